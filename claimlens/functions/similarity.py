"""Token-order-free similarities of short texts, 0 to 100, by the longest common subsequence; Arrow UDFs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from ..fixed import GOLD_POSITION, LABEL_POSITION, UNKNOWN_POSITION


_LETTERS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789 ")}


def subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: one bit a character of a, one step a character of b."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & places.get(c, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


def common_at_least(a: str, b: str, least: float) -> int | None:
    """Length of the longest common subsequence if it is least or more, else null: left off when the rest can't make up for it."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, size = (1 << len(a)) - 1, len(a)
    free = full
    for at, c in enumerate(b, 1):
        hit = free & places.get(c, 0)
        free = (free + hit | free - hit) & full
        if at % 32 == 0 and size - free.bit_count() + len(b) - at < least:
            return None
    found = size - free.bit_count()
    return found if found >= least else None


def letters(texts: list[str]) -> np.ndarray:
    """How often each letter, figure and space is in processed texts."""
    return np.array([[t.count(c) for c in _LETTERS] for t in texts], np.int32).reshape(len(texts), len(_LETTERS))


#: Texts that are compared with another at once.
LINED = 256


class Lined:
    """Texts that ``common`` lines up as one long number, each in places of its own with one to spare, where its carry ends."""

    def __init__(self, texts: list[str]) -> None:
        self.sizes = np.array([len(t) for t in texts], np.int64)
        width = 8 * (int(self.sizes.max(initial=0)) // 8 + 1)
        row, at = np.repeat(np.arange(len(texts)), self.sizes), np.arange(self.sizes.sum()) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.full, self.places = self._packed(len(texts), width, row, at), {}
        for c in np.unique(code):
            of = code == c
            self.places[chr(c)] = self._packed(len(texts), width, row[of], at[of])

    @staticmethod
    def _packed(n: int, width: int, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        bits = np.zeros((n, width), bool)
        bits[row, at] = True
        return np.packbits(bits, axis=1, bitorder="little")

    def common(self, text: str, rows: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of text with these rows, as ``subsequence`` finds one."""
        line = lambda x: int.from_bytes(x[rows].tobytes(), "little")
        places = {c: line(self.places[c]) for c in set(text) & self.places.keys()}
        free = full = line(self.full)
        for c in text:
            hit = free & places.get(c, 0)
            free = (free + hit | free - hit) & full
        left = np.frombuffer(free.to_bytes(len(rows) * self.full.shape[1], "little"), np.uint8).reshape(len(rows), -1)
        return self.sizes[rows] - np.bitwise_count(left).sum(1, dtype=np.int64)


def near_pairs(ours: list[str], least: list[int], theirs: list[str]) -> Iterator[tuple[int, int, int]]:
    """(i, j, score) of processed texts, tokens sorted, whose ratio rounds to least[i] or more.

    Lengths and letters bound the common subsequence of all pairs at once; only what these leave is compared, a text with many at once.
    """
    a, b = letters(ours), letters(theirs)
    n, m = a.sum(1), b.sum(1)
    both = np.zeros((len(ours), len(theirs)), np.int32)
    for c in range(len(_LETTERS)):
        both += np.minimum(a[:, c, None], b[None, :, c])
    need = (2 * np.array(least)[:, None] - 1) * (n[:, None] + m[None, :]) / 400  # a ratio of least - 0.5 may round to least
    fits, lined = both >= need, Lined(ours)
    for j, text in enumerate(theirs):
        rows = np.flatnonzero(fits[:, j])
        for some in (rows[at : at + LINED] for at in range(0, len(rows), LINED)):
            score = np.rint(200.0 * lined.common(text, some) / (n[some] + m[j])).astype(int).tolist()
            yield from ((i, j, x) for i, x in zip(some.tolist(), score) if x >= least[i])


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * subsequence(a, b) / (len(a) + len(b))


def processed(text: str | None) -> str:
    return re.sub(r"[^a-z0-9]", " ", (text or "").encode("ascii", "ignore").decode().lower()).strip()


def token_sort(a: str | None, b: str | None) -> int:
    x, y = (" ".join(sorted(processed(t).split())) for t in (a, b))
    return round(ratio(x, y)) if x and y else 0


def token_set(a: str | None, b: str | None) -> int:
    x, y = (set(processed(t).split()) for t in (a, b))
    if not x or not y:
        return 0
    both, one, two = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    first, second = f"{both} {one}".strip(), f"{both} {two}".strip()
    pairs = [(first, second)] if not both else [(both, first), (both, second), (first, second)]
    return max(round(ratio(*p)) for p in pairs)


class Sides:
    """Rows (id, tokens, text) of one side of a combined match: token sets, their joined strings' lengths and letters."""

    def __init__(self, ids: list, tokens: list[list[str] | None], texts: list[str | None]) -> None:
        self.ids = ids
        self.tokens = [set(t or ()) for t in tokens]
        self.words = [set(processed(t).split()) for t in texts]
        self.sizes = np.array([max(0, sum(map(len, w)) + len(w) - 1) for w in self.words], np.float64)
        self.letters = np.zeros((len(ids), len(_LETTERS)), np.int32)
        for row, words in zip(self.letters, self.words):
            for c in " ".join(words):
                row[_LETTERS[c]] += 1
        self.by_token, self.by_word = (Places(x) for x in (self.tokens, self.words))


class Places:
    """Which of some sets each of their members is in, one after the other."""

    def __init__(self, sets: list[set[str]]) -> None:
        self.sets, self.code = sets, {}
        code = np.array([self.code.setdefault(x, len(self.code)) for s in sets for x in s], np.int64)
        self.rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[np.argsort(code, kind="stable")]
        self.uses = np.bincount(code, minlength=len(self.code))
        self.starts = np.cumsum(self.uses) - self.uses

    def met(self, other: "Places") -> tuple[np.ndarray, np.ndarray]:
        """For each member that one of these sets (down) and one of other's (across) have: the pair's number, and the member's length."""
        found = [(j, self.code[x], len(x)) for j, s in enumerate(other.sets) for x in s if x in self.code]
        column, code, length = np.array(found, np.int64).reshape(-1, 3).T
        n = self.uses[code]
        place = np.repeat(self.starts[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.rows[place] * len(other.sets) + np.repeat(column, n), np.repeat(length, n)


def bounds(a: Sides, b: Sides) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of a row of a and of b: shared tokens over all tokens, the token-set ratio as far as common words alone
    give it, and what it is at most.

    A pair's strings are the common words, and they with either side's other words: the first is a prefix of the others,
    and the others' common subsequence has no more of a letter than either has.
    """
    shape, cells = (len(a.ids), len(b.ids)), len(a.ids) * len(b.ids)
    both = np.bincount(a.by_token.met(b.by_token)[0], minlength=cells).reshape(shape)
    cell, length = a.by_word.met(b.by_word)
    common, n_common = np.bincount(cell, length, cells).astype(np.int64).reshape(shape), np.bincount(cell, minlength=cells).reshape(shape)
    sizes = np.array([len(t) for t in a.tokens])[:, None] + np.array([len(t) for t in b.tokens])[None, :] - both
    shared = np.where(both > 0, both / np.maximum(sizes, 1), 0.0)
    prefix = common + np.maximum(n_common - 1, 0)
    one, two = a.sizes[:, None], b.sizes[None, :]
    some = (one > 0) & (two > 0)
    least = np.where(n_common > 0, np.maximum(np.rint(200 * prefix / np.maximum(prefix + one, 1)), np.rint(200 * prefix / np.maximum(prefix + two, 1))), 0)
    kind = np.int16 if min(a.sizes.max(initial=0), b.sizes.max(initial=0)) < 1 << 15 and max(a.letters.max(initial=0), b.letters.max(initial=0)) < 1 << 15 else np.int32
    alike = np.zeros(both.shape, kind)
    for ours, theirs in zip(a.letters.T.astype(kind, order="C"), b.letters.T.astype(kind, order="C")):
        alike += np.minimum(ours[:, None], theirs)
    most = np.where(some, np.maximum(least, np.rint(200.0 * alike / np.maximum(one + two, 1))), 0)
    return shared, np.where(some, least, 0), most


def whole_ratio(x: set[str], y: set[str], least: float = 0.0) -> int:
    """The ratio of two sets' joined strings, common words first: past these, which both start with, only the rest is compared.

    0 where it is clear before the end that it is under least.
    """
    both, one, two = sorted(x & y), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    start = " ".join(both) + " " * bool(both and one and two)
    size = lambda rest: len(" ".join(both)) + bool(both and rest) + len(rest)
    whole = size(one) + size(two)
    found = common_at_least(one, two, (least - 0.5) * whole / 200 - len(start))
    return 0 if found is None else round(200.0 * (len(start) + found) / whole)


#: Bits of a block of texts whose common subsequences are found together.
BLOCK_BITS = 1 << 24


def common_of_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """``subsequence`` of each a with its b, of processed texts: pairs are rows of 64-bit words, and a step takes a letter of every b."""
    out = np.zeros(len(a), np.int64)
    a, b = zip(*(p if len(p[0]) <= len(p[1]) else p[::-1] for p in zip(a, b))) if a else ((), ())
    n, m = (np.array([len(t) for t in x], np.int64) for x in (a, b))
    wide = -(-n // 64)
    order = np.lexsort((m, wide))
    order = order[(n[order] > 0) & (m[order] > 0)]
    at, none = 0, len(_LETTERS)
    while at < len(order):
        most = max(1, BLOCK_BITS // (64 * none * int(wide[order[at]])))
        some = order[at : at + most]
        some = some[wide[some] == wide[some[0]]]
        at += len(some)
        rows, words = np.arange(len(some)), int(wide[some[0]])
        bits = np.zeros((len(some), none + 1, 64 * words), bool)
        row, place, code = _coded([a[i] for i in some], n[some])
        bits[row, code, place] = True
        places = np.packbits(bits, axis=2, bitorder="little").view(np.uint64).reshape(-1, words).T.copy()
        row, place, code = _coded([b[i] for i in some], m[some])
        steps = np.full((int(m[some].max()), len(some)), none, np.int64)  # past its end a text has a letter that none has
        steps[place, row] = code
        steps += rows * (none + 1)
        free = np.full((words, len(some)), ~np.uint64(0))
        for step in steps:
            carry = None
            for held, of in zip(free, places):
                hit = of[step] & held
                added = held + hit
                over = added < hit
                if carry is not None:
                    added += carry
                    over |= added < carry
                carry = over.astype(np.uint64)
                held ^= hit
                held |= added
        out[some] = 64 * words - np.bitwise_count(free).sum(0, dtype=np.int64)
    return out


_CODES = np.zeros(128, np.int64)
_CODES[[ord(c) for c in _LETTERS]] = list(_LETTERS.values())


def _coded(texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and letter's number of each character of processed texts."""
    row = np.repeat(np.arange(len(texts)), sizes)
    return row, np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row], _CODES[np.frombuffer("".join(texts).encode(), np.uint8)]


def whole_ratios(pairs: list[tuple[set[str], set[str]]]) -> np.ndarray:
    """``whole_ratio`` of many pairs of sets that aren't empty."""
    ones, twos, starts, sizes = [], [], np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    for i, (x, y) in enumerate(pairs):
        both = x & y
        one, two = " ".join(sorted(x - both)), " ".join(sorted(y - both))
        prefix = sum(map(len, both)) + max(0, len(both) - 1)
        starts[i] = prefix + bool(both and one and two)
        sizes[i] = 2 * prefix + bool(both and one) + bool(both and two) + len(one) + len(two)
        ones.append(one)
        twos.append(two)
    return np.rint(200.0 * (starts + common_of_pairs(ones, twos)) / sizes)


#: Pairs that bounds are worked out for at once, and of a row those that are compared letter by letter before the first look at its best.
PAIRS, TRIED = 1 << 19, 16


def _sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def best_combined(held: Sides, batches: Iterator[pa.RecordBatch], per_held: bool) -> Iterator[tuple[list, list, list]]:
    """Best pairs (held id, other id, similarity) of held rows with rows (id, tokens, text) that stream by.

    Similarity is the mean of shared tokens and the token-set ratio.  With per_held, the best other row of each held row
    in the whole stream, else the best held row of each other row; of equals the least id.  Only pairs that may beat
    the best so far, and what common words alone give any pair of the row, are compared letter by letter, those of all rows at once.
    """
    best: dict = {}
    for batch in _sliced(batches, max(1, PAIRS // max(1, len(held.ids)))):
        rows = Sides(batch.column("id").to_pylist(), batch.column("tokens").to_pylist(), batch.column("text").to_pylist())
        shared, least, most = bounds(held, rows)
        top = (shared + most / 100.0) / 2
        ours, theirs = (held, rows) if per_held else (rows, held)
        if not per_held:
            shared, least, most, top, best = shared.T, least.T, most.T, top.T, {}
        beat = np.maximum(((shared + least / 100.0) / 2).max(1, initial=0.0), [best[key][0] if key in best else 0.0 for key in ours.ids])
        left = [row[np.argsort(-top[i, row], kind="stable")] for i, row in enumerate(np.flatnonzero(x) for x in (top > 0) & (top >= beat[:, None]))]
        at, end = 0, TRIED
        while tried := [(i, j) for i, row in enumerate(left) for j in row[at:end].tolist() if top[i, j] >= beat[i]]:
            at, end = end, 3 * end
            i, j = np.array(tried).T
            ratio, open_ = least[i, j], np.flatnonzero(least[i, j] < most[i, j])
            ratio[open_] = np.maximum(ratio[open_], whole_ratios([(ours.words[tried[x][0]], theirs.words[tried[x][1]]) for x in open_.tolist()]))
            for x, y, told in zip(i.tolist(), j.tolist(), ((shared[i, j] + ratio / 100.0) / 2).tolist()):
                key, found = ours.ids[x], best.get(ours.ids[x])
                if told > 0 and (not found or told > found[0] or told == found[0] and theirs.ids[y] < found[1]):
                    best[key] = (told, theirs.ids[y])
                    beat[x] = max(beat[x], told)
        if not per_held:
            yield [x[1] for x in best.values()], list(best), [x[0] for x in best.values()]
    if per_held:
        yield list(best), [x[1] for x in best.values()], [x[0] for x in best.values()]


class Tokens:
    """Rows (id, distinct tokens) of one side of a match by shared tokens: which rows each token has, one after the other."""

    def __init__(self, ids: list, tokens: list[list[str] | None]) -> None:
        self.ids = ids
        self.sizes = np.array([len(t or ()) for t in tokens], np.int64)
        flat = pa.array([x for t in tokens for x in t or ()], pa.string())
        self.known = pc.unique(flat)
        code = pc.index_in(flat, self.known).to_numpy(zero_copy_only=False).astype(np.int64)
        self.rows = np.repeat(np.arange(len(ids)), self.sizes)[np.argsort(code, kind="stable")]
        self.uses = np.bincount(code, minlength=len(self.known))
        self.starts = np.cumsum(self.uses) - self.uses

    def shares(self, tokens: pa.ListArray) -> np.ndarray:
        """Shared tokens over all tokens of each row (down) with each held row (across)."""
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        code = pc.index_in(tokens.flatten(), self.known)
        some = pc.is_valid(code).to_numpy(zero_copy_only=False)
        row, code = np.repeat(np.arange(len(sizes)), sizes)[some], pc.drop_null(code).to_numpy(zero_copy_only=False)
        n = self.uses[code]
        place = np.repeat(self.starts[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat(row, n) * len(self.ids) + self.rows[place]
        both = np.bincount(cell, minlength=len(sizes) * len(self.ids)).reshape(len(sizes), len(self.ids))
        return both / np.maximum(sizes[:, None] + self.sizes[None, :] - both, 1)


def best_shared(held: Tokens, batches: Iterator[pa.RecordBatch], per_held: bool) -> Iterator[tuple[list, list, list]]:
    """best_combined's pairs for rows (id, tokens), where similarity is shared tokens over all tokens alone."""
    if not held.ids:
        return
    best: dict = {}
    across = np.array(sorted(range(len(held.ids)), key=held.ids.__getitem__), np.int64)
    for batch in _sliced(batches, max(1, PAIRS // max(1, len(held.ids)))):
        ids = batch.column("id").to_pylist()
        down = np.array(sorted(range(len(ids)), key=ids.__getitem__), np.int64)
        share = held.shares(batch.column("tokens"))[np.ix_(down, across)]  # the first of equals has the least id
        if not per_held:
            first = share.argmax(1)
            found = [(held.ids[across[j]], ids[down[i]], float(share[i, j])) for i, j in enumerate(first.tolist()) if share[i, j] > 0]
            yield tuple(map(list, zip(*found))) if found else ([], [], [])
            continue
        for j, i in enumerate(share.argmax(0).tolist()):
            key, told = held.ids[across[j]], (float(share[i, j]), ids[down[i]])
            if told[0] > 0 and (key not in best or told[0] > best[key][0] or told[0] == best[key][0] and told[1] < best[key][1]):
                best[key] = told
    if per_held:
        yield list(best), [x[1] for x in best.values()], [x[0] for x in best.values()]


@F.pandas_udf(IntegerType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_sort(x, y) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(IntegerType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set(x, y) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(DoubleType())
def verdict_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """How far two labels are from each other in the order of truth, 0 to 1; of either kind the second, unknown ones unverifiable."""
    place = lambda x: GOLD_POSITION.get((x or "").strip().upper(), UNKNOWN_POSITION)
    other = lambda x: LABEL_POSITION.get((x or "").strip(), place(x))
    return pd.Series([abs(place(x) - other(y)) / 5.0 for x, y in zip(a, b)], dtype="float64")


def register(spark) -> None:
    """Makes the similarities known to SQL."""
    spark.udf.register("token_sort_ratio", token_sort_ratio)
    spark.udf.register("token_set_ratio", token_set_ratio)
    spark.udf.register("verdict_distance", verdict_distance)
