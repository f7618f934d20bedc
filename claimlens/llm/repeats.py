"""[6] Suffix-array dedup: bytes under any 400-byte string that starts elsewhere too are removed.

Every 400-byte window has one anchor, the position of its smallest 16-byte-gram hash (the leftmost of
equals), which depends on the window's bytes alone.  Consecutive windows of one anchor make a segment.
Equal windows so always meet under equal anchors, and text whose anchors occur once goes no further.

1. Equal texts become one row with a count, in a table bucketed by the text's digest, so that later joins
   move only small rows.
2. Segments (anchor, digest of the segment's bytes) are counted; anchors seen once drop out.
3. Segments with equal bytes are one, with its count.  Anchors that have several different segments go to
   shards of bounded size; each shard's suffix array and common prefixes mark the windows that repeat.
4. An anchor with more segments than a shard takes is dealt over several shards.  Each takes its distinct
   windows off its suffix array, where equal ones are neighbours, sorts their digests to a run, one digest a window
   however often it occurs, and cuts the run at the same points by binary search.  The runs of one range are merged by
   binary search; digests that two runs hold go back to the shards that hold their places.
5. Marks go back to the texts that hold the segments, and covered bytes are cut.

Null texts are empty; texts under the window's bytes keep all bytes; repeated rows are copies of each other.

Passages are cut by words in the same way (cut_passages): a text is then the string of its words' 64-bit codes, so that a
window of PASSAGE words has 8 * PASSAGE bytes, and words whose codes are covered whole are removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fields, fresh, parts, per_batch, remove, scratch, spread_join, tidy, to_batch, tune, written
from .suffixes import common_prefixes, suffix_array, words8

WINDOW = 400
GRAM = 16
#: Words of a passage that a training corpus should hold once: over 50.
PASSAGE = 51
#: Bytes of joined texts hashed at once, and the most that one piece of a text takes.
BUFFER = 1 << 20
#: Bytes that a shard's suffix array is built over, and most segments of one anchor in a shard.
SHARD_BYTES = 1 << 20
SHARD_SEGMENTS = 2048
#: Between the segments of a shard; no UTF-8 text holds it.
BREAK = 0xFF

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_TABLE = np.random.default_rng(6).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _rolled(values: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of all stretches of length (a power of two) values, modulo 2**64."""
    step, factor = 1, _BASE
    while step < length:
        values = values[: len(values) - step] * np.uint64(factor) + values[step:]
        step, factor = step * 2, factor * factor % (1 << 64)
    return values


def segments(data: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Segments of joined texts that end at ends: first window, last window, anchor hash, text's index."""
    none = (np.zeros(0, np.int64),) * 4
    if len(data) < window:
        return none
    grams = _rolled(_TABLE[data], GRAM)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    low = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    span, step = window - GRAM + 1, 1
    while step * 2 <= span:
        low = np.minimum(low[: len(low) - step], low[step:])
        step *= 2
    low = np.minimum(low[: len(low) - (span - step)], low[span - step :]) if span > step else low
    anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    # A window lies in one text if it starts window bytes or more before that text's end.
    inside = np.zeros(len(anchor) + 1, np.int8)
    whole = ends - starts >= window
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, (ends - window + 1)[whole], -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    first = inside.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    if not len(a):
        return none
    # Texts that touch: a run never passes a text's end, as its last window does not either.
    return a, b, grams[anchor[a]].view(np.int64), np.searchsorted(ends, a, side="right")


def _digest(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _pieces(texts: list[bytes], window: int) -> Iterator[tuple[bytes, list[int], list[int], list[int]]]:
    """Texts joined to buffers of about BUFFER bytes: the bytes, the pieces' ends, texts and offsets.

    Longer texts are cut into pieces that overlap by window - 1, so that each window is in one piece.
    """
    held, ends, owners, offsets, n = [], [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), BUFFER):
            piece = text[at : at + BUFFER + window - 1]
            if len(piece) >= window:
                held.append(piece)
                n += len(piece)
                ends.append(n)
                owners.append(i)
                offsets.append(at)
            if n >= BUFFER:
                yield b"".join(held), ends, owners, offsets
                held, ends, owners, offsets, n = [], [], [], [], 0
    if held:
        yield b"".join(held), ends, owners, offsets


def found_segments(texts: list[bytes], window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text's index, offset, bytes, anchor, two halves of the digest) of every segment."""
    for joined, ends, owners, offsets in _pieces(texts, window):
        stops = np.asarray(ends, np.int64)
        a, b, anchor, piece = segments(np.frombuffer(joined, np.uint8), stops, window)
        begins = np.concatenate([[0], stops[:-1]])
        at = a - begins[piece] if len(a) else a
        for first, last, h, p, off in zip(a.tolist(), b.tolist(), anchor.tolist(), piece.tolist(), at.tolist()):
            yield owners[p], offsets[p] + off, last - first + window, h, *_digest(joined[first : last + window])


def shard_marks(bodies: list[bytes], window: int = WINDOW) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a shard's segments that repeat in it: offsets by segment; and the joined bytes, their order and common prefixes."""
    joined = np.frombuffer(b"".join(x + b"\xff" for x in bodies), np.uint8)
    heads = words8(joined)
    order = suffix_array(joined, heads)
    before, shared = common_prefixes(joined, order, heads)
    hit = shared >= window
    hit[before[np.flatnonzero(hit)]] = True
    ends = np.cumsum([len(x) + 1 for x in bodies])
    out = [np.flatnonzero(hit[e - len(x) - 1 : e - window]) for x, e in zip(bodies, ends.tolist())]
    return out, joined, order, shared


def intervals(offsets: np.ndarray) -> list[int]:
    """Offsets as first, last, first, last ... of their runs."""
    if not len(offsets):
        return []
    cuts = np.flatnonzero(np.diff(offsets) != 1)
    firsts = offsets[np.concatenate([[0], cuts + 1])]
    lasts = offsets[np.concatenate([cuts, [len(offsets) - 1]])]
    return np.stack([firsts, lasts], 1).ravel().tolist()


def window_hashes(joined: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Two independent polynomial hashes of each window, as the columns of an array."""
    out = []
    for seed in (61, 62):
        codes = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)[joined]
        whole, left, at, bits = None, window, 0, []
        power = 1
        while power <= window:  # stretches by powers of two, put together to the window's length
            bits.append(power)
            power *= 2
        for size in reversed(bits):
            if left >= size:
                part = _rolled(codes, size)[at:]
                whole = part if whole is None else whole[: len(part)] * np.uint64(pow(_BASE, size, 1 << 64)) + part[: len(whole)]
                at, left = at + size, left - size
        whole = whole ^ (whole >> np.uint64(31))
        whole = whole * np.uint64(0x94D049BB133111EB)
        out.append(whole ^ (whole >> np.uint64(30)))
    return np.stack(out, 1)


SHARD = "anchor bigint, hi bigint, lo bigint, marks array<int>, reach int, digests binary, uses binary, places binary"
#: A window's place: the digest of its segment, and its offset there.
PLACE = np.dtype([("hi", "<i8"), ("lo", "<i8"), ("off", "<i4")])


def _sort_shards(batches: Iterator[pa.RecordBatch], arrow: pa.Schema, window: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and lot; each shard is some whole lots of at most SHARD_BYTES or one lot."""
    rows = ((a, s, n, hi, lo, body) for batch in batches for a, s, n, hi, lo, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "lot", "lots", "hi", "lo", "body"))))
    held, size = [], 0
    for _, lot in groupby(rows, key=lambda r: r[:2]):
        held += (lot := list(lot))
        size += sum(len(r[-1]) for r in lot)
        if size >= SHARD_BYTES:
            yield to_batch(_shard(held, window), arrow)
            held, size = [], 0
    if held:
        yield to_batch(_shard(held, window), arrow)


def _shard(rows: list[tuple], window: int) -> dict[str, list]:
    marks, joined, order, shared = shard_marks([r[-1] for r in rows], window)
    out = {"anchor": [r[0] for r in rows], "hi": [r[3] for r in rows], "lo": [r[4] for r in rows], "marks": [intervals(m) for m in marks]}
    out |= {"reach": [-1] * len(rows), **{k: [None] * len(rows) for k in ("digests", "uses", "places")}}
    if any(r[2] > 1 for r in rows):
        hashes = window_hashes(joined, window)
        begin = np.concatenate([[0], np.cumsum([len(r[-1]) + 1 for r in rows])])
        owner = np.full(len(joined), -1, np.int32)  # of windows that end in their segment
        for i in range(len(rows)):
            owner[begin[i] : begin[i + 1] - window] = i
        starts = order[owner[order] >= 0]
        same = np.cumsum(shared[starts] < window)  # equal windows have one number
        at = 0
        for (anchor, _, lots, *_), lot in groupby(rows, key=lambda r: r[:3]):
            n = len(list(lot))
            if lots > 1:
                own = (owner[starts] >= at) & (owner[starts] < at + n)
                places = np.empty(int(own.sum()), PLACE)
                segment = owner[starts[own]]
                ids = np.array([(r[3], r[4]) for r in rows], np.int64)
                places["hi"], places["lo"], places["off"] = ids[segment, 0], ids[segment, 1], starts[own] - begin[segment]
                for key, value in _cut_run(anchor, lots, hashes[starts[own]], same[own], places).items():
                    out[key] += value
            at += n
    return out


def _cut_run(anchor: int, lots: int, hashes: np.ndarray, same: np.ndarray, places: np.ndarray) -> dict[str, list]:
    """The lot's distinct windows as a sorted run of digests, cut by binary search into as many ranges as there are lots.

    Each range has its digests, how many places each has in the lot, and those places.
    """
    firsts = np.flatnonzero(np.diff(same, prepend=-1))
    uses = np.diff(firsts, append=len(same))
    order = np.lexsort((hashes[firsts, 1], hashes[firsts, 0]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    places = places[np.argsort(np.repeat(rank, uses), kind="stable")]
    digests, uses = hashes[firsts[order]], uses[order]
    ends = np.concatenate([[0], np.cumsum(uses)])
    cuts = np.searchsorted(digests[:, 0], (np.arange(1, lots, dtype=np.float64) / lots * 2.0**64).astype(np.uint64))
    edges = np.concatenate([[0], cuts, [len(digests)]])
    out: dict[str, list] = {k: [] for k in ("anchor", "hi", "lo", "marks", "reach", "digests", "uses", "places")}
    for r in range(lots):
        a, b = int(edges[r]), int(edges[r + 1])
        if b > a:
            for key, value in (("anchor", anchor), ("hi", 0), ("lo", 0), ("marks", []), ("reach", r), ("digests", np.ascontiguousarray(digests[a:b]).tobytes()), ("uses", uses[a:b].astype("<i4").tobytes()), ("places", places[ends[a] : ends[b]].tobytes())):
                out[key].append(value)
    return out


def _run(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64).reshape(-1, 2)


def merged_runs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of distinct digests, each with those found twice so far, as one: each of b is searched in a."""
    hit = _holds(a[0], b[0])
    new = b[0][~hit]
    return np.insert(a[0], np.searchsorted(a[0][:, 0], new[:, 0]), new, axis=0), np.concatenate([a[1], b[1], b[0][hit]])


def _merge_runs(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and range: the digests of a range that two of its runs hold."""
    rows = ((a, r, run) for batch in batches for a, r, run in zip(*(batch.column(c).to_pylist() for c in ("anchor", "reach", "digests"))))
    for (anchor, reach), group in groupby(rows, key=lambda r: r[:2]):
        stack: list[tuple[np.ndarray, np.ndarray]] = []
        for _, _, run in group:
            stack.append((_run(run), np.zeros((0, 2), np.uint64)))
            while len(stack) > 1 and len(stack[-2][0]) <= 2 * len(stack[-1][0]):  # runs of like sizes meet
                stack.append(merged_runs(*reversed([stack.pop(), stack.pop()])))
        while len(stack) > 1:
            stack.append(merged_runs(*reversed([stack.pop(), stack.pop()])))
        twice = np.unique(stack[0][1], axis=0)
        if len(twice):
            yield to_batch({"anchor": [anchor], "reach": [reach], "twice": [twice.tobytes()]}, arrow)


def _found(batch: pa.RecordBatch) -> dict[str, list]:
    """A lot's places of those of its windows that another lot has too."""
    out: dict[str, list] = {k: [] for k in ("anchor", "hi", "lo", "marks")}
    for anchor, digests, uses, places, twice in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digests", "uses", "places", "twice"))):
        hit = np.repeat(_holds(_run(twice), _run(digests)), np.frombuffer(uses, "<i4"))
        found: dict[tuple[int, int], list[int]] = {}
        for hi, lo, off in np.frombuffer(places, PLACE)[hit].tolist():
            found.setdefault((hi, lo), []).append(off)
        for (hi, lo), offsets in found.items():
            for key, value in (("anchor", anchor), ("hi", hi), ("lo", lo), ("marks", intervals(np.unique(offsets)))):
                out[key].append(value)
    return out


def _holds(run: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each wanted digest is in a sorted run, by binary search on the first half and a look at the second."""
    left = np.searchsorted(run[:, 0], wanted[:, 0])
    out = np.zeros(len(wanted), bool)
    live = np.flatnonzero(left < len(run))
    while len(live):
        at = left[live]
        live, at = live[run[at, 0] == wanted[live, 0]], at[run[at, 0] == wanted[live, 0]]
        out[live[run[at, 1] == wanted[live, 1]]] = True
        live = live[~out[live]]
        left[live] += 1
        live = live[left[live] < len(run)]
    return out


def word_codes(text: bytes) -> bytes:
    """Eight bytes a word, none of them BREAK."""
    words = text.split()
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.uint8)
    codes[codes == BREAK] = BREAK - 1
    return codes.tobytes()


def _as_it_is(text: bytes) -> bytes:
    return text


def _spans(covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(covered):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _word_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Bytes of the words whose codes lie whole in spans of codes, and of the white space after them."""
    if not spans:
        return []
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    return [(starts[-(-a // 8)], starts[b // 8]) for a, b in spans if b // 8 > -(-a // 8)]


def _cut(window: int, words: bool):
    seen = word_codes if words else _as_it_is

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        texts = as_bytes(batch.column("text"))
        marks = batch.column("found").to_pylist()
        wanted: list[dict[tuple[int, int], list[int]]] = [{} for _ in texts]
        for w, row in zip(wanted, marks):
            for m in row or []:
                w.setdefault((m["hi"], m["lo"]), []).extend(m["marks"])
        covered: list[list[tuple[int, int]]] = [[] for _ in texts]
        busy = [i for i, w in enumerate(wanted) if w]
        for i, at, _, _, hi, lo in found_segments([seen(texts[i]) for i in busy], window):
            spans = wanted[busy[i]].get((hi, lo), ())
            covered[busy[i]] += [(at + a, at + b + window) for a, b in zip(spans[::2], spans[1::2])]
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")}
        for i, text in enumerate(texts):
            kept, at = [], 0
            spans = _word_spans(text, _spans(covered[i])) if words else _spans(covered[i])
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            rest = b"".join([*kept, text[at:]])
            for k, v in (("n_bytes", len(text)), ("n_removed", len(text) - len(rest)), ("n_spans", len(spans)), ("kept_sha256", hashlib.sha256(rest).hexdigest()), ("kept_text", rest.decode("utf-8", "ignore"))):
                out[k].append(v)
        return {"k1": batch.column("k1"), "k2": batch.column("k2"), **out}

    return work


def remove_repeats(documents: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """One row per row of documents: all its columns but text, n_bytes, n_removed, n_spans, kept_sha256.

    With keep_text also kept_text: what is left, without characters that were cut through.  Columns of
    documents that have one of these names give way to the result.
    """
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * keep_text]
    keyed, keys = _keyed(documents)
    cut = _cut_texts(keyed.select(*keys, "text"), keys, window, keep_text).select(*keys, *results)
    return keyed.drop("text", *results).join(cut, keys).drop(*keys)


def cut_passages(documents: DataFrame, words: int = PASSAGE) -> DataFrame:
    """documents without the words that are covered by a run of so many words that also starts elsewhere.

    All columns and rows stay; null texts stay null, and texts with fewer words as they are.
    """
    keyed, keys = _keyed(documents)
    left, null = fresh(keyed, "left", "null")
    cut = _cut_texts(keyed.select(*keys, "text"), keys, 8 * words, True, words=True).select(*keys, F.col("kept_text").alias(left))
    lean = keyed.withColumn(null, F.col("text").isNull()).drop("text")
    return lean.join(cut, keys).withColumn("text", F.when(~F.col(null), F.col(left))).select(documents.columns)


def _keyed(documents: DataFrame) -> tuple[DataFrame, list[str]]:
    """documents with two columns that name the text, and these columns' names."""
    keys = fresh(documents, "k1", "k2")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return documents.withColumns({k: F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long") for i, k in enumerate(keys)}), keys


def _cut_of(texts: DataFrame, seen_as: Callable[[bytes], bytes], window: int, keep_text: bool, words: bool, n: int) -> DataFrame:
    """_cut_texts' rows of the distinct texts (k1, k2, text, copies), which are bucketed by their keys."""
    spark = texts.sparkSession

    def runs_of(batch: pa.RecordBatch) -> dict[str, list]:
        held, copies = [seen_as(t) for t in as_bytes(batch.column("text"))], batch.column("copies").to_pylist()
        k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
        seen: dict[tuple[int, int, int, int], list[int]] = {}
        for i, at, size, anchor, hi, lo in found_segments(held, window):
            if row := seen.get((i, anchor, hi, lo)):
                row[2] += copies[i]
            else:
                seen[i, anchor, hi, lo] = [at, size, copies[i]]
        keys, rows = list(seen), list(seen.values())
        return {"anchor": [k[1] for k in keys], "hi": [k[2] for k in keys], "lo": [k[3] for k in keys], "k1": [k1[k[0]] for k in keys], "k2": [k2[k[0]] for k in keys], "at": [r[0] for r in rows], "size": [r[1] for r in rows], "n": [r[2] for r in rows]}

    runs = written(per_batch(texts, "anchor bigint, hi bigint, lo bigint, k1 bigint, k2 bigint, at int, size int, n bigint", runs_of), "segments")
    counted = runs.groupBy("anchor").agg(F.sum("n").alias("uses"), F.min("hi").alias("h1"), F.max("hi").alias("h2"), F.min("lo").alias("l1"), F.max("lo").alias("l2"), F.count(F.lit(1)).alias("lines")).where("uses > 1").selectExpr("anchor", "h1 <> h2 or l1 <> l2 as mixed", "lines")
    counted = written(counted, "anchors")
    again = written(spread_join(runs, counted.select("anchor", "mixed"), ["anchor"], ["k1", "k2", "at"], uses=counted.select("anchor", F.col("lines").alias("n"))), "repeated")

    one = again.groupBy("anchor", "hi", "lo").agg(F.sum("n").alias("n"), F.min(F.struct("k1", "k2", "at", "size")).alias("home"), F.first("mixed").alias("mixed"), F.count(F.lit(1)).alias("lines"))
    one = written(one.select("anchor", "hi", "lo", "n", "mixed", "lines", "home.*"), "distinct")
    lots = one.where("mixed").groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / SHARD_SEGMENTS).cast("int").alias("lots"))
    asked = one.where("mixed").join(lots, "anchor").groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "hi", "lo", "at", "size", "lots")).alias("asked"))

    def bodies(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("anchor", "lot", "lots", "hi", "lo", "body")}
        for text, row in zip(as_bytes(batch.column("text")), batch.column("asked").to_pylist()):
            text = seen_as(text)
            for m in row:
                for k, v in (("anchor", m["anchor"]), ("lot", m["lo"] % m["lots"]), ("lots", m["lots"]), ("hi", m["hi"]), ("lo", m["lo"]), ("body", text[m["at"] : m["at"] + m["size"]])):
                    out[k].append(v)
        return out

    fetched = per_batch(texts.select("k1", "k2", "text").join(asked, ["k1", "k2"]), "anchor bigint, lot int, lots int, hi bigint, lo bigint, body binary", bodies)
    shard_arrow, run_arrow = fields(SHARD, spark), fields("anchor bigint, reach int, twice binary", spark)
    shards = written(fetched.repartition(n, "anchor", "lot").sortWithinPartitions("anchor", "lot").mapInArrow(tidy(lambda b: _sort_shards(b, shard_arrow, window)), SHARD), "shards")
    lot_runs = shards.where("reach >= 0").select("anchor", "reach", "digests", "uses", "places")
    twice = lot_runs.select("anchor", "reach", "digests").repartition(n, "anchor", "reach").sortWithinPartitions("anchor", "reach").mapInArrow(tidy(lambda b: _merge_runs(b, run_arrow)), "anchor bigint, reach int, twice binary")
    merged = per_batch(lot_runs.join(twice, ["anchor", "reach"]), "anchor bigint, hi bigint, lo bigint, marks array<int>", _found)
    whole = one.where("n > 1").select("anchor", "hi", "lo", F.array(F.lit(0), (F.col("size") - window)).alias("marks"))
    marks = shards.where("reach < 0 and size(marks) > 0").select("anchor", "hi", "lo", "marks").unionByName(merged).unionByName(whole)
    segment = ["anchor", "hi", "lo"]
    held = spread_join(again.select(*segment, "k1", "k2"), marks, segment, ["k1", "k2"], uses=one.select(*segment, F.col("lines").alias("n"))).groupBy("k1", "k2").agg(F.collect_list(F.struct("hi", "lo", "marks")).alias("found"))
    cut = per_batch(texts.select("k1", "k2", "text").join(held, ["k1", "k2"], "left"), "k1 bigint, k2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string", _cut(window, words))
    cut = written(cut if keep_text else cut.drop("kept_text"), "cut")
    for done in (runs, counted, again, one, shards):
        remove(spark, done)
    return cut


def _cut_texts(keyed: DataFrame, keys: list[str], window: int, keep_text: bool, words: bool = False) -> DataFrame:
    """A row for each distinct text, by its keys: what is left of it; a written table."""
    spark, seen_as = keyed.sparkSession, word_codes if words else _as_it_is
    tune(spark)
    lean = keyed.select(F.col(keys[0]).alias("k1"), F.col(keys[1]).alias("k2"), F.coalesce("text", F.lit("")).alias("text"))
    n = parts(keyed)
    name = "claimlens_texts_" + scratch(spark, "x").rsplit("-", 1)[1]
    lean.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")).repartition(n, "k1", "k2").write.bucketBy(n, "k1", "k2").sortBy("k1", "k2").option("compression", "zstd").option("path", scratch(spark, "texts")).saveAsTable(name)
    texts = spark.table(name)

    try:
        cut = _cut_of(texts, seen_as, window, keep_text, words, n)
    finally:
        remove(spark, texts)
        spark.sql(f"DROP TABLE {name}")
    return cut.withColumnsRenamed(dict(zip(("k1", "k2"), keys)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
