"""[9] Benchmark decontamination over a positional inverted index of the training documents.

The index is dealt by documents, as search engines do it: each segment holds all postings of some documents, for
each term a sorted list of (document, position), and is a row of a table in the shared folder.  A search sends
the test windows to every segment.  Corpus frequencies of the windows' terms come from the index; a window
starts from the list of its rarest term, shifts it by the term's place in the window, and intersects it with
the shifted lists of the other terms, from rare to frequent.  Windows with a term that the corpus lacks end there.
A window is near where all its terms lie, in any order and each as often as the window has it, within as many consecutive words
as the window has and SLOP more.

Test items go out in slices of at most SLICE_WORDS words, so what is broadcast is bounded whatever their number.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LARGE_ROWS, as_bytes, fields, fresh, per_batch, tidy, to_batch, tune, written

WINDOW = 13
#: Words between a window's terms, beyond its own, that a proximity match may have.
SLOP = 3
#: Words of test items that are searched for, and broadcast, at once.
SLICE_WORDS = 1_000_000
#: More than any posting, which is a document's place and a word's.
LAST = np.iinfo(np.int64).max
#: A-Z to a-z; other ASCII than letters and digits to a space; bytes of non-ASCII characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SEGMENT = "seg string, doc_ids array<bigint>, n_words array<bigint>, terms array<binary>, ends array<int>, docs binary, at binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows_of(words: list, size: int = WINDOW) -> list[tuple]:
    """Runs of size words; fewer words, but some, are one window."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def index(documents: DataFrame) -> DataFrame:
    """Segments of the postings of doc_id and text, of all terms; a written table."""

    def segment(batch: pa.RecordBatch) -> dict[str, list]:
        split = [words_of(t) for t in as_bytes(batch.column("text"))]
        ids: dict[bytes, int] = defaultdict(count().__next__)
        sizes = np.array([len(w) for w in split], np.int64)
        code = np.fromiter(map(ids.__getitem__, chain.from_iterable(split)), np.int32, int(sizes.sum()))
        doc = np.repeat(np.arange(len(split), dtype=np.int64), sizes)
        at = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(code.astype(np.uint16) if len(ids) < 1 << 16 else code, kind="stable")  # 16 bits are sorted by radix
        ends = np.cumsum(np.bincount(code, minlength=len(ids)))
        return {"seg": [uuid.uuid4().hex], "doc_ids": [batch.column("doc_id").to_pylist()], "n_words": [sizes.tolist()], "terms": [list(ids)], "ends": [ends.tolist()], "docs": [doc[order].astype("<u2").tobytes()], "at": [at[order].astype("<u4").tobytes()]}

    return written(per_batch(documents.select("doc_id", "text"), SEGMENT, segment), "index", LARGE_ROWS)


def _part(column: pa.ListArray, row: int) -> pa.Array:
    """One row's values."""
    begin, end = column.offsets[row].as_py(), column.offsets[row + 1].as_py()
    return column.values.slice(begin, end - begin)


def _wanted(column: pa.ListArray, row: int, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which of a segment's terms are among terms: their places in the segment, and in terms."""
    found = pc.index_in(_part(column, row), value_set=terms)
    at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    return at, found.drop_null().to_numpy(zero_copy_only=False)


def frequencies(segments: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """Postings in the whole corpus of those of the terms that it has."""
    names = sorted(terms)
    sent = segments.sparkSession.sparkContext.broadcast(names)
    arrow = fields("term int, n bigint", segments.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(sent.value, pa.binary())
        totals = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                at, term = _wanted(batch.column("terms"), row, wanted)
                totals[term] += np.diff(_part(batch.column("ends"), row).to_numpy(), prepend=0)[at]
        held = np.flatnonzero(totals)
        yield to_batch({"term": held, "n": totals[held]}, arrow)

    counted = segments.select("terms", "ends").mapInArrow(tidy(run), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {names[r["term"]]: r["n"] for r in counted.collect()}  # at most the slice's terms


def _rarest_first(items: list[tuple], known: dict[bytes, int], size: int) -> tuple[list[bytes], dict[int, list[tuple]]]:
    """The terms of windows that may occur, and these windows by their rarest term, a place in the terms: (place of that term in the window, length, the other terms and places from rare to frequent, items)."""
    holders: dict[tuple, list[int]] = defaultdict(list)
    for i, (_, words) in enumerate(items):
        for window in set(windows_of(words, size)):
            holders[window].append(i)
    holders = {window: owners for window, owners in holders.items() if all(t in known for t in window)}
    terms = sorted({t for window in holders for t in window})
    number = {t: i for i, t in enumerate(terms)}
    out: dict[int, list[tuple]] = defaultdict(list)
    for window, owners in holders.items():
        places = sorted(range(len(window)), key=lambda p: (known[window[p]], p))
        out[number[window[places[0]]]].append((places[0], len(window), [(number[window[p]], p) for p in places[1:]], owners))
    return terms, dict(out)


def _holds(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return keys[keys.searchsorted(wanted)] == wanted


def _together(around: np.ndarray, lists, counts: Counter, width: int) -> np.ndarray:
    """Which of the places lie in some width consecutive words that hold every term as often as counts says."""
    start = around[:, None] - np.arange(width)
    good = np.ones(start.shape, bool)
    for term, n in counts.items():
        held = lists(term)
        good &= held.searchsorted(start + width) - held.searchsorted(start) >= n
        if not good.any():
            break
    return good.any(1)


def _search(terms: list[bytes], plan: dict[int, list[tuple]], slop: int):
    """Spans and items of each document of a segment: exact matches, and the items of near ones."""
    wanted = pa.array(terms, pa.binary())

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("seg", "ord", "doc_id", "n_words", "spans", "items", "near")}
        for row, (seg, doc_ids, sizes, docs, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("seg", "doc_ids", "n_words", "docs", "at")))):
            ends, docs, at = np.concatenate([[0], _part(batch.column("ends"), row).to_numpy()]).astype(np.int64), np.frombuffer(docs, "<u2"), np.frombuffer(at, "<u4")
            # Each list ends with a number that no posting has.
            lists = {term: np.append(docs[ends[i] : ends[i + 1]].astype(np.int64) << 32 | at[ends[i] : ends[i + 1]], LAST) for i, term in zip(*(x.tolist() for x in _wanted(batch.column("terms"), row, wanted)))}
            spans: dict[int, set] = defaultdict(set)
            items: dict[int, set] = defaultdict(set)
            near: dict[int, set] = defaultdict(set)
            for term in plan.keys() & lists.keys():
                own = lists[term][:-1]
                for place, length, others, owners in plan[term]:
                    if any(t not in lists for t, _ in others):
                        continue
                    # Near its rarest term are all a window's terms wherever it occurs, so what isn't near need not be looked at.
                    around, reach = own, length - 1 + slop
                    for t, _ in others:
                        held = lists[t]
                        around = around[held[held.searchsorted(around - reach)] <= around + reach]
                        if not around.size:
                            break
                    if not around.size:
                        continue
                    begin = around[(around & 0xFFFFFFFF) >= place] - place
                    for t, p in others:
                        if not len(begin):
                            break
                        begin = begin[_holds(lists[t], begin + p)]
                    for key in begin.tolist():
                        spans[key >> 32].add((key & 0xFFFFFFFF, length))
                        items[key >> 32].update(owners)
                    for key in around[_together(around, lists.__getitem__, Counter([term, *(t for t, _ in others)]), length + slop)].tolist():
                        near[key >> 32].update(owners)
            for i, (doc_id, n) in enumerate(zip(doc_ids, sizes)):
                out["seg"].append(seg)
                out["ord"].append(i)
                out["doc_id"].append(doc_id)
                out["n_words"].append(n)
                out["spans"].append([x for s in sorted(spans.get(i, ())) for x in s])
                out["items"].append(sorted(items.get(i, ())))
                out["near"].append(sorted(near.get(i, ())))
        return out

    return work


def _slices(benchmark: DataFrame) -> Iterator[list[tuple]]:
    held, n = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of((row["text"] or "").encode())
        held.append((row["item_id"], words))
        n += len(words)
        if n >= SLICE_WORDS:
            yield held
            held, n = [], 0
    yield held


FOUND = "seg string, ord int, doc_id bigint, n_words bigint, spans array<bigint>, items array<string>, near array<string>"


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row per row of documents: doc_id, n_words, spans (first word, words, ...), items, and near.

    items are the ids, as strings, of items of which some window occurs word for word; near those of which all of some
    window's words lie within its length and slop consecutive words, so items are near too.  Null texts
    have no words; an item without words has no window; items of one id are one; a null id is "null".
    """
    spark = documents.sparkSession
    tune(spark)
    segments = index(documents)
    found = []
    for items in _slices(benchmark):
        names = ["null" if i is None else str(i) for i, _ in items]
        known = frequencies(segments, {w for _, words in items for w in words})
        plan = spark.sparkContext.broadcast((*_rarest_first(items, known, window), names))

        def work(batch: pa.RecordBatch, plan=plan) -> dict[str, list]:
            terms, windows, called = plan.value
            out = _search(terms, windows, slop)(batch)
            for column in ("items", "near"):
                out[column] = [sorted({called[i] for i in row}) for row in out[column]]
            return out

        found.append(per_batch(segments, FOUND, work))
    if len(found) == 1:
        return found[0].drop("seg", "ord")
    # Each slice's matches are written: what is joined in the end is a union of tables, not of searches.
    found = [written(f, "found") for f in found]
    merged = reduce(DataFrame.unionByName, found).groupBy("seg", "ord", "doc_id", "n_words").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near")))
    return merged.withColumns({c: F.array_sort(F.array_distinct(c)) for c in ("items", "near")}).drop("seg", "ord")


def _digest(batch: pa.RecordBatch) -> dict[str, list]:
    hits = []
    for row in batch.column("spans").to_pylist():
        n = end = 0
        for start, length in sorted(zip(row[::2], row[1::2])):
            n += max(0, start + length - max(start, end))
            end = max(end, start + length)
        hits.append(n)
    items, near = batch.column("items").to_pylist(), batch.column("near").to_pylist()
    return {"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "n_hit": hits, "n_items": [len(x) for x in items], "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], "n_near": [len(x) for x in near]}


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, n_near (items with near windows) and contaminated: a
    twentieth or more of the words are hit."""
    counted = per_batch(find(documents, benchmark), "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, n_near bigint", _digest)
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that aren't contaminated, with all their columns; ids play no part.

    A row goes by its text alone: texts are named by 64-bit digests in place of ids.
    """
    (mark,) = fresh(documents, "mark")
    marked = documents.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    dirty = contamination(marked.select(F.col(mark).alias("doc_id"), "text"), benchmark).where("contaminated").select(F.col("doc_id").alias(mark)).distinct()
    return marked.join(dirty, mark, "left_anti").select(documents.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same by joining all windows.
SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
tests AS (
  SELECT id AS item, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13 THEN [w] ELSE list_transform(range(1, len(w) - 11), lambda i: w[i:i+12]) END) AS t FROM w WHERE kind = 'b'),
lengths AS (SELECT DISTINCT len(t) AS n FROM tests),
spots AS (
  SELECT id AS doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM w, lengths WHERE kind = 'd' AND len(w) >= n),
hits AS (
  SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, w[i:i+n-1] AS t FROM spots) JOIN tests USING (t)),
covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item AS VARCHAR) AS item FROM hits) GROUP BY 1),
posted AS (SELECT id AS doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS term FROM w WHERE kind = 'd'),
often AS (SELECT term, count(*) AS n FROM posted GROUP BY 1),
wins AS (SELECT row_number() OVER () AS win, t FROM (SELECT DISTINCT t FROM tests)),
places AS (SELECT win, len(t) AS size, unnest(range(1, len(t) + 1)) AS place, unnest(t) AS term FROM wins),
ranked AS (SELECT places.*, n FROM places LEFT JOIN often USING (term)),
rare AS (SELECT win, any_value(size) AS size, arg_min(term, n * 1000 + place) AS term FROM ranked GROUP BY win HAVING bool_and(n IS NOT NULL)),
others AS (SELECT DISTINCT win, ranked.term FROM ranked JOIN rare USING (win) WHERE ranked.term <> rare.term),
asked AS (SELECT win, count(*) AS k FROM others GROUP BY 1),
around AS (SELECT win, size, doc_id, p FROM rare JOIN posted USING (term)),
held AS (
  SELECT win, a.doc_id, a.p, count(DISTINCT o.term) AS k FROM around a JOIN others o USING (win)
  JOIN posted q ON q.doc_id = a.doc_id AND q.term = o.term AND abs(q.p - a.p) <= a.size - 1 + 3 GROUP BY 1, 2, 3),
loose AS (
  SELECT win, size, doc_id, p FROM around LEFT JOIN held USING (win, doc_id, p) LEFT JOIN asked USING (win) WHERE coalesce(held.k, 0) = coalesce(asked.k, 0)),
counts AS (SELECT win, term, count(*) AS c FROM places GROUP BY 1, 2),
need AS (SELECT win, count(*) AS k FROM counts GROUP BY 1),
starts AS (SELECT DISTINCT win, size, doc_id, unnest(range(p - size - 2, p + 1)) AS s FROM loose),
tally AS (
  SELECT w.win, w.doc_id, w.s, c.term FROM starts w JOIN counts c ON c.win = w.win
  JOIN posted q ON q.doc_id = w.doc_id AND q.term = c.term AND q.p >= w.s AND q.p < w.s + w.size + 3 GROUP BY 1, 2, 3, 4, c.c HAVING count(*) >= c.c),
fits AS (SELECT DISTINCT win, doc_id FROM (SELECT win, doc_id, s, count(*) AS k FROM tally GROUP BY 1, 2, 3) JOIN need USING (win, k)),
nearby AS (SELECT doc_id, count(DISTINCT coalesce(CAST(item AS VARCHAR), 'null')) AS n_near FROM fits JOIN wins USING (win) JOIN tests USING (t) GROUP BY 1)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(n_near, 0) AS n_near,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM w LEFT JOIN covered ON covered.doc_id = id LEFT JOIN named ON named.doc_id = id LEFT JOIN nearby ON nearby.doc_id = id WHERE kind = 'd'
"""
