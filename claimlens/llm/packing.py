"""[10] Best-fit packing by length patterns fitted with non-negative least squares.

Documents' token lengths are known after one pass; their histogram has at most one bin a token of the
sequence length, so planning is a small task on the driver whatever the number of documents.

1. Patterns of few lengths that fill a sequence exactly are enumerated from the lengths that occur.
2. Repeat counts are fitted to the histogram by non-negative least squares (coordinate descent over the
   sparse patterns), rounded down, and clipped to what is left of each length.
3. The residual histogram is packed best-fit, longest first, into the places with the least room.
4. The plan is a table of runs: the pieces of a length with ranks from .. to go, one each, to consecutive
   sequences at one offset.  Pieces get their rank among equal lengths by a distributed running count.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_texts, bounded, fields, per_batch, tidy, to_batch, tune, written
from .tokens import default_path, encoder

LENGTH = 4096
END = 1
#: Documents in a pattern, patterns for each first length and size, and sweeps of the fit.
PATTERN_DOCS, PATTERN_TRIES, SWEEPS = 8, 2, 12

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"


def pieces(documents: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """A row per piece of a document's ids (with the end id), and its place among the task's pieces of that length."""
    arrow = fields(PIECES, documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        tail = np.array([end], "<u4")
        for batch in bounded(batches):
            out: dict[str, list] = {f.name: [] for f in arrow}
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer).encode(as_texts(batch.column("text")))):
                ids = np.concatenate([ids, tail])
                for number, at in enumerate(range(0, len(ids), length)):
                    part = ids[at : at + length]
                    for k, v in (("doc_id", doc_id), ("piece", number), ("start", at), ("length", len(part)), ("ids_crc32", zlib.crc32(part.tobytes())), ("task", task), ("nth", int(seen[len(part)]))):
                        out[k].append(v)
                    seen[len(part)] += 1
            if out["doc_id"]:
                yield to_batch(out, arrow)

    return written(documents.select("doc_id", "text").mapInArrow(tidy(run), PIECES), "pieces")


def patterns(histogram: np.ndarray, length: int) -> list[tuple[int, ...]]:
    """Few-document patterns whose lengths, all of which occur, add up to length exactly."""
    there = np.flatnonzero(histogram)
    found: set[tuple[int, ...]] = set()
    if histogram[length]:
        found.add((length,))

    def nearest(n: int, skip: int) -> int:
        i = min(max(int(np.searchsorted(there, n)) + skip, 0), len(there) - 1)
        return int(there[i])

    for first in there.tolist():
        for docs in range(2, PATTERN_DOCS + 1):
            for attempt in range(PATTERN_TRIES):
                chosen, left = [first], length - first
                for k in range(docs - 1, 1, -1):
                    if left <= k:
                        break
                    pick = nearest(left // k, attempt * (k - docs) + attempt)
                    if pick >= left:
                        break
                    chosen.append(pick)
                    left -= pick
                if len(chosen) == docs - 1 and 0 < left <= length and histogram[left]:
                    found.add(tuple(sorted([*chosen, left], reverse=True)))
    return sorted(found)


def fitted(histogram: np.ndarray, found: list[tuple[int, ...]]) -> np.ndarray:
    """Non-negative repeat counts of patterns that come nearest to the histogram in the sum of squares."""
    columns = [np.unique(p, return_counts=True) for p in found]
    times = np.zeros(len(found))
    left = histogram.astype(np.float64)
    for _ in range(SWEEPS):
        change = 0.0
        for i, (lengths, uses) in enumerate(columns):
            step = max(-times[i], float(uses @ left[lengths]) / float(uses @ uses))
            if step:
                times[i] += step
                left[lengths] -= step * uses
                change = max(change, abs(step))
        if change < 0.25:
            break
    return times


def plan(histogram: np.ndarray, length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first sequence, offset) for all pieces of the histogram, and the sequences."""
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def take(size: int, n: int, sequence: int, offset: int) -> None:
        runs.append((size, int(used[size]), n, sequence, offset))
        used[size] += n
        left[size] -= n

    found = patterns(left, length)
    times = fitted(left, found)
    for i in np.argsort(-times, kind="stable").tolist():
        lengths, uses = np.unique(found[i], return_counts=True)
        n = min(int(times[i]), int((left[lengths] // uses).min()))
        if n > 0:
            offset = 0
            for size in found[i]:
                take(size, n, sequences, offset)
                offset += size
            sequences += n
    # Best fit of the residue: groups of open sequences by the room they have left.
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def free(room: int, sequence: int, n: int) -> None:
        if room:
            if not groups[room]:
                insort(rooms, room)
            groups[room].append((sequence, n))

    for size in np.flatnonzero(left)[::-1].tolist():
        while left[size]:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                sequence, n = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
                put = min(n, int(left[size]))
                take(size, put, sequence, length - room)
                free(room - size, sequence, put)
                if n > put:
                    free(room, sequence + put, n - put)
            else:
                fits = length // size
                n = max(1, int(left[size]) // fits)
                fits = min(fits, int(left[size]))
                for k in range(fits):
                    take(size, n, sequences, k * size)
                free(length - fits * size, sequences, n)
                sequences += n
    return runs, sequences


def pack(documents: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a document of the end id alone.  Repeated rows are packed once each.
    """
    spark = documents.sparkSession
    tune(spark)
    table = pieces(documents, tokenizer or default_path(), length, end)
    counts = table.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = np.zeros(length + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row a length
        histogram[row["length"]] = row["n"]
    runs, _ = plan(histogram, length)
    by_length: dict[int, list[tuple]] = defaultdict(list)
    for size, rank, n, sequence, offset in runs:
        by_length[size].append((rank, sequence, offset))
    # Its size is bounded by the lengths and patterns, not by the documents.
    sent = spark.sparkContext.broadcast({k: np.array(sorted(v), np.int64) for k, v in by_length.items()})

    def place(batch: pa.RecordBatch) -> dict[str, list]:
        sizes = batch.column("length").to_pylist()
        sequence, offset = [], []
        for size, rank in zip(sizes, batch.column("rank").to_pylist()):
            own = sent.value[size]
            first, base, off = own[np.searchsorted(own[:, 0], rank, side="right") - 1]
            sequence.append(int(base + rank - first))
            offset.append(int(off))
        return {**{c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}, "sequence_id": sequence, "offset": offset}

    ranked = table.join(before.select("task", "length", F.coalesce("before", F.lit(0)).alias("before")), ["task", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return per_batch(ranked, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint", place)


def sequences(documents: DataFrame, packed: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and doc_ids in order.  doc_id must be unique here."""
    path = tokenizer or default_path()
    spots = packed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("spots"))

    def cut(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "sequence_id", "offset", "ids")}
        for doc_id, spots, ids in zip(batch.column("doc_id").to_pylist(), batch.column("spots").to_pylist(), encoder(path).encode(as_texts(batch.column("text")))):
            ids = [*ids.tolist(), end]
            for s in spots:
                for k, v in (("doc_id", doc_id), ("sequence_id", s["sequence_id"]), ("offset", s["offset"]), ("ids", ids[s["start"] : s["start"] + s["length"]])):
                    out[k].append(v)
        return out

    cuts = per_batch(documents.select("doc_id", "text").join(spots, "doc_id"), "doc_id bigint, sequence_id bigint, offset bigint, ids array<int>", cut)
    ordered = cuts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("x"))
    return ordered.select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.doc_id").alias("doc_ids"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
