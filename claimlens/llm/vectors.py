"""Hashed byte-trigram vectors, and bounded samples of labelled rows, for the classifiers here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fields, remainder, tidy, to_batch, written

#: Buckets that trigrams are hashed to, and bytes hashed at once.
BUCKETS, SPAN = 4096, 1 << 20
#: Labelled rows for each task that a model is fitted by.
ROWS_A_TASK = 250


def counts(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's trigrams are in the text."""
    data = np.frombuffer(b" " + text + b" ", np.uint8)
    out = np.zeros(buckets, np.float32)
    for at in range(0, max(1, len(data) - 2), SPAN):
        part = data[at : at + SPAN + 2].astype(np.uint32)
        code = part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)
        out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - (buckets.bit_length() - 1)), minlength=buckets)
    return out


def document_frequencies(rows: DataFrame, vector: Callable[[bytes], np.ndarray], size: int) -> tuple[np.ndarray, int]:
    """In how many texts of rows each feature occurs, over all rows, and the number of rows."""
    arrow = fields("feature int, n bigint", rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                total += vector(text) > 0
                n += 1
        yield to_batch({"feature": [*range(size), -1], "n": [*total.tolist(), n]}, arrow)

    found = {r["feature"]: r["n"] for r in rows.select("text").mapInArrow(tidy(run), "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    return np.array([found.get(i, 0) for i in range(size)], np.float64), found.get(-1, 0)


def labelled(documents: DataFrame, labels: DataFrame, label: str, modulus: int, left_out: int, most: int) -> DataFrame:
    """text and label of at most `most` labelled rows outside the held-out fold, drawn by a hash of doc_id.

    The drawn ids are that bounded table which is broadcast.  A doc_id with several labels takes the largest, one
    with several texts the least (null before all), so repeated ids don't lift the bound.  The rows are written once:
    models pass over them several times, over documents only here.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id", modulus) != left_out))
    drawn = ids.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    single = found.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("row")).select("row.text", "row.label")
    return written(single.repartition(max(1, most // ROWS_A_TASK)), "labelled")
