"""[3] Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Features are hashed byte trigrams of the text as it is, so that case, marks and layout count, and a few hashed
facts on repetition and length, weighted by how many of all documents have them.  TF-IDF vectors of at most LABELLED
labelled rows give the latent axes (a randomised SVD) and, projected, the table of neighbours; both are of bounded size
and broadcast.  Every text is compared with all of them, in blocks, by exact cosine products; its NEIGHBOURS nearest vote,
weighted by similarity, and of equally near ones those first in the table, which is sorted.  Null texts are empty texts; a text whose
cosines are all 0 or less gets the mean label, and without labelled rows every score is a half.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, per_batch, remainder, tune
from .language import unit
from .vectors import BUCKETS, counts, document_frequencies, labelled

LABELLED, AXES, NEIGHBOURS, SHARPNESS = 4000, 48, 15, 6
FACTS = 48
SIZE = BUCKETS + FACTS
FOLDS, HELD_OUT = 3, 1


def features(text: bytes) -> np.ndarray:
    """Square roots of trigram counts, as a share of the text, and one-of-eight codes of six facts."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n = max(1, len(words))
    shares = (
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(text.count(c) for c in b"#*$%&|<>") / n,
        sum(w.isupper() for w in words) / n,
        text.count(b"!") / n,
    )
    facts = np.zeros(FACTS, np.float32)
    for i, share in enumerate(shares):
        facts[8 * i + min(7, int(8 * share))] = 6.0
    if len(words) < 10:
        facts[40 + len(words) % 8] += 1.0
    grams = np.sqrt(counts(text))
    return np.concatenate([grams / max(1.0, float(np.linalg.norm(grams))) * 8, facts])


def axes(x: np.ndarray, k: int = AXES) -> np.ndarray:
    """The leading right singular vectors, by a randomised range finder with two power rounds."""
    k = min(k, *x.shape)
    sketch = x @ np.random.default_rng(3).standard_normal((x.shape[1], min(k + 16, x.shape[1]))).astype(np.float32)
    for _ in range(2):
        sketch = x @ (x.T @ np.linalg.qr(sketch)[0])
    return np.linalg.svd(np.linalg.qr(sketch)[0].T @ x, full_matrices=False)[2][:k].T.astype(np.float32)


def fit(rows: DataFrame, documents: DataFrame) -> dict:
    """The model from text and label of at most LABELLED rows, and the features' frequencies over all documents' texts."""
    tune(rows.sparkSession)
    frequency, n = document_frequencies(documents, features, SIZE)
    idf = (np.log((1 + n) / (1 + frequency)) + 1).astype(np.float32)
    idf[BUCKETS:] = 1
    told = per_batch(rows, "label int, vector binary", lambda b: {"label": b.column("label"), "vector": [features(t).astype(np.float16).tobytes() for t in as_bytes(b.column("text"))]}).collect()
    told.sort(key=lambda r: (bytes(r["vector"]), r["label"]))  # rows come in any order
    if not told:
        return {"idf": idf, "axes": np.zeros((SIZE, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "labels": np.zeros(0, np.float32)}
    x = np.stack([np.frombuffer(r["vector"], np.float16) for r in told]).astype(np.float32) * idf
    latent = axes(x)
    return {"idf": idf, "axes": latent, "vectors": unit(x @ latent).astype(np.float32), "labels": np.array([r["label"] for r in told], np.float32)}


def voted(near: np.ndarray, labels: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Scores by the labels of the k nearest of each row, weighted by similarity; of ties those with the lowest numbers."""
    k = min(k, near.shape[1])
    least = np.partition(near, near.shape[1] - k, axis=1)[:, -k, None]
    above, level = near > least, near == least
    chosen = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True)))
    weight = np.where(chosen, np.maximum(near, 0), 0) ** SHARPNESS
    total = weight.sum(1)
    return np.where(total > 0, np.clip((weight @ labels) / np.maximum(total, 1e-30), 0, 1), labels.mean())


def score(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row."""
    tune(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        m = sent.value
        if not len(m["labels"]):
            return {"doc_id": batch.column("doc_id"), "score": [0.5] * batch.num_rows}
        x = np.stack([features(t) for t in as_bytes(batch.column("text"))]) * m["idf"]
        near = unit(x @ m["axes"]) @ m["vectors"].T
        return {"doc_id": batch.column("doc_id"), "score": voted(near, m["labels"]).astype(float).tolist()}

    return per_batch(documents.select("doc_id", "text"), "doc_id bigint, score double", work)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(labelled(docs, labels, "quality", FOLDS, HELD_OUT, LABELLED), docs)
    return score(docs, model).select("doc_id", (F.coalesce(remainder("doc_id", FOLDS), F.lit(0)) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
