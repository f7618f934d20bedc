"""[1] Language by the nearest of several clustered centroids a language, on normalised TF-IDF n-gram vectors.

Vectors are hashed byte trigrams of the lower-cased letters of the whole text, weighted by frequencies over all
training rows.  Centroids are fitted by spherical k-means on about SAMPLE distinct training texts of each language
(fewer if that makes over TOTAL of all, but eight), drawn by their hashes; a text that is repeated counts once there.  A text goes to the language of the centroid with the highest cosine; one that is further
from it than nearly all training rows of that centroid is rejected, which the column `rejected` tells.
Texts that are null or without letters are `und`, with score 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_texts, per_batch, remainder, tune
from .vectors import BUCKETS, counts, document_frequencies

SAMPLE, TOTAL, CENTROIDS, ROUNDS = 500, 4000, 3, 8
FOLDS, HELD_OUT = 4, 2
#: A centroid's own training rows are this many deviations from their mean cosine at most, else rejected.
DEVIATIONS = 4.0
_SPACE = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def letters(text: bytes) -> np.ndarray:
    folded = b" ".join(text.decode("utf-8", "replace").lower().encode().translate(_SPACE).split())
    out = counts(folded)
    return np.sqrt(out)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def clustered(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows: the first is the row nearest the mean, each next the row furthest from all before."""
    k = min(k, len(x))
    picks = [int(np.argmax(x @ x.mean(0)))]
    while len(picks) < k:
        picks.append(int(np.argmin((x @ x[picks].T).max(1))))
    centres = x[picks]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, 1)
        centres = np.stack([unit(x[own == i].mean(0)) if (own == i).any() else centres[i] for i in range(k)])
    return centres


def fit(training: DataFrame) -> dict:
    """The model from text and lang of training rows."""
    tune(training.sparkSession)
    frequency, n = document_frequencies(training, letters, BUCKETS)
    idf = np.log((1 + n) / (1 + frequency)).astype(np.float32) + 1
    mark = F.xxhash64("text")
    sizes = {r["lang"]: max(1, r["n"]) for r in training.groupBy("lang").agg(F.approx_count_distinct(mark).alias("n")).collect()}
    per = min(SAMPLE, max(8, TOTAL // max(1, len(sizes))))
    rows: dict[str, list[np.ndarray]] = {}
    if sizes:
        share = F.create_map(*(F.lit(x) for lang, m in sizes.items() for x in (lang, 1.0 if m <= 1.1 * per else per / m)))
        draw = F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 20)) < share[F.col("lang")] * F.lit(1 << 20)
        # One of equal texts, which are put together before the shuffle; so about `per` rows of each language are left.
        drawn = training.where(draw).groupBy("lang", mark.alias("mark")).agg(F.first("text").alias("text"))
        vectors = per_batch(drawn, "lang string, mark bigint, vector binary", lambda b: {"lang": b.column("lang"), "mark": b.column("mark"), "vector": [letters((t or "").encode()).astype(np.float16).tobytes() for t in b.column("text").to_pylist()]})
        for r in sorted(vectors.collect(), key=lambda r: (r["lang"], r["mark"])):
            rows.setdefault(r["lang"], []).append(np.frombuffer(r["vector"], np.float16))
    names, centres, least = [], [], []
    for lang in sorted(rows):
        x = unit(np.stack(rows[lang]).astype(np.float32) * idf)
        own = clustered(x, CENTROIDS)
        near = x @ own.T
        for i, c in enumerate(own):
            mine = near[near.argmax(1) == i, i] if (near.argmax(1) == i).any() else near[:, i]
            names.append(lang)
            centres.append(c)
            least.append(float(mine.mean() - DEVIATIONS * mine.std()))
    return {"idf": idf, "names": names, "centres": np.array(centres, np.float32).reshape(len(names), BUCKETS), "least": least}


def predict(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score (the cosine) and rejected."""
    tune(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        m, texts = sent.value, as_texts(batch.column("text"))
        some = [bool(m["names"]) and any(map(str.isalpha, t)) for t in texts]
        langs, scores, rejected = [], [], []
        x = np.stack([letters(t.encode()) if s else np.zeros(BUCKETS, np.float32) for t, s in zip(texts, some)])
        near = unit(x * m["idf"]) @ m["centres"].T
        for row, s in zip(near, some):
            best = int(np.argmax(row)) if s else -1
            langs.append(m["names"][best] if s else "und")
            scores.append(float(min(1.0, max(0.0, row[best]))) if s else 0.0)
            rejected.append(not s or float(row[best]) < m["least"][best])
        return {"doc_id": batch.column("doc_id"), "lang_pred": langs, "score": scores, "rejected": rejected}

    return per_batch(documents.select("doc_id", "text"), "doc_id bigint, lang_pred string, score double, rejected boolean", work)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where((remainder("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull()).select("text", "lang"))
    return predict(docs, model).select("doc_id", (F.coalesce(remainder("doc_id", FOLDS), F.lit(0)) == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")
