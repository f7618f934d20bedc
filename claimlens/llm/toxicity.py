"""[2] Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. On at most LABELLED labelled rows outside the held-out fold, words and word beginnings that are much more frequent in
   toxic texts become lexicon entries; each (kind, strength) of entry is a voter, which votes where such entries are dense, so
   that long texts draw no votes by their length; patterns are voters too.
   Labels are used here and for the class share, and nowhere after.
2. The label model sees the rows' votes only: expectation-maximisation gives each voter's accuracy on either class,
   from a start where the rows with the most and strongest votes are toxic, as many as the class share says.  Voters whose votes agree beyond
   what the class explains share their weight, by their estimated correlations.
3. A logistic regression on votes, densities and strengths of entries learns the posterior labels, and scores every text.

Null texts are empty texts; a text without any entry gets the score of none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_texts, fields, filtered, per_batch, remainder, tidy, to_batch, tune
from .vectors import labelled

#: Labelled rows drawn; entries kept; least share of toxic rows with an entry; counted entries a task holds.
LABELLED, ENTRIES, LEAST_SHARE, HELD = 16_000, 6000, 0.004, 200_000
BEGINNINGS = (3, 4, 5, 6, 7)
#: Log odds from which an entry is of strength 0, 1, 2.
STRENGTHS = (0.8, 2.0, 3.5)
#: Shares of a text's words that its entries of a strength are, from which they vote.
DENSE = (0.05, 0.02, 0.005)
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
_WORD = re.compile(r"[^\W\d_]+")


def entries(text: str) -> set[tuple[int, str]]:
    """(0, word) and (k, first k letters) of all words of a text, in lower case."""
    words = set(_WORD.findall(text.lower()))
    out = {(0, w) for w in words}
    for k in BEGINNINGS:
        out |= {(k, w[:k]) for w in words if len(w) > k}
    return out


def _patterns(text: str) -> list[int]:
    """Votes of the patterns: shouting, insistent marks, address; 1 for toxic, 0 for none."""
    raw = text.encode()
    n = max(1, len(raw.split()))
    return [int(raw.count(b"!") > 0.3 * n), int(bool(re.search(r"\b(?:you|your|du|tu|vous)\b.{0,40}!", text, re.I)) and n < 40), int(sum(w.isupper() and len(w) > 3 for w in text.split()) > 0.5 * n)]


def _counted(rows: DataFrame, wanted: set | None) -> DataFrame:
    """In how many rows of either label each entry occurs; of toxic rows only where wanted is None."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)
    schema = "kind int, entry string, label int, n bigint"
    arrow = fields(schema, rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return to_batch({"kind": [k[0] for k, _ in held], "entry": [k[1] for k, _ in held], "label": [y for _, y in held], "n": list(held.values())}, arrow)

        for batch in batches:
            for text, label in zip(as_texts(batch.column("text")), batch.column("label").to_pylist()):
                found = entries(text)
                held.update((e, label) for e in (found if sent.value is None else found & sent.value))
            if len(held) > HELD:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return rows.mapInArrow(tidy(run), schema).groupBy("kind", "entry", "label").agg(F.sum("n").alias("n"))


def lexicon(rows: DataFrame, toxic: int, total: int) -> dict[tuple[int, str], float]:
    """Log odds of at most ENTRIES entries that stand out in toxic rows; their number is bounded before they are collected."""
    often = _counted(rows.where("label = 1"), None).where(F.col("n") >= max(4, math.ceil(LEAST_SHARE * toxic)))
    pos = {(r["kind"], r["entry"]): r["n"] for r in often.orderBy(F.desc("n"), "kind", "entry").limit(20 * ENTRIES).collect()}
    neg = {(r["kind"], r["entry"]): r["n"] for r in _counted(rows.where("label = 0"), set(pos)).collect()}
    odds = {e: math.log((n + 0.5) / (toxic + 1)) - math.log((neg.get(e, 0) + 0.5) / (total - toxic + 1)) for e, n in pos.items()}
    best = sorted((e for e in odds if odds[e] >= STRENGTHS[0]), key=lambda e: (-odds[e], e))[:ENTRIES]
    return {e: odds[e] for e in best}


def votes(text: str, known: dict[tuple[int, str], float]) -> tuple[list[int], list[float]]:
    """The voters' votes on a text, and the classifier's other inputs: how dense and how strong its entries are."""
    words = Counter(_WORD.findall(text.lower()))
    kinds = (0, *BEGINNINGS)
    hits = [[0] * len(STRENGTHS) for _ in kinds]
    most = 0.0
    for w, n in words.items():
        for row, k in zip(hits, kinds):
            odds = known.get((k, w[:k] if k else w)) if not k or len(w) > k else None
            if odds is not None:
                row[sum(odds >= s for s in STRENGTHS) - 1] += n
                most = max(most, odds)
    total = max(1, words.total())
    out = [int(n > 0 and n >= least * total) for row in hits for n, least in zip(row, DENSE)]
    told = [x for row in hits for x in (min(1.0, 20 * sum(row) / total), min(1.0, 50 * row[-1] / total), math.log1p(row[-1]) / 3)]
    return out + _patterns(text), [*told, most / 5]


def trust() -> np.ndarray:
    """How much each vote says at the start: the log odds from which its entries are; those of the weakest for a pattern."""
    return np.array([*STRENGTHS * (1 + len(BEGINNINGS)), *STRENGTHS[:1] * len(_patterns(""))])


def label_model(v: np.ndarray, prior: float, said: np.ndarray | float = 1.0, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Voters' chance of a vote on either class, their weights for correlation, posterior labels, and the class share.

    Expectation-maximisation over the votes v, from the rows where the votes say most as toxic; rows that tie at the edge all are.
    """
    n_votes = (v * said).sum(1)
    edge = np.sort(n_votes)[-max(1, round(prior * len(v)))]
    q = np.clip((n_votes >= edge if edge > n_votes.min() else n_votes > edge).astype(float), 0.02, 0.98)
    share = prior
    for _ in range(rounds):
        on = np.stack([((1 - q) @ v + 0.5) / ((1 - q).sum() + 1), (q @ v + 0.5) / (q.sum() + 1)])
        on = np.clip(on, 1e-3, 1 - 1e-3)
        weight = 1 / _together(v, q > 0.5).sum(1)
        logit = math.log(share / (1 - share)) + v @ (weight * np.log(on[1] / on[0])) + (1 - v) @ (weight * np.log((1 - on[1]) / (1 - on[0])))
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        share = float(np.clip(q.mean(), 0.5 * prior, 2 * prior))
    return on, weight, q, share


def _together(v: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """How much of one thing each two voters say: correlations of their votes within the classes, less what chance gives.

    Classes are taken as hard: soft ones would leave the class itself in the rest, and make all voters one.  Voters that
    hardly ever differ within the classes tell of no correlation.
    """
    rest = np.concatenate([part - part.mean(0) for part in (v[toxic], v[~toxic]) if len(part)])
    deviation = np.sqrt((rest**2).mean(0))
    told = deviation > 0.02
    scaled = rest / np.where(told, deviation, 1) * told
    out = np.maximum(0, np.abs(scaled.T @ scaled / len(v)) - 2 / math.sqrt(len(v)))
    np.fill_diagonal(out, 1)
    return out


def logistic(x: np.ndarray, q: np.ndarray, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Weights, the last one constant, that fit soft labels: Adagrad on whole batches."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    w, seen = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(rounds):
        gradient = x.T @ (1 / (1 + np.exp(-x @ w)) - q) / len(x) + ridge * w
        seen += gradient**2
        w -= rate * gradient / np.sqrt(seen)
    return w


def fit(rows: DataFrame) -> dict:
    """The model from text and label of at most LABELLED rows."""
    tune(rows.sparkSession)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, total = sizes.get(1, 0), sum(sizes.values())
    if not toxic or toxic == total:
        return {"known": {}, "weights": np.array([0.0] * sum(map(len, votes("", {}))) + [5.0 if toxic else -5.0])}
    known = lexicon(rows, toxic, total)
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def vote(batch: pa.RecordBatch) -> dict[str, list]:
        told = [votes(t, sent.value) for t in as_texts(batch.column("text"))]
        return {"votes": [v for v, _ in told], "inputs": [[*v, *f] for v, f in told]}

    told = per_batch(rows.select("text"), "votes array<int>, inputs array<float>", vote).collect()  # at most LABELLED rows
    _, _, q, _ = label_model(np.array([r["votes"] for r in told], np.float64), toxic / total, trust())
    return {"known": known, "weights": logistic(np.array([r["inputs"] for r in told], np.float32), q)}


def _scores(batch: pa.RecordBatch, model: dict) -> np.ndarray:
    known = model["known"]
    x = np.array([[*v, *f, 1.0] for v, f in (votes(t, known) for t in as_texts(batch.column("text")))])
    return 1 / (1 + np.exp(-x @ model["weights"]))


def score(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row."""
    tune(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return per_batch(documents.select("doc_id", "text"), "doc_id bigint, score double", lambda b: {"doc_id": b.column("doc_id"), "score": _scores(b, sent.value).tolist()})


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that score below THRESHOLD, with all their columns."""
    model = fit(labelled(documents, labels, "toxic", FOLDS, HELD_OUT, LABELLED))
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return filtered(documents, lambda b: (_scores(b, sent.value) < THRESHOLD).tolist())


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(documents, fit(labelled(documents, labels, "toxic", FOLDS, HELD_OUT, LABELLED)))
    return out.withColumns({"held_out": F.coalesce(remainder("doc_id", FOLDS), F.lit(0)) == HELD_OUT, "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, labels).select("doc_id", "held_out", "score", "predicted")
