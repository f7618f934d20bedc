"""[8] Masked pseudo-likelihood: a small bidirectional window network and counts of all words predict every token from both sides.

Tokens are lower-cased words.  P(token | both sides) = P(class | both sides) * P(token | class).  The network sums
position-wise embeddings of REACH tokens on each side, and a tanh layer predicts the masked token's class in two
steps (its group, then the class in the group), so that probabilities are normalised.  The classes follow the
corpus: as many as the root of its distinct words, SIZE at least.  Three quarters of them are the most frequent words,
each a class of its own; every other word is in one of the remaining classes by its hash.  There P(token | class) is
the token's count in the corpus out of the class's count and one; that one is the share of unknown words, which only
texts from outside of the corpus have: such a word has 257 ** -(bytes + 1) of it (as of 255 bytes if longer).

All documents train the network in one pass.  Their words' codes are written once, for training and scoring, dealt by a hash of the row to shards of
about SHARD tokens, whose number follows from the corpus alone, and the shards to as many rounds as the root of that
number.  A round reads its own shards (a folder each round); each shard, in the order of its hashes, trains from the
round's common start, and the shards' parameters and Adagrad sums, weighted by their tokens, are summed by blocks, in
the shards' order, to be the next round's start (local SGD).  So the model is the same however the input is split into files and tasks.

The counts of all words are a written table.  Held by every task: the network, and words with their counts from the
most frequent down, at most SPREAD times as many as classes.  The counts of the other, rarer words reach the texts by a join on
56 bits of the word's hash and its length, so no size of vocabulary has to fit a task, and no frequent word is in the join.

A document's score is the sum over all its tokens of log P(token | both sides).  Null texts and texts without
words have no tokens, a sum of 0 and a null mean.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_bytes, bounded, fields, parts, per_batch, remove, scratch, tidy, to_batch, tune, written

#: The least number of classes, in GROUPS groups of equally many.
SIZE, GROUPS = 1024, 32
#: Words that a task holds, by classes.
SPREAD = 24
REACH, HIDDEN = 2, 16
#: Tokens in a training step and in a scoring step, the learning rate, and words that a task counts before it sends them on.
STEP, BLOCK, RATE, HELD = 8192, 1 << 15, 0.08, 200_000
#: Tokens of a shard, on average; tokens whose order is mixed at once; and parameters in a row that is summed.
SHARD, MIXED, ROW = 1 << 22, 1 << 16, 1 << 13
#: The id beyond a text's ends, for context only; in a larger network it is the number of classes too.
EDGE = SIZE
#: A word's key in the join; Spark's xxhash64 is XXH64 with the seed 42.
KEY = "(xxhash64(word) & -256L) | least(octet_length(word), 255)"


@dataclass
class Vocabulary:
    """What tasks hold of the corpus's words, and the table (word, n) of all of them.

    A word's code is its place in words or, of a rarer word, len(words) and its hashed class's number; classes
    and terms (log P(token | class), for rarer words less the log of their own count) are by code.
    """

    table: DataFrame
    tokens: int
    groups: int
    words: list[bytes]
    least: int
    classes: np.ndarray
    terms: np.ndarray

    @property
    def kind(self) -> type:
        """Of codes."""
        return np.uint16 if len(self.classes) <= 1 << 16 else np.int32


def vocabulary(documents: DataFrame) -> Vocabulary:
    """Counts of all words over all texts, and the classes."""
    arrow = fields("word binary, n bigint", documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in bounded(batches):
            for text in as_bytes(batch.column("text")):
                held.update(text.translate(LOWER).split())
            if len(held) > HELD:
                yield to_batch({"word": list(held), "n": list(held.values())}, arrow)
                held.clear()
        if held:
            yield to_batch({"word": list(held), "n": list(held.values())}, arrow)

    table = written(documents.select("text").mapInArrow(tidy(run), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # One row a distinct count: no more than the root of twice the number of tokens.
    histogram = sorted(((r["n"], r["of"]) for r in table.groupBy("n").agg(F.count("*").alias("of")).collect()), reverse=True)
    groups = max(GROUPS, math.ceil(sum(x for _, x in histogram) ** 0.25))
    size, least, over = groups * groups, 1 << 62, 0
    for n, x in histogram:
        over += x
        if over > SPREAD * size:
            break
        least = n
    top = sorted(((-r["n"], bytes(r["word"])) for r in table.where(F.col("n") >= least).collect()))
    words, counts = [w for _, w in top], np.array([-n for n, _ in top], np.float64)
    single = size * 3 // 4
    rest = size - single
    total = np.zeros(rest)
    for r in table.groupBy(F.expr(f"shiftrightunsigned({KEY}, 8) % {rest}L").alias("c")).agg(F.sum("n").alias("n")).collect():
        total[r["c"]] = r["n"]
    places = np.array([(_digest(w) >> 8) % rest for w in words], np.int64)
    own = np.arange(len(words)) < single
    np.subtract.at(total, places[own], counts[own])
    terms = np.where(own, 0.0, np.log(counts) - np.log(total[places] + 1)) if words else np.zeros(0)
    classes = np.where(own, np.arange(len(words)), single + places)
    kind = np.uint16 if size < 1 << 16 else np.int64  # 16 bits are sorted by radix
    return Vocabulary(table, sum(n * x for n, x in histogram), groups, words, least, np.concatenate([classes, single + np.arange(rest)]).astype(kind), np.concatenate([terms, -np.log(total + 1)]))


def _digest(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


class _Codes(dict):
    """Words to codes; the keys of the rarer words asked for are put in rare."""

    def __init__(self, words: list[bytes], rest: int):
        super().__init__((w, i) for i, w in enumerate(words))
        self.first, self.rest, self.rare = len(words), rest, []

    def __missing__(self, word: bytes) -> int:
        key = _digest(word)
        self.rare.append(key & -256 | min(len(word), 255))
        return self.first + (key >> 8) % self.rest


def codes_of(text: bytes, known: _Codes) -> np.ndarray:
    words = text.translate(LOWER).split()
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def contexts(ids: list[np.ndarray], edge: int = EDGE) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of some texts, and of each the REACH ids before and after it."""
    gap = np.full(REACH, edge, ids[0].dtype if len(ids) else np.int64)
    row = np.concatenate([gap, *(x for i in ids for x in (i, gap))])
    at = np.flatnonzero(row != edge)
    shifts = [-k for k in range(REACH, 0, -1)] + list(range(1, REACH + 1))
    return row[at], np.stack([row[at + s] for s in shifts], 1)


def start(groups: int = GROUPS) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(8)
    shapes = {"embed": (groups * groups + 1, HIDDEN), "place": (2 * REACH, HIDDEN), "bias": (HIDDEN,), "group": (HIDDEN, groups), "group_bias": (groups,), "inner": (groups, HIDDEN, groups), "inner_bias": (groups, groups)}
    return {k: (rng.standard_normal(s) * 0.1).astype(np.float32) if "bias" not in k else np.zeros(s, np.float32) for k, s in shapes.items()}


def _exps(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of logits by class (first) and token: exponentials, their sums, and what was taken off the logits."""
    top = z.max(0)
    e = np.exp(z - top)
    return e, e.sum(0), top


def _picked(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logs of the softmax at one class a token."""
    _, total, top = _exps(z)
    return z[at, np.arange(len(at))] - top - np.log(total)


def _forward(p: dict[str, np.ndarray], around: np.ndarray) -> np.ndarray:
    total = np.broadcast_to(p["bias"], (len(around), HIDDEN)).copy()
    for j in range(around.shape[1]):
        total += np.take(p["embed"] * (1 + p["place"][j]), around[:, j], axis=0)
    return np.tanh(total)


def _by_group(p: dict[str, np.ndarray], target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens in order of their groups; in that order each one's group and class in it; and where each group starts."""
    groups = p["group"].shape[1]
    group, inner = np.divmod(target, target.dtype.type(groups))
    order = np.argsort(group, kind="stable")
    return order, group[order], inner[order], np.searchsorted(group[order], np.arange(groups + 1))


def log_probabilities(p: dict[str, np.ndarray], target: np.ndarray, around: np.ndarray) -> np.ndarray:
    order, group, inner, edges = _by_group(p, target)
    h = _forward(p, around[order])
    logs = _picked(p["group"].T @ h.T + p["group_bias"][:, None], group)
    for g, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            logs[a:b] += _picked(p["inner"][g].T @ h[a:b].T + p["inner_bias"][g][:, None], inner[a:b])
    out = np.empty_like(logs)
    out[order] = logs
    return out


def gradients(p: dict[str, np.ndarray], target: np.ndarray, around: np.ndarray) -> dict[str, np.ndarray]:
    """Of the sum of the tokens' negative log-likelihoods."""
    order, group, inner, edges = _by_group(p, target)
    around = around[order]
    h = _forward(p, around)
    d = {k: np.zeros_like(v) for k, v in p.items()}

    def errors(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        e, total, _ = _exps(weights.T @ rows.T + bias[:, None])
        e /= total
        e[at, np.arange(len(at))] -= 1
        return e

    dz = errors(p["group"], p["group_bias"], h, group)
    d["group"], d["group_bias"] = (dz @ h).T, dz.sum(1)
    dh = dz.T @ p["group"].T
    for g, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            dy = errors(p["inner"][g], p["inner_bias"][g], h[a:b], inner[a:b])
            d["inner"][g], d["inner_bias"][g] = (dy @ h[a:b]).T, dy.sum(1)
            dh[a:b] += dy.T @ p["inner"][g].T
    da = dh * (1 - h * h)
    d["bias"] = da.sum(0)
    for j in range(around.shape[1]):
        order = np.argsort(around[:, j], kind="stable")
        ids = around[order, j]
        firsts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        sums = np.add.reduceat(da[order], firsts, axis=0)
        d["embed"][ids[firsts]] += sums * (1 + p["place"][j])
        d["place"][j] = (sums * p["embed"][ids[firsts]]).sum(0)
    return d


def step(p: dict[str, np.ndarray], seen: dict[str, np.ndarray], target: np.ndarray, around: np.ndarray) -> None:
    """One Adagrad step on the mean negative log-likelihood of some tokens."""
    for k, d in gradients(p, target, around).items():
        d /= len(target)
        seen[k] += d * d
        p[k] -= RATE * d / np.sqrt(seen[k] + 1e-8)


def encoded(documents: DataFrame, words: Vocabulary) -> tuple[DataFrame, int]:
    """All rows (doc_id, codes, rare, mark, shard, round), written by round: codes are their words', rare the keys of rarer words; and the number of rounds."""
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast((words.words, len(words.classes) - len(words.words)))
    kind = words.kind
    shards = max(1, math.ceil(words.tokens / SHARD))
    rounds = math.ceil(shards**0.5)

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        known, codes, rare = _Codes(*held.value), [], []
        for text in as_bytes(batch.column("text")):
            codes.append(codes_of(text, known).astype(kind).tobytes())
            rare.append(np.array(known.rare, np.uint64).view(np.int64))
            known.rare.clear()
        return {"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "codes": codes, "rare": rare}

    marked = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("mark"))
    schema = "doc_id bigint, mark bigint, codes binary, rare array<bigint>"
    coded = per_batch(marked, schema, work).withColumn("shard", F.pmod("mark", F.lit(shards)))
    path = scratch(spark, "shards")
    coded.withColumn("round", F.col("shard") % rounds).repartition(min(shards, parts(documents)), "shard").write.option("compression", "zstd").partitionBy("round").parquet(path)
    return spark.read.schema(f"{schema}, shard bigint, round bigint").parquet(path), rounds


SUMS = "name string, block int, shard bigint, value binary, tokens bigint"


def _trained(batches: Iterator[pa.RecordBatch], begin: tuple[dict, dict], classes: np.ndarray, kind: type, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, in order: each shard's parameters and sums after its pass, by blocks, times its tokens."""
    edge = len(begin[0]["embed"]) - 1

    def learn(p: dict, seen: dict, texts: list[np.ndarray]) -> int:
        target, around = contexts(texts, edge)
        mix = np.random.default_rng(len(target)).permutation(len(target))
        for a in range(0, len(mix), STEP):
            step(p, seen, target[mix[a : a + STEP]], around[mix[a : a + STEP]])
        return len(target)

    rows = ((shard, codes) for batch in bounded(batches) for shard, codes in zip(batch.column("shard").to_pylist(), batch.column("codes").to_pylist()))
    for shard, lot in groupby(rows, key=lambda r: r[0]):
        p, seen = ({k: v.copy() for k, v in x.items()} for x in begin)
        texts, size, total = [], 0, 0
        for _, codes in lot:
            texts.append(classes[np.frombuffer(codes, kind)])
            size += len(texts[-1])
            if size >= MIXED:
                total += learn(p, seen, texts)
                texts, size = [], 0
        if texts:
            total += learn(p, seen, texts)
        out: dict[str, list] = {f.name: [] for f in arrow}
        for sort, params in (("p", p), ("seen", seen)):
            for name, v in params.items():
                flat = v.ravel().astype(float) * total
                for block, at in enumerate(range(0, len(flat), ROW)):
                    for column, value in zip(out, (f"{sort} {name}", block, shard, flat[at : at + ROW].tobytes(), total)):
                        out[column].append(value)
        yield to_batch(out, arrow)


def _averaged(group: pa.Table) -> pa.Table:
    """One block's mean over its shards, summed in their order."""
    rows = sorted(zip(group.column("shard").to_pylist(), group.column("value").to_pylist(), group.column("tokens").to_pylist()))
    total = np.zeros(len(rows[0][1]) // 8)
    for _, value, _ in rows:
        total += np.frombuffer(value)
    mean = total / sum(tokens for _, _, tokens in rows)
    return pa.table({"name": group.column("name")[:1], "block": group.column("block")[:1], "value": pa.array([mean.tobytes()], pa.binary())})


def train(rows: DataFrame, rounds: int, words: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters after one pass over encoded's rows."""
    spark = rows.sparkSession
    arrow, kind = fields(SUMS, spark), words.kind
    classes = spark.sparkContext.broadcast(words.classes)
    p = start(words.groups)
    seen = {k: np.zeros_like(v) for k, v in p.items()}
    tasks = parts(rows)

    def passed(sent):
        return lambda batches: _trained(batches, sent.value, classes.value, kind, arrow)

    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((p, seen))
        own = rows.where((F.col("round") == turn) & (F.length("codes") > 0)).select("shard", "mark", "codes")
        sums = own.repartition(tasks, "shard").sortWithinPartitions("shard", "mark", "codes").mapInArrow(tidy(passed(sent)), SUMS)
        p, seen = ({k: v.copy() for k, v in x.items()} for x in (p, seen))
        for r in sums.groupBy("name", "block").applyInArrow(_averaged, "name string, block int, value binary").collect():  # the parameters
            sort, name = r["name"].split()
            values, at = np.frombuffer(r["value"]), r["block"] * ROW
            (p if sort == "p" else seen)[name].ravel()[at : at + len(values)] = values
        sent.unpersist()
    return p


def scored(rows: DataFrame, words: Vocabulary, parameters: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (the sum) and mean_log_likelihood of every one of encoded's rows."""
    held, kind, edge, least = rows.sparkSession.sparkContext.broadcast((words.classes, words.terms, parameters)), words.kind, words.groups**2, words.least

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        classes, terms, p = held.value
        each = [np.frombuffer(c, kind) for c in batch.column("codes").to_pylist()]
        target, around = contexts([classes[c] for c in each], edge)
        logs = np.concatenate([np.zeros(0), *(log_probabilities(p, target[a : a + BLOCK], around[a : a + BLOCK]) for a in range(0, len(target), BLOCK))])
        logs += terms[np.concatenate([np.zeros(0, kind), *each])]
        ends = np.concatenate([[0], np.cumsum([len(c) for c in each])])
        running = np.concatenate([[0.0], np.cumsum(logs, dtype=np.float64)])
        return {"doc_id": batch.column("doc_id"), "n_tokens": [len(c) for c in each], "log_likelihood": (running[ends[1:]] - running[ends[:-1]]).tolist(), "rare": batch.column("rare")}

    # Written: the rows' numbers have to stay.
    sums = written(per_batch(rows.select("doc_id", "codes", "rare"), "doc_id bigint, n_tokens bigint, log_likelihood double, rare array<bigint>", work).withColumn("row", F.monotonically_increasing_id()), "scores")
    counts = words.table.where(F.col("n") < least).groupBy(F.expr(KEY).alias("key")).agg(F.sum("n").alias("n"))
    spelt = -(F.col("key").bitwiseAND(255) + 1) * math.log(257)
    rest = sums.select("row", F.explode("rare").alias("key")).join(counts, "key", "left").select("row", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("n_tokens"), F.coalesce(F.log("n"), spelt).alias("log_likelihood"))
    whole = sums.drop("rare").unionByName(rest).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("log_likelihood").alias("log_likelihood"))
    return whole.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_likelihood"))


def score(documents: DataFrame, words: Vocabulary, parameters: dict[str, np.ndarray]) -> DataFrame:
    """scored's rows of any documents by a trained model."""
    return scored(encoded(documents, words)[0], words, parameters)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tune(spark)
    words = vocabulary(docs)
    rows, rounds = encoded(docs, words)
    out = scored(rows, words, train(rows, rounds, words))
    remove(spark, rows)
    return out
