"""[7] MinHash near-dedup by a multi-index Hamming join on b-bit signatures, links confirmed on full sets.

Texts are sets of five-word shingles.  Equal sets are one class from the start.  A class has SYMBOLS b-bit
MinHash symbols; a pair of sets with similarity s differs in each with probability 1 - s.

The symbols are split into CHUNKS chunks.  By the pigeonhole principle a pair that differs in fewer than
2 * CHUNKS symbols differs in at most one symbol of some chunk, so the keys made by masking each symbol of each
chunk find every pair under that distance (31 of 64, where a pair at similarity 0.75 differs in 16 on average, with
a deviation of 3.5: a chance of 2e-5 to be over it).  A pair over the distance still has such a chunk but for a chance
of 0.262 ** 16 = 5e-10 at similarity 0.75, and less above.  Every candidate is confirmed on full sets.

Rows of a key, head or label that many others have are split in the joins (``common.spread_join``).  No group's pairs are all listed.  Every member of a key's bucket is paired with the bucket's head, the class that
shares most keys with others, and confirmed links make components.  Buckets that still hold several components
are then compared in full, block by block and with one product of shingle matrices for a pair of blocks, so that
components are those of all links; a task gives at most one link for any two components that it puts together.
Blocks are bounded by classes and by shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_bytes, fields, fresh, parts, per_batch, remove, spread_join, tidy, to_batch, tune, written
from .links import components

SHINGLE = 5
SIMILAR = (75, 100)
SYMBOLS, CHUNK, BITS = 64, 4, 16
CHUNKS = SYMBOLS // CHUNK
#: Classes and shingles of a bucket in a block on average, and shingles compared at once, where blocks are compared in full.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 17, 2048

_RNG = np.random.default_rng(7)
_MULTIPLY = _RNG.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; the whole sequence if it is shorter; empty without words."""
    words = text.translate(LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(size, n)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h = h * _BASE + codes[i : n - k + 1 + i]
            h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def signature(items: np.ndarray) -> np.ndarray:
    """SYMBOLS b-bit MinHash symbols, as 64-bit words of four symbols each."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 4096):
        low = np.minimum(low, (items[at : at + 4096, None] * _MULTIPLY + _ADD).min(0))
    return ((low >> np.uint64(8)) & np.uint64(0xFFFF)).astype("<u2").view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    part, whole = SIMILAR
    if len(small) * whole < part * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return whole * both >= part * (len(a) + len(b) - both)


def _sign(batch: pa.RecordBatch) -> dict[str, list]:
    sizes, ids, signs = [], [], []
    for text in as_bytes(batch.column("text")):
        s = shingles(text)
        sizes.append(len(s))
        ids.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None)
        signs.append(signature(s).tolist() if len(s) else None)
    return {"row": batch.column("row"), "mark": batch.column("mark"), "doc_id": batch.column("doc_id"), "n_shingles": sizes, "cls": ids, "sig": signs}


def _differences(a: str, b: str) -> F.Column:
    """Symbols in which two signatures differ."""
    x = lambda i: F.col(a)[i].bitwiseXOR(F.col(b)[i])
    lanes = [(F.shiftrightunsigned(x(i), BITS * j).bitwiseAND(0xFFFF) != 0).cast("int") for i in range(SYMBOLS // CHUNK) for j in range(CHUNK)]
    out = lanes[0]
    for lane in lanes[1:]:
        out = out + lane
    return out


def _sizes(a: str, b: str) -> F.Column:
    """Whether sets of these sizes can be similar enough."""
    part, whole = SIMILAR
    return whole * F.least(a, b) >= part * F.greatest(a, b)


def _blocked(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and pair of blocks: exact links between different components within each."""
    rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "own", "cls", "comp")), as_bytes(batch.column("text"))))
    for (_, i, j), lot in groupby(rows, key=lambda r: r[:3]):
        lot = list(lot)
        comp = np.array([r[5] for r in lot])
        if (comp == comp[0]).all():
            continue
        sets = [shingles(r[6]) for r in lot]
        sizes = np.array([len(s) for s in sets])
        _, item, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        number = np.cumsum(uses > 1) - 1  # only shingles that two sets have
        keep = uses[item] > 1
        owner, item = owner[keep], number[item[keep]]
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(item, kind="stable")
        owner, item = owner[order], item[order]
        for at in range(0, int(item[-1]) + 1 if len(item) else 0, COLUMNS):
            low, high = np.searchsorted(item, (at, at + COLUMNS))
            has = np.zeros((len(sets), COLUMNS), np.float32)
            has[owner[low:high], item[low:high] - at] = 1
            both += has @ has.T
        part, whole = SIMILAR
        linked = (whole * both >= part * (sizes[:, None] + sizes[None, :] - both)) & (comp[:, None] != comp[None, :])
        a, b = np.nonzero(np.triu(linked, 1))
        joined: dict[int, int] = {}  # components that this lot has put together already

        def root(c: int) -> int:
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        out: tuple[list, list] = ([], [])
        for x, y in zip(a.tolist(), b.tolist()):
            u, v = root(int(comp[x])), root(int(comp[y]))
            if u != v:
                joined[max(u, v)] = min(u, v)
                out[0].append(lot[x][4])
                out[1].append(lot[y][4])
        if out[0]:
            yield to_batch({"a": out[0], "b": out[1]}, arrow)


def _confirm(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by b, whose set is kept from row to row."""
    last, held = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b, out = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
        one, two = batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary())
        for i, (x, y) in enumerate(zip(a, b)):
            if y != last:
                last, held = y, shingles(two[i].as_py())
            if similar(shingles(one[i].as_py()), held):
                out.append((x, y))
        if out:
            yield to_batch({"a": [p[0] for p in out], "b": [p[1] for p in out]}, arrow)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) of classes whose full shingle sets are similar enough."""
    arrow = fields("a bigint, b bigint", pairs.sparkSession)
    one, two = (texts.select(F.col("cls").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    both = spread_join(pairs.select("a", "b"), one, ["a"], ["b"]).join(two, "b").sortWithinPartitions("b")
    return written(both.mapInArrow(tidy(lambda b: _confirm(b, arrow)), "a bigint, b bigint"), "confirmed")


def near_groups(documents: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, n_shingles, component_id, kept, a mark of the text, and comp.

    Texts that are null or without words have no set and are linked with nothing; their component is their
    own doc_id, comp is null, and they are kept.  Shorter texts than five words are one shingle.  Equal rows, or rows with one
    doc_id, are rows like any others.  A component's id is its smallest doc_id that isn't null; rows without doc_id
    are not kept if it has one, and all kept if it has none.  comp names the component itself.
    """
    spark = documents.sparkSession
    tune(spark)
    rows = documents.select("doc_id", "text", F.lit(0).alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    signed = written(per_batch(rows, "row int, mark bigint, doc_id bigint, n_shingles bigint, cls bigint, sig array<bigint>", _sign), "signed")
    classes = written(signed.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"), F.min(F.struct("doc_id", "mark")).alias("home")), "classes")

    masks = [~(0xFFFF << BITS * j) & (1 << 64) - 1 for j in range(CHUNK)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.xxhash64(F.lit(c * CHUNK + j), F.col("sig")[c].bitwiseAND(F.lit(m))) for c in range(CHUNKS) for j, m in enumerate(masks)))
    buckets = classes.select("cls", F.explode(keys).alias("key"))
    crowds = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("a"), F.max("cls").alias("z")).where("a <> z").select("key", "n")
    crowds = written(crowds, "crowds")
    crowded = written(spread_join(buckets, crowds, ["key"], ["cls"], uses=crowds), "buckets")  # only of keys that several classes have
    # A text whose copies were changed here and there is in the largest buckets with all its keys, a copy with some.
    central = crowded.groupBy("cls").agg(F.sum("n").alias("weight"))
    heads = crowded.join(central, "cls").groupBy("key").agg(F.max(F.struct("weight", "cls")).alias("x")).select("key", F.col("x.cls").alias("a"))
    shared = written(spread_join(crowded.select("key", "cls"), heads, ["key"], ["cls"], uses=crowds), "headed")

    def close(pairs: DataFrame) -> DataFrame:
        one, two = (classes.select(F.col("cls").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
        return spread_join(pairs, one, ["a"], ["b"]).join(two, "b").where(_sizes("n_a", "n_b")).select("a", "b", _differences("sig_a", "sig_b").alias("far"))

    stars = written(close(written(shared.where("cls <> a").select("a", F.col("cls").alias("b")).distinct(), "pairs")), "stars")
    known = shared.select("cls").distinct()
    where = classes.join(known, "cls").select("cls", "home.doc_id", "home.mark")
    source = rows.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), "text")
    texts = source.join(where, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_m") == F.col("mark"))).select("cls", "text")
    texts = written(texts.groupBy("cls").agg(F.first("text").alias("text")), "texts")

    def merged(old: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
        """Components of all links so far, where old has those of the earlier ones."""
        return components(links if old is None else links.select("a", "b").union(old.select(F.col("node").alias("a"), F.col("comp").alias("b"))), name)

    def across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        """Pairs that aren't in one component yet."""
        at = [comps.select(F.col("node").alias(f"n{c}"), F.col("comp").alias(f"c{c}")) for c in "ab"]
        j = pairs.join(at[0], F.col("a") == F.col("na"), "left").join(at[1], F.col("b") == F.col("nb"), "left")
        return j.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    nearest = stars.groupBy("b").agg(F.min(F.struct("far", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    comps = merged(None, confirmed(nearest, texts), "comps")
    rest = written(across(stars.select("a", "b").join(nearest, ["a", "b"], "left_anti"), comps), "rest")
    comps = merged(comps, confirmed(rest, texts), "comps")

    # What is left: classes of several components in one bucket, neither of which is the bucket's head.
    at = comps.select(F.col("node").alias("cls"), "comp")
    placed = shared.join(at, "cls", "left").select("key", "a", "cls", F.coalesce("comp", "cls").alias("comp"))
    split = placed.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("key")
    sized = placed.where("cls <> a").join(classes.select("cls", "n"), "cls")
    mixed = written(sized.join(split, "key").select("key", "cls", "comp", "n"), "mixed")
    blocks = mixed.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    lots = mixed.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    lots = lots.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lots = lots.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "comp").join(texts, "cls")
    arrow = fields("a bigint, b bigint", spark)
    dealt = lots.repartition(parts(documents), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    comps = merged(comps, written(dealt.mapInArrow(tidy(lambda b: _blocked(b, arrow)), "a bigint, b bigint"), "confirmed"), "comps")
    for done in (crowded, shared, stars, mixed, texts):
        remove(spark, done)

    named = classes.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("comp", "cls").alias("comp"), "least")
    ids = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "comp").select("cls", "comp", "component_id")
    rows = signed.select("doc_id", "mark", "n_shingles", "cls")
    # Rows without a set share no class: they don't take part in the join.
    alone = rows.where("cls is null").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.col("cls").alias("comp"))
    kept = F.when(F.col("component_id").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    copies = signed.where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    return spread_join(rows.where("cls is not null"), named, ["cls"], ["doc_id", "mark"], uses=copies).select("doc_id", "mark", "n_shingles", "component_id", kept.alias("kept"), "comp").unionByName(alone)


def keep_firsts(documents: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: that of its smallest doc_id, if there is one; of rows
    with that doc_id, or of rows if none has one, one.  Rows whose text is null or without words all stay."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    mark, first, first_mark = fresh(documents, "mark", "first", "first_mark")
    firsts = near_groups(documents).where("comp is not null").groupBy("comp").agg(F.min(order).alias("x")).select(F.col("x.doc_id").alias(first), F.col("x.mark").alias(first_mark))
    marked = documents.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    wordy = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = marked.where(wordy).join(firsts, marked["doc_id"].eqNullSafe(F.col(first)) & (F.col(mark) == F.col(first_mark)), "left_semi").dropDuplicates(["doc_id", mark])
    return kept.unionByName(marked.where(~wordy)).drop(mark)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs).select("doc_id", "n_shingles", "component_id", "kept")


#: The same links by joining all shingles.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * k >= 75 * (len(p.s) + len(q.s) - k)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m AS component_id, s.doc_id = m AS kept FROM sets s JOIN least ON x = s.doc_id
"""
