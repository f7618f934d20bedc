"""[12] N-gram Jaccard join in the metric space of shingle sets, whose distance is 1 - similarity.

Texts are sets of three-word shingles; equal sets are one class from the start.  Sets are linked at a distance of RADIUS
or less.  Each level puts classes in regions about pivots, so that any linked pair meets in one region.

* First regions.  Documents of a corpus are nearly all at distance 1 from each other, where no pivot document tells them
  apart, so the first pivots are parts of sets.  A hash splits all shingles into as many classes as sets of
  that size need for a linked pair to be at distance 0 in one of them: linked sets differ in at most a ninth of the
  smaller one's shingles, so with more classes than that some class holds the same part of both.  Each set lies on the
  pivots that its own parts are.  Classes follow size bands; a set that may link into the band below lies on that band's pivots
  too.  Parts that are empty are no pivots, unless a set has too few others.
* Stars.  In each region the set that shares most pivots with others is the centre.  Exact distances of all members
  to it give the first links, and each member's difference from the centre: the distance of any two members of one centre
  follows from their differences alone, which are short, so texts go no further.
* Regions of members that links have not yet put into one component are split about a few of their members, again and again:
  each member goes to its nearest pivot, and to every other that is at most 2 * RADIUS farther, as the triangle inequality
  says that a linked partner may have that as its nearest.  Small regions are compared in full by a product of
  matrices.  A region that doesn't get smaller (all members about as far from each other) is compared
  in pairs of blocks.

Every link between different components is found, as each step only leaves out pairs that cannot be linked or are in one
component already.

Odd input: null, empty and blank texts have no set, are linked with nothing and are their own component.  Texts of fewer than
three words are one shingle.  Repeated rows and ids are rows like any others; a component's id is its smallest doc_id that
isn't null, or null if there is none.  Long texts are taken whole.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, bounded, fields, per_batch, remove, spread_join, table, tidy, to_batch, tune, written
from .links import components
from .neardup import shingles

SHINGLE = 3
SIMILAR = (90, 100)
RADIUS = 1 - SIMILAR[0] / SIMILAR[1]
#: A size band's largest set has about this many times the shingles of its smallest.
BAND = 1.5
#: Members that one task compares with a centre or with pivots; members, and shingles of their differences, compared in full.
LEGS, BLOCK, BLOCK_ITEMS, COLUMNS = 512, 1024, 1 << 18, 2048
#: Pivots that a region is split about; a part with more than this share of the region's members isn't smaller; levels.
PIVOTS, SMALLER, DEPTH = 8, 0.8, 6

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def differing(size: int) -> int:
    """In how many shingles a set of this size and a linked one that isn't smaller may differ."""
    part, whole = SIMILAR
    return size * (whole - part) // part


def _edges() -> list[int]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return out


#: Smallest size of each band.
EDGES = _edges()


def classes_of(band: int) -> int:
    """Classes of shingles for a band: over a linked pair's differing shingles, with some to spare for empty parts."""
    most = differing(EDGES[band + 1] - 1)
    return most + 1 if most == 0 else most + 2 + most // 32


def pivots(items: np.ndarray) -> np.ndarray:
    """Keys of the parts that a set lies on; two linked sets have one in common."""
    n = len(items)
    band = bisect_right(EDGES, n) - 1
    bands = [band]
    part, whole = SIMILAR
    if band and part * n <= whole * (EDGES[band] - 1):
        bands.append(band - 1)
    out = []
    with np.errstate(over="ignore"):
        spread = items * _PRIME
        spread ^= spread >> np.uint64(31)
        inner = spread * np.uint64(0xD6E8FEB86659FD93)
        inner ^= inner >> np.uint64(32)
        for b in bands:
            m = classes_of(b)
            at = (spread % np.uint64(m)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            at = at[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            held, sums = at[first], np.add.reduceat(inner[order], first)
            if len(held) <= differing(min(n, EDGES[b + 1] - 1)):
                all_sums = np.zeros(m, np.uint64)
                all_sums[held] = sums
                held, sums = np.arange(m), all_sums
            key = (sums + (held + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) * _PRIME + np.uint64(b)
            out.append(key ^ key >> np.uint64(29))
    return np.unique(np.concatenate(out))


def _place(batch: pa.RecordBatch) -> dict[str, list]:
    """Each row's class; its keys with the class's first row of a batch only."""
    sizes, ids, keys, seen = [], [], [], set()
    for text in as_bytes(batch.column("text")):
        s = shingles(text, SHINGLE)
        sizes.append(len(s))
        ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
        keys.append(pivots(s).view(np.int64) if len(s) and ids[-1] not in seen else None)
        seen.add(ids[-1])
    return {"row": range(batch.num_rows), "spot": batch.column("spot"), "doc_id": batch.column("doc_id"), "n_shingles": sizes, "cls": ids, "keys": keys}


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What is in one of two sorted sets only, sorted."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    twice = both[1:] == both[:-1]
    return both[~(np.concatenate([twice, [False]]) | np.concatenate([[False], twice]))]


def linked(sizes: np.ndarray | int, apart: np.ndarray | int) -> np.ndarray | bool:
    """Whether two sets with so many shingles together, apart of them in one only, are similar enough."""
    part, whole = SIMILAR
    return whole * (sizes - apart) >= part * (sizes + apart)


def _distance(sizes: int, apart: int) -> float:
    return 2 * apart / (sizes + apart) if sizes else 0.0


def _legs(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come by centre and share, the centre's own first: each member's difference from the centre."""
    centre = np.zeros(0, np.uint64)
    for batch in bounded(batches):
        out: dict[str, list] = {f.name: [] for f in arrow}
        for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), as_bytes(batch.column("text"))):
            items = shingles(text, SHINGLE)
            if b is None:
                centre = items
                continue
            apart = difference(centre, items)
            for name, value in zip(out, (a, b, len(items), bool(linked(len(items) + len(centre), len(apart))), apart.view(np.int64))):
                out[name].append(value)
        yield to_batch(out, arrow)


def _members(batch: pa.RecordBatch) -> Iterator[tuple]:
    column = batch.column("apart")
    offsets, flat = np.asarray(column.offsets), np.asarray(column.values)
    names = [c for c in batch.schema.names if c != "apart"]
    for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
        yield *row, flat[offsets[i] : offsets[i + 1]]


def _split(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come by region and share, its pivots first: each member's regions, and its links to pivots of other components."""
    held: list[tuple] = []
    last, started = None, False
    for batch in bounded(batches):
        out: dict[str, list] = {f.name: [] for f in arrow}
        for region, share, role, own, b, comp, n, apart in _members(batch):
            if (region, share) != last:
                last, held = (region, share), []
            if role == 0:
                held.append((b, comp, n, apart))
                continue
            far = []
            for q, c, m, other in held:
                between = len(difference(apart, other))
                far.append(_distance(n + m, between))
                if c != comp and linked(n + m, between):
                    for name, value in zip(out, (None, False, q, b, None, None)):
                        out[name].append(value)
            near = int(np.argmin(far))
            for i, d in enumerate(far):
                if d <= far[near] + 2 * RADIUS + 1e-9:
                    for name, value in zip(out, (f"{region}/{held[i][0]}", own and i == near, None, b, n, apart)):
                        out[name].append(value)
        yield to_batch(out, arrow)


def _compared(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come by region and pair of blocks: links between different components within each."""
    rows = (r for batch in bounded(batches) for r in _members(batch))
    for _, lot in groupby(rows, key=lambda r: r[:3]):
        lot = list(lot)
        own, comp = np.array([r[3] for r in lot]), np.array([r[5] for r in lot])
        if (comp == comp[0]).all() or not own.any():
            continue
        sizes, far = np.array([r[6] for r in lot]), np.array([len(r[7]) for r in lot])
        _, item, uses = np.unique(np.concatenate([r[7] for r in lot]), return_inverse=True, return_counts=True)
        owner, number = np.repeat(np.arange(len(lot)), far), np.cumsum(uses > 1) - 1
        keep = uses[item] > 1
        owner, item = owner[keep], number[item[keep]]
        order = np.argsort(item, kind="stable")
        owner, item = owner[order], item[order]
        both = np.zeros((len(lot), len(lot)), np.float32)
        for at in range(0, int(item[-1]) + 1 if len(item) else 0, COLUMNS):
            low, high = np.searchsorted(item, (at, at + COLUMNS))
            has = np.zeros((len(lot), COLUMNS), np.float32)
            has[owner[low:high], item[low:high] - at] = 1
            both += has @ has.T
        apart = far[:, None] + far[None, :] - 2 * both.astype(np.int64)
        good = linked(sizes[:, None] + sizes[None, :], apart) & (comp[:, None] != comp[None, :]) & (own[:, None] | own[None, :])
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        out: tuple[list, list] = ([], [])
        for x, y in zip(*(v.tolist() for v in np.nonzero(np.triu(good, 1)))):
            u, v = root(int(comp[x])), root(int(comp[y]))
            if u != v:
                joined[max(u, v)] = min(u, v)
                out[0].append(lot[x][4])
                out[1].append(lot[y][4])
        if out[0]:
            yield to_batch({"a": out[0], "b": out[1]}, arrow)


def _with_centres(stars: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, share, b, text): members of each centre a in shares of about LEGS, with the centre itself in each, b null."""
    uses = stars.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    lots = uses.select("a", F.ceil(F.col("n") / LEGS).alias("lots"))
    members = spread_join(stars, lots, ["a"], ["b"], uses=uses).select("a", F.pmod(F.xxhash64("b"), F.col("lots")).alias("share"), "b")
    members = members.join(texts.withColumnRenamed("node", "b"), "b").select("a", "share", "b", "text")
    centres = lots.join(texts.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1)).alias("share"), F.lit(None).cast("bigint").alias("b"), "text")
    return members.unionByName(centres)


def _pairs_of_blocks(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members by pair of blocks; sizes has each region's number of blocks."""
    lots = spread_join(regions, sizes.select("region", "blocks"), ["region"], ["b"], uses=sizes.select("region", F.col("members").alias("n")))
    lots = lots.withColumn("at", F.pmod(F.xxhash64("b"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return lots.select("region", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "own", "b", "comp", "n", "apart")


MEMBER = "region string, own boolean, q bigint, b bigint, n bigint, apart array<bigint>"


def _next_level(large: DataFrame, sizes: DataFrame, level: int) -> DataFrame:
    """MEMBER rows: members of the parts of large regions, and links (q, b) to pivots."""
    ranks = [F.min_by("b", F.xxhash64(F.lit(level), F.lit(i), "b")).alias(f"p{i}") for i in range(PIVOTS)]
    drawn = large.groupBy("region").agg(*ranks).select("region", F.explode(F.array_distinct(F.array(*(f"p{i}" for i in range(PIVOTS))))).alias("b"))
    shares = sizes.select("region", F.ceil(F.col("members") / LEGS).alias("shares"))
    held = large.join(drawn, ["region", "b"]).join(shares, "region").withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)))
    members = spread_join(large, shares, ["region"], ["b"], uses=sizes.select("region", F.col("members").alias("n"))).withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")))
    columns = lambda rows, role: rows.select("region", "share", F.lit(role).alias("role"), "own", "b", "comp", "n", "apart")
    arrow = fields(MEMBER, large.sparkSession)
    both = columns(held, 0).unionByName(columns(members, 1))
    return _dealt_by(both, ["region", "share"], ["role", "b"]).mapInArrow(tidy(lambda b: _split(b, arrow)), MEMBER)


def _dealt_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows dealt by keys, and in order within these."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components of links (a, b) and all earlier ones."""
    return components(links.select("a", "b").union(comps.select("node", "comp")), "regions")


def linked_groups(documents: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, n_shingles, component_id."""
    spark = documents.sparkSession
    tune(spark)
    spot = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64(F.coalesce("text", F.lit(""))).cast("string"))
    rows = documents.select("doc_id", "text", spot.alias("spot"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    placed = written(per_batch(rows, f"row int, spot string, doc_id {kind}, n_shingles bigint, cls binary, keys array<bigint>", _place), "placed")
    grouped = placed.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), F.first("keys", ignorenulls=True).alias("keys"), F.min("spot").alias("spot"), F.count(F.lit(1)).alias("copies"))
    # Classes are numbered as they are written; later steps read these numbers.
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")

    lying = classes.select("node", F.explode("keys").alias("key"))
    crowds = written(lying.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "crowds")
    crowded = written(spread_join(lying, crowds, ["key"], ["node"], uses=crowds), "crowded")
    central = crowded.groupBy("node").agg(F.sum("n").alias("weight"))
    heads = crowded.join(central, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("x")).select("key", F.col("x.node").alias("a"))
    stars = spread_join(crowded, heads, ["key"], ["node"], uses=crowds).where("node <> a").select("a", F.col("node").alias("b")).distinct()
    stars = written(stars, "stars")

    wanted = classes.join(crowded.select("node").distinct(), "node").select("node", "spot")
    many = placed.groupBy("spot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = spread_join(rows.select("spot", "text", "doc_id"), wanted, ["spot"], ["doc_id"], uses=many)
    texts = written(found.groupBy("node").agg(F.first("text").alias("text")), "texts")
    for done in (crowds, crowded):
        remove(spark, done)

    schema = "a bigint, b bigint, n bigint, near boolean, apart array<bigint>"
    arrow = fields(schema, spark)
    legs = written(_dealt_by(_with_centres(stars, texts), ["a", "share"], ["b"]).mapInArrow(tidy(lambda b: _legs(b, arrow)), schema), "legs")
    for done in (stars, texts):
        remove(spark, done)
    comps = components(legs.where("near").select("a", "b"), "regions")

    pair = fields("a bigint, b bigint", spark)
    members = legs.select(F.col("a").cast("string").alias("region"), F.lit(True).alias("own"), "b", "n", "apart")
    parents, level = spark.createDataFrame([], "parent string, of bigint"), 0
    while True:
        at = comps.select(F.col("node").alias("b"), "comp")
        placed_members = members.join(at, "b", "left").withColumn("comp", F.coalesce("comp", "b"))
        stats = placed_members.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.sum(F.size("apart")).alias("items"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
        blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("items") / BLOCK_ITEMS), F.lit(1))
        stats = written(stats.where("c1 <> c2").select("region", "members", blocks.alias("blocks")), "sizes")
        if not stats.limit(1).count():
            break
        current = written(spread_join(placed_members, stats.select("region"), ["region"], ["b"], uses=stats.select("region", F.col("members").alias("n"))), "region")
        # A part is named by its region's name and its pivot.
        above = stats.withColumn("parent", F.substring_index("region", "/", level)).join(parents, "parent", "left")
        stuck = (F.lit(level) >= DEPTH) | F.coalesce(F.col("members") > SMALLER * F.col("of"), F.lit(False))
        above = above.withColumn("compared", (F.col("blocks") == 1) | stuck)
        whole, large = (above.where(c).select("region", "members", "blocks") for c in ("compared", "not compared"))
        full = _dealt_by(_pairs_of_blocks(current, whole), ["region", "i", "j"], []).mapInArrow(tidy(lambda b: _compared(b, pair)), "a bigint, b bigint")
        links = written(full, "links")
        inner = spread_join(current, large.select("region"), ["region"], ["b"], uses=large.select("region", F.col("members").alias("n")))
        following = written(_next_level(inner, large, level), "parts")
        comps = _merged(comps, links.unionByName(following.where("q is not null").select(F.col("q").alias("a"), "b")))
        parents = large.select(F.col("region").alias("parent"), F.col("members").alias("of"))
        remove(spark, current)
        members = following.where("q is null").select("region", "own", "b", "n", "apart")
        level += 1

    named = classes.select("cls", "least", "copies", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ids = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = spread_join(named, ids, ["comp"], ["node"]).select("cls", "component_id")
    own = placed.select("doc_id", "n_shingles", "cls", "spot", "row")
    alone = own.where("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    uses = classes.select("cls", F.col("copies").alias("n"))
    return spread_join(own.where("cls is not null"), named, ["cls"], ["spot", "row"], uses=uses).select("doc_id", "n_shingles", "component_id").unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_groups(table(spark, sf_dir, "documents"))


#: The same links by joining all shingles.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * k >= 90 * (len(p.s) + len(q.s) - k)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m AS component_id FROM sets s JOIN least ON x = s.doc_id
"""
