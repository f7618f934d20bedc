"""The claim cache: exact hits by a hash of the claim, fuzzy hits by token order-free similarity, expiry, upsert."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import near_pairs
from ..functions.text import cache_key
from ..sources import versions
from ..sources.scratch import kept

THRESHOLD = 85
TTL_DAYS = 90


def alive(expires_at: Column, now: Column) -> Column:
    return expires_at.isNull() | (now <= expires_at)


def entry(rows: DataFrame, now: Column, ttl_days: int | None = TTL_DAYS) -> DataFrame:
    """Entries of rows (text, label, confidence, explanation, evidence_urls) cached now; without ttl_days they never expire."""
    ends = now + F.make_dt_interval(F.lit(ttl_days)) if ttl_days else F.lit(None).cast("timestamp")
    return rows.select(cache_key(F.col("text")).alias("key"), F.col("text").alias("claim_text"), F.col("label").alias("verdict_label"), "confidence", "explanation", "evidence_urls", now.alias("cached_at"), ends.alias("expires_at"))


def upsert(old: DataFrame, new: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """The latest entry of each key, by cached_at; of equal times the first by ties or, without them, by all columns."""
    order = ties or [c for c in old.columns if c not in ("key", "cached_at")]
    latest = Window.partitionBy("key").orderBy(F.desc("cached_at"), *order)
    return old.unionByName(new).withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def live(cache: DataFrame, now: Column) -> DataFrame:
    """Entries that haven't expired: what a cache holds when it is opened."""
    return cache.where(alive(F.col("expires_at"), now))


def exact(claims: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Claims (claim_id, text) with their live entries; the key's join is a hash or merge join as sizes say."""
    held = live(cache, now).select("key", *(F.col(c).alias(f"cached_{c.removeprefix('verdict_')}") for c in ("verdict_label", "confidence", "explanation") if c in cache.columns))
    return claims.withColumn("key", cache_key(F.col("text"))).join(held, "key", "left")


def invalidate(cache: DataFrame, texts: DataFrame) -> DataFrame:
    """The cache without the entries of these texts."""
    return cache.join(texts.select(cache_key(F.col("text")).alias("key")), "key", "left_anti").select(cache.columns)


def size(cache: DataFrame) -> int:
    return cache.count()


def cleared(cache: DataFrame) -> DataFrame:
    return cache.limit(0)


def invalidated(cache: DataFrame, texts: DataFrame) -> DataFrame:
    """text, removed: whether the cache had an entry of each of these texts."""
    return texts.withColumn("key", cache_key(F.col("text"))).join(cache.select("key").withColumn("removed", F.lit(True)), "key", "left").select("text", F.coalesce("removed", F.lit(False)).alias("removed"))


def save(cache: DataFrame, path: str) -> int:
    """Writes a new version of a stored cache; readers see the one before until it is whole."""
    return versions.save(cache, path)


def put(new: DataFrame, path: str) -> int:
    """Upserts entries into a stored cache; of writers at one time none loses the other's."""
    return versions.update(new.sparkSession, path, lambda old: new if old is None else upsert(old, new))


def load(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """The newest whole version of a stored cache; with now, without what has expired."""
    cache = versions.read(spark, path)
    return cache if now is None else live(cache, now)


def bags(text: Column) -> Column:
    """A processed text with its tokens sorted."""
    plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"[^\x00-\x7F]", "")), "[^a-z0-9]", " "))
    return F.array_join(F.array_sort(F.filter(F.split(plain, " +"), lambda t: t != "")), " ")


def bagged(rows: DataFrame) -> DataFrame:
    """rows (text and more) with the bag of each text as sorted, worked out once a distinct text."""
    of = kept(rows.select("text").distinct().withColumn("sorted", bags(F.col("text"))), "bags")
    return rows.join(of, "text", "left")


#: Bags of either side that are compared in one task at once.
BLOCK = 2_000


def near(a: DataFrame, b: DataFrame, threshold: int) -> DataFrame:
    """Pairs (one, two, score) of a's bags (sorted, least) and b's (sorted) whose score is least or more, which isn't under threshold.

    A pair at the threshold t (200 LCS / (la + lb) >= t - 0.5) has lengths within a factor, so bags meet by bands of lengths,
    and in a band by blocks of about BLOCK bags of either side: a task holds two blocks, whatever the band's size.
    """
    part = 2 * threshold - 1  # in quarters of a percent
    band = F.floor(F.log(F.length("sorted").cast("double")) / F.log(F.lit((400 - part) / part)) + 1e-9).cast("int")
    one = a.select("sorted", "least", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    two = b.select("sorted", band.alias("band"))
    blocks = [{r["band"]: -(-r["count"] // BLOCK) for r in x.groupBy("band").count().collect()} for x in (one, two)]  # bands are as many as the logarithm of the longest length
    shared = sorted(blocks[0].keys() & blocks[1].keys())
    if not shared:
        return a.sparkSession.createDataFrame([], "one string, two string, score int")
    sizes = lambda: F.broadcast(a.sparkSession.createDataFrame([(k, blocks[0][k], blocks[1][k]) for k in shared], "band int, ours int, theirs int"))
    own = lambda n: F.pmod(F.xxhash64("sorted"), n).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = one.join(sizes(), "band").withColumn("i", own(F.col("ours"))).withColumn("j", others("theirs")).drop("ours", "theirs")
    two = two.join(sizes(), "band").withColumn("j", own(F.col("theirs"))).withColumn("i", others("ours")).drop("ours", "theirs")

    def compared(x: pa.Table, y: pa.Table) -> pa.Table:
        ours, theirs = x.column("sorted").to_pylist(), y.column("sorted").to_pylist()
        found = list(near_pairs(ours, x.column("least").to_pylist(), theirs)) if ours and theirs else []
        return pa.table({"one": pa.array([ours[i] for i, _, _ in found], pa.string()), "two": pa.array([theirs[j] for _, j, _ in found], pa.string()), "score": pa.array([s for _, _, s in found], pa.int32())})

    keys = ["band", "i", "j"]
    return one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInArrow(compared, "one string, two string, score int")


def fuzzy(claims: DataFrame, cache: DataFrame, now: Column, threshold: int = THRESHOLD) -> DataFrame:
    """The best entry of each claim with similarity of at least threshold (claim_id, key, score); ties: the first cached.

    Bags (processed texts, tokens sorted) are worked out once a distinct text and meet once each, with the first cached entry of each bag, and results
    go back to the claims by their texts.  A claim whose own bag is an entry has a score of 100, so only pairs that round to 100 can tie
    with it.  An expired best entry is a miss even if another entry would do.
    """
    of = kept(claims.select("text").distinct().withColumn("sorted", bags(F.col("text"))).where(F.length("sorted") > 0), "bags")
    held = cache.withColumn("sorted", bags(F.col("text"))).where(F.length("sorted") > 0)
    entry = F.struct((-F.unix_micros(F.col("cached_at").cast("timestamp"))).alias("at"), "key", "expires_at")
    entries = kept(held.groupBy("sorted").agg(F.max(entry).alias("entry")), "entries")
    own = entries.select("sorted", F.lit(True).alias("own"))
    asked = kept(of.select("sorted").distinct().join(own, "sorted", "left"), "asked")
    texts = entries.select("sorted")
    # Pairs that round to 100 have nearly one length, so their bands are a percent wide.
    whole, rest = (asked.where(x).select("sorted", F.lit(least).alias("least")) for x, least in (("own", 100), ("own IS NULL", threshold)))
    scored = near(whole, texts, 100).unionByName(near(rest, texts, threshold)).join(entries.withColumnRenamed("sorted", "two"), "two")
    best = scored.groupBy(F.col("one").alias("sorted")).agg(F.max(F.struct("score", "entry")).alias("x"))
    found = of.join(best, "sorted").where(alive(F.col("x.entry.expires_at"), now)).select("text", "x.entry.key", "x.score")
    return claims.select("claim_id", "text").join(kept(found, "found"), "text").select("claim_id", "key", "score")


def lookup(claims: DataFrame, cache: DataFrame, now: Column, threshold: int | None = THRESHOLD) -> DataFrame:
    """claim_id, key, score of the entry that serves each claim (claim_id, text): its own if there is one, else the nearest.

    Entries are looked up once a distinct text.  A claim whose own entry has expired is a miss; so is one whose nearest entry has.  Without threshold only own entries serve.
    cache: key, claim_text, cached_at, expires_at, one row a key.
    """
    keyed = kept(claims.select("text").distinct().withColumn("key", cache_key(F.col("text"))), "keyed")
    own = keyed.join(cache.select("key", alive(F.col("expires_at"), now).alias("live")), "key", "left")
    found = own.where("live").select("text", "key", F.lit(100).alias("score"))
    if threshold is not None:
        entries = cache.select("key", F.col("claim_text").alias("text"), "cached_at", "expires_at")
        near_ones = fuzzy(own.where("live is null").select(F.col("text").alias("claim_id"), "text"), entries, now, threshold)
        found = found.unionByName(near_ones.withColumnRenamed("claim_id", "text"))
    return claims.select("claim_id", "text").join(kept(found, "found"), "text").select("claim_id", "key", "score")
