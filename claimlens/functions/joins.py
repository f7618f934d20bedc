"""A join that splits hot keys by known counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a join splits at most, those with most rows; and rows of such a key in one task, on average.
HOT_KEYS, LOT = 10_000, 20_000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until df has no such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def spread_join(facts: DataFrame, held: DataFrame, keys: list[str], by: list[str], lot: int = LOT, uses: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """facts joined with held on keys; held has few rows a key, facts may have any number.

    Rows of keys with more than lot rows are dealt by a hash of the columns by to lots of about lot rows, and held's rows are
    repeated for these.  Only the HOT_KEYS keys with most rows are split, and broadcast as pairs of numbers; any other has
    less than one HOT_KEYS-th of all rows.  uses has the number n of facts' rows by key, if it is known; facts are read for it otherwise.
    """
    mark, lots, share = fresh(facts.join(held.limit(0), keys), "mark", "lots", "share")
    if uses is None:
        uses = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    most = uses.where(F.col("n") > lot).select(F.xxhash64(*keys).alias(mark), "n").orderBy(F.desc("n"), mark).limit(HOT_KEYS).collect()
    if not most:
        return facts.join(held, keys, how)
    sizes: dict[int, int] = {}
    for key, n in most:  # two keys may have one hash
        sizes[key] = sizes.get(key, 0) + n
    hot = F.broadcast(facts.sparkSession.createDataFrame([(key, -(-n // lot)) for key, n in sizes.items()], f"{mark} bigint, {lots} bigint"))
    dealt = facts.withColumn(mark, F.xxhash64(*keys)).join(hot, mark, "left").withColumn(share, F.pmod(F.xxhash64(*by), F.coalesce(lots, F.lit(1).cast("bigint"))))
    every = held.withColumn(mark, F.xxhash64(*keys)).join(hot, mark, "left")
    every = every.withColumn(share, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(lots, F.lit(1).cast("bigint")) - 1)))
    return dealt.drop(mark, lots).join(every.drop(mark, lots), [*keys, share], how).drop(share)
