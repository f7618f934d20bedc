"""Connected components of a link table by repeated hooking and shortcutting; nothing goes to the driver.

A node that many others are linked with, and a label that many nodes have, are split in the joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOT, remove, spread_join, written


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, comp) of every node in links (a, b): comp is the component's smallest node.

    Each round a node takes the least label among its own and its neighbours', then the label of that
    label; so chains halve in length.  Labels are written each round, which cuts the lineage.
    """
    spark = links.sparkSession
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), f"{name}-links")
    degrees = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other"), F.count(F.lit(1)).alias("n"))
    degrees = written(degrees, f"{name}-degrees")
    labels = written(degrees.select("node", F.least("node", "other").alias("comp")), f"{name}-labels")
    crowded = labels.count() > LOT  # of fewer nodes none, and no label, can have more rows than a task takes anyway

    def joined(rows: DataFrame, held: DataFrame, key: str, by: str, how: str, uses: DataFrame) -> DataFrame:
        return spread_join(rows, held, [key], [by], uses=uses, how=how) if crowded else rows.join(held, key, how)

    while True:
        linked = joined(both.withColumnRenamed("b", "node"), labels, "node", "a", "inner", degrees.select("node", "n"))
        near = linked.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        hooked = labels.join(near, "node", "left").select("node", "comp", F.least("comp", F.coalesce("low", "comp")).alias("new"))
        if crowded:
            hooked = written(hooked, f"{name}-hooked")
        uses = hooked.groupBy("new").agg(F.count(F.lit(1)).alias("n"))
        jump = labels.select(F.col("node").alias("new"), F.col("comp").alias("up"))
        following = written(joined(hooked, jump, "new", "node", "left", uses).select("node", "comp", F.least("new", F.coalesce("up", "new")).alias("new")), f"{name}-labels")
        moved = following.where("new <> comp").limit(1).count()
        remove(spark, labels)
        if crowded:
            remove(spark, hooked)
        labels = following.select("node", F.col("new").alias("comp"))
        if not moved:
            for done in (both, degrees):
                remove(spark, done)
            return labels
