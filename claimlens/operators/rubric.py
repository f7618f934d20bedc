"""The rubric: evidence weighted by its source's tier gives each claim a verdict and a confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import LABELS, TIERS


def lookup(key: Column, pairs: list[tuple], default=None) -> Column:
    """A small fixed table as an expression."""
    return reduce(lambda out, p: F.when(key == p[0], F.lit(p[1])).otherwise(out), reversed(pairs), F.lit(default))


def weight(tier: Column) -> Column:
    return F.coalesce(lookup(tier, TIERS), F.lit("0.40")).cast("decimal(4,2)")


def rubric(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, label, confidence, numeric_score, support_weight, contradict_weight, evidence_count, best_tier.

    evidence: claim_id, source_tier, supports_claim (null: says neither), relevance_score (decimal, so that
    sums don't depend on the order of rows).  One shuffle, with partial sums before it; claims without
    evidence come from the outer join.
    """
    rank = lookup(F.col("source_tier"), [(t, i) for i, (t, _) in enumerate(TIERS)], len(TIERS) - 1)
    worth = weight(F.col("source_tier")) * F.col("relevance_score")
    zero = F.lit(0).cast("decimal(4,2)")
    told = evidence.groupBy("claim_id").agg(
        F.sum(F.when(F.col("supports_claim"), worth).otherwise(zero)).alias("support_weight"),
        F.sum(F.when(~F.col("supports_claim"), worth).otherwise(zero)).alias("contradict_weight"),
        F.count(F.lit(1)).alias("evidence_count"),
        F.min(rank).alias("best"),
        F.bool_or((F.coalesce(F.col("supports_claim"), F.lit(True)) == F.lit(False)) & F.col("source_tier").isin("Government", "Wire")).alias("refuted"),
        F.bool_or(F.col("source_tier").isin("Government", "Wire", "Academic")).alias("high"),
    )
    joined = claims.select("claim_id").join(told, "claim_id", "left")
    s, c = F.col("support_weight").cast("double"), F.col("contradict_weight").cast("double")
    share = F.coalesce(F.try_divide(s, s + c), F.lit(0.5))
    label = (
        F.when(F.col("evidence_count").isNull(), "Unverifiable")
        .when(F.col("refuted") & (share < 0.5), "False")
        .when(share >= 0.85, "True")
        .when(share >= 0.65, "Mostly True")
        .when(share >= 0.45, "Misleading")
        .when(share >= 0.25, "Exaggerated")
        .otherwise("False")
    )
    n = F.col("evidence_count")
    sure = F.when((n >= 3) & F.col("high"), "High").when((n >= 2) | ((n >= 1) & F.col("high")), "Medium").otherwise("Low")
    out = joined.select("claim_id", label.alias("label"), sure.alias("confidence"), F.coalesce(s, F.lit(0.0)).alias("support_weight"), F.coalesce(c, F.lit(0.0)).alias("contradict_weight"), F.coalesce(n, F.lit(0)).alias("evidence_count"), lookup(F.col("best"), [(i, t) for i, (t, _) in enumerate(TIERS)]).alias("best_tier"))
    return out.withColumn("numeric_score", lookup(F.col("label"), [(x[0], x[1]) for x in LABELS], 5.0))


def to_verdicts(scores: DataFrame) -> DataFrame:
    """Verdict rows: the label's description as explanation, and weights rounded half-even as counts."""
    text = lookup(F.col("label"), [(x[0], x[2]) for x in LABELS], "")
    return scores.select("claim_id", "label", "confidence", text.alias("explanation"), F.bround("support_weight").cast("int").alias("support_count"), F.bround("contradict_weight").cast("int").alias("contradict_count"), F.col("best_tier").alias("primary_source_tier"))


def worst_tier(evidence: DataFrame) -> DataFrame:
    """The least trusted tier of a claim's evidence, which the model path reports."""
    rank = lookup(F.col("source_tier"), [(t, i) for i, (t, _) in enumerate(TIERS)], len(TIERS) - 1)
    return evidence.groupBy("claim_id").agg(F.max(rank).alias("r")).select("claim_id", lookup(F.col("r"), [(i, t) for i, (t, _) in enumerate(TIERS)]).alias("tier"))


def evidence_prompt(evidence: DataFrame, most: int = 10) -> DataFrame:
    """claim_id, prompt: a claim's first pieces of evidence (pos, source_name, source_tier, snippet), numbered."""
    rows = evidence.withColumn("n", F.row_number().over(Window.partitionBy("claim_id").orderBy("pos"))).where(F.col("n") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "source_name", "source_tier", "snippet"))), lambda x: F.format_string("[%d] %s (%s)\n%s", x["n"], x["source_name"], x["source_tier"], x["snippet"]))
    return rows.groupBy("claim_id").agg(F.array_join(lines, "\n\n").alias("prompt"))


def summary(verdicts: DataFrame, group: str) -> DataFrame:
    """Counts of every label for each group, zeros included, in label order."""
    counts = verdicts.groupBy(group).agg(*(F.count_if(F.col("label") == x[0]).alias(f"_{i}") for i, x in enumerate(LABELS)))
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(x[0]).alias("label"), F.col(f"_{i}").alias("n")) for i, x in enumerate(LABELS))))
    return counts.select(group, rows.alias("x")).select(group, "x.*")


def scorecard(verdicts: DataFrame) -> DataFrame:
    """Counts of labels, and the share of each among all and of True among decided ones."""
    counts = verdicts.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("label") != "Unverifiable", F.col("n"))).alias("decided"))
    joined = counts.crossJoin(F.broadcast(total))  # one row
    return joined.select("label", "n", (F.col("n") / F.col("total")).alias("share"), F.when(F.col("label") != "Unverifiable", F.col("n") / F.col("decided")).alias("decided_share"))


def subtotals(scored: DataFrame, *groups: str) -> DataFrame:
    """Counts of claims and mean scores by all of groups, by each part of them, and over all: in one pass, by grouping sets.

    level tells which groups a row is over: a bit is set for each that is left out, the last group's being the lowest.
    """
    return scored.cube(*groups).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum("evidence_count").alias("evidence"), F.sum(F.col("numeric_score").cast("decimal(4,1)")).alias("score"))
