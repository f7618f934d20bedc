"""Reads tables, and maps the benchmark tables to claims, evidence, transcripts and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import TIERS
from ..operators.rubric import lookup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gold(spark: SparkSession, path: str) -> DataFrame:
    """The gold claims: a JSON array of id, claim, verdict, explanation, sources."""
    return spark.read.option("multiLine", True).json(path)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), "o_custkey", "o_orderdate")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as evidence: the supplier gives the tier, the return flag the stand, the discount the relevance."""
    tier = lookup(F.pmod("l_suppkey", F.lit(len(TIERS))).cast("int"), [(i, t) for i, (t, _) in enumerate(TIERS)])
    stand = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), tier.alias("source_tier"), stand.alias("supports_claim"), F.round(F.col("l_discount") * 10, 1).cast("decimal(3,1)").alias("relevance_score"), F.col("l_linenumber").alias("pos"))
