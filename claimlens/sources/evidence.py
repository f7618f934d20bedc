"""Evidence sources: each takes claims (claim_id, text, category) and gives evidence rows; unavailable ones drop out."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import FACT_CHECK_DOMAINS, FACT_CHECK_NAMES, FIGURE_CATEGORIES
from ..functions.text import is_economic, series_of, tier_of
from .scratch import kept

COLUMNS = ["claim_id", "source_name", "source_url", "source_tier", "snippet", "supports_claim", "relevance_score", "pos"]


class EvidenceSource(Protocol):
    name: str

    def available(self) -> bool: ...

    def evidence(self, claims: DataFrame) -> DataFrame: ...


def relevant(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence whose relevance is a number from 0 to 1, and the rows that are set aside."""
    fine = F.coalesce(F.col("relevance_score").between(0, 1), F.lit(False))
    return rows.where(fine), rows.where(~fine)


def web_query(text: Column, category: Column) -> Column:
    """What a web search is asked: claims on figures are searched as such."""
    return F.substring(F.concat(F.when(category.isin(FIGURE_CATEGORIES), "data statistics ").otherwise("fact check "), text), 1, 200)


def site_query(text: Column, sites: int = 3) -> Column:
    """What a search of the first few fact-checking sites is asked."""
    return F.substring(F.concat(F.lit(f"({' OR '.join(f'site:{d}' for d in FACT_CHECK_DOMAINS[:sites])}) "), text), 1, 250)


class GovernmentData:
    """A stub row for each claim on economic figures with a known series, or its latest observation (series, date, value) if given."""

    name = "government"

    def __init__(self, observations: DataFrame | None = None) -> None:
        self.observations = observations

    def available(self) -> bool:
        return True

    def evidence(self, claims: DataFrame) -> DataFrame:
        found = claims.where(is_economic(F.col("text"))).withColumn("series", series_of(F.col("text"))).where("series is not null")
        stub = F.concat(F.lit("[Stub] FRED series "), "series", F.lit(" — configure FRED_API_KEY for live data."))
        if self.observations is None:
            found = found.withColumns({"snippet": stub, "relevance": F.lit(0.7)})
        else:
            latest = self.observations.groupBy("series").agg(F.max(F.struct("date", "value")).alias("x"))
            told = F.concat(F.lit("FRED "), "series", F.lit(": latest value = "), F.col("x.value").cast("string"), F.lit(" (date: "), F.col("x.date").cast("string"), F.lit(")"))
            found = found.join(latest, "series").withColumns({"snippet": told, "relevance": F.lit(0.9)})
        # A claim has one series, so no cap is ever passed.
        return found.select("claim_id", F.lit("FRED (Federal Reserve)").alias("source_name"), F.concat(F.lit("https://fred.stlouisfed.org/series/"), "series").alias("source_url"), F.lit("Government").alias("source_tier"), "snippet", F.lit(None).cast("boolean").alias("supports_claim"), F.col("relevance").alias("relevance_score"), F.lit(1).alias("pos"))


class Corpus:
    """Search results that are already rows (claim_id, url, text, pos): tier by address, at most so many a claim."""

    def __init__(self, name: str, results: DataFrame, most: int = 5, fact_checks: bool = False) -> None:
        self.name, self.results, self.most, self.fact_checks = name, results, most, fact_checks

    def available(self) -> bool:
        return True

    def evidence(self, claims: DataFrame) -> DataFrame:
        rows = self.results.join(claims.select("claim_id"), "claim_id", "left_semi")
        if self.fact_checks:
            rows = rows.where(reduce(lambda a, b: a | b, (F.contains("url", F.lit(d)) for d in FACT_CHECK_DOMAINS)))
        rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("claim_id").orderBy("pos", "url"))).where(F.col("pos") <= self.most)
        name = fact_check_name() if self.fact_checks else F.lit(self.name)
        return rows.select("claim_id", name.alias("source_name"), F.col("url").alias("source_url"), (F.lit("FactCheck") if self.fact_checks else tier_of(F.col("url"))).alias("source_tier"), F.substring("text", 1, 400 if self.fact_checks else 500).alias("snippet"), F.lit(None).cast("boolean").alias("supports_claim"), F.lit(0.8 if self.fact_checks else 0.5).alias("relevance_score"), "pos")


def fact_check_name():
    out = F.lit("Fact-Check Outlet")
    for domain, name in reversed(FACT_CHECK_NAMES):
        out = F.when(F.contains("url", F.lit(domain)), name).otherwise(out)
    return out


FOUND = "claim_id string, url string, text string, pos int, error string"


class Searched:
    """Evidence by a function that is called for each claim where the claims lie: search(text, category) gives rows of url and text.

    What it raises is that claim's failure alone: a row with the error and no evidence.
    """

    def __init__(self, name: str, search: Callable[[str, str | None], Iterable[dict]], most: int = 5, ready: bool = True) -> None:
        self.name, self.search, self.most, self.ready = name, search, most, ready

    def available(self) -> bool:
        return self.ready

    def found(self, claims: DataFrame) -> DataFrame:
        """claim_id, url, text, pos and error."""
        search, most = self.search, self.most

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for claim, text, category in zip(frame["claim_id"], frame["text"], frame["category"]):
                    try:
                        rows = [(r["url"], r.get("text")) for r in itertools.islice(search(text, category), most)]
                        out += [(claim, url, body, i, None) for i, (url, body) in enumerate(rows, 1)]
                    except Exception as e:
                        out.append((claim, None, None, None, f"{type(e).__name__}: {e}"[:200]))
                yield pd.DataFrame(out, columns=["claim_id", "url", "text", "pos", "error"]).astype({"pos": "Int32"})

        kind = claims.schema["claim_id"].dataType.simpleString()
        asked = claims.select("claim_id", "text", F.col("category") if "category" in claims.columns else F.lit(None).cast("string").alias("category"))
        return asked.mapInPandas(run, FOUND.replace("claim_id string", f"claim_id {kind}"))

    def evidence(self, claims: DataFrame) -> DataFrame:
        """Evidence rows, and failures: rows without an address, with error."""
        rows = self.found(claims)
        return rows.select("claim_id", F.lit(self.name).alias("source_name"), F.col("url").alias("source_url"), tier_of(F.col("url")).alias("source_tier"), F.substring("text", 1, 500).alias("snippet"), F.lit(None).cast("boolean").alias("supports_claim"), F.lit(0.5).alias("relevance_score"), "pos", "error")


def default_sources(results: DataFrame | None = None, observations: DataFrame | None = None) -> list[EvidenceSource]:
    """The usual sources in their order: official figures, fact checks and the web; the last two of search results (claim_id, url, text, pos)."""
    searched = [Corpus("fact checks", results, 3, fact_checks=True), Corpus("web", results, 5)] if results is not None else []
    return [GovernmentData(observations), *searched]


def gather(claims: DataFrame, sources: Sequence[EvidenceSource]) -> DataFrame:
    """Evidence of all available sources, in the order of the sources (rank) and of their results (pos).

    What a source fails at is left out; ``gathered`` tells of it.
    """
    return gathered(claims, sources)[0]


def gathered(claims: DataFrame, sources: Sequence[EvidenceSource]) -> tuple[DataFrame, DataFrame]:
    """Evidence, and failures (source_name, claim_id, error): a source that fails, at all or at some claims, doesn't stop the others.

    A source that fails as a whole has one row without claim_id.
    """
    rows, failed = [], []
    kind = claims.schema["claim_id"].dataType.simpleString()
    ready = [(i, s) for i, s in enumerate(sources) if s.available()]
    if not ready:
        raise ValueError("no evidence source is available")
    spark = claims.sparkSession
    for i, s in ready:
        try:
            found = s.evidence(claims)
            if "error" in found.columns:
                found = kept(found, "evidence")  # it is asked once
                failed.append(found.where("error IS NOT NULL").select(F.lit(s.name).alias("source_name"), "claim_id", "error"))
                found = found.where("error IS NULL")
            rows.append(found.select(*COLUMNS).withColumn("rank", F.lit(i)))
        except Exception as e:
            failed.append(spark.createDataFrame([(s.name, None, f"{type(e).__name__}: {e}"[:200])], f"source_name string, claim_id {kind}, error string"))
    if not rows:
        raise ValueError("every evidence source failed")
    none = spark.createDataFrame([], f"source_name string, claim_id {kind}, error string")
    return reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, failed, none)
