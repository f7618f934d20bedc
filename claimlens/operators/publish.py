"""Reports as rows: posts and threads, feed items, list pages, JSON, event frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import LABELS
from ..functions.text import shorten
from ..sources import versions
from .rubric import lookup

POST_CHARS, POSTS = 300, 10


def verdict_post(claim: Column, label: Column, confidence: Column, explanation: Column) -> Column:
    line = F.concat(lookup(label, [(x[0], x[3]) for x in LABELS], "•"), F.lit(" "), label, F.lit(" ("), confidence, F.lit(" confidence)"))
    head = F.substring(explanation, 1, 80)
    room = F.greatest(F.lit(60), POST_CHARS - F.length(line) - F.length(head) - 10)
    return F.substring(F.concat(F.lit('"'), shorten(claim, room), F.lit('"\n\n'), line, F.lit("\n"), head), 1, POST_CHARS)


def thread(posts: DataFrame, group: str, order: str, uri: str, most: int = POSTS) -> DataFrame:
    """Each group's first posts with root and parent: a reply answers the post before it."""
    w = Window.partitionBy(group).orderBy(order)
    return posts.withColumns({"n": F.row_number().over(w), "parent": F.lag(uri).over(w), "root": F.first(uri).over(w)}).where(F.col("n") <= most)


def page(reports: DataFrame, page: int, page_size: int, speaker: str | None = None) -> DataFrame:
    """One page of reports, newest first, ties by report_id; speaker filters by a part of the name, whatever its case."""
    if page < 1:
        raise ValueError("pages count from 1")
    size = min(page_size, 100)
    found = reports if speaker is None else reports.where(F.contains(F.lower("speaker"), F.lit(speaker.lower())))
    return found.orderBy(F.desc("created_at"), "report_id").offset((page - 1) * size).limit(size)


def report_text(reports: DataFrame, verdicts: DataFrame, claims: DataFrame) -> DataFrame:
    """report_id, text: a heading for each report (report_id, speaker, date, venue), then a paragraph a verdict
    (report_id, claim_id, pos, label, confidence, explanation) in order, with its claim's text (claim_id, text) if there is one.
    """
    named = verdicts.join(claims.select("claim_id", "text"), "claim_id", "left")
    said = F.format_string("\n[%s] %s\n  Confidence: %s\n  %s\n", "label", F.coalesce("text", F.lit("(claim not found)")), "confidence", "explanation")
    lots = named.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("pos", said.alias("said")))).alias("x"))
    head = F.concat_ws("\n", F.concat(F.lit("Fact-check report for "), F.coalesce("speaker", F.lit("Unknown"))), F.concat(F.lit("Date: "), F.date_format("date", "MMMM dd, yyyy")), F.concat(F.lit("Venue: "), F.nullif("venue", F.lit(""))))
    paragraphs = F.coalesce(F.array_join("x.said", ""), F.lit(""))
    return reports.join(lots, "report_id", "left").select("report_id", F.concat(head, F.lit("\n"), paragraphs).alias("text"))


def frame(event: Column, data: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def to_sinks(reports: DataFrame, sinks: dict[str, Callable[[DataFrame], Column | None]], now: Column) -> tuple[DataFrame, dict[str, str | None]]:
    """Gives reports to each sink in turn, and tells of each why it failed, or null: one that fails doesn't stop the others.

    A sink may return the address that a report has there, which becomes a column of its name; it is null where the sink failed or has none.
    published_at is set last, whatever failed.
    """
    out, outcomes = reports, {}
    for name, sink in sinks.items():
        address = None
        try:
            address, outcomes[name] = sink(reports), None
        except Exception as e:
            outcomes[name] = f"{type(e).__name__}: {e}"[:200]
        out = out.withColumn(name, F.lit(None).cast("string") if address is None else address)
    return out.withColumn("published_at", now), outcomes


def stored(path: str, reports: DataFrame) -> int:
    """Upserts reports by report_id into a stored table of reports, the last one of an id by created_at; returns the version."""

    def change(old: DataFrame | None) -> DataFrame:
        every = reports if old is None else old.unionByName(reports)
        rest = F.struct("created_at", *(c for c in reports.columns if c not in ("report_id", "created_at")))
        return every.groupBy("report_id").agg(F.max(rest).alias("x")).select("report_id", "x.*").select(reports.columns)

    return versions.update(reports.sparkSession, path, change)
