"""Transcripts from texts and files: what is blank is set aside, what is known of a text goes before what is found in it."""

from __future__ import annotations

from datetime import date, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

STRIPPED, UNDATED = "Detected and stripped subtitle timing markers.", "Could not detect a date in the transcript."


def transcript_id(*parts: Column) -> Column:
    """An id that depends on the text alone, so that lost tasks give it again."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def transcripts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transcripts, and the rows that are set aside for being blank, of rows with text and, if they like, speaker, date, venue, source_url.

    Transcripts have id, text, speaker, date, venue, source_url, word_count and warnings.
    """
    given = lambda name, kind: F.col(name) if name in rows.columns else F.lit(None).cast(kind)
    blank = F.coalesce(T.strip(F.col("text")), F.lit("")) == ""
    text = T.normalise_space(T.strip_subtitles(F.col("text")))
    clean = rows.where(~blank).select(text.alias("text"), F.coalesce(given("speaker", "string"), F.lit("Unknown")).alias("speaker"), given("date", "date").alias("given_date"), F.nullif(given("venue", "string"), F.lit("")).alias("given_venue"), given("source_url", "string").alias("source_url"), T.is_subtitles(F.col("text")).alias("subtitles"), *[c for c in rows.columns if c not in ("text", "speaker", "date", "venue", "source_url")])
    found = clean.withColumns({"date": F.coalesce(F.col("given_date").cast("date"), T.find_date(F.col("text"))), "venue": F.coalesce("given_venue", T.find_venue(F.col("text")))})
    warned = F.filter(F.array(F.when(F.col("subtitles"), STRIPPED), F.when(F.col("date").isNull(), UNDATED)), lambda w: w.isNotNull())
    out = found.withColumns({"id": transcript_id("text", "speaker"), "word_count": T.word_count(F.col("text")), "warnings": warned})
    return out.drop("given_date", "given_venue", "subtitles"), rows.where(blank)


def files(spark: SparkSession, path: str) -> DataFrame:
    """text and source_url of a file, of bytes that aren't UTF-8 with a mark in their place; raises on a missing path or a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        raise FileNotFoundError(path)
    if system.getFileStatus(at).isDirectory():
        raise ValueError(f"{path} is a folder, not a file")
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.expr("try_validate_utf8(cast(content AS string))").alias("whole"), F.col("content").cast("string").alias("any"), "path").select(F.coalesce("whole", F.expr("make_valid_utf8(any)")).alias("text"), F.col("path").alias("source_url"))


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether there is something of that name; a text that is no name at all is none."""
    if not path.strip() or "\n" in path or len(path) > 4096:
        return False
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))
    except Py4JJavaError:
        return False


def given_date(text: str) -> date:
    """The day that is named as YYYY-MM-DD; raises ValueError for anything else."""
    return datetime.strptime(text, "%Y-%m-%d").date()


def ingest(spark: SparkSession, source: str, fetched: DataFrame | None = None, **known) -> tuple[DataFrame, DataFrame]:
    """Transcripts, and blank rows, of an address, of a file if there is one of that name, or else of a text itself.

    Addresses are looked up in fetched pages (url, html), whose body counts as it is; nothing is fetched here.
    known gives speaker, date (a day, or its text as YYYY-MM-DD) and venue.
    """
    if source.startswith(("http://", "https://")):
        if fetched is None:
            raise ValueError("pages have to be given for an address")
        rows = fetched.where(F.col("url") == source).select(F.col("html").alias("text"), F.col("url").alias("source_url"))
    elif is_file(spark, source):
        rows = files(spark, source)
    else:
        rows = spark.createDataFrame([(source,)], "text string")
    if isinstance(known.get("date"), str):
        known["date"] = given_date(known["date"])
    return transcripts(rows.withColumns({k: F.lit(v) for k, v in known.items()}))
