"""Answers that were kept in files: one JSON object a line, or a file for each claim; what is broken is a miss."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

from . import versions

KEPT = "key string, answer string"


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The kept answers (key, answer) of the last version under path, and the lines that are no such object; none without a version.

    Of a key that was written twice the last answer in byte order counts.
    """
    if not versions.newest(spark, path):
        return spark.createDataFrame([], KEPT), spark.createDataFrame([], "line string")
    lines = versions.read(spark, path, form="text").select(F.col("value").alias("line"))
    told = lines.select("line", F.from_json("line", f"{KEPT}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("x"))
    good = F.coalesce(F.col("x._corrupt_record").isNull() & F.col("x.key").isNotNull() & F.col("x.answer").isNotNull(), F.lit(False))
    return told.where(good).groupBy("x.key").agg(F.max("x.answer").alias("answer")), told.where(~good).select("line")


def save(rows: DataFrame, path: str) -> int:
    """Answers (key, answer) as a new last version."""
    return versions.save(rows.select(F.to_json(F.struct(F.col("key").cast("string").alias("key"), F.col("answer").cast("string").alias("answer"))).alias("value")), path, "text")


@dataclass
class File(InputPartition):
    path: str


class KeptSearch(DataSource):
    """``spark.read.format("kept_search").option("path", folder)``: results of searches that were kept, an object a line.

    A file has {"claim_id": ..., "web": {"results": [{"url": ..., "title": ..., "description": ...}, ...]}} on each line.  Each file is a partition.
    The option most keeps that many results a claim; a filter on claim_id is pushed, and other claims give no rows.  A
    line that can't be read as that gives one row with its error and no result.  path is one of any file system that pyarrow knows.
    """

    @classmethod
    def name(cls) -> str:
        return "kept_search"

    def schema(self) -> str:
        return "claim_id string, pos int, url string, title string, text string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return KeptReader(self.options)


class KeptReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.most, self.claim = options["path"], int(options.get("most", str(1 << 30))), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("claim_id",):
                self.claim = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(fs.FileSelector(at))
        return [File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.size and not f.base_name.startswith((".", "_"))] or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        from pyarrow import fs

        if not partition.path:
            return
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        name = partition.path.rsplit("/", 1)[-1].split(".")[0]
        with io.TextIOWrapper(io.BufferedReader(system.open_input_stream(partition.path)), "utf-8", "replace") as lines:
            for line in lines:
                try:
                    told = json.loads(line)
                    claim = str(told["claim_id"])
                    rows = [(claim, i, r.get("url"), r.get("title"), r.get("description"), None) for i, r in enumerate(told["web"]["results"][: self.most], 1)]
                except Exception as e:  # a broken line is its own failure alone
                    claim, rows = name, [(name, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]
                if self.claim is None or claim == self.claim:
                    yield from rows


@udtf(returnType="pos int, url string, title string, text string, error string")
class SearchResults:
    """In SQL: ``SELECT ... FROM t, LATERAL search_results(t.answer, 5)``: an answer's results, at most so many, or a row with its error.

    An answer that is null has none.
    """

    def eval(self, answer: str, most: int) -> Iterator[tuple]:
        if answer is None:
            return
        try:
            found = json.loads(answer).get("web", {}).get("results", [])
            rows = [(i, r.get("url"), r.get("title"), r.get("description"), None) for i, r in enumerate(found[:most], 1)]
        except Exception as e:  # a broken answer is its own failure alone
            rows = [(None, None, None, None, f"{type(e).__name__}: {e}"[:200])]
        yield from rows


def files_read(spark: SparkSession, path: str, most: int) -> DataFrame:
    """What was found in the kept searches of a folder, at most so many results a claim."""
    return spark.read.format("kept_search").option("path", path).option("most", most).load()


def register(spark: SparkSession) -> None:
    """Makes the format, its push of filters, and the table function search_results known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeptSearch)
    spark.udtf.register("search_results", SearchResults)
