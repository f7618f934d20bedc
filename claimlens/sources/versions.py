"""Tables that are replaced as a whole: numbered versions, of which a writer can't lose another's.

A version's rows are written to a folder with a name of its own, and become version n by a file ``_log/n`` with that name,
which is created only if it isn't there yet.  Readers follow the last number.  Who changes a table starts from the
last version; if another writer was faster, the change is made anew from the version that is there now.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Taken(Exception):
    """Another writer has made this version."""


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def newest(spark: SparkSession, path: str) -> int:
    """The number of the last version; 0 without any."""
    at, files = _files(spark, f"{path}/_log")
    return max((int(s.getPath().getName()) for s in files.listStatus(at) if s.getPath().getName().isdigit()), default=0) if files.exists(at) else 0


def _folder(spark: SparkSession, path: str, version: int) -> str:
    at, files = _files(spark, f"{path}/_log/{version:012d}")
    for _ in range(50):  # between the file's creation and its end it may be empty
        stream = files.open(at)
        name = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        stream.close()
        if name:
            return f"{path}/{name}"
        time.sleep(0.1)
    raise OSError(f"version {version} of {path} was begun and not ended")


def commit(rows: DataFrame, path: str, version: int, form: str = "parquet") -> int:
    """Writes rows as this version; raises Taken, and leaves nothing behind, if there is one of that number."""
    spark = rows.sparkSession
    name = f"data-{uuid.uuid4().hex}"
    rows.write.format(form).save(f"{path}/{name}")
    at, files = _files(spark, f"{path}/_log/{version:012d}")
    try:
        out = files.create(at, False)
    except Exception as e:
        old, _ = _files(spark, f"{path}/{name}")
        files.delete(old, True)
        if not files.exists(at):
            raise
        raise Taken(f"{path} has a version {version}") from e
    out.write(bytearray(name.encode()))
    out.close()
    return version


def read(spark: SparkSession, path: str, version: int | None = None, form: str = "parquet") -> DataFrame:
    """A version's rows, the last one's if none is named; raises FileNotFoundError without any."""
    last = newest(spark, path) if version is None else version
    if not last:
        raise FileNotFoundError(f"there is no version of {path}")
    return spark.read.format(form).load(_folder(spark, path, last))


def save(rows: DataFrame, path: str, form: str = "parquet") -> int:
    """Rows as a new last version, whatever was there before."""
    while True:
        try:
            return commit(rows, path, newest(rows.sparkSession, path) + 1, form)
        except Taken:
            continue


def update(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame]) -> int:
    """A new version, which change makes of the last one (none at first); made again if another writer came between."""
    while True:
        base = newest(spark, path)
        try:
            return commit(change(read(spark, path, base) if base else None), path, base + 1)
        except Taken:
            continue
