"""What the training-data operators share: table access, scratch space, batches of whole texts.

Rules that hold for every operator here:

* only the columns it names are read, so extra columns with clashing names do no harm;
* a null text counts as an empty one unless the operator's docstring says otherwise;
* rows whose ids are null or repeated are rows like any other: each gets its own result row;
* scratch tables go under the folder that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import HOT_KEYS, LOT, fresh, spread_join  # noqa: F401  the operators here take them from this module

#: Rows of whole texts that a Python worker gets at once; at some 4 KB a text this is about 1 MB.
BATCH_ROWS = 256
#: Bytes of rows that work is done on at once, unless one row has more.
BATCH_BYTES = 4 << 20
#: Bytes of text for each partition of a table that an operator deals out itself.
PARTITION_BYTES = 16 << 20
#: For a table whose rows have megabytes each.  A writer keeps a row group in memory, and cuts it by bytes only from a hundred rows
#: on; a reader decodes up to 4,096 of its rows at once.  So bytes are looked at after each row, and row groups are small.
LARGE_ROWS = {"parquet.block.size": str(2 * BATCH_BYTES), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: Maps A-Z to a-z in bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: White space as the contracts define it: \x20 and \x09-\x0D, which is what bytes.split() splits on.
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches where the session still has Spark's default: whole texts may be long.

    Results are lazy, so the setting has to outlive this call; a session's own setting is left as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) in (None, "10000"):
        spark.conf.set(key, str(BATCH_ROWS))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name under the shared checkpoint folder; only a local master goes without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors and the driver share")
        base = f"file://{tempfile.gettempdir()}/claimlens-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/claimlens/{name}-{uuid.uuid4().hex[:12]}"


def _trim() -> None:
    """Gives memory that is free within the process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker gives back what it no longer needs: an executor's workers stay on while others run."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return whole


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most BATCH_ROWS rows and, unless one row has more, BATCH_BYTES bytes."""
    for batch in batches:
        held = [batch]
        while held:
            b = held.pop()
            if b.num_rows > 1 and (b.num_rows > BATCH_ROWS or b.nbytes > BATCH_BYTES):
                half = b.num_rows // 2
                held += [b.slice(half), b.slice(0, half)]
            elif b.num_rows:
                yield b


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """The rows of df, written once to the shared folder: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").options(**options or {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the scratch files that df reads, once nothing needs them."""
    jvm = spark.sparkContext._jvm
    for folder in {re.sub(r"(/\w+=[^/]*)*/[^/]*$", "", f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def plan_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the bytes that df reads; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(df: DataFrame, per: int = PARTITION_BYTES) -> int:
    """Partitions for rows of df's size, no fewer than the session's shuffle partitions."""
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(df)
    # Rows that aren't of files have no size that Spark knows of; it then says some huge number.
    return least if size > 1 << 60 else max(least, min(100_000, math.ceil(size / per)))


def remainder(column: str, modulus: int) -> F.Column:
    """crc32 of an id's text form, modulo something: the fold that fixes held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def fields(schema: str, spark: SparkSession) -> pa.Schema:
    """The Arrow schema of a Spark DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def per_batch(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], dict[str, Iterable]]) -> DataFrame:
    """mapInArrow with work, which gets a batch and returns columns of any equal length."""
    arrow = fields(schema, df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            yield to_batch(work(batch), arrow)

    return df.mapInArrow(tidy(run), schema)


def filtered(df: DataFrame, keeps: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """The rows of df that keeps, which gets whole batches, says to keep; all columns as they are, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            yield batch.filter(pa.array(keeps(batch), pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)


def to_batch(columns: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def running_start(df: DataFrame, order: str, size: str, out: str, path: str) -> None:
    """Writes df to path, with columns out and part, and the table path-bases (part, base).

    out and its part's base are the sum of size over all rows before a row in ascending order of the column order.
    Rows are range-partitioned and sorted, rows with one value (or none) by their place in df, so that such a
    group may span partitions; each partition sums its own rows as it streams by, and the partitions' totals,
    one row each, are all that is brought together.  Nulls come first.  df has to be read from files.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` bigint", "part int"])
    arrow = fields(schema, df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = np.asarray(batch.column(size).to_numpy(zero_copy_only=False), dtype=np.int64)
            ends = total + np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ends - sizes), pa.array(np.full(len(sizes), part, np.int32))], schema=arrow)

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(order).asc_nulls_first(), F.col("_place").asc()]
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    placed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), schema).write.option("compression", "zstd").parquet(path)
    # One row a partition: their running sum is small by the number of partitions, whatever the rows.
    held = spark.read.schema(schema).parquet(path)
    base, before = [], 0
    for part, total in sorted((r["part"], r["n"]) for r in held.groupBy("part").agg(F.sum(size).alias("n")).collect()):
        base.append((part, before))
        before += total
    spark.createDataFrame(base, "part int, base bigint").coalesce(1).write.parquet(f"{path}-bases")
