"""[4] Token ids in a content-addressed store of chunks.

A store is a folder of Parquet tables:

* ``chunks`` (digest, payload): each distinct run of ids once, compressed, under the digest of its ids;
* ``recipes`` (doc_id, start, n_tokens, digests, root, part): documents in ascending doc_id order, the chunks that
  make each up, the ids before it in its part, and the Merkle root of its digests; ``recipes-bases`` has the ids before a part;
* ``manifest`` (level, node, digest): Merkle nodes over the documents' roots, FAN of a level to a node above.

A stream is cut after ids where a rolling hash of the last WINDOW ids has its low bits clear, so cuts move with the
contents, and equal passages give equal chunks.  Ids are written and shuffled once: chunks go by digest to
the task that keeps one of each.  To read documents' checksums back, each stored chunk is opened, held
against its digest and summed; recipes then join those sums, not the payloads, and their roots are held against the
manifest.  So the query sees each stored id once and never puts a document's ids together; read_ids does that.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_texts, bounded, fields, per_batch, running_start, scratch, tidy, to_batch, tune
from .tokens import default_path, encoder

END = 2
#: Ids in the rolling hash, average ids between its cuts (a power of two), least and most ids in a chunk.
WINDOW, AVERAGE, LEAST, MOST = 16, 512, 64, 4096
#: Digests that a task remembers so as to send a chunk on once.
SEEN = 100_000
#: Nodes of one Merkle level under a node of the next, and ids whose documents are under a node of the lowest.
FAN, SPAN = 1024, 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


def cuts_of(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each of several id streams, which are put together in ids and end at ends."""
    marks = np.zeros(0, np.int64)
    if len(ids) >= WINDOW:
        h = (ids.astype(np.uint64) + np.uint64(1)) * _BASE
        h ^= h >> np.uint64(31)
        step, factor = 1, int(_BASE)
        while step < WINDOW:
            h = h[: len(h) - step] * np.uint64(factor) + h[step:]
            step, factor = step * 2, factor * factor % (1 << 64)
        marks = np.flatnonzero((h >> np.uint64(40)) % np.uint64(AVERAGE) == 0) + WINDOW
    begins = np.concatenate([[0], ends[:-1]])
    lows, highs = np.searchsorted(marks, begins + WINDOW).tolist(), np.searchsorted(marks, ends, side="right").tolist()
    marks, out = marks.tolist(), []
    for begin, end, low, high in zip(begins.tolist(), ends.tolist(), lows, highs):
        own, last = [], begin
        for mark in [*marks[low:high], end] if end - begin > LEAST else [end] * (end > begin):
            while mark - last > MOST:
                last += MOST
                own.append(last)
            if mark - last >= LEAST or mark == end and mark > last:
                own.append(mark)
                last = mark
        out.append(own)
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    return cuts_of(ids, np.array([len(ids)]))[0]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary Merkle tree; an odd node goes up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return digest(b"\0" + level[0])


@lru_cache(maxsize=1)
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(ids: np.ndarray) -> bytes:
    """A chunk's payload: two bytes an id if they suffice, else four; then zstd."""
    narrow = int(ids.max()) < 1 << 16
    return (b"\2" if narrow else b"\4") + _codec()[0].compress(ids.astype("<u2" if narrow else "<u4").tobytes())


def unpacked(payload: bytes) -> np.ndarray:
    return np.frombuffer(_codec()[1].decompress(payload[1:]), "<u2" if payload[0] == 2 else "<u4").astype("<u4")


def checked(name: bytes, payload: bytes) -> np.ndarray:
    ids = unpacked(payload)
    if digest(ids.tobytes()) != name:
        raise ValueError(f"chunk {name.hex()} does not hold what its digest names")
    return ids


def write(documents: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    """Writes the store of doc_id and text: null texts are empty, each document gets the end id, repeated rows are kept."""
    spark = documents.sparkSession
    tune(spark)
    tokenizer = tokenizer or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, seen = np.array([end], "<u4"), set()
        for batch in bounded(batches):
            chunks, recipes = [], []
            each = encoder(tokenizer).encode(as_texts(batch.column("text")))
            ids = np.concatenate([x for each_ids in each for x in (each_ids, tail)])
            ends = np.cumsum([len(x) + 1 for x in each])
            start = 0
            for doc_id, own, stops in zip(batch.column("doc_id").to_pylist(), each, cuts_of(ids, ends)):
                names = []
                for stop in stops:
                    name = digest(ids[start:stop].tobytes())
                    names.append(name)
                    if name not in seen:
                        seen.add(name)
                        chunks.append((name, packed(ids[start:stop])))
                    start = stop
                recipes.append((doc_id, len(own) + 1, names, merkle(names)))
            if len(seen) > SEEN:
                seen.clear()
            c, r = len(chunks), len(recipes)
            yield to_batch({"part": ["chunks"] * c + ["recipes"] * r, **{k: [x[i] for x in chunks] + [None] * r for i, k in enumerate(("digest", "payload"))}, **{k: [None] * c + [x[i] for x in recipes] for i, k in enumerate(("doc_id", "n_tokens", "digests", "root"))}}, arrow)

    schema = "part string, digest binary, payload binary, doc_id bigint, n_tokens bigint, digests array<binary>, root binary"
    arrow = fields(schema, spark)
    rows = documents.select("doc_id", "text").mapInArrow(tidy(encode), schema)
    # One of each chunk; recipes go anywhere, as each is a group of its own.
    rows = rows.withColumn("row", F.when(F.col("digest").isNull(), F.monotonically_increasing_id()))
    raw = f"{path}/raw"
    kept = rows.groupBy("part", "digest", "row").agg(*(F.first(c).alias(c) for c in ("payload", "doc_id", "n_tokens", "digests", "root"))).drop("row")
    kept.select(*rows.columns[:-1]).write.partitionBy("part").option("compression", "uncompressed").parquet(raw)  # payloads are compressed

    recipes = spark.read.schema("doc_id bigint, n_tokens bigint, digests array<binary>, root binary, part string").parquet(raw).where("part = 'recipes'").drop("part")
    running_start(recipes, "doc_id", "n_tokens", "start", f"{path}/recipes")
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(f"{raw}/part=chunks")
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(source) or not files.rename(source, jvm.org.apache.hadoop.fs.Path(f"{path}/chunks")):
        spark.createDataFrame([], "digest binary, payload binary").write.parquet(f"{path}/chunks")
    files.delete(jvm.org.apache.hadoop.fs.Path(raw), True)
    manifest(spark, path, "root").write.partitionBy("level").parquet(f"{path}/manifest")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    local = spark.read.schema("doc_id bigint, n_tokens bigint, digests array<binary>, root binary, start bigint, part int").parquet(f"{path}/recipes")
    bases = spark.read.schema("part int, base bigint").parquet(f"{path}/recipes-bases")  # a row a partition of the writing
    return local.join(F.broadcast(bases), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "digests", "root")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest binary, payload binary").parquet(f"{path}/chunks")


def manifest(spark: SparkSession, path: str, root: str = "root") -> DataFrame:
    """Merkle nodes (level, node, digest) over the documents' roots in order of their starts."""
    leaves = _recipes(spark, path)
    if root != "root":
        leaves = per_batch(leaves, "start bigint, root binary", lambda b: {"start": b.column("start"), "root": [merkle(x) for x in b.column("digests").to_pylist()]})
    joined = F.sha2(F.concat_ws(",", F.expr("transform(array_sort(collect_list(struct(place, digest))), x -> x.digest)")), 256).alias("digest")
    level = leaves.select(F.floor(F.col("start") / SPAN).cast("long").alias("node"), F.col("start").alias("place"), F.hex("root").alias("digest")).groupBy("node").agg(joined)
    out = level.withColumn("level", F.lit(0))
    for depth in range(1, _depth(spark, path) + 1):
        level = level.select(F.floor(F.col("node") / FAN).cast("long").alias("up"), F.col("node").alias("place"), "digest").groupBy(F.col("up").alias("node")).agg(joined)
        out = out.unionByName(level.withColumn("level", F.lit(depth)))
    return out


def _depth(spark: SparkSession, path: str) -> int:
    """Levels over the lowest one."""
    last = _recipes(spark, path).agg(F.max("start").alias("m")).first()["m"] or 0
    nodes, depth = last // SPAN + 1, 0
    while nodes > 1:
        nodes, depth = -(-nodes // FAN), depth + 1
    return depth


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("node bigint, digest string, level int").parquet(f"{path}/manifest")


def broken(spark: SparkSession, path: str) -> DataFrame:
    """Manifest nodes that the recipes' digests, hashed anew, don't give."""
    return _manifest(spark, path).join(manifest(spark, path, "anew"), ["level", "node", "digest"], "left_anti")


def sound(spark: SparkSession, path: str) -> DataFrame:
    """The lowest manifest nodes that hold, as do all nodes above them, what the recipes' roots give."""
    held = manifest(spark, path).join(_manifest(spark, path), ["level", "node", "digest"], "left_semi").select("level", "node")
    out = held.where("level = 0").select("node")
    for depth in range(1, _depth(spark, path) + 1):
        above = held.where(F.col("level") == depth).select(F.col("node").alias("up"))
        out = out.join(above, F.floor(F.col("node") / FAN**depth) == F.col("up"), "left_semi")
    return out


@lru_cache(maxsize=1 << 16)
def _shift(n: int) -> int:
    """x to the power 8 n modulo the CRC polynomial, reflected."""
    out, base, n = 1 << 31, 1 << 23, n
    while n:
        if n & 1:
            out = _times(out, base)
        base, n = _times(base, base), n >> 1
    return out


def _times(a: int, b: int) -> int:
    product, bit = 0, 1 << 31
    while bit:
        if a & bit:
            product ^= b
        b = b >> 1 ^ 0xEDB88320 if b & 1 else b >> 1
        bit >>= 1
    return product


def joined_crc(crcs: list[int], sizes: list[int]) -> int:
    """crc32 of byte strings put together, from their own crc32s and sizes in bytes."""
    out = 0
    for crc, size in zip(crcs, sizes):
        out = (_times(_shift(size), out) if out else 0) ^ crc
    return out


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and verified, from the store's files alone.

    Each chunk is opened, checked and summed where it lies.  verified: all chunks are there, their ids add up to
    n_tokens, their digests to the recipe's Merkle root, and the roots to the manifest's nodes over the document.
    """
    tune(spark)

    def sums(batch: pa.RecordBatch) -> dict[str, list]:
        names = batch.column("digest").to_pylist()
        ids = [checked(d, p).tobytes() for d, p in zip(names, batch.column("payload").to_pylist())]
        return {"digest": batch.column("digest"), "n": [len(x) // 4 for x in ids], "crc": list(map(zlib.crc32, ids))}

    summed = per_batch(_chunks(spark, path), "digest binary, n bigint, crc bigint", sums)
    asked = _recipes(spark, path).select("doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("pos", "digest"))
    told = asked.join(summed, "digest", "left").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.array_sort(F.collect_list(F.struct("pos", "digest", "n", "crc"))).alias("parts"))

    def check(batch: pa.RecordBatch) -> dict[str, list]:
        crcs, good = [], []
        rows, parts = batch.column("parts").offsets.to_pylist(), batch.column("parts").values
        names, sizes, sums = (parts.field(c).to_pylist() for c in ("digest", "n", "crc"))
        for root, n, a, b in zip(batch.column("root").to_pylist(), batch.column("n_tokens").to_pylist(), rows, rows[1:]):
            whole = None not in sizes[a:b]
            good.append(whole and sum(sizes[a:b]) == n and merkle(names[a:b]) == root)
            crcs.append(joined_crc(sums[a:b], [4 * x for x in sizes[a:b]]) if whole else 0)
        return {**{c: batch.column(c) for c in ("doc_id", "start", "n_tokens")}, "ids_crc32": crcs, "verified": good}

    checked_rows = per_batch(told, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, verified boolean", check)
    nodes = sound(spark, path).withColumn("sound", F.lit(True))
    under = checked_rows.withColumn("node", F.floor(F.col("start") / SPAN)).join(nodes, "node", "left")
    return under.select("doc_id", "start", "n_tokens", "ids_crc32", (F.col("verified") & F.coalesce("sound", F.lit(False))).alias("verified"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids of each document, put together from its chunks."""
    tune(spark)
    asked = _recipes(spark, path).select("doc_id", "start", F.posexplode("digests").alias("pos", "digest"))
    told = asked.join(_chunks(spark, path), "digest").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("pos", "digest", "payload"))).alias("parts"))

    def put(batch: pa.RecordBatch) -> dict[str, list]:
        ids = [np.concatenate([checked(p["digest"], p["payload"]) for p in row]).tolist() for row in batch.column("parts").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "start": batch.column("start"), "ids": ids}

    return per_batch(told, "doc_id bigint, start bigint, ids array<int>", put)


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "store")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_checksums(spark, path)
