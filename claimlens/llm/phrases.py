"""[11] Phrase collocation mining by Apriori level-wise passes.

Pass k counts the phrases of k words, by language.  Of k > 1 a pass emits only phrases both of whose overlapping parts of
k - 1 words are frequent; those are broadcast as sorted 64-bit marks while there are at most SET_MARKS of them,
and beyond that as a bit map of 2 ** MAP_BITS bits, which may let some more phrases through.  Marks only spare work: any
phrase that passes is counted in full by Spark, by its text, and infrequent ones are dropped by that count, so
neither collisions nor a full map change a result.  Every level's frequent phrases are written; scores, cuts and
redundancy come from these level tables.

Each task counts a few MB of text at a time: words are numbered within these, phrases are pairs of the number of their
first k - 1 words and of their last, and each different phrase leaves the task once with its count.  Spark adds
counts up before and after the shuffle, so a phrase that is everywhere costs one row a task.

Odd input: a null text is empty, a null language counts as "und".  Rows whose doc_id is null or repeated
count like any others (doc_id isn't read).  Texts are taken whole: ones longer than SPAN bytes are counted span by
span, each phrase in the span in which it begins.  Equal scores go by counts, then by the phrase's bytes.  Empty
tables, and languages without candidates, give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, bounded, fields, spread_join, table, tidy, tune, written

LEAST, LONGEST, TOP = 30, 4, 2000
SCALE = 2_000_000
COVERED = (80, 100)
UNKNOWN = "und"
#: Bytes of text that are counted at once.
SPAN = 4 << 20
#: Frequent phrases of a level that are broadcast by their marks (8 bytes each), and bits of the map beyond (64 MB).
SET_MARKS, MAP_BITS = 4_000_000, 29

#: A-Z lowered, tabs to spaces, what ends a piece to line feeds.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_WORD = re.compile(rb"[^ \n]+")
_SPACE = re.compile(rb"[ \n]")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ x) * _PRIME
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)


class Marks:
    """Which marks are of frequent phrases: exactly while they are few, by a bit map that may say yes too often beyond."""

    def __init__(self, marks: np.ndarray | None = None, bits: np.ndarray | None = None, size: int = 0):
        self.marks, self.bits, self.size = marks, bits, size

    def has(self, marks: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            at = marks >> np.uint64(64 - self.size)
            return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        if not len(self.marks):
            return np.zeros(len(marks), bool)
        return self.marks[np.minimum(np.searchsorted(self.marks, marks), len(self.marks) - 1)] == marks


def marks_of(langs: list[bytes], phrases: list[bytes]) -> np.ndarray:
    """Marks of space-joined phrases, the same as _Span's."""
    digest = xxhash.xxh3_64_intdigest
    words = [phrase.split(b" ") for phrase in phrases]
    out = np.fromiter(map(digest, langs), np.uint64, len(langs))
    for i in range(max(map(len, words), default=0)):
        has = np.flatnonzero([len(w) > i for w in words])
        out[has] = _mixed(out[has], np.fromiter((digest(words[at][i]) for at in has), np.uint64, len(has)))
    return out


class _Span:
    """The words of some texts: their numbers among the different words, languages, and where pieces end."""

    def __init__(self, data: bytes, starts: np.ndarray, langs: np.ndarray, names: list[bytes], owned: int):
        raw = np.frombuffer(data, np.uint8)
        inner = (raw != 32) & (raw != 10)
        edge = np.flatnonzero(np.diff(inner, prepend=False, append=False))
        first, last = edge[::2], edge[1::2]
        self.n, self.names = len(first), names
        self.lengths = last - first
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.letters = raw[inner]
        words = pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(self.offsets.astype(np.int32)), pa.py_buffer(self.letters)]).dictionary_encode()
        self.number = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = words.dictionary
        self.lang = langs[np.searchsorted(starts, first, side="right") - 1]
        piece = np.cumsum(raw == 10)[first] if self.n else np.zeros(0, np.int64)
        #: Whether the next word goes on in the same piece.
        self.goes_on = np.concatenate([piece[1:] == piece[:-1], [False]])[: self.n]
        self.owned = first < owned
        marks = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words.to_pylist()), np.uint64, len(self.words))
        heads = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
        self.word_mark, self.head = marks[self.number] if self.n else np.zeros(0, np.uint64), heads[self.lang]

    def whole(self, size: int) -> np.ndarray:
        """Whether so many words from each word on are of one piece."""
        if size == 1:
            return np.ones(self.n, bool)
        out = self.goes_on.copy()
        for i in range(1, size - 1):
            out[: self.n - i] &= self.goes_on[i:]
            out[self.n - i :] = False
        return out

    def marks(self, size: int, at: np.ndarray) -> np.ndarray:
        out = self.head[at]
        for i in range(size):
            out = _mixed(out, self.word_mark[at + i])
        return out

    def counted(self, size: int, frequent: Marks | None) -> tuple[np.ndarray, np.ndarray]:
        """The first place of each different phrase of size words that may be frequent, and its number of places."""
        use = self.whole(size)
        if size > 1:
            before = np.flatnonzero(self.whole(size - 1))
            good = np.zeros(self.n + 1, bool)
            marks, same = np.unique(self.marks(size - 1, before), return_inverse=True)
            good[before] = frequent.has(marks)[same]
            use = use & good[:-1] & good[1:]
        at = np.flatnonzero(use & self.owned)
        code, width = self.lang[at], max(1, len(self.words))
        for i in range(size):
            _, code = np.unique(code * width + self.number[at + i], return_inverse=True)
        _, where, uses = np.unique(code, return_index=True, return_counts=True)
        return at[where], uses

    def texts(self, size: int, at: np.ndarray) -> pa.Array:
        """The space-joined phrases that begin at these words."""
        lengths = self.offsets[at + size] - self.offsets[at] + size - 1
        ends = np.cumsum(lengths)
        out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
        base = ends - lengths
        for i in range(size):
            n = self.lengths[at + i]
            run = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(base, n) + run] = self.letters[np.repeat(self.offsets[at + i], n) + run]
            base = base + n + 1
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(out)]).cast(pa.string())


def _cuts(data: bytes, size: int, span: int) -> Iterator[tuple[int, int, int]]:
    """Parts of a text: begin, end, and the end of where phrases begin that are counted in this part."""
    at = 0
    while at < len(data):
        end = at + span
        if end < len(data):
            cut = data.find(b"\n", end - span // 8, end)
            if cut < 0:
                found = _SPACE.search(data, end)
                cut = found.start() if found else len(data)
            reach = cut
            for _, word in zip(range(size - 1), _WORD.finditer(data, cut)):
                reach = word.end()
            yield at, reach, cut - at
            at = cut
        else:
            yield at, len(data), len(data) - at
            at = len(data)


def _spans(batches: Iterator[pa.RecordBatch], size: int, span: int) -> Iterator[_Span]:
    """Texts, cleaned, put together up to span bytes; longer ones by parts."""
    held: list[tuple[bytes, bytes]] = []
    total = 0

    def together() -> _Span:
        names = sorted({lang for _, lang in held})
        at = {name: i for i, name in enumerate(names)}
        lengths = np.array([len(t) + 1 for t, _ in held])
        data = b"\n".join(t for t, _ in held)
        return _Span(data, np.cumsum(lengths) - lengths, np.array([at[lang] for _, lang in held]), names, len(data) + 1)

    for batch in bounded(batches):
        for text, lang in zip(as_bytes(batch.column("text")), as_bytes(batch.column("lang"))):
            data = text.translate(_CLEAN)
            if len(data) > span:
                for begin, end, owned in _cuts(data, size, span):
                    yield _Span(data[begin:end], np.zeros(1, np.int64), np.zeros(1, np.int64), [lang], owned)
                continue
            if held and total + len(data) > span:
                yield together()
                held, total = [], 0
            held.append((data, lang))
            total += len(data)
    if held:
        yield together()


COUNTS = "lang string, phrase string, f bigint"


def _pass(rows: DataFrame, size: int, frequent: object, span: int) -> DataFrame:
    """(lang, phrase, f) by span, for phrases that may be frequent; of size 1 with the number of all words, phrase null."""
    arrow = fields(COUNTS, rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = frequent.value if frequent else None
        for s in _spans(batches, size, span):
            at, uses = s.counted(size, marks)
            names = pa.array(s.names, pa.binary()).cast(pa.string())
            if len(at):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(s.lang[at])), s.texts(size, at), pa.array(uses, pa.int64())], schema=arrow)
            if size == 1:
                yield pa.RecordBatch.from_arrays([names, pa.nulls(len(names), pa.string()), pa.array(np.bincount(s.lang[s.owned], minlength=len(names)), pa.int64())], schema=arrow)

    return rows.mapInArrow(tidy(run), COUNTS)


def frequent_marks(level: DataFrame) -> Marks:
    """The marks of a level's phrases: at most SET_MARKS of 8 bytes, or a map of 2 ** MAP_BITS bits, whatever the level's size."""
    spark, arrow = level.sparkSession, fields("mark bigint", level.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found = marks_of(as_bytes(batch.column("lang")), as_bytes(batch.column("phrase")))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], schema=arrow)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(batch.column("mark")).tobytes()], pa.binary())], names=["marks"])

    marks = level.select("lang", "phrase").mapInArrow(tidy(run), "mark bigint")
    if level.count() <= SET_MARKS:
        blobs = [r["marks"] for r in marks.mapInArrow(packed, "marks binary").collect()]
        return Marks(np.unique(np.frombuffer(b"".join(blobs), np.uint64)))
    place = F.shiftrightunsigned("mark", 64 - MAP_BITS)
    blocks = marks.groupBy(F.shiftright(place, 15).alias("block")).agg(F.bitmap_construct_agg(place.bitwiseAND(0x7FFF)).alias("bits"))
    out = np.zeros((max(1, 1 << MAP_BITS - 15), 4096), np.uint8)
    for r in blocks.collect():
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return Marks(bits=out.ravel(), size=MAP_BITS)


def levels(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, span: int = SPAN) -> tuple[list[DataFrame], DataFrame]:
    """Written tables (lang, phrase, f) of the frequent phrases of 1, 2, ... words, and (lang, n) of all words."""
    spark = documents.sparkSession
    tune(spark)
    rows = documents.select("text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    out, sent = [], None
    for size in range(1, longest + 1):
        counted = _pass(rows, size, sent, span).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        level = written(counted.where((F.col("f") >= least) | F.col("phrase").isNull()), f"phrases-{size}")
        if sent:
            sent.destroy()
        if size == 1:
            totals = level.where("phrase is null").select("lang", F.col("f").alias("n"))
            level = level.where("phrase is not null")
        out.append(level)
        if size < longest:
            sent = spark.sparkContext.broadcast(frequent_marks(level))
    return out, totals


def scored(held: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more, at their lowest-scoring cut."""
    every = held[0]
    longer = held[1]
    for level in held[1:]:
        every = every.unionByName(level)
    for level in held[2:]:
        longer = longer.unionByName(level)
    words = longer.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = words.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    joined = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        part = every.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = spread_join(cuts, part, ["lang", side], ["phrase", "k"])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"top": whole("a") * F.lit(SCALE).cast("decimal(7,0)"), "bottom": whole("l") + whole("r")})
    lowest = cuts.select("lang", "phrase", "a", F.struct(F.expr("top div bottom").alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(held: list[DataFrame]) -> DataFrame:
    """(lang, phrase, most): of phrases of two words or more, the largest count of a longer one that they lie in."""
    parts_of = None
    for size, level in list(enumerate(held, 1))[2:]:
        w = F.split("phrase", " ")
        inner = F.array(*(F.array_join(F.slice(w, at, n), " ") for n in range(2, size) for at in range(1, size - n + 2)))
        found = level.select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f")
        parts_of = found if parts_of is None else parts_of.unionByName(found)
    return parts_of.groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, span: int = SPAN) -> DataFrame:
    """The contract's rows: each language's first phrases by score."""
    held, totals = levels(documents, least, span=span)
    part, whole = COVERED
    kept = scored(held).join(covered(held), ["lang", "phrase"], "left").where(F.coalesce(whole * F.col("most") < part * F.col("a"), F.lit(True))).drop("most")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's phrases are ranked in shares first, so that one task gets a bounded number of them.
    shares = min(512, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    share = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS k),
grams AS (
  SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g, k FROM words, sizes WHERE len(w) >= k),
counts AS MATERIALIZED (SELECT lang, g, k, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
frequent AS MATERIALIZED (SELECT lang, g, f FROM counts WHERE f >= 30),
candidates AS MATERIALIZED (SELECT lang, g, k, f, string_split(g, ' ') AS w FROM counts WHERE k > 1 AND f >= 30),
halves AS MATERIALIZED (
  SELECT c.lang, c.g, c.f AS a, s.k, array_to_string(c.w[1:s.k], ' ') AS x, array_to_string(c.w[s.k + 1:], ' ') AS y
  FROM candidates c JOIN sizes s ON s.k < c.k),
cuts AS (
  SELECT c.lang, c.g, c.a, c.k, l.f AS l, r.f AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score
  FROM halves c JOIN frequent l ON l.lang = c.lang AND l.g = c.x JOIN frequent r ON r.lang = c.lang AND r.g = c.y),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_parts AS (
  SELECT c.lang, c.f, array_to_string(c.w[i.k:i.k + s.k - 1], ' ') AS g
  FROM candidates c JOIN sizes s ON s.k > 1 AND s.k < c.k JOIN sizes i ON i.k + s.k - 1 <= c.k),
covers AS (SELECT lang, g, max(f) AS most FROM inner_parts GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.g)) AS rank
  FROM best b LEFT JOIN covers c ON c.lang = b.lang AND c.g = b.g WHERE c.most IS NULL OR 100 * c.most < 80 * a)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, g AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""
