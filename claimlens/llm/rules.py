"""[5] Quality rules as a short-circuit cascade, ordered by rejections per cost.

A rule is a test of a text's facts; facts are worked out when a rule first asks for them and kept for the rule
after it.  On a sample of at most SAMPLE rows each rule is timed and its rejections counted; the cascade runs
the rules by rejections per second, highest first, and stops at a text's first rejection.  The order changes the
cost, never the verdict.  Null texts have no words, and so fail the first base rule.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, per_batch, tune

#: Rows on which costs and rejections are estimated.
SAMPLE = 2000
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


class Facts:
    """A text's facts, each worked out once and only if asked for."""

    def __init__(self, text: bytes) -> None:
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip(b" \t\n\v\f\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < WINDOW + 1:
            return 0
        codes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, n)
        h = np.zeros(n - WINDOW + 1, np.uint64)
        for i in range(WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : n - WINDOW + 1 + i]
            h ^= h >> np.uint64(32)
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        if not same.any():
            return 0
        change = np.zeros(n + 1, np.int64)
        hit = np.zeros(len(h), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        at = np.flatnonzero(hit)
        np.add.at(change, at, 1)
        np.add.at(change, at + WINDOW, -1)
        return int((np.cumsum(change) > 0).sum())

    @cached_property
    def capitals(self) -> tuple[int, int]:
        a = np.bincount(np.frombuffer(self.text, np.uint8), minlength=128)
        return int(a[65:91].sum()), int(a[97:123].sum())


#: A rule's name and when it rejects.
Rule = tuple[str, Callable[[Facts], bool]]
BASE: list[Rule] = [
    ("few_words", lambda f: f.n_words < 10),
    ("repeats", lambda f: 100 * f.n_repeat_words > 20 * f.n_words),
]
RULES: list[Rule] = [
    *BASE,
    ("symbols", lambda f: 100 * f.n_symbols > 15 * f.n_words),
    ("same_lines", lambda f: 100 * f.n_dup_lines > 30 * len(f.lines)),
    ("word_length", lambda f: f.word_chars > 20 * f.n_words or f.word_chars < 2 * f.n_words),
    ("capitals", lambda f: 100 * f.capitals[0] > 40 * sum(f.capitals)),
]


def order_rules(documents: DataFrame, rules: list[Rule] = RULES) -> list[str]:
    """Rule names by rejections per second on a sample, each rule measured on its own."""
    n = documents.count()
    sample = documents.select("text").sample(fraction=min(1.0, 0.9 * SAMPLE / max(n, 1)), seed=5).limit(SAMPLE)

    def measure(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"rule": [], "seconds": [], "rejected": []}
        texts = as_bytes(batch.column("text"))
        for name, rejects in rules:
            began, n = time.perf_counter(), sum(rejects(Facts(t)) for t in texts)
            for k, v in (("rule", name), ("seconds", time.perf_counter() - began), ("rejected", n)):
                out[k].append(v)
        return out

    told = per_batch(sample, "rule string, seconds double, rejected bigint", measure)
    rate = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in told.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect()}
    return sorted((name for name, _ in rules), key=lambda name: -rate.get(name, 0.0))


def cascade(documents: DataFrame, rules: list[Rule] = RULES, report: bool = False) -> DataFrame:
    """doc_id, kept, and the rule that rejected it, if any; with report also all base facts of every text."""
    tune(documents.sparkSession)
    order = order_rules(documents, rules)
    by_name = dict(rules)
    tests = [(name, by_name[name]) for name in order]
    facts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") if report else ()

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in (*facts, "base_failed", "kept", "rejected_by")}
        for text in as_bytes(batch.column("text")):
            own = Facts(text)
            why = next((name for name, rejects in tests if rejects(own)), None)
            out["kept"].append(why is None)
            out["rejected_by"].append(why)
            for k in facts:
                out[k].append(getattr(own, k))
            out["base_failed"].append(any(rejects(own) for _, rejects in BASE) if report else None)
        return {"doc_id": batch.column("doc_id"), **out}

    schema = "doc_id bigint, " + "".join(f"{k} bigint, " for k in facts) + "base_failed boolean, kept boolean, rejected_by string"
    out = per_batch(documents.select("doc_id", "text"), schema, work)
    return out if report else out.drop("base_failed")


def query(spark, sf_dir: str) -> DataFrame:
    return cascade(spark.read.parquet(f"{sf_dir}/documents.parquet"), report=True).drop("rejected_by")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY 1),
facts AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^a-z]', '', 'g')) AS low
  FROM w LEFT JOIN rep USING (doc_id)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM facts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 15 * n_words OR 100 * n_dup_lines > 30 * n_lines
    OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR 100 * up > 40 * (up + low)) AS kept
FROM base
"""
