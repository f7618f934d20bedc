"""Phrases, the metric-space join and whitening, against plain brute force on small tables with odd rows."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import phrases, regions, whitening
from claimlens.llm.common import spread_join
from claimlens.llm.neardup import shingles

RNG = random.Random(5)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_phrases(rows, least, top):
    """The contract's rule, word by word."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    out = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang, p] = (score, a, f[lang, p[:k]], f[lang, p[k:]])
    long = [(lang, p, v[1]) for (lang, p), v in out.items()]
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    kept = [(lang, p, v) for (lang, p), v in out.items() if not any(g == lang and len(q) > len(p) and 100 * b >= 80 * v[1] and inside(p, q) for g, q, b in long)]
    rows = []
    for lang in {k[0] for k in kept}:
        mine = sorted((k for k in kept if k[0] == lang), key=lambda k: (-k[2][0], -k[2][1], " ".join(k[1]).encode()))
        rows += [(lang, i, " ".join(p), a, l, r, n[lang], s) for i, (_, p, (s, a, l, r)) in enumerate(mine[:top], 1)]
    return sorted(rows)


WORDS = ["a", "B", "Zé", "\x00x", "ünd", "d-d", "#", "and", "of", "\u2028"]


def texts():
    out = [(None, "a b a b, a b. " * 9), ("und", "a b"), ("en", None), ("en", ""), ("en", " \t\n.,"), (None, None)]
    for i in range(60):
        seps = [" ", " ", " ", "  ", "\t", ", ", "\n", "\x0b", "."]
        out.append((RNG.choice(["en", "de", None]), "".join(RNG.choice(WORDS) + RNG.choice(seps) for _ in range(RNG.randint(1, 90)))))
    return out


@pytest.mark.parametrize("span,marks", [(1 << 20, 1 << 20), (64, 1 << 20), (200, 0)])
def test_phrases(spark, monkeypatch, span, marks):
    monkeypatch.setattr(phrases, "SET_MARKS", marks)
    monkeypatch.setattr(phrases, "MAP_BITS", 18)
    rows = texts()
    docs = spark.createDataFrame([(g, t, "x", 1) for g, t in rows], "lang string, text string, phrase string, f int").repartition(3)
    got = [tuple(r) for r in phrases.collocations(docs, least=3, top=40, span=span).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    want = plain_phrases(rows, 3, 40)
    assert len(want) > 60 and sorted(got) == want


def test_phrase_map_has_every_mark():
    found = phrases.marks_of([b"en", b"en", b"de"], [b"a b", b"a", b"a b"])
    assert len(set(found.tolist())) == 3
    bits = np.zeros(1 << 9, np.uint8)
    for m in (found[:2] >> np.uint64(64 - 12)).tolist():
        bits[m >> 3] |= 1 << (m & 7)
    assert phrases.Marks(bits=bits, size=12).has(found).tolist() == [True, True, False]
    assert phrases.Marks(np.sort(found[:2])).has(found).tolist() == [True, True, False]
    assert not phrases.Marks(np.zeros(0, np.uint64)).has(found).any()


def test_phrase_scores_are_exact_beyond_64_bits(spark):
    """2000000 * a and l + r pass 64 bits."""
    a, l, r = 4 * 10**18 + 7, 9 * 10**18 + 1, 9 * 10**18 + 3
    one = spark.createDataFrame([("x", "p", l), ("x", "q", r)], phrases.COUNTS)
    two = spark.createDataFrame([("x", "p q", a)], phrases.COUNTS)
    none = one.limit(0)
    assert [tuple(t) for t in phrases.scored([one, two, none, none]).collect()] == [("x", "p q", a, l, r, 2_000_000 * a // (l + r))]


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([("x", None), (None, "a b")], "lang string, text string")).count() == 0


def test_spread_join(spark):
    facts = spark.range(3000).select(F.when(F.col("id") < 2500, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("lots"))
    held = spark.createDataFrame([(1, "x"), (2600, "y"), (9, "z")], "k long, mark string")
    for how in ("inner", "left"):
        got = spread_join(facts, held, ["k"], ["lots"], lot=100, how=how)
        assert got.columns == ["k", "lots", "mark"]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, facts.join(held, "k", how).collect()))


def prose(n):
    return [f"w{RNG.randrange(5000)}" for _ in range(n)]


def changed(words, times):
    words = list(words)
    for _ in range(times):
        words[RNG.randrange(len(words))] = f"c{RNG.randrange(10**6)}"
    return words


def groups():
    """Copies, chains, stars, hubs that differ by just about the threshold, short and odd texts."""
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one two three"), (7, "one  two\nthree"), (8, "one two three four"), (None, "one"), (None, None), (5, "one two"), (9, "é É"), (10, "é é")]
    for size in (30, 31, 60, 100, 150, 400):
        base = prose(size)
        for _ in range(25):
            rows.append((len(rows) + 20, " ".join(changed(base, RNG.randint(0, max(1, size // 25))))))
        step = base
        for _ in range(8):  # a chain
            step = changed(step, max(1, size // 70))
            rows.append((len(rows) + 20, " ".join(step)))
        rows += [(len(rows) + 21, " ".join(base[: size - size // 11])), (len(rows) + 22, " ".join(base + prose(size // 10)))]
    RNG.shuffle(rows)
    return rows


def plain_links(rows):
    sets = []
    for _, text in rows:
        words = [w for w in re.split("[ \t-\r]+", lowered(text)) if w]
        sets.append({tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {tuple(words)} if words else set())
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    n = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
                n += 1
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(s), least.get(root(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))], n


def key(r):
    return tuple((x is None, x or 0) for x in r)


ROWS = groups()


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 6, "LEGS": 4, "PIVOTS": 3}, {"BLOCK": 5, "BLOCK_ITEMS": 60, "SMALLER": 0.1, "DEPTH": 1}])
def test_metric_join(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(regions, name, value)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, row string, b int").repartition(3)
    want, links = plain_links(ROWS)
    assert links > 300
    assert sorted((tuple(r) for r in regions.linked_groups(docs).collect()), key=key) == sorted(want, key=key)


def test_linked_sets_share_a_pivot():
    """Every pair at the threshold or above lies on a common pivot, in all bands and next to their edges."""
    rng = np.random.default_rng(3)
    for n in [*range(1, 60), 100, 101, 113, 170, 171, 400, 999, 3000]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            off = regions.differing(len(a))
            cut = int(rng.integers(0, off + 1))
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 63, off - cut, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                assert len(np.intersect1d(regions.pivots(a), regions.pivots(b)))


def test_distance_by_differences():
    a, b, c = (shingles(" ".join(prose(80)).encode(), 3) for _ in range(3))
    b = np.unique(np.concatenate([b, a[:50]]))
    x, y = regions.difference(c, a), regions.difference(c, b)
    assert len(regions.difference(x, y)) == len(a) + len(b) - 2 * len(np.intersect1d(a, b))


def test_no_documents_to_join(spark):
    assert regions.linked_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sql_of_metric_join(spark):
    """Also on rows whose ids repeat not."""
    rows = [(i, t) for i, (_, t) in enumerate(ROWS)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = con.sql(f"SELECT doc_id, n_shingles, component_id FROM ({regions.SQL})").fetchall()
    assert sorted(got) == sorted(plain_links(rows)[0])


def vectors(n, dim, rng):
    mix = rng.normal(size=(dim, dim))
    return (rng.normal(size=(n, dim)) @ mix).astype(np.float32)


def check_whitening(rows, table):
    """rows: of the operator; table: (vec_id, vector) that count."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in table])
    n, dim = x.shape
    total = [sum(int(e) for e in col) for col in x.T]
    centred = x - np.array(total) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    given = min(32, dim)
    assert len(rows) == n * given
    white = np.zeros((n, given))
    at = {i: k for k, (i, _) in enumerate(table)}
    for r in rows:
        white[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - t) ** 2 for a, t in zip(x[at[r["vec_id"]]], total))
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
    want = centred @ axes[:, :given] / np.sqrt(values[:given])
    assert np.allclose(np.abs(white), np.abs(want), atol=1e-6)
    assert np.allclose(np.abs(white.T @ want / n), np.eye(given), atol=1e-6)


@pytest.mark.parametrize("dim,parts,fan", [(5, 1, 8), (40, 7, 2), (3, 30, 3)])
def test_whitening(spark, monkeypatch, dim, parts, fan):
    monkeypatch.setattr(whitening, "FAN", fan)
    rng = np.random.default_rng(dim)
    good = [(i, [float(c) for c in v]) for i, v in enumerate(vectors(300, dim, rng))]
    odd = [(900, None), (901, []), (902, [1.0] * (dim - 1) + [None]), (903, [float("nan")] * dim), (904, [float("inf")] * dim), (905, [1.0] * (dim + 2)), (906, [1e30] * dim)]
    rows = good + odd
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, component int").repartition(parts)
    check_whitening(whitening.whitened(df).collect(), good)


def test_merges_lose_nothing():
    """A merge of states is the state of all rows, with more dimensions than rows, too."""
    rng = np.random.default_rng(9)
    for dim, sizes in ((6, (50, 3)), (20, (4, 7)), (4, (1, 1))):
        x = [np.floor(64 * vectors(n, dim, rng)).astype(np.int64) + whitening.OFFSET for n in sizes]
        a, b = (whitening.fold(None, y) for y in x)
        one, every = whitening.merge(a, b), np.vstack(x) - whitening.OFFSET
        centred = every - every.mean(0)
        assert one.n == sum(sizes) and one.total == np.vstack(x).sum(0).tolist()
        assert np.allclose(one.rows.T @ one.rows, centred.T @ centred, atol=1e-6)
        folded = whitening.fold(whitening.fold(None, x[0]), x[1])
        assert np.allclose(folded.rows.T @ folded.rows, centred.T @ centred, atol=1e-6)


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0, float(i % 2)]) for i in range(8)], "vec_id long, embedding array<double>")
    rows = whitening.whitened(same).collect()
    assert len(rows) == 24 and all((r["whitened"] is None) == (r["component"] > 1) for r in rows)
    assert {round(r["explained"], 12) for r in rows} == {0.0, 1.0} and all(r["identity_error"] < 1e-9 for r in rows)
    single = whitening.whitened(same.limit(1)).collect()
    assert [(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in single] == [(None, 0.0, 0, 0.0)] * 3
    assert whitening.whitened(same.limit(0)).count() == 0


def test_deviations_beyond_64_bits():
    x = np.array([[whitening.OFFSET + 3, whitening.OFFSET], [whitening.OFFSET + 10**9, whitening.OFFSET]])
    n, total = 10**9, [10**9 * whitening.OFFSET, 10**9 * whitening.OFFSET + 1]
    assert whitening.deviations(x, n, total) == [(3 * n) ** 2 + 1 if (3 * n) ** 2 + 1 < 1 << 63 else None, None]
