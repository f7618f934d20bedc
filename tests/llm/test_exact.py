"""Operators whose results are exact, against plain brute force on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from claimlens.llm import decontaminate, neardup, packing, repeats, rules, store, suffixes, tokens

RNG = random.Random(11)
WORDS = ["".join(RNG.choices("abcdefgh", k=RNG.randint(2, 6))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choices(WORDS, k=n))


def odd_rows():
    base, passage = prose(140), prose(90)
    rows = [(0, None), (1, ""), (2, "  \n\t"), (3, "word"), (4, base), (5, base), (6, base + " tail"), (7, base.upper()), (8, prose(40) + passage + prose(40)), (9, prose(30) + passage), (10, "ab " * 600), (11, "é" * 500 + " ü"), (12, prose(3000)), (13, "x" * 5000), (None, base), (4, base), (4, "other text"), (15, "don't STOP 12 ² İΣ <|endoftext|>")]
    for i in range(20, 40):
        words = base.split()
        for _ in range(RNG.randint(1, 8)):
            words[RNG.randrange(len(words))] = RNG.choice(WORDS)
        rows.append((i, " ".join(words)))
    return rows


ROWS = odd_rows()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, row string, mark int")
    return df.withColumns({"lang": F.lit(None).cast("string"), "at": F.lit(2)}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def same(got, want):
    key = lambda r: tuple((x is None, x) if not isinstance(x, list) else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_suffix_array_and_common_prefixes():
    for text in (b"banana", b"aaaaaaaaaaaaaaaaaaaaa", bytes(RNG.choices(b"ab\0", k=300)), b"z"):
        data = np.frombuffer(text, np.uint8)
        order = suffixes.suffix_array(data)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        before, shared = suffixes.common_prefixes(data, order)
        for a, b in zip(order[1:].tolist(), order.tolist()):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert (before[a], shared[a]) == (b, n)


def cut_plainly(rows, window=400):
    seen = {}
    data = [(t or "").encode() for _, t in rows]
    for b in data:
        for i in range(len(b) - window + 1):
            seen[b[i : i + window]] = seen.get(b[i : i + window], 0) + 1
    out = []
    for (doc_id, _), b in zip(rows, data):
        hit = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                hit[i : i + window] = b"\1" * window
        kept = bytes(c for c, h in zip(b, hit) if not h)
        spans = sum(1 for i in range(len(b)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((doc_id, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("segments_in_a_shard", [2048, 3])
def test_repeats(docs, monkeypatch, segments_in_a_shard):
    """With few segments a shard, runs are cut and merged across shards."""
    monkeypatch.setattr(repeats, "SHARD_SEGMENTS", segments_in_a_shard)
    got = repeats.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    same(got, cut_plainly(ROWS))


def test_repeats_of_nothing(empty):
    assert repeats.remove_repeats(empty).count() == 0
    assert repeats.cut_passages(empty).count() == 0


def test_repeats_in_texts_of_several_pieces(spark, monkeypatch):
    """Texts over a buffer's bytes are cut into pieces; a hot window is in all segments of an anchor that many lots share."""
    long = "".join(RNG.choices("abcdefgh ", k=1_200_000))
    rows = [(1, long), (2, long[900_000:1_100_000] + "tail"), (3, "head" + long[5:800])]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_removed", "n_spans").collect()
    assert sorted(map(tuple, got)) == [(1, 200_795, 2), (2, 200_000, 1), (3, 795, 1)]
    monkeypatch.setattr(repeats, "SHARD_SEGMENTS", 2)
    passage = prose(80)
    rows = [(i, f"{prose(i % 7)} {passage} {prose(5)}") for i in range(40)]
    same(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), cut_plainly(rows))


def passages_plainly(rows, size):
    seen = {}
    data = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for w in data:
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])] = seen.get(tuple(w[i : i + size]), 0) + 1
    out = []
    for (doc_id, t), w in zip(rows, data):
        hit = [any(seen[tuple(w[i : i + size])] > 1 for i in range(max(0, j - size + 1), min(j, len(w) - size) + 1)) for j in range(len(w))]
        out.append((doc_id, t is None, [x for x, h in zip(w, hit) if not h]))
    return out


@pytest.mark.parametrize("segments_in_a_shard", [2048, 2])
def test_passages(spark, monkeypatch, segments_in_a_shard):
    monkeypatch.setattr(repeats, "SHARD_SEGMENTS", segments_in_a_shard)
    passage, short = prose(51), prose(50)
    rows = [(1, None), (2, ""), (3, passage), (3, "a " + passage + " b"), (None, prose(20) + " " + passage.replace(" ", "\n ")), (5, short + " x"), (6, "y " + short), (7, prose(300)), (8, "ab " * 120), (9, short + passage)]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, n_bytes string, k1 int")
    out = repeats.cut_passages(docs)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"] is None, (r["text"] or "").split()) for r in out.collect()]
    same(got, passages_plainly(rows, 51))


def test_repeats_among_other_columns(docs):
    odd = docs.withColumns({"n_bytes": F.lit(1), "k1": F.lit(2), "_k1": F.lit(3), "found": F.lit(4)})
    got = repeats.remove_repeats(odd)
    assert got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").count() == len(ROWS)
    assert {"k1", "_k1", "found"} <= set(got.columns) and len(got.columns) == len(set(got.columns))


def groups_plainly(rows):
    def shingled(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingled(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                comp[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    ids = [least.get(root(i)) for i in range(len(rows))]
    return [(d, len(s), c, not s or c is None or d == c) for (d, _), s, c in zip(rows, sets, ids)]


GROUPED = ["doc_id", "n_shingles", "component_id", "kept"]


def test_near_groups(docs):
    same(neardup.near_groups(docs).select(*GROUPED).collect(), groups_plainly(ROWS))


def test_near_groups_without_ids(spark):
    base, other = prose(40), prose(40)
    rows = [(5, base), (6, base), (None, base), (None, base + " word"), (None, other), (None, other + " word"), (None, None), (7, ""), (7, ""), (8, "w"), (8, "w")]
    docs = spark.createDataFrame([(*r, i, "x", 0) for i, r in enumerate(rows)], "doc_id long, text string, mark int, first string, _d int")
    same(neardup.near_groups(docs).select(*GROUPED).collect(), groups_plainly(rows))
    kept = neardup.keep_firsts(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == 6 and (5, base) in got and got.count((7, "")) == 2 and got.count((8, "w")) == 1 and (None, None) in got
    assert [t for d, t in got if d is None and t] in ([other], [other + " word"])


def near_pairs(n, rng=random.Random(3)):
    """Pairs of texts whose similarity is just 0.75, and just below it: 280 shingles each, 240 or 239 of them shared."""
    rows = []
    for i in range(n):
        words = [f"p{i}w{j}" for j in range(284)]
        cut = 40 if i % 2 else 41
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[cut:] + [f"q{i}w{j}" for j in range(cut)]))]
    return rows


def test_near_groups_at_the_threshold(spark):
    """Recall of the index where it is least, and exactness of the bound."""
    rows = near_pairs(400)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[2 * i + 1] == 2 * i for i in range(400)] == [bool(i % 2) for i in range(400)]


def test_near_groups_by_several_blocks(spark, monkeypatch):
    """A bucket of which the head is like none of the others: blocks of it are compared in full."""
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 300)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base + [f"x{i // 3}y{j}" for j in range(30 + i % 3)])) for i in range(60)]
    got = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).select(*GROUPED).collect()
    same(got, groups_plainly(rows))


def test_near_groups_whose_links_all_go_through_one(spark):
    base = prose(60).split()
    rows = [(100, " ".join(base))]
    for i in range(60):
        words = list(base)
        words[(7 * i) % 60] = f"new{i}"
        rows.append((i, " ".join(words)))
    same(neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).select(*GROUPED).collect(), groups_plainly(rows))


def test_near_groups_of_nothing(empty):
    assert neardup.near_groups(empty).count() == 0


ITEMS = [(1, ROWS[8][1][40:300]), (2, "short item here"), (3, None), (4, prose(30)), (1, "word"), (None, ROWS[12][1][100:260]), (7, "...")]


def near_plainly(rows, items, words, reach=3):
    """Names of the items of which some window's words all lie, as often as there, within so many words and a few more, by row."""
    data = [words(t) for _, t in rows]
    out = [set() for _ in rows]
    for item, x in items:
        v = words(x)
        for i in range(max(1, len(v) - 12) if v else 0):
            win = v[i : i + 13]
            need, width = Counter(win), len(win) + reach
            for found, w in zip(out, data):
                if need.keys() <= set(w) and any(not need - Counter(w[max(0, s) : s + width]) for s in range(-width, len(w))):
                    found.add("null" if item is None else str(item))
    return out


def hits_plainly(rows, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    out = []
    for (doc_id, t), near in zip(rows, near_plainly(rows, items, words)):
        w, hit, found = words(t), set(), set()
        for item, x in items:
            v = words(x)
            n = min(13, len(v))
            for i in range(len(v) - n + 1 if v else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add("null" if item is None else str(item))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(near), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_near_is_tight(spark):
    """Terms spread over more words than a window and SLOP aren't near, nor is a term that the window has twice and the text once."""
    item = [f"t{i}" for i in range(13)]
    gaps = lambda n: " ".join(x for i, t in enumerate(item) for x in ([t] + ["gap"] * (i < n)))
    wide = " ".join(f"{t} gap gap" if i % 2 else t for i, t in enumerate(item))
    rows = [(1, gaps(3)), (2, gaps(4)), (3, wide), (4, " ".join(reversed(item))), (5, " ".join(item[:12])), (6, "b a a c"), (7, "a b c"), (8, "a b x x x c a"), (9, "a b x x x x c a"), (10, "b c a a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame([(1, " ".join(item)), (2, "a b c a")], "item_id long, text string")
    near = {r["doc_id"]: r["near"] for r in decontaminate.find(docs, tests).collect()}
    assert {k for k, v in near.items() if v == ["1"]} == {1, 4} and {k for k, v in near.items() if v == ["2"]} == {6, 8, 10}


@pytest.mark.parametrize("words_in_a_slice", [1_000_000, 30])
def test_contamination(spark, docs, monkeypatch, words_in_a_slice):
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", words_in_a_slice)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    same(decontaminate.contamination(docs, items).collect(), hits_plainly(ROWS, ITEMS))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x gamma beta alpha y"), (2, "alpha " + "z " * 30 + "beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    got = {r["doc_id"]: (r["items"], r["near"]) for r in decontaminate.find(docs, items, slop=2).collect()}
    assert got == {1: ([], ["9"]), 2: ([], [])}


def test_index_is_read_a_few_segments_at_once(spark):
    """A task that reads the index holds a row group of it; segments have megabytes."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["a", "b", "cc", "dd", "eee"], k=300_000))) for i in range(20)]
    segments = decontaminate.index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    groups = [m.row_group(i) for f in segments.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == segments.count() > 4
    assert max(g.total_byte_size for g in groups) < 32 << 20 < sum(g.total_byte_size for g in groups)


def test_keep_clean_goes_by_row(spark):
    passage = prose(30)
    rows = [(1, passage), (1, prose(50)), (None, passage + " a"), (None, prose(40)), (2, None), (3, prose(5))]
    docs = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "doc_id long, text string, mark string, seg int")
    out = decontaminate.keep_clean(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert out.columns == docs.columns and sorted(r["seg"] for r in out.collect()) == [1, 3, 4, 5]


def test_contamination_without_items(docs, spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, items).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, items).count() == 0


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return [e.ids for e in t.encode_batch([x or "" for _, x in ROWS], add_special_tokens=False)]


def test_encoder_is_the_tokenizer(ids):
    assert [x.tolist() for x in tokens.encoder(tokens.default_path()).encode([x or "" for _, x in ROWS])] == ids


def test_encoder_keeps_pieces_that_recur(monkeypatch):
    # Odd texts in small batches, with room for few pieces: the tokenizer's own ids, and a batch's new pieces go to it at once.
    chars = "abcstmdrevl''''  \n\t019 !$É×÷ßÿÄñ.<|"
    odd = ["".join(RNG.choices(chars, k=RNG.randint(0, 60))) for _ in range(2000)]
    odd = ["", " ", *odd, "'", "x's's'll'rex", "''s", "a" * 5000, "<|endoftext|>", "日本 it's", "é" * 3000]
    own = tokens.Encoder(tokens.default_path())
    wanted = [e.ids for e in own.tokenizer.encode_batch(odd, add_special_tokens=False)]
    for most, size in ((tokens.KEPT_PIECES, tokens.KEPT_BYTES), (400, 1 << 20), (3, 1 << 20), (400, 20)):
        monkeypatch.setattr(tokens, "KEPT_PIECES", most)
        monkeypatch.setattr(tokens, "KEPT_BYTES", size)
        own._keep([], tokens.NONE, tokens.NONE)
        assert [x.tolist() for i in range(0, len(odd), 16) for x in own.encode(odd[i : i + 16])] == wanted
        assert len(own.numbers) <= most

    asked, learn = [], own._learn
    monkeypatch.setattr(tokens, "KEPT_PIECES", 100)
    monkeypatch.setattr(tokens, "KEPT_BYTES", 1 << 20)
    monkeypatch.setattr(own, "_learn", lambda: asked.append(list(own.numbers)[len(own.bounds) - 1 :]) or learn())
    monkeypatch.setattr(own, "model", None)  # a piece by itself would ask the model
    own._keep([], tokens.NONE, tokens.NONE)
    common, rare = [f"often{c}" for c in "abcdefghij"], iter(f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx")
    for _ in range(40):
        own.encode([" ".join([*common, *(next(rare) for _ in range(12))])])
    assert sum(b"oftena" in x for x in asked) == 1 and len(asked) == 40


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_store_round_trip(spark, docs, ids, tmp_path):
    path = f"file://{tmp_path}/store"
    store.write(docs, path)
    rows = store.read_checksums(spark, path).orderBy("start").collect()
    at = 0
    for r in rows:
        assert r["start"] == at and r["verified"]
        at += r["n_tokens"]
    keys = [r["doc_id"] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    same([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows], [(d, len(i) + 1, crc([*i, 2])) for (d, _), i in zip(ROWS, ids)])
    same([(r["doc_id"], list(r["ids"])) for r in store.read_ids(spark, path).collect()], [(d, [*i, 2]) for (d, _), i in zip(ROWS, ids)])
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert store.broken(spark, path).count() == 0
    # A node that doesn't hold what the recipes give leaves its documents unverified.
    kept = spark.read.parquet(f"{path}/manifest").collect()
    spark.createDataFrame([(r["node"], r["digest"][::-1], r["level"]) for r in kept], "node bigint, digest string, level int").write.mode("overwrite").partitionBy("level").parquet(f"{path}/manifest")
    assert {r["verified"] for r in store.read_checksums(spark, path).collect()} == {False} and store.broken(spark, path).count() == len(kept)


def test_store_of_nothing(spark, empty, tmp_path):
    store.write(empty, f"file://{tmp_path}/store")
    assert store.read_checksums(spark, f"file://{tmp_path}/store").count() == 0


def test_store_of_several_levels(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "SPAN", 16)
    monkeypatch.setattr(store, "FAN", 3)
    path = f"file://{tmp_path}/store"
    store.write(spark.createDataFrame([(i, prose(6)) for i in range(60)], "doc_id long, text string"), path)
    assert store._depth(spark, path) > 2 and {r["verified"] for r in store.read_checksums(spark, path).collect()} == {True}


def test_joined_crc():
    parts = [b"", b"abc", bytes(1000), b"z" * 77]
    assert store.joined_crc([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(b"".join(parts))


def test_cuts_follow_the_contents():
    ids = np.random.default_rng(1).integers(0, 49_000, 20_000).astype("<u4")
    one, two = (set(np.array(store.cuts(x))[::-1] - len(x)) for x in (ids, ids[777:]))
    assert store.cuts(ids)[-1] == len(ids) and len(one & two) > 0.9 * len(two)


def test_packing(docs, ids):
    got = packing.pack(docs, length=256).collect()
    want = []
    for (d, _), i in zip(ROWS, ids):
        i = [*i, 1]
        want += [(d, k, 256 * k, len(i[256 * k : 256 * (k + 1)]), crc(i[256 * k : 256 * (k + 1)])) for k in range(-(-len(i) // 256))]
    same([tuple(r)[:5] for r in got], want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 256
    assert len(by) <= 1.1 * sum(n for places in by.values() for _, n in places) / 256 + 2


def test_packing_of_nothing(empty):
    assert packing.pack(empty).count() == 0


def test_rules_in_any_order(docs):
    got = rules.cascade(docs, report=True).collect()
    other = rules.cascade(docs, rules=rules.RULES[::-1], report=True).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["word_chars"])
    assert [tuple(r)[:8] for r in sorted(got, key=key)] == [tuple(r)[:8] for r in sorted(other, key=key)]
    assert all(not r["kept"] for r in got if r["base_failed"])
