"""Small cases of the operators: nulls, ties, empty input, and values worked out by hand."""

import random
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.fixed import DATA_SIGNALS, LABELS, SOURCE_SIGNALS, WHITE_SPACE
from claimlens.functions import similarity as S
from claimlens.functions import text as T
from claimlens.operators import cache, evaluate, evolve, publish, rubric
from claimlens.settings import Settings, read_env, settings


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


VECTORS = [
    ([], ("Unverifiable", "Low", 0.0, 0.0, None)),
    ([("Established", True, "0.8")] * 3, ("True", "Medium", 1.68, 0.0, "Established")),
    ([("Established", False, "0.8")] * 3, ("False", "Medium", 0.0, 1.68, "Established")),
    ([("Government", False, "0.8"), ("Other", True, "0.8")], ("False", "Medium", 0.32, 0.8, "Government")),
    ([("Government", True, "0.8"), ("Wire", True, "0.8"), ("Established", True, "0.8")], ("True", "High", 2.04, 0.0, "Government")),
    ([("Other", True, "0.3")], ("True", "Low", 0.12, 0.0, "Other")),
    ([("Other", None, "0.5")], ("Misleading", "Low", 0.0, 0.0, "Other")),
]


@pytest.mark.parametrize("rows, expected", VECTORS)
def test_rubric(spark, rows, expected):
    claims = spark.createDataFrame([(1,)], "claim_id long")
    evidence = spark.createDataFrame([(1, *r) for r in rows], "claim_id long, source_tier string, supports_claim boolean, r string").withColumn("relevance_score", F.col("r").cast("decimal(3,1)"))
    r = rubric.rubric(claims, evidence).first()
    assert (r["label"], r["confidence"], round(r["support_weight"], 6), round(r["contradict_weight"], 6), r["best_tier"]) == expected


def test_text(spark):
    assert one(spark, "1\n00:00:00,000 --> 00:00:05,000\nHello there.\n", T.strip_subtitles).strip() == "Hello there."
    assert one(spark, "a\r\n\r\n\r\n\r\nb ", T.normalise_space) == "a\n\nb"
    assert one(spark, "One two three four five.", T.word_count) == 5
    assert str(one(spark, "delivered on January 20, 2025. ok", T.find_date)) == "2025-01-20"
    assert one(spark, "no date", T.find_date) is None
    assert one(spark, "<script>x</script><p>a &amp; b</p>", T.html_text) == "a &amp; b"
    assert one(spark, "<script>", T.escape_html) == "&lt;script&gt;"
    assert one(spark, "foreign_policy x-ray", T.title_case) == "Foreign_Policy X-Ray"
    assert one(spark, "  Hello ", T.cache_key) == "2cf24dba5fb0a30e"
    assert one(spark, "https://www.bls.gov/x", T.tier_of) == "Government"
    assert one(spark, "https://randomsite.com", T.tier_of) == "Other"
    assert one(spark, "the unemployment rate", T.series_of) == "UNRATE"
    assert one(spark, "a state dinner", T.series_of) is None


def test_subsequence_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc d", k=rng.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert S.subsequence(a, b) == table[-1][-1]


def test_fuzzy_cache_equals_all_pairs(spark):
    rng = random.Random(2)
    words = ["tax", "jobs", "rise", "fell", "rate", "egg", "price", "the", "down"]
    texts = [" ".join(rng.choices(words, k=rng.randint(2, 6))) for _ in range(60)] + ["", "ÄÖ"]
    claims = spark.createDataFrame(list(enumerate(texts)), "claim_id long, text string")
    entries = [(f"k{i}", t[:-1] + "s" if t else t, i) for i, t in enumerate(texts[::2])]
    held = spark.createDataFrame(entries, "key string, text string, s long").select("key", "text", F.timestamp_seconds("s").alias("cached_at"), F.when(F.col("s") % 5 == 0, F.timestamp_seconds(F.lit(0))).alias("expires_at"))
    got = {r["claim_id"]: (r["key"], r["score"]) for r in cache.fuzzy(claims, held, F.current_timestamp()).collect()}
    want = {}
    for i, t in enumerate(texts):
        best = max(((S.token_sort(t, u), -s, k) for k, u, s in entries), default=None)
        if best and best[0] >= 85 and -best[1] % 5:
            want[i] = (best[2], best[0])
    assert got == want


def test_fuzzy_cache_query_has_all_turns(spark, tmp_path):
    from claimlens.plans import catalogue

    rng = random.Random(3)
    long = " ".join(rng.choices(["tax", "jobs", "rise", "price", "down"], k=120))
    texts = ["only once told", "odd turns meet here", "", long, long + "x", "meet here odd turns", "Only once told ", long[1:], None, "odd turn meets here"]
    turns = [(i // 4 + 1, 2 * (i % 4) + 1, t) for i, t in enumerate(texts)] + [(9, 0, "an even turn"), (0, 2, long + "y")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    keys = {r["text"]: r["key"] for r in spark.createDataFrame([(t,) for _, _, t in turns], "text string").select("text", T.cache_key(F.col("text")).alias("key")).collect()}
    first = {}
    for conv, _, t in turns:
        first[keys[t]] = min(first.get(keys[t], (conv, t)), (conv, t), key=lambda x: x[0])
    want = {}
    for conv, turn, t in turns:
        score, _, key = max((S.token_sort(t, u), -at, k) for k, (at, u) in first.items())
        if score >= 85:
            want[f"{conv}:{turn}"] = (key, score)
    got = {r["claim_id"]: (r["key"], r["score"]) for r in catalogue.QUERIES["cache_fuzzy"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 10


def test_agreement(spark):
    for gold, label, score in (("TRUE", "True", 1.0), ("TRUE", "Mostly True", 0.8), ("FALSE", "Misleading", 0.6), ("TRUE", "False", 0.0), ("UNSUPPORTED", "Unverifiable", 1.0), ("FALSE / MISLEADING", "Misleading", 1.0), ("TRUE", "odd", 0.2)):
        assert spark.range(1).select(evaluate.agreement(F.lit(gold), F.lit(label)).alias("s")).first()["s"] == pytest.approx(score)


def test_posts_are_short(spark):
    rows = spark.createDataFrame([("word " * 200, "e" * 200)], "c string, e string")
    for label, *_ in LABELS:
        post = rows.select(publish.verdict_post(F.col("c"), F.lit(label), F.lit("High"), F.col("e")).alias("p")).first()["p"]
        assert len(post) <= 300 and "…" in post


def test_breeding_keeps_elites_and_ranges(spark):
    scored = evolve.seeded(spark, 8, seed=1).withColumn("fitness", F.col("slot") / 10.0)
    rows = evolve.breed(scored, 1, seed=1).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(8))
    best = scored.where("slot = 7").first()
    assert all(rows[0][g] == best[g] for g in evolve.GENES)
    assert all(0 <= r[g] < evolve.SIZES[g] for r in rows for g in evolve.GENES)
    again = evolve.breed(scored.repartition(5), 1, seed=1).orderBy("slot").collect()
    assert rows == again


def test_empty_tables(spark):
    assert rubric.rubric(spark.createDataFrame([], "claim_id long"), spark.createDataFrame([], "claim_id long, source_tier string, supports_claim boolean, relevance_score decimal(3,1)")).count() == 0


def test_pages_count_from_one(spark):
    with pytest.raises(ValueError):
        publish.page(spark.range(1), 0, 10)


def test_event_stream(spark, tmp_path):
    from claimlens.streaming.events import counted, read_events

    schema = "event_id long, ts timestamp, event_type string, props string"
    spark.sql("SELECT 1L event_id, timestamp'2024-01-01 00:10:00' ts, 'a' event_type, '{}' props UNION ALL SELECT 2L, timestamp'2024-01-01 03:10:00', 'a', '{}'").write.parquet(f"{tmp_path}/in")
    run = counted(read_events(spark, f"{tmp_path}/in", schema)).writeStream.format("memory").queryName("seen").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("seen").count() == 2


def test_combined_match_is_brute_force(spark, monkeypatch):
    gold = [(1, "jobs grew last year"), (2, "the deficit fell"), (3, ""), (4, None), (5, "prices rose and rose")]
    found = [(0, "last year jobs grew"), (1, "jobs grew last year"), (2, "deficits fall"), (3, None), (4, ""), (5, "rose prices")]
    monkeypatch.setattr(evaluate, "GOLD_BLOCK", 2)
    rows = evaluate.best_match(spark.createDataFrame(gold, "ref_id int, claim string"), spark.createDataFrame(found, "pos int, text string"), combined=True).collect()

    def alike(a, b):
        x, y = set((a or "").split()), set((b or "").split())
        return (len(x & y) / len(x | y) + S.token_set(a, b) / 100) / 2 if x and y else 0.0

    for ref, claim in gold:
        best = max(found, key=lambda f: (alike(claim, f[1]), -f[0]))
        got = next(r for r in rows if r["ref_id"] == ref)
        top = alike(claim, best[1])
        assert got["similarity"] == pytest.approx(top) and got["matched_claim"] == (best[1] if top > 0 else None)


def test_report_text(spark):
    reports = spark.sql("SELECT 1 AS report_id, 'Ann' AS speaker, DATE'2025-01-20' AS date, 'Hall' AS venue UNION ALL SELECT 2, 'Bo', NULL, ''")
    verdicts = spark.createDataFrame([(1, 8, 2, "False", "Low", "no"), (1, 7, 1, "True", "High", "yes")], "report_id int, claim_id int, pos int, label string, confidence string, explanation string")
    told = {r["report_id"]: r["text"] for r in publish.report_text(reports, verdicts, spark.createDataFrame([(7, "It rose.")], "claim_id int, text string")).collect()}
    assert told[1] == "Fact-check report for Ann\nDate: January 20, 2025\nVenue: Hall\n\n[True] It rose.\n  Confidence: High\n  yes\n\n[False] (claim not found)\n  Confidence: Low\n  no\n"
    assert told[2] == "Fact-check report for Bo\n"


def test_shorten_as_the_standard_library(spark):
    """Breaks where textwrap breaks: at spaces, dashes between words and hyphens between letters."""
    rng = random.Random(4)
    parts = ["a", "well-known", "long-term", "x-", "-y", "--", "a--b", "e-mail", "3-4", "co-op-ed", "é-ü", "don't--no", "(semi-)open", "-", "Zoë", "w" * 30, "aa-" * 9 + "bb", "ab-cd", "\t", "\n", "  ", "\u00a0", "½-x", "A-B-C-DD"]
    rows = [("a well-known long-term plan of the state", w) for w in range(5, 45)] + [("hello", 1), ("", 5), ("  ", 5), ("x" * 50, 20)]
    rows += [(" ".join(rng.choices(parts, k=rng.randint(1, 9))), rng.randint(3, 40)) for _ in range(600)]
    df = spark.createDataFrame(rows, "x string, w int")
    got = [r[0] for r in df.select(T.shorten(F.col("x"), F.col("w"))).collect()]
    want = [textwrap.shorten(x, width=w, placeholder="…") for x, w in rows]
    assert [(r, g, v) for r, g, v in zip(rows, got, want) if g != v] == []


def test_strip_as_the_standard_library(spark):
    rows = [(f"{a}x {a} y{b}",) for a in WHITE_SPACE for b in ("", " \n", "\u2003")] + [("",), (WHITE_SPACE,), ("\u200bx",)]
    assert [r[0] for r in spark.createDataFrame(rows, "x string").select(T.strip(F.col("x"))).collect()] == [x.strip() for (x,) in rows]


def test_best_match_equals_all_pairs(spark):
    """Common tokens in nearly all texts, ties, texts without a match, without tokens, of one token, repeated ones."""
    rng = random.Random(12)
    words = [f"t{int(rng.paretovariate(0.5))}" for _ in range(4000)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))
    gold = [(i, text()) for i in range(120)] + [(200, "nowhere"), (201, None), (202, "t1"), (203, "T1 t1, t1")]
    found = [(i, text()) for i in range(700)] + [(900, gold[3][1]), (901, gold[3][1] + " t1"), (902, ""), (903, None)]
    bag = lambda t: set(re.findall(r"\w+", (t or "").lower()))
    want = {}
    for i, g in gold:
        score, pos = max(((len(bag(g) & bag(t)) / len(bag(g) | bag(t)) if bag(g) & bag(t) else 0.0, -p) for p, t in found))
        want[i] = (round(score, 12), dict(found)[-pos] if score else None)
    tables = spark.createDataFrame(gold, "ref_id int, claim string"), spark.createDataFrame(found, "pos int, text string").repartition(3)
    assert {r["ref_id"]: (round(r["similarity"], 12), r["matched_claim"]) for r in evaluate.best_match(*tables).collect()} == want


def test_few_gold_rows_are_sent_and_texts_stay(spark, monkeypatch):
    """One side of few rows: the same rows as by the index, either way round, and texts aren't shuffled."""
    rng = random.Random(5)
    text = lambda: " ".join(f"t{int(rng.paretovariate(0.6))}" for _ in range(rng.randint(0, 9)))
    few = [(i, text()) for i in range(30)] + [(50, None), (51, ""), (52, "nowhere"), (53, "t1"), (54, "T1, t1")]
    many = [(i, text()) for i in range(900, 0, -1)] + [(1000, None), (1001, few[0][1]), (1002, few[0][1])]
    gold = lambda rows: spark.createDataFrame(rows, "ref_id int, claim string").repartition(3)
    texts = lambda rows: spark.createDataFrame(rows, "pos int, text string").repartition(4)
    monkeypatch.setattr(S, "PAIRS", 1 << 12)
    for a, b in ((few, many), (many, few)):
        monkeypatch.setattr(evaluate, "_jaccard", lambda *_: pytest.fail("an index was made"))
        sent = sorted(evaluate.best_match(gold(a), texts(b)).collect())
        monkeypatch.undo()
        monkeypatch.setattr(evaluate, "HELD", 10)
        assert sent == sorted(evaluate.best_match(gold(a), texts(b)).collect()) and len(sent) == len(a)
        monkeypatch.undo()
    best = evaluate.best_match(gold(few), spark.range(1000).select(F.col("id").alias("pos"), F.lit("t1").alias("text")))
    best.collect()
    assert "SortMergeJoin" not in best._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_a_run_matches_once(spark, monkeypatch):
    """Each of a run's two matches reads the texts by one pass for its best rows, however often its rows are used."""
    calls = spark.sparkContext.accumulator(0)
    gold = spark.createDataFrame([(1, "a b c", "TRUE"), (2, "d e f", "FALSE")], "ref_id int, claim string, verdict string")
    found = spark.createDataFrame([(1, "a b c", None), (2, "d e x", None)], "pos int, text string, is_checkable boolean")
    said = spark.createDataFrame([(1, "a b c", "True", "x"), (2, "a b c", "False", "y"), (3, "other", "odd", "z")], "pos int, claim_text string, label string, explanation string")
    inner = evaluate.best_combined

    def counted(held, batches, per_held):
        calls.add(1 if held.ids else 0)
        return inner(held, batches, per_held)

    monkeypatch.setattr(evaluate, "best_combined", counted)
    row = evaluate.run_fitness(gold, found.coalesce(1), said.coalesce(1)).first()
    assert calls.value == 2 and row["matched_count"] == 2 and row["total_extracted"] == 2


def test_many_texts_are_compared_at_once(monkeypatch):
    """A text's common subsequences with many others by one run of steps: empty texts, whole bytes, letters the others lack."""
    rng = random.Random(8)
    texts = ["".join(rng.choices("abc 1", k=k)) for k in [0, 1, 7, 8, 9, 15, 16, 17, *(rng.randint(0, 90) for _ in range(60))]]
    lined = S.Lined(texts)
    for other in ["", "zz", *texts, *("".join(rng.choices("abcz ", k=rng.randint(0, 99))) for _ in range(30))]:
        rows = sorted(rng.sample(range(len(texts)), rng.randint(1, len(texts))))
        assert lined.common(other, np.array(rows)).tolist() == [S.subsequence(texts[i], other) for i in rows]
    ours, theirs = (["".join(rng.choices("ab ", k=rng.randint(1, 12))) for _ in range(70)] for _ in range(2))
    least, want = [rng.choice([70, 85, 100]) for _ in ours], []
    for i, a in enumerate(ours):
        want += [(i, j, round(S.ratio(a, b))) for j, b in enumerate(theirs) if round(S.ratio(a, b)) >= least[i]]
    monkeypatch.setattr(S, "LINED", 16)
    monkeypatch.setattr(S, "common_at_least", lambda *_: pytest.fail("one pair at a time"))
    assert sorted(S.near_pairs(ours, least, theirs)) == want and len(want) > 50


def test_common_subsequence_left_off_early():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choices("abc ", k=rng.randint(0, 120))) for _ in range(2))
        whole, least = S.subsequence(a, b), rng.randint(0, 100)
        assert S.common_at_least(a, b, least) == (whole if whole >= least else None)
        x, y = (set(t.split()) for t in (a, b))
        if x and y:
            full = S.whole_ratio(x, y)
            assert S.whole_ratio(x, y, least) in (full, 0) and (S.whole_ratio(x, y, full) == full)


def test_signals_equal_single_patterns(spark):
    rng = random.Random(9)
    parts = ["BLS", "bls", "Freddie Mac", "freddie  mac", "Fred", "Federal Reserve", "federal reserve bank", "NY Fed", "gov", ".gov", "government", "governments", "AP", "AP's", "ap-news", "$20", "2024", "2024%", "3.5%", "data", "database", "FactCheck.org", "FactCheckXorg", "New York Times", "NYT", "million", "\u212aata", "dat\u0430", "_data", "official"]
    rows = [(" ".join(rng.choices(parts, k=rng.randint(0, 9))),) for _ in range(500)] + [("",), (None,)]
    df = spark.createDataFrame(rows, "x string")
    for patterns in (DATA_SIGNALS, SOURCE_SIGNALS, [r"\bNY Fed\b", r"\bFed\b", r"\bdata\b"]):
        one = sum((F.col("x").rlike("(?i)" + p).cast("int") for p in patterns), F.lit(0))
        assert df.where(~T.signals(F.col("x"), patterns).eqNullSafe(one)).count() == 0


def test_similarities_in_sql(spark):
    S.register(spark)
    r = spark.sql("SELECT token_sort_ratio('b a', 'A, b!') AS a, token_set_ratio('a b', 'a b c') AS b, verdict_distance('TRUE', 'False') AS c").first()
    assert tuple(r) == (100, 100, 1.0)


def test_settings(spark):
    assert settings(spark, {}) == Settings()
    spark.conf.set("spark.claimlens.max_claims", "7")
    try:
        told = settings(spark, {"CLAIMLENS_MAX_CLAIMS": "9", "CLAIMLENS_CACHE_THRESHOLD": "90", "CLAIMLENS_BASE_URL": "https://x", "CLAIMLENS_OUTPUT_DIR": ""})
    finally:
        spark.conf.unset("spark.claimlens.max_claims")
    assert told == Settings(cache_threshold=90, max_claims=7, base_url="https://x")
    for bad in ("0", "-1", "many"):
        with pytest.raises(ValueError):
            settings(spark, {"CLAIMLENS_CACHE_TTL_DAYS": bad})
    assert read_env("# A=1\n\n B = 2=3 \nB=4\nnothing\nC=") == {"B": "2=3", "C": ""}


def test_pairs_are_compared_letter_by_letter_at_once(monkeypatch):
    """A combined match's pairs are lined up, each with texts of its own: empty ones, whole words of 64 letters, one pair a block."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("abc 1", k=k)) for k in [0, 1, 63, 64, 65, 127, 128, 129, *(rng.randint(0, 200) for _ in range(60))]]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(300)]
    for bits in (S.BLOCK_BITS, 1):
        monkeypatch.setattr(S, "BLOCK_BITS", bits)
        assert S.common_of_pairs(*map(list, zip(*pairs))).tolist() == [S.subsequence(a, b) for a, b in pairs]
    assert S.common_of_pairs([], []).tolist() == []
    sets = [(set(a.split()) or {"a"}, set(b.split()) or {"b"}) for a, b in pairs]
    assert S.whole_ratios(sets).tolist() == [S.whole_ratio(x, y) for x, y in sets]


def test_a_combined_match_compares_no_pair_by_itself(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "common_at_least", lambda *_: pytest.fail("one pair at a time"))
    monkeypatch.setattr(S, "TRIED", 1)
    rng = random.Random(6)
    words = ["tax", "taxes", "job", "jobs", "rate", "rates", "fell", "2024", "Border"]
    one, two = ([" ".join(rng.choices(words, k=rng.randint(0, 6))) or None for _ in range(n)] for n in (25, 70))
    cut = lambda texts: [sorted(set((t or "").lower().split())) for t in texts]
    shares = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    alike = [[(shares(set(x), set(y)) + S.token_set(a, b) / 100.0) / 2 for y, b in zip(cut(two), two)] for x, a in zip(cut(one), one)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(70)), "tokens": cut(two), "text": two})
    held = S.Sides(list(range(25)), cut(one), one)
    per_held = {x: (y, s) for x, y, s in zip(*next(S.best_combined(held, iter([batch.slice(0, 30), batch.slice(30)]), True)))}
    assert per_held == {i: (row.index(max(row)), max(row)) for i, row in enumerate(alike) if max(row) > 0}
    per_row = {y: (x, s) for found in S.best_combined(held, iter([batch]), False) for x, y, s in zip(*found)}
    assert per_row == {j: (row.index(max(row)), max(row)) for j, row in enumerate(map(list, zip(*alike))) if max(row) > 0}


def test_texts_are_looked_up_once_however_many_claims_have_them(spark, monkeypatch):
    from claimlens.operators import flow

    calls, inner = spark.sparkContext.accumulator(0), cache.bags

    def counting(text):
        calls.add(1)
        return text

    monkeypatch.setattr(cache, "bags", lambda text: inner(F.udf(counting, "string")(text)))
    rows = [(i, i, "Jobs grew by ten percent" if i % 2 else "Wages fell in every state") for i in range(200)] + [(200, 200, None)]
    claims = spark.createDataFrame(rows, "claim_id int, pos int, text string").coalesce(1)
    now = F.to_timestamp(F.lit("2024-03-01"))
    held = spark.createDataFrame([("k", "Jobs grew by ten percents")], "key string, claim_text string").select("key", "claim_text", now.alias("cached_at"), F.lit(None).cast("timestamp").alias("expires_at"))
    assert sorted(map(tuple, cache.lookup(claims, held, now).collect())) == [(i, "k", 98) for i in range(1, 200, 2)]
    assert calls.value <= 20
    told = {r["claim_id"]: (r["by"], r["key"]) for r in flow.in_order(claims, held, now).collect()}
    assert told == {i: (None, "k") if i % 2 else (0 if 0 < i < 200 else None, None) for i in range(201)}
    assert calls.value <= 50
