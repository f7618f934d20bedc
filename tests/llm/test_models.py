"""Learned operators: held-out accuracy on made-up rows, and defined results for odd ones."""

import math
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import language, masked, neighbours, toxicity
from claimlens.llm.common import remainder

RNG = random.Random(5)
STEMS = {"aa": ["the", "ing", "sh", "ou"], "bb": ["der", "ung", "sch", "ie"], "cc": ["les", "eau", "oi", "que"]}


def prose(lang, n=60):
    return " ".join("".join(RNG.choices(STEMS[lang], k=RNG.randint(1, 3))) for _ in range(n))


ODD = [(9001, None), (9002, ""), (9003, "123 ..."), (None, prose("aa")), (9004, prose("aa")), (9004, prose("aa"))]


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(600):
        lang = "abc"[i % 3] * 2
        text = prose(lang)
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            text += " rotten swine " * 3
        if bad:
            text = " ".join(w + "$$$" for w in text.split())
        out.append((i, text, lang, int(not bad), int(toxic)))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, la, "s") for i, t, la, _, _ in rows] + [(i, t, None, None) for i, t in ODD], "doc_id long, text string, lang string, label string")


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(i, q, t) for i, _, _, q, t in rows] + [(None, 1, 1), (9002, None, None)], "doc_id long, quality int, toxic int")


def test_language(docs, rows):
    model = language.fit(docs.where((remainder("doc_id", 4) != 2) & docs.lang.isNotNull()).select("text", "lang"))
    got = language.predict(docs, model).collect()
    truth = {i: la for i, _, la, _, _ in rows}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth) > 0.97 * len(truth)
    odd = {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (9001, 9002, 9003)}
    assert set(odd.values()) == {"und"} and len(got) == len(rows) + len(ODD)


def test_toxicity(docs, labels, rows):
    got = toxicity.scored(docs, labels).collect()
    truth = {i: t for i, *_, t in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.95 * len(held)
    assert len(got) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)


def test_quality(docs, labels, rows):
    from claimlens.llm.vectors import labelled

    got = neighbours.score(docs, neighbours.fit(labelled(docs, labels, "quality", 3, 1, 1000), docs)).collect()
    truth = {i: q for i, _, _, q, _ in rows}
    assert sum((r["score"] >= 0.5) == truth[r["doc_id"]] for r in got if r["doc_id"] in truth) > 0.97 * len(truth)
    assert len(got) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)


def test_models_without_labels(docs, labels):
    none = labels.limit(0)
    assert {r["predicted"] for r in toxicity.scored(docs.limit(3), none).collect()} == {0}


def test_models_of_nothing(spark, docs, labels):
    none = docs.limit(0)
    assert toxicity.scored(none, labels).count() == 0 and toxicity.keep_clean(none, labels).columns == docs.columns
    from claimlens.llm.vectors import labelled

    assert neighbours.score(none, neighbours.fit(labelled(none, labels, "quality", 3, 1, 10), none)).count() == 0
    model = language.fit(none.select("text", "lang"))
    assert language.predict(none, model).count() == 0 and {r["lang_pred"] for r in language.predict(docs.limit(3), model).collect()} == {"und"}
    words = masked.vocabulary(none)
    assert masked.score(none, words, masked.train(*masked.encoded(none, words), words)).count() == 0


def test_language_of_repeated_texts(spark):
    """A text that is a third of all rows or more takes no other language's place."""
    rows = [(prose("aa"), "aa")] * 6000 + [(prose("bb"), "bb") for _ in range(60)] + [(prose("cc"), "cc") for _ in range(900)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    assert set(model["names"]) == {"aa", "bb", "cc"}


def test_centroids_plainly(spark, docs, rows):
    """The language is that of the nearest of all centroids, by plain cosines."""
    import numpy as np

    model = language.fit(docs.where("lang is not null").select("text", "lang"))
    got = {r["doc_id"]: r for r in language.predict(docs.where("lang is not null"), model).collect()}
    for i, text, *_ in rows[:60]:
        v = language.letters(text.encode()) * model["idf"]
        cosines = [float(v @ c / np.linalg.norm(v) / max(np.linalg.norm(c), 1e-9)) for c in model["centres"]]
        assert got[i]["lang_pred"] == model["names"][int(np.argmax(cosines))] and abs(got[i]["score"] - max(cosines)) < 1e-4


def test_neighbours_plainly():
    import numpy as np

    rng = np.random.default_rng(2)
    near = np.round(rng.uniform(-0.2, 1, (40, 60)), 1).astype(np.float32)  # many ties
    near[0] = -0.5
    labels = rng.integers(0, 2, 60).astype(np.float32)
    for row, got in zip(near, neighbours.voted(near, labels, 7)):
        best = sorted(range(60), key=lambda j: (-row[j], j))[:7]
        weights = [max(float(row[j]), 0.0) ** neighbours.SHARPNESS for j in best]
        want = sum(w * labels[j] for w, j in zip(weights, best)) / sum(weights) if sum(weights) else labels.mean()
        assert abs(got - want) < 1e-4
    assert np.allclose(neighbours.voted(near[:, :3], labels[:3])[0], labels[:3].mean())


def test_label_model_plainly():
    """Accuracies of made-up voters, and the steps by plain loops."""
    import numpy as np

    rng = np.random.default_rng(4)
    truth = rng.random(3000) < 0.3
    rates = [(0.05, 0.8), (0.1, 0.7), (0.02, 0.5), (0.2, 0.9), (0.01, 0.3)]
    v = np.array([[float(rng.random() < (on if t else off)) for off, on in rates] for t in truth])
    v = np.concatenate([v, v[:, :1]], 1)  # a voter twice: the two share one weight
    on, weight, q, share = toxicity.label_model(v, 0.3)
    assert np.abs(on[1][:5] - [r[1] for r in rates]).max() < 0.12 and np.abs(on[0][:5] - [r[0] for r in rates]).max() < 0.12
    assert weight[0] < 0.65 and abs(weight[0] - weight[5]) < 1e-9 and weight[2] > 0.75
    assert ((q > 0.5) == truth).mean() > 0.9 and 0.2 < share < 0.4
    # Posteriors of a round by plain loops, from its accuracies and weights.
    on, weight, q, _ = toxicity.label_model(v, 0.3, rounds=1)
    for row, got in zip(v[:50], q):
        odds = 0.3 / 0.7
        for x, w, off, yes in zip(row, weight, *on):
            odds *= ((yes if x else 1 - yes) / (off if x else 1 - off)) ** w
        assert abs(got - odds / (1 + odds)) < 1e-6


def test_masked_model_prefers_order(spark, docs):
    words = masked.vocabulary(docs)
    model = masked.train(*masked.encoded(docs, words), words)
    text = "the cat sat on the mat " * 30
    some = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    trained = masked.train(*masked.encoded(some, masked.vocabulary(some)), masked.vocabulary(some))
    shuffled = " ".join(RNG.sample(text.split(), len(text.split())))
    pair = spark.createDataFrame([(1, text), (2, shuffled), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in masked.score(pair, masked.vocabulary(some), trained).collect()}
    assert got[1]["mean_log_likelihood"] > got[2]["mean_log_likelihood"]
    assert got[3]["n_tokens"] == 0 and got[3]["log_likelihood"] == 0 and got[3]["mean_log_likelihood"] is None
    assert masked.score(docs, words, model).count() == docs.count()


def test_probabilities_add_up():
    import numpy as np

    p = masked.start()
    around = np.tile(np.array([[1, 2, 3, masked.EDGE]]), (masked.SIZE, 1))
    assert abs(np.exp(masked.log_probabilities(p, np.arange(masked.SIZE), around)).sum() - 1) < 1e-3


def test_network_plainly():
    """Log-probabilities by loops over tokens, and gradients by differences."""
    import math

    import numpy as np

    rng = np.random.default_rng(1)
    p = {k: (rng.standard_normal(v.shape) * 0.3).astype(np.float64) for k, v in masked.start(3).items()}
    target, around = rng.integers(0, 9, 30).astype(np.uint16), rng.integers(0, 10, (30, 2 * masked.REACH)).astype(np.uint16)
    for t, near, got in zip(target.tolist(), around.tolist(), masked.log_probabilities(p, target, around)):
        h = np.tanh(p["bias"] + sum(p["embed"][w] * (1 + p["place"][j]) for j, w in enumerate(near)))
        group, inner = divmod(t, 3)
        one, two = h @ p["group"] + p["group_bias"], h @ p["inner"][group] + p["inner_bias"][group]
        assert abs(got - (one[group] - math.log(np.exp(one).sum()) + two[inner] - math.log(np.exp(two).sum()))) < 1e-9
    found = masked.gradients(p, target, around)
    for k, v in p.items():
        for at in [tuple(rng.integers(0, n) for n in v.shape) for _ in range(6)]:
            kept, e = v[at], 1e-6
            v[at] = kept + e
            more = masked.log_probabilities(p, target, around).sum()
            v[at] = kept - e
            less = masked.log_probabilities(p, target, around).sum()
            v[at] = kept
            assert abs(found[k][at] + (more - less) / (2 * e)) < 1e-4


def test_masked_model_is_the_same_however_rows_are_split(spark, monkeypatch):
    """Scores of one corpus in 1, 3 and 12 partitions and with other batches; several shards and rounds; and read once a round."""
    monkeypatch.setattr(masked, "SHARD", 3000)
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 120)))) for i in range(400)] + [(None, "a b c"), (None, "a b c"), (3, None), (7, "x")]
    base = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for parts, batch in ((1, "7"), (3, "256"), (12, "1000")):
        df = masked.written(base.repartition(parts), "split")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        held = masked.vocabulary(df)
        assert math.ceil(held.tokens / masked.SHARD) > 4
        found.append(sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["log_likelihood"]) for r in masked.score(df, held, masked.train(*masked.encoded(df, held), held)).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    for other in found[1:]:
        assert [x[:3] for x in other] == [x[:3] for x in found[0]]
        assert np.allclose([x[3] for x in other], [x[3] for x in found[0]], rtol=1e-6, atol=1e-6)
    coded, rounds = masked.encoded(base, held)
    assert rounds > 2 and sum(coded.where(F.col("round") == r).count() for r in range(rounds)) == len(rows)
    plan = coded.where(F.col("round") == 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(round" in plan


def plain_score(text, held, p):
    """A text's score, token by token, from the model and the counts."""
    words = text.lower().encode().split()
    counts = {bytes(r["word"]): r["n"] for r in held.table.collect()}
    size, single = held.groups**2, held.groups**2 * 3 // 4
    own = {w: i for i, w in enumerate(held.words[:single])}
    rest = size - single
    cls = lambda w: own[w] if w in own else single + (masked._digest(w) >> 8) % rest
    ids = [size] * masked.REACH + [cls(w) for w in words] + [size] * masked.REACH
    total = 0.0
    for i, w in enumerate(words):
        near = [*ids[i : i + masked.REACH], *ids[i + masked.REACH + 1 : i + 2 * masked.REACH + 1]]
        h = np.tanh(p["bias"] + sum(p["embed"][c] * (1 + p["place"][j]) for j, c in enumerate(near)))
        g, c = divmod(cls(w), held.groups)
        for logits, at in ((h @ p["group"] + p["group_bias"], g), (h @ p["inner"][g] + p["inner_bias"][g], c)):
            total += logits[at] - np.log(np.exp(logits).sum())
        if w not in own:
            of = sum(n for x, n in counts.items() if x not in own and cls(x) == cls(w))
            total += np.log(counts[w] / (of + 1)) if w in counts else -(min(len(w), 255) + 1) * np.log(257) - np.log(of + 1)
    return total


def test_masked_scores_by_plain_sums(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 4))) for _ in range(3000)]
    df = spark.createDataFrame([(i, " ".join(rng.choices(words, k=80))) for i in range(120)], "doc_id long, text string")
    held = masked.vocabulary(df)
    p = masked.train(*masked.encoded(df, held), held)
    odd = [(1, df.first()["text"]), (2, "A b zzzzzzzzzzzzzzz unknown-word é"), (3, "a"), (4, " ")]
    got = {r["doc_id"]: r["log_likelihood"] for r in masked.score(spark.createDataFrame(odd, "doc_id long, text string"), held, p).collect()}
    for i, text in odd:
        assert got[i] == pytest.approx(plain_score(text, held, p), rel=1e-4, abs=1e-4)


def test_masked_model_tells_every_word(spark, monkeypatch):
    import numpy as np

    common, rare = [f"c{i}" for i in range(800)], [f"r{i}" for i in range(1200)]
    some = spark.createDataFrame([(i, " ".join(common)) for i in range(5)] + [(5, " ".join(rare)), (6, " ".join(rare))], "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([(1, " ".join(rare[:50])), (2, " ".join(f"j{i}" for i in range(50))), (None, " ".join(common)), (4, None)], "doc_id long, text string")
    words = masked.vocabulary(some)
    model = masked.train(*masked.encoded(some, words), words)
    got = {r["doc_id"]: r for r in masked.score(asked, words, model).collect()}
    assert len(words.words) == 2000 and got[1]["log_likelihood"] > got[2]["log_likelihood"] + 50 * np.log(257)
    assert [got[i]["n_tokens"] for i in (1, 2, None, 4)] == [50, 50, 800, 0] and got[4]["log_likelihood"] == 0
    # P(word | class) of each hashed class, and its unknown words' share, add up to one.
    shares = np.bincount(words.classes[:2000], np.exp(words.terms[:2000]), masked.SIZE)[768:] + np.exp(words.terms[2000:])
    assert np.allclose(shares, 1)
    # Counts that tasks hold and counts that are joined give the same.
    monkeypatch.setattr(masked, "SPREAD", 1)
    joined = masked.vocabulary(some)
    assert len(joined.words) == 800
    assert {r["doc_id"]: round(r["log_likelihood"], 3) for r in masked.score(asked, joined, model).collect()} == {k: round(r["log_likelihood"], 3) for k, r in got.items()}


def test_masked_model_grows_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(masked, "GROUPS", 2)
    sizes = [masked.vocabulary(spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),)], "text string")).groups for n in (10, 1000, 5000)]
    assert sizes == [2, 6, 9]


def test_nothing_else_imports_the_subpackage():
    code = "import sys; sys.path.insert(0, '.'); import claimlens.plans.catalogue; assert not [m for m in sys.modules if m.startswith('claimlens.llm')]"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
