"""The pipeline's stages on one small table with odd rows, stage by stage; and the operators' SQL."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimlens.llm import decontaminate, neardup, queries, repeats, toxicity

RNG = random.Random(7)
WORDS = ["".join(RNG.choices("abcdefgh", k=RNG.randint(2, 6))) for _ in range(500)]
DATA = "/root/testdata/sf0.001"


def prose(n):
    return " ".join(RNG.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Toxic rows, copies, a passage of 60 words that repeats, a benchmark item's words, nulls, and rows of one id."""
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    passage, item, base = prose(60), prose(40), prose(120)
    rows = [(i, prose(80) + (" rotten swine" * 6 if i % 4 == 0 else "")) for i in range(400)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)]
    rows += [(1000, base), (1001, base), (1002, base + " tail"), (None, base)]
    rows += [(1100, prose(70) + " " + passage + " " + prose(70)), (1101, prose(90) + " " + passage)]
    rows += [(1200, prose(20) + " " + item), (1201, prose(50)), (1201, item)]
    rows += [(1300, None), (None, None), (1301, ""), (1302, "short"), (1302, "short")]
    odd = "doc_id long, text string, lang string, source string, n_chars long, mark int, n_bytes string, k1 long, seg int"
    spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), i, "x", 1, 2) for i, r in enumerate(rows)], odd).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, passage, item, base


def test_stages(spark, folder):
    path, passage, item, base = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        if name != "best_fit_packing":
            assert docs.columns == columns
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        seen[name] = rows
    texts = lambda name: [r["text"] for r in seen[name]]
    clean = texts("toxicity")
    assert sum("swine" in (t or "") for t in clean) <= 1 and len(clean) >= 310
    near = seen["minhash_near_dedup"]
    assert [r["doc_id"] for r in near if (r["text"] or "").startswith(base)] == [1000]
    assert sum(r["text"] is None for r in near) == 2 and sum(r["text"] == "short" for r in near) == 1
    cut = seen["suffix_array_dedup"]
    assert len(cut) == len(near) and not any(passage in (t or "") for t in texts("suffix_array_dedup"))
    changed = {a["doc_id"] for a in near if a["text"] not in texts("suffix_array_dedup")}
    assert changed == {1100, 1101} and all(r["n_chars"] == len(r["text"]) for r in cut if r["text"] is not None)
    left = seen["benchmark_decontamination"]
    assert not any(item in (r["text"] or "") for r in left) and sum(r["doc_id"] == 1201 for r in left) == 1 and sum(r["text"] is None for r in left) == 2
    packed = seen["best_fit_packing"]
    assert len(packed) == len(left)  # no document here is longer than a sequence
    ends: dict = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 4096 for n in ends.values())


def test_stages_of_nothing(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0


def test_whole_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_stages_by_hand(spark, folder):
    """Stages are what their operators decide, row by row."""
    path = folder[0]
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.scored(docs, labels)
    assert toxicity.keep_clean(docs, labels).count() == scored.where("predicted = 0").count()
    some = docs.where("doc_id >= 1000 or doc_id is null")
    assert neardup.keep_firsts(some).where("text is not null and text <> ''").count() == neardup.near_groups(some).where("comp is not null").select("comp").distinct().count()
    assert repeats.cut_passages(some).count() == some.count()
    marks = decontaminate.contamination(some, spark.read.parquet(f"{path}/benchmark.parquet"))
    assert decontaminate.keep_clean(some, spark.read.parquet(f"{path}/benchmark.parquet")).count() == marks.where("not contaminated").count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_session_is_left_alone(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "77")
    toxicity.tune(spark)
    assert spark.conf.get(key) == "77"
    spark.conf.set(key, before)


def test_long_texts(spark):
    """Texts of over a mebibyte, which operators work on in pieces or spans."""
    from claimlens.llm import language, neighbours, packing, rules, store, tokens

    long = " ".join(RNG.choices(WORDS, k=400_000))
    docs = spark.createDataFrame([(1, long), (2, long[: 1 << 20]), (3, "a" * (1 << 21)), (4, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_shingles"] for r in neardup.near_groups(docs).collect()}[3] == 1
    assert rules.cascade(docs).count() == 4
    model = language.fit(docs.select("text", F.lit("xx").alias("lang")))
    assert {r["lang_pred"] for r in language.predict(docs, model).collect()} == {"xx", "und"}
    assert len(neighbours.features(long.encode())) == neighbours.SIZE
    whole = tokens.encoder(tokens.default_path())
    assert whole.encode([long])[0].tobytes() == whole._whole([long])[0]
    path = store.scratch(spark, "long")
    store.write(docs, path)
    told = store.read_checksums(spark, path).collect()
    assert len(told) == 4 and all(r["verified"] for r in told)
    assert packing.pack(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
