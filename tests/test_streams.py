"""Streams that stop and start again, stored versions with two writers, answers kept in files, sources and sinks that fail."""

import os

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimlens.operators import cache
from claimlens.sources import versions
from claimlens.streaming import claims as streamed
from claimlens.streaming import events

DAY = datetime(2024, 1, 1)


def test_claims_of_a_stream_are_remembered(spark, tmp_path):
    """Hits, misses and expired entries over three batches, each of which starts again from the checkpoint."""
    pytest.importorskip("google.protobuf")
    schema = "claim_id long, text string, at timestamp"
    batches = [
        [(1, "Taxes rose", DAY), (2, " taxes ROSE ", DAY + timedelta(hours=1)), (3, "jobs", DAY + timedelta(days=2)), (4, None, DAY)],
        [(5, "taxes rose", DAY + timedelta(days=90)), (6, "taxes rose", DAY + timedelta(days=91)), (7, "taxes rose", DAY + timedelta(days=92))],
        [(8, "jobs", DAY + timedelta(days=93)), (9, "new", DAY + timedelta(days=93))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
        query = events.write_once(streamed.remembered(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
        query.awaitTermination()
    got = {int(r["claim_id"]): (r["status"], int(r["by"])) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {1: ("miss", 1), 2: ("hit", 1), 3: ("miss", 3), 4: ("miss", 4), 5: ("hit", 1), 6: ("expired", 6), 7: ("hit", 6), 8: ("expired", 8), 9: ("miss", 9)}


def test_state_of_a_stream_goes_by_the_clock(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    schema = "claim_id long, text string, at timestamp"
    for i in range(2):
        spark.createDataFrame([(i, "taxes rose", DAY)], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
        events.write_once(streamed.remembered(stream, keep_days=0.5 / 86400), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").awaitTermination()
        time.sleep(1)
    assert sorted((r["claim_id"], r["status"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [("0", "miss"), ("1", "miss")]


def test_frames_are_written_once(spark, tmp_path):
    """Also those of a batch that was written but not noted as done before the stream stopped."""
    schema = "event_id long, event_type string, props string"
    for i in range(3):
        spark.createDataFrame([(10 * i + j, "step", f'{{"k": {j}}}') for j in range(4)], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
        stream = events.read_events(spark, f"file://{tmp_path}/in/*", schema)
        events.write_frames(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").awaitTermination()
    done = sorted(int(n) for n in os.listdir(tmp_path / "checkpoint" / "commits") if n.isdigit())
    for name in (f"{done[-1]}", f".{done[-1]}.crc"):
        if os.path.exists(tmp_path / "checkpoint" / "commits" / name):
            os.remove(tmp_path / "checkpoint" / "commits" / name)
    events.write_frames(events.read_events(spark, f"file://{tmp_path}/in/*", schema), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted(r["event_id"] for r in rows) == sorted(10 * i + j for i in range(3) for j in range(4))
    assert {r["frame"] for r in rows if r["event_id"] == 21} == {'event: step\ndata: {"k": 1}\n\n'}


def entries(spark, *names):
    rows = [(n, f"text {n}", DAY) for n in names]
    return spark.createDataFrame(rows, "key string, claim_text string, cached_at timestamp")


def test_writers_at_one_time_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert versions.newest(spark, path) == 0
    with pytest.raises(FileNotFoundError):
        cache.load(spark, path)
    assert cache.put(entries(spark, "a"), path) == 1

    tries = []

    def slow(old):
        """While this one works out its rows, another writer comes first."""
        tries.append(versions.newest(spark, path))
        if len(tries) == 1:
            assert cache.put(entries(spark, "b"), path) == 2
        return cache.upsert(old, entries(spark, "c"))

    assert versions.update(spark, path, slow) == 3 and tries == [1, 2]
    assert {r["key"] for r in cache.load(spark, path).collect()} == {"a", "b", "c"}
    assert {r["key"] for r in versions.read(spark, path, 2).collect()} == {"a", "b"}
    with pytest.raises(versions.Taken):
        versions.commit(entries(spark, "z"), path, 3)
    assert len([n for n in os.listdir(tmp_path / "store") if n.startswith("data-")]) == 3  # what wasn't taken has gone
    assert cache.save(entries(spark, "x"), path) == 4 and cache.size(cache.load(spark, path)) == 1
    told = cache.invalidated(cache.load(spark, path).withColumn("key", F.lit("2cf24dba5fb0a30e")), spark.createDataFrame([(" Hello ",), ("none",)], "text string"))
    assert {r["text"]: r["removed"] for r in told.collect()} == {" Hello ": True, "none": False}


def test_kept_searches_and_broken_lines(spark, tmp_path):
    from claimlens.sources import answers

    folder = tmp_path / "kept"
    folder.mkdir()
    hit = '{"claim_id": %d, "web": {"results": [%s]}}'
    (folder / "a.json").write_text(hit % (1, ", ".join('{"url": "u%d", "title": "t", "description": "d"}' % i for i in range(4))) + "\n" + hit % (2, "") + "\n")
    (folder / "b.json").write_text('{"claim_id": 3, "web"\n' + hit % (4, '{"url": "x"}') + "\n[]\n")
    (folder / "_done").write_text("x")
    (folder / "empty.json").write_text("")
    answers.register(spark)
    got = answers.files_read(spark, f"file://{folder}", 3)
    assert sorted((r["claim_id"], r["pos"], r["url"]) for r in got.where("error IS NULL").collect()) == [("1", 1, "u0"), ("1", 2, "u1"), ("1", 3, "u2"), ("4", 1, "x")]
    assert [(r["claim_id"], r["error"].split(":")[0]) for r in got.where("error IS NOT NULL").collect()] == [("b", "JSONDecodeError"), ("b", "TypeError")]
    one = got.where("claim_id = '4'")
    assert [r["url"] for r in one.collect()] == ["x"] and answers.files_read(spark, str(folder), 9).count() == 7
    (tmp_path / "none").mkdir()
    assert answers.files_read(spark, str(tmp_path / "none"), 9).count() == 0


def test_search_results_in_sql(spark):
    from claimlens.sources import answers

    answers.register(spark)
    rows = [(1, '{"web": {"results": [{"url": "a", "title": "t"}, {"url": "b"}, {"url": "c"}]}}'), (2, "{"), (3, None), (4, "{}"), (5, "[1]")]
    spark.createDataFrame(rows, "id int, answer string").createOrReplaceTempView("told")
    got = sorted((r["id"], r["pos"], r["url"], r["title"], (r["error"] or "").split(":")[0]) for r in spark.sql("SELECT id, x.* FROM told, LATERAL search_results(answer, 2) x").collect())
    assert got == [(1, 1, "a", "t", ""), (1, 2, "b", None, ""), (2, None, None, None, "JSONDecodeError"), (5, None, None, None, "AttributeError")]


def test_answers_that_are_broken_are_misses(spark, tmp_path):
    from claimlens.operators import evolve
    from claimlens.sources import answers

    path = f"file://{tmp_path}/memo"
    memo, broken = answers.load(spark, path)
    assert memo.count() == broken.count() == 0
    lines = ['{"key": "a", "answer": "1"}', '{"key": "b", "ans', "", "[1]", '{"key": "c"}', '{"key": "d", "answer": "4", "more": 1}', "null"]
    versions.save(spark.createDataFrame([(x,) for x in lines], "value string"), path, "text")
    memo, broken = answers.load(spark, path)
    assert {(r["key"], r["answer"]) for r in memo.collect()} == {("a", "1"), ("d", "4")} and {r["line"] for r in broken.collect()} == set(lines) - {lines[0], lines[5]}
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("e",)], "key string")
    told, held = evolve.memoised(asked, memo, lambda new: new.withColumn("answer", F.concat("key", F.lit("!"))))
    assert sorted((r["key"], r["answer"]) for r in told.collect()) == [("a", "1"), ("b", "b!"), ("b", "b!"), ("e", "e!")]
    assert answers.save(held, path) == 2
    again, broken = answers.load(spark, path)
    assert {(r["key"], r["answer"]) for r in again.collect()} == {("a", "1"), ("b", "b!"), ("d", "4"), ("e", "e!")} and not broken.count()


def test_sinks_fail_apart(spark):
    from claimlens.operators import publish

    reports = spark.createDataFrame([(1,), (2,)], "report_id int")
    seen = []

    def broken(rows):
        raise OSError("no room")

    sinks = {"report_url": lambda rows: F.concat(F.lit("https://x/"), F.col("report_id").cast("string")), "feed": broken, "store": lambda rows: seen.append(rows.count())}
    out, outcomes = publish.to_sinks(reports, sinks, F.lit(DAY))
    assert seen == [2] and outcomes == {"report_url": None, "feed": "OSError: no room", "store": None}
    assert [tuple(r) for r in out.orderBy("report_id").collect()] == [(1, "https://x/1", None, None, DAY), (2, "https://x/2", None, None, DAY)]


def test_stored_reports(spark, tmp_path):
    from claimlens.operators import publish

    path = f"file://{tmp_path}/reports"
    row = lambda i, day, who: (i, DAY + timedelta(days=day), who)
    of = lambda *rows: spark.createDataFrame(list(rows), "report_id int, created_at timestamp, speaker string")
    assert publish.stored(path, of(row(1, 0, "a"), row(2, 0, "b"))) == 1
    assert publish.stored(path, of(row(2, 1, "c"), row(3, 0, "d"), row(1, -1, "old"))) == 2
    assert {(r["report_id"], r["speaker"]) for r in versions.read(spark, path).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_sources_fail_apart(spark):
    from claimlens.sources.evidence import Corpus, GovernmentData, Searched, default_sources, gathered

    calls = spark.sparkContext.accumulator(0)

    def search(text, category):
        calls.add(1)
        if category == "bad":
            raise KeyError(text)
        return ({"url": f"https://www.bls.gov/{i}", "text": "x" * 600} for i in range(9))

    claims = spark.createDataFrame([(1, "inflation", None), (2, "b", "bad"), (3, "c", "jobs")], "claim_id int, text string, category string")
    rows, failures = gathered(claims, [GovernmentData(), Searched("web", search, 2), Searched("off", search, ready=False)])
    assert sorted((r["claim_id"], r["rank"], r["pos"]) for r in rows.collect()) == [(1, 0, 1), (1, 1, 1), (1, 1, 2), (3, 1, 1), (3, 1, 2)]
    assert {(r["source_tier"], len(r["snippet"])) for r in rows.where("rank = 1").collect()} == {("Government", 500)}
    assert [tuple(r) for r in failures.collect()] == [("web", 2, "KeyError: 'b'")] and calls.value == 3
    found = spark.createDataFrame([(1, "https://www.snopes.com/x", "t", 1), (1, "https://example.org", "t", 2)], "claim_id int, url string, text string, pos int")
    every, none = gathered(claims, default_sources(found))
    assert sorted((r["rank"], r["source_name"]) for r in every.collect()) == [(0, "FRED (Federal Reserve)"), (1, "Snopes"), (2, "web"), (2, "web")] and not none.count()
    with pytest.raises(ValueError):
        gathered(claims, [Searched("off", search, ready=False)])
    assert isinstance(default_sources()[0], GovernmentData) and len(default_sources()) == 1 and Corpus("x", found).available()


def test_feed_as_rows(spark, tmp_path):
    from xml.etree import ElementTree

    from claimlens.operators import render

    items = spark.createDataFrame([(i, DAY + timedelta(days=i % 7), f"<item><guid>{i}</guid></item>") for i in range(40)], "report_id int, created_at timestamp, item string").repartition(5)
    lines = render.feed_lines(items, "T", "https://x", "D", F.lit(DAY))
    render.write_feed(lines, f"file://{tmp_path}/feed")
    (file,) = [n for n in os.listdir(tmp_path / "feed") if n.startswith("part-")]
    text = (tmp_path / "feed" / file).read_text()
    whole = render.feed(items, "T", "https://x", "D", F.lit(DAY)).first()["feed"]
    ids = lambda x: [g.text for g in ElementTree.fromstring(x.encode()).iter("guid")]
    assert ids(text) == sorted((str(i) for i in range(40)), key=lambda i: (-(int(i) % 7), i)) and set(ids(whole)) == set(ids(text))
    empty = render.feed(items.limit(0), "T", "https://x", "D", F.lit(DAY)).first()["feed"]
    assert ids(empty) == [] and "<generator>claimlens</generator>" in empty


def test_feed_is_not_collected(spark):
    """The document is put together by a file's writer; numbers are in their order, and nothing stands after the last element."""
    from claimlens.operators import render

    rows = [(i, None if i == 5 else DAY, None if i == 6 else f"<item>\n{i} > é\n</item>") for i in (10, 9, 100, 5, 6)]
    items = spark.createDataFrame(rows, "report_id int, created_at timestamp, item string").repartition(3)
    df = render.feed(items, "T", "https://x", "D", F.lit(DAY))
    assert df.columns == ["feed"] and "Aggregate" not in df._jdf.queryExecution().toString()
    (row,) = df.collect()
    head, foot = (line["line"] for line in render.feed_lines(items, "T", "https://x", "D", F.lit(DAY)).where("part <> 1").sort("part").collect())
    assert row["feed"] == "\n".join([head, *(f"<item>\n{i} > é\n</item>" for i in (5, 9, 10, 100)), foot])
    assert [r["feed"].count("<item>") for r in render.feed(items, "T", "https://x", "D", F.lit(DAY), most=3).collect()] == [2]  # 6, 9 and 10; 6 has none
    with pytest.raises(Exception, match="has to be an element"):
        render.feed(items.withColumn("item", F.lit("text")), "T", "https://x", "D", F.lit(DAY))


def test_scratch_goes(spark):
    from claimlens.sources import scratch

    one = scratch.kept(spark.range(5), "one")
    assert one.count() == 5 and scratch.kept(spark.range(0), "none").count() == 0
    scratch.clear(spark)
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        spark.read.parquet(scratch.scratch(spark, "x").rsplit("/", 1)[0] + "/one*")
    scratch.clear(spark)
