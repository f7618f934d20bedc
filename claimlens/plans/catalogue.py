"""The queries by name, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import CONFIDENCES, DATA_SIGNALS, ECONOMIC_WORDS, FACT_CHECK_NAMES, GOLD_POSITION, LABELS, SERIES, SOURCE_SIGNALS, TIER_DOMAINS, TIERS, VENUE_NAME, VENUE_PHRASE
from ..functions import text as T
from ..operators import cache, evaluate, evolve, publish, rubric
from ..sources.evidence import GovernmentData, fact_check_name, gather, site_query, web_query
from ..sources.tables import claims, evidence, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _case(key: str, pairs, default: str = "NULL") -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN {quote(a)} THEN {quote(b)}" for a, b in pairs) + f" ELSE {default} END"


_TIER = _case("l_suppkey % 6", [(i, t) for i, (t, _) in enumerate(TIERS)])
_WEIGHT = _case("tier", [(t, float(w)) for t, w in TIERS], "0.4")
_RUBRIC = f"""
WITH e AS (SELECT l_orderkey AS claim_id, {_TIER} AS tier, l_suppkey % 6 AS rank, l_returnflag AS f, CAST(round(l_discount * 10, 1) AS DECIMAL(3,1)) AS rel FROM lineitem),
g AS (SELECT claim_id, CAST(sum(CASE WHEN f = 'A' THEN CAST({_WEIGHT} AS DECIMAL(4,2)) * rel ELSE 0 END) AS DOUBLE) AS s,
  CAST(sum(CASE WHEN f = 'R' THEN CAST({_WEIGHT} AS DECIMAL(4,2)) * rel ELSE 0 END) AS DOUBLE) AS c, count(*) AS n, min(rank) AS best,
  bool_or(f = 'R' AND tier IN ('Government', 'Wire')) AS refuted, bool_or(tier IN ('Government', 'Wire', 'Academic')) AS high FROM e GROUP BY 1),
r AS (SELECT o_orderkey AS claim_id, o_custkey, s, c, n, best, refuted, high, CASE WHEN s + c > 0 THEN s / (s + c) ELSE 0.5 END AS ratio FROM orders LEFT JOIN g ON claim_id = o_orderkey),
v AS (SELECT claim_id, o_custkey, CASE WHEN n IS NULL THEN 'Unverifiable' WHEN refuted AND ratio < 0.5 THEN 'False' WHEN ratio >= 0.85 THEN 'True' WHEN ratio >= 0.65 THEN 'Mostly True'
    WHEN ratio >= 0.45 THEN 'Misleading' WHEN ratio >= 0.25 THEN 'Exaggerated' ELSE 'False' END AS label,
  CASE WHEN n >= 3 AND high THEN 'High' WHEN n >= 2 OR (n >= 1 AND high) THEN 'Medium' ELSE 'Low' END AS confidence,
  coalesce(s, 0.0) AS support_weight, coalesce(c, 0.0) AS contradict_weight, coalesce(n, 0) AS evidence_count, {_case("best", [(i, t) for i, (t, _) in enumerate(TIERS)])} AS best_tier FROM r)
"""


@query(_RUBRIC + f"SELECT claim_id, label, confidence, support_weight, contradict_weight, evidence_count, best_tier, CAST({_case('label', [(x[0], x[1]) for x in LABELS])} AS DOUBLE) AS numeric_score FROM v")
def rubric_score(spark, sf_dir):
    return rubric.rubric(claims(spark, sf_dir), evidence(spark, sf_dir))


@query(_RUBRIC + f"SELECT claim_id, label, confidence, {_case('label', [(x[0], x[2]) for x in LABELS])} AS explanation, CAST(round_even(support_weight, 0) AS INTEGER) AS support_count, CAST(round_even(contradict_weight, 0) AS INTEGER) AS contradict_count, best_tier AS primary_source_tier FROM v")
def rubric_to_verdict(spark, sf_dir):
    return rubric.to_verdicts(rubric_score(spark, sf_dir))


@query(f"SELECT l_orderkey AS claim_id, {_case('max(l_suppkey % 6)', [(i, t) for i, (t, _) in enumerate(TIERS)])} AS tier FROM lineitem GROUP BY 1")
def llm_tier_worst(spark, sf_dir):
    return rubric.worst_tier(evidence(spark, sf_dir))


@query(_RUBRIC + ", l AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x[0]}')" for i, x in enumerate(LABELS)) + ") t(pos, label)), n AS (SELECT DISTINCT c_nationkey FROM customer JOIN v ON o_custkey = c_custkey) SELECT n.c_nationkey AS nation, l.pos, l.label, count(v.claim_id) AS n FROM n CROSS JOIN l LEFT JOIN (SELECT v.*, c_nationkey FROM v JOIN customer ON o_custkey = c_custkey) v ON v.c_nationkey = n.c_nationkey AND v.label = l.label GROUP BY 1, 2, 3")
def verdict_summary(spark, sf_dir):
    who = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("claim_id"), F.col("c_nationkey").alias("nation"))
    return rubric.summary(rubric_score(spark, sf_dir).join(who, "claim_id"), "nation")


@query(_RUBRIC + "SELECT label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share, CASE WHEN label <> 'Unverifiable' THEN count(*) / sum(count(*) FILTER (label <> 'Unverifiable')) OVER () END AS decided_share FROM v GROUP BY 1".replace("count(*) FILTER (label <> 'Unverifiable')", "CASE WHEN label <> 'Unverifiable' THEN count(*) END"))
def scorecard(spark, sf_dir):
    return rubric.scorecard(rubric_score(spark, sf_dir))


@query(r"""
WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents)
SELECT doc_id, text, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INTEGER) AS word_count FROM n WHERE text <> ''""")
def ingest_normalize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.normalise_space(T.strip_subtitles(F.col("text"))).alias("text"))
    return docs.where("text <> ''").withColumn("word_count", T.word_count(F.col("text")))


_DATED = "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 3 THEN strftime(o_orderdate, '%-d %B %Y') WHEN 4 THEN strftime(o_orderdate, '%-d %b %Y') ELSE 'Smarch 5, 2024 or 13/45/2024' END AS d, CASE WHEN o_orderkey % 6 < 5 THEN CAST(o_orderdate AS DATE) END AS meant, CASE o_orderkey % 3 WHEN 0 THEN 'Remarks at the Town Hall. ' WHEN 1 THEN 'In the Rose Garden ' ELSE '' END AS v FROM orders"


def _dated(spark, sf_dir):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    written = ["MMMM d, yyyy", "yyyy-MM-dd", "M/d/yyyy", "d MMMM yyyy", "d MMM yyyy"]
    forms = F.coalesce(*(F.when(key % 6 == i, F.date_format(day, form)) for i, form in enumerate(written)), F.lit("Smarch 5, 2024 or 13/45/2024"))
    venue = F.when(key % 3 == 0, "Remarks at the Town Hall. ").when(key % 3 == 1, "In the Rose Garden ").otherwise("")
    return table(spark, sf_dir, "orders").select(key.alias("id"), F.concat(venue, F.lit("Given on "), forms, F.lit(" here")).alias("text"))


@query(f"SELECT id, meant AS date FROM ({_DATED})")
def detect_date(spark, sf_dir):
    return _dated(spark, sf_dir).select("id", T.find_date(F.col("text")).alias("date"))


@query(f"SELECT id, coalesce(nullif(regexp_extract(t, '{VENUE_PHRASE}', 1), ''), nullif(regexp_extract(t, '{VENUE_NAME}', 0), '')) AS venue FROM (SELECT id, v || 'Given on ' || d || ' here' AS t FROM ({_DATED}))")
def detect_venue(spark, sf_dir):
    return _dated(spark, sf_dir).select("id", T.find_venue(F.col("text")).alias("venue"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


_CLAIMS = r"(SELECT doc_id, list_transform(list_filter(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 20)[1:3], lambda x: x || '.') AS c FROM documents)"


def _stub_claims(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.claims_of(F.col("text"))).alias("pos", "text"))
    return docs.select("doc_id", "pos", "text")


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, c[i] AS text, substr(c[i], 1, least(100, length(c[i]) - 1)) AS context FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM {_CLAIMS})")
def extract_stub_claims(spark, sf_dir):
    return _stub_claims(spark, sf_dir).withColumn("context", F.expr("substring(text, 1, least(100, length(text) - 1))"))


_HOSTS = ["www.bls.gov/x", "apnews.com/a", "www.nytimes.com/b", "www.politifact.com/c", "www.snopes.com/d", "www.npr.org/e", "example.org/f", "apnews.com/hub/ap-fact-check/g"]


def _urls(spark, sf_dir):
    host = F.element_at(F.array(*map(F.lit, _HOSTS)), (F.pmod("page_id", F.lit(8)) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://"), host, F.lit("?"), "page_id").alias("url"))


_URLS = f"(SELECT page_id, 'https://' || {_case('page_id % 8', list(enumerate(_HOSTS)))} || '?' || page_id AS url FROM pages)"


@query("SELECT page_id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(url), {chr(39)}{d}{chr(39)})' for d in ds)} THEN '{t}'" for t, ds in TIER_DOMAINS) + f" ELSE 'Other' END AS tier FROM {_URLS}")
def classify_tier(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", T.tier_of(F.col("url")).alias("tier"))


@query("SELECT page_id, CASE " + " ".join(f"WHEN contains(url, '{d}') THEN '{n}'" for d, n in FACT_CHECK_NAMES) + f" ELSE 'Fact-Check Outlet' END AS name FROM {_URLS}")
def domain_name(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", fact_check_name().alias("name"))


@query("SELECT item_id, substr(CASE WHEN item_id % 3 = 0 THEN 'data statistics ' ELSE 'fact check ' END || text, 1, 200) AS web_query, substr('(site:politifact.com OR site:factcheck.org OR site:snopes.com) ' || text, 1, 250) AS site_query FROM benchmark")
def search_queries(spark, sf_dir):
    category = F.when(F.col("item_id") % 3 == 0, "jobs").when(F.col("item_id") % 3 == 1, "other")
    return table(spark, sf_dir, "benchmark").select("item_id", web_query(F.col("text"), category).alias("web_query"), site_query(F.col("text")).alias("site_query"))


_WORDED = ["Unemployment", "inflation rose", "GDP", "the deficit", "new jobs", "wages", "nothing"]


@query(f"SELECT claim_id, 'https://fred.stlouisfed.org/series/' || s AS source_url, 'Government' AS source_tier, '[Stub] FRED series ' || s || ' — configure FRED_API_KEY for live data.' AS snippet, 0.7::DOUBLE AS relevance_score FROM (SELECT claim_id, CASE {' '.join(f'WHEN contains(t, {chr(39)}{w}{chr(39)}) THEN {chr(39)}{s}{chr(39)}' for w, s in SERIES)} END AS s FROM (SELECT doc_id AS claim_id, lower({_case('doc_id % 7', list(enumerate(_WORDED)))} || ' ' || text) AS t FROM documents) WHERE regexp_matches(t, '{'|'.join(ECONOMIC_WORDS)}')) WHERE s IS NOT NULL")
def gov_evidence(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, _WORDED)), (F.pmod("doc_id", F.lit(7)) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), F.concat(word, F.lit(" "), "text").alias("text"))
    return gather(rows, [GovernmentData()]).select("claim_id", "source_url", "source_tier", "snippet", "relevance_score")


_KEY = r"substr(sha256(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))), 1, 16)"


@query(f"SELECT doc_id, key, CASE WHEN first <> doc_id THEN first END AS cached FROM (SELECT doc_id, {_KEY} AS key, min(doc_id) OVER (PARTITION BY {_KEY}) AS first FROM documents)")
def cache_exact(spark, sf_dir):
    """Each document's earlier copy, from a cache that has the first document of each key."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), "text")
    held = docs.groupBy(T.cache_key(F.col("text")).alias("key")).agg(F.min("claim_id").alias("verdict_label")).withColumn("expires_at", F.lit(None).cast("timestamp"))
    hits = cache.exact(docs, held, F.current_timestamp())
    return hits.select(F.col("claim_id").alias("doc_id"), "key", F.when(F.col("cached_label") != F.col("claim_id"), F.col("cached_label")).alias("cached"))


@query("SELECT event_id, ts + INTERVAL 90 DAY AS expires_at FROM events WHERE TIMESTAMP '2024-04-15' <= ts + INTERVAL 90 DAY")
def cache_ttl(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("ts") + F.make_dt_interval(F.lit(cache.TTL_DAYS))).alias("expires_at"))
    return rows.where(cache.alive(F.col("expires_at"), F.lit("2024-04-15").cast("timestamp_ntz")))


@query("SELECT user_id AS key, ts AS cached_at, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def cache_upsert(spark, sf_dir):
    """Entries of clicks and views, upserted with those of all other events."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("cached_at"), "event_id", "event_type")
    old = F.col("event_type").isin("click", "view")
    return cache.upsert(rows.where(old), rows.where(~old), ["event_id"]).drop("event_type")


@query()
def cache_fuzzy(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("claim_id"), "text")
    keyed = table(spark, sf_dir, "conversations").select(T.cache_key(F.col("text")).alias("key"), "text", F.timestamp_seconds(F.col("conv_id")).alias("cached_at"))
    # Texts of one key differ in case and outer space only; the first of them is the entry.
    entries = keyed.groupBy("key").agg(F.min("text").alias("text"), F.min("cached_at").alias("cached_at")).withColumn("expires_at", F.lit(None).cast("timestamp"))
    return cache.fuzzy(turns, entries, F.current_timestamp())


_TOK = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda x: x <> ''))"


@query(f"""
WITH e AS (SELECT doc_id * 3 + i - 1 AS pos, c[i] AS text FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM {_CLAIMS})),
g AS (SELECT item_id AS ref_id, {_TOK.format('text')} AS a FROM benchmark), t AS (SELECT pos, text, {_TOK.format('text')} AS b FROM e),
p AS (SELECT ref_id, pos, text, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS sim FROM g, t WHERE len(list_intersect(a, b)) > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY sim DESC, pos) AS n FROM p)
SELECT g.ref_id, b.text AS matched_claim, coalesce(sim, 0.0) AS similarity FROM g LEFT JOIN b ON b.ref_id = g.ref_id AND n = 1""")
def token_jaccard_match(spark, sf_dir):
    gold = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), F.col("text").alias("claim"))
    found = _stub_claims(spark, sf_dir).select((F.col("doc_id") * 3 + F.col("pos")).alias("pos"), "text")
    return evaluate.best_match(gold, found)


@query()
def combined_match(spark, sf_dir):
    gold = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), F.col("text").alias("claim"))
    found = _stub_claims(spark, sf_dir).select((F.col("doc_id") * 3 + F.col("pos")).alias("pos"), "text")
    return evaluate.best_match(gold, found, combined=True).withColumn("matched", F.col("similarity") >= evaluate.THRESHOLD)


_GOLD = ["TRUE", "PARTLY TRUE", "EXAGGERATED", "MISLEADING", "UNSUPPORTED", "FALSE", "FALSE / MISLEADING", "odd"]


@query(_RUBRIC + f", a AS (SELECT claim_id, 1.0 - abs({_case('coalesce(g, 0)', [(i, GOLD_POSITION.get(x, 4)) for i, x in enumerate(_GOLD)])} - CASE WHEN upper(label) = 'TRUE' THEN 0 WHEN label = 'Mostly True' THEN 1 WHEN label ILIKE 'exaggerated' THEN 2 WHEN label ILIKE 'misleading' THEN 3 WHEN label ILIKE 'false' THEN 5 ELSE 4 END) / 5.0::DOUBLE AS score FROM (SELECT claim_id, CASE WHEN claim_id % 3 = 0 THEN upper(label) ELSE label END AS label, claim_id % 8 AS g FROM v)) SELECT claim_id, score, CASE WHEN score >= 0.8 THEN 'YES' WHEN score >= 0.4 THEN '~' ELSE 'NO' END AS bucket FROM a")
def verdict_agreement(spark, sf_dir):
    gold = F.element_at(F.array(*map(F.lit, _GOLD)), (F.pmod("claim_id", F.lit(8)) + 1).cast("int"))
    score = evaluate.agreement(gold, F.when(F.col("claim_id") % 3 == 0, F.upper("label")).otherwise(F.col("label")))
    return rubric_score(spark, sf_dir).select("claim_id", score.alias("score"), evaluate.bucket(score).alias("bucket"))


def _hits(patterns: list[str]) -> str:
    return " + ".join(f"CAST(regexp_matches(text, '(?i){p}') AS INTEGER)" for p in patterns)


@query(f"SELECT doc_id, CASE WHEN text = '' THEN 0.0 ELSE 0.6 * least(({_hits(DATA_SIGNALS)}) / 5.0, 1.0) + 0.4 * least(length(text) / 500.0, 1.0) END::DOUBLE AS score FROM documents")
def explanation_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.explanation_quality(F.col("text")).alias("score"))


@query(f"SELECT doc_id, CASE WHEN text = '' THEN 0.0 ELSE least(({_hits(SOURCE_SIGNALS)}) / 3.0, 1.0) END::DOUBLE AS score FROM documents")
def source_citation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.source_citation(F.col("text")).alias("score"))


@query(
    f"SELECT doc_id, p AS parsimony, 0.25 * (CAST(doc_id % 5 AS DOUBLE) / 4) + 0.30 * (CAST(doc_id % 3 AS DOUBLE) / 2) + 0.20 * q + 0.15 * s + 0.10 * p AS fitness FROM (SELECT doc_id, CASE WHEN n_chars <= 500 THEN 1.0 WHEN n_chars >= 2000 THEN 0.0 ELSE 1.0 - (n_chars - 500) / 1500.0 END::DOUBLE AS p, "
    f"CASE WHEN text = '' THEN 0.0 ELSE 0.6 * least(({_hits(DATA_SIGNALS)}) / 5.0, 1.0) + 0.4 * least(length(text) / 500.0, 1.0) END::DOUBLE AS q, CASE WHEN text = '' THEN 0.0 ELSE least(({_hits(SOURCE_SIGNALS)}) / 3.0, 1.0) END::DOUBLE AS s FROM documents)"
)
def parsimony_fitness(spark, sf_dir):
    p, k = T.parsimony(F.col("n_chars")), F.col("doc_id")
    scored = evaluate.fitness((k % 5).cast("double") / 4, (k % 3).cast("double") / 2, T.explanation_quality(F.col("text")), T.source_citation(F.col("text")), p)
    return table(spark, sf_dir, "documents").select("doc_id", p.alias("parsimony"), scored.alias("fitness"))


def _reports(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").alias("created_at"), F.col("c_name").alias("speaker"))


@query("SELECT o_orderkey AS report_id, o_orderdate AS created_at, c_name AS speaker FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def list_reports_page(spark, sf_dir):
    return publish.page(_reports(spark, sf_dir), 3, 20)


@query("SELECT o_orderkey AS report_id, o_orderdate AS created_at, c_name AS speaker FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(c_name), '01') ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def speaker_filter(spark, sf_dir):
    return publish.page(_reports(spark, sf_dir), 1, 500, "01")


@query("SELECT conv_id, turn, 'at://post/' || conv_id || '/' || turn AS uri, lag('at://post/' || conv_id || '/' || turn) OVER w AS parent, first_value('at://post/' || conv_id || '/' || turn) OVER w AS root, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY n <= 10")
def thread_plan(spark, sf_dir):
    posts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("/", F.lit("at://post"), "conv_id", "turn").alias("uri"))
    return publish.thread(posts, "conv_id", "turn", "uri")


@query(
    _RUBRIC
    + f""", p AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda x: x <> '') AS w, substr(text, 1, 80) AS head,
  {_case('label', [(x[0], x[3]) for x in LABELS], "'•'")} || ' ' || label || ' (' || confidence || ' confidence)' AS line FROM conversations JOIN v ON conv_id = claim_id),
q AS (SELECT *, array_to_string(w, ' ') AS whole, greatest(60, 300 - length(line) - length(head) - 10) AS room FROM p)
SELECT conv_id, turn, substr('"' || CASE WHEN length(whole) <= room THEN whole ELSE array_to_string(w[1:list_max(list_filter(range(0, len(w) + 1), lambda k: length(array_to_string(w[1:k], ' ')) < room))], ' ') || '…' END
  || '"' || chr(10) || chr(10) || line || chr(10) || head, 1, 300) AS post FROM q"""
)
def posts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").join(rubric_score(spark, sf_dir), F.col("conv_id") == F.col("claim_id"))
    return rows.select("conv_id", "turn", publish.verdict_post(F.col("text"), F.col("label"), F.col("confidence"), F.col("text")).alias("post"))


@query("SELECT event_id, 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM events")
def sse_frames(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", publish.frame(F.col("event_type"), F.col("props")).alias("frame"))


@query(f"SELECT claim_id, string_agg('[' || n || '] ' || tier, chr(10) ORDER BY n) AS prompt FROM (SELECT l_orderkey AS claim_id, {_TIER} AS tier, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n <= 10 GROUP BY 1")
def evidence_prompt(spark, sf_dir):
    tier = rubric.lookup(F.pmod("l_suppkey", F.lit(6)).cast("int"), [(i, t) for i, (t, _) in enumerate(TIERS)])
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), tier.alias("tier"), F.row_number().over(w).alias("n")).where("n <= 10")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "tier"))), lambda x: F.format_string("[%d] %s", x["n"], x["tier"]))
    return rows.groupBy("claim_id").agg(F.array_join(lines, "\n").alias("prompt"))


@query("SELECT c_nationkey AS report, string_agg(DISTINCT upper(c_mktsegment[1]) || lower(c_mktsegment[2:]), ', ' ORDER BY upper(c_mktsegment[1]) || lower(c_mktsegment[2:])) AS categories FROM customer GROUP BY 1")
def rss_categories(spark, sf_dir):
    named = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("report"), T.title_case(F.col("c_mktsegment")).alias("category"))
    return named.groupBy("report").agg(F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"))


@query("SELECT o_orderkey AS guid, 'Fact Check: ' || coalesce(c_name, 'Unknown') || ' — ' || strftime(o_orderdate, '%Y-%m-%d') AS title, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S +0000') AS pub_date FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def rss_items(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select(F.col("o_orderkey").alias("guid"), F.concat(F.lit("Fact Check: "), F.coalesce("c_name", F.lit("Unknown")), F.lit(" — "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("title"), F.date_format(F.col("o_orderdate").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss Z").alias("pub_date"))


_LABEL = _case("l_suppkey % 6", [(i, x[0]) for i, x in enumerate(LABELS)])
_SAID = f"chr(10) || '[' || {_LABEL} || '] ' || coalesce(p_name, '(claim not found)') || chr(10) || '  Confidence: ' || {_case('l_linenumber % 3', list(enumerate(CONFIDENCES)))} || chr(10) || '  ' || l_returnflag || chr(10)"


@query(f"""
WITH v AS (SELECT l_orderkey, string_agg(said, '' ORDER BY l_linenumber, said) AS x FROM (SELECT l_orderkey, l_linenumber, {_SAID} AS said FROM lineitem LEFT JOIN part ON p_partkey = l_partkey) GROUP BY 1)
SELECT o_orderkey AS report_id, 'Fact-check report for ' || coalesce(c_name, 'Unknown') || chr(10) || 'Date: ' || strftime(o_orderdate, '%B %d, %Y') || chr(10) || coalesce(x, '') AS text
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN v ON l_orderkey = o_orderkey""")
def rss_content(spark, sf_dir):
    reports = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    reports = reports.select(F.col("o_orderkey").alias("report_id"), F.col("c_name").alias("speaker"), F.col("o_orderdate").alias("date"), F.lit(None).cast("string").alias("venue"))
    label = rubric.lookup(F.pmod("l_suppkey", F.lit(6)).cast("int"), [(i, x[0]) for i, x in enumerate(LABELS)])
    sure = rubric.lookup(F.pmod("l_linenumber", F.lit(3)).cast("int"), list(enumerate(CONFIDENCES)))
    verdicts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_partkey").alias("claim_id"), F.col("l_linenumber").alias("pos"), label.alias("label"), sure.alias("confidence"), F.col("l_returnflag").alias("explanation"))
    return publish.report_text(reports, verdicts, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("claim_id"), F.col("p_name").alias("text")))


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def escape_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


_RUNS = "(SELECT CAST(ts AS DATE) AS gen, CAST(value AS DECIMAL(18,4)) AS v FROM events)"


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("gen"), F.col("value").cast("decimal(18,4)").alias("v"))


@query(f"SELECT gen, CAST(max(v) AS DOUBLE) AS best, CAST(sum(v) AS DOUBLE) / count(*) AS mean, count(*) AS size FROM {_RUNS} GROUP BY 1")
def generation_log(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("gen").agg(F.max("v").cast("double").alias("best"), (F.sum("v").cast("double") / F.count(F.lit(1))).alias("mean"), F.count(F.lit(1)).alias("size"))


@query(f"SELECT gen, CAST(max(b) OVER (ORDER BY gen ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS best_ever FROM (SELECT gen, max(v) AS b FROM {_RUNS} GROUP BY 1)")
def best_ever(spark, sf_dir):
    best = _runs(spark, sf_dir).groupBy("gen").agg(F.max("v").alias("b"))  # a row a generation
    return best.select("gen", F.max("b").over(Window.orderBy("gen").rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("best_ever"))


@query(f"WITH g AS (SELECT gen, CAST(max(v) AS DOUBLE) AS b FROM {_RUNS} GROUP BY 1), e AS (SELECT count(*) AS generations, arg_min(b, gen) AS first_best, arg_max(b, gen) AS last_best FROM g) SELECT *, last_best - first_best AS gained, CASE WHEN first_best > 0 THEN (last_best - first_best) / first_best * 100 END AS percent FROM e")
def run_improvement(spark, sf_dir):
    return evaluate.improvement(generation_log(spark, sf_dir))


@query("SELECT source, CAST(sum(n_chars) AS BIGINT) AS tokens_in, CAST(sum(len(text)) AS BIGINT) AS tokens_out, 15e-6 * sum(n_chars) + 75e-6 * sum(len(text)) AS cost FROM documents GROUP BY 1")
def cost_totals(spark, sf_dir):
    sums = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("tokens_in"), F.sum(F.length("text")).alias("tokens_out"))
    return sums.withColumn("cost", evaluate.cost(F.col("tokens_in"), F.col("tokens_out")))


@query(f"SELECT gen, CAST(c AS DOUBLE) AS cost FROM (SELECT gen, c, coalesce(sum(c) OVER (ORDER BY gen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM (SELECT gen, sum(v) AS c FROM {_RUNS} GROUP BY 1)) WHERE spent < 50000")
def budget_stop(spark, sf_dir):
    costs = _runs(spark, sf_dir).groupBy("gen").agg(F.sum("v").alias("c"))
    spent = F.coalesce(F.sum("c").over(Window.orderBy("gen").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return costs.withColumn("spent", spent).where("spent < 50000").select("gen", F.col("c").cast("double").alias("cost"))


@query("WITH r AS (SELECT o_orderkey AS seen, CAST(o_totalprice AS DECIMAL(18,2)) AS f, o_orderkey % 5 AS persona, o_orderkey % 4 AS tone FROM orders), l AS (SELECT seen, f, 'persona' AS gene, persona AS choice FROM r UNION ALL SELECT seen, f, 'tone', tone FROM r), m AS (SELECT gene, choice, CAST(sum(f) AS DOUBLE) / count(*) AS mean, min(seen) AS first, count(*) AS n FROM l GROUP BY 1, 2) SELECT gene, choice AS best_choice, round(mean, 2) AS best_mean, n AS runs FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY mean DESC, first) AS k FROM m) WHERE k = 1")
def gene_importance(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seen"), F.col("o_totalprice").alias("fitness"), (F.col("o_orderkey") % 5).alias("persona"), (F.col("o_orderkey") % 4).alias("tone"))
    return evolve.importance(runs, ["persona", "tone"]).withColumn("best_mean", F.round("best_mean", 2))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def top5(spark, sf_dir):
    return evolve.best(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 5, "o_totalprice", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2")
def elites(spark, sf_dir):
    return evolve.elites(table(spark, sf_dir, "orders"), "o_custkey", 2, "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT p_partkey, substr(sha256(concat_ws('-', p_partkey % 5, p_partkey % 4, p_size % 3)), 1, 16) AS hash FROM part")
def genome_hash(spark, sf_dir):
    genes = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 5).alias("a"), (F.col("p_partkey") % 4).alias("b"), (F.col("p_size") % 3).alias("c"))
    return genes.select("p_partkey", evolve.genome_hash(["a", "b", "c"]).alias("hash"))


#: Populations of a dozen parts each, whose genes and fitness are the parts'.
def _genomes(spark, sf_dir):
    key = F.col("p_partkey")
    genes = [F.pmod(F.col("p_partkey") * (i + 3) + F.col("p_size"), F.lit(evolve.SIZES[g])).cast("int").alias(g) for i, g in enumerate(evolve.GENES)]
    return table(spark, sf_dir, "part").select(F.floor(key / 12).alias("island"), (key % 12).alias("slot"), *genes, F.col("p_retailprice").alias("fitness"))


def _draw(*parts: str) -> str:
    return "CAST(('0x' || substr(md5(concat_ws('|', 7, 1, " + ", ".join(parts) + ")), 1, 8)) AS BIGINT) % 2147483648"


@query(
    f"""WITH base AS (SELECT p_partkey // 12 AS island, p_partkey % 12 AS slot, p_partkey, p_size, p_retailprice AS fitness FROM part),
g(gene, i, size) AS (VALUES {", ".join(f"('{g}', {i}, {evolve.SIZES[g]})" for i, g in enumerate(evolve.GENES))}),
genes AS (SELECT island, slot, gene, size, (p_partkey * (i + 3) + p_size) % size AS choice FROM base, g),
ranked AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY fitness DESC, slot) - 1 AS r FROM base),
kids AS (SELECT island, r AS child, (r - 2) // 2 AS pair, (r - 2) % 2 AS twin FROM ranked WHERE r >= 2),
drawn AS (SELECT p.island, p.pair, side, b.slot, b.fitness, row_number() OVER (PARTITION BY p.island, p.pair, side ORDER BY {_draw("p.island", "p.pair", "b.slot", "side")}, b.slot) AS n
  FROM (SELECT DISTINCT island, pair FROM kids) p JOIN base b ON b.island = p.island, (VALUES ('a'), ('b')) s(side)),
parents AS (SELECT island, pair, side, slot FROM drawn WHERE n <= 3 QUALIFY row_number() OVER (PARTITION BY island, pair, side ORDER BY fitness DESC, slot) = 1),
crossed AS (SELECT k.island, k.child, g.gene, g.size, CASE WHEN ({_draw("k.island", "k.pair", "g.gene", "'cross'")} < 1073741824) = (twin = 0) THEN x.choice ELSE y.choice END AS choice
  FROM kids k, g JOIN parents a ON a.island = k.island AND a.pair = k.pair AND a.side = 'a' JOIN parents b ON b.island = k.island AND b.pair = k.pair AND b.side = 'b'
  JOIN genes x ON x.island = k.island AND x.slot = a.slot AND x.gene = g.gene JOIN genes y ON y.island = k.island AND y.slot = b.slot AND y.gene = g.gene),
grown AS (SELECT island, child AS slot, gene, CASE WHEN {_draw("island", "child", "gene", "'mutate'")} < 0.2 * 2147483648 THEN (choice + 1 + ({_draw("island", "child", "gene", "'to'")}) % (size - 1)) % size ELSE choice END AS choice FROM crossed
  UNION ALL SELECT e.island, e.r, gene, choice FROM ranked e JOIN genes USING (island, slot) WHERE e.r < 2)
SELECT island, slot, {", ".join(f"max(CASE WHEN gene = '{g}' THEN choice END) AS {g}" for g in evolve.GENES)} FROM grown GROUP BY island, slot"""
)
def ga_step(spark, sf_dir):
    """One generation of all populations."""
    return evolve.breed(_genomes(spark, sf_dir), generation=1, seed=7)


@query("SELECT conv_id, count(*) AS total_claims, count(*) FILTER (role = 'user') AS checkable_claims FROM conversations GROUP BY 1")
def claim_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("total_claims"), F.count_if(F.col("role") == "user").alias("checkable_claims"))


@query(_RUBRIC + "SELECT o_custkey AS report_id, to_json(list({'claim_id': claim_id, 'label': label, 'confidence': confidence} ORDER BY claim_id)) AS verdicts FROM v GROUP BY 1")
def report_json(spark, sf_dir):
    rows = rubric_score(spark, sf_dir).join(claims(spark, sf_dir).select("claim_id", F.col("o_custkey").alias("report_id")), "claim_id")
    return rows.groupBy("report_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("claim_id", "label", "confidence")))).alias("verdicts"))
