"""Search and quality analytics: queries over blocks, documents and events (value as latency, event_type as outcome)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.stem import stems_udf
from weftline.operators import crawl as W
from weftline.operators import evidence as V
from weftline.operators import score as S
from weftline.operators import search as Q
from weftline.operators import stats as A
from weftline.plans.corpus_queries import _B, _blocks
from weftline.sources.tables import table

KEY = ["doc_id", "version", "idx"]
AND, OR, PHRASE, PREFIX = "settlement offers", 'dividends OR "harbour hotels"', '"settlement offers"', "settle*"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def search_and(spark, d):
    return Q.matching(_blocks(spark, d), KEY, "text", AND)


def search_or(spark, d):
    return Q.matching(_blocks(spark, d), KEY, "text", OR)


def search_phrase(spark, d):
    return Q.matching(_blocks(spark, d), KEY, "text", PHRASE)


def search_prefix(spark, d):
    return Q.matching(_blocks(spark, d), KEY, "text", PREFIX)


def search_bm25(spark, d):
    scored = Q.bm25(_blocks(spark, d), KEY, "text", "title", AND.split()).withColumn("score", F.round("score", 6))
    return Q.top(scored, KEY, 10)


def search_latest(spark, d):
    scored = Q.bm25(_blocks(spark, d), KEY, "text", "title", AND.split()).withColumn("score", F.round("score", 6))
    last = table(spark, d, "versions").groupBy("doc_id").agg(F.max("version").alias("version"))
    return scored.join(last, ["doc_id", "version"]).select(*KEY, "score")


def term_statistics(spark, d):
    p = Q.postings(_blocks(spark, d).select(*KEY, "text"), KEY, "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).cast("bigint").alias("tf"))


def title_overlap(spark, d):
    docs = table(spark, d, "documents").where("title IS NOT NULL AND text IS NOT NULL").select("doc_id", T.ascii_tokens(F.col("title")).alias("a"), T.ascii_tokens(F.col("text")).alias("b"))
    out = S.token_overlap(docs, "doc_id", F.col("a"), F.col("b"))
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def passage_recall(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL AND title IS NOT NULL")
    return docs.select("doc_id", F.col("text").contains(F.col("title")).alias("holds_title"), (F.locate("\n", "text") - 1).alias("first_break"))


def duplicate_texts(spark, d):
    h = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    g = h.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return g.select("first_id", "copies")


def latency_ranks(spark, d):
    e = _events(spark, d)
    counts = e.groupBy("event_type").agg(F.count("*").alias("n"))
    return A.nearest_ranks(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).join(counts, "event_type")


def outcome_rates(spark, d):
    e = _events(spark, d)
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("event_type") != "error").cast("double")), 6).alias("success_rate"), F.round(F.avg(F.when(F.col("event_type") != "error", F.col("value"))), 6).alias("mean_value"), F.count_if(F.col("value") < 5).alias("quick"))


def first_vs_warm(spark, d):
    by = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = _events(spark, d).withColumn("rep", F.row_number().over(by))
    ranks = A.nearest_ranks(e.withColumn("first", F.col("rep") == 1), ["event_type", "first"], "value", {"p50": 0.5})
    return ranks.groupBy("event_type").agg(F.max(F.when(F.col("first"), F.col("p50"))).alias("first_p50"), F.max(F.when(~F.col("first"), F.col("p50"))).alias("warm_p50"))


def split_groups(spark, d):
    e = _events(spark, d).withColumn("split", F.explode(F.array(F.lit("all"), F.when(F.col("user_id") % 5 == 0, "held out").otherwise("dev"))))
    return e.groupBy("event_type", "split").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def cost_by_unit(spark, d):
    e = _events(spark, d).withColumn("unit", F.when(F.col("k") % 2 == 0, "credit").otherwise("token"))
    g = e.groupBy("event_type", "unit").agg(F.round(F.sum("value"), 3).alias("amount"), F.bool_or(F.col("k") > 95).alias("estimated"))
    return g.groupBy("event_type").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "unit", F.col("estimated").cast("string")))), ";").alias("units"), F.round(F.sum("amount"), 3).alias("total"))


def kind_counts(spark, d):
    g = _events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return g.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.col("event_type"), F.lit("="), F.col("n").cast("string")))), ", ").alias("kinds"))


def common_cases(spark, d):
    e = _events(spark, d)
    every = e.agg(F.count_distinct("event_type")).scalar()
    return e.groupBy("k").agg(F.count_distinct("event_type").alias("kinds")).where(F.col("kinds") == every)


def paired_deltas(spark, d):
    e = _events(spark, d)
    out = A.paired(e, "event_type", "click", "view", ["user_id", "k"], "value")
    return out.select("user_id", "k", *[F.round(c, 6).alias(c) for c in ("a", "b", "delta", "ratio")])


def profile_pairs(spark, d):
    t = _events(spark, d).select("event_type").distinct()
    return t.select(F.col("event_type").alias("left_kind")).join(t.select(F.col("event_type").alias("right_kind")), F.expr("left_kind < right_kind"))


def leader_ties(spark, d):
    g = _events(spark, d).groupBy("k", "event_type").agg(F.count("*").alias("n"))
    by = Window.partitionBy("k")
    ranked = g.withColumns({"best": F.max("n").over(by), "second": F.expr("nth_value(n, 2) OVER (PARTITION BY k ORDER BY n DESC, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")})
    return ranked.where("n = best").groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("event_type")), ",").alias("leaders"), F.max("best").alias("best"), F.max(F.col("best") - F.col("second")).alias("margin"))


def bootstrap_interval(spark, d):
    e = _events(spark, d).where("event_type = 'purchase'").select(F.col("user_id").alias("case_id"), F.floor(F.col("value") * 100).cast("double").alias("value"))
    out = A.cluster_bootstrap(e, "case_id", "value")
    return out.select(F.round("value", 6).alias("value"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "cases", "attempts")


def peak_resources(spark, d):
    e = _events(spark, d).withColumn("hour", F.date_trunc("hour", "ts"))
    per = e.groupBy("hour", "event_type").agg(F.sum("value").alias("total"))
    cpu = e.groupBy("event_type", "user_id").agg((F.max_by("k", F.struct("ts", "event_id")) - F.min_by("k", F.struct("ts", "event_id"))).alias("used"))
    return per.groupBy("event_type").agg(F.round(F.max("total"), 6).alias("peak")).join(cpu.groupBy("event_type").agg(F.sum("used").alias("cpu")), "event_type")


def running_budget(spark, d):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = _events(spark, d).withColumn("cents", F.floor(F.col("value") * 100).cast("bigint"))
    return e.withColumn("spent", F.coalesce(F.sum("cents").over(by), F.lit(0))).where("spent < 20000").select("event_id", "spent")


def stable_signatures(spark, d):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, d).withColumn("changed", F.coalesce((F.col("event_type") != F.lag("event_type").over(by)).cast("int"), F.lit(1)))
    e = e.withColumn("run", F.sum("changed").over(by))
    return e.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event")).where("n >= 3").select("user_id", "first_event", "n")


def task_generation(spark, d):
    kinds = _events(spark, d).select("event_type").distinct()
    return kinds.join(table(spark, d, "region").select("r_name")).join(spark.range(1, 4).select(F.col("id").alias("repetition"))).select("event_type", "r_name", "repetition")


def strategy_rates(spark, d):
    v = table(spark, d, "versions").select("doc_id", "version", "strategy", "backend", "http_status", F.length("markdown").alias("chars")).distinct()
    v = v.fillna("", ["strategy", "backend"])
    rates = v.groupBy("strategy", "backend").agg(F.count("*").alias("n"), F.round(F.avg((F.col("http_status") < 300).cast("double")), 6).alias("ok_rate"))
    return rates.join(A.nearest_ranks(v, ["strategy", "backend"], "chars", {"median_chars": 0.5}), ["strategy", "backend"], "left")


def stemmed_terms(spark, d):
    b = _blocks(spark, d).select(F.explode(stems_udf(F.col("text"))).alias("stem"))
    return b.groupBy("stem").agg(F.count("*").alias("n"))


def evidence_status(spark, d):
    b = _blocks(spark, d)
    capitals = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    heads = b.where("block_type = 'heading'").select("doc_id", "version", F.col("block_id").alias("field"), F.col("text").alias("value"), capitals.alias("quote"))
    titles = b.where("level = 1").select("doc_id", "version", F.lit("title").alias("field"), F.col("title").alias("value"), F.concat("title", F.lit("?")).alias("quote"))
    return V.evidence(heads.unionByName(titles).groupBy("doc_id", "version", "field").agg(F.max("value").alias("value"), F.max("quote").alias("quote")), b)


def heading_texts(spark, d):
    v = table(spark, d, "versions").select("doc_id", "version", "markdown").dropDuplicates(["doc_id", "version"])
    return v.select("doc_id", "version", F.posexplode(S.heading_texts(F.col("markdown"))).alias("at", "heading")).select("doc_id", "version", (F.col("at") + 1).alias("nth"), "heading")


def heading_recall(spark, d):
    """Of the headings among a version's blocks, how many its Markdown has as headings."""
    want = _blocks(spark, d).where("block_type = 'heading'").groupBy("doc_id", "version").agg(F.collect_list("text").alias("wanted"))
    v = table(spark, d, "versions").select("doc_id", "version", "markdown").where("markdown IS NOT NULL").dropDuplicates(["doc_id", "version"]).join(want, ["doc_id", "version"])
    out = S.recall_fractions(v.withColumn("key", F.struct("doc_id", "version")), "key", "markdown", {"headings": "wanted", "passages": "wanted"})
    return out.select("key.doc_id", "key.version", F.round("headings", 6).alias("headings"), F.round("passages", 6).alias("passages"))


def crawl_pages(spark, d):
    return W.materialized(table(spark, d, "crawl_urls"), table(spark, d, "versions")).select("crawl_id", "doc_id", "version", "url", F.length("markdown").alias("chars"))


def prompt_budget(spark, d):
    return V.prompt_lines(_blocks(spark, d), 1000).groupBy("doc_id", "version").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


_E = "(SELECT event_id, ts, user_id, event_type, value, (props->>'$.k')::BIGINT AS k FROM events)"
_W = "' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ') || ' '"
_BM25 = f"""
    WITH u AS (SELECT doc_id, version, idx, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w, regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+') AS h FROM {_B}),
    c AS (SELECT doc_id, version, idx, len(w) + len(h) AS dl, len(list_filter(w, lambda x: x = 'settlement')) AS w0, len(list_filter(h, lambda x: x = 'settlement')) AS h0, len(list_filter(w, lambda x: x = 'offers')) AS w1, len(list_filter(h, lambda x: x = 'offers')) AS h1 FROM u),
    s AS (SELECT count(*) AS n, avg(dl) AS mean, count(*) FILTER (w0 + h0 > 0) AS d0, count(*) FILTER (w1 + h1 > 0) AS d1 FROM c)
    SELECT doc_id, version, idx, round(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * (w0 + 0.5 * h0) * 2.2 / ((w0 + 0.5 * h0) + 1.2 * (0.25 + 0.75 * dl / mean)) + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * (w1 + 0.5 * h1) * 2.2 / ((w1 + 0.5 * h1) + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score
    FROM c, s WHERE w0 + h0 > 0 AND w1 + h1 > 0"""


def _mul(a: str, b: str) -> str:
    return f"((((({a}) & 65535) * ({b})) + ((((({a}) >> 16) * ({b})) & 65535) << 16)) & 4294967295)"


QUERIES = {f.__name__: f for f in (search_and, search_or, search_phrase, search_prefix, search_bm25, search_latest, term_statistics, title_overlap, passage_recall, duplicate_texts, latency_ranks, outcome_rates, first_vs_warm, split_groups, cost_by_unit, kind_counts, common_cases, paired_deltas, profile_pairs, leader_ties, bootstrap_interval, peak_resources, running_budget, stable_signatures, task_generation, strategy_rates, stemmed_terms, evidence_status, heading_texts, heading_recall, crawl_pages, prompt_budget)}

_LEVEL = "lower(trim(regexp_replace(@, '[\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+', ' ', 'g'), ' '))"

SQL = {
    "evidence_status": f"""
        WITH b AS (SELECT DISTINCT doc_id, version, idx, block_id, text FROM {_B}),
        h AS (SELECT doc_id, version, block_id AS field, text AS value, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS quote FROM {_B} WHERE block_type = 'heading' UNION ALL SELECT doc_id, version, 'title', title, title || '?' FROM {_B} WHERE level = 1),
        c AS (SELECT doc_id, version, field, max(value) AS value, max(quote) AS quote FROM h GROUP BY ALL),
        j AS (SELECT c.*, min(idx) FILTER (value IS NOT NULL AND quote <> '' AND contains({_LEVEL.replace("@", "text")}, {_LEVEL.replace("@", "quote")})) AS at_idx FROM c LEFT JOIN b USING (doc_id, version) GROUP BY ALL)
        SELECT j.doc_id, j.version, field, CASE WHEN value IS NULL THEN 'missing' WHEN at_idx IS NULL THEN 'unsupported' ELSE 'supported' END AS status, b.block_id FROM j LEFT JOIN b ON b.doc_id = j.doc_id AND b.version = j.version AND b.idx = at_idx""",
    "heading_texts": """
        WITH v AS (SELECT DISTINCT doc_id, version, string_split(markdown, chr(10)) AS l FROM versions),
        h AS (SELECT doc_id, version, list_filter(list_transform(l, lambda x, i: CASE WHEN regexp_matches(x, '^#{1,6} ') THEN trim(regexp_replace(x, '^#{1,6} +| +#+ *$', '', 'g'))
            WHEN regexp_matches(coalesce(l[i + 1], ''), '^(=+|-+) *$') AND trim(x) <> '' AND NOT regexp_matches(x, '^\\s*([-*+]|\\d+[.)]) |^(=+|-+) *$') THEN trim(x) END), lambda x: x IS NOT NULL) AS h FROM v)
        SELECT doc_id, version, unnest(generate_series(1, len(h)))::INT AS nth, unnest(h) AS heading FROM h""",
    "crawl_pages": "SELECT crawl_id, doc_id, version, url, length(markdown)::INT AS chars FROM (SELECT crawl_id, doc_id, version, arg_min(url, seq) AS url FROM crawl_urls WHERE state = 'done' AND doc_id IS NOT NULL AND version IS NOT NULL GROUP BY ALL) JOIN (SELECT DISTINCT doc_id, version, markdown FROM versions) USING (doc_id, version)",
    "search_and": f"SELECT doc_id, version, idx FROM {_B} WHERE contains({_W}, ' settlement ') AND contains({_W}, ' offers ')",
    "search_or": f"SELECT doc_id, version, idx FROM {_B} WHERE contains({_W}, ' dividends ') OR contains({_W}, ' harbour hotels ')",
    "search_phrase": f"SELECT doc_id, version, idx FROM {_B} WHERE contains({_W}, ' settlement offers ')",
    "search_prefix": f"SELECT doc_id, version, idx FROM {_B} WHERE contains({_W}, ' settle')",
    "search_bm25": f"{_BM25} ORDER BY score DESC, doc_id, version, idx LIMIT 10",
    "search_latest": f"SELECT b.* FROM ({_BM25}) b JOIN (SELECT doc_id, max(version) AS version FROM versions GROUP BY doc_id) USING (doc_id, version)",
    "term_statistics": f"SELECT term, count(DISTINCT (doc_id, version, idx)) AS df, count(*) AS tf FROM (SELECT doc_id, version, idx, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM {_B}) GROUP BY term",
    "title_overlap": """
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(title), '[a-z0-9]+') AS a, regexp_extract_all(lower(text), '[a-z0-9]+') AS b FROM documents WHERE title IS NOT NULL AND text IS NOT NULL),
        o AS (SELECT doc_id, w, count(*) AS o FROM (SELECT doc_id, unnest(a) AS w FROM d) GROUP BY ALL), g AS (SELECT doc_id, w, count(*) AS g FROM (SELECT doc_id, unnest(b) AS w FROM d) GROUP BY ALL),
        s AS (SELECT doc_id, sum(least(coalesce(o, 0), coalesce(g, 0))) AS both_n, sum(coalesce(o, 0)) AS o, sum(coalesce(g, 0)) AS g FROM o FULL JOIN g USING (doc_id, w) GROUP BY doc_id),
        p AS (SELECT doc_id, CASE WHEN o > 0 AND g > 0 THEN both_n / o ELSE 0 END AS precision, CASE WHEN o > 0 AND g > 0 THEN both_n / g ELSE 0 END AS recall FROM s)
        SELECT doc_id, round(precision::DOUBLE, 6) AS precision, round(recall::DOUBLE, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END::DOUBLE, 6) AS f1 FROM p""",
    "passage_recall": "SELECT doc_id, contains(text, title) AS holds_title, (instr(text, chr(10)) - 1)::INT AS first_break FROM documents WHERE text IS NOT NULL AND title IS NOT NULL",
    "duplicate_texts": "SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "latency_ranks": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, count(*) AS n FROM events GROUP BY event_type",
    "outcome_rates": "SELECT user_id, count(*) AS n, round(avg((event_type <> 'error')::INT), 6) AS success_rate, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_value, count(*) FILTER (value < 5) AS quick FROM events GROUP BY user_id",
    "first_vs_warm": "SELECT event_type, quantile_disc(value, 0.5) FILTER (rep = 1) AS first_p50, quantile_disc(value, 0.5) FILTER (rep >= 2) AS warm_p50 FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rep FROM events) GROUP BY event_type",
    "split_groups": "SELECT event_type, split, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT *, unnest(['all', CASE WHEN user_id % 5 = 0 THEN 'held out' ELSE 'dev' END]) AS split FROM events) GROUP BY event_type, split",
    "cost_by_unit": f"SELECT event_type, string_agg(unit || ':' || estimated::VARCHAR, ';' ORDER BY unit) AS units, round(sum(amount), 3) AS total FROM (SELECT event_type, CASE WHEN k % 2 = 0 THEN 'credit' ELSE 'token' END AS unit, round(sum(value), 3) AS amount, bool_or(k > 95) AS estimated FROM {_E} GROUP BY ALL) GROUP BY event_type",
    "kind_counts": "SELECT user_id, string_agg(event_type || '=' || n, ', ' ORDER BY event_type || '=' || n) AS kinds FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id",
    "common_cases": f"SELECT k, count(DISTINCT event_type) AS kinds FROM {_E} GROUP BY k HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)",
    "paired_deltas": f"SELECT user_id, k, round(a, 6) AS a, round(b, 6) AS b, round(a - b, 6) AS delta, round(CASE WHEN b > 0 THEN a / b END, 6) AS ratio FROM (SELECT user_id, k, avg(value) AS a FROM {_E} WHERE event_type = 'click' GROUP BY ALL) FULL JOIN (SELECT user_id, k, avg(value) AS b FROM {_E} WHERE event_type = 'view' GROUP BY ALL) USING (user_id, k)",
    "profile_pairs": "SELECT a.event_type AS left_kind, b.event_type AS right_kind FROM (SELECT DISTINCT event_type FROM events) a JOIN (SELECT DISTINCT event_type FROM events) b ON a.event_type < b.event_type",
    "leader_ties": f"""
        WITH g AS (SELECT k, event_type, count(*) AS n FROM {_E} GROUP BY ALL), r AS (SELECT *, max(n) OVER (PARTITION BY k) AS best, nth_value(n, 2) OVER (PARTITION BY k ORDER BY n DESC, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM g)
        SELECT k, string_agg(event_type, ',' ORDER BY event_type) AS leaders, max(best) AS best, max(best - second) AS margin FROM r WHERE n = best GROUP BY k""",
    "bootstrap_interval": f"""
        WITH o AS (SELECT user_id AS case_id, floor(value * 100)::DOUBLE AS value FROM events WHERE event_type = 'purchase'),
        s AS (SELECT case_id, sum(value) AS total, count(*) AS n, row_number() OVER (ORDER BY case_id) - 1 AS pick FROM o GROUP BY case_id),
        c AS (SELECT count(*)::BIGINT AS cases FROM s),
        r AS (SELECT id // cases AS draw, cases, ((424242 + (id + 1) * 1831565813) & 4294967295)::BIGINT AS s FROM c, (SELECT unnest(range(0, 2000 * (SELECT count(*) FROM s))) AS id)),
        t1 AS (SELECT draw, cases, {_mul("xor(s, s >> 15)", "(s | 1)")} AS t FROM r),
        t2 AS (SELECT draw, cases, xor(t, (t + {_mul("xor(t, t >> 7)", "(t | 61)")}) & 4294967295) AS t FROM t1),
        p AS (SELECT draw, floor(xor(t, t >> 14) / 4294967296.0::DOUBLE * cases)::BIGINT AS pick FROM t2),
        m AS (SELECT draw, sum(total) / sum(n) AS mean FROM p JOIN s USING (pick) GROUP BY draw)
        SELECT round((SELECT sum(total) / sum(n) FROM s), 6) AS value, round(quantile_disc(mean, 0.025), 6) AS low, round(quantile_disc(mean, 0.975), 6) AS high, (SELECT cases FROM c) AS cases, (SELECT sum(n)::BIGINT FROM s) AS attempts FROM m""",
    "peak_resources": f"""
        SELECT event_type, round(peak, 6) AS peak, cpu FROM (SELECT event_type, max(total) AS peak FROM (SELECT date_trunc('hour', ts) AS h, event_type, sum(value) AS total FROM events GROUP BY ALL) GROUP BY event_type)
        JOIN (SELECT event_type, sum(used)::BIGINT AS cpu FROM (SELECT event_type, user_id, arg_max(k, (ts, event_id)) - arg_min(k, (ts, event_id)) AS used FROM {_E} GROUP BY ALL) GROUP BY event_type) USING (event_type)""",
    "running_budget": "SELECT event_id, spent FROM (SELECT event_id, coalesce(sum(floor(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent FROM events) WHERE spent < 20000",
    "stable_signatures": "SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS changed FROM events)) GROUP BY user_id, run HAVING count(*) >= 3",
    "task_generation": "SELECT event_type, r_name, repetition FROM (SELECT DISTINCT event_type FROM events), region, (SELECT unnest([1, 2, 3])::BIGINT AS repetition)",
    "prompt_budget": f"""
        WITH l AS (SELECT doc_id, version, idx, block_id, '[' || block_id || '] ' || text AS line FROM {_B}),
        u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id, version ORDER BY idx) AS until FROM l),
        b AS (SELECT *, until - length(line) - 1 AS before FROM u)
        SELECT doc_id, version, count(*) AS lines, sum(least(length(line), 1000 - before))::BIGINT AS chars FROM b WHERE until <= 1001 OR (1000 - before > length(block_id) + 3 AND before <= 1000) GROUP BY ALL""",
    "strategy_rates": "SELECT coalesce(strategy, '') AS strategy, coalesce(backend, '') AS backend, count(*) AS n, round(avg((http_status < 300)::INT), 6) AS ok_rate, quantile_disc(chars, 0.5)::INT AS median_chars FROM (SELECT DISTINCT doc_id, version, strategy, backend, http_status, length(markdown) AS chars FROM versions) GROUP BY ALL",
}
