"""Queries over the stored tables and run records: retention, reading on, outcomes, reports, redirects, stemmed search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import format as T
from weftline.functions.urls import normalize_url
from weftline.operators import corpus as C
from weftline.operators import crawl as W
from weftline.operators import outcome as O
from weftline.operators import report as R
from weftline.operators import search as Q
from weftline.plans.corpus_queries import _B, _F, _blocks, _crawl, _fetches, _versions
from weftline.plans.quality_queries import _events
from weftline.sources import dispatch
from weftline.sources.tables import table

KEY = ["doc_id", "version", "idx"]
CUT = "2023-06-01"


def slices_at(spark, d):
    """Reads on from the recorded offset of each request."""
    v = table(spark, d, "versions").select("doc_id", "version", "markdown").where("markdown IS NOT NULL").dropDuplicates(["doc_id", "version"])
    s = table(spark, d, "slices").select("request_id", "doc_id", "version", F.coalesce("max_chars", F.lit(24000)).alias("max_chars"), F.col("next_offset").alias("offset")).distinct()
    s = s.join(v.groupBy("doc_id").agg(F.max("version").alias("latest")), "doc_id").select("request_id", "doc_id", F.coalesce("version", "latest").alias("version"), "max_chars", "offset")
    return C.slice_bounds(s, v, table(spark, d, "blocks"))


def block_select(spark, d):
    return C.selected_blocks(_blocks(spark, d), "b2, b5,b9-b7").select("doc_id", "version", "block_id")


def snapshot_scan(spark, d):
    f = _fetches(spark, d).where("raw_hash IS NOT NULL AND body IS NOT NULL").select("raw_hash", "content_type", "body", "arrival")
    return C.first_wins(f, ["raw_hash"], "arrival").select("raw_hash", "content_type", F.octet_length("body").cast("bigint").alias("bytes"), F.md5("body").alias("digest"))


def prune_by_age(spark, d):
    v = table(spark, d, "versions").select("doc_id", "version", "fetched_at").dropDuplicates(["doc_id", "version"])
    return C.retained(v, 2, CUT).select("doc_id", "version")


def prune_snapshots(spark, d):
    v = table(spark, d, "versions").select("doc_id", "version", "snapshot_hash").dropDuplicates(["doc_id", "version"])
    return C.dropped_snapshots(v, "old").select("doc_id", "version", "snapshot_hash")


def delete_cascade(spark, d):
    """What is left of each table when the documents with a version 3 are deleted."""
    v = _versions(spark, d)
    tables = {"versions": v, "blocks": _blocks(spark, d), "aliases": table(spark, d, "aliases").distinct(), "snapshots": _fetches(spark, d).where("raw_hash IS NOT NULL").select("raw_hash").distinct()}
    left = C.deleted(tables, v.where("version = 3"))
    out = None
    for name, t in left.items():
        n = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def export_raw(spark, d):
    f = _fetches(spark, d).where("raw_hash IS NOT NULL AND body IS NOT NULL").select("raw_hash", "content_type", "body", "arrival")
    raw = C.first_wins(f, ["raw_hash"], "arrival").select("raw_hash", C.raw_text(F.col("body")).alias("raw"))
    return _versions(spark, d).select("doc_id", "version", "raw_hash").join(raw, "raw_hash", "left").select("doc_id", "version", F.length("raw").cast("bigint").alias("raw_chars"), F.md5(F.col("raw")).alias("digest"))


def upsert_aliases(spark, d):
    return C.upserted(table(spark, d, "fetch_log"))["aliases"]


def upsert_snapshots(spark, d):
    return C.upserted(table(spark, d, "fetch_log"), "latest")["snapshots"].select("raw_hash", F.octet_length("body").cast("bigint").alias("bytes"))


def documents_page(spark, d):
    from weftline.corpus import Corpus

    return Corpus.open(spark, d).documents(20, 10).select("doc_id", "latest_version", "versions", "updated_at")


def duplicate_contents(spark, d):
    """Versions whose content another document had first."""
    v = table(spark, d, "versions").select("doc_id", "version", "content_hash", "fetched_at").where("content_hash IS NOT NULL").dropDuplicates(["doc_id", "version"])
    first = v.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"))
    return v.join(first, "content_hash").where("doc_id <> first_doc").select("doc_id", "version", "first_doc")


def fetch_errors(spark, d):
    """Codes of failed fetches of crawls, their kinds, and whether to try again."""
    c = _crawl(spark, d).where("state = 'failed'")
    code = F.coalesce("reason", F.lit("unknown"))
    # the frontier keeps no status, so that an http_error alone is no reason
    again = F.coalesce(O.retryable(code, F.lit(None).cast("int")), F.lit(False))
    return c.select("crawl_id", "url", O.error_kind(code).alias("kind"), again.alias("again"))


def envelopes(spark, d):
    v = table(spark, d, "versions").select("doc_id", "version", "raw_hash", "meta.warnings").dropDuplicates(["doc_id", "version"])
    cut = table(spark, d, "fetch_log").where("raw_hash IS NOT NULL").groupBy("raw_hash").agg(F.max("input_truncated").alias("cut"))
    j = v.join(cut, "raw_hash", "left")
    status, reasons = O.envelope_status(F.col("cut"), F.transform(F.col("warnings"), lambda w: F.when(w.contains("cut"), F.concat(F.lit("partial: "), w)).otherwise(w)))
    return j.select("doc_id", "version", status.alias("status"), F.array_join(reasons, ",").alias("reasons"))


def stats_totals(spark, d):
    v = table(spark, d, "versions").select("doc_id", "version", "meta.stats").dropDuplicates(["doc_id", "version"]).select("doc_id", O.rounded_timings(F.col("stats")).alias("stats"))
    return O.summed_timings(v, "doc_id", "stats").withColumn("total", F.round("total", 1))


def candidate_choice(spark, d):
    """The candidate that a URL's fetches give: the rendered one or the plain one."""
    f = _fetches(spark, d).where("final_url IS NOT NULL")
    pages = f.select("final_url", (F.col("backend") != "http").alias("rendered"), (F.col("http_status").between(200, 299) & F.col("body").isNotNull()).alias("ok"), F.octet_length("body").cast("bigint").alias("chars"))
    return O.chosen(pages, "final_url")


def url_policy(spark, d):
    return _crawl(spark, d).select("url").distinct().select("url", O.url_violation(F.col("url")).alias("violation"))


def page_keys(spark, d):
    return _crawl(spark, d).select("url").distinct().select("url", T.page_key(F.col("url")).alias("key"))


def formatted_cells(spark, d):
    v = _versions(spark, d)
    return v.select("doc_id", "version", T.csv_cell(F.col("title")).alias("csv"), T.escape_html(F.col("title")).alias("html"), T.markdown_cell(F.col("title")).alias("cell"), T.slug(F.col("title")).alias("slug"))


def gold_texts(spark, d):
    f = _fetches(spark, d).where("body IS NOT NULL")
    return f.select("arrival", F.md5(T.gold_text(F.decode("body", "ISO-8859-1"))).alias("digest"))


def sniffed_kinds(spark, d):
    """The kind of each body by its first bytes alone."""
    return _fetches(spark, d).where("body IS NOT NULL").select("arrival", dispatch.content_kind(F.lit(None).cast("string"), F.col("body")).alias("kind"))


def dispatched(spark, d):
    return dispatch.documents(table(spark, d, "fetch_log")).select("arrival", "kind", "title", "error", F.size("blocks").alias("blocks"))


def redirect_targets(spark, d):
    """Where addresses that fetches or stored redirects left lead to in the end."""
    f = table(spark, d, "fetch_log").where("requested_url <> final_url").select(F.col("requested_url").alias("src"), F.col("final_url").alias("dst"))
    return W.resolved_redirects(f.distinct()).select("url", "final", "hops", "error")


def crawls_newest(spark, d):
    c = _crawl(spark, d).groupBy("crawl_id").agg(F.max("seq").alias("last_seq"), F.count("*").alias("urls"))
    return c.orderBy(F.desc("last_seq"), "crawl_id").limit(20)


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Events as run records: the kind of event is the profile, the user the case, the value the latency."""
    outcome = F.when(F.col("value") >= 95, "error").when(F.col("k") == 0, "na").otherwise("ok")
    kind = F.when(F.col("value") >= 98, "timeout").when(F.col("value") >= 95, "blocked")
    return _events(spark, d).select(F.col("event_type").alias("profile"), F.col("user_id").alias("case"), (F.col("k") % 3 + 1).alias("repetition"), outcome.alias("outcome"), kind.alias("kind"), F.col("value").alias("latency"), (F.col("k") / 100).alias("score"))


def report_battery(spark, d):
    r = R.computed(_records(spark, d), ["profile"])
    counts = ["records", "cases", "attempted", "ok", "errors", "not_applicable", "unavailable", "timeouts", "blocked", "usable_n"]
    rounded = ["success_rate", "timeout_rate", "blocked_rate", "mean_usable", "mean_score", "slowest", *[f"{p}_{q}" for p in ("all", "first", "warm") for q in ("p50", "p95")]]
    return r.select("profile", *counts, *[F.round(c, 6).alias(c) for c in rounded])


def case_lists(spark, d):
    return R.case_lists(_records(spark, d), ["profile", "outcome"])


def leader_margins(spark, d):
    g = _records(spark, d).where("outcome = 'ok'").groupBy("profile", "repetition").agg(F.round(F.avg("score"), 4).alias("mean"), F.count("*").alias("n"))
    out = R.leaders(g, ["repetition"], "profile", "mean", "n")
    return out.select("repetition", "leaders", F.round("best", 4).alias("best"), F.round("margin", 4).alias("margin"), "qualifier", "small_sample")


def phase_medians(spark, d):
    v = table(spark, d, "versions").select("doc_id", "version", "backend", "meta.stats").dropDuplicates(["doc_id", "version"])
    r = v.select(F.coalesce("backend", F.lit("")).alias("profile"), F.lit("ok").alias("outcome"), F.lit(2).alias("repetition"), F.col("stats").alias("timings"))
    return R.phase_medians(r, ["profile"])


def workloads(spark, d):
    r = _records(spark, d).withColumn("scenario", F.concat(F.lit("w"), (F.col("case") % 4).cast("string")))
    return R.workload_summary(r)


def sessions(spark, d):
    return R.sessions_held(_events(spark, d).select(F.col("user_id").alias("session"), (F.col("value") < 99).alias("held")))


def suite_cases(spark, d):
    return table(spark, d, "sites").select("host", R.in_suite(F.col("host"), ("docs.*", "*.test")).alias("chosen")).distinct()


def search_stemmed(spark, d):
    postings = Q.inverted(_blocks(spark, d), KEY, "text", "title")
    return Q.search(postings, KEY, 'settling offer OR "harbours hotel"').withColumn("score", F.round("score", 6))


def search_title(spark, d):
    postings = Q.inverted(_blocks(spark, d), KEY, "text", "title")
    return Q.search(postings, KEY, "price* shock", columns=(1,)).withColumn("score", F.round("score", 6))


def crawl_run(spark, d):
    """A crawl of the stored pages from the first seed over the links of the pages."""
    f = _fetches(spark, d).where("final_url IS NOT NULL").select(normalize_url(F.col("requested_url")).alias("url"), normalize_url(F.col("final_url")).alias("final_url"), "http_status", "raw_hash", "arrival", "body")
    page = f.where("url IS NOT NULL").groupBy("url").agg(F.max_by(F.struct("final_url", "http_status", "raw_hash", F.col("body").isNotNull().alias("has")), "arrival").alias("p"))
    pages = page.select("url", (F.col("p.http_status").between(200, 299) & F.col("p.has")).alias("ok"), F.when(~F.col("p.http_status").between(200, 299), "http_error").alias("error"), "p.final_url", F.col("p.final_url").alias("doc_id"), F.col("p.raw_hash").alias("content_hash"))
    c = _crawl(spark, d)
    edges = c.where("source IN ('link', 'sitemap')").select("crawl_id", normalize_url(F.col("url")).alias("dst"), F.col("seq").alias("pos"))
    seeds = c.where("source = 'seed'").groupBy("crawl_id").agg(F.min_by("url", "seq").alias("seed")).select("crawl_id", normalize_url(F.col("seed")).alias("src"))
    links = seeds.join(edges, "crawl_id").select("src", "dst", "pos")
    stored = seeds.join(pages.where("ok").select(F.col("url").alias("src")), "src", "left_semi").agg(F.min("src")).first()[0]
    root = stored or seeds.agg(F.min("src")).first()[0]
    frontier, _ = W.crawled(pages, links, root, max_pages=1_000_000, max_depth=2, same_origin=False)
    return frontier.select("url", "depth", "source", "state", "reason")


_REC = "(SELECT event_type AS profile, user_id AS \"case\", (k % 3 + 1) AS repetition, CASE WHEN value >= 95 THEN 'error' WHEN k = 0 THEN 'na' ELSE 'ok' END AS outcome, CASE WHEN value >= 98 THEN 'timeout' WHEN value >= 95 THEN 'blocked' END AS kind, value AS latency, k / 100 AS score FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events))"
_S = "(SELECT raw_hash, content_type, body FROM (SELECT *, row_number() OVER (PARTITION BY raw_hash ORDER BY arrival) AS r FROM fetch_log WHERE raw_hash IS NOT NULL AND body IS NOT NULL) WHERE r = 1)"
_L = "(SELECT doc_id, max(version) AS latest FROM versions GROUP BY doc_id)"

QUERIES = {f.__name__: f for f in (slices_at, block_select, snapshot_scan, prune_by_age, prune_snapshots, delete_cascade, export_raw, upsert_aliases, upsert_snapshots, documents_page, duplicate_contents, fetch_errors, envelopes, stats_totals, candidate_choice, url_policy, page_keys, formatted_cells, gold_texts, sniffed_kinds, dispatched, redirect_targets, crawls_newest, report_battery, case_lists, leader_margins, phase_medians, workloads, sessions, suite_cases, search_stemmed, search_title, crawl_run)}

SQL = {
    "slices_at": """
        WITH s AS (SELECT DISTINCT request_id, doc_id, version, coalesce(max_chars, 24000) AS max_chars, coalesce(next_offset, 0) AS offs FROM slices),
        l AS (SELECT doc_id, max(version) AS latest FROM versions WHERE markdown IS NOT NULL GROUP BY 1),
        t AS (SELECT DISTINCT request_id, s.doc_id, v.version, markdown, length(markdown)::BIGINT AS total, greatest(0, least(offs, length(markdown)))::BIGINT AS start, max_chars FROM s JOIN l USING (doc_id) JOIN versions v ON v.doc_id = s.doc_id AND v.version = coalesce(s.version, latest) WHERE markdown IS NOT NULL),
        h AS (SELECT *, least(total, start + greatest(1, max_chars))::BIGINT AS hard FROM t),
        e AS (SELECT h.*, CASE WHEN hard < total THEN coalesce((SELECT max(char_offset) FROM blocks b WHERE b.doc_id = h.doc_id AND b.version = h.version AND char_offset > start AND char_offset <= hard), hard) ELSE hard END AS stop FROM h)
        SELECT request_id, regexp_replace(substr(markdown, start + 1, stop - start), '\\n+$', '') AS slice, CASE WHEN stop < total THEN stop END AS next_offset, total AS total_chars, start > 0 OR stop < total AS truncated FROM e""",
    "block_select": f"SELECT doc_id, version, block_id FROM {_B} WHERE block_id IN ('b2', 'b5', 'b7', 'b8', 'b9')",
    "snapshot_scan": f"SELECT raw_hash, content_type, octet_length(body)::BIGINT AS bytes, md5(body) AS digest FROM {_S}",
    "prune_by_age": f"SELECT DISTINCT doc_id, version FROM versions JOIN {_L} USING (doc_id) WHERE version > latest - 2 AND (version = latest OR fetched_at IS NULL OR fetched_at >= '{CUT}')",
    "prune_snapshots": f"SELECT DISTINCT doc_id, version, CASE WHEN version = latest THEN snapshot_hash END AS snapshot_hash FROM versions JOIN {_L} USING (doc_id)",
    "delete_cascade": f"""
        WITH g AS (SELECT DISTINCT doc_id FROM versions WHERE version = 3), v AS (SELECT DISTINCT doc_id, version, raw_hash FROM versions WHERE doc_id NOT IN (SELECT doc_id FROM g))
        SELECT 'versions' AS name, count(*) AS n FROM (SELECT DISTINCT doc_id, version FROM v) UNION ALL SELECT 'blocks', count(*) FROM {_B} WHERE doc_id NOT IN (SELECT doc_id FROM g)
        UNION ALL SELECT 'aliases', count(*) FROM (SELECT DISTINCT url, doc_id FROM aliases) WHERE doc_id NOT IN (SELECT doc_id FROM g)
        UNION ALL SELECT 'snapshots', count(*) FROM (SELECT DISTINCT raw_hash FROM fetch_log WHERE raw_hash IN (SELECT raw_hash FROM v WHERE raw_hash IS NOT NULL))""",
    "export_raw": f"SELECT DISTINCT doc_id, version, length(to_base64(body))::BIGINT AS raw_chars, md5(to_base64(body)) AS digest FROM versions v LEFT JOIN {_S} s ON s.raw_hash = v.raw_hash",
    "upsert_aliases": "SELECT requested_url AS url, final_url AS target FROM (SELECT *, row_number() OVER (PARTITION BY requested_url ORDER BY arrival) AS r FROM fetch_log WHERE requested_url <> final_url) WHERE r = 1",
    "upsert_snapshots": f"""
        WITH f AS (SELECT DISTINCT final_url, raw_hash, arrival FROM fetch_log WHERE raw_hash IS NOT NULL AND final_url IS NOT NULL),
        l AS (SELECT final_url, arg_max(raw_hash, arrival) AS raw_hash FROM f GROUP BY 1)
        SELECT raw_hash, octet_length(body)::BIGINT AS bytes FROM {_S} WHERE raw_hash IN (SELECT raw_hash FROM l)""",
    "documents_page": "SELECT doc_id, max(version) AS latest_version, count(DISTINCT version) AS versions, max(last_seen_at) AS updated_at FROM versions GROUP BY doc_id ORDER BY updated_at DESC NULLS LAST, doc_id LIMIT 20 OFFSET 10",
    "duplicate_contents": "SELECT DISTINCT doc_id, version, first_doc FROM versions JOIN (SELECT content_hash, min(doc_id) AS first_doc FROM versions GROUP BY 1) USING (content_hash) WHERE doc_id <> first_doc",
    "fetch_errors": "SELECT DISTINCT crawl_id, url, CASE coalesce(reason, 'unknown') WHEN 'timeout' THEN 'timeout' WHEN 'http_error' THEN 'http_error' WHEN 'dns_failure' THEN 'network' WHEN 'connect_failed' THEN 'network' WHEN 'tls_failure' THEN 'network' WHEN 'blocked_by_policy' THEN 'blocked' WHEN 'robots_disallowed' THEN 'blocked' WHEN 'unsupported_content_type' THEN 'unsupported' WHEN 'unsupported_encoding' THEN 'unsupported' ELSE 'engine_error' END AS kind, coalesce(reason, 'unknown') IN ('timeout', 'dns_failure', 'connect_failed') AS again FROM crawl_urls WHERE state = 'failed'",
    "envelopes": """
        WITH v AS (SELECT DISTINCT doc_id, version, raw_hash, meta.warnings AS w FROM versions), c AS (SELECT raw_hash, max(input_truncated) AS cut FROM fetch_log WHERE raw_hash IS NOT NULL GROUP BY 1)
        SELECT doc_id, version, CASE WHEN cut IS NOT NULL OR len(list_filter(w, lambda x: contains(x, 'cut'))) > 0 THEN 'partial' ELSE 'ok' END AS status, coalesce(cut, '') AS reasons FROM v LEFT JOIN c USING (raw_hash)""",
    "stats_totals": "SELECT doc_id, e.key AS name, round(sum(round(e.value, 1)), 1) AS total FROM (SELECT doc_id, unnest(map_entries(stats)) AS e FROM (SELECT DISTINCT doc_id, version, meta.stats AS stats FROM versions)) WHERE e.value >= 0 GROUP BY ALL",
    "candidate_choice": f"""
        WITH p AS (SELECT final_url, backend <> 'http' AS r, http_status BETWEEN 200 AND 299 AND body IS NOT NULL AS ok, octet_length(body)::BIGINT AS chars FROM {_F} WHERE final_url IS NOT NULL),
        g AS (SELECT final_url, max(chars) FILTER (NOT r AND ok) AS http_chars, max(chars) FILTER (r AND ok) AS rendered_chars, bool_or(r AND NOT ok) AS failed FROM p GROUP BY 1)
        SELECT final_url, http_chars, rendered_chars, CASE WHEN rendered_chars >= coalesce(http_chars, 0) THEN 'rendered' WHEN http_chars IS NULL THEN 'none' WHEN failed AND rendered_chars IS NULL THEN 'partial' ELSE 'http' END AS choice FROM g""",
    "url_policy": """
        SELECT url, CASE WHEN NOT regexp_matches(url, '^\\s*[A-Za-z][A-Za-z0-9+.-]*:') THEN 'invalid' WHEN NOT regexp_matches(url, '(?i)^\\s*https?:') THEN 'scheme' WHEN regexp_matches(url, '^[^:]*://[^/?#]*@') THEN 'credentials'
            WHEN regexp_extract(url, '://([^/?#:]*)', 1) = '' THEN 'invalid' WHEN regexp_matches(url, '(?i)://(localhost|127\\.|10\\.|192\\.168\\.|169\\.254\\.|0\\.|\\[)') THEN 'address' END AS violation FROM (SELECT DISTINCT url FROM crawl_urls)""",
    "page_keys": """
        SELECT url, regexp_replace(regexp_replace(b, '\\?.*$', ''), '/index\\.html$', '/') || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS key
        FROM (SELECT url, b, list_filter(string_split(regexp_extract(b, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_')) AS k FROM (SELECT DISTINCT url, regexp_replace(url, '#.*$', '') AS b FROM crawl_urls))""",
    "formatted_cells": """
        SELECT doc_id, version, CASE WHEN title IS NULL THEN '' WHEN regexp_matches(s, '[",\\n\\r]') THEN '"' || replace(s, '"', '""') || '"' ELSE s END AS csv,
            replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html, regexp_replace(replace(title, '|', '\\|'), '\\s*\\n\\s*', ' ', 'g') AS cell, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug
        FROM (SELECT DISTINCT doc_id, version, title, CASE WHEN regexp_matches(title, '^[=+\\-@\\t\\r]') THEN '''' || title ELSE title END AS s FROM versions)""",
    "redirect_targets": """
        WITH RECURSIVE s AS (SELECT requested_url AS src, min(final_url) AS dst FROM fetch_log WHERE requested_url <> final_url GROUP BY 1),
        w AS (SELECT src AS url, dst AS tip, 1 AS hops, [src] AS passed FROM s UNION ALL SELECT w.url, s.dst, w.hops + 1, list_append(w.passed, s.src) FROM w JOIN s ON s.src = w.tip WHERE NOT list_contains(w.passed, w.tip) AND w.hops <= 10),
        e AS (SELECT w.*, list_contains(passed, tip) AS l, s.src IS NULL AS stop FROM w LEFT JOIN s ON s.src = w.tip)
        SELECT url, CASE WHEN NOT l AND hops <= 10 THEN tip END AS final, hops, CASE WHEN l THEN 'loop' WHEN hops > 10 THEN 'too_many' END AS error FROM e WHERE stop OR l OR hops > 10""",
    "crawls_newest": "SELECT crawl_id, max(seq) AS last_seq, count(DISTINCT url) AS urls FROM crawl_urls GROUP BY crawl_id ORDER BY last_seq DESC, crawl_id LIMIT 20",
    "report_battery": f"""
        WITH r AS (SELECT *, outcome IN ('ok', 'error') AS tried, CASE WHEN outcome = 'error' THEN 0.0 WHEN outcome = 'ok' THEN score END AS usable FROM {_REC})
        SELECT profile, count(*) AS records, count(DISTINCT "case") AS cases, count(*) FILTER (tried) AS attempted, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (outcome = 'na') AS not_applicable, 0::BIGINT AS unavailable,
            count(*) FILTER (kind = 'timeout') AS timeouts, count(*) FILTER (kind = 'blocked') AS blocked, count(usable) AS usable_n, round(avg((outcome = 'ok')::INT) FILTER (tried), 6) AS success_rate, round(avg((kind = 'timeout')::INT) FILTER (tried), 6) AS timeout_rate,
            round(avg((kind = 'blocked')::INT) FILTER (tried), 6) AS blocked_rate, round(avg(usable), 6) AS mean_usable, round(avg(score) FILTER (outcome = 'ok'), 6) AS mean_score, round(max(latency) FILTER (outcome = 'ok'), 6) AS slowest,
            round(quantile_disc(latency, 0.5) FILTER (outcome = 'ok'), 6) AS all_p50, round(quantile_disc(latency, 0.95) FILTER (outcome = 'ok'), 6) AS all_p95, round(quantile_disc(latency, 0.5) FILTER (outcome = 'ok' AND repetition = 1), 6) AS first_p50, round(quantile_disc(latency, 0.95) FILTER (outcome = 'ok' AND repetition = 1), 6) AS first_p95,
            round(quantile_disc(latency, 0.5) FILTER (outcome = 'ok' AND repetition > 1), 6) AS warm_p50, round(quantile_disc(latency, 0.95) FILTER (outcome = 'ok' AND repetition > 1), 6) AS warm_p95 FROM r GROUP BY profile""",
    "case_lists": f"SELECT profile, outcome, count(*) AS cases, array_to_string(list_sort(list(\"case\"::VARCHAR) FILTER (n <= 8)), ', ') AS shown FROM (SELECT *, row_number() OVER (PARTITION BY profile, outcome ORDER BY \"case\") AS n FROM (SELECT DISTINCT profile, outcome, \"case\" FROM {_REC})) GROUP BY profile, outcome",
    "leader_margins": f"""
        WITH g AS (SELECT profile, repetition, round(avg(score), 4) AS mean, count(*) AS n FROM {_REC} WHERE outcome = 'ok' GROUP BY ALL), b AS (SELECT repetition, max(mean) AS best FROM g GROUP BY 1),
        t AS (SELECT repetition, string_agg(profile, ',' ORDER BY profile) AS leaders, any_value(best) AS best, min(n) AS n FROM g JOIN b USING (repetition) WHERE mean = best GROUP BY 1), o AS (SELECT repetition, max(mean) FILTER (mean < best) AS nxt FROM g JOIN b USING (repetition) GROUP BY 1)
        SELECT repetition, leaders, round(best, 4) AS best, round(best - nxt, 4) AS margin, CASE WHEN contains(leaders, ',') THEN 'tie' WHEN nxt IS NULL THEN 'only' WHEN best - nxt < 0.05 OR best - nxt <= 0.1 * abs(best) THEN 'close' ELSE 'clear' END AS qualifier, n < 10 AS small_sample FROM t JOIN o USING (repetition)""",
    "phase_medians": "SELECT profile, e.key AS phase, quantile_disc(e.value, 0.5) AS median, count(*) AS n FROM (SELECT coalesce(backend, '') AS profile, unnest(map_entries(stats)) AS e FROM (SELECT DISTINCT doc_id, version, backend, meta.stats AS stats FROM versions)) WHERE e.value >= 0 GROUP BY ALL",
    "workloads": f"SELECT 'w' || (\"case\" % 4) AS scenario, profile, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'na') AS not_applicable, 0::BIGINT AS unavailable, count(*) FILTER (outcome IN ('ok', 'error')) AS attempted, quantile_disc(latency, 0.5) FILTER (outcome = 'ok') AS p50 FROM {_REC} GROUP BY ALL",
    "sessions": "SELECT user_id AS session, bool_and(coalesce(value < 99, false)) AS held FROM events GROUP BY user_id",
    "suite_cases": "SELECT DISTINCT host, host LIKE 'docs.%' OR host LIKE '%.test' AS chosen FROM sites",
}
