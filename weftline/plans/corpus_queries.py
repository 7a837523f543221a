"""Queries over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import urls as U
from weftline.operators import corpus as C
from weftline.operators import crawl as W
from weftline.operators import score as S
from weftline.session import cut
from weftline.sources import pages as P
from weftline.sources import records
from weftline.sources.tables import table

def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").select("doc_id", "version", "idx", "block_id", "block_type", "level", "text", "markdown", "hash", "char_offset", "title").dropDuplicates(["doc_id", "version", "idx"])


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "versions").select("doc_id", "version", "requested_url", "final_url", "http_status", "content_type", "title", "content_hash", "raw_hash", "strategy", "backend", "markdown").dropDuplicates(["doc_id", "version"])


def _crawl(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_urls").dropDuplicates(["crawl_id", "url"])


def _fetches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_log").dropDuplicates(["arrival"])


def url_normalize(spark, d):
    return table(spark, d, "crawl_urls").select("url").distinct().select("url", U.normalize_url(F.col("url")).alias("normalized"))


def doc_ids(spark, d):
    n = table(spark, d, "crawl_urls").select("url").distinct().select("url", U.normalize_url(F.col("url")).alias("normalized"))
    return n.select("url", T.doc_id_for(F.col("normalized")).alias("computed_id"))


def block_refs(spark, d):
    ref = T.version_ref(F.col("doc_id"), F.col("version"), F.col("block_id"))
    b = _blocks(spark, d).select("doc_id", "version", "block_id", ref.alias("ref"))
    p = T.parse_ref(F.col("ref"))
    return b.select("ref", p["doc_id"].alias("parsed_doc"), p["version"].alias("parsed_version"), p["block_id"].alias("parsed_block"))


def block_hashes(spark, d):
    h = C.block_hash(F.col("block_type"), F.col("markdown"))
    return _blocks(spark, d).select("doc_id", "version", "idx", h.alias("computed_hash"), (h == F.col("hash")).alias("same"))


def block_offsets(spark, d):
    return C.block_offsets(table(spark, d, "blocks"))


def block_numbers(spark, d):
    by = Window.partitionBy("doc_id", "version").orderBy("idx")
    return _blocks(spark, d).where("markdown <> ''").select("doc_id", "version", "idx", F.concat(F.lit("b"), F.row_number().over(by).cast("string")).alias("number"), "block_id")


def document_stats(spark, d):
    b = _blocks(spark, d)
    return b.groupBy("doc_id", "version").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("blocks"), F.count_if(F.col("block_type") == "heading").alias("headings"), F.count_if(F.col("block_type") == "table").alias("tables"), F.count_if(F.col("block_type") == "code").alias("code_blocks"))


def block_range(spark, d):
    return _blocks(spark, d).where("idx BETWEEN 2 AND 5").select("doc_id", "version", "block_id", F.length("markdown").alias("chars"))


def version_islands(spark, d):
    out = C.version_islands(table(spark, d, "fetch_log").select("final_url", "raw_hash", "arrival"), "final_url", "raw_hash", "arrival")
    return out


def latest_versions(spark, d):
    v = _versions(spark, d)
    return v.join(C.latest(v).withColumnRenamed("doc_id", "l_doc"), (F.col("doc_id") == F.col("l_doc")) & (F.col("version") == F.col("latest_version"))).select("doc_id", "version", "versions", "title", F.length("markdown").alias("chars"))


def list_documents(spark, d):
    v = table(spark, d, "versions").select("doc_id", "version", "final_url").distinct()
    out = v.groupBy("doc_id").agg(F.max("version").alias("latest_version"), F.count_distinct("version").alias("versions"), F.min("final_url").alias("url"))
    return out.orderBy("url", "doc_id").limit(50)


def alias_resolve(spark, d):
    urls = table(spark, d, "aliases").select("url").unionByName(table(spark, d, "versions").select(F.col("requested_url").alias("url"))).unionByName(table(spark, d, "crawl_urls").select("url"))
    return C.resolve(urls, table(spark, d, "versions"), table(spark, d, "aliases"))


def insert_if_absent(spark, d):
    rows = table(spark, d, "crawl_urls").select("url", "crawl_id", "seq", "state")
    return C.first_wins(rows.withColumn("at", F.struct("seq", "crawl_id")), ["url"], "at").select("url", "crawl_id", "seq")


def orphan_snapshots(spark, d):
    return C.orphans(table(spark, d, "fetch_log"), table(spark, d, "versions"))


def prune_keep_one(spark, d):
    v = table(spark, d, "versions").select("doc_id", "version").distinct()
    kept = C.retained(v, 1)
    return v.groupBy("doc_id").agg(F.count("*").alias("before")).join(kept.groupBy("doc_id").agg(F.count("*").alias("kept")), "doc_id", "left").select("doc_id", "before", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("before") - F.coalesce("kept", F.lit(0))).alias("removed"))


def delete_document(spark, d):
    v = _versions(spark, d).select("doc_id", "version", "raw_hash")
    gone = v.where("version = 3").select("doc_id").distinct()
    return v.join(gone, "doc_id", "left_anti").select("doc_id", "version")


def export_nested(spark, d):
    v = _versions(spark, d).select("doc_id", "version", "title")
    out = C.export_nested(v, table(spark, d, "blocks"))
    return out.select("doc_id", "version", "title", F.coalesce(F.size("blocks"), F.lit(0)).cast("bigint").alias("blocks"), F.array_join(F.transform("blocks", lambda b: F.concat_ws(":", b["block_id"], b["block_type"])), ",").alias("outline"))


def slices(spark, d):
    v = table(spark, d, "versions").select("doc_id", "version", "markdown").where("markdown IS NOT NULL").dropDuplicates(["doc_id", "version"])
    s = table(spark, d, "slices").select("request_id", "doc_id", "version", F.coalesce("max_chars", F.lit(24000)).alias("max_chars")).distinct()
    last = v.groupBy("doc_id").agg(F.max("version").alias("latest"))
    s = s.join(last, "doc_id").select("request_id", "doc_id", F.coalesce("version", "latest").alias("version"), "max_chars")
    return C.slice_bounds(s, v, table(spark, d, "blocks"))


def window_blocks(spark, d):
    s = table(spark, d, "slices").select("request_id", "doc_id", "version", F.coalesce("max_chars", F.lit(24000)).alias("stop")).distinct()
    last = table(spark, d, "versions").where("markdown IS NOT NULL").groupBy("doc_id").agg(F.max("version").alias("latest"))
    s = s.join(last, "doc_id", "left").select("request_id", "doc_id", F.coalesce("version", "latest").alias("version"), "stop")
    b = _blocks(spark, d).select("doc_id", "version", "block_id", "char_offset", F.length("markdown").alias("len"))
    return s.join(b, ["doc_id", "version"]).where("char_offset + len > 0 AND char_offset < stop").select("request_id", "block_id", "char_offset")


def content_classify(spark, d):
    kind = F.when(F.col("content_type").rlike("(?i)html"), "html").when(F.col("content_type").rlike("(?i)pdf"), "pdf").when(F.col("content_type").rlike("(?i)^text/|json|xml|javascript|markdown"), "text")
    label = F.lower(F.regexp_extract("content_type_header", r"(?i)charset\s*=\s*\"?([^\s;\"]+)", 1))
    return _fetches(spark, d).select("arrival", kind.alias("kind"), F.when(label != "", label).alias("header_charset"))


def status_gate(spark, d):
    ok = F.col("http_status").between(200, 299)
    return _fetches(spark, d).select("arrival", "http_status", F.when(~ok, "http_error").alias("error"), F.when(~ok, (F.col("http_status") == 429) | (F.col("http_status") >= 500)).alias("retryable"))


def byte_limit(spark, d):
    kept, cut = records.limited(F.col("body"))
    return _fetches(spark, d).where("body IS NOT NULL").select("arrival", F.octet_length("body").cast("bigint").alias("bytes"), cut.alias("cut"), F.octet_length(kept).cast("bigint").alias("kept"))


def redirect_hops(spark, d):
    return W.redirect_hops(table(spark, d, "fetch_log"))


def markdown_links(spark, d):
    v = _versions(spark, d).select("doc_id", "version", F.explode(F.regexp_extract_all("markdown", F.lit(r"\[[^\]\n]*\]\(([^)\s]+)\)"), F.lit(1))).alias("target"))
    return v.groupBy("doc_id", "version").agg(F.count("*").alias("links"), F.count_distinct("target").alias("targets"))


def heading_lines(spark, d):
    v = _versions(spark, d).select("doc_id", "version", F.posexplode(S.headings(F.col("markdown"))).alias("at", "heading"))
    return v.select("doc_id", "version", (F.col("at") + 1).alias("nth"), "heading")


def quote_spans(spark, d):
    # the whole of each block, found again in its version at the block's offset
    b = _blocks(spark, d).select("doc_id", "version", "block_id", "char_offset", F.col("markdown").alias("quote"))
    v = _versions(spark, d).select("doc_id", "version", "markdown")
    return b.join(v, ["doc_id", "version"]).select("doc_id", "version", "block_id", F.expr("substring(markdown, cast(char_offset + 1 AS int), length(quote)) = quote").alias("verified"))


def crawl_counters(spark, d):
    return W.counters(table(spark, d, "crawl_urls"))


def crawl_scope(spark, d):
    c = _crawl(spark, d)
    reason = W.scope_reason(F.col("url"), "https://news.antelen.test/", include=("/**",), exclude=("/old/**",))
    return c.select("crawl_id", "url", reason.alias("why"), (F.col("depth") > 3).alias("beyond_depth"))


def crawl_duplicates(spark, d):
    by = Window.partitionBy("crawl_id", "content_hash").orderBy("seq", "url")
    c = _crawl(spark, d).where("content_hash IS NOT NULL").select("crawl_id", "url", "seq", F.first("url").over(by).alias("first_url"))
    return c.where("url <> first_url").select("crawl_id", "url", "first_url")


def crawl_frontier(spark, d):
    by = Window.partitionBy("crawl_id").orderBy("depth", "seq", "url")
    return _crawl(spark, d).where("state = 'queued'").select("crawl_id", "url", F.row_number().over(by).alias("turn")).where("turn <= 10")


def crawl_pacing(spark, d):
    by = Window.partitionBy("crawl_id", "origin").orderBy("seq", "url")
    return _crawl(spark, d).select("crawl_id", "url", "seq", U.origin_of(F.col("url")).alias("origin")).select("crawl_id", "url", ((F.row_number().over(by) - 1) * 500).cast("bigint").alias("start_ms"))


def crawl_scored(spark, d):
    c = _crawl(spark, d)
    out = W.scored(c.where("source = 'sitemap'"), c.where("state = 'done'"), c.where("reason = 'robots'"), "crawl_id")
    return out.withColumn("coverage", F.round("coverage", 6))


def crawl_dangling(spark, d):
    return _crawl(spark, d).where("doc_id IS NOT NULL").join(table(spark, d, "versions").select("doc_id").distinct(), "doc_id", "left_anti").select("crawl_id", "url", "doc_id")


def _links(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, pos): links of all fetches of a page, each at its first place; URLs in their normal form."""
    f = table(spark, d, "fetch_log")
    page = f.select("arrival", U.normalize_url(F.col("final_url")).alias("src")).dropDuplicates(["arrival"])
    out = P.extracted(f).select("arrival", F.posexplode("outlinks").alias("pos", "target")).join(page, "arrival")
    return out.select("src", U.normalize_url(F.col("target")).alias("dst"), "pos").where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.min("pos").alias("pos"))


def crawl_breadth_first(spark, d):
    seeds = _crawl(spark, d).where("source = 'seed'").select(U.normalize_url(F.col("url")).alias("node"), F.struct("crawl_id", "seq", "url").alias("at"))
    return W.breadth_first(cut(_links(spark, d)), seeds, 3).select("node", "depth")


def site_documents(spark, d):
    v = table(spark, d, "versions").select("doc_id", U.site_of(F.col("final_url")).alias("site")).where("site IS NOT NULL").distinct()
    s = table(spark, d, "sites").select(F.col("host").alias("site"), "locale", "time_zone")
    return v.groupBy("site").agg(F.count("*").alias("documents")).join(s, "site", "left")


def citations(spark, d):
    b = _blocks(spark, d).where("block_type = 'heading'")
    v = _versions(spark, d).select("doc_id", "version", "final_url", F.col("title").alias("version_title"))
    return b.join(v, ["doc_id", "version"]).select(T.version_ref(F.col("doc_id"), F.col("version"), F.col("block_id")).alias("ref"), "final_url", "version_title", F.col("text").alias("quote"))


def page_blocks(spark, d):
    pages = P.extracted(table(spark, d, "fetch_log"))
    return pages.select("arrival", F.posexplode("blocks").alias("idx", "b")).select("arrival", "idx", "b.type", "b.level", "b.lang", "b.text", "b.markdown", C.block_hash(F.col("b.type"), F.col("b.markdown")).alias("hash"))


def page_signals(spark, d):
    pages = P.extracted(table(spark, d, "fetch_log"))
    status = table(spark, d, "fetch_log").select("arrival", "http_status").distinct()
    chars = F.aggregate("blocks", F.lit(0), lambda a, b: a + F.length(b["text"]))
    reason = S.escalation(F.col("http_status"), F.col("chars"), F.col("app_root_empty"), F.col("noscript_warning"), F.col("inline_script_chars"), F.col("external_scripts"), F.col("scripts"), F.col("body_text_chars"))
    return pages.withColumn("chars", chars).join(status, "arrival").select("arrival", "title", "lang", "published", "chars", "scripts", "body_text_chars", reason.alias("render_reason"))


def page_outlinks(spark, d):
    pages = P.extracted(table(spark, d, "fetch_log"))
    return pages.select("arrival", F.explode("outlinks").alias("target")).select("arrival", "target", U.site_of(F.col("target")).alias("site"))


# The SQL has literals of its own: it checks the constants of the library, too.
_URL = "^\\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?"
_NORMALIZED = f"""
    SELECT url, CASE WHEN scheme <> '' THEN scheme || '://' ||
        CASE WHEN scheme = 'http' AND suffix(host, ':80') THEN host[:-4] WHEN scheme = 'https' AND suffix(host, ':443') THEN host[:-5] ELSE host END ||
        CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN rest <> '' THEN '?' || rest ELSE '' END END AS normalized
    FROM (SELECT *, CASE WHEN len(list_filter(parts, lambda p: tracked(p))) > 0
            THEN array_to_string(list_transform(list_filter(parts, lambda p: NOT tracked(p)), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&') ELSE query END AS rest
        FROM (SELECT url, lower(regexp_extract(url, '{_URL}', 1)) AS scheme, lower(regexp_extract(url, '{_URL}', 2)) AS host, regexp_extract(url, '{_URL}', 3) AS path,
            regexp_extract(url, '{_URL}', 4) AS query, list_filter(string_split(regexp_extract(url, '{_URL}', 4), '&'), lambda p: p <> '') AS parts
            FROM (SELECT DISTINCT url FROM crawl_urls)))""".replace("tracked(p)", "(lower(split_part(p, '=', 1)) IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', '_hsenc', '_hsmi', 'ref_src') OR regexp_matches(split_part(p, '=', 1), '^(?i:utm)_[A-Za-z]+$'))")
_B = "(SELECT DISTINCT doc_id, version, idx, block_id, block_type, level, text, markdown, hash, char_offset, title FROM blocks)"
_V = "(SELECT DISTINCT doc_id, version, requested_url, final_url, http_status, content_type, title, content_hash, raw_hash, strategy, backend, markdown FROM versions)"
_C = "(SELECT DISTINCT * FROM crawl_urls)"
_F = "(SELECT DISTINCT * FROM fetch_log)"
_SITE = "nullif(regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(final_url, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\\\]*)', 1), '^.*@|:\\d*$', '', 'g')), '\\.$', ''), '^www\\.', ''), '')"

QUERIES = {f.__name__: f for f in (url_normalize, doc_ids, block_refs, block_hashes, block_offsets, block_numbers, document_stats, block_range, version_islands, latest_versions, list_documents, alias_resolve, insert_if_absent, orphan_snapshots, prune_keep_one, delete_document, export_nested, slices, window_blocks, content_classify, status_gate, byte_limit, redirect_hops, markdown_links, heading_lines, quote_spans, crawl_counters, crawl_scope, crawl_duplicates, crawl_frontier, crawl_pacing, crawl_scored, crawl_dangling, crawl_breadth_first, site_documents, citations, page_blocks, page_signals, page_outlinks)}

SQL = {
    "url_normalize": _NORMALIZED,
    "doc_ids": f"SELECT url, 'd_' || substr(sha256(normalized), 1, 16) AS computed_id FROM ({_NORMALIZED})",
    "block_refs": f"SELECT 'fk:' || doc_id || '@' || version || '#' || block_id AS ref, doc_id AS parsed_doc, version AS parsed_version, block_id AS parsed_block FROM {_B}",
    "block_hashes": f"SELECT doc_id, version, idx, h AS computed_hash, h = hash AS same FROM (SELECT *, substr(sha256(block_type || chr(10) || markdown), 1, 16) AS h FROM {_B})",
    "block_offsets": f"SELECT doc_id, version, idx, coalesce(sum(length(markdown) + 2) OVER (PARTITION BY doc_id, version ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS computed_offset, char_offset FROM {_B}",
    "block_numbers": f"SELECT doc_id, version, idx, 'b' || row_number() OVER (PARTITION BY doc_id, version ORDER BY idx) AS number, block_id FROM {_B} WHERE markdown <> ''",
    "document_stats": f"SELECT doc_id, version, sum(length(text))::BIGINT AS chars, count(*) AS blocks, count(*) FILTER (block_type = 'heading') AS headings, count(*) FILTER (block_type = 'table') AS tables, count(*) FILTER (block_type = 'code') AS code_blocks FROM {_B} GROUP BY ALL",
    "block_range": f"SELECT doc_id, version, block_id, length(markdown)::INT AS chars FROM {_B} WHERE idx BETWEEN 2 AND 5",
    "version_islands": """
        WITH f AS (SELECT DISTINCT final_url, raw_hash, arrival FROM fetch_log WHERE raw_hash IS NOT NULL AND final_url IS NOT NULL),
        m AS (SELECT *, CASE WHEN lag(raw_hash) OVER w IS NULL OR lag(raw_hash) OVER w <> raw_hash THEN 1 ELSE 0 END AS changed FROM f WINDOW w AS (PARTITION BY final_url ORDER BY arrival)),
        n AS (SELECT *, (sum(changed) OVER (PARTITION BY final_url ORDER BY arrival ROWS UNBOUNDED PRECEDING))::INT AS version FROM m)
        SELECT final_url, version, any_value(raw_hash) AS raw_hash, min(arrival) AS first_seen, max(arrival) AS last_seen, count(*) AS fetches FROM n GROUP BY final_url, version""",
    "latest_versions": f"SELECT doc_id, version, versions, title, length(markdown)::INT AS chars FROM {_V} v JOIN (SELECT doc_id AS l, max(version) AS m, count(DISTINCT version) AS versions FROM versions GROUP BY doc_id) ON doc_id = l AND version = m",
    "list_documents": "SELECT doc_id, max(version) AS latest_version, count(DISTINCT version) AS versions, min(final_url) AS url FROM versions GROUP BY doc_id ORDER BY url, doc_id LIMIT 50",
    "alias_resolve": """
        WITH u AS (SELECT url FROM aliases UNION SELECT requested_url FROM versions UNION SELECT url FROM crawl_urls),
        o AS (SELECT final_url AS url, min(doc_id) AS direct FROM versions GROUP BY 1), a AS (SELECT url, min(doc_id) AS alias FROM aliases GROUP BY 1)
        SELECT url, coalesce(direct, alias) AS doc_id, CASE WHEN direct IS NOT NULL THEN 'url' WHEN alias IS NOT NULL THEN 'alias' ELSE 'none' END AS how FROM u LEFT JOIN o USING (url) LEFT JOIN a USING (url)""",
    "insert_if_absent": "SELECT url, crawl_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq, crawl_id) AS n FROM crawl_urls) WHERE n = 1",
    "orphan_snapshots": "SELECT DISTINCT raw_hash FROM fetch_log WHERE raw_hash IS NOT NULL AND raw_hash NOT IN (SELECT raw_hash FROM versions WHERE raw_hash IS NOT NULL)",
    "prune_keep_one": "SELECT doc_id, count(*) AS before, count(*) FILTER (version > m - 1) AS kept, count(*) FILTER (version <= m - 1) AS removed FROM (SELECT DISTINCT doc_id, version, max(version) OVER (PARTITION BY doc_id) AS m FROM versions) GROUP BY doc_id",
    "delete_document": "SELECT DISTINCT doc_id, version FROM versions WHERE doc_id NOT IN (SELECT doc_id FROM versions WHERE version = 3)",
    "export_nested": f"SELECT doc_id, version, title, coalesce(n, 0) AS blocks, outline FROM (SELECT DISTINCT doc_id, version, title FROM versions) LEFT JOIN (SELECT doc_id, version, count(*) AS n, string_agg(block_id || ':' || block_type, ',' ORDER BY idx) AS outline FROM {_B} GROUP BY ALL) USING (doc_id, version)",
    "slices": f"""
        WITH s AS (SELECT DISTINCT request_id, doc_id, version, coalesce(max_chars, 24000) AS max_chars FROM slices),
        l AS (SELECT doc_id, max(version) AS latest FROM versions WHERE markdown IS NOT NULL GROUP BY 1),
        r AS (SELECT request_id, s.doc_id, coalesce(version, latest) AS version, max_chars FROM s JOIN l USING (doc_id)),
        t AS (SELECT r.*, markdown, length(markdown)::BIGINT AS total, least(length(markdown), greatest(1, max_chars))::BIGINT AS hard FROM r JOIN {_V} v USING (doc_id, version)),
        e AS (SELECT request_id, markdown, total, CASE WHEN hard < total THEN coalesce((SELECT max(char_offset) FROM blocks b WHERE b.doc_id = t.doc_id AND b.version = t.version AND char_offset > 0 AND char_offset <= hard), hard) ELSE hard END AS stop FROM t)
        SELECT request_id, regexp_replace(substr(markdown, 1, stop), '\\n+$', '') AS slice, CASE WHEN stop < total THEN stop END AS next_offset, total AS total_chars, stop < total AS truncated FROM e""",
    "window_blocks": f"SELECT request_id, block_id, char_offset FROM (SELECT DISTINCT request_id, doc_id, version, coalesce(max_chars, 24000) AS stop FROM slices) s JOIN {_B} b ON b.doc_id = s.doc_id AND b.version = coalesce(s.version, (SELECT max(v.version) FROM versions v WHERE v.doc_id = s.doc_id AND v.markdown IS NOT NULL)) WHERE char_offset + length(markdown) > 0 AND char_offset < stop",
    "content_classify": f"SELECT arrival, CASE WHEN content_type ILIKE '%html%' THEN 'html' WHEN content_type ILIKE '%pdf%' THEN 'pdf' WHEN regexp_matches(content_type, '(?i)^text/|json|xml|javascript|markdown') THEN 'text' END AS kind, nullif(lower(regexp_extract(content_type_header, '(?i)charset\\s*=\\s*\"?([^\\s;\"]+)', 1)), '') AS header_charset FROM {_F}",
    "status_gate": f"SELECT arrival, http_status, CASE WHEN http_status NOT BETWEEN 200 AND 299 THEN 'http_error' END AS error, CASE WHEN http_status NOT BETWEEN 200 AND 299 THEN http_status = 429 OR http_status >= 500 END AS retryable FROM {_F}",
    "byte_limit": f"SELECT arrival, octet_length(body)::BIGINT AS bytes, CASE WHEN octet_length(body) > 10485760 THEN 'compressed_limit' END AS cut, least(octet_length(body), 10485760)::BIGINT AS kept FROM {_F} WHERE body IS NOT NULL",
    "redirect_hops": f"SELECT arrival, i::INT AS hop, redirects[i].url AS url, redirects[i].status AS status FROM (SELECT arrival, redirects, unnest(generate_series(1, len(redirects))) AS i FROM {_F})",
    "markdown_links": f"SELECT doc_id, version, count(*) AS links, count(DISTINCT target) AS targets FROM (SELECT doc_id, version, unnest(regexp_extract_all(markdown, '\\[[^\\]\\n]*\\]\\(([^)\\s]+)\\)', 1)) AS target FROM {_V}) GROUP BY ALL",
    "heading_lines": f"SELECT doc_id, version, nth, heading FROM (SELECT doc_id, version, unnest(generate_series(1, len(h)))::INT AS nth, trim(regexp_replace(unnest(h), '^#{{1,6}} +| +#+ *$', '', 'g')) AS heading FROM (SELECT doc_id, version, list_filter(string_split(markdown, chr(10)), lambda x: regexp_matches(x, '^#{{1,6}} ')) AS h FROM {_V}))",
    "quote_spans": f"SELECT b.doc_id, b.version, block_id, substr(v.markdown, char_offset + 1, length(b.markdown)) = b.markdown AS verified FROM {_B} b JOIN {_V} v ON b.doc_id = v.doc_id AND b.version = v.version",
    "crawl_counters": f"SELECT crawl_id, count(*) FILTER (state IN ('done', 'failed')) AS fetched, count(*) FILTER (state = 'done') AS saved, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'skipped' AND reason = 'robots') AS skipped_robots, count(*) FILTER (state = 'skipped' AND reason = 'scope') AS skipped_scope, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (reason LIKE 'duplicate_of %') AS duplicates, count(*) AS known FROM {_C} GROUP BY crawl_id",
    "crawl_scope": f"SELECT crawl_id, url, CASE WHEN NOT regexp_matches(url, '(?i)^\\s*https?://') THEN 'scheme' WHEN lower(regexp_extract(url, '^\\s*([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) <> 'https://news.antelen.test' THEN 'origin' WHEN regexp_matches(regexp_extract(url, '{_URL}', 3), '(?i)\\.(avi|apk|bmp|bz2|css|deb|dmg|eot|exe|gif|gz|ico|iso|jpe?g|js|m4a|map|mjs|mkv|mov|mp3|mp4|msi|ogg|otf|png|rar|rpm|svg|tar|tgz|tiff?|ttf|wasm|wav|webm|webp|woff2?|xz|zip|7z)$') THEN 'asset' WHEN NOT starts_with(regexp_extract(url, '{_URL}', 3) || regexp_extract(url, '(\\?[^#]*)', 1), '/') THEN 'include' WHEN regexp_matches(regexp_extract(url, '{_URL}', 3) || regexp_extract(url, '(\\?[^#]*)', 1), '^/old/.*$') THEN 'exclude' END AS why, depth > 3 AS beyond_depth FROM {_C}",
    "crawl_duplicates": f"SELECT crawl_id, url, first_url FROM (SELECT crawl_id, url, first_value(url) OVER (PARTITION BY crawl_id, content_hash ORDER BY seq, url) AS first_url FROM {_C} WHERE content_hash IS NOT NULL) WHERE url <> first_url",
    "crawl_frontier": f"SELECT crawl_id, url, turn::INT AS turn FROM (SELECT crawl_id, url, row_number() OVER (PARTITION BY crawl_id ORDER BY depth, seq, url) AS turn FROM {_C} WHERE state = 'queued') WHERE turn <= 10",
    "crawl_pacing": f"SELECT crawl_id, url, ((row_number() OVER (PARTITION BY crawl_id, lower(regexp_extract(url, '^\\s*([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) ORDER BY seq, url) - 1) * 500)::BIGINT AS start_ms FROM {_C}",
    "crawl_scored": f"""
        WITH e AS (SELECT DISTINCT crawl_id, url, 1 AS e FROM {_C} WHERE source = 'sitemap'), r AS (SELECT DISTINCT crawl_id, url, 1 AS r FROM {_C} WHERE state = 'done'), f AS (SELECT DISTINCT crawl_id, url, 1 AS f FROM {_C} WHERE reason = 'robots')
        SELECT crawl_id, count(e) AS expected, count(r) AS returned, count(*) FILTER (e = 1 AND r = 1) AS covered, count(*) FILTER (e = 1 AND r IS NULL) AS missing, count(*) FILTER (e IS NULL AND r = 1) AS unexpected, count(*) FILTER (f = 1 AND r = 1) AS forbidden_returned, round(CASE WHEN count(e) > 0 THEN count(*) FILTER (e = 1 AND r = 1) / count(e) END, 6) AS coverage
        FROM e FULL JOIN r USING (crawl_id, url) FULL JOIN f USING (crawl_id, url) GROUP BY crawl_id""",
    "crawl_dangling": f"SELECT crawl_id, url, doc_id FROM {_C} WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM versions)",
    "site_documents": f"SELECT site, documents, locale, time_zone FROM (SELECT site, count(*) AS documents FROM (SELECT DISTINCT doc_id, {_SITE} AS site FROM versions) WHERE site IS NOT NULL GROUP BY site) LEFT JOIN (SELECT host AS site, locale, time_zone FROM sites) USING (site)",
    "citations": f"SELECT 'fk:' || b.doc_id || '@' || b.version || '#' || block_id AS ref, final_url, v.title AS version_title, text AS quote FROM {_B} b JOIN {_V} v ON b.doc_id = v.doc_id AND b.version = v.version WHERE block_type = 'heading'",
}
