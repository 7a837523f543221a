"""Crawl frontier: scope, counters, bounded breadth-first traversal, redirect chains, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.urls import ASSET, glob_to_regex, origin_of, path_of
from weftline.session import cut


def scope_reason(url: Column, root: str | None = None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Why a URL is out of scope, in order: scheme, origin, asset, include, exclude; null when it is in scope."""
    target = F.concat(path_of(url), F.regexp_extract(url, r"(\?[^#]*)", 1))
    reason = F.when(~url.rlike(r"(?i)^\s*https?://"), "scheme")
    if root is not None:
        reason = reason.when(origin_of(url) != origin_of(F.lit(root)), "origin")
    reason = reason.when(path_of(url).rlike(ASSET), "asset")
    if include:
        reason = reason.when(~target.rlike("|".join(f"(?:{glob_to_regex(p)})" for p in include)), "include")
    if exclude:
        reason = reason.when(target.rlike("|".join(f"(?:{glob_to_regex(p)})" for p in exclude)), "exclude")
    return reason


def counters(frontier: DataFrame) -> DataFrame:
    """State counters of each crawl; fetched counts failures, too. Repeated rows count once."""
    rows = frontier.dropDuplicates(["crawl_id", "url"])
    return rows.groupBy("crawl_id").agg(
        F.count_if(F.col("state").isin("done", "failed")).alias("fetched"),
        F.count_if(F.col("state") == "done").alias("saved"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if((F.col("state") == "skipped") & (F.col("reason") == "robots")).alias("skipped_robots"),
        F.count_if((F.col("state") == "skipped") & (F.col("reason") == "scope")).alias("skipped_scope"),
        F.count_if(F.col("state") == "queued").alias("queued"),
        F.count_if(F.coalesce(F.col("reason").startswith("duplicate_of "), F.lit(False))).alias("duplicates"),
        F.count("*").alias("known"),
    )


def numbered(rows: DataFrame, start: int) -> tuple[DataFrame, int]:
    """``rows`` (node, at) with seq: their place by (at, node) after ``start``; and the last place.

    Rows are sorted into ranges and numbered within each; one count a range comes to the driver. No level goes through one task.
    """
    ranges = cut(rows.repartitionByRange("at", "node").withColumn("range", F.spark_partition_id()))
    counts = dict(ranges.groupBy("range").count().collect())
    before, total = [], start
    for i in range(max(counts, default=0) + 1):
        before.append(total)
        total += counts.get(i, 0)
    by = Window.partitionBy("range").orderBy("at", "node")
    return ranges.withColumn("seq", F.array(*[F.lit(n).cast("bigint") for n in before])[F.col("range")] + F.row_number().over(by)), total


def breadth_first(edges: DataFrame, root: object, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """(node, depth, seq) reached from ``root``: by depth, within a level by (order of the parent, position of the link).

    ``root`` is a node, or a table of nodes (node, at) in the order of ``at``. ``edges`` has src, dst and pos. One job a level; each level is
    joined to the edges, reduced to its new nodes and written before the next, so a lost executor repeats one level. ``max_pages`` keeps the first
    nodes in order, which is the crawl's own bound.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    if not isinstance(root, DataFrame):
        root = spark.range(1).select(F.lit(root).cast(kind).alias("node"), F.lit(0).alias("at"))
    last, known, near = 0, None, root.where("node IS NOT NULL").groupBy("node").agg(F.min("at").alias("at"))
    for depth in range(max_depth + 1):
        if depth:
            near = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), F.col("seq").alias("parent"), "pos")
            near = near.join(known.select("node"), "node", "left_anti").groupBy("node").agg(F.min(F.struct("parent", "pos")).alias("at"))
        new, last = numbered(near, last)
        new = new.select("node", F.lit(depth).alias("depth"), "seq")
        if max_pages is not None:
            new = new.where(F.col("seq") <= max_pages)
        front = cut(new)
        known = front if known is None else cut(known.unionByName(front))
        if front.isEmpty():
            break
    return known


def crawled(
    pages: DataFrame,
    links: DataFrame,
    root: str | None,
    sitemap: DataFrame | None = None,
    rules: DataFrame | None = None,
    *,
    max_pages: int = 100,
    max_depth: int = 3,
    same_origin: bool = True,
    include: tuple[str, ...] = (),
    exclude: tuple[str, ...] = (),
    resume: DataFrame | None = None,
) -> tuple[DataFrame, dict[str, int | str]]:
    """(frontier, counts and stop reason) of a bounded breadth-first crawl over stored pages.

    ``pages`` has url, ok, error, final_url, doc_id and content_hash (one row each), ``links`` src, dst and pos, ``sitemap`` url and position,
    ``rules`` what ``robots.rules`` gives; all URLs are in normal form. The frontier has url, depth, seq, source, state, reason, doc_id and
    content_hash. The start has depth 0 and pages of the sitemap depth 1; pages are taken by (depth, seq) while the budget lasts; a link is considered
    once, in the order of its page and place: out of scope and too deep ones are counted, those that robots refuse are kept as skipped. The target of
    a redirect is the same page and is not taken again. With ``resume``, a frontier, the same budget goes on where it stopped.
    """
    from weftline.sources.robots import allowed

    spark = pages.sparkSession
    row = "url STRING, depth INT, seq BIGINT, source STRING, state STRING, reason STRING, doc_id STRING, content_hash STRING"
    counts = {"skipped_scope": 0, "beyond_depth": 0}
    frontier = cut(resume.select(*[c.split()[0] for c in row.split(", ")])) if resume is not None else spark.createDataFrame([], row)
    last = (frontier.agg(F.max("seq")).first()[0] or 0) if resume is not None else 0
    start = root if root is not None else frontier.orderBy("seq").first()["url"]

    def considered(found: DataFrame, depth: int) -> None:
        """Adds (url, at, source) to the frontier."""
        nonlocal frontier, last
        new = found.where("url IS NOT NULL").join(frontier.select("url"), "url", "left_anti")
        why = scope_reason(F.col("url"), start if same_origin else None, include, exclude)
        new = cut(new.withColumn("why", why))
        counts["skipped_scope"] += new.where("why IS NOT NULL").count()
        new = new.where("why IS NULL")
        if depth > max_depth:
            counts["beyond_depth"] += new.count()
            return
        one = new.groupBy("url").agg(F.min(F.struct("at", "source")).alias("x")).select(F.col("url").alias("node"), "x.at", "x.source")
        if rules is not None:
            one = allowed(one.withColumnRenamed("node", "url"), rules).withColumnRenamed("url", "node")
        else:
            one = one.withColumn("allowed", F.lit(True))
        placed, last = numbered(one, last)
        state = F.when(F.col("allowed"), "queued").otherwise("skipped")
        none = F.lit(None).cast("string")
        frontier = cut(frontier.unionByName(placed.select(F.col("node").alias("url"), F.lit(depth).alias("depth"), "seq", "source", state.alias("state"), F.when(~F.col("allowed"), "robots").alias("reason"), none.alias("doc_id"), none.alias("content_hash"))))

    if resume is None:
        considered(spark.range(1).select(F.lit(root).alias("url"), F.struct(F.lit(0).cast("bigint").alias("parent"), F.lit(0).alias("pos")).alias("at"), F.lit("start").alias("source")), 0)
        if sitemap is not None:
            considered(sitemap.select("url", F.struct(F.lit(0).cast("bigint").alias("parent"), F.col("position").cast("int").alias("pos")).alias("at"), F.lit("sitemap").alias("source")), 1)
    budget = max_pages - frontier.where("(state = 'done' AND source <> 'redirect') OR state = 'failed'").count()
    page = pages.select(F.col("url").alias("p_url"), F.col("ok").alias("p_ok"), F.col("error").alias("p_error"), F.col("final_url").alias("p_final"), F.col("doc_id").alias("p_doc"), F.col("content_hash").alias("p_hash"))
    for depth in range(max_depth + 1):
        waiting = frontier.where((F.col("state") == "queued") & (F.col("depth") == depth))
        if budget <= 0:
            break
        level, n = numbered(waiting.select(F.col("url").alias("node"), F.col("seq").alias("at")), 0)
        level = level.where(F.col("seq") <= budget).select(F.col("node").alias("url"), F.col("at").alias("from"))
        got = cut(level.join(page, F.col("url") == F.col("p_url"), "left"))
        budget -= min(n, budget)
        if n == 0:
            continue
        # the target of a redirect is done, too, unless it was taken already
        target = got.where("p_ok AND p_final IS NOT NULL AND p_final <> url").groupBy(F.col("p_final").alias("t_url")).agg(F.min_by(F.struct("url", "p_doc", "p_hash"), "from").alias("t"), F.min("from").alias("t_from"))
        f = frontier.join(got.select(F.col("url").alias("g_url"), "p_ok", "p_error", "p_doc", "p_hash"), F.col("url") == F.col("g_url"), "left").join(target, F.col("url") == F.col("t_url"), "left")
        taken, led = F.col("g_url").isNotNull(), F.col("t_url").isNotNull() & (F.col("state") == "queued") & F.col("g_url").isNull()
        f = f.select(
            "url", "depth", "seq", "source",
            F.when(taken, F.when(F.coalesce("p_ok", F.lit(False)), "done").otherwise("failed")).when(led, "done").otherwise(F.col("state")).alias("state"),
            F.when(taken, F.when(~F.coalesce("p_ok", F.lit(False)), F.coalesce("p_error", F.lit("not_found")))).when(led, F.concat(F.lit("redirect_from "), F.col("t.url"))).otherwise(F.col("reason")).alias("reason"),
            F.when(taken, F.when(F.col("p_ok"), F.col("p_doc"))).when(led, F.col("t.p_doc")).otherwise(F.col("doc_id")).alias("doc_id"),
            F.when(taken, F.when(F.col("p_ok"), F.col("p_hash"))).when(led, F.col("t.p_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        )
        frontier = cut(f)
        unknown = target.join(frontier.select(F.col("url").alias("t_url")), "t_url", "left_anti")
        placed, last = numbered(unknown.select(F.col("t_url").alias("node"), F.col("t_from").alias("at"), "t"), last)
        frontier = cut(frontier.unionByName(placed.select(F.col("node").alias("url"), F.lit(depth).alias("depth"), "seq", F.lit("redirect").alias("source"), F.lit("done").alias("state"), F.concat(F.lit("redirect_from "), F.col("t.url")).alias("reason"), F.col("t.p_doc").alias("doc_id"), F.col("t.p_hash").alias("content_hash"))))
        found = got.where("p_ok").join(links, F.coalesce("p_final", "url") == F.col("src"))
        considered(found.select(F.col("dst").alias("url"), F.struct(F.col("from").alias("parent"), F.col("pos").cast("int").alias("pos")).alias("at"), F.col("url").alias("source")), depth + 1)
    # the same content under another document is a duplicate of the first that had it
    first = frontier.where("state = 'done' AND content_hash IS NOT NULL AND source <> 'redirect'").groupBy("content_hash").agg(F.min_by(F.struct("url", "doc_id"), "seq").alias("first"))
    frontier = frontier.join(first, "content_hash", "left")
    copy = (F.col("state") == "done") & (F.col("source") != "redirect") & (F.col("first.doc_id") != F.col("doc_id"))
    frontier = cut(frontier.withColumn("reason", F.when(F.coalesce(copy, F.lit(False)), F.concat(F.lit("duplicate_of "), F.col("first.url"))).otherwise(F.col("reason"))).select(*[c.split()[0] for c in row.split(", ")]))
    tally = {r["k"]: r["n"] for r in frontier.select(F.when(F.col("reason") == "robots", "skipped_robots").when(F.col("reason").startswith("duplicate_of "), "duplicates").otherwise(F.col("state")).alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}
    failed_root = frontier.where("depth = 0 AND source = 'start' AND state = 'failed'").count() > 0
    queued = tally.get("queued", 0)
    stop = "root_failed" if failed_root else "page_limit" if queued else "depth_limit" if counts["beyond_depth"] else "exhausted"
    return frontier, {**counts, "skipped_robots": tally.get("skipped_robots", 0), "duplicates": tally.get("duplicates", 0), "failed": tally.get("failed", 0), "queued": queued, "stop_reason": stop}


def materialized(frontier: DataFrame, versions: DataFrame) -> DataFrame:
    """(crawl_id, doc_id, version, url, markdown) of the pages that a crawl stored, each once whatever addresses led to it."""
    done = frontier.where("state = 'done' AND doc_id IS NOT NULL AND version IS NOT NULL").groupBy("crawl_id", "doc_id", "version").agg(F.min_by("url", "seq").alias("url"))
    return done.join(versions.select("doc_id", "version", "markdown").dropDuplicates(["doc_id", "version"]), ["doc_id", "version"]).select("crawl_id", "doc_id", "version", "url", "markdown")


def added(frontier: DataFrame, rows: DataFrame) -> DataFrame:
    """The frontier with new rows (crawl_id, url, depth, source, at): known addresses of a crawl are left out, others are queued after its last."""
    last = frontier.groupBy("crawl_id").agg(F.max("seq").alias("last"))
    new = rows.join(frontier.select("crawl_id", "url"), ["crawl_id", "url"], "left_anti").groupBy("crawl_id", "url").agg(F.min_by(F.struct("at", "depth", "source"), "at").alias("x"))
    by = Window.partitionBy("crawl_id").orderBy("x.at", "url")
    new = new.join(last, "crawl_id", "left").select("crawl_id", "url", "x.depth", (F.coalesce("last", F.lit(0)) + F.row_number().over(by)).cast("bigint").alias("seq"), F.lit("queued").alias("state"), "x.source")
    return frontier.unionByName(new, allowMissingColumns=True)


def updated(frontier: DataFrame, changes: DataFrame) -> DataFrame:
    """The frontier with the state, reason, doc_id, version and content_hash of changes (crawl_id, url, ...) put in; one change for each address."""
    columns = [c for c in ("state", "reason", "doc_id", "version", "content_hash") if c in changes.columns and c in frontier.columns]
    c = changes.select("crawl_id", "url", F.struct(*columns).alias("__new"))
    j = frontier.join(c, ["crawl_id", "url"], "left")
    return j.select(*[F.when(F.col("__new").isNotNull(), F.col("__new")[x]).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in frontier.columns])


def crawl_id() -> Column:
    """A new crawl id of twelve random hexadecimal digits."""
    return F.concat(F.lit("c_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12))


def resolved_redirects(hops: DataFrame, most: int = 10) -> DataFrame:
    """(url, final, hops, error) of each address that redirects: followed over redirects(src, dst), at most ``most`` times.

    ``error`` is ``loop`` for a chain that comes back to an address it passed, ``too_many`` for one that is longer; ``final`` is null then.
    """
    step = cut(hops.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").groupBy("src").agg(F.min("dst").alias("dst")))
    at = step.select(F.col("src").alias("url"), F.col("dst").alias("final"), F.lit(1).alias("hops"), F.array("src").alias("passed"))
    done = None
    for _ in range(most):
        j = cut(at.join(step, F.col("final") == F.col("src"), "left").withColumn("loop", F.array_contains("passed", F.col("final"))))
        none = F.lit(None).cast("string")
        ended = j.where("src IS NULL OR loop").select("url", F.when(~F.col("loop"), F.col("final")).alias("final"), "hops", F.when(F.col("loop"), "loop").alias("error"))
        done = ended if done is None else done.unionByName(ended)
        at = j.where("src IS NOT NULL AND NOT loop").select("url", F.col("dst").alias("final"), (F.col("hops") + 1).alias("hops"), F.concat("passed", F.array("src")).alias("passed"))
        if at.isEmpty():
            return done
    return done.unionByName(at.select("url", none.alias("final"), "hops", F.lit("too_many").alias("error")))


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) of all nodes below the roots in parent(node, parent), the roots included; whatever the depth, cycles end."""
    known = cut(roots.select("node").where("node IS NOT NULL").distinct())
    front = known
    while True:
        new = cut(edges.join(front.select(F.col("node").alias("parent")), "parent", "left_semi").select("node").distinct().join(known, "node", "left_anti"))
        if new.isEmpty():
            return known
        known, front = cut(known.unionByName(new)), new


def redirect_hops(fetches: DataFrame) -> DataFrame:
    """(arrival, hop, url, status): the redirects of each fetch in order."""
    one = fetches.select("arrival", "redirects").dropDuplicates(["arrival"])
    return one.select("arrival", F.posexplode("redirects").alias("hop", "r")).select("arrival", (F.col("hop") + 1).alias("hop"), "r.url", "r.status")


def scored(expected: DataFrame, returned: DataFrame, forbidden: DataFrame, key: str) -> DataFrame:
    """Coverage, missing, unexpected and forbidden pages of each crawl; the three inputs have ``key`` and url."""
    e = expected.select(key, "url").distinct().withColumn("e", F.lit(1))
    r = returned.select(key, "url").distinct().withColumn("r", F.lit(1))
    f = forbidden.select(key, "url").distinct().withColumn("f", F.lit(1))
    j = e.join(r, [key, "url"], "full").join(f, [key, "url"], "full")
    g = j.groupBy(key).agg(F.count("e").alias("expected"), F.count("r").alias("returned"), F.count_if(F.col("e").isNotNull() & F.col("r").isNotNull()).alias("covered"), F.count_if(F.col("e").isNotNull() & F.col("r").isNull()).alias("missing"), F.count_if(F.col("e").isNull() & F.col("r").isNotNull()).alias("unexpected"), F.count_if(F.col("f").isNotNull() & F.col("r").isNotNull()).alias("forbidden_returned"))
    return g.withColumn("coverage", F.when(F.col("expected") > 0, F.col("covered") / F.col("expected")))
