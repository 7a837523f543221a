import math
import random
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftline.corpus import Corpus
from weftline.functions import format as T
from weftline.functions.register import register
from weftline.functions.stem import stem
from weftline.operators import corpus, crawl, outcome, report, search
from weftline.sources import dispatch, robots
from weftline.streaming import ingest


def test_stemmed_search_matches_sqlite(spark, tmp_path):
    rng = random.Random(3)
    words = "settlement settled settling offers offering harbour harbours hotel hotels Café café the Привет".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25))), " ".join(rng.choices(words, k=2))) for i in range(120)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(text, title, tokenize = 'porter unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO t(rowid, text, title) VALUES (?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "id INT, text STRING, title STRING")
    path = str(tmp_path / "postings")
    search.write_index(search.inverted(df, ["id"], "text", "title"), path)
    postings = search.read_index(spark, path)
    queries = {"settle offer": '"settle" "offer"', '"harbours hotel"': '"harbours hotel"', "settl* cafe": '"settl" * "cafe"', "hotels OR привет": '"hotels" OR "привет"', '"the harbour" settled OR "cafe hotel"': '"the harbour" "settled" OR "cafe hotel"'}
    for query, fts in queries.items():
        want = {r: -s for r, s in db.execute("SELECT rowid, bm25(t, 1.0, 0.5) FROM t WHERE t MATCH ?", (fts,))}
        got = {r["id"]: r["score"] for r in search.search(postings, ["id"], query).collect()}
        assert want and got.keys() == want.keys(), query
        assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want), query
    only = {r for (r,) in db.execute("SELECT rowid FROM t WHERE t MATCH 'title : \"harbour hotel\"'")}
    assert {r["id"] for r in search.search(postings, ["id"], '"harbour hotel"', columns=(1,)).collect()} == only
    assert search.search(postings, ["id"], " * ").count() == 0
    with pytest.raises(ValueError, match="invalid_argument"):
        search.search(postings, ["id"], "a OR OR b")


def test_snippets():
    text = " ".join(f"w{i}" for i in range(50)) + " Harbours here."
    assert search.marked_snippet(text, "harbour", 4) == "…w47 w48 w49 «Harbours»…"
    assert search.marked_snippet("One two", "three") == "One two"
    assert search.marked_snippet(None, "x") == ""
    assert search.marked_snippet(text, "w0", 2) == "«w0» w1…"


def test_selections_and_slices(spark):
    assert corpus.selection("b3, b7-b5,10") == [(3, 3), (5, 7), (10, 10)]
    with pytest.raises(ValueError, match="invalid_argument"):
        corpus.selection("b3,x")
    texts = spark.createDataFrame([("d", 1, "aaaa\n\nbbbb\n\ncccc")], "doc_id STRING, version INT, markdown STRING")
    blocks = spark.createDataFrame([("d", 1, o) for o in (0, 6, 12)], "doc_id STRING, version INT, char_offset BIGINT")
    asked = [(1, 0, 8), (2, 6, 8), (3, 12, 8), (4, 99, 8), (5, -3, 3), (6, 7, 4)]
    r = spark.createDataFrame([(i, "d", 1, o, n) for i, o, n in asked], "request_id INT, doc_id STRING, version INT, offset INT, max_chars INT")
    got = {x["request_id"]: (x["slice"], x["next_offset"], x["truncated"]) for x in corpus.slice_bounds(r, texts, blocks).collect()}
    assert got == {1: ("aaaa", 6, True), 2: ("bbbb", 12, True), 3: ("cccc", None, True), 4: ("", None, True), 5: ("aaa", 3, True), 6: ("bbb", 11, True)}


def test_crawl_against_brute_force(spark):
    rng = random.Random(4)
    urls = [f"https://s.example/p{i}" for i in range(50)] + ["https://s.example/private/x", "https://s.example/a.png", "https://other.example/"]
    links = {u: rng.sample(urls, rng.randint(0, 6)) for u in urls}
    info = {u: (i % 9 != 4, None if i % 9 != 4 else "http_error", urls[i + 1] if i % 10 == 3 else u, f"d{i % 40}", f"h{i % 30}") for i, u in enumerate(urls) if i != 7}
    info[urls[0]] = (True, None, urls[0], "d0", "h0")

    def plain(max_pages, max_depth):
        known, queue, processed, scope, deep = {}, [], 0, 0, 0

        def consider(u, depth, source):
            nonlocal scope, deep
            if u in known:
                return
            if not u.startswith("https://s.example/") or u.endswith(".png"):
                scope += 1
            elif depth > max_depth:
                deep += 1
            elif "/private" in u:
                known[u] = [depth, source, "skipped", "robots"]
            else:
                known[u] = [depth, source, "queued", None]
                queue.append(u)

        consider(urls[0], 0, "start")
        for u in (urls[5], urls[6]):
            consider(u, 1, "sitemap")
        for depth in range(max_depth + 1):
            level = [u for u in queue if known[u][0] == depth and known[u][2] == "queued"][: max(0, max_pages - processed)]
            processed += len(level)
            led = []
            for u in level:
                ok, error, final, *_ = info.get(u, (False, "not_found", u))
                known[u][2:] = ["done", None] if ok else ["failed", error]
                if ok and final != u:
                    led.append((final, u))
            for final, u in led:
                if final not in known:
                    known[final] = [depth, "redirect", "done", f"redirect_from {u}"]
                elif known[final][2] == "queued":
                    known[final][2:] = ["done", f"redirect_from {u}"]
            for u in level:
                if known[u][2] == "done":
                    for x in dict.fromkeys(links[info[u][2]]):
                        consider(x, depth + 1, u)
        return known, scope, deep

    pages = spark.createDataFrame([(u, *x) for u, x in info.items()], "url STRING, ok BOOLEAN, error STRING, final_url STRING, doc_id STRING, content_hash STRING")
    edges = spark.createDataFrame([(u, x, i) for u, t in links.items() for i, x in enumerate(t)], "src STRING, dst STRING, pos INT")
    sitemap = spark.createDataFrame([(urls[5], 0), (urls[6], 1)], "url STRING, position INT")
    rules = robots.rules(spark.createDataFrame([("https://s.example", 200, "User-agent: *\nDisallow: /private")], "origin STRING, status INT, body STRING"))
    for max_pages, max_depth in ((1000, 2), (9, 3)):
        frontier, counts = crawl.crawled(pages, edges, urls[0], sitemap, rules, max_pages=max_pages, max_depth=max_depth)
        rows = {r["url"]: r for r in frontier.collect()}
        want, scope, deep = plain(max_pages, max_depth)
        assert {u: (r["depth"], r["source"], r["state"]) for u, r in rows.items()} == {u: (x[0], x[1], x[2]) for u, x in want.items()}
        assert all(r["reason"] == want[u][3] for u, r in rows.items() if not (r["reason"] or "").startswith("duplicate_of"))
        assert (counts["skipped_scope"], counts["beyond_depth"]) == (scope, deep)
        assert counts["stop_reason"] == ("page_limit" if counts["queued"] else "depth_limit")
    again, counts = crawl.crawled(pages, edges, None, None, rules, max_pages=1000, max_depth=3, resume=frontier)
    assert counts["queued"] == 0 and again.count() > frontier.count()
    lost, counts = crawl.crawled(pages, edges, urls[7], max_depth=1)
    assert counts["stop_reason"] == "root_failed" and lost.count() == 1


def test_redirects_and_descendants(spark):
    hops = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("s", "s")] + [(f"n{i}", f"n{i + 1}") for i in range(12)]
    got = {r["url"]: (r["final"], r["hops"], r["error"]) for r in crawl.resolved_redirects(spark.createDataFrame(hops, "src STRING, dst STRING")).collect()}
    assert got["a"] == ("c", 2, None) and got["x"][2] == "loop" and got["n0"][2] == "too_many" and got["n5"] == ("n12", 7, None) and "s" not in got
    tree = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8), (1, 4)], "node INT, parent INT")
    assert {r[0] for r in crawl.descendants(tree, spark.createDataFrame([(2,)], "node INT")).collect()} == {1, 2, 3, 4}


def test_texts_by_type():
    title, blocks = dispatch.text_document("# One  two\n\nSome\ntext\n\n```py\na = 1\n\nb\n```\n\n~~~\nx", "text/markdown")
    assert title == "One two"
    assert [(b["type"], b["level"], b["lang"]) for b in blocks] == [("heading", 1, None), ("paragraph", None, None), ("code", None, "py"), ("code", None, "x")]
    assert blocks[2]["text"] == "a = 1\n\nb" and blocks[1]["text"] == "Some text"
    assert dispatch.text_document('{"a": 1}\n', "application/json")[1] == [{"type": "code", "level": None, "lang": "json", "text": '{"a": 1}', "markdown": '```json\n{"a": 1}\n```'}]
    assert [b["type"] for b in dispatch.text_document("# no heading\r\n \r\n```\nx", "text/plain")[1]] == ["paragraph", "paragraph"]
    assert dispatch.text_document("", "text/plain") == ("", [])


def test_dispatch_and_sitemaps(spark):
    rows = [(1, "text/html", b"<p>hi"), (2, "", b"  <!DOCTYPE html><p>x"), (3, "application/octet-stream", b"%PDF-1.4"), (4, "text/csv", b"a,b"), (5, "image/png", b"x"), (6, None, None)]
    df = spark.createDataFrame([(a, "https://a.example", t, None, b) for a, t, b in rows], "arrival BIGINT, final_url STRING, content_type STRING, content_type_header STRING, body BINARY")
    got = {r["arrival"]: (r["kind"], r["error"], len(r["blocks"])) for r in dispatch.documents(df).collect()}
    assert got == {1: ("html", None, 1), 2: ("html", None, 1), 3: ("pdf", "needs_line_table", 0), 4: ("text", None, 1), 5: (None, "unsupported_content_type", 0)}
    files = [("i", b"<sitemapindex><loc>s1</loc><loc>s2</loc><loc>i</loc></sitemapindex>"), ("s1", b"<urlset><loc>https://a/1</loc><loc>https://a/2</loc></urlset>"), ("s2", b"https://a/2\nhttps://a/3")]
    maps = spark.createDataFrame(files, "url STRING, body BINARY")
    assert [tuple(r) for r in dispatch.sitemaps_read(maps, ["i", "gone"]).orderBy("position").collect()] == [("https://a/1", "s1", 0), ("https://a/2", "s1", 1), ("https://a/3", "s2", 2)]
    assert dispatch.sitemaps_read(maps, ["i"], most_files=1).count() == 0


def test_outcomes(spark):
    df = spark.createDataFrame([("ENOTFOUND",), ("ETIMEDOUT",), ("ECONNRESET",), ("AbortError",), ("other",), (None,)], "c STRING")
    assert [r[0] for r in df.select(outcome.error_code(F.col("c"))).collect()] == ["dns_failure", "timeout", "connect_failed", "cancelled", "internal", None]
    assert [r[0] for r in df.limit(1).select(outcome.error_code(F.col("c"), F.lit(True), F.lit(True))).collect()] == ["timeout"]
    urls = ["https://a.example/x", "ftp://a", "https://u:p@a.example", "http://10.1.2.3/", "http://8.8.8.8:80/", "http://[::1]/", "http://[2606:4700::1]/", "http://localhost:3/", "x"]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i INT, u STRING").orderBy("i").select(outcome.url_violation(F.col("u"))).collect()]
    assert got == [None, "scheme", "credentials", "address", None, "address", None, "address", "invalid"]
    hosts = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("c", None)], "h STRING, ok BOOLEAN")
    assert {r["h"]: r["allowed"] for r in outcome.resolved_allowed(hosts, "h", "ok").collect()} == {"a": False, "b": True, "c": False}
    one = spark.createDataFrame([({"a": 1.26, "b": -1.0, "c": float("nan")},)], "t MAP<STRING, DOUBLE>")
    assert one.select(outcome.rounded_timings(F.col("t"))).first()[0] == {"a": 1.3}
    pages = spark.createDataFrame([("p", False, True, 100), ("p", True, True, 100), ("q", False, True, 100), ("q", True, False, None), ("r", True, True, 5), ("s", False, False, None)], "k STRING, rendered BOOLEAN, ok BOOLEAN, chars INT")
    assert {r["k"]: r["choice"] for r in outcome.chosen(pages, "k").collect()} == {"p": "rendered", "q": "partial", "r": "rendered", "s": "none"}


def test_formats(spark):
    df = spark.createDataFrame([("=1,\"x\"", "a|b\n c", "\x1b[31mred\x1b[0m‮x", 1536, "https://a/x/index.html?utm_a=1&q=2#f")], "a STRING, b STRING, c STRING, n BIGINT, u STRING")
    got = df.select(T.csv_cell(F.col("a")), T.markdown_cell(F.col("b")), T.terminal_text(F.col("c")), T.byte_size(F.col("n")), T.page_key(F.col("u")), T.fence(F.lit("a ```` b")), T.fnv1a(F.lit("a")), T.escape_html(F.lit("<a href='x'>")), T.slug(F.lit("A b, c!"))).first()
    assert tuple(got) == ("\"'=1,\"\"x\"\"\"", "a\\|b c", "redx", "1.5 KiB", "https://a/x/?q=2", "`````\na ```` b\n`````", 0xE40C292C, "&lt;a href=&#39;x&#39;&gt;", "a-b-c")
    now = F.lit(datetime(2024, 1, 31, 12)).cast("timestamp")
    ages = spark.createDataFrame([("30d",), ("12h",), ("2024-01-05",), ("soon",)], "a STRING")
    assert [r[0] for r in ages.select(F.date_format(T.age_start(F.col("a"), now), "yyyy-MM-dd HH:mm")).collect()] == ["2024-01-01 12:00", "2024-01-31 00:00", "2024-01-05 00:00", None]
    assert spark.range(1).select(T.gold_text(F.lit("<p>a &amp;lt; b</p><script>x</script><b>c</b>"))).first()[0] == "a &lt; b c"


def test_report_pieces(spark):
    assert report.shuffled(list("abcdef"), 7) == report.shuffled(list("abcdef"), 7) and sorted(report.shuffled(list("abcdef"), 7)) == list("abcdef")
    r = spark.createDataFrame([("p", "c1", 1, "ok", 5.0, 0.5), ("p", "c1", 2, "ok", 7.0, 1.0), ("p", "c2", 2, "error", 9.0, None), ("q", "c1", 2, "ok", 6.0, 0.2), ("q", "c3", 1, "na", None, None)], "profile STRING, case STRING, repetition INT, outcome STRING, latency DOUBLE, score DOUBLE")
    got = {x["profile"]: x for x in report.computed(r, ["profile"]).collect()}
    assert (got["p"]["attempted"], got["p"]["success_rate"], got["p"]["mean_usable"], got["p"]["warm_p50"], got["p"]["first_p50"]) == (3, pytest.approx(2 / 3), 0.5, 7.0, 5.0)
    assert got["q"]["not_applicable"] == 1 and got["q"]["first_p50"] is None
    both = {x["measure"]: x for x in report.paired_intervals(r, "p", "q").collect()}
    assert both["delta"]["value"] == 1.0 and both["delta"]["low"] is None
    u = {x["metric"]: x for x in report.uncertainty(r, "p", {"latency": F.col("latency"), "score": F.col("score")}).collect()}
    assert u["latency"]["value"] == 7.0 and u["latency"]["cases"] == 2 and u["score"]["cases"] == 1
    cases = spark.createDataFrame([("c1", "dev")], "case STRING, split STRING")
    assert report.with_cases(r, cases).where("split IS NULL").count() == 2
    assert report.union_of(r.select("case"), cases).count() == 6


def test_corpus_object(spark, data, tmp_path):
    c = Corpus.open(spark, data)
    some = c.versions.where("markdown IS NOT NULL").orderBy("doc_id", "version").first()
    target = spark.createDataFrame([(f"fk:{some['doc_id']}@{some['version']}",), (some["final_url"],), ("https://nowhere.example/",)], "target STRING")
    got = {r["target"]: r for r in c.read(target, max_chars=50).collect()}
    assert some["markdown"].startswith(got[f"fk:{some['doc_id']}@{some['version']}"]["slice"]) and "https://nowhere.example/" not in got
    on = c.read(target.limit(1), offset=got[f"fk:{some['doc_id']}@{some['version']}"]["next_offset"]).first()
    assert on["slice"] and some["markdown"].endswith(on["slice"].rstrip("\n") or " ") or on["truncated"]
    assert {r["block_id"] for r in c.read(target.limit(1), blocks="b1-b2").collect()} <= {"b1", "b2"}
    i = c.indexed(str(tmp_path / "postings"))
    block = c.blocks.where("length(text) > 40").orderBy("doc_id", "idx").first()
    word = max(block["text"].split(), key=lambda w: len(w) if w.isascii() and w.isalpha() else 0)
    hits = i.search(word, all_versions=True, limit=200).collect()
    assert hits and all("«" in h["snippet"] or stem(word.lower()) in {stem(w) for w in (h["title"] or "").lower().split()} for h in hits)
    assert [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)
    gone = c.delete(target.limit(1))
    assert gone.versions.where(F.col("doc_id") == some["doc_id"]).count() == gone.blocks.where(F.col("doc_id") == some["doc_id"]).count() == 0
    kept = c.prune(keep=1)
    assert kept.versions.groupBy("doc_id").count().where("count > 1").count() == 0 and kept.versions.select("doc_id").distinct().count() == c.versions.where("doc_id IS NOT NULL").select("doc_id").distinct().count()
    c.export(str(tmp_path / "out"), raw=True)
    assert spark.read.json(str(tmp_path / "out")).count() == c.versions.count()
    assert c.documents(5).count() == 5 and c.versions_of(target).count() >= 1
    tables = Corpus.ingest(spark.read.parquet(f"{data}/fetch_log.parquet"))
    assert tables["documents"].where("error IS NULL").count() > 0 and tables["versions"].count() > 0


def test_registered_functions(spark):
    assert register(spark)[-1] == "split_blocks"
    assert spark.sql("SELECT tokenize_porter('Offers settled') AS t").first()["t"] == [stem("offers"), stem("settled")]
    assert spark.sql("SELECT find_quote('A  big dog', 'BIG DOG').start AS s").first()["s"] == 3
    assert [r["type"] for r in spark.sql("SELECT * FROM split_blocks('# a\n\nb', 'text/markdown')").collect()] == ["heading", "paragraph"]
    assert spark.sql("SELECT size(extract_html(CAST('<p>x' AS BINARY), CAST(NULL AS STRING), 'https://a/').blocks) AS n").first()["n"] == 1


def test_a_batch_that_comes_twice_counts_once(spark, tmp_path):
    path = str(tmp_path / "versions")
    rows = lambda *x: spark.createDataFrame(list(x), "final_url STRING, raw_hash STRING, arrival BIGINT")
    one, two = rows(("u", "A", 1), ("u", "B", 2), ("u", "A", 3)), rows(("u", "A", 4), ("u", "C", 5), ("v", "A", 6))
    for batch, number in ((one, 0), (one, 0), (two, 1), (two, 1)):
        ingest.append_versions(batch, path, number)
    got = sorted((r["final_url"], r["version"], r["raw_hash"]) for r in spark.read.parquet(path).collect())
    assert got == [("u", 1, "A"), ("u", 2, "B"), ("u", 3, "A"), ("u", 4, "C"), ("v", 1, "A")]


def test_late_rows_of_windows_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "ts TIMESTAMP, k STRING"
    query = None
    for hour, keys in ((1, ["a", "a"]), (9, ["a"]), (1, ["late"]), (20, ["b"])):
        spark.createDataFrame([(datetime(2024, 1, 1, hour), k) for k in keys], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = ingest.windowed_counts(stream, "ts", "k").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r["k"], r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 2), ("a", 1)}


def test_retention(spark):
    v = spark.createDataFrame([("a", i, f"2023-0{i}-01", "s") for i in (1, 2, 4)] + [("b", 1, None, "s")], "doc_id STRING, version INT, fetched_at STRING, snapshot_hash STRING")
    key = lambda df: sorted((r["doc_id"], r["version"]) for r in df.collect())
    assert key(corpus.retained(v, 2)) == [("a", 4), ("b", 1)]  # by number: 3 is missing
    assert key(corpus.retained(v, None, "2023-02-01")) == [("a", 2), ("a", 4), ("b", 1)]
    assert key(corpus.dropped_snapshots(v, "old").where("snapshot_hash IS NOT NULL")) == [("a", 4), ("b", 1)]
    assert corpus.dropped_snapshots(v, "all").where("snapshot_hash IS NOT NULL").count() == 0


def test_encodings_are_cut_before_they_are_whole():
    import gzip
    import zlib

    import zstandard

    from weftline.sources import records

    bomb = gzip.compress(b"\0" * 50_000_000)
    body, error = records.decode_content(bomb, "gzip", 1_000)
    assert body == b"\0" * 1_000 and error == "decompressed_limit"
    assert records.decode_content(zlib.compress(b"abc"), "deflate") == records.decode_content(zlib.compress(b"abc")[2:-4], "deflate") == (b"abc", None)
    assert records.decode_content(zstandard.compress(gzip.compress(b"abc")), "gzip, zstd") == (b"abc", None)
    assert records.decode_content(b"no", "zstd")[1].startswith("decode_failed") and records.decode_content(b"no", "gzip")[1].startswith("decode_failed")


def test_sinks(spark, tmp_path):
    from weftline.sources import records

    one = spark.createDataFrame([(1, "x", ["partial: cut"])], "id INT, t STRING, w ARRAY<STRING>")
    records.append_records(one, str(tmp_path / "run"))
    records.append_records(one.withColumn("id", F.lit(2)), str(tmp_path / "run"))
    assert sorted(r["id"] for r in records.json_lines(spark, str(tmp_path / "run"), "id INT, t STRING").collect()) == [1, 2]
    records.write_reports({"summary": one.drop("w").coalesce(1), "cases": one.drop("w").coalesce(1)}, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report/summary")).first()["t"] == "x"
    files = records.manifest(spark, str(tmp_path / "report")).where("path LIKE '%.csv'").collect()
    assert {f["path"].split("/")[0] for f in files} == {"summary", "cases"} and len({f["sha256"] for f in files}) == 1
    status, reasons = outcome.envelope_status(F.lit(None).cast("string"), F.col("w"))
    line = one.select(records.envelope(status, "read", F.struct("id"), F.col("w"), F.lit(None).cast("map<string,double>")).alias("e"), records.exit_code(status).alias("x"), F.size(reasons).alias("n")).first()
    assert line["e"] == '{"status":"partial","tool":"read","data":{"id":1},"warnings":["partial: cut"]}' and (line["x"], line["n"]) == (3, 0)


def test_headings_and_recall(spark):
    from weftline.operators import score

    df = spark.createDataFrame([("k", "# One\n\nTwo\n===\n\nThree\n---\n\n- item\n---\ntext here", ["one", "Four"], ["TEXT **here**"], [])], "k STRING, m STRING, h ARRAY<STRING>, p ARRAY<STRING>, none ARRAY<STRING>")
    assert df.select(score.heading_texts(F.col("m"))).first()[0] == ["One", "Two", "Three"]
    got = score.recall_fractions(df, "k", "m", {"headings": "h", "passages": "p", "codes": "none"}).first()
    assert (got["headings"], got["passages"], got["codes"]) == (0.5, 1.0, None)
    c = spark.createDataFrame([("r", 1, "h", "b", "a  big dog", 3, "big dog")], "ref STRING, version INT, content_hash STRING, block_hash STRING, text STRING, offset INT, quote STRING")
    cols = {n: F.col(n) for n in c.columns}
    assert c.select(score.citation_verified(cols, cols), score.citation_verified(cols, {**cols, "version": F.lit(2)})).first() == (True, False)


def test_crawl_state(spark):
    f = spark.createDataFrame([("c", "u1", 0, 1, "done", "seed", "d", 1), ("c", "u2", 1, 2, "queued", "link", None, None)], "crawl_id STRING, url STRING, depth INT, seq BIGINT, state STRING, source STRING, doc_id STRING, version INT")
    new = spark.createDataFrame([("c", "u2", 1, "link", 5), ("c", "u4", 2, "link", 7), ("c", "u3", 2, "link", 6), ("e", "u1", 0, "seed", 1)], "crawl_id STRING, url STRING, depth INT, source STRING, at INT")
    more = crawl.added(f, new)
    assert sorted((r["crawl_id"], r["url"], r["seq"], r["state"]) for r in more.collect()) == [("c", "u1", 1, "done"), ("c", "u2", 2, "queued"), ("c", "u3", 3, "queued"), ("c", "u4", 4, "queued"), ("e", "u1", 1, "queued")]
    done = crawl.updated(more, spark.createDataFrame([("c", "u2", "done", "d2", 3)], "crawl_id STRING, url STRING, state STRING, doc_id STRING, version INT"))
    assert done.where("url = 'u2'").first().asDict()["doc_id"] == "d2" and done.where("state = 'queued'").count() == 3
    v = spark.createDataFrame([("d2", 3, "text")], "doc_id STRING, version INT, markdown STRING")
    assert [(r["url"], r["markdown"]) for r in crawl.materialized(done, v).orderBy("url").collect()] == [("u2", "text")] or crawl.materialized(done, v).count() == 1
    assert len(spark.range(1).select(crawl.crawl_id()).first()[0]) == 14


def test_pages_over_http(spark):
    import gzip
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from weftline.sources.http import fetched

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            there = {"/a": (301, "/b"), "/b": (302, "/page"), "/loop": (302, "/loop2"), "/loop2": (302, "/loop"), "/many": (302, "/many0")} | {f"/many{i}": (302, f"/many{i + 1}") for i in range(12)}
            if self.path in there:
                self.send_response(there[self.path][0])
                self.send_header("Location", there[self.path][1])
                self.end_headers()
                return
            body = gzip.compress(b"<p>hello")
            self.send_response(200 if self.path == "/page" else 500)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Encoding", "gzip")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    try:
        rows = {r["requested_url"].removeprefix(root): r for r in fetched(spark, [root + x for x in ("/page", "/a", "/loop", "/many", "/gone")] + ["ftp://x", "http://u:p@127.0.0.1/"], batch=2, timeout=10, private=True).collect()}
        refused = fetched(spark, [root + "/page"], timeout=10).first()
    finally:
        server.shutdown()
    assert rows["/page"]["body"] == b"<p>hello" and rows["/page"]["http_status"] == 200 and rows["/page"]["content_type"] == "text/html" and rows["/page"]["error"] is None
    assert rows["/a"]["final_url"] == root + "/page" and [(h["url"].removeprefix(root), h["status"]) for h in rows["/a"]["redirects"]] == [("/a", 301), ("/b", 302)]
    assert (rows["/loop"]["error"], rows["/many"]["error"], rows["/gone"]["error"]) == ("redirect_loop", "too_many_redirects", "http_error")
    assert (rows["ftp://x"]["error"], rows["http://u:p@127.0.0.1/"]["error"], refused["error"]) == ("invalid_url", "blocked_by_policy", "blocked_by_policy")


def test_a_stream_ends_or_is_stopped(spark, tmp_path):
    schema = "final_url STRING, raw_hash STRING, arrival BIGINT"
    source = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([("u", f"h{i}", i)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    assert ingest.ended(ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")), 120) == "exhausted"
    assert spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().count() == 3
    assert ingest.ended(ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "state"), every="1 hour"), 1) == "deadline"
