import math
import random
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.functions import netpolicy, text, urls
from weftline.operators import corpus, crawl, score, search, stats
from weftline.plans import catalog
from weftline.sources import pages, robots

URLS = [
    ("HTTP://Example.COM:80/a?utm_source=x&b=2#frag", "http://example.com/a?b=2"),
    ("https://example.com", "https://example.com/"),
    ("https://example.com/p?", "https://example.com/p"),
    ("https://example.com:8443/p?fbclid=1", "https://example.com:8443/p"),
    ("https://example.com/p?UTM_Source=x&q=1", "https://example.com/p?q=1"),
    ("https://example.com/p?a=1&&b=2", "https://example.com/p?a=1&&b=2"),
    ("https://example.com/p?a&&b=x%20y&gclid=1", "https://example.com/p?a=&b=x+y"),
    ("https://example.com/p?utm_=1&ref_srcx=2", "https://example.com/p?utm_=1&ref_srcx=2"),
    ("https://example.com/p?FBCLID=1", "https://example.com/p"),
    ("no url", None),
    (None, None),
]


PLAIN = [
    ("**Bold** [link](https://x.test/a) `code` \\_x\\_ &amp; ![alt](i.png)", "bold link code x & alt"),
    ("‘q’ “r” &quot;s&quot;", "'q' \"r\" \"s\""),
    ("[![alt](i.png)](https://x.test) a\\.b \\[c\\]", "alt a.b [c]"),
    ("&amp;lt; # A > b", "&lt; a b"),
    ("", ""),
    (None, None),
]


def test_plain_text(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PLAIN)], "i INT, t STRING")
    assert [r[0] for r in df.orderBy("i").select(text.plain(F.col("t"))).collect()] == [w for _, w in PLAIN]


def test_nearest_ranks_against_sorting(spark):
    rng = random.Random(12)
    rows = [(rng.choice("abc") if i % 3 else "a", rng.choice([float(rng.randint(0, 40)), rng.random(), None])) for i in range(900)] + [("z", None)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    got = {r["k"]: (r["p50"], r["p95"]) for r in stats.nearest_ranks(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    want = {}
    for k in "abc":
        values = sorted(v for g, v in rows if g == k and v is not None)
        want[k] = tuple(values[math.ceil(p * len(values)) - 1] for p in (0.5, 0.95))
    assert got == want
    assert stats.nearest_ranks(df.limit(0), ["k"], "v", {"p50": 0.5}).count() == 0


def test_pairs_of_repeated_rows(spark):
    df = spark.createDataFrame([("l", 1, 2.0), ("l", 1, 4.0), ("r", 1, 1.0), ("r", 2, 5.0)], "s STRING, k INT, v DOUBLE")
    assert sorted(tuple(r) for r in stats.paired(df, "s", "l", "r", ["k"], "v").select("k", "a", "b").collect()) == [(1, 3.0, 1.0), (2, None, 5.0)]
    with pytest.raises(Exception, match="several rows of l for 1"):
        stats.paired(df, "s", "l", "r", ["k"], "v", repeated="error").collect()


def test_urls(spark):
    df = spark.createDataFrame([(u,) for u, _ in URLS], "u STRING")
    assert [r[0] for r in df.select(urls.normalize_url(F.col("u"))).collect()] == [w for _, w in URLS]
    site = spark.createDataFrame([("https://user@WWW.Example.com:8080/x",), ("ftp:/x",)], "u STRING").select(urls.site_of(F.col("u"))).collect()
    assert [r[0] for r in site] == ["example.com", None]


@pytest.mark.parametrize(("pattern", "path", "match"), [("/docs/*", "/docs/a", True), ("/docs/*", "/docs/a/b", False), ("/docs/**", "/docs/a/b", True), ("/a?c", "/abc", True), (r"/\d+/i", "/x/12", True), ("/docs/", "/docs/", True)])
def test_globs(pattern, path, match):
    import re

    assert bool(re.search(urls.glob_to_regex(pattern), path)) is match


def test_refs(spark):
    df = spark.createDataFrame([("fk:d_0123456789abcdef@2#b3",), ("d_0123456789abcdef",), ("x",), (None,)], "r STRING")
    got = [tuple(r[0]) if r[0] else None for r in df.select(text.parse_ref(F.col("r"))).collect()]
    assert got == [("d_0123456789abcdef", 2, "b3"), ("d_0123456789abcdef", None, None), None, None]


def test_versions_count_changes_not_contents(spark):
    df = spark.createDataFrame([("u", h, i) for i, h in enumerate("AABA")] + [("u", None, 9), (None, "A", 10)], "u STRING, h STRING, n INT")
    got = sorted(tuple(r) for r in corpus.version_islands(df, "u", "h", "n").select("version", "h", "first_seen", "last_seen", "fetches").collect())
    assert got == [(1, "A", 0, 1, 2), (2, "B", 2, 2, 1), (3, "A", 3, 3, 1)]


def test_search_matches_sqlite(spark):
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30))), rng.choice(words)) for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(text, title)")
    db.executemany("INSERT INTO t(rowid, text, title) VALUES (?, ?, ?)", rows)
    want = {r: -s for r, s in db.execute("SELECT rowid, bm25(t, 1.0, 0.5) FROM t WHERE t MATCH 'alpha zeta'")}
    df = spark.createDataFrame(rows, "id INT, text STRING, title STRING")
    got = {r["id"]: r["score"] for r in search.bm25(df, ["id"], "text", "title", ["alpha", "zeta"]).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_query_compiler():
    assert search.compile_query('OR "a b" c* OR OR d OR') == [[(["a", "b"], False), (["c"], True)], [(["d"], False)]]
    assert search.compile_query("  * ") == []


def test_bootstrap_equals_the_sequential_generator(spark):
    def generator(seed):
        state = seed & 0xFFFFFFFF
        imul = lambda a, b: (a * b) & 0xFFFFFFFF
        while True:
            state = (state + 0x6D2B79F5) & 0xFFFFFFFF
            t = imul(state ^ (state >> 15), state | 1)
            t ^= (t + imul(t ^ (t >> 7), t | 61)) & 0xFFFFFFFF
            yield ((t ^ (t >> 14)) & 0xFFFFFFFF) / 2**32

    g = generator(stats.SEED)
    want = [math.floor(next(g) * 7) for _ in range(70)]
    got = [r["pick"] for r in stats.draws(spark.range(1), 7, times=10).orderBy("draw", "slot").collect()]
    assert got == want
    one = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "c STRING, v DOUBLE")
    assert tuple(stats.cluster_bootstrap(one, "c", "v").first()) == (2.0, None, None, 1, 2)


def test_registered_bootstrap_draws_every_user_2000_times(spark, data):
    got = catalog.QUERIES["bootstrap_interval"](spark, data).first()
    users = {}
    for u, v in duckdb.sql(f"SELECT user_id, floor(value * 100) FROM '{data}/events.parquet' WHERE event_type = 'purchase'").fetchall():
        users.setdefault(u, []).append(v)
    cases = [(sum(users[u]), len(users[u])) for u in sorted(users)]
    state, means = 424242, []
    for _ in range(2000):
        total = n = 0
        for _ in cases:
            state = (state + 0x6D2B79F5) & 0xFFFFFFFF
            t = (state ^ (state >> 15)) * (state | 1) & 0xFFFFFFFF
            t ^= (t + ((t ^ (t >> 7)) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
            x = cases[math.floor((t ^ (t >> 14)) / 2**32 * len(cases))]
            total, n = total + x[0], n + x[1]
        means.append(total / n)
    means.sort()
    whole = sum(c[0] for c in cases) / sum(c[1] for c in cases)
    assert (got["cases"], got["attempts"]) == (len(cases), sum(c[1] for c in cases)) and len(cases) > 2
    assert (got["value"], got["low"], got["high"]) == pytest.approx((whole, means[49], means[1949]), abs=2e-6)


def test_windows_of_the_latest_version(spark, data):
    rows = lambda q: duckdb.sql(q.replace("@", data)).fetchall()
    last = dict(rows("SELECT doc_id, max(version) FROM '@/versions.parquet' WHERE markdown IS NOT NULL GROUP BY doc_id"))
    blocks = {}
    for doc, version, block, at, n in rows("SELECT DISTINCT doc_id, version, block_id, char_offset, length(markdown) FROM '@/blocks.parquet'"):
        blocks.setdefault((doc, version), []).append((block, at, n))
    asked = rows("SELECT DISTINCT request_id, doc_id, version, coalesce(max_chars, 24000) FROM '@/slices.parquet'")
    want = {(r, b, at) for r, doc, version, stop in asked for b, at, n in blocks.get((doc, last.get(doc) if version is None else version), []) if at + n > 0 and at < stop}
    assert {r for r, _, version, _ in asked if version is None} & {w[0] for w in want}
    got = [tuple(r) for r in catalog.QUERIES["window_blocks"](spark, data).select("request_id", "block_id", "char_offset").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_quotes_are_whole_blocks(spark, data, tmp_path):
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN idx = 1 THEN markdown || '!' ELSE markdown END AS markdown) FROM '{data}/blocks.parquet') TO '{tmp_path}/blocks.parquet'")
    duckdb.sql(f"COPY (SELECT * FROM '{data}/versions.parquet') TO '{tmp_path}/versions.parquet'")
    texts = {r[:2]: r[2] for r in duckdb.sql(f"SELECT doc_id, version, markdown FROM '{data}/versions.parquet'").fetchall()}
    blocks = duckdb.sql(f"SELECT DISTINCT doc_id, version, idx, block_id, char_offset, markdown FROM '{tmp_path}/blocks.parquet'").fetchall()
    want = {(d, v, b): texts[d, v][at : at + len(m)] == m for d, v, _, b, at, m in blocks if (d, v) in texts}
    assert any(len(m) >= 40 and not want.get((d, v, b), True) for d, v, _, b, _, m in blocks) and any(len(m) < 40 for *_, m in blocks)
    got = [tuple(r) for r in catalog.QUERIES["quote_spans"](spark, str(tmp_path)).select("doc_id", "version", "block_id", "verified").collect()]
    assert len(got) == len(want) and {r[:3]: r[3] for r in got} == want


def test_token_overlap(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "b", "c"]), (2, ["x"], ["y"])], "k INT, o ARRAY<STRING>, g ARRAY<STRING>")
    got = {r["k"]: (round(r["precision"], 4), round(r["recall"], 4)) for r in score.token_overlap(df, "k", F.col("o"), F.col("g")).collect()}
    assert got == {1: (0.6667, 0.6667), 2: (0.0, 0.0)}


def test_crawl_is_bounded_and_ordered(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "d", 0), ("d", "a", 0), ("d", "e", 1)], "src STRING, dst STRING, pos INT")
    got = [tuple(r) for r in crawl.breadth_first(edges, "a", 2).orderBy("seq").collect()]
    assert got == [("a", 0, 1), ("b", 1, 2), ("c", 1, 3), ("d", 2, 4)]
    assert crawl.breadth_first(edges, "a", 9, max_pages=3).count() == 3
    assert crawl.breadth_first(edges.limit(0), "a", 2).count() == 1


def test_crawl_over_real_links_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    urls = [f"https://s.example/p{i}" for i in range(60)]
    links = {u: rng.sample(urls, rng.randint(0, 4)) + ["https://s.example/gone"] * (i % 9 == 0) for i, u in enumerate(urls)}
    links[urls[1]] = urls[:50]  # a wide level
    page = lambda u: ("<body><main><p>Some text of the page " + "".join(f"<a href='{x}#top'>x</a> " for x in links[u]) + "</p></main></body>").encode()
    rows = [(i, u.upper().replace("/P", "/p") if i % 2 else u, "text/html", None, page(u)) for i, u in enumerate(urls)]
    spark.createDataFrame(rows + rows[:5], "arrival BIGINT, final_url STRING, content_type STRING, content_type_header STRING, body BINARY").write.parquet(f"{tmp_path}/fetch_log.parquet")
    seeds = [("b", urls[2], 1, "seed"), ("a", urls[7], 2, "seed"), ("a", urls[9], 1, "seed"), ("a", urls[30], 3, "link"), ("b", urls[9], 2, "seed")]
    spark.createDataFrame(seeds, "crawl_id STRING, url STRING, seq BIGINT, source STRING").write.parquet(f"{tmp_path}/crawl_urls.parquet")
    order = [urls[9], urls[7], urls[2]]
    depth = dict.fromkeys(order, 0)
    for u in order:
        if depth[u] < 3:
            for x in links.get(u, []):
                if x not in depth:
                    depth[x] = depth[u] + 1
                    order.append(x)
    got = [tuple(r) for r in catalog.QUERIES["crawl_breadth_first"](spark, str(tmp_path)).collect()]
    assert len(got) == len(depth) and dict(got) == depth and max(depth.values()) > 1
    edges = spark.createDataFrame([(u, x, i) for u, t in links.items() for i, x in enumerate(t)], "src STRING, dst STRING, pos INT").repartition(5)
    roots = spark.createDataFrame([(u, i) for i, u in enumerate(order[:3])], "node STRING, at INT")
    assert [r["node"] for r in crawl.breadth_first(edges, roots, 3).orderBy("seq").collect()] == order
    assert [r["seq"] for r in crawl.breadth_first(edges, roots, 3, max_pages=8).orderBy("seq").collect()] == list(range(1, 9))


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private\nAllow: /private/ok\nCrawl-delay: 90\nSitemap: https://a.example/s.xml\n"
    assert robots.parse_robots(body) == ([("/private", False), ("/private/ok", True)], 60.0, ["https://a.example/s.xml"])
    table = spark.createDataFrame([("https://a.example", 200, body), ("https://b.example", 503, None), ("https://c.example", 404, None)], "origin STRING, status INT, body STRING")
    df = spark.createDataFrame([("https://a.example/private/x",), ("https://a.example/private/ok",), ("https://b.example/",), ("https://c.example/",)], "url STRING")
    got = {r["url"][8:]: r["allowed"] for r in robots.allowed(df, robots.rules(table)).collect()}
    assert got == {"a.example/private/x": False, "a.example/private/ok": True, "b.example/": False, "c.example/": True}
    assert robots.sitemap_urls(b"<urlset><url><loc>https://a.example/?a=1&amp;b=2</loc></url></urlset>") == (["https://a.example/?a=1&b=2"], [])


@pytest.mark.parametrize(("address", "want"), [("8.8.8.8", True), ("10.0.0.1", False), ("::ffff:127.0.0.1", False), ("169.254.1.1", False), ("2606:4700::1111", True), ("x", None), (None, None)])
def test_addresses(address, want):
    assert netpolicy.address_allowed(address) is want
    assert netpolicy.address_allowed("10.1.2.3", ("10.0.0.0/8",)) is True


PAGE = """<html lang=en><head><title>T - Site</title><base href="/b/"></head><body><nav><a href=x>menu</a></nav><main><h1>Title</h1><p>One <b>bold</b> <a href="y?z#f">link</a>
<ol start=3><li>three<ul><li>sub</ul><li>four</ol><pre><code class="language-py">a = 1
</code></pre><table><tr><th colspan=2>h|1<tr><td>1<td>2</table><blockquote>q</blockquote><div>loose <del>old</del></div></main><footer>f</footer></body></html>"""


def test_page_blocks():
    out = pages.extract(PAGE, "https://a.example/p")
    assert [b["type"] for b in out["blocks"]] == ["heading", "paragraph", "list", "code", "table", "quote", "paragraph"]
    md = [b["markdown"] for b in out["blocks"]]
    assert md[1] == "One **bold** [link](https://a.example/b/y?z#f)"
    assert md[2] == "3. three\n   - sub\n4. four"
    assert md[3] == "```py\na = 1\n```"
    assert md[4] == "| h\\|1 |  |\n| --- | --- |\n| 1 | 2 |"
    assert md[6] == "loose ~~old~~"
    assert out["outlinks"] == ["https://a.example/b/x", "https://a.example/b/y?z"]
    assert pages.extract("", "")["blocks"] == []


def test_parts_of_pages():
    page = """<html><head><meta name=author content=Ann><meta property="og:site_name" content=S></head><body><div id=__next>x</div><noscript>Please enable JavaScript</noscript>
    <article><h1>Top<a class=headerlink href="#top">¶</a></h1><dl><dt>Term<dd>Meaning <b>here</b></dl><figure><img src=i.png alt=pic><figcaption>Shown</figcaption></figure><address>Street 1</address>
    <menu><li>one<li>two</menu><table><caption>Sizes</caption><tr><td>a*b<td><table><tr><td>in</table></table><p>see <a href="/x">that</a> and <code>a_b*c</code> or a_b*c</p><span>loose<p>inner</p></span></article></body></html>"""
    out = pages.extract(page, "https://a.example/p")
    md = [b["markdown"] for b in out["blocks"]]
    assert md[:3] == ["# Top", "Term\n:   Meaning **here**", "![pic](https://a.example/i.png)Shown"]
    assert md[3] == "Street 1" and md[4] == "- one\n- two" and [b["type"] for b in out["blocks"]][:5] == ["heading", "list", "paragraph", "paragraph", "list"]
    assert "see [that](https://a.example/x) and `a_b*c` or a\\_b\\*c" in md and md[-2:] == ["loose", "inner"]
    assert (out["author"], out["site_name"], out["app_root_empty"], out["noscript_warning"], out["semantic"]) == ("Ann", "S", True, True, True)
    assert out["links"] == [{"href": "https://a.example/x", "text": "that"}]
    caption = pages.extract("<main><table><caption>Sizes</caption><tr><td>a<td>b</table></main>", "")["blocks"][0]
    assert caption["markdown"].startswith("Sizes\n\n| a | b |") and caption["text"] == "a\tb"


def test_density_candidate():
    text = "Quiet frogs and old reeds share one pond, and nobody minds the water there at all. " * 4
    page = f"<body><div class=side><p>Some other short words of a side column here.</p></div><div id=c><div><p>{text}</p><p>{text}</p></div></div></body>"
    out = pages.extract(page, "https://a.example/")
    assert out["strategy"] == "density" and len(out["blocks"]) == 2
    assert pages.extract(f"<body><p>{text}</p><table><tr><td>1</table></body>", "")["strategy"] == "structural"


def test_deep_pages():
    assert pages.extract("<body>" + "<div>" * 10_000 + "deep text", "")["blocks"][0]["markdown"] == "deep text"
    assert pages.extract("<body>" + "<b>" * 5_000 + "x", "")["blocks"][0]["text"] == "x"
    assert len(pages.extract("<body>" + "<ul><li>a" * 3_000, "")["blocks"][0]["markdown"].split("\n")) == 3_000


def test_pdf_lines(spark):
    rows = [("d", 1, i, y, s, t) for i, (y, s, t) in enumerate([(700.0, 20.0, "Head"), (660.0, 10.0, "a long exam-"), (648.0, 10.0, "ple line"), (600.0, 10.0, "next")])]
    got = [(r["level"], r["text"]) for r in pages.pdf_paragraphs(spark.createDataFrame(rows, "doc STRING, page INT, seq INT, y DOUBLE, size DOUBLE, text STRING")).orderBy("paragraph").collect()]
    assert got == [(1, "Head"), (None, "a long example line"), (None, "next")]


def test_streaming_numbers_like_batch(spark, tmp_path):
    from weftline.streaming.ingest import ingest

    schema = "final_url STRING, raw_hash STRING, arrival BIGINT"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([("u", "A", 1), ("u", "A", 2)], [("u", "A", 3), ("u", "B", 4), ("v", "A", 5)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        ingest(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "state")).awaitTermination()
    got = sorted((r["final_url"], r["version"], r["raw_hash"]) for r in spark.read.parquet(out).collect())
    assert got == [("u", 1, "A"), ("u", 2, "B"), ("v", 1, "A")]


def test_stems_match_sqlite(spark, data):
    from weftline.functions.stem import stem, stems

    words = set()
    for r in spark.read.parquet(f"{data}/documents.parquet").where("lang = 'en' AND text IS NOT NULL").select("text").collect():
        words |= {w for w in __import__("re").findall(r"[a-z]+", r["text"].lower()) if len(w) < 60}
    words |= {"relational", "conditional", "hopping", "falling", "happy", "sky", "agreed", "controlling", "generalizations", "oscillators"}
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(w, tokenize = 'porter unicode61 remove_diacritics 2')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    ordered = sorted(words)
    db.executemany("INSERT INTO t(rowid, w) VALUES (?, ?)", list(enumerate(ordered, 1)))
    want = {ordered[doc - 1]: term for term, doc in db.execute("SELECT term, doc FROM v")}
    wrong = {w: (stem(w), want[w]) for w in ordered if w in want and stem(w) != want[w]}
    assert not wrong
    assert stems("Café CRÈMES") == [stem("cafe"), stem("cremes")] and stems(None) == []


def test_quotes_and_evidence(spark):
    from weftline.operators import evidence as V

    assert V.quote_span("A  Big\nDog ran", "big dog") == (3, 10)
    assert V.quote_span("x", " ") is V.quote_span(None, "a") is None
    blocks = spark.createDataFrame([("d", 1, 0, "b1", "The  pond is deep"), ("d", 1, 1, "b2", "the pond is deep, too")], "doc_id STRING, version INT, idx INT, block_id STRING, text STRING")
    claims = spark.createDataFrame([("d", 1, "depth", "deep", "POND is deep"), ("d", 1, "width", "wide", "is wide"), ("d", 1, "age", None, "x"), ("e", 1, "age", "1", "x")], "doc_id STRING, version INT, field STRING, value STRING, quote STRING")
    got = {(r["doc_id"], r["field"]): (r["status"], r["block_id"]) for r in V.evidence(claims, blocks).collect()}
    assert got == {("d", "depth"): ("supported", "b1"), ("d", "width"): ("unsupported", None), ("d", "age"): ("missing", None), ("e", "age"): ("unsupported", None)}
    titles = spark.createDataFrame([("Ponds and frogs | Site",), ("A - much longer tail than its head",), ("Plain",), ("One \u2013 Two \u2013 Three",)], "t STRING")
    assert [r[0] for r in titles.select(V.short_title(F.col("t"))).collect()] == ["Ponds and frogs", "A - much longer tail than its head", "Plain", "One \u2013 Two"]
    assert V.table_row_kept("| a | b | c |", ["a", "c"]) and not V.table_row_kept("| a | b |", ["b", "a"])
    assert V.code_kept("```\n  x = 1\n  y\n```", "x = 1\ny") and not V.code_kept("x = 1\ny", "x = 1\ny")


def test_records(spark, tmp_path):
    import gzip

    from weftline.sources import records

    r = spark.createDataFrame([("q", '{"results": [{"url": "ftp://x"}, {"url": "https://a", "title": "A", "content": "c"}]}')], "query STRING, body STRING")
    assert [tuple(x) for x in records.search_results(r).collect()] == [("q", 1, "https://a", "A", "c")]
    assert records.decode_content(gzip.compress(b"abc"), "gzip") == (b"abc", None)
    assert records.decode_content(b"abc", "br") == (None, "unsupported_encoding")
    assert records.decode_content(b"abc", None, 2) == (b"ab", "decompressed_limit")
    path = str(tmp_path / "out")
    records.write_export(spark.createDataFrame([(1, None), (2, "x")], "id INT, t STRING"), path)
    assert records.json_lines(spark, path, "id INT, t STRING").count() == 2


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql_agrees(spark, data, name):
    import glob
    import os

    db = duckdb.connect()
    db.sql("SET TimeZone='UTC'")
    for f in glob.glob(data + "/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    value = lambda x: round(x, 5) if isinstance(x, float) else x
    df = catalog.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = db.sql(catalog.SQL[name])
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(value(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted(rel.columns) == columns
    assert got == want
