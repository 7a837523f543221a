from datetime import datetime

import pytest

META = "STRUCT<lang: STRING, siteName: STRING, byline: STRING, description: STRING, publishedAt: STRING, canonicalUrl: STRING>"
VERSIONS = f"doc_id STRING, version INT, fetched_at STRING, final_url STRING, raw_hash STRING, markdown STRING, meta {META}, site STRING, form STRING, node INT, label STRING, text STRING"
BLOCKS = "doc_id STRING, version INT, idx INT, block_id STRING, block_type STRING, level INT, markdown STRING, wording STRING, furniture STRING"
FETCHES = "arrival BIGINT, final_url STRING, content_type_header STRING, body BINARY, raw_hash STRING, main STRING, fetched_at TIMESTAMP"
DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, tokens STRING, labels STRING, bucket STRING, item_id STRING"


@pytest.fixture(scope="session")
def tables(spark):
    """Small tables with nulls in every column, empty and very long texts, repeated rows and columns of clashing names."""
    meta = ("en", "Alpha", None, None, "2024-01-01", None)
    none = (None,) * 6
    extra = ("x", "x", 1, "x", "x")
    long = "Every word counts here. " * 20_000
    versions = [
        ("d1", 1, None, "https://www.alpha.example/a", "h1", "# Title\n\nThe quick brown fox jumps over the lazy dog and runs away.", meta, *extra),
        ("d1", 1, None, "https://www.alpha.example/a", "h1", "# Title\n\nThe quick brown fox jumps over the lazy dog and runs away.", meta, *extra),
        ("d2", 1, "x", "https://alpha.example/b", None, "", none, *extra),
        ("d3", 1, "x", None, None, None, none, *extra),
        ("d4", 2, "x", "https://alpha.example/c", "h4", long, None, *extra),
        (None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    blocks = [
        ("d1", 1, 0, "b1", "heading", 1, "# Title", "x", "x"),
        ("d1", 1, 1, "b2", "paragraph", None, "The quick brown fox jumps over the lazy dog and runs away.", "x", "x"),
        ("d1", 1, 1, "b2", "paragraph", None, "The quick brown fox jumps over the lazy dog and runs away.", "x", "x"),
        ("d2", 1, 0, "b1", None, None, "", "x", "x"),
        ("d4", 2, 0, "b1", "paragraph", None, long, "x", "x"),
        (None, None, None, None, None, None, None, None, None),
    ]
    fetches = [
        (1, "https://alpha.example/a", "text/html", b"<body><h1>Title</h1><p>The quick brown fox jumps over the lazy dog and runs away.</p></body>", "h1", "x", datetime(2024, 1, 1)),
        (1, "https://alpha.example/a", "text/html", b"<body><h1>Title</h1><p>The quick brown fox jumps over the lazy dog and runs away.</p></body>", "h1", "x", datetime(2024, 1, 1)),
        (2, None, None, b"", "h4", "x", None),
        (3, None, None, None, None, None, None),
    ]
    documents = [
        (1, "The quick brown fox jumps over the lazy dog. It runs far away from here.", "en", "a", "x", "x", "x", "x"),
        (1, "The quick brown fox jumps over the lazy dog. It runs far away from here.", "en", "a", "x", "x", "x", "x"),
        (2, "", None, None, "x", "x", "x", "x"),
        (3, None, None, None, "x", "x", "x", "x"),
        (4, long, "en", "b", "x", "x", "x", "x"),
        (None, None, None, None, None, None, None, None),
    ]
    out = {name: spark.createDataFrame(rows, schema).repartition(3).cache() for name, rows, schema in (("versions", versions, VERSIONS), ("blocks", blocks, BLOCKS), ("fetch_log", fetches, FETCHES), ("documents", documents, DOCUMENTS))}
    out["slices"] = spark.createDataFrame([(1, "d1", None, 20, None, "x"), (1, "d1", None, 20, None, "x"), (2, "d4", 2, None, 100, "x"), (3, "d9", 1, 5, 5, "x"), (4, "d2", 1, 1, 9, "x"), (5, None, None, None, None, None)], "request_id BIGINT, doc_id STRING, version INT, max_chars INT, overlap_chars INT, text STRING")
    out["benchmark"] = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog", None), (1, "quick brown fox jumps over the lazy dog", None), (2, None, "t"), (3, "", "t")], "item_id BIGINT, text STRING, task STRING")
    out["targets"] = spark.createDataFrame([(1, "a", 0.5, 2, 1.0), (1, "b", 0.5, None, 1.0), (1, "c", 0.0, 1, 1.0), (2, None, None, None, None)], "mix_id INT, source STRING, target_share DOUBLE, max_repeats INT, size_ratio DOUBLE")
    out["subjects"] = spark.createDataFrame([("animals", "a"), ("law", "b"), (None, None)], "subject STRING, description STRING")
    out["subject_labels"] = spark.createDataFrame([(1, " Animals "), (1, " Animals "), (4, "law"), (4, None), (9, "law"), (None, None)], "doc_id BIGINT, subject STRING")
    return out
