"""Extraction quality: token overlap, passage and heading recall, citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import plain


def token_overlap(pairs: DataFrame, key: str, output: Column, gold: Column) -> DataFrame:
    """Precision, recall and F1 of multiset token overlap of two token arrays; all zero if either side is empty."""
    def counted(side: Column, name: str) -> DataFrame:
        return pairs.select(key, F.explode(side).alias("w")).groupBy(key, "w").agg(F.count("*").alias(name))

    both = counted(output, "o").join(counted(gold, "g"), [key, "w"], "full").fillna({"o": 0, "g": 0})
    s = both.groupBy(key).agg(F.sum(F.least("o", "g")).alias("both"), F.sum("o").alias("o"), F.sum("g").alias("g"))
    p = F.when((F.col("o") > 0) & (F.col("g") > 0), F.col("both") / F.col("o")).otherwise(0.0)
    r = F.when((F.col("o") > 0) & (F.col("g") > 0), F.col("both") / F.col("g")).otherwise(0.0)
    s = s.select(key, p.alias("precision"), r.alias("recall"))
    return s.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def contains_passage(output: Column, passage: Column) -> Column:
    return F.contains(plain(output), plain(passage))


def headings(markdown: Column) -> Column:
    """Texts of ATX headings."""
    lines = F.filter(F.split(markdown, "\n"), lambda x: x.rlike(r"^#{1,6} "))
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^#{1,6} +| +#+ *$", "")))


def heading_texts(markdown: Column) -> Column:
    """Texts of headings of both kinds: marked lines, and lines that are underlined. List items and blank lines are none."""
    lines = F.split(markdown, "\n")
    marked = lambda x: x.rlike(r"^#{1,6} ")
    after = lambda i: F.coalesce(F.try_element_at(lines, i + 2), F.lit(""))
    under = lambda x, i: after(i).rlike(r"^(?:=+|-+) *$") & (F.trim(x) != "") & ~x.rlike(r"^\s*(?:[-*+]|\d+[.)]) |^(?:=+|-+) *$")
    found = F.filter(F.transform(lines, lambda x, i: F.when(marked(x), F.regexp_replace(x, r"^#{1,6} +| +#+ *$", "")).when(under(x, i), x)), lambda x: x.isNotNull())
    return F.transform(found, lambda x: F.trim(x))


def recall_fractions(cases: DataFrame, key: str, output: str, expected: dict[str, str]) -> DataFrame:
    """For each kind (name to an array column: passages or headings) the share of what is expected that a case's output holds; null for nothing expected.

    ``headings`` are looked for among the output's headings, everything else in its plain text.
    """
    out = cases.select(key)
    text = plain(F.col(output))
    heads = F.transform(heading_texts(F.col(output)), lambda h: plain(h))
    columns = {}
    for name, column in expected.items():
        hit = (lambda x: F.array_contains(heads, plain(x))) if name == "headings" else (lambda x: F.contains(text, plain(x)))
        n = F.size(F.coalesce(F.col(column), F.array().cast("array<string>")))
        columns[name] = F.when(n > 0, F.size(F.filter(column, hit)) / n)
    return cases.select(key, *[c.alias(n) for n, c in columns.items()]) if columns else out


def citation_verified(claim: dict[str, Column], stored: dict[str, Column]) -> Column:
    """Whether a citation still holds: same reference, version, content hash and block hash, and its quote, white space levelled, at its offset."""
    same = F.lit(True)
    for name in ("ref", "version", "content_hash", "block_hash"):
        same = same & claim[name].eqNullSafe(stored[name])
    level = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return same & (level(F.substring(stored["text"], claim["offset"] + 1, F.length(claim["quote"]))) == level(claim["quote"]))


def citation_holds(text: Column, offset: Column, quote: Column) -> Column:
    """Whether the quote stands at its offset (from 0)."""
    return F.substring(text, offset + 1, F.length(quote)) == quote


def escalation(status: Column, extracted: Column, app_root_empty: Column, noscript: Column, inline_script: Column, external: Column, scripts: Column, body_text: Column) -> Column:
    """Reason to render a page with a browser, null for none."""
    return (
        F.when(status.isin(403, 429, 503), "challenge")
        .when(app_root_empty & (extracted < 1000), "empty root")
        .when(noscript & (extracted < 1500), "script notice")
        .when((extracted < 200) & ((inline_script >= 1000) | (external >= 2) | ((scripts > 0) & (body_text < 50))), "script page")
    )
