"""robots.txt and sitemaps as tables."""

from __future__ import annotations

import gzip
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.urls import origin_of, path_of

MAX_ROBOTS, MAX_DELAY = 512 * 1024, 60.0


def parse_robots(body: str, agent: str = "weftline") -> tuple[list[tuple[str, bool]], float | None, list[str]]:
    """(rules as (path pattern, allowed), crawl delay in seconds, sitemaps) for an agent: its own group, else that of ``*``."""
    groups: dict[str, tuple[list, list]] = {}
    current: list[str] = []
    sitemaps, in_rules = [], False
    for line in body[:MAX_ROBOTS].splitlines():
        field, _, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            current = ([] if in_rules else current) + [value.lower()]
            in_rules = False
            groups.setdefault(value.lower(), ([], []))
        elif field == "sitemap" and value:
            sitemaps.append(value)
        elif field in ("allow", "disallow", "crawl-delay"):
            in_rules = True
            for a in current:
                if field == "crawl-delay":
                    groups[a][1].append(value)
                elif value:
                    groups[a][0].append((value, field == "allow"))
    own = next((groups[a] for a in groups if a != "*" and a in agent.lower()), groups.get("*", ([], [])))
    try:
        delay = min(MAX_DELAY, float(own[1][0])) if own[1] else None
    except ValueError:
        delay = None
    return own[0], delay, sitemaps


def rules(robots: DataFrame, agent: str = "weftline") -> DataFrame:
    """(origin, pattern, allowed) from robots(origin, status, body): 2xx parsed, 4xx allows all (no rule), anything else disallows all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for origin, status, body in batch[["origin", "status", "body"]].itertuples(index=False):
                if pd.notna(status) and 200 <= status < 300:
                    out += [(origin, p, ok) for p, ok in parse_robots(body or "", agent)[0]]
                elif not (pd.notna(status) and 400 <= status < 500):
                    out.append((origin, "/", False))
            yield pd.DataFrame(out, columns=["origin", "pattern", "allowed"])

    return robots.mapInPandas(run, "origin STRING, pattern STRING, allowed BOOLEAN")


def allowed(urls: DataFrame, table: DataFrame) -> DataFrame:
    """``urls`` with ``allowed``: the longest matching rule of its origin decides, allow on a tie, true without a rule."""
    star = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("pattern", r"([.+?^{}()|\[\]\\])", r"\\$1"), r"\*", ".*"))
    t = table.select(F.col("origin").alias("r_origin"), F.length("pattern").alias("r_len"), star.alias("r_regex"), F.col("allowed").alias("r_ok"))
    j = urls.select("url").distinct().withColumn("r_path", F.concat(path_of(F.col("url")), F.regexp_extract("url", r"(\?[^#]*)", 1))).join(t, origin_of(F.col("url")) == F.col("r_origin"), "left")
    hit = F.expr("r_path RLIKE r_regex")
    best = j.groupBy("url").agg(F.max(F.when(hit, F.struct("r_len", "r_ok"))).alias("best"))
    return urls.join(best.select("url", F.coalesce("best.r_ok", F.lit(True)).alias("allowed")), "url", "left")


def sitemap_urls(body: bytes) -> tuple[list[str], list[str]]:
    """(page URLs, sitemap URLs) of a sitemap, sitemap index or plain list, gzipped or not."""
    if body[:2] == b"\x1f\x8b":
        body = gzip.decompress(body)
    text = body.decode("utf-8", "replace")
    locs = [html.unescape(re.sub(r"^<!\[CDATA\[(.*)\]\]>$", r"\1", x.strip(), flags=re.S)).strip() for x in re.findall(r"<loc>(.*?)</loc>", text, re.S)]
    if "<sitemapindex" in text:
        return [], locs
    if "<" in text:
        return locs, []
    return [x.strip() for x in text.splitlines() if re.match(r"https?://", x.strip())], []
