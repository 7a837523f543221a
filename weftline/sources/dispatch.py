"""Fetched bodies of any kind to typed blocks: each kind has its own extraction, and every body has a row, if only with an error."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.pages import decode_body, extract, space

SNIFFED = 512
_BLOCK = "ARRAY<STRUCT<type: STRING, level: INT, lang: STRING, text: STRING, markdown: STRING>>"
SCHEMA = f"arrival BIGINT, kind STRING, title STRING, error STRING, blocks {_BLOCK}"


def content_kind(content_type: Column, body: Column) -> Column:
    """``html``, ``pdf`` or ``text`` by the content type, or by the first ``SNIFFED`` bytes where that is empty or says nothing; else null."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    head = F.ltrim(F.decode(F.substring(body, 1, SNIFFED), "ISO-8859-1"))
    sniffed = F.when(head.startswith("%PDF-"), "pdf").when(head.rlike("(?i)^<(?:!doctype html|html|head|body)"), "html")
    return (
        F.when(kind.isin("text/html", "application/xhtml+xml"), "html")
        .when(kind.isin("application/pdf", "application/x-pdf"), "pdf")
        .when(kind.startswith("text/") | kind.rlike("(?:json|xml)$") | (kind == "application/javascript"), "text")
        .when(kind.isin("", "application/octet-stream", "binary/octet-stream"), sniffed)
    )


def text_document(body: str, content_type: str) -> tuple[str, list[dict]]:
    """(title, blocks) of a text. Data and script types are one code block; others are split at blank lines, headings and fences in Markdown only.

    The title is the first heading, or the first 120 characters of the first block.
    """
    text = re.sub(r"\r\n?", "\n", body)
    blocks: list[dict] = []

    def add(kind: str, plain: str, markdown: str, level: int | None = None, lang: str | None = None) -> None:
        blocks.append({"type": kind, "level": level, "lang": lang, "text": plain, "markdown": markdown})

    lang = next((x for x in ("json", "xml", "csv", "javascript") if x in content_type), None)
    if lang:
        code = text.rstrip()
        add("code", code, f"```{lang}\n{code}\n```", lang=lang)
    elif "markdown" in content_type:
        # a fence up to its own closing mark, or a run of lines that are neither blank nor a fence's first
        for m in re.finditer(r"^[ \t]*(```|~~~)[^\n]*(?:\n(?!\s*\1).*)*(?:\n\s*\1[^\n]*)?|(?:^(?![ \t]*(?:```|~~~)).*\S.*\n?)+", text, re.M):
            chunk = m.group().strip("\n").rstrip()
            heading = re.fullmatch(r"(#{1,6})\s+(.*)", chunk)
            if m.group(1):
                inner = chunk.split("\n")
                add("code", "\n".join(inner[1:-1]), chunk, lang=re.match(r"\s*(?:```|~~~)\s*([\w+#.-]*)", chunk).group(1) or None)
            elif heading:
                add("heading", space(heading.group(2)), chunk, len(heading.group(1)))
            else:
                add("paragraph", space(chunk), chunk)
    else:
        for chunk in re.split(r"\n[^\S\n]*(?:\n[^\S\n]*)+", text):
            if chunk.strip():
                add("paragraph", space(chunk), chunk.strip("\n").rstrip())
    title = next((b["text"] for b in blocks if b["type"] == "heading"), blocks[0]["text"][:120] if blocks else "")
    return title, blocks


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            title, error, blocks = None, None, []
            try:
                if r.kind == "html":
                    page = extract(decode_body(bytes(r.body), r.content_type_header), r.final_url or "")
                    title, blocks = page["title"], page["blocks"]
                elif r.kind == "text":
                    title, blocks = text_document(decode_body(bytes(r.body), r.content_type_header), (r.content_type or "").lower())
                elif r.kind == "pdf":
                    error = "needs_line_table"
                else:
                    error = "unsupported_content_type"
            except Exception as failure:  # a page that cannot be taken apart must not stop the others
                error = f"extraction_failed: {type(failure).__name__}"
            out.append((r.arrival, r.kind, title, error, blocks))
        yield pd.DataFrame(out, columns=["arrival", "kind", "title", "error", "blocks"])


def documents(fetch_log: DataFrame) -> DataFrame:
    """(arrival, kind, title, error, blocks) of every fetch with a body, whatever its type; repeated rows count once.

    Text of PDF files comes as a line table (``pages.pdf_paragraphs``); their rows say so.
    """
    rows = fetch_log.where("body IS NOT NULL").select("arrival", "final_url", "content_type", "content_type_header", "body").dropDuplicates(["arrival"])
    return rows.withColumn("kind", content_kind(F.col("content_type"), F.col("body"))).mapInPandas(_documents, SCHEMA)


def sitemaps_read(files: DataFrame, seeds: list[str], most_files: int = 20, most_urls: int | None = None) -> DataFrame:
    """(url, file, position): pages that sitemaps name, breadth first from the seeds over sitemap indexes in sitemaps(url, body).

    At most ``most_files`` files are read and ``most_urls`` pages returned, which are the crawl's own limits.
    """
    from weftline.sources.robots import sitemap_urls

    spark = files.sparkSession
    seen, queue, found = set(), list(dict.fromkeys(seeds)), []
    while queue and len(seen) < most_files:
        level = queue[: most_files - len(seen)]
        seen |= set(level)
        bodies = {r["url"]: bytes(r["body"]) for r in files.where(F.col("url").isin(level) & F.col("body").isNotNull()).collect()}  # at most most_files rows
        below = []
        for url in level:
            pages, maps = sitemap_urls(bodies[url]) if url in bodies else ([], [])
            found += [(page, url) for page in pages]
            below += maps
        queue = [u for u in dict.fromkeys(queue[len(level) :] + below) if u not in seen]
    first = list({page: (page, url) for page, url in reversed(found)}.values())[::-1][:most_urls]
    return spark.createDataFrame([(page, url, i) for i, (page, url) in enumerate(first)], "url STRING, file STRING, position INT")
