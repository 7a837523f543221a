"""Quotes, evidence and prompts over the blocks of a version."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from weftline.functions.text import normalize_text


def quote_span(text: str | None, quote: str | None) -> tuple[int, int] | None:
    """(start, end) of the first place of a quote, letter case and white space apart, in the text's own characters; null when there is none."""
    if not text or not quote or not quote.strip():
        return None
    pattern = r"\s+".join(re.escape(w) for w in quote.split())
    m = re.search(pattern, text, re.I)
    return (m.start(), m.end()) if m else None


@F.pandas_udf(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))
def quote_span_udf(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    spans = [quote_span(t, q) or (None, None) for t, q in zip(text, quote)]
    return pd.DataFrame({"start": pd.array([s[0] for s in spans], "Int32"), "stop": pd.array([s[1] for s in spans], "Int32")})


def holds(text: Column, quote: Column) -> Column:
    """Whether a text holds a quote, letter case and white space apart."""
    return F.contains(F.lower(normalize_text(text)), F.lower(normalize_text(quote)))


def evidence(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """Status of each field of each claim set: ``supported`` when a block of its version holds its quote, ``unsupported`` when none does or there is
    no quote, ``missing`` when it has no value. (doc_id, version, field, status, block_id); the first block in order is cited."""
    b = blocks.select("doc_id", "version", "block_id", "idx", "text").dropDuplicates(["doc_id", "version", "idx"])
    j = claims.select("doc_id", "version", "field", "value", "quote").join(b, ["doc_id", "version"], "left")
    hit = F.col("value").isNotNull() & F.col("quote").isNotNull() & (F.col("quote") != "") & holds(F.col("text"), F.col("quote"))
    g = j.groupBy("doc_id", "version", "field").agg(F.max(F.col("value").isNotNull()).alias("given"), F.min(F.when(hit, F.struct("idx", "block_id"))).alias("at"))
    status = F.when(~F.col("given"), "missing").when(F.col("at").isNotNull(), "supported").otherwise("unsupported")
    return g.select("doc_id", "version", "field", status.alias("status"), F.col("at.block_id").alias("block_id"))


def prompt_lines(blocks: DataFrame, budget: int) -> DataFrame:
    """Lines ``[bN] text`` of each version that fit a budget: whole ones while they do, then the first that does not, cut if there is room."""
    by = Window.partitionBy("doc_id", "version").orderBy("idx")
    line = F.concat(F.lit("["), F.col("block_id"), F.lit("] "), F.col("text"))
    rows = blocks.select("doc_id", "version", "idx", "block_id", line.alias("line")).withColumn("until", F.sum(F.length("line") + 1).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("until") - F.length("line") - 1)
    room = F.lit(budget) - F.col("before")
    keep = (F.col("until") <= budget + 1) | ((room > F.length("block_id") + 3) & (F.col("before") <= budget))
    return rows.where(keep).select("doc_id", "version", "idx", F.expr(f"substring(line, 1, cast(least(length(line), {budget} - before) AS int))").alias("line"))


def short_title(title: Column, site: Column | None = None) -> Column:
    """A title without a trailing site name: cut at the last spaced separator when what follows is the site's name or at most four words and no
    longer than what stands before."""
    out = title
    for mark in ("|", "-", "—", "–", "·", "::"):
        esc = re.escape(mark)
        head, tail = F.regexp_extract(title, rf"^(.*) {esc} (.*)$", 1), F.regexp_extract(title, rf"^(.*) {esc} (.*)$", 2)
        words = lambda c: F.size(F.split(F.trim(c), r"\s+"))
        is_site = (F.lower(tail) == F.lower(site)) if site is not None else F.lit(False)
        cut = (head != "") & (F.coalesce(is_site, F.lit(False)) | ((words(tail) <= 4) & (words(head) >= words(tail))))
        out = F.when(out == title, F.when(cut, F.trim(head)).otherwise(title)).otherwise(out)
    return out


def table_row_kept(line: str, cells: list[str]) -> bool:
    """Whether the cells stand in order on one line."""
    at = 0
    for cell in cells:
        at = line.lower().find(cell.lower(), at)
        if at < 0:
            return False
        at += len(cell)
    return True


def code_kept(text: str, code: str) -> bool:
    """Whether the lines of a code stand in a row inside a fence or an indented block, each after the same indent."""
    wanted = code.strip("\n").split("\n")
    lines, fenced, inside = text.split("\n"), False, []
    for line in lines:
        mark = re.match(r"\s*(```|~~~)", line) is not None
        inside.append(not mark and (fenced or line.startswith(("    ", "\t"))))
        fenced = fenced != mark
    for i in range(len(lines) - len(wanted) + 1):
        if all(inside[i : i + len(wanted)]):
            pads = {x[: len(x) - len(w)] for x, w in zip(lines[i:], wanted) if x.endswith(w) and w}
            if len(pads) <= 1 and all(x.endswith(w) for x, w in zip(lines[i:], wanted)) and all(not p.strip() for p in pads):
                return True
    return False
