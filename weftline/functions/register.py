"""Functions for SQL: registered with a session, so that queries can call them by name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from weftline.functions.stem import stems_udf as tokenize_porter
from weftline.operators.evidence import quote_span_udf as find_quote
from weftline.operators.search import marked_snippet
from weftline.session import ship
from weftline.sources.dispatch import text_document
from weftline.sources.pages import decode_body, extract


_TEXTS = [StructField(c, StringType()) for c in ("type", "lang", "text", "markdown")]
_BLOCK = StructType([_TEXTS[0], StructField("level", IntegerType()), *_TEXTS[1:]])


@F.pandas_udf(StringType())
def snippet(texts: pd.Series, queries: pd.Series) -> pd.Series:
    return pd.Series([marked_snippet(t, q or "") for t, q in zip(texts, queries)])


@F.pandas_udf(StructType([StructField("title", StringType()), StructField("lang", StringType()), StructField("blocks", ArrayType(_BLOCK))]))
def extract_html(bodies: pd.Series, headers: pd.Series, urls: pd.Series) -> pd.DataFrame:
    rows = [extract(decode_body(bytes(b), h), u or "") if b is not None else {} for b, h, u in zip(bodies, headers, urls)]
    return pd.DataFrame([{c: r.get(c) for c in ("title", "lang", "blocks")} for r in rows], columns=["title", "lang", "blocks"])


class SplitBlocks:
    """One row for each block of a text: its place, type, level, code language, text and Markdown."""

    def eval(self, text: str, content_type: str) -> Iterator[tuple]:
        if text is not None:
            for i, b in enumerate(text_document(text, content_type or "text/markdown")[1]):
                yield i, b["type"], b["level"], b["lang"], b["text"], b["markdown"]


def register(spark: SparkSession) -> list[str]:
    """Registers tokenize_porter, find_quote, snippet and extract_html, and the table function split_blocks; returns their names."""
    ship(spark)
    scalar = {"tokenize_porter": tokenize_porter, "find_quote": find_quote, "snippet": snippet, "extract_html": extract_html}
    for name, f in scalar.items():
        spark.udf.register(name, f)
    spark.udtf.register("split_blocks", F.udtf(SplitBlocks, returnType="idx INT, type STRING, level INT, lang STRING, text STRING, markdown STRING"))
    return [*scalar, "split_blocks"]
