"""The named queries of the core and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.operators import timestamps
from weftline.plans import corpus_queries, quality_queries, store_queries
from weftline.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda spark, d: timestamps.found(table(spark, d, "versions"), table(spark, d, "sites")),
    "p1_instants": lambda spark, d: timestamps.publication_and_fetch_instants(table(spark, d, "versions"), table(spark, d, "sites")),
    **corpus_queries.QUERIES,
    **quality_queries.QUERIES,
    **store_queries.QUERIES,
}

SQL: dict[str, str] = {**corpus_queries.SQL, **quality_queries.SQL, **store_queries.SQL}
