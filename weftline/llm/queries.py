"""The named queries of the training-text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import boilerplate, langid, leakage, mixing, mojibake, residue, sitelines, splitter, subjects
from weftline.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": lambda spark, d: boilerplate.found(table(spark, d, "versions"), table(spark, d, "fetch_log"), table(spark, d, "blocks")),
    "p2_main_bodies": lambda spark, d: boilerplate.main_bodies(table(spark, d, "fetch_log")),
    "p3_found": lambda spark, d: residue.found(table(spark, d, "versions")),
    "p3_labels": lambda spark, d: residue.labelled(table(spark, d, "versions")),
    "p4_found": lambda spark, d: langid.found(*(table(spark, d, x) for x in ("versions", "documents", "fetch_log", "blocks"))),
    "p4_segments": lambda spark, d: langid.identified(*(table(spark, d, x) for x in ("versions", "documents", "fetch_log", "blocks")), each=True),
    "p5_found": lambda spark, d: splitter.found(table(spark, d, "slices"), table(spark, d, "versions")),
    "p5_pieces": lambda spark, d: splitter.pieces(table(spark, d, "slices"), table(spark, d, "versions")),
    "p6_found": lambda spark, d: sitelines.found(table(spark, d, "versions")),
    "p6_cleaned": lambda spark, d: sitelines.cleaned(table(spark, d, "versions")),
    "p7_found": lambda spark, d: mojibake.found(table(spark, d, "versions")),
    "p8_found": lambda spark, d: leakage.found(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "p8_report": lambda spark, d: leakage.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "p7_restored": lambda spark, d: mojibake.restored(table(spark, d, "versions")),
    "p9_plan": lambda spark, d: mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets")),
    "p9_shares": lambda spark, d: mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets")),
    "p10_found": lambda spark, d: subjects.found(*(table(spark, d, x) for x in ("documents", "subjects", "subject_labels"))),
    "p10_shares": lambda spark, d: subjects.assigned(*(table(spark, d, x) for x in ("documents", "subjects", "subject_labels"))),
}

SQL: dict[str, str] = {
    "p5_found": """
        WITH latest AS (SELECT doc_id, max(version) AS version FROM versions GROUP BY doc_id)
        SELECT DISTINCT s.request_id
        FROM slices s JOIN latest l ON l.doc_id = s.doc_id
        JOIN versions v ON v.doc_id = s.doc_id AND v.version = coalesce(s.version, l.version)
        WHERE length(v.markdown) > greatest(1, coalesce(s.max_chars, 24000))
    """,
}
