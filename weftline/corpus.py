"""The corpus as one object: ingest, read, search, crawl, list, export, delete, prune over its tables.

Tables are DataFrames, or a folder of Parquet tables; every method gives DataFrames and changes nothing stored. A changed corpus is a new object.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import parse_ref, version_ref
from weftline.functions.urls import normalize_url
from weftline.operators import corpus as C
from weftline.operators import crawl as W
from weftline.operators import search as Q
from weftline.operators.evidence import quote_span_udf
from weftline.sources import dispatch
from weftline.sources.tables import table

KEY = ["doc_id", "version", "block_id"]


@dataclass(frozen=True)
class Corpus:
    versions: DataFrame
    blocks: DataFrame
    aliases: DataFrame
    snapshots: DataFrame | None = None
    postings: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Corpus:
        f = table(spark, folder, "fetch_log")
        snapshots = C.first_wins(f.where("raw_hash IS NOT NULL AND body IS NOT NULL").select("raw_hash", "content_type", "body", "arrival"), ["raw_hash"], "arrival").drop("arrival")
        versions = table(spark, folder, "versions").dropDuplicates(["doc_id", "version"])
        return cls(versions, table(spark, folder, "blocks").dropDuplicates(["doc_id", "version", "idx"]), table(spark, folder, "aliases").distinct(), snapshots)

    @staticmethod
    def ingest(fetch_log: DataFrame) -> dict[str, DataFrame]:
        """Versions, aliases and snapshots of all fetches, and the blocks of each fetched body."""
        return {**C.upserted(fetch_log), "documents": dispatch.documents(fetch_log)}

    def _wanted(self, targets: DataFrame, version: int | None = None) -> DataFrame:
        """(target, doc_id, version) of targets, each a reference, document id, URL or alias; the latest version where none is named."""
        t = targets.select("target").distinct().withColumn("ref", parse_ref(F.col("target"))).withColumn("url", normalize_url(F.col("target")))
        found = C.resolve(t.select("url").where("url IS NOT NULL"), self.versions, self.aliases).select(F.col("url").alias("r_url"), F.col("doc_id").alias("by_url"))
        t = t.join(found, F.col("url") == F.col("r_url"), "left").select("target", F.coalesce("ref.doc_id", "by_url").alias("doc_id"), F.coalesce(F.lit(version).cast("int"), "ref.version").alias("asked"))
        return t.join(C.latest(self.versions), "doc_id").select("target", "doc_id", F.coalesce("asked", "latest_version").alias("version"))

    def read(self, targets: DataFrame, version: int | None = None, blocks: str | None = None, find: str | None = None, offset: int = 0, max_chars: int = 24_000) -> DataFrame:
        """The asked text of each target: its selected blocks, the blocks that hold a quote (with the span), or the slice from an offset on."""
        w = self._wanted(targets, version)
        if blocks is not None or find is not None:
            b = self.blocks.join(w, ["doc_id", "version"])
            b = b if blocks is None else C.selected_blocks(b, blocks)
            b = b.select("target", *KEY, "idx", version_ref(F.col("doc_id"), F.col("version"), F.col("block_id")).alias("ref"), "block_type", "text", "markdown")
            return b if find is None else b.withColumn("span", quote_span_udf(F.col("text"), F.lit(find))).where("span.start IS NOT NULL")
        requests = w.select(F.col("target").alias("request_id"), "doc_id", "version", F.lit(max(1, max_chars)).alias("max_chars"), F.lit(max(0, offset)).alias("offset"))
        return C.slice_bounds(requests, self.versions.where("markdown IS NOT NULL").select("doc_id", "version", "markdown"), self.blocks).withColumnRenamed("request_id", "target")

    def indexed(self, path: str | None = None) -> Corpus:
        """This corpus with the postings of its blocks, written to ``path`` where one is given."""
        postings = Q.inverted(self.blocks, KEY, "text", "title")
        if path is not None:
            Q.write_index(postings, path)
            postings = Q.read_index(self.blocks.sparkSession, path)
        return replace(self, postings=postings)

    def search(self, query: str, limit: int = 10, all_versions: bool = False, doc_id: str | None = None) -> DataFrame:
        """Best blocks of the latest versions (or all): ref, title, url, score and snippet, best first, ties by key. Statistics are over all blocks."""
        postings = self.postings if self.postings is not None else Q.inverted(self.blocks, KEY, "text", "title")
        hits = Q.search(postings, KEY, query)
        if not all_versions:
            hits = hits.join(C.latest(self.versions).select("doc_id", F.col("latest_version").alias("version")), ["doc_id", "version"])
        if doc_id is not None:
            hits = hits.where(F.col("doc_id") == doc_id)
        best = Q.top(hits, KEY, limit)
        rows = best.join(self.blocks.select(*KEY, "block_type", "text"), KEY).join(self.versions.select("doc_id", "version", "final_url", "title", "fetched_at"), ["doc_id", "version"])
        out = rows.select(version_ref(F.col("doc_id"), F.col("version"), F.col("block_id")).alias("ref"), *KEY, "block_type", F.col("final_url").alias("url"), "title", "fetched_at", Q.snippets(query)(F.coalesce("text", F.lit(""))).alias("snippet"), "text", "score")
        return out.orderBy(F.desc("score"), *KEY)

    def crawl(self, pages: DataFrame, links: DataFrame, root: str, **options: object) -> tuple[DataFrame, dict[str, int | str]]:
        return W.crawled(pages, links, root, **options)

    def documents(self, limit: int = 50, offset: int = 0) -> DataFrame:
        """Documents by the last time they were seen, newest first, then by id."""
        v = self.versions.select("doc_id", "version", "final_url", "title", "last_seen_at")
        d = v.groupBy("doc_id").agg(F.max_by(F.struct("final_url", "title", "version"), "version").alias("l"), F.max("last_seen_at").alias("updated_at"), F.count_distinct("version").alias("versions"))
        return d.select("doc_id", F.col("l.final_url").alias("url"), F.col("l.title").alias("title"), F.col("l.version").alias("latest_version"), "versions", "updated_at").orderBy(F.desc("updated_at"), "doc_id").offset(max(0, offset)).limit(max(0, limit))

    def versions_of(self, targets: DataFrame) -> DataFrame:
        return self.versions.join(self._wanted(targets).select("doc_id"), "doc_id", "left_semi").orderBy("doc_id", "version")

    def export(self, path: str, raw: bool = False) -> None:
        """Every version with its blocks nested, as JSON Lines; with ``raw`` the snapshot in base64."""
        from weftline.sources.records import write_export

        out = C.export_nested(self.versions, self.blocks)
        if raw and self.snapshots is not None:
            out = out.join(self.snapshots.select("raw_hash", C.raw_text(F.col("body")).alias("raw")), "raw_hash", "left")
        write_export(out, path)

    def delete(self, targets: DataFrame) -> Corpus:
        tables = {"versions": self.versions, "blocks": self.blocks, "aliases": self.aliases} | ({"snapshots": self.snapshots} if self.snapshots is not None else {})
        left = C.deleted(tables, self._wanted(targets).select("doc_id"))
        return Corpus(left["versions"], left["blocks"], left["aliases"], left.get("snapshots"))

    def prune(self, keep: int | None = None, older_than: str | None = None, raw: str | None = None) -> Corpus:
        kept = C.retained(self.versions, keep, older_than).drop("latest_version", "versions")
        if raw is not None:
            kept = C.dropped_snapshots(kept, raw)
        held = kept.where("snapshot_hash IS NOT NULL").select(F.col("snapshot_hash").alias("raw_hash")).distinct() if raw is not None else kept.where("raw_hash IS NOT NULL").select("raw_hash").distinct()
        keys = kept.select("doc_id", "version")
        return Corpus(kept, self.blocks.join(keys, ["doc_id", "version"], "left_semi"), self.aliases, None if self.snapshots is None else self.snapshots.join(held, "raw_hash", "left_semi"))
