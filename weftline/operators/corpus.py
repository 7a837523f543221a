"""Versions, blocks, aliases, snapshots and retention as functions from tables to tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import short_hash


def version_islands(fetches: DataFrame, key: str, content: str, order: str) -> DataFrame:
    """Numbers versions per document: a new one whenever the content differs from the fetch before, so A, B, A gives three.

    Fetches without content are left out. One row for each version: first and last arrival and number of fetches.
    """
    by = Window.partitionBy(key).orderBy(order)
    marked = fetches.where(F.col(content).isNotNull() & F.col(key).isNotNull()).select(key, content, order).dropDuplicates([order])
    changed = F.coalesce((F.col(content) != F.lag(content).over(by)).cast("int"), F.lit(1))
    numbered = marked.withColumn("changed", changed).withColumn("version", F.sum("changed").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return numbered.groupBy(key, "version").agg(F.first(content).alias(content), F.min(order).alias("first_seen"), F.max(order).alias("last_seen"), F.count("*").alias("fetches"))


def latest(versions: DataFrame) -> DataFrame:
    """(doc_id, latest_version, versions): distinct version numbers of each document."""
    return versions.groupBy("doc_id").agg(F.max("version").alias("latest_version"), F.count_distinct("version").alias("versions"))


def block_offsets(blocks: DataFrame) -> DataFrame:
    """Offset of each block in its version's markdown: blocks before it and the blank lines between."""
    by = Window.partitionBy("doc_id", "version").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    one = blocks.select("doc_id", "version", "idx", "markdown", "char_offset").dropDuplicates(["doc_id", "version", "idx"])
    return one.select("doc_id", "version", "idx", F.coalesce(F.sum(F.length("markdown") + 2).over(by), F.lit(0)).cast("bigint").alias("computed_offset"), "char_offset")


def block_hash(block_type: Column, markdown: Column) -> Column:
    return short_hash(F.concat(block_type, F.lit("\n"), markdown))


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Insert-if-absent: of each key the row of the lowest order."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("r")).select(*key, "r.*")


def resolve(urls: DataFrame, versions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(url, doc_id, how): a document by its own URL, else by an alias; null when neither knows it."""
    own = versions.groupBy(F.col("final_url").alias("url")).agg(F.min("doc_id").alias("direct"))
    other = aliases.groupBy("url").agg(F.min("doc_id").alias("alias"))
    joined = urls.select("url").distinct().join(own, "url", "left").join(other, "url", "left")
    how = F.when(F.col("direct").isNotNull(), "url").when(F.col("alias").isNotNull(), "alias").otherwise("none")
    return joined.select("url", F.coalesce("direct", "alias").alias("doc_id"), how.alias("how"))


def retained(versions: DataFrame, keep: int | None = None, older_than: str | None = None) -> DataFrame:
    """Versions that stay: the newest ``keep`` version numbers of each document (one at least), and of the others none fetched before
    ``older_than``; both texts are compared as they are. The latest version stays whatever its age."""
    j = versions.join(latest(versions), "doc_id")
    if keep is not None:
        j = j.where(F.col("version") > F.col("latest_version") - max(1, keep))
    if older_than is not None:
        j = j.where((F.col("version") == F.col("latest_version")) | F.coalesce(F.col("fetched_at") >= older_than, F.lit(True)))
    return j


def dropped_snapshots(versions: DataFrame, mode: str) -> DataFrame:
    """Versions with ``snapshot_hash`` nulled: of ``all`` versions or of the ``old`` ones, which are not the latest."""
    if mode not in ("all", "old"):
        raise ValueError("invalid_argument: mode must be all or old")
    j = versions.join(latest(versions), "doc_id")
    gone = F.lit(True) if mode == "all" else F.col("version") < F.col("latest_version")
    return j.withColumn("snapshot_hash", F.when(~gone, F.col("snapshot_hash"))).drop("latest_version", "versions")


def deleted(tables: dict[str, DataFrame], targets: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the target documents (doc_id), and snapshots (``raw_hash``) without those that no version is left of."""
    gone = targets.select("doc_id").where("doc_id IS NOT NULL").distinct()
    out = {name: t.join(gone, "doc_id", "left_anti") for name, t in tables.items() if name != "snapshots"}
    if "snapshots" in tables:
        out["snapshots"] = tables["snapshots"].join(out["versions"].where("raw_hash IS NOT NULL").select("raw_hash").distinct(), "raw_hash", "left_semi")
    return out


def upserted(fetches: DataFrame, keep_snapshots: str = "all") -> dict[str, DataFrame]:
    """The stored tables after all fetches in order of arrival: versions (numbered by change), aliases (requested addresses that led elsewhere, first
    wins) and snapshots (one body a hash, first wins; ``latest`` keeps those of each document's last version only, ``none`` none)."""
    own = fetches.dropDuplicates(["arrival"])
    versions = version_islands(own.select("final_url", "raw_hash", "arrival"), "final_url", "raw_hash", "arrival")
    aliases = first_wins(own.where("requested_url <> final_url").select(F.col("requested_url").alias("url"), F.col("final_url").alias("target"), "arrival"), ["url"], "arrival").select("url", "target")
    bodies = own.where("raw_hash IS NOT NULL AND body IS NOT NULL").select("raw_hash", "content_type", "body", "arrival")
    snapshots = first_wins(bodies, ["raw_hash"], "arrival").drop("arrival")
    if keep_snapshots == "latest":
        last = versions.groupBy("final_url").agg(F.max_by("raw_hash", "version").alias("raw_hash")).select("raw_hash").distinct()
        snapshots = snapshots.join(last, "raw_hash", "left_semi")
    elif keep_snapshots == "none":
        snapshots = snapshots.limit(0)
    return {"versions": versions, "aliases": aliases, "snapshots": snapshots}


def selection(text: str) -> list[tuple[int, int]]:
    """Ranges of block numbers of a selection such as ``b3``, ``b3-b7`` or ``b2,b5,b10-b9``; anything else is an error."""
    out = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*b?(\d+)\s*(?:-\s*b?(\d+))?\s*", part)
        if not m:
            raise ValueError(f"invalid_argument: no block selection: {part!r}")
        a = int(m.group(1))
        b = int(m.group(2) or a)
        out.append((min(a, b), max(a, b)))
    return out


def selected_blocks(blocks: DataFrame, text: str) -> DataFrame:
    """Blocks whose number is in a selection, by range tests."""
    number = F.regexp_extract("block_id", r"^b(\d+)$", 1).try_cast("bigint")
    inside = F.lit(False)
    for a, b in selection(text):
        inside = inside | number.between(a, b)
    return blocks.where(inside)


def orphans(snapshots: DataFrame, versions: DataFrame, key: str = "raw_hash") -> DataFrame:
    """Snapshots that no version points to."""
    held = versions.where(F.col(key).isNotNull()).select(key).distinct()
    return snapshots.where(F.col(key).isNotNull()).select(key).distinct().join(held, key, "left_anti")


def export_nested(versions: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row for each version with its blocks nested in order."""
    own = blocks.select("doc_id", "version", F.struct("idx", "block_id", "block_type", "markdown").alias("b")).distinct()
    nested = own.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list("b")).alias("blocks"))
    return versions.join(nested, ["doc_id", "version"], "left")


def raw_text(body: Column) -> Column:
    """A body in base64, on one line."""
    return F.translate(F.base64(body), "\r\n", "")


def slice_bounds(requests: DataFrame, texts: DataFrame, blocks: DataFrame) -> DataFrame:
    """The slice of each request from its ``offset`` on (0 where there is no such column or it is null): its end snaps back to the last block boundary
    inside the window, where there is one. Offsets are kept within the text; a slice is truncated when anything stands before or after it."""
    offset = F.coalesce(F.col("offset"), F.lit(0)) if "offset" in requests.columns else F.lit(0)
    r = requests.join(texts, ["doc_id", "version"]).withColumn("total_chars", F.length("markdown").cast("bigint"))
    r = r.withColumn("start", F.greatest(F.lit(0), F.least(offset, F.col("total_chars"))).cast("bigint")).withColumn("hard_end", F.least(F.col("total_chars"), F.col("start") + F.greatest(F.lit(1), F.col("max_chars"))))
    starts = blocks.groupBy("doc_id", "version").agg(F.collect_set("char_offset").alias("offsets"))
    r = r.join(starts, ["doc_id", "version"], "left")
    inside = F.array_max(F.filter("offsets", lambda o: (o > F.col("start")) & (o <= F.col("hard_end"))))
    r = r.withColumn("end", F.when(F.col("hard_end") < F.col("total_chars"), F.coalesce(inside, F.col("hard_end"))).otherwise(F.col("hard_end")))
    text = F.regexp_replace(F.expr("substring(markdown, cast(start + 1 AS int), cast(end - start AS int))"), r"\n+$", "")
    return r.select("request_id", text.alias("slice"), F.when(F.col("end") < F.col("total_chars"), F.col("end")).alias("next_offset"), "total_chars", ((F.col("start") > 0) | (F.col("end") < F.col("total_chars"))).alias("truncated"))
