"""Incremental versioning of a stream of fetches (an extension: batch is the reference behaviour)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_versions(batch: DataFrame, path: str, batch_id: int = 0) -> None:
    """Writes the batch's new versions below ``path``, numbered after the stored ones; unchanged content adds nothing.

    Each batch has a folder of its own, which a second delivery of the same batch writes again, so nothing is counted twice. Of the stored table
    only the rows of the batch's documents are reduced to their latest version.
    """
    spark = batch.sparkSession
    rows = batch.where("final_url IS NOT NULL AND raw_hash IS NOT NULL").select("final_url", "raw_hash", "arrival").dropDuplicates(["arrival"])
    try:
        stored = spark.read.parquet(path).where(F.col("batch") < batch_id).join(rows.select("final_url").distinct(), "final_url", "left_semi")
        last = stored.groupBy("final_url").agg(F.max_by("raw_hash", "version").alias("last_hash"), F.max("version").alias("last_version"))
        rows = rows.join(last, "final_url", "left")
    except Exception as error:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
            raise
        rows = rows.withColumns({"last_hash": F.lit(None).cast("string"), "last_version": F.lit(None).cast("int")})
    by = Window.partitionBy("final_url").orderBy("arrival")
    before = F.coalesce(F.lag("raw_hash").over(by), F.col("last_hash"))
    rows = rows.withColumn("new", F.coalesce((F.col("raw_hash") != before).cast("int"), F.lit(1)))
    number = F.coalesce(F.col("last_version"), F.lit(0)) + F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows.withColumn("version", number.cast("int")).where("new = 1").select("final_url", "version", "raw_hash", "arrival").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def ingest(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Versions of all that is there, and an end; or with ``every`` (such as ``10 seconds``) a batch each time, without end.

    A stopped query goes on where its checkpoint says. How much a batch takes is the stream's own option (``maxFilesPerTrigger``).
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(lambda batch, number: append_versions(batch, path, number)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def ended(query: StreamingQuery, seconds: float) -> str:
    """Waits for a query: ``exhausted`` when it came to its end, ``deadline`` when time was up and it was stopped."""
    if query.awaitTermination(seconds):
        return "exhausted"
    query.stop()
    return "deadline"


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by key in tumbling event-time windows; rows later than ``late`` behind the watermark are dropped by design."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).count().select(F.col("window.start").alias("window_start"), key, "count")
