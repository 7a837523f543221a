"""Record files and service responses as tables, and content encodings."""

from __future__ import annotations

import io
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

#: explicit schemas: nothing is inferred
RUN_RECORDS = "runId STRING, suite STRING, profile STRING, engine STRING, caseId STRING, dataset STRING, category STRING, heldOut BOOLEAN, repetition INT, outcome STRING, startedAt STRING, latencyMs DOUBLE, timings MAP<STRING, DOUBLE>, error STRUCT<kind: STRING, message: STRING, code: STRING>, scores MAP<STRING, DOUBLE>, cost STRUCT<unit: STRING, amount: DOUBLE, estimated: BOOLEAN>"
SEARCH_RESPONSE = "results ARRAY<STRUCT<url: STRING, title: STRING, content: STRING>>"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON Lines file; a broken line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def search_results(responses: DataFrame, limit: int = 10) -> DataFrame:
    """(query, rank, url, title, snippet) of the first ``limit`` web results of each response(query, body)."""
    r = responses.select("query", F.from_json("body", SEARCH_RESPONSE)["results"].alias("r"))
    web = F.filter("r", lambda x: x["url"].rlike(r"(?i)^https?://"))
    return r.select("query", F.posexplode(F.slice(web, 1, limit)).alias("rank", "x")).select("query", (F.col("rank") + 1).alias("rank"), "x.url", "x.title", F.col("x.content").alias("snippet"))


ENCODED_LIMIT, DECODED_LIMIT = 10 * 1024 * 1024, 25 * 1024 * 1024


def _inflated(body: bytes, name: str, most: int) -> bytes:
    """At most ``most`` + 1 bytes of a decoded body, without ever holding more: a small body may stand for a very large one."""
    if name in ("gzip", "x-gzip"):
        return zlib.decompressobj(31).decompress(body, most + 1)
    if name == "deflate":
        try:
            return zlib.decompressobj().decompress(body, most + 1)
        except zlib.error:
            return zlib.decompressobj(-15).decompress(body, most + 1)
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(body)) as reader:
        return reader.read(most + 1)


def decode_content(body: bytes, encoding: str | None, most: int = DECODED_LIMIT) -> tuple[bytes | None, str | None]:
    """(decoded body, error): gzip, deflate, zstd and identity, cut at ``most`` bytes. Brotli is not available and counts as unsupported."""
    for name in reversed([x.strip().lower() for x in (encoding or "").split(",") if x.strip()]):
        if name == "identity":
            continue
        if name not in ("gzip", "x-gzip", "deflate", "zstd"):
            return None, "unsupported_encoding"
        try:
            body = _inflated(body, name, most)
        except (OSError, EOFError, zlib.error, ValueError, RuntimeError) as error:
            return None, f"decode_failed: {type(error).__name__}"
        except Exception as error:  # zstandard has an error class of its own
            if type(error).__name__ != "ZstdError":
                raise
            return None, "decode_failed: ZstdError"
    return body[:most], "decompressed_limit" if len(body) > most else None


@F.pandas_udf(StructType([StructField("body", BinaryType()), StructField("error", StringType())]))
def decoded(bodies: pd.Series, encodings: pd.Series) -> pd.DataFrame:
    """``decode_content`` as a column function; null bodies stay null."""
    rows = [decode_content(bytes(b), e) if b is not None else (None, None) for b, e in zip(bodies, encodings)]
    return pd.DataFrame(rows, columns=["body", "error"])


def limited(body: Column, most: int = ENCODED_LIMIT) -> tuple[Column, Column]:
    """(the first ``most`` bytes of a body as it came, ``compressed_limit`` where that cut it)."""
    return F.substring(body, 1, most), F.when(F.octet_length(body) > most, "compressed_limit")


def write_export(nested: DataFrame, path: str) -> None:
    """The export as JSON Lines, spread over tasks; null fields are left out."""
    nested.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def append_records(records: DataFrame, path: str) -> None:
    """Run records added to those at ``path``, as JSON Lines."""
    records.write.mode("append").option("ignoreNullFields", "true").json(path)


def write_report(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def write_reports(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a report as CSV in a folder of its name."""
    for name, t in tables.items():
        write_report(t, f"{path}/{name}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of all files below a folder: what a published run is compared by."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_replace("path", "^.*/(?=[^/]+/[^/]+$)", "").alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def envelope(status: Column, tool: str, data: Column, warnings: Column, timings: Column) -> Column:
    """One JSON line of a result: null parts are left out."""
    return F.to_json(F.struct(status.alias("status"), F.lit(tool).alias("tool"), data.alias("data"), warnings.alias("warnings"), timings.alias("timings")))


# Exit codes by status.
_EXIT = {"ok": 0, "error": 1, "usage": 2, "partial": 3}


def exit_code(status: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, code in _EXIT.items():
        out = out.when(status == name, code)
    return out.otherwise(1)
