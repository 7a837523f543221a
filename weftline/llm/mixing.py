"""Mix sources to target token shares along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]: points (t, weight) with straight lines between, an input; a source without one has
its share times 1 + a (2t - 1), the slopes ``a`` chosen so that the weights of a mix sum to the same at every t. Integrated, the schedule is the
source's cumulative token demand; the text copy at cumulative token c of a source gets the position t at which that demand is c, and the mix is
range-sorted by position. Schedules say when tokens come, shares how many.

A source's tokens are those of its different texts (a text that several sources hold counts for the source of its lowest doc_id in the mix). Its
demand is share times size, its supply its tokens times its cap; the smaller one is used, whole epochs first and the rest in hash order, and the
shares reached are reported. Demand that a capped or empty source leaves open is not given to others: their ratios stay as wanted.

Cumulative tokens are prefix sums in two steps, over hash buckets and within them, so that a source with a third of all rows is spread over tasks;
copies are made in runs of ``RUN``, so that no task makes all copies of a text that is used very often.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the split pattern that belongs to that vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKET_ROWS, RAMP, RUN = 50_000, 0.5, 1_000


@cache
def encoding(path: str):
    """The public byte-pair vocabulary at ``path``; loaded once a worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("weftline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counted(name: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            batch["tokens"] = [len(encode(t)) for t in batch["text"]]
            yield batch[["doc_id", "source", "text_key", "tokens"]]

    return run


def tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, text_key, tokens) of each document with a text; repeated rows count once.

    The vocabulary at ``tokenizer`` is read by the driver and sent to the workers; they need not have it.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)
    rows = documents.where("text IS NOT NULL AND text <> ''").select("doc_id", "source", "text", F.sha2("text", 256).alias("text_key"))
    return rows.mapInPandas(_counted(os.path.basename(tokenizer)), "doc_id BIGINT, source STRING, text_key STRING, tokens BIGINT").dropDuplicates(["doc_id"])


def demands(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each source of each mix: what it has, should and can give, and the slope of its schedule. Small: as many rows as targets."""
    t = targets.where("source IS NOT NULL").select("mix_id", "source", "target_share", "max_repeats", "size_ratio").distinct()
    total = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    has = owned(counted, t).groupBy("mix_id", "source").agg(F.sum("tokens").alias("available"), F.count("*").alias("texts"))
    rows = t.join(has, ["mix_id", "source"], "left").fillna({"available": 0, "texts": 0})
    rows = rows.withColumn("demand", F.col("target_share") * F.col("size_ratio") * F.lit(total))
    rows = rows.withColumn("budget", F.when(F.col("max_repeats").isNull(), F.when(F.col("available") > 0, F.col("demand")).otherwise(0.0)).otherwise(F.least("demand", F.col("available") * F.col("max_repeats").cast("double"))))
    mix = Window.partitionBy("mix_id")
    z = 1 - 2 * F.col("target_share") / F.greatest(F.max("target_share").over(mix), F.lit(1e-9))
    rows = rows.withColumn("z", z)
    return rows.withColumn("slope", RAMP * (F.col("z") - F.sum(F.col("z") * F.col("target_share")).over(mix) / F.greatest(F.sum("target_share").over(mix), F.lit(1e-9)))).drop("z")


def owned(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, doc_id, text_key, tokens): each different text of a mix once, at its lowest doc_id."""
    rows = counted.join(targets.select("mix_id", "source").distinct(), "source")
    return rows.groupBy("mix_id", "text_key").agg(F.min_by(F.struct("source", "doc_id", "tokens"), "doc_id").alias("x")).select("mix_id", "x.source", "x.doc_id", "text_key", "x.tokens")


def segments(plan: DataFrame, schedules: DataFrame | None) -> DataFrame:
    """``plan`` with the integrated schedule of each source: straight pieces of its weight with the share of its demand before each.

    ``schedules`` has mix_id, source, t in [0, 1] and weight, 0 or more; before its first and after its last point a weight stays the same. Without
    points, or with weights of 0 alone, the schedule is the default one.
    """
    slope = F.array(F.struct(F.lit(0.0).alias("t"), (1 - F.col("slope")).alias("w")), F.struct(F.lit(1.0).alias("t"), (1 + F.col("slope")).alias("w")))
    if schedules is not None:
        clean = schedules.select("mix_id", "source", F.col("t").cast("double").alias("t"), F.col("weight").cast("double").alias("w")).where("t BETWEEN 0 AND 1 AND w >= 0")
        own = clean.groupBy("mix_id", "source", "t").agg(F.max("w").alias("w")).groupBy("mix_id", "source").agg(F.sort_array(F.collect_list(F.struct("t", "w"))).alias("p"))
        plan = plan.join(own.where(F.exists("p", lambda x: x["w"] > 0)), ["mix_id", "source"], "left")
        ends = F.concat(F.array(F.struct(F.lit(0.0).alias("t"), F.col("p")[0]["w"].alias("w"))), F.col("p"), F.array(F.struct(F.lit(1.0).alias("t"), F.element_at("p", -1)["w"].alias("w"))))
        points = F.coalesce(F.when(F.col("p").isNotNull(), ends), slope)
    else:
        points = slope
    plan = plan.withColumn("__p", points)
    pieces = F.filter(F.zip_with(F.slice("__p", 1, F.size("__p") - 1), F.slice("__p", 2, F.size("__p")), lambda a, b: F.struct(a["t"].alias("t"), a["w"].alias("w"), (b["t"] - a["t"]).alias("dt"), (b["w"] - a["w"]).alias("dw"))), lambda x: x["dt"] > 0)
    area = lambda x: (x["w"] + x["dw"] / 2) * x["dt"]
    plan = plan.withColumn("__s", pieces).withColumn("weight_total", F.aggregate("__s", F.lit(0.0), lambda a, x: a + area(x)))
    run = F.transform("__s", lambda x, i: F.struct(x["t"].alias("t"), x["w"].alias("w"), x["dt"].alias("dt"), x["dw"].alias("dw"), (F.aggregate(F.slice("__s", 1, i), F.lit(0.0), lambda a, y: a + area(y)) / F.col("weight_total")).alias("before")))
    return plan.withColumn("segments", run).drop("__p", "__s", *(["p"] if schedules is not None else []))


def position(u: Column) -> Column:
    """The time at which a source has had the share ``u`` of its demand, by the columns ``segments`` and ``weight_total``."""
    # the last piece that begins at u or before and has any weight, or where u is 0 the first that has
    some = F.filter("segments", lambda x: (x["w"] + x["dw"] / 2) > 0)
    s = F.coalesce(F.element_at(F.filter(some, lambda x: x["before"] <= u), -1), some[0])
    area = F.greatest(F.lit(0.0), (u - s["before"]) * F.col("weight_total"))
    # w x + g x^2 / 2 = area with g the slope of the weight
    g = s["dw"] / s["dt"]
    root = F.sqrt(F.greatest(F.lit(0.0), s["w"] * s["w"] + 2 * g * area))
    x = F.when(s["w"] + root > 0, 2 * area / (s["w"] + root)).otherwise(0.0)
    return s["t"] + F.least(x, s["dt"])


def _placed(documents: DataFrame, targets: DataFrame, tokenizer: str, schedules: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    counted = cut(tokens(documents, tokenizer))
    plan = cut(segments(demands(counted, targets), schedules))
    texts = owned(counted, targets).join(plan.select("mix_id", "source", "available", "budget", "demand", "segments", "weight_total"), ["mix_id", "source"])
    # every text in whole epochs, and once more for those below the rest
    buckets = max(16, -(-counted.count() // BUCKET_ROWS))
    texts = texts.withColumn("order", F.xxhash64("mix_id", "text_key")).withColumn("bucket", F.pmod(F.col("order"), F.lit(buckets)).cast("int"))
    sums = texts.groupBy("mix_id", "source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = Window.partitionBy("mix_id", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).drop("in_bucket")
    inside = Window.partitionBy("mix_id", "source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    texts = texts.join(sums, ["mix_id", "source", "bucket"]).withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    epochs = F.floor(F.col("budget") / F.greatest("available", F.lit(1)))
    rest = F.col("budget") - epochs * F.col("available")
    texts = texts.withColumn("uses", (epochs + F.when(F.col("at") + F.col("tokens") / 2 <= rest, 1).otherwise(0)).cast("int"))
    runs = texts.where("uses > 0").select("mix_id", "source", "doc_id", "tokens", "at", "uses", "available", "budget", "segments", "weight_total", F.explode(F.sequence(F.lit(0), F.floor((F.col("uses") - 1) / RUN).cast("int"))).alias("run"))
    runs = runs.repartition("mix_id", "doc_id", "run")
    copies = runs.select("*", F.explode(F.sequence(F.col("run") * RUN + 1, F.least("uses", (F.col("run") + 1) * RUN))).alias("copy"))
    u = F.least((F.col("copy") - 1) * F.col("available") + F.col("at") + F.col("tokens") / 2, F.col("budget")) / F.col("budget")
    return copies.select("mix_id", position(u).alias("position"), "source", "doc_id", "copy", "tokens"), plan


def mixed(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, schedules: DataFrame | None = None) -> DataFrame:
    """The plan: (mix_id, position, source, doc_id, copy, tokens), range-sorted by mix and position.

    Null or empty texts and sources that no mix names are not drawn; sources without documents give no row.
    """
    return _placed(documents, targets, tokenizer, schedules)[0].orderBy("mix_id", "position", "doc_id", "copy")


def shares(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, schedules: DataFrame | None = None) -> DataFrame:
    """One row for each source of each mix: target share, tokens it has, should give and gives, share reached and highest number of uses."""
    placed, plan = _placed(documents, targets, tokenizer, schedules)
    got = placed.groupBy("mix_id", "source").agg(F.sum("tokens").alias("used_tokens"), F.max("copy").alias("most_uses"))
    rows = plan.join(got, ["mix_id", "source"], "left").fillna({"used_tokens": 0, "most_uses": 0})
    share = F.col("used_tokens") / F.sum("used_tokens").over(Window.partitionBy("mix_id"))
    return rows.select("mix_id", "source", "target_share", "max_repeats", "texts", "available", F.round("demand", 3).alias("demand"), "used_tokens", "most_uses", F.round(share, 6).alias("reached_share"))
