"""Nearest-rank percentiles, case-cluster bootstrap, paired comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.crawl import numbered
from weftline.session import cut

# The generator's increment, the draws and the seed that published intervals use.
INCREMENT, DRAWS, SEED = 0x6D2B79F5, 2000, 424242
_MASK = 4294967295
BROADCAST_CASES = 500_000


def nearest_rank(value: str, p: float) -> Column:
    """The value at rank ceil(p n) of a column, as an aggregate."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """The value at rank ceil(p n) of each group, one column for each point; groups without a value have no row.

    No group goes through one task: equal values are counted together, sorted into ranges over all groups, and the counts of the ranges before say
    in which range a rank lies. Null and NaN values are left out.
    """
    held = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    held = cut(held.repartitionByRange(*keys, "__v").withColumn("__range", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    parts = held.groupBy(*keys, "__range").agg(F.sum("__n").alias("__part"))  # as many rows as groups and ranges
    parts = parts.withColumns({"__all": F.sum("__part").over(group), "__before": F.sum("__part").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__part")}).drop("__part")
    inside = Window.partitionBy(*keys, "__range").orderBy("__v")
    rank = held.join(parts, [*keys, "__range"]).withColumn("__rank", F.col("__before") + F.sum("__n").over(inside))
    return rank.groupBy(*keys).agg(*[F.min(F.when(F.col("__rank") >= F.ceil(F.lit(p) * F.col("__all") - 1e-9), F.col("__v"))).alias(name) for name, p in points.items()])


def _times(a: str, b: str) -> str:
    """The low 32 bits of a product of 32-bit numbers, without leaving 64 bits."""
    return f"((((({a}) & 65535) * ({b})) + ((((({a}) >> 16) * ({b})) & 65535) << 16)) & {_MASK})"


def draws(frame: DataFrame, cases: int, seed: int = SEED, times: int = DRAWS) -> DataFrame:
    """(draw, slot, pick): ``cases`` picks of a case index for each draw, from a counter-based generator."""
    spark = frame.sparkSession
    rows = spark.range(times * cases).selectExpr(f"id DIV {cases} AS draw", f"id % {cases} AS slot", f"(({seed} + (id + 1) * {INCREMENT}) & {_MASK}) AS s")
    # a pick is never null, and says so: else a join's test for null would write all of this out many times over
    a = "(s ^ (s >> 15))"
    rows = rows.selectExpr("draw", "slot", f"{_times(a, '(s | 1)')} AS t")
    rows = rows.selectExpr("draw", "slot", f"(t ^ ((t + {_times('(t ^ (t >> 7))', '(t | 61)')}) & {_MASK})) AS t")
    return rows.selectExpr("draw", "slot", f"COALESCE(CAST(FLOOR((t ^ (t >> 14)) / 4294967296.0D * {cases}) AS BIGINT), 0) AS pick")


def cluster_bootstrap(observations: DataFrame, case: str, value: str, seed: int = SEED, times: int = DRAWS) -> DataFrame:
    """Mean with a 95 % interval that resamples cases, each with all its repetitions. The interval is null for fewer than two cases.

    Only case sums take part in the draws: one row a case, joined to draws x cases picks.
    """
    clean = observations.where(F.col(value).isNotNull() & ~F.isnan(value))
    sums = clean.groupBy(case).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    whole = sums.agg((F.sum("total") / F.sum("n")).alias("value"), F.count("*").alias("cases"), F.sum("n").alias("attempts"))
    cases = whole.first()["cases"]
    if cases < 2:
        return whole.select("value", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "cases", "attempts")
    places, _ = numbered(sums.select(F.col(case).alias("node"), F.col(case).alias("at"), "total", "n"), 0)
    ranked = places.select("total", "n", (F.col("seq") - 1).alias("pick"))
    # one row a case; up to BROADCAST_CASES of them the picks need not be shuffled
    ranked = F.broadcast(ranked) if cases <= BROADCAST_CASES else ranked
    means = draws(observations, cases, seed, times).join(ranked, "pick").groupBy("draw").agg((F.sum("total") / F.sum("n")).alias("mean"))
    ends = means.agg(F.expr("percentile_disc(0.025) WITHIN GROUP (ORDER BY mean)").alias("low"), F.expr("percentile_disc(0.975) WITHIN GROUP (ORDER BY mean)").alias("high"))
    return whole.join(ends).select("value", "low", "high", "cases", "attempts")  # one row each


def paired(rows: DataFrame, side: str, left: str, right: str, keys: list[str], value: str, repeated: str = "mean") -> DataFrame:
    """Full outer pairing of two sides on ``keys``: values of both, which are present, and their difference and ratio.

    ``repeated``: what becomes of several rows of one side and key, their ``mean`` or an ``error``.
    """
    if repeated not in ("mean", "error"):
        raise ValueError("repeated must be mean or error")

    def of(name: str, alias: str) -> DataFrame:
        one = rows.where(F.col(side) == name).groupBy(*keys).agg(F.avg(value).alias(alias), F.count("*").alias("n"))
        fail = F.raise_error(F.concat(F.lit(f"several rows of {name} for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))).cast("double")
        return one.select(*keys, (F.when(F.col("n") > 1, fail).otherwise(F.col(alias)) if repeated == "error" else F.col(alias)).alias(alias))

    j = of(left, "a").join(of(right, "b"), keys, "full")
    return j.select(*keys, "a", "b", (F.col("a") - F.col("b")).alias("delta"), F.when(F.col("b") > 0, F.col("a") / F.col("b")).alias("ratio"))
