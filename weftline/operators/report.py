"""The report battery over run records: one group for each profile, all measures in one aggregation.

A record has profile, case, repetition, outcome (``ok``, ``error``, ``na``, ``unavailable``), latency, score and optional extras.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.outcome import usable_value
from weftline.operators.stats import cluster_bootstrap, nearest_ranks, paired


def computed(records: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by outcome, rates, means and percentiles of each group; means of nothing are null.

    Records without one of the optional columns (kind, recall, escalated, attempts, chars, tokens, expected_error, cost) count as if it were null.
    """
    optional = {"kind": "string", "recall": "double", "escalated": "boolean", "attempts": "double", "chars": "double", "tokens": "double", "expected_error": "boolean", "cost": "double"}
    r = records.select("*", *[F.lit(None).cast(t).alias(c) for c, t in optional.items() if c not in records.columns])
    ok, error, tried = F.col("outcome") == "ok", F.col("outcome") == "error", F.col("outcome").isin("ok", "error")
    r = r.withColumn("usable", usable_value(F.col("outcome"), F.col("expected_error"), F.col("score").cast("double")))
    rate = lambda hit, of: F.avg(F.when(of, hit.cast("double")))
    out = r.groupBy(*keys).agg(
        F.count("*").alias("records"),
        F.count_distinct("case").alias("cases"),
        F.count_if(tried).alias("attempted"),
        F.count_if(ok).alias("ok"),
        F.count_if(error).alias("errors"),
        F.count_if(F.col("outcome") == "na").alias("not_applicable"),
        F.count_if(F.col("outcome") == "unavailable").alias("unavailable"),
        F.count_if(error & (F.col("kind") == "timeout")).alias("timeouts"),
        F.count_if(error & (F.col("kind") == "blocked")).alias("blocked"),
        F.count_if(ok & (F.col("recall") < 0.5)).alias("extraction_failures"),
        rate(ok, tried).alias("success_rate"),
        rate(F.col("kind") == "timeout", tried).alias("timeout_rate"),
        rate(F.col("kind") == "blocked", tried).alias("blocked_rate"),
        rate(F.col("escalated"), ok).alias("escalation_rate"),
        F.avg("usable").alias("mean_usable"),
        F.count("usable").alias("usable_n"),
        F.avg(F.when(ok, F.col("score"))).alias("mean_score"),
        F.avg(F.when(ok, F.col("recall"))).alias("mean_recall"),
        F.avg(F.when(ok, F.col("attempts"))).alias("mean_attempts"),
        F.avg(F.when(ok, F.col("chars"))).alias("mean_chars"),
        F.avg(F.when(ok, F.col("tokens"))).alias("mean_tokens"),
        F.sum("cost").alias("cost"),
        F.max(F.when(ok, F.col("latency"))).alias("slowest"),
    )
    timed = r.where(ok & F.col("latency").isNotNull()).withColumn("pass", F.explode(F.array(F.lit("all"), F.when(F.col("repetition") == 1, "first").otherwise("warm"))))
    ranks = nearest_ranks(timed, [*keys, "pass"], "latency", {"p50": 0.5, "p95": 0.95})
    wide = ranks.groupBy(*keys).agg(*[F.max(F.when(F.col("pass") == p, F.col(q))).alias(f"{p}_{q}") for p in ("all", "first", "warm") for q in ("p50", "p95")])
    return out.join(wide, keys, "left")


def case_lists(records: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """(keys, cases, shown): how many distinct cases a group has and the first ``most`` by name, which is the report's own limit.

    Cases are ranked after a distinct count, so no group is collected whole.
    """
    one = records.select(*keys, "case").distinct()
    first = one.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("case"))).where(F.col("n") <= most)
    return one.groupBy(*keys).agg(F.count("*").alias("cases")).join(first.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.col("case").cast("string"))), ", ").alias("shown")), keys)


def leaders(values: DataFrame, keys: list[str], name: str, value: str, n: str, higher: bool = True) -> DataFrame:
    """(keys, leaders, best, margin, qualifier, small_sample): the best of each group with ties, the lead over the next value, and what to say of it.

    ``close`` is a margin under 0.05 or of a tenth of the best or less; a sample of fewer than ten is small.
    """
    sign = 1 if higher else -1
    by = Window.partitionBy(*keys)
    v = values.where(F.col(value).isNotNull()).withColumn("__best", F.max(F.col(value) * sign).over(by))
    other = v.groupBy(*keys).agg(F.max(F.when(F.col(value) * sign < F.col("__best"), F.col(value) * sign)).alias("__next"))
    top = v.where(F.col(value) * sign == F.col("__best")).groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(name)), ",").alias("leaders"), F.max("__best").alias("__best"), F.min(n).alias("__n"))
    j = top.join(other, keys)
    margin = F.col("__best") - F.col("__next")
    qualifier = F.when(F.col("leaders").contains(","), "tie").when(margin.isNull(), "only").when((margin < 0.05) | (margin <= 0.1 * F.abs(F.col("__best"))), "close").otherwise("clear")
    return j.select(*keys, "leaders", (F.col("__best") * sign).alias("best"), margin.alias("margin"), qualifier.alias("qualifier"), (F.col("__n") < 10).alias("small_sample"))


def phase_medians(records: DataFrame, keys: list[str], timings: str = "timings") -> DataFrame:
    """(keys, phase, median, n) of the phases that engines report, over warm successes."""
    warm = records.where("outcome = 'ok' AND repetition > 1").select(*keys, F.explode(timings).alias("phase", "ms")).where("ms >= 0")
    return nearest_ranks(warm, [*keys, "phase"], "ms", {"median": 0.5}).join(warm.groupBy(*keys, "phase").agg(F.count("*").alias("n")), [*keys, "phase"])


def uncertainty(records: DataFrame, profile: str, metrics: dict[str, Column]) -> DataFrame:
    """(metric, value, low, high, cases, attempts): the case bootstrap of each metric of one profile; a metric is a column expression over records."""
    rows = records.where(F.col("profile") == profile)
    out = None
    for name, column in metrics.items():
        part = cluster_bootstrap(rows.select("case", column.cast("double").alias("value")), "case", "value").select(F.lit(name).alias("metric"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def paired_intervals(records: DataFrame, left: str, right: str) -> DataFrame:
    """The case bootstrap of differences and ratios of warm successes that both profiles have; a repeated (case, repetition) is an error."""
    warm = records.where("outcome = 'ok' AND repetition > 1")
    both = paired(warm, "profile", left, right, ["case", "repetition"], "latency", repeated="error").where("a IS NOT NULL AND b IS NOT NULL")
    out = None
    for name in ("delta", "ratio"):
        part = cluster_bootstrap(both, "case", name).select(F.lit(name).alias("measure"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def with_cases(records: DataFrame, cases: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """Records with the columns of their case, and of its gold text where there is one; records of unknown cases stay."""
    out = records.join(cases, "case", "left")
    return out if gold is None else out.join(gold, "case", "left")


def in_suite(case: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns (``*`` for any text) names a case. A few patterns are one expression, so cases are not multiplied by them."""
    return case.rlike("^(?:" + "|".join(".*".join(re.escape(x) for x in p.split("*")) for p in patterns) + ")$") if patterns else F.lit(False)


def workload_summary(records: DataFrame) -> DataFrame:
    """(scenario, profile, ok, attempted, not_applicable, unavailable, p50): the median is over successes."""
    keys = ["scenario", "profile"]
    counts = records.groupBy(*keys).agg(*[F.count_if(F.col("outcome") == x).alias(n) for x, n in (("ok", "ok"), ("na", "not_applicable"), ("unavailable", "unavailable"))], F.count_if(F.col("outcome").isin("ok", "error")).alias("attempted"))
    return counts.join(nearest_ranks(records.where("outcome = 'ok'"), keys, "latency", {"p50": 0.5}), keys, "left")


def sessions_held(checks: DataFrame) -> DataFrame:
    """(session, held): whether every check of a session holds; a null check does not."""
    return checks.groupBy("session").agg(F.bool_and(F.coalesce("held", F.lit(False))).alias("held"))


def startup_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p50, p95, most_rss) of runs, the first pass left out."""
    later = runs.where("pass > 1")
    return nearest_ranks(later, keys, "ms", {"p50": 0.5, "p95": 0.95}).join(later.groupBy(*keys).agg(F.max("rss").alias("most_rss")), keys)


def union_of(*families: DataFrame) -> DataFrame:
    """All rows of record families; columns that one lacks are null there."""
    out = families[0]
    for f in families[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def shuffled(names: list[str], seed: int) -> list[str]:
    """The order of a repetition's tasks: the Fisher-Yates shuffle driven by the 32-bit counter generator. For task lists, which the driver makes."""
    out, state = list(names), seed & 0xFFFFFFFF
    for i in range(len(out) - 1, 0, -1):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ (t >> 7)) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        j = int(((t ^ (t >> 14)) & 0xFFFFFFFF) / 2**32 * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out
