"""Success rates, latencies, anomalies, alerts, routing weights, caches and circuit breakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .evaluation import floor_percentile
from .folds import Breaker, TtlCache, fold


def call_stats(calls: DataFrame, by: str, successes_only: bool = False) -> DataFrame:
    """Calls, success rate and mean latency; latency sums over successes only if asked, over all calls always."""
    ok = F.col("ok").cast("int")
    spent = F.sum(F.when(F.col("ok"), F.col("ms")).otherwise(0.0)) if successes_only else F.sum("ms")
    total = F.count("*")
    return calls.groupBy(by).agg(total.alias("total"), F.round(F.coalesce(F.sum(ok) / total, F.lit(1.0)), 3).alias("success_rate"), F.round(F.coalesce(spent / total, F.lit(0.0)), 1).alias("avg_ms"))


def penalty(success_rate: Column, avg_ms: Column) -> Column:
    """How much a poor success rate or latency takes off a routing weight, 0.9 at most."""
    slow = F.when(avg_ms > 3000, F.least(F.lit(0.4), (avg_ms - 3000) / 10000)).otherwise(0.0)
    failing = F.when(success_rate < 0.90, F.least(F.lit(0.5), (0.90 - success_rate) * 2)).otherwise(0.0)
    return F.least(F.lit(0.9), failing + slow)


def routing_score(success_rate: Column, avg_ms: Column, penalty_: Column) -> Column:
    return (0.7 * success_rate + 0.3 / (1 + avg_ms / 1000)) * F.greatest(F.lit(0.0), 1 - penalty_)


def scored(stats: DataFrame) -> DataFrame:
    """Stats with their penalty and routing score."""
    p = penalty(F.col("success_rate"), F.col("avg_ms"))
    return stats.withColumn("penalty", F.round(p, 6)).withColumn("routing_score", F.round(routing_score(F.col("success_rate"), F.col("avg_ms"), p), 6))


# Metric, threshold, severity, and whether lower is worse.
THRESHOLDS = (
    ("agent_success_rate", 0.90, "error", True),
    ("tool_success_rate", 0.95, "warning", True),
    ("agent_avg_ms", 3000.0, "warning", False),
    ("tool_avg_ms", 5000.0, "error", False),
)


def alerts(stats: DataFrame, label: str, kind: str) -> DataFrame:
    """``metric, label, value, threshold, severity`` of each crossed threshold of one kind."""
    limits = stats.sparkSession.createDataFrame([t for t in THRESHOLDS if t[0].startswith(kind)], "metric string, threshold double, severity string, low boolean")
    long = stats.filter("success_rate IS NOT NULL AND avg_ms IS NOT NULL").select(
        F.col(label).cast("string").alias("label"),
        F.explode(F.array(F.struct(F.lit(f"{kind}_success_rate").alias("metric"), F.col("success_rate").alias("value")), F.struct(F.lit(f"{kind}_avg_ms").alias("metric"), F.col("avg_ms").alias("value")))).alias("m"),
    )
    both = long.select("label", "m.*").join(F.broadcast(limits), "metric")
    crossed = F.when(F.col("low"), F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    return both.filter(crossed).select("metric", "label", "value", "threshold", "severity")


def zscores(samples: DataFrame, by: list[str], order: list[str], value: str, window: int = 60, limit: float = 2.5) -> DataFrame:
    """Samples that lie more than ``limit`` deviations from the mean of the last ``window``, themselves included.

    Fewer than half a window, or no deviation, gives none.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - window, 0)
    rows = samples.withColumns({"_n": F.count(value).over(w), "_m": F.avg(value).over(w), "_s": F.stddev_samp(value).over(w)})
    z = F.abs(F.col(value) - F.col("_m")) / F.col("_s")
    found = rows.filter((F.col("_n") >= window // 2) & (F.col("_s") > 1e-12)).withColumn("z", z).filter(F.col("z") > limit)
    return found.select(*by, *order, value, F.round("z", 2).alias("z_score"), F.when(F.col("z") > 1.5 * limit, "high").otherwise("medium").alias("severity"))


def failure_runs(calls: DataFrame, by: str, order: list[str], least: int = 3) -> DataFrame:
    """Runs of ``least`` or more failures in a row: where each starts and how long it is."""
    island = F.sum(F.col("ok").cast("int")).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    runs = calls.withColumn("_g", island).filter(~F.col("ok")).groupBy(by, "_g").agg(F.count("*").alias("length"), F.min(order[-1]).alias("first_id"))
    return runs.filter(F.col("length") >= least).drop("_g")


def best_agent(stats: DataFrame, label: str) -> DataFrame:
    """The one with the highest routing score, the smallest name of equals."""
    return stats.agg(F.min_by(F.struct(label, "routing_score"), F.struct((-F.col("routing_score")).alias("s"), label)).alias("b")).select("b.*")


def suggestions(stats: DataFrame, runs: DataFrame, label: str, most: int = 5) -> DataFrame:
    """Advice: low success over more than ten calls (priority 8), runs of failures (9); the first ``most``."""
    weak = stats.filter("success_rate < 0.85 AND total > 10").select(F.col(label).cast("string").alias("label"), F.lit("low_success").alias("title"), F.lit(8).alias("priority"))
    down = runs.select(F.col(label).cast("string").alias("label"), F.lit("repeated_failure").alias("title"), F.lit(9).alias("priority")).distinct()
    return down.unionByName(weak).orderBy(F.desc("priority"), "title", "label").limit(most)


def breaker(calls: DataFrame, by: str, ts: str, tie: str, failures: int = 5, recovery: float = 60.0) -> DataFrame:
    """Each call with ``allowed`` and the breaker's ``state`` after it; ``ts`` is in seconds.

    Calls that are not allowed change nothing.
    """
    return fold(calls, [by], [ts, tie], [ts, "ok"], lambda: Breaker(failures, recovery))


def ttl_hits(lookups: DataFrame, by: list[str], ts: str, tie: str, ttl: float = 300.0) -> DataFrame:
    """Cache lookups with ``hit``; ``ts`` is in seconds."""
    return fold(lookups, by, [ts, tie], [ts], lambda: TtlCache(ttl))


def outcome_counts(events: DataFrame, by: str, outcome: str, values: list[str]) -> DataFrame:
    """Counts by outcome as columns, their total, and the share of the first."""
    counts = events.groupBy(by).pivot(outcome, values).count().na.fill(0, values)
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return counts.withColumn("total", total).withColumn("hit_rate", F.round(F.coalesce(F.try_divide(F.col(values[0]).cast("double"), total.cast("double")), F.lit(0.0)), 6))


def latency_summary(events: DataFrame, by: str, value: str) -> DataFrame:
    """Median (the upper one of two), p95 by floor index, and maximum."""
    w = Window.partitionBy(by)
    ranked = events.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    upper = ranked.groupBy(by).agg(F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2), F.col(value))).alias("p50"), F.max(value).alias("max"))
    return floor_percentile(events, [by], value, {"p95": 0.95}).join(upper, by)
