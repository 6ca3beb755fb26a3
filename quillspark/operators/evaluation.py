"""Retrieval metrics, their summaries, bootstrap intervals and gates; classifier and dialogue reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .retrieval import small

METRICS = ("recall_at_5", "recall_at_10", "precision_at_3", "mrr_at_10", "ndcg_at_10", "duplicate_top3", "no_answer_false_positive")


def query_metrics(queries: DataFrame, results: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per query.

    ``queries``: query_id, category, query_type. ``results``: query_id, pos (from 1), source_id, key.
    ``labels``: query_id, source_id, grade. Recall is a hit rate and 1 without labels; a source counts
    at its first position; gains are linear over log2(position + 1); a query without an answer is a
    false positive if it has results.
    """
    top = results.filter("pos <= 10")
    first = top.groupBy("query_id", "source_id").agg(F.min("pos").alias("pos"))
    hit = first.join(labels, ["query_id", "source_id"])
    found = hit.groupBy("query_id").agg(
        F.min("pos").alias("first_relevant_rank"),
        F.sum((F.col("pos") <= 3).cast("int")).alias("top3"),
        F.sum(F.col("grade") / F.log2(F.col("pos") + 1)).alias("dcg"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "source_id"))
    ideal = labels.withColumn("i", place).filter("i <= 10").groupBy("query_id").agg(F.count("*").alias("n_labels"), F.sum(F.col("grade") / F.log2(F.col("i") + 1)).alias("idcg"))
    shown = top.groupBy("query_id").agg(F.count("*").alias("n_results"), (F.sum((F.col("pos") <= 3).cast("int")) - F.countDistinct(F.when(F.col("pos") <= 3, F.col("key")))).alias("repeated"))
    rows = queries.join(found, "query_id", "left").join(ideal, "query_id", "left").join(shown, "query_id", "left")
    rank = F.col("first_relevant_rank")

    def recall(k: int) -> Column:
        return F.when(F.col("n_labels").isNull(), 1.0).otherwise(F.coalesce((rank <= k).cast("double"), F.lit(0.0)))

    return rows.select(
        "query_id",
        "category",
        "query_type",
        recall(5).alias("recall_at_5"),
        recall(10).alias("recall_at_10"),
        F.round(F.coalesce(F.col("top3"), F.lit(0)) / 3, 6).alias("precision_at_3"),
        F.round(F.coalesce(1 / rank, F.lit(0.0)), 6).alias("mrr_at_10"),
        F.round(F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)), 6).alias("ndcg_at_10"),
        (F.coalesce("repeated", F.lit(0)) > 0).cast("double").alias("duplicate_top3"),
        ((F.col("query_type") == "no_answer") & (F.coalesce("n_results", F.lit(0)) > 0)).cast("double").alias("no_answer_false_positive"),
        F.coalesce(rank, F.lit(0)).cast("int").alias("first_relevant_rank"),
    )


def fact_coverage(facts: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, n_facts, coverage``: share of non-empty facts that the joined top ``k`` contents hold.

    ``facts``: query_id, fact. ``results``: query_id, pos, content. White space and case do not count.
    """
    ordered = F.sort_array(F.collect_list(F.struct("pos", X.content_form(F.col("content")).alias("c"))))
    joined = results.filter(F.col("pos") <= k).groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda s: s["c"]), "").alias("all"))
    rows = facts.withColumn("fact", X.content_form(F.col("fact"))).filter("fact <> ''").join(joined, "query_id", "left")
    held = F.coalesce(F.col("all").contains(F.col("fact")), F.lit(False)).cast("double")
    return rows.groupBy("query_id").agg(F.count("*").alias("n_facts"), F.round(F.avg(held), 6).alias("coverage"))


def summary(metrics: DataFrame) -> DataFrame:
    """Means over all queries, by category and by type, in one pass of grouping sets."""
    means = [F.round(F.avg(F.when(F.col("query_type") == "no_answer", F.col(m)) if m == "no_answer_false_positive" else F.col(m)), 4) for m in METRICS]
    named = [F.coalesce(c, F.lit(0.0)).alias(m) for c, m in zip(means, METRICS)]
    grouped = metrics.groupingSets([[], [F.col("category")], [F.col("query_type")]], F.col("category"), F.col("query_type"))
    return grouped.agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), *named).select("gid", "category", "query_type", "n", *METRICS)


def paired_delta(ours: DataFrame, theirs: DataFrame, metric: str) -> DataFrame:
    """``query_id, cluster, delta`` of one metric between two variants' rows."""
    left = ours.select("query_id", "cluster", F.col(metric).alias("a"))
    return left.join(theirs.select("query_id", F.col(metric).alias("b")), "query_id").select("query_id", "cluster", F.round(F.col("a") - F.col("b"), 6).alias("delta"))


def bootstrap(deltas: DataFrame, rounds: int = 2000, seed: int = 20260808) -> DataFrame:
    """Mean delta with a 95 % interval from resampled clusters; all zero where there are fewer than two rows.

    Draw ``i`` of round ``r`` is a fixed mixing of (seed, r, i), so every engine draws the same. Only
    clusters' sums take part, so the work is rounds times clusters.
    """
    clusters = deltas.groupBy("cluster").agg(F.sum("delta").alias("s"), F.count("*").alias("n"))
    numbered = clusters.withColumn("c", F.row_number().over(Window.orderBy("cluster")) - 1)
    total = clusters.agg(F.count("*").alias("k"), F.sum("s").alias("s_all"), F.sum("n").alias("n_all"))
    draws = deltas.sparkSession.range(rounds).withColumnRenamed("id", "r").crossJoin(F.broadcast(total)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    mixed = F.pmod((F.col("r") * F.col("k") + F.col("i") + seed) * 48271 % 2147483647 * 48271 % 2147483647, F.col("k"))
    sampled = draws.withColumn("c", mixed).join(small(numbered), "c")
    means = sampled.groupBy("r").agg(F.round(F.sum("s") / F.sum("n"), 9).alias("m"))
    ranked = means.withColumn("p", F.row_number().over(Window.orderBy("m", "r")) - 1)
    low, high = max(0, int(0.025 * rounds) - 1), int(0.975 * rounds) - 1
    ends = ranked.agg(F.round(F.max(F.when(F.col("p") == low, F.col("m"))), 6).alias("ci_low"), F.round(F.max(F.when(F.col("p") == high, F.col("m"))), 6).alias("ci_high"))
    few = F.coalesce(F.col("n_all"), F.lit(0)) < 2
    zero = lambda c: F.when(few, 0.0).otherwise(c)
    mean = zero(F.round(F.col("s_all") / F.col("n_all"), 6)).alias("mean_delta")
    return total.crossJoin(ends).select(mean, F.col("k").alias("clusters"), zero(F.col("ci_low")).alias("ci_low"), zero(F.col("ci_high")).alias("ci_high"))


def acceptance(ours: DataFrame, theirs: DataFrame, interval: DataFrame, p95_ours: float, p95_theirs: float) -> DataFrame:
    """The gates on one-row summaries: thresholds, no loss, no repeats, latency; and whether all hold."""
    a = ours.select(*[F.col(m).alias(f"a_{m}") for m in METRICS])
    b = theirs.select(*[F.col(m).alias(f"b_{m}") for m in METRICS])
    rows = a.crossJoin(b).crossJoin(interval)
    c = F.col
    checks = {
        "recall_at_5_gte_90": c("a_recall_at_5") >= 0.90,
        "recall_at_5_vs_r1_gte_5pp": F.round(c("a_recall_at_5") - c("b_recall_at_5"), 6) >= 0.05,
        "recall_at_5_ci_above_zero": c("ci_low") > 0,
        "mrr_not_down_over_2pp": F.round(c("a_mrr_at_10") - c("b_mrr_at_10"), 6) >= -0.02,
        "ndcg_not_down_over_2pp": F.round(c("a_ndcg_at_10") - c("b_ndcg_at_10"), 6) >= -0.02,
        "no_answer_fpr_lte_5": c("a_no_answer_false_positive") <= 0.05,
        "top3_duplicate_zero": c("a_duplicate_top3") == 0,
        "p95_latency_within_1_2x": F.lit(p95_ours <= 1.2 * p95_theirs),
    }
    checked = rows.select(*[v.alias(k) for k, v in checks.items()])
    both = F.lit(True)
    for k in checks:
        both = both & F.col(k)
    return checked.withColumn("passed", both)


def floor_percentile(df: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """For each group the value at index floor((n - 1) * fraction) of the sorted ones."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    picks = [F.max(F.when(F.col("_i") == F.floor((F.col("_n") - 1) * f), F.col(value))).alias(name) for name, f in fractions.items()]
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), *picks)


def per_class(cases: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every label that ``truth`` or ``pred`` has; 0 where undefined."""
    sides = cases.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("truth") == F.col("pred")).cast("int").alias("tp")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))).alias("x"))
    sums = sides.select("x.*").groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    p = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return sums.select("label", "support", "predicted", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def classifier_report(cases: DataFrame) -> DataFrame:
    """Number of cases, accuracy and the mean F1 over labels."""
    overall = cases.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg((F.col("truth") == F.col("pred")).cast("double")), F.lit(0.0)), 4).alias("accuracy"))
    return overall.crossJoin(per_class(cases).agg(F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 4).alias("macro_f1")))


def pass_report(turns: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Dialogue results: ``case_id, turn, expected_ok`` and a map ``scores``.

    A case passes if the mean over its turns of the mean score reaches the threshold and its last turn
    met the expectations.
    """
    mean = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size("scores"), F.lit(1))
    cases = turns.withColumn("overall", mean).groupBy("case_id").agg(F.round(F.avg("overall"), 6).alias("overall"), F.max_by("expected_ok", "turn").alias("last_ok"))
    return cases.withColumn("passed", (F.col("overall") >= threshold) & F.col("last_ok"))


def mean_scores(turns: DataFrame) -> DataFrame:
    """Mean of each score over the results that have it."""
    return turns.select(F.explode("scores").alias("metric", "v")).groupBy("metric").agg(F.round(F.avg("v"), 4).alias("value"))


def regressions(now: DataFrame, before: DataFrame, drop: float = 0.05) -> DataFrame:
    """Metrics that fell by more than a share of their earlier, positive value. Both: metric, value."""
    both = now.withColumnRenamed("value", "current").join(before.withColumnRenamed("value", "previous"), "metric").filter("previous > 0")
    change = F.round((F.col("current") - F.col("previous")) / F.col("previous"), 6)
    return both.withColumn("change", change).filter(F.col("change") < -drop)


def recommendations(scores: DataFrame, rules: dict[str, float]) -> DataFrame:
    """Metrics below their threshold, a missing one counting as 1."""
    limits = scores.sparkSession.createDataFrame(list(rules.items()), "metric string, threshold double")
    both = limits.join(scores, "metric", "left").withColumn("value", F.coalesce("value", F.lit(1.0)))
    return both.filter("value < threshold").select("metric", "value", "threshold")
