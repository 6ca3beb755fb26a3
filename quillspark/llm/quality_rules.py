"""Quality rules as a short-circuit cascade, in built-in expressions only.

The metrics of a text, which are part of the result, are computed once. The rules are tried many times
over on a sample, which gives each one's cost and how many rows it rejects; they are then asked in
order of rejections per cost, and a text that one rule rejects is not shown to the next, so rules that
read the text again come after what the metrics decide. The order never changes what is kept.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

_BLANKS = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a SQL condition over the text and its metrics."""

    name: str
    rejects: str


#: Thresholds are parameters; all conditions are false for texts without words.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 24 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 10 * n_dup_lines > 9 * n_lines"),
    Rule("capitals", r"2 * length(regexp_replace(text, '[^\\p{Lu}]', '')) > word_chars"),
    Rule("digits", "2 * length(regexp_replace(text, '[^0-9]', '')) > word_chars"),
)


def with_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` and the metrics of every row; a null text has no words, lines or symbols."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    split = F.array_remove(F.split(F.translate("text", _BLANKS, " " * len(_BLANKS)), " "), "")
    lines = F.filter(F.split("text", "\n"), lambda s: F.length(F.translate(s, _BLANKS, "")) > 0)
    rows = rows.select("doc_id", "text", split.alias("words"), lines.alias("lines"))
    size = F.size("words")
    windows = F.when(size < 3, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.concat_ws(" ", F.col("words")[i], F.col("words")[i + 1], F.col("words")[i + 2]))
    )
    rows = rows.select("doc_id", "text", "lines", size.cast("long").alias("n_words"), windows.alias("windows"))
    return rows.select(
        "doc_id",
        "text",
        "n_words",
        F.length(F.translate("text", _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("windows") == F.size(F.array_distinct("windows")), F.lit(0)).otherwise(_covered(F.col("windows"))).cast("long").alias("n_repeat_words"),
    )


def _covered(windows: Column) -> Column:
    """Words that lie in a window whose text occurs twice or more; windows start at each word."""
    sorted_ = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))

    def places(own: Column) -> Column:
        """Starts of repeated windows in text order: in the sorted list they are next to an equal one."""
        last = F.size(own) - 1
        same = F.filter(
            F.sequence(F.lit(0), last),
            lambda i: ((i > 0) & (own[i]["w"] == own[F.greatest(i - 1, F.lit(0))]["w"])) | ((i < last) & (own[i]["w"] == own[F.least(i + 1, last)]["w"])),
        )
        return F.array_sort(F.transform(same, lambda i: own[i]["p"]))

    def total(p: Column) -> Column:
        return F.when(F.size(p) < 2, F.size(p) * 3).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(3), lambda n, k: n + F.least(F.lit(3), p[k] - p[k - 1]))
        )

    # A one-element array names the intermediate result, which would otherwise be computed at each use.
    held = F.transform(F.array(sorted_), places)
    return F.transform(held, total)[0]


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def measured(sample: DataFrame, conditions: list[str], least: float = 0.25, most: int = 4096) -> list[tuple[float, int]]:
    """Seconds and rejections of one pass of each condition over the ``sample``, a written table of bounded size.

    The rows are repeated within one job, eight times as often each time, until the condition takes
    ``least`` seconds more than reading alone, so that a job's own time does not count. A fifth of
    that is the smallest difference that is told from none.
    """
    spark = sample.sparkSession
    rows = F.broadcast(sample)

    def timed(condition: str, times: int) -> tuple[float, int]:
        many = spark.range(times, numPartitions=1).crossJoin(rows)
        began = time.perf_counter()
        rejected = many.agg(F.coalesce(F.sum(F.expr(f"CAST(({condition}) AS INT)")), F.lit(0))).first()[0]
        return time.perf_counter() - began, rejected // times

    out, idle = [], {}
    for condition in conditions:
        times = 1
        while True:
            if times not in idle:
                timed("n_words >= 0", times)
                idle[times], _ = timed("n_words >= 0", times)
            spent, rejected = timed(condition, times)
            if spent - idle[times] >= least or times >= most:
                out.append((max(spent - idle[times], least / 5) / times, rejected))
                break
            times *= 8
    return out


def ordered(rules: list[Rule], costs: list[tuple[float, int]], apart: float = 8.0) -> list[Rule]:
    """The rules by rejections per cost, then by rejections and name.

    Costs that lie within a factor of ``apart`` from the next lower one are one and the same, so that
    the noise of a measurement does not change the order of rules that cost alike.
    """
    tiers: dict[str, float] = {}
    last = tier = 0.0
    for cost, rule in sorted(((c, r) for (c, _), r in zip(costs, rules)), key=lambda x: (x[0], x[1].name)):
        if cost > last * apart:
            tier = cost
        last, tiers[rule.name] = cost, tier
    rejected = {r.name: n for (_, n), r in zip(costs, rules)}
    return sorted(rules, key=lambda r: (-rejected[r.name] / tiers[r.name], -rejected[r.name], r.name))


def cascade_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, seed: int = 7) -> list[Rule]:
    """The rules by rejections per second on a sample of about ``sample_rows`` rows, taken before any metric.

    Rows that the base rejects are left out, as no rule is asked about them.
    """
    count = docs.count()
    if not count:
        return list(rules)
    sampled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).sample(min(1.0, sample_rows / count), seed)
    # Written first: a filter on the metrics, pushed below them, would compute them twice.
    sample = Scratch(docs.sparkSession, "cascade").keep(with_metrics(sampled, "id", "t"), "sample").filter(F.expr(f"NOT ({BASE_FAILED})"))
    return ordered(list(rules), measured(sample, [r.rejects for r in rules]))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """Metrics of every row, ``base_failed``, ``rejected_by`` and ``kept``.

    ``rejected_by`` is ``base`` or the first rule, in this run's order, that rejects the text, else
    null. Null texts count as empty, which the base rejects; null ids and repeated rows stay; an empty
    table gives no rows.
    """
    metrics = with_metrics(docs, id_col, text_col)
    chain = F.when(F.col("base_failed"), F.lit("base"))
    for rule in cascade_order(docs, id_col, text_col, rules, sample_rows):
        chain = chain.when(F.expr(rule.rejects), F.lit(rule.name))
    rows = metrics.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rejected_by", chain)
    return rows.withColumn("kept", F.col("rejected_by").isNull()).drop("text")
