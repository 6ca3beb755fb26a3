"""Stored reports, labelled query sets and knowledge stores as DataFrames."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

REPORT = (
    "timestamp STRING, total INT, passed INT, pass_rate DOUBLE, avg_scores MAP<STRING,DOUBLE>, regressions ARRAY<STRING>, recommendations ARRAY<STRING>, "
    "results ARRAY<STRUCT<test_id:STRING,passed:BOOLEAN,scores:MAP<STRING,DOUBLE>,detail:STRING>>"
)
STORED = "id STRING, title STRING, content STRING, chunkIndex INT, metadata MAP<STRING,STRING>"


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """``metric, value`` of a stored report; none if it is missing or broken. Old reports may lack metrics."""
    try:
        rows = spark.read.schema(REPORT).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], REPORT)
    return rows.select(F.explode("avg_scores").alias("metric", "value"))


def write_baseline(scores: DataFrame, path: str) -> None:
    """Replace the stored report's scores by ``metric, value``: a handful of rows, one file."""
    scores.agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("avg_scores")).coalesce(1).write.mode("overwrite").json(path)


# The templates whose queries set thresholds and are not tested on.
CALIBRATION = ("noanswer-01", "noanswer-02")


def labelled_queries(templates: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row per paraphrase of each template, with the source ids of its titles and their grades.

    ``templates``: template (its id), titles, sections, queries, facts, grades (a map from title to
    grade), category, query_type. ``corpus``: title, content. All paraphrases of the templates in
    ``CALIBRATION`` are for calibration, the others for tests; the category tells what has no answer.
    Paraphrases count from 1.
    """
    sources = corpus.select("title", X.source_id(F.col("title"), F.col("content")).alias("source_id"))
    named = templates.select("template", F.explode_outer("titles").alias("title")).join(sources, "title", "left")
    found = named.groupBy("template").agg(F.array_sort(F.collect_set("source_id")).alias("relevant_source_ids"))
    graded = templates.select("template", F.explode("grades").alias("title", "grade")).join(sources, "title")
    grades = graded.groupBy("template").agg(F.map_from_entries(F.collect_list(F.struct("source_id", "grade"))).alias("relevance"))
    rows = templates.join(found, "template").join(grades, "template", "left").select("*", F.posexplode("queries").alias("i", "query"))
    return rows.select(
        F.concat_ws("-", "template", F.col("i") + 1).alias("id"),
        F.col("template").alias("partition"),
        "query",
        "category",
        "query_type",
        "relevant_source_ids",
        F.col("sections").alias("relevant_sections"),
        F.col("facts").alias("must_recall_facts"),
        F.coalesce("relevance", F.create_map().cast("map<string,int>")).alias("relevance"),
        (F.col("category") == "no_answer").alias("no_answer"),
        F.when(F.col("template").isin(*CALIBRATION), "calibration").otherwise("test").alias("role"),
    )


def knowledge_store(spark: SparkSession, path: str) -> DataFrame:
    """A persisted store's documents: blank contents are left out, blank ids made from title, index and text."""
    rows = spark.read.schema(STORED).json(path, multiLine=True).filter(F.trim(F.coalesce("content", F.lit(""))) != "")
    own = X.legacy_chunk_id(F.coalesce("title", F.lit("")), F.coalesce("chunkIndex", F.lit(0)), F.col("content"))
    return rows.withColumn("id", F.when(F.trim(F.coalesce("id", F.lit(""))) == "", own).otherwise(F.col("id")))


def json_skills(files: DataFrame) -> DataFrame:
    """``name, content, keywords`` of JSON skill files ``path, text``; those without content or instructions are left out."""
    one = F.from_json("text", "name STRING, content STRING, instructions STRING, keywords ARRAY<STRING>")
    rows = files.filter(F.lower("path").endswith(".json")).select("path", one.alias("s"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    body = X.strip(F.coalesce(F.nullif(F.col("s.content"), F.lit("")), F.col("s.instructions"), F.lit("")))
    return rows.select(F.coalesce(F.nullif(F.col("s.name"), F.lit("")), stem).alias("name"), body.alias("content"), F.coalesce("s.keywords", F.array().cast("array<string>")).alias("keywords")).filter("content <> ''")
