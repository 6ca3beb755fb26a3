"""Upserts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Scratch


def upserted(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """``existing`` with ``incoming`` rows put in by key; of incoming rows with one key the last by ``order``."""
    last = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
    return existing.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def write_upsert(incoming: DataFrame, path: str, key: str, order: str) -> int:
    """Upsert into the Parquet table at ``path``; returns the number of incoming rows.

    The new table is written in full into a folder beside the old one; then the folders are renamed.
    A run that breaks off leaves the old table, in its place or, between the two renames, as
    ``path.old``, from where the next run puts it back.
    """
    from pyspark.errors import AnalysisException

    spark = incoming.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    now, new, old = (jvm.Path(path.rstrip("/") + end) for end in ("", ".new", ".old"))
    files = now.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(old) and not files.exists(now):
        files.rename(old, now)
    try:
        existing = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        existing = spark.createDataFrame([], incoming.schema)
    upserted(existing, incoming, key, order).write.mode("overwrite").parquet(path.rstrip("/") + ".new")
    files.delete(old, True)
    if files.exists(now):
        files.rename(now, old)
    files.rename(new, now)
    files.delete(old, True)
    spark.catalog.refreshByPath(path)
    return incoming.count()


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines and as a Markdown table of its columns, in two folders below ``path``."""
    report.write.mode("overwrite").json(f"{path}/json")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.columns]
    rows = report.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    head = report.sparkSession.createDataFrame([("| " + " | ".join(report.columns) + " |",), ("|" + "---|" * len(report.columns),)], "value string")
    head.coalesce(1).unionByName(rows).write.mode("overwrite").text(f"{path}/markdown")


def config_hash(config: dict) -> str:
    """SHA-256 of a configuration as JSON with sorted keys."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
