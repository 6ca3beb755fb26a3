"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import Breaker
from ..session import Scratch

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(folder)


def seconds(column: str = "ts"):
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return what it wrote."""
    scratch = Scratch(stream.sparkSession, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{scratch.path}/checkpoint").trigger(availableNow=True)
    out = f"{scratch.path}/rows"
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def _stateful(stream: DataFrame, key: str, out: str, state: str, update: Callable) -> DataFrame:
    return stream.groupBy(key).applyInPandasWithState(update, out, state, "append", GroupStateTimeout.NoTimeout)


def compaction(stream: DataFrame, trigger: int = 15, keep: int = 5) -> DataFrame:
    """Episodes as they complete: ``user_id, episode, first_id, last_id`` of archived messages.

    The state is the messages not yet archived, fewer than ``trigger`` of them.
    """

    def update(key, batches, state: GroupState):
        import pandas as pd

        done, held = state.get if state.exists else (0, [])
        held, rows = list(held), []
        new = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for event_id in new["event_id"].tolist():
            held.append(event_id)
            if len(held) >= trigger:
                done += 1
                rows.append((key[0], done, held[0], held[-keep - 1]))
                held = held[-keep:]
        state.update((done, held))
        yield pd.DataFrame(rows, columns=["user_id", "episode", "first_id", "last_id"])

    return _stateful(stream, "user_id", "user_id long, episode int, first_id long, last_id long", "done int, held array<bigint>", update)


def breaker(stream: DataFrame, failures: int = 5, recovery: float = 60.0) -> DataFrame:
    """``user_id, event_id, allowed, state`` of every call; the state is the breaker's three numbers."""

    def update(key, batches, state: GroupState):
        import pandas as pd

        machine = Breaker(failures, recovery)
        if state.exists:
            machine.state, machine.fails, machine.opened = state.get
        rows = []
        new = pd.concat(list(batches)).sort_values(["sec", "event_id"])
        for event_id, sec, ok in zip(new["event_id"].tolist(), new["sec"].tolist(), new["ok"].tolist()):
            rows.append((key[0], event_id, *machine.step(sec, ok)))
        state.update((machine.state, machine.fails, machine.opened))
        yield pd.DataFrame(rows, columns=["user_id", "event_id", "allowed", "state"])

    calls = stream.select("user_id", "event_id", seconds().alias("sec"), (F.col("event_type") != "error").alias("ok"))
    return _stateful(calls, "user_id", "user_id long, event_id long, allowed boolean, state string", "state string, fails int, opened double", update)


def monitor(stream: DataFrame, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Calls, failures and mean value of each tumbling window and type; rows later than ``late`` are left out."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    grouped = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return grouped.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "mean_value")


def hit_once(stream: DataFrame, ttl: str = "5 minutes") -> DataFrame:
    """The first lookup of each key within a time to live: what a shared cache would have to compute."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", ttl)
    return timed.dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("event_id", "user_id", "event_type")
