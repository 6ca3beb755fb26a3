"""Queries over the event log: calls, caches, breakers, memory by user, and their streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation, memory, monitor
from ..sources.readers import table
from ..streaming import streams
from .registry import query


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("sec", streams.seconds())


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Events as calls of one of three agents: errors failed, the value is the latency."""
    return events(spark, sf).select("event_id", "ts", "sec", "user_id", (F.col("user_id") % 3).alias("agent"), (F.col("event_type") != "error").alias("ok"), (F.col("value") * 40).alias("ms"))


CALLS = "calls AS (SELECT event_id, ts, epoch(ts) AS sec, user_id, user_id % 3 AS agent, event_type <> 'error' AS ok, value * 40 AS ms FROM events)"
STATS = f"{CALLS}, stats AS (SELECT agent, count(*) AS total, round(sum(ok::INT) / count(*), 3) AS success_rate, round(sum(ms) / count(*), 1) AS avg_ms FROM calls GROUP BY agent)"
SCORED = f"""{STATS}, pen AS (SELECT *, least(0.9, CASE WHEN success_rate < 0.9 THEN least(0.5, (0.9 - success_rate) * 2) ELSE 0 END + CASE WHEN avg_ms > 3000 THEN least(0.4, (avg_ms - 3000) / 10000) ELSE 0 END) AS p FROM stats),
scored AS (SELECT agent, total, success_rate, avg_ms, round(p, 6)::DOUBLE AS penalty, round((0.7 * success_rate + 0.3 / (1 + avg_ms / 1000)) * greatest(0, 1 - p), 6)::DOUBLE AS routing_score FROM pen)"""


@query(f"WITH {STATS} SELECT * FROM stats")
def agent_stats(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.call_stats(calls(spark, sf), "agent")


@query(f"WITH {CALLS} SELECT user_id, count(*) AS total, round(sum(ok::INT) / count(*), 3) AS success_rate, round(sum(CASE WHEN ok THEN ms ELSE 0 END) / count(*), 1) AS avg_ms FROM calls GROUP BY user_id")
def tool_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Latency sums over successes, over the number of all calls."""
    return monitor.call_stats(calls(spark, sf), "user_id", successes_only=True)


@query(f"WITH {SCORED} SELECT * FROM scored")
def routing_score(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.scored(monitor.call_stats(calls(spark, sf), "agent"))


@query(f"WITH {SCORED} SELECT agent, routing_score FROM scored ORDER BY routing_score DESC, agent LIMIT 1")
def best_agent(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.best_agent(routing_score(spark, sf), "agent")


_ALERTS = """m AS (SELECT {1}::VARCHAR AS label, unnest(['{2}_success_rate', '{2}_avg_ms']) AS metric, unnest([success_rate, avg_ms]) AS value FROM {0}),
th(metric, threshold, severity, low) AS (VALUES ('agent_success_rate', 0.90::DOUBLE, 'error', TRUE), ('tool_success_rate', 0.95::DOUBLE, 'warning', TRUE), ('agent_avg_ms', 3000.0::DOUBLE, 'warning', FALSE), ('tool_avg_ms', 5000.0::DOUBLE, 'error', FALSE))
SELECT metric, label, value, threshold, severity FROM m JOIN th USING (metric) WHERE CASE WHEN low THEN value < threshold ELSE value > threshold END"""


@query(f"WITH {STATS}, {_ALERTS.format('stats', 'agent', 'agent')}")
def alerts(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.alerts(monitor.call_stats(calls(spark, sf), "agent"), "agent", "agent")


@query(
    """WITH w AS (SELECT event_type, ts, event_id, value, count(value) OVER f AS n, avg(value) OVER f AS m, stddev_samp(value) OVER f AS s FROM events WINDOW f AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
    SELECT event_type, ts, event_id, value, round(abs(value - m) / s, 2) AS z_score, CASE WHEN abs(value - m) / s > 3.75 THEN 'high' ELSE 'medium' END AS severity FROM w WHERE n >= 30 AND s > 1e-12 AND abs(value - m) / s > 2.5"""
)
def zscore_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.zscores(table(spark, sf, "events"), ["event_type"], ["ts", "event_id"], "value")


_RUNS = f"""{CALLS}, g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY agent ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM calls),
runs AS (SELECT agent, count(*) AS length, min(event_id) AS first_id FROM g WHERE NOT ok GROUP BY agent, g HAVING count(*) >= 3)"""


@query(f"WITH {_RUNS} SELECT * FROM runs")
def failure_runs(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.failure_runs(calls(spark, sf), "agent", ["ts", "event_id"])


@query(
    f"""WITH {_RUNS}, st AS (SELECT agent, count(*) AS total, round(sum(ok::INT) / count(*), 3) AS success_rate FROM calls GROUP BY agent)
    SELECT * FROM (SELECT DISTINCT agent::VARCHAR AS label, 'repeated_failure' AS title, 9 AS priority FROM runs UNION ALL SELECT agent::VARCHAR, 'low_success', 8 FROM st WHERE success_rate < 0.85 AND total > 10) ORDER BY priority DESC, title, label LIMIT 5"""
)
def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """A report of the five most urgent ones."""
    return monitor.suggestions(monitor.call_stats(calls(spark, sf), "agent"), failure_runs(spark, sf), "agent")


_LATENCY = """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, any_value(n) AS n, max(CASE WHEN i = floor((n - 1) * 0.95) THEN value END) AS p95, {0} FROM r GROUP BY event_type"""


@query(_LATENCY.format("max(CASE WHEN i = n // 2 THEN value END) AS p50, max(value) AS max"))
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.latency_summary(table(spark, sf, "events"), "event_type", "value")


@query(_LATENCY.format("max(CASE WHEN i = floor((n - 1) * 0.5) THEN value END) AS p50"))
def guard_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.floor_percentile(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


_OUTCOME = "CASE event_type WHEN 'view' THEN 'hit' WHEN 'click' THEN 'miss' WHEN 'error' THEN 'error' ELSE 'invalidated' END"


@query(f"""WITH o AS (SELECT user_id % 10 AS layer, {_OUTCOME} AS o FROM events), c AS (SELECT layer, count(*) FILTER (o = 'hit') AS hit, count(*) FILTER (o = 'miss') AS miss, count(*) FILTER (o = 'error') AS error, count(*) FILTER (o = 'invalidated') AS invalidated, count(*) AS total FROM o GROUP BY layer)
SELECT *, round(hit / total, 6) AS hit_rate FROM c""")
def cache_metrics_pivot(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "view", "hit").when(F.col("event_type") == "click", "miss").when(F.col("event_type") == "error", "error").otherwise("invalidated")
    rows = table(spark, sf, "events").select((F.col("user_id") % 10).alias("layer"), outcome.alias("o"))
    return monitor.outcome_counts(rows, "layer", "o", ["hit", "miss", "error", "invalidated"])


USAGE = (("anthropic", 20, 100, 10, None), ("openai", 130, 100, None, None), ("deepseek", None, 100, None, 30), ("openai", None, None, None, None), ("anthropic", 5, 0, 7, None))
_USAGE_SQL = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else "NULL" if v is None else str(v) for v in row) + f", {i})" for i, row in enumerate(USAGE))


@query(
    f"""SELECT i, provider, (CASE WHEN provider = 'anthropic' THEN coalesce(plain, 0) + coalesce(rd, 0) + coalesce(wr, 0) ELSE coalesce(plain, coalesce(rd, 0) + coalesce(miss, 0)) END)::INT AS total_input,
    CASE WHEN coalesce(rd, wr, miss) IS NULL THEN 'unknown' WHEN coalesce(rd, 0) > 0 THEN 'hit' WHEN coalesce(wr, 0) > 0 OR coalesce(miss, 0) > 0 THEN 'miss' ELSE 'ineligible' END AS status FROM (VALUES {_USAGE_SQL}) AS t(provider, plain, rd, wr, miss, i)"""
)
def provider_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(*r, i) for i, r in enumerate(USAGE)], "provider string, plain int, rd int, wr int, miss int, i int")
    c = F.col
    return rows.select("i", "provider", X.total_input_tokens(c("provider"), c("plain"), c("rd"), c("wr"), c("miss")).alias("total_input"), X.cache_status(c("provider"), c("rd"), c("wr"), c("miss")).alias("status"))


# --- memory by user ------------------------------------------------------------------------------

_COMPACT = """n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
e AS (SELECT *, CASE WHEN n < 15 THEN 0 ELSE floor((n - 5) / 10) END::INT AS episodes FROM n)"""


@query(f"WITH {_COMPACT} SELECT user_id, event_id, i::INT AS i, episodes, CASE WHEN ceil(i / 10) <= episodes THEN ceil(i / 10) END::INT AS episode FROM e")
def compaction(spark: SparkSession, sf: str) -> DataFrame:
    return memory.compaction(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "i", "episodes", "episode")


@query(
    """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum((p IS NULL OR ts >= p + INTERVAL 24 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM l)
    SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, s"""
)
def ttl_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return memory.sessions(table(spark, sf, "events"), ["user_id"], "ts")


_SEQ = "q AS (SELECT user_id, event_id, epoch(ts) AS sec, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(
    f"""WITH RECURSIVE {_SEQ}, r AS (SELECT user_id, i, event_id, TRUE AS accepted, sec AS at, event_type AS fp FROM q WHERE i = 1 UNION ALL
    SELECT q.user_id, q.i, q.event_id, q.event_type <> r.fp AND q.sec - r.at >= 36000, CASE WHEN q.event_type <> r.fp AND q.sec - r.at >= 36000 THEN q.sec ELSE r.at END, CASE WHEN q.event_type <> r.fp AND q.sec - r.at >= 36000 THEN q.event_type ELSE r.fp END FROM r JOIN q ON q.user_id = r.user_id AND q.i = r.i + 1)
    SELECT user_id, event_id, accepted FROM r"""
)
def profile_throttle(spark: SparkSession, sf: str) -> DataFrame:
    """The event type is the fingerprint; ten hours between accepted updates."""
    return memory.throttled(events(spark, sf), ["user_id"], "sec", "event_id", "event_type", 36000.0).select("user_id", "event_id", "accepted")


@query(
    f"""WITH RECURSIVE {_SEQ}, r AS (SELECT user_id, i, event_id, FALSE AS hit, sec AS at FROM q WHERE i = 1 UNION ALL
    SELECT q.user_id, q.i, q.event_id, q.sec < r.at + 43200, CASE WHEN q.sec < r.at + 43200 THEN r.at ELSE q.sec END FROM r JOIN q ON q.user_id = r.user_id AND q.i = r.i + 1)
    SELECT user_id, event_id, hit FROM r"""
)
def cache_ttl_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Entries live for twelve hours, as events are hours apart."""
    return monitor.ttl_hits(events(spark, sf), ["user_id"], "sec", "event_id", 43200.0).select("user_id", "event_id", "hit")


_BREAKER = f"""WITH RECURSIVE {_SEQ}, r AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, TRUE AS allowed, 'closed' AS state, 0 AS fails, 0::DOUBLE AS opened FROM q WHERE i = 1 UNION ALL
SELECT user_id, i, event_id, allowed, CASE WHEN NOT allowed THEN pstate WHEN ok THEN 'closed' WHEN nf >= 2 THEN 'open' ELSE CASE WHEN pstate = 'open' THEN 'half_open' ELSE pstate END END, CASE WHEN NOT allowed THEN pf WHEN ok THEN 0 ELSE nf END, CASE WHEN allowed AND NOT ok AND nf >= 2 THEN sec ELSE po END
FROM (SELECT q.user_id, q.i, q.event_id, q.sec, q.event_type <> 'error' AS ok, r.state AS pstate, r.fails AS pf, r.opened AS po, r.fails + 1 AS nf, r.state <> 'open' OR q.sec - r.opened >= 43200 AS allowed FROM r JOIN q ON q.user_id = r.user_id AND q.i = r.i + 1))
SELECT user_id, event_id, allowed, state FROM r WHERE i > 0"""


@query(_BREAKER)
def circuit_breaker(spark: SparkSession, sf: str) -> DataFrame:
    """Two failures in a row open it for twelve hours, as events are hours apart."""
    return monitor.breaker(calls(spark, sf), "user_id", "sec", "event_id", failures=2, recovery=43200.0).select("user_id", "event_id", "allowed", "state")


@query(
    """WITH c AS (SELECT q.vec_id AS query_id, v.vec_id AS idx, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 4) AS distance FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, idx) AS r FROM c),
    k AS (SELECT *, round(1 - distance, 6) AS relevance, 'episode ' || (idx % 3) AS text FROM n WHERE r <= 5 AND round(1 - distance, 6) >= 0.35),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY relevance DESC, idx DESC, r) AS t FROM k)
    SELECT query_id, idx, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, idx DESC, r)::INT AS pos FROM o WHERE t = 1"""
)
def episodic_search(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors stand for entries; their text is one of three, their time the id."""
    from ..operators import retrieval

    vectors = table(spark, sf, "embeddings")
    near = retrieval.knn(vectors.filter("vec_id % 50 = 0"), vectors, 5)
    found = near.select("query_id", F.col("vec_id").alias("idx"), F.round(1 - F.col("score"), 4).alias("distance"), F.col("vec_id").alias("ts"), F.concat(F.lit("Episode "), F.col("vec_id") % 3).alias("text"))
    return memory.episodic(found)


# --- streaming -----------------------------------------------------------------------------------


@query(f"WITH {_COMPACT}, a AS (SELECT user_id, ceil(i / 10)::INT AS episode, episodes, event_id, i FROM e) SELECT user_id, episode, arg_min(event_id, i) AS first_id, arg_max(event_id, i) AS last_id FROM a WHERE episode <= episodes GROUP BY ALL")
def stream_compaction(spark: SparkSession, sf: str) -> DataFrame:
    return streams.finished(streams.compaction(streams.events(spark, sf)))


@query(_BREAKER)
def stream_breaker(spark: SparkSession, sf: str) -> DataFrame:
    return streams.finished(streams.breaker(streams.events(spark, sf), 2, 43200.0))


@query("SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def stream_monitor(spark: SparkSession, sf: str) -> DataFrame:
    return streams.finished(streams.monitor(streams.events(spark, sf)), "complete")
