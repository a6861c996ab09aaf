"""Queries N1-N5: the streams' batch twins over the adapter views, and their SQL. A10's catalogue is here too."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.adapters import attempts, lines, with_views
from ..sources.files import catalogue
from ..streaming import attempts as N
from .planning import calls


def sessions(s, d):
    """Attempts with deadlines in the middle of their sessions' days."""
    return attempts(s, d).withColumn("deadline", F.to_timestamp_ntz(F.date_trunc("day", F.col("created_at").cast("timestamp"))) + F.expr("INTERVAL 12 HOURS"))


def _late(s, d):
    return N.in_time(sessions(s, d)).groupBy("session_id").agg(F.count_if("late").alias("late"), F.count_if(~F.col("late")).alias("in_time"))


QUERIES = {
    "a10_catalogue": lambda s, d: catalogue(lines(s, d).withColumn("line", F.when(F.col("line_no") % 3 == 1, F.concat(F.col("line_no").cast("string"), F.lit(". "), "line")).otherwise(F.col("line")))).select("doc_id", "number", F.length("question").alias("n")),
    "n1_exactly_once": lambda s, d: N.exactly_once(attempts(s, d)).select("session_id", "question_id", "id"),
    "n2_late_answers": _late,
    "n3_session_fold": lambda s, d: N.fold_sessions(sessions(s, d), 2).withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss")),
    "n4_daily_failures": lambda s, d: N.daily_failures(attempts(s, d)),
    "n5_metric_minutes": lambda s, d: N.metric_minutes(calls(s, d)),
}

_DEADLINE = "d AS (SELECT *, date_trunc('day', created_at) + INTERVAL 12 HOURS AS deadline FROM attempts)"
ORACLE_SQL = {
    "n1_exactly_once": with_views("attempts", "SELECT session_id, question_id, id FROM attempts QUALIFY row_number() OVER (PARTITION BY session_id, question_id ORDER BY created_at, id) = 1"),
    "n2_late_answers": with_views("attempts", f"{_DEADLINE} SELECT session_id, count(*) FILTER (created_at >= deadline) AS late, count(*) FILTER (created_at < deadline) AS in_time FROM d GROUP BY ALL"),
    "n3_session_fold": with_views("attempts", f"""{_DEADLINE}, o AS (SELECT * FROM d WHERE created_at < deadline QUALIFY row_number() OVER (PARTITION BY session_id, question_id ORDER BY created_at, id) = 1),
        t AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) <= 2),
        c AS (SELECT session_id, count(*) FILTER (status <> 'skipped') AS a, count(*) FILTER (status = 'skipped') AS s, max(created_at) AS last_at FROM t GROUP BY ALL)
        SELECT session_id, coalesce(a, 0)::INT AS answered, coalesce(s, 0)::INT AS skipped, (count(*) - coalesce(a, 0) - coalesce(s, 0))::INT AS discarded, CASE WHEN coalesce(a + s, 0) >= 2 THEN 'completed' WHEN bool_or(created_at >= deadline) THEN 'time_expired' ELSE 'answering' END AS state,
        strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at FROM d LEFT JOIN c USING (session_id) GROUP BY session_id, a, s, last_at"""),
    "n4_daily_failures": with_views("attempts", "SELECT strftime(created_at, '%Y-%m-%d') AS day, user_id, subject_id, count(*) AS answers, count(*) FILTER (score < 3) AS failed FROM attempts WHERE score IS NOT NULL GROUP BY ALL"),
    "n5_metric_minutes": "SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) AS calls, avg(floor(value * 10)) AS mean_latency_ms, CAST(sum(floor(value)) AS BIGINT) AS prompt_tokens FROM events GROUP BY ALL",
}
