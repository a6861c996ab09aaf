"""Queries J1-J15 and K3 over the adapter views, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import progress as P
from ..sources.adapters import attempts, questions, with_views

NOW = "2024-02-01 00:00:00"


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.attempt_fact(attempts(spark, sf_dir), questions(spark, sf_dir))


def _points(spark, sf_dir):
    """Texts of missing points: the fixtures carry counts only, so a point is named by its question and number."""
    rows = fact(spark, sf_dir).where("assessed AND missing_count > 0")
    number = F.explode(F.sequence(F.lit(1), F.col("missing_count").cast("int")))
    return rows.select(*P.KEYS, "question_id", number.alias("k")).select(*P.KEYS, F.concat_ws("#", "question_id", "k").alias("text"))


QUERIES = {
    "j1_attempt_fact": lambda s, d: fact(s, d).select("id", "user_id", "subject_id", "question_id", "topic_name", "mode", "status", "assessed", "progress_score", F.col("day").cast("string").alias("day"), "expected_duration_seconds"),
    "j2_totals": lambda s, d: P.totals(fact(s, d)),
    "j3_topics": lambda s, d: P.topic_rows(fact(s, d), NOW),
    "j4_frequent_points": lambda s, d: P.frequent_points(_points(s, d), P.KEYS),
    "j5_failure_trend": lambda s, d: P.failure_trend(fact(s, d)).withColumn("day", F.col("day").cast("string")),
    "j6_failure_names": lambda s, d: P.failure_names(fact(s, d)),
    "j7_due_list": lambda s, d: P.due_list(fact(s, d), NOW).withColumn("priority", F.round("priority", 4)),
    "j8_latest_attempts": lambda s, d: P.latest(fact(s, d)).select(*P.KEYS, "id", "created_at", "duration_seconds", "question_text", "place"),
    "j8_latest_mocks": lambda s, d: P.latest_mocks(fact(s, d)).select(*P.KEYS, "session_id", "session_mode", "created_at", "progress_score", "place"),
    "j10_session_reports": lambda s, d: P.session_reports(attempts(s, d)),
    "j11_run_reports": lambda s, d: P.run_reports(P.session_reports(attempts(s, d))),
    "j12_session_analysis": lambda s, d: P.session_analysis(fact(s, d)),
    "j13_pending_runs": lambda s, d: P.pending_runs(attempts(s, d), F.col("session_id") % 13 == 0).select("id", "run_id", "session_id"),
    "j14_subject_summary": lambda s, d: P.subject_summary(questions(s, d), attempts(s, d)),
    "j15_recent_runs": lambda s, d: P.recent_runs(attempts(s, d)),
    "k3_mastery": lambda s, d: P.mastery(fact(s, d), [*P.KEYS, "topic_name"], NOW).withColumn("time_ratio", F.round("time_ratio", 6)),
}

_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.MODE_LABELS.items())
FACT = f"""fact AS (SELECT a.*, coalesce(q.topic_name, 'Unassigned') AS topic_name, q.question_text, q.expected_duration_seconds,
    CASE a.session_mode {_LABELS} ELSE '{P.INDEPENDENT}' END AS mode, a.status = 'evaluated' AND a.score IS NOT NULL AS assessed,
    CASE WHEN a.status = 'skipped' THEN 0.0::DOUBLE ELSE a.score END AS progress_score, CAST(a.created_at AS DATE) AS day,
    greatest(0, date_sub('day', a.created_at, TIMESTAMP '{NOW}'))::INT AS age FROM attempts a JOIN questions q ON q.id = a.question_id)"""


def over_fact(body: str) -> str:
    return with_views("questions attempts", f"{FACT}{', ' if body.lstrip().split(' ')[1] == 'AS' else ' '}{body}")


MASTERY = """mastery AS (SELECT *, (omissions + incorrect_points) / greatest(1, n) AS rate FROM (SELECT user_id, subject_id, topic_name, count(*) FILTER (assessed) AS n,
    avg(score) FILTER (assessed) AS average, arg_max(score, (created_at, id)) FILTER (assessed) AS latest, CAST(coalesce(sum(missing_count) FILTER (assessed), 0) AS BIGINT) AS omissions,
    CAST(coalesce(sum(incorrect_count) FILTER (assessed), 0) AS BIGINT) AS incorrect_points, avg(duration_seconds / expected_duration_seconds) FILTER (assessed) AS time_ratio,
    min(age) FILTER (assessed) AS recency_days, avg(score) FILTER (assessed AND session_mode IN ('subject_simulation', 'multi_subject')) AS mock_average FROM fact GROUP BY ALL)),
    states AS (SELECT * EXCLUDE (rate), CASE WHEN n = 0 THEN 'not_practised' WHEN average < 2.5 OR rate > 1 THEN 'weak' WHEN n >= 2 AND average >= 4 AND latest >= 4 AND rate <= 0.25
    AND time_ratio <= 1.2 AND recency_days <= 14 AND (coalesce(mock_average, 0) >= 4 OR n >= 3) THEN 'exam_ready' ELSE 'learning' END AS mastery_state FROM mastery)"""
GRADE = "CASE WHEN {p} IS NULL THEN NULL " + " ".join(f"WHEN {{p}} >= {a} THEN {b}" for a, b in P.GRADES) + " ELSE 5.0 END::DOUBLE"
REPORTS = f"""reports AS (SELECT *, {GRADE.format(p="percent_correct")} AS grade FROM (SELECT run_id, session_id, count(*) AS answers, avg(score) FILTER (status = 'evaluated') AS average_score,
    count(*) FILTER (status = 'skipped') AS skipped, round(coalesce(sum(score) FILTER (status = 'evaluated'), 0) / nullif((count(*) FILTER (status IN ('evaluated', 'skipped'))) * 5, 0) * 100, 1) AS percent_correct
    FROM attempts GROUP BY run_id, session_id))"""

ORACLE_SQL = {
    "j1_attempt_fact": over_fact("SELECT id, user_id, subject_id, question_id, topic_name, mode, status, assessed, progress_score, CAST(day AS VARCHAR) AS day, expected_duration_seconds FROM fact"),
    "j2_totals": over_fact("""SELECT user_id, subject_id, count(*) AS attempts_count, count(*) FILTER (assessed) AS evaluated_count, count(*) FILTER (status = 'skipped') AS skipped_count,
        avg(score) FILTER (assessed) AS average_score, max(score) FILTER (assessed) AS best_score, arg_max(score, (created_at, id)) FILTER (assessed) AS last_score,
        avg(duration_seconds) AS average_response_seconds, max(created_at) AS last_practice_at FROM fact GROUP BY ALL"""),
    "j3_topics": over_fact(f"""{MASTERY}, c AS (SELECT user_id, subject_id, topic_name, count(*) AS attempts FROM fact GROUP BY ALL)
        SELECT user_id, subject_id, topic_name, attempts, average AS average_score, latest AS last_score, mastery_state, CAST(row_number() OVER (PARTITION BY user_id, subject_id
        ORDER BY CASE mastery_state WHEN 'weak' THEN 0 WHEN 'learning' THEN 1 WHEN 'exam_ready' THEN 2 ELSE 3 END, topic_name) AS INT) AS place FROM c JOIN states USING (user_id, subject_id, topic_name)"""),
    "j4_frequent_points": over_fact("""p AS (SELECT user_id, subject_id, question_id || '#' || k AS text FROM (SELECT *, unnest(range(1, missing_count + 1)) AS k FROM fact WHERE assessed)),
        c AS (SELECT user_id, subject_id, text, count(*) AS times FROM p GROUP BY ALL)
        SELECT *, CAST(row_number() OVER (PARTITION BY user_id, subject_id ORDER BY times DESC, text) AS INT) AS place FROM c QUALIFY place <= 10"""),
    "j5_failure_trend": over_fact("""SELECT user_id, subject_id, CAST(day AS VARCHAR) AS day, topic_name, mode, CAST(count(*) FILTER (score < 3) AS BIGINT) AS failed_attempts,
        CAST(grouping(topic_name) AS INT) AS all_topics, CAST(grouping(mode) AS INT) AS all_modes FROM fact WHERE assessed
        GROUP BY GROUPING SETS ((user_id, subject_id, day), (user_id, subject_id, day, topic_name), (user_id, subject_id, day, mode), (user_id, subject_id, day, mode, topic_name))"""),
    "j6_failure_names": over_fact("""SELECT user_id, subject_id, string_agg(DISTINCT topic_name, '|' ORDER BY topic_name) AS topics, string_agg(DISTINCT mode, '|' ORDER BY mode) AS modes FROM fact WHERE assessed GROUP BY ALL"""),
    "j7_due_list": over_fact("""d AS (SELECT user_id, subject_id, question_id, id AS attempt_id, (5 - coalesce(progress_score, 0)) * 2 + missing_count * 2 + incorrect_count * 3
        + CASE WHEN duration_seconds > expected_duration_seconds * 1.25 THEN 1 ELSE 0 END + age / 7 AS p, progress_score AS last_score, age AS age_days FROM fact
        WHERE progress_score IS NULL OR progress_score < 4 OR missing_count > 0 OR incorrect_count > 0 OR age >= 14)
        SELECT * EXCLUDE (p), round(p, 4) AS priority, CAST(row_number() OVER (PARTITION BY user_id, subject_id ORDER BY p DESC, attempt_id) AS INT) AS place FROM d QUALIFY place <= 20"""),
    "j8_latest_attempts": over_fact("""SELECT user_id, subject_id, id, created_at, duration_seconds, question_text, CAST(row_number() OVER (PARTITION BY user_id, subject_id ORDER BY created_at DESC, id DESC) AS INT) AS place FROM fact QUALIFY place <= 20"""),
    "j8_latest_mocks": over_fact("""SELECT user_id, subject_id, session_id, session_mode, created_at, progress_score, CAST(row_number() OVER (PARTITION BY user_id, subject_id ORDER BY created_at DESC, id DESC) AS INT) AS place
        FROM fact WHERE session_mode IN ('subject_simulation', 'multi_subject') QUALIFY place <= 20"""),
    "j10_session_reports": with_views("attempts", f"{REPORTS} SELECT *, coalesce(grade <= 4, false) AS passed FROM reports"),
    "j11_run_reports": with_views("attempts", f"""{REPORTS} SELECT run_id, count(*) AS sessions, CASE WHEN count(grade) = 0 THEN NULL WHEN bool_and(coalesce(grade <= 4, false)) THEN median(grade) ELSE 5.0 END::DOUBLE AS grade FROM reports GROUP BY run_id"""),
    "j12_session_analysis": over_fact("""w AS (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY score, id) AS place FROM fact WHERE assessed AND (score < 4 OR missing_count + incorrect_count > 0) QUALIFY place <= 3),
        i AS (SELECT session_id, string_agg(id::VARCHAR, ',' ORDER BY place) AS improve FROM w GROUP BY ALL)
        SELECT f.*, coalesce(improve, '') AS improve FROM (SELECT session_id, count(*) FILTER (assessed) AS graded, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (NOT assessed AND status <> 'skipped') AS ungraded,
        avg(score) FILTER (assessed) AS mean_score FROM fact GROUP BY ALL) f LEFT JOIN i USING (session_id)"""),
    "j13_pending_runs": with_views("attempts", "SELECT id, run_id, session_id FROM attempts WHERE status = 'pending' AND run_id NOT IN (SELECT run_id FROM attempts WHERE session_id % 13 = 0)"),
    "j14_subject_summary": with_views("questions attempts", "SELECT subject_id, count(*) AS questions, count(*) FILTER (id IN (SELECT question_id FROM attempts WHERE status = 'evaluated' AND score IS NOT NULL)) AS practised FROM questions GROUP BY ALL"),
    "j15_recent_runs": with_views("attempts", "SELECT subject_id, run_id, max(created_at) AS last_at, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY max(created_at) DESC, run_id) AS INT) AS place FROM attempts GROUP BY subject_id, run_id QUALIFY place <= 100"),
    "k3_mastery": over_fact(f"{MASTERY} SELECT * REPLACE (round(time_ratio, 6) AS time_ratio) FROM states"),
}
