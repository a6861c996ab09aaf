"""Queries L1-L7, G6 and M1-M11 over the adapter views, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planning as L
from ..operators import progress as P
from ..operators import topics as D
from ..operators import usage as M
from .quality import points_sql
from ..sources.adapters import attempts, questions, requests, table, units, with_views
from .progress import MASTERY, NOW, fact, over_fact

TODAY, EXAM = "2024-01-30", "2024-02-20"


def active_units(s, d):
    return units(s, d).where("review_status = 'accepted'")


def no_pools(s, d):
    """Pools that are disabled: the second."""
    return s.range(1).select(F.lit(2).cast("bigint").alias("pool_id"))


def eligible(s, d):
    return L.eligible(questions(s, d), active_units(s, d), no_pools(s, d))


def loads(s, d):
    return L.workload(fact(s, d), eligible(s, d), TODAY, EXAM)


def _rank(df, order):
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*P.KEYS).orderBy(*order)))


def _plan(s, d):
    from .questions import titled_units

    f = fact(s, d)
    learners = f.select(*P.KEYS).distinct()
    cards = questions(s, d).where("question_pool_id IS NOT NULL AND review_status = 'accepted' AND priority = 'A' AND difficulty = 'hard'")
    cards = cards.withColumn("reliability", F.when(F.col("id") % 2 == 1, "current").when(F.col("id") % 3 == 0, "inferred"))
    pack = learners.where("subject_id <> 1").select("subject_id").distinct().select("subject_id", F.lit("Review and accept the generated exam pack").alias("action"), F.lit(1).alias("rank"))
    weak = _rank(P.topic_rows(f, NOW).where("mastery_state = 'weak'").withColumn("action", F.concat(F.lit("Practice "), "topic_name")), ["place"])
    due = P.due_list(f, NOW, L.DUE_QUESTIONS).select(*P.KEYS, "question_id", F.col("priority").alias("urgency"), F.col("place").alias("rank"))
    due = due.join(questions(s, d).select(F.col("id").alias("question_id"), F.col("question_text").alias("action")), "question_id")
    states = F.create_map(*(F.lit(x) for p in D.STATE_ORDER.items() for x in p))
    material = D.material_coverage(titled_units(s, d), ["subject_id", "title"]).withColumn("state_rank", states[F.col("material_state")])
    return L.study_plan(learners, L.reported_cards(cards), pack, weak, due, L.thin_topics(material)).select(*P.KEYS, "action", "priority", "place")


def _cards(s, d):
    q = questions(s, d).where("difficulty = 'hard'")
    points = q.select(F.col("id").alias("question_id"), F.posexplode(F.array("evidence_id_1", "evidence_id_2")).alias("k", "unit_id")).withColumn("text", F.concat(F.lit("Point "), F.col("k").cast("string"), F.lit(".")))
    return L.answer_cards(points, active_units(s, d))


def asked(s, d):
    """Requests with a type and a duration made of their texts."""
    kind = F.element_at(F.array(F.lit("ask"), F.lit("explain"), F.lit("quiz")), (F.length("input_text") % 3 + 1).cast("int"))
    return requests(s, d).withColumn("request_type", kind).withColumn("duration_ms", F.length("output_text") * 3)


def quizzes(s, d):
    return attempts(s, d).where("score IS NOT NULL").select("id", "user_id", "session_id", "score", "created_at", (F.col("missing_count") == 0).alias("correct"), (F.col("score") / 5).alias("similarity"))


def cited(s, d):
    return requests(s, d).select("user_id", F.col("id").alias("request_id"), (F.col("conv_id") % 50).alias("document_id"), (F.col("turn") % 7 + 1).alias("page"))


def users(s, d):
    return table(s, d, "conversations").select((F.col("conv_id") % 12).alias("user_id")).distinct().withColumn("name", F.concat(F.lit("user "), F.col("user_id").cast("string")))


def answered(s, d):
    """Requests whose answers cite the units that their numbers name."""
    marks = F.concat(F.col("output_text"), F.lit(" [E"), (F.col("conv_id") % 500).cast("string"), F.lit("] [E"), (F.col("id") % 700).cast("string"), F.lit("]"))
    return requests(s, d).withColumn("output_text", marks).withColumn("request_type", F.when(F.col("conv_id") % 6 == 5, "quiz").otherwise("ask"))


def stored_cards(s, d):
    return requests(s, d).where("conv_id % 3 = 0").select(F.col("id").alias("request_id"), F.when(F.col("conv_id") % 2 == 0, "accepted").otherwise("needs_review").alias("status"))


def calls(s, d):
    rows = table(s, d, "events")
    return rows.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), (F.col("event_type") == "view").alias("cached"), F.floor(F.col("value") * 10).alias("latency_ms"), F.floor("value").alias("prompt_tokens"), (F.col("value") / 2).alias("tokens_per_second"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"))


QUERIES = {
    "g6_eligible_questions": lambda s, d: eligible(s, d).select("id", "subject_id", "topic_name"),
    "l1_learning_rows": lambda s, d: L.learning_rows(questions(s, d), eligible(s, d), fact(s, d)),
    "l2_activity": lambda s, d: L.activity(fact(s, d), TODAY).withColumn("day", F.col("day").cast("string")),
    "l3_streaks": lambda s, d: L.streaks(fact(s, d), TODAY),
    "l4_workload": loads,
    "l5_schedule": lambda s, d: L.schedule(loads(s, d), TODAY).withColumn("day", F.col("day").cast("string")),
    "l6_study_plan": _plan,
    "l7_answer_cards": _cards,
    "m1_requests_per_user": lambda s, d: M.requests_per_user(users(s, d), requests(s, d)),
    "m2_latest_requests": lambda s, d: M.latest_requests(requests(s, d), users(s, d)).select("id", "user_id", "name", "input_text"),
    "m3_top_questions": lambda s, d: M.top_counts(requests(s, d), ["input_text"], 10),
    "m3_top_user_questions": lambda s, d: M.top_counts(requests(s, d), ["user_id", "input_text"], 30),
    "m3_top_sources": lambda s, d: M.top_counts(cited(s, d), ["document_id", "page"], 10),
    "m4_feedback": lambda s, d: M.feedback_counts(requests(s, d).select("user_id", (F.length("output_text") % 3 - 1).alias("rating"))),
    "m5_user_totals": lambda s, d: M.user_totals(asked(s, d), quizzes(s, d)),
    "m6_user_sources": lambda s, d: M.user_sources(cited(s, d)),
    "m6_user_activity": lambda s, d: M.user_activity(attempts(s, d), TODAY).withColumn("day", F.col("day").cast("string")),
    "m6_latest_scores": lambda s, d: M.latest_scores(quizzes(s, d)),
    "m7_history": lambda s, d: M.history(requests(s, d), stored_cards(s, d), cited(s, d), "THE"),
    "m8_review_cards": lambda s, d: M.review_cards(answered(s, d), active_units(s, d), stored_cards(s, d)).withColumn("rubric", F.array_join("rubric", "~")).withColumn("evidence_ids", F.array_join(F.transform("evidence_ids", lambda x: x.cast("string")), ",")),
    "m9_citation_links": lambda s, d: M.citation_links(requests(s, d).select(F.col("id").alias("request_id"), "subject_id", F.concat(F.lit("E"), (F.col("conv_id") % 600).cast("string")).alias("marker")), units(s, d)),
    "m10_inference_metrics": lambda s, d: M.inference_metrics(calls(s, d)).withColumn("tokens_per_second", F.round("tokens_per_second", 9)),
    "m11_quiz_scores": lambda s, d: M.quiz_scores(quizzes(s, d)).withColumn("similarity", F.round("similarity", 9)),
}

ELIGIBLE = """active AS (SELECT id, subject_id, source_start FROM units WHERE review_status = 'accepted'), eligible AS (SELECT * FROM questions WHERE review_status = 'accepted' AND enabled
    AND coalesce(question_pool_id, 0) <> 2 AND (question_pool_id IS NOT NULL OR (evidence_id_1 IN (SELECT id FROM active) AND evidence_id_2 IN (SELECT id FROM active))))"""
LOADS = f"""loads AS (SELECT *, greatest(0, today_target - today_completed) AS today_remaining FROM (SELECT *, CASE WHEN study_days > 0 THEN CAST(ceil((remaining + today_completed) / study_days) AS BIGINT) ELSE least(remaining + today_completed, 10) END AS today_target FROM (
    SELECT u.user_id, u.subject_id, coalesce(e.n, 0) AS eligible_questions, CAST(coalesce(c.completed, 0) AS BIGINT) AS completed, date_diff('day', DATE '{TODAY}', DATE '{EXAM}') AS days_left, date_diff('day', DATE '{TODAY}', DATE '{EXAM}') + 1 AS study_days,
    coalesce(e.n, 0) * 3 AS total, CAST(coalesce(e.n, 0) * 3 - coalesce(c.completed, 0) AS BIGINT) AS remaining, CAST(coalesce(c.completed - c.before, 0) AS BIGINT) AS today_completed
    FROM (SELECT DISTINCT user_id, subject_id FROM fact) u LEFT JOIN (SELECT subject_id, count(*) AS n FROM eligible GROUP BY ALL) e USING (subject_id)
    LEFT JOIN (SELECT user_id, subject_id, sum(least(n, 3)) AS completed, sum(least(b, 3)) AS before FROM (SELECT user_id, subject_id, question_id, count(*) AS n, count(*) FILTER (day < DATE '{TODAY}') AS b
    FROM fact WHERE assessed AND question_id IN (SELECT id FROM eligible) GROUP BY ALL) GROUP BY ALL) c USING (user_id, subject_id))))"""


def _over(views: str, body: str) -> str:
    """Over the fact and more views."""
    from ..sources.adapters import SQL

    start = over_fact(body)
    return start.replace("WITH ", "WITH " + "".join(SQL[v] + ", " for v in views.split()), 1)


_CITED = "cited AS (SELECT user_id, id AS request_id, conv_id % 50 AS document_id, turn % 7 + 1 AS page FROM requests)"
_USERS = "users AS (SELECT DISTINCT conv_id % 12 AS user_id, 'user ' || (conv_id % 12) AS name FROM conversations)"
_QUIZ = "quizzes AS (SELECT id, user_id, session_id, score, created_at, missing_count = 0 AS correct, score / 5 AS similarity FROM attempts WHERE score IS NOT NULL)"
_CARDS = "cards AS (SELECT id AS request_id, CASE WHEN conv_id % 2 = 0 THEN 'accepted' ELSE 'needs_review' END AS status FROM requests WHERE conv_id % 3 = 0)"

ORACLE_SQL = {
    "g6_eligible_questions": with_views("questions units", f"{ELIGIBLE} SELECT id, subject_id, topic_name FROM eligible"),
    "l1_learning_rows": _over("units", f"""{ELIGIBLE}, t AS (SELECT subject_id, topic_name, count(*) AS questions, count(*) FILTER (id IN (SELECT id FROM eligible)) AS available FROM questions GROUP BY ALL),
        a AS (SELECT user_id, subject_id, topic_name, count(DISTINCT question_id) AS practised, count(*) AS attempts, avg(score) AS average FROM fact WHERE assessed GROUP BY ALL)
        SELECT u.user_id, subject_id, topic_name, questions, available, coalesce(practised, 0) AS practised, coalesce(attempts, 0) AS attempts, round_even(average * 20, 0) AS score_percent
        FROM (SELECT DISTINCT user_id, subject_id FROM fact) u JOIN t USING (subject_id) LEFT JOIN a USING (user_id, subject_id, topic_name)"""),
    "l2_activity": over_fact(f"""c AS (SELECT DISTINCT user_id, subject_id, unnest(generate_series(DATE '{TODAY}' - 13, DATE '{TODAY}', INTERVAL 1 DAY))::DATE AS day FROM fact)
        SELECT c.user_id, c.subject_id, CAST(c.day AS VARCHAR) AS day, count(f.id) AS answers FROM c LEFT JOIN (SELECT * FROM fact WHERE assessed) f USING (user_id, subject_id, day) GROUP BY ALL"""),
    "l3_streaks": over_fact(f"""d AS (SELECT DISTINCT user_id, subject_id, day FROM fact WHERE assessed AND day <= DATE '{TODAY}'),
        g AS (SELECT user_id, subject_id, day, day - CAST(row_number() OVER (PARTITION BY user_id, subject_id ORDER BY day) AS INT) AS island FROM d),
        r AS (SELECT user_id, subject_id, count(*) AS n, max(day) AS last FROM g GROUP BY user_id, subject_id, island)
        SELECT u.user_id, u.subject_id, coalesce(max(n), 0) AS streak FROM (SELECT DISTINCT user_id, subject_id FROM fact) u LEFT JOIN (SELECT * FROM r WHERE last >= DATE '{TODAY}' - 1) r USING (user_id, subject_id) GROUP BY ALL"""),
    "l4_workload": _over("units", f"{ELIGIBLE}, {LOADS} SELECT * FROM loads"),
    "l5_schedule": _over("units", f"""{ELIGIBLE}, {LOADS}, i AS (SELECT *, unnest(range(0, least(study_days, 14))) AS i, greatest(0, remaining - today_remaining) AS ahead, greatest(1, study_days - 1) AS later FROM loads),
        a AS (SELECT user_id, subject_id, i, CAST(CASE WHEN i = 0 THEN today_remaining ELSE ahead // later + CASE WHEN i <= ahead % later THEN 1 ELSE 0 END END AS BIGINT) AS questions FROM i)
        SELECT user_id, subject_id, CAST(DATE '{TODAY}' + CAST(i AS INT) AS VARCHAR) AS day, questions, CAST(ceil(questions / 10) AS BIGINT) AS sessions FROM a"""),
    "l7_answer_cards": with_views("questions units", f"""{ELIGIBLE}, p AS (SELECT id AS question_id, 0 AS k, evidence_id_1 AS unit_id FROM questions WHERE difficulty = 'hard' UNION ALL SELECT id, 1, evidence_id_2 FROM questions WHERE difficulty = 'hard'),
        m AS (SELECT p.*, a.id AS known, source_start FROM p LEFT JOIN active a ON a.id = p.unit_id)
        SELECT question_id, string_agg(trim('Point ' || k || '. ' || coalesce('[E' || known || ']', '')), ' ' ORDER BY k) AS answer,
        array_to_string(list_transform(list_sort(list_distinct(list((known, source_start)) FILTER (known IS NOT NULL))), lambda x: 'E' || x[1] || '@' || x[2]), ',') AS sources FROM m GROUP BY question_id HAVING count(known) > 0"""),
    "m1_requests_per_user": with_views("requests", f"{_USERS} SELECT u.user_id, count(r.id) AS requests FROM users u LEFT JOIN requests r USING (user_id) GROUP BY ALL"),
    "m2_latest_requests": with_views("requests", f"{_USERS} SELECT id, user_id, name, input_text FROM requests JOIN users USING (user_id) ORDER BY id DESC LIMIT 20"),
    "m3_top_questions": with_views("requests", "SELECT input_text, count(*) AS times FROM requests GROUP BY ALL ORDER BY times DESC, input_text LIMIT 10"),
    "m3_top_user_questions": with_views("requests", "SELECT user_id, input_text, count(*) AS times FROM requests GROUP BY ALL ORDER BY times DESC, user_id, input_text LIMIT 30"),
    "m3_top_sources": with_views("requests", f"{_CITED} SELECT document_id, page, count(*) AS times FROM cited GROUP BY ALL ORDER BY times DESC, document_id, page LIMIT 10"),
    "m4_feedback": with_views("requests", "SELECT user_id, count(*) FILTER (length(output_text) % 3 = 2) AS likes, count(*) FILTER (length(output_text) % 3 = 0) AS dislikes FROM requests GROUP BY ALL"),
    "m5_user_totals": with_views("requests attempts", f"""{_QUIZ}, t AS (SELECT user_id, ['ask', 'explain', 'quiz'][length(input_text) % 3 + 1] AS kind, length(output_text) * 3 AS ms FROM requests),
        f AS (SELECT user_id, kind AS favourite FROM t GROUP BY user_id, kind QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, kind) = 1)
        SELECT t.user_id, t.requests, t.average_ms, f.favourite, coalesce(q.quizzes, 0) AS quizzes, q.average_score, q.best_score FROM (SELECT user_id, count(*) AS requests, avg(ms) AS average_ms FROM t GROUP BY ALL) t JOIN f USING (user_id)
        LEFT JOIN (SELECT user_id, count(*) AS quizzes, avg(score) AS average_score, max(score) AS best_score FROM quizzes GROUP BY ALL) q USING (user_id)"""),
    "m6_user_sources": with_views("requests", f"""{_CITED} SELECT user_id, document_id, page, count(*) AS times, CAST(row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, document_id, page) AS INT) AS place FROM cited GROUP BY user_id, document_id, page QUALIFY place <= 8"""),
    "m6_user_activity": with_views("attempts", f"SELECT user_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS events FROM attempts WHERE CAST(created_at AS DATE) BETWEEN DATE '{TODAY}' - 13 AND DATE '{TODAY}' GROUP BY ALL"),
    "m6_latest_scores": with_views("attempts", f"""{_QUIZ}, l AS (SELECT user_id, id, score, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS p FROM quizzes QUALIFY p <= 8)
        SELECT user_id, id, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY p DESC) AS INT) AS place FROM l"""),
    "m7_history": with_views("requests", f"""{_CITED}, {_CARDS} SELECT r.id, r.user_id, r.subject_id, coalesce(c.status, 'none') AS card_status, document_id || ':' || page AS sources FROM requests r LEFT JOIN cards c ON c.request_id = r.id
        JOIN cited s ON s.request_id = r.id WHERE contains(lower(input_text), 'the') OR contains(lower(output_text), 'the')"""),
    "m8_review_cards": with_views("requests units", f"""{_CARDS}, w AS (SELECT id, subject_id, conv_id % 500 AS a, id % 700 AS b, output_text || ' [E' || (conv_id % 500) || '] [E' || (id % 700) || ']' AS answer
            FROM requests WHERE conv_id % 6 <> 5 AND trim(input_text) <> '' AND id NOT IN (SELECT request_id FROM cards WHERE status <> 'needs_review')),
        e AS (SELECT w.id, u.id AS unit_id FROM w JOIN units u ON u.subject_id = w.subject_id AND (u.id = w.a OR u.id = w.b) WHERE u.review_status = 'accepted'),
        g AS (SELECT id, string_agg(unit_id::VARCHAR, ',' ORDER BY unit_id) AS evidence_ids FROM e GROUP BY ALL)
        SELECT w.id AS request_id, subject_id, coalesce(evidence_ids, '') AS evidence_ids, CASE WHEN evidence_ids IS NULL THEN '' ELSE array_to_string({points_sql("answer")}, '~') END AS rubric,
        CASE WHEN evidence_ids IS NULL THEN 0.25 ELSE 0.7 END::DOUBLE AS quality_score, 'needs_review' AS status FROM w LEFT JOIN g USING (id)"""),
    "m9_citation_links": with_views("requests units", "SELECT r.id AS request_id, r.subject_id, 'E' || (conv_id % 600) AS marker, u.id AS linked_unit_id FROM requests r LEFT JOIN units u ON u.id = conv_id % 600 AND u.subject_id = r.subject_id AND u.review_status = 'accepted'"),
    "m10_inference_metrics": """WITH l AS (SELECT *, event_type = 'view' AS cached FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) SELECT count(*) AS requests, avg(floor(value * 10)) FILTER (NOT cached) AS average_latency_ms,
        round(avg(value / 2) FILTER (NOT cached), 9) AS tokens_per_second, avg(floor(value)) FILTER (NOT cached) AS average_prompt_tokens, (count(*) FILTER (cached)) * 100 / count(*) AS cache_hit_rate,
        'm' || (arg_max(user_id, (ts, event_id)) % 3) AS current_model FROM l""",
    "m11_quiz_scores": with_views("attempts", f"{_QUIZ} SELECT session_id, count(*) AS answers, round(avg(similarity), 9) AS similarity, avg(correct::INT) AS correctness FROM quizzes GROUP BY ALL"),
}


def plan_sql() -> str:
    """L6; its material comes from the queries on topics, which import this module."""
    from .questions import _TITLE, material_sql

    body = material_sql(f"u AS (SELECT *, {_TITLE} AS title FROM units)")
    return _over("units", f"""{MASTERY}, {body}, ranked AS (SELECT * FROM states), learners AS (SELECT DISTINCT user_id, subject_id FROM fact),
        d AS (SELECT user_id, subject_id, question_id, id AS attempt_id, (5 - coalesce(progress_score, 0)) * 2 + missing_count * 2 + incorrect_count * 3
        + CASE WHEN duration_seconds > expected_duration_seconds * 1.25 THEN 1 ELSE 0 END + age / 7 AS p, question_text FROM fact
        WHERE progress_score IS NULL OR progress_score < 4 OR missing_count > 0 OR incorrect_count > 0 OR age >= 14),
        thin AS (SELECT subject_id, title, row_number() OVER (PARTITION BY subject_id ORDER BY list_position(['conflicting', 'needs_review', 'missing', 'partial'], material_state), lower(title), title) AS rank FROM material
        WHERE material_state IN ('partial', 'missing', 'needs_review', 'conflicting') QUALIFY rank <= 3),
        b AS (SELECT user_id, subject_id, question_text AS action, CASE WHEN id % 2 = 1 THEN 110 ELSE 100 END AS priority, 0 AS branch, row_number() OVER (PARTITION BY user_id, subject_id ORDER BY id % 2 DESC, quality_score DESC, id) AS rank
        FROM learners JOIN questions USING (subject_id) WHERE question_pool_id IS NOT NULL AND review_status = 'accepted' AND priority = 'A' AND difficulty = 'hard' QUALIFY rank <= 6
        UNION ALL SELECT user_id, subject_id, 'Review and accept the generated exam pack', 100, 1, 1 FROM learners WHERE subject_id <> 1
        UNION ALL SELECT user_id, subject_id, 'Practice ' || topic_name, 90, 2, row_number() OVER (PARTITION BY user_id, subject_id ORDER BY topic_name) AS rank FROM ranked WHERE mastery_state = 'weak' QUALIFY rank <= 4
        UNION ALL SELECT user_id, subject_id, question_text, CAST(80 + least(9, floor(p)) AS INT), 3, row_number() OVER (PARTITION BY user_id, subject_id ORDER BY p DESC, attempt_id) AS rank FROM d QUALIFY rank <= 4
        UNION ALL SELECT user_id, subject_id, 'Improve material coverage for ' || title, 65, 4, rank FROM learners JOIN thin USING (subject_id)),
        o AS (SELECT * FROM b UNION ALL SELECT user_id, subject_id, 'Run a timed exam simulation', 50, 5, 1 FROM learners WHERE (user_id, subject_id) NOT IN (SELECT (user_id, subject_id) FROM b))
        SELECT user_id, subject_id, action, CAST(priority AS INT) AS priority, CAST(row_number() OVER (PARTITION BY user_id, subject_id ORDER BY priority DESC, branch, rank) AS INT) AS place FROM o QUALIFY place <= 8""")
