"""The generic tables seen as the study domain's: questions, attempts, units, requests, text lines.

Each view is a projection of one table or a join on keys; nothing is sampled or generated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Session modes dealt to runs by run_id % 9; the ninth stands for practice outside a session.
MODES = ("single_question", "rapid_practice", "random_practice", "weak_topic", "oral_exam_simulation", "subject_simulation", "multi_subject", "full_colloquium")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        (key % 4).alias("subject_id"),
        F.col("p_brand").alias("topic_name"),
        F.concat(F.col("p_size").cast("string"), F.lit(". "), F.col("p_brand"), F.lit(" ("), (key % 3).cast("string"), F.lit(")")).alias("raw_heading"),
        F.lower("p_type").alias("question_type"),
        F.when(F.col("p_size") < 17, "easy").when(F.col("p_size") < 34, "medium").otherwise("hard").alias("difficulty"),
        F.when(key % 3 == 0, "A").when(key % 3 == 1, "B").otherwise("C").alias("priority"),
        (F.col("p_size") * 2 + 30).alias("expected_duration_seconds"),
        ((key % 100).cast("double") / 100).alias("quality_score"),
        F.when(key % 5 == 0, "needs_review").otherwise("accepted").alias("review_status"),
        (key % 11 != 0).alias("enabled"),
        F.when(key % 3 == 0, key % 4 + 1).alias("question_pool_id"),
        (key % 500).alias("evidence_id_1"),
        (key * 7 % 500).alias("evidence_id_2"),
        F.concat(F.lit("What is "), F.col("p_name"), F.lit("?")).alias("question_text"),
    )


def _mode(run: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, name in enumerate(MODES):
        out = F.when(run % 9 == k, name).otherwise(out)
    return out


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    events = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("bigint"))
    events = events.withColumn("run_id", F.col("user_id") * 100 + F.dayofmonth("ts"))
    return events.select(
        F.col("event_id").alias("id"), "user_id", (F.col("k") % 4).alias("subject_id"), F.col("k").alias("question_id"), "run_id",
        (F.col("run_id") * 4 + F.col("k") % 4).alias("session_id"), _mode(F.col("run_id")).alias("session_mode"),
        F.when(kind == "view", "skipped").when(kind == "signup", "pending").when(kind == "error", "needs_review").otherwise("evaluated").alias("status"),
        F.when(kind.isin("click", "purchase"), F.least(F.lit(5.0), F.floor(F.col("value") / 15).cast("double"))).alias("score"),
        (F.col("event_id") % 3).alias("missing_count"), F.when(F.col("event_id") % 7 == 0, 1).otherwise(0).alias("incorrect_count"),
        F.floor("value").cast("int").alias("duration_seconds"), F.col("ts").alias("created_at"),
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a unit; those without a vector have none, and no topic either."""
    e, d, q = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.select("doc_id", "text").join(e, F.col("doc_id") == F.col("vec_id"), "left").join(q, "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 4).alias("subject_id"), (F.col("doc_id") % 50).alias("document_id"), F.col("label").alias("topic_id"),
        (F.col("doc_id") % 7 + 1).alias("source_start"), F.col("text").alias("content"),
        F.when(F.col("quality") == 0, "quarantined").when(F.col("doc_id") % 9 == 0, "needs_review").otherwise("accepted").alias("review_status"),
        F.when(F.col("toxic") == 1, 0.5).otherwise(0.95).alias("confidence"), "embedding",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(turn)).withColumn("output_text", F.lead("text").over(turn))
    return rows.where("role = 'user' AND next_role = 'assistant'").select(
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("request_uuid"), (F.col("conv_id") % 10).alias("user_id"),
        (F.col("conv_id") % 4).alias("subject_id"), "role", F.col("text").alias("input_text"), "output_text", (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        "conv_id", "turn",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of documents, with a blank one after every three; six make a page."""
    spaced = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 2, F.array(x, F.lit(""))).otherwise(F.array(x))))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(spaced).alias("pos", "line"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("line_no"), (F.floor(F.col("pos") / 6).cast("int") + 1).alias("page_number"), "line")


#: The same views for DuckDB, as common table expressions.
SQL = {
    "questions": """questions AS (SELECT p_partkey AS id, p_partkey % 4 AS subject_id, p_brand AS topic_name,
        CONCAT(CAST(p_size AS STRING), '. ', p_brand, ' (', CAST(p_partkey % 3 AS STRING), ')') AS raw_heading, LOWER(p_type) AS question_type,
        CASE WHEN p_size < 17 THEN 'easy' WHEN p_size < 34 THEN 'medium' ELSE 'hard' END AS difficulty,
        CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS priority, 30 + p_size * 2 AS expected_duration_seconds,
        CAST(p_partkey % 100 AS DOUBLE) / 100 AS quality_score, CASE WHEN p_partkey % 5 = 0 THEN 'needs_review' ELSE 'accepted' END AS review_status,
        p_partkey % 11 <> 0 AS enabled, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 4 + 1 END AS question_pool_id,
        p_partkey % 500 AS evidence_id_1, (p_partkey * 7) % 500 AS evidence_id_2, CONCAT('What is ', p_name, '?') AS question_text FROM part)""",
    "attempts": """attempts AS (SELECT event_id AS id, user_id, k % 4 AS subject_id, k AS question_id, user_id * 100 + DAY(ts) AS run_id,
        (user_id * 100 + DAY(ts)) * 4 + k % 4 AS session_id, CASE (user_id * 100 + DAY(ts)) % 9 WHEN 0 THEN 'single_question' WHEN 1 THEN 'rapid_practice'
        WHEN 2 THEN 'random_practice' WHEN 3 THEN 'weak_topic' WHEN 4 THEN 'oral_exam_simulation' WHEN 5 THEN 'subject_simulation'
        WHEN 6 THEN 'multi_subject' WHEN 7 THEN 'full_colloquium' END AS session_mode,
        CASE event_type WHEN 'view' THEN 'skipped' WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'needs_review' ELSE 'evaluated' END AS status,
        CASE WHEN event_type IN ('click', 'purchase') THEN LEAST(CAST(5 AS DOUBLE), CAST(FLOOR(value / 15) AS DOUBLE)) END AS score,
        event_id % 3 AS missing_count, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS incorrect_count, CAST(FLOOR(value) AS INT) AS duration_seconds, ts AS created_at
        FROM (SELECT *, CAST(REGEXP_EXTRACT(props, '[0-9]+', 0) AS BIGINT) AS k FROM events) e)""",
    "units": """units AS (SELECT d.doc_id AS id, d.doc_id % 4 AS subject_id, d.doc_id % 50 AS document_id, e.label AS topic_id, d.doc_id % 7 + 1 AS source_start,
        d.text AS content, CASE WHEN l.quality = 0 THEN 'quarantined' WHEN d.doc_id % 9 = 0 THEN 'needs_review' ELSE 'accepted' END AS review_status,
        CASE WHEN l.toxic = 1 THEN 0.5 ELSE 0.95 END::DOUBLE AS confidence, e.embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "requests": """requests AS (SELECT * FROM (SELECT CONCAT(CAST(conv_id AS STRING), ':', CAST(turn AS STRING)) AS request_uuid, conv_id % 10 AS user_id, conv_id % 4 AS subject_id,
        role, text AS input_text, LEAD(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, LEAD(text) OVER (PARTITION BY conv_id ORDER BY turn) AS output_text,
        conv_id * 100 + turn AS id, conv_id, turn FROM conversations) t WHERE role = 'user' AND next_role = 'assistant')""",
    "lines": """lines AS (SELECT doc_id, pos AS line_no, CAST(FLOOR((pos - 1) / 6) AS INT) + 1 AS page_number, line
        FROM (SELECT doc_id, UNNEST(spaced) AS line, generate_subscripts(spaced, 1) AS pos FROM
        (SELECT doc_id, flatten(list_transform(string_split(text, CHR(10)), lambda x, i: CASE WHEN i % 3 = 0 THEN [x, ''] ELSE [x] END)) AS spaced FROM documents)))""",
}


def with_views(names: str, body: str) -> str:
    """`body` (a query, or more common table expressions and a query) over the named views."""
    views = ", ".join(SQL[n] for n in names.split())
    return f"WITH {views}{', ' if ' AS (' in body.split('SELECT')[0] else ' '}{body}"
