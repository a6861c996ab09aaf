"""Usage of the system: requests, feedback, quizzes, history, inference metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def _first(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def requests_per_user(users: DataFrame, requests: DataFrame) -> DataFrame:
    """M1: requests of each user, zeros included."""
    return users.join(requests.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("requests"))


def latest_requests(requests: DataFrame, users: DataFrame, n: int = 20) -> DataFrame:
    """M2: the latest n requests with their users' names."""
    return requests.join(users, "user_id").orderBy(F.desc("id")).limit(n)


def top_counts(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """M3: the n most frequent values of the keys, by count, then value. Spark keeps n rows a task for this."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), *keys).limit(n)


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """M4: likes and dislikes."""
    return feedback.groupBy("user_id").agg(F.count_if(F.col("rating") > 0).alias("likes"), F.count_if(F.col("rating") < 0).alias("dislikes"))


def user_totals(requests: DataFrame, quizzes: DataFrame) -> DataFrame:
    """M5: requests, mean time, quizzes, scores and favourite type (the most frequent, the first name among equals)."""
    asked = requests.groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.avg("duration_ms").alias("average_ms"))
    kinds = requests.groupBy("user_id", "request_type").agg(F.count(F.lit(1)).alias("n"))
    liked = _first(kinds, ["user_id"], [F.desc("n"), "request_type"], 1).select("user_id", F.col("request_type").alias("favourite"))
    scored = quizzes.groupBy("user_id").agg(F.count(F.lit(1)).alias("quizzes"), F.avg("score").alias("average_score"), F.max("score").alias("best_score"))
    return asked.join(liked, "user_id").join(scored, "user_id", "left").withColumn("quizzes", F.coalesce("quizzes", F.lit(0)))


def user_sources(cited: DataFrame, n: int = 8) -> DataFrame:
    """M6: the n most used sources of each user."""
    counted = cited.groupBy("user_id", "document_id", "page").agg(F.count(F.lit(1)).alias("times"))
    return _first(counted, ["user_id"], [F.desc("times"), "document_id", "page"], n)


def user_activity(events: DataFrame, today: str, days: int = 14) -> DataFrame:
    """M6: events of each user on each of the last days; the first day counts whole."""
    first = F.date_sub(F.to_date(F.lit(today)), days - 1)
    return events.withColumn("day", F.to_date("created_at")).where((F.col("day") >= first) & (F.col("day") <= F.to_date(F.lit(today)))).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("events"))


def latest_scores(quizzes: DataFrame, n: int = 8) -> DataFrame:
    """M6: the last n quiz scores of each user, the oldest at place 1."""
    last = _first(quizzes, ["user_id"], [F.desc("created_at"), F.desc("id")], n)
    oldest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("place")))
    return last.select("user_id", "id", "score", oldest.alias("place"))


def history(requests: DataFrame, cards: DataFrame, cited: DataFrame, text: str) -> DataFrame:
    """M7: conversations that hold the text in question or answer, any case, with card status and sources."""
    low = text.lower()
    found = requests.where(F.contains(F.lower("input_text"), F.lit(low)) | F.contains(F.lower("output_text"), F.lit(low)))
    sources = cited.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("document_id", "page"))), lambda x: F.concat_ws(":", x["document_id"], x["page"])), ",").alias("sources"))
    rows = found.join(cards.select(F.col("request_id").alias("id"), "status"), "id", "left").join(sources.withColumnRenamed("request_id", "id"), "id", "left")
    return rows.select("id", "user_id", "subject_id", F.coalesce("status", F.lit("none")).alias("card_status"), F.coalesce("sources", F.lit("")).alias("sources"))


def review_cards(requests: DataFrame, active_units: DataFrame, existing: DataFrame) -> DataFrame:
    """M8: a review card for each request of the type `ask` with a non-empty question that has none, or whose card still
    needs review.

    Evidence is what the answer cites and is accepted in the subject; quality 0.7 with evidence, 0.25 without. With
    evidence the answer's sentences are drafted as rubric.
    """
    settled = existing.where("status <> 'needs_review'").select(F.col("request_id").alias("id"))
    fresh = requests.where((F.col("request_type") == "ask") & (F.length(F.trim("input_text")) > 0)).join(settled, "id", "left_anti")
    cites = fresh.select("id", "subject_id", F.explode(F.array_distinct(F.regexp_extract_all("output_text", F.lit(r"\[E(\d+)\]"), F.lit(1)))).alias("c")).select("id", "subject_id", F.col("c").cast("bigint").alias("unit_id"))
    known = cites.join(active_units.select(F.col("id").alias("unit_id"), "subject_id"), ["unit_id", "subject_id"])
    evidence = known.groupBy("id").agg(F.array_sort(F.collect_set("unit_id")).alias("evidence_ids"))
    cards = fresh.join(evidence, "id", "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<bigint>")))
    grounded = F.size("evidence_ids") > 0
    return cards.select(
        F.col("id").alias("request_id"), "subject_id", "evidence_ids", F.when(grounded, X.draft_points(F.col("output_text"))).otherwise(F.array().cast("array<string>")).alias("rubric"),
        F.when(grounded, 0.7).otherwise(0.25).alias("quality_score"), F.lit("needs_review").alias("status"),
    )


def citation_links(markers: DataFrame, units: DataFrame) -> DataFrame:
    """M9: markers E<id> linked to the unit, if it is accepted in the same subject; else null."""
    unit = F.expr("try_cast(regexp_extract(marker, '^E([0-9]+)$', 1) as bigint)")
    active = units.where("review_status = 'accepted'").select(F.col("id").alias("unit_id"), "subject_id", F.col("id").alias("linked_unit_id"))
    return markers.withColumn("unit_id", unit).join(active, ["unit_id", "subject_id"], "left").select("request_id", "subject_id", "marker", "linked_unit_id")


def inference_metrics(metrics: DataFrame, n: int = 500) -> DataFrame:
    """Means over those of the last n calls that were not cached, the share of cached ones in percent, and the model
    of the last call. What a call does not tell counts as zero."""
    last = metrics.orderBy(F.desc("created_at"), F.desc("id")).limit(n)

    def mean(name: str) -> Column:
        return F.coalesce(F.avg(F.when(~F.col("cached"), F.coalesce(F.col(name), F.lit(0)))), F.lit(0.0))

    return last.agg(
        F.count(F.lit(1)).alias("requests"), mean("latency_ms").alias("average_latency_ms"), mean("tokens_per_second").alias("tokens_per_second"),
        mean("prompt_tokens").alias("average_prompt_tokens"), F.coalesce(F.count_if("cached") * 100 / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("cache_hit_rate"),
        F.max_by("model", F.struct("created_at", "id")).alias("current_model"),
    )


def quiz_scores(answers: DataFrame) -> DataFrame:
    """Means of similarity and correctness of each quiz session."""
    return answers.groupBy("session_id").agg(F.count(F.lit(1)).alias("answers"), F.avg("similarity").alias("similarity"), F.avg(F.col("correct").cast("int")).alias("correctness"))
