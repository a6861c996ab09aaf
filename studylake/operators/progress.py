"""Progress of learners: one fact of attempts, and the aggregates, windows and rankings over it.

All learners and subjects are computed at once; user_id and subject_id are keys of every grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels of session modes, the label of practice outside a session, statuses without a score, the modes
# of mock exams, and the score below which an attempt failed.
MODE_LABELS = {
    "single_question": "Single question", "rapid_practice": "Rapid practice", "random_practice": "Balanced practice", "weak_topic": "Weak-topic practice",
    "oral_exam_simulation": "Oral simulation", "subject_simulation": "Subject simulation", "multi_subject": "Multi-subject exam", "full_colloquium": "Complete Colloquium",
}
INDEPENDENT = "Independent practice"
UNSCORED = ("pending", "needs_review", "skipped")
MOCK_MODES = ("subject_simulation", "multi_subject")
FAILED_BELOW = 3
# Percent thresholds of grades.
GRADES = ((92, 1.0), (87, 1.3), (82, 1.7), (76, 2.0), (71, 2.3), (65, 2.7), (60, 3.0), (55, 3.3), (50, 4.0))
WORST_GRADE = 5.0

KEYS = ["user_id", "subject_id"]


def mode_label(mode: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in MODE_LABELS.items() for x in pair))
    return F.coalesce(labels[mode], F.lit(INDEPENDENT))


def german_grade(percent: Column) -> Column:
    """The grade of a percentage, clamped to 0..100; null stays null."""
    grade = F.when(percent.isNull(), F.lit(None).cast("double"))
    clamped = F.least(F.lit(100.0), F.greatest(F.lit(0.0), percent))
    for least, value in GRADES:
        grade = grade.when(clamped >= least, value)
    return grade.otherwise(WORST_GRADE)


def attempt_fact(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """Attempts with their question's topic and time, the mode's label, and whether they are assessed.

    Skipped attempts count with score 0 (progress_score) but are not assessed.
    """
    q = questions.select(F.col("id").alias("question_id"), F.coalesce("topic_name", F.lit("Unassigned")).alias("topic_name"), "question_text", "expected_duration_seconds")
    return (
        attempts.join(q, "question_id")
        .withColumn("mode", mode_label(F.col("session_mode")))
        .withColumn("assessed", ~F.col("status").isin(*UNSCORED) & F.col("score").isNotNull())
        .withColumn("progress_score", F.when(F.col("status") == "skipped", 0.0).otherwise(F.col("score")))
        .withColumn("day", F.to_date("created_at"))
    )


def totals(fact: DataFrame) -> DataFrame:
    """Counts, scores and times of each learner and subject."""
    scored = F.when(F.col("assessed"), F.col("score"))
    order = F.struct("created_at", "id")
    return fact.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("attempts_count"), F.count_if("assessed").alias("evaluated_count"), F.count_if(F.col("status") == "skipped").alias("skipped_count"),
        F.avg(scored).alias("average_score"), F.max(scored).alias("best_score"), F.max_by("score", F.when(F.col("assessed"), order)).alias("last_score"),
        F.avg("duration_seconds").alias("average_response_seconds"), F.max("created_at").alias("last_practice_at"),
    )


def age_days(now: str) -> Column:
    return F.greatest(F.lit(0), F.expr(f"timestampdiff(DAY, created_at, TIMESTAMP_NTZ '{now}')").cast("int"))


def mastery(fact: DataFrame, keys: list[str], now: str) -> DataFrame:
    """K3: mastery of each group. Weak below 2.5 on average or above one omission an answer; exam-ready needs two recent,
    quick and nearly complete answers of at least 4 and a good mock exam or three answers; else learning."""
    a = F.col("assessed")
    expected = F.greatest(F.lit(1), F.coalesce(F.when(F.col("expected_duration_seconds") != 0, F.col("expected_duration_seconds")), F.lit(60)))
    grouped = fact.groupBy(*keys).agg(
        F.count_if(a).alias("n"), F.avg(F.when(a, F.col("score"))).alias("average"), F.max_by("score", F.when(a, F.struct("created_at", "id"))).alias("latest"),
        F.coalesce(F.sum(F.when(a, F.col("missing_count"))), F.lit(0)).alias("omissions"), F.coalesce(F.sum(F.when(a, F.col("incorrect_count"))), F.lit(0)).alias("incorrect_points"),
        F.avg(F.when(a, F.col("duration_seconds") / expected)).alias("time_ratio"), F.min(F.when(a, age_days(now))).alias("recency_days"),
        F.avg(F.when(a & F.col("session_mode").isin(*MOCK_MODES), F.col("score"))).alias("mock_average"),
    )
    rate = (F.col("omissions") + F.col("incorrect_points")) / F.greatest(F.lit(1), F.col("n"))
    ready = (
        (F.col("n") >= 2) & (F.col("average") >= 4) & (F.col("latest") >= 4) & (rate <= 0.25) & (F.col("time_ratio") <= 1.2)
        & (F.coalesce("recency_days", F.lit(0)) <= 14) & ((F.coalesce("mock_average", F.lit(0)) >= 4) | (F.col("n") >= 3))
    )
    state = F.when(F.col("n") == 0, "not_practised").when((F.col("average") < 2.5) | (rate > 1.0), "weak").when(ready, "exam_ready").otherwise("learning")
    return grouped.withColumn("mastery_state", state)


def topic_rows(fact: DataFrame, now: str) -> DataFrame:
    """Per topic attempts, average and last score, mastery; rank puts weak topics first."""
    states = {"weak": 0, "learning": 1, "exam_ready": 2}
    rank = F.coalesce(F.create_map(*(F.lit(x) for p in states.items() for x in p))[F.col("mastery_state")], F.lit(3))
    counts = fact.groupBy(*KEYS, "topic_name").agg(F.count(F.lit(1)).alias("attempts"))
    graded = mastery(fact, [*KEYS, "topic_name"], now).select(*KEYS, "topic_name", F.col("average").alias("average_score"), F.col("latest").alias("last_score"), "mastery_state")
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy(rank, "topic_name"))
    return counts.join(graded, [*KEYS, "topic_name"]).withColumn("place", place)


def frequent_points(points: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The n most frequent texts of each group, by count, then text."""
    counted = points.groupBy(*keys, "text").agg(F.count(F.lit(1)).alias("times"))
    place = Window.partitionBy(*keys).orderBy(F.desc("times"), "text")
    return counted.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)


def failure_trend(fact: DataFrame) -> DataFrame:
    """Failed attempts of each assessed day in all, by topic, by mode and by both, in one pass of grouping sets.
    Days without a failure stay, with 0."""
    assessed = fact.where("assessed").withColumn("failed", (F.col("score") < FAILED_BELOW).cast("int"))
    day = [F.col(k) for k in (*KEYS, "day")]
    topic, mode = F.col("topic_name"), F.col("mode")
    return assessed.groupingSets([day, [*day, topic], [*day, mode], [*day, mode, topic]], *day, topic, mode).agg(
        F.sum("failed").alias("failed_attempts"), F.grouping("topic_name").cast("int").alias("all_topics"), F.grouping("mode").cast("int").alias("all_modes")
    )


def failure_names(fact: DataFrame) -> DataFrame:
    """Topics and modes among the assessed attempts, sorted."""
    return fact.where("assessed").groupBy(*KEYS).agg(F.array_join(F.sort_array(F.collect_set("topic_name")), "|").alias("topics"), F.array_join(F.sort_array(F.collect_set("mode")), "|").alias("modes"))


def due_list(fact: DataFrame, now: str, n: int = 20) -> DataFrame:
    """Attempts that are due, by priority; a question may come several times, with that attempt's score."""
    score = F.col("progress_score")
    slow = (F.col("duration_seconds") > F.col("expected_duration_seconds") * 1.25).cast("int")
    rows = fact.withColumn("age", age_days(now))
    priority = (5 - F.coalesce(score, F.lit(0.0))) * 2 + F.col("missing_count") * 2 + F.col("incorrect_count") * 3 + slow + F.col("age") / 7
    due = rows.where(score.isNull() | (score < 4) | (F.col("missing_count") > 0) | (F.col("incorrect_count") > 0) | (F.col("age") >= 14))
    due = due.select(*KEYS, "question_id", F.col("id").alias("attempt_id"), priority.alias("priority"), score.alias("last_score"), F.col("age").alias("age_days"))
    place = Window.partitionBy(*KEYS).orderBy(F.desc("priority"), "attempt_id")
    return due.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)


def latest(fact: DataFrame, n: int = 20) -> DataFrame:
    """The last n attempts of each learner and subject; place 1 is the newest."""
    place = Window.partitionBy(*KEYS).orderBy(F.desc("created_at"), F.desc("id"))
    return fact.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)


def latest_mocks(fact: DataFrame, n: int = 20) -> DataFrame:
    return latest(fact.where(F.col("session_mode").isin(*MOCK_MODES)), n)


def session_reports(attempts: DataFrame, keys: tuple[str, ...] = ("run_id", "session_id")) -> DataFrame:
    """Percent and grade of each session; skipped answers count as wrong, pending ones do not count."""
    scored = F.col("score").isNotNull() & ~F.col("status").isin(*UNSCORED, "internal_error")
    grouped = attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("answers"), F.avg(F.when(scored, F.col("score"))).alias("average_score"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.coalesce(F.sum(F.when(scored, F.col("score"))), F.lit(0.0)).alias("points"), F.count_if(scored).alias("scored"),
    )
    percent = F.when(F.col("scored") + F.col("skipped") > 0, F.round(F.col("points") / ((F.col("scored") + F.col("skipped")) * 5) * 100, 1))
    graded = grouped.withColumn("percent_correct", percent).withColumn("grade", german_grade(F.col("percent_correct")))
    return graded.withColumn("passed", F.coalesce(F.col("grade") <= 4.0, F.lit(False))).drop("points", "scored")


def run_reports(reports: DataFrame) -> DataFrame:
    """A run's grade is the median of its sessions' if all are passed, 5.0 if not, null without any grade."""
    grouped = reports.groupBy("run_id").agg(F.count(F.lit(1)).alias("sessions"), F.count("grade").alias("graded"), F.median("grade").alias("median_grade"), F.bool_and("passed").alias("all_passed"))
    grade = F.when(F.col("graded") == 0, F.lit(None).cast("double")).when((F.col("graded") == F.col("sessions")) & F.col("all_passed"), F.col("median_grade")).otherwise(WORST_GRADE)
    return grouped.select("run_id", "sessions", grade.alias("grade"))


def session_analysis(fact: DataFrame, n: int = 3) -> DataFrame:
    """Graded, skipped and ungraded answers of a session, the mean, and its weakest answers."""
    graded = F.col("assessed")
    gaps = F.col("missing_count") + F.col("incorrect_count")
    summary = fact.groupBy("session_id").agg(
        F.count_if(graded).alias("graded"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(~graded & (F.col("status") != "skipped")).alias("ungraded"), F.avg(F.when(graded, F.col("score"))).alias("mean_score")
    )
    weak = fact.where(graded & ((F.col("score") < 4) | (gaps > 0)))
    place = Window.partitionBy("session_id").orderBy("score", "id")
    worst = weak.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n).groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"].cast("string")), ",").alias("improve"))
    return summary.join(worst, "session_id", "left").withColumn("improve", F.coalesce("improve", F.lit("")))


def pending_runs(attempts: DataFrame, open_sessions: Column) -> DataFrame:
    """Attempts to evaluate: pending ones of runs whose sessions are all finished."""
    finished = attempts.groupBy("run_id").agg(F.bool_and(~open_sessions).alias("finished")).where("finished").select("run_id")
    return attempts.where("status = 'pending'").join(finished, "run_id", "left_semi")


def subject_summary(questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Distinct questions of a subject, and those practised."""
    done = attempts.where(~F.col("status").isin(*UNSCORED) & F.col("score").isNotNull()).select(F.col("question_id").alias("id")).distinct().withColumn("done", F.lit(True))
    return questions.join(done, "id", "left").groupBy("subject_id").agg(F.count_distinct("id").alias("questions"), F.count_distinct(F.when(F.col("done"), F.col("id"))).alias("practised"))


def recent_runs(attempts: DataFrame, n: int = 100) -> DataFrame:
    """The latest runs that touch each subject."""
    runs = attempts.groupBy("subject_id", "run_id").agg(F.max("created_at").alias("last_at"))
    return runs.withColumn("place", F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("last_at"), "run_id"))).where(F.col("place") <= n)
