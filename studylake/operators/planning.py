"""Learning overviews, daily activity, streaks, workloads, schedules and study plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .progress import KEYS

# A goal's default repetitions and questions a session, days of activity and of a schedule.
REPETITIONS, PER_SESSION, ACTIVITY_DAYS, SCHEDULE_DAYS = 3, 10, 14, 14


def eligible(questions: DataFrame, active_units: DataFrame, disabled_pools: DataFrame) -> DataFrame:
    """Accepted, enabled questions of pools that are not disabled, with current evidence: an imported pool, or at
    least one evidence id and all of them active."""
    evidence = F.array_compact(F.array("evidence_id_1", "evidence_id_2"))
    ids = questions.select("id", F.explode(evidence).alias("unit_id"))
    active = active_units.select(F.col("id").alias("unit_id")).distinct().withColumn("active", F.lit(True))
    current = ids.join(active, "unit_id", "left").groupBy("id").agg(F.bool_and(F.coalesce("active", F.lit(False))).alias("current"))
    usable = questions.where("review_status = 'accepted' AND enabled").join(disabled_pools.select(F.col("pool_id").alias("question_pool_id")), "question_pool_id", "left_anti")
    return usable.join(current, "id", "left").where(F.col("question_pool_id").isNotNull() | F.coalesce("current", F.lit(False))).drop("current")


def learning_rows(questions: DataFrame, eligible_ids: DataFrame, fact: DataFrame) -> DataFrame:
    """L1: questions, available, practised, attempts and score percent of each topic for each learner of its subject."""
    usable = eligible_ids.select("id").distinct().withColumn("usable", F.lit(True))
    topics = questions.join(usable, "id", "left").groupBy("subject_id", "topic_name").agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.coalesce("usable", F.lit(False))).alias("available"))
    done = fact.where("assessed").groupBy(*KEYS, "topic_name").agg(F.count_distinct("question_id").alias("practised"), F.count(F.lit(1)).alias("attempts"), F.avg("score").alias("average"))
    learners = fact.select(*KEYS).distinct()
    rows = learners.join(topics, "subject_id").join(done, [*KEYS, "topic_name"], "left")
    return rows.select(
        *KEYS, "topic_name", "questions", "available", F.coalesce("practised", F.lit(0)).alias("practised"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.bround(F.col("average") * 20).alias("score_percent")
    )


def activity(fact: DataFrame, today: str, days: int = ACTIVITY_DAYS) -> DataFrame:
    """L2: assessed answers of each of the last days, zeros included."""
    counted = fact.where("assessed").groupBy(*KEYS, "day").agg(F.count(F.lit(1)).alias("answers"))
    end = F.to_date(F.lit(today))
    calendar = fact.select(*KEYS).distinct().withColumn("day", F.explode(F.sequence(F.date_sub(end, days - 1), end)))
    return calendar.join(counted, [*KEYS, "day"], "left").select(*KEYS, "day", F.coalesce("answers", F.lit(0)).alias("answers"))


def streaks(fact: DataFrame, today: str) -> DataFrame:
    """L3: days in a row with assessed answers that end today or yesterday, else 0."""
    days = fact.where("assessed").select(*KEYS, "day").distinct().where(F.col("day") <= F.to_date(F.lit(today)))
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(*KEYS).orderBy("day")))
    runs = days.withColumn("island", island).groupBy(*KEYS, "island").agg(F.count(F.lit(1)).alias("length"), F.max("day").alias("last"))
    live = runs.where(F.col("last") >= F.date_sub(F.to_date(F.lit(today)), 1)).groupBy(*KEYS).agg(F.max("length").alias("streak"))
    return fact.select(*KEYS).distinct().join(live, KEYS, "left").select(*KEYS, F.coalesce("streak", F.lit(0)).alias("streak"))


def workload(fact: DataFrame, eligible_ids: DataFrame, today: str, exam_date: str, repetitions: int = REPETITIONS, per_session: int = PER_SESSION) -> DataFrame:
    """L4: total, completed and remaining answers until the exam day, and today's target; each question counts at most
    `repetitions` times."""
    now = F.to_date(F.lit(today))
    per_subject = eligible_ids.groupBy("subject_id").agg(F.count(F.lit(1)).alias("eligible"))
    done = (
        fact.where("assessed").join(eligible_ids.select(F.col("id").alias("question_id")), "question_id", "left_semi")
        .groupBy(*KEYS, "question_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("day") < now).alias("before"))
        .groupBy(*KEYS).agg(F.sum(F.least("n", F.lit(repetitions))).alias("completed"), F.sum(F.least("before", F.lit(repetitions))).alias("before"))
    )
    rows = fact.select(*KEYS).distinct().join(per_subject, "subject_id", "left").join(done, KEYS, "left")
    left = F.datediff(F.to_date(F.lit(exam_date)), now)
    study = F.when(left >= 0, left + 1).otherwise(0)
    rows = rows.select(*KEYS, F.coalesce("eligible", F.lit(0)).alias("eligible_questions"), F.coalesce("completed", F.lit(0)).alias("completed"), F.coalesce("before", F.lit(0)).alias("before"), left.alias("days_left"), study.alias("study_days"))
    rows = rows.withColumn("total", F.col("eligible_questions") * repetitions).withColumn("remaining", F.col("total") - F.col("completed")).withColumn("today_completed", F.col("completed") - F.col("before"))
    open_today = F.col("remaining") + F.col("today_completed")
    target = F.when(F.col("study_days") > 0, F.ceil(open_today / F.col("study_days"))).otherwise(F.least(open_today, F.lit(per_session)))
    rows = rows.withColumn("today_target", target.cast("bigint"))
    return rows.withColumn("today_remaining", F.greatest(F.lit(0), F.col("today_target") - F.col("today_completed"))).drop("before")


def schedule(loads: DataFrame, today: str, per_session: int = PER_SESSION, days: int = SCHEDULE_DAYS) -> DataFrame:
    """Questions and sessions of the next days: today's rest first, what is left spread evenly with the larger shares first."""
    rows = loads.where("study_days > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.least(F.col("study_days"), F.lit(days)) - 1)))
    ahead, later = F.greatest(F.lit(0), F.col("remaining") - F.col("today_remaining")), F.greatest(F.lit(1), F.col("study_days") - 1)
    share = F.floor(ahead / later) + F.when(F.col("i") <= ahead % later, 1).otherwise(0)
    amount = F.when(F.col("i") == 0, F.col("today_remaining")).otherwise(share).cast("bigint")
    return rows.select(*KEYS, F.date_add(F.to_date(F.lit(today)), F.col("i")).alias("day"), amount.alias("questions"), F.ceil(amount / per_session).cast("bigint").alias("sessions"))


# What is recommended where nothing else is.
SIMULATION = "Run a timed exam simulation"


# How many of each branch are recommended, and the states of thin material.
REPORTED_CARDS, WEAK_TOPICS, DUE_QUESTIONS, THIN_TOPICS = 6, 4, 4, 3
THIN_STATES = ("partial", "missing", "needs_review", "conflicting")


def reported_cards(cards: DataFrame) -> DataFrame:
    """The reported cards (id, subject_id, question_text, quality_score, reliability) to prepare first in each subject:
    those on current reports, then by quality."""
    urgency = (F.col("reliability") == "current").cast("int")
    rank = F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc(F.coalesce("urgency", F.lit(0))), F.desc("quality_score"), "id"))
    return cards.withColumn("urgency", urgency).withColumn("rank", rank).where(F.col("rank") <= REPORTED_CARDS).select("subject_id", F.col("question_text").alias("action"), "urgency", "rank")


def thin_topics(coverage: DataFrame) -> DataFrame:
    """The first topics of each subject whose material is thin, in the order of the coverage table (K4: subject_id,
    title, material_state, state_rank)."""
    rank = F.row_number().over(Window.partitionBy("subject_id").orderBy("state_rank", X.casefold(F.col("title")), "title"))
    rows = coverage.where(F.col("material_state").isin(*THIN_STATES)).withColumn("rank", rank).where(F.col("rank") <= THIN_TOPICS)
    return rows.select("subject_id", F.concat(F.lit("Improve material coverage for "), "title").alias("action"), "rank")


def study_plan(learners: DataFrame, reported: DataFrame, without_pack: DataFrame, weak: DataFrame, due: DataFrame, thin: DataFrame, n: int = 8) -> DataFrame:
    """The n first recommendations of every learner (user_id, subject_id). Each branch has subject_id, action, rank (1
    first), user_id where it differs by learner, and, for reported and due ones, urgency: whether the report is current,
    or the priority of the due attempt. A branch is cut to its first rows before it meets the learners.

    Priorities: reported cards 110 if current, else 100 (six); no accepted pack 100; weak topics 90 (four); due questions
    80 and up to 9 more (four); thin topics 65 (three); with nothing else a simulation at 50. Equal ones keep this order.
    """
    every = "user_id", "subject_id"
    who = learners.select(*every).distinct()

    def branch(df: DataFrame, order: int, priority: Column, most: int) -> DataFrame:
        df = df.where(F.col("rank") <= most)
        df = df if "user_id" in df.columns else who.join(df, "subject_id")
        return df.select(*every, "action", priority.cast("int").alias("priority"), F.lit(order).alias("branch"), "rank")

    rows = branch(reported, 0, F.when(F.col("urgency") == 1, 110).otherwise(100), REPORTED_CARDS)
    for df, order, priority, most in (
        (without_pack, 1, F.lit(100), 1), (weak, 2, F.lit(90), WEAK_TOPICS), (due, 3, 80 + F.least(F.lit(9), F.floor("urgency")), DUE_QUESTIONS), (thin, 4, F.lit(65), THIN_TOPICS),
    ):
        rows = rows.unionByName(branch(df, order, priority, most))
    none = who.join(rows.select(*every).distinct(), list(every), "left_anti")
    simulation = none.select(*every, F.lit(SIMULATION).alias("action"), F.lit(50).alias("priority"), F.lit(5).alias("branch"), F.lit(1).alias("rank"))
    rows = rows.unionByName(simulation)
    place = Window.partitionBy(*every).orderBy(F.desc("priority"), "branch", "rank")
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)


def answer_cards(points: DataFrame, evidence: DataFrame) -> DataFrame:
    """Answers of points (question_id, k, text, unit_id) with the citations of accepted evidence (id, source_start)."""
    known = points.join(evidence.select(F.col("id").alias("unit_id"), "source_start"), "unit_id")
    cited = known.groupBy("question_id", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_set("unit_id")), lambda x: F.concat(F.lit("[E"), x.cast("string"), F.lit("]"))), " ").alias("marks"))
    sources = known.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("unit_id", "source_start"))), lambda x: F.concat(F.lit("E"), x["unit_id"].cast("string"), F.lit("@"), x["source_start"].cast("string"))), ",").alias("sources"))
    sentences = points.select("question_id", "k", "text").distinct().join(cited, ["question_id", "k"], "left").withColumn("s", F.trim(F.concat_ws(" ", "text", F.coalesce("marks", F.lit("")))))
    answers = sentences.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]), " ").alias("answer"))
    return answers.join(sources, "question_id")
