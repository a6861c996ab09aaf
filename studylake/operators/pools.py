"""Question pools, selection and reported questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..shared import checkpointed
from . import retrieval
from . import topics as D

# Allowed values and defaults of questions, ranks of types, tags that are too general for project evidence.
DIFFICULTIES, PRIORITIES = ("easy", "medium", "hard"), ("A", "B", "C")
TYPE_RANK = {"explanation": 0, "definition": 1, "connection": 2, "comparison": 3, "application": 4}
GENERAL_TAGS = ("own project", "evaluation", "experiment", "learning theories", "media choice")
CONCEPT_STOP = ("what", "which", "explain", "difference", "differences", "between", "wie", "was", "und", "sind", "lassen", "sich")


def normalized(raw: DataFrame) -> DataFrame:
    """One form of imported questions; names of fields vary. Rows without a text have a reject reason."""

    def first(*names: str) -> Column:
        found = [F.col(n) for n in names if n in raw.columns]
        return F.coalesce(*found, F.lit(None)) if found else F.lit(None)

    def text(*names: str) -> Column:
        value = F.trim(first(*names).cast("string"))
        return F.when(value != "", value)

    def strings(*names: str) -> Column:
        found = [n for n in names if n in raw.columns]
        if not found:
            return F.array().cast("array<string>")
        value = F.coalesce(*(F.col(n) if raw.schema[n].dataType.typeName() == "array" else F.array(F.col(n)) for n in found), F.array().cast("array<string>"))
        return X.distinct_strings(value)

    difficulty, priority = F.lower(text("difficulty")), F.upper(text("priority"))
    question = text("question", "text", "wording")
    slides = [n for n in ("source_slides", "source_pages", "pages") if n in raw.columns]
    listed = F.coalesce(*(F.array_join(n, ",") if raw.schema[n].dataType.typeName() == "array" else F.col(n).cast("string") for n in slides), F.lit("")) if slides else F.lit("")
    return raw.select(
        text("id", "external_id", "question_id").alias("external_id"), text("concept_id", "parent_question_id").alias("concept_id"), F.coalesce(text("topic", "category"), F.lit("Unassigned")).alias("topic"), question.alias("question"),
        F.coalesce(F.lower(text("question_type", "type")), F.lit("explain")).alias("question_type"), F.when(difficulty.isin(*DIFFICULTIES), difficulty).otherwise("medium").alias("difficulty"),
        F.when(priority.isin(*PRIORITIES), priority).otherwise("B").alias("priority"), text("source_file").alias("source_file"), X.slide_numbers(listed).alias("source_slides"), X.unparsed_slides(listed).alias("other_slides"),
        strings("expected_answer_points", "answer_points").alias("points"), strings("possible_followups", "followups").alias("followups"), strings("tags").alias("tags"),
        F.when(question.isNull(), "missing question text").alias("reject_reason"),
    )


def concept_key(q: DataFrame) -> Column:
    """What makes questions the same concept: concept id, source and slides, two acronyms, external id, the id of one
    without text, or its first eight terms."""
    source = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce("source_file", F.lit("")), r"\.[^.]*$", "")), "[^a-z0-9]+", "")
    slides = F.coalesce("source_slides", F.array().cast("array<int>"))
    acronyms = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("question_text", F.lit(r"(?i)\b(?:vr|ar|mr|xr|lms|mooc)s?\b"), F.lit(0)), F.lower)))
    terms = F.array_sort(F.array_except(X.long_tokens(F.col("question_text")), F.array(*map(F.lit, CONCEPT_STOP))))
    return (
        F.when(F.col("concept_id").isNotNull(), F.concat(F.lit("concept:"), X.casefold(F.col("concept_id"))))
        .when((source != "") & (F.size(slides) > 0), F.concat(F.lit("source:"), source, F.lit(":"), F.array_min(slides).cast("string"), F.lit("-"), F.array_max(slides).cast("string")))
        .when(F.size(acronyms) >= 2, F.concat(F.lit("acronyms:"), F.array_join(acronyms, ",")))
        .when(F.col("external_id").isNotNull(), F.concat(F.lit("external:"), X.casefold(F.col("external_id"))))
        .when(F.coalesce("question_text", F.lit("")) == "", F.concat(F.lit("question:"), F.col("id").cast("string")))
        .otherwise(F.concat(F.lit("terms:"), F.array_join(F.slice(terms, 1, 8), ",")))
    )


def _before(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`rows` with the first two lines of all rows that share `keys`, as name_1 and name_2; null where a key is null."""
    known = rows.where(F.col(keys[-1]).isNotNull())
    first = known.groupBy(*keys).agg(F.min("line").alias(f"{name}_1"))
    second = known.join(first, keys).where(F.col("line") > F.col(f"{name}_1")).groupBy(*keys).agg(F.min("line").alias(f"{name}_2"))
    return rows.join(first, keys, "left").join(second, keys, "left")


def _first_wins(rows: DataFrame) -> DataFrame:
    """Of rows (subject_id, line, external_id, key) with unique lines those that no earlier one of these shares id or key with.

    A round settles all rows that come first with both, and whole chains behind them: a row with just one open row before
    it is taken if that one is not, so it points to it, and pointers are doubled until they reach a row that does not
    point on. So a chain of n rows takes about log2 n steps of one round. Rows that share an id or key with a taken row
    go; what two or more rows stood before waits for the next round.
    """
    left, taken = checkpointed(rows), rows.limit(0)
    while not left.isEmpty():
        marked = _before(_before(left, ["subject_id", "key"], "text"), ["subject_id", "external_id"], "id")
        by_text = F.when(F.col("line") > F.col("text_1"), F.col("text_1"))
        by_id = F.when(F.col("line") > F.col("id_1"), F.col("id_1"))
        more = (F.col("line") > F.col("text_2")) | (F.col("line") > F.col("id_2")) | (by_text != by_id)
        marked = marked.select(*rows.columns, F.coalesce(by_text, by_id).alias("to"), F.coalesce(more, F.lit(False)).alias("waits"))
        # to: the row that this one points to; odd: whether it is taken just if that one is not
        steps = checkpointed(marked.withColumn("to", F.when(~F.col("waits"), F.col("to"))).withColumn("odd", F.col("to").isNotNull()))
        while True:
            aim = steps.where("to IS NOT NULL").select("subject_id", F.col("line").alias("to"), F.col("to").alias("next"), F.col("odd").alias("turn"))
            if aim.join(steps.select("subject_id", "to"), ["subject_id", "to"], "left_semi").isEmpty():
                break
            joined = steps.join(aim, ["subject_id", "to"], "left")
            steps = checkpointed(joined.select(*rows.columns, "waits", F.coalesce("next", "to").alias("to"), (F.col("odd") != F.coalesce("turn", F.lit(False))).alias("odd")))
        roots = steps.where("to IS NULL AND NOT waits").select("subject_id", F.col("line").alias("to"), F.lit(True).alias("settled"))
        ends = checkpointed(steps.join(roots, ["subject_id", "to"], "left").withColumn("settled", F.coalesce("settled", F.col("to").isNull() & ~F.col("waits"))))
        now = ends.where("settled AND NOT odd").select(*rows.columns)
        taken = taken.unionByName(now)
        rest = ends.where("NOT settled").select(*rows.columns).join(now.select("subject_id", "key").distinct(), ["subject_id", "key"], "left_anti")
        left = checkpointed(rest.join(now.where("external_id IS NOT NULL").select("subject_id", "external_id").distinct(), ["subject_id", "external_id"], "left_anti"))
    return taken


def preview(new: DataFrame, stored: DataFrame) -> DataFrame:
    """G1: rows of a file (subject_id, line, external_id, question) with why they are rejected: an id or else a text that is
    stored, or that an earlier accepted row has. A rejected row marks neither its id nor its text as seen."""
    key = X.question_key(F.col("question"))
    ids = stored.where("external_id IS NOT NULL").select("subject_id", "external_id").distinct().withColumn("stored_id", F.lit(True))
    texts = stored.select("subject_id", X.question_key(F.col("question_text")).alias("key")).distinct().withColumn("stored_text", F.lit(True))
    rows = new.withColumn("key", key).join(ids, ["subject_id", "external_id"], "left").join(texts, ["subject_id", "key"], "left")
    rows = checkpointed(rows.withColumn("stored_id", F.coalesce("stored_id", F.lit(False))).withColumn("stored_text", F.coalesce("stored_text", F.lit(False))))
    accepted = _first_wins(rows.where("NOT stored_id AND NOT stored_text").select("subject_id", "line", "external_id", "key"))
    seen_ids = accepted.where("external_id IS NOT NULL").select("subject_id", "external_id", F.col("line").alias("id_line"))
    seen_texts = accepted.select("subject_id", "key", F.col("line").alias("text_line"))
    rows = rows.join(seen_ids, ["subject_id", "external_id"], "left").join(seen_texts, ["subject_id", "key"], "left")
    by_id = F.col("stored_id") | F.coalesce(F.col("id_line") < F.col("line"), F.lit(False))
    by_text = F.col("stored_text") | F.coalesce(F.col("text_line") < F.col("line"), F.lit(False))
    reason = F.when(by_id, "duplicate external ID").when(by_text, "duplicate question text")
    return rows.select("subject_id", "line", "external_id", "question", reason.alias("reason"))


def counts(accepted: DataFrame, column: str) -> DataFrame:
    """Accepted rows by topic or priority."""
    return accepted.groupBy("subject_id", column).agg(F.count(F.lit(1)).alias("n"))


def materialized(accepted: DataFrame, topics: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Imported questions as stored, and the topics that they bring (id, subject_id, name).

    A question's topic is found by name in any case; names that no topic of the subject has become topics with ids after
    the highest, in the order of subject and name, spelt as in the first line. Points become structs, defaults are set,
    and questions are numbered in file order.
    """
    known = topics.groupBy("subject_id", X.casefold(F.col("name")).alias("key")).agg(F.min("id").alias("known_id"))
    rows = accepted.withColumn("key", X.casefold(F.col("topic"))).join(known, ["subject_id", "key"], "left")
    new = rows.where("known_id IS NULL").groupBy("subject_id", "key").agg(F.min_by("topic", "line").alias("name"))
    created = D.numbered(new, ["subject_id", "key"], topics.agg(F.max("id")).first()[0] or 0, "id")
    rows = rows.join(created.select("subject_id", "key", F.col("id").alias("new_id")), ["subject_id", "key"], "left")
    number = F.row_number().over(Window.partitionBy("subject_id").orderBy("line"))
    stored = rows.select(
        "subject_id", (number - 1 + first_id).alias("number"), F.coalesce("known_id", "new_id").alias("topic_id"), F.col("known_id").isNull().alias("creates_topic"), "question",
        F.transform("points", lambda p: F.struct(p.alias("text"), F.array().cast("array<bigint>").alias("evidence_ids"), F.lit("must_know").alias("priority"))).alias("points"),
        F.lit(90).alias("expected_duration_seconds"), F.lit(0.8).alias("quality_score"), F.lit("accepted").alias("review_status"),
    )
    return stored, created.select("id", "subject_id", "name")


def disable(questions: DataFrame, pools: DataFrame) -> DataFrame:
    """Questions of disabled pools (pool_id) are off; none is deleted."""
    off = pools.select(F.col("pool_id").alias("question_pool_id")).distinct().withColumn("off", F.lit(True))
    return questions.join(off, "question_pool_id", "left").withColumn("enabled", F.col("enabled") & F.col("off").isNull()).drop("off")


def listed(questions: DataFrame, topics: DataFrame, accepted_only: bool = False) -> DataFrame:
    """Questions with their topic's name, their own, or Unassigned."""
    rows = questions.join(topics.select(F.col("id").alias("topic_id"), F.col("name").alias("resolved")), "topic_id", "left")
    rows = rows.withColumn("topic", F.coalesce("resolved", F.nullif(F.col("topic_name"), F.lit("")), F.lit("Unassigned"))).drop("resolved")
    return rows.where("review_status = 'accepted' AND enabled") if accepted_only else rows


def practice_candidates(questions: DataFrame, topics: list[str] | None = None, difficulties: list[str] | None = None, priorities: list[str] | None = None) -> DataFrame:
    """Accepted, enabled questions by the filters given."""
    rows = questions.where("review_status = 'accepted' AND enabled")
    for column, values in (("topic_name", topics), ("difficulty", difficulties), ("priority", priorities)):
        if values:
            rows = rows.where(F.col(column).isin(*values))
    return rows


def recent(attempts: DataFrame, count: int) -> DataFrame:
    """Questions of each learner's last attempts: twice the count, ten at least."""
    last = Window.partitionBy("user_id", "subject_id").orderBy(F.desc("created_at"), F.desc("id"))
    return attempts.withColumn("k", F.row_number().over(last)).where(F.col("k") <= max(10, 2 * count)).select("user_id", "subject_id", "question_id").distinct()


def balanced_sample(questions: DataFrame, recently: DataFrame, count: int, seed: int) -> DataFrame:
    """For each learner of `recently` count questions of the subject: one for each concept, fresh ones first within a
    topic, topics in turn. Chance is the MD5 of seed and id.

    Topics take turns in one order for all learners, so only the first `count` of a subject are drawn from. Of such a topic
    a learner gets `count` questions at most, the first ones by chance that are not among their recent ones, and recent
    ones behind them. So the first `count` and as many more as any learner has recent ones, cut once for each topic, are
    all that a learner meets. A subject's come as one list and a learner's recent ones as another, and the lists are told
    apart in place: what is shuffled is a row for each recent question, none for what a learner could get.
    """
    chance = lambda c: F.md5(F.concat_ws(":", F.lit(seed), c.cast("string")))
    one = questions.groupBy("subject_id", "concept").agg(F.min("id").alias("id"), F.min_by("topic_name", "id").alias("topic_name")).withColumn("chance", chance(F.col("id")))
    turns = one.select("subject_id", "topic_name").distinct()
    turns = turns.withColumn("rank", F.row_number().over(Window.partitionBy("subject_id").orderBy(chance(F.col("topic_name")), "topic_name"))).where(F.col("rank") <= count)
    drawn = one.join(turns, ["subject_id", "topic_name"]).select("subject_id", "topic_name", "rank", "id", "chance")
    marked = recently.select("user_id", "subject_id", F.col("question_id").alias("id")).distinct().join(drawn.select("subject_id", "id", "rank", "chance"), ["subject_id", "id"], "left")
    learners = marked.groupBy("user_id", "subject_id").agg(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "chance", "id"))).alias("recents"))
    most = learners.agg(F.max(F.size("recents"))).first()[0] or 0
    first = drawn.withColumn("k", F.row_number().over(Window.partitionBy("subject_id", "topic_name").orderBy("chance", "id"))).where(F.col("k") <= count + most)
    lists = first.groupBy("subject_id", "rank", "topic_name").agg(F.array_sort(F.collect_list(F.struct("chance", "id"))).alias("offers"))
    lists = lists.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("rank", "topic_name", "offers"))).alias("topics"))

    def picked(topic: Column) -> Column:
        fresh = F.filter(topic["offers"], lambda x: ~F.array_contains("recents.id", x["id"]))
        again = F.array_sort(F.transform(F.filter("recents", lambda x: x["rank"] == topic["rank"]), lambda x: F.struct(x["chance"].alias("chance"), x["id"].alias("id"))))
        marked_as = lambda xs, recent: F.transform(xs, lambda x: F.struct(x["id"].alias("id"), F.lit(recent).alias("recent")))
        both = F.slice(F.concat(marked_as(F.slice(fresh, 1, count), 0), marked_as(again, 1)), 1, count)
        return F.transform(both, lambda x, turn: F.struct(turn.alias("turn"), topic["rank"].alias("rank"), x["id"].alias("id"), topic["topic_name"].alias("topic_name"), x["recent"].alias("recent")))

    picks = F.slice(F.array_sort(F.flatten(F.transform("topics", picked))), 1, count)
    rows = learners.join(lists, "subject_id").select("user_id", "subject_id", F.posexplode(picks).alias("pos", "pick"))
    return rows.select("user_id", "subject_id", "pick.id", "pick.topic_name", "pick.recent", (F.col("pos") + 1).alias("place"))


def mock_pool(questions: DataFrame) -> DataFrame:
    """Questions for mock exams: accepted and enabled ones with a rubric (n_points) that are in a pool or name evidence
    (n_evidence); of a subject's pools if it has any such, the best of each concept."""
    curated = F.col("question_pool_id").isNotNull()
    rows = questions.where("review_status = 'accepted' AND enabled AND n_points > 0").where(curated | (F.col("n_evidence") > 0))
    has = rows.groupBy("subject_id").agg(F.bool_or(curated).alias("has_pool"))
    rows = rows.join(has, "subject_id").where(curated | ~F.col("has_pool"))
    best = rows.groupBy("subject_id", "concept").agg(F.max_by("id", F.struct("quality_score", -F.col("id"))).alias("id"))
    return rows.join(best, ["subject_id", "concept", "id"], "left_semi").drop("has_pool")


def question_order(questions: DataFrame, weak: DataFrame, target: int | None = None) -> DataFrame:
    """Questions by type, quality and id, weak ones (subject_id, id, place) before them in their own order.

    With a target, as for a mock exam, `questions` are those of G10 and the first `target` of each subject are taken.
    """
    rank = F.coalesce(F.create_map(*(F.lit(x) for p in TYPE_RANK.items() for x in p))[F.col("question_type")], F.lit(5))
    rows = questions.join(weak.select("subject_id", "id", F.col("place").alias("weak_place")), ["subject_id", "id"], "left")
    order = Window.partitionBy("subject_id").orderBy(F.col("weak_place").asc_nulls_last(), rank, F.desc("quality_score"), "id")
    placed = rows.select("subject_id", "id", F.row_number().over(order).alias("place"))
    return placed if target is None else placed.where(F.col("place") <= target)


def next_question(candidates: DataFrame) -> DataFrame:
    """For each session (session_id, place, question_id, used, evidence_ids, missing_ids) the first unused question
    that shares missing evidence, else the first unused one."""
    fits = F.arrays_overlap("evidence_ids", "missing_ids")
    return candidates.where(~F.col("used")).groupBy("session_id").agg(F.min_by("question_id", F.struct(~F.coalesce(fits, F.lit(False)), F.col("place"))).alias("next_question_id"))


def _first_gap(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """The least number from 1 on that no row of `keys` has; numbers are distinct within them."""
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(number)))
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col(number) != F.col("nth"), F.col("nth"))), F.max("nth") + 1).alias("gap"))


def next_questions(sessions: DataFrame, questions: DataFrame, used: DataFrame) -> DataFrame:
    """G12 for all sessions at once: sessions (session_id, subject_id, missing_ids), questions (question_id, subject_id,
    place, evidence_ids), used (session_id, question_id), each pair once. Sessions with nothing left have no row.

    The first unused one is at the first gap among the numbers of the used ones, so that no session meets all questions
    of its subject. Those that share one piece of missing evidence are numbered as well, and their first unused one is at
    such a gap too, so that no session meets all of them either. Numbering is one window for each subject.
    """
    numbered = questions.withColumn("k", F.row_number().over(Window.partitionBy("subject_id").orderBy("place", "question_id")))
    asked = sessions.select("session_id", "subject_id", F.explode(F.array_distinct("missing_ids")).alias("evidence_id"))
    offers = numbered.select("subject_id", "question_id", "k", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    offers = offers.withColumn("offer", F.row_number().over(Window.partitionBy("subject_id", "evidence_id").orderBy("k")))
    gone = used.join(asked, "session_id").join(offers.select("subject_id", "evidence_id", "question_id", "offer"), ["subject_id", "evidence_id", "question_id"])
    gone = _first_gap(gone, ["session_id", "evidence_id"], "offer")
    open_ = asked.join(gone, ["session_id", "evidence_id"], "left").withColumn("offer", F.coalesce("gap", F.lit(1)))
    fitting = open_.join(offers.select("subject_id", "evidence_id", "offer", "k"), ["subject_id", "evidence_id", "offer"]).groupBy("session_id").agg(F.min("k").alias("fitting"))
    taken = used.join(sessions.select("session_id", "subject_id"), "session_id").join(numbered.select("subject_id", "question_id", "k"), ["subject_id", "question_id"])
    gaps = _first_gap(taken, ["session_id"], "k")
    chosen = sessions.select("session_id", "subject_id").join(fitting, "session_id", "left").join(gaps, "session_id", "left").withColumn("k", F.coalesce("fitting", "gap", F.lit(1)))
    return chosen.join(numbered.select("subject_id", "k", "question_id"), ["subject_id", "k"]).select("session_id", F.col("question_id").alias("next_question_id"))


def import_reported(new: DataFrame, stored: DataFrame) -> DataFrame:
    """H1: inserted, unchanged, or conflict where the wording of a stable id (stable_id, wording) changed."""
    old = stored.select("stable_id", F.col("wording").alias("old_wording"))
    state = F.when(F.col("old_wording").isNull(), "inserted").when(F.col("old_wording") == F.col("wording"), "unchanged").otherwise("conflict")
    return new.join(old, "stable_id", "left").select("stable_id", state.alias("state"))


def activation(reported: DataFrame, units: DataFrame) -> DataFrame:
    """H2: active reports (stable_id, activation, evidence_ids) fall back unless their evidence is not empty and all accepted."""
    ids = reported.select("stable_id", F.explode("evidence_ids").alias("unit_id"))
    ok = units.where("review_status = 'accepted'").select(F.col("id").alias("unit_id")).distinct().withColumn("ok", F.lit(True))
    state = ids.join(ok, "unit_id", "left").groupBy("stable_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("valid"))
    rows = reported.join(state, "stable_id", "left")
    down = (F.col("activation") == "active") & ~F.coalesce("valid", F.lit(False))
    return rows.select("stable_id", F.when(down, "awaiting_course_evidence").otherwise(F.col("activation")).alias("activation"))


def reported_list(reported: DataFrame, provenance: str = "", reliability: str = "", activation: str = "", query: str = "") -> DataFrame:
    """H3: reports by the filters given, in the order of chains."""
    for column, value in (("provenance", provenance), ("reliability", reliability), ("activation", activation)):
        if value:
            reported = reported.where(F.col(column) == value)
    if query:
        reported = reported.where(F.contains(X.question_key(F.col("wording")), X.question_key(F.lit(query))))
    return reported.orderBy(F.coalesce("chain_id", "stable_id"), "stable_id")


def substantive(content: Column, answerability: Column, tags: Column) -> Column:
    """H4: evidence of 80 characters and ten words that is no bare address and, for project questions, names one of their tags."""
    flat = F.trim(F.regexp_replace(content, r"\s+", " "))
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    own = F.array_except(F.transform(tags, lambda t: F.replace(norm(t), F.lit("_"), F.lit(" "))), F.array(*map(F.lit, GENERAL_TAGS)))
    long = (F.length(flat) >= 80) & (F.regexp_count(flat, F.lit(r"[A-Za-zÀ-ÖØ-öø-ÿ]{3,}")) >= 10) & ~flat.rlike(r"(?i)^https?://\S+$")
    return long & (~F.contains(answerability, F.lit("project")) | F.exists(own, lambda t: F.contains(norm(content), t)))


#: Units searched for a report's card, and those that make its points.
CARD_HITS, CARD_POINTS = 8, 3


def training_cards(reported: DataFrame, units: DataFrame, stored: DataFrame, limit: int = 10, followups: bool = True) -> DataFrame:
    """H5: cards of the first reports of each subject, and what becomes of each.

    Reports (stable_id, subject_id, wording, provenance, reliability, chain_id, question_type, answerability, topic_tags,
    required_actions, vector) go by current reliability, exact wording, chain and id; `limit` of a subject are taken, 50 at
    most. Evidence comes from a search for wording, tags and actions among active units (id, subject_id, document_id,
    topic_id, content, vector): the first three of eight hits that are substantive, whose whole texts are the points, the
    first two as must-know. Outcomes: existing (a stored question stems from the report: origin_id), unmatched (no
    evidence), skipped (the wording is stored, or an earlier card has it), created.

    The search goes through the units' texts several times, so units are cut off by a checkpoint: what they are joined
    from is shuffled once.
    """
    units = checkpointed(units.select("id", "subject_id", "document_id", "topic_id", "content", "vector"))
    rows = reported if followups else reported.where("provenance != 'reported_followup'")
    order = [(F.col("reliability") != "current").cast("int"), (F.col("provenance") != "exact_reported").cast("int"), F.coalesce("chain_id", "stable_id"), F.col("stable_id")]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("subject_id").orderBy(*order))).where(F.col("rank") <= max(1, min(50, limit)))
    linked = stored.where("origin_id IS NOT NULL").select(F.col("origin_id").alias("stable_id")).distinct().withColumn("linked", F.lit(True))
    rows = checkpointed(rows.join(linked, "stable_id", "left"))
    text = F.array_join(F.concat(F.array("wording"), "topic_tags", "required_actions"), " ")
    numbered = rows.where("linked IS NULL").withColumn("query_id", F.xxhash64("subject_id", "stable_id"))
    asked = numbered.select("query_id", "subject_id", F.lit(None).cast("int").alias("topic_id"), text.alias("text"), "vector")
    hits = retrieval.search(asked, units, CARD_HITS).join(units.select(F.col("id").alias("unit_id"), "content"), "unit_id").join(numbered.select("query_id", "stable_id", "answerability", "topic_tags"), "query_id")
    hits = hits.where(substantive(F.col("content"), F.col("answerability"), F.col("topic_tags"))).withColumn("k", F.row_number().over(Window.partitionBy("stable_id").orderBy("place"))).where(F.col("k") <= CARD_POINTS)
    point = F.struct("k", "unit_id", F.trim("content").alias("text"), F.when(F.col("k") <= 2, "must_know").otherwise("useful_detail").alias("priority"))
    points = hits.groupBy("stable_id").agg(F.array_sort(F.collect_list(point)).alias("points"))
    key = X.question_key(F.col("wording"))
    known = stored.select("subject_id", X.question_key(F.col("question_text")).alias("key")).distinct().withColumn("known", F.lit(True))
    rows = rows.join(points, "stable_id", "left").withColumn("key", key).join(known, ["subject_id", "key"], "left")
    open_ = F.col("linked").isNull() & F.col("points").isNotNull() & F.col("known").isNull()
    earlier = F.row_number().over(Window.partitionBy("subject_id", "key", open_).orderBy("rank")) > 1
    outcome = F.when(F.col("linked"), "existing").when(F.col("points").isNull(), "unmatched").when(F.col("known") | earlier, "skipped").otherwise("created")
    rows = rows.withColumn("outcome", outcome)
    return rows.select(
        "subject_id", "stable_id", "rank", "outcome", F.when(F.col("outcome") == "created", F.col("points")).alias("points"), F.when(F.size("required_actions") >= 3, "hard").otherwise("medium").alias("difficulty"),
        X.reported_quality(F.col("reliability"), F.col("provenance")).alias("quality_score"),
    )
