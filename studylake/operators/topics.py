"""Topics: canonical names, counts, resolution, inference (D1-D8), and what material covers (K1, K2, K4)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..shared import checkpointed

# What tells the dimensions of a topic in its material, and topic names that ask for more of them.
DIMENSIONS = {
    "central_explanation": r"\b(?:is defined as|refers to|means|describes|is a|are a|concept|definition)\b",
    "core_mechanism": r"\b(?:mechanism|because|therefore|causes?|leads? to|works? by|how it works|processing|interaction)\b",
    "model_components": r"\b(?:components?|elements?|consists? of|comprises?|modules?|stages?|layers?)\b",
    "relationships_process": r"\b(?:relationship|between|process|sequence|workflow|step|phase|cycle|input|output)\b",
    "application_example": r"\b(?:for example|for instance|e\.g\.|example|application|apply|use case|scenario)\b",
    "limitation_comparison": r"\b(?:limitation|drawback|however|whereas|compared|comparison|advantage|disadvantage|trade-?off|versus|vs\.)\b",
}
BASE_DIMENSIONS = ("application_example", "central_explanation", "core_mechanism", "source_traceability")
NAMED = {
    "model_components": r"\b(?:model|framework|architecture|system)\b",
    "relationships_process": r"\b(?:process|workflow|cycle|method)\b",
    "limitation_comparison": r"\b(?:comparison|evaluation|method|alternative)\b",
}
TRACEABLE_FROM, TITLE_CHARS = 0.7, 160
STATE_ORDER = {"conflicting": 0, "needs_review": 1, "missing": 2, "partial": 3, "complete": 4, "unassigned": 5}


def canonical(topics: DataFrame, unicode: Callable[[Column], Column] = X.nfkc) -> DataFrame:
    """For each topic (id, subject_id, name) what becomes of it: kept, renamed, merged into the topic that stands for its
    title in its subject, or unassigned if it has not just one title; and the new id and name.

    The topic with the least id stands for a title, unless another one already bears the clean title as its name: then
    the least of those does.
    """
    same = lambda c: c
    rows = topics.withColumn("plain", unicode(F.col("name"))).withColumn("title", F.substring(X.single_title(F.col("plain"), same), 1, TITLE_CHARS)).withColumn("key", X.casefold(F.col("title"))).drop("plain")
    titled = rows.where("title IS NOT NULL")
    first = titled.groupBy("subject_id", "key").agg(F.min(F.struct("id", "title")).alias("first"))
    bearer = F.min(F.when((F.col("id") != F.col("first.id")) & (F.lower("name") == F.lower("first.title")), F.struct("id", "title")))
    heads = titled.join(first, ["subject_id", "key"]).groupBy("subject_id", "key").agg(F.coalesce(bearer, F.min("first")).alias("head"))
    joined = rows.join(heads, ["subject_id", "key"], "left")
    action = (
        F.when(F.col("title").isNull(), "unassigned").when(F.col("head.id") != F.col("id"), "merged").when(F.col("title") != F.col("name"), "renamed").otherwise("kept")
    )
    return joined.select("id", "subject_id", "name", F.col("head.id").alias("new_id"), F.col("head.title").alias("new_name"), action.alias("action"))


class Normalized(NamedTuple):
    """The tables after topics were made canonical."""

    topics: DataFrame
    units: DataFrame
    questions: DataFrame
    counts: DataFrame


def normalized(topics: DataFrame, units: DataFrame, questions: DataFrame, unicode: Callable[[Column], Column] = X.nfkc) -> Normalized:
    """Topics (id, subject_id, name, description) made canonical, and the rows that refer to them.

    Units (id, topic_id, review_status, enabled_for_retrieval) and questions (id, topic_id) take the id that their topic
    was merged into, or none if it became unassigned; their other columns stay. Topics that nothing refers to any more go.
    A renamed topic keeps its heading in its description, and evidence_count has its accepted, enabled units. The counts of
    each subject are renamed, merged, moved_to_unassigned and deleted_orphans. What becomes of topics is decided once and
    checkpointed, as all four results hang on it.
    """
    decided = checkpointed(canonical(topics, unicode))
    remap = decided.select(F.col("id").alias("topic_id"), "new_id", F.lit(True).alias("__known"))

    def moved(df: DataFrame) -> DataFrame:
        rows = df.join(remap, "topic_id", "left")
        return rows.withColumn("topic_id", F.when(F.col("__known"), F.col("new_id")).otherwise(F.col("topic_id"))).select(*df.columns)

    units, questions = moved(units), moved(questions)
    used = units.select("topic_id").unionByName(questions.select("topic_id")).where("topic_id IS NOT NULL").distinct().withColumn("used", F.lit(True))
    heads = decided.where("new_id = id").join(used, F.col("id") == F.col("topic_id"), "left").drop("topic_id")
    heads = checkpointed(heads.select("id", "subject_id", F.col("name").alias("heading"), F.col("new_name").alias("name"), "action", F.coalesce("used", F.lit(False)).alias("used")))
    counted = units.where("review_status = 'accepted' AND enabled_for_retrieval").groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
    kept = heads.where("used").join(topics.select("id", "description"), "id").join(counted, F.col("id") == F.col("topic_id"), "left")
    before = F.coalesce("description", F.lit(""))
    trace = F.concat(F.lit("Original source heading: "), "heading")
    traced = F.when((F.col("action") == "renamed") & ~F.contains(before, trace), X.strip(F.concat(before, F.lit("\n"), trace))).otherwise(F.col("description"))
    kept = kept.select("id", "subject_id", "name", traced.alias("description"), F.coalesce("n", F.lit(0)).alias("evidence_count"))
    of_all = decided.groupBy("subject_id").agg(*(F.count_if(F.col("action") == a).alias(n) for a, n in (("renamed", "renamed"), ("merged", "merged"), ("unassigned", "moved_to_unassigned"))))
    orphans = heads.where("NOT used").groupBy("subject_id").agg(F.count(F.lit(1)).alias("orphans"))
    counts = of_all.join(orphans, "subject_id", "left").select("subject_id", "renamed", "merged", "moved_to_unassigned", F.coalesce("orphans", F.lit(0)).alias("deleted_orphans"))
    return Normalized(kept, units, questions, counts)


def evidence_counts(topics: DataFrame, units: DataFrame) -> DataFrame:
    """Accepted units of each topic, zeros included."""
    counted = units.where("review_status = 'accepted'").groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
    return topics.join(counted, topics["id"] == counted["topic_id"], "left").select("id", F.coalesce("n", F.lit(0)).alias("evidence_count"))


def active(topics: DataFrame, used: DataFrame) -> DataFrame:
    """D3: topics with units or questions; `used` has the topic ids of both."""
    return topics.join(used.select(F.col("topic_id").alias("id")).distinct(), "id", "left_semi")


def numbered(rows: DataFrame, order: list[str], after: int, name: str) -> DataFrame:
    """`rows` with numbers after `after`, without gaps, in the order of the columns `order`.

    Rows are dealt by range and checkpointed with the number of their part. The sizes of the parts, one row each, tell
    where each part begins, so that no task sees more than its part.
    """
    dealt = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    dealt = checkpointed(dealt)
    sizes = sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect())
    starts, at = [], after
    for part, size in sizes:
        starts.append((part, at))
        at += size
    starts = rows.sparkSession.createDataFrame(starts, "__part int, __start long")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + place).drop("__part", "__start")


def resolve(names: DataFrame, topics: DataFrame, unicode: Callable[[Column], Column] = X.nfkc) -> DataFrame:
    """Ids of names by key; new keys get ids after the highest, in the order of subject and key."""
    wanted = names.select("subject_id", X.topic_key(F.col("name"), unicode).alias("key")).distinct()
    known = topics.select("subject_id", X.topic_key(F.col("name"), unicode).alias("key"), "id").groupBy("subject_id", "key").agg(F.min("id").alias("id"))
    joined = checkpointed(wanted.join(known, ["subject_id", "key"], "left"))
    top = topics.agg(F.max("id")).first()[0] or 0
    fresh = numbered(joined.where("id IS NULL").drop("id"), ["subject_id", "key"], top, "id")
    return joined.where("id IS NOT NULL").select("subject_id", "key", "id", F.lit(False).alias("created")).unionByName(fresh.select("subject_id", "key", "id", F.lit(True).alias("created")))


def backfill(units: DataFrame, headings: DataFrame) -> DataFrame:
    """Units without topic take the one title of their document's page (document_id, page, title), if it is the only one."""
    single = headings.groupBy("document_id", "page").agg(F.min("title").alias("title"), F.count_distinct("title").alias("n")).where("n = 1")
    rows = units.join(single.select("document_id", F.col("page").alias("source_start"), "title"), ["document_id", "source_start"], "left")
    return rows.select("id", F.when(F.col("topic_name").isNull() & ~F.col("authoritative"), F.col("title")).otherwise(F.col("topic_name")).alias("topic_name"))


def infer(questions: DataFrame, evidence: DataFrame, topics: DataFrame) -> DataFrame:
    """Topic of each question (id, subject_id, question_text): the only topic of its accepted evidence (id, topic_id),
    else the only topic of its subject whose whole name stands in the text.

    Names are matched through their first word, so that questions and topics meet by an equal key.
    """
    by_evidence = evidence.groupBy("id").agg(F.min("topic_id").alias("topic"), F.count_distinct("topic_id").alias("n")).where("n = 1").select("id", F.col("topic").alias("by_evidence"))
    key = X.topic_key(F.col("name"), lambda c: c)
    names = topics.select("subject_id", F.col("id").alias("topic_id"), key.alias("key")).where(F.length("key") >= 4).withColumn("word", F.split_part("key", F.lit(" "), F.lit(1)))
    texts = questions.select("id", "subject_id", F.concat(F.lit(" "), X.topic_key(F.col("question_text"), lambda c: c), F.lit(" ")).alias("text"))
    words = texts.withColumn("word", F.explode(F.array_distinct(F.split(F.trim("text"), " "))))
    named = words.join(names, ["subject_id", "word"]).where(F.contains("text", F.concat(F.lit(" "), "key", F.lit(" ")))).groupBy("id").agg(F.min("topic_id").alias("topic"), F.count_distinct("topic_id").alias("n")).where("n = 1").select("id", F.col("topic").alias("by_name"))
    return questions.select("id").join(by_evidence, "id", "left").join(named, "id", "left").select("id", F.coalesce("by_evidence", "by_name").alias("topic_id"))


def reclassify(questions: DataFrame, inferred: DataFrame) -> DataFrame:
    """Manual topics stay, unassigned questions take the inferred one; whether each is resolved."""
    rows = questions.join(inferred.withColumnRenamed("topic_id", "inferred"), "id", "left")
    topic = F.when(F.col("manual") | F.col("topic_id").isNotNull(), F.col("topic_id")).otherwise(F.col("inferred"))
    return rows.select("id", topic.alias("topic_id"), (~F.col("manual") & F.col("topic_id").isNull() & F.col("inferred").isNotNull()).alias("assigned"), topic.isNull().alias("unresolved"))


def by_title(df: DataFrame, name: Column, unicode: Callable[[Column], Column] = X.nfkc) -> DataFrame:
    """A row for each title of a topic name; Unassigned without one."""
    titles = X.topic_titles(name, unicode)
    return df.withColumn("title", F.explode(F.when(F.size(titles) == 0, F.array(F.lit("Unassigned"))).otherwise(titles)))


def unit_dimensions(units: DataFrame) -> DataFrame:
    """K1: a column for each dimension a unit shows."""
    for name, pattern in DIMENSIONS.items():
        units = units.withColumn(name, F.col("content").rlike(f"(?iU){pattern}"))
    located = F.col("document_id").isNotNull() & (F.coalesce("source_location", F.lit("")) != "")
    return units.withColumn("source_traceability", located & (F.coalesce("confidence", F.lit(0.0)) >= TRACEABLE_FROM))


def material_coverage(units: DataFrame, keys: list[str]) -> DataFrame:
    """K2: material of each group of units, of which `title` is a key: counts, dimensions covered and missing, state.

    Units have content, document_id, source_location, confidence, review_status, enabled_for_retrieval and problems. Only
    accepted and enabled ones count as material; a problem that speaks of a conflict makes them conflicting.
    """
    ok = (F.col("review_status") == "accepted") & F.coalesce("enabled_for_retrieval", F.lit(True))
    conflict = F.contains(F.lower(F.array_join(F.coalesce("problems", F.array().cast("array<string>")), " ")), F.lit("conflict"))
    names = [*DIMENSIONS, "source_traceability"]
    grouped = unit_dimensions(units).groupBy(*keys).agg(
        F.count_if(ok).alias("accepted"), F.count_if(F.col("review_status") == "needs_review").alias("review"), F.count_if(ok & conflict).alias("conflicts"), *(F.max(ok & F.col(n)).alias(n) for n in names)
    )
    covered = F.array_sort(F.array_compact(F.array(*(F.when(F.col(n), n) for n in names))))
    asked = {n: F.col("title").rlike(f"(?iU){p}") for n, p in NAMED.items()}
    asked["limitation_comparison"] = asked["limitation_comparison"] | F.col("limitation_comparison")
    required = F.array_sort(F.concat(F.array(*map(F.lit, BASE_DIMENSIONS)), F.array_compact(F.array(*(F.when(c, n) for n, c in asked.items())))))
    rows = grouped.withColumn("covered", covered).withColumn("required", required).withColumn("missing", F.array_except("required", "covered"))
    thin = F.size("covered") < F.greatest(F.lit(1), F.floor(F.size("required") / 2))
    state = (
        F.when(F.col("title") == "Unassigned", "unassigned").when(F.col("conflicts") > 0, "conflicting").when((F.col("accepted") == 0) & (F.col("review") > 0), "needs_review")
        .when(F.col("accepted") == 0, "missing").when(F.size("missing") == 0, "complete").when((F.col("review") > 0) & thin, "needs_review").otherwise("partial")
    )
    return rows.select(*keys, "accepted", "review", "conflicts", "covered", "required", "missing", state.alias("material_state"))


def topic_coverage(topics: DataFrame, units: DataFrame, mastery: DataFrame, unicode: Callable[[Column], Column] = X.nfkc) -> DataFrame:
    """K4: what is known of each title of a subject: its topics (topic_ids, topic_id the least one or 0, original_names),
    its material (K2) and its mastery (subject_id, title, n, mastery_state), with state_rank for the order of the table.

    Titles come from the active topics (id, subject_id, name) and from the units (subject_id, topic_id, topic_name, and
    what K2 asks for) that are accepted or wait for a review; units of a topic without a title, or of none, are
    Unassigned. A title without units is missing material, one without answers is not practised.
    """
    named = topics.withColumn("title", F.explode(X.topic_titles(F.col("name"), unicode))).select("subject_id", "title", F.col("id").cast("long").alias("topic_id"), F.col("name").alias("original"))
    placed = by_title(units.where("review_status IN ('accepted', 'needs_review')"), F.col("topic_name"), unicode)
    of_units = placed.select("subject_id", "title", F.col("topic_id").cast("long"), F.coalesce("topic_name", F.lit("Unassigned")).alias("original"))
    known = named.unionByName(of_units).distinct().groupBy("subject_id", "title").agg(F.array_sort(F.collect_set("topic_id")).alias("topic_ids"), F.array_sort(F.collect_set("original")).alias("original_names"))
    material = material_coverage(placed, ["subject_id", "title"]).select("subject_id", "title", "accepted", "review", "conflicts", "material_state")
    rows = known.join(material, ["subject_id", "title"], "left").join(mastery.select("subject_id", "title", "n", "mastery_state"), ["subject_id", "title"], "left")
    rank = F.create_map(*(F.lit(x) for p in STATE_ORDER.items() for x in p))
    state = F.coalesce("material_state", F.when(F.col("title") == "Unassigned", "unassigned").otherwise("missing"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        "subject_id", "title", "topic_ids", F.coalesce(F.try_element_at("topic_ids", F.lit(1)), F.lit(0)).alias("topic_id"), "original_names", zero("accepted"), zero("review"), zero("conflicts"),
        state.alias("material_state"), zero("n"), F.coalesce("mastery_state", F.lit("not_practised")).alias("mastery_state"), rank[state].alias("state_rank"),
    )
