"""Queries on topics, retrieval, gates, pools, reports and grading (D, E, F, G, H, I, K) over the adapter views, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import gates as G
from ..operators import pools as P
from ..operators import progress as J
from ..operators import retrieval as R
from ..operators import topics as D
from .quality import _SEM
from ..sources.adapters import attempts, questions, requests, table, units, with_views
from .planning import ELIGIBLE, eligible, plan_sql
from .progress import FACT, MASTERY, NOW, fact, over_fact


def topics(s, d):
    """The distinct headings of questions as topics."""
    rows = questions(s, d)
    return rows.groupBy("subject_id", "raw_heading").agg(F.min("id").alias("id")).select("id", "subject_id", F.col("raw_heading").alias("name"))


def _headings(s, d):
    """Topics as extracted: some headings hold two titles, some are clean already."""
    name = F.when(F.col("id") % 11 == 0, F.concat("name", F.lit("|Second heading"))).when(F.col("id") % 7 == 0, F.regexp_extract("name", r"(Brand#\d+)", 1)).otherwise(F.col("name"))
    return topics(s, d).withColumn("name", name).withColumn("description", F.when(F.col("id") % 2 == 0, F.lit("from slides")))


def _normalized(s, d):
    """D1 over the headings, the questions below them (some without) and the units of the same ids."""
    placed = questions(s, d).join(topics(s, d).select("subject_id", F.col("name").alias("raw_heading"), F.col("id").alias("topic_id")), ["subject_id", "raw_heading"])
    q = placed.select("id", F.when(F.col("id") % 9 != 0, F.col("topic_id")).alias("topic_id"))
    u = units(s, d).drop("topic_id").join(placed.select("id", "topic_id"), "id", "left").select("id", "topic_id", "review_status", (F.col("id") % 10 != 0).alias("enabled_for_retrieval"))
    return D.normalized(_headings(s, d), u, q)


def _named(s, d):
    """Topics of units: their labels as names."""
    ids = units(s, d).where("topic_id IS NOT NULL").select(F.col("topic_id").cast("bigint").alias("id")).distinct()
    return ids.select("id", F.concat(F.lit("Topic "), F.col("id").cast("string"), F.lit(" model")).alias("name"))


def located(s, d):
    """Units with where they stand, whether retrieval may use them, and their problems."""
    return units(s, d).select(
        "*", F.when(F.col("id") % 8 != 0, F.concat(F.lit("Page "), F.col("source_start").cast("string"))).otherwise("").alias("source_location"), (F.col("id") % 10 != 3).alias("enabled_for_retrieval"),
        F.when(F.col("id") % 97 == 0, F.array(F.lit("broken_formula"), F.lit("Conflicting_source"))).otherwise(F.array(F.lit("broken_formula"))).alias("problems"),
    )


def titled_units(s, d):
    name = F.element_at(F.array(*(F.lit(x) for x in ("Learning model", "Process of control", "Media evaluation", "Unassigned", "Basics"))), (F.col("topic_id") % 5 + 1).cast("int"))
    return located(s, d).withColumn("title", F.when(F.col("topic_id").isNull(), "Unassigned").otherwise(name))


def coverage(s, d):
    """K4 over the headings as topics, where some are active only, and the units of the questions with their ids."""
    at = questions(s, d).join(topics(s, d).select("subject_id", F.col("name").alias("raw_heading"), F.col("id").alias("topic_id")), ["subject_id", "raw_heading"]).select("id", "topic_id")
    names = _headings(s, d).select("id", "subject_id", "name")
    placed = located(s, d).drop("topic_id").join(at, "id", "left").join(names.select(F.col("id").alias("topic_id"), F.col("name").alias("topic_name")), "topic_id", "left")
    practised = J.mastery(fact(s, d).withColumn("title", F.col("topic_name")), ["subject_id", "title"], NOW)
    return D.topic_coverage(names.where("id % 4 != 1"), placed, practised)


def _material(s, d):
    rows = D.material_coverage(titled_units(s, d), ["subject_id", "title"])
    return rows.select("subject_id", "title", "accepted", "review", "conflicts", *(F.array_join(c, ",").alias(c) for c in ("covered", "required", "missing")), "material_state")


def query_vectors(s, d):
    rows = R.corpus(units(s, d)).where("id % 50 = 0")
    return rows.select(F.col("id").alias("query_id"), "subject_id", "vector", F.col("content").alias("text"))


def question_vectors(s, d):
    """Questions with the sum of their two units' vectors; questions on the same units are alike."""
    rows = questions(s, d).select("id", "subject_id", "evidence_id_1", "evidence_id_2")
    for k in (1, 2):
        rows = rows.join(units(s, d).select(F.col("id").alias(f"evidence_id_{k}"), F.col("embedding").alias(f"v{k}")), f"evidence_id_{k}", "left")
    return rows.select("id", "subject_id", F.zip_with("v1", "v2", lambda x, y: x.cast("double") + y.cast("double")).alias("embedding"))


def _nearest(s, d, n=12):
    return R.nearest(query_vectors(s, d), R.corpus(units(s, d)), n)


def _hybrid(s, d):
    near, q, u = _nearest(s, d), query_vectors(s, d), R.corpus(units(s, d))
    return R.hybrid(near, R.overlap(near, q, u), q, u)


def _pool(s, d, k):
    kept = _hybrid(s, d)
    return kept.unionByName(R.rescue(query_vectors(s, d), R.corpus(units(s, d)), kept, k))


def _resolution(s, d):
    """Questions that ask about a unit's first line; some name a source and pages, some one that is not there, some none."""
    rows, u = questions(s, d), R.corpus(units(s, d))
    u = u.select("id", "subject_id", "document_id", "topic_id", F.concat(F.lit("doc"), F.col("document_id").cast("string")).alias("stem"), F.col("source_start").cast("int").alias("page"), "content", "vector")
    line = F.split("content", "\n")[0]
    one, two = u.select(F.col("id").alias("evidence_id_1"), line.alias("line_1"), "vector"), u.select(F.col("id").alias("evidence_id_2"), line.alias("line_2"))
    stem = F.when(F.col("id") % 7 == 0, "doc999").when(F.col("id") % 5 != 0, F.concat(F.lit("doc"), (F.col("id") % 50).cast("string")))
    canonical = F.col("id") % 4 != 1
    q = rows.join(one, "evidence_id_1", "left").join(two, "evidence_id_2", "left").select(
        "id", "subject_id", F.when(F.col("id") % 6 != 0, (F.col("id") % 12).cast("int")).alias("topic_id"), stem.alias("stem"), F.when(F.col("id") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("id") % 7 + 1).cast("int"))).alias("pages"),
        F.concat_ws(" ", "question_text", "line_1").alias("question_text"), F.col("question_type").alias("tags"), F.when(canonical, F.concat_ws(" ", "topic_name", "line_2")).otherwise("").alias("points"), canonical.alias("canonical"), "vector",
    )
    return R.resolve_evidence(q, u).withColumn("relevance", F.round("relevance", 6))


def _words(s, d):
    """The third words of all questions as topics."""
    rows = questions(s, d).select("subject_id", "id", F.element_at(F.split("question_text", "[ ?]"), 3).alias("name"))
    return rows.groupBy("subject_id", "name").agg(F.min("id").alias("id"))


def _line(text, number):
    """A whole line of a text, chosen by a number."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.get(lines, F.pmod(number, F.size(lines)).cast("int"))


def _points(s, d):
    """Points of questions that quote the units they name, some of them wrongly."""
    q = questions(s, d).select(F.col("id").alias("question_id"), F.posexplode(F.array("evidence_id_1", "evidence_id_2")).alias("k", "unit_id"))
    rows = q.join(units(s, d).select(F.col("id").alias("unit_id"), F.col("content").alias("c")), "unit_id", "left")
    line = _line(F.col("c"), F.col("question_id"))
    quote = F.when(F.col("question_id") % 4 == 0, F.concat(F.lit("not in the text "), line)).otherwise(line)
    text = F.when(F.col("question_id") % 5 == 0, F.concat(line, F.lit(" 42"))).when(F.col("question_id") % 7 == 0, _line(F.col("c"), F.col("question_id") + 1)).otherwise(line)
    return rows.select("question_id", "k", "unit_id", F.coalesce(text, F.lit("")).alias("text"), F.coalesce(quote, F.lit("")).alias("source_quote"), (F.col("question_id") % 9 != 0).alias("cited"))


def _asked(s, d):
    """Questions with forms that repeat, from their names' words."""
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("What is the difference between "), "topic_name", F.lit(" and "), "question_type", F.lit("?"))).otherwise(F.col("question_text"))
    return questions(s, d).withColumn("question_text", text)


def _candidates(s, d):
    """Questions as candidates, whose sources are the contents of their two units."""
    return questions(s, d).select("id", "question_text", F.col("topic_name").alias("point_text"), F.array("evidence_id_1", "evidence_id_2").alias("source_ids"))


def _answers(s, d):
    """Answers: the assistant turns, graded against points made of their own and other words."""
    rows = requests(s, d).select(F.col("id").alias("answer_id"), F.col("output_text").alias("answer"), "input_text", F.length("output_text").alias("duration_seconds"))
    points = F.array(_line(F.col("answer"), F.col("answer_id")), _line(F.col("input_text"), F.col("answer_id")), F.lit("quantum chromodynamics lattice"))
    return rows.select("answer_id", "answer", "duration_seconds", F.posexplode(points).alias("k", "text"))


def _concepts(s, d):
    rows = questions(s, d).withColumn("concept_id", F.when(F.col("id") % 17 == 0, F.concat(F.lit("C"), (F.col("id") % 5).cast("string")))).withColumn("source_file", F.when(F.col("id") % 4 == 0, F.concat("topic_name", F.lit(".pdf"))))
    rows = rows.withColumn("source_slides", F.array((F.col("id") % 9).cast("int"))).withColumn("external_id", F.when(F.col("id") % 6 == 1, F.col("id").cast("string")))
    return rows.withColumn("concept", P.concept_key(rows))


def _rubrics(s, d):
    """Questions with the sizes of their rubrics and evidence; the second subject has no pool."""
    rows = _concepts(s, d).where("subject_id <> 2 OR question_pool_id IS NULL")
    return rows.withColumn("n_points", F.when(F.col("id") % 13 != 0, 2).otherwise(0)).withColumn("n_evidence", F.when(F.col("id") % 10 != 7, 1).otherwise(0))


def _imports(s, d):
    q = questions(s, d)
    return q.where("id % 3 <> 1").select("subject_id", F.col("id").alias("line"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("x"), (F.col("id") % 400).cast("string"))).alias("external_id"), F.concat(F.lit("What is "), "topic_name", F.lit(" in "), "difficulty", F.lit("?")).alias("question"), "topic_name", "priority")


def _stored(s, d):
    return questions(s, d).where("id % 3 = 1").select("subject_id", F.concat(F.lit("x"), F.col("id").cast("string")).alias("external_id"), F.concat(F.lit("what is "), "topic_name", F.lit(" in easy?")).alias("question_text"))


def reported(s, d):
    b = table(s, d, "benchmark")
    key = F.col("item_id")
    return b.select(
        F.concat(F.lit("r"), key.cast("string")).alias("stable_id"), (key % 4).alias("subject_id"), F.col("text").alias("wording"), F.element_at(F.array(*map(F.lit, X.PROVENANCE)), (key % 3 + 1).cast("int")).alias("provenance"),
        F.element_at(F.array(*map(F.lit, X.RELIABILITY)), (key % 4 + 1).cast("int")).alias("reliability"), F.when(key % 2 == 0, "active").otherwise("awaiting_course_evidence").alias("activation"),
        F.when(key % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(key % 500, key * 3 % 500)).alias("evidence_ids"), F.when(key % 6 == 0, F.concat(F.lit("c"), (key % 4).cast("string"))).alias("chain_id"), (key % 5).alias("n_actions"),
    )


def _materialized(s, d):
    names = topics(s, d).withColumn("name", F.regexp_extract("name", r"(Brand#1\d)", 1)).where("name <> ''")
    return P.materialized(_imports(s, d).withColumn("topic", F.upper("topic_name")).withColumn("points", F.array("question")), names, 1000)


def _cards(s, d):
    """Reports with the vectors of the units of their numbers, against units; some have questions already, or their wording has."""
    key = F.substring("stable_id", 2, 20).cast("long")
    tags, actions = F.array(F.lit("own project"), F.lit("of_the")), F.transform(F.sequence(F.lit(1), F.col("n_actions").cast("int") + 1), lambda k: F.concat(F.lit("act"), k.cast("string")))
    u = R.corpus(units(s, d))
    r = reported(s, d).select("*", key.alias("n"), F.lit("explanation").alias("question_type"), F.when(key % 3 == 0, "project").otherwise("open").alias("answerability"), tags.alias("topic_tags"), actions.alias("required_actions"))
    r = r.withColumn("wording", F.when(F.col("n") % 7 == 3, "The same wording").otherwise(F.col("wording"))).join(u.select(F.col("id").alias("n"), "vector"), "n", "left")
    stored = r.where("n % 10 IN (1, 2)").select("subject_id", F.when(F.col("n") % 10 == 1, F.col("stable_id")).alias("origin_id"), F.when(F.col("n") % 10 == 1, F.concat(F.lit("linked "), "stable_id")).otherwise(F.upper("wording")).alias("question_text"))
    cards = P.training_cards(r, u, stored.where("question_text <> 'THE SAME WORDING'"), 10)
    listed = F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["k"], p["unit_id"], p["priority"], F.sha2(p["text"], 256))), ",")
    return cards.select("subject_id", "stable_id", "rank", "outcome", "difficulty", F.round("quality_score", 9).alias("quality_score"), F.coalesce(listed, F.lit("")).alias("points"))


def _claims(s, d):
    """Lines of answers as claims in all categories; some cite their evidence, some a unit that is not there, some nothing."""
    rows = _answers(s, d).withColumn("n", F.col("answer_id") + F.col("k"))
    category = F.element_at(F.array(*map(F.lit, ("correct", "missing", "incorrect", "partial", "misplaced"))), (F.col("n") % 5 + 1).cast("int"))
    cited = F.when(F.col("n") % 3 == 0, F.array(F.col("answer_id") % 300)).when(F.col("n") % 7 == 1, F.array(F.col("answer_id") % 300, F.lit(-2).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return rows.select("answer_id", "k", category.alias("category"), "text", cited.alias("cited"), (F.col("n") % 2 == 0).alias("contradicted"))


def _claim_evidence(s, d):
    return requests(s, d).select(F.col("id").alias("answer_id"), F.explode(F.array_distinct(F.array(F.col("id") % 300, F.col("id") % 299))).alias("unit_id"))


def _next(s, d):
    q = questions(s, d).select(F.col("id").alias("question_id"), "subject_id", F.col("id").alias("place"), F.array("evidence_id_1", "evidence_id_2").alias("evidence_ids"))
    sessions = attempts(s, d).groupBy("session_id", "subject_id").agg(F.max(F.col("question_id") % 500).alias("m"))
    sessions = sessions.select("session_id", "subject_id", F.array("m", F.col("m") + 7, F.col("m") + 14).alias("missing_ids"))
    return P.next_questions(sessions, q, attempts(s, d).select("session_id", "question_id").distinct())


QUERIES = {
    "d1_canonical_topics": lambda s, d: D.canonical(topics(s, d)),
    "d1_normalized_topics": lambda s, d: _normalized(s, d).topics,
    "d1_moved_rows": lambda s, d: _normalized(s, d).units.select(F.lit("unit").alias("kind"), "id", "topic_id").unionByName(_normalized(s, d).questions.select(F.lit("question").alias("kind"), "id", "topic_id")),
    "d1_counts": lambda s, d: _normalized(s, d).counts,
    "d2_evidence_counts": lambda s, d: D.evidence_counts(_named(s, d), units(s, d)),
    "d3_active_topics": lambda s, d: D.active(_named(s, d), units(s, d).where("review_status <> 'quarantined'")).select("id", "name"),
    "d4_resolve_topics": lambda s, d: D.resolve(questions(s, d).select("subject_id", F.concat("topic_name", F.lit(" "), "difficulty").alias("name")), topics(s, d).where("id % 2 = 0").withColumn("name", F.concat(F.regexp_extract("name", r"(Brand#\d+)", 1), F.lit(" easy")))),
    "d5_backfill_topics": lambda s, d: D.backfill(units(s, d).select("id", "document_id", "source_start", F.when(F.col("id") % 3 == 0, F.lit("given")).alias("topic_name"), (F.col("id") % 10 == 1).alias("authoritative")), units(s, d).where("id % 2 = 0").select("document_id", F.col("source_start").alias("page"), F.concat(F.lit("T"), F.col("topic_id").cast("string")).alias("title"))),
    "d6_infer_topics": lambda s, d: D.infer(questions(s, d), R.evidence_of(questions(s, d), units(s, d)).join(units(s, d).select(F.col("id").alias("unit_id"), "topic_id"), "unit_id").select(F.col("question_id").alias("id"), F.col("topic_id").cast("bigint").alias("topic_id")), _words(s, d)),
    "d7_reclassify": lambda s, d: D.reclassify(questions(s, d).select("id", F.when(F.col("id") % 4 == 0, F.col("id") % 7).alias("topic_id"), (F.col("id") % 5 == 0).alias("manual")), questions(s, d).select("id", F.when(F.col("id") % 2 == 0, F.lit(3).cast("bigint")).alias("topic_id"))),
    "d8_titles": lambda s, d: D.by_title(questions(s, d), F.concat_ws("|", "raw_heading", "topic_name", "difficulty")).groupBy("subject_id", "title").agg(F.count(F.lit(1)).alias("n")),
    "e1_corpus": lambda s, d: R.corpus(units(s, d)).select("id", "subject_id", F.size("vector").alias("size"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 9).alias("norm")),
    "e2_to_embed": lambda s, d: R.to_embed(units(s, d), units(s, d).where("id % 4 = 0").select(X.sha256(F.col("content")).alias("hash"))).select("hash"),
    "e3_nearest": lambda s, d: _nearest(s, d).withColumn("semantic", F.round("semantic", 9)),
    "e4_hybrid": lambda s, d: _hybrid(s, d).select("query_id", "unit_id", F.round("semantic", 9).alias("semantic"), F.round("score", 9).alias("score")),
    "e5_rescue": lambda s, d: R.rescue(query_vectors(s, d), R.corpus(units(s, d)), _hybrid(s, d)).select("query_id", "unit_id", F.round("score", 9).alias("score")),
    "e6_diversified": lambda s, d: R.diversified(_pool(s, d, 6).withColumn("score", F.round("score", 9)), units(s, d), 6),
    "e7_still_active": lambda s, d: R.still_active(_nearest(s, d).select("query_id", "unit_id"), units(s, d), units(s, d).withColumn("content", F.when(F.col("id") % 6 == 0, F.lit("changed")).otherwise(F.col("content")))),
    "e9_notes": lambda s, d: R.notes(query_vectors(s, d), units(s, d).select(F.col("id").alias("note_id"), "subject_id", "document_id", F.col("source_start").alias("page"), "content", (F.col("id") * 7 % 1000).alias("updated_at"))).select("query_id", "note_id", "shared", "place", "source"),
    "e10_query_texts": lambda s, d: R.query_texts(table(s, d, "conversations").where("role = 'user'")).select("conv_id", "turn", "query_text"),
    "e12_evidence_resolution": _resolution,
    "e13_evidence_of": lambda s, d: R.evidence_of(questions(s, d), units(s, d)),
    "f1_schema": lambda s, d: G.schema_problems(questions(s, d).withColumn("points", F.array(F.struct(F.col("topic_name").alias("text"), F.col("question_text").alias("source_quote"))))).select("id", F.array_join("problems", ",").alias("problems")),
    "f2_form": lambda s, d: G.form_problems(_asked(s, d)).select("id", F.array_join("problems", ",").alias("problems")),
    "f4_points": lambda s, d: G.point_problems(_points(s, d), units(s, d)).select("question_id", "k", F.array_join("problems", ",").alias("problems")),
    "f5_concepts": lambda s, d: G.concept_problems(_candidates(s, d), units(s, d).select(F.col("id").alias("source_id"), "content")).select("id", F.array_join("problems", ",").alias("problems")),
    "f6_comparisons": lambda s, d: G.comparison_problems(_asked(s, d).withColumn("rubric", F.concat_ws(" ", "topic_name", "question_type"))).select("id", F.array_join("problems", ",").alias("problems")),
    "f7_subsumed": lambda s, d: G.subsumed(_points(s, d).where("question_id % 2 = 0"), _points(s, d).where("question_id % 2 = 1")),
    "f8_near_questions": lambda s, d: G.near_questions(questions(s, d), questions(s, d), letters=False, only=f"jaccard > {G.SAME_TERMS} OR prefix", digits=9).select("id", "other_id", "jaccard", "prefix"),
    "f8_duplicate_questions": lambda s, d: G.repeated_questions(questions(s, d).where("id % 50 = 0"), questions(s, d)).select("id", "other_id"),
    "f9_vector_problems": lambda s, d: G.vector_problems(units(s, d).select("id", F.when(F.col("id") % 13 == 0, F.transform("embedding", lambda x: x * 0)).when(F.col("id") % 17 != 0, F.col("embedding")).alias("embedding"))),
    "f9_vector_duplicates": lambda s, d: G.vector_duplicates(question_vectors(s, d).where("id % 50 = 0"), question_vectors(s, d)).withColumn("cosine", F.round("cosine", 6)),
    "f10_verdicts": lambda s, d: G.verdicts(questions(s, d).select("id", (F.col("id") % 3 != 0).alias("grounded"), (F.col("id") % 4 != 0).alias("clear"), (F.col("id") % 5 == 0).alias("duplicate"), F.when(F.col("id") % 7 == 0, F.array(F.lit("low_quality"))).otherwise(F.array().cast("array<string>")).alias("reasons")), ["grounded", "clear"]).withColumn("reasons", F.array_join("reasons", ",")),
    "f11_storable": lambda s, d: G.storable(questions(s, d).where("review_status = 'accepted'"), questions(s, d).where("review_status <> 'accepted'")).select("id", "subject_id"),
    "f12_acceptance": lambda s, d: G.acceptance(questions(s, d).withColumn("has_rubric", F.col("id") % 8 != 0), units(s, d)),
    "f13_citation_gate": lambda s, d: G.citation_gate(questions(s, d).select("id", F.array("evidence_id_1").alias("referenced"), F.when(F.col("id") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array("evidence_id_2")).alias("cited"), F.array("evidence_id_1", F.col("id") % 250).alias("allowed"))).withColumn("unknown", F.array_join(F.transform("unknown", lambda x: x.cast("string")), ",")),
    "f14_uncovered_targets": lambda s, d: G.uncovered_targets(units(s, d).select(F.col("id").alias("unit_id"), F.posexplode(F.split("content", r"(?<=[.!?])\s+")).alias("k", "sentence")), units(s, d).select(F.col("id").alias("unit_id"), _line(F.col("content"), F.col("id")).alias("text"))).select("unit_id", "k"),
    "f15_evidence_batches": lambda s, d: G.evidence_batches(units(s, d).where("review_status = 'accepted'")),
    "f16_coverage_targets": lambda s, d: G.coverage_targets(G.evidence_batches(units(s, d).where("review_status = 'accepted'")), units(s, d), eligible(s, d)),
    "g1_preview": lambda s, d: P.preview(_imports(s, d), _stored(s, d)),
    "g2_counts": lambda s, d: P.counts(P.preview(_imports(s, d), _stored(s, d)).where("reason IS NULL").join(_imports(s, d).select("line", "priority"), "line"), "priority"),
    "g3_materialized": lambda s, d: _materialized(s, d)[0].select("subject_id", "number", "topic_id", "creates_topic", "question", F.size("points").alias("n_points")),
    "g3_created_topics": lambda s, d: _materialized(s, d)[1],
    "g4_disable": lambda s, d: P.disable(questions(s, d), s.range(1).select(F.lit(2).cast("bigint").alias("pool_id"))).select("id", "enabled"),
    "g5_listed": lambda s, d: P.listed(questions(s, d).withColumn("topic_id", F.col("id") % 20).withColumn("topic_name", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("topic_name"))), _named(s, d), True).select("id", "topic"),
    "g7_practice_candidates": lambda s, d: P.practice_candidates(questions(s, d), difficulties=["easy", "hard"], priorities=["A"]).select("id", "subject_id", "difficulty"),
    "g8_recent": lambda s, d: P.recent(attempts(s, d), 5),
    "g9_balanced_sample": lambda s, d: P.balanced_sample(_concepts(s, d), P.recent(attempts(s, d), 5), 8, 7),
    "g10_mock_pool": lambda s, d: P.mock_pool(_rubrics(s, d)).select("id", "subject_id", "concept"),
    "g11_mock_order": lambda s, d: P.question_order(P.mock_pool(_rubrics(s, d)), questions(s, d).where("id % 21 = 0").select("subject_id", "id", (-F.col("id")).alias("place")), 8),
    "g11_question_order": lambda s, d: P.question_order(questions(s, d), questions(s, d).where("id % 21 = 0").select("subject_id", "id", (-F.col("id")).alias("place"))),
    "g12_next_question": _next,
    "b18_concept_keys": lambda s, d: _concepts(s, d).select("id", "concept"),
    "h1_import_reported": lambda s, d: P.import_reported(reported(s, d), reported(s, d).where("n_actions < 3").withColumn("wording", F.when(F.col("n_actions") == 0, "old").otherwise(F.col("wording")))),
    "h2_activation": lambda s, d: P.activation(reported(s, d), units(s, d)),
    "h3_reported_list": lambda s, d: P.reported_list(reported(s, d), reliability="current", query="THE").select("stable_id", "chain_id"),
    "h4_substantive": lambda s, d: units(s, d).select("id", P.substantive(F.col("content"), F.when(F.col("id") % 2 == 0, "project").otherwise("open"), F.array(F.lit("own project"), F.lit("of_the"))).alias("substantive")),
    "h5_training_cards": _cards,
    "i1_grade_points": lambda s, d: G.grade_points(_answers(s, d)).select("answer_id", "k", F.round("overlap", 9).alias("overlap"), "verdict"),
    "i2_grade_answers": lambda s, d: G.grade_answers(G.grade_points(_answers(s, d))),
    "i3_prune_claims": lambda s, d: G.prune_claims(_claims(s, d), _claim_evidence(s, d), units(s, d).select(F.col("id").alias("unit_id"), "content")).withColumn("cited", F.array_join(F.transform("cited", lambda x: x.cast("string")), ",")),
    "i4_evaluation_guard": lambda s, d: G.evaluation_guard(attempts(s, d).select("id", (F.col("id") % 3).alias("linked"), F.least(F.col("id") % 3, F.col("id") % 2).alias("current"), (F.col("id") % 5 != 0).alias("has_rubric"))),
    "i5_corrected": lambda s, d: G.corrected(attempts(s, d), attempts(s, d).where("id % 3 = 0").select((F.col("id") - F.col("id") % 9).alias("attempt_id"), F.col("id").alias("correction_id"), (F.col("id") % 6).cast("double").alias("score"))),
    "k1_dimensions": lambda s, d: D.unit_dimensions(located(s, d)).select("id", *D.DIMENSIONS, "source_traceability"),
    "k2_material_coverage": _material,
    "k4_topic_coverage": lambda s, d: coverage(s, d).withColumn("topic_ids", F.array_join(F.transform("topic_ids", lambda x: x.cast("string")), ",")).withColumn("original_names", F.array_join("original_names", "~")),
}


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_TITLE = "coalesce(['Learning model', 'Process of control', 'Media evaluation', 'Unassigned', 'Basics'][topic_id % 5 + 1], 'Unassigned')"
_TRACED = "confidence >= 0.7 AND id % 8 <> 0"
_USED = "review_status = 'accepted' AND id % 10 <> 3"


def material_sql(titled: str) -> str:
    """K2 as CTEs that end in `material`, over the CTE that `titled` begins (u: units with title)."""
    return f"""{titled}, ud AS (SELECT *, id % 97 = 0 AS conflict, {_USED} AS used, {_DIMS}, {_TRACED} AS source_traceability FROM u),
        mg AS (SELECT subject_id, title, count(*) FILTER (used) AS accepted, count(*) FILTER (review_status = 'needs_review') AS review, count(*) FILTER (used AND conflict) AS conflicts, {", ".join(f"bool_or(used AND {n}) AS {n}" for n in _ALL)} FROM ud GROUP BY ALL),
        ml AS (SELECT *, list_sort(list_filter([{", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in _ALL)}], lambda x: x IS NOT NULL)) AS covered, list_sort(list_filter([{", ".join(map(_q, D.BASE_DIMENSIONS))}, {", ".join(f"CASE WHEN regexp_matches(title, {_q('(?i)' + p)}){' OR limitation_comparison' if n == 'limitation_comparison' else ''} THEN '{n}' END" for n, p in D.NAMED.items())}], lambda x: x IS NOT NULL)) AS required FROM mg),
        mm AS (SELECT *, list_filter(required, lambda x: NOT list_contains(covered, x)) AS missing FROM ml),
        material AS (SELECT subject_id, title, accepted, review, conflicts, covered, required, missing, CASE WHEN title = 'Unassigned' THEN 'unassigned' WHEN conflicts > 0 THEN 'conflicting'
        WHEN accepted = 0 AND review > 0 THEN 'needs_review' WHEN accepted = 0 THEN 'missing' WHEN len(missing) = 0 THEN 'complete' WHEN review > 0 AND len(covered) < greatest(1, len(required) // 2) THEN 'needs_review' ELSE 'partial' END AS material_state FROM mm)"""


_DIMS = ", ".join(f"regexp_matches(content, {_q('(?i)' + p)}) AS {n}" for n, p in D.DIMENSIONS.items())
_ALL = [*D.DIMENSIONS, "source_traceability"]
_TOKENS = "list_distinct(regexp_extract_all(lower({}), '[A-Za-zÀ-ÖØ-öø-ÿ0-9]{{3,}}'))"
_NOTE_TERMS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{3,}}'))"
_MEANINGFUL = f"list_filter(q.tokens, lambda t: t NOT IN ({', '.join(map(_q, R.RESCUE_STOP))}))"
CORPUS = f"""corpus AS (SELECT id, subject_id, document_id, content, {_TOKENS.format("content")} AS tokens, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM units WHERE review_status = 'accepted' AND embedding IS NOT NULL),
    pairs AS (SELECT q.id AS query_id, c.id AS unit_id, c.document_id, c.content, list_cosine_similarity(q.v, c.v) AS semantic, len(list_intersect(q.tokens, c.tokens)) AS shared, greatest(1, len(q.tokens)) AS terms,
        {_MEANINGFUL} AS asked, list_intersect({_MEANINGFUL}, c.tokens) AS met, q.content AS query_text FROM corpus q JOIN corpus c USING (subject_id) WHERE q.id % 50 = 0),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, unit_id) AS place FROM pairs QUALIFY place <= 12),
    hybrid AS (SELECT query_id, unit_id, document_id, semantic, 0.82::DOUBLE * semantic + 0.18::DOUBLE * shared / terms AS score FROM near WHERE 0.82::DOUBLE * semantic + 0.18::DOUBLE * shared / terms >= 0.28
        QUALIFY row_number() OVER (PARTITION BY query_id, lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))) ORDER BY 0.82::DOUBLE * semantic + 0.18::DOUBLE * shared / terms DESC, unit_id) = 1),
    rescue AS (SELECT query_id, unit_id, document_id, greatest(0.28::DOUBLE, 0.35::DOUBLE + 0.35::DOUBLE * len(met) / greatest(1, len(asked))) AS score FROM pairs
        WHERE (len(met) >= 2 OR len(list_filter(met, lambda t: contains(query_text, upper(t)) AND contains(content, upper(t)))) > 0) AND (query_id, unit_id) NOT IN (SELECT (query_id, unit_id) FROM hybrid)),
    pool AS (SELECT query_id, unit_id, document_id, round(score, 9) AS score FROM hybrid UNION ALL SELECT query_id, unit_id, document_id, round(score, 9) FROM rescue)"""
def _evidence(t: str) -> str:
    """B11b as a list."""
    return f"list_filter(list_distinct(regexp_extract_all(replace(lower({t}), 'ß', 'ss'), '[A-Za-zÀ-ÖØ-öø-ÿ0-9]{{2,}}')), lambda w: w NOT IN ({', '.join(map(_q, X.STOP_WORDS))}))"


def _relevance(exact: str) -> str:
    """E11 over q.expected and q.asked, c.evidence."""
    part = lambda t, n: f"len(list_intersect({t}, c.evidence))::DOUBLE / greatest(1, least(len({t}), {n}))"
    return f"least(1.0::DOUBLE, CASE WHEN {exact} THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END + 0.3::DOUBLE * {part('q.expected', 12)} + 0.15::DOUBLE * {part('q.asked', 8)})"


def _search_sql(name: str, queries: str, k: int) -> str:
    """E3-E6 for one query set: `name` holds query_id, unit_id, place."""
    near = f"""{name}_p AS (SELECT q.id AS query_id, c.id AS unit_id, c.document_id, c.content, (q.topic_id IS NULL OR q.topic_id = c.topic_id) AS fits, list_cosine_similarity(q.v, c.v) AS semantic, len(list_intersect(q.tokens, c.tokens)) AS shared,
        greatest(1, len(q.tokens)) AS terms, {_MEANINGFUL} AS m, list_intersect({_MEANINGFUL}, c.tokens) AS met, q.question_text AS text FROM {queries} q JOIN c USING (subject_id)),
    {name}_n AS (SELECT * FROM {name}_p WHERE semantic IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, unit_id) <= {max(4 * k, 12)}),
    {name}_h AS (SELECT query_id, unit_id, document_id, 0.82::DOUBLE * semantic + 0.18::DOUBLE * shared / terms AS score FROM {name}_n WHERE fits AND 0.82::DOUBLE * semantic + 0.18::DOUBLE * shared / terms >= 0.28
        QUALIFY row_number() OVER (PARTITION BY query_id, lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))) ORDER BY 0.82::DOUBLE * semantic + 0.18::DOUBLE * shared / terms DESC, unit_id) = 1),
    {name}_r AS (SELECT query_id, unit_id, document_id, greatest(0.28::DOUBLE, 0.35::DOUBLE + 0.35::DOUBLE * len(met) / greatest(1, len(m))) AS score FROM {name}_p
        WHERE fits AND (len(met) >= 2 OR len(list_filter(met, lambda t: contains(text, upper(t)) AND contains(content, upper(t)))) > 0) AND (query_id, unit_id) NOT IN (SELECT (query_id, unit_id) FROM {name}_h)),
    {name}_u AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, unit_id) AS w FROM (FROM {name}_h UNION ALL FROM {name}_r)),
    {name}_f AS (SELECT *, w = 1 AND row_number() OVER (PARTITION BY query_id, w = 1 ORDER BY score DESC, unit_id) <= 2 AS head FROM {name}_u),
    {name} AS (SELECT query_id, unit_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY head DESC, score DESC, unit_id) AS place FROM {name}_f) WHERE place <= {k})"""
    return near


def _resolution_sql() -> str:
    return with_views("questions units", f"""
    c AS (SELECT id, subject_id, document_id, topic_id, 'doc' || document_id AS stem, source_start AS page, content, {_TOKENS.format("content")} AS tokens, {_evidence("content")} AS evidence, list_transform(embedding, lambda x: x::DOUBLE) AS v
        FROM units WHERE review_status = 'accepted' AND embedding IS NOT NULL),
    q0 AS (SELECT q.id, q.subject_id, CASE WHEN q.id % 6 <> 0 THEN q.id % 12 END AS topic_id, CASE WHEN q.id % 7 = 0 THEN 'doc999' WHEN q.id % 5 <> 0 THEN 'doc' || (q.id % 50) END AS stem, CASE WHEN q.id % 3 = 0 THEN NULL ELSE q.id % 7 + 1 END AS page,
        concat_ws(' ', question_text, split_part(a.content, chr(10), 1)) AS question_text, question_type, CASE WHEN q.id % 4 <> 1 THEN concat_ws(' ', topic_name, split_part(b.content, chr(10), 1)) ELSE '' END AS points, q.id % 4 <> 1 AS canonical, a.v
        FROM questions q LEFT JOIN c a ON a.id = evidence_id_1 LEFT JOIN c b ON b.id = evidence_id_2),
    q AS (SELECT *, {_TOKENS.format("question_text")} AS tokens, {_evidence("points")} AS expected, {_evidence("question_text || ' ' || question_type")} AS asked FROM q0),
    s AS (SELECT q.id, c.id AS unit_id, c.page, q.canonical, q.page IS NOT NULL AS wants, coalesce(c.page BETWEEN q.page - 1 AND q.page + 1, FALSE) AS near, c.page = q.page AS exact,
        {_relevance("coalesce(c.page BETWEEN q.page - 1 AND q.page + 1, FALSE)")} AS relevance FROM q JOIN c ON c.subject_id = q.subject_id AND c.stem = q.stem),
    o AS (SELECT *, CASE WHEN near THEN 'near' WHEN relevance >= 0.12 THEN 'evidence' ELSE 'rejected' END AS role FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY id, role ORDER BY CASE WHEN near THEN (CASE WHEN exact THEN 0 ELSE 1 END) END, CASE WHEN near THEN page ELSE -relevance END, page, unit_id) AS place FROM o),
    g AS (SELECT id, bool_or(role = 'near') AS n, bool_or(role = 'evidence') AS e, any_value(canonical) AS canonical, any_value(wants) AS wants FROM o GROUP BY id),
    t AS (SELECT id, wants AND (n OR canonical) AS paged, n, e FROM g WHERE (wants AND (n OR canonical)) OR e OR canonical),
    t2 AS (SELECT id, paged, CASE WHEN paged THEN 'exact_source' ELSE 'source_search' END AS strategy, CASE WHEN paged AND n THEN 'exact_source' WHEN NOT paged AND e THEN 'source_search' ELSE 'canonical_only' END AS status FROM t),
    first_tiers AS (SELECT t2.id, strategy, status, TRUE AS sufficient, CASE WHEN k.role = 'near' THEN 'evidence' ELSE k.role END AS role, unit_id, relevance, place FROM t2 LEFT JOIN k ON k.id = t2.id AND place <= 5 AND (NOT paged OR k.role = 'near')),
    rest AS (SELECT * FROM q WHERE id NOT IN (SELECT id FROM t)),
    {_search_sql("f1", "rest", 10)},
    rest2 AS (SELECT * REPLACE (CAST(NULL AS BIGINT) AS topic_id) FROM rest WHERE topic_id IS NOT NULL AND id NOT IN (SELECT query_id FROM f1)),
    {_search_sql("f2", "rest2", 10)},
    h AS (SELECT q.id, q.canonical, f.unit_id, f.place AS found_at, {_relevance("FALSE")} AS relevance FROM (FROM f1 UNION ALL FROM f2) f JOIN q ON q.id = f.query_id JOIN c ON c.id = f.unit_id),
    h2 AS (SELECT *, CASE WHEN relevance >= 0.12 THEN 'evidence' ELSE 'rejected' END AS role FROM h),
    h3 AS (SELECT *, row_number() OVER (PARTITION BY id, role ORDER BY found_at) AS place FROM h2),
    last_tiers AS (SELECT rest.id, CASE WHEN topic_id IS NOT NULL THEN 'topic_search' ELSE 'fallback' END AS strategy, CASE WHEN e.id IS NOT NULL THEN 'fallback' WHEN rest.canonical THEN 'canonical_only' ELSE 'poor' END AS status,
        e.id IS NOT NULL OR rest.canonical AS sufficient, role, unit_id, relevance, place FROM rest LEFT JOIN (SELECT DISTINCT id FROM h2 WHERE role = 'evidence') e ON e.id = rest.id LEFT JOIN h3 ON h3.id = rest.id AND place <= 5)
    SELECT id, strategy, status, sufficient, role, unit_id, round(relevance, 6) AS relevance, place FROM (FROM first_tiers UNION ALL FROM last_tiers)""")


REPORTED = f"""reported AS (SELECT 'r' || item_id AS stable_id, item_id % 4 AS subject_id, text AS wording, [{", ".join(map(_q, X.RELIABILITY))}][item_id % 4 + 1] AS reliability, CASE WHEN item_id % 2 = 0 THEN 'active' ELSE 'awaiting_course_evidence' END AS activation,
    CASE WHEN item_id % 5 = 0 THEN [] ELSE [item_id % 500, item_id * 3 % 500] END AS evidence_ids, CASE WHEN item_id % 6 = 0 THEN 'c' || (item_id % 4) END AS chain_id, item_id % 5 AS n_actions FROM benchmark)"""
CONCEPTS = f"""concepts AS (SELECT *, CASE WHEN id % 17 = 0 THEN 'concept:c' || (id % 5) WHEN id % 4 = 0 THEN 'source:' || regexp_replace(lower(topic_name), '[^a-z0-9]+', '', 'g') || ':' || (id % 9) || '-' || (id % 9)
    WHEN id % 6 = 1 THEN 'external:' || id ELSE 'terms:' || array_to_string(list_sort(list_filter({_TOKENS.format("question_text")}, lambda t: t NOT IN ({", ".join(map(_q, P.CONCEPT_STOP))})))[1:8], ',') END AS concept FROM questions)"""
_MOCK = """ok AS (SELECT * FROM concepts WHERE review_status = 'accepted' AND enabled AND id % 13 <> 0 AND (question_pool_id IS NOT NULL OR id % 10 <> 7)), a AS (SELECT *, max((question_pool_id IS NOT NULL AND subject_id <> 2)::INT) OVER (PARTITION BY subject_id) AS has FROM ok WHERE subject_id <> 2 OR question_pool_id IS NULL),
    mock AS (SELECT * FROM a WHERE question_pool_id IS NOT NULL OR has = 0 QUALIFY row_number() OVER (PARTITION BY subject_id, concept ORDER BY quality_score DESC, id) = 1)"""
RECENT = "recent AS (SELECT DISTINCT user_id, subject_id, question_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, subject_id ORDER BY created_at DESC, id DESC) AS k FROM attempts) WHERE k <= 10)"
def recursive(names: str, body: str) -> str:
    return with_views(names, body).replace("WITH ", "WITH RECURSIVE ", 1)


_IMPORTS = """imports AS (SELECT subject_id, id AS line, CASE WHEN id % 2 = 0 THEN 'x' || (id % 400) END AS external_id, 'What is ' || topic_name || ' in ' || difficulty || '?' AS question, topic_name, priority FROM questions WHERE id % 3 <> 1),
    stored AS (SELECT subject_id, 'x' || id AS external_id, 'what is ' || topic_name || ' in easy?' AS question_text FROM questions WHERE id % 3 = 1),
    p1 AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY line) AS n, (subject_id, external_id) IN (SELECT (subject_id, external_id) FROM stored) AS stored_id,
        (subject_id, lower(question)) IN (SELECT (subject_id, lower(question_text)) FROM stored) AS stored_text FROM imports),
    fold AS (SELECT DISTINCT subject_id, 0::BIGINT AS n, NULL::VARCHAR AS reason, []::VARCHAR[] AS ids, []::VARCHAR[] AS texts FROM imports UNION ALL
        SELECT subject_id, n, reason, CASE WHEN reason IS NULL AND external_id IS NOT NULL THEN list_append(ids, external_id) ELSE ids END, CASE WHEN reason IS NULL THEN list_append(texts, text) ELSE texts END
        FROM (SELECT p1.subject_id, p1.n, external_id, lower(question) AS text, ids, texts, CASE WHEN external_id IS NOT NULL AND (stored_id OR list_contains(ids, external_id)) THEN 'duplicate external ID'
            WHEN stored_text OR list_contains(texts, lower(question)) THEN 'duplicate question text' END AS reason FROM fold JOIN p1 ON p1.subject_id = fold.subject_id AND p1.n = fold.n + 1)),
    preview AS (SELECT p1.*, fold.reason FROM p1 JOIN fold USING (subject_id, n))"""

_LIST = lambda values: "[" + ", ".join(map(_q, values)) + "]"
_KEY = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
_SAME = """s AS (SELECT id, subject_id, raw_heading AS name, topic_name AS title FROM (SELECT subject_id, raw_heading, min(id) AS id, any_value(topic_name) AS topic_name FROM questions GROUP BY subject_id, raw_heading))"""


def _normalized_sql(body: str) -> str:
    """Topics with what becomes of them (m), units and questions under their new topics (mu, mq)."""
    return with_views("questions units", f"""{_SAME}, t AS (SELECT id, subject_id, CASE WHEN id % 11 = 0 THEN name || '|Second heading' WHEN id % 7 = 0 THEN title ELSE name END AS name, CASE WHEN id % 11 <> 0 THEN title END AS title,
        CASE WHEN id % 2 = 0 THEN 'from slides' END AS description FROM s),
    f AS (SELECT subject_id, title, min(id) AS first FROM t WHERE title IS NOT NULL GROUP BY ALL),
    h AS (SELECT t.subject_id, t.title, coalesce(min(id) FILTER (id <> first AND lower(name) = lower(t.title)), min(first)) AS new_id FROM t JOIN f USING (subject_id, title) GROUP BY ALL),
    m AS (SELECT t.*, h.new_id FROM t LEFT JOIN h USING (subject_id, title)),
    p AS (SELECT q.id, s.id AS topic_id FROM questions q JOIN s ON s.subject_id = q.subject_id AND s.name = q.raw_heading),
    mq AS (SELECT p.id, m.new_id AS topic_id FROM p LEFT JOIN m ON m.id = p.topic_id AND p.id % 9 <> 0),
    mu AS (SELECT u.id, m.new_id AS topic_id, review_status, u.id % 10 <> 0 AS on_ FROM units u LEFT JOIN p ON p.id = u.id LEFT JOIN m ON m.id = p.topic_id) {body}""")


_MATERIALIZED = f"""{_SAME}, t AS (SELECT subject_id, upper(title) AS name, min(id) AS known FROM s WHERE regexp_full_match(title, 'Brand#1\\d') GROUP BY ALL),
    i AS (SELECT q.subject_id, q.id AS line, 'What is ' || topic_name || ' in ' || difficulty || '?' AS question, upper(topic_name) AS name, known FROM questions q LEFT JOIN t ON t.subject_id = q.subject_id AND t.name = upper(topic_name) WHERE id % 3 <> 1),
    n AS (SELECT subject_id, name, (SELECT max(id) FROM s WHERE regexp_full_match(title, 'Brand#1\\d')) + row_number() OVER (ORDER BY subject_id, lower(name)) AS new_id FROM (SELECT DISTINCT subject_id, name FROM i WHERE known IS NULL))"""


def _cards_sql() -> str:
    base = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in X.RELIABILITY.items())
    change = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in X.PROVENANCE.items())
    return with_views("units", f"""{REPORTED}, c AS (SELECT id, subject_id, document_id, topic_id, content, {_TOKENS.format("content")} AS tokens, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM units WHERE review_status = 'accepted' AND embedding IS NOT NULL),
    b AS (SELECT r.* REPLACE (CASE WHEN item % 7 = 3 THEN 'The same wording' ELSE wording END AS wording), {_LIST(X.PROVENANCE)}[item % 3 + 1] AS provenance, CASE WHEN item % 3 = 0 THEN 'project' ELSE 'open' END AS answerability FROM (SELECT *, CAST(stable_id[2:] AS BIGINT) AS item FROM reported) r),
    o AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY reliability <> 'current', provenance <> 'exact_reported', coalesce(chain_id, stable_id), stable_id) AS rank FROM b QUALIFY rank <= 10),
    q AS (SELECT item AS id, subject_id, NULL::BIGINT AS topic_id, wording || ' own project of_the' || list_reduce(list_prepend('', range(1, n_actions + 2)::VARCHAR[]), lambda a, k: a || ' act' || k) AS question_text, c.v, {_TOKENS.format("question_text")} AS tokens
        FROM (SELECT o.*, wording || ' own project of_the' || list_reduce(list_prepend('', range(1, n_actions + 2)::VARCHAR[]), lambda a, k: a || ' act' || k) AS question_text FROM o WHERE item % 10 <> 1) o LEFT JOIN (SELECT id AS cid, v FROM c) c ON c.cid = o.item),
    {_search_sql("f", "q", 8)},
    w AS (SELECT f.query_id, f.unit_id, f.place, trim(c.content, ' ') AS text, trim(regexp_replace(c.content, '\\s+', ' ', 'g')) AS flat, answerability FROM f JOIN c ON c.id = f.unit_id JOIN o ON o.item = f.query_id),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS k FROM w WHERE length(flat) >= 80 AND len(regexp_extract_all(flat, '[A-Za-zÀ-ÖØ-öø-ÿ]{{3,}}')) >= 10 AND NOT regexp_full_match(flat, '(?i)https?://\\S+') AND (answerability <> 'project' OR contains(lower(flat), 'of the')) QUALIFY k <= 3),
    p AS (SELECT query_id, string_agg(k || ':' || unit_id || ':' || CASE WHEN k <= 2 THEN 'must_know' ELSE 'useful_detail' END || ':' || sha256(text), ',' ORDER BY k) AS points FROM h GROUP BY query_id),
    known AS (SELECT DISTINCT subject_id, {_KEY.format("upper(wording)")} AS key FROM b WHERE item % 10 = 2 AND wording <> 'The same wording'),
    z AS (SELECT o.*, p.points, {_KEY.format("wording")} AS key, item % 10 = 1 AS linked FROM o LEFT JOIN p ON p.query_id = o.item),
    y AS (SELECT z.*, known.key IS NOT NULL AS known, row_number() OVER (PARTITION BY z.subject_id, z.key, NOT linked AND points IS NOT NULL AND known.key IS NULL ORDER BY rank) > 1 AS earlier FROM z LEFT JOIN known ON known.subject_id = z.subject_id AND known.key = z.key),
    x AS (SELECT *, CASE WHEN linked THEN 'existing' WHEN points IS NULL THEN 'unmatched' WHEN known OR earlier THEN 'skipped' ELSE 'created' END AS outcome FROM y)
    SELECT subject_id, stable_id, CAST(rank AS INT) AS rank, outcome, CASE WHEN n_actions + 1 >= 3 THEN 'hard' ELSE 'medium' END AS difficulty, round(least(1.0, greatest(0.0, CASE reliability {base} ELSE 0.5 END + CASE provenance {change} ELSE 0.0 END)), 9) AS quality_score,
        CASE WHEN outcome = 'created' THEN points ELSE '' END AS points FROM x""")


ORACLE_SQL = {
    "d1_canonical_topics": with_views("questions", f"""{_SAME}, h AS (SELECT subject_id, title, min(id) AS new_id FROM s GROUP BY ALL)
        SELECT id, subject_id, name, new_id, title AS new_name, CASE WHEN new_id <> id THEN 'merged' ELSE 'renamed' END AS action FROM s JOIN h USING (subject_id, title)"""),
    "d1_normalized_topics": _normalized_sql("""SELECT h.id, h.subject_id, h.title AS name, CASE WHEN h.title <> h.name AND h.id = h.new_id THEN trim(coalesce(h.description, '') || chr(10) || 'Original source heading: ' || h.name, ' ' || chr(10)) ELSE h.description END AS description,
        (SELECT count(*) FROM mu WHERE mu.topic_id = h.id AND review_status = 'accepted' AND on_) AS evidence_count FROM m h WHERE h.new_id = h.id AND h.id IN (SELECT topic_id FROM mq UNION ALL SELECT topic_id FROM mu)"""),
    "d1_moved_rows": _normalized_sql("SELECT 'unit' AS kind, id, topic_id FROM mu UNION ALL SELECT 'question', id, topic_id FROM mq"),
    "d1_counts": _normalized_sql("""SELECT subject_id, count(*) FILTER (new_id = id AND title <> name) AS renamed, count(*) FILTER (new_id <> id) AS merged, count(*) FILTER (title IS NULL) AS moved_to_unassigned,
        count(*) FILTER (new_id = id AND id NOT IN (SELECT topic_id FROM mq WHERE topic_id IS NOT NULL UNION ALL SELECT topic_id FROM mu WHERE topic_id IS NOT NULL)) AS deleted_orphans FROM m GROUP BY subject_id"""),
    "d4_resolve_topics": with_views("questions", f"""{_SAME}, w AS (SELECT DISTINCT subject_id, {_KEY.format("topic_name || ' ' || difficulty")} AS key FROM questions),
        k AS (SELECT subject_id, {_KEY.format("title || ' easy'")} AS key, min(id) AS id FROM s WHERE id % 2 = 0 GROUP BY ALL), j AS (SELECT * FROM w LEFT JOIN k USING (subject_id, key))
        SELECT subject_id, key, coalesce(id, (SELECT max(id) FROM s WHERE id % 2 = 0) + row_number() OVER (PARTITION BY id IS NULL ORDER BY subject_id, key)) AS id, id IS NULL AS created FROM j"""),
    "d2_evidence_counts": with_views("units", "SELECT r.id, count(u.id) AS evidence_count FROM (SELECT DISTINCT topic_id::BIGINT AS id FROM units WHERE topic_id IS NOT NULL) r LEFT JOIN units u ON u.topic_id = r.id AND u.review_status = 'accepted' GROUP BY r.id"),
    "d3_active_topics": with_views("units", "SELECT DISTINCT topic_id::BIGINT AS id, 'Topic ' || topic_id || ' model' AS name FROM units WHERE review_status <> 'quarantined' AND topic_id IS NOT NULL"),
    "d5_backfill_topics": with_views("units", """h AS (SELECT document_id, source_start, min('T' || topic_id) AS title FROM units WHERE id % 2 = 0 GROUP BY ALL HAVING count(DISTINCT topic_id) = 1)
        SELECT id, CASE WHEN id % 3 = 0 THEN 'given' WHEN id % 10 = 1 THEN NULL ELSE title END AS topic_name FROM units LEFT JOIN h USING (document_id, source_start)"""),
    "d7_reclassify": with_views("questions", """r AS (SELECT id, CASE WHEN id % 4 = 0 THEN id % 7 WHEN id % 5 <> 0 AND id % 2 = 0 THEN 3 END AS topic_id, id % 5 <> 0 AND id % 4 <> 0 AND id % 2 = 0 AS assigned FROM questions) SELECT *, topic_id IS NULL AS unresolved FROM r"""),
    "e1_corpus": with_views("units", "SELECT id, subject_id, len(embedding)::INT AS size, 1.0::DOUBLE AS norm FROM units WHERE review_status = 'accepted' AND embedding IS NOT NULL"),
    "e2_to_embed": with_views("units", "SELECT DISTINCT sha256(content) AS hash FROM units WHERE sha256(content) NOT IN (SELECT sha256(content) FROM units WHERE id % 4 = 0)"),
    "e3_nearest": with_views("units", f"{CORPUS} SELECT query_id, unit_id, round(semantic, 9) AS semantic, place::INT AS place FROM near"),
    "e4_hybrid": with_views("units", f"{CORPUS} SELECT query_id, unit_id, round(semantic, 9) AS semantic, round(score, 9) AS score FROM hybrid"),
    "e5_rescue": with_views("units", f"{CORPUS} SELECT query_id, unit_id, round(score, 9) AS score FROM rescue"),
    "e6_diversified": with_views("units", f"""{CORPUS}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, unit_id) AS r FROM pool), b AS (SELECT *, CASE WHEN r = 1 THEN row_number() OVER (PARTITION BY query_id, r = 1 ORDER BY score DESC, unit_id) END AS h FROM a)
        SELECT query_id, unit_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(h <= 2, false) DESC, score DESC, unit_id) AS INT) AS place FROM b QUALIFY place <= 6"""),
    "e7_still_active": with_views("units", f"{CORPUS} SELECT query_id, unit_id FROM near WHERE unit_id % 6 <> 0"),
    "e9_notes": with_views("units", f"""{CORPUS}, n AS (SELECT id AS note_id, subject_id, 'N' || document_id || '_' || source_start AS source, {_NOTE_TERMS.format("content")} AS tokens,
        row_number() OVER (PARTITION BY subject_id ORDER BY id * 7 % 1000 DESC, id DESC) AS age FROM units WHERE trim(content) <> '' QUALIFY age <= 200),
        m AS (SELECT q.id AS query_id, n.note_id, n.source, n.age, len(list_intersect(list_filter({_NOTE_TERMS.format("q.content")}, lambda t: t NOT IN ({", ".join(map(_q, R.NOTE_STOP))})), n.tokens)) AS shared FROM corpus q JOIN n USING (subject_id) WHERE q.id % 50 = 0)
        SELECT query_id, note_id, shared, source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, age) AS INT) AS place FROM m WHERE shared > 0 QUALIFY place <= 5"""),
    "e10_query_texts": "SELECT conv_id, turn, concat_ws(chr(10), lag(text, 2) OVER w, lag(text) OVER w, text) AS query_text FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "e13_evidence_of": with_views("questions units", "i AS (SELECT DISTINCT id AS question_id, unnest([evidence_id_1, evidence_id_2]) AS unit_id FROM questions) SELECT question_id, unit_id, document_id, source_start FROM i JOIN units ON units.id = unit_id WHERE review_status = 'accepted'"),
    "f8_near_questions": with_views("questions", f"""k AS (SELECT id, subject_id, trim(regexp_replace(lower(question_text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS key,
        list_filter(string_split({_SEM}, ','), lambda w: w <> '' AND w NOT IN ({", ".join(map(_q, X.INTERROGATIVES))})) AS terms FROM questions),
        p AS (SELECT a.id, b.id AS other_id, len(list_intersect(a.terms, b.terms)) / greatest(1, len(list_distinct(list_concat(a.terms, b.terms)))) AS jaccard,
        CASE WHEN length(a.key) <= length(b.key) THEN len(string_split(a.key, ' ')) >= 5 AND starts_with(b.key, a.key || ' ') ELSE len(string_split(b.key, ' ')) >= 5 AND starts_with(a.key, b.key || ' ') END AS prefix
        FROM k a JOIN k b ON a.subject_id = b.subject_id AND a.id <> b.id) SELECT id, other_id, round(jaccard, 9) AS jaccard, prefix FROM p WHERE jaccard > {G.SAME_TERMS} OR prefix"""),
    "e12_evidence_resolution": _resolution_sql(),
    "f9_vector_duplicates": with_views("questions units", """v AS (SELECT q.id, q.subject_id, list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE + z[2]::DOUBLE) AS v FROM questions q
        JOIN units a ON a.id = evidence_id_1 JOIN units b ON b.id = evidence_id_2)
        SELECT a.id, b.id AS other_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM v a JOIN v b ON a.subject_id = b.subject_id AND a.id <> b.id WHERE a.id % 50 = 0 AND list_cosine_similarity(a.v, b.v) >= 0.92"""),
    "f9_vector_problems": with_views("units", "SELECT id, CASE WHEN id % 13 = 0 AND embedding IS NOT NULL THEN 'zero' WHEN id % 17 = 0 OR embedding IS NULL THEN 'missing' ELSE 'valid' END AS state FROM units"),
    "f10_verdicts": with_views("questions", """r AS (SELECT id, list_sort(list_filter([CASE WHEN id % 3 = 0 THEN 'grounded' END, CASE WHEN id % 4 = 0 THEN 'clear' END, CASE WHEN id % 5 = 0 THEN 'duplicate' END, CASE WHEN id % 7 = 0 THEN 'low_quality' END], lambda x: x IS NOT NULL)) AS r FROM questions)
        SELECT id, len(r) = 0 AS accepted, array_to_string(r, ',') AS reasons FROM r"""),
    "f11_storable": with_views("questions", "SELECT min(id) AS id, subject_id FROM questions q WHERE review_status = 'accepted' AND NOT EXISTS (SELECT 1 FROM questions o WHERE o.review_status <> 'accepted' AND o.subject_id = q.subject_id AND o.question_text = q.question_text) GROUP BY subject_id, question_text"),
    "f12_acceptance": with_views("questions units", """r AS (SELECT id, CASE WHEN evidence_id_1 NOT IN (SELECT id FROM units WHERE review_status = 'accepted') OR evidence_id_2 NOT IN (SELECT id FROM units WHERE review_status = 'accepted') THEN 'evidence_not_accepted' WHEN id % 8 = 0 THEN 'no_rubric' END AS reason FROM questions)
        SELECT id, reason IS NULL AS acceptable, reason FROM r"""),
    "f13_citation_gate": with_views("questions", """u AS (SELECT id, CASE WHEN id % 3 = 0 THEN [evidence_id_1] ELSE list_distinct([evidence_id_1, evidence_id_2]) END AS used, id % 3 <> 0 AS cites, [evidence_id_1, id % 250] AS allowed FROM questions),
        x AS (SELECT id, cites, list_sort(list_filter(used, lambda e: NOT list_contains(allowed, e))) AS n FROM u) SELECT id, cites AND len(n) = 0 AS valid, array_to_string(n, ',') AS unknown FROM x"""),
    "g1_preview": recursive("questions", f"{_IMPORTS} SELECT subject_id, line, external_id, question, reason FROM preview"),
    "g2_counts": recursive("questions", f"{_IMPORTS} SELECT subject_id, priority, count(*) AS n FROM preview WHERE reason IS NULL GROUP BY ALL"),
    "g4_disable": with_views("questions", "SELECT id, enabled AND coalesce(question_pool_id, 0) <> 2 AS enabled FROM questions"),
    "g5_listed": with_views("questions units", "SELECT id, CASE WHEN id % 20 IN (SELECT topic_id FROM units) THEN 'Topic ' || (id % 20) || ' model' WHEN id % 3 = 0 THEN 'Unassigned' ELSE topic_name END AS topic FROM questions WHERE review_status = 'accepted' AND enabled"),
    "g12_next_question": with_views("attempts questions", """s AS (SELECT session_id, subject_id, max(question_id % 500) AS m FROM attempts GROUP BY ALL),
        c AS (SELECT s.session_id, q.id, row_number() OVER (PARTITION BY s.session_id ORDER BY NOT (q.evidence_id_1 IN (m, m + 7, m + 14) OR q.evidence_id_2 IN (m, m + 7, m + 14)), q.id) AS k
        FROM s JOIN questions q USING (subject_id) WHERE NOT EXISTS (SELECT 1 FROM attempts a WHERE a.session_id = s.session_id AND a.question_id = q.id))
        SELECT session_id, id AS next_question_id FROM c WHERE k = 1"""),
    "g7_practice_candidates": with_views("questions", "SELECT id, subject_id, difficulty FROM questions WHERE review_status = 'accepted' AND enabled AND difficulty IN ('easy', 'hard') AND priority = 'A'"),
    "g8_recent": with_views("attempts", f"{RECENT} SELECT * FROM recent"),
    "g9_balanced_sample": with_views("questions attempts", f"""{CONCEPTS}, {RECENT}, o AS (SELECT subject_id, concept, min(id) AS id, arg_min(topic_name, id) AS topic_name FROM concepts GROUP BY ALL),
        r AS (SELECT u.user_id, u.subject_id, o.id, o.topic_name, (x.question_id IS NOT NULL)::INT AS recent, md5('7:' || o.id) AS chance FROM (SELECT DISTINCT user_id, subject_id FROM recent) u JOIN o USING (subject_id) LEFT JOIN recent x ON x.user_id = u.user_id AND x.subject_id = u.subject_id AND x.question_id = o.id),
        t AS (SELECT *, row_number() OVER (PARTITION BY user_id, subject_id, topic_name ORDER BY recent, chance, id) AS turn FROM r)
        SELECT user_id, subject_id, id, topic_name, recent, CAST(row_number() OVER (PARTITION BY user_id, subject_id ORDER BY turn, md5('7:' || topic_name), id) AS INT) AS place FROM t QUALIFY place <= 8"""),
    "g10_mock_pool": with_views("questions", f"{CONCEPTS}, {_MOCK} SELECT id, subject_id, concept FROM mock"),
    "g11_mock_order": with_views("questions", f"""{CONCEPTS}, {_MOCK} SELECT subject_id, id, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY CASE WHEN id % 21 = 0 THEN -id END ASC NULLS LAST, quality_score DESC, id) AS INT) AS place
        FROM mock QUALIFY place <= 8"""),
    "g11_question_order": with_views("questions", "SELECT subject_id, id, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY CASE WHEN id % 21 = 0 THEN -id END ASC NULLS LAST, quality_score DESC, id) AS INT) AS place FROM questions"),
    "b18_concept_keys": with_views("questions", f"{CONCEPTS} SELECT id, concept FROM concepts"),
    "h1_import_reported": f"WITH {REPORTED} SELECT stable_id, CASE WHEN n_actions >= 3 THEN 'inserted' WHEN n_actions = 0 THEN 'conflict' ELSE 'unchanged' END AS state FROM reported",
    "g3_materialized": with_views("questions", f"""{_MATERIALIZED} SELECT subject_id, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY line) - 1 + 1000 AS INT) AS number, coalesce(known, new_id) AS topic_id, known IS NULL AS creates_topic, question, 1 AS n_points FROM i LEFT JOIN n USING (subject_id, name)"""),
    "g3_created_topics": with_views("questions", f"{_MATERIALIZED} SELECT new_id AS id, subject_id, name FROM n"),
    "h5_training_cards": _cards_sql(),
    "h2_activation": with_views("units", f"""{REPORTED}, e AS (SELECT stable_id, unnest(evidence_ids) AS e FROM reported), v AS (SELECT stable_id, bool_and(e IN (SELECT id FROM units WHERE review_status = 'accepted')) AS ok FROM e GROUP BY ALL)
        SELECT r.stable_id, CASE WHEN activation = 'active' AND NOT coalesce(ok, false) THEN 'awaiting_course_evidence' ELSE activation END AS activation FROM reported r LEFT JOIN v USING (stable_id)"""),
    "h3_reported_list": f"WITH {REPORTED} SELECT stable_id, chain_id FROM reported WHERE reliability = 'current' AND contains(lower(wording), 'the')",
    "h4_substantive": with_views("units", "f AS (SELECT id, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS t FROM units) SELECT id, length(t) >= 80 AND len(regexp_extract_all(t, '[A-Za-zÀ-ÖØ-öø-ÿ]{3,}')) >= 10 AND NOT regexp_full_match(t, '(?i)https?://\\S+') AND (id % 2 = 1 OR contains(lower(t), 'of the')) AS substantive FROM f"),
    "i4_evaluation_guard": with_views("attempts", "SELECT id, CASE WHEN id % 2 < id % 3 THEN 'insufficient_evidence' WHEN id % 3 = 0 AND id % 5 = 0 THEN 'needs_review' ELSE 'gradable' END AS state FROM attempts"),
    "i5_corrected": with_views("attempts", """c AS (SELECT id - id % 9 AS attempt_id, arg_max((id % 6)::DOUBLE, id) AS s FROM attempts WHERE id % 3 = 0 GROUP BY ALL)
        SELECT id, coalesce(s, score) AS score, CASE WHEN s IS NOT NULL THEN score END AS previous_score FROM attempts LEFT JOIN c ON attempt_id = id"""),
    "k1_dimensions": with_views("units", f"SELECT id, {_DIMS}, {_TRACED} AS source_traceability FROM units"),
    "k2_material_coverage": with_views("units", f"""{material_sql(f"u AS (SELECT *, {_TITLE} AS title FROM units)")}
        SELECT subject_id, title, accepted, review, conflicts, array_to_string(covered, ',') AS covered, array_to_string(required, ',') AS required, array_to_string(missing, ',') AS missing, material_state FROM material"""),
    "k4_topic_coverage": with_views("questions attempts units", f"""{FACT}, {MASTERY.replace("SELECT user_id, subject_id, topic_name", "SELECT subject_id, topic_name")}, {_SAME},
        t AS (SELECT id, subject_id, CASE WHEN id % 11 = 0 THEN name || '|Second heading' WHEN id % 7 = 0 THEN title ELSE name END AS name, CASE WHEN id % 11 = 0 THEN [title, 'Second heading'] ELSE [title] END AS titles FROM s),
        {material_sql("""w AS (SELECT u.* EXCLUDE (topic_id), t.id AS topic_id, t.name AS topic_name, coalesce(t.titles, ['Unassigned']) AS titles FROM units u LEFT JOIN questions q ON q.id = u.id LEFT JOIN s ON s.subject_id = q.subject_id AND s.name = q.raw_heading
            LEFT JOIN t ON t.id = s.id WHERE u.review_status IN ('accepted', 'needs_review')), u AS (SELECT *, unnest(titles) AS title FROM w)""")},
        k AS (SELECT subject_id, unnest(titles) AS title, id AS topic_id, name AS original FROM t WHERE id % 4 <> 1 UNION SELECT subject_id, title, topic_id, coalesce(topic_name, 'Unassigned') FROM u),
        g AS (SELECT subject_id, title, list_sort(list(DISTINCT topic_id) FILTER (topic_id IS NOT NULL)) AS ids, list_sort(list(DISTINCT original)) AS names FROM k GROUP BY ALL),
        c AS (SELECT g.*, m.* EXCLUDE (subject_id, title, covered, required, missing), coalesce(m.material_state, CASE WHEN g.title = 'Unassigned' THEN 'unassigned' ELSE 'missing' END) AS state, st.n, st.mastery_state FROM g
            LEFT JOIN material m ON m.subject_id = g.subject_id AND m.title = g.title LEFT JOIN states st ON st.subject_id = g.subject_id AND st.topic_name = g.title)
        SELECT subject_id, title, coalesce(array_to_string(ids, ','), '') AS topic_ids, coalesce(ids[1], 0) AS topic_id, array_to_string(names, '~') AS original_names, coalesce(accepted, 0) AS accepted, coalesce(review, 0) AS review, coalesce(conflicts, 0) AS conflicts,
        state AS material_state, coalesce(n, 0) AS n, coalesce(mastery_state, 'not_practised') AS mastery_state, list_position(['conflicting', 'needs_review', 'missing', 'partial', 'complete', 'unassigned'], state) - 1 AS state_rank FROM c"""),
}
ORACLE_SQL["l6_study_plan"] = plan_sql()
assert ELIGIBLE and MASTERY and over_fact
