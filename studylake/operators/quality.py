"""The quality gate of units, and what documents and reviews make of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..shared import checkpointed

# Thresholds of the gate, what quarantines a unit, and what bars it from acceptance in a batch.
QUARANTINE_BELOW, ACCEPT_FROM, BATCH_ACCEPT_FROM = 0.45, 0.9, 0.90
QUARANTINE = ("meaningless_fragment", "corrupted_table", "broken_formula", "navigation_boilerplate", "course_administration", "outline_without_explanation")
# Problems that a proposal does not lift, and those that ask for a review of each unit.
HARD = ("meaningless_fragment", "broken_formula", "corrupted_table", "possible_diagram_or_broken_reading_order", "heading_without_explanation", "low_information_fragment")
NOT_IN_BATCH = (
    "meaningless_fragment", "corrupted_table", "broken_formula", "source_traceability_failure",
    "possible_diagram_or_broken_reading_order", "heading_without_explanation", "low_information_fragment",
)
FURNITURE, SUPERSEDED = "repeated_header_or_footer", "superseded_extraction"
# Marks of units whose source has a newer revision.
RETIRED = ("superseded_extraction", "superseded_source")
# Warnings on a document's coverage by the problem that gives rise to them.
WARNINGS = {"original_visual_inspection_required": "visual_fragment", "broken_tables_present": "corrupted_table", "broken_formulas_present": "broken_formula"}


def gate(units: DataFrame, repeated: DataFrame, unicode: Callable[[Column], Column] = X.nfkc) -> DataFrame:
    """Cleaned content, problems, confidence and status of units (doc_id, raw_content, source_start, source_end).

    `repeated` has doc_id and line: lines that are taken out. A document has a bounded number of lines. Six kinds of
    problems cost 0.18 each, a fragment 0.2; other signs change the status only.
    """
    # The set of keys is made once for each document and the text once for each unit; both are then plain columns.
    keys = repeated.groupBy("doc_id").agg(F.collect_set(X.line_key(F.col("line"), unicode)).alias("keys"))
    rows = units.join(keys, "doc_id", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>"))).withColumn("whole", X.normalize(F.col("raw_content"), unicode))
    # within normalised text a line's key needs no further normalisation
    key = lambda line: X.casefold(F.regexp_replace(X.strip(line), r"(?U)\s+", " "))
    # most documents repeat no line: their lines need no keys
    every = F.split("whole", "\n")
    rows = rows.withColumn("kept", F.when(F.size("keys") == 0, every).otherwise(F.filter(every, lambda line: ~F.array_contains(F.col("keys"), key(line)))))
    has = F.size("kept") < F.size(F.split("whole", "\n"))
    rows = rows.withColumn("repeated", has).withColumn("content", F.when(has, X.normalize(F.array_join("kept", "\n"), lambda c: c)).otherwise(F.col("whole")))
    text = F.col("content")
    heading_text = X.strip(F.regexp_replace(text, r"^#{1,6}\s+", ""))
    n = F.size("words")
    marked = text.rlike(r"^#{1,6}\s+")
    # only what is marked as a heading or short can be one, and only then its title is asked for
    title = F.when(marked | (n <= 10), X.single_title(heading_text, lambda c: c))
    rows = rows.withColumn("words", F.regexp_extract_all(text, F.lit(X.WORDS), F.lit(0))).withColumn("title", title).withColumn("purpose", X.purpose_problem(text))
    as_title = ~text.rlike(r"(?:^|[^\p{L}])\p{Ll}") & ~text.rlike(r"\p{L}\p{Lu}")
    heading = marked | (F.col("title").isNotNull() & (n <= 10) & as_title)
    rows = rows.withColumn("heading", heading)
    titled = F.col("heading") & F.col("title").isNotNull()
    rows = rows.withColumn("meaningful", ((n >= 4) | titled) & ~text.rlike(r"^[^\p{L}]+$") & (text != ""))
    rows = rows.withColumn("academic", F.col("meaningful") & ((F.size(F.array_distinct(F.transform("words", F.lower))) >= 4) | titled))
    rows = rows.withColumn("complete", F.col("heading") | (n >= 12) | text.rlike(r"[.!?:;)]\s*$"))
    short = F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")
    few = F.filter(short, lambda line: F.size(F.split(X.strip(line), r"(?U)\s+")) <= 2)
    costly = F.array_compact(F.array(
        F.col("purpose"), F.when(text.rlike(f"(?i){X.NAVIGATION}"), "navigation_boilerplate"), F.when(X.attribution(text), "copyright_or_attribution"),
        F.when(X.joined_words(text), "suspicious_joined_words"), F.when(X.table_corrupt(text), "corrupted_table"), F.when(X.formula_broken(text), "broken_formula"),
    ))
    signs = F.array_compact(F.array(
        F.when(~F.col("complete"), "incomplete_fragment"), F.when(F.col("heading"), "heading_without_explanation"),
        F.when((n < 8) & ~text.rlike(r"[.!?;:]\s*$") & ~X.has_formula(text), "low_information_fragment"),
        F.when((F.size(short) >= 5) & (F.size(few) / F.size(short) > 0.65), "possible_diagram_or_broken_reading_order"),
        F.when(~F.col("meaningful"), "meaningless_fragment"), F.when(~F.col("academic"), "no_academic_information"),
    ))
    rows = rows.withColumn("costly", costly).withColumn("signs", signs)
    score = F.lit(0.98) - F.lit(0.18) * F.size("costly") - F.when(F.col("complete"), 0.0).otherwise(0.2)
    score = F.when(~F.col("meaningful"), F.least(score, F.lit(0.2))).otherwise(score)
    score = F.when(~F.col("academic"), F.least(score, F.lit(0.4))).otherwise(score)
    rows = rows.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    problems = F.concat("costly", "signs")
    status = (
        F.when(F.col("repeated") & ((text == "") | ~F.col("meaningful") | ~F.col("academic")), "rejected")
        .when(F.arrays_overlap(problems, F.array(*map(F.lit, QUARANTINE))) | (F.col("confidence") < QUARANTINE_BELOW), "quarantined")
        .when((F.size(problems) > 0) | (F.col("confidence") < ACCEPT_FROM), "needs_review").otherwise("accepted")
    )
    kind = F.when(F.col("heading"), "heading").when(F.contains(text, F.lit("|")), "table").when(text.rlike(r"(?m)^\s*[-*•]\s"), "bullet_list").otherwise("paragraph")
    listed = F.array_sort(F.concat(problems, F.when(F.col("repeated"), F.array(F.lit("repeated_header_or_footer"))).otherwise(F.array().cast("array<string>"))))
    return rows.select(
        "doc_id", "source_start", "source_end", "content", kind.alias("content_type"), F.round("confidence", 3).alias("confidence"), listed.alias("problems"), status.alias("status"), "complete", "meaningful", "academic",
        F.when(F.col("heading"), F.col("title")).alias("detected_topic"), X.sha256(F.col("raw_content")).alias("source_hash"),
    )


def current(units: DataFrame) -> DataFrame:
    """Units that no later extraction has superseded; all where there are no problems to tell.

    Spark would push the filter below the gate, whose expressions would be spelled out in it many times. It pushes none
    below a column that is not the same each time, so the filter asks for such a column as well.
    """
    if "problems" not in units.columns:
        return units
    superseded = F.array_contains(F.coalesce("problems", F.array().cast("array<string>")), SUPERSEDED)
    return units.withColumn("__row", F.monotonically_increasing_id()).where(~superseded & (F.col("__row") >= 0)).drop("__row")


def merge_proposals(units: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposed cleanups (doc_id, source_start, content, status, problems) over the gate's rows.

    A proposal takes the place of content, status and problems. Units with removed page furniture or a hard problem keep
    content and status, and the proposal's problems are added to the furniture or to all the unit's own. Provenance stays.
    """
    p = proposals.select("doc_id", "source_start", F.col("content").alias("p_content"), F.col("status").alias("p_status"), F.col("problems").alias("p_problems"))
    furniture = F.array_contains("problems", FURNITURE)
    hard = F.arrays_overlap("problems", F.array(*map(F.lit, HARD)))
    use = F.col("p_status").isNotNull()
    free = use & ~furniture & ~hard
    problems = (
        F.when(~use, F.col("problems")).when(hard, F.array_sort(F.array_union("problems", "p_problems")))
        .when(furniture, F.array_sort(F.array_union("p_problems", F.array(F.lit(FURNITURE))))).otherwise(F.col("p_problems"))
    )
    return units.join(p, ["doc_id", "source_start"], "left").select(
        "doc_id", "source_start", "source_end", F.when(free, F.col("p_content")).otherwise(F.col("content")).alias("content"),
        F.when(free, F.col("p_status")).otherwise(F.col("status")).alias("status"), problems.alias("problems"), "source_hash",
    )


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New, changed, unchanged and gone documents by (subject_id, path) and hash."""
    o, n = old.select("subject_id", "path", F.col("hash").alias("old_hash")), new.select("subject_id", "path", "hash")
    change = F.when(F.col("hash").isNull(), "gone").when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") == F.col("hash"), "unchanged").otherwise("changed")
    return o.join(n, ["subject_id", "path"], "full").select("subject_id", "path", change.alias("change"))


def supersede(units: DataFrame, fresh: DataFrame) -> DataFrame:
    """C11: old units of re-read documents are disabled and flagged unless authoritative; fresh units come in but where an
    authoritative one stands. Both have id, document_id, source_start, authoritative, enabled, problems."""
    reread = fresh.select("document_id").distinct().withColumn("reread", F.lit(True))
    old = units.join(reread, "document_id", "left")
    out = F.coalesce("reread", F.lit(False)) & ~F.col("authoritative")
    old = old.withColumn("enabled", F.when(out, False).otherwise(F.col("enabled"))).withColumn("problems", F.when(out, F.array_union("problems", F.array(F.lit("superseded_extraction")))).otherwise(F.col("problems"))).drop("reread")
    held = units.where("authoritative").select("document_id", "source_start").distinct()
    return old.unionByName(fresh.join(held, ["document_id", "source_start"], "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, the latest version of each key; among equals the new row."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new")))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place", "__new")


def document_rollup(units: DataFrame) -> DataFrame:
    """Current units of each document by status; accepted if any is and none needs review, else to review; in
    training if any is accepted."""
    counts = current(units).groupBy("document_id").agg(*(F.count_if(F.col("review_status") == s).alias(s) for s in ("accepted", "needs_review", "quarantined", "rejected")))
    done = (F.col("accepted") > 0) & (F.col("needs_review") == 0)
    return counts.withColumn("quality", F.when(done, "accepted").otherwise("needs_review")).withColumn("training", F.col("accepted") > 0)


def document_list(units: DataFrame, questions: DataFrame) -> DataFrame:
    """Units by status, source pages and linked questions of each document."""
    counts = units.groupBy("document_id").agg(
        F.count_if(F.col("review_status") == "accepted").alias("accepted"), F.count_if(F.col("review_status") == "needs_review").alias("review"),
        F.count_if(F.col("review_status") == "quarantined").alias("quarantined"), F.count(F.lit(1)).alias("total"), F.count_distinct("source_start").alias("pages"),
    )
    ids = questions.select(F.col("id").alias("question_id"), F.explode(F.array("evidence_id_1", "evidence_id_2")).alias("unit_id"))
    linked = ids.join(units.select(F.col("id").alias("unit_id"), "document_id"), "unit_id").select("document_id", "question_id").distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("questions"))
    return counts.join(linked, "document_id", "left").withColumn("questions", F.coalesce("questions", F.lit(0)))


def quality_report(gated: DataFrame) -> DataFrame:
    """C14: status and issue counts of the current units of each document in long form."""
    rows = current(gated.select("doc_id", "status", "problems"))
    names = F.concat(F.array(F.concat(F.lit("status:"), "status")), F.transform("problems", lambda p: F.concat(F.lit("issue:"), p)))
    each = rows.select("doc_id", F.explode(names).alias("name"))
    return each.groupBy("doc_id", F.split_part("name", F.lit(":"), F.lit(1)).alias("what"), F.split_part("name", F.lit(":"), F.lit(2)).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def unit_detail(gated: DataFrame) -> DataFrame:
    """C14: the current units behind a document's report, with their place, status, confidence and problems."""
    return current(gated.select("doc_id", "source_start", "source_end", "status", "confidence", "problems"))


def coverage_warnings(gated: DataFrame) -> DataFrame:
    """C14: what is missing or broken in the current units of a document."""
    issues = [F.count_if(F.array_contains("problems", problem)).alias(warning) for warning, problem in WARNINGS.items()]
    rows = current(gated.select("doc_id", "status", "problems")).groupBy("doc_id").agg(F.count_if(F.col("status") == "accepted").alias("accepted"), *issues)
    warnings = [F.when(F.col("accepted") == 0, "no_accepted_evidence"), *(F.when(F.col(w) > 0, w) for w in WARNINGS)]
    return rows.select("doc_id", F.array_join(F.array_compact(F.array(*warnings)), ",").alias("warnings"))


def review_queue(
    units: DataFrame, document: int | None = None, topic: int | None = None, most_confidence: float | None = None,
    status: str | None = None, issue: str | None = None, suspicious_only: bool = False,
) -> DataFrame:
    """Current units by the filters given, the least confident first: units of any status unless only suspicious
    ones are asked for; `issue` is a part of a problem's name. What is chosen is kept in the shared folder before it is put
    in order: Spark would otherwise make the units twice, first to find the bounds of its sorted parts."""
    rows = current(units)
    if suspicious_only:
        rows = rows.where(F.col("review_status") != "accepted")
    for column, value in (("document_id", document), ("topic_id", topic), ("review_status", status)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if most_confidence is not None:
        rows = rows.where(F.col("confidence") <= most_confidence)
    if issue:
        rows = rows.where(F.exists("problems", lambda p: F.contains(p, F.lit(issue))))
    return checkpointed(rows).orderBy("confidence", "document_id", "source_start")


def batch_acceptance(gated: DataFrame) -> DataFrame:
    """C17: whether current units that wait may be accepted together, and why not."""
    barred = F.array_intersect("problems", F.array(*map(F.lit, NOT_IN_BATCH)))
    reason = F.when(F.col("confidence") < BATCH_ACCEPT_FROM, "low_confidence").when(F.size(barred) > 0, F.concat(F.lit("problem:"), F.array_min(barred)))
    rows = current(gated.select("doc_id", "source_start", "status", "confidence", "problems"))
    return rows.where("status <> 'accepted'").select("doc_id", "source_start", reason.isNull().alias("accepted"), reason.alias("reason"))


def fold_reviews(units: DataFrame, events: DataFrame) -> DataFrame:
    """Units (id, content, review_status, problems) under their latest review (unit_id, event_id, decision, text).

    Units of a superseded source can't be reviewed any more, and a review that accepts an empty text counts for nothing.
    """
    last = events.where("decision != 'accepted' OR text IS NULL OR trim(text) != ''").groupBy("unit_id").agg(F.max_by(F.struct("decision", "text"), "event_id").alias("r"))
    rows = units.join(last, units["id"] == last["unit_id"], "left")
    fixed = F.array_contains(F.coalesce("problems", F.array().cast("array<string>")), RETIRED[1])
    rows = rows.withColumn("r", F.when(~fixed, F.col("r")))
    return rows.select("id", F.coalesce("r.text", "content").alias("content"), F.coalesce("r.decision", "review_status").alias("review_status"), F.col("r").isNotNull().alias("authoritative"))


def revisions(log: DataFrame) -> DataFrame:
    """A source's revisions (source_id, revision, hash): whether each changed, and which one is active."""
    line = Window.partitionBy("source_id").orderBy("revision")
    before = F.lag("hash").over(line)
    last = F.max("revision").over(Window.partitionBy("source_id"))
    return log.withColumn("changed", before.isNull() | (before != F.col("hash"))).withColumn("active", F.col("revision") == last)


def revision_log(uploads: DataFrame) -> DataFrame:
    """Revisions of sources from their uploads (source_id, upload_id, uploaded_at, hash, filename): an upload whose hash is
    that of the one before makes none. Columns: source_id, revision (from 1), filename, hash, valid_from, valid_to, active.

    A revision holds from its upload until the next one's, the last one without end. Uploads at one time go by id.
    """
    line = Window.partitionBy("source_id").orderBy("uploaded_at", "upload_id")
    before = F.lag("hash").over(line)
    changed = uploads.withColumn("__changed", before.isNull() | (before != F.col("hash"))).where("__changed")
    numbered = changed.withColumn("revision", F.row_number().over(line)).withColumn("valid_to", F.lead("uploaded_at").over(line))
    return numbered.select("source_id", "revision", "filename", "hash", F.col("uploaded_at").alias("valid_from"), "valid_to", F.col("valid_to").isNull().alias("active"))


def _as_of(log: DataFrame, revision: int | None) -> DataFrame:
    """The revision of each source that holds once `revision` is uploaded (the last one if there are fewer, or for None)."""
    rows = log if revision is None else log.where(F.col("revision") <= revision)
    return rows.groupBy("source_id").agg(F.max_by(F.struct("revision", "valid_from"), "revision").alias("now")).select("source_id", F.col("now.revision").alias("revision"), F.col("now.valid_from").alias("since"))


def units_as_of(units: DataFrame, log: DataFrame, revision: int | None = None) -> DataFrame:
    """Units (id, source_id, created_at, problems, enabled, authoritative) as they stand once `revision` is uploaded.

    Units of an older revision are retired, accepted ones by hand as well: out of retrieval, no longer authoritative, and
    marked as superseded. Units that a later revision brings are not there yet. Those of a source without revisions stay.
    """
    later = log if revision is None else log.where(F.col("revision") == revision)
    until = later.where("valid_to IS NOT NULL").select("source_id", F.col("valid_to").alias("__until")) if revision is not None else None
    rows = units.join(_as_of(log, revision), "source_id", "left")
    if until is not None:
        rows = rows.join(until, "source_id", "left").where("__until IS NULL OR created_at < __until").drop("__until")
    retired = F.coalesce(F.col("created_at") < F.col("since"), F.lit(False))
    marks = F.array(*map(F.lit, RETIRED))
    problems = F.when(retired, F.array_sort(F.array_union("problems", marks))).otherwise(F.col("problems"))
    return rows.select("id", "source_id", "revision", problems.alias("problems"), (F.col("enabled") & ~retired).alias("enabled"), (F.col("authoritative") & ~retired).alias("authoritative"), retired.alias("retired"))


def note_snapshots(edits: DataFrame, log: DataFrame) -> DataFrame:
    """The notes of each revision (source_id, revision, page, content, updated_at): the last edit of each page (source_id,
    edit_id, page, content, updated_at) while the revision held. The next revision starts without notes, and an empty
    edit takes a note away. Edits before the first revision belong to none."""
    held = (F.col("updated_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("updated_at") < F.col("valid_to")))
    spans = log.select(F.col("source_id").alias("__source"), "revision", "valid_from", "valid_to")
    rows = edits.join(spans, (F.col("source_id") == F.col("__source")) & held)
    last = rows.groupBy("source_id", "revision", "page").agg(F.max_by(F.struct("content", "updated_at"), F.struct("updated_at", "edit_id")).alias("last"))
    return last.select("source_id", "revision", "page", "last.content", "last.updated_at").where("trim(content) != ''")
