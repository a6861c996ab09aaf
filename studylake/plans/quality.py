"""Queries on text and its quality (A2, A3, A13, B, C) over the adapter views, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import quality as Q
from ..operators import segment as S
from ..sources.adapters import lines, questions, requests, table, units, with_views


def docs(s, d):
    return table(s, d, "documents")


def gated(s, d):
    rows = lines(s, d)
    return Q.gate(S.paragraphs(rows), S.repeated_lines(rows))


def _pages(s, d):
    return lines(s, d).where("page_number BETWEEN 2 AND 3")


def _supersede(s, d):
    rows = units(s, d).select("id", "document_id", "source_start", (F.col("id") % 11 == 0).alias("authoritative"), F.lit(True).alias("enabled"), F.array().cast("array<string>").alias("problems"))
    fresh = rows.where("document_id % 5 = 0").withColumn("id", F.col("id") + 100_000).withColumn("authoritative", F.lit(False))
    return Q.supersede(rows, fresh).withColumn("problems", F.array_join("problems", ","))


def _paths(s, d, step):
    return docs(s, d).where(F.col("doc_id") % 10 != step).select((F.col("doc_id") % 4).alias("subject_id"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), X.sha256(F.when(F.col("doc_id") % 7 == step, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))


def _reviews(s, d):
    return table(s, d, "labels").select(F.col("doc_id").alias("unit_id"), F.col("doc_id").alias("event_id"), F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("decision"), F.when(F.col("toxic") == 1, "removed").alias("text"))


def _with_empty_texts(s, d):
    return _reviews(s, d).withColumn("text", F.when(F.col("text").isNull() & (F.col("unit_id") % 5 == 0), " ").otherwise(F.col("text")))


def _merge(s, d):
    rows = gated(s, d)
    proposals = rows.where("doc_id % 3 = 0").select("doc_id", "source_start", F.concat("content", F.lit(" (revised)")).alias("content"), F.lit("accepted").alias("status"), F.array(F.lit("rewritten")).alias("problems"))
    return Q.merge_proposals(rows, proposals).select("doc_id", "source_start", "status", F.array_join("problems", ",").alias("problems"), F.length("content").alias("n"))


def _queued(s, d):
    return gated(s, d).select(F.col("doc_id").alias("document_id"), "source_start", F.col("status").alias("review_status"), "confidence", "problems")


def _flags(s, d):
    t = F.col("text")
    return docs(s, d).select("doc_id", X.purpose_problem(t).alias("purpose"), X.table_corrupt(t).alias("corrupt"), X.formula_broken(t).alias("broken"), X.sha256(t).alias("hash"), F.length(X.normalize(t)).alias("n"))


def _tokens(s, d):
    t = F.col("question_text")
    return questions(s, d).select("id", *(F.array_join(F.array_sort(f(t)), ",").alias(n) for n, f in (("long", X.long_tokens), ("evidence", X.evidence_tokens), ("semantic", X.semantic_terms), ("claim", X.claim_terms), ("question", X.question_terms))))


def _headings(s, d):
    return questions(s, d).select("id", F.array_join(X.topic_titles(F.col("raw_heading")), "|").alias("titles"), X.single_title(F.col("raw_heading")).alias("title"), X.topic_key(F.col("topic_name")).alias("key"))


def _citations(s, d):
    allowed = F.array(*map(F.lit, ("E1", "E2", "E3", "E5")))
    rows = requests(s, d).withColumn("answer", F.concat("output_text", F.lit(" [E"), (F.col("conv_id") % 6).cast("string"), F.lit("] and more. [E"), (F.col("turn") % 4).cast("string"), F.lit("]")))
    return rows.select("id", X.citations_valid(F.col("answer"), allowed).alias("valid"), X.repair_citations(F.col("answer"), allowed).alias("repaired"), F.array_join(X.draft_points(F.col("answer")), "~").alias("points"))


def _uploads(s, d):
    """Signups and purchases as uploads of a learner's script; equal ones in a row make no revision."""
    rows = table(s, d, "events").where("event_type IN ('signup', 'purchase')")
    return rows.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("upload_id"), F.col("ts").alias("uploaded_at"), F.md5(F.concat("event_type", (F.col("event_id") % 3).cast("string"))).alias("hash"), F.concat(F.lit("script"), F.col("event_id").cast("string"), F.lit(".pdf")).alias("filename"))


def _extracted(s, d):
    rows = table(s, d, "events").where("event_type = 'click'")
    problems = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("broken_formula"))).otherwise(F.array().cast("array<string>"))
    return rows.select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), F.col("ts").alias("created_at"), problems.alias("problems"), (F.col("event_id") % 5 != 0).alias("enabled"), (F.col("event_id") % 3 == 0).alias("authoritative"))


def _note_edits(s, d):
    rows = table(s, d, "events").where("event_type = 'view'")
    return rows.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("edit_id"), (F.col("event_id") % 5).alias("page"), F.when(F.col("event_id") % 4 != 0, F.col("props")).otherwise(" ").alias("content"), F.col("ts").alias("updated_at"))


def _plain_times(df, *columns):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


def headed(s, d):
    """Lines, some of them as Markdown headings: numbered ones, generic ones, and ones with two titles."""
    n, line = F.col("line_no"), F.col("line")
    heading = F.when(n % 36 == 1, F.concat(F.lit("## "), n.cast("string"), F.lit(". "), line)).when(n % 36 == 13, F.lit("# 3. Overview")).when(n % 36 == 25, F.lit("### Memory|Attention"))
    return lines(s, d).withColumn("line", F.when(F.trim("line") != "", F.coalesce(heading, line)).otherwise(line))


QUERIES = {
    "a2_document_scan": lambda s, d: docs(s, d).select("doc_id", X.sha256(F.col("text")).alias("hash"), F.length("text").alias("n")),
    "a3_page_range": lambda s, d: _pages(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")),
    "a13_upsert": lambda s, d: Q.upsert(_reviews(s, d), _reviews(s, d).where("unit_id % 2 = 0").withColumn("event_id", F.col("event_id") + F.when(F.col("unit_id") % 4 == 0, 5).otherwise(-5)).withColumn("decision", F.lit("needs_review")), ["unit_id"], "event_id"),
    "b2_line_keys": lambda s, d: lines(s, d).where("line <> ''").select(X.line_key(F.col("line")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
    "b4_b6_text_flags": _flags,
    "b7_block_kinds": lambda s, d: lines(s, d).where("line <> ''").groupBy(X.block_kind(F.col("line")).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    "b8_topic_titles": _headings,
    "b11_token_sets": _tokens,
    "b13_b20_scalars": lambda s, d: questions(s, d).select("id", X.page_number(F.lit(None), F.concat(F.lit("Slide "), F.col("expected_duration_seconds").cast("string"))).alias("page"), X.mock_target(F.col("expected_duration_seconds") * 15).alias("target"), X.question_key(F.col("question_text")).alias("question_key"), X.file_stem(F.concat(F.lit("a\\b/"), "topic_name", F.lit(".x.pdf"))).alias("stem")),
    "b21_reported_quality": lambda s, d: questions(s, d).select("id", F.round(X.reported_quality(F.element_at(F.array(*map(F.lit, X.RELIABILITY)), (F.col("id") % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, X.PROVENANCE)), (F.col("id") % 3 + 1).cast("int"))), 6).alias("quality")),
    "b22_b24_citations": _citations,
    "b26_lenient_json": lambda s, d: table(s, d, "events").select("event_id", X.lenient_json(F.concat(F.lit("Sure: ```json "), F.col("props"), F.when(F.col("event_id") % 5 == 0, "").otherwise(" ``` done"))).alias("json")),
    "b29_question_cleanup": lambda s, d: questions(s, d).select("id", X.clean_question(F.concat(F.lit(" "), F.replace(F.col("question_text"), F.lit(" "), F.lit("  ")), F.lit(" !"))).alias("text"), X.noise_line(F.concat(F.lit("Page "), F.col("id").cast("string"))).alias("noise")),
    "c1_paragraphs": lambda s, d: S.paragraphs(lines(s, d)),
    "c2_repeated_lines": lambda s, d: S.repeated_lines(lines(s, d)),
    "c3_page_furniture": lambda s, d: S.page_furniture(lines(s, d)),
    "c4_without_counters": lambda s, d: S.without_counters(lines(s, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines")),
    "c5_merge_short": lambda s, d: S.merge_short(lines(s, d).where("line <> ''").select("doc_id", "page_number", F.col("line_no").alias("source_start"), F.col("line_no").alias("source_end"), F.col("line").alias("raw_content"))).select("doc_id", "page_number", "source_start", "source_end", F.length("raw_content").alias("n")),
    "c6_section_titles": lambda s, d: S.section_titles(headed(s, d), S.page_furniture(headed(s, d))).select("doc_id", "line_no", "section_title", "page_topic"),
    "c7_extraction_summary": lambda s, d: S.extraction_summary(lines(s, d)).withColumn("empty_pages", F.array_join(F.col("empty_pages").cast("array<string>"), ",")),
    "c8_unit_quality": lambda s, d: gated(s, d).withColumn("problems", F.array_join("problems", ",")),
    "c8_status_by_source": lambda s, d: gated(s, d).join(docs(s, d).select("doc_id", "source"), "doc_id").groupBy("source", "status").agg(F.count(F.lit(1)).alias("units"), F.sum(F.length("content")).alias("chars")),
    "c9_merge_proposals": _merge,
    "c10_changes": lambda s, d: Q.changes(_paths(s, d, 1), _paths(s, d, 2)),
    "c11_supersede": _supersede,
    "c12_document_rollup": lambda s, d: Q.document_rollup(units(s, d)),
    "c13_document_list": lambda s, d: Q.document_list(units(s, d), questions(s, d)),
    "c14_quality_report": lambda s, d: Q.quality_report(gated(s, d)),
    "c14_coverage_warnings": lambda s, d: Q.coverage_warnings(gated(s, d)),
    "c14_unit_detail": lambda s, d: Q.unit_detail(gated(s, d)).withColumn("problems", F.array_join("problems", ",")),
    "c15_review_queue": lambda s, d: Q.review_queue(_queued(s, d), most_confidence=0.96, issue="fragment").withColumn("problems", F.array_join("problems", ",")),
    "c15_suspicious": lambda s, d: Q.review_queue(_queued(s, d), suspicious_only=True).withColumn("problems", F.array_join("problems", ",")),
    "c17_batch_acceptance": lambda s, d: Q.batch_acceptance(gated(s, d)),
    "c18_fold_reviews": lambda s, d: Q.fold_reviews(units(s, d).withColumn("problems", F.when(F.col("id") % 12 == 0, F.array(*map(F.lit, Q.RETIRED))).otherwise(F.array().cast("array<string>"))), _with_empty_texts(s, d)),
    "c19_revision_log": lambda s, d: _plain_times(Q.revision_log(_uploads(s, d)), "valid_from", "valid_to"),
    "c19_units_as_of": lambda s, d: Q.units_as_of(_extracted(s, d), Q.revision_log(_uploads(s, d)), 2).withColumn("problems", F.array_join("problems", ",")),
    "c19_current_units": lambda s, d: Q.units_as_of(_extracted(s, d), Q.revision_log(_uploads(s, d))).withColumn("problems", F.array_join("problems", ",")),
    "c19_note_snapshots": lambda s, d: _plain_times(Q.note_snapshots(_note_edits(s, d), Q.revision_log(_uploads(s, d))), "updated_at"),
    "c19_revisions": lambda s, d: Q.revisions(table(s, d, "events").select((F.col("user_id")).alias("source_id"), F.col("event_id").alias("revision"), F.md5("event_type").alias("hash"))),
    "c21_work_batches": lambda s, d: S.work_batches(units(s, d), F.col("document_id") % 2 == 0).select("id", "document_id", "batch"),
}


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _flat(t: str) -> str:
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def purpose_sql(t: str) -> str:
    admin = " OR ".join(f"regexp_matches({_flat(t)}, {_q('(?i)' + p)})" for p in X.ADMINISTRATION)
    return f"""CASE WHEN {admin} THEN 'course_administration' WHEN regexp_matches(substring({_flat(t)}, 1, 220), {_q("(?i)" + X.OVERVIEW)}) OR regexp_matches({_strip(t)}, {_q("(?i)" + X.OBJECTIVES)})
        OR len(regexp_extract_all({t}, {_q(X.LEADERS)})) >= 2 OR (regexp_matches({t}, {_q("(?i)" + X.CONTENTS)}) AND len(regexp_extract_all({t}, {_q(X.CONTENTS_ENTRY)})) >= 2) THEN 'outline_without_explanation' END"""


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


def normal_sql(t: str) -> str:
    """Without Unicode normalisation, which changes nothing in the tables; hyphens at line ends need no look-around."""
    out = f"regexp_replace({t}, '\\r\\n?', chr(10), 'g')"
    out = f"regexp_replace({out}, '([a-zäöüß])-\\n([a-zäöüß])', '\\1\\2', 'g')"
    return _strip(f"regexp_replace(regexp_replace(regexp_replace({out}, '[\\t\\x{{00a0}}]+', ' ', 'g'), ' {{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _count(t: str, piece: str) -> str:
    return f"(length({t}) - length(replace({t}, '{piece}', '')))"


def corrupt_sql(t: str) -> str:
    bars = f"list_filter(list_transform(string_split({t}, chr(10)), lambda l: {_count('l', '|')}), lambda n: n > 0)"
    return f"(len({bars}) > 0 AND (len({bars}) < 2 OR list_max({bars}) - list_min({bars}) > 1))"


def broken_sql(t: str) -> str:
    return f"(regexp_matches({t}, {_q('(?i)' + X.FORMULA)}) AND ({_count(t, '(')} <> {_count(t, ')')} OR regexp_matches({t}, '[=+\\-/]\\s*$')))"


def titles_sql(t: str) -> str:
    """Clean titles of a heading, in order; equal ones are not told apart by case in the tables."""
    clean = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, {_q('(?i)' + X.SLIDE_PREFIX)}, ''), '\\s*\\(\\s*\\d+\\s*\\)\\s*$', ''), '\\s+\\d+\\s*$', ''), '\\s+', ' ', 'g'), {_q(X.TITLE_EDGE)})"
    generic = ", ".join(map(_q, X.GENERIC_TITLES))
    parts = f"list_filter(list_transform(string_split_regex({t}, {_q(X.TITLE_SPLIT)}), lambda p: {clean}), lambda p: length(p) >= 3 AND NOT regexp_matches(p, '^\\d+$') AND lower(p) NOT IN ({generic}) AND NOT regexp_matches(p, '(?i)^(page|slide|lecture)\\s*\\d+$'))"
    return f"list_filter({parts}, lambda p, i: list_position(list_transform({parts}, lambda q: lower(q)), lower(p)) = i)"


def points_sql(t: str) -> str:
    """Draft rubric points of an answer. Where a sentence ends a line break is put, so that no look-around is needed."""
    body = f"regexp_replace(regexp_replace({t}, '(?is)\\n\\s*(citations?|sources?|evidence)\\s*:.*$', ''), '\\[(E|Q)\\d+\\]', '', 'g')"
    pieces = f"string_split_regex(regexp_replace({body}, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')"
    long = f"list_filter(list_transform({pieces}, lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'), ' -•' || chr(9))), lambda p: length(p) >= 25)"
    whole = f"trim(regexp_replace({body}, '\\s+', ' ', 'g'))"

    def cut(p: str) -> str:
        return f"CASE WHEN length({p}) <= 360 THEN {p} ELSE rtrim(substring({p}, 1, 357)) || '…' END"

    return f"CASE WHEN len({long}) > 0 THEN list_transform({long}, lambda p: {cut('p')})[1:4] WHEN {whole} <> '' THEN [{cut(whole)}] ELSE [] END"


PARAGRAPHS = """islands AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM lines),
    paragraphs AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS raw_content, min(line_no) AS source_start, max(line_no) AS source_end FROM islands WHERE trim(line) <> '' GROUP BY doc_id, island),
    repeats AS (SELECT doc_id, trim(line) AS line, count(*) AS times FROM lines WHERE trim(line) <> '' AND length(trim(line)) <= 120 GROUP BY doc_id, trim(line) HAVING count(*) >= 3)"""
_KEY = "regexp_replace(trim({}), '\\s+', ' ', 'g')"
GATED = f"""{PARAGRAPHS}, keys AS (SELECT doc_id, list(lower({normal_sql("line")})) AS keys FROM repeats GROUP BY doc_id),
    g1 AS (SELECT p.*, {normal_sql("raw_content")} AS whole, coalesce(keys, []) AS keys FROM paragraphs p LEFT JOIN keys USING (doc_id)),
    g2 AS (SELECT *, list_filter(string_split(whole, chr(10)), lambda l: NOT list_contains(keys, lower({_KEY.format("l")}))) AS kept FROM g1),
    g3 AS (SELECT *, len(kept) < len(string_split(whole, chr(10))) AS repeated, CASE WHEN len(kept) < len(string_split(whole, chr(10))) THEN {normal_sql("array_to_string(kept, chr(10))")} ELSE whole END AS content FROM g2),
    g4 AS (SELECT *, regexp_extract_all(content, {_q(X.WORDS)}) AS words, {titles_sql("trim(regexp_replace(content, '^#{1,6}\\s+', ''))")} AS titles, {purpose_sql("content")} AS purpose FROM g3),
    g5 AS (SELECT *, len(words) AS n, CASE WHEN len(titles) = 1 THEN titles[1] END AS title FROM g4),
    g6 AS (SELECT *, regexp_matches(content, '^#{{1,6}}\\s+') OR (title IS NOT NULL AND n <= 10 AND NOT regexp_matches(content, '(^|[^\\p{{L}}])\\p{{Ll}}') AND NOT regexp_matches(content, '\\p{{L}}\\p{{Lu}}')) AS heading FROM g5),
    g7 AS (SELECT *, (n >= 4 OR (heading AND title IS NOT NULL)) AND NOT regexp_matches(content, '^[^\\p{{L}}]+$') AND content <> '' AS meaningful, heading OR regexp_matches(content, '[.!?:;)]\\s*$') OR n >= 12 AS complete FROM g6),
    g8 AS (SELECT *, meaningful AND (len(list_distinct(list_transform(words, lambda w: lower(w)))) >= 4 OR (heading AND title IS NOT NULL)) AS academic, list_filter(string_split(content, chr(10)), lambda l: trim(l) <> '') AS short FROM g7),
    g9 AS (SELECT *, list_filter([purpose, CASE WHEN regexp_matches(content, {_q("(?i)" + X.NAVIGATION)}) THEN 'navigation_boilerplate' END, CASE WHEN regexp_matches(content, {_q("(?i)" + X.ATTRIBUTION)}) THEN 'copyright_or_attribution' END,
        CASE WHEN regexp_matches(content, {_q(X.JOINED)}) THEN 'suspicious_joined_words' END, CASE WHEN {corrupt_sql("content")} THEN 'corrupted_table' END, CASE WHEN {broken_sql("content")} THEN 'broken_formula' END], lambda x: x IS NOT NULL) AS costly,
        list_filter([CASE WHEN NOT complete THEN 'incomplete_fragment' END, CASE WHEN heading THEN 'heading_without_explanation' END,
        CASE WHEN n < 8 AND NOT regexp_matches(content, '[.!?;:]\\s*$') AND NOT regexp_matches(content, {_q("(?i)" + X.FORMULA)}) THEN 'low_information_fragment' END,
        CASE WHEN len(short) >= 5 AND len(list_filter(short, lambda l: len(string_split_regex(trim(l), '\\s+')) <= 2)) / len(short) > 0.65 THEN 'possible_diagram_or_broken_reading_order' END,
        CASE WHEN NOT meaningful THEN 'meaningless_fragment' END, CASE WHEN NOT academic THEN 'no_academic_information' END], lambda x: x IS NOT NULL) AS signs FROM g8),
    g10 AS (SELECT *, 0.98::DOUBLE - 0.18::DOUBLE * len(costly) - CASE WHEN complete THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END AS c1 FROM g9),
    g11 AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, c1, CASE WHEN meaningful THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END, CASE WHEN academic THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END)) AS conf, list_concat(costly, signs) AS problem_list FROM g10),
    gated AS (SELECT doc_id, source_start, source_end, content, CASE WHEN heading THEN 'heading' WHEN contains(content, '|') THEN 'table' WHEN regexp_matches(content, '(?m)^\\s*[-*•]\\s') THEN 'bullet_list' ELSE 'paragraph' END AS content_type,
        round(conf, 3) AS confidence, list_sort(list_concat(problem_list, CASE WHEN repeated THEN ['repeated_header_or_footer'] ELSE [] END)) AS problems,
        CASE WHEN repeated AND (content = '' OR NOT meaningful OR NOT academic) THEN 'rejected' WHEN list_has_any(problem_list, [{", ".join(map(_q, Q.QUARANTINE))}]) OR conf < 0.45 THEN 'quarantined'
        WHEN len(problem_list) > 0 OR conf < 0.9 THEN 'needs_review' ELSE 'accepted' END AS status, complete, meaningful, academic, CASE WHEN heading THEN title END AS detected_topic, sha256(raw_content) AS source_hash FROM g11)"""


def over_gate(body: str) -> str:
    return with_views("lines", f"{GATED}{', ' if body.lstrip().split(' ')[1] == 'AS' else ' '}{body}")


def _terms(t: str, pattern: str, stop=(), aliases=None, plural=False) -> str:
    out = f"list_filter(regexp_extract_all(lower({t}), {_q(pattern)}), lambda w: length(w) > 1 AND w NOT IN ('', {', '.join(map(_q, stop))}))" if stop and aliases else f"regexp_extract_all(lower({t}), {_q(pattern)})"
    if aliases:
        cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in aliases.items())
        rest = "CASE WHEN length(w) > 4 THEN regexp_replace(w, 's$', '') ELSE w END" if plural else "w"
        out = f"list_transform({out}, lambda w: CASE w {cases} ELSE {rest} END)"
    if stop and not aliases:
        out = f"list_filter({out}, lambda w: w NOT IN ({', '.join(map(_q, stop))}))"
    return f"array_to_string(list_sort(list_distinct({out})), ',')"


_SEM = _terms("question_text", r"[a-zA-ZÀ-ÖØ-öø-ÿ0-9]{2,}", (), X.SEMANTIC_ALIASES)

_LOG = """up AS (SELECT user_id AS source_id, event_id, ts, md5(event_type || (event_id % 3)) AS hash, 'script' || event_id || '.pdf' AS filename FROM events WHERE event_type IN ('signup', 'purchase')),
    ch AS (SELECT *, lag(hash) OVER (PARTITION BY source_id ORDER BY ts, event_id) AS before FROM up),
    log AS (SELECT source_id, row_number() OVER w AS revision, filename, hash, ts AS valid_from, lead(ts) OVER w AS valid_to, lead(ts) OVER w IS NULL AS active FROM ch WHERE before IS NULL OR before <> hash WINDOW w AS (PARTITION BY source_id ORDER BY ts, event_id)),
    x AS (SELECT event_id AS id, user_id AS source_id, ts AS created_at, CASE WHEN event_id % 2 = 0 THEN ['broken_formula'] ELSE [] END AS problems, event_id % 5 <> 0 AS enabled, event_id % 3 = 0 AS authoritative FROM events WHERE event_type = 'click')"""
_RETIRED = """SELECT id, source_id, revision, array_to_string(CASE WHEN retired THEN list_sort(list_distinct(list_concat(problems, ['superseded_extraction', 'superseded_source']))) ELSE problems END, ',') AS problems,
        enabled AND NOT retired AS enabled, authoritative AND NOT retired AS authoritative, retired FROM (SELECT *, coalesce(created_at < since, FALSE) AS retired FROM u)"""

_HEADED = "CASE WHEN trim(line) = '' THEN line WHEN line_no % 36 = 1 THEN '## ' || line_no || '. ' || line WHEN line_no % 36 = 13 THEN '# 3. Overview' WHEN line_no % 36 = 25 THEN '### Memory|Attention' ELSE line END"

ORACLE_SQL = {
    "a2_document_scan": "SELECT doc_id, sha256(text) AS hash, length(text) AS n FROM documents",
    "a3_page_range": with_views("lines", "SELECT doc_id, count(*) AS lines, min(line_no) AS first_line, max(line_no) AS last_line FROM lines WHERE page_number BETWEEN 2 AND 3 GROUP BY ALL"),
    "a13_upsert": """WITH o AS (SELECT doc_id AS unit_id, doc_id AS event_id, CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS decision, CASE WHEN toxic = 1 THEN 'removed' END AS text FROM labels)
        SELECT unit_id, CASE WHEN unit_id % 4 = 0 THEN event_id + 5 ELSE event_id END AS event_id, CASE WHEN unit_id % 4 = 0 THEN 'needs_review' ELSE decision END AS decision, text FROM o""",
    "b2_line_keys": with_views("lines", f"k AS (SELECT replace(lower(regexp_replace({normal_sql('line')}, '\\s+', ' ', 'g')), 'ß', 'ss') AS key FROM lines WHERE line <> '') SELECT key, count(*) AS n FROM k GROUP BY ALL HAVING count(*) > 1"),
    "b4_b6_text_flags": f"SELECT doc_id, {purpose_sql('text')} AS purpose, {corrupt_sql('text')} AS corrupt, {broken_sql('text')} AS broken, sha256(text) AS hash, length({normal_sql('text')}) AS n FROM documents",
    "b7_block_kinds": with_views("lines", """k AS (SELECT CASE WHEN regexp_matches(line, '^[-*•]\\s+') THEN 'bullet_group' WHEN regexp_matches(line, '^\\d+[.)]\\s+') THEN 'numbered_list' WHEN regexp_matches(line, '[=±∑∆√]') THEN 'formula'
        WHEN length(line) <= 90 AND NOT ends_with(line, '.') THEN 'heading_candidate' WHEN contains(line, '|') THEN 'table_like' ELSE 'text' END AS kind FROM lines WHERE line <> '') SELECT kind, count(*) AS n FROM k GROUP BY ALL"""),
    "b8_topic_titles": with_views("questions", f"t AS (SELECT id, {titles_sql('raw_heading')} AS t, topic_name FROM questions) SELECT id, array_to_string(t, '|') AS titles, CASE WHEN len(t) = 1 THEN t[1] END AS title, trim(regexp_replace(lower(topic_name), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS key FROM t".replace("{{", "{").replace("}}", "}")),
    "b11_token_sets": with_views("questions", f"""SELECT id, {_terms("question_text", r"[A-Za-zÀ-ÖØ-öø-ÿ0-9]{3,}")} AS long, {_terms("question_text", r"[A-Za-zÀ-ÖØ-öø-ÿ0-9]{2,}", X.STOP_WORDS)} AS evidence, {_SEM} AS semantic,
        {_terms("question_text", r"[\p{L}\p{N}_]+", X.CLAIM_STOP, X.CLAIM_ALIASES, True)} AS claim, array_to_string(list_filter(string_split({_SEM}, ','), lambda w: w NOT IN ({", ".join(map(_q, X.INTERROGATIVES))})), ',') AS question FROM questions"""),
    "b13_b20_scalars": with_views("questions", """SELECT id, CAST(expected_duration_seconds AS INT) AS page, CAST(least(8, greatest(3, round_even(expected_duration_seconds * 15 / 150, 0))) AS INT) AS target,
        trim(regexp_replace(lower(question_text), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS question_key, regexp_replace(lower(topic_name || '.x'), '[^a-z0-9]+', '', 'g') AS stem FROM questions"""),
    "b21_reported_quality": with_views("questions", "SELECT id, round(least(1.0, greatest(0.0, [0.95, 0.85, 0.65, 0.5][id % 4 + 1] + [0.04, 0.02, -0.05][id % 3 + 1]))::DOUBLE, 6) AS quality FROM questions"),
    "b22_b24_citations": with_views("requests", f"""a AS (SELECT id, output_text || ' [E' || (conv_id % 6) || '] and more. [E' || (turn % 4) || ']' AS t FROM requests),
        n AS (SELECT *, regexp_extract_all(t, '\\[([EN]\\d+(_\\d+)?)\\]', 1) AS names, trim(regexp_replace(t, '\\[(E(0|4|[6-9]|\\d\\d+)|E\\d+_\\d+|N\\d+(_\\d+)?)\\]', '', 'g')) AS kept FROM a)
        SELECT id, len(names) > 0 AND len(list_filter(names, lambda x: x NOT IN ('E1', 'E2', 'E3', 'E5'))) = 0 AS valid,
        CASE WHEN kept = '' OR regexp_matches(kept, '\\[E\\d+\\]') THEN kept ELSE kept || chr(10) || chr(10) || 'Evidence: [E1] [E2] [E3]' END AS repaired, array_to_string({points_sql("t")}, '~') AS points FROM n"""),
    "b26_lenient_json": "SELECT event_id, regexp_extract(props, '(?s)\\{.*\\}') AS json FROM events",
    "b29_question_cleanup": with_views("questions", "SELECT id, replace(question_text, ' ?', '?') || '!' AS text, true AS noise FROM questions"),
    "c1_paragraphs": with_views("lines", f"{PARAGRAPHS} SELECT doc_id, raw_content, source_start, source_end FROM paragraphs"),
    "c2_repeated_lines": with_views("lines", f"{PARAGRAPHS} SELECT * FROM repeats"),
    "c3_page_furniture": with_views("lines", f"""e AS (SELECT doc_id, page_number, replace(lower(regexp_replace({normal_sql("line")}, '\\s+', ' ', 'g')), 'ß', 'ss') AS key, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no) AS a,
        row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no DESC) AS b FROM lines WHERE trim(line) <> ''), p AS (SELECT doc_id, count(DISTINCT page_number) AS pages FROM lines GROUP BY ALL)
        SELECT doc_id, key, count(DISTINCT page_number) AS on_pages FROM e JOIN p USING (doc_id) WHERE a <= 3 OR b <= 3 GROUP BY doc_id, key, pages HAVING count(DISTINCT page_number) >= greatest(CASE WHEN pages = 1 THEN 3 ELSE 2 END, ceil(pages * 0.35))"""),
    "c4_without_counters": with_views("lines", """e AS (SELECT *, min(line_no) OVER p AS a, max(line_no) OVER p AS b FROM lines WHERE trim(line) <> '' WINDOW p AS (PARTITION BY doc_id, page_number))
        SELECT doc_id, count(*) AS lines FROM e WHERE NOT ((line_no IN (a, b) AND regexp_matches(line, '(?i)^\\s*(page|seite|slide)\\s+\\d{1,4}\\s*(/\\s*\\d{1,4})?\\s*$')) OR (line_no = b AND trim(line) = page_number::VARCHAR)) GROUP BY ALL"""),
    "c6_section_titles": with_views("lines", f"""headed AS (SELECT * REPLACE ({_HEADED} AS line) FROM lines), e AS (SELECT *, replace(lower(regexp_replace({normal_sql("line")}, '\\s+', ' ', 'g')), 'ß', 'ss') AS key, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no) AS a,
        row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no DESC) AS b FROM headed WHERE trim(line) <> ''), p AS (SELECT doc_id, count(DISTINCT page_number) AS pages FROM headed GROUP BY ALL),
        u AS (SELECT doc_id, key FROM e JOIN p USING (doc_id) WHERE a <= 3 OR b <= 3 GROUP BY doc_id, key, pages HAVING count(DISTINCT page_number) >= greatest(CASE WHEN pages = 1 THEN 3 ELSE 2 END, ceil(pages * 0.35))),
        h AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+') THEN regexp_replace(line, '^#{{1,6}}\\s+', '') END AS heading FROM e), h2 AS (SELECT *, {titles_sql("coalesce(heading, '')")} AS heads FROM h),
        l AS (SELECT doc_id, line_no, last_value(CASE WHEN heading IS NOT NULL THEN {{'t': CASE WHEN len(heads) = 1 THEN heads[1] END}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section,
        trim(min_by(line, line_no) FILTER ((doc_id, key) NOT IN (SELECT (doc_id, key) FROM u)) OVER (PARTITION BY doc_id, page_number)) AS f FROM h2),
        t AS (SELECT *, {titles_sql("f")} AS titles FROM l)
        SELECT doc_id, line_no, section.t AS section_title, CASE WHEN len(string_split_regex(f, '\\s+')) BETWEEN 2 AND 10 AND NOT regexp_matches(f, '[.!?=∑√+]') AND len(titles) = 1 THEN titles[1] END AS page_topic FROM t"""),
    "c7_extraction_summary": with_views("lines", """p AS (SELECT doc_id, page_number, count(*) FILTER (trim(line) <> '') AS n FROM lines GROUP BY ALL)
        SELECT doc_id, count(*) AS pages, coalesce(string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER (n = 0), '') AS empty_pages,
        CASE WHEN count(*) FILTER (n = 0) = count(*) THEN 'no_extractable_text' ELSE 'text_extracted' END AS state FROM p GROUP BY doc_id"""),
    "c8_unit_quality": over_gate("SELECT * REPLACE (array_to_string(problems, ',') AS problems) FROM gated"),
    "c8_status_by_source": over_gate("SELECT source, status, count(*) AS units, CAST(sum(length(content)) AS BIGINT) AS chars FROM gated JOIN documents USING (doc_id) GROUP BY ALL"),
    "c9_merge_proposals": over_gate(f"""m AS (SELECT *, doc_id % 3 = 0 AS use, list_has_any(problems, [{", ".join(map(_q, Q.HARD))}]) AS hard, list_contains(problems, 'repeated_header_or_footer') AS furniture FROM gated)
        SELECT doc_id, source_start, CASE WHEN use AND NOT hard AND NOT furniture THEN 'accepted' ELSE status END AS status,
        array_to_string(CASE WHEN NOT use THEN problems WHEN hard THEN list_sort(list_append(problems, 'rewritten')) WHEN furniture THEN ['repeated_header_or_footer', 'rewritten'] ELSE ['rewritten'] END, ',') AS problems,
        length(CASE WHEN use AND NOT hard AND NOT furniture THEN content || ' (revised)' ELSE content END) AS n FROM m"""),
    "c10_changes": """WITH o AS (SELECT doc_id, doc_id % 7 = 1 AS x FROM documents WHERE doc_id % 10 <> 1), n AS (SELECT doc_id, doc_id % 7 = 2 AS x FROM documents WHERE doc_id % 10 <> 2)
        SELECT coalesce(o.doc_id, n.doc_id) % 4 AS subject_id, 'doc/' || coalesce(o.doc_id, n.doc_id) AS path, CASE WHEN n.doc_id IS NULL THEN 'gone' WHEN o.doc_id IS NULL THEN 'new' WHEN o.x = n.x THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n USING (doc_id)""",
    "c11_supersede": with_views("units", """SELECT id, document_id, source_start, id % 11 = 0 AS authoritative, NOT (document_id % 5 = 0 AND id % 11 <> 0) AS enabled, CASE WHEN document_id % 5 = 0 AND id % 11 <> 0 THEN 'superseded_extraction' ELSE '' END AS problems FROM units
        UNION ALL SELECT id + 100000, document_id, source_start, false, true, '' FROM units WHERE document_id % 5 = 0 AND (document_id, source_start) NOT IN (SELECT (document_id, source_start) FROM units WHERE id % 11 = 0)"""),
    "c12_document_rollup": with_views("units", """c AS (SELECT document_id, count(*) FILTER (review_status = 'accepted') AS accepted, count(*) FILTER (review_status = 'needs_review') AS needs_review,
        count(*) FILTER (review_status = 'quarantined') AS quarantined, count(*) FILTER (review_status = 'rejected') AS rejected FROM units GROUP BY ALL)
        SELECT *, CASE WHEN accepted > 0 AND needs_review = 0 THEN 'accepted' ELSE 'needs_review' END AS quality, accepted > 0 AS training FROM c"""),
    "c13_document_list": with_views("units questions", """l AS (SELECT document_id, count(DISTINCT q.id) AS questions FROM units u JOIN questions q ON u.id IN (q.evidence_id_1, q.evidence_id_2) GROUP BY ALL)
        SELECT u.*, coalesce(questions, 0) AS questions FROM (SELECT document_id, count(*) FILTER (review_status = 'accepted') AS accepted, count(*) FILTER (review_status = 'needs_review') AS review, count(*) FILTER (review_status = 'quarantined') AS quarantined,
        count(*) AS total, count(DISTINCT source_start) AS pages FROM units GROUP BY ALL) u LEFT JOIN l USING (document_id)"""),
    "c14_quality_report": over_gate("SELECT doc_id, 'status' AS what, status AS name, count(*) AS n FROM gated GROUP BY ALL UNION ALL SELECT doc_id, 'issue', name, count(*) FROM (SELECT doc_id, unnest(problems) AS name FROM gated) GROUP BY doc_id, name"),
    "c14_coverage_warnings": over_gate("""c AS (SELECT doc_id, count(*) FILTER (status = 'accepted') AS a, count(*) FILTER (list_contains(problems, 'visual_fragment')) AS v,
        count(*) FILTER (list_contains(problems, 'corrupted_table')) AS t, count(*) FILTER (list_contains(problems, 'broken_formula')) AS f FROM gated GROUP BY ALL)
        SELECT doc_id, concat_ws(',', CASE WHEN a = 0 THEN 'no_accepted_evidence' END, CASE WHEN v > 0 THEN 'original_visual_inspection_required' END,
        CASE WHEN t > 0 THEN 'broken_tables_present' END, CASE WHEN f > 0 THEN 'broken_formulas_present' END) AS warnings FROM c"""),
    "c14_unit_detail": over_gate("SELECT doc_id, source_start, source_end, status, confidence, array_to_string(problems, ',') AS problems FROM gated"),
    "c15_review_queue": over_gate("""SELECT doc_id AS document_id, source_start, status AS review_status, confidence, array_to_string(problems, ',') AS problems FROM gated
        WHERE confidence <= 0.96 AND len(list_filter(problems, lambda p: contains(p, 'fragment'))) > 0"""),
    "c15_suspicious": over_gate("SELECT doc_id AS document_id, source_start, status AS review_status, confidence, array_to_string(problems, ',') AS problems FROM gated WHERE status <> 'accepted'"),
    "c17_batch_acceptance": over_gate(f"""r AS (SELECT doc_id, source_start, CASE WHEN confidence < 0.9 THEN 'low_confidence' WHEN list_has_any(problems, [{", ".join(map(_q, Q.NOT_IN_BATCH))}]) THEN 'problem:' || list_min(list_intersect(problems, [{", ".join(map(_q, Q.NOT_IN_BATCH))}])) END AS reason FROM gated)
        SELECT doc_id, source_start, reason IS NULL AS accepted, reason FROM r JOIN gated USING (doc_id, source_start) WHERE status <> 'accepted'"""),
    "c18_fold_reviews": with_views("units", """r AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS decision, CASE WHEN toxic = 1 THEN 'removed' WHEN doc_id % 5 = 0 THEN ' ' END AS text FROM labels),
        k AS (SELECT * FROM r WHERE decision <> 'accepted' OR text IS NULL OR trim(text) <> '')
        SELECT id, coalesce(k.text, content) AS content, coalesce(k.decision, review_status) AS review_status, k.doc_id IS NOT NULL AS authoritative FROM units LEFT JOIN k ON k.doc_id = id AND id % 12 <> 0"""),
    "c19_revision_log": f"WITH {_LOG} SELECT source_id, revision, filename, hash, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(valid_to, '%Y-%m-%d %H:%M:%S') AS valid_to, active FROM log",
    "c19_units_as_of": f"""WITH {_LOG}, now AS (SELECT source_id, max(revision) AS revision, max(valid_from) AS since FROM log WHERE revision <= 2 GROUP BY ALL), u AS (SELECT x.*, now.revision, since FROM x LEFT JOIN now USING (source_id) LEFT JOIN log n ON n.source_id = x.source_id AND n.revision = 2
        WHERE n.valid_to IS NULL OR created_at < n.valid_to) {_RETIRED}""",
    "c19_current_units": f"WITH {_LOG}, now AS (SELECT source_id, max(revision) AS revision, max(valid_from) AS since FROM log GROUP BY ALL), u AS (SELECT x.*, now.revision, since FROM x LEFT JOIN now USING (source_id)) {_RETIRED}",
    "c19_note_snapshots": f"""WITH {_LOG}, e AS (SELECT user_id AS source_id, event_id, event_id % 5 AS page, CASE WHEN event_id % 4 <> 0 THEN props ELSE ' ' END AS content, ts FROM events WHERE event_type = 'view')
        SELECT source_id, revision, page, content, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at FROM (SELECT e.*, revision FROM e JOIN log USING (source_id) WHERE ts >= valid_from AND (valid_to IS NULL OR ts < valid_to)
        QUALIFY row_number() OVER (PARTITION BY source_id, revision, page ORDER BY ts DESC, event_id DESC) = 1) WHERE trim(content) <> ''""",
    "c19_revisions": """SELECT user_id AS source_id, event_id AS revision, md5(event_type) AS hash, coalesce(lag(event_type) OVER w <> event_type, true) AS changed, event_id = max(event_id) OVER (PARTITION BY user_id) AS active FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "c21_work_batches": with_views("units", "SELECT id, document_id, CAST(CASE WHEN document_id % 2 = 0 THEN dense_rank() OVER (PARTITION BY document_id ORDER BY source_start) - 1 ELSE (row_number() OVER (PARTITION BY document_id ORDER BY source_start, id) - 1) // 8 END AS INT) AS batch FROM units"),
}
