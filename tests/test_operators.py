"""Operators on small rows: cases that the tables do not hold."""

import json

import pytest
from pyspark.sql import functions as F

from studylake.functions import text as X
from studylake.operators import gates as G
from studylake.operators import pools, quality, segment, topics
from studylake.sources import files
from studylake.streaming import attempts as stream


def one(spark, make, *values):
    """The result of a column expression on one row of strings."""
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} string" for k in range(len(values))))
    return row.select(make(*(F.col(f"c{k}") for k in range(len(values)))).alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [
    ("a\r\nb\rc", "a\nb\nc"), ("ﬁne  x\t\ty", "fine x y"), ("Wort-\nteil", "Wortteil"), ("WORT-\nTEIL", "WORT-\nTEIL"), ("Punkt", "• Punkt"), (" a\n\n\n\nb ", "a\n\nb"), ("", ""),
])
def test_normalize(spark, text, want):
    assert one(spark, X.normalize, text) == want


def test_line_key_folds_case(spark):
    assert one(spark, X.line_key, "  STRASSE   ") == one(spark, X.line_key, "Straße") == "strasse"


@pytest.mark.parametrize(("heading", "want"), [
    ("Slide 12: Cognitive Load", ["Cognitive Load"]), ("13. Cognitive Load", ["Cognitive Load"]), ("MemoryAttention|memory", ["Memory", "Attention"]), ("Unassigned", []), ("Overview", []), ("12", []), ("", []), (None, []), ("Load (3)", ["Load"]),
])
def test_topic_titles(spark, heading, want):
    assert one(spark, X.topic_titles, heading) == want


@pytest.mark.parametrize(("text", "want"), [
    ("The slides are available on Moodle for download.", "course_administration"), ("Course outline: memory and attention", "outline_without_explanation"), ("A ..... 3\nB ..... 7", "outline_without_explanation"),
    ("Contents\n1 Memory 3\n2 Attention 9", "outline_without_explanation"), ("Memory is the ability to keep what was learned.", None),
])
def test_purpose(spark, text, want):
    assert one(spark, X.purpose_problem, text) == want


@pytest.mark.parametrize(("text", "numbers", "rest"), [("17–19, 21", [17, 18, 19, 21], []), ("slides 3-4; 4 x7", [3, 4], ["x7"]), ("", [], []), ("9-7", [], [])])
def test_slides(spark, text, numbers, rest):
    assert one(spark, X.slide_numbers, text) == numbers
    assert one(spark, X.unparsed_slides, text) == rest


def test_citations(spark):
    allowed = F.array(F.lit("E1"), F.lit("E2"), F.lit("N3_2"))
    repaired = lambda t: one(spark, lambda c: X.repair_citations(c, allowed), t)
    assert repaired("A [E1] b [E9].") == "A [E1] b ."
    assert repaired("No marks") == "No marks\n\nEvidence: [E1] [E2] [N3_2]"
    assert repaired("Gone [E7] [N3_1]") == "Gone\n\nEvidence: [E1] [E2] [N3_2]" and repaired("[E9]") == ""
    valid = lambda t: one(spark, lambda c: X.citations_valid(c, allowed), t)
    assert valid("x [E1]") and valid("[N3_2]") and not valid("x [E3]") and not valid("x [E1] [N3_1]") and not valid("x")
    points = lambda t: one(spark, X.draft_points, t)
    assert points("A first sentence that is long [E1].\nShort.\nEvidence: [E1] and a longer line of sources") == ["A first sentence that is long ."]
    assert points("Too short [Q2]") == ["Too short"] and points("  ") == []
    assert points("x" * 400) == ["x" * 357 + "…"]


def test_lenient_json(spark):
    assert one(spark, X.lenient_json, 'Sure: ```json\n{"a": {"b": 1}}\n``` bye') == '{"a": {"b": 1}}'
    assert one(spark, X.lenient_json, "{not json}") is None and one(spark, X.lenient_json, "none") is None


def gate(spark, *texts, repeated=()):
    units = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, raw_content string, source_start int, source_end int")
    lines = spark.createDataFrame([(k, line) for k in range(len(texts)) for line in repeated], "doc_id long, line string")
    return [(r["status"], r["problems"]) for r in quality.gate(units, lines).orderBy("doc_id").collect()]


def test_gate_statuses(spark):
    good = "Memory is the process that keeps what was learned, because the brain stores it."
    assert gate(spark, good, "@@@ 7 / ?", "# Memory", "", good + "\nHeader 2024")[0] == ("accepted", [])
    assert gate(spark, "@@@ 7 / ?")[0][0] == "quarantined"
    assert gate(spark, "# Working Memory")[0][1] == ["heading_without_explanation", "low_information_fragment"]
    assert [s for s, _ in gate(spark, "Header 2024", good + "\nHeader 2024", repeated=["Header 2024"])] == ["rejected", "accepted"]


def test_merge_short_follows_what_was_merged(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(1, 1, 1, 1, words(20)), (1, 1, 2, 2, words(20)), (1, 1, 3, 3, words(5)), (1, 2, 4, 4, words(3)), (1, 2, 5, 5, words(120)), (2, 1, 1, 1, words(2))]
    units = spark.createDataFrame(rows, "doc_id long, page_number int, source_start int, source_end int, raw_content string")
    got = sorted((r["doc_id"], r["page_number"], r["source_start"], r["source_end"]) for r in segment.merge_short(units).collect())
    assert got == [(1, 1, 1, 2), (1, 1, 3, 3), (1, 2, 4, 4), (1, 2, 5, 5), (2, 1, 1, 1)]


def test_canonical_topics_merge_to_the_least_id(spark):
    rows = [(3, 1, "13. Cognitive Load"), (2, 1, "cognitive load"), (5, 1, "Memory | Attention"), (7, 2, "Cognitive Load")]
    got = {r["id"]: (r["action"], r["new_id"]) for r in topics.canonical(spark.createDataFrame(rows, "id long, subject_id long, name string")).collect()}
    assert got == {2: ("kept", 2), 3: ("merged", 2), 5: ("unassigned", None), 7: ("kept", 7)}


def test_support_counts_close_spellings(spark):
    rows = spark.createDataFrame([("encoders predict tokens", "The encoder predicts a token sequence"), ("banana", "apple"), ("", "x")], "claim string, source string")
    assert [round(r["support"], 3) for r in G.support(rows, "claim", "source").collect()] == [1.0, 0.0, 0.0]


@pytest.mark.parametrize(("text", "want"), [
    ("What is the difference between encoders and decoders?", ["comparison_missing_expected_side"]), ("What is the difference between encoder and encoders?", ["comparison_of_same_concept_and_example"]), ("How does attention differ from encoder?", []),
])
def test_comparisons(spark, text, want):
    rows = spark.createDataFrame([(1, text, "attention weighs tokens while an encoder maps them")], "id long, question_text string, rubric string")
    assert G.comparison_problems(rows).first()["problems"] == want


def test_duplicate_questions_equal_brute_force(spark):
    from difflib import SequenceMatcher

    texts = ["How does the encoder map tokens to vectors?", "How does the encoder map tokens to vectors in practice?", "How do encoders map tokens to vectors?", "Why is memory limited?", "Why is the memory limited?", "Name three planets."]
    rows = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "id long, subject_id long, question_text string")
    got = {(r["id"], r["other_id"]) for r in G.duplicate_questions(G.near_questions(rows, rows)).collect()}
    terms = {r["id"]: set(r["t"]) for r in rows.select("id", X.question_terms(F.col("question_text")).alias("t")).collect()}
    for a, x in enumerate(texts):
        for b, y in enumerate(texts):
            if a != b and len(terms[a] & terms[b]) / len(terms[a] | terms[b]) > 0.8:
                assert (a, b) in got
            if (a, b) in got:
                assert terms[a] & terms[b] and (SequenceMatcher(None, x.lower(), y.lower()).ratio() > 0.6)


def test_evidence_batches(spark):
    text = " ".join(["word"] * 10)
    rows = [(k, 1, 1, text, "accepted") for k in range(9)] + [(20, 2, None, "w " * 7000, "accepted"), (21, 2, None, text, "accepted"), (22, 2, None, "too short", "accepted")]
    got = G.evidence_batches(spark.createDataFrame(rows, "id long, document_id long, topic_id long, content string, review_status string"))
    assert sorted((r["id"], r["batch"]) for r in got.collect()) == [*((k, k // 4) for k in range(9)), (20, 0), (21, 1)]


def test_grading(spark):
    rows = spark.createDataFrame([(1, 0, "virtual environment", "Eine virtuelle Umgebung", 60), (1, 1, "haptic feedback", "Eine virtuelle Umgebung", 60), (2, 0, "anything", "", 5)], "answer_id long, k int, text string, answer string, duration_seconds int")
    got = {r["answer_id"]: (r["score"], r["time_use"]) for r in G.grade_answers(G.grade_points(rows)).collect()}
    assert got == {1: (3, "appropriate"), 2: (0, "too_short")}


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_discover(spark, tmp_path):
    (tmp_path / "a").mkdir()
    write(tmp_path / "a" / "My_first-notes.md", "x")
    write(tmp_path / "b.txt", "x")
    got = files.discover(spark, str(tmp_path)).collect()
    assert [(r["relative_path"], r["title"], r["kind"], r["size"]) for r in got] == [("a/My_first-notes.md", "My first notes", "markdown", 1)]


def test_question_banks(spark, tmp_path):
    plain = write(tmp_path / "plain.json", json.dumps([{"id": "q1", "text": " What? ", "difficulty": "HARD", "priority": "z", "tags": ["a", "A", " b"], "source_slides": ["17–19", 21]}]))
    wrapped = write(tmp_path / "wrapped.json", json.dumps({"questions": [{"question_id": "q2", "question": ""}, {"question": "Why?", "topic": "T"}]}))
    row = files.json_bank(spark, plain).first()
    assert (row["external_id"], row["question"], row["difficulty"], row["priority"], row["topic"], row["tags"], row["source_slides"]) == ("q1", "What?", "hard", "B", "Unassigned", ["a", "b"], [17, 18, 19, 21])
    rows = files.json_bank(spark, wrapped).collect()
    assert [(r["question"], r["reject_reason"]) for r in rows] == [(None, "missing question text"), ("Why?", None)]
    lines = write(tmp_path / "x.jsonl", '{"question": "A?"}\n\n{broken\n{"question": "B?"}\n')
    good, bad = files.jsonl_bank(spark, lines, "question string")
    assert [(r["line_no"], r["question"]) for r in good.orderBy("line_no").collect()] == [(1, "A?"), (4, "B?")]
    assert [r["line_no"] for r in bad.collect()] == [3]


def test_markdown_bank(spark):
    text = "# Memory\n## Q1 — What is it?\n**Priority:** A\n**Source:** l.pdf — slides 3–4\n**Expected answer points:**\n- one\n* two\n\n## Why?\n# Other\n## When?\n"
    rows = files.markdown_bank(spark.createDataFrame([("f", text)], "path string, text string")).orderBy("question").collect()
    assert [(r["topic"], r["external_id"], r["question"]) for r in rows] == [("Memory", "Q1", "What is it?"), ("Other", None, "When?"), ("Memory", None, "Why?")]
    assert (rows[0]["priority"], rows[0]["source_file"], rows[0]["source_slides"], rows[0]["points"]) == ("A", "l.pdf", [3, 4], ["one", "two"])


def test_reported_bank(spark, tmp_path):
    q = {"question_id": "r1", "exam_id": "old", "wording": "What?", "provenance": "exact_reported", "reliability": "current", "current_course_evidence_ids": [2, 1]}
    path = write(tmp_path / "r.json", json.dumps({"schema_version": "1.0", "source_file": "f", "questions": [q, {**q, "question_id": "r2", "reliability": "rumour"}, {**q, "question_id": "r3", "exam_id": "none"}]}))
    subjects = spark.createDataFrame([(7, "new")], "id long, slug string")
    good, bad = files.reported_bank(spark, path, subjects, {"old": "new"})
    assert [(r["question_id"], r["subject_id"]) for r in good.collect()] == [("r1", 7)]
    assert sorted((r["question_id"], r["reason"]) for r in bad.collect()) == [("r2", "reliability"), ("r3", "no such exam")]
    files.export_reported(good.drop("source_file", "schema_version", "slug"), str(tmp_path / "out"))
    bank = spark.read.json(str(tmp_path / "out")).first()
    assert (bank["subject_id"], bank["schema_version"], bank["questions"][0]["wording"], bank["rules"]["reports_are_authoritative_for_answers"]) == (7, "1.0", "What?", False)
    back, bad = files.reported_bank(spark, str(tmp_path / "out"), subjects, {"old": "new"}, lines=True)
    assert [(r["question_id"], r["subject_id"], r["current_course_evidence_ids"]) for r in back.collect()] == [("r1", 7, [2, 1])] and bad.count() == 0


def test_metrics_and_reports(spark, tmp_path):
    path = write(tmp_path / "m.jsonl", '{"id": 1, "cached": false, "latency_ms": 2.5}\nnot json\n')
    assert [r["id"] for r in files.metrics(spark, path).collect()] == [1]
    out = str(tmp_path / "report")
    files.write_report(spark.createDataFrame([(1, "a"), (2, "b")], "subject_id long, x string"), out)
    files.write_report(spark.createDataFrame([(2, "c")], "subject_id long, x string"), out)
    assert sorted((r["subject_id"], r["x"]) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "c")]


def test_normalized_accepts_missing_fields(spark):
    assert pools.normalized(spark.createDataFrame([("What?",)], "wording string")).first()["question"] == "What?"


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows = [
        (1, 1, 10, "evaluated", "2024-01-01 10:00:00", 4.0), (2, 1, 10, "evaluated", "2024-01-01 10:01:00", 1.0), (3, 1, 11, "skipped", "2024-01-01 10:02:00", None), (4, 1, 12, "evaluated", "2024-01-01 10:03:00", 2.0),
        (5, 2, 10, "evaluated", "2024-01-01 13:00:00", 2.0), (6, 3, 10, "evaluated", "2024-01-01 11:00:00", 5.0),
    ]
    table = spark.createDataFrame(rows, "id long, session_id long, question_id long, status string, at string, score double")
    table = table.select("id", "session_id", "question_id", "status", "score", F.to_timestamp("at").alias("created_at"), F.lit("2024-01-01 12:00:00").cast("timestamp").alias("deadline"), F.lit(1).cast("long").alias("user_id"), F.lit(1).cast("long").alias("subject_id"))
    path = str(tmp_path / "log")
    table.coalesce(1).write.parquet(path)
    live = lambda: spark.readStream.schema(table.schema).parquet(path)

    def run(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination(120)
        return spark.table(name)

    once = run(stream.exactly_once(live()), "once", "append")
    assert sorted((r["session_id"], r["question_id"]) for r in once.collect()) == sorted((r["session_id"], r["question_id"]) for r in stream.exactly_once(table).collect())
    days = run(stream.daily_failures(live()), "days", "update")
    assert [tuple(r) for r in days.collect()] == [tuple(r) for r in stream.daily_failures(table).collect()]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKS_DB)
    fold = {r["session_id"]: (r["answered"], r["skipped"], r["discarded"], r["state"]) for r in run(stream.fold_sessions(live(), 2, delay="2 hours"), "fold", "update").collect()}
    assert fold == {r["session_id"]: (r["answered"], r["skipped"], r["discarded"], r["state"]) for r in stream.fold_sessions(table, 2).collect()}
    assert fold == {1: (1, 1, 2, "completed"), 2: (0, 0, 1, "time_expired"), 3: (1, 0, 0, "answering")}


def test_rejected_rows_of_a_file_mark_nothing(spark):
    from studylake.operators import pools

    new = spark.createDataFrame([(1, 1, "x", "What is stored?"), (1, 2, "x", "What is new?"), (1, 3, "x", "What else?"), (1, 4, None, "what is new")], "subject_id long, line long, external_id string, question string")
    stored = spark.createDataFrame([(1, "y", "what is stored")], "subject_id long, external_id string, question_text string")
    got = {r["line"]: r["reason"] for r in pools.preview(new, stored).collect()}
    assert got == {1: "duplicate question text", 2: None, 3: "duplicate external ID", 4: "duplicate question text"}


def test_rescue_by_an_acronym(spark):
    from studylake.operators import retrieval

    queries = spark.createDataFrame([(1, 1, "What is an LMS?")], "query_id long, subject_id long, text string")
    units = spark.createDataFrame([(7, 1, "An LMS helps learners"), (8, 1, "an lms in small letters")], "id long, subject_id long, content string")
    kept = spark.createDataFrame([], "query_id long, unit_id long")
    got = {r["unit_id"]: r["score"] for r in retrieval.rescue(queries, units, kept).collect()}
    assert got.keys() == {7} and abs(got[7] - 0.7) < 1e-9


def first_wins(rows):
    """The rule of an import, row by row."""
    ids, texts, out = set(), set(), {}
    for subject, line, external, question in sorted(rows, key=lambda r: r[1]):
        text = " ".join(question.lower().replace("?", " ").split())
        out[line] = "duplicate external ID" if external and (subject, external) in ids else "duplicate question text" if (subject, text) in texts else None
        if out[line] is None:
            texts.add((subject, text))
            if external:
                ids.add((subject, external))
    return out


IMPORT = "subject_id long, line long, external_id string, question string"


def test_import_settles_a_long_chain_in_few_rounds(spark, monkeypatch):
    # each row shares its id with the row before it or its text, so that what becomes of one hangs on all before
    chain = [(1, k, f"x{(k + 1) // 2}", f"what is {k // 2}") for k in range(10_000)]
    cuts = []
    kept = pools.checkpointed
    monkeypatch.setattr(pools, "checkpointed", lambda df: cuts.append(1) or kept(df))
    none = spark.createDataFrame([], "subject_id long, external_id string, question_text string")
    got = {r["line"]: r["reason"] for r in pools.preview(spark.createDataFrame(chain, IMPORT), none).collect()}
    assert got == first_wins(chain) and sum(r is None for r in got.values()) == 5000
    assert len(cuts) <= 25


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_import_equals_the_rule_row_by_row(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(rng.randrange(2), k, rng.choice([None, *(f"x{i}" for i in range(60))]), f"what is {rng.randrange(60)}?") for k in range(300)]
    none = spark.createDataFrame([], "subject_id long, external_id string, question_text string")
    assert {r["line"]: r["reason"] for r in pools.preview(spark.createDataFrame(rows, IMPORT), none).collect()} == first_wins(rows)
    assert pools.preview(spark.createDataFrame([], IMPORT), none).count() == 0


def test_new_topics_are_numbered_without_gaps(spark):
    names = spark.createDataFrame([(k % 3, f"Topic {k % 200}") for k in range(500)], "subject_id long, name string")
    known = spark.createDataFrame([(0, "topic 0", 7), (0, "TOPIC 0", 5), (1, "other", 40)], "subject_id long, name string, id long")
    got = topics.resolve(names, known).collect()
    new = sorted((r["id"], r["subject_id"], r["key"]) for r in got if r["created"])
    assert [i for i, *_ in new] == list(range(41, 41 + len(new))) and [n[1:] for n in new] == sorted(n[1:] for n in new)
    assert [(r["subject_id"], r["key"], r["id"]) for r in got if not r["created"]] == [(0, "topic 0", 5)]
    assert topics.resolve(names, known.where("false")).where("created").agg(F.min("id"), F.max("id")).first()[:] == (1, len(new) + 1)


def test_topics_move_with_their_rows(spark):
    rows = spark.createDataFrame([(1, 1, "13. Cognitive Load", "old"), (2, 1, "Cognitive Load", None), (3, 1, "Slide 4: cognitive load", None), (4, 1, "Memory|Attention", None), (5, 1, "7. Working Memory", None), (6, 1, "Unused topic", None), (7, 2, "13. Cognitive Load", None)], "id long, subject_id long, name string, description string")
    units = spark.createDataFrame([(1, 1, "accepted", True), (2, 3, "accepted", False), (3, 4, "accepted", True), (4, None, "accepted", True), (5, 99, "accepted", True)], "id long, topic_id long, review_status string, enabled_for_retrieval boolean")
    questions = spark.createDataFrame([(1, 3), (2, 5), (3, 7), (4, 4)], "id long, topic_id long")
    done = topics.normalized(rows, units, questions)
    assert {r["id"]: r["topic_id"] for r in done.units.collect()} == {1: 2, 2: 2, 3: None, 4: None, 5: 99}
    assert {r["id"]: r["topic_id"] for r in done.questions.collect()} == {1: 2, 2: 5, 3: 7, 4: None}
    assert sorted((r["id"], r["name"], r["description"], r["evidence_count"]) for r in done.topics.collect()) == [(2, "Cognitive Load", None, 1), (5, "Working Memory", "Original source heading: 7. Working Memory", 0), (7, "Cognitive Load", "Original source heading: 13. Cognitive Load", 0)]
    assert {r["subject_id"]: tuple(r)[1:] for r in done.counts.collect()} == {1: (1, 2, 1, 1), 2: (1, 0, 0, 0)}


def test_revisions_retire_units_and_keep_notes(spark):
    at = lambda c: F.to_timestamp(F.concat(F.lit("2024-01-01 "), c))
    uploads = spark.createDataFrame([(1, 1, "08:00:00", "a", "one.pdf"), (1, 2, "09:00:00", "a", "same.pdf"), (1, 3, "10:00:00", "b", "two.pdf"), (1, 4, "11:00:00", "a", "back.pdf")], "source_id long, upload_id long, t string, hash string, filename string").withColumn("uploaded_at", at("t"))
    log = quality.revision_log(uploads)
    assert [(r["revision"], r["filename"], r["active"]) for r in log.orderBy("revision").collect()] == [(1, "one.pdf", False), (2, "two.pdf", False), (3, "back.pdf", True)]
    units = spark.createDataFrame([(1, 1, "08:30:00", ["x"], True, True), (2, 1, "10:00:00", [], True, False), (3, 1, "12:00:00", [], True, True), (4, 2, "12:00:00", [], True, True)], "id long, source_id long, t string, problems array<string>, enabled boolean, authoritative boolean").withColumn("created_at", at("t"))
    state = lambda n: {r["id"]: (r["enabled"], r["authoritative"], r["problems"]) for r in quality.units_as_of(units, log, n).collect()}
    gone = ["superseded_extraction", "superseded_source"]
    assert state(None) == {1: (False, False, [*gone, "x"]), 2: (False, False, gone), 3: (True, True, []), 4: (True, True, [])}
    assert state(1) == {1: (True, True, ["x"]), 4: (True, True, [])}
    assert state(2) == {1: (False, False, [*gone, "x"]), 2: (True, False, []), 4: (True, True, [])}
    edits = spark.createDataFrame([(1, 1, 5, "07:00:00", "too early"), (1, 2, 5, "08:10:00", "draft"), (1, 3, 5, "09:10:00", "kept"), (1, 4, 6, "09:20:00", "away"), (1, 5, 6, "09:30:00", " "), (1, 6, 5, "10:00:00", "new")], "source_id long, edit_id long, page long, t string, content string").withColumn("updated_at", at("t"))
    assert sorted((r["revision"], r["page"], r["content"]) for r in quality.note_snapshots(edits, log).collect()) == [(1, 5, "kept"), (2, 5, "new")]


def test_a_session_expires_without_answers_also_after_a_restart(spark, tmp_path):
    schema = "id long, session_id long, question_id long, status string, created_at timestamp, deadline timestamp"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKS_DB)

    def put(name, *rows):
        frame = spark.createDataFrame([(*r[:4], *r[4:]) for r in rows], "id long, session_id long, question_id long, status string, at string, until string")
        frame.select("id", "session_id", "question_id", "status", F.to_timestamp("at").alias("created_at"), F.to_timestamp("until").alias("deadline")).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        live = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        seen = []
        query = stream.fold_sessions(live, 3).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        query.foreachBatch(lambda batch, _: seen.extend((r["session_id"], r["answered"], r["state"]) for r in batch.collect())).start().awaitTermination(180)
        return seen

    put("1", (1, 1, 10, "evaluated", "2024-01-01 10:00:00", "2024-01-01 12:00:00"), (2, 2, 10, "skipped", "2024-01-01 10:10:00", "2024-01-01 18:00:00"))
    assert sorted(run()) == [(1, 1, "answering"), (2, 0, "answering")]
    # the query is gone; another session's answer moves the clock to 13:00 once it starts again
    put("2", (3, 3, 10, "evaluated", "2024-01-01 14:00:00", "2024-01-01 18:00:00"))
    assert sorted(run()) == [(1, 1, "time_expired"), (3, 1, "answering")]
    put("3", (4, 1, 11, "evaluated", "2024-01-01 14:30:00", "2024-01-01 12:00:00"))
    assert run() == [(1, 1, "time_expired")]
    everything = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    twin = {r["session_id"]: r["state"] for r in stream.fold_sessions(everything, 3, now="2024-01-01 13:30:00").collect()}
    assert twin == {1: "time_expired", 2: "answering", 3: "answering"}


def test_upsert_writes_touched_folders_only(spark, tmp_path):
    import os

    path = str(tmp_path / "units")
    schema = "subject_id long, id long, content string, authoritative boolean, version long"
    put = lambda *rows: {r["subject_id"]: (r["inserted"], r["updated"]) for r in files.upsert(spark.createDataFrame(rows, schema), path, ["id"], "subject_id", ["version"], "NOT old.authoritative").collect()}
    names = lambda s: sorted(os.listdir(f"{path}/subject_id={s}"))
    first = [(1, 1, "a", False, 1), (1, 2, "b", True, 1), (2, 1, "c", False, 1)]
    assert put(*first) == {1: (2, 0), 2: (1, 0)}
    before = names(1), names(2)
    assert put(*first) == {} and (names(1), names(2)) == before
    # of two updates of a key the later counts; a protected row stays; the other folder is not touched
    batch = [(1, 1, "old", False, 2), (1, 1, "new", False, 3), (1, 2, "never", False, 3), (1, 3, None, False, 1)]
    assert put(*batch) == {1: (1, 1)} and names(2) == before[1] and names(1) != before[0]
    rows = lambda: sorted((r["subject_id"], r["id"], r["content"] or "", r["authoritative"]) for r in spark.read.parquet(path).collect())
    want = [(1, 1, "new", False), (1, 2, "b", True), (1, 3, "", False), (2, 1, "c", False)]
    assert rows() == want
    after = names(1)
    assert put(*batch) == {} and names(1) == after and rows() == want


def test_upsert_from_a_stream(spark, tmp_path):
    schema = "subject_id long, id long, content string, version long"
    for k, rows in enumerate([[(1, 1, "a", 1), (2, 1, "b", 1)], [(1, 1, "c", 2), (1, 2, "d", 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    live = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = files.upsert_stream(live, str(tmp_path / "table"), str(tmp_path / "state"), ["id"], "subject_id", ["version"], "new.version >= old.version")
    writer.trigger(availableNow=True).start().awaitTermination(180)
    assert sorted((r["subject_id"], r["id"], r["content"]) for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [(1, 1, "c"), (1, 2, "d"), (2, 1, "b")]


def test_headings_are_cleaned_and_end_sections(spark):
    text = ["intro", "# 1. Cognitive Load", "a", "## Overview", "b", "# Memory|Attention", "c", "### Slide 4: Working Memory", "d"]
    lines = spark.createDataFrame([(1, k, 1, line) for k, line in enumerate(text, 1)], "doc_id long, line_no int, page_number int, line string")
    none = spark.createDataFrame([], "doc_id long, key string")
    got = [r["section_title"] for r in segment.section_titles(lines, none).orderBy("line_no").collect()]
    assert got == [None, "Cognitive Load", "Cognitive Load", None, None, None, None, "Working Memory", "Working Memory"]


def test_superseded_units_are_not_reviewed(spark):
    units = spark.createDataFrame([(1, "a", "needs_review", []), (2, "b", "needs_review", ["superseded_source"]), (3, "c", "needs_review", None), (4, "d", "accepted", [])], "id long, content string, review_status string, problems array<string>")
    events = spark.createDataFrame([(1, 1, "accepted", "better"), (2, 2, "accepted", "never"), (3, 3, "rejected", None), (3, 4, "accepted", "  "), (4, 5, "rejected", None)], "unit_id long, event_id long, decision string, text string")
    got = {r["id"]: (r["content"], r["review_status"], r["authoritative"]) for r in quality.fold_reviews(units, events).collect()}
    assert got == {1: ("better", "accepted", True), 2: ("b", "needs_review", False), 3: ("c", "rejected", True), 4: ("d", "rejected", True)}


def test_claims_are_pruned_and_cited(spark):
    claims = spark.createDataFrame([
        (1, 0, "correct", "the encoder maps tokens", [7], None), (1, 1, "correct", "x", [7, 99], None), (1, 2, "incorrect", "wrong", [7], False), (1, 3, "incorrect", "wrong", [8], True),
        (1, 4, "missing", "decoders generates text", [], None), (1, 5, "partial", "encoders mapping", [99], None), (1, 6, "correct", "unrelated zebra", None, None), (2, 0, "correct", "no evidence", [], None),
    ], "answer_id long, k int, category string, text string, cited array<long>, contradicted boolean")
    evidence = spark.createDataFrame([(1, 7, "An encoder maps each token"), (1, 8, "A decoder generates a text")], "answer_id long, unit_id long, content string")
    got = {(r["answer_id"], r["k"]): r["cited"] for r in G.prune_claims(claims, evidence).collect()}
    assert got == {(1, 0): [7], (1, 3): [8], (1, 4): [8], (1, 5): [7], (1, 6): [7], (2, 0): []}


def test_material_states(spark):
    full = "Memory is defined as storage because it works by stages, for example a diary."
    rows = [
        (1, "Load", full, "accepted", True, "Page 1", 0.9, []), (2, "Thin", "Only words.", "accepted", True, "Page 1", 0.9, None), (3, "Off", full, "accepted", False, "Page 1", 0.9, []),
        (4, "Wait", full, "needs_review", True, "Page 1", 0.9, []), (5, "Clash", full, "accepted", True, "Page 1", 0.9, ["Conflicting_definition"]), (6, "Unassigned", full, "accepted", True, "Page 1", 0.9, []),
        (7, "Nowhere", full, "accepted", True, "", 0.9, []), (8, "Unsure", full, "accepted", True, "Page 1", 0.5, []), (9, "Both", "Only words.", "accepted", True, "", 0.9, []), (10, "Both", full, "needs_review", True, "Page 1", 0.9, []),
    ]
    units = spark.createDataFrame([(i, 1, 5, *r) for i, *r in rows], "id long, subject_id long, document_id long, title string, content string, review_status string, enabled_for_retrieval boolean, source_location string, confidence double, problems array<string>")
    got = {r["title"]: r["material_state"] for r in topics.material_coverage(units, ["subject_id", "title"]).collect()}
    assert got == {"Load": "complete", "Thin": "partial", "Off": "missing", "Wait": "needs_review", "Clash": "conflicting", "Unassigned": "unassigned", "Nowhere": "partial", "Unsure": "partial", "Both": "needs_review"}
    named = units.withColumn("topic_name", F.when(F.col("title") != "Unassigned", F.concat(F.lit("3. "), "title"))).withColumn("topic_id", F.when(F.col("title") != "Unassigned", F.col("id"))).drop("title")
    known = spark.createDataFrame([(40, 1, "Memory|Attention"), (41, 1, "Overview"), (1, 1, "3. Load")], "id long, subject_id long, name string")
    mastery = spark.createDataFrame([(1, "Load", 3, "weak"), (1, "Elsewhere", 1, "weak")], "subject_id long, title string, n long, mastery_state string")
    table = {r["title"]: r for r in topics.topic_coverage(known, named, mastery).collect()}
    assert set(table) == set(got) | {"Memory", "Attention"}
    assert (table["Load"]["topic_ids"], table["Load"]["original_names"], table["Load"]["mastery_state"], table["Load"]["n"]) == ([1], ["3. Load"], "weak", 3)
    assert (table["Memory"]["topic_id"], table["Memory"]["material_state"], table["Unassigned"]["topic_id"], table["Unassigned"]["original_names"]) == (40, "missing", 0, ["Unassigned"])
    assert table["Both"]["topic_ids"] == [9, 10] and table["Thin"]["mastery_state"] == "not_practised"
