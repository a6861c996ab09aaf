"""Steps whose work has to grow with their input: rows that joins give, on small tables with large groups."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from studylake.operators import gates, pools, retrieval, segment, similar
from studylake.plans import questions


def largest(df):
    """The rows of `df`, and the most rows that any of its plan's nodes gave."""
    rows, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(k) for k in range(node.children().size())]
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
    return rows, most


def test_next_questions_meet_no_whole_group(spark):
    """400 sessions miss evidence that 400 questions share; every session has used the first two of them but one."""
    questions = spark.range(400).select(F.col("id").alias("question_id"), F.lit(1).alias("subject_id"), F.col("id").alias("place"), F.array(F.when(F.col("id") < 5, 1).otherwise(7).cast("long"), F.lit(8).cast("long")).alias("evidence_ids"))
    sessions = spark.range(400).select(F.col("id").alias("session_id"), F.lit(1).alias("subject_id"), F.array(F.lit(7).cast("long"), F.lit(9).cast("long")).alias("missing_ids"))
    used = sessions.select("session_id", F.explode(F.array(F.lit(5), F.lit(6), F.lit(0)).cast("array<long>")).alias("question_id")).where("NOT (session_id = 3 AND question_id = 5)")
    rows, most = largest(pools.next_questions(sessions, questions, used))
    assert {(r["session_id"], r["next_question_id"]) for r in rows} == {(k, 5 if k == 3 else 7) for k in range(400)}
    assert most <= 5_000


def test_questions_of_equal_texts_are_compared_once(spark):
    """Two texts, one letter apart, of 60 questions each: only the result holds their pairs, and no join does before."""
    text = F.when(F.col("id") % 2 == 0, "What is a warm plate?").otherwise("What is a warm plates?")
    rows = spark.range(120).select("id", F.lit(1).alias("subject_id"), text.alias("question_text"))
    pairs, _ = largest(gates.repeated_questions(rows, rows))
    assert {(r["id"], r["other_id"]) for r in pairs} == {(a, b) for a in range(120) for b in range(120) if a != b}
    texts, most = largest(gates._near_texts(rows, rows, True))
    assert most <= 600 and len({(r["question_a"], r["question_b"]) for r in texts}) == len(texts) == 4


def test_shared_counts_equal_plain_ones():
    """Numbers that most lists hold, rare ones, none at all, and lists without any."""
    make = np.random.default_rng(1)
    left, right = ([np.unique(np.concatenate([make.integers(0, 3, 2), make.integers(-(2**62), 2**62, 2), make.integers(10, 2000, k % 40)])) if k % 7 else np.array([], np.int64) for k in range(n)] for n in (70, 90))
    got = similar.shared_counts(left, right)
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
    assert similar.shared_counts([], right).shape == (0, 90) and not similar.shared_counts([left[0]], right).any()


def test_search_hands_on_only_what_can_be_chosen(spark):
    """Ten queries share two words with each of 300 units: all are rescued, but a search of four needs no more than five of a block."""
    units = spark.range(300).select("id", F.lit(1).alias("subject_id"), F.when(F.col("id") < 200, 5).otherwise(6).alias("document_id"), F.lit(2).alias("topic_id"), F.concat(F.lit("memory attention "), F.col("id") + 1000).alias("content"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    queries = spark.range(10).select(F.col("id").alias("query_id"), F.lit(1).alias("subject_id"), F.lit(None).cast("int").alias("topic_id"), F.lit("memory attention span").alias("text"), F.lit(None).cast("array<double>").alias("vector"))
    none = spark.createDataFrame([], "query_id long, unit_id long")
    assert retrieval.rescue(queries, units, none).count() == 3000
    rows, most = largest(retrieval.rescue(queries, units, none, 4))
    assert {(r["query_id"], r["unit_id"]) for r in rows} == {(q, u) for q in range(10) for u in (0, 1, 2, 3, 200)}
    assert most <= 400
    chosen = retrieval.search(queries, units, 4).where("query_id = 3").orderBy("place").collect()
    assert [r["unit_id"] for r in chosen] == [0, 200, 1, 2]


def test_evidence_of_a_source_is_ranked_within_blocks(spark):
    """Forty questions name a source of 200 units: no join gives all 8,000 pairs, and each keeps the five best of a role."""
    units = spark.range(200).select("id", F.lit(1).alias("subject_id"), F.lit(5).alias("document_id"), F.lit(2).alias("topic_id"), F.lit("doc5").alias("stem"), F.lit(3).alias("page"), F.concat(F.lit("memory "), F.when(F.col("id") % 50 == 7, "attention span")).alias("content"), F.array(F.lit(1.0)).alias("vector"))
    units = units.withColumn("content", F.coalesce("content", F.lit("nothing here")))
    q = spark.range(40).select("id", F.lit(1).alias("subject_id"), F.lit(None).cast("int").alias("topic_id"), F.lit("doc5").alias("stem"), F.array().cast("array<int>").alias("pages"), F.lit("attention span").alias("question_text"), F.lit("tag").alias("tags"), F.lit("memory").alias("points"), F.lit(True).alias("canonical"), F.array(F.lit(1.0)).alias("vector"))
    rows, most = largest(retrieval._from_source(q, units, 5))
    assert {(r["unit_id"], r["role"], r["place"]) for r in rows if r["id"] == 9} == {(7, "evidence", 1), (57, "evidence", 2), (107, "evidence", 3), (157, "evidence", 4), *((k, "rejected", k + 1) for k in range(5))}
    assert len(rows) == 360 and most <= 1000


def test_sources_give_what_joined_texts_give(spark):
    """Sixty questions on three sources, one of them null: the same problems, but no row holds a source's text."""
    q = spark.range(60).select("id", F.concat(F.lit("What is memory "), F.col("id") % 4 + 1000).alias("question_text"), F.lit("memory").alias("point_text"), (F.col("id") % 4).alias("source_id"))
    sources = spark.createDataFrame([(0, "Memori 1000 and attention"), (1, None), (2, "nothing")], "source_id long, content string")
    joined = q.join(sources, "source_id").withColumn("source_text", F.concat_ws(" ", "content", F.lit("memory")))
    want = {(r["id"], tuple(r["problems"])) for r in gates.concept_problems(joined).collect()}
    got = gates.concept_problems(q.withColumn("source_text", F.lit("memory")), sources)
    assert "content" not in got.columns and {(r["id"], tuple(r["problems"])) for r in got.collect()} == want and len(want) == 45


def test_questions_are_held_against_their_units_alone(spark, tmp_path):
    """The words of a question do not count as its source: F5 finds the questions whose units lack them, by both units."""
    part = spark.range(24).select(F.col("id").alias("p_partkey"), F.when(F.col("id") % 2 == 0, "memory attention").otherwise("quantum lattice").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("TYPE").alias("p_type"), F.lit(5).alias("p_size"))
    text = F.when(F.col("doc_id") % 7 == 0, "Memory and attentions of a span").when(F.col("doc_id") == 3, "Quantum lattices").otherwise("nothing here")
    documents = spark.range(200).select(F.col("id").alias("doc_id")).select("doc_id", text.alias("text"))
    for name, df in (("part", part), ("documents", documents), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("embeddings", spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["id"]: r["problems"] for r in questions.QUERIES["f5_concepts"](spark, str(tmp_path)).collect()}
    assert got == {k: "" if k % 2 == 0 or k == 3 else "question_concept_not_in_source" for k in range(24)}


def test_lines_are_dealt_once_for_furniture_and_once_for_titles(spark):
    """Twelve pages, in order or not, under one running head that is not written in one Unicode form."""
    head = F.when(F.col("page_number") % 2 == 0, "Ｒunning\u00a0head").otherwise("running  head ")
    line = F.when(F.col("k") == 0, head).when(F.col("k") == 1, F.concat(F.lit("  Chapter of "), F.element_at(F.array(*map(F.lit, "abcdefghijkl")), F.col("page_number")))).when(F.col("k") == 2, "").when(F.col("k") == 5, F.when(F.col("page_number") == 5, "## 1. Memory").otherwise("## A|B")).otherwise(F.concat(F.lit("Line "), F.col("line_no").cast("string"), F.lit(".")))
    lines = spark.range(120).select(F.lit(1).alias("doc_id"), (F.col("id") + 1).alias("line_no"), (F.floor(F.col("id") / 10).cast("int") + 1).alias("page_number"), (F.col("id") % 10).alias("k")).withColumn("line", line).drop("k")
    lines = lines.unionByName(lines.where("page_number = 1").withColumn("doc_id", F.lit(2)))
    furniture = segment.page_furniture(lines)
    assert {tuple(r) for r in furniture.collect()} == {(1, "running head", 12)}
    titles = segment.section_titles(lines, furniture)
    rows = {(r["doc_id"], r["line_no"]): (r["section_title"], r["page_topic"]) for r in titles.collect()}
    assert len(rows) == 12 * 9 + 9
    assert all(rows[1, n][1] == f"Chapter of {'abcdefghijkl'[(n - 1) // 10]}" for d, n in rows if d == 1)
    assert {n: t for (d, n), (t, _) in rows.items() if d == 1 and t} == {n: "Memory" for n in range(46, 56) if n != 53}
    assert {topic for (d, _), (_, topic) in rows.items() if d == 2} == {"running head"}
    for df, most in ((furniture, 1), (titles, 2)):
        assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= most


def test_samples_meet_no_row_for_each_offer(spark):
    """300 learners draw from twelve topics, two of which have one question; recent ones fill what is left."""
    topic = F.when(F.col("id") < 2, F.concat(F.lit("small"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("t"), (F.col("id") % 10).cast("string")))
    questions = spark.range(242).select("id", F.lit(1).cast("long").alias("subject_id"), topic.alias("topic_name"), F.col("id").cast("string").alias("concept"))
    learners = spark.range(300).withColumnRenamed("id", "user_id")
    recently = learners.select("user_id", F.lit(1).cast("long").alias("subject_id"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (F.col("user_id") * k * 7) % 242)).alias("question_id")).distinct()
    seen = {}
    for r in recently.collect():
        seen.setdefault(r["user_id"], set()).add(r["question_id"])
    for subject in (questions, questions.where("topic_name IN ('small0', 'small1', 't3') AND id < 14")):
        rows, most = largest(pools.balanced_sample(subject, recently, 8, 7))
        assert most <= 3_000
        chance = lambda x: hashlib.md5(f"7:{x}".encode()).hexdigest()
        held = [(r["id"], r["topic_name"]) for r in subject.collect()]
        topics = sorted({t for _, t in held}, key=lambda t: (chance(t), t))[:8]
        want = set()
        for user, had in seen.items():
            turns = []
            for place, t in enumerate(topics):
                own = sorted((x in had, chance(x), x) for x, of in held if of == t)
                turns += [(turn, place, x, t, int(recent)) for turn, (recent, _, x) in enumerate(own)]
            want |= {(user, 1, x, t, recent, k + 1) for k, (_, _, x, t, recent) in enumerate(sorted(turns)[:8])}
        assert {tuple(r) for r in rows} == want


def test_card_units_are_put_together_once(spark):
    """Units come from a join, as in the adapter; the search that goes through them again and again does not make it anew."""
    text = F.concat(F.lit("Unit on retrieval practice with many more words than ten, so that it is evidence for cards number "), F.col("id").cast("string"))
    vectors = spark.range(77).select("id", F.array(F.lit(1.0), F.col("id") / 100).alias("vector"))
    units = spark.range(77).join(vectors, "id").select("id", F.lit(0).cast("long").alias("subject_id"), (F.col("id") % 5).alias("document_id"), F.lit(1).alias("topic_id"), text.alias("content"), "vector")
    reported = spark.range(20).select(F.concat(F.lit("r"), (F.col("id") + 10).cast("string")).alias("stable_id"), F.lit(0).cast("long").alias("subject_id"), F.concat(F.lit("Retrieval practice "), F.col("id").cast("string")).alias("wording"), F.lit("exact_reported").alias("provenance"), F.lit("current").alias("reliability"), F.lit(None).cast("string").alias("chain_id"), F.lit("open").alias("answerability"), F.array(F.lit("memory")).alias("topic_tags"), F.array(F.lit("act")).alias("required_actions"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    stored = reported.where("stable_id = 'r12'").select("subject_id", F.col("stable_id").alias("origin_id"), F.lit("other").alias("question_text"))
    cards = pools.training_cards(reported, units, stored, 4)
    assert "Range (0, 77," not in cards._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["stable_id"]: r for r in cards.collect()}
    assert {k: r["outcome"] for k, r in rows.items()} == {"r10": "created", "r11": "created", "r12": "existing", "r13": "created"}
    assert all(len(r["points"]) == 3 and r["points"][0]["text"].startswith("Unit on") for k, r in rows.items() if k != "r12")


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    """4,000 questions in two subjects on six vectors each, one of them with a null and one far from all; ids come again in the other subject."""
    vector = F.when(F.col("k") == 4, F.array(F.lit(1.0), F.lit(0.0), F.lit(None).cast("double"))).when(F.col("k") == 5, F.array(F.lit(-1.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.col("k") / 100))
    rows = spark.range(2000).crossJoin(spark.range(2).withColumnRenamed("id", "subject_id")).withColumn("k", F.col("id") % 6).select("id", "subject_id", vector.alias("embedding"))
    calls = []
    blocks = similar.in_block_pairs
    monkeypatch.setattr(similar, "in_block_pairs", lambda left, right, *rest: calls.append((left.count(), right.count())) or blocks(left, right, *rest))
    got = similar.vector_pairs(rows.where("id % 100 = 0"), rows, 0.92)
    near, n = [k for k in range(0, 2000, 100) if k % 6 < 4], sum(k % 6 < 4 for k in range(2000))
    opposite = [k for k in range(0, 2000, 100) if k % 6 == 5]
    assert got.count() == 2 * (len(near) * (n - 1) + len(opposite) * (sum(k % 6 == 5 for k in range(2000)) - 1))
    assert got.where("id = 0 AND other_id % 6 = 0").distinct().count() == sum(k % 6 == 0 for k in range(1, 2000))
    assert max(calls[0]) <= 40


def test_questions_that_differ_by_id_alone_are_resolved_once(spark, monkeypatch):
    """600 questions of six kinds, told apart by nulls too: what is compared are the kinds, and each question has its kind's rows."""
    units = spark.range(40).select("id", F.lit(1).alias("subject_id"), (F.col("id") % 3).alias("document_id"), F.lit(2).alias("topic_id"), F.when(F.col("id") < 20, "doc5").otherwise("doc6").alias("stem"), (F.col("id") % 9).cast("int").alias("page"), F.concat(F.lit("memory attention "), F.when(F.col("id") == 30, "SPAN encoder").otherwise("nothing")).alias("content"), F.array(F.lit(1.0), F.col("id") / 40).alias("vector"))
    kind, none = F.col("id") % 6, F.lit(None)
    q = spark.range(600).select(
        "id", F.lit(1).alias("subject_id"), F.when(kind == 4, 3).otherwise(none).cast("int").alias("topic_id"), F.when(kind < 2, "doc5").alias("stem"), F.when(kind == 0, F.array(F.lit(4), none.cast("int"))).otherwise(F.array(none.cast("int"), F.lit(5))).alias("pages"),
        F.lit("Which SPAN of encoder?").alias("question_text"), F.when(kind == 2, "tag").alias("tags"), F.when(kind == 5, "").alias("points"), (kind != 3).alias("canonical"), F.when(kind != 5, F.array(F.lit(1.0), F.lit(0.5))).alias("vector"),
    )
    calls = []
    blocks = similar.in_block_pairs
    monkeypatch.setattr(similar, "in_block_pairs", lambda left, right, *rest: calls.append(left.count()) or blocks(left, right, *rest))
    got = {}
    for r in retrieval.resolve_evidence(q, units).collect():
        got.setdefault(r["id"], set()).add(tuple(r)[1:])
    assert max(calls) <= 6 and len(got) == 600
    assert all(got[k] == got[k % 6] for k in got)
    alone = {}
    for r in retrieval.resolve_evidence(q.where("id < 6"), units).collect():
        alone.setdefault(r["id"], set()).add(tuple(r)[1:])
    assert {k: got[k] for k in range(6)} == alone
    assert [sorted(x[4] for x in got[k] if x[3] == "evidence") for k in (0, 1)] == [[3, 4, 5, 12, 13], [4, 5, 6, 13, 14]]
    assert all(30 in {x[4] for x in got[k]} for k in (2, 3, 4, 5)) and {x[0] for x in got[4]} == {"topic_search"}


def test_capitals_are_found_wherever_they_stand(spark):
    """Tokens in capitals, also within longer words, by runs of capitals as by the whole text."""
    texts = ["RESTARTED start art", "The GPU-based gpu", "ÀÉÎ àéî aéî", "Straße STRASSE", "ÿab ŸAB", "no capitals at all", "A1B2 a1b2 x1B2 1b2", "", None, "AB\nC abc", "ABCİ abc"]
    text = F.col("text")
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("tokens", retrieval.X.long_tokens(text))
    plain = F.filter("tokens", lambda t: F.contains(text, F.upper(t)))
    got = rows.select("text", F.coalesce(retrieval._capitals(F.col("tokens"), text), F.array().cast("array<string>")).alias("got"), F.coalesce(plain, F.array().cast("array<string>")).alias("want")).collect()
    assert all(r["got"] == r["want"] for r in got) and sum(len(r["got"]) for r in got) >= 8


def test_pairs_of_questions_come_apart_row_by_row(spark, small):
    """What a pair of texts holds is rounded once, and the rows of a block go one by one into their pairs."""
    df = questions.QUERIES["f8_near_questions"](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    last = plan.split("Exchange")[0]
    assert "round(" in plan and "round(" not in last
    assert [word for word in last.replace("\n", " ").split() if word in ("Generate", "Coalesce")] == ["Generate", "Coalesce", "Generate"]
    rows = spark.createDataFrame([(1, 1, "What do alpha beta gamma delta epsilon zeta mean?"), (2, 1, "What do alpha beta gamma delta epsilon zeta eta mean?"), (3, 1, "What do alpha beta gamma delta epsilon zeta mean?")], "id long, subject_id long, question_text string")
    got = {tuple(r) for r in gates.near_questions(rows, rows, letters=False, digits=2).select("id", "other_id", "jaccard").collect()}
    whole = {(a, b): j for a, b, j in (tuple(r) for r in gates.near_questions(rows, rows, letters=False).select("id", "other_id", "jaccard").collect())}
    assert len(got) == 6 and got == {(a, b, round(j, 2)) for (a, b), j in whole.items()} and whole[1, 2] != round(whole[1, 2], 2)
