"""Work that is done once, or only where it can change something; with the same results as plain patterns give."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylake.functions import text as X
from studylake.operators import gates, quality
from studylake.plans import files as plan_files
from studylake.sources import files

ODD = [
    "", " ", "\n", "a", "Plain text.", "Tabs\t\tand  blanks", "a\r\nb\rc", "line-\nend", "LINE-\nEND", "a\n\n\n\nb", " wide　", "\x85\x1c x \x0b", "a\xa0\xa0b", "bullet", "ends \n", "x ", "᠎a",
    "The exam needs registration", "Klauſur and Anmeldung, Klausur", "EXAM\n\nADMIſſION", "office   hours", "office\nhours", "Offıce hours", "OFFİCE HOURS", "submission\tdeadline", "Moodle has slides", "Übungspunkte zur Prüfung",
    "table\nof contents", "Table of  Contents", "Outline of the Course", "KURSZıELE", "Lernziele:\nx", "a . . . . 1 b . . . . 2", "a .... 1 b .... 2", "a .  .  .  . 1 b.\t.\t.\t.2", "Contents\n1 Title 2\n2 Other 3\n",
    "© me", "COPYRIGHT", "copyrıght", "All Rights Reſerved", "image\n source", "ımage source", "Photo   credit", "photo", "wordJoined here", "wortJoined.", "langesÜber alles", "a|b\nc", "a|b\nc|d", "x = (1", "sin (x", "√", "log x", "f(x)=",
]


def test_texts_left_alone_are_those_that_no_pattern_changes(spark):
    """Each text as the patterns alone, without the look at pieces before, would have it."""
    t = F.col("t")
    plain = t
    for pattern, to in ((r"\r\n?", "\n"), (X.PRIVATE_USE, "• "), (r"(?<=[a-zäöüß])-\n(?=[a-zäöüß])", ""), ("[\t ]+", " "), (r"\n{3,}", "\n\n"), (r"(?U)^\s+|\s+$", "")):
        plain = F.regexp_replace(plain, pattern, to)
    flat = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"(?U)^\s+|\s+$", "")
    outline = F.substring(flat, 1, 220).rlike(f"(?iU){X.OVERVIEW}") | F.regexp_replace(t, r"(?U)^\s+|\s+$", "").rlike(f"(?i){X.OBJECTIVES}") | (F.regexp_count(t, F.lit(X.LEADERS)) >= 2)
    outline = outline | (t.rlike(f"(?i){X.CONTENTS}") & (F.regexp_count(t, F.lit(X.CONTENTS_ENTRY)) >= 2))
    admin = F.exists(F.array(*(flat.rlike(f"(?iU){p}") for p in X.ADMINISTRATION)), lambda x: x)
    want = [plain, F.regexp_replace(t, r"(?U)^\s+|\s+$", ""), F.when(admin, "course_administration").when(outline, "outline_without_explanation"), t.rlike(f"(?iu){X.ATTRIBUTION}"), t.rlike(X.JOINED), t.rlike(f"(?i){X.FORMULA}")]
    got = [X.normalize(t, lambda c: c), X.strip(t), X.purpose_problem(t), X.attribution(t), X.joined_words(t), X.has_formula(t)]
    df = spark.createDataFrame([(x,) for x in [*ODD, None]], "t string")
    for row in df.select("t", F.array(*(c.cast("string") for c in want)).alias("want"), F.array(*(c.cast("string") for c in got)).alias("got")).collect():
        assert row["got"] == row["want"], row["t"]


def test_a_queue_in_order_makes_its_units_once(spark):
    """Confidence is made by Python here, which counts: Spark's sort asks for it once for a row, not again for its bounds."""
    calls = spark.sparkContext.accumulator(0)

    def counted(x):
        calls.add(1)
        return x % 7 / 10

    units = spark.range(200).repartition(4).select(F.col("id").alias("document_id"), F.lit(1).alias("source_start"), F.lit("needs_review").alias("review_status"), F.udf(counted, T.DoubleType())("id").alias("confidence"), F.array(F.lit("x")).alias("problems"))
    rows = quality.review_queue(units, suspicious_only=True).collect()
    assert [(r["confidence"], r["document_id"]) for r in rows] == sorted((k % 7 / 10, k) for k in range(200))
    assert calls.value == 200


def test_close_words_are_those_of_the_ratio():
    """Random words of few letters, some of which share a bit; lists that come again, and empty ones."""
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdä!€1") for _ in range(draw.randint(1, 9))) for _ in range(200)]
    left, right = [draw.sample(words, 6) for _ in range(60)], [draw.sample(words, draw.randint(0, 40)) for _ in range(30)] * 2
    for least in (gates.FUZZY_TERM, gates.FUZZY_CONCEPT):
        want = [sum(any(SequenceMatcher(None, word, other).ratio() >= least for other in b) for word in a) for a, b in zip(left, right)]
        assert gates.close_counts([*left, None], [*right, ["a"]], least) == [*want, 0] and sum(want) > 0


def test_claims_are_pruned_alike_by_named_units(spark):
    """Units named by id give what their contents in each row give; a unit that is not there is no evidence."""
    claims = spark.range(24).select((F.col("id") % 6).alias("answer_id"), (F.col("id") / 6).cast("int").alias("k"), F.element_at(F.array(*map(F.lit, ("correct", "partial", "incorrect"))), (F.col("id") % 3 + 1).cast("int")).alias("category"), F.concat(F.lit("memori span "), F.col("id") % 4 + 1000).alias("text"), F.when(F.col("id") % 5 == 0, F.array(F.lit(9).cast("long"))).alias("cited"), (F.col("id") % 2 == 0).alias("contradicted"))
    ids = spark.createDataFrame([(a, u) for a in range(6) for u in (a % 3, 2, 9)], "answer_id long, unit_id long").distinct()
    units = spark.createDataFrame([(0, "memory 1000"), (1, "memory span 1001"), (2, "the span")], "unit_id long, content string")
    want = {tuple(map(str, r)) for r in gates.prune_claims(claims, ids.join(units, "unit_id")).collect()}
    assert {tuple(map(str, r)) for r in gates.prune_claims(claims, ids, units).collect()} == want and len(want) > 5


def test_bank_files_are_written_by_all_tasks(spark):
    """Small rows of 40 banks: no few tasks write all their files; a named schema gives what the inferred one does."""
    rows = spark.range(40).select(F.col("id").alias("bank"), F.concat(F.lit('{"questions": [{"id": "'), F.col("id"), F.lit('", "text": "What?"}]}')).alias("value"))
    path = plan_files._put(rows, "banks", ["bank"], [])
    with_tasks = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"part-(\d+)-", 1).alias("task")).distinct().count()
    assert with_tasks > 1
    named, found = files.json_bank(spark, path, "questions array<struct<id:string, text:string>>"), files.json_bank(spark, path)
    assert sorted(map(str, named.collect())) == sorted(map(str, found.collect())) and named.count() == 40
