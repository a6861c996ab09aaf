"""Gates on candidate questions: form, support, citations, duplicates, acceptance, coverage (F1-F16), and answers."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import similar

# Limits of the gates.
MIN_QUALITY, MIN_QUOTE, MIN_WORDS, MAX_WORDS, MAX_CHARS = 0.8, 20, 4, 55, 450
SUPPORTED, REPEATS, SAME_SIDE = 0.6, 0.9, 0.8
FUZZY_TERM, FUZZY_CONCEPT, FUZZY_QUESTION, SAME_TERMS, SAME_VECTORS = 0.86, 0.82, 0.9, 0.8, 0.92
BATCH_UNITS, BATCH_CHARS, BATCH_WORDS = 4, 12_000, 8
#: Ids in a block of questions with one text.
PAIR_BLOCK = 1024
# Question forms.
DANGLING = r"\b(?:does|do)\b.+\ballow(?:s)?\s+.+\s+from\?$"
QUOTATION = r"(this|following) (passage|excerpt|text)|in your own words|diese[nmrs]? (Text|Abschnitt)|eigenen Worten"
ASKS_COMPARISON = r"difference|differ|unterschied|vergleichen"
COMPARISONS = (
    r"difference between (.+?) and (.+?)\?", r"how (?:does|do) (.+?) differ from (.+?)\?", r"how (?:does|do) (.+?) and (.+?) differ\b",
    r"unterschied(?:e)? zwischen (.+?) und (.+?)\?", r"wie unterscheidet sich (.+?) von (.+?)\?",
)
# Words that the sides of a comparison don't differ by.
SIDE_STOP = ("the", "a", "an", "level", "in", "for", "of", "der", "die", "das", "im", "für", "von")
# Categories of claims that keep only citations of their answer's evidence.
SURE_CLAIMS = ("correct", "missing", "incorrect")
NUMBERS = r"\b\d+(?:[.,]\d+)?\b"


def _problems(*flags: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(flag, name) for flag, name in flags)))


def schema_problems(candidates: DataFrame) -> DataFrame:
    """what breaks a candidate's schema: question_type, difficulty, duration, quality, points (text, source_quote)."""
    kinds = ("explanation", "definition", "connection", "comparison", "application")
    bad_points = F.exists("points", lambda p: (F.length(F.trim(p["text"])) < 3) | (F.length(p["source_quote"]) < 20) | (F.length(p["source_quote"]) > 800))
    return candidates.withColumn("problems", _problems(
        (F.length(F.trim("question_text")) < 8, "question_text"), (~F.col("question_type").isin(*kinds), "question_type"), (~F.col("difficulty").isin("easy", "medium", "hard"), "difficulty"),
        (~F.col("expected_duration_seconds").between(30, 180), "duration"), (~F.col("quality_score").between(0, 1), "quality_score"), (F.size("points") < 1, "no_points"), (bad_points, "points"),
    ))


def form_problems(questions: DataFrame) -> DataFrame:
    """questions that are unclear, cut off, quote a passage, have low quality or ask about administration."""
    text = X.strip(F.col("question_text"))
    words = F.size(F.split(text, r"(?U)\s+"))
    return questions.withColumn("problems", F.concat(_problems((X.purpose_problem(text).isNotNull(), "purpose")), _problems(
        (~F.endswith(text, F.lit("?")) | (words < 3), "unclear_question"), (text.rlike(f"(?iU){DANGLING}"), "incomplete_question_clause"),
        (text.rlike(f"(?i){QUOTATION}"), "passage_quotation"), (F.coalesce("quality_score", F.lit(0.0)) < MIN_QUALITY, "low_quality"),
    )))


#: Words and lists of words that a worker keeps what it found out about.
KEPT_WORDS = 1 << 20


@functools.lru_cache(KEPT_WORDS >> 2)
def _letters(word: str) -> int:
    """The letters of a word as bits; several letters may share one."""
    return functools.reduce(operator.or_, (1 << (ord(c) & 63) for c in word), 0)


@functools.lru_cache(KEPT_WORDS >> 2)
def _alike(word: str, other: str, at_least: float) -> bool:
    """Whether the ratio of two words is `at_least`; its cheap upper bound comes first."""
    matcher = SequenceMatcher(None, other, word)
    return matcher.quick_ratio() >= at_least and SequenceMatcher(None, word, other).ratio() >= at_least


def _spelt_closely(words: list[str], others: tuple, letters: np.ndarray, lengths: np.ndarray, at_least: float) -> set[str]:
    """Those of the words that have one among the others with a ratio of `at_least`.

    That many letters have to match in each of two words, and none matches that the other word lacks: most words are told
    apart by the numbers of such letters, all at once.
    """
    own, n = np.array([_letters(w) for w in words], np.uint64)[:, None], np.array([len(w) for w in words])[:, None]
    least = at_least * (lengths + n) / 2 - 1e-9
    near = (lengths - np.bitwise_count(letters & ~own) >= least) & (n - np.bitwise_count(own & ~letters) >= least)
    close: set[str] = set()
    for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
        if words[i] not in close and _alike(words[i], others[j], at_least):
            close.add(words[i])
    return close


def close_counts(words: Iterable, actual: Iterable, at_least: float) -> list[int]:
    """How many of each list's words have one spelt closely in the list beside it.

    Lists that come again, as a source's do for each of its claims, are asked for each word once.
    """
    known: dict[tuple, tuple[np.ndarray, np.ndarray, dict]] = {}
    kept, out = 0, []
    for left, right in zip(words, actual):
        n = 0
        if left is not None and right is not None and len(left) and len(right):
            others = tuple(right)
            if others not in known:
                if kept > KEPT_WORDS:
                    known, kept = {}, 0
                known[others] = (np.array([_letters(x) for x in others], np.uint64), np.array([len(x) for x in others], np.int64), {})
                kept += len(others)
            letters, lengths, found = known[others]
            fresh = [word for word in left if word not in found]
            if fresh:
                close = _spelt_closely(fresh, others, letters, lengths, at_least)
                found.update((word, word in close) for word in fresh)
                kept += len(fresh)
            n = sum(found[word] for word in left)
        out.append(n)
    return out


def fuzzy_share(rows: DataFrame, expected: str, available: str, at_least: float, out: str) -> DataFrame:
    """The share of the terms in one array column that the other holds, exactly or as a close spelling.

    Equal terms are settled by the JVM; Python sees the rest only, and only where both sides have some.
    """
    rest = F.array_except(expected, available)

    @F.pandas_udf("int")
    def close(words: pd.Series, actual: pd.Series) -> pd.Series:
        return pd.Series(close_counts(words, actual, at_least))

    shared = F.size(F.array_intersect(expected, available)) + close(F.when(F.size(rest) > 0, rest), F.when(F.size(rest) > 0, F.col(available)))
    return rows.withColumn(out, shared / F.greatest(F.lit(1), F.size(expected)))


def support(rows: DataFrame, claim: str, source: str, out: str = "support") -> DataFrame:
    """the share of a claim's terms that the source supports."""
    rows = rows.withColumn("__claim", X.claim_terms(F.col(claim))).withColumn("__source", X.claim_terms(F.col(source)))
    return fuzzy_share(rows, "__claim", "__source", FUZZY_TERM, out).drop("__claim", "__source")


def point_problems(points: DataFrame, units: DataFrame) -> DataFrame:
    """problems of points (question_id, k, text, source_quote, unit_id, cited: whether the question cites the unit)
    with one row for each cited unit; one row for each point comes back, with its support by the quote."""
    flat = lambda c: X.strip(F.regexp_replace(c, r"(?U)\s+", " "))
    rows = points.join(units.where("review_status = 'accepted'").select(F.col("id").alias("unit_id"), flat(F.col("content")).alias("content")), "unit_id", "left").withColumn("quote", flat(F.col("source_quote")))
    known = F.col("content").isNotNull() & F.col("cited")
    found = F.coalesce((F.length("quote") >= MIN_QUOTE) & F.contains("content", F.col("quote")), F.lit(False))
    each = rows.groupBy("question_id", "k").agg(F.first("text").alias("text"), F.first("quote").alias("quote"), F.bool_and(known).alias("known"), F.bool_or(found).alias("found"))
    each = support(each, "text", "quote")
    words = F.size(F.split(X.strip(F.col("text")), r"(?U)\s+"))
    numbers = F.size(F.array_except(F.regexp_extract_all("text", F.lit(NUMBERS), F.lit(0)), F.regexp_extract_all("quote", F.lit(NUMBERS), F.lit(0))))
    return each.select("question_id", "k", "support", _problems(
        (~F.col("known"), "invalid_point_citation"), ((words < MIN_WORDS) | (words > MAX_WORDS) | (F.length("text") > MAX_CHARS), "fragment_or_copied_slide"),
        (~F.col("found"), "missing_exact_support_quote"), (F.col("found") & (F.col("support") < SUPPORTED), "answer_not_supported_by_quote"), (numbers > 0, "unsupported_numeric_claim"),
    ).alias("problems"))


def concept_problems(questions: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """questions (id, question_text, point_text, source_text) whose answer repeats them or whose terms the source lacks.

    With `sources` (source_id, content) questions name one by source_id or some by source_ids, whose terms count together,
    and with those of a source_text if there is one; each is cut into terms once, however many questions name it, and each
    text is held against the same sources once. Questions without such a source have no row.
    """
    rows = support(questions, "point_text", "question_text", "repeats")
    if sources is None:
        rows = support(rows, "question_text", "source_text", "in_source")
    else:
        none = F.array().cast("array<string>")
        names = F.col("source_ids") if "source_ids" in questions.columns else F.array("source_id")
        own = F.col("source_text") if "source_text" in questions.columns else F.lit(None).cast("string")
        asked = questions.select(F.col("question_text").alias("__asked"), own.alias("__own"), names.alias("__names")).distinct()
        listed = asked.select("__names").distinct().select("__names", F.explode(F.array_distinct("__names")).alias("source_id"))
        named = sources.join(listed.select("source_id").distinct(), "source_id", "left_semi").select("source_id", F.coalesce(X.claim_terms(F.col("content")), none).alias("__held"))
        held = listed.join(named, "source_id").groupBy("__names").agg(F.array_distinct(F.flatten(F.collect_list("__held"))).alias("__held"))
        asked = asked.join(held, "__names").withColumn("__claim", X.claim_terms(F.col("__asked"))).withColumn("__source", F.array_union("__held", F.coalesce(X.claim_terms(F.col("__own")), none)))
        asked = fuzzy_share(asked, "__claim", "__source", FUZZY_TERM, "in_source").select("__asked", "__own", "__names", "in_source")
        same = F.col("question_text").eqNullSafe(F.col("__asked")) & own.eqNullSafe(F.col("__own")) & names.eqNullSafe(F.col("__names"))
        rows = rows.join(asked, same).drop("__asked", "__own", "__names")
    return rows.withColumn("problems", _problems((F.col("repeats") >= REPEATS, "answer_repeats_question"), (F.col("in_source") < SUPPORTED, "question_concept_not_in_source")))


def comparison_sides(text: Column) -> Column:
    """the sides of a comparison, by the first form that fits; null if none does."""
    sides = [F.when(text.rlike(f"(?i){p}"), F.struct(F.regexp_extract(text, f"(?i){p}", 1).alias("left"), F.regexp_extract(text, f"(?i){p}", 2).alias("right"))) for p in COMPARISONS]
    return F.coalesce(*sides)


def comparison_problems(questions: DataFrame) -> DataFrame:
    """comparisons (id, question_text, rubric) with a side or context that the rubric does not support, or of one thing."""
    rows = questions.where(F.col("question_text").rlike(f"(?i){ASKS_COMPARISON}")).withColumn("sides", comparison_sides(F.col("question_text"))).where("sides IS NOT NULL")
    parts = F.split("sides.right", r"(?i)\s+(?:in|for|within|bei|für)\s+", 2)
    rows = rows.select("id", "rubric", F.col("sides.left").alias("left"), parts[0].alias("right"), F.coalesce(F.get(parts, F.lit(1)), F.regexp_extract("question_text", r"(?i)\bdiffer in (.+?)\?$", 1)).alias("context"))
    for side in ("left", "right", "context"):
        rows = support(rows, side, "rubric", f"{side}_support")
    terms = lambda c: F.array_except(F.array_distinct(F.transform(F.regexp_extract_all(X.casefold(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda t: F.regexp_replace(t, "s$", ""))), F.array(*map(F.lit, SIDE_STOP)))
    a, b = terms(F.col("left")), terms(F.col("right"))
    same = (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b))) >= SAME_SIDE)
    return rows.select("id", "left", "right", _problems(
        ((F.col("context") != "") & (F.col("context_support") < SAME_SIDE), "unsupported_comparison_context"), (F.least("left_support", "right_support") < SAME_SIDE, "comparison_missing_expected_side"), (same, "comparison_of_same_concept_and_example"),
    ).alias("problems"))


def subsumed(points: DataFrame, existing: DataFrame) -> DataFrame:
    """questions of whose points (question_id, k, text, unit_id) each shares a unit with, and is supported by, a point of
    one existing question."""
    pairs = points.join(existing.select(F.col("question_id").alias("other_id"), F.col("text").alias("other_text"), "unit_id"), "unit_id").select("question_id", "k", "text", "other_id", "other_text").distinct()
    held = support(pairs, "text", "other_text").where(F.col("support") >= REPEATS).groupBy("question_id", "other_id").agg(F.count_distinct("k").alias("held"))
    total = points.groupBy("question_id").agg(F.count_distinct("k").alias("total"))
    return held.join(total, "question_id").where("held = total").select("question_id", "other_id")


def _near_texts(candidates: DataFrame, existing: DataFrame, letters: bool) -> DataFrame:
    """Pairs (subject_id, question_a, question_b) of different or equal texts of candidates and existing questions that can
    repeat each other, with jaccard, prefix, text_a and text_b; each text of a subject stands for all its questions."""
    one, two = (
        df.select("subject_id", F.col("question_text").alias("id")).where("id IS NOT NULL").distinct().select("subject_id", "id", X.question_key(F.col("id")).alias("key"), X.question_terms(F.col("id")).alias("terms"))
        for df in (candidates, existing)
    )
    often = two.select("subject_id", F.explode("terms").alias("term")).groupBy("subject_id", "term").agg(F.count(F.lit(1)).alias("times"))

    def rarest(df: DataFrame) -> DataFrame:
        rows = df.select("id", "subject_id", F.size("terms").alias("n"), F.explode("terms").alias("term")).join(often, ["subject_id", "term"], "left")
        place = F.row_number().over(Window.partitionBy("subject_id", "id").orderBy(F.coalesce("times", F.lit(0)), "term"))
        # |A and B| > 0.8 |A or B| leaves less than a fifth of either's terms unshared
        return rows.withColumn("k", place).where(F.col("k") <= F.floor(F.col("n") * 0.2) + 1).select("id", "subject_id", "term")

    def beginnings(df: DataFrame) -> DataFrame:
        """The first five, six and so on words of each question but all of them."""
        words = F.split("key", " ")
        return df.where(F.size(words) > 5).select("id", "subject_id", F.explode(F.transform(F.sequence(F.lit(5), F.size(words) - 1), lambda k: F.array_join(F.slice(words, 1, k), " "))).alias("key"))

    whole = [df.select("id", "subject_id", "key") for df in (one, two)]
    begun = [x.withColumnRenamed("id", "a").join(y.withColumnRenamed("id", "b"), ["subject_id", "key"]).select("subject_id", "a", "b") for x, y in ((beginnings(one), whole[1]), (whole[0], beginnings(two)))]
    met = rarest(one).withColumnRenamed("id", "a").join(rarest(two).withColumnRenamed("id", "b"), ["subject_id", "term"]).select("subject_id", "a", "b")
    met = met.unionByName(begun[0]).unionByName(begun[1])
    if letters:
        folded = [df.select("id", "subject_id", X.casefold(F.col("id")).alias("text")) for df in (one, two)]
        met = met.unionByName(similar.letter_candidates(*folded, FUZZY_QUESTION))
    left = one.select(F.col("id").alias("a"), "subject_id", F.col("key").alias("key_a"), F.col("terms").alias("terms_a"))
    right = two.select(F.col("id").alias("b"), "subject_id", F.col("key").alias("key_b"), F.col("terms").alias("terms_b"))
    rows = met.distinct().join(left, ["a", "subject_id"]).join(right, ["b", "subject_id"])
    jaccard = F.size(F.array_intersect("terms_a", "terms_b")) / F.greatest(F.lit(1), F.size(F.array_union("terms_a", "terms_b")))
    short, long = F.when(F.length("key_a") <= F.length("key_b"), F.col("key_a")).otherwise(F.col("key_b")), F.when(F.length("key_a") <= F.length("key_b"), F.col("key_b")).otherwise(F.col("key_a"))
    prefix = (F.size(F.split(short, " ")) >= 5) & F.startswith(long, F.concat(short, F.lit(" ")))
    return rows.select("subject_id", F.col("a").alias("question_a"), F.col("b").alias("question_b"), jaccard.alias("jaccard"), prefix.alias("prefix"), X.casefold(F.col("a")).alias("text_a"), X.casefold(F.col("b")).alias("text_b"))


def _of_questions(pairs: DataFrame, candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Pairs of texts as pairs (id, other_id) of their questions.

    The ids of a text lie in blocks of about `PAIR_BLOCK`; pairs of blocks are dealt evenly and come apart last, so that no
    pair of ids is shuffled and no text, however frequent, is left to one task.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        rows = df.select("subject_id", F.col("question_text").alias(f"question_{name}"), "id")
        keys = ["subject_id", f"question_{name}"]
        counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).alias("blocks"))
        return rows.join(counts, keys).groupBy(*keys, F.pmod(F.xxhash64("id"), "blocks").alias(f"block_{name}")).agg(F.collect_list("id").alias(f"ids_{name}"))

    met = pairs.join(blocks(candidates, "a"), ["subject_id", "question_a"]).join(blocks(existing, "b"), ["subject_id", "question_b"])
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(tasks, "subject_id", "question_a", "block_a", "question_b", "block_b").drop("subject_id", "question_a", "block_a", "question_b", "block_b")
    # between the two the rows of a block come one by one: code for both at once would hold all pairs of two blocks
    rows = met.withColumn("id", F.explode("ids_a")).drop("ids_a").coalesce(tasks).withColumn("other_id", F.explode("ids_b")).drop("ids_b")
    return rows.where("id != other_id")


def near_questions(candidates: DataFrame, existing: DataFrame, letters: bool = True, only: str | None = None, digits: int | None = None) -> DataFrame:
    """F8: pairs (id, other_id) of candidates and existing questions (id, subject_id, question_text) that can repeat each
    other: same terms by more than 0.8, a prefix of five words and more, or (unless not asked for) nearly the same letters.

    Pairs meet by a shared rare term: two texts alike by more than 0.8 share one of the rarest fifth of their terms, by how
    often they occur in the subject. Prefixes meet by equality of one question with the first words of the other, and
    letters by shared rare grams (`similar.letter_candidates`); no pair that repeats is lost by any of the three. All of
    this is done once for each text of a subject; a condition `only` on jaccard and prefix is tested there as well, and
    jaccard is rounded there to `digits`, not again for each pair of ids.
    """
    texts = _near_texts(candidates, existing, letters)
    texts = texts.where(only) if only else texts
    return _of_questions(texts if digits is None else texts.withColumn("jaccard", F.round("jaccard", digits)), candidates, existing)


def _repeating(pairs: DataFrame) -> DataFrame:
    """The pairs that repeat; letters are compared only where neither terms nor prefix decide."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0.0 if x is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])

    settled = (F.col("jaccard") > SAME_TERMS) | F.col("prefix")
    rows = pairs.withColumn("ratio", ratio(F.when(~settled, F.col("text_a")), F.when(~settled, F.col("text_b"))))
    return rows.where(settled | (F.col("ratio") > FUZZY_QUESTION)).drop("ratio", "text_a", "text_b")


def duplicate_questions(pairs: DataFrame) -> DataFrame:
    """F8: those of the pairs of `near_questions` that repeat."""
    return _repeating(pairs).select("id", "other_id", "jaccard", "prefix")


def repeated_questions(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """F8: `duplicate_questions` of all that `near_questions` finds, decided once for each pair of texts."""
    return _of_questions(_repeating(_near_texts(candidates, existing, True)), candidates, existing).select("id", "other_id", "jaccard", "prefix")


def vector_problems(vectors: DataFrame) -> DataFrame:
    """vectors that are missing, hold null or non-finite components, or have no length."""
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.select("id", F.when(v.isNull() | (F.size(v) == 0), "missing").when(odd, "not_finite").when(norm <= 1e-12, "zero").otherwise("valid").alias("state"))


def vector_duplicates(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """pairs (id, other_id, cosine) of candidates and existing questions (id, subject_id, embedding) of a subject whose
    vectors are alike by 0.92 or more; vectors that have a problem have no pairs."""
    return similar.vector_pairs(candidates, existing, SAME_VECTORS)


def verdicts(rows: DataFrame, checks: list[str]) -> DataFrame:
    """accepted if all boolean checks hold, nothing repeats and no reason stands; the reasons of all three."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(F.col(c), F.lit(False)), c) for c in checks)))
    reasons = F.array_sort(F.array_distinct(F.concat("reasons", failed, F.when(F.col("duplicate"), F.array(F.lit("duplicate"))).otherwise(F.array().cast("array<string>")))))
    return rows.select("id", (F.size(reasons) == 0).alias("accepted"), reasons.alias("reasons"))


def storable(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """candidates whose text is not stored yet in their subject; of equal ones the least id."""
    key = X.question_key(F.col("question_text"))
    fresh = candidates.withColumn("key", key).join(stored.select("subject_id", key.alias("key")).distinct(), ["subject_id", "key"], "left_anti")
    heads = fresh.groupBy("subject_id", "key").agg(F.min("id").alias("id"))
    return fresh.join(heads, ["subject_id", "key", "id"], "left_semi")


def acceptance(questions: DataFrame, units: DataFrame) -> DataFrame:
    """whether questions may be accepted: evidence, all of it accepted, and a rubric; else why not."""
    ids = questions.select("id", F.explode(F.array_compact(F.array("evidence_id_1", "evidence_id_2"))).alias("unit_id"))
    ok = units.where("review_status = 'accepted'").select(F.col("id").alias("unit_id")).distinct().withColumn("ok", F.lit(True))
    state = ids.join(ok, "unit_id", "left").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("ok").alias("n_ok"))
    rows = questions.join(state, "id", "left")
    reason = F.when(F.coalesce("n", F.lit(0)) == 0, "no_evidence").when(F.col("n_ok") < F.col("n"), "evidence_not_accepted").when(~F.col("has_rubric"), "no_rubric")
    return rows.select("id", reason.isNull().alias("acceptable"), reason.alias("reason"))


def citation_gate(packs: DataFrame) -> DataFrame:
    """sections (id, referenced, cited, allowed: arrays) that cite something and nothing that is not allowed."""
    used = F.array_union("referenced", "cited")
    return packs.select("id", ((F.size("cited") > 0) & (F.size(F.array_except(used, "allowed")) == 0)).alias("valid"), F.array_sort(F.array_except(used, "allowed")).alias("unknown"))


def uncovered_targets(sentences: DataFrame, points: DataFrame) -> DataFrame:
    """sentences (unit_id, k, sentence) of six words and more that no point (unit_id, text) of their unit supports by 0.8."""
    long = sentences.where(F.size(F.split(F.trim("sentence"), r"\s+")) >= 6)
    # both are cut into terms before they meet: a point's text once, not again for each sentence of its unit
    claims, sources = long.select("unit_id", "k", X.claim_terms(F.col("sentence")).alias("__claim")), points.select("unit_id", X.claim_terms(F.col("text")).alias("__source"))
    held = fuzzy_share(claims.join(sources, "unit_id"), "__claim", "__source", FUZZY_TERM, "support").where(F.col("support") >= SAME_SIDE).select("unit_id", "k").distinct()
    return long.join(held, ["unit_id", "k"], "left_anti")


def evidence_batches(units: DataFrame) -> DataFrame:
    """batches of units of eight words and more of a document and topic, in order: up to four units and 12,000 characters.

    Where a batch ends hangs on where the last one did, so that a group's units are folded in order, in one sorted pass.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, n, size, number = None, 0, 0, 0
        for batch in batches:
            numbers = []
            for document, topic, length in zip(batch["document_id"], batch["topic_id"], batch["length"]):
                if (document, topic) != group:
                    group, n, size, number = (document, topic), 0, 0, 0
                elif n == BATCH_UNITS or size + length > BATCH_CHARS:
                    n, size, number = 0, 0, number + 1
                n, size = n + 1, size + length
                numbers.append(number)
            yield batch.assign(batch=numbers)[["id", "document_id", "topic_id", "length", "batch"]]

    rows = units.where(F.size(F.split(X.strip(F.col("content")), r"(?U)\s+")) >= BATCH_WORDS)
    rows = rows.select("id", F.col("document_id").cast("long"), F.coalesce(F.col("topic_id").cast("long"), F.lit(-1)).alias("topic_id"), F.length("content").alias("length"))
    return rows.repartition("document_id", "topic_id").sortWithinPartitions("document_id", "topic_id", "id").mapInPandas(run, "id long, document_id long, topic_id long, length int, batch int")


def coverage_targets(batches: DataFrame, units: DataFrame, eligible: DataFrame) -> DataFrame:
    """F16: questions a batch should have (a hundredth of its words, 2 to 6), has, and needs."""
    words = batches.join(units.select("id", F.size(F.split(X.strip(F.col("content")), r"(?U)\s+")).alias("words")), "id")
    target = words.groupBy("document_id", "topic_id", "batch").agg(F.least(F.lit(6), F.greatest(F.lit(2), F.floor(F.sum("words") / 100))).alias("target"))
    touch = eligible.select(F.col("id").alias("question_id"), F.explode(F.array("evidence_id_1", "evidence_id_2")).alias("id")).join(batches, "id")
    have = touch.groupBy("document_id", "topic_id", "batch").agg(F.count_distinct("question_id").alias("covered"))
    rows = target.join(have, ["document_id", "topic_id", "batch"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return rows.withColumn("needed", F.greatest(F.lit(0), F.col("target") - F.col("covered")))


def grade_points(points: DataFrame) -> DataFrame:
    """For each point (answer_id, k, text, answer) the share of its terms in the answer, and the verdict on it."""
    rows = points.withColumn("__point", X.semantic_terms(F.col("text"))).withColumn("__answer", X.semantic_terms(F.col("answer")))
    rows = fuzzy_share(rows, "__point", "__answer", FUZZY_CONCEPT, "overlap").drop("__point", "__answer")
    return rows.withColumn("verdict", F.when(F.col("overlap") >= 0.2, "correct").when(F.col("overlap") >= 0.12, "partial").otherwise("missing"))


def grade_answers(graded: DataFrame) -> DataFrame:
    """Score of each answer from its points: coverage of correct ones, a quarter for partial ones; and its use of time."""
    rows = graded.groupBy("answer_id").agg(
        F.count_if(F.col("verdict") == "correct").alias("correct"), F.count_if(F.col("verdict") == "partial").alias("partial"), F.count(F.lit(1)).alias("points"),
        F.bool_or(F.trim("answer") != "").alias("answered"), F.first("duration_seconds").alias("duration_seconds"),
    )
    coverage = (F.col("correct") + 0.25 * F.col("partial")) / F.greatest(F.lit(1), F.col("points"))
    score = F.when(~F.col("answered") | (F.col("correct") + F.col("partial") == 0), 0)
    for least, value in ((0.9, 5), (0.65, 4), (0.42, 3), (0.2, 2)):
        score = score.when(coverage >= least, value)
    time = F.when(F.col("duration_seconds") < 20, "too_short").when(F.col("duration_seconds") > 150, "too_long").otherwise("appropriate")
    return rows.select("answer_id", "correct", "partial", "points", coverage.alias("coverage"), score.otherwise(1).alias("score"), time.alias("time_use"))


def prune_claims(claims: DataFrame, evidence: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Claims (answer_id, k, category, text, cited, contradicted) against their answer's evidence (answer_id, unit_id, content).

    With `units` (unit_id, content) evidence has no content; each unit is cut into terms once, however many answers name
    it, and evidence that is no such unit counts for nothing.

    A correct, missing or incorrect claim that cites anything else goes, and an incorrect one that the evidence does not
    contradict. Those that cite nothing, and partial and misplaced ones in any case, cite the unit that holds most of the
    claim's terms, spelt closely; the least id of several, and always one if the answer has evidence at all.
    """
    if units is None:
        held = evidence.select("answer_id", "unit_id", X.semantic_terms(F.col("content")).alias("__held"))
    else:
        named = units.join(evidence.select("unit_id").distinct(), "unit_id", "left_semi")
        evidence = evidence.join(units.select("unit_id"), "unit_id", "left_semi")
        held = evidence.join(named.select("unit_id", X.semantic_terms(F.col("content")).alias("__held")), "unit_id")
    allowed = evidence.groupBy("answer_id").agg(F.array_sort(F.collect_set("unit_id")).alias("allowed"))
    none = F.array().cast("array<bigint>")
    rows = claims.join(allowed, "answer_id", "left").withColumn("cited", F.coalesce("cited", none)).withColumn("allowed", F.coalesce("allowed", none))
    sure = F.col("category").isin(*SURE_CLAIMS)
    unknown = F.size(F.array_except("cited", "allowed")) > 0
    gone = (sure & unknown) | ((F.col("category") == "incorrect") & ~F.coalesce("contradicted", F.lit(False)))
    rows = rows.where(~gone).withColumn("kept", F.when(sure, F.array_sort(F.col("cited"))).otherwise(none)).select("answer_id", "k", "category", "text", "kept")
    pairs = rows.where("size(kept) = 0").select("answer_id", "k", X.semantic_terms(F.col("text")).alias("__terms")).join(held, "answer_id")
    scored = fuzzy_share(pairs, "__terms", "__held", FUZZY_CONCEPT, "overlap")
    best = scored.groupBy("answer_id", "k").agg(F.max_by("unit_id", F.struct("overlap", -F.col("unit_id"))).alias("best"))
    return rows.join(best, ["answer_id", "k"], "left").select("answer_id", "k", "category", F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.array_compact(F.array("best"))).alias("cited"))


def evaluation_guard(rows: DataFrame) -> DataFrame:
    """I4: answers (id, linked, current, has_rubric) that must not be graded: evidence is incomplete, or there is none and no rubric."""
    state = F.when(F.col("current") < F.col("linked"), "insufficient_evidence").when((F.col("linked") == 0) & ~F.col("has_rubric"), "needs_review").otherwise("gradable")
    return rows.select("id", state.alias("state"))


def corrected(attempts: DataFrame, corrections: DataFrame) -> DataFrame:
    """Attempts with the latest correction (attempt_id, correction_id, score); the score before is kept."""
    last = corrections.groupBy("attempt_id").agg(F.max_by("score", "correction_id").alias("new_score"))
    rows = attempts.join(last, attempts["id"] == last["attempt_id"], "left")
    return rows.select("id", F.coalesce("new_score", "score").alias("score"), F.when(F.col("new_score").isNotNull(), F.col("score")).alias("previous_score"))
