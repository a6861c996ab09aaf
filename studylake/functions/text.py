"""Text as Column expressions: normalisation, line keys, purpose and layout checks, topic titles, token sets.

All but Unicode normalisation stay in the JVM. Patterns carry (?U) where word characters and boundaries are meant for
all scripts, as Java takes them as ASCII otherwise.
"""

from __future__ import annotations

import functools
import operator
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What tells logistics and outlines from study content.
ADMINISTRATION = (
    r"\b(?:moodle|canvas|blackboard)\b.{0,100}\b(?:slides?|handouts?|available|download|version|folien|verfügbar)\b",
    r"\b(?:slides?|handouts?|folien)\b.{0,100}\b(?:moodle|canvas|blackboard)\b",
    r"\b(?:exercise|assignment|homework|übung\w*)\s+(?:points?|scores?|punkte\w*)\b.{0,100}\b(?:exam|klausur|prüfung)\b",
    r"\b(?:exam|klausur|prüfung)\b.{0,100}\b(?:admission|registration|eligibility|zulassung|anmeldung)\b",
    r"\b(?:office hours|submission deadline|course logistics|exam registration|exam admission|sprechstunde\w*|abgabefrist\w*|prüfungszulassung|klausurzulassung)\b",
)
OVERVIEW = r"\b(?:course (?:objectives|outline|overview)|outline of (?:the )?course|table of contents|kursziele|inhaltsverzeichnis|vorlesungsübersicht)\b"
OBJECTIVES = r"^(?:learning objectives|lernziele)\s*[:\n]"
LEADERS = r"(?:\.[ \t]*){4,}\d+\b"
CONTENTS = r"^\s*(?:contents|inhalt)\s*\n"
CONTENTS_ENTRY = r"(?m)^\s*\d+(?:\.\d+)*\s+\S.+\s+\d+\s*$"
# Signs of navigation, attribution, joined words, formulas, and of topic titles.
NAVIGATION = r"^(next|previous|back|home|contents?|seite\s+\d+|page\s+\d+)\s*$"
ATTRIBUTION = r"(?:©|copyright|all rights reserved|bildquelle|image\s+source|photo\s+credit)"
JOINED = r"(?:^|[^\p{L}\p{N}_])[a-zäöüß]{4,}[A-ZÄÖÜ][a-zäöüß]{2,}(?:[^\p{L}\p{N}_]|$)"
FORMULA = r"[=∑√]|\b(?:sqrt|sin|cos|log)\s*\("
WORDS = r"[A-Za-zÀ-ÖØ-öø-ÿ]{2,}"
TITLE_SPLIT = r"[\r\n|]+|\s*[•▪◦]\s*"
SLIDE_PREFIX = r"^[\s\W_]*(?:(?:page|slide|chapter|lecture)\s*)?\d+(?:[.\-:]\d+)*[\s.:\-_]*"
TITLE_EDGE = " -–—:;,.|•…"
GENERIC_TITLES = (
    "additional", "author", "conditions", "contents", "example", "examples", "introduction", "license", "link", "overview", "solution", "source",
    "structure", "student", "summary", "teacher", "techniques", "theories", "title", "tutor", "worker", "you",
)
# Words that carry no evidence.
STOP_WORDS = tuple(
    "what which where when why how are and the they them with from into give explain different difference differences between evaluate was were wie welche sind und der die das lassen sich einordnen unterschied unterschiede zwischen erklären erklaeren".split()
)
# German words and variants by the term that they stand for.
SEMANTIC_ALIASES = {
    "virtuell": "virtual", "virtuelle": "virtual", "realen": "real", "reale": "real", "umgebung": "environment", "umgebungen": "environment",
    "objekte": "objects", "kombiniert": "combination", "kombination": "combination", "mischt": "combination", "erweitert": "augmented",
    "immersive": "immersion", "immersiv": "immersion", "präsenz": "presence", "praesenz": "presence", "anwesenheit": "presence",
    "benutzbarkeit": "usability", "anpassbar": "adaptability", "messbar": "measurability", "recents": "presence",
}
# Words without weight in a claim, and variants by the term that they stand for.
CLAIM_STOP = tuple(
    "the a an is are was were be been being of on in at to for from and or with by as that this these those it its their them each one how what why which when where would could should does do did can explain describe compare define main primary role goal function connect through into than between about your own words difference differences significance importance process types kinds mentioned evidence der die das ein eine einer eines einem den dem des ist sind war wird werden wie was warum welche welcher welches erklären erläutern beschreiben vergleichen definieren und oder von im in am an auf zu zur zum mit für durch als sich es sie er ihr ihre einer jeden".split()
)
CLAIM_ALIASES = {
    "divides": "split", "divided": "split", "splits": "split", "splitting": "split", "division": "split", "forward": "route", "forwarded": "route",
    "forwards": "route", "routing": "route", "routed": "route", "predict": "prediction", "predicts": "prediction", "predicting": "prediction",
    "predicted": "prediction", "assigns": "assign", "assigned": "assign", "assigning": "assign", "entire": "whole", "properties": "property",
    "generalize": "generalization", "generalizes": "generalization",
}
#: White space of all scripts, as (?U)\s has it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What a lower-case text can hold in place of an s or i where patterns ignore case.
FOLDED = ("ſ", "ı", "\u0307")
PRIVATE_USE = "[-]"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Python sees only texts that hold more than ASCII."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def strip(text: Column) -> Column:
    """A text without space of any script at its ends, of which no more is looked at."""
    return F.btrim(text, F.lit(SPACE))


def lines_to_lf(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def has_any(text: Column, *pieces: str) -> Column:
    """Whether a text holds one of the pieces, letter for letter: cheap, to keep patterns from texts that can't match them."""
    return functools.reduce(operator.or_, (F.contains(text, F.lit(piece)) for piece in pieces))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value made once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def normalize(text: Column, unicode: Callable[[Column], Column] = nfkc) -> Column:
    """B1: one form of line ends, characters, bullets, hyphens at line ends, spaces and blank lines.

    Most texts hold nothing that the patterns change; they are told by pieces that each pattern needs, and left alone.
    """

    def changed(out: Column) -> Column:
        for pattern, to in ((PRIVATE_USE, "• "), (r"(?<=[a-zäöüß])-\n(?=[a-zäöüß])", ""), ("[\t ]+", " "), ("[ ]{2,}", " "), (r"\n{3,}", "\n\n")):
            out = F.regexp_replace(out, pattern, to)
        return out

    def cleaned(out: Column) -> Column:
        private = (F.octet_length(out) > F.length(out)) & out.rlike(PRIVATE_USE)
        return strip(F.when(has_any(out, "-\n", "\t", "  ", "\n\n\n") | private, changed(out)).otherwise(out))

    return _let(unicode(F.when(F.contains(text, F.lit("\r")), lines_to_lf(text)).otherwise(text)), cleaned)


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def line_key(line: Column, unicode: Callable[[Column], Column] = nfkc) -> Column:
    """B2: a line's identity."""
    return casefold(F.regexp_replace(normalize(line, unicode), r"(?U)\s+", " "))


def sha256(text: Column) -> Column:
    """B3."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def flattened(text: Column) -> Column:
    """A text on one line."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def purpose_problem(text: Column) -> Column:
    """course_administration, outline_without_explanation, or null for study content. Only texts that hold the words
    that a pattern needs, or dots like leaders, are put to it."""

    def worded(low: Column) -> Column:
        names = has_any(low, "moodle", "canvas", "blackboard", "exam", "klausur", "prüfung", "sprechstunde", "abgabefrist", "course", "contents", "kursziele", "inhaltsverzeichnis", "vorlesungsübersicht", *FOLDED)
        return names | (has_any(low, "office") & has_any(low, "hours")) | (has_any(low, "submission") & has_any(low, "deadline"))

    def by_words(flat: Column) -> Column:
        admin = functools.reduce(operator.or_, (flat.rlike(f"(?iU){pattern}") for pattern in ADMINISTRATION))
        return F.when(admin, "course_administration").when(F.substring(flat, 1, 220).rlike(f"(?iU){OVERVIEW}"), "outline_without_explanation")

    leaders = has_any(text, "..", ". .", "  ", "\t") & (F.regexp_count(text, F.lit(LEADERS)) >= 2)
    outline = strip(text).rlike(f"(?i){OBJECTIVES}") | leaders | (text.rlike(f"(?i){CONTENTS}") & (F.regexp_count(text, F.lit(CONTENTS_ENTRY)) >= 2))
    return F.coalesce(F.when(_let(F.lower(text), worded), _let(flattened(text), by_words)), F.when(outline, "outline_without_explanation"))


def attribution(text: Column) -> Column:
    """Whether a text holds a notice of copyright or of an image's source."""

    def worded(low: Column) -> Column:
        return has_any(low, "©", "copyright", "reserved", "bildquelle", *FOLDED) | (has_any(low, "image") & has_any(low, "source")) | (has_any(low, "photo") & has_any(low, "credit"))

    return _let(F.lower(text), worded) & text.rlike(f"(?iu){ATTRIBUTION}")


def joined_words(text: Column) -> Column:
    """Whether a text holds two words without a space between them."""
    return text.rlike("[a-zäöüß][A-ZÄÖÜ]") & text.rlike(JOINED)


def count_of(text: Column, piece: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def table_corrupt(text: Column) -> Column:
    """Fewer than two rows with a bar, or bars that differ by more than one."""
    bars = F.filter(F.transform(F.split(text, "\n"), lambda line: count_of(line, "|")), lambda n: n > 0)
    return F.contains(text, F.lit("|")) & (F.size(bars) > 0) & ((F.size(bars) < 2) | (F.array_max(bars) - F.array_min(bars) > 1))


def has_formula(text: Column) -> Column:
    return has_any(text, "=", "∑", "√", "(") & text.rlike(f"(?i){FORMULA}")


def formula_broken(text: Column) -> Column:
    """A formula with unbalanced brackets or an operator at its end."""
    return has_formula(text) & ((count_of(text, "(") != count_of(text, ")")) | text.rlike(r"[=+\-/]\s*$"))


def block_kind(line: Column) -> Column:
    """The kind of a text block; the first that fits."""
    return (
        F.when(line.rlike(r"^[-*•]\s+"), "bullet_group").when(line.rlike(r"^\d+[.)]\s+"), "numbered_list").when(line.rlike("[=±∑∆√]"), "formula")
        .when((F.length(line) <= 90) & ~F.endswith(line, F.lit(".")), "heading_candidate").when(F.contains(line, F.lit("|")), "table_like").otherwise("text")
    )


def clean_title(part: Column) -> Column:
    out = F.regexp_replace(part, f"(?iU){SLIDE_PREFIX}", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s*\(\s*\d+\s*\)\s*$", ""), r"\s+\d+\s*$", "")
    return F.btrim(F.regexp_replace(out, r"\s+", " "), F.lit(TITLE_EDGE))


def topic_titles(heading: Column, unicode: Callable[[Column], Column] = nfkc) -> Column:
    """Clean, distinct titles of a raw heading, in order; empty if there are none."""
    text = F.coalesce(unicode(heading), F.lit(""))
    parts = F.transform(F.split(F.regexp_replace(text, "[-�]", "\n"), TITLE_SPLIT), clean_title)
    kept = F.filter(
        parts,
        lambda p: (F.length(p) >= 3) & ~p.rlike(r"^\p{Nd}+$") & ~casefold(p).isin(*GENERIC_TITLES) & ~p.rlike(r"(?i)^(?:page|slide|lecture)\s*\d+$"),
    )
    empty = F.array().cast("array<string>")
    distinct = F.aggregate(kept, empty, lambda seen, p: F.when(F.exists(seen, lambda x: casefold(x) == casefold(p)), seen).otherwise(F.array_append(seen, p)))
    return F.when((strip(text) == "") | (casefold(strip(text)) == "unassigned"), empty).otherwise(distinct)


def single_title(heading: Column, unicode: Callable[[Column], Column] = nfkc) -> Column:
    """The title of a heading that has just one."""
    return _let(topic_titles(heading, unicode), lambda titles: F.when(F.size(titles) == 1, F.get(titles, F.lit(0))))


def topic_key(title: Column, unicode: Callable[[Column], Column] = nfkc) -> Column:
    """B10."""
    return F.trim(F.regexp_replace(casefold(unicode(title)), r"[^\p{L}\p{N}_]+", " "))


def _distinct(tokens: Column) -> Column:
    return F.array_distinct(tokens)


def long_tokens(text: Column) -> Column:
    """Words of three characters and more."""
    return _distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9]{3,}"), F.lit(0)))


def evidence_tokens(text: Column) -> Column:
    """Words of two characters and more that carry evidence."""
    return F.array_except(_distinct(F.regexp_extract_all(casefold(text), F.lit(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9]{2,}"), F.lit(0))), F.array(*map(F.lit, STOP_WORDS)))


def _aliased(tokens: Column, aliases: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))


def semantic_terms(text: Column) -> Column:
    """Words with variants of one meaning as one."""
    return _distinct(_aliased(F.regexp_extract_all(casefold(text), F.lit(r"[a-zA-ZÀ-ÖØ-öø-ÿ0-9]{2,}"), F.lit(0)), SEMANTIC_ALIASES))


def claim_terms(text: Column) -> Column:
    """B11d: words of a claim without stop words, variants as one, longer words without a final s."""
    tokens = F.filter(F.regexp_extract_all(casefold(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(*CLAIM_STOP))
    table = F.create_map(*(F.lit(x) for pair in CLAIM_ALIASES.items() for x in pair))
    return _distinct(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.when(F.length(t) > 4, F.regexp_replace(t, "s$", "")).otherwise(t))))


# Words that only ask.
INTERROGATIVES = tuple(
    "what which how why when where who does do did is are was were the a an of in on at to for by with and or explain describe define was wie warum wann wo wer welcher welche welches ist sind der die das ein eine eines im am an auf zu zur zum mit und oder erklären beschreiben definieren".split()
)


def question_terms(text: Column) -> Column:
    """B11e: semantic terms of a question without the words that only ask."""
    return F.array_except(semantic_terms(text), F.array(*map(F.lit, INTERROGATIVES)))


def file_stem(path: Column) -> Column:
    """The name of a file without folders and extension, letters and digits only."""
    name = F.element_at(F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1)
    return F.regexp_replace(casefold(F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")), "[^a-z0-9]+", "")


def page_number(start: Column, location: Column) -> Column:
    """The page given, or named in a location."""
    return F.coalesce(start.cast("int"), F.regexp_extract(location, r"(?i)(?:page|slide|seite)\s*(\d+)", 1).try_cast("int"))


def _slide_parts(text: Column) -> Column:
    """Parts of a slide list, at commas, semicolons and spaces; ranges lose their spaces and their word for slides."""
    tight = F.regexp_replace(F.trim(text), r"(?i)(?:\b(?:slides?|pages?)\s*)?\b(\d+)\s*[–-]\s*(\d+)", "$1-$2")
    return F.filter(F.split(tight, r"\s*[,;]\s*|\s+"), lambda p: p != "")


def slide_numbers(text: Column) -> Column:
    """Slides of a list such as "17-19, 21": single numbers and ranges, distinct, in order; the rest is left out."""
    parts = _slide_parts(text)

    def expand(p: Column) -> Column:
        low, high = F.regexp_extract(p, r"^(\d+)(?:-\d+)?$", 1).try_cast("int"), F.regexp_extract(p, r"^\d+-(\d+)$", 1).try_cast("int")
        empty = F.array().cast("array<int>")
        return F.when(low.isNull(), empty).when(high.isNull(), F.array(low)).when(high < low, empty).otherwise(F.sequence(low, F.greatest(low, high)))

    return F.array_distinct(F.flatten(F.transform(parts, expand)))


def unparsed_slides(text: Column) -> Column:
    """The parts of a slide list that are no numbers."""
    return F.filter(_slide_parts(text), lambda p: ~p.rlike(r"^\d+(?:-\d+)?$"))


def distinct_strings(values: Column) -> Column:
    """Trimmed strings, distinct in any case, in order."""
    empty = F.array().cast("array<string>")
    kept = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    return F.aggregate(kept, empty, lambda seen, v: F.when(F.exists(seen, lambda x: casefold(x) == casefold(v)), seen).otherwise(F.array_append(seen, v)))


def question_key(text: Column) -> Column:
    """The text by which questions repeat."""
    return F.trim(F.regexp_replace(casefold(text), r"[^\p{L}\p{N}_]+", " "))


def mock_target(seconds: Column) -> Column:
    """Questions of a mock exam: one for 150 seconds, three to eight, halves to even."""
    return F.least(F.lit(8), F.greatest(F.lit(3), F.bround(seconds / 150).cast("int")))


# Base quality of a report's reliability, and what its provenance adds.
RELIABILITY = {"current": 0.95, "historical_same_course": 0.85, "adjacent_historical": 0.65, "inferred": 0.5}
PROVENANCE = {"exact_reported": 0.04, "reported_followup": 0.02, "inferred_followup": -0.05}


def reported_quality(reliability: Column, provenance: Column) -> Column:
    """Base of the reliability and adjustment of the provenance, within 0 and 1."""
    base = F.coalesce(F.create_map(*(F.lit(x) for p in RELIABILITY.items() for x in p))[reliability], F.lit(0.5))
    change = F.coalesce(F.create_map(*(F.lit(x) for p in PROVENANCE.items() for x in p))[provenance], F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + change))


def draft_points(answer: Column) -> Column:
    """Up to four sentences of an answer as rubric points, without its list of sources and its citations of evidence
    and questions; the whole, if no sentence is long enough. Long points end in an ellipsis."""
    body = F.regexp_replace(F.regexp_replace(answer, r"(?is)\n\s*(?:citations?|sources?|evidence)\s*:.*$", ""), r"\[(?:E|Q)\d+\]", "")

    def flat(s: Column) -> Column:
        return F.regexp_replace(s, r"\s+", " ")

    def cut(s: Column) -> Column:
        return F.when(F.length(s) <= 360, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, 357)), F.lit("…")))

    sentences = F.transform(F.split(body, r"(?<=[.!?])\s+|\n+"), lambda s: F.btrim(flat(s), F.lit(" -•\t")))
    long = F.filter(sentences, lambda s: F.length(s) >= 25)
    whole = F.btrim(flat(body))
    points = F.when(F.size(long) > 0, F.slice(F.transform(long, cut), 1, 4)).when(whole != "", F.array(cut(whole)))
    return F.coalesce(points, F.array().cast("array<string>"))


#: A citation of evidence or of a note on a page.
CITATION = r"\[([EN]\d+(?:_\d+)?)\]"


def cited(text: Column) -> Column:
    """What a text cites: E<unit> and N<document>_<page>, once each."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)))


def citations_valid(text: Column, allowed: Column) -> Column:
    """At least one citation, and none that is not in `allowed` (names like E5 or N3_2)."""
    return (F.size(cited(text)) > 0) & (F.size(F.array_except(cited(text), allowed)) == 0)


def repair_citations(text: Column, allowed: Column) -> Column:
    """Citations that are not allowed go; if none is left the first three allowed ones follow on a line of their own.

    The text is cut at its citations; each comes back if it is allowed.
    """
    gaps, names = F.split(text, CITATION, -1), F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    marks = F.transform(names, lambda x: F.when(F.array_contains(allowed, x), F.concat(F.lit("["), x, F.lit("]"))).otherwise(""))
    joined = F.array_join(F.zip_with(gaps, marks, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    kept = F.regexp_replace(joined, r"^\s+|\s+$", "")
    more = F.array_join(F.transform(F.slice(allowed, 1, 3), lambda x: F.concat(F.lit("["), x, F.lit("]"))), " ")
    return F.when((kept == "") | F.exists(marks, lambda m: m != ""), kept).otherwise(F.concat(kept, F.lit("\n\nEvidence: "), more))


def lenient_json(text: Column) -> Column:
    """The outermost JSON object of a noisy text, as text; null if there is none that parses."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def clean_question(text: Column) -> Column:
    """One space between words, none before punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\s+([,.;:!?])", "$1"))


def noise_line(line: Column) -> Column:
    """Lines that are page numbers or marks only."""
    return F.trim(line).rlike(r"(?i)^(?:(?:page|seite|slide|folie)?\s*\d+(?:\s*(?:/|of|von)\s*\d+)?|[^\p{L}\p{N}]*)$")
