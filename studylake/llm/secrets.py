"""Operator 9: secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regex is turned into a Boolean trigram query on the driver. One pass over the texts makes the postings of
just the trigrams that some rule asks for, and runs the rules that have no mandatory trigram. Postings are intersected
by grouping; the rule's regex then verifies the candidates that are left. Python never touches a text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Candidates up to this many bytes go to the texts by broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES = 16 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regex in the syntax that Java and Python share, and the least length of one of its groups."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


# The base kinds, in the order in which they are listed. Runs below 24 and 20 characters would be dropped;
# for hex and access asking for the length in the regex finds the same spans, as a run that fails holds none that passes.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds that this scan adds: well-known public token formats.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
)
RULES = BASE + MORE


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """What any match must hold: a list of clauses (all), each a list of alternatives (one), each a set of trigrams (all).

    Trigrams are lower case, as the index is. An empty list means that nothing is mandatory. Strings that the regex can
    spell out are followed through groups, alternatives, optional parts and small classes; anything else ends a string.
    """
    parser = re._parser

    def strings(op, arg) -> tuple[set[str] | None, list]:
        """All strings that the part can be, or None with the clauses it makes mandatory."""
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}, []
        if name == "IN":
            chars: set[str] = set()
            for kind, value in arg:
                if str(kind) == "LITERAL":
                    chars.add(chr(value).lower())
                elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None, []
            return (chars, []) if len(chars) <= 8 else (None, [])
        if name == "SUBPATTERN":
            return sequence(arg[3])
        if name == "BRANCH":
            parts = [sequence(p) for p in arg[1]]
            if all(s is not None for s, _ in parts):
                return set().union(*(s for s, _ in parts)), []
            return None, []
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, part = arg
            found, clauses = sequence(part)
            if low == 0:
                return ({""} | found, []) if high == 1 and found is not None else (None, [])
            if found is not None:
                if low == high == 1:
                    return found, []
                return None, clause(found)
            return None, clauses
        return None, []

    def clause(found: set[str]) -> list:
        options = sorted({frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in found}, key=sorted)
        return [options] if all(options) else []

    def sequence(parts) -> tuple[set[str] | None, list]:
        run, clauses, whole = {""}, [], True
        for op, arg in parts:
            found, inner = strings(op, arg)
            if found is not None and len(run) * len(found) <= 64:
                run = {a + b for a in run for b in found}
                continue
            clauses += clause(run)
            run, whole = found or {""}, False
            clauses += inner
        if whole:
            return run, []
        return None, clauses + clause(run)

    found, clauses = sequence(parser.parse(regex))
    return clause(found) if found is not None else clauses


def _array(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["hash"] == b["hash"])


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """id, hash, kinds: the rules each text of (id, hash, text) may match. Written to the shared folder."""
    spark = texts.sparkSession
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    full = [r for r in rules if not queries[r.kind]]
    asked = sorted({t for q in queries.values() for options in q for option in options for t in option})
    # the array of one holds the lower-case text, so that it is made once and not for each trigram
    hits = F.transform(F.array(F.lower("text")), lambda low: F.filter(_array(asked), lambda t: F.contains(low, t)))[0] if asked else F.array().cast("array<string>")
    scanned = F.array_compact(F.array(*(F.when(F.col("text").rlike(r.regex), F.lit(r.kind)) for r in full))) if full else F.array().cast("array<string>")
    seen = texts.select("id", "hash", hits.alias("trigrams"), scanned.alias("kinds")).where((F.size("trigrams") > 0) | (F.size("kinds") > 0))
    index = written(seen, "secret-index")

    rows = [(kind, i, j, len(option), t) for kind, q in queries.items() for i, options in enumerate(q) for j, option in enumerate(options) for t in option]
    scans = index.select("id", "hash", F.explode("kinds").alias("kind"))
    if not rows:
        return written(scans.groupBy("id", "hash").agg(F.sort_array(F.collect_set("kind")).alias("kinds")), "secret-candidates")
    # a few hundred rows at most, fixed by the rules
    asks = spark.createDataFrame(rows, "kind string, clause int, option int, needed int, trigram string")
    clauses = spark.createDataFrame([(kind, len(q)) for kind, q in queries.items() if q], "kind string, clauses int")
    met = (
        index.select("id", "hash", F.explode("trigrams").alias("trigram"))
        .join(F.broadcast(asks), "trigram")
        .groupBy("id", "hash", "kind", "clause", "option", "needed").agg(F.countDistinct("trigram").alias("have")).where("have = needed")
        .groupBy("id", "hash", "kind").agg(F.countDistinct("clause").alias("met"))
        .join(F.broadcast(clauses), "kind").where("met = clauses").select("id", "hash", "kind")
    )
    return written(met.unionByName(scans).groupBy("id", "hash").agg(F.sort_array(F.collect_set("kind")).alias("kinds")), "secret-candidates")


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans of secrets in whole texts. Returns id, hash (of the text), kind, rank (of the rule), start, end.

    Places count code points; ends are exclusive. The matches of a rule are leftmost and non-overlapping; those whose
    group is too short are dropped after that. Rows that repeat an id and a text give their spans once; null and empty
    texts give none.
    """
    texts = _keyed(df, id_col, text_col)
    found = candidates(texts, rules)
    size = found.count() * 64
    chosen = F.broadcast(found) if size <= BROADCAST_BYTES else found
    rows = texts.join(chosen, _same(texts, chosen)).select(texts["id"], texts["hash"], texts["text"], F.explode("kinds").alias("kind"))

    def by_kind(make) -> Column:
        return F.coalesce(*(F.when(F.col("kind") == r.kind, make(r)) for r in rules))

    def lengths(strings: Column) -> Column:
        return F.transform(strings, F.length)

    # a regex splits a text into its gaps: their lengths and those of the matches place each match
    placed = rows.select(
        "id", "hash", "kind",
        by_kind(lambda r: lengths(F.split("text", r.regex, -1))).alias("gap"),
        by_kind(lambda r: lengths(F.regexp_extract_all("text", F.lit(r.regex), F.lit(0)))).alias("size"),
        by_kind(lambda r: lengths(F.regexp_extract_all("text", F.lit(r.regex), F.lit(r.group)))).alias("part"),
    ).dropDuplicates(["id", "hash", "kind"])
    each = placed.select("id", "hash", "kind", F.posexplode(F.arrays_zip("gap", "size", "part")).alias("k", "m")).select("id", "hash", "kind", "k", "m.*").where("size is not null")
    so_far = Window.partitionBy("id", "hash", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    least = by_kind(lambda r: F.lit(r.least))
    rank = by_kind(lambda r: F.lit(rules.index(r)))
    return each.select("id", "hash", "kind", "part", (end - F.col("size")).alias("start"), end.alias("end")).where(F.col("part") >= least).select("id", "hash", "kind", rank.alias("rank"), "start", "end")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of `df`: `id_col`, spans (array of struct start, rank, end, kind, sorted; empty if none).

    Null and empty texts have no spans; rows that repeat have the same; very long texts are scanned whole; an empty table
    gives no rows, and other columns are left out, whatever their names.
    """
    texts = _keyed(df, id_col, text_col).select("id", "hash")
    per_text = spans(df, id_col, text_col, rules).groupBy("id", "hash").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    joined = texts.join(per_text, _same(texts, per_text), "left")
    return joined.select(texts["id"].alias(id_col), F.coalesce(per_text["spans"], empty).alias("spans"))


def listed(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]", rules: tuple[Rule, ...] = RULES, length_col: str | None = None) -> DataFrame:
    """`df` with each maximal run of secret characters in `text_col` replaced by `mask`; texts without secrets stay as they are.

    All columns stay, null texts too. `length_col`, if given, gets the new length of a text that changes. Rows that repeat an id and a text change alike.
    """
    found = spans(df, id_col, text_col, rules)
    before = Window.partitionBy("id", "hash").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    opens = found.withColumn("opens", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    so_far = Window.partitionBy("id", "hash").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = opens.withColumn("run", F.sum("opens").over(so_far)).groupBy("id", "hash", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    per_text = written(runs.groupBy("id", "hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs")), "secret-runs")
    chosen = F.broadcast(per_text) if per_text.count() * 256 <= BROADCAST_BYTES else per_text
    chosen = chosen.select(F.col("id").alias("__id"), F.col("hash").alias("__hash"), F.col("runs").alias("__runs"))
    text = F.col(text_col).cast("string")
    joined = df.join(chosen, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("__hash")), "left")
    count = F.size("__runs")

    def gap(k: Column) -> Column:
        """What stands before run k: all from the end of the run before it."""
        start = F.when(k == 0, F.lit(0)).otherwise(F.get("__runs", k - 1)["end"])
        end = F.when(k == count, F.length(text)).otherwise(F.get("__runs", k)["start"])
        return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))

    # a step of its own: beside a result named like the text, the text's name would mean that result
    masked = joined.withColumn("__masked", F.array_join(F.transform(F.sequence(F.lit(0), count), gap), mask))
    new = {text_col: F.col("__masked")} | ({length_col: F.length("__masked").cast(df.schema[length_col].dataType)} if length_col else {})
    return masked.select(*(F.when(F.col("__runs").isNull(), F.col(c)).otherwise(new[c]).alias(c) if c in new else F.col(c) for c in df.columns))
