"""Operator 10: quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are measured on a bounded sample; rules then run in falling order of rejections
per cost, and a text leaves the cascade at its first failure. The order changes only the time taken: a text is kept if
no rule rejects it, whatever the order.
"""

from __future__ import annotations

import copy
import re
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, rows_of, to_batches

#: Bound of the sample that the order is learned from: about so many whole texts, chosen by the hash of text and id.
SAMPLE_TEXTS = 200

_WORD = re.compile(r"[^ \t-\r]+")
# Characters that str.split() takes as white space beside space and \t to \r.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
# The characters counted as symbols.
SYMBOLS = "#*$%&|<>"


def words_of(text: str) -> list[str]:
    """Maximal runs of characters other than space and \\t to \\r."""
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


class Measures:
    """Counts over a whole text, each made when a rule or the result first asks for it."""

    def __init__(self, text: str):
        self.text = text

    def __getattr__(self, name: str):
        if name not in COUNTS:
            raise AttributeError(name)
        value = COUNTS[name](self)
        setattr(self, name, value)
        return value


def _repeat_words(m: Measures) -> int:
    """Words inside three-word windows that occur twice or more, first occurrences included."""
    words = m.words
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, reach = 0, 0  # words before reach are settled
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered += i + 3 - max(i, reach)
            reach = i + 3
    return covered


def _dup_lines(m: Measures) -> int:
    lines = [line for line in m.text.split("\n") if _WORD.search(line)]
    return len(lines) - len(set(lines))


COUNTS: dict[str, Callable[[Measures], object]] = {
    "words": lambda m: words_of(m.text),
    "n_words": lambda m: len(m.words),
    "word_chars": lambda m: sum(map(len, m.words)),
    "n_symbols": lambda m: sum(map(m.text.count, SYMBOLS)),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_lines": lambda m: sum(1 for line in m.text.split("\n") if _WORD.search(line)),
    "n_upper": lambda m: sum(map(str.isupper, m.words)),
    "n_alpha": lambda m: sum(1 for w in m.words if not w.isdecimal() and any(map(str.isalpha, w))),
    "n_bang": lambda m: m.text.count("!!") + m.text.count("??"),
    "n_brace": lambda m: m.text.count("{") + m.text.count("}"),
}

#: The method's rules: true rejects. Those on words ask for one word at least; a text without words fails the base.
RULES: dict[str, Callable[[Measures], bool]] = {
    "too_many_words": lambda m: m.n_words > 1_000_000,
    "word_length": lambda m: not 2 * m.n_words <= m.word_chars <= 15 * m.n_words,
    "symbols": lambda m: 10 * m.n_symbols > 3 * m.n_words,
    "shouting": lambda m: 2 * m.n_upper > m.n_words,
    "bangs": lambda m: 10 * m.n_bang > 3 * m.n_words,
    "dup_lines": lambda m: 10 * m.n_dup_lines > 3 * m.n_lines,
    "few_letters": lambda m: 10 * m.n_alpha < 6 * m.n_words,
    "braces": lambda m: 10 * m.n_brace > m.n_words,
    "repeats": lambda m: 10 * m.n_repeat_words > 4 * m.n_words,
}


#: The counts that every text's row shows.
BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed(m: Measures) -> bool:
    return m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words


def learn_order(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Callable] | None = None) -> list[str]:
    """Names of the rules in the order of the cascade; by name for an empty table.

    The sample is taken by a hash from the whole table; it decides nothing but the order. Rules share their counts, and
    the base counts are made for every text in any case. So the next rule is always the one with the most rejections per
    second among the texts that the rules before it leave, given the counts that these have made. Null texts don't count;
    repeated rows are taken together or not at all, and at most twice SAMPLE_TEXTS rows in all.
    """
    rules = RULES if rules is None else rules
    texts = df.select(F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("place")).where("text is not null")
    every = max(1, df.count() // SAMPLE_TEXTS)
    left = [Measures(row["text"]) for row in texts.where(F.pmod("place", F.lit(every)) == 0).limit(2 * SAMPLE_TEXTS).collect()]
    left = [m for m in left if not base_failed(m) and [getattr(m, c) for c in BASE_COUNTS]]
    order: list[str] = []
    while len(order) < len(rules):
        best = None
        for name in sorted(rules.keys() - set(order)):
            tried = [copy.copy(m) for m in left]
            began = time.perf_counter()
            rejected = [rules[name](m) for m in tried]
            gain = sum(rejected) / max(time.perf_counter() - began, 1e-9)
            if best is None or gain > best[0]:
                best = gain, name, [m for m, out in zip(tried, rejected) if not out]
        order.append(best[1])
        left = best[2]
    return order


def score(
    df: DataFrame,
    order: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: dict[str, Callable] | None = None,
) -> DataFrame:
    """Run the cascade over whole texts.

    Returns `id_col`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by (the
    first rule in `order` that rejects, `base` before all, null for kept texts). A null text counts as empty, and
    texts without words fail the base. Rows stay one to one, repeated ones and null ids included; very long texts are
    measured whole; other columns are left out, whatever their names. An empty table stays empty.
    """
    rules = RULES if rules is None else rules
    if sorted(order) != sorted(rules):
        raise ValueError("order has to name each rule once")
    counts = BASE_COUNTS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), *((c, pa.int64()) for c in counts), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())])

            def judged():
                for i, text in rows_of([batch]):
                    m = Measures(text or "")
                    failed = base_failed(m)
                    by = "base" if failed else next((name for name in order if rules[name](m)), None)
                    yield (i, *(getattr(m, c) for c in counts), failed, by is None, by)

            yield from to_batches(judged(), schema)

    out = T.StructType([
        df.schema[id_col],
        *(T.StructField(c, T.LongType()) for c in counts),
        T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType()),
    ])
    return df.select(id_col, F.col(text_col).cast("string").alias("__text")).transform(in_batches, run, out)
