"""Operator 1: language ID by compression.

For each language a zstandard compressor gets a raw-content dictionary of that language's text. A text goes to the
language whose compressor makes it smallest, and is rejected if the runner-up comes close.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, rows_of, to_batches

#: The learned sample: about so many whole texts of each language, chosen by a hash, and so many bytes of dictionary
#: (64 KB a language for the workers), to which each text gives an equal part from a place that its hash names. More
#: than MAX_LANGUAGES languages are refused.
SAMPLE_TEXTS, DICTIONARY_BYTES, MAX_LANGUAGES = 200, 65_536, 256
#: Texts are compressed in blocks of so many bytes, as a dictionary helps most at a block's start; whole texts count.
BLOCK_BYTES = 2048
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")


def normalised(text: str) -> bytes:
    """What is compressed: lower-case letters, all else one space, so that digits, marks and capitals carry no sign."""
    return _NOT_LETTERS.sub(" ", text.lower()).encode("utf-8")


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary bytes for each language of the labelled rows of `df`.

    Rows with null language or text teach nothing. The rows of a language are taken by a hash of their id, at the rate
    that gives SAMPLE_TEXTS of them, so that frequent and rare languages get dictionaries of like size; an empty table
    gives no language. Fails if there are more than MAX_LANGUAGES.
    """
    # null texts are few; leaving them in the counts lets the first scan read the language column alone
    counts = df.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    space = 1 << 20
    rates = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(-(-space * SAMPLE_TEXTS // max(r["n"], 1))))))
    # by id and text, so that rows which repeat an id are not taken all together
    place = F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col).cast("string"), F.col(text_col)), F.lit(space))
    rows = (
        df.where(F.col(lang_col).isNotNull() & (place < rates[F.col(lang_col).cast("string")]))
        .select(F.col(lang_col).cast("string").alias("lang"), place.alias("place"), F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
        .where(F.col("text").isNotNull())
        .distinct()
        # what repeats is taken once; the bound of rows holds whatever the hash does
        .limit(4 * SAMPLE_TEXTS * len(counts))
        .collect()
    )
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for row in sorted(rows, key=lambda r: (r["place"], r["id"] or "", r["text"])):
        texts.setdefault(row["lang"], []).append((row["place"], normalised(row["text"])))
    found = {lang: _dictionary(parts) for lang, parts in sorted(texts.items())}
    return {lang: content for lang, content in found.items() if len(content) >= 8}


def _dictionary(texts: list[tuple[int, bytes]]) -> bytes:
    """DICTIONARY_BYTES at most: equal parts of all texts, and what short ones leave to the longer ones."""
    left, parts = DICTIONARY_BYTES, []
    for k, (place, text) in enumerate(sorted(texts, key=lambda t: (len(t[1]), t))):
        share = min(len(text), max(0, left // (len(texts) - k) - 1))
        start = place % (len(text) - share + 1)
        parts.append(text[start : start + share])
        left -= share + 1
    return b" ".join(parts)


@functools.lru_cache(maxsize=4)
def _compressors(digest: str, languages: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, content in languages:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(
            4, source_size=BLOCK_BYTES, dict_size=len(content), min_match=4, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False
        )
        dictionary.precompute_compress(compression_params=params)
        out.append((lang, zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)))
    return out


def judge(text: str | None, compressors: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float]:
    """Language and margin: by how much of the runner-up's size the winner is smaller. Ties go to the first name."""
    if text is None or not compressors or not _LETTER.search(text):
        return UNKNOWN, 0.0
    if len(compressors) == 1:
        return compressors[0][0], 1.0
    data = normalised(text)
    blocks = [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in compressors)
    return sizes[0][1], 1 - sizes[0][0] / sizes[1][0]


def identify(
    df: DataFrame,
    dictionaries: dict[str, bytes],
    id_col: str = "doc_id",
    text_col: str = "text",
    min_margin: float = 0.002,
    sure_margin: float = 0.1,
    keep: Iterable[str] = (),
) -> DataFrame:
    """Language of whole texts. Returns `id_col`, lang_pred, score, margin, accepted, and the columns in `keep`.

    score is margin / sure_margin, 1 at most. accepted is false below min_margin and for unknown texts. A text that is
    null, empty or without a letter is `und` with score 0, as is every text if nothing was learned. Rows stay one to
    one and are judged by their text alone; clashing columns in `keep` are refused. Very long texts are judged whole, block
    by block; an empty table stays empty. A language with less than 8 bytes of sample has no dictionary and is never told.
    """
    keep = list(keep)
    made = {"lang_pred", "score", "margin", "accepted"}
    if made & set(keep):
        raise ValueError(f"columns {sorted(made & set(keep))} clash with results")
    languages = tuple(sorted(dictionaries.items()))
    digest = hashlib.sha256(repr(languages).encode()).hexdigest()
    kept = list(dict.fromkeys([id_col, *keep]))
    # a text that is kept is sent to the workers once
    sent = [*kept, *([] if text_col in kept else [text_col])]
    place = sent.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(digest, languages)
        for batch in batches:
            fields = [batch.schema.field(k) for k in range(len(kept))]
            schema = pa.schema([*fields, ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("accepted", pa.bool_())])

            def judged():
                for row in rows_of([batch]):
                    lang, margin = judge(row[place], compressors)
                    yield (*row[: len(kept)], lang, min(1.0, margin / sure_margin), margin, lang != UNKNOWN and margin >= min_margin)

            yield from to_batches(judged(), schema, weigh=place if place < len(kept) else None)

    out = T.StructType([*(df.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return df.select(*sent).transform(in_batches, run, out)
