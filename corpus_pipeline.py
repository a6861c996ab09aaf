"""A training corpus from raw documents: known languages, no near-duplicates, no secrets, a weighted mix, token ids.

Every stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept, and returns a DataFrame;
all but the last return the columns of documents. Its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.llm import bpe, dartminhash, langid, mixing, secrets
from studylake.llm.common import table, written
from studylake.llm.queries import PATTERN, RANKS, domain_of, held_out

#: The mix of the corpus: nine tenths of the tokens that the earlier stages leave, each document at most once.
MIX = mixing.Plan(weights={"domain": {"d1": 3}, "lang": {"en": 3}}, default=2, share=(9, 10), epochs=1, seed=23)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; the others go, as do null, empty and letterless texts.

    Repeated rows are judged alike and stay; long texts are judged whole; further columns stay. An empty table stays empty.
    """
    learned = langid.learn(docs.where(~held_out()))
    return langid.identify(docs, learned, keep=docs.columns).where("accepted").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id, once if its row repeats.

    A row without an id goes by its text, behind all rows with one. Null, empty and wordless texts are near to nothing
    and stay, once for each id. Of rows that repeat an id with different texts one stays. Long texts are compared whole.
    """
    by_text = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), 2) + F.lit(1 << 62)
    keyed = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), by_text))
    classes = written(dartminhash.near_duplicates(keyed, id_col="__key").select("__key", "class_id"), "pipeline-classes")
    gone = written(classes.where("__key != class_id").select("__key").distinct(), "pipeline-duplicates")
    again = written(classes.groupBy("__key").agg(F.count(F.lit(1)).alias("n"), F.min("class_id").alias("c")).where("n > 1 and c = __key").select("__key"), "pipeline-repeats")

    def small(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() * 16 <= dartminhash.BROADCAST_BYTES else ids

    kept = keyed.join(small(gone), "__key", "left_anti")
    once = kept.join(small(again), "__key", "left_anti").select(*docs.columns)
    first = kept.join(small(again), "__key", "left_semi").groupBy("__key").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return once.unionByName(first)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in them masked; texts without one stay as they are, null and empty ones too.

    Rows that repeat change alike; long texts are scanned whole; n_chars, where it is there, follows the text.
    """
    return secrets.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fit whole into their leaf's budget, each at most once.

    Null languages and sources are leaves of their own; texts without a token go with the prefix that their order falls
    into; rows that repeat an id go the same way; a long text that reaches beyond the budget does not come in part.
    """
    return mixing.mix(docs, MIX, domain_of()).where("mix_copies > 0").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts: doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text again.

    A null text counts as empty: no ids. Rows stay one to one, repeated ones and null ids included; other columns go.
    """
    hashed = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    # small tables, as executors are full of what the stages before have left; written between, so that the workers
    # that encode are free before others decode
    encoded = written(bpe.encode(hashed, RANKS, PATTERN, keep=["lang", "source", "text_sha256"], chunks=60_000, parts=40_000), "pipeline-encoded")
    decoded = bpe.decode(encoded.withColumn("token_ids", F.col("ids")), RANKS)
    round_trip = F.sha2("decoded", 256) == F.col("text_sha256")
    return decoded.select("doc_id", "lang", "source", "n_tokens", F.col("token_ids").alias("ids"), round_trip.alias("round_trip"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix", mix), ("encode", encode)]
#: SQL can express neither the language ID nor the signatures; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
