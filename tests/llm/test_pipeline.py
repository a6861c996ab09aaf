"""The pipeline, stage by stage, on the small tables."""

import numpy as np
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from studylake.llm import bpe, dartminhash, langid, queries, secrets

from .test_operators import brute_classes, brute_spans


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "secret_scan", "mix", "encode"]
    results = [docs]
    for _, stage in corpus_pipeline.STAGES:
        results.append(stage(spark, results[-1], small).cache())
    known, single, clean, mixed, encoded = results[1:]
    assert all(r.columns == columns for r in results[:-1])

    verdict = langid.identify(docs, langid.learn(docs.where(~queries.held_out())))
    assert {r["doc_id"] for r in known.collect()} == {r["doc_id"] for r in verdict.where("accepted").collect()}

    classes = brute_classes([(r["doc_id"], r["text"]) for r in known.collect()])
    assert {r["doc_id"] for r in single.collect()} == {i for i, c in classes.items() if i == c}

    before = {r["doc_id"]: r for r in single.collect()}
    for r in clean.collect():
        found = brute_spans(before[r["doc_id"]]["text"])
        assert (r["text"] == before[r["doc_id"]]["text"]) == (not found)
        assert not brute_spans(r["text"]) and r["n_chars"] == len(r["text"])
    assert clean.count() == single.count()

    tokens = {r["doc_id"]: len(r["text"].split()) for r in clean.collect()}
    taken = sum(tokens[r["doc_id"]] for r in mixed.collect())
    assert taken <= 0.9 * sum(tokens.values()) and mixed.count() == mixed.select("doc_id").distinct().count()

    library = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=bpe.load_ranks(queries.RANKS), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    for r in encoded.collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode_ordinary(texts[r["doc_id"]])
        assert r["round_trip"]
    assert encoded.count() == len(texts)


def test_run_equals_stages(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.where("round_trip").count() == got.count() > 0


def test_empty_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, small)
        assert result.count() == 0
        docs = result if "text" in result.columns else docs
    assert dartminhash and secrets
