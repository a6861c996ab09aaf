"""Links that the neighbour search does not find come from the comparison of all vectors."""

import numpy as np
import pytest

from studylake.llm import nndescent

from .test_operators import brute_links


@pytest.mark.parametrize("block", [7, 256])
def test_a_search_that_finds_nothing_loses_nothing(spark, monkeypatch, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    vectors = [(k, (centres[k % 12] + 0.1 * rng.normal(size=16)).tolist()) for k in range(150)] + [(900, [1.0] * 5), (901, [1.0] * 4 + [1.1]), (902, None), (903, [0.0] * 16)]
    vectors += [(910 + k, vectors[3][1]) for k in range(4)]
    nothing = lambda nodes, *_: nodes.sparkSession.createDataFrame([], nndescent._EDGES)
    monkeypatch.setattr(nndescent, "_start", nothing)
    monkeypatch.setattr(nndescent, "ROUNDS", 1)
    monkeypatch.setattr(nndescent, "BLOCK", block)
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_duplicates(table).collect()}
    assert got == brute_links(vectors)
    assert max(n for n, _ in got.values()) > 8
