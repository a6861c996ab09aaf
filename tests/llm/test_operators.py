"""The ten operators against brute force, the libraries, and the cases that must not crash."""

import base64
import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from studylake.llm import bpe, dartminhash, langid, licenses, mixing, nndescent, quality, queries, secrets, suffixes
from studylake.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars int, ids string, spans int, text_sha256 string, hash int"


def docs(spark, rows):
    """Documents with further columns whose names clash with results."""
    return spark.createDataFrame([(i, t, lang, "s1", len(t or ""), "x", 1, "y", 2) for i, t, lang in rows], DOCS)


ODD = [(1, None, "en"), (2, "", "en"), (None, "no id", None), (3, "abc", None), (3, "abc", None), (4, "aaaa " * 3000, "en"), (5, "é" * 500 + " 日本語 🎉", "fr"), (6, "  \n\t ", "de")]


@pytest.fixture(scope="session")
def odd(spark):
    return docs(spark, ODD).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return docs(spark, [(0, "", "")]).where("false")


@pytest.fixture(scope="session")
def library():
    with open(queries.RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def some_texts(n, seed=1):
    rng = random.Random(seed)
    letters = "aabbAé \n\t  \x1c\x85\xa0'sllrevdtm123½²_-ßß日本語🎉 　"
    return ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(n)] + ["a" * 5001, " " * 999, "ab" * 2000 + "c", "\n" * 500]


# ---- 1


def test_language_id_learns_from_others_only(spark, small):
    result = queries.op1_language_id(spark, small).toPandas()
    table = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    assert len(result) == len(table)
    both = result.merge(table, on="doc_id")
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.9
    assert both.score.between(0, 1).all()


def test_language_id_odd_rows(spark, odd, empty):
    learned = langid.learn(odd)
    rows = langid.identify(odd, learned, keep=["text"]).collect()
    assert len(rows) == len(ODD)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 6)} == {"und"}
    assert not any(r["accepted"] for r in rows if r["doc_id"] in (1, 2, 6))
    assert langid.learn(empty) == {}
    assert langid.identify(empty, {}).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}


def test_numbers_are_no_letters(odd):
    learned = langid._compressors("x", tuple(sorted(langid.learn(odd).items())))
    assert langid.judge("½ ² ³ ①", learned) == ("und", 0.0)


def test_language_id_refuses_clashes(odd):
    with pytest.raises(ValueError):
        langid.identify(odd.withColumn("score", F.lit(1)), {}, keep=["score"])


# ---- 2


def test_mixing_equals_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op2_mixing"]).df()
    got = queries.op2_mixing(spark, small).toPandas()
    key = ["doc_id", "domain", "lang", "source", "n_tokens", "copies", "part_tokens"]
    assert sorted(map(tuple, want[key].astype(str).values)) == sorted(map(tuple, got[key].astype(str).values))


def brute_budget(leaves, plan):
    """Water filling by bisection on the rate, level by level."""

    def share(children, budget):
        total = sum(c for c, _ in children.values())
        if total <= budget:
            return {k: c for k, (c, _) in children.items()}
        low, high = 0.0, float(budget) + 1
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(c, mid * w) for c, w in children.values()) < budget else (low, mid)
        return {k: min(c, low * w) for k, (c, w) in children.items()}

    def weight(level, name):
        return plan.weights.get(level, {}).get(name, plan.default)

    out = {}
    cap = {k: v * plan.epochs for k, v in leaves.items()}
    budget = sum(leaves.values()) * plan.share[0] // plan.share[1]
    domains = {d: (sum(v for k, v in cap.items() if k[0] == d), weight("domain", d)) for d, _, _ in cap}
    for d, b in share(domains, budget).items():
        langs = {x: (sum(v for k, v in cap.items() if k[:2] == (d, x)), weight("lang", x)) for dd, x, _ in cap if dd == d}
        for x, c in share(langs, b).items():
            sources = {s: (v, weight("source", s)) for (dd, xx, s), v in cap.items() if (dd, xx) == (d, x)}
            out |= {(d, x, s): v for s, v in share(sources, c).items()}
    return out


@pytest.mark.parametrize("epochs", [1, 3])
def test_budgets_against_bisection(spark, epochs):
    rng = random.Random(epochs)
    leaves = {(f"d{d}", f"l{x}", f"s{s}"): rng.choice([0, 5, 100, 10_000, 300]) for d in range(3) for x in range(3) for s in range(4)}
    plan = mixing.Plan(weights={"domain": {"d0": 5}, "source": {"s1": 3}}, default=2, share=(1, 2), epochs=epochs)
    table = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, supply long")
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(table, plan).collect()}
    want = brute_budget(leaves, plan)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 12 for k in want)
    assert sum(got.values()) <= sum(leaves.values()) // 2


def test_mixing_odd_rows(spark, odd, empty):
    whole = mixing.mix(odd, mixing.Plan(share=(1, 1)), F.lit(None))
    # the leaf of document 6 holds no token; document 2 has none either, but its leaf does
    assert sorted(r["doc_id"] or 0 for r in whole.collect()) == [0, 1, 2, 3, 3, 4, 5]
    assert whole.agg(F.sum("mix_copies")).first()[0] == 7
    assert mixing.mix(empty, mixing.Plan(), F.lit("d")).count() == 0


def test_mixing_takes_a_prefix_to_the_token(spark):
    table = docs(spark, [(i, "w " * (i % 7 + 1), "en") for i in range(500)])
    plan = mixing.Plan(share=(5, 2), epochs=3, seed=1)
    got = mixing.mix(table, plan, F.lit("d"))
    total = got.agg(F.sum(F.col("mix_copies") * F.col("mix_tokens") + F.col("mix_part"))).first()[0]
    assert total == sum(i % 7 + 1 for i in range(500)) * 5 // 2
    assert got.where("mix_part > 0").count() <= 1


# ---- 3 and 4


def test_tree_encoder_equals_library(library):
    library, ranks = library
    tree = bpe.TreeEncoder(ranks, queries.PATTERN)
    for text in some_texts(3000):
        ids = tree.encode(text)
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert bpe.decode_ids(ids, tree.bytes_of) == text.encode()


def test_seams_follow_the_encoding(library):
    """What the walk along a seam says of two neighbours is what encoding their bytes says."""
    _, ranks = library
    tree = bpe.TreeEncoder(ranks, queries.PATTERN)
    rng = random.Random(5)
    short = [t for t in ranks if len(t) < 12]
    for _ in range(20_000):
        a, b = rng.choice(short), rng.choice(short)
        pair = ranks[a], ranks[b]
        assert tree.fits[pair[0] << tree.shift | pair[1]] == (tree.windows[a + b] == pair), (a, b)


def test_heap_counts_equal_library():
    library = Tokenizer.from_file(queries.VOCABULARY)
    counter = bpe.HeapCounter(queries.VOCABULARY, queries.PATTERN)
    for k, text in enumerate(some_texts(3000, 2)):
        if k % 9 == 0:
            text = text[:5] + "<|endoftext|>" * (k % 3) + text[5:]
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_bpe_queries(spark, small, library):
    library, _ = library
    texts = dict(map(tuple, spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()))
    for r in queries.op3_bpe_round_trip(spark, small).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    other = Tokenizer.from_file(queries.VOCABULARY)
    for r in queries.op4_token_counts(spark, small).collect():
        assert r["n_tokens"] == len(other.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), r["n_tokens"] > 1024)


def test_bpe_odd_rows(odd, empty):
    args = (queries.RANKS, queries.PATTERN)
    encoded = bpe.encode(odd, *args)
    rows = bpe.decode(encoded, queries.RANKS).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"])) for r in rows) == sorted((i or 0, (t or "").encode()) for i, t, _ in ODD)
    assert bpe.decode(bpe.encode(empty, *args), queries.RANKS).count() == 0
    counts = bpe.count_tokens(odd, queries.VOCABULARY, queries.PATTERN).collect()
    assert [r["n_tokens"] for r in counts if r["doc_id"] in (1, 2)] == [0, 0] and len(counts) == len(ODD)
    with pytest.raises(ValueError):
        bpe.encode(odd, *args, keep=["ids"])
    with pytest.raises(ValueError):
        bpe.decode(encoded.withColumn("decoded", F.lit(1)), queries.RANKS)


# ---- 5


def brute_links(vectors, threshold=0.95):
    units = {}
    for i, v in vectors:
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            units.setdefault(len(v), []).append((i, np.array(v) / np.linalg.norm(v)))
    links = {i: 0 for i, _ in vectors}
    root = {i: i for i, _ in vectors}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for group in units.values():
        for k, (i, a) in enumerate(group):
            for j, b in group[:k]:
                if a @ b >= threshold:
                    links[i] += 1
                    links[j] += 1
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return {i: (links[i], find(i)) for i in links}


def test_nn_descent_finds_all_links(spark):
    rng = np.random.default_rng(7)
    rows = [rng.standard_normal(16) for _ in range(600)]
    rows += [rows[0] + rng.standard_normal(16) * 0.05 for _ in range(60)]  # a saturated group
    rows += [rows[k] + rng.standard_normal(16) * 0.05 for k in range(100, 160)]
    rows += [rows[5], rows[5] * 2.0]
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    vectors += [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] + [1.0] * 15), (9005, [None] + [1.0] * 15), (9006, [1.0, 2.0]), (9007, [2.0, 4.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_duplicates(table).collect()}
    assert got == brute_links(vectors)


def test_nn_descent_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, id int, unit string, digest int"
    assert nndescent.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(4, [1.0, 0.0], 1, "x", 2), (None, [1.0, 0.0], 1, "x", 2)], schema)
    assert sorted(map(tuple, nndescent.near_duplicates(one).collect()), key=str) == [(4, 0, 4), (None, 0, None)]


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}


# ---- 6


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            part = data[k : k + length]
            if part in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(part)
        runs = sum(1 for k, x in enumerate(gone) if x and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), runs, bytes(b for b, x in zip(data, gone) if not x))
    return out


def suffix_result(table):
    return {
        r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"]))
        for r in suffixes.deduplicate(table).collect()
    }


def repeated_rows(seed):
    rng = random.Random(seed)

    def words(n):
        return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 8))) for _ in range(n))

    passages = [words(30) for _ in range(3)]
    rows = [(i, words(rng.randint(0, 40)) + rng.choice(passages)[rng.randint(0, 40) :] + words(rng.randint(0, 60))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(200, "ab" * 400), (201, "x" * 99), (202, "x" * 100), (203, "x" * 101), (204, None), (205, "")]
    return rows + [(300, rows[0][1] * 3), (301, "long " + words(30_000) + passages[0])]


@pytest.mark.parametrize("large", [suffixes.SORTED_GROUP, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(suffixes, "SORTED_GROUP", large)
    rows = repeated_rows(large)
    assert suffix_result(docs(spark, [(i, t, "en") for i, t in rows])) == brute_repeats(rows)


def test_repeats_query(spark, small):
    want = brute_repeats([tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()])
    got = queries.op6_suffix_dedup(spark, small).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == {i: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for i, v in want.items()}


def test_repeats_odd_rows(odd, empty):
    rows = suffixes.deduplicate(odd).collect()
    assert len(rows) == len(ODD)
    assert [bytes(r["kept"]) for r in rows if r["doc_id"] is None] == [b"no id"]
    assert suffixes.deduplicate(empty).count() == 0


# ---- 7


def test_license_scan(spark, odd, empty):
    rows = [
        (1, "x y z.\nLicensed under CC BY-NC 4.0.\nmore", "en"),
        (2, "Released under the MIT license and licensed under the Apache License, Version 2.0!", "en"),
        (3, "a license to print money", "en"),
        (4, "This work is LICENSED under the\nGNU General Public License, version 3.", "en"),
        (5, "Licensed under the GNU General Public License, version 2", "en"),
        (6, "Permission is hereby granted, free of charge, to any person obtaining a copy of the software and associated documentation files", "en"),
        (7, "Licensed under CC BY 4.0", "en"),
    ]
    got = {r["doc_id"]: [(x["license"], x["changes"]) for x in r["found"]] for r in licenses.scan(docs(spark, rows)).collect()}
    notices = {
        "the GNU Affero General Public License, version 3": "AGPL-3.0",
        "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "GPL-3.0",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY": "MIT",
        "BSD 3-Clause license": "BSD-3-Clause", "Licensed under CC BY-ND 4.0": "CC-BY-ND-4.0",
    }
    for text, name in notices.items():
        assert [x[2] for x in licenses.find("Before it. licensed under " * text.startswith("the") + text + " After it.")] == [name], text
    assert got == {1: [("CC-BY-NC-4.0", 0)], 2: [("MIT", 0), ("Apache-2.0", 0)], 3: [], 4: [("GPL-3.0", 0)], 5: [("GPL-2.0", 0)], 6: [("MIT", 1)], 7: [("CC-BY-4.0", 0)]}
    for r in licenses.scan(docs(spark, rows)).collect():
        text = rows[r["doc_id"] - 1][1]
        assert all(text[x["start"] : x["end"]] == x["wording"] for x in r["found"])
    assert licenses.scan(odd).where("size(found) > 0").count() == 0 and licenses.scan(empty).count() == 0


def test_license_alignment_against_brute_force():
    rng = random.Random(3)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            new = [row[0] + 1]
            for k, y in enumerate(b):
                new.append(min(row[k] + (x != y), row[k + 1] + 1, new[k] + 1))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = rng.choices("abc", k=rng.randint(1, 5)), rng.choices("abcd", k=rng.randint(1, 8))
        changes, i, j = licenses.aligned(a, b)
        assert changes == min(distance(a, b[x:y]) for x in range(len(b) + 1) for y in range(x, len(b) + 1))
        assert changes == distance(a, b[i:j])


# ---- 8


def brute_classes(rows, similarity=0.8):
    def shingles(text):
        w = (text or "").split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= similarity * len(x | y):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {i: find(i) for i in ids}


def near_rows(seed):
    rng = random.Random(seed)

    def words(n):
        return [rng.choice(["al", "be", "ga", "de", "ep"]) + str(rng.randint(0, 400)) for _ in range(n)]

    rows = []
    for family in range(12):
        base = words(rng.randint(40, 400))
        for copy in range(rng.choice([1, 2, 5, 40])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = "edit" + str(rng.random())
            rows.append((len(rows), " ".join(w)))
    rows += [(5000, rows[0][1]), (5001, rows[0][1]), (5002, "one two"), (5003, "one two"), (5004, ""), (5005, None), (5006, "w " * 3000)]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows(4)
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(docs(spark, [(i, t, "en") for i, t in rows])).collect()}
    assert got == brute_classes(rows)


@pytest.mark.parametrize("weighted", [False, True])
def test_near_duplicates_of_many_families_on_one_boilerplate(spark, monkeypatch, weighted):
    # 50 pairs at 0.82; all others are 0.78 alike by what comes before and after, where most of their bands meet
    before, after, rows = [f"w{k}" for k in range(134)], [f"w{k}" for k in range(134, 268)], []
    for pair in range(50):
        for copy in range(2):
            own = [f"p{pair}x{k}" for k in range(7)] + [f"c{pair}x{copy}x{k}" for k in range(25)]
            rows.append((len(rows), " ".join(before + own + after)))
    monkeypatch.setattr(dartminhash, "BLOCK", 16)
    monkeypatch.setattr(dartminhash, "COLUMNS", 64)
    # no shingle comes twice in a text, so that both similarities are one
    table = docs(spark, [(i, t, "en") for i, t in rows])
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(table, weighted=weighted).collect()}
    want = brute_classes(rows)
    assert len(set(want.values())) == 50 and got == want


def test_elements_in_common_count_weights():
    rng = np.random.default_rng(3)
    sets = [{int(x): int(rng.integers(1, 5)) for x in rng.choice(300, 40, replace=False)} for _ in range(12)]
    cells = [dartminhash._cells(np.array(sorted(s), np.uint64).tobytes(), np.array([s[x] for x in sorted(s)], np.int64).tobytes()) for s in sets]
    got = dartminhash._in_common(cells, np.arange(5), np.arange(5, 12))
    assert got.tolist() == [[sum(min(s[x], t.get(x, 0)) for x in s) for t in sets[5:]] for s in sets[:5]]


def test_near_duplicates_query(spark, small):
    want = brute_classes([tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()])
    assert {r["doc_id"]: r["class_id"] for r in queries.op8_minhash_near_dedup(spark, small).collect()} == want


def test_near_duplicates_odd_rows(odd, empty):
    rows = dartminhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and all(r["class_id"] == r["doc_id"] for r in rows)
    assert dartminhash.near_duplicates(empty).count() == 0
    assert dartminhash.near_duplicates(odd, weighted=True).count() == len(ODD)


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    elements = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    a = rng.choice([0.5, 1.0, 2.0, 3.25], 400)
    b = np.where(rng.random(400) < 0.3, rng.choice([0.5, 1.0, 2.0], 400), a)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    k = 2000
    got = (dartminhash.signature(elements, a, k) == dartminhash.signature(elements, b, k)).mean()
    assert abs(got - want) < 0.04
    plain = (dartminhash.signature(elements[:300], k=k) == dartminhash.signature(elements[100:], k=k)).mean()
    assert abs(plain - 0.5) < 0.05


# ---- 9


def brute_spans(text):
    found = []
    for rank, rule in enumerate(secrets.RULES):
        regex = {"access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}.get(rule.kind, rule.regex)
        least = {"access": 20, "hex": 24}.get(rule.kind, rule.least)
        found += [(m.start(), rank, m.end(), rule.kind) for m in re.finditer(regex, text or "") if len(m[rule.group]) >= least]
    return sorted(found)


SECRETS = [
    (1, "x password = 'hunter22' 🎉 Token:abc API_KEY:\"ABCDEF123\" secret: token = abcdefg", "en"),
    (2, "AKIA" + "B" * 16 + " AKIA123 " + "AKIA" * 6 + " é" + "0123456789abcdef" * 3 + "g" + "a" * 23, "en"),
    (3, "gh" + "p_" + "a1B2" * 9 + " xox" + "b-0123456789-abc -----BEGIN " + "RSA PRIVATE KEY----- sk_live_" + "0" * 20, "en"),
    (4, "eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10 + " AIza" + "x" * 35, "fr"),
    (5, "nothing here", "en"), (6, "", "en"), (7, None, None), (8, "token=" + "f" * 5000, "en"), (8, "token=" + "f" * 5000, "en"), (None, "secret=abcdef", "en"),
]


def test_secret_spans_equal_regexes(spark, empty):
    rows = secrets.scan(docs(spark, SECRETS)).collect()
    got = sorted(((r["doc_id"] or 0), [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["spans"]]) for r in rows)
    assert got == sorted(((i or 0), brute_spans(t)) for i, t, _ in SECRETS)
    assert secrets.scan(empty).count() == 0


def test_secret_query_equals_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op9_secret_scan"]).df()
    got = queries.op9_secret_scan(spark, small).toPandas()
    key = sorted(want.columns)
    assert sorted(map(tuple, want[key].astype(str).values)) == sorted(map(tuple, got[key].astype(str).values))


def test_redaction(spark):
    table = docs(spark, SECRETS)
    got = secrets.redact(table, length_col="n_chars")
    assert got.columns == table.columns
    want = []
    for i, text, _ in SECRETS:
        covered = [False] * len(text or "")
        for start, _, end, _ in brute_spans(text):
            covered[start:end] = [True] * (end - start)
        out = "".join(c if not x else "\0" for c, x in zip(text or "", covered))
        masked = None if text is None else re.sub("\0+", "[secret]", out)
        want.append((i or 0, masked or "", len(masked or "")))
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["n_chars"]) for r in got.collect()) == sorted(want)


def test_trigram_queries_are_mandatory():
    rng = random.Random(1)
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.regex)
        for _, text, _ in SECRETS:
            for m in re.finditer(rule.regex, text or ""):
                low = m[0].lower()
                assert all(any(all(t in low for t in option) for option in clause) for clause in query)
    assert secrets.trigram_query(r"[0-9a-f]{24,}") == []
    assert secrets.trigram_query(r"ab(cd|ef)?g+hij") == [[frozenset({"abc", "bcd"}), frozenset({"abe", "bef"})]] or secrets.trigram_query(r"hello") == [[frozenset({"hel", "ell", "llo"})]]
    assert rng


# ---- 10


def brute_quality(text):
    words = re.findall("[^ \t-\r]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines, dup = [], 0
    for line in (text or "").split("\n"):
        if re.search("[^ \t-\r]", line):
            dup += line in lines
            lines.append(line)
    counts = (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered))
    return (*counts, len(words) < 50 or 100 * len(covered) > 50 * len(words))


QUALITY = [*ODD, (10, "the same line\n" * 40, "en"), (11, " ".join(f"w{k}" for k in range(100)), "en"), (12, "a b c a b c d e f\x1cg h i \x85 j", "en"), (13, "LOUD! " * 2 + " ".join(f"LOUD{k}!!" for k in range(90)), "en")]


def test_quality_counts(spark, empty):
    table = docs(spark, QUALITY)
    rows = quality.score(table, quality.learn_order(table)).collect()
    got = sorted((r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert got == sorted(((i or 0), *brute_quality(t)) for i, t, _ in QUALITY)
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert kept[11] and not kept[13] and not kept[10]
    assert quality.score(empty, quality.learn_order(empty)).count() == 0


def test_quality_order_changes_no_verdict(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    first = {r["doc_id"]: r["kept"] for r in quality.score(table, sorted(quality.RULES)).collect()}
    assert first == {r["doc_id"]: r["kept"] for r in quality.score(table, sorted(quality.RULES, reverse=True)).collect()}
    with pytest.raises(ValueError):
        quality.score(table, ["symbols"])


def test_results_have_the_contracts_types(spark, small):
    want = {
        "op1_language_id": {"doc_id": T.LongType(), "held_out": T.BooleanType(), "lang_pred": T.StringType(), "score": T.DoubleType()},
        "op4_token_counts": {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()},
        "op5_embedding_near_dedup": {"n_links": T.LongType(), "component_id": T.LongType(), "kept": T.BooleanType()},
        "op6_suffix_dedup": {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()},
        "op9_secret_scan": {"n_assign": T.LongType(), "n_access": T.LongType(), "n_hex": T.LongType(), "base_sha256": T.StringType(), "spans": T.StringType()},
        "op10_quality_rules": {"n_words": T.LongType(), "word_chars": T.LongType(), "base_failed": T.BooleanType(), "kept": T.BooleanType()},
    }
    for name, columns in want.items():
        schema = queries.QUERIES[name](spark, small).schema
        assert {c: schema[c].dataType for c in columns} == columns


assert pd and public_tokenizers
