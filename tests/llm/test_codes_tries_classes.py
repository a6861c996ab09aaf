"""Vector codes, the prefix trie and the quality classifier against brute force, and the cases that must not crash."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from studylake.llm import prefixtrie, queries, subword, veccode

# ---- 11

VECTORS = "vec_id long, embedding array<double>, label int, code string, error string"


def vectors(spark, rows):
    """Vectors with further columns whose names clash with results."""
    return spark.createDataFrame([(i, v, label, "c", "e") for i, v, label in rows], VECTORS)


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """Codes by plain loops over Python's integers."""
    rows = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(rows[0][1]) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, v, _ in rows}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for c in cut.values():
                groups.setdefault(near(c[p], book)[1], []).append(c[p])
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else e for k, e in enumerate(book)]
    result, by_label = {}, {}
    for i, _, label in rows:
        best = [near(cut[i][p], books[p]) for p in range(parts)]
        result[i] = "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)
        by_label[label] = by_label.get(label, 0) + result[i][1]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return {i: (*result[i], by_label[label], digest) for i, _, label in rows}


def run_codes(df):
    books = veccode.learn(df)
    coded = veccode.with_label_error(veccode.compress(df, books, keep=["vec_id", "label"]).cache())
    return {r["vec_id"]: (r["code"].hex(), r["error"], r["label_error"], books.digest()) for r in coded.collect()}


def some_vectors(n, dim, seed, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(dim)] for _ in range(5)]
    return [(i, [c + rng.choice((0, 0.01, 0.2)) * rng.gauss(0, scale) for c in rng.choice(centres)], rng.choice((None, 1, 2))) for i in range(n)]


@pytest.mark.parametrize("dim", [8, 24, 64])
def test_codes_equal_brute_force(spark, dim):
    rows = some_vectors(150, dim, dim)
    odd = [(900, None, 1), (901, [None] + [0.1] * (dim - 1), 1), (902, [float("nan")] * dim, 2), (903, [float("inf")] * dim, None), (-5, [0.5] * dim, 2), (904, rows[3][1], None), (905, [0.0] * dim, 7)]
    assert run_codes(vectors(spark, rows + odd)) == brute_codes(rows + odd)


def test_codes_of_wide_numbers(spark):
    rows = some_vectors(40, 16, 3, 1e5) + [(77, [3e5] * 16, 1)]
    assert run_codes(vectors(spark, rows)) == brute_codes(rows)


def test_codes_of_few_and_no_vectors(spark):
    few = some_vectors(3, 16, 5)
    assert run_codes(vectors(spark, few)) == brute_codes(few)
    none = vectors(spark, few).where("false")
    assert run_codes(none) == {} and run_codes(vectors(spark, [(1, None, 1)])) == {}
    assert {len(c) for c, *_ in run_codes(vectors(spark, [(1, [], 1), (2, [], None)])).values()} == {16}


def test_codes_of_odd_rows(spark):
    rows = some_vectors(30, 16, 6)
    twice = vectors(spark, rows + rows[:4] + [(None, rows[0][1], 1), (500, [1.0] * 15, 1)])
    books = veccode.learn(twice)
    coded = veccode.compress(twice, books)
    assert coded.columns == ["vec_id", "label", "code", "error"] and coded.count() == 35  # the vector of another length is out
    uneven = vectors(spark, [(i, v[:13], label) for i, v, label in rows])
    filled = vectors(spark, [(i, v[:13] + [0.0] * 3, label) for i, v, label in rows])
    assert run_codes(uneven) == run_codes(filled)


def test_labels_by_shuffle(spark, monkeypatch):
    rows = some_vectors(60, 8, 8)
    want = run_codes(vectors(spark, rows))
    monkeypatch.setattr(veccode, "BROADCAST_LABELS", 1)
    assert run_codes(vectors(spark, rows)) == want


def test_walsh_keeps_distances_in_order_of_sequency():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 8, 13):
        a, b = rng.integers(-(10**6), 10**6, (2, 50, width))
        n = veccode.walsh(a).shape[1]
        assert (((veccode.walsh(a) - veccode.walsh(b)) ** 2).sum(1) == n * ((a - b) ** 2).sum(1)).all()
        rows = veccode.walsh(np.eye(n, dtype=int)).T
        assert [(np.diff(r) != 0).sum() for r in rows] == list(range(n))
        books = rng.integers(-3, 3, (1, 16, width))
        x = rng.integers(-3, 3, (200, 1, width))
        code, error = veccode.nearest(x, books)
        full = ((x[:, 0, None] - books[0][None]) ** 2).sum(2)
        assert (code[:, 0] == full.argmin(1)).all() and (error[:, 0] == full.min(1)).all()


# ---- 12

TURNS = "conv_id long, turn long, role string, text string, depth string, path string, words int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "d", "p", 3) for r in rows], TURNS)


def brute_trie(rows, rebuild=True):
    """Nodes by a dictionary of prefixes."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role, key, text))
    convs = {c: [(role, text) for _, role, _, text in sorted(t)] for c, t in convs.items()}
    made = {}
    for c, t in convs.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        made[c] = tuple(convs.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:])
    members = {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    below = {p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p] for p in members}
    words = {p: len(prefixtrie_words(p[-1][1])) if p else 0 for p in members}
    result = []

    def total(p):
        leaves, saved = (0 if below[p] else 1), (len(members[p]) - 1) * words[p]
        for q in below[p]:
            a, b = total(q)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(map(str, sorted(c for c in members[p] if made[c] == p)))
        result.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        total(())
    return sorted(result, key=str)


def prefixtrie_words(text):
    import re

    return re.findall(r"[^ \t-\r]+", text)


def run_trie(df, rebuild=True, shards=None):
    seqs = prefixtrie.sequences(df)
    return sorted((tuple(r) for r in prefixtrie.nodes((prefixtrie.rebuilt(seqs) if rebuild else seqs).cache(), shards).collect()), key=str)


def some_turns(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 4 * n), n):
        for t in range(rng.choice((1, 1, 2, 3, 5, 9))):
            rows.append((c, t, rng.choice(("user", "user", None)), rng.choice(("a b", "a b", "hello", "", None, " x\x0by z\xa0w "))))
    return rows


@pytest.mark.parametrize("shards", [None, 1, 2, 7, 60])
def test_trie_equals_brute_force(spark, shards):
    rows = some_turns(120, 4)
    assert run_trie(turns(spark, rows), True, shards) == brute_trie(rows)


@pytest.mark.parametrize("shards", [3, 40])
def test_trie_of_copies_and_long_conversations(spark, shards, monkeypatch):
    monkeypatch.setattr(prefixtrie, "SPLIT_TURNS", 3)
    monkeypatch.setattr(prefixtrie, "ID_BLOCK", 20)
    rows = [(c, t, "user", f"t{t}") for c in range(60) for t in range(2 + c % 2)]
    rows += [(c, t, "user", f"t{t}") for c in range(100, 130) for t in range(300 if c == 100 else 8)]
    rows += [(1000 + c, t, "bot", "one " * 9000 if t == 2 else "two") for c in range(20) for t in range(3)]
    assert run_trie(turns(spark, rows), False, shards) == brute_trie(rows, False)


def test_trie_of_odd_rows(spark):
    rows = [(None, 1, "user", "no conversation"), (3, None, "user", "first"), (3, 1, "b", "x"), (3, 1, "a", "y"), (3, 1, "a", "y"), (4, 7, None, None), (21, 0, "user", "lone")]
    for shards in (1, 5):
        assert run_trie(turns(spark, rows), True, shards) == brute_trie(rows)
    assert run_trie(turns(spark, rows).where("false")) == []
    assert run_trie(turns(spark, rows[:1])) == []


# ---- 13


def marked(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", 1.0) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    return docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")


def brute_features(text):
    """Strings of all features of a text."""
    words = prefixtrie_words(text)
    grams = [f"{size}:{w[i : i + size]}" for w in (f"\0{w}\0" for w in words) for size in subword.SIZES for i in range(len(w) - size + 1)]
    return grams + [f"w:{w}" for w in words] + [f"p:{a} {b}" if a != b else "same" for a, b in zip(words, words[1:])]


def test_features_are_those_of_words_and_pairs():
    texts = ["", " ", "a", "ab ab abc", "x\ty\n\nz ", "Ünïcödé 🎉🎉 日本語 日本語", "no-break\xa0space", " lead and trail \r\n"] + [" ".join(random.Random(s).choices(["aa", "b", "longer", "ü"], k=40)) for s in range(5)]
    for text in texts:
        found = [b for block in subword.features(text) for b in block]
        want = brute_features(text)
        assert len(found) == len(want)
        assert len(set(found)) <= len(set(want)) and len(set(found)) >= 0.98 * len(set(want))


def test_long_texts_are_hashed_whole(monkeypatch):
    text = "one two three " * 900 + "end"
    whole = np.sort(np.concatenate(list(subword.features(text))))
    monkeypatch.setattr(subword, "BLOCK", 1000)
    blocks = list(subword.features(text))
    assert len(blocks) > 5 and sum(map(len, blocks)) == len(whole) - (len(blocks) - 1)  # a pair fewer at each seam
    assert len(list(subword.features("x" * 5000))) == 1


def test_classifier_tells_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    scored = queries.op13_quality_classifier(spark, d)
    both = scored.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert scored.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert both.score.between(0, 1).all() and ((both.score >= 0.3) == (both.predicted == 1)).all()


def test_classifier_learns_from_others_only(spark):
    rows = [(i, "good words here" if i % 3 else "### !! ###", i % 3 > 0) for i in range(60)]
    docs, labels = marked(spark, [(i, t, int(q)) for i, t, q in rows])
    fit = labels.where(~queries.held_out())
    wrong = labels.where(queries.held_out()).withColumn("quality", 1 - F.col("quality"))
    model = subword.learn(docs, fit)
    assert (subword.learn(docs, fit.unionByName(wrong.where("false"))).gain == model.gain).all()
    assert model.score("good words here") > 0.9 and model.score("### !! ###") < 0.1
    assert model.score(None) == model.score("") == model.score(" \n")


def test_classifier_odd_rows(spark):
    docs, labels = marked(spark, [(1, None, 1), (2, "", 0), (None, "no id", 1), (3, "abc", None), (3, "abc", 1), (3, "abd", 0), (4, "x", 5), (5, "w " * 200_000, 0), (6, "é🎉", 1)])
    model = subword.learn(docs, labels)
    scored = subword.score(docs, model, keep=["lang", "score"])
    assert scored.columns == ["doc_id", "lang", "score"] and scored.count() == 9
    assert all(0 <= r["score"] <= 1 for r in scored.collect())
    none = subword.learn(docs, labels.where("false"))
    assert {r["score"] for r in subword.score(docs, none).collect()} == {0.5}
    ones = subword.learn(docs, labels.where("quality = 1"))
    assert len({r["score"] for r in subword.score(docs, ones).collect()}) == 1
    assert subword.score(docs.where("false"), model).count() == 0
    assert subword.learn(docs.where("false"), labels).score("x") == pytest.approx(0.5, abs=0.2)
