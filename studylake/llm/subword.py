"""Operator 13: a quality classifier on supervised subword embeddings.

Words, pairs of words and character n-grams within words are hashed to buckets, and every bucket has a learned vector. A
document is the mean of the vectors of all its features; a softmax over two classes gives the score. The vectors are
trained by stochastic gradient descent in numpy on a bounded sample of labelled documents. As the mean and the output
layer are linear, scoring sums one number for each feature.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, rows_of, to_batches, written

#: Bounds of the fit: labelled documents of each class (whole texts), and distinct features of all of them together.
SAMPLE_TEXTS, SAMPLE_FEATURES = 1000, 8_000_000
#: Buckets as bits, length of the vectors, sizes of the character n-grams (marks of a word's ends included).
BITS, DIM, SIZES = 16, 8, (3, 4)
#: Passes over the sample and steps, both at least; the rate of the first step; the seed.
EPOCHS, STEPS, RATE, SEED = 4, 6000, 0.4, 11
#: How much further than the output layer's the step of a feature's vector goes, as a mean over many moves each little.
STRETCH = 20
#: Characters of a text that are hashed at once; blocks end between words.
BLOCK = 1 << 18

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, _INVERSE):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _buckets(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind * 0xD6E8FEB86659FD93 & _MASK)) * np.uint64(0xFF51AFD7ED558CCD)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(64 - BITS)


def _block_features(codes: np.ndarray) -> np.ndarray:
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    mark = np.concatenate(([True], space, [True]))
    y = np.ones(len(mark), np.uint64)
    y[1:-1][~space] = codes[~space] + np.uint64(2)
    found = []
    # character n-grams: a mark may stand at the ends only
    h, inner = y[:-1] * np.uint64(_BASE) + y[1:], None
    for size in range(3, max(SIZES) + 1):
        if len(y) < size:
            break
        n = len(y) - size + 1
        h = h[:n] * np.uint64(_BASE) + y[size - 1 :]
        inner = mark[1 : 1 + n] if inner is None else inner[:n] | mark[size - 2 : size - 2 + n]
        if size in SIZES:
            found.append(_buckets(h[~inner], size))
    # words, by differences of running sums
    turn = np.flatnonzero(mark[1:] != mark[:-1]) + 1
    start, end = turn[::2], turn[1::2]
    if len(start):
        up, down = _powers(max(2 * BLOCK, 1 << (len(y) - 1).bit_length()))
        sums = np.cumsum(y * up[: len(y)], dtype=np.uint64)
        words = (sums[end - 1] - sums[start - 1]) * down[start]
        pairs = words[:-1] * np.uint64(0xA0761D6478BD642F) + words[1:]
        pairs[words[:-1] == words[1:]] = 0  # a word that comes again at once is told as such, whatever the word
        found += [_buckets(words, 1), _buckets(pairs, 2)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def features(text: str) -> Iterator[np.ndarray]:
    """Buckets of all features of a whole text, block by block; pairs of words don't reach across blocks."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    at = 0
    while at < len(codes):
        end = at + BLOCK
        if end < len(codes):
            rest = codes[end:]
            gap = (rest == 32) | ((rest >= 9) & (rest <= 13))
            end += int(gap.argmax()) if gap.any() else len(rest)
        yield _block_features(codes[at:end])
        at = end


class Model:
    """What a feature adds to the difference of the two outputs, and the difference of a text without features."""

    def __init__(self, gain: np.ndarray, offset: float):
        self.gain, self.offset = gain, offset

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for buckets in features(text or ""):
            total += float(self.gain[buckets].sum())
            n += len(buckets)
        x = self.offset + (total / n if n else 0.0)
        return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("place", pa.int64()), ("quality", pa.int32()), ("bucket", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])

    def rows():
        for place, quality, text in rows_of(batches):
            counts = np.zeros(1 << BITS, np.int32)
            for buckets in features(text):
                counts += np.bincount(buckets.astype(np.int64), minlength=1 << BITS).astype(np.int32)
            bucket = np.flatnonzero(counts)
            yield place, quality, bucket, counts[bucket]

    yield from to_batches(rows(), schema, weigh=2)


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from `labels` (id_col, label_col) and the texts of `df` that they mark.

    Labels other than 0 and 1 and null ids count for nothing; an id with several labels has the more frequent one, 1 if
    they are as many. Of each class the SAMPLE_TEXTS ids with the least hashes are taken, or all if fewer; of an id with
    several texts the least is. Null and empty texts teach nothing. Training stops taking texts at SAMPLE_FEATURES
    features, so the driver's memory has a bound. The share of a class in all labels, not in the sample, sets the offset.
    With one class, or without texts of both, every score is the share of label 1 (one half for no labels at all).
    """
    fit = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("q")).where("id is not null and q in (0, 1)")
    fit = fit.groupBy("id").agg(F.avg("q").alias("q")).select("id", (F.col("q") >= 0.5).cast("int").alias("quality"), F.xxhash64(F.col("id").cast("string"), F.lit(SEED)).alias("place"))
    fit = written(fit, "subword-labels")
    share = {r["quality"]: r["count"] for r in fit.groupBy("quality").count().collect()}
    ones, zeros = share.get(1, 0), share.get(0, 0)
    prior = math.log((ones + 0.5) / (zeros + 0.5))
    flat = Model(np.zeros(1 << BITS), prior if ones + zeros else 0.0)
    if not ones or not zeros:
        return flat
    chosen = [fit.where(F.col("quality") == q).orderBy("place", "id").limit(SAMPLE_TEXTS) for q in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text != ''").join(chosen, "id")
    texts = texts.groupBy("id", "quality", "place").agg(F.min("text").alias("text")).select("place", "quality", "text")
    sample = written(texts.transform(in_batches, _counted, "place long, quality int, bucket array<int>, times array<int>"), "subword-sample")
    rows, held = [], 0
    for r in sample.orderBy("place").toLocalIterator():
        if r["bucket"] and held + len(r["bucket"]) <= SAMPLE_FEATURES:
            times = np.array(r["times"], np.float32)
            rows.append((r["quality"], np.array(r["bucket"], np.int32), times / times.sum()))
            held += len(r["bucket"])
    n = np.bincount([r[0] for r in rows], minlength=2)
    if not n.all():
        return flat
    gain, offset = _train(rows)
    return Model(gain, offset + prior - math.log(n[1] / n[0]))


def _train(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent on the cross entropy, one document a step, with a rate that falls to zero."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    epochs = max(EPOCHS, -(-STEPS // len(rows)))
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            quality, bucket, share = rows[i]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = share @ vectors[bucket]
            logits = hidden @ out + bias
            e = np.exp(logits - logits.max())
            wrong = e / e.sum()
            wrong[quality] -= 1
            back = out @ wrong
            out -= rate * np.outer(hidden, wrong)
            bias -= rate * 0.1 * wrong
            vectors[bucket] -= (rate * STRETCH) * np.outer(share, back)
    gain = vectors @ (out[:, 1] - out[:, 0])
    return gain.astype(np.float64), float(bias[1] - bias[0])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`id_col`, the columns in `keep` and score, the probability of label 1, of every whole text.

    Null texts count as empty; an empty text, or one of white space alone, has the score of a text without features.
    Rows stay one to one, repeated ones and null ids included, and equal texts score alike. Very long texts are hashed
    in blocks that end between words, all of them. A column named score is not kept. An empty table stays empty.
    """
    keep = [c for c in (keep or []) if c not in (id_col, "score")]
    fields = T.StructType([df.schema[id_col], *(df.schema[c] for c in keep), T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            scores = pa.array([model.score(texts[i].as_py()) for i in range(batch.num_rows)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], "score"])

    return df.select(id_col, *keep, F.col(text_col).cast("string").alias("__text")).transform(in_batches, run, fields)
