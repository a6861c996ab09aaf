"""Operator 11: vectors as short codes, by codebooks of integers for each part of a vector.

Vectors become integers and are cut into equal parts; each part has a codebook, learned in a fixed number of rounds that
assign every part to its nearest entry and move the entry to the mean of its parts, rounded down. Distances are taken
after a Walsh-Hadamard transform of zero-padded parts and entries: it multiplies every squared distance by the padded
length, and gathers most of it in the first coefficients by sequency. Squared differences are summed in that order, and
an entry is out once its sum alone exceeds the whole sum of another. All of it is integer arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches

#: Parts of a vector, entries of a part's codebook, rounds that move the entries, and integers to a unit of length.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels up to this number are broadcast with their sums, at about 32 bytes each; more are joined by shuffle.
BROADCAST_LABELS = 100_000


def _sequency(n: int) -> np.ndarray:
    """Rows of the Hadamard matrix of size `n` by their number of sign changes: the bits of the Gray code, reversed."""
    s = np.arange(n)
    gray, order = s ^ (s >> 1), np.zeros(n, int)
    for bit in range(n.bit_length() - 1):
        order = order << 1 | gray >> bit & 1
    return order


def walsh(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the last axis, padded with zeros to a power of two, coefficients by sequency."""
    n = 1 << max(0, x.shape[-1] - 1).bit_length()
    y = np.zeros((*x.shape[:-1], n), x.dtype)
    y[..., : x.shape[-1]] = x
    step = 1
    while step < n:
        pairs = y.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        a, b = pairs[..., 0, :], pairs[..., 1, :]
        y = np.stack([a + b, a - b], axis=-2)
        step *= 2
    return y.reshape(*x.shape[:-1], n)[..., _sequency(n)]


def _wide(x: np.ndarray, entries: np.ndarray) -> bool:
    """Whether scaled squared distances could leave 64 bits: they are at most length x padded length x (2 most)^2."""
    most = max((int(abs(a).max()) for a in (x, entries) if a.size), default=0)
    width = x.shape[-1]
    return 4 * most * most * width * 2 * max(width, 1) >= 1 << 62


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For parts (rows, part, position) and entries (part, entry, position): each part's nearest entry, the one with the
    lower index of several, and the squared distance to it. Numbers that could leave 64 bits become Python's integers."""
    if _wide(parts, entries):
        parts, entries = parts.astype(object), entries.astype(object)
    x, e = walsh(parts), walsh(entries)
    (rows, many, n), k = x.shape, e.shape[1]
    if not rows:
        return np.zeros((0, many), np.int64), np.zeros((0, many), parts.dtype)
    head = max(1, n // 4)
    sums = np.zeros((rows, many, k), x.dtype)
    for s in range(head):
        sums += (x[:, :, None, s] - e[None, :, :, s]) ** 2
    # the whole sum of the entry that leads so far bounds the least one
    row, part = np.arange(rows)[:, None], np.arange(many)[None, :]
    lead = sums.argmin(axis=2)
    bound = sums[row, part, lead]
    for s in range(head, n):
        bound = bound + (x[:, :, s] - e[part, lead, s]) ** 2
    r, p, c = np.nonzero(sums <= bound[:, :, None])
    total = sums[r, p, c]
    for s in range(head, n):
        total = total + (x[r, p, s] - e[p, c, s]) ** 2
        stay = total <= bound[r, p]
        if not stay.all():
            r, p, c, total = r[stay], p[stay], c[stay], total[stay]
    cell = r * many + p  # in ascending order, and within a cell so are the entries; the leader is always left
    start = np.flatnonzero(np.diff(cell, prepend=-1))
    least = np.minimum.reduceat(total, start)
    hit = np.flatnonzero(total == np.repeat(least, np.diff(start, append=len(cell))))
    first = hit[np.flatnonzero(np.diff(cell[hit], prepend=-1))]
    return c[first].reshape(rows, many), (least // n).reshape(rows, many)


def _integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exact: Python's integers where 64 bits could be too few."""
    if not vectors.size or np.abs(vectors).max() < 1 << 48:
        return np.floor(vectors * SCALE).astype(np.int64)
    return np.array([[int(x) * SCALE if abs(x) >= 1 << 53 else int(np.floor(x * SCALE)) for x in v] for v in vectors], object).reshape(vectors.shape)


def _cut(integers: np.ndarray, parts: int) -> np.ndarray:
    """Vectors in `parts` equal parts, with zeros behind where the length is no multiple."""
    rows, length = integers.shape
    width = -(-length // parts)
    padded = np.zeros((rows, parts * width), integers.dtype)
    padded[:, :length] = integers
    return padded.reshape(rows, parts, width)


def _kept(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows that hold `length` finite numbers, and these."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), length), False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    values = column.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), length)
    finite = np.isfinite(values).all(axis=1)  # a null component is NaN here
    return at[finite], values[finite]


def _sound(vec: str) -> F.Column:
    return F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


class Codebooks:
    """Entries of all parts as integers (part, entry, position), and the length of the vectors they are for."""

    def __init__(self, entries: np.ndarray, length: int):
        self.entries, self.length = entries, length

    def digest(self) -> str:
        """SHA-256 of all components as decimals, by part, entry and position, with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def learn(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks from all vectors of `df`.

    They start as the vectors of the `entries` smallest ids (a null id comes last; of several vectors of one id the least
    counts; fewer ids give fewer entries). Each round is one pass over the table: every task sums the parts of each entry,
    the sums meet by (part, entry, position), and only those, entries x length numbers, come to the driver. Entries
    without parts stay. Vectors that are null or hold null or non-finite components don't count, nor do those of another
    length than the vector of the least id, as they can't be cut alike; a length that is no multiple of `parts` is filled
    up with zeros. Repeated rows count each time. An empty table gives codebooks without entries.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    sound = rows.where(_sound("vec"))
    first = sound.orderBy(F.col("id").asc_nulls_last(), "vec").limit(1).collect()
    length = len(first[0]["vec"]) if first else 0
    if not length:
        return Codebooks(np.zeros((parts, 1 if first else 0, 0), np.int64), 0)
    fit = sound.where(F.size("vec") == length)
    ids = [r["id"] for r in fit.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()]
    chosen = F.col("id").isin([i for i in ids if i is not None]) | (F.col("id").isNull() & F.lit(None in ids))
    seeds = {r["id"]: r["vec"] for r in fit.where(chosen).groupBy("id").agg(F.min("vec").alias("vec")).collect()}
    books = _cut(_integers(np.array([seeds[i] for i in ids])), parts).transpose(1, 0, 2)
    for _ in range(rounds):
        sums = rows.select("vec").transform(in_batches, _summing(books, length, parts), "part int, entry int, position int, n long, total string")
        met = sums.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        books = books.astype(object)
        for r in met:
            books[r["part"], r["entry"], r["position"]] = int(r["total"]) // r["n"]
        if all(abs(x) < 1 << 62 for x in books.flat):
            books = books.astype(np.int64)
    return Codebooks(books, length)


def _summing(books: np.ndarray, length: int, parts: int):
    """A task's sums of the parts that each entry is nearest to, as decimal strings."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, object)
        at = np.broadcast_to(np.arange(parts), (0, parts))
        for batch in batches:
            x = _cut(_integers(_kept(batch.column(0), length)[1]), parts)
            code, _ = nearest(x, books)
            at = np.broadcast_to(np.arange(parts), code.shape)
            np.add.at(counts, (at, code), 1)
            sums = np.zeros(books.shape, x.dtype)  # a batch is too short for its sums to leave 64 bits
            np.add.at(sums, (at, code), x)
            totals = totals + sums
        part, entry, position = np.indices(books.shape).reshape(3, -1)
        n = np.repeat(counts.ravel(), books.shape[2])
        used = n > 0
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(part[used], pa.int32()), "entry": pa.array(entry[used], pa.int32()), "position": pa.array(position[used], pa.int32()),
            "n": pa.array(n[used], pa.int64()), "total": pa.array([str(t) for t in totals.ravel()[used]], pa.string()),
        })

    return run


def compress(df: DataFrame, books: Codebooks, vec_col: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """`keep` (all columns but `vec_col` unless given), code (binary, a byte for each part: the index of its nearest
    entry) and error (long, squared distances summed over parts).

    Vectors that are null, hold null or non-finite components or have another length than the codebooks' are left out;
    repeated rows stay, each with the same code. Codes of an empty table are an empty table. Columns of `df` that are
    named code or error are not kept. An error beyond 64 bits fails the query rather than being wrong.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in (vec_col, "code", "error")]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    entries, length, parts = books.entries, books.length, books.entries.shape[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not entries.shape[1]:
                continue
            at, vectors = _kept(batch.column(len(keep)), length)
            code, error = nearest(_cut(_integers(vectors), parts), entries) if length else (np.zeros((len(at), parts), int), np.zeros((len(at), parts), int))
            kept = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keep))]
            codes, errors = pa.array([bytes(c) for c in code.astype(np.uint8)], pa.binary()), pa.array([int(e) for e in error.sum(axis=1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*kept, codes, errors], names=[*keep, "code", "error"])

    return df.select(*keep, F.col(vec_col).cast("array<double>").alias("__vec")).transform(in_batches, run, schema)


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """`coded` with label_error, the errors of all rows with the same label, null labels together. `coded` is read twice,
    so it should be a written table. Sums are made before they meet, so a label of many rows costs no more than others."""
    totals = coded.groupBy(label_col).agg(F.sum("error").alias("label_error")).select(F.col(label_col).alias("__label"), "label_error")
    few = totals.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return coded.join(F.broadcast(totals) if few else totals, F.col(label_col).eqNullSafe(F.col("__label"))).drop("__label")
