"""Operator 8: near-duplicates by DartMinHash signatures and a banded join.

Darts: over each element of a weighted set stands a strip as wide as its weight and endless in rank. Hashes throw darts
into it, one for each unit of area on average, at the same places for whatever set holds the element. Each dart belongs
to one of K coordinates, and a coordinate's value is the dart of the lowest rank inside the set's strips. Two sets agree
in a coordinate with a probability equal to their weighted Jaccard similarity. About K (ln K + 2) darts fill all
coordinates, whatever the size of the set, so that a long text costs one hash an element and few darts.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, rows_of, to_batches, written
from .components import components

#: Words of a shingle, least similarity of a link, bands and coordinates of a band: a pair at 0.8 shares one of 25 bands
#: of 5 with a probability of 0.99995.
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 25, 5
#: Each member of a bucket is first compared with this many hubs of the bucket (members with the most candidates
#: overall); buckets of up to SMALL members are compared whole, which is a bounded number of pairs. Neither limits what
#: is found: what the hubs leave open is compared after that.
HUBS, SMALL = 4, 8
#: What the hubs leave open is compared block by block: members and bytes of hashes of a block, columns of a comparison.
BLOCK, BLOCK_BYTES, COLUMNS = 256, 8 << 20, 4096
#: Tables of document ids up to this size are joined by broadcast, larger ones by shuffle.
BROADCAST_BYTES = 16 << 20

_U = np.uint64
_M1, _M2, _STEP = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result hangs on all bits of x."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _salt(*parts: int) -> np.uint64:
    return _U(xxhash.xxh64_intdigest(repr(parts)))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def _strips(done: int, reach: float) -> list[tuple[np.ndarray, float, float]]:
    """Strips of the rank axis from number `done` on that begin below `reach`, alike for all sets: 0 to 1/8, to 1, then of
    length 1. Those of one length come together: their numbers, the start of the first, the length. Long texts need the
    first alone, so that they get few darts; short ones need many, which are thrown at once."""
    out = []
    if done < 1:
        out.append((np.array([0]), 0.0, 0.125))
    if done < 2 and reach > 0.125:
        out.append((np.array([1]), 0.125, 0.875))
    first, last = max(done, 2), 1 + math.ceil(reach)
    if last > first:
        out.append((np.arange(first, last), float(first - 1), 1.0))
    return out


def _poisson_steps(mean: float) -> np.ndarray:
    """Distribution function of the number of darts in an area of this size, for up to 15 darts."""
    p, total, out = math.exp(-mean), 0.0, []
    for k in range(16):
        total += p
        out.append(total)
        p *= mean / (k + 1)
    return np.array(out)


_STEPS = {w: _poisson_steps(w) for w in (0.125, 0.875, 1.0)}
_SALTS = functools.lru_cache(maxsize=1024)(_salt)


def signature(elements: np.ndarray, weights: np.ndarray | None = None, k: int = BANDS * ROWS) -> np.ndarray:
    """The k dart values of a set of 64-bit hashes; weights above zero, 1 each unless given. The set must not be empty.

    A weight's strip is made of cells of width 1; in the last one the darts beyond the weight are outside the set.
    """
    if weights is None:
        cells, width = elements, None
        total = float(len(elements))
    else:
        n = np.ceil(weights).astype(np.int64)
        at = np.repeat(np.arange(len(elements)), n)
        cell = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        cells = np.where(cell == 0, elements[at], _mix(elements[at] + cell.astype(_U) * _STEP))
        width = np.minimum(weights[at] - cell, 1.0)
        total = float(weights.sum())
    best_rank, best = np.full(k, np.inf), np.zeros(k, _U)
    reach, done = k * (math.log(k) + 2) / total, 0
    while True:
        for numbers, low, length in _strips(done, reach):
            salts = np.array([_SALTS(int(j)) for j in numbers], _U)
            counts = np.searchsorted(_STEPS[length], _unit(_mix(cells[:, None] ^ salts)).ravel(), side="right")
            spot = np.repeat(np.arange(len(counts)), counts)
            done = int(numbers[-1]) + 1
            if not len(spot):
                continue
            at, strip = np.divmod(spot, len(salts))
            # the darts of a cell and strip are told apart by their number
            number = np.arange(len(spot)) - np.repeat(np.cumsum(counts) - counts, counts)
            dart = _mix(cells[at] + salts[strip] + number.astype(_U) * _STEP)
            if width is not None:
                inside = _unit(_mix(dart + _STEP)) < width[at]
                dart, strip = dart[inside], strip[inside]
            rank = low + length * (strip + _unit(_mix(dart ^ _STEP)))
            order = np.argsort(-rank)
            dart, rank = dart[order], rank[order]
            place = (dart % _U(k)).astype(np.int64)
            first, value = np.full(k, np.inf), np.zeros(k, _U)
            first[place], value[place] = rank, dart  # the last to be set is the lowest in rank
            better = first < best_rank
            best_rank[better], best[better] = first[better], value[better]
        # a coordinate is settled once it has a dart, as strips come in the order of ranks
        if np.isfinite(best_rank).all():
            return best
        reach = max(reach, max(done - 1, 0.125)) + max(k / total, 0.5)


class _Words(dict):
    """Hashes of words, kept for words that come again; started anew when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def shingles(text: str | None, size: int = SHINGLE, counted: bool = False):
    """Hashes of the word shingles of a text, sorted, distinct; with `counted` also how often each occurs.

    Words are runs without white space. A text of fewer words has one shingle, of all of them; one without words none.
    """
    words = (text or "").split()
    if not words:
        found = np.empty(0, _U)
    else:
        of = np.fromiter(map(_WORDS.__getitem__, words), _U, len(words))
        size = min(size, len(words))
        n = len(words) - size + 1
        found = np.full(n, _U(size))
        for i in range(size):
            found = _mix(found * _STEP + of[i : i + n])
    return np.unique(found, return_counts=True) if counted else np.unique(found)


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", weighted: bool = False) -> DataFrame:
    """id, set (digest of the shingle set, null without words), size, bands (array of BANDS hashes).

    With `weighted` shingles weigh as often as they occur, and equal sets need equal counts.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), ("set", pa.binary()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])

            def made():
                for i, text in rows_of([batch]):
                    found, times = shingles(text, counted=True)
                    if not len(found):
                        yield i, None, 0, []
                        continue
                    digest = _digest(found, times, weighted)
                    values = signature(found, times.astype(np.float64) if weighted else None)
                    bands = [_band(values[b * ROWS : (b + 1) * ROWS], b) for b in range(BANDS)]
                    yield i, digest, int(times.sum() if weighted else len(found)), bands

            yield from to_batches(made(), schema)

    out = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("set", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).transform(in_batches, run, out)


def _digest(found: np.ndarray, times: np.ndarray, weighted: bool) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes() + (times.astype(np.int64).tobytes() if weighted else b""))


def _band(values: np.ndarray, b: int) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes(), seed=b) - (1 << 63)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets (id, hashes, times) reach the similarity, exactly."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("hashes_a"), F.col("times").alias("times_a"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hashes_b"), F.col("times").alias("times_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "hashes_a", "times_a", "hashes_b", "times_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), batch.schema.field(1)])

            def near():
                for a, b, ha, ta, hb, tb in rows_of([batch]):
                    x, y = np.frombuffer(ha, _U), np.frombuffer(hb, _U)
                    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                    if ta is None:
                        shared, total = len(i), len(x) + len(y)
                    else:
                        p, q = np.frombuffer(ta, np.int64), np.frombuffer(tb, np.int64)
                        shared, total = int(np.minimum(p[i], q[j]).sum()), int(p.sum() + q.sum())
                    if shared >= similarity * (total - shared):
                        yield a, b

            yield from to_batches(near(), schema)

    return both.transform(in_batches, run, T.StructType([pairs.schema["a"], pairs.schema["b"]]))


def _sets_of(df: DataFrame, ids: DataFrame, id_col: str, text_col: str, weighted: bool) -> DataFrame:
    """id, hashes, times of the documents in `ids`; an id with several texts has a row for each of their sets."""
    chosen = F.broadcast(ids) if ids.count() * 24 <= BROADCAST_BYTES else ids
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id", "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), ("set", pa.binary()), ("hashes", pa.binary()), ("times", pa.binary())])

            def made():
                for i, text in rows_of([batch]):
                    found, times = shingles(text, counted=True)
                    if len(found):
                        yield i, _digest(found, times, weighted), found.tobytes(), times.astype(np.int64).tobytes() if weighted else None

            yield from to_batches(made(), schema, weigh=2)

    out = T.StructType([texts.schema["id"], *(T.StructField(c, T.BinaryType()) for c in ("set", "hashes", "times"))])
    return texts.transform(in_batches, run, out).dropDuplicates(["id", "set"]).drop("set")


def _in_components(members: DataFrame, components_of: DataFrame) -> DataFrame:
    """The rows with the component of their `rep`; one that has no link is a component of its own."""
    return members.join(components_of, members["rep"] == components_of["node"], "left").select(*members.columns, F.coalesce("component", "rep").alias("component"))


def _cells(hashes: bytes, times: bytes | None) -> np.ndarray:
    """A set's elements; one that weighs n is n of them, so that the least weights are the elements in common."""
    found = np.frombuffer(hashes, _U)
    if times is None:
        return found
    n = np.frombuffer(times, np.int64)
    at = np.repeat(np.arange(len(found)), n)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return np.where(cell == 0, found[at], _mix(found[at] + cell.astype(_U) * _STEP))


def _in_common(cells: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many elements each set of `a` has in common with each of `b`, exactly."""
    where = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    _, kind, times = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
    often = times > 1
    met = often[kind]
    column, where = (np.cumsum(often) - 1)[kind[met]], where[met]
    order = np.argsort(column)
    column, where = column[order], where[order]
    total = np.zeros((len(a), len(b)))
    for first in range(0, int(often.sum()), COLUMNS):
        i, j = np.searchsorted(column, [first, first + COLUMNS])
        held = np.zeros((len(cells), COLUMNS), np.float32)
        held[where[i:j], column[i:j] - first] = 1
        total += held[a] @ held[b].T
    return total


def _open_links(members: DataFrame, df: DataFrame, id_col: str, text_col: str, similarity: float, weighted: bool) -> DataFrame:
    """Links (a, b) that join the components which meet in a bucket, of members (band, hash, rep, size, component).

    All pairs of a bucket but those of one component are compared. Its largest component and its other members are cut
    into blocks; each pair of blocks but those of the largest component is one comparison of bounded size, and leaves
    the links that join components, not all of them. Buckets of the same members are compared once.
    """
    mark = [F.xxhash64(F.lit(k), F.col("rep").cast("string")).cast("decimal(38,0)") for k in range(2)]
    parts = members.groupBy("band", "hash", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"), F.sum(mark[0]).alias("m0"), F.sum(mark[1]).alias("m1"))
    open_buckets = (
        parts.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.struct("c", "component", "s")).alias("head"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("m0").alias("m0"), F.sum("m1").alias("m1"))
        .where("kinds > 1").groupBy("c", "m0", "m1").agg(F.min(F.struct("band", "hash", "head", "s")).alias("b")).select("b.band", "b.hash", "b.head", "c", "b.s")
    )

    def blocks(c: Column, s: Column) -> Column:
        return F.ceil(F.greatest(c / BLOCK, s * 8 / BLOCK_BYTES)).cast("int")

    first, others = blocks(F.col("head.c"), F.col("head.s")), blocks(F.col("c") - F.col("head.c"), F.col("s") - F.col("head.s"))
    open_buckets = open_buckets.select("band", "hash", F.col("head.component").alias("head"), first.alias("first"), others.alias("others"))
    rows = written(members.select("band", "hash", "rep", "component").join(open_buckets, ["band", "hash"]), "dart-open")
    sets = _sets_of(df, written(rows.select(F.col("rep").alias("id")).distinct(), "dart-ids"), id_col, text_col, weighted)
    place, in_head, last = F.xxhash64(F.col("rep").cast("string")), F.col("component") == F.col("head"), F.col("first") + F.col("others") - 1
    own = rows.withColumn("block", F.when(in_head, F.pmod(place, F.col("first"))).otherwise(F.col("first") + F.pmod(place, F.col("others"))).cast("int"))
    own = own.withColumn("other", F.explode(F.when(in_head, F.sequence(F.col("first"), last)).otherwise(F.sequence(F.lit(0), last))))
    sent = own.select("band", "hash", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "component")
    sent = sent.join(sets.withColumnRenamed("id", "rep"), "rep").repartition("band", "hash", "low", "high").sortWithinPartitions("band", "hash", "low", "high")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joining(rows):
            number: dict = {}
            of = np.array([number.setdefault(r[6], len(number)) for r in rows])
            side = np.array([r[4] for r in rows])
            a, b = np.flatnonzero(side == rows[0][2]), np.flatnonzero(side == rows[0][3])
            if not len(a) or not len(b) or len(number) < 2:
                return
            cells = [_cells(r[7], r[8]) for r in rows]
            size = np.array([len(c) for c in cells])
            shared = _in_common(cells, a, b)
            i, j = np.nonzero((shared >= similarity * (size[a][:, None] + size[b][None, :] - shared)) & (of[a][:, None] != of[b][None, :]))
            root = list(range(len(number)))

            def find(x):
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for i, j in zip(a[i].tolist(), b[j].tolist()):
                x, y = find(of[i]), find(of[j])
                if x != y:
                    root[x] = y
                    yield rows[i][5], rows[j][5]

        def found(batches):
            held: list[tuple] = []
            for row in rows_of(batches):
                if held and held[-1][:4] != row[:4]:
                    yield from joining(held)
                    held = []
                held.append(row)
            if held:
                yield from joining(held)

        batches = iter(batches)
        first = next(batches, None)
        if first is not None:
            kind = first.schema.field("rep").type
            yield from to_batches(found(itertools.chain([first], batches)), pa.schema([("a", kind), ("b", kind)]))

    kind = members.schema["rep"].dataType
    links = sent.select("band", "hash", "low", "high", "block", "rep", "component", "hashes", "times").transform(in_batches, run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
    return written(links.distinct(), "dart-links")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """Classes of near-duplicates. Returns one row for each row: `id_col`, rep_id (the least id with the same shingle
    set), class_id (the least id in the component of links at `similarity` or more; the document itself if alone).

    Documents with equal shingle sets fall together first, so that copies never meet in a bucket. Members of a bucket
    are compared with its hubs first: the member that appears in the most and fullest buckets is the one that others
    were copied from. Buckets that then hold more than one component are compared whole, block by block, but for pairs
    of one component. So every pair that shares a band is compared or already in one class. A link is an exact
    comparison of shingle sets. Texts that are null or have no words are alone, as are rows with a null id (their
    results are null). Rows that repeat an id are one document, which is near to whatever any of its texts is near to.
    Very long texts cost time and memory in proportion to their words; further columns do no harm. An empty table gives no
    rows.
    """
    found = written(sketches(df, id_col, text_col, weighted), "dart-sketches")
    known = found.where("id is not null and set is not null")
    reps = written(known.groupBy("set").agg(F.min("id").alias("rep"), F.min(F.struct("size", "bands")).alias("s")).select("rep", "set", "s.size", "s.bands"), "dart-reps")
    rows = reps.select("rep", "size", F.posexplode("bands").alias("band", "hash"))
    buckets = written(rows.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "dart-buckets")
    members = rows.join(buckets, ["band", "hash"])
    score = members.groupBy("rep").agg(F.sum("n").alias("score"))
    members = written(members.join(score, "rep"), "dart-members")

    hubs = members.where(F.col("n") > SMALL).groupBy("band", "hash").agg(_top(F.col("score"), F.col("rep"), HUBS).alias("others"))
    whole = members.where(F.col("n") <= SMALL).groupBy("band", "hash").agg(F.collect_list(F.struct("rep", "size")).alias("others"))
    pairs = members.join(hubs.unionByName(whole), ["band", "hash"]).select(F.col("rep").alias("x"), F.col("size").alias("size_x"), F.explode("others").alias("other"))
    pairs = pairs.where((F.col("x") != F.col("other.rep")) & (F.least("size_x", "other.size") >= similarity * F.greatest("size_x", "other.size")))
    pairs = written(pairs.select(F.least("x", "other.rep").alias("a"), F.greatest("x", "other.rep").alias("b")).distinct(), "dart-pairs")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "dart-ids")
    sets = written(_sets_of(df, ids, id_col, text_col, weighted), "dart-sets")
    links = _verified(pairs, sets, similarity).distinct()
    # a document with several texts ties their sets together
    own = written(known.select("id", "set").join(reps.select("set", "rep"), "set").select("id", "rep"), "dart-own")
    several = own.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("id", "a")
    ties = own.join(several, "id").where("a != rep").select("a", F.col("rep").alias("b"))
    links = written(links.unionByName(ties).distinct(), "dart-links")
    classes = written(components(links), "dart-components")
    rest = _open_links(_in_components(members.where(F.col("n") > SMALL), classes), df, id_col, text_col, similarity, weighted)
    if not rest.isEmpty():
        classes = written(components(links.unionByName(rest)), "dart-components")
    placed = own.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("id", "rep", F.coalesce("component", "rep").alias("class"))
    alone = found.where("id is null or set is null").select("id", F.col("id").alias("rep"), F.col("id").alias("class"))
    return placed.unionByName(alone).select(F.col("id").alias(id_col), F.col("rep").alias("rep_id"), F.col("class").alias("class_id"))


def _top(score: Column, rep: Column, n: int) -> Column:
    """Hubs of a bucket: its member of the highest score, and the best of each of n - 1 sections that a hash of ids makes.

    All of them are plain aggregates with partial results of fixed size.
    """
    member, rank = F.struct(rep.alias("rep"), F.col("size").alias("size")), F.struct(score, rep)
    section = F.pmod(F.xxhash64(rep.cast("string")), F.lit(max(n - 1, 1)))
    sections = [F.max_by(member, F.when(section == k, rank)) for k in range(n - 1)]
    return F.array_compact(F.array(F.max_by(member, rank), *sections))
