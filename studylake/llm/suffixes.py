"""Operator 6: removal of repeated passages by a hash-compared suffix sort.

Two equal strings of LENGTH bytes pick the same anchor inside themselves (the places whose ANCHOR-byte hash is least
in some window), so only suffixes at anchors need to be sorted, and only anchors whose hash occurs twice. Anchors with
the same bytes all around are settled by a grouping: all but the first are repeats. Of each group of anchors with
differing surroundings one of each kind remains; these are sorted, both as suffixes to the right and as reversed
prefixes to the left. The comparison finds the longest common extension by binary search over prefix polynomial
hashes; bytes verify it. Runs of neighbours with long enough extensions are the equal strings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, rows_of, to_batches, written

#: Length of the strings that must not repeat, and of the anchors; a string holds WINDOWS anchors.
LENGTH, ANCHOR = 100, 32
WINDOWS = LENGTH - ANCHOR + 1
#: Texts are hashed in stretches of at most so many bytes.
STRETCH = 1 << 17
#: Groups with more kinds of surroundings than this are not sorted in one task: their strings are grouped by hash instead.
SORTED_GROUP = 100_000

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so that they can be divided by modulo 2^64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base % (1 << 64)))
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = [(_powers(b, STRETCH + 1), _powers(pow(b, -1, 1 << 64), STRETCH + 1)) for b in _BASES]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _prefixes(data: np.ndarray, which: int) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2^64."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _POWERS[which][0][: len(data)], out=out[1:])
    return out


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of `width` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def _anchors(data: np.ndarray, ends: np.ndarray, with_context: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Anchors of texts that stand one after another in `data` and end at `ends`: places, hashes, hashes of surroundings."""
    none = np.empty(0, np.int64), np.empty(0, _U), np.empty(0, _U)
    if len(data) < LENGTH:
        return none
    prefix = _prefixes(data, 0)
    hashes = _mix((prefix[ANCHOR:] - prefix[:-ANCHOR]) * _POWERS[0][1][: len(data) - ANCHOR + 1]) | _U(1)
    least = _sliding(hashes, WINDOWS, np.minimum)  # for each string start
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    least[text[: len(least)] != text[LENGTH - 1 :]] = 0  # strings across texts pick nothing
    pad = np.zeros(WINDOWS - 1, _U)
    at = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), WINDOWS, np.maximum) == hashes)
    if not with_context:
        return at, hashes[at], None
    low = np.maximum(at - (WINDOWS - 1), (ends - np.diff(ends, prepend=0))[text[at]])
    high = np.minimum(at + LENGTH, ends[text[at]])
    other = _prefixes(data, 1)
    around = _mix((other[high] - other[low]) * _POWERS[1][1][low])
    return at, hashes[at], _mix(around + ((at - low) * 256 + high - at).astype(_U))


def _stretches(rows: Iterable[tuple]) -> Iterator[tuple[list, list, list, list, np.ndarray, np.ndarray]]:
    """Texts gathered into stretches: ids, start in the document, own range, data, ends. Long texts are cut so that each
    place has LENGTH bytes around it, or its text's end, in the stretch that owns it."""
    ids, bases, owns, parts, size = [], [], [], [], 0
    for i, text in rows:
        data = np.frombuffer((text or "").encode("utf-8"), np.uint8)
        n, start = len(data), 0
        if n < LENGTH or i is None:
            continue
        while True:
            end = min(n, start + STRETCH)
            if parts and size + end - start > STRETCH:
                yield ids, bases, owns, parts, np.concatenate(parts), np.cumsum([len(p) for p in parts])
                ids, bases, owns, parts, size = [], [], [], [], 0
            ids.append(i)
            bases.append(start)
            owns.append((start + LENGTH if start else 0, end - LENGTH if end < n else n))
            parts.append(data[start:end])
            size += end - start
            if end == n:
                break
            start = end - 2 * LENGTH
    if parts:
        yield ids, bases, owns, parts, np.concatenate(parts), np.cumsum([len(p) for p in parts])


def anchors(df: DataFrame, id_col: str, text_col: str, with_context: bool) -> DataFrame:
    """hash of each anchor of each text; with_context also id, at (byte) and context (hash of its surroundings)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, bases, owns, _, data, ends in _stretches(rows_of([batch])):
                at, hashes, around = _anchors(data, ends, with_context)
                which = np.searchsorted(ends, at, side="right")
                at = at - (ends - np.diff(ends, prepend=0))[which] + np.array(bases)[which]
                own = np.array(owns)[which]
                mine = (at >= own[:, 0]) & (at < own[:, 1])
                if not with_context:
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[mine].view(np.int64))], names=["hash"])
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[mine].view(np.int64)), pa.array(around[mine].view(np.int64)), pa.array(np.array(ids, np.int64)[which][mine]), pa.array(at[mine])],
                    names=["hash", "context", "id", "at"],
                )

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).transform(in_batches, run, "hash long, context long, id long, at long" if with_context else "hash long")


class _Side:
    """Strings of up to `width` bytes, of the same group or not, in the order of their groups: sort and compare."""

    def __init__(self, strings: list[bytes], group: np.ndarray, width: int):
        n = len(strings)
        self.group = group
        self.size = np.fromiter(map(len, strings), np.int64, n)
        self.bytes = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(n, width)
        self.hashes = np.zeros((n, width + 1), _U)
        np.cumsum((self.bytes.astype(_U) + _U(1)) * _POWERS[0][0][:width], axis=1, out=self.hashes[:, 1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of common prefixes, by binary search over the hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hashes[a, mid] == self.hashes[b, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether string a sorts before string b: by group, then bytes, a prefix before what extends it, then place."""
        n = self.common(a, b)
        ended_a, ended_b = n >= self.size[a], n >= self.size[b]
        last = self.bytes.shape[1] - 1
        byte = self.bytes[a, np.minimum(n, last)] < self.bytes[b, np.minimum(n, last)]
        tie = np.where(self.size[a] != self.size[b], self.size[a] < self.size[b], a < b)
        inner = np.where(ended_a | ended_b, np.where(ended_a & ended_b, tie, ended_a), byte)
        return np.where(self.group[a] != self.group[b], self.group[a] < self.group[b], inner)

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Mergesort, all pairs of runs of a level at once; common prefix of each string with the one before it.

        The strings come in the order of their groups, so that two runs only mix where a group lies across their seam:
        the strings of this group are searched for in its part of the other run, all others stay where they are.
        """
        n = len(self.size)
        order = np.arange(n)
        begins = np.searchsorted(self.group, self.group, side="left")
        ends = np.searchsorted(self.group, self.group, side="right")
        width = 1
        while width < n:
            seams = np.arange(width, n, 2 * width)
            seams = seams[self.group[seams - 1] == self.group[seams]]
            if len(seams):
                low, high = np.maximum(seams - width, begins[seams]), np.minimum(seams + width, ends[seams])
                sizes = high - low
                at = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                seam, first, last = (np.repeat(x, sizes) for x in (seams, low, high))
                left = at < seam
                # how many of the other run's part come before each string; equal strings keep the left run first by their place
                begin = np.where(left, seam, first)
                low, high = begin.copy(), np.where(left, last, seam)
                while True:
                    todo = np.flatnonzero(low < high)
                    if not len(todo):
                        break
                    mid = (low[todo] + high[todo]) // 2
                    earlier = self.before(order[mid], order[at[todo]])
                    low[todo] = np.where(earlier, mid + 1, low[todo])
                    high[todo] = np.where(earlier, high[todo], mid)
                place = np.where(left, at, at - seam + first) + (low - begin)
                merged = order.copy()
                merged[place] = order[at]
                order = merged
            width *= 2
        shared = np.zeros(n, np.int64)
        a, b = order[:-1], order[1:]
        n_common = self.common(a, b)
        # the bytes have the last word on what the hashes call equal
        columns = np.arange(self.bytes.shape[1])
        wrong = ((self.bytes[a] != self.bytes[b]) & (columns < n_common[:, None])).any(axis=1)
        for k in np.flatnonzero(wrong):
            n_common[k] = int(np.argmax(self.bytes[a[k]] != self.bytes[b[k]]))
        shared[1:] = np.where(self.group[a] == self.group[b], n_common, -1)
        if n:
            shared[0] = -1
        return order, shared

    def reach(self, order: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """The longest common prefix that each string has with another of its group: with one of its neighbours in the order."""
        out = np.full(len(order), -1)
        out[order] = np.maximum(shared, np.append(shared[1:], -1))
        return out

    def classes(self, order: np.ndarray, shared: np.ndarray, length: int) -> np.ndarray:
        """A number for each string, equal for those of a group whose first `length` bytes are equal; -1 for shorter strings."""
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(shared < length)
        out[self.size < length] = -1
        return out


def repeats(group: np.ndarray, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the anchors, given in order of group and place, stand in a string of LENGTH bytes that an earlier anchor of
    its group stands in at the same offset: their indexes, and how far left of the anchor such strings start at least and
    at most. `left` holds the bytes before each anchor in reverse.

    As all these strings hold the anchor, what they cover is one interval.
    """
    n = len(group)
    l, r = _Side(left, group, WINDOWS - 1), _Side(right, group, LENGTH)
    l_order, l_shared = l.sorted()
    r_order, r_shared = r.sorted()
    # the longest that any other of its group has in common with a string, on each side: no repeat reaches further
    back, on = l.reach(l_order, l_shared), r.reach(r_order, r_shared)
    least, most = np.full(n, LENGTH), np.full(n, -1)
    for offset in range(WINDOWS):
        if not ((back >= offset) & (on >= LENGTH - offset)).any():
            continue
        a, b = l.classes(l_order, l_shared, offset), r.classes(r_order, r_shared, LENGTH - offset)
        some = np.flatnonzero((a >= 0) & (b >= 0) & (back >= offset) & (on >= LENGTH - offset))
        if len(some) < 2:
            continue
        key = a[some] * (n + 1) + b[some]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        again = some[first[which] < np.arange(len(some))]
        least[again] = np.minimum(least[again], offset)
        most[again] = np.maximum(most[again], offset)
    found = np.flatnonzero(most >= 0)
    return found, least[found], most[found]


def _sort_groups(contexts: DataFrame) -> DataFrame:
    """Repeated stretches (id, start, end) among anchors (hash, id, at, left, right) with differing surroundings."""

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        hashes, ids, at, left, right = zip(*rows)
        found, least, most = repeats(np.array(hashes, np.int64), list(left), list(right))
        at = np.array(at, np.int64)[found]
        return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[found]), pa.array(at - most), pa.array(at - least + LENGTH)], names=["id", "start", "end"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in rows_of(batches):
            if len(rows) >= 20_000 and rows[-1][0] != row[0]:
                yield flush(rows)
                rows = []
            rows.append(row)
        if rows:
            yield flush(rows)

    ordered = contexts.select("hash", "id", "at", "left", "right").repartition("hash").sortWithinPartitions("hash", "id", "at")
    return ordered.transform(in_batches, run, "id long, start long, end long")


def _group_strings(contexts: DataFrame) -> DataFrame:
    """The same for groups too large for one task: all their strings are grouped by digest, partial results first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        schema = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("start", pa.int64()), ("digest", pa.binary())])

        def strings():
            for h, i, at, left, right in rows_of(batches):
                whole, n = left[::-1] + right, len(left)
                salt = h.to_bytes(8, "little", signed=True)
                for back in range(max(0, LENGTH - len(right)), n + 1):
                    yield i, at, at - back, xxhash.xxh3_128_digest(salt + whole[n - back : n - back + LENGTH])

        yield from to_batches(strings(), schema)

    # several anchors of one hash may stand in the same string, so strings are told apart by where they start
    strings = contexts.select("hash", "id", "at", "left", "right").transform(in_batches, run, "id long, at long, start long, digest binary")
    first = strings.groupBy("digest").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    again = strings.join(first, "digest").where((F.col("id") != F.col("first.id")) | (F.col("start") != F.col("first.start")))
    return again.groupBy("id", "at").agg(F.min("start").alias("start"), F.max("start").alias("last")).select("id", "start", (F.col("last") + LENGTH).alias("end"))


def _contexts(df: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The bytes to the left (reversed) and right of anchors (hash, kinds, id, at)."""
    side = places.groupBy("id").agg(F.collect_list(F.struct("hash", "kinds", "at")).alias("places"))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(side, "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("hash", pa.int64()), ("kinds", pa.int64()), ("id", pa.int64()), ("at", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])

        def cut():
            for i, text, places in rows_of(batches):
                data = (text or "").encode("utf-8")
                for p in places:
                    at = p["at"]
                    yield p["hash"], p["kinds"], i, at, data[max(0, at - WINDOWS + 1) : at][::-1], data[at : at + LENGTH]

        yield from to_batches(cut(), schema)

    return texts.transform(in_batches, run, "hash long, kinds long, id long, at long, left binary, right binary").dropDuplicates(["hash", "id", "at"])


def repeated_stretches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, end: bytes covered by strings of LENGTH bytes that also start earlier (smaller id, or same id and
    earlier start). Stretches may overlap; together they hold just those bytes."""
    # written first, so that the join below has plain exchanges on both sides and Spark can split a frequent hash
    counts = written(anchors(df, id_col, text_col, False).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "suffix-hashes", tidy=True)
    met = written(anchors(df, id_col, text_col, True).join(counts, "hash"), "suffix-anchors", tidy=True)
    kinds = written(met.groupBy("hash", "context").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("n")), "suffix-kinds", tidy=True)
    many = kinds.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")

    # same surroundings as an earlier anchor: every string that holds the anchor repeats
    shared = kinds.where("n > 1").select("hash", "context", "first")
    copies = met.join(shared, ["hash", "context"]).where((F.col("id") != F.col("first.id")) | (F.col("at") != F.col("first.at")))
    whole = copies.select("id", F.greatest(F.col("at") - (WINDOWS - 1), F.lit(0)).alias("start"), (F.col("at") + LENGTH).alias("end"))

    places = written(kinds.join(many, "hash").select("hash", "kinds", F.col("first.id").alias("id"), F.col("first.at").alias("at")), "suffix-places", tidy=True)
    contexts = written(_contexts(df, places, id_col, text_col), "suffix-contexts", tidy=True)
    parts = _sort_groups(contexts.where(F.col("kinds") <= SORTED_GROUP))
    large = contexts.where(F.col("kinds") > SORTED_GROUP)
    if not large.isEmpty():
        parts = parts.unionByName(_group_strings(large))
    return whole.unionByName(parts)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut repeated passages out of whole texts, as UTF-8 bytes.

    Returns `id_col`, n_bytes, spans (array of struct start, end: the maximal removed runs, in order) and kept (binary,
    the other bytes). Strings are judged on the input, not on what is left, and never cross documents. Ids have to be
    whole numbers; they give the order. A null text counts as empty, an empty table gives no rows, very long
    texts are cut whole, and other columns are left out. A text with a null id has no place in the order and
    stays whole; rows that repeat an id and a text are one document, of which each row shows the result.
    """
    stretches = written(repeated_stretches(df, id_col, text_col), "suffix-stretches", tidy=True)
    per_text = stretches.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s")).select("id", F.transform("s", lambda x: x["start"]).alias("starts"), F.transform("s", lambda x: x["end"]).alias("ends"))
    texts = df.select(F.col(id_col).alias("given"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(per_text, "id", "left").select("given", "text", "starts", "ends")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            schema = pa.schema([pa.field("given", batch.schema.field(0).type), ("n_bytes", pa.int64()), ("spans", span), ("kept", pa.binary())])

            def cut():
                for i, text, starts, ends in rows_of([batch]):
                    data = (text or "").encode("utf-8")
                    spans: list[dict] = []
                    for start, end in zip(starts or (), ends or ()):
                        end = min(end, len(data))
                        if spans and start <= spans[-1]["end"]:
                            spans[-1]["end"] = max(spans[-1]["end"], end)
                        else:
                            spans.append({"start": start, "end": end})
                    cuts = [0, *(x for s in spans for x in (s["start"], s["end"])), len(data)]
                    yield i, len(data), spans, b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2]))

            yield from to_batches(cut(), schema, weigh=3)

    out = T.StructType([
        T.StructField("given", df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType()),
    ])
    return joined.transform(in_batches, run, out).withColumnRenamed("given", id_col)
