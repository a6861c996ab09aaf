"""Operator 12: the prefix trie of conversations, by a skeleton of splitters.

A conversation is the path of its turns; a node is a distinct path that some conversation starts with. Paths go to shards
by range, between splitters. The conversations below a node lie in one shard unless the node's path is the start of a
splitter, so the trie of the splitters' paths, the skeleton, is broadcast: a sorted shard finishes every other node by
itself with a stack of open nodes, and hands in what it has gathered at the skeleton's nodes. These sums meet by node,
and the skeleton, whose size has a bound, is added up from its leaves to the root.

Paths hold 32 bytes a turn, the SHA-256 of role and text, so texts themselves are shuffled nowhere.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, rows_of, to_batches, written

#: Bytes of a turn in a path.
KEY = 32
#: Turns in a shard, about, and the most shards. A splitter keeps SPLIT_TURNS turns of a path, so the skeleton has at
#: most SHARDS x SPLIT_TURNS nodes and takes 8 MB to broadcast.
SHARD_TURNS, SHARDS, SPLIT_TURNS = 200_000, 4096, 64
#: Conversations sampled for each shard, about, to place the splitters; their places decide how even shards are, not what is found.
SAMPLED = 16
#: Bytes of a block of conversation ids on their way to their hash.
ID_BLOCK = 1 << 16
#: Sorts before every conversation id.
BEFORE = -(1 << 63) - 1

WORD = r"[^\x20\x09-\x0D]+"


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id (long), path (binary, KEY bytes a turn), words (array of int, the words of each turn's text).

    Turns go in the order of `turn_col`, null first; turns that tie go by role and then by the SHA-256 of role and text.
    Null roles and texts are empty ones; a row that repeats is a turn again; rows without a conversation id are left out.
    One row holds KEY bytes for each turn of its conversation, and never a text, however long the texts are.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.select("conv_id", F.struct("turn", "role", key.alias("key"), F.regexp_count("text", F.lit(WORD)).alias("words")).alias("t"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return gathered.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda t: t["key"]), "")).alias("path"), F.transform("t", lambda t: t["words"]).alias("words"))


def rebuilt(seqs: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % every (all of them if it has fewer, none
    if it isn't there), h = crc32 of c's decimals modulo `heads`. `seqs` is read twice, so it should be a written table."""
    most = heads - 1
    base = seqs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.expr(f"substring(path, 1, {most * KEY})").alias("first"), F.slice("words", 1, most).alias("first_words"))
    joined = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left")
    joined = joined.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int"))
    head, words = F.expr(f"coalesce(substring(first, 1, h * {KEY}), X'')"), F.expr("coalesce(slice(first_words, 1, h), array())")
    return joined.select("conv_id", F.concat(head, F.expr(f"substring(path, h * {KEY} + 1)")).alias("path"), F.concat(words, F.expr("slice(words, h + 1, greatest(size(words) - h, 0))")).alias("words"))


class Skeleton:
    """The trie of the splitters' paths: an index for each (parent's index, turn), the root being 0."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.index: dict[tuple[int, bytes], int] = {}
        self.parent = [-1]
        for path, _ in splitters:
            at = 0
            for i in range(0, len(path), KEY):
                step = at, path[i : i + KEY]
                if step not in self.index:
                    self.index[step] = len(self.parent)
                    self.parent.append(at)
                at = self.index[step]


def splitters_of(seqs: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most shards - 1 places (path, conversation id), from a sample by hash, that cut the table about evenly."""
    n = seqs.count()
    every = max(1, n // (SAMPLED * shards))
    cut = F.length("path") > SPLIT_TURNS * KEY
    sample = seqs.where(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0)
    # a path that is cut short stands before all that it starts
    sample = sample.select(F.expr(f"substring(path, 1, {SPLIT_TURNS * KEY})").alias("path"), F.when(~cut, F.col("conv_id")).alias("conv_id"))
    found = sorted((bytes(r["path"]), BEFORE if r["conv_id"] is None else r["conv_id"]) for r in sample.limit(4 * SAMPLED * shards).collect())
    return sorted({found[len(found) * k // shards] for k in range(1, shards)}) if found else []


class _Node:
    __slots__ = ("key", "place", "words", "conv_id", "n", "children", "leaves", "saved", "hash", "ids", "size", "blocks", "waiting")

    def __init__(self, key: bytes, place: int, words: int):
        self.key, self.place, self.words = key, place, words
        self.conv_id, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.hash, self.ids, self.size, self.blocks = None, [], 0, 0
        self.waiting = []  # children that ask for this node's conversation


_SCHEMA = pa.schema([
    ("kind", pa.int32()), ("place", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("words", pa.int64()), ("shard", pa.int64()), ("block", pa.int64()), ("ends", pa.string()),
])
_DDL = "kind int, place long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, shard long, block long, ends string"
#: Kinds of rows that shards return: a finished node; one that hangs at the skeleton's node `place`, whose conversation it
#: lacks; what a shard has gathered at the skeleton's node `place`; and a block of ids that end there.
DONE, HANGING, GATHERED, ENDS = range(4)


def _walk(skeleton: Skeleton):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        stack: list[_Node] = []
        now = None

        def close() -> Iterator[tuple]:
            node, depth = stack.pop(), len(stack)
            if node.place >= 0:
                if node.ids:
                    yield block(node)
                yield GATHERED, node.place, node.conv_id, depth, None, node.n, node.children, node.leaves, node.saved, node.words, now, None, None
            else:
                node.saved += (node.n - 1) * node.words
                node.leaves = node.leaves if node.children else 1
                for child in node.waiting:
                    yield DONE, None, *child[:2], node.conv_id, *child[2:]
                ends = (node.hash or hashlib.sha256()).hexdigest()
                row = node.conv_id, depth, node.n, node.children, node.leaves, node.saved, None, None, None, ends
            if not stack:
                return
            above = stack[-1]
            above.n += node.n
            above.conv_id = node.conv_id if above.conv_id is None else min(above.conv_id, node.conv_id)
            if node.place < 0:
                above.children += 1
                above.leaves += node.leaves
                above.saved += node.saved
                if above.place < 0:
                    above.waiting.append(row)
                else:
                    yield HANGING, above.place, *row[:2], None, *row[2:]

        def block(node: _Node) -> tuple:
            ids, node.ids, node.size = ",".join(node.ids), [], 0
            node.blocks += 1
            return ENDS, node.place, None, None, None, None, None, None, None, None, now, node.blocks, ids

        for shard, path, conv_id, words in rows_of(batches):
            if shard != now:
                while stack:
                    yield from close()
                now = shard
                stack.append(_Node(b"", 0, 0))
            depth = 0
            while depth + 1 < len(stack) and stack[depth + 1].key == path[depth * KEY : depth * KEY + KEY]:
                depth += 1
            while len(stack) > depth + 1:
                yield from close()
            for i in range(depth, len(path) // KEY):
                key, above = path[i * KEY : i * KEY + KEY], stack[-1].place
                stack.append(_Node(key, skeleton.index.get((above, key), -1) if above >= 0 else -1, words[i]))
            node, text = stack[-1], str(conv_id)
            node.n += 1
            node.conv_id = conv_id if node.conv_id is None else min(node.conv_id, conv_id)
            if node.place >= 0:
                node.ids.append(text)
                node.size += len(text) + 1
                if node.size >= ID_BLOCK:
                    yield block(node)
            elif node.hash is None:
                node.hash = hashlib.sha256(text.encode())
            else:
                node.hash.update(f",{text}".encode())
        while stack:
            yield from close()

    return lambda batches: to_batches(rows(batches), _SCHEMA, weigh=12)


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each run of rows with the same place, read in order and held nowhere."""
    schema = pa.schema([("place", pa.int64()), ("ends", pa.string())])

    def rows():
        now, state = None, None
        for place, ids in rows_of(batches):
            if place != now:
                if state is not None:
                    yield now, state.hexdigest()
                now, state = place, hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        if state is not None:
            yield now, state.hexdigest()

    yield from to_batches(rows(), schema)


def nodes(seqs: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of the trie of `seqs` (conv_id, path, words), a written table with each conversation once.

    Columns: conv_id (the smallest of the conversations that start with the node's path), depth, parent_conv_id (null at
    the root), n_convs, n_children, n_leaves (childless nodes below or at the node), saved_tokens (words of each node at
    or below, for every conversation but one that shares it), ends_sha256 (SHA-256 of the ids, ascending, of the
    conversations that are the node's path and nothing more; that of the empty string if there are none).

    Conversations without turns end at the root; equal ones share all their nodes. A table without conversations has no
    nodes, not even the root. Many equal conversations are split over shards by id unless they have over SPLIT_TURNS
    turns; then they stay in one shard, which streams them. A task holds the nodes of one path and their children's rows.
    Ids that end at a node of the skeleton are hashed by one task in blocks, as SHA-256 reads them in order.
    """
    spark = seqs.sparkSession
    if shards is None:
        turns = seqs.agg(F.sum(F.size("words") + 1)).first()[0] or 0
        shards = min(SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS)))
    splitters = splitters_of(seqs, shards)
    skeleton = Skeleton(splitters)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())
            shard = pa.array([bisect.bisect_right(splitters, k) for k in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([shard, *(batch.column(i) for i in (1, 0, 2))], names=["shard", "path", "conv_id", "words"])

    dealt = seqs.select("conv_id", "path", "words").transform(in_batches, place, "shard long, path binary, conv_id long, words array<int>")
    dealt = dealt.repartition(len(splitters) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    found = written(dealt.transform(in_batches, _walk(skeleton), _DDL), "trie-nodes")

    gathered = found.where(F.col("kind") == GATHERED).groupBy("place")
    gathered = gathered.agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("words").alias("words"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    at = {r["place"]: r.asDict() for r in gathered.collect()}
    ends = found.where(F.col("kind") == ENDS).select("place", "shard", "block", "ends").repartition("place").sortWithinPartitions("place", "shard", "block")
    ends = {r["place"]: r["ends"] for r in ends.select("place", "ends").transform(in_batches, _hashed, "place long, ends string").collect()}
    for i in sorted(at, key=lambda i: -at[i]["depth"]):
        node = at[i]
        node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
        node["n_leaves"] = node["n_leaves"] if node["n_children"] else 1
        above = at.get(skeleton.parent[i])
        if above:
            above["n_children"] += 1
            for c in ("n_leaves", "saved_tokens"):
                above[c] += node[c]
    none = hashlib.sha256().hexdigest()
    listed = [
        (i, n["conv_id"], n["depth"], at[skeleton.parent[i]]["conv_id"] if i else None, n["n_convs"], n["n_children"], n["n_leaves"], n["saved_tokens"], ends.get(i, none))
        for i, n in at.items()
    ]
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    bones = spark.createDataFrame(listed, "place long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    found = found.withColumnRenamed("ends", "ends_sha256")
    done = found.where(F.col("kind") == DONE).select(*names)
    parents = F.broadcast(bones.select("place", F.col("conv_id").alias("above")))
    hanging = found.where(F.col("kind") == HANGING).drop("parent_conv_id").join(parents, "place").withColumnRenamed("above", "parent_conv_id").select(*names)
    return done.unionByName(hanging).unionByName(bones.select(*names))
