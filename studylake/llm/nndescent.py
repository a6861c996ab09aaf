"""Operator 5: near-duplicate vectors by NN-descent.

Equal vectors fall together first. A neighbour graph starts from blocks of vectors on the same side of random planes
and is refined: at each vector its neighbours are compared with each other, and who finds a closer one takes it into
its list. What comes out above the threshold joins vectors to groups, before lists are trimmed. Lists hold few
neighbours, so each is then enlarged to the whole group it lies in: the members of a group are compared with each other,
block by block, and only counts leave the blocks. So a link is lost only if its ends fall into different groups; an
audit against brute force measures how many do, and rounds with new planes follow until it finds none and a round joins
nothing more. If they don't come to that, all vectors are compared once, block by block, for links between groups.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, rows_of, written
from .components import components

log = logging.getLogger(__name__)

#: Length of the neighbour lists, and how many of those that list a vector join it in a comparison.
NEIGHBOURS, REVERSE = 5, 3
#: Sets of planes in a round, vectors in a block of the start, refinements at most, and the share of links gained to stop at.
TABLES, BLOCK, REFINEMENTS, CHANGED = 4, 256, 5, 0.002
#: Vectors that the audit compares with all others (once out of all, once out of those with links), and the rounds of new
#: planes it may ask for; if links are still missing then, all vectors are compared, block by block.
AUDITED, ROUNDS = 256, 6
#: Single precision decides what is worth an exact look, with this slack.
SLACK = 1e-4


def _unit(vector) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it has no direction."""
    if vector is None or not len(vector) or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0:
        return None
    v = v / top
    return v / math.sqrt(float(v @ v))


def nodes_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, digest and unit (binary doubles) of the vectors that can link; the others are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, vector in rows_of([batch]):
                unit = _unit(vector)
                if unit is not None and i is not None:
                    out.append((i, xxhash.xxh3_128_digest(np.asarray(vector, np.float64).tobytes()), unit.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())], names=["id", "digest", "unit"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).transform(in_batches, run, "id long, digest binary, unit binary")


def _edges(a, b, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.asarray(sim, np.float64))], names=["a", "b", "sim"])


_EDGES = "a long, b long, sim double"


def _forest(near: np.ndarray) -> tuple[list[int], list[int]]:
    """Ends of edges that join what a symmetric matrix of links joins: one less for each component than it has members."""
    root = list(range(len(near)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    a, b = [], []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))):
        x, y = find(i), find(j)
        if x != y:
            root[x] = y
            a.append(i)
            b.append(j)
    return a, b


def _start(nodes: DataFrame, bits: int, seed: int, threshold: float) -> DataFrame:
    """Edges to the closest vectors of the same block, and those that join the groups in it. A block holds neighbours in the order of plane codes, so that a
    code which many vectors share is spread over blocks and tasks."""

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            by_size: dict[int, list] = {}
            for i, single in rows_of([batch]):
                by_size.setdefault(len(single) // 4, []).append((i, single))
            for size, rows in by_size.items():
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((size, TABLES * bits))
                matrix = np.frombuffer(b"".join(u for _, u in rows), np.float32).reshape(-1, size)
                signs = (matrix @ planes[size] > 0).reshape(len(rows), TABLES, bits)
                codes = (signs * (1 << np.arange(bits))).sum(2)
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t * 100_000 + size] * len(rows), pa.int64()), pa.array(codes[:, t].astype(np.int64)), pa.array([i for i, _ in rows], pa.int64()), pa.array([u for _, u in rows], pa.binary())],
                        names=["part", "code", "id", "single"],
                    )

    def closest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(rows):
            ids = np.array([r[2] for r in rows])
            matrix = np.frombuffer(b"".join(r[3] for r in rows), np.float32).reshape(len(rows), -1)
            sims = matrix @ matrix.T
            np.fill_diagonal(sims, -2)
            k = min(NEIGHBOURS, len(rows) - 1)
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            i, j = _forest(sims >= threshold - SLACK)
            return _edges(
                np.concatenate([np.repeat(ids, k), ids[i]]), np.concatenate([ids[best].ravel(), ids[j]]),
                np.concatenate([np.take_along_axis(sims, best, 1).ravel(), sims[i, j]]),
            )

        held: list[tuple] = []
        for row in rows_of(batches):
            # codes may meet in a block, as neighbours in the order; parts may not
            if held and (len(held) >= BLOCK or held[-1][0] != row[0]):
                if len(held) > 1:
                    yield edges(held)
                held = []
            held.append(row)
        if len(held) > 1:
            yield edges(held)

    rows = nodes.select("id", "single").transform(in_batches, coded, "part long, code long, id long, single binary")
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.withColumn("salt", F.xxhash64("id")).repartitionByRange(parts, "part", "code", "salt").sortWithinPartitions("part", "code", "salt")
    return ordered.select("part", "code", "id", "single").transform(in_batches, closest, _EDGES)


def _best(edges: DataFrame) -> DataFrame:
    """The NEIGHBOURS closest of each list. A list holds what a bounded number of comparisons found."""
    line = Window.partitionBy("a").orderBy(F.col("sim").desc(), "b")
    return edges.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("k", F.row_number().over(line)).where(f"k <= {NEIGHBOURS}").drop("k")


def _refined(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges closer than the last of a list, found by comparing the neighbours of each vector with each other."""
    last = graph.groupBy("a").agg(F.when(F.count(F.lit(1)) >= NEIGHBOURS, F.min("sim")).otherwise(F.lit(-2.0)).alias("last"))
    vectors = nodes.join(last, nodes["id"] == last["a"], "left").select("id", "single", F.coalesce("last", F.lit(-2.0)).alias("last"))
    pick = Window.partitionBy("b").orderBy(F.xxhash64("a"))
    backward = graph.withColumn("k", F.row_number().over(pick)).where(f"k <= {REVERSE}").select(F.col("b").alias("center"), F.col("a").alias("id"))
    near = graph.select(F.col("a").alias("center"), F.col("b").alias("id")).unionByName(backward).unionByName(graph.select(F.col("a").alias("center"), F.col("a").alias("id"))).distinct()
    groups = near.join(vectors, "id").groupBy("center").agg(F.collect_list(F.struct("id", "single", "last")).alias("near"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sim = [], [], []
            for (near,) in rows_of([batch]):
                ids = np.array([n["id"] for n in near])
                last = np.array([n["last"] for n in near])
                if len({len(n["single"]) for n in near}) > 1:
                    continue
                matrix = np.frombuffer(b"".join(n["single"] for n in near), np.float32).reshape(len(near), -1)
                sims = matrix @ matrix.T
                np.fill_diagonal(sims, -3)
                i, j = np.nonzero(sims > last[:, None])
                a.append(ids[i])
                b.append(ids[j])
                sim.append(sims[i, j])
            if a:
                yield _edges(np.concatenate(a), np.concatenate(b), np.concatenate(sim))

    return groups.select("near").transform(in_batches, compare, _EDGES)


def _exact(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs a < b whose cosine reaches the threshold in double precision."""
    near = edges.where(F.col("sim") >= threshold - SLACK).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    left, right = nodes.select(F.col("id").alias("a"), F.col("unit").alias("u")), nodes.select(F.col("id").alias("b"), F.col("unit").alias("v"))

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(a, b, s) for a, b, u, v in rows_of([batch]) if (s := float(np.frombuffer(u) @ np.frombuffer(v))) >= threshold]
            if found:
                yield _edges(*zip(*found))

    return near.join(left, "a").join(right, "b").select("a", "b", "u", "v").transform(in_batches, check, _EDGES)


def _audit(nodes: DataFrame, linked: DataFrame, threshold: float, seed: int) -> DataFrame:
    """All links of the audited vectors, taken by the hash of their ids: AUDITED of all and AUDITED of those in `linked`
    (node). Each is compared with every vector."""
    place = F.xxhash64(F.lit(seed), F.col("id"))
    of_all = nodes.select("id", "unit").orderBy(place).limit(AUDITED)
    of_linked = nodes.join(linked.select(F.col("node").alias("id")), "id", "left_semi").select("id", "unit").orderBy(place).limit(AUDITED)
    asked = of_all.unionByName(of_linked).distinct().collect()
    by_size: dict[int, list] = {}
    for row in asked:
        by_size.setdefault(len(row["unit"]), []).append((row["id"], bytes(row["unit"])))
    queries = {size: (np.array([i for i, _ in rows]), np.frombuffer(b"".join(u for _, u in rows)).reshape(len(rows), -1)) for size, rows in by_size.items()}

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[int, list] = {}
            for i, unit in rows_of([batch]):
                rows.setdefault(len(unit), []).append((i, unit))
            for size, held in rows.items():
                if size in queries:
                    ids, matrix = queries[size]
                    own = np.array([i for i, _ in held])
                    sims = np.frombuffer(b"".join(u for _, u in held)).reshape(len(held), -1) @ matrix.T
                    i, j = np.nonzero((sims >= threshold) & (own[:, None] != ids[None, :]))
                    yield _edges(own[i], ids[j], sims[i, j])

    return nodes.select("id", "unit").transform(in_batches, compare, _EDGES).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _with_single(nodes: DataFrame) -> DataFrame:
    """The nodes and `single`, their vectors in single precision, which is what travels to comparisons."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            single = [np.frombuffer(u, np.float64).astype(np.float32).tobytes() for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(single, pa.binary())], names=["id", "unit", "single"])

    return nodes.transform(in_batches, run, "id long, unit binary, single binary")


def _recall(truth: DataFrame, group: DataFrame) -> float:
    """The share of links whose ends are in one group, all of whose pairs are compared; 1 if there is no link."""
    a, b = (group.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    row = truth.join(a, "a", "left").join(b, "b", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ca") == F.col("cb")).alias("found")).first()
    return row["found"] / row["n"] if row["n"] else 1.0


def _group_links(members: DataFrame, threshold: float) -> DataFrame:
    """id, links: near-duplicates of each of (component, size, id, mult, unit) in its component, weighted by mult.

    A component is cut into blocks of about BLOCK members; each pair of blocks is one small comparison, so that a
    component of any size is spread over tasks. Only sums leave them.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = members.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    sent = own.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "mult", "unit")
    ordered = sent.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums(rows):
            low, high = rows[0][1], rows[0][2]
            side = np.array([r[3] for r in rows])
            ids, mult = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
            matrix = np.frombuffer(b"".join(r[6] for r in rows)).reshape(len(rows), -1)
            a, b = np.flatnonzero(side == low), np.flatnonzero(side == high)
            near = (matrix[a] @ matrix[b].T >= threshold) & (ids[a][:, None] != ids[b][None, :])
            out = [(ids[a], near @ mult[b])] + ([(ids[b], near.T @ mult[a])] if low != high else [])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([y for _, y in out]).astype(np.int64))], names=["id", "links"])

        held: list[tuple] = []
        for row in rows_of(batches):
            if held and held[-1][:3] != row[:3]:
                yield sums(held)
                held = []
            held.append(row)
        if held:
            yield sums(held)

    return ordered.select("component", "low", "high", "block", "id", "mult", "unit").transform(in_batches, run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _missing_joins(nodes: DataFrame, group: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of groups, by their least ids, that a link between their vectors joins. Every pair of blocks of about
    BLOCK vectors is one small comparison, and gives each pair of groups once, however many links join them."""
    known = group.select(F.col("node").alias("id"), "component")
    rows = nodes.select("id", "unit").join(known, "id", "left").withColumn("component", F.coalesce("component", "id")).withColumn("length", F.octet_length("unit"))
    blocks = rows.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = rows.join(blocks, "length").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = own.select("length", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "component", "unit")
    ordered = sent.repartition("length", "low", "high").sortWithinPartitions("length", "low", "high")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joins(held):
            side, component = np.array([r[3] for r in held]), np.array([r[4] for r in held])
            matrix = np.frombuffer(b"".join(r[5] for r in held)).reshape(len(held), -1)
            a, b = np.flatnonzero(side == held[0][1]), np.flatnonzero(side == held[0][2])
            near = (matrix[a] @ matrix[b].T >= threshold) & (component[a][:, None] != component[b][None, :])
            i, j = np.nonzero(near)
            ends = np.sort(np.stack([component[a][i], component[b][j]], axis=1), axis=1)
            return np.unique(ends, axis=0)

        def batch(held):
            ends = joins(held)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0], pa.int64()), pa.array(ends[:, 1], pa.int64())], names=["a", "b"])

        held: list[tuple] = []
        for row in rows_of(batches):
            if held and held[-1][:3] != row[:3]:
                yield batch(held)
                held = []
            held.append(row)
        if held:
            yield batch(held)

    return ordered.transform(in_batches, run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, seed: int = 5) -> DataFrame:
    """Near-duplicate links by cosine. Returns one row for each row: `id_col`, n_links (other rows linked directly),
    component_id (the least id reachable by links).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different length. Rows that repeat an id and a vector count as vectors of their own; of an id with several vectors the
    one whose bytes have the least digest counts, and all its rows show that one's result. Rows with a null id are
    returned alone. An empty table gives no rows. Ids have to be whole numbers.
    """
    rows = written(nodes_of(df, id_col, vector_col), "nn-rows")
    # an id with several vectors goes by the one of the least digest
    several = written(rows.groupBy("id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least < most").select("id", "least"), "nn-several")
    if not several.isEmpty():
        rows = written(rows.join(several, "id", "left").where("least is null or digest = least").drop("least"), "nn-rows")
    classes = written(rows.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("mult"), F.min("unit").alias("unit")), "nn-nodes")
    nodes = written(_with_single(classes.select("id", "unit")), "nn-units")
    n = nodes.count()
    group = None
    if n > 1:
        bits = max(2, round(math.log2(max(n / 16, 4))))
        graph = links = None
        joined = 0
        for turn in range(ROUNDS):
            start = written(_start(nodes, bits, seed + turn, threshold), "nn-start")
            graph = written(_best(start if graph is None else start.unionByName(graph)), "nn-graph")
            met = start.where(F.col("sim") >= threshold - SLACK)
            held = graph.where(F.col("sim") >= threshold - SLACK).count()
            for _ in range(REFINEMENTS):
                new = written(_refined(graph, nodes), "nn-new")
                met = met.unionByName(new.where(F.col("sim") >= threshold - SLACK))
                graph = written(_best(graph.unionByName(new)), "nn-graph")
                # refined while the lists still gain links; closer neighbours below the threshold don't matter
                before, held = held, graph.where(F.col("sim") >= threshold - SLACK).count()
                if held - before <= CHANGED * before:
                    break
            found = _exact(met, nodes, threshold).select("a", "b")
            links = written(found if links is None else found.unionByName(links).distinct(), "nn-links")
            group = written(components(links), "nn-components")
            recall = _recall(_audit(nodes, group, threshold, seed + turn), group)
            log.info("NN-descent: round %d, recall %.4f, %d vectors in groups", turn, recall, group.count())
            # nodes less components: how many joins there were
            now = group.agg(F.count_if(F.col("node") != F.col("component"))).first()[0]
            if recall == 1 and now == joined:
                break
            joined = now
        else:
            # the rest exactly: pairs of groups that a link joins, out of all pairs
            log.warning("NN-descent: after %d rounds the audit finds %.4f of the links; all vectors are compared", ROUNDS, recall)
            links = written(_missing_joins(nodes, group, threshold).unionByName(links).distinct(), "nn-links")
            group = written(components(links), "nn-components")
    if group is None:
        n_links = rows.sparkSession.createDataFrame([], "id long, links long")
        group = rows.sparkSession.createDataFrame([], "node long, component long")
    else:
        sizes = group.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        members = group.join(sizes, "component").join(classes.select("id", "mult", "unit"), F.col("node") == F.col("id")).select("component", "size", "id", "mult", "unit")
        n_links = written(_group_links(members, threshold), "nn-counts")
    own = classes.groupBy("digest").agg(F.first("id").alias("rep"), F.sum("mult").alias("mult"))
    linked = (
        rows.select("id", "digest").join(own, "digest").join(n_links.withColumnRenamed("id", "rep"), "rep", "left")
        .join(group.withColumnRenamed("node", "rep"), "rep", "left")
        .groupBy("id", "digest").agg(F.first(F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.first(F.coalesce("component", "rep")).alias("component_id"))
    )
    given = df.select(F.col(id_col), F.col(id_col).cast("long").alias("__id"))
    per_id = linked.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return given.join(per_id, given["__id"] == per_id["id"], "left").select(F.col(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "__id").alias("component_id"))
