"""Lloyd's k-means on whole numbers, with kd-tree filtering.

A vector's components become floor(scale * x).  Every task cuts its vectors into
blocks and builds a kd-tree over each: all nodes of a level split at the median
of their widest component, and each holds its count, its exact sum and its box.
The trees are written once to the shared folder, and every round reads them.

A round takes a tree from its root, a level at a time.  Of the centroids that a
node still has, the one nearest to the middle of its box is its champion; a
centroid that is strictly farther than the champion from every point of the box
(judged at the box's corner nearest to it) is pruned.  A node with one centroid
left is assigned whole, by its count and sum; the others pass what they have
left on to their children, and the vectors of undecided leaves are compared
with what their leaf has left.  Only strictly dominated centroids go, so ties
still fall to the smaller number.  Counts and sums are added up per task and
then by Spark; the driver sees k * (dims + 1) sums a round, whatever the table's size.

All of it is exact: doubles while they hold every number that occurs, then 64
bits, then Python's integers; sums travel in limbs of 31 bits.  A distance or
an inertia that is no long raises an error.

Edge cases: vectors that are null, have another number of components, or hold
nulls, NaN or infinities take no part; a component that is infinite when scaled
raises an error; with k vectors or fewer each is a centroid; repeated rows and
rows with the same id are vectors like any other, and of equal hashes the
lesser vector becomes a centroid first; rows without an id take part, but
become centroids only after all others; a cluster that loses all its vectors
keeps its centroid; an empty table gives an empty result; other columns are not
passed on, so theirs may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, materialize
from .topk import EXACT, exact

LIMB = 31
#: Components under this have sums in one limb.
PLAIN = 1 << LIMB
BLOCKS = "ids array<long>, width string, data binary, limbs int, lows binary, highs binary, sums binary"


@dataclass(frozen=True)
class Centroids:
    k: int = 8
    dims: int = 64
    scale: int = 1024
    rounds: int = 10
    seed: str = "3:"
    block: int = 8192
    leaf: int = 32


def cuts(n: int, leaf: int) -> list[np.ndarray]:
    """Where the nodes of each level begin, with n at the end; the last level has leaves of at most `leaf` rows."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > leaf:
        at = levels[-1]
        levels.append(np.insert(at, np.arange(1, len(at)), (at[:-1] + at[1:]) // 2))
    return levels


def limbs_of(x: np.ndarray) -> np.ndarray:
    """(limbs, ...) of whole numbers held as doubles, lowest first; the highest has the sign."""
    if np.abs(x).max(initial=0) < PLAIN:
        return x.astype(np.int64)[None]
    whole, out = exact(x, np.inf), []
    while any(v >= PLAIN or v < -PLAIN for v in whole.ravel()):
        out.append((whole & (PLAIN - 1)).astype(np.int64))
        whole = whole >> LIMB
    return np.stack([*out, whole.astype(np.int64)])


def narrow(x: np.ndarray) -> str:
    """The narrowest type that holds these whole numbers."""
    most = np.abs(x).max(initial=0)
    return "<i2" if most < 1 << 15 else "<i4" if most < PLAIN else "<f8"


class Tree:
    """A block in the order of its kd-tree's leaves, with box, sum and count of every node."""

    def __init__(self, data: np.ndarray, leaf: int, lows=None, highs=None, sums=None) -> None:
        self.data, self.levels = data, cuts(len(data), leaf)
        self.lows, self.highs, self.sums = lows, highs, sums

    @classmethod
    def built(cls, data: np.ndarray, leaf: int) -> tuple[Tree, np.ndarray]:
        """The tree, and the order of the rows in it."""
        order = np.arange(len(data))
        levels = cuts(len(data), leaf)
        for above, below in zip(levels[:-1], levels[1:], strict=True):
            for i, (a, b) in enumerate(zip(above[:-1], above[1:], strict=True)):
                part = data[order[a:b]]
                widest = int(np.argmax(part.max(0) - part.min(0)))
                order[a:b] = order[a:b][np.argpartition(part[:, widest], below[2 * i + 1] - a)]
        out = cls(data[order], leaf)
        at = levels[-1][:-1]
        lows, highs, sums = [np.minimum.reduceat(out.data, at)], [np.maximum.reduceat(out.data, at)], [np.add.reduceat(limbs_of(out.data), at, axis=1)]
        while len(lows[0]) > 1:
            lows.insert(0, np.minimum(lows[0][::2], lows[0][1::2]))
            highs.insert(0, np.maximum(highs[0][::2], highs[0][1::2]))
            sums.insert(0, sums[0][:, ::2] + sums[0][:, 1::2])
        out.lows, out.highs, out.sums = np.concatenate(lows), np.concatenate(highs), np.concatenate(sums, axis=1)
        return out, order

    def filtered(self, z: np.ndarray, bound: float) -> tuple[list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
        """Nodes that go whole to a centroid (first row, end, number in the tree, centroid), the rows of undecided leaves and their centroids."""
        zz = (z * z).sum(1)
        nodes, left, first = np.zeros(1, np.int64), np.ones((1, len(z)), bool), 0
        whole = []
        for at in self.levels:
            low, high = exact(self.lows[first + nodes], bound), exact(self.highs[first + nodes], bound)
            far = zz[None] - (low + high) @ z.T
            far = np.where(left, far, far.max() + 1)
            champion = np.argmin(far, 1)
            for c in np.unique(champion).tolist():
                own = np.flatnonzero(champion == c)
                u = z - z[c]
                most = high[own] @ np.maximum(u, 0).T + low[own] @ np.minimum(u, 0).T
                left[own] &= ~((zz - zz[c])[None] - 2 * most > 0)
            single = left.sum(1) == 1
            for i, c in zip(nodes[single].tolist(), np.argmax(left[single], 1).tolist(), strict=True):
                whole.append((int(at[i]), int(at[i + 1]), first + i, c))
            nodes, left = nodes[~single], left[~single]
            if not len(nodes):
                return whole, np.zeros(0, np.int64), np.zeros(0, np.int64)
            if at is not self.levels[-1]:
                first += len(at) - 1
                nodes, left = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(left, 2, 0)
        size = at[nodes + 1] - at[nodes]
        rows = np.repeat(at[nodes] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        left = np.repeat(left, size, 0)
        some = np.flatnonzero(left.any(0))
        far = zz[some][None] - 2 * (exact(self.data[rows], bound) @ z[some].T)
        return whole, rows, some[np.argmin(np.where(left[:, some], far, far.max() + 1), 1)]


def bound_of(data: np.ndarray, z: list[list[int]]) -> float:
    """No number in the comparison of these vectors and centroids passes this."""
    most = max(float(np.abs(data).max(initial=0)), float(max(abs(v) for row in z for v in row)), 1.0)
    return 16.0 * data.shape[1] * most * most


def numbers(z: list[list[int]], bound: float) -> np.ndarray:
    return np.array(z, np.float64 if bound < EXACT else np.int64 if bound < 2.0**62 else object)


def vectors_of(rows: DataFrame, spec: Centroids, id_col: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part, v as doubles."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(v.isNotNull() & (F.size(v) == spec.dims) & finite).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    out = np.floor(x * float(scale))
    if not np.isfinite(out).all():
        raise ValueError("a component is too large to be scaled")
    return out


def trees(rows: DataFrame, spec: Centroids) -> DataFrame:
    """A row for each block: its ids and vectors in the tree's order, and the nodes' boxes and sums."""

    def block(ids: pa.Array, data: np.ndarray) -> pa.RecordBatch:
        tree, order = Tree.built(data, spec.leaf)
        width = narrow(data)
        blobs = [x.astype(width).tobytes() for x in (tree.data, tree.lows, tree.highs)]
        row = {"ids": [ids.take(pa.array(order)).to_pylist()], "width": [width], "data": blobs[:1], "limbs": [len(tree.sums)], "lows": blobs[1:2], "highs": blobs[2:], "sums": [tree.sums.astype("<i8").tobytes()]}
        kinds = {"ids": pa.list_(pa.int64()), "limbs": pa.int32(), "width": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in row.items()], names=list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data, n = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, spec.block):
                part = batch.slice(at, spec.block)
                ids.append(part.column(0))
                data.append(scaled(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, spec.dims), spec.scale))
                n += part.num_rows
                if n >= spec.block:
                    yield block(pa.concat_arrays(ids), np.concatenate(data))
                    ids, data, n = [], [], 0
        if n:
            yield block(pa.concat_arrays(ids), np.concatenate(data))

    return rows.mapInArrow(run, BLOCKS)


def loaded(batches: Iterator[pa.RecordBatch], spec: Centroids) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for i, row in enumerate(batch.select(["width", "data", "limbs", "lows", "highs", "sums"]).to_pylist()):
            data, lows, highs = (np.frombuffer(row[c], row["width"]).reshape(-1, spec.dims).astype(np.float64) for c in ("data", "lows", "highs"))
            sums = np.frombuffer(row["sums"], "<i8").reshape(row["limbs"], -1, spec.dims)
            yield batch.column(0).slice(i, 1).flatten(), Tree(data, spec.leaf, lows, highs, sums)


def moved(blocks: DataFrame, z: list[list[int]], spec: Centroids) -> list[list[int]]:
    """The centroids after one round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * len(z), [[0] * spec.dims for _ in z]

        def add(c: int, n: int, own: np.ndarray) -> None:
            counts[c] += n
            for limb in range(len(own)):
                sums[c] = [s + (v << LIMB * limb) for s, v in zip(sums[c], own[limb].tolist(), strict=True)]

        for _, tree in loaded(batches, spec):
            bound = bound_of(tree.data, z)
            whole, rows, labels = tree.filtered(numbers(z, bound), bound)
            for c in range(len(z)):
                own = np.array([node for _, _, node, w in whole if w == c], np.int64)
                if len(own):
                    add(c, sum(b - a for a, b, _, w in whole if w == c), tree.sums[:, own].sum(1))
                mine = rows[labels == c]
                if len(mine):
                    add(c, len(mine), limbs_of(tree.data[mine]).sum(1))
        out = []
        for c, (n, total) in enumerate(zip(counts, sums, strict=True)):
            for dim, s in enumerate([n, *total] if n else []):
                limb = 0
                while s >= PLAIN or s < -PLAIN:
                    out.append((c, dim, limb, s & (PLAIN - 1)))
                    s, limb = s >> LIMB, limb + 1
                out.append((c, dim, limb, s))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["cluster", "dim", "limb", "part"])

    parts = blocks.mapInArrow(run, "cluster long, dim long, limb long, part long")
    totals: dict[tuple[int, int], int] = {}
    for c, dim, limb, part in parts.groupBy("cluster", "dim", "limb").agg(F.sum("part").alias("part")).collect():  # k * (dims + 1) rows a limb
        totals[c, dim] = totals.get((c, dim), 0) + (part << LIMB * limb)
    return [[totals.get((c, 1 + d), 0) // totals[c, 0] for d in range(spec.dims)] if (c, 0) in totals else old for c, old in enumerate(z)]


def labelled(blocks: DataFrame, z: list[list[int]], spec: Centroids) -> DataFrame:
    """(id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in loaded(batches, spec):
            bound = bound_of(tree.data, z)
            centres = numbers(z, bound)
            whole, rows, labels = tree.filtered(centres, bound)
            cluster = np.zeros(len(tree.data), np.int64)
            cluster[rows] = labels
            for a, b, _, c in whole:
                cluster[a:b] = c
            gap = exact(tree.data, bound) - centres[cluster]
            # a distance that is no long cannot be returned, and raises here
            distance = pa.array([int(x) for x in (gap * gap).sum(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), distance], names=["id", "cluster", "distance"])

    return blocks.mapInArrow(run, "id long, cluster int, distance long")


def clusters(rows: DataFrame, spec: Centroids = Centroids(), id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per vector: its id, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256``."""
    spark = rows.sparkSession
    bound_batches(spark)
    taken = vectors_of(rows, spec, id_col, vector)
    first = taken.orderBy(F.sha2(F.concat(F.lit(spec.seed), F.col("id").cast("string")).cast("binary"), 256).asc_nulls_last(), "v").limit(spec.k).collect()
    z = [[int(v) for v in scaled(np.array(r["v"]), spec.scale)] for r in first]
    blocks = materialize(trees(taken, spec), "trees")
    if z:
        for _ in range(spec.rounds):
            z = moved(blocks, z, spec)
        out = materialize(labelled(blocks, z, spec), "labelled")
    else:
        out = spark.createDataFrame([], "id long, cluster int, distance long")
    inertia = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    facts = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, z[c])).encode()).hexdigest()) for c, s in inertia.items()]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(named), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
