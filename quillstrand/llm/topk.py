"""Exact top-k by inner product, with MaxScore.

A vector's components are made integers and seen as the weights of its terms,
the dimensions.  Candidates are held in shards, term by term, with the largest
and smallest weight of every term.  Against a query, a term's contribution
lies between two bounds; what it adds over the lower one is its gain, and a
candidate's score is the sum of all lower bounds and its gains.  Per query and
shard, terms go in order of their largest gain.  Non-essential are the last
ones, as many as can be while all their gains together stay under the
threshold (the k-th best score so far, less the lower bounds): a candidate
that gains nothing by the essential terms cannot be among the best.  The
essential terms' postings are summed for the whole shard, and the others are
probed one by one, only for candidates that are still competitive.  The first
candidates of a shard are scored outright where no threshold is known.  The
shards' best are merged.

The query set meets all rows in blocks: shards are dealt out once, every block
of queries is sent to each deal, and the shards of a deal meet the blocks there.

Scores are exact whatever the components: products and sums are made in
doubles while they are whole numbers that those hold, in 64 bits while they
fit, and in Python's integers beyond.  A score that is no long raises an error.

Edge cases: vectors that are null, or hold nulls, NaN or infinities take no
part, nor do rows without an id; a vector of any length does, a shorter one as
if filled with zeros; rows with the same id all take part, except against a
query of that id, and of queries with the same id the least vector counts; ties
go to the smaller id; with k or fewer candidates all are returned; an empty
table gives an empty result; other columns are not passed on, so theirs may
have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches, materialize

#: Whole numbers up to here are exact in doubles.
EXACT = 1 << 53


@dataclass(frozen=True)
class TopK:
    k: int = 5
    scale: int = 256
    shard: int = 8192
    queries: int = 2048


def integers(vectors: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of the vectors that take part, as doubles, which hold such numbers exactly."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # floor() would give longs, which are too short for large components; past 2**53 doubles are whole anyway
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    whole = F.transform(v, lambda x: F.when(F.abs(scaled(x)) < float(EXACT), F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    return vectors.where(v.isNotNull() & finite & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("v"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Shards of at most `size` rows: their ids, vectors end to end, and the vectors' lengths, as binary."""
    schema = "ids binary, data binary, lengths binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                v = part.column(1)
                lengths = np.diff(v.offsets.to_numpy()).astype("<i4")
                flat = v.flatten().to_numpy(zero_copy_only=False).astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (part.column(0).to_numpy().astype("<i8"), flat, lengths)], names=["ids", "data", "lengths"])

    return rows.mapInArrow(run, schema)


def unpacked(ids: bytes, data: bytes, lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    """ids, and a dense matrix of doubles filled up with zeros."""
    n = np.frombuffer(lengths, "<i4")
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = np.frombuffer(data, "<f8")
    return np.frombuffer(ids, "<i8"), out


def exact(matrix: np.ndarray, bound: float) -> np.ndarray:
    """The matrix in numbers whose products and sums are exact if none passes `bound`."""
    if bound < EXACT:
        return matrix
    if bound < 2.0**62:
        return matrix.astype(np.int64)
    out = np.empty(matrix.shape, object)
    out.ravel()[:] = [int(x) for x in matrix.ravel()]
    return out


def split_at(gains: np.ndarray, slack) -> int:
    """The first non-essential term: the gains from there on (they come in falling order) sum to less than `slack`."""
    tail = np.append(np.cumsum(gains[::-1])[::-1], 0)
    return int(np.argmax(tail < slack)) if slack > 0 else len(gains)


class Shard:
    """Candidates by term, with the terms' bounds."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.terms = ids[order], np.ascontiguousarray(matrix[order].T)
        self.most = float(np.abs(matrix).max(initial=0))
        self.kinds: dict = {}

    def _in(self, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms with their largest and smallest weights, in numbers that are exact up to `bound`."""
        kind = 0 if bound < EXACT else 1 if bound < 2.0**62 else 2
        if kind not in self.kinds:
            terms = exact(self.terms, bound)
            self.kinds[kind] = terms, terms.max(1), terms.min(1)
        return self.kinds[kind]

    def best(self, own: int, query: np.ndarray, k: int, threshold: int | None) -> tuple[list[int], np.ndarray]:
        """Scores and ids of this shard's k best that can still reach `threshold`."""
        d = min(len(query), len(self.terms))
        alive = np.flatnonzero(self.ids != own)
        if not d or not len(alive):
            return [0] * len(alive[:k]), self.ids[alive[:k]]
        bound = (d + 1) * float(np.abs(query).max(initial=0)) * max(self.most, 1.0) * 2
        terms, high, low = self._in(bound)
        q = exact(query[None, :d], bound)[0]
        use = np.flatnonzero(q)
        q = q[use]
        up, down = q * high[use], q * low[use]
        upper, lower = np.maximum(up, down), np.minimum(up, down)
        order = np.argsort(lower - upper, kind="stable")
        use, q, upper, lower = use[order], q[order], upper[order], lower[order]
        rest = np.append(np.cumsum(upper[::-1])[::-1], 0)  # what the terms from i on can add at most
        if threshold is None and len(alive) > 4 * k:
            some = q @ terms[np.ix_(use, alive[: 4 * k])]
            threshold = np.sort(some)[-k]
        if threshold is not None and rest[0] < threshold:
            return [], self.ids[:0]
        split = len(q) if threshold is None else split_at(upper - lower, threshold - lower.sum())
        part = (q[:split] @ terms[use[:split]])[alive] if split else np.zeros(len(alive), terms.dtype)
        for i in range(split, len(use)):
            still = part + rest[i] >= threshold
            if not still.all():
                alive, part = alive[still], part[still]
            if not len(alive):
                break
            part = part + q[i] * terms[use[i], alive]
        if threshold is not None:
            still = part >= threshold
            alive, part = alive[still], part[still]
        if len(part) > k:  # all that reach the k-th best, ties included
            still = part >= np.sort(part)[-k]
            alive, part = alive[still], part[still]
        top = np.lexsort((self.ids[alive], -part))[:k] if part.dtype != object else np.array(sorted(range(len(part)), key=lambda i: (-part[i], self.ids[alive[i]]))[:k], np.int64)
        return [int(x) for x in part[top]], self.ids[alive[top]]


def top_k(vectors: DataFrame, is_query: Column, spec: TopK = TopK(), id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's best rows; is_query picks the queries among the rows."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = integers(vectors, id_col, vector, spec.scale)
    queries = integers(vectors.where(is_query), id_col, vector, spec.scale).groupBy("id").agg(F.min("v").alias("v"))
    blocks = materialize(packed(queries, spec.queries).select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("lengths").alias("q_lengths")), "queries")
    # shards are dealt out once; each deal gets all blocks of queries.  There are as many deals as shards,
    # up to four for each core: more would only send the blocks more often
    shards = materialize(packed(rows, spec.shard), "shards")
    deals = max(1, min(shards.count(), 4 * spark.sparkContext.defaultParallelism))
    shards = shards.withColumn("deal", F.pmod(F.xxhash64("ids"), F.lit(deals)))
    blocks = blocks.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
    met = shards.join(blocks, "deal").select("ids", "data", "lengths", "q_ids", "q_data", "q_lengths")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "score", "vec_id")])
    k = spec.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thresholds: dict[int, int] = {}  # the k-th best that this task has met, by query
        last, shard = None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != last:
                    last, shard = row[:3], Shard(*unpacked(*row[:3]))
                q_ids, q = unpacked(*row[3:])
                out = []
                for own, query in zip(q_ids.tolist(), q, strict=True):
                    score, ids = shard.best(own, query, k, thresholds.get(own))
                    if len(score) == k:
                        thresholds[own] = max(thresholds.get(own, score[-1]), score[-1])
                    out.append((np.full(len(ids), own), score, ids))
                owner, ids = (np.concatenate([o[i] for o in out]) for i in (0, 2))
                # a score that is no long cannot be returned, and raises here
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array([s for o in out for s in o[1]], pa.int64()), pa.array(ids)], names=schema.names)

    best = met.mapInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id"), "score")
