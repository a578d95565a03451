"""Near copies by SimHash and MinHash bands, judged by exact shingle similarity.

A text's set is the XXH64 values of its shingles (``shingle`` words, as in
``simhash``).  Two texts are near copies if their sets' Jaccard similarity is
``num / den`` or more, which is judged on the sets themselves; the groups are
the connected components.  Two ways bring candidates together:

SimHash: fingerprints of the same shingles' hashes, which operator 3's pigeonhole
blocks link at ``distance`` or fewer differing bits.  They reach texts that are
almost the same.  At similarity 0.8 fingerprints of 64 bits differ in up to
some 17, and pigeonhole blocks for that distance have three bits.

Bands: a pair shares a band of ``rows`` least hashes with probability
J ** rows, so one of similarity 0.8 misses all of ``bands`` with probability
(1 - 0.8 ** 4) ** 24 = 3e-6, and none is cut afterwards.

1. texts of the same set are one class; classes meet by their fingerprints,
   and in the buckets of a band;
2. linked fingerprints' classes are compared, and every member of a bucket with
   the least of it, a linear number of pairs;
3. only buckets whose members are not yet in one component hold pairs that
   could still add a link: their members are all compared across components,
   by pairs of tiles.

Edge cases: null and blank texts have the empty set, and are copies of each
other; fewer words than a shingle are one shingle; rows without an id link
others, but are never dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches, materialize
from ._text import mix, pieces
from .components import components
from .simhash import SALTS, SimHash, of_hashes, shingle_hashes
from .simhash import links as linked_fingerprints


@dataclass(frozen=True)
class NearCopies:
    shingle: int = 5
    num: int = 4
    den: int = 5
    rows: int = 4
    bands: int = 24
    distance: int = 4
    seed: int = 42
    tile: int = 256


def shingle_set(text: bytes | None, spec: NearCopies) -> np.ndarray:
    return np.unique(shingle_hashes(text or b"", spec.shingle, spec.seed))


def set_hash(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))


def band_keys(own: np.ndarray, spec: NearCopies) -> np.ndarray:
    """A key for each band: a hash of the least values under its `rows` permutations."""
    if not len(own):
        return np.zeros(0, np.int64)
    odd = np.random.default_rng(spec.seed).integers(0, 2**64, (2, spec.bands * spec.rows), dtype=np.uint64) | np.uint64(1)
    least = np.full(odd.shape[1], 2**64 - 1, np.uint64)
    for at in range(0, len(own), 4096):
        least = np.minimum(least, (own[None, at : at + 4096] * odd[0][:, None]).min(1))
    both = (mix(least) * odd[1]).reshape(spec.bands, spec.rows).sum(1, dtype=np.uint64)
    return mix(both + np.arange(spec.bands, dtype=np.uint64)).view(np.int64)


def alike(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, spec: NearCopies) -> np.ndarray | bool:
    """Whether sets of sizes a and b with so many common members are similar enough, in whole numbers."""
    return common * spec.den >= (a + b - common) * spec.num


def signatures(docs: DataFrame, spec: NearCopies, id_col: str, text: str) -> DataFrame:
    """(id, h, fp, keys) of every document: the hash of its set, its fingerprint as a signed long, and its bands' keys."""
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text"):
                hashes = [shingle_hashes(x or b"", spec.shingle, spec.seed) for x in part.column(1).cast(pa.large_binary()).to_pylist()]
                own = [np.unique(h) for h in hashes]
                prints = np.array([of_hashes(h) for h in hashes], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_hash(s) for s in own], pa.int64()), pa.array(prints), pa.array([band_keys(s, spec) for s in own], pa.list_(pa.int64()))], names=["id", "h", "fp", "keys"])

    return src.mapInArrow(run, T.StructType([src.schema["id"], T.StructField("h", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]))


def by_fingerprint(prints: DataFrame, spec: NearCopies) -> DataFrame:
    """Pairs (a, b) of classes, a < b, that span the groups of fingerprints within `distance`, from (h, fp); a class has several where shingles repeat."""
    held = materialize(prints.select("fp", "h").distinct(), "fingerprints")
    roots = materialize(held.groupBy("fp").agg(F.min("h").alias("root")), "roots")
    same = held.join(roots, "fp").where("h <> root").select(F.col("root").alias("a"), F.col("h").alias("b"))
    near = linked_fingerprints(roots.select("fp"), SimHash(spec.shingle, spec.distance, seed=spec.seed))
    for side in ("a", "b"):
        near = near.join(roots.select(F.col("fp").alias(side), F.col("root").alias(f"{side}_root")), side)
    near = near.where("a_root <> b_root").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
    return materialize(same.union(near).distinct(), "by_fingerprint")


def sets_of(docs: DataFrame, wanted: DataFrame, spec: NearCopies, id_col: str, text: str) -> DataFrame:
    """(h, shingles) of the classes `wanted`, which has (h, least)."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("__text"))
    src = src.join(wanted, F.col("id").eqNullSafe(F.col("least"))).select("h", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text"):
                got = [(h, shingle_set(x, spec)) for h, x in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist(), strict=True)]
                got = [(h, s.tobytes()) for h, s in got if set_hash(s) == h]  # an id may repeat with other texts
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in got], pa.int64()), pa.array([s for _, s in got], pa.binary())], names=["h", "shingles"])

    return src.mapInArrow(run, "h long, shingles binary").dropDuplicates(["h"])


def compared(candidates: DataFrame, sets: DataFrame, spec: NearCopies) -> DataFrame:
    """The pairs (a, b) of candidates that are near copies."""
    half = materialize(candidates.join(sets.select(F.col("h").alias("b"), F.col("shingles").alias("y")), "b"), "halves")
    # read from files, this join stands alone, and adaptive execution may split the rows of a common a
    met = half.join(sets.select(F.col("h").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if alike(min(len(x), len(y)), len(x), len(y), spec):
                    good[k] = alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), spec)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    return materialize(met.mapInArrow(run, "a long, b long"), "links")


def spanning(hs: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], spec: NearCopies) -> list[tuple[int, int]]:
    """Links that join the components `comps` of the members `hs`, all of which are compared with each other."""
    size = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(len(sets)), size)
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    post, ends = doc[np.argsort(word, kind="stable")], np.cumsum(np.bincount(word))
    at = np.concatenate([[0], np.cumsum(size)])
    group = np.unique(comps, return_inverse=True)[1]
    out = []
    for i in range(len(sets)):
        if (group == group[0]).all():
            break
        own = word[at[i] : at[i + 1]]
        n = np.diff(ends, prepend=0)[own]
        places = np.arange(n.sum()) + np.repeat(ends[own] - np.cumsum(n), n)
        common = np.bincount(post[places], minlength=len(sets))
        for j in np.flatnonzero(alike(common, size[i], size, spec) & (group != group[i])):
            if group[j] != group[i]:
                out.append((int(hs[i]), int(hs[j])))
                group[group == group[j]] = group[i]
    return out


def across(open_members: DataFrame, sets: DataFrame, spec: NearCopies) -> DataFrame:
    """Links between components inside of buckets; open_members has (key, n, h, c), c being the component."""
    tiles = F.ceil(F.col("n") / spec.tile).cast("int")
    met = open_members.withColumn("t", F.pmod(F.xxhash64("h", F.lit(7)), tiles.cast("long")).cast("int"))
    # in a bucket of several tiles, tile t takes part in the pairs (t, x) and (x, t)
    met = met.select("key", "t", "h", "c", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("x"))
    met = met.select("key", F.least("t", "x").alias("i"), F.greatest("t", "x").alias("j"), "h", "c").join(sets, "h")
    met = met.select("key", "i", "j", "h", "c", "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[int, int, bytes]] = []  # one group, at most two tiles
        last = None

        def done() -> pa.RecordBatch:
            out = spanning(np.array([k[0] for k in kept]), np.array([k[1] for k in kept]), [np.frombuffer(k[2], np.uint64) for k in kept], spec) if kept else []
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for key, i, j, *rest in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (key, i, j) != last:
                    yield done()
                    kept, last = [], (key, i, j)
                kept.append(tuple(rest))
        yield done()

    return materialize(met.mapInArrow(run, "a long, b long"), "links")


def links(classes: DataFrame, near: DataFrame, docs: DataFrame, spec: NearCopies, id_col: str, text: str) -> DataFrame:
    """(node, component) of the classes (h, least, keys) that have a near copy; near has the pairs that fingerprints link."""
    keyed = classes.select("h", F.explode("keys").alias("key"))
    buckets = materialize(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("root")).where("n > 1"), "buckets")
    members = materialize(keyed.join(buckets, "key").select("key", "n", "root", "h"), "bucketed")
    met = members.select("h").union(near.select(F.explode(F.array("a", "b"))))
    wanted = met.distinct().join(classes.select("h", "least"), "h")
    sets = materialize(sets_of(docs, wanted, spec, id_col, text), "sets")
    first = compared(near.union(members.where("h <> root").select(F.col("root").alias("a"), F.col("h").alias("b"))).distinct(), sets, spec)
    groups = components(first)
    placed = members.where("n > 2").join(groups.withColumnRenamed("node", "h"), "h", "left").select("key", "n", "h", F.coalesce("component", "h").alias("c"))
    placed = materialize(placed, "placed")
    # the same members may meet in several buckets: one of those is enough
    judged = placed.groupBy("key", "n").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.bit_xor(F.xxhash64("h")).alias("who")).where("lo < hi")
    left = materialize(judged.groupBy("n", "lo", "hi", "who").agg(F.min("key").alias("key")).select("key"), "open")
    if left.isEmpty():
        return groups
    return components(first.union(across(placed.join(left, "key"), sets, spec)))


def near_copies(docs: DataFrame, spec: NearCopies = NearCopies(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its id and ``component_id``, the least id of its near copies, and of theirs."""
    prints = materialize(signatures(docs, spec, id_col, text), "signatures")
    classes = materialize(prints.groupBy("h").agg(F.min("id").alias("least"), F.first("keys").alias("keys")), "classes")
    groups = links(classes, by_fingerprint(prints, spec), docs, spec, id_col, text)
    # a component may be large, so its id is dealt out under several salts
    found = materialize(groups.join(classes, F.col("node") == F.col("h")).select("h", "component", "least"), "members")
    least = found.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int"))
    named = salted.join(least, ["component", "salt"]).select("h", "component_id")
    named = materialize(classes.join(named, "h", "left").select("h", F.coalesce("component_id", "least").alias("component_id")), "named")
    return prints.select("id", "h").join(named, "h").select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, spec: NearCopies = NearCopies(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those whose component has a smaller id."""
    dropped = near_copies(docs, spec, id_col, text).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__id"))
    return docs.join(dropped, F.col(f"`{id_col}`") == F.col("__id"), "left_anti")
