"""Near-duplicates by SimHash and pigeonhole blocks.

A text is lower-cased (A-Z), cut into words and shingles of ``shingle`` words
(repeats included; fewer words: the whole sequence), and bit i of its 64-bit
fingerprint is set if more than half of the shingles' XXH64 values have it.
Fingerprints link if ``distance`` or fewer bits differ.

Blocks: the 64 bits are split into ``distance + extra`` blocks.  Two linked
fingerprints differ in at most ``distance`` of them, so they agree in ``extra``
at least, and each choice of ``extra`` blocks is a join key.  Different
fingerprints (copies are joined beforehand) meet in the buckets of a key, are
compared there, and each bucket returns links that span its groups, not all
pairs.  A bucket of more than ``tile`` fingerprints is cut into tiles, and
every pair of tiles is a group of its own, so no task holds more than two
tiles however large a group of near copies is, and no link is lost.  ``extra``
follows the number of different fingerprints (``blocks_for``), so that keys
get longer and chance meetings in a bucket stay few as tables grow.

Edge cases: null and blank texts have no words and the fingerprint zero, which
links like any other; very long texts are hashed whole, 65,536 shingles at a
time; repeated ids get a row each, each with the class of its own text; rows
whose id is null get a row, and a class of such rows alone has a null id; an
empty table gives an empty result; other columns are not passed on, so theirs
may have any names (``keep_one`` keeps them all); bytes that are not UTF-8
are hashed as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches, materialize
from ._text import pieces
from .components import components

SALTS = 16


@dataclass(frozen=True)
class SimHash:
    shingle: int = 4
    distance: int = 4
    #: blocks of a key; None: as many as the number of fingerprints asks for
    extra: int | None = None
    seed: int = 42
    tile: int = 8192


def shingle_hashes(text: bytes, size: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle, in order."""
    words = text.lower().split()  # bytes: A-Z only, and the six white-space bytes only
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(flat, seed)], np.uint64)
    cuts = np.flatnonzero(np.frombuffer(flat, np.uint8) == 0x20)
    starts = [0, *(cuts[: len(words) - size] + 1).tolist()]
    ends = [*cuts[size - 1 :].tolist(), len(flat)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64)


def fingerprint(text: bytes, spec: SimHash = SimHash()) -> int:
    return of_hashes(shingle_hashes(text, spec.shingle, spec.seed))


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes."""
    n, ones = len(h), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, spec: SimHash, id_col: str, text: str) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text"):
                got = [fingerprint(x or b"", spec) for x in part.column(1).cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(got, np.uint64).view(np.int64))], names=["id", "fp"])

    return src.mapInArrow(run, T.StructType([src.schema["id"], T.StructField("fp", T.LongType())]))


def blocks_for(n: int, distance: int) -> int:
    """How many blocks a key takes: the fewest whose bits would put under 64 of n random fingerprints into a bucket, but at most four."""
    return next((e for e in (1, 2, 3) if 64 * e // (distance + e) >= n.bit_length() - 6), 4)


def block_keys(distance: int, extra: int) -> list[int]:
    """Bit masks of the join keys: each choice of `extra` blocks."""
    n = distance + extra
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [sum(c) for c in combinations(blocks, extra)]


def span(fps: np.ndarray, distance: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the groups of `fps` within `distance`: (fingerprint, least of its group).

    Breadth-first from the least fingerprint not yet reached; each fingerprint
    is compared once with those not yet reached.
    """
    fps = np.unique(fps.view(np.uint64))
    left, a, b = fps, [], []
    while len(left) > 1:
        root, front, left, found = left[0], left[:1], left[1:], []
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            step = max(1, (rows << 12) // len(left))
            for at in range(0, len(front), step):
                hit |= (np.bitwise_count(front[at : at + step, None] ^ left[None, :]) <= distance).any(0)
            front, left = left[hit], left[~hit]
            found.append(front)
        if found and len(group := np.concatenate(found)):
            a.append(group)
            b.append(np.full(len(group), root))
    none = np.zeros(0, np.uint64)
    return np.concatenate(a or [none]).view(np.int64), np.concatenate(b or [none]).view(np.int64)


def links(fps: DataFrame, spec: SimHash) -> DataFrame:
    """Spanning links (a, b) between different fingerprints (column fp, each once)."""
    extra = blocks_for(fps.count(), spec.distance) if spec.extra is None else spec.extra
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in block_keys(spec.distance, extra)]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("which", "key"))
    sizes = keyed.groupBy("which", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    # most buckets hold two fingerprints that agree there by chance: no need to gather those
    pairs = sizes.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= spec.distance).select("a", "b")
    met = keyed.join(sizes.where("n > 2").select("which", "key", "n"), ["which", "key"])
    tiles = F.ceil(F.col("n") / spec.tile).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), tiles.cast("long")).cast("int")
    # in a bucket of several tiles, tile t takes part in the pairs (t, x) and (x, t)
    met = met.withColumn("t", mine).select("which", "key", "t", "fp", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("x"))
    met = met.select("which", "key", F.least("t", "x").alias("i"), F.greatest("t", "x").alias("j"), "fp")
    met = met.repartition("which", "key", "i", "j").sortWithinPartitions("which", "key", "i", "j")
    distance = spec.distance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []  # the group that a batch's end may have cut, at most two tiles
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            change = np.zeros(batch.num_rows, bool)
            for c in cols[:4]:
                change[1:] |= c[1:] != c[:-1]
            change[0] = last is not None and tuple(c[0] for c in cols[:4]) != last
            cuts = np.flatnonzero(change)
            out = []
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if kept and change[a]:
                    out.append(span(np.concatenate(kept), distance))
                    kept = []
                kept.append(cols[4][a:b].copy())
            last = tuple(c[-1] for c in cols[:4])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *[o[k] for o in out]])) for k in (0, 1)], names=["a", "b"])
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in span(np.concatenate(kept), distance)], names=["a", "b"])

    return pairs.union(met.mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, spec: SimHash = SimHash(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its id, ``fingerprint`` (16 hex digits) and ``component_id`` (least id reachable)."""
    prints = materialize(fingerprints(docs, spec, id_col, text), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    groups = components(links(classes.select("fp"), spec))
    # linked fingerprints get the least document id of their component; a component may be large,
    # so its id is dealt out under several salts
    members = materialize(groups.join(classes, F.col("node") == F.col("fp")).select("fp", "component", "least"), "members")
    least = members.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    named = salted.join(least, ["component", "salt"]).select("fp", "component_id")
    # read from files, the last join stands alone, and adaptive execution may split the rows of a common fingerprint
    named = materialize(classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, spec: SimHash = SimHash(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those whose component has a smaller id."""
    dropped = near_duplicates(docs, spec, id_col, text).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__id"))
    return docs.join(dropped, F.col(f"`{id_col}`") == F.col("__id"), "left_anti")
