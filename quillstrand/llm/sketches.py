"""Fingerprints of documents: threshold-scaled sketches of their shingles.

A text is lower-cased (A-Z) and cut into words and shingles of ``shingle``
words (fewer words: the whole sequence).  Of the shingles' 64-bit hashes a
sketch keeps every one below a fixed fraction of the range, each once; a text
that has none there keeps its least hash.  The threshold is the same for all
texts, so a sketch grows with its text, sketches of parts merge into that of
the whole by union, and the share of a sketch that another one has estimates
how much of a text the other contains, however unequal the two are.

The likeness of two sketches is the containment of the smaller in the larger
one.  Equal sketches have likeness one, and a sketch that is empty (no words)
is like nothing but itself.  Least hashes outside of the range only tell equal
from different: they are compared when both sketches have nothing else.

``judged`` compares a document with the one that follows it by descending id,
and with an edited text of which that one gives half.  Texts move once: they
are dealt out by ranges of their order, the ranges' ends are known before that
from ids alone, and the first text of each range also goes to the range before.
A task goes through its texts in order and holds two of them.

Edge cases: a null text is empty; very long texts are sketched whole; bytes that are not
UTF-8 count as U+FFFD; rows with the same id follow each other by a hash of
their texts, and rows without an id come last; an only document is followed by
itself; an empty table gives an empty result; other columns are not passed on,
so theirs may have any names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches, materialize
from ._text import Texts, mix, pieces, strings

#: Seed of the shingles' hashes.
SEED = np.uint64(0x5EED)
#: At most so many ranges, of the two-level list that a row is placed by: 128 times 128.
FANOUT = 128
LEAST_ID = -(1 << 63)


@dataclass(frozen=True)
class Sketch:
    shingle: int = 5
    #: a sketch keeps one in so many hashes
    scale: int = 8
    #: bytes of text in a range, while there are fewer than 16,384 of them
    range_bytes: int = 4 << 20

    @property
    def most(self) -> int:
        """The greatest hash that is kept."""
        return (1 << 64) // self.scale - 1


def hashes(texts: Texts, spec: Sketch) -> tuple[np.ndarray, np.ndarray]:
    """Every shingle's hash, and where those of each text begin, with their number at the end."""
    words = texts.word_hash
    n = np.where(texts.n_words == 0, 0, np.maximum(texts.n_words - spec.shingle + 1, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    start = np.arange(at[-1]) - np.repeat(at[:-1] - texts.word_at[:-1], n)
    last = np.repeat(texts.word_at[1:], n)
    out = np.full(len(start), SEED)
    for k in range(spec.shingle):
        if texts.n_words.size and texts.n_words.min() >= spec.shingle:
            out = mix(out ^ words[start + k])
        else:
            have = start + k < last
            out[have] = mix(out[have] ^ words[start[have] + k])
    return out, at


def sketched(column: pa.Array, spec: Sketch) -> list[np.ndarray]:
    """The sketch of each text: hashes in order, as big-endian bytes say them."""
    texts = Texts(pc.ascii_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    every, at = hashes(texts, spec)
    kept = every <= np.uint64(spec.most)
    cut = np.concatenate([[0], np.cumsum(kept)])[at]
    few, out = every[kept], []
    for i in range(texts.n):
        own = few[cut[i] : cut[i + 1]]
        if not len(own) and at[i] < at[i + 1]:
            own = every[at[i] : at[i + 1]].min(keepdims=True)
        out.append(np.unique(own))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of the smaller sketch in the larger one."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    fewer = min(len(a), len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / fewer if fewer else 0.0


def written(sketch: np.ndarray) -> str:
    """16 hex digits a hash."""
    return sketch.astype(">u8").tobytes().hex()


def sketch_rows(docs: DataFrame, spec: Sketch = Sketch(), id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, hash): a row for each hash of a sketch, as a signed long."""
    bound_batches(docs.sparkSession)
    names = [id_col, *(keep or [])]
    src = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text"):
                got = sketched(part.column(len(names)), spec)
                own = pa.array(np.repeat(np.arange(len(got)), [len(s) for s in got]))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(own) for i in range(len(names))), pa.array(np.concatenate([np.zeros(0, np.uint64), *got]).view(np.int64))], names=[*names, "hash"])

    return src.mapInArrow(run, T.StructType([*(src.schema[c] for c in names), T.StructField("hash", T.LongType())]))


def merged(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, hash): the sketch of each group's texts together; hashes that were kept only for want of others drop out where others are."""
    return rows.select(*by, "hash").distinct()


def contained(rows: DataFrame, id_col: str, groups: DataFrame, group: str, spec: Sketch = Sketch()) -> DataFrame:
    """(id, group, share): the share of each text's sketch that a group's merged sketch has, where it has any."""
    # hashes are unsigned: signed ones under zero are beyond any threshold but that of scale 1
    scaled = F.col("hash").between(0, spec.most) if spec.scale > 1 else F.lit(True)
    own = rows.where(scaled).select(id_col, "hash").distinct()
    size = own.groupBy(id_col).agg(F.count("*").alias("__size"))
    met = own.join(groups.where(scaled).select(group, "hash"), "hash").groupBy(id_col, group).agg(F.count("*").alias("__n"))
    return met.join(size, id_col).select(id_col, group, (F.col("__n") / F.col("__size")).alias("share"))


def _place(bounds: list[tuple[int, int]], key: Column) -> Column:
    """How many of the ascending `bounds` are at or under `key`, less one: two short searches instead of a long one."""
    groups = [bounds[i : i + FANOUT] for i in range(0, len(bounds), FANOUT)]
    pair = "struct<id:long,h:long>"
    say = lambda b: {"id": b[0], "h": b[1]}
    tops = F.from_json(F.lit(json.dumps([say(g[0]) for g in groups])), f"array<{pair}>")
    within = F.from_json(F.lit(json.dumps([[say(b) for b in g] for g in groups])), f"array<array<{pair}>>")
    under = lambda b: b <= key
    i = F.greatest(F.size(F.filter(tops, under)) - 1, F.lit(0))
    return i * FANOUT + F.greatest(F.size(F.filter(F.get(within, i), under)) - 1, F.lit(0))


def ranges(keys: DataFrame, spec: Sketch) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Least and greatest key of every range, ascending: at most 16,384 of them."""
    total = keys.agg(F.sum("bytes").alias("b")).first()["b"]
    n = int(min(FANOUT * FANOUT, max(1, (total or 0) // spec.range_bytes)))
    dealt = keys.select("key.*").repartitionByRange(n, "id", "h").withColumn("part", F.spark_partition_id())
    ends = dealt.groupBy("part").agg(F.min(F.struct("id", "h")).alias("low"), F.max(F.struct("id", "h")).alias("high")).collect()
    return sorted((tuple(r["low"]), tuple(r["high"])) for r in ends)


def judged(docs: DataFrame, spec: Sketch = Sketch(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``."""
    spark = docs.sparkSession
    bound_batches(spark)
    key = F.struct(F.coalesce(F.col("id"), F.lit(LEAST_ID).cast("long")).alias("id"), F.xxhash64("__text").alias("h"))
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    keys = materialize(src.select(key.alias("key"), F.octet_length("__text").cast("long").alias("bytes")), "keys")
    ends = ranges(keys, spec)
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not ends:
        return spark.createDataFrame([], schema.replace("id long", f"`{id_col}` long", 1))
    lows, highs = [low for low, _ in ends], [high for _, high in ends]
    placed = src.withColumn("key", key).withColumn("part", _place(lows, F.col("key")))
    # in descending order a range is followed by the one under it, and the last by the first
    first = F.col("key") == F.get(F.from_json(F.lit(json.dumps([{"id": i, "h": h} for i, h in highs])), "array<struct<id:long,h:long>>"), F.col("part"))
    above = F.pmod(F.col("part") + 1, F.lit(len(ends)))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("guest"))
    guest = F.struct(above.alias("part"), F.lit(1).alias("guest"))
    rows = placed.select(F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))).alias("to"), "id", "key", "__text").select("to.part", "to.guest", "key", "id", "__text")
    dealt = rows.repartition(max(len(ends), 2), "part").sortWithinPartitions("part", "guest", F.desc("key"), "__text")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # part, guest, id, text, sketch of the row before
        for batch in batches:
            for part in pieces(batch, "__text"):
                parts, guests, ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), strings(part.column(4))
                prints = sketched(pa.array(texts, pa.large_string()), spec)
                pairs = []
                for row in zip(parts, guests, ids, texts, prints, strict=True):
                    if last is not None and last[0] == row[0] and not last[1]:
                        pairs.append((last, row))
                    last = row
                n_chars = [len(a[3]) for a, _ in pairs]
                edited = [a[3][: n - n // 2] + b[3][: n // 2] for n, (a, b) in zip(n_chars, pairs, strict=True)]
                theirs = sketched(pa.array(edited, pa.large_string()), spec)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[2] for a, _ in pairs], pa.int64()),
                        pa.array(n_chars, pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                        pa.array([written(a[4]) for a, _ in pairs], pa.string()),
                        pa.array([written(e) for e in theirs], pa.string()),
                        pa.array([likeness(a[4], e) for (a, _), e in zip(pairs, theirs, strict=True)], pa.float64()),
                        pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
                    ],
                    names=names,
                )

    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)
