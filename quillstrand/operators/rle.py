"""Run-length coding in the order of a key, and the segment codec built on it."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .delta import first_difference, prefix_sum
from .scan import lagged, running_sum

#: Rows that one task makes of a long run at most.
PART = 1 << 16


def encode(df: DataFrame, key: str, value: str, most: int | None = None) -> DataFrame:
    """(run, value, start, length) of maximal runs of the numeric key's order; `most` cuts longer runs.

    start is the key of the run's first row.
    """
    marked = lagged(df.select(key, value), key, {"__before": F.col(value), "__any": F.lit(True)})
    new = F.col("__any").isNull() | ~F.col(value).eqNullSafe(F.col("__before"))
    runs = running_sum(marked.withColumn("__new", new.cast("long")), key, {"run": F.col("__new")})
    out = runs.groupBy((F.col("run") - 1).alias("run"), value).agg(F.min(key).alias("start"), F.count("*").alias("length"))
    if most is None:
        return out.select("run", value, "start", "length")
    # keys of a run are taken as dense here, as they number the rows
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / most))
    cut = out.select("run", value, "start", "length", F.explode(parts).alias("part"))
    return cut.select("run", "part", value, (F.col("start") + F.col("part") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("length") - F.col("part") * most).alias("length"))


def decode(runs: DataFrame, value: str, key: str = "start") -> DataFrame:
    """(key, value) rows; long runs are cut into parts first, so that they spread over tasks."""
    parts = runs.select(value, key, "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / PART))).alias("part")).repartition(key, "part")
    n = F.least(F.lit(PART).cast("long"), F.col("length") - F.col("part") * PART)
    base = F.col(key) + F.col("part") * PART
    return parts.select(F.explode(F.sequence(base, base + n - 1)).alias(key), value)


def unpack(blob: bytes) -> tuple[list[int], list[int]]:
    """Keys and lengths of [n][n one-byte keys][n 32-bit lengths]; too short a value is empty."""
    if len(blob) < 4 or len(blob) < 4 + 5 * (n := struct.unpack_from("<I", blob)[0]):
        return [], []
    return list(blob[4 : 4 + n]), list(struct.unpack_from(f"<{n}I", blob, 4 + n))


def pack(keys: list[int], lengths: list[int]) -> bytes:
    return struct.pack("<I", len(keys)) + bytes(keys) + struct.pack(f"<{len(keys)}I", *lengths)


def unpacked(df: DataFrame, blob: str, keys: list[str]) -> DataFrame:
    """keys with the packed runs' nth, key and length."""
    src = df.select(*keys, blob)
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keys) + ", nth int, key int, length long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, out = [], []
            for i, x in enumerate(b.column(len(keys)).to_pylist()):
                for n, (k, m) in enumerate(zip(*unpack(x or b""), strict=True)):
                    row.append(i)
                    out.append((n, k, m))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(row, pa.int64())) for i in range(len(keys))), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=[*keys, "nth", "key", "length"])

    return src.mapInArrow(run, schema)


def numeric_codec(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row on coding a numeric column by differences and runs: n, runs, coded and raw bytes, whether runs are used, bytes."""
    runs = encode(first_difference(df.select(key, value), key, value), key, "delta")
    n = df.agg(F.count("*").alias("n"))
    sizes = runs.agg(F.count("*").alias("runs")).crossJoin(n)  # two one-row tables
    coded, raw = 4 + 8 * F.col("runs"), 4 * F.col("n")
    return sizes.select("n", "runs", coded.alias("coded_bytes"), raw.alias("raw_bytes"), (coded <= raw).alias("use_runs"), F.when(coded <= raw, coded).otherwise(raw).alias("bytes"))


def numeric_encode(df: DataFrame, key: str, value: str) -> DataFrame:
    """Runs of differences, which numeric_decode restores."""
    return encode(first_difference(df.select(key, value), key, value), key, "delta")


def numeric_decode(runs: DataFrame, key: str, value: str) -> DataFrame:
    rows = decode(runs, "delta").withColumnRenamed("start", key)
    return prefix_sum(rows, key, "delta", value).select(key, value)
