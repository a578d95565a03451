"""Feedback prediction over a whole array: tiles by anti-diagonals.

Each value is predicted from restored neighbours, across tiles too, so a tile
can be worked on when those before it along each axis are done.  Tiles whose
numbers add up to the same are independent: they are a step, and there are as
many steps as the sum of the tiles' numbers along the axes.  Tiles grow with the array, up to
half a million cells, so that steps stay few; a narrow array still has a step for each of these,
as nothing else in it is independent.  A step's result is written to the
shared folder; of it, the next steps read only what touches them: a face, an edge or a corner
of restored values for each tile.  A task holds as many tiles as have some million
cells, and goes through them in step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, scratch_path
from .delta import AXES
from .feedback import CELLS, run_blocks
from .groups import whole_groups

#: Least sides of a tile by number of dimensions, the most cells that one grows to, and steps that are few enough.
SIDES, MOST, FEW = {1: (1 << 14,), 2: (64, 128), 3: (32, 16, 16)}, 1 << 19, 8
#: A tile, or what one gives to another: numbers along three axes, the step, what it is (-1: a tile; else axes that it
#: comes over, as bits), cells along three axes, and values, codes and restored values.
ROWS = "a long, b long, c long, step long, kind int, na int, nb int, nc int, v binary, code binary, restored binary"
NAMES = [f.split()[0] for f in ROWS.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=NAMES)


def sides_for(shape: tuple[int, ...]) -> tuple[int, ...]:
    """Sides of the tiles of an array: the axis of most tiles gets longer ones until steps are few or tiles large."""
    sides = [min(s, 1 << (n - 1).bit_length()) for s, n in zip(SIDES[len(shape)], shape, strict=True)]
    while True:
        tiles = [-(-n // s) for n, s in zip(shape, sides, strict=True)]
        if sum(tiles) - len(tiles) + 1 <= FEW or 2 * int(np.prod(sides)) > MOST:
            return tuple(sides)
        sides[tiles.index(max(tiles))] *= 2


def packed(df: DataFrame, value: str, code: str | None, dims: int, sides: tuple[int, ...]) -> DataFrame:
    """A row for each tile."""
    axes = AXES[:dims]
    tiles = [F.floor(F.col(a) / n).alias(f"t{a}") for a, n in zip(axes, sides, strict=True)]
    src = df.select(*tiles, *[F.col(a).cast("long").alias(a) for a in axes], F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"), (F.col(code) if code else F.lit(0)).cast("long").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, group in whole_groups(batches, dims, CELLS):
            first = np.flatnonzero(np.diff(group, prepend=-1))
            local = [p % n for p, n in zip(cols[dims : 2 * dims], sides, strict=True)]
            v, c = np.zeros((len(first), *sides)), np.zeros((len(first), *sides), "<i8")
            v[(group, *local)], c[(group, *local)] = cols[2 * dims], cols[2 * dims + 1]
            size = [np.maximum.reduceat(p, first) + 1 for p in local]
            out = []
            for k, i in enumerate(first.tolist()):
                t = [int(x[i]) for x in cols[:dims]]
                out.append((*t, *[0] * (3 - dims), sum(t), -1, *(int(s[k]) for s in size), *[1] * (3 - dims), v[k].tobytes(), c[k].tobytes() if code else None, None))
            yield _rows(out)

    names = [f"t{a}" for a in axes]
    tiles = src.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, ROWS)
    path = scratch_path(df.sparkSession, "tiles")
    tiles.write.partitionBy("step").parquet(path)
    return df.sparkSession.read.schema(ROWS).parquet(path).select(*NAMES)


def _step(tiles: DataFrame, dims: int, sides: tuple[int, ...], eb: float, radius: int) -> DataFrame:
    """Tiles with codes and restored values, and what they give to others, from tiles and what they were given."""

    def done(rows: list[list[tuple]]) -> pa.RecordBatch:
        v = np.stack([np.frombuffer(r[0][8]).reshape(sides) for r in rows])
        codes = np.stack([np.frombuffer(r[0][9], "<i8").reshape(sides) for r in rows]) if rows[0][0][9] is not None else None
        pad = np.zeros((*(n + 1 for n in sides), len(rows)))
        for k, r in enumerate(rows):
            for given in r[1:]:
                over = [given[4] >> i & 1 for i in range(dims)]
                pad[(*(0 if o else slice(1, None) for o in over), k)] = np.frombuffer(given[10]).reshape([n for n, o in zip(sides, over, strict=True) if not o])
        made, out = run_blocks(v, eb, radius, codes, pad)
        result = []
        for k, r in enumerate(rows):
            own = r[0]
            result.append((*own[:8], own[8], made[k].astype("<i8").tobytes(), out[k].tobytes()))
            for mask in range(1, 1 << dims):
                over = [mask >> i & 1 for i in range(dims)]
                part = np.ascontiguousarray(out[k][tuple(-1 if o else slice(None) for o in over)])
                to = [own[i] + over[i] for i in range(dims)]
                result.append((*to, *[0] * (3 - dims), own[3] + sum(over), mask, 0, 0, 0, None, None, part.tobytes()))
        return _rows(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = []
        most = max(1, CELLS // int(np.prod(sides)))
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[4] == -1:
                    if len(held) == most:
                        yield done(held)
                        held = []
                    held.append([row])
                elif held and held[-1][0][:3] == row[:3]:  # beyond the array's end there is no tile to take it
                    held[-1].append(row)
        if held:
            yield done(held)

    return tiles.repartition("a", "b", "c").sortWithinPartitions("a", "b", "c", "kind").mapInArrow(run, ROWS)


def _whole(df: DataFrame, value: str, code: str | None, dims: int, eb: float, radius: int, sides: tuple[int, ...] | None) -> DataFrame:
    spark, axes = df.sparkSession, AXES[:dims]
    bound_batches(spark)  # a tile has megabytes
    if sides is None:
        ends = df.agg(*[F.max(a) for a in axes]).first()
        sides = SIDES[dims] if ends[0] is None else sides_for(tuple(int(n) + 1 for n in ends))
    tiles = packed(df, value, code, dims, sides)
    last = tiles.agg(F.max("step").alias("n")).first()["n"]
    base = scratch_path(spark, "wavefront")
    read = lambda *paths: spark.read.schema(ROWS).option("basePath", base).parquet(*paths).select(*NAMES)
    for step in range(0 if last is None else last + 1):
        now = tiles.where(F.col("step") == step)
        if step:
            now = now.unionByName(read(*(f"{base}/at={k}" for k in range(max(0, step - dims), step))).where((F.col("kind") > 0) & (F.col("step") == step)))
        _step(now, dims, sides, eb, radius).write.partitionBy("kind").parquet(f"{base}/at={step}")
    names = [*axes, "code", "outlier", "restored"]
    schema = ", ".join(f"{a} long" for a in axes) + ", code long, outlier double, restored double"
    if last is None:
        return spark.createDataFrame([], schema)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                inside = tuple(slice(0, n) for n in row[5 : 5 + dims])
                v, c, r = (np.frombuffer(x, t).reshape(sides)[inside].ravel() for x, t in zip(row[8:], ("<f8", "<i8", "<f8"), strict=True))
                place = np.meshgrid(*(np.arange(n) + t * s for n, t, s in zip(row[5 : 5 + dims], row[:dims], sides, strict=True)), indexing="ij")
                yield pa.RecordBatch.from_arrays([*(pa.array(p.ravel()) for p in place), pa.array(c), pa.array(v, mask=c != 0), pa.array(r)], names=names)

    return read(base).where("kind = -1").mapInArrow(cells, schema)


def compressed(df: DataFrame, value: str, dims: int, eb: float, radius: int = 512, sides: tuple[int, ...] | None = None) -> DataFrame:
    """(place, code, outlier, restored) of a dense array that begins at 0 on all axes."""
    return _whole(df, value, None, dims, eb, radius, sides)


def decompressed(coded: DataFrame, dims: int, eb: float, radius: int = 512, sides: tuple[int, ...] | None = None) -> DataFrame:
    """(place, ..., restored) from codes and outliers."""
    return _whole(coded, "outlier", "code", dims, eb, radius, sides)


def serial(values: np.ndarray, eb: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and restored values of a whole array in one piece."""
    made, out = run_blocks(values[None], eb, radius)
    return made[0], out[0]
