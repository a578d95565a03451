"""Multi-level spline prediction of 3-D arrays.

Values at multiples of 8 on all axes are anchors and kept exactly.  In
steps of 4, 2 and 1 the values between are predicted along z, then y, then x
from those known so far: a cubic through four neighbours, a one-sided quadratic
where one is missing, a mean or a copy at the array's end.  What the prediction
misses is quantized; the bound is tighter on the coarse levels.  Blocks of
32 x 8 x 8 see one further plane on each side, so they are predicted alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dealt
from .groups import whole_groups

#: Sides of a block along x, y, z; tightening per level, and its floor.
BLOCK = (32, 8, 8)
ALPHA, BETA = 1.75, 3.0


def level_bound(eb: float, unit: int) -> float:
    """The bound on the level of that step."""
    return max(eb / ALPHA ** (unit.bit_length() - 1), eb / BETA)


def _predict(v: np.ndarray, axis: int, at: int, unit: int, size: int) -> np.ndarray:
    """Prediction of plane `at` along an axis of a block whose known length is `size`."""
    take = lambda k: v.take(k, axis)
    far, near = at - 3 * unit >= 0, at + 3 * unit < size
    if at + unit >= size:
        return take(at - unit)
    if far and near:
        return (-take(at - 3 * unit) + 9 * take(at - unit) + 9 * take(at + unit) - take(at + 3 * unit)) / 16
    if near:
        return (3 * take(at - unit) + 6 * take(at + unit) - take(at + 3 * unit)) / 8
    if far:
        return (-take(at - 3 * unit) + 6 * take(at - unit) + 3 * take(at + unit)) / 8
    return (take(at - unit) + take(at + unit)) / 2


def run_block(values: np.ndarray, codes: np.ndarray | None, eb: float, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, outliers (NaN: none) and restored values of a block [z, y, x, ...] with its further planes; what follows x counts blocks of one shape.

    With codes None they are made from the values; otherwise values hold the
    anchors, and the originals of outliers.
    """
    out = np.full(values.shape, np.nan)
    keep = tuple(slice(None, None, 8) for _ in range(3))
    out[keep] = values[keep]
    made = np.full(values.shape, radius, np.int64) if codes is None else codes
    outlier = np.full(values.shape, np.nan)
    done = [8, 8, 8]  # known steps along z, y, x
    for unit in (4, 2, 1):
        bound = level_bound(eb, unit)
        for axis in range(3):
            grid = [slice(None, None, done[a]) for a in range(3)]
            grid[axis] = slice(None)
            known = out[tuple(grid)]
            for at in range(unit, values.shape[axis], 2 * unit):
                pred = _predict(known, axis, at, unit, values.shape[axis])
                cell = list(grid)
                cell[axis] = at
                cell = tuple(cell)
                if codes is None:
                    err = values[cell] - pred
                    steps = np.trunc(np.copysign(np.abs(err) / bound + 1, err) / 2)
                    code = steps.astype(np.int64) + radius
                    inside = (code >= 0) & (code < 2 * radius)
                    made[cell] = np.where(inside, code, 0)
                    outlier[cell] = np.where(inside, np.nan, values[cell])
                    got = pred + steps * 2 * bound
                    out[cell] = np.where(inside, got, values[cell])
                else:
                    got = pred + (codes[cell] - radius) * 2 * bound
                    out[cell] = np.where(np.isnan(values[cell]), got, values[cell])
                known = out[tuple(grid)]
            done[axis] = unit
    return made, outlier, out


def _dealt(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with their block (bx, by, bz), those on a block's first planes also for the blocks before."""
    rows = df.select("x", "y", "z", *columns)
    for a, b, side in (("x", "bx", BLOCK[0]), ("y", "by", BLOCK[1]), ("z", "bz", BLOCK[2])):
        own = F.floor(F.col(a) / side)
        rows = rows.withColumn(b, F.explode(F.when((F.col(a) % side == 0) & (F.col(a) > 0), F.array(own - 1, own)).otherwise(F.array(own))))
    return rows


def _in_blocks(df: DataFrame, columns: list[str], work, schema: str, cells: int | None) -> DataFrame:
    """What `work` makes of blocks of one shape: it gets an array [z, y, x, block] of each column, and gives columns of such arrays."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, group in whole_groups(batches, 3):
            place = [c - b * side for c, b, side in zip(cols[3:6], cols[:3], BLOCK, strict=True)]
            sides = [np.maximum.reduceat(p, np.flatnonzero(np.diff(group, prepend=-1))) + 1 for p in place]
            shapes, of = np.unique(np.stack(sides, 1), axis=0, return_inverse=True)
            for k, shape in enumerate(shapes):
                rows = np.flatnonzero(of[group] == k)
                number = np.cumsum(np.diff(group[rows], prepend=-1) != 0) - 1
                at = (place[2][rows], place[1][rows], place[0][rows], number)
                arrays = []
                for c in cols[6:]:
                    arrays.append(np.full((*shape[::-1], int(number[-1]) + 1), np.nan))
                    arrays[-1][at] = c[rows]
                own = np.logical_and.reduce([p[rows] < side for p, side in zip(place, BLOCK, strict=True)])
                inner = tuple(a[own] for a in at)
                made = [pa.array(x[inner], pa.float64(), mask=np.isnan(x[inner])) if x.dtype == np.float64 else pa.array(x[inner]) for x in work(*arrays)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c[rows][own]) for c in cols[3:6]), *made], names=names)

    rows = _dealt(df, columns).select("bx", "by", "bz", *[F.col(c).cast("long").alias(c) for c in "xyz"], *[F.col(c).cast("double").alias(c) for c in columns])
    return dealt(rows, df.count() if cells is None else cells, "bx", "by", "bz").sortWithinPartitions("bx", "by", "bz").mapInArrow(run, schema)


def predicted(df: DataFrame, value: str, eb: float, radius: int = 512, cells: int | None = None) -> DataFrame:
    """(x, y, z, anchor, code, outlier) of a dense array; its cells are counted if their number is not given."""

    def work(v: np.ndarray) -> tuple[np.ndarray, ...]:
        codes, outlier, _ = run_block(v, None, eb, radius)
        anchor = np.full(v.shape, np.nan)
        anchor[::8, ::8, ::8] = v[::8, ::8, ::8]
        return anchor, codes, outlier

    return _in_blocks(df, [value], work, "x long, y long, z long, anchor double, code long, outlier double", cells)


def restored(coded: DataFrame, eb: float, radius: int = 512, cells: int | None = None) -> DataFrame:
    """(x, y, z, restored)."""
    rows = coded.withColumn("exact", F.coalesce("anchor", "outlier", F.lit(float("nan"))))
    return _in_blocks(rows, ["exact", "code"], lambda exact, codes: run_block(exact, np.nan_to_num(codes).astype(np.int64), eb, radius)[2:], "x long, y long, z long, restored double", cells)
