"""Lorenzo prediction with feedback: each value is predicted from restored neighbours.

Values outside a block count as zero, so blocks are independent: a task takes
many at a time and they go through their cells in step, one anti-diagonal of all
blocks after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .delta import AXES, TILES

#: Cells that a task works on at a time.
CELLS = 1 << 20


def run_blocks(values: np.ndarray, eb: float, radius: int, codes: np.ndarray | None = None, pad: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (0: outlier) and restored values of blocks of 1 to 3 dimensions, the first axis counting blocks; with codes, values need only hold outliers.

    pad: restored values with one more place in front of each axis for those before the block, which are zero
    without it; blocks come last there, and it is filled in.
    """
    side = values.shape[1:]
    dims = len(side)
    # cells come first, so that what all blocks have at a place lies together
    values, given = np.moveaxis(values, 0, -1), None if codes is None else np.moveaxis(codes, 0, -1)
    pad = np.zeros((*(n + 1 for n in side), values.shape[-1])) if pad is None else pad
    made = np.zeros(values.shape, np.int64)
    offsets = [(tuple(-((m >> a) & 1) for a in range(dims)), -((-1) ** m.bit_count())) for m in range(1, 1 << dims)]
    # cells whose places add up to the same do not need each other
    place = np.indices(side).reshape(dims, -1)
    total = place.sum(0)
    order = np.argsort(total, kind="stable")
    for cells in np.split(order, np.flatnonzero(np.diff(total[order])) + 1):
        at = tuple(place[:, cells])
        pred = sum(sign * pad[tuple(i + 1 + o for i, o in zip(at, off, strict=True))] for off, sign in offsets)
        if given is None:
            steps = (values[at] - pred) / (2 * eb)
            size = np.floor(np.abs(steps) + 0.5)
            inside = size < radius
            code = np.where(inside, np.where(steps >= 0, 1, -1) * np.where(inside, size, 0).astype(np.int64) + radius, 0)
        else:
            code = given[at]
        made[at] = code
        pad[tuple(i + 1 for i in at)] = np.where(code != 0, pred + (code - radius) * 2 * eb, values[at])
    return np.moveaxis(made, -1, 0), np.moveaxis(pad[tuple(slice(1, None) for _ in range(dims))], -1, 0)


def _apply(df: DataFrame, value: str, code: str | None, dims: int, eb: float, radius: int, tile: tuple[int, ...] | None) -> DataFrame:
    axes, tile = AXES[:dims], tile or TILES[dims]
    tiles = {f"t{a}": F.floor(F.col(a) / t) for a, t in zip(axes, tile, strict=True)}
    src = df.select(*[F.col(a).cast("long").alias(a) for a in axes], F.col(value).cast("double").alias("v"), *([F.col(code).cast("long").alias("c")] if code else [])).withColumns(tiles)
    schema = ", ".join(f"{a} long" for a in axes) + ", code long, outlier double, restored double"

    def work(cols: list[np.ndarray], block: np.ndarray) -> pa.RecordBatch:
        """Whole blocks, numbered by `block`."""
        local = tuple(p % t for p, t in zip(cols[:dims], tile, strict=True))
        v = np.zeros((int(block[-1]) + 1, *tile))
        v[(block, *local)] = np.nan_to_num(cols[dims])
        c = None
        if code:
            c = np.zeros(v.shape, np.int64)
            c[(block, *local)] = cols[dims + 1]
        made, out = (x[(block, *local)] for x in run_blocks(v, eb, radius, c))
        return pa.RecordBatch.from_arrays([*(pa.array(p) for p in cols[:dims]), pa.array(made), pa.array(np.nan_to_num(cols[dims]), mask=made != 0), pa.array(out)], names=[*axes, "code", "outlier", "restored"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def joined() -> tuple[list[np.ndarray], np.ndarray]:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            change = np.zeros(len(cols[0]), bool)
            for t in cols[-dims:]:
                change[1:] |= t[1:] != t[:-1]
            return cols, np.cumsum(change)

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(h[0]) for h in held) >= CELLS:
                cols, block = joined()
                whole = int(np.searchsorted(block, block[-1]))  # the last block may go on
                if whole:
                    yield work([c[:whole] for c in cols], block[:whole])
                held = [[c[whole:] for c in cols]]
        if held:
            yield work(*joined())

    return src.repartition(*tiles).sortWithinPartitions(*tiles, *axes).mapInArrow(run, schema)


def compressed(df: DataFrame, value: str, dims: int, eb: float, radius: int = 512, tile: tuple[int, ...] | None = None) -> DataFrame:
    """(place, code, outlier, restored)."""
    return _apply(df, value, None, dims, eb, radius, tile)


def decompressed(coded: DataFrame, dims: int, eb: float, radius: int = 512, tile: tuple[int, ...] | None = None) -> DataFrame:
    """(place, ..., restored) from codes and outliers."""
    return _apply(coded, "outlier", "code", dims, eb, radius, tile)
