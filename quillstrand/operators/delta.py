"""Differences, predictors on tiles, quantization and their inverses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dequantize, prequantize, unzigzag, zigzag
from ..session import dealt
from .scan import lagged, running_sum

#: Tile sides of the predictors by number of dimensions.
TILES = {1: (256,), 2: (16, 16), 3: (8, 8, 8)}
AXES = ("x", "y", "z")


def first_difference(df: DataFrame, key: str, value: str, out: str = "delta") -> DataFrame:
    """x[i] - x[i - 1] over the whole column; the first value stands for itself."""
    return lagged(df, key, {out: F.col(value)}).withColumn(out, F.col(value) - F.coalesce(out, F.lit(0)))


def prefix_sum(df: DataFrame, key: str, value: str, out: str = "total") -> DataFrame:
    """The inverse of first_difference."""
    return running_sum(df, key, {out: F.col(value)})


def tile_columns(axes: tuple[str, ...], tile: tuple[int, ...]) -> dict[str, Column]:
    return {f"t{a}": F.floor(F.col(a) / t) for a, t in zip(axes, tile, strict=True)}


def lorenzo(df: DataFrame, value: str, dims: int, out: str = "d", tile: tuple[int, ...] | None = None, cells: int | None = None) -> DataFrame:
    """Lorenzo residual inside tiles: differences along x, then y, then z; outside a tile all is zero.

    All windows of a tile share its key, so the tiles are dealt out once; cells are counted if their number is not given.
    """
    axes, tile = AXES[:dims], tile or TILES[dims]
    cols = tile_columns(axes, tile)
    res = dealt(df.withColumns(cols), cells, *cols)
    now = F.col(value)
    for a in axes:
        w = Window.partitionBy(*cols, *[b for b in axes if b != a]).orderBy(a)
        res = res.withColumn(out, now - F.lag(now, 1, 0).over(w))
        now = F.col(out)
    return res.drop(*cols)


def unlorenzo(df: DataFrame, residual: str, dims: int, out: str = "q", tile: tuple[int, ...] | None = None, cells: int | None = None) -> DataFrame:
    """Running sums along each axis inside tiles."""
    axes, tile = AXES[:dims], tile or TILES[dims]
    cols = tile_columns(axes, tile)
    res = dealt(df.withColumns(cols), cells, *cols)
    now = F.col(residual)
    for a in axes:
        w = Window.partitionBy(*cols, *[b for b in axes if b != a]).orderBy(a).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        res = res.withColumn(out, F.sum(now).over(w))
        now = F.col(out)
    return res.drop(*cols)


def quantized(df: DataFrame, value: str, dims: int, eb: float, radius: int = 512, use_zigzag: bool = False, tile: tuple[int, ...] | None = None, cells: int | None = None) -> DataFrame:
    """df with q, d, code and outlier (null where the code says all).

    code is d + radius, or the zig-zag of d, where abs(d) < radius, and else 0
    with the outlier d + radius, or d.
    """
    res = lorenzo(df.withColumn("q", prequantize(F.col(value), eb)), "q", dims, "d", tile, cells)
    inside = F.abs("d") < radius
    code = zigzag(F.col("d")) if use_zigzag else F.col("d") + radius
    return res.withColumns({"code": F.when(inside, code).otherwise(0), "outlier": F.when(~inside, F.col("d") if use_zigzag else F.col("d") + radius)})


def residuals(df: DataFrame, value: str, dims: int, eb: float, radius: int | None = None, tile: tuple[int, ...] | None = None) -> DataFrame:
    """df with q and d alone, or, with a radius, the code d + radius of every value: no value is an outlier, so codes may be of any size."""
    res = lorenzo(df.withColumn("q", prequantize(F.col(value), eb)), "q", dims, "d", tile)
    return res if radius is None else res.withColumn("code", F.col("d") + radius)


def restored(df: DataFrame, dims: int, eb: float, radius: int = 512, use_zigzag: bool = False, tile: tuple[int, ...] | None = None, cells: int | None = None) -> DataFrame:
    """df (place, code, outlier) with q2 and the restored value."""
    inside = unzigzag(F.col("code")) if use_zigzag else F.col("code") - radius
    d = F.when(F.col("outlier").isNotNull(), F.col("outlier") - (0 if use_zigzag else radius)).otherwise(inside)
    res = unlorenzo(df.withColumn("__d", d), "__d", dims, "q2", tile, cells)
    return res.withColumn("restored", dequantize(F.col("q2"), eb)).drop("__d")


def in_index_range(df: DataFrame, lo: int, hi: int, idx: str = "x", tile: int = TILES[1][0], tile_col: str = "tile_id") -> DataFrame:
    """A range filter on the element index with the filter on the tile column that it implies, which can reach the scan."""
    return df.where(F.col(tile_col).between(lo // tile, (hi - 1) // tile) & F.col(idx).between(lo, hi - 1))


def too_many_outliers(df: DataFrame) -> DataFrame:
    """One row: n, n_outliers, and whether they pass a fifth of the values."""
    return df.agg(F.count("*").alias("n"), F.count("outlier").alias("n_outliers")).withColumn("too_many", F.col("n_outliers") * 5 > F.col("n"))


def relative_bound(df: DataFrame, value: str, eb: float) -> float:
    """eb times the range of values; an empty or constant column has no such bound."""
    r = df.agg((F.max(value) - F.min(value)).alias("r")).first()["r"]
    if not r:
        raise ValueError("a relative bound needs values that differ")
    return float(r) * eb


def binned2d(df: DataFrame, value: str = "value", side: int = 2) -> DataFrame:
    """Means of side x side cells; at the edge, of those there are."""
    return df.groupBy(F.floor(F.col("x") / side).alias("x"), F.floor(F.col("y") / side).alias("y")).agg(F.avg(value).alias("mean"))


def dry_run(df: DataFrame, value: str, eb: float) -> DataFrame:
    """df with what quantization alone makes of the values."""
    return df.withColumn("restored", dequantize(prequantize(F.col(value), eb), eb))
