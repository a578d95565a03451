"""Splitting values into a dense and a sparse part, and putting them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gather(df: DataFrame, idx: str, value: str, keep_dense: Column) -> tuple[DataFrame, DataFrame]:
    """(sparse, dense): values off the criterion by index, and the column with those set to zero."""
    bad = ~keep_dense
    return df.where(bad).select(idx, value), df.withColumn(value, F.when(bad, F.lit(0).cast(df.schema[value].dataType)).otherwise(F.col(value)))


def scatter(dense: DataFrame, sparse: DataFrame, idx: str, value: str) -> DataFrame:
    """dense with the sparse values written in."""
    return dense.join(sparse.select(idx, F.col(value).alias("__sparse")), idx, "left").withColumn(value, F.coalesce("__sparse", value)).drop("__sparse")


def nonzero(df: DataFrame, idx: str, value: str) -> DataFrame:
    return df.where(F.col(value) != 0).select(idx, value)


def split_by_radius(df: DataFrame, idx: str, value: str, radius: int) -> DataFrame:
    """Codes of 2 * radius and more, or below zero."""
    return df.where((F.col(value) >= 2 * radius) | (F.col(value) < 0)).select(idx, value)


def split_by_value(df: DataFrame, idx: str, value: str, usual: object) -> DataFrame:
    """Codes other than the usual one."""
    return df.where(F.col(value) != usual).select(idx, value)
