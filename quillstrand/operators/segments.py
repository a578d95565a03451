"""Identifiers: splitting at delimiters, and types and constants of their segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_numeric

DELIMITERS = ". :/"


def _class(delimiters: str) -> str:
    return "[" + "".join("\\" + c if c in "\\]^-[" else c for c in delimiters) + "]"


def is_delimiter(c: Column, delimiters: str = DELIMITERS) -> Column:
    return c.rlike("^" + _class(delimiters) + "$")


def pieces(identifier: Column, delimiters: str = DELIMITERS) -> Column:
    """Pieces between single delimiters: empty ones inside stay, an empty one at the end does not."""
    parts = F.split(identifier, _class(delimiters), -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def delimiters_of(identifier: Column, delimiters: str = DELIMITERS) -> Column:
    return F.regexp_extract_all(identifier, F.lit("(" + _class(delimiters) + ")"), F.lit(1))


def exploded(df: DataFrame, identifier: str, keys: list[str], delimiters: str = DELIMITERS) -> DataFrame:
    """A row per segment: keys, pos (from 0), segment, delimiter ('' at the end), numeric."""
    parts, ends = pieces(F.col(identifier), delimiters), delimiters_of(F.col(identifier), delimiters)
    # the delimiters stand in a column of their own, so they are found once per row
    rows = df.select(*keys, ends.alias("__ends"), F.posexplode(parts).alias("pos", "segment"))
    delimiter = F.coalesce(F.get(F.col("__ends"), F.col("pos")), F.lit(""))
    return rows.select(*keys, "pos", "segment", delimiter.alias("delimiter"), is_numeric(F.col("segment")).alias("numeric"))


def shape_of(identifier: Column, delimiters: str = DELIMITERS) -> Column:
    """An identifier's shape: how many pieces it has, and the delimiters in their order."""
    return F.concat(F.size(pieces(identifier, delimiters)).cast("string"), F.lit(" "), F.array_join(delimiters_of(identifier, delimiters), ""))


def common_shapes(df: DataFrame, identifier: str, most: int = 16, share: int = 1024, delimiters: str = DELIMITERS) -> list[str]:
    """The dictionary of shapes: at most `most`, the commonest first, each of a `share`-th of all rows or more."""
    counts = df.where(F.col(identifier).isNotNull()).groupBy(shape_of(F.col(identifier), delimiters).alias("shape")).agg(F.count("*").alias("n"))
    total = df.count()
    return [r["shape"] for r in counts.orderBy(F.desc("n"), "shape").limit(most).collect() if r["n"] * share >= total]


def shape_id(identifier: Column, shapes: list[str], delimiters: str = DELIMITERS) -> Column:
    """The number of an identifier's shape in the dictionary; -1 for others."""
    place = F.array_position(F.array(*[F.lit(s) for s in shapes]).cast("array<string>"), shape_of(identifier, delimiters))
    return (F.coalesce(place, F.lit(0)) - 1).cast("int")


def infer(df: DataFrame, identifier: str, key: str, delimiters: str = DELIMITERS, mode: str = "exact", by: tuple[str, ...] = ()) -> DataFrame:
    """A row per segment position, and per value of `by` in mode "exact": is it numeric and lossless as such, constant, and how long at most.

    mode "exact" looks at every row.  mode "first" has the types and lengths of the
    first row alone, and calls a segment constant if ten sampled rows agree, as
    fast schema inference does; it may lose data.
    """
    rows = exploded(df, identifier, [key, *by], delimiters)
    if mode == "first":
        first = rows.join(df.agg(F.min(key).alias(key)), key).select("pos", "delimiter", F.col("numeric").alias("is_numeric"), (F.octet_length("segment") + 1).alias("max_len"), F.col("segment").alias("first_value"))
        ids = sample_ids(df, key)
        same = rows.join(F.broadcast(ids), key).groupBy("pos").agg((F.min("segment") == F.max("segment")).alias("is_static"))
        return first.join(same, "pos")
    number = F.col("segment").try_cast("bigint")
    whole = F.coalesce(number.cast("string") == F.col("segment"), F.lit(False)) & F.col("numeric")
    return rows.groupBy(*by, "pos").agg(
        F.min(whole).alias("is_numeric"),
        (F.min("segment") == F.max("segment")).alias("is_static"),
        (F.max(F.octet_length("segment")) + 1).alias("max_len"),
        F.min_by("segment", key).alias("first_value"),
        F.min_by("delimiter", key).alias("delimiter"),
        F.count("*").alias("n_rows"),
    )


def sample_ids(df: DataFrame, key: str, most: int = 10) -> DataFrame:
    """Keys of evenly spaced rows, for keys that number the rows from 0: (n - 1) * i // (k - 1)."""
    n = df.agg(F.count("*").alias("n")).withColumn("k", F.least("n", F.lit(most)))
    at = F.floor((F.col("n") - 1) * F.col("i") / F.greatest(F.col("k") - 1, F.lit(1)))
    return n.where("n > 0").select("n", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i")).select(at.alias(key)).distinct()


def columns(df: DataFrame, identifier: str, count: int, delimiters: str = DELIMITERS) -> DataFrame:
    """df with seg_0 to seg_{count - 1}; missing pieces are null, further ones are left out."""
    parts = pieces(F.col(identifier), delimiters)
    return df.withColumn("__parts", parts).select("*", *[F.get(F.col("__parts"), F.lit(i)).alias(f"seg_{i}") for i in range(count)]).drop("__parts")


def truncated(segment: Column, max_len: int) -> Column:
    """A string cut to what a column of that width with an end mark holds, 255 bytes at most."""
    return F.substring(segment, 1, min(max_len - 1, 255))
