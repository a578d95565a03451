"""Scans over a whole ordered column without a one-partition window.

Rows are cut into blocks by their numeric key, and blocks have totals, a row a
block.  Up to 65,536 of them are scanned on the driver and broadcast; more
are cut into groups of 65,536 block numbers, and those again: totals go up this tree
and running sums come down it.  So no task holds more than 65,536 rows of it, whether keys number the
rows or are hashes or times that spread over all 64 bits.  Inside a block an ordinary window does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: Most rows that a window over block totals may have.
GROUP = 1 << 16
#: Bytes of input that may be read twice for them.
SMALL = 1 << 30
#: Keys of a block.
BLOCK = 1 << 16


def _blocked(df: DataFrame, key: str, size: int) -> DataFrame:
    return df.withColumn("__block", F.floor(F.col(key) / F.lit(size)))


def _tree(blocks: DataFrame) -> DataFrame:
    """Rows of blocks with their group, that one's group, and the root, a column that is 0 everywhere."""
    up = blocks.withColumn("__up", F.shiftright("__block", 16)).withColumn("__top", F.shiftright("__block", 32))
    return up.withColumn("__root", F.pmod("__top", F.lit(1)))


def _blocks(blocks: DataFrame) -> tuple[DataFrame, list | None]:
    """Totals of blocks, and their rows in order if there are at most `GROUP`, which may be on the driver and be broadcast.

    They are written before they are looked at, so that their input is not read again; small input may be.
    """
    leaves = blocks._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size > SMALL:
        blocks = materialize(blocks, "blocks")
    rows = blocks.limit(GROUP + 1).collect()
    if len(rows) <= GROUP:
        return blocks, sorted(rows, key=lambda r: r["__block"])
    return blocks if size > SMALL else materialize(blocks, "blocks"), None


def _carry(blocked: DataFrame, by: list[str], totals: dict[str, Column]) -> DataFrame:
    """Exclusive running sums of block totals, named like them with __base_ in front."""
    sums, few = _blocks(blocked.groupBy(*by, "__block").agg(*[F.sum(c).alias(n) for n, c in totals.items()]))
    if few is not None:
        so_far: dict[tuple, list] = {}
        out = []
        for r in few:
            own = so_far.setdefault(tuple(r[c] for c in by), [0] * len(totals))
            out.append((*(r[c] for c in by), r["__block"], *own))
            own[:] = [a + (r[n] or 0) for a, n in zip(own, totals, strict=True)]
        kinds = T.StructType([*(sums.schema[c] for c in (*by, "__block")), *(T.StructField(f"__base_{n}", sums.schema[n].dataType) for n in totals)])
        return F.broadcast(sums.sparkSession.createDataFrame(out, kinds))
    sums = _tree(sums)
    groups = sums.groupBy(*by, "__root", "__top", "__up").agg(*[F.sum(n).alias(n) for n in totals])
    tops = groups.groupBy(*by, "__root", "__top").agg(*[F.sum(n).alias(n) for n in totals])

    def before(rows: DataFrame, part: str, order: str, level: str) -> DataFrame:
        w = Window.partitionBy(*by, part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(*by, order, *(["__up", "__top"] if level == "__own_" else []), *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(level + n) for n in totals])

    out = before(sums, "__up", "__block", "__own_").join(before(groups, "__top", "__up", "__group_"), [*by, "__up"]).join(before(tops, "__root", "__top", "__top_"), [*by, "__top"])
    return out.select(*by, "__block", *[(F.col(f"__own_{n}") + F.col(f"__group_{n}") + F.col(f"__top_{n}")).alias(f"__base_{n}") for n in totals])


def running_sum(df: DataFrame, key: str, sums: dict[str, Column], by: list[str] | None = None, exclusive: bool = False, size: int = BLOCK) -> DataFrame:
    """df with a running sum for each of `sums`, in the order of the unique key, per group of `by`."""
    by = by or []
    blocked = _blocked(df, key, size)
    base = _carry(blocked, by, sums)
    w = Window.partitionBy(*by, "__block").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = blocked.join(base, [*by, "__block"])
    for n, c in sums.items():
        out = out.withColumn(n, F.col(f"__base_{n}") + F.sum(c).over(w) - (c if exclusive else F.lit(0)))
    return out.drop("__block", *[f"__base_{n}" for n in sums])


def dense_id(df: DataFrame, key: str, name: str = "rec_id", size: int = BLOCK) -> DataFrame:
    """df with its rank by the unique key, from 0."""
    blocked = _blocked(df, key, size)
    base = _carry(blocked, [], {"n": F.lit(1)})
    rank = F.col("__base_n") + F.row_number().over(Window.partitionBy("__block").orderBy(key)) - 1
    return blocked.join(base, "__block").withColumn(name, rank).drop("__block", "__base_n")


def lagged(df: DataFrame, key: str, values: dict[str, Column], size: int = BLOCK) -> DataFrame:
    """df with, for each name, the value of the row before in the order of the unique key; null for the first row."""
    blocked = _blocked(df, key, size)
    last = F.struct(*[F.col(n) for n in values])
    ends, few = _blocks(blocked.groupBy("__block").agg(*[F.max_by(c, F.col(key)).alias(n) for n, c in values.items()]).select("__block", last.alias("__last")))
    if few is not None:
        kinds = T.StructType([T.StructField("__block", T.LongType()), *(T.StructField(f"__end_{n}", ends.schema["__last"].dataType[n].dataType) for n in values)])
        prior = [(r["__block"], *(before["__last"] if before else [None] * len(values))) for before, r in zip([None, *few], few, strict=False)]
        return _lagged(blocked, F.broadcast(df.sparkSession.createDataFrame(prior, kinds)), key, values)
    ends = _tree(ends)
    groups = ends.groupBy("__root", "__top", "__up").agg(F.max_by("__last", "__block").alias("__last"))
    tops = groups.groupBy("__root", "__top").agg(F.max_by("__last", "__up").alias("__last"))

    def prior(rows: DataFrame, part: str, order: str, name: str, more: tuple[str, ...] = ()) -> DataFrame:
        return rows.select(order, *more, F.lag("__last").over(Window.partitionBy(part).orderBy(order)).alias(name))

    # the last values of the block before, or of the group before if a block is its group's first
    before = prior(ends, "__up", "__block", "__a", ("__up", "__top")).join(prior(groups, "__top", "__up", "__b"), "__up").join(prior(tops, "__root", "__top", "__c"), "__top")
    before = before.select("__block", F.coalesce("__a", "__b", "__c").alias("__last")).select("__block", *[F.col(f"__last.{n}").alias(f"__end_{n}") for n in values])
    return _lagged(blocked, before, key, values)


def _lagged(blocked: DataFrame, before: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    own = Window.partitionBy("__block").orderBy(key)
    out = blocked.join(before, "__block").withColumn("__nth", F.row_number().over(own))
    for n, c in values.items():
        out = out.withColumn(n, F.when(F.col("__nth") == 1, F.col(f"__end_{n}")).otherwise(F.lag(c).over(own)))
    return out.drop("__block", "__nth", *[f"__end_{n}" for n in values])
