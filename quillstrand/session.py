"""Session helpers: the shared scratch folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    and the master is local, as in tests on one machine, a local folder is made
    and remembered; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="quillstrand-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark)}/quillstrand/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """Have Arrow batches of the session hold about `most` bytes, however long its texts are.

    By count alone a batch has 10,000 rows, and a task holds it in the JVM and in Python at once.
    Spark reads this setting when a plan runs, not when it is made, so it cannot be put back
    before the caller runs it.  All operators with Arrow stages ask for the same bound, so none
    depends on what ran before, and a bound that the application was started with stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in dict(spark.sparkContext.getConf().getAll()):
        spark.conf.set(name, most)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it again.

    This cuts the lineage at files which outlive executors, so a lost executor
    costs the tasks that read them and not the stages that made them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task sorts at a time, about.
DEALT = 1 << 18


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """df by keys, in as many partitions as its number of rows asks for (None: they are counted).

    Adaptive execution joins partitions by their compressed bytes, and of cells a few megabytes are
    millions of rows, which a task sorts at once; a number that is given stays.
    """
    n = -(-(df.count() if rows is None else rows) // DEALT)
    return df.repartition(*keys) if n <= 1 else df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a path, in order."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


def cleanup(spark: SparkSession) -> None:
    """Delete the tables that this application has materialized; frames that read them are of no use afterwards."""
    drop_path(spark, f"{shared_dir(spark)}/quillstrand/{spark.sparkContext.applicationId}")


def hot_keys(counts: DataFrame, key: str, n: str = "n", least: int = 256, share: int = 1000) -> DataFrame:
    """Rows of `counts` whose key has over `least` rows and over a `share`-th of all rows.

    There are fewer than `share` of them, whatever the data, so they may be broadcast.
    `counts` is read twice and should be materialized.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) > max(least, total // share))


def join_hot(rows: DataFrame, counts: DataFrame, key: str, n: str = "n", least: int = 256, how: str = "inner") -> DataFrame:
    """rows joined to the one row of `counts` that has their key; rows of hot keys stay where they are.  how is inner, or left to keep rows without one.

    `counts` has a row for each key with the number `n` of its rows.  Keys over a
    thousandth of all rows, fewer than 1,000, are broadcast; the others meet by a
    shuffle in which no key has more rows than that.
    """
    hot = hot_keys(counts, key, n, least)
    if hot.isEmpty():
        return rows.join(counts, key, how)
    names = F.broadcast(hot.select(key))
    cold = rows.join(names, key, "left_anti").join(counts.join(names, key, "left_anti"), key, how)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def environment(spark: SparkSession) -> DataFrame:
    """(key, value): versions and settings that a run depends on."""
    import platform

    names = ("spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.executor.memory", "spark.executor.cores")
    rows = [("spark", spark.version), ("python", platform.python_version()), ("machine", platform.machine()), *((n, spark.conf.get(n, None)) for n in names)]
    return spark.createDataFrame(rows, "key string, value string")
