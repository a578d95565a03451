"""One file from many tasks, and back: parts at places that are known beforehand.

``format("parts")`` writes rows (at, data), each to its place in one file, and
reads rows (segment, part, data) of an archive.  A file takes shape under
another name and gets its own when all tasks are done and all bytes are there; a job
that fails leaves nothing.  A task that runs again writes the same bytes to
the same places.  That needs a file system with positional writes, shared by
the driver and all executors; elsewhere archives stay folders.

An archive is ``QSA1``, the header's length (8 bytes), the header (JSON: its
segments with place, bytes and number of parts, and what the caller adds), then
the segments end to end, the parts of each in their order.  The last segment,
``index``, has the sizes of all parts, 8 bytes each, so any part is found without the others.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.scan import dense_id, running_sum
from ..session import drop_path, folders, materialize, scratch_path
from .files import registered

MAGIC = b"QSA1"
#: Bytes of parts that a task reads, and entries of an index row.
TOGETHER, ENTRIES = 1 << 26, 1 << 16


def local(path: str) -> str | None:
    """The path as the operating system says it, if it is one."""
    if "://" not in path and not path.startswith("file:"):
        return path
    parsed = urlparse(path)
    return unquote(parsed.path) if parsed.scheme == "file" and parsed.netloc in ("", "localhost") else None


@dataclass
class Wrote(WriterCommitMessage):
    size: int


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        where = local(options["path"])
        if where is None:
            raise ValueError(f"{options['path']}: one file from many tasks needs a file system with positional writes")
        if os.path.exists(where) and not overwrite:
            raise FileExistsError(where)
        self.path, self.size = where, int(options["size"])
        self.partial = f"{where}.{uuid.uuid4().hex}.partial"
        os.makedirs(os.path.dirname(where) or ".", exist_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        n = 0
        with os.fdopen(os.open(self.partial, os.O_RDWR | os.O_CREAT, 0o644), "r+b") as f:
            for batch in batches:
                for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    f.seek(at)
                    n += f.write(data)
            f.flush()
            os.fsync(f.fileno())
        return Wrote(n)

    def commit(self, messages: list[Wrote | None]) -> None:
        n = sum(m.size for m in messages if m is not None)
        if n != self.size:
            self.abort(messages)
            raise ValueError(f"{n} bytes were written to {self.path}, which has {self.size}")
        open(self.partial, "ab").close()  # an empty file has no parts
        os.replace(self.partial, self.path)

    def abort(self, messages: list[Wrote | None]) -> None:
        if os.path.exists(self.partial):
            os.unlink(self.partial)


@dataclass
class Together(InputPartition):
    """Parts of a segment that lie next to each other."""

    segment: str
    first: int
    at: int
    sizes: list[int]


def header_of(path: str) -> dict:
    with open(local(path), "rb") as f:
        if f.read(4) != MAGIC:
            raise ValueError(f"{path} is no archive")
        return json.loads(f.read(int.from_bytes(f.read(8), "little")))


class PartsReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.segment = local(options["path"]), options.get("segment")
        self.together = int(options.get("togetherbytes", TOGETHER))

    def partitions(self) -> list[Together]:
        header = header_of(self.path)
        with open(self.path, "rb") as f:
            f.seek(header["segments"][-1]["at"])
            index = np.frombuffer(f.read(header["segments"][-1]["bytes"]), "<u8").astype(np.int64)
        out, done = [], 0
        for s in header["segments"][:-1]:
            sizes = index[done : done + s["parts"]]
            done += s["parts"]
            if self.segment not in (None, s["name"]) or not len(sizes):
                continue
            ends = np.cumsum(sizes)
            cuts = np.flatnonzero(np.diff((ends - sizes) // self.together, prepend=-1)).tolist()
            out += [Together(s["name"], a, s["at"] + int(ends[a] - sizes[a]), sizes[a:b].tolist()) for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True)]
        return out

    def read(self, own: Together | None) -> Iterator[pa.RecordBatch]:
        if own is None:
            return
        with open(self.path, "rb") as f:
            f.seek(own.at)
            for k, size in enumerate(own.sizes):
                yield pa.RecordBatch.from_arrays([pa.array([own.segment]), pa.array([own.first + k]), pa.array([f.read(size)], pa.binary())], names=["segment", "part", "data"])


class Parts(DataSource):
    """Option ``size`` of the writer: the file's bytes.  Options ``segment`` and ``togetherBytes`` of the reader: one segment only; bytes that a task reads."""

    @classmethod
    def name(cls) -> str:
        return "parts"

    def schema(self) -> str:
        return "segment string, part long, data binary"

    def reader(self, schema: T.StructType) -> PartsReader:
        return PartsReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options, overwrite)


def write_at(rows: DataFrame, path: str, size: int) -> None:
    """A file of `size` bytes from rows (at, data) that fill it."""
    registered(rows.sparkSession, Parts)
    rows.select("at", "data").write.format("parts").mode("overwrite").option("size", size).save(path)


def _index(sizes: DataFrame) -> DataFrame:
    """(part, data): the sizes, in the order of their keys, as binary rows of `ENTRIES` each."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("k").to_numpy(), kind="stable")
        return pa.table({"part": table.column("block")[:1], "data": pa.array([table.column("size").to_numpy()[order].astype("<u8").tobytes()], pa.binary())})

    rows = dense_id(sizes.select("key", "size"), "key", "k")
    return rows.select(F.floor(F.col("k") / ENTRIES).alias("block"), "k", "size").groupBy("block").applyInArrow(run, "part long, data binary")


def write_archive(rows: DataFrame, path: str, segments: list[str], more: dict | None = None) -> None:
    """An archive of (segment, part, data); `segments` names them in the file's order, and parts count from 0 in each."""
    spark = rows.sparkSession
    place = F.array_position(F.array(*[F.lit(s) for s in segments]), F.col("segment")) - 1
    rows = materialize(rows.select((place.cast("long") * (1 << 40) + F.col("part")).alias("key"), "segment", "data"), "parts")
    sizes = rows.select("key", "segment", F.octet_length("data").cast("long").alias("size"))
    totals = {r["segment"]: (r["bytes"], r["n"]) for r in sizes.groupBy("segment").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}  # a row a segment
    n_parts = sum(n for _, n in totals.values())
    table, at = [], 0
    for name in [*segments, "index"]:
        size, n = (8 * n_parts, -(-n_parts // ENTRIES)) if name == "index" else totals.get(name, (0, 0))
        table.append({"name": name, "at": at, "bytes": size, "parts": n})
        at += size
    # places follow the header, whose length follows from places: it is padded to one that holds any
    room = len(json.dumps({"segments": table, **(more or {})})) + 24 * len(table)
    for s in table:
        s["at"] += 12 + room
    head = json.dumps({"segments": table, **(more or {})}).encode().ljust(room)
    placed = running_sum(sizes, "key", {"at": F.col("size")}, exclusive=True).select("key", (F.col("at") + 12 + room).alias("at"))
    body = rows.join(placed, "key").select("at", "data")
    first = spark.createDataFrame([(0, bytearray(MAGIC + room.to_bytes(8, "little") + head))], "at long, data binary")
    index = _index(sizes).select((F.col("part") * (8 * ENTRIES) + table[-1]["at"]).alias("at"), "data")
    write_at(body.unionByName(first).unionByName(index), path, at + 12 + room)


def read_archive(spark: SparkSession, path: str, segment: str | None = None) -> DataFrame:
    """(segment, part, data) of an archive, or of one segment of it."""
    reader = registered(spark, Parts).read.format("parts")
    return (reader.option("segment", segment) if segment else reader).load(path)


def table_parts(df: DataFrame, name: str) -> DataFrame:
    """(segment, part, data): a table as batches in Arrow's stream format, numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(b for b in batches if b.num_rows):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | k]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["nth", "data"])

    rows = materialize(df.mapInArrow(run, "nth long, data binary"), "batches")  # numbered from what was written: another run may cut batches elsewhere
    return dense_id(rows, "nth", "part").select(F.lit(name).alias("segment"), "part", "data")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One file of several tables; their schemas go to the header."""
    rows = None
    for name, df in tables.items():
        own = table_parts(df, name)
        rows = own if rows is None else rows.unionByName(own)
    write_archive(rows, path, list(tables), {"schemas": {n: df.schema.json() for n, df in tables.items()}})


def is_archive(path: str) -> bool:
    where = local(path)
    return where is not None and os.path.isfile(where)


def read_table_of(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of such a file."""
    schema = T.StructType.fromJson(json.loads(header_of(path)["schemas"][name]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield from pa.ipc.open_stream(data)

    return read_archive(spark, path, name).select("data").mapInArrow(run, schema)


def in_one_file(spark: SparkSession, path: str, write) -> None:
    """What `write(folder)` writes as a folder of tables, as one file."""
    folder = scratch_path(spark, "archive")
    write(folder)
    write_tables({name: spark.read.parquet(f"{folder}/{name}") for name in folders(spark, folder)}, path)
    drop_path(spark, folder)


def tables(spark: SparkSession, path: str):
    """A function from names to tables of an archive, which is one file or a folder."""
    if is_archive(path):
        return lambda name: read_table_of(spark, path, name)
    return lambda name: spark.read.parquet(f"{path}/{name}")
