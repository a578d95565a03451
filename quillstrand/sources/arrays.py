"""Raw little-endian arrays, their named shapes, and archives."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual

from . import parts
from .files import Range, as_option, cut, files_of, listed, openable, registered

#: X, y, z of public test datasets.
SHAPES = {
    "hacc": (280953867, 1, 1),
    "hacc1b": (1073726487, 1, 1),
    "cesm": (3600, 1800, 1),
    "hurricane": (500, 500, 100),
    "nyx-s": (512, 512, 512),
    "nyx-m": (1024, 1024, 1024),
    "qmc": (288, 69, 7935),
    "qmcpre": (69, 69, 33120),
    "exafel": (388, 59200, 1),
    "rtm": (235, 849, 849),
    "parihaka": (1168, 1126, 922),
}


def dims(shape: tuple[int, int, int]) -> int:
    x, y, z = shape
    return 3 if z > 1 else 2 if y > 1 else 1


@dataclass
class Box:
    """Bounds, both included, of the index and of x, y and z."""

    idx: list
    x: list
    y: list
    z: list

    def narrow(self, name: str, low: int, high: int) -> None:
        own = getattr(self, name)
        own[0], own[1] = max(own[0], low), min(own[1], high)


class RawArrayReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files, self.kind = files_of(options), np.dtype(options.get("dtype", "<f4"))
        self.shape = tuple(int(n) for n in options["shape"].split("x")) if options.get("shape") else None
        self.part = int(options.get("partbytes", 1 << 26))
        for name, size in self.files:
            if size % self.kind.itemsize:
                raise ValueError(f"{name} is no whole number of {self.kind.str} values")
        most = (1 << 62,) * 3 if self.shape is None else self.shape
        self.box = Box([0, 1 << 62], *([0, n - 1] for n in most))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        names = ("idx", "x", "y", "z") if self.shape else ("idx",)
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            whole = name in names and isinstance(getattr(f, "value", None), int)
            if whole and isinstance(f, EqualTo):
                self.box.narrow(name, f.value, f.value)
            elif whole and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.box.narrow(name, f.value + isinstance(f, GreaterThan), 1 << 62)
            elif whole and isinstance(f, LessThan | LessThanOrEqual):
                self.box.narrow(name, 0, f.value - isinstance(f, LessThan))
            elif name in names and isinstance(f, In) and f.value and all(isinstance(v, int) for v in f.value):
                self.box.narrow(name, min(f.value), max(f.value))
                yield f
            elif not (isinstance(f, IsNotNull) and name in names):
                yield f

    def runs(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """Stretches of the index between a and b that hold all of the box: planes, rows of planes, or parts of long rows."""
        a, b = max(a, self.box.idx[0]), min(b, self.box.idx[1] + 1)
        if self.shape is None:
            if a < b:
                yield a, b
            return
        x, y, _ = self.shape
        (x0, x1), (y0, y1), (z0, z1) = self.box.x, self.box.y, self.box.z
        if x0 > x1 or y0 > y1 or a >= b:
            return
        narrow = (x - (x1 - x0 + 1)) * self.kind.itemsize >= 1 << 16  # a gap that is worth a seek
        whole_planes = y0 == 0 and y1 == y - 1 and not narrow
        stretches = ((z0 * x * y, (z1 + 1) * x * y) for _ in range(1)) if whole_planes else ((z * x * y + y0 * x, z * x * y + (y1 + 1) * x) for z in range(max(z0, a // (x * y)), min(z1, (b - 1) // (x * y)) + 1))
        for start, end in stretches:
            if not narrow:
                if max(start, a) < min(end, b):
                    yield max(start, a), min(end, b)
                continue
            for row in range(max(start, a) // x * x, min(end, b), x):
                if max(row + x0, a) < min(row + x1 + 1, b):
                    yield max(row + x0, a), min(row + x1 + 1, b)

    def partitions(self) -> list[Range]:
        width = self.kind.itemsize
        return [r for r in cut(self.files, self.part, width) if next(self.runs(r.a // width, r.b // width), None)]

    def planned_bytes(self) -> int:
        """Bytes that will be read."""
        width = self.kind.itemsize
        return sum((b - a) * width for r in self.partitions() for a, b in self.runs(r.a // width, r.b // width))

    def read(self, r: Range | None) -> Iterator[pa.RecordBatch]:
        if r is None:
            return
        width, number = self.kind.itemsize, np.float64 if self.kind.kind == "f" else np.int64
        system, where = fs.FileSystem.from_uri(r.file)
        with system.open_input_file(where) as f:
            for a, b in self.runs(r.a // width, r.b // width):
                for at in range(a, b, 1 << 18):
                    f.seek(at * width)
                    values = np.frombuffer(f.read(min(1 << 18, b - at) * width), self.kind).astype(number)
                    columns = {"idx": np.arange(at, at + len(values)), "value": values}
                    if self.shape:
                        x, y, _ = self.shape
                        columns |= {"x": columns["idx"] % x, "y": columns["idx"] // x % y, "z": columns["idx"] // (x * y)}
                        inside = np.logical_and.reduce([(columns[c] >= getattr(self.box, c)[0]) & (columns[c] <= getattr(self.box, c)[1]) for c in "xyz"])
                        columns = {c: v[inside] for c, v in columns.items()}
                    n = len(columns["idx"])
                    yield pa.RecordBatch.from_arrays([pa.array([r.file] * n, pa.string()), *map(pa.array, columns.values())], names=["file", *columns])


class RawArray(DataSource):
    """spark.read.format("rawarray"): the values of raw array files, with bounds of the index, or of x, y and z, taken to the bytes that are read.

    Options: ``dtype``, numpy's name of the type; ``shape``, as 3600x1800x1, x fastest;
    ``partBytes``; ``files``, a JSON list of names and sizes in place of what is at the path.
    """

    @classmethod
    def name(cls) -> str:
        return "rawarray"

    def schema(self) -> str:
        value = "double" if np.dtype(self.options.get("dtype", "<f4")).kind == "f" else "long"
        return f"file string, idx long, value {value}" + (", x long, y long, z long" if self.options.get("shape") else "")

    def reader(self, schema: T.StructType) -> RawArrayReader:
        return RawArrayReader(self.options)


def read_array(spark: SparkSession, path: str, dtype: str = "<f4", files: str = "*", part: int = 1 << 26, shape: tuple[int, int, int] | None = None, **unused: int) -> DataFrame:
    """(file, idx, value), and x, y, z where a shape is given, of raw array files of any size.

    Filters on the index and the places become byte ranges.  Files that only
    Spark's readers can open are rows of the binaryFile source, which holds up to 2 GB.
    """
    found = listed(spark, path, files)
    if openable(path):
        reader = registered(spark, RawArray).read.format("rawarray").option("files", as_option(found)).option("dtype", dtype).option("partBytes", part)
        return (reader.option("shape", "x".join(map(str, shape))) if shape else reader).load()
    kind = np.dtype(dtype)
    whole = spark.read.format("binaryFile").option("pathGlobFilter", files).load(path).select("path", "content")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(data) % kind.itemsize:
                    raise ValueError(f"{name} is no whole number of {dtype} values")
                values = np.frombuffer(data, kind)
                for at in range(0, len(values), 1 << 16):
                    some = values[at : at + (1 << 16)].astype(np.float64 if kind.kind == "f" else np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(np.arange(at, at + len(some))), pa.array(some)], names=["file", "idx", "value"])

    out = whole.mapInArrow(held, f"file string, idx long, value {'double' if kind.kind == 'f' else 'long'}")
    return with_place(out, shape) if shape else out


def write_array(df: DataFrame, path: str, dtype: str = "<f4", size: int = 1 << 20, idx: str = "idx", value: str = "value") -> None:
    """One raw file of the values in the index's order, from 0 without gaps: every task writes its chunks to their places."""
    kind = np.dtype(dtype)
    rows = chunks(df, dtype, size, idx, value)
    parts.write_at(rows.select((F.col("chunk") * (size * kind.itemsize)).alias("at"), "data"), path, df.count() * kind.itemsize)


def with_place(df: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """x, y and z from the linear index, x fastest."""
    x, y, _ = shape
    return df.withColumns({"x": F.col("idx") % x, "y": F.floor(F.col("idx") / x) % y, "z": F.floor(F.col("idx") / (x * y))})


def chunks(df: DataFrame, dtype: str = "<f4", size: int = 1 << 16, idx: str = "idx", value: str = "value") -> DataFrame:
    """(chunk, data): the values in order, as raw bytes; a sink writes them after each other."""
    kind = np.dtype(dtype)

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column(idx).to_numpy(), kind="stable")
        return pa.table({"chunk": table.column("chunk")[:1], "data": pa.array([table.column(value).to_numpy()[order].astype(kind).tobytes()], pa.binary())})

    return df.select(F.floor(F.col(idx) / size).alias("chunk"), F.col(idx).alias(idx), F.col(value).alias(value)).groupBy("chunk").applyInArrow(run, "chunk long, data binary")


def embedding_cells(embeddings: DataFrame) -> DataFrame:
    """The embeddings as a 2-D array: x along the vector, y by vec_id."""
    return embeddings.select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "value")).select(F.col("x").cast("long"), "y", F.col("value").cast("double").alias("value"))


def embedding_cube(embeddings: DataFrame) -> DataFrame:
    """The same values as a 3-D array of 8 x 8 x vectors."""
    return embedding_cells(embeddings).select((F.col("x") % 8).alias("x"), F.floor(F.col("x") / 8).alias("y"), F.col("y").alias("z"), "value")
