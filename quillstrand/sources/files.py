"""Files of any size, as lists and byte ranges."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, InputPartition

#: Suffixes of files that can only be read from their beginning.
PACKED = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd", ".lz4": "lz4"}


@dataclass
class Range(InputPartition):
    """Bytes from `a` to `b` of a file of `size` bytes; `number` counts the file's ranges."""

    file: str
    size: int
    number: int
    a: int
    b: int


def listed(spark: SparkSession, path: str, files: str = "*") -> DataFrame:
    """(path, length) of the files that Spark finds at a path; nothing is read of them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", files).load(path).select("path", "length")


def openable(path: str) -> bool:
    """Whether tasks can open the path themselves; if not, only Spark's readers can."""
    try:
        fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    except (OSError, ValueError, ImportError):
        return False
    return True


def as_option(found: DataFrame) -> str:
    """A list of files that is made once, so that every plan with it reads the same bytes."""
    return json.dumps(sorted((r["path"], r["length"]) for r in found.collect()))  # a row a file


def files_of(options: dict) -> list[tuple[str, int]]:
    """Files and sizes of a source: the list that the caller made, or what is at the path now."""
    if options.get("files"):
        return [tuple(x) for x in json.loads(options["files"])]
    path = options["path"]
    system, where = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    info = system.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(where))
    begin = path[: len(path) - len(where)] if path.endswith(where) else "file://"
    return sorted((begin + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def cut(files: list[tuple[str, int]], size: int, unit: int = 1) -> list[Range]:
    """Ranges of about `size` bytes, whole multiples of `unit`; packed files are one range."""
    size = max(unit, size - size % unit)
    out = []
    for name, length in files:
        if name[name.rfind(".") :] in PACKED:
            out.append(Range(name, length, 0, 0, 1 << 62))
            continue
        out += [Range(name, length, k, a, min(a + size, length)) for k, a in enumerate(range(0, length, size))]
    return out


def pieces(name: str, at: int = 0, piece: int = 1 << 22) -> Iterator[bytes]:
    """The bytes of a file from `at` on, a piece at a time."""
    system, where = fs.FileSystem.from_uri(name)
    kind = PACKED.get(name[name.rfind(".") :])
    if kind:
        with system.open_input_stream(where, compression=kind) as f:
            while data := f.read(piece):
                yield data
        return
    with system.open_input_file(where) as f:
        f.seek(at)
        while data := f.read(piece):
            yield data


def registered(spark: SparkSession, *sources: type[DataSource]) -> SparkSession:
    """The session, which now knows these sources, and hands them filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in sources:
        spark.dataSource.register(s)
    return spark
