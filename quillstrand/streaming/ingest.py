"""FASTQ files as a stream: whole ones as they arrive, or files that grow.

Where files are the unit (`read_stream`), each arriving file is
one row of the stream, and is cut into records in the task that reads it.  This keeps
the stream free of state.  Files are opened in the task, through Arrow's file systems,
and read a piece of some megabytes at a time; those that only Spark's readers can open
come as rows of the binaryFile source and are cut into such pieces.

Files that are appended to (`read_growing`) are read on from where the last batch ended,
which the checkpoint holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.fastq import PIECE, RANGE, ROLES, Fastq, records_in
from ..sources.files import openable, pieces, registered

SCHEMA = "file string, rec_id long, identifier string, bases string, plus string, quality string"
_FILE = "path string, modificationTime timestamp, length long, content binary"


def _batches(path: str, pieces: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Records of a file that comes in pieces."""
    done = 0
    for starts, _, columns in records_in(pieces, path, 0, 1 << 62):
        n = len(starts)
        yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(done, done + n), pa.int64()), *columns], names=["file", "rec_id", *ROLES])
        done += n


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            own = memoryview(data.as_buffer())
            yield from _batches(path, (bytes(own[at : at + PIECE]) for at in range(0, len(own), PIECE)))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column(0).to_pylist():
            yield from _batches(path, pieces(path))


def read_stream(spark: SparkSession, folder: str, pattern: str = "*.fastq", files_a_trigger: int = 100, **unused: int) -> DataFrame:
    """Records of files as they arrive."""
    raw = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_trigger).load(folder)
    if openable(folder):
        return raw.select("path").mapInArrow(_opened, SCHEMA)
    return raw.select("path", "content").mapInArrow(_held, SCHEMA)


def read_growing(spark: SparkSession, folder: str, range_bytes: int = RANGE) -> DataFrame:
    """Records of files that arrive and are appended to, with the byte at which each begins; a record comes when it is whole."""
    return registered(spark, Fastq).readStream.format("fastq").option("rangeBytes", range_bytes).load(folder).select("file", "start", *ROLES)


def write_stream(records: DataFrame, path: str, checkpoint: str):
    """Append records to a Parquet folder, once for everything there is."""
    return records.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
