"""Bit planes with zero groups left out, in chunks of 2048 16-bit codes.

A chunk is 32 rows of 32 words of 32 bits.  Its planes hold, for each bit and
each row, that bit of the row's words; 256 flags tell which groups of four plane words
are not all zero, and only those are kept.  Chunks are ordered by their number, and
their places follow from a running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dealt
from .groups import whole_groups

CODES = 2048


def planes_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plane words [chunk, group, 4] of whole chunks [chunk, code], and which groups are not all zero."""
    words = np.ascontiguousarray(codes.astype("<u2"))
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 32, 32, 4), axis=3, bitorder="little")  # chunk, row, word, bit
    planes = np.packbits(bits.transpose(0, 3, 1, 2), axis=3, bitorder="little").reshape(len(codes), -1).view("<u4").reshape(-1, 256, 4)
    return planes, planes.any(2)


def codes_of(planes: np.ndarray) -> np.ndarray:
    """Codes [chunk, code] of plane words."""
    bits = np.unpackbits(np.ascontiguousarray(planes).reshape(len(planes), -1).view(np.uint8).reshape(-1, 32, 32, 4), axis=3, bitorder="little")  # chunk, bit, row, word
    return np.packbits(bits.transpose(0, 2, 3, 1), axis=3, bitorder="little").reshape(len(planes), -1).view("<u2")


def encode(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Flags (32 bytes) and kept words of one chunk, filled up with zeros."""
    words = np.zeros((1, CODES), "<u2")
    words[0, : len(codes)] = codes
    planes, keep = planes_of(words)
    return np.packbits(keep[0], bitorder="little").tobytes(), planes[keep].tobytes()


def decode(flags: bytes, words: bytes) -> np.ndarray:
    keep = np.unpackbits(np.frombuffer(flags, np.uint8), bitorder="little").astype(bool)
    planes = np.zeros((1, 256, 4), "<u4")
    planes[0, keep] = np.frombuffer(words, "<u4").reshape(-1, 4)
    return codes_of(planes)[0]


def encoded(df: DataFrame, idx: str, code: str, total: int | None = None) -> DataFrame:
    """(chunk_id, n, flags, words) of codes by index; the index has no gaps, and codes are counted if their number is not given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chunk, at, code), group in whole_groups(batches, 1):
            n = np.bincount(group)
            codes = np.zeros((len(n), CODES), "<u2")
            codes[group, at % CODES] = code
            planes, keep = planes_of(codes)
            kept = planes[keep]
            ends = np.cumsum(keep.sum(1))
            flags = np.packbits(keep, axis=1, bitorder="little")
            words = [kept[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(chunk[first]), pa.array(n), pa.array([f.tobytes() for f in flags], pa.binary()), pa.array(words, pa.binary())], names=["chunk_id", "n", "flags", "words"])

    rows = df.select(F.floor(F.col(idx) / CODES).alias("chunk_id"), F.col(idx).cast("long").alias("idx"), F.col(code).cast("int").alias("code"))
    return dealt(rows, total, "chunk_id").sortWithinPartitions("chunk_id").mapInArrow(run, "chunk_id long, n long, flags binary, words binary")


def decoded(chunks: DataFrame, idx: str = "idx", code: str = "code") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                chunk, n, flags, words = (b.column(i).slice(at, 256) for i in range(4))
                keep = np.unpackbits(np.frombuffer(b"".join(flags.to_pylist()), np.uint8).reshape(-1, 32), axis=1, bitorder="little").astype(bool)
                planes = np.zeros((len(keep), 256, 4), "<u4")
                planes[keep] = np.frombuffer(b"".join(words.to_pylist()), "<u4").reshape(-1, 4)
                inside = np.arange(CODES)[None] < n.to_numpy()[:, None]
                place = chunk.to_numpy()[:, None] * CODES + np.arange(CODES)[None]
                yield pa.RecordBatch.from_arrays([pa.array(place[inside]), pa.array(codes_of(planes)[inside].astype(np.int32))], names=[idx, code])

    return chunks.select("chunk_id", "n", "flags", "words").mapInArrow(run, f"`{idx}` long, `{code}` int")
