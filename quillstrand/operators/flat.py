"""Bytes of text columns as flat arrays with their places in the whole column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches
from .scan import running_sum


def with_offsets(records: DataFrame, text: str = "bases", key: str = "rec_id") -> DataFrame:
    """records with the length of a text in bytes and the exclusive sum of lengths before it; a null text has none."""
    length = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return running_sum(records.withColumn("length", length), key, {"offset": F.col("length")}, exclusive=True)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a binary column's values, from 0 on, and their bytes after each other; a null has none."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw


def placed(offsets: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The place in the whole column of every byte of a batch, and the bytes."""
    at, raw = flat(column)
    return np.repeat(offsets - at[:-1], np.diff(at)) + np.arange(len(raw)), raw


def map_bytes(records: DataFrame, text: str, key: str, work: Callable[[np.ndarray, np.ndarray], dict[str, pa.Array] | None], schema: str) -> DataFrame:
    """What `work` makes of (places, bytes) of each batch, in columns."""
    bound_batches(records.sparkSession)
    src = with_offsets(records.select(key, text), text, key).select("offset", F.col(text).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(*placed(batch.column(0).to_numpy(), batch.column(1)))) is not None:
                yield pa.RecordBatch.from_pydict(out)

    return src.mapInArrow(run, schema)


def counts_by_chunk(records: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(chunk_id, symbol, n): how often each byte occurs in each `size` bytes of the whole column."""

    def work(place: np.ndarray, raw: np.ndarray) -> dict[str, pa.Array]:
        both, n = np.unique(place // size << 8 | raw, return_counts=True)
        return {"chunk_id": pa.array(both >> 8), "symbol": pa.array((both & 255).astype(np.int32)), "n": pa.array(n)}

    return map_bytes(records, text, key, work, "chunk_id long, symbol int, n long").groupBy("chunk_id", "symbol").agg(F.sum("n").alias("n"))


def where_bytes(records: DataFrame, text: str, key: str, wanted: np.ndarray) -> DataFrame:
    """(pos, symbol) of the bytes that the table `wanted` (256 flags) has."""

    def work(place: np.ndarray, raw: np.ndarray) -> dict[str, pa.Array]:
        some = wanted[raw]
        return {"pos": pa.array(place[some]), "symbol": pa.array(raw[some].astype(np.int32))}

    return map_bytes(records, text, key, work, "pos long, symbol int")


def stretches(place: np.ndarray, size: int) -> np.ndarray:
    """Bounds of the stretches of a sorted array that neighbour without gaps and stay in one block of `size`."""
    cut = np.flatnonzero((np.diff(place) != 1) | (place[1:] % size == 0)) + 1
    return np.concatenate([[0], cut, [len(place)]])


def byte_blocks(records: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(block_id, data): the bytes of a whole text column, `size` of them a row, however long single texts are."""

    def parts(place: np.ndarray, raw: np.ndarray) -> dict[str, pa.Array] | None:
        if not len(place):
            return None
        order = np.argsort(place, kind="stable") if (np.diff(place) < 0).any() else slice(None)
        place, raw = place[order], raw[order]
        cuts = stretches(place, size)
        own = [raw[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return {"block_id": pa.array(place[cuts[:-1]] // size), "first": pa.array(place[cuts[:-1]] % size), "data": pa.array(own, pa.binary())}

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([b"".join(held)], pa.binary())], names=["block_id", "data"])
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if block != now:
                    if held:
                        yield row()
                    now, held = block, []
                held.append(data)
        if held:
            yield row()

    cut = map_bytes(records, text, key, parts, "block_id long, first long, data binary")
    return cut.repartition("block_id").sortWithinPartitions("block_id", "first").mapInArrow(joined, "block_id long, data binary")


def reassembled(block_rows: DataFrame, columns: list[str], unpack: Callable[..., bytes], lengths: DataFrame, size: int, key: str = "rec_id", text: str = "bases") -> DataFrame:
    """(key, text) from blocks of `size` bytes, which `unpack` makes of their columns, and the texts' lengths and offsets."""
    kind = lengths.schema[key].dataType
    first, last = F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.col("length") - 1) / size)
    places = lengths.where("length > 0").select(key, "offset", "length", F.explode(F.sequence(first, last)).alias("block_id"), (first != last).alias("several"))
    places = places.select("block_id", key, F.greatest(F.col("offset") - F.col("block_id") * size, F.lit(0)).alias("a"), F.least(F.col("offset") + F.col("length") - F.col("block_id") * size, F.lit(size)).alias("b"), "several")
    schema = T.StructType([T.StructField(key, kind), T.StructField("block_id", T.LongType()), T.StructField("several", T.BooleanType()), T.StructField("part", T.StringType())])

    def run(own: pa.Table, data: pa.Table) -> pa.Table:
        if not own.num_rows or not data.num_rows:
            return pa.table({f.name: pa.array([], t) for f, t in zip(schema.fields, (own.schema.field(key).type, pa.int64(), pa.bool_(), pa.string()), strict=True)})
        raw = unpack(*(data.column(c)[0].as_py() for c in columns))
        # a part may begin or end within a character: bytes stand as characters of their own until texts are whole
        parts = [raw[a:b].decode("latin-1") for a, b in zip(own.column("a").to_pylist(), own.column("b").to_pylist(), strict=True)]
        return pa.table({key: own.column(key), "block_id": own.column("block_id"), "several": own.column("several"), "part": pa.array(parts, pa.string())})

    # a group is one block, and the texts that touch it
    made = places.groupBy("block_id").cogroup(block_rows.groupBy("block_id")).applyInArrow(run, schema)
    whole = lambda c: F.encode(c, "iso-8859-1").cast("string").alias(text)
    ordered = F.array_sort(F.collect_list(F.struct("block_id", "part")))["part"]
    long = made.where("several").groupBy(key).agg(F.array_join(ordered, "").alias("part")).select(key, whole(F.col("part")))
    short = made.where("not several").select(key, whole(F.col("part")))
    return short.unionByName(long).unionByName(lengths.where("length = 0").select(key, F.lit("").alias(text)))
