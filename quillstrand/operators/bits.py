"""Bases in two bits, addressed by their place in the whole column.

The column is cut into blocks of ``BLOCK`` bases.  Every batch of reads packs
its own bases; where a block or a byte is shared by several batches, the parts
are put over each other.  A block's row also has its exceptions: bases that two
bits cannot say, with their places in the block.  So bases are never rows, and
what is shuffled is a quarter of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BASES
from . import flat
from .flat import map_bytes, stretches, where_bytes

#: Bases of a block.
BLOCK = 1 << 18
CODES = np.zeros(256, np.uint8)
CODES[list(BASES.encode())] = range(4)
OTHER = np.ones(256, bool)
OTHER[list(BASES.encode())] = False
BLOCKS = "block_id long, data binary, places binary, others binary"


def blocks(records: DataFrame, key: str = "rec_id", text: str = "bases") -> DataFrame:
    """(block_id, data, places, others): packed bases, and places (32-bit) and bytes of the exceptions, of each block."""

    def parts(place: np.ndarray, raw: np.ndarray) -> dict[str, pa.Array] | None:
        if not len(place):
            return None
        order = np.argsort(place, kind="stable") if (np.diff(place) < 0).any() else slice(None)
        place, raw = place[order], raw[order]
        out: dict[str, list] = {c: [] for c in ("block_id", "first", "data", "places", "others")}
        cuts = stretches(place, BLOCK)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at, own = place[a:b] % BLOCK, raw[a:b]
            first = int(at[0]) // 4
            codes = np.zeros(-(-(int(at[-1]) + 1) // 4) * 4 - 4 * first, np.uint8)
            codes[at - 4 * first] = CODES[own]
            other = OTHER[own]
            out["block_id"].append(int(place[a]) // BLOCK)
            out["first"].append(first)
            out["data"].append((codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes())
            out["places"].append(at[other].astype("<u4").tobytes())
            out["others"].append(own[other].tobytes())
        kinds = {"block_id": pa.int64(), "first": pa.int32()}
        return {c: pa.array(v, kinds.get(c, pa.binary())) for c, v in out.items()}

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, data, places, others = None, None, [], []

        def row() -> pa.RecordBatch:
            at = np.frombuffer(b"".join(places), "<u4")
            order = np.argsort(at, kind="stable")
            filled = np.frombuffer(b"".join(others), np.uint8)[order]
            return pa.RecordBatch.from_arrays([pa.array([now]), *(pa.array([x], pa.binary()) for x in (data.tobytes(), at[order].tobytes(), filled.tobytes()))], names=["block_id", "data", "places", "others"])

        for batch in batches:
            for block, first, d, p, o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    if now is not None:
                        yield row()
                    now, data, places, others = block, np.zeros(0, np.uint8), [], []
                part = np.frombuffer(d, np.uint8)
                if first + len(part) > len(data):
                    data = np.concatenate([data, np.zeros(first + len(part) - len(data), np.uint8)])
                data[first : first + len(part)] |= part
                places.append(p)
                others.append(o)
        if now is not None:
            yield row()

    cut = map_bytes(records, text, key, parts, "block_id long, first int, data binary, places binary, others binary")
    return cut.repartition("block_id").sortWithinPartitions("block_id", "first").mapInArrow(whole, BLOCKS)


def packed(records: DataFrame, key: str = "rec_id") -> DataFrame:
    """(byte_id, byte): four bases a byte, the first in the lowest bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(data, np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(block * (BLOCK // 4) + np.arange(len(own))), pa.array(own.astype(np.int32))], names=["byte_id", "byte"])

    return blocks(records, key).select("block_id", "data").mapInArrow(run, "byte_id long, byte int")


def exceptions(records: DataFrame, key: str = "rec_id") -> DataFrame:
    """(g, base) of all that two bits cannot say: N, small letters, ambiguity codes."""
    return where_bytes(records, "bases", key, OTHER).select(F.col("pos").alias("g"), F.char("symbol").alias("base"))


def unpack(data: bytes, places: bytes, others: bytes) -> np.ndarray:
    """The bytes of a block's bases; up to three more where the last byte is not full."""
    own = np.frombuffer(data, np.uint8)
    out = np.frombuffer(BASES.encode(), np.uint8)[(own[:, None] >> np.array([0, 2, 4, 6], np.uint8)).ravel() & 3]
    out[np.frombuffer(places, "<u4")] = np.frombuffer(others, np.uint8)
    return out


def reassembled(block_rows: DataFrame, lengths: DataFrame, key: str = "rec_id", text: str = "bases") -> DataFrame:
    """(key, text) from blocks and the records' lengths and offsets."""
    return flat.reassembled(block_rows, ["data", "places", "others"], lambda *block: unpack(*block).tobytes(), lengths, BLOCK, key, text)


def sizes(records: DataFrame) -> DataFrame:
    """One row: bases, bits, bytes, exceptions, and bytes with four for each exception's place."""
    n = F.coalesce(F.sum(F.octet_length("bases").cast("long")), F.lit(0))
    other = F.coalesce(F.sum(F.length(F.translate("bases", "ACGT", "")).cast("long")), F.lit(0))
    out = records.agg(n.alias("n_bases"), other.alias("n_exceptions"))
    packed_bytes = F.floor((F.col("n_bases") * 2 + 7) / 8)
    return out.select("n_bases", (F.col("n_bases") * 2).alias("bits"), packed_bytes.alias("packed_bytes"), "n_exceptions", (packed_bytes + 4 * F.col("n_exceptions")).alias("total_bytes"))
