"""Window matching in blocks of 4 KiB.

At each place of a block one forward sweep over the window of the 255 bytes
before it looks for a match that starts in the window and stays before the place;
after a mismatch the sweep goes on with the next window byte and the first byte
again, without going back.  The longest match wins, the earliest on ties.
Blocks are then cut greedily into literals and (length, distance) pairs of two
or more bytes, with a flag bit each, lowest bit first.  Blocks are independent,
so they are the unit of work; the last one is filled with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import dense_id, running_sum

BLOCK, WINDOW, LEAST = 4096, 255, 2


def matches(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and distance of the match at each place: all places sweep together, one window step at a time."""
    n = len(block)
    place = np.arange(n)
    best, away = np.zeros(n, np.int64), np.zeros(n, np.int64)
    run, first = np.zeros(n, np.int64), np.zeros(n, np.int64)
    start = np.maximum(place - WINDOW, 0)
    for step in range(WINDOW):
        at = start + step
        ahead = place + run
        live = (at < place) & (ahead < n)
        same = live & (block[np.minimum(ahead, n - 1)] == block[np.minimum(at, n - 1)])
        first = np.where(same & (run == 0), place - at, first)
        ended = live & ~same & (run > 0)
        better = ended & (run > best)
        best, away = np.where(better, run, best), np.where(better, first, away)
        run = np.where(same, run + 1, np.where(ended, 0, run))
    better = run > best
    return np.where(better, run, best), np.where(better, first, away)


def _orbit(then: np.ndarray) -> np.ndarray:
    """Which places are come by from 0, going from each to then[place]; the last place stays where it is."""
    seen = np.zeros(len(then), bool)
    seen[0] = True
    for _ in range(len(then).bit_length()):
        seen[then[seen]] = True
        then = then[then]  # twice as far with every round
    return seen


def compress(data: bytes) -> tuple[bytes, bytes]:
    """Flags and tokens of one block."""
    block = np.frombuffer(data.ljust(BLOCK, b"\0"), np.uint8)
    length, away = matches(block)
    pair = length >= LEAST
    then = np.append(np.minimum(np.arange(len(block)) + np.where(pair, length, 1), len(block)), len(block))
    at = np.flatnonzero(_orbit(then)[:-1])
    own = pair[at]
    place = np.cumsum(1 + own) - 1 - own
    out = np.empty(int((1 + own).sum()), np.uint8)
    out[place] = np.where(own, length[at], block[at])
    out[place[own] + 1] = away[at][own]
    return np.packbits(own, bitorder="little").tobytes(), out.tobytes()


def expand(flags: bytes, tokens: bytes, size: int = BLOCK) -> bytes:
    """The block of its flags and tokens: places that repeat others point to them, and pointers are followed twice as far with every round."""
    pair = np.unpackbits(np.frombuffer(flags, np.uint8), bitorder="little").astype(np.int64)
    raw = np.frombuffer(tokens, np.uint8)
    at = np.cumsum(1 + pair) - 1 - pair
    pair, at = pair[at < len(raw)], at[at < len(raw)]  # the last flags byte may have flags of no token
    length = np.where(pair, raw[at], 1).astype(np.int64)
    away = np.where(pair, raw[np.minimum(at + 1, len(raw) - 1)], 0)
    start = np.cumsum(length) - length
    length = np.minimum(length, np.maximum(size - start, 0))
    token = np.repeat(np.arange(len(at)), length)
    place = np.arange(len(token))
    source = place - away[token]
    while (source[source] != source).any():
        source = source[source]
    return raw[at[token]][source].tobytes()


def blocks(df: DataFrame, data: str, keys: list[str]) -> DataFrame:
    """(keys, block_id, data) of binary values cut into blocks."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / BLOCK))
    rows = df.select(*keys, data, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block_id"))
    return rows.select(*keys, "block_id", F.substring(F.col(data), (F.col("block_id") * BLOCK + 1).cast("int"), F.lit(BLOCK)).alias("data"))


def _map(df: DataFrame, keys: list[str], columns: list[str], work, names: list[str]) -> DataFrame:
    src = df.select(*keys, *columns)
    schema = ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keys), *(f"{c} binary" for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [work(*x) for x in zip(*(b.column(i).to_pylist() for i in range(len(keys), len(keys) + len(columns))), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), *(pa.array([g[i] for g in got], pa.binary()) for i in range(len(names)))], names=[*keys, *names])

    return src.mapInArrow(run, schema)


def compressed(block_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block_id, flags, tokens)."""
    return _map(block_rows, [*keys, "block_id"], ["data"], lambda d: compress(d), ["flags", "tokens"])


def expanded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block_id, data), blocks being full."""
    return _map(rows, [*keys, "block_id"], ["flags", "tokens"], lambda f, t: (expand(f, t),), ["data"])


def with_offsets(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with the places at which their flags and tokens begin, per `keys`, when all blocks' flags, and all tokens, are put after each other."""
    sizes = {"flags_at": F.octet_length("flags").cast("long"), "tokens_at": F.octet_length("tokens").cast("long")}
    return running_sum(rows, order, sizes, by=keys, exclusive=True)


def streamed(rows: DataFrame, order: str) -> DataFrame:
    """(segment, part, data): the blocks' flags after each other, and their tokens, in the order of a unique key."""
    numbered = dense_id(rows.select(order, "flags", "tokens"), order, "part")
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("segment"), F.col(c).alias("data")) for c in ("flags", "tokens")]))
    return numbered.select("part", pair.alias("s")).select("s.segment", "part", "s.data")


def from_stream(parts: DataFrame) -> DataFrame:
    """(part, flags, tokens) of such a stream's parts."""
    one = lambda c: parts.where(F.col("segment") == c).select("part", F.col("data").alias(c))
    return one("flags").join(one("tokens"), "part")


def fixed_width(df: DataFrame, segment: str, key: str, width: int, rows_a_block: int = 1 << 14) -> DataFrame:
    """(part, data): a string column as fixed-width bytes filled with zeros, in the key's order, in parts of whole rows."""
    def join(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column(key).to_numpy(), kind="stable")
        values = table.column(segment).to_pylist()
        return pa.table({"part": table.column("part")[:1], "data": pa.array([b"".join((values[i] or "").encode()[:width].ljust(width, b"\0") for i in order)], pa.binary())})

    return df.select(F.floor(F.col(key) / rows_a_block).alias("part"), key, segment).groupBy("part").applyInArrow(join, "part long, data binary")
