"""Canonical Huffman coding: histogram, book on the driver, chunks in tasks.

Trees are not unique on ties; here the lighter node comes first and, of equal
weight, the one with the smaller least symbol, so that books are the same on
every run.  A book has as many entries as there are symbols, whatever the data's size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import byte_blocks, flat, reassembled, where_bytes
from .scan import running_sum

#: Symbols of a lane, which decodes on its own.
LANE = 256
#: Symbols up to which lengths come from a heap; of larger alphabets batches of nodes are merged.
HEAP = 1 << 13
#: Bytes of a chunk of texts.
CHUNK = 1 << 18
#: Longest codes of 32-bit and 64-bit words.
LONGEST = {32: 27, 64: 58}


def histogram(symbols: DataFrame, symbol: str, bins: int, smooth: int = 0) -> DataFrame:
    """(symbol, n) of all bins; smooth is added to each, so that every symbol gets a code."""
    counts = symbols.groupBy(F.col(symbol).cast("int").alias("symbol")).agg(F.count("*").alias("n"))
    return symbols.sparkSession.range(bins).select(F.col("id").cast("int").alias("symbol")).join(counts, "symbol", "left").select("symbol", (F.coalesce("n", F.lit(0)) + smooth).cast("long").alias("n"))


def byte_histogram(texts: DataFrame, text: str, bins: int = 256, smooth: int = 0, where: Column | None = None) -> DataFrame:
    """The histogram of texts' bytes, counted per batch before anything is shuffled."""
    src = texts.where(where) if where is not None else texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(flat(b.column(0))[1], minlength=256)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["symbol", "n"])

    parts = src.select(F.col(text).cast("binary")).mapInArrow(run, "symbol int, n long")
    counts = parts.groupBy("symbol").agg(F.sum("n").alias("n"))
    return texts.sparkSession.range(bins).select(F.col("id").cast("int").alias("symbol")).join(counts, "symbol", "left").select("symbol", (F.coalesce("n", F.lit(0)) + smooth).cast("long").alias("n"))


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code length per symbol of positive count; a single symbol gets one bit."""
    heap = [(n, s, (s,)) for s, n in counts.items() if n > 0]
    if len(heap) > HEAP:
        order = sorted((n, s) for n, s, _ in heap)
        return {s: int(k) for (_, s), k in zip(order, lengths_in_rounds(np.array([n for n, _ in order])), strict=True)}
    if len(heap) == 1:
        return {heap[0][1]: 1}
    depth = dict.fromkeys((s for _, s, _ in heap), 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*a[2], *b[2]):
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), (*a[2], *b[2])))
    return depth


def lengths_in_rounds(weights: np.ndarray) -> np.ndarray:
    """Code lengths for weights in rising order, whole batches of nodes at a time: for alphabets that are too large for a heap.

    A node of the two least weighs `most`; all nodes up to that weight are pairs of neighbours
    at once, as none of their sums can come between them.  The sums, in order already, are
    merged with the nodes that are left.  From the root down, a node's children are one longer than it.
    """
    n = len(weights)
    if n < 2:
        return np.ones(n, np.int64)
    own, number = weights.astype(np.int64), np.arange(n)
    parent, made = np.zeros(2 * n - 1, np.int64), n
    while len(own) > 1:
        k = int(np.searchsorted(own, own[0] + own[1], "right"))
        k -= k % 2
        sums, new = own[:k:2] + own[1:k:2], np.arange(made, made + k // 2)
        parent[number[:k]] = np.repeat(new, 2)
        made += k // 2
        # merge of two sorted lists: each node's place is its own and how many of the other list come before it
        left, names = own[k:], number[k:]
        at_left = np.arange(len(left)) + np.searchsorted(sums, left, "left")
        at_sums = np.arange(len(sums)) + np.searchsorted(left, sums, "right")
        own, number = np.empty(len(left) + len(sums), np.int64), np.empty(len(left) + len(sums), np.int64)
        own[at_left], own[at_sums], number[at_left], number[at_sums] = left, sums, names, new
    # lengths by pointer doubling: how far the root is
    far, up = np.ones(2 * n - 1, np.int64), parent
    far[2 * n - 2], up[2 * n - 2] = 0, 2 * n - 2
    while (up != 2 * n - 2).any():
        far, up = far + far[up], up[up]
    return far[:n]


def limited_lengths(counts: dict[int, int], most: int) -> dict[int, int]:
    """The code lengths of least cost that are `most` at most, by package-merge.

    On each of `most` levels, symbols and pairs of the level before are merged by
    weight; of the last level the first 2n - 2 are taken, and the symbols that
    they are made of get a bit for each time.  On equal weights symbols come before
    pairs, and lesser symbols first.
    """
    order = sorted((n, s) for s, n in counts.items() if n > 0)
    if len(order) < 2:
        return {s: 1 for _, s in order}
    if len(order) > 1 << most:
        raise ValueError(f"{len(order)} symbols have no codes of at most {most} bits")
    own = np.array([n for n, _ in order], np.int64)
    pairs, single = own[:0], []
    for _ in range(most):
        both = np.concatenate([own, pairs])
        at = np.argsort(both, kind="stable")
        single.append(at < len(own))
        both = both[at][: len(both) // 2 * 2]
        pairs = both[::2] + both[1::2]
    lengths, need = np.zeros(len(order), np.int64), 2 * len(order) - 2
    for flags in reversed(single):
        n = int(flags[:need].sum())
        lengths[:n] += 1
        need = 2 * (need - n)
    return {s: int(k) for (_, s), k in zip(order, lengths, strict=True)}


@dataclass(frozen=True)
class Book:
    """Canonical codes: symbol -> (code, length), and per length the first code and its place among the sorted symbols."""

    codes: dict[int, tuple[int, int]]
    first: dict[int, int]
    entry: dict[int, int]
    keys: tuple[int, ...]

    @property
    def longest(self) -> int:
        return max((n for _, n in self.codes.values()), default=0)

    def rows(self) -> list[tuple[int, int, int]]:
        return [(s, n, c) for s, (c, n) in sorted(self.codes.items())]


def first_codes(symbols: dict[int, int]) -> dict[int, int]:
    """The least code of each length up to the longest, by how many symbols each has."""
    first, at = {}, 0
    for n in range(max(symbols, default=0), 0, -1):
        first[n] = at
        at = -(-(at + symbols.get(n, 0)) // 2)
    return first


def canonical(lengths: dict[int, int], word: int = 32) -> Book:
    """Codes from lengths alone: the longest length starts at zero, and each shorter one after half of what the longer ones used."""
    most = max(lengths.values(), default=0)
    if most > LONGEST[word]:
        raise ValueError(f"a code of {most} bits does not fit a {word}-bit word; take {64 if word == 32 else 'fewer symbols or smoother counts'}")
    by: dict[int, list[int]] = {}
    for s in sorted(lengths):
        by.setdefault(lengths[s], []).append(s)
    first = first_codes({n: len(symbols) for n, symbols in by.items()})
    codes, entry, keys = {}, {}, []
    for n in range(1, most + 1):
        entry[n] = len(keys)
        for i, s in enumerate(by.get(n, ())):
            codes[s] = (first[n] + i, n)
            keys.append(s)
    return Book(codes, first, entry, tuple(keys))


def build(hist: DataFrame, word: int = 32, most: int | None = None) -> Book:
    """The book of a histogram of at most some thousand bins; no code is longer than `most`, which is what a word holds unless it is given."""
    counts = {r["symbol"]: r["n"] for r in hist.collect()}
    lengths, most = code_lengths(counts), most or LONGEST[word]
    return canonical(lengths if max(lengths.values(), default=0) <= most else limited_lengths(counts, most), word)


def book_frame(spark, book: Book) -> DataFrame:
    return spark.createDataFrame(book.rows(), "symbol int, length int, code long")


def chunk_bits(hist_by_chunk: DataFrame, book: DataFrame) -> DataFrame:
    """(chunk_id, nbit, ncell): bits and 32-bit cells, from counts by chunk."""
    rows = hist_by_chunk.join(F.broadcast(book.select("symbol", "length")), "symbol")  # a book is small
    return rows.groupBy("chunk_id").agg(F.sum(F.col("n") * F.col("length")).alias("nbit")).withColumn("ncell", F.floor((F.col("nbit") + 31) / 32))


def entries(chunks: DataFrame) -> DataFrame:
    """chunks with the cell at which each begins when they are put after each other."""
    return running_sum(chunks, "chunk_id", {"entry": F.col("ncell")}, exclusive=True)


def chunk_ratio(chunks: DataFrame, symbols: Column, width: int = 32) -> DataFrame:
    """chunks with their bytes before and after, symbols being `width` bits, and the ratio."""
    before, after = symbols * (width // 8), 4 * F.col("ncell")
    return chunks.select("chunk_id", before.alias("original"), after.alias("coded"), (before / after).alias("ratio"))


def tuned(n: int, cores: int, lanes: int = 128, unit: int = 256) -> tuple[int, int]:
    """Symbols of a chunk and number of chunks, so that every core has `lanes` chunks; chunks are whole multiples of `unit`."""
    share = -(-max(n, 1) // max(1, cores * lanes))
    size = -(-share // unit) * unit
    return size, -(-max(n, 1) // size)


def archive_size(ncell: Column, pardeg: int = 4096, bins: int = 256, symbol_bytes: int = 1) -> Column:
    """Header, reverse book, two words per chunk and the cells, in bytes."""
    return F.lit(128 + 4 * 64 + symbol_bytes * bins + 8 * pardeg) + 4 * ncell


def encode_chunk(symbols: np.ndarray, book: Book) -> tuple[int, bytes, bytes]:
    """Number of bits, the bits from the highest of each big-endian 32-bit cell on, and the bit at which each `LANE` symbols begin (32-bit)."""
    top = max(book.codes, default=0) + 1
    code, length = np.zeros(top, np.uint64), np.zeros(top, np.int64)
    for s, (c, n) in book.codes.items():
        code[s], length[s] = c, n
    if len(symbols) and (symbols.max() >= top or symbols.min() < 0):
        raise ValueError("a symbol has no code in this book")
    n = length[symbols]
    if (n == 0).any():
        raise ValueError("a symbol has no code in this book")
    return pack_codes(code[symbols], n)


def pack_codes(code: np.ndarray, n: np.ndarray) -> tuple[int, bytes, bytes]:
    """What `encode_chunk` gives, of codes (unsigned) and their lengths."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    if total >= 1 << 32:
        raise ValueError("a chunk of over 512 MB of code")
    # bit j of a code, counted from its end
    back = np.repeat(ends, n) - 1 - np.arange(total)
    bits = (np.repeat(code, n) >> back.astype(np.uint64)) & np.uint64(1)
    return total, np.packbits(bits.astype(np.uint8)).tobytes().ljust(-(-total // 32) * 4, b"\0"), (ends - n)[::LANE].astype("<u4").tobytes()


def decode_chunk(cells: bytes, n: int, marks: bytes, book: Book) -> np.ndarray:
    """The n symbols of a chunk."""
    sizes = {length for _, length in book.codes.values()}
    length, code = split_codes(cells, n, marks, {k: book.first[k] for k in sizes})
    place = np.zeros(book.longest + 1, np.int64)  # of a length's code 0 among the sorted symbols, were there one
    for k in sizes:
        place[k] = book.entry[k] - book.first[k]
    return np.array(book.keys, np.int64)[place[length] + code] if n else np.zeros(0, np.int64)


def split_codes(cells: bytes, n: int, marks: bytes, first: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and codes of a chunk's n symbols, from the least code of each length that has any: all its lanes go in step, a symbol each at a time.

    Left-justified, the codes of a length are a range of their own, and longer
    ones come lower: the place of what comes next among the ranges tells its length.
    """
    at = np.frombuffer(marks, "<u4").astype(np.int64)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = sorted(first, reverse=True)
    most = sizes[0]
    lowest, size = np.array([first[k] << (most - k) for k in sizes], np.uint64), np.array(sizes)
    word = np.concatenate([np.frombuffer(cells, ">u4").astype(np.uint64), np.zeros(3, np.uint64)])
    left = n - LANE * (len(at) - 1)
    length, code = np.zeros((2, len(at), LANE), np.int64)
    for step in range(min(n, LANE)):
        live = len(at) if left > step else len(at) - 1  # only the last lane may be shorter
        p = at[:live]
        cell, shift = p >> 5, (p & 31).astype(np.uint64)
        ahead = (word[cell] << np.uint64(32) | word[cell + 1]) << shift | word[cell + 2] >> (np.uint64(32) - shift)
        peek = ahead >> np.uint64(64 - most)
        n_bits = size[np.searchsorted(lowest, peek, "right") - 1]
        length[:live, step] = n_bits
        code[:live, step] = (peek >> (most - n_bits).astype(np.uint64)).astype(np.int64)
        at[:live] += n_bits
    return length.ravel()[:n], code.ravel()[:n]


def without_uncoded(texts: DataFrame, text: str, key: str, book: Book, replacement: int) -> tuple[DataFrame, DataFrame]:
    """(texts, sparse): bytes that the book lacks replaced, and those bytes by place (pos, symbol).

    Bytes over 127 are parts of characters: where the book lacks any of them, all are replaced and listed.
    """
    if replacement not in book.codes:
        raise ValueError("the replacement has no code either")
    uncoded = np.ones(256, bool)
    uncoded[[s for s in book.codes if s < 256]] = False
    uncoded[128:] = uncoded[128:].any()
    lacking = "".join(chr(s) for s in np.flatnonzero(uncoded[:128]))
    new = F.translate(text, lacking, chr(replacement) * len(lacking))
    if uncoded[128]:
        for size, some in ((2, r"[\x{80}-\x{7ff}]"), (3, r"[\x{800}-\x{ffff}]"), (4, r"[\x{10000}-\x{10ffff}]")):
            new = F.replace(F.regexp_replace(new, some, "\x00" * size), F.lit("\x00"), F.lit(chr(replacement)))
    return texts.withColumn(text, new), where_bytes(texts, text, key, uncoded)


def encoded(texts: DataFrame, text: str, key: str, book: Book, size: int = CHUNK) -> DataFrame:
    """(chunk_id, n, nbit, ncell, cells, marks): the bytes of texts in the key's order, `size` of them a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                nbit, cells, marks = encode_chunk(np.frombuffer(data, np.uint8), book)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([len(data)]), pa.array([nbit]), pa.array([len(cells) // 4]), pa.array([cells], pa.binary()), pa.array([marks], pa.binary())], names=["chunk_id", "n", "nbit", "ncell", "cells", "marks"])

    return byte_blocks(texts, text, key, size).mapInArrow(run, "chunk_id long, n long, nbit long, ncell long, cells binary, marks binary")


def decoded(chunks: DataFrame, lengths: DataFrame, book: Book, key: str = "rec_id", text: str = "quality", size: int = CHUNK) -> DataFrame:
    """(key, text) of chunks and the texts' lengths and offsets (`flat.with_offsets`)."""
    unpack = lambda cells, n, marks: decode_chunk(cells, n, marks, book).astype(np.uint8).tobytes()
    return reassembled(chunks.withColumnRenamed("chunk_id", "block_id"), ["cells", "n", "marks"], unpack, lengths, size, key, text)
