"""Canonical Huffman coding for alphabets of any size, such as words of bases or keys.

Symbols of the same weight are alike, so the tree is built over weights: the
driver sees a row for each different weight, of which there are at most
sqrt(2 * occurrences), and says how many symbols of each get which length.
Which they are is a matter of ranks, by scans over the symbols.  Codes of a
length are numbers in a row, so a decoder needs the least code of each length, at most
58 numbers; symbols come back by a join on length and code.  No task holds the book.

Edge cases: symbols are whole numbers of 64 bits; null ones are no symbols, and
in rows to encode they are an error, as are symbols without a code; a single symbol gets one bit; codes over 58
bits, which take more than 5e11 occurrences, are an error; no rows give no book and no chunks.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, join_hot, materialize
from .groups import whole_groups
from .huffman import LONGEST, first_codes, pack_codes, split_codes
from .scan import running_sum

#: Codes of a chunk.
CHUNK = 1 << 14


def class_lengths(weights: list[int], symbols: list[int]) -> list[list[tuple[int, int]]]:
    """For each weight, which rise, how many of its symbols get which code length: [(length, symbols)], shorter ones first.

    All nodes of the least weight are paired at once, as nothing lighter can come up any more; an
    odd one is paired with a node of the next weight.  From the root down, classes hand their depths on.
    """
    if sum(symbols) == 1:
        return [[(1, 1)]]
    left = list(symbols)
    parents: list[list[tuple[int, int]]] = [[] for _ in weights]  # a class's (parent class, children here of each of its nodes)
    heap = [(w, c) for c, w in enumerate(weights)]

    def made(weight: int, nodes: int) -> int:
        left.append(nodes)
        parents.append([])
        heapq.heappush(heap, (weight, len(left) - 1))
        return len(left) - 1

    while heap:
        w, a = heapq.heappop(heap)
        if left[a] > 1:
            parents[a].append((made(2 * w, left[a] // 2), 2))
            left[a] %= 2
            if left[a]:
                heapq.heappush(heap, (w, a))
        elif heap:
            v, b = heapq.heappop(heap)
            up = made(w + v, 1)
            parents[a].append((up, 1))
            parents[b].append((up, 1))
            left[b] -= 1
            if left[b]:
                heapq.heappush(heap, (v, b))
    depths: list[Counter[int]] = [Counter() for _ in left]
    if depths:
        depths[-1][0] = 1
    for c in range(len(left) - 2, -1, -1):
        for up, each in parents[c]:
            for depth, nodes in depths[up].items():
                depths[c][depth + 1] += each * nodes
    return [sorted(depths[c].items()) for c in range(len(weights))]


def weight_classes(counts: DataFrame) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(weight, symbols, [(length, symbols)]) of counts (symbol, n)."""
    rows = sorted((r["n"], r["symbols"]) for r in counts.groupBy("n").agg(F.count("*").alias("symbols")).collect())  # at most sqrt(2 * occurrences)
    lengths = class_lengths([n for n, _ in rows], [s for _, s in rows])
    return [(n, s, k) for (n, s), k in zip(rows, lengths, strict=True)]


def cost(counts: DataFrame) -> DataFrame:
    """One row: symbols, and the bits that all occurrences take."""
    classes = weight_classes(counts.where("n > 0"))
    row = (sum(s for _, s, _ in classes), sum(n * length * k for n, _, lengths in classes for length, k in lengths))
    return counts.sparkSession.createDataFrame([row], "symbols long, bits long")


def book(rows: DataFrame, symbol: str = "symbol") -> DataFrame:
    """(symbol, n, length, code) of the symbols that occur in rows; of equal weights, lesser symbols have the shorter codes."""
    spark = rows.sparkSession
    counts = materialize(rows.where(F.col(symbol).isNotNull()).groupBy(F.col(symbol).cast("long").alias("symbol")).agg(F.count("*").alias("n")), "counts")
    classes = weight_classes(counts)
    if not classes:
        return counts.select("symbol", "n", F.lit(0).alias("length"), F.lit(0).cast("long").alias("code"))
    of_length: Counter[int] = Counter()
    cuts = []
    for n, symbols, lengths in classes:
        upto, own = 0, []
        for length, k in lengths:
            upto += k
            own.append((upto, length))
            of_length[length] += k
        cuts.append((n, symbols, own))
    if max(of_length) > LONGEST[64]:
        raise ValueError(f"a code of {max(of_length)} bits does not fit a 64-bit word")
    known = spark.createDataFrame(cuts, "n long, symbols long, cuts array<struct<upto: long, length: int>>")
    classed = materialize(join_hot(counts, known, "n", "symbols"), "classed")
    sure = classed.where(F.size("cuts") == 1).select("symbol", "n", F.col("cuts")[0]["length"].alias("length"))
    ranked = running_sum(classed.where(F.size("cuts") > 1), "symbol", {"rank": F.lit(1)}, by=["n"])
    parted = ranked.select("symbol", "n", F.filter("cuts", lambda c: F.col("rank") <= c["upto"])[0]["length"].alias("length"))
    lengths = materialize(sure.unionByName(parted), "lengths")
    first = F.create_map(*[F.lit(x) for k, v in first_codes(of_length).items() for x in (k, v)]).cast("map<int, long>")
    placed = running_sum(lengths, "symbol", {"at": F.lit(1)}, by=["length"], exclusive=True)
    return materialize(placed.select("symbol", "n", "length", (F.element_at(first, F.col("length")) + F.col("at")).alias("code")), "book")


def encoded(rows: DataFrame, codes: DataFrame, idx: str = "idx", symbol: str = "symbol", size: int = CHUNK) -> DataFrame:
    """(chunk_id, n, nbit, cells, marks) of rows that idx numbers from 0, by a book (symbol, n, length, code); `size` codes a chunk."""
    bound_batches(rows.sparkSession)
    src = rows.select(F.col(idx).cast("long").alias("idx"), F.col(symbol).cast("long").alias("symbol"))
    coded = join_hot(src, codes, "symbol", how="left").select(F.floor(F.col("idx") / size).alias("chunk_id"), "idx", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("code", F.lit(0)).alias("code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chunk, at, length, code), group in whole_groups(batches, 1):
            if not length.all():
                raise ValueError("a symbol has no code in this book")
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            if (at - chunk * size != np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))).any():
                raise ValueError("rows are not numbered from 0 without gaps")
            out = [(int(chunk[a]), b - a, *pack_codes(code[a:b].astype(np.uint64), length[a:b].astype(np.int64))) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["chunk_id", "n", "nbit", "cells", "marks"])

    return coded.repartition("chunk_id").sortWithinPartitions("chunk_id", "idx").mapInArrow(run, "chunk_id long, n long, nbit long, cells binary, marks binary")


def decoded(chunks: DataFrame, codes: DataFrame, size: int = CHUNK) -> DataFrame:
    """(idx, symbol) of chunks, by the book that made them."""
    bound_batches(chunks.sparkSession)
    first = {r["length"]: r["first"] for r in codes.groupBy("length").agg(F.min("code").alias("first")).collect()}  # at most 58

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, n, cells, marks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                length, code = split_codes(cells, n, marks, first)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + chunk * size), pa.array(code | np.int64(1) << length)], names=["idx", "word"])

    # a code with a one in front tells its length too
    words = chunks.select("chunk_id", "n", "cells", "marks").mapInArrow(run, "idx long, word long")
    names = codes.select(F.col("code").bitwiseOR(F.expr("shiftleft(1L, length)")).alias("word"), "symbol", "n")
    return join_hot(words, names, "word").select("idx", "symbol")
