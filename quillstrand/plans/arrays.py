"""Error-bounded compression of arrays: predict, quantize, split outliers, code, and back.

An archive is a folder: ``codes`` (coded chunks), ``outliers``, ``anchors`` (spline only),
``book`` (Huffman only) and ``header``, all Parquet, or one file that has the same tables.
Nothing has a fixed capacity.
"""

from __future__ import annotations

import math
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import bitshuffle, delta, huffman, spline, stats
from ..session import dealt, materialize
from ..sources import parts as archive
from ..sources.arrays import dims as dims_of
from .options import Codec, Mode, Options, Predictor

#: Codes of a Huffman chunk.
CHUNK = 1 << 14


def linear(shape: tuple[int, int, int]):
    x, y, _ = shape
    return F.col("x") + F.col("y") * x + F.col("z") * (x * y)


#: Parts of an archive in their order, bytes of the header, and bytes of a row of the others.
PARTS, HEADER, WIDTHS = ("header", "book", "anchors", "outliers", "codes"), 128, {"book": 5, "anchors": 4, "outliers": 12}


def _body(codec: Codec):
    """Bytes of a row of codes: a Huffman-coded chunk, one in bit planes, or one code of two bytes."""
    sizes = {
        Codec.HUFFMAN: lambda: F.octet_length("cells") + F.octet_length("marks") + 12,
        Codec.BITSHUFFLE: lambda: F.octet_length("flags") + F.octet_length("words") + 8,
        Codec.PLAIN: lambda: F.lit(2),
    }
    return sizes[codec]()


def book_of(spark: SparkSession, path: str) -> huffman.Book:
    """The book of an archive, which others may be coded by (`Options.codebook`)."""
    lengths = {r["symbol"]: r["length"] for r in archive.tables(spark, path)("book").collect()}  # a row a symbol of at most some thousand
    if sum(1 << huffman.LONGEST[64] - n for n in lengths.values()) > 1 << huffman.LONGEST[64]:
        raise ValueError(f"no codes have the lengths of the book in {path}")
    return huffman.canonical(lengths)


def absolute_bound(df: DataFrame, options: Options, value: str = "value") -> float:
    return delta.relative_bound(df, value, options.eb) if options.mode is Mode.REL else options.eb


def predict(df: DataFrame, options: Options, eb: float, value: str = "value") -> DataFrame:
    """(x, y, z, code, outlier, anchor)"""
    rank = dims_of(options.shape)
    if options.predictor is Predictor.SPLINE:
        return spline.predicted(df, value, eb, options.radius, math.prod(options.shape))
    out = delta.quantized(df, value, rank, eb, options.radius, options.predictor is Predictor.ZIGZAG, cells=math.prod(options.shape))
    return out.select("x", "y", "z", "code", F.col("outlier").cast("double").alias("outlier"), F.lit(None).cast("double").alias("anchor"))


def _huffman_chunks(codes: DataFrame, book: huffman.Book) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("idx").to_numpy(), kind="stable")
        nbit, cells, marks = huffman.encode_chunk(table.column("code").to_numpy()[order], book)
        return pa.table({"chunk_id": table.column("chunk_id")[:1], "n": [len(order)], "nbit": [nbit], "cells": pa.array([cells], pa.binary()), "marks": pa.array([marks], pa.binary())})

    return codes.select(F.floor(F.col("idx") / CHUNK).alias("chunk_id"), "idx", "code").groupBy("chunk_id").applyInArrow(run, "chunk_id long, n long, nbit long, cells binary, marks binary")


def _huffman_codes(chunks: DataFrame, book: huffman.Book) -> DataFrame:
    def run(batches):
        for b in batches:
            for c, n, cells, marks in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                codes = huffman.decode_chunk(cells, n, marks, book)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(codes)) + c * CHUNK), pa.array(codes, pa.int64())], names=["idx", "code"])

    return chunks.select("chunk_id", "n", "cells", "marks").mapInArrow(run, "idx long, code long")


def compress(df: DataFrame, options: Options, path: str, value: str = "value", one_file: bool = False) -> dict[str, float]:
    """Write an archive of a dense array (x, y, z, value); returns the seconds of each stage."""
    spark, took, began = df.sparkSession, {}, time.time()
    if one_file:
        archive.in_one_file(spark, path, lambda folder: took.update(compress(df, options, folder, value)))
        return took | {"file": time.time() - began - sum(took.values())}

    def lap(name: str) -> None:
        nonlocal began
        took[name], began = time.time() - began, time.time()

    if options.shape is None:
        raise ValueError("the array's shape is needed")
    if options.codebook and (missing := set(range(options.bins)) - set(options.codebook.codes)):
        raise ValueError(f"the book has no codes for {len(missing)} of the {options.bins} codes that a radius of {options.radius} has")
    eb = absolute_bound(df, options, value)
    lap("bound")
    coded = materialize(predict(df, options, eb, value).withColumn("idx", linear(options.shape)), "codes")
    lap("predict")
    seen: list[tuple[str, Observation]] = []

    def put(rows: DataFrame, name: str, width) -> None:
        """Write a table, and see in the same pass how many rows and bytes it has."""
        seen.append((name, Observation()))
        rows.observe(seen[-1][1], F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.lit(1) * width), F.lit(0)).cast("long").alias("bytes")).write.parquet(f"{path}/{name}")

    put(coded.where(F.col("outlier").isNotNull()).select("idx", "outlier"), "outliers", F.lit(WIDTHS["outliers"]))
    put(coded.where(F.col("anchor").isNotNull()).select("idx", "anchor"), "anchors", F.lit(WIDTHS["anchors"]))
    lap("outliers")
    if "hist" in options.dump:
        huffman.histogram(coded, "code", options.bins).write.parquet(f"{path}/dump_hist")
    if "quant" in options.dump:
        coded.select("idx", F.col("code").cast("int").alias("code")).write.parquet(f"{path}/dump_quant")
    if options.codec is Codec.HUFFMAN:
        book = options.codebook or huffman.build(huffman.histogram(coded, "code", options.bins))
        put(huffman.book_frame(spark, book).coalesce(1), "book", F.lit(WIDTHS["book"]))
        lap("book")
        put(_huffman_chunks(coded, book), "codes", _body(options.codec))
    elif options.codec is Codec.PLAIN:
        put(coded.select("idx", "code"), "codes", _body(options.codec))
    else:
        put(bitshuffle.encoded(coded, "idx", "code", math.prod(options.shape)), "codes", _body(options.codec))
    lap("encode")
    sizes = {"header": (1, HEADER)} | {name: (o.get["rows"], o.get["bytes"]) for name, o in seen}
    spark.createDataFrame([(name, *sizes[name]) for name in PARTS if name in sizes], "part string, rows long, bytes long").coalesce(1).write.parquet(f"{path}/measures")
    x, y, z = options.shape
    header = [(options.mode.value, options.eb, eb, options.predictor.value, options.codec.value, options.radius, x, y, z)]
    spark.createDataFrame(header, "mode string, eb double, abs_eb double, predictor string, codec string, radius int, x long, y long, z long").coalesce(1).write.parquet(f"{path}/header")
    return took


def decompress(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z, restored) of an archive."""
    read = archive.tables(spark, path)
    h = read("header").first()
    shape = (h["x"], h["y"], h["z"])
    chunks = read("codes")
    if h["codec"] == Codec.HUFFMAN.value:
        codes = _huffman_codes(chunks, book_of(spark, path))
    elif h["codec"] == Codec.PLAIN.value:
        codes = chunks
    else:
        codes = bitshuffle.decoded(chunks)
    n = math.prod(shape)
    rows = dealt(codes, n, "idx").join(dealt(read("outliers"), n, "idx").hint("merge"), "idx", "left").join(dealt(read("anchors"), n, "idx").hint("merge"), "idx", "left")
    x, y, _ = shape
    rows = rows.withColumns({"x": F.col("idx") % x, "y": F.floor(F.col("idx") / x) % y, "z": F.floor(F.col("idx") / (x * y))})
    if h["predictor"] == Predictor.SPLINE.value:
        return spline.restored(rows, h["abs_eb"], h["radius"], n)
    rows = rows.withColumn("outlier", F.col("outlier").cast("long"))
    return delta.restored(rows, dims_of(shape), h["abs_eb"], h["radius"], h["predictor"] == Predictor.ZIGZAG.value, cells=n).select("x", "y", "z", "restored")


def verify(original: DataFrame, restored: DataFrame, shape: tuple[int, int, int], value: str = "value") -> DataFrame:
    """Quality of an archive's contents against the original."""
    n, idx = math.prod(shape), linear(shape).cast("long").alias("idx")
    # cells that were exploded from few bytes look small enough to broadcast, and are not
    both = dealt(original.select(idx, value), n, "idx").join(dealt(restored.select(idx, "restored"), n, "idx").hint("merge"), "idx")
    return stats.assess(both, value, "restored", "idx")


def size_report(spark: SparkSession, path: str, again: bool = False) -> DataFrame:
    """(part, start, bytes, share) of an archive, by what its rows hold; start is where a part would begin in one file of all of them.

    Sizes are those that `compress` saw when it wrote; `again` counts them anew.
    """
    read = archive.tables(spark, path)
    sizes = {r["part"]: r["bytes"] for r in read("measures").collect()}  # a row a part
    if again:
        codec = Codec(read("header").first()["codec"])
        sizes = {"header": HEADER} | {name: read(name).count() * width for name, width in WIDTHS.items() if name in sizes}
        sizes["codes"] = read("codes").agg(F.coalesce(F.sum(_body(codec)), F.lit(0)).cast("long")).first()[0]
    rows, at = [], 0
    for name in PARTS:
        if name in sizes:
            rows.append((name, at, sizes[name]))
            at += sizes[name]
    return spark.createDataFrame([(*r, r[2] / at) for r in rows], "part string, start long, bytes long, share double")


def time_report(spark: SparkSession, took: dict[str, float], values: int, width: int = 4) -> DataFrame:
    """(stage, seconds, gib_per_s) of what `compress` returned; ``total_without_book`` and ``total`` come last."""
    size = values * width / (1 << 30)
    rows = [*took.items(), ("total_without_book", sum(t for s, t in took.items() if s != "book")), ("total", sum(took.values()))]
    return spark.createDataFrame([(s, t, size / t if t else None) for s, t in rows], "stage string, seconds double, gib_per_s double")


def estimate(df: DataFrame, options: Options, value: str = "value") -> DataFrame:
    """One row on what compression would give, without writing: values, outliers, entropy, Huffman bits and ratio."""
    eb = absolute_bound(df, options, value)
    coded = materialize(predict(df, options, eb, value), "codes")
    hist = huffman.histogram(coded, "code", options.bins)
    book = huffman.book_frame(df.sparkSession, huffman.build(hist))
    sizes = stats.huffman_estimate(hist, book).crossJoin(stats.entropy(hist)).crossJoin(delta.too_many_outliers(coded).select("n_outliers", "too_many"))  # one-row tables
    total = F.floor((F.col("bits") + 7) / 8) + 12 * F.col("n_outliers")
    return sizes.select("n", "n_outliers", "too_many", "entropy", "bits", total.alias("bytes"), (4 * F.col("n") / total).alias("cr"), (8 * total / F.col("n")).alias("bitrate"))
