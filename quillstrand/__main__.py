"""Command line: python -m quillstrand fastq|array ACTION ..."""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import SparkSession

from .plans import arrays as array_plan
from .plans import fastq as fastq_plan
from .plans import options as array_options
from .sources import arrays, fastq
from .sources.parts import tables


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillstrand", description="Compress, restore and report on sequencing reads and raw arrays.")
    kinds = out.add_subparsers(dest="kind", required=True)
    reads = kinds.add_parser("fastq", help="sequencing reads")
    reads.add_argument("action", choices=("report", "compress", "decompress"))
    reads.add_argument("input")
    reads.add_argument("output", nargs="?", help="container, or folder of FASTQ text")
    reads.add_argument("--strip-cr", action="store_true")
    for p in (reads, cells := kinds.add_parser("array", help="raw little-endian arrays")):
        p.add_argument("--one-file", action="store_true", help="write the container or archive as one file, which takes a shared file system")
    cells.add_argument("action", choices=("report", "compress", "decompress"))
    cells.add_argument("input")
    cells.add_argument("output", nargs="?", help="archive, or raw file")
    cells.add_argument("-t", "--type", default="<f4", help="numpy name of the values' type")
    cells.add_argument("-o", "--options", default="", help="k=v,k=v: mode, eb, predictor, hist, codec, radius, shape, dump")
    sides = cells.add_mutually_exclusive_group()
    sides.add_argument("-l", "--length", help="sides, x fastest, as 3600x1800, or a dataset's name")
    sides.add_argument("--demo", choices=sorted(arrays.SHAPES), help="sides by a dataset's name alone")
    cells.add_argument("-S", "--skip", default="", help="what to leave out, with commas between: huffman (codes are kept as they are), write (restore and compare, but write nothing)")
    cells.add_argument("--import-book", metavar="ARCHIVE", help="code by the book of that archive and make none")
    cells.add_argument("--compare", help="raw file of the originals, for the quality of what is restored")
    return out


def _shape(args: argparse.Namespace, options: array_options.Options) -> tuple[int, int, int] | None:
    if args.demo:
        return arrays.SHAPES[args.demo]
    return options.shape if not args.length else arrays.SHAPES.get(args.length) or array_options.shape(args.length)


def _skipped(text: str) -> set[str]:
    names = set(filter(None, text.split(",")))
    if names - {"huffman", "write"}:
        raise SystemExit(f"nothing to skip: {text}")
    return names


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    skip = _skipped(args.skip) if args.kind == "array" else set()
    if skip and (args.action, skip) not in (("compress", {"huffman"}), ("decompress", {"write"})):
        raise SystemExit("huffman is skipped when compressing, write when restoring")
    if "huffman" in skip and args.import_book:
        raise SystemExit("a book is of no use where huffman is skipped")
    if args.action != "report" and not args.output and "write" not in skip:
        raise SystemExit("an output is needed")
    spark = SparkSession.builder.appName("quillstrand").getOrCreate()
    if args.kind == "fastq":
        if args.action == "decompress":
            fastq.write_fastq(fastq_plan.decompress(spark, args.input), args.output)
            return 0
        reads = fastq.numbered_over_files(fastq.read_fastq(spark, args.input, args.strip_cr))
        if args.action == "compress":
            fastq_plan.compress(reads, args.output, args.one_file)
        fastq_plan.measured(reads).show(truncate=False)
        return 0
    if args.action == "decompress":
        shape = tuple(tables(spark, args.input)("header").select("x", "y", "z").first())
        out = array_plan.decompress(spark, args.input)
        if "write" not in skip:
            arrays.write_array(out.withColumn("idx", array_plan.linear(shape)), args.output, args.type, value="restored")
        if args.compare:
            original = arrays.read_array(spark, args.compare, args.type, shape=shape)
            array_plan.verify(original, out, shape).show(truncate=False, vertical=True)
        return 0
    options = array_options.parse(args.options)
    options = dataclasses.replace(options, shape=_shape(args, options))
    if "huffman" in skip:
        options = dataclasses.replace(options, codec=array_options.Codec.PLAIN)
    if args.import_book:
        options = dataclasses.replace(options, codebook=array_plan.book_of(spark, args.import_book))
    cells = arrays.read_array(spark, args.input, args.type, shape=options.shape)
    if args.action == "report":
        array_plan.estimate(cells, options).show(truncate=False, vertical=True)
        return 0
    took = array_plan.compress(cells, options, args.output, one_file=args.one_file)
    array_plan.size_report(spark, args.output).show(truncate=False)
    x, y, z = options.shape
    array_plan.time_report(spark, took, x * y * z).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
