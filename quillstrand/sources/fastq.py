"""FASTQ files as ordered lines and as records."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader

from ..operators.scan import dense_id
from ..session import materialize
from . import files
from .files import Range


def read_lines(spark: SparkSession, path: str, strip_cr: bool = False) -> DataFrame:
    """(file, line_no, start, length, line) of text files of any size.

    A file is read in splits.  Within a split, lines are numbered as they come;
    the numbers and bytes of the splits before are added from one row per
    split.  Offsets are 64-bit.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("line"))
    raw = raw.withColumn("bytes", F.octet_length("line").cast("long") + 1)
    own = Window.partitionBy("file", "split").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = raw.groupBy("file", "split").agg(F.count("*").alias("lines"), F.sum("bytes").alias("size"))
    before = Window.partitionBy("file").orderBy("split")
    base = totals.select("file", "split", (F.sum("lines").over(before) - F.col("lines")).alias("lines0"), (F.sum("size").over(before) - F.col("size")).alias("bytes0"))
    out = raw.withColumns({"k": F.row_number().over(own), "sum": F.sum("bytes").over(own)}).join(base, ["file", "split"])
    line = F.regexp_replace("line", "\r$", "") if strip_cr else F.col("line")
    return out.select("file", (F.col("lines0") + F.col("k") - 1).alias("line_no"), (F.col("bytes0") + F.col("sum") - F.col("bytes")).alias("start"), (F.col("bytes") - 1).alias("length"), line.alias("line"))


SCHEMA = "file string, range int, nth long, start long, size int, identifier string, bases string, plus string, quality string"
ROLES = ("identifier", "bases", "plus", "quality")
#: Bytes of a range, and of what a task holds of it at once.
RANGE, PIECE = 1 << 26, 1 << 22


def lines_in(data: bytes, ends: np.ndarray) -> pa.Array:
    """The lines of `data` that end at these line feeds, without them."""
    offsets = np.concatenate([[0], ends + 1]).astype(np.int32)
    return pc.binary_slice(pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), 0, -1)


def as_text(column: pa.Array) -> pa.Array:
    """The strings of a binary column; bytes that are not UTF-8 become U+FFFD."""
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in column.to_pylist()], pa.string())


def records_in(parts: Iterator[bytes], name: str, at: int, until: int, whole: bool | None = True, strip_cr: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.Array]]]:
    """(starts, sizes, four columns) of the records that begin before byte `until`; `parts` go on from byte `at`, where a record begins.

    What follows the last whole record of the file raises an error if `whole`; if that is false it is a record that
    lacks lines, whose size counts the line feed that is missing; if it is None it is left for later.
    """
    rest, ended = b"", False
    while at < until and not ended:
        data = next(parts, None)
        ended = data is None
        if ended and rest and whole is None:
            return
        if ended and rest and not whole:
            lines = rest.split(b"\n")
            lines = lines[:-1] if len(lines) > 1 and not lines[-1] else lines
            filled = [*lines, None, None, None][:4]
            yield np.array([at]), np.array([len(rest) + (rest[-1] != 0x0A)]), [pa.array([None if x is None else x[: -1 if strip_cr and x.endswith(b"\r") else None].decode("utf-8", "replace")], pa.string()) for x in filled]
            return
        if ended and rest:
            raise ValueError(f"{name} is not a whole FASTQ file of four-line records: {rest.count(10)} lines and {len(rest) - rest.rfind(10) - 1} bytes after the last one")
        rest += data or b""
        ends = np.flatnonzero(np.frombuffer(rest, np.uint8) == 0x0A)
        ends = ends[: len(ends) // 4 * 4]
        starts = np.concatenate([[0], ends[3::4] + 1])[:-1]
        n = int(np.searchsorted(starts + at, until))
        if n:
            ends = ends[: 4 * n]
            lines = lines_in(rest, ends)
            if strip_cr:
                lines = pc.replace_substring_regex(lines, "\r$", "")
            sizes = ends[3::4] + 1 - starts[:n]
            yield starts[:n] + at, sizes, [as_text(lines.take(pa.array(np.arange(k, 4 * n, 4)))) for k in range(4)]
            at, rest = at + int(ends[-1]) + 1, rest[int(ends[-1]) + 1 :]
        if n < len(starts):
            return


def first_record(r: Range, most: int = 1 << 28) -> int:
    """The byte at which the first record that begins in this range begins, or the range's end.

    Of the four ways to group the lines that follow, the right one has a '+' in
    front of every third line and as many bases as qualities.  Lines are read until one way is left; where that does
    not decide, the lines from the file's beginning are counted, which is exact and slow.
    """
    if r.a == 0:
        return 0
    data = b""
    for part in files.pieces(r.file, r.a - 1, 1 << 16):
        data += part
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x0A)
        if len(ends) and r.a + ends[0] >= r.b:
            return r.b  # the range lies within one line
        if len(ends) < 9:
            continue
        starts, sizes = ends[:-1] + 1, np.diff(ends) - 1
        plus = np.frombuffer(data, np.uint8)[starts] == 0x2B
        left = []
        for p in range(4):
            n = (len(starts) - p) // 4
            own = p + 4 * np.arange(n)
            if (plus[own + 2] & (sizes[own + 1] == sizes[own + 3])).all():
                left.append(p)
        if len(left) == 1:
            return min(r.b, r.a - 1 + int(starts[left[0]]))
        if not left or len(data) > most:
            break
    lines, at = 0, 0
    for part in files.pieces(r.file):
        ends = np.flatnonzero(np.frombuffer(part, np.uint8) == 0x0A) + at
        number = lines + 1 + np.arange(len(ends))
        found = ends[(ends >= r.a - 1) & (number % 4 == 0)]
        if len(found):
            return min(r.b, int(found[0]) + 1)
        lines, at = lines + len(ends), at + len(part)
        if at >= r.b:
            break
    return r.b


class FastqReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files = files.files_of(options)
        self.range_bytes = int(options.get("rangebytes", RANGE))
        self.whole, self.strip_cr = options.get("whole", "true") == "true", options.get("stripcr", "false") == "true"
        self.starts = {(f, n): at for f, n, at in json.loads(options.get("starts", "[]"))}

    def partitions(self) -> list[Range]:
        return files.cut(self.files, self.range_bytes)

    def read(self, r: Range | None) -> Iterator[pa.RecordBatch]:
        if r is None:  # there are no ranges
            return
        at = self.starts.get((r.file, r.number))
        at = first_record(r) if at is None else at
        nth = 0
        if at >= r.b:
            return
        for starts, sizes, columns in records_in(files.pieces(r.file, at, PIECE), r.file, at, r.b, self.whole, self.strip_cr):
            yield _batch(r, nth, starts, sizes, columns)
            nth += len(starts)


def _batch(r: Range, nth: int, starts: np.ndarray, sizes: np.ndarray, columns: list[pa.Array]) -> pa.RecordBatch:
    n = len(starts)
    return pa.RecordBatch.from_arrays([pa.array([r.file] * n, pa.string()), pa.array([r.number] * n, pa.int32()), pa.array(np.arange(nth, nth + n)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), *columns], names=["file", "range", "nth", "start", "size", *ROLES])


class FastqStream(DataSourceStreamReader):
    """Records as files arrive and grow: an offset says how many bytes of each file have been read.

    A record belongs to the batch, and to the range of it, that its last byte is in, so one
    that is cut by what has been written so far waits for the rest.  The task finds where it
    begins by going back from there.  Nothing but the offsets is kept between batches.
    """

    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.range_bytes, self.strip_cr = int(options.get("rangebytes", RANGE)), options.get("stripcr", "false") == "true"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {name: size for name, size in files.files_of(self.options) if name[name.rfind(".") :] not in files.PACKED}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, size in end.items():
            if size < start.get(name, 0):
                raise ValueError(f"{name} has shrunk")
            out += [Range(name, size, k, a, min(a + self.range_bytes, size)) for k, a in enumerate(range(start.get(name, 0), size, self.range_bytes))]
        return out

    def read(self, r: Range | None) -> Iterator[pa.RecordBatch]:
        if r is None:
            return
        back, at = 1 << 16, 0
        while r.a > back and (at := first_record(Range(r.file, r.size, 0, r.a - back, r.a + 1))) > r.a:
            back, at = back * 4, 0
        nth = 0
        for starts, sizes, columns in records_in(files.pieces(r.file, at, PIECE), r.file, at, r.b, None, self.strip_cr):
            own = np.flatnonzero((starts + sizes > r.a) & (starts + sizes <= r.b))
            if len(own):
                yield _batch(r, nth, starts[own], sizes[own], [c.take(pa.array(own)) for c in columns])
                nth += len(own)


class Fastq(DataSource):
    """spark.read.format("fastq"), and spark.readStream for files that arrive and grow: records of four lines, from byte ranges that are fixed when the source is planned.

    A record belongs to the range that it begins in, and tasks find the first one
    themselves, so files are read once, and no setting of the session changes rows.
    Options: ``rangeBytes``; ``stripCr``; ``whole``, without which a last record may lack lines;
    ``files``, a JSON list of names and sizes in place of what is at the path;
    ``starts``, a JSON list of file, range and byte for ranges whose first record is known.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> FastqReader:
        return FastqReader(self.options)

    def streamReader(self, schema: T.StructType) -> FastqStream:
        return FastqStream(self.options)


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, size, nth, line), written once: nth numbers the lines of a task without gaps, so those of a split too."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("line"))
    return materialize(raw, "lines")


def _by_lines(spark: SparkSession, path: str, strip_cr: bool, check: bool) -> DataFrame:
    """Records of files that only Spark's readers can open: its splits are written as they came, and numbered from there."""
    raw = _raw(spark, path)
    sums = raw.groupBy("file", "split").agg(F.count("*").alias("lines"), F.sum(F.octet_length("line").cast("long") + 1).alias("bytes"), F.min("nth").alias("first"), F.max("size").alias("size"))
    before = Window.partitionBy("file").orderBy("split")
    splits = materialize(sums.withColumn("lines0", F.sum("lines").over(before) - F.col("lines")), "splits")
    if check:
        rows = splits.groupBy("file").agg(F.sum("lines").alias("n"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"))
        bad = rows.where((F.col("n") % 4 != 0) | (F.col("bytes") != F.col("size"))).limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0]['file']} has {bad[0]['n']} lines and {bad[0]['size']} bytes: not a whole FASTQ file of four-line records")
    line = F.regexp_replace("line", "\r$", "") if strip_cr else F.col("line")
    met = raw.join(splits.select("file", "split", "first", "lines0"), ["file", "split"])
    return assemble(met.select("file", (F.col("lines0") + F.col("nth") - F.col("first")).alias("line_no"), line.alias("line")))


def check_whole(spark: SparkSession, path: str) -> None:
    """Raise unless every file has a multiple of four lines and ends with a line feed."""
    read_fastq(spark, path)


def assemble(lines: DataFrame) -> DataFrame:
    """Records from lines in any order: (file, rec_id, identifier, bases, plus, quality) by line number."""
    role = F.col("line_no") % 4
    pick = lambda k: F.max(F.when(role == k, F.col("line")))
    return lines.groupBy("file", F.floor(F.col("line_no") / 4).alias("rec_id")).agg(pick(0).alias("identifier"), pick(1).alias("bases"), pick(2).alias("plus"), pick(3).alias("quality"))


def _ranges(table: DataFrame) -> DataFrame:
    """A row for each range that has records: how many, those of the file before it, its first byte and the one after its last."""
    sums = table.groupBy("file", "range").agg(F.count("*").alias("n"), F.min("start").alias("a"), F.max(F.col("start") + F.col("size")).alias("b"), F.bool_or(F.col("quality").isNull()).alias("short"))
    w = Window.partitionBy("file").orderBy("range")
    return sums.withColumns({"before": F.sum("n").over(w) - F.col("n"), "from": F.coalesce(F.lag("b").over(w), F.lit(0))})


def _broken(ranges: DataFrame, sizes: DataFrame) -> list:
    """A file whose ranges leave a gap, do not end where it does, or end with a record that lacks lines, if there is one; gaps come first."""
    rows = ranges.groupBy("file").agg(F.max("b").alias("b"), F.bool_or(F.col("a") != F.col("from")).alias("gap"), F.bool_or("short").alias("short"))
    met = sizes.where("length <> 0").join(rows, F.col("path") == F.col("file"), "left").withColumn("gap", F.coalesce("gap", F.lit(True)))
    bad = met.where(F.col("gap") | F.col("short") | (F.col("length") > 0) & (F.col("b") != F.col("length")))
    return bad.select("path", "gap").orderBy(F.desc("gap")).limit(1).collect()


def starts_by_count(spark: SparkSession, files_option: str, range_bytes: int) -> str:
    """The ``starts`` of files in which marks do not tell where records begin: lines are counted by range."""
    ranges = [(r.file, r.number, r.a, r.b) for r in files.cut([tuple(x) for x in json.loads(files_option)], range_bytes)]
    rows = spark.createDataFrame(ranges, "file string, number int, a long, b long").repartition(max(1, len(ranges)), "file", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                # line feeds before the last byte of the range before, and the first four from there on
                n, ends, at = 0, [], max(r["a"] - 1, 0)
                for part in files.pieces(r["file"], at, PIECE):
                    found = np.flatnonzero(np.frombuffer(part, np.uint8) == 0x0A) + at
                    n += int((found < r["b"] - 1).sum())
                    ends += found[: 4 - len(ends)].tolist() if len(ends) < 4 else []
                    at += len(part)
                    if at >= r["b"] and len(ends) == 4:
                        break
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]]), pa.array([r["number"]], pa.int32()), pa.array([n]), pa.array([ends], pa.list_(pa.int64()))], names=["file", "number", "n", "ends"])

    found = rows.mapInArrow(run, "file string, number int, n long, ends array<long>").orderBy("file", "number").collect()  # a row a range
    out, last, lines = [], None, 0
    for r in found:
        lines = 0 if r["file"] != last else lines
        to = (-lines - 1) % 4  # the line feed that ends a record
        out.append((r["file"], r["number"], 0 if r["number"] == 0 else r["ends"][to] + 1 if to < len(r["ends"]) else 1 << 62))
        last, lines = r["file"], lines + r["n"]
    return json.dumps(out)


def read_fastq(spark: SparkSession, path: str, strip_cr: bool = False, check: bool = True, most: int = 100_000, range_bytes: int = RANGE) -> DataFrame:
    """(file, rec_id, identifier, bases, plus, quality) of FASTQ files of any size.

    Files are listed once and read once: records are written to the shared
    folder with their place in their range, and numbered by the ranges' counts, a row a
    range, which are broadcast while there are at most `most`.  Ranges that do not
    meet, or do not end with their file, mean that marks misled: then lines are counted.
    """
    if not files.openable(path):
        return _by_lines(spark, path, strip_cr, check)
    found = files.listed(spark, path)
    option, session = files.as_option(found), files.registered(spark, Fastq)
    sizes = spark.createDataFrame([tuple(x) for x in json.loads(option)], "path string, length long")
    sizes = sizes.withColumn("length", F.when(F.col("path").rlike(r"\.(gz|bz2|zst|lz4)$"), -1).otherwise(F.col("length")))  # not known

    def numbered(starts: str) -> tuple[DataFrame, DataFrame]:
        reader = session.read.format("fastq").option("files", option).option("rangeBytes", range_bytes).option("starts", starts)
        table = materialize(reader.option("whole", "false").option("stripCr", str(strip_cr).lower()).load(), "fastq")
        return table, materialize(_ranges(table), "ranges")

    table, ranges = numbered("[]")
    bad = _broken(ranges, sizes)
    if bad and bad[0]["gap"]:
        table, ranges = numbered(starts_by_count(spark, option, range_bytes))
        bad = _broken(ranges, sizes)
    if bad and check:
        raise ValueError(f"{bad[0]['path']} is not a whole FASTQ file of four-line records")
    base = ranges.select("file", "range", "before")
    base = F.broadcast(base) if ranges.count() <= most else base
    return table.join(base, ["file", "range"]).select("file", (F.col("before") + F.col("nth")).alias("rec_id"), *ROLES)


def numbered_over_files(records: DataFrame) -> DataFrame:
    """(rec_id, identifier, bases, plus, quality): one numbering for all files, in the order of their names."""
    counts = materialize(records.groupBy("file").agg((F.max("rec_id") + 1).alias("n")), "files")
    before = counts.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("__before"))  # a row a file
    return records.join(F.broadcast(before) if counts.count() <= 100_000 else before, "file").select((F.col("__before") + F.col("rec_id")).alias("rec_id"), *ROLES)


def write_fastq(records: DataFrame, path: str) -> None:
    """Records as FASTQ text, one file per range of records, in order of their names."""
    text = F.concat_ws("\n", "identifier", "bases", "plus", "quality")
    records.repartitionByRange("rec_id").sortWithinPartitions("rec_id").select(text.alias("value")).write.text(path)


def synthesize(documents: DataFrame) -> DataFrame:
    """Reads made of the documents' hashes, for tables that hold no sequencing data."""
    # hashed before they are numbered, so that no text is shuffled
    out = dense_id(documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash")), "doc_id")
    return out.select(
        "rec_id",
        F.concat(F.lit("@SIM1."), F.col("doc_id") + 1, F.lit(" RUN:7:"), F.lit(1100) + F.floor(F.col("doc_id") / 100), F.lit("/1")).alias("identifier"),
        F.translate("hash", "0123456789abcdef", "ACGTACGTACGTACGN").alias("bases"),
        F.lit("+").alias("plus"),
        F.translate(F.md5(F.col("doc_id").cast("string").cast("binary")), "0123456789abcdef", "IIIIFFFFDDBB@<:#").alias("quality"),
    )


def to_lines(records: DataFrame) -> DataFrame:
    """(line_no, line) of records."""
    return records.select("rec_id", F.posexplode(F.array("identifier", "bases", "plus", "quality")).alias("role", "line")).select((F.col("rec_id") * 4 + F.col("role")).alias("line_no"), "line")
