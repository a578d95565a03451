"""FASTQ compression: columns out of lines, a codec for each, sizes, and a container that restores the file."""

from __future__ import annotations

import time
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import bits, flat, huffman, lz, rle, segments
from ..operators.scan import running_sum
from ..session import materialize
from ..sources import parts as archive

#: Share of the quality bytes, from the start, that the book is made of.
SAMPLE = 0.2
PARDEG = 4096


@dataclass(frozen=True)
class Segment:
    pos: int
    kind: str  # static, numeric or string
    max_len: int
    first_value: str
    delimiter: str
    shape: int = 0

    @property
    def name(self) -> str:
        return f"segment_{self.pos}" if self.shape == 0 else f"shape_{self.shape}_segment_{self.pos}"


@dataclass(frozen=True)
class Plan:
    """Identifiers of a file: the common shapes, and the codec of each of their segments.

    Identifiers of no common shape are odd, and kept as they are, so that they
    cost no column, however many pieces they have.  With several shapes, rows are numbered
    within their shape, and the sequence of shapes is kept as runs.
    """

    shapes: list[str]
    segments: list[Segment]

    def of(self, shape: int) -> list[Segment]:
        return [s for s in self.segments if s.shape == shape]

    def shaped(self, records: DataFrame) -> DataFrame:
        """(rec_id, identifier, shape, k): k numbers the rows of a shape from 0; it is rec_id where there is one shape."""
        rows = records.select("rec_id", "identifier", segments.shape_id(F.col("identifier"), self.shapes).alias("shape"))
        if len(self.shapes) < 2:
            return rows.withColumn("k", F.col("rec_id"))
        return running_sum(rows, "rec_id", {"k": F.lit(1).cast("long")}, by=["shape"], exclusive=True)

    def columns(self, shaped: DataFrame, shape: int) -> DataFrame:
        """(k, seg_0, ...) of a shape's rows; where there is one shape, odd rows stay and hold nothing."""
        odd = F.col("shape") != shape
        own = shaped.withColumn("identifier", F.when(~odd, F.col("identifier"))) if len(self.shapes) < 2 else shaped.where(~odd)
        return segments.columns(own.select("k", "identifier"), "identifier", len(self.of(shape))).drop("identifier")


def plan_segments(records: DataFrame, mode: str = "exact") -> Plan:
    """The codec of each identifier segment, by what its values are: a constant is stored once, numbers by differences and runs, others by window matching."""
    kind = lambda r: "static" if r["is_static"] else "numeric" if r["is_numeric"] else "string"
    if mode == "first":
        rows = segments.infer(records, "identifier", "rec_id", mode=mode).orderBy("pos").collect()
        first = records.orderBy("rec_id").select(segments.shape_of(F.col("identifier")).alias("s")).limit(1).collect()
        return Plan([r["s"] for r in first], [Segment(r["pos"], kind(r), r["max_len"], r["first_value"], r["delimiter"]) for r in rows])
    shapes = segments.common_shapes(records, "identifier")
    common = records.select("rec_id", "identifier", segments.shape_id(F.col("identifier"), shapes).alias("shape")).where("shape >= 0")
    rows = segments.infer(common, "identifier", "rec_id", by=("shape",)).orderBy("shape", "pos").collect()  # a row per segment of a common shape
    return Plan(shapes, [Segment(r["pos"], kind(r), r["max_len"], r["first_value"], r["delimiter"], r["shape"]) for r in rows])


def shape_runs(shaped: DataFrame) -> DataFrame:
    """The sequence of shapes, -1 for odd ones, as runs."""
    return rle.encode(shaped.select("rec_id", "shape"), "rec_id", "shape")


def segment_sizes(records: DataFrame, plan: Plan) -> DataFrame:
    """(part, bytes) of every segment, and of the runs of shapes where there are several."""
    spark = records.sparkSession
    shaped = plan.shaped(records)
    if len(plan.shapes) > 1:
        shaped = materialize(shaped, "shaped")
    out = None
    if not plan.segments or len(plan.shapes) > 1:
        out = shape_runs(shaped).agg((F.count("*") * 8).alias("bytes")).select(F.lit("shapes").alias("part"), "bytes")
    for s in plan.segments:
        name, cols = f"seg_{s.pos}", plan.columns(shaped, s.shape)
        if s.kind == "static":
            is_number = s.first_value is not None and s.first_value.isdigit()
            part = spark.range(1).select(F.lit(4 if is_number else len((s.first_value or "").encode())).cast("long").alias("bytes"))
        elif s.kind == "numeric":
            part = rle.numeric_codec(cols.select("k", F.coalesce(F.col(name).try_cast("long"), F.lit(0).cast("long")).alias("v")), "k", "v").select(F.col("bytes").cast("long"))
        else:
            blocks = lz.compressed(lz.blocks(lz.fixed_width(cols, name, "k", s.max_len), "data", ["part"]), ["part"])
            part = blocks.agg(F.sum(F.octet_length("flags") + F.octet_length("tokens")).cast("long").alias("bytes"))
        part = part.select(F.lit(f"{s.name}_{s.kind}").alias("part"), "bytes")
        out = part if out is None else out.unionByName(part)
    return out


def quality_histogram(records: DataFrame, share: float = SAMPLE) -> DataFrame:
    """Counts of the first `share` of all quality bytes, one added to each."""
    rows = running_sum(records.select("rec_id", "quality").withColumn("n", F.octet_length("quality").cast("long")), "rec_id", {"before": F.col("n")}, exclusive=True)
    total = records.agg(F.coalesce(F.sum(F.octet_length("quality").cast("long")), F.lit(0)).alias("t")).first()["t"]
    limit = int(share * total)
    # the last record of the sample may count in part
    head = rows.where(F.col("before") < limit).select(F.substring(F.col("quality"), F.lit(1), (limit - F.col("before")).cast("int")).alias("quality"))
    return huffman.byte_histogram(head, "quality", smooth=1)


def quality_size(records: DataFrame) -> DataFrame:
    """(part, bytes) of the Huffman-coded quality column."""
    book = huffman.book_frame(records.sparkSession, huffman.build(quality_histogram(records)))
    total = records.agg(F.sum(F.octet_length("quality").cast("long")).alias("t")).first()["t"] or 0
    sublen = max(1, -(-total // PARDEG))
    cells = huffman.chunk_bits(flat.counts_by_chunk(records, "quality", "rec_id", sublen), book).agg(F.coalesce(F.sum("ncell"), F.lit(0)).alias("ncell"))
    return cells.select(F.lit("quality").alias("part"), huffman.archive_size(F.col("ncell"), PARDEG).cast("long").alias("bytes"))


def report(records: DataFrame) -> DataFrame:
    """(part, bytes): every part of the compressed file, what it was, and the total.

    ``total`` counts identifiers, bases, quality and four bytes; ``true_total``
    adds what restoring takes: the '+' lines where they say something and the
    lengths of reads, as runs, and identifiers of no common shape.
    """
    records = materialize(records.select("rec_id", "identifier", "bases", "plus", "quality"), "records")
    plan = plan_segments(records)
    ids = segment_sizes(records, plan)
    bases = bits.sizes(records).select(F.lit("bases").alias("part"), F.col("total_bytes").cast("long").alias("bytes"))
    parts = materialize(ids.unionByName(bases).unionByName(quality_size(records)), "parts")
    original = records.agg(F.sum(sum((F.octet_length(c) for c in ("identifier", "bases", "plus", "quality")), F.lit(4)).cast("long")).alias("bytes")).select(F.lit("original").alias("part"), "bytes")
    total = parts.agg((F.sum("bytes") + 4).alias("bytes")).select(F.lit("total").alias("part"), "bytes")
    runs = rle.encode(records.select("rec_id", F.octet_length("bases").alias("n")), "rec_id", "n").agg((F.count("*") * 8).alias("extra"))
    plus = records.agg(F.coalesce(F.sum(F.when(F.col("plus") != "+", F.octet_length("plus") + 4)), F.lit(0)).alias("more"))
    odd = records.where(segments.shape_id(F.col("identifier"), plan.shapes) < 0).agg(F.coalesce(F.sum(F.octet_length("identifier") + 4), F.lit(0)).alias("odd"))
    true = total.crossJoin(runs).crossJoin(plus).crossJoin(odd).select(F.lit("true_total").alias("part"), (F.col("bytes") + F.col("extra") + F.col("more") + F.col("odd")).alias("bytes"))  # one-row tables
    return parts.unionByName(original).unionByName(total).unionByName(true)


def measured(records: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: original, total and true_total bytes, both ratios, the seconds that the report took and megabytes (2**20) a second."""
    began = time.time()
    got = {r["part"]: r["bytes"] for r in report(records).collect()}  # a row per part
    took = time.time() - began if seconds is None else seconds
    row = (got["original"] or 0, got["total"], got["true_total"])
    ratios = tuple(row[0] / x if x else None for x in row[1:])
    return records.sparkSession.createDataFrame([(*row, *ratios, took, row[0] / (1 << 20) / took)], "original long, total long, true_total long, ref_ratio double, true_ratio double, seconds double, mb_per_s double")


def compress(records: DataFrame, path: str, one_file: bool = False) -> None:
    """Write a container, a folder of tables or one file, from which `decompress` restores the records exactly.

    Identifiers that do not split and join to themselves, as planned from all
    rows, and '+' lines other than '+' are kept as they are.
    """
    spark = records.sparkSession
    if one_file:
        archive.in_one_file(spark, path, lambda folder: compress(records, folder))
        return
    records = materialize(records.select("rec_id", "identifier", "bases", "plus", "quality"), "records")
    plan = plan_segments(records)
    shaped = materialize(plan.shaped(records), "shaped")
    shaped.where("shape < 0").select("rec_id", "identifier").write.parquet(f"{path}/odd_identifiers")
    header = [(s.pos, s.kind, s.max_len, s.first_value, s.delimiter, s.shape) for s in plan.segments]
    spark.createDataFrame(header, "pos int, kind string, max_len int, first_value string, delimiter string, shape int").coalesce(1).write.parquet(f"{path}/segments")
    spark.createDataFrame(list(enumerate(plan.shapes)), "shape int, form string").coalesce(1).write.parquet(f"{path}/shapes")
    if len(plan.shapes) != 1:
        shape_runs(shaped).write.parquet(f"{path}/shape_runs")
    for s in plan.segments:
        cols, c = plan.columns(shaped, s.shape), F.col(f"seg_{s.pos}")
        if s.kind == "numeric":
            rle.numeric_encode(cols.select("k", F.coalesce(c.try_cast("long"), F.lit(0).cast("long")).alias("v")), "k", "v").write.parquet(f"{path}/{s.name}")
        elif s.kind == "string":
            fixed = lz.fixed_width(cols, f"seg_{s.pos}", "k", s.max_len)
            blocks = lz.compressed(lz.blocks(fixed, "data", ["part"]), ["part"])
            blocks.write.parquet(f"{path}/{s.name}")
    records.where("plus <> '+'").select("rec_id", "plus").write.parquet(f"{path}/plus")
    flat.with_offsets(records.select("rec_id", "bases")).select("rec_id", "length", "offset").write.parquet(f"{path}/lengths")
    n_bases, n_quality = (F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in ("bases", "quality"))
    records.where(n_bases != n_quality).select("rec_id", n_quality.alias("n_quality")).write.parquet(f"{path}/quality_lengths")
    bits.blocks(records).write.parquet(f"{path}/bases")
    book = huffman.build(huffman.byte_histogram(records, "quality", smooth=1))
    huffman.book_frame(spark, book).coalesce(1).write.parquet(f"{path}/book")
    huffman.encoded(records, "quality", "rec_id", book).write.parquet(f"{path}/quality")


def _strings(blocks: DataFrame, width: int, rows_a_part: int = 1 << 14) -> DataFrame:
    """(k, v) of a string segment's blocks."""

    def join(table: pa.Table) -> pa.Table:
        order = sorted(range(table.num_rows), key=table.column("block_id").to_pylist().__getitem__)
        rows = table.column("data").to_pylist()
        data = b"".join(rows[i] for i in order)
        n = len(data) // width
        part = table.column("part")[0].as_py()
        values = [data[i * width : (i + 1) * width].rstrip(b"\0").decode() for i in range(n)]
        return pa.table({"k": pa.array([part * rows_a_part + i for i in range(n)], pa.int64()), "v": pa.array(values, pa.string())})

    return lz.expanded(blocks, ["part"]).groupBy("part").applyInArrow(join, T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())]))


def decompress(spark: SparkSession, path: str) -> DataFrame:
    """The records of a container."""
    read = archive.tables(spark, path)
    plan = Plan([r["form"] for r in read("shapes").orderBy("shape").collect()], [Segment(*r) for r in read("segments").orderBy("shape", "pos").collect()])
    lengths, odd = read("lengths"), read("odd_identifiers")
    if len(plan.shapes) == 1:
        rows = lengths.select("rec_id", F.lit(0).alias("shape"), F.col("rec_id").alias("k")).join(odd.select("rec_id"), "rec_id", "left_anti")
    else:
        rows = rle.decode(read("shape_runs"), "shape").withColumnRenamed("start", "rec_id")
        rows = materialize(running_sum(rows, "rec_id", {"k": F.lit(1).cast("long")}, by=["shape"], exclusive=True), "shaped")
    ids = odd
    for shape in range(len(plan.shapes)):
        own, pieces = rows.where(F.col("shape") == shape).select("rec_id", "k"), []
        for s in plan.of(shape):
            if s.kind == "static":
                pieces.append(F.lit(s.first_value))
            else:
                values = rle.numeric_decode(read(s.name), "k", "v").withColumn("v", F.col("v").cast("string")) if s.kind == "numeric" else _strings(read(s.name), s.max_len)
                own = own.join(values.withColumnRenamed("v", f"v{s.pos}"), "k")
                pieces.append(F.col(f"v{s.pos}"))
            pieces.append(F.lit(s.delimiter))
        ids = ids.unionByName(own.select("rec_id", F.concat(*pieces).alias("identifier")))
    bases = bits.reassembled(read("bases"), lengths)
    book = huffman.canonical({r["symbol"]: r["length"] for r in read("book").collect()})
    own = lengths.select("rec_id", "length").join(read("quality_lengths"), "rec_id", "left").select("rec_id", F.coalesce("n_quality", "length").alias("length"))
    quality = huffman.decoded(read("quality"), running_sum(own, "rec_id", {"offset": F.col("length")}, exclusive=True), book)
    plus = read("plus").withColumnRenamed("plus", "__plus")
    out = ids.join(bases, "rec_id").join(quality, "rec_id").join(plus, "rec_id", "left")
    return out.select("rec_id", "identifier", "bases", F.coalesce("__plus", F.lit("+")).alias("plus"), "quality")
