"""Content-addressed WARC archive.

Writing turns pages into WARC records: the exact header block of every record
goes to a table of its own, and payload bytes are stored once, compressed,
under their SHA-256.  Of records with equal payloads of at least ``least``
bytes the one with the smallest id is a response and the others are revisits of
it; smaller ones are all responses (and still share their stored bytes).

Reading joins the payloads, each verified against its SHA-256, to the headers
of the responses, which gives back every record byte by byte; revisits have no
bytes of their own.  ``judged`` parses the rebuilt records: header fields,
length and SHA-1 of the content, and for revisits those of the response that
they refer to.

Layout of an archive: ``records`` (id, sha256, type, refers_to, headers) and
``payloads`` (sha256, responses, payload in Zstandard), both Parquet.
``members`` turns rebuilt records into gzip members, and ``parse`` reads files
made of such members, or of plain records.

Edge cases: a null payload is empty; a null URL gives a record without
WARC-Target-URI, and line ends in one become spaces; payloads of any length
are handled one at a time; rows with the same id and payload all get a record,
of which one is the response; rows without an id get records too, and are
responses only where their payload has no id at all; an empty table gives an empty archive;
other columns are not archived, so theirs may have any names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches, join_hot, materialize

#: Fixed value: the alphabet of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END, TAIL = "\r\n", b"\r\n\r\n"


@dataclass(frozen=True)
class Warc:
    least: int = 0
    date: str = "2024-01-01T00:00:00Z"


class Damaged(ValueError):
    """An archive whose parts do not fit together."""


def base32(hex40: Column) -> Column:
    """Base 32 of 40 hex digits: five of them are four characters."""
    parts = []
    for at in range(1, 41, 5):
        n = F.conv(F.substring(hex40, at, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(BASE32), F.shiftright(n, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*parts)


def _body(payload: str) -> Column:
    return F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit("").cast("binary"))


def digests(pages: DataFrame, id_col: str, url: str, payload: str) -> DataFrame:
    """(id, url, n, sha1, sha256) of every row."""
    body = _body(payload)
    return pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.octet_length(body).cast("long").alias("n"), F.unhex(F.sha1(body)).alias("sha1"), F.unhex(F.sha2(body, 256)).alias("sha256"))


def _uuid(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("<urn:record:"), c.cast("string"), F.lit(">")), F.lit("<urn:record-without-id>"))


def header(spec: Warc) -> Column:
    """The exact header block of a record."""
    revisit = F.col("type") == "revisit"
    lines = [
        F.lit("WARC/1.1" + END),
        F.concat(F.lit("WARC-Type: "), F.col("type"), F.lit(END)),
        F.concat(F.lit("WARC-Record-ID: "), _uuid(F.col("id")), F.lit(END)),
        F.lit(f"WARC-Date: {spec.date}{END}"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " "), F.lit(END)), F.lit("")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}WARC-Refers-To: "), _uuid(F.col("refers_to")), F.lit(END))).otherwise(""),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.hex("sha1")), F.lit(END)),
        F.lit(f"Content-Type: text/html{END}"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string"), F.lit(END + END)),
    ]
    return F.concat(*lines).cast("binary")


def _squeezed(rows: DataFrame) -> DataFrame:
    """rows with the last column, ``payload``, compressed."""
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([squeeze(x) for x in b.column(b.num_columns - 1).to_pylist()], pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def write(pages: DataFrame, path: str, spec: Warc = Warc(), id_col: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write the archive of pages to the folder `path`."""
    bound_batches(pages.sparkSession)
    narrow = materialize(digests(pages, id_col, url, payload).withColumn("row", F.monotonically_increasing_id()), "digests")
    # one row per content, aggregated before the shuffle; contents with very many copies are broadcast to them.
    # Rows with the least id of their content may repeat: one of them is the first
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "url", "row"))
    contents = materialize(narrow.groupBy("sha256").agg(least.alias("f"), F.count("*").alias("copies")), "contents")
    typed = join_hot(narrow, contents, "sha256", "copies").withColumn("first", F.col("f.id"))
    shared = (F.col("copies") > 1) & (F.col("n") >= spec.least)
    revisit = shared & (F.col("row") != F.col("f.row"))
    records = typed.withColumn("type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first")))
    records.select("id", "sha256", "type", "refers_to", header(spec).alias("headers")).write.parquet(f"{path}/records")
    # payload bytes: those of one row per content.  Rows that are not the first of theirs are left out, by a list
    # that is broadcast if it is short (its size is known from its files); ties, if any, meet by digest.
    drop = materialize(typed.where(~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("__id"), F.col("sha256").alias("__sha")), "copies")
    body = _body(payload)
    kept = _squeezed(pages.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.sha2(body, 256)).alias("sha256"), body.alias("payload")))
    kept = kept.join(drop, F.col("id").eqNullSafe(F.col("__id")) & (F.col("sha256") == F.col("__sha")), "left_anti").select("sha256", "payload")
    if not typed.where((F.col("row") != F.col("f.row")) & F.col("id").eqNullSafe(F.col("first"))).isEmpty():
        kept = kept.groupBy("sha256").agg(F.first("payload").alias("payload"))
    many = materialize(typed.where((F.col("copies") > 1) & ~shared).groupBy("sha256").agg(F.count("*").alias("__n")), "many").withColumnRenamed("sha256", "__sha")
    kept = kept.join(many, F.col("sha256") == F.col("__sha"), "left").select("sha256", F.coalesce("__n", F.lit(1).cast("long")).alias("responses"), "payload")
    kept.write.parquet(f"{path}/payloads")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record, rebuilt: id, sha256, type, refers_to and record (its exact bytes).

    A payload that differs from its digest, and a response without a payload, raise an error.
    """
    bound_batches(spark)
    records, stored = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    # a key meets as many rows as it has responses: more than one only for payloads under `least` bytes
    responses = join_hot(records.where("type = 'response'"), stored.select("sha256", "responses", "payload"), "sha256", "responses")
    whole = responses.select("id", "sha256", "type", "refers_to", "headers", "payload")
    lost = records.where("type = 'response'").join(stored.select(F.col("sha256").alias("s")), F.col("sha256") == F.col("s"), "left_anti")
    missing = lost.select("id", "sha256", "type", "refers_to", "headers", F.lit(None).cast("binary").alias("payload"))
    schema = T.StructType([*whole.schema.fields[:4], T.StructField("record", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for at in range(0, b.num_rows, 256):  # compressed bytes may be many times as long
                part = b.slice(at, 256)
                out = []
                for sha, head, x in zip(part.column(1).to_pylist(), part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True):
                    if x is None:
                        raise Damaged(f"record without its payload {sha.hex()}")
                    body = loose(x)
                    if hashlib.sha256(body).digest() != sha:
                        raise Damaged(f"payload differs from its digest {sha.hex()}")
                    out.append(head + body + TAIL)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(out, pa.binary())], names=schema.names)

    bare = records.where("type <> 'response'").select("id", "sha256", "type", "refers_to", F.concat("headers", F.lit(TAIL)).alias("record"))
    return whole.unionByName(missing).mapInArrow(run, schema).unionByName(bare)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of the records of a .warc or .warc.gz file."""
    raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(raw):
        end = raw.find(TAIL, at) + 4
        if end < 4 or not raw.startswith(b"WARC/1.", at):
            raise Damaged("a record without a header block")
        fields = dict(re.findall(r"^([^:\r\n]+): ([^\r]*)\r$", raw[at : end - 2].decode("utf-8", "replace"), re.MULTILINE))
        n = int(fields.get("Content-Length", -1))
        if n < 0 or raw[end + n : end + n + 4] != TAIL:
            raise Damaged("a record that does not end where its length says")
        yield fields, raw[end : end + n]
        at = end + n + 4


def parsed(records: DataFrame) -> DataFrame:
    """What rebuilt records say of themselves: id, sha256, record_type, refers_to, digest (bare base 32) and content_bytes.

    Content whose SHA-1 is not the header's, and headers that do not fit the table, raise an error.
    """
    schema = T.StructType([records.schema["id"], records.schema["sha256"], *[T.StructField(c, T.StringType()) for c in ("record_type", "refers_to", "digest")], T.StructField("content_bytes", T.LongType())])
    src = records.select("id", "sha256", _uuid(F.col("id")).alias("name"), "type", "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, kind, raw in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                (fields, content), *more = parse(raw)
                digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                if more or fields.get("WARC-Type") != kind or fields.get("WARC-Record-ID") != name:
                    raise Damaged(f"header of another record: {name}")
                if kind == "response" and base64.b32encode(hashlib.sha1(content).digest()).decode() != digest:
                    raise Damaged(f"content differs from its digest: {name}")
                refers = re.fullmatch(r"<urn:record:(.*)>", fields.get("WARC-Refers-To", ""))
                out.append((kind, refers[1] if refers else None, digest, len(content)))
            cols = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=schema.names)

    return src.mapInArrow(run, schema)


def judged(spark: SparkSession, path: str) -> DataFrame:
    """Per record of the archive at `path`, from the rebuilt records: id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's payload is that of the response it refers to; one without such a response raises an error.
    """
    rows = materialize(parsed(read(spark, path)), "parsed")
    kind = rows.schema["id"].dataType
    revisits = rows.where("record_type = 'revisit'").withColumn("refers_to", F.col("refers_to").cast(kind))
    responses = rows.where("record_type = 'response'")
    counts = revisits.groupBy("sha256").agg(F.count("*").alias("n"))
    of = F.col("r.sha256") == F.col("c.sha256")
    known = responses.alias("r").join(counts.alias("c"), of).select(F.col("r.sha256").alias("sha256"), F.col("r.id").alias("first"), F.col("r.digest").alias("whole"), F.col("r.content_bytes").alias("payload_bytes"), "n")
    known = materialize(known, "referred")
    lost = revisits.join(known.select(F.col("sha256").alias("s")), F.col("sha256") == F.col("s"), "left_anti")
    if not lost.isEmpty():
        raise Damaged("revisits without a response")
    met = join_hot(revisits, known, "sha256", "n")
    fits = F.col("first").eqNullSafe(F.col("refers_to")) & (F.col("whole") == F.col("digest"))
    digest = F.when(fits, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("revisit that differs from its response: "), F.col("digest"))))
    own = responses.select("id", F.col("content_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    return own.unionByName(met.select("id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to"))


def members(records: DataFrame) -> DataFrame:
    """(id, member): each record as a gzip member; members put after each other are a .warc.gz file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([gzip.compress(x, mtime=0) for x in b.column(1).to_pylist()], pa.binary())], names=["id", "member"])

    src = records.select("id", "record")
    return src.mapInArrow(run, T.StructType([src.schema["id"], T.StructField("member", T.BinaryType())]))
