"""Queries over the driver's tables, one or more for each operator, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracles
from .functions import columns as C
from .operators import bits, bitshuffle, delta, feedback, flat, huffman, lz, rle, segments, sparse, spline, stats, wavefront, wide
from .operators.scan import dense_id, lagged, running_sum
from .plans import arrays as array_plan
from .plans import fastq as fastq_plan
from .plans.options import Codec, Mode, Options, Predictor
from .session import dealt, materialize, read_table, scratch_path
from .sources import arrays, fastq, parts
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Error bounds of the queries on events, embeddings and the spline.
EB1, EB2, EB3 = 0.5, 0.01, 0.02

_FQ = """fq as (
  select row_number() over (order by doc_id) - 1 as rec_id,
    '@SIM1.' || (doc_id + 1) || ' RUN:7:' || (1100 + doc_id // 100) || '/1' as identifier,
    translate(md5(text), '0123456789abcdef', 'ACGTACGTACGTACGN') as bases, '+' as plus,
    translate(md5(cast(doc_id as varchar)), '0123456789abcdef', 'IIIIFFFFDDBB@<:#') as quality
  from documents)"""
_LINES = f"{_FQ}, lines as (select rec_id * 4 + k as line_no, [identifier, bases, plus, quality][k + 1] as line from fq, (select unnest(range(4)) as k))"
_BASES = f"{_FQ}, b as (select 32 * rec_id + i as g, substr(bases, i + 1, 1) as base from fq, (select unnest(range(32)) as i))"
_EV = "ev as (select event_id, event_type, value, row_number() over (order by event_id) - 1 as x from events)"
_Q1 = f"""{_EV}, q as (select x, value, cast(round(value / {2 * EB1}) as bigint) as q from ev),
d as (select *, q - coalesce(lag(q) over (partition by x // 256 order by x), 0) as d from q),
c as (select *, case when abs(d) < 512 then d + 512 else 0 end as code, case when abs(d) >= 512 then d + 512 end as outlier from d)"""
_E2 = f"e2 as (select i as x, vec_id as y, cast(embedding[i + 1] as double) as value, cast(round(cast(embedding[i + 1] as double) / {2 * EB2}) as bigint) as q from embeddings, (select unnest(range(64)) as i))"
_E3 = _E2.replace("e2 as", "e3 as").replace("i as x, vec_id as y", "i % 8 as x, i // 8 as y, vec_id as z")
#: Code lengths of the quality symbols, for queries whose SQL needs a fixed book.
QUALITY_LENGTHS = {"I": 2, "F": 2, "D": 3, "B": 3, "@": 4, "<": 4, ":": 4, "#": 4}
_BOOK = "book as (select * from (values " + ", ".join(f"({ord(c)}, {n})" for c, n in QUALITY_LENGTHS.items()) + ") as t(symbol, length))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def reads(spark: SparkSession, sf: str) -> DataFrame:
    return fastq.synthesize(read_table(spark, sf, "documents"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events numbered from 0."""
    return dense_id(read_table(spark, sf, "events").select("event_id", "event_type", "value", "user_id"), "event_id", "x")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.embedding_cells(read_table(spark, sf, "embeddings"))


def cube(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.embedding_cube(read_table(spark, sf, "embeddings"))


# Indexing and records


@query(f"with {_FQ} select * from fq")
def fastq_records(spark, sf):
    return reads(spark, sf)


@query(f"with {_LINES} select line_no, cast(sum(strlen(line) + 1) over (order by line_no) - strlen(line) - 1 as bigint) as start, strlen(line) as length from lines")
def line_index(spark, sf):
    lines = fastq.to_lines(reads(spark, sf)).withColumn("length", F.octet_length("line").cast("long"))
    return running_sum(lines, "line_no", {"start": F.col("length") + 1}, exclusive=True).select("line_no", "start", "length")


@query("select doc_id, cast(len(text) - len(replace(text, chr(10), '')) as bigint) as n_lines from documents")
def line_count(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("n_lines"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i, strlen(text) as size from documents),
s as (select *, sum(strlen(line) + 1) over (partition by doc_id order by i) - strlen(line) - 1 as start from l)
select doc_id, cast(i - 1 as bigint) as line_no, cast(start as bigint) as start from s where start < size or i = 1""")
def newline_offsets(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("size"), F.split("text", "\n").alias("lines"))
    fast = docs.select("doc_id", "size", F.posexplode("lines").alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.octet_length("line").cast("long") + 1
    out = fast.withColumn("start", F.sum(n).over(w) - n)
    return out.where((F.col("start") < F.col("size")) | (F.col("line_no") == 0)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "start")


@query(f"with {_LINES} select count(*) as n_lines, count(*) % 4 = 0 as whole from lines")
def record_check(spark, sf):
    return fastq.to_lines(reads(spark, sf)).agg(F.count("*").alias("n_lines"), (F.count("*") % 4 == 0).alias("whole"))


@query(f"with {_FQ} select * from fq")
def record_assembly(spark, sf):
    lines = fastq.to_lines(reads(spark, sf)).withColumn("file", F.lit("f"))
    return fastq.assemble(lines).drop("file")


@query(f"with {_LINES} select line_no // 4 as rec_id, cast(max(case when line_no % 4 = 1 then strlen(line) end) as bigint) as n_bases, cast(max(case when line_no % 4 = 3 then strlen(line) end) as bigint) as n_quality from lines group by 1")
def field_lengths(spark, sf):
    lines = fastq.to_lines(reads(spark, sf))
    n = lambda k: F.max(F.when(F.col("line_no") % 4 == k, F.octet_length("line"))).cast("long")
    return lines.groupBy(F.floor(F.col("line_no") / 4).alias("rec_id")).agg(n(1).alias("n_bases"), n(3).alias("n_quality"))


@query(f"with {_FQ} select rec_id, strlen(quality) as n, cast(sum(strlen(quality)) over (order by rec_id) - strlen(quality) as bigint) as offset, quality from fq".replace(" as offset", ' as "offset"'))
def quality_gather(spark, sf):
    rows = reads(spark, sf).select("rec_id", "quality").withColumn("n", F.octet_length("quality").cast("long"))
    return running_sum(rows, "rec_id", {"offset": F.col("n")}, exclusive=True).select("rec_id", "n", "offset", "quality")


# Identifiers

_PIECES = r"""p as (select page_id, regexp_split_to_array(url, '[. :/]') as parts, regexp_extract_all(url, '[. :/]') as ends from pages),
t as (select page_id, case when parts[len(parts)] = '' then parts[1:len(parts) - 1] else parts end as parts, ends from p),
s as (select page_id, generate_subscripts(parts, 1) - 1 as pos, unnest(parts) as segment, ends from t)"""


@query(f"with {_PIECES} select page_id, cast(pos as integer) as pos, segment, coalesce(ends[pos + 1], '') as delimiter, regexp_full_match(segment, '[0-9]+') as is_numeric from s")
def segment_split(spark, sf):
    return segments.exploded(read_table(spark, sf, "pages"), "url", ["page_id"]).withColumnRenamed("numeric", "is_numeric")


_IDS = f"""{_FQ}, p as (select rec_id, regexp_split_to_array(identifier, '[. :/]') as parts from fq),
s as (select rec_id, cast(generate_subscripts(parts, 1) - 1 as integer) as pos, unnest(parts) as segment from p)"""


@query(f"with {_IDS} select pos, min(cast(regexp_full_match(segment, '[0-9]+') and cast(try_cast(segment as bigint) as varchar) = segment as integer)) = 1 as is_numeric, min(segment) = max(segment) as is_static, cast(max(strlen(segment)) + 1 as integer) as max_len, arg_min(segment, rec_id) as first_value, count(*) as n_rows from s group by pos")
def segment_types(spark, sf):
    return segments.infer(reads(spark, sf), "identifier", "rec_id").select("pos", "is_numeric", "is_static", "max_len", "first_value", "n_rows")


@query(f"""with {_IDS}, n as (select count(*) as n, least(count(*), 10) as k from fq),
ids as (select distinct (n - 1) * i // greatest(k - 1, 1) as rec_id from n, (select unnest(range(10)) as i) where i < k)
select pos, regexp_full_match(min(case when rec_id = 0 then segment end), '[0-9]+') as is_numeric, min(segment) = max(segment) as is_static,
  cast(max(case when rec_id = 0 then strlen(segment) end) + 1 as integer) as max_len, min(case when rec_id = 0 then segment end) as first_value
from s join ids using (rec_id) group by pos""")
def segment_first(spark, sf):
    return segments.infer(reads(spark, sf), "identifier", "rec_id", mode="first").select("pos", "is_numeric", "is_static", "max_len", "first_value")


@query(f"with {_FQ}, n as (select count(*) as n, least(count(*), 10) as k from fq) select distinct (n - 1) * i // greatest(k - 1, 1) as rec_id from n, (select unnest(range(10)) as i) where i < k")
def segment_sample10(spark, sf):
    return segments.sample_ids(reads(spark, sf), "rec_id")


@query(r"""with s as (select doc_id, translate(substr(md5(text), 1, 12), 'abcdef', '012345') as digits, substr(md5(text), 1, 3) as mixed from documents),
w as (select *, cast(digits as hugeint) % 4294967296 as low from s)
select doc_id, digits, cast(case when low >= 2147483648 then low - 4294967296 else low end as integer) as wrapped, case when regexp_full_match(mixed, '[0-9]+') then cast(mixed as integer) else -1 end as small from w""")
def segment_to_int(spark, sf):
    h = F.md5(F.col("text").cast("binary"))
    docs = read_table(spark, sf, "documents").select("doc_id", F.translate(F.substring(h, 1, 12), "abcdef", "012345").alias("digits"), F.substring(h, 1, 3).alias("mixed"))
    return docs.select("doc_id", "digits", C.wrapped_int(F.col("digits")).alias("wrapped"), C.wrapped_int(F.col("mixed")).alias("small"))


@query(f"with {_IDS} select rec_id, " + ", ".join(f"max(case when pos = {i} then segment end) as seg_{i}" for i in range(6)) + " from s group by rec_id")
def segment_columns(spark, sf):
    return segments.columns(reads(spark, sf), "identifier", 6).select("rec_id", *[f"seg_{i}" for i in range(6)])


@query("select page_id, len(regexp_extract_all(url, '[. :/]')) as n_delimiters, substr(segment, 1, 5) as cut from (select page_id, url, regexp_split_to_array(url, '[. :/]')[4] as segment from pages)")
def segment_truncate(spark, sf):
    url = F.col("url")
    n = F.size(segments.delimiters_of(url)).cast("long")
    return read_table(spark, sf, "pages").select("page_id", n.alias("n_delimiters"), segments.truncated(F.get(F.split(url, "[. :/]", -1), F.lit(3)), 6).alias("cut"))


# Differences, scans and runs


@query("select event_id, user_id - coalesce(lag(user_id) over (order by event_id), 0) as delta from events")
def lorenzo1d_int(spark, sf):
    return delta.first_difference(read_table(spark, sf, "events").select("event_id", "user_id"), "event_id", "user_id").select("event_id", "delta")


@query("select event_id, cast(sum(user_id) over (order by event_id) as bigint) as total from events")
def prefix_scan(spark, sf):
    return delta.prefix_sum(read_table(spark, sf, "events").select("event_id", "user_id"), "event_id", "user_id").select("event_id", "total")


@query("select event_id, user_id from events")
def prefix_scan_inverse(spark, sf):
    d = delta.first_difference(read_table(spark, sf, "events").select("event_id", "user_id"), "event_id", "user_id")
    return delta.prefix_sum(d.select("event_id", "delta"), "event_id", "delta", "user_id").select("event_id", "user_id")


_RUNS = f"""{_EV}, m as (select *, case when event_type = lag(event_type) over (order by x) then 0 else 1 end as new from ev),
r as (select *, sum(new) over (order by x) - 1 as run from m), runs as (select run, event_type, min(x) as start, count(*) as length from r group by 1, 2)"""


@query(f"with {_RUNS} select cast(run as bigint) as run, event_type, start, length from runs")
def rle_encode(spark, sf):
    return rle.encode(events(spark, sf), "x", "event_type")


@query(f"with {_EV} select x, event_type from ev")
def rle_decode(spark, sf):
    runs = rle.encode(events(spark, sf), "x", "event_type")
    return rle.decode(runs, "event_type").withColumnRenamed("start", "x").select("x", "event_type")


@query(f"with {_RUNS}, p as (select *, unnest(range((length - 1) // 2 + 1)) as part from runs) select cast(run as bigint) as run, part, event_type, start + part * 2 as start, least(2, length - part * 2) as length from p")
def rle_capped(spark, sf):
    return rle.encode(events(spark, sf), "x", "event_type", most=2)


@query(f"""with {_FQ}, v as (select rec_id, 1100 + (rec_id // 100) as v from (select doc_id as rec_id from documents)),
d as (select rec_id, v - coalesce(lag(v) over (order by rec_id), 0) as d from v),
m as (select rec_id, d, case when d = lag(d) over (order by rec_id) then 0 else 1 end as new from d),
t as (select count(*) as n, cast(sum(new) as bigint) as runs from m)
select n, runs, 4 + 8 * runs as coded_bytes, 4 * n as raw_bytes, 4 + 8 * runs <= 4 * n as use_runs, least(4 + 8 * runs, 4 * n) as bytes from t""")
def rle_int_codec_size(spark, sf):
    ids = segments.columns(reads(spark, sf), "identifier", 6).select("rec_id", F.col("seg_4").cast("long").alias("tile"))
    return rle.numeric_codec(ids, "rec_id", "tile")


@query(f"with {_FQ} select rec_id, cast(split_part(split_part(identifier, ':', 3), '/', 1) as bigint) as tile from fq")
def rle_int_roundtrip(spark, sf):
    ids = segments.columns(reads(spark, sf), "identifier", 6).select("rec_id", F.col("seg_4").cast("long").alias("tile"))
    return rle.numeric_decode(rle.numeric_encode(ids, "rec_id", "tile"), "rec_id", "tile")


# Bases


@query(f"with {_FQ} select rec_id, strlen(bases) as length, cast(sum(strlen(bases)) over (order by rec_id) - strlen(bases) as bigint) as \"offset\" from fq")
def base_lengths_offsets(spark, sf):
    return flat.with_offsets(reads(spark, sf)).select("rec_id", "length", "offset")


@query(f"with {_BASES} select g // 4 as byte_id, cast(sum(case base when 'C' then 1 when 'G' then 2 when 'T' then 3 else 0 end << cast(2 * (g % 4) as integer)) as integer) as byte from b group by 1")
def base_pack2bit(spark, sf):
    return bits.packed(reads(spark, sf))


@query(f"with {_BASES} select g, base from b where base = 'N'")
def n_positions(spark, sf):
    return bits.exceptions(reads(spark, sf))


@query(f"with {_FQ} select rec_id, bases from fq")
def base_unpack(spark, sf):
    r = reads(spark, sf)
    return bits.reassembled(bits.blocks(r), flat.with_offsets(r).select("rec_id", "length", "offset"))


@query(f"with {_BASES}, t as (select count(*) as n, count(*) filter (where base not in ('A', 'C', 'G', 'T')) as e from b) select n as n_bases, 2 * n as bits, (2 * n + 7) // 8 as packed_bytes, e as n_exceptions, (2 * n + 7) // 8 + 4 * e as total_bytes from t")
def base_sizes(spark, sf):
    return bits.sizes(reads(spark, sf))


@query(f"with {_BASES} select base, case base when 'C' then 1 when 'G' then 2 when 'T' then 3 else 0 end as code, case base when 'N' then 'A' else base end as back, count(*) as n from b group by base")
def base_codes(spark, sf):
    code = C.base_code(F.col("base"))
    counts = huffman.byte_histogram(reads(spark, sf), "bases").where("n > 0").withColumn("base", F.char("symbol"))
    return counts.select("base", code.alias("code"), C.code_base(code).alias("back"), "n")


# Histograms and statistics

_CHARS = f"{_FQ}, ch as (select 32 * rec_id + i as pos, ascii(substr(quality, i + 1, 1)) as symbol from fq, (select unnest(range(32)) as i))"


@query(f"with {_CHARS}, c as (select symbol, count(*) as n from ch group by 1) select cast(s as integer) as symbol, coalesce(n, 0) as n from (select unnest(range(256)) as s) left join c on s = symbol")
def hist256(spark, sf):
    return huffman.byte_histogram(reads(spark, sf), "quality")


@query(f"with {_CHARS}, c as (select symbol, count(*) as n from ch where pos < (select cast(floor(0.2 * count(*)) as bigint) from ch) group by 1) select cast(s as integer) as symbol, coalesce(n, 0) + 1 as n from (select unnest(range(256)) as s) left join c on s = symbol")
def hist256_prefix(spark, sf):
    return fastq_plan.quality_histogram(reads(spark, sf))


@query(f"with {_Q1}, k as (select code, count(*) as n from c group by 1) select cast(s as integer) as symbol, coalesce(n, 0) as n from (select unnest(range(1024)) as s) left join k on s = code")
def hist_quantcode(spark, sf):
    return huffman.histogram(delta.quantized(events(spark, sf), "value", 1, EB1), "code", 1024)


@query(f"with {_CHARS}, c as (select symbol, count(*) as n from ch group by 1) select round(-sum(n / t * log2(n / t)), 9) as entropy from c, (select count(*) as t from ch)")
def entropy_bits(spark, sf):
    return stats.entropy(huffman.byte_histogram(reads(spark, sf), "quality")).select(F.round("entropy", 9).alias("entropy"))


@query("select min(value) as min, max(value) as max, round(avg(value), 9) as avg, max(value) - min(value) as rng, round(stddev_pop(value), 9) as std from events")
def extrema(spark, sf):
    return stats.extrema(read_table(spark, sf, "events"), "value").select("min", "max", F.round("avg", 9).alias("avg"), "rng", F.round("std", 9).alias("std"))


_REC = f"{_EV}, r as (select x, value as o, round(value / {2 * EB1}) * {2 * EB1} as r from ev)"


def _dry(spark, sf):
    return delta.dry_run(events(spark, sf).select("x", "value"), "value", EB1)


@query(f"""with {_REC}, e as (select *, abs(o - r) as err from r), m as (select max(err) as me from e)
select count(*) as n, min(o) as min_original, max(o) as max_original, max(r) as max_restored, round(stddev_pop(o), 6) as std_original, round(stddev_pop(r), 6) as std_restored,
  round(avg((o - r) * (o - r)), 9) as mse, round(20 * log10(max(o) - min(o)) - 10 * log10(avg((o - r) * (o - r))), 6) as psnr, round(sqrt(avg((o - r) * (o - r))) / (max(o) - min(o)), 9) as nrmse,
  round(corr(o, r), 9) as coeff, max(err) as max_abs_err, round(max(err) / (max(o) - min(o)), 9) as max_rel_err, round(max(case when o <> 0 then err / abs(o) end), 6) as max_pw_rel_err,
  min(case when err = me then x end) as max_err_idx from e, m""")
def assess_quality(spark, sf):
    out = stats.assess(_dry(spark, sf), "value", "restored", "x")
    places = {"std_original": 6, "std_restored": 6, "mse": 9, "psnr": 6, "nrmse": 9, "coeff": 9, "max_rel_err": 9, "max_pw_rel_err": 6}
    return out.select(*[F.round(c, places[c]).alias(c) if c in places else c for c in out.columns])


@query(f"with {_REC} select max(abs(o - r)) as max_err, min(case when abs(o - r) = (select max(abs(o - r)) from r) then x end) as idx from r")
def max_error_argmax(spark, sf):
    return stats.max_error(_dry(spark, sf), "value", "restored", "x")


@query(f"with {_REC} select max(abs(o - r)) <= 1.001 * {EB1} as bounded, min(case when abs(o - r) > 1.001 * {EB1} then x end) as first_bad from r")
def error_bounded(spark, sf):
    return stats.error_bounded(_dry(spark, sf), "value", "restored", EB1, "x")


@query(f"with {_REC} select max(abs(o - r)) <= 0.1001 as bounded, min(case when abs(o - r) > 0.1001 then x end) as first_bad from r")
def error_bound_broken(spark, sf):
    return stats.error_bounded(_dry(spark, sf), "value", "restored", 0.1, "x")


@query(f"with {_REC} select min(cast(o = r as integer)) = 1 as identical, count(*) filter (where o <> r) as n_different from r")
def identical(spark, sf):
    return stats.identical(_dry(spark, sf), "value", "restored")


@query(f"with {_EV}, l as (select value as v, lead(value, 1) over (order by x) as v1, lead(value, 2) over (order by x) as v2 from ev) select round(corr(v, v1), 9) as lag1, round(corr(v, v2), 9) as lag2 from l")
def autocorr_lag12(spark, sf):
    return stats.autocorrelation(events(spark, sf), "x", "value").select(F.round("lag1", 9).alias("lag1"), F.round("lag2", 9).alias("lag2"))


@query("with r as (select min(value) as lo, (max(value) - min(value)) / 20 as step from events) select least(cast(floor((value - lo) / step) as bigint), 19) as bin, count(*) as n from events, r group by 1")
def hist_equiwidth(spark, sf):
    ev = read_table(spark, sf, "events")
    r = stats.extrema(ev, "value").first()
    return stats.equal_width(ev, "value", 20, r["min"], r["max"])


@query(f"with {_Q1} select count(*) filter (where code < 0 or code >= 1024) as out_of_range, count(*) filter (where code = 0) as zeros, count(code) > 0 as \"any\" from c")
def code_check(spark, sf):
    return stats.code_check(delta.quantized(events(spark, sf), "value", 1, EB1), "code", 1024)


@query(f"with {_CHARS}, c as (select symbol, count(*) as n from ch group by 1) select cast(symbol as integer) as symbol, n from c order by n desc, symbol limit 5")
def top_symbols(spark, sf):
    return huffman.byte_histogram(reads(spark, sf), "quality").where("n > 0").orderBy(F.desc("n"), "symbol").limit(5)


# Arrays


@query(f"with {_Q1} select x, q, q * cast({2 * EB1} as double) as restored from c")
def prequant(spark, sf):
    q = C.prequantize(F.col("value"), EB1)
    return events(spark, sf).select("x", q.alias("q"), C.dequantize(q, EB1).alias("restored"))


@query(f"with {_Q1} select x, q, d, code, outlier from c")
def lorenzo1d_quant(spark, sf):
    return delta.quantized(events(spark, sf).select("x", "value"), "value", 1, EB1).select("x", "q", "d", "code", "outlier")


_D2 = f"""{_E2}, dx as (select *, q - coalesce(lag(q) over (partition by y, x // 16 order by x), 0) as dx from e2),
d2 as (select *, dx - coalesce(lag(dx) over (partition by x, y // 16 order by y), 0) as d from dx)"""
_D3 = f"""{_E3}, dx as (select *, q - coalesce(lag(q) over (partition by y, z order by x), 0) as dx from e3),
dy as (select *, dx - coalesce(lag(dx) over (partition by x, z order by y), 0) as dy from dx),
d3 as (select *, dy - coalesce(lag(dy) over (partition by x, y, z // 8 order by z), 0) as d from dy)"""


@query(f"with {_D2} select cast(x as bigint) as x, y, q, d, case when abs(d) < 16 then d + 16 else 0 end as code, case when abs(d) >= 16 then d + 16 end as outlier from d2")
def lorenzo2d_quant(spark, sf):
    return delta.quantized(cells(spark, sf), "value", 2, EB2, radius=16).select("x", "y", "q", "d", "code", "outlier")


@query(f"with {_D3} select cast(x as bigint) as x, cast(y as bigint) as y, z, q, d, case when abs(d) < 32 then d + 32 else 0 end as code from d3")
def lorenzo3d_quant(spark, sf):
    return delta.quantized(cube(spark, sf), "value", 3, EB2, radius=32).select("x", "y", "z", "q", "d", "code")


@query(f"with {_Q1} select x, case when abs(d) >= 512 then 0 when d >= 0 then 2 * d else -2 * d - 1 end as code, case when abs(d) >= 512 then d end as outlier, d as back from c")
def zigzag_codes(spark, sf):
    out = delta.quantized(events(spark, sf).select("x", "value"), "value", 1, EB1, use_zigzag=True)
    return out.select("x", "code", "outlier", C.unzigzag(C.zigzag(F.col("d"))).alias("back"))


@query(f"with {_REC} select x, r * 1.0 as restored from r")
def lorenzo_inverse(spark, sf):
    coded = delta.quantized(events(spark, sf).select("x", "value"), "value", 1, EB1).select("x", "code", "outlier")
    return delta.restored(coded, 1, EB1).select("x", "restored")


@query(f"with {_E2} select cast(x as bigint) as x, y, q from e2")
def lorenzo_inverse_2d(spark, sf):
    coded = delta.quantized(cells(spark, sf), "value", 2, EB2, radius=16).select("x", "y", "code", "outlier")
    return delta.restored(coded, 2, EB2, radius=16).select("x", "y", F.col("q2").alias("q"))


@query(f"with {_E3} select cast(x as bigint) as x, cast(y as bigint) as y, z, q from e3")
def lorenzo_inverse_3d(spark, sf):
    coded = delta.quantized(cube(spark, sf), "value", 3, EB2, radius=16, use_zigzag=True).select("x", "y", "z", "code", "outlier")
    return delta.restored(coded, 3, EB2, radius=16, use_zigzag=True).select("x", "y", "z", F.col("q2").alias("q"))


@query("select event_id, value from events where abs(value) >= 100")
def outlier_gather(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "value")
    return sparse.gather(ev, "event_id", "value", C.in_ball(F.col("value"), 100))[0]


@query("select event_id, value from events")
def outlier_scatter(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "value")
    some, dense = sparse.gather(ev, "event_id", "value", C.in_ball(F.col("value"), 100))
    return sparse.scatter(dense, some, "event_id", "value")


@query("select d.doc_id, case when l.quality is null then -1 else l.quality end as quality from documents d left join labels l using (doc_id)")
def scatter_labels(spark, sf):
    dense = read_table(spark, sf, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return sparse.scatter(dense, read_table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query(f"with {_Q1} select x, d as value from c where d <> 0")
def nonzero_gather(spark, sf):
    d = delta.quantized(events(spark, sf), "value", 1, EB1).select("x", F.col("d").alias("value"))
    return sparse.nonzero(d, "x", "value")


@query(f"with {_Q1} select x, d + 64 as value from c where d + 64 >= 128 or d + 64 < 0")
def split_by_radius(spark, sf):
    d = delta.quantized(events(spark, sf), "value", 1, EB1).select("x", (F.col("d") + 64).alias("value"))
    return sparse.split_by_radius(d, "x", "value", 64)


@query(f"with {_Q1} select x, code from c where code <> 512")
def split_by_usual(spark, sf):
    return sparse.split_by_value(delta.quantized(events(spark, sf), "value", 1, EB1), "x", "code", 512)


@query(f"with {_Q1} select count(*) filter (where d = 0) as n_equal, count(*) filter (where abs(d) < 32) as n_ball, count(*) filter (where d >= 0 and d < 64) as n_shifted from c")
def criteria_counts(spark, sf):
    d = F.col("d")
    return delta.quantized(events(spark, sf), "value", 1, EB1).agg(F.count_if(C.is_equal(d, 0)).alias("n_equal"), F.count_if(C.in_ball(d, 32)).alias("n_ball"), F.count_if(C.in_shifted_ball(d, 32)).alias("n_shifted"))


@query("with c as (select i // 2 as x, vec_id // 2 as y, cast(embedding[i + 1] as double) as v from embeddings, (select unnest(range(64)) as i)) select x, y, round(avg(v), 9) as mean from c group by 1, 2")
def binning2d(spark, sf):
    return delta.binned2d(cells(spark, sf)).select("x", "y", F.round("mean", 9).alias("mean"))


@query("select round((max(value) - min(value)) * 0.001, 9) as eb from events")
def rel_error_bound(spark, sf):
    eb = delta.relative_bound(read_table(spark, sf, "events"), "value", 0.001)
    return spark.range(1).select(F.round(F.lit(eb), 9).alias("eb"))


@query(f"with {_REC} select x, r * 1.0 as restored from r")
def dryrun_quant(spark, sf):
    return _dry(spark, sf).select("x", "restored")


@query(f"with {_Q1} select count(*) as n, count(outlier) as n_outliers, count(outlier) * 5 > count(*) as too_many from c")
def outlier_capacity(spark, sf):
    return delta.too_many_outliers(delta.quantized(events(spark, sf), "value", 1, EB1))


@query("select event_id, round(ln(value), 9) as log_value from events where value > 0")
def log_transform(spark, sf):
    return read_table(spark, sf, "events").where("value > 0").select("event_id", F.round(F.ln("value"), 9).alias("log_value"))


# Huffman


def _fixed_book() -> huffman.Book:
    return huffman.canonical({ord(c): n for c, n in QUALITY_LENGTHS.items()})


@query(f"with {_CHARS}, {_BOOK} select pos // 4096 as chunk_id, cast(sum(length) as bigint) as nbit, cast((sum(length) + 31) // 32 as bigint) as ncell from ch join book using (symbol) group by 1")
def huffman_chunk_bits(spark, sf):
    return huffman.chunk_bits(flat.counts_by_chunk(reads(spark, sf), "quality", "rec_id", 4096), huffman.book_frame(spark, _fixed_book()))


@query(f"with {_CHARS}, {_BOOK}, k as (select pos // 4096 as chunk_id, (sum(length) + 31) // 32 as ncell from ch join book using (symbol) group by 1) select cast(33408 + 4 * sum(ncell) as bigint) as bytes from k")
def huffman_size(spark, sf):
    return huffman_chunk_bits(spark, sf).agg(huffman.archive_size(F.sum("ncell")).alias("bytes"))


_HIST = f"{_CHARS}, qn as (select symbol, count(*) as n from ch group by 1), q0 as (select cast(symbol as integer) as symbol, n from qn), q1 as (select cast(s as integer) as symbol, coalesce(n, 0) + 1 as n from (select unnest(range(256)) as s) left join qn on s = symbol)"


@query(f"with recursive {_HIST}, {oracles.huffman('q1', 'bk')} select cast(symbol as integer) as symbol, cast(length as integer) as length, code from bk")
def huffman_book(spark, sf):
    """The book that the data's own counts give, one added to each."""
    return huffman.book_frame(spark, huffman.build(huffman.byte_histogram(reads(spark, sf), "quality", smooth=1)))


@query(f"with recursive {_HIST}, {oracles.huffman('q1', 'bk')} select cast(symbol as integer) as symbol, cast(length as integer) as length, code, lpad(bin(code), length, '0') as bits from bk")
def huffman_canonical(spark, sf):
    """The codes of that book as strings of bits."""
    return huffman_book(spark, sf).withColumn("bits", C.bit_string(F.col("code"), F.col("length")))


@query(f"with recursive {_HIST}, {oracles.package_merge('q1', 9)} select n, cost, cast(512 as bigint) as kraft, true as within from pm_cost")
def huffman_limited(spark, sf):
    """The book of at most nine bits: its symbols, cost and Kraft sum in units of 2**-9."""
    hist = huffman.byte_histogram(reads(spark, sf), "quality", smooth=1)
    book = huffman.book_frame(spark, huffman.build(hist, most=9))
    rows = book.join(hist, "symbol")
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("n") * F.col("length")).alias("cost"), F.sum(F.expr("shiftleft(1L, 9 - length)")).alias("kraft"), (F.max("length") <= 9).alias("within"))


@query("""with recursive h as (select list_sort(list(n)) as ws from (select count(*) as n from lineitem group by l_partkey)),
t(nodes, cost) as (select ws, cast(0 as bigint) from h union all select list_sort(list_append(nodes[3:], nodes[1] + nodes[2])), cost + nodes[1] + nodes[2] from t where len(nodes) > 1)
select cast(len(ws) as bigint) as symbols, cost as bits from t, h where len(nodes) = 1""")
def huffman_rounds(spark, sf):
    """What a code for part keys takes, with all nodes of a weight merged at a time."""
    return wide.cost(read_table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")))


#: Words of eight bases, as numbers of eight digits to the base of five.
_WORDS = f"""{_FQ}, w as (select 4 * rec_id + i as idx, substr(bases, cast(8 * i + 1 as bigint), 8) as word from fq, (select unnest(range(4)) as i)),
words as (select idx, cast(list_sum(list_transform(range(8), lambda k: (instr('ACGTN', substr(word, k + 1, 1)) - 1) * cast(5 ** (7 - k) as bigint))) as bigint) as symbol from w)"""


def base_words(spark: SparkSession, sf: str) -> DataFrame:
    """(idx, symbol): reads as words of eight bases, whose alphabet has 5**8 symbols."""
    words = F.posexplode(F.array(*[F.substring("bases", 8 * i + 1, 8) for i in range(4)])).alias("i", "word")
    return reads(spark, sf).select("rec_id", words).select((4 * F.col("rec_id") + F.col("i")).alias("idx"), F.conv(F.translate("word", "ACGTN", "01234"), 5, 10).cast("long").alias("symbol"))


@query(f"with {_WORDS} select idx, symbol from words")
def huffman_wide_roundtrip(spark, sf):
    """Words of bases, coded by a book that no task holds, and back."""
    words = materialize(base_words(spark, sf), "words")
    book = wide.book(words)
    return wide.decoded(materialize(wide.encoded(words, book), "chunks"), book)


@query(f"with {_WORDS}, n as (select symbol, count(*) as n from words group by 1) select n, count(*) as symbols, cast(1 as double) as kraft, true as in_order, true as one_code from n group by n")
def huffman_wide_book(spark, sf):
    """The book of words of bases by how often they occur: symbols, Kraft's sum of the whole book, whether no rarer word has a shorter code, and whether no two words share one."""
    book = wide.book(base_words(spark, sf))
    kraft = book.agg(F.sum(F.pow(F.lit(2.0), -F.col("length"))).alias("kraft"), (F.countDistinct("length", "code") == F.count("*")).alias("one_code"))
    spans = book.groupBy("n").agg(F.count("*").alias("symbols"), F.min("length").alias("least"), F.max("length").alias("most"))
    rarer = lagged(spans, "n", {"before": F.col("least")})
    # weights in order: the longest code of one is no longer than the shortest of the next rarer
    return rarer.crossJoin(kraft).select("n", "symbols", "kraft", F.coalesce(F.col("most") <= F.col("before"), F.lit(True)).alias("in_order"), "one_code")  # a one-row table


@query(f"with {_FQ} select rec_id, quality from fq")
def huffman_roundtrip(spark, sf):
    r = reads(spark, sf)
    book = huffman.build(huffman.byte_histogram(r, "quality", smooth=1))
    return huffman.decoded(materialize(huffman.encoded(r, "quality", "rec_id", book), "chunks"), flat.with_offsets(r, "quality").select("rec_id", "length", "offset"), book)


@query(f"with recursive {_HIST}, {oracles.huffman('q0', 'bk')} select cast(sum(n) as bigint) as n, cast(sum(n * length) as bigint) as bits, round(8 * sum(n) / sum(n * length), 9) as ratio from bk join q0 using (symbol)")
def huffman_estimate(spark, sf):
    hist = huffman.byte_histogram(reads(spark, sf), "quality")
    return stats.huffman_estimate(hist, huffman.book_frame(spark, huffman.build(hist)), 8).withColumn("ratio", F.round("ratio", 9))


@query(f"with {_CHARS}, {_BOOK}, k as (select pos // 4096 as chunk_id, cast((sum(length) + 31) // 32 as bigint) as ncell from ch join book using (symbol) group by 1) select chunk_id, cast(sum(ncell) over (order by chunk_id) - ncell as bigint) as entry from k")
def huffman_chunk_entries(spark, sf):
    return huffman.entries(huffman_chunk_bits(spark, sf)).select("chunk_id", "entry")


@query(f"with {_CHARS}, {_BOOK}, k as (select pos // 4096 as chunk_id, count(*) as n, cast((sum(length) + 31) // 32 as bigint) as ncell from ch join book using (symbol) group by 1) select chunk_id, n as original, 4 * ncell as coded, round(n / (4 * ncell), 9) as ratio from k")
def huffman_chunk_ratio(spark, sf):
    total = reads(spark, sf).agg(F.sum(F.octet_length("quality").cast("long")).alias("t")).first()["t"]
    n = F.least(F.lit(4096).cast("long"), F.lit(total) - F.col("chunk_id") * 4096)  # symbols of a chunk
    return huffman.chunk_ratio(huffman_chunk_bits(spark, sf), n, 8).withColumn("ratio", F.round("ratio", 9))


@query(f"with {_CHARS}, t as (select count(*) as n from ch), s as (select n, ((n - 1) // (8 * 128) + 1 + 255) // 256 * 256 as size from t) select cast(size as bigint) as sublen, cast((n - 1) // size + 1 as bigint) as pardeg from s")
def huffman_tuned(spark, sf):
    """Chunk size and number for eight cores."""
    total = reads(spark, sf).agg(F.sum(F.octet_length("quality").cast("long")).alias("t")).first()["t"]
    return spark.createDataFrame([huffman.tuned(total, 8)], "sublen long, pardeg long")


@query(f"with {_CHARS}, {_BOOK} select pos, cast(symbol as integer) as symbol from ch where symbol not in (select symbol from book where length < 4)")
def huffman_outlier_filter(spark, sf):
    """Symbols beyond a book of the commonest four, by place."""
    book = huffman.canonical({ord(c): 2 for c, n in QUALITY_LENGTHS.items() if n < 4})
    return huffman.without_uncoded(reads(spark, sf), "quality", "rec_id", book, ord("I"))[1]


@query(f"with {_CHARS}, c as (select symbol, count(*) as n from ch group by 1) select cast(symbol as integer) as symbol, n, cast(row_number() over (order by n, symbol) as integer) as place from c")
def sort_by_frequency(spark, sf):
    hist = huffman.byte_histogram(reads(spark, sf), "quality").where("n > 0")
    return hist.withColumn("place", F.row_number().over(Window.orderBy("n", "symbol")))  # 256 rows at most


@query(f"with {_BASES}, t as (select count(*) as n, (2 * count(*) + 7) // 8 + 4 * count(*) filter (where base not in ('A', 'C', 'G', 'T')) as c from b) select n as original, c as compressed, round(n / c, 9) as ratio, round(32 / (n / c), 9) as bitrate from t")
def base_ratio(spark, sf):
    cols = stats.ratios(F.col("n_bases"), F.col("total_bytes"))
    return bits.sizes(reads(spark, sf)).select(F.col("n_bases").alias("original"), F.col("total_bytes").alias("compressed"), *[F.round(c, 9).alias(k) for k, c in cols.items()])


# Window matching and bit planes


def _text_blocks(spark, sf):
    return lz.blocks(read_table(spark, sf, "benchmark").select("item_id", F.col("text").cast("binary").alias("data")), "data", ["item_id"])


@query()
def lz_block_sizes(spark, sf):
    out = lz.compressed(_text_blocks(spark, sf), ["item_id"])
    return out.select("item_id", "block_id", F.octet_length("flags").alias("flag_bytes"), F.octet_length("tokens").alias("token_bytes"))


@query("select item_id, md5(text) as digest, strlen(text) as n from benchmark")
def lz_block_roundtrip(spark, sf):
    blocks = _text_blocks(spark, sf)
    back = lz.expanded(lz.compressed(blocks, ["item_id"]), ["item_id"]).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("block_id", "data"))).alias("b"))
    back = back.select("item_id", F.aggregate("b", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["data"])).alias("back"))
    own = read_table(spark, sf, "benchmark").select("item_id", F.octet_length("text").cast("long").alias("n"))
    return own.join(back, "item_id").select("item_id", F.md5(F.substring(F.col("back"), F.lit(1), F.col("n").cast("int"))).alias("digest"), "n")


@query("select item_id, md5(text) as digest, strlen(text) as n from benchmark")
def lz_stream_roundtrip(spark, sf):
    """All blocks as one file of two contiguous streams, written and read by many tasks."""
    keyed = _text_blocks(spark, sf).withColumn("key", F.col("item_id") * (1 << 20) + F.col("block_id"))
    path = scratch_path(spark, "stream")
    parts.write_archive(lz.streamed(lz.compressed(keyed.select("key", F.col("key").alias("block_id"), "data"), ["key"]), "key"), path, ["flags", "tokens"])
    back = lz.expanded(lz.from_stream(parts.read_archive(spark, path)).withColumnRenamed("part", "block_id"), [])
    names = dense_id(keyed.select("key", "item_id"), "key", "block_id").drop("key")
    texts = back.join(names, "block_id").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("block_id", "data"))).alias("b"))
    texts = texts.select("item_id", F.aggregate("b", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["data"])).alias("back"))
    own = read_table(spark, sf, "benchmark").select("item_id", F.octet_length("text").cast("long").alias("n"))
    return own.join(texts, "item_id").select("item_id", F.md5(F.substring(F.col("back"), F.lit(1), F.col("n").cast("int"))).alias("digest"), "n")


@query(f"with {_Q1}, o as (select x // 2048 as chunk_id, (x % 2048) // 256 as g, x % 2 as p, bit_or(code) as o from c group by 1, 2, 3) select chunk_id, cast(sum(bit_count(o)) as bigint) as kept from o group by 1")
def bitplane_flags(spark, sf):
    out = bitshuffle.encoded(delta.quantized(events(spark, sf), "value", 1, EB1), "x", "code")
    return out.select("chunk_id", F.floor(F.octet_length("words") / 16).alias("kept"))


@query(f"with {_Q1}, o as (select x // 2048 as chunk_id, (x % 2048) // 256 as g, x % 2 as p, bit_or(code) as o from c group by 1, 2, 3), k as (select chunk_id, cast(sum(bit_count(o)) as bigint) as kept from o group by 1) select chunk_id, cast(4 * (sum(kept) over (order by chunk_id) - kept) as bigint) as start from k")
def bitplane_starts(spark, sf):
    return running_sum(bitplane_flags(spark, sf), "chunk_id", {"start": 4 * F.col("kept")}, exclusive=True).select("chunk_id", "start")


@query(f"with {_Q1} select x as idx, cast(code as integer) as code from c")
def bitplane_roundtrip(spark, sf):
    return bitshuffle.decoded(bitshuffle.encoded(delta.quantized(events(spark, sf), "value", 1, EB1), "x", "code"))


# Spline and feedback


def _spline_sql(select: str) -> str:
    cells = f"{_E3}, ec as materialized (select cast(x as bigint) as x, cast(y as bigint) as y, z, value from e3), n as (select count(*) as n from embeddings)"
    return f"with {cells}, {oracles.spline('ec', ('8', '8', 'least(9, (select n from n) - 8 * (c.z // 8))'), EB3, 512, 'sp')} {select}"


@query(_spline_sql("select x, y, z, code, round(restored, 9) + 0.0 as restored from sp"))
def spline3d_roundtrip(spark, sf):
    coded = materialize(spline.predicted(cube(spark, sf), "value", EB3, 512), "spline")
    n, axes = coded.count(), ["x", "y", "z"]
    return dealt(coded.select(*axes, "code"), n, *axes).join(dealt(spline.restored(coded, EB3, 512, n), n, *axes).hint("merge"), axes).withColumn("restored", F.round("restored", 9) + 0.0)


def _fed_back(a: DataFrame, dims: int, eb: float, radius: int) -> DataFrame:
    coded = materialize(feedback.compressed(a, "value", dims, eb, radius).drop("restored"), "feedback")
    return feedback.decompressed(coded, dims, eb, radius).drop("outlier").withColumn("restored", F.round("restored", 9) + 0.0)


@query(f"with recursive {_EV}, e1 as (select cast(x as bigint) as x, value from ev), {oracles.feedback('e1', (256,), EB1, 512, 'fb')} select x, code, round(restored, 9) + 0.0 as restored from fb")
def feedback1d_roundtrip(spark, sf):
    return _fed_back(events(spark, sf), 1, EB1, 512)


@query(f"with recursive {_E2}, ec as (select cast(x as bigint) as x, y, value from e2), {oracles.feedback('ec', (16, 16), EB2, 8, 'fb')} select x, y, code, round(restored, 9) + 0.0 as restored from fb")
def feedback2d_roundtrip(spark, sf):
    return _fed_back(cells(spark, sf), 2, EB2, 8)


@query(f"with recursive {_E3}, ec as (select cast(x as bigint) as x, cast(y as bigint) as y, z, value from e3), {oracles.feedback('ec', (8, 8, 8), EB2, 64, 'fb')} select x, y, z, code, round(restored, 9) + 0.0 as restored from fb")
def feedback3d_roundtrip(spark, sf):
    return _fed_back(cube(spark, sf), 3, EB2, 64)


@query(f"with recursive {_E2}, ec as materialized (select cast(x as bigint) as x, y, value from e2), {oracles.wavefront2d('ec', EB2, 8, 'wf')} select x, y, code, round(restored, 9) + 0.0 as restored from wf")
def feedback2d_whole(spark, sf):
    """Feedback across tiles, compressed and restored."""
    coded = wavefront.compressed(cells(spark, sf), "value", 2, EB2, 8).drop("restored")
    return wavefront.decompressed(coded, 2, EB2, 8).drop("outlier").withColumn("restored", F.round("restored", 9) + 0.0)


@query(f"with {_Q1} select x, d + 512 as code from c")
def lorenzo_no_outlier(spark, sf):
    return delta.residuals(events(spark, sf).select("x", "value"), "value", 1, EB1, 512).select("x", "code")


@query(f"with {_D2} select cast(x as bigint) as x, y, d from d2")
def lorenzo_delta_only(spark, sf):
    return delta.residuals(cells(spark, sf), "value", 2, EB2).select("x", "y", "d")


@query("with r as (select cast(floor((value - 10) / 2) as bigint) as b from events where value between 10 and 50 and value <> 0) select least(b, 19) as bin, count(*) as n, cast(floor(log2(count(*))) as bigint) as log2_n from r group by 1")
def hist_zoomed(spark, sf):
    return stats.equal_width(read_table(spark, sf, "events"), "value", 20, 10.0, 50.0, log2=True, drop_zeros=True)


# Whole pipelines


_PARTS = f"""n as (select count(*) as n, count(*) filter (where base = 'N') as e from b),
d as (select doc_id - coalesce(lag(doc_id) over (order by doc_id), -1) as dn, 1100 + doc_id // 100 - coalesce(lag(1100 + doc_id // 100) over (order by doc_id), 0) as dt, row_number() over (order by doc_id) as i from documents),
m as (select case when dn = lag(dn) over (order by i) then 0 else 1 end as n1, case when dt = lag(dt) over (order by i) then 0 else 1 end as n2 from d),
r as (select 4 + 8 * sum(n1) as a, 4 + 8 * sum(n2) as b, 4 * count(*) as raw from m),
parts as (select part, cast(bytes as bigint) as bytes from (
  select 'segment_0_static' as part, 5 as bytes union all select 'segment_1_numeric', least(a, raw) from r union all select 'segment_2_static', 3
  union all select 'segment_3_static', 4 union all select 'segment_4_numeric', least(b, raw) from r union all select 'segment_5_static', 4
  union all select 'bases', (2 * n + 7) // 8 + 4 * e from n))"""
_QUALITY = f"""px as (select cast(s as integer) as symbol, coalesce(n, 0) + 1 as n from (select unnest(range(256)) as s) left join (select symbol, count(*) as n from ch where pos < (select cast(floor(0.2 * count(*)) as bigint) from ch) group by 1) on s = symbol),
{oracles.huffman('px', 'bk')}, sub as (select (count(*) + 4095) // 4096 as size from ch),
cells as (select pos // size as k, (sum(length) + 31) // 32 as ncell from ch, sub, bk where bk.symbol = ch.symbol group by 1)"""
_REPORT = f"""{_BASES}, {_CHARS[len(_FQ) + 2:]}, {_PARTS}, {_QUALITY},
every as (select * from parts union all select 'quality', cast(33408 + 4 * sum(ncell) as bigint) from cells),
sums as (select cast(sum(bytes) + 4 as bigint) as total from every), org as (select cast(sum(strlen(identifier) + strlen(bases) + strlen(plus) + strlen(quality) + 4) as bigint) as original from fq)"""


@query(f"with recursive {_REPORT} select * from every union all select 'original', original from org union all select 'total', total from sums union all select 'true_total', total + 8 from sums")
def fastq_report(spark, sf):
    return fastq_plan.report(reads(spark, sf))


@query(f"with recursive {_REPORT} select original, total, total + 8 as true_total, round(original / total, 9) as ref_ratio, round(original / (total + 8), 9) as true_ratio from org, sums")
def fastq_ratio(spark, sf):
    out = fastq_plan.measured(reads(spark, sf))
    return out.select("original", "total", "true_total", F.round("ref_ratio", 9).alias("ref_ratio"), F.round("true_ratio", 9).alias("true_ratio"))


@query(f"with {_BASES}, {_PARTS} select * from parts")
def fastq_parts(spark, sf):
    """The parts of the report whose sizes are formulas."""
    r = materialize(reads(spark, sf), "records")
    out = fastq_plan.segment_sizes(r, fastq_plan.plan_segments(r))
    return out.unionByName(bits.sizes(r).select(F.lit("bases").alias("part"), F.col("total_bytes").cast("long").alias("bytes")))


@query(f"with {_FQ} select * from fq")
def fastq_roundtrip(spark, sf):
    path = scratch_path(spark, "fastq")
    fastq_plan.compress(reads(spark, sf), path)
    return fastq_plan.decompress(spark, path)


@query(f"with {_FQ} select * from fq")
def fastq_file_roundtrip(spark, sf):
    """Reads written as FASTQ text and read again in byte ranges."""
    path = scratch_path(spark, "reads")
    fastq.write_fastq(reads(spark, sf), path)
    return fastq.numbered_over_files(fastq.read_fastq(spark, path, range_bytes=1 << 20))


@query(f"with {_FQ} select identifier, bases, plus, quality from fq")
def fastq_stream(spark, sf):
    """Reads written as FASTQ text and taken in as a stream, by all records that are whole."""
    path = scratch_path(spark, "reads")
    fastq.write_fastq(reads(spark, sf), path)
    ingest.write_stream(ingest.read_growing(spark, path), f"{path}-out", f"{path}-state").awaitTermination()
    return spark.read.parquet(f"{path}-out").select("identifier", "bases", "plus", "quality")


@query(f"with {_FQ} select * from fq")
def fastq_one_file_roundtrip(spark, sf):
    path = scratch_path(spark, "fastq")
    fastq_plan.compress(reads(spark, sf), path, one_file=True)
    return fastq_plan.decompress(spark, path)


_SHAPED = f"{_FQ}, sh as (select rec_id, case when rec_id % 3 = 0 then '@M:' || rec_id // 2 || ':' || substr(md5(identifier), 1, 2 + rec_id % 4) || '.' else identifier end as identifier, bases, plus, quality from fq)"


def shaped_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Reads of two instruments, whose names have other delimiters."""
    r, k = reads(spark, sf), F.col("rec_id")
    other = F.concat(F.lit("@M:"), F.floor(k / 2), F.lit(":"), F.substring(F.md5("identifier"), F.lit(1), (2 + k % 4).cast("int")), F.lit("."))
    return r.withColumn("identifier", F.when(k % 3 == 0, other).otherwise(F.col("identifier")))


@query(f"with {_SHAPED} select * from sh")
def fastq_shapes_roundtrip(spark, sf):
    path = scratch_path(spark, "fastq")
    fastq_plan.compress(shaped_reads(spark, sf), path)
    return fastq_plan.decompress(spark, path)


@query(f"with {_SHAPED}, s as (select regexp_replace(identifier, '[^. :/]', '', 'g') as ends, regexp_matches(identifier, '[. :/]$') as closed from sh) select (len(ends) + 1 - cast(closed as integer)) || ' ' || ends as shape, count(*) as n from s group by 1")
def identifier_shapes(spark, sf):
    return shaped_reads(spark, sf).groupBy(segments.shape_of(F.col("identifier")).alias("shape")).agg(F.count("*").alias("n"))


_VARIED = """vr as (
  select row_number() over (order by doc_id) - 1 as rec_id,
    case when doc_id % 17 = 0 then 'odd-' || doc_id else '@' || substr(md5(cast(doc_id as varchar)), 1, 3 + cast(doc_id % 5 as integer)) || '.' || (doc_id + 1) || ':7' end as identifier,
    case when doc_id % 13 = 0 then lower(b) when doc_id % 11 = 0 then replace(b, 'A', 'R') else b end as bases,
    case when doc_id % 19 = 0 then '+again' else '+' end as plus,
    substr(translate(md5(cast(doc_id as varchar)), '0123456789abcdef', 'IIIIFFFFDDBB@<:#'), 1, cast(7 * doc_id % 33 as integer)) as quality
  from (select doc_id, substr(translate(md5(text), '0123456789abcdef', 'ACGTACGTACGTACGN'), 1, cast(7 * doc_id % 33 as integer)) as b from documents))"""


def varied_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Reads of many lengths, zero too, with odd identifiers, a varying string segment, small letters and ambiguity codes."""
    r = reads(spark, sf).select("rec_id", (F.regexp_extract("identifier", r"\.(\d+) ", 1).cast("long") - 1).alias("d"), "bases", "quality")
    md5 = F.md5(F.col("d").cast("string").cast("binary"))
    name = F.concat(F.lit("@"), F.substring(md5, F.lit(1), (3 + F.col("d") % 5).cast("int")), F.lit("."), F.col("d") + 1, F.lit(":7"))
    n = (7 * F.col("d") % 33).cast("int")
    b, q = (F.substring(F.col(c), F.lit(1), n) for c in ("bases", "quality"))
    return r.select(
        "rec_id",
        F.when(F.col("d") % 17 == 0, F.concat(F.lit("odd-"), F.col("d"))).otherwise(name).alias("identifier"),
        F.when(F.col("d") % 13 == 0, F.lower(b)).when(F.col("d") % 11 == 0, F.replace(b, F.lit("A"), F.lit("R"))).otherwise(b).alias("bases"),
        F.when(F.col("d") % 19 == 0, "+again").otherwise("+").alias("plus"),
        q.alias("quality"),
    )


@query(f"with {_VARIED} select * from vr")
def fastq_varied_roundtrip(spark, sf):
    path = scratch_path(spark, "fastq")
    fastq_plan.compress(varied_reads(spark, sf), path)
    return fastq_plan.decompress(spark, path)


@query(f"with {_VARIED}, o as (select *, sum(strlen(bases)) over (order by rec_id) - strlen(bases) as o from vr), b as (select cast(o + i as bigint) as g, substr(bases, i + 1, 1) as base from o, (select unnest(range(32)) as i) where i < strlen(bases)) select g, base from b where base not in ('A', 'C', 'G', 'T')")
def base_exceptions_varied(spark, sf):
    return bits.exceptions(varied_reads(spark, sf))


def _events_array(spark, sf) -> tuple[DataFrame, tuple[int, int, int]]:
    a = events(spark, sf).select("x", F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("z"), "value")
    return a, (read_table(spark, sf, "events").count(), 1, 1)


_REL = f"""{_EV}, bound as (select (max(value) - min(value)) * 0.001 as eb from events),
q as (select x, value, cast(round(value / (2.0 * eb)) as bigint) as q, eb from ev, bound),
d as (select *, q - coalesce(lag(q) over (partition by x // 256 order by x), 0) as d from q),
c as (select *, case when abs(d) < 512 then d + 512 else 0 end as code, abs(d) >= 512 as outside from d),
h as (select cast(code as integer) as symbol, count(*) as n from c group by 1)"""
_REL_BOOK = f"{_REL}, {oracles.huffman('h', 'bk')}"


@query(f"""with recursive {_REL_BOOK}, s as (select cast(sum(n) as bigint) as n, cast(sum(n * length) as bigint) as bits, log2(sum(n)) - sum(n * log2(n)) / sum(n) as entropy from h join bk using (symbol)),
o as (select count(*) filter (where outside) as n_outliers from c)
select n, n_outliers, n_outliers * 5 > n as too_many, round(entropy, 9) as entropy, bits, (bits + 7) // 8 + 12 * n_outliers as bytes, round(4 * n / ((bits + 7) // 8 + 12 * n_outliers), 9) as cr, round(8 * ((bits + 7) // 8 + 12 * n_outliers) / n, 9) as bitrate from s, o""")
def array_report(spark, sf):
    a, shape = _events_array(spark, sf)
    out = array_plan.estimate(a, Options(Mode.REL, 1e-3, shape=shape))
    return out.select("n", "n_outliers", "too_many", F.round("entropy", 9).alias("entropy"), "bits", "bytes", F.round("cr", 9).alias("cr"), F.round("bitrate", 9).alias("bitrate"))


def _array_roundtrip(spark, sf, options: Options, rank: int, one_file: bool = False) -> DataFrame:
    if rank == 1:
        a, shape = _events_array(spark, sf)
    else:
        n = read_table(spark, sf, "embeddings").count()
        a, shape = (cells(spark, sf).withColumn("z", F.lit(0).cast("long")), (64, n, 1)) if rank == 2 else (cube(spark, sf), (8, 8, n))
    options = Options(options.mode, options.eb, options.predictor, options.hist, options.codec, options.radius, shape)
    path = scratch_path(spark, "array")
    array_plan.compress(a, options, path, one_file=one_file)
    q = array_plan.verify(a, array_plan.decompress(spark, path), shape)
    return q.select("n", F.round("max_abs_err", 9).alias("max_abs_err"), F.round("mse", 9).alias("mse"), "max_err_idx")


_ERR = "count(*) as n, round(max(abs(value - r)), 9) as max_abs_err, round(avg((value - r) * (value - r)), 9) as mse, min(case when abs(value - r) = (select max(abs(value - r)) from e) then idx end) as max_err_idx from e"


@query(f"with {_REL}, e as (select value, q * (2.0 * eb) as r, x as idx from c) select {_ERR}")
def array_roundtrip_1d(spark, sf):
    return _array_roundtrip(spark, sf, Options(Mode.REL, 1e-3), 1)


def _event_file(spark: SparkSession, sf: str) -> str:
    """The events' values as one raw file of doubles."""
    path = scratch_path(spark, "events")
    arrays.write_array(events(spark, sf).select(F.col("x").alias("idx"), "value"), path, "<f8", size=1 << 14)
    return path


@query(f"with {_EV} select cast(x as bigint) as idx, value from ev")
def array_file_roundtrip(spark, sf):
    """A raw file from many tasks, read again in parts."""
    return arrays.read_array(spark, _event_file(spark, sf), "<f8", part=1 << 20).select("idx", "value")


@query(f"with {_EV}, p as (select x % 10 as x, x // 10 % 20 as y, x // 200 as z, value from ev) select cast(x as bigint) as x, cast(y as bigint) as y, cast(z as bigint) as z, value from p where y between 3 and 5 and z >= 2 and x <> 4")
def array_file_box(spark, sf):
    """A box of the same file seen as planes of 10 x 20: only rows 3 to 5 of planes from 2 on are read."""
    n = read_table(spark, sf, "events").count()
    cells = arrays.read_array(spark, _event_file(spark, sf), "<f8", part=1 << 20, shape=(10, 20, -(-n // 200)))
    return cells.where("y between 3 and 5 and z >= 2 and x <> 4").select("x", "y", "z", "value")


@query(f"with {_REL}, e as (select value, q * (2.0 * eb) as r, x as idx from c) select {_ERR}")
def array_one_file_roundtrip(spark, sf):
    """The archive of `array_roundtrip_1d` as one file."""
    return _array_roundtrip(spark, sf, Options(Mode.REL, 1e-3), 1, one_file=True)


@query(f"with {_E2}, e as (select value, q * cast({2 * EB2} as double) as r, cast(x + 64 * y as bigint) as idx from e2) select {_ERR}")
def array_roundtrip_2d(spark, sf):
    return _array_roundtrip(spark, sf, Options(Mode.ABS, EB2, Predictor.ZIGZAG, codec=Codec.BITSHUFFLE), 2)


@query(_spline_sql(f", e as (select value, restored as r, cast(x + 8 * y + 64 * z as bigint) as idx from sp) select {_ERR}"))
def array_roundtrip_3d(spark, sf):
    return _array_roundtrip(spark, sf, Options(Mode.ABS, EB3, Predictor.SPLINE), 3)


@query(f"""with recursive {_REL_BOOK}, k as (select x // 16384 as k, sum(length) as nbit, count(*) as n from c join bk on c.code = bk.symbol group by 1),
p as (select 0 as i, 'header' as part, 128 as bytes union all select 1, 'book', 5 * count(*) from bk union all select 2, 'anchors', 0 union all select 3, 'outliers', 12 * count(*) from c where outside
  union all select 4, 'codes', sum(4 * ((nbit + 31) // 32) + 4 * ((n + 255) // 256) + 12) from k)
select part, cast(sum(bytes) over (order by i) - bytes as bigint) as start, cast(bytes as bigint) as bytes, round(bytes / (select sum(bytes) from p), 9) as share from p""")
def archive_segments(spark, sf):
    a, shape = _events_array(spark, sf)
    path = scratch_path(spark, "array")
    array_plan.compress(a, Options(Mode.REL, 1e-3, shape=shape), path)
    return array_plan.size_report(spark, path).withColumn("share", F.round("share", 9))


@query(f"with {_REL} select x as idx, cast(code as integer) as code from c")
def dump_quant(spark, sf):
    a, shape = _events_array(spark, sf)
    path = scratch_path(spark, "array")
    array_plan.compress(a, Options(Mode.REL, 1e-3, shape=shape, dump=("hist", "quant")), path)
    return spark.read.parquet(f"{path}/dump_quant")


@query(f"with {_REL} select cast(s as integer) as symbol, coalesce(n, 0) as n from (select unnest(range(1024)) as s) left join h on s = symbol")
def dump_hist(spark, sf):
    a, shape = _events_array(spark, sf)
    path = scratch_path(spark, "array")
    array_plan.compress(a, Options(Mode.REL, 1e-3, shape=shape, dump=("hist",)), path)
    return spark.read.parquet(f"{path}/dump_hist")
