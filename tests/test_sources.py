"""Files: FASTQ in splits, containers, raw arrays, streams and options."""

import numpy as np
import pytest

from quillstrand.plans import arrays as array_plan
from quillstrand.plans import fastq as fastq_plan
from quillstrand.plans import options
from quillstrand.sources import arrays, fastq, files
from quillstrand.streaming import ingest

READS = [
    ("@A.1 x:7/1", "ACGTNACG", "+", "IIIIFFFF"),
    ("@A.2 y:7/1", "acRY", "+A.2", "FF:#"),
    ("@A.3 x:007/1", "", "+", ""),
    ("odd", "GGGGG", "+", "IIIII"),
]


def write(path, reads, end="\n"):
    path.write_text("\n".join("\n".join(r) for r in reads) + end)


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 37) for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = fastq.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["line"] for r in got] == lines and [r["line_no"] for r in got] == list(range(5000))
    at = 0
    for r in got:
        assert (r["start"], r["length"]) == (at, len(r["line"]))
        at += r["length"] + 1


def test_fastq_files(spark, tmp_path):
    write(tmp_path / "a.fastq", READS)
    got = fastq.read_fastq(spark, str(tmp_path / "a.fastq")).orderBy("rec_id").collect()
    assert [tuple(r)[2:] for r in got] == READS
    write(tmp_path / "b.fastq", READS, end="")
    with pytest.raises(ValueError, match="not a whole FASTQ"):
        fastq.read_fastq(spark, str(tmp_path / "b.fastq"))
    (tmp_path / "c.fastq").write_text("")
    assert fastq.read_fastq(spark, str(tmp_path / "c.fastq")).count() == 0
    (tmp_path / "d.fastq").write_text("@a\r\nAC\r\n+\r\nII\r\n", newline="")
    assert fastq.read_fastq(spark, str(tmp_path / "d.fastq"), strip_cr=True).first()["bases"] == "AC"


def test_rows_stay_when_settings_change_between_planning_and_running(spark, tmp_path):
    write(tmp_path / "a.fastq", [(f"@r{i}", "ACGT" * (i % 23), "+", "@+!I" * (i % 23)) for i in range(20_000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for one, two in (("100000", "150000"), ("150000", "100000")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", one)
            frames = [fastq.read_fastq(spark, str(tmp_path), range_bytes=int(one)), files.registered(spark, fastq.Fastq).read.format("fastq").option("rangeBytes", one).load(str(tmp_path))]
            spark.conf.set("spark.sql.files.maxPartitionBytes", two)
            for df in frames:
                got = df.select("identifier", "bases", "plus", "quality").collect()
                assert sorted(map(tuple, got)) == sorted((f"@r{i}", "ACGT" * (i % 23), "+", "@+!I" * (i % 23)) for i in range(20_000))
            ids = sorted((r["rec_id"], r["identifier"]) for r in frames[0].collect())
            assert ids == [(i, f"@r{i}") for i in range(20_000)]
            assert frames[1]._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("line", ["+", "", "@+\n+"])
def test_marks_that_do_not_tell_records(spark, tmp_path, line):
    """Lines that could begin anywhere in a record, or nowhere."""
    lines = ([f"{line}"] * 8 + [f"x{i}" for i in range(4)]) * 60 if line != "" else [f"no mark {i}" for i in range(800)]
    lines = "\n".join(lines).split("\n")
    lines = lines[: len(lines) // 4 * 4]
    (tmp_path / "a.fastq").write_text("\n".join(lines) + "\n")
    want = [tuple(lines[i : i + 4]) for i in range(0, len(lines), 4)]
    for size in (90, 333, 1 << 20):
        got = fastq.read_fastq(spark, str(tmp_path / "a.fastq"), range_bytes=size).orderBy("rec_id").collect()
        assert [tuple(r)[2:] for r in got] == want


def test_packed_files_bad_bytes_and_missing_lines(spark, tmp_path):
    import gzip

    (tmp_path / "p").mkdir()
    with gzip.open(tmp_path / "p" / "a.fastq.gz", "wt") as f:
        f.write("\n".join("\n".join(r) for r in READS) + "\n")
    assert [tuple(r)[2:] for r in fastq.read_fastq(spark, str(tmp_path / "p"), range_bytes=9).orderBy("rec_id").collect()] == READS
    (tmp_path / "b.fastq").write_bytes(b"@\xff\nAC\n+\nII\n@2\nA")
    with pytest.raises(ValueError, match="not a whole FASTQ"):
        fastq.read_fastq(spark, str(tmp_path / "b.fastq"))
    with pytest.raises(Exception, match="not a whole FASTQ"):
        files.registered(spark, fastq.Fastq).read.format("fastq").load(str(tmp_path / "b.fastq")).count()
    got = fastq.read_fastq(spark, str(tmp_path / "b.fastq"), check=False).orderBy("rec_id").collect()
    assert [tuple(r)[2:] for r in got] == [("@\ufffd", "AC", "+", "II"), ("@2", "A", None, None)]


def test_files_that_only_spark_opens(spark, tmp_path, monkeypatch):
    reads = [(f"@r{i}", "ACGT" * (i % 23), "+", "IIII" * (i % 23)) for i in range(2000)]
    write(tmp_path / "a.fastq", reads)
    monkeypatch.setattr(files, "openable", lambda path: False)
    got = fastq.read_fastq(spark, str(tmp_path)).orderBy("rec_id").collect()
    assert [tuple(r)[2:] for r in got] == reads


def test_one_numbering_over_files(spark, tmp_path):
    for k, name in enumerate("cab"):
        write(tmp_path / f"{name}.fastq", [(f"@{name}{i}", "A", "+", "I") for i in range(k + 1)])
    got = fastq.numbered_over_files(fastq.read_fastq(spark, str(tmp_path))).orderBy("rec_id").collect()
    assert [(r["rec_id"], r["identifier"]) for r in got] == [(0, "@a0"), (1, "@a1"), (2, "@b0"), (3, "@b1"), (4, "@b2"), (5, "@c0")]


@pytest.mark.parametrize("most", [100_000, 0])
def test_records_over_the_borders_of_splits(spark, tmp_path, most):
    reads = [(f"@r{i}", "ACGT" * (i % 23), "+", "IIII" * (i % 23)) for i in range(3000)]
    for name in "ab":
        write(tmp_path / f"{name}.fastq", reads)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9973")
    try:
        got = fastq.read_fastq(spark, str(tmp_path), most=most, range_bytes=9973).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name in "ab":
        assert [tuple(r)[2:] for r in sorted((r for r in got if r["file"].endswith(f"{name}.fastq")), key=lambda r: r["rec_id"])] == reads


def test_large_files_are_read_in_parts(spark, tmp_path):
    v = np.arange(5000, dtype="<f4")
    (tmp_path / "a.f32").write_bytes(v.tobytes())
    df = arrays.read_array(spark, str(tmp_path / "a.f32"), whole=1000, part=4096)
    assert [(r["idx"], r["value"]) for r in df.orderBy("idx").collect()] == list(enumerate(v.tolist()))
    arrays.write_array(df, "file://" + str(tmp_path / "b.f32"), size=700)
    assert (tmp_path / "b.f32").read_bytes() == v.tobytes()
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.fastq", READS)
    ingest.write_stream(ingest.read_stream(spark, str(tmp_path / "in"), whole=10), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [tuple(r)[2:] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("rec_id").collect()] == READS


def test_command_line(spark, tmp_path, capsys):
    from quillstrand.__main__ import main

    write(tmp_path / "a.fastq", READS)
    assert main(["fastq", "compress", str(tmp_path / "a.fastq"), str(tmp_path / "c")]) == 0
    assert main(["fastq", "decompress", str(tmp_path / "c"), str(tmp_path / "t")]) == 0
    assert fastq.read_fastq(spark, str(tmp_path / "t"), check=False).count() == len(READS)
    v = np.sin(np.arange(600) / 30).astype("<f4")
    (tmp_path / "v.f32").write_bytes(v.tobytes())
    assert main(["array", "compress", str(tmp_path / "v.f32"), str(tmp_path / "z"), "-o", "mode=abs,eb=1e-3,dump=all", "-l", "600"]) == 0
    assert main(["array", "decompress", str(tmp_path / "z"), "file://" + str(tmp_path / "w.f32"), "--compare", str(tmp_path / "v.f32")]) == 0
    assert np.abs(np.fromfile(tmp_path / "w.f32", "<f4") - v).max() <= 1.01e-3
    assert spark.read.parquet(str(tmp_path / "z" / "dump_quant")).count() == 600 and spark.read.parquet(str(tmp_path / "z" / "dump_hist")).count() == 1024
    assert main(["array", "report", str(tmp_path / "v.f32"), "-o", "mode=abs,eb=1e-3", "-l", "600"]) == 0
    assert main(["fastq", "compress", str(tmp_path / "a.fastq"), str(tmp_path / "c.one"), "--one-file"]) == 0
    assert main(["fastq", "decompress", str(tmp_path / "c.one"), str(tmp_path / "t1")]) == 0
    assert fastq.read_fastq(spark, str(tmp_path / "t1"), check=False).count() == len(READS) and (tmp_path / "c.one").is_file()
    assert main(["array", "compress", str(tmp_path / "v.f32"), str(tmp_path / "z.one"), "--one-file", "-o", "mode=abs,eb=1e-3", "-l", "600"]) == 0
    assert main(["array", "decompress", str(tmp_path / "z.one"), "file://" + str(tmp_path / "w1.f32")]) == 0
    assert (tmp_path / "w1.f32").read_bytes() == (tmp_path / "w.f32").read_bytes()
    out = capsys.readouterr().out
    assert "true_ratio" in out and "gib_per_s" in out and "bitrate" in out


def test_command_line_skips_steps_and_takes_books(spark, tmp_path, capsys):
    from quillstrand.__main__ import main, parser
    from quillstrand.operators import huffman

    v = np.sin(np.arange(600) / 30).astype("<f4")
    (tmp_path / "v.f32").write_bytes(v.tobytes())
    raw, common = str(tmp_path / "v.f32"), ["-o", "mode=abs,eb=1e-3,radius=64", "-l", "600"]
    assert main(["array", "compress", raw, str(tmp_path / "plain"), *common, "--skip", "huffman"]) == 0
    assert spark.read.parquet(str(tmp_path / "plain" / "codes")).count() == 600 and not (tmp_path / "plain" / "book").exists()
    seen = array_plan.size_report(spark, str(tmp_path / "plain"))
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, array_plan.size_report(spark, str(tmp_path / "plain"), again=True).collect()))
    # a book of all codes, as made from counts that are smoothed
    book = huffman.canonical({s: 8 if s % 4 else 6 for s in range(128)})
    huffman.book_frame(spark, book).write.parquet(str(tmp_path / "other" / "book"))
    assert main(["array", "compress", raw, str(tmp_path / "z"), *common, "--import-book", str(tmp_path / "other")]) == 0
    assert array_plan.book_of(spark, str(tmp_path / "z")).codes == book.codes
    capsys.readouterr()
    for made in ("plain", "z"):
        assert main(["array", "decompress", str(tmp_path / made), "-S", "write", "--compare", raw]) == 0
        assert "max_abs_err" in capsys.readouterr().out
        assert abs(array_plan.verify(arrays.read_array(spark, raw, shape=(600, 1, 1)), array_plan.decompress(spark, str(tmp_path / made)), (600, 1, 1)).first()["max_abs_err"]) <= 1.01e-3
    assert parser().parse_args(["array", "report", raw, "--demo", "cesm"]).demo == "cesm"
    for bad in (["--skip", "all"], ["--skip", "write"], ["--skip", "huffman", "--import-book", "x"], ["--demo", "nothing"]):
        with pytest.raises(SystemExit):
            main(["array", "compress", raw, str(tmp_path / "y"), *common[:2], *bad])
    spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "symbol int, length int").write.parquet(str(tmp_path / "broken" / "book"))
    with pytest.raises(ValueError, match="no codes have"):
        array_plan.book_of(spark, str(tmp_path / "broken"))
    with pytest.raises(ValueError, match="no codes for"):
        main(["array", "compress", raw, str(tmp_path / "y"), "-o", "mode=abs,eb=1e-3", "-l", "600", "--import-book", str(tmp_path / "other")])


def test_container_restores_odd_reads(spark, tmp_path):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(READS)], "rec_id long, identifier string, bases string, plus string, quality string")
    fastq_plan.compress(df, str(tmp_path / "c"))
    assert [tuple(r)[1:] for r in fastq_plan.decompress(spark, str(tmp_path / "c")).orderBy("rec_id").collect()] == READS
    fastq.write_fastq(df, str(tmp_path / "t"))
    assert fastq.read_fastq(spark, str(tmp_path / "t"), check=False).count() == 4


def test_identifiers_of_several_shapes(spark, tmp_path):
    """Two instruments' names in one file, and one name of 500 pieces."""
    schema = "rec_id long, identifier string, bases string, plus string, quality string"
    name = lambda i: f"@M0.{i} run:7/1" if i % 3 else f"@SRR:{i // 2}:lane{i % 7}."
    names = [name(i) for i in range(3000)]
    df = spark.createDataFrame([(i, n, "ACGT", "+", "IIII") for i, n in enumerate(names)], schema)
    plan = fastq_plan.plan_segments(df)
    assert len(plan.shapes) == 2 and [s.kind for s in plan.of(0)] == ["static", "numeric", "static", "static", "static"] and [s.kind for s in plan.of(1)] == ["static", "numeric", "string"]
    fastq_plan.compress(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c" / "odd_identifiers")).count() == 0
    assert {r["rec_id"]: r["identifier"] for r in fastq_plan.decompress(spark, str(tmp_path / "c")).collect()} == dict(enumerate(names))
    names[77] = ":".join(map(str, range(500)))
    names[78], names[79] = None, ""
    odd = spark.createDataFrame([(i, n, "ACGT", "+", "IIII") for i, n in enumerate(names)], schema)
    assert fastq_plan.plan_segments(odd).shapes == plan.shapes
    fastq_plan.compress(odd, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o" / "odd_identifiers")).count() == 3
    assert {r["rec_id"]: r["identifier"] for r in fastq_plan.decompress(spark, str(tmp_path / "o")).collect()} == dict(enumerate(names))
    got = {r["part"]: r["bytes"] for r in fastq_plan.report(odd).collect()}
    assert got["shape_1_segment_0_static"] == 4 and got["true_total"] > got["total"] + 1800
    every = spark.createDataFrame([(i, "x." * i, "A", "+", "I") for i in range(20)], schema)
    assert len(fastq_plan.plan_segments(every, mode="exact").shapes) == 16


def test_report_totals(spark):
    df = spark.createDataFrame([(i, f"@A.{i + 1}", "ACGT", "+", "IIII") for i in range(50)], "rec_id long, identifier string, bases string, plus string, quality string")
    got = {r["part"]: r["bytes"] for r in fastq_plan.report(df).collect()}
    assert got["segment_0_static"] == 2 and got["segment_1_numeric"] == 12 and got["bases"] == 50
    assert got["total"] == sum(v for k, v in got.items() if k.startswith(("segment", "bases", "quality"))) + 4
    assert got["true_total"] == got["total"] + 8


def test_raw_arrays(spark, tmp_path):
    v = np.arange(1000, dtype="<f4")
    (tmp_path / "a.f32").write_bytes(v.tobytes())
    df = arrays.read_array(spark, str(tmp_path / "a.f32"))
    assert [r["value"] for r in df.orderBy("idx").collect()] == v.tolist()
    back = arrays.chunks(df, size=300).orderBy("chunk").collect()
    assert b"".join(bytes(r["data"]) for r in back) == v.tobytes()
    place = arrays.with_place(df, (10, 20, 5)).where("idx = 234").first()
    assert (place["x"], place["y"], place["z"]) == (4, 3, 1)
    assert arrays.dims(arrays.SHAPES["cesm"]) == 2 and arrays.dims(arrays.SHAPES["rtm"]) == 3


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.fastq", READS)
    for k in range(2):  # a second run finds what is new
        ingest.write_stream(ingest.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 4 * (k + 1)
        write(tmp_path / "in" / "b.fastq", READS)


def test_stream_of_files_that_only_spark_opens(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    reads = [(f"@r{i}", "ACGT" * 50, "+", "IIII" * 50) for i in range(30_000)]  # more than one piece
    write(tmp_path / "in" / "a.fastq", reads)
    monkeypatch.setattr(ingest, "openable", lambda path: False)
    ingest.write_stream(ingest.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("rec_id").collect()
    assert [tuple(r)[2:] for r in got] == reads and [r["rec_id"] for r in got] == list(range(30_000))


@pytest.mark.parametrize("range_bytes", [1 << 20, 5000])
def test_a_file_that_grows(spark, tmp_path, range_bytes):
    """Three steps, cut inside records, with a new start from the checkpoint each time."""
    (tmp_path / "in").mkdir()
    reads = [(f"@r{i}", "ACGT" * (i % 23), "+", "@+!I" * (i % 23)) for i in range(3000)]
    text = ("\n".join("\n".join(r) for r in reads) + "\n").encode()
    at, counts = 0, []
    for to in (70_001, 150_123, len(text)):
        with open(tmp_path / "in" / "a.fastq", "ab") as f:
            f.write(text[at:to])
        at = to
        if counts:
            write(tmp_path / "in" / f"b{len(counts)}.fastq", READS[:3])
        ingest.write_stream(ingest.read_growing(spark, str(tmp_path / "in"), range_bytes), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        counts.append(spark.read.parquet(str(tmp_path / "out")).count())
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("file", "start").collect()
    whole = text[:70_001].count(b"\n") // 4
    assert counts[0] == whole and [tuple(r)[2:] for r in got if r["file"].endswith("a.fastq")] == reads
    assert [tuple(r)[2:] for r in got if not r["file"].endswith("a.fastq")] == READS[:3] * 2
    one = files.registered(spark, fastq.Fastq).read.format("fastq").load(str(tmp_path / "in")).select("file", "start", *fastq.ROLES)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, got))


def test_options():
    o = options.parse("mode=abs,eb=1e-3,predictor=spline,codec=bitshuffle,shape=3600x1800,radius=256")
    assert (o.mode, o.eb, o.predictor, o.codec, o.shape, o.bins) == (options.Mode.ABS, 1e-3, options.Predictor.SPLINE, options.Codec.BITSHUFFLE, (3600, 1800, 1), 512)
    assert options.shape("1,2,3", slowest_first=True) == (3, 2, 1) and options.switch("on") and not options.switch("off")
    for bad in ("eb=1x", "what=1", "mode", "shape=0x2"):
        with pytest.raises(ValueError):
            options.parse(bad)


def test_own_codebook(spark, tmp_path):
    from quillstrand.operators import huffman

    df = spark.createDataFrame([(i, 0, 0, float(i % 5)) for i in range(600)], "x long, y long, z long, value double")
    book = huffman.canonical({s: 10 for s in range(1024)})
    o = options.Options(options.Mode.ABS, 0.1, shape=(600, 1, 1), codebook=book)
    took = array_plan.compress(df, o, str(tmp_path / "a"))
    assert set(took) >= {"predict", "encode"}
    seen = array_plan.size_report(spark, str(tmp_path / "a"))
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, array_plan.size_report(spark, str(tmp_path / "a"), again=True).collect()))
    q = array_plan.verify(df, array_plan.decompress(spark, str(tmp_path / "a")), (600, 1, 1)).first()
    assert q["n"] == 600 and q["max_abs_err"] <= 0.1 * 1.001


def test_environment(spark):
    from quillstrand.session import environment

    assert {r["key"]: r["value"] for r in environment(spark).collect()}["spark"] == spark.version
