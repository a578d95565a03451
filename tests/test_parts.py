"""One file from many tasks, raw arrays by byte ranges, and archives."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstrand.sources import arrays, files, parts


def cells(spark, n, split=7):
    return spark.range(n).repartition(split).select(F.col("id").alias("idx"), (F.col("id") * 3 - 50).cast("double").alias("value"))


@pytest.mark.parametrize("n,size", [(10_000, 300), (1, 300), (0, 300), (600, 300)])
def test_array_from_many_tasks(spark, tmp_path, n, size):
    path = f"file://{tmp_path}/a.f32"
    arrays.write_array(cells(spark, n), path, size=size)
    assert np.fromfile(tmp_path / "a.f32", "<f4").tolist() == [i * 3.0 - 50 for i in range(n)]
    assert os.listdir(tmp_path) == ["a.f32"]


def test_failed_tasks_and_gaps_leave_no_file(spark, tmp_path):
    path = f"file://{tmp_path}/a.f32"
    with pytest.raises(Exception, match="broken on purpose"):
        arrays.write_array(cells(spark, 5000).withColumn("value", F.when(F.col("idx") == 4321, F.raise_error(F.lit("broken on purpose")).cast("double")).otherwise(F.col("value"))), path, size=300)
    with pytest.raises(Exception, match="bytes were written"):
        parts.write_at(spark.createDataFrame([(0, bytearray(b"abc"))], "at long, data binary"), path, 4)
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="positional writes"):
        parts.write_at(spark.createDataFrame([(0, bytearray(b"abc"))], "at long, data binary"), "hdfs://x/y", 3)


def reader(path, shape, part=4096, *pushed):
    out = arrays.RawArrayReader({"path": str(path), "dtype": "<f4", "shape": shape, "partbytes": str(part)})
    assert list(out.pushFilters(list(pushed))) == []
    return out


def test_bounds_become_byte_ranges(spark, tmp_path):
    x, y, z = 20, 30, 40
    v = np.arange(x * y * z, dtype="<f4")
    v.tofile(tmp_path / "a.f32")
    df = arrays.read_array(spark, str(tmp_path / "a.f32"), shape=(x, y, z), part=4096)
    for where in ("z = 3", "z >= 38 and y < 2", "x = 5", "idx between 700 and 1300 and y > 4", "x in (1, 7) and z = 2", "z > 39", "y = 29 and x = 19 and z = 39", "idx < 0", "x + y = 9", "value > 23990.0"):
        got = sorted((r["idx"], r["value"]) for r in df.where(where).collect())
        every = spark.createDataFrame([(i, i % x, i // x % y, i // (x * y), float(i)) for i in range(len(v))], "idx long, x long, y long, z long, value double")
        assert got == sorted((r["idx"], r["value"]) for r in every.where(where).collect()), where
    plan = df.where("z = 3")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan  # taken whole by the source


def test_bytes_read(tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    x, y, z = 20, 30, 40
    np.arange(x * y * z, dtype="<f4").tofile(tmp_path / "a.f32")
    whole = 4 * x * y * z
    read = []
    real = arrays.fs.FileSystem.from_uri

    class Spy:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    class System:
        def __init__(self, system):
            self.system = system

        def open_input_file(self, where):
            return Spy(self.system.open_input_file(where))

    def rows(r):
        read.clear()
        with monkeypatch.context() as m:
            m.setattr(arrays.fs, "FileSystem", type("FS", (), {"from_uri": staticmethod(lambda u: (lambda s, w: (System(s), w))(*real(u)))}))
            n = sum(b.num_rows for p in r.partitions() for b in r.read(p))
        assert sum(read) == r.planned_bytes()
        return n, sum(read)

    path = f"file://{tmp_path}/a.f32"
    assert rows(reader(path, "20x30x40")) == (x * y * z, whole)
    assert rows(reader(path, "20x30x40", 4096, EqualTo(("z",), 3))) == (x * y, whole // z)
    assert rows(reader(path, "20x30x40", 4096, EqualTo(("y",), 3), LessThan(("z",), 2))) == (2 * x, 2 * 4 * x)
    assert rows(reader(path, "20x30x40", 4096, GreaterThanOrEqual(("idx",), 23990))) == (10, 40)
    assert rows(reader(path, "20x30x40", 4096, EqualTo(("z",), 40))) == (0, 0)
    long = np.arange(3 * 40_000, dtype="<f4")
    long.tofile(tmp_path / "b.f32")
    assert rows(reader(f"file://{tmp_path}/b.f32", "40000x3x1", 1 << 26, EqualTo(("x",), 5))) == (3, 12)


def test_whole_numbers_only(spark, tmp_path):
    (tmp_path / "a.f32").write_bytes(b"12345")
    with pytest.raises(Exception, match="no whole number"):
        arrays.read_array(spark, str(tmp_path / "a.f32")).count()


def test_archive_of_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parts, "ENTRIES", 16)
    rows = [(s, k, bytearray(f"{s}{k}".encode() * (k % 5))) for s, n in (("b", 40), ("a", 3), ("none", 0)) for k in range(n)]
    path = f"file://{tmp_path}/x.qsa"
    df = spark.createDataFrame(rows, "segment string, part long, data binary").repartition(5)
    parts.write_archive(df, path, ["b", "none", "a"], {"note": "hello"})
    head = parts.header_of(path)
    assert [s["name"] for s in head["segments"]] == ["b", "none", "a", "index"] and head["note"] == "hello"
    raw = (tmp_path / "x.qsa").read_bytes()
    for s in head["segments"][:-1]:
        assert raw[s["at"] : s["at"] + s["bytes"]] == b"".join(bytes(d) for n, _, d in rows if n == s["name"])
    assert sorted((r["segment"], r["part"], bytes(r["data"])) for r in parts.read_archive(spark, path).collect()) == sorted((s, k, bytes(d)) for s, k, d in rows)
    assert parts.read_archive(spark, path, "a").count() == 3 and parts.read_archive(spark, path, "none").count() == 0
    assert head["segments"][-1]["at"] + head["segments"][-1]["bytes"] == len(raw) and json.loads(raw[12 : 12 + int.from_bytes(raw[4:12], "little")]) == head


def test_tables_in_one_file(spark, tmp_path):
    path = f"file://{tmp_path}/t.qsa"
    one = spark.range(5000).select("id", F.concat(F.lit("é"), F.col("id")).alias("s"), F.array("id").alias("l"))
    parts.write_tables({"one": one, "two": one.limit(0)}, path)
    assert sorted(map(tuple, parts.read_table_of(spark, path, "one").collect())) == sorted(map(tuple, one.collect()))
    assert parts.read_table_of(spark, path, "two").schema == one.schema and parts.read_table_of(spark, path, "two").count() == 0
    assert parts.is_archive(path) and not parts.is_archive(f"file://{tmp_path}") and files.openable(path)
