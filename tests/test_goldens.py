"""Small inputs with known results."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstrand.functions import columns as C
from quillstrand.operators import bits, flat, bitshuffle, delta, feedback, huffman, lz, rle, segments, sparse, spline, stats


def ints(spark, values, col="v"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"k long, {col} long")


def test_identifier_pieces(spark):
    df = spark.createDataFrame([(0, "@SRR1295433.1 HWI:7:1101/1"), (1, "@A..1:"), (2, ""), (3, None)], "k long, id string")
    rows = [tuple(r) for r in segments.exploded(df, "id", ["k"]).orderBy("k", "pos").collect()]
    assert [r[2:] for r in rows if r[0] == 0] == [("@SRR1295433", ".", False), ("1", " ", True), ("HWI", ":", False), ("7", ":", True), ("1101", "/", True), ("1", "", True)]
    assert [r[2:] for r in rows if r[0] == 1] == [("@A", ".", False), ("", ".", False), ("1", ":", True)]
    assert not [r for r in rows if r[0] in (2, 3)]


@pytest.mark.parametrize(("n", "want"), [(1, [0]), (2, [0, 1]), (11, [0, 1, 2, 3, 4, 5, 6, 7, 8, 10]), (100, list(range(0, 100, 11)))])
def test_sample_ids(spark, n, want):
    assert [r[0] for r in segments.sample_ids(spark.range(n).withColumnRenamed("id", "rec_id"), "rec_id").orderBy("rec_id").collect()] == want


def test_constant_by_sample_loses_what_exact_keeps(spark):
    df = spark.createDataFrame([(i, "@A.y" if i == 5 else "@A.x") for i in range(1000)], "rec_id long, identifier string")
    exact = {r["pos"]: r["is_static"] for r in segments.infer(df, "identifier", "rec_id").collect()}
    first = {r["pos"]: r["is_static"] for r in segments.infer(df, "identifier", "rec_id", mode="first").collect()}
    assert exact == {0: True, 1: False} and first == {0: True, 1: True}


def test_wrapped_int(spark):
    df = spark.createDataFrame([("007",), ("2147483648",), ("99999999999",), ("12a",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(C.wrapped_int(F.col("s"))).collect()] == [7, -2147483648, 1215752191, -1, -1, -1]


def test_numbers_that_do_not_round_trip_are_strings(spark):
    df = spark.createDataFrame([(0, "@A.007"), (1, "@A.8")], "rec_id long, identifier string")
    assert {r["pos"]: r["is_numeric"] for r in segments.infer(df, "identifier", "rec_id").collect()} == {0: False, 1: False}


def test_two_bit_packing(spark):
    df = spark.createDataFrame([(0, "ACGTN"), (1, "GGN"), (2, "acR"), (3, "")], "rec_id long, bases string")
    assert bytes(r["byte"] for r in bits.packed(df).orderBy("byte_id").collect()).hex() == "e42800"
    assert [(r["g"], r["base"]) for r in bits.exceptions(df).orderBy("g").collect()] == [(4, "N"), (7, "N"), (8, "a"), (9, "c"), (10, "R")]
    places = flat.with_offsets(df).select("rec_id", "length", "offset")
    back = bits.reassembled(bits.blocks(df), places)
    assert {r["rec_id"]: r["bases"] for r in back.collect()} == {0: "ACGTN", 1: "GGN", 2: "acR", 3: ""}


def test_differences_and_runs(spark):
    df = ints(spark, [100, 101, 102, 103, 103, 110])
    d = delta.first_difference(df, "k", "v")
    assert [r["delta"] for r in d.orderBy("k").collect()] == [100, 1, 1, 1, 0, 7]
    assert [(r["delta"], r["length"]) for r in rle.numeric_encode(df, "k", "v").orderBy("run").collect()] == [(100, 1), (1, 3), (0, 1), (7, 1)]
    size = rle.numeric_codec(df, "k", "v").first()
    assert (size["coded_bytes"], size["raw_bytes"], size["use_runs"], size["bytes"]) == (36, 24, False, 24)
    assert [r["v"] for r in rle.numeric_decode(rle.numeric_encode(df, "k", "v"), "k", "v").orderBy("k").collect()] == [100, 101, 102, 103, 103, 110]


def test_runs_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(0, None), (1, None), (2, "a"), (3, None)], "k long, v string")
    assert [(r["value"] if "value" in r else r["v"], r["length"]) for r in rle.encode(df, "k", "v").orderBy("run").collect()] == [(None, 2), ("a", 1), (None, 1)]
    assert rle.encode(df.limit(0), "k", "v").count() == 0


def test_packed_runs():
    blob = rle.pack([1, 2], [3, 70000])
    assert rle.unpack(blob) == ([1, 2], [3, 70000]) and rle.unpack(blob[:-1]) == ([], []) and rle.unpack(b"") == ([], [])


def test_packed_runs_as_rows(spark):
    df = spark.createDataFrame([("a", bytearray(rle.pack([9], [2]))), ("b", None)], "k string, x binary")
    assert [tuple(r) for r in rle.unpacked(df, "x", ["k"]).collect()] == [("a", 0, 9, 2)]


@pytest.mark.parametrize(
    ("data", "tokens", "flags", "size"),
    [(bytes(4096), 25, 4, 48), ((b"ABC" * 1366)[:4096], 25, 4, 47), (bytes(range(256)) * 16, 4096, 512, 4096)],
)
def test_window_matching(data, tokens, flags, size):
    f, t = lz.compress(data)
    assert (len(f), len(t)) == (flags, size)
    assert lz.expand(f, t) == data


def test_window_matching_does_not_go_back():
    length, away = lz.matches(np.frombuffer(b"aabaaab", np.uint8))
    assert (length[3], away[3]) == (2, 3) and length[5] < 2
    length, away = lz.matches(np.frombuffer(b"abcabcabcd", np.uint8))
    assert (length[3], away[3], length[6], away[6]) == (3, 3, 3, 6)


@given(st.binary(max_size=300).map(lambda b: b * 5))
@settings(max_examples=30, deadline=None)
def test_window_matching_round_trip(data):
    assert lz.expand(*lz.compress(data[:4096]))[: len(data[:4096])] == data[:4096]


def test_huffman_golden():
    freq = {0: 5, 1: 9, 2: 12, 3: 13, 4: 16, 5: 45}
    lengths = huffman.code_lengths(freq)
    assert lengths == {0: 4, 1: 4, 2: 3, 3: 3, 4: 3, 5: 1}
    book = huffman.canonical(lengths)
    assert [format(c, f"0{n}b") for _, n, c in book.rows()] == ["0000", "0001", "001", "010", "011", "1"]
    assert sum(freq[s] * n for s, n in lengths.items()) == 224


def test_huffman_limits():
    fib = [1, 1]
    while len(fib) < 32:
        fib.append(fib[-1] + fib[-2])
    lengths = huffman.code_lengths(dict(enumerate(fib)))
    with pytest.raises(ValueError, match="does not fit"):
        huffman.canonical(lengths)
    assert huffman.canonical(lengths, word=64).longest == 31
    assert huffman.code_lengths({7: 3}) == {7: 1} and huffman.code_lengths({}) == {}


@given(st.lists(st.integers(0, 40), min_size=1, max_size=3000))
@settings(max_examples=40, deadline=None)
def test_huffman_round_trip(symbols):
    counts = {s: symbols.count(s) for s in set(symbols)}
    book = huffman.canonical(huffman.code_lengths(counts))
    nbit, cells, marks = huffman.encode_chunk(np.array(symbols), book)
    assert nbit == sum(counts[s] * n for s, (_, n) in book.codes.items()) and len(cells) % 4 == 0
    assert huffman.decode_chunk(cells, len(symbols), marks, book).tolist() == symbols


def test_long_codes_round_trip():
    fib = [1, 1]
    while len(fib) < 25:
        fib.append(fib[-1] + fib[-2])
    book = huffman.canonical(huffman.code_lengths(dict(enumerate(fib))))
    symbols = list(range(25)) * 40 + [0] * 50
    _, cells, marks = huffman.encode_chunk(np.array(symbols), book)
    assert book.longest > 12 and huffman.decode_chunk(cells, len(symbols), marks, book).tolist() == symbols


@given(st.lists(st.integers(0, 1023), max_size=2048))
@settings(max_examples=25, deadline=None)
def test_bit_planes_round_trip(codes):
    flags, words = bitshuffle.encode(np.array(codes, np.uint16))
    assert len(flags) == 32 and bitshuffle.decode(flags, words)[: len(codes)].tolist() == codes


def test_quantized_golden(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 0.25, -0.25, 3, 700, 700.4, -2.5])], "x long, value double")
    out = delta.quantized(df, "value", 1, 0.5, radius=4).orderBy("x").collect()
    assert [r["q"] for r in out] == [0, 0, 0, 3, 700, 700, -3]
    assert [r["code"] for r in out] == [4, 4, 4, 7, 0, 4, 0]
    assert {r["x"]: r["outlier"] for r in out if r["outlier"] is not None} == {4: 701, 6: -699}
    back = delta.restored(delta.quantized(df, "value", 1, 0.5, radius=4), 1, 0.5, radius=4).orderBy("x").collect()
    assert [r["restored"] for r in back] == [0, 0, 0, 3, 700, 700, -3]


def test_tiles_start_anew(spark):
    df = spark.createDataFrame([(i, float(10 + i)) for i in range(6)], "x long, value double")
    assert [r["code"] for r in delta.quantized(df, "value", 1, 0.5, radius=100, tile=(4,)).orderBy("x").collect()] == [110, 101, 101, 101, 114, 101]
    grid = spark.createDataFrame([(x, y, float(v)) for y, row in enumerate([[1, 2, 4], [2, 4, 8], [3, 6, 12]]) for x, v in enumerate(row)], "x long, y long, value double")
    for tile, want in ((None, [1, 1, 2, 1, 1, 2, 1, 1, 2]), ((2, 2), [1, 1, 4, 1, 1, 4, 3, 3, 12])):
        assert [r["d"] for r in delta.quantized(grid, "value", 2, 0.5, radius=100, tile=tile).orderBy("y", "x").collect()] == want


def test_zigzag(spark):
    df = ints(spark, [0, -1, 1, -2, 2, -512, 511])
    assert [r[0] for r in df.orderBy("k").select(C.zigzag(F.col("v"))).collect()] == [0, 1, 2, 3, 4, 1023, 1022]
    assert [r[0] for r in df.orderBy("k").select(C.unzigzag(C.zigzag(F.col("v")))).collect()] == [0, -1, 1, -2, 2, -512, 511]


def test_sparse(spark):
    df = ints(spark, [1, 0, -9, 4])
    some, dense = sparse.gather(df, "k", "v", C.in_ball(F.col("v"), 4))
    assert {tuple(r) for r in some.collect()} == {(2, -9), (3, 4)}
    assert [r["v"] for r in sparse.scatter(dense, some, "k", "v").orderBy("k").collect()] == [1, 0, -9, 4]


@pytest.mark.parametrize("shape", [(33, 9, 10), (5, 3, 2), (64, 16, 8), (1, 1, 1)])
def test_spline_bound(spark, shape):
    rng = np.random.default_rng(3)
    x, y, z = shape
    v = np.cumsum(rng.normal(size=(z, y, x)), axis=2)
    v[0, 0, 0] = 5e5  # an outlier among its neighbours
    df = spark.createDataFrame([(i, j, k, float(v[k, j, i])) for k in range(z) for j in range(y) for i in range(x)], "x long, y long, z long, value double")
    back = spline.restored(spline.predicted(df, "value", 0.05, 64), 0.05, 64)
    both = df.join(back, ["x", "y", "z"])
    assert both.count() == x * y * z
    assert both.agg(F.max(F.abs(F.col("value") - F.col("restored")))).first()[0] <= 0.05 * 1.001


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_feedback_bound(dims):
    rng = np.random.default_rng(4)
    v = np.cumsum(rng.normal(size=(5, *(12,) * dims)), axis=1)
    v[(2, *(3,) * dims)] = 1e6
    codes, out = feedback.run_blocks(v, 0.1, 32)
    assert np.abs(out - v).max() <= 0.1 * 1.001 and (codes == 0).any()
    again = feedback.run_blocks(np.where(codes == 0, v, 0), 0.1, 32, codes)[1]
    assert np.array_equal(again, out)


def test_statistics(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 2.5), (2, 3.0, 2.5)], "i long, a double, b double")
    q = stats.assess(df, "a", "b", "i").first()
    assert (q["max_abs_err"], q["max_err_idx"], round(q["mse"], 6)) == (0.5, 1, round(0.5 / 3, 6))
    assert tuple(stats.max_error(df, "a", "b", "i").first()) == (0.5, 1)
    assert tuple(stats.error_bounded(df, "a", "b", 0.4, "i").first()) == (False, 1)
    assert stats.identical(df, "a", "a").first()["identical"]
    flat = spark.createDataFrame([(i, 1.0) for i in range(3)], "i long, a double")
    with pytest.raises(ValueError, match="differ"):
        delta.relative_bound(flat, "a", 0.1)


def test_index_range_takes_the_tile_filter_along(spark, tmp_path):
    spark.range(5000).select(F.col("id").alias("x"), F.floor(F.col("id") / 256).alias("tile_id")).write.parquet(str(tmp_path / "t"))
    out = delta.in_index_range(spark.read.parquet(str(tmp_path / "t")), 300, 700)
    assert [r["x"] for r in out.orderBy("x").collect()] == list(range(300, 700))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(tile_id,1)" in plan and "LessThanOrEqual(tile_id,2)" in plan


def test_limited_codes_cost_no_more_than_any(spark):
    from itertools import product

    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    counts = dict(enumerate(fib))
    lengths = huffman.limited_lengths(counts, 27)
    assert max(lengths.values()) == 27 and sum(2 ** (27 - n) for n in lengths.values()) == 2**27
    book = huffman.canonical(lengths)
    data = np.array([s for s in range(40) for _ in range(3)])
    _, cells, marks = huffman.encode_chunk(data, book)
    assert huffman.decode_chunk(cells, len(data), marks, book).tolist() == data.tolist()
    hist = spark.createDataFrame(list(counts.items()), "symbol int, n long")
    assert huffman.build(hist).longest == 27 and huffman.build(hist, word=64).longest == 39
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 5):
        for most in (3, 4):
            w = {s: int(x) for s, x in enumerate(rng.integers(1, 40, n) ** 2)}
            cost = lambda ls: sum(a * b for a, b in zip(w.values(), ls, strict=True))
            best = min(cost(ls) for ls in product(range(1, most + 1), repeat=n) if sum(2.0**-k for k in ls) <= 1)
            got = huffman.limited_lengths(w, most)
            assert cost(got[s] for s in w) == best and max(got.values()) <= most
    free = {s: int(x) for s, x in enumerate(rng.integers(1, 10**6, 300))}
    plain = huffman.code_lengths(free)
    assert sum(free[s] * k for s, k in huffman.limited_lengths(free, 58).items()) == sum(free[s] * k for s, k in plain.items())
    with pytest.raises(ValueError, match="no codes"):
        huffman.limited_lengths(dict.fromkeys(range(9), 1), 3)


def test_long_and_odd_texts_in_chunks_of_bytes(spark):
    rng = np.random.default_rng(0)
    texts = ["", "I" * 1_000_000, None, "".join(map(chr, rng.integers(33, 74, 700_001))), "é𝔵" * 3000, "", "FF"]
    df = spark.createDataFrame(list(enumerate(texts)), "rec_id long, quality string")
    book = huffman.build(huffman.byte_histogram(df, "quality", smooth=1))
    chunks = huffman.encoded(df, "quality", "rec_id", book).cache()
    sizes = {r["chunk_id"]: r["n"] for r in chunks.collect()}
    assert max(sizes.values()) == huffman.CHUNK and sum(sizes.values()) == sum(len((t or "").encode()) for t in texts)
    back = huffman.decoded(chunks, flat.with_offsets(df, "quality").select("rec_id", "length", "offset"), book)
    assert dict(map(tuple, back.collect())) == {i: t or "" for i, t in enumerate(texts)}
    again = huffman.encoded(df, "quality", "rec_id", book, size=1000)
    back = huffman.decoded(again, flat.with_offsets(df, "quality").select("rec_id", "length", "offset"), book, size=1000)
    assert dict(map(tuple, back.collect())) == {i: t or "" for i, t in enumerate(texts)}


def test_uncoded_bytes_of_long_characters(spark):
    df = spark.createDataFrame([(0, "AéB"), (1, "A€𝔵C"), (2, "")], "rec_id long, quality string")
    book = huffman.canonical({ord("A"): 1, ord("B"): 1})
    new, sparse = huffman.without_uncoded(df, "quality", "rec_id", book, ord("A"))
    flatted = b"".join(r["quality"].encode() for r in new.orderBy("rec_id").collect())
    data = bytearray(flatted)
    for r in sparse.collect():
        data[r["pos"]] = r["symbol"]
    assert bytes(data) == "AéBA€𝔵C".encode() and set(flatted) <= set(b"AB")
    assert huffman.encoded(new, "quality", "rec_id", book).count() == 1


@pytest.mark.parametrize("shape,sides", [((50,), (7,)), ((11, 9), (4, 5)), ((5, 7, 6), (3, 2, 4))])
def test_feedback_across_tiles_is_the_serial_one(spark, shape, sides):
    from quillstrand.operators import wavefront

    rng = np.random.default_rng(len(shape))
    v = np.cumsum(rng.normal(0, 1, shape), axis=0) * 3
    rows = [(*map(int, at), float(v[at])) for at in np.ndindex(*shape)]
    axes = ("x", "y", "z")[: len(shape)]
    df = spark.createDataFrame(rows, ", ".join(f"{a} long" for a in axes) + ", value double").repartition(3)
    codes, restored = wavefront.serial(v, 0.05, 16)
    coded = wavefront.compressed(df, "value", len(shape), 0.05, 16, sides).cache()
    got = {tuple(r[: len(shape)]): (r["code"], r["restored"], r["outlier"]) for r in coded.collect()}
    assert len(got) == v.size and (codes == 0).any() and (codes != 0).any()
    for at in np.ndindex(*shape):
        assert got[at] == (codes[at], restored[at], None if codes[at] else v[at])
    back = wavefront.decompressed(coded.drop("restored"), len(shape), 0.05, 16, sides)
    assert {tuple(r[: len(shape)]): r["restored"] for r in back.collect()} == {at: restored[at] for at in np.ndindex(*shape)}
    assert wavefront.compressed(df.limit(0), "value", len(shape), 0.05).count() == 0


def test_feedback_over_a_narrow_array_takes_few_steps(spark, monkeypatch):
    from quillstrand.operators import wavefront

    for shape in ((64, 400_000), (400_000, 3), (5_000, 7_000), (10**7,), (400, 500, 600)):
        sides = wavefront.sides_for(shape)
        tiles = [-(-n // s) for n, s in zip(shape, sides, strict=True)]
        assert np.prod(sides) <= wavefront.MOST and sum(tiles) <= 60
    steps, one = [], wavefront._step
    monkeypatch.setattr(wavefront, "_step", lambda *a: steps.append(1) or one(*a))
    v = np.cumsum(np.random.default_rng(3).normal(0, 1, (3, 2500)), axis=1)
    df = spark.createDataFrame([(int(x), int(y), float(v[x, y])) for x, y in np.ndindex(*v.shape)], "x long, y long, value double").repartition(3)
    codes, restored = wavefront.serial(v, 0.05, 16)
    got = wavefront.compressed(df, "value", 2, 0.05, 16).collect()
    assert len(steps) <= 8 and len(got) == v.size
    assert all((r["code"], r["restored"]) == (codes[r["x"], r["y"]], restored[r["x"], r["y"]]) for r in got)


def test_lengths_in_rounds_cost_what_a_heap_gives(monkeypatch):
    rng = np.random.default_rng(9)
    for w in (rng.integers(1, 50, 65_536), rng.zipf(1.3, 5000) % 10**9 + 1, np.array([1, 1]), np.array([5]), np.ones(1000, np.int64), np.array([1, 1, 2, 3, 5, 8, 13, 21])):
        w = np.sort(w.astype(np.int64))
        got = huffman.lengths_in_rounds(w)
        monkeypatch.setattr(huffman, "HEAP", 1 << 20)
        plain = huffman.code_lengths(dict(enumerate(w.tolist())))
        assert (got * w).sum() == sum(int(w[s]) * k for s, k in plain.items())
        assert len(w) == 1 or sum(2.0 ** -got) == 1
        monkeypatch.setattr(huffman, "HEAP", 0)
        assert huffman.code_lengths(dict(enumerate(w.tolist()))) == dict(enumerate(got.tolist()))


def test_blocks_are_dealt_out_by_the_number_of_cells(spark, monkeypatch):
    from quillstrand import session

    monkeypatch.setattr(session, "DEALT", 1000)
    cells = spark.range(10240).selectExpr("id % 16 as x", "id div 16 % 16 as y", "id div 256 as z", "sin(id) as value")
    coded = spline.predicted(cells, "value", 0.1)
    assert coded.rdd.getNumPartitions() == 11
    assert spline.restored(coded, 0.1).rdd.getNumPartitions() == 11


def test_tiles_and_chunks_are_dealt_out_by_the_number_of_cells(spark, monkeypatch):
    from quillstrand import session

    monkeypatch.setattr(session, "DEALT", 1000)
    cells = spark.range(10240).selectExpr("id", "id % 16 as x", "id div 16 as y", "sin(id) as value")
    coded = delta.quantized(cells, "value", 2, 0.1)
    assert coded.rdd.getNumPartitions() == 11
    assert bitshuffle.encoded(coded, "id", "code").rdd.getNumPartitions() == 11
