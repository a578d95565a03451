"""Codes of alphabets that no task holds: costs as a heap gives, codes free of prefixes, round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstrand import session
from quillstrand.operators import huffman, scan, wide


@pytest.mark.parametrize("seed", range(6))
def test_lengths_by_weight_cost_what_a_heap_gives(seed):
    rng = np.random.default_rng(seed)
    kinds = [rng.integers(1, 9, 3000), rng.zipf(1.5, 2000) % 10**6 + 1, np.ones(seed + 1, np.int64), rng.integers(1, 10**6, 500), 2 ** np.arange(20), np.array([1, 1, 1, 1, 3, 3, 4])]
    w = np.asarray(kinds[seed], np.int64)
    weights, symbols = (x.tolist() for x in np.unique(w, return_counts=True))
    got = wide.class_lengths(weights, symbols)
    assert [sum(k for _, k in c) for c in got] == symbols
    plain = huffman.code_lengths(dict(enumerate(w.tolist())))
    assert sum(n * length * k for n, c in zip(weights, got, strict=True) for length, k in c) == sum(int(w[s]) * k for s, k in plain.items())
    assert len(w) == 1 or sum(k * 2.0**-length for c in got for length, k in c) == 1


def _rows(spark, symbols):
    return spark.createDataFrame([(i, int(s)) for i, s in enumerate(symbols)], "idx long, symbol long")


def _check(spark, symbols, size=64):
    rows = _rows(spark, symbols)
    book = wide.book(rows)
    got = {r["symbol"]: (r["n"], r["length"], r["code"]) for r in book.collect()}
    values, counts = np.unique(symbols, return_counts=True)
    assert {s: n for s, (n, _, _) in got.items()} == dict(zip(values.tolist(), counts.tolist(), strict=True))
    # the book is that of these lengths
    assert {s: (c, k) for s, (_, k, c) in got.items()} == huffman.canonical({s: k for s, (_, k, _) in got.items()}, 64).codes
    assert sum(n * k for n, k, _ in got.values()) == wide.cost(rows.groupBy("symbol").agg(F.count("*").alias("n"))).first()["bits"]
    bits = sorted(format(c, f"0{k}b") for _, k, c in got.values())
    assert not any(b.startswith(a) for a, b in zip(bits, bits[1:], strict=False))
    chunks = wide.encoded(rows, book, size=size)
    assert chunks.agg(F.sum("nbit")).first()[0] == sum(n * k for n, k, _ in got.values())
    assert sorted(map(tuple, wide.decoded(chunks, book, size).collect())) == list(enumerate(int(s) for s in symbols))


def test_round_trip(spark):
    rng = np.random.default_rng(3)
    _check(spark, rng.zipf(1.4, 1500) % 700 - 50)  # negative symbols too
    _check(spark, np.repeat([5], 130))
    _check(spark, np.arange(257) << 50)  # each symbol once, far apart


def test_a_third_of_all_rows_is_one_symbol_and_scans_have_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(scan, "GROUP", 2)
    monkeypatch.setattr(session.hot_keys, "__defaults__", ("n", 16, 1000))
    rng = np.random.default_rng(4)
    _check(spark, np.where(rng.random(600) < 0.4, 7, rng.integers(0, 200_000, 600)))


def test_edges(spark):
    none = _rows(spark, [])
    book = wide.book(none)
    assert book.columns == ["symbol", "n", "length", "code"] and book.count() == 0
    chunks = wide.encoded(none, book)
    assert chunks.count() == 0 and wide.decoded(chunks, book).count() == 0
    assert tuple(wide.cost(none.groupBy("symbol").agg(F.count("*").alias("n"))).first()) == (0, 0)
    rows = _rows(spark, [1, 2, 2])
    book = wide.book(rows.unionByName(spark.createDataFrame([(3, None)], "idx long, symbol long")))
    assert book.count() == 2
    for bad in (_rows(spark, [1, 9]), rows.where("idx != 1"), spark.createDataFrame([(0, None)], "idx long, symbol long"), rows.unionByName(rows)):
        with pytest.raises(Exception, match="no code in this book|not numbered"):
            wide.encoded(bad, book).collect()
