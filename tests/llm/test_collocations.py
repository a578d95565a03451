"""Collocations against a plain version that counts every phrase."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quillstrand.llm import collocations, queries
from quillstrand.llm.collocations import Phrases

SCHEMA = "doc_id long, text string, lang string, rank string, id string"


def plain(rows, spec):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = tuple(w for w in re.split(r"[\x20\x09]+", piece) if w)
            n[lang] += len(ws)
            for k in range(1, spec.longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, ws[i : i + k]] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= spec.least}
    held = Counter()
    for (lang, ws), a in cand.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                held[lang, ws[i : i + k]] = max(held[lang, ws[i : i + k]], a)
    by = {}
    for (lang, ws), a in cand.items():
        if 100 * held[lang, ws] >= spec.inside * a:
            continue
        cuts = [(spec.scale * a // (f[lang, ws[:j]] + f[lang, ws[j:]]), j) for j in range(1, len(ws))]
        s, j = min(cuts)
        by.setdefault(lang, []).append((-s, -a, " ".join(ws).encode(), f[lang, ws[:j]], f[lang, ws[j:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rs in by.items() for i, (s, a, p, left, right) in enumerate(sorted(rs)[: spec.top]))


def got(spark, rows, spec, parts=3):
    df = spark.createDataFrame([(i, t, g, "r", "x") for i, (t, g) in enumerate(rows)], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in collocations.collocations(df, spec).collect())


def made(n, seed):
    rng = random.Random(seed)
    words = ["a", "A", "bb", "Ccc", "ü", "𝔵", "new", "york", "d" * 70]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", ",", "  "]) for _ in range(rng.randrange(60)))
    return [(text(), rng.choice(["en", "de", None, "en us", "und"])) for _ in range(n)]


@pytest.mark.parametrize("spec", [Phrases(least=3), Phrases(least=2, chunk_bytes=300, bucket=7, top=9), Phrases(least=1, longest=3, inside=50, chunk_bytes=50, bucket=3)])
def test_plain_version(spark, spec):
    rows = made(60, spec.least)
    rows += rows[:5] + [(None, "en"), ("", None), (" \n.", "de")]
    assert got(spark, rows, spec) == plain(rows, spec)


def test_one_phrase_that_most_texts_share(spark):
    rows = [("the same line comes again and again", "en")] * 400 + made(40, 9)
    spec = Phrases(least=30, chunk_bytes=500, bucket=10)
    mine = got(spark, rows, spec)
    assert mine == plain(rows, spec) and any(r[3] == 400 for r in mine)


def test_nothing_frequent_and_nothing_at_all(spark):
    assert got(spark, [("one two three", "en")], Phrases()) == []
    assert got(spark, [], Phrases(least=1)) == []


def test_long_texts_are_cut_between_pieces():
    text = b"aa bb. " * 10 + b"x " * 40 + b"! end"
    parts = list(collocations.cut_text(text, 20))
    assert b"".join(parts) == text and all(p[-1] in b".!" for p in parts[:-1]) and max(map(len, parts)) > 60
    assert list(collocations.cut_text(b"no end " * 9, 20)) == [b"no end " * 9]


def test_numbers_pack_and_unpack():
    for x in ([], [0], [255, 0], [256], [1 << 40, 3, 0], [(1 << 62) + 1]):
        assert collocations.unpack(collocations.pack(np.array(x, np.int64))).tolist() == x


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 7_000_000_000_000, 8_000_000_000_001, 9_000_000_000_000
    df = spark.createDataFrame([(a, [left], [right])], "f long, heads array<long>, tails array<long>")
    row = df.select(collocations.score(2, 2_000_000).alias("s")).select(F.col("s.score")).first()
    assert row[0] == 2_000_000 * a // (left + right)


def test_sql_with_lower_bounds(spark):
    """The query's SQL, with bounds that bite on the smallest tables."""
    from quillstrand.llm import oracles

    spec = Phrases(least=5, top=50, inside=60)
    con = duckdb.connect()
    con.execute("create view documents as select * from read_parquet('/root/testdata/sf0.001/documents.parquet')")
    want = sorted(con.execute(oracles.phrase_sql(spec)).fetchall())
    df = collocations.collocations(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spec)
    assert sorted(tuple(r) for r in df.collect()) == want and max(r[1] for r in want) == spec.top
    assert "op12_collocations" in queries.ORACLES
