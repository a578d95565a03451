"""Sketches and the comparison of neighbours, against plain versions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstrand.llm import queries, sketches
from quillstrand.llm._text import Texts, mix
from quillstrand.llm.sketches import Sketch

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def plain_sketch(text, spec):
    """Word by word and shingle by shingle."""
    words, word = [], b""
    for b in (text or "").encode() + b" ":
        if chr(b) in SPACE:
            if word:
                words.append(word)
            word = b""
        else:
            word += bytes([b + 32 if 65 <= b <= 90 else b])
    code = {w: Texts(pa.array([w.decode()])).word_hash[0] for w in set(words)}
    found = set()
    for i in range(max(1, len(words) - spec.shingle + 1) if words else 0):
        h = sketches.SEED
        for w in words[i : i + spec.shingle]:
            h = mix(np.array([h ^ code[w]], np.uint64))[0]
        found.add(int(h))
    kept = {h for h in found if h < (1 << 64) // spec.scale} or set(sorted(found)[:1])
    return sorted(kept)


def plain_likeness(a, b):
    return 1.0 if a == b else len(set(a) & set(b)) / min(len(a), len(b)) if a and b else 0.0


def plain(rows, spec):
    """rows in the order that is judged."""
    hexed = lambda s: "".join(f"{h:016x}" for h in s)
    out = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, e, b = (plain_sketch(t, spec) for t in (text, edited, after))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(e), plain_likeness(a, e), plain_likeness(a, b)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(n, seed):
    rng = random.Random(seed)
    words = ["eins", "Zwei", "trois", "quatro", "fünf", "𝔰𝔦𝔵", "Ä", "é"]
    return [(i, rng.choice(["", " ", "\t"]) + rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.choice([0, 1, 3, 5, 6, 40, 200])))) for i in rng.sample(range(-5000, 5000), n)]


@pytest.mark.parametrize("scale,range_bytes", [(1, 1 << 22), (8, 500), (64, 4000)])
def test_plain_version(spark, scale, range_bytes):
    rows = made(120, scale)
    rows[3], rows[4] = (rows[3][0], None), (rows[4][0], rows[9][1])
    spec = Sketch(scale=scale, range_bytes=range_bytes)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, part string, id string").repartition(5)
    assert got(sketches.judged(df, spec)) == plain(sorted(rows, key=lambda r: -r[0]), spec)


def test_query_on_the_smallest_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = queries.QUERIES["op11_fingerprints"](spark, SF)
    mine = got(df)
    assert mine == plain(sorted(rows, key=lambda r: -r[0]), Sketch())
    far = [r for r in mine if r[6] < 0.5]
    assert sum(r[5] for r in far) / len(far) > 0.4 > 0.05 > sum(r[6] for r in far) / len(far)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert got(sketches.judged(spark.createDataFrame([], schema))) == []
    one = got(sketches.judged(spark.createDataFrame([(5, "a b c d e f g")], schema)))
    assert one == plain([(5, "a b c d e f g")], Sketch()) and one[0][6] == 1.0
    blank = got(sketches.judged(spark.createDataFrame([(1, None), (2, " \n")], schema)))
    assert [(r[0], r[1], r[3], r[6]) for r in blank] == [(1, 0, "", 1.0), (2, 2, "", 1.0)]


def test_repeated_and_missing_ids(spark):
    rows = [(7, f"text {k} of many words in a row") for k in range(40)] + [(None, "no id at all"), (None, "none here"), (3, "three"), (7, "text 1 of many words in a row")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    low = F.coalesce("doc_id", F.lit(sketches.LEAST_ID).cast("long"))
    order = [(r["doc_id"], r["text"]) for r in df.orderBy(low.desc(), F.xxhash64("text").desc()).collect()]
    for size in (100, 1 << 22):
        assert got(sketches.judged(df, Sketch(range_bytes=size))) == plain(order, Sketch())


def test_long_text_and_its_part(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    part = " ".join(long.split()[1000:1400])
    big, small = sketches.sketched(pa.array([long, part]), Sketch())
    assert abs(len(big) / 199_996 - 1 / 8) < 0.01 and sketches.likeness(small, big) == 1.0


def test_merged_sketches_hold_their_parts(spark):
    spec = Sketch(scale=4)
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(300)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = sketches.sketch_rows(docs, spec, keep=["source"])
    share = sketches.contained(rows.select("doc_id", "hash"), "doc_id", sketches.merged(rows, ["source"]), "source", spec)
    found = {(r["doc_id"], r["source"]): r["share"] for r in share.collect()}
    assert all(found[i, f"s{i % 3}"] == 1.0 for i in range(12)) and all(v < 0.1 for (i, s), v in found.items() if s != f"s{i % 3}")
    whole = sketches.sketched(pa.array(texts), spec)
    assert {(r["source"], r["hash"]) for r in sketches.merged(rows, ["source"]).collect()} == {(f"s{i % 3}", int(h)) for i, s in enumerate(whole) for h in s.view(np.int64)}
