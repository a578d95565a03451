"""The pipeline's near-duplicates against all pairs' Jaccard similarity."""

import random

import numpy as np
import pytest
from test_text_ops import EDGE, edge, words

import corpus_pipeline
from quillstrand.llm import near_copies


def plain_sets(rows):
    out = {}
    for i, text in rows:
        w = words((text or "").encode().lower().decode())
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def plain_components(rows):
    """Least id of each text's component, from all pairs of sets."""
    sets = plain_sets(rows)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            n = len(x & y)
            if 5 * n >= 4 * (len(x) + len(y) - n):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**9)}" if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("tile", [1024, 4])
def test_stage_drops_every_near_copy(spark, tile):
    rng = random.Random(4)
    rows = []
    for k in range(40):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice((60, 150, 600))))
        rows += [base, *[edited(rng, base, s) for s in (0.005, 0.01, 0.02, 0.03, 0.05)]]
    chain = " ".join(f"c{k}" for k in range(300))
    for _ in range(25):  # each is near to the last, but not to the first
        chain = edited(rng, chain, 0.012)
        rows.append(chain)
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, near_copies.NearCopies(tile=tile)).collect()}
    assert got == want
    if tile == 1024:
        kept = {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()}
        assert kept == {i for i in want if want[i] == i}


def test_members_of_one_bucket_are_all_compared():
    spec = near_copies.NearCopies()
    a, b = np.arange(100, dtype=np.uint64), np.arange(1000, 1100, dtype=np.uint64)
    sets = [a, b, np.append(b[5:], b[:1]), a[10:]]
    assert near_copies.spanning(np.arange(4), np.arange(4), sets, spec) == [(0, 3), (1, 2)]


def test_edges(spark):
    kept = near_copies.keep_one(edge(spark))
    assert kept.columns == edge(spark).columns
    ids = sorted((r["doc_id"] is not None, r["doc_id"]) for r in kept.select("doc_id").collect())
    assert [i for _, i in ids if i is not None] == [1, 4, 5, 5, 6, 7, 8, 9, 10, 11] and len(EDGE) == 14
    assert near_copies.keep_one(edge(spark).limit(0)).count() == 0


def test_documents_that_differ_in_many_bits_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = plain_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()} == {i for i in want if want[i] == i}


def test_fingerprints_alone_bring_copies_of_four_bits_together(spark):
    from quillstrand.llm import simhash

    rng = random.Random(6)
    rows = []
    for k in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(400)]
        rows += [" ".join(base), *(" ".join([*base[:at], f"e{k}", *base[at + 1 :]]) for at in (0, 200, 399))]
    rows += ["", None, "one two", "again and again and again and again and again", "again and again and again and again and again and again"]
    rng.shuffle(rows)
    sets, spec = plain_sets(enumerate(rows)), simhash.SimHash(shingle=5)
    prints = [simhash.fingerprint((t or "").encode(), spec) for t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if (prints[a] ^ prints[b]).bit_count() <= 4 and 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert sum(r != i for i, r in enumerate(root)) > 30
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, near_copies.NearCopies(bands=0)).collect()}
    assert got == dict(enumerate(root))
