"""k-means against a plain version in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillstrand.llm import centroids
from quillstrand.llm.centroids import Centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def plain(rows, spec):
    kept = [(i, [math.floor(spec.scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == spec.dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{spec.seed}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    z = [v for _, v in sorted(kept, key=key)[: spec.k]]
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(z)), key=lambda c: (gap(v, z[c]), c))
    for _ in range(spec.rounds):
        own = [near(v) for _, v in kept]
        z = [[sum(col) // len(col) for col in zip(*mine)] if (mine := [v for (_, v), o in zip(kept, own) if o == c]) else z[c] for c in range(len(z))]
    own = [(i, near(v), gap(v, z[near(v)])) for i, v in kept]
    per = {c: sum(d for _, o, d in own if o == c) for c in range(len(z))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in z]
    return sorted(((i, c, d, per[c], sum(per.values()), sha[c]) for i, c, d in own), key=repr)


def got(spark, rows, spec, parts=3):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in centroids.clusters(df, spec).collect()), key=repr)


def made(n, dims, seed, grid=4):
    rng = random.Random(seed)
    return [(i, [rng.randrange(-grid, grid) / grid for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("dims,k,leaf", [(3, 5, 2), (8, 8, 4), (2, 3, 32)])
def test_plain_version_with_ties(spark, dims, k, leaf):
    # few values: many equal distances and equal vectors
    spec = Centroids(k=k, dims=dims, rounds=4, block=64, leaf=leaf)
    rows = made(300, dims, dims)
    rows += [(7, rows[7][1]), (None, rows[3][1]), (None, rows[9][1])]
    assert got(spark, rows, spec) == plain(rows, spec)


def test_rows_that_take_no_part(spark):
    spec = Centroids(k=2, dims=2, rounds=2)
    rows = [(1, None), (2, [1.0]), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [0.5, -0.5]), (7, [1.0, 2.0, 3.0]), (8, []), (9, [0.25, 1.0])]
    assert [r[0] for r in got(spark, rows, spec)] == [6, 9] and got(spark, rows, spec) == plain(rows, spec)


def test_few_and_none(spark):
    spec = Centroids(k=8, dims=2, rounds=2)
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0])]
    assert got(spark, rows, spec) == plain(rows, spec)
    assert got(spark, [], spec) == []


def test_large_numbers_stay_exact(spark):
    # two far-away clusters whose members are equal: distances between clusters pass 64 bits
    spec = Centroids(k=3, dims=2, rounds=3, leaf=2)
    rows = [(i, [1e30, -1e25]) for i in range(5)] + [(i, [3e9 + 1024 * (i % 3), 1.0]) for i in range(5, 30)] + [(i, [-1e30, 2.0]) for i in range(30, 33)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert got(spark, rows, spec) == plain(rows, spec)


def test_a_distance_beyond_longs_raises(spark):
    with pytest.raises(Exception, match="int64|too large|overflow|long"):
        got(spark, [(1, [1e20, 0.0]), (2, [-1e20, 0.0]), (3, [0.0, 0.0])], Centroids(k=1, dims=2, rounds=1))


def test_trees_prune_and_lose_nothing():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(-20, 20, (500, 4)) + 1000 * c for c in range(4)]).astype(float)
    tree, order = centroids.Tree.built(data, 16)
    assert (tree.data == data[order]).all() and sorted(order) == list(range(2000))
    z = np.array([[1000.0 * c + 3] * 4 for c in range(4)])
    whole, rows, labels = tree.filtered(z, 0)
    taken = sum(b - a for a, b, _, _ in whole)
    assert taken + len(rows) == 2000 and len(whole) < 60 and not len(rows)
    for a, b, node, c in whole:
        assert (tree.sums[0, node] == tree.data[a:b].sum(0)).all()
        assert (np.argmin(((tree.data[a:b, None] - z[None]) ** 2).sum(2), 1) == c).all()
