"""What the quality classifier learns from."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quillstrand.llm import weak_quality
from quillstrand.llm._text import Texts


@pytest.fixture(scope="module")
def tables(spark):
    """A fifth of the texts are short, and toxic."""
    rng = random.Random(6)
    rows = []
    for i in range(1000):
        bad = i % 5 == 0
        own = [f"{'b' if bad else 'g'}{rng.randrange(10**6)}" for _ in range(20 if bad else 600)]
        rows.append((i, " ".join(["zorgle", *own] if bad else own), 1 - bad, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality long, toxic long").repartition(4).cache()
    return df.select("doc_id", "text"), df.drop("text")


@pytest.mark.parametrize("most", [100, 200, 400])
def test_short_and_bad_texts_keep_their_share(spark, tables, monkeypatch, most):
    seen = {}

    def train(docs, y, fit):
        seen["short"], seen["bad"] = np.mean([len(d) < 100 for d in docs]), np.mean(y)
        return np.zeros(1 << fit.bits, np.float32), 0.0

    monkeypatch.setattr(weak_quality, "train", train)
    docs, labels = tables
    _, _, learned = weak_quality.fit_scorer(docs, labels, "doc_id", "text", weak_quality.Fit(rows=most, label_rows=most))
    spread = 3.5 * (0.2 * 0.8 / most) ** 0.5
    assert abs(seen["short"] - 0.2) < spread and abs(seen["bad"] - 0.2) < spread
    assert set(weak_quality.tokens(Texts(pa.array(["zorgle"]))).tolist()) <= set(learned.tolist())


def test_punctuation_is_cut_whatever_its_length():
    t = Texts(pa.array(["idiot idiot!!!!! ??????idiot...!!!!!!", "!!!!!!!!! !", None, "a-b 'a-b'"]))
    h = weak_quality.tokens(t)
    assert h[0] == h[1] == h[2] and h[3] == h[4] and h[5] == h[6] and len(set(h.tolist())) == 3
    assert len(weak_quality.tokens(Texts(pa.array([], pa.string())))) == 0


def test_all_words_that_qualify_are_learned(spark):
    rng = random.Random(1)
    rows = []
    for i in range(8):
        own = [f"x{k}" for k in range(5500)]
        rng.shuffle(own)
        rows.append((i, " ".join(own), 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic long")
    learned = weak_quality.learn_insults(df.select("doc_id", "text"), df.drop("text"), "doc_id", "text", weak_quality.Fit())
    assert len(learned) == 5500
