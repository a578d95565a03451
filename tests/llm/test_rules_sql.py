"""Quality rules with active cutoffs against the SQL; labels of the classifier against plain versions."""

import duckdb
import numpy as np
import pyarrow as pa

from quillstrand.llm import queries, quality_rules, weak_quality
from quillstrand.llm._text import Texts


def texts(rng, n):
    vocab = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(2000)]
    out = []
    for i in range(n):
        w = list(rng.choice(vocab, int(rng.integers(52, 90))))
        if i % 50 == 0:
            w[: i // 50 % 12] = ["#$%"] * (i // 50 % 12)
        if i % 9 == 0:
            w = [x.upper() for x in w[:30]] + w[30:]
        if i % 11 == 0:
            w[10:10] = ["\n", *w[:20], "\n", *w[:20], "\n"]
        out.append(" ".join(w))
    return out


def test_active_cutoffs_equal_the_sql(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts(rng, 9000))] + [(9001, None, "en"), (9002, "", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bad = {i for i in range(9000) if i % 9 == 0 or i % 11 == 0}
    labels = spark.createDataFrame([(i, 0 if i in bad else 1, 0) for i in range(9000) if i % 4] + [(1, None, 0), (2, 0, 0), (None, 1, 0), (99_999, 1, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    measured = quality_rules.with_measures(docs, keep=["doc_id", "lang"])
    cutoffs = quality_rules.choose(quality_rules.good_histograms(measured, labels, "doc_id", "lang"))
    assert sum(c < quality_rules.STEPS for c in cutoffs.values()) > 5
    out = queries.op7_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    res = con.execute(queries.ORACLES["op7_quality_rules"])
    names = [d[0] for d in res.description]
    want = sorted(res.fetchall())
    got = sorted(tuple(r[c] for c in names) for r in out.collect())
    assert got == want and any(not r[-1] and not r[-2] for r in got)


EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + "".join(map(chr, range(32))) + "\x7f"


def plain_tokens(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w.decode()).strip(EDGE) for w in (text or "").encode().split()]


def plain_votes(text, learned):
    """Some labellers' votes by their rules."""
    w = [x.decode() for x in (text or "").encode().split()]
    t, n = plain_tokens(text), len(w)

    def by(share, good, bad):
        return 1 if share >= bad else -1 if share <= good else 0

    symbols = sum(c in "#*$%&|<>" for c in text or "")
    listed = sum(x in weak_quality.INSULTS for x in t)
    hits = sum(x in weak_quality.INSULTS or x in learned for x in t)
    echoes = sum(a == b for a, b in zip(t, t[1:]))
    upper, lower = (sum(a <= c <= b for c in text or "") for a, b in (("A", "Z"), ("a", "z")))
    return {
        "symbol_density": by(min(symbols * 200 // max(n, 1), 200), 2, 20),
        "symbol_words": by(sum(any(c in "#*$%&|<>" for c in x) for x in w) * 200 // max(n, 1), 4, 20),
        "echoes": by(echoes * 200 // (n + 20), 2, 20),
        "capitals": by(upper * 200 // max(upper + lower, 1), 20, 50),
        "marks": by(sum(x.endswith("!") for x in w) * 200 // max(n, 1), 4, 40),
        "listed_insult": 1 if listed > 1 or listed * 100 > n else -1 if listed == 0 else 0,
        "learned_insult": 1 if hits - listed > 1 else -1 if hits == 0 else 0,
        "several_insults": 1 if hits > 1 else -1 if hits == 0 else 0,
    }


SOME = [None, "", "You idiot!!!!! Such TRASH, 'worthless'", "BUY NOW!!! $$$ ### ***", "a a a a b b b", "plain words in a row " * 20, "é " * 60 + "grumbly grumbly.", "?!", "<b>x</b> & y | z"]


def test_votes_equal_plain_ones():
    t = Texts(pa.array(SOME))
    learned = weak_quality.tokens(Texts(pa.array(["grumbly"])))
    known = weak_quality.listed_words(weak_quality.INSULTS), weak_quality.Members(learned)
    got = weak_quality.votes(t, quality_rules.measure(t), weak_quality.tokens(t), known)
    for i, text in enumerate(SOME):
        want = plain_votes(text, {"grumbly"})
        assert {k: int(got[k][i]) for k in want} == want, text


def plain_em(patterns, counts, rounds=60):
    """EM over vote patterns with loops: posterior of bad for each pattern."""
    post = [1 / (1 + np.exp(-2.0 * sum(p) - max(p))) for p in patterns]
    for _ in range(rounds):
        prior = (sum(q * c for q, c in zip(post, counts)) + 1) / (sum(counts) + 2)
        logs = [[np.log(1 - prior), np.log(prior)] for _ in patterns]
        for j in range(len(patterns[0])):
            for cls in (0, 1):
                n = {v: sum((q if cls else 1 - q) * c for p, q, c in zip(patterns, post, counts) if p[j] == v) + (2.0 if v == 0 else 5.0 if v == (1 if cls else -1) else 1.0) for v in (-1, 0, 1)}
                for k, p in enumerate(patterns):
                    logs[k][cls] += np.log(n[p[j]] / sum(n.values()))
        post = [1 / (1 + np.exp(a - b)) for a, b in logs]
    return post


def test_em_equals_plain_loops():
    rng = np.random.default_rng(2)
    pats = np.array([(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    counts = rng.integers(1, 400, len(pats)).astype(float)
    assert np.allclose(weak_quality.em(pats, counts)[0], plain_em(pats.tolist(), counts.tolist()), atol=1e-9)


def test_scores_are_those_of_the_weights(spark):
    rng = np.random.default_rng(3)
    fit = weak_quality.Fit(bits=12)
    w, bias, learned = rng.normal(size=1 << 12).astype(np.float32), -0.3, np.zeros(0, np.uint64)
    docs = spark.createDataFrame(list(enumerate(SOME)), "doc_id long, text string")
    got = {r["doc_id"]: r["bad_score"] for r in weak_quality.score(docs, (w, bias, learned), "text", fit, ["doc_id"]).collect()}
    for i, text in enumerate(SOME):
        one = Texts(pa.array([text], pa.string()))
        hashes = weak_quality.tokens(one)
        buckets = {int(h) >> 52 for h in hashes.tolist()}
        m = quality_rules.measure(one)
        levels = [min(int(m[x][0]) * 20 // 200, 10) for x in ("symbol_share", "dup_line_share", "repeat_share", "shout_share")]
        levels.append(min(sum(x in weak_quality.INSULTS for x in plain_tokens(text)), 3))
        buckets |= {(0x9E3779B97F4A7C15 * (level + 16 * k + 1) & (2**64 - 1)) >> 52 for k, level in enumerate(levels)}
        assert abs(got[i] - 1 / (1 + np.exp(-(bias + sum(float(w[b]) for b in buckets))))) < 1e-6, text


def test_training_follows_its_gradient():
    """The trained scorer ranks texts with the marked bucket as bad, and its loss is below the prior's."""
    rng = np.random.default_rng(5)
    y = (np.arange(600) % 5 == 0).astype(float)
    docs = [np.unique(np.append(rng.integers(0, 200, 20), 300 if bad else 301)) for bad in y]
    w, bias = weak_quality.train(docs, y, weak_quality.Fit(bits=9))
    score = np.array([1 / (1 + np.exp(-(bias + w[d].sum()))) for d in docs])
    assert score[y == 1].min() > 0.5 > score[y == 0].max() and w[300] > 0 > w[301]
