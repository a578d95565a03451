"""Operators on documents against plain versions, and their edge cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillstrand.llm import quality_rules, simhash, substring, weak_quality
from quillstrand.llm._text import Texts

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

EDGE = [
    (1, None),
    (2, ""),
    (3, " \t\r\n\x0b\x0c "),
    (4, "one"),
    (5, "a b c d e"),
    (5, "a b c d e"),
    (6, "naïve café \x85 \x1c word\n\nword\nword   x"),
    (7, "\n".join(["same line here"] * 6) + "\n tail"),
    (8, "x" * 300_000),
    (9, "w " * 3000),
    (10, " ".join(f"t{i}" for i in range(200))),
    (11, "lead " + " ".join(f"t{i}" for i in range(60)) + " end"),
    (12, " ".join(f"t{i}" for i in range(200))),
    (None, "no id at all"),
]


def edge(spark):
    df = spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "s", 0, "k", "q") for i, t in EDGE], "doc_id long, text string, lang string, source string, n_chars long, kept string, q string")
    return df.withColumn("id", F.lit("clash")).withColumn("fp", F.lit(1)).withColumn("n_words", F.lit("mine"))


def words(text):
    return WORD.findall((text or "").encode())


# words


def test_words_and_lines():
    texts = [t for _, t in EDGE]
    t = Texts(pa.array(texts))
    assert t.n_words.tolist() == [len(words(x)) for x in texts]
    doc, start, end = t.lines()
    got = [t.data[a:b].tobytes() for a, b in zip(start, end)]
    want = [line for x in texts for line in (x or "").encode().split(b"\n") if words(line.decode())]
    assert got == want
    h = t.word_hash
    flat = [w for x in texts for w in words(x)]
    assert len(set(h.tolist())) == len(set(flat)) and len(h) == len(flat)
    assert Texts(pa.array([], pa.string())).n == 0


# quality rules


def plain_measures(text):
    w = words(text)
    runs = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if runs[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dups, len(covered)


def test_measures_match_plain_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts = [r["text"] for r in docs] + [t for _, t in EDGE]
    m = quality_rules.measure(Texts(pa.array(texts)))
    got = list(zip(*(m[c].tolist() for c in quality_rules.BASE)))
    assert got == [plain_measures(t) for t in texts]


def test_exact_bound():
    # 0 of n is within rate r at confidence delta just if (1 - r) ** n <= delta
    assert quality_rules.within(0, 299, 0.01, 0.05) and not quality_rules.within(0, 298, 0.01, 0.05)
    assert not quality_rules.within(0, 0, 0.5, 0.5) and not quality_rules.within(9, 10, 0.5, 0.5)


def test_cutoffs_keep_their_promise():
    rng = np.random.default_rng(1)
    bad_runs = 0
    for _ in range(100):
        values = np.minimum(rng.geometric(0.05, 3000), quality_rules.STEPS)
        hist = np.bincount(values, minlength=quality_rules.STEPS + 1)
        cut = quality_rules.choose({("en", r): hist for r in quality_rules.RULES})["en", "symbol_share"]
        bad_runs += cut < quality_rules.STEPS and 0.95**cut > 0.01  # the true share above the cutoff
    assert bad_runs <= 5
    few = quality_rules.choose({("en", "repeat_share"): np.bincount([0] * 20, minlength=quality_rules.STEPS + 1)})
    assert few["en", "repeat_share"] == quality_rules.STEPS


def test_rules_on_edges(spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (10, 1, None), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(edge(spark), labels).collect()
    assert len(out) == len(EDGE)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["base_failed"] and not by[1]["kept"] and by[10]["kept"] and by[9]["base_failed"]
    assert quality_rules.quality_rules(edge(spark).limit(0), labels.limit(0)).count() == 0


def test_rules_reject_junk_and_keep_clean(spark):
    rng = np.random.default_rng(2)
    vocab = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    rows = []
    for i in range(4000):
        w = list(rng.choice(vocab, 80))
        if i % 10 == 0:
            w = [x + "***" for x in w]
        rows.append((i, " ".join(w), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    out = quality_rules.quality_rules(docs, labels).select("doc_id", "kept").collect()
    assert all(r["kept"] == (r["doc_id"] % 10 != 0) for r in out)


# classifier


def test_em_finds_accuracies():
    rng = np.random.default_rng(3)
    n, y = 20000, None
    y = rng.random(n) < 0.2
    acc = [0.95, 0.9, 0.8]
    v = np.stack([np.where(rng.random(n) < a, y, ~y) * 2 - 1 for a in acc], 1)
    pats, counts = np.unique(v, axis=0, return_counts=True)
    post, rates = weak_quality.em(pats, counts.astype(float))
    for j, a in enumerate(acc):
        assert abs(rates[j, 1, 2] - a) < 0.03 and abs(rates[j, 0, 0] - a) < 0.03


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    out = weak_quality.quality_classifier(docs, seen, keep=["doc_id"]).join(labels.where("doc_id % 2 = 1"), "doc_id")
    rows = out.groupBy("quality", "toxic", "kept").count().collect()
    n = Counter()
    for r in rows:
        n[(r["quality"] == 1 and r["toxic"] == 0, r["kept"])] += r["count"]
    clean, bad = n[True, True] + n[True, False], n[False, True] + n[False, False]
    assert n[True, True] / clean > 0.97 and n[False, False] / bad > 0.9


def test_classifier_on_edges(spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (10, None, 1)], "doc_id long, quality int, toxic int")
    out = weak_quality.quality_classifier(edge(spark), labels)
    assert out.count() == len(EDGE) and out.where("kept is null or bad_score is null").count() == 0
    assert weak_quality.quality_classifier(edge(spark).limit(0), labels.limit(0)).count() == 0
    assert weak_quality.quality_classifier(edge(spark), None).count() == len(EDGE)


# near duplicates


def plain_fingerprint(text):
    w = words((text or "").encode().lower().decode())
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_classes(prints):
    """Union-find over all pairs of different fingerprints."""
    ids = {}
    for i, f in prints:
        if i is not None:
            ids[f] = min(i, ids.get(f, i))
        else:
            ids.setdefault(f, None)
    fps, root = list(ids), {f: f for f in ids}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for f in fps:
        if ids[f] is not None:
            least[find(f)] = min(ids[f], least.get(find(f), ids[f]))
    return {f: least.get(find(f)) for f in fps}


@pytest.mark.parametrize("tile", [8192, 16])
def test_near_duplicates_match_all_pairs(spark, tile):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**62))
    prints = [(i, (base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 4)), replace=False)))) for i in range(150)]
    prints += [(1000 + i, int(rng.integers(0, 2**63))) for i in range(300)] + [(2000, prints[0][1])]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    fps = spark.createDataFrame([(signed(f),) for f in {f for _, f in prints}], "fp long")
    from quillstrand.llm.components import components

    got = components(simhash.links(fps, simhash.SimHash(tile=tile)))
    where = {r["node"]: r["component"] for r in got.collect()}
    groups = lambda of: {frozenset(x for x in of if of[x] == v) for v in of.values()}
    mine = {f: where.get(signed(f), signed(f)) for _, f in prints}
    assert groups(mine) == groups(plain_classes(prints))


def test_fingerprints_and_classes_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(edge(spark).select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    rows = docs.collect()
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in rows]
    classes = plain_classes(prints)
    want = sorted((str(i), f"{f:016x}", classes[f]) for i, f in prints)
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_near_duplicates_on_edges(spark):
    out = simhash.near_duplicates(edge(spark))
    assert out.count() == len(EDGE)
    zero = {r["component_id"] for r in out.where("fingerprint = '0000000000000000'").collect()}
    assert zero == {1}
    assert simhash.near_duplicates(edge(spark).limit(0)).count() == 0
    kept = simhash.keep_one(edge(spark))
    assert kept.columns == edge(spark).columns and {r["doc_id"] for r in kept.collect()} >= {1, 4, 8, None}


# repeated passages


def plain_removed(rows, size=50):
    first = {}
    for i, text in rows:
        if i is not None:
            w = words(text)
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((str(i), len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_sequences_that_collide_modulo_powers_of_two():
    for n in (256, 1024, 4096):
        a, b = "".join(thue_morse(n, "a", "b")), "".join(thue_morse(n, "b", "a"))
        t = Texts(pa.array([f"{a}\n{b}", f"{a} {b}", a, b]))
        m = quality_rules.measure(t)
        assert m["n_dup_lines"].tolist() == [0] * 4 and m["n_repeat_words"].tolist() == [0] * 4
        assert len(set(t.word_hash.tolist())) == 2 and len(set(t.text_hash.tolist())) == 4
        assert len(set(weak_quality.tokens(t).tolist())) == 2


@pytest.mark.parametrize("size", [50, 2048])
def test_windows_that_collide_modulo_powers_of_two(spark, size):
    if size == 50:  # one word differs
        rest = [f"v{i}" for i in range(49)]
        rows = [(i, " ".join([*rest, "".join(thue_morse(1024, *x))])) for i, x in enumerate(("ab", "ba"))]
    else:
        rows = [(i, " ".join(thue_morse(size, *x))) for i, x in enumerate((("left", "right"), ("right", "left")))]
    out = substring.judged(spark.createDataFrame(rows, "doc_id long, text string"), substring.Window(size), keep=["doc_id"])
    assert [r["n_removed"] for r in out.collect()] == [0, 0]


@pytest.mark.parametrize(("bucket", "extra"), [(1 << 19, 2), (500, 8), (500, 4)])
def test_repeated_windows_match_plain_ones(spark, monkeypatch, bucket, extra):
    monkeypatch.setattr(substring, "BUCKET", bucket)
    monkeypatch.setattr(substring, "extra_bytes", lambda total: extra)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(edge(spark).select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = substring.judged(docs.repartition(5), keep=["doc_id"])
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()) == plain_removed(rows)


def test_short_windows_and_texts(spark):
    rows = [(3, "a b c d\n e f g"), (1, "x a b c y"), (2, "c y a b c z"), (4, None), (5, "b c d"), (5, "b c d"), (-1, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spec = substring.Window(window=3)
    out = substring.judged(docs, spec, keep=["doc_id"])
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()) == plain_removed(rows, 3)
    texts = {r["doc_id"]: r["text"] for r in substring.remove_repeats(docs, spec).collect()}
    assert texts == {3: "d\n e f g", 1: "x a b c y", 2: "c y z", 4: None, 5: "", -1: "q"}


def test_repeats_on_edges(spark):
    out = substring.remove_repeats(edge(spark))
    assert out.columns == edge(spark).columns and out.count() == len(EDGE)
    assert {r["doc_id"]: r["text"] for r in out.collect()}[11] == "lead end"
    assert substring.judged(edge(spark).limit(0)).count() == 0
    assert substring.judged(edge(spark)).columns == ["doc_id", "lang", "source", "n_chars", "kept", "q", "id", "fp", "n_words", "n_removed", "kept_sha256", "kept_text"]
