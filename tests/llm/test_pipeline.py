"""The pipeline against a plain version of its stages."""

import zlib

import numpy as np
import pytest
from test_near_copies import plain_components
from test_text_ops import EDGE, edge, plain_measures, plain_removed, words

import corpus_pipeline
from quillstrand.llm import queries, quality_rules, weak_quality
from quillstrand.session import materialize, read_table

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def plain_kept(docs, labels):
    """Ids that the quality rules keep, from plain measures of the base rules; these tables have too few labels for further cutoffs."""
    out = set()
    for i, text in docs.items():
        n, _, _, _, repeats = plain_measures(text)
        if not (n < 50 or 100 * repeats > 50 * n):
            out.add(i)
    return out


def test_stages_against_plain_ones(spark):
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "near_duplicates", "substring_dedup", "packing"]
    after = []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "stage")
        after.append(docs)
    for df in after[:-1]:
        assert df.columns == columns
    given = rows(read_table(spark, SF, "documents"))
    first = rows(after[0])
    assert set(first) == plain_kept(given, None) and all(first[i] == given[i] for i in first)

    judged = weak_quality.quality_classifier(after[0], read_table(spark, SF, "labels"), keep=["doc_id"])
    second = rows(after[1])
    assert set(second) == {r["doc_id"] for r in judged.where("kept").collect()}
    labels = {r["doc_id"]: r for r in read_table(spark, SF, "labels").collect()}
    clean = [i for i in first if i in labels and labels[i]["quality"] == 1 and labels[i]["toxic"] == 0]
    assert sum(i in second for i in clean) >= 0.95 * len(clean)

    # near copies are texts of five-word shingles' similarity of 0.8 or more, by all pairs
    classes = plain_components(second.items())
    third = rows(after[2])
    assert set(third) == {i for i in second if classes[i] == i}

    fourth = rows(after[3])
    want = {int(i): (n - gone, digest) for i, n, gone, digest in plain_removed(third.items())}
    import hashlib

    assert set(fourth) == set(third)
    for i, text in fourth.items():
        w = words(text)
        assert (len(w), hashlib.sha256(b" ".join(w)).hexdigest()) == want[i]
    assert all(r["n_chars"] == len(r["text"]) for r in after[3].collect())

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    pieces = {}
    for r in after[4].collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(fourth)
    for i, text in fourth.items():
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 2], "<u4")
        for r in pieces[i]:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert sum(r["length"] for r in pieces[i]) == len(ids)

    run = {tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == {tuple(r)[:5] for r in after[4].collect()}


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_nothing(spark, stage):
    docs = read_table(spark, SF, "documents").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, SF).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_edges(spark, stage):
    """Null ids and texts, long and repeated texts, repeated ids, and columns named like the results."""
    docs = edge(spark)
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, SF)
    got = sorted(str(r["doc_id"]) for r in out.collect())
    ids = sorted(str(i) for i, _ in EDGE)
    if name == "packing":
        assert set(got) == set(ids)
        return
    assert out.columns == docs.columns
    if name == "quality_rules":
        assert got == sorted(str(i) for i, t in EDGE if i in (10, 11, 12))
    elif name == "near_duplicates":
        assert got == sorted(map(str, [1, 4, 5, 5, 6, 7, 8, 9, 10, 11, None]))
    elif name == "substring_dedup":
        assert got == ids and run(spark, docs.drop("n_chars"), SF).columns == docs.drop("n_chars").columns


def test_rules_here_have_no_cutoffs(spark):
    measured = materialize(quality_rules.with_measures(read_table(spark, SF, "documents"), keep=["doc_id", "lang"]), "m")
    cutoffs = quality_rules.choose(quality_rules.good_histograms(measured, read_table(spark, SF, "labels"), "doc_id", "lang"))
    assert set(cutoffs.values()) == {quality_rules.STEPS}
