"""Each occurrence of a word has its own merge-dropout."""

import pytest

from quillstrand.llm import piece_codec, queries

PIECES = queries.tokenizer("piece_bpe_32k.model")


@pytest.mark.parametrize("leaves", [1 << 19, 5])
def test_every_occurrence_is_cut_by_its_own_draw(leaves):
    c = piece_codec.Codec(PIECES, piece_codec.Dropout(rate=0.2, seed=3))
    c.LEAVES = leaves
    texts = ["the information of internationalisation 🎉x▁ " * 300, "once only here, " + "y" * 100, "the information of"]
    for _ in range(3):
        for text, key, ids in zip(texts, (5, 6, 7), c.encode_all(texts, [5, 6, 7]), strict=True):
            chunks = c.chunks(text)
            want = [i for w, v in zip(chunks, c.variants(len(chunks), key).tolist(), strict=True) for i in (c._ids(c.merge(w, v)) if w else c.marks)]
            assert ids.tolist() == want


def test_cuts_are_as_many_as_the_models_own_dropout_makes():
    """The query's rate, on one common word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    word, n = "information", 4000
    theirs = [tuple(sp.encode(word, enable_sampling=True, alpha=0.1, nbest_size=-1)) for _ in range(n)]
    c = piece_codec.Codec(PIECES, piece_codec.Dropout(rate=0.1, seed=8))
    mine = [tuple(x.tolist()) for x in c.encode_all([word] * n, list(range(n)))]
    plain = tuple(sp.encode(word))
    assert len(set(mine)) > 5 and abs(len(set(mine)) - len(set(theirs))) <= 0.4 * len(set(theirs))
    assert abs(mine.count(plain) - theirs.count(plain)) < 0.05 * n
