"""Quality classifier without hand-made labels for every document.

1. Overlapping heuristic labellers vote bad, good or abstain on each document;
   human labels, where there are some, are one more labeller.  Each looks at
   one aspect of a bad text: symbols, repetition, shouting or insults.  Besides
   a fixed list of insults, one labeller has a list learned for all languages
   from at most ``Fit.label_rows`` labelled texts.
2. Per aspect, expectation-maximisation over the counts of vote patterns (at
   most 81 each, whatever the number of documents) estimates each
   labeller's accuracy and the posterior of every pattern; a text is bad if it is so in any aspect.
3. The posteriors label a sample of at most ``Fit.rows`` different texts (near
   copies share a sketch, and sketches are drawn by a hash of their own) on which a linear scorer over hashed words and
   binned measures is trained.  Only the fit is bounded: the vote counts cover
   all documents and every document is scored.

A document is kept if its bad-score is under one half.  Edge cases: a null
text has no words and is scored by its measures alone; with an empty table,
or where one class is missing from the sample, the scorer falls back to its
prior; human labels that are null, or repeat with different values, abstain;
input columns named like the results are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches, materialize
from ._text import Texts, byte_hashes, mix, passed_on, pieces
from .quality_rules import LOWER, STEPS, SYMBOLS, UPPER, measure

#: Words that insult.
INSULTS = tuple("trash pathetic idiot worthless disgusting stupid clown scum loser moron idiots losers clowns morons imbecile garbage filth retard bastard bitch dumb dumbass jerk vermin subhuman freak hateful".split())

#: The labellers of each aspect; the last is the human label.
ASPECTS = {
    "symbols": ("symbol_density", "symbol_words", "symbol_chars", "human_quality"),
    "repetition": ("repeats", "lines", "echoes", "human_quality"),
    "shouting": ("shout_words", "capitals", "marks", "human_quality"),
    "insults": ("listed_insult", "learned_insult", "several_insults", "human_toxic"),
}
LABELLERS = tuple(dict.fromkeys(x for names in ASPECTS.values() for x in names))

_LOWER_OF = np.arange(256, dtype=np.uint8)
_LOWER_OF[65:91] += 32
#: ASCII bytes other than letters and digits are cut from the ends of words.
_EDGE = np.zeros(256, bool)
_EDGE[:128] = True
_EDGE[48:58] = _EDGE[65:91] = _EDGE[97:123] = False


@dataclass(frozen=True)
class Fit:
    """rows: most texts that the scorer is trained on; label_rows: most labelled texts that insults are learned from; bits: log2 of its hash space; insults: the list that one labeller has, which may be empty."""

    rows: int = 10_000
    label_rows: int = 20_000
    bits: int = 18
    least_z: float = 4.0
    epochs: int = 150
    threshold: float = 0.5
    insults: tuple[str, ...] = INSULTS


def tokens(t: Texts) -> np.ndarray:
    """Hashes of the words, ASCII letters small and ASCII punctuation cut from both ends."""
    data = _LOWER_OF[t.data]
    inner = ~_EDGE[data]
    at, before = np.flatnonzero(inner), np.concatenate([[0], np.cumsum(inner)])
    first, last = before[t.start], before[t.end]
    some = first < last  # a word of punctuation only is cut to nothing
    start, end = t.start.copy(), t.start.copy()
    start[some], end[some] = at[first[some]], at[last[some] - 1] + 1
    return byte_hashes(data, start, end, 21)


class Members:
    """Membership in a small set of hashes: a table over their highest bits leaves few words to look up."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys)
        self.high = np.zeros(1 << 16, bool)
        self.high[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def __call__(self, words: np.ndarray) -> np.ndarray:
        out = self.high[(words >> np.uint64(48)).astype(np.int64)]
        at = np.flatnonzero(out) if len(self.keys) else out[:0]
        if len(at):
            place = np.minimum(np.searchsorted(self.keys, words[at]), len(self.keys) - 1)
            out[at] = self.keys[place] == words[at]
        return out


@lru_cache(4)
def listed_words(insults: tuple[str, ...]) -> Members:
    return Members(tokens(Texts(pa.array([" ".join(insults)], pa.string()))))


def insult_hits(t: Texts, words: np.ndarray, known: tuple[Members, Members]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text that are listed, and that are listed or learned; known: both lists."""
    listed = known[0](words)
    return t.per_word_sum(listed), t.per_word_sum(listed | known[1](words))


def votes(t: Texts, m: dict[str, np.ndarray], words: np.ndarray, known: tuple[Members, Members]) -> dict[str, np.ndarray]:
    """1 bad, -1 good, 0 abstain."""

    def by(share: np.ndarray, good: int, bad: int) -> np.ndarray:
        return np.where(share >= bad, 1, np.where(share <= good, -1, 0))

    def share(some: np.ndarray, of: np.ndarray) -> np.ndarray:
        return some * STEPS // np.maximum(of, 1)

    n = m["n_words"]
    listed, hits = insult_hits(t, words, known)
    marked = np.concatenate([[0], np.cumsum(SYMBOLS[t.data])])
    echo = np.zeros(len(words), bool)
    echo[1:] = (words[1:] == words[:-1]) & (t.doc[1:] == t.doc[:-1])
    last = t.data[t.end - 1] if len(t.end) else t.data[:0]
    capitals, letters = t.per_text(UPPER[t.data]), t.per_text(UPPER[t.data] | LOWER[t.data])
    return {
        "symbol_density": by(m["symbol_share"], STEPS // 100, STEPS // 10),
        "symbol_words": by(share(t.per_word_sum(marked[t.end] > marked[t.start]), n), STEPS // 50, STEPS // 10),
        "symbol_chars": by(m["n_symbols"] * 1000 // np.maximum(m["word_chars"], 1), 3, 30),
        "repeats": by(m["repeat_share"], STEPS // 10, STEPS // 4),
        "lines": by(m["dup_line_share"], STEPS // 10, STEPS // 4),
        "echoes": by(share(t.per_word_sum(echo), n + 20), STEPS // 100, STEPS // 10),
        "shout_words": by(m["shout_share"], STEPS // 50, STEPS // 5),
        "capitals": by(share(capitals, letters), STEPS // 10, STEPS // 4),
        "marks": by(share(t.per_word_sum(last == ord("!")), n), STEPS // 50, STEPS // 5),
        # one such word in a long text may be a harmless use, and a learned one chance
        "listed_insult": np.where((listed > 1) | (listed * 100 > n), 1, np.where(listed == 0, -1, 0)),
        "learned_insult": np.where(hits - listed > 1, 1, np.where(hits == 0, -1, 0)),
        "several_insults": np.where(hits > 1, 1, np.where(hits == 0, -1, 0)),
    }


def features(t: Texts, m: dict[str, np.ndarray], words: np.ndarray, known: tuple[Members, Members], bits: int, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text index and bucket of each different feature of each text, in order; `used` tells which buckets are wanted."""
    shift = np.uint64(64 - bits)
    doc, bucket = [t.doc], [(words >> shift).astype(np.int64)]
    shares = ("symbol_share", "dup_line_share", "repeat_share", "shout_share")
    levels = [np.minimum(m[x] * 20 // STEPS, 10) for x in shares]  # twentieths, all from one half on together
    levels.append(np.minimum(insult_hits(t, words, known)[1], 3))
    for k, level in enumerate(levels):
        doc.append(np.arange(t.n))
        bucket.append(((np.uint64(0x9E3779B97F4A7C15) * (level + 16 * k + 1).astype(np.uint64)) >> shift).astype(np.int64))
    docs, buckets = np.concatenate(doc), np.concatenate(bucket)
    if used is not None:
        wanted = used[buckets]
        docs, buckets = docs[wanted], buckets[wanted]
    key = np.unique((docs << bits) | buckets)
    return key >> bits, key & ((1 << bits) - 1)


def sketches(t: Texts, words: np.ndarray) -> np.ndarray:
    """The least hash of three words in a row: copies share it, near copies mostly."""
    out = t.text_hash.view(np.int64).copy()
    at = t.window_starts(3)
    if len(at):
        key = mix(words[at] + np.uint64(3) * words[at + 1] + np.uint64(5) * words[at + 2]).view(np.int64)
        doc = t.doc[at]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        out[doc[first]] = np.minimum.reduceat(key, first)
    return out


def agreed(labels: DataFrame, id_col: str, column: str) -> DataFrame:
    """(__id, label) of the documents whose labels do not contradict each other."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(id_col).alias("__id"))
    return rows.agg(F.min(column).alias("label"), F.max(column).alias("hi")).where("label = hi").drop("hi")


def sketch_table(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, sketch) of every document."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text"):
                t = Texts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sketches(t, tokens(t)))], names=["id", "sketch"])

    return src.mapInArrow(run, T.StructType([src.schema["id"], T.StructField("sketch", T.LongType())]))


def drawn(by_sketch: DataFrame, most: int) -> DataFrame:
    """At most so many rows, by a hash of the sketch: the least sketches are those of texts with many different words."""
    return by_sketch.orderBy(F.xxhash64("sketch", F.lit(5)), "sketch").limit(most)


def learn_insults(docs: DataFrame, labels: DataFrame, id_col: str, text: str, fit: Fit) -> np.ndarray:
    """Hashes of words that mark toxic texts: met in several of them, and hardly in others.

    The labelled texts to learn from are chosen by id before any text moves:
    one of each sketch, drawn whatever the texts' lengths, and the same on every run.
    """
    rows = sketch_table(docs, id_col, text).join(agreed(labels, id_col, "toxic"), F.col("id") == F.col("__id"))
    sample = drawn(rows.groupBy("sketch").agg(F.min(F.struct("id", "label")).alias("r")), fit.label_rows).select("r.*").collect()
    if not sample:
        return np.zeros(0, np.uint64)
    # at most label_rows ids are broadcast
    chosen = docs.sparkSession.createDataFrame([(r["id"], int(r["label"])) for r in sample], T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("label", T.LongType())]))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("__text")).join(F.broadcast(chosen), F.col("id") == F.col("__id")).select("label", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text"):
                t = Texts(part.column(1))
                # a row for each different word of each text
                key = np.unique(np.stack([t.doc.astype(np.uint64), tokens(t)]), axis=1)
                label = part.column(0).to_numpy()[key[0].astype(np.int64)]
                word, at = np.unique(key[1], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bincount(at, label, len(word)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(word)))], names=["w", "bad", "n"])

    words = src.mapInArrow(run, "w long, bad long, n long").groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    found = words.where((F.col("bad") >= 6) & (F.col("bad") >= 0.9 * F.col("n"))).select("w").collect()  # at most a sixth of the words of label_rows texts
    return np.array(sorted(r["w"] for r in found), np.int64).view(np.uint64)


def vote_table(docs: DataFrame, labels: DataFrame | None, learned: np.ndarray, id_col: str, text: str, insults: tuple[str, ...] = INSULTS) -> DataFrame:
    """Per document: id, sketch and all votes."""
    names = [c for c in LABELLERS if not c.startswith("human")]
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([src.schema["id"], T.StructField("sketch", T.LongType()), *[T.StructField(c, T.ByteType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = listed_words(insults), Members(learned)
        for batch in batches:
            for part in pieces(batch, "__text"):
                t = Texts(part.column(1))
                words = tokens(t)
                v = votes(t, measure(t), words, known)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sketches(t, words)), *[pa.array(v[c].astype(np.int8)) for c in names]], names=["id", "sketch", *names])

    out = src.mapInArrow(run, schema)
    human = {"human_quality": ("quality", 0), "human_toxic": ("toxic", 1)}
    if labels is None:
        return out.select("*", *[F.lit(0).cast("byte").alias(c) for c in human])
    for c, (column, bad) in human.items():
        one = agreed(labels, id_col, column).select("__id", F.when(F.col("label") == bad, 1).otherwise(-1).cast("byte").alias(c))
        out = out.join(one, out["id"] == one["__id"], "left").drop("__id")
    return out.fillna(0, list(human))


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of bad per vote pattern, and P(vote | class) per labeller.

    patterns: (n, k) of -1, 0, 1; counts: (n,).  Starts from the balance of
    the votes, so the class called bad is the one most bad votes agree on.
    """
    post = 1 / (1 + np.exp(-2.0 * patterns.sum(1) - 1.0 * patterns.max(1, initial=-1)))
    k = patterns.shape[1]
    table = np.zeros((k, 2, 3))
    for _ in range(rounds):
        w = np.stack([(1 - post) * counts, post * counts])  # class x pattern
        for j in range(k):
            for v in (-1, 0, 1):
                table[j, :, v + 1] = w[:, patterns[:, j] == v].sum(1) + (2.0 if v == 0 else 1.0 + 4.0 * (v == np.array([-1, 1])))
        table /= table.sum(2, keepdims=True)
        prior = (w.sum(1) + 1) / (w.sum() + 2)
        logs = np.log(prior) + sum(np.log(table[j, :, patterns[:, j] + 1]) for j in range(k))
        post = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
    return post, table


def posteriors(table: DataFrame) -> tuple[dict, dict]:
    """{aspect: {pattern: posterior}} and {aspect: P(vote | class) by labeller}, from counts over all documents."""
    out, rates = {}, {}
    for aspect, names in ASPECTS.items():
        rows = table.groupBy(*names).count().collect()  # 3 ** len(names) at most
        rows.sort(key=lambda r: tuple(r[c] for c in names))
        pats = np.array([[r[c] for c in names] for r in rows], np.int64).reshape(-1, len(names))
        post, rate = em(pats, np.array([r["count"] for r in rows], float))
        out[aspect] = {tuple(map(int, p)): float(x) for p, x in zip(pats, post, strict=True)}
        rates[aspect] = dict(zip(names, rate, strict=True))
    return out, rates


def posterior(post: dict, votes_of) -> float:
    """Bad in any aspect, from the votes of one document (a mapping)."""
    good = 1.0
    for aspect, names in ASPECTS.items():
        good *= 1 - post[aspect][tuple(votes_of[c] for c in names)]
    return 1 - good


def train(docs: list[np.ndarray], y: np.ndarray, fit: Fit) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer over present buckets, from soft labels."""
    w = np.zeros(1 << fit.bits)
    n, bad = len(y), float(y.sum())
    if n == 0 or bad < 1e-9 or n - bad < 1e-9:
        return w.astype(np.float32), 0.0 if n == 0 else (-6.0 if bad < n / 2 else 6.0)
    doc = np.repeat(np.arange(n), [len(d) for d in docs])
    bucket = np.concatenate(docs)
    present = np.bincount(bucket, minlength=len(w)).astype(float)
    present_bad = np.bincount(bucket, y[doc], minlength=len(w))
    rate_bad, rate_good, rate = present_bad / bad, (present - present_bad) / (n - bad), present / n
    z = (rate_bad - rate_good) / np.sqrt(np.maximum(rate * (1 - rate), 1 / n) * (1 / bad + 1 / (n - bad)))
    chosen = (np.abs(z) >= fit.least_z) & (present >= 5)
    use = chosen[bucket]
    doc, bucket = doc[use], bucket[use]
    bias, g2, gb2 = np.log(bad / (n - bad)), np.full(len(w), 1e-8), 1e-8
    # both classes weigh the same, so that rare bad texts are not given up
    weight = y / bad + (1 - y) / (n - bad)
    for _ in range(fit.epochs):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(doc, w[bucket], minlength=n), -30, 30)))
        err = (p - y) * weight
        g = np.bincount(bucket, err[doc], minlength=len(w)) + 1e-4 * w
        g2 += g * g
        gb2 += err.sum() ** 2
        w -= 0.5 * g / np.sqrt(g2) * chosen
        bias -= 0.5 * err.sum() / np.sqrt(gb2)
    return w.astype(np.float32), float(bias)


def fit_scorer(docs: DataFrame, labels: DataFrame | None, id_col: str, text: str, fit: Fit) -> tuple[np.ndarray, float, np.ndarray]:
    """Steps 1 to 3; the sample's features, at most fit.rows short lists of buckets, come to the driver."""
    bound_batches(docs.sparkSession)
    learned = np.zeros(0, np.uint64) if labels is None else learn_insults(docs, labels, id_col, text, fit)
    table = materialize(vote_table(docs, labels, learned, id_col, text, fit.insults), "votes")
    post, _ = posteriors(table)
    sample = drawn(table.groupBy("sketch").agg(F.min(F.struct("id", *LABELLERS)).alias("r")), fit.rows).select("r.*")
    soft = {r["id"]: posterior(post, r) for r in sample.collect() if r["id"] is not None}
    if not soft:
        return *train([], np.zeros(0), fit), learned
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i,) for i in soft], T.StructType([T.StructField("__id", docs.schema[id_col].dataType)]))
    src = docs.join(F.broadcast(ids), F.col(f"`{id_col}`") == F.col("__id"), "left_semi").select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("__text"))
    bits, insults = fit.bits, fit.insults

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = listed_words(insults), Members(learned)
        for batch in batches:
            for part in pieces(batch, "__text"):
                t = Texts(part.column(1))
                doc, bucket = features(t, measure(t), tokens(t), known, bits)
                at = np.searchsorted(doc, np.arange(t.n + 1))
                raw = [bucket[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=["id", "buckets"])

    rows = src.mapInArrow(run, T.StructType([src.schema["id"], T.StructField("buckets", T.BinaryType())])).dropDuplicates(["id"]).collect()
    rows.sort(key=lambda r: r["id"])
    return *train([np.frombuffer(r["buckets"], "<i4").astype(np.int64) for r in rows], np.array([soft[r["id"]] for r in rows]), fit), learned


def score(docs: DataFrame, model: tuple[np.ndarray, float, np.ndarray], text: str, fit: Fit, keep: list[str] | None = None) -> DataFrame:
    """docs with ``bad_score`` (0 to 1) and ``kept``."""
    w, bias, learned = model
    used = np.flatnonzero(w)
    used, weight, bits, threshold, insults = used.astype(np.int32), w[used], fit.bits, fit.threshold, fit.insults
    rest = passed_on(docs.columns if keep is None else keep, ("bad_score", "kept"))
    src = docs.select(F.col(f"`{text}`").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__row"))
    schema = T.StructType([src.schema["__row"], T.StructField("bad_score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, known = np.zeros(1 << bits), (listed_words(insults), Members(learned))
        full[used] = weight
        for batch in batches:
            for part in pieces(batch, "__text"):
                t = Texts(part.column(0))
                doc, bucket = features(t, measure(t), tokens(t), known, bits, full != 0)
                s = 1 / (1 + np.exp(-np.clip(bias + np.bincount(doc, full[bucket], minlength=t.n), -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(s), pa.array(s < threshold)], names=["__row", "bad_score", "kept"])

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col("__row")[c].alias(c) for c in rest], "bad_score", "kept")


def quality_classifier(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text: str = "text", fit: Fit = Fit(), keep: list[str] | None = None) -> DataFrame:
    """Judge every document: its columns, ``bad_score`` and ``kept``."""
    return score(docs, fit_scorer(docs, labels, id_col, text, fit), text, fit, keep)


