"""Quality rules with risk-controlled thresholds.

Every rule is a number computed from the whole text and a cutoff: a document
is rejected where the number is above it.  The base rules are fixed.  The
cutoffs of the other rules are chosen from labelled documents: per stratum and
rule, cutoffs are tried from the loosest to the tightest and the last one is
taken whose exact (Clopper-Pearson) upper bound on the rate of rejected good
documents is within its share of the allowed risk.  Trying them in a fixed
order and stopping at the first failure needs no further correction inside a
rule; across rules and strata the confidence is corrected by Bonferroni, and
the allowed risk is split over the rules, so that with confidence
``1 - delta`` no stratum loses more than ``risk`` of its good documents to the
rules together.  A stratum with too few labels certifies nothing and keeps
its documents.

Edge cases: a null text has no words and fails the base rules; an empty table
gives an empty result; null strata form a stratum of their own; a label that
is null, or whose document is missing, is not used; labels repeated for a
document count once if they agree and not at all if they do not.  Columns
other than id, text and stratum are passed on, but for any that have the
names of the results, which replace them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches, materialize
from ._text import Texts, byte_hashes, mix, passed_on, pieces, repeats_of

SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LOWER = np.zeros(256, bool)
LOWER[97:123] = True

#: What each rule divides, in steps of the resolution below.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("symbol_share", "dup_line_share", "repeat_share", "shout_share", "short_line_share")
#: Cutoffs are multiples of 1/STEPS; numbers are held as integers 0 to STEPS.
STEPS = 200


def measure(t: Texts) -> dict[str, np.ndarray]:
    """The numbers of all rules for the texts of a slice."""
    n = t.n_words.astype(np.int64)
    lead = (t.data & 0xC0) != 0x80
    out = {"n_words": n, "word_chars": t.per_text(t.inside & lead), "n_symbols": t.per_text(SYMBOLS[t.data])}
    doc, start, end = t.lines()
    _, later = repeats_of(mix(byte_hashes(t.data, start, end, 12) + doc.astype(np.uint64)))
    n_lines = np.bincount(doc, minlength=t.n)
    out["n_dup_lines"] = np.bincount(doc[later], minlength=t.n)
    at = t.window_starts(3)
    h = t.word_hash
    key = mix(mix(mix(h[at] + np.uint64(1)) + h[at + 1]) + h[at + 2]) if len(at) else np.zeros(0, np.uint64)
    many, _ = repeats_of(mix(key + t.doc[at].astype(np.uint64)))
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[at[many] + k] = True
    out["n_repeat_words"] = t.per_word_sum(covered)
    # a shouted word has four ASCII capitals or more and no ASCII small letter
    caps = np.concatenate([[0], np.cumsum(UPPER[t.data])])
    small = np.concatenate([[0], np.cumsum(LOWER[t.data])])
    shout = (caps[t.end] - caps[t.start] >= 4) & (small[t.end] == small[t.start])
    words_in = np.searchsorted(t.start, end) - np.searchsorted(t.start, start)
    some, lines = np.maximum(n, 1), np.maximum(n_lines, 1)
    # a share may pass 1 (many symbols in a word): it is held at 1
    share = lambda a, b: np.minimum(a * STEPS // b, STEPS).astype(np.int64)
    return out | {
        "symbol_share": share(out["n_symbols"], some),
        # in a short text a heading met again is a large share: a few more lines and words are added to it
        "dup_line_share": share(out["n_dup_lines"], lines + 8),
        "repeat_share": share(out["n_repeat_words"], some + 40),
        "shout_share": share(t.per_word_sum(shout), some),
        "short_line_share": share(np.bincount(doc[words_in <= 2], minlength=t.n), lines),
    }


def with_measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns `keep` of it) with the numbers in a struct column ``q``."""
    rest = passed_on(docs.columns if keep is None else keep, ("q", "base_failed", "kept"))
    names = [*BASE, *RULES]
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{text}`").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__row") if rest else F.lit(True).alias("__row"))
    schema = T.StructType([src.schema["__row"], T.StructField("q", T.StructType([T.StructField(c, T.LongType()) for c in names]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text"):
                m = measure(Texts(part.column(0)))
                q = pa.StructArray.from_arrays([pa.array(m[c], pa.int64()) for c in names], names)
                yield pa.RecordBatch.from_arrays([part.column(1), q], names=["__row", "q"])

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col("__row")[c].alias(c) for c in rest], "q")


def base_failed(n_words: str = "q.n_words", repeats: str = "q.n_repeat_words"):
    return (F.col(n_words) < 50) | (100 * F.col(repeats) > 50 * F.col(n_words))


def within(k: int, n: int, rate: float, delta: float) -> bool:
    """Whether the exact (Clopper-Pearson) upper bound after k of n is at most `rate`.

    That is so if a true rate of `rate` shows k or fewer of n with probability
    `delta` at most.
    """
    if n == 0 or k > rate * n:
        return False
    i = np.arange(1, k + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i))])
    terms = logs + np.arange(k + 1) * math.log(rate) + (n - np.arange(k + 1)) * math.log1p(-rate)
    top = terms.max()
    return float(top + np.log(np.exp(terms - top).sum())) <= math.log(delta)


@dataclass(frozen=True)
class Risk:
    """risk: the share of good documents that all rules together may reject in a stratum; delta: the chance that this fails."""

    risk: float = 0.05
    delta: float = 0.05


def choose(counts: dict, risk: Risk = Risk()) -> dict:
    """Cutoffs from histograms of good documents.

    counts: {(stratum, rule): array of STEPS + 1 counts}.  Returns
    {(stratum, rule): cutoff}, documents above it being rejected; STEPS
    rejects none.
    """
    strata = {s for s, _ in counts}
    delta = risk.delta / max(1, len(strata) * len(RULES))
    out = {}
    for key, hist in counts.items():
        n, best = int(hist.sum()), STEPS
        above = n - np.cumsum(hist)  # above[c]: good documents over cutoff c
        for c in range(STEPS - 1, -1, -1):
            if not within(int(above[c]), n, risk.risk / len(RULES), delta):
                break
            best = c
        out[key] = best
    return out


def good_histograms(measured: DataFrame, labels: DataFrame, id_col: str, stratum: str, good: str = "quality") -> dict:
    """Counts of each rule's numbers over the labelled good documents that pass the base rules.

    The result has strata x rules x (STEPS + 1) numbers at most; strata are
    languages, so it is small whatever the number of documents.
    """
    votes = labels.where(F.col(good).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(good).alias("lo"), F.max(good).alias("hi"))
    votes = votes.where((F.col("lo") == 1) & (F.col("hi") == 1)).select("__id")
    rows = measured.where(~base_failed()).join(votes, F.col(f"`{id_col}`") == F.col("__id"), "left_semi")
    rows = rows.select(F.col(f"`{stratum}`").alias("s"), F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"q.{r}").alias("v")) for r in RULES])).alias("x"))
    out: dict = {}
    for r in rows.groupBy("s", "x.rule", "x.v").count().collect():
        out.setdefault((r["s"], r["rule"]), np.zeros(STEPS + 1, np.int64))[r["v"]] += r["count"]
    return out


def judge(measured: DataFrame, cutoffs: dict, stratum: str) -> DataFrame:
    """measured with ``base_failed`` and ``kept``."""
    over = F.lit(False)
    for (s, rule), c in sorted(cutoffs.items(), key=str):
        if c < STEPS:
            over = over | (F.col(f"`{stratum}`").eqNullSafe(F.lit(s)) & (F.col(f"q.{rule}") > c))
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", stratum: str = "lang", risk: Risk = Risk(), keep: list[str] | None = None) -> DataFrame:
    """Judge every document: its columns, the numbers ``q``, ``base_failed`` and ``kept``."""
    narrow = materialize(with_measures(docs, text, [id_col, stratum]), "measures")
    cutoffs = choose(good_histograms(narrow, labels, id_col, stratum), risk)
    if keep is not None and set(keep) <= {id_col, stratum}:
        return judge(narrow, cutoffs, stratum)
    # measuring again moves no text; joining the verdicts to the texts would
    return judge(with_measures(docs, text, keep), cutoffs, stratum)
