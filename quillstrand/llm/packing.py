"""Best-fit packing of token sequences by linear grouping.

Documents are tokenised, cut where they are longer than the capacity, and
packed into as few sequences as possible.  How many pieces there are of each
length is all the packing needs, so it is planned on the driver from at most
``capacity`` counts, however many documents there are:

1. lengths over a share of the capacity are large; they are put in order into groups of equal cardinality and rounded
   up to the largest of their group;
2. the few sizes that remain are packed by a linear programme over
   configurations (column generation with a knapsack), rounded down;
3. actual lengths take the places of the rounded ones, largest first;
4. what is left, and the small lengths, go best-fit into the gaps, largest
   first, opening new sequences only where nothing fits.

The share that counts as large decides between close configurations of few
sizes and gaps that the rest can fill; ``Packing.large`` has several, and the
plan with the fewest sequences is taken.

The plan lists runs (length, first rank, number, first sequence, offset); the
rank of a piece among those of its length comes from counts by partition, so
pieces find their places without being gathered or sorted.

Edge cases: a null or empty text is the end token alone; a very long text is
cut into as many pieces as it takes; rows with the same or a null id
are packed one by one; an empty table gives an empty result; a length that
fills a sequence is one by itself; columns other than id and text are not
passed on, so theirs may have any names; bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ..session import bound_batches, materialize
from ._text import pieces, strings

#: Fixed value: the pattern that splits text before byte-level merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Packing:
    tokenizer: str
    capacity: int = 1024
    end_id: int = 2
    groups: int = 64
    large: tuple[float, ...] = (1 / 5, 1 / 3, 1 / 2)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in plain):
        out[chr(0x100 + n)] = b
    return out


@lru_cache(2)
def encoder(path: str):
    """text -> array of ids, as the tokenizers library gives them without special tokens added.

    The merges of a byte-level BPE file are its vocabulary's ids in order, which
    is what tiktoken takes and runs five times as fast.  Texts in which one of
    the file's added tokens occurs, and files of another kind, are run by
    tokenizers itself.
    """
    tok = Tokenizer.from_file(path)
    exact = lambda text: np.asarray(tok.encode(text, add_special_tokens=False).ids, np.uint32)
    spec = json.load(open(path, encoding="utf-8"))
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", ())]
    added = tuple(t["content"] for t in spec.get("added_tokens", ()))
    vocab = model.get("vocab", {})
    fits = (
        model.get("type") == "BPE"
        and spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not (model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    )
    if fits:
        byte = _byte_alphabet()
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}
        enc = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda text: exact(text) if any(a in text for a in added) else np.asarray(enc.encode_ordinary(text), np.uint32)
    return exact


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but for the first."""
    first = n - (-(-n // capacity) - 1) * capacity if n else 0
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def tokenized(docs: DataFrame, spec: Packing, id_col: str, text: str) -> DataFrame:
    """A row per piece, with the partition that made it and its rank there among the pieces of its length."""
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("__text"))
    ints = {"piece": T.IntegerType(), "start": T.LongType(), "length": T.LongType(), "ids_crc32": T.LongType(), "part": T.IntegerType(), "nth": T.LongType()}
    schema = T.StructType([src.schema["id"], *[T.StructField(k, v) for k, v in ints.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(spec.tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(spec.capacity + 1, np.int64)
        for batch in batches:
            for cut_batch in pieces(batch, "__text"):
                row, out = [], []
                for k, x in enumerate(strings(cut_batch.column(1))):
                    ids = np.append(encode(x or ""), np.uint32(spec.end_id)).astype("<u4")
                    for p, (start, length) in enumerate(cut(len(ids), spec.capacity)):
                        row.append(k)
                        out.append((p, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length]))
                        seen[length] += 1
                cols = np.array(out, np.int64).reshape(-1, 6).T
                yield pa.RecordBatch.from_arrays([cut_batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(c).cast(pa.int32() if n in ("piece", "part") else pa.int64()) for n, c in zip(ints, cols, strict=True)]], names=schema.names)

    return src.mapInArrow(run, schema)


def grouped(counts: np.ndarray, first: int, groups: int) -> list[tuple[int, int]]:
    """Ranges (lo, hi] of lengths from `first` on, with about equally many pieces each; all of a range counts as hi."""
    lengths = np.flatnonzero(counts[: len(counts) - 1])
    lengths = lengths[lengths >= first]
    if not len(lengths):
        return []
    up = np.cumsum(counts[lengths])
    marks = np.searchsorted(up, up[-1] * np.arange(1, groups + 1) / groups)
    ends = lengths[np.unique(np.minimum(marks, len(lengths) - 1))]
    return list(zip([first - 1, *ends[:-1].tolist()], ends.tolist(), strict=True))


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The worthiest multiset of sizes within the capacity."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.flatnonzero(worth > 1e-12)
    sz, wo = sizes[order], worth[order]
    least = int(sz.min()) if len(sz) else capacity + 1
    for c in range(least, capacity + 1):
        fit = sz <= c
        value = np.where(fit, wo + best[np.maximum(c - sz, 0)], -1.0)
        k = int(value.argmax())
        if value[k] > best[c - 1] + 1e-15:
            best[c], took[c] = value[k], order[k]
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(best[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1500) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each size) and how often each is used, from the linear programme rounded down."""
    n = len(sizes)
    if not n:
        return []
    cols, cost = [np.eye(n, dtype=np.int64)[g] * (capacity // sizes[g]) for g in range(n)], [1.0] * n
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x = inverse @ demand
    for _ in range(rounds):
        dual = np.array(cost) @ inverse
        if dual.min() < -1e-9:  # covering more than the demand pays: a surplus column enters
            enter, price = -np.eye(n, dtype=np.int64)[int(dual.argmin())], 0.0
        else:
            value, enter = _knapsack(sizes, dual, capacity)
            price = 1.0
            if value <= 1 + 1e-7:
                break
        d = inverse @ enter
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        step = inverse[leave] / d[leave]
        inverse -= np.outer(d, step)
        inverse[leave] = step
        cols[leave], cost[leave] = enter, price
        x = np.maximum(inverse @ demand, 0)
    return [(c, int(v + 1e-6)) for c, p, v in zip(cols, cost, x, strict=True) if p and v >= 1]


def plan(counts: np.ndarray, spec: Packing) -> np.ndarray:
    """Rows (length, first rank, number, first sequence, offset) that place all pieces.

    counts[l] pieces have length l.  A sequence of a row's run holds the piece
    of the next rank at the same offset.
    """
    plans = [plan_with(counts, spec, int(share * spec.capacity)) for share in spec.large]
    return min(plans, key=lambda p: (p[:, 3] + p[:, 2]).max(initial=0))


def plan_with(counts: np.ndarray, spec: Packing, small: int) -> np.ndarray:
    """The plan with lengths over `small` as large ones."""
    cap = spec.capacity
    taken = np.zeros(cap + 1, np.int64)  # ranks given out, by length
    runs: list[list] = []  # [first sequence, number, slack, [(length, first rank)]]
    opened = 0

    def opening(number: int, items: list[tuple[int, int]]) -> None:
        nonlocal opened
        runs.append([opened, number, cap - sum(x for x, _ in items), items])
        opened += number

    def take(length: int, number: int) -> int:
        taken[length] += number
        return int(taken[length] - number)

    if counts[cap]:
        opening(int(counts[cap]), [(cap, take(cap, int(counts[cap])))])
    ranges = grouped(counts, small + 1, spec.groups)
    sizes = np.array([hi for _, hi in ranges], np.int64)
    demand = np.array([counts[lo + 1 : hi + 1].sum() for lo, hi in ranges], float)
    for pattern, often in configurations(sizes, demand, cap):
        slots = [g for g in range(len(sizes))[::-1] for _ in range(pattern[g])]
        places = []  # per slot: runs of actual lengths over the `often` sequences
        for g in slots:
            lo, hi = ranges[g]
            need, got = often, []
            for length in range(hi, lo, -1):
                if need and (use := min(need, int(counts[length] - taken[length]))):
                    got.append((use, length, take(length, use)))
                    need -= use
            places.append(got + [(need, 0, 0)] * bool(need))
        at = 0
        while at < often:  # cut where any slot changes its length
            size, items = often - at, []
            for got in places:
                seen = 0
                for number, length, rank in got:
                    if at < seen + number:
                        size = min(size, seen + number - at)
                        if length:
                            items.append((length, rank + at - seen))
                        break
                    seen += number
            if items:
                opening(size, items)
            at += size
    # best fit of the rest into the gaps, longest first
    gaps: dict[int, list[list]] = {}
    for r in runs:
        gaps.setdefault(r[2], []).append(r)
    for length in range(cap - 1, 0, -1):
        left = int(counts[length] - taken[length])
        while left:
            slack = next((s for s in range(length, cap + 1) if gaps.get(s)), None)
            if slack is None:
                each = cap // length
                number = left // each or 1
                use = min(each, left)
                opening(number, [(length, take(length, number)) for _ in range(use)])
                gaps.setdefault(runs[-1][2], []).append(runs[-1])
                left -= number * use
                continue
            r = gaps[slack].pop()
            number = min(left, r[1])
            if number < r[1]:  # the other sequences of the run stay as they are
                rest = [r[0] + number, r[1] - number, slack, [(x, k + number) for x, k in r[3]]]
                runs.append(rest)
                gaps[slack].append(rest)
            r[1], r[2], r[3] = number, slack - length, [*r[3], (length, take(length, number))]
            gaps.setdefault(r[2], []).append(r)
            left -= number
    rows = []
    for first, number, _, items in runs:
        offset = 0
        for length, rank in items:
            rows.append((length, rank, number, first, offset))
            offset += length
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(docs: DataFrame, spec: Packing, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = materialize(tokenized(docs, spec, id_col, text), "pieces")
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    totals = np.zeros(spec.capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        totals[r["length"]] = r["n"]
    places = plan(totals, spec)
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = made.join(before, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    schema = T.StructType([T.StructField(id_col, ranked.schema["id"].dataType), *[ranked.schema[c] for c in ("piece", "start", "length", "ids_crc32")], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (places[:, 0] << 48) | places[:, 1]
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.searchsorted(key, (length << 48) | rank, "right") - 1
            row = places[at]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=schema.names)

    return ranked.mapInArrow(run, schema)
