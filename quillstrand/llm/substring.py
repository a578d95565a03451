"""Substring de-duplication by Rabin-Karp hashes of every fixed-length window.

Every window of ``window`` consecutive words of every text is hashed.  A
window is repeated if its hash also starts in a text of a smaller id; the words
that repeated windows cover are removed, neighbouring and overlapping windows
merging into maximal intervals.  Windows are judged on the input.

Flow.  (1) Each slice of texts hashes its windows, keeps one entry per hash
(that of its smallest id; the others of the slice are repeats already, which
pre-aggregates large groups of copies) and deals the entries out by hash,
packed in arrays.  (2) Each hash bucket finds the smallest id of every hash and
sends the hashes of repeated windows back to the other ids.  (3) Texts with
repeated windows meet their hashes, find their windows again, and lose the
covered words; the others need only what (1) has already told of them.

Hashes are polynomials modulo 2**31 - 1 over independent bases: 62 bits from
two, and as many more of the third and fourth as the size of the input needs
(``extra_bytes``), so that the chance of any two of n different windows meeting
stays under 1e-3 (n**2 / 2**79 with 16 more bits, at 30 GB of text 4e-5;
n**2 / 2**94 with 32, up to 17 TB; n**2 / 2**125 with 64).

Edge cases: a null or blank text has no words; of rows with the same id each
is judged alike (a window repeated inside one id is not removed); an empty
table gives an empty result; rows whose id is null take no part in (1) and
(2) and keep their words; input columns named like the results are replaced
by them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches
from ._text import PRIME, Rolling, Texts, mix, passed_on, pieces, reduced

_ROLL = [Rolling(seed) for seed in (31, 32, 33, 34)]
#: Windows of a bucket, about; buckets follow from the size of the input.
BUCKET = 1 << 19


@dataclass(frozen=True)
class Window:
    window: int = 50


def extra_bytes(total: int) -> int:
    """Bytes of further hash bits for `total` bytes of text, which have total / 4 windows at most, roughly."""
    n = total / 4
    return 2 if n * n < 2.0**69 else 4 if n * n < 2.0**84 else 8


def window_hashes(t: Texts, size: int, extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, 62-bit hash and `extra` bytes of further hash bits of every window."""
    at = t.window_starts(size)
    kind = np.dtype(f"u{extra}")
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, kind)
    h, again = t.word_hash, mix(t.word_hash)
    p = np.uint64(PRIME)
    # words enter each polynomial by bits of their own, under the prime
    a, b, c = (_ROLL[k](reduced(v & p), at, size) for k, v in enumerate((h, h >> np.uint64(31), again)))
    first = mix(a << np.uint64(31) | b)
    if extra == 8:
        c = c << np.uint64(31) | _ROLL[3](reduced(again >> np.uint64(31) & p), at, size)
    return at, first, c.astype(kind)


def covered(t: Texts, at: np.ndarray, hit: np.ndarray, size: int) -> np.ndarray:
    """Which words the windows that start at at[hit] cover."""
    depth = np.zeros(len(t.start) + 1, np.int64)
    depth[at[hit]] += 1
    np.subtract.at(depth, at[hit] + size, 1)
    return np.cumsum(depth[:-1]) > 0


def _pack(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary value per [cuts[i], cuts[i + 1])."""
    raw = values.tobytes()
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int64).tobytes()), pa.py_buffer(raw)])


ENTRY = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("h1", T.BinaryType()), T.StructField("h2", T.BinaryType())])
#: h1: hashes of repeated windows; runs: a text's hash, then first window and number of windows of each run that is repeated.
BACK = T.StructType([T.StructField("id", T.LongType()), T.StructField("h1", T.BinaryType()), T.StructField("runs", T.ArrayType(T.BinaryType()))])


def _repeats(ids: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each window equals one of a smaller or the same id here (one stays out of each class), and whether of a smaller one."""
    order = np.argsort(h1)
    same = h1[order][1:] == h1[order][:-1]
    met = np.zeros(len(h1), bool)
    met[1:] |= same
    met[:-1] |= same
    sub = order[met]
    sub = sub[np.lexsort((ids[sub], h2[sub], h1[sub]))]
    again = np.zeros(len(sub), bool)
    again[1:] = (h1[sub[1:]] == h1[sub[:-1]]) & (h2[sub[1:]] == h2[sub[:-1]])
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(sub))))
    other, late = np.zeros(len(h1), bool), np.zeros(len(h1), bool)
    other[sub] = again
    late[sub] = again & (ids[sub] > ids[sub[head]] if len(sub) else again)
    return other, late


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys."""
    change = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(keys[0])]]).astype(np.int64) if len(keys[0]) else np.zeros(1, np.int64)


def entries(docs: DataFrame, spec: Window, buckets: int, extra: int, id_col: str, text: str) -> DataFrame:
    """(1): rows of a bucket hold ids and hashes in parallel arrays; rows of a negative bucket hold runs of a text known to be repeated."""
    size = spec.window

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        row_id, row_hash = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        count = np.concatenate([x[2] for x in held])
        pos, h1, h2 = (np.concatenate([x[k] for x in held]) for k in (3, 4, 5))
        row = np.repeat(np.arange(len(row_id)), count)
        if (row_id[1:] < row_id[:-1]).any():
            order = np.argsort(row_id[row], kind="stable")
            row, pos, h1, h2 = row[order], pos[order], h1[order], h2[order]
        ids = row_id[row]
        other, late = _repeats(ids, h1, h2)
        # known repeats: runs of neighbouring windows of a row
        r, q = row[late], pos[late]
        order = np.lexsort((q, r))
        r, q = r[order], q[order]
        runs = _cuts(r, q - np.arange(len(q)))
        if len(runs) > 1:
            first, length, owner = q[runs[:-1]], np.diff(runs), r[runs[:-1]]
            at = _cuts(owner)
            rows = owner[at[:-1]]
            blobs = [np.concatenate([row_hash[i : i + 1].view(np.int64), np.stack([first[a:b], length[a:b]], 1).ravel()]).astype("<i8").tobytes() for i, a, b in zip(rows, at[:-1], at[1:], strict=True)]
            none = pa.array([b""] * len(rows), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array((-1 - row_id[rows] % buckets).astype(np.int32)), pa.array(row_id[rows]), none, none, pa.array(blobs, pa.binary())], names=ENTRY.names)
        i, a, b = ids[~other], h1[~other], h2[~other]
        if not len(i):
            return
        group = (a % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
        order = np.argsort(group, kind="stable")
        i, a, b, group = i[order], a[order], b[order], group[order]
        cuts = _cuts(group)
        # ids of a row are sorted: they are held as steps of the least width that fits all of these
        steps = np.diff(i, prepend=i[:1])
        steps[cuts[:-1]] = 0
        width = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if steps.max() <= np.iinfo(k).max)
        yield pa.RecordBatch.from_arrays([pa.array(group[cuts[:-1]].astype(np.int32)), pa.array(i[cuts[:-1]]), *[_pack(x, cuts).cast(pa.binary()) for x in (steps.astype(width), a, b)]], names=ENTRY.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in pieces(batch, "__text"):
                t = Texts(part.column(1))
                at, h1, h2 = window_hashes(t, size, extra)
                doc = t.doc[at]
                held.append((part.column(0).to_numpy(zero_copy_only=False), t.text_hash, np.bincount(doc, minlength=t.n), at - t.word_at[doc], h1, h2))
                n += len(at)
                if n >= BUCKET:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    src = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("__text"))
    return src.mapInArrow(run, ENTRY)


def repeated(sent: DataFrame, buckets: int, extra: int) -> DataFrame:
    """(2): a row per id that has repeated windows: id, h1, and an array of runs.

    A bucket sends one row to each group of ids, not one to each id; the
    groups then take their rows apart.
    """
    kind2 = np.dtype(f"u{extra}")
    groups = max(64, buckets // 16)
    names = ["g", "ids", "counts", "h1", "runs"]

    def packs(ids: np.ndarray, h1: np.ndarray) -> pa.RecordBatch:
        group = ids % groups
        order = np.lexsort((ids, group))
        ids, h1, group = ids[order], h1[order], group[order]
        each = _cuts(ids, group)
        who, count = ids[each[:-1]], np.diff(each)
        rows = _cuts(group[each[:-1]])  # bounds of the groups' rows among ids
        none = pa.array([b""] * (len(rows) - 1), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(who[rows[:-1]] % groups), _pack(who, rows).cast(pa.binary()), _pack(count, rows).cast(pa.binary()), _pack(h1, each[rows]).cast(pa.binary()), none], names=names)

    def bucket(rows: list[tuple[int, bytes, bytes, bytes]]) -> pa.RecordBatch | None:
        h1 = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
        h2 = np.concatenate([np.frombuffer(r[3], kind2) for r in rows])
        ids = np.concatenate([r[0] + np.cumsum(np.frombuffer(r[1], f"u{len(r[1]) * 8 // len(r[2])}").astype(np.int64)) for r in rows])
        _, late = _repeats(ids, h1, h2)
        return packs(ids[late], h1[late]) if late.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            known = batch.filter(pc.less(batch.column(0), 0))
            if n := known.num_rows:
                ids = known.column(1).to_numpy()
                at = np.arange(n + 1)
                none = pa.array([b""] * n, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids % groups), _pack(ids, at).cast(pa.binary()), _pack(np.zeros(n, np.int64), at).cast(pa.binary()), none, known.column(4)], names=names)
            cols = [c.to_pylist() for c in batch.filter(pc.greater_equal(batch.column(0), 0)).columns]
            for b, *row in zip(*cols, strict=True):
                if b != now:
                    if rows and (out := bucket(rows)) is not None:
                        yield out
                    now, rows = b, []
                rows.append(tuple(row))
        if rows and (out := bucket(rows)) is not None:
            yield out

    def merged(rows: list[tuple[bytes, bytes, bytes, bytes]]) -> pa.RecordBatch:
        ids, counts = (np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) for k in (0, 1))
        h1 = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
        owner = np.repeat(ids, counts)
        order = np.argsort(owner, kind="stable")
        owner, h1 = owner[order], h1[order]
        runs: dict[int, list[bytes]] = {}
        for r in rows:
            if r[3]:
                runs.setdefault(int(np.frombuffer(r[0], np.int64)[0]), []).append(r[3])
        who = np.unique(ids)
        cuts = np.searchsorted(owner, np.append(who, np.iinfo(np.int64).max))
        return pa.RecordBatch.from_arrays([pa.array(who), _pack(h1, cuts).cast(pa.binary()), pa.array([runs.get(i, []) for i in who.tolist()], pa.list_(pa.binary()))], names=BACK.names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for g, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != now:
                    if rows:
                        yield merged(rows)
                    now, rows = g, []
                rows.append(tuple(row))
        if rows:
            yield merged(rows)

    sent = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "g long, ids binary, counts binary, h1 binary, runs binary")
    return sent.repartition("g").sortWithinPartitions("g").mapInArrow(merge, BACK)


def _squeezed(src: DataFrame) -> DataFrame:
    """(__key, __text, __row) with the text compressed, as it is about to be shuffled."""
    schema = T.StructType([src.schema["__key"], T.StructField("__zip", T.BinaryType()), src.schema["__row"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in pieces(batch, "__text"):
                data = part.column(1).cast(pa.large_binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else zip_(x) for x in data], pa.binary()), part.column(2)], names=schema.names)

    return src.mapInArrow(run, schema)


def judged(docs: DataFrame, spec: Window = Window(), id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``n_words``, ``n_removed`` and ``kept_sha256`` next to the columns `keep`, or else next to all columns but the text, which comes without removed words as ``kept_text``.

    In ``kept_text`` the remaining words keep the white space between them;
    an interval goes with the white space after it.
    """
    rest = passed_on([c for c in docs.columns if c != text] if keep is None else keep, ("n_words", "n_removed", "kept_sha256", "kept_text"))
    with_text = keep is None
    size = spec.window
    bound_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    buckets, extra = max(1, total // (6 * BUCKET)), extra_bytes(total)
    back = repeated(entries(docs, spec, buckets, extra, id_col, text), buckets, extra).select(F.col("id").alias("__id"), F.col("h1").alias("__h1"), F.col("runs").alias("__runs"))
    src = _squeezed(docs.select(F.col(f"`{id_col}`").cast("long").alias("__key"), F.col(f"`{text}`").cast("string").alias("__text"), F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in rest]).alias("__row")))
    src = src.join(back, F.col("__key") == F.col("__id"), "left").select("__zip", "__h1", "__runs", "__row")
    fields = [src.schema["__row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())]
    schema = T.StructType(fields if with_text else fields[:-1])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches with texts, a few at a time."""
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [None if x is None else unzip(x) for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.large_binary()).cast(pa.large_string()), *part.columns[1:]], names=["__text", "__h1", "__runs", "__row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in plain(batches):
            for part in pieces(batch, "__text"):
                t = Texts(part.column(0))
                gone = np.zeros(len(t.start), bool)
                hashes, runs = part.column(1).to_pylist(), part.column(2).to_pylist()
                flagged = [i for i, x in enumerate(hashes) if x is not None]
                if flagged:
                    at, h1, _ = window_hashes(t, size, extra)
                    lo, hi = np.searchsorted(at, t.word_at[:-1]), np.searchsorted(at, t.word_at[1:])
                    hit = np.zeros(len(at), bool)
                    for i in flagged:
                        want = np.frombuffer(hashes[i], np.uint64)
                        mine = hit[lo[i] : hi[i]]
                        if len(want):
                            mine |= np.isin(h1[lo[i] : hi[i]], want)
                        for x in (np.frombuffer(r, "<i8") for r in runs[i]):
                            if x[0] == t.text_hash[i : i + 1].view(np.int64)[0]:
                                for first, length in x[1:].reshape(-1, 2):
                                    mine[first : first + length] = True
                    gone = covered(t, at, hit, size)
                digests, texts, marked = [], [], set(flagged)
                for i in range(t.n):
                    raw = t.text(i)
                    if i not in marked:
                        digests.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                        texts.append(raw if with_text else b"")
                        continue
                    w = slice(t.word_at[i], t.word_at[i + 1])
                    stay = np.flatnonzero(~gone[w])
                    words = raw.split()
                    digests.append(hashlib.sha256(b" ".join([words[k] for k in stay])).hexdigest())
                    if with_text:
                        texts.append(_without(raw, t.start[w] - t.offsets[i], gone[w]))
                cols = [part.column(3), pa.array(t.n_words.astype(np.int64)), pa.array(t.per_word_sum(gone)), pa.array(digests)]
                if with_text:
                    null = part.column(0).is_null().to_pylist()
                    cols.append(pa.array([None if x else y.decode() for x, y in zip(null, texts, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col("__row")[c].alias(c) for c in rest], *schema.names[1:])


def _without(raw: bytes, start: np.ndarray, gone: np.ndarray) -> bytes:
    """raw without the marked words, each going with the white space after it."""
    if not gone.any():
        return raw
    ends = np.append(start[1:], len(raw))
    change = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    out, at = [], 0
    for a, b in zip(change[::2], change[1::2], strict=True):  # runs of removed words
        out.append(raw[at : start[a]])
        at = int(ends[b - 1])
    out.append(raw[at:])
    return b"".join(out)


def remove_repeats(docs: DataFrame, spec: Window = Window(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated windows cut out of the text."""
    given = {c: f"__{k}" for k, c in enumerate(docs.columns)}
    out = judged(docs.toDF(*given.values()), spec, given[id_col], given[text])
    return out.select(*[F.col("kept_text" if c == text else name).alias(c) for c, name in given.items()])
