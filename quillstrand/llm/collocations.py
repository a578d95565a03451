"""Collocations: phrases of two to ``longest`` words, mined by hierarchical pair naming.

A text is lower-cased (A-Z) and cut into pieces at ``[.,;:!?]`` and line ends
(0x0A to 0x0D), and those into words at spaces and tabs.  All counts are per language.

Words that occur ``least`` times or more get ids.  A phrase of k words is a
pair of adjacent frequent phrases of k - 1 words, one place apart, and is named
by the pair of their ids: pairs are counted over the whole corpus, those that
are frequent get an id of their own, and the ids replace the pairs for the next
level.  The pair of ids that a phrase was made of stays as its two parents, so
prefixes, suffixes and their counts, and which phrase is inside which, are looked up by joins of ids.

Naming is a join in two steps.  Texts are kept as chunks of some megabytes,
each a sequence of numbers of its own distinct phrases.  A chunk's distinct
phrases, with counts, go to the bucket that their hash belongs to; the bucket
adds up what all chunks sent, gives ids, and answers each chunk in the order in
which it asked.  So no occurrence is ever moved alone, and a phrase has at most
one row a chunk, however common it is.  A bucket holds some 65,536 phrases of
all chunks, and there are as many buckets as that asks for.

Scores are whole numbers made by decimals of 38 digits.  Ranks come from counts
of ranges of the order, so no task sees all phrases of a language.

Edge cases: a null language is ``und``; null and blank texts have no words;
very long texts are cut at ends of pieces, and a piece that is longer than a
chunk stays whole; repeated rows count as often as they are there; an empty
table, or one without frequent phrases, gives an empty result; phrases of equal
score and count come in the order of their UTF-8 bytes; a language may hold spaces; other
columns are not read, whatever their names; bytes that are not UTF-8 are words like others and are shown with U+FFFD.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bound_batches, drop_path, materialize, scratch_path
from ._text import byte_hashes, mix, utf8

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
#: An id is its bucket's number, shifted by so many bits, and its place there, from 1.
PLACE = 24
#: Keys are held in two packed columns: of words, lengths and bytes; of pairs, both ids.
CHUNK = "chunk long, n_keys long, seq binary, a binary, b binary, counts binary, langs array<string>, words array<long>"
SENT = "bucket long, chunk long, a binary, b binary, counts binary"
NAMED = "chunk long, bucket long, places binary, id long, left long, right long, lang string, word string, f long"


@dataclass(frozen=True)
class Phrases:
    longest: int = 4
    least: int = 30
    #: a phrase goes if a longer one that holds it has so many percent of its occurrences
    inside: int = 80
    scale: int = 2_000_000
    top: int = 2000
    chunk_bytes: int = 8 << 20
    bucket: int = 1 << 16


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0, byte plane by byte plane, compressed."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(x.max(initial=0)) < 1 << (8 * w))
    planes = np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:9], "little")
    planes = np.frombuffer(pa.decompress(blob[9:], width * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(f"<u{width}").ravel().astype(np.int64)


def record(names: str, rows: list[dict]) -> pa.RecordBatch:
    """Rows in the columns of a schema as Spark writes it."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left.astype(U64)) + right.astype(U64))


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of the hash, so keys in the hash's order are in the buckets' order."""
    return ((hashes >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and whether a piece begins with it."""
    gap = GAP[data]
    edge = np.diff(gap.view(np.int8), prepend=np.int8(1), append=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    breaks = np.cumsum(BREAK[data], dtype=np.int64)
    new = np.ones(len(start), bool)
    new[1:] = breaks[start[1:]] > breaks[end[:-1] - 1]
    return start, end, new


def chunked(langs: list[str], texts: list[bytes], chunk: int) -> dict:
    """The row of a chunk: its words as numbers of its own distinct ones, in the order of their hashes, and those."""
    data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    names, of = np.unique(np.array(langs, object), return_inverse=True)
    start, end, new = tokens(data)
    lang = of[np.searchsorted(begin, start, "right") - 1]
    # two hashes tell words apart within the chunk
    own = mix(byte_hashes(data, start, end, 21) + lang.astype(U64))
    _, first, number, counts = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    if (byte_hashes(data, start, end, 22) != byte_hashes(data, start[first], end[first], 22)[number]).any() or (lang != lang[first][number]).any():
        _, first, number, counts = np.unique(np.stack([own, byte_hashes(data, start, end, 22)], 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    raw, prefix = data.tobytes(), [n.encode() + b" " for n in names]
    keys = [prefix[w] + raw[a:b] for w, a, b in zip(lang[first].tolist(), start[first].tolist(), end[first].tolist(), strict=True)]
    hashes = word_hashes(np.array([len(k) for k in keys], np.int64), np.frombuffer(b"".join(keys), np.uint8))
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    seq = np.zeros(len(start) + int(new.sum()), np.int64)
    seq[np.arange(len(start)) + np.cumsum(new)] = place[number]
    keys = [keys[i] for i in order.tolist()]
    return {
        "chunk": chunk,
        "n_keys": len(keys),
        "seq": pack(seq),
        "a": pack(np.array([len(k) for k in keys], np.int64)),
        "b": pack(np.frombuffer(b"".join(keys), np.uint8)),
        "counts": pack(counts[order]),
        "langs": names.tolist(),
        "words": np.bincount(lang, minlength=len(names)).tolist(),
    }


def word_hashes(size: np.ndarray, data: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return byte_hashes(data, ends - size, ends, 31)


def cut_text(text: bytes, most: int) -> Iterator[bytes]:
    """The text in parts of at most `most` bytes that end where pieces do; a longer piece stays whole."""
    at = 0
    while len(text) - at > most:
        to = max(text.rfind(b, at, at + most) for b in (bytes([x]) for x in np.flatnonzero(BREAK).tolist()))
        if to <= at:
            later = [x for b in np.flatnonzero(BREAK).tolist() if (x := text.find(bytes([b]), at + most)) >= 0]
            if not later:
                break
            to = min(later)
        yield text[at : to + 1]
        at = to + 1
    yield text[at:]


def chunks(docs: DataFrame, spec: Phrases, text: str, lang: str) -> DataFrame:
    """A row for each chunk of texts."""
    src = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, langs, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            at, data = utf8(batch.column(1))
            for own, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for part in cut_text(data[a:b].tobytes(), spec.chunk_bytes):
                    if texts and size + len(part) > spec.chunk_bytes:
                        yield record(CHUNK, [chunked(langs, texts, task << 32 | nth)])
                        nth, langs, texts, size = nth + 1, [], [], 0
                    langs.append(own)
                    texts.append(part)
                    size += len(part) + 1
        if texts:
            yield record(CHUNK, [chunked(langs, texts, task << 32 | nth)])

    return src.mapInArrow(run, CHUNK)


def sent(table: DataFrame, level: int, n_buckets: int) -> DataFrame:
    """What chunks send to buckets: keys in the order of their hashes, and how often each occurs there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b, counts = unpack(row["a"]), unpack(row["b"]), unpack(row["counts"])
                hashes = word_hashes(a, b.astype(np.uint8)) if level == 1 else pair_hashes(a, b)
                bucket = bucket_of(hashes, n_buckets)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
                ends = np.append(0, np.cumsum(a)) if level == 1 else None
                out = []
                for i, j in zip(cuts, [*cuts, len(a)][1:], strict=True):
                    rest = b[ends[i] : ends[j]] if level == 1 else b[i:j]
                    out.append({"bucket": int(bucket[i]), "chunk": row["chunk"], "a": pack(a[i:j]), "b": pack(rest), "counts": pack(counts[i:j])})
                yield record(SENT, out)

    return table.select("chunk", "a", "b", "counts").mapInArrow(run, SENT)


def merged_words(bucket: int, rows: list[dict], least: int) -> list[dict]:
    """Names of a bucket's frequent words, and the answers to its chunks."""
    total: dict[bytes, int] = {}
    asked = []
    for r in rows:
        ends = np.cumsum(unpack(r["a"])).tolist()
        raw = unpack(r["b"]).astype(np.uint8).tobytes()
        keys = [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        asked.append(keys)
        for k, n in zip(keys, unpack(r["counts"]).tolist(), strict=True):
            total[k] = total.get(k, 0) + n
    place = {k: i + 1 for i, k in enumerate(sorted(k for k, n in total.items() if n >= least))}
    out = [{"chunk": r["chunk"], "bucket": bucket, "places": pack(np.array([place.get(k, 0) for k in keys], np.int64))} for r, keys in zip(rows, asked, strict=True)]
    for k, i in place.items():
        lang, _, word = k.rpartition(b" ")
        out.append({"id": bucket << PLACE | i, "lang": lang.decode(), "word": word.decode("utf-8", "replace"), "f": total[k]})
    return out


def merged_pairs(bucket: int, rows: list[dict], least: int) -> list[dict]:
    """Names of a bucket's frequent pairs, and the answers to its chunks."""
    left, right, counts = ([unpack(r[c]) for r in rows] for c in ("a", "b", "counts"))
    cuts = np.cumsum([len(x) for x in left])[:-1]
    left, right, counts = np.concatenate(left), np.concatenate(right), np.concatenate(counts)
    order = np.lexsort((right, left))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)
    at = np.flatnonzero(new)
    f = np.add.reduceat(counts[order], at)
    place = np.where(f >= least, np.cumsum(f >= least), 0)
    answer = np.empty(len(order), np.int64)
    answer[order] = place[np.cumsum(new) - 1]
    out = [{"chunk": r["chunk"], "bucket": bucket, "places": pack(p)} for r, p in zip(rows, np.split(answer, cuts), strict=True)]
    for i in np.flatnonzero(place).tolist():
        k = order[at[i]]
        out.append({"id": bucket << PLACE | int(place[i]), "left": int(left[k]), "right": int(right[k]), "f": int(f[i])})
    return out


def named(rows: DataFrame, level: int, spec: Phrases) -> DataFrame:
    """Names and answers of all buckets."""
    work = merged_words if level == 1 else merged_pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            out = work(bucket, held, spec.least)
            if any(r.get("id", 0) & ((1 << PLACE) - 1) == (1 << PLACE) - 1 for r in out):
                raise ValueError("too many phrases in a bucket")
            yield record(NAMED, out)

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    if held:
                        yield from done()
                    bucket, held = row["bucket"], []
                held.append(row)
        if held:
            yield from done()

    return rows.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, NAMED)


def next_level(chunk: int, seq: np.ndarray, answers: list[tuple[int, np.ndarray]]) -> dict | None:
    """The chunk's pairs of adjacent frequent phrases: numbers of its own distinct ones, in the order of their hashes, and those."""
    ids = np.concatenate([np.zeros(1, np.int64), *[np.where(p > 0, p | b << PLACE, 0) for b, p in answers]])
    small = np.zeros(len(ids), np.int64)
    kept = np.flatnonzero(ids)
    small[kept] = np.arange(1, len(kept) + 1)
    at = small[seq]
    here = np.flatnonzero((at[:-1] > 0) & (at[1:] > 0))
    if not len(here):
        return None
    pair, number, counts = np.unique(at[here] * (len(kept) + 1) + at[here + 1], return_inverse=True, return_counts=True)
    left, right = ids[kept[pair // (len(kept) + 1) - 1]], ids[kept[pair % (len(kept) + 1) - 1]]
    order = np.argsort(pair_hashes(left, right), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    out = np.zeros(len(seq), np.int64)
    out[here] = place[number]
    return {"chunk": chunk, "n_keys": len(order), "seq": pack(out[: here[-1] + 1]), "a": pack(left[order]), "b": pack(right[order]), "counts": pack(counts[order])}


def advanced(table: DataFrame, names: DataFrame) -> DataFrame:
    """The table of the next level: each chunk takes its buckets' answers."""
    asked = table.select("chunk", F.lit(-1).cast("long").alias("bucket"), F.col("seq").alias("data"))
    both = asked.unionByName(names.where("chunk is not null").select("chunk", "bucket", F.col("places").alias("data")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seq, answers = None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            row = next_level(chunk, seq, answers) if answers else None
            if row:
                yield record(CHUNK, [row])

        for batch in batches:
            for own, bucket, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != chunk:
                    if chunk is not None:
                        yield from done()
                    chunk, seq, answers = own, unpack(data), []
                else:
                    answers.append((bucket, unpack(data)))
        if chunk is not None:
            yield from done()

    return both.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(run, CHUNK)


def levels(docs: DataFrame, spec: Phrases, text: str, lang: str) -> tuple[list[DataFrame], DataFrame]:
    """Names of each level, (id, left, right, lang, word, f), and (lang, n), the number of words of each language."""
    spark = docs.sparkSession
    bound_batches(spark)

    def put(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    table, path = put(chunks(docs, spec, text, lang), "phrases-1")
    words = materialize(table.select(F.explode(F.arrays_zip("langs", "words")).alias("w")).groupBy(F.col("w.langs").alias("lang")).agg(F.sum("w.words").alias("n")), "words")
    out = []
    for level in range(1, spec.longest + 1):
        n_keys = table.agg(F.sum("n_keys").alias("n")).first()["n"] or 0
        names, _ = put(named(sent(table, level, max(1, n_keys // spec.bucket)), level, spec), f"names-{level}")
        out.append(names.where("id is not null").select("id", "left", "right", "lang", "word", "f"))
        if level < spec.longest:
            following, next_path = put(advanced(table, names), f"phrases-{level + 1}")
            drop_path(spark, path)  # what comes after reads the next table only
            table, path = following, next_path
    drop_path(spark, path)
    return out, words


def phrases(names: list[DataFrame]) -> list[DataFrame]:
    """Per level (id, lang, phrase, last, f, heads, tails): words, and counts of all prefixes and suffixes, by way of the parents."""
    none = F.array().cast("array<long>")
    out = [materialize(names[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("heads"), none.alias("tails")), "level-1")]
    for level in names[1:]:
        a, b = (out[-1].select(*[F.col(c).alias(f"{side}_{c}") for c in out[-1].columns]) for side in "ab")
        met = level.select("id", "left", "right", "f").join(a, F.col("left") == F.col("a_id")).join(b, F.col("right") == F.col("b_id"))
        heads, tails = F.concat("a_heads", F.array("a_f")), F.concat("b_tails", F.array("b_f"))
        out.append(materialize(met.select("id", F.col("a_lang").alias("lang"), F.concat_ws(" ", "a_phrase", "b_last").alias("phrase"), F.col("b_last").alias("last"), "f", heads.alias("heads"), tails.alias("tails")), "level"))
    return out


def score(k: int, scale: int) -> Column:
    """The lowest-scoring cut of a phrase of k words: (score, cut, l, r)."""
    def cut(i: int) -> Column:
        left, right = F.get("heads", F.lit(i - 1)), F.get("tails", F.lit(k - i - 1))
        wide = lambda c: c.cast("decimal(20,0)")
        whole = F.call_function("div", F.lit(scale).cast("decimal(15,0)") * wide(F.col("f")), wide(left) + wide(right))
        return F.struct(whole.alias("score"), F.lit(i).alias("cut"), left.alias("l"), right.alias("r"))

    return F.array_min(F.array(*[cut(i) for i in range(1, k)]))


def ranked(rows: DataFrame, by: str, order: list[Column], top: int) -> DataFrame:
    """rows with ``rank`` (from 1) within each `by`, as far as `top`: places within ranges of the whole order, and the ranges' counts."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(n, F.col(by), *order).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy(by, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")).where(F.col("__before") < top)
    own = F.row_number().over(Window.partitionBy(by, "__part").orderBy(*order))
    met = dealt.join(sizes, [by, "__part"]).withColumn("rank", (F.col("__before") + own).cast("long"))
    return met.where(F.col("rank") <= top).drop("__part", "__before")


def collocations(docs: DataFrame, spec: Phrases = Phrases(), text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``rank``, ``phrase``, its count ``a``, counts ``l`` and ``r`` of the lowest-scoring cut's parts, the language's words ``n``, and ``score``."""
    names, words = levels(docs, spec, text, lang)
    every, parts = phrases(names), []
    for k in range(2, spec.longest + 1):
        rows = every[k - 1].select("id", "lang", "phrase", "f", score(k, spec.scale).alias("best"))
        if k < spec.longest:
            # a phrase is inside a longer one if it is a parent of one of k + 1 words inside that, which occurs as often at least
            child = names[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            held = F.lit(100).cast("decimal(3,0)") * F.col("longer").cast("decimal(20,0)") >= F.lit(spec.inside).cast("decimal(3,0)") * F.col("f").cast("decimal(20,0)")
            rows = rows.join(child, "id", "left").where(~F.coalesce(held, F.lit(False)))
        parts.append(rows.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.score"))
    kept = functools.reduce(DataFrame.unionByName, parts)
    top = ranked(kept, "lang", [F.desc("score"), F.desc("a"), F.col("phrase")], spec.top)
    return top.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
