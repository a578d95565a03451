"""Chat formatting: transcripts are parsed by a hidden Markov model and rendered canonically.

A transcript comes as rows of text in order; turns may begin at any line of a
row, and rows may be cut anywhere between lines.  Some turns begin with a
speaker marker ("User:", "### Assistant", "[system]", "Kunde:", ...), others do
not.  The hidden states are a role and whether the line opens a turn.  A line
shows a symbol: what its marker says (a known role, one of some classes of
other names, or nothing), whether a blank line of its row comes before it, and
features of its form.  Transitions and emissions are counted from transcripts
whose turns are known.  Viterbi decoding gives each line its state, also where
markers are missing or have names never met, and turns are rendered as
``<|role|>\\n``, its lines and ``<|end|>\\n``.  A marker is cut off only where a turn
opens.  Blank lines at a turn's start and end are left out, as styles differ in them,
and so are those where a turn goes on in another row.  Content cannot forge a mark: between
``<`` and ``|`` it gets a backslash, one more than there were, and ``turns_of`` takes it
out again.  The end mark is no speaker.

Fit and judgement can be kept apart: with ``folds``, a conversation is judged by
tables counted from the conversations of the other folds.

A conversation may be of any length.  Rows are sorted by range, so one that is
long goes over several partitions, and are held in chunks of at most
``Chat.chunk`` rows and ``Chat.most`` bytes (one text is never cut).  Chunks of
conversations that have several are summed up by their best score from every
state to every state; those small matrices are combined inside partitions, then
along conversations, one for each partition, which fixes the states at all
borders; then every chunk is decoded alone.  The result is that of one Viterbi run.

Edge cases: a null or empty text is one empty line; a null place comes first;
rows of the same conversation and place follow each other by text; null
conversation ids are one conversation; repeated rows stay; very long texts are
worked on whole; an empty table gives an empty result; turns of a role that is
none of the three are not counted in fitting; input columns named like the
results are replaced by them; bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches, materialize
from ._text import passed_on, strings

ROLES = ("system", "user", "assistant")
#: What speakers are called.
NAMES = {"system": "system|instructions|context", "user": "user|human|question|q|customer|prompter|me", "assistant": "assistant|ai|bot|answer|a|agent|gpt|model"}
_OPEN, _CLOSE = r"\s*(?:#{1,4}\s*|\[|<\|?|\*\*)?", r"\s*(?:\]|\|?>|\*\*)?\s*(?::\*\*|:|>|(?=\r?$)|(?<=\])|(?<=>))\s*"
MARKER = re.compile(_OPEN + "(?:" + "|".join(f"(?P<{r}>{n})" for r, n in NAMES.items()) + ")" + _CLOSE, re.IGNORECASE)
#: Any other name of one or two words that is followed by a colon or set in marks.
OTHER = re.compile(r"\s*(?:#{1,4}\s*|\*\*|-{1,2}\s*)?(?P<colon>[^\W\d_][\w'-]{0,19}(?: [^\W_][\w'-]{0,19})?)\s*(?:\*\*)?:(?:\*\*)?(?:\s+|$)|\s*(?:\[|<\|?)(?P<mark>[^\W\d_][\w'-]{0,19})(?:\]|\|?>)\s*")
#: Classes of other names.
OTHERS = 12
MARKS = 1 + len(ROLES) + OTHERS
SYMBOLS = MARKS * 2 * 2 * 3 * 2
STATES = [(r, opens) for r in ROLES for opens in (True, False)]
N, START = len(STATES), len(STATES)
END = "<|end|>\n"


@dataclass(frozen=True)
class Chat:
    chunk: int = 256
    most: int = 1 << 20
    folds: int = 1


def marker(line: str) -> tuple[int, str]:
    """What a line's marker says (0: it has none), and the line without it."""
    if (m := MARKER.match(line)) and m.end():
        return next(k + 1 for k, r in enumerate(ROLES) if m[r]), line[m.end() :]
    if line.strip() != END.strip() and (m := OTHER.match(line)):
        return 1 + len(ROLES) + zlib.crc32((m["colon"] or m["mark"]).lower().encode()) % OTHERS, line[m.end() :]
    return 0, line


def symbols(text: str | None) -> tuple[list[int], list[str], list[str]]:
    """Symbols of a text's lines, the lines, and the lines without markers."""
    lines = (text or "").split("\n")
    out, bare, blank = [], [], False
    for line in lines:
        mark, rest = marker(line)
        asks = rest.rstrip().endswith("?")
        size = 0 if len(rest) < 40 else 1 if len(rest) < 200 else 2
        form = bool(re.match(r"\s*(?:[-*•]|\d+[.)]|```|    )", rest))
        out.append((((mark * 2 + blank) * 2 + asks) * 3 + size) * 2 + form)
        bare.append(rest)
        blank = not line.strip()
    return out, lines, bare


def chunks(rows: DataFrame, conv: str, order: str, text: str, chat: Chat, rest: list[str]) -> DataFrame:
    """A row per chunk: its partition, the run of its conversation there, its number in the run, whether it is all
    of its conversation for certain, the conversation and its fold, and the texts and other columns of its rows."""
    bound_batches(rows.sparkSession)
    src = rows.select(F.col(f"`{conv}`").alias("__conv"), F.pmod(F.xxhash64(F.col(f"`{conv}`"), F.lit(3)), F.lit(chat.folds)).cast("int").alias("__fold"), F.col(f"`{order}`").alias("__order"), F.col(f"`{text}`").cast("string").alias("__text"), F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in rest]).alias("__row"))
    src = src.repartitionByRange("__conv", "__order", "__text").sortWithinPartitions("__conv", "__order", "__text").drop("__order")
    kinds = {"part": T.IntegerType(), "run": T.LongType(), "nth": T.LongType(), "whole": T.BooleanType()}
    schema = T.StructType([*[T.StructField(k, t) for k, t in kinds.items()], T.StructField("conv", src.schema["__conv"].dataType), T.StructField("fold", T.IntegerType()), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(src.schema["__row"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        n = size = number = nth = 0
        last = None

        def close(more: bool | None) -> pa.RecordBatch:
            """The held rows; more: whether their conversation goes on, None if that is not known."""
            whole = more is False and nth == 0 and number > 0
            cols = [pa.concat_arrays([h.column(k) for h in held]) for k in (2, 3)]
            lists = [pa.LargeListArray.from_arrays(pa.array([0, n], pa.int64()), c) for c in cols]
            lists = [x.cast(pa.list_(x.type.value_type)) for x in lists]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([nth], pa.int64()), pa.array([whole]), held[0].column(0).slice(0, 1), held[0].column(1).slice(0, 1), *lists], names=schema.names)

        for batch in batches:
            convs = batch.column(0).to_pylist()
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
            at = 0
            for k, (c, s) in enumerate(zip(convs, sizes, strict=True)):
                here = k - at + n
                if here and (c != last or here >= chat.chunk or size + s > chat.most):
                    if k > at:
                        held.append(batch.slice(at, k - at))
                        n += k - at
                    yield close(c == last)
                    number, nth = (number, nth + 1) if c == last else (number + 1, 0)
                    held, n, size, at = [], 0, 0, k
                last = c
                size += s
            if batch.num_rows > at:
                held.append(batch.slice(at))
                n += batch.num_rows - at
        if n:
            yield close(None)

    return materialize(src.mapInArrow(run, schema), "chunks")


def fit(cut: DataFrame, truth: str, folds: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Log transition (the last row is the start's) and emission tables for the conversations of each fold, from `chunks`.

    `truth` is a column of arrays of (role, lines): the turns of a row's text and how many lines they have.
    """
    schema = "fold int, kind int, a int, b int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((folds, 2, N, SYMBOLS), np.int64)
        for batch in batches:
            for fold, texts, rows in zip(batch.column(5).to_pylist(), (x.values for x in batch.column(6)), batch.column(7).to_pylist(), strict=True):
                before = None
                for text, row in zip(strings(texts), rows, strict=True):
                    found = symbols(text)[0]
                    at = 0
                    for turn in row[truth] or ():
                        name, lines = turn["role"], found[at : at + (turn["lines"] or 0)]
                        at += len(lines)
                        if name not in ROLES:
                            before = None
                            continue
                        for k, symbol in enumerate(lines):
                            s = STATES.index((name, k == 0))
                            count[fold, 1, s, symbol] += 1
                            if before is not None:
                                count[fold, 0, before, s] += 1
                            before = s
        fold, kind, a, b = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (fold, kind, a, b)), pa.array(count[fold, kind, a, b])], names=["fold", "kind", "a", "b", "n"])

    counts = np.zeros((folds, 2, N, SYMBOLS))
    for r in cut.mapInArrow(run, schema).groupBy("fold", "kind", "a", "b").agg(F.sum("n").alias("n")).collect():  # a few hundred rows for each fold
        counts[r["fold"], r["kind"], r["a"], r["b"]] += r["n"]
    if folds > 1:
        counts = counts.sum(0) - counts
    return [_tables(c[0, :, :N], c[1]) for c in counts]


def _tables(move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    move = move + 0.5
    for i, (role_i, _) in enumerate(STATES):  # a line inside a turn has the role of the line before
        for j, (role_j, opens) in enumerate(STATES):
            if not opens and role_i != role_j:
                move[i, j] = 1e-9
    start = np.array([1.0 if opens else 1e-9 for _, opens in STATES])
    # little is known of rare names: what a marker is, and what the line is like, are counted apart
    by_mark = emit.reshape(N, MARKS, -1)
    mark, form = by_mark.sum(2) + 0.05, by_mark + 0.05
    form[:, 1 + len(ROLES) :] = form[:, 1 + len(ROLES) :].sum(1, keepdims=True)
    form /= form.sum(2, keepdims=True)
    joint = (mark[:, :, None] * form).reshape(N, -1)
    return tuple(np.log(x / x.sum(1, keepdims=True)) for x in (np.vstack([move, start]), joint))


def _sum_of(found: list[int], tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Best scores over a chunk from the state before it (START included) to that at its end, and the first state on the way."""
    move, emit = tables
    m = move + emit[:, found[0]][None, :]
    first = np.tile(np.arange(N), (N + 1, 1))
    for s in found[1:]:
        m, first = _joined(m, first, move[:N] + emit[:, s][None, :])
    return m, first


def _joined(m: np.ndarray, first: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Max-plus product, and the first states of the best ways."""
    total = m[:, :, None] + then[None, :, :]
    best = total.argmax(1)
    return total.max(1), np.take_along_axis(first, best, 1)


SUMS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("nth", T.LongType()), T.StructField("m", T.ArrayType(T.DoubleType())), T.StructField("first", T.ArrayType(T.IntegerType()))])
BORDERS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("nth", T.LongType()), T.StructField("enter", T.IntegerType()), T.StructField("leave", T.IntegerType()), T.StructField("closes", T.BooleanType())])


def solve(sums: list[tuple[np.ndarray, np.ndarray]], enter: int | None = None, leave: int | None = None, closes: bool = True) -> list[tuple[int, int, bool]]:
    """For parts of a conversation in order: the state before and at the end of each, and whether a turn closes there."""
    score = np.where(np.arange(N + 1) == (START if enter is None else enter), 0.0, -np.inf)
    trail = []
    for m, _ in sums:
        total = score[:, None] + m[: len(score)]
        score = total.max(0)
        trail.append(total.argmax(0))
    at, out = int(score.argmax()) if leave is None else leave, []
    for k in range(len(sums) - 1, -1, -1):
        before = int(trail[k][at])
        out.append((before, at, closes))
        closes, at = STATES[int(sums[k][1][before, at])][1], before
    return out[::-1]


def _pair(m: list[float], first: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array(m).reshape(N + 1, N), np.array(first).reshape(N + 1, N)


def _grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows in groups of equal first `width` columns, which come together."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:width] != key:
                yield key, rows
                rows = []
            key = row[:width]
            rows.append(row[width:])
    if rows:
        yield key, rows


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.BooleanType: pa.bool_()}
    arrays = []
    for k, f in enumerate(schema.fields):
        kind = pa.list_(pa.float64() if isinstance(f.dataType.elementType, T.DoubleType) else pa.int32()) if isinstance(f.dataType, T.ArrayType) else kinds[type(f.dataType)]
        arrays.append(pa.array([r[k] for r in rows], kind))
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def borders(cut: DataFrame, tables: list[tuple]) -> DataFrame:
    """(part, run, nth, enter, leave, closes) of the chunks that may not be all of their conversation."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, number, nth, fold, texts in zip(*(batch.column(k).to_pylist() for k in range(4)), (x.values for x in batch.column(4)), strict=True):
                m, first = _sum_of([s for t in strings(texts) for s in symbols(t)[0]], tables[fold])
                out.append((part, number, nth, m.ravel().tolist(), first.ravel().tolist()))
            yield _batch(out, SUMS)

    several = cut.where("not whole")
    small = materialize(several.select("part", "run", "nth", "fold", "texts").mapInArrow(sums, SUMS), "sums")

    def in_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _grouped(batches, 2):
            m, first = _pair(*rows[0][1:])
            for row in rows[1:]:
                m, first = _joined(m, first, _pair(*row[1:])[0][:N])
            yield _batch([(*key, 0, m.ravel().tolist(), first.ravel().tolist())], SUMS)

    # a partition's share of one conversation: chunks of `chunk` rows, one small matrix each
    ordered = small.repartition("part", "run").sortWithinPartitions("part", "run", "nth")
    names = several.where("nth = 0").select("part", "run", "conv")
    shares = ordered.mapInArrow(in_part, SUMS).drop("nth").join(names, ["part", "run"])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 1):
            found = solve([_pair(*r[2:]) for r in rows])
            yield _batch([(*r[:2], 0, *f) for r, f in zip(rows, found, strict=True)], BORDERS)

    # along a conversation: one matrix for each partition that has a part of it
    shares = shares.select("conv", "part", "run", "m", "first").repartition("conv").sortWithinPartitions("conv", "part", "run")
    shares = materialize(shares.mapInArrow(along, BORDERS).drop("nth"), "shares")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _grouped(batches, 5):
            found = solve([_pair(*r[1:]) for r in rows], *key[2:])
            yield _batch([(*key[:2], r[0], *f) for r, f in zip(rows, found, strict=True)], BORDERS)

    met = small.join(shares, ["part", "run"]).select("part", "run", "enter", "leave", "closes", "nth", "m", "first")
    return materialize(met.repartition("part", "run").sortWithinPartitions("part", "run", "nth").mapInArrow(inside, BORDERS), "borders")


def decode_path(found: list[int], tables: tuple, enter: int, leave: int | None) -> list[int]:
    """States of the lines of a chunk, given the state before it and, if it is fixed, that at its end."""
    move, emit = tables
    score, trail = move[enter] + emit[:, found[0]], []
    for s in found[1:]:
        total = score[:, None] + move[:N]
        trail.append(total.argmax(0))
        score = total.max(0) + emit[:, s]
    path = [int(score.argmax()) if leave is None else leave]
    for t in reversed(trail):
        path.append(int(t[path[-1]]))
    return path[::-1]


def escaped(line: str) -> str:
    """The line with one more backslash in every ``<|``, ``<\\|`` and so on, so that none is a mark."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", line)


def turns_of(text: str) -> list[tuple[str, str]]:
    """Role and content of the turns of a canonical text."""
    found = re.findall(r"<\|(" + "|".join(ROLES) + r")\|>\n(.*?)<\|end\|>\n", text, re.DOTALL)
    return [(role, re.sub(r"<\\(\\*)\|", r"<\1|", content).removesuffix("\n")) for role, content in found]


def rendered(lines: list[str], bare: list[str], path: list[int], closes: bool) -> str:
    """Lines with their states; closes: whether the line after them opens a turn, or there is none."""
    out, own = [], []  # own: the lines of one turn

    def put() -> None:
        full = [k for k, line in enumerate(own) if line.strip()]
        if full:
            out.extend(escaped(line) + "\n" for line in own[full[0] : full[-1] + 1])
        own.clear()

    for k, s in enumerate(path):
        role, opens = STATES[s]
        if opens:
            put()
            out.append(f"<|{role}|>\n")
        own.append(bare[k] if opens else lines[k])
        if STATES[path[k + 1]][1] if k + 1 < len(path) else closes:
            put()
            out.append(END)
    put()
    return "".join(out)


def judged(cut: DataFrame, tables: list[tuple], rest: list[str]) -> DataFrame:
    """The rows of `chunks` with their columns `rest`, ``roles`` (of the turns that open there), ``role`` (of the first line) and ``rendered``."""
    fixed = borders(cut, tables)
    on = ["part", "run", "nth"]
    # borders are few, and broadcast if their files are small; texts are dealt out again only if not
    met = cut.join(fixed, on, "left").select("fold", "texts", "rows", "enter", "leave", "closes")
    row = cut.schema["rows"].dataType.elementType
    schema = T.StructType([T.StructField("__row", row), T.StructField("role", T.StringType()), T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("rendered", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                fold, enter, leave, closes = (batch.column(c)[k].as_py() for c in (0, 3, 4, 5))
                own = [symbols(t) for t in strings(batch.column(1)[k].values)]
                path = decode_path([s for found, _, _ in own for s in found], tables[fold], START if enter is None else enter, leave)
                out, at = [], 0
                for found, lines, bare in own:
                    mine, at = path[at : at + len(found)], at + len(found)
                    ends = STATES[path[at]][1] if at < len(path) else closes is not False
                    out.append((STATES[mine[0]][0], [STATES[s][0] for s in mine if STATES[s][1]], rendered(lines, bare, mine, ends)))
                yield pa.RecordBatch.from_arrays([batch.column(2)[k].values, *(pa.array([o[c] for o in out], t) for c, t in enumerate((pa.string(), pa.list_(pa.string()), pa.string())))], names=schema.names)

    out = met.mapInArrow(run, schema)
    return out.select(*[F.col("__row")[c].alias(c) for c in rest], "role", "roles", F.size("roles").cast("long").alias("turns"), "rendered")


def formatted(rows: DataFrame, tables: list[tuple], conv: str = "conv_id", order: str = "turn", text: str = "text", chat: Chat = Chat(), keep: list[str] | None = None) -> DataFrame:
    """rows (or the columns `keep`) with ``role``, ``roles``, ``turns`` and ``rendered``.

    The ``rendered`` texts of a conversation, put after each other in order, are its canonical form.
    """
    rest = passed_on(rows.columns if keep is None else keep, ("role", "roles", "turns", "rendered"))
    return judged(chunks(rows, conv, order, text, chat, rest), tables, rest)


def fitted(rows: DataFrame, truth: str, conv: str = "conv_id", order: str = "turn", text: str = "text", chat: Chat = Chat()) -> list[tuple]:
    """Tables counted from rows whose turns are known (see `fit`), for each fold."""
    return fit(chunks(rows, conv, order, text, chat, [truth]), truth, chat.folds)


def transcripts(rows: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", turns: int = 3, every: int = 5) -> DataFrame:
    """Raw transcripts of turns of known roles: conv, order (of the first turn), text and ``truth``.

    `turns` places in a row make one text.  A conversation has one of six styles
    of markers, two of which have names of their own, and one turn in `every`
    has no marker; half of the conversations put a blank line after each turn.
    """
    c, o, r = F.col(f"`{conv}`"), F.col(f"`{order}`"), F.coalesce(F.col(f"`{role}`"), F.lit("none"))
    name = F.initcap(r)
    # Names of speakers that the parser does not know
    own = lambda a, b, x: F.when(r == "user", a).when(r == "assistant", b).otherwise(x)
    styles = [F.concat(name, F.lit(": ")), F.concat(F.lit("### "), name, F.lit(":\n")), F.concat(F.lit("["), r, F.lit("] ")), F.concat(F.lit("**"), name, F.lit(":** ")), F.concat(own("Kunde", "Berater", "Regie"), F.lit(": ")), F.concat(F.lit("<"), own("alice", "bob", "chair"), F.lit("> "))]
    style = F.pmod(F.xxhash64(c), F.lit(len(styles)))
    mark = F.coalesce(*[F.when(style == k, s) for k, s in enumerate(styles)])
    mark = F.when(F.pmod(F.xxhash64(c, o), F.lit(every)) == 0, F.lit("")).otherwise(mark)
    blank = F.when(F.pmod(F.xxhash64(c, F.lit(1)), F.lit(2)) == 0, F.lit("\n")).otherwise(F.lit(""))
    said = F.concat(mark, F.coalesce(F.col(f"`{text}`"), F.lit("")), blank)
    # rows without a place stand alone; a group has the rows of `turns` places, and as many of each as the input repeats
    place = F.coalesce(F.floor(o / turns), F.lit(-1) - F.pmod(F.xxhash64(said), F.lit(1 << 40)))
    turn = F.struct(o.alias("at"), said.alias("said"), r.alias("role"))
    grouped = rows.groupBy(c.alias(conv), place.alias("__place")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    lines = F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.size(F.split(x["said"], "\n")).alias("lines")))
    return grouped.select(conv, F.col("t")[0]["at"].alias(order), F.array_join(F.transform("t", lambda x: x["said"]), "\n").alias(text), lines.alias("truth"))
