"""Vectorised words, lines and hashes over Arrow string columns.

A word is a maximal run of bytes other than the six ASCII white-space bytes
(space and 0x09 to 0x0D).  Byte strings are hashed eight bytes at a time, each
step a bijective mix of what is there so far, so that equal lengths of up to
eight bytes never collide and longer ones do by chance only; no input is
special, as it would be to a polynomial modulo a power of two.  Windows of
words are hashed by polynomials modulo the prime 2**31 - 1 over several
independent bases.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PRIME = (1 << 31) - 1
#: Byte strings longer than this are hashed one by one.
LONG = 64
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (two xor-shift-multiply rounds)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(31)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the byte strings data[start:end], whatever their place."""
    size = end - start
    h = mix(size.astype(U64) + U64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    if not len(data):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left, own = start[live], size[live], h[live]
    while len(live):
        own = mix(own ^ (eight[at] & _LOW[np.minimum(left, 8)]))
        done = left <= 8
        if done.any():
            h[live[done]] = own[done]
            on = ~done
            live, at, left, own = live[on], at[on], left[on], own[on]
        at, left = at + 8, left - 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]], seed)
    return h


class Powers:
    """Powers of a base and of its inverse modulo PRIME, kept per process."""

    def __init__(self, seed: int) -> None:
        self.base = int(np.random.default_rng(seed).integers(1 << 20, PRIME - 1))
        self.up = self.down = np.ones(1, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = n * 9 // 8
            for name, base in (("up", self.base), ("down", pow(self.base, -1, PRIME))):
                out = np.ones(n, U64)
                filled = 1
                while filled < n:  # out[i] = base ** i, by doubling
                    more = min(filled, n - filled)
                    out[filled : filled + more] = reduced(out[:more] * U64(pow(base, filled, PRIME)))
                    filled += more
                setattr(self, name, out)
        return self.up, self.down


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x under 2**62."""
    p = U64(PRIME)
    x = (x & p) + (x >> U64(31))
    return np.where(x >= p, x - p, x)


class Rolling:
    """Rabin-Karp hashes modulo PRIME of windows over values under PRIME."""

    def __init__(self, seed: int) -> None:
        self.powers = Powers(seed)

    def __call__(self, values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of values[i : i + size] for i in at, whatever their place."""
        up, down = self.powers(len(values) + 1)
        total = np.zeros(len(values) + 1, U64)
        # terms under 2**31: sums of 2**32 of them fit
        np.cumsum(reduced(values * up[: len(values)]), out=total[1:])
        return reduced(reduced(total[at + size] - total[at]) * down[at])


def passed_on(columns: list[str], own: tuple[str, ...]) -> list[str]:
    """Input columns that go into the output: those that have no name of an operator's own column."""
    taken = {c.lower() for c in own}
    return [c for c in columns if c.lower() not in taken]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8) if offs is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def strings(column: pa.Array) -> list[str | None]:
    """Values of a string column; bytes that are not UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each; one long text stays whole."""
    if not batch.num_rows:
        return
    offsets, _ = utf8(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Texts:
    """Words and lines of the texts of one slice."""

    def __init__(self, column: pa.Array) -> None:
        self.offsets, self.data = utf8(column)
        self.n = len(self.offsets) - 1
        inside = ~SPACE[self.data]
        before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[self.offsets[:-1][self.offsets[:-1] < len(inside)]] = False
        after[self.offsets[1:][self.offsets[1:] > 0] - 1] = False
        self.inside = inside
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: words of text i are those from word_at[i] to word_at[i + 1]
        self.word_at = np.searchsorted(self.start, self.offsets)
        self.n_words = np.diff(self.word_at)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    @cached_property
    def word_hash(self) -> np.ndarray:
        return byte_hashes(self.data, self.start, self.end, 11)

    @cached_property
    def text_hash(self) -> np.ndarray:
        return byte_hashes(self.data, self.offsets[:-1], self.offsets[1:], 13)

    def window_starts(self, size: int) -> np.ndarray:
        """Indices of words at which a window of `size` words of one text starts."""
        n = len(self.start)
        if n < size:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: n - size + 1] == self.doc[size - 1 :])

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-byte array over each text."""
        return sums(flags, self.offsets)

    def per_word_sum(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-word array over each text."""
        return sums(flags, self.word_at)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and end of every line that has a word, split at line feeds."""
        cuts = np.flatnonzero(self.data == 0x0A)
        start = np.unique(np.concatenate([self.offsets[:-1], cuts + 1]))
        start = start[start < len(self.data)]
        if not len(start):
            return start, start, start
        doc = np.searchsorted(self.offsets, start, "right") - 1
        end = np.append(cuts, len(self.data))[np.searchsorted(cuts, start, "left")]
        end = np.minimum(end, self.offsets[doc + 1])
        has = np.searchsorted(self.start, end) > np.searchsorted(self.start, start)
        return doc[has], start[has], end[has]


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def repeats_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per key: whether it occurs twice or more; whether it is counted as a repeat, which one of each class is not."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    many[order[1:][same]] = many[order[:-1][same]] = True
    later[order[1:][same]] = True
    return many, later
