"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The model's pieces are merged by an agenda: the adjacent pair whose piece has
the best score (leftmost on ties) is merged first.  With dropout, a candidate
that comes off the agenda is skipped if the keyed hash of (draw, pair, place)
falls under the dropout rate; it may come back when a neighbour changes.  Every
occurrence of a word has a draw of its own, a keyed hash of the seed, the
document and the word's place in it, so there is no bound to the ways in which
a word is cut, and no random state: any executor, and any retry, gives the same
ids.  Rate 0 gives the model's own segmentation.

Merges never cross from a word into the white space after it (no piece has a
space mark after another character; this is checked on loading), so words are
encoded one by one.  What is kept of a word is the tree of its agenda's
decisions: a node is a candidate, its children are what follows if it is merged
or skipped, a leaf has the ids.  All occurrences of a slice walk their trees
together, each by its own draw; trees and branches grow when several take them
at once, and are dropped when they have too many leaves.  Occurrences that find
no tree, or no branch, run their agendas together, row by row.

Decoding is lossless: characters without a piece become byte pieces, and so
does the space mark itself where the text has it.

Edge cases: a null text has null ids, an empty one has none; texts may be of
any length, and words too; rows with the same or a null id are coded one by
one, with the same draws; an empty table gives an empty result; input columns
named like the results are replaced by them; bytes that are not UTF-8 count as
U+FFFD.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches
from ._text import passed_on, pieces, strings

MARK = "▁"
_ALL, _NONE, _ODD, _MIX = 2**64 - 1, 1 << 40, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
#: Characters of a chunk that is too long for the cache.
LONG = 64
#: A run of marks with the word after it.
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass(frozen=True)
class Dropout:
    rate: float = 0.1
    seed: int = 0


def skip_hash(x):
    """64-bit hash of a draw's key xor a candidate's code; for integers and arrays alike."""
    if isinstance(x, int):
        x = (x ^ x >> 32) * _ODD & _ALL
        x = (x ^ x >> 29) * _MIX & _ALL
        return x ^ x >> 32
    x = (x ^ x >> np.uint64(32)) * np.uint64(_ODD)
    x = (x ^ x >> np.uint64(29)) * np.uint64(_MIX)
    return x ^ x >> np.uint64(32)


class Codec:
    """Encoder and decoder for a BPE model with byte pieces."""

    #: Leaves at which the trees are dropped.
    LEAVES = 1 << 19
    #: Occurrences that make a tree, or a branch, grow.
    MANY = 3

    def __init__(self, model: str, dropout: Dropout) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.id = {p: i for i, p in enumerate(self.piece) if i not in special}
        order = sorted(self.id, key=lambda p: (-sp.get_score(self.id[p]), self.id[p]))
        self.rank = {p: k for k, p in enumerate(order)}
        #: The same as arrays: symbols are ids; every way to make a piece of two symbols.
        self.rank_id = np.array([self.id[p] for p in order])
        singles = sorted((ord(p), i) for p, i in self.id.items() if len(p) == 1)
        self.chars, self.char_id = (np.array(x, np.int64) for x in zip(*singles, strict=True))
        pairs = sorted((self.id[p[:i]] << 20 | self.id[p[i:]], k) for p, k in self.rank.items() for i in range(1, len(p)) if p[:i] in self.id and p[i:] in self.id)
        self.pair_key, self.pair_rank = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.bytes_id = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if sp.is_byte(i)}
        byte_of = {i: b for b, i in self.bytes_id.items()}
        self.marks = tuple(self.bytes_id[b] for b in MARK.encode())
        #: What each id stands for.
        raw = [bytes((byte_of[i],)) if i in byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.piece)]
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array(list(map(len, raw)))
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        if len(self.bytes_id) != 256:
            raise ValueError("the model lacks byte pieces, so not every text could be decoded")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id):
            raise ValueError("pieces of the model cross from a word into the next space")
        self.dropout = dropout
        self.limit = int(dropout.rate * 2**64)
        self._drop_trees()

    def skips(self, key: int, rank: int, at: int) -> bool:
        """Whether the candidate of that piece rank, starting at that character, is dropped."""
        return skip_hash(key ^ (rank << 20) ^ at) < self.limit

    def merge(self, word: str, variant: int) -> list[str]:
        """Pieces of one chunk for an occurrence's number, by agenda: least rank first, leftmost on ties."""
        key = int(self.draws(np.array([variant], np.uint64))[0])
        return self._merge_long(word, key) if len(word) > LONG else self._merge_short(word, key)

    def _merge_short(self, word: str, key: int) -> list[str]:
        """The agenda as a plain list, which is faster for a few characters."""
        rank, none, limit = self.rank.get, _NONE, self.limit
        part = list(word)
        at = list(range(len(part)))
        agenda = [rank(a + b, none) for a, b in zip(part, part[1:])]
        while agenda and (best := min(agenda)) < none:
            i = agenda.index(best)
            if limit and skip_hash(key ^ (best << 20) ^ at[i]) < limit:
                agenda[i] = none
                continue
            both = part[i] + part[i + 1]
            part[i : i + 2] = (both,)
            del at[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = rank(both + part[i + 1], none)
            if i:
                agenda[i - 1] = rank(part[i - 1] + both, none)
        return part

    def _merge_long(self, word: str, key: int) -> list[str]:
        """The agenda as a heap."""
        part = list(word)
        end = len(part)
        left, right = list(range(-1, end - 1)), list(range(1, end + 1))
        agenda: list[tuple[int, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            both = part[i] + part[j]
            if (r := self.rank.get(both)) is not None:
                heapq.heappush(agenda, (r, i, j, both))

        for i in range(end - 1):
            offer(i, i + 1)
        while agenda:
            r, i, j, both = heapq.heappop(agenda)
            # stale, if one of the two has been merged meanwhile
            if not part[i] or right[i] != j or part[i] + part[j] != both:
                continue
            if self.limit and self.skips(key, r, i):
                continue
            part[i], part[j] = both, ""
            right[i] = right[j]
            if right[j] < end:
                left[right[j]] = i
                offer(i, right[j])
            if left[i] >= 0:
                offer(left[i], i)
        return [p for p in part if p]

    def draws(self, variants: np.ndarray) -> np.ndarray:
        """The key of the skip hash for each occurrence's number."""
        x = variants + np.uint64((self.dropout.seed * _ODD + _ODD) & _ALL)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def _drop_trees(self) -> None:
        self.roots: dict[str, int] = {}
        self.n_nodes = 0
        self.code = np.zeros(1 << 12, np.uint64)  # the candidate, as the skip hash takes it
        self.child = np.full(1 << 13, -1, np.int64)  # of node i: 2 i if merged, 2 i + 1 if skipped
        self.leaf = np.full(1 << 12, -1, np.int64)
        self.parent: list[tuple[int, int]] = []  # node and decision
        self.root_word: dict[int, str] = {}
        self.leaf_ids: list[tuple[int, ...]] = []
        #: The same after each other, with their places and sizes.
        self.leaf_flat = self.leaf_at = self.leaf_size = np.zeros(0, np.int64)

    def _node(self, parent: int, skipped: int) -> int:
        i = self.n_nodes
        if i == len(self.code):
            self.code = np.concatenate([self.code, np.zeros(i, np.uint64)])
            self.child = np.concatenate([self.child, np.full(2 * i, -1, np.int64)])
            self.leaf = np.concatenate([self.leaf, np.full(i, -1, np.int64)])
        self.n_nodes += 1
        self.parent.append((parent, skipped))
        if parent >= 0:
            self.child[2 * parent + skipped] = i
        return i

    def _grow(self, parent: int, skipped: int, word: str = "") -> int:
        """The node that follows a decision (or the root of a word), with all that follows if nothing more is skipped."""
        path = []
        at_node, decision = parent, skipped
        while at_node >= 0:
            path.append(decision)
            top = at_node
            at_node, decision = self.parent[at_node]
        if parent >= 0:
            word = self.root_word[top]
        path.reverse()
        rank, none = self.rank.get, _NONE
        part = list(word)
        at = list(range(len(part)))
        agenda = [rank(a + b, none) for a, b in zip(part, part[1:])]
        first = node = -1
        k = 0
        while agenda and (best := min(agenda)) < none:
            i = agenda.index(best)
            skip = 0
            if k < len(path):
                skip = path[k]
            else:
                node = self._node(parent, skipped) if node < 0 else self._node(node, 0)
                first = node if first < 0 else first
                self.code[node] = (best << 20) ^ at[i]
            k += 1
            if skip:
                agenda[i] = none
                continue
            both = part[i] + part[i + 1]
            part[i : i + 2] = (both,)
            del at[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = rank(both + part[i + 1], none)
            if i:
                agenda[i - 1] = rank(part[i - 1] + both, none)
        node = self._node(parent, skipped) if node < 0 else self._node(node, 0)
        first = node if first < 0 else first
        self.leaf[node] = len(self.leaf_ids)
        self.leaf_ids.append(self._ids(part))
        if parent < 0:
            self.roots[word] = first
            self.root_word[first] = word
        return first

    def _walk(self, node: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The leaves that occurrences reach from their words' roots, by their keys; -1 if the way is not grown."""
        out = np.full(len(node), -1, np.int64)
        row = np.arange(len(node))
        limit, none_skipped = np.uint64(min(self.limit, _ALL)), not self.limit
        while len(row):
            leaf = self.leaf[node]
            end = leaf >= 0
            out[row[end]] = leaf[end]
            on = ~end
            row, node, key = row[on], node[on], key[on]
            skipped = np.zeros(len(row), bool) if none_skipped else skip_hash(key ^ self.code[node]) < limit
            branch = 2 * node + skipped
            node = self.child[branch]
            new = node < 0
            if new.any():
                wanted, n = np.unique(branch[new], return_counts=True)
                for b in wanted[n >= self.MANY].tolist():
                    self._grow(b >> 1, b & 1)
                node = self.child[branch]
                on = node >= 0
                row, node, key = row[on], node[on], key[on]
        return out

    def _ids(self, parts: list[str]) -> tuple[int, ...]:
        find, out = self.id.get, []
        for p in parts:
            i = find(p)
            if i is not None:
                out.append(i)
            else:
                out.extend([self.bytes_id[b] for b in p.encode()])
        return tuple(out)

    def merge_all(self, words: list[str], which: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Agendas of words[w] for w in which, by their keys, many at a time: ids after each other, and where each one's begin and how many they are.

        A row of an array is a chunk; its symbols keep the place of their first
        character, and each round takes the best candidate of every row.
        A character that is no piece is a symbol under -1, which merges with
        nothing and becomes bytes.  Long chunks go one by one.
        """
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        at = np.cumsum(size) - size
        place = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        symbols = np.where(self.chars[place] == codes, self.char_id[place], -2 - codes)
        flat, start, n = [], np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        done = 0
        own = size[which]
        plain = own <= LONG
        for low, width in ((0, 8), (8, 16), (16, LONG)):
            some = np.flatnonzero(plain & (own > low) & (own <= width))
            for k in range(0, len(some), 1 << 15):
                part = some[k : k + (1 << 15)]
                ids, count = self._with_bytes(*self._merge_rows(ragged(symbols, at, size, which[part]), own[part], keys[part], width))
                flat.append(ids)
                start[part], n[part] = done + np.cumsum(count) - count, count
                done += len(ids)
        for i in np.flatnonzero(~plain).tolist():
            w = words[which[i]]
            ids = np.array(self._ids((self._merge_long if len(w) > LONG else self._merge_short)(w, int(keys[i]))), np.int64)
            flat.append(ids)
            start[i], n[i] = done, len(ids)
            done += len(ids)
        return np.concatenate([np.zeros(0, np.int64), *flat]), start, n

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that two symbols make, or _NONE."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], _NONE)

    def _merge_rows(self, symbols: np.ndarray, size: np.ndarray, seeds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, whose characters' ids come after each other, and how many each has."""
        sym = np.full((len(size), width), -1, np.int64)
        sym[np.arange(width)[None, :] < size[:, None]] = symbols
        rows, last = np.arange(len(sym)), width
        after = np.tile(np.arange(1, width + 1), (len(sym), 1))
        after[rows, size - 1] = last
        before = np.tile(np.arange(-1, width - 1), (len(sym), 1))
        agenda = np.full((len(sym), width), _NONE, np.int64)
        both = (sym[:, :-1] >= 0) & (sym[:, 1:] >= 0)
        agenda[:, :-1][both] = self._pair(sym[:, :-1][both], sym[:, 1:][both])
        while len(rows):
            at = agenda[rows].argmin(1)  # the leftmost of the best
            best = agenda[rows, at]
            live = best < _NONE
            rows, at, best = rows[live], at[live], best[live]
            if self.limit:
                drop = skip_hash(seeds[rows] ^ (best.astype(np.uint64) << np.uint64(20)) ^ at.astype(np.uint64)) < np.uint64(min(self.limit, _ALL))
                agenda[rows[drop], at[drop]] = _NONE
                r, i, best = rows[~drop], at[~drop], best[~drop]
            else:
                r, i = rows, at
            j = after[r, i]
            k = after[r, j]
            sym[r, i] = self.rank_id[best]
            sym[r, j] = -1
            agenda[r, j] = _NONE
            after[r, i] = k
            ends = k == last
            agenda[r[ends], i[ends]] = _NONE
            on = ~ends
            before[r[on], k[on]] = i[on]
            agenda[r[on], i[on]] = self._pair(sym[r[on], i[on]], sym[r[on], k[on]])
            b = before[r, i]
            on = b >= 0
            agenda[r[on], b[on]] = self._pair(sym[r[on], b[on]], sym[r[on], i[on]])
        alive = sym != -1
        return sym[alive], alive.sum(1)

    def _with_bytes(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many each chunk has, with the bytes of characters that are no pieces in their place."""
        strange = ids < -1
        if not strange.any():
            return ids, count
        found, which = np.unique(ids[strange], return_inverse=True)
        raw = [[self.bytes_id[b] for b in chr(-2 - c).encode("utf-8", "surrogatepass")] for c in found.tolist()]
        size = np.ones(len(ids), np.int64)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        size[strange] = lengths[which]
        out = np.repeat(ids, size)
        out[np.repeat(strange, size)] = ragged(np.array(list(chain.from_iterable(raw))), np.cumsum(lengths) - lengths, lengths, which)
        return out, np.bincount(np.repeat(np.arange(len(count)), count), size, len(count)).astype(np.int64)

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text; the empty one is a mark of the text's own."""
        out: list[str] = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                out.append("")
            out += CHUNK.findall((part if k else " " + part).replace(" ", MARK))
        return out

    def variants(self, n: int, key: int | str) -> np.ndarray:
        """Numbers of a document's n words: a keyed 64-bit start with a step for each word, so that no two occurrences share a draw."""
        if not self.limit:
            return np.zeros(n, np.uint64)
        # draws() mixes this
        return np.uint64(xxhash.xxh64_intdigest(str(key).encode(), self.dropout.seed)) + np.arange(n, dtype=np.uint64) * np.uint64(_ODD)

    def encode(self, text: str, key: int | str = 0) -> list[int]:
        """Ids of a text; key tells documents apart for dropout."""
        return self.encode_all([text], [key])[0].tolist()

    def encode_all(self, texts: list[str], keys: list[int | str]) -> list[np.ndarray]:
        """Ids of several texts, put together by place."""
        if len(self.leaf_ids) > self.LEAVES:
            self._drop_trees()
        own, numbers, bounds = [], [], [0]
        for t, k in zip(texts, keys, strict=True):
            some = self.chunks(t) if t else []
            own += some
            numbers.append(self.variants(len(some), k))
            bounds.append(len(own))
        if not own:
            return [np.zeros(0, np.int64)] * len(texts)
        coded = pa.array(own, pa.string()).dictionary_encode()
        words, at_word, key = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), self.draws(np.concatenate(numbers))
        root = np.full(len(words), -1, np.int64)
        for i, (w, n) in enumerate(zip(words, np.bincount(at_word).tolist(), strict=True)):
            if w in self.roots:
                root[i] = self.roots[w]
            elif n >= self.MANY and 0 < len(w) <= LONG:
                root[i] = self._grow(-1, 0, w)
        leaf = root[at_word]
        walked = np.flatnonzero(leaf >= 0)
        leaf[walked] = self._walk(leaf[walked], key[walked])
        self._sync_leaves()
        n_leaves = len(self.leaf_size)
        which = leaf.copy()
        rest = np.flatnonzero(leaf < 0)
        mark = np.array([not w for w in words])[at_word[rest]]
        other = rest[~mark]
        flat, start, size = self.merge_all(words, at_word[other], key[other])
        which[rest[mark]] = n_leaves
        which[other] = n_leaves + 1 + np.arange(len(other))
        base = len(self.leaf_flat) + len(self.marks)
        starts, sizes = np.concatenate([self.leaf_at, [len(self.leaf_flat)], base + start]), np.concatenate([self.leaf_size, [len(self.marks)], size])
        ids = ragged(np.concatenate([self.leaf_flat, self.marks, flat]), starts, sizes, which)
        at = np.concatenate([[0], np.cumsum(sizes[which])])[bounds]
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def _sync_leaves(self) -> None:
        """Put the ids of new leaves after those of the known ones."""
        new = self.leaf_ids[len(self.leaf_size) :]
        if new:
            size = np.fromiter(map(len, new), np.int64, len(new))
            self.leaf_at = np.concatenate([self.leaf_at, len(self.leaf_flat) + np.cumsum(size) - size])
            self.leaf_size = np.concatenate([self.leaf_size, size])
            self.leaf_flat = np.concatenate([self.leaf_flat, np.fromiter(chain.from_iterable(new), np.int64, int(size.sum()))])

    def decode(self, ids) -> str:
        """The text whose ids these are."""
        return self.decode_all([np.asarray(ids, np.int64)])[0].decode()

    def decode_all(self, lists: list[np.ndarray]) -> list[bytes]:
        """The UTF-8 texts of several lists of ids."""
        ids = np.concatenate([np.zeros(0, np.int64), *lists])
        raw = ragged(self.raw, self.raw_at, self.raw_size, ids).tobytes()
        ends = np.concatenate([[0], np.cumsum(self.raw_size[ids])])[np.cumsum([0, *map(len, lists)])]
        # the first word's space was put there by encoding
        return [raw[a:b].removeprefix(b" ") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The pieces flat[start[i] : start[i] + size[i]] for i in which, after each other."""
    n = size[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start[which] - (ends - n), n)]


@lru_cache(2)
def codec(model: str, dropout: Dropout) -> Codec:
    return Codec(model, dropout)


def encoded(docs: DataFrame, model: str, dropout: Dropout = Dropout(), id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns `keep`) with ``ids``."""
    return _mapped(docs, model, dropout, id_col, text, passed_on(docs.columns if keep is None else keep, ("ids",)), False)


def checked(docs: DataFrame, model: str, dropout: Dropout = Dropout(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_ids, ids_crc32 (little-endian unsigned 32-bit ids) and decoded_equal, from encoding and decoding its text."""
    return _mapped(docs, model, dropout, id_col, text, passed_on([id_col], ("n_ids", "ids_crc32", "decoded_equal")), True)


def _mapped(docs: DataFrame, model: str, dropout: Dropout, id_col: str, text: str, rest: list[str], digest: bool) -> DataFrame:
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{text}`").cast("string").alias("__text"), F.col(f"`{id_col}`").cast("string").alias("__key"), F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in rest]).alias("__row"))
    fields = [T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded_equal", T.BooleanType())] if digest else [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([src.schema["__row"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, dropout)
        for batch in batches:
            for part in pieces(batch, "__text", 8 << 20):  # words repeat more in a larger slice
                texts = strings(part.column(0))
                ids = c.encode_all(texts, part.column(1).to_pylist())
                null = np.array([x is None for x in texts], bool)
                if digest:
                    back = c.decode_all(ids)
                    cols = [
                        pa.array(np.array(list(map(len, ids)), np.int64), mask=null),
                        pa.array(np.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], np.int64), mask=null),
                        pa.array(np.array([x is not None and x.encode() == y for x, y in zip(texts, back, strict=True)], bool), mask=null),
                    ]
                else:
                    cols = [pa.array([None if x is None else i.astype(np.int32) for x, i in zip(texts, ids, strict=True)], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(2), *cols], names=schema.names)

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col("__row")[c].alias(c) for c in rest], *schema.names[1:])


def decoded(rows: DataFrame, model: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """rows with the text of their ids."""
    src = rows.select(F.col(f"`{ids}`").cast("array<int>").alias("__ids"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"))
    schema = T.StructType([src.schema["__row"], T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, Dropout(rate=0))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([None if x is None else c.decode(x) for x in b.column(0).to_pylist()], pa.string())], names=schema.names)

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col("__row")[c].alias(c) for c in rows.columns if c != into], into)
