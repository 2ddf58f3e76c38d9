"""Alignment of two tokenizers' tokens by merge-path partitioning.

Both tokenizations of a text cover the same bytes, so their tokens are two ascending lists of
ends.  Merging the lists visits every overlapping pair once: at each distinct end, the first
token of either side that ends there or later.

1. Texts are encoded once; diagonal binary searches cut the merge of each text into pieces of
   equal work, whatever the text's length.  The pieces are stored, with the counts of the id
   pairs that their overlaps link.
2. The counts are added over all texts and, in waves of bounded size, sent to the tasks.
3. Each piece emits its overlaps with their counts, and its groups; the groups that a cut
   leaves open are stitched from the pieces of a text in order.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._common import bounded_batches, stored
from ._shingles import buffers
from .token_counts import _span_hashes, pretoken_starts

#: Ends of both sides of one piece.
PIECE_ENDS = 1 << 16
#: Id pairs whose counts are sent to the tasks at a time (16 bytes each).
WAVE_PAIRS = 4_000_000
#: Distinct pre-tokens a worker remembers, and pairs it counts before it passes them on.
CACHE_ENTRIES, HELD_PAIRS = 500_000, 1_000_000
SLICE_BYTES = 1 << 20
_STATE: dict = {}

PIECES = "key long, doc_id long, piece int, pieces int, skew long, a binary, b binary, more_a int, more_b int, pair long, n long"


# --- encoding --------------------------------------------------------------------------


class ByteLevel:
    """Ids of the texts under a byte-level BPE file; each distinct pre-token goes through the library once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(printable))}
        names = {i: s for s, i in spec["model"]["vocab"].items()}
        self.bytes = [bytes(byte[c] for c in names[i]) if i in names and all(c in byte for c in names[i]) else b"" for i in range(max(names) + 1)]
        self._forget()

    def _forget(self) -> None:
        self.known, self.start, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, spaced: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and how many each has."""
        data, offsets = buffers(spaced)
        raw = data.tobytes()
        if not raw:
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        width = 1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000)
        byte_at = np.zeros(len(chars) + 1, np.int64)
        np.cumsum(width, out=byte_at[1:])
        first = np.zeros(len(chars), bool)
        first[np.searchsorted(byte_at, offsets[:-1][np.diff(offsets) > 0])] = True
        starts = byte_at[:-1][pretoken_starts(chars, first)]
        ends = np.append(starts[1:], len(data))
        distinct, at, inverse = np.unique(_span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_ENTRIES:
            self._forget()
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != distinct[inside]
        if new.any():
            made = self.model.encode_batch_fast([raw[starts[i] : ends[i]].decode() for i in at[new]], add_special_tokens=False)
            lists = [m.ids for m in made]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            begin = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum()))])
            for name, values in (("known", distinct[new]), ("start", begin), ("size", size)):
                setattr(self, name, np.insert(getattr(self, name), place[new], values))
            place = np.searchsorted(self.known, distinct)
        begin, size = self.start[place][inverse], self.size[place][inverse]
        sums = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[_ranges(begin, size)]
        return ids, np.diff(sums[np.searchsorted(starts, offsets)])


class Pieces:
    """Ids of the texts under a sentence-piece model, which puts a space in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes = [self._bytes(i) for i in range(n)]

    def _bytes(self, i: int) -> bytes:
        if self.model.is_control(i) or self.model.is_unknown(i):
            return b""
        name = self.model.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = self.model.encode(texts.to_pylist(), num_threads=1)
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum())), size


class Side:
    """A tokenizer with the bytes of its tokens, and their ids as text."""

    def __init__(self, path: str):
        self.model = Pieces(path) if path.endswith(".model") else ByteLevel(path)
        self.size = np.array([len(b) for b in self.model.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.model.bytes), np.uint8)
        self.at = np.cumsum(self.size) - self.size
        self.kind = np.uint16 if len(self.size) <= 1 << 16 else np.uint32
        self.digits = np.array([str(i).encode() for i in range(len(self.size))])

    def covering(self, texts: pa.Array, spaced: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, how many each text has, and which texts' tokens give space + text again."""
        data, offsets = buffers(spaced)
        ids, count = self.model.encode(texts if isinstance(self.model, Pieces) else spaced)
        size = self.size[ids]
        at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
        good = np.diff(at) == np.diff(offsets)
        if (size == 0).any():
            good[np.repeat(np.arange(len(count)), count)[size == 0]] = False
        keep = np.repeat(good, count)
        mine = self.flat[_ranges(self.at[ids[keep]], size[keep])]
        theirs = data if good.all() else data[np.repeat(good, np.diff(offsets))]
        differ = np.flatnonzero(mine != theirs)
        if len(differ):
            text = np.flatnonzero(good)
            ends = np.cumsum(np.diff(offsets)[good])
            good[text[np.unique(np.searchsorted(ends, differ, "right"))]] = False
        return ids, count, good


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of start[1] and so on."""
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


def _side(path: str) -> Side:
    if path not in _STATE:
        _STATE[path] = Side(path)
    return _STATE[path]


# --- pieces ----------------------------------------------------------------------------


def merge_path(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the ascending a and b are among the first d of their merge, for each d; equal ends stay together."""
    lo, hi = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        at = np.clip(diagonals - 1 - mid, 0, max(len(b) - 1, 0))
        more = a[np.minimum(mid, len(a) - 1)] <= b[at]
        lo, hi = np.where(open_ & more, mid + 1, lo), np.where(open_ & ~more, mid, hi)
    i, j = lo, diagonals - lo
    if len(a) and len(b):
        tied = (i > 0) & (j < len(b))
        tied &= a[np.maximum(i - 1, 0)] == b[np.minimum(j, len(b) - 1)]
        j = j + tied
    return i, j


def cuts(ends_a: np.ndarray, ends_b: np.ndarray, piece_ends: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the pieces in both lists, first and last included."""
    total = len(ends_a) + len(ends_b)
    pieces = max(1, -(-total // piece_ends))
    i, j = merge_path(ends_a, ends_b, np.arange(pieces + 1) * total // pieces)
    return i, j


class Merge:
    """The merge of both sides for the pieces of a batch, all at once.

    Every piece has, after its own tokens, the next token of each side, which overlaps may reach.
    """

    def __init__(self, a: Side, b: Side, rows_a: list, rows_b: list, more_a: np.ndarray, more_b: np.ndarray, skew: np.ndarray):
        n = len(rows_a)
        self.pieces = n
        self.n_a = np.fromiter((len(x) // a.kind().itemsize for x in rows_a), np.int64, n)
        self.n_b = np.fromiter((len(x) // b.kind().itemsize for x in rows_b), np.int64, n)
        self.a, own_a, self.piece_a = self._with_next(np.frombuffer(b"".join(rows_a), a.kind), self.n_a, more_a)
        self.b, own_b, self.piece_b = self._with_next(np.frombuffer(b"".join(rows_b), b.kind), self.n_b, more_b)
        self.own_a, self.own_b = own_a, own_b
        ends_a, last_a = self._ends(a.size[self.a], own_a, self.n_a, np.maximum(skew, 0))
        ends_b, last_b = self._ends(b.size[self.b], own_b, self.n_b, np.maximum(-skew, 0))
        last = np.maximum(last_a, last_b) + 1
        base = np.cumsum(last) - last
        self.ends_a = base[self.piece_a] + np.where(own_a, ends_a, (last - 1)[self.piece_a])
        self.ends_b = base[self.piece_b] + np.where(own_b, ends_b, (last - 1)[self.piece_b])
        # a next token ends at or behind the piece's last end
        self.over_b = np.searchsorted(self.ends_b, self.ends_a)
        self.over_a = np.searchsorted(self.ends_a, self.ends_b)
        self.common_a = own_a & (self.ends_b[np.minimum(self.over_b, len(self.b) - 1)] == self.ends_a) & own_b[np.minimum(self.over_b, len(self.b) - 1)]
        self.common_b = np.zeros(len(self.b), bool)
        self.common_b[self.over_b[self.common_a]] = True

    @staticmethod
    def _with_next(ids: np.ndarray, count: np.ndarray, more: np.ndarray):
        size = count + 1
        out = np.zeros(int(size.sum()), np.int64)
        own = np.ones(len(out), bool)
        last = np.cumsum(size) - 1
        own[last] = False
        out[own], out[last] = ids, np.maximum(more, 0)
        return out, own, np.repeat(np.arange(len(count)), size)

    @staticmethod
    def _ends(size: np.ndarray, own: np.ndarray, count: np.ndarray, begin: np.ndarray):
        sums = np.cumsum(np.where(own, size, 0))
        last = np.cumsum(count + 1) - 1
        before = np.concatenate([[0], sums[last[:-1]]]) if len(last) else sums[:0]
        ends = sums - np.repeat(before - begin, count + 1)
        return ends, ends[last]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides and the piece of every overlap."""
        b_only = self.own_b & ~self.common_b
        i = np.concatenate([np.flatnonzero(self.own_a), self.over_a[b_only]])
        j = np.concatenate([self.over_b[self.own_a], np.flatnonzero(b_only)])
        return self.a[i], self.b[j], np.concatenate([self.piece_a[self.own_a], self.piece_b[b_only]])

    def groups(self) -> np.ndarray:
        return np.bincount(self.piece_a[self.common_a], minlength=self.pieces)

    def fragments(self, a: Side, b: Side) -> tuple[bytes, np.ndarray]:
        """All pieces' groups as text, and for each piece five bounds in it.

        Between the bounds lie: A's and B's tokens before the first common end (with an end at the
        first common end included), the groups between, A's and B's tokens behind the last.
        Every token has its mark: ',' or the mark that ends its side of the group.
        """
        group_a = np.concatenate([[0], np.cumsum(self.common_a)[:-1]])[self.own_a]
        group_b = np.concatenate([[0], np.cumsum(self.common_b)[:-1]])[self.own_b]
        ids_a, ids_b, piece_a, piece_b = self.a[self.own_a], self.b[self.own_b], self.piece_a[self.own_a], self.piece_b[self.own_b]
        # order: piece, group, side; a piece may begin inside a group, so the group's number is counted by piece
        key_a, key_b = 2 * (group_a + piece_a), 2 * (group_b + piece_b) + 1
        place_a = np.arange(len(ids_a)) + np.searchsorted(key_b, key_a)
        place_b = np.arange(len(ids_b)) + np.searchsorted(key_a, key_b, "right")
        n = len(ids_a) + len(ids_b)
        digits = np.zeros(n, f"S{max(a.digits.itemsize, b.digits.itemsize) + 1}")
        digits[place_a], digits[place_b] = a.digits[ids_a], b.digits[ids_b]
        key = np.empty(n, np.int64)
        key[place_a], key[place_b] = key_a, key_b
        last = np.ones(n, bool)
        last[:-1] = key[1:] != key[:-1]
        closing = np.zeros(n, bool)  # B's token at a common end
        closing[place_b] = self.common_b[self.own_b]
        mark = np.where(closing, ord(";"), np.where(last & (key % 2 == 0), ord("|"), ord(","))).astype(np.uint8)
        cells = digits.view(np.uint8).reshape(n, digits.itemsize)
        size = (cells != 0).sum(1)
        cells[np.arange(n), size] = mark
        text = cells[cells != 0].tobytes()
        ends = np.concatenate([[0], np.cumsum(size + 1)])
        piece = np.empty(n, np.int64)
        piece[place_a], piece[place_b] = piece_a, piece_b
        order = np.arange(self.pieces)
        begin, end = np.searchsorted(piece, order), np.searchsorted(piece, order, "right")
        lowest = 2 * (np.concatenate([[0], np.cumsum(self.common_a)])[np.searchsorted(self.piece_a, order)] + order)
        highest = lowest + 2 * self.groups()
        head_a, head = np.searchsorted(key, lowest + 1), np.searchsorted(key, lowest + 2)
        tail, tail_b = np.searchsorted(key, highest), np.searchsorted(key, highest + 1)
        bounds = np.stack([begin, head_a, head, np.maximum(tail, head), np.maximum(tail_b, head), end])
        return text, ends[bounds]


def _keys(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    return a * width + b


def _encoded(a_path: str, b_path: str, piece_ends: int):
    """Rows (id, text) to pieces, and to counts of id pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = _side(a_path), _side(b_path)
        key = TaskContext.get().partitionId() << 40
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def counts() -> pa.RecordBatch:
            pair, n = _added(held)
            columns = [*(pa.nulls(len(pair), k) for k in kinds), pa.array(pair), pa.array(n)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
        names = ["key", "doc_id", "piece", "pieces", "skew", "a", "b", "more_a", "more_b", "pair", "n"]
        for batch in chain.from_iterable(_slices(x, ("text",)) for x in batches):
            texts = pc.fill_null(batch.column(1), "")
            some = pc.greater(pc.binary_length(texts), 0)
            inner = texts.filter(some)
            spaced = pc.binary_join_element_wise(" ", inner, "")
            ids_a, count_a, good_a = a.covering(inner, spaced)
            ids_b, count_b, good_b = b.covering(inner, spaced)
            at_a, at_b = np.concatenate([[0], np.cumsum(count_a)]), np.concatenate([[0], np.cumsum(count_b)])
            ends_a, ends_b = np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b])
            ids_a, ids_b = ids_a.astype(a.kind), ids_b.astype(b.kind)
            rows: list[tuple] = []
            inside = np.full(len(texts), -1)
            inside[some.to_numpy(zero_copy_only=False)] = np.arange(len(inner))
            for doc, t in zip(batch.column(0).to_pylist(), inside.tolist(), strict=True):
                key += 1
                if t < 0 or not (good_a[t] and good_b[t]):
                    rows.append((key, doc, 0, 1, 0, b"", b"", -1, -1))
                    continue
                (x, y), (u, v) = at_a[t : t + 2].tolist(), at_b[t : t + 2].tolist()
                if y - x + v - u <= piece_ends:
                    rows.append((key, doc, 0, 1, 0, ids_a[x:y].tobytes(), ids_b[u:v].tobytes(), -1, -1))
                    continue
                own_a = ends_a[x:y] - (ends_a[x - 1] if x else 0)
                own_b = ends_b[u:v] - (ends_b[u - 1] if u else 0)
                i, j = cuts(own_a, own_b, piece_ends)
                for p in range(len(i) - 1):
                    begin_a, begin_b = (int(own_a[i[p] - 1]) if i[p] else 0), (int(own_b[j[p] - 1]) if j[p] else 0)
                    more_a = int(ids_a[x + i[p + 1]]) if i[p + 1] < y - x else -1
                    more_b = int(ids_b[u + j[p + 1]]) if j[p + 1] < v - u else -1
                    rows.append((key, doc, p, len(i) - 1, begin_a - begin_b, ids_a[x + i[p] : x + i[p + 1]].tobytes(), ids_b[u + j[p] : u + j[p + 1]].tobytes(), more_a, more_b))
            columns = list(zip(*rows, strict=True))
            merge = Merge(a, b, columns[5], columns[6], np.array(columns[7]), np.array(columns[8]), np.array(columns[4]))
            left, right, _ = merge.links()
            held.append(np.unique(_keys(left, right, len(b.size)), return_counts=True))
            if sum(len(h[0]) for h in held) > HELD_PAIRS:
                yield counts()
                held.clear()
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), none, none], names=names)
        if held:
            yield counts()

    return run


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pair, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    order = np.argsort(pair, kind="stable")
    pair, n = pair[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    return pair[first], np.add.reduceat(n, first) if len(first) else n


# --- counts ----------------------------------------------------------------------------


class Counts:
    """Counts of id pairs by open addressing; a count is doubled, and odd if it is the highest of its B id."""

    def __init__(self, pair: np.ndarray, value: np.ndarray):
        bits = max(4, int(2 * len(pair)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.pair, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        rest, at = np.arange(len(pair)), self._at(pair)
        while len(rest):
            free = self.pair[at] == -1
            self.pair[at[free]] = pair[rest[free]]
            here = self.pair[at] == pair[rest]
            self.value[at[here]] = value[rest[here]]
            rest, at = rest[~here], (at[~here] + 1) & self.mask

    def _at(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, pair: np.ndarray) -> np.ndarray:
        """Doubled counts with their mark; 0 for pairs of other waves."""
        at = self._at(pair)
        found = self.pair[at]
        out = np.where(found == pair, self.value[at], 0)
        rest = np.flatnonzero((found != pair) & (found != -1))
        at = at[rest]
        while len(rest):
            at = (at + 1) & self.mask
            found = self.pair[at]
            hit = found == pair[rest]
            out[rest[hit]] = self.value[at[hit]]
            on = ~hit & (found != -1)
            rest, at = rest[on], at[on]
        return out


def _measured(a_path: str, b_path: str, sent, tag: str, whole: bool):
    """Rows of pieces to their sums; whole: all pieces are whole texts, whose digests are made too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _side(a_path), _side(b_path)
        if _STATE.get("wave") != tag:
            _STATE["counts"] = Counts(*(np.frombuffer(x, np.int64) for x in sent.value))
            _STATE["wave"] = tag
        known: Counts = _STATE["counts"]
        for x in chain.from_iterable(_slices(x, ("a", "b")) for x in batches):
            at = {n: x.column(i) for i, n in enumerate(x.schema.names)}
            merge = Merge(a, b, at["a"].to_pylist(), at["b"].to_pylist(), at["more_a"].to_numpy(), at["more_b"].to_numpy(), at["skew"].to_numpy())
            left, right, piece = merge.links()
            value = known.of(_keys(left, right, len(b.size)))
            sums = lambda w, piece=piece, n=len(x): np.bincount(piece, w, n)
            # doubles add exactly up to 2**53; more goes through whole numbers
            counts = value >> 1
            if len(counts) and int(counts.max()) * len(counts) >= 1 << 53:
                count_sum = np.zeros(len(x), np.int64)
                np.add.at(count_sum, piece, counts)
            else:
                count_sum = sums(counts).astype(np.int64)
            out = [at["key"], at["doc_id"], at["piece"], pa.array(merge.n_a), pa.array(merge.n_b), pa.array(merge.groups()), pa.array(np.bincount(piece, minlength=len(x))), pa.array(sums(value & 1).astype(np.int64)), pa.array(count_sum)]
            text, bounds = merge.fragments(a, b)
            if whole:
                own = [hashlib.sha256(text[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(bounds[0].tolist(), bounds[5].tolist(), strict=True)]
                out.append(pa.array(own, pa.string()))
            else:
                for k in range(5):
                    out.append(pa.array([text[s:e] for s, e in zip(bounds[k].tolist(), bounds[k + 1].tolist(), strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=_SUMS + (["groups_sha256"] if whole else _PARTS))

    return run


def _slices(batch: pa.RecordBatch, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about SLICE_BYTES in these columns."""
    size = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(c))), 0).to_numpy().astype(np.int64) for c in columns))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


_SUMS = ["key", "doc_id", "piece", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_PARTS = ["head_a", "head_b", "body", "tail_a", "tail_b"]
_FORM = "key long, doc_id long, piece int, " + ", ".join(f"{c} long" for c in _SUMS[3:])


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From fragments sorted by key and piece: each text's digest."""
    name, digest, first = None, None, True
    open_a: list[bytes] = []
    open_b: list[bytes] = []

    def end():
        close()
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["key", "groups_sha256"])

    def close():
        nonlocal first
        if open_a or open_b:
            a, b = b"".join(open_a).replace(b"|", b","), b"".join(open_b).replace(b";", b",")
            digest.update((b"" if first else b";") + a[:-1] + b"|" + b[:-1])
            first = False
        open_a.clear()
        open_b.clear()

    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] != name:
                if name is not None:
                    yield end()
                name, digest, first = row["key"], hashlib.sha256(), True
                open_a.clear()
                open_b.clear()
            open_a.append(row["head_a"])
            open_b.append(row["head_b"])
            if row["n_groups"]:
                close()
                if row["body"]:
                    digest.update(b";" + row["body"][:-1])
                open_a.append(row["tail_a"])
                open_b.append(row["tail_b"])
                if not row["tail_a"] and not row["tail_b"]:
                    open_a.clear()
                    open_b.clear()
    if name is not None:
        yield end()


# --- the operator ----------------------------------------------------------------------


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", piece_ends: int = PIECE_ENDS, wave_pairs: int = WAVE_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    a_path names a byte-level BPE file, which gets a space and the text, b_path a sentence-piece
    model, which adds the space.  Offsets where tokens of both end cut them into groups; links are
    the overlapping token pairs; a pair's count is how many links of all rows hold its ids; n_best
    counts the links whose count is the highest of their B id, ties included.
    Null and empty texts, and those that the tokens do not give back byte for byte, have zeros and an
    empty digest.  Null and repeated ids and repeated rows are rows of their own, an empty table
    gives an empty result, and other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = stored(base.mapInArrow(_encoded(a_path, b_path, piece_ends), PIECES))
    pieces = made.filter("key IS NOT NULL").drop("pair", "n")
    width = len(_side(b_path).size)
    pairs = stored(made.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")))
    best = pairs.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("top"))  # a row for each id at most
    marked = pairs.join(F.broadcast(best), F.col("pair") % width == F.col("b")).select("pair", (2 * F.col("n") + (F.col("n") == F.col("top")).cast("long")).alias("value"))
    waves = max(1, -(-pairs.count() // wave_pairs))
    marked = stored(marked) if waves > 1 else marked
    single, several, parts = [], [], F.pmod(F.xxhash64("pair"), F.lit(waves))
    for w in range(waves):
        got = (marked.filter(parts == w) if waves > 1 else marked).toArrow()
        tag = uuid.uuid4().hex
        sent = spark.sparkContext.broadcast([got.column(i).to_numpy().astype(np.int64).tobytes() for i in (0, 1)])
        single.append(pieces.filter("pieces = 1").mapInArrow(_measured(a_path, b_path, sent, tag, True), _FORM + ", groups_sha256 string"))
        several.append(pieces.filter("pieces > 1").mapInArrow(_measured(a_path, b_path, sent, tag, False), _FORM + "".join(f", {c} binary" for c in _PARTS)))
    # waves repeat everything but what they count
    sums = [F.max(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [F.sum(c).alias(c) for c in ("n_best", "count_sum")]
    whole = single[0]
    if waves > 1:
        for x in single[1:]:
            whole = whole.unionByName(x)
        whole = whole.groupBy("key").agg(*sums, F.max("groups_sha256").alias("groups_sha256"))
    digests = several[0].select("key", "piece", "n_groups", *_PARTS).repartition("key").sortWithinPartitions("key", "piece").mapInArrow(_stitched, "key long, groups_sha256 string")
    cut = several[0].drop(*_PARTS)
    for x in several[1:]:
        cut = cut.unionByName(x.drop(*_PARTS))
    cut = cut.groupBy("key", "piece").agg(*sums).groupBy("key").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in _SUMS[3:]])
    columns = ["doc_id", *_SUMS[3:], "groups_sha256"]
    return whole.select(*columns).unionByName(cut.join(digests, "key").select(*columns))
