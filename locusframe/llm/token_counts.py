"""Token counts by rank-synchronous merging of ragged numpy arrays.

All pre-tokens of an Arrow batch are held as one flat symbol array with sequence
bounds.  In each step every sequence merges its own lowest-rank pair, at all places
at once; sequences without a pair leave.  What survives are the tokens.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ._common import add_columns
from ._shingles import buffers, mix

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
_NONE = np.int32(2**31 - 1)
_STATE: dict = {}
#: Sequences of more symbols are merged rank by rank through lists of places, so that a step costs what it merges.
LONG = 256
#: Distinct pre-tokens a worker remembers (10 bytes each); beyond it, it starts afresh.
CACHE_ENTRIES = 2_000_000


def char_classes() -> np.ndarray:
    """Class of every code point, as the splitting pattern of byte-level models sees it."""
    if "classes" not in _STATE:
        import regex

        everything = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
        table = np.zeros(0x110000, np.uint8)
        for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
            for m in regex.finditer(pattern, everything):
                a, z = ord(everything[m.start()]), ord(everything[m.end() - 1])
                if z - a == m.end() - m.start() - 1:
                    table[a : z + 1] = kind
                else:  # the run spans the surrogates
                    table[[ord(c) for c in m.group()]] = kind
        _STATE["classes"] = table
    return _STATE["classes"]


def pretoken_starts(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, as a mask over code points; first marks the start of each text.

    The rules: contractions ('s 't 're 've 'm 'll 'd); an optional space and a run of
    letters, of numbers or of others; white space, of which the last character is left
    to what follows if it is a plain space, and stands alone if not.
    """
    n = len(chars)
    kind = char_classes()[chars]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    space = kind == _SPACE
    following = np.zeros(n, bool)  # the next character begins a non-space run of the same text
    following[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start |= following  # the last space of a run parts from the run
    joins = np.zeros(n, bool)  # a plain space goes before this character
    joins[1:] = following[:-1] & (chars[:-1] == 0x20)
    start &= ~joins
    at = np.flatnonzero((chars == 0x27) & run & ~joins)
    at = at[at + 1 < n]
    at = at[~first[at + 1]]
    if len(at):
        two = at[np.isin(chars[at + 1], [ord(c) for c in "stmd"])]
        start[two + 1] = False
        _begin(start, two + 2, first)
        at = at[at + 2 < n]
        at = at[~first[at + 2]]
        three = at[
            ((chars[at + 2] == ord("e")) & np.isin(chars[at + 1], [ord("r"), ord("v")]))
            | ((chars[at + 1] == ord("l")) & (chars[at + 2] == ord("l")))
        ]
        start[three + 1] = False
        _begin(start, three + 3, first)
    return start


def _begin(start: np.ndarray, at: np.ndarray, first: np.ndarray) -> None:
    """After a contraction the rest starts anew, unless a space joined to the next word is there already."""
    start[at[at < len(start)]] = True


class MergeTable:
    """Pair ranks and results of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        names = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(printable))}
        self.byte = np.array([vocab[names[b]] for b in range(256)], np.int32)
        self.base = np.int64(max(vocab.values()) + 1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
        self.special = [x["content"] for x in spec.get("added_tokens", [])]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def count(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each sequence; symbols holds all sequences (of one byte at least) on end."""
        long = lengths > LONG
        if long.any():
            out = np.zeros(len(lengths), np.int64)
            of_long = np.repeat(long, lengths)
            out[long] = self._count_long(symbols[of_long], lengths[long])
            if not long.all():
                out[~long] = self.count(symbols[~of_long], lengths[~long])
            return out
        out = lengths.astype(np.int64)
        active = np.arange(len(lengths))
        symbols = symbols.astype(np.int64)
        while len(active):
            bounds = np.cumsum(lengths) - lengths
            rank = np.full(len(symbols), _NONE, np.int32)
            if len(symbols) > 1:
                rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
            rank[bounds + lengths - 1] = _NONE
            least = np.minimum.reduceat(rank, bounds)
            hit = (rank == np.repeat(least, lengths)) & (rank != _NONE)
            places = np.flatnonzero(hit)
            new_run = np.ones(len(places), bool)
            new_run[1:] = places[1:] != places[:-1] + 1
            run_at = np.flatnonzero(new_run)
            within = np.arange(len(places)) - np.repeat(run_at, np.diff(np.append(run_at, len(places))))
            places = places[within % 2 == 0]  # of overlapping pairs every other one
            symbols[places] = self.made[rank[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            owner = np.repeat(np.arange(len(lengths)), lengths)
            lengths = lengths - np.bincount(owner[places], minlength=len(lengths))
            out[active] = lengths
            on = (least != _NONE) & (lengths > 1)
            symbols = symbols[keep & on[owner]]
            active, lengths = active[on], lengths[on]
        return out


    def _count_long(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The same for long sequences: at each rank in turn, all its pairs of all sequences at once.

        A pair that a merge makes has a higher rank than the merge, so each rank is met once.  Only the pairs beside
        merges are ranked again.
        """
        n, symbols = len(symbols), symbols.astype(np.int64)
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        follow, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        follow[ends - 1], before[ends - lengths] = n, n  # n: none
        symbols, follow, before = np.append(symbols, 0), np.append(follow, n), np.append(before, n)
        rank = np.full(n + 1, _NONE, np.int32)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def place(at: np.ndarray) -> None:
            """Rank the pairs that begin at these places."""
            at = at[at < n]
            rank[at] = np.where(follow[at] < n, self.ranks(symbols[at], symbols[follow[at]]), _NONE)
            at = at[rank[at] != _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            own = rank[at]
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(at) else np.zeros(0, np.int64)
            for r, some in zip(own[cut].tolist(), np.split(at, cut[1:]) if len(at) else (), strict=True):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(some)

        place(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = waiting.pop(r)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:  # of overlapping pairs every other one
                new_run = np.ones(len(at), bool)
                new_run[1:] = follow[at[:-1]] != at[1:]
                first = np.flatnonzero(new_run)
                at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
            gone = follow[at]
            symbols[at], rank[gone], follow[at] = self.made[r], _NONE, follow[gone]
            before[follow[at]] = at
            lengths = lengths - np.bincount(owner[at], minlength=len(lengths))
            place(np.unique(np.concatenate([at, before[at]])))
        return lengths


def _bpe(path: str) -> MergeTable:
    if path not in _STATE:
        _STATE[path] = MergeTable(path)
    return _STATE[path]


def _cached(model: MergeTable, path: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse_first) -> np.ndarray:
    """Tokens of each distinct pre-token, from what this worker knows or newly merged."""
    hashes, first = inverse_first
    known, known_counts = _STATE.get((path, "cache"), (np.zeros(0, np.uint64), np.zeros(0, np.int32)))
    counts = np.zeros(len(hashes), np.int32)
    at = np.searchsorted(known, hashes)
    found = np.zeros(len(hashes), bool)
    inside = at < len(known)
    found[inside] = known[at[inside]] == hashes[inside]
    counts[found] = known_counts[at[found]]
    new = np.flatnonzero(~found)
    if len(new):
        s, lengths = starts[first[new]], ends[first[new]] - starts[first[new]]
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths - s, lengths)
        counts[new] = model.count(model.byte[data[place]], lengths)
        if len(known) > CACHE_ENTRIES:
            known, known_counts, at = known[:0], known_counts[:0], np.zeros_like(at)
        _STATE[(path, "cache")] = (np.insert(known, at[new], hashes[new]), np.insert(known_counts, at[new], counts[new]))
    return counts


def count_texts(column: pa.Array, path: str) -> np.ndarray:
    """Tokens of every text of an Arrow string array."""
    model = _bpe(path)
    data, offsets = buffers(column)
    texts = len(offsets) - 1
    total = np.zeros(texts, np.int64)
    raw = data.tobytes()
    for special in model.special:  # a special string inside a text is one token and parts its neighbours
        mark = special.encode()
        if mark in raw:
            return np.array([_with_special(x, path) for x in column.to_pylist()], np.int64)
    if not raw:
        return total
    chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    width = 1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000)
    byte_at = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(width, out=byte_at[1:])
    first = np.zeros(len(chars), bool)
    filled = offsets[:-1][np.diff(offsets) > 0]
    first[np.searchsorted(byte_at, filled)] = True
    starts = byte_at[:-1][pretoken_starts(chars, first)]
    ends = np.append(starts[1:], len(data))
    hashes = _span_hashes(data, starts, ends)
    distinct, first_at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    counts = _cached(model, path, data, starts, ends, (distinct, first_at))[inverse]
    sums = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(counts, out=sums[1:])
    bounds = sums[np.searchsorted(starts, offsets)]
    return np.diff(bounds)


def _with_special(text: str | None, path: str) -> int:
    import re

    if not text:
        return 0
    parts = re.split("|".join(re.escape(s) for s in _bpe(path).special), text)
    return len(parts) - 1 + int(sum(count_texts(pa.array([p]), path)[0] for p in parts if p))


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    from . import _shingles as S

    n = len(data)
    up, down = S._powers(n)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_CASED[data] * up[:n], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: A random value for each byte; unlike that of the shingles it tells A from a.
_CASED = np.random.default_rng(7919).integers(1, 2**63, 256, dtype=np.uint64)


def with_token_counts(df: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (n_tokens > limit) to every row.

    tokenizer_path names a byte-level BPE file in the tokenizers JSON format that every
    executor can open.  Null and empty texts count 0 bytes and 0 tokens.  Rows are not
    moved: repeated rows and ties give equal rows, an empty table an empty result, and
    columns called like the three new ones are replaced.  Pre-tokens are told apart by
    64-bit hashes.
    """

    def make():
        def compute(column: pa.Array) -> list[pa.Array]:
            _, offsets = buffers(column)
            n = count_texts(column, tokenizer_path)
            return [pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)]

        return compute

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return add_columns(df, text_col, fields, make)
