"""Word shingles of many texts at once, as 64-bit hashes, with numpy.

A word is a run of bytes other than the six ASCII white-space characters, after
lower-casing A-Z.  All texts of an Arrow batch are hashed in one go: a running
polynomial sum gives the hash of any byte range, so there is no loop over words.
"""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_RNG = np.random.default_rng(20240229)
#: A random value for each byte, after lower-casing A-Z.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_ORDER = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BLOCK = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, 0 to n."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, _BLOCK)
        for name, base in (("up", _MULT), ("down", _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts data[offsets[i]:offsets[i + 1]], and words per text."""
    space = _SPACE[data]
    n = len(data)
    edge = np.ones(n + 1, bool)
    edge[1:-1] = space[1:] != space[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)  # every cut starts a run of one kind within one text
    starts, ends = cuts[:-1], cuts[1:]
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    word = ~space[starts]
    starts, ends = starts[word], ends[word]
    up, down = _powers(n)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=run[1:])
    hashes = mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)
    return hashes, np.diff(first)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of every text, sorted by text and hash, and how many each has.

    A text of fewer words, but not none, has its whole word sequence as its one shingle.
    """
    words, counts = word_hashes(data, offsets)
    texts = len(counts)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(texts), made)
    first = np.cumsum(counts) - counts
    start = np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made) + np.repeat(first, made)
    length = np.minimum(np.repeat(counts, made), k)
    value = length.astype(np.uint64) * _ORDER[0]
    for j in range(k):
        there = length > j
        at = np.where(there, start + j, 0)
        value += np.where(there, words[at] * _ORDER[j + 1], np.uint64(0)) if len(words) else 0
        value = mix(value) if j == k - 1 else value ^ (value >> np.uint64(29))
    order = np.argsort(value)
    if texts < 1 << 16:  # numpy sorts 16-bit keys in linear time
        order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(owner[order], kind="stable")]
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=texts)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; null texts are empty."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
