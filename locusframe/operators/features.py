"""Random features of encoded sequences, from numpy kernels over whole Arrow batches.

Features of letters come from tables by base code, so the four numbers a letter are never made; those of
other numbers are products of all windows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.sequence import ONE_HOT_BASES
from . import kernels as K

Nonlinearity = Callable[[np.ndarray], np.ndarray]


def gaussian_filters(count: int, width: int, gamma: float = 1.0, seed: int = 0) -> np.ndarray:
    """Model parameters: count rows of width normal numbers."""
    return np.random.default_rng(seed).normal(0.0, gamma, (count, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two."""
    x, h = x.copy(), 1
    while h < x.shape[1]:
        pairs = x.reshape(len(x), -1, 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), -1)
        h *= 2
    return x


#: Up to this width structured filters are multiplied out.
DENSE_WIDTH = 128


class FastFilters:
    """count structured random filters, drawn once: signs, Hadamard, shuffle, normal numbers, Hadamard, lengths."""

    def __init__(self, width: int, count: int, gamma: float, seed: int):
        rng = np.random.default_rng(seed)
        self.count, self.d = count, 1 << max(1, int(width - 1).bit_length())
        self.scale, self.draws = gamma / np.sqrt(self.d), []
        for _ in range(-(-count // self.d)):
            signs, order, normal = rng.choice([-1.0, 1.0], self.d), rng.permutation(self.d), rng.normal(size=self.d)
            self.draws.append((signs, order, normal, np.sqrt(rng.chisquare(self.d, self.d)) / np.linalg.norm(normal)))

    def matrix(self, width: int) -> np.ndarray:
        """The same as count rows of numbers, for widths at which a plain product is faster."""
        return self.products(np.eye(width)).T

    def products(self, rows: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(rows), self.d))
        padded[:, : rows.shape[1]] = rows
        out = [hadamard(hadamard(padded * signs)[:, order] * normal) * lengths for signs, order, normal, lengths in self.draws]
        return np.concatenate(out, axis=1)[:, : self.count] * self.scale


def fast_products(rows: np.ndarray, count: int, gamma: float, seed: int) -> np.ndarray:
    """Products of the rows with the structured filters of a seed."""
    return FastFilters(rows.shape[1], count, gamma, seed).products(rows)


def _featured(df: DataFrame, columns: list[Column], out: str, make: Callable[[], Callable[[list[pa.Array]], np.ndarray]]) -> DataFrame:
    """The rows of the matrix that the batches' columns give, as arrays; null where the first column is."""

    def compute(columns: list[pa.Array], f: Callable) -> list[pa.Array]:
        x = f(columns)
        values = K.lists(x.ravel(), np.arange(len(x) + 1) * x.shape[1])
        if columns[0].null_count:
            values = values.take(pa.array(np.arange(len(x)), mask=columns[0].is_null().to_numpy(zero_copy_only=False)))
        return [values]

    def prepared():
        f = make()
        return lambda columns: compute(columns, f)

    return K.map_columns(df, columns, [T.StructField(out, T.ArrayType(T.DoubleType()))], prepared)


def _dense(filters: np.ndarray, alphabet: int, nonlinearity: Nonlinearity, phase: np.ndarray | None) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda flat, at: K.convolved(flat, at, lambda x: x @ filters.T, filters.shape[1], len(filters), alphabet, nonlinearity, phase)


def random_features(
    df: DataFrame, column: str, filters: np.ndarray, alphabet: int = 4, nonlinearity: Nonlinearity = np.cos, phase: np.ndarray | None = None, out: str = "features"
) -> DataFrame:
    """features: the encoded column convolved with the filters; phase has one number a filter.

    The sum over n-grams of the nonlinearity of their products; zeros if a row is too short, null if it is null.
    """
    return _featured(df, [F.col(column)], out, lambda: lambda c: _dense(filters, alphabet, nonlinearity, phase)(*K.flat_lists(c[0])))


def random_features_fast(df: DataFrame, column: str, count: int, ngram: int, alphabet: int = 4, gamma: float = 1.0, seed: int = 0, out: str = "features") -> DataFrame:
    """As random_features with cosines of structured filters and a seeded phase; no filter matrix is made."""

    def make():
        width, phase = ngram * alphabet, np.random.default_rng(seed + 1).uniform(0, 2 * np.pi, count)
        filters = FastFilters(width, count, gamma, seed)
        if width <= DENSE_WIDTH:
            return lambda c, f=_dense(filters.matrix(width), alphabet, np.cos, phase): f(*K.flat_lists(c[0]))
        return lambda c: K.convolved(*K.flat_lists(c[0]), filters.products, width, count, alphabet, np.cos, phase)

    return _featured(df, [F.col(column)], out, make)


def featurize_sequence(df: DataFrame, filters: np.ndarray, phase: np.ndarray | None = None, seq_col: str = "sequence", out: str = "features") -> DataFrame:
    """features of the windows' sequences: random_features of their one-hot vectors, which are not made."""

    def make():
        bank, table = K.BaseFilters(filters, np.cos, phase), K.code_table(ONE_HOT_BASES)
        return lambda c: bank.features(*K.letters(c[0], table))

    return _featured(df, [F.col(seq_col)], out, make)


def featurize_sequence_phase(df: DataFrame, count: int, ngram: int, seed: int = 0) -> DataFrame:
    """features of the sequences under structured filters with a seeded phase."""

    def make():
        phase, filters, table = np.random.default_rng(seed + 1).uniform(0, 2 * np.pi, count), FastFilters(ngram * 4, count, 1.0, seed), K.code_table(ONE_HOT_BASES)
        if ngram * 4 <= DENSE_WIDTH:
            bank = K.BaseFilters(filters.matrix(ngram * 4), np.cos, phase)
            return lambda c: bank.features(*K.letters(c[0], table))

        def f(columns: list[pa.Array]) -> np.ndarray:
            code, at = K.letters(columns[0], table)
            return K.convolved(K.encoded(code), 4 * at, filters.products, ngram * 4, count, 4, np.cos, phase)

        return f

    return _featured(df, [F.col("sequence")], "features", make)


def _strands(column: pa.Array, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Numbers of both strands on end, and where each begins and ends; zeros for a null or empty signal."""
    flat, at = _signal(column, 2 * window)
    out = []
    for first in (0, window):
        n = np.clip(np.diff(at) - first, 0, window)
        out.append((flat[K.ranges(at[:-1] + first, n)], np.concatenate([[0], np.cumsum(n)])))
    return out


def _signal(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all signals on end, and where each begins and ends; size zeros for one that is null or empty."""
    flat, at = K.flat_lists(column)
    own = np.diff(at)
    n = np.where(own > 0, own, size)
    to = np.concatenate([[0], np.cumsum(n)])
    values = np.zeros(to[-1])
    values[K.ranges(to[:-1], own)] = flat
    return values, to


def featurize_multiscale_signal(df: DataFrame, filters: np.ndarray, widths: tuple[int, ...] = (100, 50, 25, 12, 6), window: int = 200, seed: int = 0) -> DataFrame:
    """features: sequence features, then for each strand the product over widths of its signal's features (3 * filters)."""

    def make():
        bank, table = K.BaseFilters(filters), K.code_table(ONE_HOT_BASES)
        banks = [_dense(gaussian_filters(len(filters), w, seed=seed + i), 1, np.cos, None) for i, w in enumerate(widths)]

        def f(columns: list[pa.Array]) -> np.ndarray:
            strands = [np.prod([b(*x) for b in banks], axis=0) for x in _strands(columns[1], window)]
            return np.hstack([bank.features(*K.letters(columns[0], table)), *strands])

        return f

    return _featured(df, [F.col("sequence"), F.col("dnase")], "features", make)


def featurize_signal(df: DataFrame, filters: np.ndarray, signal_filters: np.ndarray | None = None, window: int = 200) -> DataFrame:
    """features: sequence, plus and minus strand; without signal filters those of the one-hot values raised by the signal."""

    def make():
        bank, table = K.BaseFilters(filters), K.code_table(ONE_HOT_BASES)

        def raised(columns: list[pa.Array]) -> np.ndarray:
            code, at = K.letters(columns[0], table)
            flat, begin = _strands(columns[1], window)[0]
            values, n = np.ones(len(code)), np.minimum(np.diff(at), np.diff(begin))
            values[K.ranges(at[:-1], n)] += flat[K.ranges(begin[:-1], n)]
            return _dense(filters, 4, np.cos, None)(K.encoded(code, values), 4 * at)

        def apart(columns: list[pa.Array]) -> np.ndarray:
            strand = _dense(signal_filters, 1, np.cos, None)
            return np.hstack([bank.features(*K.letters(columns[0], table)), *(strand(*x) for x in _strands(columns[1], window))])

        return raised if signal_filters is None else apart

    return _featured(df, [F.col("sequence"), F.col("dnase")], "features", make)


def featurize_concat_raw(df: DataFrame, filters: np.ndarray, window: int = 200) -> DataFrame:
    """features of the one-hot vector and the signal on end, moved by single numbers."""

    def make():
        table = K.code_table(ONE_HOT_BASES)

        def f(columns: list[pa.Array]) -> np.ndarray:
            code, at = K.letters(columns[0], table)
            flat, begin = _signal(columns[1], 2 * window)
            hot, n = 4 * np.diff(at), np.diff(begin)
            both = np.concatenate([[0], np.cumsum(hot + n)])
            values = np.empty(both[-1])
            values[K.ranges(both[:-1], hot)] = K.encoded(code)
            values[K.ranges(both[:-1] + hot, n)] = flat
            return _dense(filters, 1, np.cos, None)(values, both)

        return f

    return _featured(df, [F.col("sequence"), F.col("dnase")], "features", make)
