"""Array kernels over the letters of whole Arrow batches, with numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

#: Letters that a kernel looks at together, and numbers of one block of products.
SLICE_LETTERS, BLOCK = 1 << 20, 1 << 21
#: Code of every letter that is no base.
OTHER = 4


def code_table(bases: str) -> np.ndarray:
    """The place in ``bases`` of each byte, or OTHER."""
    out = np.full(256, OTHER, np.uint8)
    out[np.frombuffer(bases.encode(), np.uint8)] = np.arange(len(bases))
    return out


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings on end, and where each string begins and ends; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _first_bytes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes begin a character, and where each string begins and ends in characters."""
    first = (data & 0xC0) != 0x80
    return first, np.concatenate([[0], np.cumsum(first)])[at]


def letters(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letters of all strings on end, and where each string begins and ends; nulls are empty."""
    data, at = _bytes(column)
    if len(data) and int(data.max()) >= 0x80:  # a character of several bytes is one letter
        first, at = _first_bytes(data, at)
        data = data[first]
    return table[data], at


def points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings on end, and where each string begins and ends; nulls are empty."""
    data, at = _bytes(column)
    if len(data) and int(data.max()) >= 0x80:
        return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4"), _first_bytes(data, at)[1]
    return data, at


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all lists on end, and where each list begins and ends; nulls are empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float), np.concatenate([[0], np.cumsum(sizes)])


def ranges(start: np.ndarray, size: np.ndarray, step: int = 1) -> np.ndarray:
    """start[0], start[0] + step, ... size[0] of them, then those of start[1] and so on."""
    return (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)) * step + np.repeat(start, size)


def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_LETTERS) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows that hold about ``most`` bytes or numbers in a column."""
    for b in batches:
        c = b.column(column)
        size = pc.list_value_length(c) if pa.types.is_nested(c.type) else pc.binary_length(c)
        ends, at = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < len(b):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to


def map_columns(df: DataFrame, columns: list, fields: list[T.StructField], make: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]]) -> DataFrame:
    """df with the fields appended, or put in place of columns of their names.

    ``make`` runs once a task and returns the function from the Arrow arrays of the column expressions to one array a field.
    """
    names = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in names]
    schema = T.StructType([*df.select(*kept).schema.fields, *fields])
    inputs = [x.alias(f"__x{i}") for i, x in enumerate(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for b in slices(batches, len(kept)):
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *compute(b.columns[len(kept) :])], names=schema.names)

    return df.select(*kept, *inputs).mapInArrow(run, schema)


# --- k-mers ----------------------------------------------------------------------------


class Windows:
    """All windows of k letters of a batch that hold bases only: the row and the two-bit code of each."""

    def __init__(self, column: pa.Array, k: int, table: np.ndarray):
        code, at = letters(column, table)
        n = max(0, len(code) - k + 1)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        bad = np.concatenate([[0], np.cumsum(code == OTHER)])
        good = (bad[k : n + k] == bad[:n]) & (at[1:][row[:n]] >= np.arange(n) + k)
        self.at = np.flatnonzero(good)
        self.row, self.rows, self.k, self.code = row[self.at], len(at) - 1, k, code

    def places(self) -> np.ndarray:
        """Rolling codes: the first letter is the highest digit."""
        n = max(0, len(self.code) - self.k + 1)
        place = np.zeros(n, np.int64)
        for j in range(self.k):
            place = place * 4 + self.code[j : n + j]
        return place[self.at]

    def composition(self) -> list[np.ndarray]:
        """How many of each base a window has."""
        out = []
        for b in range(4):
            sums = np.concatenate([[0], np.cumsum(self.code == b)])
            out.append(sums[self.at + self.k] - sums[self.at])
        return out

    def counted(self, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and number of the distinct places of each row; places are below width."""
        if self.rows * width <= max(1 << 20, 4 * len(place)):
            n = np.bincount(self.row * width + place, minlength=1)
            key = np.flatnonzero(n)
            return key // width, key % width, n[key]
        if self.rows * width < 1 << 62:
            key, n = np.unique(self.row * width + place, return_counts=True)
            return key // width, key % width, n
        values, place = np.unique(place, return_inverse=True)
        key, n = np.unique(self.row * len(values) + place, return_counts=True)
        return key // len(values), values[key % len(values)], n


def kmer_strings(place: np.ndarray, k: int, bases: str) -> pa.Array:
    digits = np.empty((len(place), k), np.uint8)
    for j in range(k):
        digits[:, k - 1 - j] = place % 4
        place = place // 4
    data = np.frombuffer(bases.encode(), np.uint8)[digits]
    return pa.LargeStringArray.from_buffers(len(data), pa.py_buffer(np.arange(0, len(data) * k + 1, k, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


# --- products --------------------------------------------------------------------------


def _summed(values: np.ndarray, row: np.ndarray, out: np.ndarray) -> None:
    """Add the rows of values, sorted by row, to out's."""
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    out[row[first]] += np.add.reduceat(values, first, axis=0)


def convolved(flat: np.ndarray, at: np.ndarray, product: Callable[[np.ndarray], np.ndarray], width: int, count: int, alphabet: int, nonlinearity: Callable, phase: np.ndarray | None) -> np.ndarray:
    """For each row of numbers, the sum over its windows (moved by alphabet) of the nonlinearity of their products; zeros if it is too short."""
    sizes = np.diff(at)
    n = np.where(sizes >= width, (sizes - width) // alphabet + 1, 0)
    out = np.zeros((len(sizes), count))
    starts, row = ranges(at[:-1], n, alphabet), np.repeat(np.arange(len(n)), n)
    if not len(starts):
        return out
    windows, step = np.lib.stride_tricks.sliding_window_view(flat, width), max(1, BLOCK // max(width, count))
    held = np.concatenate([[0], np.cumsum(flat != 0)])
    some = held[starts + width] > held[starts]
    if 2 * np.count_nonzero(some) < len(some):  # windows of zeros have products of zero
        zeros = np.bincount(row[~some], minlength=len(n))
        out += zeros[:, None] * nonlinearity(np.zeros((1, count)) if phase is None else phase[None])
        starts, row = starts[some], row[some]
    for a in range(0, len(starts), step):
        z = product(windows[starts[a : a + step]])
        _summed(nonlinearity(z if phase is None else z + phase), row[a : a + step], out)
    return out * np.sqrt(2.0 / count)


class BaseFilters:
    """Filters over one-hot letters as tables: the sum of a filter's numbers for every code of a few letters on end."""

    #: Letters of one table; codes of all of a filter's letters that are counted instead of looked up.
    TOGETHER, COUNTED = 3, 4096

    def __init__(self, filters: np.ndarray, nonlinearity: Callable = np.cos, phase: np.ndarray | None = None):
        self.count, self.k = len(filters), filters.shape[1] // 4
        by_letter = np.concatenate([filters.reshape(self.count, self.k, 4), np.zeros((self.count, self.k, 1))], axis=2).transpose(1, 2, 0)
        self.nonlinearity, self.phase, self.tables = nonlinearity, phase, []
        for p in range(0, self.k, self.TOGETHER):
            table = by_letter[p]
            for x in by_letter[p + 1 : p + self.TOGETHER]:
                table = (table[:, None] + x[None]).reshape(-1, self.count)
            self.tables.append((p, min(self.TOGETHER, self.k - p), table))
        self.all = None
        if 5**self.k <= self.COUNTED:
            table = by_letter[0]
            for x in by_letter[1:]:
                table = (table[:, None] + x[None]).reshape(-1, self.count)
            self.all = self._through(table)

    def _through(self, z: np.ndarray) -> np.ndarray:
        return self.nonlinearity(z if self.phase is None else z + self.phase)

    @staticmethod
    def _codes(code: np.ndarray, at: np.ndarray, p: int, k: int) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for j in range(k):
            out = out * 5 + code[at + p + j]
        return out

    def _distinct(self, code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The codes of all of a filter's letters that occur, the place of each window's among them, and a window of each."""
        all_ = self._codes(code, starts, 0, self.k)
        if 5**self.k > BLOCK:
            kinds, first, kind = np.unique(all_, return_index=True, return_inverse=True)
            return kinds, kind, starts[first]
        one = np.full(5**self.k, -1)
        one[all_] = starts
        kinds = np.flatnonzero(one >= 0)
        first = one[kinds]
        one[kinds] = np.arange(len(kinds))
        return kinds, one[all_], first

    def features(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sums over the n-grams of each row of letters."""
        sizes = np.diff(at)
        n = np.maximum(sizes - self.k + 1, 0)
        starts, row, out = ranges(at[:-1], n), np.repeat(np.arange(len(n)), n), np.zeros((len(n), self.count))
        if not len(starts):
            return out
        if self.all is not None:
            width, step = len(self.all), max(1, BLOCK // len(self.all))
            cut = np.searchsorted(row, np.arange(0, len(n) + step, step))
            for i, (a, z) in enumerate(zip(cut, cut[1:], strict=False)):
                held = np.bincount((row[a:z] - i * step) * width + self._codes(code, starts[a:z], 0, self.k), minlength=min(step, len(n) - i * step) * width)
                out[i * step : (i + 1) * step] = held.reshape(-1, width) @ self.all
        else:
            step = max(1, BLOCK // self.count)
            if 5**self.k < 1 << 62:  # texts repeat their n-grams: each is made once
                kinds, kind, first = self._distinct(code, starts)
                if 2 * len(kinds) <= len(starts) and len(kinds) <= 4 * step:
                    made = np.concatenate([self._through(sum(table[self._codes(code, first[a : a + step], p, k)] for p, k, table in self.tables)) for a in range(0, len(first), step)])
                    for a in range(0, len(starts), step):
                        _summed(made[kind[a : a + step]], row[a : a + step], out)
                    return out * np.sqrt(2.0 / self.count)
            for a in range(0, len(starts), step):
                z = sum(table[self._codes(code, starts[a : a + step], p, k)] for p, k, table in self.tables)
                _summed(self._through(z), row[a : a + step], out)
        return out * np.sqrt(2.0 / self.count)


def encoded(code: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """Four numbers a letter, its value (1 if not given) at its base."""
    hot = np.concatenate([np.eye(4), np.zeros((1, 4))])[code]
    return (hot if values is None else hot * values[:, None]).ravel()


def one_hot_column(df: DataFrame, bases: str, seq_col: str = "sequence", out: str = "v") -> DataFrame:
    """The one-hot vector of each sequence, as a column; a null sequence stays null."""

    def make():
        table = code_table(bases)

        def compute(columns: list[pa.Array]) -> list[pa.Array]:
            code, at = letters(columns[0], table)
            v = lists(encoded(code), 4 * at)
            return [v if not columns[0].null_count else v.take(pa.array(np.arange(len(v)), mask=columns[0].is_null().to_numpy(zero_copy_only=False)))]

        return compute

    return map_columns(df, [F.col(seq_col)], [T.StructField(out, T.ArrayType(T.DoubleType()))], make)


def _bits(hot: np.ndarray) -> pa.Array:
    """The rows of a matrix of truths as bytes of eight, zeros after the last."""
    data = np.packbits(hot, axis=1)
    at = np.arange(len(data) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def packed(df: DataFrame, column: str, width: int, out: str = "features") -> DataFrame:
    """width numbers a row as bits: 1 at the places (from 0) in the row's list."""

    def compute(columns: list[pa.Array]) -> list[pa.Array]:
        place, at = flat_lists(columns[0])
        hot = np.zeros((len(at) - 1, width), bool)
        hot[np.repeat(np.arange(len(hot)), np.diff(at)), place.astype(np.int64)] = True
        return [_bits(hot)]

    return map_columns(df, [F.col(column)], [T.StructField(out, T.BinaryType())], lambda: compute)


def one_hot_bits(df: DataFrame, bases: str, letters_: int, more: int = 0, place=None, seq_col: str = "sequence", out: str = "features") -> DataFrame:
    """The one-hot vector of sequences of at most letters_ as bits, zeros where one ends; then ``more`` numbers, 1 at the place (from 0), none for null."""

    def make():
        table = code_table(bases)

        def compute(columns: list[pa.Array]) -> list[pa.Array]:
            code, at = letters(columns[0], table)
            hot = np.zeros((len(at) - 1, 4 * letters_ + more), bool)
            row, base = np.repeat(np.arange(len(hot)), np.diff(at)), np.flatnonzero(code != OTHER)
            hot[row[base], 4 * (base - at[row[base]]) + code[base]] = True
            own = pc.fill_null(columns[1], -1).to_numpy(zero_copy_only=False)
            some = np.flatnonzero(own >= 0)
            hot[some, 4 * letters_ + own[some]] = True
            return [_bits(hot)]

        return compute

    return map_columns(df, [F.col(seq_col), (F.lit(None) if place is None else place).cast("int")], [T.StructField(out, T.BinaryType())], make)


def unpacked(df: DataFrame, width: int, column: str = "features") -> DataFrame:
    """Bits as an array of numbers, in place of the column."""

    def compute(columns: list[pa.Array]) -> list[pa.Array]:
        x = bit_rows(columns[0])[:, :width]
        return [lists(x.ravel(), np.arange(len(x) + 1) * width)]

    return map_columns(df, [F.col(column)], [T.StructField(column, T.ArrayType(T.DoubleType()))], lambda: compute)


def bit_rows(column: pa.Array) -> np.ndarray:
    """Numbers of the rows of a column of bits; zeros follow the last up to a whole byte."""
    return np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1), axis=1).astype(float)


def list_sums(df: DataFrame, column: str, total: str = "total", moment: str = "moment") -> DataFrame:
    """The sum of each list of numbers, and the sum of its numbers times their places (from 1), in place of the column; null for a null list."""

    def compute(columns: list[pa.Array]) -> list[pa.Array]:
        flat, at = flat_lists(columns[0])
        sums = np.concatenate([[0.0], np.cumsum(flat)]), np.concatenate([[0.0], np.cumsum(flat * (np.arange(len(flat)) - np.repeat(at[:-1], np.diff(at)) + 1))])
        missing = columns[0].is_null().to_numpy(zero_copy_only=False)
        return [pa.array(s[at[1:]] - s[at[:-1]], mask=missing) for s in sums]

    return map_columns(df, [F.col(column)], [T.StructField(total, T.DoubleType()), T.StructField(moment, T.DoubleType())], lambda: compute).drop(column)


def spread(df: DataFrame, column: str, size: int, out: str) -> DataFrame:
    """An array of size numbers, zeros but at the places of a list of (place, v) records, in place of the column; null for null."""

    def compute(columns: list[pa.Array]) -> list[pa.Array]:
        at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(columns[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
        place, v = (x.to_numpy(zero_copy_only=False) for x in columns[0].flatten().flatten())
        values = np.zeros((len(at) - 1, size))
        values[np.repeat(np.arange(len(values)), np.diff(at)), place] = v
        missing = columns[0].is_null().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(~missing) * size])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[~missing].ravel()), mask=pa.array(missing))]

    return map_columns(df, [F.col(column)], [T.StructField(out, T.ArrayType(T.DoubleType()))], lambda: compute).drop(column)


def _masked(values: pa.Array, column: pa.Array) -> pa.Array:
    """The values, null where the column is."""
    return values if not column.null_count else values.take(pa.array(np.arange(len(values)), mask=column.is_null().to_numpy(zero_copy_only=False)))


def text_of_one_hot(df: DataFrame, bases: str, column: str = "v", out: str = "sequence") -> DataFrame:
    """The sequence of each one-hot vector, as a column; a block of zeros is N, and a null vector stays null."""
    names = np.frombuffer((bases + "N").encode(), np.uint8)

    def compute(columns: list[pa.Array]) -> list[pa.Array]:
        flat, at = flat_lists(columns[0])
        sizes = np.diff(at) // 4
        blocks = flat[ranges(np.repeat(at[:-1], sizes) + ranges(np.zeros(len(sizes), np.int64), sizes) * 4, np.full(int(sizes.sum()), 4))].reshape(-1, 4) != 0
        code = np.where(blocks.any(1), blocks.argmax(1), OTHER)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        texts = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(names[code]))).cast(pa.string())
        return [_masked(texts, columns[0])]

    return map_columns(df, [F.col(column)], [T.StructField(out, T.StringType())], lambda: compute)


def one_hot_signals(df: DataFrame, bases: str, seq_col: str = "sequence", signal: str = "signal", out: str = "v") -> DataFrame:
    """The one-hot vector of each sequence whose hot value is 1 + the signal at that base (0 where the signal ends or is null)."""

    def make():
        table = code_table(bases)

        def compute(columns: list[pa.Array]) -> list[pa.Array]:
            code, at = letters(columns[0], table)
            flat, begin = flat_lists(columns[1])
            values, n = np.ones(len(code)), np.minimum(np.diff(at), np.diff(begin))
            values[ranges(at[:-1], n)] += np.nan_to_num(flat[ranges(begin[:-1], n)])
            return [_masked(lists(encoded(code, values), 4 * at), columns[0])]

        return compute

    return map_columns(df, [F.col(seq_col), F.col(signal)], [T.StructField(out, T.ArrayType(T.DoubleType()))], make)


def gram_matrices(flat: np.ndarray, at: np.ndarray, n: int, alphabet: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of the n-gram matrices of encoded vectors, about BLOCK numbers at a time: the vector of each row, and its n * alphabet numbers."""
    width = n * alphabet
    held = np.maximum(np.diff(at) // alphabet - n + 1, 0)
    starts, vector = ranges(at[:-1], held, alphabet), np.repeat(np.arange(len(held)), held)
    if not len(starts):
        return
    windows, step = np.lib.stride_tricks.sliding_window_view(flat, width), max(1, BLOCK // width)
    for a in range(0, len(starts), step):
        yield vector[a : a + step], windows[starts[a : a + step]]


def gram_counts(df: DataFrame, n: int, column: str = "v", out: str = "grams", alphabet: int = 4) -> DataFrame:
    """How many n-grams (rows of the n-gram matrix: n * alphabet numbers, moved by alphabet) each encoded vector has.

    The matrix is made, some rows at a time, and its rows are counted, so that a long vector needs no more memory than a short one.
    """

    def compute(columns: list[pa.Array]) -> list[pa.Array]:
        flat, at = flat_lists(columns[0])
        held = np.zeros(len(at) - 1, np.int32)
        for vector, matrix in gram_matrices(flat, at, n, alphabet):
            first = np.flatnonzero(np.concatenate([[True], vector[1:] != vector[:-1]]))
            held[vector[first]] += np.diff(np.append(first, len(matrix))).astype(np.int32)
        return [_masked(pa.array(held), columns[0])]

    return map_columns(df, [F.col(column)], [T.StructField(out, T.IntegerType())], lambda: compute)


def gram_norms(df: DataFrame, n: int, column: str = "v", out: str = "norm", alphabet: int = 4) -> DataFrame:
    """The length of the sum of each encoded vector's n-grams; 0 without any.

    The sum's number at a place is a difference of running sums over the vector's letters, so no n-gram is stored.
    """

    def compute(columns: list[pa.Array]) -> list[pa.Array]:
        flat, at = flat_lists(columns[0])
        norms = np.zeros(len(at) - 1)
        for i, (a, z) in enumerate(zip(at[:-1], at[1:], strict=True)):
            rows = (z - a) // alphabet
            if rows >= n:
                sums = np.concatenate([np.zeros((1, alphabet)), np.cumsum(flat[a : a + rows * alphabet].reshape(-1, alphabet), axis=0)])
                norms[i] = np.sqrt(((sums[rows - n + 1 : rows + 1] - sums[:n]) ** 2).sum())
        return [_masked(pa.array(norms), columns[0])]

    return map_columns(df, [F.col(column)], [T.StructField(out, T.DoubleType())], lambda: compute)
