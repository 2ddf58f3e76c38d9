"""Column functions over base sequences and feature arrays, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed base orders; each belongs to one function.
ONE_HOT_BASES, KMER_BASES, PWM_BASES = "ATCG", "ATGC", "ACGT"


def steps(first, last) -> Column:
    """first to last by one, or nothing if last comes before first."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def once(value: Column) -> Column:
    """An array column computed once a row: the generator keeps the optimizer from copying its expression into each use."""
    return F.explode(F.array(value))


def pieces(seq: Column, size: int = 256, overlap=0) -> Column:
    """The sequence cut every size letters, each piece reaching overlap letters into the next.

    Looking up a letter costs as much as its place, so long sequences are cut before they are looked into.
    """
    overlap = F.lit(overlap) if isinstance(overlap, int) else overlap
    return F.transform(steps(0, F.ceil(F.length(seq) / size).cast("int") - 1), lambda i: F.substring(seq, i * size + 1, overlap + size))


def cuts_of(seq: Column, k: int) -> Column:
    """All substrings of length k, in order."""
    return F.flatten(F.transform(pieces(seq, overlap=k - 1), lambda p: F.transform(steps(1, F.length(p) - (k - 1)), lambda i: F.substring(p, i, F.lit(k)))))


def bases(seq: Column) -> Column:
    """Array of single bases."""
    return cuts_of(seq, 1)


def one_hot(seq: Column) -> Column:
    """Four numbers a base, in the order A, T, C, G; other letters give zeros."""
    return F.flatten(F.transform(bases(seq), lambda b: F.array(*[(b == x).cast("double") for x in ONE_HOT_BASES])))


def one_hot_text(vector: Column) -> Column:
    """The sequence of a one-hot vector; a block of zeros is N."""

    def base(i):
        block = F.slice(vector, i * 4 + 1, F.lit(4))
        at = F.array_position(F.transform(block, lambda v: v != 0), True)
        return F.when(at == 0, F.lit("N")).otherwise(F.substring(F.lit(ONE_HOT_BASES), at.cast("int"), F.lit(1)))

    return F.array_join(F.transform(steps(0, F.floor(F.size(vector) / 4).cast("int") - 1), base), "")


def one_hot_signal(seq: Column, signal: Column) -> Column:
    """One-hot vector whose hot value is 1 + the signal at that base (0 where the signal ends)."""
    return F.flatten(
        F.transform(bases(seq), lambda b, i: F.array(*[F.when(b == x, 1.0 + F.coalesce(F.get(signal, i), F.lit(0.0))).otherwise(0.0) for x in ONE_HOT_BASES]))
    )


def ngrams(vector: Column, n: int, alphabet: int = 4) -> Column:
    """All n-grams of an encoded vector: windows of n * alphabet numbers, moved by alphabet."""
    rows = F.floor(F.size(vector) / alphabet).cast("int") - n
    return F.transform(steps(0, rows), lambda i: F.slice(vector, i * alphabet + 1, F.lit(n * alphabet)))


def conv_norm(grams: Column) -> Column:
    """Square root of the sum of all inner products of n-grams: the length of their sum."""
    zero = F.transform(F.element_at(grams, 1), lambda _: F.lit(0.0))
    total = F.aggregate(grams, zero, lambda acc, g: F.zip_with(acc, g, lambda a, b: a + b))
    return F.when(F.size(grams) > 0, F.sqrt(F.aggregate(total, F.lit(0.0), lambda acc, v: acc + v * v))).otherwise(0.0)


def footprint(signal: Column) -> Column:
    """Multiscale footprint of a signal of length L: its total, then for scales s = 1 to
    floor(log2 L) the share of each left half in its block, of 2**(s - 1) blocks."""
    n = F.size(signal)
    scales = F.floor(F.log2(n.cast("double")) + 1e-9).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)

    def scale(s):
        blocks = F.pow(F.lit(2), s - 1).cast("int")
        width = F.floor(n / blocks).cast("int")
        half = F.floor(width / 2).cast("int")

        def share(k):
            whole = total(F.slice(signal, k * width + 1, width))
            return total(F.slice(signal, k * width + 1, half)) / F.when(whole == 0, 1.0).otherwise(whole)

        return F.transform(steps(0, blocks - 1), share)

    return F.when(n == 0, F.array().cast("array<double>")).otherwise(F.concat(F.array(total(signal)), F.flatten(F.transform(steps(1, scales), scale))))


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length k that hold A, C, G and T only."""
    return F.filter(cuts_of(seq, k), lambda s: ~s.rlike("[^ACGT]"))


def kmer_index(kmer: Column, k: int) -> Column:
    """Place of a k-mer in the enumeration of all, base order A, T, G, C, first base slowest."""
    out = F.lit(0).cast("long")
    for i in range(k):
        base = F.substring(kmer, i + 1, 1)
        out = out * 4 + F.coalesce(*[F.when(base == b, F.lit(code)) for code, b in enumerate(KMER_BASES)])
    return out


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def signal_or_zeros(signal: Column, size: int) -> Column:
    """The signal, or zeros where it is null or empty."""
    return F.when(F.coalesce(F.size(signal), F.lit(0)) > 0, signal).otherwise(F.array_repeat(F.lit(0.0), size))
