"""MinHash near-dedup with odd sketches.

1. Every text becomes a set of hashed word shingles; equal sets are one class.
2. A class has a MinHash sample of BANDS x ROWS values.  Bands of ROWS values are bucket keys; the whole
   sample is folded into an odd sketch, a bitmap in which each value flips one bit.  The XOR of two
   sketches is the sketch of what differs, and its population count estimates the similarity.
3. Members of a bucket meet by their sketches.  Pairs whose estimate is far below the threshold go, by a margin of
   six standard deviations and more; the others chain classes into groups.
4. In each group, full sets confirm the pairs whose sketches are near enough, nearest first, until all
   that can be linked is.  Only the sets of such groups are made, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._common import bounded_batches, stored
from ._groups import group_links, joined
from ._shingles import buffers, mix, shingle_sets

#: At similarity 0.8 all bands miss a pair with probability (1 - 0.8**4)**32, 5e-8.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch; estimates within MARGIN of the threshold are not trusted.  At 0.8 a sample of 128 has a deviation of 0.035.
SKETCH_BITS, MARGIN = 512, 0.24
WORDS = SKETCH_BITS // 64
#: Larger buckets are chained whole; the groups' own comparison parts them again.
BUCKET = 512
#: Bits of the filter that tells which sets are wanted.
LEAST_FILTER, MOST_FILTER = 1 << 16, 1 << 26
_SEEN = 1 << 20
_RNG = np.random.default_rng(6007)
_XOR = _RNG.integers(1, 2**63, SAMPLES, dtype=np.uint64)
_TIMES = _RNG.integers(1, 2**63, SAMPLES, dtype=np.uint64) | np.uint64(1)
_BAND = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_FOLD = _RNG.integers(1, 2**63, SAMPLES, dtype=np.uint64)
_SKETCH = [f"s{i}" for i in range(WORDS)]


def min_hashes(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The least of SAMPLES permutations for each set; values holds the sets (not empty) on end."""
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), SAMPLES), np.uint64)
    at, room = 0, 1 << 15  # values that stay in the cache
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + room)))
        some = values[starts[at] : starts[to] if to < len(sizes) else len(values)]
        begin = starts[at:to] - starts[at]
        for i in range(SAMPLES):
            out[at:to, i] = np.minimum.reduceat((some ^ _XOR[i]) * _TIMES[i], begin)
        at = to
    return out


def odd_sketches(least: np.ndarray) -> np.ndarray:
    """A bitmap for each row in which every value flips one bit."""
    bit = (mix(least ^ _FOLD) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    bit += np.arange(len(least))[:, None] * SKETCH_BITS
    odd = np.bincount(bit.ravel(), minlength=len(least) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).reshape(-1).view(np.int64).reshape(len(least), WORDS)


def band_keys(least: np.ndarray) -> np.ndarray:
    return mix((least.reshape(-1, BANDS, ROWS) * _BAND).sum(2, dtype=np.uint64) + _BAND[:, 0]).view(np.int64)


def similarity(differing: np.ndarray | int) -> np.ndarray:
    """Estimated similarity of two sets whose sketches differ in so many bits."""
    left = np.maximum(1 - 2 * np.asarray(differing) / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / 2 * np.log(left) / (2 * SAMPLES)


def most_differing(share: int) -> int:
    """Bits in which sketches may differ before a similarity of share % is ruled out."""
    bits = np.arange(SKETCH_BITS // 2)
    return int(bits[similarity(bits) >= share / 100 - MARGIN].max())


def _least_size(share: int) -> int:
    """Smaller sets only link with equal ones."""
    return -(-share // (100 - share)) if share < 100 else 1 << 62


def _sets(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Shingles, set sizes and set signatures of runs of texts."""
    data, offsets = buffers(column)
    for a in range(0, len(column), 512):
        z = min(a + 512, len(column))
        values, sizes = shingle_sets(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], k)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ np.uint64(0xD6E8FEB86659FD93)), out=sums[1:])
        ends = np.cumsum(sizes)
        yield values, sizes, mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)


def _new(seen: set[int], signatures: np.ndarray, able: np.ndarray) -> np.ndarray:
    """Which able sets this task has not met before, as far as it remembers."""
    if len(seen) > _SEEN:
        seen.clear()
    out = np.zeros(len(signatures), bool)
    for i in np.flatnonzero(able).tolist():
        if (s := int(signatures[i])) not in seen:
            seen.add(s)
            out[i] = True
    return out


def _measure(k: int, least_size: int):
    """Rows (id, text) to (id, n, sig, bands, sketch); equal sets of a task get their bands and sketch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in filter(len, batches):
            done = 0
            for values, sizes, signatures in _sets(b.column(1), k):
                new = _new(seen, signatures, sizes >= least_size)
                n = int(new.sum())
                least = min_hashes(values[np.repeat(new, sizes)], sizes[new]) if n else np.zeros((0, SAMPLES), np.uint64)
                place = np.full(len(sizes), -1)
                place[new] = np.arange(n)
                at = pa.array(place, mask=place < 0)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(band_keys(least).ravel()))
                sketch = odd_sketches(least) if n else np.zeros((0, WORDS), np.int64)
                columns = [b.column(0).slice(done, len(sizes)), pa.array(sizes.astype(np.int64)), pa.array(signatures), bands.take(at), *(pa.array(np.ascontiguousarray(sketch[:, i])).take(at) for i in range(WORDS))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "sig", "bands", *_SKETCH])
                done += len(sizes)

    return run


def _wanted(k: int, least_size: int, sent, bits: int):
    """Texts to (sig, shingles) of the sets that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(sent.value, np.uint8), bitorder="little").astype(bool)
        seen: set[int] = set()
        for b in filter(len, batches):
            for values, sizes, signatures in _sets(b.column(0), k):
                some = _new(seen, signatures, (sizes >= least_size) & held[signatures & (bits - 1)])
                at = np.concatenate([[0], np.cumsum(sizes[some])])
                sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.sort(values.view(np.int64)[np.repeat(some, sizes)]) if some.sum() == 1 else _sorted(values[np.repeat(some, sizes)].view(np.int64), sizes[some])))
                yield pa.RecordBatch.from_arrays([pa.array(signatures[some]), sets], names=["sig", "shingles"])

    return run


def _sorted(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of each set in signed order."""
    return values[np.lexsort((values, np.repeat(np.arange(len(sizes)), sizes)))]


# --- pairs -----------------------------------------------------------------------------


def _bits(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words.view(np.uint64)).sum(-1, dtype=np.int64)  # of signed numbers numpy counts the absolute value


def _near(sketches: np.ndarray, sizes: np.ndarray, share: int, most: int, other: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j, i in other, whose sketches and sizes do not rule out a link, and the bits that differ."""
    some, sketches = np.arange(len(sketches))[other], np.ascontiguousarray(sketches).view(np.uint64)
    differ = np.zeros((len(some), len(sketches)), np.int64)
    for w in range(WORDS):
        differ += np.bitwise_count(sketches[some, w][:, None] ^ sketches[None, :, w])
    fits = (differ <= most) & (100 * np.minimum(sizes[some][:, None], sizes) >= share * np.maximum(sizes[some][:, None], sizes)) & (some[:, None] < np.arange(len(sketches)))
    i, j = np.nonzero(fits)
    return some[i], j, differ[i, j]


class _Joined:
    """Components of a few members."""

    def __init__(self, n: int):
        self.parent, self.parts = list(range(n)), n

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)
        self.parts -= a != b
        return a != b


def sorted_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, by which they are sorted."""
    held: list[pa.RecordBatch] = []
    for b in filter(len, batches):
        name = b.column(0).to_pylist()
        cut = [0, *(i for i in range(1, len(b)) if name[i] != name[i - 1]), len(b)]
        for s, e in zip(cut, cut[1:], strict=False):
            if held and held[0].column(0)[0].as_py() != name[s]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _numbers(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in names], -1)


def _bucket_edges(share: int, most: int):
    """Rows (key, sig, n, sketch) sorted by key to edges that chain the near members of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_parts(batches):
            sig, sizes, sketches = t.column("sig").to_numpy(), t.column("n").to_numpy(), _numbers(t, _SKETCH)
            joined, a, b = _Joined(len(sig)), [], []
            i, j, _ = _near(sketches, sizes, share, most, slice(None))
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                if joined.join(x, y):
                    a.append(sig[x])
                    b.append(sig[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= share * (len(a) + len(b) - both)


def _confirm(share: int, most: int):
    """Rows (part, core, sig, n, sketch, shingles) sorted by part to confirmed links that join the members of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_parts(batches):
            t = t.combine_chunks()
            sig, sizes, sketches, core = t.column("sig").to_numpy(), t.column("n").to_numpy(), _numbers(t, _SKETCH), t.column("core").to_numpy(zero_copy_only=False)
            shingles = t.column("shingles").combine_chunks()
            if isinstance(shingles, pa.ChunkedArray):
                shingles = shingles.chunk(0)
            at, flat = shingles.offsets.to_numpy(), shingles.values.to_numpy(zero_copy_only=False)
            joined, a, b = _Joined(len(sig)), [], []
            inner = np.flatnonzero(core)
            for i in inner[1:].tolist():
                joined.join(int(inner[0]), i)
            pairs = _near(sketches, sizes, share, most, slice(None))
            for k in np.argsort(pairs[2], kind="stable").tolist():
                i, j = int(pairs[0][k]), int(pairs[1][k])
                if joined.root(i) != joined.root(j) and _linked(flat[at[i] : at[i + 1]], flat[at[j] : at[j + 1]], share):
                    joined.join(i, j)
                    a.append(sig[i])
                    b.append(sig[j])
                    if joined.parts == 1:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _meet(share: int, most: int):
    """Rows (sig, n, sketch, shingles, pivots) to links with the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            sketches, sizes, sigs = _numbers(pa.Table.from_batches([batch]), _SKETCH), batch.column(batch.schema.names.index("n")).to_numpy(), batch.column(batch.schema.names.index("sig")).to_pylist()
            for i, (own, pivots) in enumerate(zip(batch.column(batch.schema.names.index("shingles")), batch.column(batch.schema.names.index("pivots")), strict=True)):
                for p in pivots:
                    n = p["n"].as_py()
                    sketch = np.array([p[c].as_py() for c in _SKETCH])
                    if _bits(sketch ^ sketches[i]) > most or 100 * min(n, sizes[i]) < share * max(n, sizes[i]):
                        continue
                    if _linked(np.asarray(own.values), np.asarray(p["shingles"].values), share):
                        a.append(sigs[i])
                        b.append(p["sig"].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


# --- the operator ----------------------------------------------------------------------


def _possible(x: str, y: str, share: int, most: int) -> Column:
    """Whether two classes' sketches and sizes do not rule out a link."""
    differ = " + ".join(f"bit_count({x}.{c} ^ {y}.{c})" for c in _SKETCH)
    return F.expr(f"{differ} <= {most} AND 100 * least({x}.n, {y}.n) >= {share} * greatest({x}.n, {y}.n)")


def near_duplicates(docs: DataFrame, share: int = 80, k: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    A set holds the distinct k-word shingles of the whole text with A-Z lowered; a text of fewer words has its word
    sequence as its one shingle, one without words an empty set.  Sets link when 100 * shared >= share * united (share
    of 80 or more, for which the bands are made), confirmed on full sets; component_id is the smallest doc_id reachable,
    and kept tells the rows whose id it is.  A text without words is linked with nothing and is kept.  Null ids never are the
    smallest: such a row is kept only if no row of its component has an id.  Repeated rows are linked copies, of which
    all with the smallest id are kept; an empty table gives an empty result; other columns are not read.  Shingles are told apart
    by 64-bit hashes.  A link at the threshold is missed with a probability of 5e-8, closer ones with less.
    """
    if share < 80:
        raise ValueError("the bands are made for similarities of 80 % and more")
    spark = docs.sparkSession
    bounded_batches(spark)
    most, least_size = most_differing(share), _least_size(share)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    form = "id long, n long, sig long, bands array<long>, " + ", ".join(f"{c} long" for c in _SKETCH)
    measured = stored(base.mapInArrow(_measure(k, least_size), form))
    texts = measured.select("id", "n", "sig")
    classes = texts.filter("n > 0").groupBy("sig").agg(F.min("id").alias("least"))
    made = measured.filter("bands IS NOT NULL")
    sketched = stored(made.groupBy("sig").agg(*[F.first(c).alias(c) for c in ("n", "bands", *_SKETCH)]))
    sketches = sketched.drop("bands")

    # buckets: members meet the first of their bucket; where that leaves some apart, all members meet
    rows = sketched.select("sig", F.explode("bands").alias("key"))
    keys = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("sig").alias("a")).filter("m > 1")
    shared = stored(rows.join(keys.hint("merge"), "key"))  # at every size the join whose hot keys are split
    stars = shared.filter("sig <> a").groupBy("a", "sig").agg(F.max("m").alias("m"))
    x, y = (sketches.select(F.col("sig").alias(c), F.struct("n", *_SKETCH).alias(v)) for c, v in (("a", "x"), ("sig", "y")))
    tried = stored(stars.join(y, "sig").join(x, "a").select("a", "sig", "m", _possible("x", "y", share, most).alias("near")))
    apart = tried.filter("NOT near AND m > 2").select("a", "sig")
    open_keys = shared.join(apart, ["a", "sig"]).filter(f"m > 2 AND m <= {BUCKET}").select("key").distinct()
    met = shared.join(open_keys, "key", "left_semi").select("key", "sig").join(sketches, "sig").select("key", "sig", "n", *_SKETCH)
    edges = met.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_edges(share, most), "a long, b long")
    whole = shared.filter(f"m > {BUCKET} AND sig <> a").select("a", F.col("sig").alias("b"))
    chained = joined(tried.filter("near").select("a", F.col("sig").alias("b")).unionByName(edges).unionByName(whole))
    member = stored(chained.unionByName(chained.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "sig"))

    # full sets of the members, which a filter of bounded size picks while texts are read
    bits = min(MOST_FILTER, max(LEAST_FILTER, 1 << int(16 * member.count()).bit_length()))
    at = F.col("sig").bitwiseAND(bits - 1)
    words = member.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((sig & {bits - 1}) & 63 AS int))")).alias("bits")).toArrow()
    filter_words = np.zeros(bits // 64, np.int64)
    filter_words[words.column(0).to_numpy()] = words.column(1).to_numpy()
    sent = spark.sparkContext.broadcast(filter_words.tobytes())
    sets = base.select("t").mapInArrow(_wanted(k, least_size, sent, bits), "sig long, shingles array<long>")
    sets = sets.join(member.select("sig"), "sig", "left_semi").groupBy("sig").agg(F.first("shingles").alias("shingles"))
    sets = stored(sketches.join(sets, "sig").select("sig", "n", *_SKETCH, "shingles"))
    grouped = stored(member.join(sketches.select("sig", F.col("n").alias("size")), "sig").select("sig", "size", F.col("root").alias("group")))
    linked = joined(group_links(grouped, sets, _meet(share, most), _confirm(share, most)))

    rooted = classes.join(linked.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.select("sig", "root").join(smallest, "root").select("sig", "component_id")
    out = texts.join(found, "sig", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON r.r = l.a)
SELECT d AS doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(r) AS component_id, d = min(r) AS kept FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY d"""
