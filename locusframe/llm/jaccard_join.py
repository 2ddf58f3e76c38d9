"""N-gram Jaccard join with tries over globally ordered shingle sets.

1. Every text becomes a set of hashed word shingles; equal sets are one class.
2. Shingles are counted over all classes.  Shingles that exactly the same texts hold are one
   run, with their number as its weight: a set is a short list of weighted runs.
3. With runs ordered rare first, a class can only have partners if enough of its shingles
   are not its own alone, and partners share a run among the first few, the prefix.
   Classes are grouped by prefix run, or, where that copies less, by chains of such runs.
4. Each group's sets are stored in a trie.  One walk of the trie carries the overlaps of
   all sets of the group with the path so far, and leaves a subtree when what remains of
   either side cannot reach the overlap that the threshold needs.
Groups of any size are met: large ones are cut into blocks, of which every pair that
could still hold a link between different components is walked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import bounded_batches, stored
from ._components import components, join_counted
from ._shingles import buffers, mix, shingle_sets

#: Sets and runs of shingles of one block; pivots drawn from a group that needs several blocks.
BLOCK_SETS, BLOCK_SHINGLES, PIVOTS = 256, 1 << 19, 12
#: A shingle is hot if a 256th of all texts hold it: at most 256 times the mean set size are.
HOT_SHARE = 256
_CHUNK_TEXTS, _CHUNK_SHINGLES = 8192, 3 << 20
#: Shingles of one part of the count.
PART_SHINGLES = 1_500_000
_SEEN = 1 << 20


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts (from, to) with their shingles, set sizes and set signatures."""
    data, offsets = buffers(column)
    step = 512
    for a in range(0, len(column), step):
        z = min(a + step, len(column))
        values, sizes = shingle_sets(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], k)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ np.uint64(0xD6E8FEB86659FD93)), out=sums[1:])
        ends = np.cumsum(sizes)
        signatures = mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)
        yield a, z, values.view(np.int64), sizes, signatures


def _needed(n: np.ndarray | int, share: int) -> np.ndarray:
    """ceil(share % of n)"""
    return -(-share * n // 100)


# --- sets and counts -------------------------------------------------------------------


def _measure(k: int):
    """Rows of texts (id, n, sig), and of shingles frequent within a chunk (sig, n as shingle, count)."""

    def run(batches):
        held, texts, count = [], 0, 0

        def frequent():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(8, texts // HOT_SHARE // 2)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(int(often.sum()), pa.int64()), pa.array(n[often]), pa.array(values[often]), pa.array(np.ones(often.sum(), bool))], names=["id", "n", "sig", "shingle"]
            )

        for b in batches:
            n, sig = [], []
            for _, _, values, sizes, signatures in _sets(b.column(1), k):
                n.append(sizes)
                sig.append(signatures)
                held.append(values)
                texts, count = texts + len(sizes), count + len(values)
                if texts >= _CHUNK_TEXTS or count >= _CHUNK_SHINGLES:
                    yield frequent()
                    held, texts, count = [], 0, 0
            if n:
                sizes = np.concatenate(n)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes.astype(np.int64)), pa.array(np.concatenate(sig)), pa.array(np.zeros(len(sizes), bool))], names=["id", "n", "sig", "shingle"])
        if held:
            yield frequent()

    return run


def _packed(shingle: np.ndarray, owner: np.ndarray) -> bytes:
    """Sorted shingles as differences of as few bytes as they need, then their owners (below 2**16)."""
    order = np.argsort(shingle)
    shingle, owner = shingle[order], owner[order]
    step = np.diff(shingle, prepend=shingle[:1])
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    planes = step.view(np.uint8).reshape(-1, 8)[:, :width]
    return b"".join([np.array([len(shingle), width], np.int32).tobytes(), shingle[:1].tobytes(), planes.tobytes(), owner.astype(np.uint16).tobytes()])


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = np.frombuffer(data, np.int32, 2).tolist()
    step = np.zeros((n, 8), np.uint8)
    step[:, :width] = np.frombuffer(data, np.uint8, n * width, 16).reshape(n, width)
    first = np.frombuffer(data, np.uint64, 1, 8)[0]
    return np.cumsum(step.reshape(-1).view(np.uint64)) + first, np.frombuffer(data, np.uint16, n, 16 + n * width)


def _postings(k: int, hot: np.ndarray, parts: int):
    """(part, base, data): the shingles of one part that a run of texts holds, and which text of it does.

    Part -1 holds what needs no counting: for each text its size, its signature and its hot
    shingles, as (text, count, value) in three arrays.
    """
    hot = hot.view(np.uint64)
    hot.sort()

    def run(batches):
        from pyspark import TaskContext

        seen: set[int] = set()
        base, texts, held = TaskContext.get().partitionId() << 40, 0, []

        def flush():
            shingle, owner = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            fixed = [np.concatenate([h[i] for h in held]) for i in (2, 3, 4)]
            rows = [(-1 - (base >> 16) % parts, np.array([len(fixed[0])], np.int64).tobytes() + b"".join(x.astype(np.int64).tobytes() for x in fixed))]
            part = (shingle % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
            shingle, owner, part = shingle[order], owner[order], part[order]
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
            for a, z in zip(starts, [*starts[1:], len(part)], strict=False):  # both may be empty but for the end
                rows.append((int(part[a]), _packed(shingle[a:z], owner[a:z])))
            for at in range(0, len(rows), 64):
                some = rows[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int32()), pa.array([base] * len(some), pa.int64()), pa.array([r[1] for r in some], pa.binary())], names=["part", "base", "data"])

        for b in batches:
            for _, _, values, sizes, signatures in _sets(b.column(0), k):
                new = np.zeros(len(sizes), bool)
                for i, s in enumerate(signatures.tolist()):
                    if sizes[i] and s not in seen:
                        new[i] = True
                        seen.add(s)
                if len(seen) > _SEEN:
                    seen.clear()
                own = np.arange(texts, texts + int(new.sum()))
                shingle, owner = values[np.repeat(new, sizes)].view(np.uint64), np.repeat(own, sizes[new])
                at = np.minimum(np.searchsorted(hot, shingle), max(0, len(hot) - 1))
                is_hot = hot[at] == shingle if len(hot) else np.zeros(len(shingle), bool)
                fixed = (np.concatenate([own, own, owner[is_hot]]), np.concatenate([np.full(len(own), -1), np.zeros(len(own), int), np.full(int(is_hot.sum()), 1 << 30)]), np.concatenate([sizes[new], signatures[new], shingle[is_hot].view(np.int64)]))
                held.append((shingle[~is_hot], owner[~is_hot], *fixed))
                texts += len(own)
                if sum(len(h[0]) for h in held) > _CHUNK_SHINGLES or texts > (1 << 16) - 600:
                    yield from flush()
                    base, texts, held = base + (1 << 16), 0, []
        if held:
            yield from flush()

    return run


def _shared(batches):
    """From postings sorted by part: (ref, count, value, weight) of the runs of shingles that several texts hold, and of all fixed values."""

    def out(ref, count, value, weight):
        return pa.RecordBatch.from_arrays([pa.array(ref), pa.array(count.astype(np.int32)), pa.array(value), pa.array(weight.astype(np.int32))], names=["ref", "count", "value", "weight"])

    def shared(held):
        shingle, ref = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        order = np.argsort(shingle)
        shingle, ref = shingle[order], ref[order]
        starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        count = np.diff(np.append(starts, len(shingle)))
        holders = mix(np.add.reduceat(mix(ref.view(np.uint64)), starts)) if len(starts) else shingle  # of the texts that hold the shingle
        keep = np.repeat(count > 1, count)
        ref, run, count = ref[keep], np.repeat(holders, count)[keep].view(np.int64), np.repeat(count, count)[keep]
        order = np.lexsort((run, ref))  # equal references side by side take less room in the shuffle
        ref, run, count = ref[order], run[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], (ref[1:] != ref[:-1]) | (run[1:] != run[:-1])])) if len(ref) else np.zeros(0, np.int64)
        return out(ref[first], count[first], run[first], np.diff(np.append(first, len(ref))))

    name, held = None, []
    for b in batches:
        for part, base, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            raw = data.as_py()
            if part < 0:
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                owner, count, value = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n)
                yield out(base + owner, count, value, np.ones(n))
                continue
            if part != name:
                if held:
                    yield shared(held)
                name, held = part, []
            shingle, owner = _unpacked(raw)
            held.append((shingle, base + owner.astype(np.int64)))
    if held:
        yield shared(held)


def _ordered(share: int):
    """From rows sorted by ref: sig, n and the shared runs of each text with their weights, rare first, if they are enough to link.

    prefix tells how many runs hold the first shingles of which partners share one.
    """

    def sets(ref, count, value, weight):
        order = np.lexsort((value, count, ref))
        ref, count, value, weight = ref[order], count[order], value[order], weight[order]
        new = np.flatnonzero(np.concatenate([[True], (ref[1:] != ref[:-1]) | (count[1:] != count[:-1]) | (value[1:] != value[:-1])]))
        ref, value, weight = ref[new], value[new], np.add.reduceat(weight.astype(np.int64), new)  # parts of one run
        first = np.flatnonzero(np.concatenate([[True], ref[1:] != ref[:-1]]))
        last = np.append(first[1:], len(ref))
        n, sig = value[first], value[first + 1]
        before = np.concatenate([[0], np.cumsum(weight)])
        total = before[last] - before[first + 2]
        need = _needed(n, share)
        good = np.flatnonzero(total >= need)
        inside = before[:-1] - np.repeat(before[first + 2], last - first) <= np.repeat(total - need, last - first)
        inside = np.concatenate([[0], np.cumsum(inside)])
        runs = [value[first[i] + 2 : last[i]] for i in good]
        weights = [weight[first[i] + 2 : last[i]] for i in good]
        prefix = inside[last[good]] - inside[first[good] + 2]
        return pa.RecordBatch.from_arrays(
            [pa.array(sig[good]), pa.array(n[good]), pa.array(prefix.astype(np.int32)), pa.array(runs, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.int64()))], names=["sig", "n", "prefix", "runs", "weights"]
        )

    def run(batches):
        rest = [np.zeros(0, np.int64)] * 4
        for b in batches:
            held = [np.concatenate([r, b.column(i).to_numpy()]) for i, r in enumerate(rest)]
            stop = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if stop:
                yield sets(*(h[:stop] for h in held))
            rest = [h[stop:] for h in held]
        if len(rest[0]):
            yield sets(*rest)

    return run


# --- the trie --------------------------------------------------------------------------


def trie_links(
    sets: list[np.ndarray], sizes: np.ndarray, share: int = 75, labels: np.ndarray | None = None, weights: list[np.ndarray] | None = None
) -> list[tuple[int, int]]:
    """Links (i, j) that join all sets of similarity share % or more into their components.

    sets hold integers (equal ones are equal runs of shingles), weights the shingles of each (1 if not
    given; equal runs weigh the same), sizes the full set sizes.  Sets of one label count as joined
    already, and links that join nothing new are left out.
    """
    n = len(sets)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if labels is not None:
        first: dict = {}
        for i, x in enumerate(labels.tolist()):
            if x is not None and x >= 0:
                parent[root(i)] = root(first.setdefault(x, i))
    flat = np.concatenate(sets) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, local, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often > 1
    order = np.empty(len(values), np.int64)  # most common first, so that alike sets share long paths
    order[np.lexsort((values, -often))] = np.arange(len(values))
    weight = np.ones(len(values), np.int64)
    if weights is not None and n:
        weight[order[local]] = np.concatenate(weights)
    keep = shared[local]
    local, owner = order[local[keep]], owner[keep]
    width = int(shared.sum())
    by = np.lexsort((local, owner))
    local, owner = local[by], owner[by]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    paths = [local[bounds[i] : bounds[i + 1]] for i in range(n)]
    summed = np.concatenate([[0], np.cumsum(weight[local])])
    lengths = summed[bounds[1:]] - summed[bounds[:-1]]
    able = [i for i in range(n) if lengths[i] and lengths[i] >= _needed(int(sizes[i]), share)]
    if len(able) < 2:
        return []
    able.sort(key=lambda i: paths[i].astype(">i8").tobytes())  # in trie order: equal beginnings are neighbours
    common = [_common(paths[a], paths[b]) for a, b in zip(able, able[1:], strict=False)]
    links: list[tuple[int, int]] = []
    rows = max(1, (32 << 20) // max(width, 1))
    for at in range(0, len(able), rows):
        ask = np.array(able[at : at + rows])
        member = np.zeros((len(ask), width), bool)
        for r, i in enumerate(ask.tolist()):
            member[r, paths[i]] = True
        for r, j in _walk(able, common, paths, sizes, lengths, weight[:width], ask, member, share):
            for i in ask[r].tolist():
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((i, j))
    return links


def _common(a: np.ndarray, b: np.ndarray) -> int:
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    return int(differ[0]) if len(differ) else m


def _walk(able, common, paths, sizes, lengths, weight, ask, member, share):
    """Walk the trie once for all asking sets; yields (rows of asking sets, set) that are similar.

    Nodes are ranges of neighbours in trie order that share a path of some depth.
    """
    total = member @ weight
    own = sizes[ask]
    everyone = np.arange(len(ask))
    stack = [(0, len(able), 0, everyone, np.zeros(len(ask), np.int64), np.zeros(len(ask), np.int64))]
    while stack:
        a, z, depth, rows, overlap, passed = stack.pop()
        if z - a == 1:
            to = len(paths[able[a]])
        else:
            to = min(common[a : z - 1])
        piece = paths[able[a]][depth:to]
        if len(piece):
            overlap = overlap + member[np.ix_(rows, piece)] @ weight[piece]
            passed = member[rows, : piece[-1] + 1] @ weight[: piece[-1] + 1]  # shingles of the asking set up to here in the order
        inside = able[a:z]
        least, left = int(sizes[inside].min()), int(lengths[inside].max()) - int(weight[paths[able[a]][:to]].sum())
        bound = overlap + np.minimum(total[rows] - passed, left)
        need = -(-share * (own[rows] + least) // (100 + share))
        on = bound >= need
        rows, overlap, passed = rows[on], overlap[on], passed[on]
        if not len(rows):
            continue
        if z - a == 1:
            j = able[a]
            alike = (100 * overlap >= share * (own[rows] + int(sizes[j]) - overlap)) & (ask[rows] != j)
            if alike.any():
                yield rows[alike], j
            continue
        start = a
        for i in range(a, z):  # children part where neighbours share no more than this path
            if i == z - 1 or common[i] == to:
                if i + 1 - start == 1 and len(paths[able[start]]) == to:
                    j = able[start]
                    alike = (100 * overlap >= share * (own[rows] + int(sizes[j]) - overlap)) & (ask[rows] != j)
                    if alike.any():
                        yield rows[alike], j
                else:
                    stack.append((start, i + 1, to, rows, overlap, passed))
                start = i + 1


def _walk_blocks(share: int):
    """Rows sorted by (part): the links of each part's sets."""

    def run(batches):
        name, held = None, []

        def links():
            sig = np.array([h[0] for h in held])
            found = trie_links([h[2] for h in held], np.array([h[1] for h in held], np.int64), share, np.array([h[4] for h in held], object), [h[3] for h in held])
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(sig[i]), pa.array(sig[j])], names=["a", "b"])

        for b in batches:
            part, sig, n, core = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(5).to_pylist()
            for i, (runs, weights) in enumerate(zip(b.column(3), b.column(4), strict=True)):
                if part[i] != name:
                    if len(held) > 1:
                        yield from links()
                    name, held = part[i], []
                held.append((sig[i], n[i], np.asarray(runs.values), np.asarray(weights.values), 1 if core[i] else None))
        if len(held) > 1:
            yield from links()

    return run


def _meet_pivots(share: int):
    """Links between sets and the pivots of their group."""

    def run(batches):
        for b in batches:
            a, c = [], []
            for sig, n, runs, pivots in zip(*(b.column(i) for i in range(4)), strict=True):
                own, own_n = np.sort(np.asarray(runs.values)), n.as_py()
                for p in pivots:
                    other, other_n = np.asarray(p["runs"].values), p["n"].as_py()
                    at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    both = int(np.asarray(p["weights"].values)[own[at] == other].sum())
                    if 100 * both >= share * (own_n + other_n - both):
                        a.append(sig.as_py())
                        c.append(p["sig"].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return run


# --- the join --------------------------------------------------------------------------


def similarity_components(docs: DataFrame, share: int = 75, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    A set holds the distinct k-word shingles of the whole text with A-Z lowered; a text of
    fewer words has its word sequence as its one shingle, one without words an empty set.
    Sets link when 100 * shared >= share * united (share of 50 or more); component_id is the smallest doc_id
    reachable.  A text without words is linked with nothing and has its own id.  Null ids
    are kept and never are the smallest; repeated rows are linked copies, an empty table
    gives an empty result; other columns are not read.  Shingles are told apart by 64-bit
    hashes.  docs must give the same rows in the same order when read again, as a table does.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    measured = stored(base.mapInArrow(_measure(k), "id long, n long, sig long, shingle boolean"))
    texts = measured.filter("not shingle").select("id", "n", "sig")
    count = texts.count()
    frequent = measured.filter("shingle").groupBy("sig").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(64, count // HOT_SHARE))
    hot = np.array(sorted(r[0] for r in frequent.select("sig").collect()), np.int64)  # bounded, see HOT_SHARE
    classes = texts.filter("n > 0").groupBy("sig").agg(F.min("id").alias("least"), F.first("n").alias("n"))

    total = texts.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_SHINGLES + 1)
    postings = base.select("t").mapInArrow(_postings(k, hot, parts), "part int, base long, data binary")
    shared = postings.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_shared, "ref long, count int, value long, weight int")
    form = "sig long, n long, prefix int, runs array<long>, weights array<long>"
    sets = shared.repartition("ref").sortWithinPartitions("ref").mapInArrow(_ordered(share), form)
    able = stored(sets.groupBy("sig").agg(*[F.first(c).alias(c) for c in ("n", "prefix", "runs", "weights")]))

    # who is compared with whom is settled without the sets, which are joined to it last
    first = able.select("sig", F.explode(F.slice("runs", F.lit(1), F.col("prefix"))).alias("key"))
    keys = first.groupBy("key").agg(F.count("*").alias("m"), F.min("sig").alias("a")).filter("m > 1")
    first = stored(join_counted(first, keys, "key", "m", count))
    total = first.count()
    maybe = components(first.select("a", F.col("sig").alias("b")))
    member = maybe.unionByName(maybe.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "sig")
    grouped = stored(able.select("sig", F.size("runs").alias("size")).join(member, "sig"))
    keyed = first.join(member, "sig")
    blocks = lambda m, w: F.greatest(F.ceil(m / BLOCK_SETS), F.ceil(w / BLOCK_SHINGLES))
    # a chain of classes is one group, or as many as it has keys, whichever copies fewer sets
    chain = grouped.groupBy("root").agg(F.count("*").alias("m"), F.sum("size").alias("w")).withColumn("by_chain", F.col("m") * blocks(F.col("m"), F.col("w")))
    by_key = keyed.groupBy("root").agg(F.sum(F.ceil(F.col("m") / BLOCK_SETS)).alias("by_key"))
    chain = stored(chain.join(by_key, "root").select("root", F.col("m").alias("in_chain"), (F.col("by_key") < F.col("by_chain")).alias("split")))
    whole = join_counted(grouped, chain.filter("not split"), "root", "in_chain", total).select("sig", "size", F.xxhash64(F.lit("chain"), "root").alias("group"))
    split = join_counted(keyed, chain.filter("split"), "root", "in_chain", total).select("sig", F.xxhash64(F.lit("key"), "key").alias("group"))
    grouped = stored(whole.unionByName(split.join(grouped.select("sig", "size"), "sig").select("sig", "size", "group")))
    sums = grouped.groupBy("group").agg(F.count("*").alias("m"), F.sum("size").alias("w")).filter("m > 1")
    sums = stored(sums.select("group", "m", blocks(F.col("m"), F.col("w")).alias("blocks")))

    # groups of several blocks: most sets link with one of a few pivots and need no comparing among themselves
    several = stored(join_counted(grouped, sums.filter("blocks > 1"), "group", "m", total))
    large = several.groupBy("sig").agg(F.max(F.struct("m", "group")).alias("g")).select("sig", "g.*")
    salts = F.ceil(F.col("m") / (4 * BLOCK_SETS))
    large = large.select("sig", "group", "m", F.pmod(F.xxhash64("sig", F.lit(2)), salts).alias("salt")).join(able, "sig")
    picked = large.filter(F.pmod(F.xxhash64("sig"), F.ceil(F.col("m") / PIVOTS)) == 0)
    pivots = picked.groupBy("group").agg(F.first("m").alias("m"), F.collect_list(F.struct("sig", "n", "runs", "weights")).alias("pivots"))
    pivots = pivots.select("group", "pivots", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    met = stored(large.join(pivots, ["group", "salt"]).select("sig", "n", "runs", "pivots").mapInArrow(_meet_pivots(share), "a long, b long"))
    met_root = components(met)
    met_all = met_root.unionByName(met_root.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("sig"), F.col("root").alias("near"))
    sided = several.select("sig", "group").join(met_all, "sig")
    main = sided.groupBy("group", "near").agg(F.count("*").alias("c")).groupBy("group").agg(F.max(F.struct("c", "near")).alias("x"), F.sum("c").alias("met"))
    core = join_counted(sided, main.select("group", F.col("x.near").alias("main"), "met"), "group", "met", total).filter("near = main").select("sig", "group", F.lit(True).alias("core"))
    split = stored(grouped.join(core, ["sig", "group"], "left").withColumn("core", F.coalesce("core", F.lit(False))))
    sides = split.groupBy("group").agg(F.sum(F.col("core").cast("long")).alias("c")).join(sums, "group")
    part = lambda x: F.ceil(F.col("blocks") * x / F.col("m")).cast("int")
    sides = stored(sides.select("group", "m", part(F.col("c")).alias("gc"), part(F.col("m") - F.col("c")).alias("gn")).filter("gn > 0"))
    placed = join_counted(split, sides, "group", "m", total)
    at = F.pmod(F.xxhash64("sig", F.lit(1)), F.when(F.col("core"), F.greatest("gc", F.lit(1))).otherwise(F.col("gn"))).cast("int")
    placed = placed.withColumn("at", at)
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda kind, i, j: F.concat_ws(":", F.col("group").cast("string"), F.lit(kind), i.cast("string"), j.cast("string"))
    with_core = F.transform(up_to(F.col("gc")), lambda i: name("c", i, F.col("at")))
    among = F.transform(up_to(F.col("gn")), lambda j: name("n", F.least(j, F.col("at")), F.greatest(j, F.col("at"))))
    of_core = F.transform(up_to(F.col("gn")), lambda j: name("c", F.col("at"), j))
    parts = placed.select(F.explode(F.when(F.col("core"), of_core).otherwise(F.concat(with_core, among))).alias("part"), "sig", "core")
    parts = parts.join(able, "sig").select("part", "sig", "n", "runs", "weights", "core")
    links = parts.repartition("part").sortWithinPartitions("part").mapInArrow(_walk_blocks(share), "a long, b long")

    joined = components(met.unionByName(links))
    rooted = classes.select("sig", "least").join(joined.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.select("sig", "root").join(smallest, "root").select("sig", "component_id")
    out = texts.join(found, "sig", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON r.r = l.a)
SELECT d AS doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(r) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY d"""
