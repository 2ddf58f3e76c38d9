"""Audit of how sources diverge, by a recount with minimal perfect hashes.

1. A first pass counts the documents of every (lang, term) exactly and keeps the frequent terms.
2. The kept terms of a language are dealt to shards; each shard gets a minimal perfect hash, level by
   level: bits where exactly one key falls, the others try the next level; a key's slot is the rank
   of its bit.  The keys are stored in slot order.
3. The shards are broadcast, in waves of bounded bytes.  A second pass looks every term up, compares
   it with the key stored at its slot, and increments the dense slots of its (lang, source) group.
4. Divergences of groups are summed by chunks of slots, in whole numbers throughout.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ._common import bounded_batches, stored
from ._components import join_counted
from ._shingles import _powers, buffers, mix

#: Mean terms of a shard, bytes of the shards sent at a time, slots of a chunk, sources compared at a time.
SHARD_TERMS, WAVE_BYTES, CHUNK, SOURCES = 1 << 14, 48 << 20, 2048, 64
#: Rows that a task of the first pass holds, and slots that one of the second pass does.
HELD_ROWS, HELD_SLOTS = 1 << 19, 12 << 20
SCALE = 1_000_000_000
_LEVELS = 48
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_STATE: dict = {}


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Runs of letters and non-ASCII characters, A-Z lowered: their numbers in the dictionary, text by text; how many each text has; the dictionary."""
    data, offsets = buffers(column)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64), pa.array([], pa.large_string())
    letter = _LETTER[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = letter[1:] != letter[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1][letter[cuts[:-1]]], cuts[1:][letter[cuts[:-1]]]
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(_LOWER[data[letter]])).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), np.diff(np.searchsorted(starts, offsets)), words.dictionary


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to (lang, term, n), n documents of the task at a time."""
    held: list[pa.Table] = []

    def added() -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "term"]).aggregate([("n", "sum")]).rename_columns(["lang", "term", "n"])

    rows = 0
    for b in filter(len, batches):
        codes, count, words = terms(b.column(1))
        if not len(codes):
            continue
        lang = b.column(0).cast(pa.large_string()).dictionary_encode()
        once = np.unique(np.repeat(np.arange(len(b)), count) * len(words) + codes)
        pair, n = np.unique(lang.indices.to_numpy().astype(np.int64)[once // len(words)] * len(words) + once % len(words), return_counts=True)
        held.append(pa.table({"lang": lang.dictionary.take(pa.array(pair // len(words))), "term": words.take(pa.array(pair % len(words))), "n": n.astype(np.int64)}))
        rows += len(pair)
        if rows > HELD_ROWS:
            held = [added()]
            rows = len(held[0])
            if rows > HELD_ROWS // 2:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from added().to_batches()


# --- perfect hashes --------------------------------------------------------------------


def key_hashes(keys: pa.Array, seed: int = 0) -> np.ndarray:
    data, at = buffers(keys)
    if seed not in _STATE:
        _STATE[seed] = np.random.default_rng(seed + 104729).integers(1, 2**63, 256, dtype=np.uint64)
    up, down = _powers(len(data))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_STATE[seed][data] * up[: len(data)], out=run[1:])
    return mix((run[at[1:]] - run[at[:-1]]) * down[at[:-1]] + np.diff(at).astype(np.uint64))


def _level(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) % np.uint64(size)).astype(np.int64)


def perfect_hash(keys: pa.Array) -> bytes:
    """Levels of bits with a place for each of the distinct keys, and the keys in the order of their slots."""
    n = len(keys)
    for seed in range(64):
        h, rest, sizes, levels, place = key_hashes(keys, seed), np.arange(n), [], [], np.zeros(n, np.int64)
        while len(rest) and len(sizes) < _LEVELS:
            size = max(64, 2 * len(rest))
            at = _level(h[rest], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            place[rest[alone[at]]] = sum(sizes) + at[alone[at]]
            rest = rest[~alone[at]]
            sizes.append(size)
            levels.append(alone)
        if not len(rest):
            break
    else:
        raise ValueError("the keys of a shard are not distinct")
    data, at = buffers(keys.take(pa.array(np.argsort(place))))
    bits = np.packbits(np.concatenate(levels)) if levels else np.zeros(0, np.uint8)
    return b"".join([np.array([n, seed, len(sizes), *sizes], np.int64).tobytes(), at.astype(np.int64).tobytes(), bits.tobytes(), data.tobytes()])


class PerfectHash:
    """What perfect_hash has written."""

    def __init__(self, raw: bytes):
        self.n, self.seed, levels = np.frombuffer(raw, np.int64, 3).tolist()
        self.sizes = np.frombuffer(raw, np.int64, levels, 24).tolist()
        at = np.frombuffer(raw, np.int64, self.n + 1, 24 + 8 * levels)
        begin, total = 32 + 8 * (levels + self.n), sum(self.sizes)
        self.bit = np.unpackbits(np.frombuffer(raw, np.uint8, -(-total // 8), begin))[:total].astype(bool)
        self.rank = np.cumsum(self.bit).astype(np.int32) - 1
        self.keys = pa.LargeStringArray.from_buffers(self.n, pa.py_buffer(at), pa.py_buffer(raw[begin + -(-total // 8) :]))

    def slots(self, words: pa.Array) -> np.ndarray:
        """The slot of each word, -1 for those that are not among the keys."""
        h, out = key_hashes(words, self.seed), np.full(len(words), -1)
        rest, base = np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            at = base + _level(h[rest], level, size)
            hit = self.bit[at]
            out[rest[hit]] = self.rank[at[hit]]
            rest, base = rest[~hit], base + size
        found = np.flatnonzero(out >= 0)
        same = pc.equal(self.keys.take(pa.array(out[found])), words.take(pa.array(found)))
        out[found[~same.to_numpy(zero_copy_only=False)]] = -1
        return out


def _shard(h: np.ndarray, shards: int | np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.asarray(shards).astype(np.uint64)).astype(np.int64)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, term, v) to (lang, shard, shards, term)."""
    for b in filter(len, batches):
        shards = np.maximum(1, -(-b.column(2).to_numpy() // SHARD_TERMS))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_shard(key_hashes(b.column(1)), shards)), pa.array(shards), b.column(1)], names=["lang", "shard", "shards", "term"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by lang and shard to one row with the perfect hash of each."""
    name, held = None, []

    def out():
        raw = perfect_hash(pa.chunked_array(held, pa.large_string()).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*name, int(np.frombuffer(raw, np.int64, 1)[0]), raw)], names=["lang", "shard", "shards", "n", "data"])

    for b in filter(len, batches):
        lang, shard, shards = (b.column(i).to_pylist() for i in range(3))
        cut = [0, *(i for i in range(1, len(b)) if (lang[i], shard[i]) != (lang[i - 1], shard[i - 1])), len(b)]
        for s, e in zip(cut, cut[1:], strict=False):
            if (lang[s], shard[s], shards[s]) != name:
                if held:
                    yield out()
                name, held = (lang[s], shard[s], shards[s]), []
            held.append(b.column(3).slice(s, e - s).cast(pa.large_string()))
    if held:
        yield out()


class Vocabulary:
    """The kept terms of one language that a wave sends: its shards' hashes, with dense places of their own."""

    def __init__(self, shards: int):
        self.shards, self.parts, self.size = shards, {}, 0

    def add(self, shard: int, base: int, data: bytes) -> None:
        h = PerfectHash(data)
        self.parts[shard] = (h, self.size, base)
        self.size += h.n

    def places(self, words: pa.Array) -> np.ndarray:
        out, shard = np.full(len(words), -1), _shard(key_hashes(words), self.shards)
        order = np.argsort(shard, kind="stable")
        names, first = np.unique(shard[order], return_index=True)
        for s, a, z in zip(names.tolist(), first, np.append(first[1:], len(order)), strict=True):
            if s in self.parts:
                h, own, _ = self.parts[s]
                at = h.slots(words.take(pa.array(order[a:z])))
                out[order[a:z]] = np.where(at >= 0, own + at, -1)
        return out

    def slots(self, places: np.ndarray) -> np.ndarray:
        """Slots in the language of places in this wave."""
        own = np.array([p[1] for p in self.parts.values()])
        base = np.array([p[2] for p in self.parts.values()])
        part = np.searchsorted(own, places, "right") - 1
        return places - own[part] + base[part]


def _recount(sent, tag: str, with_groups: bool):
    """Rows (lang, source, text) to (lang, source, slot, n); with_groups: also slot -1 of every group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _STATE.get("wave") != tag:
            known: dict[str, Vocabulary] = {}
            for lang, shard, shards, base, data in sent.value:
                known.setdefault(lang, Vocabulary(shards)).add(shard, base, data)
            _STATE["known"], _STATE["wave"] = known, tag
        known = _STATE["known"]
        dense: dict[tuple[str, str], np.ndarray] = {}
        seen: set[tuple[str, str]] = set()

        def out(rows: list[tuple[str, str, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            size = [len(r[2]) for r in rows]
            column = lambda i: pa.array([r[i] for r in rows], pa.string()).take(pa.array(np.repeat(np.arange(len(rows)), size)))
            return pa.RecordBatch.from_arrays([column(0), column(1), pa.array(np.concatenate([r[2] for r in rows])), pa.array(np.concatenate([r[3] for r in rows]))], names=["lang", "source", "slot", "n"])

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), slots in dense.items():
                at = np.flatnonzero(slots)
                if len(at):
                    yield out([(lang, source, known[lang].slots(at), slots[at])])
            dense.clear()

        for b in filter(len, batches):
            lang, source = b.column(0).to_pylist(), b.column(1).to_pylist()
            groups: dict[tuple[str, str], int] = {}
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(lang, source, strict=True)])
            if with_groups and (new := groups.keys() - seen):
                seen |= new
                yield out([(*g, np.array([-1]), np.array([0])) for g in sorted(new)])
                if len(seen) > HELD_ROWS:
                    seen.clear()
            codes, count, words = terms(b.column(2))
            if not len(codes):
                continue
            used, n = np.unique(np.repeat(group, count) * len(words) + codes, return_counts=True)
            group_at = np.searchsorted(used // len(words), np.arange(len(groups) + 1))
            by_lang: dict[str, list[tuple[tuple[str, str], slice]]] = {}
            for g, i in groups.items():
                by_lang.setdefault(g[0], []).append((g, slice(group_at[i], group_at[i + 1])))
            for name, members in by_lang.items():
                if name not in known:
                    continue
                some = np.unique(np.concatenate([used[s] for _, s in members]) % len(words))
                place = known[name].places(words.take(pa.array(some)))
                for g, s in members:
                    at = place[np.searchsorted(some, used[s] % len(words))]
                    if g not in dense:
                        dense[g] = np.zeros(known[name].size, np.int64)
                    dense[g][at[at >= 0]] += n[s][at >= 0]  # the terms of a group are distinct
                    if sum(map(len, dense.values())) > HELD_SLOTS:
                        yield from flush()
        yield from flush()

    return run


# --- divergences -----------------------------------------------------------------------


def shares(count: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * v)), exactly."""
    if len(count) and (int(count.max()) + 2) * SCALE >= 1 << 63:
        count = count.astype(object)
    return (1 + SCALE * (count + 2) // (total + 2 * v)).astype(np.int64)


def _divergences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: (part, lang, block, source, v, total, chunk, slot, n) to sums for each pair of sources of a part.

    A row with slot -1 names a source of the part and its total, the others its counts.
    """
    name, held = None, []

    def out() -> pa.RecordBatch | None:
        lang, v, chunk = held[0]["lang"], held[0]["v"], held[0]["chunk"]
        sides = sorted({(h["block"], h["source"]): h["total"] for h in held if h["slot"] < 0}.items())
        index = {k: i for i, (k, _) in enumerate(sides)}
        width = min(CHUNK, v - chunk * CHUNK)
        count = np.zeros((len(sides), width), np.int64)
        for h in held:
            if h["slot"] >= 0:
                count[index[h["block"], h["source"]], h["slot"] - chunk * CHUNK] = h["n"]
        p = shares(count, np.array([t for _, t in sides])[:, None], v)
        *_, low, high = name
        first = np.arange(len(sides)) if low == high else np.flatnonzero([k[0] == low for k, _ in sides])
        rows: tuple[list, list, list] = ([], [], [])
        for i in first.tolist():
            other = np.arange(i + 1, len(sides)) if low == high else np.flatnonzero([k[0] == high for k, _ in sides])
            value = ((p[i] - p[other]) ** 2 // (p[i] + p[other])).sum(1)
            for j, x in zip(other.tolist(), value.tolist(), strict=True):
                for a, c in ((i, j), (j, i)):
                    for column, y in zip(rows, (sides[a][0][1], sides[c][0][1], x), strict=True):
                        column.append(y)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(rows[0]), pa.string()), pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64())], names=["lang", "source", "item", "value"])

    for b in batches:
        for row in b.to_pylist():
            key = (row["lang"], row["chunk"], row["low"], row["high"])
            if key != name:
                if held:
                    yield out()
                name, held = key, []
            held.append(row)
    if held:
        yield out()


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 10, ranks: int = 10) -> DataFrame:
    """lang, source, part, item, value and rank: how each source of a language differs from its other sources and its language.

    A term is a run of letters and non-ASCII characters with A-Z lowered; a language keeps those in at
    least ``least`` of its documents, V of them.  With N occurrences of kept terms, a group gives each
    p = 1 + floor(10**9 * (count + 2) / (N + 2 V)).  Part pair has, for every other source of the language, the sum
    of floor((p - q)**2 / (p + q)) over the kept terms; part term the ``ranks`` terms that the source uses
    more than its language, by that value.  Ranks count from 1, ties by the item's bytes.
    Null texts, languages and sources are read as empty; repeated rows and null ids are documents of their own; a
    group without terms is compared like any other, and one alone in its language has no pairs.  An empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = docs.select(read(lang_col).alias("lang"), read(source_col).alias("source"), read(text_col).alias("text"))
    counted = base.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n long")
    kept = stored(counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term"))
    sizes = stored(kept.groupBy("lang").agg(F.count("*").alias("v")))
    total = sizes.agg(F.sum("v")).first()[0] or 0
    dealt = join_counted(kept, sizes, "lang", "v", total).select("lang", "term", "v").mapInArrow(_dealt, "lang string, shard long, shards long, term string")
    hashed = dealt.repartition("lang", "shard").sortWithinPartitions("lang", "shard").mapInArrow(_hashed, "lang string, shard long, shards long, n long, data binary")
    hashed = stored(hashed)
    before = W.partitionBy("lang").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = hashed.select("lang", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row a shard
    hashed = stored(hashed.join(bases, ["lang", "shard"]))

    # waves of shards, none larger than WAVE_BYTES or one shard
    waves = max(1, -(-(hashed.agg(F.sum(F.octet_length("data"))).first()[0] or 0) // WAVE_BYTES))
    wave = lambda: F.pmod(F.xxhash64("lang", "shard"), F.lit(waves))
    while waves > 1 and hashed.groupBy(wave().alias("w")).agg(F.sum(F.octet_length("data")).alias("b"), F.count("*").alias("m")).filter((F.col("b") > WAVE_BYTES) & (F.col("m") > 1)).limit(1).count():
        waves *= 2
    recounted = None
    for w in range(waves):
        tag, rows = uuid.uuid4().hex, hashed.filter(wave() == w).select("lang", "shard", "shards", "base", "data").toArrow().to_pylist()
        sent = spark.sparkContext.broadcast([tuple(r.values()) for r in rows])
        one = base.mapInArrow(_recount(sent, tag, w == 0), "lang string, source string, slot long, n long")
        recounted = one if recounted is None else recounted.unionByName(one)
    counts = stored(recounted.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n")))

    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(F.broadcast(sizes) if sizes.count() < 10_000 else sizes, "lang", "left")
    langs = W.partitionBy("lang")
    groups = stored(groups.select("lang", "source", "total", F.coalesce("v", F.lit(0)).alias("v"), F.count("*").over(langs).alias("m"), F.sum("total").over(langs).alias("all")))
    filled = counts.filter("slot >= 0")
    count_of = filled.groupBy("lang", "slot").agg(F.sum("n").alias("n_all"))
    p = lambda n, t: 1 + F.expr(f"(cast({n} as decimal(19,0)) + 2) * {SCALE}BD div (cast({t} as decimal(19,0)) + 2 * v)")
    words = hashed.select("lang", "base", "data").mapInArrow(_keys, "lang string, slot long, item string")
    used = filled.join(groups, ["lang", "source"]).join(count_of, ["lang", "slot"]).select("lang", "source", "slot", p("n", "total").alias("p"), p("n_all", "all").alias("q")).filter("p > q")
    f = F.expr("(p - q) * (p - q) div (p + q)")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = used.join(words, ["lang", "slot"]).select("lang", "source", F.lit("term").alias("part"), "item", f.alias("value"))
    term = term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)

    blocks = F.ceil(F.col("m") / SOURCES).cast("long")
    side = groups.filter("m > 1 AND v > 0").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
    heads = side.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(v - 1) div {CHUNK}"))).alias("chunk"), F.lit(-1).cast("long").alias("slot"), F.lit(0).cast("long").alias("n"))
    cells = side.join(filled, ["lang", "source"]).withColumn("chunk", F.expr(f"slot div {CHUNK}"))
    parts = heads.unionByName(cells.select(*heads.columns)).withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    parts = parts.select("lang", "chunk", F.least("block", "met").alias("low"), F.greatest("block", "met").alias("high"), "block", "source", "v", "total", "slot", "n")
    keys = ["lang", "chunk", "low", "high"]
    summed = parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_divergences, "lang string, source string, item string, value long")
    pair = summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = groups.filter("m > 1 AND v = 0").select("lang", "source")  # as many rows as the result has
    bare = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    pair = pair.unionByName(bare).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    return pair.select("lang", "source", "part", "item", "value", "rank").unionByName(term)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, base, data) to the slots and their keys."""
    for b in batches:
        for lang, base, data in zip(b.column(0), b.column(1).to_pylist(), b.column(2), strict=True):
            keys = PerfectHash(data.as_py()).keys
            yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(keys), pa.string()), pa.array(base + np.arange(len(keys))), keys.cast(pa.string())], names=["lang", "slot", "item"])


_P = "1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY {0}) + 2 * count(*) OVER (PARTITION BY {0}))"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, {_P.format("lang, source")} AS p FROM a),
q AS (SELECT lang, term, {_P.format("lang")} AS q FROM (SELECT lang, term, sum(n) AS n FROM a GROUP BY ALL)),
s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 10"""
