"""Line deduplication by a segment-partition edit join.

A line is cut into one segment more than the edits allowed; of two lines within that
distance, one holds a segment of the other unchanged, at nearly the same place.  Segments
are an index keyed by length, number and content; each line probes the few substrings
that can match.  What meets is filtered by byte counts and verified with a banded
bit-parallel edit distance.  Distances and lengths count UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _shingles as S
from ._common import bounded_batches, stored, unused

#: Lines of fewer bytes say too little and always stay.
LEAST_BYTES = 20
#: Lines of one key are compared in squares of so many.
SQUARE = 256
#: Rows of one key that a task holds before it lets the key pass.
HELD = 1 << 20
#: So many line hashes (8 bytes each) may go to every task.
WANTED = 1 << 20
_TABLES = np.random.default_rng(424242).integers(1, 2**63, (2, 256), dtype=np.uint64)
_SEEN = 1 << 20


class Lines:
    """All lines of an Arrow array of texts, with hashes of any byte range."""

    def __init__(self, column: pa.Array):
        self.data, offsets = S.buffers(column)
        n = len(self.data)
        ends = np.flatnonzero(self.data == 10)
        # a text of m line breaks has m + 1 lines; each starts at the text or behind a break
        breaks = np.diff(np.searchsorted(ends, offsets))
        count = breaks + 1
        self.text = np.repeat(np.arange(len(count)), count)
        first = np.cumsum(count) - count
        self.number = np.arange(len(self.text)) - first[self.text] + 1
        self.start, self.end = np.empty(len(self.text), np.int64), np.empty(len(self.text), np.int64)
        opens = np.zeros(len(self.text), bool)
        opens[first] = True
        closes = np.roll(opens, -1)
        self.start[opens], self.start[~opens] = offsets[:-1], ends + 1
        self.end[closes], self.end[~closes] = offsets[1:], ends
        self.length = self.end - self.start
        up, self.down = S._powers(n)
        self.runs = []
        for table in _TABLES:
            run = np.zeros(n + 1, np.uint64)
            np.cumsum(table[self.data] * up[:n], out=run[1:])
            self.runs.append(run)

    def hashed(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        run = self.runs[which]
        return S.mix((run[end] - run[start]) * self.down[start] + (end - start).astype(np.uint64))


def _occurrences(batches):
    for b in batches:
        x = Lines(b.column(2))
        on = np.flatnonzero(x.length >= LEAST_BYTES)
        at = pa.array(x.text[on])
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(at), b.column(1).take(at), pa.array(x.number[on]), pa.array(x.hashed(x.start[on], x.end[on]).view(np.int64)), pa.array(x.hashed(x.start[on], x.end[on], 1).view(np.int64))],
            names=["id", "x", "no", "line", "check"],
        )


def segments(length: np.ndarray, edits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Offsets and lengths of the segments of lines of these lengths; the last ones take what is left over."""
    short, over = length // (edits + 1), length % (edits + 1)
    sizes = [short + (i >= edits + 1 - over) for i in range(edits + 1)]
    return [sum(sizes[:i], np.zeros_like(length)) for i in range(edits + 1)], sizes


def probes(length: np.ndarray, edits: int):
    """(line numbers, segment length class, segment, substring starts, sizes, is the line's own segment)."""
    for shorter in range(edits + 1):
        other = length - shorter
        offsets, sizes = segments(other, edits)
        for i in range(edits + 1):
            for move in range(-edits, edits + 1):
                # edits left of the segment move it by at most i, those right of it leave edits - i
                if abs(move) > i or abs(move - shorter) > edits - i:
                    continue
                start = offsets[i] + move
                fits = np.flatnonzero((start >= 0) & (start + sizes[i] <= length) & (other >= edits + 1))
                yield fits, other[fits], i, start[fits], sizes[i][fits], shorter == 0 and move == 0


def _postings(edits: int):
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            x = Lines(b.column(0))
            line = x.hashed(x.start, x.end)
            on = []
            for i in np.flatnonzero(x.length >= LEAST_BYTES).tolist():
                if (h := int(line[i])) not in seen:
                    seen.add(h)
                    on.append(i)
            if len(seen) > _SEEN:
                seen.clear()
            on = np.array(on, np.int64)
            for fits, other, i, start, size, own in probes(x.length[on], edits):
                at = x.start[on[fits]] + start
                key = S.mix(x.hashed(at, at + size) + (other * 8 + i).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(line[on[fits]].view(np.int64)), pa.array(np.full(len(fits), own))], names=["key", "line", "own"]
                )

    return run


def _shared_keys(batches):
    """From postings sorted by key and line: the rows of keys that an own segment shares with another line."""
    key, line, own = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    names, going = ["key", "line", "own"], None

    def useful(key, line, own):
        if not len(key):
            return None
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(starts, len(key)))
        mixed = np.minimum.reduceat(line, starts) != np.maximum.reduceat(line, starts)
        good = np.repeat(mixed & np.logical_or.reduceat(own, starts), size)
        if good.any():
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1]) | (own[1:] != own[:-1])
            good &= fresh
            return pa.RecordBatch.from_arrays([pa.array(key[good]), pa.array(line[good]), pa.array(own[good])], names=names)
        return None

    for b in batches:
        key, line, own = (np.concatenate([a, b.column(i).to_numpy(zero_copy_only=False)]) for i, a in enumerate((key, line, own)))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1]) | (own[1:] != own[:-1])
        key, line, own = key[fresh], line[fresh], own[fresh]
        stop = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if len(key) - stop > HELD:  # a key of very many lines goes on unseen; it is compared in squares
            going = key[-1]
        if going is not None and len(key) and (open_ := key == going).any():
            yield pa.RecordBatch.from_arrays([pa.array(key[open_]), pa.array(line[open_]), pa.array(own[open_])], names=names)
            key, line, own = key[~open_], line[~open_], own[~open_]
            stop = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if (out := useful(key[:stop], line[:stop], own[:stop])) is not None:
            yield out
        key, line, own = key[stop:], line[stop:], own[stop:]
    if (out := useful(key, line, own)) is not None:
        yield out


def _texts(wanted: np.ndarray | None):
    """line, its bytes and the counts of 32 classes of bytes, of the wanted lines, once a task for each.

    wanted is sorted; None takes all lines.
    """

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            x = Lines(b.column(0))
            line = x.hashed(x.start, x.end).view(np.int64)
            on = x.length >= LEAST_BYTES
            if wanted is not None:
                at = np.minimum(np.searchsorted(wanted, line), max(0, len(wanted) - 1))
                on &= (wanted[at] == line) if len(wanted) else False
            ids, rows, counts = [], [], []
            raw = x.data.tobytes()
            for i in np.flatnonzero(on).tolist():
                if (h := int(line[i])) not in seen:
                    seen.add(h)
                    ids.append(h)
                    rows.append(raw[x.start[i] : x.end[i]])
                    counts.append(np.bincount(x.data[x.start[i] : x.end[i]] & 31, minlength=32).astype(np.uint8).tobytes())
            if len(seen) > _SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary()), pa.array(counts, pa.binary())], names=["line", "bytes", "counts"])

    return run


def _square_pairs(edits: int):
    """Rows sorted by square: pairs (a: an own segment, b: a probe) whose byte counts are near enough."""

    def run(batches):
        name, held = None, []

        def pairs():
            sketch = np.frombuffer(b"".join(h[3] for h in held), np.uint8).reshape(-1, 32)
            line = np.array([h[0] for h in held])
            left = np.flatnonzero([h[1] and h[2] in (0, 1) for h in held])
            right = np.flatnonzero([h[2] in (0, 2) for h in held])
            for i in left.tolist():
                # counts are kept modulo 256; one edit moves them by two at most
                d = (sketch[right] - sketch[i]).view(np.int8).astype(np.int16)
                near = right[(np.abs(d).sum(axis=1) <= 2 * edits) & (line[right] != line[i])]
                if len(near):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(line[near], line[i])), pa.array(np.maximum(line[near], line[i]))], names=["a", "b"])

        for b in batches:
            for square, line, own, side, counts in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if square != name:
                    if len(held) > 1:
                        yield from pairs()
                    name, held = square, []
                held.append((line, own, side, counts))
        if len(held) > 1:
            yield from pairs()

    return run


def within(left: list[bytes], right: list[bytes], edits: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most edits, by a bit-parallel band.

    The band holds the 2 * edits + 1 cells of a column around the diagonal; bit b is the
    cell b - edits below it.  All pairs advance together, a column at a time.
    """
    n = len(left)
    m, t = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    out = np.zeros(n, bool)
    live = np.flatnonzero(np.abs(m - t) <= edits)
    if not len(live):
        return out
    live = live[np.argsort(t[live], kind="stable")]
    m, t, width = m[live], t[live], 2 * edits + 1
    longest = int(max(m.max(), t.max()))
    pad = edits + 1
    rows = np.full((len(live), longest + 2 * pad + 1), -1, np.int16)  # pattern, padded on both sides
    cols = np.full((len(live), longest + 1), -2, np.int16)
    for r, i in enumerate(live.tolist()):
        rows[r, pad : pad + m[r]] = np.frombuffer(left[i], np.uint8)
        cols[r, : t[r]] = np.frombuffer(right[i], np.uint8)
    full = np.uint64((1 << width) - 1)
    one = np.uint64(1)
    # the column before the first holds 0, 1, 2 ... downwards: its cells are one more than those above
    vp = np.full(len(live), sum(1 << b for b in range(edits, width)), np.uint64)
    vn = np.zeros(len(live), np.uint64)
    lowest = np.full(len(live), edits, np.int64)  # value of the lowest cell of the band
    answer = np.full(len(live), edits + 1, np.int64)
    last = np.minimum(m - t + edits, width - 1)  # band place of the final cell in the final column
    done = t == 0
    answer[done] = m[done]
    for j in range(int(t.max())):
        on = slice(int(np.searchsorted(t, j + 1)), None)  # pairs whose text has this column
        x = np.zeros(len(t[on]), np.uint64)
        for b in range(width):
            x |= (rows[on, pad + j + b - edits] == cols[on, j]).astype(np.uint64) << np.uint64(b)
        p, q = vp[on], vn[on]
        d0 = ((((x & p) + p) ^ p) | x | q) & full
        hp = (q | ~(d0 | p)) & full
        hn = p & d0
        lowest[on] += 1 - ((d0 >> np.uint64(width - 1)) & one).astype(np.int64)
        d = d0 >> one
        vp[on], vn[on] = (hn | ~(d | hp)) & full, d & hp
        final = np.flatnonzero(t[on] == j + 1) + on.start
        if len(final):
            value = lowest[final].copy()
            for b in range(width - 1, 0, -1):  # climb from the lowest cell to the final one
                up = last[final] < b
                step = ((vp[final] >> np.uint64(b - 1)) & one).astype(np.int64) - ((vn[final] >> np.uint64(b - 1)) & one).astype(np.int64)
                value[up] -= step[up]
            answer[final] = value
    out[live] = answer <= edits
    return out


def _verify(edits: int):
    def run(batches):
        for b in batches:
            good = pa.array(within(b.column(2).to_pylist(), b.column(3).to_pylist(), edits))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], names=["a", "b"])

    return run


def near_lines(texts: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of hashes of distinct lines of t, at most edits apart, each pair once."""
    found = texts.mapInArrow(_postings(edits), "key long, line long, own boolean")
    keys = stored(found.repartition("key").sortWithinPartitions("key", "line", "own").mapInArrow(_shared_keys, "key long, line long, own boolean"))
    wanted = keys.select("line").distinct()
    some = wanted.limit(WANTED + 1).toArrow().column(0).to_numpy()
    few = np.sort(some) if len(some) <= WANTED else None  # a broadcast of checked size: sent to the tasks only if it is small; the join does without
    known = texts.mapInArrow(_texts(few), "line long, bytes binary, counts binary")
    if few is None:
        known = known.join(wanted, "line", "left_semi")
    lines = stored(known.groupBy("line").agg(F.min("bytes").alias("bytes"), F.min("counts").alias("counts")))
    # keys of many lines are compared in squares: block i of the own segments with block j of the probes
    sizes = keys.groupBy("key").agg(F.ceil(F.count("*") / SQUARE).cast("int").alias("all"))
    dealt = keys.join(lines.select("line", "counts"), "line").join(sizes, "key")
    block = F.pmod(F.xxhash64("line", F.lit(3)), F.col("all")).cast("int")
    upto = F.sequence(F.lit(0), F.col("all") - 1)
    name = lambda i, j: F.concat_ws(":", F.col("key").cast("string"), i.cast("string"), j.cast("string"))
    # own segments are also probes of lines of their length; side: 1 only asks as a segment, 2 only as a probe, 0 both
    as_own = F.transform(upto, lambda j: F.struct(name(block, j).alias("square"), F.when(j == block, 0).otherwise(1).alias("side")))
    as_probe = F.transform(upto, lambda i: F.struct(name(i, block).alias("square"), F.lit(2).alias("side")))
    both = F.when(F.col("own"), F.concat(as_own, F.filter(as_probe, lambda s: s["square"] != name(block, block)))).otherwise(as_probe)
    squares = dealt.select(F.explode(both).alias("s"), "line", "own", "counts").select("s.square", "line", "own", "s.side", "counts")
    pairs = squares.repartition("square").sortWithinPartitions("square").mapInArrow(_square_pairs(edits), "a long, b long").distinct()
    left, right = lines.select(F.col("line").alias("a"), F.col("bytes").alias("x")), lines.select(F.col("line").alias("b"), F.col("bytes").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify(edits), "a long, b long")


def repeated_lines(docs: DataFrame, edits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, x (hash of the text) and drop (sorted numbers of its repeated lines) of documents that have any."""
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("x"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = base.schema["id"].dataType.simpleString()
    where = stored(base.mapInArrow(_occurrences, f"id {kind}, x long, no long, line long, check long"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "no")
    first = stored(where.groupBy("line", "check").agg(F.min(order).alias("first")))
    pairs = stored(near_lines(base.select("t"), edits))
    places = first.groupBy("line").agg(F.min("first").alias("first"))
    a, b = (places.select(F.col("line").alias(n), F.col("first").alias(f"{n}_first")) for n in ("a", "b"))
    later = F.when(F.col("a_first") < F.col("b_first"), F.col("b")).otherwise(F.col("a"))
    gone = pairs.join(a, "a").join(b, "b").select(later.alias("line")).distinct().withColumn("gone", F.lit(True))
    judged = where.join(first.join(gone, "line", "left"), ["line", "check"])
    drop = judged.filter(F.col("gone").isNotNull() | (order != F.col("first")))
    return drop.groupBy("id", "x").agg(F.sort_array(F.collect_set("no")).alias("drop"))


def without_repeated_lines(docs: DataFrame, edits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, with the text freed of repeated lines, and n_lines and n_dropped.

    Lines are parted by line feeds.  A line of LEAST_BYTES bytes or more goes if an equal
    line, or one at most edits bytes of insertion, deletion or substitution away, has its
    first place before it, by document id and line number; shorter and empty lines stay.
    Documents are never dropped here, also if no line is left (their text is empty then);
    null texts stay null with no lines.  Null ids come last; rows of one id count as one
    document's, so equal rows keep equal lines.  An empty table gives an empty result;
    columns called n_lines or n_dropped are replaced.  Equal lines are told by 128-bit hashes; near
    ones are named by 64-bit hashes and compared by their bytes.
    """
    own_id, own_x, drop, own = unused(docs, "__id", "__x", "__drop", "__own")
    found = repeated_lines(docs, edits, id_col, text_col).select(F.col("id").alias(own_id), F.col("x").alias(own_x), F.col("drop").alias(drop))
    kept = docs.drop("n_lines", "n_dropped").withColumn(own, F.xxhash64(text_col))
    both = kept.join(found, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(own) == F.col(own_x)), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    new = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, lambda s, i: ~F.array_contains(drop, (i + 1).cast("long"))), "\n"))
    counts = [F.coalesce(F.size(lines), F.lit(0)).cast("long"), F.coalesce(F.size(drop), F.lit(0)).cast("long")]
    counts = [F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(counts[0]), F.when(F.col(drop).isNull(), F.lit(0).cast("long")).otherwise(counts[1])]
    columns = [new.alias(c) if c == text_col else F.col(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return both.select(*columns, counts[0].alias("n_lines"), counts[1].alias("n_dropped"))


SQL = """
WITH l AS (SELECT doc_id, no, lines[no] AS line FROM
  (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))),
f AS (SELECT line, min({'d': doc_id, 'n': no}) AS first FROM l WHERE strlen(line) >= 20 GROUP BY line),
near AS (SELECT DISTINCT CASE WHEN a.first < b.first THEN b.line ELSE a.line END AS line FROM f a JOIN f b
  ON strlen(b.line) BETWEEN strlen(a.line) AND strlen(a.line) + 2 AND a.line <> b.line AND levenshtein(a.line, b.line) <= 2),
j AS (SELECT l.doc_id, l.no, l.line, f.line IS NOT NULL AND (near.line IS NOT NULL OR f.first <> {'d': l.doc_id, 'n': l.no}) AS gone
  FROM l LEFT JOIN f ON f.line = l.line LEFT JOIN near ON near.line = l.line)
SELECT d.doc_id, count(j.no)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  md5(coalesce(string_agg(j.line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS text_md5
FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id GROUP BY d.doc_id"""
