"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.  Every
text is cut into short windows of whole words; a window that the toxic dictionary
shortens more than the ordinary one speaks for toxicity.  How much such windows must
save, and how many a text needs, is calibrated by folds of the training rows.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._common import add_columns, stored
from ._shingles import buffers

#: Bytes of text from which the words of one window start.
WINDOW = 64
#: The model is fitted on at most so many rows of each class, and so many characters of each.
FIT_ROWS, FIT_CHARS = {1: 2000, 0: 5000}, 10_000
#: Bytes of the dictionary of either class, and of the segments that the toxic one is made of, of which the folds choose one size.
ORDINARY_BYTES, TOXIC_BYTES, SEGMENTS = 32_768, 8192, (10, 12, 16, 24)
#: The ordinary dictionary is trained on about so many bytes of the ordinary rows.
TRAIN_BYTES = 4 << 20
#: Folds of the calibration.
FOLDS = 4
#: Beginnings of words, in bytes, that are compared between the classes; hash bits that tell them apart; occurrences
#: that count in one text; how many times as frequent, and with how much evidence, they must be in toxic text.
LEAST, LONGEST, KEY_BITS, REPEATS, RATIO, EVIDENCE = 4, 10, 21, 4, 3.0, 10.0
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: What the bytes of a word are mixed with, by place; later places are alike.
_PLACES = (np.arange(12) * 89 % 256).astype(np.uint8)
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("A") : ord("Z") + 1] += 32


def _placed(data: np.ndarray, start: np.ndarray, space: np.ndarray) -> bytes:
    """The bytes, those of words mixed with their place in the word, so that equal strings match only at equal places."""
    at = np.arange(len(data), dtype=np.int32)
    place = at - np.maximum.accumulate(np.where(start, at, 0))
    return np.where(space, data, data ^ _PLACES[np.minimum(place, len(_PLACES) - 1)]).tobytes()


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased placed bytes, and start, end and text number of every window.

    A window holds the words that start within WINDOW bytes, and the space before them.
    """
    data = _UPPER[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    space = _SPACE[data]
    start = ~space & first
    start[1:] |= ~space[1:] & space[:-1]
    at = np.flatnonzero(start)
    owner = np.searchsorted(offsets, at, side="right") - 1
    cell = (at - offsets[owner]) // WINDOW
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (cell[1:] != cell[:-1])
    begin, owner = at[new], owner[new]
    end = offsets[owner + 1].copy()
    same = owner[1:] == owner[:-1]
    end[:-1][same] = begin[1:][same]
    begin = np.where(begin > offsets[owner], begin - 1, begin)
    return _placed(data, start, space), begin, end, owner


def _compressor(content: bytes):
    import zstandard

    params = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_BTOPT,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def _trained(size: int, samples: list[bytes], segment: int) -> bytes:
    """A dictionary that the library fills with segments of so many bytes; of samples too few to train on, the samples themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6, f=20).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    cut: int  # bytes a window must save to count
    weights: np.ndarray  # of the features of a text, the last is the intercept

    def features(self, column: pa.Array) -> np.ndarray:
        return self.features_of(*self.savings(column))

    def features_of(self, saved: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """For each text: windows that save enough, what they save, the same as shares, and the most saved."""
        hit = saved >= self.cut
        n = np.bincount(owner, minlength=texts)
        k = np.bincount(owner[hit], minlength=texts)
        total = np.bincount(owner[hit], saved[hit], minlength=texts)
        most = np.zeros(texts)
        np.maximum.at(most, owner, saved)
        share = 100.0 / np.maximum(n, 1)
        return np.column_stack([np.log1p(k), np.log1p(total), np.log1p(share * k), np.log1p(share * total), most / 4.0, np.log1p(n), np.ones(texts)])

    def savings(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
        """Bytes by which the toxic dictionary shortens every window more than the ordinary one."""
        data, offsets = buffers(column)
        raw, begin, end, owner = windows(data, offsets)
        plain, toxic = _compressor(self.ordinary).compress, _compressor(self.toxic).compress
        cut = map(raw.__getitem__, map(slice, begin.tolist(), end.tolist()))
        opening = (begin == offsets[owner]).tolist()  # the first word of a text lacks the space before it
        spaced = (b" " + w if o else w for w, o in zip(cut, opening, strict=True))
        saved = np.fromiter((len(plain(w)) - len(toxic(w)) for w in spaced), np.int64, len(begin))
        return saved, owner, len(column)

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(column) @ self.weights, -30, 30)))


class _Words:
    """The words of the fitting texts."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.space = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], self.space]).astype(np.int8))).astype(np.int32)
        self.start, self.end = edge[::2], edge[1::2]
        begun = np.zeros(len(data), bool)
        begun[self.start] = True
        # placed part by part, at word starts, so that only a part's places are held
        cuts = [0, *self.start[:: 1 << 18].tolist()[1:], len(data)]
        self.raw = np.frombuffer(b"".join(_placed(data[a:z], begun[a:z], self.space[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)), np.uint8)
        self.ends = np.cumsum([len(t) + 1 for t in texts])
        self.owner = np.searchsorted(self.ends, self.start, side="right").astype(np.int32)
        self.length = np.bincount(self.owner, minlength=len(texts))
        self.data = data

    def _begun(self):
        """For each length of beginnings: the words that are as long, their keys; texts, keys and counts.  One length is held at a time."""
        h = np.full(len(self.start), 0x9E3779B97F4A7C15, np.uint64)
        for n in range(LONGEST):
            live = np.flatnonzero(self.start + n < self.end)
            one = (h[live] ^ self.data[self.start[live] + n]) * np.uint64(0xD6E8FEB86659FD93)
            one ^= one >> np.uint64(32)
            h[live] = one
            if n + 1 >= LEAST:
                key = (one >> np.uint64(64 - KEY_BITS)).astype(np.int32)
                pair, times = np.unique(self.owner[live].astype(np.int64) << KEY_BITS | key, return_counts=True)
                yield live, key, (pair >> KEY_BITS).astype(np.int32), (pair & (1 << KEY_BITS) - 1).astype(np.int32), np.minimum(times, REPEATS).astype(np.uint8)

    def toxic(self, y: np.ndarray, used: np.ndarray) -> np.ndarray:
        """For each word the length of its beginning that is most over-represented in toxic ones of the used texts, or 0.

        Occurrences are compared with the class's share of all words by the log-likelihood ratio, divided by
        how much a text repeats itself.
        """
        out, best = np.zeros(len(self.start), np.int64), np.full(len(self.start), EVIDENCE)
        words = [float(self.length[used & (y == c)].sum()) for c in (0, 1)]
        if not min(words):
            return out
        p = words[1] / sum(words)
        for n, (live, key, doc, pair, times) in enumerate(self._begun(), LEAST):
            count = lambda w: np.bincount(pair, w, 1 << KEY_BITS)  # noqa: E731, B023
            toxic, any_ = (used & (y == 1))[doc], used[doc]
            k1, k, square = count(times * toxic), count(times * any_), count(times.astype(float) ** 2 * any_)
            seen = np.flatnonzero((count(toxic) >= 3) & (k1 * (1 - p) >= RATIO * p * np.maximum(k - k1, 0.5)))
            a, b = k1[seen], (k - k1)[seen]
            ratio = a * np.log(a / ((a + b) * p)) + b * np.log(np.maximum(b, 1e-9) / ((a + b) * (1 - p)))
            telling = np.zeros(1 << KEY_BITS)
            telling[seen] = ratio * (a + b) / square[seen]
            of = telling[key]
            more = of >= best[live]
            out[live[more]], best[live[more]] = n, of[more]
        return out

    def spoken(self, chosen: np.ndarray, length: np.ndarray) -> list[bytes]:
        """For each text so many bytes of its chosen words, each with a space before it.

        Between them lie bytes that no text has, so that no window matches across them.
        """
        parts: dict[int, list[bytes]] = {}
        for i in np.flatnonzero(chosen).tolist():
            parts.setdefault(self.owner[i], []).append(self.raw[self.start[i] : self.start[i] + length[i]].tobytes())
        between = b"\0\0\0\0 "
        return [between + between.join(w) for w in parts.values()]

    def plain(self, texts: np.ndarray, without: np.ndarray) -> list[bytes]:
        """Pieces of the chosen texts without some words, at most TRAIN_BYTES in all."""
        out, size = [], 0
        drop = np.zeros(len(self.raw) + 1, np.int8)
        np.add.at(drop, self.start[without], 1)
        np.add.at(drop, self.end[without], -1)
        keep = np.cumsum(drop[:-1], dtype=np.int8) == 0
        for i in np.flatnonzero(texts).tolist():
            if size > TRAIN_BYTES:
                break
            a, z = (int(self.ends[i - 1]) if i else 0), int(self.ends[i])
            text = self.raw[a:z][keep[a:z]].tobytes()
            out += [text[j : j + 4 * WINDOW] for j in range(0, len(text), 4 * WINDOW)]
            size += len(text)
        return out


def _without_copies(texts: list[bytes]) -> np.ndarray:
    """Marks the texts to keep so that copies and near copies of one text do not pose as evidence.

    A text goes if three of its least word hashes, in one of three bands, are those of an earlier one.
    """
    factors = np.random.default_rng(5).integers(1, 2**31, 9, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seen: set[tuple] = set()
    keep = np.ones(len(texts), bool)
    for i, t in enumerate(texts):
        words = np.array([zlib.crc32(w) for w in set(t.split())], np.uint64)
        if not len(words):
            continue
        least = ((words[:, None] * factors) & np.uint64(2**32 - 1)).min(axis=0).reshape(3, 3)
        bands = {(j, *least[j].tolist()) for j in range(3)}
        keep[i] = not bands & seen
        seen |= bands
    return keep


def dictionaries(words: _Words, y: np.ndarray, used: np.ndarray, segments: tuple[int, ...]) -> list[tuple[bytes, bytes]]:
    """For each size of segments the ordinary and the toxic dictionary, both trained by the library.

    The trainer picks frequent strings, and most strings of toxic texts are frequent in all texts.  The text is
    therefore dealt to the two training sets first: what is over-represented in toxic texts, as it stands
    in them, trains the toxic dictionary, the other words of ordinary texts the ordinary one.
    """
    length = words.toxic(y, used)
    spoken = words.spoken((length > 0) & (used & (y == 1))[words.owner], length)
    base = _trained(ORDINARY_BYTES, words.plain(used & (y == 0), length > 0), 64)
    pad, out = b"\n" * 8, []
    for segment in segments:
        extra = _trained(min(TOXIC_BYTES, max(512, sum(map(len, spoken)))), spoken, segment) if spoken else b""
        # both hold the ordinary part at equal distance, so lengths differ by what the toxic training set adds
        out.append((base + b"\n" * len(extra) + pad, base + extra + pad))
    return out


class Sample:
    """The labelled texts that a model is fitted on, in the given order.  Copies of earlier texts are left out."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        low = [t.encode().translate(_UPPER.tobytes()) for t in texts]
        once = _without_copies(low)
        self.low, self.y = [t for t, k in zip(low, once, strict=True) if k], np.asarray(toxic)[once]
        self.words, self.fold = _Words(self.low), np.arange(len(self.low)) % FOLDS

    def held_out(self, fold: int) -> list[list[tuple[np.ndarray, np.ndarray, int]]]:
        """For each size of segments the savings of the fold's texts, through dictionaries trained without them."""
        held, out = np.flatnonzero(self.fold == fold), []
        for ordinary, toxic in dictionaries(self.words, self.y, self.fold != fold, SEGMENTS):
            model = Model(ordinary, toxic, 1, np.zeros(7))
            out.append([model.savings(pa.array([self.low[i].decode() for i in some.tolist()], pa.string())) for some in np.array_split(held, len(held) // 256 + 1)])
        return out

    def model(self, saved: list[list[list[tuple]]]) -> Model:
        """The model of all texts, of the segments, the least saving and the weights that did best on all folds' savings.

        Without texts of both classes nothing is called toxic.
        """
        best, segment, cut, weights = np.inf, SEGMENTS[0], 1, np.array([0.0] * 6 + [-2.0])
        if len(set(self.y.tolist())) == 2:
            target = np.concatenate([self.y[self.fold == f] for f in range(FOLDS)]).astype(float)
            # half way between the rows as they are and classes of equal weight: a missed toxic text costs more than a false alarm
            weight = np.where(target == 1, np.sqrt((target == 0).sum() / (target == 1).sum()), 1.0)
            for i, size in enumerate(SEGMENTS):
                for least in (1, 2, 3):
                    x = np.vstack([Model(b"", b"", least, weights).features_of(*s) for f in range(FOLDS) for s in saved[f][i]])
                    w = _logistic(x, target, weight)
                    p = np.clip(1 / (1 + np.exp(-x @ w)), 1e-6, 1 - 1e-6)
                    loss = float(-(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).mean())
                    if loss < best:
                        best, segment, cut, chosen = loss, size, least, w
            weights = chosen
        ((ordinary, toxic),) = dictionaries(self.words, self.y, np.ones(len(self.low), bool), (segment,))
        return Model(ordinary, toxic, cut, weights)


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Fit on labelled texts, in the given order, here and now.

    The calibration sees every text through dictionaries trained without its fold; the dictionaries of
    the model are trained on all texts.
    """
    sample = Sample(texts, toxic)
    both = len(set(sample.y.tolist())) == 2
    return sample.model([sample.held_out(f) for f in range(FOLDS)] if both else [])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample: at most FIT_ROWS labelled rows of a class, least id hashes first.

    Of a text longer than FIT_CHARS a slice of that length is used, whose place a hash of the id gives.  An id is
    toxic if any of its labels is 1, ordinary if all others are 0; null labels and null ids label nothing.  All
    rows of a repeated id count.  Without labelled rows of both classes the model calls nothing toxic.
    Reruns take the same rows in the same order.
    """
    marks = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).filter("i is not null and y in (0, 1)")
    marks = marks.groupBy("i").agg(F.max("y").alias("y"))
    room = F.greatest(F.length("t") - FIT_CHARS, F.lit(0))
    text = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter(F.length("t") >= 1)
    text = text.select("i", F.substr("t", 1 + F.pmod(F.xxhash64("i", F.lit(1)), room + 1).cast("int"), F.lit(FIT_CHARS)).alias("t"))
    sample = []
    for y in (0, 1):
        some = marks.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(FIT_ROWS[y])
        sample.append(text.join(F.broadcast(some), "i").orderBy(F.xxhash64("i"), "i", "t").limit(FIT_ROWS[y]).select(F.col("i").cast("string").alias("i"), "t", "y"))

    rows = stored(sample[0].unionByName(sample[1]))

    def sampled(some: list[tuple[str, str, int]]) -> Sample:
        some = sorted(some, key=lambda r: (zlib.crc32(r[0].encode()), r[1]))
        return Sample([r[1] for r in some], np.array([r[2] for r in some], np.int64))

    def held_out(batches):
        folds: dict[int, list] = {}
        for b in batches:
            for fold, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                folds.setdefault(fold, []).append(tuple(row))
        for fold, some in folds.items():
            yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([pickle.dumps(sampled(some).held_out(fold))], pa.binary())], names=["fold", "saved"])

    def final(batches):
        some, saved = [], {}
        for b in batches:
            for i, t, y, fold, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if data is None:
                    some.append((i, t, y))
                else:
                    saved[fold] = pickle.loads(data)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(sampled(some).model([saved[f] for f in range(FOLDS)]))], pa.binary())], names=["model"])

    # the sample is bounded: a task for each fold reads it, and one more that trains the model of all; the driver gets the model alone
    each = rows.select(F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("fold"), "i", "t", "y")
    saved = each.repartition(4 * FOLDS, "fold").mapInArrow(held_out, "fold int, saved binary")
    none = lambda kind: F.lit(None).cast(kind)
    both = rows.select("i", "t", "y", none("int").alias("fold"), none("binary").alias("saved")).unionByName(saved.select(none("string").alias("i"), none("string").alias("t"), none("int").alias("y"), "fold", "saved"))
    fitted = both.repartition(1).mapInArrow(final, "model binary").collect()
    return pickle.loads(fitted[0][0]) if fitted else fit([], np.zeros(0, np.int64))


def with_toxicity(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add score (0 to 1, higher: more likely toxic) and predicted (1 from the threshold on).

    Whole texts are scored.  Null and empty texts, and texts of white space, have no
    window and get the score of a text without any sign.  Equal texts get equal scores;
    rows are not moved; an empty table gives an empty result; columns of the two new
    names are replaced.
    """
    packed = pickle.dumps((model.ordinary, model.toxic, model.cut, model.weights))

    def make():
        own = Model(*pickle.loads(packed))

        def compute(column: pa.Array) -> list[pa.Array]:
            score = own.score(column)
            return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

        return compute

    return add_columns(df, text_col, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make)
