"""Language identification with averaged hashed subword embeddings.

The 2-, 3- and 4-byte groups of the lower-cased text are hashed to embeddings, whose
mean goes through a linear softmax.  The model is trained by stochastic gradient
descent in numpy on a bounded sample; a part kept back sets the temperature and the
probability under which an answer counts as rejected.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ._common import add_columns, stored
from ._shingles import buffers

BUCKETS, WIDTH, GROUPS = 1 << 15, 16, (2, 3, 4)
#: About so many rows of each language are fitted on, fewer if there are so many languages that the total would exceed
#: FIT_TOTAL (but one at least), and so many characters of each.
FIT_ROWS, FIT_TOTAL, FIT_CHARS = 1200, 9600, 6000
#: Training pieces have up to so many bytes; texts are scored in slices of so many.
PIECE, SLICE = 256, 1 << 20
#: Of the texts kept back, so large a share may be rejected.
REJECTED = 0.005
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
#: Odd multipliers of the byte-group hash.
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def groups(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n bytes from every place on."""
    h = np.full(len(data) - n + 1, n * 0x165667B1 & 0xFFFFFFFF, np.uint32)
    for j in range(n):
        h = (h ^ data[j : len(data) - n + 1 + j]) * _FACTORS[j]
    return (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)


def _bag(piece: bytes) -> np.ndarray:
    data = _LOWER[np.frombuffer(b" " + piece + b" ", np.uint8)].astype(np.uint32)
    return np.concatenate([groups(data, n) for n in GROUPS if len(data) >= n])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # what each bucket adds to each language, mean taken over a text
    bias: np.ndarray
    scale: float  # inverse temperature
    floor: float  # answers below are rejected

    def logits(self, column: pa.Array) -> np.ndarray:
        data, offsets = buffers(column)
        texts = len(offsets) - 1
        out, n = np.zeros((texts, len(self.langs))), np.zeros(texts)
        data = _LOWER[data].astype(np.uint32)
        for at in range(0, len(data), SLICE):
            for size in GROUPS:
                part = data[at : at + SLICE + size - 1]
                if len(part) < size:
                    continue
                ids = groups(part, size)
                place = np.arange(at, at + len(ids))
                first = np.searchsorted(offsets, at, side="right") - 1
                last = np.searchsorted(offsets, at + len(ids) - 1, side="right") - 1
                ends = np.clip(offsets[first + 1 : last + 2], at, at + len(ids))
                owner = np.repeat(np.arange(first, last + 1), np.diff(np.concatenate([[at], ends])))
                inside = place + size <= offsets[owner + 1]
                ids, owner = ids[inside], owner[inside]
                n[first : last + 1] += np.bincount(owner - first, minlength=last + 1 - first)
                for j in range(len(self.langs)):
                    out[first : last + 1, j] += np.bincount(owner - first, weights=self.table[ids, j], minlength=last + 1 - first)
        return out / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        p = _softmax(self.logits(column) * self.scale)
        return p.argmax(axis=1), p.max(axis=1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], seed: int = 3, epochs: int = 4, rate: float = 0.5, batch: int = 32) -> Model:
    """Train on pieces of the texts; every fifth text of a language is kept back for calibration, so that each language has one to train on."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    if len(names) < 2:
        return Model(names, np.zeros((BUCKETS, len(names))), np.zeros(len(names)), 1.0, 0.0)
    place = {x: i for i, x in enumerate(names)}
    y_all = np.array([place[x] for x in langs])
    seen, held = [0] * len(names), []
    pieces, y = [], []
    for i, t in enumerate(texts):
        seen[y_all[i]] += 1
        if seen[y_all[i]] % 5 == 0:
            held.append(i)
            continue
        raw = t.encode()
        for size in (PIECE, PIECE // 4, PIECE // 12):
            at = int(rng.integers(0, max(1, len(raw) - size)))
            pieces.append(_bag(raw[at : at + size]))
            y.append(y_all[i])
    y = np.array(y)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weight, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, total = 0, max(1, epochs * (len(pieces) // batch + 1))
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for at in range(0, len(order), batch):
            take = order[at : at + batch]
            ids = np.concatenate([pieces[i] for i in take])
            sizes = np.array([len(pieces[i]) for i in take])
            mean = np.add.reduceat(embed[ids], np.cumsum(sizes) - sizes) / sizes[:, None]
            g = _softmax(mean @ weight + bias)
            g[np.arange(len(take)), y[take]] -= 1
            step = rate * (1 - steps / total)
            back = g @ weight.T / sizes[:, None]
            weight -= step * mean.T @ g / len(take) * 4
            bias -= step * g.mean(axis=0)
            np.subtract.at(embed, ids, np.repeat(step * back, sizes, axis=0).astype(np.float32) * 4)
            steps += 1
    model = Model(names, (embed @ weight).astype(np.float32), bias, 1.0, 0.0)
    if not held:
        return model
    logits = model.logits(pa.array([texts[i] for i in held], pa.string()))
    losses = {s: -np.log(np.clip(_softmax(logits * s)[np.arange(len(held)), y_all[held]], 1e-9, 1)).mean() for s in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0)}
    model.scale = min(losses, key=losses.get)
    model.floor = float(np.quantile(_softmax(logits * model.scale).max(axis=1), REJECTED))
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of each language, drawn by a hash of id and text; see FIT_ROWS.

    Every language of the rows is learned: the rows of the least hashes of each are taken, one at least.  Of a text longer
    than FIT_CHARS a slice of that length is used, whose place a hash gives.  Rows without text or language teach
    nothing; with fewer than two languages there is nothing to tell apart, and without any the model knows none.
    One task fits the sample; the driver gets the model alone.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).filter("t is not null and l is not null and t <> ''")
    rows = rows.withColumn("h", F.xxhash64("i", "t"))
    langs = rows.select("l").distinct().count()
    most = max(1, min(FIT_ROWS, FIT_TOTAL // max(1, langs)))
    first = lambda df, *order: df.withColumn("place", F.row_number().over(W.partitionBy("l").orderBy(*order))).filter(F.col("place") <= most)
    # hashes are ranked without the texts; a stored table of known size: the texts are not shuffled by language where it is small
    last = stored(first(rows.select("l", "h"), "h").groupBy("l").agg(F.max("h").alias("last")))
    room = F.greatest(F.length("t") - FIT_CHARS, F.lit(0))
    piece = F.substr("t", 1 + F.pmod(F.xxhash64("i", F.lit(1)), room + 1).cast("int"), F.lit(FIT_CHARS))
    some = rows.join(last, "l").filter("h <= last").select(F.col("i").cast("string").alias("i"), piece.alias("t"), "l", "h")
    some = first(some, "h", "i", "t").select("i", "t", "l")

    def run(batches):
        taken = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        taken.sort(key=lambda r: (str(r[0])[::-1], r[1]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1] for r in taken], [r[2] for r in taken]))], pa.binary())], names=["model"])

    fitted = some.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(fitted[0][0]) if fitted else fit([], [])


def with_language(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add lang_pred, score (its probability) and accepted (score not below the calibrated floor).

    Whole texts are read.  Null texts and those without a letter get ``und`` with score 0,
    as does everything if the model knows no language.  Equal texts get equal answers, the
    alphabetically first language on ties; rows are not moved; an empty table gives an empty
    result; columns of the new names are replaced.
    """
    packed = pickle.dumps((model.langs, model.table, model.bias, model.scale, model.floor))

    def make():
        import re

        own = Model(*pickle.loads(packed))
        letter = re.compile(r"[^\W\d_]")

        def compute(column: pa.Array) -> list[pa.Array]:
            from .token_counts import _LETTER, char_classes

            kinds = char_classes()

            def has_letter(t: str | None) -> bool:
                if not t:
                    return False
                m = letter.search(t)
                return m is not None and (kinds[ord(m.group())] == _LETTER or any(kinds[ord(c)] == _LETTER for c in t))

            known = np.array([has_letter(t) for t in column.to_pylist()], bool) & bool(own.langs)
            if not own.langs:
                return [pa.array(["und"] * len(column)), pa.array(np.zeros(len(column))), pa.array(known)]
            best, p = own.predict(column)
            names = [own.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            return [pa.array(names, pa.string()), pa.array(np.where(known, p, 0.0)), pa.array(known & (p >= own.floor))]

        return compute

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    return add_columns(df, text_col, fields, make)
