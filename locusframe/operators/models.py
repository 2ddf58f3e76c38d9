"""Linear models: fitted on sums that executors make, applied within the row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..files import materialised
from ..functions.sequence import dot
from .kernels import bit_rows
from .metrics import tagged_metrics
from .splits import keep_by_hash


#: Numbers of one row of a packed matrix; rows of one product.
PACK, ROWS = 32_768, 2048


def _matrix(batch: pa.RecordBatch, intercept: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The features of the first column, arrays or bits, with ones last if asked, and the labels of the second."""
    if pa.types.is_binary(batch.column(0).type) or pa.types.is_large_binary(batch.column(0).type):
        x = bit_rows(batch.column(0))
    else:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
        x = x.reshape(len(batch), len(x) // max(1, len(batch)))
    return np.column_stack([x, np.ones(len(x))]) if intercept else x, batch.column(1).to_numpy(zero_copy_only=False).astype(float)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of at most ROWS rows."""
    for b in batches:
        for a in range(0, len(b), ROWS):
            yield b.slice(a, ROWS)


def _pieces(key: int, part: int, flat: np.ndarray) -> pa.RecordBatch:
    """Numbers of (key, part), in rows of PACK."""
    at = range(0, len(flat), PACK)
    return pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.int32()), pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array([flat[i : i + PACK].tobytes() for i in at], pa.binary())], names=_PIECE)


_PIECE = ["key", "part", "piece", "data"]
_PIECE_FORM = "key int, part int, piece long, data binary"


def _added(parts: DataFrame) -> DataFrame:
    """Equal pieces of all tasks, added up where they meet."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *name, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = np.frombuffer(data)
                sums[tuple(name)] = sums[tuple(name)] + own if tuple(name) in sums else own
        if sums:
            keys = list(zip(*sums, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int32()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=_PIECE)

    return parts.repartition("key", "part", "piece").mapInArrow(add, _PIECE_FORM)


def _joined(pieces: list[tuple[int, bytes]]) -> np.ndarray:
    return np.concatenate([np.frombuffer(data) for _, data in sorted(pieces)])


def _newton(curve: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """The step of a curvature that is positive definite by its penalty, or the shortest step of another."""
    try:
        np.linalg.cholesky(curve)
        return np.linalg.solve(curve, slope)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(curve, slope, rcond=None)[0]


def _square(flat: np.ndarray) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    d = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
    m = np.zeros((d, d))
    m[np.triu_indices(d)] = flat
    return m + np.triu(m, 1).T


def _triangle(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the products of features, label and one."""
    x = np.column_stack([x, y, np.ones(len(x))])
    total = x.T @ x
    return total[np.triu_indices(len(total))]


def _rows(df: DataFrame, features: str, label: str, *more: Column) -> DataFrame:
    return df.filter(F.col(features).isNotNull() & F.col(label).isNotNull()).select(features, label, *more)


def gram(df: DataFrame, features: str = "features", label: str = "label", intercept: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, X'y and the number of rows.

    Each task adds up its own upper triangle and packs it; equal pieces of all tasks meet in one task and are added
    there, so the driver gets one triangle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in filter(len, batches):
            own = _triangle(*_matrix(b, intercept))
            total = own if total is None else total + own
        if total is not None:
            yield _pieces(0, 0, total)

    pieces = _added(_rows(df, features, label).mapInArrow(run, _PIECE_FORM)).collect()
    if not pieces:
        return np.zeros((0, 0)), np.zeros(0), 0
    m = _square(_joined([(r["piece"], r["data"]) for r in pieces]))
    return m[:-2, :-2], m[:-2, -2], int(round(m[-1, -1]))


def ridge_fit(df: DataFrame, reg: float, features: str = "features", label: str = "label", intercept: bool = False) -> np.ndarray:
    """Weights that minimise the squared error plus reg times their squared length (an intercept, last, is free)."""
    xx, xy, _ = gram(df, features, label, intercept)
    penalty = np.full(len(xy), reg)
    if intercept and len(xy):
        penalty[-1] = 0.0
    return np.linalg.lstsq(xx + np.diag(penalty), xy, rcond=None)[0] if len(xy) else np.zeros(0)


def ridge_fit_blocks(df: DataFrame, reg: float, block: int = 1024, epochs: int = 20, tolerance: float = 1e-9, features: str = "features", label: str = "label") -> np.ndarray:
    """As ridge_fit without an intercept, for many features: one block of weights after the other against the residual.

    The blocks' own products are summed once, so the driver gets features times block numbers; each step then reads
    the rows, takes the residual from the weights so far, and sums one product a feature of the block.  Ends when
    an epoch changes no weight by more than tolerance times the largest.  The rows are written once and read from there.
    """
    rows = materialised(_rows(df, features, label))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in filter(len, batches):
            x, y = _matrix(b)
            for i, at in enumerate(range(0, x.shape[1], block)):
                own = _triangle(x[:, at : at + block], y)
                sums[i] = sums[i] + own if i in sums else own
        for i, flat in sums.items():
            yield _pieces(i, 0, flat)

    held: dict[int, list] = {}
    for r in _added(rows.mapInArrow(products, _PIECE_FORM)).collect():
        held.setdefault(r["key"], []).append((r["piece"], r["data"]))
    own = {i: _square(_joined(p))[:-2, :-2] for i, p in held.items()}
    w = np.zeros(sum(len(m) for m in own.values()))
    for _ in range(epochs):
        before = w.copy()
        for i, m in sorted(own.items()):
            part = slice(i * block, i * block + len(m))

            def against(batches: Iterator[pa.RecordBatch], part=part, w=w.copy()) -> Iterator[pa.RecordBatch]:
                total = None
                for b in filter(len, batches):
                    x, y = _matrix(b)
                    one = x[:, part].T @ (y - x @ w)
                    total = one if total is None else total + one
                if total is not None:
                    yield _pieces(0, 0, total)

            r = _joined([(x["piece"], x["data"]) for x in _added(rows.mapInArrow(against, _PIECE_FORM)).collect()])
            w[part] = np.linalg.lstsq(m + reg * np.eye(len(m)), r + m @ w[part], rcond=None)[0]
        if len(w) and np.abs(w - before).max() <= tolerance * max(np.abs(w).max(), 1e-300):
            break
    return w


@dataclass
class LinearModel:
    """Weights, intercept and the mean of every feature, which is taken off before the weights apply."""

    weights: np.ndarray
    intercept: float
    means: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, reg: float, features: str = "features", label: str = "label") -> LinearModel:
        """Ridge weights of centred features; the intercept is the mean label.  Without rows, a model of no features."""
        xx, xy, n = gram(df, features, label, intercept=True)
        if not n:
            return cls(np.zeros(0), 0.0, np.zeros(0))
        sums, means = xx[-1, :-1], xx[-1, :-1] / n
        mean = xy[-1] / n
        centred = xx[:-1, :-1] - np.outer(sums, means)
        return cls(np.linalg.lstsq(centred + reg * np.eye(len(means)), xy[:-1] - sums * mean, rcond=None)[0], float(mean), means)

    def predict(self, df: DataFrame, features: str = "features", out: str = "score") -> DataFrame:
        """The score of every row; null where the features are."""
        return linear_predict(df, np.append(self.weights, self.intercept - float(self.weights @ self.means)), features, out, intercept=True)

    def save(self, spark: SparkSession, path: str, block: int = 1024) -> None:
        """Rows kind (weight, mean or intercept), block, row, col, w."""
        rows = [(kind, i // block, i, 0, float(x)) for kind, values in (("weight", self.weights), ("mean", self.means), ("intercept", [self.intercept])) for i, x in enumerate(values)]
        spark.createDataFrame(rows, "kind string, block int, row int, col int, w double").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearModel:
        rows = spark.read.parquet(path).toPandas().sort_values("row")
        of = {kind: rows.loc[rows["kind"] == kind, "w"].to_numpy() for kind in ("weight", "mean", "intercept")}
        return cls(of["weight"], float(of["intercept"][0]), of["mean"])


def linear_score(features: Column, weights: np.ndarray, intercept: bool = False) -> Column:
    w = [float(x) for x in weights]
    out = dot(features.cast("array<double>"), F.array(*[F.lit(x) for x in (w[:-1] if intercept else w)]))
    return out + w[-1] if intercept else out


def linear_predict(df: DataFrame, weights: np.ndarray, features: str = "features", out: str = "score", intercept: bool = False) -> DataFrame:
    return df.withColumn(out, linear_score(F.col(features), weights, intercept))


def gated(signal: Column, score: Column) -> Column:
    """The score where there is signal, 0.0 elsewhere."""
    return F.when(signal, score).otherwise(0.0)


def arg_max_class(score0: Column, score1: Column) -> Column:
    return F.when(score1 > score0, 1).otherwise(0)


def logistic_fit(df: DataFrame, iterations: int = 10, reg: float = 0.0, features: str = "features", label: str = "label") -> np.ndarray:
    """Weights and intercept (last) of a two-class logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    model = LogisticRegression(maxIter=iterations, regParam=reg).fit(rows)
    return np.append(model.coefficients.toArray(), model.intercept)


def logistic_predict(df: DataFrame, weights: np.ndarray, features: str = "features", out: str = "score") -> DataFrame:
    z = linear_score(F.col(features), weights, intercept=True)
    return df.withColumn(out, 1.0 / (1.0 + F.exp(-z)))


def hard_negative_mining(df: DataFrame, reg: float, rate: float, rounds: int, threshold: float = 0.5, key: str = "id", seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """Last weights, and the rows of the last fit (a mined negative once for each round that missed it).

    Each round fits on positives and chosen negatives, scores all negatives, and adds those
    above the threshold.  Rounds are cut by written tables, which survive lost executors.
    """
    used = materialised(df.filter((F.col("label") == 1) | ((F.col("label") == 0) & keep_by_hash(F.col(key), rate, seed))))
    weights = ridge_fit(used, reg)
    for _ in range(rounds):
        missed = linear_predict(df.filter("label = 0"), weights).filter(F.col("score") > threshold).drop("score")
        used = materialised(used.unionByName(missed))
        weights = ridge_fit(used, reg)
    return weights, used


def save_model(spark: SparkSession, weights: np.ndarray, path: str, block: int = 1024) -> None:
    """Weights as rows block, row, col, w."""
    w = weights.reshape(len(weights), -1)
    rows = [(i // block, i, j, float(w[i, j])) for i in range(w.shape[0]) for j in range(w.shape[1])]
    spark.createDataFrame(rows, "block int, row int, col int, w double").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(path).toPandas()
    w = np.zeros((int(rows["row"].max()) + 1, int(rows["col"].max()) + 1)) if len(rows) else np.zeros((0, 1))
    w[rows["row"], rows["col"]] = rows["w"]
    return w[:, 0] if w.shape[1] == 1 else w


def fold_sets(fold: Column, n_folds: int) -> tuple[Column, Column]:
    """train_folds and test_folds of a row that one fold tests and all others train on; a null fold does neither."""
    every = F.array(*map(F.lit, range(n_folds)))
    held = F.when(fold.isNotNull(), F.array(fold.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(fold.isNotNull(), F.array_except(every, held)).otherwise(F.array().cast("array<int>")), held


def _members(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of a column of lists."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(column)), size), column.flatten().to_numpy(zero_copy_only=False)


def fold_weights(df: DataFrame, n_folds: int, rates: tuple[float, ...], regs: tuple[float, ...], key: str = "id", seed: int = 0, features: str = "features", label: str = "label") -> DataFrame:
    """fold, rate, reg and weights of a ridge model for each, from one scan.

    df has train_folds, the folds that a row trains.  A fit at a rate takes all positives and that share of the
    negatives, the same ones at every higher rate.  Products are summed over all rows and over the rows that a fold leaves
    out, each by the lowest rate that takes a row; a fold's own are the difference.  Each fold is solved in a task of its own.
    """
    steps = sorted(set(rates))
    bucket = F.when(F.col(label) == 1, 0)
    for i, rate in enumerate(steps):
        bucket = bucket.when((F.col(label) == 0) & keep_by_hash(F.col(key), rate, seed), i)
    left_out = F.array_except(F.array(*map(F.lit, range(n_folds))), F.coalesce("train_folds", F.array().cast("array<int>")))
    rows = _rows(df, features, label, bucket.alias("bucket"), left_out.alias("left_out")).filter("bucket IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in filter(len, batches):
            (x, y), own = _matrix(b), b.column(2).to_numpy()
            row, fold = _members(b.column(3))
            for i in range(len(steps)):
                some = [(-1, np.flatnonzero(own == i)), *((f, row[(fold == f) & (own[row] == i)]) for f in np.unique(fold))]
                for f, at in some:
                    if len(at):
                        flat = _triangle(x[at], y[at])
                        sums[int(f), i] = sums[int(f), i] + flat if (int(f), i) in sums else flat
        for (f, i), flat in sums.items():
            yield _pieces(f, i, flat)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[tuple[int, int], list]] = {}
        for b in batches:
            for fold, *_, k, i, piece, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(fold, {}).setdefault((k, i), []).append((piece, data))
        for fold, parts in held.items():
            total, out = 0, []
            for i, rate in enumerate(steps):
                if (-1, i) in parts:
                    total = total + _joined(parts[-1, i])
                if (fold, i) in parts:
                    total = total - _joined(parts[fold, i])
                if isinstance(total, int):
                    continue
                m = _square(total)
                out += [(fold, rate, reg, np.linalg.lstsq(m[:-2, :-2] + reg * np.eye(len(m) - 2), m[:-2, -2], rcond=None)[0]) for reg in regs]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.float64()), pa.array([o[3] for o in out], pa.list_(pa.float64()))], names=["fold", "rate", "reg", "weights"])

    summed = _added(rows.mapInArrow(run, _PIECE_FORM))
    every = F.sequence(F.lit(0), F.lit(n_folds - 1))
    dealt = summed.withColumn("fold", F.explode(F.when(F.col("key") < 0, every).otherwise(F.array("key")))).select("fold", *_PIECE)
    return dealt.repartition("fold").mapInArrow(solve, "fold int, rate double, reg double, weights array<double>")


def fold_scores(df: DataFrame, models: DataFrame, features: str = "features", label: str = "label", link: str = "linear") -> DataFrame:
    """Label and score of each test row under every model of its folds, with the models' other columns.

    df has test_folds, models fold and weights (one more than features: an intercept).  Models go to every task: folds times
    settings times features numbers.
    """
    names = [c for c in models.columns if c != "weights"]
    held: dict[int, list] = {}
    for r in models.collect():
        held.setdefault(r["fold"], []).append((tuple(r[c] for c in names), np.array(r["weights"])))
    kinds = [models.schema[c] for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in _blocks(batches):
            x, y = _matrix(b)
            row, fold = _members(b.column(2))
            for f in np.unique(fold).tolist():
                at = row[fold == f]
                for setting, w in held.get(f, ()):
                    score = x[at] @ w[: x.shape[1]] + (w[-1] if len(w) > x.shape[1] else 0.0)
                    score = 1 / (1 + np.exp(-score)) if link == "logistic" else score
                    yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(at), to_arrow_type(k.dataType)) for v, k in zip(setting, kinds, strict=True)), pa.array(y[at]), pa.array(score)], names=[*names, "label", "score"])

    form = ", ".join(f"{k.name} {k.dataType.simpleString()}" for k in kinds) + ", label double, score double"
    return _rows(df, features, label, F.coalesce("test_folds", F.array().cast("array<int>")).alias("test_folds")).mapInArrow(run, form)


def fold_logistic(df: DataFrame, n_folds: int, iterations: int, reg: float, features: str = "features", label: str = "label", written: bool = False) -> DataFrame:
    """fold and weights (the intercept last) of logistic models, all folds a scan for each Newton step.

    df has train_folds; it is written first if it is not a written table already.  features are arrays, or bits of zeros and
    ones, of which the zeros up to a whole byte are features without weight (reg above 0).  reg, times the rows of a fold, holds the weights down, but not the intercept.  A fold without
    training rows has no model.
    """
    rows = _rows(df, features, label, F.coalesce("train_folds", F.array().cast("array<int>")).alias("train_folds"))
    rows = rows if written else materialised(rows)
    weights: dict[int, np.ndarray] = {}
    for _ in range(iterations):

        def step(batches: Iterator[pa.RecordBatch], weights=dict(weights)) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in _blocks(batches):
                (x, y), (row, fold) = _matrix(b, intercept=True), _members(b.column(2))
                for f in np.unique(fold).tolist():
                    one = x[row[fold == f]]
                    p = 1 / (1 + np.exp(-(one @ weights[f]))) if f in weights else np.full(len(one), 0.5)
                    half = one * np.sqrt(p * (1 - p))[:, None]
                    curve = half.T @ half  # numpy makes one triangle of a matrix and itself
                    own = np.concatenate([[len(one)], one.T @ (y[row[fold == f]] - p), curve[np.triu_indices(len(curve))]])
                    sums[f] = sums[f] + own if f in sums else own
            for f, flat in sums.items():
                yield _pieces(int(f), 0, flat)

        def solve(batches: Iterator[pa.RecordBatch], weights=dict(weights)) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for b in batches:
                for f, piece, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    held.setdefault(f, []).append((piece, data))
            for f, pieces in held.items():
                flat = _joined(pieces)
                d = int((np.sqrt(8 * (len(flat) - 1) + 9) - 3) / 2)
                w = weights.get(f, np.zeros(d))
                penalty = np.append(np.full(d - 1, reg * flat[0]), 0.0)
                w = w + _newton(_square(flat[1 + d :]) + np.diag(penalty), flat[1 : 1 + d] - penalty * w)
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([w], pa.list_(pa.float64()))], names=["fold", "weights"])

        summed = _added(rows.mapInArrow(step, _PIECE_FORM))
        found = summed.repartition("key").mapInArrow(solve, "fold int, weights array<double>").collect()  # folds times features numbers
        weights = {r["fold"]: np.array(r["weights"]) for r in found}
    made = [(f, w.tolist()) for f, w in sorted(weights.items())]
    return df.sparkSession.createDataFrame(made, "fold int, weights array<double>")


def _every_fold(metrics: DataFrame, counts: DataFrame, n_folds: int) -> DataFrame:
    """Metrics beside the counts of every fold, also of one that tests or trains nothing."""
    folds = metrics.sparkSession.range(n_folds).select(F.col("id").cast("int").alias("fold"))
    zero = {c: 0 for c in counts.columns if c != "fold"}
    return folds.join(counts, "fold", "left").fillna(zero).join(metrics, "fold", "left")


def _fold_counts(df: DataFrame) -> DataFrame:
    """fold, train, test and test_positives, of the rows with features and label."""
    df = df.filter("label IS NOT NULL AND features IS NOT NULL")
    one = lambda c: df.select("label", F.explode(c).alias("fold"))
    test = one("test_folds").groupBy("fold").agg(F.count("*").alias("test"), F.count_if(F.col("label") == 1).alias("test_positives"))
    return one("train_folds").groupBy("fold").agg(F.count("*").alias("train")).join(test, "fold", "full")


def cross_validate(df: DataFrame, n_folds: int, rates: tuple[float, ...], regs: tuple[float, ...], key: str = "id", seed: int = 0) -> DataFrame:
    """fold, counts, rate, reg and metrics of ridge models; df has train_folds and test_folds.

    Two scans of one written table, for any number of folds, rates and regularisers.  A fold that tests or trains nothing has a row without metrics.
    """
    data = materialised(df.select("label", "features", F.col(key).alias("id"), "train_folds", "test_folds"))
    models = fold_weights(data, n_folds, rates, regs, "id", seed)
    scored = fold_scores(data, models).withColumn("score", F.round("score", 9))
    return _every_fold(tagged_metrics(scored, "test", keys=["fold", "rate", "reg"]), _fold_counts(data), n_folds)


def cross_validate_logistic(df: DataFrame, n_folds: int, iterations: int, reg: float, tag: str = "cv", gate: Column | None = None) -> DataFrame:
    """fold, counts and metrics of logistic models; df has train_folds and test_folds.  Where gate is false the score is 0."""
    gate = F.lit(True) if gate is None else gate
    data = materialised(df.select("label", "features", gate.alias("gate"), "train_folds", "test_folds"))
    scored = fold_scores(data.filter("gate"), fold_logistic(data, n_folds, iterations, reg, written=True), link="logistic").withColumn("score", F.round("score", 6))
    shut = data.filter("NOT gate").select(F.explode("test_folds").alias("fold"), F.col("label").cast("double").alias("label"), F.lit(0.0).alias("score"))
    return _every_fold(tagged_metrics(scored.unionByName(shut), tag, keys=["fold"]), _fold_counts(data), n_folds)
