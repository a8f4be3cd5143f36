"""A feed-forward network trained in parallel: every partition learns from its rows, then all agree.

Rows are packed once into blocks of a few thousand and written. In each epoch every partition starts
from the broadcast weights, and makes mini-batch steps of Adam block by block, each in a new order; the
weights and moments of all partitions are averaged by their rows. There are as many partitions as
PART_ROWS asks for, MOST_PARTS at most, so that what the driver averages has a fixed bound, and few
rows train as on one machine. Some rows of each class are kept apart in every block; their loss says
when to stop, and the best epoch's weights stand.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincart import tables

BLOCK_ROWS, PART_ROWS, MOST_PARTS = 2048, 20_000, 256


class BadOptions(ValueError):
    """Options that no network can be trained with."""


@dataclass(frozen=True)
class Options:
    hidden: tuple[int, ...] = (64, 32)
    epochs: int = 50
    learning_rate: float = 1e-3
    batch_size: int = 32
    dropout: float = 0.0
    early_stopping: bool = True
    patience: int = 10
    validation_fraction: float = 0.15
    seed: int = 0


def checked(given: dict) -> Options:
    """Options from names and values; BadOptions tells which one cannot be and why."""

    def number(name: str, value: object, whole: bool, holds, must: str):
        if isinstance(value, bool) or not isinstance(value, int | float | np.integer | np.floating):
            raise BadOptions(f"{name} must be a number, not {value!r}")
        if not math.isfinite(value) or whole and value != int(value) or not holds(value):
            raise BadOptions(f"{name} must be {must}, not {value!r}")
        return int(value) if whole else float(value)

    if unknown := set(given) - set(Options.__dataclass_fields__):
        raise BadOptions(f"a network has no option {', '.join(sorted(unknown))}")
    told = asdict(Options()) | given
    hidden = told["hidden"]
    if isinstance(hidden, str | bytes) or not isinstance(hidden, list | tuple) or not hidden:
        raise BadOptions(f"hidden must be a list of one width or more, not {hidden!r}")
    if not isinstance(told["early_stopping"], bool):
        raise BadOptions(f"early_stopping must be true or false, not {told['early_stopping']!r}")
    above = lambda least: (lambda x: x >= least)
    return Options(
        tuple(number(f"hidden[{i}]", x, True, above(1), "a whole number from 1") for i, x in enumerate(hidden)),
        number("epochs", told["epochs"], True, above(1), "a whole number from 1"),
        number("learning_rate", told["learning_rate"], False, lambda x: x > 0, "above 0"),
        number("batch_size", told["batch_size"], True, above(1), "a whole number from 1"),
        number("dropout", told["dropout"], False, lambda x: 0 <= x < 1, "from 0 and below 1"),
        told["early_stopping"],
        number("patience", told["patience"], True, above(1), "a whole number from 1"),
        number("validation_fraction", told["validation_fraction"], False, lambda x: 0 < x < 1, "between 0 and 1"),
        number("seed", told["seed"], True, above(0), "a whole number from 0"),
    )


def start(sizes: list[int], seed: int) -> np.ndarray:
    """All weights and biases in one vector; weights as wide as their inputs ask for, biases 0."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.append(rng.normal(0, math.sqrt(2 / max(a, 1)), a * b), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)])


def layers(theta: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        out.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _chances(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def outputs(theta: np.ndarray, sizes: list[int], x: np.ndarray) -> np.ndarray:
    parts = layers(theta, sizes)
    for w, b in parts[:-1]:
        x = np.maximum(x @ w + b, 0)
    return x @ parts[-1][0] + parts[-1][1]


def losses(theta: np.ndarray, sizes: list[int], x: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    """Log loss of each row, or its squared error where there are no classes."""
    z = outputs(theta, sizes, x)
    return -np.log(np.maximum(_chances(z)[np.arange(len(y)), y.astype(int)], 1e-12)) if classes else (z[:, 0] - y) ** 2


def gradient(theta: np.ndarray, sizes: list[int], x: np.ndarray, y: np.ndarray, classes: int, dropout: float, rng: np.random.Generator | None) -> np.ndarray:
    """Of the mean loss of the rows."""
    parts, seen, masks = layers(theta, sizes), [x], []
    for w, b in parts[:-1]:
        x = np.maximum(x @ w + b, 0)
        masks.append((rng.random(x.shape) >= dropout) / (1 - dropout) if dropout else 1.0)
        x = x * masks[-1]
        seen.append(x)
    z = x @ parts[-1][0] + parts[-1][1]
    if classes:
        back = _chances(z)
        back[np.arange(len(y)), y.astype(int)] -= 1
    else:
        back = 2 * (z - y[:, None])
    back /= len(y)
    out = []
    for i in reversed(range(len(parts))):
        out += [back.sum(axis=0), (seen[i].T @ back).ravel()]
        if i:
            back = (back @ parts[i][0].T) * masks[i - 1] * (seen[i] > 0)
    return np.concatenate(out[::-1])


_PACKED = "part int, place int, rows int, kept_apart int, x binary, y binary"


def packed(df: DataFrame, features: str, label: str, stratified: bool, options: Options) -> DataFrame:
    """Blocks of rows, those kept apart first: of each class of a block its share, what is left over going to the next block."""
    n = df.count()
    parts = min(max(-(-n // PART_ROWS), 1), MOST_PARTS)
    rows = df.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y")).repartition(parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, owed, place = TaskContext.get().partitionId(), {}, 0
        rng = np.random.default_rng((options.seed, part, 1))
        held: list[pd.DataFrame] = []

        def block() -> pd.DataFrame:
            nonlocal place
            rows = pd.concat(held)
            x, y = np.stack(rows["x"].to_numpy()).astype(np.float32), rows["y"].to_numpy(float)
            apart = np.zeros(len(y), bool)
            for c in np.unique(y) if stratified else [None]:
                of = rng.permutation(np.flatnonzero(y == c) if stratified else np.arange(len(y)))
                # the first block of a class rounds as a whole set would
                owed[c] = owed.get(c, 0.5) + options.validation_fraction * len(of)
                take = min(int(owed[c]), max(len(of) - 1, 0))
                owed[c] -= take
                apart[of[:take]] = True
            order = np.concatenate([np.flatnonzero(apart), np.flatnonzero(~apart)])
            place += 1
            return pd.DataFrame({"part": [part], "place": [place], "rows": [len(y)], "kept_apart": [int(apart.sum())], "x": [x[order].tobytes()], "y": [y[order].tobytes()]})

        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                held.append(batch.iloc[at : at + BLOCK_ROWS])
                if sum(map(len, held)) >= BLOCK_ROWS:
                    yield block()
                    held.clear()
        if held:
            yield block()

    return tables.written(rows.mapInPandas(run, _PACKED))


@dataclass
class _State:
    theta: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0


def _epoch(blocks: DataFrame, state: _State, sizes: list[int], classes: int, options: Options, epoch: int) -> tuple[_State, float, float]:
    """The state after an epoch, and the mean losses before it of the rows kept apart and of the others."""
    shared = blocks.sparkSession.sparkContext.broadcast((state.theta.tobytes(), state.first.tobytes(), state.second.tobytes(), state.steps))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        theta, first, second = (np.frombuffer(x, float).copy() for x in shared.value[:3])
        steps, begin = shared.value[3], theta.copy()
        sums, counts = np.zeros(2), np.zeros(2, int)
        rng = None
        for r in (r for batch in batches for r in batch.to_dict("records")):
            rng = rng or np.random.default_rng((options.seed, r["part"], epoch, 2))
            x = np.frombuffer(r["x"], np.float32).reshape(r["rows"], -1).astype(float)
            y = np.frombuffer(r["y"], float)
            k = int(r["kept_apart"])
            for j, part in enumerate((slice(0, k), slice(k, None))):
                if len(y[part]):
                    sums[j] += losses(begin, sizes, x[part], y[part], classes).sum()
                    counts[j] += len(y[part])
            order = k + rng.permutation(len(y) - k)
            for at in range(0, len(order), options.batch_size):
                some = order[at : at + options.batch_size]
                g = gradient(theta, sizes, x[some], y[some], classes, options.dropout, rng)
                steps += 1
                first = 0.9 * first + 0.1 * g
                second = 0.999 * second + 0.001 * g * g
                theta = theta - options.learning_rate * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.999**steps)) + 1e-8)
        if rng:
            yield pd.DataFrame({"n": [int(counts[1])], "steps": [steps], "apart": [sums[0]], "n_apart": [int(counts[0])], "own": [sums[1]], "theta": [theta.tobytes()], "first": [first.tobytes()], "second": [second.tobytes()]})

    schema = "n long, steps long, apart double, n_apart long, own double, theta binary, first binary, second binary"
    # a row of each task, MOST_PARTS at most
    rows = sorted(blocks.coalesce(MOST_PARTS).mapInPandas(run, schema).collect(), key=lambda r: bytes(r["theta"]))
    shared.destroy()
    total = max(sum(r["n"] for r in rows), 1)
    mean = lambda c: sum(np.frombuffer(r[c], float) * (r["n"] / total) for r in rows)
    n_apart = sum(r["n_apart"] for r in rows)
    # a loss that is no number comes back as null
    added = lambda c: sum(math.nan if r[c] is None else r[c] for r in rows)
    apart = added("apart") / n_apart if n_apart else math.nan
    return _State(mean("theta"), mean("first"), mean("second"), max(r["steps"] for r in rows)), apart, added("own") / total


def train(df: DataFrame, features: str, label: str, classes: int, options: Options) -> tuple[np.ndarray, list[int], dict]:
    """Weights, layer sizes and a report of the epochs; ``classes`` is 0 for a number. Labels must be scaled."""
    blocks = packed(df, features, label, classes > 0, options)
    try:
        first = blocks.select("rows", F.octet_length("x").alias("bytes")).first()
        if first is None:
            raise BadOptions("no rows to train on")
        sizes = [first["bytes"] // 4 // first["rows"], *options.hidden, classes or 1]
        theta = start(sizes, options.seed)
        state, best, told = _State(theta, theta * 0, theta * 0), (math.inf, 0, theta), []
        watched = blocks.agg(F.coalesce(F.sum("kept_apart"), F.lit(0))).first()[0] > 0
        for epoch in range(options.epochs + 1):
            before = state.theta
            state, apart, own = _epoch(blocks, state, sizes, classes, options, epoch)
            watch = apart if watched else own
            told.append({"epoch": epoch, "loss": own, "validation_loss": apart if watched else None})
            if not math.isfinite(watch):
                raise BadOptions(f"the loss is no number after epoch {epoch}: learning_rate {options.learning_rate:g} may be too high")
            if watch < best[0]:
                best = (watch, epoch, before)
            if options.early_stopping and epoch - best[1] >= options.patience:
                break
    finally:
        tables.drop(blocks)
    last = told[-1]["epoch"]
    kept = best if options.early_stopping else (told[-1]["validation_loss"] or told[-1]["loss"], last, before)
    return kept[2], sizes, {"epochs": told, "ran": last, "kept_epoch": kept[1], "stopped_early": last < options.epochs, "options": asdict(options)}


class _Fitted(Params):
    weights = Param(Params._dummy(), "weights", "all weights and biases", TypeConverters.toListFloat)
    sizes = Param(Params._dummy(), "sizes", "sizes of the layers", TypeConverters.toListInt)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for a number", TypeConverters.toInt)
    scale = Param(Params._dummy(), "scale", "mean and deviation of a numeric target", TypeConverters.toListFloat)
    report = Param(Params._dummy(), "report", "the epochs, as JSON", TypeConverters.toString)


class NetworkModel(Model, _Fitted, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A trained network: ``prediction`` and, for classes, ``probability``."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes, sizes = self.getOrDefault(self.classes), self.getOrDefault(self.sizes)
        weights = np.array(self.getOrDefault(self.weights))
        mean, deviation = self.getOrDefault(self.scale)

        def run(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            z = outputs(weights, sizes, np.stack(x.to_numpy()).astype(np.float32).astype(float))
            return pd.Series(list(_chances(z) if classes else z * deviation + mean))

        out = dataset.withColumn("_out", F.pandas_udf(run, "array<double>")(vector_to_array(F.col(self.getFeaturesCol()))))
        if not classes:
            return out.withColumn(self.getPredictionCol(), F.get("_out", F.lit(0))).drop("_out")
        best = F.array_position("_out", F.array_max("_out")) - 1
        return out.withColumn("probability", array_to_vector("_out")).withColumn(self.getPredictionCol(), best.cast("double")).drop("_out")

    def told(self) -> dict:
        return json.loads(self.getOrDefault(self.report))


class Network(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Trains a network; ``classes`` is the number of label codes, or 0 for a number."""

    classes = Param(Params._dummy(), "classes", "number of classes, 0 for a number", TypeConverters.toInt)
    options = Param(Params._dummy(), "options", "options of the training, as JSON", TypeConverters.toString)

    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", classes: int = 0, options: str = "{}") -> None:
        super().__init__()
        checked(json.loads(options))
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, classes=classes, options=options)

    def _fit(self, dataset: DataFrame) -> NetworkModel:
        options, classes, label = checked(json.loads(self.getOrDefault(self.options))), self.getOrDefault(self.classes), self.getLabelCol()
        mean, deviation = 0.0, 1.0
        if not classes:
            told = dataset.agg(F.avg(label), F.stddev_pop(label)).first()
            mean, deviation = float(told[0] or 0.0), float(told[1] or 1.0)
            dataset = dataset.withColumn(label, (F.col(label) - mean) / deviation)
        theta, sizes, report = train(dataset, self.getFeaturesCol(), label, classes, options)
        out = NetworkModel()
        out._set(weights=theta.tolist(), sizes=sizes, classes=classes, scale=[mean, deviation], report=json.dumps(report), featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
        return out
