"""Support vector machines with a Gaussian kernel, by random Fourier features.

cos and sin of random projections are features whose inner products are close to the kernel: for any
two rows the error is above ``error`` with a chance of at most ``chance``, if there are
``pairs_for(error, chance)`` projections (Hoeffding's inequality). A linear machine on them is then
a kernel machine: Spark's linear classifier, or the regression below, whose passes only sum a
matrix of features by features.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincart import tables

ERROR, CHANCE = 0.15, 0.01
#: Partial sums that one task adds, and rows whose features a task makes or sums at once.
TOGETHER, AT_ONCE = 16, 256


def pairs_for(error: float = ERROR, chance: float = CHANCE) -> int:
    """Projections with which the kernel of two rows is off by more than ``error`` with at most ``chance``."""
    return math.ceil(2 * math.log(2 / chance) / error**2)


def projections(size: int, pairs: int, gamma: float, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, math.sqrt(2 * gamma), (size, pairs))


def fourier(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w
    return np.concatenate([np.cos(z), np.sin(z)], axis=1) / math.sqrt(w.shape[1])


def features(batches: Iterator[pd.Series], pairs: int, gamma: float, seed: int) -> Iterator[pd.Series]:
    """The features of rows, handed on few rows at a time: they are far wider than the inputs, of which a batch may have many rows."""
    for x in batches:
        for i in range(0, len(x), AT_ONCE):
            rows = np.stack(x.iloc[i : i + AT_ONCE].to_numpy())
            yield pd.Series(list(fourier(rows, projections(rows.shape[1], pairs, gamma, seed))))


class RandomFourierModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    gamma = Param(Params._dummy(), "gamma", "width of the kernel exp(-gamma |x - y|^2)", TypeConverters.toFloat)
    pairs = Param(Params._dummy(), "pairs", "number of projections", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of the projections", TypeConverters.toInt)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, pairs, seed = (self.getOrDefault(p) for p in (self.gamma, self.pairs, self.seed))

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            return features(batches, pairs, gamma, seed)

        mapped = F.pandas_udf(run, "array<double>")(vector_to_array(F.col(self.getInputCol())))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(mapped))


class RandomFourier(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Features of the kernel; a ``gamma`` of 0 is one over the number of inputs times their common variance."""

    gamma = Param(Params._dummy(), "gamma", "width of the kernel, 0 to take it from the rows", TypeConverters.toFloat)
    error = Param(Params._dummy(), "error", "of the kernel of two rows", TypeConverters.toFloat)
    chance = Param(Params._dummy(), "chance", "of a larger error", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "of the projections", TypeConverters.toInt)

    def __init__(self, *, inputCol: str = "features", outputCol: str = "kernel_features", gamma: float = 0.0, error: float = ERROR, chance: float = CHANCE, seed: int = 0) -> None:
        super().__init__()
        if gamma < 0 or not 0 < error < 1 or not 0 < chance < 1:
            raise ValueError("gamma must not be below 0, and error and chance lie between 0 and 1")
        self._set(inputCol=inputCol, outputCol=outputCol, gamma=gamma, error=error, chance=chance, seed=seed)

    def _fit(self, dataset: DataFrame) -> RandomFourierModel:
        gamma = self.getOrDefault(self.gamma)
        if not gamma:
            # one row for each input
            each = dataset.select(F.posexplode(vector_to_array(F.col(self.getInputCol()))).alias("i", "x"))
            told = each.agg(F.var_pop("x").alias("v"), F.max("i").alias("i")).first()
            gamma = 1 / ((told["i"] + 1) * told["v"]) if told["v"] else 1.0
        out = RandomFourierModel()
        out._set(gamma=float(gamma), pairs=pairs_for(self.getOrDefault(self.error), self.getOrDefault(self.chance)), seed=self.getOrDefault(self.seed), inputCol=self.getInputCol(), outputCol=self.getOutputCol())
        return out


def summed(rows: DataFrame, of, size: int) -> np.ndarray:
    """The sum over all partitions of the vector of ``size`` that ``of`` makes of their batches (x, y)."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for batch in batches:
            for i in range(0, len(batch), AT_ONCE):
                some = batch.iloc[i : i + AT_ONCE]
                total += of(np.stack(some["x"].to_numpy()), some["y"].to_numpy(float))
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "sums": [total.tobytes()]})

    def both(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size)
        for s in found.sort_values("part")["sums"]:
            total += np.frombuffer(s, float)
        return pd.DataFrame({"part": [key[0]], "sums": [total.tobytes()]})

    schema = "part long, sums binary"
    parts = rows.mapInPandas(own, schema)
    parts = tables.written(parts)
    while parts.select(F.max("part")).first()[0]:
        fewer = tables.written(parts.groupBy(F.floor(F.col("part") / TOGETHER).alias("at")).applyInPandas(both, schema))
        tables.drop(parts)
        parts = fewer
    total = parts.first()
    tables.drop(parts)
    return np.frombuffer(total["sums"], float) if total else np.zeros(size)


class SupportVectorRegressionModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    coefficients = Param(Params._dummy(), "coefficients", "of the features, and the intercept", TypeConverters.toListFloat)
    objectives = Param(Params._dummy(), "objectives", "before each pass", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        *w, b = self.getOrDefault(self.coefficients)
        told = F.pandas_udf(lambda x: pd.Series(np.stack(x.to_numpy()) @ np.array(w) + b if len(x) else []), "double")
        return dataset.withColumn(self.getPredictionCol(), told(vector_to_array(F.col(self.getFeaturesCol()))))


class SupportVectorRegression(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Minimises |w|^2 / 2 + C * sum(max(0, |w x + b - y| - epsilon)).

    Each pass replaces a row's loss by a parabola that lies above it and touches it at its present
    residual; the parabolas' sum is solved exactly, so that the objective falls in every pass.
    """

    C = Param(Params._dummy(), "C", "weight of the losses", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "residuals that cost nothing", TypeConverters.toFloat)
    passes = Param(Params._dummy(), "passes", "over the rows at most", TypeConverters.toInt)

    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", C: float = 1.0, epsilon: float = 0.1, passes: int = 20) -> None:
        super().__init__()
        if C <= 0 or epsilon < 0 or passes < 1:
            raise ValueError("C must be above 0, epsilon not below it and passes 1 or more")
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, C=C, epsilon=epsilon, passes=passes)

    def _fit(self, dataset: DataFrame) -> SupportVectorRegressionModel:
        c, epsilon = self.getOrDefault(self.C), self.getOrDefault(self.epsilon)
        rows = tables.written(dataset.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")))
        first = rows.first()
        if first is None:
            raise ValueError("no rows to train on")
        k = len(first["x"]) + 1
        theta, told = np.append(np.zeros(k - 1), rows.agg(F.avg("y")).first()[0]), []
        for _ in range(self.getOrDefault(self.passes)):
            now = theta

            def sums(x: np.ndarray, y: np.ndarray, now: np.ndarray = now) -> np.ndarray:
                x = np.column_stack([x, np.ones(len(x))])
                r = x @ now - y
                over, under = np.maximum(np.abs(r - epsilon), 1e-4), np.maximum(np.abs(-r - epsilon), 1e-4)
                weight = 0.5 / over + 0.5 / under
                aim = y - epsilon * (0.5 / under - 0.5 / over) / weight
                xw = x * weight[:, None]
                return np.concatenate([(xw.T @ x).ravel(), xw.T @ aim, [np.maximum(np.abs(r) - epsilon, 0).sum()]])

            found = summed(rows, sums, k * k + k + 1)
            told.append(float(0.5 * now[:-1] @ now[:-1] + c * found[-1]))
            ridge = np.diag(np.append(np.ones(k - 1), 1e-9))
            theta = np.linalg.solve(c * found[: k * k].reshape(k, k) + ridge, c * found[k * k : -1])
            if len(told) > 1 and told[-2] - told[-1] <= 1e-4 * abs(told[-2]):
                break
        tables.drop(rows)
        out = SupportVectorRegressionModel()
        out._set(coefficients=theta.tolist(), objectives=told, featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
        return out
