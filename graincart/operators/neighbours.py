"""Exact nearest neighbours with pivots and the triangle inequality.

Training rows go to the nearest of some pivots, and each keeps its distance from it. A query looks
first into the cells that are nearest and hold enough rows, which bounds the distance of its k-th
neighbour; then only into cells, and within them at rows, whose distances from the pivot do not
exclude them. Equal rows of equal content are one with a count. Cells follow the size of the table;
several of them make a group of a bounded number of rows, and a cell with many rows is split over
groups. A task meets one group with one block of queries, cell by cell: products of matrices tell which
pairs may be near, and only of those the distance is summed exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graincart import tables

#: Rows of a cell on average, those of a group (beyond them a cell is split), and queries of a block; pivots at most.
CELL_ROWS, SPLIT_ROWS, BLOCK_ROWS, MOST_PIVOTS = 1000, 20_000, 4096, 1024
#: What rounding may take from a distance, relative to it.
SLACK = 1e-9
#: Numbers that a task holds of a table of pairs at once.
AT_ONCE = 2_000_000


@dataclass(frozen=True)
class Index:
    """``rows`` (group, at, content, v, n, cell): a row for each vector and content; ``at`` is its place in its group by content.

    For each pivot: the distances of the nearest and the farthest row of its cell, how many rows it
    counts, and the groups that have them.
    """

    rows: DataFrame
    pivots: np.ndarray
    near: np.ndarray
    far: np.ndarray
    counts: np.ndarray
    groups: list[range]


def _gaps(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows from pivots, without the squares' cancellation."""
    return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in pivots], axis=1)) if len(x) else np.zeros((0, len(pivots)))


@dataclass(frozen=True)
class Search:
    """What is looked for: ``k`` rows of ``index`` for each query, of ``blocks`` blocks, and the field by which a row is a query's own."""

    index: Index
    k: int
    blocks: int
    but: str | None


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of rows of ``x`` from rows of ``y`` by a product of matrices, and how far off those of a row of ``x`` may be."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    off = 4 * (x.shape[1] + 8) * np.finfo(float).eps * (xx + yy.max(initial=0))
    return xx[:, None] + yy[None, :] - 2 * (x @ y.T), off


def _groups(sizes: np.ndarray) -> list[range]:
    """The groups of each cell: those of one after another share one of SPLIT_ROWS rows, a larger cell has some of its own."""
    out, last, held = [], -1, SPLIT_ROWS
    for rows in sizes.tolist():
        parts = -(-rows // SPLIT_ROWS)
        if parts > 1:
            out.append(range(last + 1, last + 1 + parts))
            last, held = last + parts, SPLIT_ROWS
            continue
        if held + rows > SPLIT_ROWS:
            last, held = last + 1, 0
        out.append(range(last, last + 1))
        held += rows
    return out


def build(train: DataFrame, content: list[str], vector: str) -> Index:
    """An index of the rows of ``train``; ``content`` names what a neighbour is told by."""
    each = train.select(F.struct(*content).alias("content"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    each = tables.written(each.groupBy("content", "v").agg(F.count("*").alias("n")))
    wanted = min(max(each.count() // CELL_ROWS, 1), MOST_PIVOTS)
    pivots = np.array([r["v"] for r in each.select("v").orderBy(F.xxhash64("v"), "v").limit(2 * wanted).distinct().collect()], float)
    pivots = pivots[np.lexsort(pivots.T)][:: max(len(pivots) // wanted, 1)][:MOST_PIVOTS] if len(pivots) else np.zeros((1, 0))

    def place(v: pd.Series) -> pd.DataFrame:
        cell, far = np.zeros(len(v), np.int32), np.zeros(len(v))
        step = max(AT_ONCE // len(pivots), 1)
        for i in range(0, len(v), step):
            x = np.stack(v.iloc[i : i + step].to_numpy())
            near = _squares(x, pivots)[0].argmin(axis=1)
            cell[i : i + step], far[i : i + step] = near, np.sqrt(((x - pivots[near]) ** 2).sum(axis=1))
        return pd.DataFrame({"cell": cell, "far": far})

    placed = each.withColumn("_p", F.pandas_udf(place, "cell int, far double")("v")).select("content", "v", "n", "_p.*")
    placed = tables.written(placed)
    tables.drop(each)
    m = len(pivots)
    near, far, counts, sizes = np.full(m, np.inf), np.full(m, -np.inf), np.zeros(m, np.int64), np.zeros(m, np.int64)
    # a row for each pivot
    for r in placed.groupBy("cell").agg(F.min("far").alias("near"), F.max("far").alias("far"), F.sum("n").alias("n"), F.count("*").alias("rows")).collect():
        near[r["cell"]], far[r["cell"]], counts[r["cell"]], sizes[r["cell"]] = r["near"], r["far"], r["n"], r["rows"]
    groups = _groups(sizes)
    of = lambda numbers: F.element_at(F.lit(numbers), F.col("cell") + 1)
    group = of([g.start for g in groups]) + F.pmod(F.xxhash64("content", "v"), F.greatest(of([len(g) for g in groups]), F.lit(1)))
    rows = placed.withColumn("group", group.cast("int"))
    at = F.row_number().over(Window.partitionBy("group").orderBy("content")).alias("at")
    rows = tables.written(rows.select("group", at, "content", "v", "n", "cell"))
    tables.drop(placed)
    return Index(rows, pivots, near, far, counts, groups)


def _cut(found: list[np.ndarray], rows: int) -> list[np.ndarray]:
    """Of each query the first ``rows`` of ``found`` (query, distance, at, own) that are not its own, and its own before the last of them."""
    who, distance, at, own = found
    order = np.lexsort((at, distance, who))
    who, distance, at, own = who[order], distance[order], at[order], own[order]
    taken = np.cumsum(~own)
    begins = np.searchsorted(who, who)
    before = taken - ~own - (taken - ~own)[begins]
    kept = before < rows
    return [who[kept], distance[kept], at[kept], own[kept]]


def _near(q: np.ndarray, bound: np.ndarray, own: np.ndarray, x: np.ndarray, at: np.ndarray, names: np.ndarray, k: int, spare: int) -> list[np.ndarray]:
    """(query, distance, at, own) of the ``k`` nearest rows of ``x`` within each query's bound; ``spare`` rows at most are a query's own."""
    out = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)]
    most = k + spare
    step = max(AT_ONCE // max(len(x), 1), 1)
    for i in range(0, len(q), step):
        b = bound[i : i + step]
        squares, off = _squares(q[i : i + step], x)
        off = 2 * off
        limit = b * b + off
        if len(x) > most and np.count_nonzero(squares <= limit[:, None]) > 8 * most * len(b):
            limit = np.minimum(limit, np.partition(squares, most - 1, axis=1)[:, most - 1] + off)
        who, which = np.nonzero(squares <= limit[:, None])
        found = [out]
        pairs = max(AT_ONCE // max(x.shape[1], 1), 1)
        for j in range(0, len(who), pairs):
            w, c = who[j : j + pairs], which[j : j + pairs]
            gap = np.ascontiguousarray((x[c] - q[i + w]).T)
            # along the first axis numpy adds one after another, as Spark's and SQL's sums do
            distance = np.sqrt(np.add.reduce(gap * gap, axis=0)) if len(gap) else np.zeros(len(w))
            in_reach = distance <= b[w]
            w, c, distance = w[in_reach], c[in_reach], distance[in_reach]
            found.append(_cut([i + w, distance, at[c], own[i + w] == names[c]], k))
        out = [np.concatenate(parts) for parts in zip(*found, strict=True)]
    return _cut(out, k)


def _met(search: Search, asked: DataFrame) -> DataFrame:
    """(_q, content, n, distance): of each group the nearest rows of the cells where a query (_q, query, v, bound, c) looks, within its bound."""
    index, k, blocks, but = search.index, search.k, search.blocks, search.but
    name = F.xxhash64(F.col("content")[but].cast("string")) if but else F.lit(0).cast("long")
    kind = index.rows.select(F.col("content")[but].alias("x")).schema["x"].dataType if but else None
    own = F.xxhash64(F.col("query").cast(kind).cast("string")) if but else F.lit(1).cast("long")

    def meet(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = [[np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)]]
        if len(rows) and len(asked):
            rows = rows.sort_values(["cell", "at"])
            x, at, names, cell = np.stack(rows["v"].to_numpy()), rows["at"].to_numpy(np.int64), rows["name"].to_numpy(np.int64), rows["cell"].to_numpy()
            q, bound, owns = np.stack(asked["v"].to_numpy()), asked["bound"].to_numpy(float), asked["own"].to_numpy(np.int64)
            spare = int(np.unique(names, return_counts=True)[1].max()) if but else 0
            here, starts = np.unique(cell, return_index=True)
            looks = np.zeros((len(q), len(here)), bool)
            lists = [np.asarray(c) for c in asked["cells"]]
            places = np.concatenate(lists)
            by = np.repeat(np.arange(len(lists)), [len(c) for c in lists])
            spot = np.minimum(np.searchsorted(here, places), len(here) - 1)
            met = here[spot] == places
            looks[by[met], spot[met]] = True
            for j, (a, b) in enumerate(zip(starts, [*starts[1:], len(cell)], strict=True)):
                who = np.flatnonzero(looks[:, j])
                if len(who):
                    w, *rest = _near(q[who], bound[who], owns[who], x[a:b], at[a:b], names[a:b], k, spare)
                    found.append([who[w], *rest])
        who, distance, at, _ = _cut([np.concatenate(parts) for parts in zip(*found, strict=True)], k)
        told = asked["_q"].to_numpy(np.int64)[who] if len(who) else who
        group = rows["group"].iloc[0] if len(rows) else 0
        return pd.DataFrame({"_q": told, "group": np.full(len(who), group, np.int32), "at": at.astype(np.int32), "distance": distance})

    block = F.pmod(F.xxhash64("_q"), F.lit(blocks)).cast("int").alias("block")
    asks = asked.select("_q", "v", "bound", own.alias("own"), "c.group", "c.cells", block)
    rows = index.rows.select("group", "at", "v", "cell", name.alias("name"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    keys = ["group", "block"]
    near = rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(meet, "_q long, group int, at int, distance double")
    return near.join(index.rows.select("group", "at", "content", "n"), ["group", "at"]).select("_q", "content", "n", "distance")


def _first(pairs: DataFrame, k: int, order: list) -> DataFrame:
    """Of each query the first rows until they count k."""
    before = Window.partitionBy("query").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = pairs.withColumn("_place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("_place") <= k)
    return ranked.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("_before") < k)


def nearest(index: Index, queries: DataFrame, k: int, but: str | None = None) -> DataFrame:
    """(query, content, n, distance): the ``k`` nearest rows of each of ``queries`` (query, v), n of a content at a distance.

    Ties go by the content. With ``but`` a row whose content has the query's own name under that
    field is none of its neighbours. A query of another length than the rows, or without vector, has
    none.
    """
    size = index.pivots.shape[1]
    asked = queries.select("query", F.col("v").cast("array<double>").alias("v")).where((F.size("v") == size) & F.forall("v", lambda x: x.isNotNull()))
    asked = tables.written(asked.withColumn("_q", F.monotonically_increasing_id()))
    blocks = max(-(-asked.count() // BLOCK_ROWS), 1)
    need = k + (1 if but else 0)
    pivots, low, high, counts, groups = index.pivots, index.near, index.far, index.counts, index.groups

    def home(gaps: np.ndarray) -> list[int]:
        order = [int(c) for c in np.argsort(gaps, kind="stable") if counts[c]]
        enough = np.searchsorted(np.cumsum(counts[order]), need) + 1
        return order[:enough]

    def away(gaps: np.ndarray, bound: float) -> list[int]:
        may = (gaps - high <= bound) & (low - gaps <= bound) & (counts > 0)
        may[home(gaps)] = False
        return np.flatnonzero(may).tolist()

    def by_group(cells: list[int]) -> list[dict]:
        out: dict[int, list[int]] = {}
        for c in cells:
            for g in groups[c]:
                out.setdefault(g, []).append(c)
        return [{"group": g, "cells": found} for g, found in out.items()]

    def ask(v: pd.Series) -> pd.Series:
        return pd.Series([by_group(home(row)) for row in (_gaps(np.stack(v.to_numpy()), pivots) if len(v) else ())], dtype=object)

    def ask_more(v: pd.Series, bound: pd.Series) -> pd.Series:
        return pd.Series([by_group(away(row, b)) for row, b in zip(_gaps(np.stack(v.to_numpy()), pivots) if len(v) else (), bound, strict=True)], dtype=object)

    kind = "array<struct<group:int,cells:array<int>>>"
    names = asked.select("_q", "query")
    search = Search(index, k, blocks, but)

    def met(asks: DataFrame) -> DataFrame:
        found = _met(search, asks).join(names, "_q").select("query", "content", "n", "distance")
        return found.where(~F.col("query").eqNullSafe(F.col("content")[but])) if but else found

    order = ["distance", "content"]
    at_home = asked.select("_q", "query", "v", F.lit(float("inf")).alias("bound"), F.explode(F.pandas_udf(ask, kind)("v")).alias("c"))
    first = tables.written(_first(met(at_home), k, order).drop("_place", "_before"))
    # fewer than k are told at home only if there are no more; then every cell was home
    known = first.groupBy("query").agg(F.max("distance").alias("_worst"), F.sum("n").alias("_n"))
    bound = F.when(F.col("_n") >= k, F.col("_worst") * (1 + SLACK)).otherwise(F.lit(float("inf")))
    more = asked.join(known, "query", "left").withColumn("bound", F.coalesce(bound, F.lit(float("inf"))))
    more = more.select("_q", "query", "v", "bound", F.explode(F.pandas_udf(ask_more, kind)("v", "bound")).alias("c"))
    found = first.union(met(more).select(*first.columns))
    out = _first(found, k, order)
    return out.select("query", "content", F.least("n", F.lit(k) - F.col("_before")).alias("n"), "distance")


class NeighboursModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """The votes, or the mean, of the nearest training rows; these stay in a written table."""

    k = Param(Params._dummy(), "k", "number of neighbours", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for a number", TypeConverters.toInt)
    path = Param(Params._dummy(), "path", "where the training rows are", TypeConverters.toString)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark, k, classes = dataset.sparkSession, self.getOrDefault(self.k), self.getOrDefault(self.classes)
        index = build(spark.read.parquet(self.getOrDefault(self.path)), ["label"], "v")
        # written, as the numbers of rows must be the same whenever they are read
        rows = tables.written(dataset.withColumn("_row", F.monotonically_increasing_id()))
        asked = rows.select(F.col("_row").alias("query"), vector_to_array(F.col(self.getFeaturesCol())).alias("v"))
        found = nearest(index, asked, k).select("query", F.col("content.label").alias("label"), "n")
        if classes:
            votes = [F.coalesce(F.sum(F.when(F.col("label") == c, F.col("n"))), F.lit(0)).cast("double") for c in range(classes)]
            told = found.groupBy("query").agg(F.array(*votes).alias("_votes"), F.sum("n").alias("_n"))
            shares = F.transform("_votes", lambda v: v / F.col("_n"))
            # of classes with equal votes the first
            told = told.select(F.col("query").alias("_row"), array_to_vector(shares).alias("probability"), (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double").alias(self.getPredictionCol()))
        else:
            told = found.groupBy("query").agg((F.sum(F.col("label") * F.col("n")) / F.sum("n")).alias(self.getPredictionCol())).withColumnRenamed("query", "_row")
        return rows.join(told, "_row", "left").drop("_row")


class Neighbours(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    k = Param(Params._dummy(), "k", "number of neighbours", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for a number", TypeConverters.toInt)

    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", classes: int = 0, k: int = 5) -> None:
        super().__init__()
        if k < 1:
            raise ValueError(f"k must be 1 or more, not {k}")
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, classes=classes, k=k)

    def _fit(self, dataset: DataFrame) -> NeighboursModel:
        rows = dataset.select(F.col(self.getLabelCol()).cast("double").alias("label"), vector_to_array(F.col(self.getFeaturesCol())).alias("v"))
        kept = tables.written(rows)
        out = NeighboursModel()
        out._set(k=self.getOrDefault(self.k), classes=self.getOrDefault(self.classes), path=tables.path_of(kept), featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
        return out
