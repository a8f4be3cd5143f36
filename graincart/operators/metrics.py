"""Evaluation of predictions: confusion, scores, curves, residuals, ranks and groups.

A table of predictions has a truth, a prediction, and for curves a score. Curves are built from
sums by distinct score, so that what is ordered grows with the scores and not with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincart.operators.quantiles import quantiles
from graincart.operators.running import running_sums


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, pred, n, share of the truth, support) over the full grid of labels."""
    pairs = df.groupBy(F.col(truth).cast("string").alias("truth"), F.col(pred).cast("string").alias("pred")).agg(F.count("*").alias("n"))
    labels = pairs.select(F.explode(F.array("truth", "pred")).alias("label")).distinct()
    # labels are few by definition: a grid of classes
    grid = labels.select(F.col("label").alias("truth")).crossJoin(F.broadcast(labels.select(F.col("label").alias("pred"))))
    full = grid.join(pairs, ["truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    support = F.sum("n").over(Window.partitionBy("truth"))
    return full.select("truth", "pred", "n", support.alias("support"), F.coalesce(F.try_divide("n", support), F.lit(0.0)).alias("share"))


def class_scores(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(label, support, precision, recall, f1) of labels seen in truth or prediction; division by zero gives 0."""
    t, p = F.col(truth).cast("string"), F.col(pred).cast("string")
    sides = df.select(F.explode(F.array(F.struct(t.alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (t == p).cast("int").alias("hit")), F.struct(p.alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("r")).select("r.*")
    sums = sides.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("hits"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select("label", "support", zero(F.col("hits"), F.col("predicted")).alias("precision"), zero(F.col("hits"), F.col("support")).alias("recall"), zero(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"), "hits")


def classification(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """accuracy, balanced accuracy (over labels in truth), macro and weighted averages, f1 of the smallest class."""
    s = class_scores(df, truth, pred)
    seen = F.col("support") > 0
    return s.agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.min_by("f1", F.when(seen, F.struct("support", "label"))).alias("f1_minority"),
        F.sum("support").alias("support"),
    )


def regression(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: errors, their median, explained variance, determination and mean residual (truth less prediction)."""
    y, r = F.col(truth).cast("double"), F.col(truth).cast("double") - F.col(pred).cast("double")
    middle = quantiles(df, {"r": F.abs(r)}, [0.5]).select(F.get("values", F.lit(0)).alias("median_ae"))
    out = df.agg(
        F.avg(F.abs(r)).alias("mae"),
        F.sqrt(F.avg(r * r)).alias("rmse"),
        (1 - F.var_pop(r) / F.var_pop(y)).alias("explained_variance"),
        F.max(F.abs(r)).alias("max_error"),
        (1 - F.avg(r * r) / F.var_pop(y)).alias("r2"),
        F.avg(r).alias("residual_mean"),
    )
    # one row each
    return out.join(F.broadcast(middle), F.lit(True), "left").select("mae", "rmse", "median_ae", "explained_variance", "max_error", "r2", "residual_mean")


def residuals(df: DataFrame, truth: str, pred: Column) -> DataFrame:
    """``df`` with ``residual``, truth less prediction; null where either is missing."""
    return df.withColumn("residual", F.col(truth).cast("double") - pred.cast("double"))


def residual_facts(df: DataFrame, truth: str, pred: Column) -> DataFrame:
    """One row: n, mean, deviation and mean size of the residuals, and their least and largest."""
    r = F.col("residual")
    return residuals(df, truth, pred).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.avg(F.abs(r)).alias("mae"), F.min(r).alias("least"), F.max(r).alias("largest"))


def _cumulated(df: DataFrame, truth: Column, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each score of a group, from high to low: positives and others there (p, q), up to there (tp, fp) and in all (np, nq)."""
    each = df.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(truth).alias("p"), F.count_if(~truth).alias("q"))
    run = running_sums(each, "score", {"tp": "p", "fp": "q"}, descending=True, by=by, totals=True)
    return run.withColumnsRenamed({"total_tp": "np", "total_fp": "nq"})


def _and_ends(points: DataFrame, groups: DataFrame, by: tuple[str, ...], names: tuple[str, str], ends: list[tuple[float, float]]) -> DataFrame:
    """``points`` and the fixed ends of each group's curve; of a single curve always."""
    add = F.explode(F.array(*[F.struct(F.lit(x).alias(names[0]), F.lit(y).alias(names[1])) for x, y in ends])).alias("e")
    of = groups.select(*by).distinct() if by else points.sparkSession.range(1)
    return points.union(of.select(*by, add).select(*by, *[f"e.{n}" for n in names]))


def roc_points(df: DataFrame, truth: Column, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, fpr, tpr) for each distinct score from high to low, from (0, 0) to (1, 1)."""
    c = _cumulated(df, truth, score, by)
    points = c.where("np > 0 and nq > 0").select(*by, (F.col("fp") / F.col("nq")).alias("fpr"), (F.col("tp") / F.col("np")).alias("tpr"))
    return _and_ends(points, c, by, ("fpr", "tpr"), [(0.0, 0.0), (1.0, 1.0)]).distinct()


def _area(by_score: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The area under the ROC curve by trapezoids, null if one class is missing, and average precision, null without positives."""
    area = F.sum(F.col("q") * (2 * F.col("tp") - F.col("p"))) / (2.0 * F.nullif(F.max("np") * F.max("nq"), F.lit(0)))
    precise = F.sum(F.when(F.col("np") > 0, F.col("p") / F.col("np") * (F.col("tp") / (F.col("tp") + F.col("fp")))))
    return by_score.groupBy(*by).agg(area.alias("auc"), precise.alias("average_precision"), F.max("np").alias("positives"), F.max("nq").alias("others"))


def roc_auc(df: DataFrame, truth: Column, score: str) -> DataFrame:
    """One row: the area by trapezoids, null if one class is missing."""
    return _area(_cumulated(df, truth, score), ()).select("auc")


def pr_points(df: DataFrame, truth: Column, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, recall, precision) for each distinct score, and the end (1, 0)."""
    c = _cumulated(df, truth, score, by)
    points = c.where("np > 0").select(*by, (F.col("tp") / F.col("np")).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    return _and_ends(points, c, by, ("recall", "precision"), [(1.0, 0.0)])


def average_precision(df: DataFrame, truth: Column, score: str) -> DataFrame:
    return _area(_cumulated(df, truth, score), ()).select("average_precision")


def against_rest(df: DataFrame, truth: str, scores: dict[str, Column]) -> DataFrame:
    """(class, truth, score): each row once for each class of ``scores`` (class: its score), truth saying whether the row is of it."""
    each = F.array(*[F.struct(F.lit(c).alias("class"), F.coalesce(F.col(truth).cast("string") == c, F.lit(False)).alias("truth"), s.cast("double").alias("score")) for c, s in scores.items()])
    return df.select(F.explode(each).alias("r")).select("r.*").where("score is not null")


def one_vs_rest(df: DataFrame, truth: str, scores: dict[str, Column]) -> DataFrame:
    """(class, auc, average_precision, positives, others) of each class against all others, from one pass over the rows.

    Rows are summed by class and score before anything is ordered. A class that no row has, or all
    rows have, has no auc. Rows whose truth is null are of no class.
    """
    return _area(_cumulated(against_rest(df, truth, scores), F.col("truth"), "score", ("class",)), ("class",))


def macro(each: DataFrame) -> DataFrame:
    """One row: the means of auc and average_precision over the classes of ``one_vs_rest``, null if a class has none."""
    mean = lambda c: F.when(F.count(c) == F.count("*"), F.avg(c)).alias(f"{c}_macro")
    return each.agg(F.count("*").alias("classes"), mean("auc"), mean("average_precision"))


def leaderboard(df: DataFrame, metric: str, higher_is_better: bool = True) -> DataFrame:
    """Competition ranks (1, 1, 3) of measured models; then those without the metric, then those that failed."""
    measured = (F.col("status") == "ok") & F.col(metric).isNotNull()
    place = F.rank().over(Window.partitionBy(measured).orderBy(F.desc(metric) if higher_is_better else F.asc(metric)))
    group = F.when(measured, 0).when(F.col("status") == "ok", 1).otherwise(2)
    return df.withColumn("rank", F.when(measured, place).cast("long")).withColumn("standing", group)


def group_classification(df: DataFrame, group: str, truth: Column, pred: Column) -> DataFrame:
    """Size, accuracy, selection rate and the rates of true and false positives of each group; undefined ones are null."""
    rate = lambda a, b: F.try_divide(F.count_if(a), F.count_if(b))
    return df.groupBy(F.col(group).alias("group")).agg(
        F.count("*").alias("n"),
        F.count_if(truth).alias("positives"),
        (F.count_if(truth == pred) / F.count("*")).alias("accuracy"),
        (F.count_if(pred) / F.count("*")).alias("selection_rate"),
        rate(truth & pred, truth).alias("tpr"),
        rate(~truth & pred, ~truth).alias("fpr"),
    )


def group_regression(df: DataFrame, group: str, truth: str, pred: str) -> DataFrame:
    r = F.col(pred).cast("double") - F.col(truth).cast("double")
    return df.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"), F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(r).alias("mean_error"))


def group_report(df: DataFrame, group: str, scores: DataFrame, least: int = 1) -> DataFrame:
    """``scores`` (group, n, metrics) of every group of the whole table, with its ``rows`` and the ``reason`` why it has none.

    Groups of fewer than ``least`` held-out rows are not measured.
    """
    everyone = df.groupBy(F.col(group).alias("_of")).agg(F.count("*").alias("rows"))
    out = everyone.join(scores, F.col("_of").eqNullSafe(F.col("group")), "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    reason = F.when(n == 0, "no held-out rows").when(n < least, f"fewer than {least} held-out rows")
    told = [F.when(reason.isNull(), F.col(c)).alias(c) for c in scores.columns if c not in ("group", "n")]
    return out.select(F.col("_of").alias("group"), "rows", n.alias("n"), reason.alias("reason"), *told)


def gaps(groups: DataFrame, metrics: list[str], threshold: float = 0.1) -> DataFrame:
    """(metric, gap, lowest, highest, exceeds): the range of each metric over the groups that have it, names break ties."""
    rows = groups.select("group", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("r")).select("group", "r.*").where("value is not null")
    out = rows.groupBy("metric").agg(
        F.count("*").alias("measured"),
        (F.max("value") - F.min("value")).alias("gap"),
        F.min_by("group", F.struct("value", "group")).alias("lowest"),
        F.min_by("group", F.struct(-F.col("value"), "group")).alias("highest"),
    )
    gap = F.when(F.col("measured") > 1, F.col("gap"))
    return out.select("metric", gap.alias("gap"), "lowest", "highest", F.coalesce(gap > threshold, F.lit(False)).alias("exceeds"))


def widest_first(found: DataFrame) -> DataFrame:
    """``gaps`` with ``place``: the widest first, those that tie by name, and unmeasured ones last. A row for each metric."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("gap"), "metric")
    return found.withColumn("place", F.row_number().over(order).cast("long"))


def rankable(board: DataFrame, names: list[str]) -> DataFrame:
    """(metric, n): the metrics that any model has, and how many models have them."""
    counts = board.agg(*[F.count(c).alias(c) for c in names])
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("n")) for c in names])
    return counts.select(F.explode(rows).alias("r")).select("r.*").where("n > 0")
