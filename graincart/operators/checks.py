"""Checks before training: class balance, overlap of splits, leaking features, and their acknowledgement."""

from __future__ import annotations

import json

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincart import tables
from graincart.operators.profile import correlation
from graincart.operators.running import running_sums

#: A class below this share, and a single feature above this score, are worth a warning.
SMALL_CLASS, LEAK = 0.1, 0.95
#: Classes that a single feature is held against.
MOST_CLASSES = 50


def class_balance(df: DataFrame, column: str) -> DataFrame:
    """(value, n, fraction) of the classes, with the smallest fraction and the ratio of largest to smallest."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))
    counts = counts.withColumn("total", F.sum("n").over(w)).withColumn("lo", F.min("n").over(w)).withColumn("hi", F.max("n").over(w))
    return counts.select("value", "n", (F.col("n") / F.col("total")).alias("fraction"), (F.col("lo") / F.col("total")).alias("min_fraction"), (F.col("hi") / F.col("lo")).alias("imbalance_ratio"))


def imbalance(df: DataFrame, column: str, least: float = SMALL_CLASS) -> DataFrame:
    return class_balance(df, column).agg(F.min("min_fraction").alias("min_fraction"), (F.min("min_fraction") < least).alias("warn"))


def row_key(columns: list[str]) -> Column:
    """One string for a row; nulls have a mark of their own."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])


def overlap(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """Training rows whose key is in the test rows, their number over that of the test rows, and whether any is."""
    keys = df.select(row_key(columns).alias("k"), (F.col(split) == "train").alias("train"))
    sides = keys.groupBy("k").agg(F.count_if("train").alias("a"), F.count_if(~F.col("train")).alias("b"))
    out = sides.agg(F.coalesce(F.sum(F.when(F.col("b") > 0, F.col("a"))), F.lit(0)).alias("count"), F.sum("b").alias("tests"))
    return out.select("count", F.try_divide("count", "tests").alias("fraction"), (F.col("count") > 0).alias("warn"))


def _labelled(df: DataFrame, feature: str, target: str, order: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """Rows (x, y, order) with both values, and the rows of each class, of at most one class more than may be."""
    rows = df.where(F.col(feature).isNotNull() & F.col(target).isNotNull()).select(F.col(feature).cast("double").alias("x"), F.col(target).cast("string").alias("y"), *order)
    return rows, {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).limit(MOST_CLASSES + 1).collect()}


def _by_value(rows: DataFrame, classes: list[str]) -> DataFrame:
    """A row for each x, with how many rows of class i are there (_at) and up to there (_left)."""
    counts = rows.groupBy("x").agg(*[F.count_if(F.col("y") == c).alias(f"_at{i}") for i, c in enumerate(classes)])
    return running_sums(counts, "x", {f"_left{i}": f"_at{i}" for i in range(len(classes))})


def _best(cuts: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The best accuracy if the rows left of a cut (_left) get one class and the others another."""
    left = F.array_max(F.array(*[F.col(f"_left{i}") for i in range(len(sizes))]))
    right = F.array_max(F.array(*[F.lit(n) - F.col(f"_left{i}") for i, n in enumerate(sizes.values())]))
    return cuts.agg((F.greatest(F.max(left + right), F.lit(max(sizes.values()))) / F.lit(sum(sizes.values()))).alias("score"))


def _unmeasured(df: DataFrame, sizes: dict[str, int]) -> DataFrame | None:
    return None if 0 < len(sizes) <= MOST_CLASSES else df.sparkSession.createDataFrame([(None,)], "score double")


def stump_accuracy(df: DataFrame, feature: str, target: str, order: list[str]) -> DataFrame:
    """The best accuracy of one threshold on ``feature``; a cut may fall between equal values, in the order of ``order``.

    Rows are counted by value, values are summed by ranges, and only rows of one value are ordered.
    The score is null without rows or above MOST_CLASSES classes.
    """
    rows, sizes = _labelled(df, feature, target, order)
    empty = _unmeasured(df, sizes)
    if empty is not None:
        return empty
    w = Window.partitionBy("x").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = [(F.col(f"_left{i}") - F.col(f"_at{i}") + F.count_if(F.col("y") == c).over(w)).alias(f"_left{i}") for i, c in enumerate(sizes)]
    return _best(rows.join(_by_value(rows, [*sizes]), "x").select(*inside), sizes)


def stump_accuracy_by_value(df: DataFrame, feature: str, target: str) -> DataFrame:
    """As ``stump_accuracy``, with cuts between different values only, so that no rows are ordered."""
    rows, sizes = _labelled(df, feature, target, [])
    empty = _unmeasured(df, sizes)
    return _best(_by_value(rows, [*sizes]), sizes) if empty is None else empty


def linear_leak(df: DataFrame, feature: str, target: str, least: float = LEAK) -> DataFrame:
    """The squared correlation of a feature with a numeric target, and whether it is too good."""
    r = correlation(F.col(feature), F.col(target))
    return df.agg((r * r).alias("score")).select("score", F.coalesce(F.col("score") >= least, F.lit(False)).alias("warn"))


def _in_vectors(df: DataFrame, terms: dict[str, list[tuple[str, str]]], y: Column) -> DataFrame:
    """(y, feature, column, x) of what is not 0 in vectors; ``terms`` gives the name and source of each place of a vector."""
    parts = []
    for c, told in terms.items():
        pairs = F.transform(vector_to_array(F.col(c)), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        some = df.select(y.alias("y"), F.explode(F.filter(pairs, lambda p: p["x"] != 0)).alias("p"))
        name = lambda at: F.element_at(F.lit([t[at] for t in told]), F.col("p.i") + 1)  # noqa: B023, E731
        parts.append(some.select("y", name(0).alias("feature"), name(1).alias("column"), F.col("p.x").alias("x")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def leaks(df: DataFrame, features: dict[str, tuple[str, Column]], target: str, task: str, least: float = LEAK, terms: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """(feature, column, metric, score, warn): how well each feature tells the target on its own.

    ``features`` gives for each name the column it comes from and its number. A class is told by
    the best single threshold (``stump_accuracy``), a number by the squared correlation
    (``r_squared``, 0 if either side does not vary). All features are measured in one pass: rows are
    summed by feature and value, and the sums run within each feature. Rows without target, or
    without the feature, do not count; a feature without any rows has no score. Above MOST_CLASSES
    classes nothing is measured. ``terms`` gives vector columns with name and source of each of
    their places; only what is not 0 in them is read, and the zeros follow from the counts.
    """
    known = df.where(F.col(target).isNotNull())
    if task == "regression":
        y = F.col(target).cast("double")
        told = known.agg(*[F.struct(F.lit(n).alias("feature"), F.lit(c).alias("column"), correlation(x, y).alias("r"), F.count(x).alias("n")).alias(f"s{i}") for i, (n, (c, x)) in enumerate(features.items())])
        rows = told.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(features))])).alias("s")).select("s.*")
        score = F.when(F.col("n") > 0, F.coalesce(F.nanvl(F.col("r") * F.col("r"), F.lit(0.0)), F.lit(0.0)))
        rows = rows.select("feature", "column", F.lit("r_squared").alias("metric"), score.alias("score"))
        if terms:
            whole = known.agg(F.count(y).alias("m"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"))
            x = F.col("x")
            sums = _in_vectors(known, terms, y).groupBy("feature", "column").agg(F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(x * F.col("y")).alias("sxy"))
            # one row
            sums = sums.crossJoin(F.broadcast(whole))
            both = F.expr("m * sxy - sx * sy")
            r2 = F.coalesce(F.try_divide(both * both, F.expr("(m * sxx - sx * sx) * (m * syy - sy * sy)")), F.lit(0.0))
            rows = rows.union(sums.select("feature", "column", F.lit("r_squared").alias("metric"), F.least(r2, F.lit(1.0)).alias("score")))
    else:
        classes = [r[0] for r in known.select(F.col(target).cast("string")).distinct().limit(MOST_CLASSES + 1).collect()]
        each = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(c).alias("column"), x.cast("double").alias("x")) for n, (c, x) in features.items()])
        if len(classes) > MOST_CLASSES:
            known, classes = known.limit(0), classes[:1]
        of = known.select(F.col(target).cast("string").alias("y"), F.explode(each).alias("f")).select("y", "f.*").where("x is not null")
        at = [F.count_if(F.col("y") == c).alias(f"at{i}") for i, c in enumerate(classes)] + [F.count_if(F.lit(False)).alias("none")]
        counts = of.groupBy("feature", "column", "x").agg(*at)
        if terms and classes:
            there = tables.written(_in_vectors(known, terms, F.col(target).cast("string")).groupBy("feature", "column", "x").agg(*at))
            # one row of the classes' sizes
            whole = known.select(F.col(target).cast("string").alias("y")).agg(*[c.alias(f"all{i}") for i, c in enumerate(at[:-1])])
            zeros = there.groupBy("feature", "column").agg(*[F.sum(f"at{i}").alias(f"some{i}") for i in range(len(classes))]).crossJoin(F.broadcast(whole))
            zeros = zeros.select("feature", "column", F.lit(0.0).alias("x"), *[(F.col(f"all{i}") - F.col(f"some{i}")).alias(f"at{i}") for i in range(len(classes))], F.lit(0).cast("long").alias("none"))
            counts = counts.union(there).union(zeros)
        sums = {f"left{i}": f"at{i}" for i in range(len(classes))} or {"left": "none"}
        run = running_sums(counts, "x", sums, by=("feature", "column"), totals=True)
        most = lambda values: F.greatest(*values) if len(values) > 1 else values[0]
        left, right, whole = most([F.col(n) for n in sums]), most([F.col(f"total_{n}") - F.col(n) for n in sums]), [F.col(f"total_{n}") for n in sums]
        best = F.greatest(F.max(left + right), F.max(most(whole))) / F.max(sum(whole[1:], whole[0]))
        rows = run.groupBy("feature", "column").agg(F.lit("stump_accuracy").alias("metric"), best.alias("score"))
    return rows.withColumn("warn", F.coalesce(F.col("score") >= least, F.lit(False)))


def finding(kind: str, subject: str, raised: bool, severity: str, message: str, details: dict) -> tuple:
    """A row of ``FINDINGS``; what is not raised has neither severity nor message."""
    return kind, subject, raised, severity if raised else None, message if raised else "", json.dumps(details, sort_keys=True, default=str)


FINDINGS = "kind string, subject string, raised boolean, severity string, message string, details string"


def with_acknowledgement(checks: DataFrame, acks: DataFrame) -> DataFrame:
    """Checks with the note of their acknowledgement, if there is one."""
    return checks.join(acks.select("check_id", "note"), "check_id", "left").withColumn("acknowledged", F.col("note").isNotNull())


def open_warnings(checks: DataFrame, acks: DataFrame) -> DataFrame:
    return checks.where(F.col("severity") == "warning").join(acks, "check_id", "left_anti")


def register_once(checks: DataFrame, new: DataFrame) -> DataFrame:
    """``checks`` and those of ``new`` whose (kind, subject) is not there yet."""
    return checks.unionByName(new.join(checks, ["kind", "subject"], "left_anti").select(*checks.columns))
