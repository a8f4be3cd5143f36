"""Column profiles. Every statistic of a table comes from one aggregation where that is possible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincart.operators.quantiles import quantiles

#: Rows of whose values a task holds the distinct ones.
EACH = 200_000
QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def _long_form(df: DataFrame, one: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}.{n}`").alias(n) for n in names]) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """missing rate, min, max, mean, sample deviation (0 for a single value) and exact quantiles of each column."""
    aggs: list[Column] = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [
            F.avg(x.isNull().cast("double")).alias(f"{c}.missing_rate"),
            F.min(x).alias(f"{c}.min"),
            F.max(x).alias(f"{c}.max"),
            F.avg(x).alias(f"{c}.mean"),
            F.when(F.count(x) > 1, F.stddev_samp(x)).when(F.count(x) == 1, 0.0).alias(f"{c}.std"),
        ]
    out = _long_form(df, df.agg(*aggs), columns, ["missing_rate", "min", "max", "mean", "std"])
    # a row for each column
    out = out.join(F.broadcast(quantiles(df, {c: F.col(c) for c in columns}, QUANTILES)), "column", "left")
    cuts = [F.get("values", F.lit(i)).alias(f"q{round(q * 100)}") for i, q in enumerate(QUANTILES)]
    return out.select("column", "missing_rate", "min", "max", "mean", "std", *cuts)


def text_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """missing rate, mean length and number of distinct values of each column."""
    aggs = []
    for c in columns:
        aggs += [
            F.avg(F.col(c).isNull().cast("double")).alias(f"{c}.missing_rate"),
            F.avg(F.length(c)).alias(f"{c}.mean_length"),
            F.count_distinct(c).alias(f"{c}.cardinality"),
        ]
    return _long_form(df, df.agg(*aggs), columns, ["missing_rate", "mean_length", "cardinality"])


def first_distinct(df: DataFrame, column: str, order: list[str], k: int = 3, width: int = 120) -> DataFrame:
    """The first ``k`` distinct values in the order of ``order`` (a unique key), cut to ``width`` characters."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("_at"))
    top = firsts.orderBy("_at").limit(k)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_at"))
    return top.select(place.cast("long").alias("place"), F.substring(column, 1, width).alias("example"))


def datetime_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    aggs = [a for c in columns for a in (show(F.min(c)).alias(f"{c}.min"), show(F.max(c)).alias(f"{c}.max"))]
    return _long_form(df, df.agg(*aggs), columns, ["min", "max"])


def frequencies(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation over the rows in which both are there; null if one of them does not vary."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of all pairs, over the rows in which both are there; undefined pairs are left out."""
    pairs = [(a, b) for a in columns for b in columns]
    distinct = {tuple(sorted(p)) for p in pairs}
    one = df.agg(*[correlation(F.col(a), F.col(b)).alias(f"{a}.{b}") for a, b in sorted(distinct)])
    cell = lambda a, b: F.col(f"`{'.'.join(sorted((a, b)))}`")
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), cell(a, b).alias("corr")) for a, b in pairs])
    return one.select(F.explode(rows).alias("r")).select("r.*").where(F.col("corr").isNotNull() & ~F.isnan("corr"))


def histogram(df: DataFrame, column: str, side: str, bins: int = 20) -> DataFrame:
    """(side, bin, n): counts in ``bins`` bins whose edges all values share; the last bin is closed."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).withColumn("hi", F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")))
    at = F.least(F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    # one row of two numbers: the broadcast has a fixed size
    return df.where(x.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.col(side).alias("side"), at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def top_and_other(df: DataFrame, column: str, k: int = 12) -> DataFrame:
    """The ``k`` most frequent values with their shares, and the others as one."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(k).withColumn("top", F.lit(True))
    marked = counts.join(F.broadcast(top.select("value", "top")), "value", "left")
    named = marked.groupBy(F.when(F.col("top"), F.col("value")).otherwise("other").alias("value")).agg(F.sum("n").alias("n"))
    return named.select("value", "n", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"))


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows beyond the first of their kind, and their share."""
    kinds = df.groupBy(*columns).agg(F.count("*").alias("c"))
    return kinds.agg(F.sum(F.col("c") - 1).alias("duplicates"), (F.sum(F.col("c") - 1) / F.sum("c")).alias("fraction"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distinct_values): exact numbers of distinct values that are not null, without a task that holds many of them.

    Rows are dealt out over parts of EACH rows, in each of which copies go, and then by value; nothing is
    kept for a row but its value.
    """
    parts = df.count() // EACH + 1
    found = []
    for c in columns:
        x = F.col(f"`{c}`")
        values = df.select(x.alias("x")).where("x is not null")
        if parts > 1:
            values = values.withColumn("_at", F.pmod(F.monotonically_increasing_id(), F.lit(parts))).repartition(parts, "_at").groupBy("_at", "x").agg(F.lit(0)).select("x").repartition(parts, "x")
        found.append(values.distinct().agg(F.count("*").alias("distinct_values")).select(F.lit(c).alias("column"), "distinct_values"))
    return reduce(DataFrame.union, found)


def kind_facts(df: DataFrame, columns: list[str]) -> DataFrame:
    """What kinds are told by: counts, distinct values, mean length, and how many values are numbers or whole."""
    aggs = []
    for c in columns:
        text = F.col(f"`{c}`").cast("string")
        number = F.try_cast(text, "double") if hasattr(F, "try_cast") else text.try_cast("double")
        aggs += [
            F.count(F.col(f"`{c}`")).alias(f"{c}.n"),
            F.avg(F.length(text)).alias(f"{c}.mean_length"),
            F.count_if(number.isNotNull()).alias(f"{c}.numbers"),
            F.count_if(number.isNotNull() & (number == F.floor(number))).alias(f"{c}.whole"),
        ]
    facts = _long_form(df, df.agg(*aggs), columns, ["n", "mean_length", "numbers", "whole"])
    # a row for each column
    out = facts.join(F.broadcast(distinct_counts(df, columns)), "column")
    return out.select("column", "n", "distinct_values", "mean_length", "numbers", "whole")


def kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, kind): bool, datetime, integer, number, categorical or text."""
    types = {f.name: f.dataType.typeName() for f in df.schema}
    typed = {"boolean": "bool", "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "datetime", "byte": "integer", "short": "integer", "integer": "integer", "long": "integer", "float": "number", "double": "number"}
    # what a type tells needs no pass over the rows
    open_ = [c for c in columns if types[c] not in typed]
    sure = df.sparkSession.createDataFrame([(c, typed[types[c]]) for c in columns if c not in open_], "column string, kind string")
    if not open_:
        return sure
    facts = kind_facts(df, open_)
    few = (F.col("distinct_values") <= 20) | ((F.col("distinct_values") / F.col("n") <= 0.5) & (F.col("mean_length") <= 64))
    told = (
        F.when(F.col("n") == 0, "text")
        .when(F.col("numbers") == F.col("n"), F.when(F.col("whole") == F.col("n"), "integer").otherwise("number"))
        .when(few, "categorical")
        .otherwise("text")
    )
    return sure.union(facts.select("column", told.alias("kind")))
