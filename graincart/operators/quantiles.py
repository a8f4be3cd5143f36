"""Exact quantiles by distributed selection.

Rows are counted in bins that keep the order of numbers: of one sign and a 256th of a power of two at
first. The counts tell which bins hold the wanted places, and only their rows are counted again, in
4,096 bins between their least and largest value, until few enough rows are left that their values are
counted one by one. What is aggregated is a count for each bin, or for each value of at most
EXACT_ROWS rows, whatever the number of values; a double's 52 digits end it after six passes at most.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincart import tables

#: Bins of a power of two, and of a bin that is counted again; rows whose values are counted one by one.
STEPS, BINS, EXACT_ROWS = 256, 4096, 2_000_000


def ordered_bin(x: Column) -> Column:
    """A long that never falls as doubles rise, NaN above all: equal for 0.0 and -0.0, null for null."""
    far = 1 << 20
    size = lambda y: F.floor(F.log2(y) * STEPS) + far  # noqa: E731  a logarithm never falls as its number rises
    return (
        F.when(F.isnan(x), F.lit(1 << 30)).when(x == float("inf"), F.lit(1 << 29)).when(x == float("-inf"), F.lit(-(1 << 29)))
        .when(x > 0, size(x)).when(x < 0, -size(-x)).when(x == 0, F.lit(0))
    ).cast("long")


def quantiles(df: DataFrame, columns: dict[str, Column], shares: Iterable[float], by: Iterable[str] = ()) -> DataFrame:
    """(by, column, n, values): the quantiles of each of ``columns`` (name: number), interpolated between neighbours, and their count.

    Groups are those of the columns ``by``, nulls one of them. Nulls are no values; NaN is above all
    numbers. A column without any value has no row. All columns are counted in the same passes.
    """
    by, shares = list(by), list(shares)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), x.cast("double").alias("_x")) for i, x in enumerate(columns.values())]))
    group = F.struct(*by) if by else F.lit(0)
    rows = df.select(group.alias("_g"), pairs.alias("_p")).select("_g", "_p._c", "_p._x").where("_x is not null")
    rows = rows.withColumn("_b", ordered_bin(F.col("_x")))
    of = ["_g", "_c"]

    def counted(some: DataFrame, within: list[str], key: Column) -> DataFrame:
        """Each bin's count, ends, and number of rows before it in its group, column and former bin."""
        each = some.groupBy(*within, key.alias("_bin")).agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        return each.withColumn("_before", F.sum("_n").over(Window.partitionBy(*within).orderBy("_bin")) - F.col("_n"))

    first = tables.written(counted(rows, of, F.col("_b")))
    sizes = first.groupBy(*of).agg(F.sum("_n").alias("_rows"))
    # the two neighbours of each share, as places from 0
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("_q"), ((F.col("_rows") - 1) * s).alias("_at")) for i, s in enumerate(shares)]))
    wanted = sizes.select(*of, "_rows", at.alias("w")).select(*of, "_rows", "w._q", "w._at")
    wanted = wanted.select("*", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_place")).distinct()
    found = first.join(wanted, of).where((F.col("_place") >= F.col("_before")) & (F.col("_place") < F.col("_before") + F.col("_n")))
    kept = [*of, "_rows", "_q", "_at", "_place", "_b", "_n", "_low", "_high"]
    found = tables.written(found.withColumnRenamed("_bin", "_b").select(*kept, (F.col("_place") - F.col("_before")).alias("_rest")))
    tables.drop(first)
    done = [found]
    while True:
        bins = found.where("_low < _high").select(*of, "_b", F.col("_low").alias("_from"), F.col("_high").alias("_to"), "_n").distinct()
        left = bins.agg(F.sum("_n")).first()[0]
        if not left:
            break
        bins = tables.small(bins.drop("_n"))
        some = rows.join(bins, [*of, "_b"]).where((F.col("_x") >= F.col("_from")) & (F.col("_x") <= F.col("_to")))
        key = F.col("_x") if left <= EXACT_ROWS else F.floor((F.col("_x") - F.col("_from")) / (F.col("_to") - F.col("_from")) * BINS).cast("double")
        within = [*of, "_b", "_from"]
        sought = found.where("_low < _high").select(*of, "_b", F.col("_low").alias("_from"), "_rows", "_q", "_at", "_place", "_rest")
        inner = counted(some, within, key).join(sought, within).where((F.col("_rest") >= F.col("_before")) & (F.col("_rest") < F.col("_before") + F.col("_n")))
        found = tables.written(inner.select(*kept, (F.col("_rest") - F.col("_before")).alias("_rest")))
        done.append(found)
    told = done[0].where("not _low < _high")
    for t in done[1:]:
        told = told.union(t.where("not _low < _high"))
    ends = told.groupBy(*of, "_rows", "_q", "_at").agg(F.min_by("_low", "_place").alias("_a"), F.max_by("_low", "_place").alias("_b"))
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at")))
    out = ends.groupBy(*of, "_rows").agg(F.sort_array(F.collect_list(F.struct("_q", value.alias("v")))).alias("_v"))
    name = F.element_at(F.array(*map(F.lit, columns)), F.col("_c") + 1)
    out = tables.written(out.select(*[F.col("_g")[c].alias(c) for c in by], name.alias("column"), F.col("_rows").alias("n"), F.col("_v.v").alias("values")))
    tables.drop(*done)
    return out


def medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float]:
    """The median of each of ``columns`` (name: number); those without values are left out."""
    return {r["column"]: r["values"][0] for r in quantiles(df, columns, [0.5]).collect()}
