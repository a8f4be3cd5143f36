"""Prefix sums over the order of a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graincart import tables

def running_sums(df: DataFrame, x: str, sums: dict[str, str], descending: bool = False, by: tuple[str, ...] = (), totals: bool = False) -> DataFrame:
    """``df`` (one row for each value of the number ``x``, within each group of ``by``) with ``sums`` (new name: column) up to and with each row.

    The rows are dealt over ranges of (by, x) by a sorted shuffle and written once, with their
    range. Each range of a group is summed; the sums of the ranges before it, a table of at most
    as many rows as there are ranges and groups, are added to the prefix sums within the range. Values
    that are equal must be one row of a group. Nulls in ``x`` come first, or last if descending; nulls
    in ``by`` are a group. With ``totals`` the sum of a whole group comes too, as total_<name>. An
    empty table gives an empty result.
    """
    order = F.desc if descending else F.asc
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    dealt = tables.written(df.repartitionByRange(*by, order(x)).withColumn("_group", group).withColumn("_range", F.spark_partition_id()))
    each = dealt.groupBy("_group", "_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum(f"_{n}").over(Window.partitionBy("_group")).alias(f"total_{n}") for n in sums] if totals else []
    each = each.select("_group", "_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums], *whole)
    within = Window.partitionBy("_group", "_range").orderBy(order(x)).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(tables.small(each), ["_group", "_range"])
    told = [F.col(f"total_{n}") for n in sums] if totals else []
    return out.select(*df.columns, *[(F.sum(c).over(within) + F.col(f"_{n}")).alias(n) for n, c in sums.items()], *told)


def places(df: DataFrame, salt: str, key: list[str], within: list[str] | None = None, each: int = 100_000) -> DataFrame:
    """``df`` with ``_at``: 0, 1, ... in an order that hashes of ``salt`` and ``key`` give, for each value of ``within``.

    Rows are ordered within bins of about ``each`` rows only; the bins' counts tell where each bin
    begins. Rows with equal keys have places of their own, in any order.
    """
    bins = df.count() // each + 1
    group = F.to_json(F.struct(*within)) if within else F.lit("")
    draw = F.xxhash64(F.lit(salt), *[F.col(c) for c in key])
    rows = df.withColumn("_group", group).withColumn("_draw", draw).withColumn("_bin", F.pmod("_draw", F.lit(bins)))
    sizes = rows.groupBy("_group", "_bin").agg(F.count("*").alias("_n"))
    begins = sizes.select("_group", "_bin", (F.sum("_n").over(Window.partitionBy("_group").orderBy("_bin")) - F.col("_n")).alias("_begin"))
    order = Window.partitionBy("_group", "_bin").orderBy("_draw", *key)
    out = rows.join(begins, ["_group", "_bin"]).withColumn("_at", F.col("_begin") + F.row_number().over(order) - 1)
    return out.select(*df.columns, "_at")
