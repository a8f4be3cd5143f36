"""How well one table stands for another: distributions, correlations, near copies, balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincart import tables
from graincart.functions import tests_of_fit
from graincart.operators.profile import correlation
from graincart.operators.running import running_sums

#: Numbers that near copies meet by cells of; the others are only compared. Rows of a cell for each key.
GRID, CELL_ROWS = 3, 2000


def cumulative_counts(df: DataFrame, column: str, is_sample: Column) -> DataFrame:
    """(x, a, b, ca, cb): rows of the sample and of the made side at each value of a number, and up to it. Nulls are left out."""
    x = df.select(F.col(column).cast("double").alias("x"), is_sample.cast("long").alias("s")).where("x is not null")
    counts = x.groupBy("x").agg(F.sum("s").alias("a"), F.sum(1 - F.col("s")).alias("b"))
    return running_sums(counts, "x", {"ca": "a", "cb": "b"})


def ks_statistic(df: DataFrame, column: str, is_sample: Column, exact_up_to: int = tests_of_fit.EXACT) -> DataFrame:
    """statistic and p_value: the largest distance of the two empirical distributions, and its chance.

    Rows are summed by value before anything is ordered. Both are null if a side has no row.
    """
    run = cumulative_counts(df, column, is_sample)
    totals = run.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs(F.try_divide("ca", "na") - F.try_divide("cb", "nb"))
    one = run.crossJoin(F.broadcast(totals)).agg(F.max(gap).alias("statistic"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    chance = F.udf(lambda d, n, m: tests_of_fit.kolmogorov_smirnov(d, n or 0, m or 0, exact_up_to), "double")  # one row
    return one.select("statistic", chance("statistic", "na", "nb").alias("p_value"))


def aligned_counts(df: DataFrame, column: str, is_sample: Column) -> DataFrame:
    """(value, sample, made) of all categories of either side, nulls as the category None."""
    key = F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value")
    return df.groupBy(key).agg(F.count_if(is_sample).alias("sample"), F.count_if(~is_sample).alias("made"))


def chi_square(df: DataFrame, column: str, is_sample: Column) -> DataFrame:
    """statistic, dof and p_value of the made counts against the sample's shares; expected counts are 0.5 at least, then rescaled."""
    counts = aligned_counts(df, column, is_sample)
    sums = F.broadcast(counts.agg(F.sum("sample").alias("all_sample"), F.sum("made").alias("total")))
    counts = counts.crossJoin(sums).withColumn("e", F.greatest(F.try_divide("sample", "all_sample") * F.col("total"), F.lit(0.5)))
    counts = counts.crossJoin(F.broadcast(counts.agg(F.sum("e").alias("all_e")))).withColumn("e", F.col("e") * F.col("total") / F.col("all_e"))
    one = counts.agg(F.sum((F.col("made") - F.col("e")) ** 2 / F.col("e")).alias("statistic"), (F.count("*") - 1).alias("dof"))
    chance = F.udf(lambda x, dof: tests_of_fit.chi_square_tail(x, dof or 0), "double")  # one row
    return one.withColumn("p_value", chance("statistic", "dof"))


def distributions(df: DataFrame, numeric: list[str], categorical: list[str], is_sample: Column, bins: int = 20, most: int = 12) -> DataFrame:
    """(column, chart, sample_side, label, value): histograms over edges that both sides share, and shares of categories.

    A bin's label is its number, its value the count of rows; the last bin holds the largest value. Of
    the categories of a side the ``most`` common ones stand, those that tie by name, and the others
    are summed as ``other``. Missing categories are the category None; missing numbers are left out.
    """
    parts = []
    if numeric:
        ends = df.agg(*[f for i, c in enumerate(numeric) for f in (F.min(F.col(c).cast("double")).alias(f"lo{i}"), F.max(F.col(c).cast("double")).alias(f"hi{i}"))])
        each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i, c in enumerate(numeric)])
        cells = df.withColumn("_side", is_sample).crossJoin(F.broadcast(ends)).select("_side", F.explode(each).alias("r")).select("_side", "r.*").where("x is not null")
        width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
        bin_of = F.least(F.floor((F.col("x") - F.col("lo")) / width * bins), F.lit(bins - 1)).cast("string")
        counts = cells.groupBy("column", F.lit("histogram").alias("chart"), F.col("_side").alias("sample_side"), bin_of.alias("label"))
        parts.append(counts.agg(F.count("*").cast("double").alias("value")))
    if categorical:
        each = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("v")) for c in categorical])
        counts = df.select(is_sample.alias("sample_side"), F.explode(each).alias("r")).groupBy("r.column", "sample_side", "r.v").agg(F.count("*").alias("n"))
        side = Window.partitionBy("column", "sample_side")
        ranked = counts.withColumn("k", F.row_number().over(side.orderBy(F.desc("n"), "v"))).withColumn("all", F.sum("n").over(side))
        label = F.when(F.col("k") <= most, F.col("v")).otherwise("other")
        shares = ranked.groupBy("column", F.lit("bar").alias("chart"), "sample_side", label.alias("label")).agg((F.sum("n") / F.max("all")).alias("value"))
        parts.append(shares)
    return parts[0].union(parts[1]) if len(parts) == 2 else parts[0]


def ks_of_all(df: DataFrame, columns: dict[str, Column], is_sample: Column, exact_up_to: int = tests_of_fit.EXACT) -> DataFrame:
    """(column, statistic, p_value) of Kolmogorov and Smirnov's test for each of ``columns`` (name: number), in one pass.

    Rows are summed by column and value before anything is ordered. A side without values has neither.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), x.cast("double").alias("x")) for c, x in columns.items()])).alias("p")
    rows = df.select(is_sample.cast("long").alias("s"), each).select("s", "p.*").where("x is not null")
    counts = rows.groupBy("column", "x").agg(F.sum("s").alias("a"), F.sum(1 - F.col("s")).alias("b"))
    run = running_sums(counts, "x", {"ca": "a", "cb": "b"}, by=("column",), totals=True)
    gap = F.abs(F.try_divide("ca", "total_ca") - F.try_divide("cb", "total_cb"))
    one = run.groupBy("column").agg(F.max(gap).alias("statistic"), F.max("total_ca").alias("na"), F.max("total_cb").alias("nb"))
    chance = F.udf(lambda d, n, m: tests_of_fit.kolmogorov_smirnov(d, n or 0, m or 0, exact_up_to), "double")  # a row for each column
    return one.select("column", "statistic", chance("statistic", "na", "nb").alias("p_value"))


def chi_square_of_all(df: DataFrame, columns: list[str], is_sample: Column) -> DataFrame:
    """(column, statistic, dof, p_value): ``chi_square`` of each of ``columns`` in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("value")) for c in columns])).alias("p")
    counts = df.select(is_sample.alias("s"), each).groupBy("p.column", "p.value").agg(F.count_if("s").alias("a"), F.count_if(~F.col("s")).alias("b"))
    counts = tables.written(counts)
    # a row for each column
    whole = F.broadcast(counts.groupBy("column").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b")))
    counts = counts.join(whole, "column").withColumn("e", F.greatest(F.try_divide("a", "all_a") * F.col("all_b"), F.lit(0.5)))
    counts = counts.join(F.broadcast(counts.groupBy("column").agg(F.sum("e").alias("all_e"))), "column").withColumn("e", F.col("e") * F.col("all_b") / F.col("all_e"))
    one = counts.groupBy("column").agg(F.sum(F.try_divide((F.col("b") - F.col("e")) ** 2, F.col("e"))).alias("statistic"), (F.count("*") - 1).alias("dof"))
    chance = F.udf(lambda x, dof: tests_of_fit.chi_square_tail(x, dof or 0), "double")  # a row for each column
    return one.withColumn("p_value", chance("statistic", "dof"))


#: P-values below, drifts and shares of dropped rows above which a report warns, and the share of the
#: mean distance of neighbours within which rows are near copies.
LOW_P, DRIFT, DROPPED, NEAR = 0.01, 0.2, 0.1, 0.05
REPORT = "measure string, column string, value double, p_value double, bound double, warning string"


def near_threshold(rows: int, numbers: int) -> float:
    """Within which distance a row is a near copy: it falls with the density of ``rows`` in ``numbers`` dimensions, and is 0 without any."""
    return NEAR * rows ** (-1.0 / numbers) if numbers and rows else 0.0


def report(df: DataFrame, is_sample: Column, numeric: list[str], categorical: list[str], key: list[str], wanted: dict[str, dict[str, float]] | None = None, dropped: int = 0, asked: int | None = None, from_profile: bool = False, near: float | None = None) -> DataFrame:
    """How well the made rows of ``df`` stand for its sample, a row for each thing that was measured.

    (measure, column, value, p_value, bound, warning): ks and chi2 for each column, correlation_drift,
    duplicates (made rows beyond the first of their kind) and duplicates_share, near_copies (within
    ``bound``, which ``near_threshold`` gives unless ``near`` does), dropped, dropped_share,
    wanted:<value> and made:<value> for each share that was asked for, and derived_profile. ``warning``
    is a code where the value is beyond its bound, else null. All rows of both sides are compared.
    """
    spark, columns = df.sparkSession, [*numeric, *categorical]
    sizes = df.agg(F.count_if(is_sample).alias("sample"), F.count_if(~is_sample).alias("made")).first()
    made, asked = df.where(~is_sample), sizes["made"] if asked is None else asked
    null = F.lit(None).cast("double")
    parts = []
    if numeric:
        tests = ks_of_all(df, {c: F.col(c) for c in numeric}, is_sample)
        parts.append(tests.select(F.lit("ks").alias("measure"), "column", F.col("statistic").alias("value"), "p_value", F.lit(LOW_P).alias("bound")))
    if categorical:
        tests = chi_square_of_all(df, categorical, is_sample)
        parts.append(tests.select(F.lit("chi2").alias("measure"), "column", F.col("statistic").alias("value"), "p_value", F.lit(LOW_P).alias("bound")))
    parts = [p.withColumn("warning", F.when(F.col("p_value") < F.col("bound"), "fidelity_drift")) for p in parts]
    if numeric:
        drift = correlation_drift(df, numeric, is_sample).select(F.lit("correlation_drift").alias("measure"), F.lit(None).cast("string").alias("column"), F.coalesce("drift", F.lit(0.0)).alias("value"), null.alias("p_value"), F.lit(DRIFT).alias("bound"))
        parts.append(drift.withColumn("warning", F.when(F.col("value") > F.col("bound"), "fidelity_drift")))
    share = dropped / max(asked, 1)
    facts = [("dropped", None, float(dropped), None, None, None), ("dropped_share", None, share, None, DROPPED, "dropped_rows_high" if share > DROPPED else None), ("derived_profile", None, float(from_profile), None, None, "derived_profile" if from_profile else None)]
    if columns:
        kinds = made.groupBy(*columns).agg(F.count("*").alias("n"))
        twice = kinds.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).first()["n"]
        bound = near_threshold(sizes["sample"], len(numeric)) if near is None else near
        copies = near_copies(made, df.where(is_sample), key, numeric, categorical, bound).count() if sizes["sample"] and sizes["made"] else 0
        facts += [("duplicates", None, float(twice), None, None, None), ("duplicates_share", None, twice / max(sizes["made"], 1), None, None, None), ("near_copies", None, float(copies), None, bound, "near_copies" if copies else None)]
    for c, shares in (wanted or {}).items():
        for r in balance(made, c, shares).collect():
            facts += [(f"wanted:{r['value']}", c, float(r["wanted"]), None, None, None), (f"made:{r['value']}", c, float(r["actual"] or 0.0), None, None, None)]
    out = spark.createDataFrame(facts, REPORT)
    for p in parts:
        out = out.union(p.select(*out.columns))
    return out


def report_warnings(told: DataFrame) -> list[str]:
    """The codes that a report warns of, each once, by name."""
    return [r["warning"] for r in told.where("warning is not null").select("warning").distinct().orderBy("warning").collect()]


def correlation_drift(df: DataFrame, columns: list[str], is_sample: Column) -> DataFrame:
    """The largest difference of any correlation between the two sides, from one aggregation."""
    x = lambda c, side: F.when(side, F.col(c).cast("double"))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return df.limit(0).agg(F.lit(0.0).alias("drift"))
    gaps = [F.abs(correlation(x(a, is_sample), x(b, is_sample)) - correlation(x(a, ~is_sample), x(b, ~is_sample))) for a, b in pairs]
    return df.agg((F.greatest(*gaps) if len(gaps) > 1 else gaps[0]).alias("drift"))


def correlation_matrices(df: DataFrame, columns: list[str], is_sample: Column) -> DataFrame:
    """(a, b, sample, made): each pair's correlation on both sides, from one aggregation; null where a side does not vary."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cell = lambda a, b, side: correlation(F.when(side, F.col(a)), F.when(side, F.col(b)))
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), cell(a, b, is_sample).alias("sample"), cell(a, b, ~is_sample).alias("made")) for a, b in pairs])
    return df.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def cumulative_shares(df: DataFrame, column: str) -> DataFrame:
    """(value, share): the share of rows with this value or a smaller one; nulls are left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return running_sums(counts, "value", {"upto": "n"}, totals=True).select("value", (F.col("upto") / F.col("total_upto")).alias("share"))


def near_copies(made: DataFrame, sample: DataFrame, key: list[str], numeric: list[str], categorical: list[str], threshold: float) -> DataFrame:
    """The rows of ``made`` that lie within ``threshold`` of a row of ``sample``, with the least distance.

    The distance is the largest over the columns: numbers scaled by the sample's range, categories
    0 or 1; both missing is 0, one missing is 1.

    Equal rows of a side are compared once. Below a threshold of 1, rows meet by their categories,
    missing values and cells of the threshold's width on the first numbers; a cell with many rows is
    dealt over several keys.
    """
    columns = [*numeric, *categorical]
    ends = sample.agg(F.lit(1).alias("one"), *[f for c in numeric for f in (F.min(c).cast("double").alias(f"m_{c}"), (F.max(c) - F.min(c)).cast("double").alias(f"r_{c}"))])
    row = F.struct(*columns).alias("row")
    meets = F.struct(*_meeting(numeric, categorical, threshold)).alias("meets")
    left = made.select(row).distinct().select("row", "row.*").crossJoin(F.broadcast(ends)).select("row", *[f"r_{c}" for c in numeric], *columns, meets)
    right = sample.select(row).distinct().select("row", "row.*").crossJoin(F.broadcast(ends)).select(*[F.col(c).alias(f"s_{c}") for c in columns], meets)
    for i in range(min(len(numeric), GRID) if threshold < 1 else 0):
        # a row of the sample stands in its own cell and in both beside it
        cell = F.col(f"meets.cell{i}")
        near = F.when(cell.isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(cell - 1, cell, cell + 1))
        right = right.withColumn("_cell", F.explode(near))
        right = right.withColumn("meets", F.col("meets").withField(f"cell{i}", F.col("_cell"))).drop("_cell")
    count = lambda d, n: d.groupBy("meets").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias(n))
    parts_of = count(left, "n_left").join(count(right, "n_right"), "meets")
    left = _dealt(left.join(parts_of, "meets"), columns, "left", "right")
    right = _dealt(right.join(parts_of, "meets"), [f"s_{c}" for c in columns], "right", "left")
    parts = []
    for c in numeric:
        parts.append(_missing(c, F.abs(F.col(c) - F.col(f"s_{c}")).cast("double") / _scale(c)))
    for c in categorical:
        parts.append(_missing(c, F.when(F.col(c) == F.col(f"s_{c}"), 0.0).otherwise(1.0)))
    gap = F.greatest(*parts) if len(parts) > 1 else parts[0]
    best = left.join(right, ["meets", "left", "right"]).select("row", gap.alias("distance")).where(F.col("distance") <= threshold)
    best = best.groupBy("row").agg(F.min("distance").alias("distance"))
    return made.select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(key)], row).join(best, "row").groupBy(*[F.col(f"k_{i}").alias(k) for i, k in enumerate(key)]).agg(F.min("distance").alias("distance"))


def _dealt(df: DataFrame, columns: list[str], own: str, other: str) -> DataFrame:
    """Each row in one of its side's parts of a cell, once for each part of the other side."""
    parts = F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}").cast("long") - 1)
    return df.withColumn(own, F.pmod(F.xxhash64(*columns), F.col(f"n_{own}").cast("long"))).withColumn(other, F.explode(parts)).drop("n_left", "n_right")


def _scale(c: str) -> Column:
    return F.when(F.col(f"r_{c}") == 0, 1.0).otherwise(F.col(f"r_{c}"))


def _meeting(numeric: list[str], categorical: list[str], threshold: float) -> list[Column]:
    """What is equal, or a cell beside, in any two rows within ``threshold``; nothing from 1 on."""
    if threshold >= 1:
        return [F.lit(0).alias("all")]
    # a little wider than the threshold, so that rounding moves no pair further than a cell
    cells = [F.floor((F.col(c).cast("double") - F.col(f"m_{c}")) / (_scale(c) * max(threshold, 1e-9) * 1.001)).alias(f"cell{i}") for i, c in enumerate(numeric[:GRID])]
    return [F.lit(0).alias("all"), *cells, *[F.col(c).isNull().alias(f"none{i}") for i, c in enumerate(numeric[GRID:])], *[F.col(c).alias(f"same{i}") for i, c in enumerate(categorical)]]


def _missing(c: str, distance: Column) -> Column:
    a, b = F.col(c), F.col(f"s_{c}")
    return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull() | b.isNull(), 1.0).otherwise(distance)


def balance(df: DataFrame, column: str, wanted: dict[str, float]) -> DataFrame:
    """(value, wanted, actual): the shares asked for and those found, missing as the category None."""
    text = F.coalesce(F.col(column).cast("string"), F.lit("None"))
    rows = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(float(s)).alias("wanted"), F.avg((text == v).cast("double")).alias("actual")) for v, s in wanted.items()])
    return df.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
