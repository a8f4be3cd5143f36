"""Scans of tables for personal data: findings, summaries and redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graincart import tables
from graincart.functions import pii

#: How many masked cells and row ids a finding shows.
CELLS, ROWS = 3, 5


def text_columns(df: DataFrame) -> list[str]:
    """The columns that are scanned: strings but for those that begin with two underscores."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and not f.name.startswith("__")]


def _hits(df: DataFrame, columns: list[str], *kept: Column) -> DataFrame:
    """(kept..., column, detector, n) of each cell and detector with a span; a text is shortened once for all numeric detectors."""
    texts = [x for i, c in enumerate(columns) for x in (F.col(f"`{c}`").alias(f"_text{i}"), pii.near_digits(F.col(f"`{c}`")).alias(f"_near{i}"))]
    each = [
        F.struct(F.lit(c).alias("column"), F.lit(d.name).alias("detector"), pii.span_count(F.col(f"_text{i}"), F.col(f"_near{i}"), d).alias("n"))
        for i, c in enumerate(columns)
        for d in pii.DETECTORS
    ]
    rows = df.select(*kept, *texts)
    names = rows.columns[: len(kept)]
    return rows.select(*names, F.explode(F.array(*each)).alias("cell")).select(*names, "cell.*").where("n > 0")


def _summed(hits: DataFrame) -> DataFrame:
    return hits.groupBy("column", "detector").agg(F.sum("n").alias("spans"), F.count("*").alias("rows_with"))


def counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, detector, spans and rows_with of each column and detector with a span, in one pass.

    Nulls have none. An empty table gives an empty result.
    """
    columns = text_columns(df) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, detector string, spans long, rows_with long")
    return _summed(_hits(df, columns))


def findings(df: DataFrame, row_id: str, columns: list[str] | None = None) -> DataFrame:
    """``counts`` with example_cells, the first cells with their spans masked, and row_examples, by ``row_id``.

    No value of a cell's span stands in the result. Ties of ``row_id`` go by the masked cell. The
    patterns are sought in one pass, whose hits are written without the cells; the cells are then read of
    the first rows only.
    """
    columns = text_columns(df) if columns is None else columns
    kind = df.schema[row_id].dataType.simpleString()
    if not columns:
        return counts(df, columns).withColumn("example_cells", F.array().cast("array<string>")).withColumn("row_examples", F.array().cast(f"array<{kind}>"))
    hits = tables.written(_hits(df, columns, F.col(row_id).alias("row")))
    found = _summed(hits)
    told = [(r["column"], r["detector"]) for r in found.select("column", "detector").collect()]  # a row for each column and detector
    if not told:
        return found.withColumn("example_cells", F.array().cast("array<string>")).withColumn("row_examples", F.array().cast(f"array<{kind}>"))
    of = lambda c, d: (F.col("column") == c) & (F.col("detector") == d)
    firsts = reduce(DataFrame.union, [hits.where(of(c, d)).select("column", "detector", "row").orderBy("row").limit(ROWS) for c, d in told])
    # at most ROWS rows for each column and detector
    firsts = F.broadcast(firsts.distinct().withColumnRenamed("row", "_row"))
    cells = df.select(F.col(row_id).alias("row"), *[F.col(f"`{c}`").alias(f"_text{i}") for i, c in enumerate(columns)])
    cells = cells.join(firsts, F.col("row").eqNullSafe(F.col("_row")))
    cell = F.lit(None).cast("string")
    for c, d in told:
        text, detector = F.col(f"_text{columns.index(c)}"), pii.BY_NAME[d]
        cell = F.when(of(c, d), F.when(F.size(pii.matches(text, detector)) > 0, pii.with_masked_spans(text, detector))).otherwise(cell)
    cells = cells.select("column", "detector", "row", cell.alias("cell")).where("cell is not null")
    place = F.row_number().over(Window.partitionBy("column", "detector").orderBy("row", "cell"))
    first = cells.withColumn("_place", place).where(F.col("_place") <= ROWS).groupBy("column", "detector").agg(F.array_sort(F.collect_list(F.struct("row", "cell"))).alias("first"))
    out = found.join(F.broadcast(first), ["column", "detector"])
    return out.select("column", "detector", "spans", "rows_with", F.slice("first.cell", 1, CELLS).alias("example_cells"), F.col("first.row").alias("row_examples"))


def primary_detectors(found: DataFrame) -> DataFrame:
    """column, spans, detectors and primary of each column of ``counts``: the detector with most spans, the first of those that tie."""
    order = F.array_position(F.array(*[F.lit(d.name) for d in pii.DETECTORS]), F.col("detector"))
    best = F.max_by("detector", F.struct("spans", -order))
    return found.groupBy("column").agg(F.sum("spans").alias("spans"), F.count("*").alias("detectors"), best.alias("primary"))


def mask_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the spans in ``columns`` replaced by a mark, and for each <column>__replaced, how many there were."""
    out = df
    for c in columns:
        new = pii.redacted(F.col(f"`{c}`"))
        out = out.withColumn(c, F.struct(F.col(f"`{c}`").alias("old"), new.alias("new")))
        out = out.withColumn(f"{c}__replaced", pii.marks_added(F.col(f"`{c}`.old"), F.col(f"`{c}`.new"))).withColumn(c, F.col(f"`{c}`.new"))
    return out
