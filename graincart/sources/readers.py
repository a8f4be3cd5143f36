"""Tables from files and rows, and back into files."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "__row_id__"
PROVENANCE = "__provenance__"


class UnsupportedFormat(ValueError):
    """The suffix of a file names no known format."""


class MalformedFile(ValueError):
    """A file is empty, has no columns or cannot be parsed."""


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV (with a header), Parquet or JSON Lines file or folder, by its suffix in either case.

    MalformedFile comes at once, not when rows are read: for a file that is empty or cannot be parsed, a
    CSV row of more fields than the header, and a line that is no JSON object. CSV rows of fewer fields
    end in nulls, and quoted fields may hold line breaks. Columns stand in the order of the file, those of
    JSON Lines in the order in which they first appear.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path else ""
    if suffix not in _READERS:
        raise UnsupportedFormat(f"cannot read .{suffix} files")
    try:
        df = _READERS[suffix](spark, path)
    except (PySparkException, Py4JJavaError) as e:
        raise MalformedFile(str(e)[:2000]) from e
    if not df.columns:
        raise MalformedFile("the file has no columns")
    return df


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    options = {"header": True, "multiLine": True, "escape": '"', "mode": "PERMISSIVE"}
    names = spark.read.options(**options).csv(path).columns
    if not names:
        raise MalformedFile("the file has no columns")
    bad = _free("_bad", names)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*names, bad)])
    df = spark.read.options(**options, columnNameOfCorruptRecord=bad).schema(schema).csv(path)

    def too_long(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [max((len(x) for x in csv.reader(io.StringIO(raw))), default=0) for raw in batch["raw"]]
            yield batch[[n > len(names) for n in sizes]]

    # rows whose number of fields is not that of the header; of these, only longer ones are wrong
    odd = df.where(F.col(f"`{bad}`").isNotNull()).select(F.col(f"`{bad}`").alias("raw"), F.col(f"`{names[0]}`").alias("first"))
    wrong = odd.mapInPandas(too_long, "raw string, first string").limit(1).collect()
    if wrong:
        raise MalformedFile(f"a row has more fields than the header: {wrong[0]['raw'][:200]}")
    return typed(df.drop(bad))


def _read_json(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = lines.where(F.trim("value") != "")
    keys = lines.select(F.posexplode(F.json_object_keys("value")).alias("at", "key"), "file", "block", "line")
    # as many rows as there are columns
    order = [r["key"] for r in keys.groupBy("key").agg(F.min(F.struct("file", "block", "line", "at")).alias("first")).orderBy("first").collect()]
    if not order:
        if lines.limit(1).count():
            raise MalformedFile("no line is a JSON object")
        raise MalformedFile("the file is empty")
    bad = _free("_bad", order)
    df = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)
    # all lines were looked at to find the columns, so that a bad one has shown
    if bad in df.columns:
        wrong = lines.where(F.json_object_keys("value").isNull()).limit(1).collect()
        raise MalformedFile(f"a line is no JSON object: {wrong[0]['value'][:200] if wrong else ''}")
    return df.select(*[F.col(f"`{c}`") for c in order if c in df.columns])


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


_READERS = {"csv": _read_csv, "parquet": lambda spark, path: spark.read.parquet(path), "jsonl": _read_json, "ndjson": _read_json}


def typed(df: DataFrame) -> DataFrame:
    """String columns as long, double or boolean where all their values are that; one aggregation for all."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    tests = []
    for i, c in enumerate(names):
        x = F.col(f"`{c}`")
        blank = x.isNull() | (x == "")
        ok = lambda t, x=x, blank=blank: F.bool_and(F.when(~blank, x.try_cast(t).isNotNull()))
        flag = F.bool_and(F.when(~blank, F.lower(x).isin("true", "false")))
        tests += [ok("bigint").alias(f"l{i}"), ok("double").alias(f"d{i}"), flag.alias(f"b{i}")]
    found = df.agg(*tests).first()
    kind = lambda i: "boolean" if found[f"b{i}"] else "bigint" if found[f"l{i}"] else "double" if found[f"d{i}"] else None
    return df.withColumns({c: F.nullif(F.col(f"`{c}`"), F.lit("")).try_cast(kind(i)) for i, c in enumerate(names) if kind(i)})


def from_rows(spark: SparkSession, columns: list[str], rows: list[list]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], columns) if rows else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))


def with_row_id(df: DataFrame) -> DataFrame:
    """``df``, read from one Parquet file, with the place of each row in it."""
    return df.select("*", F.col("_metadata.row_index").alias(ROW_ID))


def page(df: DataFrame, first: int, size: int = 200, row_id: str = ROW_ID) -> DataFrame:
    """``size`` rows (1000 at most) from row ``first``, by a range of ids that Parquet can skip to."""
    return df.where((F.col(row_id) >= first) & (F.col(row_id) < first + min(size, 1000))).orderBy(row_id)


def export(df: DataFrame, path: str, form: str = "csv", provenance: bool = False) -> None:
    """Write ``df`` as CSV or Parquet; row ids never and provenance only on request."""
    out = df.drop(ROW_ID) if provenance else df.drop(ROW_ID, PROVENANCE)
    if form == "csv":
        out.write.mode("errorifexists").option("header", True).csv(path)
    elif form == "parquet":
        out.write.mode("errorifexists").parquet(path)
    else:
        raise UnsupportedFormat(f"cannot write {form}")
