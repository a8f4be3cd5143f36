"""Sets of columns of one or two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_only(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The columns of ``keep`` as they are, and all others that are numbers or times as doubles, times in seconds."""
    out = []
    for f in df.schema.fields:
        x = F.col(f"`{f.name}`")
        if f.name in keep:
            out.append(x)
        elif isinstance(f.dataType, T.NumericType):
            out.append(x.cast("double").alias(f.name))
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType | T.DateType):
            out.append((F.unix_micros(x.cast("timestamp")) / 1e6).alias(f.name))
    return df.select(*out)


def shared(a: DataFrame, b: DataFrame) -> list[str]:
    """The names that both tables have, in the order of the first."""
    return [c for c in a.columns if c in b.columns]


def concatenated(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, by the names of columns; a column that one lacks is null there."""
    return a.unionByName(b, allowMissingColumns=True)
