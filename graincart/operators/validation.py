"""Rows of strings against declared columns: typed values, and what is wrong with each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.operators.schema import ColumnSpec

YES, NO = ("true", "yes", "1"), ("false", "no", "0")


def _typed(spec: ColumnSpec, text: Column) -> Column:
    if spec.kind == "bool":
        return F.when(F.lower(text).isin(*YES), True).when(F.lower(text).isin(*NO), False)
    if spec.kind in ("integer", "number"):
        x = text.try_cast("double")
        return F.when(x == F.floor(x), x.cast("long")) if spec.kind == "integer" else x
    if spec.kind == "datetime":
        return F.try_to_timestamp(text)
    if spec.kind == "categorical":
        return F.when(text.isin(*spec.categories), text)
    return text


def validated(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """``df`` with the declared columns in their types, and ``errors``: one message for each value that fits not.

    Blank values are null and no error.
    """
    values, errors = {}, []
    for s in specs:
        text = F.trim(F.col(s.name).cast("string"))
        text = F.when(text != "", text)
        value = _typed(s, text)
        wrong = text.isNotNull() & value.isNull()
        if s.kind in ("integer", "number"):
            low = value < s.low if s.low is not None else F.lit(False)
            high = value > s.high if s.high is not None else F.lit(False)
            out = F.coalesce(low | high, F.lit(False))
            errors.append(F.when(wrong, F.lit(f"{s.name}: not a {s.kind}")).when(out, F.lit(f"{s.name}: out of range")))
            value = F.when(~out, value)
        else:
            errors.append(F.when(wrong, F.lit(f"{s.name}: not a {s.kind}")))
        values[s.name] = value
    return df.withColumn("errors", F.array_compact(F.array(*errors))).withColumns(values)
