"""How values are shown: rounded, as JSON, with units, and metrics with their direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units of sizes, each 1,024 times the one before.
UNITS = ("B", "KB", "MB", "GB")


def rounded(number: Column, places: int = 4) -> Column:
    """Half to even at ``places`` decimals, of the scaled double; NaN and infinities are null."""
    x = number.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.rint(x * 10.0**places) / 10.0**places)


def json_value(name: str, kind: T.DataType) -> Column:
    """The value of a column as a JSON scalar in text: bytes as UTF-8, what is no number as null, times as ISO texts."""
    x = F.col(f"`{name}`")
    if isinstance(kind, T.BinaryType):
        x = F.decode(x, "UTF-8")
    elif isinstance(kind, T.FloatType | T.DoubleType):
        x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        x = F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
    elif isinstance(kind, T.DateType):
        x = F.date_format(x, "yyyy-MM-dd")
    whole = F.to_json(F.struct(x.alias("v")))
    return F.when(x.isNull(), "null").otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def size_text(n: Column) -> Column:
    """Bytes in the largest unit of which there is one, with one decimal above bytes."""
    out = F.concat(n.cast("long").cast("string"), F.lit(f" {UNITS[0]}"))
    for power, unit in enumerate(UNITS[1:], 1):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", n / 1024**power), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n.isNotNull(), out)


def metric_text(value: Column, higher_is_better: Column) -> Column:
    """A metric in four decimals with an arrow for its better direction; a missing one is a dash."""
    return F.when(value.isNull(), "–").otherwise(F.concat(F.format_string("%.4f", value), F.when(higher_is_better, " ↑").otherwise(" ↓")))


def gap_text(metric: Column, gap: Column, lowest: Column, highest: Column, exceeds: Column) -> Column:
    """What a gap between groups says, and whether it is above its threshold; a gap of fewer than two groups is not measured."""
    said = F.concat(metric, F.lit(" runs from "), F.coalesce(lowest, F.lit("None")), F.lit(" to "), F.coalesce(highest, F.lit("None")), F.lit(" by "), F.format_string("%.3f", gap))
    return F.when(gap.isNull(), F.concat(metric, F.lit(" is not measured"))).otherwise(F.concat(said, F.when(exceeds, ", above the threshold").otherwise("")))


def evidence(p: Column) -> Column:
    """How strong a p-value is: below 0.01 strong, below 0.05 some, else none."""
    return F.when(p < 0.01, "strong").when(p < 0.05, "some").otherwise("none")


def percent_done(done: Column, total: Column) -> Column:
    """The whole percentage that is done, 100 at most."""
    return F.least(F.lit(100), F.round(100.0 * done / total)).cast("long")
