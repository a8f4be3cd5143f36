"""Mixing of sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, divided by its quality weight; the documents of a source
stand in the order of their keys, and a prefix sum of their sizes is cut at the source's word
budget. Whole passes over the source (epochs) come first; the sorted order decides only about the
fraction of a pass that is left.

No source is ever sorted in one task. The key is an integer of 48 bits; sizes are summed by its
first 12 bits, the bin that holds the cut is summed by the next 12 bits, and only what shares the
first 24 bits with the cut is sorted and summed row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincart.llm.common import broadcast_if_small, materialize

SPACE = r"[^\x20\x09-\x0D]+"
BITS = 12
#: The budget of all sources as a share of all words, and the most passes over one source.
SHARE, MOST = 1.5, 2.0


def quality_weight(text: Column) -> Column:
    """0.25 to 1: the share of characters that are neither digits nor marks of tables, code and spam."""
    odd = F.length(text) - F.length(F.translate(text, "0123456789|{}<>[]=_#*~^\\@$%+/&;", ""))
    return F.coalesce(1.0 - 0.75 * odd / F.greatest(F.length(text), F.lit(1)), F.lit(1.0))


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: int = 0) -> Column:
    """A key of 48 bits whose order is that of E / weight, E exponential and a function of id, text and seed."""
    draw = F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.lit(str(seed)), doc_id.cast("string"), text)), 1, 12), 16, 10)
    u = (draw.cast("double") + 0.5) / 2.0**48
    # 1 - u ** (1 / weight) grows with -ln(u) / weight, and lies in (0, 1)
    key = F.floor((1.0 - F.exp(F.ln(u) / weight)) * 2.0**48).cast("long")
    return F.least(F.greatest(key, F.lit(0)), F.lit(2**48 - 1))


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size; a row for each source) with ``target``.

    The sources in the order of their code points, null last, weigh 3, 1, 2, 3, ... A target
    stops at ``most`` times its source's size; what is over goes to the others by weight until
    none is above. That is min(cap, level * weight) with one level for all, found by sorting the
    sources by cap / weight: the sources before some place are capped, those behind share the rest.
    """
    alone = Window.partitionBy(F.lit(1))
    named = sizes.withColumn("_rank", F.row_number().over(alone.orderBy(F.col("source").asc_nulls_last())) - 1)
    named = named.withColumn("_weight", F.element_at(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0)), (F.col("_rank") % 3 + 1).cast("int")))
    named = named.withColumn("_cap", most * F.col("source_size")).withColumn("_total", share * F.sum("source_size").over(alone))
    order = alone.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    behind = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    named = named.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(behind))
    # the first source whose cap is not reached sets the level
    free = F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_weight")).alias("at"), F.col("_rank"), F.col("_level").alias("level")))
    named = named.withColumn("_free", F.min(free).over(alone))
    target = F.coalesce(F.least(F.col("_cap"), F.col("_free.level") * F.col("_weight")), F.col("_cap"))
    return named.select("source", "source_size", target.cast("double").alias("target"))


def _cut(sums: DataFrame, by: list[str]) -> DataFrame:
    """The bin of each source in which the prefix sum passes ``left``, and what is left at its start."""
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(w), F.lit(0))
    return sums.withColumn("before", before).where((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left"))).select(
        *by, "bin", (F.col("left") - F.col("before")).alias("rest")
    )


def _place() -> Column:
    return F.struct(F.col("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.col("size"))


def mix(docs: DataFrame, seed: int = 0, share: float = SHARE, most: float = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and the columns of ``carry`` for each row of ``docs``.

    A null text has size 0 and is taken 0 times. A null source is a source of its own, last in
    order. Rows equal in id and text have one key and are
    taken alike. A source of size 0 has target 0. An
    empty table gives an empty result. The document at the cut gives only as many of its words as
    the budget still holds. Other columns of ``docs`` are ignored.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(SPACE)), F.lit(0)).cast("long")
    weight = quality_weight(F.col("text"))
    rows = docs.select("doc_id", "source", size.alias("size"), sampling_key(F.col("doc_id"), F.col("text"), weight, seed).alias("key"), *carry)
    rows = materialize(rows)
    by_source = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    by_source = by_source.withColumn("passes", passes).withColumn("left", F.col("target") - F.col("passes") * F.col("source_size"))
    small = broadcast_if_small(by_source.withColumnRenamed("source", "s"))
    same = F.col("source").eqNullSafe(F.col("s"))
    first, second = F.shiftright("key", 36), F.shiftright("key", 24)

    # the bin of the first 12 bits that holds the cut, then that of the next 12
    sums = rows.groupBy("source", first.alias("bin")).agg(F.sum("size").alias("words")).join(small, same).where("left > 0")
    cut1 = materialize(_cut(sums, ["source"]))
    c1 = broadcast_if_small(cut1.select(F.col("source").alias("s"), F.col("bin").alias("bin1"), F.col("rest").alias("left")))
    inner = rows.join(c1, same & (first == F.col("bin1"))).groupBy("source", "bin1", second.alias("bin")).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    cut2 = materialize(_cut(inner, ["source"]))
    c2 = cut2.select(F.col("source").alias("s"), F.col("bin").alias("bin2"), F.col("rest").alias("left"))

    # what shares 24 bits with the cut is summed row by row; rows equal in key, id and size go together
    near = rows.join(broadcast_if_small(c2), same & (second == F.col("bin2")))
    near = near.groupBy("source", _place().alias("place"), "left").agg(F.sum("size").alias("words"), F.count("*").alias("copies"))
    order = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0))).where("before < left")
    part = F.floor(F.least(F.col("words").cast("double"), F.round(F.col("left") - F.col("before"))) / F.col("copies"))
    edge = near.groupBy("source").agg(F.max(F.struct("place", part.cast("long").alias("part"))).alias("edge"))
    cut = c2.join(edge.withColumnRenamed("source", "es"), F.col("s").eqNullSafe(F.col("es")))
    cut = broadcast_if_small(materialize(cut.select(F.col("s").alias("cs"), "bin2", "edge")))

    out = rows.join(small, same, "left").join(cut, F.col("source").eqNullSafe(F.col("cs")), "left")
    whole = (second < F.col("bin2")) | (_place() < F.col("edge.place"))
    extra = F.when(whole, F.col("size")).when(_place() == F.col("edge.place"), F.col("edge.part")).otherwise(F.lit(0))
    taken = F.col("size") * F.col("passes") + extra
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *carry)
