"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the hashes of its five-word shingles, and its sketch the ``k`` smallest of
them. Documents with equal sets form a class, and only classes are compared. Inverted lists of
retained values generate overlaps: two sets at the threshold share so many retained values, but for
a chance below 1e-8, that they also meet in the list of one of the rarest values of each sketch (as
many as may be missing, and one), and only these are listed. That keeps passages that many
documents share out of the lists.

Small sketches of all classes tell which classes meet any other at all; these get larger sketches,
which are listed again and give the pairs. Lists are not expanded into all pairs: first each class is
compared with the smallest class of the lists, then only classes outside a list's most common
component with the classes of other components there, and only if their sizes and what is left of
their lists allow the threshold. Of each pair the ``k`` smallest values of the union of both sketches
estimate the similarity; pairs whose estimate is too low by chance but for 1e-8 go, and the full sets
decide about the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.llm.common import beside, broadcast_if_small, discard, join_spread, materialize, small_batches
from graincart.llm.components import components
from graincart.llm.hashing import shingle_set, spaced_words

SHINGLE = 5
#: Values in the small sketches of all classes, and in those of classes that meet others.
RETAINED, RETAINED_AGAIN = 48, 256
CHANCE = 1e-8
#: Hashes that a Python task holds before it hands rows on.
HELD = 500_000


def least_share(k: int, threshold: float, chance: float = CHANCE) -> float:
    """The share of k draws that hits with probability ``threshold`` stay above, but for ``chance``."""
    low, high = 0.0, threshold
    for _ in range(60):
        f = (low + high) / 2
        bound = f * math.log(f / threshold) + (1 - f) * math.log((1 - f) / (1 - threshold))
        low, high = (f, high) if k * bound > -math.log(chance) else (low, f)
    return low


def _set(text: str | None) -> tuple[np.ndarray, str | None]:
    """The sorted set of a text and its name."""
    found = np.sort(shingle_set(spaced_words(text), SHINGLE).view(np.int64))
    return found, xxhash.xxh3_128_hexdigest(found.tobytes()) if len(found) else None


def _sketches(texts: list[str | None], k: int) -> list:
    return list(zip(*[(len(found), name, found[:k].copy()) for found, name in map(_set, texts)], strict=True)) or [(), (), ()]


def _sets(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Sketch and rest of the sets that have the name which is wanted of their row."""
    names = ["node", "n", "sketch", "rest"]
    for batch in batches:
        out, held = [], 0
        for node, wanted, text in zip(batch["node"], batch["name"], batch["text"], strict=True):
            found, name = _set(text)
            if name == wanted:
                out.append((node, len(found), found[:k], found[k:] if len(found) > k else None))
                held += len(found)
            if held > HELD:
                yield pd.DataFrame(out, columns=names)
                out, held = [], 0
        yield pd.DataFrame(out, columns=names)


def _rarest(sets: DataFrame, total: int) -> DataFrame:
    """(node, n, need, left, value): the values by which a node of ``sets`` (node, n, need, values) is listed.

    They are the rarest, one more than may be missing if ``need`` of the values are shared; ``left``
    is how many values come from there on. Values that no other node has come first, cannot meet
    and are only counted. ``total`` bounds the number of values of all nodes.
    """
    each = sets.select("node", F.explode("values").alias("value"))
    shared = materialize(each.groupBy("value").agg(F.count("*").alias("rows")).where("rows > 1"))
    met = join_spread(each, shared.withColumnRenamed("rows", "df"), "value", shared, total)
    met = met.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("met"))
    sized = sets.select("node", "n", "need", F.size("values").alias("held"))
    out = met.hint("merge").join(sized, "node").withColumn("alone", F.col("held") - F.size("met"))
    listed = F.slice("met", 1, F.greatest(F.col("held") - F.col("need") + 1 - F.col("alone"), F.lit(0)))
    out = out.select("node", "n", "need", F.size("met").alias("meets"), F.posexplode(listed).alias("at", "entry"))
    out = materialize(out.select("node", "n", "need", (F.col("meets") - F.col("at")).alias("left"), F.col("entry.value").alias("value")))
    discard(shared)
    return out


def _with_least(lists: DataFrame, total: int) -> DataFrame:
    """The entries of lists with two nodes or more, with the smallest node of the list (lo) and its size."""
    ends = lists.groupBy("value").agg(F.min(F.struct("node", F.col("n").alias("m"))).alias("lo"), F.max("node").alias("hi"), F.count("*").alias("rows"))
    ends = materialize(ends.where("lo.node < hi").select("value", F.col("lo.node").alias("lo"), F.col("lo.m").alias("m"), "rows"))
    out = materialize(join_spread(lists, ends.drop("rows"), "value", ends.select("value", "rows"), total).select("value", "node", "n", "need", "left", "lo", "m"))
    discard(ends)
    return out


def _sizes(n: str, m: str, percent: int) -> Column:
    return 100 * F.least(F.col(n), F.col(m)) >= percent * F.greatest(F.col(n), F.col(m))


def _by_hub(entries: DataFrame, percent: int) -> DataFrame:
    """For each node the smallest node of a list, that of most lists if there are several."""
    near = entries.where("node <> lo").where(_sizes("n", "m", percent))
    counts = near.groupBy("node", "lo").agg(F.count("*").alias("lists"))
    best = counts.groupBy("node").agg(F.max(F.struct("lists", -F.col("lo"))).alias("best"))
    return materialize(best.select((-F.col("best")["col2"]).alias("a"), F.col("node").alias("b")))


def _across(entries: DataFrame, parts: DataFrame, percent: int, k: int, total: int) -> DataFrame:
    """The pairs of nodes of a list that are in different components and can reach the threshold."""
    marked = entries.drop("lo", "m").join(parts.withColumnRenamed("component", "part").hint("merge"), "node", "left")
    marked = materialize(marked.withColumn("part", F.coalesce("part", "node")))
    main = marked.groupBy("value", "part").agg(F.count("*").alias("nodes"))
    main = main.groupBy("value").agg(F.count("*").alias("parts"), F.max(F.struct("nodes", "part")).alias("main"), F.sum("nodes").alias("rows")).where("parts > 1")
    main = materialize(main.select("value", F.col("main.part").alias("main"), "rows"))
    full = join_spread(marked, main.drop("rows"), "value", main.select("value", "rows"), total)
    # what a node is listed by before, so that a pair is met only at the first value that the two share
    listed = entries.groupBy("node").agg(F.collect_list(F.struct("left", "value")).alias("listed"))
    earlier = F.transform(F.filter("listed", lambda x: x["left"] > F.col("left")), lambda x: x["value"])
    full = materialize(full.join(listed.hint("merge"), "node").withColumn("earlier", earlier).drop("listed"))
    discard(marked)
    other = full.where("part <> main").select("value", *[F.col(c).alias(f"{c}_x") for c in ("node", "n", "need", "left", "part", "earlier")])
    # a pair of two others is met from both sides, and counts once
    once = (F.col("part") != F.col("part_x")) & ((F.col("part") == F.col("main")) | (F.col("node") < F.col("node_x")))
    # no more can be shared than is left of either list at the first value that the two share
    both = F.least("left", "left_x")
    reach = (both >= F.greatest("need", "need_x")) & ((F.greatest("n", "n_x") > k) | (100 * both >= percent * (F.col("n") + F.col("n_x") - both)))
    first = ~F.arrays_overlap("earlier", "earlier_x")
    pairs = join_spread(full, other, "value", main.select("value", "rows"), full.count()).where(once & _sizes("n", "n_x", percent) & reach & first)
    pairs = materialize(pairs.select(F.least("node", "node_x").alias("a"), F.greatest("node", "node_x").alias("b")).distinct())
    discard(full, main)
    return pairs


def _links(pairs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    total = pairs.count()
    often = materialize(pairs.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("rows")))

    def beside(left: DataFrame, kept: list[Column]) -> DataFrame:
        side = lambda c: sets.select(F.col("node").alias(c), F.struct("n", *kept).alias(f"of_{c}"))
        # b once for each pair, a perhaps in very many
        out = left.join(side("b").hint("merge"), "b")
        return join_spread(out, side("a"), "a", often.withColumnRenamed("node", "a"), total)

    x, y = F.col("of_a.sketch"), F.col("of_b.sketch")
    both = F.size(F.array_intersect(x, y))
    whole = F.greatest("of_a.n", "of_b.n") <= k
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, k)
    estimate = F.size(F.array_intersect(union, F.array_intersect(x, y))) / F.size(union)
    exact = lambda shared: 100 * shared >= percent * (F.col("of_a.n") + F.col("of_b.n") - shared)
    may = F.when(whole, exact(both)).otherwise(estimate >= least_share(k, percent / 100))
    close = materialize(beside(pairs, [F.col("sketch")]).where(may).select("a", "b", whole.alias("whole")))
    # sketches of small sets are the sets, so that their estimate is exact; of others the rest is read too
    full = lambda c: F.concat(F.col(f"of_{c}.sketch"), F.coalesce(F.col(f"of_{c}.rest"), F.array().cast("array<long>")))
    again = beside(close.where("not whole").select("a", "b"), [F.col("sketch"), F.col("rest")]).where(exact(F.size(F.array_intersect(full("a"), full("b")))))
    out = materialize(close.where("whole").select("a", "b").union(again.select("a", "b")))
    discard(pairs, often, close)
    return out


def _classes(rows: DataFrame) -> DataFrame:
    """name, id, node, first_id, copies, n and values for each distinct set.

    The node is the smallest id, or where two classes have the same a hash of the name.
    """
    met = rows.where("n_shingles > 0").groupBy("name")
    found = met.agg(F.min("id").alias("id"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("sketch").alias("values"))
    found = materialize(found.withColumn("node", F.col("id")))
    twice = found.groupBy("id").agg(F.count("*").alias("classes")).where("classes > 1").select("id", F.lit(True).alias("twice"))
    if not twice.limit(1).count():
        return found
    twice = materialize(twice)
    named = found.drop("node").join(broadcast_if_small(twice), "id", "left")
    out = materialize(named.withColumn("node", F.when(F.col("twice"), F.xxhash64("name")).otherwise(F.col("id"))).drop("twice"))
    discard(found, twice)
    return out


def _full_sets(docs: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """(node, n, sketch, rest) of the classes in ``near`` (id, name, node), one row each."""
    texts = docs.select("id", "text").join(broadcast_if_small(near), "id").select("node", "name", "text")
    sets = materialize(texts.mapInPandas(lambda batches: _sets(batches, k), "node long, n long, sketch array<long>, rest array<long>"))
    if not sets.groupBy("node").count().where("count > 1").limit(1).count():
        return sets
    once = materialize(sets.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("rest").alias("rest")))
    discard(sets)
    return once


def _linked(docs: DataFrame, classes: DataFrame, percent: int, k: int, k_again: int) -> DataFrame:
    """(node, component) of the classes that are linked with another."""
    threshold = percent / 100
    need = F.ceil(least_share(k, threshold) * F.least("n", F.lit(k))).cast("int")
    lists = _rarest(classes.select("node", "n", need.alias("need"), "values"), classes.count() * k)
    met = _with_least(lists, lists.count())
    near = materialize(classes.select("id", "name", "node").join(met.select("node").distinct().hint("merge"), "node", "left_semi"))
    discard(lists, met)
    sets = _full_sets(docs, near, k_again)
    discard(near)

    # a set so small that all its partners are whole must share its part of the threshold itself
    least = F.when(100 * F.col("n") <= percent * k_again, percent * F.col("n") / 100).otherwise(least_share(k_again, threshold) * F.size("sketch"))
    lists = _rarest(sets.select("node", "n", F.ceil(least).cast("int").alias("need"), F.col("sketch").alias("values")), sets.count() * k_again)
    total = lists.count()
    entries = _with_least(lists, total)
    discard(lists)
    first = _links(_by_hub(entries, percent), sets, percent, k_again)
    parts = components(first)
    second = _links(_across(entries, parts, percent, k_again, total), sets, percent, k_again)
    discard(parts, entries, sets)
    parts = components(first.union(second))
    discard(first, second)
    return parts


def near_duplicates(docs: DataFrame, percent: int = 85, carry: tuple[str, ...] = (), k: int = RETAINED, k_again: int = RETAINED_AGAIN) -> DataFrame:
    """doc_id, the columns of ``carry``, n_shingles, component_id, kept and group for each row of ``docs`` (doc_id, text).

    Documents are linked if 100 * intersection >= percent * union of their sets of five-word
    shingles. Null texts and texts without words have an empty set, are linked with nothing and
    are their own component. A text of fewer than five words has its whole sequence as its one
    shingle. component_id is the smallest doc_id of the component; rows without doc_id take part,
    but their component_id is null if no row of the component has one, and then, as for any row
    without doc_id, kept says whether component_id is null too. Repeated rows share their result.
    Rows of different texts that share a doc_id are documents of their own, linked only if their
    texts are; ``group`` is one number for each component, and null for an empty set. Texts of any
    length are compared whole. An empty table gives an empty result; other columns of ``docs`` are
    ignored.
    """
    small_batches(docs.sparkSession)
    named = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("id"), "text", *carry)
    rows = beside(named, ("text",), ("doc_id", "id", *carry), lambda texts: _sketches(texts, k), {"n_shingles": "long", "name": "string", "sketch": "array<long>"})
    rows = materialize(rows)
    classes = _classes(rows)
    parts = _linked(named, classes, percent, k, k_again)
    roots = parts.select(F.col("component").alias("node"), "component").distinct()

    # classes that have copies or links; the name of a component is its smallest node, which is the smallest doc_id but where ids are null or repeated
    found = materialize(classes.select("name", "id", "node", "first_id", "copies").join(parts.union(roots).hint("merge"), "node", "left").where("copies > 1 or component is not null or node <> id"))
    found = found.withColumn("part", F.coalesce("component", "node"))
    least = found.groupBy("part").agg(F.min("first_id").alias("component_id")).where("not part <=> component_id").withColumn("other", F.lit(True))
    least = materialize(least)
    joined = found.join(broadcast_if_small(least), "part", "left").withColumn("component_id", F.when(F.col("other"), F.col("component_id")).otherwise(F.col("part")))
    joined = materialize(joined.select("name", F.col("part").alias("_part_of"), "component_id", F.col("copies").alias("rows")))
    discard(found, least, parts)

    # a name that meets nothing for rows of empty sets, as all nulls would go to one task
    key = F.coalesce("name", F.xxhash64("id", "doc_id").cast("string"))
    rows = rows.select("doc_id", "id", *carry, "n_shingles", key.alias("name"))
    out = join_spread(rows, joined.drop("rows"), "name", joined.select("name", "rows"), rows.count(), "left")
    linked = F.col("_part_of").isNotNull()
    own = F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).cast(docs.schema["doc_id"].dataType)
    group = F.when(linked, F.col("_part_of")).when(F.col("n_shingles") > 0, F.col("id"))
    out = out.select("doc_id", *carry, "n_shingles", own.alias("component_id"), group.alias("group"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", *carry, "n_shingles", "component_id", "kept", "group")
