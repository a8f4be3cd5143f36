"""Benchmark decontamination by winnowing.

A text's fingerprints are the least hashes of its k-grams of words in each window of ``w`` k-grams,
so that any two texts that share k + w - 1 words in a row share a fingerprint of them. Fingerprints
of documents are joined with those of benchmark items; a joint fingerprint gives an alignment of
the two texts, along which the words themselves are compared. Runs of equal words as long as a
window are hits.

Items shorter than a window are windows of their own; for each length that occurs among them,
documents are fingerprinted by all k-grams of that length.

Everything on this path is a DataFrame function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincart.llm.common import broadcast_if_small, lower_ascii, materialize, text_key

#: What stands between words; the second before A-Z are made lower case.
BETWEEN, BETWEEN_ANY = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 5
#: A fingerprint is a hash above, and the place of its k-gram in the lowest bits.
PLACE_BITS = 28


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), BETWEEN), "")


def _grams(listed: Column, k: int, w: int) -> Column:
    """array<long>: hash and place of each k-gram of an array of words; null if it has less than a window."""
    gram = lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.slice(listed, i, k)), PLACE_BITS + 1), PLACE_BITS) + i
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.size(listed) - k + 1, F.lit(1))), gram)
    return F.when(F.size(listed) >= k + w - 1, some)


def _winnow(grams: Column, w: int) -> Column:
    """The least of each window of ``w`` k-grams."""
    least = lambda i: F.array_min(F.slice(grams, i, w))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(grams) - w + 1, F.lit(1))), least))


def _marks(texts: DataFrame, key: str, k: int, w: int) -> DataFrame:
    """(key, hash, place) of the fingerprints of ``texts`` (key, words)."""
    some = texts.where(F.size("words") >= k + w - 1).select(key, _grams(F.col("words"), k, w).alias("grams"))
    # explode_outer: Spark would push explode's test for emptiness below the k-grams, and compute them in each window
    some = some.select(key, F.explode_outer(_winnow(F.col("grams"), w) if w > 1 else F.col("grams")).alias("mark")).where("mark is not null")
    return some.select(key, F.shiftright("mark", PLACE_BITS).alias("hash"), F.col("mark").bitwiseAND(2**PLACE_BITS - 1).cast("int").alias("place"))


def _runs(equal: Column, least: Column) -> Column:
    """array<struct<start, end>> of the runs of 1 in a string of 0 and 1 that are ``least`` long or more."""
    runs = F.regexp_extract_all(equal, F.lit("1+"), F.lit(0))
    gaps = F.split(equal, "1+", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(state: Column, piece: Column) -> Column:
        begin = state["at"] + F.length(piece["gap"])
        end = begin + F.coalesce(F.length(piece["run"]), F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(end - begin >= least, F.array_append(state["found"], span)).otherwise(state["found"]).alias("found"))

    return F.aggregate(F.arrays_zip(gaps.alias("gap"), runs.alias("run")), start, step)["found"]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``carry``, n_words, n_hit, items (array of item_id) and contaminated for each row of ``docs``.

    A document word is hit if it stands in an occurrence of ``window`` consecutive words of an
    item, or of a whole item of fewer words. Null texts and texts without words have no hits, and
    items without words are never found; an empty benchmark hits nothing. Repeated rows of
    ``docs`` have equal results; items that repeat an item_id count once in ``items``, and all items
    without an id as one, which stands there as a null: n_items counts it, items_sha256 has no name
    for it. An empty
    table gives an empty result. Other columns of either table are ignored.
    """
    key = F.md5("text").alias("key")
    items = materialize(benchmark.where("text is not null").select("item_id", words(F.col("text")).alias("item_words")).where("size(item_words) > 0").distinct())
    items = items.withColumn("item", F.xxhash64("item_id", "item_words"))
    short = sorted(r[0] for r in items.where(F.size("item_words") < window).select(F.size("item_words")).distinct().limit(window).collect())
    # of equal texts each is looked at: to find them first would move all texts
    texts = docs.where("text is not null").select(key, words(F.col("text")).alias("words"))
    met = None
    for length, gram, w in [(window, k, window - k + 1), *((n, n, 1) for n in short)]:
        same = items.where(F.size("item_words") >= window if length == window else F.size("item_words") == length)
        same = same.select("item", F.col("item_words").alias("words"))
        wanted = materialize(_marks(same, "item", gram, w).select("hash", "item", F.col("place").alias("item_place")))
        found = _marks(texts, "key", gram, w).join(broadcast_if_small(wanted), "hash")
        found = found.select("key", "item", (F.col("place") - F.col("item_place")).alias("shift"))
        met = found if met is None else met.union(found)
    met = materialize(met.distinct())

    # the words of the document along each alignment, compared with those of the item
    sizes = items.select("item", "item_id", "item_words")
    spots = met.join(broadcast_if_small(sizes.select("item", F.size("item_words").alias("n"))), "item")
    spots = materialize(spots.groupBy("key").agg(F.collect_list(F.struct("item", "shift", "n")).alias("spots")))
    first = lambda s: F.greatest(s["shift"], F.lit(0))
    hits = docs.where("text is not null").select(key, "text").join(broadcast_if_small(spots.select("key", "spots")), "key")
    hits = hits.dropDuplicates(["key"]).select("key", words(F.col("text")).alias("words"), "spots")
    part = lambda s: F.struct(s["item"].alias("item"), s["shift"].alias("shift"), F.slice("words", first(s) + 1, s["n"]).alias("part"))
    hits = hits.select("key", F.explode_outer(F.transform("spots", part)).alias("spot")).select("key", "spot.*")
    hits = hits.join(broadcast_if_small(sizes), "item")
    # where the item begins before the document, its first words are passed by
    skip = F.greatest(-F.col("shift"), F.lit(0))
    equal = F.zip_with(F.slice("item_words", skip + 1, F.size("item_words")), "part", lambda a, b: F.when(a == b, "1").otherwise("0"))
    hits = hits.select("key", "item_id", F.greatest("shift", F.lit(0)).alias("at"), _runs(F.array_join(equal, ""), F.least(F.size("item_words"), F.lit(window))).alias("runs"))
    hits = hits.select("key", "item_id", "at", F.explode("runs").alias("run"))
    hits = hits.select("key", "item_id", (F.col("at") + F.col("run.start")).alias("start"), (F.col("at") + F.col("run.end")).alias("end"))
    # spans of a text that overlap count their words once
    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    hits = hits.withColumn("new", new).groupBy("key").agg(F.sum("new").alias("n_hit"), F.transform(F.collect_set(F.struct("item_id")), lambda x: x["item_id"]).alias("items"))
    hits = broadcast_if_small(materialize(hits))

    rows = docs.select("doc_id", *carry, F.coalesce(F.size(F.array_remove(F.split("text", BETWEEN_ANY), "")), F.lit(0)).cast("long").alias("n_words"), text_key(F.col("doc_id"), F.col("text")).alias("key"))
    rows = rows.join(hits, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    nothing = F.array().cast(f"array<{benchmark.schema['item_id'].dataType.simpleString()}>")
    return rows.select("doc_id", *carry, "n_words", n_hit.alias("n_hit"), F.coalesce("items", nothing).alias("items"), (n_hit > 0).alias("contaminated"))


def contamination_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of ``docs``; see ``contamination``."""
    found = contamination(docs, benchmark)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")
