"""Training data: deterministic splits and features fitted on the training rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincart import tables
from graincart.functions.text import ngrams, tokens
from graincart.operators.quantiles import medians


def held_out_count(n: Column, share: float) -> Column:
    """Rows of a class to hold out: the rounded share, but one at least, and one fewer than all at most; none of one."""
    take = F.greatest(F.lit(1), F.least(F.bround(n * F.lit(float(share))), n - 1))
    return F.when(n > 1, take).otherwise(F.lit(0)).cast("long")


def split(df: DataFrame, key: list[str], share: float, seed: int, stratum: str | None = None) -> DataFrame:
    """``df`` with ``split`` (train or test): in each class the rows with the smallest hash of seed and key are held out.

    Only keys, hashes and classes are ordered. Classes are cut by their counts in bins of the
    hash, so that no class is sorted as one group.
    """
    name = F.col(stratum) if stratum else F.lit("all")
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    rows = df.withColumn("_class", name).withColumn("_digest", digest).withColumn("_bin", F.substring("_digest", 1, 3))
    bins = rows.groupBy("_class", "_bin").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_class")
    bins = bins.withColumn("_total", F.sum("_n").over(w)).withColumn("_before", F.sum("_n").over(w.orderBy("_bin")) - F.col("_n"))
    bins = bins.withColumn("_take", held_out_count(F.col("_total"), share)).select("_class", "_bin", "_n", "_before", "_take")
    cut = bins.where((F.col("_before") < F.col("_take")) & (F.col("_before") + F.col("_n") > F.col("_take")))
    # only the bin that holds the cut is ranked
    order = Window.partitionBy("_class", "_bin").orderBy("_digest", *key)
    ranked = rows.join(cut.select("_class", "_bin"), ["_class", "_bin"], "left_semi")
    ranked = ranked.select(*key, "_class", "_bin", F.row_number().over(order).alias("_rank"))
    out = rows.join(bins, ["_class", "_bin"], "left").join(ranked, [*key, "_class", "_bin"], "left")
    test = F.col("_before") + F.coalesce("_rank", F.col("_n")) <= F.col("_take")
    return out.withColumn("split", F.when(test, "test").otherwise("train")).drop("_class", "_digest", "_bin", "_n", "_before", "_take", "_rank")


def imputed_and_scaled(df: DataFrame, column: str, is_train: Column) -> DataFrame:
    """``df`` with ``<column>_scaled``: the training median for what is missing, then z-scores with the training mean and population deviation."""
    x = F.col(column).cast("double")
    middle = medians(df, {column: F.when(is_train, x)}).get(column, 0.0)
    filled = df.withColumn("_x", F.coalesce(x, F.lit(middle)))
    scale = filled.agg(F.avg(F.when(is_train, F.col("_x"))).alias("_mean"), F.stddev_pop(F.when(is_train, F.col("_x"))).alias("_std"))
    scaled = (F.col("_x") - F.col("_mean")) / F.when(F.col("_std") == 0, 1.0).otherwise(F.col("_std"))
    return filled.crossJoin(F.broadcast(scale)).withColumn(f"{column}_scaled", scaled).drop("_x", "_mean", "_std")


def one_hot(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """A 0/1 column for each fitted category and one for what is missing; unseen values are all zero."""
    flags = {f"{column}={c}": F.coalesce((F.col(column) == c), F.lit(False)).cast("double") for c in categories}
    return df.withColumns(flags | {f"{column}=__missing__": F.col(column).isNull().cast("double")})


def epoch_seconds(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp")) / 1e6


def grams(column: str, low: int, high: int) -> Column:
    """The runs of ``low`` to ``high`` words of a text, in lower case; none of a null."""
    return ngrams(tokens(F.coalesce(F.col(column).cast("string"), F.lit(""))), low, high)


def _rows_with(found: DataFrame) -> DataFrame:
    return found.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(df: DataFrame, column: str, terms: int = 2000, least: int = 1, low: int = 1, high: int = 1) -> DataFrame:
    """(term, df): the ``terms`` terms that most rows have, of those that ``least`` rows have; ties by name.

    A run is in no more rows than the shorter runs in it. So the shortest runs are counted first, and
    longer ones only where the first and last of theirs are in as many rows as the last of the ``terms``
    that most rows have: nearly all longer runs are rare, and are not counted.
    """
    each = lambda a, b: df.select(F.explode(F.array_distinct(grams(column, a, b))).alias("term"))
    first = lambda counted: counted.where(F.col("df") >= least).orderBy(F.desc("df"), "term").limit(terms)
    if low == high:
        return first(_rows_with(each(low, low)))
    short = tables.written(_rows_with(each(low, low)).where(F.col("df") >= least))
    last = first(short).agg(F.count("*").alias("n"), F.min("df").alias("df")).first()
    # ties of the last one too: a run of such may come before it by name
    common = tables.written(short.where(F.col("df") >= (last["df"] if last["n"] == terms else least)))
    tables.drop(short)
    longer, known = each(low + 1, high), common.select(F.col("term").alias("_part"))
    # if it is more than a broadcast may have, they tie with a few rows each and would leave little out
    if common.limit(tables.BROADCAST_ROWS + 1).count() <= tables.BROADCAST_ROWS:
        for at in (low, -low):
            longer = longer.withColumn("_part", F.substring_index("term", " ", at)).join(F.broadcast(known), "_part", "left_semi").drop("_part")
    return first(common.unionByName(_rows_with(longer)))


def tfidf(df: DataFrame, key: str, text: str, is_train: Column, terms: int = 2000, least: int = 1, low: int = 1, high: int = 1) -> DataFrame:
    """(key, term, weight): shares of terms in all terms of a row, times ln((1+N)/(1+df)) + 1 of the training rows, normed to 1.

    Terms are runs of ``low`` to ``high`` words; see ``vocabulary``. A vocabulary of more rows than a
    broadcast may have is joined by a shuffle.
    """
    # texts are dealt out by key, however few parts their file has, and what a text has is counted and normed where it is
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text"), is_train.alias("train")).repartition("key")
    known = tables.written(vocabulary(texts.where("train"), "text", terms, least, low, high))
    # behind an explode of one element the words are made once for both their number and their rows
    rows = texts.select("key", F.explode(F.array(grams("text", 1, 1))).alias("words"))
    number = sum((F.greatest(F.size("words") - n + 1, F.lit(0)) for n in range(low, high + 1)), F.lit(0))
    # a run past the end is null and meets no term
    run = lambda n: F.concat_ws(" ", *[F.get("words", F.col("at") + i) for i in range(n)])
    runs = F.array(*[F.when(F.col("at") + n <= F.size("words"), run(n)) for n in range(low, high + 1)])
    counts = rows.select("key", "words", number.alias("total"), F.posexplode("words").alias("at", "word")).select("key", "total", F.explode(runs).alias("term"))
    total = df.agg(F.count_if(is_train).alias("rows"))
    found = counts.join(tables.small(known), "term").groupBy("key", "total", "term", "df").agg(F.count("*").alias("n"))
    # one row
    raw = F.col("n") / F.col("total") * (F.ln((1 + F.col("rows")) / (1 + F.col("df"))) + 1)
    weighed = found.crossJoin(F.broadcast(total)).select("key", "term", raw.alias("raw"))
    # at most as many rows as the vocabulary has
    norm = F.sqrt(F.sum(F.col("raw") ** 2).over(Window.partitionBy("key")))
    return weighed.select("key", "term", (F.col("raw") / norm).alias("weight"))


def task_type(df: DataFrame, column: str, kind: str) -> DataFrame:
    """One row: classification or regression, by kind and number of distinct values."""
    x = F.col(column)
    facts = df.where(x.isNotNull()).agg(F.count("*").alias("n"), F.count_distinct(x).alias("d"), *([F.bool_and(x.cast("double") == F.floor(x.cast("double"))).alias("whole")] if kind in ("integer", "number") else []))
    if kind not in ("integer", "number"):
        return facts.select(F.lit(column).alias("column"), F.lit("classification").alias("task"))
    many = (F.col("d") > 20) | (F.col("d") > F.greatest(F.lit(2), F.floor(F.col("n") / 2)))
    few = F.lit("classification") if kind == "integer" else F.when(F.col("whole"), "classification").otherwise("regression")
    return facts.select(F.lit(column).alias("column"), F.when(many, "regression").otherwise(few).alias("task"))
