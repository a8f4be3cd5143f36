"""The corpus pipeline: language, near copies, benchmark passages, secrets, mix.

Every stage takes (spark, docs, sf_dir) and returns a table with the columns of its ``docs``; the
last one returns the mix. Other columns than doc_id, text, lang, source and n_chars pass through
the first four stages untouched, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincart.llm.common import broadcast_if_small, discard, join_spread, materialize, table, with_rest
from graincart.llm.decontamination import contamination
from graincart.llm.langid import identify, learn
from graincart.llm.minhash import near_duplicates
from graincart.llm.mixing import mix
from graincart.llm.secrets import redact_secrets

#: The similarity of near copies in per cent.
SIMILAR = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is certain; null texts and texts without letters go.

    The model learns from the rows of ``docs`` itself; without any labelled row all go.
    """
    model = learn(docs)
    return with_rest(docs, lambda d, rest: identify(d, model, ("text", *rest)).where("accepted"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id; ties go by a hash of the text.

    A row without doc_id goes by a hash of its text. Rows equal in doc_id and text are one
    document; rows of different texts that share a doc_id are documents of their own. Texts without
    words are copies of nothing and stay.
    """
    named = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    known = docs.select(named.alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    found = materialize(near_duplicates(known, percent=SIMILAR, carry=("text_hash",)).where("group is not null"))
    first = found.groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    first = materialize(first)
    gone = join_spread(found, first.drop("rows"), "group", first.select("group", "rows"), found.count()).where("doc_id <> first.doc_id or text_hash <> first.text_hash")
    gone = materialize(gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).distinct())
    twice = found.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    discard(found, first)

    def work(d: DataFrame, rest: tuple[str, ...]) -> DataFrame:
        d = d.withColumn("_id", named).withColumn("_text", F.xxhash64("text"))
        d = d.join(broadcast_if_small(gone), ["_id", "_text"], "left_anti")
        return d.dropDuplicates(["_id", "_text"]) if twice else d

    return with_rest(docs, work)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that repeat no window of words of a benchmark item; null texts stay."""
    items = table(spark, sf_dir, "benchmark")
    return with_rest(docs, lambda d, rest: contamination(d, items, carry=("text", *rest)).where("not contaminated"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret; n_chars follows a text that changed."""
    size, stated = docs.schema["n_chars"].dataType, docs.columns.index("n_chars")

    def work(d: DataFrame, rest: tuple[str, ...]) -> DataFrame:
        n_chars = next(c for c in rest if c == f"_rest{stated}")
        out = redact_secrets(d.withColumn("_before", F.length("text")))
        return out.withColumn(n_chars, F.when(F.length("text") != F.col("_before"), F.length("text").cast(size)).otherwise(F.col(n_chars)))

    return with_rest(docs, work)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their sizes, their sources' targets and the words that the mix takes."""
    out = mix(docs, carry=("text", "lang", "n_chars"))
    return out.select("doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken")


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("secrets", secrets),
    ("mixing", mixing),
]
#: SQL has no trained language model: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
