"""Work that must spread over tasks and hold little, whatever the files of a table are."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graincart import tables
from graincart.functions import text
from graincart.operators import generate, labeling, pool, prep, profile
from graincart.operators.schema import ColumnSpec


def test_fast_answers_are_handed_on_together():
    now = [0.0]
    held = pool.Held(10, clock=lambda: now[0])
    assert not held.enough(9) and not held.enough(10) and held.enough(pool.MOST)
    now[0] = pool.HELD
    assert not held.enough(9) and held.enough(10) and not held.enough(10)


def test_labelling_is_dealt_out(spark):
    df = spark.range(200).coalesce(1).select(F.col("id").alias("__row_id__"), F.col("id").alias("a"))
    out = labeling.label_rows(df, lambda s: {"n": len(s)}, ["a"], "n bigint").withColumn("p", F.spark_partition_id())
    assert out.agg(F.count_distinct("p")).first()[0] > 1 and out.select("__row_id__").distinct().count() == 200


def test_batches_are_dealt_out(spark, monkeypatch):
    found = []
    real = generate._asked
    monkeypatch.setattr(generate, "_asked", lambda numbers, *a: found.append(numbers.rdd.getNumPartitions()) or real(numbers, *a))
    out = generate.generated(spark, [ColumnSpec("a", "integer", 0, 9)], 95, generate.fake_generator, batch=10)
    assert min(found) > 1 and out.count == 95 and sorted(r["__row_id__"] for r in out.rows.collect()) == list(range(95))


def test_kinds_hold_few_values_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(profile, "EACH", 50)
    df = spark.range(1000).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 3).cast("string").alias("few"), F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0).alias("zero"), F.lit(None).cast("string").alias("none"))
    assert {r["column"]: r["kind"] for r in profile.kinds(df, df.columns).collect()} == {"id": "integer", "name": "text", "few": "integer", "zero": "number", "none": "text"}
    counted = {r["column"]: r["distinct_values"] for r in profile.distinct_counts(df, df.columns).collect()}
    assert counted == {"id": 1000, "name": 1000, "few": 3, "zero": 1, "none": 0}
    facts = {r["column"]: (r["n"], r["distinct_values"], r["numbers"], r["whole"]) for r in profile.kind_facts(df, ["name", "few"]).collect()}
    assert facts == {"name": (1000, 1000, 0, 0), "few": (1000, 3, 1000, 1000)}
    # 1000 rows are 21 parts
    assert profile.distinct_counts(df, ["name"])._jdf.queryExecution().toString().count("REPARTITION_BY_NUM") >= 2


def _runs(body, low, high):
    words = (body or "").split()
    return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def test_rare_runs_are_not_counted(spark, monkeypatch):
    # each row has 20 words and 20 runs of its own beside one run that all have
    df = spark.createDataFrame([(i, "all of " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(50)], "id long, body string")
    counted, real = [], type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *by: (counted.append(self.where("term LIKE '% %'").count()) if by == ("term",) else None) or real(self, *by))
    found = prep.vocabulary(df, "body", terms=2, high=2)
    assert [tuple(r) for r in found.collect()] == [("all", 50), ("all of", 50)] and sum(counted) == 50


def test_texts_are_dealt_out(spark, monkeypatch):
    df, seen, real = spark.range(200).coalesce(1).select("id", F.lit("a b a").alias("body")), [], prep.vocabulary
    monkeypatch.setattr(prep, "vocabulary", lambda train, *a: seen.append(train._jdf.queryExecution().toString()) or real(train, *a))
    assert prep.tfidf(df, "id", "body", F.col("id") % 5 != 0, high=2).count() == 800 and "REPARTITION_BY_COL" in seen[0]


@pytest.mark.parametrize(("terms", "least", "low", "high", "broadcast"), [(5, 1, 1, 2, 200_000), (12, 1, 1, 3, 200_000), (12, 1, 1, 3, 3), (40, 1, 2, 3, 200_000), (7, 3, 1, 2, 200_000), (10_000, 2, 1, 3, 200_000), (3, 99, 1, 2, 200_000)])
def test_runs_are_counted_as_by_hand(spark, monkeypatch, terms, least, low, high, broadcast):
    monkeypatch.setattr(tables, "BROADCAST_ROWS", broadcast)
    draw = random.Random(terms + high)
    bodies = [None, "", "a", "a a a", "b a"] + [" ".join(draw.choices("abcdefghij", [9, 9, 5, 5, 3, 2, 2, 1, 1, 1], k=draw.randrange(1, 9))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    train = [b for i, b in enumerate(bodies) if i % 5]
    rows = Counter(t for b in train for t in set(_runs(b, low, high)))
    best = sorted(((t, n) for t, n in rows.items() if n >= least), key=lambda x: (-x[1], x[0]))[:terms]
    is_train = F.col("id") % 5 != 0
    assert [tuple(r) for r in prep.vocabulary(df.where(is_train), "body", terms, least, low, high).collect()] == best
    wanted = {}
    for i, b in enumerate(bodies):
        runs = _runs(b, low, high)
        raw = {t: runs.count(t) / len(runs) * (math.log((1 + len(train)) / (1 + n)) + 1) for t, n in best if t in runs}
        wanted |= {(i, t): x / math.sqrt(sum(y * y for y in raw.values())) for t, x in raw.items()}
    out = {(r["key"], r["term"]): r["weight"] for r in prep.tfidf(df, "id", "body", is_train, terms, least, low, high).collect()}
    assert out == pytest.approx(wanted)


def test_short_texts_have_no_runs(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],), (["a", "b"],), (["a"],), ([],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(text.ngrams(F.col("w"), 1, 3)).collect()] == [["a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d"], ["a", "b", "a b"], ["a"], [], None]
    assert [r[0] for r in df.select(text.ngrams(F.col("w"), 3, 3)).collect()] == [["a b c", "b c d"], [], [], [], None]
