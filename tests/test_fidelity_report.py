"""The fidelity report, and tests of all columns at once."""

import random

import pytest
from pyspark.sql import functions as F

from graincart.operators import cards, fidelity


def sides(spark, n=300):
    rng = random.Random(0)
    rows = [(i, i % 2 == 0, rng.gauss(0, 1), rng.gauss(3 if i % 2 else 0, 1), rng.choice("abc")) for i in range(n)]
    return spark.createDataFrame(rows, "i long, s boolean, x double, y double, c string")


def test_all_columns_at_once_equal_each(spark):
    df = sides(spark)
    told = {r["column"]: r for r in fidelity.ks_of_all(df, {c: F.col(c) for c in ("x", "y")}, F.col("s")).collect()}
    for c in ("x", "y"):
        one = fidelity.ks_statistic(df, c, F.col("s")).first()
        assert told[c]["statistic"] == pytest.approx(one["statistic"]) and told[c]["p_value"] == pytest.approx(one["p_value"])
    all_, one = fidelity.chi_square_of_all(df, ["c"], F.col("s")).first(), fidelity.chi_square(df, "c", F.col("s")).first()
    assert all_["statistic"] == pytest.approx(one["statistic"]) and all_["dof"] == one["dof"] and all_["p_value"] == pytest.approx(one["p_value"])


def test_thresholds_of_near_copies():
    assert fidelity.near_threshold(10_000, 1) == pytest.approx(0.000005) and fidelity.near_threshold(10_000, 2) == pytest.approx(0.0005)
    assert fidelity.near_threshold(100, 0) == 0.0 == fidelity.near_threshold(0, 3)


def test_dense_numbers_are_no_near_copies(spark):
    rng = random.Random(1)
    rows = [(i, i < 2000, round(rng.random(), 9)) for i in range(4000)]
    df = spark.createDataFrame([*rows, (9999, False, rows[7][2])], "i long, s boolean, x double")
    told = {r["measure"]: r for r in fidelity.report(df, F.col("s"), ["x"], [], ["i"]).collect()}
    # at 0.05 every row would be one
    assert 1 <= told["near_copies"]["value"] < 250 and told["near_copies"]["bound"] == pytest.approx(0.05 / 2000)


def test_report_warns(spark):
    df = sides(spark)
    out = fidelity.report(df, F.col("s"), ["x", "y"], ["c"], ["i"], {"c": {"a": 0.5, "z": 0.5}}, dropped=40, asked=190, from_profile=True)
    told = {(r["measure"], r["column"]): r for r in out.collect()}
    assert told["ks", "y"]["warning"] == "fidelity_drift" and told["ks", "x"]["warning"] is None
    assert told["made:z", "c"]["value"] == 0 and told["wanted:z", "c"]["value"] == 0.5
    assert fidelity.report_warnings(out) == ["derived_profile", "dropped_rows_high", "fidelity_drift"]
    none = fidelity.report(df.limit(0), F.col("s"), ["x"], ["c"], ["i"])
    assert fidelity.report_warnings(none) == []


def test_secret_values_at_any_depth():
    deep = {"token": "x"}
    for _ in range(5000):
        deep = {"a": [deep]}
    out = cards.without_secret_values({"keep": (1, None, "sk-abcdefghijk and api_key=hunter22"), 7: {"Password": [1, 2]}, "deep": deep})
    assert out["keep"] == [1, None, "[REDACTED] and [REDACTED]"] and out["7"] == {"Password": "[REDACTED]"}
    at = out["deep"]
    for _ in range(5000):
        at = at["a"][0]
    assert at == {"token": "[REDACTED]"}
