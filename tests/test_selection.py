"""Quantiles by selection and prefix sums by ranges, against sorted lists."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graincart.operators import checks, metrics, quantiles, training
from graincart.operators.running import running_sums

ODD = [0.0, -0.0, 1.0, -1.0, 0.1, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1e-300, 3.0, 4.0, 8.0, 0.9999999999999999, 2.0000000000000004, math.inf, -math.inf, math.nan]


def test_bins_keep_the_order(spark):
    rng = np.random.default_rng(0)
    some = np.frombuffer(rng.bytes(8 * 3000), np.float64)
    values = ODD + [float(x) for x in some if x == x] + [2.0**k for k in range(-1074, 1024)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1024, 7)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)] + [(-1, None)], "i long, x double")
    out = {r["i"]: r["k"] for r in df.select("i", quantiles.ordered_bin(F.col("x")).alias("k")).collect()}
    assert out.pop(-1) is None and out[0] == out[1] == 0
    order = sorted(range(len(values)), key=lambda i: (values[i] != values[i], values[i]))
    assert all(out[a] <= out[b] for a, b in zip(order, order[1:], strict=False)) and len(set(out.values())) > 3000


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_are_exact(spark, seed, monkeypatch):
    # with few rows left to be counted one by one, bins are counted again and again
    monkeypatch.setattr(quantiles, "EXACT_ROWS", [2_000_000, 3, 0][seed])
    monkeypatch.setattr(quantiles, "BINS", [4096, 4, 64][seed])
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in (("a", 700), ("b", 1), (None, 2), ("c", 90)):
        for i in range(n):
            y = float(rng.choice([rng.normal() * 10.0 ** rng.integers(-8, 8), float(rng.integers(-3, 4)), 0.0]))
            rows.append((g, y if i % 5 or g == "b" else None, int(rng.integers(0, 10**6)), float(rng.normal())))
    df = spark.createDataFrame(rows, "g string, y double, z long, w double")
    shares = [0.0, 0.013, 0.25, 0.5, 0.75, 0.9, 1.0]
    out = quantiles.quantiles(df, {"y": F.col("y"), "z": F.col("z"), "none": F.lit(None).cast("double")}, shares, by=["g"]).collect()
    assert len(out) == 8
    for r in out:
        values = [x["yz".index(r["column"]) + 1] for x in rows if x[0] == r["g"]]
        values = [float(v) for v in values if v is not None]
        assert r["n"] == len(values) and np.allclose(r["values"], np.quantile(values, shares), rtol=1e-12, atol=0)


def test_quantiles_of_little(spark):
    df = spark.createDataFrame([], "y double")
    assert quantiles.quantiles(df, {"y": F.col("y")}, [0.5]).count() == 0
    assert quantiles.medians(spark.createDataFrame([(math.nan,), (1.0,), (math.inf,)], "y double"), {"y": F.col("y")}) == {"y": math.inf}
    assert quantiles.medians(spark.createDataFrame([(5.0,)] * 3000, "y double"), {"y": F.col("y")}) == {"y": 5.0}
    one = metrics.regression(spark.createDataFrame([(None, 1.0)], "t double, p double"), "t", "p").collect()
    assert len(one) == 1 and one[0]["median_ae"] is None


def test_no_buffer_of_all_values(spark):
    """The plans hold no percentile and no collected list of values."""
    df = spark.range(1000).select((F.col("id") * 1.37).alias("y"))
    plans = []
    real = quantiles.tables.written
    quantiles.tables.written = lambda t: plans.append(t._jdf.queryExecution().toString()) or real(t)
    try:
        quantiles.quantiles(df, {"y": F.col("y")}, [0.1, 0.5])
    finally:
        quantiles.tables.written = real
    assert len(plans) > 2 and not any("percentile" in p for p in plans) and not any("collect_list" in p for p in plans[:-1])


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_within_groups(spark, descending):
    rng = np.random.default_rng(4)
    rows = [(g, float(x), int(rng.integers(0, 5))) for g in ("a", "b", None) for x in rng.choice(1000, 120, replace=False)]
    out = running_sums(spark.createDataFrame(rows, "g string, x double, n long").repartition(7), "x", {"upto": "n"}, descending, ("g",), totals=True).collect()
    assert len(out) == len(rows)
    for r in out:
        same = [(x, n) for g, x, n in rows if g == r["g"]]
        assert r["upto"] == sum(n for x, n in same if (x >= r["x"] if descending else x <= r["x"])) and r["total_upto"] == sum(n for _, n in same)
    assert running_sums(spark.createDataFrame([], "x double, n long"), "x", {"s": "n"}).count() == 0


def brute_auc(y, s):
    p, q = [a for a, t in zip(s, y, strict=True) if t], [a for a, t in zip(s, y, strict=True) if not t]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q)) if p and q else None


def test_one_vs_rest_equals_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(str(rng.choice(["a", "b", "c"])) if i % 9 else None, *(float(x) for x in rng.integers(0, 12, 4))) for i in range(300)]
    df = spark.createDataFrame(rows, "t string, a double, b double, c double, d double")
    out = {r["class"]: r for r in metrics.one_vs_rest(df, "t", {k: F.col(k) for k in "abcd"}).collect()}
    for i, k in enumerate("abcd"):
        wanted = brute_auc([r[0] == k for r in rows], [r[i + 1] for r in rows])
        assert out[k]["auc"] == (pytest.approx(wanted) if wanted is not None else None)
    told = metrics.macro(metrics.one_vs_rest(df, "t", {k: F.col(k) for k in "abc"})).first()
    assert told["classes"] == 3 and told["auc_macro"] == pytest.approx(np.mean([out[k]["auc"] for k in "abc"]))
    assert metrics.macro(metrics.one_vs_rest(df, "t", {k: F.col(k) for k in "abcd"})).first()["auc_macro"] is None
    curves = metrics.roc_points(metrics.against_rest(df, "t", {k: F.col(k) for k in "abcd"}), F.col("truth"), "score", ("class",))
    ends = {r["class"]: r["n"] for r in curves.groupBy("class").agg(F.count("*").alias("n")).collect()}
    assert ends["d"] == 2 and all(ends[k] > 8 for k in "abc")


def test_leak_list(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "yes" if i % 3 else "no", float(i % 3), float(rng.integers(0, 5)), None if i % 2 else 1.0, 2.0 * i + 1) for i in range(120)]
    df = spark.createDataFrame(rows, "i long, y string, told double, noise double, gaps double, line double")
    names = {n: (f"from_{n}", F.col(n)) for n in ("told", "noise", "gaps")}
    out = {r["feature"]: r for r in checks.leaks(df, names, "y", "classification").collect()}
    assert out["told"]["score"] == 1.0 and out["told"]["warn"] and out["told"]["column"] == "from_told"
    for n, at in (("noise", 3), ("gaps", 4)):
        known = [(r[at], r[1]) for r in rows if r[at] is not None]
        best = max(
            max(sum(y == c for x, y in known if x <= cut) for c in ("yes", "no")) + max([sum(y == c for x, y in known if x > cut) for c in ("yes", "no")]) for cut in {x for x, _ in known} | {-1.0}
        )
        assert out[n]["score"] == pytest.approx(best / len(known)) and not out[n]["warn"]
    out = {r["feature"]: r for r in checks.leaks(df, names | {"line": ("line", F.col("line"))}, "i", "regression").collect()}
    assert out["line"]["score"] == pytest.approx(1.0) and out["line"]["warn"] and out["gaps"]["score"] == 0.0
    many = df.withColumn("y", F.col("i").cast("string"))
    assert checks.leaks(many, names, "y", "classification").count() == 0
    assert checks.leaks(df.limit(0), names, "y", "classification").count() == 0


def test_findings_of_a_setup(spark):
    rows = [(i, float(i % 4), "x" if i % 4 == 1 else "y", f"t{i % 4}", "x" if i % 4 == 1 else "y", 0.9) for i in range(80)]
    df = spark.createDataFrame(rows, "i long, n double, sort string, word string, sort__fine string, sort__confidence double")
    s = training.setup(df, "sort", ["i"], unreviewed=F.col("i") % 10 == 0)
    out = {r["kind"]: r for r in training.findings(s).collect()}
    assert set(out) == {"class_imbalance", "train_test_duplicates", "target_leakage", "unreviewed_labels", "label_sibling_exclusion"}
    assert out["train_test_duplicates"]["raised"] and out["target_leakage"]["severity"] == "warning" and "word" in out["target_leakage"]["message"]
    assert out["unreviewed_labels"]["severity"] == "info" and out["label_sibling_exclusion"]["raised"] and not out["class_imbalance"]["raised"]
