"""Text columns as features: terms, weights, JSON, leaks and a model."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from graincart.operators import models, training

WORDS = ["red", "blue", "green", "car", "boat", "sky", "late", "soon"]


def rows_of(n=120):
    rng = np.random.default_rng(0)
    out = []
    for i in range(n):
        words = [str(w) for w in rng.choice(WORDS[:6], 6)] + (["late"] if i % 2 else ["soon"])
        out.append((i, None if i % 17 == 0 else " ".join(rng.permutation(words)).title() + "!", float(rng.integers(0, 9)), "yes" if i % 2 else "no"))
    return out


@pytest.mark.parametrize("grams", [(1, 1), (1, 2)])
def test_weights_are_those_of_counts(spark, grams):
    rows = rows_of(40)
    df = spark.createDataFrame(rows, "i long, t string, n double, y string")
    spec, reasons = training.fit_spec(df.where("i < 30"), {"t": "text", "n": "number"}, terms=25, least=2, grams=grams)
    spec = training.Spec.from_json(spec.to_json())
    split = lambda t: [w.lower() for w in t.rstrip("!").split()] if t else []
    of = lambda t: [" ".join(split(t)[j : j + k]) for k in range(grams[0], grams[1] + 1) for j in range(len(split(t)) - k + 1)]
    seen = Counter(g for i, t, *_ in rows if i < 30 for g in set(of(t)))
    terms = sorted(sorted((t for t, c in seen.items() if c >= 2), key=lambda t: (-seen[t], t))[:25])
    assert not reasons and spec.names == [f"tfidf:t={t}" for t in terms] + ["n"] and spec.inputs == ["_text0", "_x1_0"] and {s for _, s in spec.sources} == {"t", "n"}
    out = {r["i"]: r["v"] for r in spec.encoded(df, ["i"]).select("i", vector_to_array("_text0").alias("v")).collect()}
    for i, t, *_ in rows:
        counts = Counter(of(t))
        w = np.array([counts[g] * (math.log(31 / (1 + seen[g])) + 1) for g in terms])
        assert np.allclose(out[i], w / (np.linalg.norm(w) or 1))


def test_a_model_learns_from_text(spark):
    df = spark.createDataFrame(rows_of(), "i long, t string, n double, y string")
    s = training.setup(df, "y", ["i"])
    assert s.features == {"t": "text", "n": "number"} or s.features["t"] == "text"
    out = {r["model"]: r for r in training.run(s, ["logistic_regression"]).collect()}
    assert out["logistic_regression"]["status"] == "ok" and out["logistic_regression"]["metrics"]["accuracy"] > 0.85
    told = {r["feature"]: r for r in training.leak_list(s, least=0.9).collect()}
    assert told["tfidf:t=late"]["warn"] and told["tfidf:t=late"]["column"] == "t" and not told["tfidf:t=car"]["warn"] and not told["n"]["warn"]
    # the zeros are counted: the terms' scores are those of their dense columns
    spec, _ = training.fit_spec(s.rows.where("split = 'train'"), s.features)
    dense = spec.encoded(s.rows.where("split = 'train'"), ["y"]).withColumn("v", vector_to_array([c for c in spec.inputs if c.startswith("_text")][0]))
    terms = [n for n in spec.names if n.startswith("tfidf:")]
    again = training.checks.leaks(dense, {n: ("t", F.col("v")[i]) for i, n in enumerate(terms)}, "y", "classification", 0.9)
    assert {r["feature"]: round(r["score"], 9) for r in again.collect()} == {n: round(told[n]["score"], 9) for n in terms}


def test_term_leaks_of_a_number(spark):
    rows = [(i, "late now" if i % 3 == 0 else "soon now", 5.0 + (i % 3 == 0)) for i in range(30)]
    df = spark.createDataFrame(rows, "i long, t string, y double")
    spec, _ = training.fit_spec(df, {"t": "text"})
    encoded = spec.encoded(df, ["y"])
    told = training.checks.leaks(encoded.withColumn("c", F.lit(1.0)), {"c": ("c", F.col("c"))}, "y", "regression", terms=dict(spec.parts))
    out = {r["feature"]: r["score"] for r in told.collect()}
    assert out["tfidf:t=late"] == pytest.approx(1.0) and out["c"] == 0.0


def test_texts_without_terms_are_told(spark):
    df = spark.createDataFrame([(1, "!!", 1.0), (2, None, 2.0)], "i long, t string, n double")
    spec, reasons = training.fit_spec(df, {"t": "text", "n": "number"})
    assert reasons == {"t": "no terms"} and spec.names == ["n"]
    assert models.REGISTRY["svm"].tasks == ("classification", "regression")
