"""Runs that tune, resume and refuse another split."""

import json

import pytest
from pyspark.sql import functions as F

from graincart.operators import models, training


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float(i % 13), float((i * 7) % 11), "abc"[(i % 13) // 5]) for i in range(150)]
    return spark.createDataFrame(data, "id long, x double, z double, y string")


def test_run_tunes_and_measures_ranking(rows):
    s = training.setup(rows, "y", ["id"])
    out = {r["model"]: r for r in training.run(s, ["knn", "random_forest"], options={"random_forest": {"trees": 5, "depth": 4}}, grids={"knn": {"k": [1, 40]}}, folds=2).collect()}
    assert json.loads(out["knn"]["options"]) == {"k": 1} and json.loads(out["random_forest"]["options"]) == {"trees": 5, "depth": 4}
    assert all(r["status"] == "ok" and 0.5 < r["metrics"]["auc_macro"] <= 1 and r["metrics"]["average_precision_macro"] > 0.5 for r in out.values())


def test_search_tells_all_settings(rows):
    score = lambda scored: scored.agg(F.avg((F.col("y") == F.col("predicted")).cast("double"))).first()[0]
    best, told = models.search(rows, "knn", "classification", ["x", "z"], "y", {"k": [0, 3, 75]}, score, ["id"], folds=2)
    assert best == {"k": 3} and [o["k"] for o, _ in told] == [0, 3, 75] and told[0][1] != told[0][1]
    _, told = models.search(rows, "knn", "classification", ["x", "z"], "y", {"k": [1, 3, 5, 7]}, score, ["id"], folds=2, most=2)
    assert len(told) == 2
    for grid, df, what in (({"k": [0]}, rows, "finite"), ({"k": [1]}, rows.limit(3), "too few")):
        with pytest.raises(ValueError, match=what):
            models.search(df, "knn", "classification", ["x", "z"], "y", grid, score, ["id"], folds=2)


def test_a_resumed_run_refuses_another_split(rows, tmp_path):
    path = f"file://{tmp_path}/run"
    s = training.setup(rows, "y", ["id"])
    first = training.run(s, ["naive_bayes"], path)
    assert first.first()["status"] == "ok"
    again = {r["model"]: r for r in training.run(s, ["naive_bayes", "linear_regression"], path).collect()}
    assert again["naive_bayes"]["metrics"] == first.first()["metrics"] and again["linear_regression"]["status"] == "failed"
    with pytest.raises(training.NotTrainable, match="split otherwise"):
        training.run(training.setup(rows, "y", ["id"], seed=1), ["naive_bayes"], path)
