"""Models of the library's own: network, neighbours and kernel machines, on fixtures with known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from graincart.operators import kernel, models, neighbours, network


@pytest.mark.parametrize(
    ("options", "told"),
    [
        ({"hidden": []}, "hidden"), ({"hidden": "64"}, "hidden"), ({"hidden": [3, 0]}, r"hidden\[1\]"), ({"learning_rate": "fast"}, "learning_rate"), ({"learning_rate": math.nan}, "learning_rate"),
        ({"dropout": 1.0}, "dropout"), ({"epochs": 2.5}, "epochs"), ({"batch_size": True}, "batch_size"), ({"validation_fraction": 1}, "validation_fraction"), ({"early_stopping": 1}, "early_stopping"), ({"width": 3}, "width"),
    ],
)
def test_options_are_refused_with_a_reason(options, told):
    with pytest.raises(network.BadOptions, match=told):
        network.checked(options)


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    for classes, out in ((3, 3), (0, 1)):
        sizes = [4, 5, out]
        theta = network.start(sizes, 1) + 0.1
        x, y = rng.normal(size=(7, 4)), rng.integers(0, 3, 7).astype(float)
        g = network.gradient(theta, sizes, x, y, classes, 0.0, None)
        for i in rng.choice(len(theta), 12):
            step = np.zeros(len(theta))
            step[i] = 1e-6
            slope = (network.losses(theta + step, sizes, x, y, classes).mean() - network.losses(theta - step, sizes, x, y, classes).mean()) / 2e-6
            assert g[i] == pytest.approx(slope, rel=1e-4, abs=1e-7)


def test_network_learns_xor(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), "same" if (a > 0) == (b > 0) else "other", "test" if i % 5 == 0 else "train") for i, (a, b) in enumerate(rng.uniform(-1, 1, (600, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, y string, split string")
    model = models.fit(df, "mlp", "classification", ["a", "b"], "y", hidden=[16, 8], epochs=40, learning_rate=0.01, batch_size=16, patience=12)
    out = models.predict(model, df.where("split = 'test'"), ["a", "b"])
    assert out.agg(F.avg((F.col("y") == F.col("predicted")).cast("double"))).first()[0] > 0.93
    assert out.where("abs(probability_same + probability_other - 1) > 1e-6").count() == 0
    told = model.stages[-1].told()
    kept = told["epochs"][told["kept_epoch"]]
    assert kept["validation_loss"] == min(e["validation_loss"] for e in told["epochs"]) and told["ran"] <= 40
    model.write().overwrite().save(str(tmp_path / "m"))
    again = models.predict(PipelineModel.load(str(tmp_path / "m")), df.where("split = 'test'"), ["a", "b"])
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_network_learns_a_number(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), 300 + 50 * abs(float(a)), "train") for a in rng.uniform(-1, 1, 400)]
    df = spark.createDataFrame(rows, "a double, y double, split string")
    model = models.fit(df, "mlp", "regression", ["a"], "y", hidden=[16], epochs=30, learning_rate=0.02)
    worst = models.predict(model, df, ["a"]).agg(F.avg(F.abs(F.col("y") - F.col("predicted")))).first()[0]
    assert worst < 3
    with pytest.raises(network.BadOptions, match="learning_rate"):
        models.fit(df, "mlp", "regression", ["a"], "y", hidden=[8], epochs=8, learning_rate=1e200)


def test_rows_kept_apart_are_of_all_classes(spark):
    from pyspark.ml.feature import VectorAssembler

    rows = [(float(i), float(i % 10 == 0)) for i in range(1000)]
    df = VectorAssembler(inputCols=["x"], outputCol="f").transform(spark.createDataFrame(rows, "x double, y double"))
    apart = []
    for r in network.packed(df, "f", "y", True, network.Options()).collect():
        apart += np.frombuffer(r["y"], float)[: r["kept_apart"]].tolist()
    assert sum(apart) == 15 and len(apart) == 150


@pytest.mark.parametrize("seed", range(2))
def test_neighbours_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 20)
    monkeypatch.setattr(neighbours, "SPLIT_ROWS", 30)
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(400, 3)).round(1) * [1, 5, 0.1]
    x[:130] = x[0]
    labels = [int(v) for v in rng.integers(0, 3, 400)]
    train = spark.createDataFrame([(i, v.tolist(), y) for i, (v, y) in enumerate(zip(x, labels, strict=True))] + [(999, None, 0)], "i long, v array<double>, y int")
    out = models.nearest_neighbours(train, train.where("i % 10 = 0"), "v", "i", 7).collect()
    for q in range(0, 400, 10):
        gaps = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        wanted = sorted((round(g, 9), i) for i, g in enumerate(gaps) if i != q)[:7]
        assert sorted((round(r["distance"], 9), r["neighbour"]) for r in out if r["query"] == q) == wanted
    # votes of distances that do not tie
    asked = rng.normal(size=(60, 3)) * [1, 5, 0.1]
    df = spark.createDataFrame([(*v.tolist(), y, "train") for v, y in zip(x, labels, strict=True)], "a double, b double, c double, y int, split string")
    more = spark.createDataFrame([(i, *v.tolist()) for i, v in enumerate(asked)], "i long, a double, b double, c double")
    told = {r["i"]: r for r in models.predict(models.fit(df, "knn", "classification", ["a", "b", "c"], "y", k=5), more, ["a", "b", "c"]).collect()}
    means = {r["i"]: r["predicted"] for r in models.predict(models.fit(df, "knn", "regression", ["a", "b", "c"], "y", k=5), more, ["a", "b", "c"]).collect()}
    for i, q in enumerate(asked):
        gaps = np.sqrt(((x - q) ** 2).sum(axis=1))
        order = np.argsort(gaps, kind="stable")
        if gaps[order[5]] - gaps[order[4]] < 1e-9:
            continue
        near = [labels[j] for j in order[:5]]
        votes = [near.count(c) for c in range(3)]
        assert told[i]["predicted"] == str(votes.index(max(votes))) and told[i]["probability_0"] == votes[0] / 5
        assert means[i] == pytest.approx(np.mean(near))


def test_neighbours_look_into_few_cells(spark, monkeypatch):
    """Cells that the triangle inequality excludes are not read."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 50)
    rng = np.random.default_rng(0)
    centres = rng.uniform(-100, 100, (20, 2))
    x = np.concatenate([c + rng.normal(size=(100, 2)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    met = []
    real = neighbours._met
    monkeypatch.setattr(neighbours, "_met", lambda index, asked: met.append(asked.count()) or real(index, asked))
    assert models.nearest_neighbours(df, df.where("i % 50 = 0"), "v", "i", 5).count() == 200
    assert sum(met) < 40 * 12


def test_kernel_error_is_within_its_bound():
    rng = np.random.default_rng(0)
    x, gamma = rng.normal(size=(120, 6)), 0.2
    z = kernel.fourier(x, kernel.projections(6, kernel.pairs_for(0.15, 0.01), gamma, 3))
    wanted = np.exp(-gamma * ((x[:, None] - x) ** 2).sum(axis=2))
    assert (np.abs(z @ z.T - wanted) > 0.15).mean() <= 0.01 and np.allclose((z * z).sum(axis=1), 1)
    assert kernel.pairs_for(0.05) > 8 * kernel.pairs_for(0.15)


def test_kernel_machine_tells_rings(spark, tmp_path):
    rng = np.random.default_rng(0)
    angles, far = rng.uniform(0, 2 * math.pi, 300), np.where(np.arange(300) % 2, 1.0, 3.0) + rng.normal(0, 0.2, 300)
    rows = [(float(r * math.cos(a)), float(r * math.sin(a)), "in" if i % 2 else "out", "test" if i % 7 == 0 else "train") for i, (a, r) in enumerate(zip(angles, far, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, y string, split string")
    right = lambda o: models.predict(models.fit(df, "svm", "classification", ["a", "b"], "y", **o), df.where("split = 'test'"), ["a", "b"]).agg(F.avg((F.col("y") == F.col("predicted")).cast("double"))).first()[0]
    assert right({"C": 10.0}) > 0.95 and right({"kernel": "linear"}) < 0.75
    with pytest.raises(ValueError, match="kernel"):
        right({"kernel": "cubic"})
    with pytest.raises(ValueError, match="no option"):
        right({"degree": 3})


def test_support_vector_regression(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-3, 3, 300)
    y = np.sin(x) + np.where(np.arange(300) % 29 == 0, 5.0, 0.0)
    df = spark.createDataFrame([(float(a), float(b), "train") for a, b in zip(x, y, strict=True)], "a double, y double, split string")
    model = models.fit(df, "svm", "regression", ["a"], "y", C=10.0, epsilon=0.05, gamma=0.5)
    told = np.array([r["predicted"] for r in models.predict(model, df, ["a"]).collect()])
    # rows far off pull no more than others
    assert np.median(np.abs(told - np.sin(x))) < 0.08
    falls = model.stages[-1].getOrDefault("objectives")
    assert all(b <= a * (1 + 1e-9) for a, b in zip(falls, falls[1:], strict=False)) and len(falls) > 3


def test_neighbours_meet_in_groups(spark, monkeypatch):
    """A query goes to groups of cells, not to each cell: what is shuffled does not grow with queries times cells."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 10)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    met = []
    real = neighbours._met
    monkeypatch.setattr(neighbours, "_met", lambda search, asked: met.append(asked.count()) or real(search, asked))
    out = models.nearest_neighbours(df, df.where("i % 30 = 0"), "v", "i", 5).collect()
    # 60 cells, of which none is excluded in 24 dimensions, are one group
    assert sum(met) <= 2 * 20
    for q in range(0, 600, 30):
        gaps = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert sorted((round(r["distance"], 9), r["neighbour"]) for r in out if r["query"] == q) == sorted((round(g, 9), i) for i, g in enumerate(gaps) if i != q)[:5]


def test_kernel_features_are_made_few_rows_at_a_time(spark):
    """The memory of a task does not follow its batch of inputs."""
    x = np.random.default_rng(0).normal(size=(3000, 2))
    wanted = kernel.fourier(x, kernel.projections(2, 20, 0.5, 1))
    made = list(kernel.features(iter([pd.Series(list(x[:2900])), pd.Series([], dtype=object), pd.Series(list(x[2900:]))]), 20, 0.5, 1))
    assert max(map(len, made)) <= kernel.AT_ONCE and np.allclose(np.concatenate([np.stack(m) for m in made]), wanted)
    model = kernel.RandomFourierModel()
    model._set(gamma=0.5, pairs=20, seed=1, inputCol="x", outputCol="z")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, x array<double>").coalesce(1).select("i", array_to_vector("x").alias("x"))
    out = model.transform(df).select("i", vector_to_array("z").alias("z")).collect()
    assert np.allclose(np.array([r["z"] for r in sorted(out, key=lambda r: r["i"])]), wanted)
