"""Setups, fitted features, runs over models, places, deletion and reports of groups."""

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from graincart.operators import checks, metrics, models, training
from graincart.operators.running import places
from graincart.sources.versions import Store


@pytest.fixture
def rows(spark):
    made = [(i, float(i % 2) + i / 1000, "a b c".split()[i % 3], i % 2 == 0, None if i == 5 else "yes" if i % 2 else "no") for i in range(60)]
    return spark.createDataFrame(made, "id long, x double, c string, flag boolean, y string").cache()


def test_setup_drops_rows_and_says_why(rows):
    s = training.setup(rows, "y", ["id"], excluded=("flag",), unreviewed=F.col("id") == 7)
    assert s.task == "classification" and s.features == {"x": "number", "c": "categorical"} and s.reasons["flag"] == "user"
    assert s.counts == {"given": 60, "without_target": 1, "unreviewed": 1, "rows": 58, "train": 46, "test": 12, "classes": 2}
    assert training.plan(s, ["naive_bayes", "linear_regression", "oracle"]) == {"naive_bayes": None, "linear_regression": "does not do classification", "oracle": "unknown model"}
    digest = training.split_digest(s.rows, ["id"])
    assert training.same_split(training.setup(rows.orderBy(F.desc("x")), "y", ["id"], unreviewed=F.col("id") == 7).rows, digest, ["id"])
    assert not training.same_split(training.setup(rows, "y", ["id"], seed=1, unreviewed=F.col("id") == 7).rows, digest, ["id"])


def test_setup_refuses(rows):
    for df, target, what in ((rows, "z", "no column"), (rows.where("y = 'yes'"), "y", "one class"), (rows.limit(0), "y", "two rows"), (rows.select("id", "y"), "y", "no features"), (rows.withColumn("split", F.lit(1)), "y", "split")):
        with pytest.raises(training.NotTrainable, match=what):
            training.setup(df, target, ["id"])


def test_features_fill_scale_and_name(spark, monkeypatch):
    df = spark.createDataFrame([(1.0, "b", True, "t"), (None, None, None, "t"), (3.0, "a", False, "t"), (float("nan"), "b", True, "t"), (float("inf"), "b", True, "t")], "n double, c string, f boolean, t string")
    kinds = {"n": "number", "c": "categorical", "f": "bool", "t": "text"}
    spec, reasons = training.fit_spec(df, kinds)
    assert reasons == {} and spec.names == ["n", "c=a", "c=b", "c=__missing__", "f", "tfidf:t=t"]
    assert training.Spec.from_json(spec.to_json()) == spec
    with pytest.raises(ValueError, match="format"):
        training.Spec.from_json(spec.to_json().replace('"format": 2', '"format": 9'))
    n = spec.features[0]
    assert (n.median, n.mean) == (2.0, 2.0) and n.std == pytest.approx(0.4**0.5)
    other = spark.createDataFrame([(None, "new", None, "t")], df.schema)
    assert tuple(spec.encoded(other, []).first())[:5] == (0.0, 0.0, 0.0, 0.0, 0.0)
    monkeypatch.setattr(training, "MOST_CATEGORIES", 2)
    assert training.fit_spec(df, kinds)[1] == {"c": "too many categories"}


def test_run_isolates_failures_and_resumes(rows, tmp_path, monkeypatch):
    s, path = training.setup(rows, "y", ["id"]), str(tmp_path / "run")
    found = {r["model"]: r for r in training.run(s, ["naive_bayes", "random_forest", "linear_regression"], path, {"random_forest": {"trees": -1}}).collect()}
    assert found["naive_bayes"]["rank"] == 1 and found["naive_bayes"]["metrics"]["accuracy"] == 1.0
    assert found["random_forest"]["status"] == "failed" and found["random_forest"]["error"]
    assert found["linear_regression"]["error"] == "does not do classification"
    fitted, fit = [], models.fit
    monkeypatch.setattr(models, "fit", lambda df, name, *a, **o: fitted.append(name) or fit(df, name, *a, **o))
    again = {r["model"]: r["status"] for r in training.run(s, ["naive_bayes", "random_forest"], path, {"random_forest": {"trees": 3}}).collect()}
    assert fitted == ["random_forest"] and again == {"naive_bayes": "ok", "random_forest": "ok"}


def test_places_and_folds(spark, rows):
    at = places(rows, "s", ["id"], ["c"], each=7)
    for c in "abc":
        assert sorted(r["_at"] for r in at.where(F.col("c") == c).collect()) == list(range(20))
    assert places(rows.limit(0), "s", ["id"]).count() == 0
    assert sorted(r["_at"] for r in places(rows.select(F.lit(None).cast("string").alias("k"), "id"), "s", ["k"], each=7).collect()) == list(range(60))
    labelled = rows.where("y is not null").withColumn("_label", (F.col("y") == "yes").cast("double"))
    measure = MulticlassClassificationEvaluator(labelCol="_label", metricName="accuracy")
    found = models.tune(labelled, "logistic_regression", "classification", ["x"], {"regParam": [0.0, 100.0]}, measure, ["id"])
    assert found.avgMetrics[0] == 1.0
    with pytest.raises(ValueError, match="too few"):
        models.tune(labelled.limit(5), "logistic_regression", "classification", ["x"], {}, measure, ["id"])
    score = lambda df: df.agg(F.avg((F.round("x") == (F.col("id") % 2)).cast("double"))).first()[0]
    lost = models.permutation_importance(rows, score, ["x", "c"], "id")
    assert lost["x"] > 0.2 and lost["c"] == 0


def test_deleted_projects(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path))
    gone, kept = store.create("a", rows), store.create("b", rows)
    assert store.delete("a") == 1 and store.delete("a") == 0
    assert [r["version_id"] for r in store.versions().collect()] == [kept] and store.load(kept).count() == 60
    assert not (tmp_path / "data" / gone).exists()


def test_groups_without_rows_have_reasons(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "g string")
    scores = spark.createDataFrame([("a", 2, 0.5), (None, 1, 1.0)], "group string, n long, accuracy double")
    found = {r["group"]: tuple(r)[1:] for r in metrics.group_report(df, "g", scores, 2).collect()}
    assert found == {"a": (2, 2, None, 0.5), "b": (1, 0, "no held-out rows", None), None: (1, 1, "fewer than 2 held-out rows", None)}


def test_fairness_run_and_checks(spark, rows):
    whole = rows.withColumn("g", F.when(F.col("id") < 50, "a").when(F.col("id") < 59, "b").otherwise("c"))
    s = training.setup(rows, "y", ["id"], excluded=("flag",))
    report, gaps = training.fairness_run(s, "naive_bayes", whole, "g")
    found = {r["group"]: r for r in report.collect()}
    assert {g: r["rows"] for g, r in found.items()} == {"a": 50, "b": 9, "c": 1} and sum(r["n"] for r in found.values()) == s.counts["test"]
    assert all(r["accuracy"] == 1.0 if r["n"] else r["reason"] for r in found.values())
    assert {r["metric"]: r["exceeds"] for r in gaps.collect()}["accuracy"] is False
    told = spark.createDataFrame([("tpr", True), ("fpr", False)], "metric string, exceeds boolean")
    assert {tuple(r) for r in training.fairness_checks(told, "m", "g", True).collect()} == {("fairness_tpr", "warning", "m"), ("feature_g", "info", "m")}


def test_fairness_of_regressions(spark, rows):
    made = rows.select("id", "x", (F.col("x") * 100 + F.when(F.col("id") % 3 == 0, 40).otherwise(0)).alias("t"), (F.col("id") % 3).cast("string").alias("g"))
    s = training.setup(made.drop("g"), "t", ["id"])
    _, gaps = training.fairness_run(s, "linear_regression", made, "g")
    r = gaps.first()
    assert s.task == "regression" and r["highest"] == "0" and r["relative"] > 0.1 and r["exceeds"]


def test_bundles(spark, rows, tmp_path):
    s = training.setup(rows, "y", ["id"])
    spec, _ = training.fit_spec(s.rows.where("split = 'train'"), s.features)
    model = models.fit(spec.encoded(s.rows, ["y", "split"]), "naive_bayes", "classification", spec.inputs, "y")
    training.write_bundle(str(tmp_path), s, spec, model, "# card", {"api_key": "abc"})
    again, same, files = training.read_bundle(spark, str(tmp_path))
    assert same == spec and files["model_card.md"] == "# card" and '"abc"' not in files["metadata.json"]
    told = models.predict(again, same.encoded(rows.where("y is not null"), ["y"]), same.inputs)
    assert told.where("y <> predicted").count() == 0


def test_stumps_equal_a_loop(spark):
    made = [(i, float(v), y) for i, (v, y) in enumerate(zip([3, 1, 1, 2, 2, 2, 3, 5, 5, 1], "aabbacbbca", strict=True))] + [(98, None, "a"), (99, 1.0, None)]
    df = spark.createDataFrame(made, "id long, v double, y string")
    labels = [y for _, _, y in sorted((v, i, y) for i, v, y in made if v is not None and y)]
    most = lambda ys: max(map(ys.count, set(ys)), default=0)
    assert checks.stump_accuracy(df, "v", "y", ["id"]).first()[0] == max(most(labels[:k]) + most(labels[k:]) for k in range(11)) / 10
    ends = [k for k in range(11) if k in (0, 3, 6, 8, 10)]
    assert checks.stump_accuracy_by_value(df, "v", "y").first()[0] == max(most(labels[:k]) + most(labels[k:]) for k in ends) / 10
    assert checks.stump_accuracy(df.limit(0), "v", "y", ["id"]).first()[0] is None
    assert checks.stump_accuracy_by_value(spark.range(60).selectExpr("double(id) AS v", "id AS y"), "v", "y").first()[0] is None
