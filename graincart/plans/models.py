"""Model plans: fits on the training split, scored on the held-out rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from graincart.operators import metrics, models, neighbours, training
from graincart.plans.registry import query, table
from graincart.plans.training import split_labels

INPUTS = ["n", "marks", "lines"]


def _rows(spark, sf_dir):
    """Simple numbers of each labelled document with its class and split."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.ln(F.length("text") + 1).alias("n"),
        (F.regexp_count("text", F.lit(r"[|!#$%&*]")) / (F.length("text") + 1)).alias("marks"),
        (F.regexp_count("text", F.lit("\n")) / (F.length("text") + 1)).alias("lines"),
    )
    return docs.join(split_labels(spark, sf_dir).select("doc_id", "quality", "split"), "doc_id")


@query("mdl_fit")
def mdl_fit(spark, sf_dir):
    """Predictions of a logistic regression for the held-out rows."""
    rows = _rows(spark, sf_dir)
    model = models.fit(rows, "logistic_regression", "classification", INPUTS, "quality")
    out = models.predict(model, rows.where("split = 'test'"), INPUTS)
    return out.select("doc_id", "quality", "predicted", "probability_1")


@query("mdl_score")
def mdl_score(spark, sf_dir):
    return metrics.classification(mdl_fit(spark, sf_dir), "quality", "predicted")


@query("mdl_encode", "SELECT doc_id, CAST(quality AS DOUBLE) AS code FROM labels")
def mdl_encode(spark, sf_dir):
    df = table(spark, sf_dir, "labels").withColumn("y", F.col("quality").cast("string"))
    return models.encoder(df, "y").transform(df).select("doc_id", F.col(models.LABEL).alias("code"))


@query("mdl_encode_reg", "SELECT c_custkey, TRY_CAST(c_acctbal AS DOUBLE) AS y FROM customer")
def mdl_encode_reg(spark, sf_dir):
    return models.numeric_target(table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", F.col(models.LABEL).alias("y"))


_KNN = """WITH q AS (SELECT vec_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(q.v, e.embedding), lambda z: (z[1] - z[2])::DOUBLE * (z[1] - z[2])))) AS distance FROM q, embeddings e WHERE q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS k FROM p) SELECT query, neighbour, round(distance, 4) AS distance FROM r WHERE k <= 5"""


@query("mdl_knn", _KNN)
def mdl_knn(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    out = models.nearest_neighbours(df, df.where("vec_id % 100 = 0"), "embedding", "vec_id")
    return out.select("query", "neighbour", F.round("distance", 4).alias("distance"))


@query("mdl_knn_votes", _KNN.split("SELECT query, neighbour, round")[0] + """, v AS (SELECT query, label, count(*) AS n FROM r JOIN embeddings e ON e.vec_id = r.neighbour WHERE k <= 5 GROUP BY 1, 2)
SELECT query, arg_min(label, (-n, label)) AS predicted, max(n) / sum(n) AS share FROM v GROUP BY 1""")
def mdl_knn_votes(spark, sf_dir):
    """The class that most of the five nearest rows have, of those that tie the first, and its share of the votes."""
    df = table(spark, sf_dir, "embeddings")
    index = neighbours.build(df, ["vec_id", "label"], "embedding")
    found = neighbours.nearest(index, df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v")), 5, but="vec_id")
    votes = found.groupBy("query", F.col("content.label").alias("label")).agg(F.sum("n").alias("n"))
    return votes.groupBy("query").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("predicted"), (F.max("n") / F.sum("n")).alias("share"))


@query("mdl_mlp")
def mdl_mlp(spark, sf_dir):
    """Predictions of a small network for the held-out rows."""
    rows = _rows(spark, sf_dir)
    model = models.fit(rows, "mlp", "classification", INPUTS, "quality", hidden=[16], epochs=6, learning_rate=0.01)
    return models.predict(model, rows.where("split = 'test'"), INPUTS).select("doc_id", "quality", "predicted", "probability_1")


@query("mdl_svm")
def mdl_svm(spark, sf_dir):
    """Predictions of a kernel machine for the held-out rows."""
    rows = _rows(spark, sf_dir)
    model = models.fit(rows, "svm", "classification", INPUTS, "quality")
    return models.predict(model, rows.where("split = 'test'"), INPUTS).select("doc_id", "quality", "predicted")


@query("mdl_naive_bayes", "SELECT l_returnflag AS class, count(*) AS n, round(avg(l_quantity), 6) AS mean_l_quantity, round(var_pop(l_quantity), 6) AS var_l_quantity, round(avg(l_tax), 6) AS mean_l_tax, round(var_pop(l_tax), 6) AS var_l_tax FROM lineitem GROUP BY 1")
def mdl_naive_bayes(spark, sf_dir):
    out = models.gaussian_bayes(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], "l_returnflag")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


@query("mdl_linear", "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def mdl_linear(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("split", F.lit("train"))
    model = models.fit(df, "linear_regression", "regression", ["l_quantity"], "l_extendedprice").stages[-1]
    return spark.createDataFrame([(round(float(model.coefficients[0]), 3), round(float(model.intercept), 2))], "slope double, intercept double")


def _setup(spark, sf_dir):
    """Labelled documents, of which some lack the target and some wait for review."""
    rows = _rows(spark, sf_dir).drop("split").withColumn("quality", F.when(F.col("doc_id") % 7 != 0, F.col("quality")))
    return training.setup(rows, "quality", ["doc_id"], unreviewed=F.col("doc_id") % 11 == 0)


@query(
    "trn_setup",
    """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN quality END AS c FROM labels JOIN documents USING (doc_id)),
k AS (SELECT c, count(*) AS n FROM r WHERE c IS NOT NULL AND doc_id % 11 <> 0 GROUP BY 1),
t AS (SELECT n, CASE WHEN n > 1 THEN greatest(1, least(round_even(n * CAST(0.2 AS DOUBLE), 0), n - 1)) ELSE 0 END AS held FROM k)
SELECT 'classification' AS task, (SELECT count(*) FROM r) AS given, (SELECT count(*) FROM r WHERE c IS NULL) AS without_target, (SELECT count(*) FROM r WHERE c IS NOT NULL AND doc_id % 11 = 0) AS unreviewed,
CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) - sum(held) AS BIGINT) AS train, CAST(sum(held) AS BIGINT) AS test, count(*) AS classes FROM t""",
)
def trn_setup(spark, sf_dir):
    s = _setup(spark, sf_dir)
    columns = ", ".join(f"{c} long" for c in s.counts)
    return spark.createDataFrame([(s.task, *s.counts.values())], f"task string, {columns}")


@query("mdl_run")
def mdl_run(spark, sf_dir):
    """Two models by their held-out accuracy, and one that does not do the task."""
    return training.run(_setup(spark, sf_dir), ["logistic_regression", "naive_bayes", "linear_regression"])


def _item_spec(spark, sf_dir):
    columns = {"l_quantity": "number", "l_returnflag": "categorical", "l_extendedprice": "number"}
    items = table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.when(F.col("l_linenumber") != 2, F.col("l_quantity")))
    spec, _ = training.fit_spec(items.where("l_orderkey % 4 <> 0"), columns)
    return training.Spec.from_json(spec.to_json())


_ITEMS = "WITH i AS (SELECT CASE WHEN l_linenumber <> 2 THEN l_quantity END AS q, l_extendedprice AS p, l_returnflag AS f FROM lineitem WHERE l_orderkey % 4 <> 0)"


@query("pre_names", f"{_ITEMS} SELECT 'l_quantity' AS name, 'l_quantity' AS source FROM i UNION SELECT 'l_extendedprice', 'l_extendedprice' FROM i UNION SELECT 'l_returnflag=' || coalesce(f, '__missing__'), 'l_returnflag' FROM i")
def pre_names(spark, sf_dir):
    return spark.createDataFrame(_item_spec(spark, sf_dir).sources, "name string, source string")


@query(
    "pre_spec",
    f"""{_ITEMS}, m AS (SELECT 'l_quantity' AS c, CAST(q AS DOUBLE) AS x, (SELECT median(CAST(q AS DOUBLE)) FROM i) AS mid FROM i UNION ALL SELECT 'l_extendedprice', CAST(p AS DOUBLE), (SELECT median(CAST(p AS DOUBLE)) FROM i) FROM i)
SELECT c AS "column", round(mid, 6) AS median, round(avg(coalesce(x, mid)), 6) AS mean, round(stddev_pop(coalesce(x, mid)), 6) AS std FROM m GROUP BY c, mid""",
)
def pre_spec(spark, sf_dir):
    """Fitted numbers of a specification that was written as JSON and read back."""
    rows = [(f.column, round(f.median, 6), round(f.mean, 6), round(f.std, 6)) for f in _item_spec(spark, sf_dir).features if f.kind == "number"]
    return spark.createDataFrame(rows, "column string, median double, mean double, std double")
