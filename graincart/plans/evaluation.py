"""Metrics, curves, ranks and group gaps over predictions of ``labels.quality``."""

from __future__ import annotations

from pyspark.sql import functions as F

from graincart.functions.text import hash_draw
from graincart.operators import metrics
from graincart.plans.registry import query, table

_P = """WITH p AS (SELECT doc_id, lang, quality = 1 AS y, floor(100 * (concat('0x', substr(sha256(doc_id || '::q'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 + quality) / 2) / 100 AS s FROM labels JOIN documents USING (doc_id)),
z AS (SELECT *, s >= 0.4 AS h FROM p)"""


def predictions(spark, sf_dir):
    df = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    s = F.floor(100 * (hash_draw(F.concat(F.col("doc_id").cast("string"), F.lit("::q"))) + F.col("quality")) / 2) / 100
    df = df.select("doc_id", "lang", (F.col("quality") == 1).alias("y"), s.cast("double").alias("s"))
    return df.withColumn("h", F.col("s") >= 0.4)


@query("agg_confusion", f"{_P}, l AS (SELECT unnest(['true', 'false']) AS v) SELECT a.v AS truth, b.v AS pred, count(doc_id) AS n, CAST(sum(count(doc_id)) OVER (PARTITION BY a.v) AS BIGINT) AS support, count(doc_id) / sum(count(doc_id)) OVER (PARTITION BY a.v) AS share FROM l a CROSS JOIN l b LEFT JOIN z ON CAST(y AS VARCHAR) = a.v AND CAST(h AS VARCHAR) = b.v GROUP BY 1, 2")
def agg_confusion(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), "y", "h")


_SCORES = f"""{_P}, l AS (SELECT unnest([true, false]) AS v), c AS (SELECT v, (SELECT count(*) FROM z WHERE y = v) AS t, (SELECT count(*) FROM z WHERE h = v) AS p, (SELECT count(*) FROM z WHERE h = v AND y = v) AS k FROM l),
m AS (SELECT v, t, k, k / p AS pr, k / t AS re, 2 * k / (t + p) AS f1 FROM c)"""


@query("agg_cls_metrics", f"{_SCORES} SELECT sum(k) / sum(t) AS accuracy, round(avg(re), 9) AS balanced_accuracy, round(avg(f1), 9) AS f1_macro, round(sum(f1 * t) / sum(t), 9) AS f1_weighted, round(avg(pr), 9) AS precision_macro, round(avg(re), 9) AS recall_macro, round(min_by(f1, t), 9) AS f1_minority, CAST(sum(t) AS BIGINT) AS support FROM m")
def agg_cls_metrics(spark, sf_dir):
    out = metrics.classification(predictions(spark, sf_dir), "y", "h")
    return out.select(*[F.round(c, 9).alias(c) if t == "double" and c != "accuracy" else c for c, t in out.dtypes])


@query("agg_reg_metrics", "WITH r AS (SELECT l_extendedprice AS y, l_extendedprice - 1500 * l_quantity AS r FROM lineitem) SELECT round(avg(abs(r)), 4) AS mae, round(sqrt(avg(r * r)), 4) AS rmse, round(quantile_cont(abs(r), 0.5), 4) AS median_ae, round(1 - var_pop(r) / var_pop(y), 4) AS explained_variance, round(max(abs(r)), 4) AS max_error, round(1 - avg(r * r) / var_pop(y), 4) AS r2, round(avg(r), 4) AS residual_mean FROM r")
def agg_reg_metrics(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity")).alias("h"))
    out = metrics.regression(df, "y", "h")
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


_CUM = f"{_P}, g AS (SELECT s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM z GROUP BY 1), c AS (SELECT s, p, q, sum(p) OVER (ORDER BY s DESC) AS tp, sum(q) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM g)"


@query("win_roc", f"{_CUM} SELECT fp / nq AS fpr, tp / np AS tpr FROM c UNION SELECT 0.0::DOUBLE, 0.0::DOUBLE UNION SELECT 1.0::DOUBLE, 1.0::DOUBLE")
def win_roc(spark, sf_dir):
    return metrics.roc_points(predictions(spark, sf_dir), F.col("y"), "s")


@query("ev_roc", f"{_CUM} SELECT sum(q * (2 * tp - p)) / (2.0::DOUBLE * max(np) * max(nq)) AS auc FROM c")
def ev_roc(spark, sf_dir):
    return metrics.roc_auc(predictions(spark, sf_dir), F.col("y"), "s")


@query("win_pr", f"{_CUM} SELECT tp / np AS recall, tp / (tp + fp) AS precision FROM c UNION ALL SELECT 1.0::DOUBLE, 0.0::DOUBLE")
def win_pr(spark, sf_dir):
    return metrics.pr_points(predictions(spark, sf_dir), F.col("y"), "s")


@query("ev_pr", f"{_CUM} SELECT round(sum(p / np * (tp / (tp + fp))), 9) AS average_precision FROM c")
def ev_pr(spark, sf_dir):
    return metrics.average_precision(predictions(spark, sf_dir), F.col("y"), "s").select(F.round("average_precision", 9).alias("average_precision"))


_REST = """WITH t AS (SELECT doc_id, lang, ['de', 'en', 'es', 'fr'] AS k FROM documents), u AS (SELECT doc_id, lang, unnest(k) AS c FROM t),
z AS (SELECT c AS "class", coalesce(lang = c, false) AS y, floor(50 * (concat('0x', substr(sha256(doc_id || '::' || c), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 + coalesce(lang = c, false)::INT * 0.5)) / 50 AS s FROM u),
g AS (SELECT "class", s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM z GROUP BY 1, 2),
c AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER v AS np, sum(q) OVER v AS nq FROM g WINDOW w AS (PARTITION BY "class" ORDER BY s DESC), v AS (PARTITION BY "class")),
a AS (SELECT "class", sum(q * (2 * tp - p)) / (2.0::DOUBLE * nullif(max(np) * max(nq), 0)) AS auc, sum(CASE WHEN np > 0 THEN p / np * (tp / (tp + fp)) END) AS ap, CAST(max(np) AS BIGINT) AS positives, CAST(max(nq) AS BIGINT) AS others FROM c GROUP BY 1)"""


def _language_scores(spark, sf_dir):
    """A made score for each language of each document."""
    df = table(spark, sf_dir, "documents").select("doc_id", "lang")
    s = lambda c: F.floor(50 * (hash_draw(F.concat(F.col("doc_id").cast("string"), F.lit(f"::{c}"))) + F.coalesce((F.col("lang") == c).cast("int"), F.lit(0)) * 0.5)) / 50
    return df, {c: s(c) for c in ("de", "en", "es", "fr")}


@query("ev_ovr", f"{_REST} SELECT \"class\", round(auc, 9) AS auc, round(ap, 9) AS average_precision, positives, others FROM a")
def ev_ovr(spark, sf_dir):
    """Each language against all others: areas under both curves."""
    df, scores = _language_scores(spark, sf_dir)
    return metrics.one_vs_rest(df, "lang", scores).withColumns({c: F.round(c, 9) for c in ("auc", "average_precision")})


@query("ev_ovr_macro", f"{_REST} SELECT count(*) AS classes, round(CASE WHEN count(auc) = count(*) THEN avg(auc) END, 9) AS auc_macro, round(CASE WHEN count(ap) = count(*) THEN avg(ap) END, 9) AS average_precision_macro FROM a")
def ev_ovr_macro(spark, sf_dir):
    df, scores = _language_scores(spark, sf_dir)
    return metrics.macro(metrics.one_vs_rest(df, "lang", scores)).withColumns({c: F.round(c, 9) for c in ("auc_macro", "average_precision_macro")})


@query("ev_residuals", "SELECT o_orderkey, o_totalprice - 250000 AS residual FROM orders")
def ev_residuals(spark, sf_dir):
    return metrics.residuals(table(spark, sf_dir, "orders"), "o_totalprice", F.lit(250000)).select("o_orderkey", "residual")


@query("ev_residual_facts", "WITH r AS (SELECT o_totalprice - 250000 AS r FROM orders) SELECT count(*) AS n, round(avg(r), 4) AS mean, round(stddev_pop(r), 4) AS std, round(avg(abs(r)), 4) AS mae, round(min(r), 4) AS least, round(max(r), 4) AS largest FROM r")
def ev_residual_facts(spark, sf_dir):
    out = metrics.residual_facts(table(spark, sf_dir, "orders"), "o_totalprice", F.lit(250000))
    return out.select("n", *[F.round(c, 4).alias(c) for c in out.columns if c != "n"])


_BOARD = "SELECT c_custkey AS model, CASE WHEN c_custkey % 17 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN c_custkey % 5 <> 1 THEN floor(c_acctbal / 100) END AS score FROM customer"


@query("win_rank", f"WITH b AS ({_BOARD}), m AS (SELECT *, status = 'ok' AND score IS NOT NULL AS ok FROM b) SELECT model, status, score, CASE WHEN ok THEN rank() OVER (PARTITION BY ok ORDER BY score DESC) END AS rank, CASE WHEN ok THEN 0 WHEN status = 'ok' THEN 1 ELSE 2 END AS standing FROM m")
def win_rank(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    board = df.select(F.col("c_custkey").alias("model"), F.when(F.col("c_custkey") % 17 == 0, "failed").otherwise("ok").alias("status"), F.when(F.col("c_custkey") % 5 != 1, F.floor(F.col("c_acctbal") / 100).cast("double")).alias("score"))
    return metrics.leaderboard(board, "score")


query("mdl_rank", f"WITH b AS ({_BOARD}), m AS (SELECT *, status = 'ok' AND score IS NOT NULL AS ok FROM b) SELECT model, status, score, CASE WHEN ok THEN rank() OVER (PARTITION BY ok ORDER BY score DESC) END AS rank, CASE WHEN ok THEN 0 WHEN status = 'ok' THEN 1 ELSE 2 END AS standing FROM m")(win_rank)

_GROUPS = f"{_P}, g AS (SELECT lang AS \"group\", count(*) AS n, count(*) FILTER (y) AS positives, count(*) FILTER (y = h) / count(*) AS accuracy, count(*) FILTER (h) / count(*) AS selection_rate, count(*) FILTER (y AND h) / nullif(count(*) FILTER (y), 0) AS tpr, count(*) FILTER (NOT y AND h) / nullif(count(*) FILTER (NOT y), 0) AS fpr FROM z GROUP BY 1)"


@query("agg_fair_cls", f"{_GROUPS} SELECT * FROM g")
def agg_fair_cls(spark, sf_dir):
    return metrics.group_classification(predictions(spark, sf_dir), "lang", F.col("y"), F.col("h"))


@query("agg_groups", f"{_GROUPS} SELECT \"group\", n FROM g")
def agg_groups(spark, sf_dir):
    return agg_fair_cls(spark, sf_dir).select("group", "n")


@query("fr_gap", f"{_GROUPS}, m AS (UNPIVOT g ON accuracy, selection_rate, tpr, fpr INTO NAME metric VALUE value) SELECT metric, CASE WHEN count(*) > 1 THEN max(value) - min(value) END AS gap, arg_min(\"group\", (value, \"group\")) AS lowest, arg_min(\"group\", (-value, \"group\")) AS highest, coalesce(max(value) - min(value) > 0.1 AND count(*) > 1, false) AS exceeds FROM m GROUP BY 1")
def fr_gap(spark, sf_dir):
    return metrics.gaps(agg_fair_cls(spark, sf_dir), ["accuracy", "selection_rate", "tpr", "fpr"])




@query("fr_report", f"{_GROUPS.replace('FROM z', 'FROM z WHERE doc_id % 25 = 0')}, d AS (SELECT lang AS l, count(*) AS rows FROM documents GROUP BY 1), r AS (SELECT l, rows, coalesce(n, 0) AS n, accuracy, tpr FROM d LEFT JOIN g ON l IS NOT DISTINCT FROM \"group\") SELECT l AS \"group\", rows, n, CASE WHEN n = 0 THEN 'no held-out rows' WHEN n < 10 THEN 'fewer than 10 held-out rows' END AS reason, CASE WHEN n >= 10 THEN accuracy END AS accuracy, CASE WHEN n >= 10 THEN tpr END AS tpr FROM r")
def fr_report(spark, sf_dir):
    held_out = predictions(spark, sf_dir).where("doc_id % 25 = 0")
    scores = metrics.group_classification(held_out, "lang", F.col("y"), F.col("h")).select("group", "n", "accuracy", "tpr")
    return metrics.group_report(table(spark, sf_dir, "documents"), "lang", scores, 10)


@query("agg_fair_reg", "SELECT l_returnflag AS \"group\", count(*) AS n, round(avg(abs(1500 * l_quantity - l_extendedprice)), 4) AS mae, round(sqrt(avg((1500 * l_quantity - l_extendedprice) ^ 2)), 4) AS rmse, round(avg(1500 * l_quantity - l_extendedprice), 4) AS mean_error FROM lineitem GROUP BY 1")
def agg_fair_reg(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity")).alias("h"))
    out = metrics.group_regression(df, "l_returnflag", "y", "h")
    return out.select(*[F.round(c, 4).alias(c) if t == "double" else c for c, t in out.dtypes])


@query("set_groups", "SELECT DISTINCT lang AS value FROM documents UNION SELECT 'xx'")
def set_groups(spark, sf_dir):
    kept = spark.createDataFrame([("xx",)], "value string")
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("value")).union(kept).distinct()
