"""Column sets, values as they are shown, and validation rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from graincart.functions import shown
from graincart.operators import columns, metrics, review
from graincart.plans.evaluation import agg_fair_cls
from graincart.plans.registry import SQL, query, table
from graincart.plans.texts import agg_pii


@query("flt_numeric", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(epoch(o_orderdate::TIMESTAMP) AS DOUBLE) AS o_orderdate FROM orders")
def flt_numeric(spark, sf_dir):
    """The columns of ``orders`` that are numbers or times, as doubles."""
    df = table(spark, sf_dir, "orders")
    df = df.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return columns.numeric_only(df, keep=["o_orderkey"])


@query("set_intersect_cols", "SELECT DISTINCT 'doc_id' AS name FROM documents JOIN labels USING (doc_id)")
def set_intersect_cols(spark, sf_dir):
    """The columns that documents and labels share, if any row of theirs meets."""
    a, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    names = columns.shared(a, b)
    return a.join(b, names, "left_semi").select(F.explode(F.array(*map(F.lit, names))).alias("name")).distinct()


_TOLD = "SELECT \"column\", detector, spans FROM (" + SQL["agg_pii"] + ")" if "agg_pii" in SQL else None


@query("set_concat", f"{_TOLD} UNION ALL SELECT 'source', 'given', count(*) FROM documents WHERE source IS NOT NULL GROUP BY ALL HAVING count(*) > 0" if _TOLD else None)
def set_concat(spark, sf_dir):
    """Findings of the patterns and of a second layer, as one table."""
    first = agg_pii(spark, sf_dir)
    second = table(spark, sf_dir, "documents").where("source is not null").groupBy(F.lit("source").alias("column"), F.lit("given").alias("detector")).agg(F.count("*").alias("spans"))
    return columns.concatenated(first.select("column", "detector", "spans"), second)


@query("fn_round", "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 8, 2) AS two, round_even(l_quantity / 4, 0) AS whole FROM lineitem")
def fn_round(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", shown.rounded(F.col("l_extendedprice") / 8, 2).alias("two"), shown.rounded(F.col("l_quantity") / 4, 0).alias("whole"))


@query("fn_jsonify", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE CAST(o_custkey AS VARCHAR) END AS number, to_json(o_orderpriority || chr(10) || '"x"')::VARCHAR AS text, '"' || strftime(o_orderdate::DATE, '%Y-%m-%d') || '"' AS day,
CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS flag, CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END AS raw FROM orders""")
def fn_jsonify(spark, sf_dir):
    """Numbers, texts, days, flags and bytes of ``orders`` as JSON."""
    o = table(spark, sf_dir, "orders")
    df = o.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("number"), F.concat("o_orderpriority", F.lit('\n"x"')).alias("text"), F.col("o_orderdate").cast("date").alias("day"),
        (F.col("o_orderkey") % 2 == 0).alias("flag"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus").cast("binary")).alias("raw"),
    )
    return df.select("o_orderkey", *[shown.json_value(f.name, f.dataType).alias(f.name) for f in df.schema.fields[1:]])


_SIZE = "CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024) ELSE n || ' B' END"


@query("fe_format", f"SELECT o_orderkey, {_SIZE} AS size FROM (SELECT o_orderkey, o_orderkey * 1021 * (o_custkey + 1) AS n FROM orders)")
def fe_format(spark, sf_dir):
    n = F.col("o_orderkey") * 1021 * (F.col("o_custkey") + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.size_text(n).alias("size"))


@query("fe_primary", "SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN '–' ELSE printf('%.4f', p_size / 49.0::DOUBLE) || CASE WHEN p_size % 2 = 0 THEN ' ↑' ELSE ' ↓' END END AS shown FROM part")
def fe_primary(spark, sf_dir):
    value = F.when(F.col("p_size") % 9 != 0, F.col("p_size") / 49.0)
    return table(spark, sf_dir, "part").select("p_partkey", shown.metric_text(value, F.col("p_size") % 2 == 0).alias("shown"))


_BOARDS = "SELECT c_custkey AS model, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS f1, CASE WHEN c_custkey < 0 THEN 1.0 END AS auc, c_nationkey::DOUBLE AS rmse FROM customer"


@query("fe_rankable", f"WITH b AS ({_BOARDS}) SELECT 'f1' AS metric, count(f1) AS n FROM b HAVING count(f1) > 0 UNION ALL SELECT 'auc', count(auc) FROM b HAVING count(auc) > 0 UNION ALL SELECT 'rmse', count(rmse) FROM b HAVING count(rmse) > 0")
def fe_rankable(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    board = c.select(F.col("c_custkey").alias("model"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("f1"), F.when(F.col("c_custkey") < 0, 1.0).alias("auc"), F.col("c_nationkey").cast("double").alias("rmse"))
    return metrics.rankable(board, ["f1", "auc", "rmse"])


def _gaps(spark, sf_dir):
    return metrics.gaps(agg_fair_cls(spark, sf_dir), ["accuracy", "selection_rate", "tpr", "fpr"])


@query("fe_gap", "SELECT metric, CASE WHEN gap IS NULL THEN metric || ' is not measured' ELSE metric || ' runs from ' || coalesce(lowest, 'None') || ' to ' || coalesce(highest, 'None') || ' by ' || printf('%.3f', gap) || CASE WHEN exceeds THEN ', above the threshold' ELSE '' END END AS said FROM (" + SQL["fr_gap"] + ")")
def fe_gap(spark, sf_dir):
    g = _gaps(spark, sf_dir)
    return g.select("metric", shown.gap_text(F.col("metric"), F.col("gap"), F.col("lowest"), F.col("highest"), F.col("exceeds")).alias("said"))


@query("win_gaps", "SELECT row_number() OVER (ORDER BY gap DESC NULLS LAST, metric) AS place, metric, gap, lowest, highest FROM (" + SQL["fr_gap"] + ")")
def win_gaps(spark, sf_dir):
    """The gaps between groups, the widest first."""
    return metrics.widest_first(_gaps(spark, sf_dir)).select("place", "metric", "gap", "lowest", "highest")


@query("fe_override", """SELECT doc_id AS "row", kind, value, CASE WHEN value IS NULL OR trim(value) = '' THEN 'no answer' WHEN kind = 'binary' AND lower(trim(value)) NOT IN ('true', 'false') THEN 'not true or false' WHEN kind = 'choice' AND trim(value) NOT IN ('good', 'bad') THEN 'no option'
WHEN kind = 'score' AND (TRY_CAST(trim(value) AS DOUBLE) IS NULL OR TRY_CAST(trim(value) AS DOUBLE) NOT BETWEEN 1 AND 5) THEN 'no level' END AS problem
FROM (SELECT doc_id, ['binary', 'choice', 'score'][1 + doc_id % 3] AS kind, [' ', 'true', 'good', '3.5', '9', 'False'][1 + doc_id // 3 % 6] AS value FROM documents)""")
def fe_override(spark, sf_dir):
    """Whether a reviewer's new answer is one that the question can have."""
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), pick(["binary", "choice", "score"], F.col("doc_id") % 3).alias("kind"), pick([" ", "true", "good", "3.5", "9", "False"], F.expr("doc_id div 3 % 6")).alias("value"))
    return df.select("row", "kind", "value", review.override_problem(F.col("kind"), F.col("value"), ["good", "bad"], (1, 5)).alias("problem"))


@query("smp_val", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7-' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, n > 1 AND k <= greatest(1, least(round_even(n * CAST(0.15 AS DOUBLE), 0), n - 1)) AS validation FROM r""")
def smp_val(spark, sf_dir):
    """The exact share of each language for validation, one row at least and not all."""
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("__row_id__"), "lang")
    return review.validation_rows(df, "lang", 0.15, 7).select(F.col("__row_id__").alias("doc_id"), "validation")
