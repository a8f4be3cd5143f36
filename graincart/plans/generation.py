"""Validation of rows, generated rows, provenance merges and confidence functions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from graincart.functions import shown
from graincart.operators import cards, generate, labeling
from graincart.operators.schema import ColumnSpec
from graincart.operators.validation import validated
from graincart.plans.registry import query, table
from graincart.sources.versions import merged_provenance


@query("flt_validate", """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'x' || o_custkey WHEN o_orderkey % 9 = 1 THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END AS n, o_orderstatus AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'maybe' END AS b FROM orders),
v AS (SELECT *, TRY_CAST(n AS BIGINT) AS i FROM o) SELECT o_orderkey, CASE WHEN i BETWEEN 0 AND 1000 THEN i END AS n, CASE WHEN s IN ('F', 'O') THEN s END AS s, CASE WHEN b = 'Yes' THEN true END AS b,
concat_ws('; ', CASE WHEN trim(n) <> '' AND i IS NULL THEN 'n: not a integer' WHEN i NOT BETWEEN 0 AND 1000 THEN 'n: out of range' END, CASE WHEN s NOT IN ('F', 'O') THEN 's: not a categorical' END, CASE WHEN b = 'maybe' THEN 'b: not a bool' END) AS errors FROM v""")
def flt_validate(spark, sf_dir):
    k = F.col("o_orderkey") % 9
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, F.concat(F.lit("x"), F.col("o_custkey").cast("string"))).when(k == 1, " ").otherwise(F.col("o_custkey").cast("string")).alias("n"), F.col("o_orderstatus").alias("s"), F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("maybe").alias("b"))
    out = validated(df, [ColumnSpec("n", "integer", 0, 1000), ColumnSpec("s", "categorical", categories=("F", "O")), ColumnSpec("b", "bool")])
    return out.withColumn("errors", F.array_join("errors", "; "))


@query("fn_conf_bin", "SELECT DISTINCT l_discount AS p, least(greatest(2 * abs(l_discount - 0.5), 0), 1) AS confidence FROM lineitem")
def fn_conf_bin(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("p"), labeling.review_confidence(F.col("l_discount")).alias("confidence")).distinct()


@query("fn_conf_choice", "SELECT l_orderkey, l_linenumber, l_partkey, greatest(l_discount, nullif(l_tax, 0)) AS confidence FROM lineitem")
def fn_conf_choice(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.greatest("l_discount", F.nullif(F.col("l_tax"), F.lit(0.0))).alias("confidence"))


@query("fn_conf_score", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN greatest(round(value, 1), 3.5) ELSE value END AS confidence FROM events")
def fn_conf_score(spark, sf_dir):
    shares = F.when(F.col("event_id") % 3 != 0, F.to_json(F.create_map(F.lit("a"), F.round("value", 1), F.lit("b"), F.lit(3.5))))
    best = F.array_max(F.map_values(F.from_json(shares, "map<string,double>")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(best, F.col("value")).alias("confidence"))


@query("jn_provmerge", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'human_reviewed' ELSE 'evaluator' END AS bucket FROM documents")
def jn_provmerge(spark, sf_dir):
    old = F.lit('{"row_origin":"uploaded","label_origins":{"a":{"origin":"evaluator"},"b":{"origin":"evaluator"}}}')
    new = F.when(F.col("doc_id") % 3 == 0, '{"label_origins":{"a":{"origin":"human_reviewed"}}}')
    return table(spark, sf_dir, "documents").select("doc_id", labeling.origin_bucket(merged_provenance(old, new)).alias("bucket"))


@query("fn_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("fn_redact_secret", r"""SELECT c_custkey, CASE WHEN c_custkey > 99999 THEN '[REDACTED] name: ' WHEN c_custkey % 2 = 0 THEN '[REDACTED] name: ' ELSE 'token=k' || c_custkey % 100 || ' name: ' END || c_name || ' [REDACTED] Authorization: [REDACTED]' AS note FROM customer""")
def fn_redact_secret(spark, sf_dir):
    note = F.concat(
        F.when((F.col("c_custkey") > 99999) | (F.col("c_custkey") % 2 == 0), F.concat(F.lit("api_key=k000"), F.col("c_custkey").cast("string"), F.lit(",")))
        .otherwise(F.concat(F.lit("token=k"), (F.col("c_custkey") % 100).cast("string"))), F.lit(" name: "), "c_name",
        F.lit(" sk-Abc_123-"), F.col("c_custkey").cast("string"), F.lit(" Authorization: bearer abc.def-ghi_jkl"))
    return table(spark, sf_dir, "customer").select("c_custkey", cards.without_secrets(note).alias("note"))


@query("fe_interpret", "SELECT o_orderkey, CASE WHEN x < 0.01 THEN 'strong' WHEN x < 0.05 THEN 'some' ELSE 'none' END AS evidence FROM (SELECT o_orderkey, o_orderkey % 100 / 1000.0 AS x FROM orders)")
def fe_interpret(spark, sf_dir):
    x = F.col("o_orderkey") % 100 / 1000.0
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.evidence(x).alias("evidence"))


@query("fe_progress", "SELECT o_orderkey, least(100, round(100.0 * o_orderkey / 10007))::BIGINT AS percent FROM orders")
def fe_progress(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.percent_done(F.col("o_orderkey"), F.lit(10007)).alias("percent"))


@query("gen_rows")
def gen_rows(spark, sf_dir):
    """As many rows as ``customer`` has, by the ranges and categories of its columns."""
    df = table(spark, sf_dir, "customer")
    specs = generate.specs_of(df, ["c_nationkey", "c_acctbal", "c_mktsegment"])
    return generate.generated(spark, specs, df.count(), generate.fake_generator).rows
