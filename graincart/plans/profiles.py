"""Profiles of columns, and scans and pages of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graincart import tables
from graincart.operators import profile
from graincart.operators.quantiles import quantiles
from graincart.plans.registry import query, table
from graincart.sources import readers

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _rounded(df, but=()):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes])


@query(
    "agg_profile",
    _union([f"""SELECT '{c}' AS "column", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate,
      CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
      {', '.join(f'round(CAST(quantile_cont({c}, {q}) AS DOUBLE), 6) AS q{round(q * 100)}' for q in profile.QUANTILES)} FROM lineitem""" for c in NUMBERS]),
)
def agg_profile(spark, sf_dir):
    return _rounded(profile.numeric_profile(table(spark, sf_dir, "lineitem"), NUMBERS))


@query("agg_missing", "SELECT 'value' AS \"column\", avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS missing_rate FROM (SELECT nullif(event_type, 'error') AS v FROM events)")
def agg_missing(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.nullif(F.col("event_type"), F.lit("error")).alias("v"))
    return df.agg(F.avg(F.col("v").isNull().cast("double")).alias("missing_rate")).select(F.lit("value").alias("column"), "missing_rate")


@query("agg_moments", "SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS std FROM lineitem GROUP BY 1")
def agg_moments(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return _rounded(df.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.avg("l_extendedprice").alias("mean"), F.stddev_samp("l_extendedprice").alias("std")), ("lo", "hi"))


@query("agg_quant", "SELECT o_orderpriority, " + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 6) AS q{round(q * 100)}" for q in profile.QUANTILES) + " FROM orders GROUP BY 1")
def agg_quant(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    df = quantiles(df, {"o_totalprice": F.col("o_totalprice")}, profile.QUANTILES, by=["o_orderpriority"])
    return df.select("o_orderpriority", *[F.round(F.get("values", F.lit(i)), 6).alias(f"q{round(q * 100)}") for i, q in enumerate(profile.QUANTILES)])


@query("agg_freq", "SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1")
def agg_freq(spark, sf_dir):
    return profile.frequencies(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("agg_dt", "SELECT 'ts' AS \"column\", strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS min, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS max FROM events")
def agg_dt(spark, sf_dir):
    return profile.datetime_profile(table(spark, sf_dir, "events"), ["ts"])


@query("agg_text", _union([f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS missing_rate, round(avg(length({c})), 6) AS mean_length, count(DISTINCT {c}) AS cardinality FROM documents" for c in ("text", "lang", "source")]))
def agg_text(spark, sf_dir):
    return _rounded(profile.text_profile(table(spark, sf_dir, "documents"), ["text", "lang", "source"]))


@query("win_first", "SELECT row_number() OVER (ORDER BY i) AS place, substr(text, 1, 120) AS example FROM (SELECT text, min(doc_id) AS i FROM documents GROUP BY text ORDER BY i LIMIT 3)")
def win_first(spark, sf_dir):
    return profile.first_distinct(table(spark, sf_dir, "documents"), "text", ["doc_id"])


@query("agg_corr", "WITH n AS (SELECT * FROM lineitem) " + _union([f"SELECT '{a}' AS a, '{b}' AS b, round(corr({min(a, b)}, {max(a, b)}), 6) AS corr FROM n" for a in NUMBERS for b in NUMBERS]))
def agg_corr(spark, sf_dir):
    return _rounded(profile.correlations(table(spark, sf_dir, "lineitem"), NUMBERS))


@query("agg_kinds", _union([f"SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS distinct_values, round(avg(length({c})), 6) AS mean_length, count(TRY_CAST({c} AS DOUBLE)) AS numbers, count(*) FILTER (TRY_CAST({c} AS DOUBLE) = floor(TRY_CAST({c} AS DOUBLE))) AS whole FROM part" for c in ("p_name", "p_brand", "p_type")]))
def agg_kinds(spark, sf_dir):
    return _rounded(profile.kind_facts(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"]))


@query("agg_kinds_told", "SELECT * FROM (VALUES ('c_custkey', 'integer'), ('c_name', 'text'), ('c_nationkey', 'integer'), ('c_acctbal', 'number'), ('c_mktsegment', 'categorical')) t(\"column\", kind)")
def agg_kinds_told(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return profile.kinds(df, df.columns)


_HIST = """WITH x AS (SELECT l_returnflag AS side, l_extendedprice AS v FROM lineitem), e AS (SELECT min(v) AS lo, max(v) AS hi FROM x)
SELECT side, CAST(least(floor((v - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM x, e GROUP BY 1, 2"""


@query("agg_hist", _HIST)
def agg_hist(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag")


_TOP = """WITH c AS (SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS k FROM c),
o AS (SELECT CASE WHEN k <= 12 THEN value ELSE 'other' END AS value, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1) SELECT value, n, n / (SELECT sum(n) FROM o) AS share FROM o"""


@query("win_topk_other", _TOP)
def win_topk_other(spark, sf_dir):
    return profile.top_and_other(table(spark, sf_dir, "part"), "p_name")


@query("agg_dups", "SELECT CAST(sum(c - 1) AS BIGINT) AS duplicates, sum(c - 1) / sum(c) AS fraction FROM (SELECT count(*) AS c FROM documents GROUP BY text)")
def agg_dups(spark, sf_dir):
    return profile.duplicates(table(spark, sf_dir, "documents"), ["text"])


@query("src_parquet", "SELECT r_regionkey, r_name FROM region")
def src_parquet(spark, sf_dir):
    return readers.read_table(spark, f"{sf_dir}/region.parquet").select("r_regionkey", "r_name")


@query("src_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(x, y)")
def src_rows(spark, sf_dir):
    return readers.from_rows(spark, ["x", "y"], [[1, "a"], [2, "b"]]).select(F.col("x").cast("int"), "y")


@query("src_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 400 AND 599")
def src_page(spark, sf_dir):
    return readers.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 400, 200, "o_orderkey")


@query("prj_drop", "SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, o_orderstatus FROM orders")
def prj_drop(spark, sf_dir):
    return table(spark, sf_dir, "orders").drop("o_totalprice")


@query("lim_head", "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 200")
def lim_head(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy("event_id").limit(200).select("event_id", "event_type", "value")


@query("srt_recent", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def srt_recent(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_orderdate")


@query("flt_target", "SELECT event_id, event_type FROM events WHERE nullif(event_type, 'error') IS NOT NULL")
def flt_target(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.nullif(F.col("event_type"), F.lit("error")).isNotNull()).select("event_id", "event_type")


@query("fn_epoch", "SELECT event_id, epoch_us(ts) / 1000000.0 AS seconds FROM events")
def fn_epoch(spark, sf_dir):
    from graincart.operators.prep import epoch_seconds

    return table(spark, sf_dir, "events").select("event_id", epoch_seconds(F.col("ts")).alias("seconds"))


def _through_file(df, form):
    """``df`` written in a format and read back."""
    path = f"{tables.shared_folder(df.sparkSession)}/graincart-{uuid.uuid4().hex}.{form}"
    if form == "csv":
        readers.export(df, path, "csv")
    else:
        df.write.json(path)
    return readers.read_table(df.sparkSession, path)


@query("src_csv", "SELECT * FROM customer")
def src_csv(spark, sf_dir):
    return _through_file(table(spark, sf_dir, "customer"), "csv").withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@query("src_jsonl", "SELECT c_nationkey, c_name, c_custkey, c_acctbal FROM customer")
def src_jsonl(spark, sf_dir):
    """Columns come back in the order of the file, not in that of their names."""
    back = _through_file(table(spark, sf_dir, "customer").select("c_nationkey", "c_name", "c_custkey", "c_acctbal"), "jsonl")
    if back.columns != ["c_nationkey", "c_name", "c_custkey", "c_acctbal"]:
        raise ValueError(f"columns are {back.columns}")
    return back.withColumn("c_nationkey", F.col("c_nationkey").cast("int"))
