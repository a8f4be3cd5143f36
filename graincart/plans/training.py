"""Splits, features and checks before training."""

from __future__ import annotations

from pyspark.sql import functions as F

from graincart.operators import checks, prep
from graincart.operators.quantiles import quantiles
from graincart.plans.registry import query, table

_SPLIT = """WITH r AS (SELECT doc_id, {c} AS c, row_number() OVER (PARTITION BY {c} ORDER BY md5('42-' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY {c}) AS n FROM labels)
SELECT doc_id, CASE WHEN n > 1 AND k <= greatest(1, least(round_even(n * CAST(0.2 AS DOUBLE), 0), n - 1)) THEN 'test' ELSE 'train' END AS split FROM r"""


def split_labels(spark, sf_dir, stratum="quality"):
    return prep.split(table(spark, sf_dir, "labels"), ["doc_id"], 0.2, 42, stratum)


@query("trn_split", _SPLIT.format(c="quality"))
def trn_split(spark, sf_dir):
    return split_labels(spark, sf_dir).select("doc_id", "split")


query("win_split", _SPLIT.format(c="quality"))(trn_split)


@query("smp_split", _SPLIT.format(c="1"))
def smp_split(spark, sf_dir):
    return split_labels(spark, sf_dir, None).select("doc_id", "split")


@query("jn_split_assert", f"WITH s AS ({_SPLIT.format(c='quality')}) SELECT count(*) AS shared FROM (SELECT doc_id FROM s WHERE split = 'train' INTERSECT SELECT doc_id FROM s WHERE split = 'test')")
def jn_split_assert(spark, sf_dir):
    s = trn_split(spark, sf_dir)
    return s.where("split = 'train'").select("doc_id").intersect(s.where("split = 'test'").select("doc_id")).agg(F.count("*").alias("shared"))


@query("trn_task", "SELECT * FROM (VALUES ('l_returnflag', 'classification'), ('l_linenumber', 'classification'), ('l_extendedprice', 'regression')) t(\"column\", task)")
def trn_task(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    parts = [prep.task_type(df, c, k) for c, k in (("l_returnflag", "categorical"), ("l_linenumber", "integer"), ("l_extendedprice", "number"))]
    return parts[0].union(parts[1]).union(parts[2])


_ORDERS = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 3 THEN o_totalprice END AS x, o_orderkey % 5 <> 0 AS train FROM orders"


@query("pre_scale", f"""WITH o AS ({_ORDERS}), m AS (SELECT quantile_cont(x, 0.5) AS m FROM o WHERE train), f AS (SELECT o_orderkey, train, coalesce(x, m) AS x FROM o, m),
s AS (SELECT avg(x) AS a, stddev_pop(x) AS d FROM f WHERE train) SELECT o_orderkey, round((x - a) / d, 6) AS x_scaled FROM f, s""")
def pre_scale(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 3, F.col("o_totalprice")).alias("x"))
    out = prep.imputed_and_scaled(df, "x", F.col("o_orderkey") % 5 != 0)
    return out.select("o_orderkey", F.round("x_scaled", 6).alias("x_scaled"))


@query("pre_impute", f"WITH o AS ({_ORDERS}) SELECT quantile_cont(x, 0.5) AS median FROM o WHERE train")
def pre_impute(spark, sf_dir):
    df = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0")
    median = quantiles(df, {"x": F.when(F.col("o_orderkey") % 10 != 3, F.col("o_totalprice"))}, [0.5])
    return median.select(F.get("values", F.lit(0)).alias("median"))


@query("pre_onehot", "SELECT c_custkey, CASE WHEN s = 'BUILDING' THEN 1.0::DOUBLE ELSE 0 END AS \"s=BUILDING\", CASE WHEN s = 'MACHINERY' THEN 1.0::DOUBLE ELSE 0 END AS \"s=MACHINERY\", CASE WHEN s IS NULL THEN 1.0::DOUBLE ELSE 0 END AS \"s=__missing__\" FROM (SELECT c_custkey, nullif(c_mktsegment, 'HOUSEHOLD') AS s FROM customer)")
def pre_onehot(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("s"))
    return prep.one_hot(df, "s", ["BUILDING", "MACHINERY"]).drop("s")


@query("agg_class", "WITH c AS (SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1) SELECT value, n, n / sum(n) OVER () AS fraction, min(n) OVER () / sum(n) OVER () AS min_fraction, max(n) OVER () / min(n) OVER () AS imbalance_ratio FROM c")
def agg_class(spark, sf_dir):
    return checks.class_balance(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query("chk_imbalance", "WITH c AS (SELECT count(*) AS n FROM labels GROUP BY quality) SELECT min(n) / sum(n) AS min_fraction, min(n) / sum(n) < 0.1 AS warn FROM c")
def chk_imbalance(spark, sf_dir):
    return checks.imbalance(table(spark, sf_dir, "labels"), "quality")


_OVER = "WITH s AS (SELECT text AS k, doc_id % 5 <> 0 AS train FROM documents), g AS (SELECT count(*) FILTER (train) AS a, count(*) FILTER (NOT train) AS b FROM s GROUP BY k) SELECT CAST(coalesce(sum(a) FILTER (b > 0), 0) AS BIGINT) AS count, coalesce(sum(a) FILTER (b > 0), 0) / sum(b) AS fraction, coalesce(sum(a) FILTER (b > 0), 0) > 0 AS warn FROM g"


@query("chk_duplicates", _OVER)
def chk_duplicates(spark, sf_dir):
    df = table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 5 != 0, "train").otherwise("test"))
    return checks.overlap(df, ["text"])


query("jn_dup", _OVER)(chk_duplicates)

_STUMP = """WITH l AS (SELECT doc_id, n_chars AS x, quality AS y FROM documents JOIN labels USING (doc_id)), c AS (SELECT DISTINCT y AS c FROM l), t AS (SELECT y AS c, count(*) AS total FROM l GROUP BY 1),
r AS (SELECT doc_id, c.c, total, sum(CASE WHEN y = c.c THEN 1 ELSE 0 END) OVER (PARTITION BY c.c ORDER BY x, doc_id ROWS UNBOUNDED PRECEDING) AS lft FROM l, c JOIN t ON t.c = c.c),
b AS (SELECT doc_id, max(lft) + max(total - lft) AS hits FROM r GROUP BY 1) SELECT greatest(max(hits), (SELECT max(total) FROM t)) / (SELECT sum(total) FROM t) AS score FROM b"""


@query("win_stump", _STUMP)
def win_stump(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return checks.stump_accuracy(df, "n_chars", "quality", ["doc_id"])


@query("win_stump_by_value", """WITH l AS (SELECT n_chars AS x, quality AS y FROM documents JOIN labels USING (doc_id)), c AS (SELECT y AS c, count(*) AS total FROM l GROUP BY 1),
g AS (SELECT x, c, any_value(total) AS total, count(*) FILTER (y = c) AS n FROM l, c GROUP BY x, c), r AS (SELECT x, total, sum(n) OVER (PARTITION BY c ORDER BY x) AS lft FROM g),
b AS (SELECT x, max(lft) + max(total - lft) AS hits FROM r GROUP BY 1) SELECT greatest(max(hits), (SELECT max(total) FROM c)) / (SELECT sum(total) FROM c) AS score FROM b""")
def win_stump_by_value(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return checks.stump_accuracy_by_value(df, "n_chars", "quality")


@query("chk_leakage", "SELECT round(corr(l_extendedprice, l_quantity) ^ 2, 6) AS score, corr(l_extendedprice, l_quantity) ^ 2 >= 0.95 AS warn FROM lineitem")
def chk_leakage(spark, sf_dir):
    out = checks.linear_leak(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity")
    return out.select(F.round("score", 6).alias("score"), "warn")


_FEATURES = {"l_quantity": "l_quantity", "l_tax": "l_tax", "half": "l_linenumber", "late": "l_shipdate"}
_LEAKS = """WITH l AS (SELECT l_returnflag AS y, l_quantity::DOUBLE AS l_quantity, l_tax::DOUBLE AS l_tax, CASE WHEN l_linenumber > 1 THEN l_linenumber / 2 END::DOUBLE AS half, (epoch(l_shipdate::TIMESTAMP) / 86400)::DOUBLE AS late FROM lineitem),
m AS (UNPIVOT l ON l_quantity, l_tax, half, late INTO NAME feature VALUE x), k AS (SELECT DISTINCT y AS c FROM l),
g AS (SELECT feature, x, c, count(*) FILTER (y = c) AS n FROM m, k GROUP BY 1, 2, 3), r AS (SELECT feature, x, c, sum(n) OVER (PARTITION BY feature, c ORDER BY x) AS lft, sum(n) OVER (PARTITION BY feature, c) AS whole FROM g),
b AS (SELECT feature, x, max(lft) + max(whole - lft) AS hits, max(whole) AS most, sum(whole) AS rows FROM r GROUP BY 1, 2)
SELECT feature, CASE feature WHEN 'half' THEN 'l_linenumber' WHEN 'late' THEN 'l_shipdate' ELSE feature END AS "column", 'stump_accuracy' AS metric, greatest(max(hits), max(most)) / max(rows) AS score, greatest(max(hits), max(most)) / max(rows) >= 0.7 AS warn FROM b GROUP BY 1"""


@query("chk_leak_list", _LEAKS)
def chk_leak_list(spark, sf_dir):
    """Every feature of the line items by its best threshold on the return flag, in one pass, under its source column."""
    df = table(spark, sf_dir, "lineitem")
    numbers = {"l_quantity": F.col("l_quantity"), "l_tax": F.col("l_tax"), "half": F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") / 2), "late": F.unix_date(F.col("l_shipdate").cast("date"))}
    return checks.leaks(df, {n: (_FEATURES[n], x) for n, x in numbers.items()}, "l_returnflag", "classification", 0.7)


@query("chk_leak_list_reg", " UNION ALL ".join(f"SELECT '{c}' AS feature, '{c}' AS \"column\", 'r_squared' AS metric, round(coalesce(corr({c}, l_extendedprice) ^ 2, 0), 6) AS score, coalesce(corr({c}, l_extendedprice) ^ 2, 0) >= 0.8 AS warn FROM lineitem" for c in ("l_quantity", "l_tax", "l_discount")))
def chk_leak_list_reg(spark, sf_dir):
    out = checks.leaks(table(spark, sf_dir, "lineitem"), {c: (c, F.col(c)) for c in ("l_quantity", "l_tax", "l_discount")}, "l_extendedprice", "regression", 0.8)
    return out.withColumn("score", F.round("score", 6))
