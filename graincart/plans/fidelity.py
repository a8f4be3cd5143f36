"""Fidelity of one part of ``lineitem`` (flag N, the made rows) to another (flag R, the sample)."""

from __future__ import annotations

from pyspark.sql import functions as F

from graincart.operators import fidelity, synth
from graincart.plans.registry import query, table

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
_SIDES = "SELECT * FROM lineitem WHERE l_returnflag IN ('R', 'N')"


def _sides(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "N"))


def _is_sample():
    return F.col("l_returnflag") == "R"


_KS = f"""WITH c AS (SELECT l_extendedprice AS x, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag = 'N') AS b FROM ({_SIDES}) GROUP BY 1),
r AS (SELECT sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER (ORDER BY x) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c), t AS (SELECT max(abs(ca / na - cb / nb)) AS statistic, max(na * nb / (na + nb)) AS n FROM r)
SELECT statistic, round(least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * n * statistic * statistic))))), 9) AS p_value FROM t"""


@query("fid_ks", _KS)
def fid_ks(spark, sf_dir):
    # the SQL has the limit distribution at every size
    out = fidelity.ks_statistic(_sides(spark, sf_dir), "l_extendedprice", _is_sample(), exact_up_to=0)
    return out.select("statistic", F.round("p_value", 9).alias("p_value"))


@query("win_ecdf", f"""WITH c AS (SELECT l_quantity AS x, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag = 'N') AS b FROM ({_SIDES}) GROUP BY 1)
SELECT x, CAST(sum(a) OVER (ORDER BY x) AS BIGINT) AS ca, CAST(sum(b) OVER (ORDER BY x) AS BIGINT) AS cb FROM c""")
def win_ecdf(spark, sf_dir):
    return fidelity.cumulative_counts(_sides(spark, sf_dir), "l_quantity", _is_sample()).select("x", "ca", "cb")


@query("fid_chi2", f"""WITH c AS (SELECT l_linenumber AS v, count(*) FILTER (l_returnflag = 'R') AS s, count(*) FILTER (l_returnflag = 'N') AS g FROM ({_SIDES}) GROUP BY 1),
e AS (SELECT g, sum(g) OVER () AS t, greatest(s / sum(s) OVER () * sum(g) OVER (), 0.5) AS e FROM c), f AS (SELECT g, e * t / sum(e) OVER () AS e FROM e),
x AS (SELECT sum((g - e) * (g - e) / e) AS s, count(*) - 1 AS dof FROM f)
SELECT round(s, 6) AS statistic, dof, round(exp(-s / 2) * (1 + s / 2 + s * s / 8), 9) AS p_value FROM x""")
def fid_chi2(spark, sf_dir):
    out = fidelity.chi_square(_sides(spark, sf_dir), "l_linenumber", _is_sample())
    # 6 degrees of freedom, for which the tail has a closed form
    return out.select(F.round("statistic", 6).alias("statistic"), "dof", F.round("p_value", 9).alias("p_value"))


_DIST = f"""WITH x AS (SELECT l_returnflag = 'R' AS sample_side, CAST(l_extendedprice AS DOUBLE) AS v, CAST(l_linenumber AS VARCHAR) AS c FROM ({_SIDES})), e AS (SELECT min(v) AS lo, max(v) AS hi FROM x),
r AS (SELECT sample_side, c, count(*) AS n, row_number() OVER (PARTITION BY sample_side ORDER BY count(*) DESC, c) AS k FROM x GROUP BY 1, 2)
SELECT 'l_extendedprice' AS "column", 'histogram' AS chart, sample_side, CAST(CAST(least(floor((v - lo) / (hi - lo) * 20), 19) AS BIGINT) AS VARCHAR) AS label, CAST(count(*) AS DOUBLE) AS value FROM x, e GROUP BY ALL
UNION ALL SELECT 'l_linenumber', 'bar', sample_side, CASE WHEN k <= 4 THEN c ELSE 'other' END, sum(n) / max((SELECT count(*) FROM x y WHERE y.sample_side = r.sample_side)) FROM r GROUP BY ALL"""


@query("fid_dist", _DIST)
def fid_dist(spark, sf_dir):
    return fidelity.distributions(_sides(spark, sf_dir), ["l_extendedprice"], ["l_linenumber"], _is_sample(), most=4)


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]


@query("fid_drift", "SELECT round(greatest(" + ", ".join(f"abs(corr({a}, {b}) FILTER (l_returnflag = 'R') - corr({a}, {b}) FILTER (l_returnflag = 'N'))" for a, b in _PAIRS) + f"), 6) AS drift FROM ({_SIDES})")
def fid_drift(spark, sf_dir):
    out = fidelity.correlation_drift(_sides(spark, sf_dir), ["l_quantity", "l_extendedprice", "l_discount"], _is_sample())
    return out.select(F.round("drift", 6).alias("drift"))


@query("fid_matrices", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}) FILTER (l_returnflag = 'R'), 4) AS sample, round(corr({a}, {b}) FILTER (l_returnflag = 'N'), 4) AS made FROM lineitem" for a, b in _PAIRS))
def fid_matrices(spark, sf_dir):
    out = fidelity.correlation_matrices(_sides(spark, sf_dir), ["l_quantity", "l_extendedprice", "l_discount"], _is_sample())
    return out.select("a", "b", F.round("sample", 4).alias("sample"), F.round("made", 4).alias("made"))


@query("jn_align", "WITH s AS (SELECT o_orderpriority AS value, count(*) AS sample FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' GROUP BY 1), g AS (SELECT o_orderpriority AS value, count(*) AS made FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' GROUP BY 1) SELECT value, coalesce(sample, 0) AS sample, coalesce(made, 0) AS made FROM s FULL JOIN g USING (value)")
def jn_align(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    s = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "1-URGENT")
    g = (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") != "5-LOW")
    return fidelity.aligned_counts(df.where(s | g), "o_orderpriority", s)


@query("set_union_cat", "SELECT o_orderpriority AS value FROM orders UNION SELECT c_mktsegment FROM customer")
def set_union_cat(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value"))
    return a.union(table(spark, sf_dir, "customer").select("c_mktsegment")).distinct()


_KEYS = ", ".join(KEY)
_NEAR = f"""WITH g AS (SELECT * FROM lineitem WHERE l_returnflag = 'N' ORDER BY {_KEYS}), s AS (SELECT * FROM lineitem WHERE l_returnflag = 'R' ORDER BY {_KEYS}),
r AS (SELECT max(l_quantity) - min(l_quantity) AS rq, max(l_discount) - min(l_discount) AS rd FROM s),
d AS (SELECT g.l_orderkey, g.l_linenumber, g.l_partkey, g.l_suppkey, g.l_shipdate, g.l_extendedprice, min(greatest(abs(g.l_quantity - s.l_quantity) / rq, abs(g.l_discount - s.l_discount) / rd, CASE WHEN g.l_linestatus = s.l_linestatus THEN 0 ELSE 1 END)) AS distance FROM g, s, r GROUP BY ALL)
SELECT {_KEYS}, round(distance, 6) AS distance FROM d WHERE distance <= 0.05"""


@query("fid_near", _NEAR)
def fid_near(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    out = fidelity.near_copies(df.where("l_returnflag = 'N'"), df.where("l_returnflag = 'R'"), KEY, ["l_quantity", "l_discount"], ["l_linestatus"], 0.05)
    return out.select(*KEY, F.round("distance", 6).alias("distance"))


query("fid_near_all", _NEAR)(fid_near)

_CUSTOMERS = "WITH c AS (SELECT *, c_custkey % 2 = 0 AS s FROM customer), x AS (SELECT count(*) AS n, max(c_acctbal) - min(c_acctbal) AS w, max(c_nationkey) - min(c_nationkey) AS v FROM c WHERE s)"
_CUSTOMERS_NEAR = "SELECT m.c_custkey, min(greatest(abs(m.c_acctbal - r.c_acctbal) / w, abs(m.c_nationkey - r.c_nationkey) / v, CASE WHEN m.c_mktsegment = r.c_mktsegment THEN 0 ELSE 1 END)) AS d FROM c m, c r, x WHERE NOT m.s AND r.s GROUP BY 1"


@query("jn_near", f"{_CUSTOMERS} SELECT c_custkey, round(d, 6) AS distance FROM ({_CUSTOMERS_NEAR}) WHERE d <= 0.02")
def jn_near(spark, sf_dir):
    """Customers of odd keys within 0.02 of one of even key, in balance, nation and segment."""
    df = table(spark, sf_dir, "customer")
    out = fidelity.near_copies(df.where("c_custkey % 2 <> 0"), df.where("c_custkey % 2 = 0"), ["c_custkey"], ["c_acctbal", "c_nationkey"], ["c_mktsegment"], 0.02)
    return out.select("c_custkey", F.round("distance", 6).alias("distance"))


def _ks(c: str) -> str:
    return f"""SELECT 'ks' AS measure, '{c}' AS "column", max(abs(ca / (SELECT count(*) FROM c WHERE s) - cb / (SELECT count(*) FROM c WHERE NOT s))) AS value FROM (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb FROM (SELECT {c} AS v, count(*) FILTER (s) AS a, count(*) FILTER (NOT s) AS b FROM c GROUP BY 1))"""


@query(
    "fid_report",
    f"""{_CUSTOMERS}, k AS (SELECT c_mktsegment AS v, count(*) FILTER (s) AS a, count(*) FILTER (NOT s) AS b FROM c GROUP BY 1), e AS (SELECT v, b, greatest(a / sum(a) OVER () * sum(b) OVER (), 0.5) AS e, sum(b) OVER () AS n FROM k),
f AS (SELECT b, e * n / sum(e) OVER () AS e FROM e), g AS (SELECT count(*) AS n FROM c WHERE NOT s GROUP BY c_acctbal, c_nationkey, c_mktsegment), t AS (SELECT 0.05::DOUBLE * pow(n, -0.5) AS near FROM x)
SELECT measure, "column", round(value, 6) AS value FROM ({_ks("c_acctbal")} UNION ALL {_ks("c_nationkey")} UNION ALL SELECT 'chi2', 'c_mktsegment', sum((b - e) ** 2 / e) FROM f
UNION ALL SELECT 'correlation_drift', NULL, abs(corr(c_acctbal, c_nationkey) FILTER (s) - corr(c_acctbal, c_nationkey) FILTER (NOT s)) FROM c
UNION ALL SELECT 'duplicates', NULL, sum(n - 1) FROM g UNION ALL SELECT 'duplicates_share', NULL, sum(n - 1) / sum(n) FROM g
UNION ALL SELECT 'near_copies', NULL, count(*) FROM ({_CUSTOMERS_NEAR}), t WHERE d <= near
UNION ALL SELECT 'dropped', NULL, 5 UNION ALL SELECT 'dropped_share', NULL, 5 / (SELECT count(*) + 5 FROM c WHERE NOT s) UNION ALL SELECT 'derived_profile', NULL, 0
UNION ALL SELECT 'wanted:BUILDING', 'c_mktsegment', 0.5 UNION ALL SELECT 'made:BUILDING', 'c_mktsegment', avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END) FROM c WHERE NOT s)""",
)
def fid_report(spark, sf_dir):
    """The customers of odd keys as if they were made from those of even keys."""
    df = table(spark, sf_dir, "customer").withColumn("s", F.col("c_custkey") % 2 == 0)
    n = df.where("not s").count()
    out = fidelity.report(df, F.col("s"), ["c_acctbal", "c_nationkey"], ["c_mktsegment"], ["c_custkey"], {"c_mktsegment": {"BUILDING": 0.5}}, dropped=5, asked=n + 5)
    return out.select("measure", "column", F.round("value", 6).alias("value"))


@query("agg_balance", "SELECT v AS value, w AS wanted, (SELECT avg(CASE WHEN l_returnflag = v THEN 1.0 ELSE 0.0 END) FROM lineitem) AS actual FROM (VALUES ('A', 0.25), ('N', 0.5), ('R', 0.25)) t(v, w)".replace("0.25)", "CAST(0.25 AS DOUBLE))").replace("0.5)", "CAST(0.5 AS DOUBLE))"))
def agg_balance(spark, sf_dir):
    return fidelity.balance(table(spark, sf_dir, "lineitem"), "l_returnflag", {"A": 0.25, "N": 0.5, "R": 0.25})


@query("win_midrank", "WITH c AS (SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT value, sum(n) OVER (ORDER BY value) - n AS below, n, sum(n) OVER () AS t FROM c) SELECT value, round((below + (n + 1) / 2) / (t + 1), 9) AS u FROM r")
def win_midrank(spark, sf_dir):
    return synth.mid_ranks(table(spark, sf_dir, "lineitem"), "l_quantity").select("value", F.round("u", 9).alias("u"))


@query("win_cumfreq", "SELECT v AS value, sum(n) OVER (ORDER BY v) / sum(n) OVER () AS share FROM (SELECT c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1)")
def win_cumfreq(spark, sf_dir):
    return fidelity.cumulative_shares(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("gen_sample")
def gen_sample(spark, sf_dir):
    """As many synthetic rows as ``customer`` has, from a copula fitted on it."""
    df = table(spark, sf_dir, "customer")
    model = synth.fit(df, ["c_nationkey", "c_acctbal", "c_mktsegment"])
    return synth.sample(spark, model, df.count(), seed=5)


@query("gen_balance")
def gen_balance(spark, sf_dir):
    drawn = gen_sample(spark, sf_dir)
    return synth.balanced(drawn, "c_mktsegment", {"BUILDING": 0.5, "MACHINERY": 0.5}, 100)
