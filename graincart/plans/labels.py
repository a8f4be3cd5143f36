"""Evaluator answers, provenance and review over ``documents``; the metadata joins of checks over ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from graincart.operators import checks, labeling, review
from graincart.plans.registry import query, table

_DRAW = "concat('0x', substr(sha256({}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0"
_P = f"least(greatest(0.5 + ({_DRAW.format("doc_id || '::spam'")} - 0.5) * 1.8, 0.001), 0.999)"


def _state():
    return F.col("doc_id").cast("string")


@query("lab_fake", f"WITH p AS (SELECT doc_id, {_P} AS p FROM documents) SELECT doc_id, p >= 0.5 AS spam, p, 2 * abs(p - 0.5) AS confidence FROM p")
def lab_fake(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", labeling.binary_answer(_state(), "spam").alias("a"))
    return df.select("doc_id", F.col("a.answer").alias("spam"), "a.p", "a.confidence")


query("lab_normalize", f"WITH p AS (SELECT doc_id, {_P} AS p FROM documents) SELECT doc_id, p >= 0.5 AS spam, p, 2 * abs(p - 0.5) AS confidence FROM p")(lab_fake)

_W = {o: _DRAW.format(f"doc_id || '::tone::{o}'") + " + 0.01" for o in ("pos", "neg", "flat")}


@query("lab_values", f"WITH w AS (SELECT doc_id, {', '.join(f'{x} AS {o}' for o, x in _W.items())} FROM documents), s AS (SELECT doc_id, pos / (pos + neg + flat) AS p_pos, neg / (pos + neg + flat) AS p_neg, flat / (pos + neg + flat) AS p_flat FROM w) SELECT doc_id, CASE WHEN p_pos >= p_neg AND p_pos >= p_flat THEN 'pos' WHEN p_neg >= p_flat THEN 'neg' ELSE 'flat' END AS tone, greatest(p_pos, p_neg, p_flat) AS tone__confidence, p_pos AS tone__p_pos, p_neg AS tone__p_neg, p_flat AS tone__p_flat FROM s")
def lab_values(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", labeling.choice_answer(_state(), "tone", ["pos", "neg", "flat"]).alias("a"))
    return df.select("doc_id", F.col("a.answer").alias("tone"), F.col("a.confidence").alias("tone__confidence"), *[F.col("a.shares")[o].alias(f"tone__p_{o}") for o in ("pos", "neg", "flat")])


def labeled(spark, sf_dir):
    """``documents`` with an evaluator's label; every seventh has none and every fifth is reviewed."""
    a = labeling.binary_answer(_state(), "spam")
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("__row_id__"), a.alias("a"))
    missing = F.col("__row_id__") % 7 == 0
    origin = F.when(F.col("__row_id__") % 5 == 0, "human_reviewed").otherwise("evaluator")
    given = F.concat(F.lit('{"row_origin":"uploaded","label_origins":{"spam":{"origin":"'), origin, F.lit('"}}}'))
    return df.select(
        "__row_id__",
        F.when(~missing, F.col("a.answer")).alias("spam"),
        F.when(~missing, F.col("a.confidence")).alias("spam__confidence"),
        F.when(missing, '{"row_origin":"synthetic"}').when(F.col("__row_id__") % 11 == 0, F.lit(None)).otherwise(given).alias("__provenance__"),
    )


_LABELED = f"""WITH p AS (SELECT doc_id AS i, {_P} AS p FROM documents), l AS (SELECT i, CASE WHEN i % 7 <> 0 THEN p >= 0.5 END AS spam, CASE WHEN i % 7 <> 0 THEN 2 * abs(p - 0.5) END AS c,
CASE WHEN i % 7 = 0 THEN 'synthetic' WHEN i % 11 = 0 THEN 'uploaded' WHEN i % 5 = 0 THEN 'human_reviewed' ELSE 'evaluator' END AS bucket FROM p)"""


@query("agg_prov", f"{_LABELED} SELECT b AS bucket, count(bucket) AS n FROM (VALUES ('uploaded'), ('synthetic'), ('evaluator'), ('human_reviewed')) v(b) LEFT JOIN l ON b = bucket GROUP BY 1")
def agg_prov(spark, sf_dir):
    return labeling.breakdown(labeled(spark, sf_dir))


_QUEUE = f"{_LABELED}, q AS (SELECT i, spam, CASE WHEN c IS NOT NULL THEN least(greatest(2 * abs(c - 0.5), 0.0), 1.0) END AS c FROM l WHERE bucket <> 'human_reviewed')"


@query("rev_queue", f"{_QUEUE} SELECT i AS \"row\", 'spam' AS family, CAST(spam AS VARCHAR) AS answer, c AS confidence, CASE WHEN c IS NULL THEN 'unlabeled' ELSE 'queued' END AS state FROM q WHERE c IS NULL OR c < 0.6")
def rev_queue(spark, sf_dir):
    df = labeled(spark, sf_dir)
    return labeling.review_queue(df, labeling.families(df.columns), 0.6)


@query("agg_review", f"{_QUEUE} SELECT count(*) FILTER (c IS NULL) AS unlabeled, count(*) FILTER (c < 0.6) AS queued FROM q")
def agg_review(spark, sf_dir):
    return rev_queue(spark, sf_dir).agg(F.count_if(F.col("state") == "unlabeled").alias("unlabeled"), F.count_if(F.col("state") == "queued").alias("queued"))


@query("lim_queue", f"{_QUEUE} SELECT i AS \"row\" FROM q WHERE c IS NULL OR c < 0.6 ORDER BY i LIMIT 50")
def lim_queue(spark, sf_dir):
    return rev_queue(spark, sf_dir).orderBy("row").limit(50).select("row")


@query("flt_unreviewed", f"{_LABELED} SELECT i AS \"row\" FROM l WHERE bucket = 'evaluator' AND (c IS NULL OR c < 0.5)")
def flt_unreviewed(spark, sf_dir):
    hit = labeling.unreviewed(F.col("__provenance__"), "spam", F.col("spam__confidence"), 0.5)
    return labeled(spark, sf_dir).where(hit).select(F.col("__row_id__").alias("row"))


@query("rev_apply", f"""{_LABELED} SELECT i AS "row", CASE WHEN i % 13 = 1 THEN true ELSE spam END AS spam, CASE WHEN i % 13 = 1 THEN 1.0 ELSE c END AS confidence, i % 13 = 2 AS excluded,
CASE WHEN i % 13 IN (0, 1) THEN 'human_reviewed' ELSE bucket END AS bucket FROM l""")
def rev_apply(spark, sf_dir):
    df = labeled(spark, sf_dir)
    rest = F.col("row") % 13
    decisions = df.select(F.col("__row_id__").alias("row")).where(rest < 3)
    decisions = decisions.select("row", F.lit("spam").alias("family"), F.when(rest == 0, "accept").when(rest == 1, "override").otherwise("exclude").alias("action"), F.lit("true").alias("value"), F.lit(None).cast("string").alias("note"))
    out = review.apply_decisions(df, decisions, {"spam": "binary"})
    return out.select(F.col("__row_id__").alias("row"), "spam", F.col("spam__confidence").alias("confidence"), F.col("__excluded__").alias("excluded"), labeling.origin_bucket(F.col("__provenance__")).alias("bucket"))


@query("agg_labels_cov", f"{_LABELED} SELECT count(spam) AS labeled, count(*) - count(spam) AS failed FROM l")
def agg_labels_cov(spark, sf_dir):
    return labeled(spark, sf_dir).agg(F.count("spam").alias("labeled"), F.count_if(F.col("spam").isNull()).alias("failed"))


@query("set_except_rows", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def set_except_rows(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("__row_id__"))
    done = df.where("__row_id__ % 3 = 0").withColumn("failed", F.lit(False))
    return labeling.unanswered(df, done).select(F.col("__row_id__").alias("doc_id"))


def _answer(state: str) -> dict:
    return {"length": len(state)}


@query("lab_call", r"SELECT c_custkey AS row, length('c_name: ' || c_name || chr(10) || 'c_mktsegment: ' || c_mktsegment) AS length, false AS failed FROM customer")
def lab_call(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("__row_id__", F.col("c_custkey"))
    out = labeling.label_rows(df, _answer, ["c_name", "c_mktsegment"], "length bigint")
    return out.select(F.col("__row_id__").alias("row"), "length", "failed")


_CHECKS = "WITH c AS (SELECT o_orderkey AS check_id, o_orderpriority AS kind, o_custkey AS subject, CASE WHEN o_orderstatus = 'F' THEN 'warning' ELSE 'info' END AS severity FROM orders), a AS (SELECT o_orderkey AS check_id, 'seen ' || o_orderkey AS note FROM orders WHERE o_orderkey % 4 = 0)"


def _checks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = o.select(F.col("o_orderkey").alias("check_id"), F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("subject"), F.when(F.col("o_orderstatus") == "F", "warning").otherwise("info").alias("severity"))
    return c, o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("check_id"), F.concat(F.lit("seen "), F.col("o_orderkey").cast("string")).alias("note"))


@query("jn_checks_ack", f"{_CHECKS} SELECT c.*, note, note IS NOT NULL AS acknowledged FROM c LEFT JOIN a USING (check_id)")
def jn_checks_ack(spark, sf_dir):
    return checks.with_acknowledgement(*_checks(spark, sf_dir))


@query("jn_unack", f"{_CHECKS} SELECT c.* FROM c ANTI JOIN a USING (check_id) WHERE severity = 'warning'")
def jn_unack(spark, sf_dir):
    return checks.open_warnings(*_checks(spark, sf_dir))


@query("jn_exists", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey = 7) AS found")
def jn_exists(spark, sf_dir):
    c, _ = _checks(spark, sf_dir)
    return c.where((F.col("kind") == "1-URGENT") & (F.col("subject") == 7)).agg((F.count("*") > 0).alias("found"))


@query("jn_parent", "SELECT c.r_regionkey AS id, c.r_name AS name, p.r_name AS parent FROM region c LEFT JOIN region p ON p.r_regionkey = c.r_regionkey - 1")
def jn_parent(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    p = r.select((F.col("r_regionkey") + 1).alias("r_regionkey"), F.col("r_name").alias("parent"))
    return r.join(p, "r_regionkey", "left").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), "parent")


def _families(spark, sf_dir):
    """``documents`` with a choice and a score of an evaluator, and its provenance."""
    i = F.col("doc_id")
    df = table(spark, sf_dir, "documents").select(i.alias("__row_id__"), F.when(i % 2 == 0, "pos").otherwise("neg").alias("tone"), F.lit(0.8).alias("tone__confidence"))
    row = F.col("__row_id__")
    df = df.withColumn("tone__p_pos", F.when(row % 2 == 0, 0.8).otherwise(0.2)).withColumn("tone__p_neg", F.when(row % 2 == 0, 0.2).otherwise(0.8))
    df = df.withColumn("rate", (row % 5 + 1).cast("double")).withColumn("rate__probabilities", F.concat(F.lit('{"'), (row % 5 + 1).cast("string"), F.lit('":0.9}')))
    return df.withColumn("__provenance__", F.lit('{"row_origin":"uploaded","label_origins":{"tone":{"origin":"evaluator","confidence":0.8},"rate":{"origin":"evaluator"}}}'))


_KINDS = {"tone": "choice", "rate": "score"}


def _decisions(df):
    """Of each thirteen rows one is accepted, one gets another choice, one another score, and one is excluded beside an override."""
    said = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(f).alias("family"), F.lit(a).alias("action"), F.lit(v).cast("string").alias("value"), F.lit(n).cast("string").alias("note")) for r, f, a, v, n in (
        (0, "tone", "accept", None, "ok"), (1, "tone", "override", "pos", None), (2, "rate", "override", "2.5", None), (3, "rate", "override", "4", None), (4, "tone", "override", "neg", None), (4, "rate", "exclude", None, None))])
    return df.select(F.col("__row_id__").alias("row"), F.explode(said).alias("d")).where("row % 13 = d.r").select("row", "d.family", "d.action", "d.value", "d.note")


@query("rev_apply_all", """SELECT i AS "row", CASE WHEN m = 1 THEN 'pos' WHEN i % 2 = 0 THEN 'pos' ELSE 'neg' END AS tone, CASE WHEN m = 1 THEN 1.0 ELSE 0.8 END AS sure,
CASE WHEN m = 1 THEN 1.0 WHEN i % 2 = 0 THEN 0.8 ELSE 0.2 END AS p_pos, CASE WHEN m = 1 THEN 0.0 WHEN i % 2 = 0 THEN 0.2 ELSE 0.8 END AS p_neg,
CAST(CASE m WHEN 2 THEN 2.5 WHEN 3 THEN 4 ELSE i % 5 + 1 END AS DOUBLE) AS rate, CASE m WHEN 2 THEN '{"2.5":1.0}' WHEN 3 THEN '{"4":1.0}' ELSE '{"' || i % 5 + 1 || '":0.9}' END AS probabilities,
m = 4 AS excluded, CASE WHEN m IN (0, 1, 2, 3) THEN 'human_reviewed' ELSE 'evaluator' END AS bucket FROM (SELECT doc_id AS i, doc_id % 13 AS m FROM documents)""".replace("i % 5 + 1 ||", "(i % 5 + 1) ||").replace("CASE WHEN m = 1 THEN 1.0 ELSE 0.8 END AS sure", "CAST(CASE WHEN m = 1 THEN 1.0 ELSE 0.8 END AS DOUBLE) AS sure").replace("CASE WHEN m = 1 THEN 1.0 WHEN i % 2 = 0 THEN 0.8 ELSE 0.2 END", "CAST(CASE WHEN m = 1 THEN 1.0 WHEN i % 2 = 0 THEN 0.8 ELSE 0.2 END AS DOUBLE)").replace("CASE WHEN m = 1 THEN 0.0 WHEN i % 2 = 0 THEN 0.2 ELSE 0.8 END", "CAST(CASE WHEN m = 1 THEN 0.0 WHEN i % 2 = 0 THEN 0.2 ELSE 0.8 END AS DOUBLE)"))
def rev_apply_all(spark, sf_dir):
    df = _families(spark, sf_dir)
    out = review.apply_decisions(df, _decisions(df), _KINDS)
    return out.select(F.col("__row_id__").alias("row"), "tone", F.col("tone__confidence").alias("sure"), F.col("tone__p_pos").alias("p_pos"), F.col("tone__p_neg").alias("p_neg"), "rate", F.col("rate__probabilities").alias("probabilities"), F.col("__excluded__").alias("excluded"), labeling.origin_bucket(F.col("__provenance__")).alias("bucket"))


@query("rev_validate", """SELECT doc_id AS "row", CASE doc_id % 7 WHEN 1 THEN '' WHEN 5 THEN 'rate' WHEN 3 THEN 'mood' ELSE 'tone' END AS family, CASE doc_id % 7 WHEN 0 THEN 'unknown action' WHEN 1 THEN 'no family' WHEN 2 THEN 'no new answer' WHEN 3 THEN 'unknown family' ELSE 'not a number' END AS problem
FROM documents WHERE doc_id % 7 IN (0, 1, 2, 3, 5)""")
def rev_validate(spark, sf_dir):
    row, rest = F.col("doc_id"), F.col("doc_id") % 7
    family = F.when(rest == 1, "").when(rest == 5, "rate").when(rest == 3, "mood").otherwise("tone")
    action = F.when(rest == 0, "delete").when(rest.isin(1, 3), "accept").when(rest == 4, "exclude").otherwise("override")
    value = F.when(rest == 2, " ").otherwise("good")
    return review.invalid_decisions(table(spark, sf_dir, "documents").select(row.alias("row"), family.alias("family"), action.alias("action"), value.alias("value")), _KINDS)


@query("rev_check", f"{_QUEUE} SELECT 'unreviewed_labels' AS kind, 'warning' AS severity, 'documents' AS subject, count(DISTINCT i) AS \"rows\" FROM q WHERE c IS NULL OR c < 0.6 HAVING count(*) > 0")
def rev_check(spark, sf_dir):
    return review.unreviewed_check(rev_queue(spark, sf_dir), "documents")


@query("lab_apply", f"""WITH p AS (SELECT doc_id AS i, {_P} AS p FROM documents) SELECT i AS "row", CASE WHEN i % 7 <> 0 AND i % 3 <> 0 THEN p >= 0.5 END AS spam, CASE WHEN i % 7 <> 0 AND i % 3 <> 0 THEN 2 * abs(p - 0.5) END AS confidence,
CASE WHEN i % 2 = 0 THEN 'human_reviewed' WHEN i % 7 <> 0 AND i % 3 <> 0 THEN 'evaluator' ELSE 'synthetic' END AS bucket FROM p""")
def lab_apply(spark, sf_dir):
    a = labeling.binary_answer(_state(), "spam")
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id").alias("__row_id__")
    # every third row was not asked, every seventh failed, and half of the rows have another family that was reviewed
    answers = docs.where("doc_id % 3 <> 0").select(key, a["answer"].alias("spam"), a["confidence"].alias("spam__confidence"), (F.col("doc_id") % 7 == 0).alias("failed"))
    old = F.when(F.col("doc_id") % 2 == 0, '{"row_origin":"synthetic","label_origins":{"tone":{"origin":"human_reviewed"}}}').otherwise('{"row_origin":"synthetic"}')
    out = review.apply_answers(docs.select(key, old.alias("__provenance__")), answers, ["spam"])
    return out.select(F.col("__row_id__").alias("row"), "spam", F.col("spam__confidence").alias("confidence"), labeling.origin_bucket(F.col("__provenance__")).alias("bucket"))


@query("fr_positive", "SELECT max(lang) AS positive FROM documents")
def fr_positive(spark, sf_dir):
    return review.positive_class(table(spark, sf_dir, "documents"), "lang")
