"""Text functions and detectors over documents and other text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from graincart.functions import pii, text
from graincart.operators import pii as scans
from graincart.operators import prep
from graincart.plans.registry import query, table

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query("prj_state", r"SELECT c_custkey, 'c_name: ' || trim(regexp_replace(c_name, '\s+', ' ', 'g')) || chr(10) || 'c_mktsegment: ' || trim(regexp_replace(c_mktsegment, '\s+', ' ', 'g')) || chr(10) || rtrim('note: ' || coalesce(nullif(c_mktsegment, 'BUILDING'), '')) AS state FROM customer")
def prj_state(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("note", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return df.select("c_custkey", text.rendered_row(["c_name", "c_mktsegment", "note"]).alias("state"))


@query("fn_tokenize", f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n, md5(array_to_string({_TOKENS}, ' ')) AS digest FROM documents")
def fn_tokenize(spark, sf_dir):
    words = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n"), F.md5(F.array_join(words, " ")).alias("digest"))


_GRAMS = "list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"


@query("fn_ngrams", f"WITH w AS (SELECT doc_id, {_TOKENS} AS w FROM documents) SELECT doc_id, array_to_string({_GRAMS}, '|') AS grams FROM w")
def fn_ngrams(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.array_join(text.ngrams(F.col("w"), 1, 2), "|").alias("grams"))


@query("agg_docfreq", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1")
def agg_docfreq(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df"))


@query("topk_vocab", f"SELECT term, df FROM (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1) WHERE df >= 2 ORDER BY df DESC, term LIMIT 2000")
def topk_vocab(spark, sf_dir):
    return agg_docfreq(spark, sf_dir).where("df >= 2").orderBy(F.desc("df"), "term").limit(2000)


@query("pre_tfidf", f"""WITH w AS (SELECT doc_id AS key, {_TOKENS} AS w FROM documents), g AS (SELECT key, {_GRAMS} AS g FROM w), t AS (SELECT key, len(g) AS total, unnest(g) AS term FROM g),
c AS (SELECT key, total, term, count(*) AS n FROM t GROUP BY ALL), v AS (SELECT term, count(*) AS df FROM c WHERE key % 5 <> 0 GROUP BY 1 ORDER BY df DESC, term LIMIT 2000),
r AS (SELECT key, c.term, n / total * (ln((1 + (SELECT count(*) FROM w WHERE key % 5 <> 0)) / (1 + df)) + 1) AS raw FROM c JOIN v USING (term))
SELECT key, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY key)), 6) AS weight FROM r""")
def pre_tfidf(spark, sf_dir):
    out = prep.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text", F.col("doc_id") % 5 != 0, high=2)
    return out.select("key", "term", F.round("weight", 6).alias("weight"))


@query("fn_option_slug", r"SELECT DISTINCT p_type, 'p_' || lower(trim(regexp_replace(p_type || ' / ' || p_brand, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS slug FROM part")
def fn_option_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type", text.option_slug(F.concat("p_type", F.lit(" / "), "p_brand")).alias("slug")).distinct()


@query("fn_snake", r"SELECT p_partkey, lower(trim(regexp_replace(p_name || ' #', '[^A-Za-z0-9]+', '_', 'g'), '_')) AS name FROM part")
def fn_snake(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.snake_name(F.concat("p_name", F.lit(" #"))).alias("name"))


@query("fn_family", "SELECT DISTINCT split_part(c_mktsegment || '__p_' || lower(c_mktsegment), '__', 1) AS family FROM customer")
def fn_family(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(text.family_of(F.concat("c_mktsegment", F.lit("__p_"), F.lower("c_mktsegment"))).alias("family")).distinct()


@query("fn_value_key", "SELECT p_partkey, 'int:' || p_size AS size_key, CASE WHEN nullif(p_type, 'ECONOMY') IS NULL THEN 'missing' ELSE 'str:' || p_type END AS type_key, CASE WHEN p_size > 25 THEN 'bool:True' ELSE 'bool:False' END AS flag_key, format('num:{:.6g}', p_retailprice * 1.3) AS price_key FROM part")
def fn_value_key(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("t", F.nullif(F.col("p_type"), F.lit("ECONOMY"))).withColumn("b", F.col("p_size") > 25)
    return df.select("p_partkey", text.value_key(F.col("p_size"), "integer").alias("size_key"), text.value_key(F.col("t"), "text").alias("type_key"), text.value_key(F.col("b"), "bool").alias("flag_key"), text.value_key(F.col("p_retailprice") * 1.3, "number").alias("price_key"))


@query("fn_readable", "SELECT DISTINCT p_size AS k, CAST(p_size AS VARCHAR) AS readable FROM part")
def fn_readable(spark, sf_dir):
    key = text.value_key(F.col("p_size"), "integer")
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("k"), text.readable_key(key).alias("readable")).distinct()


@query("fn_hash_draw", "SELECT doc_id, concat('0x', substr(sha256(doc_id || '::toxic'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS draw FROM documents")
def fn_hash_draw(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.hash_draw(F.concat(F.col("doc_id").cast("string"), F.lit("::toxic"))).alias("draw"))


def _count(name: str):
    def run(spark, sf_dir):
        found = F.size(pii.matches(F.col("text"), pii.BY_NAME[name])).cast("long")
        return table(spark, sf_dir, "documents").select("doc_id", found.alias("n")).where("n > 0")

    return run


# The SQL says the same rules without looking around a match. A run of the characters that a guard forbids cannot be
# cut, so addresses and numbers are whole runs; elsewhere each character that may stand between two matches comes twice.
_RUN = r"list_filter(regexp_extract_all(text, '{}'), lambda x: {})"
_EMAIL = r"regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')"
_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = _RUN.format("[0-9.]+", rf"regexp_full_match(x, '{_BYTE}(?:\.{_BYTE}){{3}}')")
_GROUPS = r"string_split(x, '-')"
_SSN = (
    r"flatten(list_transform(regexp_extract_all(text, '[0-9]+(?:-[0-9]+)+'), lambda x: list_filter(range(1, len(@) - 1), lambda i: length(@[i]) = 3 AND length(@[i + 1]) = 2 "
    r"AND length(@[i + 2]) = 4 AND @[i] NOT IN ('000', '666') AND @[i][1] <> '9')))"
).replace("@", _GROUPS)
_TWICE = r"regexp_replace(text, '([^0-9.])', '\1\1', 'g')"
_GAP = r"(?:\s\s|--|\.)"
_PHONE = rf"regexp_extract_all({_TWICE}, '(?:^|[^0-9.])((?:\+\+1{_GAP}?|1(?:  |--))?(?:(?:\(\()?[2-9][0-9]{{2}}(?:\)\))?{_GAP}[0-9]{{3}}{_GAP}[0-9]{{4}}|[2-9][0-9]{{9}}))(?:$|[^0-9.])', 1)"
_SUM = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INT) WHEN d[i] > '4' THEN 2 * CAST(d[i] AS INT) - 9 ELSE 2 * CAST(d[i] AS INT) END))"
_CARDS = rf"list_transform(regexp_extract_all({_TWICE}, '(?:^|[^0-9.])((?:[0-9](?:  |--)?){{12,18}}[0-9])(?:$|[^0-9.])', 1), lambda x: regexp_replace(x, '[^0-9]', '', 'g'))"
_CARD = f"list_filter({_CARDS}, lambda d: {_SUM} % 10 = 0)"
_FOUND = {"email": _EMAIL, "phone": _PHONE, "ssn": _SSN, "credit_card": _CARD, "ip": _IP}
for _name, _query in (("email", "fn_email"), ("phone", "fn_phone"), ("ssn", "fn_ssn"), ("credit_card", "fn_card"), ("ip", "fn_ip")):
    query(_query, f"SELECT doc_id, n FROM (SELECT doc_id, CAST(len({_FOUND[_name]}) AS BIGINT) AS n FROM documents) WHERE n > 0")(_count(_name))


@query("fn_ssn_made", f"WITH t AS (SELECT o_orderkey, {{}} AS text FROM orders) SELECT o_orderkey, CAST(len({_SSN}) AS BIGINT) AS n FROM t".format(
    "lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(o_orderkey % 89 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey * 7 % 10000 AS VARCHAR), 4 + CAST(o_orderkey % 7 = 0 AS INT), '0') || ', 123-45-6789'"))
def fn_ssn_made(spark, sf_dir):
    key = F.col("o_orderkey")
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
    last = F.when(key % 7 == 0, padded(key * 7 % 10000, 5)).otherwise(padded(key * 7 % 10000, 4))
    made = F.concat_ws("-", padded(key % 1000, 3), padded(key % 89, 2), last)
    n = F.size(pii.matches(F.concat(made, F.lit(", 123-45-6789")), pii.BY_NAME["ssn"])).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"))


@query("fn_luhn", """WITH d AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + 17 AS VARCHAR), 12, '3') AS s FROM orders)
SELECT o_orderkey, (SELECT sum(CASE WHEN (length(s) - i) % 2 = 0 THEN CAST(substr(s, i, 1) AS INT) ELSE CASE WHEN 2 * CAST(substr(s, i, 1) AS INT) > 9 THEN 2 * CAST(substr(s, i, 1) AS INT) - 9 ELSE 2 * CAST(substr(s, i, 1) AS INT) END END) FROM (SELECT unnest(range(1, 13)) AS i)) % 10 = 0 AS valid FROM d""")
def fn_luhn(spark, sf_dir):
    digits = F.lpad((F.col("o_orderkey") * 7919 + 17).cast("string"), 12, "3")
    return table(spark, sf_dir, "orders").select("o_orderkey", pii.luhn(digits).alias("valid"))


@query("fn_mask", "SELECT c_custkey, substr(c_name, 1, 1) || '***' AS name, substr(c_mktsegment, 1, 1) || '***' || CASE WHEN c_nationkey > 4 THEN '.co' || c_nationkey ELSE '' END AS mail FROM customer")
def fn_mask(spark, sf_dir):
    # addresses with a dot before the @, and some whose host has none
    host = F.when(F.col("c_nationkey") > 4, F.concat(F.lit("example.co"), F.col("c_nationkey").cast("string"))).otherwise("localhost")
    mail = F.concat("c_mktsegment", F.lit(".x@"), host)
    return table(spark, sf_dir, "customer").select("c_custkey", text.masked(F.col("c_name")).alias("name"), text.masked(mail).alias("mail"))


@query("fn_redact")
def fn_redact(spark, sf_dir):
    out = scans.mask_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"])
    return out.select("doc_id", F.md5("text").alias("digest"), F.col("text__replaced").alias("replaced"))


_CELLS = "WITH c AS (" + " UNION ALL ".join(f"SELECT doc_id, '{d}' AS detector, CAST(len({sql}) AS BIGINT) AS n FROM documents" for d, sql in _FOUND.items()) + "), "
_CELLS += "a AS (SELECT 'text' AS \"column\", detector, CAST(sum(n) AS BIGINT) AS spans, count(*) AS rows_with, array_agg(doc_id ORDER BY doc_id)[1:5] AS ids FROM c WHERE n > 0 GROUP BY 2)"


@query("agg_pii", _CELLS + " SELECT \"column\", detector, spans, rows_with, array_to_string(ids, ',') AS first_rows FROM a")
def agg_pii(spark, sf_dir):
    found = scans.findings(table(spark, sf_dir, "documents"), "doc_id", ["text"])
    return found.select("column", "detector", "spans", "rows_with", F.concat_ws(",", F.transform("row_examples", lambda x: x.cast("string"))).alias("first_rows"))


@query("agg_pii_sum", _CELLS + " SELECT \"column\", CAST(sum(spans) AS BIGINT) AS spans, count(*) AS detectors, arg_max(detector, spans * 10 - list_position(['email', 'phone', 'ssn', 'credit_card', 'ip'], detector)) AS \"primary\" FROM a GROUP BY 1")
def agg_pii_sum(spark, sf_dir):
    return scans.primary_detectors(scans.counts(table(spark, sf_dir, "documents"), ["text"]))
