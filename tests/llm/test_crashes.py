"""Rows that once ended a job or came back changed."""

import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graincart.llm import langid, media, minhash, oracle, pii, quality, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "la", "s", len(t or "")) for i, t in enumerate(rows)], DOCS)


def test_addresses_with_very_many_zeros(spark):
    texts = ["0" * 10_000 + "1.2.3.4", "1." + "0" * 10_000 + ".3.4", "9" * 10_000 + ".2.3.4", "ip 1.2.3.4"]
    out = {r["doc_id"]: r["n_ip"] for r in pii.personal_data_digests(docs_of(spark, texts)).collect()}
    assert out == {0: 1, 1: 1, 2: 0, 3: 1}
    assert sys.get_int_max_str_digits() < 10_000


PGP = "-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: GnuPG v1.4 - x\nComment: a-b\n\n" + "\n".join("lQOYBF" + "Ab3+/9" * 9 for _ in range(6)) + "\n=Qb1z\n"


@pytest.mark.parametrize("end", ["-----END PGP PRIVATE KEY BLOCK-----", ""])
def test_keys_of_pgp(spark, end):
    text = f"before it\n{PGP}{end}\nafter it, and nothing is lost"
    out = secrets.redact_secrets(docs_of(spark, [text])).first()["text"]
    assert "lQOYBF" not in out and "BEGIN" not in out and out.startswith("before it\n[SECRET]") and out.endswith("after it, and nothing is lost")
    con = duckdb.connect()
    con.register("documents", docs_of(spark, [text]).toPandas())
    assert con.sql(oracle.secrets_sql()).fetchall()[0][-1] == secrets.secret_digests(docs_of(spark, [text])).first()["spans"]


def carried(spark, texts):
    """Documents with columns of many types, nulls beside numbers that no float holds, and clashing names."""
    docs = docs_of(spark, texts).withColumn("n_chars", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")))
    big = F.when(F.col("doc_id") % 3 != 0, F.lit(2**53 + 1) + F.col("doc_id"))
    more = {
        "big": big, "score": big, "_chars_before_redaction": big, "_before": big, "text_hash": big, "group": F.lit("mine"), "accepted": F.lit(None).cast("boolean"),
        "at": F.when(F.col("doc_id") % 2 == 1, F.expr("timestamp'2024-02-29 12:34:56.789012'")), "day": F.expr("date'1900-01-01'"), "price": F.expr("cast(12345678901234567890.12 as decimal(30,2))"),
        "many": F.array(big, F.lit(None).cast("long")), "pair": F.struct(big.alias("x"), F.lit("é").alias("y")), "raw": F.unhex(F.lit("00ff")), "flag": F.when(F.col("doc_id") % 2 == 0, F.lit(True)),
    }
    return docs.withColumns(more)


def test_stages_return_other_columns_bit_for_bit(spark):
    docs = carried(spark, [f"{LONG} {x}" for x in ("primus", "secundus tertius", "password=hunter2hunter2", "quartus", "quintus sextus septimus", None, "")])
    wanted = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            w = wanted[r["doc_id"]]
            assert [r[c] for c in docs.columns if c not in ("text", "n_chars")] == [w[c] for c in docs.columns if c not in ("text", "n_chars")], name
            if r["text"] == w["text"]:
                assert r["n_chars"] == w["n_chars"], name
            else:
                assert name == "secrets" and r["n_chars"] == len(r["text"])


def test_operators_carry_bit_for_bit(spark):
    docs = carried(spark, [LONG, None, "", LONG, "another text of seven words or so"]).drop("accepted", "score")
    carry = ("big", "at", "price", "many", "pair", "raw", "flag")
    wanted = {r["doc_id"]: [r[c] for c in carry] for r in docs.collect()}
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    model = media.store_media(docs.select("doc_id", "text"))
    files = docs.join(model.select("doc_id", "media"), "doc_id")
    for out in (
        langid.identify(docs, langid.learn(docs), carry),
        quality.score_quality(docs, quality.learn(docs, labels), (*carry, "n_chars")),
        minhash.near_duplicates(docs, carry=carry),
        media.decode_images(files, carry=("doc_id", *carry)),
    ):
        assert {r["doc_id"]: [r[c] for c in carry] for r in out.collect()} == wanted
