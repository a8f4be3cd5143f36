"""Column decisions, generated rows, cards and resumed labelling."""

import pytest
from pyspark.sql import functions as F

from graincart.operators import cards, generate
from graincart.operators.schema import ColumnSpec, Question, features, label_columns, siblings, state_columns
from graincart.streaming.resume import label_available


def test_columns_of_questions():
    questions = [Question("ok", "binary"), Question("tone", "choice", ("Very good", "bad"))]
    assert label_columns(questions, ["text"]) == ["ok", "ok__confidence", "tone", "tone__confidence", "tone__p_very_good", "tone__p_bad"]
    with pytest.raises(ValueError, match="taken"):
        label_columns(questions, ["ok"])
    with pytest.raises(ValueError, match="same column"):
        Question("tone", "choice", ("a b", "a-b"))
    with pytest.raises(ValueError, match="snake_case"):
        Question("Not So", "binary")
    with pytest.raises(ValueError, match="unknown"):
        state_columns(["a"], ["b"], [])


def test_features_have_reasons():
    columns = ["__provenance__", "ok", "ok__confidence", "age", "region", "note"]
    assert siblings(columns, "ok") == ["ok__confidence"]
    kept, why = features(columns, "ok", excluded=("note",), sensitive=("region",))
    assert kept == ["age"] and why == {"__provenance__": "provenance", "ok": "target", "ok__confidence": "target_sibling", "note": "user", "region": "sensitive"}


def test_generated_rows(spark):
    specs = [ColumnSpec("age", "integer", 18, 89), ColumnSpec("plan", "categorical", categories=("basic", "pro"))]
    calls = lambda prompt: "no JSON here" if "Batch 1." in prompt and "could not" not in prompt else "Sure:\n```json\n" + generate.fake_generator(prompt) + "\n```"
    df = generate.generated(spark, specs, 60, calls)
    r = df.agg(F.count("*").alias("n"), F.min("age").alias("lo"), F.max("age").alias("hi")).first()
    assert r["n"] == 60 and r["lo"] >= 18 and r["hi"] <= 89 and dict(df.dtypes)["age"] == "bigint"
    filled = generate.fill_text(df.limit(5), "bio", lambda p: p[:11])
    assert filled.where("bio = 'Write a bio'").count() == 5


def test_cards(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    card = cards.dataset_card(df, "demo", "uploaded", {"uploaded": 2}, {"api_key": "hush", "seed": 1})
    assert "| s | categorical | 50.00% |" in card and "hush" not in card and '"seed": 1' in card
    assert "not measured" in cards.model_card("m", "classification", "y", ["n"], {"f1": None})


def test_labelling_resumes(spark, tmp_path):
    folder = lambda x: f"file://{tmp_path}/{x}"
    df = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "__row_id__ long, body string")
    run = lambda: label_available(spark, folder("in"), df.schema, folder("out"), folder("mark"), lambda s: {"size": len(s)}, ["body"], "size bigint")
    df.where("__row_id__ < 4").write.parquet(folder("in"))
    run()
    df.where("__row_id__ >= 4").write.mode("append").parquet(folder("in"))
    run()
    out = spark.read.parquet(folder("out"))
    assert sorted(r["__row_id__"] for r in out.collect()) == list(range(6)) and out.where("size <> 8").count() == 0


@pytest.mark.parametrize("threshold", [0.0, 0.04, 1.0])
def test_near_copies_of_all_rows(spark, threshold, monkeypatch):
    import random

    from graincart.operators import fidelity

    monkeypatch.setattr(fidelity, "CELL_ROWS", 7)
    rng = random.Random(5)
    number = lambda: rng.choice([None, 0.0, round(rng.uniform(-3, 3), 2), float(rng.randint(-2, 2))])
    rows = lambda n: [(i, number(), number(), rng.choice(["a", "b", None])) for i in range(n)]
    made, sample = rows(400), rows(450)
    ends = [(lambda v: max(v) - min(v))([r[c] for r in sample if r[c] is not None]) for c in (1, 2)]

    def distance(a, b):
        one = lambda x, y, gap: 0.0 if x is None and y is None else 1.0 if x is None or y is None else gap()
        return max(*(one(a[c], b[c], lambda c=c: abs(a[c] - b[c]) / ends[c - 1]) for c in (1, 2)), one(a[3], b[3], lambda: float(a[3] != b[3])))

    wanted = {a[0]: min(distance(a, b) for b in sample) for a in made}
    schema = "id long, x double, y double, c string"
    out = fidelity.near_copies(spark.createDataFrame(made, schema), spark.createDataFrame(sample, schema), ["id"], ["x", "y"], ["c"], threshold)
    got = {r["id"]: r["distance"] for r in out.collect()}
    assert got == {i: d for i, d in wanted.items() if d <= threshold} and max(got) >= 200


def test_ks_chances_are_exact():
    from itertools import combinations

    from graincart.functions import tests_of_fit as fit

    for n, m in ((3, 4), (5, 5), (2, 6)):
        gaps = []
        for first in combinations(range(n + m), n):
            a = b = 0
            most = 0.0
            for i in range(n + m):
                a, b = a + (i in first), b + (i not in first)
                most = max(most, abs(a / n - b / m))
            gaps.append(most)
        for d in sorted(set(gaps)):
            assert fit.kolmogorov_smirnov(d, n, m) == pytest.approx(sum(g >= d - 1e-12 for g in gaps) / len(gaps), abs=1e-12)
    assert fit.kolmogorov_smirnov(0.1, 9000, 9000, 0) == pytest.approx(fit.kolmogorov_smirnov(0.1, 900, 900), abs=1e-3)
    assert fit.kolmogorov_smirnov(None, 3, 4) is None
    # fixed values of tables: the 5 % and 1 % points
    for x, dof, p in ((3.841459, 1, 0.05), (6.634897, 1, 0.01), (18.307038, 10, 0.05), (10.0, 2, 0.006737947), (124.342113, 100, 0.05)):
        assert fit.chi_square_tail(x, dof) == pytest.approx(p, rel=1e-5)


def test_running_sums_need_no_single_task(spark):
    import random

    from graincart.operators.running import running_sums

    rng = random.Random(3)
    values = {rng.gauss(0, 5): rng.randrange(9) for _ in range(3000)}
    df = spark.createDataFrame([*values.items(), (None, 4)], "x double, n int")
    for down in (False, True):
        out = {r["x"]: r["upto"] for r in running_sums(df, "x", {"upto": "n"}, down).collect()}
        total = 0 if down else 4
        for x in sorted(values, reverse=down):
            total += values[x]
            assert out[x] == total
    assert running_sums(df.limit(0), "x", {"upto": "n"}).count() == 0


def test_validation_rows(spark):
    from graincart.operators.review import seed_of, validation_rows

    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(2000)] + [(9999, "lone")], "__row_id__ long, y string")
    shares = {r["y"]: r["s"] for r in validation_rows(df, "y", 0.2).groupBy("y").agg(F.avg(F.col("validation").cast("int")).alias("s")).collect()}
    assert abs(shares["a"] - 0.2) < 0.05 and abs(shares["b"] - 0.2) < 0.05 and shares["lone"] == 0
    assert seed_of({"a": 1, "b": 2}) == seed_of({"b": 2, "a": 1}) != seed_of({"a": 1})
