"""Pools, readers, version numbers, and runs that end in a version."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from graincart.operators import generate, pool
from graincart.operators.schema import ColumnSpec
from graincart.sources import readers, runs
from graincart.sources.versions import Store


def test_pool_bounds_waits_and_order():
    now, most, lock, waits = [0], [0], threading.Lock(), []
    tries: dict[int, int] = {}

    def ask(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            tries[i] = tries.get(i, 0) + 1
        time.sleep(0.01 if i % 3 else 0.03)
        with lock:
            now[0] -= 1
        if i % 5 == 0 and tries[i] < 3 or i == 7:
            raise RuntimeError(f"no {i}")
        return i * i

    taken = []
    items = (taken.append(i) or i for i in range(20))
    got = []
    for o in pool.outcomes(ask, items, workers=3, retries=2, wait=0.5, sleep=waits.append):
        got.append(o)
        assert len(taken) - len(got) <= 6
    assert [o.item for o in got] == list(range(20)) and most[0] == 3
    assert all(o.value == o.item**2 and o.attempts == (3 if o.item % 5 == 0 else 1) for o in got if o.item != 7)
    assert got[7].error == "RuntimeError: no 7" and got[7].attempts == 3
    assert sorted(waits) == sorted([0.5, 1.0] * 5)
    with pytest.raises(ValueError, match="workers"):
        next(pool.outcomes(ask, [1], workers=0))


def test_reader_errors_come_at_once(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    good = readers.read_table(spark, put("a.csv", 'b,a\n1,"x, ""y""\nz"\n2\n'))
    assert good.columns == ["b", "a"] and [tuple(r) for r in good.collect()] == [(1, 'x, "y"\nz'), (2, None)]
    for name, text, what in (
        ("b.csv", "a,b\n1,2\n1,2,3\n", "more fields"), ("c.csv", "", "columns"), ("d.jsonl", '{"a": 1}\n{"a": \n', "no JSON object"), ("e.jsonl", "\n", "empty"), ("f.jsonl", "nothing\n", "no line"), ("g.parquet", "PAR1 no", ""),
    ):
        with pytest.raises(readers.MalformedFile, match=what):
            readers.read_table(spark, put(name, text))
    with pytest.raises(readers.UnsupportedFormat):
        readers.read_table(spark, put("h.txt", "x"))
    out = readers.read_table(spark, put("i.JSONL", '{"z": 1, "b": "x"}\n\n{"a": true, "z": 2}\n'))
    assert out.columns == ["z", "b", "a"] and out.count() == 2


def test_two_writers_get_two_numbers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    df = spark.range(3).withColumnRenamed("id", "x")
    ids, failed = [], []

    def write():
        try:
            ids.append(store.create("a/b c", df))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sorted(r["number"] for r in store.versions("a/b c").collect()) == [1, 2, 3, 4, 5, 6]
    # a number of a writer that died is not given again
    assert store._claim("a/b c") == 7
    assert store.entry(store.create("a/b c", df))["number"] == 8


@pytest.mark.parametrize(
    ("reply", "found"),
    [
        ('[{"a": 1}]', [{"a": 1}]), ('Here it is: {"rows": [1, 2]} thanks', {"rows": [1, 2]}), ('so [1] {"a": 2}', [1]), ('x ```json\n[{"a": [1]}]\n``` y', [{"a": [1]}]), ("a [b] c {", None), ("", None), ('5 {"a": "}"}', {"a": "}"}),
    ],
)
def test_replies(reply, found):
    assert generate.parse_reply(reply) == found


SPECS = [ColumnSpec("n", "integer", 0, 100), ColumnSpec("c", "categorical", categories=("a", "b"))]


def halting(folder):
    """A generator that gives each second row wrongly, fails now and then, and writes down what it was asked."""

    def ask(prompt):
        batch = int(prompt.split("Batch ")[1].split(".")[0])
        size = int(prompt.split(" ")[1])
        name = f"{folder}/{batch}"
        with open(name, "a") as f:
            f.write("x")
        if batch % 4 == 3 or batch % 4 == 1 and os.path.getsize(name) == 1:
            raise RuntimeError("busy")
        return json.dumps({"rows": [{"n": 5 * i if i % 2 else 1000, "c": "a"} for i in range(size)]})

    return ask


def test_rows_are_topped_up_and_survive_a_restart(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    path = f"file://{tmp_path}/made"
    part = generate.generated(spark, SPECS, 100, halting(str(folder)), batch=10, path=path, most_calls=12)
    assert part.count < 100 and "calls" in part.stopped
    asked = set(os.listdir(folder))
    whole = generate.generated(spark, SPECS, 100, halting(str(folder)), batch=10, path=path)
    assert whole.count == 100 and whole.stopped is None and whole.dropped > 0 and whole.rounds >= 1
    rows = whole.rows.collect()
    assert sorted(r["__row_id__"] for r in rows) == list(range(100)) and all(r["n"] % 10 == 5 and r["c"] == "a" for r in rows)
    # no batch was asked for again after its result was there
    assert all(os.path.getsize(folder / b) <= 3 for b in asked) and len(os.listdir(folder)) > len(asked)
    again = generate.generated(spark, SPECS, 100, lambda p: 1 / 0, batch=10, path=path)
    assert again.count == 100 and again.rounds == 0


def test_generators_that_give_nothing_end(spark, tmp_path):
    out = generate.generated(spark, SPECS, 10, lambda p: "sorry", batch=5, retries=0, path=f"file://{tmp_path}/none", idle_rounds=2)
    assert out.count == 0 and out.rows.count() == 0 and out.stopped == "2 rounds gave no row" and out.calls == 4


def test_generation_run_makes_a_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    sample = spark.createDataFrame([(i, float(i % 17), "ab"[i % 2]) for i in range(200)], "__row_id__ long, x double, c string")
    first = store.create("p", sample)
    done = runs.generation_run(store, "p", "statistical", 60, sample_id=first, balance={"c": {"a": 0.9, "b": 0.1}}, seed=4, soft_limit=50)
    made = store.load(done.version_id, provenance=True)
    assert made.count() == 60 and made.where("c = 'a'").count() == 54 and store.lineage(done.version_id) == [done.version_id, first]
    assert made.select(F.get_json_object("__provenance__", "$.row_origin")).distinct().collect()[0][0] == "synthetic"
    kinds = {r["kind"]: r for r in done.findings.collect()}
    assert "generation_soft_limit" in kinds and {r["measure"] for r in done.report.collect()} >= {"ks", "chi2", "near_copies", "made:a"}
    told = [ColumnSpec("mail", "categorical", categories=("ann@example.com", "bob@example.org"))]
    done = runs.generation_run(store, "p", "generated", 8, specs=told, generator=generate.fake_generator)
    assert done.facts["rows"] == 8 and {r["kind"] for r in done.findings.collect()} == {"derived_profile", "personal_data"}


def test_labels_and_reviews_become_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    first = store.create("p", spark.createDataFrame([(i, f"text {i}") for i in range(30)], "__row_id__ long, t string"))
    broken = tmp_path / "broken"
    broken.write_text("x")

    def ask(state):
        i = int(state.rsplit(" ", 1)[1])
        if i % 10 == 3 and broken.exists():
            raise RuntimeError("down")
        return {"spam": i % 2 == 0, "spam__confidence": 0.9 if i % 5 else 0.6}

    preview = runs.labeling_preview(store.load(first), ask, ["t"], "spam boolean, spam__confidence double").collect()
    assert [r["state"] for r in sorted(preview)] == [f"t: text {i}" for i in range(5)] and [r["failed"] for r in sorted(preview)] == [False, False, False, True, False]
    assert runs.labeling_estimate(store.load(first)).first()["calls"] == 30
    args = (ask, ["t"], "spam boolean, spam__confidence double", ["spam"], f"file://{tmp_path}/answers")
    done = runs.labeling_run(store, first, *args, wait=0.001, soft_limit=20)
    assert done.facts["failed_rows"] == 3 and done.facts["labeled"] == 27 and {r["kind"] for r in done.findings.collect()} == {"labeling_soft_limit", "labeling_failures"}
    broken.unlink()
    done = runs.labeling_run(store, first, *args)
    # only the three were asked again
    assert done.facts["failed_rows"] == 0 and done.facts["labeled"] == 30 and done.facts["calls"] == 27 + 9 + 3
    decide = lambda rows: spark.createDataFrame(rows, "row long, family string, action string, value string, note string")
    for rows, what in (([(1, "spam", "delete", None, None)], "unknown action"), ([(99, "spam", "accept", None, None)], "no rows 99")):
        with pytest.raises(ValueError, match=what):
            runs.review_run(store, done.version_id, decide(rows))
    seen = runs.review_run(store, done.version_id, decide([(0, "spam", "override", "false", "no"), (5, "spam", "accept", None, None), (1, "spam", "exclude", None, None)]))
    out = {r["__row_id__"]: r for r in store.load(seen.version_id, provenance=True).collect()}
    assert out[0]["spam"] is False and out[1]["__excluded__"] and json.loads(out[5]["__provenance__"])["label_origins"]["spam"]["origin"] == "human_reviewed"
    assert seen.facts["waiting_rows"] == 4 and seen.facts["reviewed_rows"] == 2 and seen.findings.first()["raised"]
    assert store.lineage(seen.version_id)[-1] == first and [r["number"] for r in store.versions("p").collect()] == [1, 2, 3, 4]


def test_prompts_have_a_schema_and_shares():
    told = generate.prompt_for(SPECS, 5, 2, "bad", "shops", {"c": {"a": 0.75, "b": 0.25}})
    assert "75% should be a, 25% should be b" in told and "about: shops" in told and told.endswith("could not be used: bad")
    rows = generate.reply_schema(SPECS, 5)["properties"]["rows"]
    assert rows["maxItems"] == 5 and rows["items"]["properties"] == {"n": {"type": "integer", "minimum": 0, "maximum": 100}, "c": {"type": "string", "enum": ["a", "b"]}}
    assert all(set(r) == {"n", "c"} and 0 <= r["n"] <= 100 for r in json.loads(generate.fake_generator(told)))


def test_suggestions_and_drafts():
    replies = iter(["nothing", json.dumps([{"name": "Unit Price", "type": "number", "min": 1, "max": "9"}, {"name": "size", "type": "shape"}, {"name": "kind", "type": "categorical", "categories": ["a", 2]}, {"name": "unit-price", "type": "text"}])])
    found = generate.suggest_specs(lambda p: next(replies), "a shop")
    assert found == [ColumnSpec("unit_price", "number", 1.0, 9.0), ColumnSpec("kind", "categorical", categories=("a", "2"))]
    with pytest.raises(ValueError, match="no columns"):
        generate.suggest_specs(lambda p: "[]", "a shop", retries=0)
    replies = iter(['{"name": "Bad Name", "kind": "binary"}', '{"name": "tone", "kind": "choice", "text": "How does it sound?", "options": ["kind", "rude"]}'])
    question, wording = generate.draft_question(lambda p: next(replies), "tone")
    assert question.columns() == ["tone", "tone__confidence", "tone__p_kind", "tone__p_rude"] and wording == "How does it sound?"
    with pytest.raises(ValueError, match="drafts no question"):
        generate.draft_question(lambda p: "no", "x", retries=0)


def test_a_run_without_a_sample_asks_for_seed_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    done = runs.generation_run(store, "p", "statistical", 120, specs=SPECS, generator=generate.fake_generator, path=f"file://{tmp_path}/seed")
    made = store.load(done.version_id)
    assert made.count() == 120 and made.where("n < 0 or n > 100 or c not in ('a', 'b')").count() == 0
    assert spark.read.parquet(f"file://{tmp_path}/seed").count() == runs.SEED_ROWS and [r["kind"] for r in done.findings.collect()] == ["derived_profile"]


def test_targets_that_are_no_numbers(spark):
    from graincart.operators import models

    df = spark.createDataFrame([("1.5",), (None,), ("x",), ("NaN",)], "y string")
    with pytest.raises(ValueError, match="2 values of y"):
        models.numeric_target(df, "y")
    assert [r[0] for r in models.numeric_target(df.limit(2), "y").select(models.LABEL).collect()] == [1.5, None]
