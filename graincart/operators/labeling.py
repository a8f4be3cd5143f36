"""Labels from an evaluator: a deterministic stand-in, label columns, provenance, and the review of labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.functions.text import hash_draw, rendered_row
from graincart.operators import pool

PROVENANCE = "__provenance__"
EXCLUDED = "__excluded__"
ROW_ID = "__row_id__"
#: Answers that are handed on together.
EACH = 10
ORIGIN_SCHEMA = "row_origin string, label_origins map<string, struct<origin: string, confidence: double, note: string>>"


def binary_answer(state: Column, name: str) -> Column:
    """struct<answer: boolean, p, confidence> of the stand-in for a yes/no question."""
    p = F.least(F.greatest(0.5 + (hash_draw(F.concat(state, F.lit(f"::{name}"))) - 0.5) * 1.8, F.lit(0.001)), F.lit(0.999))
    return F.struct((p >= 0.5).alias("answer"), p.alias("p"), (2 * F.abs(p - 0.5)).alias("confidence"))


def choice_answer(state: Column, name: str, options: list[str]) -> Column:
    """struct<answer, confidence, shares: map> over the options; ties go to the first."""
    weights = [hash_draw(F.concat(state, F.lit(f"::{name}::{o}"))) + 0.01 for o in options]
    total = sum(weights[1:], weights[0])
    shares = [w / total for w in weights]
    best = F.greatest(*shares)
    answer = F.lit(options[-1])
    for o, s in reversed(list(zip(options, shares, strict=True))):
        answer = F.when(s == best, F.lit(o)).otherwise(answer)
    pairs = [x for o, s in zip(options, shares, strict=True) for x in (F.lit(o), s)]
    return F.struct(answer.alias("answer"), best.alias("confidence"), F.create_map(*pairs).alias("shares"))


def score_answer(state: Column, name: str, levels: list[str]) -> Column:
    """struct<answer: double, confidence>: the place of the level (from 1), 0.92 of its mass there and 0.02 elsewhere."""
    n = len(levels)
    at = F.floor(hash_draw(F.concat(state, F.lit(f"::{name}"))) * n) % n
    return F.struct((at + 1).cast("double").alias("answer"), F.lit(0.92 / (0.92 + 0.02 * (n - 1))).alias("confidence"))


def review_confidence(p: Column) -> Column:
    """2 * |p - 0.5|, between 0 and 1; a null stays null."""
    return F.when(p.isNotNull(), F.least(F.greatest(2 * F.abs(p - 0.5), F.lit(0.0)), F.lit(1.0)))


def families(columns: list[str]) -> dict[str, str]:
    """Label families by their columns: choice if options have shares, score if probabilities are there, else binary."""
    found = {}
    for c in columns:
        head, mark, tail = c.partition("__")
        if not mark or not head:
            continue
        kind = "choice" if tail.startswith("p_") else "score" if tail == "probabilities" else "binary" if tail == "confidence" else None
        rank = {"choice": 2, "score": 1, "binary": 0}
        if kind and (head not in found or rank[kind] > rank[found[head]]):
            found[head] = kind
    return found


def origins(provenance: Column) -> Column:
    return F.from_json(provenance, ORIGIN_SCHEMA)


def origin_bucket(provenance: Column) -> Column:
    """human_reviewed over evaluator over the row's origin; without provenance, uploaded."""
    parsed = origins(provenance)
    any_of = lambda name: F.coalesce(F.exists(F.map_values(parsed["label_origins"]), lambda x: x["origin"] == name), F.lit(False))
    return F.when(any_of("human_reviewed"), "human_reviewed").when(any_of("evaluator"), "evaluator").otherwise(F.coalesce(parsed["row_origin"], F.lit("uploaded")))


def breakdown(df: DataFrame, column: str = PROVENANCE) -> DataFrame:
    """(bucket, n): rows by origin, the four known origins always among them."""
    known = df.sparkSession.createDataFrame([("uploaded",), ("synthetic",), ("evaluator",), ("human_reviewed",)], "bucket string")
    counts = df.groupBy(origin_bucket(F.col(column)).alias("bucket")).agg(F.count("*").alias("n"))
    return known.join(counts, "bucket", "full_outer").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def unreviewed(provenance: Column, family: str, confidence: Column, threshold: float) -> Column:
    """An evaluator's label that nobody has reviewed and whose confidence is below ``threshold`` or unknown."""
    origin = F.element_at(origins(provenance)["label_origins"], family)["origin"]
    return F.coalesce(origin == "evaluator", F.lit(False)) & (confidence.isNull() | (confidence < threshold))


def review_queue(df: DataFrame, found: dict[str, str], threshold: float, row_id: str = ROW_ID) -> DataFrame:
    """(row, family, answer, confidence, state): labels below ``threshold`` and those never given.

    All families of a row are looked at in one pass; reviewed ones are left out.
    """
    rows = []
    for name, kind in found.items():
        if kind == "choice":
            shares = [F.col(c) for c in df.columns if c.startswith(f"{name}__p_")]
            confidence = F.greatest(*shares) if len(shares) > 1 else shares[0]
        elif kind == "score" and f"{name}__probabilities" in df.columns:
            confidence = F.coalesce(F.array_max(F.map_values(F.from_json(f"{name}__probabilities", "map<string,double>"))), F.col(f"{name}__confidence"))
        else:
            confidence = review_confidence(F.col(f"{name}__confidence"))
        reviewed = F.coalesce(F.element_at(origins(F.col(PROVENANCE))["label_origins"], name)["origin"] == "human_reviewed", F.lit(False)) if PROVENANCE in df.columns else F.lit(False)
        state = F.when(confidence.isNull() & F.col(name).isNull(), "unlabeled").when(confidence < threshold, "queued")
        rows.append(F.struct(F.lit(name).alias("family"), F.col(name).cast("string").alias("answer"), confidence.alias("confidence"), F.when(~reviewed, state).alias("state")))
    return df.select(F.col(row_id).alias("row"), F.explode(F.array(*rows)).alias("r")).select("row", "r.*").where("state is not null")


def label_rows(df: DataFrame, ask: Callable[[str], dict], columns: list[str], schema: str, row_id: str = ROW_ID, retries: int = pool.RETRIES, workers: int = pool.WORKERS, wait: float = pool.WAIT, each: int = EACH) -> DataFrame:
    """Answers of a Python evaluator ``ask`` for the rendered row of each row: (row id, answers..., failed, error, attempts).

    Calls run inside the tasks that hold the rows, ``workers`` at once and in the rows' order; see
    ``pool`` for how they are repeated. A call that keeps failing gives nulls, ``failed`` and its
    last error. Results are handed on as they come: ``each`` rows at a time if the evaluator is slow,
    more if answers come fast (``pool.Held``). The rows are dealt out
    over all tasks first. Write the result and join it to resume: only rows without an answer
    are asked again.
    """
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = ((key, state) for batch in batches for key, state in zip(batch[row_id], batch["_state"], strict=True))
        rows, held = [], pool.Held(each)
        told = lambda: pd.DataFrame(rows, columns=[row_id, *names, "failed", "error", "attempts"])
        for o in pool.outcomes(lambda item: dict(ask(item[1])), items, workers, retries, wait):
            rows.append((o.item[0], *[(o.value or {}).get(n) for n in names], o.error is not None, o.error, o.attempts))
            if held.enough(len(rows)):
                yield told()
                rows.clear()
        if rows:
            yield told()

    state = df.select(F.col(row_id).cast("long").alias(row_id), rendered_row(columns).alias("_state"))
    return pool.dealt(state).mapInPandas(run, f"{row_id} long, {schema}, failed boolean, error string, attempts int")


def unanswered(df: DataFrame, answers: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    return df.join(answers.where("not failed").select(row_id), row_id, "left_anti")
