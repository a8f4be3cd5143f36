"""Decisions of reviewers on label families, and answers of an evaluator that become columns."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.functions.text import option_slug
from graincart.operators.labeling import EXCLUDED, PROVENANCE, ROW_ID
from graincart.operators.prep import split

ACTIONS = ("accept", "override", "exclude")
_ENTRY = "struct<origin: string, confidence: double, evaluator_confidence: double, note: string>"
_SCHEMA = f"row_origin string, label_origins map<string, {_ENTRY}>"


def invalid_decisions(decisions: DataFrame, found: dict[str, str]) -> DataFrame:
    """(row, family, problem) of decisions (row, family, action, value) that cannot be applied, the first problem of each.

    ``found`` names the kind of each family: binary, choice or score.
    """
    known = F.col("family").isin(*found)
    scores = F.col("family").isin(*[f for f, kind in found.items() if kind == "score"])
    over, empty = F.col("action") == "override", F.coalesce(F.trim("value"), F.lit("")) == ""
    problem = (
        F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown action")
        .when(F.coalesce(F.trim("family"), F.lit("")) == "", "no family")
        .when(F.coalesce(F.col("row") < 0, F.lit(True)), "no row")
        .when(over & empty, "no new answer")
        .when((F.col("action") != "exclude") & ~F.coalesce(known, F.lit(False)), "unknown family")
        .when(over & scores & F.col("value").try_cast("double").isNull(), "not a number")
    )
    return decisions.select("row", "family", problem.alias("problem")).where("problem is not null")


def _level(value: Column) -> Column:
    """The name of a score's level: whole numbers without a point."""
    number = value.try_cast("double")
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))


def apply_decisions(df: DataFrame, decisions: DataFrame, found: dict[str, str], row_id: str = ROW_ID) -> DataFrame:
    """``df`` after decisions (row, family, action, value, note) on any of its families.

    A row with an ``exclude`` is only marked, whatever else is said of it; earlier marks stay. ``accept``
    keeps the answer; ``override`` sets it, with confidence 1 and its siblings brought along: the
    shares of a choice become 1 and 0, and the probabilities of a score name one level. Both mark the
    family as reviewed by a person, and keep the evaluator's confidence and the note beside it. Of
    two decisions on one family of a row override wins, then the larger value. Rows that no decision names
    stay as they are. Check ``invalid_decisions`` first.
    """
    each = decisions.groupBy(F.col("row").alias(row_id), "family").agg(F.max(F.struct("action", "value", "note")).alias("said"), F.max(F.col("action") == "exclude").alias("out"))
    given = each.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("family", "said"))).alias("_said"), F.max("out").alias("_out"))
    out = df.join(given, row_id, "left").withColumn("_out", F.coalesce("_out", F.lit(False)))
    was = F.coalesce(F.col(EXCLUDED), F.lit(False)) if EXCLUDED in df.columns else F.lit(False)
    new = {EXCLUDED: was | F.col("_out")}
    parsed = F.from_json(F.col(PROVENANCE), _SCHEMA) if PROVENANCE in df.columns else None
    reviewed = []
    for family, kind in found.items():
        said = F.when(~F.col("_out"), F.element_at("_said", family))
        over = F.coalesce(said["action"] == "override", F.lit(False))
        touched = F.coalesce(said["action"].isin("accept", "override"), F.lit(False))
        value = said["value"].try_cast(df.schema[family].dataType)
        new[family] = F.when(over, value).otherwise(F.col(family))
        if f"{family}__confidence" in df.columns:
            new[f"{family}__confidence"] = F.when(over, 1.0).otherwise(F.col(f"{family}__confidence"))
        if kind == "choice":
            for c in df.columns:
                if c.startswith(f"{family}__p_"):
                    named = F.concat(F.lit(f"{family}__"), option_slug(said["value"])) == c
                    new[c] = F.when(over, F.when(named, 1.0).otherwise(0.0)).otherwise(F.col(c))
        elif kind == "score" and f"{family}__probabilities" in df.columns:
            new[f"{family}__probabilities"] = F.when(over, F.concat(F.lit('{"'), _level(said["value"]), F.lit('":1.0}'))).otherwise(F.col(f"{family}__probabilities"))
        if parsed is not None:
            before = F.element_at(parsed["label_origins"], family)
            entry = F.struct(F.lit("human_reviewed").alias("origin"), F.lit(None).cast("double").alias("confidence"), F.coalesce(before["evaluator_confidence"], before["confidence"]).alias("evaluator_confidence"), said["note"].alias("note"))
            reviewed.append(F.when(touched, F.struct(F.lit(family).alias("key"), entry.alias("value"))))
    if reviewed:
        marks = F.map_from_entries(F.array_compact(F.array(*reviewed)))
        old = F.coalesce(parsed["label_origins"], F.create_map().cast(f"map<string, {_ENTRY}>"))
        merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(marks), k)), marks)
        text = F.to_json(F.struct(F.coalesce(parsed["row_origin"], F.lit("uploaded")).alias("row_origin"), merged.alias("label_origins")))
        new[PROVENANCE] = F.when(F.size(marks) > 0, text).otherwise(F.col(PROVENANCE))
    return out.withColumns(new).drop("_said", "_out")


def apply_answers(df: DataFrame, answers: DataFrame, found: list[str], row_id: str = ROW_ID) -> DataFrame:
    """``df`` with the columns of ``answers`` (row id, label columns, failed), null where the evaluator failed or was not asked.

    The provenance of an answered row names the evaluator for each family in ``found``, beside what it
    named before. Raises ValueError if a column is there already.
    """
    names = [c for c in answers.columns if c not in (row_id, "failed")]
    if taken := sorted(set(names) & set(df.columns)):
        raise ValueError(f"columns are taken: {', '.join(taken)}")
    got = answers.where(~F.coalesce("failed", F.lit(False))).select(row_id, *names, F.lit(True).alias("_answered"))
    out = df.join(got, row_id, "left")
    parsed = F.from_json(F.col(PROVENANCE) if PROVENANCE in df.columns else F.lit(None).cast("string"), _SCHEMA)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    entries = []
    for family in found:
        sure = F.col(f"{family}__confidence") if f"{family}__confidence" in names else F.lit(None)
        entries += [F.lit(family), F.struct(F.lit("evaluator").alias("origin"), sure.cast("double").alias("confidence"), none("double", "evaluator_confidence"), none("string", "note"))]
    old = F.coalesce(parsed["label_origins"], F.create_map().cast(f"map<string, {_ENTRY}>"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~k.isin(*found)), F.create_map(*entries))
    text = F.to_json(F.struct(F.coalesce(parsed["row_origin"], F.lit("uploaded")).alias("row_origin"), merged.alias("label_origins")))
    return out.withColumn(PROVENANCE, F.when(F.col("_answered"), text).otherwise(F.col(PROVENANCE) if PROVENANCE in df.columns else F.lit(None))).drop("_answered")


def unreviewed_check(queue: DataFrame, version: str) -> DataFrame:
    """One warning (kind, severity, subject, rows) for a version whose review queue has rows, else none."""
    rows = queue.agg(F.count_distinct("row").alias("rows"))
    return rows.where("rows > 0").select(F.lit("unreviewed_labels").alias("kind"), F.lit("warning").alias("severity"), F.lit(version).alias("subject"), "rows")


def seed_of(settings: dict) -> int:
    """A seed that depends on settings only: the checksum of their sorted JSON, in 31 bits."""
    return zlib.crc32(json.dumps(settings, sort_keys=True, default=str).encode()) & 0x7FFFFFFF


def validation_rows(train: DataFrame, target: str, share: float, seed: int = 0, row_id: str = ROW_ID) -> DataFrame:
    """``train`` with ``validation``: of each class the rounded ``share``, one row at least and one fewer than all at most, and nothing of a class of one row."""
    out = split(train, [row_id], share, seed, target)
    return out.withColumn("validation", F.col("split") == "test").drop("split")


def override_problem(kind: Column, value: Column, options: list[str], levels: tuple[float, float]) -> Column:
    """Why a new answer cannot be one to a question of this kind (binary, choice, score), or null."""
    said = F.trim(value)
    number = said.try_cast("double")
    return (
        F.when(F.coalesce(said, F.lit("")) == "", "no answer")
        .when((kind == "binary") & ~F.lower(said).isin("true", "false"), "not true or false")
        .when((kind == "choice") & ~said.isin(*options), "no option")
        .when((kind == "score") & ~F.coalesce(number.between(*levels), F.lit(False)), "no level")
    )


def positive_class(df: DataFrame, target: str) -> DataFrame:
    """One row: the last class by name, which fairness takes as the positive one."""
    return df.where(F.col(target).isNotNull()).agg(F.max(F.col(target).cast("string")).alias("positive"))
