"""Runs that end in a version: generation, labelling, review. A run that starts again goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincart.operators import checks, fidelity, generate, labeling, pii, pool, review
from graincart.operators.profile import kinds
from graincart.operators.schema import ColumnSpec
from graincart.sources.readers import PROVENANCE, ROW_ID
from graincart.sources.versions import Store

#: Rows above which a generation, and calls above which a labelling, warns.
GENERATED_ROWS, LABELED_ROWS = 5_000, 5_000
#: Rows that a generator gives in the place of a sample.
SEED_ROWS = 50


@dataclass(frozen=True)
class Done:
    """The version that a run made, facts about it, and the findings (``checks.FINDINGS``) that it raised."""

    version_id: str
    facts: dict
    findings: DataFrame
    report: DataFrame | None = field(default=None, repr=False)


def _columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numbers and categories of a table, without texts and marks."""
    names = [c for c in df.columns if not c.startswith("__")]
    told = {r["column"]: r["kind"] for r in kinds(df, names).collect()} if names else {}
    return [c for c in names if told[c] in ("integer", "number")], [c for c in names if told[c] in ("categorical", "bool")]


def generation_run(
    store: Store, project: str, mode: str, n: int, *, sample_id: str | None = None, specs: list[ColumnSpec] = (), generator: Callable[[str], str] | None = None,
    texts: tuple[str, ...] = (), seed: int = 0, balance: dict[str, dict[str, float]] | None = None, path: str | None = None, soft_limit: int = GENERATED_ROWS,
) -> Done:
    """Make ``n`` rows, store them as a version with its fidelity report, and scan them for personal data.

    ``mode`` is that of ``generate.make_rows``; generated rows come in rounds under ``path``, which a run
    that starts again goes on from. With ``balance`` (shares by column and value) statistical rows are
    drawn thrice over and kept by their quotas. With a sample the version is its child and is held
    against it. Without one a statistical or hybrid run is fitted on SEED_ROWS rows that the
    generator gives first, and the findings say that no real row stands behind it.
    """
    spark, facts, found = store.spark, {"mode": mode, "asked": n, "seed": seed}, []
    sample = store.load(sample_id).drop(ROW_ID) if sample_id else None
    dropped = 0
    if mode == "generated":
        made = generate.generated(spark, list(specs) or generate.specs_of(sample, sample.columns), n, generator, path=path)
        rows, dropped = made.rows, made.dropped
        facts |= {"calls": made.calls, "rounds": made.rounds, "stopped": made.stopped}
    else:
        fitted = sample if sample is not None else generate.generated(spark, list(specs), SEED_ROWS, generator, path=path).rows.drop(ROW_ID)
        rows = generate.make_rows(spark, mode, 3 * n if balance else n, fitted, generator=generator, texts=texts, seed=seed)
        for column, shares in (balance or {}).items():
            rows = generate.synth.balanced(rows, column, shares, n)
    if n > soft_limit:
        found.append(checks.finding("generation_soft_limit", project, True, "warning", f"{n} rows are above the soft limit of {soft_limit}", {"count": n, "soft_limit": soft_limit}))
    version_id = store.create(project, rows, sample_id, "synthetic", seed, {"generation": facts, "balance": balance, "dropped": dropped}, own_rows=True)
    rows = store.load(version_id)
    report = None
    if sample is not None:
        shared = [c for c in sample.columns if c in rows.columns]
        both = sample.select(F.lit(True).alias("__sample__"), F.monotonically_increasing_id().alias("__at__"), *shared).union(rows.select(F.lit(False), ROW_ID, *shared))
        numeric, categorical = _columns(sample.select(*shared))
        report = fidelity.report(both, F.col("__sample__"), numeric, categorical, ["__at__"], balance, dropped, n)
        warned = fidelity.report_warnings(report)
    else:
        warned = ["derived_profile"]
    found += [checks.finding(code, version_id, True, "warning", f"the made rows: {code.replace('_', ' ')}", {}) for code in warned]
    personal = pii.counts(rows)
    for r in personal.groupBy("column").agg(F.sum("spans").alias("spans")).collect():  # a row for each column
        found.append(checks.finding("personal_data", version_id, True, "warning", f"{r['column']} has {r['spans']} spans of personal data", {"column": r["column"], "spans": r["spans"]}))
    facts |= {"rows": rows.count(), "dropped": dropped}
    return Done(version_id, facts, spark.createDataFrame(found, checks.FINDINGS), report)


def labeling_preview(df: DataFrame, ask: Callable[[str], dict], columns: list[str], schema: str, rows: int = 5) -> DataFrame:
    """(row, state, answers, failed, error) of the first ``rows`` rows, as the evaluator would see and answer them."""
    first = df.orderBy(ROW_ID).limit(rows)
    told = labeling.label_rows(first, ask, columns, schema, retries=0)
    state = first.select(ROW_ID, labeling.rendered_row(columns).alias("state"))
    names = [x.split()[0] for x in schema.split(",")]
    return state.join(told, ROW_ID).select(F.col(ROW_ID).alias("row"), "state", F.struct(*names).alias("answers"), "failed", "error")


def labeling_estimate(df: DataFrame) -> DataFrame:
    """One row: rows, and calls, one for each row, as all questions travel together."""
    return df.agg(F.count("*").alias("rows"), F.count("*").alias("calls"))


def labeling_run(
    store: Store, version_id: str, ask: Callable[[str], dict], columns: list[str], schema: str, families: list[str], path: str, *,
    retries: int = pool.RETRIES, workers: int = pool.WORKERS, wait: float = pool.WAIT, soft_limit: int = LABELED_ROWS,
) -> Done:
    """Ask for the rows of a version that have no answer under ``path`` yet, and store all answers as a child version.

    Answers are appended to ``path`` as they come. Rows whose calls keep failing have null labels; the
    version's meta tells how many (``failed_rows``), and a later run under the same path asks
    for them again.
    """
    spark, df = store.spark, store.load(version_id, provenance=True)
    kept = f"{ROW_ID} long, {schema}, failed boolean, error string, attempts int"

    def answered() -> DataFrame:
        try:
            return spark.read.schema(kept).parquet(path)
        except AnalysisException:
            return spark.createDataFrame([], kept)

    left = labeling.unanswered(df, answered())
    labeling.label_rows(left, ask, columns, schema, retries=retries, workers=workers, wait=wait).write.mode("append").parquet(path)
    told = answered()
    # a row that failed before and was answered later has two results
    good = told.where("not failed").dropDuplicates([ROW_ID]).drop("error", "attempts")
    out = review.apply_answers(df, good, families)
    first = families[0]
    facts = out.agg(F.count("*").alias("rows"), F.count(first).alias("labeled")).first().asDict()
    facts |= {"failed_rows": df.join(good, ROW_ID, "left_anti").count(), "calls": told.agg(F.coalesce(F.sum("attempts"), F.lit(0)).alias("n")).first()["n"]}
    found = []
    if facts["rows"] > soft_limit:
        found.append(checks.finding("labeling_soft_limit", version_id, True, "warning", f"{facts['rows']} calls are above the soft limit of {soft_limit}", {"rows": facts["rows"], "soft_limit": soft_limit}))
    if facts["failed_rows"]:
        found.append(checks.finding("labeling_failures", version_id, True, "warning", f"{facts['failed_rows']} rows have no answer", {"failed_rows": facts["failed_rows"]}))
    project = store.entry(version_id)["project"]
    new = store.create(project, out, version_id, "labeled", meta={"labeling": facts, "families": families})
    return Done(new, facts, spark.createDataFrame(found, checks.FINDINGS))


def review_run(store: Store, version_id: str, decisions: DataFrame, threshold: float = 0.5) -> Done:
    """Store a version after ``decisions`` (row, family, action, value, note) as its child, and tell what still waits.

    Raises ValueError if a decision cannot be applied (``review.invalid_decisions``); nothing is stored then.
    """
    df = store.load(version_id, provenance=True)
    found = labeling.families(df.columns)
    wrong = review.invalid_decisions(decisions, found).limit(20).collect()
    if wrong:
        raise ValueError("; ".join(f"row {r['row']}, {r['family']}: {r['problem']}" for r in wrong))
    unknown = decisions.join(df.select(F.col(ROW_ID).alias("row")), "row", "left_anti").select("row").distinct().limit(5).collect()
    if unknown:
        raise ValueError(f"no rows {', '.join(str(r['row']) for r in unknown)}")
    out = review.apply_decisions(df, decisions, found)
    said = {r["action"]: r["n"] for r in decisions.groupBy("action").agg(F.count("*").alias("n")).collect()}
    new = store.create(store.entry(version_id)["project"], out, version_id, "reviewed", meta={"decisions": said})
    stored = store.load(new, provenance=True)
    queue = labeling.review_queue(stored, found, threshold)
    waits = queue.agg(F.count_distinct("row").alias("n")).first()["n"]
    facts = {"decisions": said, "waiting_rows": waits, "reviewed_rows": stored.where(labeling.origin_bucket(F.col(PROVENANCE)) == "human_reviewed").count()}
    rows = [checks.finding("unreviewed_labels", new, waits > 0, "warning", f"{waits} rows wait for review", {"rows": waits, "threshold": threshold})]
    return Done(new, facts, store.spark.createDataFrame(rows, checks.FINDINGS))
