"""Training as a whole: which rows and columns are used, fitted features, and a run over several models."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graincart import tables
from graincart.operators import checks, metrics, models, prep
from graincart.operators.cards import without_secret_values
from graincart.operators.profile import kinds
from graincart.operators.quantiles import medians
from graincart.operators.schema import features

FORMAT = 2
MISSING = "__missing__"
#: Categories that a column may have to be a feature.
MOST_CATEGORIES = 1000
#: Terms of a text column, and rows that must have one.
TERMS, LEAST_ROWS = 2000, 1
#: What ranks models, and whether more of it is better.
RANKED_BY = {"classification": ("accuracy", True), "regression": ("rmse", False)}
_RESULT = "model string, status string, error string, metrics map<string, double>, options string"


class NotTrainable(ValueError):
    """The rows or columns do not allow a model of the target."""


@dataclass(frozen=True)
class Setup:
    """Rows with ``split``, the task, features with their kinds, why other columns are none, and counts of rows."""

    rows: DataFrame
    key: tuple[str, ...]
    target: str
    task: str
    features: dict[str, str]
    reasons: dict[str, str]
    counts: dict[str, int]


def setup(df: DataFrame, target: str, key: Iterable[str], share: float = 0.2, seed: int = 42, excluded: tuple[str, ...] = (), sensitive: tuple[str, ...] = (), unreviewed: Column | None = None) -> Setup:
    """What a run trains on. ``key`` names a row and is no feature; rows without target, or marked ``unreviewed``, are left out.

    Raises NotTrainable if the target or the features are missing, a column is named ``split``, or
    there are fewer than two rows or, for a classification, classes.
    """
    key = tuple(key)
    if target not in df.columns:
        raise NotTrainable(f"no column {target}")
    if "split" in df.columns:
        raise NotTrainable("a column is named split already")
    used, reasons = features([c for c in df.columns if c not in key], target, excluded, sensitive)
    if not used:
        raise NotTrainable("no features")
    told = {r["column"]: r["kind"] for r in kinds(df, [*used, target]).collect()}
    task = prep.task_type(df, target, told[target]).first()["task"]
    known, doubtful = F.col(target).isNotNull(), F.coalesce(unreviewed, F.lit(False)) if unreviewed is not None else F.lit(False)
    rows = prep.split(df.where(known & ~doubtful).select(*key, *used, target), [*key], share, seed, target if task == "classification" else None)
    seen = df.agg(F.count("*").alias("given"), F.count_if(~known).alias("without_target"), F.count_if(known & doubtful).alias("unreviewed")).first().asDict()
    kept = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"), F.count_distinct(target).alias("classes")).first().asDict()
    if kept["rows"] < 2:
        raise NotTrainable("fewer than two rows have the target")
    if task == "classification" and kept["classes"] < 2:
        raise NotTrainable("the target has one class")
    return Setup(rows, key, target, task, {c: told[c] for c in used}, reasons, seen | kept)


def plan(s: Setup, names: Iterable[str]) -> dict[str, str | None]:
    """For each model why it cannot be fitted, or None; nothing is fitted."""
    problem = lambda n: "unknown model" if n not in models.REGISTRY else None if s.task in models.REGISTRY[n].tasks else f"does not do {s.task}"
    return {n: problem(n) for n in names}


@dataclass(frozen=True)
class Feature:
    """How a column becomes numbers: scaled numbers (of times, their seconds), 0 and 1, one number for each category, or weights of terms."""

    column: str
    kind: str
    median: float = 0.0
    mean: float = 0.0
    std: float = 1.0
    categories: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()
    idf: tuple[float, ...] = ()
    grams: tuple[int, int] = (1, 1)

    def vectors(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with ``out``: the weights of the terms of a text as a sparse vector of length 1, or of zeros."""
        words, counts, weighed = f"{out}_words", f"{out}_counts", f"{out}_weighed"
        df = df.withColumn(words, prep.grams(self.column, *self.grams))
        df = CountVectorizerModel.from_vocabulary([*self.terms], inputCol=words, outputCol=counts).transform(df)
        df = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol=counts, outputCol=weighed).transform(df)
        return Normalizer(p=2.0, inputCol=weighed, outputCol=out).transform(df).drop(words, counts, weighed)


def _finite(feature: Feature) -> Column:
    x = prep.epoch_seconds(F.col(feature.column)) if feature.kind == "datetime" else F.col(feature.column).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _category(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


@dataclass(frozen=True)
class Spec:
    """Fitted features. ``inputs`` are the columns that ``encoded`` makes, ``names`` what they stand for."""

    features: tuple[Feature, ...]

    @property
    def sources(self) -> list[tuple[str, str]]:
        """Readable name of each input, and the column it comes from."""
        out = []
        for f in self.features:
            if f.kind == "text":
                out += [(f"tfidf:{f.column}={t}", f.column) for t in f.terms]
            else:
                out += [(f"{f.column}={c}", f.column) for c in f.categories] if f.kind == "categorical" else [(f.column, f.column)]
        return out

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.sources]

    @property
    def parts(self) -> list[tuple[str, list[tuple[str, str]]]]:
        """Each column that ``encoded`` makes, with names and sources of what is in it: one number, or the terms of a text."""
        out, sources = [], iter(self.sources)
        for i, f in enumerate(self.features):
            if f.kind == "text":
                out.append((f"_text{i}", [next(sources) for _ in f.terms]))
            else:
                out += [(f"_x{i}_{j}", [next(sources)]) for j in range(len(f.categories) if f.kind == "categorical" else 1)]
        return out

    @property
    def inputs(self) -> list[str]:
        return [c for c, _ in self.parts]

    def encoded(self, df: DataFrame, keep: Iterable[str]) -> DataFrame:
        """The columns of ``keep`` and the inputs; categories and terms that training has not seen are 0 everywhere."""
        out = []
        for i, f in enumerate(self.features):
            if f.kind == "text":
                df = f.vectors(df, f"_text{i}")
                out.append(F.col(f"_text{i}"))
            elif f.kind == "categorical":
                out += [(_category(f.column) == c).cast("double") for c in f.categories]
            elif f.kind == "bool":
                out.append(F.coalesce(F.col(f.column).cast("boolean").cast("double"), F.lit(0.0)))
            else:
                out.append((F.coalesce(_finite(f), F.lit(f.median)) - f.mean) / f.std)
        return df.select(*keep, *[x.alias(name) for x, name in zip(out, self.inputs, strict=True)])

    def to_json(self) -> str:
        return json.dumps({"format": FORMAT, "features": [asdict(f) for f in self.features]}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Spec:
        told = json.loads(text)
        if told.get("format") != FORMAT:
            raise ValueError(f"features of format {told.get('format')}, not {FORMAT}")
        lists = ("categories", "terms", "idf", "grams")
        return cls(tuple(Feature(**f | {c: tuple(f[c]) for c in lists}) for f in told["features"]))


def fit_spec(train: DataFrame, columns: dict[str, str], terms: int = TERMS, least: int = LEAST_ROWS, grams: tuple[int, int] = (1, 1)) -> tuple[Spec, dict[str, str]]:
    """Features of ``columns`` (name: kind) as the training rows have them, and why a column gives none.

    Medians are selected exactly for all columns at once, means and deviations of the filled values from a aggregation;
    categories are counted before they are read. Numbers that are not finite count as missing. Of a
    text the ``terms`` terms stand that most rows have, at least ``least`` of them, with their inverse
    document frequencies; columns with over MOST_CATEGORIES categories, and texts without terms, give none.
    """
    reasons: dict[str, str] = {}
    numbers = [Feature(c, k) for c, k in columns.items() if k in ("integer", "number", "datetime")]
    categories: dict[str, list[str]] = {c: [] for c, k in columns.items() if k == "categorical"}
    if numbers:
        told = medians(train, {f.column: _finite(f) for f in numbers})
        middles = [told.get(f.column, 0.0) for f in numbers]
        filled = [F.coalesce(_finite(f), F.lit(m)) for f, m in zip(numbers, middles, strict=True)]
        facts = train.agg(*[F.struct(F.avg(x), F.stddev_pop(x)).alias(f"s{i}") for i, x in enumerate(filled)]).first()
        numbers = [Feature(f.column, f.kind, m, s[0] or 0.0, s[1] or 1.0) for f, m, s in zip(numbers, middles, facts, strict=True)]
    if categories:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _category(c).alias("value")) for c in categories]))
        values = train.select(pairs.alias("p")).select("p.*").distinct()
        sizes = {r["column"]: r["n"] for r in values.groupBy("column").agg(F.count("*").alias("n")).collect()}
        few = [c for c in categories if sizes.get(c, 0) <= MOST_CATEGORIES]
        for r in values.where(F.col("column").isin(few)).collect():
            categories[r["column"]].append(r["value"])
    fitted = {f.column: f for f in numbers}
    for c, found in categories.items():
        if c in few:
            fitted[c] = Feature(c, "categorical", categories=tuple(sorted(found, key=lambda v: (v == MISSING, v))))
        else:
            reasons[c] = "too many categories"
    fitted |= {c: Feature(c, "bool") for c, k in columns.items() if k == "bool"}
    texts = [c for c, k in columns.items() if k == "text"]
    rows = train.count() if texts else 0
    for c in texts:
        # as many rows as ``terms`` asks for
        found = sorted((r["term"], r["df"]) for r in prep.vocabulary(train, c, terms, least, *grams).collect())
        if found:
            fitted[c] = Feature(c, "text", terms=tuple(t for t, _ in found), idf=tuple(math.log((1 + rows) / (1 + n)) + 1 for _, n in found), grams=tuple(grams))
        else:
            reasons[c] = "no terms"
    return Spec(tuple(fitted[c] for c in columns if c in fitted)), reasons


def leak_list(s: Setup, spec: Spec | None = None, least: float = checks.LEAK) -> DataFrame:
    """``checks.leaks`` of the encoded training rows: a category or a term is reported under the column it comes from."""
    train = s.rows.where("split = 'train'")
    spec = spec or fit_spec(train, s.features)[0]
    rows = spec.encoded(train, [s.target])
    numbers = {told[0][0]: (told[0][1], F.col(x)) for x, told in spec.parts if not x.startswith("_text")}
    terms = {x: told for x, told in spec.parts if x.startswith("_text")}
    return checks.leaks(rows, numbers, s.target, s.task, least, terms)


def findings(s: Setup, spec: Spec | None = None) -> DataFrame:
    """(kind, subject, raised, severity, message, details as JSON): the checks of a setup, each told whether it is raised or not.

    class_imbalance, train_test_duplicates (rows equal in all features and target),
    target_leakage, unreviewed_labels and label_sibling_exclusion.
    """
    spark, out = s.rows.sparkSession, []
    if s.task == "classification":
        told = checks.imbalance(s.rows, s.target).first()
        share = told["min_fraction"]
        out.append(checks.finding("class_imbalance", s.target, bool(told["warn"]), "warning", f"the smallest class of {s.target} has {share:.0%} of the rows", {"min_fraction": share, "threshold": checks.SMALL_CLASS}))
    else:
        out.append(checks.finding("class_imbalance", s.target, False, "warning", "", {"reason": "not a classification"}))
    twice = checks.overlap(s.rows, [*s.features, s.target]).first().asDict()
    out.append(checks.finding("train_test_duplicates", s.target, bool(twice["warn"]), "warning", f"{twice['count']} training rows are equal to held-out rows", {"count": twice["count"], "fraction": twice["fraction"]}))
    leaked = [r.asDict() for r in leak_list(s, spec).where("warn").orderBy(F.desc("score"), "feature").limit(100).collect()]
    names = ", ".join(sorted({r["column"] for r in leaked}))
    out.append(checks.finding("target_leakage", s.target, bool(leaked), "warning", f"{names} tell {s.target} on their own", {"suspects": leaked, "threshold": checks.LEAK}))
    left_out = s.counts.get("unreviewed", 0)
    out.append(checks.finding("unreviewed_labels", s.target, left_out > 0, "info", f"{left_out} rows whose label waits for review are left out", {"excluded_rows": left_out}))
    near = sorted(c for c, why in s.reasons.items() if why == "target_sibling")
    out.append(checks.finding("label_sibling_exclusion", s.target, bool(near), "info", f"{', '.join(near)} belong to the label {s.target} and are no features", {"excluded": near}))
    return spark.createDataFrame(out, checks.FINDINGS)


def run(s: Setup, names: Iterable[str], path: str | None = None, options: dict[str, dict] | None = None, grids: dict[str, dict[str, list]] | None = None, folds: int = 3, most: int | None = None, seed: int = 0) -> DataFrame:
    """(model, status, error, metrics, options, rank, standing): models of a setup, ranked by the held-out rows.

    A model with a grid of options is tuned on the training rows first (``models.search``), and what it
    was fitted with is told in ``options`` as JSON. Models with probabilities are also measured by
    auc_macro and average_precision_macro. A model that fails is told with its error and the others
    go on. With ``path`` the split's digest, the fitted features and each result are written as they
    come; a run that starts again reads them, only does what has no result that is ok, and raises
    NotTrainable if its rows are split otherwise.
    """
    spark = s.rows.sparkSession
    spec = _kept_spec(s, path)
    if not spec.features:
        raise NotTrainable("no features that a model takes")
    found = [tuple(r) for r in _results(spark, f"{path}/results").where("status = 'ok'").collect()] if path else []
    done = {r[0] for r in found}
    rows = tables.written(spec.encoded(s.rows, [*s.key, s.target, "split"]))
    try:
        for name, problem in plan(s, names).items():
            if name in done:
                continue
            row = (name, "failed", problem, None, None) if problem else _one(s, spec, rows, name, (options or {}).get(name, {}), (grids or {}).get(name), folds, most, seed)
            found.append(row)
            if path:
                spark.createDataFrame([row], _RESULT).write.mode("append").parquet(f"{path}/results")
    finally:
        tables.drop(rows)
    by, more = RANKED_BY[s.task]
    told = spark.createDataFrame(found, _RESULT).withColumn(by, F.col("metrics")[by])
    return metrics.leaderboard(told, by, more).drop(by)


def _kept_spec(s: Setup, path: str | None) -> Spec:
    """The features fitted on the training rows; with a path those of its first run, whose split must be the same."""
    spark, train = s.rows.sparkSession, s.rows.where("split = 'train'")
    if not path:
        return fit_spec(train, s.features)[0]
    try:
        told = spark.read.parquet(f"{path}/split")
        features = spark.read.parquet(f"{path}/features").first()["features"]
    except AnalysisException:
        spec = fit_spec(train, s.features)[0]
        spark.createDataFrame([(spec.to_json(),)], "features string").write.mode("overwrite").parquet(f"{path}/features")
        split_digest(s.rows, s.key).write.mode("overwrite").parquet(f"{path}/split")
        return spec
    if not same_split(s.rows, told, s.key):
        raise NotTrainable("the results at this path are of rows that were split otherwise")
    return Spec.from_json(features)


def _results(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_RESULT).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], _RESULT)


def _one(s: Setup, spec: Spec, rows: DataFrame, name: str, options: dict, grid: dict[str, list] | None, folds: int, most: int | None, seed: int) -> tuple:
    try:
        if grid:
            by, more = RANKED_BY[s.task]
            score = lambda scored: held_out_metrics(s, scored)[by] * (1 if more else -1)
            best, _ = models.search(rows.where("split = 'train'").drop("split"), name, s.task, spec.inputs, s.target, grid, score, [*s.key], folds, most, seed, options)
            options = options | best
        model = models.fit(rows, name, s.task, spec.inputs, s.target, **options)
        values = held_out_metrics(s, models.predict(model, rows.where("split = 'test'"), spec.inputs))
    except Exception as e:  # whatever a model's library raises must not end the run
        return name, "failed", f"{type(e).__name__}: {e}"[:2000], None, json.dumps(options, sort_keys=True)
    return name, "ok", None, values, json.dumps(options, sort_keys=True)


def held_out_metrics(s: Setup, scored: DataFrame) -> dict[str, float]:
    """The metrics of predicted rows that have a value, those of ranking too if there are probabilities."""
    if s.task == "regression":
        values = metrics.regression(scored, s.target, "predicted").first().asDict()
    else:
        scored = scored.withColumn(s.target, F.col(s.target).cast("string"))
        values = metrics.classification(scored, s.target, "predicted").first().asDict()
        chances = {c.removeprefix("probability_"): F.col(f"`{c}`") for c in scored.columns if c.startswith("probability_")}
        if chances:
            # of two classes the last is the positive one
            chances = dict([[*chances.items()][-1]]) if len(chances) == 2 else chances
            told = metrics.macro(metrics.one_vs_rest(scored, s.target, chances)).first().asDict()
            values |= {c: told[c] for c in ("auc_macro", "average_precision_macro")}
    return {k: float(v) for k, v in values.items() if v is not None and not isinstance(v, str)}


def split_digest(rows: DataFrame, key: Iterable[str]) -> DataFrame:
    """(split, rows, digest) that two equal splits share, in whatever order their rows come."""
    each = F.xxhash64(*[F.col(c).cast("string") for c in key])
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.sum(each.cast("decimal(38,0)")).cast("string").alias("digest"))


def same_split(rows: DataFrame, told: DataFrame, key: Iterable[str]) -> bool:
    """Whether ``rows`` have the split whose digest was ``told``."""
    a, b = ({tuple(r) for r in d.select("split", "rows", "digest").collect()} for d in (split_digest(rows, key), told))
    return a == b


def fairness_run(s: Setup, name: str, whole: DataFrame, group: str, least: int = 1, threshold: float = 0.1, options: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Report of all groups of ``whole`` by a model's held-out rows, and the gaps between measured groups.

    ``whole`` has the key and ``group``, which need not be a feature. The positive class is the last
    one by name. For a regression the gap of the mean absolute error is also given relative to that
    of all rows (``relative``), and this is what is held against ``threshold``.
    """
    spec, _ = fit_spec(s.rows.where("split = 'train'"), s.features)
    rows = spec.encoded(s.rows, [*s.key, s.target, "split"])
    model = models.fit(rows, name, s.task, spec.inputs, s.target, **(options or {}))
    scored = models.predict(model, rows.where("split = 'test'"), spec.inputs).select(*s.key, F.col(s.target).alias("_truth"), F.col("predicted").alias("_told"))
    scored = scored.join(whole.select(*s.key, F.col(group).alias("_of")), [*s.key])
    if s.task == "classification":
        positive = s.rows.agg(F.max(F.col(s.target).cast("string"))).first()[0]
        scores = metrics.group_classification(scored, "_of", F.col("_truth").cast("string") == positive, F.col("_told") == positive)
        report = metrics.group_report(whole, group, scores, least)
        return report, metrics.gaps(report, ["accuracy", "selection_rate", "tpr", "fpr"], threshold)
    report = metrics.group_report(whole, group, metrics.group_regression(scored, "_of", "_truth", "_told"), least)
    error = scored.agg(F.avg(F.abs(F.col("_truth").cast("double") - F.col("_told")))).first()[0]
    found = metrics.gaps(report, ["mae"], threshold).withColumn("relative", F.try_divide("gap", F.lit(error)))
    return report, found.withColumn("exceeds", F.coalesce(F.col("relative") > threshold, F.lit(False)))


def fairness_checks(gaps: DataFrame, subject: str, group: str, was_feature: bool = False) -> DataFrame:
    """(kind, severity, subject): a warning for each gap that exceeds, and a note if the group was a feature."""
    warned = gaps.where("exceeds").select(F.concat(F.lit("fairness_"), "metric").alias("kind"), F.lit("warning").alias("severity"), F.lit(subject).alias("subject"))
    if not was_feature:
        return warned
    note = gaps.sparkSession.createDataFrame([(f"feature_{group}", "info", subject)], "kind string, severity string, subject string")
    return warned.unionByName(note)


def write_bundle(path: str, s: Setup, spec: Spec, model: PipelineModel, card: str, meta: dict | None = None) -> None:
    """A fitted model with all that predictions need, in a folder that Spark can write: model, features, inputs, metadata and card."""
    model.write().overwrite().save(f"{path}/model")
    told = {
        "features.json": spec.to_json(),
        "input_schema.json": s.rows.select(*[f.column for f in spec.features]).schema.json(),
        "metadata.json": json.dumps(without_secret_values({"task": s.task, "target": s.target, "counts": s.counts} | (meta or {})), sort_keys=True, default=str),
        "model_card.md": card,
    }
    spark = s.rows.sparkSession
    spark.createDataFrame([*told.items()], "name string, content string").coalesce(1).write.mode("overwrite").parquet(f"{path}/files")


def read_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, Spec, dict[str, str]]:
    """Model, features and files of a bundle."""
    files = {r["name"]: r["content"] for r in spark.read.parquet(f"{path}/files").collect()}
    return PipelineModel.load(f"{path}/model"), Spec.from_json(files["features.json"]), files
