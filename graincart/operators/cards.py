"""Cards of tables and models as Markdown, from aggregates that are already small."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.operators import profile

#: What secrets look like in a text, and in the names of settings.
SECRETS = (
    r"sk-[A-Za-z0-9_\-]{8,}",
    r"(?i)\bBearer\s+[A-Za-z0-9._\-]{12,}",
    r"(?i)\b(?:api[_-]?key|secret|token|password)\b\s*[:=]\s*\S{6,}",
)
SECRET_NAMES = r"(?i)api[_-]?key|secret|token|password|authorization|credential"
MARK = "[REDACTED]"


def without_secrets(text: Column) -> Column:
    """``text`` with all that looks like a credential replaced, its name too."""
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, MARK)
    return text


def without_secret_values(value):
    """A nested value without its secret entries, whatever they hold, and without credentials in its strings.

    The value is walked with a list of what is still to be copied and where to, so that no depth is
    too much; tuples become lists and keys become text.
    """
    found: list = [value]
    # (container, place in it) of each value that still stands as it was given
    todo: list[tuple[dict | list, object]] = [(found, 0)]
    credential = re.compile("|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in SECRETS))
    while todo:
        where, at = todo.pop()
        given = where[at]
        if isinstance(given, str):
            where[at] = credential.sub(MARK, given)
        elif isinstance(given, list | tuple):
            where[at] = [*given]
            todo += [(where[at], i) for i in range(len(given))]
        elif isinstance(given, dict):
            where[at] = {str(k): v for k, v in given.items()}
            for k in where[at]:
                if re.search(SECRET_NAMES, k):
                    where[at][k] = MARK
                else:
                    todo.append((where[at], k))
    return found[0]


def dataset_card(df: DataFrame, name: str, origin: str, provenance: dict[str, int] | None = None, meta: dict | None = None) -> str:
    """Rows, columns with kinds and missing rates, origins of rows, and the settings without secrets."""
    columns = [c for c in df.columns if not c.startswith("__")]
    told = {r["column"]: r["kind"] for r in profile.kinds(df, columns).collect()}
    first = df.agg(F.count("*").alias("_n"), *[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    lines = [f"# {name}", "", f"Origin: {origin}. Rows: {first['_n']}.", "", "| column | kind | missing |", "| --- | --- | --- |"]
    lines += [f"| {c} | {told[c]} | {first[c] or 0:.2%} |" for c in columns]
    if provenance:
        lines += ["", "| origin of rows | rows |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in sorted(provenance.items())]]
    if meta:
        lines += ["", "```json", json.dumps(without_secret_values(meta), indent=1, sort_keys=True, default=str), "```"]
    return "\n".join(lines) + "\n"


def model_card(name: str, task: str, target: str, features: list[str], metrics: dict[str, float | None], warnings: list[str] = ()) -> str:
    """What a model predicts from what, its held-out metrics, and what to beware of."""
    lines = [f"# {name}", "", f"A {task} model of `{target}` from {', '.join(f'`{f}`' for f in features)}.", "", "| metric | held-out value |", "| --- | --- |"]
    lines += [f"| {k} | {'not measured' if v is None else f'{v:.4f}'} |" for k, v in metrics.items()]
    if warnings:
        lines += ["", "Beware:", *[f"* {w}" for w in warnings]]
    return "\n".join(lines) + "\n"
