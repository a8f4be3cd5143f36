"""Decisions about columns, made on names and kinds before any row is read."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from graincart.operators.labeling import EXCLUDED, PROVENANCE, families

_NAME = re.compile(r"[a-z][a-z0-9]*(?:_[a-z0-9]+)*")
KINDS = ("bool", "integer", "number", "datetime", "categorical", "text")


def slug(option: str) -> str:
    return "p_" + re.sub(r"[^A-Za-z0-9]+", "_", option).strip("_").lower()


@dataclass(frozen=True)
class Question:
    """A question for the evaluator: binary, choice (two options or more) or score (two levels or more)."""

    name: str
    kind: str
    options: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not _NAME.fullmatch(self.name):
            raise ValueError(f"{self.name!r} is not a snake_case name")
        if self.kind not in ("binary", "choice", "score"):
            raise ValueError(f"unknown kind of question: {self.kind}")
        if self.kind != "binary" and len(set(self.options)) < 2:
            raise ValueError(f"{self.name} needs two different options or more")
        if self.kind == "choice" and len({slug(o) for o in self.options}) < len(self.options):
            raise ValueError(f"options of {self.name} have the same column name")

    def columns(self) -> list[str]:
        more = {"binary": [], "choice": [f"{self.name}__{slug(o)}" for o in self.options], "score": [f"{self.name}__probabilities"]}
        return [self.name, f"{self.name}__confidence", *more[self.kind]]


def label_columns(questions: list[Question], existing: list[str]) -> list[str]:
    """The columns that the answers get; an error if any exists or comes twice."""
    names = [c for q in questions for c in q.columns()]
    twice = {c for c in names if names.count(c) > 1}
    if twice or set(names) & set(existing):
        raise ValueError(f"columns are taken: {', '.join(sorted(twice | set(names) & set(existing)))}")
    return names


def state_columns(columns: list[str], chosen: list[str] | None, outputs: list[str]) -> list[str]:
    """The columns that the evaluator sees: the chosen ones, or all but provenance."""
    chosen = [c for c in columns if c != PROVENANCE] if chosen is None else chosen
    if unknown := [c for c in chosen if c not in columns]:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    if clash := [c for c in chosen if c in outputs]:
        raise ValueError(f"an answer cannot see itself: {', '.join(clash)}")
    return chosen


def siblings(columns: list[str], target: str) -> list[str]:
    """The other columns of the target's label family."""
    head = target.split("__", 1)[0]
    if head not in families(columns):
        return []
    return [c for c in columns if c != target and (c == head or c.startswith(f"{head}__"))]


def features(columns: list[str], target: str, excluded: tuple[str, ...] = (), sensitive: tuple[str, ...] = (), use_sensitive: bool = False) -> tuple[list[str], dict[str, str]]:
    """The features of a target, and for every other column the first reason why it is none."""
    near = set(siblings(columns, target))
    reasons = {}
    for c in columns:
        if c in (PROVENANCE, EXCLUDED):
            reasons[c] = "provenance"
        elif c == target:
            reasons[c] = "target"
        elif c in near:
            reasons[c] = "target_sibling"
        elif c in excluded:
            reasons[c] = "user"
        elif c in sensitive and not use_sensitive:
            reasons[c] = "sensitive"
    return [c for c in columns if c not in reasons], reasons


@dataclass(frozen=True)
class ColumnSpec:
    """A declared column."""

    name: str
    kind: str
    low: float | None = None
    high: float | None = None
    categories: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind: {self.kind}")
        if self.low is not None and self.high is not None and self.low > self.high:
            raise ValueError(f"{self.name}: the least value is above the greatest")
        if self.kind == "categorical" and not self.categories:
            raise ValueError(f"{self.name}: categories are missing")
