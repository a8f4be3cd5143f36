"""The reference computations as queries over the test tables, with their SQL."""

from __future__ import annotations

from graincart.plans import evaluation, fidelity, generation, labels, models, profiles, rest, texts, training  # noqa: F401  they register themselves
from graincart.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
