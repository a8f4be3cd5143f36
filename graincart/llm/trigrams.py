"""Trigram queries for regular expressions.

For a pattern the query is a list of alternatives, each a set of trigrams that every match of
that alternative contains; an empty set means that the pattern has no mandatory trigram, so that
its rule scans all texts. Trigrams are in lower case and are looked up in texts in lower case.
"""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser

#: Sets of strings beyond this number are cut down to their prefixes and suffixes.
MOST_STRINGS = 64


class _Part:
    """What is known of a piece of a pattern: all its strings, or else the alternatives it needs."""

    def __init__(self, exact: set[str] | None = None, needs: list[frozenset[str]] | None = None):
        self.exact, self.needs = exact, needs or [frozenset()]


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _query(part: _Part) -> list[frozenset[str]]:
    return [_trigrams(s) for s in sorted(part.exact)] if part.exact is not None else part.needs


def _both(x: list[frozenset[str]], y: list[frozenset[str]]) -> list[frozenset[str]]:
    return list(dict.fromkeys(a | b for a, b in product(x, y)))


def _sequence(items) -> _Part:
    needs, run = [frozenset()], {""}
    all_exact = True
    for item in items:
        part = _one(*item)
        joined = {a + b for a, b in product(run, part.exact)} if part.exact is not None else None
        if joined is not None and len(joined) <= MOST_STRINGS:
            run = joined
            continue
        all_exact = False
        needs = _both(needs, [_trigrams(s) for s in sorted(run)])
        needs = _both(needs, _query(part)) if part.exact is None else needs
        run = part.exact if part.exact is not None and len(part.exact) <= MOST_STRINGS else {""}
    return _Part(exact=run) if all_exact else _Part(needs=_both(needs, [_trigrams(s) for s in sorted(run)]))


def _one(kind, value) -> _Part:
    if kind is op.LITERAL:
        return _Part(exact={chr(value).lower()})
    if kind is op.IN:
        chars = set()
        for what, x in value:
            if what is op.LITERAL:
                chars.add(chr(x).lower())
            elif what is op.RANGE and x[1] - x[0] < 8:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return _Part()
        return _Part(exact=chars) if len(chars) <= 8 else _Part()
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(p.exact is not None for p in parts):
            return _Part(exact=set().union(*(p.exact for p in parts)))
        return _Part(needs=list(dict.fromkeys(q for p in parts for q in _query(p))))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        part = _sequence(inner)
        if (low, high) == (0, 1) and part.exact is not None:
            return _Part(exact=part.exact | {""})
        if low == 0:
            return _Part()
        return _Part(needs=_query(part))
    if kind is op.AT:
        return _Part(exact={""})
    return _Part()


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The alternatives of ``pattern``; any text with a match holds all trigrams of one of them."""
    query = _query(_sequence(_parser.parse(pattern)))
    return [frozenset()] if any(not q for q in query) else [q for q in query if not any(r < q for r in query)]
