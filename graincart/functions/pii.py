"""Detectors of personal data in table cells, as expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from graincart.functions.text import masked

MARK = "[REDACTED]"


@dataclass(frozen=True)
class Detector:
    """A pattern; if ``digits`` is given, a span needs so many digits and their check digit.

    ``needs`` is a character that every span has; ``numeric`` tells that a span begins at most one
    character before its first digit, ends with a digit and has at most two other characters
    between two digits.
    """

    name: str
    pattern: str
    digits: tuple[int, int] | None = None
    needs: str | None = None
    numeric: bool = False


_BYTE = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: The detectors in the order in which they are applied. Guards keep versions and longer numbers out.
DETECTORS = (
    Detector("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+", needs="@"),
    Detector("phone", r"(?<![\d.])(?:\+1[\s.-]?|1[ -])?(?:\(?[2-9]\d{2}\)?[\s.-]\d{3}[\s.-]\d{4}|[2-9]\d{9})(?![\d.])", numeric=True),
    Detector("ssn", r"(?<!\d)(?!000|666|9\d\d)\d{3}-\d{2}-\d{4}(?!\d)", numeric=True),
    Detector("credit_card", r"(?<![\d.])(?:\d[ -]?){12,18}\d(?![\d.])", (13, 19), numeric=True),
    Detector("ip", rf"(?<![\d.]){_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}(?![\d.])", numeric=True),
)
BY_NAME = {d.name: d for d in DETECTORS}


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """The check digit of the digits of ``text``; fewer than two digits are false."""
    digits = digits_of(text)
    return (F.length(digits) >= 2) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def _confirmed(span: Column, detector: Detector) -> Column:
    if detector.digits is None:
        return F.lit(True)
    size = F.length(digits_of(span))
    return size.between(*detector.digits) & luhn(span)


def matches(text: Column, detector: Detector) -> Column:
    """array<string> of the spans that the detector confirms; none in a null."""
    found = F.coalesce(F.regexp_extract_all(text, F.lit(detector.pattern), F.lit(0)), F.array().cast("array<string>"))
    return F.filter(found, lambda x: _confirmed(x, detector)) if detector.digits else found


def near_digits(text: Column) -> Column:
    """``text`` with long runs between digits cut short: numeric detectors find the same spans in it, as no span and no guard reaches into what is cut."""
    return F.regexp_replace(text, r"([^0-9]{2})[^0-9]{2,}([^0-9]{2})", "$1~$2")


def span_count(text: Column, near: Column, detector: Detector) -> Column:
    """How many spans the detector confirms in ``text``, of which ``near`` is what ``near_digits`` leaves; none in a null."""
    n = F.size(matches(near if detector.numeric else text, detector)).cast("long")
    return F.when(F.contains(text, F.lit(detector.needs)), n).otherwise(F.lit(0).cast("long")) if detector.needs else n


def _rewritten(text: Column, detector: Detector, new) -> Column:
    """``text`` with ``new(span)`` for each confirmed span."""
    pieces = F.split(text, detector.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(detector.pattern), F.lit(0))
    joined = F.zip_with(pieces, found, lambda a, b: F.concat(a, F.when(b.isNull(), "").when(_confirmed(b, detector), new(b)).otherwise(b)))
    return F.array_join(joined, "")


def with_masked_spans(text: Column, detector: Detector) -> Column:
    """``text`` with each of the detector's spans masked."""
    return _rewritten(text, detector, masked)


def _marker(detector: Detector, mark: str) -> Callable[[Column], Column]:
    return lambda text: _rewritten(text, detector, lambda _: F.lit(mark))


def redacted(text: Column, detectors: tuple[Detector, ...] = DETECTORS, mark: str = MARK) -> Column:
    """``text`` with the spans of each detector replaced, one detector after another on what is left."""
    for d in detectors:
        if d.digits:
            # bound to a name, as it is used twice: what is before would be evaluated again
            text = F.transform(F.array(text), _marker(d, mark))[0]
        else:
            text = F.regexp_replace(text, d.pattern, mark)
    return text


def marks_added(before: Column, after: Column, mark: str = MARK) -> Column:
    """How many spans ``redacted`` has replaced."""
    held = lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))
    return F.coalesce(((held(after) - held(before)) / len(mark)).cast("long"), F.lit(0).cast("long"))
