"""Calls of a slow function from inside a task: a bounded number at once, retried with growing waits, results in order."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

WORKERS, RETRIES, WAIT = 4, 2, 0.2
#: Rows that are handed on together however fast they come, and seconds after which fewer are.
MOST, HELD = 1000, 0.5


@dataclass(frozen=True)
class Outcome:
    """What a call gave, or the last error after all its attempts."""

    item: Any
    value: Any
    error: str | None
    attempts: int


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as the cluster runs tasks at least, as few files would keep few tasks busy; streams stay as they are."""
    spark = df.sparkSession
    return df if df.isStreaming else df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def called(ask: Callable[[Any], Any], item: Any, retries: int = RETRIES, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> Outcome:
    """One call, repeated ``retries`` times at most; before repetition i it waits ``wait * 2**i`` seconds."""
    error = None
    for attempt in range(retries + 1):
        try:
            return Outcome(item, ask(item), None, attempt + 1)
        except Exception as e:  # noqa: BLE001  the function may fail in any way, and is told
            error = f"{type(e).__name__}: {e}"
        if attempt < retries:
            sleep(wait * 2**attempt)
    return Outcome(item, None, error, retries + 1)


def outcomes(ask: Callable[[Any], Any], items: Iterable[Any], workers: int = WORKERS, retries: int = RETRIES, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> Iterator[Outcome]:
    """The outcomes in the order of ``items``, handed on as soon as all before them are there.

    ``workers`` calls run at once. Not more than twice as many items are taken before their turn, so
    that neither a long list nor a slow reader fills memory.
    """
    if workers < 1:
        raise ValueError(f"workers must be 1 or more, not {workers}")
    waiting: deque = deque()
    with ThreadPoolExecutor(workers) as threads:
        try:
            for item in items:
                waiting.append(threads.submit(called, ask, item, retries, wait, sleep))
                if len(waiting) >= 2 * workers:
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()
        finally:
            for call in waiting:
                call.cancel()


class Held:
    """Counts rows that wait to be handed on: enough are ``least`` of them if the last went out long ago, else MOST."""

    def __init__(self, least: int, clock: Callable[[], float] = time.monotonic) -> None:
        self.least, self.clock, self.last = least, clock, clock()

    def enough(self, rows: int) -> bool:
        if rows < self.least or (rows < MOST and self.clock() - self.last < HELD):
            return False
        self.last = self.clock()
        return True
