"""Rows from a text generator, a callable that takes a prompt and returns a string.

Requests are numbered batches; each runs in the task that holds its number, with retries that tell
the generator what was wrong, and is a function of the batch alone, so that a lost task can run again.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincart import tables
from graincart.operators import pool, synth
from graincart.operators.profile import kinds
from graincart.operators.running import running_sums
from graincart.operators.schema import KINDS, ColumnSpec, Question
from graincart.operators.validation import validated

#: Rows of a request, texts of one, and how often a reply that cannot be used is asked for again.
BATCH, TEXTS, RETRIES = 25, 10, 2


def parse_reply(reply: str) -> list | dict | None:
    """JSON from a reply: all of it, a fenced part, or the first object or list in it that can be read, whichever opens first."""
    fenced = reply.split("```")[1].removeprefix("json") if reply.count("```") >= 2 else None
    for text in (reply, fenced):
        try:
            found = json.loads(text) if text else None
        except ValueError:
            continue
        if isinstance(found, list | dict):
            return found
    decoder = json.JSONDecoder()
    for at in (i for i, c in enumerate(reply) if c in "[{"):
        try:
            return decoder.raw_decode(reply, at)[0]
        except ValueError:
            continue
    return None


def rows_of(reply: list | dict | None) -> list[dict] | None:
    """The objects of a reply: a list of them, or the one list of them that an object has; else None."""
    if isinstance(reply, dict):
        lists = [v for v in reply.values() if isinstance(v, list)]
        reply = lists[0] if len(lists) == 1 else None
    return reply if isinstance(reply, list) and reply and all(isinstance(r, dict) for r in reply) else None


def specs_of(df: DataFrame, columns: list[str], most: int = 100) -> list[ColumnSpec]:
    """Declared columns as those of ``df`` are: ranges of numbers, categories of up to ``most`` values; others are texts."""
    columns = [c for c in columns if not c.startswith("__")]
    told = {r["column"]: r["kind"] for r in kinds(df, columns).collect()}
    numbers = [c for c in columns if told[c] in ("integer", "number")]
    ends = df.agg(F.lit(0), *[f(F.col(f"`{c}`").cast("double")) for c in numbers for f in (F.min, F.max)]).first()
    out = []
    for c in columns:
        if c in numbers:
            at = 1 + 2 * numbers.index(c)
            out.append(ColumnSpec(c, told[c], ends[at], ends[at + 1]))
        elif told[c] == "categorical":
            found = [r[0] for r in df.where(F.col(f"`{c}`").isNotNull()).select(F.col(f"`{c}`").cast("string")).distinct().limit(most + 1).collect()]
            out.append(ColumnSpec(c, "categorical", categories=tuple(sorted(found))) if 0 < len(found) <= most else ColumnSpec(c, "text"))
        else:
            out.append(ColumnSpec(c, told[c]))
    return out


_TYPES = {"integer": "integer", "number": "number", "bool": "boolean"}


def reply_schema(specs: list[ColumnSpec], n: int) -> dict:
    """The JSON schema of a reply: ``rows``, at most ``n`` objects with all columns, each of its type, range or categories."""
    columns = {}
    for s in specs:
        told: dict = {"type": _TYPES.get(s.kind, "string")}
        told |= {"minimum": s.low} if s.low is not None else {}
        told |= {"maximum": s.high} if s.high is not None else {}
        told |= {"enum": [*s.categories]} if s.kind == "categorical" else {"format": "date-time"} if s.kind == "datetime" else {}
        columns[s.name] = told
    row = {"type": "object", "properties": columns, "required": [s.name for s in specs], "additionalProperties": False}
    return {"type": "object", "properties": {"rows": {"type": "array", "maxItems": n, "items": row}}, "required": ["rows"]}


def prompt_for(specs: list[ColumnSpec], n: int, batch: int, trouble: str = "", description: str = "", shares: dict[str, dict[str, float]] | None = None) -> str:
    """What the generator is asked for: columns, the schema of the reply, and where they are wanted the shares of values."""
    columns = [{"name": s.name, "type": s.kind, "min": s.low, "max": s.high, "categories": list(s.categories)} for s in specs]
    ask = f"Write {n} rows as a JSON list of objects with these columns: {json.dumps(columns)}. Batch {batch}. They must fit this schema: {json.dumps(reply_schema(specs, n))}."
    if description:
        ask += f" The rows are about: {description}."
    for column, wanted in (shares or {}).items():
        ask += f" Of the values of {column}, " + ", ".join(f"{share:.0%} should be {value}" for value, share in wanted.items()) + "."
    return f"{ask} The last reply could not be used: {trouble}" if trouble else ask


def suggest_specs(generator: Callable[[str], str], description: str, most: int = 20, retries: int = RETRIES) -> list[ColumnSpec]:
    """Columns that a generator suggests for a description. What cannot be a column is left out; ValueError if nothing is left."""
    kinds_ = ", ".join(KINDS)
    ask = f"Suggest up to {most} columns of a table about: {description}. Reply as a JSON list of objects with name, type (one of {kinds_}), and where they make sense min, max and categories."

    def one(prompt: str) -> list[ColumnSpec]:
        out: dict[str, ColumnSpec] = {}
        for told in (rows_of(parse_reply(generator(prompt))) or [])[:most]:
            name = re.sub(r"[^a-z0-9]+", "_", str(told.get("name") or "").lower()).strip("_")
            try:
                low, high = (float(told[c]) if told.get(c) is not None else None for c in ("min", "max"))
                spec = ColumnSpec(name, str(told.get("type")), low, high, tuple(str(c) for c in told.get("categories") or ()))
            except (TypeError, ValueError):
                continue
            if name and name not in out:
                out[name] = spec
        if not out:
            raise ValueError("no columns")
        return [*out.values()]

    found = pool.called(one, ask, retries)
    if found.error:
        raise ValueError(f"the generator suggests no columns: {found.error}")
    return found.value


def draft_question(generator: Callable[[str], str], description: str, retries: int = RETRIES) -> tuple[Question, str]:
    """A question for the evaluator, and its wording, that a generator drafts from a description; ValueError if no draft is one."""
    ask = f"Draft one question about a row for: {description}. Reply as a JSON object with name (snake case), kind (binary, choice or score), text, and for a choice or score options."

    def one(prompt: str) -> tuple[Question, str]:
        told = parse_reply(generator(prompt))
        if not isinstance(told, dict):
            raise ValueError("no object")
        return Question(str(told.get("name")), str(told.get("kind")), tuple(str(o) for o in told.get("options") or ())), str(told.get("text") or "")

    found = pool.called(one, ask, retries)
    if found.error:
        raise ValueError(f"the generator drafts no question: {found.error}")
    return found.value


def fake_generator(prompt: str) -> str:
    """A stand-in that draws values from a hash of the prompt."""
    head = prompt.split(" The last reply", 1)[0]
    n = int(head.split(" ", 2)[1])
    columns = json.JSONDecoder().raw_decode(head, head.index("[{"))[0]
    draw = lambda *key: int.from_bytes(hashlib.sha256("::".join(map(str, (head, *key))).encode()).digest()[:8], "big") / 2**64

    def value(c: dict, i: int):
        u = draw(c["name"], i)
        low, high = c["min"] if c["min"] is not None else 0, c["max"] if c["max"] is not None else 100
        kinds = {"integer": lambda: int(low + u * (high - low)), "number": lambda: low + u * (high - low), "bool": lambda: u < 0.5, "datetime": lambda: f"2024-01-{1 + int(u * 28):02d} 00:00:00", "categorical": lambda: c["categories"][int(u * len(c["categories"]))]}
        return kinds.get(c["type"], lambda: f"{c['name']} {int(u * 1000)}")()

    return json.dumps([{c["name"]: value(c, i) for c in columns} for i in range(n)])


def _asked(numbers: DataFrame, specs: list[ColumnSpec], generator: Callable[[str], str], retries: int, workers: int) -> DataFrame:
    """(batch, place, calls, trouble, columns...): the rows that the generator gives for each of ``numbers`` (batch, size), as text.

    A batch whose replies cannot be used is one row of nulls, with place null and the trouble.
    """
    names = [s.name for s in specs]

    def one(item: tuple[int, int]) -> tuple[list[dict], int, str]:
        number, size = item
        trouble = ""
        for attempt in range(retries + 1):
            try:
                rows = rows_of(parse_reply(generator(prompt_for(specs, size, number, trouble))))
            except Exception as e:  # noqa: BLE001  a generator may fail in any way
                trouble = f"{type(e).__name__}: {e}"
                continue
            if rows:
                return rows[:size], attempt + 1, ""
            trouble = "it was no list of objects"
        return [], retries + 1, trouble

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = ((int(n), int(s)) for frame in frames for n, s in zip(frame["batch"], frame["size"], strict=True))
        rows, held = [], pool.Held(1)
        told = lambda: pd.DataFrame(rows, columns=["batch", "place", "calls", "trouble", *names], dtype=object)
        for o in pool.outcomes(one, items, workers, retries=0):
            found, calls, trouble = o.value if o.error is None else ([], retries + 1, o.error)
            made = [(o.item[0], i, calls, None, *[None if r.get(c) is None else str(r[c]) for c in names]) for i, r in enumerate(found)]
            rows += made or [(o.item[0], None, calls, trouble[:500], *[None] * len(names))]
            if held.enough(len(rows)):
                yield told()
                rows.clear()
        if rows:
            yield told()

    schema = "batch bigint, place bigint, calls int, trouble string, " + ", ".join(f"`{c}` string" for c in names)
    return numbers.mapInPandas(run, schema)


@dataclass(frozen=True)
class Generated:
    """Rows with __row_id__, how many were asked for, and what it took; ``stopped`` tells why rows are missing, if any are."""

    rows: DataFrame
    asked: int
    count: int
    dropped: int
    calls: int
    rounds: int
    stopped: str | None

    def __getattr__(self, name: str):
        """What is no fact of the run is asked of its rows, as of a table."""
        if name == "rows" or name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.rows, name)


def generated(spark: SparkSession, specs: list[ColumnSpec], n: int, generator: Callable[[str], str], batch: int = BATCH, retries: int = RETRIES, path: str | None = None, most_calls: int | None = None, idle_rounds: int = 3, workers: int = pool.WORKERS) -> Generated:
    """``n`` valid rows from ``generator``, in rounds: what the rows so far lack is asked for in new batches.

    Each round's results are appended to ``path`` (a folder of the shared one if it is None) before
    the next is planned; what is planned are batch numbers that have no result there yet, so that a
    run that starts again with its path loses none and asks for none twice. It ends when there are
    enough rows, when ``most_calls`` calls were made, or after ``idle_rounds`` rounds that gave no
    valid row. Rows with errors are dropped, and counted.
    """
    if n < 0 or batch < 1:
        raise ValueError("n must not be below 0, and batch 1 or more")
    path = path or f"{tables.shared_folder(spark)}/graincart-{uuid.uuid4().hex}"
    schema = "batch bigint, place bigint, calls int, trouble string, " + ", ".join(f"`{s.name}` string" for s in specs)
    rounds, idle, stopped, before = 0, 0, None, None
    while True:
        try:
            told = spark.read.schema(schema).parquet(path)
        except AnalysisException:
            told = spark.createDataFrame([], schema)
        checked = validated(told, specs)
        valid = (F.size("errors") == 0) & F.col("place").isNotNull()
        made = told.groupBy("batch").agg(F.max("calls").alias("calls")).agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.max("batch"), F.lit(-1)).alias("last"), F.count("*").alias("batches")).first()
        seen = checked.agg(F.count_if(valid).alias("valid"), F.count_if(F.col("place").isNotNull()).alias("rows")).first()
        if seen["valid"] >= n:
            break
        idle = idle + 1 if before is not None and seen["valid"] <= before else 0
        if idle >= idle_rounds:
            stopped = f"{idle} rounds gave no row"
            break
        left = None if most_calls is None else most_calls - made["calls"]
        if left is not None and left <= 0:
            stopped = f"{made['calls']} calls were made"
            break
        # numbers without a result: those that an interrupted round left out, then new ones
        wanted = -(-(n - seen["valid"]) // batch)
        wanted = wanted if left is None else min(wanted, max(left // (retries + 1), 1))
        end = made["last"] + 1
        over = min(end - made["batches"], wanted)
        numbers = spark.range(end, end + wanted - over).select(F.col("id").alias("batch"))
        if over:
            left_out = spark.range(end).select(F.col("id").alias("batch")).join(told.select("batch").distinct(), "batch", "left_anti")
            numbers = numbers.union(left_out.orderBy("batch").limit(over).repartition(spark.sparkContext.defaultParallelism))
        sized = numbers.withColumn("size", F.lit(min(batch, n)).cast("int"))
        _asked(sized, specs, generator, retries, workers).write.mode("append").parquet(path)
        before, rounds = seen["valid"], rounds + 1
    # the first n by batch and place, numbered from 0
    kept = checked.where(valid).withColumn("_order", F.col("batch") * batch + F.col("place")).withColumn("_one", F.lit(1))
    placed = running_sums(kept.select("_order", "_one"), "_order", {"_upto": "_one"}).where(F.col("_upto") <= n)
    rows = kept.join(placed.select("_order", (F.col("_upto") - 1).alias("__row_id__")), "_order").select(*[s.name for s in specs], "__row_id__")
    return Generated(rows, n, min(seen["valid"], n), seen["rows"] - seen["valid"], made["calls"], rounds, stopped)


def fill_text(df: DataFrame, column: str, generator: Callable[[str], str], row_id: str = "__row_id__", retries: int = RETRIES, workers: int = pool.WORKERS) -> DataFrame:
    """``df`` with a text for each row, written in view of the row's other columns; null where the generator keeps failing or gives nothing.

    Rows are asked for in requests of TEXTS rows; a request whose reply has not as many texts as rows
    is asked again. Where a reply has no JSON at all, the request's rows are asked for one by one, and
    a reply is the text.
    """
    seen = F.to_json(F.struct(*[c for c in df.columns if c not in (row_id, column)]))

    def one(items: list[tuple]) -> list[str]:
        listed = "\n".join(f"{i + 1}. {row}" for i, (_, row) in enumerate(items))
        found = parse_reply(generator(f"Write a {column} for each of these {len(items)} rows as a JSON list of texts:\n{listed}"))
        if found is None:
            found = [generator(f"Write a {column} for this row, and nothing else:\n{row}") for _, row in items]
        if not isinstance(found, list) or len(found) != len(items):
            raise ValueError(f"not {len(items)} texts")
        return [None if t is None or not str(t).strip() else str(t) for t in found]

    def requests(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for frame in frames:
            for item in zip(frame[row_id], frame["_seen"], strict=True):
                held.append(item)
                if len(held) == TEXTS:
                    yield held
                    held = []
        if held:
            yield held

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for o in pool.outcomes(one, requests(frames), workers, retries):
            yield pd.DataFrame({row_id: [i for i, _ in o.item], column: o.value or [None] * len(o.item)})

    made = df.select(row_id, seen.alias("_seen")).mapInPandas(run, f"{row_id} bigint, `{column}` string")
    return df.drop(column).join(made, row_id)


def make_rows(spark: SparkSession, mode: str, n: int, sample: DataFrame | None = None, specs: list[ColumnSpec] = (), generator: Callable[[str], str] | None = None, texts: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """``n`` rows: ``statistical`` from a copula of ``sample``, ``generated`` by the generator, or ``hybrid``, a copula whose text columns the generator fills."""
    if mode == "generated":
        return generated(spark, list(specs), n, generator).rows
    if mode not in ("statistical", "hybrid"):
        raise ValueError(f"unknown mode: {mode}")
    columns = [c for c in sample.columns if c not in texts and not c.startswith("__")]
    out = synth.sample(spark, synth.fit(sample, columns), n, seed)
    for c in texts:
        out = fill_text(out, c, generator) if mode == "hybrid" else out.withColumn(c, F.lit(None).cast("string"))
    return out


def expected(n: int, batch: int = BATCH) -> dict[str, int]:
    return {"rows": n, "calls": -(-n // batch)}
