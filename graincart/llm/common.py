"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Bytes that a broadcast table may have; larger tables are joined by a shuffle.
BROADCAST_BYTES = 24_000_000
#: A key is hot if it has more than this share of all rows, and more than so many rows.
HOT_SHARE, HOT_ROWS = 1 / 2000, 1000
#: Rows and bytes of a batch that goes to a Python task.
BATCH_ROWS, BATCH_BYTES = 2000, "16m"
_own_dirs: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may go without the
    setting; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="graincart-")
    return _own_dirs[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: it cuts the lineage, and a lost
    executor costs no recomputation of what is before. ``discard`` deletes it again."""
    path = f"{shared_dir(df.sparkSession)}/graincart-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def view_of(out: DataFrame, table_: DataFrame) -> DataFrame:
    """``out``, a selection from the materialized ``table_``, as the one to discard."""
    if table_ in _paths:
        _paths[out] = _paths.pop(table_)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables once all that was read from them is written."""
    for table_ in tables:
        path = _paths.pop(table_, None)
        if path:
            spark = table_.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, StringType | BinaryType):
        size = F.octet_length(value)
    elif isinstance(kind, ArrayType):
        inner = kind.elementType
        fixed = not isinstance(inner, StringType | BinaryType | ArrayType | MapType | StructType)
        size = F.size(value) * 8 if fixed else F.aggregate(value, F.lit(0).cast("long"), lambda total, x: total + _bytes(x, inner))
    elif isinstance(kind, StructType):
        size = sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(0))
    else:
        return F.lit(8).cast("long")
    return F.coalesce(size.cast("long"), F.lit(0)) + 16


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if the bytes of its values are at most ``most``; else unchanged, so
    that the join shuffles. ``df`` should be cheap to read (a materialized table)."""
    each = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    size = df.agg(F.sum(each)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def hot_rows(total: int) -> float:
    """The number of rows beyond which a key is hot, of ``total`` rows; there are at most 1 / HOT_SHARE such keys."""
    return max(total * HOT_SHARE, HOT_ROWS)


def join_spread(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """Join by ``key`` without all rows of a hot key in one task.

    ``counts`` (``key``, rows) tells how many of the ``total`` rows of ``left`` each key has. Hot
    keys, at most 1 / HOT_SHARE of them, are split into parts of hot_rows(total) rows, and their
    rows in ``right`` are repeated for each part.
    """
    most = hot_rows(total)
    hot = F.broadcast(counts.where(F.col("rows") > most).select(key, F.ceil(F.col("rows") / most).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), parts).cast("int").alias("_part")
    left = left.join(hot, key, "left").select(*[F.col(f"`{c}`") for c in left.columns], spread)
    right = right.join(hot, key, "left").select(*[F.col(f"`{c}`") for c in right.columns], F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    # a sorted merge at every size: a table that grows with the data must not be broadcast while it is small
    return left.join(right.hint("merge"), [key, "_part"], how).drop("_part")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(text, UPPER, LOWER)


def text_key(doc_id: Column, text: Column) -> Column:
    """A digest that equal texts share; null and empty texts, which may be very many, each have their own, that no text has."""
    return F.when(F.length(text) > 0, F.md5(text)).otherwise(F.concat(F.lit("-"), F.coalesce(doc_id.cast("string"), F.uuid())))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no classifier learns from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of this session's Python tasks, unless somebody has set them lower."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def in_pandas(df: DataFrame, run: Callable, key: str, schema: str) -> DataFrame:
    """``df`` through ``run`` by mapInPandas; whole numbers in ``key`` pass as text, as pandas would turn those beside a null into floats."""
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType
    out = df.withColumn(key, F.col(key).cast("string")).mapInPandas(run, f"`{key}` string, {schema}")
    return out.withColumn(key, F.col(key).cast(kind))


_ARROW = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def beside(df: DataFrame, reads: tuple[str, ...], carry: tuple[str, ...], work: Callable, new: dict[str, str]) -> DataFrame:
    """The columns of ``carry`` and new ones (name: type), which ``work`` makes from the lists of values of ``reads``, row for row.

    Carried columns are handed on as Arrow has them, so that no value of theirs can change.
    """
    small_batches(df.sparkSession)
    kept = df.select(*dict.fromkeys((*carry, *reads)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = dict(zip(batch.schema.names, batch.columns, strict=True))
            made = work(*[held[c].to_pylist() for c in reads])
            made = [pa.array(values, _ARROW[kind]) for values, kind in zip(made, new.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[held[c] for c in carry], *made], names=[*carry, *new])

    fields = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in carry] + [f"{c} {kind}" for c, kind in new.items()]
    return kept.mapInArrow(run, ", ".join(fields))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_rest(docs: DataFrame, work: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """``work`` on doc_id, text and the other columns under names that clash with nothing."""
    rest = {c: f"_rest{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = work(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(x) for c, x in rest.items()]), tuple(rest.values()))
    return out.select(*[F.col(rest[c]).alias(c) if c in rest else F.col(c) for c in docs.columns])
