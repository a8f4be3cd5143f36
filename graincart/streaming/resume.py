"""Labelling that resumes where it stopped: a stream over the files of a version.

The stream's checkpoint remembers which files have been answered. Files that come later, or that
were left when a run stopped, are answered by the next run, and none twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from graincart.operators.labeling import ROW_ID, label_rows


def label_available(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, ask: Callable[[str], dict], columns: list[str], answers: str, files_at_once: int = 20, row_id: str = ROW_ID
) -> None:
    """Answer all rows of the Parquet folder ``source`` that are not answered yet, into the Parquet folder ``target``.

    Each step takes ``files_at_once`` files and commits them, so that a run that is stopped loses
    one step at most.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    out = label_rows(rows, ask, columns, answers, row_id)
    run = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
