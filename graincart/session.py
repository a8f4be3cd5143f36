"""Session factory with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", app: str = "graincart", partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``__`` for dots."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()
