"""Immutable table versions in a folder that all machines share, with parents, numbers and provenance.

A version is a Parquet folder that is written once. The list of versions is a small Parquet
table: one file for each version, added and never changed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincart.operators.labeling import breakdown
from graincart.operators.profile import kinds
from graincart.sources.readers import PROVENANCE, ROW_ID

_SCHEMA = "version_id string, project string, number long, parent_id string, origin string, row_count long, columns string, provenance string, seed long, meta string, created timestamp"


@dataclass(frozen=True)
class Store:
    """Versions under ``root``, any path that Spark reads and writes."""

    spark: SparkSession
    root: str

    def versions(self, project: str | None = None) -> DataFrame:
        """All versions by project and number."""
        try:
            found = self.spark.read.schema(_SCHEMA).option("recursiveFileLookup", True).parquet(f"{self.root}/versions")
        except AnalysisException:
            found = self.spark.createDataFrame([], _SCHEMA)
        found = found.join(self._deleted(), "version_id", "left_anti").select(*found.columns)
        return (found.where(F.col("project") == project) if project else found).orderBy("project", "number")

    def _deleted(self) -> DataFrame:
        try:
            return self.spark.read.schema("version_id string").parquet(f"{self.root}/deleted")
        except AnalysisException:
            return self.spark.createDataFrame([], "version_id string")

    def delete(self, project: str) -> int:
        """Delete a project's versions and their rows; how many there were.

        The entries are marked before any row goes, so that an interrupted deletion leaves no
        version without its rows.
        """
        gone = [r["version_id"] for r in self.versions(project).select("version_id").collect()]
        if gone:
            self.spark.createDataFrame([(v,) for v in gone], "version_id string").write.mode("append").parquet(f"{self.root}/deleted")
        for version_id in gone:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data/{version_id}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return len(gone)

    def entry(self, version_id: str) -> dict:
        """The entry of a version; ValueError if there is none."""
        found = self.versions().where(F.col("version_id") == version_id).limit(1).collect()
        if not found:
            raise ValueError(f"no version {version_id}")
        return found[0].asDict()

    def _claim(self, project: str) -> int:
        """The next number of a project, claimed by a file that only one writer can make; a number is never given twice.

        A file system must not make a file that is there already (HDFS does not, nor do local ones);
        an object store whose writes overwrite cannot tell two writers apart.
        """
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = f"{self.root}/numbers/{quote(project, safe='')}"
        where = jvm.org.apache.hadoop.fs.Path(folder)
        fs = where.getFileSystem(conf)
        fs.mkdirs(where)
        taken = [int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit()]
        number = max([*taken, self.versions(project).agg(F.max("number")).first()[0] or 0]) + 1
        while not _made(jvm, fs, where, number):
            number += 1
        return number

    def create(self, project: str, df: DataFrame, parent_id: str | None = None, origin: str = "uploaded", seed: int | None = None, meta: dict | None = None, own_rows: bool = False) -> str:
        """Write ``df`` as the next version of ``project`` and return its id.

        Rows without provenance get the origin of the version; with a parent, provenance is that
        of the parent's row of the same id, overlaid by that of ``df``, unless ``own_rows`` says that
        the ids are not those of the parent's rows.
        """
        if parent_id is not None and not self.versions(project).where(F.col("version_id") == parent_id).limit(1).count():
            raise ValueError(f"{project} has no version {parent_id}")
        version_id = uuid.uuid4().hex
        own = F.col(PROVENANCE) if PROVENANCE in df.columns else F.lit(None).cast("string")
        rows = df.withColumn(PROVENANCE, own)
        if parent_id is not None and ROW_ID in df.columns and not own_rows:
            before = self.load(parent_id, provenance=True)
            if ROW_ID in before.columns:
                rows = rows.join(before.select(ROW_ID, F.col(PROVENANCE).alias("_before")), ROW_ID, "left")
                rows = rows.withColumn(PROVENANCE, merged_provenance(F.col("_before"), F.col(PROVENANCE))).drop("_before")
        rows = rows.withColumn(PROVENANCE, F.coalesce(PROVENANCE, F.to_json(F.struct(F.lit(origin).alias("row_origin")))))
        path = f"{self.root}/data/{version_id}"
        rows.write.mode("errorifexists").parquet(path)
        stored = self.spark.read.parquet(path)
        columns = [c for c in stored.columns if c not in (PROVENANCE, ROW_ID)]
        told = {r["column"]: r["kind"] for r in kinds(stored, columns).collect()} if columns else {}
        buckets = {r["bucket"]: r["n"] for r in breakdown(stored).collect()}
        number = self._claim(project)
        row = (version_id, project, number, parent_id, origin, sum(buckets.values()), json.dumps(told), json.dumps(buckets), seed, json.dumps(meta or {}))
        entry = self.spark.createDataFrame([row], _SCHEMA.rsplit(",", 1)[0]).withColumn("created", F.current_timestamp())
        # a folder of its own: two jobs that append to one folder clear away each other's files
        entry.write.mode("errorifexists").parquet(f"{self.root}/versions/{version_id}")
        return version_id

    def load(self, version_id: str, provenance: bool = False) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/data/{version_id}")
        return df if provenance else df.drop(PROVENANCE)

    def lineage(self, version_id: str) -> list[str]:
        """The version and its ancestors, nearest first."""
        parents = {r["version_id"]: r["parent_id"] for r in self.versions().select("version_id", "parent_id").collect()}
        if version_id not in parents:
            raise ValueError(f"no version {version_id}")
        chain = [version_id]
        while parents.get(chain[-1]):
            chain.append(parents[chain[-1]])
        return chain


def _made(jvm, fs, folder, number: int) -> bool:
    """Whether the file ``number`` was made just now, and not there before."""
    if fs.getScheme() == "file":
        return jvm.java.io.File(f"{folder.toUri().getPath()}/{number}").createNewFile()
    try:
        fs.create(jvm.org.apache.hadoop.fs.Path(folder, str(number)), False).close()
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            return False
        raise


def merged_provenance(old, new):
    """The origins of ``new`` over those of ``old``; the row's origin stays that of ``old``."""
    from graincart.operators.labeling import origins

    empty = F.create_map().cast("map<string, struct<origin: string, confidence: double, note: string>>")
    a, b = origins(old), origins(new)
    fresh = F.coalesce(b["label_origins"], empty)
    kept = F.map_filter(F.coalesce(a["label_origins"], empty), lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    both = F.to_json(F.struct(F.coalesce(a["row_origin"], b["row_origin"]).alias("row_origin"), F.map_concat(kept, fresh).alias("label_origins")))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(both)
