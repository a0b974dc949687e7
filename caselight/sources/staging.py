"""Written intermediate tables in the shared folder, which survive the loss of executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables and streaming state.

    It is the one ``spark.checkpoint.dir`` names, or else the context's checkpoint folder. A plain local session that has neither gets a temporary
    folder, a cluster a folder in the warehouse, which its executors write to as well. A ``file:`` path may be a shared mount; on a
    cluster it is tried once, and refused if the driver does not see what the executors write there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and re.fullmatch(r"local(\[.*\])?", context.master):
        # Spark lets no session change its own setting, so the folder is kept here.
        folder = _OWN.get(context.applicationId) or _OWN.setdefault(context.applicationId, tempfile.mkdtemp(prefix="caselight-"))
    folder = (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/caselight-work").rstrip("/")
    local = folder.startswith("file:") or (folder.startswith("/") and _default_scheme(spark) == "file")
    if local and not context.master.startswith("local") and folder not in _SHARED:
        if not _shared(spark, folder):
            raise ValueError(f"the driver does not see what executors write to {folder}; set spark.checkpoint.dir to a folder that all share")
        _SHARED.add(folder)
    return folder


_SHARED: set[str] = set()
#: Temporary folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def _shared(spark: SparkSession, folder: str) -> bool:
    """Whether rows that tasks write to a folder are all found there by the driver."""
    path, parts = f"{folder}/caselight-trial-{uuid.uuid4().hex}", max(2, spark.sparkContext.defaultParallelism)
    rows = spark.range(0, parts, 1, parts)
    rows.write.parquet(path)
    found = spark.read.schema(rows.schema).parquet(path).count() == parts
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return found


def _default_scheme(spark: SparkSession) -> str:
    return spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").split(":")[0]


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder name of its own in the shared folder; it is deleted when the session ends."""
    path = f"{work_dir(spark)}/caselight-{kind}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write a frame that several later steps read, and return the written table.

    The steps then share one evaluation, a lost executor costs no recomputation, and the planner
    sees the table's real size. The folder goes when the session ends, as the table is read for as long as frames over it are in use.
    """
    path = new_folder(df.sparkSession, "stage") + "/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables of one job, in one folder that goes with ``drop`` once nothing reads them any more, or else when the session ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.count = spark, new_folder(spark, "scratch"), 0

    def stage(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
