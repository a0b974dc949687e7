"""Streaming sources and row-local operators on arriving documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from caselight.functions.presence import long_enough
from caselight.operators.clean import clean_forms
from caselight.operators.extract import parse_reports
from caselight.operators.rules import check_reports
from caselight.schemas import MIN_TEXT_CHARS
from caselight.sources.documents import extension, intake_check


def table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, max_files: int = 1000) -> DataFrame:
    """Parquet files arriving in a folder, picked by name. Where the name is itself a folder, the table's files are those in it."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(place) and files.getFileStatus(place).isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def text_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Text files arriving in a folder, one row each."""
    raw = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder, wholetext=True)
    text = F.regexp_replace("value", "^\\ufeff", "")
    return raw.select(F.sha2(F.col("_metadata.file_path"), 256).alias("doc_id"), text.alias("text"))


_FILES = "path string, modificationTime timestamp, length long, content binary"


def landed_uploads(spark: SparkSession, folder: str, max_files: int = 1000, late: str = "1 day", by: list[str] | None = None) -> DataFrame:
    """Files as they land, one row each: ``name, extension, path, length, modified_at, content_hash, text``.

    An upload is a file in a folder that has its name. Contents that landed before are passed over, if their files' times lie no further
    apart than ``late``, also for the columns of ``by`` if any are named; the state holds a hash for each content of that time. A final line end and a leading byte-order mark are dropped.
    """
    raw = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(folder)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -2), "^name=", "")
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\\ufeff|\\n\\z", "")
    rows = raw.select(
        name.alias("name"), extension(name).alias("extension"), "path", "length", F.col("modificationTime").alias("modified_at"),
        F.sha2("content", 256).alias("content_hash"), text.alias("text"),
    )
    return rows.withWatermark("modified_at", late).dropDuplicatesWithinWatermark(["content_hash", *(by or [])])


def parsed_uploads(uploads: DataFrame) -> DataFrame:
    """Uploads with the intake's ``reason`` and ``accepted``, the extraction's ``status``, and the report fields of readable texts."""
    checked = intake_check(uploads, path="name").withColumn("status", F.when(long_enough(F.col("text"), MIN_TEXT_CHARS), "SUCCESS").otherwise("EXTRACTION_FAILED"))
    return parse_reports(checked.withColumnsRenamed({"status": "_status"})).withColumnRenamed("_status", "status")


def checked_uploads(uploads: DataFrame) -> DataFrame:
    """Accepted uploads, parsed, cleaned and checked, under their content's hash."""
    taken = intake_check(uploads, path="name").filter("accepted")
    return checked_reports(taken, key="content_hash")


def checked_reports(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Extract, clean and check reports; row-local, so batch and stream share it."""
    return check_reports(clean_forms(parse_reports(documents.select(key, text), text).drop(text), key))
