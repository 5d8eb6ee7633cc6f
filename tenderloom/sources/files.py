"""Readers and writers: document files, result tables, report documents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder for one run in the shared folder the cluster names.

    Without one a local folder serves in local mode only; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return f"{folder}/tenderloom-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tenderloom-")


def kept(rows: DataFrame, name: str = "rows") -> DataFrame:
    """Rows written to the shared folder and read from there, for plans that use them several times."""
    path = f"{shared_folder(rows.sparkSession)}/{name}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Document files as (filename, content, uploaded_at) rows."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("path", name.alias("filename"), "content", F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("uploaded_at"))


def write_table(rows: DataFrame, path: str, buckets: int = 64, key: str = "tender_id", mode: str = "append") -> None:
    """Write a table partitioned by a hash bucket of its tender, so no folder per tender arises."""
    rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).write.mode(mode).partitionBy("bucket").parquet(path)


def store_precedents(precedents: DataFrame, path: str) -> None:
    """Append precedents, one folder per category."""
    precedents.write.mode("append").partitionBy("tender_category").parquet(path)


def write_reports(header: DataFrame, path: str) -> None:
    """Report documents as JSON lines, one document per tender."""
    header.withColumn("report_id", F.sha2(F.concat_ws("|", F.lit("report"), F.col("tender_id").cast("string")), 256)).write.mode("overwrite").json(path)


def load_reports(spark: SparkSession, path: str, schema: str, report_ids: list[str] | None = None) -> DataFrame:
    """Stored report documents, all of them or those of the given ids."""
    rows = spark.read.schema(schema).json(path)
    return rows if report_ids is None else rows.where(F.col("report_id").isin(*report_ids))


def log_responses(rows: DataFrame, path: str) -> None:
    """Append response-log rows."""
    rows.write.mode("append").parquet(path)
