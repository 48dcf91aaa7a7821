"""Where results go: a Markdown file a document, audit lines that are appended, and reading both back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_name


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local temporary one only on a local master without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="foliospark_")
    return f"{base.rstrip('/')}/out_{uuid.uuid4().hex}"


def through_files(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what reads it more than once finds it done, and executors may be
    lost. The files go when the session ends."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(folder)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(folder)


def write_markdown(df: DataFrame, folder: str, name: str = "file_name", text: str = "markdown") -> None:
    """One text file a row, ended by a newline, in a folder named after it, so that a reader can skip to a document. Names must
    differ."""
    df.select(safe_name(F.col(name)).alias("file_name"), F.col(text).alias("value")).repartition("file_name").write.mode("overwrite").partitionBy("file_name").text(folder)


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, markdown) of what ``write_markdown`` wrote."""
    return spark.read.schema("value string, file_name string").text(folder, wholetext=True).select("file_name", F.regexp_replace("value", r"\n\z", "").alias("markdown"))


def append_audit(df: DataFrame, folder: str, case: str = "case_id", line: str = "line") -> None:
    """Audit lines under their case's safe name; earlier lines stay."""
    df.select(safe_name(F.col(case)).alias("case_file"), F.col(line).alias("value")).write.mode("append").partitionBy("case_file").text(folder)


def read_audit(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("value string, case_file string").text(folder).select("case_file", F.col("value").alias("line"))
