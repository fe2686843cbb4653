"""Tables that outlive a lost executor: written through Spark into the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Most bytes of a batch that goes to a Python worker, unless the session names its own.
BATCH, _BATCH = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of 10,000 rows of text take some 100 MB on either side of the pipe; a few MB do as well."""
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, BATCH)


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one where none is set, in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillscan-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a reader of it.

    Everything downstream starts from those files, so work above is never repeated and
    results of non-deterministic batching stay fixed. The folder's owner removes them.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/quillscan/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_part(column: str, parts: int) -> Column:
    """crc32 of an id written as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
