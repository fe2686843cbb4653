"""Intermediate tables in the folder that all executors share, so that long plans are cut and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode a temporary one where none is named."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillscan-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back. The folder's owner removes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillscan/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
