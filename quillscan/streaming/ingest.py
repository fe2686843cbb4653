"""Books as they arrive: a stream of files, analysed batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.plans.analyze import Analysis, analyze
from quillscan.sources.files import MARKUP, TEXT, from_files, name_of, suffix_of

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Text and markup files of a folder as a stream of single-file books."""
    rows = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(folder)
    books = rows.select(F.col("path").alias("book_id"), F.col("path").alias("source_path"), name_of(F.col("path")).alias("file"), "length", "content")
    return books.where(suffix_of(F.col("file")).isin(*MARKUP, *TEXT))


def analyze_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, rules=None, language: str = "auto", sink: Callable[[Analysis, int], None] | None = None, files_a_batch: int = 1000):
    """Start a query that analyses every new file once; findings and summaries are written under ``out`` by batch.

    A book is complete in its file, so nothing is kept between batches; a batch that is run again replaces its folder.
    """

    def batch(files: DataFrame, number: int) -> None:
        tables = from_files(files, title_from_metadata=True).persisted()
        done = analyze(tables, rules, language)
        try:
            if sink:
                sink(done, number)
            else:
                for name, df in (("findings", done.findings), ("summary", done.summary)):
                    df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            done.release()

    return arriving(spark, folder, files_a_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
