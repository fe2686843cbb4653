"""Members of containers as rows: a table function for LATERAL joins, which reads only what is asked for."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quillscan.sources import epub


class ArchiveMembers:
    """``archive_members(content, pattern, with_content)``: path, size, packed, error and, if asked for, content.

    ``pattern`` is a shell pattern for whole paths, null for all. Members that it does not match are not read, and
    none is where no content is asked for. A container that breaks a rule, or a member that cannot be read, ends in
    a row of its error alone; null content has no rows.
    """

    @staticmethod
    def analyze(content: AnalyzeArgument, pattern: AnalyzeArgument, with_content: AnalyzeArgument) -> AnalyzeResult:
        if not pattern.isConstantExpression or not with_content.isConstantExpression:
            raise ValueError("pattern and with_content must be constants")
        schema = StructType().add("path", StringType()).add("size", LongType()).add("packed", LongType()).add("error", StringType())
        return AnalyzeResult(schema.add("content", BinaryType()) if with_content.value else schema)

    def eval(self, content, pattern, with_content):
        if content is None:
            return
        wanted = (lambda path: fnmatchcase(path, pattern)) if pattern is not None else (lambda path: True)
        try:
            for path, size, packed, data in epub.listed(bytes(content), wanted, bool(with_content)):
                yield (path, size, packed, None, data) if with_content else (path, size, packed, None)
        except ValueError as error:
            yield (None, None, None, str(error), None) if with_content else (None, None, None, str(error))


def register(spark: SparkSession):
    """Make ``archive_members`` known to SQL; the function for DataFrames is returned."""
    return spark.udtf.register("archive_members", F.udtf(ArchiveMembers))


def members(files: DataFrame, pattern: str | None = None, contents: bool = False) -> DataFrame:
    """(book_id, path, size, packed, error[, content]) of the containers in (book_id, content) rows."""
    told = register(files.sparkSession)
    rows = files.select("book_id", F.col("content").alias("container"))
    return rows.lateralJoin(told(F.col("container").outer(), F.lit(pattern).cast("string"), F.lit(contents))).drop("container")
