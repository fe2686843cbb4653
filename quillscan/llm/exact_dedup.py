"""Exact deduplication by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised texts, an external sort within each partition
puts equal texts next to each other, and the window's group boundary is a full comparison of
neighbouring texts. Splitters are sampled from a bounded key (first 64 characters, length, salt),
so what the driver sees of the sample has a fixed width per row whatever the texts' lengths.

Hot groups: a salt from doc_id is part of the sort key, so a group of copies becomes at most
``SALTS`` runs in as many places; runs (one row each) are then merged by the text's SHA-256, so that
between runs texts are told apart by that digest, not by a comparison of all bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillscan.llm._store import documents, written

SALTS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null as empty, A-Z lower-cased, all else kept."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (and ``doc``, the whole row, if ``carry``).

    Of equal normalised texts the largest id stays. Null text counts as empty; rows that repeat both
    id and text leave exactly one kept; a null id is smaller than any other; an empty table gives an
    empty result; other columns, whatever their names, are only seen inside ``doc``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.lit(True)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        *([] if carry else [text.alias("text")]),
        normalised(F.substring(text, 1, 64)).alias("head"),
        F.length(text).alias("len"),
        F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(SALTS)).alias("salt"),
        row.alias("doc"),
    ).repartitionByRange("head", "len", "salt")
    norm = normalised(F.col(f"doc.`{text_col}`") if carry else F.col("text"))
    run = Window.partitionBy("head", "len", "salt", "norm").orderBy(F.col("id").desc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = (
        rows.withColumn("norm", norm)
        .withColumn("place", F.row_number().over(run))
        .withColumn("run_size", F.count(F.lit(1)).over(whole))
        .withColumn("run_max", F.max("id").over(whole))
        .select("id", "doc", "salt", "place", "run_size", "run_max", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    )
    marked = written(marked if carry else marked.drop("doc"), "exact-runs")
    runs = marked.where("place = 1").select("sha", "salt", "run_size", "run_max")
    groups = runs.groupBy("sha").agg(
        F.sum("run_size").alias("group_size"),
        F.max("run_max").alias("keep_id"),
        F.max(F.struct(F.col("run_max").isNotNull(), "run_max", "salt"))["salt"].alias("keep_salt"),
    )
    where = runs.select("sha", "salt").join(groups, "sha")
    return marked.join(where, ["sha", "salt"]).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        ((F.col("place") == 1) & (F.col("salt") == F.col("keep_salt"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(["doc"] if carry else []),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir).select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of every group of equal texts, that of the largest id; the columns are those of ``docs``.

    Null text is empty; of rows that repeat both id and text one stays; a null id stays only where a group has no other;
    an empty table gives no rows; other columns are carried along whatever their names.
    """
    return exact_groups(docs, carry=True).where("kept").select("doc.*")


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
