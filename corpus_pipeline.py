"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``; mixing repeats rows as its targets ask,
packing returns one row per piece of a document with its sequence and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillscan.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from quillscan.llm._store import documents, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Toxicity is a trained model and packing a randomised search: no SQL gives run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
