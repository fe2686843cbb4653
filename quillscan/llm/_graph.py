"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.llm._store import written


EDGES_A_TASK = 250_000


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of any orderable type -> (node, label): label is the least node of its component.

    Steps run in as many tasks as the edges at hand are worth (``EDGES_A_TASK``), since late ones have few of them.
    Every step is a grouped minimum and a join on the node, written to the shared folder; a hub's many edges are
    split by the join. Self-loops are ignored, nodes without edges are absent, an empty table gives none.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).union(edges.select("v", "v").distinct())
        before = state
        tasks = 8 + state[0] // EDGES_A_TASK
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy(F.col("u").alias("x")).agg(F.least(F.min("v"), F.min("u")).alias("m")).coalesce(tasks)
        larger = both.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(tasks)
        least = larger.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).coalesce(tasks)
        smaller = larger.join(least, F.col("u") == F.col("x"))
        smaller = smaller.select("u", F.col("m").alias("v")).union(smaller.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = written(smaller.where("u <> v").distinct().coalesce(tasks), "edges")
