"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source has a weight and may be read at most ``max_epochs`` times. The common level is found
in closed form: with sources sorted by cap / weight, those below the level are clamped and the rest
share what remains in proportion to their weights. A source's target is then a whole number of
passes plus a fraction of one; the fraction is the prefix of a seeded hash order whose sizes fit,
plus the one remaining document nearest in size to what is left. Both decisions are thresholds on
the hash, so they are applied to the documents by a join with one row per source and no text moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillscan.llm._store import documents, written

WEIGHTS = (5, 2, 1)
SHARE, MAX_EPOCHS, SEED = 1.5, 2, "mix-1"
BUCKET_BITS = 12


def words(text: Column) -> Column:
    """Number of maximal runs of characters other than space and U+0009 to U+000D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def order_hash(id_col: Column, seed: str = SEED) -> Column:
    """60 bits of md5 over seed and id: the order in which fractions of a source are taken."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with ``target``. One row per source; windows run over those rows only."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("clamped", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("place", F.row_number().over(by_cap))
        .withColumn("level", (F.col("budget") - F.col("clamped")) / F.col("open"))
    )
    free = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct("place", "level"))
    rows = rows.withColumn("at", F.min(free).over(everything)["level"])
    return rows.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("at")), F.col("cap")).alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """Two tables: per document (doc_id, source, h, size), per source (source, source_size, target, passes, cut, pick).

    A document is read ``passes`` times, and once more if its hash ``h`` is at most ``cut`` or equals ``pick``.
    Null text has size 0; a null source is a source of its own, last in order; rows that repeat an id share
    its hash and are taken together; an empty table gives empty tables.
    """
    sized = written(
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), order_hash(F.col(f"`{id_col}`"), seed).alias("h"), words(F.col(f"`{text_col}`")).alias("size")),
        "mix-sizes",
    )
    bucket = F.shiftright("h", 60 - BUCKET_BITS)
    cells = written(sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size")), "mix-cells")
    sources = targets(cells.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    sources = sources.withColumn("passes", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)) + F.lit(1e-12)), F.lit(0)).cast("long"))
    sources = written(sources.withColumn("quota", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0))), "mix-sources")
    quota = sources.select(F.col("source").alias("s"), "quota")

    def joined(rows: DataFrame, side: DataFrame) -> DataFrame:
        return rows.join(side, rows["source"].eqNullSafe(side["s"])).drop("s")

    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        joined(cells.withColumn("upto", F.sum("size").over(running)), quota)
        .where("upto > quota and quota > 0")
        .groupBy("source")
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"), "quota")).alias("e"))
        .select(F.col("source").alias("s"), "e.*")
    )
    inside = joined(sized, edge).where(bucket == F.col("bucket")).groupBy("source", "h", "before", "quota").agg(F.sum("size").alias("size"))
    running = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        inside.withColumn("upto", F.col("before") + F.sum("size").over(running))
        .groupBy("source")
        .agg(
            F.min(F.when(F.col("upto") > F.col("quota"), F.struct(F.col("h"), (F.col("quota") - (F.col("upto") - F.col("size"))).alias("left")))).alias("x"),
        )
        .select(F.col("source").alias("s"), (F.col("x.h") - 1).alias("cut"), F.col("x.left").alias("left"))
    )
    cuts = written(cuts, "mix-cuts")
    gap = F.abs(F.col("size") - F.col("left"))
    picks = (
        joined(sized, cuts).where(F.col("h") > F.col("cut")).groupBy("source", "h", "left").agg(F.sum("size").alias("size")).where(gap < F.col("left"))
        .groupBy("source").agg(F.min(F.struct(gap.alias("gap"), F.col("h")))["h"].alias("pick")).select(F.col("source").alias("s"), "pick")
    )
    plan = sources.join(cuts.select(F.col("s").alias("s1"), "cut"), F.col("source").eqNullSafe(F.col("s1")), "left").join(picks.select(F.col("s").alias("s2"), "pick"), F.col("source").eqNullSafe(F.col("s2")), "left")
    return sized, written(plan.select("source", "source_size", "target", "passes", "cut", "pick"), "mix-plan")


def times() -> Column:
    """How often a document joined with its source's row is read."""
    more = (F.coalesce(F.col("h") <= F.col("cut"), F.lit(False)) | F.coalesce(F.col("h") == F.col("pick"), F.lit(False))).cast("long")
    return F.col("passes") + more


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, plan = mix_plan(documents(spark, sf_dir).select("doc_id", "text", "source"))
    plan = plan.withColumnRenamed("source", "s")
    return sized.join(plan, sized["source"].eqNullSafe(plan["s"])).select("doc_id", "size", "source_size", "target", (times() * F.col("size")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: every document as often as the mix reads it; the columns are those of ``docs``.

    Null text has size 0; a null source is a source of its own; sources of size 0 are left out, as are documents that
    the fraction of a pass misses; rows that repeat an id are taken together; an empty table gives no rows.
    """
    _, plan = mix_plan(docs)
    plan = plan.select(F.col("source").alias("s"), "passes", "cut", "pick")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), order_hash(F.col("doc_id")).alias("h"))
    rows = rows.join(plan, rows["doc.source"].eqNullSafe(plan["s"])).select("doc", times().alias("n")).where("n > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, list_extract([5.0, 2.0, 1.0]::DOUBLE[], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS weight,
         source_size * 2.0::DOUBLE AS cap FROM per
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM weighed
), target AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT min_by(level, place) FROM levels WHERE cap / weight > level)), cap) AS target
  FROM levels
), quota AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0) + 1e-12), 0)::BIGINT AS passes,
         greatest(target - coalesce(floor(target / nullif(source_size, 0) + 1e-12), 0) * source_size, 0) AS quota FROM target
), hs AS (SELECT source, h, sum(size) AS size FROM sized GROUP BY source, h
), run AS (
  SELECT hs.*, q.quota, sum(hs.size) OVER (PARTITION BY hs.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM hs JOIN quota q ON hs.source IS NOT DISTINCT FROM q.source
), cut AS (
  SELECT source, min(h) - 1 AS cut, min_by(quota - (upto - size), h) AS "left" FROM run WHERE upto > quota GROUP BY source
), pick AS (
  SELECT hs.source, arg_min(h, {'gap': abs(size - "left"), 'h': h}) AS pick FROM hs JOIN cut c ON hs.source IS NOT DISTINCT FROM c.source
  WHERE h > cut AND abs(size - "left") < "left" GROUP BY hs.source
)
SELECT d.doc_id, d.size, q.source_size, q.target,
       ((q.passes + CASE WHEN d.h <= c.cut OR d.h = p.pick THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM sized d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source
LEFT JOIN cut c ON d.source IS NOT DISTINCT FROM c.source LEFT JOIN pick p ON d.source IS NOT DISTINCT FROM p.source
"""
