"""Prefix trie of conversations from mergeable partial tries.

A conversation is a sequence of turns, each known by two 64-bit hashes of its role and text; the node of its first
``d`` turns is known by the exclusive or of hashes of every (turn, position), which running windows give without
walking the trie. Partitions combine what they hold into partial node tables; ``merged`` sums the members of these
and joins their lists of ends in rounds, a hash of the node and a shrinking number of tries being the key of each.
What hangs below a node is then rolled up from the bottom in rounds of doubling reach, over shared nodes only: a node of
one member heads a chain, whose figures are known at once.

Nothing is gathered by conversation: turns are sorted in ranges that may split one, positions are counted within ranges
and shifted by the ranges before, and running windows go over ``STRIDE`` turns at most. Lists of ends are kept in pieces
of ``1 << ID_BITS`` neighbouring ids and hashed as a sorted stream.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillscan.llm._bytes import lean
from quillscan.llm._store import partitions, small_batches, written

#: Conversations that share an opening; most turns taken from the first of them; turns of a window; ids of a piece of ends.
FAMILY, OPENINGS, STRIDE, ID_BITS = 100, 6, 4096, 12
KEY = ["k1", "k2", "depth"]
_MASK = (1 << 33) - 1


def _crc_mod(number: Column, parts: int) -> Column:
    return F.crc32(number.cast("string").cast("binary")) % parts


def placed_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns in order, and the stretches they lie in.

    Turns: conv, part, at (ascending within part), a and b (hashes), size (code points of the text). Stretches, one row
    for each conversation in each range: conv, part, first (least ``at``), before (turns in earlier ranges), n, total.
    """
    role, text = F.coalesce(F.col("`role`"), F.lit("")), F.coalesce(F.col("`text`"), F.lit(""))
    rows = conversations.select(
        F.col("`conv_id`").cast("long").alias("conv"), F.col("`turn`").alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(text, role, F.lit(1)).alias("b"),
        F.length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"),
    ).where("conv is not null")
    order = ["conv", F.asc_nulls_first("turn"), "a", "b", "row"]
    turns = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    turns = written(turns.select("conv", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND(F.lit(_MASK)).alias("at"), "a", "b", "size"), "turns")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = turns.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    return turns, stretches.select("conv", "part", "first", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("conv")).alias("total"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the opening of their family's first one in place of their own.

    Gives (conv, length) of every conversation, and (conv, length, depth from 1, a, b, size) of every rebuilt turn.
    """
    turns, stretches = placed_turns(conversations)
    stretches = written(stretches, "stretches")
    firsts = stretches.where((F.col("conv") % FAMILY == 0) & (F.col("before") < OPENINGS)).join(turns, ["conv", "part"])
    place = F.col("at") - F.col("first") + F.col("before")
    heads = firsts.withColumn("i", place).where(F.col("i") < OPENINGS).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("i", "a", "b", "size"))).alias("head"))
    convs = stretches.where("before = 0").select("conv", "total", _crc_mod(F.col("conv"), OPENINGS).alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    convs = convs.join(heads.withColumnRenamed("conv", "base"), "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<i:bigint,a:bigint,b:bigint,size:bigint>>")), F.lit(1), F.col("h").cast("int")))
    convs = convs.withColumn("k", F.size("head").cast("long")).withColumn("length", F.col("k") + F.greatest(F.col("total") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv", "h", "k", "length", "head"), "rebuilt")
    opening = convs.select("conv", "length", F.posexplode("head").alias("p", "t")).select("conv", "length", (F.col("p") + 1).cast("long").alias("depth"), "t.a", "t.b", "t.size")
    own = turns.join(stretches.select("conv", "part", "first", "before").join(convs.select("conv", "h", "k", "length"), "conv"), ["conv", "part"])
    own = own.where(place >= F.col("h")).select("conv", "length", (F.col("k") + place - F.col("h") + 1).alias("depth"), "a", "b", "size")
    return convs.select("conv", "length"), opening.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """Each rebuilt turn with the keys of its node (k1, k2) and of the node above (p1, p2); the root's are 0."""
    turns = turns.withColumn("chunk", F.floor(F.col("depth") / STRIDE)).withColumn("v1", F.xxhash64("a", "b", "depth")).withColumn("v2", F.xxhash64("b", "a", "depth", F.lit(2)))
    turns = written(turns.drop("a", "b"), "rebuilt-turns")
    running = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.select("*", F.bit_xor("v1").over(running).alias("k1"), F.bit_xor("v2").over(running).alias("k2"))
    # only conversations of more than STRIDE turns have chunks before one
    long_ = turns.where(F.col("length") >= STRIDE).groupBy("conv", "chunk").agg(F.bit_xor("v1").alias("k1"), F.bit_xor("v2").alias("k2"))
    past = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    long_ = long_.select("conv", "chunk", F.bit_xor("k1").over(past).alias("o1"), F.bit_xor("k2").over(past).alias("o2")).where("chunk > 0")
    rows = rows.join(long_, ["conv", "chunk"], "left")
    for k, o in (("k1", "o1"), ("k2", "o2")):
        rows = rows.withColumn(k, F.col(k).bitwiseXOR(F.coalesce(F.col(o), F.lit(0).cast("long"))))
    return rows.select("conv", "length", "depth", "size", "k1", "k2", F.col("k1").bitwiseXOR(F.col("v1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("v2")).alias("p2"))


def merged(tables: DataFrame, extra: list[str], *aggregates: Column) -> DataFrame:
    """Partial tables (with a column ``trie``) summed into one, in two rounds of a fan-in of about the root of their number."""
    fan = max(2, int(partitions(tables.sparkSession) ** 0.5))
    for trie in (F.col("trie") % fan, F.lit(0)):
        tables = tables.groupBy(*KEY, *extra, trie.alias("trie")).agg(*aggregates)
    return tables.drop("trie")


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ids; pieces of them stream by in order, so no list is ever whole."""

    def run(batches):
        node, state = None, None
        for batch in batches:
            rows = []
            for *key, text in zip(*(batch.column(c).to_pylist() for c in (*KEY, "text"))):
                if key != node:
                    if node is not None:
                        rows.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in list(zip(*rows))[:3]), pa.array([r[3] for r in rows])], names=[*KEY, "sha"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in node), pa.array([state.hexdigest()])], names=[*KEY, "sha"])

    text = F.array_join(F.transform(F.array_sort("ids"), lambda i: i.cast("string")), ",")
    return ends.select(*KEY, "piece", text.alias("text")).repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "text").mapInArrow(lean(run), "k1 long, k2 long, depth long, sha string")


def rolled_up(shared: DataFrame) -> DataFrame:
    """Sums of ``leaves`` and ``saved`` over the subtrees of shared nodes.

    After round r every node holds the sum over what lies less than 2**r below it, and gives it to its ancestor
    2**r above: as many rounds as the depth has binary digits.
    """
    deepest, reach = shared.agg(F.max("depth")).first()[0] or 0, 1
    while reach <= deepest:
        given = shared.where(F.col("depth") >= reach).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - reach).alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = shared.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + reach).alias("depth"), F.col("p1").alias("a1"), F.col("p2").alias("a2"))
        rows = shared.join(given, KEY, "left").join(above, ["p1", "p2", "depth"], "left")
        shared = written(rows.select(*KEY, F.col("a1").alias("p1"), F.col("a2").alias("p2"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), f"rolled-{reach}")
        reach *= 2
    return shared.select(*KEY, "leaves", "saved")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without conv_id belong to no conversation; null role and text are empty; turns are ordered by turn, null first,
    rows of one turn by hashes of role and text, and repeated rows are turns of their own; ids must be whole
    numbers; an empty table has no nodes; other columns are ignored.
    """
    convs, turns = rebuilt(conversations)
    rows = written(prefixes(turns), "prefixes")
    part = F.spark_partition_id()
    zero = F.lit(0).cast("long")
    roots = convs.select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), F.col("conv"), zero.alias("size"), F.lit(1).cast("long").alias("n"), part.alias("trie"))
    partial = rows.select(*KEY, "p1", "p2", "conv", "size", F.lit(1).cast("long").alias("n"), part.alias("trie")).unionByName(roots)
    nodes = written(merged(partial, ["p1", "p2", "size"], F.sum("n").alias("n"), F.min("conv").alias("conv")), "nodes")

    ended = rows.where("depth = length").select(*KEY, "conv").unionByName(convs.where("length = 0").select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), "conv"))
    ended = ended.select(*KEY, F.shiftright("conv", ID_BITS).alias("piece"), F.array("conv").alias("ids"), part.alias("trie"))
    digests = _digests(merged(ended, ["piece"], F.flatten(F.collect_list("ids")).alias("ids")))

    up = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth"))
    children = up.agg(F.count(F.lit(1)).alias("n_children"), F.sum((F.col("n") == 1).cast("long")).alias("chains"))
    nodes = written(nodes.join(children, KEY, "left").na.fill(0, ["n_children", "chains"]), "parents")
    shared = nodes.where("n > 1").select(*KEY, "p1", "p2", (F.col("chains") + (F.col("n_children") == 0).cast("long")).alias("leaves"), ((F.col("n") - 1) * F.col("size")).alias("saved"))
    sums = rolled_up(shared)
    parents = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent_conv_id"))
    out = nodes.join(sums, KEY, "left").join(digests, KEY, "left").join(parents, ["p1", "p2", "depth"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("n_children"),
        F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``."""
    small_batches(spark)
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# crc32 of the id's digits, a byte at a time and eight shifts for each.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"
ORACLE = f"""
WITH own AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
), opened AS (
  SELECT *, {_CRC} % 6 AS h FROM own
), m AS (
  SELECT o.c, list_concat(coalesce(b.s[1:o.h], []), o.s[o.h + 1:]) AS s FROM opened o LEFT JOIN own b ON b.c = o.c - o.c % 100
), prefixes AS (
  SELECT c, d, s[1:d] AS p, len(s) = d AS ends FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM m)
), nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS ends, CASE WHEN d = 0 THEN 0 ELSE length(p[d].t) END AS size FROM prefixes GROUP BY 1, 2
), children AS (
  SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), n AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (p)
), below AS (
  SELECT p[1:a] AS p, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM n) GROUP BY 1
)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN below USING (p) LEFT JOIN n AS up ON n.d > 0 AND up.p = n.p[1:n.d - 1]
"""
