"""Similar wording without a budget: a set-similarity join by prefixes.

The words of every text are put in one order, rare ones first. Two sets whose Dice coefficient reaches
``threshold`` share at least ``overlap`` words, so each has one of the shared words among its first
``size - overlap + 1``, and the k-th shared word among its first ``size - overlap + k``. Texts therefore meet on the words
of these prefixes; sizes that cannot reach the threshold, and positions that leave too few words, are passed over; what is left is checked
exactly, but first by sketches: whether each of 512 classes of words has an odd or an even number of the set's words. Every
class in which two sets differ holds a word that only one of them has, so too many of them rule a pair out, and only the others carry their words.

A word that more than ``CROWD`` texts of a book have in their prefix is no key of its own: those texts meet on that word
and the next shared one, then on three, and so on to ``DEPTH`` words. Groups that are still larger, texts too short to
share a further word, and groups with fewer pairs than ``WORTH`` times the keys of two more words that they would have (near copies of a
long text, which share most of a long prefix) are dealt into blocks, every pair of which is compared by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.shared import settled

#: Texts that meet on one key, words of the longest key, texts of a block, pairs that are worth a longer key (which leads to still longer ones), and buckets of word frequencies (8 MB).
CROWD, DEPTH, BLOCK, WORTH, BUCKETS = 64, 6, 512, 16, 1 << 20
SLACK = 1e-9
#: Numbers of 64 classes of words each in a sketch; pairs that are compared together, about, and at most of one family.
SKETCH, TOGETHER, FAMILY = 8, 20_000, 1_000_000


def _least_overlap(size: Column, threshold: float) -> Column:
    """Words that a set of this size shares with the smallest set that can be similar to it."""
    return F.ceil(size * (threshold / (2 - threshold)) - SLACK).cast("int")


def ordered_sets(rows: DataFrame, book: str, key: str, words: str, *more: str) -> DataFrame:
    """(sid, book, key, t, size, and columns ``more`` as they are): distinct words as 64-bit hashes, rare first; those of equal frequency in order of their hash.

    Frequencies are counted in ``BUCKETS`` buckets of hashes over all books, so that they can be broadcast whatever the vocabulary:
    any order is right, a rarer first word only makes smaller groups. ``sid`` is a number in place of book and key, so
    that what is shuffled for every word of a prefix stays small.
    """
    rows = settled(rows.select(F.col(book).alias("book"), F.col(key).alias("key"), F.transform(F.array_distinct(words), lambda w: F.xxhash64(w)).alias("t"), F.monotonically_increasing_id().alias("sid"), *more), "similarity-words")
    counts = np.zeros(BUCKETS, np.int64)
    counted = rows.select(F.explode("t").alias("h")).groupBy(F.pmod("h", F.lit(BUCKETS)).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return rows.select("sid", "book", "key", _orderer(rows.sparkSession.sparkContext.broadcast(counts))("t").alias("t"), F.size("t").alias("size"), *more).where("size > 0")


def _orderer(shared):
    def run(sets: pa.Array) -> pa.Array:
        offsets, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        row = np.repeat(np.arange(len(sets)), np.diff(offsets))
        flat = flat[offsets[0] : offsets[-1]]
        order = np.lexsort((flat, shared.value[flat % BUCKETS], row))
        return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(flat[order]))

    return F.arrow_udf(run, "array<long>")


def _sketched(sets: pa.Array) -> pa.Array:
    """For each class of words, whether a set has an odd number of them."""
    offsets = sets.offsets.to_numpy()
    flat = sets.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
    most = 64 * SKETCH
    where = np.repeat(np.arange(len(sets)), np.diff(offsets)) * most + (flat >> np.uint64(40)).astype(np.int64) % most
    odd = (np.bincount(where, minlength=most * len(sets)) & 1).astype(np.uint8).reshape(-1, most)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH), pa.array(np.packbits(odd, axis=1).view("<i8").ravel()))


def _apart(a: Column, b: Column, sizes: Column, threshold: float) -> Column:
    """Whether sketches differ in no more classes than sets of ``sizes`` words in all may have words that the other has not."""
    return F.bit_count(a.bitwiseXOR(b)) <= sizes * (1 - threshold) + SLACK


def _possible(threshold: float, depth: int) -> Column:
    """Whether two texts that share ``depth`` words, the last at their positions, can still reach the threshold."""
    more = F.least(F.col("a.size") - F.col("a.pos"), F.col("b.size") - F.col("b.pos")) - 1
    sizes = F.col("a.size") + F.col("b.size")
    return (depth + more >= sizes * (threshold / 2) - SLACK) & _apart(F.col("a.bits"), F.col("b.bits"), sizes, threshold)


def _pairs(a: DataFrame, b: DataFrame, on: Column, threshold: float, depth: int) -> DataFrame:
    met = a.alias("a").join(b.alias("b"), (F.col("a.path") == F.col("b.path")) & on & _possible(threshold, depth))
    return met.select(F.least("a.sid", "b.sid").alias("x"), F.greatest("a.sid", "b.sid").alias("y"))


def _by_key(rows: DataFrame, threshold: float, depth: int) -> DataFrame:
    return _pairs(rows, rows, F.col("a.sid") < F.col("b.sid"), threshold, depth)


def _by_block(rows: DataFrame, threshold: float, depth: int) -> DataFrame:
    """All pairs of groups of any size; a text is copied once for each block it is compared with."""
    sizes = rows.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "path").withColumn("x", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    a = dealt.withColumn("y", F.explode(F.sequence("x", F.col("blocks") - 1)))
    b = dealt.withColumnRenamed("x", "y").withColumn("x", F.explode(F.sequence(F.lit(0), "y")))
    on = (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    return _pairs(a, b, on & ((F.col("a.x") < F.col("a.y")) | (F.col("a.sid") < F.col("b.sid"))), threshold, depth)


def _sketches_allow(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` whose sketches do not rule them out."""
    of = lambda key, *names: sets.select(F.col("sid").alias(key), *[F.col(old).alias(new) for old, new in names])
    both = pairs.join(of("x", ("sketch", "s"), ("size", "n")), "x").join(of("y", ("sketch", "u"), ("size", "m")), "y")
    differ = sum((F.bit_count(F.get("s", F.lit(k)).bitwiseXOR(F.get("u", F.lit(k)))) for k in range(SKETCH)), F.lit(0))
    return both.where(differ <= (F.col("n") + F.col("m")) * (1 - threshold) + SLACK).select("x", "y")


def _compared(pairs: DataFrame, sets: DataFrame, threshold: float, together: int = TOGETHER, family: int = FAMILY) -> DataFrame:
    """(book, i, j, dice) of the ``pairs`` of one book that reach the threshold.

    Pairs are dealt by the least text that their first one is paired with, so that near copies meet in one place and their
    words go there once, not once a pair. A family of more than ``family`` pairs is dealt to several places.
    """
    buckets = max(1, -(-pairs.count() // together))
    many = pairs.groupBy(F.col("x").alias("sid")).agg(F.collect_list("y").alias("ys"))
    least = pairs.groupBy(F.col("y").alias("sid")).agg(F.min("x").alias("least"))
    many = many.join(least, "sid", "left").withColumn("cell", F.coalesce("least", "sid")).drop("least")
    parts = many.groupBy("cell").agg(F.ceil(F.sum(F.size("ys")) / family).alias("parts"))
    bucket = F.pmod(F.xxhash64("cell", F.pmod(F.xxhash64("sid"), F.col("parts"))), F.lit(buckets)).cast("int")
    many = settled(many.join(parts, "cell").select(bucket.alias("bucket"), "sid", "ys"), "similarity-met")
    others = many.select("bucket", F.explode("ys").alias("sid"), F.lit(None).cast("array<long>").alias("ys")).distinct()
    asked = many.unionByName(others).groupBy("bucket", "sid").agg(F.first("ys", ignorenulls=True).alias("ys"))
    key = sets.schema["key"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("sid")
        sid, t, ys = table.column("sid").to_numpy(), table.column("t").combine_chunks(), table.column("ys").combine_chunks().fill_null([])
        starts, size = t.offsets.to_numpy().astype(np.int64), np.diff(t.offsets.to_numpy()).astype(np.int64)
        starts = starts[:-1] - starts[0]
        code = np.unique(t.flatten().to_numpy(), return_inverse=True)[1]
        mark = np.zeros(len(code) + 1, bool)
        cut = np.concatenate([[0], np.cumsum(np.diff(ys.offsets.to_numpy()))])
        y = np.searchsorted(sid, ys.flatten().to_numpy())
        x, both = np.repeat(np.arange(len(sid)), np.diff(cut)), np.zeros(len(y), np.int64)
        for i in np.flatnonzero(np.diff(cut)):
            own = code[starts[i] : starts[i] + size[i]]
            mark[own] = True
            for k in range(cut[i], cut[i + 1], 2_000):
                other = y[k : min(k + 2_000, cut[i + 1])]
                ends = np.cumsum(size[other])
                words = np.arange(ends[-1]) + np.repeat(starts[other] - ends + size[other], size[other])
                both[k : k + len(other)] = np.add.reduceat(mark[code[words]], ends - size[other], dtype=np.int64)
            mark[own] = False
        dice = 2 * both / (size[x] + size[y])
        book = table.column("book").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        kept = np.flatnonzero((dice >= threshold) & (book[x] == book[y]))
        of = lambda name, rows: table.column(name).take(pa.array(rows[kept])).combine_chunks()
        return pa.table([of("book", x), of("key", x), of("key", y), pa.array(dice[kept])], names=["book", "i", "j", "dice"])

    found = asked.join(sets.select("sid", "book", "key", "t"), "sid").groupBy("bucket").applyInArrow(run, f"book string, i {key}, j {key}, dice double")
    return found.select("book", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "dice")


def similar_pairs(sets: DataFrame, threshold: float, crowd: int = CROWD, depth: int = DEPTH) -> DataFrame:
    """(book, i, j, dice) of all pairs i < j of one book whose Dice coefficient is at least ``threshold``, which must be above 0.

    ``sets`` comes from ``ordered_sets``. Empty sets are similar to none.
    """
    if not 0 < threshold <= 1:
        raise ValueError("similarity_threshold must be above 0 and at most 1 where pairs have no budget")
    ratio = threshold / (2 - threshold)
    sets = settled(sets.withColumn("sketch", F.arrow_udf(_sketched, "array<long>")("t")), "similarity-sets")
    # 64 classes for all places of a text; all 512 for each pair
    bits = F.aggregate("sketch", F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)).alias("bits")
    reach = F.col("size") - _least_overlap(F.col("size"), threshold)
    first = sets.select("sid", "book", "size", bits, F.posexplode(F.slice("t", F.lit(1), reach + 1)).alias("pos", "h"))
    level, met = first.select("sid", "size", "bits", "pos", F.xxhash64("book", "h").alias("path")), []
    for k in range(1, depth + 1):
        most = F.greatest(F.least(reach + k, F.col("size") - 1) - F.col("pos"), F.lit(0)).cast("long")
        crowds = level.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(most * (most + 1)).alias("keys")).where("n > 1")
        level = settled(level.join(crowds, "path"), f"similarity-keys-{k}")
        met.append(_by_key(level.where(F.col("n") <= crowd), threshold, k))
        level = level.where(F.col("n") > crowd)
        if level.isEmpty():
            break
        if k == depth:
            met.append(_by_block(level, threshold, k))
            break
        # few pairs for their many words; and texts that may share no further word with a similar one, and all that are short enough for these
        few = F.col("n") * (F.col("n") - 1) <= WORTH * F.col("keys")
        met.append(_by_block(level.where(few | (F.col("size") * (ratio * ratio) <= k + SLACK)), threshold, k))
        further = level.where(~few & (_least_overlap(F.col("size"), threshold) > k)).join(sets.select("sid", "t"), "sid")
        nexts = F.transform(F.slice("t", F.col("pos") + 2, F.greatest(reach + k - F.col("pos"), F.lit(0))), lambda h, i: F.struct((F.col("pos") + 1 + i).alias("pos"), h.alias("h")))
        level = further.select("sid", "size", "bits", "path", F.explode(nexts).alias("next")).select("sid", "size", "bits", F.col("next.pos").alias("pos"), F.xxhash64("path", "next.h").alias("path"))
    pairs = met[0]
    for more in met[1:]:
        pairs = pairs.unionByName(more)
    pairs = settled(_sketches_allow(pairs.distinct(), sets, threshold), "similarity-pairs")
    return _compared(pairs, sets, threshold)
