"""Ranked lexical search over a bit-sliced impact index.

``build`` deals documents into blocks and writes one row for each: the block's ids in ascending order, its terms
(64-bit hashes, sorted), the places of each term's documents, and the impacts of all these postings cut into
``SLICES`` bitmaps, one for each binary digit. A block never leaves the task that reads its documents, so nothing is
shuffled and a frequent term is no hot key.

``search`` sums bitmaps: a term's slices are multiplied by its weight and added to the slices of every item that has
the term by bitwise carry arithmetic, 64 documents to a machine word. The top of each block is found by going down
the slices from the most significant one, as long as the documents that still qualify are more than asked for; ids
stand in ascending order, which settles ties. Each block gives as many rows as asked for to each item, and a
window over those keeps the best.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillscan.llm._bytes import ALNUM, flat, lean, pieces, prefix, span, words
from quillscan.llm._store import documents, small_batches, written

#: Digits of an impact, which stays below 10**6; documents and bytes of text of a block.
SLICES, BLOCK_DOCS, BLOCK_BYTES = 20, 16_384, 16_000_000
#: (item, term) pairs that are broadcast at a time, and items whose sums a task holds at a time.
MOST_PAIRS, MOST_ITEMS = 200_000, 128
_BLOCK = "terms binary, starts binary, places binary, slices binary"


def term_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of every term: runs of ASCII letters (A-Z lower-cased), digits and longer characters."""
    starts, ends, row = words(raw, offsets, ALNUM)
    return row, span(prefix(raw, fold=True), starts, ends)


@dataclass
class Index:
    """Blocks of the index, and what impacts were made with: documents that have terms, and all their terms."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impacts of ``tf`` occurrences in documents of ``length`` terms, all divisions rounding down."""
    sizes, code = np.unique(length, return_inverse=True)
    m = np.array([10 + 90 * n * n_docs // max(n_terms, 1) for n in sizes.tolist()], np.int64)[code]
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _block(ids: list[pa.Array], parts: list[tuple], lengths: list[np.ndarray], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """One row of the index from the documents of a block."""
    id_ = pa.concat_arrays(ids)
    order = pc.sort_indices(id_, null_placement="at_end").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    doc, h, tf = (np.concatenate(x) for x in zip(*parts))
    length = np.concatenate(lengths)
    at = place[doc]
    by = np.lexsort((at, h))
    q = impact(tf, length[doc], n_docs, n_terms)[by]
    terms, starts = np.unique(h[by], return_index=True)
    slices = np.stack([np.packbits((q >> k) & 1 == 1, bitorder="little") for k in range(SLICES)])
    binary = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
    columns = [pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), id_.take(pa.array(order))), binary(terms.astype("<u8")), binary(np.r_[starts, len(q)].astype("<u4")), binary(at[by].astype("<u4")), binary(slices)]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "terms", "starts", "places", "slices"])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> Index:
    """Index of every document that has a term; null and empty texts have none.

    Documents are read twice: once to count them and their terms, which every impact depends on, and once to cut blocks.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def count(batches):
        for batch in batches:
            _, _, row = words(*flat(batch.column(0)), ALNUM)
            yield pa.RecordBatch.from_pydict({"docs": pa.array([len(np.unique(row))], pa.int64()), "terms": pa.array([len(row)], pa.int64())})

    n_docs, n_terms = (int(x or 0) for x in rows.select("text").mapInArrow(lean(count), "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first())

    def cut(batches):
        ids, parts, lengths, held, size = [], [], [], 0, 0
        for batch in batches:
            raw, offsets = flat(batch.column(1))
            for a, b in pieces(offsets):
                row, h = term_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                length = np.bincount(row, minlength=b - a)
                own = np.flatnonzero(length)
                code = np.zeros(b - a, np.int64)
                code[own] = np.arange(len(own))
                by = np.lexsort((h, row))
                row, h = code[row[by]], h[by]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
                ids.append(batch.column(0).slice(a, b - a).take(pa.array(own)))
                parts.append((row[first] + held, h[first], np.diff(np.r_[first, len(h)])))
                lengths.append(length[own])
                held, size = held + len(own), size + int(offsets[b] - offsets[a])
                if held >= block_docs or size >= block_bytes:
                    if held:
                        yield _block(ids, parts, lengths, n_docs, n_terms)
                    ids, parts, lengths, held, size = [], [], [], 0, 0
        if held:
            yield _block(ids, parts, lengths, n_docs, n_terms)

    kind = rows.schema["id"].dataType.simpleString()
    return Index(written(rows.mapInArrow(lean(cut), f"ids array<{kind}>, {_BLOCK}"), "impact-index"), n_docs, n_terms)


def plus(a: np.ndarray, x: np.ndarray) -> None:
    """Add the number that ``x`` holds in its slices (first axis) to ``a``, in place, by carries; ``a`` has room for the sum."""
    carry = np.zeros(a.shape[1:], np.uint64)
    for k in range(len(a)):
        if k < len(x):
            half = a[k] ^ x[k]
            both = (a[k] & x[k]) | (carry & half)
        elif carry.any():
            half, both = a[k], a[k] & carry
        else:
            return
        a[k] = half ^ carry
        carry = both


def times(slices: np.ndarray, weight: int) -> np.ndarray:
    """Slices of ``weight`` times the number: shifted sums, one for every binary digit of the weight."""
    out = np.zeros((len(slices) + weight.bit_length(), *slices.shape[1:]), np.uint64)
    for k in range(weight.bit_length()):
        if weight >> k & 1:
            plus(out[k:], slices)
    return out


def highest(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Item and place of the ``k`` largest sums above 0 of each item, in ascending place.

    ``sums`` has a row of slices (least significant first) for each item, each slice one bit for each document.
    """
    sure = np.zeros((sums.shape[0], sums.shape[2]), np.uint64)
    open_ = np.bitwise_or.reduce(sums, axis=1)
    for b in range(sums.shape[1] - 1, -1, -1):
        with_ = open_ & sums[:, b]
        n = np.bitwise_count(sure | with_).sum(axis=1, dtype=np.int64)[:, None]
        sure = np.where(n <= k, sure | with_, sure)
        open_ = np.where(n > k, with_, open_ & ~with_)
    bits = lambda x: np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").astype(bool)
    sure, open_ = bits(sure), bits(open_)
    spare = k - sure.sum(axis=1, keepdims=True)
    return np.nonzero(sure | (open_ & (np.cumsum(open_, axis=1) <= spare)))


def _ranked(block: dict, vocabulary: np.ndarray, weights: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], n_items: int, k: int):
    """Item numbers, places and scores of the best documents of one block, for some items at a time."""
    terms, starts, places = (np.frombuffer(block[c], t) for c, t in (("terms", "<u8"), ("starts", "<u4"), ("places", "<u4")))
    packed = np.frombuffer(block["slices"], np.uint8).reshape(SLICES, -1)
    width = (len(block["ids"]) + 63) // 64
    item, term = pairs
    here = np.searchsorted(terms, vocabulary)
    there = (here < len(terms)) & (terms[np.minimum(here, len(terms) - 1)] == vocabulary) & (weights > 0)
    for low in range(0, n_items, MOST_ITEMS):
        mine = (item >= low) & (item < low + MOST_ITEMS) & there[term]
        if not mine.any():
            continue
        own, of = item[mine] - low, term[mine]
        digits = SLICES + int(weights[of].max()).bit_length() + int(np.bincount(own).max()).bit_length()
        sums = np.zeros((digits, min(MOST_ITEMS, n_items - low), width), np.uint64)
        by = np.argsort(of, kind="stable")
        own, of = own[by], of[by]
        for group in np.split(np.arange(len(of)), np.flatnonzero(of[1:] != of[:-1]) + 1):
            t, who = int(of[group[0]]), own[group]
            a, b = int(starts[here[t]]), int(starts[here[t] + 1])
            at = places[a:b].astype(np.int64)
            bits = np.unpackbits(packed[:, a // 8 : (b + 7) // 8], axis=1, bitorder="little")[:, a % 8 : a % 8 + b - a].astype(np.uint64) << (at & 63).astype(np.uint64)
            word = at >> 6
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            product = times(np.bitwise_or.reduceat(bits, first, axis=1), int(weights[t]))
            spot = np.ix_(range(digits), who, word[first])
            part = sums[spot]
            plus(part, product[:, None, :])
            sums[spot] = part
        sums = np.ascontiguousarray(sums.transpose(1, 0, 2))
        who, place = highest(sums, k)
        digit = (sums[who, :, place >> 6] >> (place & 63).astype(np.uint64)[:, None]) & np.uint64(1)
        yield who + low, place, (digit.astype(np.int64) << np.arange(digits)).sum(axis=1)


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item, those of score 0 left out.

    Equal scores are ranked by ascending id, null ids last, and rows that repeat id and text in either order; items
    whose text is null, or whose terms no document has, get no rows, and items that share an id are one with the terms of all;
    an empty index gives no rows. Items are dealt into rounds of about ``most_pairs`` distinct (item, term) pairs, so
    that what is broadcast stays bounded; a single item has as many terms as its text.
    """
    spark = index.blocks.sparkSession
    rows = queries.select(F.col(f"`{id_col}`").alias("item_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def ask(batches):
        for batch in batches:
            row, h = term_hashes(*flat(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(h.view(np.int64))], names=["item_id", "term"])

    item_kind = rows.schema["item_id"].dataType.simpleString()
    asked = written(rows.mapInArrow(lean(ask), f"item_id {item_kind}, term long").distinct(), "asked")
    rounds = max(1, math.ceil(asked.count() / most_pairs))
    parts = [_search_round(index, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r), k) for r in range(rounds)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_round(index: Index, asked: DataFrame, k: int) -> DataFrame:
    spark = index.blocks.sparkSession
    table = asked.toArrow()
    items = table.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
    vocabulary, term = np.unique(table.column("term").to_numpy().view(np.uint64), return_inverse=True)
    wanted = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches):
        for batch in batches:
            total = np.zeros(len(wanted.value), np.int64)
            for terms, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms, sizes = np.frombuffer(terms, "<u8"), np.diff(np.frombuffer(starts, "<u4").astype(np.int64))
                at = np.minimum(np.searchsorted(terms, wanted.value), len(terms) - 1)
                total += np.where(terms[at] == wanted.value, sizes[at], 0)
            known = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"term": pa.array(known), "n": pa.array(total[known])})

    df = np.zeros(len(vocabulary), np.int64)
    for t, n in index.blocks.select("terms", "starts").mapInArrow(lean(frequencies), "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        df[t] = n
    weights = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()], np.int64)
    pairs = items.indices.to_numpy().astype(np.int64), term
    shared = spark.sparkContext.broadcast((vocabulary, weights, pairs, items.dictionary))

    def rank(batches):
        vocabulary, weights, pairs, names = shared.value
        for batch in batches:
            for r in range(len(batch)):
                ids = batch.column(0).slice(r, 1).flatten()
                block = {c: batch.column(c)[r].as_py() for c in ("terms", "starts", "places", "slices")} | {"ids": ids}
                for who, place, score in _ranked(block, vocabulary, weights, pairs, len(names), k):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(who)), ids.take(pa.array(place)), pa.array(score)], names=["item_id", "doc_id", "score"])

    kinds = index.blocks.schema["ids"].dataType.elementType.simpleString(), asked.schema["item_id"].dataType.simpleString()
    return index.blocks.mapInArrow(lean(rank), f"item_id {kinds[1]}, doc_id {kinds[0]}, score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best ``documents`` of every ``benchmark`` item."""
    small_batches(spark)
    return search(build(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, r, t, len(list_filter(w, lambda x: x = t)) AS tf, len(w) AS n FROM (
    SELECT doc_id, r, w, unnest(list_distinct(w)) AS t FROM (
      SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents))
), totals AS (
  SELECT count(DISTINCT r) AS docs, sum(tf)::BIGINT AS terms FROM d
), df AS (
  SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM d, totals GROUP BY 1
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS t FROM benchmark
), scored AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score FROM asked JOIN df USING (t) JOIN d USING (t), totals GROUP BY 1, 2, 3
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
