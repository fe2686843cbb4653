"""Benchmark decontamination by winnowing.

A run of ``t`` words is known by one k-gram hash: the least of the hashes of its ``w = t - k + 1`` k-grams,
the rightmost of equals. Equal runs choose the same k-gram, so any span of ``t`` words that a document shares
with a benchmark item shares a fingerprint; each hit is then extended to the whole run by two 64-bit hashes of
its words, and runs that touch are joined into maximal spans. Items of fewer than ``SPAN`` words are one run of
their own length, for which fingerprints of that length are kept (nine more lengths at most).

The index of the benchmark is broadcast while it has at most ``MOST_WINDOWS`` runs: then documents are read once
and nothing of them is shuffled. Beyond, fingerprints of documents meet the index in a semi join, and only
documents that have a hit come back for the extension.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.llm._bytes import ALNUM, flat, lean, mix, pieces, prefix, span, words
from quillscan.llm._store import documents, small_batches, written

#: Words of a window of a benchmark item, and runs in an index that is broadcast (some 40 bytes each).
SPAN, MOST_WINDOWS = 10, 1_000_000
_EMPTY = np.zeros(0, np.int64)
_BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SPANS = "array<struct<start:bigint,end:bigint>>"


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of every word: runs of ASCII letters (A-Z lower-cased), digits and longer characters."""
    starts, ends, row = words(raw, offsets, ALNUM)
    return row, span(prefix(raw, fold=True), starts, ends)


def run_hashes(h: np.ndarray, at: np.ndarray, n: int, which: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words that start at ``at``."""
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        out = out * _BASES[which] + h[at + j]
    return mix(out + np.uint64(n))


def winnowed(row: np.ndarray, h: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``t`` words within rows, and the fingerprint of each."""
    k = (t + 1) // 2
    if len(h) < t:
        return _EMPTY, np.zeros(0, np.uint64)
    grams = run_hashes(h, np.arange(len(h) - k + 1), k, 0)
    starts = np.flatnonzero(row[: len(h) - t + 1] == row[t - 1 :])
    least = grams[starts]
    for j in range(1, t - k + 1):
        other = grams[starts + j]
        least = np.where(other <= least, other, least)
    return starts, least


def benchmark_index(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", words_in_window: int = SPAN) -> DataFrame:
    """One row per run of every item: item (text, null where the id is), t, f (fingerprint), a, b (hashes of the run)."""

    def run(batches):
        for batch in batches:
            row, h = word_hashes(*flat(batch.column(1)))
            count = np.bincount(row, minlength=len(batch))
            for t in np.unique(np.minimum(count, words_in_window)[count > 0]).tolist():
                starts, f = winnowed(row, h, t)
                mine = (count[row[starts]] == t) | (t == words_in_window)
                starts, f = starts[mine], f[mine]
                yield pa.RecordBatch.from_pydict({
                    "item": batch.column(0).take(pa.array(row[starts])), "t": pa.array(np.full(len(starts), t), pa.int32()),
                    **{name: pa.array(x.view(np.int64)) for name, x in (("f", f), ("a", run_hashes(h, starts, t, 0)), ("b", run_hashes(h, starts, t, 1)))},
                })

    rows = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), "item string, t int, f long, a long, b long").distinct()


@dataclass
class Index:
    """Runs of a benchmark in arrays: by length, sorted by first hash, with the items that hold each."""

    fingerprints: dict[int, np.ndarray]
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    first: np.ndarray
    holders: np.ndarray
    items: list[str | None]

    @classmethod
    def of(cls, table: pa.Table) -> Index:
        items = table.column("item").combine_chunks().dictionary_encode()
        code = items.indices.fill_null(len(items.dictionary)).to_numpy()
        t, f, a, b = (table.column(c).to_numpy() for c in "tfab")
        f, a, b = (x.view(np.uint64) for x in (f, a, b))
        order = np.lexsort((code, b, a, t))
        t, f, a, b, code = (x[order] for x in (t, f, a, b, code))
        fresh = np.r_[True, (t[1:] != t[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(t) else np.zeros(0, bool)
        heads = np.flatnonzero(fresh)
        number = np.arange(len(heads))
        runs = {n: (a[heads][t[heads] == n], b[heads][t[heads] == n], number[t[heads] == n]) for n in np.unique(t).tolist()}
        return cls({n: np.unique(f[t == n]) for n in runs}, runs, np.r_[heads, len(t)], code, [*items.dictionary.to_pylist(), None])

    def found(self, row: np.ndarray, h: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """For every length: starts of the document's runs that are an item's, the length, and the runs' numbers."""
        out = []
        for t, (a, b, number) in self.runs.items():
            starts, f = winnowed(row, h, t)
            starts = starts[member(self.fingerprints[t], f)]
            first, second = run_hashes(h, starts, t, 0), run_hashes(h, starts, t, 1)
            at, end = np.searchsorted(a, first), np.searchsorted(a, first, "right")
            while (open_ := (at < end) & (b[np.minimum(at, len(b) - 1)] != second)).any():
                at = at + open_
            hit = at < end
            out.append((starts[hit], t, number[at[hit]]))
        return out

    def named(self, runs: np.ndarray) -> list[str]:
        """Ids, in order of their text, of the items that hold any of these runs; those without an id are left out."""
        codes = {c for r in np.unique(runs).tolist() for c in self.holders[self.first[r] : self.first[r + 1]].tolist()}
        return sorted(i for i in (self.items[c] for c in codes) if i is not None)


def member(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``keys``."""
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x if len(keys) else np.zeros(len(x), bool)


def joined_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of overlapping or touching ones."""
    if not len(starts):
        return _EMPTY, _EMPTY
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.r_[True, starts[1:] > ends[:-1]]
    return starts[fresh], ends[np.r_[np.flatnonzero(fresh)[1:] - 1, len(ends) - 1]]


def contaminated(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_windows: int = MOST_WINDOWS) -> DataFrame:
    """doc_id, n_words, spans (of words that are the benchmark's, half-open, in order), items (ids as text, in order).

    Null and empty texts have no words; rows that repeat id and text count each on their own; null ids are kept; items
    without an id make spans but are not named, items without words make none, and items that share an id are one; an
    empty table gives no rows, an empty benchmark rows without spans; other columns are ignored.
    """
    index = written(index, "benchmark-runs")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return _broadcast_way(rows, index) if index.count() <= most_windows else _shuffled_way(rows, index)


def _broadcast_way(rows: DataFrame, index: DataFrame) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(Index.of(index.toArrow()))

    def run(batches):
        known = shared.value
        for batch in batches:
            raw, offsets = flat(batch.column(1))
            for a, b in pieces(offsets):
                row, h = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                count = np.bincount(row, minlength=b - a)
                before = np.cumsum(count) - count
                found = known.found(row, h)
                starts = np.concatenate([s for s, _, _ in found] or [_EMPTY])
                ends = np.concatenate([s + t for s, t, _ in found] or [_EMPTY])
                runs = np.concatenate([r for _, _, r in found] or [_EMPTY])
                spans, items = [[] for _ in range(b - a)], [[] for _ in range(b - a)]
                owner = row[starts] if len(starts) else _EMPTY
                for k in np.unique(owner).tolist():
                    mine = owner == k
                    s, e = joined_spans(starts[mine] - before[k], ends[mine] - before[k])
                    spans[k] = [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())]
                    items[k] = known.named(runs[mine])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(a, b - a), "n_words": pa.array(count),
                    "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "items": pa.array(items, pa.list_(pa.string())),
                })

    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, spans {SPANS}, items array<string>")


def _shuffled_way(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Nothing is broadcast but the lengths of runs (ten at most); a row is known by two hashes of its id and text."""
    lengths = sorted(r[0] for r in index.select("t").distinct().collect())
    key = ["x", "y"]
    keyed = rows.select(F.xxhash64("doc_id", "text").alias("x"), F.xxhash64("text", "doc_id", F.lit(1)).alias("y"), "doc_id", "text")
    texts = keyed.select(*key, "text")

    def sketch(batches):
        for batch in batches:
            row, h = word_hashes(*flat(batch.column(2)))
            count = np.bincount(row, minlength=len(batch))
            found = [(row[s], np.full(len(s), t), f.view(np.int64)) for t in lengths for s, f in [winnowed(row, h, t)]]
            at = np.unique(np.column_stack([np.concatenate(c) for c in zip(*found)]), axis=0)
            lists = np.split(at[:, 1:], np.searchsorted(at[:, 0], np.arange(1, len(batch))))
            prints = pa.array([[{"t": t, "f": f} for t, f in x.tolist()] for x in lists], pa.list_(pa.struct([("t", pa.int32()), ("f", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count), prints], names=[*key, "n_words", "prints"])

    def extend(batches):
        for batch in batches:
            for k in range(len(batch)):
                row, h = word_hashes(*flat(batch.column(2).slice(k, 1)))
                for t in lengths:
                    wanted = np.array(sorted(p["f"] for p in batch.column(3)[k].as_py() if p["t"] == t), np.int64)
                    starts, f = winnowed(row, h, t)
                    mine = member(wanted, f.view(np.int64))
                    starts, f = starts[mine], f[mine]
                    a, b = (run_hashes(h, starts, t, i).view(np.int64) for i in (0, 1))
                    n = len(starts)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * n, pa.int64())), batch.column(1).take(pa.array([k] * n, pa.int64())), pa.array([t] * n, pa.int32()), pa.array(f.view(np.int64)), pa.array(a), pa.array(b), pa.array(starts)], names=[*key, "t", "f", "a", "b", "start"])

    sketched = written(texts.mapInArrow(lean(sketch), "x long, y long, n_words long, prints array<struct<t:int,f:bigint>>").dropDuplicates(key), "winnowed")
    prints = sketched.select(*key, F.explode("prints").alias("p")).select(*key, "p.*")
    hits = prints.join(index.select("t", "f").distinct(), ["t", "f"], "left_semi").groupBy(key).agg(F.collect_list(F.struct("t", "f")).alias("prints"))
    once = texts.join(hits, key).dropDuplicates(key).select(*key, "text", "prints")
    runs = once.mapInArrow(lean(extend), "x long, y long, t int, f long, a long, b long, start long")
    marks = index.groupBy("t", "f", "a", "b").agg(F.min("item").alias("any"))
    found = written(runs.join(marks.drop("any"), ["t", "f", "a", "b"], "left_semi"), "runs")
    # spans that touch, joined within a document: a new one starts after the furthest end so far
    ordered = F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("t")).alias("end"))))
    step = lambda done, s: F.when((F.size(done) > 0) & (s["start"] <= F.element_at(done, -1)["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(s)))
    spans = found.groupBy(key).agg(ordered.alias("s")).select(*key, F.aggregate("s", F.array().cast(SPANS), step).alias("spans"))
    items = found.join(index, ["t", "f", "a", "b"]).where("item is not null").select(*key, "item").distinct().groupBy(key).agg(F.sort_array(F.collect_list("item")).alias("items"))
    per = sketched.select(*key, "n_words").join(spans, key, "left").join(items, key, "left")
    out = keyed.select("doc_id", *key).join(per, key)
    return out.select("doc_id", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for all ``documents`` against all of ``benchmark``."""
    small_batches(spark)
    found = contaminated(documents(spark, sf_dir), benchmark_index(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH lowered AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS t, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM items WHERE len(w) > 0)
), runs AS (
  SELECT r, t, s, array_to_string(w[s:s + t - 1], ' ') AS words FROM (SELECT r, w, t, unnest(range(1, len(w) - t + 2)) AS s FROM lowered, (SELECT DISTINCT t FROM windows) WHERE len(w) >= t)
), found AS (
  SELECT r, s, t, item_id FROM runs JOIN windows USING (t, words)
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + t)) AS p FROM (SELECT DISTINCT r, s, t FROM found)) GROUP BY 1
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM lowered LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
