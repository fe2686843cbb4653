"""Quartile bucket digests of documents, and how alike two digests are.

Byte triplets (i, i+4, i+9), taken around the end of the text, are hashed into 256 buckets; every
bucket is coded by the quartile of the document's bucket counts that it falls into (2 bits), after one
byte for the length on a logarithmic scale. The difference of two digests is the sum of the quartile
steps between their buckets plus a bounded penalty for length, and so has a fixed largest value.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.llm._bytes import flat, lean, pieces
from quillscan.llm._store import documents, partitions

BUCKETS, GAPS, LENGTH_STEP, LENGTH_MOST = 256, (4, 9), 1.1, 24
_LEAST = -(2**63)


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Quartile codes (rows x buckets, 0 to 3) and length codes of a string column; null is empty."""
    raw, offsets = flat(texts)
    codes = np.zeros((len(offsets) - 1, BUCKETS), np.int8)
    for a, b in pieces(offsets):
        r, cut = raw[offsets[a] : offsets[b]].astype(np.uint32), offsets[a : b + 1] - offsets[a]
        size = np.diff(cut)
        row = np.repeat(np.arange(b - a), size)
        reach = np.minimum(size, GAPS[-1])
        tail = np.repeat(cut[1:], reach) - 1 - (np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach))
        key = r.copy()
        for k, gap in enumerate(GAPS, 1):
            other = np.empty_like(r)
            other[: max(0, len(r) - gap)] = r[gap:]
            at = row[tail]
            other[tail] = r[cut[at] + (tail - cut[at] + gap) % size[at]]
            key |= other << np.uint32(8 * k)
        key *= np.uint32(2654435761)
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x85EBCA6B)
        counts = np.bincount(row * BUCKETS + (key >> np.uint32(24)), minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS)
        for q in (1, 2, 3):
            codes[a:b] += counts > np.partition(counts, q * BUCKETS // 4 - 1, axis=1)[:, q * BUCKETS // 4 - 1, None]
    lengths = np.minimum(255, np.rint(np.log(np.diff(offsets) + 1) / np.log(LENGTH_STEP))).astype(np.int64)
    return codes, lengths


def rendered(codes: np.ndarray, lengths: np.ndarray) -> list[str]:
    """Digests as hexadecimal strings: length byte, then four buckets to a byte."""
    packed = (codes[:, 0::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6).astype(np.uint8)
    return [f"{n:02x}{p.tobytes().hex()}" for n, p in zip(lengths.tolist(), packed)]


def likeness(codes_a, lengths_a, codes_b, lengths_b) -> np.ndarray:
    """1 for equal digests, 0 for the largest difference."""
    steps = np.abs(codes_a - codes_b).sum(axis=1, dtype=np.int64) + 2 * np.minimum(np.abs(lengths_a - lengths_b), LENGTH_MOST)
    return 1 - steps / (3 * BUCKETS + 2 * LENGTH_MOST)


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` as a struct column ``doc``, with ``fingerprint``. Null text is empty; no shuffle."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rendered(*digests(batch.column(1))), pa.string())], names=["doc", "fingerprint"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(lean(run), f"doc {rows.schema['doc'].dataType.simpleString()}, fingerprint string")


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of every text, of its edited text, and their likeness to each other and to the next document's.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The last
    quarter of the characters is replaced by as many first ones of the next document in ascending id, the last
    document being followed by the first (a lone document by itself). Null text is empty; null ids come first;
    rows that repeat an id are ordered by text; an empty table gives no rows; other columns are ignored.

    Documents are dealt into id ranges of equal depth; each range also gets a copy of the first document of the
    range after it, so that the text moves once and every range is worked through in order by itself.
    """
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LEAST)).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    count = 4 * partitions(docs.sparkSession)
    cuts = rows.agg(F.percentile_approx("id", [i / count for i in range(1, count)], 20 * count)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))
    spot = F.pandas_udf(lambda s: pd.Series(np.searchsorted(cuts, s.to_numpy(), "right")), "long")
    heads = sorted((r[0], r[1]) for r in rows.select("id").groupBy(spot("id").alias("range")).agg(F.min("id")).collect())
    before = {first: heads[i - 1][0] for i, (_, first) in enumerate(heads)}

    @F.pandas_udf("array<long>")
    def ranges(s: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, s.to_numpy(), "right").tolist()
        return pd.Series([[r, before[i]] if i in before else [r] for r, i in zip(own, s.tolist())])

    dealt = rows.select("*", F.posexplode(ranges("id")).alias("ahead", "range")).repartition("range").sortWithinPartitions("range", "ahead", "id", "text")

    def run(batches):
        kept = None
        for batch in batches:
            batch = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks().to_batches()[0]
            n = len(batch) - 1
            kept = batch.slice(n)
            if not n:
                continue
            text, own = batch.column("text").to_pylist(), np.array(batch.column("ahead").to_pylist()[:n]) == 0
            edited = []
            for t, u in zip(text, text[1:]):
                quarter = len(t) // 4
                edited.append(t[: len(t) - quarter] + u[:quarter])
            codes, lengths = digests(batch.column("text"))
            edited_codes, edited_lengths = digests(pa.array(edited, pa.string()))
            out = pa.RecordBatch.from_pydict({
                "doc_id": pa.array([None if i == _LEAST else i for i in batch.column("id").to_pylist()[:n]], pa.int64()),
                "n_chars": pa.array([len(t) for t in text[:n]], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                "fingerprint": pa.array(rendered(codes[:n], lengths[:n]), pa.string()),
                "edited_fingerprint": pa.array(rendered(edited_codes, edited_lengths), pa.string()),
                "near_edited": pa.array(likeness(codes[:n], lengths[:n], edited_codes, edited_lengths)),
                "near_next": pa.array(likeness(codes[:n], lengths[:n], codes[1:], lengths[1:])),
            })
            yield out.filter(pa.array(own))

    return dealt.mapInArrow(lean(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(documents(spark, sf_dir))
