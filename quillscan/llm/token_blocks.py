"""Token ids in patched frame-of-reference blocks.

A segment is a self-contained file image holding a run of documents in ascending id order:

    header    magic, block length, documents, tokens, blocks, bytes per exception   (little endian)
    documents ids i8, null marks u1, lengths u4
    blocks    minimum u4, width u1, exceptions u1, payload start u4 (the index of block starts)
    payload   per block its low bits, ``width`` per id, in 32-bit words
    patches   per block positions u1, then high bits u2 or u4 (all positions first)

The block minimum is subtracted, the width is that of a chosen percentile of the differences, and
what exceeds it keeps its low bits in place with the rest in the exception list. Segments are rows
of a Parquet table in the shared folder, so that Spark's writer commits them and any store works.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillscan.llm._bytes import flat, lean, pieces
from quillscan.llm._store import documents, written
from quillscan.llm._tokens import END_ID, encoder, vocabulary

BLOCK, PERCENTILE, SEGMENT_TOKENS = 128, 0.9, 1_000_000
_HEAD = struct.Struct("<4sIQQQI")
_MAGIC = b"QPF1"


def _width(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack(doc_ids: list, lengths: list[int], ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """File image of documents with these ids (None allowed) and token counts, ``ids`` being all their tokens."""
    n, nb = len(ids), -(-len(ids) // block)
    grid = np.empty(nb * block, np.uint32)
    grid[:n] = ids
    grid[n:] = ids[-1] if n else 0
    grid = grid.reshape(nb, block)
    low = grid.min(axis=1) if nb else np.zeros(0, np.uint32)
    diff = grid - low[:, None]
    at = min(block - 1, int(percentile * block))
    width = _width(np.partition(diff, at, axis=1)[:, at]) if nb else np.zeros(0, np.int64)
    high = diff >> np.minimum(width, 31).astype(np.uint32)[:, None]
    high[width == 32] = 0
    row, col = np.divmod(np.flatnonzero(high > 0), block)
    per_block = np.bincount(row, minlength=nb).astype(np.uint8 if block < 256 else np.uint16)
    words = block // 32 * width
    starts = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
    payload = np.zeros(starts[-1], "<u4")
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        lanes = np.ascontiguousarray(diff[rows].T) & np.uint32((1 << w) - 1)
        out = np.zeros((block // 32 * w, len(rows)), np.uint32)
        for j in range(block):
            word, shift = divmod(j * w, 32)
            out[word] |= lanes[j] << np.uint32(shift)
            if shift + w > 32:
                out[word + 1] |= lanes[j] >> np.uint32(32 - shift)
        payload[starts[rows][:, None] + np.arange(block // 32 * w)] = out.T
    patches = high[row, col]
    wide = 4 if len(patches) and patches.max() > 0xFFFF else 2
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([
        _HEAD.pack(_MAGIC, block, len(doc_ids), n, nb, wide),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), null.tobytes(), np.array(lengths, "<u4").tobytes(),
        low.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), per_block.tobytes(), starts.astype("<u4").tobytes(),
        payload.tobytes(), col.astype(np.uint8 if block <= 256 else np.uint16).tobytes(), patches.astype(f"<u{wide}").tobytes(),
    ])


def unpack(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Inverse of ``pack``: document ids, token counts, all tokens."""
    magic, block, docs, n, nb, wide = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a token segment")
    at = _HEAD.size

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, null, lengths = take("<i8", docs), take(np.uint8, docs), take("<u4", docs)
    low, width = take("<u4", nb), take(np.uint8, nb).astype(np.int64)
    per_block, starts = take(np.uint8 if block < 256 else np.uint16, nb), take("<u4", nb + 1).astype(np.int64)
    payload = take("<u4", starts[-1])
    count = int(per_block.sum(dtype=np.int64))
    col, patches = take(np.uint8 if block <= 256 else np.uint16, count), take(f"<u{wide}", count)
    grid = np.zeros((nb, block), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows, used = np.flatnonzero(width == w), block // 32 * w
        words = np.ascontiguousarray(payload[starts[rows][:, None] + np.arange(used)].T)
        lanes = np.empty((block, len(rows)), np.uint32)
        for j in range(block):
            word, shift = divmod(j * w, 32)
            x = words[word] >> np.uint32(shift)
            if shift + w > 32:
                x |= words[word + 1] << np.uint32(32 - shift)
            lanes[j] = x & np.uint32((1 << w) - 1)
        grid[rows] = lanes.T
    row = np.repeat(np.arange(nb), per_block)
    grid[row, col] |= patches.astype(np.uint32) << width[row].astype(np.uint32)
    grid += low[:, None]
    return [None if z else int(d) for d, z in zip(doc_ids, null)], lengths, grid.reshape(-1)[:n]


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id``, and write segments in ascending id order; returns the segment table.

    Columns: part and seg (their order is the documents' order), n_docs, n_tokens, payload. Null text is an
    empty document; null ids come first; rows that repeat an id are ordered by text; a document is never
    split between segments; an empty table has no segments; other columns are ignored.
    """
    path = tokenizer or vocabulary()

    def segments(batches):
        part, seg, doc_ids, sizes, data, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def close():
            nonlocal seg, doc_ids, sizes, data, held
            ids = np.concatenate(data)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seg": pa.array([seg], pa.int32()), "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_tokens": pa.array([held], pa.int64()), "payload": pa.array([pack(doc_ids, sizes, ids)], pa.binary())})
            seg, doc_ids, sizes, data, held = seg + 1, [], [], [], 0
            return row

        for batch in batches:
            names, (raw, offsets) = batch.column(0).to_pylist(), flat(batch.column(1))
            for a, b in pieces(offsets):
                ids, counts = encoder(path).encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end_id)
                done, ends = 0, np.cumsum(counts)
                for doc, n, upto in zip(names[a:b], counts.tolist(), ends.tolist()):
                    doc_ids.append(doc)
                    sizes.append(n)
                    held += n
                    if held >= segment_tokens:
                        data.append(ids[done:upto])
                        done = upto
                        yield close()
                data.append(ids[done:])
        if doc_ids:
            yield close()

    ordered = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(lean(segments), "part int, seg int, n_docs long, n_tokens long, payload binary"), "token-segments")


def read_tokens(segments: DataFrame) -> DataFrame:
    """Per document, from the segments alone: doc_id, start, n_tokens, ids_crc32, in the order written."""

    def decode(batches):
        for batch in batches:
            for part, seg, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                doc_ids, lengths, ids = unpack(data)
                ends = np.cumsum(lengths.astype(np.int64))
                raw, starts = ids.astype("<u4").tobytes(), ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(doc_ids)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * n, pa.int32()), "seg": pa.array([seg] * n, pa.int32()), "doc_id": pa.array(doc_ids, pa.int64()), "local": pa.array(starts, pa.int64()), "n_tokens": pa.array(lengths.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    within = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.sum("n").over(across) - F.col("n")).drop("n")
    places = segments.select("part", "seg", "n_tokens").withColumn("seg_start", F.sum("n_tokens").over(within) - F.col("n_tokens")).drop("n_tokens")
    places = places.join(parts, "part").select("part", "seg", (F.col("base") + F.col("seg_start")).alias("base"))
    docs = segments.select("part", "seg", "payload").mapInArrow(lean(decode), "part int, seg int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(places, ["part", "seg"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(documents(spark, sf_dir)))
