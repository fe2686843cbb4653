"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents longer than a sequence are cut into full pieces with what is left over as the first piece;
a full piece is a sequence of its own. The left-overs are bin-packed: they are dealt by hash into
chunks of about ``CHUNK`` documents, and every chunk evolves on ``ISLANDS`` islands (one task's group
each). A genome assigns items to bins; crossover injects whole well-filled bins of one parent into the
other, drops the bins that now repeat an item, and best-fits the displaced items. After each epoch an
island's elites migrate to the next one. Evolution ends where a chunk meets its lower bound, the number of
sequences that its tokens fill.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.llm._bytes import flat, lean, pieces
from quillscan.llm._store import documents, written
from quillscan.llm._tokens import END_ID, encoder, vocabulary

CAPACITY, CHUNK, ISLANDS, EPOCHS, POPULATION, GENERATIONS, ELITES = 1024, 4096, 2, 2, 4, 6, 2


def best_fit(order, sizes: np.ndarray, capacity: int, assign: np.ndarray, fill: list[int]) -> None:
    """Put each item of ``order`` into the fullest bin that has room, opening bins at need; edits assign and fill."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, f in enumerate(fill):
        room[capacity - f].append(b)
        mask |= 1 << (capacity - f)
    size = sizes.tolist()
    for i in order:
        s = size[i]
        m = mask >> s
        if m:
            r = (m & -m).bit_length() - 1 + s
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            b, r = len(fill), capacity
            fill.append(0)
        assign[i] = b
        fill[b] += s
        room[r - s].append(b)
        mask |= 1 << (r - s)


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject a random half of b's well-filled bins into a; displaced items are best-fitted, largest first."""
    fill_b = np.bincount(b, weights=sizes).astype(np.int64)
    good = np.flatnonzero(fill_b >= np.quantile(fill_b, 0.5))
    chosen = np.zeros(len(fill_b), bool)
    chosen[good[rng.random(len(good)) < 0.5]] = True
    injected = chosen[b]
    hit = np.zeros(a.max() + 1, bool)
    hit[a[injected]] = True
    kept = ~hit[a] & ~injected
    child = np.full(len(a), -1, np.int64)
    kept_bins, kept_ids = np.unique(a[kept], return_inverse=True)
    new_bins, new_ids = np.unique(b[injected], return_inverse=True)
    child[kept], child[injected] = kept_ids, new_ids + len(kept_bins)
    fill = np.bincount(child[child >= 0], weights=sizes[child >= 0], minlength=len(kept_bins) + len(new_bins)).astype(int).tolist()
    left = np.flatnonzero(child < 0)
    best_fit(left[np.argsort(-sizes[left], kind="stable")].tolist(), sizes, capacity, child, fill)
    return child


def bins(assign: np.ndarray) -> int:
    return int(assign.max()) + 1 if len(assign) else 0


def fitness(assign: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then more unequal fill (which leaves room where later items can use it)."""
    return -bins(assign), float(((np.bincount(assign, weights=sizes) / capacity) ** 2).sum())


def evolve(sizes: np.ndarray, capacity: int, seeds: list[np.ndarray], rng: np.random.Generator, population: int = POPULATION, generations: int = GENERATIONS) -> list[np.ndarray]:
    """The population after some generations, best first; starts from ``seeds`` and greedy packings."""
    floor = -(-int(sizes.sum()) // capacity)
    people = list(seeds)
    for k in range(population):
        if people and min(map(bins, people)) <= floor:
            break
        if len(people) >= population:
            break
        noise = 1 if not k and not seeds else rng.uniform(0.9, 1.1, len(sizes))
        assign, fill = np.full(len(sizes), -1, np.int64), []
        best_fit(np.argsort(-sizes * noise, kind="stable").tolist(), sizes, capacity, assign, fill)
        people.append(assign)
    rank = lambda: people.sort(key=lambda p: fitness(p, sizes, capacity), reverse=True)
    rank()
    for _ in range(generations):
        if bins(people[0]) <= floor:
            break
        i, j = sorted(rng.choice(len(people), 2, replace=False)) if len(people) > 1 else (0, 0)
        people += [crossover(people[i], people[j], sizes, capacity, rng), crossover(people[j], people[i], sizes, capacity, rng)]
        rank()
        del people[population:]
    return people


def token_table(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: key (unique), doc_id, n_tokens, crcs (one for each piece). Written once."""
    path = tokenizer or vocabulary()

    def coded(batches):
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            names, (raw, offsets) = batch.column(0), flat(batch.column(1))
            for a, b in pieces(offsets):
                ids, counts = encoder(path).encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end_id)
                data, crcs = memoryview(ids.astype("<u4")).cast("B"), []
                for n, upto in zip(counts.tolist(), np.cumsum(counts).tolist()):
                    cut = [upto - n, *range(upto - (n - 1) // capacity * capacity, upto + 1, capacity)]
                    crcs.append([zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(cut, cut[1:])])
                keys = np.arange(row, row + b - a, dtype=np.int64) + (part << 36)
                row += b - a
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "doc_id": names.slice(a, b - a), "n_tokens": pa.array(counts), "crcs": pa.array(crcs, pa.list_(pa.int64()))})

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return written(rows.mapInArrow(lean(coded), "key long, doc_id long, n_tokens long, crcs array<long>"), "pack-tokens")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, chunk: int = CHUNK, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 9, **columns) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is an empty document (its end id alone); every row is packed, also one that repeats an id;
    null ids stay null; an empty table gives no pieces; other columns are ignored.
    """
    tokens = token_table(docs, tokenizer, capacity, **columns)
    chunks = max(1, -(-tokens.count() // chunk))
    items = tokens.select("key", "n_tokens", F.pmod(F.xxhash64("key"), F.lit(chunks)).alias("chunk"))
    state = "chunk long, island int, keys binary, sizes binary, elites array<binary>"

    def start(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        n = rows["n_tokens"].to_numpy(np.int64)
        left = np.where(n % capacity == 0, 0, n % capacity)
        return live(key[0], key[1], rows["key"].to_numpy(np.int64), n, left, [], 0)

    def live(number, island, keys, n, left, seeds, epoch) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(number), int(island), epoch])
        people = evolve(left[left > 0], capacity, seeds, rng)[:ELITES]
        return pd.DataFrame({"chunk": [number], "island": [island], "keys": [keys.tobytes()], "sizes": [n.tobytes()], "elites": [[p.astype(np.int32).tobytes() for p in people]]})

    def migrate(epoch):
        def run(key, rows: pd.DataFrame) -> pd.DataFrame:
            keys, n = (np.frombuffer(rows[c].iloc[0], np.int64) for c in ("keys", "sizes"))
            seeds = sorted({bytes(e) for es in rows["elites"] for e in es})
            return live(key[0], key[1], keys, n, n % capacity, [np.frombuffer(e, np.int32).astype(np.int64) for e in seeds], epoch)

        return run

    def best(key, rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = (np.frombuffer(rows[c].iloc[0], np.int64) for c in ("keys", "sizes"))
        left = n % capacity
        some = left > 0
        seeds = sorted({bytes(e) for es in rows["elites"] for e in es})
        assign = max((np.frombuffer(e, np.int32).astype(np.int64) for e in seeds), key=lambda p: fitness(p, left[some], capacity))
        sequence, offset = np.full(len(n), -1, np.int64), np.zeros(len(n), np.int64)
        order = np.argsort(assign, kind="stable")
        ends = np.cumsum(left[some][order])
        first = np.searchsorted(assign[order], assign[order])
        starts = ends - left[some][order]
        place = np.empty(len(order), np.int64)
        place[order] = starts - starts[first] if len(order) else 0
        sequence[some], offset[some] = assign, place
        full = n // capacity
        base = bins(assign) + np.cumsum(full) - full
        top = int(key[0]) << 32
        return pd.DataFrame({"key": keys, "left_sequence": sequence + top, "left_offset": offset, "full_base": base + top})

    world = items.select("*", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island")).groupBy("chunk", "island").applyInPandas(start, state)
    for epoch in range(1, epochs):
        world = written(world, "pack-world")
        arrivals = world.withColumn("island", (F.col("island") + 1) % islands)
        world = world.unionByName(arrivals).groupBy("chunk", "island").applyInPandas(migrate(epoch), state)
    placed = world.groupBy("chunk").applyInPandas(best, "key long, left_sequence long, left_offset long, full_base long")
    rest = F.pmod("n_tokens", F.lit(capacity))
    first = F.when(rest > 0, rest).otherwise(F.lit(capacity))
    at = F.when(F.col("piece") == 0, F.lit(0)).otherwise(first + (F.col("piece") - 1) * capacity)
    lone = (F.col("piece") > 0) | (rest == 0)
    return (
        tokens.join(placed, "key")
        .select("*", F.posexplode("crcs").alias("piece", "ids_crc32"))
        .select(
            "doc_id",
            "piece",
            at.cast("long").alias("start"),
            F.when(F.col("piece") == 0, first).otherwise(F.lit(capacity)).cast("long").alias("length"),
            "ids_crc32",
            F.when(lone, F.col("full_base") + F.col("piece") - F.when(rest > 0, 1).otherwise(0)).otherwise(F.col("left_sequence")).alias("sequence_id"),
            F.when(lone, F.lit(0)).otherwise(F.col("left_offset")).cast("long").alias("offset"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of ``docs`` with their places, as ``pack`` gives them.

    Null text is an empty document; every row is packed, also one that repeats another; null ids stay null; an empty table
    gives no rows; of the columns only doc_id and text are read.
    """
    return pack(docs)
