"""Repeated phrases of any width without a budget.

A phrase is a run of tokens within a sentence. It is a maximal repeat if it occurs more than once and cannot be made longer
without losing occurrences: its occurrences are preceded by different tokens (or one begins its sentence) and
followed by different tokens (or one ends its sentence). All other repeated phrases are parts of maximal ones.

Phrases of up to ``SPAN`` tokens are found in one step: the positions of repeated runs of the least width that stand after different
tokens (few of all) take their next tokens with them, are dealt by their first ones, sorted, and every phrase that neighbours share
is told with its number. Only positions whose phrases are longer go on; for these, widths are found by bisection over powers of
two, for all positions of all books at once. Where a phrase is as frequent as the one 2**k tokens longer, no phrase between them can be right-maximal, and the interval is passed over; otherwise
its middle is counted and both halves go on. Positions that agree up to the middle are one class from then on in the lower
half: one of them stands for all, with their number, first and last place and the tokens before them. So each level holds at
most about as many rows as there are positions of repeated phrases, also where a line is repeated in itself a thousand
times, and there are as many levels as the longest such sentence's length has binary digits.
Phrases are known by two 64-bit hashes, taken from prefix sums over a sentence's tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.shared import settled

_BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSES = tuple(np.uint64(pow(int(b), -1, 2**64)) for b in _BASES)
PHRASE = ["width", "a", "b"]
#: Runs that are compared in one bucket, about; and of these that take their next tokens with them, and how many tokens at most.
BUCKET, SORTED, SPAN = 500_000, 200_000, 16
#: Tokens after a place that longer phrases are sorted by, and tokens that are sorted together, about.
REACH, TEXT = 4096, 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _hashes(tokens: pa.ListArray, row: np.ndarray, pos: np.ndarray, width: np.ndarray) -> list[pa.Array]:
    """Two hashes of each run of ``width`` tokens at ``pos`` of a row of ``tokens``, equal for equal runs."""
    offsets = tokens.offsets.to_numpy().astype(np.int64)
    flat = tokens.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
    # powers count from the row's start, so that they stay few
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    inner = np.arange(len(flat)) - np.repeat(offsets[:-1], size)
    most = int(size.max()) if len(size) else 0
    start, out = offsets[row] + pos, []
    for k in (0, 1):
        power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(most, _BASES[k]))])
        back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(most, _INVERSES[k]))])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(flat + np.uint64(k)) * power[inner])])
        out.append(pa.array(_mix((sums[start + width] - sums[start]) * back[pos] + width.astype(np.uint64)).view(np.int64)))
    return out


def numbered_sentences(rows: DataFrame, low: int) -> DataFrame:
    """(sid, book, ord, w, t): sentences of at least ``low`` tokens, each with a number and its tokens' hashes.

    The book is part of these hashes, so that phrases of different books differ and need not carry it. They are made
    where they are used and not kept, as they take several times the room of the tokens.
    """
    rows = rows.where(F.size("w") >= low).select(F.col("book_id").alias("book"), "ord", "w")
    rows = settled(rows.withColumn("sid", F.monotonically_increasing_id()), "repeat-sentences")
    return rows.withColumn("t", F.transform("w", lambda x: F.xxhash64("book", x)))


def _again(sentences: DataFrame, width: int, most: int = BUCKET) -> DataFrame:
    """(sid, pos): runs of one width that occur again and not always after the same token, and at most a few others, by 48 bits of a hash.

    What is always preceded by the same token is no maximal repeat, and so is no longer phrase that begins with it. Only the
    rest need rows of their own. All runs meet in packed arrays, dealt by hash into buckets of about ``most``.
    """
    total = sentences.agg(F.coalesce(F.sum(F.greatest(F.size("w") - width + 1, F.lit(0))), F.lit(0))).first()[0]
    buckets = max(1, -(-total // most))
    first = np.uint64(2**48 - 1)

    def bits(x):
        return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])

    def whole(pieces):
        wide = np.zeros((sum(map(len, pieces)) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, 6)
        return wide.view("<u8").ravel()

    def deal(batches):
        for batch in batches:
            row, pos = _places(batch.column("t"), width)
            if not len(row):
                continue
            h = _hashes(batch.column("t"), row, pos, np.full(len(row), width))[0].to_numpy().view(np.uint64)
            # the beginning of a sentence is a token like none, and differs even from itself
            before = np.where(pos > 0, _mix(_before(batch.column("t"), row, pos).fill_null(0).to_numpy().view(np.uint64)) >> np.uint64(16), first)
            sid = batch.column("sid").to_numpy()[row]
            piece, bucket = sid >> 16, ((h >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int64)
            order = np.lexsort((piece, bucket))
            piece, bucket = piece[order], bucket[order]
            cut = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (bucket[1:] != bucket[:-1])])
            packed = [np.split(x[order], cut[1:]) for x in ((sid & 0xFFFF).astype("<u2"), pos.astype("<i4"), bits(h), bits(before))]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), pa.array(piece[cut]), *[pa.array([x.tobytes() for x in p], pa.binary()) for p in packed]], names=["bucket", "piece", "row", "pos", "h", "before"])

    def meet(table: pa.Table) -> pa.Table:
        packed = {c: table.column(c).to_pylist() for c in ("row", "pos", "h", "before")}
        row, pos = np.frombuffer(b"".join(packed["row"]), "<u2"), np.frombuffer(b"".join(packed["pos"]), "<i4")
        h, before = whole(packed["h"]), whole(packed["before"])
        order = np.argsort(h, kind="stable")
        h, before = h[order], before[order]
        cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        count = np.diff(np.r_[cut, len(h)])
        most = np.maximum.reduceat(before, cut)
        kept = order[np.repeat((count > 1) & ((most == first) | (most != np.minimum.reduceat(before, cut))), count)]
        piece = np.repeat(table.column("piece").to_numpy(), [len(x) // 2 for x in packed["row"]])
        return pa.table({"sid": (piece[kept] << 16) | row[kept], "pos": pos[kept]})

    dealt = sentences.select("sid", "t").mapInArrow(deal, "bucket int, piece long, row binary, pos binary, h binary, before binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "sid long, pos int")


def _places(tokens: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and position of every run of one width."""
    count = np.maximum(np.diff(tokens.offsets.to_numpy().astype(np.int64)) - width + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _before(tokens: pa.ListArray, row: np.ndarray, pos: np.ndarray) -> pa.Array:
    """The token before each place; null where it begins its sentence."""
    starts = tokens.offsets.to_numpy().astype(np.int64)[row] + pos
    return tokens.values.take(pa.array(np.where(pos > 0, starts - 1, 0), mask=pos == 0))


def _all_runs(sentences: DataFrame, width: int) -> DataFrame:
    """Every run of one width: sid, pos, m (tokens of the sentence), before (the token before it, as a hash), width, a, b."""

    def run(batches):
        for batch in batches:
            tokens = batch.column("t")
            size = np.diff(tokens.offsets.to_numpy().astype(np.int64))
            row, pos = _places(tokens, width)
            yield pa.RecordBatch.from_arrays([batch.column("sid").take(pa.array(row)), pa.array(pos, pa.int32()), pa.array(size[row], pa.int32()), _before(tokens, row, pos), pa.array(np.full(len(row), width), pa.int32()), *_hashes(tokens, row, pos, np.full(len(row), width))], names=["sid", "pos", "m", "before", "width", "a", "b"])

    return sentences.select("sid", "t").mapInArrow(run, "sid long, pos int, m int, before long, width int, a long, b long")


def _runs_at(sentences: DataFrame, wanted: DataFrame, width: Column, around: bool = False) -> DataFrame:
    """Rows of ``wanted`` (with sid and pos) with the hashes of their run of ``width``; if ``around``, with the tokens of the sentence as ``m`` and ``before``."""
    asked = wanted.select("sid", F.struct("*", width.cast("int").alias("width")).alias("x")).groupBy("sid").agg(F.collect_list("x").alias("xs"))
    kind = asked.schema["xs"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            xs = batch.column("xs")
            row = np.repeat(np.arange(len(batch)), np.diff(xs.offsets.to_numpy()))
            x = xs.flatten()
            pos, wide = (x.field(n).to_numpy().astype(np.int64) for n in ("pos", "width"))
            size = np.diff(batch.column("t").offsets.to_numpy())[row]
            yield pa.RecordBatch.from_arrays([x, *_hashes(batch.column("t"), row, pos, wide), pa.array(size, pa.int32()), _before(batch.column("t"), row, pos)], names=["x", "a", "b", "m", "before"])

    found = asked.join(sentences.select("sid", "t"), "sid").select("xs", "t").mapInArrow(run, f"x {kind}, a long, b long, m int, before long")
    return found.select("x.*", "a", "b", *(["m", "before"] if around else []))


def _classes(runs: DataFrame, *more: Column) -> DataFrame:
    """Rows of one phrase as one: how often it occurs, where first and last, after which tokens; the first row's place stands for it."""
    return runs.groupBy(*PHRASE).agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("edge").alias("edge"),
        F.min(F.struct("sid", "pos", "m")).alias("at"), *more,
    ).select("*", "at.*").drop("at")


def repeated_phrases(rows: DataFrame, width: int) -> DataFrame:
    """(book_id, phrase, n): phrases of one width that occur more than once in a book, counted without a budget.

    Phrases are counted by hash, and only the first occurrence of a repeated one is spelt out.
    """
    sentences = numbered_sentences(rows, width)
    first = F.min(F.struct("sid", "pos")).alias("f")
    found = _all_runs(sentences, width).groupBy(*PHRASE).agg(F.count(F.lit(1)).alias("n"), first).where("n > 1").select("f.sid", "f.pos", "n")
    spelt = F.array_join(F.slice("w", F.col("pos") + 1, F.lit(width)), " ")
    return found.join(sentences, "sid").select(F.col("book").alias("book_id"), spelt.alias("phrase"), "n")


def _spans(sentences: DataFrame, wanted: DataFrame, low: int, span: int, most: int = SORTED) -> DataFrame:
    """Rows of ``wanted`` (sid, pos) with their sentence's ord and number of tokens ``m``, the token before, and the next ``span`` tokens in ``t``.

    ``bucket`` is the same for equal runs of ``low`` tokens; a bucket has about ``most`` rows.
    """
    buckets = max(1, -(-wanted.count() // most))
    ord_ = sentences.schema["ord"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            tokens, asked = batch.column("t"), batch.column("at")
            row, pos = np.repeat(np.arange(len(batch)), np.diff(asked.offsets.to_numpy())), asked.flatten().to_numpy().astype(np.int64)
            for i in range(0, len(row), 100_000):
                r, p = row[i : i + 100_000], pos[i : i + 100_000]
                offsets = tokens.offsets.to_numpy().astype(np.int64)
                size, at = np.diff(offsets)[r], offsets[r] + p
                inside = np.arange(span) < (size - p)[:, None]
                flat = tokens.values.to_numpy().view(np.uint64)
                next_ = np.where(inside, flat[np.where(inside, at[:, None] + np.arange(span), 0)], np.uint64(0))
                bucket = _hashes(tokens, r, p, np.full(len(r), low))[0].to_numpy().view(np.uint64) % np.uint64(buckets)
                packed = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(np.arange(len(r) + 1, dtype=np.int32) * (8 * span)), pa.py_buffer(np.ascontiguousarray(next_.astype("<u8")))])
                of = lambda name: batch.column(name).take(pa.array(r))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), of("sid"), pa.array(p, pa.int32()), pa.array(size, pa.int32()), of("ord"), _before(tokens, r, p), packed], names=["bucket", "sid", "pos", "m", "ord", "before", "t"])

    asked = wanted.groupBy("sid").agg(F.collect_list("pos").alias("at"))
    found = asked.join(sentences.select("sid", "ord", "t"), "sid").select("sid", "ord", "at", "t")
    return found.mapInArrow(run, f"bucket int, sid long, pos int, m int, ord {ord_}, before long, t binary")


def _shared(spans: DataFrame, low: int, span: int) -> DataFrame:
    """Maximal repeats of fewer than ``span`` tokens (``done``), and the positions of longer ones.

    The former as their first place, width, n, first and last; the latter as their own place, with ``span`` as width and
    the number of places that agree so far as n.
    """
    ord_ = spans.schema["ord"].dataType.simpleString()
    place = f"struct<ord:{ord_},pos:int>"

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ords = table.column("ord").combine_chunks()
        keys = {f"k{i}": x for i, x in enumerate(ords.flatten() if pa.types.is_struct(ords.type) else [ords])} | {"pos": table.column("pos")}
        reading = pc.sort_indices(pa.table(keys), [(k, "ascending") for k in keys]).to_numpy().astype(np.int64)
        rank = np.empty(len(table), np.int64)
        rank[reading] = np.arange(len(table))
        words = np.frombuffer(b"".join(table.column("t").to_pylist()), "<u8").reshape(-1, span)
        pos, m = table.column("pos").to_numpy(), table.column("m").to_numpy()
        before = table.column("before").fill_null(0).to_numpy()
        size = np.minimum(m - pos, span)
        # rows in the order of their tokens, and how many each shares with the one before it
        rows = np.lexsort(tuple(words[:, k] for k in range(span - 1, -1, -1)))
        common = np.zeros(len(rows), np.int64)
        alike, near = np.ones(len(rows) - 1, bool), np.minimum(size[rows[1:]], size[rows[:-1]])
        for k in range(span):
            column = words[rows, k]
            alike &= (column[1:] == column[:-1]) & (k < near)
            common[1:] += alike
        out = []
        for width in range(low, span + 1):
            if not len(rows):
                break
            start = np.flatnonzero(np.r_[True, common[1:] < width])
            n = np.diff(np.r_[start, len(rows)])
            b = before[rows]
            kept = (n > 1) & (np.logical_or.reduceat(pos[rows] == 0, start) | (np.minimum.reduceat(b, start) != np.maximum.reduceat(b, start)))
            if width < span:
                inner = common.copy()
                inner[start] = span
                # a phrase whose places all go on with the same token is part of a longer one
                told = np.flatnonzero(kept & (np.minimum.reduceat(inner, start) == width))
                order = rank[rows]
                first, last = reading[np.minimum.reduceat(order, start)[told]], reading[np.maximum.reduceat(order, start)[told]]
                out.append((first, last, np.full(len(told), width), n[told], np.zeros(len(told), np.int64), np.ones(len(told), bool)))
            mask = np.repeat(kept, n)
            common[start] = 0
            rows, common, n = rows[mask], common[mask], np.repeat(n, n)[mask]
            if width == span:
                key = np.zeros(len(rows), np.uint64)
                for k in range(span):
                    key = _mix(key ^ words[rows, k])
                out.append((rows, rows, np.full(len(rows), span), n, key.view(np.int64), np.zeros(len(rows), bool)))
        first, last, width, n, key, done = (np.concatenate([x[k] for x in out]) for k in range(6))
        of = lambda name, at: table.column(name).take(pa.array(at)).combine_chunks()
        places = [pa.StructArray.from_arrays([of("ord", at), of("pos", at)], names=["ord", "pos"]) for at in (first, last)]
        return pa.table([of("sid", first), of("pos", first), of("m", first), of("before", first), pa.array(width, pa.int32()), pa.array(n), *places, pa.array(key), pa.array(done)], names=["sid", "pos", "m", "before", "width", "n", "first", "last", "key", "done"])

    return spans.groupBy("bucket").applyInArrow(run, f"sid long, pos int, m int, before long, width int, n long, first {place}, last {place}, key long, done boolean")


def _stretches(sentences: DataFrame, wanted: DataFrame, reach: int, most: int = TEXT) -> DataFrame:
    """Stretches of sentences that hold the next ``reach`` tokens of rows of ``wanted`` (sid, pos, m, key); where these overlap, they are one.

    ``bucket`` is the same for equal keys; a bucket has about ``most`` tokens. So a line that is repeated in itself is
    there once, not once for each of its places.
    """
    sizes = wanted.groupBy("sid").agg(F.least(F.max("m"), F.sum(F.least(F.lit(reach), F.col("m") - F.col("pos")))).alias("n"))
    buckets = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // most))
    ord_ = sentences.schema["ord"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            tokens, asked = batch.column("t"), batch.column("at")
            starts, cuts, flat = tokens.offsets.to_numpy(), asked.offsets.to_numpy(), tokens.values.to_numpy()
            x = asked.values
            all_pos, all_bucket = x.field("pos").to_numpy().astype(np.int64), (x.field("key").to_numpy().view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            out, size = {n: [] for n in ("bucket", "row", "at", "pos", "before", "t")}, 0

            def told():
                row = pa.array(out["row"], pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), batch.column("sid").take(row), batch.column("ord").take(row), pa.array(np.diff(starts)[out["row"]], pa.int32()), pa.array(out["at"], pa.int32()), pa.array(out["pos"], pa.list_(pa.int32())), pa.array(out["before"], pa.list_(pa.int64())), pa.array(out["t"], pa.list_(pa.int64()))], names=["bucket", "sid", "ord", "m", "at", "pos", "before", "t"])  # noqa: B023

            for i in range(len(batch)):
                words, pos, bucket = flat[starts[i] : starts[i + 1]], all_pos[cuts[i] : cuts[i + 1]], all_bucket[cuts[i] : cuts[i + 1]]
                order = np.lexsort((pos, bucket))
                pos, bucket = pos[order], bucket[order]
                cut = np.flatnonzero((bucket[1:] != bucket[:-1]) | (pos[1:] - pos[:-1] >= reach)) + 1
                for p, b in zip(np.split(pos, cut), bucket[np.r_[0, cut]]):
                    text = words[p[0] : p[-1] + reach]
                    for name, value in (("bucket", b), ("row", i), ("at", p[0]), ("pos", p), ("before", np.where(p > 0, words[p - 1], 0)), ("t", text)):
                        out[name].append(value)
                    size += len(text) + 2 * len(p)
                if size > 1 << 20:
                    yield told()
                    out, size = {n: [] for n in out}, 0
            if out["row"]:
                yield told()

    asked = wanted.groupBy("sid").agg(F.collect_list(F.struct("pos", "key")).alias("at"))
    found = asked.join(sentences.select("sid", "ord", "t"), "sid").select("sid", "ord", "at", "t")
    return found.mapInArrow(run, f"bucket int, sid long, ord {ord_}, m int, at int, pos array<int>, before array<long>, t array<long>")


def _doubled(words: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of the runs of 1, 2, 4, ... words at each place (a last one for beyond the end); equal for equal runs, where those that meet their ``end`` are shorter."""
    n = len(words)
    rank = np.append(np.unique(words, return_inverse=True)[1] + 1, 0)
    out, step, most = [rank], 1, int((end - np.arange(n)).max(initial=0))
    while step < most:
        after = np.arange(n) + step
        rank = np.append(np.unique(rank[:n] * (n + 1) + rank[np.where(after < end, after, n)], return_inverse=True)[1] + 1, 0)
        out.append(rank)
        step *= 2
    return out


def _nodes(common: list[int]) -> list[tuple[int, int, int]]:
    """(depth, from, to) of every group of neighbours that share more than with those around it; ``common[i]`` is what the i-th shares with the one before."""
    out, open_ = [], [(0, 0)]
    for i, depth in enumerate([*common[1:], 0], 1):
        start = i - 1
        while open_[-1][0] > depth:
            held, start = open_.pop()
            out.append((held, start, i))
        if open_[-1][0] < depth:
            open_.append((depth, start))
    return out


def _longer(stretches: DataFrame, low: int) -> DataFrame:
    """Maximal repeats of at least ``low`` tokens of all places of ``stretches`` (``done``), and places where these end too soon to tell, as ``_shared`` has them."""
    ord_ = stretches.schema["ord"].dataType.simpleString()
    place = f"struct<ord:{ord_},pos:int>"

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        t, at = table.column("t").combine_chunks(), table.column("pos").combine_chunks()
        size, many = np.diff(t.offsets.to_numpy()), np.diff(at.offsets.to_numpy())
        stop = np.cumsum(size)
        of = np.repeat(np.arange(len(table)), many)
        pos, before, m = at.flatten().to_numpy().astype(np.int64), table.column("before").combine_chunks().flatten().to_numpy(), table.column("m").to_numpy()[of]
        where = (stop - size)[of] + pos - table.column("at").to_numpy()[of]
        ranks = _doubled(t.flatten().to_numpy(), np.repeat(stop, size))
        length = stop[of] - where
        more = pos + length < m
        rows = np.argsort(ranks[-1][where], kind="stable")
        a, b = rows[:-1], rows[1:]
        shared = np.zeros(len(a), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            x, y = (np.where(shared < length[r], where[r] + shared, stop[-1]) for r in (a, b))
            shared += (ranks[k][x] == ranks[k][y]) * (1 << k)
        shared = np.minimum(shared, np.minimum(length[a], length[b]))
        # the order of reading, for the first and last place of a phrase
        ords = table.column("ord").combine_chunks()
        keys = {f"k{i}": x.take(pa.array(of)) for i, x in enumerate(ords.flatten() if pa.types.is_struct(ords.type) else [ords])} | {"pos": pa.array(pos)}
        reading = pc.sort_indices(pa.table(keys), [(k, "ascending") for k in keys]).to_numpy().astype(np.int64)
        rank = np.empty(len(pos), np.int64)
        rank[reading] = np.arange(len(pos))
        groups = [x for x in _nodes([0, *shared.tolist()]) if x[0] >= low]
        depth, start, end = (np.array([x[k] for x in groups], np.int64) for k in range(3))
        span = np.column_stack([start, end]).ravel()
        ends = lambda f, x: f.reduceat(np.append(x[rows], x[rows[-1:]]), span)[::2] if len(span) else x[:0]
        diverse = ends(np.maximum, (pos == 0).astype(np.int8)).astype(bool) | (ends(np.minimum, before) != ends(np.maximum, before))
        # a phrase that reaches the end of a stretch that is cut goes on as a whole, with all that begin with it
        # (no place shares more than its length, so one that is cut at a group's depth is as long as that)
        reached = np.flatnonzero(ends(np.maximum, np.where(more, length, 0)) >= depth)
        cut = np.array([i for i in reached if (more & (length == depth[i]))[rows[start[i] : end[i]]].any()], np.int64)
        cut = cut[np.lexsort((depth[cut], start[cut]))]
        inside, told = np.zeros(len(groups), bool), []
        covered = -1
        for i in cut:
            if start[i] >= covered:
                covered = end[i]
                inside |= (start >= start[i]) & (end <= end[i]) & (depth >= depth[i])
                if diverse[i]:
                    told.append(i)
        done = np.flatnonzero(diverse & ~inside)
        first, last = reading[ends(np.minimum, rank)[done]], reading[ends(np.maximum, rank)[done]]
        left = np.concatenate([rows[start[i] : end[i]] for i in told]) if told else np.zeros(0, np.int64)
        size = (end - start)[told] if told else np.zeros(0, np.int64)
        width, n = np.r_[depth[done], np.repeat(depth[told] if told else size, size)], np.r_[(end - start)[done], np.repeat(size, size)]
        first, last, here = np.r_[first, left], np.r_[last, left], np.r_[first, left]
        before = pa.array(before[here], mask=pos[here] == 0)
        places = [pa.StructArray.from_arrays([ords.take(pa.array(of[x])), pa.array(pos[x], pa.int32())], names=["ord", "pos"]) for x in (first, last)]
        return pa.table([table.column("sid").take(pa.array(of[here])).combine_chunks(), pa.array(pos[here], pa.int32()), pa.array(m[here], pa.int32()), before, pa.array(width, pa.int32()), pa.array(n), *places, pa.array(np.arange(len(n)) < len(done))], names=["sid", "pos", "m", "before", "width", "n", "first", "last", "done"])

    return stretches.groupBy("bucket").applyInArrow(run, f"sid long, pos int, m int, before long, width int, n long, first {place}, last {place}, done boolean")


def maximal_repeats(rows: DataFrame, low: int = 3, span: int = SPAN, reach: int = REACH) -> DataFrame:
    """Maximal repeats of at least ``low`` tokens: book_id, width, n (occurrences), first and last (ord, pos), phrase.

    ``rows`` has book_id, ord and tokens ``w`` of every sentence, ``ord`` in reading order and different for each
    sentence of a book. Occurrences within one sentence count, overlapping ones too. No rows give no rows. ``span`` and
    ``reach`` only say which step finds a phrase.
    """
    if low < 1:
        raise ValueError("the least width must be at least 1")
    sentences = numbered_sentences(rows, low)
    span = max(span, low)
    reach = max(reach, span)
    again = settled(_again(sentences, low), "repeat-places")
    shared = settled(_shared(_spans(sentences, again, low, span), low, span), "repeat-shared")
    short = shared.where("done").select("sid", "pos", "width", "n", "first", "last")
    every, start = sentences, shared.where("not done")
    sentences = settled(sentences.drop("t").join(start.select("sid").distinct(), "sid", "left_semi"), "repeat-long").withColumn("t", F.transform("w", lambda x: F.xxhash64("book", x)))
    longer = settled(_longer(_stretches(sentences, start, reach), span), "repeat-longer")
    short = short.unionByName(longer.where("done").select(*short.columns))
    start = longer.where("not done").select(
        "sid", "pos", "m", F.col("width").alias("lo"), F.col("n").alias("clo"), F.lit(1).cast("long").alias("n"), "first", "last",
        F.col("before").alias("low"), F.col("before").alias("high"), F.col("before").isNull().alias("edge"),
        # level k: the least power of two beyond what is left of the sentence
        F.greatest(F.ceil(F.log2(F.col("m") - F.col("pos") - F.col("width") + F.lit(1))), F.lit(0)).cast("int").alias("level"),
    )
    diverse = F.col("edge") | (F.col("low") != F.col("high"))
    state = [c for c in start.columns if c != "level"]
    levels, carried = {r[0] for r in start.select("level").distinct().collect()}, None
    for k in range(max(levels, default=0), 0, -1):
        if k not in levels and carried is None:
            continue
        # a row stands for the positions that agree up to lo + 2**k, or for one position where these are not repeated
        here = start.where(F.col("level") == k).drop("level")
        here = here.unionByName(carried) if carried is not None else here
        half = F.col("lo") + (1 << (k - 1))
        exists = F.col("pos") + half <= F.col("m")
        runs = settled(_runs_at(sentences, here.where(exists), half), f"repeat-runs-{k}")
        classes = _classes(runs, F.min("lo").alias("lo"), F.min("clo").alias("clo"))
        counts = classes.where((F.col("n") > 1) & diverse).select(*PHRASE, F.col("n").alias("c"))
        above = runs.join(counts, PHRASE).where("n <> c").withColumns({"lo": F.col("width"), "clo": F.col("c")})
        below = classes.where("n <> clo").select(*state).unionByName(here.where(~exists).select(*state))
        carried = settled(above.select(*state).unionByName(below), f"repeat-level-{k}")
    ends = start.where("level = 0").drop("level")
    ends = ends.unionByName(carried) if carried is not None else ends
    found = short
    if levels:
        found = found.unionByName(_classes(_runs_at(sentences, ends, F.col("lo"))).where(diverse).select(*short.columns))
    spelt = F.array_join(F.slice("w", F.col("pos") + 1, F.col("width")), " ")
    return found.join(every.select("sid", "book", "w"), "sid").select(F.col("book").alias("book_id"), "width", "n", "first", "last", spelt.alias("phrase"))
