"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counting works on packed arrays. Every task hashes the words of pieces of about 2.5 MB of texts and sends, for each bucket
of the hash space, a piece's distinct words with their training counts, and likewise its distinct training bigrams. Which
document has which word stays with the piece. A bucket's reducer sums the counts and keeps the n-grams frequent enough
for the model; the counts of a piece's words go back to it, and there its documents' unigram scores are added up. A word
of all documents thus costs its bucket 12 bytes a piece, and beyond ``PIECES`` pieces a bucket is summed, and answers, in salts.

The filter stores an n-gram of count c under the levels 1 .. 1 + floor(log_b(c / c_min)); a count is read back by
probing level after level until one is absent. Kept are all n-grams that occur ``LEAST`` times or more, at every corpus
size, in a segment of its own for each bucket, so the filter grows with the corpus. Its size is checked: within
``BROADCAST`` bytes it is broadcast to the workers; beyond, the texts' distinct n-grams are shuffled to the segments of
their buckets and the counts read there go back to the texts. Both ways probe the same bits and give the same scores.

p(w | v) = L min(1, c(vw) / c(v)) + (1 - L) p(w); p(w) is c(w) / N for kept words, and the rest of the mass is shared
equally by the words that are not kept and one for all unseen. Words are told apart by 64-bit hashes, bigrams by 40
bits within a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from quillscan.llm._bytes import flat, lean, lean_cogroups, lean_groups, mix, pieces, prefix, span, words
from quillscan.llm._store import crc_part, documents, written

LEAST, LEVEL_BASE, PROBES, BITS, BIGRAM_SHARE = 2, 1.5, 7, 10, 0.15
#: Most bytes of a filter that is broadcast, and bytes of text for each bucket of words (there are four times as many of bigrams).
BROADCAST, BUCKET_TEXT = 128 << 20, 32 << 20
#: Most pieces of texts that one group of a bucket hears from.
PIECES = 1 << 16
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PAIR, _GOLD = np.uint64(0xD1342543DE82EF95), np.uint64(0x9E3779B97F4A7C15)


def token_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashes) of the tokens: words of each row (A-Z lower-cased), then one end."""
    n = len(offsets) - 1
    starts, ends, row = words(raw, offsets)
    size = np.bincount(row, minlength=n)
    out = np.empty(len(row) + n, np.uint64)
    at = np.arange(len(row)) + row
    out[at] = span(prefix(raw, fold=True), starts, ends)
    out[np.cumsum(size) + np.arange(n)] = _END
    return np.repeat(np.arange(n), size + 1), out


def bigrams(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token with the one before it (a start mark for the first), and of that context."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.r_[True, row[1:] != row[:-1]]] = _START
    return mix(before * _PAIR + h), before


def _five(x: np.ndarray, shift: int) -> bytes:
    x = (x << np.uint64(shift)) >> np.uint64(24)
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unfive(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _cuts(h: np.ndarray, bits: int) -> np.ndarray:
    """Where the buckets of ascending hashes begin, and their end."""
    return np.r_[0, np.searchsorted(h, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(h)]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    return from_arrow_schema(schema).simpleString()[7:-1].replace(":", " ").replace(",", ", ")


_ASKED = pa.schema([("piece", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("hashes", "counts", "doc", "times"))])


def _words(bits: int):
    """Task side of the words' count, for every piece of texts.

    A row for each bucket has the piece's distinct words of it and their training counts. One more, of bucket -1, has the
    keys of its documents and, for its words in ascending order, the number of documents with the word, which, and how often.
    """

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw, offsets = flat(batch.column(3))
            keys = np.stack([batch.column(k).to_numpy() for k in (0, 1)], 1) if len(batch) else np.zeros((0, 2), np.int64)
            train = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in pieces(offsets, 2_500_000, 30_000):
                row, h = token_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                uniq, code = np.unique(h, return_inverse=True)
                counts = np.bincount(code, weights=train[a:b][row], minlength=len(uniq)).astype("<u4")
                pair, times = np.unique(code * (b - a) + row, return_counts=True)
                word, doc = np.divmod(pair, b - a)
                held = np.bincount(word, minlength=len(uniq)).astype("<u4")
                times = times.astype(np.uint8 if times.max() < 256 else "<u4")
                piece = (part << 36) + n
                out = [(piece, -1, keys[a:b].astype("<i8").tobytes(), held.tobytes(), doc.astype("<u2").tobytes(), times.tobytes())]
                cut = _cuts(uniq, bits)
                out += [(piece, k, uniq[cut[k] : cut[k + 1]].astype("<u8").tobytes(), counts[cut[k] : cut[k + 1]].tobytes(), b"", b"") for k in np.flatnonzero(np.diff(cut)).tolist()]
                yield from _table(out, _ASKED).to_batches()
                n += 1

    return run


_PAIRS = pa.schema([("bucket", pa.int32()), ("salt", pa.int32()), *((c, pa.binary()) for c in ("once", "more", "times"))])


def _pairs(bits: int, salts: int):
    """Task side of the bigrams' count: for every piece of training texts and bucket, the bigrams met once, those met more often and how often."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw, offsets = flat(batch.column(0))
            for a, b in pieces(offsets, 2_500_000, 30_000):
                row, h = token_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                grams, often = np.unique(bigrams(row, h)[0], return_counts=True)
                cut, out = _cuts(grams, bits), []
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    some, times = grams[cut[k] : cut[k + 1]], often[cut[k] : cut[k + 1]]
                    out.append((k, (part + n) % salts, _five(some[times == 1], bits), _five(some[times > 1], bits), times[times > 1].astype("<i8").tobytes()))
                yield from _table(out, _PAIRS).to_batches()
                n += 1

    return run


def _summed(h: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, n = np.concatenate(h), np.concatenate(n)
    order = np.argsort(h)
    h = h[order]
    begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[begin], np.add.reduceat(n[order].astype(np.int64), begin) if len(h) else np.zeros(0, np.int64)


def _arrays(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) if len(x.as_buffer()) else np.zeros(0, kind) for x in table.column(name)]


_COUNTED = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _word_sums(kind: str):
    """Corpus-wide training counts of a bucket's words, from counts of type ``kind``."""

    def run(table: pa.Table) -> pa.Table:
        h, c = _summed(_arrays(table, "hashes", "<u8"), _arrays(table, "counts", kind))
        return _table([(table.column("bucket")[0].as_py(), h.tobytes(), c.astype("<i8").tobytes())], _COUNTED)

    return run


def _pair_sums(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    once, more = ([_unfive(x) for x in _arrays(table, c, np.uint8)] for c in ("once", "more"))
    return table.column("bucket")[0].as_py(), *_summed(once + more, [np.ones(len(x), np.int64) for x in once] + _arrays(table, "times", "<i8"))


def _pair_partial(table: pa.Table) -> pa.Table:
    """Counts of a bucket's bigrams over the pieces of one salt."""
    bucket, h, c = _pair_sums(table)
    return _table([(bucket, 0, _five(h[c == 1], 24), _five(h[c > 1], 24), c[c > 1].tobytes())], _PAIRS)


_FILLED = pa.schema([("kind", pa.string()), ("place", pa.int32()), ("data", pa.binary())])


def _pair_filled(table: pa.Table) -> pa.Table:
    bucket, h, c = _pair_sums(table)
    return _table([("pair", bucket, segment(h, c))], _FILLED)


def _replied(asked: pa.Table, counted: pa.Table) -> pa.Table:
    """Bucket side of the way back: corpus-wide counts of the words that each piece has."""
    h, c = (np.concatenate(_arrays(counted, n, kind)) for n, kind in (("hashes", "<u8"), ("counts", "<i8")))
    back = [c[np.searchsorted(h, x)].tobytes() for x in _arrays(asked, "hashes", "<u8")]
    return pa.table([asked.column("piece"), asked.column("bucket"), pa.array(back, pa.binary())], names=["piece", "bucket", "counts"])


def _known(piece: pa.Table, counts: pa.Table) -> pa.Table:
    """Each document's sum of log10(c + 0.1) over its tokens, and its tokens with c > 0, from the counts sent to its piece."""
    count = np.concatenate(_arrays(counts.sort_by("bucket"), "counts", "<i8"))
    keys, held, doc = (_arrays(piece, n, kind)[0] for n, kind in (("hashes", "<i8"), ("counts", "<u4"), ("doc", "<u2")))
    times = _arrays(piece, "times", np.uint8)[0]
    if len(times) != len(doc):
        times = times.view("<u4")
    keys, word = keys.reshape(-1, 2), np.repeat(np.arange(len(held)), held)
    gain, known = (np.bincount(doc, weights=x[word] * times, minlength=len(keys)) for x in (np.log10(count + 0.1), count > 0))
    return pa.table({"key": keys[:, 0], "other": keys[:, 1], "gain": gain, "n_known": known.astype(np.int64)})


def _slots(h: np.ndarray, level: int, bits: int):
    """Successive probe positions of (n-gram, level) in a segment of so many bits."""
    x = mix(h + np.uint64(0x9E3779B97F4A7C15 * level % 2**64))
    step = mix(x ^ _PAIR) | np.uint64(1)
    for _ in range(PROBES):
        yield ((x >> np.uint64(16)) % np.uint64(bits)).astype(np.int64)
        x = x + step


def segment(h: np.ndarray, c: np.ndarray) -> bytes:
    """Bloom filter of one bucket's n-grams with ``LEAST`` occurrences or more."""
    h, c = h[c >= LEAST], c[c >= LEAST]
    top = 1 + np.floor(np.log(c / LEAST) / np.log(LEVEL_BASE) + 1e-9).astype(np.int64)
    bits = max(64, BITS * int(top.sum())) // 8 * 8
    on = np.zeros(bits, bool)
    level = 1
    while len(h):
        for slot in _slots(h, level, bits):
            on[slot] = True
        h, top, level = h[top > level], top[top > level], level + 1
    return np.packbits(on).tobytes()


class Filter:
    """A filter as workers see it: the segments of all buckets in one array, with where each starts."""

    def __init__(self, segments: list[bytes]):
        self.data = b"".join(segments)
        self.sizes = np.array([len(s) for s in segments], np.int64)

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Stored counts of hashed n-grams (middle of the level's range), 0 for those not stored."""
        bits = int(len(self.sizes) - 1).bit_length()
        return self.counts_in((h >> np.uint64(64 - bits)).astype(np.int64), (h << np.uint64(bits)) >> np.uint64(24))

    def counts_in(self, bucket: np.ndarray, name: np.ndarray) -> np.ndarray:
        """The same for the 40-bit names of n-grams within their buckets."""
        start = 8 * (np.cumsum(self.sizes) - self.sizes)[bucket]
        size = (8 * self.sizes)[bucket].astype(np.uint64)
        out = np.zeros(len(name), np.int64)
        live, level = np.arange(len(name)), 1
        while len(live):
            live = self._present(name[live], start[live], size[live], live, level)
            out[live] = level
            level += 1
        return np.where(out > 0, LEAST * LEVEL_BASE ** (out - 0.5), 0.0)

    def _present(self, name, start, size, live, level) -> np.ndarray:
        """Those of ``live`` whose (n-gram, level) is in the filter."""
        bits = np.frombuffer(self.data, np.uint8)
        x = mix(name + np.uint64(0x9E3779B97F4A7C15 * level % 2**64))
        step = mix(x ^ _PAIR) | np.uint64(1)
        for _ in range(PROBES):
            slot = start + ((x >> np.uint64(16)) % size).astype(np.int64)
            hit = (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0
            live, x, step, start, size = live[hit], (x + step)[hit], step[hit], start[hit], size[hit]
        return live


class Read:
    """Counts already read from a filter, in the ascending order of the n-grams' hashes."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def counts(self, h: np.ndarray) -> np.ndarray:
        return self.values


class Model:
    """Smoothed bigram probabilities over the counts of words and of bigrams."""

    def __init__(self, words: Filter, pairs: Filter, tokens: int, rare_mass: float, rare_types: int):
        self.words, self.pairs, self.tokens = words, pairs, tokens
        self.rare = max(rare_mass, 0.5) / max(tokens, 1) / (rare_types + 1)

    def score(self, row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        """log10 probability of each of ``n`` rows' tokens."""
        uniq, code = np.unique(h, return_inverse=True)
        c1 = self.words.counts(uniq)
        p1 = np.where(c1 > 0, np.minimum(c1 / max(self.tokens, 1), 0.999), self.rare)
        pair, before = bigrams(row, h)
        pairs, where = np.unique(pair, return_inverse=True)
        c2 = self.pairs.counts(pairs)[where]
        first = np.r_[True, row[1:] != row[:-1]]
        context = np.zeros(len(h))
        context[1:] = c1[code][:-1]
        end = c1[np.searchsorted(uniq, _END)]
        context[first] = end
        share = np.minimum(1.0, c2 / np.maximum(context, np.maximum(c2, 1.0)))
        return np.bincount(row, weights=np.log10(BIGRAM_SHARE * share + (1 - BIGRAM_SHARE) * p1[code]), minlength=n)


def _asked(word_bits: int, pair_bits: int):
    """Task side of a filter that is not broadcast: a piece's distinct n-grams, by bucket."""

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                piece, texts = batch.column(0)[k].as_py(), batch.column(1)[k].values
                row, h = token_hashes(*flat(texts))
                out = []
                for kind, grams, bits in (("word", np.unique(h), word_bits), ("pair", np.unique(bigrams(row, h)[0]), pair_bits)):
                    cut = np.r_[0, np.searchsorted(grams, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(grams)]
                    out += [(piece, kind, j, _five(grams[cut[j] : cut[j + 1]], bits)) for j in np.flatnonzero(np.diff(cut)).tolist()]
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], names=["piece", "kind", "place", "names"])

    return run


def _probed(asked: pa.Table, segments: pa.Table) -> pa.Table:
    """Bucket side: the counts of the n-grams that each piece asks for."""
    names = [_unfive(x) for x in asked.column("names").to_pylist()]
    filter_ = Filter(segments.column("data").to_pylist() or [segment(np.zeros(0, "<u8"), np.zeros(0, "<i8"))])
    ends = np.cumsum([len(n) for n in names])
    flat_ = np.concatenate(names) if names else np.zeros(0, "<u8")
    read = filter_.counts_in(np.zeros(len(flat_), np.int64), flat_).astype("<f8")
    values = [x.tobytes() for x in np.split(read, ends[:-1])] if names else []
    return pa.table([asked.column("piece"), asked.column("kind"), asked.column("place"), pa.array(values, pa.binary())], names=["piece", "kind", "place", "counts"])


def _judged_apart(rows: DataFrame, filled: DataFrame, model: tuple, word_bits: int, pair_bits: int) -> DataFrame:
    """Scores with the filter left where it is: n-grams go to its segments and counts come back."""

    def cut(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            offsets = flat(batch.column(2))[1]
            for a, b in pieces(offsets, 2_500_000):
                lists = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(c).slice(a, b - a)) for c in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array([(part << 36) + n]), *lists], names=["piece", "keys", "others", "texts", "ids"])
                n += 1

    kind = rows.schema["id"].dataType.simpleString()
    cuts = written(rows.select("key", "other", "text", "id").mapInArrow(lean(cut), f"piece long, keys array<long>, others array<long>, texts array<string>, ids array<{kind}>"), "lm-pieces")
    asked = cuts.select("piece", "texts").mapInArrow(lean(_asked(word_bits, pair_bits)), "piece long, kind string, place int, names binary")
    read = asked.groupBy("kind", "place").cogroup(filled.select("kind", "place", "data").groupBy("kind", "place")).applyInArrow(_probed, "piece long, kind string, place int, counts binary")

    def judge(piece: pa.Table, counts: pa.Table) -> pa.Table:
        counts = counts.sort_by([("kind", "ascending"), ("place", "ascending")])
        of = lambda kind: Read(np.concatenate([np.frombuffer(x, "<f8") for k, x in zip(counts.column("kind").to_pylist(), counts.column("counts").to_pylist()) if k == kind]))
        keys, others, texts, ids = (piece.column(c).combine_chunks().values for c in ("keys", "others", "texts", "ids"))
        row, h = token_hashes(*flat(texts))
        return pa.table({"key": keys, "other": others, "doc_id": ids, "n_tokens": pa.array(np.bincount(row, minlength=len(keys))), "score": pa.array(Model(of("word"), of("pair"), *model).score(row, h, len(keys)))})

    return cuts.groupBy("piece").cogroup(read.groupBy("piece")).applyInArrow(judge, f"key long, other long, doc_id {kind}, n_tokens long, score double")


def scores(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST, pieces_a_group: int = PIECES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; ``train`` is the Column of rows to learn from.

    Null text is empty, its only token being the end. Rows that repeat id and text count each on their own and get
    equal scores. Without training rows the base score gives every token the same smoothed share and the model has no
    n-grams; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text, id_ = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{id_col}`")
    rows = docs.select(F.xxhash64(id_, text).alias("key"), F.xxhash64(text, id_).alias("other"), F.coalesce(train, F.lit(False)).alias("train"), text.alias("text"), id_.alias("id"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_bits = max(3, int(np.ceil(np.log2(max(size, 1) / BUCKET_TEXT))))
    pair_bits = word_bits + 2
    asked = written(rows.select("key", "other", "train", "text").mapInArrow(lean(_words(word_bits)), _ddl(_ASKED)), "lm-words")
    salts = -(-asked.where("bucket < 0").count() // pieces_a_group) or 1
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("piece"), F.lit(salts)).cast("int"))
    words, pairs = asked.where("bucket >= 0"), rows.where("train").select("text").mapInArrow(lean(_pairs(pair_bits, salts)), _ddl(_PAIRS))
    counted = words.groupBy("bucket", "salt").applyInArrow(lean_groups(_word_sums("<u4")), _ddl(_COUNTED))
    if salts > 1:
        counted = counted.groupBy("bucket").applyInArrow(lean_groups(_word_sums("<i8")), _ddl(_COUNTED))
        pairs = pairs.groupBy("bucket", "salt").applyInArrow(lean_groups(_pair_partial), _ddl(_PAIRS))
    counted = written(counted, "lm-counts")

    def fill(batches):
        for batch in batches:
            for bucket, h, c in zip(*(batch.column(k) for k in range(3))):
                h, c = np.frombuffer(h.as_buffer(), "<u8"), np.frombuffer(c.as_buffer(), "<i8")
                often = c[c >= LEAST]
                row = {"kind": ["word"], "place": [bucket.as_py()], "data": [segment(_unfive(_five(h, word_bits)), c)], "mass": [int(often.sum())], "kept": [len(often)], "n": [int(c.sum())], "v": [int((c > 0).sum())]}
                yield pa.RecordBatch.from_arrays([pa.array(row["kind"]), pa.array(row["place"], pa.int32()), pa.array(row["data"], pa.binary()), *(pa.array(row[x], pa.int64()) for x in ("mass", "kept", "n", "v"))], names=list(row))

    of_words = counted.mapInArrow(lean(fill), _ddl(_FILLED) + ", mass long, kept long, n long, v long")
    of_pairs = pairs.groupBy("bucket").applyInArrow(lean_groups(_pair_filled), _ddl(_FILLED))
    filled = written(of_words.unionByName(of_pairs, allowMissingColumns=True), "lm-filter")
    sums = [F.coalesce(F.sum(x), F.lit(0)) for x in ("n", "v", "mass", "kept", F.length("data"))]
    tokens, types, mass, kept, bytes_ = filled.agg(*sums).first()
    rare = tokens, tokens - mass, types - kept
    if bytes_ <= broadcast_bytes:
        found = {(r["kind"], r["place"]): bytes(r["data"]) for r in filled.select("kind", "place", "data").collect()}
        empty = segment(np.zeros(0, "<u8"), np.zeros(0, "<i8"))
        shared = spark.sparkContext.broadcast(Model(*(Filter([found.get((kind, k), empty) for k in range(1 << bits)]) for kind, bits in (("word", word_bits), ("pair", pair_bits))), *rare))
        del found

        def judge(batches):
            for batch in batches:
                raw, offsets = flat(batch.column(2))
                for a, b in pieces(offsets, 1_500_000):
                    row, h = token_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (0, 1, 3)), pa.array(np.bincount(row, minlength=b - a)), pa.array(shared.value.score(row, h, b - a))], names=["key", "other", "doc_id", "n_tokens", "score"])

        judged = rows.select("key", "other", "text", "id").mapInArrow(lean(judge), f"key long, other long, doc_id {rows.schema['id'].dataType.simpleString()}, n_tokens long, score double")
    else:
        judged = _judged_apart(rows, filled, rare, word_bits, pair_bits)
    answers = counted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    replies = words.groupBy("bucket", "salt").cogroup(answers.groupBy("bucket", "salt")).applyInArrow(lean_cogroups(_replied), "piece long, bucket int, counts binary")
    base = asked.where("bucket < 0").groupBy("piece").cogroup(replies.groupBy("piece")).applyInArrow(lean_cogroups(_known), "key long, other long, gain double, n_known long")
    base = base.groupBy("key", "other").agg(F.first("gain").alias("gain"), F.first("n_known").alias("n_known"))
    floor = float(np.log10(tokens + 0.1 * (types + 1)))
    return judged.join(base, ["key", "other"]).select("doc_id", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("gain") - F.col("n_tokens") * floor).alias("base_score"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_part("doc_id", 10) == 0
    return scores(documents(spark, sf_dir), ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
