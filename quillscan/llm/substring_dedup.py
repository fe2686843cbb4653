"""Removal of long repeated passages with suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere, in any document, is removed.

*Routing.* Of all ``GRAM``-byte strings inside a window of ``LENGTH`` bytes the one of least hash names the window;
equal windows have equal names wherever they stand. Consecutive windows of one name form a *context*. Contexts that
are equal as a whole are repeats and counted once; only names with several different contexts, or whose string occurs
twice in one, go on, dealt by name into blocks.

*Search.* In a block, contexts are cut into phrases where a hash of the ``CUT`` bytes before is a multiple of
``PHRASE``, so equal passages get equal phrases. A suffix array over the phrases, by linear grouping construction,
brings suffixes with the same passage together; runs of neighbours that share the whole phrases within ``SHARED`` bytes,
those of equal phrases taken together, are the candidates, and windows are compared within them by 64-bit
hashes of all their bytes. Windows with too few phrase ends for that, or no whole phrase there, are compared directly.

*Hot names.* Of a name with more than ``HOT`` different contexts the windows are dealt by their own hash instead, in
packed arrays, so no name's contexts have to meet in one task.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.llm._bytes import flat, lean, lean_groups, mix, pieces, prefix, span
from quillscan.llm._gsaca import suffix_array
from quillscan.llm._store import documents, written

LENGTH, GRAM, CUT, PHRASE, SHARED, HOT, BLOCK_BYTES = 400, 128, 8, 16, 256, 20_000, 1_000_000
_POSITION_BITS = np.uint64(28)


def contexts(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Contexts of some rows: row, first window (byte in the row), windows, name, hash of all its bytes, recurring."""
    n, w = len(raw), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    sums = prefix(raw)
    at = np.arange(n - gram + 1)
    h = span(sums, at, at + gram)
    x = np.full(-(-len(h) // w) * w, np.uint64(2**64 - 1))
    x[: len(h)] = (h >> _POSITION_BITS << _POSITION_BITS) | at.astype(np.uint64)
    x = x.reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).reshape(-1)[w - 1 : len(h)]
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)[: len(h) - w + 1]
    least = (np.minimum(ahead, back) & np.uint64((1 << 28) - 1)).astype(np.int64)
    name = h[least]
    window = np.arange(len(name))
    row = np.searchsorted(offsets, window, "right") - 1
    inside = window + length <= offsets[row + 1]
    change = np.r_[True, (name[1:] != name[:-1]) | (row[1:] != row[:-1])]
    first = np.flatnonzero(inside & (change | np.r_[True, ~inside[:-1]]))
    last = np.flatnonzero(inside & np.r_[change[1:] | ~inside[1:], True]) + 1
    moves = np.r_[0, np.cumsum(least[1:] != least[:-1])]
    return row[first], first - offsets[row[first]], last - first, name[first], span(sums, first, last - 1 + length), moves[last - 1] > moves[first]


def repeats_in(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of a block's contexts, whether the window that starts at each of its bytes also starts elsewhere in the block."""
    size = np.array([len(t) for t in texts])
    offsets = np.r_[0, np.cumsum(size)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    total = len(raw)
    sums = prefix(raw)
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(total)
    starts = at[at + length <= offsets[owner + 1]]
    hashes = span(sums, starts, starts + length)
    # phrase ends: after CUT bytes inside the context whose hash is a multiple of PHRASE
    ends = np.arange(CUT, total + 1)
    marked = ends[span(sums, ends - CUT, ends) % np.uint64(PHRASE) == 0]
    marked = marked[(marked < total)]
    marked = marked[marked - CUT >= offsets[owner[np.minimum(marked, total - 1)]]]
    # a window is held by its first phrase end that its own bytes decide
    k = np.searchsorted(marked, starts + CUT)
    held = np.append(marked, total)[k]
    usable = held + SHARED <= starts + length
    family = np.full(len(marked) + 1, -1, np.int64)
    if len(marked):
        own = owner[marked]
        to = np.where(np.r_[own[1:] == own[:-1], False], np.r_[marked[1:], total], offsets[own + 1])
        phrase = span(sums, marked, to)
        _, code = np.unique(phrase, return_inverse=True)
        closing = np.r_[own[1:] != own[:-1], True]
        # the last phrase of a context is cut short by its end: make it differ from every other
        code = code + len(marked)
        code[closing] = np.arange(closing.sum())
        array = np.array(suffix_array(code.tolist()))
        here, there = marked[array[:-1]], marked[array[1:]]
        fits = (here + SHARED <= offsets[owner[here] + 1]) & (there + SHARED <= offsets[owner[there] + 1])
        alike = np.zeros(len(here), bool)
        # whole phrases within SHARED bytes, all of whose ends a window held here has before its last byte
        reach = np.searchsorted(marked, marked + SHARED) - 1
        reach = marked[np.maximum(reach, np.arange(len(marked)))]
        of = np.empty(total + 1, np.int64)
        of[marked] = reach
        span_here, span_there = of[here] - here, of[there] - there
        same = fits & (span_here == span_there)
        alike[same] = span(sums, here[same], of[here[same]]) == span(sums, there[same], of[there[same]])
        # equal whole phrases may stand apart in the array, where longer phrases follow them: runs of one string are one family
        run = np.cumsum(np.r_[True, ~alike]) - 1
        head = marked[array[np.flatnonzero(np.r_[True, ~alike])]]
        _, string = np.unique(span(sums, head, of[head]), return_inverse=True)
        family[array] = string[run]
        count = np.bincount(family[:-1])
        lone = count[family[:-1]] < 2
        family[:-1][lone] = -2
        family[:-1][reach == marked] = -1
    group = np.where(usable, family[k], -1)
    look = np.flatnonzero(group != -2)
    key = mix(hashes[look] ^ mix((group[look] + 2).astype(np.uint64)))
    order = np.argsort(key)
    key = key[order]
    again = np.zeros(len(key), bool)
    if len(key) > 1:
        same = key[1:] == key[:-1]
        again[1:] |= same
        again[:-1] |= same
    found = np.zeros(total, bool)
    found[starts[look[order[again]]]] = True
    return np.split(found, offsets[1:-1])


def _ranges(found: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, found.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


_RANGES = "array<struct<a:int,b:int>>"


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (byte ranges to remove, ascending, apart), kept (the remaining bytes).

    Null text is empty; texts under ``length`` bytes have nothing to remove; rows that repeat an id, a text or both are
    judged row by row like any others; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # two hashes of id and text tell rows apart: one of 64 bits would meet by chance among some 10^10 rows
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("rid"), F.xxhash64(F.lit(1), F.col(f"`{id_col}`"), text).alias("twin"), text.alias("text"))

    def cut(batches):
        for batch in batches:
            raw, offsets = flat(batch.column(2))
            rid, twin = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in pieces(offsets, most_rows=50_000):
                row, first, windows, name, whole, again = contexts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(rid[a:b][row]), pa.array(twin[a:b][row]), pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(again)], names=["name", "whole", "rid", "twin", "first", "windows", "again"])

    seen = written(rows.select("rid", "twin", "text").mapInArrow(lean(cut), "name long, whole long, rid long, twin long, first int, windows int, again boolean"), "repeat-contexts")
    distinct = seen.groupBy("name", "whole", "windows").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "twin", "first")).alias("at"), F.max("again").alias("again"))
    names = distinct.groupBy("name").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("n"), F.max("again").alias("again")).where("contexts > 1 or n > 1 or again")
    distinct = written(distinct.drop("again").join(names.select("name", "contexts", F.col("again").alias("within")), "name"), "repeat-distinct")
    resolved = distinct.where("n > 1").select("name", "whole", F.array(F.struct(F.lit(0).alias("a"), F.col("windows").alias("b"))).cast(_RANGES).alias("found"))
    open_ = distinct.where("contexts > 1 or within")
    total = open_.agg(F.coalesce(F.sum(F.col("windows") + length), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    wanted = open_.select("at.rid", "at.twin", F.struct("name", "whole", F.col("at.first").alias("first"), "windows", (F.col("contexts") > hot).alias("hot")).alias("c")).groupBy("rid", "twin").agg(F.collect_list("c").alias("cs"))

    def fetch(batches):
        for batch in batches:
            out = []
            for text, cs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                out += [(c["name"], c["whole"], c["hot"], data[c["first"] : c["first"] + c["windows"] - 1 + length]) for c in cs]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=["name", "whole", "hot", "data"])

    one = rows.select("rid", "twin", "text").join(wanted, ["rid", "twin"])
    fetched = written(one.select("text", "cs").mapInArrow(lean(fetch), "name long, whole long, hot boolean, data binary"), "repeat-bytes")

    def search(table: pa.Table) -> pa.Table:
        found = [_ranges(f) for f in repeats_in(table.column("data").to_pylist(), length)]
        keep = [i for i, f in enumerate(found) if f]
        rows = pa.array([[{"a": a, "b": b} for a, b in found[i]] for i in keep], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        return pa.table({"name": table.column("name").take(keep), "whole": table.column("whole").take(keep), "found": rows})

    block = F.pmod(F.xxhash64("name"), F.lit(blocks)).alias("block")
    searched = fetched.where("not hot").select(block, "name", "whole", "data").groupBy("block").applyInArrow(lean_groups(search), f"name long, whole long, found {_RANGES}")

    def deal(batches):
        for batch in batches:
            name, whole, data = (batch.column(k).to_pylist() for k in range(3))
            raw = np.frombuffer(b"".join(data), np.uint8)
            offsets = np.r_[0, np.cumsum([len(d) for d in data])]
            for a, b in pieces(offsets):
                sums, cut_ = prefix(raw[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
                at = np.arange(cut_[-1])
                owner = np.repeat(np.arange(b - a), np.diff(cut_))
                at = at[at + length <= cut_[owner + 1]]
                h = span(sums, at, at + length)
                part = (h >> np.uint64(56)).astype(int)
                for k in np.unique(part).tolist():
                    i = part == k
                    yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "names": pa.array([np.array(name[a:b])[owner[at[i]]].tobytes()], pa.binary()), "wholes": pa.array([np.array(whole[a:b])[owner[at[i]]].tobytes()], pa.binary()), "at": pa.array([(at[i] - cut_[owner[at[i]]]).astype("<i4").tobytes()], pa.binary()), "h": pa.array([h[i].tobytes()], pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        name, whole, at, h = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("names", "<i8"), ("wholes", "<i8"), ("at", "<i4"), ("h", "<u8")))
        _, code, count = np.unique(h, return_inverse=True, return_counts=True)
        i = np.flatnonzero(count[code] > 1)
        rows = pa.array([[{"a": a, "b": a + 1}] for a in at[i].tolist()], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        return pa.table({"name": name[i], "whole": whole[i], "found": rows})

    dealt = fetched.where("hot").select("name", "whole", "data").mapInArrow(lean(deal), "part int, names binary, wholes binary, at binary, h binary")
    met = dealt.groupBy("part").applyInArrow(lean_groups(meet), f"name long, whole long, found {_RANGES}")
    repeats = written(resolved.unionByName(searched).unionByName(met).groupBy("name", "whole").agg(F.flatten(F.collect_list("found")).alias("found")), "repeat-found")
    where = (
        seen.join(repeats, ["name", "whole"])
        .select("rid", "twin", F.transform("found", lambda x: F.struct((F.col("first") + x["a"]).cast("int").alias("a"), (F.col("first") + x["b"] - 1 + length).cast("int").alias("b"))).alias("found"))
        .groupBy("rid", "twin")
        .agg(F.flatten(F.collect_list("found")).alias("found"))
    )

    def remove(batches):
        for batch in batches:
            raw, offsets = flat(batch.column(1))
            lists, kept, spans = batch.column(2), [], []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                data, ranges = raw[a:b], lists[k]
                if not ranges.is_valid or not len(ranges.values):
                    spans.append([])
                    kept.append(data.tobytes())
                    continue
                level = np.zeros(len(data) + 1, np.int64)
                np.add.at(level, ranges.values.field(0).to_numpy(), 1)
                np.add.at(level, ranges.values.field(1).to_numpy(), -1)
                gone = np.cumsum(level[:-1]) > 0
                spans.append([{"a": x, "b": y} for x, y in _ranges(gone)])
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    marked = rows.join(where, ["rid", "twin"], "left").select("id", "text", "found")
    return marked.mapInArrow(lean(remove), f"doc_id {rows.schema['id'].dataType.simpleString()}, n_bytes long, spans {_RANGES}, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removals(documents(spark, sf_dir))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
