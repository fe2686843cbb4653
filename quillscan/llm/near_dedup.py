"""Near-duplicate documents by BagMinHash over the multiset of their five-word shingles.

A shingle that occurs w times owns the weight interval [0, w). It is cut into the dyadic levels [0, 1), [1, 2),
[2, 4), [4, 8) ...; each level is an independent Poisson process in (time, weight, register) seeded by shingle and
level, and points beyond w are rejected. A register keeps the point that comes first, so two documents agree in a
register with probability equal to their weighted Jaccard similarity. Processes are followed only up to the time
by which all registers of a document are full, so the cost is one draw for each shingle plus a constant.

Registers are banded. Texts with the same words are first collapsed into one *content*. In every bucket of a band
the contents are compared with one centre, then, where several components remain, with random ones; where several
still remain, all pairs are compared inside tasks, block by block, of which only links that join components leave the
task. Every link is verified on the multisets themselves; classes are the components of the verified links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.llm._bytes import _powers, flat, lean, lean_groups, mix, pieces, prefix, span, words
from quillscan.llm._graph import components
from quillscan.llm._store import documents, written

SHINGLE, THRESHOLD, REGISTERS, BAND_ROWS = 5, 0.8, 80, 4
#: Rounds with a random centre; bands (all) and block length of the comparison of what is left.
ROUNDS, LAST_BANDS, BLOCK = 1, REGISTERS // BAND_ROWS, 512
_GOLD, _ODD = np.uint64(0x9E3779B97F4A7C15), [np.uint64(k) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, hashes) of all five-word shingles, and per row two 64-bit hashes of its word sequence.

    Words are runs without ASCII white space, A-Z lower-cased; a row of one to four words has one shingle of them all.
    """
    n = len(offsets) - 1
    starts, ends, row = words(raw, offsets)
    h = span(prefix(raw, fold=True), starts, ends)
    size = np.bincount(row, minlength=n)
    first = np.cumsum(size) - size
    place = np.arange(len(row)) - first[row]
    padded = np.append(h, np.zeros(SHINGLE, np.uint64))
    s = np.zeros(len(h), np.uint64)
    short = size[row] < SHINGLE
    for k in range(SHINGLE):
        other = padded[k : k + len(h)]
        s += np.where(short & (place + k >= size[row]), np.uint64(0), other) * _ODD[k]
    keep = np.where(short, place == 0, place + SHINGLE <= size[row])
    content = np.zeros((2, n), np.uint64)
    some = size > 0
    if some.any():
        prefix(np.zeros(int(size.max()), np.uint8))
        power = _powers[0][place]
        for k, x in enumerate((h, mix(h ^ _GOLD))):
            content[k, some] = mix(np.add.reduceat(x * power, first[some]) + size[some].astype(np.uint64))
    return row[keep], mix(s[keep]), content[0], content[1]


def multiset(row: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) with how often each occurs."""
    if not len(row):
        return row, s, np.zeros(0, np.int64)
    key = mix(s ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return row[order[begin]], s[order[begin]], np.diff(np.r_[begin, len(key)])


def signatures(row: np.ndarray, s: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash signatures (n x registers, 32-bit point names) of weighted sets; zero where a row has nothing."""
    out = np.zeros((n, registers), np.uint32)
    total = np.bincount(row, weights=weight, minlength=n)
    todo, slack = total > 0, 6.0
    while todo.any():
        limit = np.zeros(n)
        limit[todo] = (np.log(registers) + slack) / total[todo]
        best = np.full(n * registers, np.inf)
        name = np.zeros(n * registers, np.uint32)
        mine = np.flatnonzero(todo[row])
        level = np.zeros(len(mine), np.int64)
        more, k = mine[weight[mine] > 1], 1
        while len(more):
            mine, level = np.append(mine, more), np.append(level, np.full(len(more), k))
            more, k = more[weight[more] > 2**k], k + 1
        base = np.where(level > 0, 2.0 ** (level - 1), 0.0)
        length = np.maximum(base, 1.0)
        seed = mix(s[mine] + _GOLD * (level.astype(np.uint64) + np.uint64(1)))
        r, w, time, draw = row[mine], weight[mine], np.zeros(len(mine)), 0
        point_row, point_time, point_name = [], [], []
        while len(seed):
            draw += 1
            x = mix(seed + np.uint64(0x9E3779B97F4A7C15 * draw % 2**64))
            time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / (registers * length)
            on = time <= limit[r]
            seed, r, w, time, base, length, x = seed[on], r[on], w[on], time[on], base[on], length[on], x[on]
            y = mix(x ^ _ODD[0])
            take = base + (y >> np.uint64(32)).astype(np.float64) / 2.0**32 * length < w
            point_row.append(r[take] * registers + ((y & np.uint64(0xFFFFFFFF)) % np.uint64(registers)).astype(np.int64)[take])
            point_time.append(time[take])
            point_name.append((x >> np.uint64(32)).astype(np.uint32)[take])
        at, when, named = map(np.concatenate, (point_row, point_time, point_name))
        np.minimum.at(best, at, when)
        first = best[at] == when
        name[at[first]] = named[first]
        full = todo & np.isfinite(best.reshape(n, registers)).all(axis=1)
        out[full] = name.reshape(n, registers)[full]
        todo, slack = todo & ~full, slack * 2
    return out


def similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of two string columns' shingle multisets, row by row; 1 where both are empty."""
    n, sides = len(left), []
    for column in (left, right):
        raw, offsets = flat(column)
        row, s, _, _ = shingles(raw, offsets)
        sides.append(multiset(row, s))
    key = [mix(s ^ mix(r.astype(np.uint64) + np.uint64(1))) for r, s, _ in sides]
    totals = [np.bincount(r, weights=c, minlength=n) for r, _, c in sides]
    _, i, j = np.intersect1d(*key, assume_unique=True, return_indices=True)
    both = np.bincount(sides[0][0][i], weights=np.minimum(sides[0][2][i], sides[1][2][j]), minlength=n)
    union = totals[0] + totals[1] - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def spanning(texts: pa.Array, a: np.ndarray, b: np.ndarray, label: np.ndarray, threshold: float, columns: int = 4096) -> list[tuple[int, int]]:
    """Links between rows ``a`` and ``b`` that join components: all pairs are compared, as many links returned as join labels.

    Multisets are laid out as 0/1 rows over (shingle, occurrence), so the overlaps of all pairs are a matrix product.
    """
    if pa.types.is_binary(texts.type):
        texts = texts.cast(pa.string())
    raw, offsets = flat(texts)
    row, s, weight = multiset(*shingles(raw, offsets)[:2])
    size = np.bincount(row, weights=weight, minlength=len(texts))
    nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    row, item = np.repeat(row, weight), mix(np.repeat(s, weight) + _GOLD * nth.astype(np.uint64))
    _, code, count = np.unique(item, return_inverse=True, return_counts=True)
    row, code = row[count[code] > 1], code[count[code] > 1]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    place_a, place_b = np.full(len(texts), -1), np.full(len(texts), -1)
    place_a[a], place_b[b] = np.arange(len(a)), np.arange(len(b))
    both = np.zeros((len(a), len(b)), np.float32)
    for c in range(0, int(code[-1]) + 1 if len(code) else 0, columns):
        part = slice(*np.searchsorted(code, (c, c + columns)))
        left, right = np.zeros((len(a), columns), np.float32), np.zeros((len(b), columns), np.float32)
        for side, place in ((left, place_a), (right, place_b)):
            at = place[row[part]]
            side[at[at >= 0], code[part][at >= 0] - c] = 1
        both += left @ right.T
    union = size[a][:, None] + size[b][None] - both
    i, j = np.nonzero((both >= threshold * union - 1e-6) & (union > 0) & (label[a][:, None] != label[b][None]))
    exact = both[i, j].astype(np.float64) / union[i, j] >= threshold
    parent, out = {}, []

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(a[i[exact]].tolist(), b[j[exact]].tolist()):
        p, q = root(label[x]), root(label[y])
        if p != q:
            parent[p] = q
            out.append((x, y))
    return out


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            raw, offsets = flat(batch.column(2))
            for a, b in pieces(offsets):
                row, s, c1, c2 = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sign = signatures(*multiset(row, s), b - a)
                empty = np.bincount(row, minlength=b - a) == 0
                name = np.ascontiguousarray(np.stack([c1, c2], 1)).tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                    pa.array([name[16 * i : 16 * i + 16] for i in range(b - a)], pa.binary()),
                    pa.array([None if e else x.tobytes() for e, x in zip(empty, sign)], pa.binary()),
                ], names=["id", "raw", "content", "sign"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("raw"), text.alias("text"))
    return written(rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, raw long, content binary, sign binary"), "near-signed")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those (u, v) whose multisets overlap enough."""

    def run(batches):
        for batch in batches:
            ends = np.cumsum(np.diff(flat(batch.column(2))[1]) + np.diff(flat(batch.column(3))[1]))
            for a, b in pieces(np.r_[0, ends]):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(similarity(part.column(2), part.column(3)) >= threshold)).select([0, 1])

    with_v = pairs.join(texts.withColumnsRenamed({"content": "v", "text": "text_v"}), "v")
    both = with_v.join(texts.withColumnsRenamed({"content": "u", "text": "text_u"}), "u").select("u", "v", F.col("text_u"), F.col("text_v"))
    return both.mapInArrow(lean(run), "u binary, v binary")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, raw (xxhash64 of its text), content, label (name of its class), class_id (its least id), class_size.

    Texts with the same sequence of words are one content and always share a class, the empty sequence included;
    null text is empty. Rows may repeat an id; null ids are ignored in class_id unless a class has no other; an
    empty table gives no rows; other columns are ignored.
    """
    signed = _signed(docs, id_col, text_col)
    contents = written(signed.groupBy("content").agg(F.min(F.struct(F.col("id").isNull(), "id", "raw", "sign")).alias("one")).select("content", "one.id", "one.raw", "one.sign"), "near-contents")
    width = 8 * BAND_ROWS
    band = lambda k: F.xxhash64(F.substring(F.hex("sign"), k * width + 1, width))
    keys = F.array(*[band(k) for k in range(REGISTERS // BAND_ROWS)])
    members = contents.where("sign is not null").select("content", F.posexplode(keys).alias("band", "key"))
    crowded = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("centre")).where("n > 1")
    members = written(members.join(crowded, ["band", "key"]), "near-members")
    needed = members.select("content").distinct().join(contents, "content").select("content", F.col("id").alias("i"), F.col("raw").alias("r"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("x"))
    texts = written(source.join(needed, F.col("id").eqNullSafe(F.col("i")) & (F.col("x") == F.col("r"))).dropDuplicates(["content"]).select("content", "text"), "near-texts")

    star = members.where("content <> centre").select(F.col("centre").alias("u"), F.col("content").alias("v")).distinct()
    links = written(_verified(star, texts, threshold), "near-links")
    labels = written(components(links), "near-labels")

    def still_open(labels, bands=REGISTERS // BAND_ROWS, seed=0):
        """Members of buckets where several components meet and not all pairs have been compared, with a random one of them."""
        named = members.where((F.col("n") > 2) & (F.col("band") < bands)).join(labels.withColumnRenamed("node", "content"), "content", "left").withColumn("label", F.coalesce("label", "content"))
        mixed = named.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct(F.xxhash64("content", "band", F.lit(seed)), "content", "label")).alias("c")).where("low <> high")
        return written(named.join(mixed.select("band", "key", F.col("c.content").alias("second"), F.col("c.label").alias("second_label")), ["band", "key"]), "near-open")

    for seed in range(ROUNDS):
        star = still_open(labels, seed=seed).where("label <> second_label").select(F.least("second", "content").alias("u"), F.greatest("second", "content").alias("v")).distinct()
        links = links.union(written(_verified(star, texts, threshold), "near-links"))
        labels = written(components(links), "near-labels")

    rest = still_open(labels, LAST_BANDS).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rest = rest.withColumn("own", F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int")).join(texts, "content")
    rest = rest.select("band", "key", "content", "label", "text", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rest = rest.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")

    def compare(table: pa.Table) -> pa.Table:
        name, own = table.column("content").to_pylist(), table.column("own").to_numpy()
        label = pd.factorize(pd.Series(table.column("label").to_pylist()))[0]
        a, b = (np.flatnonzero(own == table.column(c)[0].as_py()) for c in ("i", "j"))
        found = spanning(table.column("text").combine_chunks(), a, b, label, threshold) if label.max() > 0 else []
        return pa.table({"u": pa.array([min(name[x], name[y]) for x, y in found], pa.binary()), "v": pa.array([max(name[x], name[y]) for x, y in found], pa.binary())})

    last = rest.groupBy("band", "key", "i", "j").applyInArrow(lean_groups(compare), "u binary, v binary").distinct()
    labels = written(components(links.union(written(last, "near-links"))), "near-labels")

    of = contents.select("content").join(labels.withColumnRenamed("node", "content"), "content", "left").withColumn("label", F.coalesce("label", "content"))
    counted = signed.groupBy("content").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).join(of, "content")
    totals = counted.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    named = written(counted.join(totals, "label").select("content", "label", "class_id", "class_size"), "near-classes")
    return signed.select(F.col("id").alias("doc_id"), "raw", "content").join(named, "content")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class, that of least id; the columns are those of ``docs``.

    Null text is empty, and all texts without a word are one class. Where several rows of a class share the least id, one of
    them stays; a row without an id stays only in a class that has no other; an empty table gives no rows.
    """
    known = lambda c: F.coalesce(F.concat(F.lit("i"), F.col(c).cast("string")), F.lit(""))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "raw")
    keep = classes(docs).groupBy("label").agg(F.min(first).alias("one")).select(known("one.doc_id").alias("i"), F.col("one.raw").alias("r"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = rows.select(known("doc.doc_id").alias("i"), F.xxhash64(F.coalesce(F.col("doc.text"), F.lit(""))).alias("r"), "doc")
    return rows.join(keep, ["i", "r"]).dropDuplicates(["i", "r"]).select("doc.*")
