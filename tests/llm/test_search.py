"""Lexical search, the conversation trie and benchmark passages against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillscan.llm import conversation_trie, decontamination, lexical_index

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "item_id long, text string, doc_id string, score double, spans int, rank string"


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))


@pytest.fixture(scope="module")
def items(spark, odd):
    """Passages of the odd texts, short and empty items, nulls, repeated ids and repeated rows."""
    rng = random.Random(3)
    long_ = terms(odd.where("doc_id = 0").first().text)
    passages = [" ".join(long_[a : a + n]) for a, n in ((0, 10), (40, 60), (100, 25), (290, 10), (7, 9), (20, 3), (50, 1))]
    texts = [*passages, passages[1].upper().replace(" ", ",\n"), "word " * 12, "word", "x", None, "", " .. ", "no such word here", "漢字 🙂", " ".join(rng.choice(long_) for _ in range(40))]
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(1, "tail x"), (1, passages[1]), (2, passages[2]), (None, "z 漢字")]
    return spark.createDataFrame([(*r, "d", None, 3, "r") for r in rows], SCHEMA).repartition(2)


def marked(docs, items):
    runs = defaultdict(set)
    for i in items:
        w = terms(i.text)
        t = min(len(w), 10)
        for s in range(len(w) - t + 1 if t else 0):
            runs[tuple(w[s : s + t])].add(i.item_id)
    lengths = {len(r) for r in runs}
    out = []
    for d in docs:
        w = terms(d.text)
        hit, ids = set(), set()
        for t in lengths:
            for s in range(len(w) - t + 1):
                if (found := runs.get(tuple(w[s : s + t]))) is not None:
                    hit.update(range(s, s + t))
                    ids |= found
        out.append((d.doc_id, len(w), tuple(sorted(hit)), tuple(sorted(str(i) for i in ids if i is not None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [10**6, 0])
def test_contaminated(odd, none, items, most):
    got = decontamination.contaminated(odd, decontamination.benchmark_index(items), most_windows=most).collect()
    mine = [(r.doc_id, r.n_words, tuple(p for s in r.spans for p in range(s.start, s.end)), tuple(r["items"])) for r in got]
    assert sorted(mine, key=str) == marked(odd.collect(), items.collect())
    assert all(a.end < b.start for r in got for a, b in zip(r.spans, r.spans[1:]))
    assert sum(bool(r.spans) for r in got) > 5
    index = decontamination.benchmark_index(items)
    assert decontamination.contaminated(none, index, most_windows=most).count() == 0
    empty = decontamination.contaminated(odd, decontamination.benchmark_index(items.limit(0)), most_windows=most).collect()
    assert len(empty) == odd.count() and not any(r.spans or r["items"] for r in empty)


def test_any_long_enough_run_shares_a_fingerprint():
    rng = np.random.default_rng(1)
    for t in range(1, 11):
        h = rng.integers(0, 5, 400).astype(np.uint64)
        starts, f = decontamination.winnowed(np.zeros(400, np.int64), h, t)
        by = defaultdict(set)
        for s, x in zip(starts.tolist(), f.tolist()):
            by[tuple(h[s : s + t].tolist())].add(x)
        assert len(starts) == 401 - t and all(len(x) == 1 for x in by.values())


def ranked(docs, items, k=10):
    words = [terms(d.text) for d in docs]
    n_docs, n_terms = sum(bool(w) for w in words), sum(map(len, words))
    df = defaultdict(int)
    for w in words:
        for t in set(w):
            df[t] += 1
    asked = defaultdict(set)
    for i in items:
        asked[i.item_id] |= set(terms(i.text))
    out = []
    for item, ts in asked.items():
        found = []
        for d, w in zip(docs, words):
            m = 10 + 90 * len(w) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in ts if t in w)
            if score:
                found.append((-score, d.doc_id is None, d.doc_id))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "pairs"), [(16_384, 10**6), (3, 20)])
def test_search(odd, none, items, block, pairs):
    index = lexical_index.build(odd, block_docs=block)
    for k in (1, 3, 10):
        got = lexical_index.search(index, items, k, most_pairs=pairs)
        assert sorted(map(tuple, got.collect()), key=str) == ranked(odd.collect(), items.collect(), k)
    assert lexical_index.search(lexical_index.build(none), items).count() == 0
    assert lexical_index.search(index, items.limit(0)).count() == 0


def test_search_many_ties(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 6)))) for i in rng.sample(range(10**6), 700)], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(i, " ".join(rng.sample("abcdefghij", rng.randint(1, 9)))) for i in range(150)], "item_id long, text string")
    got = lexical_index.search(lexical_index.build(docs, block_docs=100), items).collect()
    assert sorted(map(tuple, got), key=str) == ranked(docs.collect(), items.collect())


def test_carries():
    rng = np.random.default_rng(4)
    cut = lambda x, n: np.stack([np.packbits(x >> k & 1, bitorder="little").view(np.uint64) for k in range(n)])
    a, b = rng.integers(0, 2**30, 128), rng.integers(0, 2**20, 128)
    sums, weight = cut(a, 40), 23_725
    lexical_index.plus(sums, lexical_index.times(cut(b, 20), weight))
    whole = sum(np.unpackbits(s.view(np.uint8), bitorder="little").astype(np.int64) << k for k, s in enumerate(sums))
    assert (whole == a + weight * b).all()


def nodes(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    whole = {}
    for c, s in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        whole[c] = own.get(base, [])[:h] + s[h:]
    members, ends, below = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, s in whole.items():
        ends[tuple(s)].append(c)
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                below[tuple(s[: d - 1])].add(tuple(s[:d]))
    out = []
    for p, cs in members.items():
        tree, todo = [], [p]
        while todo:
            tree.append(todo.pop())
            todo += below[tree[-1]]
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(below[p]), sum(not below[q] for q in tree), sum((len(members[q]) - 1) * len(q[-1][1]) for q in tree if q), hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
    return sorted(out, key=str)


def talk():
    rng = random.Random(6)
    rows = []
    for c in [*range(195, 330), -1, -100, -150, 10**15, 10**15 + 7, 400, 401, 402]:
        n = rng.choice([1, 1, 2, 3, 4, 7, 9])
        rows += [(c, t, rng.choice(["user", "user", None]), rng.choice(["hi", "hi", "yes 🙂", "", None, "no"])) for t in range(n)]
    rows += [(500, t, "user", f"turn {t % 3}") for t in range(40)] + [(501, t, "user", f"turn {t % 3}") for t in range(40)] + [(800, None, "user", "first"), (800, 2, "user", "last")]
    rows += [(c, 0, "user", "same") for c in range(9001, 9099)] + [(None, 0, "user", "lost"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("stride", [4096, 4])
def test_trie(spark, monkeypatch, stride):
    monkeypatch.setattr(conversation_trie, "STRIDE", stride)
    schema = "conv_id long, turn long, role string, text string, depth long, n int, conv string, part int"
    rows = talk()
    shuffled = random.Random(1).sample(rows, len(rows))
    table = spark.createDataFrame([(*r, 1, 2, "c", 3) for r in shuffled], schema).repartition(5)
    assert sorted(map(tuple, conversation_trie.trie(table).collect()), key=str) == nodes(rows)
    assert conversation_trie.trie(table.limit(0)).count() == 0


def test_trie_of_repeated_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(100, 0, "user", "a"), (100, 0, "user", "a"), (100, 1, None, None), (100, 1, "user", "b"), (101, None, None, None)] * 2
    got = [sorted(map(tuple, conversation_trie.trie(spark.createDataFrame(rows, schema).repartition(n)).collect()), key=str) for n in (1, 4)]
    assert got[0] == got[1] and max(r[1] for r in got[0]) == 8


@pytest.mark.parametrize("module", [conversation_trie, decontamination, lexical_index])
def test_against_sql(spark, sf, module):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    got = module.query(spark, sf)
    want = con.sql(module.ORACLE)
    assert sorted(map(tuple, got.select(*[d[0] for d in want.description]).collect()), key=str) == sorted(want.fetchall(), key=str)
