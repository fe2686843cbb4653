import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillscan.llm import exact_dedup, near_dedup, substring_dedup
from quillscan.llm._gsaca import suffix_array
from quillscan.llm._graph import components


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_exact(odd, none):
    rows = odd.collect()
    groups = {}
    for r in rows:
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    got = exact_dedup.exact_groups(odd).collect()
    assert len(got) == len(rows)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for sha, ids in by.items():
        mine = [r for r in got if r.text_sha256 == sha]
        known = [i for i in ids if i is not None]
        assert len(mine) == len(ids) and {r.group_size for r in mine} == {len(ids)} and {r.keep_id for r in mine} == {max(known) if known else None}
        assert sum(r.kept for r in mine) == 1 and all(r.doc_id == r.keep_id for r in mine if r.kept)
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.stage(odd.sparkSession, odd, "")
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_exact_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.sql(exact_dedup.ORACLE).fetchall())
    assert sorted(map(tuple, exact_dedup.query(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 6), (6, 7), (7, 8), (8, 9), (20, 20), (30, 31)] + [(100, 100 + i) for i in range(1, 40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **{i: 4 for i in range(4, 10)}, 30: 30, 31: 30, **{100 + i: 100 for i in range(40)}}


def near_texts():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy) if rng.random() < 0.8 else "\n".join(copy).upper())
    return texts + ["", None, "one", "one", "again " * 50, "again " * 49]


def multiset(text):
    from collections import Counter

    w = lower(text).split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def classes_by_force(texts):
    sets, root = [multiset(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            union = sum((sets[i] | sets[j]).values())
            if sum((sets[i] & sets[j]).values()) / union >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [512, 3])
def test_near_classes(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = near_texts()
    got = near_dedup.classes(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == dict(enumerate(classes_by_force(texts)))


def far_pairs(pairs, others):
    """Pairs at similarity 0.8 that share one or two buckets, all in the last ten bands, each among others that fill its buckets."""
    rng, texts = random.Random(8), []
    changed = lambda base, k: [f"x{rng.random()}" if i in k else w for i, w in enumerate(base)]
    while len(texts) < pairs * (others + 2):
        base = [[f"w{rng.random()}" for _ in range(50)] for _ in range(500)]
        both = [(b, changed(b, {rng.randrange(8, 42)})) for b in base]
        raw, offsets = near_dedup.flat(pa.array([" ".join(w) for pair in both for w in pair]))
        row, s, _, _ = near_dedup.shingles(raw, offsets)
        sign = near_dedup.signatures(*near_dedup.multiset(row, s), 1000).reshape(500, 2, 20, 4)
        same = (sign[:, 0] == sign[:, 1]).all(axis=2)
        for k in np.flatnonzero(same[:, 10:].any(axis=1) & (same.sum(axis=1) < 3) & ~same[:, :10].any(axis=1)).tolist()[: pairs - len(texts) // (others + 2)]:
            texts += [" ".join(w) for w in both[k]] + [" ".join(changed(base[k], {0, rng.choice([15, 25, 35])})) for _ in range(others)]
    return texts


def test_near_classes_of_crowded_last_bands(spark):
    texts = far_pairs(12, 24)
    got = near_dedup.classes(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == dict(enumerate(classes_by_force(texts)))


def test_near_edges(odd, none):
    got = near_dedup.classes(odd).collect()
    assert len(got) == odd.count() and near_dedup.classes(none).count() == 0
    same = {r.class_id for r in got if r.doc_id in (0, 1)}
    assert same == {0}
    kept = near_dedup.stage(odd.sparkSession, odd, "")
    assert kept.columns == odd.columns and kept.count() == len({r.label for r in got})
    twins = odd.sparkSession.createDataFrame([(1, " ".join(f"w{k}" for k in range(90)) + end) for end in ("", " x", " x")] + [(2, "other")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.stage(odd.sparkSession, twins, "").collect()) == [1, 2]


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(1)
    a, b = [], []
    for _ in range(150):
        w = [f"w{rng.randrange(60)}" for _ in range(rng.randint(5, 80))] * rng.choice([1, 1, 3])
        v = [x if rng.random() > 0.05 else "zz" for x in w]
        a.append(" ".join(w))
        b.append(" ".join(v))
    sim = near_dedup.similarity(pa.array(a), pa.array(b))
    assert np.allclose(sim, [sum((multiset(x) & multiset(y)).values()) / sum((multiset(x) | multiset(y)).values()) for x, y in zip(a, b)])
    sign = []
    for texts in (a, b):
        raw, offsets = near_dedup.flat(pa.array(texts))
        row, s, _, _ = near_dedup.shingles(raw, offsets)
        sign.append(near_dedup.signatures(*near_dedup.multiset(row, s), len(texts), 256))
    estimate = (sign[0] == sign[1]).mean(axis=1)
    assert abs((estimate - sim).mean()) < 0.01 and np.abs(estimate - sim).max() < 0.2


def test_suffix_array():
    rng = random.Random(0)
    for k in range(1500):
        x = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 30))] * (1 + k % 3)
        assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def removed_by_force(texts, length):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeated_passages(spark, hot):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab cdé") for _ in range(rng.randint(300, 900))) for _ in range(6)]
    texts = []
    for i in range(50):
        texts.append("".join(rng.choice(base)[rng.randint(0, 100) : rng.randint(200, 900)] if rng.random() < 0.6 else "".join(rng.choice("abc d") for _ in range(rng.randint(0, 300))) for _ in range(rng.randint(0, 4))))
    texts += ["abc" * 200, "a" * 399, "a" * 400, "a" * 401, None, "", texts[0], "b" * 700]
    got = {r.doc_id: bytes(r.kept) for r in substring_dedup.removals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hot=hot).collect()}
    assert got == dict(enumerate(removed_by_force(texts, 400)))


@pytest.mark.parametrize("filling", [".", "- ", "abc", "=-=-"])
def test_repeated_passages_of_short_periods(spark, filling):
    rng = random.Random(6)
    prose = lambda n: "".join(rng.choice("abcdefg hij klm") for _ in range(n))
    texts = []
    for k in range(12):
        heading = prose(rng.randint(20, 60))
        for _ in range(rng.randint(2, 4)):
            texts.append(prose(rng.randint(1, 300)) + heading + (filling * 500)[: rng.randint(400, 500)] + prose(rng.randint(1, 300)))
    got = {r.doc_id: bytes(r.kept) for r in substring_dedup.removals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(removed_by_force(texts, 400)))


def test_repeats_with_text_of_any_kind_after_them():
    rng = random.Random(7)
    prose = lambda n: "".join(rng.choice("abcdefg hij klm") for _ in range(n)).encode()
    for _ in range(40):
        shared = prose(rng.randint(20, 300))
        shared += b"." * (400 + rng.randint(0, 40) - len(shared))
        texts = [prose(rng.randint(0, 30)) + shared + prose(rng.randint(0, 300)) for _ in range(rng.randint(2, 6))]
        seen = {}
        for t in texts:
            for i in range(len(t) - 399):
                seen[t[i : i + 400]] = seen.get(t[i : i + 400], 0) + 1
        for t, found in zip(texts, substring_dedup.repeats_in(texts)):
            assert found.tolist() == [seen.get(t[i : i + 400], 0) > 1 for i in range(len(t) - 399)] + [False] * min(399, len(t))


def test_repeated_passages_edges(odd, none):
    rows = odd.collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.kept)) for r in substring_dedup.removals(odd).collect())
    assert got == sorted((r.doc_id is None, r.doc_id or 0, k) for r, k in zip(rows, removed_by_force([r.text for r in rows], 400)))
    assert substring_dedup.removals(none).count() == 0
