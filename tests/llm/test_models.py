import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillscan.llm import bloom_lm, fingerprints, language_id, mixing, toxicity


def test_digests(odd, none):
    texts = ["", "a", "ab", "some words stand here", "some words stand here", None]
    codes, lengths = fingerprints.digests(pa.array(texts))
    names = fingerprints.rendered(codes, lengths)
    assert names[3] == names[4] and names[0] == names[5] and len(set(map(len, names))) == 1
    assert fingerprints.likeness(codes[3:4], lengths[3:4], codes[4:5], lengths[4:5])[0] == 1
    b = np.frombuffer(texts[3].encode(), np.uint8).astype(np.uint32)
    n = len(b)
    counts = np.zeros(256, int)
    for i in range(n):
        key = np.uint32(int(b[i]) | int(b[(i + 4) % n]) << 8 | int(b[(i + 9) % n]) << 16)
        with np.errstate(over="ignore"):
            key = key * np.uint32(2654435761)
            key = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        counts[int(key >> np.uint32(24))] += 1
    q = np.sort(counts)[[63, 127, 191]]
    assert codes[3].tolist() == [sum(int(c > x) for x in q) for c in counts.tolist()]
    got = fingerprints.neighbours(odd).collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect())
    for r, (known, doc, text), (_, _, after) in zip(sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars)), sorted(want, key=lambda w: (w[0], w[1], len(w[2]))), want[1:] + want[:1]):
        k = len(text) // 4
        if r.doc_id not in (3, 7, None):
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(got) == len(want) and fingerprints.neighbours(none).count() == 0
    assert fingerprints.fingerprint(odd).count() == len(want)


def test_marginals():
    rng = np.random.default_rng(1)
    model = {"bias": -1.3, "move": [[-0.1, 0.2], [-0.7, 0.9]]}
    step = np.exp(np.array(model["move"])) * np.exp([0, model["bias"]])[None]
    rows, places, gains, sizes, want, moves, toxic = [], [], [], [], [], np.zeros((2, 2)), 0.0
    for r in range(40):
        n = int(rng.integers(1, 50))
        at = np.sort(rng.choice(n, int(rng.integers(0, min(n, 8) + 1)), replace=False))
        g = rng.normal(0, 3, len(at))
        u = np.ones((n, 2))
        u[at, 1] = np.exp(g)
        a, b = np.zeros((n, 2)), np.ones((n, 2))
        a[0] = np.array([1, np.exp(model["bias"])]) * u[0]
        for t in range(1, n):
            a[t] = (a[t - 1] @ step) * u[t]
        for t in range(n - 2, -1, -1):
            b[t] = step @ (b[t + 1] * u[t + 1])
        p = a * b
        rows += [r] * len(at)
        places += at.tolist()
        gains += g.tolist()
        sizes.append(n)
        want += (p[:, 1] / p.sum(1))[at].tolist()
        toxic += (p[:, 1] / p.sum(1)).sum()
        for t in range(1, n):
            both = a[t - 1][:, None] * step * (b[t] * u[t])[None]
            moves += both / both.sum()
    words = np.array(rows), np.array(places), np.array(gains), np.array(sizes), model
    marginals, ahead, back = toxicity.chain(*words)
    assert np.allclose(marginals, want)
    got, number = toxicity.expected_moves(*words, ahead, back)
    assert np.allclose(got, moves) and np.isclose(number, toxic)
    got, number = toxicity.expected_moves(*(x[:0] for x in words[:3]), *words[3:], np.zeros((0, 2)), np.zeros((0, 2)))
    assert np.isclose(got.sum(), sum(sizes) - len(sizes)) and 0 < number < sum(sizes)


def brute_toxicity(text, model):
    """Score of a text from its words: forward and backward over all of them, the marginals of those with a weight summed."""
    weight = dict(zip(model["words"].tolist(), model["weights"].tolist()))
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())
    marks = [toxicity.tokens(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[3][:, 0].tolist() for w in words]
    known = [any(m in weight for m in each) for each in marks]
    emit = [np.exp([0, sum(weight.get(m, 0) for m in each)]) for each in marks]
    step = np.exp(np.array(model["move"])) * np.exp([0, model["bias"]])[None]
    ahead, back = [], [np.ones(2)]
    for t, e in enumerate(emit):
        a = (ahead[-1] @ step if t else np.exp([0, model["bias"]])) * e
        ahead.append(a / a.sum())
    for e in emit[:0:-1]:
        b = step @ (back[-1] * e)
        back.append(b / b.sum())
    p = [x * y for x, y in zip(ahead, back[::-1])]
    evidence = sum(x[1] / x.sum() for x, k in zip(p, known) if k)
    return 1 / (1 + math.exp(-(model["slope"] * math.log1p(evidence) + model["shift"])))


def test_cross_fitting_sees_no_near_copy(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(400)], 300)) for _ in range(60)]
    near = [t + " tail" for t in texts]
    assert (toxicity.fold_of(pa.array(texts)) == toxicity.fold_of(pa.array(near))).mean() > 0.95 and len(set(toxicity.fold_of(pa.array([*texts, "", None])).tolist())) == toxicity.FOLDS
    # labels that no word explains: what a chain has learnt by heart must not become a verdict
    docs = spark.createDataFrame([(i, t, int(rng.integers(0, 4) == 0)) for i, t in enumerate(" ".join(rng.choice([f"w{i}" for i in range(3000)], 60)) for _ in range(400))], "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert toxicity.score(docs, model).where("predicted = 1 and doc.toxic = 0").count() <= 8


def test_toxic_spans(spark, odd, none):
    rng = np.random.default_rng(0)
    plain = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        words = rng.choice(plain, 40).tolist()
        if i % 4 == 0:
            for _ in range(3):
                words[int(rng.integers(0, 40))] = str(rng.choice(["Idiot", "scumbag", "vilest"])) + str(rng.choice(["", "s", "er"]))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.where("doc_id < 300").select("doc_id", "toxic"))
    got = toxicity.score(docs, model).select("doc.*", "score", "predicted", "spans").collect()
    assert all(r.predicted == r.toxic for r in got if r.doc_id >= 300)
    hit = next(r for r in got if r.predicted)
    assert all(re.match("(?i)idiot|scumbag|vilest", hit.text[s.start : s.end]) for s in hit.spans) and hit.spans
    assert np.allclose([r.score for r in got], [brute_toxicity(r.text, model) for r in got])
    long = spark.createDataFrame([(0, " ".join(f"W{i % 211}é" for i in range(30_000)) + " Idiots"), (1, "idiot " * 5)], "doc_id long, text string")
    assert all(np.isclose(r.score, brute_toxicity(r.doc.text, model)) for r in toxicity.score(long, model).collect())
    edge = toxicity.score(odd, model)
    assert edge.count() == odd.count() and {r.predicted for r in edge.select("predicted").collect()} == {0}
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(docs, docs.where("toxic = 0").select("doc_id", "toxic")) is None
    assert {r.score for r in toxicity.score(odd, None).select("score").collect()} == {0.0}


def test_mixing_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.sql(mixing.ORACLE).fetchall())
    got = sorted(map(tuple, mixing.query(spark, sf).select("doc_id", "size", "source_size", "target", "taken").collect()))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), (None, 10), ("c", 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # 2415 to share by 5:2:1:5 (a, b, c, null): a and null stop at 200 and 20, the rest is shared 2:1 and c stays below its cap
    assert got["a"] == 200 and got[None] == 20 and abs(got["b"] - 2 * (2415 - 220) / 3) < 1e-9 and abs(got["c"] - (2415 - 220) / 3) < 1e-9


def test_mixing_edges(odd, none):
    sized, plan = mixing.mix_plan(odd)
    assert sized.count() == odd.count() and plan.count() == 3
    mixed = mixing.stage(odd.sparkSession, odd, "")
    assert mixed.columns == odd.columns and mixed.count() > 0
    sized, plan = mixing.mix_plan(none)
    assert sized.count() == 0 and plan.count() == 0 and mixing.stage(none.sparkSession, none, "").count() == 0


def brute_lm(rows, learn):
    token = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
    count = Counter(w for d, t in rows if learn(d) for w in token(t))
    n, v = sum(count.values()), len(count)
    floor = math.log10(n + 0.1 * (v + 1))
    return n, [(len(w), sum(count[x] > 0 for x in w), sum(math.log10(count[x] + 0.1) - floor for x in w)) for w in (token(t) for _, t in rows)]


def test_language_model(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = bloom_lm.scores(odd, F.col("doc_id") % 3 != 0).collect()
    n, want = brute_lm(rows, lambda d: d is not None and d % 3 != 0)
    assert {r.train_tokens for r in got} == {n} and len(got) == len(rows)
    key = lambda x: (x[0], x[1], round(x[2], 6))
    assert sorted(key((r.n_tokens, r.n_known, r.base_score)) for r in got) == sorted(map(key, want))
    assert all(r.score < 0 for r in got) and bloom_lm.scores(none, F.lit(True)).count() == bloom_lm.scores(none, F.lit(True), broadcast_bytes=-1).count() == 0
    key = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score) for r in rows)
    assert key(got) == key(bloom_lm.scores(odd, F.col("doc_id") % 3 != 0, broadcast_bytes=0).collect())
    assert key(got) == key(bloom_lm.scores(odd, F.col("doc_id") % 3 != 0, pieces_a_group=1).collect())
    untrained = bloom_lm.scores(odd, F.lit(False)).collect()
    assert len(untrained) == len(rows) and {r.train_tokens for r in untrained} == {0}


def brute_scores(rows, learn):
    """The model over dictionaries of exact counts, quantised as the filter does it."""
    token = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
    pairs = lambda w: list(zip(["<start>", *w], w))
    known = [token(t) for d, t in rows if learn(d)]
    c1, c2 = Counter(x for w in known for x in w), Counter(x for w in known for x in pairs(w))
    n, often = sum(c1.values()), [c for c in c1.values() if c > 1]
    read = lambda c: 2 * 1.5 ** (math.floor(math.log(c / 2, 1.5) + 1e-9) + 0.5) if c > 1 else 0.0
    rare = max(n - sum(often), 0.5) / n / (len(c1) - len(often) + 1)
    out = []
    for _, t in rows:
        total = 0.0
        for before, x in pairs(token(t)):
            p, both, context = read(c1[x]), read(c2[before, x]), read(c1[None if before == "<start>" else before])
            total += math.log10(0.15 * min(1, both / max(context, both, 1)) + 0.85 * (min(p / n, 0.999) if p else rare))
        out.append(total)
    return out


def test_scores_against_exact_counts(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, 300), 5000))) for i in range(60)] + [(60, None), (61, "one"), (62, "One one")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one, apart = (sorted(bloom_lm.scores(table, F.col("doc_id") % 10 != 0, broadcast_bytes=most).collect()) for most in (bloom_lm.BROADCAST, 0))
    assert one == apart
    off = [abs(r.score - want) / r.n_tokens for r, want in zip(one, brute_scores(rows, lambda d: d % 10 != 0), strict=True)]
    assert np.median(off) < 0.01 and max(off) < 0.1


def test_salted_buckets_and_words_of_all_documents(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "everywhere " + " ".join(f"w{x}" for x in rng.integers(0, 300, 12))) for i in range(3000)] + [(5, "everywhere")] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    learn = F.col("doc_id") % 10 != 0
    whole, salted, apart = (sorted(bloom_lm.scores(table, learn, **how).collect()) for how in ({}, {"pieces_a_group": 1}, {"pieces_a_group": 2, "broadcast_bytes": 0}))
    assert whole == salted == apart
    n, want = brute_lm(rows, lambda d: d % 10 != 0)
    want = sorted((d, *w) for (d, _), w in zip(rows, want))
    assert all((r.doc_id, r.n_tokens, r.n_known) == w[:3] and abs(r.base_score - w[3]) < 1e-6 for r, w in zip(whole, want, strict=True))
    sent = table.select(F.xxhash64("doc_id").alias("k"), F.xxhash64("text").alias("o"), learn.alias("train"), "text").coalesce(2).mapInArrow(bloom_lm._words(3), bloom_lm._ddl(bloom_lm._ASKED))
    pieces, held = sent.where("bucket < 0").count(), sent.where("bucket >= 0").agg(F.sum(F.length("hashes") + F.length("counts"))).first()[0]
    assert held == pieces * 12 * 302  # 300 words, the one of all documents and the end: nothing a document


def test_filter_counts():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    c = np.maximum(2, (rng.pareto(1, 3000) * 3).astype(np.int64))
    part, names = (h >> np.uint64(61)).astype(int), (h << np.uint64(3)) >> np.uint64(24)
    filter_ = bloom_lm.Filter([bloom_lm.segment(names[part == k], c[part == k]) for k in range(8)])
    got = filter_.counts(h)
    assert (got > 0).all() and np.median(np.abs(np.log(got / c))) < 0.25
    assert (filter_.counts(rng.integers(0, 2**63, 3000, dtype=np.uint64)) > 0).mean() < 0.05


def test_language_id(spark, odd, none):
    rng = np.random.default_rng(0)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "aeiou"}
    rows = [(i, " ".join("".join(rng.choice(list(letters[k]), int(rng.integers(2, 8)))) for _ in range(40)), k) for i, k in enumerate(sorted(letters) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id < 120"))
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert np.mean([got[i] == k for i, _, k in rows if i >= 120]) > 0.95
    edge = language_id.predict(odd, model).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(edge) == odd.count()
    for r in edge:
        if r.doc_id is not None and not any(map(str.isalpha, texts[r.doc_id] or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert language_id.predict(none, model).count() == 0 and language_id.fit(none) is None


def test_folded_tables_equal_the_network():
    net = language_id.Network(["a", "b"])
    text = "some bytes to look at, é"
    raw = np.frombuffer(text.encode(), np.uint8)
    x = np.zeros(language_id.WINDOW + language_id.TAPS - 1, np.uint8)
    x[: len(raw)] = raw
    e = net.p["embed"][x]
    seen = np.concatenate([e[t : t + language_id.WINDOW] for t in range(language_id.TAPS)], axis=1)
    h = np.maximum((seen @ net.p["conv"].reshape(-1, seen.shape[1] // 32 * 24) + net.p["bias"]).max(0), 0)
    z = h @ net.p["out"] + net.p["prior"]
    assert np.allclose(language_id.classify(pa.array([text]), net.tables())[0], z - np.log(np.exp(z).sum()), atol=1e-4)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != "packing":
            assert docs.columns == columns
            docs = docs.persist()
            counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    assert {"sequence_id", "offset", "length"} <= set(docs.columns) and docs.count() > 0
    ran = corpus_pipeline.run(spark, sf)
    assert sorted(ran.select("doc_id", "piece", "ids_crc32").collect()) == sorted(docs.select("doc_id", "piece", "ids_crc32").collect())


def test_stages_on_odd_tables(spark, sf, odd, none):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        for table in (odd, none):
            got = stage(spark, table, sf)
            rows = got.count()
            assert (rows > 0) == (table is odd) and (name == "packing" or got.columns == table.columns), name


def test_pipeline_keeps_clean_documents(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, sf)
    clean = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").select("doc_id")
    lost = docs.join(clean, "doc_id").join(kept, "doc_id", "left_anti").count()
    assert lost <= 0.05 * clean.count()


def test_entry_registers_everything():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_nothing_else_imports_this_subpackage():
    from pathlib import Path

    import quillscan

    root = Path(quillscan.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "quillscan.llm" in p.read_text()]


pytestmark = pytest.mark.filterwarnings("ignore")
