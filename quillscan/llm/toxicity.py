"""Toxic spans tagged by a linear-chain conditional random field, and document scores from its marginals.

Labels are given for documents, so tokens are labelled first: a logistic regression over the words and word
beginnings of the sampled documents finds those whose presence marks toxic documents, and their occurrences in
toxic documents are the positive tokens. A two-state chain (clean, toxic) with a weight per such feature, a bias and four
transition weights is then fitted to those token labels by gradient ascent on the conditional likelihood.

Most words carry no weight, and between two weighted words the chain is a power of one constant matrix. So
forward and backward passes run over the weighted words alone, with those powers in closed form, which gives
the exact marginals. A document's evidence is the sum of its toxic marginals. A logistic curve of it turns it into a
probability. The curve is fitted by cross-fitting: evidence comes from chains that have seen neither the document nor its
near copies, and is computed on the executors for texts of all lengths, so only numbers and labels come back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.llm._bytes import ALNUM, flat, lean, mix, pieces, prefix, release, span, words
from quillscan.llm._store import crc_part, documents, small_batches

#: Bound of the training sample: documents of either label, drawn among those of at most so many characters.
SAMPLE_DOCS, SAMPLE_CHARS = 1200, 10_000
#: Bound of the sample of either label that sets the curve from evidence to score, of any length; and parts for cross-fitting.
CURVE_DOCS, FOLDS = 4000, 3
MIN_DOCS, STEPS, ASCENT = 3, 300, 100
#: Lengths in bytes of the prefixes that are features beside the whole word.
PREFIXES = (4, 5, 6)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words (runs of letters and digits, A-Z lower-cased), and their features.

    Features are hashes, one row for the whole word and one for each prefix length; 0 where a word is too short.
    """
    starts, ends, row = words(raw, offsets, ALNUM)
    sums = prefix(raw, fold=True)
    out = np.zeros((1 + len(PREFIXES), len(starts)), np.uint64)
    out[0] = span(sums, starts, ends)
    for k, n in enumerate(PREFIXES, 1):
        longer = ends - starts > n
        out[k, longer] = span(sums, starts[longer], starts[longer] + n) ^ np.uint64(k)
    return starts, ends, row, out


def known_of(features: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of features in the ascending ``known``, -1 for others."""
    at = np.minimum(np.searchsorted(known, features), len(known) - 1)
    at[known[at] != features] = -1
    return at


def _steps(model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The matrix of one step of the chain, scaled to largest eigenvalue 1, and its eigenvalues and vectors (right, left)."""
    step = np.exp(np.array(model["move"])) * np.exp(np.array([0.0, model["bias"]]))[None, :]
    values, right = np.linalg.eig(step)  # real and distinct, as all entries are positive
    values, right = values.real, right.real
    top = np.abs(values).max()
    return step / top, values / top, right, np.linalg.inv(right)


def chain(row: np.ndarray, place: np.ndarray, gain: np.ndarray, sizes: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal probability of the toxic state at every weighted word, and the messages from its left (with it) and right.

    ``row`` and ``place`` (its number among the row's words) ascend; ``gain`` is the word's weight; ``sizes`` has
    the number of words of each row. Rows are worked through together, from first to last weighted word.
    """
    if not len(row):
        return np.zeros(0), np.zeros((0, 2)), np.zeros((0, 2))
    _, values, right, left = _steps(model)

    def power(k):
        return np.einsum("ij,nj,jk->nik", right, values[None, :] ** k[:, None], left)

    first = np.r_[True, row[1:] != row[:-1]]
    begin = np.flatnonzero(first)
    run = np.diff(np.r_[begin, len(row)])
    order = np.argsort(-run, kind="stable")
    begin, run = begin[order], run[order]
    boost = np.exp(np.clip(gain, -30, 30))
    before = np.where(first, place, np.r_[0, place[1:] - place[:-1]])
    after = np.where(np.r_[first[1:], True], sizes[row] - 1 - place, 0)
    ahead, back = np.empty((len(row), 2)), np.empty((len(row), 2))
    start = np.array([1.0, np.exp(model["bias"])])
    live = len(begin)
    for k in range(run.max()):
        live = np.searchsorted(-run, -k, "left")
        at = begin[:live] + k
        m = power(before[at])
        a = (start @ m) if k == 0 else np.einsum("ni,nij->nj", ahead[at - 1], m)
        a = a * np.stack([np.ones(live), boost[at]], 1)
        ahead[at] = a / a.sum(1, keepdims=True)
    for k in range(run.max() - 1, -1, -1):
        live = np.searchsorted(-run, -k, "left")
        at = begin[:live] + k
        last = run[:live] == k + 1
        b = np.empty((live, 2))
        if last.any():
            b[last] = power(after[at[last]]).sum(2)
        if not last.all():
            nxt = at[~last] + 1
            b[~last] = np.einsum("nij,nj->ni", power(before[nxt]), back[nxt] * np.stack([np.ones(len(nxt)), boost[nxt]], 1))
        back[at] = b / b.sum(1, keepdims=True)
    p = ahead * back
    return p[:, 1] / p.sum(1), ahead, back


def expected_moves(row: np.ndarray, place: np.ndarray, gain: np.ndarray, sizes: np.ndarray, model: dict, ahead: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected numbers of the four transitions, and of toxic words, over all words of all rows.

    Between two weighted words (or an end of the text) k transitions pass; the sum over them of the chain's state before and
    after is a geometric one in the eigenvalues of the step.
    """
    step, values, right, left = _steps(model)
    start, ones = np.array([1.0, np.exp(model["bias"])]), np.ones(2)
    seen = back * np.stack([np.ones(len(row)), np.exp(np.clip(gain, -30, 30))], 1)
    first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    last = np.r_[first[1:], True] if len(row) else first
    bare = np.setdiff1d(np.flatnonzero(sizes > 0), row)
    inner = np.flatnonzero(~first)
    tile = lambda v, n: np.broadcast_to(v, (n, 2))
    a = np.concatenate([tile(start, first.sum()), ahead[inner - 1], ahead[last], tile(start, len(bare))])
    b = np.concatenate([seen[first], seen[inner], tile(ones, last.sum()), tile(ones, len(bare))])
    k = np.concatenate([place[first], place[inner] - place[inner - 1], (sizes[row] - 1 - place)[last], sizes[bare] - 1]).astype(float)
    a, b = a @ right, b @ left.T
    powers = values[None, :] ** k[:, None]
    both = (a * powers * b).sum(1)
    across = (powers[:, 0] - powers[:, 1]) / (values[0] - values[1])
    once = k[:, None] * values[None, :] ** np.maximum(k - 1, 0)[:, None]
    sums = np.empty((len(k), 2, 2))
    sums[:, 0, 0], sums[:, 1, 1], sums[:, 0, 1], sums[:, 1, 0] = once[:, 0], once[:, 1], across, across
    moves = step * np.einsum("np,pi,npq,jq,nq->ij", a, left, sums / both[:, None, None], right, b)
    begins = np.r_[np.arange(first.sum()), len(k) - len(bare) + np.arange(len(bare))].astype(int)
    at_start = start[1] * ((powers * b)[begins] @ right[1]) / both[begins]
    return moves, float(moves[:, 1].sum() + at_start.sum())


def tagged(texts: pa.Array, model: dict):
    """For every row its evidence, and for every weighted word (row, byte start, byte end, marginal)."""
    raw, offsets = flat(texts)
    evidence = np.zeros(len(offsets) - 1)
    found = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0)]]
    known, weight = model["words"], model["weights"]
    for a, b in pieces(offsets, most_rows=20_000):
        r, cut = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, row, features = tokens(r, cut)
        at = known_of(features, known)
        hit = np.flatnonzero((at >= 0).any(axis=0))
        sizes = np.bincount(row, minlength=b - a)
        gain = np.where(at[:, hit] >= 0, weight[at[:, hit]], 0).sum(axis=0)
        p = chain(row[hit], hit - (np.cumsum(sizes) - sizes)[row[hit]], gain, sizes, model)[0]
        evidence[a:b] = np.bincount(row[hit], weights=p, minlength=b - a)
        found.append([row[hit] + a, starts[hit] - cut[row[hit]], ends[hit] - cut[row[hit]], p])
    return evidence, [np.concatenate(c) for c in zip(*found)]


def copies(rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
    """Two least hashes of each row's features, which near copies of a text share; 0 for a row without words."""
    least = np.zeros((2, n), np.uint64)
    begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
    for k in range(2):
        if len(rows):
            each = np.where(features > 0, mix(features ^ np.uint64(k)), ~np.uint64(0)).min(axis=0)
            least[k, rows[begin]] = np.minimum.reduceat(each, begin)
    return least


def fold_of(texts: pa.Array) -> np.ndarray:
    """Part for cross-fitting of each text, the same for most near copies."""
    raw, offsets = flat(texts)
    out = np.zeros(len(offsets) - 1, np.int64)
    for a, b in pieces(offsets, most_rows=20_000):
        rows, features = tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[2:]
        out[a:b] = (copies(rows, features, b - a)[0] >> np.uint64(20)) % np.uint64(FOLDS)
    return out


def fit_chain(texts: list[str], labels: np.ndarray) -> dict | None:
    """The chain from labelled texts; None where there is none of either label, or no word that tells them apart."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return None
    raw, offsets = flat(pa.array(texts, pa.string()))
    rows, features = tokens(raw, offsets)[2:]
    # one entry for each feature of a document
    every, code = np.unique(features, return_inverse=True)
    code = code.reshape(features.shape)
    pair = np.unique(rows * len(every) + code)
    row, col = np.divmod(pair[every[pair % len(every)] > 0], len(every))
    # near copies of a document count together as one
    members = np.unique(copies(rows, features, len(y)), axis=1, return_inverse=True, return_counts=True)
    group, members = members[1], members[2]
    share = 1 / members[group.reshape(-1)]
    bad = np.bincount(col, weights=(y * share)[row], minlength=len(every))
    good = np.bincount(col, weights=((1 - y) * share)[row], minlength=len(every))
    scale = share * np.where(y > 0, 0.5 / (y * share).sum(), 0.5 / ((1 - y) * share).sum())
    # a feature must lean to toxic documents by more than the best of so many features would by chance
    total = np.array([(y * share).sum(), ((1 - y) * share).sum()])
    expected = np.outer(total / total.sum(), bad + good)
    strength = 2 * sum(np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(e, 1e-9)), 0) for seen, e in zip((bad, good), expected))
    leans = (bad >= MIN_DOCS) & (bad / total[0] >= 3 * (good + 0.5) / total[1]) & (strength >= 2 * np.log(len(every)))
    if not leans.any():
        return None
    place_of = np.where(leans, np.cumsum(leans) - 1, -1)
    keep = leans[col]
    row, col, vocab = row[keep], place_of[col[keep]], every[leans]

    def into(e):  # gradient with regard to the features' weights and the bias
        return np.append(np.bincount(col, weights=e[row], minlength=len(vocab)), e.sum())

    def out(w):
        return w[-1] + np.bincount(row, weights=w[col], minlength=len(y))

    u = np.ones(len(vocab) + 1)
    for _ in range(15):
        u = into(scale * out(u))
        bend = np.linalg.norm(u)
        u /= bend
    w = last = np.zeros(len(vocab) + 1)
    for t in range(STEPS):  # Nesterov's method, so that features of many documents weigh more than those of a few
        v = w + t / (t + 3) * (w - last)
        e = (1 / (1 + np.exp(-np.clip(out(v), -30, 30))) - y) * scale
        last, w = w, v - (into(e) + 1e-3 * np.append(v[:-1], 0)) / (0.3 * bend + 1e-3)
    w = w[:-1]
    # token labels: in toxic documents, the words about as telling as such documents' most telling ones
    at = place_of[code]
    telling = np.where(at >= 0, w[at], 0).sum(axis=0)
    most = np.zeros(len(y))
    np.maximum.at(most, rows, telling)
    tag = ((telling >= 0.4 * np.median(most[y > 0])) & (telling > 0) & (y[rows] > 0)).astype(int)
    if not tag.any():
        return None
    used = np.unique(at[:, tag > 0])
    known = vocab[used[used >= 0]]
    at = known_of(features, known)
    # all weights by ascent of the conditional likelihood of the tags with exact marginals: what is seen less what is expected
    size = np.bincount(rows, minlength=len(y))
    place = np.arange(len(rows)) - (np.cumsum(size) - size)[rows]
    inner = rows[1:] == rows[:-1]
    seen, toxic = np.ones((2, 2)), 1.0 + tag.sum()
    np.add.at(seen, (tag[:-1][inner], tag[1:][inner]), 1)
    rate = seen / seen.sum(1, keepdims=True)
    hit = np.flatnonzero((at >= 0).any(axis=0))
    at, rows, place = at[:, hit], rows[hit], place[hit]
    on, (kind, token) = at[at >= 0], np.nonzero(at >= 0)
    total = lambda x: np.bincount(on, weights=x[token], minlength=len(known))
    bias = float(np.log(rate[0, 1] / rate[0, 0]))
    gain, model = np.zeros(len(known)), {"words": known, "bias": bias, "move": (np.log(rate) - np.array([0.0, bias])).tolist()}
    sums = lambda: np.where(at >= 0, gain[at], 0).sum(axis=0)
    positive = total(tag[hit].astype(float))
    for _ in range(ASCENT):
        p, ahead, back = chain(rows, place, sums(), size, model)
        moves, toxic_now = expected_moves(rows, place, sums(), size, model, ahead, back)
        slope = positive - total(p) - 0.05 * gain
        bend = len(at) * total(p * (1 - p)) + 0.05 + 0.02 * total(np.ones(len(hit)))
        gain = np.clip(gain + np.clip(slope / bend, -1, 1), -25, 25)
        move = np.array(model["move"])
        move += np.clip((seen - moves - 0.05 * move) / (seen + moves), -0.5, 0.5)
        model["move"], model["bias"] = move.tolist(), model["bias"] + float(np.clip((toxic - toxic_now - 0.05 * model["bias"]) / (toxic + toxic_now), -0.5, 0.5))
    return model | {"weights": gain}


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Logistic curve of log(1 + evidence), each row with its weight; its slope is not negative."""
    a, c, x = 1.0, -1.0, np.log1p(x)
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * x + c, -30, 30)))
        g = np.array([((q - y) * x * weight).sum() + 1e-3 * a, ((q - y) * weight).sum()])
        s = q * (1 - q) * weight
        hess = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        move_by = np.linalg.solve(hess, g)
        a, c = max(a - np.clip(move_by[0], -1, 1), 0.0), c - np.clip(move_by[1], -1, 1)
    return {"slope": float(a), "shift": float(c)}


def evidence_apart(sample: DataFrame, apart: list) -> tuple[np.ndarray, np.ndarray]:
    """Evidence and label of every row of (id, text, label), from the chain fitted without its fold; computed by the tasks."""
    shared = sample.sparkSession.sparkContext.broadcast(apart)

    def run(batches):
        for batch in batches:
            texts, out = batch.column(0), np.zeros(len(batch))
            part = fold_of(texts)
            for k, model in enumerate(shared.value):
                at = np.flatnonzero(part == k)
                if model and len(at):
                    out[at] = tagged(texts.take(pa.array(at)), model)[0]
            yield pa.RecordBatch.from_arrays([pa.array(out), batch.column(1)], names=["evidence", "label"])

    got = sorted(tuple(r) for r in sample.select("text", "label").mapInArrow(lean(run), "evidence double, label int").collect())
    return np.array([g[0] for g in got]), np.array([g[1] for g in got])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id") -> dict | None:
    """Model from a bounded, hash-drawn sample of documents with a label of 0 or 1: about ``sample_docs`` of each.

    Sampling reads the labels alone; the drawn ids, at most about twice ``sample_docs`` of them, are broadcast to
    the documents, whose text is not shuffled. Rows without a label or text are not used, nor are texts of over
    ``SAMPLE_CHARS`` characters, so the driver sees a bounded number of characters.
    """
    label, text, id_ = F.col(f"`{label_col}`").cast("int"), F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    rows = labels.select(id_.alias("labelled"), label.alias("label")).where(F.col("label").isin(0, 1))
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    draw = F.pmod(F.xxhash64("labelled", F.lit("toxic-sample")), F.lit(1 << 30))

    def labelled(most: int) -> DataFrame:
        share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1, most / n) * (1 << 30)))])
        drawn = F.broadcast(rows.where(draw < F.element_at(share, F.col("label"))))
        return docs.select(id_.alias("id"), text.alias("text")).where("text is not null").join(drawn, F.col("id") == F.col("labelled"))

    sample = labelled(sample_docs).where(F.length("text") <= SAMPLE_CHARS)
    got = sorted((r[0], r[1], r[2]) for r in sample.select(F.col("id").cast("string"), "text", "label").collect())
    texts, y = [g[1] for g in got], np.array([g[2] for g in got])
    model, part = fit_chain(texts, y), fold_of(pa.array(texts, pa.string()))
    if model is None:
        return None
    apart = [fit_chain([t for t, k in zip(texts, part) if k != fold], y[part != fold]) for fold in range(FOLDS)]
    del got, texts
    release()
    x, y = evidence_apart(labelled(CURVE_DOCS), apart)
    scale = np.where(y > 0, counts[1] / max((y > 0).sum(), 1), counts[0] / max((y < 1).sum(), 1)) / (counts[0] + counts[1])
    return model | curve(x, y, scale)


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row of ``docs`` (struct ``doc``), score, predicted, spans (start and end in characters, probability) of likelihood 0.5 or more.

    Null and empty texts have no evidence and get the score of none; without a model all scores are 0. Other
    columns are only seen inside ``doc``; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts, net = batch.column(1), shared.value
            n = len(batch)
            q, spans = np.zeros(n), [[] for _ in range(n)]
            if net:
                evidence, (row, start, end, p) = tagged(texts, net)
                q = 1 / (1 + np.exp(-np.clip(net["slope"] * np.log1p(evidence) + net["shift"], -30, 30)))
                raw, offsets = flat(texts)
                for r, s, e, x in zip(*(c[p >= 0.5].tolist() for c in (row, start, end, p))):
                    heads = (raw[offsets[r] : offsets[r] + e] & 0xC0) != 0x80
                    from_char = int(heads[:s].sum())
                    spans[r].append({"start": from_char, "end": from_char + int(heads[s:].sum()), "probability": x})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(q), pa.array((q >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))], names=["doc", "score", "predicted", "spans"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), f"doc {rows.schema['doc'].dataType.simpleString()}, score double, predicted int, spans array<struct<start:int,end:int,probability:double>>")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels to learn from: those of ids whose crc32 is no multiple of 5."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_part("doc_id", 5) != 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of all documents; a null id, whose labels are never learnt, counts as held out.

    Null and empty texts get the score of no evidence; repeated rows are scored alike; an empty table gives no rows.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = score(docs, fit(docs, _labels(spark, sf_dir)))
    return out.select("doc.doc_id", F.coalesce(crc_part("doc.doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", "predicted", "spans")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the columns are those of ``docs``.

    Null and empty texts stay; rows that repeat an id or a text are judged alike; without labels of both kinds all rows
    stay; an empty table gives no rows; other columns are carried along whatever their names.
    """
    small_batches(spark)
    return score(docs, fit(docs, _labels(spark, sf_dir))).where("predicted = 0").select("doc.*")
