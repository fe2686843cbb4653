"""Language identification by a byte convolutional network written in numpy.

Bytes are embedded, filters of several widths run over a fixed-length window, each filter's largest
response in the window passes a rectifier, and a softmax layer gives the languages' probabilities. A
text is covered by consecutive windows from its first byte to its last; their log-probabilities are
averaged by length. When applied, embedding and filters are folded into two tables over byte pairs:
a filter of four taps is one lookup for its first two bytes plus one for its last two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.llm._bytes import flat, lean
from quillscan.llm._store import crc_part, documents

WINDOW, WIDTHS, FILTERS, EMBED, TAPS = 256, (2, 3, 4), 8, 8, 4
#: Bounds of the training sample: documents of each language, and windows of each document.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 4
STEPS, BATCH, RATE = 400, 128, 0.01


class Network:
    def __init__(self, langs: list[str], seed: int = 10):
        rng = np.random.default_rng(seed)
        self.langs, n = langs, FILTERS * len(WIDTHS)
        self.on = np.zeros((TAPS, EMBED, n), np.float32)
        for k, w in enumerate(WIDTHS):
            self.on[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)),
            "conv": rng.normal(0, 0.35, (TAPS, EMBED, n)) * self.on,
            "bias": np.zeros(n),
            "out": rng.normal(0, 0.3, (n, len(langs))),
            "prior": np.zeros(len(langs)),
        }

    def train(self, windows: list[bytes], labels: np.ndarray, seed: int = 11, steps: int = STEPS) -> None:
        """Adam on cross-entropy; batches are balanced over languages, windows cut to random lengths."""
        rng, p = np.random.default_rng(seed), self.p
        mean, var = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        of = [np.flatnonzero(labels == c) for c in range(len(self.langs))]
        for step in range(1, steps + 1):
            pick = np.array([rng.choice(of[c]) for c in rng.integers(0, len(of), BATCH)])
            x = np.zeros((BATCH, WINDOW + TAPS - 1), np.uint8)
            for r, i in enumerate(pick):
                w = np.frombuffer(windows[i][: WINDOW if rng.random() < 0.6 else rng.integers(8, WINDOW)], np.uint8)
                x[r, : len(w)] = w
            y = labels[pick]
            e = p["embed"][x]
            seen = np.stack([e[:, t : t + WINDOW] for t in range(TAPS)], axis=2).reshape(BATCH, WINDOW, -1)
            score = seen @ p["conv"].reshape(TAPS * EMBED, -1) + p["bias"]
            at = score.argmax(axis=1)
            top = np.take_along_axis(score, at[:, None], 1)[:, 0]
            h = np.maximum(top, 0)
            z = h @ p["out"] + p["prior"]
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            dz = q.copy()
            dz[np.arange(BATCH), y] -= 1
            dz /= BATCH
            dh = dz @ p["out"].T * (top > 0)
            patch = seen[np.arange(BATCH)[:, None], at]
            dpatch = (dh[:, :, None] * p["conv"].reshape(TAPS * EMBED, -1).T).reshape(-1, EMBED)
            byte = np.stack([np.take_along_axis(x, at + t, 1) for t in range(TAPS)], axis=2)
            dembed = np.zeros_like(p["embed"])
            np.add.at(dembed, byte.reshape(-1), dpatch)
            g = {"embed": dembed, "conv": np.einsum("nf,nfk->kf", dh, patch).reshape(p["conv"].shape) * self.on, "bias": dh.sum(0), "out": h.T @ dz + 1e-4 * p["out"], "prior": dz.sum(0)}
            rate = RATE * (1 if step < 0.7 * steps else 0.2)
            for k in p:
                mean[k] += 0.1 * (g[k] - mean[k])
                var[k] += 0.01 * (g[k] ** 2 - var[k])
                p[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)

    def tables(self) -> dict:
        """What workers need: responses to byte pairs, and the last layer."""
        e, c = self.p["embed"], self.p["conv"]
        by = np.einsum("be,tef->tbf", e, c)
        pair = lambda i: (by[i][:, None] + by[i + 1][None]).reshape(65536, -1).astype(np.float32)
        return {"first": pair(0) + self.p["bias"].astype(np.float32), "second": pair(2), "out": self.p["out"], "prior": self.p["prior"], "langs": self.langs}


def classify(texts: pa.Array, model: dict, most: int = 128) -> np.ndarray:
    """Mean log-probability of each language over a text's windows (rows x languages); zero for empty texts."""
    raw, offsets = flat(texts)
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), count)
    start = offsets[row] + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    length = np.minimum(WINDOW, offsets[row + 1] - start)
    total = np.zeros((len(size), len(model["langs"])))
    steps = np.arange(WINDOW + TAPS - 1)
    for a in range(0, len(row), most):
        s, n = start[a : a + most], length[a : a + most]
        at = s[:, None] + steps
        x = raw[np.minimum(at, len(raw) - 1)].astype(np.int32)
        x[steps >= n[:, None]] = 0
        pair = x[:, :-1] << 8 | x[:, 1:]
        score = model["first"].take(pair[:, :WINDOW].reshape(-1), axis=0)
        score += model["second"].take(pair[:, 2 : WINDOW + 2].reshape(-1), axis=0)
        h = np.maximum(score.reshape(len(s), WINDOW, -1).max(axis=1), 0)
        z = h @ model["out"] + model["prior"]
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        np.add.at(total, row[a : a + most], z * n[:, None])
    return total / np.maximum(size, 1)[:, None]


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> dict | None:
    """Network tables learned from a bounded sample of ``rows`` (null language: not used); None without any.

    About ``sample_docs`` documents of each language are drawn by a hash of their id, with ``SAMPLE_WINDOWS``
    windows of each, so the driver sees a fixed number of bytes for each language.
    """
    lang, text = F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    known = rows.where(lang.isNotNull() & (F.length(text) > 0))
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit("lang-sample")), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1, sample_docs / n) * (1 << 30)))])
    spare = F.greatest(F.length(text) - WINDOW // 2, F.lit(1))
    cuts = [F.substring(text, (F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(k)), spare) + 1).cast("int"), F.lit(WINDOW)) for k in range(SAMPLE_WINDOWS)]
    got = sorted((r[0], w) for r in known.where(draw < F.element_at(share, lang)).select(lang, F.array(*cuts)).collect() for w in r[1])
    langs = sorted({g[0] for g in got}) or sorted(counts)[:1]
    net = Network(langs)
    if got:
        net.train([w.encode()[:WINDOW] for _, w in got], np.array([langs.index(g[0]) for g in got]))
    return net.tables()


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``.

    A text that is null or has no letter is ``und`` with score 0, as is every text where nothing was learned.
    Of equally likely languages the first by name is taken; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts, net, n = batch.column(1), shared.value, len(batch)
            names, score = ["und"] * n, np.zeros(n)
            if net:
                mean = classify(texts, net)
                q = np.exp(mean - mean.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                best = q.argmax(1)
                for i, t in enumerate(texts.to_pylist()):
                    if t and any(map(str.isalpha, t)):
                        names[i], score[i] = net["langs"][best[i]], q[i, best[i]]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score)})

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(crc_part("doc_id", 3) != 1))
    return predict(docs, model).select("doc_id", (crc_part("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
