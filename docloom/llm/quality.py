"""Quality scores by attention over the passages of a document (multiple-instance learning).

Every document is cut into passages of PASSAGE characters. A passage is encoded by what its
characters are (letters, capitals, digits, punctuation, symbols, runs), by hashed character pairs, by
how well it compresses and by how much of it occurred earlier in the document. A network with gated
attention learns from document labels alone which passages tell: with h = tanh(W x + b), a passage
weighs softmax(w . (tanh(V h) * sigmoid(U h))), and the document's score is the sigmoid of a
linear function of the weighted sum of h.

The network is fitted on the driver to at most ``train_docs`` labelled documents in an order given by a hash (a
parameter), fewer if their passages come to more than ``numbers`` numbers. Each is represented by
all its passages; every document is scored by all its passages.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out

PASSAGE = 512
PAIRS = 96
TRAIN_DOCS = 4000
TRAIN_NUMBERS = 8_000_000  # most numbers the driver gets: passages times features
EPOCHS = 40
HIDDEN = 24
GATE = 12
CUT = 0.3
SEED = 9

_BASE = 16
FEATURES = _BASE + PAIRS


def _table() -> np.ndarray:
    """Character classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence mark, 6 symbol, 7 line end."""
    t = np.zeros(0x3000, np.uint8)
    for c in range(len(t)):
        s = chr(c)
        t[c] = 7 if s == "\n" else 4 if s.isspace() else 3 if s.isdigit() else 1 if s.islower() or (s.isalpha() and not s.isupper()) else 2 if s.isupper() else 5 if s in ".,;:?'\"-()" else 6
    return t


_CLASS = _table()
_PLACES = np.random.default_rng(SEED).integers(1, 1 << 62, 64, dtype=np.uint64)


def encode(text: str) -> np.ndarray:
    """A row of features per passage; an empty text has one row of zeros."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(c)
    if not n:
        return np.zeros((1, FEATURES), np.float32)
    k = -(-n // PASSAGE)
    at = np.arange(0, n, PASSAGE)
    size = np.diff(np.append(at, n)).astype(np.float32)
    kind = _CLASS[np.minimum(c, len(_CLASS) - 1)]
    out = np.zeros((k, FEATURES), np.float32)
    where = np.arange(n) // PASSAGE
    out[:, :8] = np.bincount(where * 8 + kind, minlength=k * 8).reshape(k, 8) / size[:, None]
    word = (kind == 1) | (kind == 2)
    start = word & ~np.concatenate([[False], word[:-1]])
    words = np.add.reduceat(start, at, dtype=np.float32)
    out[:, 8] = np.add.reduceat(word, at, dtype=np.float32) / np.maximum(words, 1) / 8
    same = np.concatenate([[False], c[1:] == c[:-1]])
    out[:, 9] = np.add.reduceat(same, at, dtype=np.float32) / size
    grams = np.zeros(n, np.uint64)
    for j in range(min(8, n)):  # strings of eight characters, to see what came before
        grams[: n - j] = grams[: n - j] * np.uint64(0x9E3779B97F4A7C15) + c[j:]
    grams ^= grams >> np.uint64(32)
    first = np.zeros(n, bool)
    first[np.unique(grams, return_index=True)[1]] = True
    out[:, 10] = 1 - np.add.reduceat(first, at, dtype=np.float32) / size
    parts = [text[i : i + PASSAGE].encode() for i in range(0, n, PASSAGE)]
    out[:, 11] = [len(zlib.compress(p, 1)) / len(p) for p in parts]
    out[:, 12] = math.log1p(n) / 10
    begin = np.flatnonzero(start)
    if len(begin):  # words that repeat the word before
        place = np.arange(n) - begin[np.maximum(np.searchsorted(begin, np.arange(n), side="right") - 1, 0)]
        small = np.where(kind == 2, c + 32, c).astype(np.uint64)
        value = np.add.reduceat(np.where(word, small * _PLACES[place % 64], np.uint64(0)), begin)
        again = np.concatenate([[False], value[1:] == value[:-1]])
        out[:, 13] = np.bincount(begin // PASSAGE, again, k) / np.maximum(words, 1)
    out[:, 14] = np.add.reduceat(kind == 7, at, dtype=np.float32) / np.maximum(words, 1)
    caps = (kind == 2) & np.concatenate([[False], kind[:-1] == 2])
    out[:, 15] = np.add.reduceat(caps, at, dtype=np.float32) / size
    low = np.where(kind == 4, 32, c).astype(np.uint64)
    pair = np.zeros(n, np.int64)
    pair[:-1] = ((low[:-1] * np.uint64(0x9E3779B1) + low[1:] * np.uint64(0x85EBCA6B)) >> np.uint64(9)).astype(np.int64) % PAIRS
    out[:, _BASE:] = np.sqrt(np.bincount(where * PAIRS + pair, minlength=k * PAIRS).reshape(k, PAIRS) / size[:, None])
    return out


class Network:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def fresh(cls, features: int) -> Network:
        rng = np.random.default_rng(SEED)
        return cls({"W": rng.normal(0, 1 / math.sqrt(features), (features, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1), "mean": np.zeros(features), "scale": np.ones(features)})

    def forward(self, x: np.ndarray, at: np.ndarray):
        """x: passages of several documents; at: where each document starts. Logits and what backward needs."""
        p = self.p
        z = (x - p["mean"]) * p["scale"]
        h = np.tanh(z @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        s = (v * u) @ p["w"]
        sizes = np.diff(np.append(at, len(x)))
        doc = np.repeat(np.arange(len(at)), sizes)
        e = np.exp(s - np.maximum.reduceat(s, at)[doc])
        a = e / np.add.reduceat(e, at)[doc]
        m = np.add.reduceat(a[:, None] * h, at)
        return m @ p["c"] + p["d"][0], (z, h, v, u, a, m, doc)

    def backward(self, g: np.ndarray, kept) -> dict[str, np.ndarray]:
        p = self.p
        z, h, v, u, a, m, doc = kept
        dm = g[:, None] * p["c"]
        dh = a[:, None] * dm[doc]
        ds = a * ((h - m[doc]) * dm[doc]).sum(1)
        dv = ds[:, None] * p["w"] * u * (1 - v * v)
        du = ds[:, None] * p["w"] * v * u * (1 - u)
        dh += dv @ p["V"].T + du @ p["U"].T
        dz = dh * (1 - h * h)
        return {"c": m.T @ g, "d": np.array([g.sum()]), "w": (v * u).T @ ds, "V": h.T @ dv, "U": h.T @ du, "W": z.T @ dz, "b": dz.sum(0)}


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> Network:
    net = Network.fresh(FEATURES)
    if not len(bags):
        net.p["c"][:] = 0
        return net
    every = np.vstack(bags)
    net.p["mean"], net.p["scale"] = every.mean(0), 1 / (every.std(0) + 0.02)
    rate = float(np.clip(y.mean(), 0.01, 0.99))
    net.p["d"][0] = math.log(rate / (1 - rate))
    rng = np.random.default_rng(SEED)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for start in range(0, len(order), 64):
            part = order[start : start + 64]
            x = np.vstack([bags[k] for k in part])
            at = np.cumsum([0] + [len(bags[k]) for k in part[:-1]])
            logit, kept = net.forward(x, at)
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[part]) / len(part)
            step += 1
            for k, d in net.backward(g, kept).items():
                d = d + (1e-4 * net.p[k] if k in ("W", "V", "U") else 0)
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                net.p[k] = net.p[k] - 0.01 * (1 - epoch / (epochs + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, numbers: int = TRAIN_NUMBERS) -> Network:
    """Fit to labelled rows not held out: docs (doc_id, text), labels (doc_id, quality).

    Labels of one document that disagree count as the highest; of rows that share a doc_id one is taken, by
    a hash of its text. In hash order documents are taken whole while they fit the bound on numbers.
    """
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = known.orderBy(order, "doc_id").limit(train_docs)
    text = F.coalesce("text", F.lit(""))
    joined = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("mark")).join(F.broadcast(chosen), "doc_id")  # train_docs rows at most
    size = F.greatest(F.ceil(F.length("text") / PASSAGE), F.lit(1)).cast("long") * FEATURES
    sizes = joined.groupBy("doc_id").agg(F.min(F.struct("mark", size.alias("size"))).alias("least")).select("doc_id", "least.mark", "least.size", order.alias("o"))
    fits, left = [], numbers
    for r in sorted(sizes.collect(), key=lambda r: (r["o"], r["doc_id"])):  # train_docs rows at most
        if r["size"] <= left:
            fits.append((r["doc_id"], r["mark"]))
            left -= r["size"]

    def rows(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "x": [encode(text).tobytes() for text in batch["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    taken = docs.sparkSession.createDataFrame(fits, f"doc_id {kind}, mark long")
    once = joined.join(F.broadcast(taken), ["doc_id", "mark"]).dropDuplicates(["doc_id"])
    found = once.select("doc_id", "quality", "text").mapInPandas(rows, f"doc_id {kind}, quality int, x binary").collect()  # bounded by numbers
    found.sort(key=lambda r: r["doc_id"])
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in found]
    return train(bags, np.array([float(r["quality"] > 0) for r in found]))


def score(docs: DataFrame, labels: DataFrame | None = None, network: Network | None = None, cut: float = CUT) -> DataFrame:
    """Score each row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, held_out, score (0 to 1, high for good), predicted (1 if score >= cut). Null text
    counts as empty, and an empty text is one passage without features. Without labels every score
    is 0.5. Rows are treated one by one, so repeated rows and null ids need no rule; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    if network is None:
        network = fit(docs, labels) if labels is not None else train([], np.zeros(0))
    shared = spark.sparkContext.broadcast(network)  # a few thousand numbers

    def run(batches):
        net = shared.value
        for batch in batches:
            got = np.zeros(len(batch))
            held, rows, size = [], [], 0

            def settle():
                logit, _ = net.forward(np.vstack(held), np.cumsum([0] + [len(x) for x in held[:-1]]))
                got[rows] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                held.clear()
                rows.clear()

            for k, text in enumerate(batch["text"]):
                x = encode(text)
                held.append(x)
                rows.append(k)
                size += len(x)
                if size > 4000:
                    settle()
                    size = 0
            if held:
                settle()
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": got, "predicted": (got >= cut).astype("int32")})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
