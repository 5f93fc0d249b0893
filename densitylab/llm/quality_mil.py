"""Quality by attention-based multiple-instance learning (operator 10).

A document is a bag of passages of PASSAGE words.  A passage's features are the
shares of its bytes (ASCII by value, the rest together) and of repeated words.
The model encodes every passage, h = tanh(x W + b), weighs it by gated attention,
a = softmax(w . (tanh(h V) * sigmoid(h U))), and scores the weighted sum of the
h with a logistic unit.  Only documents have labels; the weights of passages are
learned through them.

Training takes a sample by hash of at most about MAX_TRAIN labelled documents and
MAX_BYTES of text, with every passage of them; it runs on the driver over an array
of that bound, SIZE floats for every PASSAGE words.  Scoring takes every passage of
every text.

Defined results: a text without words (null, empty) gets the score of a bag
with one passage of zeros.  Without labels every score is 0.5.  A doc_id with
several labels uses the greatest, one with several texts is learned by the least.
Repeated rows get equal results.  A null doc_id isn't held out.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import documents, in_slices, labelled

PASSAGE, HIDDEN, GATE = 64, 24, 16
MAX_TRAIN, MAX_BYTES, THRESHOLD = 8000, 32 << 20, 0.3
SIZE = 128 + 1 + 4


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features (rows x SIZE) and where each text's passages begin (one passage at least)."""
    blocks, begins, done = [], [], 0
    for w in tv.words(texts, tv.SPACE):
        n = np.diff(w.ptr)
        m = np.maximum(1, -(-n // PASSAGE))
        first = np.cumsum(m) - m
        rows = int(m.sum())
        doc = w.doc_of()
        number = np.arange(len(w.hash)) - w.ptr[doc]
        own = first[doc] + number // PASSAGE
        x = np.zeros((rows, SIZE), np.float32)
        if len(w.hash):
            # a byte belongs to the passage of the last word that began in its document
            step = np.zeros(len(w.data), np.int64)
            step[w.start] = np.diff(np.r_[0, own])
            at = np.cumsum(step)
            lead = w.start[w.ptr[:-1][n > 0]]
            kind = np.minimum(w.data, 128).astype(np.int64)
            inside = np.zeros(len(w.data), bool)
            inside[w.start[0] :] = True
            for d, s in zip(np.flatnonzero(n > 0), lead):
                inside[w.offsets[d] : s] = False
            for d in np.flatnonzero(n == 0):
                inside[w.offsets[d] : w.offsets[d + 1]] = False
            hist = np.bincount(at[inside] * 129 + kind[inside], minlength=rows * 129)[: rows * 129].reshape(rows, 129)
            x[:, :129] = np.sqrt(hist / np.maximum(hist.sum(1, keepdims=True), 1))
            words = np.bincount(own, minlength=rows)
            letters = np.bincount(own, w.end - w.start, rows)
            order = np.lexsort((w.hash, own))
            same = np.r_[False, (own[order][1:] == own[order][:-1]) & (w.hash[order][1:] == w.hash[order][:-1])]
            x[:, 129] = np.bincount(own[order], same, rows) / np.maximum(words, 1)
            whole = np.lexsort((w.hash, doc))
            again = np.r_[False, (doc[whole][1:] == doc[whole][:-1]) & (w.hash[whole][1:] == w.hash[whole][:-1])]
            x[:, 130] = np.bincount(own[whole], again, rows) / np.maximum(words, 1)
            x[:, 131] = np.minimum(letters / np.maximum(words, 1) / 16, 4)
            x[:, 132] = words / PASSAGE
        blocks.append(x)
        begins.append(done + first)
        done += rows
    if not blocks:
        return np.zeros((0, SIZE), np.float32), np.zeros(1, np.int64)
    return np.concatenate(blocks), np.r_[np.concatenate(begins), done]


class Model:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "W": r.normal(0, SIZE**-0.5, (SIZE, HIDDEN)),
            "b": np.zeros(HIDDEN),
            "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "w": r.normal(0, GATE**-0.5, GATE),
            "c": np.zeros(HIDDEN),
            "d": np.zeros(1),
        }
        self.mean, self.scale = np.zeros(SIZE), np.ones(SIZE)

    def forward(self, x: np.ndarray, begin: np.ndarray) -> tuple:
        p = self.p
        first, size = begin[:-1], np.diff(begin)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
        a = e / np.repeat(np.add.reduceat(e, first), size)
        z = np.add.reduceat(h * a[:, None], first, axis=0)
        return h, t, s, a, z, 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def scores(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return self.forward(self.scaled(x), begin)[-1] if len(begin) > 1 else np.zeros(0)

    def gradient(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        first, size = begin[:-1], np.diff(begin)
        h, t, s, a, z, out = self.forward(x, begin)
        g = (out - y) / len(y)
        dz = np.repeat(g[:, None] * p["c"], size, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), size))
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = (dz * a[:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ g, "d": np.array([g.sum()])}

    def fit(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray, epochs: int = 25, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Model:
        self.mean = x.mean(0, dtype=float)
        square = sum((np.square(x[lo : lo + 8192], dtype=float).sum(0) for lo in range(0, len(x), 8192)), np.zeros(x.shape[1])) / len(x)
        self.scale = np.maximum(np.sqrt(np.maximum(square - self.mean**2, 0)), 1e-2)
        size, r, k = np.diff(begin), np.random.default_rng(seed), 0
        m = {n: np.zeros_like(v) for n, v in self.p.items()}
        v = {n: np.zeros_like(q) for n, q in self.p.items()}
        steps = epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = r.permutation(len(y))
            for lo in range(0, len(y), batch):
                docs = order[lo : lo + batch]
                own = size[docs]
                at = np.cumsum(own)
                rows = np.repeat(begin[docs] - (at - own), own) + np.arange(at[-1])
                k += 1
                for n, g in self.gradient(self.scaled(x[rows]), np.r_[0, at], y[docs]).items():
                    g = g + decay * self.p[n]
                    m[n] += 0.1 * (g - m[n])
                    v[n] += 0.001 * (g * g - v[n])
                    self.p[n] -= rate * (1 - k / (steps + 1)) * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.999**k)) + 1e-8)
        return self


def _bags(batches):
    for batch in in_slices(batches):
        x, begin = passages(batch.column(1))
        rows = [x[lo:hi].tobytes() for lo, hi in zip(begin, begin[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["doc_id", "y", "bag"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> Model | None:
    rows = labelled(docs, labels, "quality", held_out(), max_train, max_bytes).select("doc_id", "text", "y")
    got = rows.mapInArrow(_bags, "doc_id bigint, y int, bag binary").toArrow().sort_by([("doc_id", "ascending"), ("bag", "ascending")])
    if not got.num_rows:
        return None
    bags = [np.frombuffer(b, np.float32).reshape(-1, SIZE) for b in got.column("bag").to_pylist()]
    return Model().fit(np.concatenate(bags), np.r_[0, np.cumsum([len(b) for b in bags])], got.column("y").to_numpy().astype(float))


def score(docs: DataFrame, model: Model | None, columns: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``columns`` of documents with score and predicted."""
    cols = documents(docs, *dict.fromkeys((*columns, "text")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cols.schema)

    def run(batches):
        for batch in in_slices(batches, limit=1 << 20):
            names = batch.schema.names
            x, begin = passages(batch.column(names.index("text")))
            s = np.full(len(batch), 0.5) if model is None else model.scores(x, begin)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return cols.mapInArrow(run, f"{kinds}, score double, predicted int").select(*columns, "score", "predicted")
