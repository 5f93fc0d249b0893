"""Toxicity by classifier chains (operator 2).

Categories are predicted one after another by logistic models over the hashed
words, and word beginnings of BEGINNING bytes, that a text holds; a model also takes the probabilities of the categories
before it.  In training these are out-of-fold predictions, so that a later model
sees earlier ones as unsure as they are on new texts.  The first and the last category are
marks of the data, texts of poor quality and toxic ones; documents without a mark of quality
teach the other models alone.  Those between are weak labels, toxic texts with a word of the category's seed list.

Training takes a sample by hash of at most about MAX_TRAIN labelled documents and
MAX_BYTES of text, whose distinct word hashes come to the driver; only those stay
whose share among toxic texts differs from that among others by Z standard errors
or more.  Models that predict a fold choose their words, too, without its rows.
Scoring takes every word of every text.

Defined results: a text without words (null, empty) has no words to weigh and
gets the models' biases.  Without labels every probability is 0.  A doc_id with
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

BUCKETS = 1 << 22
MAX_TRAIN, MAX_BYTES, MIN_DOCS, FOLDS, THRESHOLD = 12_000, 64 << 20, 4, 3, 0.3
BEGINNING, Z = 6, 3.5

# Seed words of the weakly labelled categories.
SEEDS = {
    "insult": ["idiot", "moron", "stupid", "loser", "clown"],
    "contempt": ["pathetic", "worthless", "disgusting"],
    "abuse": ["trash", "scum"],
}
CHAIN = ["poor", *SEEDS, "toxic"]


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def _bucket(words: list[str]) -> list[int]:
    return [int(next(tv.words(pa.array([x]))).hash[0] % np.uint64(BUCKETS)) for x in words]


def word_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, and where each text's begin."""
    out, sizes = [], []
    for w in tv.words(texts):
        own = w.doc_of().astype(np.int64) * BUCKETS
        begin = tv.mix64(w.beginnings(BEGINNING) + np.uint64(BEGINNING))
        key = np.unique(np.r_[own + (w.hash % np.uint64(BUCKETS)).astype(np.int64), own + (begin % np.uint64(BUCKETS)).astype(np.int64)])
        doc = key // BUCKETS
        out.append(key % BUCKETS)
        sizes.append(np.bincount(doc, minlength=w.n_docs))
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), np.r_[0, np.cumsum(sizes)]


def _sum(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(values)]
    return total[begin[1:]] - total[begin[:-1]]


class Logistic:
    """L2-regularised, over the presence of words and a few dense columns; Adam steps of falling size."""

    def fit(self, index: np.ndarray, begin: np.ndarray, dense: np.ndarray, y: np.ndarray, size: int, l2: float = 2e-4, rounds: int = 150, rate: float = 0.5) -> Logistic:
        row = np.repeat(np.arange(len(y)), np.diff(begin))
        w, d, b = np.zeros(size), np.zeros(dense.shape[1]), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        mw, md, mb = np.zeros(size), np.zeros(dense.shape[1]), 0.0
        gw2, gd2, gb2 = np.full(size, 1e-12), np.full(dense.shape[1], 1e-12), 1e-12
        for k in range(1, rounds + 1):
            p = 1 / (1 + np.exp(-np.clip(_sum(w[index], begin) + dense @ d + b, -30, 30)))
            g = (p - y) / len(y)
            gw, gd, gb = np.bincount(index, g[row], size) + l2 * w, dense.T @ g + l2 * d, g.sum()
            mw, md, mb = 0.9 * mw + 0.1 * gw, 0.9 * md + 0.1 * gd, 0.9 * mb + 0.1 * gb
            gw2, gd2, gb2 = 0.99 * gw2 + 0.01 * gw**2, 0.99 * gd2 + 0.01 * gd**2, 0.99 * gb2 + 0.01 * gb**2
            c1, c2, step = 1 - 0.9**k, 1 - 0.99**k, rate * 0.3 * (1 - k / (rounds + 1))
            w = w - step * (mw / c1) / (np.sqrt(gw2 / c2) + 1e-8)
            d = d - step * (md / c1) / (np.sqrt(gd2 / c2) + 1e-8)
            b = b - step * (mb / c1) / (np.sqrt(gb2 / c2) + 1e-8)
        self.w, self.d, self.b = w, d, float(b)
        return self

    def predict(self, index: np.ndarray, begin: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_sum(self.w[index], begin) + dense @ self.d + self.b, -30, 30)))


def _rows(index: np.ndarray, begin: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(begin)[rows]
    at = np.cumsum(size)
    if not len(rows) or not at[-1]:
        return index[:0], np.zeros(len(rows) + 1, np.int64)
    return index[np.repeat(begin[rows] - (at - size), size) + np.arange(at[-1])], np.r_[0, at]


class Chain:
    def __init__(self, vocabulary: np.ndarray, models: list[Logistic]):
        self.vocabulary, self.models = vocabulary, models

    def restrict(self, buckets: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.vocabulary, buckets), max(0, len(self.vocabulary) - 1))
        keep = self.vocabulary[at] == buckets if len(self.vocabulary) else np.zeros(len(buckets), bool)
        total = np.r_[0, np.cumsum(keep)]
        return at[keep], total[begin]

    def predict(self, buckets: np.ndarray, begin: np.ndarray) -> np.ndarray:
        index, begin = self.restrict(buckets, begin)
        p = np.zeros((len(begin) - 1, 0))
        for m in self.models:
            p = np.column_stack([p, m.predict(index, begin, p)])
        return p


def vocabulary(buckets: np.ndarray, begin: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words whose share differs between the two classes of these rows."""
    words, at, count = np.unique(buckets, return_inverse=True, return_counts=True)
    n, hit = y.sum(), np.bincount(at, np.repeat(y, np.diff(begin)), len(words))
    p = count / max(len(y), 1)
    error = np.sqrt(p * (1 - p) * (1 / max(n, 1) + 1 / max(len(y) - n, 1))) + 1e-9
    gap = np.abs(hit / max(n, 1) - (count - hit) / max(len(y) - n, 1))
    return words[(count >= MIN_DOCS) & (gap >= Z * error)]


def _fit_known(index: np.ndarray, begin: np.ndarray, dense: np.ndarray, y: np.ndarray, size: int) -> Logistic:
    """A model of the rows that have a mark."""
    known = np.flatnonzero(~np.isnan(y))
    if not len(known):
        return Logistic().fit(index[:0], np.zeros(2, np.int64), np.zeros((1, dense.shape[1])), np.zeros(1), size)
    return Logistic().fit(*_rows(index, begin, known), dense[known], y[known], size)


def fit_chain(buckets: np.ndarray, begin: np.ndarray, marks: np.ndarray, fold: np.ndarray) -> Chain:
    """marks: documents x categories of 0/1 (NaN: not marked), in the chain's order; all have the last."""
    toxic = marks[:, -1]
    chain = Chain(vocabulary(buckets, begin, toxic), [])
    index, at = chain.restrict(buckets, begin)
    parts = []
    for f in range(FOLDS):
        train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(train) and len(test):
            seen = _rows(buckets, begin, train)
            own = Chain(vocabulary(*seen, toxic[train]), [])
            parts.append((train, test, own.restrict(*seen), own.restrict(*_rows(buckets, begin, test)), len(own.vocabulary)))
    before = np.zeros((len(marks), 0))
    for y in marks.T:
        chain.models.append(_fit_known(index, at, before, y, len(chain.vocabulary)))
        unseen = np.zeros(len(y))
        for train, test, seen, new, size in parts:
            unseen[test] = _fit_known(*seen, before[train], y[train], size).predict(*new, before[test])
        before = np.column_stack([before, unseen])
    return chain


def _bags(batches):
    for batch in in_slices(batches):
        words, begin = word_sets(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(words.astype(np.int32)))], names=["doc_id", "y", "quality", "words"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> Chain | None:
    rows = labelled(docs, labels, "toxic", held_out(), max_train, max_bytes, also="quality").select("doc_id", "text", "y", "quality")
    got = rows.mapInArrow(_bags, "doc_id bigint, y int, quality int, words array<int>").toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return None
    lists = got.column("words").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    begin = lists.offsets.to_numpy().astype(np.int64)
    buckets, begin = lists.values.to_numpy()[begin[0] : begin[-1]].astype(np.int64), begin - begin[0]
    y = got.column("y").to_numpy().astype(float)
    owner = np.repeat(np.arange(len(y)), np.diff(begin))
    marks_ = [np.bincount(owner, np.isin(buckets, _bucket(SEEDS[c])), len(y)).astype(bool) & (y > 0) for c in SEEDS]
    poor = 1.0 - got.column("quality").cast(pa.float64()).fill_null(float("nan")).to_numpy()
    fold = (tv.mix64(got.column("doc_id").to_numpy().astype(np.uint64)) % np.uint64(FOLDS)).astype(int)
    return fit_chain(buckets, begin, np.column_stack([poor, *marks_, y]).astype(float), fold)


def score(docs: DataFrame, chain: Chain | None, columns: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``columns`` of documents with p_<category> for the chain, categories, score (p_toxic) and toxic."""
    cols = documents(docs, *dict.fromkeys((*columns, "text")))
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cols.schema)
    names = [f"p_{c}" for c in CHAIN]

    def run(batches):
        for batch in in_slices(batches):
            have = batch.schema.names
            p = np.zeros((len(batch), len(CHAIN))) if chain is None else chain.predict(*word_sets(batch.column(have.index("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in p.T)], names=[*have, *names])

    out = cols.mapInArrow(run, ", ".join([own, *(f"{n} double" for n in names)]))
    listed = F.concat_ws(",", *[F.when(F.col(n) >= threshold, F.lit(c)) for n, c in zip(names, CHAIN)])
    return out.select(*columns, *names, listed.alias("categories"), F.col("p_toxic").alias("score"), (F.col("p_toxic") >= threshold).alias("toxic"))
