"""Language identification by multinomial naive Bayes (operator 7).

Features are hashed character 2- and 3-grams of the lower-cased text.  Counts by
language and bucket come from a sample of at most about ``max_train`` labelled
documents, taken by hash; they are summed in the tasks first.  The matrix of log
probabilities goes to every task, which sums the rows of a slice's grams by document
in numpy.  It has at most CELLS numbers: of more than CELLS / BUCKETS languages,
which the sample bounds, each has fewer buckets.  score is the posterior probability.

Defined results: a text that is null or has no letter is ``und`` with score 0.
Ties go to the alphabetically first language.  Without any labelled document
every text is ``und``.  Repeated rows get equal results.  A null doc_id isn't held
out.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, in_slices, staged

BUCKETS = 1 << 15
MAX_TRAIN = 20_000
CELLS = 1 << 24

_letter = regex.compile(r"\p{L}").search


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def grams(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all grams, and where each text's grams begin; bucket 0 is that of separators."""
    low = [(t or "").lower().replace("\0", " ") for t in texts]
    points = np.frombuffer("\0".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum([0, *(len(t) + 1 for t in low)])
    cut = points == 0
    two = points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA77) if len(points) > 1 else points[:0]
    out = np.zeros((2, len(points)), np.uint32)
    out[0, :-1] = two
    if len(points) > 2:
        out[1, :-2] = two[:-1] * np.uint32(0xC2B2AE3D) + points[2:] * np.uint32(0x27D4EB2F)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out = (out >> np.uint32(12)) % np.uint32(buckets - 1) + np.uint32(1)
    crosses = cut.copy()
    crosses[:-1] |= cut[1:]
    crosses[-1:] = True
    out[0, crosses] = 0
    crosses[:-1] |= crosses[1:]
    crosses[-1:] = True
    out[1, crosses] = 0
    return out, begin


def _count(buckets: int):
    def run(batches):
        total: dict[str, np.ndarray] = {}
        n_docs: dict[str, int] = {}

        def rows():
            for lang, own in total.items():
                own[0] = n_docs[lang]  # the separators' bucket carries the number of documents
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "n"])
            total.clear()
            n_docs.clear()

        for batch in in_slices(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            of: dict[str, list[str]] = {}
            for lang, text in zip(langs, texts):
                of.setdefault(lang, []).append(text)
            for lang in sorted(of):
                out, _ = grams(of[lang], buckets)
                own = total.setdefault(lang, np.zeros(buckets, np.int64))
                own += np.bincount(out.ravel(), minlength=buckets)
                n_docs[lang] = n_docs.get(lang, 0) + len(of[lang])
                if len(total) >= 256:
                    yield from rows()
        yield from rows()

    return run


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray, alpha: float = 0.5):
        self.langs = langs
        counts = counts.copy().astype(float)
        counts[:, 0] = 0
        log = np.log((counts + alpha) / (counts + alpha).sum(1, keepdims=True)) if langs else counts
        log[:, 0] = 0
        self.log = np.ascontiguousarray(log.astype(np.float32))
        self.prior = np.log((docs + 1) / (docs + 1).sum()) if langs else docs

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs or not texts:
            return ["und"] * len(texts), [0.0] * len(texts)
        out, begin = grams(texts, self.log.shape[1])
        # a text's separator stands at its end, so no text has an empty run
        like = np.stack([np.add.reduceat(row[out[0]].astype(np.float64) + row[out[1]], begin[:-1]) for row in self.log], 1)
        fit = like + self.prior
        fit -= fit.max(1, keepdims=True)
        p = np.exp(fit)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        known = [bool(t) and bool(_letter(t)) for t in texts]
        return [self.langs[b] if k else "und" for b, k in zip(best, known)], [float(min(1.0, p[i, b])) if known[i] else 0.0 for i, b in enumerate(best)]


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    rows = documents(docs, "doc_id", "lang", "text").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.select("lang").count()
    if n > max_train:
        share = lambda part, *by: F.pmod(F.xxhash64(*by, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * part)
        own = staged(rows.filter(share(max_train / n, "doc_id", "text")).select("lang", "text"), "language-sample")  # the same rows whatever the partitions
        found = own.count()
        if not found or found > 2 * max_train:  # rows that equal one another go in or out together, so they are told apart by their places
            place = rows.withColumn("place", F.monotonically_increasing_id())
            own = staged(place.filter(share(max_train / n, "doc_id", "text", "place")).select("lang", "text"), "language-sample")
        rows = own
    names = sorted(r.lang for r in rows.select("lang").distinct().collect())  # no more than the sample has rows
    buckets = BUCKETS
    while len(names) * buckets > CELLS:
        buckets //= 2
    table = rows.select("lang", "text").mapInArrow(_count(buckets), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(names), buckets), np.int64)
    got = table.toArrow()
    if got.num_rows:
        row = np.searchsorted(np.array(names), got.column("lang").to_numpy(zero_copy_only=False).astype(str))
        counts[row, got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return Model(names, counts, counts[:, 0].astype(float))


def predict(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of documents with lang_pred and score."""
    cols = documents(docs, *dict.fromkeys((*columns, "text")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cols.schema)
    limit = max(1 << 16, (1 << 20) // max(1, len(model.langs) // 8))

    def run(batches):
        for batch in in_slices(batches, limit=limit):
            names = batch.schema.names
            langs, scores = model.predict(batch.column(names.index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return cols.mapInArrow(run, f"{kinds}, lang_pred string, score double").select(*columns, "lang_pred", "score")
