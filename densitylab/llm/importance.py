"""Importance resampling towards a target distribution (operator 13).

Features of a text are its runs of 1 to ORDER consecutive words, joined by a space,
hashed into BUCKETS by the CRC-32 of their bytes.  A vectorised byte automaton reads
the Arrow buffer: a table of 256 entries folds A-Z and marks separators, word borders
are differences of that mark, and the CRC states of all words of a slice advance a byte
at a time together.  The states after a run of k words are the start of those
of k + 1 words, so no feature is ever written down.

Counts of buckets are summed over all documents and all of the target; the gain of a
bucket is 1000 times the logarithm of its share in the target over its share in the
corpus.  A text's weight is the sum of its features' gains, and its score adds a Gumbel
number that is a digest of the seed and doc_id, so that the greatest scores are a draw without
replacement in proportion to the importance weights.  Ranks come from ranges of the
scores and their sizes, never from one sorted partition.

Defined results: null and empty texts have no features and the weight 0; a null doc_id
has the digest of an empty id, and comes after all other ids of a tie.  Rows of equal
doc_id and score (repeated rows) are drawn one after another, in no matter which order.
Texts are cut into slices of words, so that a text of any length takes bounded memory; at the cut
features reach over the border.  An empty target, or an empty corpus, has no
features; counts are smoothed by one a bucket, so gains are finite.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import columns, documents, in_slices, staged

BUCKETS, ORDER, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Words whose features are hashed together; bytes of a word that the table walks before zlib takes the rest.
SLICE_WORDS, WALKED = 1 << 17, 48


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()
_FULL, _SPACE = np.uint32(0xFFFFFFFF), np.uint32(0x20)


def advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC states after the bytes data[start:end] of each row, all rows a byte further at a time."""
    size = end - start
    order = np.argsort(-np.minimum(size, WALKED), kind="stable")
    s, at, left = state[order], start[order], size[order]
    live = np.searchsorted(-np.minimum(left, WALKED), -np.arange(WALKED), side="left")  # rows with a byte at each place
    for k in range(WALKED):
        n = int(live[k])
        if not n:
            break
        s[:n] = _CRC[(s[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (s[:n] >> np.uint32(8))
    for i in np.flatnonzero(left[: int(live[-1])] > WALKED):  # long words go on in zlib, whose register is the inverse
        s[i] = zlib.crc32(data[at[i] + WALKED : at[i] + left[i]].tobytes(), int(s[i] ^ _FULL)) ^ 0xFFFFFFFF
    out = np.empty_like(s)
    out[order] = s
    return out


def features(w: tv.Words, order: int = ORDER, slice_words: int = SLICE_WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order - 1, document of the batch, CRC-32) of all runs of words of ``w``, a slice of starts at a time."""
    n = len(w.start)
    last = np.repeat(w.ptr[1:], np.diff(w.ptr))  # the end of each word's document
    doc = w.doc_of()
    for lo in range(0, n, slice_words):
        i = np.arange(lo, min(n, lo + slice_words))
        state = np.full(len(i), _FULL)
        for k in range(order):
            inside = i + k < last[i]
            i, state = i[inside], state[inside]
            if not len(i):
                break
            if k:
                state = _CRC[(state ^ _SPACE) & np.uint32(255)] ^ (state >> np.uint32(8))
            state = advance(state, w.data, w.start[i + k], w.end[i + k])
            yield k, doc[i], state ^ _FULL


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> dict[int, int]:
    """Features in each bucket over all rows' ``text``: at most ``buckets`` numbers reach the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in in_slices(batches):
            for w in tv.words(batch.column(0), hashes=False):
                for _, _, crc in features(w):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    return {r.bucket: r.n for r in rows}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    s, t = sum(corpus.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * (s + buckets) / ((corpus.get(b, 0) + 1) * (t + buckets)))) for b in range(buckets)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    buckets = np.uint32(len(gain))

    def run(batches):
        for batch in in_slices(batches):
            for w in tv.words(batch.column(1), hashes=False):
                n, weight = np.zeros(w.n_docs, np.int64), np.zeros(w.n_docs, np.int64)
                for _, doc, crc in features(w):
                    n += np.bincount(doc, minlength=w.n_docs)
                    edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])  # integers are summed as such
                    weight[doc[edge]] += np.add.reduceat(gain[crc % buckets], edge)
                ids = batch.column(0).slice(w.first, w.n_docs)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(w.ptr)), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return documents(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def drawn(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` (staged: doc_id, n_words, score, ...) with rank: 1, 2, ... of the drawn rows, by ranges of (score, doc_id)."""
    fit = scored.filter(F.col("n_words") >= least_words)
    most = fit.count() * percent // 100
    key = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranges = max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # rows of one doc_id and score are dealt over the ranges by their place in the table
    placed = staged(fit.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges, *key, F.asc("_row")).withColumn("_part", F.spark_partition_id()), "scores")
    before, first = 0, {}
    for r in sorted(placed.groupBy("_part").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_part"]):  # a row a range
        first[r["_part"]], before = before, before + r["n"]
    from pyspark.sql import Window

    starts = F.create_map(*[F.lit(x) for p, n in first.items() for x in (p, n)]) if first else F.lit(None).cast("map<int,bigint>")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*key, "_row"))
    rank = (starts[F.col("_part")] + inside).cast("bigint")
    ranked = placed.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).drop("_row", "_part")
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs``; drawn rows have a rank."""
    from pyspark.sql import types as T

    corpus = bucket_counts(documents(docs, "text"))
    gain = gains(corpus, bucket_counts(columns(target, {"text": T.StringType()})))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")
    scored = staged(weights(docs, gain).withColumn("score", F.col("weight") + noise), "weights")
    return drawn(scored, least_words, percent)
