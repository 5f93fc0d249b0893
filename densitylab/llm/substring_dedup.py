"""Substring deduplication by seed and extend (operator 9).

Seeds are winnowed anchors: among any ``window - seed + 1`` consecutive word
``seed``-grams of a document the least hash is an anchor, so every repeat of
``window`` words holds an anchor that its copies hold at the same place.
Documents are joined on the anchors that several of them hold; anchors of one
document alone go.  Around every shared seed the match is extended both ways, to
each window of ``window`` words that holds it; equal windows meet in an aggregation
that keeps their least document, so a passage in a third of all documents costs one
row per document and no pairs.  Windows are equal if 128 bits of hashes of their
words are (chance matches among 10^13 windows: 10^-13).  Windows that a lesser
document holds are joined where they overlap or meet: these are the maximal
repeats, of ``window`` words or more, which are cut.

Exact copies of a whole text are settled first: all but the least document
are covered if they have a window at all.

Defined results: null and empty texts have no words.  Texts shorter than a
window lose nothing.  A null doc_id ranks after every other (beside the largest
possible one) and never equals one; rows that repeat a doc_id do not cover each other.  Repeated rows get
equal results.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import documents, in_slices, release, staged

WINDOW, SEED = 13, 5
_LAST = (1 << 63) - 1
_TOP = np.uint64((1 << 64) - 1)


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """out[i] = least(x[i], ..., x[i + width - 1]), cut at the end of x."""
    have = 1
    while have < width:
        step = min(have, width - have)
        y = x.copy()
        if step < len(x):
            y[:-step] = least(x[:-step], x[step:])
        x, have = y, have + step
    return x


def anchors_of(w: tv.Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indices of the anchors of a batch, and their hashes (48 bits)."""
    gram, ok = w.grams(seed)
    gram[~ok] = _TOP
    span = window - seed + 1
    least = _slide(gram, span, np.minimum)
    long = np.repeat(np.diff(w.ptr) >= window, np.diff(w.ptr))
    chosen = np.flatnonzero((_slide(least[::-1], span, np.maximum)[::-1] == gram) & ok & long)
    return chosen, (gram[chosen] >> np.uint64(16)).astype(np.int64)


def _anchor_batches(window: int, seed: int):
    def run(batches):
        for batch in in_slices(batches):
            rank, tk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for w in tv.words(batch.column(2), tv.SPACE):
                at, h = anchors_of(w, window, seed)
                d = np.searchsorted(w.ptr, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(rank[d + w.first]), pa.array(tk[d + w.first]), pa.array((at - w.ptr[d]).astype(np.int32))], names=["h", "rank", "tk", "at"])

    return run


def _window_batches(window: int, seed: int):
    """Hashes of the windows that hold a shared seed, from (rank, tk, text, seeds)."""

    def run(batches):
        for batch in in_slices(batches):
            rank, tk, places = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            lens = np.diff(places.offsets.to_numpy())
            flat = places.flatten().to_numpy()
            owner = np.repeat(np.arange(len(lens)), lens)
            for w in tv.words(batch.column(2), tv.SPACE):
                here = (owner >= w.first) & (owner < w.first + w.n_docs)
                at = flat[here] + w.ptr[owner[here] - w.first]
                mark = np.zeros(len(w.hash) + window + 1, np.int32)
                np.add.at(mark, np.maximum(at - (window - seed), 0), 1)
                np.add.at(mark, at + 1, -1)
                gram, ok = w.grams(window, 1)
                other, _ = w.grams(window, 2, tv.OTHER)
                i = np.flatnonzero((np.cumsum(mark)[: len(ok)] > 0) & ok)
                d = np.searchsorted(w.ptr, i, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(gram[i].view(np.int64)), pa.array(other[i].view(np.int64)), pa.array(rank[d + w.first]), pa.array(tk[d + w.first]), pa.array((i - w.ptr[d]).astype(np.int32))], names=["w", "w2", "rank", "tk", "at"])

    return run


def _cut_batches(window: int):
    """Texts without the words of covered windows, from (doc_id, text, is_copy, windows), and the maximal repeats."""
    spans_kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        for batch in in_slices(batches):
            names = batch.schema.names
            texts, copy, places = (batch.column(names.index(c)) for c in ("text", "is_copy", "places"))
            copy = np.asarray(copy.fill_null(False))
            filled = places.fill_null(pa.scalar([], places.type)) if places.null_count else places
            lens = np.diff(filled.offsets.to_numpy())
            owner, flat = np.repeat(np.arange(len(lens)), lens), filled.flatten().to_numpy()
            raw, offsets = tv.buffers(texts)
            n_words, n_gone, kept = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), []
            spans: list[list[dict]] = [[] for _ in range(len(batch))]
            for w in tv.words(texts, tv.SPACE, hashes=False):
                here = (owner >= w.first) & (owner < w.first + w.n_docs)
                at = flat[here] + w.ptr[owner[here] - w.first]
                mark = np.zeros(len(w.start) + window + 1, np.int32)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + window, -1)
                gone = np.cumsum(mark)[: len(w.start)] > 0
                count = np.diff(w.ptr)
                n_words[w.first : w.first + w.n_docs] = count
                gone |= np.repeat(copy[w.first : w.first + w.n_docs] & (count >= window), count)
                total = np.r_[0, np.cumsum(gone)]
                n_gone[w.first : w.first + w.n_docs] = lost = total[w.ptr[1:]] - total[w.ptr[:-1]]
                part = raw[offsets[w.first] : offsets[w.first + w.n_docs]]
                for d in range(w.n_docs):
                    lo, hi = w.offsets[d], w.offsets[d + 1]
                    if not lost[d]:
                        kept.append(part[lo:hi].tobytes())
                        continue
                    words = slice(w.ptr[d], w.ptr[d + 1])
                    step = np.zeros(hi - lo + 1, np.int8)
                    turn = np.diff(np.r_[False, gone[words]].astype(np.int8))
                    edge = np.flatnonzero(np.r_[turn, -1 if gone[words][-1] else 0])
                    spans[w.first + d] = [{"first": a, "last": b - 1} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
                    begin = w.start[words] - lo
                    step[begin] = -turn
                    keep = 1 + np.cumsum(step)[: hi - lo]
                    kept.append(part[lo:hi][keep.astype(bool)].tobytes())
            cols = [c for k, c in enumerate(batch.columns) if names[k] not in ("text", "is_copy", "places")]
            out = [c for c in names if c not in ("text", "is_copy", "places")]
            words = pa.array(kept, pa.binary()).cast(pa.string())
            if texts.null_count:
                words = pa.compute.if_else(texts.is_null(), pa.scalar(None, pa.string()), words)
            yield pa.RecordBatch.from_arrays([*cols, words, pa.array(n_words), pa.array(n_gone), pa.array(spans, spans_kind)], names=[*out, "kept_text", "n_words", "n_removed", "repeats"])

    return run


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """rank orders documents (a null id is last); rank and tk together name a text of a document."""
    cols = documents(docs, *dict.fromkeys((*columns, "doc_id", "text")))
    return cols.withColumn("rank", F.coalesce("doc_id", F.lit(_LAST))).withColumn("tk", F.xxhash64("text", F.col("doc_id").isNull()))


def covered_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(copies, places), both by (rank, tk).

    copies: texts that equal the whole text of a lesser document.
    places: starts of the windows that also start in a lesser document, for the other texts.
    """
    texts = _keyed(docs).filter("text is not null").select("rank", "tk", "text")
    digests = texts.select("rank", "tk", F.unhex(F.sha2("text", 256)).alias("key"))
    # written, as the shared anchors below, so that joins have a plain exchange on both sides, which Spark splits where a key is hot
    groups = staged(digests.groupBy("key").agg(F.min("rank").alias("owner"), F.max("rank").alias("hi")).filter("owner < hi").drop("hi"), "twins")
    copies = staged(digests.join(groups, "key").filter("rank > owner").select("rank", "tk").distinct(), "copies")
    anchors = texts.mapInArrow(_anchor_batches(window, seed), "h bigint, rank bigint, tk bigint, at int")
    shared = staged(anchors.groupBy("h").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).filter("lo < hi").select("h"), "shared")
    seeds = staged(anchors.join(shared, "h").groupBy("rank", "tk").agg(F.collect_set("at").alias("seeds")), "seeds")  # a set, as equal rows have equal seeds
    # a copy's windows all start in its least document too, so it is no source and needs no windows
    held = texts.join(seeds, ["rank", "tk"]).join(copies, ["rank", "tk"], "left_anti").select("rank", "tk", "text", "seeds")
    windows = staged(held.mapInArrow(_window_batches(window, seed), "w bigint, w2 bigint, rank bigint, tk bigint, at int"), "windows")
    owners = staged(windows.groupBy("w", "w2").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).filter("lo < hi").select("w", "w2", "lo"), "owners")
    places = staged(windows.join(owners, ["w", "w2"]).filter("lo < rank").groupBy("rank", "tk").agg(F.collect_set("at").alias("places")), "places")
    release(groups, shared, seeds, windows, owners)
    return copies, places


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row with kept_text, n_words, n_removed and repeats (first and last word of each); ``columns`` of documents come along.

    kept_text is the text with the bytes of removed words and the white space
    after them cut out; a null text stays null.
    """
    copies, places = covered_windows(docs, window, seed)
    keyed = _keyed(docs, *columns)
    joined = keyed.join(places, ["rank", "tk"], "left").join(copies.withColumn("is_copy", F.lit(True)), ["rank", "tk"], "left")
    others = [c for c in columns if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema}
    out = ", ".join([f"{c} {kinds[c]}" for c in others] + ["kept_text string, n_words bigint, n_removed bigint, repeats array<struct<first: bigint, last: bigint>>"])
    return joined.select(*others, "text", "is_copy", "places").mapInArrow(_cut_batches(window), out)
