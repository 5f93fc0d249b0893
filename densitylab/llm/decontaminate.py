"""Benchmark decontamination over a positional inverted index (operator 3).

``build_index`` stores the corpus's postings once, sharded by document: a row holds
the postings of about SLICE_BYTES of texts, every token with the sorted positions where it
stands, and the documents' borders.  Texts aren't needed after that.

Test items come to the driver in blocks of at most BLOCK_BYTES, one after another,
and each block is one pass over the stored index with nothing but this block in its
tasks.  A block is cut into windows of ``window`` words.  Its tokens' counts over the
whole index name each window's rarest token; a shard looks only at windows whose
rarest token it holds.  The positions of a window's rarest token, less its offset,
are candidate starts; the lists of the further tokens, less their offsets, are
intersected with them by rising number of postings.  What is left are exact phrase
matches.  ``near_matches`` finds, in the same index, where all tokens of a phrase
stand within a span of words.

Tokens are compared by 64-bit hashes of their words, all ten of a window.

Defined results: null and empty texts have no words and no hits; an item without
words matches nothing; an item of fewer words than a window is one window; items of
equal item_id are one item; items with a null id are one item too, which counts and
hits but adds nothing to the list of ids.  Ids of items are compared and listed as
strings, whatever their type.  Repeated rows get equal results.  Extra columns are
ignored.  An empty table of items gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import columns as picked
from .common import documents, in_slices, staged

WINDOW = 10
BLOCK_BYTES = 2 << 20

#: Bytes of text behind a row of postings, which are about three times as many.
SLICE_BYTES = 1 << 18
#: Rows of postings are large: pages and row groups are small, and their sizes are looked at after every row, not every 100.
_GROUPS = {
    "parquet.block.size": str(8 << 20),
    "parquet.enable.dictionary": "false",
    **{f"parquet.{unit}.size.row.check.{end}": "1" for unit in ("page", "block") for end in ("min", "max")},
}
_INDEX = "docs array<struct<doc_id: bigint, key: bigint, n_words: bigint>>, ptr binary, term binary, begin binary, place binary"
_HITS = "doc_id bigint, key bigint, items array<struct<item: string>>, spans array<struct<first: bigint, last: bigint>>"


def text_key() -> Column:
    """With doc_id it names a text; rows of equal names are equal rows."""
    return F.xxhash64("text", F.col("doc_id").isNull())


class Shard:
    """Postings of some documents: of token ``term[i]`` the positions ``place[begin[i]:begin[i + 1]]``."""

    def __init__(self, term: np.ndarray, begin: np.ndarray, place: np.ndarray, ptr: np.ndarray):
        self.term, self.begin, self.place, self.ptr = term, begin, place, ptr

    @classmethod
    def of(cls, w: tv.Words) -> Shard:
        order = np.argsort(w.hash, kind="stable")
        h = w.hash[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        return cls(h[first], np.r_[first, len(h)].astype(np.int32), order.astype(np.int32), w.ptr.astype(np.int32))

    def numbers(self, tokens: np.ndarray) -> np.ndarray:
        """Where each token stands in ``term``, or -1."""
        if not len(self.term):
            return np.full(len(tokens), -1, np.int64)
        at = np.minimum(np.searchsorted(self.term, tokens), len(self.term) - 1)
        return np.where(self.term[at] == tokens, at, -1)

    def keys(self) -> np.ndarray:
        """token number and position as one rising number."""
        number = np.repeat(np.arange(len(self.term), dtype=np.int64), np.diff(self.begin))
        return (number << 32) | self.place


class Block:
    """Windows of a block of items, as rows of token numbers, padded with -1."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        names = {}
        item_of = np.array([names.setdefault(i, len(names)) for i, _ in items], np.int64)
        self.items = list(names)
        (w,) = tv.words(pa.array([t for _, t in items], pa.string()), limit=1 << 62) if items else (None,)
        n = np.diff(w.ptr) if items else np.zeros(0, np.int64)
        size = np.minimum(n, window)
        count = np.where(n > 0, n - size + 1, 0)
        owner = np.repeat(np.arange(len(n)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.tokens, number = np.unique(w.hash, return_inverse=True) if items else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        cols = np.arange(window)
        place = (w.ptr[owner] + at)[:, None] + cols if items else np.zeros((0, window), np.int64)
        inside = cols < size[owner][:, None]
        rows = np.where(inside, number[np.minimum(place, max(0, len(number) - 1))] if len(number) else -1, -1).astype(np.int32)
        self.rows, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        self.length = (self.rows >= 0).sum(1)
        pairs = np.unique(np.c_[which.ravel(), item_of[owner]], axis=0) if len(rows) else np.zeros((0, 2), np.int64)
        self.owner_item, self.owner_begin = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))

    def by_rarest(self, frequency: np.ndarray) -> Block:
        """Windows listed by their rarest token, and each window's columns from its rarest token on."""
        seen = np.where(self.rows >= 0, frequency[np.maximum(self.rows, 0)] if len(frequency) else 0, np.iinfo(np.int64).max)
        self.order = np.argsort(seen, axis=1, kind="stable").astype(np.int8)
        key = np.take_along_axis(self.rows, self.order[:, :1].astype(np.int64), 1).ravel() if len(self.rows) else np.zeros(0, np.int32)
        self.by_key = np.argsort(key, kind="stable")
        self.key_begin = np.searchsorted(key[self.by_key], np.arange(len(self.tokens) + 1))
        return self

    def matches(self, s: Shard) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact match; documents' ends are for the caller."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = s.numbers(self.tokens)
        there = np.flatnonzero(at >= 0)
        n = self.key_begin[there + 1] - self.key_begin[there]
        alive = self.by_key[np.repeat(self.key_begin[there], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        if not len(alive):
            return none
        rows = self.rows[alive]
        term = np.where(rows >= 0, at[np.maximum(rows, 0)], -2)
        whole = (term != -1).all(1)
        alive, term, order = alive[whole], term[whole], self.order[alive[whole]].astype(np.int64)
        if not len(alive):
            return none
        count = np.diff(s.begin).astype(np.int64)
        held = np.where(term >= 0, count[np.maximum(term, 0)], np.iinfo(np.int64).max)
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(held, order, 1), axis=1, kind="stable"), 1)
        rare = order[:, 0]
        first = term[np.arange(len(alive)), rare]
        n = count[first]
        query = np.repeat(np.arange(len(alive)), n)
        start = s.place[np.repeat(s.begin[first].astype(np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64) - rare[query]
        ok = start >= 0
        query, start, keys = query[ok], start[ok], s.keys()
        for k in range(1, self.rows.shape[1]):
            off = order[query, k]
            want = term[query, off]
            key = (want << 32) | (start + off)
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            ok = (want < 0) | (keys[i] == key)
            query, start = query[ok], start[ok]
        return alive[query], start


def _index(batches):
    for batch in in_slices(batches, limit=SLICE_BYTES):
        ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for w in tv.words(batch.column(2)):
            s, n = Shard.of(w), np.diff(w.ptr).tolist()
            docs = [{"doc_id": ids[w.first + d], "key": keys[w.first + d], "n_words": n[d]} for d in range(w.n_docs)]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([docs], kind), *(pa.array([x.tobytes()], pa.binary()) for x in (s.ptr, s.term, s.begin, s.place))], names=["docs", "ptr", "term", "begin", "place"])


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of all documents."""
    texts = documents(docs, "doc_id", "text").select("doc_id", text_key().alias("key"), "text")
    return staged(texts.mapInArrow(_index, _INDEX), "postings", **_GROUPS)


def _shards(batches) -> Iterator[tuple[list[dict], Shard]]:
    for batch in batches:
        for i in range(batch.num_rows):
            docs, ptr, term, begin, place = (batch.column(c)[i].as_py() for c in ("docs", "ptr", "term", "begin", "place"))
            yield docs, Shard(np.frombuffer(term, np.uint64), np.frombuffer(begin, np.int32), np.frombuffer(place, np.int32), np.frombuffer(ptr, np.int32))


def frequencies(index: DataFrame, tokens: np.ndarray) -> np.ndarray:
    """How often each token stands in the whole index; one number a token comes back."""

    def run(batches):
        total = np.zeros(len(tokens), np.int64)
        for batch in batches:
            for term, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = Shard(np.frombuffer(term, np.uint64), np.frombuffer(begin, np.int32), None, None)
                at = s.numbers(tokens)
                total[at >= 0] += np.diff(s.begin)[at[at >= 0]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["i", "n"])

    got = staged(index.select("term", "begin").mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")), "frequencies").toArrow()
    out = np.zeros(len(tokens), np.int64)
    out[got.column("i").to_numpy()] = got.column("n").to_numpy()
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, str]]]:
    """Lists of (item_id, text) of at most BLOCK_BYTES each, one in memory at a time."""
    block, size = [], 0
    for row in picked(benchmark, {"item_id": T.StringType(), "text": T.StringType()}).filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        own = len(row.text.encode())
        if block and size + own > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += own
    if block:
        yield block


def _pass(block: Block):
    def run(batches):
        for docs, s in _shards(batches):
            window, start = block.matches(s)
            doc = np.searchsorted(s.ptr, start, side="right") - 1
            end = start + block.length[window]
            inside = end <= s.ptr[np.minimum(doc + 1, len(s.ptr) - 1)]
            window, start, end, doc = window[inside], start[inside], end[inside], doc[inside]
            rows = []
            for d in np.unique(doc):
                own = np.flatnonzero(doc == d)
                items = np.unique(np.concatenate([block.owner_item[block.owner_begin[q] : block.owner_begin[q + 1]] for q in np.unique(window[own])]))
                base = int(s.ptr[d])
                spans = sorted(set(zip((start[own] - base).tolist(), (end[own] - base - 1).tolist())))
                rows.append((docs[d]["doc_id"], docs[d]["key"], [{"item": block.items[i]} for i in items], [{"first": a, "last": b} for a, b in spans]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("item", pa.string())])), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "key", "items", "spans"])

    return run


def _covered(spans: Column) -> Column:
    """Words in sorted spans."""
    start = F.struct(F.lit(-1).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(acc, s):
        fresh = F.greatest(F.lit(0).cast("bigint"), s["last"] - F.greatest(s["first"] - 1, acc["end"]))
        return F.struct(F.greatest(acc["end"], s["last"]).alias("end"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(spans, start, step)["n"]


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key (of its text), n_words, n_hit, n_items, item_ids (sorted) and spans of words (first, last), for every document."""
    index, hits = build_index(docs), None
    for items in _blocks(benchmark):
        block = Block(items, window)
        block.by_rarest(frequencies(index, block.tokens))
        hits = staged(index.mapInArrow(_pass(block), _HITS), "hits", into=hits)
    every = index.select(F.inline("docs"))
    none = F.array().cast("array<string>"), F.array().cast("array<struct<first: bigint, last: bigint>>")
    if hits is None:
        return every.select("doc_id", "key", "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.lit(0).cast("bigint").alias("n_items"), none[0].alias("item_ids"), none[1].alias("spans"))
    by_text = hits.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    by_text = staged(by_text.withColumn("n_hit", _covered(F.col("spans"))), "leaks")
    out = every.join(by_text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    ids = F.array_sort(F.filter(F.transform("items", lambda x: x["item"]), lambda x: x.isNotNull()))
    return out.select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"), F.coalesce(ids, none[0]).alias("item_ids"), F.coalesce("spans", none[1]).alias("spans")
    )


def without_leaks(docs: DataFrame, leaks: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of the documents without a hit.

    The names of those with one are written first, so that Spark knows their size: it moves texts only if they are many.
    """
    hit = staged(leaks.filter("n_hit > 0").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct(), "hit")
    own = documents(docs, *dict.fromkeys((*columns, "doc_id", "text")))
    return own.join(hit, own["doc_id"].eqNullSafe(F.col("_d")) & (text_key() == F.col("_k")), "left_anti").select(*columns)


def near_matches(docs: DataFrame, phrases: list[str], slop: int = 5, index: DataFrame | None = None) -> DataFrame:
    """doc_id, phrase and position of its rarest word in the document, where all words of a phrase lie within its length plus ``slop`` words to either side."""
    index = build_index(docs) if index is None else index
    wanted = [np.unique(next(tv.words(pa.array([p], pa.string()))).hash) for p in phrases]
    spans = [len(next(tv.words(pa.array([p], pa.string()))).hash) + slop for p in phrases]

    def run(batches):
        for docs_, s in _shards(batches):
            rows = []
            for phrase, tokens, span in zip(phrases, wanted, spans):
                at = s.numbers(tokens)
                if not len(tokens) or (at < 0).any():
                    continue
                lists = sorted((s.place[s.begin[i] : s.begin[i + 1]].astype(np.int64) for i in at), key=len)
                here = lists[0]
                doc = np.searchsorted(s.ptr, here, side="right") - 1
                for other in lists[1:]:  # within the span and the document
                    i = np.searchsorted(other, np.maximum(here - span, s.ptr[doc]))
                    ok = (i < len(other)) & (other[np.minimum(i, len(other) - 1)] <= np.minimum(here + span, s.ptr[doc + 1] - 1))
                    here, doc = here[ok], doc[ok]
                rows += [(docs_[d]["doc_id"], phrase, p - int(s.ptr[d])) for p, d in zip(here.tolist(), doc.tolist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64()))], names=["doc_id", "phrase", "position"])

    return index.mapInArrow(run, "doc_id bigint, phrase string, position bigint")


def report(leaks: DataFrame) -> DataFrame:
    """The digest columns of find_leaks."""
    return leaks.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
