"""MinHash near-deduplication with ProbMinHash (operator 8).

Links are pairs of texts whose sets of five-word shingles have a Jaccard
index of at least 0.8.

ProbMinHash: every distinct shingle of weight w (here 1, since links are judged
on sets; counts play no part) starts a Poisson process of rate w, seeded by its hash; each arrival falls on one of
``m`` registers, and a register keeps the shingle that arrives first.  Two
documents agree in a register with a probability equal to the probability
Jaccard index of their weighted shingles; with weights 1 that is the Jaccard
index itself.  Arrivals later than a time at which all registers are almost
surely full are never drawn; the few documents with a register left empty draw
on to a later time, so stopping early changes no register.

Banding: ``bands`` hashes of ``rows`` registers.  Texts with equal words are
one node from the start.

Verification is exact and makes no pairs within a bucket.  All members of a
bucket are compared with one text, the hub: one row a member, with its differences.
Two members differ in what only one of their differences holds, so the rows of a hub
of up to ``WHOLE`` are settled in one task, each row read once.  Nor are differences of
larger ones dealt out shingle by shingle: those of a batch of texts go together, cut by value
into parts of about ``PART_CELLS`` of a hub, and a task counts a part.  Let R be the
shingles that most of a hub's members (and the hub) hold, D(A) = A ^ R, and
the slack of A be |D(A)| - c |A| with c = (1 - t) / (1 + t).  Since A and B are
linked if |A ^ B| <= c (|A| + |B|):

* members whose slacks sum to 0 or less are linked for sure, so the member of least
  slack is linked to all that any such link could join;
* in any other link D(A) and D(B) share at least half the sum of the slacks, so
  each holds a shared one in its prefix: the first of D when a text's own differences
  come first and common ones last.  Members with the same difference in their
  prefixes are the buckets of the next round.

Near copies with edits of their own share no difference, so a group ends after one
comparison a member.  A bucket never holds the hub it came from, so rounds end; they
stop when each bucket is in one component.

Defined results: class_id is the least doc_id of the component.  A text of
fewer words than a shingle is one shingle; a text without words (null, empty)
is alone.  Rows that repeat a doc_id are one document and give one row; it has
the links of all its texts.  Rows with a null doc_id
give one row each, alone, with null class_id.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import documents, in_slices, merged, release, staged

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4


def shingles_of(w: tv.Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, shingle and count, sorted by both."""
    gram, ok = w.grams(k)
    doc = w.doc_of()
    count = np.diff(w.ptr)
    short = np.flatnonzero((count > 0) & (count < k))
    d, h = doc[ok], gram[ok]
    if len(short):
        whole = np.array([_sequence(w.hash[w.ptr[i] : w.ptr[i + 1]]) for i in short], np.uint64)
        d, h = np.r_[d, short], np.r_[h, whole]
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    first = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])] if len(d) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return d[at], h[at], np.diff(np.r_[at, len(d)])


def _sequence(h: np.ndarray) -> np.uint64:
    acc = np.uint64(len(h))
    with np.errstate(over="ignore"):
        for x in h:
            acc = tv.mix64(acc * np.uint64(0x9E3779B97F4A7C15) + x)
    return acc


def probminhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """(n_docs, m) registers; rows of documents without shingles are zero."""
    total = np.bincount(doc, weight, n_docs)
    best = np.full(n_docs * m, np.inf)
    held = np.zeros(n_docs * m, np.uint64)
    open_docs = total > 0
    reach = np.zeros(n_docs)
    np.divide(m * (np.log(m) + 3.0), total, out=reach, where=open_docs)
    while open_docs.any():
        live = np.flatnonzero(open_docs[doc])
        time = np.zeros(len(live))
        slots, times, owners, turn = [], [], [], 0
        while len(live):
            turn += 1
            u = tv.mix64(h[live] + np.uint64((turn * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
            time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
            go = time < reach[doc[live]]
            live, time, u = live[go], time[go], u[go]
            reg = ((tv.mix64(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            slots.append(doc[live] * m + reg.astype(np.int64))
            times.append(time)
            owners.append(live)
        slot, when, who = np.concatenate(slots), np.concatenate(times), np.concatenate(owners)
        np.minimum.at(best, slot, when)
        won = when == best[slot]
        held[slot[won]] = h[who[won]]
        open_docs = open_docs & np.isinf(best.reshape(n_docs, m)).any(1)
        reach *= 2.0
    return held.reshape(n_docs, m)


def _signatures(k: int, bands: int, rows: int):
    m = bands * rows

    def run(batches):
        for batch in in_slices(batches):
            ids = batch.column(0).to_numpy()
            for w in tv.words(batch.column(1)):
                d, h, _ = shingles_of(w, k)
                reg = probminhash(d, h, np.ones(len(h)), w.n_docs, m)
                keys = np.zeros((w.n_docs, bands), np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        keys = tv.mix64(keys * np.uint64(0x9E3779B97F4A7C15) + reg[:, r::rows])
                    keys = tv.mix64(keys + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                    # equal word sequences: two sums over the whole sequence, order kept by powers
                    place = np.arange(len(w.hash), dtype=np.uint64) - np.repeat(w.ptr[:-1], np.diff(w.ptr)).astype(np.uint64)
                    terms = [tv.mix64(w.hash ^ tv.mix64(place + np.uint64(s))) for s in (11, 1 << 40)]
                sums = [np.concatenate(([np.uint64(0)], np.cumsum(t, dtype=np.uint64))) for t in terms]
                with np.errstate(over="ignore"):
                    same = [(s[w.ptr[1:]] - s[w.ptr[:-1]]).view(np.int64) for s in sums]
                some = np.flatnonzero(np.diff(w.ptr) > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[w.first + some]),
                        pa.array(same[0][some]),
                        pa.array(same[1][some]),
                        pa.FixedSizeListArray.from_arrays(pa.array(keys[some].view(np.int64).ravel()), bands).cast(pa.list_(pa.int64())),
                    ],
                    names=["id", "same1", "same2", "keys"],
                )

    return run


def _compare(k: int, t: float):
    """(id, hub, root, n, text_a, text_b) -> size of A, whether linked, and the shingles that only A or only the hub has."""

    def run(batches):
        for batch in in_slices(batches, "text_a"):
            left: list[np.ndarray] = []
            for w in tv.words(batch.column(4)):
                d, h, _ = shingles_of(w, k)
                cut = np.searchsorted(d, np.arange(w.n_docs + 1))
                left += [h[cut[i] : cut[i + 1]] for i in range(w.n_docs)]
            rows, before = [], None
            for n, a, text in zip(batch.column(3).to_pylist(), left, batch.column(5).to_pylist()):
                if text != before:  # rows of a hub follow each other
                    (w,) = tv.words(pa.array([text], pa.string()))
                    h, before = shingles_of(w, k)[1], text
                plus, minus = np.setdiff1d(a, h, assume_unique=True), np.setdiff1d(h, a, assume_unique=True)
                linked = len(a) - len(plus) >= t * (len(a) + len(minus)) - 1e-9
                if n < 2:  # nobody else was compared with this hub
                    plus, minus = plus[:0], minus[:0]
                rows.append((len(a), linked, plus.view(np.int64), minus.view(np.int64)))
            kinds = (pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(v, kind) for v, kind in zip(zip(*rows), kinds))], names=["id", "hub", "root", "n", "size", "linked", "plus", "minus"])

    return run


#: Members of a hub that one task compares.
SPREAD = 128
#: Rows of a hub, and differences in them, of which one task compares all pairs; shared differences that it multiplies at once.
WHOLE, WHOLE_CELLS, COLUMNS = 128, 1 << 22, 1 << 15
#: Differences of a larger hub that one task counts.
PART_CELLS = 1 << 20


def _compared(pairs: DataFrame, texts: DataFrame, k: int, t: float, turn: int) -> DataFrame:
    """``pairs``: id, hub.  A hub's members, and itself where it has several, are dealt over as many places as they need.

    A repeated id has several texts; ``root`` names the one that served as the hub, as only differences from one text can be compared.
    """
    counts = staged(pairs.groupBy("hub").agg(F.count("*").alias("n")), f"hubs-{turn}")
    places = F.expr(f"(n + {SPREAD - 1}) div {SPREAD}")
    hubs = counts.join(texts.select(F.col("id").alias("hub"), F.col("text").alias("text_b")), "hub").select("hub", "text_b", F.explode(F.sequence(F.lit(0).cast("bigint"), places - 1)).alias("place"))
    every = pairs.join(counts, "hub").select("id", "hub", "n").unionAll(counts.filter("n > 1").select(F.col("hub").alias("id"), "hub", "n"))
    left = every.withColumn("place", F.pmod(F.xxhash64("id"), places)).join(texts.select("id", F.col("text").alias("text_a")), "id")
    both = left.join(hubs, ["hub", "place"]).select("id", "hub", F.xxhash64("hub", "text_b").alias("root"), "n", "text_a", "text_b")
    met = staged(both.mapInArrow(_compare(k, t), "id bigint, hub bigint, root bigint, n bigint, size bigint, linked boolean, plus array<bigint>, minus array<bigint>"), f"met-{turn}")
    release(counts)
    return met


def _whole(t: float):
    """All rows of a hub (root, id, size, diff) -> a, b: a tree over each set of texts that links join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids, size = table.column("id").to_numpy(), table.column("size").to_numpy()
        diff = table.column("diff").combine_chunks()
        own = np.diff(diff.offsets.to_numpy())
        row = np.repeat(np.arange(len(ids)), own)
        _, at, df = np.unique(diff.flatten().to_numpy(), return_inverse=True, return_counts=True)
        some = df > 1  # what one text alone has is in no intersection
        held, row = (np.cumsum(some) - 1)[at][some[at]], row[some[at]]
        order = np.argsort(held, kind="stable")
        held, row = held[order], row[order]
        both = np.zeros((len(ids), len(ids)))
        for lo in range(0, int(some.sum()), COLUMNS):
            cut = slice(*np.searchsorted(held, (lo, lo + COLUMNS)))
            part = np.zeros((len(ids), COLUMNS), np.float32)
            part[row[cut], held[cut] - lo] = 1
            both += part @ part.T
        apart = own[:, None] + own[None, :] - 2 * both
        sizes = size[:, None] + size[None, :]
        linked = (sizes - apart) / 2 >= t * (sizes + apart) / 2 - 1e-9
        a, b, left = [], [], np.ones(len(ids), bool)
        while left.any():
            edge = [int(np.flatnonzero(left)[0])]
            left[edge] = False
            while edge:
                x = edge.pop()
                new = np.flatnonzero(linked[x] & left)
                left[new] = False
                edge += new.tolist()
                a += [ids[x]] * len(new)
                b += ids[new].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


_DEALT = "root bigint, part bigint, rows bigint, id array<bigint>, v array<bigint>, own array<bigint>, e array<bigint>"


def _by_parts(batches):
    """(root, id, v, rows, parts, diff) -> the differences dealt over a hub's parts: a row a batch, hub and part, not one a difference."""
    for batch in batches:
        root, ids, v, rows, parts = (c.to_numpy() for c in batch.columns[:5])
        e = batch.column(5).flatten().to_numpy()
        text = np.repeat(np.arange(len(ids)), batch.column(5).value_lengths().to_numpy())
        part = (e.view(np.uint64) % parts[text].astype(np.uint64)).astype(np.int64)
        order = np.lexsort((text, part, root[text]))
        e, text, part = e[order], text[order], part[order]
        group = np.diff(root[text], prepend=0).astype(bool) | np.diff(part, prepend=0).astype(bool)
        group[:1] = True
        one = np.flatnonzero(group | np.diff(text, prepend=0).astype(bool))
        at = np.flatnonzero(group)
        of, cut = text[one], np.r_[np.searchsorted(one, at), len(one)].astype(np.int32)
        lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (ids[of], v[of], np.diff(np.r_[one, len(e)]))]
        lists.append(pa.ListArray.from_arrays(np.r_[at, len(e)].astype(np.int32), pa.array(e)))
        yield pa.RecordBatch.from_arrays([pa.array(root[text[at]]), pa.array(part[at]), pa.array(rows[text[at]]), *lists], names=["root", "part", "rows", "id", "v", "own", "e"])


_SHARED = "root bigint, id bigint, v bigint, shared array<struct<df: bigint, e: bigint>>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part of a hub's differences -> those of each text that others have, with the number of texts; under a null id those of more than half."""
    table = pa.Table.from_batches(batches).combine_chunks()
    root, rows = (table.column(c)[0].as_py() for c in ("root", "rows"))
    ids, v, own, e = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("id", "v", "own", "e"))
    value, at, df = np.unique(e, return_inverse=True, return_counts=True)
    held = np.flatnonzero(df[at] > 1)
    text = np.repeat(np.arange(len(ids)), own)[held]
    first = np.flatnonzero(np.diff(text, prepend=-1))
    most = np.flatnonzero(2 * df > rows)

    def out(ids: pa.Array, v: pa.Array, cut: np.ndarray, df: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
        cells = pa.StructArray.from_arrays([pa.array(df), pa.array(e)], names=["df", "e"])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), root)), ids, v, pa.ListArray.from_arrays(cut.astype(np.int32), cells)], names=["root", "id", "v", "shared"])

    yield out(pa.array(ids[text[first]]), pa.array(v[text[first]]), np.r_[first, len(held)], df[at][held], e[held])
    if len(most):
        yield out(pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), np.array([0, len(most)]), df[most], value[most])


_PART = "root bigint, id bigint, size bigint, own bigint, rest array<bigint>, d bigint, most bigint"


def _against_most(batches):
    """Differences from R instead of the hub: ``own`` ones first, then the shared ones by frequency."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            shared = {x["e"]: x["df"] for x in r["shared"] or []}
            flipped = {x["e"]: r["rows"] - x["df"] for x in r["flipped"] or []}
            own = r["n_diff"] - len(shared)
            rest = [(df, e) for e, df in shared.items() if e not in flipped] + [(df, e) for e, df in flipped.items() if e not in shared]
            rows.append((r["root"], r["id"], r["size"], own, [e for _, e in sorted(rest)], own + len(rest), r["most"]))
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=["root", "id", "size", "own", "rest", "d", "most"])


def _children(met: DataFrame, within: DataFrame | None, t: float, turn: int) -> tuple[DataFrame, DataFrame | None]:
    """(links, members): sure links a, b; and key, id of members of one hub of more than ``WHOLE`` that share a difference in their prefixes, of which a pair could be linked, if there is such a hub."""
    c = (1 - t) / (1 + t)
    n_diff = F.size("plus") + F.size("minus")
    groups = met.filter("n > 1").groupBy("root", "hub").agg(F.count("*").alias("rows"), F.max("size").alias("most"), F.count_if(~F.col("linked")).alias("u"), F.sum(n_diff).alias("cells"))
    groups = staged(groups.filter("u > 0").select("root", "hub", "rows", "most", F.ceil(F.col("cells") / PART_CELLS).alias("parts"), (F.greatest(F.col("rows") / WHOLE, F.col("cells") / WHOLE_CELLS) <= 1).alias("whole")), f"open-{turn}")
    # a comparison is named by what was compared, as a repeated id can have several texts
    apart = F.concat("plus", F.transform("minus", lambda x: F.xxhash64(x, F.lit(-1)))).alias("diff")
    found = staged(met.join(groups.drop("hub"), "root").select("root", "id", "size", "rows", "most", "parts", "whole", apart).withColumn("v", F.xxhash64("size", "diff")), f"found-{turn}")
    settled = found.filter("whole").select("root", "id", "size", "diff").groupBy("root").applyInArrow(_whole(t), "a bigint, b bigint").filter("a <> b").distinct()
    if groups.filter("not whole").isEmpty():
        links = staged(settled, f"sure-{turn}")
        release(groups, found)
        return links, None
    large = found.filter("not whole")
    dealt = large.select("root", "id", "v", "rows", "parts", "diff").mapInArrow(_by_parts, _DEALT)
    shared = staged(dealt.groupBy("root", "part").applyInArrow(_counted, _SHARED), f"shared-{turn}")
    joined = F.flatten(F.collect_list("shared"))
    flipped = shared.filter("id is null").groupBy("root").agg(joined.alias("flipped"))  # at most two texts' shingles
    lists = shared.filter("id is not null").groupBy("root", "id", "v").agg(joined.alias("shared"))
    wide = large.select("root", "id", "v", "size", "rows", "most", F.size("diff").alias("n_diff")).join(lists, ["root", "id", "v"], "left").join(flipped, "root", "left")
    placed = staged(wide.mapInArrow(_against_most, _PART), f"part-{turn}")
    part = placed.withColumn("slack", F.col("d") - c * F.col("size"))
    nearest = part.groupBy("root").agg(F.min(F.struct("slack", "id")).alias("x"))
    least = staged(nearest.join(groups, "root").select("root", "hub", (-F.col("x.slack")).alias("room"), F.col("x.id").alias("nearest")), f"least-{turn}")
    part = part.join(least, "root").withColumn("u", F.col("slack") > F.col("room") + 1e-9)
    sure = part.filter("not u and id <> nearest").select(F.col("id").alias("a"), F.col("nearest").alias("b")).distinct()
    links = staged(sure.unionAll(settled), f"sure-{turn}")
    prefix = lambda need: F.greatest(F.lit(0), F.col("d") - F.greatest(F.lit(1), need) + 1)
    short = F.when(F.col("u"), prefix(F.ceil(F.col("slack") - 1e-9))).otherwise(prefix(F.floor((F.col("slack") + F.col("room")) / 2 + 1e-9) + 1))
    far = F.when(F.col("u"), prefix(F.ceil(F.col("slack") - c * F.least(F.col("size") / t, F.col("most")) - 1e-9))).otherwise(F.lit(0))
    part = part.filter("id <> hub").withColumn("short", short).withColumn("far", F.greatest("short", far))
    cells = part.select("root", "hub", "id", "u", "slack", "own", "short", F.posexplode(F.slice("rest", F.lit(1), F.greatest(F.lit(0), F.col("far") - F.col("own")).cast("int"))).alias("i", "e"))
    cells = cells.select("hub", "id", F.xxhash64("root", "e").alias("key"), "u", "slack", (F.col("own") + F.col("i") < F.col("short")).alias("near"))
    if within is not None:  # only pairs of one bucket count
        cells = cells.withColumnRenamed("key", "e").join(within, ["hub", "id"]).withColumn("key", F.xxhash64("key", "e"))
    cells = staged(cells.select("key", "id", "u", "slack", "near"), f"cells-{turn}")
    # of a linked pair the one of less slack has the difference in its short prefix, and the other has more than the room
    fits = cells.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.expr("min(slack) filter (where near) as least"), F.expr("max(slack) filter (where u) as most"))
    fits = staged(fits.filter("lo < hi and least <= most").select("key", "least"), f"fits-{turn}")
    out = staged(cells.join(fits, "key").filter("near or slack >= least").select("key", "id").distinct(), f"members-{turn}")
    release(groups, found, shared, placed, least, cells, fits)
    return links, out


def _stars(live: DataFrame, first: bool) -> DataFrame:
    """key, hub of every bucket.

    The hub meets most others.  At first it need not be a member: buckets of a group of near copies
    share its middle, namely the best member of the buckets that most of their members are in.
    """
    score = live.groupBy("id").agg(F.sum("n").alias("score"))
    best = live.join(score, "id").groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("top"))
    if not first:
        return best.select("key", (-F.col("top.neg")).alias("hub"))
    best = staged(best, "best")
    reach = staged(live.join(best, "key").groupBy("id").agg(F.max("top").alias("top")), "reach")
    votes = live.join(reach, "id").groupBy("key", "top").agg(F.count("*").alias("votes"))
    return votes.groupBy("key").agg(F.max(F.struct("votes", "top")).alias("t")).select("key", (-F.col("t.top.neg")).alias("hub"))


def link_buckets(member: DataFrame, texts: DataFrame, label: DataFrame | None, shingle: int, threshold: float) -> DataFrame | None:
    """``label`` (node, component) after all links inside buckets (``member``: key, id); ``texts``: id, text."""
    turn = 0
    while True:
        turn += 1
        at = member.withColumn("c", F.col("id")) if label is None else member.join(label.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
        marks = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
        groups = at.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"), *marks).filter("lo < hi")
        if turn > 1:  # one of the buckets with the same members
            groups = groups.groupBy("n", "x1", "x2").agg(F.min("key").alias("key"))
        groups = staged(groups.select("key", "n"), f"groups-{turn}")
        live = staged(member.join(groups, "key"), f"live-{turn}")
        release(member, groups)
        if live.isEmpty():
            break
        pairs = staged(live.join(staged(_stars(live, turn == 1), f"stars-{turn}"), "key").filter("id <> hub").select("key", "id", "hub"), f"pairs-{turn}")
        met = _compared(pairs.select("id", "hub").distinct(), texts, shingle, threshold, turn)
        sure, member = _children(met, None if turn == 1 else pairs, threshold, turn)
        label = merged(label, met.filter("linked").select(F.col("id").alias("a"), F.col("hub").alias("b")).unionAll(sure).distinct())
        release(met, live, pairs, sure)
        if member is None:
            break
    return label


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, class_size, kept (doc_id = class_id): one row per document."""
    base = documents(docs, "doc_id", "text")
    named = base.filter("doc_id is not null and text is not null").select("doc_id", "text")
    signed = staged(named.mapInArrow(_signatures(shingle, bands, rows), "id bigint, same1 bigint, same2 bigint, keys array<bigint>"), "signatures")
    # written, as other aggregates below, so that joins have plain exchanges, which Spark splits where a key is hot
    nodes = staged(signed.groupBy("same1", "same2").agg(F.min("id").alias("node"), F.max("id").alias("hi")), "nodes")
    twins = signed.select("id", "same1", "same2").join(nodes.filter("node < hi"), ["same1", "same2"]).filter("id > node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    label = merged(None, staged(twins.distinct(), "twins"))
    # the bands of one document for each distinct word sequence
    firsts = signed.join(nodes.select("same1", "same2", F.col("node").alias("id")), ["same1", "same2", "id"], "left_semi")
    banded = firsts.select("id", F.explode("keys").alias("key"))
    crowd = staged(banded.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key"), "crowd")
    member = staged(banded.join(crowd, "key").select("key", "id").distinct(), "members")
    involved = member.select(F.col("id").alias("doc_id")).distinct()
    several = named.join(involved, "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    texts = staged(several.select(F.col("doc_id").alias("id"), "text"), "texts")
    release(signed, nodes, crowd)
    label = link_buckets(member, texts, label, shingle, threshold)
    release(texts)
    ids = base.filter("doc_id is not null").select("doc_id").distinct()
    alone = base.filter("doc_id is null").select("doc_id", F.lit(None).cast("bigint").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(True).alias("kept"))
    if label is None:
        return ids.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(True).alias("kept")).unionAll(alone)
    sizes = staged(label.groupBy(F.col("component").alias("class_id")).agg(F.count("*").alias("class_size")), "sizes")
    classed = ids.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
    out = classed.join(sizes, "class_id", "left").select("doc_id", "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"), (F.col("doc_id") == F.col("class_id")).alias("kept"))
    return out.unionAll(alone)
