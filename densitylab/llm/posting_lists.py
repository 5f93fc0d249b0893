"""Approximate nearest neighbours by balanced posting lists (operator 11).

Nearness is the inner product.  With one more component, sqrt(M - |x|^2) for M the
largest squared length, all vectors have one length, and the largest inner product with a
query is the least distance from it (the query's own extra component is 0).

Fit: a bounded sample is halved again and again at the median of its projection on the
line between two means, so that lists are of nearly equal size; the mean of a list
is its centroid.  Centroids are the nodes of a graph of near neighbours, which each task holds
(at most LISTS centroids), and are searched by it alone.

Index: every vector goes to its nearest list, and to further ones whose centroid is no more than
BOUNDARY times as far, REPLICAS at most.  Equal vectors are one entry with the
``k`` + 1 least of their ids, which are all that can stand in an answer.

Search: the graph is searched from the nearest centroids outwards as far as RATIO times the
distance of the nearest one; these are the query's lists, however many they are.  Lists are
scanned whole.  Those that follow one another in the tree share a group of about GROUP entries;
a longer list is cut into several groups, and many queries of a group into several blocks, so that
no task depends on the size of a list.  Scores are inner products of the vectors as given,
in doubles, one row at a time, so that equal vectors have equal scores.

Defined results: rows are left out as in ``vectors.usable``, zero vectors too.  A row with a
null vec_id is a candidate, after all ids of a tie, and no query.  Repeated rows are
rows of their own: a query's own row alone is left out of its answer, and a repeated query has its answer
once a row.  Fewer candidates than ``k`` give all that the lists hold.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, staged
from .vectors import matrix, usable

#: Vectors in the sample, and its bytes; entries a list should have; lists at most.
SAMPLE, SAMPLE_BYTES, PER_LIST, LISTS = 65_536, 32 << 20, 256, 4096
NEIGHBOURS, FAR_LINKS, STARTS = 24, 4, 8
BOUNDARY, REPLICAS, RATIO, WALK = 1.02, 4, 1.2, 1.1
GROUP, QUERIES = 8192, 1024


@dataclass(frozen=True)
class Lists:
    """Centroids in the order of the tree (one component more than the vectors), their graph, and M."""

    centroids: np.ndarray
    graph: np.ndarray
    starts: np.ndarray
    largest: float


def lengthened(x: np.ndarray, largest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(largest - (x * x).sum(1), 0.0))[:, None]], 1)


def halved(x: np.ndarray, lists: int, seed: int = 17) -> np.ndarray:
    """Centroids of ``lists`` parts of nearly equal size, neighbours in the tree next to each other."""
    rng = np.random.default_rng(seed)

    def cut(at: np.ndarray, n: int) -> list[np.ndarray]:
        if n < 2 or len(at) < 2:
            return [x[at].mean(0)]
        own = x[at]
        a, b = own[rng.choice(len(at), 2, replace=False)]
        for _ in range(6):
            near = own @ (b - a) > (b @ b - a @ a) / 2
            if near.all() or not near.any():
                break
            a, b = own[~near].mean(0), own[near].mean(0)
        left = n // 2
        place = np.argsort(own @ (b - a), kind="stable")
        edge = len(at) * left // n
        return cut(at[place[:edge]], left) + cut(at[place[edge:]], n - left)

    return np.stack(cut(np.arange(len(x)), min(lists, len(x))))


def linked(c: np.ndarray, seed: int = 29) -> np.ndarray:
    """The graph: each centroid's nearest ones and some at random, so that it hangs together."""
    n = len(c)
    rng, near = np.random.default_rng(seed), min(NEIGHBOURS, n - 1)
    out = []
    for lo in range(0, n, 1024):
        d = (c * c).sum(1)[None, :] - 2 * c[lo : lo + 1024] @ c.T
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        nearest = np.argpartition(d, near - 1, 1)[:, :near] if near else np.zeros((len(d), 0), np.int64)
        out.append(np.concatenate([nearest, rng.integers(0, n, (len(d), FAR_LINKS))], 1))
    ring = np.stack([(np.arange(n) + 1) % n, (np.arange(n) - 1) % n], 1)  # neighbours in the tree
    return np.concatenate([np.concatenate(out), ring], 1).astype(np.int32)


def fit(entries: DataFrame, width: int, count: int, largest: float) -> Lists:
    """Lists of ``count`` entries, from a hashed sample of bounded size."""
    most = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    rows = entries.select(F.xxhash64("v").alias("h"), "v")
    if count > most:
        rows = rows.filter(F.pmod(F.xxhash64("h", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * 0.9 * most / count))
    x = np.array([r.v for r in rows.orderBy("h", "v").limit(most).collect()])
    c = halved(lengthened(x, largest), int(max(1, min(LISTS, count // PER_LIST, len(x) // 8))))
    starts = np.unique(np.linspace(0, len(c) - 1, min(STARTS, len(c))).astype(np.int64))
    return Lists(c, linked(c), starts, largest)


def searched(x: np.ndarray, lists: Lists, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance to the centroids met, inf for others; which are within ``ratio`` of the nearest), by rows of x.

    A row walks the graph from its nearest unvisited centroid, until that one is farther than the ratio (WALK at least) times the nearest.
    """
    c, rows, walk = lists.centroids, np.arange(len(x)), max(ratio, WALK) ** 2
    own, lengths = (x * x).sum(1), (c * c).sum(1)
    seen, left = np.full((len(x), len(c)), np.inf), np.full((len(x), len(c)), np.inf)

    def meet(row: np.ndarray, node: np.ndarray) -> None:
        new = np.isinf(seen[row, node])
        row, node = row[new], node[new]
        d = np.maximum(own[row] + lengths[node] - 2 * np.einsum("ij,ij->i", x[row], c[node]), 0.0)
        seen[row, node] = left[row, node] = d

    meet(np.repeat(rows, len(lists.starts)), np.tile(lists.starts, len(x)))
    live = rows
    while len(live):
        node = left[live].argmin(1)
        d = left[live, node]
        go = np.isfinite(d) & (d <= walk * seen[live].min(1))
        live, node = live[go], node[go]
        left[live, node] = np.inf
        near = lists.graph[node]
        meet(np.repeat(live, near.shape[1]), near.reshape(-1))
    return seen, seen <= ratio * ratio * seen.min(1, keepdims=True)


def entries_of(v: DataFrame, k: int) -> DataFrame:
    """v, ids: each different vector with the k + 1 least of its ids."""
    ranked = v.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id")))).filter(F.col("n") <= k + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("n", "vec_id"))), lambda s: s["vec_id"])
    return ranked.groupBy("v").agg(ids.alias("ids"))


def _placed(rows: DataFrame, lists: Lists, width: int, ratio: float, most: int | None) -> DataFrame:
    """A row for each of a vector's lists, ``most`` at most; rows are number, v and what goes along."""
    slab = max(16, (4 << 20) // (8 * len(lists.centroids)))
    shared = rows.sparkSession.sparkContext.broadcast(lists)  # at most LISTS centroids
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, slab):
                part = batch.slice(lo, slab)
                x = matrix(part.column(1), width)
                if most is None:  # a query's direction alone counts, so it gets the length of the entries
                    x = np.pad(x * (np.sqrt(held.largest) / np.linalg.norm(x, axis=1))[:, None], ((0, 0), (0, 1)))
                else:
                    x = lengthened(x, held.largest)
                seen, near = searched(x, held, ratio)
                if most is not None and near.sum(1).max() > most:
                    near &= seen <= np.partition(np.where(near, seen, np.inf), most - 1, 1)[:, most - 1 : most]
                row, node = np.nonzero(near)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int32)), *(c.take(at) for c in part.columns)], names=["list", *part.schema.names])

    return rows.mapInArrow(run, f"list int, {kinds}")


def groups_of(sizes: dict[int, int], group: int = GROUP) -> dict[int, tuple[int, int]]:
    """list -> (its first group, how many groups it has): lists in order fill groups; a larger list has groups of its own."""
    out, number, held = {}, 0, 0
    for at in sorted(sizes):
        n = sizes[at]
        if held and held + n > group:
            number, held = number + 1, 0
        parts = -(-n // group)
        out[at] = (number, parts)
        if parts > 1:
            number, held = number + parts, 0
        else:
            held += n
    return out


def nearest(vectors: DataFrame, query: Column, k: int = 20, ratio: float = RATIO) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``query`` marks, the ``k`` nearest other rows that its lists hold."""
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    v, width = usable(vectors, zero=False)
    if not width:
        return spark.createDataFrame([], schema)
    entries = staged(entries_of(v.select("vec_id", "v"), k).select(F.monotonically_increasing_id().alias("entry"), "v", "ids"), "entries")
    asked = v.filter(F.coalesce(query, F.lit(False)) & F.col("vec_id").isNotNull()).select("vec_id", "v")
    questions = staged(asked.select("v").distinct().select(F.monotonically_increasing_id().alias("q"), "v"), "questions")
    facts = entries.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    lists = fit(entries, width, facts.n, facts.m)
    index = staged(_placed(entries, lists, width, BOUNDARY, REPLICAS), "posting-lists")
    probes = staged(_placed(questions, lists, width, ratio, None), "probes")
    # a row a list, of which there are at most LISTS
    sizes = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}
    wanted = {r["list"]: r["n"] for r in probes.groupBy("list").agg(F.count("*").alias("n")).collect()}
    place, asks = groups_of(sizes), {}
    for at in place:
        asks[place[at][0]] = max(asks.get(place[at][0], 1), wanted.get(at, 0))
    rows = [(at, g, parts, -(-asks[g] // QUERIES)) for at, (g, parts) in place.items()]
    plan = F.broadcast(spark.createDataFrame(rows, "list int, first int, parts int, blocks int"))
    spread = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = index.join(plan, "list").select("list", (F.col("first") + spread("entry", "parts")).alias("group"), every("blocks").alias("block"), "entry", "v", "ids")
    sought = probes.join(plan, "list").select("list", spread("q", "blocks").alias("block"), "q", "v", "first", every("parts").alias("part"))
    best = _scanned(held, sought.select("list", (F.col("first") + F.col("part")).alias("group"), "block", "q", "v"), width, k)
    once = best.dropDuplicates(["q", "entry"])  # replicas in lists of different groups meet again
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last(F.col("ids")[0]))
    top = once.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).select("q", "score", "same", F.explode("ids").alias("vec_id"))
    rank = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = top.withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score", "same"))).alias("found"))
    answers = staged(questions.join(found, "q").select("v", "found"), "answers")
    both = asked.join(answers, "v").select(F.col("vec_id").alias("query_id"), "found")
    own = F.array_position(F.transform("found", lambda s: s["same"] & s["vec_id"].eqNullSafe(F.col("query_id"))), True)
    rest = F.when(own > 0, F.filter("found", lambda s, i: i + 1 != own)).otherwise(F.col("found"))
    release(index, probes)
    return both.select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("rank", "s")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("s.vec_id").alias("vec_id"), F.col("s.score").alias("score"))


def _scanned(held: DataFrame, sought: DataFrame, width: int, k: int) -> DataFrame:
    """The k + 1 best entries of each query in each group; ``same``: the entry is the query's own vector."""
    kinds = pa.schema([("q", pa.int64()), ("entry", pa.int64()), ("score", pa.float64()), ("same", pa.bool_()), ("ids", pa.list_(pa.int64()))])

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        x, w = matrix(left.column("v"), width), matrix(right.column("v"), width)
        entry, asked = left.column("entry").to_numpy(), right.column("q").to_numpy()
        at, want = left.column("list").to_numpy(), right.column("list").to_numpy()
        rows, cols = [], []
        for one in np.intersect1d(at, want):
            mine, asks = np.flatnonzero(at == one), np.flatnonzero(want == one)
            for lo in range(0, len(asks), 256):
                own = asks[lo : lo + 256]
                s = w[own] @ x[mine].T
                least = np.full(len(own), -np.inf)
                if len(mine) > k + 1:  # what rounding could bring among the best is kept for the exact score
                    least = np.partition(s, len(mine) - k - 1, 1)[:, len(mine) - k - 1]
                    least = least - 1e-9 * (1 + np.abs(least))
                i, j = np.nonzero(s >= least[:, None])
                rows.append(own[i])
                cols.append(mine[j])
        if not rows:
            return kinds.empty_table()
        row, col = np.concatenate(rows), np.concatenate(cols)
        _, once = np.unique(np.stack([asked[row], entry[col]]), axis=1, return_index=True)  # replicas in lists of this group
        row, col = row[once], col[once]
        score = np.concatenate([(w[row[lo : lo + 65536]] * x[col[lo : lo + 65536]]).sum(1) for lo in range(0, len(row), 65536)])
        first = left.column("ids").combine_chunks()
        first = pa.compute.fill_null(pa.compute.list_element(first, 0), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        order = np.lexsort((first[col], -score, asked[row]))
        who = asked[row][order]
        order = order[np.arange(len(order)) - np.searchsorted(who, who) <= k]
        row, col, score = row[order], col[order], score[order]
        same = np.concatenate([(w[row[lo : lo + 65536]] == x[col[lo : lo + 65536]]).all(1) for lo in range(0, len(row), 65536)])
        return pa.table([pa.array(asked[row]), pa.array(entry[col]), pa.array(score), pa.array(same), left.column("ids").take(pa.array(col))], schema=kinds)

    return held.groupBy("group", "block").cogroup(sought.groupBy("group", "block")).applyInArrow(scan, "q bigint, entry bigint, score double, same boolean, ids array<bigint>")
