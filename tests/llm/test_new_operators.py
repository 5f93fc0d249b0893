"""Operators 11 to 13 against brute force."""

import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from densitylab.llm import heap_lloyd, importance, posting_lists, queries
from densitylab.llm import textvec as tv

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VECTORS = "vec_id bigint, embedding array<float>, label int"


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute_importance(docs, target, least=20, percent=5):
    def grams(text):
        w = WORD.findall(lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    s, t = np.zeros(10000, int), np.zeros(10000, int)
    own = [(i, *grams(x)) for i, x in docs]
    for _, _, g in own:
        np.add.at(s, g, 1)
    for x in target:
        np.add.at(t, grams(x)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10000) / ((s[b] + 1) * (t.sum() + 10000)))) for b in range(10000)]
    rows = []
    for i, n, g in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        rows.append((i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: len(fit) * percent // 100])}
    return sorted((str(r[0]), r[2], r[3], r[4], ranks.get(id(r))) for r in rows)


def rows_of(df):
    return sorted(((str(r.doc_id), r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_importance_of_any_rows(spark):
    long = "w" * 300 + " " + "x" * 49 + " y" * 60
    texts = ["Alpha beta GAMMA " * 9, None, "", "one", "two words", long, "ünï côde ÀB " * 10, "a-b_c.d" * 12, "\x00nul\x00 \x7f del " * 8, "alpha beta gamma " * 9]
    docs = [(i, t) for i, t in enumerate(texts * 5)] + [(None, texts[0]), (None, None)]
    target = ["beta gamma alpha", None, "", "ünï"]
    frame = spark.createDataFrame([(i, t, "z", 7) for i, t in docs], "doc_id bigint, text string, Text string, rank int")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        got = rows_of(importance.resample(frame, spark.createDataFrame([(t,) for t in target], "text string")))
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert got == sorted(brute_importance(docs, target), key=str)
    assert len({r[4] for r in got if r[4]}) == len([r for r in got if r[4]])


def test_importance_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows_of(queries.op13_importance(spark, SF)) == sorted(brute_importance(docs, target), key=str)


def test_importance_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert importance.resample(empty, empty).count() == 0
    one = importance.resample(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), empty).first()
    assert (one.n_features, one["rank"]) == (3, None)


def test_slices_of_words_change_nothing():
    import pyarrow as pa

    texts = pa.array(["a bb ccc dddd " * 40, "", "x", None, "q r s"])
    (w,) = tv.words(texts, hashes=False)
    every = lambda size: sorted((int(d), k, int(c)) for k, doc, crc in importance.features(w, slice_words=size) for d, c in zip(doc, crc))
    assert every(3) == every(1 << 17)


@pytest.mark.parametrize("n, entries", [(700, 64), (3, 64), (300, 1)])
def test_heap_codes_equal_lloyd(spark, n, entries):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 32)).astype(np.float32) * 0.2
    x[n // 2 :] = x[rng.integers(0, n // 2 + 1, n - n // 2)]  # many copies: ties
    rows = [(int(i), v.tolist(), None if i % 7 == 0 else int(i % 3)) for i, v in zip(rng.permutation(n), x)]
    bad = [(900001, None, 1), (900002, [None] * 32, 1), (900003, [float("nan")] + [0.0] * 31, 1), (900004, [float("inf")] * 32, 1), (900005, [], 1), (900006, [1.0] * 16, 1)]
    frame = spark.createDataFrame(rows + (bad if n > 3 else bad[:5]), VECTORS).repartition(3)
    coded, books = heap_lloyd.compress(frame, entries=entries)
    got = {r.vec_id: r for r in heap_lloyd.with_label_error(coded).collect()}
    at = sorted(rows)
    z = np.floor(256 * np.array([r[1] for r in at])).astype(np.int64).reshape(n, 16, 2)
    book = z[:entries].transpose(1, 0, 2).copy()
    near = lambda p: ((z[:, p, None] - book[p][None]) ** 2).sum(2)
    for _ in range(2):
        for p in range(16):
            a = near(p).argmin(1)
            for e in set(a.tolist()):
                book[p, e] = z[a == e, p].sum(0) // (a == e).sum()
    assert (book == books).all()
    code = np.stack([near(p).argmin(1) for p in range(16)], 1)
    error = sum(near(p).min(1) for p in range(16))
    label = {}
    for r, e in zip(at, error):
        label[r[2]] = label.get(r[2], 0) + int(e)
    assert len(got) == n
    assert all(got[r[0]].code == "".join(f"{c:02x}" for c in code[i]) and got[r[0]].error == error[i] and got[r[0]].label_error == label[r[2]] for i, r in enumerate(at))


def test_only_violated_parts_are_popped():
    heap = heap_lloyd.heaps(np.array([0, 0, 1, 0]), np.array([3.0, 1.0, 0.5, 2.0]), 2)
    assert heap_lloyd.violated(heap[0], 2.0) == [1, 3] and [r for _, r in heap[0]] == [0]
    assert heap_lloyd.violated(heap[1], 0.1) == []


def test_heap_codes_oracle_and_edges(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.sql(heap_lloyd.ORACLE_SQL).fetchall()
    got = queries.op12_heap_codes(spark, SF).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert heap_lloyd.with_label_error(heap_lloyd.compress(spark.createDataFrame([], VECTORS))[0]).count() == 0
    twice = spark.createDataFrame([(1, [0.5] * 16, None), (1, [0.5] * 16, None), (None, [0.5] * 16, 2)], VECTORS)
    assert sorted((r.code, r.error) for r in heap_lloyd.compress(twice)[0].collect()) == [("00" * 16, 0)] * 3
    with pytest.raises(ValueError):
        heap_lloyd.compress(spark.createDataFrame([(1, [0.5] * 15, None)], VECTORS))


def brute_nearest(rows, k=20):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.stack([v for _, v in ok])
    out = {}
    for n, (i, v) in enumerate(ok):
        if i is not None and i % 20 == 0:
            s = (x * v).sum(1)
            order = sorted((m for m in range(len(ok)) if m != n), key=lambda m: (-s[m], ok[m][0] is None, ok[m][0] or 0))[:k]
            out.setdefault(i, []).append([(ok[m][0], float(s[m])) for m in order])
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_nearest_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = brute_nearest(rows), answers(queries.op11_nearest(spark, SF))
    assert want.keys() == got.keys() and all([r for r, _, _ in v] == list(range(1, 21)) for v in got.values())
    exact = {(q, i): s for q, (own,) in want.items() for i, s in own}
    assert all(abs(s - exact[q, i]) < 1e-12 for q, v in got.items() for _, i, s in v if (q, i) in exact)
    hits = sum((q, i) in exact for q, v in got.items() for _, i, _ in v)
    assert hits >= 0.95 * len(exact)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="larger table")
def test_nearest_recall_of_many_lists(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/check_s/embeddings.parquet").collect()]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    got = answers(posting_lists.nearest(spark.read.parquet("/root/testdata/check_s/embeddings.parquet"), F.col("vec_id") % 20 == 0))
    hits = 0
    for q, own in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        hits += len(set(ids[np.argpartition(-s, 20)[:20]].tolist()) & {i for _, i, _ in own})
    assert len(got) == (ids % 20 == 0).sum() and hits >= 0.95 * 20 * len(got)


def test_nearest_of_copies_and_bad_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    hot = [(i, x[0].tolist()) for i in range(100, 160)]  # one vector in half of the rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + hot + [(40, x[40].tolist()), (20, x[3].tolist()), (None, x[0].tolist()), (200, None), (220, [0.0] * 8), (240, [float("nan")] * 8), (260, [1.0, None] * 4), (280, [1.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).repartition(3)
    got = posting_lists.nearest(frame, F.col("vec_id") % 20 == 0, ratio=100.0)  # all lists: exact
    want = brute_nearest([(i, v) for i, v in rows if v is None or len(v) == 8])
    pairs = lambda many: sorted((q, i if i is not None else -1, round(s, 9)) for q, own in many.items() for one in own for i, s in one)
    assert sorted((r.query_id, r.vec_id if r.vec_id is not None else -1, round(r.score, 9)) for r in got.collect()) == pairs(want)
    assert posting_lists.nearest(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0
    few = posting_lists.nearest(spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 1.0], 1)], VECTORS), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few] == [(0, 1, 1, 3.0)]


def test_groups_of_lists():
    place = posting_lists.groups_of({0: 10, 1: 5, 2: 100, 3: 7, 4: 90}, 16)
    assert place == {0: (0, 1), 1: (0, 1), 2: (1, 7), 3: (8, 1), 4: (9, 6)}
