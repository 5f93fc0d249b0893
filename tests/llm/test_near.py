"""Near duplicates: groups of near copies against all pairs, repeated ids, repeated passages."""

import random

import numpy as np
import pyarrow as pa
import pytest

from densitylab.llm import common, near_dedup, textvec
from densitylab.llm.common import staged

from test_llm import near_truth


def edited(words, n, r, kinds="sid"):
    w = list(words)
    for _ in range(n):
        i, kind = r.randrange(len(w)), r.choice(kinds)
        new = "".join(r.choice("abcdefghij") for _ in range(5))
        w[i : i + (kind != "i")] = [] if kind == "d" else [new]
    return w


def family(seed, copies=60, middle=True, kinds="sid"):
    """Near copies of one text and copies of some of them, of which about half are linked."""
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(120)]
    out = [base] if middle else []
    out += [edited(base, r.randint(1, 9), r, kinds) for _ in range(copies)]
    for k in range(3):  # families inside the family
        out += [edited(out[-1 - k], r.randint(0, 4), r, kinds) for _ in range(copies // 6)]
    r.shuffle(out)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize(("seed", "middle", "kinds"), [(1, True, "s"), (2, True, "sid"), (3, False, "sid"), (4, True, "d")])
def test_one_bucket_equals_all_pairs(spark, seed, middle, kinds):
    texts = dict(enumerate(family(seed, 60, middle, kinds)))
    t = staged(spark.createDataFrame(list(texts.items()), "id bigint, text string"), "t")
    label = near_dedup.link_buckets(staged(t.selectExpr("1L as key", "id"), "m"), t, None, 5, 0.8)
    got = {r.node: r.component for r in label.collect()}
    truth = near_truth(texts)
    assert {i: got.get(i, i) for i in texts} == truth and 1 < len(set(truth.values())) < len(truth)


def test_families_equal_all_pairs(spark):
    texts = dict(enumerate(family(5, 40) + family(6, 25) + family(7, 25, False)))
    rows = near_dedup.near_duplicate_classes(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == near_truth(texts)
    sizes = {}
    for r in rows:
        sizes[r.class_id] = sizes.get(r.class_id, 0) + 1
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in rows)


def test_a_repeated_id_has_the_links_of_all_its_texts(spark):
    a, b, c = (" ".join(w) for w in ([f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)], [f"c{i}" for i in range(60)]))
    rows = [(1, a), (2, b), (2, f"{a} tail"), (3, f"{b} end"), (4, c), (4, c), (5, c.upper())]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_recall_with_repeated_passages():
    """Pairs at an index of 0.811, one of which repeats a passage 200 times, meet in the bands of production."""
    r, met = random.Random(9), 0
    run = near_dedup._signatures(near_dedup.SHINGLE, near_dedup.BANDS, near_dedup.ROWS)
    for _ in range(100):
        w = [f"w{r.randrange(10**9)}" for _ in range(120)]
        other = w + [f"v{r.randrange(10**9)}" for _ in range(20)] + w[-10:] * 200
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([" ".join(w), " ".join(other)])], names=["doc_id", "text"])
        keys = [k for b in run(iter([batch])) for k in b.column("keys").to_pylist()]
        met += bool(set(keys[0]) & set(keys[1]))
    assert met >= 99


def test_weighted_registers_estimate_the_probability_index():
    r = np.random.default_rng(1)
    h = np.sort(r.integers(0, 1 << 63, 200, dtype=np.uint64))
    x, y = r.integers(1, 6, 200).astype(float), r.integers(1, 6, 200).astype(float)
    want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(200))
    reg = near_dedup.probminhash(np.repeat([0, 1], 200), np.r_[h, h], np.r_[x, y], 2, 4000)
    assert abs((reg[0] == reg[1]).mean() - want) < 0.03
    words = next(textvec.words(pa.array(["a b a b a b"])))
    assert near_dedup.shingles_of(words, 2)[2].tolist() in ([3, 2], [2, 3])


def test_hubs_that_fit_a_task_take_one_round(spark, monkeypatch):
    """Their differences are compared where they are, not dealt out shingle by shingle and bucket by bucket."""
    turns, real = [], near_dedup._compared
    monkeypatch.setattr(near_dedup, "_compared", lambda *a: turns.append(a[-1]) or real(*a))
    texts = dict(enumerate(family(8, 80)))
    t = staged(spark.createDataFrame(list(texts.items()), "id bigint, text string"), "t")
    got = {r.node: r.component for r in near_dedup.link_buckets(staged(t.selectExpr("1L as key", "id"), "m"), t, None, 5, 0.8).collect()}
    assert {i: got.get(i, i) for i in texts} == near_truth(texts) and turns == [1]


@pytest.mark.parametrize(("rows", "cells", "columns"), [(8, 1 << 22, 1 << 15), (128, 2000, 1 << 15), (128, 1 << 22, 50)])
def test_hubs_beyond_a_task_equal_all_pairs(spark, monkeypatch, rows, cells, columns):
    monkeypatch.setattr(near_dedup, "WHOLE", rows)
    monkeypatch.setattr(near_dedup, "WHOLE_CELLS", cells)
    monkeypatch.setattr(near_dedup, "COLUMNS", columns)
    texts = dict(enumerate(family(2, 60) + family(3, 25, False)))
    rows = near_dedup.near_duplicate_classes(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == near_truth(texts)


@pytest.mark.parametrize("most", [2, 128])
def test_differences_from_two_texts_of_a_hub_are_not_mixed(spark, monkeypatch, most):
    """Document 1 has a short and a long text; 2 is too far from the short one (index 0.71), 3 is near to it."""
    monkeypatch.setattr(near_dedup, "WHOLE", most, raising=False)
    short, long = [f"a{i}" for i in range(120)], [f"b{i}" for i in range(400)]
    far, near = list(short), [*short, "end"]
    for i in (20, 45, 70, 95):
        far[i] = f"x{i}"
    rows = [(1, short), (1, long), (2, far), (3, near)]
    t = staged(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "id bigint, text string"), "t")
    label = near_dedup.link_buckets(staged(t.selectExpr("1L as key", "id").distinct(), "m"), t, None, 5, 0.8)
    got = {r.node: r.component for r in label.collect()}
    assert {i: got.get(i, i) for i in (1, 2, 3)} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("parts", [1, 3])
def test_differences_of_a_large_hub_go_together(parts):
    """A batch gives a row a part of the hub, not one a difference, and a part's counts are those of all its texts."""
    r = random.Random(parts)
    diffs = [[*r.sample(range(-40, 40), 12), 1000 + i, 50] for i in range(300)] + [[]]
    ids = list(range(len(diffs)))
    same = lambda x: pa.array([x] * len(ids), pa.int64())
    whole = pa.RecordBatch.from_arrays([same(7), pa.array(ids), pa.array(ids), same(len(ids)), same(parts), pa.array(diffs, pa.list_(pa.int64()))], names=["root", "id", "v", "rows", "parts", "diff"])
    dealt = list(near_dedup._by_parts(iter([whole.slice(0, 100), whole.slice(100)])))
    assert [b.num_rows for b in dealt] == [parts, parts]
    df = {e: sum(e in d for d in diffs) for d in diffs for e in d}
    got, most = {}, []
    for p in range(parts):
        one = [b.filter(pa.array([x == p for x in b.column("part").to_pylist()])) for b in dealt]
        for x in (x for b in near_dedup._counted(iter(one)) for x in b.to_pylist()):
            cells = [(c["e"], c["df"]) for c in x["shared"]]
            most += cells if x["id"] is None else []
            got.setdefault(x["id"], []).extend(cells)
    got.pop(None)
    assert most == [(50, 300)] and {i: sorted(c) for i, c in got.items()} == {i: sorted((e, df[e]) for e in d if df[e] > 1) for i, d in enumerate(diffs) if d}


@pytest.mark.parametrize("cells", [200, 1 << 20])
def test_hubs_counted_in_parts_equal_all_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(near_dedup, "WHOLE", 8)
    monkeypatch.setattr(near_dedup, "PART_CELLS", cells)
    texts = dict(enumerate(family(9, 60) + family(10, 25, False)))
    rows = near_dedup.near_duplicate_classes(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == near_truth(texts)


@pytest.mark.parametrize("few", [0, 1 << 14])
def test_few_edges_are_one_step(spark, monkeypatch, few):
    steps, real = [], common.staged
    monkeypatch.setattr(common, "FEW_EDGES", few)
    monkeypatch.setattr(common, "staged", lambda df, label, **k: steps.append(label) or real(df, label, **k))
    edges = [(i, i + 1) for i in range(1, 40)] + [(90, 70), (70, 80), (95, 95)] + [(-5, 300), (300, -5)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 70: 70, 80: 70, 90: 70, 95: 95, -5: -5, 300: -5}
    assert (len(steps) == 1) == bool(few)
