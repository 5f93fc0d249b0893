"""Queries over whole tables against brute force and their SQL."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from densitylab.operators import clones, compare, diagnostics, folds, kernel, ordering, qc
from densitylab.operators.stage import Stage
from densitylab.plans import fixtures, queries

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_traits_reach_every_order_and_customer(spark):
    segment, prices = {c.c_custkey: c.c_mktsegment for c in rows(spark, "customer")}, defaultdict(list)
    orders = rows(spark, "orders")
    for o in orders:
        if o.o_custkey in segment:
            prices[segment[o.o_custkey]].append(o.o_totalprice)
    got = {r.group_id: r for r in queries.QUERIES["trait_alignment"](spark, SF).collect()}
    assert {g: r.n for g, r in got.items()} == {g: len(p) for g, p in prices.items()} and sum(r.n for r in got.values()) == len(orders)
    assert all(got[g].mean_value == pytest.approx(sum(p) / len(p), abs=1e-5) for g, p in prices.items())
    labelled = {r.doc_id for r in rows(spark, "labels")}
    want = {str(d.doc_id) for d in rows(spark, "documents") if d.n_chars is not None and d.doc_id is not None and d.doc_id not in labelled}
    assert want and {r.sample_id for r in queries.QUERIES["unmatched_traits"](spark, SF).collect()} == want


def test_gram_and_counts_reach_every_training_row(spark):
    train = queries._train(spark, SF).collect()
    ids, means, stats = sorted({r.sample_idx for r in train}), defaultdict(list), {r.marker_idx: r.mean for r in queries.qc.eligible(queries._train(spark, SF)).collect()}
    z = defaultdict(dict)
    for r in train:
        if r.g is not None:
            means[r.marker_idx].append(r.g)
            if r.marker_idx in stats:
                z[r.sample_idx][r.marker_idx] = r.g - stats[r.marker_idx]
    got = {(r.i, r.j): r.k for r in queries.QUERIES["gram_entries"](spark, SF).collect()}
    assert set(got) == {(i, j) for i in ids for j in ids if i <= j}
    assert all(k == pytest.approx(sum(v * z[j].get(m, 0) for m, v in z[i].items()), abs=1e-5) for (i, j), k in got.items())
    counts = {r.marker_idx: r for r in queries.QUERIES["vec_counts"](spark, SF).collect()}
    assert {m: (r.n, r.mean) for m, r in counts.items()} == {m: (len(ids), pytest.approx(sum(v) / len(v), abs=1e-7)) for m, v in means.items()}


def test_ranks_of_a_table_larger_than_a_sample_of_it(spark):
    ids = [str(i * 7919 % 30011) for i in range(30000)]
    df = spark.createDataFrame([(x, int(x) % 3) for x in ids], "sample_id string, k int").repartition(7)
    got = {r.sample_id: r["rank"] for r in ordering.ranked(df, "sample_id").collect()}
    assert got == {x: i for i, x in enumerate(sorted(ids))}
    digest = {x: hashlib.sha256(f"7\t{x}".encode()).hexdigest() for x in ids}
    dealt = {r.sample_id: r.fold for r in folds.hashed_folds(df, 5, 7).collect()}
    assert dealt == {x: i % 5 for i, x in enumerate(sorted(ids, key=digest.get))}
    by = {r.sample_id: r["rank"] for r in ordering.ranked(df, "sample_id", keys=("k",)).collect()}
    assert by == {x: i for k in range(3) for i, x in enumerate(sorted(x for x in ids if int(x) % 3 == k))}


def test_plan_of_counts_does_not_grow_with_samples(spark):
    vec = spark.createDataFrame([(0, [1] * 3000), (1, [0, 2, None] * 1000)], "marker_idx int, g array<tinyint>")
    few, many = (qc.vec_counts(vec, range(n)) for n in (3, 3000))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(many) < size(few) + 100
    assert [(r.marker_idx, r.called, r["rows"], r.total, r.mean) for r in many.orderBy("marker_idx").collect()] == [(0, 3000, 3000, 3000, 1.0), (1, 2000, 3000, 2000, 1.0)]


def test_diagnostics_take_all_training_samples(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet'")
    want = {r[1]: r[2:] for r in c.execute(queries.ORACLE["kernel_diagnostics"]).fetchall()}
    got = {r.workflow: tuple(r)[2:] for r in queries.QUERIES["kernel_diagnostics"](spark, "/root/testdata/sf0.1").collect()}
    assert got.keys() == want.keys() and want["physical:20"][0] > 512
    assert all(got[w] == pytest.approx(want[w], abs=2e-6) for w in want)


def test_hashed_replicates_make_no_row_for_a_draw(spark):
    rows = [(0, f, f"g{i:03d}", float(i + 1) * (f + 1), float(i % 7 + 1), 1 + i % 3) for f in range(2) for i in range(300)]
    sums = spark.createDataFrame(rows, "pair int, fold int, group_id string, d double, b double, n bigint").repartition(3)
    want = {}
    for rep in range(30):
        d = b = n = 0
        for f in range(2):
            own = [r for r in rows if r[1] == f]
            h = compare.mixed_number((compare.mixed_number((compare.mixed_number(compare.mixed_number(5)) + f) & 0xFFFFFFFF) + rep) & 0xFFFFFFFF)
            for k in range(300):
                x = own[compare.mixed_number((h + k) & 0xFFFFFFFF) % 300]
                d, b, n = d + x[3], b + x[4], n + x[5]
        want[rep] = (pytest.approx(d / n), pytest.approx(-d / b))
    for segment in (64, 1 << 20):  # parts of a fold's groups, or all
        made = compare.hashed_replicates(sums, 30, 5, batch=8, segment=segment)
        assert {r.rep: (r.delta_mse, r.gain) for r in made.collect()} == want
        assert "sequence(0, (m" not in made._jdf.queryExecution().optimizedPlan().toString()  # draws aren't exploded


def test_tiles_are_dealt_by_number_and_gone_through_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    g = rng.integers(0, 3, (12, 60)).tolist()
    vec = spark.createDataFrame([(i, row) for i, row in enumerate(g)], "marker_idx int, g array<tinyint>")
    links = clones.links(vec, 60, 0.3, tile=6)
    assert links.rdd.getNumPartitions() > 4  # 55 tiles, whose bytes would fit in one partition
    x = np.array(g)
    near = {(i, j) for i in range(60) for j in range(i + 1, 60) if abs(x[:, i] - x[:, j]).sum() <= 2 * 0.3 * 12 + 1e-9}
    whole = least_members(60, near)
    assert least_members(60, {(r.a, r.b) for r in links.collect()}) == whole
    fit = kernel.Fit("outer/0", tuple(range(50)), ())
    stats = qc.fit_eligible(vec, {"outer/0": fit.train}, 0, 0).select("fit_id", "marker_idx", "mean", F.lit(1.0).alias("scale"), (F.col("marker_idx") % 2).alias("tier"))
    with Stage(spark) as stage:
        strips = stage.put(kernel.loaded(vec, stats, [fit]), "strips")
        near = diagnostics.relationship(strips, 60, [(0, fit)], {"half": [0], "all": [0, 1]}, "all")
        assert near._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1
        d = rng.normal(size=(60, 2))
        systems = [kernel.System(0, t, d) for t in ((0,), (0, 1))]
        monkeypatch.setattr(kernel, "DIRECT_BYTES", 1 << 30)
        direct = kernel.products(strips.repartition(3), systems)
        monkeypatch.setattr(kernel, "DIRECT_BYTES", 0)  # tasks add up what is too large for the driver to add
        monkeypatch.setattr(kernel, "ROWS_BYTES", 100)
        assert all(np.allclose(a, b) for a, b in zip(kernel.products(strips.repartition(3), systems), direct))


def shuffled(spark, run):
    """Bytes that the stages of ``run`` write to shuffles."""
    sc = spark.sparkContext
    store = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    sums = lambda: sum(stages.apply(i).shuffleWriteBytes() for stages in [store()] for i in range(stages.size()))
    before = sums()
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sums() - before


def test_entries_deal_out_no_more_than_the_genotypes(spark):
    rng, written = np.random.default_rng(5), []
    with Stage(spark) as stage:
        for n in (4096, 8192):
            vec = spark.createDataFrame([(i, row) for i, row in enumerate(rng.integers(0, 3, (6, n)).tolist())], "marker_idx int, g array<tinyint>")
            fit = kernel.Fit("all", tuple(range(n)), ())
            stats = qc.fit_eligible(vec, {"all": fit.train}, 0, 0).select("fit_id", "marker_idx", "mean", F.lit(1.0).alias("scale"), F.lit(0).alias("tier"))
            strips = stage.put(kernel.loaded(vec, stats, [fit]), "strips")
            made = kernel.gram_entries(strips, n, fit, range(n))
            written.append(shuffled(spark, lambda: made.write.format("noop").mode("overwrite").save()))  # noqa: B023
    assert 0 < written[1] < 2.5 * written[0]  # 4 times, if a sample goes to tiles whose number grows with the samples


def test_calls_travel_as_one_number(spark):
    e = spark.range(20000, numPartitions=3).select((F.lit(9999) - F.col("id")).alias("sample_idx"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("marker_idx"))
    long = e.withColumn("g", F.expr("cast(nullif(xxhash64(sample_idx, marker_idx) & 3, 3) as int)"))
    got = {}
    assert shuffled(spark, lambda: got.update((r.marker_idx, list(r.g)) for r in fixtures.vectors(long).collect())) < 6 * 160_000
    want = defaultdict(list)
    for r in sorted(long.collect(), key=lambda r: r.sample_idx):
        want[r.marker_idx].append(r.g)
    assert got == want


def test_entries_of_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(kernel, "LEAST_SIDE", 16)
    rng = np.random.default_rng(6)
    n, x = 70, rng.integers(-1, 3, (9, 70))
    vec = spark.createDataFrame([(i, [None if v < 0 else v for v in row]) for i, row in enumerate(x.tolist())], "marker_idx int, g array<tinyint>").repartition(3)
    fit = kernel.Fit("all", tuple(i for i in range(n) if i % 5), ())
    stats = qc.fit_eligible(vec, {"all": fit.train}, 0, 0).select("fit_id", "marker_idx", "mean", (F.col("marker_idx") + 1.0).alias("scale"), (F.col("marker_idx") % 2).alias("tier"))
    at = {r.marker_idx: r for r in stats.collect()}
    z = np.array([np.where(x[m] < 0, 0, x[m] - at[m].mean) / at[m].scale for m in sorted(at)])
    k = z.T @ z
    with Stage(spark) as stage:
        strips = stage.put(kernel.loaded(vec, stats, [fit]), "strips")
        for block, side in (((256, 1024), 32 << 20), ((3, 5), 32 << 20), ((5, 3), 120)):  # a tile a block, blocks in a tile, sides of few bytes
            monkeypatch.setattr(kernel, "BLOCK", block)
            monkeypatch.setattr(kernel, "SIDE_BYTES", side)
            got = [tuple(r) for r in kernel.gram_entries(strips, n, fit, [i * 10 for i in range(n)]).collect()]
            assert sorted((i, j) for i, j, _ in got) == [(i * 10, j * 10) for i in fit.train for j in fit.train if i <= j]
            assert all(v == pytest.approx(k[i // 10, j // 10], abs=1e-9) for i, j, v in got)


def least_members(n, edges):
    least = list(range(n))
    for _ in range(n):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    return least
