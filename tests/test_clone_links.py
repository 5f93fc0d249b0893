"""Near-clone links in tiles that follow the cores, bounded by one product a block."""

import numpy as np
import pytest

from densitylab.operators import clones


def table(spark, x):
    return spark.createDataFrame([(j, [None if v < 0 else int(v) for v in row]) for j, row in enumerate(x)], "marker_idx int, g array<tinyint>").repartition(3)


def shuffled(spark, run):
    sc = spark.sparkContext
    store = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    sums = lambda: sum(stages.apply(i).shuffleWriteBytes() for stages in [store()] for i in range(stages.size()))
    before = sums()
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sums() - before


def test_links_deal_out_no_more_than_the_genotypes(spark):
    rng, written = np.random.default_rng(5), []
    for n in (4096, 8192):
        made = clones.links(table(spark, rng.integers(0, 3, (6, n))), n, 0.0, tile=256)
        written.append(shuffled(spark, lambda: made.write.format("noop").mode("overwrite").save()))  # noqa: B023
    assert 0 < written[1] < 2.5 * written[0]  # 4 times, if tiles are as many as samples over 256


@pytest.mark.parametrize(("chunk", "block", "at_once", "tile"), [(512, (256, 1024), 4096, 1024), (7, (3, 5), 4, 16), (20, (16, 9), 4096, 33)])
def test_bounds_lose_no_link(spark, monkeypatch, chunk, block, at_once, tile):
    for name, value in (("CHUNK", chunk), ("BLOCK", block), ("AT_ONCE", at_once)):
        monkeypatch.setattr(clones, name, value)
    rng = np.random.default_rng(9)
    x = rng.integers(0, 3, (20, 80))
    x[:, 40:60] = np.where(rng.random((20, 20)) < 0.2, rng.integers(0, 3, (20, 20)), x[:, :20])  # relatives about the limit
    x[rng.random(x.shape) < 0.15] = -1  # so many missing calls that the bounds must allow for them
    x[:, 79], x[:, 78], x[:, 77] = -1, x[:, 3], x[:, 3]
    for limit in (0.05, 0.17, 0.6):
        least, pairs = list(range(80)), set()
        for i in range(80):
            for j in range(i + 1, 80):
                known = (x[:, i] >= 0) & (x[:, j] >= 0)
                if known.any() and np.abs(x[known, i] - x[known, j]).sum() <= 2 * limit * known.sum() + 1e-9:
                    pairs.add((i, j))
        for _ in range(80):
            for i, j in pairs:
                least[i] = least[j] = min(least[i], least[j])
        found = {(r.a, r.b) for r in clones.links(table(spark, x), 80, limit, tile).collect()}
        assert pairs and found <= pairs
        got = list(range(80))
        for _ in range(80):
            for i, j in found:
                got[i] = got[j] = min(got[i], got[j])
        assert got == least
