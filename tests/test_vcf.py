"""VCF files: ranges of text and block gzip, filters, numbering, and a study that equals the one from arrays."""

import gzip
import io
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException

from densitylab import cli
from densitylab.operators import validate
from densitylab.operators.stage import Stage
from densitylab.sources import readers, vcf


def bgzf(data: bytes, block: int = 300) -> bytes:
    out = []
    for lo in [*range(0, len(data), block), len(data)]:  # the last block is empty, as a file's end is marked
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        part = data[lo : lo + block]
        body = c.compress(part) + c.flush()
        out.append(b"\x1f\x8b\x08\x04" + bytes(6) + b"\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


HEAD = "##fileformat=VCFv4.2\n##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"


def record(chrom, pos, calls, ref="A", alt="G", passes="PASS", fmt="GT"):
    return "\t".join([str(chrom), str(pos), ".", ref, alt, ".", passes, ".", fmt, *calls]) + "\n"


@pytest.mark.parametrize("form", ["text", "gzip", "bgzf"])
def test_every_range_split_reads_each_line_once(form):
    """Lines of all lengths, some at borders, some longer than many ranges, the last one without an end."""
    rng = np.random.default_rng(3)
    sizes = [*rng.integers(1, 40, 60), 2000, 1, *rng.integers(250, 350, 20), 299, 299, 299]
    rows = [bytes([97 + i % 26]) * int(n) for i, n in enumerate(sizes)]
    for end in (b"", b"\n"):
        raw = b"\n".join(rows) + end
        data = {"text": raw, "gzip": gzip.compress(raw), "bgzf": bgzf(raw)}[form]
        assert form == "text" or gzip.decompress(data) == raw
        for split in (1, 7, 100, 300, 333, 1024, len(data), len(data) + 5):
            if split == 1 and form == "bgzf":
                continue  # as 7, but slow
            got = []
            for lo in range(0, len(data), split):
                for chunk in vcf.chunks(vcf.pieces(io.BytesIO(data), len(data), lo, min(len(data), lo + split)), lo == 0):
                    got += [x for x in chunk.split(b"\n") if x]
            assert got == rows, (form, split, end)


def test_block_magic_across_the_reading_border(monkeypatch):
    monkeypatch.setattr(vcf, "PIECE", 64)
    raw = bytes(range(10, 250)) * 20
    data = bgzf(raw.replace(b"\n", b"x"))
    starts, at = [], 0
    while at < len(data):
        starts.append(at)
        at += struct.unpack("<H", data[at + 16 : at + 18])[0] + 1
    for lo in range(len(data)):
        assert vcf._next_block(io.BytesIO(data), lo, len(data)) == next((s for s in starts if s >= lo), len(data))


def test_records(spark, tmp_path):
    d = tmp_path / "v"
    d.mkdir()
    text = HEAD + "a\tb\tc\r\n" + record(2, 7, ["0/1:9", "./.", "1|1"], fmt="GT:DP").replace("\n", "\r\n")
    text += record(1, 9, ["0/0", "1|0", "2/1"], passes=".") + record(1, 5, ["0", ".", "0/1/1"])
    text += record(1, 6, ["0/0"] * 3, alt="G,T") + record(1, 6, ["0/0"] * 3, ref="AC") + record(6, 6, ["0/0"] * 3) + record(1, 6, ["0/0"] * 3, passes="q10") + record(1, 6, ["0/0"] * 3, alt="A")
    (d / "one.vcf").write_text(text, newline="")
    (d / "two.vcf.gz").write_bytes(gzip.compress((HEAD + "a\tb\tc\n" + record(1, 7, ["3:0/0"] * 3, fmt="DP:GT") + record(1, 7, ["1/1", "0/0", "0/1"], alt="C")).encode()))
    (d / "empty.vcf").write_text("")
    with Stage(spark) as stage:
        people, variants, vec = vcf.markers(spark, str(d), stage)
        assert [tuple(r) for r in people.orderBy("sample_idx").collect()] == [("a", 0), ("b", 1), ("c", 2)]
        assert [(r.chrom, r.pos, r.alt, r.marker_id) for r in variants.orderBy("marker_idx").collect()] == [("1", 5, "G", "1:5:A:G"), ("1", 7, "C", "1:7:A:C"), ("1", 7, "G", "1:7:A:G"), ("1", 9, "G", "1:9:A:G"), ("2", 7, "G", "2:7:A:G")]
        assert [r.marker_idx for r in variants.orderBy("marker_idx").collect()] == list(range(5))
        validate.check_variants(variants)
        assert {r.marker_idx: r.g for r in vec.collect()} == {0: [None] * 3, 1: [2, 0, 1], 2: [None] * 3, 3: [0, 1, None], 4: [1, None, 2]}
        assert {r.marker_idx: r.g for r in vcf.of_samples(vec, [2, 0]).collect()}[1] == [1, 2]
        assert {r.marker_idx: r.g for r in vcf.of_samples(vec, []).collect()}[1] == []


def test_faults(spark, tmp_path):
    def case(name, *texts):
        d = tmp_path / name
        d.mkdir()
        for i, t in enumerate(texts):
            (d / f"{i}.vcf").write_text(t)
        with Stage(spark) as stage:
            return vcf.markers(spark, str(d), stage)[2].collect()

    with pytest.raises(readers.SourceError, match="different samples"):
        case("order", HEAD + "a\tb\n", HEAD + "b\ta\n")
    with pytest.raises(PySparkException, match="no line of column names"):
        case("none", record(1, 1, ["0/0"]))
    with pytest.raises(PySparkException, match="not 2 calls at 1 4"):
        case("calls", HEAD + "a\tb\n" + record(1, 4, ["0/0"]))
    with pytest.raises(validate.ContractError, match="Repeated variants"):
        case("twice", HEAD + "a\n" + record(1, 4, ["0/0"]), HEAD + "a\n" + record(1, 4, ["0/1"]))
    with pytest.raises(validate.ContractError, match="Repeated ids"):
        case("ids", HEAD + "a\ta\n")
    assert case("bare", HEAD + "a\n") == []


def as_vcf(d) -> None:
    """The study's array as three block-gzip files with samples in another order and markers dealt over them, and one more sample."""
    x = np.load(d / "genotypes.npy")
    ids = [line.split("\t")[0] for line in (d / "samples.tsv").read_text().splitlines()[1:]]
    sites = [line.split("\t") for line in (d / "variants.tsv").read_text().splitlines()[1:]]
    rng = np.random.default_rng(4)
    people, deal = rng.permutation(len(ids)), rng.permutation(len(sites))
    call = lambda v: "./." if np.isnan(v) else ("0/0", "0/1", "1/1")[int(v)]
    (d / "vcf/deep").mkdir(parents=True)
    for k, name in enumerate(("z.vcf.gz", "a.vcf.gz", "deep/a.vcf.gz")):
        rows = [record(*sites[j][:2], [*(call(x[i, j]) for i in people), "0/1"], *sites[j][2:]) for j in deal[k::3]]
        (d / "vcf" / name).write_bytes(bgzf((HEAD + "\t".join([*(ids[i] for i in people), "other"]) + "\n" + "".join(rows)).encode(), 4000))
    (d / "genotypes.npy").unlink()
    (d / "variants.tsv").unlink()


def test_a_run_on_vcf_equals_a_run_on_the_array(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vcf, "SPLIT", 500)
    (tmp_path / "c.json").write_text(json.dumps({"densities": [16, "all"], "alphas": [0.1, 1.0], "outer_folds": 2, "inner_folds": 2, "min_call_rate": 0.9}))
    for name in ("array", "vcf"):
        d = tmp_path / name
        readers.write_demo(str(d))
        if name == "vcf":
            as_vcf(d)
            assert len(cli.inputs_of(str(d))) == 5 and all(p.stat().st_size > 2 * vcf.SPLIT for p in d.rglob("*.vcf.gz"))
        assert cli.main(["run", "--data", str(d), "--trait", "synthetic", "--config", str(tmp_path / "c.json"), "--out", str(tmp_path / f"{name}-out"), "--profile"]) == 0
    for table in ("predictions", "metrics", "tuning"):
        a, b = (spark.read.parquet(str(tmp_path / f"{n}-out" / table)).toPandas() for n in ("array", "vcf"))
        keys = [c for c in a.columns if a[c].dtype.kind not in "f"]
        a, b = (t.sort_values(keys).reset_index(drop=True) for t in (a, b))
        for c in a.columns:
            if a[c].dtype.kind == "f":
                np.testing.assert_allclose(a[c], b[c], rtol=1e-7, atol=1e-9)
            else:
                assert a[c].equals(b[c]), (table, c)
    (tmp_path / "vcf").rename(tmp_path / "more")
    with open(tmp_path / "more/samples.tsv", "a") as f:
        f.write("absent\tG0\n")
    with pytest.raises(validate.ContractError, match="without genotypes"):
        cli.load(spark, str(tmp_path / "more"), "synthetic")
