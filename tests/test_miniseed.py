"""miniSEED and SAC: every encoding comes back, gaps stay, broken records are reported."""

import struct

import numpy as np
import pytest

from smframe.sources import miniseed as ms

CODES = ("NC", "ABC", "--", "HNE")
T0 = 1_600_000_000_123_457


def counts(seed, n=3000):
    r = np.random.default_rng(seed)
    scale = np.repeat(10.0 ** r.uniform(0, 6, n // 50 + 1), 50)[:n]
    return np.cumsum(r.normal(0, scale)).astype(np.int64) // 7


@pytest.mark.parametrize("order", [">", "<"])
@pytest.mark.parametrize("encoding", [ms.INT16, ms.INT32, ms.FLOAT32, ms.FLOAT64, ms.STEIM1, ms.STEIM2])
@pytest.mark.parametrize("length", [512, 4096])
def test_every_encoding_comes_back(encoding, order, length):
    x = counts(encoding) if encoding not in (ms.INT16, ms.FLOAT32) else counts(1) % 1000
    raw = ms.encode(x.tolist(), CODES, T0, 200, encoding, length, order)
    got = [*ms.decode(raw)]
    assert len(raw) % length == 0 and all(r["problem"] is None for r in got)
    assert (np.concatenate([r["x"] for r in got]) == x).all()
    at = np.cumsum([0, *(r["n"] for r in got)])[:-1]
    assert all(abs(r["start"] - (T0 + k * 5000)) <= 1 for r, k in zip(got, at.tolist()))
    assert {(r["network"], r["station"], r["location"], r["channel"], r["rate"]) for r in got} == {(*CODES, 200.0)}


def test_words_by_hand():
    """Layouts of Steim-2 at their extremes, in the order of the manual."""
    for (code, prefix), (count, bits) in ms.LAYOUTS[ms.STEIM2].items():
        low, high = -(1 << bits - 1), (1 << bits - 1) - 1
        v = [low if k % 2 else high for k in range(count)]
        word = (prefix or 0) << 30 if prefix is not None else 0
        for k, d in enumerate(v):
            word |= (d & (1 << bits) - 1) << bits * (count - 1 - k)
        frame = np.array([[code << 24, 0, 0, word, *[0] * 12]], np.uint32)
        d, there = ms.differences(frame, ms.STEIM2)
        assert d[there].tolist() == v


def test_rates_and_broken_records(spark):
    assert [ms.rate_of(*v) for v in ((100, 1), (-10, 1), (50, -2), (-4, -8), (0, 1))] == [100.0, 0.1, 25.0, 0.03125, 0.0]
    x = counts(3)
    raw = ms.encode(x.tolist(), CODES, T0, 100)
    parts = [raw[k : k + 512] for k in range(0, len(raw), 512)]
    assert len(parts) > 8
    flipped = bytearray(parts[2])
    flipped[64 + 11] ^= 1  # the check value of the last sample
    junk = b"x" * 512
    bad = b"".join([*parts[:2], bytes(flipped), junk, *parts[4:7], parts[7][:300]])
    d = ms.records_of(spark.createDataFrame([("a", bytearray(bad)), ("b", None), ("c", bytearray(b""))], "path string, content binary"))
    problems = {r["at"]: r["problem"] for r in d.where("problem is not null").collect()}
    assert sorted(problems) == [1024, 1536, 3584] and "check value" in problems[1024] and problems[1536] == "no record header" and "ends within" in problems[3584]
    runs = ms.traces(d).orderBy("start_us").collect()
    n = [r["n"] for r in ms.decode(raw)]
    assert [r["npts"] for r in runs] == [sum(n[:2]), sum(n[4:7])]
    assert runs[0]["x"] == x[: sum(n[:2])].tolist() and runs[1]["x"] == x[sum(n[:4]) : sum(n[:7])].tolist()


def test_runs_across_files_repeats_and_checks(spark):
    x = counts(4, 2000)
    one, two = x[:900].tolist(), x[900:].tolist()
    a, b = ms.encode(one, CODES, T0, 100), ms.encode(two, CODES, T0 + 9_000_000, 100)
    other = ms.encode([1.5, 2.5], ("NC", "ABC", "00", "HNZ"), T0, 50, ms.FLOAT64)
    files = spark.createDataFrame([("1", bytearray(b)), ("2", bytearray(a)), ("3", bytearray(a)), ("4", bytearray(other))], "path string, content binary")
    t = ms.traces(ms.records_of(files))
    got = {r["channel"]: r for r in t.collect()}
    assert got["HNE"]["x"] == x.tolist() and got["HNE"]["start_us"] == T0 and got["HNZ"]["x"] == [1.5, 2.5] and got["HNZ"]["location"] == "00"
    epochs = spark.sql("select * from values ('NC','ABC','--','HNE',50.0D,timestamp'2000-01-01',timestamp'2010-01-01'), ('NC','ABC','--','HNE',200.0D,timestamp'2010-01-01',null) as t(network,station,location,channel,sample_rate,begins,ends)")
    failures = {r["channel"]: r["failure"] for r in ms.checked(t, epochs).collect()}
    assert failures["HNE"]["reason"].startswith("Sample rate") and failures["HNZ"]["reason"] == "Raw data type is not integer."


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.mseed").write_bytes(ms.encode([*range(100)], CODES, T0, 100))
    assert ms.traces(ms.records(spark, str(tmp_path))).collect()[0]["x"] == [*map(float, range(100))]


@pytest.mark.parametrize("order", ["<", ">"])
def test_sac(spark, order):
    real, whole = [-12345.0] * 70, [-12345] * 40
    real[0], real[5], real[31], real[32] = 0.01, 0.5, 10.25, -20.5
    whole[:7], whole[9] = [2020, 32, 1, 2, 3, 4, 6], 3
    whole[6] = 6
    text = ["STA".ljust(8), "-12345".ljust(16), *["-12345".ljust(8)] * 21]
    text[19], text[20] = "HNE".ljust(8), "NC".ljust(8)
    blob = struct.pack(order + "70f", *real) + struct.pack(order + "40i", *whole) + "".join(text[:2]).encode() + "".join(text[2:]).encode()
    blob = blob[:440] + ("STA".ljust(8) + "-12345".ljust(16) + "-12345  " * 17 + "HNE".ljust(8) + "NC".ljust(8) + "-12345  " * 2).encode() + struct.pack(order + "3f", 1, 2, -3)
    rows = [("a", bytearray(blob)), ("b", bytearray(blob[:-4])), ("c", bytearray(b"no")), ("d", None)]
    got = {r["path"]: r for r in ms.sac(spark.createDataFrame(rows, "path string, content binary"), 2.0).collect()}
    assert got["a"]["x"] == [2.0, 4.0, -6.0] and (got["a"]["station"], got["a"]["channel"], got["a"]["network"], got["a"]["sampling_rate"]) == ("STA", "HNE", "NC", 100.0)
    assert got["a"]["start_us"] == 1_580_518_923_504_000 and got["a"]["lat"] == 10.25 and got["a"]["elevation"] is None
    assert got["b"]["problem"] and got["c"]["problem"] and got["d"]["problem"]
