"""Archives within archives, broken ones, and the traces of what they hold."""

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile

from smframe.plans.reader_queries import HEADERS
from smframe.sources import archives
from smframe.sources import miniseed as ms


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name.replace("__", "/"), content)
    return out.getvalue()


def tarred(mode="w", **files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, content in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    return out.getvalue()


def test_members_however_deep():
    deep = zipped(a=b"one", d__b=tarred(c=b"two", e=gzip.compress(b"three")), f=zipped(g=bz2.compress(b"four"), h=lzma.compress(b"five")))
    got = {p: c for p, c, problem in archives.members("x.zip", deep) if problem is None}
    assert sorted(got.values()) == [b"five", b"four", b"one", b"three", b"two"] and got["x.zip!/d/b!/c"] == b"two"
    assert [c for _, c, _ in archives.members("t.tgz", tarred("w:gz", a=b"1", b=b"2"))] == [b"1", b"2"]
    assert [*archives.members("plain", b"PK but not one")] == [("plain", b"PK but not one", None)]
    nested = b"core"
    for _ in range(12):
        nested = zipped(x=nested)
    (_, content, problem), = archives.members("n", nested)
    assert content is None and "nested" in problem


def test_broken_archives_spoil_themselves_only():
    good = bytearray(zipped(a=b"first" * 50, b=b"second" * 50))
    at = good.index(b"b") + 1
    good[at + 1 : at + 6] = b"\0" * 5
    got = [*archives.members("z", bytes(good))]
    assert any(c == b"first" * 50 for _, c, _ in got) and any(p for _, _, p in got)
    for raw in (zipped(a=b"x")[:20], gzip.compress(b"abc" * 100)[:-12], tarred(a=b"x" * 2000)[:1000]):
        assert [p is not None for _, _, p in archives.members("q", raw)][-1]


def test_traces_and_problems_of_a_folder(spark, tmp_path):
    at2 = (HEADERS["at2"].replace("{station}", "AAA") + "\n" + " ".join(["0.001"] * 64) + "\n").encode()
    seed = ms.encode([*range(50)], ("NC", "ABC", "--", "HNE"), 1_600_000_000_000_000, 100)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.at2").write_bytes(at2)
    (tmp_path / "in" / "deep" / "b.zip").write_bytes(zipped(**{"c.at2": at2, "m.mseed": seed, "notes.csv": b"no record", "odd.dat": b"what is this", "n.zip": zipped(**{"d.at2": at2})}))
    (tmp_path / "in" / "e.zip").write_bytes(zipped(a=b"x")[:15])
    (tmp_path / "in" / "empty.dat").write_bytes(b"")
    m = archives.files(spark, str(tmp_path / "in"))
    t = archives.read(m).collect()
    assert sorted(r["format"] for r in t) == ["at2", "at2", "at2", "mseed"]
    assert [r["x"][:3] for r in t if r["format"] == "mseed"] == [[0.0, 1.0, 2.0]] and {len(r["x"]) for r in t if r["format"] == "at2"} == {64}
    assert {r["format"] for r in archives.read(m, ["at2"]).collect()} == {"at2"}
    reasons = {r["path"].rpartition("/in/")[2]: r["reason"] for r in archives.problems(m).collect()}
    assert reasons["deep/b.zip!/odd.dat"] == "no format matches" and reasons["e.zip"].startswith("zip") and "deep/b.zip!/notes.csv" not in reasons
    assert "no content" in {r["reason"] for r in archives.problems(archives.expanded(spark.createDataFrame([("p", None)], "path string, content binary"))).collect()}
