"""miniSEED (version 2) and SAC files, from the public SEED manual and the public SAC header.

A file is one row of Spark's binary source and is decoded in its task; records of one length, byte order and encoding are
decoded together. Records are a table of their own, with broken ones reported; traces are joined from them in Spark,
whatever file they lie in, wherever one continues another within half a sample.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from smframe.operators.relational import failed

#: Encodings of samples, by blockette 1000.
INT16, INT32, FLOAT32, FLOAT64, STEIM1, STEIM2 = 1, 3, 4, 5, 10, 11
PLAIN = {INT16: "i2", INT32: "i4", FLOAT32: "f4", FLOAT64: "f8"}
#: Of each two-bit code (and, where there is one, each two-bit prefix) the number of differences in a word and their bits.
LAYOUTS = {STEIM1: {(1, None): (4, 8), (2, None): (2, 16), (3, None): (1, 32)}, STEIM2: {(1, None): (4, 8), (2, 1): (1, 30), (2, 2): (2, 15), (2, 3): (3, 10), (3, 0): (5, 6), (3, 1): (6, 5), (3, 2): (7, 4)}}
CODES = ("network", "station", "location", "channel")
RECORD = pa.schema([("path", pa.string()), ("at", pa.int64()), *((c, pa.string()) for c in CODES), ("start_us", pa.int64()), ("sampling_rate", pa.float64()), ("encoding", pa.int32()), ("npts", pa.int64()), ("x", pa.list_(pa.float64())), ("problem", pa.string())])


def rate_of(factor: int, multiplier: int) -> float:
    """Samples a second: positive numbers multiply, negative ones divide."""
    if not factor or not multiplier:
        return 0.0
    return (factor if factor > 0 else -1 / factor) * (multiplier if multiplier > 0 else -1 / multiplier)


def header(raw: bytes, at: int) -> dict:
    """The header of the record at a place; raises ValueError where there is none."""
    h = raw[at : at + 64]
    if len(h) < 64 or not h[:6].strip(b" 0123456789\0") == b"" or h[6:7] not in (b"D", b"R", b"Q", b"M"):
        raise ValueError("no record header")
    order = ">" if 1900 <= struct.unpack_from(">H", h, 20)[0] <= 2100 and 1 <= struct.unpack_from(">H", h, 22)[0] <= 366 else "<"
    year, day, hour, minute, second, part, n, factor, multiplier, activity, _, _, many, correction, data, link = struct.unpack_from(order + "HHBBBxHHhhBBBBiHH", h, 20)
    if not 1900 <= year <= 2100 or not 1 <= day <= 366:
        raise ValueError("no valid time")
    text = lambda i, j: h[i:j].decode("ascii", "replace").strip(" \0")
    out = {"station": text(8, 13), "location": text(13, 15) or "--", "channel": text(15, 18), "network": text(18, 20), "n": n, "data": data, "order": order, "rate": rate_of(factor, multiplier), "encoding": None, "length": None}
    start = (datetime(year, 1, 1) - datetime(1970, 1, 1) + timedelta(days=day - 1, hours=hour, minutes=minute)) // timedelta(microseconds=1) + second * 1_000_000 + part * 100
    if not activity & 2:
        start += correction * 100
    for _ in range(many):
        if link < 48 or at + link + 8 > len(raw):
            break
        kind, following = struct.unpack_from(order + "HH", raw, at + link)
        if kind == 1000:
            out["encoding"], big, power = struct.unpack_from("BBB", raw, at + link + 4)
            out["length"], out["data_order"] = 1 << power, ">" if big else "<"
        elif kind == 1001:
            start += struct.unpack_from("b", raw, at + link + 5)[0]
        elif kind == 100:
            out["rate"] = float(struct.unpack_from(order + "f", raw, at + link + 4)[0]) or out["rate"]
        if following <= link:
            break
        link = following
    if out["length"] is None:
        raise ValueError("no blockette 1000")
    return out | {"start": start}


def differences(words: np.ndarray, encoding: int) -> tuple[np.ndarray, np.ndarray]:
    """(records, words, 7) differences and which of them there are, of (records, 16 * frames) words of Steim frames."""
    r, w = words.shape
    control = words.reshape(r, -1, 16)[:, :, :1]
    code = (control >> (30 - 2 * np.arange(16, dtype=np.uint32))) & 3
    code[:, :, 0] = 0
    code[:, 0, 1:3] = 0  # the first frame's constants
    code = code.reshape(r, w)
    prefix = words >> np.uint32(30)
    out, there = np.zeros((r, w, 7), np.int64), np.zeros((r, w, 7), bool)
    for (c, p), (count, bits) in LAYOUTS[encoding].items():
        i, j = np.nonzero((code == c) & ((prefix == p) if p is not None else True))
        shift = (bits * np.arange(count - 1, -1, -1)).astype(np.uint32)
        v = (words[i, j][:, None].astype(np.int64) >> shift) & ((1 << bits) - 1)
        out[i, j, :count] = np.where(v >> (bits - 1), v - (1 << bits), v)
        there[i, j, :count] = True
    return out, there


def steim(blocks: np.ndarray, n: np.ndarray, encoding: int, order: str) -> tuple[list[np.ndarray | None], list[str | None]]:
    """Samples of records, (records, bytes) of whole frames each; a problem in place of samples that don't check."""
    words = np.ascontiguousarray(blocks).view(order + "u4").astype(np.uint32)
    d, there = differences(words, encoding)
    first, last = words[:, 1].astype(np.int32).astype(np.int64), words[:, 2].astype(np.int32).astype(np.int64)
    samples, problems = [], []
    for k, m in enumerate(n.tolist()):
        v = d[k][there[k]]
        if len(v) < m:
            samples.append(None), problems.append(f"{len(v)} of {m} samples")
            continue
        v = v[:m].copy()
        if m:
            v[0] = first[k]  # the first difference leads from the record before
        x = np.cumsum(v)
        ok = not m or x[-1] == last[k]
        samples.append(x if ok else None), problems.append(None if ok else "the last sample differs from its check value")
    return samples, problems


def decode(raw: bytes) -> Iterator[dict]:
    """The records of a file: at, header fields, x and problem. What isn't a record is passed over to the next one, and reported."""
    at, waiting, out = 0, defaultdict(list), []
    while at + 48 <= len(raw):
        try:
            h = header(raw, at)
        except ValueError as e:
            out.append({"at": at, "problem": str(e)})
            # records begin at multiples of the least length
            at = next((k for k in range(at // 128 * 128 + 128, len(raw) - 47, 128) if raw[k + 6 : k + 7] in (b"D", b"R", b"Q", b"M") and raw[k : k + 6].strip(b" 0123456789\0") == b""), len(raw))
            continue
        out.append(h | {"at": at, "problem": None, "x": None})
        body = raw[at + h["data"] : at + h["length"]]
        if len(raw) < at + h["length"]:
            out[-1]["problem"] = "the file ends within the record"
        elif h["encoding"] in PLAIN:
            kind = np.dtype(h["data_order"] + PLAIN[h["encoding"]])
            if len(body) < h["n"] * kind.itemsize:
                out[-1]["problem"] = "too few bytes for its samples"
            else:
                out[-1]["x"] = np.frombuffer(body, kind, h["n"])
        elif h["encoding"] in LAYOUTS and h["data"] >= 48 and len(body) >= 64:
            waiting[h["encoding"], h["data_order"], len(body) // 64 * 64].append((len(out) - 1, body))
        elif h["n"]:
            out[-1]["problem"] = f"encoding {h['encoding']} is not read"
        at += h["length"]
    if at < len(raw) and any(raw[at:]) and not (out and out[-1]["problem"]):
        out.append({"at": at, "problem": "bytes behind the last record"})
    for (encoding, order, size), rows in waiting.items():
        for some in (rows[k : k + 2048] for k in range(0, len(rows), 2048)):
            blocks = np.frombuffer(b"".join(body[:size] for _, body in some), np.uint8).reshape(len(some), size)
            got = steim(blocks, np.array([out[k]["n"] for k, _ in some]), encoding, order)
            for (k, _), x, problem in zip(some, *got):
                out[k]["x"], out[k]["problem"] = x, problem
    yield from out


def records_of(files: DataFrame) -> DataFrame:
    """The records (columns of RECORD) of rows of path and content; a null content has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, path in enumerate(b.column("path").to_pylist()):
                rows = [*decode(b.column("content")[i].as_py() or b"")]
                for k in range(0, len(rows), 4096):
                    part = rows[k : k + 4096]
                    cols = [[path] * len(part), [r["at"] for r in part], *([r.get(c) for r in part] for c in CODES), [r.get("start") for r in part], [r.get("rate") for r in part], [r.get("encoding") for r in part], [r.get("n") for r in part], [None if r.get("x") is None else r["x"].astype(float) for r in part], [r["problem"] for r in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, RECORD)], schema=RECORD)

    return files.select("path", "content").mapInArrow(run, "path string, at long, network string, station string, location string, channel string, start_us long, sampling_rate double, encoding int, npts long, x array<double>, problem string")


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files under path."""
    return records_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def traces(records: DataFrame) -> DataFrame:
    """One row for each unbroken run of samples: codes, start, start_us, sampling_rate, npts, x, integers (whether all samples are whole by their encoding).

    A record goes on the one before it if it begins within half a sample of its end; records given twice count once. Broken
    records, and ones without samples or a rate, are left out, and part the runs.
    """
    good = records.where("problem is null and npts > 0 and sampling_rate > 0 and x is not null").dropDuplicates([*CODES, "start_us", "npts", "sampling_rate"])
    w = Window.partitionBy(*CODES, "sampling_rate").orderBy("start_us", "npts")
    ends = F.lag(F.col("start_us") + F.col("npts") * 1e6 / F.col("sampling_rate")).over(w)
    run = good.withColumn("_new", F.coalesce(F.abs(F.col("start_us") - ends) > 0.5e6 / F.col("sampling_rate"), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    out = run.groupBy(*CODES, "sampling_rate", "_run").agg(F.min("start_us").alias("start_us"), F.sort_array(F.collect_list(F.struct("start_us", "npts", "x"))).alias("_r"), F.min(F.col("encoding").isin(INT16, INT32, STEIM1, STEIM2)).alias("integers"))
    return out.select(*CODES, F.timestamp_micros("start_us").alias("start"), "start_us", "sampling_rate", F.flatten(F.col("_r.x")).alias("x"), "integers").withColumn("npts", F.size("x"))


def checked(traces: DataFrame, metadata: DataFrame) -> DataFrame:
    """traces with failure: of those whose samples aren't integers, or whose rate isn't that of their channel's epoch.

    metadata: codes, sample_rate, begins and ends (timestamps; a null end is open). Traces of no epoch pass.
    """
    m = metadata.select(*(F.col(c).alias(f"_{c}") for c in CODES), "sample_rate", "begins", "ends")
    on = (F.col("start") >= F.col("begins")) & (F.col("ends").isNull() | (F.col("start") < F.col("ends")))
    for c in CODES:
        on = on & (F.col(c) == F.col(f"_{c}"))
    d = traces.join(m, on, "left").drop(*(f"_{c}" for c in CODES), "begins", "ends").withColumn("failure", F.lit(None).cast("struct<module:string,reason:string>"))
    d = failed(d, "read", "Sample rate is not consistent between data and metadata", F.col("sample_rate") != F.col("sampling_rate"))
    return failed(d, "read", "Raw data type is not integer.", ~F.col("integers")).drop("sample_rate")


# ---- writing -----------------------------------------------------------------------------------------------------


def packed(d: list[int], encoding: int, room: int) -> tuple[list[tuple[int, int]], int]:
    """(code, word) of as many first differences as fit in room words, and how many those are; the fullest layout that holds the next ones is taken."""
    layouts = sorted(LAYOUTS[encoding].items(), key=lambda x: -x[1][0])
    out, i = [], 0
    while i < len(d) and len(out) < room:
        for (code, prefix), (count, bits) in layouts:
            part = d[i : i + count]
            if len(part) == count and all(-(1 << bits - 1) <= v < 1 << bits - 1 for v in part):
                word = 0 if prefix is None else prefix << 30
                for k, v in enumerate(part):
                    word |= (v & (1 << bits) - 1) << bits * (count - 1 - k)
                out.append((code, word))
                i += count
                break
        else:
            raise ValueError("a difference doesn't fit in the encoding")
    return out, i


def encode(x: list, codes: tuple[str, str, str, str], start_us: int, rate: int, encoding: int = STEIM2, length: int = 512, order: str = ">") -> bytes:
    """x as records of a whole number of samples a second; integers but for the encodings of reals."""
    network, station, location, channel = codes
    if any(len(v) > n for v, n in ((network, 2), (station, 5), (location, 2), (channel, 3))):
        raise ValueError(f"a code of {codes} is too long for a record header")
    out, at, number = [], 0, 1
    while at < len(x):
        begin = datetime(1970, 1, 1) + timedelta(microseconds=start_us + at * 1_000_000 // rate)
        if encoding in PLAIN:
            size = np.dtype(PLAIN[encoding]).itemsize
            part = x[at : at + (length - 64) // size]
            body, n = np.array(part, order + PLAIN[encoding]).tobytes(), len(part)
        else:
            frames = (length - 64) // 64
            d = [0, *(int(b) - int(a) for a, b in zip(x[at:], x[at + 1 : at + 1 + frames * 15 * 7]))]
            words, n = packed(d, encoding, frames * 15 - 2)
            cells = [(0, int(x[at]) & 0xFFFFFFFF), (0, int(x[at + n - 1]) & 0xFFFFFFFF), *words]
            cells += [(0, 0)] * (frames * 15 - len(cells))
            body = b""
            for f in range(frames):
                own = cells[f * 15 : f * 15 + 15]
                control = sum(c << (28 - 2 * k) for k, (c, _) in enumerate(own))
                body += struct.pack(f"{order}16I", control, *(w for _, w in own))
        head = f"{number:06d}D ".encode() + station.ljust(5).encode() + ("" if location == "--" else location).ljust(2).encode() + channel.ljust(3).encode() + network.ljust(2).encode()
        head += struct.pack(order + "HHBBBxHHhhBBBBiHH", begin.year, begin.timetuple().tm_yday, begin.hour, begin.minute, begin.second, begin.microsecond // 100, n, rate, 1, 0, 0, 0, 2, 0, 64, 48)
        head += struct.pack(order + "HHBBBx", 1000, 56, encoding, int(order == ">"), length.bit_length() - 1) + struct.pack(order + "HHBbBB", 1001, 0, 0, begin.microsecond % 100, 0, 0)
        out.append((head + body).ljust(length, b"\0"))
        at, number = at + n, number % 999_999 + 1
    return b"".join(out)


def written(traces: DataFrame, encoding: int = STEIM2, length: int = 512) -> DataFrame:
    """path (network.station.location.channel.start_us) and content of each trace with codes, start_us, sampling_rate (whole) and x (whole, but for reals)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in (*CODES, "start_us", "sampling_rate", "x")))
            got = [(".".join(map(str, r[:5])), encode(r[6] or [], r[:4], r[4], int(r[5]), encoding, length)) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.binary())], ["path", "content"])

    return traces.select(*CODES, "start_us", "sampling_rate", "x").mapInArrow(run, "path string, content binary")


# ---- SAC -------------------------------------------------------------------------------------------------------

SAC = pa.schema([("path", pa.string()), *((c, pa.string()) for c in CODES), ("start_us", pa.int64()), ("sampling_rate", pa.float64()), ("lat", pa.float64()), ("lon", pa.float64()), ("elevation", pa.float64()), ("x", pa.list_(pa.float64())), ("problem", pa.string())])


def sac_of(raw: bytes, factor: float) -> dict:
    """One SAC file: 70 reals, 40 integers, 192 characters, then samples, which factor multiplies; -12345 stands for unknown."""
    if len(raw) < 632:
        return {"problem": "shorter than a header"}
    order = next((o for o in "<>" if struct.unpack_from(o + "i", raw, 76 * 4)[0] in (6, 7)), None)
    if order is None:
        return {"problem": "no SAC header"}
    real, whole = struct.unpack_from(order + "70f", raw, 0), struct.unpack_from(order + "40i", raw, 280)
    n = whole[9]
    if n < 0 or len(raw) < 632 + 4 * n:
        return {"problem": "the file ends within the samples"}
    word = lambda at, size=8: (lambda s: "" if s.startswith("-12345") else s)(raw[440 + at : 440 + at + size].decode("ascii", "replace").strip(" \0"))
    known = lambda v: None if v == -12345 else float(v)
    start = None
    if -12345 not in whole[:6] and 1 <= whole[1] <= 366:
        year, day, hour, minute, second, ms = whole[:6]
        start = ((datetime(year, 1, 1) - datetime(1970, 1, 1)) // timedelta(days=1) + day - 1) * 86_400_000_000 + ((hour * 60 + minute) * 60 + second) * 1_000_000 + ms * 1000 + round((known(real[5]) or 0.0) * 1e6)
    x = np.frombuffer(raw, order + "f4", n, 632).astype(float) * factor
    return {"station": word(0), "location": word(24) or "--", "channel": word(160), "network": word(168), "start_us": start, "sampling_rate": float(f"{1 / real[0]:.6g}") if real[0] > 0 else None, "lat": known(real[31]), "lon": known(real[32]), "elevation": known(real[33]), "x": x, "problem": None}


def sac(files: DataFrame, factor: float = 1.0) -> DataFrame:
    """The trace of each row of path and content: the columns of SAC."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"path": p} | sac_of(b.column("content")[i].as_py() or b"", factor) for i, p in enumerate(b.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in SAC], schema=SAC)

    return files.select("path", "content").mapInArrow(run, "path string, network string, station string, location string, channel string, start_us long, sampling_rate double, lat double, lon double, elevation double, x array<double>, problem string")
