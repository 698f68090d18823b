"""Folders of record files with archives in them: every member of zip, tar and compressed files, however deep, as a row.

Files come from Spark's binary source, so any store that Spark reads will do; an archive is unpacked in the task that reads it, member by
member in batches of bounded size, without a copy on disk. What can't be unpacked is a row with a problem, and the rest is read.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smframe.sources import formats, miniseed, records

#: Endings of files that hold no records.
IGNORED = ("gif", "csv", "dis", "abc", "zip", "rs2", "fs1", "xml")
SINGLE = {b"\x1f\x8b": gzip.decompress, b"BZh": bz2.decompress, b"\xfd7zXZ\x00": lzma.decompress}
SEPARATOR = "!/"


def members(path: str, raw: bytes, deepest: int = 8) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(path, content, problem) of a file, or of all files within it if it is an archive; member names follow the archive's behind !/."""
    if deepest < 0:
        yield path, None, "archives are nested too deeply"
        return
    start = raw[:6]
    if start[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        try:
            z = zipfile.ZipFile(io.BytesIO(raw))
            names = [m for m in z.infolist() if not m.is_dir()]
        except (zipfile.BadZipFile, OSError, ValueError) as e:
            yield path, None, f"zip: {e}"
            return
        for m in names:
            try:
                content = z.read(m)
            except Exception as e:  # noqa: BLE001 - a broken, encrypted or unsupported member spoils itself only
                yield f"{path}{SEPARATOR}{m.filename}", None, f"zip: {e}"
                continue
            yield from members(f"{path}{SEPARATOR}{m.filename}", content, deepest - 1)
        return
    for magic, unpack in SINGLE.items():
        if start.startswith(magic):
            try:
                content = unpack(raw)
            except (OSError, EOFError, ValueError, lzma.LZMAError) as e:
                yield path, None, f"compressed: {e}"
                return
            yield from members(f"{path}{SEPARATOR}{path.rpartition('/')[2].rpartition('.')[0] or 'content'}", content, deepest - 1)
            return
    if raw[257:262] == b"ustar":
        try:
            with tarfile.open(fileobj=io.BytesIO(raw), mode="r:") as t:
                for m in t:
                    if m.isfile():
                        yield from members(f"{path}{SEPARATOR}{m.name}", t.extractfile(m).read(), deepest - 1)
        except (tarfile.TarError, OSError, EOFError) as e:
            yield path, None, f"tar: {e}"
        return
    yield path, raw, None


def expanded(files: DataFrame, most: int = 1 << 24) -> DataFrame:
    """path, content and problem of all members of rows of path and content; batches hold some `most` bytes. A null content is a problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i, path in enumerate(b.column("path").to_pylist()):
                raw = b.column("content")[i]
                for row in members(path or "", raw.as_py()) if raw.is_valid else [(path, None, "no content")]:
                    held.append(row)
                    size += len(row[1] or b"") + 256
                    if size >= most:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.large_binary() if sum(len(r[1] or b"") for r in rows) > 1 << 30 else pa.binary(), pa.string()))], ["path", "content", "problem"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, problem string")


def files(spark: SparkSession, path: str) -> DataFrame:
    """The members of all files under path."""
    return expanded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def read(members: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """The traces (path and the columns of formats.TRACE) of members, of text formats and of miniSEED; a path for each trace."""
    d = members.where("content is not null and length(content) > 0").where(~F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*IGNORED))
    seed = F.substring("content", 1, 8).cast("string").rlike(r"^[0-9 ]{6}[DRQM][ \x00]")
    text = records.parse(records.sniffed(d.where(~seed).select("path", F.col("content").cast("string").alias("text"))), kinds)
    if kinds and "mseed" not in kinds:
        return text
    r = miniseed.records_of(d.where(seed).select("path", "content"))
    m = miniseed.traces(r)
    given = {"format": F.lit("mseed"), "units": F.lit("counts"), "structure": F.lit("")}
    cols = [given.get(c, F.col(c) if c in m.columns else F.lit(None)).cast(t).alias(c) for c, t in formats.TRACE.items()]
    return text.unionByName(m.select(F.lit(None).cast("string").alias("path"), *cols))


def problems(members: DataFrame) -> DataFrame:
    """path and reason of members that can't be unpacked, or whose format no reader, or more than one, takes."""
    d = members.where(~F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*IGNORED) | F.col("problem").isNotNull())
    seed = F.coalesce(F.substring("content", 1, 8).cast("string").rlike(r"^[0-9 ]{6}[DRQM][ \x00]"), F.lit(False))
    text = records.unreadable(records.sniffed(d.where(F.col("problem").isNull() & ~seed).select("path", F.col("content").cast("string").alias("text"))))
    broken = miniseed.records_of(d.where(F.col("problem").isNull() & seed).select("path", "content")).where("problem is not null")
    return d.where("problem is not null").select("path", F.col("problem").alias("reason")).union(text).union(broken.select("path", F.concat(F.lit("record at "), F.col("at").cast("string"), F.lit(": "), F.col("problem"))))
