"""Uploaded image files, as they lie in a folder.

Listing takes names, sizes and times from the file system and opens nothing. Contents are read only of files whose name
and size pass, to compare their first bytes with what the name says. Files without a byte and hidden ones aren't seen: Spark's
readers pass over them.

Spark's readers list on the driver, which holds some 2 KB a file, and give a task a handful of files. A folder of a file
system that is mounted (file:) is therefore listed and opened by tasks: one reads the names of the top folder, a batch at a
time, the others ask for sizes and times, walk the folders below it, and read first bytes only. The listing is stored, so
that the driver holds none of it. Folders of other stores are left to Spark's reader.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored as _stored

# Endings of image names and the bytes that such files begin with (webp: also WEBP from byte 9 on).
BEGINNINGS = {
    "jpg": ("FFD8FF",), "jpeg": ("FFD8FF",), "png": ("89504E470D0A1A0A",), "gif": ("474946383761", "474946383961"),
    "webp": ("52494646",),
}
WEBP = "57454250"
#: Bytes that decide.
HEAD = 12


def _any_case(ending: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in ending)


#: Names of images, as a pattern of the file listing.
IMAGE_NAMES = "*.{" + ",".join(_any_case(e) for e in BEGINNINGS) + "}"


#: Names and files that a task holds at a time.
BATCH = 4096


def _local(spark: SparkSession, path: str) -> str | None:
    """The folder's path in the file system that driver and executors have mounted; None if it is elsewhere, or no folder."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    uri = there.makeQualified(there.getFileSystem(conf).getUri(), there.getFileSystem(conf).getWorkingDirectory()).toUri()
    return uri.getPath() if uri.getScheme() == "file" and os.path.isdir(uri.getPath()) else None


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over, and those that are no text (bytes that aren't UTF-8 come as surrogates)."""
    return (
        name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
        or any("\ud800" <= c <= "\udfff" for c in name)
    )


def _inside(folder: str, deep: bool) -> Iterator[tuple[str, bool]]:
    """(path, is it a folder) of what lies in a folder; with deep only files, also those of the folders below."""
    left = [folder]
    while left:
        with os.scandir(left.pop()) as entries:
            for e in entries:
                if _hidden(e.name):
                    continue
                if not e.is_dir():
                    yield e.path, False
                elif deep:
                    left.append(e.path)
                else:
                    yield e.path, True


def _sizes(rows: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, int, int]]:
    """(path, milliseconds of its last change, bytes) of files, and of those in folders."""
    for path, below in rows:
        for name in (f for f, _ in _inside(path, True)) if below else (path,):
            try:
                found = os.stat(name)
            except FileNotFoundError:  # gone since, or a link to nothing
                continue
            if stat.S_ISREG(found.st_mode) and found.st_size > 0:
                yield f"file:{name}", found.st_mtime_ns // 10**6, found.st_size


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length of the files below a mounted folder, stored."""
    from pyarrow import RecordBatch

    def batches_of(rows, names):
        while kept := list(islice(rows, BATCH)):
            yield RecordBatch.from_arrays([*map(list, zip(*kept, strict=True))], names)

    def top(batches):
        for _ in batches:
            yield from batches_of(_inside(folder, False), ["path", "folder"])

    def sized(batches):
        rows = (r for b in batches for r in zip(b["path"].to_pylist(), b["folder"].to_pylist(), strict=True))
        yield from batches_of(_sizes(rows), ["path", "changed", "length"])

    names = spark.range(0, 1, 1, 1).mapInArrow(top, "path STRING, folder BOOLEAN")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = names.repartition(tasks, "path").mapInArrow(sized, "path STRING, changed BIGINT, length BIGINT")
    return _stored(files.select("path", F.timestamp_millis("changed").alias("modificationTime"), "length"), "listing")


def _beginnings(files: DataFrame) -> DataFrame:
    """path, length and content of listed files, content being their first bytes."""
    from pyarrow import RecordBatch

    def head(path: str) -> bytes:
        with open(path.removeprefix("file:"), "rb", buffering=0) as f:
            return f.read(HEAD)

    def read(batches):
        for b in batches:
            yield RecordBatch.from_arrays([*b.columns, [head(p) for p in b["path"].to_pylist()]], ["path", "length", "content"])

    return files.select("path", "length").mapInArrow(read, "path STRING, length BIGINT, content BINARY")


def _read(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", names) if names else reader).load(path)


def _name() -> Column:
    return F.regexp_extract("path", r"([^/]*)$", 1).alias("stored_name")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """stored_name, bytes, written_at, path of every file below a folder; nothing is opened."""
    folder = _local(spark, path)
    return _named(_read(spark, path) if folder is None else _listing(spark, folder))


def _named(files: DataFrame) -> DataFrame:
    return files.select(_name(), F.col("length").alias("bytes"), F.col("modificationTime").alias("written_at"), "path")


def looks_like(name: Column, content: Column) -> Column:
    """Does a file begin as its name says?"""
    head = F.hex(F.substring(content, 1, HEAD))
    ending = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    said = [(ending == e) & head.startswith(b) for e, begins in BEGINNINGS.items() if e != "webp" for b in begins]
    out = (ending == "webp") & head.startswith(BEGINNINGS["webp"][0]) & (F.substring(head, 17, 8) == WEBP)
    for s in said:
        out = out | s
    return out


def file_manifest(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """stored_name, bytes, accepted, reject_reason of every file below a folder: not_an_image (by its name), too_large,
    wrong_content (its first bytes don't fit its name)."""
    folder = _local(spark, path)
    listed = _read(spark, path) if folder is None else _listing(spark, folder)
    images = _read(spark, path, IMAGE_NAMES) if folder is None else listed
    fit = images if max_bytes is None else images.filter(F.col("length") <= max_bytes)
    named = F.lower("stored_name").rlike(r"\.(" + "|".join(BEGINNINGS) + r")\z")
    if folder is not None:
        fit = _beginnings(fit.select("*", _name()).filter(named))
    wrong = F.when(~looks_like(F.col("path"), F.col("content")), "wrong_content")
    opened = fit.select(_name(), F.col("length").alias("bytes"), wrong.alias("reject_reason"))
    # the rest is refused unopened; no file is in both, so nothing has to be joined
    reason = F.when(~named, "not_an_image")
    if max_bytes is not None:
        reason = reason.when(F.col("bytes") > max_bytes, "too_large")
    shut = _named(listed).select("stored_name", "bytes", reason.alias("reject_reason")).filter(F.col("reject_reason").isNotNull())
    rows = opened.unionByName(shut)
    return rows.select("stored_name", "bytes", F.col("reject_reason").isNull().alias("accepted"), "reject_reason")
