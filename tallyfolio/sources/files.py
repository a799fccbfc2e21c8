"""Folders of uploaded files as rows of the ``files`` schema: a listing made in tasks, contents read from the listing."""

from __future__ import annotations

import itertools
import os
import stat
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfolio.functions.naming import ARCHIVE_FORMAT, UNSUPPORTED, route_format
from tallyfolio.slices import all_slices
from tallyfolio.workspace import materialize

TOO_LARGE = "too_large"
VANISHED = "vanished"
UNREADABLE = "unreadable"
# A binary value of Spark cannot be larger.
MAX_LENGTH = 2**31 - 16

LISTING = "folder string, path string, name string, length long, source_seq long, status string"
_FOUND = LISTING + ", is_folder boolean"
_ROWS = 10_000
_FOLDERS_A_TASK = 16
CHUNK = 4 << 20         # bytes of contents that leave a task together
_READ_A_TASK = 256 << 20


def file_system(folder: str):
    """File system of a folder and the folder's place in it."""
    from pyarrow import fs
    parts = urlsplit(folder)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), (parts.path if parts.scheme else os.path.abspath(folder)).rstrip("/")
    system, base = fs.FileSystem.from_uri(folder)
    return system, base.rstrip("/")


def _local_entries(path: str) -> Iterator[tuple]:
    """As ``_entries``, one by one as the system gives them, whatever their number. Links to folders are not followed."""
    with os.scandir(path) as found:
        for entry in found:
            try:
                seen = entry.stat()
            except OSError:         # a link to nowhere, or gone meanwhile
                yield entry.name, 0, 0, False, None if not os.path.lexists(entry.path) else UNREADABLE
                continue
            folder = stat.S_ISDIR(seen.st_mode)
            odd = entry.is_symlink() if folder else not stat.S_ISREG(seen.st_mode)
            yield entry.name, 0 if folder or odd else seen.st_size, seen.st_mtime_ns // 1000, folder and not odd, UNREADABLE if odd else None


def _entries(system, path: str) -> Iterator[tuple]:
    """(name, length, time in microseconds, is a folder, status) of what lies directly in a folder; names may hold anything."""
    from pyarrow import fs
    if isinstance(system, fs.LocalFileSystem):
        yield from _local_entries(path)
        return
    for found in system.get_file_info(fs.FileSelector(path, recursive=False)):
        if found.type != fs.FileType.NotFound:
            folder = found.type == fs.FileType.Directory
            yield found.base_name, found.size or 0, (found.mtime_ns or 0) // 1000, folder, None if folder or found.is_file else UNREADABLE


def _one_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What lies directly in each (folder, path), in chunks; a folder that cannot be listed is a row of its own."""
    columns = ["folder", "path", "name", "length", "source_seq", "is_folder", "status"]

    def rows(folder: str, path: str) -> Iterator[tuple]:
        system, base = file_system(folder)
        try:
            for name, length, time, is_folder, status in _entries(system, f"{base}/{path}".rstrip("/")):
                yield folder, f"{path}/{name}".lstrip("/"), name, length, time, is_folder, status
        except FileNotFoundError:
            return
        except OSError:
            yield folder, path, path.rsplit("/", 1)[-1], 0, 0, False, UNREADABLE

    for batch in batches:
        for folder, path in zip(batch["folder"], batch["path"]):
            found = rows(folder, path)
            while some := list(itertools.islice(found, _ROWS)):
                yield pd.DataFrame(some, columns=columns)


def list_folders(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``(folder, path, name, length, source_seq, status)`` of all files, whatever their names, also of those in sub-folders.

    ``path`` is relative to the folder; ``source_seq`` is the modification time in microseconds. The tree is walked level by
    level: the sub-folders of a level are dealt out to tasks, and a level is written down before the next is walked. A local
    folder is read entry by entry; the library for other stores returns one folder at a time. What cannot be read as a
    file (pipes, links to folders, folders that refuse to be listed) is a row with a status; links to folders are not
    followed. A listing that exists already (an upload log, a store inventory) can be used instead of this; it may do
    without ``status`` and have a ``media_type``.
    """
    level = spark.createDataFrame([(folder, "") for folder in folders], "folder string, path string")
    levels: list[DataFrame] = []
    while True:
        tasks = max(1, min(-(-level.count() // _FOLDERS_A_TASK), 8 * spark.sparkContext.defaultParallelism))
        found = materialize(level.repartition(tasks, "folder", "path").mapInPandas(_one_level, _FOUND), "listing")
        levels.append(found.filter("NOT is_folder").drop("is_folder"))
        level = found.filter("is_folder").select("folder", "path")
        if level.isEmpty():
            break
    files = levels[0]
    for more in levels[1:]:
        files = files.unionByName(more)
    return files


def _content(folder: str, path: str) -> tuple[bytes | None, str | None]:
    """The bytes of a file and a status, which is NULL for what could be read; no error of one file ends the job."""
    from pyarrow import fs
    system, base = file_system(folder)
    try:
        if isinstance(system, fs.LocalFileSystem) and not system.get_file_info(f"{base}/{path}").is_file:
            return None, UNREADABLE if os.path.lexists(f"{base}/{path}") else VANISHED      # opening a pipe would wait for ever
        with system.open_input_file(f"{base}/{path}") as file:
            return (file.read(), None) if file.size() <= MAX_LENGTH else (None, TOO_LARGE)
    except FileNotFoundError:
        return None, VANISHED
    except OSError:
        return None, UNREADABLE


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of the wanted files, in chunks of bounded size; the last two columns are status and wanted."""
    def out(batch: pa.RecordBatch, rows: list[tuple], end: int) -> pa.RecordBatch:
        contents, states = zip(*rows)
        told = batch.slice(end - len(rows), len(rows))
        return pa.RecordBatch.from_arrays([*told.columns[:-2], pa.array(contents, pa.binary()), pa.array(states, pa.string())],
                                          names=[*batch.schema.names[:-2], "content", "status"])

    for batch in all_slices(batches):
        rows, held = [], 0
        for place, (folder, path, told, wanted) in enumerate(zip(*(batch[c].to_pylist() for c in ("folder", "path", "status", "wanted")))):
            content, status = _content(folder, path) if wanted else (None, None)
            if rows and held + len(content or b"") > CHUNK:
                yield out(batch, rows, place)
                rows, held = [], 0
            rows.append((content, status or told))
            held += len(content or b"")
        yield out(batch, rows, batch.num_rows)


def _status(length: Column, route: Column) -> Column:
    return F.when(route == UNSUPPORTED, F.lit(UNSUPPORTED)).when(length > MAX_LENGTH, F.lit(TOO_LARGE))


def read_listed(listing: DataFrame) -> DataFrame:
    """Files of a listing: its columns less ``folder``, and ``is_archive``, ``content``, ``status``.

    Each content is read once, in a task, from its path; those of unsupported formats never, nor those larger than a binary value
    can be, nor what the listing has a status for. A file that cannot be read has a status and costs no other. Empty files have empty content. The listing is dealt out so that a task reads about the same number of bytes.
    """
    spark = listing.sparkSession
    media_type = F.col("media_type") if "media_type" in listing.columns else None
    route = route_format(F.col("name"), media_type)
    kept = ["path", "name", "length", "source_seq", *(["media_type"] if media_type is not None else []),
            *[c for c in listing.columns if c == "request_id"]]
    told = listing["status"] if "status" in listing.columns else F.lit(None).cast("string")
    rows = listing.select("folder", *kept, (route == ARCHIVE_FORMAT).alias("is_archive"), route.alias("_route"), told.alias("_told"))
    rows = rows.withColumns({"status": F.coalesce("_told", _status(F.col("length"), F.col("_route"))),
                             "wanted": F.col("_told").isNull() & (_status(F.col("length"), F.col("_route")).isNull() | (F.col("length") == 0))})
    rows = rows.select("folder", *kept, "is_archive", "status", "wanted")
    size = listing.agg(F.coalesce(F.sum(F.least("length", F.lit(MAX_LENGTH))), F.lit(0)).alias("b")).first().b
    tasks = max(spark.sparkContext.defaultParallelism, int(size) // _READ_A_TASK + 1)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in ["folder", *kept, "is_archive"]) + ", content binary, status string"
    return rows.repartition(tasks, "folder", "path").mapInArrow(_read, schema).drop("folder")


def read_folder(spark: SparkSession, folder: str, listing: DataFrame | None = None) -> DataFrame:
    """Files of a folder: ``(path, name, length, source_seq, is_archive, content, status)``; no file is left out."""
    return read_listed(list_folders(spark, [folder]) if listing is None else listing)
