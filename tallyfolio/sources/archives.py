"""Expansion of ZIP archives into file rows, from contents or, for archives of any size, from their place in a store."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfolio.slices import all_slices
from tallyfolio.sources.files import CHUNK, MAX_LENGTH, file_system
from tallyfolio.workspace import materialize

RANGE = 128 << 20       # bytes of an archive whose members one task reads
MEMBERS = 50_000        # or so many members


def _member(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
    """``(content, error)`` of one member."""
    if info.file_size > MAX_LENGTH:
        return None, "member is larger than a binary value can be"
    try:
        return archive.read(info), None
    except Exception as failure:
        return None, f"{type(failure).__name__}: {failure}"


def _members(data: bytes) -> Iterator[tuple[int, str, bytes | None, str | None]]:
    """``(member, name, content, error)`` in archive order; folder entries are no files."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for number, info in enumerate(archive.infolist()):
            if not info.is_dir():
                yield number, info.filename, *_member(archive, info)


class _Held:
    """Members that leave the task together: their batch's ``keep`` columns and archive, member, name, content, error."""

    def __init__(self, batch: pa.RecordBatch, keep: list[str]) -> None:
        self.batch, self.keep, self.rows, self.bytes = batch, keep, [], 0

    def add(self, place: int, archive: str, member: int | None, name: str | None, content: bytes | None, error: str | None) -> Iterator[pa.RecordBatch]:
        """Hold a member of the archive in row ``place`` of the batch; what would be too much with it goes first."""
        size = len(content or b"")
        if self.bytes + size > CHUNK:
            yield from self.out()
        self.rows.append((place, archive, member, name, content, error))
        self.bytes += size

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        place, *columns = zip(*self.rows)
        kinds = [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string()]
        kept = [self.batch[c].take(pa.array(place, pa.int64())) for c in self.keep]
        batch = pa.RecordBatch.from_arrays([*kept, *[pa.array(c, kind) for c, kind in zip(columns, kinds)]],
                                           names=[*self.keep, "archive", "member", "name", "content", "error"])
        self.rows, self.bytes = [], 0
        yield batch


def expand_archives(archives: DataFrame, keep: list[str], spread: bool = True) -> DataFrame:
    """One row per member of each archive: ``keep`` columns, archive, member, name, content, error.

    An archive that cannot be opened gives one row with an error; a bad member does not affect the others.
    Members leave the task in chunks of bounded size and, unless ``spread`` is off, are dealt out to all tasks by
    all that tells them apart: one archive may hold a large part of all files, and many requests may upload
    archives of one name.
    """
    source = archives.select(*keep, "name", "content")
    kept = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kept}, archive string, member int, name string, content binary, error string"

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in all_slices(batches):
            held = _Held(batch, keep)
            for place, (name, content) in enumerate(zip(batch["name"].to_pylist(), batch["content"].to_pylist())):
                try:
                    for member in _members(content):
                        yield from held.add(place, name, *member)
                except Exception as failure:
                    yield from held.add(place, name, None, None, None, f"{type(failure).__name__}: {failure}")
            yield from held.out()

    members = source.mapInArrow(expand, schema)
    return members.repartition(*keep, "archive", "member") if spread else members


class _Place(io.RawIOBase):
    """A file of a store as Python's readers expect one: a position before its start is an OSError."""

    def __init__(self, file) -> None:
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        place = offset + (0, self.file.tell(), self.file.size())[whence]
        if place < 0:
            raise OSError("position before the start of the file")
        return self.file.seek(place)

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[:len(data)] = data
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def _open(folder: str, path: str) -> io.BufferedReader:
    """An archive where it lies; only what is asked for is read."""
    system, base = file_system(folder)
    return io.BufferedReader(_Place(system.open_input_file(f"{base}/{path}")), 1 << 18)


def _directory(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges of members of each archive, from its directory at the end of the file; a bad archive is one row with an error."""
    columns = ["folder", "path", "first", "last", "error"]
    for batch in batches:
        rows = []
        for folder, path in zip(batch["folder"], batch["path"]):
            try:
                with _open(folder, path) as file, zipfile.ZipFile(file) as archive:
                    first, held = 0, 0
                    members = archive.infolist()
                    for number, info in enumerate(members):
                        held += info.compress_size
                        if held >= RANGE or number - first + 1 >= MEMBERS or number + 1 == len(members):
                            rows.append((folder, path, first, number, None))
                            first, held = number + 1, 0
            except Exception as failure:
                rows.append((folder, path, None, None, f"{type(failure).__name__}: {failure}"))
        yield pd.DataFrame(rows, columns=columns).astype({"first": "Int64", "last": "Int64"})


def expand_listed(listing: DataFrame, keep: list[str]) -> DataFrame:
    """As ``expand_archives`` for the archives of a listing, whatever their size; ``keep`` are columns of the listing.

    A task opens each archive and reads its directory only; the ranges of members that it says are written down and dealt out to
    tasks, which read just the bytes of their members. An archive of some hundred gigabytes is expanded by as many tasks as
    it has ranges, and a range that is lost is read again alone.
    """
    named = listing.select(*dict.fromkeys(["folder", "path", "name", *keep]))
    tasks = max(1, min(named.count(), 4 * named.sparkSession.sparkContext.defaultParallelism))
    found = materialize(named.select("folder", "path").repartition(tasks, "folder", "path")
                        .mapInPandas(_directory, "folder string, path string, first long, last long, error string"), "archives")
    ranges = found.join(named, ["folder", "path"])
    kept = ", ".join(f"`{c}` {listing.schema[c].dataType.simpleString()}" for c in keep)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in all_slices(batches):
            held = _Held(batch, keep)
            told = zip(*(batch[c].to_pylist() for c in ("folder", "path", "name", "first", "last", "error")))
            for place, (folder, path, name, first, last, error) in enumerate(told):
                if error is not None:
                    yield from held.add(place, name, None, None, None, error)
                    continue
                try:
                    with _open(folder, path) as file, zipfile.ZipFile(file) as archive:
                        for number, info in enumerate(archive.infolist()[first:last + 1], first):
                            if not info.is_dir():
                                yield from held.add(place, name, number, info.filename, *_member(archive, info))
                except OSError as failure:          # the archive has gone or changed since it was listed
                    yield from held.add(place, name, None, None, None, f"{type(failure).__name__}: {failure}")
            yield from held.out()

    count = max(1, min(ranges.count(), 64 * named.sparkSession.sparkContext.defaultParallelism))
    dealt = ranges.repartition(count, "folder", "path", F.coalesce("first", F.lit(-1)))
    return dealt.mapInArrow(expand, f"{kept}, archive string, member int, name string, content binary, error string")
