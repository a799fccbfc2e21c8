"""Words of whole texts as 64-bit hashes, computed on Arrow's UTF-8 buffers without Python strings.

A word is a run of bytes outside ``20`` and ``09``-``0D``; ``A``-``Z`` count as ``a``-``z``. Equal words have equal
hashes; two different ones share a hash with a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK = 1 << 20          # bytes hashed at a time
BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CODES = BYTES[LOWER]
CODES[SPACE] = 0
EXACT = BYTES.copy()     # as CODES, but capitals count as themselves
EXACT[SPACE] = 0
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the usual finaliser of multiply and shift steps)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts together and the offset at which each begins; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if large else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def powers(n: int) -> np.ndarray:
    """STEP to the powers 0 to n - 1."""
    out = np.full(n, STEP)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _chunk(data: np.ndarray, breaks: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, bytes and hash of the words of one stretch; ``breaks`` marks bytes before which a text begins."""
    inside = codes[data] != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1] | breaks[1:]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    coded = codes[data[starts[0]:]] * powers(int(lengths.max()))[place]
    sizes = np.add.reduceat(inside[starts[0]:].astype(np.int64), starts - starts[0])
    return starts, sizes, mix(np.add.reduceat(coded, starts - starts[0]))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, hash) of every word, in order."""
    row, _, _, hashes = places(*utf8(texts))
    return row, hashes


def places(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray = CODES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, first byte, bytes, hash) of every word, in order.

    ``codes`` holds an odd number for each byte of a word (equal for bytes that count as equal) and 0 for each separator.
    """
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets[:-1]] = True
    starts, sizes, hashes, at = [], [], [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data):      # to the next space or text, so that no word is cut
            near = np.flatnonzero((codes[data[end:end + CHUNK]] == 0) | breaks[end:end + CHUNK][:len(data) - end])
            if len(near):
                end += int(near[0])
                break
            end = min(len(data), end + CHUNK)
        s, n, h = _chunk(data[at:end], breaks[at:end], codes)
        starts.append(s + at)
        sizes.append(n)
        hashes.append(h)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    where = np.concatenate(starts)
    return np.searchsorted(offsets, where, side="right") - 1, where, np.concatenate(sizes), np.concatenate(hashes)


def small_batches(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(utf8(batch.column(batch.schema.get_field_index(text)))[1])
        group = np.cumsum(sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, counted: the estimate of an optimiser may be far off or unknown."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first().b)


def with_column(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of ``df`` and one more column."""
    return StructType([*df.schema.fields]).add(name, kind)


def runs(sorted_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.append(0, np.flatnonzero(sorted_ids[1:] != sorted_ids[:-1]) + 1)
    return starts, np.diff(np.append(starts, len(sorted_ids)))
