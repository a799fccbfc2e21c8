"""Periodic runs of words: stretches that repeat four times or more, found by catchers over dyadic blocks.

Words are appended from left to right. Whenever a block of ``b / 2`` words (a power of two) is complete, it and the block
before it make a catcher: ``b`` words that wait for their own return at a distance of ``d <= b``. A return is a square of
period ``d``. A run of period ``q`` and length ``4 q`` holds, at the level ``b / 2 < q <= b``, the words of one catcher and
their return, and since a catcher there is at least as long as the period, its first return is at the smallest period.
Squares of one period that overlap by a period merge into one run, and comparing the words on both sides, of which
less than ``b / 2`` can be left on either, gives its ends.

All catchers of a level advance together over the words appended after them; a level costs two comparisons a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfolio.llm.words import EXACT, mix, places, small_batches, utf8

LEAST_EXPONENT = 4
LEAST_LENGTH = 6
BLOCK = 1 << 22         # comparisons at a time
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
Order = Callable[["int | None", int], "np.ndarray | None"]


def _returns(windows: np.ndarray, level: int, apart: int, count: int) -> np.ndarray:
    """Distance, up to ``level``, of the first return of each of ``count`` windows that lie ``apart``; 0 where there is none."""
    out = np.zeros(count, np.int64)
    step = max(1, BLOCK // level)
    ahead = np.lib.stride_tricks.sliding_window_view(windows, level + 1)[::apart]
    for a in range(0, count, step):
        some = ahead[a:min(count, a + step)]
        same = some[:, 1:] == some[:, :1]
        first = same.argmax(axis=1)
        out[a:a + step] = np.where(same[np.arange(len(some)), first], first + 1, 0)
    return out


def _reach(words: np.ndarray, at: np.ndarray, distance: np.ndarray, sign: int, room: np.ndarray, most: int) -> np.ndarray:
    """How many words from ``at`` on, in the direction of ``sign``, equal those ``distance`` after them; ``room`` bounds it."""
    out = np.zeros(len(at), np.int64)
    step = max(1, BLOCK // most)
    for a in range(0, len(at), step):
        place = at[a:a + step, None] + sign * np.arange(most)
        inside = np.arange(most) < room[a:a + step, None]
        left = np.where(inside, place, 0)
        same = inside & (words[left] == words[np.where(inside, place + distance[a:a + step, None], 0)])
        out[a:a + step] = np.where(same.all(axis=1), most, same.argmin(axis=1))
    return out


def word_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period.

    ``words`` holds the hashes of the words of all texts one after the other, ``sizes`` the number of words of each text.
    """
    texts = np.arange(len(sizes))
    windows, level, found = words, 1, []
    while True:
        least = max(LEAST_LENGTH, LEAST_EXPONENT * (level // 2 + 1))        # of a run that this level can hold
        keep = sizes >= least
        if not keep.any():
            break
        if not keep.all():
            inside = np.repeat(keep, sizes)
            texts, sizes, words, windows = texts[keep], sizes[keep], words[inside], windows[inside]
        ends = np.cumsum(sizes)
        apart = max(1, level // 2)
        starts = np.arange(0, max(0, len(words) - level - level // 2), apart)       # later ones have no room for a return
        padded = np.concatenate([windows, np.zeros(level + 1, np.uint64)])
        distance = _returns(padded, level, apart, len(starts))
        text = np.searchsorted(ends, starts, side="right")
        caught = (distance > level // 2) & (starts + level + distance <= ends[text])
        place, distance, text = starts[caught], distance[caught], text[caught]
        if len(place):
            order = np.lexsort((place, distance, text))
            place, distance, text = place[order], distance[order], text[order]
            first = np.ones(len(place), bool)
            first[1:] = (text[1:] != text[:-1]) | (distance[1:] != distance[:-1]) | (place[1:] > place[:-1] + level)
            begin, text, period = place[first], text[first], distance[first]
            last = place[np.append(np.flatnonzero(first)[1:] - 1, len(place) - 1)]
            head, tail = ends[text] - sizes[text], ends[text]
            back = _reach(words, begin - 1, period, -1, begin - head, level)
            on = _reach(words, last + level, period, 1, tail - period - last - level, 2 * level)
            start, end = begin - back, last + level + on + period
            long = end - start >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * period)
            found.append((texts[text[long]], (start - head)[long], (end - start)[long], period[long]))
        windows = mix(padded[:len(words)] * np.uint64(3) + np.concatenate([windows[level:], np.zeros(level, np.uint64)])[:len(words)])
        level *= 2
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    text, start, length, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def joined(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, text: np.ndarray, texts: int) -> pa.Array:
    """Words (first byte and bytes in ``data``) of each text with one space between them."""
    number = np.bincount(text, minlength=texts)
    last = np.zeros(len(starts), bool)
    last[np.cumsum(number)[number > 0] - 1] = True
    wide = sizes + ~last
    edges = np.concatenate([[0], np.cumsum(wide)])
    out = np.full(edges[-1], 0x20, np.uint8)
    source = np.repeat(starts - edges[:-1], wide) + np.arange(edges[-1])
    inner = np.ones(edges[-1], bool)
    inner[edges[1:][~last] - 1] = False
    out[inner] = data[source[inner]]
    offsets = edges[np.concatenate([[0], np.cumsum(number)])]
    return pa.LargeStringArray.from_buffers(texts, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes()))


def _batch(names: pa.Array, texts: pa.Array, order: Order | None) -> pa.RecordBatch:
    data, offsets = utf8(texts)
    text, starts, widths, hashes = places(data, offsets, EXACT)
    sizes = np.bincount(text, minlength=len(texts))
    if order is not None:
        first = np.cumsum(sizes) - sizes
        chosen = np.arange(len(text))
        for i, (name, n) in enumerate(zip(names.to_pylist(), sizes.tolist())):
            if n and (own := order(name, n)) is not None:
                chosen[first[i]:first[i] + n] = first[i] + own
        starts, widths, hashes = starts[chosen], widths[chosen], hashes[chosen]
    where, start, length, period = word_runs(hashes, sizes)
    base = (np.cumsum(sizes) - sizes)[where] + start
    marks = np.zeros(len(text) + 1, np.int64)
    np.add.at(marks, base + period, 1)
    np.add.at(marks, base + length, -1)
    kept = np.cumsum(marks)[:-1] == 0
    edges = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(texts)))])
    runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"]))
    whole = joined(data, starts[kept], widths[kept], text[kept], len(texts)).cast(pa.string())
    return pa.RecordBatch.from_arrays([names, pa.array(sizes, pa.int64()), runs, whole], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: Order | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, equal where all their bytes are (64-bit hashes are compared), numbered
    from 0. A run is a stretch of smallest period q and length of 6 or more and 4 q or more that no neighbouring word extends.
    ``collapsed`` is the text, one space between words, without the words that some run holds after its first q. ``order`` maps
    an id and the number of words to the places at which the words are read instead (as many; None: as they stand).

    Nulls, empty and blank texts have no words, no runs and an empty ``collapsed``. Null ids and rows that repeat are kept as
    they are, other columns are not carried, no rows give no rows. Nothing is shuffled; a task holds about a million bytes
    of text, or one longer text, and some thirty bytes for each of its words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            yield _batch(batch["doc_id"], batch["text"], order)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")
