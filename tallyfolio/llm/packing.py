"""Packing: token sequences of equal length and like attention cost, filled without padding.

Documents are tokenised and packed where they are read, in groups of about ``group_tokens`` tokens, so nothing is
shuffled and a task holds one group. Full-length pieces of long documents fill sequences of their own. The other pieces
are taken by falling cost (``linear * n + quadratic * n * n``) and go to the sequence of lowest cost that has room; a piece
that fits nowhere is cut and fills the sequences of lowest cost. A group's sequences have as much room as the group has
tokens: full ones, and for what is left powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
END = 1
# White space of Unicode, as the pattern's \s. The pattern's regex engine stops at runs of about a million.
# Only where a run begins is it measured, so shorter runs cost their length once.
BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = re.compile(f"(?<!{BLANK}){BLANK}{{10000,}}")
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


@lru_cache(2)
def encoder(ranks: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Text to uint32 ids by the byte-pair ranks of a file; special tokens in a text are ordinary text."""
    import tiktoken
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    coding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def encode(text: str) -> np.ndarray:
        """A long run of white space is one piece less its last sign, which the pattern leaves to what comes after, or whole at the end."""
        found, at = [], 0
        for run in LONG_RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            found += [coding.encode_to_numpy(text[at:run.start()], disallowed_special=()), coding._encode_single_piece(text[run.start():end])]
            at = end
        found.append(coding.encode_to_numpy(text[at:], disallowed_special=()))
        return np.concatenate([np.asarray(x, "<u4") for x in found])
    return encode


def assign(sizes: np.ndarray, length: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """(document, start, size, sequence, offset) of every piece of documents of these sizes (each 1 or more)."""
    pieces, sequence = [], 0
    for i in np.flatnonzero(sizes >= length):
        for start in range(0, int(sizes[i]) - length + 1, length):
            pieces.append((int(i), start, length, sequence, 0))
            sequence += 1
    rest = sizes % length
    total = int(rest.sum())
    caps = [length] * (total // length) + [1 << k for k in reversed(range(length.bit_length())) if total % length >> k & 1]
    room, cost, used = np.array(caps, np.int64), np.zeros(len(caps)), np.zeros(len(caps), np.int64)
    for i in np.argsort(-rest, kind="stable"):
        left, start = int(rest[i]), int(sizes[i] - rest[i])
        while left:
            fits = room >= left
            open_ = fits if fits.any() else room > 0
            k = int(np.where(open_, cost, np.inf).argmin())
            n = min(left, int(room[k]))
            pieces.append((int(i), start, n, sequence + k, int(used[k])))
            room[k] -= n
            used[k] += n
            cost[k] += linear * n + quadratic * n * n
            left, start = left - n, start + n
    return pieces


def pack_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", end: int = END,
                   length: int = LENGTH, group_tokens: int = 2_000_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids and then ``end``; a null or empty text is ``end`` alone. Rows that repeat are packed as often as
    they occur, a null id is kept, other columns are not carried, no rows give no pieces. ``length`` is a power of two
    below 2**32. The same input partition gives the same pieces again, so a lost task can be repeated.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern)
        names: list = []
        texts: list[np.ndarray] = []
        base = TaskContext.get().partitionId() << 32
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal base
            sizes = np.array([len(t) for t in texts], np.int64)
            found = assign(sizes, length)
            doc, start, size, sequence, offset = (np.array(x, np.int64) for x in zip(*found))
            batch = pa.RecordBatch.from_pydict({
                "doc_id": pa.array([names[i] for i in doc], pa.int64()), "start": start, "length": size,
                "ids": pa.array([texts[i][a:a + n].tobytes() for i, a, n, _, _ in found], pa.binary()),
                "doc_tokens": sizes[doc], "sequence_id": base + sequence, "offset": offset})
            base += int(sequence.max()) + 1
            names.clear()
            texts.clear()
            return batch

        for batch in batches:
            for name, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                names.append(name)
                texts.append(np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4"))
                held += len(texts[-1])
                if held >= group_tokens:
                    yield out()
                    held = 0
        if names:
            yield out()

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, PIECES)
