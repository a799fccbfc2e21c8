"""Document fingerprints: minimum hashes of the phrases of a Lempel-Ziv parse.

A text's UTF-8 bytes are parsed from left to right; each phrase is the longest one known so far and one more byte. Texts that
compress alike share phrases, and the share of equal minimum hashes estimates how much of their phrase sets is common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfolio.llm.words import mix, text_bytes

HASHES = 64
FACTORS = np.random.default_rng(4).integers(1, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASK = (1 << 64) - 1
PRIME = 0x9E3779B97F4A7C15
STRETCH = 14 << 20      # bytes of text to a task, in four ranges of ids
NONE = np.full(HASHES, MASK, np.uint64)


class Parse:
    """A Lempel-Ziv parse that can be taken back to an earlier place."""

    def __init__(self) -> None:
        self.next: dict[int, int] = {}
        self.order: list[int] = []
        self.hashes: list[int] = [0]        # of the phrase of each node; node 0 is the empty phrase
        self.node = 0

    def feed(self, data: bytes) -> None:
        follow, order, hashes, node = self.next, self.order, self.hashes, self.node
        for byte in data:
            key = node << 8 | byte
            known = follow.get(key)
            if known is None:
                hashes.append((hashes[node] + byte + 1) * PRIME & MASK)
                order.append(key)
                follow[key] = len(order)
                node = 0
            else:
                node = known
        self.node = node

    def state(self) -> tuple[int, int]:
        return len(self.order), self.node

    def back(self, state: tuple[int, int]) -> None:
        for key in self.order[state[0]:]:
            del self.next[key]
        del self.order[state[0]:], self.hashes[state[0] + 1:]
        self.node = state[1]

    def least(self, since: int = 0) -> np.ndarray:
        """Minimum hashes of the phrases found after the first ``since``."""
        out = NONE.copy()
        for a in range(since + 1, len(self.hashes), 4096):
            block = mix(np.array(self.hashes[a:a + 4096], np.uint64))
            np.minimum(out, (block[:, None] * FACTORS).min(axis=0), out)
        return out


def text_form(least: np.ndarray) -> str:
    """Sixteen bits of each minimum hash, as hex digits."""
    return (least >> np.uint64(48)).astype(">u2").tobytes().hex()


def likeness(one: str, two: str) -> float:
    """Share of equal minimum hashes: estimates the Jaccard similarity of the phrase sets."""
    a, b = (np.frombuffer(bytes.fromhex(x), ">u2") for x in (one, two))
    return float((a == b).mean())


def fingerprint(text: str) -> str:
    parse = Parse()
    parse.feed(text.encode())
    return text_form(parse.least())


class Document:
    """A text parsed as a whole and ready to be parsed with another last quarter."""

    def __init__(self, name: int | None, text: str) -> None:
        self.name, self.text = name, text
        self.quarter = len(text) // 4
        head, tail = text[:len(text) - self.quarter], text[len(text) - self.quarter:]
        self.parse = Parse()
        self.parse.feed(head.encode())
        self.place = self.parse.state()
        self.head = self.parse.least()
        self.parse.feed(tail.encode())
        self.fingerprint = text_form(np.minimum(self.head, self.parse.least(self.place[0])))

    def edited(self, other: str) -> tuple[str, str]:
        """(text, fingerprint) with the last quarter replaced by as many first signs of ``other``."""
        new = other[:self.quarter]
        self.parse.back(self.place)
        self.parse.feed(new.encode())
        return self.text[:len(self.text) - self.quarter] + new, text_form(np.minimum(self.head, self.parse.least(self.place[0])))


OUT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and id, each range closed by the first row after it (``beyond``)."""
    held, rows = None, []

    def row(doc: Document, other: Document) -> tuple:
        text, changed = doc.edited(other.text)
        return (doc.name, len(doc.text), hashlib.sha256(text.encode()).hexdigest(), doc.fingerprint, changed,
                likeness(doc.fingerprint, changed), likeness(doc.fingerprint, other.fingerprint))

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict({c.split()[0]: list(x) for c, x in zip(OUT.split(", "), zip(*rows))},
                                           schema=pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())]))
        rows.clear()
        return batch

    for batch in batches:
        for range_, name, beyond, text in zip(batch["range"].to_pylist(), batch["id"].to_pylist(), batch["beyond"].to_pylist(), batch["text"]):
            if held is None and beyond:
                continue                    # a range is closed by one row
            doc = Document(name, text.as_py() or "")
            if held is not None:
                rows.append(row(held, doc))
            held = None if beyond else doc
            if len(rows) >= 500:
                yield out()
    if rows:
        yield out()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last ``n_chars // 4`` code points replaced by the first as many (or all) of the next row by ascending
    id, after the last that of the first. Null texts are empty; null ids come before all others; rows of equal id are ordered by
    their text. An empty text has no phrases: two of them are alike (1), one and another text are not. No rows give no rows.

    The ids are cut into ranges (a few values for each go through the driver), texts are shuffled once by range, and the first
    row of the next range is sent along to close each. A task holds two documents at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), text_bytes(rows) // STRETCH)
    count = 4 * tasks
    cuts = rows.stat.approxQuantile("id", [k / count for k in range(1, count)], 1 / (4 * count))
    edges = sorted({int(x) for x in cuts})

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch["id"].fill_null(-(1 << 63)), np.int64)
            yield pa.RecordBatch.from_pydict({"range": np.searchsorted(edges, ids, side="right"), "id": ids})

    found = rows.select("id").mapInArrow(ranges, "range bigint, id bigint").groupBy("range").agg(F.min("id").alias("id")).orderBy("range").collect()
    before = {first.id: other["range"] for first, other in zip(found, [found[-1], *found[:-1]])} if found else {}
    starts = np.array(sorted(before), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch["id"].fill_null(-(1 << 63)), np.int64)
            mine = np.searchsorted(edges, ids, side="right")
            first = np.flatnonzero(np.isin(ids, starts))
            order = np.append(np.arange(len(ids)), first)
            yield pa.RecordBatch.from_pydict({
                "range": np.append(mine, np.array([before[int(i)] for i in ids[first]], np.int64)),
                "beyond": np.append(np.zeros(len(ids), bool), np.ones(len(first), bool)),
                "id": batch["id"].take(pa.array(order)), "text": batch["text"].take(pa.array(order))})

    return (rows.mapInArrow(deal, "range bigint, beyond boolean, id bigint, text string").repartition(tasks, "range")
            .sortWithinPartitions("range", "beyond", "id", "text").mapInArrow(_compare, OUT))
