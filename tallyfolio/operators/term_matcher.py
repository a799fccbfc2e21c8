"""Dictionary terms found in documents by one walk along each text.

The terms of all jobs form one trie of words, built once for each Python worker from a broadcast of counted size. A document is
read word by word: a word that begins no term costs one look-up, any other is followed down the trie as long as
the next words go on. Only the cleaned text and the request go to Python and one number of each kind comes back; no row
carries a dictionary. A dictionary above the bound is joined instead, by the phrases of the documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfolio.functions import evidence as ev
from tallyfolio.slices import all_slices, column_slices
from tallyfolio.workspace import fits_broadcast

# Kinds of dictionary terms, and the columns they become.
KINDS = {"skill": "skills", "soft_skill": "soft_skills", "role": "roles", "certification": "certifications", "action": "actions"}
DEGREE = "degree"
CRITICAL = "critical_skills"
COUNTED = [*KINDS.values(), CRITICAL]
FOUND = ", ".join(f"{c} int" for c in [*COUNTED, DEGREE])
TERM_ROWS, TERM_BYTES = 300_000, 48 << 20
_BIT = {kind: 1 << i for i, kind in enumerate([*KINDS, CRITICAL])}


def counted_as(kind: str, critical: bool) -> int:
    """What a term counts for, as bits in the order of ``COUNTED``."""
    return _BIT.get(kind, 0) | (_BIT[CRITICAL] if kind == "skill" and critical else 0)


class Trie:
    """Terms of all requests; ``None`` as the request of a term makes it count for every request."""

    def __init__(self, rows: Iterable[tuple]) -> None:
        """``rows`` are (request_id, kind, term, critical, rank) with cleaned terms."""
        self.root: dict = {}
        for request, kind, term, critical, rank in rows:
            node = self.root
            for word in term.split(" "):
                node = node.setdefault(word, {})
            # None cannot be a word, so it holds what the term that ends here counts for: {request: (bits, rank)}.
            ends = node.setdefault(None, {})
            bits, best = ends.get(request, (0, 0))
            ends[request] = (bits | counted_as(kind, critical), max(best, rank or 0) if kind == DEGREE else best)

    def found(self, words: list[str], request) -> list[int]:
        """How many different terms of each counted column occur, and the highest rank of a degree."""
        ended, root, size = {}, self.root, len(words)
        for i, word in enumerate(words):
            node, j = root.get(word), i + 1
            while node is not None:
                ends = node.get(None)
                if ends is not None:
                    ended[id(ends)] = ends
                node = node.get(words[j]) if j < size else None
                j += 1
        counts, degree = [0] * len(COUNTED), 0
        for ends in ended.values():
            bits, best = ends.get(None, (0, 0))
            if request is not None and request in ends:
                bits, best = bits | ends[request][0], max(best, ends[request][1])
            degree = max(degree, best)
            for k in range(len(COUNTED)):
                counts[k] += bits >> k & 1
        return [*counts, degree]


_built: dict[str, Trie] = {}


def _trie(name: str, sent) -> Trie:
    """The trie of a broadcast, built once in this worker; a former one is let go."""
    if name not in _built:
        _built.clear()
        parts = all_slices(pa.ipc.open_stream(sent.value))
        _built[name] = Trie(row for part in parts for row in zip(*(column.to_pylist() for column in part.columns)))
    return _built[name]


def _walk(dictionary: DataFrame, request: Column, clean: Column) -> Column:
    rows, packed = dictionary.select(F.col("request_id").cast("string"), "kind", "term", "critical", "rank").toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(packed, rows.schema) as stream:     # one value to a worker, not an object for each term beside the trie
        stream.write_table(rows)
    name, sent = uuid.uuid4().hex, dictionary.sparkSession.sparkContext.broadcast(packed.getvalue().to_pybytes())

    def found(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        trie = _trie(name, sent)
        columns = [*COUNTED, DEGREE]
        for requests, texts in column_slices(batches):
            rows = [trie.found((text or "").lower().split(" "), request) for request, text in zip(requests, texts)]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in zip(*rows)], names=columns)

    return F.arrow_udf(found, FOUND)(request.cast("string"), clean)


def _join(documents: DataFrame, dictionary: DataFrame, key: str, request: str, clean: str) -> DataFrame:
    """``key`` and the found numbers, by a join of the documents' different phrases with the terms.

    A term that is in most documents meets them in one key: a join whose large partitions adaptive execution splits.
    """
    most = dictionary.agg(F.max(F.size(F.split("term", " "))).alias("n")).first().n or 1
    phrases = documents.select(key, F.col(request).alias("_request"), F.explode(F.array_distinct(
        ev.phrases(ev.tokens(F.col(clean)), most))).alias("term"))
    bits = F.lit(0)
    for kind, bit in _BIT.items():
        own = (F.col("kind") == "skill") & F.col("critical") if kind == CRITICAL else F.col("kind") == kind
        bits = bits.bitwiseOR(F.when(own, F.lit(bit)).otherwise(F.lit(0)))
    counted = dictionary.select("request_id", "term", bits.alias("bits"), F.when(F.col("kind") == DEGREE, F.col("rank")).otherwise(F.lit(0)).alias("best"))
    terms = counted.groupBy("request_id", "term").agg(F.bit_or("bits").alias("bits"), F.max("best").alias("best"))
    own = phrases.join(terms.withColumnRenamed("request_id", "_request"), ["_request", "term"]).select(key, "term", "bits", "best")
    shared = phrases.join(terms.filter("request_id IS NULL").drop("request_id"), "term").select(key, "term", "bits", "best")
    each = own.unionByName(shared).groupBy(key, "term").agg(F.bit_or("bits").alias("bits"), F.max("best").alias("best"))
    return each.groupBy(key).agg(
        *[F.sum(F.col("bits").bitwiseAND(F.lit(1 << k)).cast("boolean").cast("int")).cast("int").alias(c) for k, c in enumerate(COUNTED)],
        F.max("best").alias(DEGREE))


def with_found(documents: DataFrame, dictionary: DataFrame, key: str, request: str = "request_id", clean: str = "clean",
               max_rows: int = TERM_ROWS, max_bytes: int = TERM_BYTES) -> DataFrame:
    """Add ``found``: for each counted column how many different terms of the document's request occur, and ``degree``.

    ``dictionary`` is ``(request_id, kind, term, critical, rank)`` with cleaned terms; those without a request count for all.
    Terms match whole words in lower case, of any number, and count once each; ``degree`` is the highest rank found, else 0.
    ``key`` names a column that is unique and not null; it is used where the dictionary is above the bounds and joined.
    """
    if fits_broadcast(dictionary, max_rows, max_bytes):
        return documents.withColumn("found", _walk(dictionary, F.col(request), F.col(clean)))
    joined = _join(documents, dictionary, key, request, clean).select(key, F.struct(*COUNTED, DEGREE).alias("found"))
    none = F.struct(*[F.lit(0).alias(c) for c in [*COUNTED, DEGREE]])
    return documents.join(joined, key, "left").withColumn("found", F.coalesce("found", none))
