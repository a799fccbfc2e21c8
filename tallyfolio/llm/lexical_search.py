"""Ranked lexical search: the k documents of highest score for each item, exactly, by ball trees of sparse vectors.

A document is the vector of its saturated term counts, an item the vector of its terms' weights; the score is their inner
product. Each task gathers documents into groups and builds a ball tree of each: a group is cut in two between the vector
farthest from its centroid and the one farthest from that, until a leaf holds few documents. An item visits a tree best
bound first. The bound of a ball is the score of its centroid plus the smaller of (length of the item x radius) and
(weights x radius along each of the item's terms); a ball that cannot reach the item's k-th score so far is cut off with all below.
Bounds are doubles, rounded up beyond their error; scores at the leaves are exact 64-bit integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfolio.llm.words import BYTES, LOWER, places, small_batches, utf8
from tallyfolio.workspace import materialize

PAIRS = 200_000         # (item, term) pairs searched in one round
GROUP = 4096            # documents to a tree, fewer where there are many terms
LEAF = 32
CELLS = 8_000_000       # numbers in the centroids of one tree
LETTER = np.zeros(256, bool)
LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
CODES = np.where(LETTER, BYTES[LOWER], np.uint64(0))


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, 64-bit hash) of every term."""
    text, _, _, hashes = places(*utf8(texts), CODES)
    return text, hashes.view(np.int64)


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Different (item, term) pairs."""
    kind = items.schema[item_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            text, hashes = _terms(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["item"].take(pa.array(text)), pa.array(hashes)], names=["item", "term"])

    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"item {kind.simpleString()}, term bigint").distinct()


def document_vectors(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts): all terms of each text, and places in ``vocabulary`` and counts of those that it holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            text, hashes = _terms(batch["text"])
            n = np.bincount(text, minlength=batch.num_rows)
            at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            known = vocabulary[at] == hashes
            pairs, counts = np.unique(text[known] * len(vocabulary) + at[known], return_counts=True)
            row, term = np.divmod(pairs, len(vocabulary))
            edges = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.ListArray.from_arrays(edges, pa.array(term, pa.int32())),
                                              pa.ListArray.from_arrays(edges, pa.array(counts, pa.int64()))], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


class Balls:
    """Ball tree of sparse rows. Node 0 is the root; ``left`` of a leaf is -1, of others the first of two neighbouring children."""

    def __init__(self, edges: np.ndarray, columns: np.ndarray, values: np.ndarray, whole: np.ndarray, width: int, leaf: int = LEAF) -> None:
        """Row i holds ``values`` at ``columns``, both between ``edges[i]`` and ``edges[i + 1]``, and the integers ``whole`` to be scored."""
        self.edges, self.columns, self.values, self.width = edges, columns, values, width
        self.norms = self._dot(values * values, None)
        self.order = np.arange(len(edges) - 1)
        self.nodes, self.left = [(0, len(self.order))], [-1]
        sums, peaks, radii = [], [], []
        node = 0
        while node < len(self.nodes):
            a, b = self.nodes[node]
            rows = self.order[a:b]
            places = self._places(rows)
            centre = np.bincount(columns[places], values[places], minlength=width) / max(1, len(rows))
            peak = np.zeros(width)
            np.maximum.at(peak, columns[places], values[places])
            far = self._distances(rows, places, centre)
            sums.append(centre)
            peaks.append(peak)
            radii.append(math.sqrt(max(0.0, far.max(initial=0.0))))
            if len(rows) > leaf and far.max() > 0:
                one = self._distances(rows, places, self._dense(rows[far.argmax()]))
                two = self._distances(rows, places, self._dense(rows[one.argmax()]))
                ranked = np.argsort(one - two, kind="stable")
                cut = int(np.clip(np.searchsorted((one - two)[ranked], 0.0), len(rows) // 4, len(rows) - len(rows) // 4))
                self.order[a:b] = rows[ranked]
                self.left[node] = len(self.nodes)
                self.nodes += [(a, a + cut), (a + cut, b)]
                self.left += [-1, -1]
            node += 1
        self.centres, self.peaks, self.radii = np.array(sums), np.array(peaks), np.array(radii)
        places = self._places(self.order)       # rows as the leaves have them
        self.sorted_edges = np.append(0, np.cumsum(np.diff(edges)[self.order]))
        self.sorted_columns, self.sorted_whole = columns[places], whole[places]

    def _places(self, rows: np.ndarray) -> np.ndarray:
        size = self.edges[rows + 1] - self.edges[rows]
        return np.repeat(self.edges[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def _dot(self, products: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
        """Sums of ``products`` by row."""
        size = np.diff(self.edges) if rows is None else self.edges[rows + 1] - self.edges[rows]
        return np.bincount(np.repeat(np.arange(len(size)), size), products, minlength=len(size))

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.width)
        out[self.columns[self.edges[row]:self.edges[row + 1]]] = self.values[self.edges[row]:self.edges[row + 1]]
        return out

    def _distances(self, rows: np.ndarray, places: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Squared distances, rounded up by more than what may be lost to cancelling."""
        length = float(point @ point)
        plain = self.norms[rows] + length - 2 * self._dot(self.values[places] * point[self.columns[places]], rows)
        return np.maximum(plain, 0.0) + 1e-11 * (self.norms[rows] + length)

    def bounds(self, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For every node, no less than the inner product of any row below it with ``weights`` (none negative) at ``columns``."""
        middle = self.centres[:, columns] @ weights
        ball = math.sqrt(float(weights @ weights)) * self.radii
        along = np.maximum(self.peaks[:, columns] - self.centres[:, columns], 0.0) @ weights
        return (middle + np.minimum(ball, along)) * (1 + 1e-9) + 1.0


class Best:
    """The k highest scores of an item so far, of equal ones those of smallest id."""

    def __init__(self, k: int) -> None:
        self.k, self.floor = k, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.floor
        if not good.any():
            return
        scores, ids = np.append(self.scores, scores[good]), np.append(self.ids, ids[good])
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.floor = int(self.scores[-1])


def visit(tree: Balls, bounds: np.ndarray, best: Best, score: np.ndarray, ids: np.ndarray) -> int:
    """Offer all rows of ``tree`` that can still count, best ball first; the number of leaves looked at.

    ``score`` holds the item's integer weight at each column. No row is empty.
    """
    heap, leaves = [(-bounds[0], 0)], 0
    while heap:
        bound, node = heapq.heappop(heap)
        if -bound < best.floor:
            break
        child = tree.left[node]
        if child >= 0:
            heapq.heappush(heap, (-bounds[child], child))
            heapq.heappush(heap, (-bounds[child + 1], child + 1))
            continue
        a, b = tree.nodes[node]
        p, q = tree.sorted_edges[a], tree.sorted_edges[b]
        totals = np.add.reduceat(score[tree.sorted_columns[p:q]] * tree.sorted_whole[p:q], tree.sorted_edges[a:b] - p)
        best.offer(totals, ids[tree.order[a:b]])
        leaves += 1
    return leaves


class Corpus:
    """Numbers of the whole corpus: documents with a term, their terms, and the weight of each term of the vocabulary."""

    def __init__(self, documents: int, terms: int, frequency: np.ndarray) -> None:
        self.documents, self.terms = documents, terms
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)

    def saturated(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The integer values of terms that occur ``counts`` times in documents of ``n`` terms."""
        m = 100 - 90 + 90 * n * self.documents // self.terms
        return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def _search(vectors: DataFrame, corpus: Corpus, columns: list[np.ndarray], k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each task for each item, items by their place in ``columns``."""
    width = len(corpus.weights)
    many = max(LEAF, min(GROUP, CELLS // max(1, width) * LEAF // 4))
    sent = vectors.sparkSession.sparkContext.broadcast((corpus, columns))
    out = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, columns = sent.value
        root = np.sqrt(corpus.weights.astype(float))
        best = [Best(k) for _ in columns]
        score = np.zeros(width, np.int64)

        def group(batch: pa.RecordBatch) -> None:
            edges, counts = np.asarray(batch["terms"].offsets, np.int64), batch["counts"].flatten()
            edges = edges - edges[0]
            whole = corpus.saturated(np.asarray(counts), np.repeat(np.asarray(batch["n"]), np.diff(edges)))
            local, at = np.unique(np.asarray(batch["terms"].flatten()), return_inverse=True)
            tree = Balls(edges, at, whole * root[local][at], whole, len(local))
            ids = np.asarray(batch["doc_id"])
            for own, found in zip(columns, best):
                place = np.searchsorted(local, own[own <= local[-1]])
                place = place[np.isin(local[place], own)]
                if len(place):
                    score[place] = corpus.weights[local[place]]
                    visit(tree, tree.bounds(place, root[local[place]]), found, score, ids)
                    score[place] = 0

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for a in range(0, batch.num_rows, many):
                part = batch.slice(a, many)
                if held and sum(x.num_rows for x in held) + part.num_rows > many:
                    group(pa.concat_batches(held))
                    held = []
                held.append(part)
        if held:
            group(pa.concat_batches(held))
        number = [len(found.scores) for found in best]
        if sum(number):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), number), pa.int32()), pa.array(np.concatenate([found.ids for found in best])),
                                              pa.array(np.concatenate([found.scores for found in best]))], schema=out)

    return vectors.where(F.col("doc_id").isNotNull() & (F.size("terms") > 0)).mapInArrow(run, "item int, doc_id bigint, score bigint")


def _round(docs: DataFrame, pairs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, rank, doc_id, score) for items of no more than some ``PAIRS`` pairs, which the driver holds."""
    spark = docs.sparkSession
    by_item: dict = {}
    for row in pairs.collect():
        by_item.setdefault(row["item"], []).append(row["term"])
    if not by_item:
        return spark.createDataFrame([], f"item {pairs.schema['item'].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    vocabulary = np.unique(np.array([term for terms in by_item.values() for term in terms], np.int64))
    vectors = materialize(document_vectors(docs, vocabulary, id_col, text_col), "vectors")
    total = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    frequency = np.zeros(len(vocabulary), np.int64)
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        frequency[row["term"]] = row["count"]
    corpus = Corpus(total["documents"], total["terms"] or 0, frequency)
    columns = [np.sort(np.searchsorted(vocabulary, np.array(terms, np.int64))) for terms in by_item.values()]
    names = spark.createDataFrame(list(enumerate(by_item)), f"number int, item {pairs.schema['item'].dataType.simpleString()}")
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    found = _search(vectors, corpus, columns, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.join(F.broadcast(names), F.col("number") == found["item"]).select(names["item"], "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_col, rank (1 to k), doc_id, score: the k documents of highest score for each item, of equal ones those of smallest id.

    Terms are runs of ASCII letters and digits and of all signs beyond ASCII, ``A``-``Z`` as ``a``-``z``; 64-bit hashes are compared.
    With N documents that have a term, L terms in all, n in the document, a term in df documents and tf times in this one:
    weight ``floor(1000 ln((2N + 2) / (2df + 1)))``, ``m = 10 + 90 n N div L``, score the sum over the item's different terms
    of weight times ``1e9 tf div (1000 tf + 8 m)``. Only scores above 0 are returned.

    Nulls and empty texts have no terms; rows of one item id are one item with the terms of all; items without terms or matches
    give no rows. Documents of one id are ranked each; those without an id count in the corpus but are not ranked. Other
    columns are not carried. The pairs of item and term are counted: they are searched in rounds of some ``PAIRS``, each
    of which broadcasts its items and reads the documents once. Documents are not shuffled; k rows of each task and item are.
    """
    pairs = materialize(item_terms(items, item_col, item_text_col), "item-terms")
    rounds = max(1, -(-pairs.count() // PAIRS))
    parts = [_round(docs, pairs.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == i), k, id_col, text_col) for i in range(rounds)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("item", item_col)
