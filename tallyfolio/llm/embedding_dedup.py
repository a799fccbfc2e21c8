"""Near copies among embeddings by sorted projection passes.

Every pass projects the vectors on its own random directions, concatenates the signs to one word (a lexicographic sort
key) and compares each vector with the next ``window`` to ``2 * window`` ones in that order. Neighbours reach across the
borders of tasks no further than one task, so each pass may miss some pairs. Windows tell how many leading bits set each
vector's neighbours apart, and vectors go through further passes, or are compared in blocks, until the chance to miss a pair
at the threshold is estimated at ``1 - recall`` at most. Links found are tied together over all passes. A window is bounded, but groups are not: after the passes the links inside each class are counted by
comparing blocks of it with each other, so the number of links of a vector does not depend on the window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfolio.llm.components import components
from tallyfolio.llm.words import runs
from tallyfolio.workspace import materialize

COSINE, WINDOW, BITS, RECALL, BLOCK = 0.95, 128, 62, 0.999, 1024


def passes_for(vectors: int, cosine: float, window: int, recall: float) -> int:
    """Passes so that two vectors at the threshold share the first bits that tell windows apart in one of them."""
    bits = max(1.0, math.log2(max(2, vectors) / window))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return max(3, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def unit(blobs: pa.Array, size: int) -> np.ndarray:
    """Rows of doubles, scaled to length one."""
    rows = np.frombuffer(b"".join(x.as_py() for x in blobs), "<f8").reshape(-1, size)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _bytes(id_col: str, vec_col: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch["vec"].to_pylist():
                row = np.array([np.nan if x is None else x for x in value or [0.0]], "<f8") + 0.0      # no negative zero
                out.append(row.tobytes() if np.isfinite(row).all() and row.any() else None)
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "vec": pa.array(out, pa.binary())})
    return run


def _project(passes: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = 1 << np.arange(BITS, dtype=np.int64)[::-1]
        for batch in batches:
            widths = np.array([len(x.as_py()) // 8 for x in batch["vec"]], np.int64)
            for width in np.unique(widths):
                some = batch.take(pa.array(np.flatnonzero(widths == width)))
                rows = unit(some["vec"], int(width))
                for k in range(passes):
                    directions = np.random.default_rng([seed, int(width), k]).standard_normal((int(width), BITS))
                    yield pa.RecordBatch.from_pydict({
                        "pass": np.full(len(rows), k * 100_000 + int(width), np.int64), "code": (rows @ directions > 0) @ bits,
                        "id": some["id"], "vec": some["vec"]})
    return run


def _stars(near: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a block as stars: each vector with the smallest id that links inside the block reach."""
    label = np.arange(len(ids))
    order = np.argsort(ids)
    near, ids = near[np.ix_(order, order)], ids[order]
    touched = np.flatnonzero(near.any(axis=1))
    near = near[np.ix_(touched, touched)] | np.eye(len(touched), dtype=bool)
    label = np.arange(len(touched))
    while len(touched):
        low = np.where(near, label, len(label)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    return ids[touched][label[label != np.arange(len(label))]], ids[touched][label != np.arange(len(label))]


def _shared_bits(codes: np.ndarray, other: int) -> np.ndarray:
    """Leading bits in which each code equals ``other``."""
    x = codes ^ np.int64(other)
    top = x >> 31
    return BITS - np.where(top > 0, 31 + np.frexp(top.astype(float))[1], np.frexp((x & 0x7FFFFFFF).astype(float))[1])


def _windows(cosine: float, window: int) -> Callable:
    """Links of the windows as (a, b), and as (a, null, miss) the logarithm of the chance that a pair of a at the threshold is not seen here.

    A vector sees all that share more leading bits than the farthest rows it is compared with; a task does not know what
    lies beyond its first and last rows and says nothing of vectors next to them.
    """
    agree = 1 - math.acos(cosine) / math.pi

    def misses(codes: np.ndarray, low: int | None, high: int | None) -> np.ndarray:
        bits = np.maximum(*(np.full(len(codes), -1) if x is None else _shared_bits(codes, x) for x in (low, high))) + 1
        return np.log1p(-np.minimum(np.where(bits > BITS, 0.0, agree ** bits), 1 - 1e-12))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(number: int, vecs: list, ids: list, codes: list, low: list, ended: bool) -> pa.RecordBatch:
            """low: the first code before these that is compared with the first half, None if there is none; empty if not known."""
            names = np.array(ids, np.int64)
            a, b = _linked(vecs, names, number % 100_000, cosine)
            code, told = np.array(codes, np.int64), []
            if low and (ended or len(ids) == 2 * window):
                told.append((names[:window], misses(code[:window], low[0], None if ended else codes[-1])))
            if ended and len(ids) > window:
                told.append((names[window:], misses(code[window:], codes[0], None)))
            who = np.concatenate([names[:0], *(x for x, _ in told)])
            miss = np.concatenate([np.zeros(0), *(x for _, x in told)])
            return pa.RecordBatch.from_pydict({
                "a": np.concatenate([a, who]), "b": pa.array([*b.tolist(), *[None] * len(who)], pa.int64()),
                "miss": pa.array([*[None] * len(a), *miss.tolist()], pa.float64())})

        number, vecs, ids, codes, low = None, [], [], [], []
        for batch in batches:
            for p, c, i, v in zip(*[batch[x].to_pylist() for x in ("pass", "code", "id", "vec")]):
                if p != number or len(ids) == 2 * window:
                    if ids:
                        yield compare(number, vecs, ids, codes, low, p != number)
                    if p != number:
                        low = [] if number is None else [None]
                        number, vecs, ids, codes = p, [], [], []
                    else:
                        low = [codes[0]]
                        vecs, ids, codes = vecs[window:], ids[window:], codes[window:]
                vecs.append(v)
                ids.append(i)
                codes.append(c)
        if ids:
            yield compare(number, vecs, ids, codes, low, False)
    return run


def _linked(vecs: list, ids: np.ndarray, size: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    rows = unit(pa.array(vecs, pa.binary()), size)
    near = rows @ rows.T >= cosine
    np.fill_diagonal(near, False)
    return _stars(near, ids)


def _all_pairs(cosine: float) -> Callable:
    """Links inside each cell, rows sorted by cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, vecs = None, [], []
        for batch in batches:
            for w, i, j, name, vec in zip(*[batch[c].to_pylist() for c in ("width", "i", "j", "id", "vec")]):
                if (w, i, j) != last:
                    if len(ids) > 1:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _linked(vecs, np.array(ids, np.int64), last[0] // 8, cosine)], ["a", "b"])
                    last, ids, vecs = (w, i, j), [], []
                ids.append(name)
                vecs.append(vec)
        if len(ids) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _linked(vecs, np.array(ids, np.int64), last[0] // 8, cosine)], ["a", "b"])
    return run


def _candidates(vectors: DataFrame, count: int, cosine: float, window: int, recall: float, seed: int) -> DataFrame:
    """Links (a, b) that tie all near vectors (id, vec) together.

    Vectors whose chance to miss a partner is still above ``1 - recall`` after a round of passes, as in a crowd that shares
    many leading bits, go to the next round of twice as many passes among themselves. When blocks of those left are no
    more than the passes that were made, they are all compared with each other. A pair is open only while both its ends are.
    """
    spark = vectors.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links, done, passes = None, 0, passes_for(count, cosine, window, recall)
    while count > BLOCK * max(4, done):
        tasks = max(shuffles, count * passes // 200_000 + 1)
        found = materialize(vectors.mapInArrow(_project(passes, seed + done), "pass bigint, code bigint, id bigint, vec binary")
                            .repartitionByRange(tasks, "pass", "code").sortWithinPartitions("pass", "code", "id")
                            .mapInArrow(_windows(cosine, window), "a bigint, b bigint, miss double"), "found")
        some = found.where("b IS NOT NULL").select("a", "b")
        links = some if links is None else links.unionAll(some)
        sure = found.where("b IS NULL").groupBy("a").agg(F.sum("miss").alias("miss")).where(F.col("miss") <= math.log(1 - recall))
        vectors = materialize(vectors.join(sure.select(F.col("a").alias("id")), "id", "left_anti"), "open")
        count, done, passes = vectors.count(), done + passes, 2 * passes
    blocks = count // BLOCK + 1
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    cells = (vectors.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .select(F.octet_length("vec").alias("width"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "vec"))
    rest = (cells.repartition(max(shuffles, count * blocks // 50_000 + 1), "width", "i", "j").sortWithinPartitions("width", "i", "j")
            .mapInArrow(_all_pairs(cosine), "a bigint, b bigint"))
    return rest if links is None else links.unionAll(rest)


def _count(cosine: float) -> Callable:
    """Partial numbers of links (copies weighed in) between the blocks left and right of a cell, rows sorted by cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(cell: tuple, held: list) -> pa.RecordBatch:
            ids = np.array([h[0] for h in held], np.int64)
            copies, block = np.array([h[2] for h in held], np.int64), np.array([h[3] for h in held], np.int64)
            rows = unit(pa.array([h[1] for h in held], pa.binary()), len(held[0][1]) // 8)
            near = rows @ rows.T >= cosine
            np.fill_diagonal(near, False)
            if cell[1] != cell[2]:
                near &= block[:, None] != block[None, :]
            return pa.RecordBatch.from_pydict({"id": ids, "links": near @ copies})

        last, held = None, []
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("component", "i", "j", "id", "vec", "copies", "block")]
            for c, i, j, *row in zip(*columns):
                if (c, i, j) != last:
                    if held:
                        yield compare(last, held)
                    last, held = (c, i, j), []
                held.append(row)
        if held:
            yield compare(last, held)
    return run


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE,
                    window: int = WINDOW, recall: float = RECALL, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row with an id; ids are unique bigints.

    Vectors that are null or empty, zero, or hold null or non-finite numbers link with nothing; vectors of different widths
    neither. Equal vectors are compared once and count as links of each other, as do rows that repeat an id. No rows give no rows.
    """
    spark = vectors.sparkSession
    raw = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
    rows = materialize(raw.mapInArrow(_bytes(id_col, vec_col), "id bigint, vec binary").withColumn("key", F.sha2("vec", 256)), "vectors")
    reps = rows.where("vec IS NOT NULL").groupBy("key").agg(F.min("id").alias("rid"), F.count("*").alias("copies"))
    reps = materialize(reps, "reps")
    one = materialize(rows.join(reps, (rows.id == reps.rid) & (rows.key == reps.key)).select("id", "vec", "copies").dropDuplicates(["id"]), "distinct")
    count = one.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // 20_000 + 1)
    found = _candidates(one.select("id", "vec"), count, cosine, window, recall, seed)
    known = materialize(components(materialize(found.distinct(), "found")), "classes")
    sizes = known.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = (known.join(sizes, "component").join(one, "id")
              .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "vec", "copies", F.col("block").cast("bigint").alias("block")))
    links = (member.repartition(tasks, "component", "i", "j").sortWithinPartitions("component", "i", "j")
             .mapInArrow(_count(cosine), "id bigint, links bigint").groupBy("id").agg(F.sum("links").alias("links")))
    judged = reps.join(known.withColumnRenamed("id", "rid"), "rid", "left").join(links.withColumnRenamed("id", "rid"), "rid", "left")
    component = F.coalesce("component", "rid", "id")
    return (rows.select("id", "key").join(judged, "key", "left")
            .select(F.col("id").alias("vec_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)).cast("bigint").alias("n_links"),
                    component.alias("component_id"), (F.col("id") == component).alias("kept")))
