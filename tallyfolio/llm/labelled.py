"""Bounded samples of labelled documents, learning from them in a task, and the curve that turns a margin into a score."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SCORE = "__score_of_this_text__"      # carried beside the columns of documents


def held_out(id_col: str, divisor: int, remainder: int) -> Column:
    """True for the rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % divisor == remainder, F.lit(False))


def learned_in_a_task(rows: DataFrame, learn: Callable[[list[pa.RecordBatch]], object]) -> dict | None:
    """The fields of what ``learn`` makes of all ``rows``, in one task; None of no rows.

    For bounded samples, so that the driver need not hold what learning takes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(vars(learn(held)))], pa.binary())})

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0].model)) if found else None


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, remainder: int, most: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label, part) of at most ``most`` documents of each label 0 and 1, whole texts; part is 0 to 3.

    Taken by the hash of the id, which is even over sources and the same in every run. Ids with several labels count as 1.
    """
    usable = (labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id_col, divisor, remainder))
              .groupBy(id_col).agg(F.max(label).cast("int").alias("label")))
    order = F.xxhash64(id_col)
    chosen = [usable.where(F.col("label") == k).orderBy(order).limit(most) for k in (0, 1)]
    narrow = chosen[0].unionAll(chosen[1]).select(F.col(id_col).alias("_id"), "label", F.pmod(order, F.lit(4)).cast("int").alias("part"))
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(narrow), F.col("_doc") == F.col("_id")).select("text", "label", "part")     # at most 2 * most narrow rows


def share_of(labels: DataFrame, label: str, divisor: int, remainder: int, id_col: str = "doc_id") -> float:
    """Share of label 1 among the labels 0 and 1 that may be learned from."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id_col, divisor, remainder))
    return float(usable.agg(F.avg(label)).first()[0] or 0.5)


def logistic(x: np.ndarray, y: np.ndarray, ones: float, ridge: float = 1e-4, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the offset of a logistic curve, by Newton's method; ``ones`` is the share that label 1 counts for."""
    rows = np.column_stack([x, np.ones(len(x))])
    share = np.where(y == 1, ones / max(1, (y == 1).sum()), (1 - ones) / max(1, (y == 0).sum()))
    w = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (share * (p - y)) + ridge * w
        bend = (rows * (share * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ rows + ridge * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    return w


def scored(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ w, -30, 30)))
