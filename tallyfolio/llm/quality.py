"""Quality classifier: support vectors on n-gram indicators that are scaled by class log-count ratios.

Indicators: which three-byte pieces a text has, and which share of it each word shape and pair of shapes takes (a shape
is the kind of a word's first, second and last sign, its length, and whether it repeats the word before). A text's
vector has the log-count ratio of each indicator it holds and is scaled to length one, so long texts weigh no more
than short ones. The model is fitted by dual coordinate descent on a bounded sample and has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfolio.llm.labelled import SCORE, held_out, labelled_sample, learned_in_a_task, logistic, scored, share_of
from tallyfolio.llm.words import mix, places, small_batches, utf8, with_column

BITS = 18
DIMENSIONS = 1 << BITS
LEVELS = 7
SAMPLE = 2500       # labelled documents of each label that are learned from
BIAS = 0.3
KIND = np.full(256, 3, np.int64)        # 0 capital, 1 small letter or byte of another letter, 2 digit, 3 other
KIND[65:91], KIND[97:123], KIND[128:], KIND[48:58] = 0, 1, 1, 2


def _distinct(codes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The different values among ``codes``; ``last`` is scratch space with a place for each possible value."""
    order = np.arange(len(codes), dtype=np.int32)
    last[codes] = order
    return codes[last[codes] == order]


def _shares(row: np.ndarray, value: np.ndarray, totals: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, indicator) for every share 2**-k, k from 0 to LEVELS - 1, that a value reaches, and for its presence."""
    seen, times = np.unique(row * 1_000_000 + value, return_counts=True)
    row, value = seen // 1_000_000, seen % 1_000_000
    level = np.clip(LEVELS + np.floor(np.log2(times / totals[row])), -1, LEVELS).astype(np.int64) + 2
    who = np.repeat(np.arange(len(seen)), level)
    step = np.arange(len(who)) - np.repeat(np.cumsum(level) - level, level)
    code = mix((value[who] * 16 + step).astype(np.uint64) + np.uint64(seed << 40)) >> np.uint64(64 - BITS)
    return row[who], code.astype(np.int64)


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, indicator) of all texts, each pair once."""
    data, offsets = utf8(texts)
    rows, found = [], []
    if len(data) > 2:
        wide = data.astype(np.uint32)
        codes = (((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
        last = np.zeros(DIMENSIONS, np.int32)
        for i in np.flatnonzero(np.diff(offsets) > 2):
            own = _distinct(codes[offsets[i]:offsets[i + 1] - 2], last)
            rows.append(np.full(len(own), i))
            found.append(own)
    row, start, size, word = places(data, offsets)
    if len(row):
        same = np.zeros(len(row), np.int64)
        same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
        second = KIND[data[np.minimum(start + 1, start + size - 1)]]
        shape = (((KIND[data[start]] * 4 + second) * 4 + KIND[data[start + size - 1]]) * 6 + np.minimum(np.log2(size).astype(np.int64), 5)) * 2 + same
        totals = np.bincount(row, minlength=len(texts))
        pair = np.flatnonzero(row[1:] == row[:-1])
        for r, f in (_shares(row, shape, totals, 1), _shares(row[pair], shape[pair] * 800 + shape[pair + 1], totals, 2)):
            rows.append(r)
            found.append(f)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, code = np.concatenate(rows), np.concatenate(found)
    both = np.unique(row * DIMENSIONS + code)
    return both // DIMENSIONS, both % DIMENSIONS


@dataclass
class Model:
    ratio: np.ndarray       # log-count ratio of each indicator, float32
    weight: np.ndarray      # ratio times the weight of the fitted plane, float32
    offset: float
    curve: np.ndarray

    def margins(self, texts: pa.Array) -> np.ndarray:
        row, code = indicators(texts)
        n = len(texts)
        length = np.sqrt(np.bincount(row, self.ratio[code].astype(float) ** 2, n))
        return np.bincount(row, self.weight[code].astype(float), n) / np.maximum(length, 1e-9) + self.offset

    def scores(self, texts: pa.Array) -> np.ndarray:
        return scored(self.margins(texts)[:, None], self.curve)


def descend(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, cost: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Weights (last: offset) of the plane of least hinge loss: dual coordinate descent over rows of length one."""
    w, alpha = np.zeros(DIMENSIONS + 1), np.zeros(len(rows))
    chance = np.random.default_rng(5)
    for _ in range(rounds):
        for i in chance.permutation(len(rows)):
            slope = signs[i] * (w[rows[i]] @ values[i] + w[-1] * BIAS) - 1
            new = min(max(alpha[i] - slope / (1 + BIAS * BIAS), 0.0), cost[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * signs[i] * values[i]
                w[-1] += (new - alpha[i]) * signs[i] * BIAS
                alpha[i] = new
    return w


def train(rows: list[np.ndarray], labels: np.ndarray, part: np.ndarray, ones: float = 0.5, smoothing: float = 1.0, cost: float = 1.0) -> Model:
    """A model from the indicators of texts; part 3 is kept for the curve. Without both labels every score is 0.5."""
    use = part != 3
    if len(set(labels[use].tolist())) < 2:
        return Model(np.ones(DIMENSIONS, np.float32), np.zeros(DIMENSIONS, np.float32), 0.0, np.zeros(2))
    chosen = np.flatnonzero(use)
    counts = np.full((2, DIMENSIONS), smoothing)
    for i in chosen:
        counts[labels[i], rows[i]] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    ratio = np.log(counts[1] / counts[0])
    values = [(ratio[rows[i]] / max(1e-9, np.sqrt((ratio[rows[i]] ** 2).sum()))).astype(np.float32) for i in chosen]
    balance = {k: len(chosen) / (2 * (labels[chosen] == k).sum()) for k in (0, 1)}
    w = descend([rows[i] for i in chosen], values, np.where(labels[chosen] == 1, 1.0, -1.0), np.array([cost * balance[k] for k in labels[chosen]]))
    model = Model(ratio.astype(np.float32), (w[:-1] * ratio).astype(np.float32), float(w[-1] * BIAS), np.zeros(2))
    test = np.flatnonzero(~use) if len(set(labels[~use].tolist())) == 2 else np.arange(len(rows))
    lengths = [max(1e-9, float(np.sqrt((ratio[rows[i]] ** 2).sum()))) for i in test]
    margins = np.array([model.weight[rows[i]].astype(float).sum() / n + model.offset for i, n in zip(test, lengths)])
    model.curve = logistic(margins[:, None], labels[test], ones)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str, divisor: int, remainder: int, most: int = SAMPLE) -> Model:
    """Learn from at most ``most`` labelled documents of each label, in one task; the driver holds the model only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            row, code = indicators(batch["text"])
            ends = np.searchsorted(row, np.arange(1, batch.num_rows + 1))
            held = [x.astype(np.int32).tobytes() for x in np.split(code, ends[:-1])]
            yield pa.RecordBatch.from_pydict({"label": batch["label"], "part": batch["part"], "held": pa.array(held, pa.binary())})

    ones = share_of(labels, label, divisor, remainder)

    def learn(batches: list[pa.RecordBatch]) -> Model:
        table = pa.Table.from_batches(batches)
        sample = sorted(zip(table["held"].to_pylist(), table["label"].to_pylist(), table["part"].to_pylist()))
        rows = [np.frombuffer(held, np.int32) for held, _, _ in sample]
        return train(rows, np.array([x for _, x, _ in sample], np.int64), np.array([x for _, _, x in sample], np.int64), ones)

    sample = labelled_sample(docs, labels, label, divisor, remainder, most).mapInArrow(run, "label int, part int, held binary")
    none = np.zeros(0, np.int64)
    found = learned_in_a_task(sample, learn)
    return Model(**found) if found else train([], none, none)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", divisor: int = 5, remainder: int = 0,
                   threshold: float = 0.3, most: int = SAMPLE, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``threshold`` on) of every document; only the text is scored.

    Null and empty texts are scored as a text without indicators. Rows that repeat are scored as often; a null id is not held
    out. Without labels of both kinds every score is 0.5. With ``keep`` the columns of ``docs`` come back instead, of the
    documents predicted 1.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, divisor, remainder, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            yield batch.append_column(SCORE, pa.array(model.value.scores(batch["text"]), pa.float64()))

    return judged(docs, run, divisor, remainder, threshold, keep, 1)


def judged(docs: DataFrame, run, divisor: int, remainder: int, threshold: float, keep: bool, wanted: int) -> DataFrame:
    """Scores of ``run`` as rows of the classifier, or with ``keep`` the documents that are predicted ``wanted``."""
    narrow = docs if keep else docs.select("doc_id", "text")
    predicted = (F.col(SCORE) >= threshold).cast("int")
    found = narrow.mapInArrow(run, with_column(narrow, SCORE, "double"))
    if keep:
        return found.where(predicted == wanted).drop(SCORE)
    return found.select("doc_id", held_out("doc_id", divisor, remainder).alias("held_out"), F.col(SCORE).alias("score"), predicted.alias("predicted"))
