"""Toxicity: class-conditional Kneser-Ney models of the bytes of words.

Both classes have counts of a byte after the up to five bytes before it in its word. Where a class has not seen a byte there
it falls back to one model of shorter histories that both share, made of continuation counts (in how many different longer
histories a byte was seen), so that a rare expression is judged by what is known of its like. A word's evidence is the
difference of its toxic and ordinary log-likelihood, by the byte; a text is judged by the mean of its three strongest words
and of its strongest fiftieth, so that a few strange words among thousands weigh little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfolio.llm.labelled import SCORE, labelled_sample, learned_in_a_task, logistic, scored, share_of
from tallyfolio.llm.quality import judged
from tallyfolio.llm.words import LOWER, places, runs, small_batches, utf8

HISTORY = 5
DISCOUNT = 0.75
STRENGTH = 8.0      # uses that the shared model counts for beside what a class has seen
SAMPLE = 3000       # labelled documents of each label that are learned from
STRETCH = 50_000    # words
NEVER = -30.0       # offset of a curve that finds nothing toxic
SIGNS = 259         # 256 bytes, start, end, none
START, END = 256, 257
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def histories(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte to predict (those of each word and its end): history, sign, and where each word's begin."""
    total = size + 1
    begin = np.cumsum(total) - total
    n = int(total.sum())
    inside = np.arange(n) - np.repeat(begin, total)
    source = np.repeat(start, total) + inside
    sign = np.where(inside < np.repeat(size, total), LOWER[data[np.minimum(source, len(data) - 1)]].astype(np.int64), END)
    history = np.zeros(n, np.int64)
    for k in range(HISTORY, 0, -1):
        past = np.zeros(n, np.int64)
        past[k:] = sign[:-k] + 1
        past = np.where(inside >= k, past, 0)
        past[inside == k - 1] = START + 1
        history = history * SIGNS + past
    return history, sign, begin


@dataclass
class Model:
    grams: np.ndarray       # sorted (history, sign)
    gain: np.ndarray        # what each adds to the evidence
    contexts: np.ndarray    # sorted histories
    unseen: np.ndarray      # what a sign not seen after them adds
    curve: np.ndarray

    def word_evidence(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        history, sign, begin = histories(data, start, size)
        gram = history * SIGNS + sign
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = self.grams[at] == gram
        gain = np.where(known, self.gain[at], 0.0)
        rest = np.flatnonzero(~known)
        at = np.minimum(np.searchsorted(self.contexts, history[rest]), len(self.contexts) - 1)
        gain[rest] = np.where(self.contexts[at] == history[rest], self.unseen[at], 0.0)
        return np.add.reduceat(gain, begin) / (size + 1)

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Mean of the three strongest words and of the strongest fiftieth of every text; zeros for one without words."""
        data, offsets = utf8(texts)
        row, start, size, word = places(data, offsets)
        out = np.zeros((len(texts), 2))
        if not len(row) or not len(self.grams):
            return out
        _, first, again = np.unique(word, return_index=True, return_inverse=True)
        value = self.word_evidence(data, start[first], size[first])[again]
        value = value[np.lexsort((-value, row))]
        begin, count = runs(row)
        rank = np.arange(len(row)) - np.repeat(begin, count)
        for k, most in enumerate((np.minimum(3, count), count // 50 + 1)):
            out[row[begin], k] = np.add.reduceat(np.where(rank < np.repeat(most, count), value, 0.0), begin) / most
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return scored(self.evidence(texts), self.curve)


def _spread(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    value, first, again = np.unique(keys, return_index=True, return_inverse=True)
    return value, first, [np.bincount(again, w, len(value)) for w in weights]


def shared_model(history: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Probability of every sign after its history less the oldest sign, from continuation counts of both classes."""
    chance = np.full(len(sign), 1 / (SIGNS - 1))
    gram = history * SIGNS + sign
    for order in range(HISTORY):            # histories of 0 signs, then longer ones
        longer = history % SIGNS ** (order + 1)
        seen, first = np.unique(longer * SIGNS + sign, return_index=True)
        short = history % SIGNS ** order
        key, _, (times,) = _spread(short[first] * SIGNS + sign[first], np.ones(len(seen)))
        context, _, (total, kinds) = _spread(key // SIGNS, times, np.ones(len(key)))
        at = np.searchsorted(key, short * SIGNS + sign)
        where = np.searchsorted(context, short)
        # a history that is shorter than this order keeps what it has
        full = history >= SIGNS ** (order - 1) if order else np.ones(len(sign), bool)
        new = np.maximum(times[at] - DISCOUNT, 0) / total[where] + DISCOUNT * kinds[where] / total[where] * chance
        chance = np.where(full, new, chance)
    return chance


def counted_grams(data: np.ndarray, start: np.ndarray, size: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Different (history, sign) of all words, and how often each class has them; a stretch of words at a time."""
    grams, times = [np.zeros(0, np.int64)], [np.zeros((2, 0))]
    for a in range(0, len(start), STRETCH):
        history, sign, _ = histories(data, start[a:a + STRETCH], size[a:a + STRETCH])
        owner = np.repeat(np.arange(len(size[a:a + STRETCH])), size[a:a + STRETCH] + 1)
        gram, _, n = _spread(history * SIGNS + sign, counts[0][a:a + STRETCH][owner], counts[1][a:a + STRETCH][owner])
        grams.append(gram)
        times.append(np.array(n))
    times = np.concatenate(times, axis=1)
    gram, _, n = _spread(np.concatenate(grams), times[0], times[1])
    return gram, n


def train_words(data: np.ndarray, start: np.ndarray, size: np.ndarray, counts: np.ndarray) -> Model:
    """A model without its curve from different words and how many texts of each class (row 0 ordinary, row 1 toxic) have them."""
    empty = np.zeros(0, np.int64)
    if not len(start) or (counts.sum(axis=1) == 0).any():
        return Model(empty, empty.astype(float), empty, empty.astype(float), np.zeros(3))
    gram, times = counted_grams(data, start, size, counts)
    shared = shared_model(gram // SIGNS, gram % SIGNS)
    context, _, sums = _spread(gram // SIGNS, times[0], times[1], times[0] > 0, times[1] > 0)
    where = np.searchsorted(context, gram // SIGNS)
    logs, back = [], []
    for k in (0, 1):
        total, kinds = sums[k], sums[2 + k]
        fall = (STRENGTH + DISCOUNT * kinds) / (STRENGTH + total)
        own = np.maximum(times[k] - DISCOUNT, 0) / (STRENGTH + total[where])
        logs.append(np.log(own + fall[where] * shared))
        back.append(np.log(fall))
    return Model(gram, logs[1] - logs[0], context, back[1] - back[0], np.zeros(3))


def fit(docs: DataFrame, labels: DataFrame, label: str, divisor: int, remainder: int, most: int = SAMPLE) -> Model:
    """Learn from at most ``most`` documents of each label: three of four parts for the counts, the last for the curve.

    Where the last part, or the others together, lack a label, all parts serve for it. Without evidence for both labels the
    model has no grams, and its curve says not toxic if there are ordinary documents, else a half. The counted words of the
    sample are learned from in one task; the driver holds the model only.
    """
    sample = labelled_sample(docs, labels, label, divisor, remainder, most)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = F.explode(F.array_distinct(F.split(F.translate("text", upper, lower), WORD_BREAK))).alias("word")
    parts = sample.groupBy("label").agg(F.count_if(F.col("part") < 3).alias("first"), F.count_if(F.col("part") == 3).alias("last")).collect()
    first = sample.where("part < 3") if all(r["first"] for r in parts) else sample
    counted = (first.select(word, "label").where("word <> ''").groupBy("word")
               .agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")))

    def learn(batches: list[pa.RecordBatch]) -> Model:
        words = pa.Table.from_batches(batches).sort_by("word").combine_chunks()
        data, offsets = utf8(words["word"])
        return train_words(data, offsets[:-1], np.diff(offsets), np.array([words["n0"], words["n1"]], float))

    none = np.zeros(0, np.int64)
    found = learned_in_a_task(counted, learn)
    model = Model(**found) if found else train_words(np.zeros(0, np.uint8), none, none, np.zeros((2, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = model.evidence(batch["text"])
            yield pa.RecordBatch.from_pydict({"label": batch["label"], "a": found[:, 0], "b": found[:, 1]})

    part = sample.where("part = 3") if all(r["last"] for r in parts) else sample
    if not len(model.grams):
        model.curve[-1] = NEVER if any(r["label"] == 0 for r in parts) else 0.0
        return model
    rest = part.mapInArrow(run, "label int, a double, b double").toPandas().sort_values(["label", "a", "b"])
    if rest["label"].nunique() == 2:
        model.curve = logistic(rest[["a", "b"]].to_numpy(), rest["label"].to_numpy(), share_of(labels, label, divisor, remainder))
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", divisor: int = 4, remainder: int = 2,
                    threshold: float = 0.3, most: int = SAMPLE, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``threshold`` on) of every document; only the text is scored.

    Null and empty texts have no evidence. Rows that repeat are scored as often; a null id is not held out. With ``keep`` the columns
    of ``docs`` come back instead, of the documents predicted 0. Without evidence for both labels nothing can be told toxic, so
    ``keep`` keeps all; every score is then about 0 if there are ordinary labels, else 0.5.
    """
    learned = fit(docs, labels, label, divisor, remainder, most)
    if keep and not len(learned.grams):
        return docs
    model = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            yield batch.append_column(SCORE, pa.array(model.value.scores(batch["text"]), pa.float64()))

    return judged(docs, run, divisor, remainder, threshold, keep, 0)
