"""Token counts of whole texts by a vocabulary file of the ``tokenizers`` library; ids never leave the batch.

Texts are read in stretches of like size in bytes, and long texts are cut at white space, which no match of the vocabulary's
pre-tokeniser, no merge and no special token reaches across. So the words of a stretch can be encoded apart: those that
were not met before go to the library as one batch, and only the lengths are kept.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructType

from tallyfolio.llm.words import SPACE, small_batches, utf8

STRETCH = 1 << 20       # bytes of text taken at a time
KEPT_WORDS = 400_000    # words whose lengths are kept between batches
KEPT_BYTES = 32 << 20   # and their bytes: beyond either, counting begins anew


@lru_cache(2)
def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """Texts to their numbers of tokens, as the library gives them for the file at ``path``."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark deals out the work
    import tokenizers
    coding = tokenizers.Tokenizer.from_file(path)
    coding.no_truncation()
    coding.no_padding()
    return lambda texts: [len(found) for found in coding.encode_batch_fast(texts, add_special_tokens=False)]


def stretches(data: np.ndarray, most: int = STRETCH) -> Iterator[bytes]:
    """``data`` in pieces of about ``most`` bytes that end at white space, or are one longer word."""
    at = 0
    while at < len(data):
        end = at + most
        while end < len(data):
            near = np.flatnonzero(SPACE[data[end:end + most]])
            if len(near):
                end += int(near[0])
                break
            end += most
        yield data[at:end].tobytes()
        at = end


class Counter:
    """Numbers of tokens; the lengths of words met before are kept."""

    def __init__(self, path: str, kept_words: int = KEPT_WORDS, kept_bytes: int = KEPT_BYTES) -> None:
        self.encode, self.known, self.held = encoder(path), {}, 0
        self.kept_words, self.kept_bytes = kept_words, kept_bytes

    def learn(self, texts: list[list[bytes]]) -> None:
        """Lengths of all words of these texts."""
        new = list({word for words in texts for word in words if word not in self.known})
        size = sum(map(len, new))
        if len(self.known) + len(new) > self.kept_words or self.held + size > self.kept_bytes:
            self.known.clear()
            self.held = 0
            new = list({word for words in texts for word in words})
            size = sum(map(len, new))
        self.known.update(zip(new, self.encode([word.decode() for word in new])))
        self.held += size

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of every text; of a null, 0."""
        data, offsets = utf8(texts)
        if len(data) <= 2 * STRETCH:
            raw = data.tobytes()
            found = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            self.learn(found)
            return np.array([sum(map(self.known.__getitem__, words)) for words in found], np.int64)
        out = np.zeros(len(texts), np.int64)
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            for piece in stretches(data[a:b]):
                words = piece.split()
                self.learn([words])
                out[i] += sum(map(self.known.__getitem__, words))
        return out


def token_counts(docs: DataFrame, path: str, text_col: str = "text", bytes_col: str = "n_bytes", tokens_col: str = "n_tokens") -> DataFrame:
    """``docs`` without ``text_col``, with the UTF-8 bytes and the tokens of each text (both bigint).

    ``path`` names a tokenizer file that all executors can read and whose pre-tokeniser ends every match at white space, as
    those of words and of letters do. Special tokens are not added; where their strings stand in a text they count as the
    library's default has it. Nulls and empty texts have 0 bytes and 0 tokens, rows that repeat are counted each, columns
    that are already called like the new ones are replaced, no rows give no rows. A task holds a stretch of text and the
    lengths of up to ``KEPT_WORDS`` words.
    """
    kept = [c for c in docs.columns if c not in (text_col, bytes_col, tokens_col)]
    fields = {f.name: f for f in docs.schema.fields}
    schema = StructType([*(fields[c] for c in kept)]).add(bytes_col, LongType()).add(tokens_col, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in small_batches(batches, text_col, STRETCH):
            texts = batch[text_col]
            sizes = np.diff(utf8(texts)[1])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(sizes, pa.int64()), pa.array(counter.counts(texts), pa.int64())],
                                             names=[*kept, bytes_col, tokens_col])

    return docs.select(*kept, docs[text_col].cast("string").alias(text_col)).mapInArrow(run, schema)
