"""SentencePiece encoding and decoding of whole columns with numpy.

Texts are cut into units (spaces and what follows them); no piece reaches across units, so the different units of a batch are
encoded once each, and units of equal length advance together. Pieces are found by probing sorted keys with polynomial
hashes of substrings. A unigram model takes the best segmentation by Viterbi, with vectorised maxima and backpointers.
A model of merges is not a best segmentation: there the same batches repeat the merge of the best pair instead.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallyfolio.llm.words import STEP, mix, powers, small_batches, utf8, with_column

SPACE = 0x2581              # the visible sign for a space inside pieces
LONG = 64                   # longer units are merged one by one
UNKNOWN_COST = 10.0         # below the least score of a piece


def code_hash(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(1))


class Pieces:
    """Sorted keys, scores and bytes of a vocabulary; ``kind`` is ``unigram`` or ``merges``."""

    def __init__(self, pieces: list[str], scores: list[float], kind: str, special: dict[int, bytes], unknown: int) -> None:
        self.kind, self.unknown = kind, unknown
        usable = [i for i in range(len(pieces)) if i not in special and i != unknown]
        self.most = max((len(pieces[i]) for i in usable), default=1)
        keys = np.array([self.key(pieces[i]) for i in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable, np.int64)[order]
        self.scores = np.array([scores[i] for i in usable])[order]
        self.worst = (self.scores.min() if len(usable) else 0.0) - UNKNOWN_COST
        self.by_text = {pieces[i]: i for i in usable}
        self.all_scores = scores
        self.byte_ids = np.full(256, -1, np.int64)
        for i, raw in special.items():
            if len(raw) == 1:
                self.byte_ids[raw[0]] = i
        self.out = [special.get(i, p.replace(chr(SPACE), " ").encode()) for i, p in enumerate(pieces)]
        self.out[unknown] = " ⁇ ".encode()

    @staticmethod
    def key(piece: str) -> int:
        codes = code_hash(np.array([ord(c) for c in piece]))
        return int((codes * powers(len(codes))[::-1]).sum(dtype=np.uint64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place in the sorted keys, or -1."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    @staticmethod
    def prefixes(codes: np.ndarray) -> np.ndarray:
        """Hashes of the beginnings of each row, of length 0 to all."""
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        hashed = code_hash(codes)
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * STEP + hashed[:, i]
        return out

    def viterbi(self, codes: np.ndarray) -> np.ndarray:
        """Lengths of the pieces that end at each place of the best segmentation of each row; 0 elsewhere."""
        n, length = codes.shape
        power, prefix = powers(length + 1), self.prefixes(codes)
        best, back = np.full((n, length + 1), -np.inf), np.zeros((n, length + 1), np.int64)
        best[:, 0] = 0
        for end in range(1, length + 1):
            sizes = np.arange(1, min(self.most, end) + 1)
            at = self.find(prefix[:, end, None] - prefix[:, end - sizes] * power[sizes])
            score = np.where(at >= 0, self.scores[at], -np.inf)
            score[:, 0] = np.where(at[:, 0] >= 0, score[:, 0], self.worst)
            total = best[:, end - sizes] + score
            take = total.argmax(axis=1)
            best[:, end], back[:, end] = total[np.arange(n), take], sizes[take]
        out, place = np.zeros((n, length), np.int64), np.full(n, length)
        while (place > 0).any():
            rows = np.flatnonzero(place > 0)
            size = back[rows, place[rows]]
            out[rows, place[rows] - 1] = size
            place[rows] -= size
        return out

    def merges(self, codes: np.ndarray) -> np.ndarray:
        """As ``viterbi``, for the pieces left when the best pair, of equals the leftmost, is merged until none is."""
        n, length = codes.shape
        power = powers(length + 1)
        key, size = code_hash(codes), np.ones((n, length), np.int64)
        out = np.zeros((n, length), np.int64)

        def ranks(k, s):
            at = self.find(k[:, :-1] * power[s[:, 1:]] + k[:, 1:])
            return np.where(at >= 0, self.scores[at], -np.inf)

        live = np.arange(n)
        score = ranks(key, size) if length > 1 else np.full((n, 0), -np.inf)
        while len(live):
            best = score.argmax(axis=1) if score.shape[1] else np.zeros(len(live), np.int64)
            go = (score[np.arange(len(live)), best] > -np.inf) if score.shape[1] else np.zeros(len(live), bool)
            done = np.flatnonzero(~go)
            out[live[done, None], np.cumsum(size[done], axis=1) - 1] = size[done]
            key, size, score, live, best = (x[go] for x in (key, size, score, live, best))
            if not len(live):
                break
            r = np.arange(len(live))
            key[r, best] = key[r, best] * power[size[r, best + 1]] + key[r, best + 1]
            size[r, best] += size[r, best + 1]
            width = key.shape[1]
            source = np.arange(width - 1) + (np.arange(width - 1) > best[:, None])
            key, size = key[r[:, None], source], size[r[:, None], source]
            kept = np.arange(width - 2) + (np.arange(width - 2) >= best[:, None])
            score = score[r[:, None], kept]
            for shift in (-1, 0):                   # only the pairs beside the merged piece change
                at = best + shift
                ok = np.flatnonzero((at >= 0) & (at < width - 2))
                a = at[ok]
                found = self.find(key[ok, a] * power[size[ok, a + 1]] + key[ok, a + 1])
                score[ok, a] = np.where(found >= 0, self.scores[found], -np.inf)
        return out

    def merge_long(self, unit: str) -> list[int]:
        """Lengths of the pieces of one unit by merges from a heap, for units of any length."""
        size, left, right = [1] * len(unit), list(range(-1, len(unit) - 1)), list(range(1, len(unit) + 1))
        heap: list = []

        def offer(a: int) -> None:
            b = right[a] if a >= 0 else len(unit)
            if b < len(unit) and (found := self.by_text.get(unit[a:b + size[b]])) is not None:
                heapq.heappush(heap, (-self.all_scores[found], a, size[a], size[b]))

        for a in range(len(unit) - 1):
            offer(a)
        while heap:
            _, a, n, m = heapq.heappop(heap)
            if size[a] != n or not n or right[a] >= len(unit) or size[right[a]] != m:
                continue
            b = right[a]
            size[a], size[b], right[a] = n + m, 0, right[b]
            if right[b] < len(unit):
                left[right[b]] = a
            offer(left[a])
            offer(a)
        return [n for n in size if n]

    def spelled(self, unit: str, sizes: list[int]) -> bytes:
        """Ids of a unit cut into pieces of these lengths; what is no piece becomes its bytes, or the unknown id."""
        ids, at = [], 0
        for n in sizes:
            known = self.by_text.get(unit[at:at + n])
            raw = [] if known is not None else self.byte_ids[list(unit[at:at + n].encode())]
            ids.extend([known] if known is not None else raw.tolist() if (raw >= 0).all() else [self.unknown])
            at += n
        return np.array(ids, "<u4").tobytes()

    def unit_ids(self, units: list[str]) -> list[bytes]:
        """Ids of every unit, little-endian unsigned 32-bit."""
        lengths = np.array([len(u) for u in units])
        out: list = [b""] * len(units)
        for length in np.unique(lengths[lengths > 0]):
            where = np.flatnonzero(lengths == length)
            if self.kind == "merges" and length > LONG:
                for i in where:
                    out[i] = self.spelled(units[i], self.merge_long(units[i]))
                continue
            for a in range(0, len(where), 1 + (1 << 20) // int(length)):
                some = where[a:a + 1 + (1 << 20) // int(length)].tolist()
                codes = np.frombuffer("".join([units[i] for i in some]).encode("utf-32-le"), "<u4").reshape(len(some), -1)
                ends = self.viterbi(codes) if self.kind == "unigram" else self.merges(codes)
                row, end = np.nonzero(ends)
                size = ends[row, end]
                prefix, power = self.prefixes(codes), powers(length + 1)
                at = self.find(prefix[row, end + 1] - prefix[row, end + 1 - size] * power[size])
                flat = self.ids[at].astype("<u4").tobytes()
                places = (np.cumsum(np.bincount(row, minlength=len(some))) * 4).tolist()
                odd = set(row[at < 0].tolist())
                for k, (i, b, e) in enumerate(zip(some, [0, *places], places)):
                    out[i] = flat[b:e] if k not in odd else self.spelled(units[i], ends[k][ends[k] > 0].tolist())
        return out


@lru_cache(2)
def load(path: str, kind: str) -> Pieces:
    """The vocabulary of a model file (read with its own library; its segmentation is not used)."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    special = {i: b"" for i in range(size) if model.is_control(i) or model.is_unused(i)}
    special |= {i: bytes([int(model.id_to_piece(i)[3:5], 16)]) for i in range(size) if model.is_byte(i)}
    return Pieces([model.id_to_piece(i) for i in range(size)], [model.get_score(i) for i in range(size)], kind, special, model.unk_id())


class Encoder:
    """Ids of texts; units met before are kept, up to ``most`` of them."""

    def __init__(self, pieces: Pieces, most: int = 300_000) -> None:
        self.pieces, self.most, self.known = pieces, most, {}

    @staticmethod
    def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of every unit, and whether a space has to be put before it.

        Units begin with each text, with the first of several spaces, and before and after control signs (9 to 13).
        """
        space, control = data == 0x20, (data >= 9) & (data <= 13)
        first = np.zeros(len(data) + 1, bool)
        first[:-1] = space | control
        first[1:-1] &= ~(space[:-1] & space[1:])
        first[1:] |= control
        text = np.zeros(len(data) + 1, bool)
        text[offsets[:-1]] = True
        first |= text
        first[len(data)] = False
        starts = np.flatnonzero(first)
        return starts, text[starts]

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        data, offsets = utf8(pc.replace_substring(texts, chr(SPACE), " "))      # the model takes them for the same
        starts, lead = self.cut(data, offsets)
        raw = data.tobytes()
        ends = np.append(starts[1:], len(data))
        units = [raw[a:b] if not f else b" " + raw[a:b] for a, b, f in zip(starts.tolist(), ends.tolist(), lead.tolist())]
        new = list({u for u in units if u not in self.known})
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(set(units))
        forms = [u.decode().replace(" ", chr(SPACE)) for u in new]
        self.known.update(zip(new, self.pieces.unit_ids(forms)))
        parts = [self.known[u] for u in units]
        edges = np.searchsorted(starts, offsets)
        return [b"".join(parts[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def decode_ids(pieces: Pieces, ids: bytes) -> str:
    """The text of ids; the space put before it by the encoder is taken away, broken UTF-8 becomes U+FFFD."""
    out = b"".join([pieces.out[i] for i in np.frombuffer(ids, "<u4").tolist()])
    return (out[1:] if out[:1] == b" " else out).decode(errors="replace")


def encode_column(docs: DataFrame, path: str, text_col: str = "text", kind: str = "merges", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: binary, little-endian unsigned 32-bit ids; null and empty texts have no ids.

    ``path`` names a model file that all executors can read. Signs that are in no piece become byte pieces, or the unknown
    id where the model has none. A column that is already called ``ids_col`` is replaced.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load(path, kind))
        for batch in small_batches(batches, text_col):
            yield batch.append_column(ids_col, pa.array(encoder.ids(batch[text_col]), pa.binary()))

    rest = docs.drop(ids_col)
    return rest.mapInArrow(run, with_column(rest, ids_col, "binary"))


def round_trip_column(docs: DataFrame, path: str, text_col: str = "text", kind: str = "merges", ids_col: str = "ids",
                      decoded_col: str = "decoded") -> DataFrame:
    """As ``encode_column`` and then ``decode_column``, in one Python worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path, kind)
        encoder = Encoder(pieces)
        for batch in small_batches(batches, text_col, 1 << 20):
            ids = encoder.ids(batch[text_col])
            texts = [decode_ids(pieces, x) for x in ids]
            yield batch.append_column(ids_col, pa.array(ids, pa.binary())).append_column(decoded_col, pa.array(texts, pa.string()))

    rest = docs.drop(ids_col, decoded_col)
    schema = with_column(rest, ids_col, "binary").add(decoded_col, "string")
    return rest.mapInArrow(run, schema)


def decode_column(docs: DataFrame, path: str, ids_col: str = "ids", kind: str = "merges", text_col: str = "decoded") -> DataFrame:
    """``docs`` with ``text_col``, the text of the ids; null stays null. A column that is already called so is replaced."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path, kind)
        for batch in batches:
            texts = [None if x.as_py() is None else decode_ids(pieces, x.as_py()) for x in batch[ids_col]]
            yield batch.append_column(text_col, pa.array(texts, pa.string()))

    rest = docs.drop(text_col)
    return rest.mapInArrow(run, with_column(rest, text_col, "string"))
