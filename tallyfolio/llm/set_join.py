"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and the classes they form.

Sets of x and y shingles that reach the threshold differ in at most ``H(x, y)`` shingles. Sets are put into size
bands; a pair meets in the band of its smaller set. A band hashes the universe of shingles into ``m`` segments:

* *exact* plan: ``m = H + 1 + spare`` segments, so at least ``1 + spare`` of them hold the same shingles in both sets.
* *deletion* plan: ``(H + 1) / 2`` segments, of which one differs in one shingle at most, indexed with every
  one-deletion variant.

:func:`allocate` picks the plan of each band from the number of sets in it: signatures per set against the number of
other sets that would meet it by chance. A set's signatures are dealt out by their hash. A pair shares more than ``spare``
segments, so each set leaves out as many as that: its empty ones, then those whose signatures most sets share (a passage
that is often quoted). In one order for all sets, the rarest signature that a pair shares is left out by neither.
Sets that share a signature are candidates; sketches screen them, and every link is verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfolio.llm.components import components
from tallyfolio.llm.words import mix, runs, small_batches, words
from tallyfolio.workspace import materialize

WORDS, PERCENT = 5, 80
BLOCK = 1024                    # sets of one signature that are compared at a time
SIGNATURES_A_TASK = 1_500_000
SPARES = 100                    # numbers of spare segments whose costs are compared
NEED_ROWS = 300_000             # of narrow rows that may be broadcast, counted before
LOW = np.uint64(0xFFFFFFFF)     # bands are numbered in a byte: sizes up to 1.25 ** 250


def shingle_sets(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(number of shingles of each text, all shingle hashes, sorted within their text).

    A text with fewer words has its whole sequence as its one shingle; one without words has none.
    """
    row, word = words(texts)
    counts = np.bincount(row, minlength=len(texts))
    ends = np.cumsum(counts)
    power = [np.uint64(0xD1342543DE82EF95) ** np.uint64(k) for k in range(size)]
    hashes = np.zeros(max(0, len(word) - size + 1), np.uint64)
    for k in range(size):
        hashes += word[k:k + len(hashes)] * power[k]
    hashes = mix(hashes)
    sets, sizes = [], np.zeros(len(texts), np.int64)
    for i in np.flatnonzero(counts):
        a, b = int(ends[i] - counts[i]), int(ends[i])
        if b - a < size:
            own = mix((word[a:b] * np.array(power[:b - a], np.uint64)).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            own = np.sort(hashes[a:b - size + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        sets.append(own)
        sizes[i] = len(own)
    return sizes, np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def set_keys(sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of every set; 0 for an empty one."""
    starts = np.cumsum(sizes) - sizes
    some = sizes > 0
    keys = []
    for seed in (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D):
        key = np.zeros(len(sizes), np.uint64)
        if some.any():
            key[some] = mix(np.add.reduceat(mix(hashes ^ np.uint64(seed)), starts[some]) + sizes[some].astype(np.uint64))
        keys.append(key.view(np.int64))
    return keys[0], keys[1]


def sketch(hashes: np.ndarray) -> bytes:
    """How many shingles fall into each of a power of two of buckets, one or two of them in the mean."""
    buckets = 1 << max(3, (len(hashes) // 2).bit_length())
    return np.minimum(np.bincount((hashes & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def may_share(one: np.ndarray, two: np.ndarray) -> int:
    """No two sets of these sketches share more shingles than this."""
    least = min(len(one), len(two))
    one, two = (x.astype(np.int64).reshape(-1, least).sum(axis=0) for x in (one, two))
    return int(np.minimum(one, two).sum())


def differ(x: int, y: int, percent: int) -> int:
    """Most shingles in which linked sets of these sizes differ."""
    return (x + y) * (100 - percent) // (100 + percent)


def band_edges(most: int, percent: int) -> list[int]:
    """Sizes at which bands begin, so that linked sets are in one band or in neighbouring ones."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, edges[-1] * 100 // percent))
    return edges


def more_than(limit: int, mean: float) -> float:
    """Chance that a Poisson number exceeds ``limit``, added up in logarithms so that any mean can be taken."""
    if mean <= 0:
        return 0.0
    wide = 40 * math.sqrt(mean) + 40
    k = np.arange(max(0, int(mean - wide)), min(limit, int(mean + wide)) + 1)      # the terms beyond are below 1e-200
    if not len(k):
        return 1.0
    first = k[0] * math.log(mean) - mean - math.lgamma(k[0] + 1)
    logs = first + np.append(0.0, np.cumsum(math.log(mean) - np.log(k[1:])))
    return min(1.0, max(0.0, 1 - float(np.exp(logs).sum())))


def allocate(low: int, high: int, sets: int, percent: int) -> tuple[int, int, int] | None:
    """(segments, spare, deletions 0 or 1) for a band of sizes low to high; None where only equal sets are linked."""
    h = differ(high, high * 100 // percent, percent)
    if h == 0:
        return None
    size = (low + high) / 2
    plans = []
    spares = range(max(1, (h + 1) // 5), 6 + h // 3)
    for spare in spares[::len(spares) // SPARES + 1]:       # any number of spare segments finds all; it only sets the cost
        m = h + 1 + spare
        over = more_than(spare, m * math.exp(-size / m))
        plans.append((m + sets * over ** 2, m, spare, 0))
    m = (h + 2) // 2
    alike = (math.exp(-size / m) * (1 + size / m)) ** 2 if m > 1 else 0.0
    plans.append((m + size + sets * m * alike, m, 0, 1))
    return min(plans)[1:]


def signatures(sizes: np.ndarray, hashes: np.ndarray, edges: list[int], plans: list,
               percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the set, signature, band, segments the set can still skip there) for the sets of one batch."""
    band = np.searchsorted(edges, sizes, side="right") - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    spread = mix(hashes ^ np.uint64(0x9E6C63D0876A9A47))
    low, high = (spread & LOW).astype(np.float64), (spread >> np.uint64(32)).astype(np.float64)
    largest = np.array([e - 1 for e in edges[1:]] + [0])
    table = np.array([p or (0, 0, 0) for p in plans] + [(0, 0, 0)], np.int64)
    found = []
    for back in (0, 1):                       # its own band, and the one below if a partner there can be near enough
        use = band - back
        at = np.clip(use, 0, len(plans))
        ok = (sizes > 0) & (use >= 0) & ((back == 0) | (sizes * percent <= 100 * largest[at]))
        m, spare, deletion = np.where(ok[:, None], table[at], 0).T
        base = np.cumsum(m) - m
        total = int(m.sum())
        if not total:
            continue
        mine = m[owner] > 0
        who = owner[mine]
        segment = base[who] + (((hashes[mine] >> np.uint64(32)) * m[who].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        a, b = np.bincount(segment, low[mine], total), np.bincount(segment, high[mine], total)
        full = np.bincount(segment, minlength=total) > 0
        holder = np.repeat(np.arange(len(sizes)), m)
        number = np.arange(total) - base[holder]
        tag = mix((use[holder] * 1_000_003 + number).astype(np.uint64) + np.uint64(77))

        def hashed(x, y, t):
            return mix(x.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + y.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB) + t)

        slack = np.where(deletion == 1, -1, spare - np.bincount(holder, ~full, len(sizes)))
        keep = full | (slack[holder] < 0)
        found.append((holder[keep], hashed(a[keep], b[keep], tag[keep])))
        gone = deletion[who] == 1
        s = segment[gone]
        found.append((who[gone], hashed(a[s] - low[mine][gone], b[s] - high[mine][gone], tag[s])))
        found[-2:] = [(w, x, use[w], slack[w]) for w, x in found[-2:]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _sets(size: int) -> Callable:
    """Id, size, keys and sketch of every set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sizes, hashes = shingle_sets(batch["text"], size)
            one, two = set_keys(sizes, hashes)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_pydict({
                "id": batch["id"], "n": sizes, "key": one, "key2": two,
                "value": pa.array([sketch(hashes[e - n:e]) for e, n in zip(ends, sizes)], pa.binary())})
    return run


def _deal(size: int, percent: int, edges: list[int], plans: list, parts: int) -> Callable:
    """Signatures with the keys, bands and slack of their sets, by part."""
    kinds = (("sigs", np.uint64), ("keys", np.int64), ("bands", np.uint8), ("slack", np.int8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out():
            columns = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            part = (columns[0] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at, n = runs(part[order])
            cut = [order[a:a + b] for a, b in zip(at, n)]
            return pa.RecordBatch.from_pydict({"part": part[order[at]]} | {
                name: pa.array([column[c].tobytes() for c in cut], pa.binary()) for (name, _), column in zip(kinds, columns)})

        for batch in small_batches(batches, "text"):
            sizes, hashes = shingle_sets(batch["text"], size)
            key, _ = set_keys(sizes, hashes)
            first = np.zeros(len(key), bool)
            first[np.unique(key, return_index=True)[1]] = True      # a copy adds nothing
            who, sig, band, slack = signatures(np.where(first, sizes, 0), hashes[np.repeat(first, sizes)], edges, plans, percent)
            if len(sig):
                held.append((sig, key[who], band.astype(np.uint8), np.clip(slack, -1, 127).astype(np.int8)))
            if sum(len(x[0]) for x in held) > 1_000_000:
                yield out()
        if held:
            yield out()
    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every signature that two or more sets of this part share, with the number of its sets."""
    columns: list[list] = [[], [], [], []]
    for batch in batches:
        for held, name, kind in zip(columns, ("sigs", "keys", "bands", "slack"), (np.uint64, np.int64, np.uint8, np.int8)):
            held += [np.frombuffer(x.as_buffer(), kind) for x in batch[name]]
    if not columns[0]:
        return
    sig, key, band, slack = (np.concatenate(x) for x in columns)
    columns.clear()
    order = np.argsort(sig)
    at, n = runs(sig[order])
    order = order[np.repeat(n > 1, n)]
    order = order[np.lexsort((key[order], sig[order]))]
    new = np.append(True, (np.diff(sig[order].view(np.int64)) != 0) | (np.diff(key[order]) != 0))[:len(order)]
    order = order[new]
    at, n = runs(sig[order])
    sets = np.repeat(n, n)
    order, sets = order[sets > 1], sets[sets > 1]
    for i in range(0, len(order), 100_000):
        o = order[i:i + 100_000]
        yield pa.RecordBatch.from_pydict({"sig": sig[o].view(np.int64), "key": key[o], "band": band[o].astype(np.int32),
                                          "slack": slack[o].astype(np.int32), "sets": sets[i:i + 100_000]})


def _compare(fits: Callable, prepare: Callable) -> Callable:
    """The pairs (a, b) that fit, where the row of a itself comes before those of its partners."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, None
        for batch in batches:
            for part, values in prepare(batch):
                links = []
                for a, b, mine in zip(part["a"].to_pylist(), part["b"].to_pylist(), values):
                    if a == b:
                        lead, own = a, mine
                    elif a != lead:
                        raise ValueError("a pair came without its first set")
                    elif fits(own, mine):
                        links.append((a, b))
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})
    return run


def _screen(percent: int) -> Callable:
    def fits(one: tuple, two: tuple) -> bool:
        if one[1].max() == 255 or two[1].max() == 255:
            return True
        shared = may_share(one[1], two[1])
        return 100 * shared >= percent * (one[0] + two[0] - shared)

    def prepare(batch: pa.RecordBatch) -> Iterator[tuple]:
        yield batch, [(n, np.frombuffer(x.as_buffer(), np.uint8)) for n, x in zip(batch["n"].to_pylist(), batch["value"])]
    return _compare(fits, prepare)


def _shared_at_most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of bucket counts: no two of their sets share more shingles than this."""
    if len(a) * len(b) * a.shape[1] <= 1 << 21:
        return np.minimum(a[:, None, :], b[None, :, :]).sum(axis=2, dtype=np.int64)
    out = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        out += np.minimum(a[:, k, None], b[None, :, k])
    return out


def _cells(percent: int) -> Callable:
    """Pairs of different classes in each cell (sig, i, j) that may be linked; rows are sorted by cell."""
    def compare(rows: list) -> tuple[np.ndarray, np.ndarray]:
        ids, group, block, n = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2, 4))
        main = np.array([r[3] for r in rows], bool)
        raw = [np.frombuffer(r[5], np.uint8) for r in rows]
        least = min(map(len, raw))
        counts = np.stack([x.astype(np.uint16).reshape(-1, least).sum(axis=0, dtype=np.uint16) for x in raw])
        sure = np.array([x.max() == 255 for x in raw])
        one = np.flatnonzero(~main)                  # pairs inside the largest class need no look
        shared = _shared_at_most(counts[one], counts)
        fits = 100 * shared >= percent * (n[one, None] + n[None, :] - shared)
        fits |= sure[one, None] | sure[None, :]
        fits &= group[one, None] != group[None, :]
        if (block != block[0]).any():
            fits &= block[one, None] != block[None, :]
        a, b = np.nonzero(fits)
        return np.minimum(ids[one[a]], ids[b]), np.maximum(ids[one[a]], ids[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, found = None, [], []

        def out() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate([np.stack(f) for f in found], axis=1), axis=1)
            found.clear()
            return pa.RecordBatch.from_pydict({"a": pairs[0], "b": pairs[1]})

        for batch in batches:
            for sig, i, j, *row in zip(*[batch[c].to_pylist() for c in ("sig", "i", "j", "rid", "class", "block", "main", "n", "value")]):
                if (sig, i, j) != last:
                    if held:
                        found.append(compare(held))
                    if sum(len(f[0]) for f in found) > 100_000 or len(found) > 20_000:
                        yield out()
                    last, held = (sig, i, j), []
                held.append(row)
        if held:
            found.append(compare(held))
        if found:
            yield out()
    return run


def _verify(size: int, percent: int) -> Callable:
    def fits(one: np.ndarray, two: np.ndarray) -> bool:
        both = np.sort(np.concatenate([one, two]))
        shared = int((both[1:] == both[:-1]).sum())
        return 100 * shared >= percent * (len(both) - shared)

    def prepare(batch: pa.RecordBatch) -> Iterator[tuple]:
        for part in small_batches([batch], "value"):
            sizes, hashes = shingle_sets(part["value"], size)
            ends = np.cumsum(sizes)
            yield part, [hashes[e - n:e] for e, n in zip(ends, sizes)]
    return _compare(fits, prepare)


def _checked(pairs: DataFrame, values: DataFrame, columns: list[str], check: Callable, a_task: int) -> DataFrame:
    """The pairs (a, b) of ids whose values pass ``check``.

    The value of a is sent once to each task that compares its partners; a with very many partners gets several
    tasks. The narrow rows that say who needs which value are broadcast if a count shows that they are few.
    """
    split = pairs.groupBy("a").agg(F.ceil(F.count("*") / 4096).cast("int").alias("salts"))
    salted = pairs.join(split, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    lead = split.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    need = materialize(salted.unionAll(lead).withColumnRenamed("b", "id"), "need")
    rows = need.count()
    side = F.broadcast(need) if rows <= NEED_ROWS else need
    spark = pairs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // a_task + 1)
    return (values.join(side, "id").select("a", F.col("id").alias("b"), "salt", *columns)
            .repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("a") != F.col("b"))
            .select("a", "b", *columns).mapInArrow(check, "a bigint, b bigint"))


def verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose sets reach the threshold, written down.

    Sketches bound from above what two sets can share; the texts of the pairs that are left are compared exactly.
    """
    near = materialize(_checked(pairs, sketches, ["n", "value"], _screen(percent), 100_000), "near")
    return materialize(_checked(near, texts.withColumnRenamed("text", "value"), ["value"], _verify(size, percent), 10_000), "links")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS,
                    percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every document; ``id_col`` is a unique bigint.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|``; ``component_id`` is the smallest id that links
    reach, the own one included. Documents with a null id are left out; null and empty texts have no shingles and are
    linked with nothing; rows that repeat an id are returned as often as they occur. No rows give no rows.

    Equal sets are one set from the start. In a first round every set of a signature is compared with the
    smallest one only; this already ties most groups of near copies together. The second round compares, in signatures
    that still hold several classes, the sets outside the largest class with all sets of other classes: by sketch, in blocks
    inside a task, so that only pairs that may be linked become rows. No link between classes is missed.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = materialize(texts.mapInArrow(_sets(size), "id bigint, n bigint, key bigint, key2 bigint, value binary"), "sets")
    sets, sketches = found.select("id", "n", "key", "key2"), found.select("id", "n", "value")
    reps = materialize(sets.where("n > 0").groupBy("key", "key2", "n").agg(F.min("id").alias("rid")), "reps")
    totals = reps.agg(F.max("n"), F.sum("n")).first()
    edges = band_edges(int(totals[0] or 0), percent)
    where = F.expr(f"array({','.join(map(str, edges))})")
    band = F.size(F.filter(where, lambda e: e <= F.col("n"))) - 1
    counts = {r.band: r["count"] for r in reps.groupBy(band.alias("band")).count().collect()}     # a row for each band
    plans = [allocate(a, b - 1, counts.get(i, 0) + counts.get(i + 1, 0), percent) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((totals[1] or 0) * 0.6) // SIGNATURES_A_TASK + 1)
    dealt = texts.mapInArrow(_deal(size, percent, edges, plans, 8 * tasks), "part bigint, sigs binary, keys binary, bands binary, slack binary")
    shared = materialize(dealt.repartition(tasks, "part").mapInArrow(_meet, "sig bigint, key bigint, band int, slack int, sets bigint"), "shared")
    rank = F.row_number().over(Window.partitionBy("key", "band").orderBy(F.desc("sets"), "sig"))      # at most one row for each segment
    use = shared.withColumn("rank", rank).where("rank > slack")
    met = materialize(use.join(reps.select("key", "rid"), "key").select("sig", "rid"), "met")
    first = met.groupBy("sig").agg(F.min("rid").alias("a"))
    pairs = materialize(met.join(first, "sig").where("rid <> a").select("a", F.col("rid").alias("b")).distinct(), "pairs")
    links = verified(pairs, sketches, texts, size, percent)
    known = components(links)
    state = materialize(met.join(known, met.rid == known.id, "left")
                        .select("sig", "rid", F.coalesce("component", "rid").alias("class")), "state")
    sizes = state.groupBy("sig", "class").count()
    open_ = sizes.groupBy("sig").agg(F.count("*").alias("classes"), F.ceil(F.sum("count") / BLOCK).cast("int").alias("blocks"),
                                     F.max_by("class", F.struct("count", "class")).alias("largest")).where("classes > 1")
    block = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    still = (state.join(open_, "sig").select("sig", "rid", "class", (F.col("class") == F.col("largest")).alias("main"), block.alias("block"),
                                             F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")))
    still = still.join(sketches.withColumnRenamed("id", "rid"), "rid").select(
        "sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rid", "class", F.col("block").cast("bigint").alias("block"), "main", "n", "value")
    more = (still.repartition(tasks, "sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(_cells(percent), "a bigint, b bigint")
            .distinct().join(pairs, ["a", "b"], "left_anti"))
    links = links.unionAll(verified(materialize(more, "pairs"), sketches, texts, size, percent))
    known = components(links)
    joined = sets.join(reps, ["key", "key2", "n"], "left").join(known.withColumnRenamed("id", "rid"), "rid", "left")
    return joined.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rid", "id").alias("component_id"))
