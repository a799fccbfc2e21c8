"""Line dedup: of lines that are equal or a few edits apart only the first stays, in DataFrame functions alone.

Equal lines meet by hash. Near lines are found by a segment-partition join: a line of length ``l`` is cut into ``t + 1``
segments, of which one is whole in any line within ``t`` edits. Every segment is indexed under its length, number and text;
longer lines probe, for each length down to ``t`` less, just those substrings that a segment could have moved to. Lines that
share one, and whose counts of common letters do not already rule it out, are verified by the banded bit-parallel edit
distance: the band of ``2 t + 1`` diagonals is the bits of one integer, and one step of additions and shifts takes it
across a sign of the longer line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfolio.llm.components import components
from tallyfolio.workspace import fits_broadcast, materialize

LETTERS = "etaoinshrdlucmgb0123456789"      # counted to rule pairs out; the answer does not depend on the choice
EXACT_CHARS, NEAR_CHARS, WIDE_CHARS = 10, 24, 48
COMMON = 10_000         # a line with more than one in so many of all occurrences is called common
GONE_ID, GONE = "__id_with_repeated_lines__", "__repeated_lines__"     # joined to the columns of documents
FEW_ROWS, FEW_BYTES = 400_000, 48 << 20


def edits(length: Column) -> Column:
    """Edits allowed between lines of which the shorter has this length."""
    return F.when(length >= WIDE_CHARS, 2).when(length >= NEAR_CHARS, 1)


def banded_distance(long: Column, short: Column, most: int) -> Column:
    """Edit distance of two texts at most ``most`` apart in length, exact up to ``most``; larger values mean more.

    Bit ``k`` of the band in column ``j`` stands for row ``j - most + k``. ``vp`` and ``vn`` say where the distance
    rises and falls from one row to the next; the distance grows by one in each column whose diagonal bit is 0.
    """
    width = 2 * most + 1
    full = F.lit((1 << width) - 1).cast("bigint")
    gap = F.length(long) - F.length(short)

    def let(value: Column, use) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)

    def inverse(x: Column) -> Column:
        return x.bitwiseXOR(full)

    def across(signs: Column) -> Column:
        a, b = signs["a"], signs["b"]

        def step(s: Column, j: Column) -> Column:
            x = F.lit(0).cast("bigint")
            for k in range(width):
                same = F.coalesce(F.get(a, j - most + k - 1) == F.element_at(b, j), F.lit(False))
                x = x + F.when(same, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
            vp, vn = s["vp"], s["vn"]

            def moved(row: Column) -> Column:
                d, hp, hn = row["d"], row["hp"], row["hn"]
                down = F.shiftright(d, 1)
                return F.struct(hn.bitwiseOR(inverse(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"),
                                (s["far"] + 1 - F.bit_get(d, F.greatest(F.lit(0), most - gap))).alias("far"))

            def crossed(x: Column) -> Column:
                d = (x.bitwiseAND(vp) + vp).bitwiseAND(full).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn)
                return let(d, lambda d: let(F.struct(d.alias("d"), vn.bitwiseOR(inverse(d.bitwiseOR(vp))).alias("hp"), d.bitwiseAND(vp).alias("hn")), moved))

            return let(x, crossed)

        start = F.struct(F.lit(((1 << most + 1) - 1) << most).cast("bigint").alias("vp"), F.lit(0).cast("bigint").alias("vn"), F.lit(0).cast("bigint").alias("far"))
        return F.aggregate(F.sequence(F.lit(1), F.size(b)), start, step)["far"]

    # bound once: an expression inside a lambda is evaluated in every step
    return let(F.struct(F.split(short, "").alias("a"), F.split(long, "").alias("b")), across)


def segment(length: Column, i: int, t: int) -> tuple[Column, Column]:
    """(start from 1, length) of segment ``i`` of ``t + 1``; the last ones are longer by one where it does not go evenly."""
    base, more = F.floor(length / (t + 1)).cast("int"), (length % (t + 1)).cast("int")
    short = t + 1 - more
    size = base + F.when(F.lit(i) > short, 1).otherwise(0)
    return base * (i - 1) + F.greatest(F.lit(0), F.lit(i - 1) - short) + 1, size


def part_key(wide: Column, length: Column, i: int, at: Column, size: Column) -> Column:
    """Hash of the length of an indexed line, the number of a segment and its signs (of four bytes each)."""
    return F.xxhash64(length, F.lit(i), F.substr(wide, at * 4 - 3, size * 4))


def indexed(wide: Column, length: Column, t: int) -> list[Column]:
    return [part_key(wide, length, i, *segment(length, i, t)) for i in range(1, t + 2)]


def probes(wide: Column, length: Column, t: int, sure: bool = False) -> list[Column]:
    """Keys of the substrings under which a line of at most this length and within ``t`` edits may be indexed.

    A line of the shorter length has its own number of edits; ``sure`` says that it is ``t`` for all of them.
    """
    keys = []
    for less in range(t + 1):
        other = length - less
        for i in range(1, t + 2):
            at, size = segment(other, i, t)
            for move in range(max(1 - i, less - (t + 1 - i)), min(i - 1, less + t + 1 - i) + 1):
                key = part_key(wide, other, i, at + move, size)
                keys.append(key if sure else F.when(edits(other) == t, key))
    return keys


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, place, line): the trimmed lines of every text."""
    cut = F.split(F.col(text_col).cast("string"), "\n")
    return (docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.posexplode(cut).alias("place", "line"))
            .withColumn("line", F.btrim("line", F.lit(" \t\r"))))


def matched_parts(lines: DataFrame, common: DataFrame) -> DataFrame:
    """(indexed, key, part): index entries that another line probes, and probes that meet the entry of another line.

    ``common`` are the hashes of the lines that occur very often (at most COMMON of them) and their first document; other occurrences are
    left out here, so that no key is held by copies of one line alone. No pairs are made.
    """
    long_ = lines.withColumn("length", F.length("line")).where(F.col("length") >= NEAR_CHARS)
    one_each = (long_.withColumn("key", F.xxhash64("line")).join(F.broadcast(common), "key", "left")
                .where(F.coalesce(F.col("owner") == F.col("id"), F.lit(True))).select("key", "line", "length"))
    one_each = one_each.select("key", F.encode("line", "UTF-32").alias("wide"), "length")      # signs of equal width
    wide, length = F.col("wide"), F.col("length")
    by_edits = F.when(edits(length) == 2, F.array(*indexed(wide, length, 2))).otherwise(F.array(*indexed(wide, length, 1)))
    asked = (F.when(length >= WIDE_CHARS + 2, F.array(*probes(wide, length, 2, True)))
             .when((length < WIDE_CHARS) & (length > NEAR_CHARS), F.array(*probes(wide, length, 1, True)))
             .otherwise(F.array(*probes(wide, length, 1), *probes(wide, length, 2))))
    index = one_each.select("key", F.explode(by_edits).alias("part"))
    # Both joins read one shuffle of the probes: without a function of a lambda and a renamed column their plans are the same.
    probe = one_each.select("key", F.explode(asked).alias("part")).where("part IS NOT NULL")
    meets = (F.col("i.part") == F.col("p.part")) & (F.col("i.key") != F.col("p.key"))
    entries = index.alias("i").join(probe.alias("p").hint("merge"), meets, "left_semi")
    questions = probe.alias("p").join(index.alias("i").hint("merge"), meets, "left_semi")
    return (entries.select(F.lit(True).alias("indexed"), "key", "part")
            .unionAll(questions.select(F.lit(False), "key", "part")).distinct())


def letter_counts(line: Column) -> list[Column]:
    return [(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).alias(f"n_{c}") for c in LETTERS]


def common_prefix(x: Column, y: Column) -> Column:
    """How many signs two texts begin with alike, by halving."""
    most = F.least(F.length(x), F.length(y))
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda p, k: F.when((p + k <= most) & (F.substr(x, p + 1, k) == F.substr(y, p + 1, k)), p + k).otherwise(p))


def near_links(lines: DataFrame, common: DataFrame) -> DataFrame:
    """Links (a, b) between the hashes of different lines few enough edits apart.

    Pairs are made only where the lengths and the counts of letters allow a link: an edit changes the counts by two together
    at most. What two lines begin and end with alike is cut off before the distance is taken.
    """
    matched = materialize(matched_parts(lines, common), "matched")
    keys = materialize(matched.select("key").distinct(), "keys")
    side = F.broadcast(keys) if fits_broadcast(keys, FEW_ROWS, FEW_BYTES) else keys
    texts = lines.withColumn("key", F.xxhash64("line")).join(side, "key", "left_semi").select("key", "line").distinct()
    texts = materialize(texts.select("key", "line", F.length("line").alias("length"), *letter_counts(F.col("line"))), "texts")
    counts = ["length", *(f"n_{c}" for c in LETTERS)]
    one = matched.where("indexed").join(texts, "key").select("part", F.col("key").alias("a"), *[F.col(c).alias(f"a_{c}") for c in counts])
    two = matched.where("NOT indexed").join(texts, "key").select("part", F.col("key").alias("b"), *[F.col(c).alias(f"b_{c}") for c in counts])
    apart = sum((F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in counts[1:]), F.lit(0))
    allowed = edits(F.least("a_length", "b_length"))
    gap = F.abs(F.col("a_length") - F.col("b_length"))
    near = (one.alias("x").join(two.alias("y"), (F.col("x.part") == F.col("y.part")) & (F.col("a") != F.col("b")) & (gap <= allowed) & (apart <= 2 * allowed))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    near = materialize(near.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b"), "near")
    both = (near.join(texts.select(F.col("key").alias("a"), F.col("line").alias("x")), "a")
            .join(texts.select(F.col("key").alias("b"), F.col("line").alias("y")), "b"))
    longer = F.length("x") >= F.length("y")
    both = both.select("a", "b", F.when(longer, F.col("x")).otherwise(F.col("y")).alias("long"), F.when(longer, F.col("y")).otherwise(F.col("x")).alias("short"))
    both = both.withColumn("allowed", edits(F.length("short"))).withColumn("p", common_prefix(F.col("long"), F.col("short")))
    both = both.select("a", "b", "allowed", *[F.reverse(F.substring(F.col(c), F.col("p") + 1, F.length(c))).alias(c) for c in ("long", "short")])
    both = both.withColumn("p", common_prefix(F.col("long"), F.col("short")))
    both = both.select("a", "b", "allowed", *[F.substring(F.col(c), F.col("p") + 1, F.length(c)).alias(c) for c in ("long", "short")])
    parts = both.sparkSession.conf.get("spark.sql.shuffle.partitions")
    cut = materialize(both.repartition(int(parts), "a", "b"), "cut")
    long, short = F.col("long"), F.col("short")
    distance = F.when(long == "", 0).when(F.col("allowed") == 2, banded_distance(long, short, 2)).otherwise(banded_distance(long, short, 1))
    return cut.where(distance <= F.col("allowed")).select("a", "b")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place) of every line that repeats an earlier one; earlier means a smaller id, then a smaller place.

    Lines of fewer than EXACT_CHARS signs are never called repeated, of fewer than NEAR_CHARS only if they are equal. Hashes of equal
    lines are 128 bits wide; near lines are tied by 64 bits after their texts were compared.
    """
    lines = lines_of(docs, id_col, text_col)
    narrow = materialize(lines.where(F.length("line") >= EXACT_CHARS)
                         .select("id", "place", F.xxhash64("line").alias("key"), F.xxhash64(F.lit(1), "line").alias("key2")), "lines")
    exact = materialize(narrow.groupBy("key", "key2").agg(F.min("id").alias("owner"), F.count("*").alias("times")), "exact")
    total = narrow.count()
    common = exact.where(F.col("times") > total / COMMON).groupBy("key").agg(F.min("owner").alias("owner"))     # at most COMMON rows
    links = materialize(near_links(lines, common), "links")
    tied = materialize(components(links), "tied").withColumnRenamed("id", "key")
    known = exact.join(tied, "key", "left")
    first = known.where("component IS NOT NULL").groupBy("component").agg(F.min("owner").alias("first"))
    repeated = (known.join(first, "component", "left")
                .select("key", "key2", F.coalesce("component", "key").alias("class"), F.coalesce("first", "owner").alias("first"), "times", "component")
                .where("times > 1 OR component IS NOT NULL").drop("times", "component"))
    seen = narrow.join(repeated, ["key", "key2"])
    gone = seen.where(F.col("first") != F.col("id")).select("id", "place")
    own = seen.where(F.col("first") == F.col("id"))
    stays = own.groupBy("id", "class").agg(F.min("place").alias("least"))
    more = own.join(stays, ["id", "class"]).where("place > least").select("id", "place")
    return gone.unionAll(more)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text_col``, and ``lines_removed`` (int), replaced if it exists.

    Ids are unique bigints; a document with a null id or text is returned unchanged, as are blank and short lines. Of rows
    that repeat an id each loses the lines repeated under that id. No rows give no rows. The places to remove are broadcast
    if a count shows that they are few, else joined by id.
    """
    places = materialize(line_classes(docs, id_col, text_col).groupBy("id").agg(F.array_sort(F.collect_set("place")).alias(GONE)), "gone")
    side = F.broadcast(places) if fits_broadcast(places, FEW_ROWS, FEW_BYTES) else places
    rest = docs.drop("lines_removed")
    joined = rest.join(side.withColumnRenamed("id", GONE_ID), rest[id_col].cast("bigint") == F.col(GONE_ID), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda line, i: ~F.array_contains(GONE, i)), "\n")
    return joined.select(*[F.when(F.col(GONE).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in rest.columns],
                         F.coalesce(F.size(GONE), F.lit(0)).alias("lines_removed"))
