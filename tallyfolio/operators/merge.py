"""Keyed merge of file records: last write wins, defaults for the missing, the final record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfolio.functions.text import NO_SCORE, clean_text, parse_score
from tallyfolio.workspace import estimated_bytes, fits_broadcast, lookup_join, materialize


# Rows of an input estimated below this are simply shuffled; above it, it pays to look for a way around.
WIDE_BYTES = 64 << 30


def mark_picked(df: DataFrame, keys: list[str], order: list[str], pick=F.max, eligible: Column | None = None,
                column: str = "picked", wide_bytes: int = WIDE_BYTES) -> DataFrame:
    """Add a flag: is this the row of its key with the largest (or smallest) order value?

    Keys and order values must not be NULL, and order values must be unique within a key; only
    ``eligible`` rows take part. The picked values come from the narrow columns alone, with map-side
    partials, so a hot key costs one row per task. Wide rows then meet them on key *and* order value: that
    pair is unique, so the rows of a hot key spread over all tasks.

    For a large input the rows that were *not* picked are looked at first. Usually they are few, and then
    they are broadcast and the wide rows are not shuffled at all.
    """
    allowed = F.lit(True) if eligible is None else eligible
    value = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    rows = df.withColumn("_order", value)
    narrow = rows.filter(allowed).select(*keys, "_order")
    picked = narrow.groupBy(*keys).agg(pick("_order").alias("_order"))
    on = [*keys, "_order"]
    if estimated_bytes(df) >= wide_bytes:
        picked = materialize(picked, "picked")
        others = materialize(narrow.join(picked, on, "left_anti").distinct(), "others")
        if fits_broadcast(others):
            marked = rows.join(F.broadcast(others.withColumn("_other", F.lit(True))), on, "left")
            return marked.withColumn(column, allowed & F.col("_other").isNull()).drop("_order", "_other")
    marked = rows.join(picked.withColumn("_hit", F.lit(True)), on, "left")
    return marked.withColumn(column, allowed & F.col("_hit").isNotNull()).drop("_order", "_hit")


def last_write_wins(df: DataFrame, keys: list[str], order: list[str], wide_bytes: int = WIDE_BYTES) -> DataFrame:
    """Keep per key the row that comes last in ``order``."""
    return mark_picked(df, keys, order, wide_bytes=wide_bytes).filter("picked").drop("picked")


def merge_sources(sources: list[DataFrame], keys: list[str], order: list[str],
                  rank: str = "source_rank") -> DataFrame:
    """Union of sources; a later source overwrites equal keys of an earlier one."""
    merged = sources[0].withColumn(rank, F.lit(0))
    for number, source in enumerate(sources[1:], start=1):
        merged = merged.unionByName(source.withColumn(rank, F.lit(number)))
    return last_write_wins(merged, keys, [rank, *order])


def drop_failed(df: DataFrame, result: str) -> DataFrame:
    return df.filter(F.col(result).isNotNull())


def lookup_default(df: DataFrame, results: DataFrame, keys: list[str], result: str,
                   default: str = "") -> DataFrame:
    """Look up ``result`` by key (unique in ``results``); no row is lost, a missing one gets the default."""
    found = results.select(*keys, result)
    return lookup_join(df, found, keys).withColumn(result, F.coalesce(F.col(result), F.lit(default)))


def final_record(name: Column, content: Column, file_path: Column, key_aspects: Column,
                 reply: Column, parse: Callable[[Column], Column] = parse_score) -> list[Column]:
    """Columns of the answer: key aspects are cleaned, the reply is parsed; missing ones count as empty."""
    return [
        name.alias("name"),
        content.alias("content"),
        file_path.alias("file_path"),
        clean_text(F.coalesce(key_aspects, F.lit(""))).alias("key_feature"),
        F.coalesce(parse(reply), F.lit(NO_SCORE)).alias("score"),
    ]
