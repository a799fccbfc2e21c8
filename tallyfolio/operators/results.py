"""Rows of the results table: insert, rejection, update by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfolio.operators.merge import WIDE_BYTES, mark_picked
from tallyfolio.schemas import MAX_NAME_CHARS, RESULTS
from tallyfolio.workspace import lookup_join, materialize

NAME_TOO_LONG = "name_too_long"
DUPLICATE_KEY = "duplicate_key"


def new_results(documents: DataFrame, *keep: str) -> DataFrame:
    """Documents as freshly inserted rows: key aspects and score are not known yet."""
    return documents.select(
        "unique_id", F.col("name").alias("resume_name"), F.col("content").alias("resume_content"),
        F.lit(None).cast("string").alias("resume_key_aspect"), F.lit(None).cast("int").alias("score"), *keep)


def mark_rejects(rows: DataFrame, order: list[str], key: str = "unique_id",
                 name: str = "resume_name", wide_bytes: int = WIDE_BYTES) -> DataFrame:
    """Add ``reason``: NULL for a row the table accepts.

    A name over the column's length is rejected; of the remaining rows with one key the first in ``order``
    (unique within a key) is accepted.
    """
    fits = F.length(name) <= MAX_NAME_CHARS
    marked = mark_picked(rows, [key], order, F.min, fits, "_first", wide_bytes)
    reason = F.when(~fits, F.lit(NAME_TOO_LONG)).when(~F.col("_first"), F.lit(DUPLICATE_KEY))
    return marked.withColumn("reason", reason).drop("_first")


def reject_known(marked: DataFrame, known: DataFrame, key: str = "unique_id") -> DataFrame:
    """Mark also the rows whose key is in ``known`` (unique there): the key holds for the whole table, not for one load.

    Few keys are known in a sound load; written down and broadcast, they leave the rows where they are.
    """
    hits = materialize(known.select(key, F.lit(True).alias("_known")), "known")
    joined = lookup_join(marked, hits, [key])
    reason = F.coalesce("reason", F.when(F.col("_known"), F.lit(DUPLICATE_KEY)))
    return joined.withColumn("reason", reason).drop("_known")


def accepted(marked: DataFrame) -> DataFrame:
    return marked.filter(F.col("reason").isNull()).drop("reason")


def rejected(marked: DataFrame) -> DataFrame:
    return marked.filter(F.col("reason").isNotNull())


RESULT_COLUMNS = [field.name for field in RESULTS]
