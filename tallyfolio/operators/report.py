"""What became of the files of an intake."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfolio.operators.merge import mark_picked


def ingest_report(documents: DataFrame) -> DataFrame:
    """Files per route and status, and how many of them a later file of the same name overwrote.

    An overwritten file stays in the results table without a score. Counted from narrow columns only.
    """
    narrow = documents.select("request_id", "name", "route", "status", "source_seq", "member", "unique_id")
    usable = F.col("status") == "ok"
    marked = mark_picked(narrow, ["request_id", "name"], ["source_seq", "member", "unique_id"],
                         eligible=usable, column="last")
    return marked.groupBy("route", "status").agg(
        F.count("*").alias("files"), F.count_if(usable & ~F.col("last")).alias("overwritten"))
