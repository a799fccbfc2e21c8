"""Last write wins over all micro-batches of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfolio.operators.merge import last_write_wins
from tallyfolio.streaming.ledger import FOLD_AFTER, Ledger
from tallyfolio.workspace import lookup_join, materialize

KEYS, ORDER = ["request_id", "name"], ["source_seq", "member", "unique_id"]
_SCHEMA = "request_id string, name string, source_seq bigint, member int, unique_id string"


class LatestNames:
    """Which file of each request and name is the last one so far.

    Only keys and order values are kept, never contents. Of two files of a name the later one in ``ORDER`` counts, whichever
    micro-batch it came in: the outcome is that of one batch over all files.
    """

    def __init__(self, spark: SparkSession, path: str, fold_after: int = FOLD_AFTER):
        self.ledger = Ledger(spark, path, _SCHEMA, fold_after)

    def take(self, number: int, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Ids of the files of this micro-batch that are the last of their name, and of earlier ones that no longer are.

        ``heads`` holds keys and order values of the files of micro-batch ``number``.
        """
        offered = last_write_wins(heads.select(F.col("request_id").cast("string"), "name", *ORDER), KEYS, ORDER)
        offered = materialize(offered, "offered")
        before = self.ledger.before(number)
        self.ledger.fold(number, last_write_wins(before, KEYS, ORDER))
        rivals = lookup_join(self.ledger.before(number), offered.select(*KEYS), KEYS, "left_semi")
        standing = rivals.groupBy(*KEYS).agg(F.max(F.struct(*ORDER)).alias("standing"))
        met = offered.join(standing, KEYS, "left").filter(F.col("standing").isNull() | (F.struct(*ORDER) > F.col("standing")))
        met = materialize(met.select(*KEYS, *ORDER, F.col("standing.unique_id").alias("beaten")), "met")
        won = self.ledger.write(number, met.drop("beaten"))
        return won.select("unique_id"), met.filter("beaten IS NOT NULL").select(F.col("beaten").alias("unique_id"))
