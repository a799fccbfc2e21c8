"""Connected components of links as a series of joins, for any number of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfolio.workspace import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every node of ``links`` (a, b bigint): the smallest id that links reach.

    Alternating star contraction: every node is first tied to the smallest of its neighbours by its larger
    neighbours, then by itself, until nothing changes. Links shrink towards one star per component. A node with
    very many links is met by a partial minimum and by a join that adaptive execution splits. Each round is written
    to the shared folder. Null ends and self links are ignored; no links give no rows.
    """
    ends = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = materialize(ends.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "links")
    before = None
    while True:
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).unionAll(now.select("m", "v"))
        least = both.groupBy("u").agg(F.least("u", F.min("w")).alias("low"))
        large = (both.where("w > u").join(least.hint("merge"), "u").select(F.col("w").alias("v"), F.col("low").alias("m")).distinct())
        lowest = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(lowest.hint("merge"), "v")
        now = materialize(small.select(F.when(F.col("m") == F.col("low"), F.col("v")).otherwise(F.col("m")).alias("v"),
                                       F.col("low").alias("m")).where("v <> m").distinct(), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if before == tuple(state):
            return now.select(F.col("v").alias("id"), F.col("m").alias("component")).unionAll(
                now.select("m", "m").distinct())
        before = tuple(state)
