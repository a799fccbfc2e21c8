"""Weighted rubric: criterion levels to points, section subtotals and totals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfolio.schemas import POINTS, RUBRIC, UNSCORABLE, section_max  # noqa: F401

def rubric_rows() -> list[tuple[str, str, int, int]]:
    return [(section, criterion, level, points)
            for section, criteria in POINTS.items()
            for criterion, ladder in criteria.items()
            for level, points in enumerate(ladder, start=1)]


def criteria() -> dict[str, list[int]]:
    """Point ladder by criterion."""
    return {criterion: ladder for section in POINTS.values() for criterion, ladder in section.items()}


def points_of(levels: Mapping[str, Column]) -> Column:
    """Total of one row from its level columns by criterion; an unknown level counts 0."""
    total = F.lit(UNSCORABLE)
    for criterion, level in levels.items():
        ladder = F.array(*[F.lit(points) for points in criteria()[criterion]])
        total = total + F.coalesce(F.get(ladder, level - 1), F.lit(0))
    return total


def rubric_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rubric_rows(), RUBRIC)


def _points(ratings: DataFrame) -> DataFrame:
    # The rubric is the fixed list above, so its broadcast cannot grow with the data.
    rubric = F.broadcast(rubric_frame(ratings.sparkSession))
    return ratings.join(rubric, ["criterion", "level"], "left")


def rubric_total(ids: DataFrame, ratings: DataFrame, key: str = "unique_id") -> DataFrame:
    """Total per id of ``ids``; an id without ratings is unscorable and gets 0."""
    totals = _points(ratings).groupBy(key).agg(F.sum("points").alias("_sum"))
    total = F.coalesce(F.round("_sum"), F.lit(UNSCORABLE)).cast("int").alias("total")
    return ids.join(totals, key, "left").select(key, total)


def rubric_sections(ids: DataFrame, ratings: DataFrame, key: str = "unique_id") -> DataFrame:
    """One row per id of ``ids`` with the subtotal of each section, 0 if it has no ratings there.

    The explicit pivot values avoid a scan.
    """
    sums = _points(ratings).groupBy(key).pivot("section", list(POINTS)).agg(F.sum("points"))
    return ids.join(sums, key, "left").select(
        key, *[F.coalesce(F.col(f"`{s}`"), F.lit(UNSCORABLE)).cast("int").alias(f"section_{s}") for s in POINTS])
