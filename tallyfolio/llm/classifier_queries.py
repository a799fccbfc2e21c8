"""Queries of the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyfolio.llm.quality import quality_scores
from tallyfolio.llm.registry import query, table
from tallyfolio.llm.toxicity import toxicity_scores


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
