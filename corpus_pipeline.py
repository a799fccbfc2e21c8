"""From raw documents to packed training sequences, by operators of ``tallyfolio.llm``.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. The stages before the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfolio.llm.line_dedup import drop_repeated_lines
from tallyfolio.llm.quality import quality_scores
from tallyfolio.llm.registry import table
from tallyfolio.llm.set_join import jaccard_classes
from tallyfolio.llm.token_queries import packed
from tallyfolio.llm.toxicity import toxicity_scores
from tallyfolio.workspace import fits_broadcast, materialize

DROPPED = "__dropped_copy__"
FEW_ROWS, FEW_BYTES = 400_000, 48 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_scores(docs, table(spark, sf_dir, "labels"), keep=True)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not found toxic."""
    return toxicity_scores(docs, table(spark, sf_dir, "labels"), keep=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has; ``n_chars`` follows.

    A document that had text and keeps none of it is a copy and goes; one that was blank before stays.
    """
    kept = drop_repeated_lines(docs)
    left = kept.where((F.col("lines_removed") == 0) | (F.trim(F.translate("text", "\t\r\n", "   ")) != ""))
    return left.select(*[F.when(F.col("lines_removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
                         if c == "n_chars" else F.col(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies."""
    dropped = jaccard_classes(docs).where("component_id <> id").select(F.col("id").alias(DROPPED))
    dropped = materialize(dropped, "dropped")
    side = F.broadcast(dropped) if fits_broadcast(dropped, FEW_ROWS, FEW_BYTES) else dropped
    return docs.join(side, docs["doc_id"] == F.col(DROPPED), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids, in full sequences."""
    return packed(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("lines", lines), ("near_copies", near_copies), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
