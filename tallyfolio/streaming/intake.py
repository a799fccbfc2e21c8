"""Uploads that keep arriving: every micro-batch is a load of the results table."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyfolio.plans.batch import Models, score_batch
from tallyfolio.sources.decoders import Decoder
from tallyfolio.sources.files import LISTING, list_folders
from tallyfolio.sources.intake import read_uploads
from tallyfolio.sources.results_table import ResultsTable
from tallyfolio.streaming.latest import LatestNames
from tallyfolio.streaming.ledger import FOLD_AFTER, Ledger
from tallyfolio.workspace import folders_in, remove, scratch

_FILE = ["folder", "path", "length", "source_seq"]


class Arrivals:
    """Files that appear in folders, each handed out to one micro-batch, in the order of their time and path.

    Every micro-batch lists the folders in tasks, leaves out what earlier ones were given (a file counts as another one when its
    size or time has changed) and writes its list down before it reads any of it. Repeated after a failure it gets the same
    list again. No name is hidden, empty files are files, and files of any age are taken, whenever they appear.
    ``max_files`` bounds a micro-batch; what is left comes with the next.
    """

    def __init__(self, spark: SparkSession, folders: list[str], progress: str, max_files: int | None = None, fold_after: int = FOLD_AFTER):
        self.spark, self.folders, self.max_files = spark, folders, max_files
        self.ledger = Ledger(spark, progress, LISTING, fold_after)

    def listed(self, number: int) -> DataFrame | None:
        """The files of micro-batch ``number`` (columns of a listing); None if nothing new has arrived."""
        known = self.ledger.part(number)
        if known is not None:
            return known
        before = self.ledger.before(number)
        self.ledger.fold(number, before)
        with scratch(self.spark):
            new = list_folders(self.spark, self.folders).join(self.ledger.before(number).select(*_FILE), _FILE, "left_anti")
            if self.max_files is not None:
                new = new.orderBy("source_seq", "folder", "path").limit(self.max_files)
            if new.isEmpty():
                return None
            return self.ledger.write(number, new)


def uploads(listing: DataFrame) -> DataFrame:
    """Files of a listing of ``folder/<request_id>/...`` with contents, archives expanded; a file outside of such a folder has the request ``""``."""
    request = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(F.lit(""))
    return read_uploads(listing.withColumn("request_id", request))


def each_arrival(arrivals: Arrivals, handle: Callable[[DataFrame, int], None], checkpoint: str,
                 every: str | None = None) -> StreamingQuery:
    """Call ``handle(listing, number)`` for what has arrived: once, or with ``every`` ("1 minute") again and again.

    The query's own source counts micro-batches only, so that the listing can be a Spark job. ``handle`` must be
    repeatable: after a failure it gets the same number and listing again.
    """
    def look(_: DataFrame, number: int) -> None:
        listing = arrivals.listed(number)
        if listing is not None:
            handle(listing, number)

    ticks = arrivals.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = ticks.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def score_stream(arrivals: Arrivals, jobs: DataFrame, models: Models, results: ResultsTable, checkpoint: str,
                 raw_path: str | None = None, decoders: Mapping[str, Decoder] | None = None, every: str | None = None,
                 fold_after: int = FOLD_AFTER) -> StreamingQuery:
    """Score arriving files against the job of their request.

    Of all files of a request and name the last one has a score, whichever micro-batches they came in; a file that is
    overtaken loses its score. The load and the stage tables are named by the micro-batch number, so a micro-batch that is
    repeated after a failure replaces its own rows and asks the models only for what they have not answered.

    What a micro-batch writes on its way is removed at its end, its stage tables by the next one, when it can't be repeated any more.
    """
    latest = LatestNames(results.spark, f"{checkpoint}/latest", fold_after)

    def score(listing: DataFrame, number: int) -> None:
        for done in folders_in(results.spark, f"{checkpoint}/stages"):
            if int(done) < number:
                remove(results.spark, f"{checkpoint}/stages/{done}")
        stages = {stage: f"{checkpoint}/stages/{number}/{stage}" for stage in ("job", "resume", "score")}
        present = listing.select(F.substring_index("path", "/", 1).alias("request_id")).distinct()
        with scratch(results.spark):
            score_batch(uploads(listing), jobs.join(present, "request_id", "left_semi"), models, results, f"stream-{number}",
                        raw_path, decoders, stages, latest=lambda heads: latest.take(number, heads))

    return each_arrival(arrivals, score, f"{checkpoint}/progress", every)
