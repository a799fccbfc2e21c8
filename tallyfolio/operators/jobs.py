"""Bring the job description of a request to each of its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfolio.workspace import fits_broadcast, salted_join


def attach_jobs(documents: DataFrame, jobs: DataFrame, on: str = "request_id",
                salt_on: str = "unique_id") -> DataFrame:
    """Give each document the job row of its request.

    The jobs are broadcast when a probe shows that they are small. Beyond that both sides are shuffled,
    and salted, because one request may hold a large part of all documents.
    """
    if fits_broadcast(jobs):
        return documents.join(F.broadcast(jobs), on, "left")
    return salted_join(documents, jobs, [on], [salt_on])


def attach_single_job(documents: DataFrame, job: DataFrame, column: str) -> DataFrame:
    """One job for all documents, as a scalar subquery: no join at all; two job rows are an error."""
    return documents.withColumn(column, job.select(column).scalar())
