"""The whole batch: intake, raw put, insert, extraction, scoring, update, answer."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfolio.functions.prompts import JOB_PROMPT, RESUME_PROMPT, SCORE_PROMPT, Prompt
from tallyfolio.functions.text import NO_SCORE, clean_text, parse_score, score_int
from tallyfolio.operators.calls import CallPolicy
from tallyfolio.operators.inference import ModelFactory, requests, require_all, run_stage
from tallyfolio.operators.jobs import attach_jobs
from tallyfolio.operators.merge import final_record, last_write_wins
from tallyfolio.operators.results import mark_rejects, new_results, reject_known, rejected
from tallyfolio.sources.decoders import Decoder
from tallyfolio.sources.intake import OK, decode_files, identify_files, storable
from tallyfolio.sources.raw_files import put_raw
from tallyfolio.sources.results_table import ResultsTable
from tallyfolio.workspace import lookup_join, materialize, spread_small


Latest = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


@dataclass
class Models:
    """Model factories of the three stages, their prompts, request parameters, way of calling and score rule."""

    job: ModelFactory
    resume: ModelFactory
    score: ModelFactory
    job_prompt: Prompt = JOB_PROMPT
    resume_prompt: Prompt = RESUME_PROMPT
    score_prompt: Prompt = SCORE_PROMPT
    parameters: dict = field(default_factory=dict)
    calls: CallPolicy = CallPolicy()
    parse_score: Callable[[Column], Column] = parse_score


def job_features(jobs: DataFrame, models: Models, table: str | None = None) -> DataFrame:
    """``(request_id, job_features)``: one call per job description; a failed call raises."""
    rows = jobs.withColumn("unique_id", F.col("request_id").cast("string"))
    prompt = models.job_prompt.render(job_description_text=F.col("jd_text"))
    replies = require_all(run_stage(requests(rows, prompt, **models.parameters), models.job, table, models.calls))
    named = rows.select("unique_id", "request_id").join(replies, "unique_id")
    return named.select("request_id", F.col("reply").alias("job_features"))


def key_aspects(documents: DataFrame, models: Models, table: str | None = None) -> DataFrame:
    """``(unique_id, reply, error)``: one call per document, failures isolated."""
    rows = spread_small(documents.select("unique_id", "content"), "unique_id")
    prompt = models.resume_prompt.render(resume_text=F.col("content"))
    return run_stage(requests(rows, prompt, **models.parameters), models.resume, table, models.calls)


def score_replies(aspects: DataFrame, features: DataFrame, models: Models, table: str | None = None) -> DataFrame:
    """``(unique_id, reply, error)`` from ``(unique_id, request_id, key_aspects)``.

    The raw key aspects and raw job features go into the prompt; a document whose extraction failed is
    scored on empty text.
    """
    rows = attach_jobs(spread_small(aspects, "unique_id"), features)
    prompt = models.score_prompt.render(resume_text=F.coalesce(F.col("key_aspects"), F.lit("")),
                                        job_description=F.col("job_features"))
    return run_stage(requests(rows, prompt, **models.parameters), models.score, table, models.calls)


def two_stages(documents: DataFrame, features: DataFrame, models: Models,
               tables: Mapping[str, str] | None = None) -> DataFrame:
    """``(unique_id, key_aspects, score_reply)`` of the documents; only ids and replies move between stages."""
    tables = tables or {}
    extracted = key_aspects(documents, models, tables.get("resume"))
    found = extracted.select("unique_id", F.col("reply").alias("key_aspects"))
    aspects = materialize(lookup_join(documents.select("unique_id", "request_id"), found, ["unique_id"]), "aspects")
    scored = score_replies(aspects, features, models, tables.get("score"))
    return lookup_join(aspects.select("unique_id", "key_aspects"),
                       scored.select("unique_id", F.col("reply").alias("score_reply")), ["unique_id"])


def score_batch(files: DataFrame, jobs: DataFrame, models: Models, results: ResultsTable, load_id: str,
                raw_path: str | None = None, decoders: Mapping[str, Decoder] | None = None,
                tables: Mapping[str, str] | None = None, raw_digits: int = 2, latest: Latest | None = None) -> DataFrame:
    """Score uploads against the job description of their request.

    ``files`` is ``(request_id, source_seq, name, content)``, ``jobs`` is ``(request_id, jd_text)``. Returns
    ``(request_id, unique_id, name, content, file_path, key_feature, score)`` of the last file of each
    name; the earlier ones stay in the results table without a score. What cannot be read or inserted goes
    to the quarantine of the load with a reason. Documents are decoded once and written; everything after
    that reads the written columns it needs. Running a load again replaces it.

    ``latest`` decides which files are the last of their name where that does not depend on this batch alone: from keys and
    order values it gives the ids of those that are, and of files of other loads that no longer are and lose their score.
    """
    tables = tables or {}
    features = materialize(job_features(jobs, models, tables.get("job")), "features")
    identified = identify_files(files)
    if raw_path is not None:
        # Files are read and archives expanded once, not for the raw files and again for the documents.
        identified = materialize(identified, "members")
        put_raw(storable(identified), raw_path, load_id, raw_digits)
    decoded = materialize(decode_files(identified, decoders), "documents")
    documents = decoded.filter(F.col("status") == OK).drop("status", "error")

    # What is refused and what is last is found from names and ids; contents meet only the small answers.
    heads = materialize(documents.select("request_id", "source_seq", "member", "unique_id", "name"), "heads")
    marked = mark_rejects(heads.withColumnRenamed("name", "resume_name"), ["source_seq", "member"])
    refused = materialize(rejected(reject_known(marked, results.ids_elsewhere(load_id, heads))), "refused")
    place = ["unique_id", "source_seq", "member"]
    results.insert(load_id, new_results(lookup_join(documents, refused.select(*place), place, "left_anti")))
    unread = decoded.filter(F.col("status") != OK).select("unique_id", "name", F.col("status").alias("reason"), "error")
    results.quarantine(load_id, unread.unionByName(refused.select(
        "unique_id", F.col("resume_name").alias("name"), "reason", F.lit(None).cast("string").alias("error"))))

    if latest is None:
        last, beaten = last_write_wins(heads, ["request_id", "name"], ["source_seq", "member", "unique_id"]), None
    else:
        last, beaten = latest(heads)
    last = materialize(last.select("unique_id"), "last")
    outcome = materialize(two_stages(lookup_join(documents, last, ["unique_id"], "left_semi"), features, models, tables), "outcome")
    scores = outcome.select(
        "unique_id",
        clean_text(F.coalesce("key_aspects", F.lit(""))).alias("resume_key_aspect"),
        score_int(F.coalesce(models.parse_score(F.col("score_reply")), F.lit(NO_SCORE))).alias("score"))
    if beaten is None:
        results.update(load_id, scores)
    else:
        none = F.lit(None)
        results.update(None, scores.unionByName(beaten.select("unique_id", none.cast("string").alias("resume_key_aspect"), none.cast("int").alias("score"))))
    # Exactly the latest documents have an outcome, so this join also picks them.
    answered = lookup_join(documents, outcome, ["unique_id"], "inner")
    return answered.select("request_id", "unique_id", *final_record(
        F.col("name"), F.col("content"), F.col("file_path"), F.col("key_aspects"), F.col("score_reply"), models.parse_score))
