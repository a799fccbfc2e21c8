"""Registered queries: prompts, chat requests and replies, model stages with a stub model."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfolio.functions import prompts
from tallyfolio.functions.text import clean_text
from tallyfolio.operators.calls import CallPolicy
from tallyfolio.operators.inference import requests, run_stage, text_model
from tallyfolio.operators.jobs import attach_jobs
from tallyfolio.operators.merge import final_record
from tallyfolio.plans import batch, sql
from tallyfolio.plans.registry import query
from tallyfolio.plans.samples import documents, jobs, resumes, table
from tallyfolio.plans.stubs import always_answer_resume, stub_models
from tallyfolio.workspace import lookup_join, materialize, new_folder

_SQL_JD_PROMPT = sql.render(prompts.JOB_PROMPT, job_description_text="text")
_SQL_RESUME_PROMPT = sql.render(prompts.RESUME_PROMPT, resume_text="text")


@query("render_jd", f"SELECT item_id AS request_id, {_SQL_JD_PROMPT} AS prompt FROM benchmark")
def render_jd(spark, sf_dir):
    return jobs(spark, sf_dir).select(
        "request_id", prompts.JOB_PROMPT.render(job_description_text=F.col("jd_text")).alias("prompt"))


@query("render_resume", f"SELECT doc_id, {_SQL_RESUME_PROMPT} AS prompt FROM documents")
def render_resume(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", prompts.RESUME_PROMPT.render(resume_text=F.col("text")).alias("prompt"))


@query("render_score", f"""SELECT doc_id, {sql.render(prompts.SCORE_PROMPT, resume_text="d.text",
                                                      job_description="b.text")} AS prompt
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % {sql.N_JOBS}""")
def render_score(spark, sf_dir):
    rows = attach_jobs(resumes(spark, sf_dir), jobs(spark, sf_dir))
    return rows.select(F.col("source_seq").alias("doc_id"), prompts.SCORE_PROMPT.render(
        resume_text=F.col("content"), job_description=F.col("jd_text")).alias("prompt"))


@query("chat_request", f"""SELECT doc_id, 1 AS n_messages, 'system' AS role, {_SQL_RESUME_PROMPT} AS content,
    'gpt-4o-mini' AS model, CAST(0.1 AS DOUBLE) AS temperature, CAST(NULL AS INTEGER) AS max_tokens FROM documents""")
def chat_request(spark, sf_dir):
    prompt = prompts.RESUME_PROMPT.render(resume_text=F.col("text"))
    rows = documents(spark, sf_dir).select("doc_id", prompts.chat_request(prompt).alias("request"))
    return rows.select(
        "doc_id", F.size("request.messages").alias("n_messages"),
        F.get("request.messages", F.lit(0))["role"].alias("role"),
        F.get("request.messages", F.lit(0))["content"].alias("content"),
        "request.model", "request.temperature", "request.max_tokens")


@query("chat_reply", """SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 4 = 2 THEN NULL
    WHEN turn % 5 = 4 THEN NULL ELSE text END AS reply FROM conversations""")
def chat_reply(spark, sf_dir):
    """Replies as JSON text; some without any choice and some cut off."""
    message = F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))
    full = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    body = (F.when((F.col("role") == "user") & (F.col("turn") % 4 == 2), F.lit('{"choices": []}'))
            .when(F.col("turn") % 5 == 4, F.lit('{"choices": [{"mess')).otherwise(full))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", prompts.chat_reply(body).alias("reply"))


_SQL_FEATURES = f"SELECT item_id AS request_id, {sql.answer_job(_SQL_JD_PROMPT)} AS job_features FROM benchmark"


@query("stage_jd", _SQL_FEATURES)
def stage_jd(spark, sf_dir):
    return batch.job_features(jobs(spark, sf_dir), stub_models())


def _sql_aspects(content: str) -> str:
    prompt = sql.render(prompts.RESUME_PROMPT, resume_text=content)
    return sql.answer_resume(prompt)


@query("stage_key_aspects", f"""SELECT {sql.RESUME_ID} AS unique_id, {_sql_aspects("text")} AS reply,
    {_sql_aspects("text")} IS NULL AS failed FROM documents""")
def stage_key_aspects(spark, sf_dir):
    replies = batch.key_aspects(resumes(spark, sf_dir), stub_models(calls=CallPolicy(batch_size=8, window=4)))
    return replies.select("unique_id", "reply", F.col("error").isNotNull().alias("failed"))


def sql_score(aspects: str, features: str) -> str:
    return sql.answer_score(sql.render(prompts.SCORE_PROMPT, resume_text=aspects, job_description=features))


@query("stage_score", f"""SELECT {sql.RESUME_ID} AS unique_id, {sql_score("d.text", "b.text")} AS reply
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % {sql.N_JOBS}""")
def stage_score(spark, sf_dir):
    aspects = resumes(spark, sf_dir).select(
        "unique_id", "request_id", F.col("content").alias("key_aspects"))
    features = jobs(spark, sf_dir).withColumnRenamed("jd_text", "job_features")
    return batch.score_replies(aspects, features, stub_models()).select("unique_id", "reply")


@query("stage_reuse", f"""SELECT {sql.RESUME_ID} AS unique_id,
    {sql.always_answer_resume(sql.render(prompts.RESUME_PROMPT, resume_text="text"))} AS reply FROM documents""")
def stage_reuse(spark, sf_dir):
    """A stage table that holds a part of the calls, some of them failed: the second run asks for the rest only."""
    rows = resumes(spark, sf_dir)
    prompt = prompts.RESUME_PROMPT.render(resume_text=F.col("content"))
    stage = new_folder(spark, "stage")
    run_stage(requests(rows.filter(F.length("content") > 1000), prompt), stub_models().resume, stage)
    return run_stage(requests(rows, prompt), text_model(always_answer_resume), stage).select("unique_id", "reply")


_SQL_TWO_STAGES = f"""WITH features AS ({_SQL_FEATURES}),
  cleaned AS (SELECT {sql.RESUME_ID} AS unique_id, {sql.RESUME_NAME} AS name, {sql.REQUEST} AS request_id,
              {sql.clean("text")} AS content FROM documents),
  aspects AS (SELECT *, {_sql_aspects("content")} AS key_aspects FROM cleaned),
  scored AS (SELECT a.*, {sql_score("coalesce(a.key_aspects, '')", "f.job_features")} AS reply
             FROM aspects a JOIN features f USING (request_id))
SELECT unique_id, name, content, unique_id || '_' || name AS file_path,
  {sql.clean("coalesce(key_aspects, '')")} AS key_feature, coalesce({sql.parse_score("reply")}, '0') AS score
FROM scored"""


@query("score_two_stages", _SQL_TWO_STAGES)
def score_two_stages(spark, sf_dir):
    """Job features, key aspects, scores and the final record of all resumes."""
    models = stub_models()
    cleaned = materialize(resumes(spark, sf_dir).withColumn("content", clean_text(F.col("content"))), "cleaned")
    outcome = batch.two_stages(cleaned, batch.job_features(jobs(spark, sf_dir), models), models)
    answered = lookup_join(cleaned, outcome, ["unique_id"])
    return answered.select("unique_id", *final_record(
        F.col("name"), F.col("content"), F.concat_ws("_", "unique_id", "name"), F.col("key_aspects"),
        F.col("score_reply")))
