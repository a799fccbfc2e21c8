"""Batch inference over a table with a model function that the user supplies.

A model is a factory: called once per task, it returns a function from a list of request bodies (JSON
chat requests) to a list of reply bodies (JSON chat replies, or None). The function is called from several threads
of its task at a time unless the window of calls is 1. The package holds no vendor client.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfolio.functions.prompts import chat_reply, chat_request, request_body
from tallyfolio.operators.calls import CallPolicy, ModelCall, Window
from tallyfolio.schemas import STAGE_REPLIES
from tallyfolio.workspace import lookup_join, materialize, new_folder, remove, written

ModelFactory = Callable[[], ModelCall]


def reply_body(content: str) -> str:
    """Chat reply around a plain text; for models that return text only."""
    return json.dumps({"choices": [{"message": {"role": "assistant", "content": content}}]})


def text_model(answer: Callable[[str], str]) -> ModelFactory:
    """Model factory from a function ``prompt -> text``; an exception concerns its own row only."""
    def factory() -> ModelCall:
        def call(bodies: Sequence[str]) -> list[str | None]:
            return [reply_body(answer(json.loads(body)["messages"][0]["content"])) for body in bodies]
        return call
    return factory


def requests(df: DataFrame, prompt: Column, **parameters) -> DataFrame:
    """``(unique_id, call_key, request)`` of the rows that have a prompt.

    The call key covers the row and the whole request, so a changed prompt, model or temperature is a new
    call and an unchanged one is not.
    """
    body = request_body(chat_request(F.col("_prompt"), **parameters))
    return (df.select("unique_id", prompt.alias("_prompt"))
            .filter(F.col("_prompt").isNotNull())
            .select("unique_id", body.alias("request"))
            .select("unique_id", F.sha2(F.concat_ws("\x1f", "unique_id", "request"), 256).alias("call_key"),
                    "request"))


REPLY_ROWS, REPLY_BYTES = 256, 8 << 20      # answers that leave a task together


def call_model(calls: DataFrame, model: ModelFactory, policy: CallPolicy = CallPolicy()) -> DataFrame:
    """``(unique_id, call_key, body, error)`` of each call; a failing call is recorded, the others go on.

    Only ids and requests cross to Python. Each task keeps ``policy.window`` calls in flight, reads its input as there is room
    and hands replies on as they come, so it holds no more than the window and a batch of either.
    """
    spark = calls.sparkSession
    narrow = calls.select("unique_id", "call_key", "request")
    if policy.parallelism is not None:
        narrow = narrow.repartition(policy.parallelism, "call_key")
    at_a_time = min(spark.sparkContext.defaultParallelism, policy.parallelism or spark.sparkContext.defaultParallelism)
    rate = policy.rate / at_a_time if policy.rate else None
    names = [field.name for field in STAGE_REPLIES]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = Window(model(), policy, rate)
        wanted = (((unique_id, call_key), body) for batch in batches
                  for unique_id, call_key, body in zip(*(batch[c].to_pylist() for c in ("unique_id", "call_key", "request"))))
        rows, held = [], 0
        for key, answer in window.ask(wanted):
            rows.append((*key, *answer))
            held += len(answer[0] or "")
            if len(rows) >= REPLY_ROWS or held >= REPLY_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)
                rows, held = [], 0
        window.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)

    return narrow.mapInArrow(ask, STAGE_REPLIES)


COMMITS, CALLS_A_COMMIT = 8, 200


def run_stage(calls: DataFrame, model: ModelFactory, table: str | None = None, policy: CallPolicy = CallPolicy(),
              commits: int = COMMITS) -> DataFrame:
    """Run the calls, store the replies, and return ``(unique_id, reply, error)``, one row per call.

    The stage table is written before anything reads the replies: neither a lost executor nor a second use
    of the result calls the model again. With a ``table`` path of the caller, only calls that it holds no reply
    for are made: a call that failed before is asked again. Such a table is filled in up to ``commits`` ranges
    of the call key, so a run that dies keeps the ranges it has finished. The requests are removed once they are answered.
    """
    spark = calls.sparkSession
    if table is None:
        path = new_folder(spark, "stage")
        call_model(calls, model, policy).write.parquet(path)
        replies = spark.read.schema(STAGE_REPLIES).parquet(path)
        return replies.select("unique_id", chat_reply(F.col("body")).alias("reply"), "error")
    folder, asked = new_folder(spark, "calls"), None
    if _exists(spark, table):
        # Requests are written only of the calls that are left.
        asked = materialize(calls.select("unique_id", "call_key"), "asked")
        done = spark.read.schema(STAGE_REPLIES).parquet(table).filter(F.col("body").isNotNull())
        left = materialize(asked.join(done.select("call_key"), "call_key", "left_anti").select("call_key").distinct(), "left")
        calls = lookup_join(calls, left, ["call_key"], "left_semi")
    try:
        open_calls = written(calls, folder)
        if asked is None:
            asked = materialize(open_calls.select("unique_id", "call_key"), "asked")
        commits = max(1, min(commits, open_calls.count() // CALLS_A_COMMIT))
        for number in range(commits):
            some = open_calls.filter(F.pmod(F.xxhash64("call_key"), F.lit(commits)) == number)
            call_model(some, model, policy).write.mode("append").parquet(table)
    finally:
        remove(spark, folder)
    held = spark.read.schema(STAGE_REPLIES).parquet(table)
    # Of a call that was asked several times a reply comes before an error.
    best = (lookup_join(held, asked.select("call_key").distinct(), ["call_key"], "left_semi").groupBy("call_key")
            .agg(F.max(F.struct(F.col("body").isNotNull().alias("answered"), "body", "error")).alias("best")))
    return asked.join(best, "call_key", "left").select(
        "unique_id", chat_reply(F.col("best.body")).alias("reply"), F.col("best.error").alias("error"))


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema(STAGE_REPLIES).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def require_all(replies: DataFrame) -> DataFrame:
    """Raise if any row of a stage failed (for the job stage, where a failure ends the request)."""
    failed = replies.filter(F.col("reply").isNull()).select("unique_id", "error").first()
    if failed is not None:
        raise RuntimeError(f"model call for {failed.unique_id} failed: {failed.error}")
    return replies
