from __future__ import annotations

import dataclasses
import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from tallyfolio.functions import prompts
from tallyfolio.functions.text import parse_score, parse_score_full_range
from tallyfolio.operators import inference
from tallyfolio.operators.calls import CallPolicy
from tallyfolio.operators.inference import requests, require_all, reply_body, run_stage, text_model
from tallyfolio.plans.batch import Models, job_features, key_aspects, score_batch, two_stages
from tallyfolio.plans.samples import docx_bytes, zip_bytes
from tallyfolio.sources.raw_files import get_raw
from tallyfolio.sources.results_table import ResultsTable


def render(spark, text, **values):
    prompt = prompts.Prompt(text)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(prompt.render(**{k: F.col(k) for k in values}).alias("p")).first().p


def test_values_are_not_filled_again(spark):
    assert render(spark, "A {a} B {b} A {a}", a="{b}", b="{a}") == "A {b} B {a} A {b}"


def test_double_braces_and_no_placeholder(spark):
    assert render(spark, "{{x}} {a}", a="1") == "{x} 1"
    assert render(spark, "plain", a="1") == "plain"


def test_missing_value_is_an_error():
    with pytest.raises(KeyError):
        prompts.Prompt("{a} {b}").render(a=F.lit("x"))


def test_prompt_inputs_and_rubric():
    assert prompts.JOB_PROMPT.fields == ["job_description_text"]
    assert prompts.RESUME_PROMPT.fields == ["resume_text"]
    assert prompts.SCORE_PROMPT.fields == ["resume_text", "job_description"]
    for part in ("at most 16 points", "at most 63 points", "at most 21 points", "39: ", "0 to 100"):
        assert part in prompts.SCORE_PROMPT.text


def test_request_and_reply(spark):
    frame = spark.createDataFrame([('say "hi"\n',)], "p string")
    row = frame.select(prompts.request_body(prompts.chat_request(F.col("p"))).alias("plain"),
                       prompts.request_body(prompts.chat_request(F.col("p"), "m", 0.5, 9)).alias("full")).first()
    assert json.loads(row.plain) == {"messages": [{"role": "system", "content": 'say "hi"\n'}],
                                     "model": "gpt-4o-mini", "temperature": 0.1}
    assert json.loads(row.full)["max_tokens"] == 9 and json.loads(row.full)["temperature"] == 0.5
    bodies = [reply_body("a\nb"), '{"choices": []}', "{}", "no json", None,
              '{"choices": [{"message": {"content": "1"}}, {"message": {"content": "2"}}]}']
    replies = spark.createDataFrame(list(enumerate(bodies)), "i int, b string")
    got = [r.c for r in replies.select("i", prompts.chat_reply(F.col("b")).alias("c")).sort("i").collect()]
    assert got == ["a\nb", None, None, None, None, "1"]


def counting_model(folder, fails=lambda prompt: False):
    """Stub that leaves one file per call, so that calls can be counted across worker processes."""
    def answer(prompt):
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as call:
            call.write(prompt)
        if fails(prompt):
            raise ValueError("down")
        return f"re: {prompt}"
    return text_model(answer)


def rows(spark, n):
    return spark.range(n).select(F.concat(F.lit("u"), "id").alias("unique_id"), F.concat(F.lit("p"), "id").alias("p"))


@pytest.mark.parametrize("batch_size", [1, 7])
def test_failures_stay_with_their_rows(spark, tmp_path, batch_size):
    model = counting_model(tmp_path, lambda prompt: prompt.endswith("3"))
    got = run_stage(requests(rows(spark, 100), F.col("p")), model, policy=CallPolicy(batch_size=batch_size, parallelism=3)).collect()
    assert len(got) == 100
    for row in got:
        number = row.unique_id[1:]
        assert row.reply == (None if number.endswith("3") else f"re: p{number}")
        assert (row.error == "ValueError: down") == number.endswith("3")


def test_one_call_per_row_and_none_on_reuse(spark, tmp_path):
    calls, stage = tmp_path / "calls", str(tmp_path / "stage")
    calls.mkdir()
    model = counting_model(calls)
    first = run_stage(requests(rows(spark, 50), F.col("p")), model, stage)
    assert first.count() == first.count() == 50 and len(os.listdir(calls)) == 50
    more = run_stage(requests(rows(spark, 60), F.col("p")), model, stage)
    assert more.count() == 60 and len(os.listdir(calls)) == 60
    other = run_stage(requests(rows(spark, 60), F.col("p"), temperature=0.9), model, stage)
    assert other.count() == 60 and len(os.listdir(calls)) == 120


def test_failed_calls_are_asked_again_and_only_those(spark, tmp_path):
    calls, stage = tmp_path / "calls", str(tmp_path / "stage")
    calls.mkdir()
    down = counting_model(calls, lambda prompt: prompt.endswith("3"))
    first = run_stage(requests(rows(spark, 50), F.col("p")), down, stage)
    assert first.filter("reply IS NULL").count() == 5 and len(os.listdir(calls)) == 50
    again = run_stage(requests(rows(spark, 50), F.col("p")), counting_model(calls), stage).collect()
    assert len(again) == 50 and all(r.reply == f"re: p{r.unique_id[1:]}" and r.error is None for r in again)
    assert len(os.listdir(calls)) == 55


def test_a_run_that_dies_keeps_its_finished_ranges(spark, tmp_path, monkeypatch):
    calls, stage = tmp_path / "calls", str(tmp_path / "stage")
    calls.mkdir()
    real, made = inference.call_model, []

    def dying(*arguments):
        made.append(1)
        if len(made) == 5:
            raise RuntimeError("lost")
        return real(*arguments)
    monkeypatch.setattr(inference, "call_model", dying)
    monkeypatch.setattr(inference, "CALLS_A_COMMIT", 10)
    with pytest.raises(RuntimeError, match="lost"):
        run_stage(requests(rows(spark, 80), F.col("p")), counting_model(calls), stage)
    asked = len(os.listdir(calls))
    assert 0 < asked < 80
    monkeypatch.setattr(inference, "call_model", real)
    assert run_stage(requests(rows(spark, 80), F.col("p")), counting_model(calls), stage).filter("reply IS NOT NULL").count() == 80
    assert len(os.listdir(calls)) == 80


def test_rows_without_prompt_are_not_sent(spark, tmp_path):
    frame = rows(spark, 10).withColumn("p", F.when(F.col("unique_id") != "u4", F.col("p")))
    got = run_stage(requests(frame, F.col("p")), counting_model(tmp_path))
    assert got.count() == 9 and len(os.listdir(tmp_path)) == 9


def test_a_wrong_number_of_replies_is_asked_one_by_one(spark):
    def model():
        return lambda bodies: [reply_body("x")] * (1 if len(bodies) == 1 else len(bodies) - 1)
    got = run_stage(requests(rows(spark, 20), F.col("p")), model, policy=CallPolicy(batch_size=5))
    assert got.filter("reply = 'x'").count() == 20


def test_job_stage_is_all_or_nothing(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "a"), (2, "b")], "request_id int, jd_text string")
    models = Models(counting_model(tmp_path, lambda prompt: "\nb\n" in prompt), None, None)
    with pytest.raises(RuntimeError, match="call for 2 failed: ValueError: down"):
        job_features(jobs, models)
    good = require_all(spark.createDataFrame([("u", "r", None)], "unique_id string, reply string, error string"))
    assert good.count() == 1


def stub_models(**options):
    def score(prompt):
        if "FAILSCORE" in prompt:
            raise ValueError("down")
        return "Score: 85" if "empty()" not in prompt else "7"
    def aspects(prompt):
        if "FAILASPECT" in prompt:
            raise ValueError("down")
        return f"<b>Skills</b>: {prompt.split('[')[1].split(']')[0]}"
    return Models(text_model(lambda p: f"features of {p}"), text_model(aspects), text_model(score),
                  job_prompt=prompts.Prompt("job {job_description_text}"), resume_prompt=prompts.Prompt("[{resume_text}]"),
                  score_prompt=prompts.Prompt("empty({resume_text}) {job_description}"), **options)


def test_the_whole_range_of_scores_can_be_chosen(spark, tmp_path):
    files = spark.createDataFrame([(1, 1, "a.txt", b"a")], "request_id int, source_seq long, name string, content binary")
    jobs = spark.createDataFrame([(1, "j")], "request_id int, jd_text string")
    for rule, wanted in ((parse_score, 0), (parse_score_full_range, 100)):
        models = dataclasses.replace(stub_models(), score=text_model(lambda prompt: "Score: 100"), parse_score=rule)
        results = ResultsTable(spark, f"results_{uuid.uuid4().hex}", str(tmp_path / rule.__name__))
        answer = score_batch(files, jobs, models, results, "l1").collect()
        assert [r.score for r in answer] == [str(wanted)] and [r.score for r in results.read().collect()] == [wanted]


def test_failed_extraction_is_scored_on_empty_text(spark):
    documents = spark.createDataFrame([("a", 1, "x FAILASPECT"), ("b", 1, "y"), ("c", 1, "FAILSCORE")],
                                      "unique_id string, request_id int, content string")
    features = spark.createDataFrame([(1, "f")], "request_id int, job_features string")
    got = {r.unique_id: (r.key_aspects, r.score_reply) for r in two_stages(documents, features, stub_models()).collect()}
    assert got == {"a": (None, "7"), "b": ("<b>Skills</b>: y", "Score: 85"), "c": ("<b>Skills</b>: FAILSCORE", None)}
    assert key_aspects(documents, stub_models()).filter("error is not null").count() == 1


UPLOADS = [
    (1, 1, "cv.txt", b"first version"), (1, 2, "cv.txt", b"second <i>version</i>"), (2, 3, "cv.txt", b"other request"),
    (1, 4, "d.docx", docx_bytes("word text")), (1, 5, "z.zip", zip_bytes([("cv.txt", b"third version"), ("n.xyz", b"?")])),
    (1, 6, "e.xyz", b"unsupported"), (1, 7, "bad.txt", b"\xff"), (1, 8, "f.txt", b"FAILASPECT"), (1, 9, "s.txt", b"FAILSCORE"),
    (1, 10, "n" * 101 + ".txt", b"too long a name"),
]


def test_whole_batch(spark, tmp_path):
    files = spark.createDataFrame(UPLOADS, "request_id int, source_seq long, name string, content binary")
    jobs = spark.createDataFrame([(1, "j1"), (2, "j2")], "request_id int, jd_text string")
    results = ResultsTable(spark, f"results_{uuid.uuid4().hex}", str(tmp_path / "results"))
    raw = str(tmp_path / "raw")
    answer = score_batch(files, jobs, stub_models(), results, "l1", raw_path=raw, raw_digits=1).collect()
    got = {(r.request_id, r.name): (r.content, r.key_feature, r.score) for r in answer}
    assert got == {
        (1, "cv.txt"): ("third version", "Skills third version", "85"),
        (2, "cv.txt"): ("other request", "Skills other request", "85"),
        (1, "d.docx"): ("word text", "Skills word text", "85"),
        (1, "f.txt"): ("FAILASPECT", "", "0"),
        (1, "s.txt"): ("FAILSCORE", "Skills FAILSCORE", "0"),
        (1, "n" * 101 + ".txt"): ("too long a name", "Skills too long a name", "85"),
    }
    table = sorted((r.resume_name, r.resume_content, r.resume_key_aspect, r.score) for r in results.load("l1").collect()
                   if r.score is not None)
    assert table == sorted([
        ("cv.txt", "third version", "Skills third version", 85), ("cv.txt", "other request", "Skills other request", 85),
        ("d.docx", "word text", "Skills word text", 85), ("f.txt", "FAILASPECT", "", 0),
        ("s.txt", "FAILSCORE", "Skills FAILSCORE", 0)])
    unscored = sorted(r.resume_content for r in results.load("l1").collect() if r.score is None)
    assert unscored == ["first version", "second version"]
    left_out = sorted((r.name[:7], r.reason) for r in results.quarantined("l1").collect())
    assert left_out == [("bad.txt", "unreadable"), ("e.xyz", "unsupported"), ("n.xyz", "unsupported"),
                        ("nnnnnnn", "name_too_long")]
    again = score_batch(files, jobs, stub_models(), results, "l1", raw_path=raw, raw_digits=1)
    assert sorted(again.collect()) == sorted(answer) and results.read().count() == len(table) + len(unscored)
    path = next(r.file_path for r in answer if r.name == "d.docx")
    assert bytes(get_raw(spark, raw, path, 1).first().content) == UPLOADS[3][3]
