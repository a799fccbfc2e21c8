"""The pipeline stage by stage: what each keeps, and what comes out at the end."""

from __future__ import annotations

import collections

import pytest

import corpus_pipeline
from test_dedup import deduped, document_classes
from tallyfolio.llm import quality, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Documents before and after each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialize(stage(spark, out[-1], sf_dir), "test"))
    return out


def test_stages_are_in_order_and_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "lines", "near_copies", "packing"]
    assert {tuple(x.columns) for x in stages[:-1]} == {("doc_id", "text", "lang", "source", "n_chars")}
    assert {str(x.schema) for x in stages[:-1]} == {str(stages[0].schema)}


def test_classifier_stages_drop_what_they_reject(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in quality.quality_scores(stages[0], labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in stages[1].collect()} == good
    mild = {r.doc_id for r in toxicity.toxicity_scores(stages[1], labels).where("predicted = 0").collect()}
    assert {r.doc_id for r in stages[2].collect()} == mild


def test_line_stage_against_brute_force(stages):
    """Exact repeats by brute force on all documents; near ones are tested on their own."""
    before = {r.doc_id: r.text for r in stages[2].collect()}
    short = {i: t for i, t in before.items() if len(t) < 1500}
    after = {r.doc_id: r for r in stages[3].collect()}
    seen = collections.defaultdict(set)
    for i, t in before.items():
        for line in t.split("\n"):
            seen[line.strip(" ")].add(i)
    for i, r in after.items():
        assert r.n_chars == len(r.text)
        assert all(min(seen[line.strip(" ")]) == i for line in r.text.split("\n") if len(line.strip(" ")) >= 10)
    for i in set(before) - set(after):
        assert all(min(seen[line.strip(" ")]) < i or len(line.strip(" ")) >= 24 or not line.strip(" ") for line in before[i].split("\n"))
    own = deduped(short)
    assert sum(own[i] == t for i, t in short.items()) > len(short) / 2


def test_copy_stage_keeps_one_of_each_group(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    wanted = {i for i, (_, c) in document_classes(before).items() if i == c}
    assert {r.doc_id for r in stages[4].collect()} == wanted


def test_run_packs_all_that_is_left(spark, sf_dir, stages):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    tokens = collections.Counter()
    for r in rows:
        tokens[r.doc_id] += r.length
    assert tokens == {r.doc_id: r.doc_tokens for r in rows}
    assert set(tokens) == {r.doc_id for r in stages[4].collect()}


def test_stages_take_nothing_and_nulls(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    odd = spark.createDataFrame([(None, "a line of some length\nb", None, None, None), (900001, None, "en", "s", 0), (900002, "", "en", "s", 0)], schema)
    for docs in (odd.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test")
        docs.count()
