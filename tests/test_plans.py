"""Shape of physical plans: what is read, what is shuffled, what stays in the JVM."""

from __future__ import annotations

import pytest

from conftest import plan_of
from tallyfolio.plans import queries as registered
from tallyfolio import workspace
from tallyfolio.functions import text
from tallyfolio.operators.merge import last_write_wins
from pyspark.sql import functions as F

QUERIES = registered.QUERIES
IN_JVM = [name for name in QUERIES if not name.startswith(("stage_", "score_two", "full_batch", "extract_d", "expand",
                                                           "ingest", "src_files", "stream_", "evidence_keywords", "evidence_score"))]


@pytest.mark.parametrize("name", IN_JVM)
def test_text_path_stays_in_the_jvm(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert not any(node in plan for node in ("PythonUDF", "MapInPandas", "ArrowEvalPython", "BatchEvalPython"))


def test_columns_are_pruned(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = plan_of(documents.select("doc_id", text.clean_text(F.col("text")).alias("c")))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    winners = plan_of(last_write_wins(documents, ["source"], ["doc_id"]).select("source", "doc_id"))
    assert "text" not in winners


def test_only_small_inputs_are_spread(spark, sf_dir, monkeypatch):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "Exchange hashpartitioning(doc_id" in plan_of(workspace.spread_small(documents, "doc_id"))
    monkeypatch.setattr(workspace, "estimated_bytes", lambda df: 1 << 50)
    assert "Exchange" not in plan_of(workspace.spread_small(documents, "doc_id"))


class FakeSession:
    """Just the settings that decide on the shared folder."""

    def __init__(self, setting, master):
        self.settings, self.master, self.folder = {"spark.checkpoint.dir": setting}, master, None
        self.conf, self.sparkContext = self.settings, self

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = f"file:{folder}/id"


def test_shared_folder_comes_from_the_session(spark):
    assert workspace.shared_folder(FakeSession("s3a://bucket/work/", "yarn")) == "s3a://bucket/work"
    with pytest.raises(ValueError):
        workspace.shared_folder(FakeSession(None, "yarn"))
    local = FakeSession(None, "local[8]")
    assert workspace.shared_folder(local) == workspace.shared_folder(local) != ""
    kept = workspace.materialize(spark.range(5), "x")
    assert kept.count() == 5 and workspace.shared_folder(spark).removeprefix("file:") in kept.inputFiles()[0]
