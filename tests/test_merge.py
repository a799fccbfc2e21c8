from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from tallyfolio import workspace
from tallyfolio.operators import jobs, merge, report, results


def hot_rows(spark):
    """A third of all rows share one name."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("n"), F.col("id") % 700))
    return spark.range(3000).select(key.alias("name"), F.col("id").alias("seq"),
                                    F.concat(F.lit("text "), "id").alias("content"))


def expected_last(rows):
    last = {}
    for row in sorted(rows, key=lambda r: r.seq):
        last[row.name] = row.content
    return last


@pytest.mark.parametrize("wide_bytes", [merge.WIDE_BYTES, 0])
@pytest.mark.parametrize("broadcast_rows", [workspace.BROADCAST_ROWS, 10])
def test_last_write_wins_with_a_hot_name(spark, monkeypatch, wide_bytes, broadcast_rows):
    monkeypatch.setattr(merge, "fits_broadcast", lambda df: workspace.fits_broadcast(df, broadcast_rows))
    rows = hot_rows(spark)
    got = merge.last_write_wins(rows, ["name"], ["seq"], wide_bytes)
    assert {r.name: r.content for r in got.collect()} == expected_last(rows.collect())
    assert got.count() == len(expected_last(rows.collect()))


def test_large_input_with_few_overwritten_rows_is_not_shuffled(spark):
    rows = spark.range(1000).select(F.concat(F.lit("n"), F.col("id") % 990).alias("name"), F.col("id").alias("seq"),
                                    F.repeat(F.lit("x"), 100).alias("content"))
    plan = plan_of(merge.last_write_wins(rows, ["name"], ["seq"], wide_bytes=0))
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_small_input_is_joined_on_key_and_order(spark):
    plan = plan_of(merge.last_write_wins(hot_rows(spark), ["name"], ["seq"]))
    assert "Window" not in plan and "SortAggregate" not in plan and "name#" in plan


def test_only_eligible_rows_are_picked(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, False)], "k string, s int, ok boolean")
    for wide_bytes in (merge.WIDE_BYTES, 0):
        got = merge.mark_picked(rows, ["k"], ["s"], eligible=F.col("ok"), wide_bytes=wide_bytes)
        assert {(r.k, r.s): r.picked for r in got.collect()} == {("a", 1): True, ("a", 2): False, ("b", 1): False}


def test_later_source_overwrites(spark):
    loose = spark.createDataFrame([("a", 9, "old"), ("b", 1, "b")], "name string, seq int, content string")
    packed = spark.createDataFrame([("a", 1, "new"), ("a", 2, "newer")], "name string, seq int, content string")
    got = merge.merge_sources([loose, packed], ["name"], ["seq"])
    assert {r.name: r.content for r in got.collect()} == {"a": "newer", "b": "b"}


def test_lookup_keeps_every_row_and_defaults(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    found = spark.createDataFrame([("a", "x"), ("b", None), ("z", "y")], "name string, reply string")
    kept = merge.drop_failed(found, "reply")
    got = merge.lookup_default(rows, kept, ["name"], "reply")
    assert {r.name: r.reply for r in got.collect()} == {"a": "x", "b": "", "c": ""}


@pytest.mark.parametrize("fits", [True, False])
def test_jobs_reach_every_document_of_a_hot_request(spark, monkeypatch, fits):
    monkeypatch.setattr(jobs, "fits_broadcast", lambda df: fits)
    documents = spark.range(900).select(
        F.col("id").cast("string").alias("unique_id"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("request_id"))
    texts = spark.range(49).select(F.col("id").alias("request_id"), F.concat(F.lit("job "), "id").alias("jd_text"))
    got = jobs.attach_jobs(documents, texts)
    assert got.count() == 900
    assert got.filter("request_id < 49 and jd_text <> concat('job ', request_id)").count() == 0
    assert got.filter("request_id = 49 and jd_text is not null").count() == 0
    assert ("explode" in plan_of(got)) == (not fits)


def test_salt_spreads_a_hot_key(spark):
    rows = spark.range(20000).select(F.lit(1).alias("k"), "id")
    side = spark.createDataFrame([(1, "v")], "k int, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = workspace.salted_join(rows, side, ["k"], ["id"], salts=32)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 20000 and len(sizes) > 4 and max(sizes) < 20000 / 2


def test_two_jobs_for_one_request_text_are_an_error(spark):
    two = spark.createDataFrame([("x",), ("y",)], "jd_text string")
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        jobs.attach_single_job(spark.range(3), two, "jd_text").collect()


def test_broadcast_probe(spark):
    rows = spark.range(1000).select(F.repeat(F.lit("x"), 100).alias("t"))
    assert workspace.fits_broadcast(rows)
    assert not workspace.fits_broadcast(rows, max_rows=999)
    assert not workspace.fits_broadcast(rows, max_bytes=50_000)
    assert workspace.fits_broadcast(rows.filter("t = ''"))


def test_rejects(spark):
    long_name = "n" * 101
    rows = spark.createDataFrame(
        [("k1", long_name, 1), ("k1", "n" * 100, 2), ("k1", "b", 3), ("k2", "é" * 100, 4), ("k3", long_name, 5)],
        "unique_id string, resume_name string, seq int")
    for wide_bytes in (merge.WIDE_BYTES, 0):
        marked = results.mark_rejects(rows, ["seq"], wide_bytes=wide_bytes)
        assert {r.seq: r.reason for r in marked.collect()} == {
            1: "name_too_long", 2: None, 3: "duplicate_key", 4: None, 5: "name_too_long"}
        assert results.accepted(marked).count() == 2 and results.rejected(marked).count() == 3


def test_report_counts_overwritten(spark):
    rows = spark.createDataFrame(
        [(1, "a", "txt", "ok", 1, -1, "u1"), (1, "a", "txt", "ok", 2, -1, "u2"), (2, "a", "txt", "ok", 1, -1, "u3"),
         (1, "a", "txt", "unreadable", 3, -1, "u4")],
        "request_id int, name string, route string, status string, source_seq long, member int, unique_id string")
    assert {tuple(r) for r in report.ingest_report(rows).collect()} == {("txt", "ok", 3, 1), ("txt", "unreadable", 1, 0)}
