"""Registered queries: the results table and the raw-file table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyfolio.functions.naming import make_id, stored_key
from tallyfolio.operators import results
from tallyfolio.plans import sql
from tallyfolio.plans.registry import query
from tallyfolio.plans.samples import documents, resumes, table
from tallyfolio.sources.raw_files import get_data_url, get_raw, get_raw_many, put_raw
from tallyfolio.sources.results_table import ResultsTable
from tallyfolio.workspace import materialize, new_folder

_RAW_DIGITS = 1


def new_results_table(spark) -> ResultsTable:
    return ResultsTable(spark, f"results_{uuid.uuid4().hex}", new_folder(spark, "results"))


_SQL_INSERTED = f"""SELECT {sql.RESUME_ID} AS unique_id, {sql.RESUME_NAME} AS resume_name, text AS resume_content,
    CAST(NULL AS VARCHAR) AS resume_key_aspect, CAST(NULL AS INTEGER) AS score FROM documents"""


@query("results_schema", f"""SELECT unique_id, resume_name, CAST(length(resume_content) AS INTEGER) AS n_chars,
    resume_key_aspect IS NULL AND score IS NULL AS is_new FROM ({_SQL_INSERTED})""")
def results_schema(spark, sf_dir):
    """Creating an existing table changes nothing; its declared types hold for what is read back."""
    store = new_results_table(spark)
    store.insert("load1", results.new_results(resumes(spark, sf_dir)))
    again = ResultsTable(spark, store.name, store.location)
    return again.read().select("unique_id", "resume_name", F.length("resume_content").alias("n_chars"),
                               (F.col("resume_key_aspect").isNull() & F.col("score").isNull()).alias("is_new"))


@query("results_insert", _SQL_INSERTED)
def results_insert(spark, sf_dir):
    store = new_results_table(spark)
    store.insert("load1", results.new_results(resumes(spark, sf_dir)))
    return store.load("load1")


_SQL_CANDIDATES = f"""SELECT doc_id, {sql.make_id("source", "doc_id // 3")} AS unique_id,
    source || repeat('n', CAST(n_chars % 120 AS INTEGER)) AS resume_name FROM documents"""


@query("results_reject", f"""WITH c AS ({_SQL_CANDIDATES}),
  first AS (SELECT unique_id, min(doc_id) AS doc_id FROM c WHERE length(resume_name) <= 100 GROUP BY unique_id)
  SELECT c.doc_id, c.unique_id, c.resume_name, CASE WHEN length(c.resume_name) > 100 THEN 'name_too_long'
    WHEN first.doc_id IS NULL THEN 'duplicate_key' END AS reason
  FROM c LEFT JOIN first ON c.unique_id = first.unique_id AND c.doc_id = first.doc_id""")
def results_reject(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", make_id(F.col("source"), F.floor(F.col("doc_id") / 3)).alias("unique_id"),
        F.concat("source", F.repeat(F.lit("n"), (F.col("n_chars") % 120).cast("int"))).alias("resume_name"))
    return results.mark_rejects(rows, ["doc_id"])


@query("results_update", f"""SELECT r.unique_id, r.resume_name, r.resume_content,
    CASE WHEN l.doc_id IS NOT NULL AND l.toxic = 0 THEN 'aspect ' || l.doc_id END AS resume_key_aspect,
    CASE WHEN l.doc_id IS NOT NULL THEN CAST(l.quality AS INTEGER) END AS score
  FROM (SELECT doc_id, {sql.RESUME_ID} AS unique_id, {sql.RESUME_NAME} AS resume_name, text AS resume_content
        FROM documents) r LEFT JOIN labels l ON l.doc_id = r.doc_id""")
def results_update(spark, sf_dir):
    rows = resumes(spark, sf_dir)
    store = new_results_table(spark)
    store.insert("load1", results.new_results(rows))
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "source_seq")
    known = rows.select("source_seq", "unique_id").join(labels, "source_seq")
    unknown = labels.withColumn("unique_id", F.concat(F.lit("unknown-"), F.col("source_seq")))
    updates = known.unionByName(unknown).select(
        "unique_id",
        F.when(F.col("toxic") == 0, F.concat(F.lit("aspect "), "source_seq")).alias("resume_key_aspect"),
        F.col("quality").cast("int").alias("score"))
    store.update("load1", materialize(updates, "updates"))
    return store.load("load1")


_SQL_TWO_LOADS = f"""SELECT doc_id, {sql.RESUME_ID} AS unique_id, CASE WHEN doc_id % 3 = 0 THEN 'load1' ELSE 'load2' END AS load_id
  FROM documents"""


@query("update_all_loads", f"""SELECT r.unique_id, r.load_id, CASE WHEN l.doc_id IS NOT NULL THEN 'aspect ' || l.doc_id END AS resume_key_aspect,
    CASE WHEN l.doc_id IS NOT NULL THEN CAST(l.quality AS INTEGER) END AS score
  FROM ({_SQL_TWO_LOADS}) r LEFT JOIN labels l ON l.doc_id = r.doc_id""")
def update_all_loads(spark, sf_dir):
    """The key holds for the whole table: what one load holds the next cannot insert, and an update finds all loads."""
    rows = resumes(spark, sf_dir)
    store = new_results_table(spark)
    store.insert("load1", results.new_results(rows.filter("source_seq % 3 = 0")))
    marked = results.mark_rejects(results.new_results(rows, "source_seq"), ["source_seq"])
    known = store.ids_elsewhere("load2", materialize(rows.select("unique_id"), "ids"))
    store.insert("load2", results.accepted(results.reject_known(marked, known)))
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "source_seq")
    updates = rows.select("source_seq", "unique_id").join(labels, "source_seq").select(
        "unique_id", F.concat(F.lit("aspect "), "source_seq").alias("resume_key_aspect"), F.col("quality").cast("int").alias("score"))
    store.update(None, materialize(updates, "updates"))
    return store.read().select("unique_id", "load_id", "resume_key_aspect", "score")


def _raw(spark, sf_dir):
    rows = resumes(spark, sf_dir)
    return rows.select("source_seq", stored_key(F.col("unique_id"), F.col("name")).alias("file_path"),
                       F.col("content").cast("binary").alias("content"))


_SQL_RAW = f"SELECT doc_id, {sql.RESUME_ID} || '_' || {sql.RESUME_NAME} AS file_path, text FROM documents"


@query("raw_put", f"SELECT file_path, substr(file_path, 1, {_RAW_DIGITS}) AS shard, text FROM ({_SQL_RAW})")
def raw_put(spark, sf_dir):
    path = new_folder(spark, "raw")
    put_raw(_raw(spark, sf_dir), path, "load1", _RAW_DIGITS)
    return (spark.read.schema("file_path string, content binary, load_id string, shard string").parquet(path)
            .select("file_path", "shard", F.col("content").cast("string").alias("text")))


@query("raw_get", f"SELECT file_path, text FROM ({_SQL_RAW}) WHERE doc_id = (SELECT max(doc_id) FROM documents)")
def raw_get(spark, sf_dir):
    """One file by its exact key, from the table of all raw files."""
    path = new_folder(spark, "raw")
    files = _raw(spark, sf_dir)
    put_raw(files, path, "load1", _RAW_DIGITS)
    key = files.agg(F.max_by("file_path", "source_seq").alias("key")).first().key
    return get_raw(spark, path, key, _RAW_DIGITS).select("file_path", F.col("content").cast("string").alias("text"))


@query("raw_get_url", """SELECT 'data:application/pdf;base64,' || base64(encode(text)) AS pdf_url FROM documents
  WHERE doc_id = (SELECT min(doc_id) FROM documents)""")
def raw_get_url(spark, sf_dir):
    """The download: one stored file as a data URL."""
    path = new_folder(spark, "raw")
    files = _raw(spark, sf_dir)
    put_raw(files, path, "load1", _RAW_DIGITS)
    key = files.agg(F.min_by("file_path", "source_seq").alias("key")).first().key
    return get_data_url(spark, path, key, _RAW_DIGITS)


@query("raw_get_many", f"""SELECT r.file_path, r.text FROM ({_SQL_RAW}) r
  JOIN labels l ON l.doc_id = r.doc_id AND l.quality = 1""")
def raw_get_many(spark, sf_dir):
    path = new_folder(spark, "raw")
    files = _raw(spark, sf_dir)
    put_raw(files, path, "load1", _RAW_DIGITS)
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("source_seq"))
    keys = files.select("source_seq", "file_path").join(good, "source_seq").select("file_path")
    return get_raw_many(spark, path, keys, _RAW_DIGITS).select(
        "file_path", F.col("content").cast("string").alias("text"))
