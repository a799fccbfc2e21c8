"""Registered queries: file sources, archives, decoders, the intake report and the full batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from tallyfolio.functions.text import clean_text
from tallyfolio.operators.report import ingest_report as report_of
from tallyfolio.plans import sql
from tallyfolio.plans.batch import score_batch
from tallyfolio.plans.inference_queries import _SQL_FEATURES, _sql_aspects, sql_score
from tallyfolio.plans.registry import query
from tallyfolio.plans.samples import documents, docx_bytes, jobs, stored_files, uploads, zip_bytes
from tallyfolio.plans.store_queries import new_results_table
from tallyfolio.plans.stubs import stub_models
from tallyfolio.slices import all_slices
from tallyfolio.sources.archives import expand_archives as expand
from tallyfolio.sources.decoders import decode_docx, decode_text, decode_with
from tallyfolio.sources.files import list_folders, read_folder
from tallyfolio.sources.intake import read_documents
from tallyfolio.workspace import materialize, new_folder


_SQL_PREFIX = "list_extract(['', '_', '.', '', ''], CAST(doc_id % 5 AS INTEGER) + 1)"


@query("src_files", f"""SELECT 'd' || (doc_id % 16) || CASE WHEN doc_id % 3 = 0 THEN '/sub/' ELSE '/' END || name AS path, name,
    CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 7 <> 5 THEN text END AS text,
    CASE WHEN doc_id % 7 = 5 THEN 'unsupported' END AS status
  FROM (SELECT *, {_SQL_PREFIX} || 'cv' || (doc_id // 16) || CASE WHEN doc_id % 7 = 5 AND doc_id % 11 <> 0 THEN '.xyz' ELSE '.txt' END AS name
        FROM documents) WHERE NOT (doc_id % 11 = 0 AND doc_id % 7 = 5)
  UNION ALL SELECT 'd' || (doc_id % 16) || CASE WHEN doc_id % 3 = 0 THEN '/sub/' ELSE '/' END || {_SQL_PREFIX} || 'cv' || (doc_id // 16) || '.txt',
    {_SQL_PREFIX} || 'cv' || (doc_id // 16) || '.txt', '', NULL FROM documents WHERE doc_id % 11 = 0 AND doc_id % 7 = 5""")
def src_files(spark, sf_dir):
    """Every document as a file in a tree of folders, listed and read back: hidden names, empty files, equal names in folders."""
    folder = stored_files(spark, sf_dir)
    files = read_folder(spark, folder, list_folders(spark, [folder]))
    return files.select("path", "name", F.col("content").cast("string").alias("text"), "status")


def _packed(spark, sf_dir, pack, name: str):
    """``(doc_id, name, content)`` with the text of each document packed into bytes."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in all_slices(batches):
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "name": pa.array([f"{name}{i}" for i in ids], pa.string()),
                "content": pa.array([pack(i, text) for i, text in zip(ids, texts)], pa.binary())})
    rows = documents(spark, sf_dir).select("doc_id", "text")
    return rows.mapInArrow(build, "doc_id long, name string, content binary")


def _archive(number: int, text: str) -> bytes:
    return zip_bytes([(f"a{number}.txt", text.encode()), ("sub/", b""), (f"sub/B{number}.TXT", text[::2].encode())])


@query("expand_archives", """SELECT doc_id, 'pack' || doc_id AS archive, 0 AS member, 'a' || doc_id || '.txt' AS name,
    text FROM documents
  UNION ALL SELECT doc_id, 'pack' || doc_id, 2, 'sub/B' || doc_id || '.TXT',
    list_aggregate(list_transform(range(1, length(text) + 1, 2), lambda i: substr(text, i, 1)), 'string_agg', '')
  FROM documents""")
def expand_archives(spark, sf_dir):
    members = expand(_packed(spark, sf_dir, _archive, "pack"), ["doc_id"])
    return members.select("doc_id", "archive", "member", "name", F.col("content").cast("string").alias("text"))


@query("extract_txt", f"""SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN {sql.clean('text')} END AS content,
    doc_id % 13 = 0 AS invalid FROM documents""")
def extract_txt(spark, sf_dir):
    """Strict UTF-8: every 13th document is given an invalid byte and must come out as unreadable."""
    raw = F.col("text").cast("binary")
    broken = F.concat(raw, F.unhex(F.lit("C328")))
    rows = documents(spark, sf_dir).select(
        "doc_id", decode_text(F.when(F.col("doc_id") % 13 == 0, broken).otherwise(raw)).alias("decoded"))
    return rows.select("doc_id", clean_text(F.col("decoded")).alias("content"),
                       F.col("decoded").isNull().alias("invalid"))


@query("extract_docx", f"SELECT doc_id, {sql.clean('text')} AS content, CAST(NULL AS VARCHAR) AS error FROM documents")
def extract_docx(spark, sf_dir):
    files = _packed(spark, sf_dir, lambda _, text: docx_bytes(text), "d")
    rows = files.select("doc_id", decode_with(F.lit("docx"), F.col("content"), {"docx": decode_docx}).alias("d"))
    return rows.select("doc_id", clean_text(F.col("d.text")).alias("content"), F.col("d.error").alias("error"))


_SQL_STEM = "('cv' || (n_chars % 97))"
_SQL_READ = f"""SELECT request_id, source_seq, archive, member, name, route, status,
    CASE WHEN status = 'ok' THEN clean END AS content, {sql.make_id("request_id", "archive", "member", "name",
                                                                  "source_seq")} AS unique_id
  FROM (
    SELECT *, CASE WHEN route = 'unsupported' THEN 'unsupported' WHEN broken THEN 'unreadable' ELSE 'ok' END AS status
    FROM (
      SELECT {sql.REQUEST} AS request_id, doc_id AS source_seq, CAST(NULL AS VARCHAR) AS archive, -1 AS member,
        {_SQL_STEM} || CASE WHEN doc_id % 10 = 9 THEN '.txt' ELSE list_extract(['.txt', '.TXT', '.docx', '', '.xyz'],
          CAST(doc_id % 5 AS INTEGER) + 1) END AS name,
        CASE WHEN doc_id % 10 = 4 THEN 'unsupported' WHEN doc_id % 5 = 2 THEN 'docx' ELSE 'txt' END AS route,
        doc_id % 10 = 9 AS broken, {sql.clean("text")} AS clean
      FROM documents WHERE doc_id % 5 <> 3
      UNION ALL
      SELECT {sql.REQUEST}, doc_id, 'pack' || doc_id || '.zip', m.member,
        m.prefix || {_SQL_STEM} || m.suffix, m.route, false, {sql.clean("text")}
      FROM documents, (VALUES (0, '', '.txt', 'txt'), (2, 'sub/', '.docx', 'docx'), (3, '', '.TXT', 'unsupported'))
        AS m(member, prefix, suffix, route) WHERE doc_id % 5 = 3))"""


@query("extract_dispatch", f"SELECT * FROM ({_SQL_READ})")
def extract_dispatch(spark, sf_dir):
    return read_documents(uploads(spark, sf_dir), {"docx": decode_docx}).select(
        "request_id", "source_seq", "archive", "member", "name", "route", "status", "content", "unique_id")


_SQL_LAST = """row_number() OVER (PARTITION BY request_id, name, status = 'ok'
      ORDER BY source_seq DESC, member DESC, unique_id DESC) = 1"""


@query("ingest_report", f"""SELECT route, status, count(*) AS files,
    count(*) FILTER (WHERE status = 'ok' AND NOT is_last) AS overwritten
  FROM (SELECT *, {_SQL_LAST} AS is_last FROM ({_SQL_READ})) GROUP BY route, status""")
def ingest_report(spark, sf_dir):
    read = read_documents(uploads(spark, sf_dir), {"docx": decode_docx}).drop("content")
    return report_of(materialize(read, "read"))


_SQL_FULL = f"""WITH documents_read AS ({_SQL_READ}),
  latest AS (SELECT * FROM (SELECT *, {_SQL_LAST} AS is_last FROM documents_read) WHERE status = 'ok' AND is_last),
  features AS ({_SQL_FEATURES}),
  aspects AS (SELECT *, {_sql_aspects("content")} AS key_aspects FROM latest),
  scored AS (SELECT a.*, {sql_score("coalesce(a.key_aspects, '')", "f.job_features")} AS reply
             FROM aspects a JOIN features f USING (request_id))
SELECT request_id, unique_id, name, content, unique_id || '_' || name AS file_path,
  {sql.clean("coalesce(key_aspects, '')")} AS key_feature, coalesce({sql.parse_score("reply")}, '0') AS score
FROM scored"""


@query("full_batch", _SQL_FULL)
def full_batch(spark, sf_dir):
    """Uploads of several formats, from bytes to scores, through the raw-file and results tables."""
    return score_batch(uploads(spark, sf_dir), jobs(spark, sf_dir), stub_models(), new_results_table(spark), "load1",
                       raw_path=new_folder(spark, "raw"), raw_digits=1)


@query("full_batch_table", f"""WITH answers AS ({_SQL_FULL})
SELECT d.unique_id, d.name AS resume_name, d.content AS resume_content, a.key_feature AS resume_key_aspect,
  TRY_CAST(a.score AS INTEGER) AS score
FROM ({_SQL_READ}) d LEFT JOIN answers a ON a.unique_id = d.unique_id WHERE d.status = 'ok'""")
def full_batch_table(spark, sf_dir):
    """The results table after the batch: overwritten files are in it, without a score."""
    store = new_results_table(spark)
    score_batch(uploads(spark, sf_dir), jobs(spark, sf_dir), stub_models(), store, "load1")
    return store.load("load1")
