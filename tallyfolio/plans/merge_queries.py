"""Registered queries: merge, lookup and the final record."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfolio.operators import merge
from tallyfolio.operators.jobs import attach_jobs, attach_single_job
from tallyfolio.plans import sql
from tallyfolio.plans.registry import query
from tallyfolio.plans.samples import documents, jobs, pages, resumes, table


@query("last_write_wins", """SELECT source, lang, doc_id, text FROM documents
  QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) = 1""")
def last_write_wins(spark, sf_dir):
    return merge.last_write_wins(
        table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "text"), ["source", "lang"], ["doc_id"])


@query("merge_sources", """SELECT name, seq, content, source_rank FROM (
    SELECT 'f' || (doc_id % 400) AS name, doc_id AS seq, text AS content, 0 AS source_rank FROM documents
    UNION ALL SELECT 'f' || (page_id % 500), page_id, html, 1 FROM pages)
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY source_rank DESC, seq DESC) = 1""")
def merge_sources(spark, sf_dir):
    loose = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("f"), F.col("doc_id") % 400).alias("name"), F.col("doc_id").alias("seq"),
        F.col("text").alias("content"))
    packed = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("f"), F.col("page_id") % 500).alias("name"), F.col("page_id").alias("seq"),
        F.col("html").alias("content"))
    return merge.merge_sources([loose, packed], ["name"], ["seq"])


@query("jd_broadcast", f"""SELECT d.doc_id AS source_seq, d.request_id, b.text AS jd_text
  FROM (SELECT doc_id, {sql.REQUEST} AS request_id FROM documents) d
  LEFT JOIN benchmark b ON b.item_id = d.request_id""")
def jd_broadcast(spark, sf_dir):
    rows = resumes(spark, sf_dir).select("source_seq", "request_id", "unique_id")
    return attach_jobs(rows, jobs(spark, sf_dir)).select("source_seq", "request_id", "jd_text")


@query("jd_single", """SELECT doc_id, n_chars, (SELECT text FROM benchmark ORDER BY item_id DESC LIMIT 1) AS jd_text
  FROM documents""")
def jd_single(spark, sf_dir):
    newest = jobs(spark, sf_dir).agg(F.max_by("jd_text", "request_id").alias("jd_text"))
    return attach_single_job(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), newest, "jd_text")


@query("drop_failed", "SELECT doc_id, CAST(toxic AS VARCHAR) AS reply FROM labels WHERE quality = 1")
def drop_failed(spark, sf_dir):
    replies = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, F.col("toxic").cast("string")).alias("reply"))
    return merge.drop_failed(replies, "reply")


@query("lookup_default", """SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS reply
  FROM documents d LEFT JOIN labels l USING (doc_id)""")
def lookup_default(spark, sf_dir):
    replies = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("reply"))
    return merge.lookup_default(table(spark, sf_dir, "documents").select("doc_id"), replies, ["doc_id"], "reply")


@query("final_record", f"""SELECT source || '.txt' AS name, text AS content, 'k' || doc_id AS file_path,
    {sql.clean("CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END")} AS key_feature,
    CASE WHEN doc_id % 7 = 0 THEN '0' ELSE {sql.parse_score("'Score: ' || (n_chars % 110)")} END AS score
  FROM documents""")
def final_record(spark, sf_dir):
    docs = documents(spark, sf_dir)
    aspects = F.when(F.col("doc_id") % 9 != 0, F.col("text"))
    reply = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("Score: "), F.col("n_chars") % 110))
    return docs.select(*merge.final_record(F.concat("source", F.lit(".txt")), F.col("text"),
                                           F.concat(F.lit("k"), "doc_id"), aspects, reply))
