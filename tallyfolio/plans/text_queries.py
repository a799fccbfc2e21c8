"""Registered queries: routes, ids, keys, text cleaning, score parsing, data URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfolio.functions import naming, text
from tallyfolio.plans import sql
from tallyfolio.plans.registry import query
from tallyfolio.plans.samples import EXTENSIONS, documents, pages, table
from tallyfolio.workspace import spread_small


def _names(spark, sf_dir):
    endings = F.array(*[F.lit(e) for e in EXTENSIONS])
    number = F.pmod("doc_id", F.lit(len(EXTENSIONS) + 1)).cast("int")
    name = F.when(number == len(EXTENSIONS), F.concat(F.lit("pdf"), F.col("doc_id"))).otherwise(
        F.concat(F.lit("r"), "doc_id", F.lit("."), F.get(endings, number)))
    media = F.when(F.pmod("doc_id", F.lit(11)) == 0, "application/zip").otherwise("application/octet-stream")
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), media.alias("media_type"))


_SQL_NAMES = f"""SELECT doc_id,
  CASE WHEN doc_id % {len(EXTENSIONS) + 1} = {len(EXTENSIONS)} THEN 'pdf' || doc_id
       ELSE 'r' || doc_id || '.' || list_extract({EXTENSIONS}, CAST(doc_id % {len(EXTENSIONS) + 1} AS INT) + 1)
  END AS name,
  CASE WHEN doc_id % 11 = 0 THEN 'application/zip' ELSE 'application/octet-stream' END AS media_type
FROM documents"""


@query("route_format", f"""SELECT doc_id, name, CASE
    WHEN media_type = 'application/zip' OR extension = 'zip' THEN 'zip'
    WHEN extension IN ('pdf', 'txt', 'docx', 'doc') THEN extension ELSE 'unsupported' END AS route
  FROM (SELECT *, lower(regexp_extract(name, '([^.]*)$', 1)) AS extension FROM ({_SQL_NAMES}))""")
def route_format(spark, sf_dir):
    return _names(spark, sf_dir).select(
        "doc_id", "name", naming.route_format(F.col("name"), F.col("media_type")).alias("route"))


@query("route_format_archive", f"""SELECT doc_id, name, CASE
    WHEN suffix(name, '.pdf') THEN 'pdf' WHEN suffix(name, '.txt') THEN 'txt'
    WHEN suffix(name, '.docx') THEN 'docx' WHEN suffix(name, '.doc') THEN 'doc'
    ELSE 'unsupported' END AS route FROM ({_SQL_NAMES})""")
def route_format_archive(spark, sf_dir):
    return _names(spark, sf_dir).select(
        "doc_id", "name", naming.route_format_archive(F.col("name")).alias("route"))


def _ids(spark, sf_dir):
    name = F.concat("source", F.lit("_"), "lang", F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", name.alias("name"),
        naming.make_id(F.lit("batch"), F.col("source"), name, F.col("doc_id")).alias("unique_id"))


_SQL_IDS = f"""SELECT doc_id, name, {sql.make_id("'batch'", "source", "name", "doc_id")} AS unique_id
  FROM (SELECT doc_id, source, source || '_' || lang || '.txt' AS name FROM documents)"""


@query("make_id", _SQL_IDS)
def make_id(spark, sf_dir):
    return _ids(spark, sf_dir)


@query("stored_key", f"SELECT doc_id, unique_id || '_' || name AS file_path FROM ({_SQL_IDS})")
def stored_key(spark, sf_dir):
    return _ids(spark, sf_dir).select(
        "doc_id", naming.stored_key(F.col("unique_id"), F.col("name")).alias("file_path"))


@query("parse_id", f"""SELECT doc_id, unique_id, regexp_extract(name, '^[a-f0-9-]+') AS text_id
  FROM ({_SQL_IDS})""")
def parse_id(spark, sf_dir):
    ids = _ids(spark, sf_dir)
    key = naming.stored_key(F.col("unique_id"), F.col("name"))
    return ids.select("doc_id", naming.parse_id(key).alias("unique_id"),
                      naming.parse_id(F.col("name")).alias("text_id"))


@query("clean_text", f"SELECT doc_id, {sql.clean('text')} AS content FROM documents")
def clean_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.clean_text(F.col("text")).alias("content"))


_SQL_PAGE = "(html || ' see ' || url || ' end')"


def _page_text():
    return F.concat("html", F.lit(" see "), "url", F.lit(" end"))


@query("clean_text_pages", f"SELECT page_id, {sql.clean(_SQL_PAGE)} AS content FROM pages")
def clean_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", text.clean_text(_page_text()).alias("content"))


@query("clean_text_conversations", f"SELECT conv_id, turn, {sql.clean('text')} AS content FROM conversations")
def clean_conversations(spark, sf_dir):
    return spread_small(table(spark, sf_dir, "conversations"), "conv_id").select(
        "conv_id", "turn", text.clean_text(F.col("text")).alias("content"))


@query("strip_tags", f"SELECT page_id, {sql.strip_tags('html')} AS content FROM pages")
def strip_tags(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", text.strip_tags(F.col("html")).alias("content"))


@query("strip_urls", f"SELECT page_id, {sql.strip_urls(_SQL_PAGE)} AS content FROM pages")
def strip_urls(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", text.strip_urls(_page_text()).alias("content"))


@query("strip_special", f"SELECT doc_id, {sql.strip_special('text')} AS content FROM documents")
def strip_special(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.strip_special(F.col("text")).alias("content"))


@query("collapse_ws", f"""SELECT doc_id, trim(regexp_replace({sql.strip_special('text')}, ' +', ' ', 'g')) AS content
  FROM documents""")
def collapse_ws(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", text.collapse_ws(text.strip_special(F.col("text"))).alias("content"))


@query("parse_score", f"SELECT event_id, {sql.parse_score('props')} AS score FROM events")
def parse_score(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.parse_score(F.col("props")).alias("score"))


@query("parse_score_documents", f"SELECT doc_id, {sql.parse_score('text')} AS score FROM documents")
def parse_score_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.parse_score(F.col("text")).alias("score"))


@query("parse_score_pages", f"SELECT page_id, {sql.parse_score('html')} AS score FROM pages")
def parse_score_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", text.parse_score(F.col("html")).alias("score"))


@query("score_int", f"""SELECT event_id, TRY_CAST({sql.parse_score('props')} AS INTEGER) AS score,
    CASE WHEN regexp_matches(event_type, '^[0-9]+$') THEN CAST(event_type AS INTEGER) END AS no_number FROM events""")
def score_int(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", text.score_int(text.parse_score(F.col("props"))).alias("score"),
        text.score_int(F.col("event_type")).alias("no_number"))


@query("data_url", """SELECT doc_id, 'data:application/pdf;base64,' || base64(encode(text)) AS pdf_url
  FROM documents""")
def data_url(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", naming.data_url(F.col("text").cast("binary")).alias("pdf_url"))
