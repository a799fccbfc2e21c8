"""Resumes, job descriptions and upload files derived from whole input tables.

The derivation is column work or one narrow pass over the rows, so it grows with the tables.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfolio.functions.naming import make_id
from tallyfolio.slices import all_slices
from tallyfolio.sources.files import file_system
from tallyfolio.workspace import materialize, new_folder, spread_small

DEGREES = ["no degree", "a Bachelor degree", "a Master degree", "a Doctorate"]
EXTENSIONS = ["pdf", "txt", "docx", "doc", "ZIP", "tar.GZ", "TXT", "rtf"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small(table(spark, sf_dir, "documents"), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small(table(spark, sf_dir, "pages"), "page_id")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("request_id"), F.col("text").alias("jd_text"))


def with_request(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Spread the documents over the job descriptions; their number is a scalar subquery."""
    count = table(spark, sf_dir, "benchmark").agg(F.count("*").alias("n")).scalar()
    return docs.withColumn("request_id", F.pmod(F.col("doc_id"), count))


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(request_id, source_seq, name, unique_id, content)``: names repeat within a request."""
    docs = with_request(spark, sf_dir, documents(spark, sf_dir))
    name = F.concat(F.lit("cv"), F.col("n_chars") % 97, F.lit(".txt"))
    return docs.select(
        "request_id", F.col("doc_id").alias("source_seq"), name.alias("name"),
        make_id(F.col("request_id"), F.lit(""), F.lit(-1), name, F.col("doc_id")).alias("unique_id"),
        F.col("text").alias("content"))


def resume_text():
    """Document text with stated years, degree and results appended, as a resume would have them."""
    degree = F.element_at(F.array(*[F.lit(d) for d in DEGREES]), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    return F.concat(F.col("text"), F.lit("\n"), F.pmod("doc_id", F.lit(40)), F.lit("+ years in "), F.col("source"),
                    F.lit(", "), degree, F.lit(". Led "), F.pmod("n_chars", F.lit(9)), F.lit(" teams."))


_DOCX_HEAD = ('<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w='
              '"http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>')
_DOCX_TABLE = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"


def docx_bytes(text: str) -> bytes:
    """Minimal DOCX: one paragraph per line and a table, whose text a reader must leave out."""
    legal = "".join(c if c >= " " or c in "\t\n\r" else " " for c in text)
    paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>'
                         for line in legal.split("\n"))
    return zip_bytes([("word/document.xml", f"{_DOCX_HEAD}{paragraphs}{_DOCX_TABLE}</w:body></w:document>".encode())])


def zip_bytes(members: list[tuple[str, bytes]]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in members:
            archive.writestr(name, content)
    return buffer.getvalue()


def upload_of(number: int, stem: str, text: str) -> tuple[str, bytes]:
    """Upload number ``number``: text, upper-case text, DOCX, ZIP, and in turn unsupported or broken text."""
    data = text.encode()
    kind = number % 5
    if kind == 0:
        return f"{stem}.txt", data
    if kind == 1:
        return f"{stem}.TXT", data
    if kind == 2:
        return f"{stem}.docx", docx_bytes(text)
    if kind == 3:
        return f"pack{number}.zip", zip_bytes([
            (f"{stem}.txt", data), ("sub/", b""), (f"sub/{stem}.docx", docx_bytes(text)), (f"{stem}.TXT", data)])
    return (f"{stem}.xyz", data) if number % 10 == 4 else (f"{stem}.txt", b"\xff" + data)


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(request_id, source_seq, name, content)``: every document as an uploaded file, packed once and stored."""
    docs = with_request(spark, sf_dir, documents(spark, sf_dir)).select(
        "request_id", F.col("doc_id").alias("source_seq"),
        F.concat(F.lit("cv"), F.col("n_chars") % 97).alias("stem"), "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in all_slices(batches):
            files = [upload_of(*row) for row in zip(*(batch[c].to_pylist() for c in ("source_seq", "stem", "text")))]
            yield pa.RecordBatch.from_pydict({
                "request_id": batch["request_id"], "source_seq": batch["source_seq"],
                "name": pa.array([name for name, _ in files], pa.string()), "content": pa.array([content for _, content in files], pa.binary())})

    packed = docs.mapInArrow(pack, "request_id long, source_seq long, name string, content binary")
    return materialize(packed, "uploads")


def stored_files(spark: SparkSession, sf_dir: str) -> str:
    """A tree in the shared folder with a file for every document; returns its root.

    Some names begin with ``_`` or ``.``, some files are empty, one in seven has no supported format.
    """
    folder = new_folder(spark, "files")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        for batch in all_slices(batches):
            for number, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                empty = number % 11 == 0
                place = f"{base}/d{number % 16}" + ("/sub" if number % 3 == 0 else "")
                system.create_dir(place, recursive=True)
                name = ("", "_", ".", "", "")[number % 5] + f"cv{number // 16}" + (".xyz" if number % 7 == 5 and not empty else ".txt")
                with system.open_output_stream(f"{place}/{name}") as file:
                    file.write(b"" if empty else text.encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    documents(spark, sf_dir).select("doc_id", "text").mapInArrow(store, "n long").agg(F.sum("n")).first()
    return folder
