"""From file rows to cleaned documents: route, expand, decode, clean, identify."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfolio.functions.naming import (ARCHIVE_FORMAT, FORMATS, UNSUPPORTED, make_id, route_format,
                                         route_format_archive, stored_key)
from tallyfolio.functions.text import clean_text
from tallyfolio.sources.archives import expand_archives, expand_listed
from tallyfolio.sources.decode_helper import DecodeLimits
from tallyfolio.sources.decoders import Decoder, decode_text, decode_with, default_decoders
from tallyfolio.sources.files import read_listed

OK = "ok"
UNREADABLE = "unreadable"
NO_DECODER = "no_decoder"

# Member number of a file that came in no archive.
LOOSE = -1


def identify_files(files: DataFrame) -> DataFrame:
    """Loose files and archive members in one frame, each with route, id and stored key.

    Needs ``(request_id, source_seq, name, content)``; ``status``, ``media_type``, ``is_archive`` and ``path`` are used
    if they are there. The path is part of the id: files of one name and time in two folders are two files. Rows with an
    ``archive`` (and ``member``, ``error``) are members that have been taken out of it already.
    """
    with_path = "path" in files.columns
    taken_out = None
    if "archive" in files.columns:
        taken_out = files.filter("archive IS NOT NULL")
        files = files.filter("archive IS NULL").drop("archive", "member", "error")
    if "status" not in files.columns:
        files = files.withColumn("status", F.lit(None).cast("string"))
    media_type = F.col("media_type") if "media_type" in files.columns else None
    routed = files.withColumn("route", route_format(F.col("name"), media_type))
    if "is_archive" not in files.columns:
        routed = routed.withColumn("is_archive", F.col("route") == ARCHIVE_FORMAT)
    none = F.lit(None)
    place = ["path"] if with_path else []
    loose = routed.filter(~F.col("is_archive")).select(
        "request_id", "source_seq", none.cast("string").alias("archive"), F.lit(LOOSE).alias("member"),
        "name", "content", none.cast("string").alias("error"), "route", "status", *place)
    archives = routed.filter("is_archive")
    opened = expand_archives(archives.filter(F.col("status").isNull()), ["request_id", "source_seq", *place])
    if taken_out is not None:
        opened = opened.unionByName(taken_out.select(*opened.columns))
    # An archive that could not be opened has no member name; it is reported under its own.
    members = opened.select(
        "request_id", "source_seq", "archive", "member", F.coalesce("name", "archive").alias("name"), "content",
        "error", F.when(F.col("member").isNull(), ARCHIVE_FORMAT)
        .otherwise(route_format_archive(F.col("name"))).alias("route"), none.cast("string").alias("status"), *place)
    hidden = archives.filter(F.col("status").isNotNull()).select(
        "request_id", "source_seq", none.cast("string").alias("archive"), F.lit(LOOSE).alias("member"),
        "name", "content", none.cast("string").alias("error"), "route", "status", *place)
    unique_id = make_id(*[F.col(c) for c in ("request_id", "archive", "member", "name", "source_seq", *place)])
    return (loose.unionByName(members).unionByName(hidden)
            .withColumn("unique_id", unique_id)
            .withColumn("file_path", stored_key(F.col("unique_id"), F.col("name"))).drop(*place))


def read_uploads(listing: DataFrame) -> DataFrame:
    """Files of a listing (see ``read_listed``) with a ``request_id``, archives of any size already expanded."""
    media_type = F.col("media_type") if "media_type" in listing.columns else None
    usable = F.col("status").isNull() if "status" in listing.columns else F.lit(True)
    is_archive = usable & (route_format(F.col("name"), media_type) == ARCHIVE_FORMAT)
    members = expand_listed(listing.filter(is_archive), ["request_id", "source_seq", "path"])
    loose = read_listed(listing.filter(~is_archive))
    return loose.unionByName(members.withColumn("is_archive", F.lit(False)), allowMissingColumns=True)


def storable(identified: DataFrame) -> DataFrame:
    """``(file_path, content)`` of the files that belong in the raw-file table: all of a supported format."""
    kept = F.col("status").isNull() & F.col("content").isNotNull() & F.col("route").isin(FORMATS)
    return identified.filter(kept).select("file_path", "content")


def decode_files(identified: DataFrame, decoders: Mapping[str, Decoder] | None = None, limits: DecodeLimits = DecodeLimits()) -> DataFrame:
    """Every file with its cleaned ``content`` and a ``status``; no file is lost.

    A file that cannot be read, or not within the limits, has NULL content and an error: the error text is not taken for
    the content.
    """
    table = default_decoders() if decoders is None else dict(decoders)
    decoded = identified.withColumn("decoded", decode_with(F.col("route"), F.col("content"), table, limits))
    is_text = F.col("route") == "txt"
    text = F.when(is_text, decode_text(F.col("content"))).otherwise(F.col("decoded.text"))
    error = F.coalesce(F.col("error"), F.col("decoded.error"),
                       F.when(is_text & F.col("content").isNotNull() & text.isNull(), F.lit("invalid UTF-8")))
    status = (F.when(F.col("status").isNotNull(), F.col("status"))
              .when(F.col("route") == UNSUPPORTED, F.lit(UNSUPPORTED))
              .when(error.isNotNull(), F.lit(UNREADABLE))
              .when(~F.col("route").isin("txt", *table), F.lit(NO_DECODER))
              .otherwise(F.lit(OK)))
    return decoded.select("request_id", "source_seq", "archive", "member", "unique_id", "name", "route", "file_path",
                          clean_text(text).alias("content"), status.alias("status"), error.alias("error"))


def read_documents(files: DataFrame, decoders: Mapping[str, Decoder] | None = None, limits: DecodeLimits = DecodeLimits()) -> DataFrame:
    """Identify and decode."""
    return decode_files(identify_files(files), decoders, limits)
