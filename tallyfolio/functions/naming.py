"""Format routes, deterministic ids, stored keys and data URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The readable formats, the archive format, and the media type of every data URL.
FORMATS = ["pdf", "txt", "docx", "doc"]
ARCHIVE_FORMAT = "zip"
ARCHIVE_MEDIA_TYPE = "application/zip"
UNSUPPORTED = "unsupported"
DATA_URL_PREFIX = "data:application/pdf;base64,"

# Separator of the parts that are hashed into an id; it cannot be typed into a file name by accident.
_PART = "\x1f"


def route_format(name: Column, media_type: Column | None = None) -> Column:
    """Route of a loose file: its last dot segment, lower-cased; archives also by media type."""
    extension = F.lower(F.substring_index(name, ".", -1))
    is_archive = extension == ARCHIVE_FORMAT
    if media_type is not None:
        is_archive = is_archive | F.coalesce(media_type == ARCHIVE_MEDIA_TYPE, F.lit(False))
    return (F.when(is_archive, ARCHIVE_FORMAT)
            .when(extension.isin(FORMATS), extension)
            .otherwise(UNSUPPORTED))


def route_format_archive(name: Column) -> Column:
    """Route of an archive member: exact, case-sensitive suffix; an archive inside is unsupported."""
    route = F.lit(UNSUPPORTED)
    for extension in FORMATS:
        route = F.when(name.endswith("." + extension), extension).otherwise(route)
    return route


def make_id(*parts: Column) -> Column:
    """36-character id from the parts that identify a file in a batch.

    A hash, not a random number: a retried task must give a file the same id again.
    """
    texts = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    digest = F.md5(F.concat_ws(_PART, *texts).cast("binary"))
    return F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def stored_key(unique_id: Column, name: Column) -> Column:
    return F.concat_ws("_", unique_id, name)


def parse_id(key: Column) -> Column:
    """Leading run of ``[a-f0-9-]`` of a stored key; empty text where there is none."""
    return F.regexp_extract(key, "^[a-f0-9-]+", 0)


def data_url(content: Column) -> Column:
    """Whole content as a data URL on one line (Spark's ``base64`` breaks lines, the URL must not)."""
    return F.concat(F.lit(DATA_URL_PREFIX), F.translate(F.base64(content), "\r\n", ""))
