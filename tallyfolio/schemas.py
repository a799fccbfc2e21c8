"""Declared schemas of every table the package reads or writes (nothing is inferred)."""

from __future__ import annotations

import re

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("source_seq", T.LongType()),
    T.StructField("archive", T.StringType()),
    T.StructField("member", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("content", T.BinaryType()),
])

RESULTS = T.StructType([
    T.StructField("unique_id", T.StringType(), False),
    T.StructField("resume_name", T.StringType()),
    T.StructField("resume_content", T.StringType()),
    T.StructField("resume_key_aspect", T.StringType()),
    T.StructField("score", T.IntegerType()),
])

RAW_FILES = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("content", T.BinaryType()),
])

RUBRIC = T.StructType([
    T.StructField("section", T.StringType(), False),
    T.StructField("criterion", T.StringType(), False),
    T.StructField("level", T.IntegerType(), False),
    T.StructField("points", T.IntegerType(), False),
])

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

CHAT_REPLY = T.StructType([
    T.StructField("choices", T.ArrayType(T.StructType([T.StructField("message", MESSAGE)]))),
])

STAGE_REPLIES = T.StructType([
    T.StructField("unique_id", T.StringType()),
    T.StructField("call_key", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("error", T.StringType()),
])

MAX_NAME_CHARS = 100

_LOAD_ID = re.compile(r"[A-Za-z0-9_-]+")


def checked_load(load_id: str) -> str:
    """The load id, if it can be a folder name."""
    if not _LOAD_ID.fullmatch(load_id):
        raise ValueError(f"not a load id: {load_id!r}")
    return load_id


# Section -> criterion -> points by level (level 1 is best).
POINTS = {
    "1": {"1.1": [6, 3, 1], "1.2": [5, 3, 1], "1.3": [5, 3, 1]},
    "2": {"2.1": [15, 10, 5], "2.2": [39, 25, 15, 5], "2.3": [9, 7, 3]},
    "3": {"3.1": [16, 10, 5], "3.2": [5, 3, 1]},
}
UNSCORABLE = 0


def section_max(section: str) -> int:
    return sum(ladder[0] for ladder in POINTS[section].values())
