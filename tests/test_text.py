from __future__ import annotations

import re
import sys
import time
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfolio.functions import naming, text


def model_clean(value: str) -> str:
    """The cleaning contract in plain Python."""
    for pattern in (r"<[^>]*>", r"https?://[!$-_a-z]+", r"[^a-zA-Z0-9 ]"):
        value = re.sub(pattern, " ", value)
    return " ".join(value.split())


def model_score(value: str) -> str:
    found = re.search(r"\b\d{2}\b", value)
    return found.group() if found else "0"


def apply(spark, function, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, v string").repartition(8)
    return [row.r for row in rows.select("i", function(F.col("v")).alias("r")).sort("i").collect()]


SCORES = {
    "85": "85", "Score: 85": "85", "85/100": "85", "85%": "85", "8.55": "55", "99.5": "99", "-42": "42",
    "10:30": "10", "12 34": "12", "00": "00", "100": "0", "5": "0", "007": "0", "1,000": "0", "85th": "0",
    "Score_85": "0", "é85": "0", "": "0", "٨٥": "٨٥", "１２": "１２", "85é": "0", "a\n85\nb": "85",
}

TEXTS = [
    "a < b and c > d", "<b", "x<http://a.b>y", "see https://a.b/c?d=e%20f#frag z", "HTTP://UP.x y", "http://é.fr",
    "naïve café—ok", "smile \U0001f600 end", 'http://x"q', "   ", "", "a_b\tc\r\nd", "http://", "https://a.b/,next word",
    "<p\nq>z", "C++ C# Node.js 5+ years 20%", "a>b<c", ">", "<", "<>", "a<<b>>c", "http://a<b>c", "ht<b>tp://x y",
    "http://" + "a" * 100_000 + " end", "é" * 300 + "<x>" + "é" * 300,
]


@pytest.mark.parametrize("values, function, model", [
    (TEXTS, text.clean_text, model_clean),
    (list(SCORES), text.parse_score, SCORES.get),
    (list(SCORES), text.parse_score, model_score),
])
def test_golden_rows(spark, values, function, model):
    assert apply(spark, function, values) == [model(value) for value in values]


def test_null_stays_null(spark):
    assert apply(spark, text.clean_text, [None]) == [None]


ALPHABET = st.text(alphabet=st.one_of(
    st.sampled_from(list("<>/:.ahtps0189 _-%\n\t\"#é٣")), st.characters(exclude_categories=["Cs"])), max_size=60)
FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@FEW
@given(st.lists(ALPHABET, min_size=50, max_size=200))
def test_clean_text_equals_model(spark, values):
    cleaned = apply(spark, text.clean_text, values)
    assert cleaned == [model_clean(value) for value in values]
    assert all(re.fullmatch(r"([a-zA-Z0-9]+( [a-zA-Z0-9]+)*)?", value) for value in cleaned)
    assert apply(spark, text.clean_text, cleaned) == cleaned


@FEW
@given(st.lists(st.text(alphabet=st.sampled_from(list("0189 _-.%aé٣²½一")), max_size=12), min_size=50, max_size=200))
def test_parse_score_equals_model(spark, values):
    assert apply(spark, text.parse_score, values) == [model_score(value) for value in values]


def test_score_boundaries_over_all_characters(spark):
    """Which characters may stand next to a score: every code point, as far as both Unicode tables know it."""
    unassigned = {c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Cn", "Cs", "Co")}
    points = [c for c in range(1, sys.maxunicode + 1) if c not in unassigned]
    frame = spark.createDataFrame([(c, chr(c) + "85") for c in points], "c int, v string")
    apart = {r.c for r in frame.filter(text.parse_score(F.col("v")) != "0").select("c").collect()}
    expected = {c for c in points if model_score(chr(c) + "85") != "0"}
    # Characters newer than the Java runtime's Unicode version are the only ones that may differ.
    assert expected <= apart
    assert all(unicodedata.category(chr(c))[0] in "LN" for c in apart - expected)
    assert len(apart - expected) < 0.1 * len(points)


def test_full_range_variant(spark):
    values = ["100", "5", "Score 0.", "101", "007", "42"]
    assert apply(spark, text.parse_score_full_range, values) == ["100", "5", "0", "0", "0", "42"]


def test_score_int(spark):
    assert apply(spark, text.score_int, ["85", "00", "x", None, "٨٥"])[:4] == [85, 0, None, None]


def test_unclosed_tags_cost_linear_time(spark):
    began = time.time()
    assert apply(spark, text.clean_text, ["<" * 2_000_000]) == [""]
    assert time.time() - began < 20


def test_steps_compose_to_clean_text(spark):
    step = lambda c: text.collapse_ws(text.strip_special(text.strip_urls(text.strip_tags(c))))
    assert apply(spark, step, TEXTS) == apply(spark, text.clean_text, TEXTS)


def test_routes(spark):
    names = ["a.b.PDF", "noext", "pdf", "x.docx", "x.DOC", "x.zip", "x.ZIP", ".txt", "x.", "x.tar.gz"]
    assert apply(spark, naming.route_format, names) == [
        "pdf", "unsupported", "pdf", "docx", "doc", "zip", "zip", "txt", "unsupported", "unsupported"]
    assert apply(spark, naming.route_format_archive, names) == [
        "unsupported", "unsupported", "unsupported", "docx", "unsupported", "unsupported", "unsupported", "txt",
        "unsupported", "unsupported"]
    by_type = lambda c: naming.route_format(c, F.lit("application/zip"))
    assert apply(spark, by_type, ["x.pdf"]) == ["zip"]


def test_ids_are_stable_distinct_and_parsed_back(spark):
    rows = spark.range(2000).select(naming.make_id(F.lit("b"), F.lit(None), F.col("id"), F.lit("n")).alias("u"))
    first = {row.u for row in rows.collect()}
    assert len(first) == 2000 and first == {row.u for row in rows.repartition(3).collect()}
    assert all(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", u) for u in first)
    back = rows.select("u", naming.parse_id(naming.stored_key(F.col("u"), F.lit("cafe.txt"))).alias("p"))
    assert back.filter("u <> p").count() == 0
    assert apply(spark, naming.parse_id, ["Z_x", ""]) == ["", ""]


def test_ids_tell_parts_apart(spark):
    row = spark.range(1).select(naming.make_id(F.lit("ab"), F.lit("c")).alias("x"),
                                naming.make_id(F.lit("a"), F.lit("bc")).alias("y"),
                                naming.make_id(F.lit(None), F.lit("a")).alias("p"),
                                naming.make_id(F.lit("a"), F.lit(None)).alias("q")).first()
    assert len(set(row)) == 4


def test_data_url_is_one_line(spark):
    import base64
    data = bytes(range(256)) * 50
    row = spark.createDataFrame([(data,)], "c binary").select(naming.data_url(F.col("c")).alias("u")).first()
    assert row.u == "data:application/pdf;base64," + base64.b64encode(data).decode()
