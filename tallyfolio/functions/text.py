"""Text cleaning and score parsing as built-in column expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a tag, an address, a kept character (ASCII letters and digits) and a score.
# Java matches its own class Alnum about eight times as fast as a union of ranges, whose interface checks also
# keep the threads of an executor waiting for each other.
TAG = r"<[^>]*>"
URL = r"https?://[a-z$-_!]+"
NOT_KEPT = r"[^\p{Alnum} ]"
NOT_KEPT_RUN = r"\P{Alnum}+"
SCORE = r"\p{Nd}{2}"
SCORE_FULL_RANGE = r"100|\p{Nd}{1,2}"
WORD = r"\p{L}\p{N}_"
NO_SCORE = "0"


def strip_tags(text: Column) -> Column:
    """Replace each ``<...>`` (also across lines) by a blank.

    Only the part up to the last ``>`` can hold a whole tag. Searching just that part keeps the work
    linear: otherwise each unclosed ``<`` would scan to the end of the text again.
    """
    tail = F.substring_index(text, ">", -1)
    head = F.substr(text, F.lit(1), F.length(text) - F.length(tail))
    return F.concat(F.regexp_replace(head, TAG, " "), tail)


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, " ")


def strip_special(text: Column) -> Column:
    return F.regexp_replace(text, NOT_KEPT, " ")


def collapse_ws(text: Column) -> Column:
    """Collapse runs of white space and trim both ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_text(text: Column) -> Column:
    """Tags, then addresses, then special characters, then white space.

    The last two steps are one pass here: a run of characters outside ``[a-zA-Z0-9]`` becomes a
    single blank. Texts without ``>`` or ``://`` skip the first two (blanks for tags join nothing to a new
    ``://``). NULL stays NULL.
    """
    untagged = F.when(F.contains(text, F.lit(">")), strip_tags(text)).otherwise(text)
    plain = F.when(F.contains(text, F.lit("://")), strip_urls(untagged)).otherwise(untagged)
    return F.trim(F.regexp_replace(plain, NOT_KEPT_RUN, " "))


def _first_number(reply: Column, number: str) -> Column:
    # The character before the number is matched, not looked back at: Java's look-behind takes half of a
    # character outside the basic plane, and its \b has another idea of a word than Unicode's letters and numbers.
    found = F.regexp_extract(reply, f"(?:^|[^{WORD}])({number})(?![{WORD}])", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(NO_SCORE))


def parse_score(reply: Column) -> Column:
    """First stand-alone two-digit number of a reply as text, ``"0"`` where there is none.

    A reply of ``100`` has no two-digit number and therefore gives ``"0"``; see
    :func:`parse_score_full_range` for the variant that reads 0 to 100.
    """
    return _first_number(reply, SCORE)


def parse_score_full_range(reply: Column) -> Column:
    return _first_number(reply, SCORE_FULL_RANGE)


def score_int(score: Column) -> Column:
    """Score text to INTEGER; text that is no number gives NULL instead of ending the job."""
    return score.try_cast("int")
