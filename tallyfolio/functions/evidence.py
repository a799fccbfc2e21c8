"""Facts counted from cleaned text, one row at a time: no join, no explode, no shuffle.

All functions take cleaned text, its words, or its phrases (all runs of up to so many words). Dictionaries go
through the same cleaning as the text, so "problem-solving" or "Led" match as they are written. A per-row
``array`` column works as dictionary as well, which is how the terms of a document's own job are matched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfolio.functions.text import clean_text


def tokens(clean: Column) -> Column:
    """Lower-case words of cleaned text; empty text has no words."""
    return F.array_remove(F.split(F.lower(clean), " "), "")


def clean_term(term: Column) -> Column:
    """A dictionary term as it can occur in cleaned text; empty if nothing of it can."""
    return F.lower(clean_text(term))


def term_array(terms: Iterable[str]) -> Column:
    """Dictionary literal, cleaned like the text it is matched with, without repeats and empty terms."""
    literal = F.array(*[F.lit(term) for term in terms]).cast("array<string>")
    return F.array_remove(F.array_distinct(F.transform(literal, clean_term)), "")


def longest(terms: Iterable[str]) -> int:
    """Most words that a term of the list can have after cleaning, at least 1."""
    return max([1, *(len(re.findall("[a-zA-Z0-9]+", term)) for term in terms)])


def grams(words: Column, n: int) -> Column:
    """All runs of ``n`` words, joined by a blank."""
    if n == 1:
        return words
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def phrases(words: Column, most: int) -> Column:
    """All runs of 1 to ``most`` words."""
    return words if most == 1 else F.concat(*[grams(words, n) for n in range(1, most + 1)])


def matched(found: Column, terms: Column) -> Column:
    """Terms of the dictionary that occur among the words or phrases (each once)."""
    return F.array_intersect(terms, found)


def phrase_hits(words: Column, wanted: Sequence[str]) -> Column:
    """How many different phrases of a fixed list occur among the words of a text.

    Give a plain column of words: an expression would be evaluated for every phrase.
    """
    return F.size(matched(phrases(words, longest(wanted)), term_array(wanted)))


def run_starts(sorted_words: Column) -> Column:
    """Positions (from 1) at which a new word starts in a sorted word array.

    Give a plain column, not the sorting expression: lambdas evaluate what is inside them per element.
    """
    size = F.size(sorted_words)
    positions = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return F.filter(positions, lambda i: (i == 1) | (F.get(sorted_words, i - 1) != F.get(sorted_words, i - 2)))


def term_runs(sorted_words: Column, starts: Column) -> Column:
    """``array<struct<minus, term>>``: equal words are neighbours, so the distance of run starts is the count.

    The count is negative, so that the natural order of the structs is ``(count desc, term)``.
    """
    ends = F.concat(F.slice(starts, 2, F.size(sorted_words)), F.array(F.size(sorted_words) + 1))
    runs = F.zip_with(starts, ends, lambda start, end: F.struct(
        (start - end).alias("minus"), F.get(sorted_words, start - 1).alias("term")))
    return F.when(F.size(sorted_words) > 0, runs)


def years_of_experience(clean: Column) -> Column:
    """Largest stand-alone ``N years`` (one or two digits); NULL if there is none."""
    found = F.regexp_extract_all(clean, F.lit(r"\b([0-9]{1,2}) years?\b"), F.lit(1))
    return F.array_max(F.transform(found, lambda n: n.cast("int")))


def number_count(clean: Column) -> Column:
    return F.regexp_count(clean, F.lit("[0-9]+"))


def highest_rank(found: Column, ranked: Column) -> Column:
    """Highest rank of the terms ``array<struct<term, rank>>`` among the words or phrases, 0 if there is none."""
    hits = F.filter(ranked, lambda t: F.array_contains(found, t["term"]))
    return F.coalesce(F.array_max(F.transform(hits, lambda t: t["rank"])), F.lit(0))


def ranked_terms(ranks: dict[str, int]) -> Column:
    """Dictionary literal of terms with ranks, cleaned."""
    pairs = F.array(*[F.struct(clean_term(F.lit(term)).alias("term"), F.lit(rank).alias("rank")) for term, rank in ranks.items()])
    return F.filter(pairs, lambda t: t["term"] != "")


def share_level(found: Column, wanted: Column, floors: Sequence[float]) -> Column:
    """Level 1, 2, ... by the share ``found / wanted``; ``floors`` are the least shares, best first."""
    level = F.lit(len(floors) + 1)
    for number, floor in reversed(list(enumerate(floors, start=1))):
        level = F.when(found >= wanted * F.lit(floor), F.lit(number)).otherwise(level)
    return F.when(wanted > 0, level).otherwise(F.lit(len(floors) + 1))


def years_level(years: Column, wanted: Column) -> Column:
    """1 for at least the wanted years, 2 for at least half of them, else 3; NULL counts as none stated."""
    return F.when(years >= wanted, 1).when(years * 2 >= wanted, 2).otherwise(3)


def floor_level(value: Column, floors: Sequence[int]) -> Column:
    """Level by absolute floors, best first; NULL counts as below all floors."""
    level = F.lit(len(floors) + 1)
    for number, floor in reversed(list(enumerate(floors, start=1))):
        level = F.when(F.coalesce(value, F.lit(-1)) >= floor, F.lit(number)).otherwise(level)
    return level
