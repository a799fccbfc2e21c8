"""Evidence of documents against the dictionary of their job, and its way to rubric levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfolio.functions import evidence as ev
from tallyfolio.functions.text import clean_text
from tallyfolio.operators.rubric import criteria, points_of
from tallyfolio.operators.term_matcher import COUNTED, CRITICAL, KINDS, with_found
from tallyfolio.workspace import materialize

NO_YEARS = 1    # what a job asks for that states no years


def cleaned_dictionary(dictionary: DataFrame) -> DataFrame:
    """``(request_id, kind, term, critical, rank)`` with terms as they occur in cleaned text; empty terms are dropped."""
    return (dictionary.select("request_id", "kind", ev.clean_term(F.col("term")).alias("term"),
                              F.coalesce("critical", F.lit(False)).alias("critical"), F.coalesce("rank", F.lit(1)).alias("rank"))
            .filter("term <> ''").distinct())


def job_needs(jobs: DataFrame, cleaned: DataFrame) -> DataFrame:
    """``request_id``, ``wanted_years`` and, for each counted column, how many terms the job has; no terms.

    Terms without a request count for every job. Nothing is cut: short terms such as "C" or "R" are terms, and which
    skills are critical is said by the dictionary.
    """
    wanted = jobs.select("request_id", ev.years_of_experience(clean_text(F.col("jd_text"))).alias("wanted_years"))
    as_column = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    counted = cleaned.select("request_id", "term", as_column[F.col("kind")].alias("column")).unionByName(
        cleaned.filter("kind = 'skill' AND critical").select("request_id", "term", F.lit(CRITICAL).alias("column"))).filter("column IS NOT NULL").distinct()
    shared = counted.filter("request_id IS NULL").drop("request_id")
    own = counted.filter("request_id IS NOT NULL").join(shared, ["term", "column"], "left_anti")     # a term counts once

    def sizes(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(*[F.count_if(F.col("column") == c).cast("int").alias(c) for c in COUNTED])

    everywhere = sizes(shared).select(F.struct(*COUNTED)).scalar()      # one row
    joined = wanted.join(sizes(own, "request_id"), "request_id", "left")
    return materialize(joined.select(
        "request_id", F.coalesce("wanted_years", F.lit(NO_YEARS)).alias("wanted_years"),
        *[(F.coalesce(c, F.lit(0)) + everywhere[c]).alias(f"{c}_wanted") for c in COUNTED]), "job_needs")


def with_words(documents: DataFrame, text: str) -> DataFrame:
    """Add ``clean`` and ``words``, evaluated once per row."""
    return documents.withColumn("clean", clean_text(F.col(text))).withColumn("words", ev.tokens(F.col("clean")))


def keyword_counts(documents: DataFrame, dictionary: DataFrame, key: str, keep: Sequence[str]) -> DataFrame:
    """Per kind how many terms of the job occur and how many there are; needs ``clean`` and the columns of ``job_needs``."""
    found = with_found(documents, dictionary, key)
    return found.select(*keep, *[F.col(f"found.{c}").alias(f"{c}_found") for c in COUNTED], *[f"{c}_wanted" for c in COUNTED])


def term_frequency(documents: DataFrame, key: str, text: str, top: int | None = None) -> DataFrame:
    """``(key, term, n)``, the most frequent terms first by ``(n desc, term)``; ``top`` makes it a top-k.

    All of it happens inside the row, so there is no shuffle, whatever the number of words. The outer generator keeps a
    filter on the array's size from being derived, which would evaluate the sorting and cleaning once more for each element.
    """
    words = documents.select(key, F.sort_array(ev.tokens(clean_text(F.col(text)))).alias("words"))
    starts = words.select(key, "words", ev.run_starts(F.col("words")).alias("starts"))
    runs = starts.select(key, F.sort_array(ev.term_runs(F.col("words"), F.col("starts"))).alias("runs"))
    kept = F.col("runs") if top is None else F.slice("runs", 1, top)
    return runs.select(key, F.inline_outer(kept)).filter(F.col("term").isNotNull()).select(key, "term", (-F.col("minus")).alias("n"))


def outcome_counts(documents: DataFrame, key: str, action_words: Sequence[str]) -> DataFrame:
    """Action words and numbers in each document (from ``with_words``), and whether both are there."""
    found = ev.matched(ev.phrases(F.col("words"), ev.longest(action_words)), ev.term_array(action_words))
    counted = documents.select(key, F.size(found).alias("action_words"), ev.number_count(F.col("clean")).alias("numbers"))
    return counted.withColumn("measurable", (F.col("action_words") > 0) & (F.col("numbers") > 0))


def rubric_levels(documents: DataFrame, dictionary: DataFrame, key: str, keep: Sequence[str]) -> DataFrame:
    """Level of each criterion from counted evidence; needs ``clean`` and the columns of ``job_needs``.

    The shares and floors are parameters of this package. One pass over the rows.
    """
    counted = with_found(documents, dictionary, key).select(
        *keep, *[F.col(f"found.{c}").alias(f"_{c}") for c in COUNTED], *[F.col(f"{c}_wanted").alias(f"_{c}_wanted") for c in COUNTED],
        F.col("found.degree").alias("_degree"), ev.number_count(F.col("clean")).alias("_numbers"),
        ev.years_of_experience(F.col("clean")).alias("_years"), "wanted_years")
    clarity = (F.when((F.col("_actions") > 0) & (F.col("_numbers") > 0), 1)
               .when((F.col("_actions") > 0) | (F.col("_numbers") > 0), 2).otherwise(3))

    def share(column: str, floors: list[float]):
        return ev.share_level(F.col(f"_{column}"), F.col(f"_{column}_wanted"), floors)

    levels = {
        "1.1": share("skills", [0.5, 0.25]),
        "1.2": share("roles", [0.5, 0.125]),
        "1.3": clarity,
        "2.1": ev.years_level(F.col("_years"), F.col("wanted_years")),
        "2.2": share("critical_skills", [0.5, 0.25, 0.125]),
        "2.3": ev.floor_level(F.col("_soft_skills"), [3, 1]),
        "3.1": ev.floor_level(F.col("_degree"), [2, 1]),
        "3.2": share("certifications", [0.5, 0.125]),
    }
    return counted.select(*keep, *[level.cast("int").alias(f"level_{c}") for c, level in levels.items()])


def level_total(levels: DataFrame) -> DataFrame:
    """Add ``total``: the points of a row's own level columns, without a join or a rating table."""
    return levels.withColumn("total", points_of({c: F.col(f"`level_{c}`") for c in criteria()}))
