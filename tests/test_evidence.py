from __future__ import annotations

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import plan_of
from tallyfolio.functions import evidence as ev
from tallyfolio.functions.prompts import LEVELS, OUTLINE
from tallyfolio.operators import evidence, rubric, term_matcher

FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def texts(spark, values):
    return evidence.with_words(spark.createDataFrame(list(enumerate(values)), "i int, t string"), "t")


def column(frame, expression):
    return [r.x for r in frame.select("i", expression.alias("x")).sort("i").collect()]


def test_rubric_sums():
    assert sum(rubric.section_max(s) for s in rubric.POINTS) == 100
    assert [rubric.section_max(s) for s in rubric.POINTS] == [16, 63, 21]
    assert sum(ladder[-1] for ladder in rubric.criteria().values()) == 22
    assert len(rubric.rubric_rows()) == 25


def test_prompt_levels_follow_the_rubric():
    assert {c: len(ladder) for c, ladder in rubric.criteria().items()} == {c: len(v) for c, v in LEVELS.items()}
    assert [c for _, names in OUTLINE.values() for c in names] == list(rubric.criteria())


def ratings(spark, levels):
    return spark.createDataFrame([(u, c, level) for u, by in levels.items() for c, level in by.items()],
                                 "unique_id string, criterion string, level int")


def test_totals(spark):
    best = {c: 1 for c in rubric.criteria()}
    worst = {c: len(ladder) for c, ladder in rubric.criteria().items()}
    rated = ratings(spark, {"best": best, "worst": worst, "part": {"2.2": 3, "3.1": 9}})
    ids = spark.createDataFrame([("best",), ("worst",), ("part",), ("none",)], "unique_id string")
    totals = {r.unique_id: r.total for r in rubric.rubric_total(ids, rated).collect()}
    assert totals == {"best": 100, "worst": 22, "part": 15, "none": 0}
    sections = {r.unique_id: tuple(r)[1:] for r in rubric.rubric_sections(ids, rated).collect()}
    assert sections == {"best": (16, 63, 21), "worst": (3, 13, 6), "part": (0, 15, 0), "none": (0, 0, 0)}


def test_points_of_a_row_equal_the_rating_table(spark):
    names = list(rubric.criteria())
    wide = spark.range(60).select(F.concat(F.lit("u"), "id").alias("unique_id"), *[
        ((F.col("id") * (k + 3)) % 5).cast("int").alias(f"level_{c}") for k, c in enumerate(names)])
    direct = {r.unique_id: r.total for r in evidence.level_total(wide).select("unique_id", "total").collect()}
    pairs = F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"`level_{c}`").alias("level")) for c in names])
    long = wide.select("unique_id", F.inline(pairs))
    table = {r.unique_id: r.total for r in rubric.rubric_total(wide.select("unique_id"), long).collect()}
    assert direct == table


WORDS = st.lists(st.sampled_from(["a", "b", "B", "ab", "abc", "", "c d", "é", "7", "\n"]), max_size=40).map(" ".join)


@FEW
@given(st.lists(WORDS, min_size=20, max_size=60))
def test_term_frequency_equals_a_counter(spark, values):
    frame = texts(spark, values)
    rows = frame.select("i", "words").collect()
    expected = {r.i: sorted(((-n, t) for t, n in Counter(r.words).items())) for r in rows}
    got: dict = {i: [] for i in expected}
    for r in evidence.term_frequency(frame, "i", "t").collect():
        got[r.i].append((-r.n, r.term))
    assert {i: sorted(v) for i, v in got.items()} == expected
    top: dict = {i: [] for i in expected}
    for r in evidence.term_frequency(frame, "i", "t", top=2).collect():
        top[r.i].append((-r.n, r.term))
    assert {i: sorted(v) for i, v in top.items()} == {i: v[:2] for i, v in expected.items()}


@FEW
@given(st.lists(WORDS, min_size=20, max_size=60))
def test_phrases_equal_containment(spark, values):
    phrases = ["a b", "B", "ab abc", "c-d a", "a a", "abc", "", " ", "a b"]
    cleaned = ["a b", "b", "ab abc", "c d a", "a a", "abc"]
    frame = texts(spark, values)
    rows = frame.select("i", "clean").sort("i").collect()
    expected = [sum(f" {p} " in f" {r.clean.lower()} " for p in cleaned) for r in rows]
    assert column(frame, ev.phrase_hits(F.col("words"), phrases)) == expected
    assert column(frame, ev.phrase_hits(F.col("words"), [])) == [0] * len(rows)


def test_years_numbers_and_degrees(spark):
    frame = texts(spark, ["5+ years and 12 years", "1 year", "100 years", "years", "", "3 yearsold 2 years"])
    assert column(frame, ev.years_of_experience(F.col("clean"))) == [12, 1, None, None, None, 2]
    assert column(frame, ev.number_count(F.col("clean"))) == [2, 1, 1, 0, 0, 2]
    ranks = ev.ranked_terms({"Bachelor": 1, "master's": 2, "": 9})
    frame = texts(spark, ["Master's and Bachelor", "BACHELOR", "mastery", ""]).withColumn("phrases", ev.phrases(F.col("words"), 2))
    assert column(frame, ev.highest_rank(F.col("phrases"), ranks)) == [2, 1, 0, 0]


def test_dictionary_goes_through_the_same_cleaning(spark):
    frame = texts(spark, ["C++ and Node.js and 5+ years", "c"])
    terms = ev.term_array(["C++", "C#", "Python", "?"])
    assert column(frame, F.size(ev.matched(F.col("words"), terms))) == [1, 1]
    assert column(frame, F.size(terms)) == [2, 2]


JOB = "Needs C, R, Go, SQL, AWS and problem-solving. 3 years."
TERMS = [(1, "skill", "C", True, None), (1, "skill", "SQL", True, None), (1, "skill", "AWS", False, None), (1, "skill", "SQL ", True, None),
         (1, "soft_skill", "problem-solving", None, None), (1, "role", "data engineer", None, None), (1, "certification", "PMP", None, None),
         (None, "action", "Led", None, None), (None, "degree", "Master of Science", None, 2), (1, "skill", "!!", True, None)]


TERM_SCHEMA = "request_id int, kind string, term string, critical boolean, rank int"


def judged(spark, *resumes):
    """Documents with the numbers of their job, and the dictionary."""
    jobs = spark.createDataFrame([(1, JOB), (2, "nothing asked")], "request_id int, jd_text string")
    terms = evidence.cleaned_dictionary(spark.createDataFrame(TERMS, TERM_SCHEMA))
    rows = evidence.with_words(spark.createDataFrame([(i, r, t) for i, (r, t) in enumerate(resumes)], "i int, request_id int, t string"), "t")
    return rows.join(evidence.job_needs(jobs, terms), "request_id"), terms


def test_dictionary_of_a_job_keeps_short_terms_and_phrases(spark):
    rows, terms = judged(spark, (1, "Led a team; problem solving in SQL on aws"), (1, "data-engineer, PMP, c"), (2, "Led"), (1, ""))
    counts = {r.i: r for r in evidence.keyword_counts(rows, terms, "i", ["i"]).collect()}
    assert (counts[0].skills_found, counts[0].critical_skills_found, counts[0].soft_skills_found, counts[0].actions_found) == (2, 1, 1, 1)
    assert (counts[1].skills_found, counts[1].roles_found, counts[1].certifications_found) == (1, 1, 1)
    assert (counts[0].skills_wanted, counts[0].critical_skills_wanted, counts[2].skills_wanted, counts[2].actions_found) == (3, 2, 0, 1)
    assert counts[3].skills_found == 0 and len(counts) == 4


def test_levels_follow_the_dictionary_and_the_years_of_the_job(spark):
    rows, terms = judged(spark, (1, "data engineer PMP 3 years Master of Science led 5"), (1, "2 years"), (1, "1 year"), (2, "1 year"))
    levels = {r.i: r for r in evidence.rubric_levels(rows, terms, "i", ["i"]).collect()}
    assert [levels[i]["level_2.1"] for i in range(4)] == [1, 2, 3, 1]
    assert [levels[i]["level_1.2"] for i in range(2)] == [1, 3] and [levels[i]["level_3.2"] for i in range(2)] == [1, 3]
    assert (levels[0]["level_3.1"], levels[0]["level_1.3"]) == (1, 1)


def brute_found(dictionary, request, clean):
    """Terms as whole words of a text, each kind by itself."""
    held = [(kind, term, critical, rank or 0) for r, kind, term, critical, rank in dictionary
            if r in (None, request) and f" {term} " in f" {clean.lower()} "]
    counts = [len({t for k, t, _, _ in held if k == kind}) for kind in term_matcher.KINDS]
    return [*counts, len({t for k, t, critical, _ in held if k == "skill" and critical}), max([0, *(n for k, _, _, n in held if k == "degree")])]


DICTIONARY = st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.sampled_from([*term_matcher.KINDS, "degree", "other"]),
                                st.sampled_from(["a", "a b", "a b c", "b", "c d a", "ab", "7", "abc a", "b b"]), st.booleans(),
                                st.sampled_from([None, 1, 2, 5])), max_size=25)


@FEW
@given(DICTIONARY, st.lists(st.tuples(st.sampled_from([None, 1, 2, 3]), WORDS), min_size=5, max_size=20))
def test_walk_and_join_find_the_same_terms(spark, dictionary, texts_):
    terms = evidence.cleaned_dictionary(spark.createDataFrame(dictionary, TERM_SCHEMA))
    rows = evidence.with_words(spark.createDataFrame([(i, *pair) for i, pair in enumerate(texts_)], "i int, request_id int, t string"), "t").cache()
    distinct = [tuple(r) for r in terms.collect()]
    wanted = {r.i: brute_found(distinct, r.request_id, r.clean) for r in rows.collect()}
    for limit in (term_matcher.TERM_ROWS, -1):
        got = term_matcher.with_found(rows, terms, "i", max_rows=limit).select("i", "found").collect()
        assert {r.i: list(r.found) for r in got} == wanted
    rows.unpersist()


def test_a_large_dictionary_is_not_copied_into_rows(spark):
    """100,000 terms of one job: what goes to Python and what comes back stays narrow."""
    terms = spark.range(100_000).select(F.lit(1).alias("request_id"), F.lit("skill").alias("kind"), F.concat(F.lit("w"), "id", F.lit(" x")).alias("term"),
                                        F.lit(False).alias("critical"), F.lit(1).alias("rank"))
    rows = spark.range(2000).select("id", F.lit(1).alias("request_id"), F.concat(F.lit("w"), "id", F.lit(" x W5 X w7")).alias("clean"))
    found = term_matcher.with_found(rows, terms, "id")
    plan = plan_of(found.select("id", "found.skills", "found.degree", "found.roles"))
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan and "array" not in plan
    assert {r.skills: r.n for r in found.groupBy("found.skills").agg(F.count("*").alias("n")).collect()} == {2: 1999, 1: 1}


def test_outcomes(spark):
    frame = texts(spark, ["Led 5 people", "led people", "5 people", "misled 5"])
    got = evidence.outcome_counts(frame, "i", ["led", "designed"]).sort("i").collect()
    assert [tuple(r)[1:] for r in got] == [(1, 1, True), (1, 0, False), (0, 1, False), (0, 1, False)]


def test_levels(spark):
    assert column(texts(spark, ["x"]), ev.share_level(F.lit(0), F.lit(0), [0.5])) == [2]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate([10, 9, 5, 4, None])], "i int, v int")
    assert column(frame, ev.floor_level(F.col("v"), [10, 5])) == [1, 2, 2, 3, 3]
    assert column(frame.filter("v is not null"), ev.share_level(F.col("v"), F.lit(10), [1.0, 0.5])) == [1, 2, 2, 3]


def test_evidence_needs_no_shuffle(spark):
    rows, terms = judged(spark, (1, "a b"), (2, "c"))
    plain = spark.createDataFrame([(0, 1, "a b")], "i int, request_id int, clean string").select(
        "*", F.lit(3).alias("wanted_years"), *[F.lit(1).alias(f"{c}_wanted") for c in term_matcher.COUNTED])
    levels = evidence.rubric_levels(plain, terms, "i", ["i"])
    for result in (evidence.level_total(levels), evidence.term_frequency(rows, "i", "t", 3)):
        assert "Exchange" not in plan_of(result).replace("BroadcastExchange", "")


def test_no_filter_evaluates_the_cleaning_again(spark):
    """A generator over computed arrays must not bring a filter on their size below the projections."""
    frame = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None)], "i int, t string")
    for top in (None, 2):
        got = evidence.term_frequency(frame, "i", "t", top)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Filter" in line and "regexp_replace" in line for line in plan.splitlines())
        assert plan.count("array_sort") + plan.count("sort_array") == 2
        assert sorted(map(tuple, got.collect())) == [(1, "a", 1), (1, "b", 2)]
