"""Registered queries: rubric totals and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfolio.functions import evidence as ev
from tallyfolio.functions.text import clean_text
from tallyfolio.operators import evidence, rubric
from tallyfolio.operators.jobs import attach_jobs
from tallyfolio.plans import sql
from tallyfolio.plans.registry import query
from tallyfolio.plans.samples import documents, jobs, resume_text, table, with_request
from tallyfolio.workspace import materialize

# Dictionaries of the evidence queries (inputs of the operators; chosen for the sample tables).
PHRASES = ["of the", "in the", "and the", "of", "reread", "it is on", "de la", "the that are", "Of-The", ""]
ACTION_WORDS = ["Led", "and", "with the", "designed"]
DEGREES = {"Bachelor": 1, "master": 2, "a Doctorate": 3}
ALL_JOBS = [("soft_skill", "Teams", 0), ("soft_skill", "the", 0), ("soft_skill", "que", 0), ("soft_skill", "of the", 0), ("action", "Led", 0), ("action", "and", 0)]

_SQL_RATINGS = """SELECT doc_id, criterion, CAST((doc_id + step) % levels AS INTEGER) + 1 AS level FROM documents,
    (VALUES ('1.1', 0, 3), ('1.2', 1, 3), ('1.3', 2, 3), ('2.1', 3, 3), ('2.2', 4, 4), ('2.3', 5, 3), ('3.1', 6, 3),
            ('3.2', 7, 3)) AS criteria(criterion, step, levels) WHERE n_chars >= 300"""
_SQL_RUBRIC = ("(VALUES " + ", ".join(f"('{s}', '{c}', {level}, {points})" for s, c, level, points
                                       in rubric.rubric_rows()) + ") AS rubric(section, criterion, level, points)")


def _ratings(spark, sf_dir):
    """Ratings derived from the documents; short ones have none and count as unscorable."""
    criteria = [(c, len(ladder)) for c, ladder in rubric.criteria().items()]
    pairs = F.array(*[F.struct(F.lit(c).alias("criterion"),
                               (F.pmod(F.col("doc_id") + step, F.lit(n)) + 1).cast("int").alias("level"))
                      for step, (c, n) in enumerate(criteria)])
    return (table(spark, sf_dir, "documents").filter("n_chars >= 300").select("doc_id", F.inline(pairs)))


@query("rubric_total", f"""SELECT d.doc_id, CAST(coalesce(t.total, 0) AS INTEGER) AS total FROM documents d LEFT JOIN
  (SELECT doc_id, sum(points) AS total FROM ({_SQL_RATINGS}) r
   JOIN {_SQL_RUBRIC} ON rubric.criterion = r.criterion AND rubric.level = r.level GROUP BY doc_id) t
  ON t.doc_id = d.doc_id""")
def rubric_total(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("doc_id")
    return rubric.rubric_total(ids, _ratings(spark, sf_dir), "doc_id")


@query("rubric_sections", f"""SELECT d.doc_id,
    CAST(coalesce(sum(points) FILTER (WHERE section = '1'), 0) AS INTEGER) AS section_1,
    CAST(coalesce(sum(points) FILTER (WHERE section = '2'), 0) AS INTEGER) AS section_2,
    CAST(coalesce(sum(points) FILTER (WHERE section = '3'), 0) AS INTEGER) AS section_3
  FROM documents d LEFT JOIN ({_SQL_RATINGS}) r ON r.doc_id = d.doc_id
  LEFT JOIN {_SQL_RUBRIC} ON rubric.criterion = r.criterion AND rubric.level = r.level GROUP BY d.doc_id""")
def rubric_sections(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("doc_id")
    return rubric.rubric_sections(ids, _ratings(spark, sf_dir), "doc_id")


def _words(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "n_chars", resume_text().alias("resume"))
    return evidence.with_words(docs, "resume")


def _job_texts(spark, sf_dir):
    """Job descriptions that ask for some years of experience, as many as their number says."""
    years = F.concat(F.lit("\nAt least "), F.pmod("request_id", F.lit(45)), F.lit(" years."))
    return jobs(spark, sf_dir).withColumn("jd_text", F.concat("jd_text", years))


def _dictionary(spark, sf_dir):
    """Terms of each job by their place in its text, and terms of all jobs."""
    # Written down: otherwise the text would be cleaned again for every word of it.
    words = materialize(jobs(spark, sf_dir).select("request_id", F.split(clean_text(F.col("jd_text")), " ").alias("w")), "job_words")
    placed = words.select("request_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    word, none = F.element_at("w", F.col("i")), F.lit(None)
    pair = F.concat_ws("-", word, F.get("w", F.col("i")))

    def term(kind, value, critical):
        return F.struct(F.lit(kind).alias("kind"), value.alias("term"), critical.alias("critical"))

    kinds = F.array(F.when(F.col("i") % 3 == 0, term("skill", word, F.col("i") % 2 == 0)),
                    F.when(F.col("i") % 7 == 1, term("role", pair, F.lit(False))),
                    F.when(F.col("i") % 11 == 2, term("certification", F.upper(word), F.lit(False))))
    own = placed.select("request_id", F.inline(F.array_compact(kinds)), none.cast("int").alias("rank"))
    everywhere = spark.createDataFrame([(None, kind, term, False, rank) for kind, term, rank in
                                        [*ALL_JOBS, *(("degree", term, rank) for term, rank in DEGREES.items())]], own.schema)
    return evidence.cleaned_dictionary(own.unionAll(everywhere))


def _with_needs(spark, sf_dir):
    """Documents with the numbers of their job, and the dictionary of all jobs."""
    dictionary = materialize(_dictionary(spark, sf_dir), "dictionary")
    rows = with_request(spark, sf_dir, _words(spark, sf_dir)).drop("words")
    return attach_jobs(rows, evidence.job_needs(_job_texts(spark, sf_dir), dictionary), salt_on="doc_id"), dictionary


def _sql_words() -> str:
    return (f"SELECT *, list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS phrases "
            f"FROM (SELECT doc_id, {sql.REQUEST} AS request_id, n_chars, clean, {sql.words('clean')} AS words FROM "
            f"(SELECT doc_id, n_chars, {sql.clean(sql.resume_text())} AS clean FROM documents))")


def _sql_terms(condition: str, term: str, common: list[str] = ()) -> str:
    """Terms of one kind for the job ``item_id``, cleaned and without repeats."""
    more = "".join(f", '{c}'" for c in common)
    return (f"list_filter(list_distinct(list_concat(list_transform(list_filter(range(1, len(w) + 1), lambda i: {condition}), lambda i: lower({term})), "
            f"[''{more}])), lambda t: t <> '')")


_SQL_TERMS = f"""SELECT item_id AS request_id, CASE WHEN item_id % 45 = 0 THEN 0 ELSE item_id % 45 END AS wanted_years,
    {_sql_terms("i % 3 = 0", "w[i]")} AS skills, {_sql_terms("i % 6 = 0", "w[i]")} AS critical_skills,
    {_sql_terms("i % 7 = 1", "CASE WHEN i < len(w) THEN w[i] || ' ' || w[i + 1] ELSE w[i] END")} AS roles,
    {_sql_terms("i % 11 = 2", "w[i]")} AS certifications,
    {_sql_terms("false", "''", ["teams", "the", "que", "of the"])} AS soft_skills, {_sql_terms("false", "''", ["led", "and"])} AS actions
  FROM (SELECT item_id, string_split({sql.clean('text')}, ' ') AS w FROM benchmark)"""


def _sql_found(column: str) -> str:
    return f"CAST(len(list_distinct(list_intersect({column}, phrases))) AS INTEGER)"


_COLUMNS = ["skills", "soft_skills", "roles", "certifications", "actions", "critical_skills"]


@query("evidence_keywords", f"""SELECT doc_id, {", ".join(f"{_sql_found(c)} AS {c}_found, CAST(len({c}) AS INTEGER) AS {c}_wanted" for c in _COLUMNS)}
  FROM ({_sql_words()}) d JOIN ({_SQL_TERMS}) t USING (request_id)""")
def evidence_keywords(spark, sf_dir):
    rows, dictionary = _with_needs(spark, sf_dir)
    return evidence.keyword_counts(rows, dictionary, "doc_id", ["doc_id"])


@query("evidence_phrases", f"""SELECT doc_id, CAST(len(list_intersect({sorted({p.lower().replace("-", " ") for p in PHRASES} - {""})},
    list_concat(phrases, list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])))) AS INTEGER) AS phrases
  FROM ({_sql_words()})""")
def evidence_phrases(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", ev.phrase_hits(F.col("words"), PHRASES).alias("phrases"))


@query("evidence_term_freq", f"""SELECT doc_id, term, CAST(n AS INTEGER) AS n FROM
  (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(words) AS term FROM ({_sql_words()}))
   GROUP BY doc_id, term)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) <= 10""")
def evidence_term_freq(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", resume_text().alias("resume"))
    return evidence.term_frequency(docs, "doc_id", "resume", top=10)


@query("evidence_all_terms", f"""SELECT doc_id, term, CAST(count(*) AS INTEGER) AS n FROM
  (SELECT doc_id, unnest(words) AS term FROM ({_sql_words()})) GROUP BY doc_id, term""")
def evidence_all_terms(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", resume_text().alias("resume"))
    return evidence.term_frequency(docs, "doc_id", "resume")


@query("evidence_years", f"""SELECT doc_id, list_max(list_transform(
    regexp_extract_all(clean, '\\b([0-9]{{1,2}}) years?\\b', 1), lambda n: CAST(n AS INTEGER))) AS years
  FROM ({_sql_words()})""")
def evidence_years(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", ev.years_of_experience(F.col("clean")).alias("years"))


_SQL_ACTIONS = f"CAST(len(list_distinct(list_intersect(phrases, {[w.lower() for w in ACTION_WORDS]}))) AS INTEGER)"
_SQL_NUMBERS = "CAST(len(regexp_extract_all(clean, '[0-9]+')) AS INTEGER)"


@query("evidence_outcomes", f"""SELECT doc_id, {_SQL_ACTIONS} AS action_words, {_SQL_NUMBERS} AS numbers,
    {_SQL_ACTIONS} > 0 AND {_SQL_NUMBERS} > 0 AS measurable FROM ({_sql_words()})""")
def evidence_outcomes(spark, sf_dir):
    return evidence.outcome_counts(_words(spark, sf_dir), "doc_id", ACTION_WORDS)


_SQL_DEGREE = ("CASE WHEN list_contains(phrases, 'a doctorate') THEN 3 WHEN list_contains(words, 'master') THEN 2 "
               "WHEN list_contains(words, 'bachelor') THEN 1 ELSE 0 END")


@query("evidence_education", f"SELECT doc_id, {_SQL_DEGREE} AS degree FROM ({_sql_words()})")
def evidence_education(spark, sf_dir):
    found = ev.phrases(F.col("words"), ev.longest(DEGREES))
    return _words(spark, sf_dir).select("doc_id", ev.highest_rank(found, ev.ranked_terms(DEGREES)).alias("degree"))


def _sql_share(found: str, wanted: str, floors: list[float]) -> str:
    steps = " ".join(f"WHEN {wanted} > 0 AND {found} >= {wanted} * {floor} THEN {level}"
                     for level, floor in enumerate(floors, start=1))
    return f"CASE {steps} ELSE {len(floors) + 1} END"


_SQL_LEVELS = f"""SELECT doc_id, {_sql_share("skills_found", "len(skills)", [0.5, 0.25])} AS l11,
    {_sql_share("roles_found", "len(roles)", [0.5, 0.125])} AS l12,
    CASE WHEN actions_found > 0 AND numbers > 0 THEN 1 WHEN actions_found > 0 OR numbers > 0 THEN 2 ELSE 3 END AS l13,
    CASE WHEN years >= wanted_years THEN 1 WHEN years * 2 >= wanted_years THEN 2 ELSE 3 END AS l21,
    {_sql_share("critical_skills_found", "len(critical_skills)", [0.5, 0.25, 0.125])} AS l22,
    CASE WHEN soft_skills_found >= 3 THEN 1 WHEN soft_skills_found >= 1 THEN 2 ELSE 3 END AS l23,
    CASE WHEN degree >= 2 THEN 1 WHEN degree = 1 THEN 2 ELSE 3 END AS l31,
    {_sql_share("certifications_found", "len(certifications)", [0.5, 0.125])} AS l32
  FROM (SELECT *, {", ".join(f"{_sql_found(c)} AS {c}_found" for c in _COLUMNS)}, {_SQL_NUMBERS} AS numbers,
      list_max(list_transform(regexp_extract_all(clean, '\\b([0-9]{{1,2}}) years?\\b', 1),
                              lambda n: CAST(n AS INTEGER))) AS years, {_SQL_DEGREE} AS degree
    FROM ({_sql_words()}) d JOIN ({_SQL_TERMS}) t USING (request_id))"""


@query("evidence_score", f"""SELECT doc_id, CAST(list_extract([6, 3, 1], l11) + list_extract([5, 3, 1], l12)
    + list_extract([5, 3, 1], l13) + list_extract([15, 10, 5], l21) + list_extract([39, 25, 15, 5], l22)
    + list_extract([9, 7, 3], l23) + list_extract([16, 10, 5], l31) + list_extract([5, 3, 1], l32) AS INTEGER)
    AS total FROM ({_SQL_LEVELS})""")
def evidence_score(spark, sf_dir):
    rows, dictionary = _with_needs(spark, sf_dir)
    levels = evidence.rubric_levels(rows, dictionary, "doc_id", ["doc_id"])
    return evidence.level_total(levels).select("doc_id", "total")
