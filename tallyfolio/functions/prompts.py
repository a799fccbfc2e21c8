"""Prompt templates, chat requests and chat replies as column expressions.

The default prompts are worded for this package around the fixed outline and rubric below; pass any
other text with ``{placeholders}`` to :class:`Prompt` to use your own.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfolio.schemas import CHAT_REPLY, POINTS, UNSCORABLE, section_max

# Sections and points of the outline, as asked of the model in all three prompts.
OUTLINE = {
    "1": ("Candidate Profile", {
        "1.1": "Keywords",
        "1.2": "Past Roles and Responsibilities",
        "1.3": "Clarity and Measurable Achievements",
    }),
    "2": ("Experience", {
        "2.1": "Years of Experience",
        "2.2": "Technical Skills",
        "2.3": "Communication and Teamwork",
    }),
    "3": ("Educational Qualifications and Certifications", {
        "3.1": "Educational Qualifications",
        "3.2": "Certifications and Training",
    }),
}

# Parameters of a chat request (one message, sent in this role).
ROLE = "system"
MODEL = "gpt-4o-mini"
TEMPERATURE = 0.1
MAX_TOKENS = None

# What each level of a criterion means, best first: in the shares and floors that this package counts by itself.
LEVELS = {
    "1.1": ["half of the job's skill terms or more occur", "a quarter or more", "less than a quarter"],
    "1.2": ["half of the role titles listed for the job or more occur", "an eighth or more", "less than an eighth, or none are listed"],
    "1.3": ["both action words and numbers occur", "only one of the two", "neither"],
    "2.1": ["the stated years reach those of the job", "they reach half of them", "less, or no years are stated"],
    "2.2": ["half of the terms marked critical or more occur", "a quarter or more", "an eighth or more", "less than an eighth"],
    "2.3": ["three soft skills of the list or more occur", "one or two", "none"],
    "3.1": ["a degree of rank 2 or above", "a degree of rank 1", "no degree of the list"],
    "3.2": ["half of the certifications listed for the job or more occur", "an eighth or more", "less than an eighth, or none are listed"],
}


def _outline_text() -> str:
    lines = []
    for section, (title, points) in OUTLINE.items():
        lines.append(f"{section}. {title}")
        lines += [f"   {point} {name}" for point, name in points.items()]
    return "\n".join(lines)


def _rubric_text() -> str:
    lines = []
    for section, (title, names) in OUTLINE.items():
        lines.append(f"{section}. {title} (at most {section_max(section)} points)")
        for criterion, ladder in POINTS[section].items():
            lines.append(f"   {criterion} {names[criterion]} (at most {ladder[0]})")
            lines += [f"      {points}: {meaning}" for points, meaning in zip(ladder, LEVELS[criterion])]
    return "\n".join(lines)


class Prompt:
    """A text with ``{placeholders}``, split once; rendering is one ``concat`` of literals and columns.

    Values are inserted as they are: a placeholder that occurs inside a value is not filled again.
    ``{{`` and ``}}`` stand for single braces.
    """

    def __init__(self, text: str):
        self.text = text
        self.parts = [(literal, field) for literal, field, _, _ in Formatter().parse(text)]
        self.fields = list(dict.fromkeys(field for _, field in self.parts if field is not None))

    def render(self, **inputs: Column) -> Column:
        missing = [field for field in self.fields if field not in inputs]
        if missing:
            raise KeyError(f"no value for {missing}")
        pieces = []
        for literal, field in self.parts:
            if literal:
                pieces.append(F.lit(literal))
            if field is not None:
                pieces.append(inputs[field].cast("string"))
        return F.concat(*pieces) if pieces else F.lit("")


JOB_PROMPT = Prompt(f"""Job description:
{{job_description_text}}

List what a candidate needs for this job, as short bullet points under the headings below. Under each
heading keep what is required apart from what is only preferred, name the terms that occur often, and
write nothing that the job description does not say.

{_outline_text()}
""")

RESUME_PROMPT = Prompt(f"""Resume:
{{resume_text}}

List what this resume states, as short bullet points under the headings below. Name measured results,
action words, seniority, core and additional skills, and the highest qualification. Add nothing that the
resume does not say. Take your time.

{_outline_text()}
""")

SCORE_PROMPT = Prompt(f"""Resume:
{{resume_text}}

Job description:
{{job_description}}

Rate how well the resume fits the job. Give points for each criterion below, add them up and round to a
whole number. Rely on what is shown by evidence rather than on claims. Take your time.

{_rubric_text()}

Answer with one whole number from 0 to 100 and nothing else. If the resume cannot be scored, answer
{UNSCORABLE}.
""")

PROMPTS = {"job_description": JOB_PROMPT, "resume": RESUME_PROMPT, "score": SCORE_PROMPT}


def chat_request(prompt: Column, model: str = MODEL, temperature: float = TEMPERATURE,
                 max_tokens: int | None = MAX_TOKENS) -> Column:
    """Chat request with the prompt as its only message."""
    message = F.struct(F.lit(ROLE).alias("role"), prompt.alias("content"))
    return F.struct(
        F.array(message).alias("messages"),
        F.lit(model).alias("model"),
        F.lit(temperature).cast("double").alias("temperature"),
        F.lit(max_tokens).cast("int").alias("max_tokens"),
    )


def request_body(request: Column) -> Column:
    """The request as JSON text; an unset ``max_tokens`` is left out."""
    return F.to_json(request)


def chat_reply(body: Column) -> Column:
    """Content of the first choice of a JSON reply; NULL for no choice or for broken JSON."""
    return F.get(F.from_json(body, CHAT_REPLY)["choices"], F.lit(0))["message"]["content"]
