"""SQL text of the recurring expressions, for the statements that the queries are checked against."""

from __future__ import annotations

from tallyfolio.functions.prompts import Prompt

N_JOBS = "(SELECT count(*) FROM benchmark)"
REQUEST = f"(doc_id % {N_JOBS})"
RESUME_NAME = "('cv' || (n_chars % 97) || '.txt')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Fixed values, as in functions/text.py: the patterns of tags, URLs, special signs and scores.


def strip_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"


def strip_urls(x: str) -> str:
    return f"regexp_replace({x}, 'https?://[a-z$-_!]+', ' ', 'g')"


def strip_special(x: str) -> str:
    return f"regexp_replace({x}, '[^a-zA-Z0-9 ]', ' ', 'g')"


def clean(x: str) -> str:
    return f"trim(regexp_replace({strip_special(strip_urls(strip_tags(x)))}, ' {{2,}}', ' ', 'g'))"


def parse_score(x: str) -> str:
    return f"coalesce(nullif(regexp_extract({x}, '\\b[0-9][0-9]\\b'), ''), '0')"


def make_id(*parts: str) -> str:
    texts = ", ".join(f"coalesce(CAST({part} AS VARCHAR), '')" for part in parts)
    return (f"regexp_replace(md5(concat_ws(chr(31), {texts})), "
            r"'^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5')")


RESUME_ID = make_id(REQUEST, "''", "-1", RESUME_NAME, "doc_id")


def render(prompt: Prompt, **inputs: str) -> str:
    text = quoted(prompt.text)
    for name, value in inputs.items():
        text = f"replace({text}, '{{{name}}}', {value})"
    return text


def answer_job(prompt: str) -> str:
    return f"('Needs <b>' || {prompt} || '</b>')"


def always_answer_resume(prompt: str) -> str:
    return f"('Skills: <i>' || {prompt} || '</i> (' || length({prompt}) || ')')"


def answer_resume(prompt: str) -> str:
    return f"CASE WHEN length({prompt}) % 7 = 3 THEN NULL ELSE {always_answer_resume(prompt)} END"


def answer_score(prompt: str) -> str:
    return f"CASE WHEN length({prompt}) % 11 = 5 THEN NULL ELSE 'Score: ' || (length({prompt}) % 110) END"


def words(clean_text: str) -> str:
    return f"list_filter(string_split(lower({clean_text}), ' '), lambda w: w <> '')"


def resume_text() -> str:
    return ("(text || chr(10) || (doc_id % 40) || '+ years in ' || source || ', ' || "
            "CASE doc_id % 4 WHEN 0 THEN 'no degree' WHEN 1 THEN 'a Bachelor degree' "
            "WHEN 2 THEN 'a Master degree' ELSE 'a Doctorate' END || '. Led ' || (n_chars % 9) || ' teams.')")
