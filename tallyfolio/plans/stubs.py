"""Deterministic stand-ins for a model, simple enough to be written in SQL as well."""

from __future__ import annotations

from tallyfolio.operators.inference import text_model
from tallyfolio.plans.batch import Models


def answer_job(prompt: str) -> str:
    return f"Needs <b>{prompt}</b>"


def always_answer_resume(prompt: str) -> str:
    return f"Skills: <i>{prompt}</i> ({len(prompt)})"


def answer_resume(prompt: str) -> str:
    if len(prompt) % 7 == 3:
        raise ValueError("no answer")
    return always_answer_resume(prompt)


def answer_score(prompt: str) -> str:
    if len(prompt) % 11 == 5:
        raise ValueError("no answer")
    return f"Score: {len(prompt) % 110}"


def stub_models(**options) -> Models:
    return Models(text_model(answer_job), text_model(answer_resume), text_model(answer_score), **options)
