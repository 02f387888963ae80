"""Prompts for a judge, put together from a sample's records. Rubrics are given by the caller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .judged import CRITERIA


def expected_answer(families: list[str]) -> str:
    """The shape of the JSON that the judge is asked for."""
    groups = ", ".join(f'"{f}": {{' + ", ".join(f'"{c}": {{"score": 1-5, "rationale": "..."}}' for c in CRITERIA[f]) + "}" for f in families)
    return "{" + groups + ', "diagnostics": {}}'


def prompt(families: list[str], rubric: Column, topic: Column, records: Column | None = None) -> Column:
    """Task, topic, rubric, the sample's records if there are any, and the answer's shape.
    Null parts are empty."""
    blank = F.lit("")
    parts = [
        F.lit("Judge the survey manuscript below on " + ", ".join(families) + ". Score every criterion from 1 to 5."),
        F.concat(F.lit("Topic: "), F.coalesce(topic, blank)), F.coalesce(rubric, blank),
        *([F.concat(F.lit("Records, one JSON object a line:\n"), F.coalesce(records, blank))] if records is not None else []),
        F.lit("Answer with one JSON object of this shape: " + expected_answer(families)),
    ]
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n\n")


def data_url(content: Column, kind: Column) -> Column:
    """Binary content as a data URL of that image type."""
    mime = F.when(F.lower(kind) == "jpg", F.lit("jpeg")).otherwise(F.lower(kind))
    return F.concat(F.lit("data:image/"), mime, F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))
