"""From samples to scores: the judge behind a protocol, its responses, and what becomes of them."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import judged
from ..functions.text import once
from .audit import apply_caps
from .scoring import HIGHEST, LOWEST, coerce

#: Families that a judge scores; TSQ and HDQ come in one response.
CALLS = {"BSC": ["BSC"], "MAR": ["MAR"], "TSQ/HDQ": ["TSQ", "HDQ"]}
#: Statuses of a sample in a family. ``defaulted``: scored, though something had to be made up.
NO_RESPONSE, DEFAULTED = "no_response", "defaulted"


class Judge(Protocol):
    """Answers prompts. An implementation that calls a service belongs to the caller."""

    def responses(self, prompts: DataFrame) -> DataFrame:
        """``prompts`` (key columns, family, prompt) with a column ``raw_response``, null where
        there is no answer. Families that share a call share the response."""


class RecordedJudge:
    """Responses that were given before: key columns, family, raw_response. The last one of
    several is the one with the greatest text, so that the choice doesn't depend on order."""

    def __init__(self, recorded: DataFrame, key: list[str]):
        self.recorded, self.key = recorded, key

    def responses(self, prompts: DataFrame) -> DataFrame:
        one = self.recorded.groupBy(*self.key, "family").agg(F.max("raw_response").alias("raw_response"))
        return prompts.join(one, [*self.key, "family"], "left")


def scores(responses: DataFrame, key: list[str], capped: DataFrame | None = None) -> DataFrame:
    """key, family, criterion, score, rationale, status, warning, lowered: four rows a response.
    ``responses``: key, family, raw_response as text of the answer or of the API around it."""
    told = once(responses.withColumnRenamed("raw_response", "_answer"), "raw_response", judged.response_text(F.col("_answer"))).drop("_answer")
    silent = told.where("raw_response is null or trim(raw_response) = ''").select(*key, "family")
    rows = judged.raw_scores(told.where("raw_response is not null and trim(raw_response) <> ''"), key)
    made = once(rows, "score", F.when(F.col("status") == judged.OK, coerce(F.col("raw"), F.col("family"), F.coalesce("is_text", F.lit(False)))))
    number = F.regexp_extract("raw", r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    warning = (
        F.when(F.col("status") != judged.OK, F.col("status")).when(F.col("raw").isNull(), "missing").when(number.isNull() | ((F.col("family").isin("BSC", "MAR")) & F.coalesce("is_text", F.lit(False)) & ~F.col("raw").rlike(r"^\s*[+-]?\d+\s*$")), "invalid")
        .when((number < LOWEST) | (number > HIGHEST), "out_of_range").when(F.col("score") != number, "rounded")
    )
    made = made.withColumn("warning", warning).withColumn("status", F.when((F.col("status") == judged.OK) & F.col("warning").isin("missing", "invalid"), DEFAULTED).otherwise(F.col("status")))
    names = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(c).alias("criterion")) for f, cs in judged.CRITERIA.items() for c in cs])
    none = silent.withColumn("c", F.explode(F.filter(names, lambda x: x["family"] == F.col("family")))).select(*key, "family", "c.criterion", F.lit(None).cast("int").alias("score"), F.lit("").alias("rationale"), F.lit(NO_RESPONSE).alias("status"), F.lit(NO_RESPONSE).alias("warning"))
    out = made.select(*key, "family", "criterion", "score", "rationale", "status", "warning").unionByName(none)
    return out.withColumn("lowered", F.lit(False)) if capped is None else apply_caps(out, capped, key)


def statuses(scored: DataFrame, key: list[str]) -> DataFrame:
    """key, family, status, warnings, raw_20: one row a sample and family. A sample that failed
    has its status instead of a total; the others go on."""
    worst = F.max(F.when(F.col("status").isin(judged.OK, DEFAULTED), F.lit("")).otherwise(F.col("status")))
    status = F.when(worst != "", worst).when(F.max((F.col("status") == DEFAULTED).cast("int")) == 1, DEFAULTED).otherwise(judged.OK)
    total: Column = F.when(F.count("score") == F.count(F.lit(1)), F.sum("score"))
    return scored.groupBy(*key, "family").agg(status.alias("status"), F.count("warning").alias("warnings"), total.alias("raw_20"))
