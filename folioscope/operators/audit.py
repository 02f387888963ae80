"""Structural audit of manuscripts, and the score caps that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.judged import CRITERIA
from ..functions.text import word_count

#: What the audit looks for.
AUDIT_HEADING = r"(?U)^\s*(#{1,6})\s+(.+?)\s*$"
BACK_MATTER = r"(?iU)^(?:\d+(?:\.\d+)*\s+)?(?:references|bibliography)\b"
NOT_SUBSTANTIVE = r"(?iU)^(?:abstract|keywords?|references|bibliography)\b"
TABLE_RULE = r"(?U)^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$"
TABLE_MENTION = r"(?iU)\btable\s+(?:\d+|[ivxlcdm]+)\b"
FIGURE_MENTION = r"(?iU)\bfig(?:ure)?\.?\s*(?:\d+|[ivxlcdm]+)\b"
TRANSITIONS = {"building_upon": r"\bbuilding upon\b", "preceding_section": r"\bpreceding section\b", "sets_the_stage": r"\bsets? the stage\b", "moving_forward": r"\bmoving forward\b"}
TAXONOMY = r"\b(?:taxonomy|classification framework|research landscape|method comparison|comparative matrix)\b"
EVALUATION = r"\b(?:benchmark|evaluation metric|evaluation protocol|dataset comparison)\b"
GAP = r"\b(?:research gap|open challenge|future direction|limitation|trade-off|tradeoff)\b"
CORPUS = r"\b(?:retrieved|curated|screened|selected)\s+(?:survey\s+)?corpus\b|\bsystematic\s+(?:literature\s+)?review\b|\bcorpus\s+(?:contains|comprises|includes)\s+\d+|\bannual\s+(?:paper|publication)\s+distribution\b"
METHODOLOGY = {
    "database_sources": r"\b(?:scopus|web of science|semantic scholar|google scholar|ieee xplore|acm digital library|pubmed)\b",
    "search_query_or_terms": r"\b(?:search quer(?:y|ies)|search string|search terms?|retrieval keywords?)\b",
    "screening_counts_or_flow": r"\b(?:prisma|screening flow|records? screened|papers? screened|after deduplication|duplicates? removed)\b",
    "inclusion_exclusion": r"\b(?:inclusion criteria|exclusion criteria|eligibility criteria|inclusion and exclusion)\b",
    "retrieval_cutoff": r"\b(?:search cutoff|retrieval cutoff|cutoff date|search conducted|last searched)\b",
}
TSQ, HDQ = CRITERIA["TSQ"], CRITERIA["HDQ"]


def audit_counts(docs: DataFrame, key: list[str], text: str = "md") -> DataFrame:
    """One row a document: what its body and reference list hold."""
    lines = F.split(F.col(text), r"\R", -1)
    head = lambda x: F.regexp_extract(x, AUDIT_HEADING, 2)
    back = F.transform("lines", lambda x: x.rlike(AUDIT_HEADING) & head(x).rlike(BACK_MATTER))
    d = docs.select(*key, lines.alias("lines"))
    d = d.withColumn("cut", F.array_position(back, True).cast("int"))
    d = d.withColumn("own", F.when(F.col("cut") > 0, F.slice("lines", 1, F.greatest(F.col("cut") - 1, F.lit(0)))).otherwise(F.col("lines")))
    d = d.withColumn("tail", F.when(F.col("cut") > 0, F.slice("lines", F.col("cut"), F.size("lines"))).otherwise(F.slice("lines", 1, 0)))
    d = d.withColumns({"body": F.array_join("own", "\n"), "refs": F.array_join("tail", "\n")})
    low = F.lower("body")
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    d = d.select(
        *key, word_count(F.col("body")).alias("body_words"), F.length("body").alias("body_chars"), F.length("refs").alias("reference_chars"),
        F.size(F.filter("own", lambda x: x.rlike(AUDIT_HEADING) & ~head(x).rlike(NOT_SUBSTANTIVE))).alias("substantive_headings"),
        F.size(F.filter("own", lambda x: x.rlike(TABLE_RULE))).alias("table_rules"), count(F.col("body"), TABLE_MENTION).alias("table_mentions"), count(F.col("body"), FIGURE_MENTION).alias("figure_mentions"),
        *[count(low, "(?U)" + p).alias(n) for n, p in TRANSITIONS.items()],
        low.rlike("(?U)" + TAXONOMY).alias("has_taxonomy"), low.rlike("(?U)" + EVALUATION).alias("has_evaluation"), low.rlike("(?U)" + GAP).alias("has_gap"), low.rlike("(?U)" + CORPUS).alias("claims_corpus"),
        *[low.rlike("(?U)" + p).alias(n) for n, p in METHODOLOGY.items()],
    )
    total = lambda names: sum((F.col(n).cast("int") for n in names), F.lit(0))
    return d.withColumns({
        "aids": total(["table_rules", "table_mentions", "figure_mentions"]), "transitions": total(TRANSITIONS), "methodology": total(METHODOLOGY),
        "reference_ratio": F.when(F.col("body_chars") > 0, F.round(F.col("reference_chars") / F.col("body_chars"), 4)),
    })


def audit_flags(counts: DataFrame) -> DataFrame:
    w, h, a = F.col("body_words"), F.col("substantive_headings"), F.col("aids")
    return counts.withColumns({
        "thin_overview": (w < 4000) & (h < 10) & (a == 0),
        "reference_dominated_without_aids": (F.col("reference_chars") > F.col("body_chars")) & (F.col("reference_chars") > 0) & (w < 4000) & (a == 0),
        "limited_depth": (w < 7000) & (h < 16) & (a < 2),
        "broad_without_aids": (w >= 7000) & (h >= 16) & (a == 0),
        "formulaic_transition": (w >= 7000) & (h >= 20) & (F.col("transitions") >= 4),
        "unreproducible_corpus": F.col("claims_corpus") & (F.col("methodology") < 3),
    })


#: Which flag caps which criteria at which score.
CAPS = (
    [("thin", "TSQ", c, 3) for c in TSQ] + [("thin", "HDQ", c, 4) for c in HDQ]
    + [("limited", "TSQ", c, 4) for c in TSQ] + [("limited", "HDQ", c, 4) for c in HDQ]
    + [("unreproducible", "TSQ", TSQ[0], 4), ("unreproducible", "TSQ", TSQ[1], 4)]
    + [("broad", "TSQ", c, 4) for c in TSQ] + [("broad", "HDQ", HDQ[3], 4)]
    + [("formulaic", "TSQ", TSQ[2], 4), ("formulaic", "HDQ", HDQ[1], 4)]
)


def caps(flags: DataFrame, key: list[str]) -> DataFrame:
    """key, family, criterion, cap: the lowest cap of the rules that hold."""
    thin = F.col("thin_overview") | F.col("reference_dominated_without_aids")
    rules = F.array_compact(F.array(
        F.when(thin, F.lit("thin")), F.when(~thin & F.col("limited_depth"), F.lit("limited")), F.when(F.col("unreproducible_corpus"), F.lit("unreproducible")),
        F.when(F.col("broad_without_aids"), F.lit("broad")), F.when(F.col("formulaic_transition"), F.lit("formulaic")),
    ))
    table = flags.sparkSession.createDataFrame(CAPS, "rule string, family string, criterion string, cap int")
    return flags.select(*key, F.explode(rules).alias("rule")).join(F.broadcast(table), "rule").groupBy(*key, "family", "criterion").agg(F.min("cap").alias("cap"))


def apply_caps(scores: DataFrame, capped: DataFrame, key: list[str]) -> DataFrame:
    """Scores (key, family, criterion, score) no higher than their caps; ``lowered`` says which were."""
    both = scores.join(capped, [*key, "family", "criterion"], "left")
    lower: Column = F.coalesce(F.col("score") > F.col("cap"), F.lit(False))
    return both.select(*[c for c in scores.columns if c != "score"], F.when(lower, F.col("cap")).otherwise(F.col("score")).alias("score"), lower.alias("lowered"))
