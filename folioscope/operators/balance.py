"""The balance summary: what all claims of a sample look like beside those selected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.claims import size_bin
from .distribution import balance_columns, ratio
from .evidence import tier_name

#: Histograms over claims: dimension and its value.
DIMENSIONS = {
    "claim_scope": lambda: F.coalesce("citation_scope", F.lit("unknown")), "claim_type": lambda: F.coalesce("claim_type", F.lit("other")), "citation_mode": lambda: F.col("citation_mode"),
    "citation_group_size": lambda: size_bin(F.col("citation_group_size")), "section": lambda: F.coalesce("section_title", F.lit("Untitled")),
}
#: What the summary notes about the selection.
NOTES = [
    "Claim-centric BSC-v2 uses citation closure: every selected claim includes its full citation group.",
    "Citation groups larger than max_group_size are counted but excluded from the main evaluated claim sample.",
]


def histograms(claims: DataFrame, key: list[str], dimensions: list[str] | None = None) -> DataFrame:
    """key, dimension, value, claims: every histogram in one pass."""
    each = F.array(*[F.struct(F.lit(n).alias("dimension"), c().alias("value")) for n, c in DIMENSIONS.items() if dimensions is None or n in dimensions])
    return claims.select(*key, F.explode(each).alias("h")).groupBy(*key, "h.dimension", "h.value").agg(F.count(F.lit(1)).alias("claims"))


def selected_reuse(selected: DataFrame, key: list[str], n: int = 20, cards: DataFrame | None = None) -> DataFrame:
    """key, rank, paper_id, num_selected_claim_contexts, num_sections_used (and title, if cards
    have one): the ``n`` papers that most selected claims cite, ties by paper_id."""
    each = selected.select(*key, F.coalesce("section_title", F.lit("Untitled")).alias("section"), F.explode("citation_group.paper_id").alias("paper_id"))
    used = each.groupBy(*key, "paper_id").agg(F.count(F.lit(1)).alias("num_selected_claim_contexts"), F.count_distinct("section").alias("num_sections_used"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("num_selected_claim_contexts"), "paper_id"))
    top = used.withColumn("rank", place).where(F.col("rank") <= n)
    return top if cards is None else top.join(cards.select("paper_id", "title"), "paper_id", "left").withColumn("title", F.coalesce("title", F.lit("")))


def _as_map(rows: DataFrame, key: list[str], name: str, value: str, out: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, value)))).alias(out))


def summary(claims: DataFrame, selected: DataFrame, groups: DataFrame, cards: DataFrame, key: list[str], max_group_size: int = 15) -> DataFrame:
    """One row a sample with claims. ``claims`` are all candidates, ``groups`` (group_size) all
    citation groups before the oversized ones go, ``cards`` has paper_id and tier_rank and may
    have titles."""
    mode = F.col("citation_mode")
    n = lambda c: F.count_if(c)
    both = [
        claims.groupBy(*key).agg(F.count(F.lit(1)).alias("total_cited_claim_candidates"), n(mode == "single").alias("total_single_citation_claims"), n(mode == "group").alias("total_multi_citation_claims")),
        groups.groupBy(*key).agg(*[c for c in balance_columns(max_group_size)], n(F.col("group_size") > max_group_size).alias("oversized_citation_group_claims_skipped")),
        selected.groupBy(*key).agg(
            F.count(F.lit(1)).alias("selected_claims"), n(mode == "single").alias("selected_single_citation_claims"), n(mode == "group").alias("selected_multi_citation_claims"),
            n(F.col("citation_scope") == "clause").alias("num_clause_scope_claims"), n(F.col("citation_scope") == "sentence_fallback").alias("num_sentence_fallback_claims"), n(F.coalesce("claim_type", F.lit("other")) == "other").alias("selected_other_claims"),
        ),
    ]
    renamed = {c: c + "_all" for c in ("single_citation_claim_ratio", "large_citation_group_ratio", "oversized_citation_group_ratio", "avg_citation_group_size")} | {"max_citation_group_size": "max_citation_group_size_observed"}
    both[1] = both[1].withColumnsRenamed(renamed)
    for side, rows in (("all", claims), ("selected", selected)):
        counted = histograms(rows, key)
        for d, name in (("claim_scope", "claim_scope_distribution"), ("claim_type", "claim_type_distribution")):
            both.append(_as_map(counted.where(F.col("dimension") == d), key, "value", "claims", f"{name}_{side}"))
        if side == "selected":
            both.append(_as_map(counted.where("dimension = 'citation_group_size'"), key, "value", "claims", "citation_group_size_distribution_selected"))
            both.append(_as_map(counted.where("dimension = 'section'"), key, "value", "claims", "contexts_per_section_selected"))
    both.append(_as_map(groups.groupBy(*key, size_bin(F.col("group_size")).alias("value")).agg(F.count(F.lit(1)).alias("claims")), key, "value", "claims", "citation_group_size_distribution_all"))
    top = selected_reuse(selected, key, cards=cards if "title" in cards.columns else None)
    fields = [c for c in ("paper_id", "title", "num_selected_claim_contexts", "num_sections_used") if c in top.columns]
    both.append(top.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("top_reused_papers_selected")))
    papers = selected.select(*key, F.explode("citation_group.paper_id").alias("paper_id")).distinct().join(cards.select("paper_id", "tier_rank"), "paper_id", "left")
    tiers = papers.groupBy(*key, tier_name(F.coalesce("tier_rank", F.lit(4))).alias("value")).agg(F.count(F.lit(1)).alias("claims"))
    both.append(_as_map(tiers, key, "value", "claims", "evidence_tier_counts_selected_papers"))
    both.append(papers.groupBy(*key).agg(F.count(F.lit(1)).alias("num_unique_selected_papers")))
    out = both[0]
    for part in both[1:]:
        out = out.join(part, key, "left")
    out = out.na.fill(0)
    share = lambda a, b: ratio(F.col(a), F.col(b))
    return out.withColumns({
        "multi_citation_claim_ratio_all": share("total_multi_citation_claims", "total_cited_claim_candidates"), "multi_citation_claim_ratio_selected": share("selected_multi_citation_claims", "selected_claims"),
        "selected_other_claim_ratio": share("selected_other_claims", "selected_claims"), "selection_notes": F.array(*[F.lit(x) for x in NOTES]),
    })


def as_record(row: DataFrame, key: list[str], kind: str) -> Column:
    """A row's columns but its key as one JSON object of that record type."""
    return F.to_json(F.struct(F.lit(kind).alias("record_type"), *[c for c in row.columns if c not in key]))
