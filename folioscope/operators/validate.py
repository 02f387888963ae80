"""Rules that selected claims must obey, as a table of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.claims import evaluable
from .sampling import Budget


def violations(claims: DataFrame, bank: DataFrame, key: list[str], budget: Budget = Budget(), max_group_size: int = 15) -> DataFrame:
    """key, rule, claim_id: empty if all is well. ``claims`` have evidence ids and tier."""
    group = F.col("citation_group")
    rules = {
        "scope": ~F.col("citation_scope").isin("clause", "sentence_fallback"),
        "mode": ~F.col("citation_mode").isin("single", "group"),
        "marker": ~F.contains("marked_sentence", F.lit("[CITE_THIS]")),
        "evaluable": ~evaluable(F.col("marked_sentence")),
        "original": F.coalesce(F.col("original_sentence_with_citations") == "", F.lit(True)),
        "empty_group": F.size(group) == 0,
        "size": F.size(group) != F.col("citation_group_size"),
        "oversized": F.size(group) > max_group_size,
        "evidence_id": F.exists(group, lambda m: m["evidence_ref_id"] == ""),
        "insufficient": F.col("tier_rank") >= 4,
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    own = claims.select(*key, F.explode(broken).alias("rule"), "claim_id")
    over = claims.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("citation_mode") == "group").alias("g"))
    limits = F.array_compact(F.array(F.when(F.col("n") > budget.records, F.lit("records")), F.when(F.col("g") > budget.multi, F.lit("multi_quota"))))
    totals = over.select(*key, F.explode(limits).alias("rule"), F.lit(None).cast("string").alias("claim_id"))
    # both sides in one aggregation: which papers of a sample its claims cite, which its bank has
    cited = claims.select(*key, F.explode("citation_group.paper_id").alias("paper_id"), F.lit(True).alias("used"))
    pairs = cited.unionByName(bank.select(*key, "paper_id", F.lit(False).alias("used"))).groupBy(*key, "paper_id").agg(F.bool_or("used").alias("used"), F.bool_or(~F.col("used")).alias("banked"))
    nothing = F.lit(False)  # a null equals nothing, not even a null of the other side
    for c in [*key, "paper_id"]:
        nothing = nothing | F.col(c).isNull()
    alone = lambda a, b, rule: F.when(F.col(a) & (~F.col(b) | nothing), F.struct(F.lit(rule).alias("rule"), F.col("paper_id").alias("claim_id")))
    over_budget = F.when(F.count_if("banked") > budget.papers, F.struct(F.lit("paper_budget").alias("rule"), F.lit(None).cast("string").alias("claim_id")))
    found = F.concat(F.collect_list(alone("used", "banked", "not_in_bank")), F.collect_list(alone("banked", "used", "unused_paper")), F.array_compact(F.array(over_budget)))
    papers = pairs.groupBy(*key).agg(found.alias("found")).select(*key, F.explode("found").alias("v")).select(*key, "v.rule", F.col("v.claim_id").cast("string").alias("claim_id"))
    return own.unionByName(totals).unionByName(papers)
