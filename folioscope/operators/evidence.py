"""Evidence: reference maps, paper cards, how complete the evidence of a claim is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import id_year
from ..functions.text import clean_sentence, shorten_items

#: Evidence tiers of a paper and of a claim, best first; limits of a compact card.
TIERS = ["metadata_and_abstract", "metadata_only", "abstract_only", "title_only", "insufficient"]
CLAIM_TIERS = ["all_metadata_and_abstract", "mixed_with_metadata_only", "mixed_with_abstract_only", "title_only_or_weak", "has_missing_or_insufficient"]
TEXT_LIMITS = {"paper_id": 80, "title": 220, "abstract": 900, "task_category": 120, "method_name": 160, "method_summary": 600, "key_insights": 450, "conclusion": 350, "limitations": 350}
LIST_LIMITS = {"innovations": (3, 180), "datasets_used_for_eval": (5, 120), "main_results": (3, 180)}
FIRST_YEAR, LAST_YEAR = 2020, 2026


def filter_years(ref_map: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """References whose paper is of these years."""
    return ref_map.where(id_year(F.col("paper_id")).between(first, last))


def year_counts(ref_map: DataFrame, key: list[str], first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    year = id_year(F.col("paper_id"))
    return ref_map.groupBy(*key).agg(F.count_if(year.between(first, last)).alias("kept"), F.count_if(year.isNull()).alias("invalid_arxiv_id"), F.count_if(~year.between(first, last)).alias("outside_year_range"))


def tier_rank(metadata: Column, abstract: Column, title: Column) -> Column:
    return F.when(metadata & abstract, 0).when(metadata, 1).when(abstract, 2).when(title, 3).otherwise(4)


def tier_name(rank: Column, names: list[str] = TIERS) -> Column:
    return F.array(*[F.lit(n) for n in names])[F.least(rank, F.lit(len(names) - 1))]


def claim_tiers(members: DataFrame, cards: DataFrame, key: list[str]) -> DataFrame:
    """Per claim (``key``) how many of its papers (paper_id) are of each tier, and the claim's
    tier. ``cards``: paper_id, tier_rank. The card side is one row a paper, so a paper that
    a large share of claims cites is dealt out by the skew join."""
    rank = F.col("tier_rank")
    counted = members.join(cards.select("paper_id", "tier_rank"), "paper_id", "left").groupBy(*key).agg(
        *[F.count_if(rank == i).alias(t) for i, t in enumerate(TIERS[:4])],
        F.count_if(rank.isNull()).alias("missing"), F.count_if(rank == 4).alias("insufficient"), F.count(F.lit(1)).alias("num_papers"),
    )
    bad = F.col("missing") + F.col("insufficient") > 0
    level = F.when(bad, 4).when(F.col("metadata_and_abstract") == F.col("num_papers"), 0).when(F.col("metadata_only") > 0, 1).when(F.col("abstract_only") > 0, 2).otherwise(3)
    return counted.withColumn("tier_rank", level).withColumn("tier", tier_name(F.col("tier_rank"), CLAIM_TIERS))


def inverse_index(ref_map: DataFrame, key: list[str]) -> DataFrame:
    """Per paper of a sample its citation indices, numbers by value before other texts."""
    number = F.when(F.col("citation_index").rlike(r"^\d{1,18}$"), F.col("citation_index").cast("long"))
    entry = F.struct(number.isNull().alias("other"), number.alias("value"), F.col("citation_index").alias("text"))
    return ref_map.groupBy(*key, "paper_id").agg(F.transform(F.sort_array(F.collect_set(entry)), lambda x: x["text"]).alias("citation_indices"))


def bank(selected: DataFrame, index: DataFrame, cards: DataFrame, key: list[str]) -> DataFrame:
    """The papers that selected claims use, numbered E001, E002, ... in order of paper_id."""
    used = selected.select(*key, F.explode("citation_group.paper_id").alias("paper_id")).distinct()
    number = F.row_number().over(Window.partitionBy(*key).orderBy("paper_id"))
    return used.join(cards, "paper_id").join(index, [*key, "paper_id"], "left").withColumn("evidence_ref_id", F.format_string("E%03d", number))


def with_evidence_ids(claims: DataFrame, bank_rows: DataFrame, key: list[str]) -> DataFrame:
    """Claims whose group members carry the bank's ids. A bank has as many papers as a sample
    may use, so it fits a map."""
    names = bank_rows.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("paper_id", "evidence_ref_id"))).alias("ids"))
    filled = F.transform("citation_group", lambda m: F.struct(m["citation_index"].alias("citation_index"), m["paper_id"].alias("paper_id"), F.coalesce(F.try_element_at("ids", m["paper_id"]), F.lit("")).alias("evidence_ref_id")))
    return claims.join(names, key, "left").withColumn("citation_group", filled).drop("ids")


#: Fields of a claim that its record leaves out, beside those that begin with an underscore.
PRIVATE = ["paragraph_context", "claim_sentence", "section_path", "subsection_title", "selection_reason", "citation_evidence_preview"]


def records(claims: DataFrame, bank_rows: DataFrame, key: list[str]) -> DataFrame:
    """Claims as they are judged: with the bank's ids, without private and redundant fields."""
    filled = with_evidence_ids(claims, bank_rows, key)
    return filled.select(*[c for c in filled.columns if not c.startswith("_") and c not in PRIVATE])


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def card(metadata: DataFrame, parsed: DataFrame) -> DataFrame:
    """Evidence cards. ``metadata``: paper_id, doc VARIANT (null if missing or malformed) and, if
    it is known, the path it was found at;
    ``parsed``: paper_id, abstract, title of the parsed paper. A title comes from the
    metadata first, an abstract from the parsed paper first."""
    both = metadata.join(parsed, "paper_id", "full_outer")
    get = lambda path, kind="string": F.try_variant_get(F.col("doc"), path, kind)

    def strings(path: str) -> Column:
        many, one = get(path, "array<variant>"), get(path)
        return F.when(many.isNotNull(), F.transform(many, lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))).when(F.nullif(one, F.lit("")).isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))

    title = F.coalesce(F.nullif(get("$.basic_info.title"), F.lit("")), F.nullif(F.col("title"), F.lit("")))
    found = F.coalesce(F.nullif(get("$.basic_info.abstract"), F.lit("")), get("$.abstract"))
    abstract = F.coalesce(F.nullif(F.col("abstract"), F.lit("")), F.nullif(clean_sentence(_text(found), TEXT_LIMITS["abstract"]), F.lit("")))
    out = both.select(
        "paper_id", title.alias("title"), abstract.alias("abstract"), get("$.categorization.task_category").alias("task_category"), strings("$.categorization.keywords").alias("keywords"),
        get("$.method_details.method_name").alias("method_name"), get("$.method_details.architecture_description").alias("method_summary"), strings("$.method_details.innovations").alias("innovations"),
        strings("$.dataset_info.datasets_used_for_eval").alias("datasets_used_for_eval"), strings("$.evaluation.main_results").alias("main_results"), get("$.research_logic.motivation").alias("motivation"),
        get("$.research_logic.key_insights").alias("key_insights"), get("$.research_logic.conclusion").alias("conclusion"), get("$.evaluation.limitations").alias("limitations"), F.col("doc").isNotNull().alias("has_metadata"),
        *(["path"] if "path" in both.columns else []),
    )
    out = out.withColumns({"has_abstract": F.col("abstract").isNotNull(), "has_title": F.col("title").isNotNull()})
    return out.withColumn("tier_rank", tier_rank(F.col("has_metadata"), F.col("has_abstract"), F.col("has_title"))).withColumn("evidence_tier", tier_name(F.col("tier_rank")))


def compact(cards: DataFrame) -> DataFrame:
    """Cards cut to size; keywords and motivation stay out, empty fields are null. An object
    among the main results keeps dataset, metric, value and comparison."""
    fields = ["dataset", "metric", "value", "comparison"]

    def item(raw: Column) -> Column:
        v = F.try_parse_json(raw)
        parts = [F.when(F.nullif(F.try_variant_get(v, f"$.{f}", "string"), F.lit("")).isNotNull(), F.concat(F.lit(f"{f}="), F.try_variant_get(v, f"$.{f}", "string"))) for f in fields]
        return F.when(raw.startswith("{"), F.concat_ws("; ", *parts)).otherwise(raw)

    texts = [F.nullif(clean_sentence(_text(F.col(c)), n), F.lit("")).alias(c) for c, n in TEXT_LIMITS.items()]
    lists = [shorten_items(F.transform(c, item) if c == "main_results" else F.col(c), *n).alias(c) for c, n in LIST_LIMITS.items()]
    rest = [c for c in ("evidence_tier", "tier_rank", "has_metadata", "has_abstract", "has_title") if c in cards.columns]
    return cards.select(*texts, *[F.when(F.size(c) > 0, c).alias(n) for c, n in zip(lists, LIST_LIMITS)], *rest)


def miss_counts(cards: DataFrame, key: list[str] | None = None) -> DataFrame:
    """How many papers lack what. Metadata that were found but couldn't be read (``path`` is
    there, ``has_metadata`` isn't) count apart from those that weren't found."""
    n = lambda c: F.count_if(c)
    found = F.col("path").isNotNull() if "path" in cards.columns else F.lit(False)
    return cards.groupBy(*(key or [])).agg(
        F.count(F.lit(1)).alias("papers"), n(~F.col("has_metadata") & ~found).alias("without_metadata"), n(~F.col("has_metadata") & found).alias("unreadable_metadata"), n(~F.col("has_abstract")).alias("without_abstract"),
        n(~F.col("has_title")).alias("without_title"), n(F.col("tier_rank") == 4).alias("without_evidence"),
    )
