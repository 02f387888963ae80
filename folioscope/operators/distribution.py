"""Citation distribution over events (key, section, indices, group_size)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.claims import size_bin
from .events import cites


def ratio(part: Column, whole: Column) -> Column:
    """Four digits; a whole of zero counts as one."""
    return F.round(part / F.greatest(whole, F.lit(1)), 4)


def index_order(column: str = "citation_index") -> list[Column]:
    """Numbers first, by value; the rest by text."""
    number = F.col(column).rlike(r"^\d+$")
    return [(~number).cast("int").asc(), F.when(number, F.length(column)).asc(), F.col(column).asc()]


def section_stats(events: DataFrame, key: list[str]) -> DataFrame:
    """Per section: claims, mentions, distinct indices."""
    each = events.select(*key, "section", "group_size", F.explode("indices").alias("citation_index"))
    distinct = each.groupBy(*key, "section").agg(F.count_distinct("citation_index").alias("unique_citations"))
    return events.groupBy(*key, "section").agg(F.count(F.lit(1)).alias("cited_claims"), F.sum("group_size").alias("citation_mentions")).join(distinct, [*key, "section"])


def reuse(events: DataFrame, key: list[str]) -> DataFrame:
    """Per index: claims and sections that cite it."""
    each = events.select(*key, "section", F.explode("indices").alias("citation_index"))
    return each.groupBy(*key, "citation_index").agg(F.count(F.lit(1)).alias("num_claims"), F.count_distinct("section").alias("num_sections"))


def ranked_reuse(events: DataFrame, key: list[str], n: int) -> DataFrame:
    """The first ``n`` of ``reuse`` in each sample, with their rank."""
    order = [F.desc("num_claims"), *index_order()]
    used = reuse(events, key)
    if key:
        return used.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= n)
    top = used.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_reuse(events: DataFrame, key: list[str], n: int = 20) -> DataFrame:
    return ranked_reuse(events, key, n)


def top_share(events: DataFrame, key: list[str]) -> DataFrame:
    """Shares of mentions of the most cited index and of the five most cited ones."""
    used = reuse(events, key)
    total = used.groupBy(*key).agg(F.sum("num_claims").alias("total_citation_mentions"), F.count(F.lit(1)).alias("num_unique_citation_indices"), F.max("num_claims").alias("top"))
    five = ranked_reuse(events, key, 5).groupBy(*key).agg(F.sum("num_claims").alias("top_5"))
    joined = total.join(five, key) if key else total.crossJoin(five)  # one row each
    whole = F.col("total_citation_mentions")
    return joined.select(*key, whole, "num_unique_citation_indices", ratio(F.col("top"), whole).alias("top_1_citation_mention_share"), ratio(F.col("top_5"), whole).alias("top_5_citation_mention_share"))


def repeated_groups(events: DataFrame, key: list[str]) -> DataFrame:
    """Groups cited more than once, the order of indices mattering."""
    return events.groupBy(*key, "indices").agg(F.count(F.lit(1)).alias("num_occurrences"), F.count_distinct("section").alias("num_sections")).where("num_occurrences > 1")


def _first(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    if not key:
        return df.orderBy(*order).limit(n)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= n).drop("rank")


def top_repeated_groups(events: DataFrame, key: list[str], n: int = 10) -> DataFrame:
    return _first(repeated_groups(events, key), key, [F.desc("num_occurrences"), F.desc(F.size("indices")), F.asc("indices")], n)


def largest_groups(events: DataFrame, key: list[str], n: int = 10) -> DataFrame:
    return _first(events, key, [F.desc("group_size"), F.asc("section"), F.asc("indices")], n)


def size_histogram(events: DataFrame, key: list[str]) -> DataFrame:
    return events.groupBy(*key, size_bin(F.col("group_size")).alias("size_bin")).agg(F.count(F.lit(1)).alias("claims"))


def balance_columns(max_group_size: int) -> list[Column]:
    """Aggregates over group sizes: shares of large, oversized and single groups, mean, largest."""
    n, size = F.count(F.lit(1)), F.col("group_size")
    of_all = lambda c: F.coalesce(F.round(c / F.nullif(n, F.lit(0)), 4), F.lit(0.0))
    return [
        of_all(F.count_if(size >= 5)).alias("large_citation_group_ratio"), of_all(F.count_if(size > max_group_size)).alias("oversized_citation_group_ratio"),
        of_all(F.sum(size)).alias("avg_citation_group_size"), F.coalesce(F.max(size), F.lit(0)).alias("max_citation_group_size"), of_all(F.count_if(size == 1)).alias("single_citation_claim_ratio"),
    ]


def balance(groups: DataFrame, key: list[str], max_group_size: int = 15) -> DataFrame:
    """Group sizes in total, see ``balance_columns``."""
    return groups.groupBy(*key).agg(*balance_columns(max_group_size))


def section_coverage(paragraphs: DataFrame, key: list[str]) -> DataFrame:
    """Sections with citations among all sections that have a paragraph. Whether a section has an
    event is a matter of its paragraphs alone: no event is made, merged or compared."""
    sections = paragraphs.groupBy(*key, "section").agg(F.bool_or(cites(F.col("paragraph"))).alias("cited"))
    both = sections.groupBy(*key).agg(F.count(F.lit(1)).alias("total_body_sections"), F.count_if("cited").alias("sections_with_citations"))
    return both.withColumn("section_citation_coverage_ratio", ratio(F.col("sections_with_citations"), F.col("total_body_sections")))


def distribution(paragraphs: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """The flagship: one row of statistics a sample, samples without events included."""
    size, sections = F.col("group_size"), F.size(F.collect_set("section"))
    # rows of a sample lie together from here on: no further step moves them
    own, body = events.repartition(*key), paragraphs.repartition(*key).groupBy(*key).agg(sections.alias("total_body_sections"))
    counts = own.groupBy(*key).agg(
        sections.alias("sections_with_citations"), F.count(F.lit(1)).alias("total_cited_claims"), F.count_if(size == 1).alias("single_citation_claims"), F.count_if(size > 1).alias("multi_citation_claims"), *balance_columns(15)
    )
    used = own.select(*key, F.explode("indices").alias("citation_index")).groupBy(*key, "citation_index").agg(F.count(F.lit(1)).alias("n"))
    most = used.groupBy(*key).agg(F.sort_array(F.collect_list("n"), asc=False).alias("n"))
    total = lambda array: F.aggregate(array, F.lit(0).cast("long"), lambda s, x: s + x)
    whole = total(F.col("n"))
    shares = most.select(*key, whole.alias("total_citation_mentions"), F.size("n").alias("num_unique_citation_indices"), ratio(F.col("n")[0], whole).alias("top_1_citation_mention_share"), ratio(total(F.slice("n", 1, 5)), whole).alias("top_5_citation_mention_share"))
    groups = own.groupBy(*key, "indices").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = groups.groupBy(*key).agg(F.count(F.lit(1)).alias("num_repeated_exact_citation_groups"), F.sum("n").alias("repeated_claims"))
    out = body.join(counts, key, "left").join(shares, key, "left").join(repeated, key, "left").na.fill(0)
    claims = F.col("total_cited_claims")
    return out.withColumns({
        "section_citation_coverage_ratio": ratio(F.col("sections_with_citations"), F.col("total_body_sections")),
        "multi_citation_claim_ratio": ratio(F.col("multi_citation_claims"), claims), "repeated_exact_group_claim_ratio": ratio(F.col("repeated_claims"), claims),
    }).drop("repeated_claims")


def report(paragraphs: DataFrame, events: DataFrame, scanned_counts: DataFrame, syntax: DataFrame, key: list[str]) -> DataFrame:
    """``distribution`` with its nested parts: histograms as maps, top lists as arrays."""

    def mapped(df: DataFrame, name: str, value: str, out: str) -> DataFrame:
        return df.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, value)))).alias(out))

    def listed(df: DataFrame, order: list[Column], fields: list[str], out: str) -> DataFrame:
        placed = df.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
        return placed.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(out))

    stats = section_stats(events, key)
    parts = [
        mapped(size_histogram(events, key), "size_bin", "claims", "citation_group_size_distribution"),
        mapped(stats, "section", "cited_claims", "cited_claims_per_section"),
        mapped(stats, "section", "citation_mentions", "citation_mentions_per_section"),
        mapped(stats, "section", "unique_citations", "unique_citations_per_section"),
        listed(top_reuse(events, key), [F.asc("rank")], ["citation_index", "num_claims", "num_sections"], "top_reused_citations"),
        listed(top_repeated_groups(events, key), [F.desc("num_occurrences"), F.desc(F.size("indices")), F.asc("indices")], ["indices", "num_occurrences", "num_sections"], "top_repeated_exact_citation_groups"),
        listed(largest_groups(events, key), [F.desc("group_size"), F.asc("section"), F.asc("indices")], ["section", "indices", "group_size", "clause"], "largest_citation_groups"),
        scanned_counts.select(*key, F.struct("table", "code", "caption", "reference_entry").alias("skipped_non_body_citation_lines")),
        syntax.select(*key, F.struct(*[c for c in syntax.columns if c not in key]).alias("citation_syntax_counts")),
    ]
    out = distribution(paragraphs, events, key)
    for p in parts:
        out = out.join(p, key, "left")
    return out
