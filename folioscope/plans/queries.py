"""Every operator applied to the driver's tables. Nothing is limited but what is a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations, claims, ids, text
from ..operators import audit, distribution, events, evidence, pages, sampling, scanner, scoring, validate
from ..sources.manuscripts import bulk_events, derived_lines, derived_manuscripts, table
from ..sources.shared import cut

DOC = ["doc_id"]
ABSTRACT_CHARS = 400


def _bulk(spark: SparkSession, d: str) -> DataFrame:
    return bulk_events(table(spark, d, "lineitem"), table(spark, d, "orders"))


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Paragraphs and events, each written once as several statistics read them."""
    paras = cut(_paragraphs(spark, d), "paragraphs")
    return paras, cut(events.events(scanner.sentences(paras, DOC), DOC), "events")


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    return scanner.scan_lines(derived_lines(table(spark, d, "documents")), DOC)


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scanner.paragraphs(_scanned(spark, d), DOC)


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return scanner.sentences(_paragraphs(spark, d), DOC)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return events.events(_sentences(spark, d), DOC)


def _joined(c: str) -> Column:
    return F.array_join(F.col(c), ",")


def _cards(spark: SparkSession, d: str) -> DataFrame:
    """paper_id, tier_rank: paper k is document k; labelled ones have metadata, long ones an abstract."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), (F.col("n_chars") >= ABSTRACT_CHARS).alias("abstract"))
    known = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("paper_id"), F.lit(True).alias("known")).distinct()
    both = docs.join(known, "paper_id", "left")
    return both.select("paper_id", evidence.tier_rank(F.coalesce("known", F.lit(False)), F.col("abstract"), F.lit(True)).alias("tier_rank"))


def _ref_map(spark: SparkSession, d: str) -> DataFrame:
    """Index k of a manuscript cites paper k + doc_id, of every third none."""
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(45))).alias("k"))
    return docs.where("(k + doc_id) % 3 <> 0").select("doc_id", F.col("k").cast("string").alias("citation_index"), ((F.col("k") * 7 + F.col("doc_id")) % 200).cast("string").alias("paper_id"))


def _claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return events.claims(_sentences(spark, d), _ref_map(spark, d), _cards(spark, d), DOC)


def _claim_tiers(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    members = found.select("doc_id", "claim_id", F.explode("citation_group.paper_id").alias("paper_id"))
    return evidence.claim_tiers(members, _cards(spark, d), ["doc_id", "claim_id"])


def citation_distribution(spark, d):
    paras, found = _parts(spark, d)
    return distribution.distribution(paras, found, DOC)


def norm_ids(spark, d):
    o = table(spark, d, "orders")
    yymm = F.lpad((F.col("o_custkey") % 2800).cast("string"), 4, "0")
    tail = F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0")
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, F.concat(F.lit("arXiv:"), yymm, F.lit("."), tail, F.lit("v2"))).when(k == 1, F.concat(F.lit("https://arxiv.org/abs/"), yymm, F.lit("."), tail)).when(k == 2, F.concat(yymm, F.lit("."), tail, F.lit(".pdf"))).when(k == 3, F.concat(yymm, tail)).when(k == 4, F.concat(F.lit(" "), yymm, F.lit("."), tail, F.lit(" "))).otherwise(F.lit("no id"))
    return o.select("o_orderkey", ids.normalize_id(raw).alias("paper_id"), ids.id_year(ids.normalize_id(raw)).alias("year"), ids.id_month(ids.normalize_id(raw)).alias("month"))


def year_filter(spark, d):
    made = norm_ids(spark, d).select((F.col("o_orderkey") % 50).alias("sample"), "paper_id")
    return evidence.year_counts(made, ["sample"])


def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.split_sentences(F.col("text"))).alias("no", "sentence"))


def clean_text(spark, d):
    html = table(spark, d, "pages")
    return html.select("page_id", F.length(text.clean_sentence(F.col("html"), 10**9)).alias("n_chars"), text.clean_sentence(F.col("html"), 300).alias("cleaned"))


def citation_extract(spark, d):
    rows = events.marker_rows(_sentences(spark, d), clauses=False)
    return rows.select("doc_id", "paragraph_id", "sentence_no", "no", _joined("indices").alias("indices"))


def attached_clauses(spark, d):
    return events.marker_rows(_sentences(spark, d)).select("doc_id", "paragraph_id", "sentence_no", "no", "scope", "clause")


def citation_expand(spark, d):
    l = table(spark, d, "lineitem")
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    raw = F.concat(a.cast("string"), F.lit(", "), b.cast("string"), F.lit("-"), (b + F.col("l_linenumber") - 2).cast("string"), F.lit("; "), a.cast("string"))
    return l.select(raw.alias("raw")).distinct().select("raw", F.array_join(citations.expand(F.col("raw")), ",").alias("indices"))


def line_scan(spark, d):
    return _scanned(spark, d).select("doc_id", "line_no", "kind", "section")


def paragraphs(spark, d):
    return _paragraphs(spark, d).select("doc_id", "paragraph_id", "section", "paragraph")


def attach_citations(spark, d):
    return _sentences(spark, d).select("doc_id", "paragraph_id", "sentence_no", "sentence")


def attach_counts(spark, d):
    rows = _paragraphs(spark, d).select("doc_id", citations.attach_counts(text.split_sentences(F.col("paragraph"))).alias("c"))
    return rows.groupBy("doc_id").agg(F.sum("c.attached").alias("attached"), F.sum("c.skipped").alias("skipped"))


def claim_type(spark, d):
    words = "method benchmark latency limitation taxonomy accuracy attack corpus story introduction".split()
    p = table(spark, d, "part")
    at = lambda k: F.array(*[F.lit(w) for w in words])[(F.col("p_partkey") % k).cast("int")]
    kind = claims.claim_type(F.concat(F.lower("p_name"), F.lit(" "), at(7)), F.concat(F.lit("Part "), at(10)))
    return p.select("p_partkey", kind.alias("claim_type"), claims.type_priority(kind, F.lit("group")).alias("group_priority"), claims.type_priority(kind, F.lit("single")).alias("single_priority"))


def group_bins(spark, d):
    return distribution.size_histogram(_bulk(spark, d), [])


def section_stats(spark, d):
    return distribution.section_stats(_bulk(spark, d), [])


def section_coverage(spark, d):
    return distribution.section_coverage(_paragraphs(spark, d), DOC)


def citation_reuse_topk(spark, d):
    return distribution.top_reuse(_bulk(spark, d), [])


def top_share(spark, d):
    return distribution.top_share(cut(_bulk(spark, d), "bulk-events"), [])


def repeated_groups(spark, d):
    return distribution.repeated_groups(_bulk(spark, d), []).select(_joined("indices").alias("indices"), "num_occurrences", "num_sections")


def group_balance(spark, d):
    return distribution.balance(_bulk(spark, d), [], max_group_size=10)


def largest_groups(spark, d):
    return distribution.largest_groups(_events(spark, d), DOC).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("group_size").alias("largest"), F.sum("group_size").alias("mentions"))


def skipped_lines(spark, d):
    return scanner.skipped_lines(_scanned(spark, d), DOC)


def resolve_citations(spark, d):
    rows = events.marker_rows(_sentences(spark, d), clauses=False).select("doc_id", "paragraph_id", "sentence_no", "no", F.explode("indices").alias("citation_index"))
    return rows.join(_ref_map(spark, d), ["doc_id", "citation_index"])


def evidence_tiers(spark, d):
    return _cards(spark, d).select("paper_id", "tier_rank", evidence.tier_name(F.col("tier_rank")).alias("tier"))


def claim_tiers(spark, d):
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_partkey") % 1200).cast("string").alias("paper_id"))
    return evidence.claim_tiers(members, _cards(spark, d), ["claim_id"])


def paper_inverse_index(spark, d):
    return evidence.inverse_index(_ref_map(spark, d), DOC).select("doc_id", "paper_id", _joined("citation_indices").alias("citation_indices"))


def claim_dedup(spark, d):
    return _events(spark, d).select("doc_id", "section", _joined("indices").alias("indices"), "clause", "scope")


def type_scope_hist(spark, d):
    found, _ = _claims(spark, d)
    return found.groupBy("claim_type", "citation_scope", "citation_mode").agg(F.count(F.lit(1)).alias("claims"), F.sum("citation_group_size").alias("members"))


def evidence_bank_ids(spark, d):
    found, _ = _claims(spark, d)
    used = evidence.bank(found, evidence.inverse_index(_ref_map(spark, d), DOC), _cards(spark, d), DOC)
    return used.select("doc_id", "paper_id", "evidence_ref_id", _joined("citation_indices").alias("citation_indices"))


def audit_counts(spark, d):
    made = audit.audit_counts(derived_manuscripts(table(spark, d, "documents")), DOC)
    return made.select("doc_id", "body_chars", "reference_chars", "substantive_headings", "table_rules", "table_mentions", "figure_mentions", "aids", "transitions", "methodology", "reference_ratio")


def _flags(spark, d):
    """Audit flags over the bulk data: an order's figures stand for a manuscript's."""
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return audit.audit_flags(o.select(
        k.alias("doc_id"), (k * 7 % 9000).alias("body_words"), (c * 13 % 30).alias("substantive_headings"), (k % 4).alias("aids"), (c % 7).alias("transitions"),
        (c * 11 % 5000).alias("reference_chars"), (k * 3 % 6000).alias("body_chars"), (c % 5 == 0).alias("claims_corpus"), (k % 6).alias("methodology"),
    ))


def audit_flags(spark, d):
    names = ["thin_overview", "reference_dominated_without_aids", "limited_depth", "broad_without_aids", "formulaic_transition", "unreproducible_corpus"]
    return _flags(spark, d).select("doc_id", *names)


def score_caps(spark, d):
    return audit.caps(_flags(spark, d), DOC).groupBy("family", "criterion", "cap").agg(F.count(F.lit(1)).alias("n"))


def _raw_scores(spark, d) -> DataFrame:
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    raw = F.when(k % 5 == 0, F.concat(F.lit("score "), (k % 13).cast("string"))).when(k % 5 == 1, F.concat((k % 6).cast("string"), F.lit(".5"))).when(k % 5 == 2, F.lit("n/a")).otherwise((k % 9 - 1).cast("string"))
    fam = F.array(*[F.lit(f) for f in scoring.FAMILIES])[(F.col("l_linenumber") % 4).cast("int")]
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", fam.alias("family"), raw.alias("raw"), (k % 2 == 0).alias("is_text"))


def score_coerce(spark, d):
    rows = _raw_scores(spark, d).withColumn("score", scoring.coerce(F.col("raw"), F.col("family"), F.col("is_text")))
    return rows.groupBy("family", "raw", "is_text", "score").agg(F.count(F.lit(1)).alias("n"))


def _scores(spark, d) -> DataFrame:
    names = F.array(*[F.lit(f) for f in scoring.FAMILIES])
    method = F.concat("l_returnflag", "l_linestatus")
    topic = F.lpad((F.col("l_suppkey") % 30 + 1).cast("string"), 3, "0")
    return table(spark, d, "lineitem").select(method.alias("method"), topic.alias("topic_id"), names[(F.col("l_linenumber") % 4).cast("int")].alias("family"), (F.col("l_partkey") % 4).cast("string").alias("criterion"), (F.col("l_quantity").cast("int") % 5 + 1).alias("score"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def family_means(spark, d):
    return _rounded(scoring.family_means(_scores(spark, d)))


def subtotals(spark, d):
    one = _scores(spark, d).groupBy("method", "topic_id", "family", "criterion").agg(F.max("score").alias("score"))
    return scoring.subtotals(one, ["method", "topic_id"])


def matched_subset(spark, d):
    # a method without two topics, which then aren't compared
    rows = scoring.matched_topics(_scores(spark, d).where(~((F.col("method") == "AF") & F.col("topic_id").isin("003", "017"))))
    return rows.groupBy("method", "topic_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


def rank_systems(spark, d):
    means = scoring.family_means(_scores(spark, d)).withColumn("Category", F.when(F.col("method") == "NO", "Reference").otherwise("General"))
    return scoring.rank_systems(_rounded(means)).select("method", "Category", "Total_Avg", "rank")


def score_upsert(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 97).cast("string").alias("method"), F.lpad((F.col("o_orderkey") % 30).cast("string"), 3, "0").alias("topic_id"), F.when(F.col("o_orderkey") % 11 == 0, "").otherwise("off").alias("api_mode"), "o_orderkey")
    best = lambda part: part.groupBy("method", "topic_id", "api_mode").agg(F.max("o_orderkey").alias("score"))
    return scoring.upsert(best(rows.where("o_orderkey % 2 = 0")), best(rows.where("o_orderkey % 2 = 1")), ["method", "topic_id", "api_mode"])


def page_sample(spark, d):
    n = (F.col("c_custkey") % 400).cast("int")
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.transform(pages.sample_indices(n), lambda i: i.cast("string")), ",").alias("pages"))


def first_pages(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("page_no")).distinct()
    return pages.first_pages(rows, ["l_orderkey"], n=3)


def input_anti_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return scoring.pending(docs, table(spark, d, "labels"), DOC)


def topic_titles(spark, d):
    rows = table(spark, d, "supplier").select(F.lpad((F.col("s_nationkey") * 2).cast("string"), 3, "0").alias("topic_id"), "s_suppkey")
    topics = table(spark, d, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("topic_id"), F.col("n_name").alias("topic"))
    return scoring.with_topics(rows, topics)


def batch_summary(spark, d):
    return scoring.summary(table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "ok").otherwise("error").alias("status")))


def windowed_events(spark, d):
    from ..streaming.incremental import windowed_counts

    return windowed_counts(table(spark, d, "events"))


def select_claims(spark, d):
    found = cut(_claims(spark, d)[0], "claims")
    return sampling.select_claims(sampling.candidates(found, _claim_tiers(spark, d, found), DOC), DOC)


def _selected(spark, d) -> DataFrame:
    found = cut(_claims(spark, d)[0], "claims")
    tiers = cut(_claim_tiers(spark, d, found), "claim-tiers")
    taken = sampling.select_claims(sampling.candidates(found, tiers, DOC), DOC)
    return found.join(taken.select("doc_id", "claim_id"), ["doc_id", "claim_id"], "left_semi").join(tiers.select("doc_id", "claim_id", "tier_rank"), ["doc_id", "claim_id"])


def budget_fit(spark, d):
    rows = _selected(spark, d).withColumn("papers", F.col("citation_group.paper_id"))
    cards = F.map_from_entries(F.transform(F.array_distinct("papers"), lambda p: F.struct(p, F.to_json(F.struct(p.alias("paper_id"), F.lit(True).alias("has_title"))))))
    body = F.to_json(F.struct(F.lit("bsc_claim_context").alias("record_type"), "claim_id", "citation_mode", "marked_sentence", "citation_group"))
    return sampling.fit_budget(rows.withColumns({"cards": cards, "body": body}), DOC, limit=4000).drop("jsonl")


def selection_violations(spark, d):
    """None: what is selected obeys all rules. ``violations`` has planted faults."""
    chosen = cut(_selected(spark, d), "selected-claims")
    used = cut(evidence.bank(chosen, evidence.inverse_index(_ref_map(spark, d), DOC), _cards(spark, d), DOC), "evidence-bank")
    return validate.violations(evidence.with_evidence_ids(chosen, used, DOC), used, DOC)


ALL = [
    citation_distribution, norm_ids, year_filter, sentence_split, clean_text, citation_extract, attached_clauses, citation_expand, line_scan, paragraphs, attach_citations, attach_counts,
    claim_type, group_bins, section_stats, section_coverage, citation_reuse_topk, top_share, repeated_groups, group_balance, largest_groups, skipped_lines, resolve_citations, evidence_tiers,
    claim_tiers, paper_inverse_index, claim_dedup, type_scope_hist, evidence_bank_ids, audit_counts, audit_flags, score_caps, score_coerce, family_means, subtotals, matched_subset, rank_systems,
    score_upsert, page_sample, first_pages, input_anti_join, topic_titles, batch_summary, windowed_events, select_claims, budget_fit, selection_violations,
]
