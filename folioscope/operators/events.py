"""Citation events and claims: what is cited, where, and by which clause."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import SPLIT_RANGE, attach, bare_citation, cites_bare_numbers, expand, join_split_ranges, marker_indices, markers
from ..functions.claims import attached_clause, claim_type, clause_key, evaluable, mark_clause, similar_keys
from ..functions.text import clean_sentence, let, let_any, once, split_sentences
from .scanner import parts


def merge_clauses(found: Column, cited: str) -> Column:
    """Within a sentence, a clause joins the first earlier one of its scope that is similar;
    what they cite is united in order."""

    def merged(found: Column) -> Column:
        def step(places: Column, one: Column) -> Column:
            # the fold carries places alone: what it has so far is copied at every step
            alike = F.transform(places, lambda p, i: (p == i) & (found[i]["scope"] == one["scope"]) & similar_keys(found[i]["key"], one["key"]))
            return let(F.array_position(alike, True).cast("int") - 1, lambda at: F.concat(places, F.array(F.when(at >= 0, at).otherwise(F.size(places)))))

        def united(places: Column) -> Column:
            every = lambda at: F.filter(found, lambda x, i: places[i] == at)
            one = lambda k, at: let(every(at), lambda x: F.when(F.size(x) == 1, k).otherwise(k.withField(cited, F.array_distinct(F.flatten(F.transform(x, lambda y: y[cited]))))))
            apart = F.size(F.array_distinct(places)) == F.size(places)
            return F.when(apart, found).otherwise(F.transform(F.array_distinct(places), lambda at: one(found[at], at)))

        return let(F.aggregate(found, F.array().cast("array<int>"), step), united)

    return F.when(F.size(found) < 2, found).otherwise(let(found, merged))


def _whole(sentences: DataFrame) -> DataFrame:
    """Sentences that may hold a marker, with split ranges joined in the column whole."""
    return sentences.where(F.col("sentence").contains("[") | F.col("sentence").contains("【")).withColumn("whole", join_split_ranges(F.col("sentence")))


def _cited(indices: Column, before: Column, after: Column, whole: Column) -> Column:
    """(indices, clause, scope, key) of a marker; null if it cites nothing or has no clause."""
    found = lambda i, c: F.struct(i.alias("indices"), c["clause"].alias("clause"), c["scope"].alias("scope"), clause_key(c["clause"]).alias("key"))
    attached = lambda i: let(attached_clause(whole, before, after), lambda c: F.when(c["clause"] != "", found(i, c)))
    return let(indices, lambda i: F.when(F.size(i) > 0, attached(i)))


def clauses(whole: Column, fit: Callable[[Column], Column] | None = None) -> Column:
    """[(indices, clause, scope, key)] of a sentence's markers (those that ``fit``) that cite something
    and have a clause, in their order. A sentence stays one row: nothing is to be collected again."""
    chosen = F.filter(markers(whole), lambda m: fit(m["marker"])) if fit else markers(whole)
    return F.array_compact(F.transform(chosen, lambda m: _cited(marker_indices(m["marker"]), m["before"], m["after"], whole)))


def cites(paragraph: Column) -> Column:
    """Whether a paragraph has an event; the first one found is enough."""
    event = lambda whole, m: _cited(marker_indices(m["marker"]), m["before"], m["after"], whole)
    marked = lambda whole: F.exists(markers(whole), lambda m: F.coalesce(let(event(whole, m), lambda e: evaluable(e["clause"])), F.lit(False)))
    may = lambda c: F.contains(c, F.lit("[")) | F.contains(c, F.lit("【"))
    return may(paragraph) & F.exists(attach(split_sentences(paragraph)), lambda s: may(s) & let(join_split_ranges(s), marked))


def bare_clauses(whole: Column) -> Column:
    """As ``clauses``, of the bare number that a sentence ends in: at most one."""
    at, after = F.regexp_extract(whole, r"^(.*?)(\d{1,3})\s*[.,;:!?]?\s*$", 1), F.regexp_extract(whole, r"\d{1,3}(\s*[.,;:!?]?\s*)$", 1)
    return F.array_compact(F.array(let(bare_citation(whole), lambda number: F.when(number.isNotNull(), _cited(expand(number), at, after, whole)))))


def marker_rows(sentences: DataFrame, clauses: bool = True) -> DataFrame:
    """One row a marker: columns marker, no, indices and, if they are wanted, clause, scope."""
    each = _whole(sentences).select("*", F.posexplode(markers(F.col("whole"))).alias("no", "m"))
    each = once(each, "indices", marker_indices(F.col("m.marker"))).where(F.size("indices") > 0)
    if not clauses:
        return each.withColumn("marker", F.col("m.marker")).drop("m", "whole")
    each = once(each, "c", attached_clause(F.col("whole"), F.col("m.before"), F.col("m.after")))
    return each.withColumns({"marker": F.col("m.marker"), "clause": F.col("c.clause"), "scope": F.col("c.scope")}).drop("m", "c", "whole")


def events(sentences: DataFrame, key: list[str]) -> DataFrame:
    """key, section, indices, clause, scope, group_size, position: what the body cites,
    independent of any reference map. Repeats of (section, clause, indices) count once."""
    place = [*key, "paragraph_id", "sentence_no", "section"]
    rows = once(_whole(sentences), "found", F.filter(clauses(F.col("whole")), lambda x: evaluable(x["clause"])))
    merged = rows.select(*place, F.posexplode(merge_clauses(F.col("found"), "indices")).alias("no", "e"))
    flat = merged.select(*place, "no", F.col("e.clause").alias("clause"), F.col("e.scope").alias("scope"), F.col("e.key").alias("key"), F.col("e.indices").alias("indices"))
    first = F.row_number().over(Window.partitionBy(*key, "section", "key", "indices").orderBy("paragraph_id", "sentence_no", "no"))
    kept = flat.withColumn("first", first).where("first = 1")
    return kept.select(*key, "section", "indices", "clause", "scope", "paragraph_id", "sentence_no", "no", F.size("indices").alias("group_size"))


def syntax_counts(sentences: DataFrame, key: list[str]) -> DataFrame:
    """Per sample: split ranges, numeric brackets, those with semicolons, and sources."""
    split = sentences.groupBy(*key).agg(F.sum(F.regexp_count("sentence", F.lit(SPLIT_RANGE))).alias("separated_range_events"))
    bracket = F.col("marker").startswith("[")
    marks = marker_rows(sentences, clauses=False).groupBy(*key).agg(
        F.count_if(bracket).alias("numeric_bracket_events"), F.count_if(bracket & F.contains(F.col("marker"), F.lit(";"))).alias("semicolon_group_events"), F.count_if(~bracket).alias("unicode_source_citation_events")
    )
    return split.join(marks, key, "left").na.fill(0)


def papers_by_index(refs: DataFrame, key: list[str]) -> DataFrame:
    """key, papers: a sample's reference map as a map from index to its papers, one as a rule."""
    entries = F.sort_array(F.collect_list(F.struct("citation_index", "paper_id")))

    def mapped(e: Column) -> Column:
        names = F.array_distinct(e["citation_index"])
        many = F.transform(names, lambda n: F.transform(F.filter(e, lambda x: x["citation_index"] == n), lambda x: x["paper_id"]))
        return F.map_from_arrays(names, F.when(F.size(names) == F.size(e), F.transform(e, lambda x: F.array(x["paper_id"]))).otherwise(many))

    # dealt as the scanner deals lines, so that they meet a sample's sentences where these lie
    refs = refs.where("citation_index is not null").repartition(parts(refs.sparkSession), *key)
    return refs.groupBy(*key).agg(entries.alias("e")).select(*key, let_any(F.col("e"), mapped).alias("papers"))


def cited_papers(indices: Column, papers: Column) -> Column:
    """[(citation_index, paper_id)] of the indices that the map knows, in their order."""
    return F.flatten(F.transform(F.filter(indices, lambda i: F.map_contains_key(papers, i)), lambda i: F.transform(F.element_at(papers, i), lambda p: F.struct(i.alias("citation_index"), p.alias("paper_id")))))


def claims(sentences: DataFrame, ref_map: DataFrame, cards: DataFrame, key: list[str], method: Column | None = None, max_group_size: int = 15, share: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(claims, all groups). A citation counts if its index is in the sample's reference
    map and its paper has a card. ``ref_map``: key, citation_index, paper_id; ``cards``:
    paper_id. All groups are the sizes and scopes before large groups and repeats go.

    Each group is [(citation_index, paper_id)] in order of citation. A caller that reads both
    results says by ``share`` how to keep what they have in common (``shared.cut``).
    """
    known = ref_map.join(cards.select("paper_id").distinct(), "paper_id", "left_semi")
    place = [*key, "paragraph_id", "sentence_no", "section"]
    # a marker that isn't an opaque source is a numeric bracket
    found = clauses(F.col("whole"), lambda marker: ~F.contains(marker, F.lit("†")))
    if method is None:
        rows = once(_whole(sentences), "found", found)
    else:
        rows = sentences.withColumns({"whole": join_split_ranges(F.col("sentence")), "bare": cites_bare_numbers(method)})
        rows = once(rows, "found", F.concat(found, F.when(F.col("bare"), bare_clauses(F.col("whole"))).otherwise(F.array())))
    # rows of a sample meet its references as one row, so they lie together from the scanner on
    resolved = rows.where(F.size("found") > 0).select(*place, "sentence", "found").join(papers_by_index(known, key), key)
    group = lambda x: F.struct(x["clause"].alias("clause"), x["scope"].alias("scope"), x["key"].alias("key"), cited_papers(x["indices"], F.col("papers")).alias("group"))
    groups = once(resolved, "groups", F.filter(F.transform("found", group), lambda x: F.size(x["group"]) > 0)).where(F.size("groups") > 0)
    merged = groups.select(*place, "sentence", F.posexplode(merge_clauses(F.col("groups"), "group")).alias("no", "e"))
    flat = merged.select(*place, "sentence", "no", "e.clause", "e.scope", "e.key", "e.group").where(evaluable(F.col("clause"))).withColumn("group_size", F.size("group"))
    flat = share(flat) if share else flat
    kept = flat.where(F.col("group_size") <= max_group_size)
    first = F.row_number().over(Window.partitionBy(*key, "section", "key", "group").orderBy("paragraph_id", "sentence_no", "no"))
    kept = kept.withColumn("first", first).where("first = 1").drop("first")
    kept = kept.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy("paragraph_id", "sentence_no", "no")))
    kept, text = once(kept, "text", clean_sentence(F.col("clause"), 700)), F.col("text")
    out = kept.select(
        *key, F.format_string("%s-C%04d", F.col(key[-1]).cast("string"), "position").alias("claim_id"),
        F.when(F.col("group_size") == 1, "single").otherwise("group").alias("citation_mode"), F.col("section").alias("section_title"),
        mark_clause(text).alias("marked_sentence"), clean_sentence(F.col("sentence"), 900).alias("original_sentence_with_citations"),
        F.col("group").alias("citation_group"), F.col("group_size").alias("citation_group_size"), F.col("scope").alias("citation_scope"),
        claim_type(text, F.col("section")).alias("claim_type"), "paragraph_id", "sentence_no", "position",
    )
    return out, flat.select(*key, "group_size", "scope")
