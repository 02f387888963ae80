"""Queries of single functions, sources and sinks, on inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import citations, claims, judged, prompts, text
from ..operators import balance, distribution, events, evidence, judging, scanner, scoring, validate
from ..operators.sampling import Budget
from ..sources import manuscripts, sinks
from ..sources.manuscripts import derived_lines, table
from ..sources.shared import cut, new_path
from .queries import DOC, _cards, _joined, _ref_map, _scanned, _scores, _sentences


def _one_of(k: Column, *parts: str | Column) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])[(k % len(parts)).cast("int")]


def _paper(k: Column) -> Column:
    """A paper id from a number: months of 2020 to 2027, five digits."""
    return F.concat(F.lpad((k % 8 + 20).cast("string"), 2, "0"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("."), F.lpad((k % 99991).cast("string"), 5, "0"))


def ref_map_scan(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    p = _paper(k)
    good = F.concat(F.lit('{"1": "arXiv:'), p, F.lit('v3", " 2 ": "https://arxiv.org/abs/'), p, F.lit('", "3": "unknown", "": "'), p, F.lit('", "x": "'), F.replace(p, F.lit("."), F.lit("")), F.lit('"}'))
    raw = F.when(k % 5 == 0, F.lit("{broken")).otherwise(good)
    return manuscripts.ref_map(o.select("o_orderkey", raw.alias("text")), ["o_orderkey"])


def metadata_lookup(spark, d):
    k = F.col("k")
    papers = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).withColumn("paper_id", _paper(k)).groupBy("paper_id").agg(F.min("k").alias("k"))
    p, bare, month = F.col("paper_id"), F.replace("paper_id", F.lit("."), F.lit("")), manuscripts.month_folder(F.col("paper_id"))
    names = F.array_compact(F.array(
        F.when(k % 7 == 0, F.concat(p, F.lit(".json"))), F.when(k % 5 == 0, F.concat(p, F.lit("_processed.json"))), F.when(k % 4 == 0, F.concat(F.lit("b_"), p, F.lit(".json"))), F.when(k % 4 == 0, F.concat(F.lit("a_"), p, F.lit(".json"))),
        F.when(k % 3 == 0, F.concat(F.lit("sub/c_"), p, F.lit(".json"))), F.when(k % 2 == 0, F.concat(month, F.lit("/d_"), p, F.lit("_processed.json"))), F.when(k % 11 != 0, F.concat(month, F.lit("/e_"), bare, F.lit("_processed.json"))),
        F.concat(F.lit("deep/er/"), p, F.lit(".json")), F.concat(p, F.lit(".txt")),
    ))
    return manuscripts.best_metadata(papers, papers.select(F.explode(names).alias("path")))


def parsed_lookup(spark, d):
    k = F.col("k")
    papers = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).withColumn("paper_id", _paper(k)).groupBy("paper_id").agg(F.min("k").alias("k"))
    p, m = F.col("paper_id"), manuscripts.month_folder(F.col("paper_id"))
    j = lambda *x: F.concat(m, *[F.lit(y) if isinstance(y, str) else y for y in x])
    files = papers.select(F.explode(F.array_compact(F.array(
        F.when(k % 9 == 0, F.concat(F.lit("/home/"), p, F.lit(".md"))), F.when(k % 8 == 0, F.concat(F.lit("/dirs/"), p, F.lit("/z.md"))), F.when(k % 8 == 0, F.concat(F.lit("/dirs/"), p, F.lit("/b.md"))),
        F.when(k % 7 == 0, j("/s_", p, "/auto/s_", p, ".md")), F.when(k % 5 == 0, j("/", p, "/", p, "/auto/", p, ".md")), F.when(k % 4 == 0, j("/v", p, "b/v", p, "b/auto/v", p, "b.md")),
        F.when(k % 3 == 0, j("/w", p, "/other/auto/x.md")), F.when(k % 2 == 0, j("/x", p, "/auto/y.md")), j("/notes/auto/notes.md"), j("/x", p, "/auto/y.txt"),
    ))).alias("path"))
    where = F.when(k % 9 == 0, F.concat(F.lit("/home/"), p, F.lit(".md"))).when(k % 8 == 0, F.concat(F.lit("/dirs/"), p)).when(k % 10 == 0, F.lit("/nowhere.md"))
    asked = papers.select("paper_id", where.alias("file_path"), manuscripts.base_names(p, F.concat(F.lit("meta/s_"), p, F.lit("_processed.json"))).alias("names"))
    return manuscripts.best_parsed(asked, files)


def page_order(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", _one_of(F.col("l_linenumber"), F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".png")), F.concat(F.col("l_suppkey").cast("string"), F.lit("_x.png")), F.lit("cover.png")).alias("name")).distinct()
    from pyspark.sql import Window

    place = lambda natural: F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*manuscripts.page_order(F.col("name"), natural)))
    return rows.select("l_orderkey", "name", place(True).alias("natural_no"), place(False).alias("plain_no"))


def sample_pairs(spark, d):
    have = _scores(spark, d).select("method", "topic_id").distinct()
    methods = spark.createDataFrame([(m,) for m in ("AF", "NO", "ZZ")], "method string")
    topics = table(spark, d, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("topic_id"))
    return scoring.samples(methods, topics, have)


def topic_discovery(spark, d):
    c = F.col("c_custkey")
    name = _one_of(c, F.concat(F.lit("ref_"), F.lpad((c % 40).cast("string"), 3, "0"), F.lit(".json")), F.lit("ref_1.json"), F.lit("ref_0001.json"), F.lit("xref_003.json"), F.lit("ref_004.json.bak"))
    files = table(spark, d, "customer").select(F.concat(F.lit("root/m"), (c % 6).cast("string"), F.lit("/"), name).alias("path"))
    return manuscripts.discovered(files)


def published_means(spark, d):
    mean = _scores(spark, d).groupBy("method", "family", "criterion").agg(F.avg("score").alias("m"))
    wide = mean.groupBy(F.col("method").alias("Method")).agg(*[F.round(F.max(F.when((F.col("family") == f) & (F.col("criterion") == str(i)), F.col("m"))), 2).alias(c) for f, cs in scoring.FAMILIES.items() for i, c in enumerate(cs)])
    out = scoring.published_means(wide.withColumn("Category", F.lit("General")))
    return out.select("Category", "Method", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def json_sink(spark, d):
    n = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("topic_id"), F.lit("m").alias("method"))
    path = new_path(spark, "json-sink")
    sinks.write_json(n, path, ["method", "topic_id"])
    sinks.write_json(n.where("topic_id = '3'").withColumn("c_custkey", -F.col("c_custkey")), path, ["method", "topic_id"])  # replaces that partition alone
    return spark.read.schema("c_custkey long, method string, topic_id string").json(path)


def jsonl_sink(spark, d):
    n = table(spark, d, "supplier").select(F.lpad((F.col("s_suppkey") % 10).cast("string"), 3, "0").alias("topic_id"), F.concat(F.lit('{"k":'), F.col("s_suppkey").cast("string"), F.lit('}\n{"é":1}\n')).alias("jsonl"))
    path = new_path(spark, "jsonl-sink")
    sinks.write_jsonl(n, path, ["topic_id"])
    return spark.read.schema("value string, topic_id string").text(path).groupBy("topic_id", "value").agg(F.count(F.lit(1)).alias("n"))


def csv_upsert(spark, d):
    s = table(spark, d, "supplier").select(F.lpad((F.col("s_suppkey") % 7).cast("string"), 3, "0").alias("topic_id"), (F.col("s_suppkey") % 3).cast("string").alias("method"), F.when(F.col("s_suppkey") % 5 == 0, "").otherwise("off").alias("api_mode"), F.col("s_suppkey").alias("score"))
    best = lambda df: df.groupBy("topic_id", "method", "api_mode").agg(F.max("score").alias("score"))
    path = new_path(spark, "csv-sink")
    for flag in (0, 1):
        sinks.upsert_csv(best(s.where((F.col("score") % 4 == 0).cast("int") == flag)), path, path + "-work", ["topic_id", "method", "api_mode"])
    return spark.read.csv(path, header=True, schema="topic_id string, method string, api_mode string, score long")


def run_log(spark, d):
    path = new_path(spark, "run-log")
    rows = table(spark, d, "nation").select(F.col("n_name").alias("step"), (F.col("n_nationkey") % 2 == 0).alias("ok"))
    sinks.append_log(rows.where("ok"), path)
    sinks.append_log(rows, path)
    return spark.read.schema("step string, ok boolean, logged_at timestamp").json(path).groupBy("step", "ok").agg(F.count("logged_at").alias("n"))


def html_tables(spark, d):
    """Lines of manuscripts with HTML tables of several lines and of one, some in code."""
    rows, n, doc = derived_lines(table(spark, d, "documents")), F.col("line_no"), F.col("doc_id")
    line = F.when((n % 9 == 3) & (doc % 3 == 0), F.lit("<TABLE class='x'><tr>")).when((n % 9 == 6) & (doc % 3 == 0), F.lit("</tr></table>")).when((n % 9 == 7) & (doc % 4 == 0), F.lit("<table><tr><td>[3]</td></tr></table>")).otherwise(F.col("line"))
    scanned = scanner.scan_lines(rows.withColumn("line", line), DOC)
    return scanned.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("at"), F.max("breaks").alias("breaks"))


def section_frames(spark, d):
    p = table(spark, d, "part")
    name = _one_of(F.col("p_partkey"), F.concat(F.lit("1 Introduction to "), F.col("p_name")), F.concat(F.lit("CONCLUSION"), F.lit("")), F.concat(F.lit("Conclusions on "), F.col("p_name")), F.col("p_name"), F.lit("Reintroduction"))
    return p.select("p_partkey", claims.intro_or_conclusion(name).alias("frame"))


def abstract_lines(spark, d):
    p, name = table(spark, d, "part"), F.col("p_name")
    line = _one_of(F.col("p_partkey"), "# Abstract", "A b s t r a c t", F.concat(F.lit("**Abstract**: "), name), F.concat(F.lit("1.2 abstract - "), name), "## 2 Introduction", "Keywords: x", "Index Terms", "**Related Work**", name, "abstractions", "3. Methodology")
    return p.select("p_partkey", text.abstract_marker(line).alias("said"), text.abstract_stop(line).alias("stops"))


def _paper_md(spark, d) -> DataFrame:
    """Documents as parsed papers: a title, an abstract in several forms, a body."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    head = _one_of(k, F.concat(F.lit("# Abstract\n"), F.lit("")), F.concat(F.lit("**Abstract**: "), F.lit("")), F.lit("A B S T R A C T\n| a | b |\n![f](x.png)\n"), F.lit("No marker here.\n"))
    title = _one_of(F.floor(k / 4), F.lit("# A *study* of [things](http://x) #\n"), F.lit("#### too deep\n## Abstract\n### Third <b>one</b>\n"), F.lit("plain\n"))
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"[#\n\r]", " ")
    return text.once(docs.select("doc_id", "text"), "md", F.concat(title, head, body, F.lit("\n\n## 1 Introduction\nnot this\n"))).select("doc_id", "md")


def paper_heads(spark, d):
    md = F.col("md")
    return _paper_md(spark, d).select("doc_id", text.extract_title(md, 40).alias("title"), text.extract_abstract(md, 200).alias("abstract"))


def shortened_items(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split("text", "\n", -1).alias("items"))
    short = text.shorten_items(F.col("items"), 3, 60)
    return docs.select("doc_id", F.size(short).alias("n"), F.array_join(short, "|").alias("items"))


def bare_citations(spark, d):
    k, o = F.col("o_orderkey"), table(spark, d, "orders")
    s = _one_of(k, F.concat(F.lit("It grew "), (k % 90 + 1).cast("string"), F.lit(".")), "See Figure 3.", "It beats GPT-4", "As shown [3] 12.", "In 2021.", "version 2", "They agree 007", "no number", "top 5", "ratio 3.5", "a [7] and then 8 .")
    method = _one_of(F.floor(k / 11), "Gemini-Deep-Research", "gemini_deep_research", "other")
    rows = o.select("o_orderkey", citations.cites_bare_numbers(method).alias("bare"), citations.bare_citation(s).alias("number"))
    known = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("number"))
    return rows.join(known, "number", "left_semi").where("bare").select("o_orderkey", "number")


def marked_targets(spark, d):
    l, k = table(spark, d, "lineitem"), F.col("l_orderkey") * 7 + F.col("l_linenumber")
    n = (k % 9 + 1).cast("string")
    s = F.concat(F.lit("One [2] and two [3, "), n, F.lit("] and more [4-6] end."))
    rows = l.select((k % 9 + 1).alias("n"), (F.col("l_partkey") % 8 + 1).cast("string").alias("target"), s.alias("s")).distinct()
    return rows.select("n", "target", citations.mark_target(F.col("s"), F.col("target")).alias("marked"), claims.mark_clause(F.concat(F.col("s"), F.lit(" !?"))).alias("clause"))


def _evidence(spark, d) -> DataFrame:
    """Cards from metadata as JSON (some malformed, some missing) and parsed papers."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    known = table(spark, d, "labels").select("doc_id").where("doc_id is not null").distinct()
    first = F.substring("text", 1, 300)
    doc = F.to_json(F.struct(
        F.struct(F.when(k % 3 != 0, F.concat(F.lit("Title "), k.cast("string"))).alias("title"), F.when(k % 4 == 0, first).alias("abstract")).alias("basic_info"),
        F.struct(F.lit("Tasks").alias("task_category"), F.array(F.lit("k1")).alias("keywords")).alias("categorization"),
        F.struct(F.concat(F.lit("M"), k.cast("string")).alias("method_name"), F.array(first, F.lit(""), F.lit("second"), F.lit("third")).alias("innovations")).alias("method_details"),
        F.struct(F.array(F.struct(F.lit("D").alias("dataset"), F.lit("F1").alias("metric"), (k % 7).cast("string").alias("value"))).alias("main_results"), F.col("lang").alias("limitations")).alias("evaluation"),
        F.struct(F.lit("one dataset").alias("datasets_used_for_eval")).alias("dataset_info"),
    ))
    raw = F.when(k % 10 == 9, F.lit("{broken")).otherwise(doc)
    meta = docs.join(known, "doc_id", "left_semi").select(k.cast("string").alias("paper_id"), F.concat(k.cast("string"), F.lit(".json")).alias("path"), F.try_parse_json(raw).alias("doc"))
    every = docs.select(k.cast("string").alias("paper_id")).join(meta, "paper_id", "left")
    parsed = docs.where(k % 6 == 0).select(k.cast("string").alias("paper_id"), F.concat(F.lit("Parsed "), k.cast("string")).alias("title"), F.concat(F.lit("An abstract of "), k.cast("string")).alias("abstract"))
    return evidence.card(every, parsed)


def evidence_cards(spark, d):
    c = evidence.compact(_evidence(spark, d))
    return c.select("paper_id", "title", "abstract", "task_category", "method_name", "limitations", _joined("innovations").alias("innovations"), _joined("datasets_used_for_eval").alias("datasets"), _joined("main_results").alias("main_results"), "evidence_tier", "tier_rank")


def evidence_misses(spark, d):
    return evidence.miss_counts(_evidence(spark, d))


def usable_citations(spark, d):
    """Citations whose index is in the reference map and whose paper has a card."""
    cards = _cards(spark, d).where("tier_rank <= 1")
    return _ref_map(spark, d).join(cards.select("paper_id"), "paper_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("paper_id").alias("least"))


def _found(spark, d, **more) -> tuple[DataFrame, DataFrame]:
    return events.claims(_sentences(spark, d), _ref_map(spark, d), _cards(spark, d), DOC, **more)


def _members(c: str = "citation_group") -> Column:
    return F.array_join(F.transform(c, lambda m: F.concat(m["citation_index"], F.lit(":"), m["paper_id"])), ",")


def claim_contexts(spark, d):
    found, _ = _found(spark, d)
    return found.select("doc_id", "claim_id", "citation_mode", "section_title", "citation_scope", "claim_type", "citation_group_size", "paragraph_id", "sentence_no", "position", _members().alias("members"))


def small_claim_groups(spark, d):
    found, groups = _found(spark, d, max_group_size=2, share=lambda flat: cut(flat, "claim-groups"))
    n = found.groupBy("citation_group_size").agg(F.count(F.lit(1)).alias("kept"))
    every = groups.groupBy(F.col("group_size").alias("citation_group_size")).agg(F.count(F.lit(1)).alias("seen"))
    return every.join(n, "citation_group_size", "left").na.fill(0)


def claim_records(spark, d):
    found, _ = _found(spark, d)
    some = cut(found.where("position <= 4"), "claims").withColumns({"_private": F.lit(1), "selection_reason": F.lit("x")})
    bank = cut(evidence.bank(some, evidence.inverse_index(_ref_map(spark, d), DOC), _cards(spark, d), DOC), "bank")
    rows = evidence.records(some, bank, DOC)
    refs = F.array_join(F.transform("citation_group", lambda m: m["evidence_ref_id"]), ",")
    return rows.select("doc_id", "claim_id", refs.alias("evidence_ref_ids"), F.lit(",".join(sorted(rows.columns))).alias("fields"))


def balance_histograms(spark, d):
    found, _ = _found(spark, d)
    sides = F.when(F.col("position") % 3 == 1, F.array(F.lit("all"), F.lit("selected"))).otherwise(F.array(F.lit("all")))
    return balance.histograms(found.select("*", F.explode(sides).alias("side")), [*DOC, "side"])


def selected_reuse(spark, d):
    found, _ = _found(spark, d)
    return balance.selected_reuse(found.where("position % 3 = 1"), DOC, 5)


def _text_map(c: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")


def balance_summary(spark, d):
    found, groups = _found(spark, d, share=lambda flat: cut(flat, "claim-groups"))
    found = cut(found, "claims")
    out = balance.summary(found, found.where("position % 3 = 1"), groups, _cards(spark, d), DOC)
    plain = [c for c in out.columns if not isinstance(out.schema[c].dataType, (type(out.schema["claim_type_distribution_all"].dataType), type(out.schema["selection_notes"].dataType)))]
    maps = [c for c, t in out.dtypes if t.startswith("map")]
    top = F.array_join(F.transform(F.slice("top_reused_papers_selected", 1, 3), lambda x: F.concat_ws(":", x["paper_id"], x["num_selected_claim_contexts"].cast("string"), x["num_sections_used"].cast("string"))), ";")
    return out.select(*plain, *[F.coalesce(_text_map(c), F.lit("")).alias(c) for c in maps], F.coalesce(top, F.lit("")).alias("top_reused"))


def syntax_counts(spark, d):
    return events.syntax_counts(_sentences(spark, d), DOC)


def distribution_report(spark, d):
    scanned = _scanned(spark, d)
    paras = cut(scanner.paragraphs(scanned, DOC), "paragraphs")
    sentences = cut(scanner.sentences(paras, DOC), "sentences")
    found = cut(events.events(sentences, DOC), "events")
    out = distribution.report(paras, found, scanner.skipped_lines(scanned, DOC), events.syntax_counts(sentences, DOC), DOC)
    listed = lambda c, *fs: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[f(x) for f in fs])), ";")
    s = lambda n: lambda x: x[n].cast("string")
    many = lambda x: F.array_join(x["indices"], ",")
    skipped = F.concat_ws(",", *[F.col(f"skipped_non_body_citation_lines.{n}").cast("string") for n in ("table", "code", "caption", "reference_entry")])
    syntax = F.concat_ws(",", *[F.col(f"citation_syntax_counts.{n}").cast("string") for n in ("separated_range_events", "numeric_bracket_events", "semicolon_group_events", "unicode_source_citation_events")])
    texts = {
        "sizes": _text_map("citation_group_size_distribution"), "claims_per_section": _text_map("cited_claims_per_section"), "mentions_per_section": _text_map("citation_mentions_per_section"), "unique_per_section": _text_map("unique_citations_per_section"),
        "reused": listed("top_reused_citations", s("citation_index"), s("num_claims"), s("num_sections")), "repeated": listed("top_repeated_exact_citation_groups", many, s("num_occurrences"), s("num_sections")),
        "largest": listed("largest_citation_groups", s("section"), many, s("group_size")), "skipped": skipped, "syntax": syntax,
    }
    return out.select("doc_id", "total_cited_claims", "section_citation_coverage_ratio", *[F.coalesce(v, F.lit("")).alias(k) for k, v in texts.items()])


def violations(spark, d):
    """Claims with faults of every rule, each at its own rhythm."""
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    size = (k % 4).cast("int")
    made = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.cast("string").alias("citation_index"), ((F.col("l_partkey") + i * 5) % 50).cast("string").alias("paper_id"), F.when(k % 29 == 0, "").otherwise("E001").alias("evidence_ref_id")))
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), k.cast("string").alias("claim_id"), F.when(k % 11 == 0, "elsewhere").otherwise("clause").alias("citation_scope"), F.when(k % 13 == 0, "many").when(size == 1, "single").otherwise("group").alias("citation_mode"),
        F.when(k % 17 == 0, "No mark here.").when(k % 19 == 0, "12 [CITE_THIS].").otherwise("Some text [CITE_THIS].").alias("marked_sentence"), F.when(k % 23 == 0, "").otherwise("x [1].").alias("original_sentence_with_citations"),
        F.slice(made, 1, size).alias("citation_group"), (size + (k % 31 == 0).cast("int")).alias("citation_group_size"), (k % 5).cast("int").alias("tier_rank"),
    )
    used = rows.select("doc_id", F.explode("citation_group.paper_id").alias("paper_id")).distinct()
    bank = used.where("cast(paper_id as int) % 10 <> 3").unionByName(rows.where("doc_id % 6 = 0").select("doc_id", F.lit("unused").alias("paper_id")).distinct())
    found = validate.violations(cut(rows, "planted"), cut(bank, "planted-bank"), DOC, Budget(records=4, papers=5, multi=2), max_group_size=2)
    return found.select("doc_id", "rule", F.coalesce("claim_id", F.lit("-")).alias("claim_id"))


def json_objects(spark, d):
    k = F.col("o_orderkey")
    n = k.cast("string")
    made = _one_of(k, F.concat(F.lit('x {"a": '), n, F.lit('} {"b": 1}')), F.concat(F.lit('{"a": {"b": "}{"}, "c": "\\"}", "d": '), n, F.lit("}} tail")), F.lit('open {"a": 1'), F.lit("none"), F.lit("{}{}"), F.concat(F.lit('"{" {"q": '), n, F.lit("}")))
    return table(spark, d, "orders").select("o_orderkey", judged.first_object(made).alias("found"), judged.unfence(F.concat(F.lit("```JSON\n"), n, F.lit("\n```"))).alias("inside"))


def response_shapes(spark, d):
    k = F.col("o_orderkey")
    n = k.cast("string")
    made = _one_of(
        k, F.concat(F.lit('{"output_text": "a'), n, F.lit('"}')), F.concat(F.lit('{"choices": [{"message": {"content": "b'), n, F.lit('"}}]}')), F.concat(F.lit('{"choices": [{"message": {"content": [{"type": "text", "text": "c'), n, F.lit('"}, "d"]}}]}')),
        F.concat(F.lit('{"output": [{"type": "reasoning"}, {"content": [{"text": "e'), n, F.lit('"}, {"text": ""}]}, {"content": [{"text": "f"}]}]}')), F.concat(F.lit("plain "), n),
    )
    return table(spark, d, "orders").select("o_orderkey", judged.response_text(made).alias("said"))


def data_urls(spark, d):
    p = table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("content"), _one_of(F.col("page_id"), "png", "JPG", "webp").alias("kind"))
    return p.select("page_id", prompts.data_url(F.col("content"), F.col("kind")).alias("url"))


def judge_prompts(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("topic"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("Be strict.")).alias("rubric"))
    made = prompts.prompt(["MAR"], F.col("rubric"), F.col("topic"), F.lit('{"a":1}'))
    return n.select("n_nationkey", F.contains(made, F.lit("Be strict.")).alias("has_rubric"), F.regexp_extract(made, "Topic: ([^\n]*)", 1).alias("topic"), F.regexp_count(made, F.lit('"score"')).alias("criteria"))


def _response(family: str, score) -> Column:
    """A response with four (or eight) criteria; ``score(i)`` is the text of the i-th score."""
    groups = {"BSC": ["BSC"], "MAR": ["MAR"]}.get(family, ["TSQ", "HDQ"])
    parts = []
    for f in groups:
        items = [F.concat(F.lit(f'"{c}": {{"score": '), score(i), F.lit(', "rationale": "a {b} \\"c\\""}')) for i, c in enumerate(judged.CRITERIA[f])]
        parts.append(F.concat(F.lit(f'"{f}": {{'), F.concat_ws(", ", *items), F.lit("}")))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def judged_scores(spark, d):
    """Responses in every shape: whole, fenced, inside a text, cut off, with other schemas, empty."""
    k, way = F.col("o_orderkey"), F.col("o_custkey") % 10
    family = _one_of(k, *judged.CRITERIA)
    score = lambda i: _one_of(F.floor(k / 4) + 5 * i, "0", "1", "2.5", "3", "3.5", "5", "9", '"4"', '"n/a"', "null")
    orders = text.once(table(spark, d, "orders"), "clean", F.coalesce(*[F.when(family == f, _response(f, score)) for f in judged.CRITERIA]))
    clean = F.col("clean")
    cut_off = F.substring(clean, F.lit(1), F.length(clean) - 1)
    swapped = F.regexp_replace(F.replace(clean, F.lit('"BSC"'), F.lit('"scores"')), '"MAR"', '"other"')
    former = F.replace(clean, F.lit("Citation Distribution Balance"), F.lit("Citation Evidence Balance"))
    raw = (
        F.when(way == 0, clean).when(way == 1, F.concat(F.lit("```json\n"), clean, F.lit("\n```"))).when(way == 2, F.concat(F.lit("Here: "), clean, F.lit(" Done."))).when(way == 3, cut_off).when(way == 4, swapped).when(way == 5, former)
        .when(way == 6, F.lit("no answer")).when(way == 7, F.lit("[1, 2]")).when(way == 8, F.lit(" "))
    )
    rows = orders.select(F.col("o_orderkey").alias("doc_id"), family.alias("family"), raw.alias("raw_response"))
    out = judging.scores(cut(rows, "responses"), DOC)
    return out.groupBy("family", "criterion", "status", F.coalesce("score", F.lit(-1)).alias("score"), F.coalesce("warning", F.lit("")).alias("warning"), "rationale").agg(F.count(F.lit(1)).alias("n"))


ALL = [
    ref_map_scan, metadata_lookup, parsed_lookup, page_order, sample_pairs, topic_discovery, published_means, json_sink, jsonl_sink, csv_upsert, run_log, html_tables, section_frames, abstract_lines, paper_heads,
    shortened_items, bare_citations, marked_targets, evidence_cards, evidence_misses, usable_citations, claim_contexts, small_claim_groups, claim_records, balance_histograms, selected_reuse, balance_summary, syntax_counts,
    distribution_report, violations, json_objects, response_shapes, data_urls, judge_prompts, judged_scores,
]
