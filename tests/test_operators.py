"""Operators against sequential simulations, fixtures and published figures."""

import random
import re
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioscope.operators import audit, distribution, events, evidence, sampling, scanner, scoring, validate
from folioscope.plans import registry
from folioscope.sources import manuscripts, sinks
from folioscope.streaming import incremental

KEY = ["doc_id"]
KINDS = ["# Section a", "# References", "References", "```", "~~~ x", "<table> [1]", "</table> [2]", "<table></table> [3]", "| a | [4] |", "Table 3 caption [5]", "[6] Doe, A Journal", "", "plain text [7].", "More words here.", "## "]


def simulate(lines):
    """Kinds, sections and paragraphs by going through the lines."""
    code = html = False
    section, paras, now, kinds = "Untitled", [], None, []

    def flush():
        nonlocal now
        if now:
            paras.append(now)
        now = None

    for s in lines:
        if s.startswith(("```", "~~~")):
            flush()
            code = not code
            kinds.append("fence")
        elif code:
            kinds.append("code")
        elif re.match(r"^\[\d+\] .*Journal", s):
            flush()
            kinds.append("reference_entry")
        elif "<table" in s:
            flush()
            html = html or "</table>" not in s
            kinds.append("table_html")
        elif html:
            html = "</table>" not in s
            kinds.append("table_html")
        elif s.count("|") >= 2:
            flush()
            kinds.append("table")
        elif s.startswith("Table 3"):
            kinds.append("caption")
        elif re.match(r"^#+ \S", s):
            flush()
            section = s.split(" ", 1)[1]
            kinds.append("heading")
        elif s == "References":
            flush()
            section = s
            kinds.append("references")
        elif section == "References":
            kinds.append("closed")
        elif s == "":
            flush()
            kinds.append("blank")
        else:
            now = now or (section, [])
            now[1].append(s)
            kinds.append("text")
    flush()
    return kinds, [(sec, " ".join(p)) for sec, p in paras]


def test_scanner_is_the_sequential_scan(spark):
    r = random.Random(1)
    docs = [[r.choice(KINDS).strip() for _ in range(r.randint(1, 40))] for _ in range(120)]
    df = spark.createDataFrame([(i, "\n".join(d)) for i, d in enumerate(docs)], "doc_id long, md string")
    scanned = scanner.scan_lines(scanner.explode_lines(df, KEY), KEY)
    kinds, paras = {}, {}
    for row in scanned.orderBy("doc_id", "line_no").collect():
        kinds.setdefault(row["doc_id"], []).append(row["kind"])
    for row in scanner.paragraphs(scanned, KEY).orderBy("doc_id", "paragraph_id").collect():
        paras.setdefault(row["doc_id"], []).append((row["section"], row["paragraph"]))
    for i, d in enumerate(docs):
        want = simulate(d)
        assert kinds[i] == want[0] and paras.get(i, []) == want[1]


def test_scanner_sorts_once(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, md string")
    plan = scanner.scan_lines(scanner.explode_lines(df, KEY), KEY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


LONG = "the retrieval of many long documents needs an index that fits in memory"


def test_events_merge_and_repeat(spark):
    md = f"# Intro\nWe say that {LONG} [1] [2]. Then, {LONG} [3].\n\nWe say that {LONG} [1] [2].\n# References\n[1] Doe, Journal 2020"
    df = spark.createDataFrame([(1, md)], "doc_id long, md string")
    got = events.events(scanner.scan(df, KEY), KEY).orderBy("paragraph_id", "sentence_no").collect()
    assert [(r["section"], r["indices"]) for r in got] == [("Intro", ["1", "2"]), ("Intro", ["3"])]


def test_report(spark):
    md = f"# A\nWe say {LONG} [1, 2]. And {LONG} of others [1-6].\n\n# B\nWhat is {LONG} here 【7†x】.\n\n| a | [3] |"
    df = spark.createDataFrame([(1, md), (2, "# C\nNothing is cited.")], "doc_id long, md string")
    lines = scanner.scan_lines(scanner.explode_lines(df, KEY), KEY)
    paras = scanner.paragraphs(lines, KEY)
    sents = scanner.sentences(paras, KEY)
    found = events.events(sents, KEY)
    rows = {r["doc_id"]: r for r in distribution.report(paras, found, scanner.skipped_lines(lines, KEY), events.syntax_counts(sents, KEY), KEY).collect()}
    one = rows[1]
    assert (one["total_body_sections"], one["sections_with_citations"], one["total_cited_claims"], one["total_citation_mentions"]) == (2, 2, 3, 9)
    assert one["citation_group_size_distribution"] == {"1": 1, "2": 1, "5-8": 1}
    assert one["top_reused_citations"][0]["citation_index"] == "1" and one["skipped_non_body_citation_lines"]["table"] == 1
    assert one["citation_syntax_counts"]["unicode_source_citation_events"] == 1
    assert rows[2]["total_cited_claims"] == 0 and rows[2]["section_citation_coverage_ratio"] == 0


def test_top_reuse_of_more_than_20(spark):
    found = spark.createDataFrame([("d", "A", [str(i) for i in range(1, k + 1)]) for k in range(1, 31)], "doc_id string, section string, indices array<string>")
    for key in ([], KEY):
        for n in (5, 25):
            got = [(r["rank"], r["citation_index"], r["num_claims"]) for r in distribution.top_reuse(found, key, n).orderBy("rank").collect()]
            assert got == [(i, str(i), 31 - i) for i in range(1, n + 1)]


def chosen(spark):
    r = random.Random(2)
    text = "\n\n".join(f"# S{i % 5}\nIn step {i} {LONG} number {i} [{', '.join(str(r.randint(1, 40)) for _ in range(r.randint(1, 9)))}]." for i in range(120))
    df = spark.createDataFrame([(1, text), (2, text.replace("step", "part"))], "doc_id long, md string")
    refs = spark.createDataFrame([(d, str(i), f"p{i % 30}") for d in (1, 2) for i in range(1, 38)], "doc_id long, citation_index string, paper_id string")
    cards = spark.createDataFrame([(f"p{i}", i % 4) for i in range(28)], "paper_id string, tier_rank int")
    found, _ = events.claims(scanner.scan(df, KEY), refs, cards, KEY)
    tiers = evidence.claim_tiers(found.select("doc_id", "claim_id", F.explode("citation_group.paper_id").alias("paper_id")), cards, ["doc_id", "claim_id"])
    return found, tiers, refs, cards


def test_selection_obeys_budgets(spark):
    found, tiers, refs, cards = chosen(spark)
    found.persist(), tiers.persist()
    budget = sampling.Budget(records=30, papers=12, multi=10)
    taken = sampling.select_claims(sampling.candidates(found, tiers, KEY), KEY, budget)
    own = found.join(taken, ["doc_id", "claim_id"]).join(tiers.select("doc_id", "claim_id", "tier_rank"), ["doc_id", "claim_id"])
    bank = evidence.bank(own, evidence.inverse_index(refs, KEY), cards, KEY)
    full = evidence.with_evidence_ids(own, bank, KEY)
    assert validate.violations(full, bank, KEY, budget).count() == 0
    per = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(per) == 2 and all(r["n"] <= 30 for r in per)
    assert {r["papers"] <= 12 for r in sampling.selection_stats(sampling.candidates(found, tiers, KEY), KEY, budget).collect()} == {True}
    shuffled = sampling.select_claims(sampling.candidates(found.repartition(7), tiers, KEY), KEY, budget)
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, taken.collect()))
    broken = full.withColumn("citation_scope", F.lit("x"))
    assert {r["rule"] for r in validate.violations(broken, bank, KEY, budget).collect()} == {"scope"}


def test_budget_fit(spark):
    found, tiers, _, _ = chosen(spark)
    rows = found.join(tiers.select("doc_id", "claim_id", "tier_rank"), ["doc_id", "claim_id"]).withColumn("papers", F.col("citation_group.paper_id"))
    rows = rows.withColumns({"cards": F.map_from_entries(F.transform(F.array_distinct("papers"), lambda p: F.struct(p, F.to_json(F.struct(p.alias("t")))))), "body": F.to_json(F.struct("claim_id", "citation_group"))}).persist()
    for limit in (10**7, 6000, 400, 10):
        for r in sampling.fit_budget(rows, KEY, limit).collect():
            assert r["jsonl"] is None or len(r["jsonl"]) <= limit
            assert r["truncated"] == (limit < 10**7)
    assert {r["jsonl"] is None for r in sampling.fit_budget(rows, KEY, 10).collect()} == {True}


def test_evidence_cards(spark):
    docs = ['{"basic_info": {"title": "T", "abstract": "From metadata"}, "categorization": {"keywords": "one"}, "evaluation": {"main_results": ["a", {"dataset": "d", "value": 3}]}}', '{"basic_info": {"title": ""}}', "{broken", None]
    meta = spark.createDataFrame([(f"p{i}", d) for i, d in enumerate(docs)], "paper_id string, raw string").select("paper_id", F.try_parse_json("raw").alias("doc"))
    parsed = spark.createDataFrame([("p1", "From the text", "Own title"), ("p2", "", "Only title"), ("p4", "Abstract alone", "")], "paper_id string, abstract string, title string")
    cards = evidence.card(meta, parsed)
    got = {r["paper_id"]: r for r in cards.collect()}
    assert [got[f"p{i}"]["evidence_tier"] for i in range(5)] == ["metadata_and_abstract", "metadata_and_abstract", "title_only", "insufficient", "abstract_only"]
    assert got["p0"]["keywords"] == ["one"] and got["p1"]["title"] == "Own title"
    small = {r["paper_id"]: r for r in evidence.compact(cards).collect()}
    assert small["p0"]["main_results"] == ["a", "dataset=d; value=3"] and small["p0"]["innovations"] is None
    assert evidence.miss_counts(cards).first()["without_evidence"] == 1


def test_reference_maps_and_metadata(spark):
    raw = spark.createDataFrame([(1, '{" 1 ": "arXiv:2301.12345v2", "01": "2302.00001", "3": "junk", "4": "1901.00001"}')], "doc_id long, text string")
    refs = manuscripts.ref_map(raw, KEY)
    assert sorted((r["citation_index"], r["paper_id"]) for r in refs.collect()) == [("01", "2302.00001"), ("1", "2301.12345"), ("4", "1901.00001")]
    assert evidence.filter_years(refs).count() == 2
    files = spark.createDataFrame([("2023_new/2023-01/230112345_processed.json",), ("x/a_2301.12345.json",), ("b_2301.12345.json",), ("a_2301.12345.json",), ("2302.00001.json",)], "path string")
    best = {r["paper_id"]: r["path"] for r in manuscripts.best_metadata(refs, files).collect()}
    assert best == {"2301.12345": "a_2301.12345.json", "2302.00001": "2302.00001.json"}
    names = spark.range(1).select(manuscripts.base_names(F.lit("2301.12345"), F.lit("d/ab_2301.12345_processed.json")).alias("n")).first()["n"]
    assert names == ["ab_2301.12345", "12345_2301.12345", "2301.12345"]


def test_audit_and_caps(spark):
    thin = "# A\nfew words\n# References\n" + "[1] x\n" * 50
    rich = "\n".join(f"# H{i}\n" + "word " * 400 + ("Building upon this. " if i < 4 else "") for i in range(21))
    corpus = "# A\nA systematic literature review of Scopus. Table 2 and Fig. 3.\n|---|---|\n# 7 Bibliography of all\nz"
    df = spark.createDataFrame(list(enumerate([thin, rich, corpus, ""])), "doc_id long, md string")
    got = {r["doc_id"]: r for r in audit.audit_flags(audit.audit_counts(df, KEY)).collect()}
    assert got[0]["thin_overview"] and got[0]["reference_dominated_without_aids"] and got[0]["body_words"] == 3
    assert got[1]["broad_without_aids"] and got[1]["formulaic_transition"] and not got[1]["limited_depth"]
    assert got[2]["unreproducible_corpus"] and got[2]["aids"] == 3 and got[2]["reference_chars"] == len("# 7 Bibliography of all\nz")
    assert got[3]["reference_ratio"] is None
    caps = audit.caps(audit.audit_flags(audit.audit_counts(df, KEY)), KEY)
    scores = spark.createDataFrame([(0, "TSQ", audit.TSQ[0], 5), (0, "TSQ", audit.TSQ[1], 2), (1, "HDQ", audit.HDQ[1], 5), (1, "HDQ", audit.HDQ[0], 5)], "doc_id long, family string, criterion string, score int")
    out = {(r["doc_id"], r["criterion"]): (r["score"], r["lowered"]) for r in audit.apply_caps(scores, caps, KEY).collect()}
    assert out == {(0, audit.TSQ[0]): (3, True), (0, audit.TSQ[1]): (2, False), (1, audit.HDQ[1]): (4, True), (1, audit.HDQ[0]): (5, False)}


HEAD = "Category,Method," + ",".join(f"{c}" for f, cs in scoring.FAMILIES.items() for c in [*cs, f"{f}_Avg"]) + ",Total_Avg"
#: One published row of each of two systems, in the order BSC, TSQ, HDQ, MAR.
PUBLISHED = ["Reference,Human,3.87,3.90,3.53,4.07,3.84,4.23,4.23,4.40,4.30,4.29,4.47,4.07,4.37,4.07,4.24,5.00,5.00,5.00,5.00,5.00,4.34", "General,Codex,3.00,3.43,2.73,2.03,2.80,3.00,3.00,3.00,2.97,2.99,3.43,2.43,3.07,2.07,2.75,5.00,1.77,5.00,5.00,4.19,3.18"]


def test_published_means(spark, tmp_path):
    path = tmp_path / "results.csv"
    path.write_text("\n".join([HEAD, *PUBLISHED]))
    table = manuscripts.published(spark, str(path))
    stated = {r["Method"]: r for r in table.collect()}
    for r in scoring.published_means(table).collect():
        for c in ["BSC_Avg", "TSQ_Avg", "HDQ_Avg", "MAR_Avg", "Total_Avg"]:
            assert abs(r[c] - stated[r["Method"]][c]) <= 0.0051
    ranks = {r["Method"]: r["rank"] for r in scoring.rank_systems(table).collect()}
    assert ranks == {"Human": None, "Codex": 1}


def test_upsert_csv_and_sinks(spark, tmp_path):
    schema = "method string, topic_id string, api_mode string, score int"
    first = spark.createDataFrame([("a", "001", "off", 1), ("b", "001", "off", 2), ("", "002", "off", 3)], schema)
    second = spark.createDataFrame([("a", "001", "off", 9), ("c", "000", "on", 4)], schema)
    key = ["topic_id", "method", "api_mode"]
    for part in (first, second):
        sinks.upsert_csv(part, str(tmp_path / "t"), str(tmp_path / "w"), key)
    rows = spark.read.csv(str(tmp_path / "t"), header=True, schema=schema).collect()
    assert [tuple(r) for r in rows] == [("c", "000", "on", 4), ("a", "001", "off", 9), ("b", "001", "off", 2)]
    sinks.write_json(first, str(tmp_path / "j"), ["method", "topic_id"])
    sinks.append_log(second, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_stream_of_manuscripts(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    make = lambda i, text: spark.createDataFrame([(i, text)], "doc_id long, md string").coalesce(1).write.mode("append").parquet(str(src))
    make(1, f"# A\nWe say {LONG} [1].")
    run = lambda: incremental.stream_distributions(spark.readStream.schema("doc_id long, md string").parquet(str(src)), str(out), str(tmp_path / "cp"), KEY).awaitTermination()
    run()
    make(2, f"# A\nWe say {LONG} [1, 2].")
    run()
    make(1, f"# A\nWe say {LONG} [1, 2, 3].")
    run()
    got = {r["doc_id"]: r["total_citation_mentions"] for r in incremental.latest(spark, str(out)).collect()}
    assert got == {1: 3, 2: 2}


def test_page_images(spark, tmp_path):
    for n in ("p10.png", "p2.jpg", "cover.webp", "x.txt"):
        (tmp_path / n).write_bytes(b"1")
    rows = manuscripts.page_images(spark, str(tmp_path)).orderBy("page_no").collect()
    assert [Path(r["path"]).name for r in rows] == ["p2.jpg", "p10.png", "cover.webp"]


def test_every_query_has_a_name_and_an_independent_counterpart():
    names = set(registry.queries())
    assert set(registry.oracle_sql()) <= names and len(names) >= 45


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    sf = Path("/root/testdata/sf0.001")
    if not sf.exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for p in sf.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = registry.queries()[name](spark, str(sf))
    cols = sorted(got.columns)
    names = ", ".join(f'"{c}"' for c in cols)
    want = con.sql(f"SELECT {names} FROM ({registry.oracle_sql()[name]})").fetchall()
    plain = lambda row: str(tuple(round(float(v), 6) if isinstance(v, (float, Decimal)) else v for v in row))
    assert sorted(map(plain, want)) == sorted(map(plain, got.select(*cols).collect()))
