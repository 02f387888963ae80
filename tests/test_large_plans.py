"""Plans that do each piece of work once, and the odd inputs that such plans must not break."""

import json

from pyspark.sql import functions as F

from folioscope.functions import citations, judged
from folioscope.operators import events, judging, sampling, scanner, validate
from folioscope.plans import parts

KEY = ["doc_id"]
LONG = "the retrieval of many long documents needs an index that fits in memory"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_response_is_parsed_once_a_rung(spark):
    item = lambda n: f'"{n}": {{"score": 4, "rationale": "r"}}'
    bodies = {f: "{" + f'"{f}": {{' + ", ".join(map(item, names)) + "}}" for f, names in judged.CRITERIA.items()}
    rows = [(i, f, b) for i, (f, b) in enumerate(bodies.items())] + [(9, "BSC", None), (10, "MAR", "no"), (11, "TSQ", json.dumps({"output_text": bodies["TSQ"]}))]
    out = judging.scores(spark.createDataFrame(rows, "doc_id long, family string, raw_response string"), KEY)
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["score"], r["status"]))
    assert all(got[i] == [(4, "ok")] * 4 for i in (0, 1, 2, 3, 11)) and got[9] == [(None, "no_response")] * 4 and got[10] == [(None, "unparsed")] * 4
    assert plan(out).count("try_variant_get") <= 200  # 434 before


def test_papers_are_compared_in_one_aggregation(spark):
    schema = "doc_id long, claim_id string, citation_scope string, citation_mode string, marked_sentence string, original_sentence_with_citations string, citation_group array<struct<citation_index:string,paper_id:string,evidence_ref_id:string>>, citation_group_size int, tier_rank int"
    row = lambda d, *papers: (d, "c", "clause", "single", "x [CITE_THIS]", "x", [("1", p, "E") for p in papers], len(papers), 0)
    claims = spark.createDataFrame([row(1, "a", "b"), row(2, "a"), row(3, None)], schema)
    bank = spark.createDataFrame([(1, "a"), (1, "a"), (1, "c"), (2, "a"), (3, None), (4, "d"), (4, "e")], "doc_id long, paper_id string")
    found = validate.violations(claims, bank, KEY, sampling.Budget(papers=1))
    got = sorted((r["doc_id"], r["rule"], r["claim_id"] or "") for r in found.collect())
    assert got == [(1, "not_in_bank", "b"), (1, "paper_budget", ""), (1, "unused_paper", "c"), (3, "not_in_bank", ""), (3, "unused_paper", ""), (4, "paper_budget", ""), (4, "unused_paper", "d"), (4, "unused_paper", "e")]
    assert "Join" not in plan(found)


def test_clauses_are_found_once(spark):
    lines = spark.createDataFrame([(1, "a\nb")], "doc_id long, md string")
    assert plan(events.events(scanner.scan(lines, KEY), KEY)).count("by contrast") == 1


def test_references_with_several_papers(spark):
    md = f"# A\nWe say {LONG} [2, 1, 9]. And more of it is said here by these authors [1-3]."
    refs = spark.createDataFrame([(1, "1", "p3"), (1, "1", "p2"), (1, "2", "p1"), (1, "3", "gone"), (1, None, "p1"), (2, "9", "p1")], "doc_id long, citation_index string, paper_id string")
    cards = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "paper_id string")
    found, groups = events.claims(scanner.scan(spark.createDataFrame([(1, md)], "doc_id long, md string"), KEY), refs, cards, KEY)
    got = [[tuple(m) for m in r["citation_group"]] for r in found.orderBy("position").collect()]
    assert got == [[("2", "p1"), ("1", "p2"), ("1", "p3")], [("1", "p2"), ("1", "p3"), ("2", "p1")]]
    assert sorted(r["group_size"] for r in groups.collect()) == [3, 3]


def test_sentences_with_and_without_lone_citations(spark):
    rows = [["It is.", "[1]", "X [2].", "[3].", "[4]; 5."], ["[1]", "a", "b"], ["[1]"], [], ["a", "b"], ["Été.", "【7†x】"]]
    df = spark.createDataFrame([(r,) for r in rows], "s array<string>").select(citations.attach(F.col("s")).alias("s"))
    assert [r["s"] for r in df.collect()] == [["It is. [1]", "X [2]. [3]. [4]; 5."], ["a", "b"], [], [], ["a", "b"], ["Été. 【7†x】"]]


def test_histograms_and_contexts_read_the_documents_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"We say {LONG}\nand so on\n" * 9, "en", "s", 700) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for q in (parts.claim_contexts, parts.balance_histograms, parts.selected_reuse):
        df = q(spark, str(tmp_path))
        # lines once, the reference map, the cards and those of the semi-join at most
        assert plan(df).count("posexplode(split(") == 1 and df.count() > 0


def test_samples_go_to_python_many_at_a_time(spark):
    pool = spark.createDataFrame(
        [(d, f"c{i}", "single", "S", 1, "other", i, 0, [f"p{i}"], "1", False, 1) for d in range(300) for i in (2, 1)],
        "doc_id long, claim_id string, citation_mode string, section_title string, citation_group_size int, claim_type string, position int, tier_rank int, papers array<string>, size_bin string, frame boolean, priority int",
    )
    taken = sampling.select_claims(pool, KEY)
    assert "MapInArrow" in plan(taken) and "FlatMapGroupsInPandas" not in plan(taken)
    assert sorted((r["doc_id"], r["pick"], r["claim_id"]) for r in taken.collect()) == [(d, i, f"c{i}") for d in range(300) for i in (1, 2)]
    assert sampling.selection_stats(pool, KEY).where("selected = 2 and papers = 2").count() == 300


def test_counts_of_markers_need_no_clauses(spark):
    sentences = scanner.scan(spark.createDataFrame([(1, "A [1]; b [2-3] and 【4†x】.")], "doc_id long, md string"), KEY)
    counted = events.syntax_counts(sentences, KEY)
    assert "by contrast" not in plan(counted) and tuple(counted.first()) == (1, 0, 2, 0, 1)
