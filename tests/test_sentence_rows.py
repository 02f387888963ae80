"""A sentence stays one row from its markers to its merged clauses, and lines are dealt once."""

from itertools import product
from types import SimpleNamespace

from pyspark.sql import functions as F

from folioscope.functions import citations
from folioscope.operators import distribution, events, scanner
from folioscope.plans import parts, queries

KEY = ["doc_id"]
LONG = "the retrieval of many long documents needs an index that fits in memory"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def docs(spark, path, n=20):
    text = f"We say {LONG}\nand so on\n" * 9
    spark.createDataFrame([(i, text, "en", "s", 700) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def one_by_one(found):
    """merge_clauses as a loop."""
    kept = []
    for scope, key, cited in found:
        alike = lambda a, b: a and b and (a == b or (len(min(a, b, key=len)) >= 40 and (a in b or b in a)))
        at = next((k for k in kept if k[0] == scope and alike(k[1], key)), None)
        if at is None:
            kept.append([scope, key, list(cited)])
        else:
            at[2] = list(dict.fromkeys(at[2] + list(cited)))
    return [tuple(map(str, k)) for k in kept]


def test_clauses_merge_as_in_a_loop(spark):
    keys = ["", "a", "b", LONG, LONG[:45], LONG + " b"]
    one = [(s, k) for s, k in product(("clause", "sentence_fallback"), keys)]
    rows = [[(*one[(i * j + j * j) % len(one)], [str((i + j) % 4), str(j % 3)]) for j in range(i % 9)] for i in range(300)]
    schema = "found array<struct<scope:string,key:string,indices:array<string>>>"
    merged = spark.createDataFrame([(r,) for r in rows], schema).select(events.merge_clauses(F.col("found"), "indices").alias("m"))
    got = [[(m["scope"], m["key"], str(list(m["indices"]))) for m in r["m"]] for r in merged.collect()]
    assert got == [one_by_one(r) for r in rows]


def test_lone_citations_join_without_a_fold(spark):
    df = spark.createDataFrame([(["[1]", "It is.", "[2]", "[3]", "x"],)], "s array<string>").select(citations.attach(F.col("s")).alias("s"))
    assert df.first()["s"] == ["It is. [2] [3]", "x"] and "aggregate(" not in plan(df)


def test_claims_don_t_collect_markers_again(spark, tmp_path):
    for q in (parts.claim_contexts, parts.selected_reuse, queries.type_scope_hist):
        # paragraphs and the references of a sample; the markers of a sentence too before
        assert plan(q(spark, docs(spark, tmp_path / q.__name__))).count("collect_list(") == 2


def test_bare_numbers_come_after_the_markers(spark):
    rows = [(1, 1, 0, "S", f"We say {LONG} [2], and more of it is said by these very authors 3.", "gemini_deep_research"), (1, 1, 1, "S", f"It says {LONG} 1.", "gemini_deep_research"), (1, 1, 2, "S", f"So {LONG} 1.", "other")]
    sentences = spark.createDataFrame(rows, "doc_id long, paragraph_id int, sentence_no int, section string, sentence string, method string")
    refs = spark.createDataFrame([(1, str(i), f"p{i}") for i in (1, 2, 3)], "doc_id long, citation_index string, paper_id string")
    found, _ = events.claims(sentences, refs, refs.select("paper_id"), KEY, method=F.col("method"))
    assert sorted((r["sentence_no"], [m["citation_index"] for m in r["citation_group"]]) for r in found.collect()) == [(0, ["2", "3"]), (1, ["1"])]


def test_coverage_is_one_pass_without_events(spark, tmp_path):
    covered = queries.section_coverage(spark, docs(spark, tmp_path))
    assert plan(covered).count("posexplode(split(") == 1 and "row_number" not in plan(covered)
    md = "# A\nWe say so [1].\n\nAnd so [2].\n# B\nNothing is said [x].\n# C\n[3].\n# D\n【4†x】 12.\n# E\nWe cite 【4†x】."
    lines = scanner.explode_lines(spark.createDataFrame([(1, md), (2, "No more.")], "doc_id long, md string"), KEY)
    paras = scanner.paragraphs(scanner.scan_lines(lines, KEY), KEY)
    made = events.events(scanner.sentences(paras, KEY), KEY)
    assert {r["section"] for r in made.select("section").distinct().collect()} == {"A", "E"}
    assert sorted(tuple(r) for r in distribution.section_coverage(paras, KEY).collect()) == [(1, 5, 2, 0.4), (2, 1, 0, 0.0)]


def test_lines_are_dealt_to_a_few_partitions_a_core():
    session = lambda set_, cores: SimpleNamespace(conf={"spark.sql.shuffle.partitions": set_}, sparkContext=SimpleNamespace(defaultParallelism=cores))
    assert [scanner.parts(session(*x)) for x in (("200", 12), ("4", 8))] == [48, 4]
