"""Scalar functions on hand-written corners."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import citations, claims, ids, judged, text
from folioscope.operators import pages, scoring


def values(spark, make, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_ids(spark):
    cases = {"2301.12345": "2301.12345", "arXiv:2301.12345v2": "2301.12345", "https://arxiv.org/abs/2301.1234": "2301.1234", "http://x/pdf/2301.12345v1.pdf": "2301.12345", "230112345": "2301.12345", "23011234": "2301.1234", "1234567": None, "": None, None: None, "junk": None}
    assert values(spark, ids.normalize_id, cases) == list(cases.values())
    assert values(spark, ids.id_year, ["2301.12345", "9912.0001", "x"]) == [2023, 2099, None]


def test_expansion(spark):
    cases = {"1, 3-5; 9": ["1", "3", "4", "5", "9"], "5-1": [], "1-700": [], "1-501": [str(i) for i in range(1, 502)], "007": ["7"], " 2 – 4 ": ["2", "3", "4"], "3,3;3": ["3"], "000": ["0"], "": []}
    assert values(spark, citations.expand, cases) == list(cases.values())


def test_markers(spark):
    s = "A [1]-[3] and [2; 4] but 【03†x】 or [a] [9-2] end [1-700]."
    got = values(spark, lambda c: F.transform(citations.markers(citations.join_split_ranges(c)), lambda m: F.array_join(citations.marker_indices(m["marker"]), "/")), [s])
    assert got == [["1/2/3", "2/4", "source:3", "", ""]]
    parts = values(spark, lambda c: F.transform(citations.markers(c), lambda m: F.concat(m["before"], m["marker"], m["after"])), [s.replace("[1]-[3]", "[1-3]")])
    assert set(parts[0]) == {s.replace("[1]-[3]", "[1-3]")}


def test_sentences_and_attachment(spark):
    assert values(spark, text.split_sentences, ["One. Two? three! Four. [5] x。 【1†a】", "  ", "no end"]) == [["One.", "Two? three!", "Four.", "[5] x。", "【1†a】"], [], ["no end"]]
    got = values(spark, lambda c: citations.attach(F.split(c, "/")), ["[1]./Text a./[2]/(3)./Text b.", "[1]"])
    assert got == [["Text a. [2] (3).", "Text b."], []]
    counts = values(spark, lambda c: F.to_json(citations.attach_counts(F.split(c, "/"))), ["[1]./Text a./[2]/(3)./Text b.", "[1]/[2]"])
    assert counts == ['{"attached":2,"skipped":1}', '{"attached":0,"skipped":2}']


def test_reference_entries(spark):
    cases = {"[1] Doe, A Journal": True, "[12] Doe and Roe 2021": True, "[1] Doe 2021": False, "[1] plain": False, "1 Journal": False, "[1] " + "x" * 200 + ", 2021": False}
    assert values(spark, citations.reference_entry, cases) == list(cases.values())


def test_bare_citations(spark):
    cases = {"As was shown 12.": "12", "See Figure 3.": None, "We use GPT-4.": None, "It is so [3]. 12": None, "In 2021.": None, "x 007": "7", "[12]": None}
    assert values(spark, citations.bare_citation, cases) == list(cases.values())
    assert values(spark, citations.cites_bare_numbers, ["Gemini-Deep_Research", "x", None]) == [True, False, False]


def test_mark_target(spark):
    assert values(spark, lambda c: citations.mark_target(c, F.lit("2")), ["a [2] b [1, 2] c [3]."]) == ["a [CITE_THIS] b [CITE_THIS, CITE_OTHER] c [CITE_OTHER]."]


def test_clauses(spark):
    long = "the first of these is a long enough clause to stand on its own feet"
    clause = lambda c: F.to_json(claims.attached_clause(F.concat(c, F.lit(" [1].")), c, F.lit(".")))
    got = values(spark, clause, [f"Some text; {long}", f"A b, However {long} but also {long}", "short", f"{long}, " * 5 + long])
    assert [g.split('"scope":"')[1][:6] for g in got] == ["clause", "clause", "senten", "clause"]
    assert f'"clause":"{long}"' in got[0] and '"clause":"but also ' in got[1] and '"clause":"short ."' in got[2] and f'"clause":"{long}"' in got[3]
    assert values(spark, claims.mark_clause, ["It is so [3].", ""]) == ["It is so  [CITE_THIS].", "[CITE_THIS]"]
    assert values(spark, claims.evaluable, ["[CITE_THIS] 12", "é"]) == [False, True]
    assert values(spark, claims.clause_key, ["A [1] b-C!"]) == ["a b c"]


def test_cleaning(spark):
    assert values(spark, lambda c: text.clean_sentence(c, 12), ["![i](u) <b>a</b>  [t](u)", "abcdefghij klmnop"]) == ["a t", "abcdefghi..."]
    md = "# A title\n\nAuthors\n\n## A b s t r a c t\n![f](x)\nWe study *things* at length and width here.\n| a | b |\n# Introduction\nnot this"
    assert values(spark, lambda c: text.extract_abstract(c, 300), [md, "no", "Abstract: too short"]) == ["We study things at length and width here.", "", ""]
    assert values(spark, text.extract_title, [md, "# Abstract\n## Real [one](u) ##", ""]) == ["A title", "Real one", ""]


def test_scores(spark):
    strict = lambda t: lambda c: scoring.coerce_strict(c, F.lit(t))
    assert values(spark, strict(True), ["4", " 2 ", "4.6", "n/a", None, "9", "-3"]) == [4, 2, 1, 1, 1, 5, 1]
    assert values(spark, strict(False), ["4.6", "0", None]) == [4, 1, 1]
    assert values(spark, scoring.coerce_lenient, ["4.6", "score 2.5", "3.5", "n/a", None, "9", "-2"]) == [5, 2, 4, 3, 3, 5, 1]


@pytest.mark.parametrize("most", [1, 2, 5, 10, 50])
def test_page_sample(spark, most):
    front, back = int(most * 0.2), int(most * 0.1)
    middle = most - front - back

    def brute(n):
        if n <= most:
            return list(range(n))
        pool = list(range(front, n - back))
        if len(pool) <= middle:
            between = pool
        elif middle == 1:
            between = [pool[round((len(pool) - 1) / 2)]]
        else:
            between = [pool[round(i * (len(pool) - 1) / (middle - 1))] for i in range(middle)]
        return sorted({*range(front), *between, *range(n - back, n)})[:most]

    rows = spark.range(0, 130).select(F.col("id").cast("int").alias("n")).select("n", pages.sample_indices(F.col("n"), most).alias("p")).collect()
    for r in rows:
        assert r["p"] == brute(r["n"]), r["n"]


def test_judged(spark):
    names = judged.CRITERIA["MAR"]
    body = ", ".join(f'"{n}": {{"score": {i + 1}, "rationale": "so {{x}} \\"y\\""}}' for i, n in enumerate(names))
    clean = '{"MAR": {' + body + "}}"
    raws = [clean, f"```json\n{clean}\n```", f"Well: {clean} ok", clean[:-1], '{"MAR": "x"}', "", None]
    df = spark.createDataFrame([(i, "MAR", r) for i, r in enumerate(raws)], "i int, family string, raw_response string")
    rows = {(r["i"], r["criterion"]): r for r in judged.raw_scores(df, ["i"]).collect()}
    for i, rung in enumerate(["whole", "fence", "braces", "loose"]):
        assert [(rows[i, n]["raw"], rows[i, n]["rung"]) for n in names] == [(str(k + 1), rung) for k in range(4)]
    assert rows[5, names[0]]["raw"] is None and rows[6, names[0]]["raw"] is None
    assert values(spark, lambda c: judged.response_text(c), ['{"output_text": "a"}', '{"choices":[{"message":{"content":"b"}}]}', "plain"]) == ["a", "b", "plain"]
