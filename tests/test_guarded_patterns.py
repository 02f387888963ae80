"""Costly patterns run only on texts that may match, with the results they have on all."""

import random

from pyspark.sql import functions as F

from folioscope.functions import citations, claims, text
from folioscope.operators import events, scanner

PIECES = [" ", "  ", "\t", "　", "\xa0", "–", "[3]", "[ 4 - 6 ]", "[1]-[3]", "[007; 2,9]", "【12†s a】", "![a](b)", "[x](y)", "<b>", "by contrast", "HOWEVER", "whİle", "alſo", "whereaſ", "therefore,", "fine-tuning", "trade off", "tuning", "dataset", "models", "é", "中文。", "12", ".", ", ", "; ", "Abc", "x"]


def texts(n=600):
    r = random.Random(7)
    return ["", *PIECES, *["".join(r.choice(PIECES) + r.choice(["", " "]) for _ in range(r.randrange(1, 25))) for _ in range(n)]]


def same(spark, new, old):
    df = spark.createDataFrame([(t,) for t in [None, *texts()]], "t string").select("t", new.alias("new"), old.alias("old"))
    assert df.where(~F.col("new").eqNullSafe(F.col("old"))).collect() == []


def test_white_space_and_clean_text(spark):
    t = F.col("t")
    plain = lambda c: F.trim(F.regexp_replace(c, r"(?U)[\s&&[^ ]]\s*| \s+", " "))
    same(spark, text.collapse(t), plain(t))
    same(spark, text.clean_sentence(t, 10**6), plain(text.drop_tags(text.unlink(text.drop_images(t)))))


def test_markers_go_as_by_the_patterns_alone(spark):
    t = F.col("t")
    numeric = F.regexp_replace(F.regexp_replace(t, citations.SPLIT_RANGE, "[$1-$2]"), citations.BRACKET, " ")
    same(spark, citations.drop_markers(t), F.regexp_replace(numeric, citations.SOURCE, " "))
    bare = F.regexp_replace(F.regexp_replace(numeric, citations.SOURCE, " "), r"(?U)\b\d{1,3}\b", " ")
    same(spark, citations.citation_only(t), ~text.begins_with_letter(t) & (F.regexp_replace(bare, r"(?U)[\s.,;:!?()\[\]{}\-–—]+", "") == ""))
    between, found = F.split("t", citations.MARKER, -1), F.regexp_extract_all("t", F.lit(f"({citations.MARKER})"), F.lit(1))
    again = F.zip_with(between, F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    same(spark, F.concat(F.transform(citations.markers(t), lambda m: F.concat(m["before"], m["marker"], m["after"]))), F.transform(found, lambda m: F.array_join(again, "")))


def test_clauses_and_types_as_by_the_patterns_alone(spark):
    t = F.col("t")
    found = F.regexp_extract("t", rf"(?isU)^.*({claims.CONNECTIVE}.*)$", 1)
    held = F.lower("t").rlike("|".join(claims._MAY_CONNECT)) | text.holds(t, *claims._LIKE_ASCII)
    same(spark, (found != "") & ~held, F.when(t.isNotNull(), F.lit(False)))
    for words in (w for _, w in claims.CLAIM_TYPES):
        same(spark, F.lower("t").rlike(rf"(?U)\b({words})\b") & ~text.holds(F.lower("t"), *claims._beginnings(words)), F.when(t.isNotNull(), F.lit(False)))


def test_references_are_dealt_as_lines_are(spark):
    refs = spark.createDataFrame([(1, "1", "p")], "doc_id long, citation_index string, paper_id string")
    plan = events.papers_by_index(refs, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan and f", {scanner.parts(spark)}" in plan
