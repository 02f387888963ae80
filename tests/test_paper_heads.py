"""Titles and abstracts of parsed papers: odd inputs, and how often a line is looked at."""

from pyspark.sql import functions as F

from folioscope.functions import text

LONG = "a sentence that is long enough to count as an abstract"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_abstracts_of_odd_papers(spark):
    papers = [
        f"# T\n## 1.2 Abstract\n# {LONG}\n{LONG}\n# Next\nnot this", f"Abstract: {LONG}\n# Next\nnot this", f"**A B S T R A C T**\n\n{LONG}\n  Keywords: x\nnot this",
        f"   ABSTRACT \n{LONG}\nKeywords\nnot this", f"abstract\n{LONG}\n#\n{LONG}", f"abstract\n#\n{LONG}\n## é x", "abstract\nshort", "nothing", "", None,
    ]
    got = [r["a"] for r in spark.createDataFrame(list(enumerate(papers)), "n int, md string").orderBy("n").select(text.extract_abstract(F.col("md"), 400).alias("a")).collect()]
    assert got == [f"# {LONG} {LONG}", LONG, LONG, LONG, f"{LONG} # {LONG}", f"# {LONG}", "", "", "", ""]


def test_white_space_is_that_of_unicode(spark):
    texts = ["", "  ", " a", "a \n", "　b \r\n", "\t  x y  z  w \n q ", None, "a  b", " \t ", "\x1ca\x1c", "﻿x", "a\x85"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    c = F.col("c")
    assert df.where(~text.strip(c).eqNullSafe(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")) | ~text.collapse(c).eqNullSafe(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))).count() == 0


def test_a_line_is_made_bare_once(spark):
    df = spark.createDataFrame([("x",)], "md string").select(text.extract_abstract(F.col("md"), 200).alias("a"))
    assert plan(df).count(r"^[ *:_\-\t]+|[ *:_\-\t]+$") <= 4  # for markers and for stops; 102 before
