"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. For every line hash a HyperLogLog
sketch of the sites it occurs on is built by aggregation (partial sketches merge
map-side, so a line on every page costs one row per task). Sketches more than
``ERRORS`` standard errors from the threshold decide at once (a wrong decision has a
probability under 1e-8 a line); lines nearer to it get an exact distinct count.
Boilerplate lines are then removed from every document but for one
occurrence, that with the smallest (doc_id, line number), so no content leaves the
corpus altogether and the first document of a group of copies stays whole.

Lines are compared after trimming spaces, by two hashes of 64 and 32 bits. Blank
lines are never boilerplate. DataFrame functions only.

Defined cases
    * null text: no lines, text stays null. Empty text: one blank line, kept.
    * null site: the occurrence counts for no site, but can be removed.
    * null doc_id: sorts before all ids where the first occurrence is chosen.
    * repeated rows (same id and text): treated alike; if they hold the first
      occurrence of a line, each keeps it.
    * very long texts: their lines are gone through once.
    * empty table: an empty result. Extra columns stay as they are, whatever their names,
      but for one named like a result (``_lines``, ``_removed``), which the result replaces.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_names, materialize, quoted, row_key

LG_K, ERRORS = 12, 6


def line_rows(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One narrow row for each line that isn't blank."""
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[site_col].alias("site"))
    rows = own.select("doc_id", "site", row_key("doc_id", "text").alias("row_key"), F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    line = F.trim("line")
    return rows.where(line != "").select("doc_id", "site", "row_key", "no", F.xxhash64(line).alias("k1"), F.hash(line).alias("k2"))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """k1, k2 of the lines on at least ``min_sites`` sites, with their first occurrence."""
    spread = lines.groupBy("k1", "k2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), F.min(F.struct("doc_id", "row_key", "no")).alias("first"))
    margin = max(1, math.ceil(ERRORS * 1.04 / math.sqrt(2**lg_k) * min_sites))
    likely = materialize(spread.where(F.col("sites") >= min_sites - margin), "line-spread")
    sure = likely.where(F.col("sites") > min_sites + margin)
    near = likely.where(F.col("sites") <= min_sites + margin).select("k1", "k2")
    # pairs of a line and a site, one each, and then a count: a hot line is combined map-side in both steps
    exact = lines.join(near, ["k1", "k2"], "left_semi").where("site is not null").select("k1", "k2", "site").distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= min_sites)
    agreed = likely.join(exact, ["k1", "k2"]).select("k1", "k2", "first")
    return sure.select("k1", "k2", "first").unionByName(agreed)


def dedup_lines(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", lg_k: int = LG_K) -> DataFrame:
    """The rows of ``docs``, their text without removed lines, and the columns
    ``_lines`` and ``_removed``: how many lines the text had and how many went."""
    lines = materialize(line_rows(docs, id_col, text_col, site_col), "lines")
    common = materialize(boilerplate(lines, min_sites, lg_k), "line-boilerplate")
    hits = lines.join(common, ["k1", "k2"]).where(~F.struct("doc_id", "row_key", "no").eqNullSafe(F.col("first")))
    key, at, drop, parts = free_names(docs, "key", "at", "drop", "parts")
    drops = materialize(hits.groupBy(F.col("doc_id").alias(at), F.col("row_key").alias(key)).agg(F.collect_set("no").alias(drop)), "line-drops")
    discard(lines, common)
    own = docs.withColumn(key, row_key(docs[quoted(id_col)], docs[quoted(text_col)]))
    # always by a sort-merge join, which Spark splits where it is skewed: drops grow with the corpus
    joined = own.join(drops.hint("merge"), (own[key] == drops[key]) & own[quoted(id_col)].eqNullSafe(drops[at]), "left").drop(drops[key])
    text = F.col(quoted(text_col))
    # both arrays are gone through once: the numbers of the lines that stay, and then the lines
    without = lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(drop)), lambda i: F.get(p, i)), "\n")
    kept = F.when(F.col(drop).isNull(), text).otherwise(F.transform(F.array(F.split(text, "\n", -1)), without)[0])
    n_lines, n_removed = F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long"), F.coalesce(F.size(drop), F.lit(0)).cast("long")
    results = ["_lines", "_removed"]
    stay = [kept.alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns if c.lower() not in results]
    return joined.select(*stay, n_lines.alias("_lines"), n_removed.alias("_removed"))
