"""The document scanner: lines to paragraphs to sentences.

One pass of windows over (sample, line number). All of them have one partitioning
and one order, so Spark shuffles and sorts the lines once. The sample key is any
list of columns; a manuscript is one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.citations import attach, has_bracket, has_marker, reference_entry
from ..functions.text import bars, clean_sentence, let, split_sentences, strip

#: Line patterns.
TABLE_RULE = r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$"
CAPTION = r"(?iU)^(figure|fig\.|table)\s+\d+\b"
HEADING = r"(?U)^(#{1,6})\s+(.+?)\s*#*\s*$"
CLOSING_PARTS = r"(?i)^(references|bibliography)$"
NO_SECTION = "Untitled"


def explode_lines(docs: DataFrame, key: list[str], text: str = "md") -> DataFrame:
    """One row a line: key, line_no from 0, line."""
    return docs.select(*key, F.posexplode(F.split(F.col(text), r"\R", -1)).alias("line_no", "line"))


def parts(spark: SparkSession) -> int:
    """Partitions of lines: a few for each core. The steps that follow stay in them and cost far more a byte
    than those that adaptive execution sizes its partitions for, so it is not to merge them."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def scan_lines(lines: DataFrame, key: list[str]) -> DataFrame:
    """Each line with its kind, section and paragraph number.

    kind: fence, code, reference_entry, table_html, table, caption, heading,
    references, closed (below the references), blank, text.
    """
    order = Window.partitionBy(*key).orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    s = F.col("stripped")
    lines = lines.repartition(parts(lines.sparkSession), *key)
    rows = lines.withColumn("stripped", strip(F.coalesce(F.col("line"), F.lit(""))))
    rows = rows.withColumns({"fence": s.startswith("```") | s.startswith("~~~"), "entry": reference_entry(s), "opens": s.contains("<") & s.rlike(r"(?i)<table\b"), "shuts": s.contains("<") & s.rlike("(?i)</table>")})
    rows = rows.withColumn("in_code", F.coalesce(F.sum(F.col("fence").cast("int")).over(before) % 2 == 1, F.lit(False)))
    live = ~F.col("fence") & ~F.col("in_code") & ~F.col("entry")
    event = F.when(live & F.col("opens"), F.when(~F.col("shuts"), F.lit(True))).when(live & F.col("shuts"), F.lit(False))
    rows = rows.withColumns({"live": live, "event": event})
    rows = rows.withColumn("in_html", F.coalesce(F.last("event", ignorenulls=True).over(before), F.lit(False)))
    kind = (
        F.when(F.col("fence"), "fence").when(F.col("in_code"), "code").when(F.col("entry"), "reference_entry")
        .when(F.col("opens") | F.col("in_html"), "table_html").when(s.contains("|") & ((bars(s) >= 2) | s.rlike(TABLE_RULE)), "table")
        .when(F.lower(F.substring(s, 1, 1)).isin("f", "t") & s.rlike(CAPTION), "caption").when(s.startswith("#") & s.rlike(HEADING), "heading").when((F.octet_length(s) <= 12) & s.rlike(CLOSING_PARTS), "references")
    )
    title = clean_sentence(F.regexp_extract(s, HEADING, 2), 180)
    rows = rows.withColumn("kind", kind)
    named = F.when(F.col("kind") == "references", F.lit("References")).when(F.col("kind") == "heading", let(title, lambda t: F.when(t.rlike(CLOSING_PARTS), F.lit("References")).when(t != "", t)))
    rows = rows.withColumn("named", named)
    rows = rows.withColumn("section", F.coalesce(F.last("named", ignorenulls=True).over(upto), F.lit(NO_SECTION)))
    rest = F.when(F.col("section") == "References", "closed").when(s == "", "blank").otherwise("text")
    rows = rows.withColumn("kind", F.coalesce("kind", rest))
    ends = F.col("kind").isin("fence", "reference_entry", "table", "heading", "references", "blank") | ((F.col("kind") == "table_html") & F.col("opens"))
    return rows.withColumn("breaks", F.sum(ends.cast("int")).over(upto)).select(*key, "line_no", "line", "stripped", "kind", "section", "breaks")


def skipped_lines(scanned: DataFrame, key: list[str], raw_brackets: bool = False) -> DataFrame:
    """Per sample, the lines outside the body that hold a marker; reference entries count
    all. ``raw_brackets``: numeric brackets as they stand, not sources or split ranges."""
    hit = has_bracket(F.col("stripped")) if raw_brackets else has_marker(F.col("stripped"))
    n = lambda cond: F.count_if(cond).alias
    kind = F.col("kind")
    # the fence that ends a block counts as code, the one that begins it doesn't
    closing = (kind == "fence") & (F.col("fence_no") % 2 == 0)
    numbered = scanned.withColumn("fence_no", F.sum((kind == "fence").cast("int")).over(Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key).agg(
        n(kind.isin("table", "table_html") & hit)("table"), n(((kind == "code") | closing) & hit)("code"),
        n((kind == "caption") & hit)("caption"), n(kind == "reference_entry")("reference_entry"),
    )


def paragraphs(scanned: DataFrame, key: list[str]) -> DataFrame:
    """key, paragraph_id from 1, section of the first line, text."""
    grouped = scanned.where("kind = 'text'").groupBy(*key, "breaks").agg(F.sort_array(F.collect_list(F.struct("line_no", "stripped", "section"))).alias("lines"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy("breaks"))
    return grouped.select(*key, number.alias("paragraph_id"), F.col("lines")[0]["section"].alias("section"), F.array_join("lines.stripped", " ").alias("paragraph"))


def sentences(paras: DataFrame, key: list[str]) -> DataFrame:
    """key, paragraph_id, section, sentence_no in the paragraph, sentence; citation-only
    sentences have joined their predecessor."""
    return paras.select(*key, "paragraph_id", "section", F.posexplode(attach(split_sentences(F.col("paragraph")))).alias("sentence_no", "sentence"))


def numbered(sentence_rows: DataFrame, key: list[str]) -> DataFrame:
    """With sentence_id, from 1, through the whole sample."""
    return sentence_rows.withColumn("sentence_id", F.row_number().over(Window.partitionBy(*key).orderBy("paragraph_id", "sentence_no")))


def scan(docs: DataFrame, key: list[str], text: str = "md") -> DataFrame:
    """Sentences of whole manuscripts."""
    return sentences(paragraphs(scan_lines(explode_lines(docs, key, text), key), key), key)

