"""Inputs: manuscripts, reference maps, metadata, page images, published results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import normalize_id
from ..operators.pages import natural_number
from ..operators.scoring import PUBLISHED_SCHEMA
from . import layout


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every file; malformed bytes become replacement characters."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def part_of(path: Column, name: str) -> Column:
    """The value of ``name=...`` in a partitioned path."""
    return F.nullif(F.regexp_extract(path, rf"/{name}=([^/]+)/", 1), F.lit(""))


def manuscripts(spark: SparkSession, path: str) -> DataFrame:
    """method, topic_id, md from files below ``method=.../topic_id=.../``."""
    files = whole_texts(spark, path)
    return files.select(part_of(F.col("path"), "method").alias("method"), part_of(F.col("path"), "topic_id").alias("topic_id"), F.col("text").alias("md"))


def ref_map(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, citation_index, paper_id from JSON objects; unusable ids go."""
    entries = F.explode(F.from_json(F.col(text), "map<string,string>")).alias("index", "raw")
    rows = texts.select(*key, entries)
    named = rows.select(*key, F.regexp_replace("index", r"(?U)^\s+|\s+$", "").alias("citation_index"), normalize_id(F.col("raw")).alias("paper_id"))
    return named.where((F.col("citation_index") != "") & F.col("paper_id").isNotNull())


def metadata_tier(paper: Column, path: Column) -> Column:
    """How well a file's path fits a paper's metadata, 1 the best; null if it doesn't."""
    name = F.element_at(F.split(path, "/"), -1)
    month = F.concat(F.lit("20"), F.substring(paper, 1, 2), F.lit("_new/20"), F.substring(paper, 1, 2), F.lit("-"), F.substring(paper, 3, 2), F.lit("/"))
    monthly = F.contains(path, month) & F.endswith(name, F.lit("_processed.json"))
    suffix = F.endswith(name, F.concat(F.lit("_"), paper, F.lit(".json")))
    nested = F.size(F.split(path, "/")) > 1
    return (
        F.when(~nested & (name == F.concat(paper, F.lit(".json"))), 1).when(~nested & (name == F.concat(paper, F.lit("_processed.json"))), 2)
        .when(suffix & ~nested, 3).when(suffix & (F.size(F.split(path, "/")) == 2), 4)
        .when(monthly & F.contains(name, paper), 5).when(monthly & F.contains(name, F.replace(paper, F.lit("."), F.lit(""))), 6)
    )


def paper_of(path: Column) -> Column:
    """The paper a metadata file's name speaks of."""
    name = F.element_at(F.split(path, "/"), -1)
    dotted = F.regexp_extract(name, r"(\d{4}\.\d{4,5})(?:_processed)?\.json$", 1)
    compact = F.regexp_extract(name, r"(?:^|\D)(\d{4})(\d{4,5})\D*_processed\.json$", 1)
    return F.coalesce(F.nullif(dotted, F.lit("")), F.when(compact != "", F.concat(compact, F.lit("."), F.regexp_extract(name, r"(?:^|\D)(\d{4})(\d{4,5})\D*_processed\.json$", 2))))


def best_metadata(papers: DataFrame, files: DataFrame) -> DataFrame:
    """paper_id, path of the best file. ``files``: path relative to the root. Files meet
    papers by the id in their name; of one tier the first path wins."""
    named = files.withColumn("paper_id", paper_of(F.col("path"))).where("paper_id is not null")
    met = papers.select("paper_id").distinct().join(named, "paper_id").withColumn("tier", metadata_tier(F.col("paper_id"), F.col("path"))).where("tier is not null")
    return met.groupBy("paper_id").agg(F.min_by("path", F.struct("tier", "path")).alias("path"))


def base_names(paper: Column, metadata_path: Column) -> Column:
    """Ordered distinct names under which a paper's parsed text may lie."""
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split(metadata_path, "/"), -1), r"_processed\.json$", ""), r"\.json$", "")
    suffix = F.element_at(F.split(paper, r"\."), -1)
    return F.array_distinct(F.array_compact(F.array(F.nullif(stem, F.lit("")), F.concat_ws("_", suffix, paper), paper)))


def load_metadata(found: DataFrame, texts: DataFrame) -> DataFrame:
    """paper_id, path, doc: VARIANT, null for malformed JSON."""
    return found.join(texts, "path", "left").select("paper_id", "path", F.try_parse_json("text").alias("doc"))


def month_folder(paper: Column) -> Column:
    """``20YY_new/20YY-MM``, where papers of a month lie."""
    year = F.concat(F.lit("20"), F.substring(paper, 1, 2))
    return F.concat(year, F.lit("_new/"), year, F.lit("-"), F.substring(paper, 3, 2))


def best_parsed(papers: DataFrame, files: DataFrame) -> DataFrame:
    """paper_id, path of the parsed text. ``papers``: paper_id, names (``base_names``) and
    file_path, where the metadata say it lies (null or empty: nowhere); ``files``: path.

    A Markdown file that the metadata name comes first, then the first one in a folder they name.
    Then, in the paper's month, ``<name>/auto/<name>.md`` and ``<name>/<name>/auto/<name>.md``
    for each name in order; then the folders with the paper's id in their name, in order,
    in each first the same two places, then any ``*/auto/*.md`` and any ``auto/*.md``.
    Files meet papers by equal paths, by (month, folder) and by (month, id in the folder).
    """
    md = files.where(F.lower("path").endswith(".md")).select("path", F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder")).distinct()
    named = papers.select("paper_id", F.nullif(F.regexp_replace("file_path", "/+$", ""), F.lit("")).alias("at")).where("at is not null")
    given = named.join(md, F.col("at") == F.col("path")).select("paper_id", "path", F.lit(0).alias("a"), F.lit(0).alias("i"), F.lit("").alias("d"), F.lit(0).alias("k"))
    inside = named.join(md, F.col("at") == F.col("folder")).select("paper_id", "path", F.lit(1).alias("a"), F.lit(0).alias("i"), F.lit("").alias("d"), F.lit(0).alias("k"))
    split = F.regexp_extract("path", r"^(?:.*/)?(\d{4}_new/\d{4}-\d{2})/([^/]+)/((?:[^/]+/)?)auto/([^/]+)\.md$", 0)
    parts = md.where(split != "").select("path", *[F.regexp_extract("path", r"^(?:.*/)?(\d{4}_new/\d{4}-\d{2})/([^/]+)/((?:[^/]+/)?)auto/([^/]+)\.md$", g).alias(n) for g, n in ((1, "month"), (2, "d"), (3, "sub"), (4, "name"))])
    same = F.col("name") == F.col("d")
    parts = parts.withColumn("k", F.when(same & (F.col("sub") == ""), 0).when(same & (F.col("sub") == F.concat("d", F.lit("/"))), 1).when(F.col("sub") != "", 2).otherwise(3))
    by_name = papers.select("paper_id", month_folder(F.col("paper_id")).alias("month"), F.posexplode("names").alias("i", "d")).join(parts.where("k < 2"), ["month", "d"]).select("paper_id", "path", F.lit(2).alias("a"), "i", F.lit("").alias("d"), "k")
    ids = parts.withColumn("paper_id", F.explode(F.array_distinct(F.regexp_extract_all("d", F.lit(r"(?=(\d{4}\.\d{4,5}))"), F.lit(1)))))
    by_id = ids.join(papers.select("paper_id", month_folder(F.col("paper_id")).alias("month")), ["paper_id", "month"]).select("paper_id", "path", F.lit(3).alias("a"), F.lit(0).alias("i"), "d", "k")
    return given.unionByName(inside).unionByName(by_name).unionByName(by_id).groupBy("paper_id").agg(F.min_by("path", F.struct("a", "i", "d", "k", "path")).alias("path"))


def choose_markdown(files: DataFrame, key: list[str]) -> DataFrame:
    """Of several Markdown outputs the one named like its input (exact), else the largest."""
    return files.groupBy(*key).agg(F.max_by("path", F.struct("exact", "size", "path")).alias("path"))


#: Kinds of page images.
IMAGES = ["png", "jpg", "jpeg", "webp"]


def page_order(path: Column, natural: bool = True) -> list[Column]:
    """The order of pages: by the first number in the name and then by name, or by name alone."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return [natural_number(stem), name] if natural else [name]


def page_images(spark: SparkSession, path: str, content: bool = False, natural: bool = True) -> DataFrame:
    """path, page_no, length and, if asked for, content. TSQ and HDQ look at images of all
    kinds in natural order, MAR at PNGs in order of their names (``natural=False``)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fit = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(IMAGES if natural else ["png"]))
    folder = F.regexp_extract("path", "^(.*)/", 1)
    ranked = fit.withColumn("page_no", F.row_number().over(Window.partitionBy(folder).orderBy(*page_order(F.col("path"), natural))))
    return ranked.select("path", "page_no", "length", *(["content"] if content else []))


def published(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=PUBLISHED_SCHEMA)


def references_of(files: DataFrame) -> DataFrame:
    """method, topic_id, text of reference files (path, text) named ``<method>/ref_<topic>.json``."""
    named = files.select(layout.method_of(F.col("path")).alias("method"), layout.topic_of(F.col("path")).alias("topic_id"), "text")
    return named.where("method is not null and topic_id is not null")


def manuscripts_of(files: DataFrame) -> DataFrame:
    """method, topic_id, md of files (path, text) named ``<method>/<topic>.md``."""
    topic = F.nullif(F.regexp_extract("path", r"/(\d{3})\.md$", 1), F.lit(""))
    return files.select(layout.method_of(F.col("path")).alias("method"), topic.alias("topic_id"), F.col("text").alias("md")).where("topic_id is not null")


def discovered(files: DataFrame) -> DataFrame:
    """method, topic_id of the reference files (path) among the given ones."""
    found = files.select(layout.method_of(F.col("path")).alias("method"), layout.topic_of(F.col("path")).alias("topic_id"))
    return found.where("method is not null and topic_id is not null").distinct()


def topics(spark: SparkSession, path: str) -> DataFrame:
    """topic_id, topic from a JSON list or lines of objects."""
    return spark.read.json(path, schema="topic_id string, topic string", multiLine=True)


def derived_lines(documents: DataFrame) -> DataFrame:
    """doc_id, source, line_no, line: documents rewritten line by line into manuscripts with
    headings, captions, tables, fences, a reference list and every citation syntax."""
    d, n = F.col("doc_id"), F.col("line_no").cast("long")
    rows = documents.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    a, b, r = ((d + n * 3) % 40 + 1).cast("string"), (d * 7 + n) % 40 + 1, (d * 31 + n * 7) % 6
    cite = lambda *parts: F.concat(F.col("line"), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    new = (
        F.when(n == 60, F.lit("References")).when(n > 60, F.concat(F.lit("["), (n - 60).cast("string"), F.lit("] Doe, J. and Roe, A., Journal of Tests, 2021.")))
        .when(n % 11 == 0, F.concat(F.lit("# Section "), F.expr("line_no div 11").cast("string"))).when(n % 11 == 4, F.lit(""))
        .when((n % 11 == 6) & (d % 5 == 0), F.concat(F.lit("Table "), n.cast("string"), F.lit(": "), F.col("line")))
        .when((n % 11 == 8) & (d % 7 == 0), F.concat(F.lit("| a | ["), (n % 40 + 1).cast("string"), F.lit("] |"))).when((n % 11 == 9) & (d % 13 == 0), F.lit("```"))
        .when(r == 0, cite(" [", a, "].")).when(r == 1, cite(" [", a, ", ", b, "-", b + 2, "].")).when(r == 2, cite(" [", a, "]-[", (d + n * 3) % 40 + 4, "]."))
        .when(r == 3, cite(" 【", a, "†src】.")).otherwise(F.col("line"))
    )
    return rows.select("doc_id", "source", "line_no", new.alias("line"))


def derived_manuscripts(documents: DataFrame) -> DataFrame:
    """doc_id, md."""
    lines = derived_lines(documents).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return lines.select("doc_id", F.array_join("l.line", "\n").alias("md"))


def bulk_events(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Events of the bulk data: an order is a claim, its distinct parts in order are the
    group, its priority is the section."""
    first = lineitem.groupBy("l_orderkey", "l_partkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("at"))
    groups = first.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("at")).alias("g"))
    named = groups.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("section")), "l_orderkey")
    return named.select(F.col("l_orderkey").alias("claim_id"), "section", F.transform("g", lambda x: x["l_partkey"].cast("string")).alias("indices"), F.size("g").alias("group_size"))
