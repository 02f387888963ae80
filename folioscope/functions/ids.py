"""Paper identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def normalize_id(c: Column) -> Column:
    """``dddd.ddddd`` from an id, a URL or a file name; eight or nine bare digits get their
    dot; null for anything else."""
    bare = strip(c.cast("string"))
    bare = F.replace(F.replace(bare, F.lit("arXiv:"), F.lit("")), F.lit("arxiv:"), F.lit(""))
    bare = F.when(F.contains(bare, F.lit("/abs/")) | F.contains(bare, F.lit("/pdf/")), F.substring_index(bare, "/", -1)).otherwise(bare)
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)\.pdf$", ""), r"(?i)v\d+$", "")
    dotted = F.regexp_extract(bare, r"(\d{4}\.\d{4,5})", 1)
    digits = F.regexp_replace(bare, r"\D", "")
    return F.when(dotted != "", dotted).when(F.length(digits).isin(8, 9), F.concat(F.substring(digits, 1, 4), F.lit("."), F.substring(digits, 5, 5)))


def id_year(c: Column) -> Column:
    """The year of a normalized id; null for anything else."""
    return F.when(c.rlike(r"^\d{4}\.\d{4,5}$"), F.substring(c, 1, 2).cast("int") + 2000)


def id_month(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}\.\d{4,5}$"), F.substring(c, 3, 2))
