"""Page samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The parts of a sample taken from the front and the back.
FRONT, BACK = 0.20, 0.10


def sample_indices(n: Column, most: int = 50) -> Column:
    """The 0-based pages of an ``n``-page document to look at: all of a short one; else its
    head, its tail, and evenly spaced ones between, rounded half to even."""
    front, back = int(most * FRONT), int(most * BACK)
    middle = most - front - back
    pool = n - front - back
    step = F.sequence(F.lit(0), F.lit(max(middle - 1, 0)))
    if middle == 1:
        spread = F.array(F.lit(front) + F.bround((pool - 1) / 2, 0).cast("int"))
    else:
        spread = F.transform(step, lambda i: F.lit(front) + F.bround(i * (pool - 1) / F.lit(max(middle - 1, 1)), 0).cast("int"))
    # a sequence runs backwards from 0 to -1, hence the empty slices
    head = F.slice(F.sequence(F.lit(0), F.lit(max(front, 1))), 1, front)
    tail = F.slice(F.sequence(n - back, n), 1, back)
    between = F.when(pool <= middle, F.sequence(F.lit(front), F.greatest(n - back - 1, F.lit(front)))).otherwise(spread) if middle > 0 else F.slice(step, 1, 0)
    sampled = F.slice(F.array_sort(F.array_distinct(F.concat(head, between, tail))), 1, most)
    return F.when(n <= 0, F.slice(step, 1, 0)).when(n <= most, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(sampled)


def sample_pages(pages: DataFrame, key: list[str], most: int = 50, number: str = "page_no") -> DataFrame:
    """The sampled rows of ``pages``, by rank of their number."""
    n = pages.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("n"))
    wanted = n.select(*key, F.explode(sample_indices(F.col("n"), most)).alias("_at"))
    ranked = pages.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy(number)) - 1)
    return ranked.join(wanted, [*key, "_at"], "left_semi").drop("_at")


def first_pages(pages: DataFrame, key: list[str], n: int = 100, number: str = "page_no") -> DataFrame:
    return pages.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy(number))).where(F.col("_at") <= n).drop("_at")


def natural_number(stem: Column) -> Column:
    """A file name's first number; names without one come last."""
    return F.coalesce(F.nullif(F.regexp_extract(stem, r"(\d+)", 1), F.lit("")).try_cast("long"), F.lit(10**9))


def data_url(content: Column, kind: Column) -> Column:
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))
