"""Scores: coercion, family totals, two-stage means, ranking, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Families and the columns of published tables.
FAMILIES = {
    "BSC": ["BSC_Support", "BSC_Attribution", "BSC_Multi_Reference_Synthesis", "BSC_Balance"],
    "TSQ": ["TSQ_Coverage", "TSQ_Boundary_Control", "TSQ_Organization", "TSQ_Insight"],
    "HDQ": ["HDQ_Alignment", "HDQ_Progression", "HDQ_Specificity", "HDQ_Local_Synthesis"],
    "MAR": ["MAR_References", "MAR_Visuals", "MAR_Layout", "MAR_Completeness"],
}
PUBLISHED_SCHEMA = "Category string, Method string, " + ", ".join(f"{c} double" for f, cs in FAMILIES.items() for c in [*cs, f"{f}_Avg"]) + ", Total_Avg double"
LOWEST, HIGHEST = 1, 5


def clip(c: Column) -> Column:
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), c))


def coerce_strict(raw: Column, is_text: Column) -> Column:
    """A whole number, or a number cut to one; a text must be a whole number. Else 1."""
    whole = F.when(is_text, F.when(raw.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(raw).try_cast("long"))).otherwise(raw.try_cast("double").cast("long"))
    return clip(F.coalesce(whole, F.lit(1))).cast("int")


def coerce_lenient(raw: Column) -> Column:
    """The first number of a text, rounded half to even. Else 3."""
    number = F.nullif(F.regexp_extract(raw, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    return clip(F.coalesce(F.bround(number, 0).cast("long"), F.lit(3))).cast("int")


def coerce(raw: Column, family: Column, is_text: Column) -> Column:
    """By the policy of the family: BSC and MAR are strict, TSQ and HDQ lenient."""
    return F.when(family.isin("BSC", "MAR"), coerce_strict(raw, is_text)).otherwise(coerce_lenient(raw))


def subtotals(scores: DataFrame, key: list[str]) -> DataFrame:
    """Per family the sum of its criteria, of 20."""
    return scores.groupBy(*key, "family").agg(F.sum("score").alias("raw_20"))


def subtotal_mismatch(scores: DataFrame, stated: DataFrame, key: list[str]) -> DataFrame:
    """Families whose stated total isn't the sum."""
    return subtotals(scores, key).join(stated, [*key, "family"]).where(~F.col("raw_20").eqNullSafe(F.col("stated_20")))


def family_means(scores: DataFrame, system: str = "method") -> DataFrame:
    """Two stages: a criterion's mean over topics, then the mean of a family's criteria and
    of all. Long input (system, topic_id, family, criterion, score); with how many topics."""
    criterion = scores.groupBy(system, "family", "criterion").agg(F.avg("score").alias("mean"))
    wide = criterion.groupBy(system).agg(*[F.avg(F.when(F.col("family") == f, F.col("mean"))).alias(f"{f}_Avg") for f in FAMILIES], F.avg("mean").alias("Total_Avg"), F.count_distinct("family").alias("families"))
    topics = scores.groupBy(system).agg(F.count_distinct("topic_id").alias("topics"))
    # a total stands only beside all four families
    return wide.join(topics, system).withColumn("Total_Avg", F.when(F.col("families") == len(FAMILIES), F.col("Total_Avg"))).drop("families")


def published_means(published: DataFrame) -> DataFrame:
    """Family means and total of a published table, computed anew from its 16 criteria."""
    mean = lambda cols: sum(F.col(c) for c in cols) / len(cols)
    every = [c for cs in FAMILIES.values() for c in cs]
    return published.select("Category", "Method", *[mean(cs).alias(f"{f}_Avg") for f, cs in FAMILIES.items()], mean(every).alias("Total_Avg"))


def rank_systems(table: DataFrame, total: str = "Total_Avg") -> DataFrame:
    """The rank of all that aren't references; a published table has tens of systems."""
    place = F.rank().over(Window.partitionBy(F.col("Category") == "Reference").orderBy(F.desc(total)))
    return table.withColumn("rank", F.when(F.col("Category") != "Reference", place))


def matched_topics(scores: DataFrame, system: str = "method") -> DataFrame:
    """Scores of the topics that every system has."""
    systems = scores.agg(F.count_distinct(system).alias("n"))
    shared = scores.groupBy("topic_id").agg(F.count_distinct(system).alias("n")).join(systems, "n", "left_semi").select("topic_id")
    return scores.join(shared, "topic_id", "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``old`` without a newer one, and the rows of ``new``; rows with an empty part
    of the key go. Of several new rows of one key one is kept, by the order of all columns."""
    whole = [(F.col(k).isNotNull()) & (F.trim(F.col(k).cast("string")) != "") for k in key]
    rule = whole[0]
    for w in whole[1:]:
        rule = rule & w
    fresh = new.where(rule).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in new.columns]))).where("_n = 1").drop("_n")
    return old.where(rule).join(fresh, key, "left_anti").select(*new.columns).unionByName(fresh)


def with_topics(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """Rows with their topic's title, ``Topic <id>`` where it is unknown."""
    return rows.join(topics, "topic_id", "left").withColumn("topic", F.coalesce("topic", F.concat(F.lit("Topic "), F.col("topic_id"))))


def samples(methods: DataFrame, topics: DataFrame, present: DataFrame) -> DataFrame:
    """(method, topic_id) pairs whose inputs are present. Both dimensions are short lists of
    names; the inputs decide, so no product of them is made."""
    return present.select("method", "topic_id").distinct().join(methods, "method", "left_semi").join(topics, "topic_id", "left_semi")


def pending(inputs: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Inputs that have no result yet."""
    return inputs.join(done, key, "left_anti")


def summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("samples"))
