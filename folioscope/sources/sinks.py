"""Outputs: partitioned JSON, JSON lines, upserted tables, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import upsert


def write_json(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Only the partitions that ``df`` holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).json(path)


def write_jsonl(df: DataFrame, path: str, partitions: list[str], text: str = "jsonl") -> None:
    df.select(*partitions, F.regexp_replace(text, r"\n$", "").alias("value")).write.mode("overwrite").partitionBy(*partitions).text(path)


def upsert_csv(new: DataFrame, path: str, work: str, key: list[str]) -> None:
    """Merge ``new`` into the CSV table at ``path``, sorted by key. The result is written to
    ``work`` first, as a table can't be read while it is replaced."""
    spark = new.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    old = spark.read.csv(path, header=True, schema=new.schema) if there else new.limit(0)
    upsert(old, new, key).orderBy(*key).write.mode("overwrite").csv(work, header=True)
    spark.read.csv(work, header=True, schema=new.schema).orderBy(*key).coalesce(1).write.mode("overwrite").csv(path, header=True)


def append_log(rows: DataFrame, path: str) -> None:
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)
