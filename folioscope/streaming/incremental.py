"""The same transforms over a stream of manuscripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.distribution import distribution
from ..operators.events import events
from ..operators.scanner import explode_lines, paragraphs, scan_lines, sentences
from ..operators.scoring import upsert


def merge_into(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that keeps one row a key: each batch is merged into a new version of the
    table, named by the batch, so a repeated batch writes the same version again."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        versions = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root)) if fs.exists(root) else []
        before = [v for v in versions if v < number]
        old = spark.read.parquet(f"{path}/version={before[-1]}") if before else batch.limit(0)
        upsert(old, batch, key).write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a merged table."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    newest = max(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root))
    return spark.read.parquet(f"{path}/version={newest}")


def stream_distributions(manuscripts: DataFrame, path: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Statistics of each manuscript as it arrives; a newer text replaces the older one's."""
    merge = merge_into(path, key)

    def each(batch: DataFrame, number: int) -> None:
        paras = paragraphs(scan_lines(explode_lines(batch.dropDuplicates(key), key), key), key)
        merge(distribution(paras, events(sentences(paras, key), key), key), number)

    return manuscripts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events_stream: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by kind and tumbling window, with a watermark for late rows."""
    return events_stream.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")
