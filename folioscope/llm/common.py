"""What the operators share: the shared folder, materialised tables, words."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    It is what the cluster names in ``spark.checkpoint.dir``; only where that is
    unset and the master is local (tests, a single machine) a temporary folder takes
    its place. On a cluster each executor would write to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of at most 1,000 rows and 16 MB, which bounds what a
    worker and its JVM hold; a longer text is a batch of its own."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each, memory that nothing holds goes back to the system. Workers are
    used again by later stages, and what they keep is what those stages lack."""
    for b in batches:
        yield b
        del b
        pa.default_memory_pool().release_unused()
        if _trim:
            _trim(0)


def files_for(spark: SparkSession, rows: int, per_file: int = 200_000) -> int:
    """How many files a table of at most so many rows is worth, one a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // per_file))


def materialize(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there,
    so a lost executor costs a read and not a recomputation. ``files``: at most so many,
    for tables that are small beside the shuffle they come from."""
    df = df.coalesce(files) if files else df
    path = new_path(df.sparkSession, name)
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")  # its shuffle files go with the write: nothing reads them again
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_executors(spark: SparkSession) -> None:
    """Let every executor collect its garbage, so that its heap shrinks to what is still in
    use. A heap that a step has grown is otherwise kept, and Python workers, which live
    beside it in the same container, lack that memory in the next step. One short task
    for each core; where tasks land is up to Spark, and nothing depends on it."""
    sc = spark.sparkContext
    cores = max(1, sc.defaultParallelism)
    if sc.master.startswith("local["):
        return  # one process, whose heap the driver shares
    spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc') as done").write.format("noop").mode("overwrite").save()


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> str:
    """A column's name for ``df[...]``, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names that no column of ``df`` has, in any case, made from the wanted ones."""
    taken = {c.lower() for c in df.columns}
    made = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        made.append(name)
    return made


def carried(df: DataFrame, results: list[str]) -> list[Column]:
    """The columns of ``df`` that stay beside an operator's results: all but those that have
    the name of a result, in any case."""
    own = {r.lower() for r in results}
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in own]


def row_key(doc_id, text) -> Column:
    """What tells a row from others of the same id: a 64-bit hash of id and text."""
    return F.xxhash64(doc_id, text)


#: Bits of a bitmap, as a power of two: 2 MB.
BITS = 24


def bitmap(df: DataFrame, column: str):
    """A broadcast bitmap of fixed size: a bit for each value's lowest bits. Values that
    aren't in ``df`` may share a bit with one that is; those that are always have theirs."""
    low = df.select(F.col(column).bitwiseAND(F.lit((1 << BITS) - 1)).alias("low"))
    words = low.selectExpr("low div 64 as w", "shiftleft(cast(1 as bigint), cast(low % 64 as int)) as b").groupBy("w").agg(F.bit_or("b").alias("b"))
    got = words.toArrow()
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[got["w"].to_numpy()] = got["b"].to_numpy()
    return df.sparkSession.sparkContext.broadcast(bits)


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values & ((1 << BITS) - 1)
    return (bits[low >> 6] >> (low & 63)) & 1 == 1
