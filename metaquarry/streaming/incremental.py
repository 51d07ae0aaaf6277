"""Incremental scans: files that arrive or change between scans, as a stream or a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from metaquarry.functions import extension
from metaquarry.operators.objects import dispatch
from metaquarry.sources.files import is_wanted


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified_at, hash_value) of the files with a parser as they arrive in a folder,
    by the same rules as a full scan: extensions in any letter case, no generated test suites.
    Spark's listing leaves out names that begin with a dot or an underscore."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    s = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    known = s.where(is_wanted("path") & dispatch(extension("path")).isNotNull())
    return known.select("path", "length", F.col("modificationTime").alias("modified_at"), F.md5("content").alias("hash_value"))


def latest_targets(changes: DataFrame, known: DataFrame) -> DataFrame:
    """(path, hash_value, changed): each path once with its last hash, and whether that is new.

    changes: path, hash_value, modified_at; known: path, hash_value, one row per path."""
    last = changes.groupBy("path").agg(F.max_by("hash_value", F.struct("modified_at", "hash_value")).alias("hash_value"))
    k = known.select("path", F.col("hash_value").alias("old"))
    return last.join(k, "path", "left").select("path", "hash_value", (~F.col("hash_value").eqNullSafe(F.col("old"))).alias("changed"))


def scan_incrementally(spark: SparkSession, root: str, state: str, checkpoint: str, on_change: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs one pass over what is new in the folder and calls on_change with the changed targets.

    Hashes are kept as batches below `state`; a batch that runs again overwrites its own part, so
    a restart neither loses nor repeats a target."""

    def batch(df: DataFrame, number: int) -> None:
        session = df.sparkSession
        schema = "path string, hash_value string, batch long"
        at = session._jvm.org.apache.hadoop.fs.Path(state)
        if at.getFileSystem(session._jsc.hadoopConfiguration()).exists(at):
            kept = session.read.schema(schema).parquet(state).where(F.col("batch") < number)
            known = kept.groupBy("path").agg(F.max_by("hash_value", "batch").alias("hash_value"))
        else:  # before the first batch; a state that is there and cannot be read is an error
            known = session.createDataFrame([], "path string, hash_value string")
        targets = latest_targets(df, known).persist()
        try:
            on_change(targets.where("changed"), number)
            targets.select("path", "hash_value", F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{state}/part={number}")
        finally:
            targets.unpersist()

    return file_stream(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
