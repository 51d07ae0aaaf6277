"""Sessions, tables, shared storage and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000
MOST_TASKS = 200_000  # a task then holds more than its share, nothing is left out


def local_session(name: str = "metaquarry", cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. On a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where it is unset a folder is chosen here: a temporary one in local mode, else one in
    the warehouse, which every executor reaches."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if sc.master.startswith("local[") or sc.master == "local":
            folder = "file://" + tempfile.mkdtemp(prefix="metaquarry-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and a lost executor
    costs only the tasks that read it. Columns are stored as Parquet, so later reads prune.

    instead_of is an earlier table of this kind that nothing reads any more; its files go once
    the new ones are complete, so a loop keeps one table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    new = spark.read.schema(df.schema).parquet(path)
    new.cut_path = path
    owned = _OWNED.get()
    if owned is not None:
        owned.append(path)
    old = instead_of.__dict__.get("cut_path") if instead_of is not None else None
    if old:
        _drop(spark, old)
    return new


_OWNED: ContextVar[list[str] | None] = ContextVar("tables of the plan at work", default=None)


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def dropped_after(spark: SparkSession) -> Iterator[None]:
    """Owns the tables that cut() writes within it and drops them at its end: whoever runs a plan
    and stores its result puts both inside, so a long session does not fill the shared folder.
    What is read lazily after it has no tables any more."""
    paths: list[str] = []
    before = _OWNED.set(paths)
    try:
        yield
    finally:
        _OWNED.reset(before)
        for path in paths:
            _drop(spark, path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if df has at most `most` rows, else df as it is, which joins by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def tasks_for(scan: DataFrame) -> int:
    """A number of tasks for costly work on the rows of a scan, without reading them: one for each
    spark.sql.files.maxPartitionBytes of the planner's estimate of their size, two a core at least.
    Rows made in the driver have no such estimate and get the shuffle partitions."""
    spark = scan.sparkSession
    size = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    per = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    wanted = -(-size // per) if size < 1 << 60 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * spark.sparkContext.defaultParallelism, min(wanted, MOST_TASKS))


def spread(spark: SparkSession, rows: int, per: int = 250_000) -> int:
    """A number of buckets that grows with the rows, never below the shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per))
