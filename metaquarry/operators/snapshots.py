"""What changed between consecutive full snapshots, by Merkle trees over hash ranges of the keys.

Keys fall into leaves, ranges of their 64-bit hash. A leaf's digest combines the hashes of its
rows, a node's digest those of its children, sixteen each. Two snapshots are compared from the
root down; only rows in leaves whose digests differ are compared one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaquarry.session import cut, small

FAN_BITS = 4
LEAF_ROWS = 16


def snapshot_pairs(jobs: DataFrame, *, system: str = "system_name", job: str = "scan_job_id", started: str = "started_at", status: str = "status") -> DataFrame:
    """One row (system, job, jn, prev_jn, next_jn) per successful job; jn counts all jobs, prev_jn
    and next_jn are the neighbours within the system by start time, null at the ends. Repeated
    rows of a job count once, jobs without system, id or start time are none."""
    ok = (
        jobs.where((F.upper(F.trim(status)) == "SUCCESS") & F.col(job).isNotNull() & F.col(system).isNotNull() & F.col(started).isNotNull())
        .groupBy(F.col(job).alias("_job"))
        .agg(F.min(system).alias("_system"), F.min(started).alias("_at"))
    )
    order = Window.partitionBy("_system").orderBy("_at", "_job")
    # The table of jobs is small; the number only has to be unique and short.
    numbered = ok.withColumn("_jn", F.row_number().over(Window.orderBy("_system", "_at", "_job")))
    return numbered.select("_system", "_job", "_jn", F.lag("_jn").over(order).alias("_prev"), F.lead("_jn").over(order).alias("_next"))


def plain_type(value: Column | str) -> Column:
    """A datatype without letter case and blanks; null stays null."""
    return F.upper(F.regexp_replace(value, "(?U)\\s+", ""))


def _roles(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each row of job j once as the later side of pair j, once as the earlier side of the next."""
    roles = pairs.select("_jn", F.explode(F.array(F.struct(F.when(F.col("_prev").isNotNull(), F.col("_jn")).alias("pair"), F.lit(1).alias("sign")), F.struct(F.col("_next").alias("pair"), F.lit(-1).alias("sign")))).alias("r")).where("r.pair is not null").select("_jn", "r.pair", "r.sign")
    return df.join(small(roles), "_jn")


def tree_depth(rows_of_mean: int) -> int:
    """Levels below the root so that a leaf of a snapshot of mean size has at most LEAF_ROWS rows."""
    depth = 1
    while depth < 12 and rows_of_mean > LEAF_ROWS << (FAN_BITS * depth):
        depth += 1
    return depth


def snapshot_changes(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """(system_name, qualified_name, column_name, scan_job_id, change_kind) of each key added to,
    removed from or changed in a snapshot against the one before.

    rows: scan_job_id, qualified_name, column_name, datatype, loaded_at. In a snapshot the row of
    a key with the latest loaded_at counts, at a tie the greatest datatype. Names are compared as
    written, a null name is a name of its own; datatypes without case and blanks, null being a
    value of its own. Rows of other jobs do not count; a successful job without rows is an empty
    snapshot. Empty tables give no row."""
    pairs = cut(snapshot_pairs(jobs))
    ids = small(pairs.select(F.col("_job").alias("scan_job_id"), "_jn"))
    of = rows.select("scan_job_id", "qualified_name", "column_name", plain_type("datatype").alias("dt"), "loaded_at").join(ids, "scan_job_id")
    # One depth for all trees. Counting all rows of a Parquet table reads its footers only; that
    # some rows belong to no snapshot makes leaves a little smaller.
    depth = tree_depth(rows.count() // max(1, pairs.count()))
    state = (
        of.groupBy("_jn", "qualified_name", "column_name")
        .agg(F.max_by(F.struct("dt"), F.struct("loaded_at", "dt")).alias("s"))
        .select("_jn", "qualified_name", "column_name", F.col("s.dt").alias("dt"), F.shiftrightunsigned(F.xxhash64("qualified_name", "column_name"), 64 - FAN_BITS * depth).alias("leaf"))
    )
    row_hash = lambda seed: F.xxhash64(F.lit(seed), "qualified_name", "column_name", F.col("qualified_name").isNull(), F.col("dt").isNull(), "dt")
    digest = lambda d: d.agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("n").alias("n"))
    leaves = digest(state.select("_jn", F.col("leaf").alias("node"), row_hash(1).alias("x1"), row_hash(2).alias("x2"), F.lit(1).cast("long").alias("n")).groupBy("_jn", "node"))
    levels = [leaves]
    for _ in range(depth):
        levels.append(digest(levels[-1].select("_jn", F.shiftrightunsigned("node", FAN_BITS).alias("node"), "x1", "x2", "n").groupBy("_jn", "node")))
    differing = None
    for level in reversed(levels):
        side = _roles(level, pairs).select("pair", "node", "x1", "x2", (F.col("n") * F.col("sign")).alias("n"))
        if differing is not None:
            side = side.withColumn("up", F.shiftrightunsigned("node", FAN_BITS)).join(differing.withColumnRenamed("node", "up"), ["pair", "up"], "left_semi")
        differing = digest(side.groupBy("pair", "node")).where("x1 <> 0 or x2 <> 0 or n <> 0").select("pair", "node")
    # A leaf that differs in a pair is looked up in both of its snapshots, so each row moves once.
    jobs_of = pairs.where("_prev is not null").select(F.col("_jn").alias("pair"), F.explode(F.array(F.struct(F.col("_jn").alias("_jn"), F.lit(1).alias("sign")), F.struct(F.col("_prev").alias("_jn"), F.lit(-1).alias("sign")))).alias("r")).select("pair", "r.*")
    wanted = differing.withColumnRenamed("node", "leaf").join(small(jobs_of), "pair")
    suspects = state.join(wanted, ["_jn", "leaf"])
    here = lambda sign, c: F.max(F.when(F.col("sign") == sign, c))
    diff = (
        suspects.groupBy("pair", "qualified_name", "column_name")
        .agg(here(1, F.struct("dt")).alias("now"), here(-1, F.struct("dt")).alias("was"))
        .withColumn("change_kind", F.when(F.col("was").isNull(), "ADDED").when(F.col("now").isNull(), "REMOVED").when(~F.col("now.dt").eqNullSafe(F.col("was.dt")), "CHANGED"))
        .where("change_kind is not null")
    )
    names = small(pairs.select(F.col("_jn").alias("pair"), F.col("_system").alias("system_name"), F.col("_job").alias("scan_job_id")))
    return diff.join(names, "pair").select("system_name", "qualified_name", "column_name", "scan_job_id", "change_kind")
