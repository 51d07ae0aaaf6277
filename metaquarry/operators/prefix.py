"""Running values over numbered buckets, numbers within groups, and joins on hot keys, made so that
no task gets all rows of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaquarry.session import cut, small

HOT_ROWS, SALTS = 1_000_000, 64
RUN = 2048  # buckets whose values are taken together


def before(buckets: DataFrame, run: int = RUN, **kinds: str) -> DataFrame:
    """(bucket, one column per kind): the "sum" or "max" of the column over all buckets before each,
    null for the first. Runs of buckets are handled side by side, and then the runs, so only one
    row a run passes through one task."""
    of = {"sum": F.sum, "max": F.max}
    runs = buckets.withColumn("run", F.floor(F.col("bucket") / run))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = runs.groupBy("run").agg(*[of[k](c).alias(c) for c, k in kinds.items()])
    tops = tops.select("run", *[of[k](c).over(earlier(Window.orderBy("run"))).alias(f"base_{c}") for c, k in kinds.items()])
    inner = runs.select("bucket", "run", *[of[k](c).over(earlier(Window.partitionBy("run").orderBy("bucket"))).alias(c) for c, k in kinds.items()])
    # Of a null and a value both give the value.
    both = lambda c, k: F.greatest(f"base_{c}", c) if k == "max" else F.when(F.col(f"base_{c}").isNull(), F.col(c)).otherwise(F.col(f"base_{c}") + F.coalesce(c, F.lit(0)))
    return inner.join(tops, "run").select("bucket", *[both(c, k).alias(c) for c, k in kinds.items()])


def numbered(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds number, 1, 2, ... within each group in the given order, which must be total. Rows are
    sorted into ranges, and the ranges' sizes are summed up, so no group has to fit into a task."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumn("_i", F.monotonically_increasing_id()))
    part, place = F.shiftright("_i", 33), F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_s"))  # one row per range
    at = ranged.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn("_g", F.col("_s") + place)
    first = small(cut(at.groupBy(group).agg(F.min("_g").alias("_f"))))
    return at.join(first, group).withColumn("number", F.col("_g") - F.col("_f") + 1).drop("_i", "_p", "_s", "_g", "_f")


def salted_join(walk: DataFrame, other: DataFrame, key: str, by: str, rows: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """walk joined with other on key. walk has `rows` rows; a key that more than hot_rows of them
    have is salted by the column `by` of walk. There are so few such keys that a broadcast holds
    them, and only their rows of other are repeated."""
    if rows <= hot_rows:
        return walk.join(other, key)
    hot = small(cut(walk.groupBy(key).count().where(F.col("count") > hot_rows).select(key, F.lit(True).alias("hot"))))
    one = walk.join(hot, key, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return one.drop("hot").join(other.join(hot, key, "left").withColumn("salt", F.explode(salts)).drop("hot"), [key, "salt"]).drop("salt")
