"""Breadth-first lineage over the edges of the catalogue, one join per level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaquarry.operators.prefix import HOT_ROWS, numbered, salted_join
from metaquarry.session import cut

UPSTREAM, DOWNSTREAM = "UPSTREAM", "DOWNSTREAM"
EDGE = ["relation_id", "from_object_id", "to_object_id", "relation_type", "source_type", "created_at"]


MOST_IN_WINDOW = 1_000_000


def traverse(relations: DataFrame, start: str | DataFrame, direction: str = DOWNSTREAM, max_depth: int | None = None) -> DataFrame:
    """The edges reached from the start in breadth-first order: start_id, position, depth and the
    edge. Edges to objects that were visited before are given too; each object is expanded once.
    Edges of one object come in order of created_at and relation_id.

    start is one object id or a DataFrame of object_id, each traversed by itself. max_depth None
    means all levels, 0 none; a negative one is an error. Cycles and self links end by
    themselves. The frontier is a table, never collected; lineage is cut at every level."""
    if max_depth is not None and max_depth < 0:
        raise ValueError("max_depth must be non-negative or None")
    if direction not in (UPSTREAM, DOWNSTREAM):
        raise ValueError(f"unknown direction {direction!r}")
    spark = relations.sparkSession
    here, there = ("to_object_id", "from_object_id") if direction == UPSTREAM else ("from_object_id", "to_object_id")
    ids = spark.createDataFrame([(start,)], "object_id string") if isinstance(start, str) else start.select("object_id").where("object_id is not null").distinct()
    edges = relations.select(*EDGE).where(F.col(here).isNotNull() & F.col(there).isNotNull()).dropDuplicates(["relation_id"])
    frontier = ids.select(F.col("object_id").alias("start_id"), "object_id", F.lit(1).cast("long").alias("rank"))
    visited = frontier.select("start_id", "object_id")
    levels, depth, base = [], 0, None
    while max_depth is None or depth < max_depth:
        reached = frontier.join(edges.withColumn("object_id", F.col(here)), "object_id")
        if base is not None:
            reached = reached.join(base, "start_id")
        reached = cut(reached)
        n = reached.count()
        if not n:
            break
        # Small levels are numbered by a window, large ones by a sort over all tasks.
        by = ("rank", "created_at", "relation_id")
        ordered = numbered(reached, "start_id", *by) if n > MOST_IN_WINDOW else reached.withColumn("number", F.row_number().over(Window.partitionBy("start_id").orderBy(*by)))
        before = F.coalesce("base", F.lit(0).cast("long")) if base is not None else F.lit(0).cast("long")
        level = cut(ordered.select("start_id", (F.col("number") + before).cast("long").alias("position"), F.lit(depth + 1).alias("depth"), *EDGE), instead_of=reached)
        levels.append(level)
        # The next frontier: objects not seen before, ranked by the first edge that reaches them.
        new = level.groupBy("start_id", F.col(there).alias("object_id")).agg(F.min("position").alias("rank"))
        frontier = cut(new.join(visited, ["start_id", "object_id"], "left_anti"))
        # What was visited is the union of the frontiers; none is written again.
        visited = visited.unionByName(frontier.select("start_id", "object_id"))
        base = level.groupBy("start_id").agg(F.max("position").alias("base"))
        depth += 1
    if not levels:
        return frontier.join(edges.withColumn("object_id", F.col(here)), "object_id").where("false").select("start_id", F.col("rank").alias("position"), F.lit(0).alias("depth"), *EDGE)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def reachable(relations: DataFrame, start: str | DataFrame, direction: str = DOWNSTREAM, max_depth: int | None = None) -> DataFrame:
    """(start_id, object_id, depth): the objects reached, with the level that reaches them first."""
    there = "from_object_id" if direction == UPSTREAM else "to_object_id"
    t = traverse(relations, start, direction, max_depth)
    return t.where(F.col(there) != F.col("start_id")).groupBy("start_id", F.col(there).alias("object_id")).agg(F.min("depth").alias("depth"))


def within_two(relations: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(s, v): the objects v that one or two edges lead to from each s, s itself excepted. Ways
    through an object of very many incoming edges are dealt out over tasks; rows with a null end
    do not count."""
    r = cut(relations.select(F.col("from_object_id").alias("s"), F.col("to_object_id").alias("v")).where("s is not null and v is not null and s <> v").distinct())
    two = salted_join(r.select("s", F.col("v").alias("m")), r.select(F.col("s").alias("m"), "v"), "m", "s", r.count(), hot_rows)
    return r.unionByName(two.where("s <> v").select("s", "v")).distinct()
