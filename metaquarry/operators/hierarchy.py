"""Parent-child links into full hierarchies by nested sets.

Subtree sizes are summed upward, each pass doubling the distance covered, so a chain of length n
takes log2(n) passes. Siblings, and the roots as siblings of each other, then get consecutive
preorder ranges by prefix sums of their sizes, and the offsets are added up downward, doubling
again. Root and depth of a node are read off the ranges: of the ranges that begin at or before its
own, those that have not ended hold it. Nodes that the passes upward never end lie on a cycle or
below one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaquarry.operators.prefix import HOT_ROWS, before, salted_join
from metaquarry.session import cut, small, spread

ROWS_A_FILE = 100_000
# Sizes on a cycle have no meaning and would grow without end; no sound one comes near this.
MOST = 1 << 44


def parent_links(relations: DataFrame, kind: str = "BELONGS_TO") -> DataFrame:
    """(v, p): each object at either end of a link once, with its parent or null.

    Types are compared without letter case and outer blanks. A null or missing parent means none.
    If several different parents are given, the one last created counts, then the greatest."""
    r = relations.where(F.upper(F.trim("relation_type")) == kind).select(F.col("from_object_id").alias("f"), F.col("to_object_id").alias("t"), "created_at")
    ends = r.select(F.col("f").alias("v"), F.col("t").alias("p"), "created_at").unionByName(r.select(F.col("t").alias("v"), F.lit(None).cast("string").alias("p"), F.lit(None).cast("timestamp").alias("created_at")))
    real = F.when(F.col("p").isNotNull(), F.struct("created_at", "p"))
    return ends.where("v is not null").groupBy("v").agg(F.max(real).alias("m")).select("v", F.col("m.p").alias("p"))


def stored(df: DataFrame, rows: int) -> DataFrame:
    """df, which has up to `rows` rows, as a table without very small files."""
    return cut(df.coalesce(max(1, -(-rows // ROWS_A_FILE))))


def subtree_sizes(links: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(v, p, size, open): sizes of all subtrees; open marks nodes whose way up never ends.

    A pass holds the nodes whose way has not ended, with the ancestor a that they have come to and
    the size of their subtree down to that distance; nodes leave it at the root. What the nodes of
    a pass give their a is added up once, over all passes."""
    walk = links.where("p is not null").select("v", F.col("p").alias("a"), F.lit(1).cast("long").alias("size"))
    passes, left = [], walk.count()
    while left:
        passes.append(walk)
        gain = walk.groupBy(F.col("a").alias("v")).agg(F.try_sum("size").alias("gain"), F.count("*").alias("n"))
        grown = walk.join(gain, "v", "left").select("v", "a", F.when(F.col("n").isNull(), F.col("size")).otherwise(F.least(F.coalesce(F.col("size") + F.col("gain"), F.lit(MOST)), F.lit(MOST))).alias("size"))
        jump = grown.select(F.col("v").alias("a"), F.col("a").alias("a2"))
        walk = stored(salted_join(grown, jump, "a", "v", left, hot_rows).select("v", F.col("a2").alias("a"), "size"), left)
        now = walk.count()
        if now == left:  # every pass ends the way of some node, unless only cycles are left
            break
        left = now
    none = F.lit(None).cast("string")
    parts = [links.select("v", "p", F.lit(1).cast("long").alias("size"), F.lit(False).alias("open")), walk.select("v", none.alias("p"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("open"))]
    parts += [x.select(F.col("a").alias("v"), none.alias("p"), "size", F.lit(False).alias("open")) for x in passes]
    return reduce(DataFrame.unionByName, parts).groupBy("v").agg(F.max("p").alias("p"), F.try_sum("size").alias("size"), F.bool_or("open").alias("open"))


def sibling_offsets(nodes: DataFrame, buckets: int) -> DataFrame:
    """(v, p, size, w): what the range of v begins after that of its parent, 1 and the sizes of the
    siblings before it in order of (bucket, v); for a root, the sizes of the roots before it. The
    children of one parent are summed bucket by bucket first, so a parent of very many is not one
    task."""
    k = F.when(F.col("p").isNull(), F.lit("root")).otherwise(F.concat(F.lit("of "), "p"))
    b = nodes.select("v", "p", "size", k.alias("k"), F.pmod(F.xxhash64("v"), F.lit(buckets)).alias("b"))
    sums = b.groupBy("k", "b").agg(F.sum("size").alias("s"))
    base = sums.select("k", "b", (F.sum("s").over(Window.partitionBy("k").orderBy("b")) - F.col("s")).alias("base"))
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("k", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = F.col("base") + F.col("inner") + F.when(F.col("p").isNull(), 0).otherwise(1)
    return b.withColumn("inner", inner).join(base, ["k", "b"]).select("v", "p", "size", w.alias("w"))


def preorder(sized: DataFrame, *, with_path: bool = False, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, int]:
    """((v, p, size, lft[, path]), their number) of all nodes that are not open: lft is the place in
    the preorder of the whole forest. Nodes leave the passes once their way has come to a root."""
    nodes = sized.where("not open")
    n = nodes.count()
    path = [F.array("v").alias("path")] if with_path else []
    both = [F.concat("p2", "path").alias("path")] if with_path else []
    first = stored(sibling_offsets(nodes, spread(sized.sparkSession, n)).select("v", "p", "size", F.col("p").alias("a"), F.col("w").alias("lft"), *path), n)
    done, walk = [first.where("a is null")], first.where("a is not null")
    left = walk.count()
    while left:
        jump = reduce(DataFrame.unionByName, [*done, walk]).select(F.col("v").alias("a"), F.col("a").alias("a2"), F.col("lft").alias("l2"), *([F.col("path").alias("p2")] if with_path else []))
        step = stored(salted_join(walk, jump, "a", "v", left, hot_rows).select("v", "p", "size", F.col("a2").alias("a"), (F.col("lft") + F.col("l2")).alias("lft"), *both), left)
        done.append(step.where("a is null"))
        walk = step.where("a is not null")
        left = walk.count()
    return reduce(DataFrame.unionByName, done).drop("a"), n


def from_ranges(placed: DataFrame, n: int) -> DataFrame:
    """placed with root, root_lft and depth of each node, from the ranges alone.

    In the order of their begins and ends, the root of a node is the last one that began, and its
    depth is the number of ranges that began before it less those that ended, and lft is just the
    number that began. Places are cut into buckets; what all buckets before hold is summed first."""
    spark = placed.sparkSession
    per = max(1024, -(-n // spread(spark, n)))
    others = [c for c in placed.columns if c not in ("v", "lft")]
    starts = placed.select("v", "lft", *others, F.lit(1).alias("kind"), F.col("lft").alias("at"))
    ends = placed.select(*[F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in ("v", "lft", *others)], F.lit(0).alias("kind"), (F.col("lft") + F.col("size")).alias("at"))
    events = starts.unionByName(ends).withColumn("bucket", F.floor(F.col("at") / per))
    top, ended = F.when((F.col("kind") == 1) & F.col("p").isNull(), F.struct("lft", "v")), F.when(F.col("kind") == 0, 1).otherwise(0).cast("long")
    carried = small(cut(before(events.groupBy("bucket").agg(F.max(top).alias("top"), F.sum(ended).alias("ended")), top="max", ended="sum")))
    w = Window.partitionBy("bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = events.withColumns({"top_in": F.max(top).over(w), "ended_in": F.sum(ended).over(w)}).where("kind = 1").join(carried, "bucket")
    root = F.coalesce("top_in", "top")
    depth = F.col("lft") - F.col("ended_in") - F.coalesce("ended", F.lit(0))
    return here.select("v", "lft", *others, root["v"].alias("root"), root["lft"].alias("root_lft"), depth.cast("int").alias("depth"))


def hierarchy(relations: DataFrame, *, kind: str = "BELONGS_TO", with_path: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(object_id, parent_id, root_object_id, depth, lft, rgt, n_descendants[, path]) of each object.

    lft and rgt are the nested-set range within the tree of the root: u is below v if both have
    the same root and v.lft < u.lft < v.rgt. path holds the ids from the root to the object.
    Objects on a cycle or below one have root '' and depth -1 and null in the other columns.
    Repeated, late and null rows are handled as in parent_links; no links give no row."""
    links = cut(parent_links(relations, kind))
    sized = stored(subtree_sizes(links, hot_rows=hot_rows), links.count())
    placed, n = preorder(sized, with_path=with_path, hot_rows=hot_rows)
    lft = F.col("lft") - F.col("root_lft")
    found = from_ranges(placed, n).select(
        F.col("v").alias("object_id"),
        F.col("p").alias("parent_id"),
        F.col("root").alias("root_object_id"),
        "depth",
        lft.alias("lft"),
        (lft + F.col("size")).alias("rgt"),
        (F.col("size") - 1).alias("n_descendants"),
        *(["path"] if with_path else []),
    )
    null = lambda t: F.lit(None).cast(t)
    lost = sized.where("open").select(F.col("v").alias("object_id"), F.col("p").alias("parent_id"), F.lit("").alias("root_object_id"), F.lit(-1).alias("depth"), *[null("long").alias(c) for c in ("lft", "rgt", "n_descendants")], *([null("array<string>").alias("path")] if with_path else []))
    return found.unionByName(lost)


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) of all pairs, from the nested-set ranges.

    Each range is cut into dyadic blocks, two per level at most, and each node names the block it
    lies in on every level: the range join becomes an equi join that emits each pair once."""
    t = tree.where("root_object_id <> ''").select("object_id", "root_object_id", "depth", "lft", "rgt")
    levels = max(1, int(t.agg(F.max("rgt")).first()[0] or 1).bit_length())
    low = lambda k: F.floor((F.col("lft") + 1 + (1 << k) - 1) / (1 << k)).cast("long")
    high = lambda k: F.floor(F.col("rgt") / (1 << k)).cast("long")
    odd = lambda c: c % 2 == 1
    pieces = []
    for k in range(levels):
        a, b = low(k), high(k)
        pieces += [F.when((a < b) & odd(a), F.struct(F.lit(k).alias("k"), a.alias("b"))), F.when((a < b) & odd(b), F.struct(F.lit(k).alias("k"), (b - 1).alias("b")))]
    ranges = t.where("rgt > lft + 1").select("root_object_id", F.col("object_id").alias("ancestor_id"), F.col("depth").alias("d0"), F.explode(F.array_compact(F.array(*pieces))).alias("x")).select("root_object_id", "ancestor_id", "d0", "x.k", "x.b")
    places = t.select("root_object_id", F.col("object_id").alias("descendant_id"), F.col("depth").alias("d1"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col("lft") / (1 << k)).cast("long").alias("b")) for k in range(levels)])).alias("x")).select("root_object_id", "descendant_id", "d1", "x.k", "x.b")
    return ranges.join(places, ["root_object_id", "k", "b"]).select("ancestor_id", "descendant_id", (F.col("d1") - F.col("d0")).alias("distance"))
