"""Duplicates hidden by formatting: case, white space, punctuation and order of fields.

Records are brought to a canonical text, hashed to 128 bits, and counted per hash with combining
before the shuffle; lengths and check sums of the texts of a hash are compared, and a hash that
two texts share is told apart by the texts themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaquarry.session import cut, small

BLOCK = 1000  # ids in a block of a set whose pairs are formed

NOT_WORD = "[^\\p{L}\\p{N}]+"
# A label, then = or => or a single colon.
LABELLED = "(?U)^[^\\p{L}\\p{N}=:]*[\\p{L}_][\\p{L}\\p{N}_ ]*[\"'`\\]]*\\s*(?:=>?|:(?!:))"
LABEL = "(?U)^(.*?)\\s*(?:=>|=|:(?!:))"


def plain(text: Column | str) -> Column:
    """Letters and digits in order, letter case aside."""
    return F.lower(F.upper(F.regexp_replace(text, NOT_WORD, "")))


def plain_fields(text: Column) -> Column:
    """label, value pairs of a list of labelled fields, in order of the labels."""
    parts = F.filter(F.split(text, "[;,|\\n]"), lambda x: plain(x) != "")
    pairs = F.transform(parts, lambda x: F.concat_ws("\u0001", plain(F.regexp_extract(x, LABEL, 1)), plain(F.regexp_replace(x, LABEL, ""))))
    return F.concat(F.lit("\u0002"), F.array_join(F.array_sort(pairs), "\u0002"))


def canonical_name(qualified_name: Column | str) -> Column:
    """The canonical text of a dotted name or a list of labelled fields; null stays null."""
    q = F.col(qualified_name) if isinstance(qualified_name, str) else qualified_name
    return F.when(q.rlike(LABELLED), plain_fields(q)).otherwise(plain(q))


def canonical_records(objects: DataFrame) -> DataFrame:
    """(object_id, system_name, object_type, canon, h1, h2): h1 and h2 are 128 bits of the hash."""
    canon = F.concat_ws("\u0003", "system_name", "object_type", plain("name"), canonical_name("qualified_name"))
    complete = "object_id is not null and system_name is not null and object_type is not null and name is not null and qualified_name is not null"
    c = objects.where(complete).select("object_id", "system_name", "object_type", "qualified_name", "name", canon.alias("canon"))
    return c.withColumns({"h1": F.xxhash64(F.lit(1), "canon"), "h2": F.xxhash64(F.lit(2), "canon")})


def collided(records: DataFrame) -> DataFrame:
    """(h1, h2) of hashes that stand for more than one text. Fixed-width checks are combined
    before the shuffle: length and two more hashes."""
    checks = [F.length("canon"), F.crc32(F.encode("canon", "UTF-8")), F.hash("canon")]
    g = records.select("h1", "h2", *[c.alias(f"c{i}") for i, c in enumerate(checks)]).groupBy("h1", "h2")
    g = g.agg(*[f(f"c{i}").alias(f"{n}{i}") for i in range(3) for n, f in (("lo", F.min), ("hi", F.max))])
    return g.where(" or ".join(f"lo{i} <> hi{i}" for i in range(3))).select("h1", "h2")


def counted_ids(objects: DataFrame) -> DataFrame:
    """(h1, h2, text, object_id, n, often): each id of each canonical text with the number of its
    rows, and whether it has more than one text. The hash stands for the text; only where two texts
    share one, the text is part of the key."""
    r = cut(canonical_records(objects).groupBy("object_id", "canon", "h1", "h2").agg(F.count("*").alias("n")))
    twice = cut(collided(r).withColumn("x", F.lit(True)))
    often = cut(r.groupBy("object_id").count().where("count > 1").select("object_id", F.lit(True).alias("y")))
    marked = r.join(small(twice), ["h1", "h2"], "left").join(small(often), "object_id", "left")
    return marked.select("h1", "h2", F.when(F.col("x"), F.col("canon")).otherwise("").alias("text"), "object_id", "n", F.coalesce("y", F.lit(False)).alias("often"))


def counted_sets(ids: DataFrame) -> DataFrame:
    """(h1, h2, text, first_id, n_copies, n_rows) of each set of equal canonical texts."""
    return ids.groupBy("h1", "h2", "text").agg(F.min("object_id").alias("first_id"), F.count("*").alias("n_copies"), F.sum("n").alias("n_rows"))


def collapse(objects: DataFrame) -> DataFrame:
    """(object_id, system_name, object_type, qualified_name, name, n_copies, n_rows): each set of
    records that differ in formatting only as its record with the smallest id, with the number of
    its different ids and of its rows. Records with a null in the id or a compared column are no
    case; empty names are equal to names of punctuation only."""
    sets = counted_sets(counted_ids(objects))
    complete = objects.where("system_name is not null and object_type is not null and name is not null and qualified_name is not null")
    own = complete.groupBy("object_id", "system_name", "object_type").agg(F.min("qualified_name").alias("qualified_name"), F.min("name").alias("name"))
    return sets.select(F.col("first_id").alias("object_id"), "n_copies", "n_rows").join(own, "object_id").select("object_id", "system_name", "object_type", "qualified_name", "name", "n_copies", "n_rows")


def members(objects: DataFrame) -> DataFrame:
    """(h1, h2, text, object_id, often, first_id, n_copies): each id in a set of two or more with the id
    that stands for its set, as collapse counts them. AQE splits the side of the ids in this join
    where one set holds very many."""
    ids = counted_ids(objects)
    return ids.drop("n").join(counted_sets(ids).where("n_copies > 1").drop("n_rows"), ["h1", "h2", "text"])


def duplicate_pairs(objects: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(object_id_a, object_id_b): the pairs of different ids of one set, the smaller first.

    The ids of a set are dealt into blocks of about `block`, and each pair of blocks is a group of
    its own, so no task gets all pairs of a large set. An object whose rows lie in two sets of the
    same ids gives each pair once. Nulls as in collapse; no duplicates give no row."""
    blocks = F.ceil(F.col("n_copies") / block)
    m = members(objects).select("h1", "h2", "text", "object_id", "often", blocks.alias("of"), F.pmod(F.xxhash64("object_id", F.lit(7)), blocks).alias("at"))
    key = ["h1", "h2", "text", "i", "j"]
    a = m.select("h1", "h2", "text", F.col("object_id").alias("a"), F.col("often").alias("often_a"), F.col("at").alias("i"), F.explode(F.sequence("at", F.col("of") - 1)).alias("j"))
    b = m.select("h1", "h2", "text", F.col("object_id").alias("b"), F.col("often").alias("often_b"), F.explode(F.sequence(F.lit(0).cast("long"), "at")).alias("i"), F.col("at").alias("j"))
    pair = [F.least("a", "b").alias("object_id_a"), F.greatest("a", "b").alias("object_id_b")]
    once = a.join(b, key).where("(i < j or a < b) and not (often_a and often_b)").select(pair)
    # Only two objects that both have several texts can be a pair in more than one set.
    again = a.where("often_a").join(b.where("often_b"), key).where("a <> b").select(pair).distinct()
    return once.unionByName(again)
