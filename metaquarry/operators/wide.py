"""Entity, attribute, value rows into one typed row per entity, by positional stitching.

Every entity gets a global ordinal. Ordinals are cut into ranges; for each range every attribute
is written as one typed column whose positions are the ordinals of the range, and the wide rows
are the columns laid side by side. No join per attribute and no map per entity is made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaquarry.operators.prefix import before
from metaquarry.session import cut, small, spread

RANGE = 4096
MOST_ATTRIBUTES = 10_000
BLANKS = "(?U)^\\s+|\\s+$"

# The words for the two truth values.
TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")

SPARK_TYPES = {"integer": T.DecimalType(38, 0), "decimal": T.DecimalType(38, 2), "boolean": T.BooleanType(), "date": T.DateType(), "text": T.StringType()}
ARROW_TYPES = {"integer": pa.decimal128(38, 0), "decimal": pa.decimal128(38, 2), "boolean": pa.bool_(), "date": pa.date32(), "text": pa.string()}


def name_key(name: Column | str) -> Column:
    """Letters and digits in order, letter case aside."""
    return F.lower(F.regexp_replace(name, "[^\\p{L}\\p{N}]", ""))


def canonical(value: Column, kind: str) -> Column:
    """The value's plain text if it is of the kind, else null."""
    v = F.regexp_replace(value, BLANKS, "")
    digits = "(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)"
    if kind == "integer":
        plain = F.regexp_replace(v, "[+,]", "").try_cast("decimal(38,0)")
        return F.when(v.rlike(f"^[+-]?{digits}$"), plain.cast("string"))
    if kind == "decimal":
        plain = F.regexp_replace(v, "[+,]", "").try_cast("decimal(38,2)")
        return F.when(v.rlike(f"^[+-]?(?:{digits}(?:\\.[0-9]*)?|\\.[0-9]+)$"), plain.cast("string"))
    if kind == "boolean":
        low = F.lower(v)
        return F.when(low.isin(*TRUE_WORDS), "true").when(low.isin(*FALSE_WORDS), "false")
    if kind == "date":
        clock = "(?:[T ]\\s*[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?\\s*(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
        ymd, packed, dmy = f"^([0-9]{{4}})([-/])([0-9]{{1,2}})\\2([0-9]{{1,2}}){clock}", f"^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}}){clock}", f"^([0-9]{{1,2}})\\.([0-9]{{1,2}})\\.([0-9]{{4}}){clock}"
        day = lambda p, y, m, d: F.concat_ws("-", F.regexp_extract(v, p, y), F.lpad(F.regexp_extract(v, p, m), 2, "0"), F.lpad(F.regexp_extract(v, p, d), 2, "0")).try_cast("date")
        return F.when(v.rlike(ymd), day(ymd, 1, 3, 4)).when(v.rlike(packed), day(packed, 1, 2, 3)).when(v.rlike(dmy), day(dmy, 3, 2, 1)).cast("string")
    return F.when(v != "", v)


def _typed(texts: pa.Array, kind: str) -> pa.Array:
    if kind == "boolean":
        return pc.equal(texts, "true")
    return texts.cast(pa.string()).cast(ARROW_TYPES[kind])


def _stitcher(entity: str, kinds: list[str], names: list[str], size: int):
    """Rows (ordinal, entity, attr, canon) sorted by ordinal into wide rows, range by range."""
    schema = pa.schema([("ordinal", pa.int64()), (entity, pa.string())] + [(n, ARROW_TYPES[k]) for n, k in zip(names, kinds, strict=True)])

    def assemble(t: pa.Table) -> pa.RecordBatch:
        ordinals = t["ordinal"].to_numpy()
        first, last = int(ordinals[0]), int(ordinals[-1])
        n = last - first + 1
        place, attr = ordinals - first, t["attr"].to_numpy()
        head = np.zeros(n, dtype=np.int64)
        head[place[::-1]] = np.arange(len(place))[::-1]
        columns = [pa.array(np.arange(first, last + 1)), t[entity].combine_chunks().take(pa.array(head))]
        canon = t["canon"].combine_chunks()
        for a, kind in enumerate(kinds):
            rows = np.flatnonzero(attr == a)
            at = np.full(n, -1, dtype=np.int64)
            at[place[rows]] = np.arange(len(rows))
            typed = _typed(canon.take(pa.array(rows)), kind)
            columns.append(typed.take(pa.array(at, mask=at < 0)))
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            at, block = 0, batch.column("block").to_numpy()
            while at < batch.num_rows:
                if held and held[-1].column("block")[0].as_py() != block[at]:
                    yield assemble(pa.Table.from_batches(held))
                    held = []
                end = int(np.searchsorted(block, block[at], side="right")) if block[at] <= block[-1] else batch.num_rows
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield assemble(pa.Table.from_batches(held))

    return stitch


def attribute_types(types: DataFrame) -> list[tuple[str, str]]:
    """The declared attributes, sorted. They become columns, so their number is bounded."""
    rows = types.where(F.col("property_name").isNotNull()).groupBy("property_name").agg(F.min(F.lower("value_type")).alias("k")).orderBy("property_name").limit(MOST_ATTRIBUTES + 1).collect()
    if len(rows) > MOST_ATTRIBUTES:
        raise ValueError(f"more than {MOST_ATTRIBUTES} attributes cannot become columns")
    return [(r["property_name"], r["k"] if r["k"] in SPARK_TYPES else "text") for r in rows]


def wide_table(rows: DataFrame, types: DataFrame, *, entity: str = "object_id", size: int = RANGE) -> DataFrame:
    """One row (ordinal, entity, one typed column per attribute of `types`) per entity of `rows`.

    rows: entity, property_name, property_value, loaded_at; other columns are ignored. Integers
    and decimals are decimal(38,0) and decimal(38,2), which hold every value without loss; longer
    numbers are null. The counting row with the latest loaded_at gives a cell, at a tie the
    greatest value. Rows without an entity, and columns named like the helper columns, do not
    matter; an entity whose rows all fail to count keeps its row, all null. Empty input gives no
    row. Repeated rows of one cell are combined before the shuffle, so a hot entity or attribute
    sends at most one row per cell and task."""
    spark = rows.sparkSession
    attributes = attribute_types(types)
    kinds = [k for _, k in attributes]
    r = rows.select(F.col(entity).cast("string").alias("_e"), name_key("property_name").alias("_n"), F.col("property_value").alias("_v"), F.col("loaded_at").alias("_t")).where(F.col("_e").isNotNull())
    by_key: dict[str, int] = {}
    for i, (name, _) in enumerate(attributes):
        by_key.setdefault("".join(c for c in name if c.isalnum()).lower(), i)
    index, canon = F.lit(-1), F.lit(None).cast("string")
    if by_key:
        pairs = F.create_map(*[F.lit(x) for kv in by_key.items() for x in kv])
        index = F.coalesce(pairs[F.col("_n")], F.lit(-1))
        canon = F.lit(None).cast("string")
        for kind in sorted(set(kinds)):
            canon = F.when(F.col("_a").isin(*[i for i, k in enumerate(kinds) if k == kind]), canonical(F.col("_v"), kind)).otherwise(canon)
    cells = (
        r.withColumn("_a", index)
        .withColumn("canon", canon)
        .select("_e", F.when(F.col("canon").isNull(), -1).otherwise(F.col("_a")).alias("attr"), "canon", "_t")
        .groupBy("_e", "attr")
        .agg(F.max_by("canon", F.struct("_t", "canon")).alias("canon"))
    )
    cells = cut(cells)
    buckets = spread(spark, cells.count())
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64("_e"), F.lit(buckets)).cast("int"))
    sizes = cells.groupBy("bucket").agg(F.count_distinct("_e").alias("n"))
    starts = cut(before(sizes, n="sum").select("bucket", F.coalesce("n", F.lit(0)).alias("start")))
    placed = (
        cells.join(small(starts), "bucket")
        .withColumn("local", F.dense_rank().over(Window.partitionBy("bucket").orderBy("_e")).cast("long") - 1)
        .withColumn("ordinal", F.col("start") + F.col("local"))
        .withColumn("block", F.col("bucket").cast("long") * (1 << 32) + F.floor(F.col("local") / size))
        .select("block", "ordinal", "_e", "attr", "canon")
    )
    names = [f"c{i}" for i in range(len(attributes))]
    schema = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("_e", T.StringType())] + [T.StructField(n, SPARK_TYPES[k]) for n, k in zip(names, kinds, strict=True)])
    wide = placed.mapInArrow(_stitcher("_e", kinds, names, size), schema)
    return wide.select("ordinal", F.col("_e").alias(entity), *[F.col(n).alias(a) for n, (a, _) in zip(names, attributes, strict=True)])


def wide_cells(wide: DataFrame, attributes: list[tuple[str, str]], *, entity: str = "object_id") -> DataFrame:
    """The non-empty cells (entity, property_name, value_text) of a wide table."""
    cells = F.array(*[F.struct(F.lit(a).alias("property_name"), F.col(f"`{a}`").cast("string").alias("value_text")) for a, _ in attributes])
    return wide.select(entity, F.inline(cells)).where(F.col("value_text").isNotNull())
