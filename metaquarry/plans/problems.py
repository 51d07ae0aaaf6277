"""Queries of the general data problems: wide tables, snapshots, histories, hierarchies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaquarry.operators import hierarchy as H
from metaquarry.operators import history as V
from metaquarry.operators import snapshots as S
from metaquarry.operators import wide as W
from metaquarry.session import shared_dir, table


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    return W.wide_table(table(spark, d, "emip_property"), table(spark, d, "property_type")).drop("ordinal")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "property_type")
    return W.wide_cells(W.wide_table(table(spark, d, "emip_property"), types), W.attribute_types(types))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return S.snapshot_changes(table(spark, d, "emip_column"), table(spark, d, "scan_job"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    h = V.version_history(table(spark, d, "object_version"))
    return h.select("object_id", "valid_from", F.coalesce("valid_to", F.lit(-1).cast("long")).alias("valid_to"))


def p5_history(spark: SparkSession, d: str) -> DataFrame:
    return V.version_history(table(spark, d, "object_version"))


def p5_loads(spark: SparkSession, d: str) -> DataFrame:
    """The history from satellites that are loaded twice: by what had come up to the middle of the
    time of loading, and by the rest, part of which is late."""
    rows = table(spark, d, "object_version")
    low, high = rows.agg(F.min("loaded_at"), F.max("loaded_at")).first()
    store = V.Satellites(spark, f"{shared_dir(spark)}/satellites-{uuid.uuid4().hex}", V.attributes())
    middle = None if low is None else low + (high - low) / 2
    if middle is not None:
        store.load(rows.where(F.col("loaded_at") <= F.lit(middle)))
        store.load(rows.where(F.col("loaded_at").isNull() | (F.col("loaded_at") > F.lit(middle))))
    return store.history("hash_value").select(F.col("k").alias("object_id"), F.col("d").alias("hash_value"), "valid_from", "valid_to", "is_current")


def p5_locations(spark: SparkSession, d: str) -> DataFrame:
    return V.location_history(table(spark, d, "object_version"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(table(spark, d, "emip_relation")).select("object_id", "root_object_id", "depth")


def p6_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    t = H.hierarchy(table(spark, d, "emip_relation"), with_path=True)
    return t.select("object_id", "parent_id", "root_object_id", "depth", "n_descendants", F.array_join("path", "/").alias("path"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.hierarchy(table(spark, d, "emip_relation")))


_NAME = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_BLANK = "regexp_replace({0}, '^[\\s\\x{{A0}}\\x{{3000}}]+|[\\s\\x{{A0}}\\x{{3000}}]+$', '', 'g')"
_CLOCK = "(?:[T ]\\s*[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?\\s*(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
_DIGITS = "(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)"
_CELLS = f"""
WITH v AS (
  SELECT p.object_id, t.property_name, t.value_type AS k, p.loaded_at, {_BLANK.format("p.property_value")} AS v
  FROM emip_property p JOIN property_type t ON {_NAME.format("p.property_name")} = {_NAME.format("t.property_name")}
), c AS (
  SELECT object_id, property_name, loaded_at, CASE k
    WHEN 'integer' THEN CASE WHEN regexp_matches(v, '^[+-]?{_DIGITS}$') THEN CAST(TRY_CAST(regexp_replace(v, '[+,]', '', 'g') AS DECIMAL(38,0)) AS VARCHAR) END
    WHEN 'decimal' THEN CASE WHEN regexp_matches(v, '^[+-]?(?:{_DIGITS}(?:\\.[0-9]*)?|\\.[0-9]+)$') THEN CAST(TRY_CAST(regexp_replace(v, '[+,]', '', 'g') AS DECIMAL(38,2)) AS VARCHAR) END
    WHEN 'boolean' THEN CASE WHEN lower(v) IN ('true','t','yes','y','on','1') THEN 'true' WHEN lower(v) IN ('false','f','no','n','off','0') THEN 'false' END
    WHEN 'date' THEN CASE
      WHEN regexp_matches(v, '^[0-9]{{4}}(-[0-9]{{1,2}}-|/[0-9]{{1,2}}/)[0-9]{{1,2}}{_CLOCK}') THEN CAST(TRY_CAST(replace(regexp_extract(v, '^[0-9]+[-/][0-9]+[-/][0-9]+'), '/', '-') AS DATE) AS VARCHAR)
      WHEN regexp_matches(v, '^[0-9]{{8}}{_CLOCK}') THEN CAST(TRY_CAST(substr(v, 1, 4) || '-' || substr(v, 5, 2) || '-' || substr(v, 7, 2) AS DATE) AS VARCHAR)
      WHEN regexp_matches(v, '^[0-9]{{1,2}}\\.[0-9]{{1,2}}\\.[0-9]{{4}}{_CLOCK}') THEN CAST(TRY_CAST(regexp_replace(v, '^([0-9]+)\\.([0-9]+)\\.([0-9]+).*$', '\\3-\\2-\\1') AS DATE) AS VARCHAR) END
    ELSE CASE WHEN v <> '' THEN v END END AS value_text
  FROM v
), cells AS (
  SELECT object_id, property_name, value_text FROM c WHERE value_text IS NOT NULL AND object_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY object_id, property_name ORDER BY loaded_at DESC, value_text DESC) = 1
)"""
# The declared attributes and their types, as columns of the wide table.
_WIDE = {
    "decimal(38,0)": ("partition_count", "refresh_minutes", "retention_days", "row_count", "size_bytes"),
    "decimal(38,2)": ("avg_row_length", "null_ratio", "storage_cost"),
    "boolean": ("contains_dynamic_sql", "has_primary_key", "is_encrypted", "is_partitioned"),
    "date": ("deployed_on", "expires_on", "last_analyzed"),
    "varchar": ("charset", "data_steward", "database_name", "delimiter", "dynamic_sql_status", "encoding", "file_format", "language_version", "trigger_events", "trigger_timing", "trigger_update_columns"),
}
_TREE = """
WITH RECURSIVE b AS (
  SELECT from_object_id f, to_object_id t, created_at FROM emip_relation WHERE upper(trim(relation_type)) = 'BELONGS_TO'
), n AS (SELECT f v FROM b UNION SELECT t FROM b),
l AS (SELECT v, (SELECT arg_max(t, (created_at, t)) FROM b WHERE f = v AND t IS NOT NULL) p FROM n WHERE v IS NOT NULL),
r AS (
  SELECT v, p, v AS root, 0 AS depth, v AS path FROM l WHERE p IS NULL
  UNION ALL SELECT l.v, l.p, r.root, r.depth + 1, r.path || '/' || l.v FROM l JOIN r ON l.p = r.v
)"""

ORACLES = {
    "p1_found": _CELLS + " SELECT * FROM cells",
    "p1_wide": _CELLS
    + ", o AS (SELECT DISTINCT object_id FROM emip_property WHERE object_id IS NOT NULL) SELECT o.object_id, "
    + ", ".join(f"CAST(max(value_text) FILTER (property_name = '{n}') AS {k}) AS {n}" for k, names in _WIDE.items() for n in names)
    + " FROM o LEFT JOIN cells ON cells.object_id = o.object_id GROUP BY o.object_id",
    "p2_found": """
WITH j AS (
  SELECT scan_job_id, min(system_name) system_name, min(started_at) started_at FROM scan_job WHERE upper(trim(status)) = 'SUCCESS' GROUP BY scan_job_id
), o AS (SELECT *, lag(scan_job_id) OVER (PARTITION BY system_name ORDER BY started_at, scan_job_id) prev FROM j),
s AS (
  SELECT scan_job_id, qualified_name q, column_name c, upper(regexp_replace(datatype, '\\s+', '', 'g')) dt FROM emip_column
  QUALIFY row_number() OVER (PARTITION BY scan_job_id, qualified_name, column_name ORDER BY loaded_at DESC, dt DESC NULLS LAST) = 1
), a AS (SELECT o.system_name, o.scan_job_id, s.q, s.c, s.dt FROM o JOIN s ON s.scan_job_id = o.scan_job_id WHERE prev IS NOT NULL),
z AS (SELECT o.system_name, o.scan_job_id, s.q, s.c, s.dt FROM o JOIN s ON s.scan_job_id = o.prev)
SELECT coalesce(a.system_name, z.system_name) system_name, coalesce(a.q, z.q) qualified_name, coalesce(a.c, z.c) column_name, coalesce(a.scan_job_id, z.scan_job_id) scan_job_id,
  CASE WHEN z.q IS NULL THEN 'ADDED' WHEN a.q IS NULL THEN 'REMOVED' ELSE 'CHANGED' END change_kind
FROM a FULL JOIN z ON a.scan_job_id = z.scan_job_id AND a.q = z.q AND a.c = z.c
WHERE a.q IS NULL OR z.q IS NULL OR a.dt IS DISTINCT FROM z.dt""",
    "p5_found": """
WITH s AS (
  SELECT object_id, epoch_us(created_at) t, lower(trim(hash_value)) d FROM object_version WHERE trim(hash_value) <> ''
  QUALIFY row_number() OVER (PARTITION BY object_id, created_at ORDER BY loaded_at DESC, d DESC) = 1
), c AS (SELECT *, lag(d) OVER (PARTITION BY object_id ORDER BY t) p FROM s)
SELECT object_id, t AS valid_from, coalesce(lead(t) OVER (PARTITION BY object_id ORDER BY t), -1) AS valid_to FROM c WHERE p IS NULL OR p <> d""",
    "p5_history": """
WITH s AS (
  SELECT object_id, epoch_us(created_at) t, lower(trim(hash_value)) d FROM object_version WHERE trim(hash_value) <> ''
  QUALIFY row_number() OVER (PARTITION BY object_id, created_at ORDER BY loaded_at DESC, d DESC) = 1
), c AS (SELECT *, lag(d) OVER (PARTITION BY object_id ORDER BY t) p FROM s)
SELECT object_id, d AS hash_value, t AS valid_from, lead(t) OVER w AS valid_to, lead(t) OVER w IS NULL AS is_current FROM c WHERE p IS NULL OR p <> d WINDOW w AS (PARTITION BY object_id ORDER BY t)""",
    "p5_locations": """
WITH s AS (
  SELECT object_id, epoch_us(created_at) t, trim(source_location) d FROM object_version WHERE trim(source_location) <> ''
  QUALIFY row_number() OVER (PARTITION BY object_id, created_at ORDER BY loaded_at DESC, d DESC) = 1
), c AS (SELECT *, lag(d) OVER (PARTITION BY object_id ORDER BY t) p FROM s)
SELECT object_id, d AS source_location, t AS valid_from, lead(t) OVER w AS valid_to, lead(t) OVER w IS NULL AS is_current FROM c WHERE p IS NULL OR p <> d WINDOW w AS (PARTITION BY object_id ORDER BY t)""",
    "p6_found": _TREE + " SELECT v AS object_id, coalesce(r.root, '') AS root_object_id, coalesce(r.depth, -1) AS depth FROM l LEFT JOIN r USING (v)",
    "p6_hierarchy": _TREE + """, d AS (SELECT a.v, count(*) - 1 n FROM r a JOIN r x ON x.path = a.path OR starts_with(x.path, a.path || '/') GROUP BY a.v)
SELECT l.v AS object_id, l.p AS parent_id, coalesce(r.root, '') AS root_object_id, coalesce(r.depth, -1) AS depth, d.n AS n_descendants, r.path AS path FROM l LEFT JOIN r ON r.v = l.v LEFT JOIN d ON d.v = l.v""",
    "p6_descendants": _TREE + " SELECT a.v AS ancestor_id, x.v AS descendant_id, x.depth - a.depth AS distance FROM r a JOIN r x ON starts_with(x.path, a.path || '/')",
}

ORACLES["p5_loads"] = ORACLES["p5_history"]
QUERIES = {f.__name__: f for f in (p1_found, p1_wide, p2_found, p5_found, p5_history, p5_loads, p5_locations, p6_found, p6_hierarchy, p6_descendants)}
