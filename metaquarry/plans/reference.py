"""Queries of the catalogue's own operators, each with the SQL it is checked against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaquarry.functions import base_name, extension, stem
from metaquarry.operators import catalog as C
from metaquarry.operators import graph as G
from metaquarry.operators import hierarchy as H
from metaquarry.operators import objects as O
from metaquarry.operators import relations as R
from metaquarry.operators import reports as T
from metaquarry.operators import statements as S
from metaquarry.operators.columns import columns_of, distribution_free
from metaquarry.plans import scripts as P
from metaquarry.session import cut, shared_dir, table
from metaquarry.sources import files as D
from metaquarry.streaming.incremental import latest_targets

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def distinct_objects(spark: SparkSession, d: str) -> DataFrame:
    """emip_object with each object once; repeated rows are equal."""
    return table(spark, d, "emip_object").dropDuplicates(["object_id"])


def new_catalog(spark: SparkSession) -> C.Catalog:
    """An empty catalogue in the shared folder."""
    return C.Catalog(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}")


def distinct_relations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "emip_relation").where("from_object_id is not null and to_object_id is not null").dropDuplicates(["relation_id"])


# Sources and decoding


@query("""SELECT DISTINCT file_id, regexp_extract(relative_path, '([^/]*)$', 1) AS name, lower(regexp_extract(relative_path, '[^/](\\.[^./]+)$', 1)) AS extension,
  CASE WHEN regexp_extract(relative_path, '([^/]*)$', 1) LIKE '_%.%' THEN regexp_replace(regexp_extract(relative_path, '([^/]*)$', 1), '\\.[^.]+$', '') ELSE regexp_extract(relative_path, '([^/]*)$', 1) END AS stem
  FROM source_file WHERE NOT lower(relative_path) LIKE '%.testsuite.sql'""")
def discover_files(spark, d):
    f = table(spark, d, "source_file").where(D.is_wanted("relative_path"))
    return f.select("file_id", base_name("relative_path").alias("name"), extension("relative_path").alias("extension"), stem("relative_path").alias("stem")).distinct()


@query("""SELECT coalesce(CASE WHEN lower(relative_path) LIKE '%.sql' THEN 'sql_ddl' END, 'none') AS parser, content IS NULL AS unread, count(DISTINCT file_id) AS n_files FROM source_file GROUP BY ALL""")
def classify_input(spark, d):
    f = table(spark, d, "source_file")
    return f.groupBy(F.coalesce(O.dispatch(extension("relative_path")), F.lit("none")).alias("parser"), F.col("content").isNull().alias("unread")).agg(F.count_distinct("file_id").alias("n_files"))


@query("""WITH x AS (SELECT doc_id, text, text IS NULL OR (doc_id % 3 = 2 AND length(text) = 1) AS bad FROM documents)
SELECT doc_id, CASE WHEN NOT bad THEN md5(text) END AS text_md5, CASE WHEN bad THEN 'failed' ELSE 'ok' END AS status FROM x""")
def decode_bytes(spark, d):
    """UTF-8 without and with a mark, and UTF-16, which is refused for a text of one character."""
    doc = table(spark, d, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-8")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-16"))
    return D.decode(doc.select("doc_id", F.col("doc_id").cast("string").alias("path"), raw.alias("content"))).select("doc_id", F.md5("text").alias("text_md5"), "status")


# Statements


@query("""SELECT p_partkey AS k, (CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 7 = 4 AND p_partkey % 4 IN (1, 2) THEN 1 ELSE 0 END + CASE WHEN p_partkey % 7 = 6 THEN 2 ELSE 1 END + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_statements,
  (CASE WHEN p_partkey % 7 = 6 THEN 0 ELSE 1 END + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_kept FROM part""")
def split_statements(spark, d):
    s = P.scripts(spark, d).select("k", S.statements_of("text").alias("a"))
    return s.select("k", F.size("a").cast("long").alias("n_statements"), F.size(S.kept_statements_of(F.col("a"))).cast("long").alias("n_kept"))


def sql_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_file").where(F.lower("relative_path").endswith(".sql")).dropDuplicates(["file_id"]).withColumn("stem", stem("relative_path"))


@query(P.FILE_STATEMENTS + " SELECT file_id, unnest(range(1, len(ss) + 1))::INTEGER AS stmt_no, md5(unnest(ss)) AS statement_md5 FROM t")
def source_statements(spark, d):
    """The statements of the SQL files themselves, by their texts."""
    s = S.split_scripts(sql_files(spark, d), "file_id", text="content")
    return s.select("file_id", "stmt_no", F.md5("statement").alias("statement_md5"))


@query(P.FILE_STATEMENTS + " SELECT file_id, unnest(range(1, len(ss) + 1))::INTEGER AS stmt_no, md5(unnest(ss)) AS sql_md5 FROM k")
def source_kept_statements(spark, d):
    return S.kept_statements(sql_files(spark, d), "file_id", text="content").select("file_id", "stmt_no", F.md5("sql").alias("sql_md5"))


def file_objects(spark: SparkSession, d: str) -> DataFrame:
    return O.read_objects(S.kept_statements(sql_files(spark, d), "file_id", "stem", text="content"), "file_id", "stmt_no", system="stem").where("object_type is not null")


@query()
def source_objects(spark, d):
    return file_objects(spark, d).select("file_id", "stmt_no", "object_type", "system_name", "qualified_name", "name")


@query(P.FILE_OBJECTS + " SELECT file_id, stmt_no, object_type, system_name, qualified_name, name, md5(x) AS description_md5 FROM o")
def source_code_objects(spark, d):
    """The objects of the SQL files that keep their statement: all but plain tables, whose column
    lists SQL cannot read."""
    o = file_objects(spark, d).where("description is not null")
    return o.select("file_id", "stmt_no", "object_type", "system_name", "qualified_name", "name", F.md5("description").alias("description_md5"))


@query(P.EXPECTED + " SELECT k, seq AS stmt_no, qualified_name, true AS is_description FROM o WHERE object_type <> 'TABLE'")
def filter_statements(spark, d):
    """The text of a kept statement without its comments is the description of its object."""
    o = P.objects(spark, d).where("object_type <> 'TABLE'")
    return o.select("k", "stmt_no", "qualified_name", (F.upper("description").startswith("CREATE") & (F.col("description") == F.col("sql"))).alias("is_description"))


# Objects


def _of_type(name: str, kind: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return P.objects(spark, d).where(F.col("object_type") == kind).select("k", "stmt_no", "object_type", "system_name", "qualified_name", "name", "status")

    f.__name__ = name
    query(P.EXPECTED + f" SELECT k, seq AS stmt_no, object_type, 'part_' || k AS system_name, qualified_name, name, 'ACTIVE' AS status FROM o WHERE object_type = '{kind}'")(f)


for _name, _kind in (("extract_tables", "TABLE"), ("extract_views", "VIEW"), ("extract_matviews", "MATERIALIZED_VIEW"), ("extract_functions", "FUNCTION"), ("extract_procedures", "PROCEDURE"), ("extract_triggers", "TRIGGER")):
    _of_type(_name, _kind)


@query("""SELECT p_partkey AS k, 'TABLE' AS object_type, 'dbo.t ' || p_partkey AS qualified_name, 0::BIGINT AS n_columns FROM part""")
def extract_tsql_objects(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.lit("sys").alias("system_name"), F.expr("concat('SET ANSI_NULLS ON CREATE TABLE [dbo].[t ', p_partkey, '] (id int IDENTITY(1,1), x int)')").alias("sql"))
    return O.read_objects(t, "k").select("k", "object_type", "qualified_name", F.size("columns").cast("long").alias("n_columns"))


@query("""SELECT p_partkey AS k, md5('CREATE TABLE s' || (p_partkey % 10) || '.t_' || p_partkey || ' (\n  id INTEGER NOT NULL' || CASE WHEN p_partkey % 11 = 0 THEN '' ELSE ', -- the; key' END || '\n  code VARCHAR(20) UNIQUE,\n  qty NUMERIC(' || (10 + p_partkey % 5) || ',2) DEFAULT 0,\n  made TIMESTAMP(6) DEFAULT CURRENT_TIMESTAMP,\n  CONSTRAINT pk_' || p_partkey || ' PRIMARY KEY (id)\n)' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ' ' END || ';') AS sql_md5 FROM part""")
def strip_distribution(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("k")).select("k", F.expr(f"concat({P.TABLE_SQL}, {P.DISTRIBUTION}, ';')").alias("sql"))
    return t.select("k", F.md5(distribution_free("sql")).alias("sql_md5"))


@query("""SELECT p_partkey AS k, (CASE WHEN p_partkey % 7 > 0 THEN 0 ELSE CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 19 WHEN 2 THEN 20 ELSE 18 END END)::BIGINT AS n_removed FROM part""")
def strip_distribution_all(spark, d):
    """Of whole scripts of every kind only the clauses of tables go."""
    return P.scripts(spark, d).select("k", (F.length("text") - F.length(distribution_free("text"))).cast("long").alias("n_removed"))


@query("""SELECT '/repo/' || (p_partkey % 9) || '/part_' || p_partkey || '.sql' AS path, 'UnsupportedSqlSyntaxError' AS error_type FROM part WHERE p_partkey % 77 = 0""")
def invalid_ddl(spark, d):
    return P.read(spark, d).where("error_type is not null").select("path", "error_type")


@query("""SELECT p_partkey % 9 AS folder, count(*) FILTER (p_partkey % 77 <> 0) AS n_sound, count(*) FILTER (p_partkey % 77 = 0) AS n_failed FROM part WHERE p_partkey % 7 < 6 OR p_partkey % 5 = 0 GROUP BY ALL""")
def file_outcomes(spark, d):
    r = P.read(spark, d).groupBy("path", (F.col("k") % 9).alias("folder")).agg(F.bool_or(F.col("error_type").isNotNull()).alias("bad"))
    return r.groupBy("folder").agg(F.count_if(~F.col("bad")).alias("n_sound"), F.count_if("bad").alias("n_failed"))


_COLUMNS = """, c AS (SELECT k, unnest([1, 2, 3, 4]) AS n FROM o WHERE object_type = 'TABLE')
SELECT k, ['id', 'code', 'qty', 'made'][n] AS column_name, n::INTEGER AS ordinal_position, CASE n WHEN 1 THEN 'INT' WHEN 2 THEN 'VARCHAR(20)' WHEN 3 THEN 'DECIMAL(' || (10 + k % 5) || ', 2)' ELSE 'TIMESTAMP(6)' END AS datatype,
  n <> 1 AS nullable, CASE n WHEN 3 THEN '0' WHEN 4 THEN 'CURRENT_TIMESTAMP()' END AS default_value, n = 1 AS is_primary_key, n = 2 AS is_unique FROM c"""


@query(P.EXPECTED + _COLUMNS)
def table_columns(spark, d):
    return columns_of(P.objects(spark, d), "k").drop("column_id", "object_id")


@query(P.EXPECTED + " SELECT k, 'id' AS primary_key, 'code' AS unique_columns FROM o WHERE object_type = 'TABLE'")
def table_constraints(spark, d):
    o = P.objects(spark, d).where("object_type = 'TABLE'")
    named = lambda field: F.array_join(F.transform(F.filter("columns", lambda c: c[field]), lambda c: c["column_name"]), ",")
    return o.select("k", named("is_primary_key").alias("primary_key"), named("is_unique").alias("unique_columns"))


# Properties and candidates


@query(P.EXPECTED + """, x AS (SELECT k, unnest(['contains_dynamic_sql', 'dynamic_sql_status']) AS property_name FROM o WHERE object_type = 'PROCEDURE' AND k % 3 > 0)
SELECT k, property_name, CASE WHEN property_name = 'contains_dynamic_sql' THEN 'true' WHEN k % 3 = 1 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS property_value FROM x""")
def dynamic_sql_props(spark, d):
    p = R.properties(P.objects(spark, d), "k")
    return p.where("property_name in ('contains_dynamic_sql', 'dynamic_sql_status')").select("k", "property_name", "property_value")


@query(P.EXPECTED + """, x AS (SELECT k, unnest(['trigger_timing', 'trigger_events', 'trigger_update_columns']) AS property_name FROM o WHERE object_type = 'TRIGGER')
SELECT k, property_name, CASE property_name WHEN 'trigger_timing' THEN 'BEFORE' WHEN 'trigger_events' THEN 'INSERT,UPDATE' ELSE 'a,b' END AS property_value FROM x""")
def trigger_props(spark, d):
    return R.properties(P.objects(spark, d), "k").where("property_name like 'trigger%'").select("k", "property_name", "property_value")


def _edges(name: str, kind: str, sql: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        c = R.candidates(P.objects(spark, d), "k").where(F.col("relation_type") == kind)
        return c.select("k", "source_qualified_name", "target_qualified_name", "source_type")

    f.__name__ = name
    query(P.EXPECTED + ", e AS (" + sql + ") SELECT o.k, o.qualified_name AS source_qualified_name, o.s || '.' || e.t AS target_qualified_name, e.y AS source_type FROM o JOIN e ON o.k = e.k AND o.name NOT LIKE 'w%'")(f)


_edges("relation_reads", "READS", """
  SELECT k, 't_' || (k - 1) t, 'STATIC_SQL' y FROM p WHERE k % 7 = 1 UNION ALL SELECT k, 't_' || (k + 6), 'STATIC_SQL' FROM p WHERE k % 7 = 1
  UNION ALL SELECT k, 't_' || (k - 2), 'STATIC_SQL' FROM p WHERE k % 7 = 2 UNION ALL SELECT k, 't_' || (k - 3), 'STATIC_SQL' FROM p WHERE k % 7 = 3
  UNION ALL SELECT k, 't_' || (k + 3), CASE WHEN k % 3 = 0 THEN 'STATIC_SQL' ELSE 'RESOLVED_DYNAMIC_SQL' END FROM p WHERE k % 7 = 4 AND k % 3 < 2""")  # fmt: skip
_edges("relation_writes", "WRITES", "SELECT k, 't_' || (k - 4) t, 'STATIC_SQL' y FROM p WHERE k % 7 = 4 AND k % 3 = 0")
_edges("relation_calls", "CALLS", """
  SELECT k, 'f_' || (k + 7) t, 'STATIC_SQL' y FROM p WHERE k % 7 = 3 UNION ALL SELECT k, 'p_' || (k + 7), 'STATIC_SQL' FROM p WHERE k % 7 = 4 AND k % 3 = 0
  UNION ALL SELECT k, 't_' || (k - 4), 'STATIC_SQL' FROM p WHERE k % 7 = 4 AND k % 3 = 0 UNION ALL SELECT k, 'f_' || (k - 2), 'STATIC_SQL' FROM p WHERE k % 7 = 5""")  # fmt: skip
_edges("relation_targets", "TARGET", "SELECT k, 't_' || (k - 5) t, 'STATIC_SQL' y FROM p WHERE k % 7 = 5")


# Catalogue


@query("SELECT DISTINCT object_id, object_type, system_name, qualified_name, name, status FROM emip_object WHERE object_type = 'TRIGGER' AND status = 'ACTIVE'")
def catalog_lookup(spark, d):
    return C.lookup(distinct_objects(spark, d), object_type="TRIGGER", status="ACTIVE").select("object_id", "object_type", "system_name", "qualified_name", "name", "status")


@query("""WITH c AS (SELECT object_id, count(DISTINCT column_id) n FROM emip_column GROUP BY 1), p AS (SELECT object_id, count(DISTINCT property_id) n, min(property_name) f FROM emip_property GROUP BY 1)
SELECT DISTINCT o.object_id, coalesce(c.n, 0) AS n_columns, coalesce(p.n, 0) AS n_properties, p.f AS first_property FROM emip_object o LEFT JOIN c USING (object_id) LEFT JOIN p USING (object_id)""")
def catalog_children(spark, d):
    o = C.with_children(distinct_objects(spark, d), table(spark, d, "emip_column").dropDuplicates(["column_id"]), table(spark, d, "emip_property").dropDuplicates(["property_id"]))
    return o.select("object_id", F.size("columns").cast("long").alias("n_columns"), F.size("properties").cast("long").alias("n_properties"), F.try_element_at("properties", F.lit(1))["property_name"].alias("first_property"))


@query("SELECT qualified_name, arg_min(system_name, (system_name, object_id)) AS system_name, arg_min(object_id, (system_name, object_id)) AS object_id FROM emip_object GROUP BY 1")
def identity_fallback(spark, d):
    return C.first_by_qualified_name(table(spark, d, "emip_object"))


@query("""WITH o AS (SELECT DISTINCT object_id, system_name, qualified_name, object_type, created_at FROM emip_object), s AS (SELECT * FROM o WHERE created_at < TIMESTAMP '2023-06-01')
SELECT object_id FROM o WHERE object_id IN (SELECT object_id FROM s) OR (system_name, qualified_name) IN (SELECT (system_name, qualified_name) FROM s)""")
def object_exists(spark, d):
    o = distinct_objects(spark, d)
    return C.existing(o.select("object_id", "system_name", "qualified_name"), o.where("created_at < timestamp'2023-06-01'")).select("object_id")


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY loaded_at, object_id, created_at, updated_at) seq FROM emip_object),
s AS (SELECT * FROM o WHERE created_at < TIMESTAMP '2023-06-01'),
k AS (SELECT o.*, o.object_id IN (SELECT object_id FROM s) OR (o.system_name, o.qualified_name) IN (SELECT (system_name, qualified_name) FROM s) OR seq > min(seq) OVER (PARTITION BY object_id) OR seq > min(seq) OVER (PARTITION BY system_name, qualified_name) AS skip FROM o)
SELECT count(*) FILTER (NOT skip) AS objects_created, count(*) FILTER (skip) AS objects_skipped, 0::BIGINT AS objects_failed FROM k""")
def persist_outcomes(spark, d):
    o = table(spark, d, "emip_object")
    # The order of arrival, without numbering all rows in one task.
    batch = o.withColumn("seq", F.concat_ws("/", F.date_format("loaded_at", "yyyyMMddHHmmss.SSSSSS"), "object_id"))
    ids = batch.groupBy("object_id").agg(F.count("*").alias("n"))
    once = C.classify(batch.dropDuplicates(["object_id"]), o.where("created_at < timestamp'2023-06-01'")).join(ids, "object_id")
    # A repeated row of an object comes after its first one and is skipped.
    new, old = F.col("outcome") == "created", F.col("outcome") == "skipped"
    return once.agg(F.count_if(new).alias("objects_created"), F.sum(F.when(old, F.col("n")).otherwise(F.col("n") - 1)).alias("objects_skipped"), F.count_if(F.col("outcome") == "failed").alias("objects_failed"))


@query("""SELECT DISTINCT object_id, CASE WHEN object_type = 'VIEW' THEN upper(name) ELSE name END AS name, CASE WHEN object_type = 'VIEW' THEN 'DEPRECATED' ELSE status END AS status FROM emip_object""")
def catalog_upsert(spark, d):
    o = distinct_objects(spark, d)
    changed = o.where("object_type = 'VIEW'").withColumns({"name": F.upper("name"), "status": F.lit("DEPRECATED")})
    return C.updated(o, changed).select("object_id", "name", "status")


@query("SELECT object_type, count(DISTINCT object_id) AS n FROM emip_object WHERE object_type <> 'FILE' GROUP BY 1")
def catalog_delete(spark, d):
    o = distinct_objects(spark, d)
    stored = new_catalog(spark)
    stored.append({"OBJECT": o})
    stored.delete_objects(o.where("object_type = 'FILE'"))
    return stored.read("OBJECT").groupBy("object_type").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT object_id, property_name, upper(property_name) u FROM emip_property WHERE property_name LIKE 'trigger%'),
k AS (SELECT DISTINCT property_id, object_id, property_name FROM emip_property)
SELECT object_id, property_name, count(*) AS n FROM (SELECT object_id, property_name FROM k WHERE object_id NOT IN (SELECT object_id FROM n) UNION ALL SELECT DISTINCT object_id, 'has_trigger' FROM n) GROUP BY ALL""")
def replace_children(spark, d):
    p = table(spark, d, "emip_property").dropDuplicates(["property_id"]).select("property_id", "object_id", "property_name", "property_value")
    new = p.where("property_name like 'trigger%'").select("object_id").distinct().select(F.md5("object_id").alias("property_id"), "object_id", F.lit("has_trigger").alias("property_name"), F.lit("true").alias("property_value"))
    return C.with_replaced(p, new).groupBy("object_id", "property_name").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT DISTINCT object_id, system_name, qualified_name FROM emip_object), r AS (SELECT DISTINCT relation_id, from_object_id f, to_object_id t, relation_type, source_type FROM emip_relation),
c AS (SELECT r.f, s.system_name, x.qualified_name q, r.relation_type, r.source_type FROM r JOIN o s ON s.object_id = r.f JOIN o x ON x.object_id = r.t)
SELECT c.f AS from_object_id, coalesce((SELECT min(object_id) FROM o WHERE o.system_name = c.system_name AND o.qualified_name = c.q), (SELECT arg_min(object_id, (o.system_name, o.object_id)) FROM o WHERE o.qualified_name = c.q)) AS to_object_id, relation_type, source_type FROM c""")
def resolve_candidates(spark, d):
    o = distinct_objects(spark, d).select("object_id", "system_name", "qualified_name")
    found = distinct_relations(spark, d).join(o.select(F.col("object_id").alias("to_object_id"), F.col("qualified_name").alias("target_qualified_name")), "to_object_id").select(F.col("from_object_id").alias("object_id"), "target_qualified_name", "relation_type", "source_type")
    return C.resolve_candidates(found, o, o)


@query("""SELECT from_object_id, to_object_id, relation_type, source_type FROM emip_relation WHERE from_object_id IS NOT NULL AND to_object_id IS NOT NULL
EXCEPT SELECT from_object_id, to_object_id, relation_type, source_type FROM emip_relation WHERE created_at < TIMESTAMP '2023-06-01'""")
def edge_dedupe(spark, d):
    r = distinct_relations(spark, d)
    return C.new_edges(r, r.where("created_at < timestamp'2023-06-01'"))


def _busiest(column: str) -> str:
    return f"(SELECT {column} FROM emip_relation WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(DISTINCT relation_id) DESC, 1 LIMIT 1)"


def busiest(r: DataFrame, column: str) -> str:
    """The object with most edges, the start of the point queries."""
    found = r.groupBy(column).count().orderBy(F.desc("count"), column).first()
    return found[0] if found else ""


@query(f"SELECT DISTINCT relation_id, from_object_id, relation_type FROM emip_relation WHERE to_object_id = {_busiest('to_object_id')} AND from_object_id IS NOT NULL")
def upstream_edges(spark, d):
    r = distinct_relations(spark, d)
    return C.upstream(r, busiest(table(spark, d, "emip_relation").where("to_object_id is not null").dropDuplicates(["relation_id"]), "to_object_id")).select("relation_id", "from_object_id", "relation_type")


@query(f"SELECT DISTINCT relation_id, to_object_id, relation_type FROM emip_relation WHERE from_object_id = {_busiest('from_object_id')} AND to_object_id IS NOT NULL")
def downstream_edges(spark, d):
    r = distinct_relations(spark, d)
    return C.downstream(r, busiest(table(spark, d, "emip_relation").where("from_object_id is not null").dropDuplicates(["relation_id"]), "from_object_id")).select("relation_id", "to_object_id", "relation_type")


_R = "r AS (SELECT DISTINCT relation_id, from_object_id f, to_object_id t FROM emip_relation WHERE from_object_id IS NOT NULL AND to_object_id IS NOT NULL)"


@query(f"WITH RECURSIVE {_R}, s AS (SELECT {_busiest('from_object_id')} v UNION SELECT r.t FROM r JOIN s ON r.f = s.v) SELECT relation_id, f AS from_object_id, t AS to_object_id FROM r WHERE f IN (SELECT v FROM s)")
def lineage_bfs_down(spark, d):
    start = busiest(table(spark, d, "emip_relation").where("from_object_id is not null").dropDuplicates(["relation_id"]), "from_object_id")
    return G.traverse(distinct_relations(spark, d), start, G.DOWNSTREAM).select("relation_id", "from_object_id", "to_object_id")


@query(f"WITH RECURSIVE {_R}, s AS (SELECT {_busiest('to_object_id')} v UNION SELECT r.f FROM r JOIN s ON r.t = s.v) SELECT relation_id, f AS from_object_id, t AS to_object_id FROM r WHERE t IN (SELECT v FROM s)")
def lineage_bfs_up(spark, d):
    start = busiest(table(spark, d, "emip_relation").where("to_object_id is not null").dropDuplicates(["relation_id"]), "to_object_id")
    return G.traverse(distinct_relations(spark, d), start, G.UPSTREAM).select("relation_id", "from_object_id", "to_object_id")


@query(f"""WITH RECURSIVE {_R}, st AS (SELECT DISTINCT object_id v FROM emip_object WHERE object_type = 'WORKFLOW'), s AS (SELECT v AS start_id, v, 0 AS depth FROM st UNION SELECT s.start_id, r.t, s.depth + 1 FROM r JOIN s ON r.f = s.v WHERE s.depth < 2),
m AS (SELECT start_id, v, min(depth) depth FROM s GROUP BY 1, 2) SELECT m.start_id, (m.depth + 1)::INTEGER AS depth, r.relation_id FROM m JOIN r ON r.f = m.v WHERE m.depth < 3 AND m.depth + 1 <= 3""")
def lineage_bfs_depth(spark, d):
    start = distinct_objects(spark, d).where("object_type = 'WORKFLOW'")
    return G.traverse(distinct_relations(spark, d), start, G.DOWNSTREAM, 3).select("start_id", "depth", "relation_id")


@query("""WITH RECURSIVE b AS (SELECT from_object_id f, to_object_id t, created_at, relation_id FROM emip_relation WHERE upper(trim(relation_type)) = 'BELONGS_TO' AND from_object_id IS NOT NULL AND to_object_id IS NOT NULL),
p AS (SELECT f, arg_max(t, (created_at, t)) t FROM b GROUP BY 1), h AS (SELECT t v FROM p WHERE t NOT IN (SELECT f FROM p) UNION SELECT p.f FROM p JOIN h ON p.t = h.v), st AS (SELECT f v FROM p WHERE f NOT IN (SELECT v FROM h)),
r AS (SELECT DISTINCT relation_id, f, t FROM b), s AS (SELECT v AS start_id, v, 0 AS depth FROM st UNION SELECT s.start_id, r.t, s.depth + 1 FROM r JOIN s ON r.f = s.v WHERE s.depth < 4), m AS (SELECT start_id, v, min(depth) depth FROM s GROUP BY 1, 2)
SELECT m.start_id, (m.depth + 1)::INTEGER AS depth, r.relation_id FROM m JOIN r ON r.f = m.v WHERE m.depth < 5""")
def lineage_cycle(spark, d):
    """From every object on a cycle of BELONGS_TO, or below one, five levels up: ways that close."""
    r = distinct_relations(spark, d).where("upper(trim(relation_type)) = 'BELONGS_TO'")
    start = H.hierarchy(table(spark, d, "emip_relation")).where("root_object_id = ''").select("object_id")
    return G.traverse(r, start, G.DOWNSTREAM, 5).select("start_id", "depth", "relation_id")


@query(f"""WITH {_R}, one AS (SELECT f s, t v FROM r WHERE f <> t), two AS (SELECT a.s, r.t v FROM one a JOIN r ON r.f = a.v WHERE r.t <> a.s), x AS (SELECT * FROM one UNION SELECT * FROM two) SELECT s AS object_id, count(*) AS n_affected FROM x GROUP BY 1""")
def impact_within_two(spark, d):
    """Objects within two steps downstream of every object: all starts at once, set by set."""
    return G.within_two(table(spark, d, "emip_relation")).groupBy(F.col("s").alias("object_id")).agg(F.count("*").alias("n_affected"))


@query("SELECT object_id, arg_max(version_id, (version_number, created_at, version_id)) AS version_id, max(version_number) AS version_number FROM object_version GROUP BY 1")
def object_versions_current(spark, d):
    return C.current_versions(table(spark, d, "object_version")).select("object_id", "version_id", "version_number")


@query("""WITH v AS (SELECT source_location p, hash_value h, created_at c FROM object_version WHERE source_location IS NOT NULL), b AS (SELECT p, arg_max(coalesce(h, ''), (c, coalesce(h, ''))) h FROM v WHERE c < TIMESTAMP '2024-01-01' GROUP BY 1), n AS (SELECT p, arg_max(coalesce(h, ''), (c, coalesce(h, ''))) h FROM v WHERE c >= TIMESTAMP '2024-01-01' GROUP BY 1)
SELECT n.p AS path, n.h AS hash_value, n.h IS DISTINCT FROM b.h AS changed FROM n LEFT JOIN b USING (p)""")
def incremental_changes(spark, d):
    v = table(spark, d, "object_version").where("source_location is not null").select(F.col("source_location").alias("path"), F.coalesce("hash_value", F.lit("")).alias("hash_value"), F.col("created_at").alias("modified_at"))
    old = v.where("modified_at < timestamp'2024-01-01'").groupBy("path").agg(F.max_by("hash_value", F.struct("modified_at", "hash_value")).alias("hash_value"))
    return latest_targets(v.where("modified_at >= timestamp'2024-01-01'"), old)


@query("SELECT DISTINCT object_id, md5(owner_name) AS tag_id, owner_name AS name FROM emip_object WHERE owner_name IS NOT NULL")
def tags_for_object(spark, d):
    o = table(spark, d, "emip_object").where("owner_name is not null")
    return C.tags_of(o.select("object_id", F.md5("owner_name").alias("tag_id")), o.select(F.md5("owner_name").alias("tag_id"), F.col("owner_name").alias("name")).distinct())


PII_RULES = [("r1", "CONTACT", "(?i)addr|zip|city", 10), ("r2", "FINANCE", "(?i)amt|price|fee|tax", 20), ("r3", "PERSON", "(?i)user|cust|owner", 20)]


@query("""WITH c AS (SELECT DISTINCT column_id, column_name n FROM emip_column)
SELECT column_id, CASE WHEN regexp_matches(n, '(?i)amt|price|fee|tax') THEN 'r2' WHEN regexp_matches(n, '(?i)user|cust|owner') THEN 'r3' ELSE 'r1' END AS rule_id, CASE WHEN regexp_matches(n, '(?i)amt|price|fee|tax') THEN 'FINANCE' WHEN regexp_matches(n, '(?i)user|cust|owner') THEN 'PERSON' ELSE 'CONTACT' END AS category FROM c WHERE regexp_matches(n, '(?i)addr|zip|city|amt|price|fee|tax|user|cust|owner')""")
def pii_rule_hits(spark, d):
    return C.pii_hits(table(spark, d, "emip_column").select("column_id", "column_name").distinct(), PII_RULES)


@query("""WITH c AS (SELECT scan_job_id, count(DISTINCT object_id) o, count(DISTINCT column_id) n FROM emip_column GROUP BY 1), f AS (SELECT scan_job_id, count(DISTINCT failure_id) e FROM failed_file GROUP BY 1)
SELECT DISTINCT j.scan_job_id, coalesce(c.o, 0) AS object_count, coalesce(c.n, 0) AS column_count, coalesce(f.e, 0) AS error_count FROM scan_job j LEFT JOIN c USING (scan_job_id) LEFT JOIN f USING (scan_job_id)""")
def scan_results(spark, d):
    none = table(spark, d, "failed_file").select("scan_job_id", F.lit(None).cast("string").alias("relation_id"))
    return C.results_of(table(spark, d, "scan_job"), table(spark, d, "emip_column"), none, table(spark, d, "failed_file")).drop("relation_count")


_TWINS = """WITH c AS (SELECT object_id o, column_name n, min(column_id) i FROM emip_column GROUP BY 1, 2), e AS (SELECT DISTINCT from_object_id f, to_object_id t FROM emip_relation WHERE from_object_id IS NOT NULL AND to_object_id IS NOT NULL),
p AS (SELECT f a, t b FROM e UNION SELECT r.t, w.t FROM e r JOIN e w ON r.f = w.f), x AS (SELECT DISTINCT c.i AS source_column_id, z.i AS target_column_id, c.n FROM p JOIN c ON c.o = p.a JOIN c z ON z.o = p.b AND z.n = c.n WHERE p.a <> p.b)"""


@query(_TWINS + " SELECT source_column_id, target_column_id, n AS transformation FROM x UNION ALL SELECT source_column_id, target_column_id, 'again' FROM x")
def column_lineage(spark, d):
    """Columns of one name in tables that an edge or one object between them relates: saved twice
    under two transformations and once more in vain, and found by their source columns."""
    c = table(spark, d, "emip_column").groupBy("object_id", "column_name").agg(F.min("column_id").alias("column_id"))
    e = table(spark, d, "emip_relation").where("from_object_id is not null and to_object_id is not null").select(F.col("from_object_id").alias("f"), F.col("to_object_id").alias("t")).distinct()
    # Only tables have columns, so the ends are brought down to these before they are paired.
    ends = e.join(c.select(F.col("object_id").alias("t")).distinct(), "t", "left_semi")
    side = lambda o, i: c.select(F.col("object_id").alias(o), "column_name", F.col("column_id").alias(i))
    here = ends.select("f", F.col("t").alias("b")).join(side("b", "target_column_id"), "b")
    around = ends.select("f", F.col("t").alias("a")).join(side("a", "source_column_id"), "a").join(here, ["f", "column_name"])
    direct = e.select(F.col("f").alias("a"), F.col("t").alias("b")).join(side("a", "source_column_id"), "a").join(side("b", "target_column_id"), ["b", "column_name"])
    pairs = cut(direct.select("a", "b", "column_name", "source_column_id", "target_column_id").unionByName(around.select("a", "b", "column_name", "source_column_id", "target_column_id")).where("a <> b").select("source_column_id", "target_column_id", F.col("column_name").alias("transformation")).distinct())
    stored = new_catalog(spark)
    for x in (pairs, pairs.withColumn("transformation", F.lit("again")), pairs):
        stored.save_column_relations(x)
    found = stored.find_column_relations(pairs.select(F.col("source_column_id").alias("column_id")))
    return found.select("source_column_id", "target_column_id", "transformation")


# Reports


def _files(spark: SparkSession, d: str) -> DataFrame:
    """One row per script as a scan reports it."""
    r = P.read(spark, d).groupBy("path").agg(F.bool_or(F.col("error_type").isNotNull()).alias("failed"), F.count("object_type").alias("objects"))
    f = P.scripts(spark, d).select("path").join(r, "path", "left")
    bad = F.coalesce("failed", F.lit(False))
    n = F.when(bad, 0).otherwise(F.coalesce("objects", F.lit(0)))
    return f.select("path", F.lit(True).alias("supported"), F.lit(None).cast("string").alias("unsupported_reason"), bad.alias("failed"), n.alias("objects"), n.alias("created"), F.lit(0).cast("long").alias("skipped"))


@query(P.EXPECTED + """, f AS (SELECT k, count(*) n FROM o GROUP BY 1) SELECT (SELECT count(*) FROM p) AS files_scanned, (SELECT count(*) FROM p) AS files_supported, 0::BIGINT AS files_unsupported, (SELECT count(*) FROM p WHERE k % 77 = 0) AS files_failed,
 (SELECT count(*) FROM o) AS objects_created, 0::BIGINT AS objects_skipped, (SELECT count(*) FROM f WHERE n > 1) AS files_with_several_objects""")
def scan_summary(spark, d):
    return T.scan_summary(_files(spark, d))


@query(P.EXPECTED + " SELECT '/repo/' || (k % 9) || '/part_' || k || '.sql' AS path, count(*) AS objects FROM o GROUP BY k HAVING count(*) > 1")
def multi_object_files(spark, d):
    return _files(spark, d).where("objects > 1").select("path", "objects")


_BLOCK = "concat_ws(chr(10), repeat('=', 49), relative_path, 'Absolute path: ' || absolute_path, 'Parser: ' || parser, 'Stage: ' || stage, 'Exception: ' || error_type, 'Statement type: ' || coalesce(statement_type, 'Unknown'), 'Message: ' || error_message, repeat('=', 49))"


@query(f"SELECT DISTINCT failure_id, md5({_BLOCK}) AS block_md5 FROM failed_file")
def failed_files(spark, d):
    return table(spark, d, "failed_file").dropDuplicates(["failure_id"]).select("failure_id", F.md5(T.block_of()).alias("block_md5"))


_CAUSES = [("ENCODING", "(?i)decode|encoding|charset"), ("SYNTAX", "(?i)parse|syntax|token"), ("ACCESS", "(?i)permission|denied|cannot read")]


@query("""WITH f AS (SELECT DISTINCT failure_id, coalesce(error_type, '') || ' ' || coalesce(error_message, '') m FROM failed_file),
c AS (SELECT CASE WHEN regexp_matches(m, '(?i)decode|encoding|charset') THEN 'ENCODING' WHEN regexp_matches(m, '(?i)parse|syntax|token') THEN 'SYNTAX' WHEN regexp_matches(m, '(?i)permission|denied|cannot read') THEN 'ACCESS' ELSE 'OTHER' END AS cause, count(*) AS n FROM f GROUP BY 1)
SELECT cause, n, round(n * 100.0 / sum(n) OVER (), 2)::DOUBLE AS pct, (row_number() OVER (ORDER BY n DESC, cause))::INTEGER AS rank FROM c""")
def root_cause_pct(spark, d):
    m = F.concat_ws(" ", F.coalesce("error_type", F.lit("")), F.coalesce("error_message", F.lit("")))
    return T.root_causes(table(spark, d, "failed_file").dropDuplicates(["failure_id"]), [(n, m.rlike(p)) for n, p in _CAUSES])


@query("""WITH f AS (SELECT DISTINCT failure_id, coalesce(error_type, '') || ' ' || coalesce(error_message, '') m FROM failed_file)
SELECT 'ENCODING' AS signature, count(*) FILTER (regexp_matches(m, '(?i)decode|encoding|charset')) AS n FROM f UNION ALL SELECT 'SYNTAX', count(*) FILTER (regexp_matches(m, '(?i)parse|syntax|token')) FROM f UNION ALL SELECT 'ACCESS', count(*) FILTER (regexp_matches(m, '(?i)permission|denied|cannot read')) FROM f""")
def signature_counts(spark, d):
    m = F.concat_ws(" ", F.coalesce("error_type", F.lit("")), F.coalesce("error_message", F.lit("")))
    return T.signatures(table(spark, d, "failed_file").dropDuplicates(["failure_id"]), {n: m.rlike(p) for n, p in _CAUSES})


@query("SELECT substr(error_message, 1, 24) AS message, count(DISTINCT failure_id) AS n FROM failed_file GROUP BY 1 ORDER BY n DESC, message NULLS FIRST LIMIT 20")
def top_messages(spark, d):
    return T.top(table(spark, d, "failed_file").dropDuplicates(["failure_id"]), F.substring("error_message", 1, 24), "message", 20)


_KINDS = ("TABLE", "VIEW", "MATERIALIZED_VIEW", "FUNCTION", "PROCEDURE", "TRIGGER")


@query("SELECT system_name, " + ", ".join(f"count(DISTINCT object_id) FILTER (object_type = '{k}') AS {k.lower()}" for k in _KINDS) + ", count(DISTINCT object_id) AS total FROM emip_object GROUP BY ROLLUP (system_name)")
def coverage_by_type(spark, d):
    return T.coverage(distinct_objects(spark, d), "system_name", _KINDS)


@query(P.FILE_OBJECTS + """, g AS (SELECT file_id, count(*) AS objects FROM o GROUP BY 1), h AS (SELECT DISTINCT file_id, system_name, relative_path, lower(relative_path) LIKE '%.sql' AS sql FROM source_file), e AS (SELECT DISTINCT system_name, relative_path FROM failed_file)
SELECT h.system_name, count(*) AS discovered, count(*) FILTER (NOT sql) AS ignored, count(*) FILTER (sql) AS scanned, count(*) FILTER (sql) AS supported, 0::BIGINT AS unsupported,
 count(*) FILTER (sql AND e.relative_path IS NOT NULL) AS failed, coalesce(sum(g.objects) FILTER (sql AND e.relative_path IS NULL), 0)::BIGINT AS objects
FROM h LEFT JOIN e ON h.system_name = e.system_name AND h.relative_path = e.relative_path LEFT JOIN g ON g.file_id = h.file_id GROUP BY 1""")
def repo_funnel(spark, d):
    """Per repository: files, those a parser takes, those reported as failed, and the objects that
    the others define, but for plain tables."""
    e = table(spark, d, "failed_file").select("system_name", "relative_path").distinct().withColumn("e", F.lit(True))
    n = file_objects(spark, d).where("description is not null").groupBy("file_id").agg(F.count("*").alias("n"))
    f = table(spark, d, "source_file").select("file_id", "system_name", "relative_path").distinct().join(e, ["system_name", "relative_path"], "left").join(n, "file_id", "left")
    sql = O.dispatch(extension("relative_path")).isNotNull()
    bad = F.coalesce("e", F.lit(False))
    return T.funnel(f.select("system_name", (~sql).alias("ignored"), sql.alias("supported"), F.lit(None).cast("string").alias("unsupported_reason"), bad.alias("failed"), F.when(sql & ~bad, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("objects")), "system_name")


@query(P.EXPECTED + """, s AS (SELECT sum(CASE WHEN k % 3 = 0 THEN 1 WHEN k % 7 = 4 AND k % 4 IN (1, 2) THEN 1 ELSE 0 END + CASE WHEN k % 7 = 6 THEN 2 ELSE 1 END + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END)::BIGINT n FROM p)
SELECT (SELECT count(*) FROM p) AS scripts, (SELECT n FROM s) AS statements, (SELECT count(*) FROM a) AS kept, (SELECT count(*) FROM a WHERE NOT (seq = 1 AND broken)) AS parsed, (SELECT count(*) FROM o) AS objects""")
def stage_funnel(spark, d):
    s = P.scripts(spark, d).agg(F.count("*").alias("scripts"), F.sum(F.size(S.statements_of("text"))).alias("statements"))
    read = cut(P.read(spark, d))
    r = read.agg(F.count("*").alias("kept"), F.count("object_type").alias("parsed"))
    o = O.file_outcomes(read).agg(F.count("*").alias("objects"))
    one = F.lit(1)  # each side is one row
    return s.withColumn("one", one).join(r.withColumn("one", one), "one").join(o.withColumn("one", one), "one").drop("one")
