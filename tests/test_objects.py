import pytest

from conftest import rows
from metaquarry.operators import columns as K
from metaquarry.operators import objects as O
from metaquarry.operators import relations as R


def read(spark, *sql, **kw):
    df = spark.createDataFrame([(i, "sys", s) for i, s in enumerate(sql)], "i int, system_name string, sql string")
    got = {r["i"]: r for r in O.read_objects(df, "i", **kw).collect()}
    return [got[i] for i in range(len(sql))]


def found(spark, what, sql, **kw):
    df = spark.createDataFrame([(1, "sys", sql)], "i int, system_name string, sql string")
    return what(O.objects_only(O.read_objects(df, "i")), "i", **kw)


def edges(spark, sql, **kw):
    return [(r["relation_type"], r["target_qualified_name"], r["source_type"]) for r in found(spark, R.candidates, sql, **kw).orderBy("seq").collect()]


def props(spark, sql):
    return {r["property_name"]: r["property_value"] for r in found(spark, R.properties, sql).collect()}


@pytest.mark.parametrize("tail", ["", " DISTRIBUTED BY (id)", " DISTRIBUTED RANDOMLY", " DISTRIBUTED REPLICATED", " DISTRIBUTE BY (id)"])
def test_tables(spark, tail):
    r = read(spark, f"CREATE TABLE dm.orders (id INT){tail};")[0]
    assert (r["object_type"], r["qualified_name"], r["name"], r["system_name"], r["description"]) == ("TABLE", "dm.orders", "orders", "sys", None)


def test_kinds_and_names(spark):
    cases = {
        "CREATE VIEW a.v AS SELECT 1": ("VIEW", "a.v", "v"),
        "CREATE OR REPLACE VIEW a.v AS SELECT 1": ("VIEW", "a.v", "v"),
        "CREATE MATERIALIZED VIEW a.m AS SELECT 1": ("MATERIALIZED_VIEW", "a.m", "m"),
        "CREATE FUNCTION a.f() RETURNS int AS $$ x $$ LANGUAGE sql": ("FUNCTION", "a.f", "f"),
        "CREATE OR REPLACE FUNCTION f (a int) RETURNS TABLE (b int) LANGUAGE sql AS 'x'": ("FUNCTION", "f", "f"),
        "CREATE PROCEDURE a.p() LANGUAGE sql AS $$ x $$": ("PROCEDURE", "a.p", "p"),
        "CREATE OR REPLACE PROCEDURE a.p(x int) AS $$ $$": ("PROCEDURE", "a.p", "p"),
        "CREATE TRIGGER trg BEFORE INSERT ON a.t FOR EACH ROW EXECUTE FUNCTION a.f()": ("TRIGGER", "trg", "trg"),
        "CREATE TRIGGER x INSTEAD OF UPDATE ON a.t EXECUTE FUNCTION f()": ("TRIGGER", "x", "x"),
        "CREATE TABLE [dbo].[Big Table] ([a] int)": ("TABLE", "dbo.Big Table", "Big Table"),
        "CREATE OR ALTER VIEW dbo.v AS SELECT 1": ("VIEW", "dbo.v", "v"),
        "ALTER PROC [dbo].[p] AS SELECT 1": ("PROCEDURE", "dbo.p", "p"),
        "INSERT INTO a VALUES (1)": (None, None, None),
        "CREATE INDEX i ON a (b)": (None, None, None),
        "ALTER TABLE a ADD b INT": (None, None, None),
    }
    for sql, r in zip(cases, read(spark, *cases), strict=True):
        assert (r["object_type"], r["qualified_name"], r["name"]) == cases[sql], sql
        assert r["description"] == (sql if r["object_type"] not in (None, "TABLE") or "[" in sql else None)


def test_quirks_and_their_mending(spark):
    array = "CREATE TABLE a.t (x INT[], y INT)"
    assert read(spark, array)[0]["columns"] == [] and len(read(spark, array, strict_compat=False)[0]["columns"]) == 2
    inner = "CREATE OR REPLACE FUNCTION f() RETURNS int AS $$ CREATE TABLE t (a int); x[1] $$"
    assert read(spark, inner)[0]["object_type"] == "TABLE" and read(spark, inner, strict_compat=False)[0]["object_type"] == "FUNCTION"
    exists = "CREATE TABLE IF NOT EXISTS a.t (x INT IDENTITY)"
    assert read(spark, exists)[0]["qualified_name"] == "IF"
    assert edges(spark, "CREATE PROCEDURE p() AS $$ UPDATE s.t SET a = 1 $$") == [] and edges(spark, "CREATE PROCEDURE p() AS $$ UPDATE s.t SET a = 1 $$", strict_compat=False) == [("WRITES", "s.t", "STATIC_SQL")]


@pytest.mark.parametrize("sql", ["CREATE TABLE a.t (", "CREATE TABLE a.t (x INT) NOT NULL) DISTRIBUTED BY (x)", "CREATE TABLE a.t (x INT y INT)", "CREATE TABLE a.t (x INT, , y INT)", "CREATE TABLE a.t (x)", "CREATE TABLE a.t (x INT,\n y VARCHAR(20) z INT)"])
def test_unreadable_tables(spark, sql):
    r = read(spark, sql)[0]
    assert (r["object_type"], r["error_type"]) == (None, "UnsupportedSqlSyntaxError")


def test_columns(spark):
    sql = """CREATE TABLE a.t (
        id INTEGER NOT NULL -- the, key
      , code CHARACTER VARYING(20) UNIQUE, "Big" NUMERIC(12,2) DEFAULT 0 NULL, made TIMESTAMP(6) DEFAULT CURRENT_TIMESTAMP,
      note TEXT DEFAULT 'a, b' /* 中文 ( */, z DOUBLE PRECISION, day DATE DEFAULT now() NOT NULL, w INT4 PRIMARY KEY, PRIMARY KEY (code),
      CONSTRAINT pk PRIMARY KEY (id, made), CONSTRAINT u UNIQUE (note), CHECK (z > 0), FOREIGN KEY (w) REFERENCES b (c)
    ) WITH (appendonly=true) DISTRIBUTED BY (id) PARTITION BY RANGE (day) (START (date '2020-01-01') END (date '2021-01-01') EVERY (INTERVAL '1 month'));"""
    got = [tuple(c) for c in read(spark, sql)[0]["columns"]]
    assert got == [
        ("id", 1, "INT", False, None, True, False),
        ("code", 2, "VARCHAR(20)", True, None, False, True),
        ("Big", 3, "DECIMAL(12, 2)", True, "0", False, False),
        ("made", 4, "TIMESTAMP(6)", False, "CURRENT_TIMESTAMP()", True, False),
        ("note", 5, "TEXT", True, "'a, b'", False, True),
        ("z", 6, "DOUBLE", True, None, False, False),
        ("day", 7, "DATE", False, "now()", False, False),
        ("w", 8, "INT", False, None, True, False),
    ]


def test_views_have_no_columns_and_ids_repeat(spark):
    df = spark.createDataFrame([("s", "CREATE VIEW v AS SELECT 1"), ("s", "CREATE TABLE t (a INT, b INT)")], "system_name string, sql string")
    a, b = (O.objects_only(O.read_objects(df)) for _ in range(2))
    assert rows(a.select("object_id")) == rows(b.select("object_id"))
    assert [(r["column_name"], len(r["column_id"])) for r in K.columns_of(a).orderBy("ordinal_position").collect()] == [("a", 36), ("b", 36)]


def test_one_failure_discards_the_file(spark):
    df = spark.createDataFrame([("f", "s", "CREATE VIEW v AS SELECT 1"), ("f", "s", "CREATE TABLE t ("), ("g", "s", "CREATE VIEW w AS SELECT 1")], "path string, system_name string, sql string")
    assert [r["path"] for r in O.file_outcomes(O.read_objects(df, "path")).collect()] == ["g"]


def test_null_and_empty_statements(spark):
    assert [(r["object_type"], r["error_type"]) for r in read(spark, None, "")] == [(None, None)] * 2


def test_dynamic_sql(spark):
    sql = "CREATE OR ALTER PROCEDURE dbo.p AS DECLARE @S nvarchar(99) = 'SELECT a FROM dbo.t'; EXEC(@s)"
    assert edges(spark, sql) == [("READS", "dbo.t", "RESOLVED_DYNAMIC_SQL")]
    assert props(spark, sql) == {"contains_dynamic_sql": "true", "dynamic_sql_source": sql, "dynamic_sql_status": "RESOLVED"}
    sql = "CREATE OR ALTER PROCEDURE dbo.p AS EXEC(@a + @b)"
    assert edges(spark, sql) == [] and props(spark, sql)["dynamic_sql_status"] == "UNRESOLVED"
    last = "CREATE OR ALTER PROCEDURE dbo.p AS DECLARE @s int = '1'; DECLARE @s int = 'DELETE FROM x.y'; EXEC(@s)"
    assert ("WRITES", "x.y", "RESOLVED_DYNAMIC_SQL") in edges(spark, last)


def test_edges(spark):
    f = 'CREATE FUNCTION s.f() RETURNS int AS $$ SELECT a FROM "S"."T" JOIN s.u ON 1=1; -- FROM c.d\nPERFORM s.g(1); SELECT x FROM S.F; SELECT x FROM "S"."T" $$'
    assert edges(spark, f) == [("READS", "S.T", "STATIC_SQL"), ("READS", "c.d", "STATIC_SQL"), ("READS", "s.u", "STATIC_SQL"), ("CALLS", "s.g", "STATIC_SQL")]
    p = "CREATE PROCEDURE s.p() AS $$ INSERT INTO s.a (x) SELECT 1 FROM s.b; UPDATE  s.c SET x=1; DELETE FROM s.d; MERGE INTO s.e USING s.b ON true; CALL s.q(); $$"
    assert edges(spark, p) == [("READS", "s.b", "STATIC_SQL"), ("READS", "s.d", "STATIC_SQL"), ("WRITES", "s.a", "STATIC_SQL"), ("WRITES", "s.c", "STATIC_SQL"), ("WRITES", "s.d", "STATIC_SQL"), ("WRITES", "s.e", "STATIC_SQL"), ("CALLS", "s.q", "STATIC_SQL"), ("CALLS", "s.a", "STATIC_SQL")]
    assert edges(spark, "CREATE TABLE s.t AS SELECT * FROM s.u") == []


def test_triggers(spark):
    sql = "CREATE TRIGGER g AFTER UPDATE OF a, b ON s.t FOR EACH ROW EXECUTE PROCEDURE s.f()"
    assert edges(spark, sql) == [("TARGET", "s.t", "STATIC_SQL"), ("CALLS", "s.f", "STATIC_SQL")]
    assert props(spark, sql) == {"trigger_timing": "AFTER", "trigger_events": "UPDATE", "trigger_update_columns": "a,b"}
