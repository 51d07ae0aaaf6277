"""Objects that statements create. Names and kinds come from built-in expressions; only the column
lists of tables are read by Python, and only for statements that create a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaquarry.functions import strip
from metaquarry.operators.columns import COLUMNS, table_shape
from metaquarry.schemas import natural_id

# The phrases by which each kind of object is told. TSQL gives kind and name, a name
# of one or two parts, in brackets or bare.
_BRACKETED = "(?:\\[[^\\]]+\\]|[#A-Za-z_][\\w$#@]*)"
TSQL = f"(?iU)\\b(?:CREATE\\s+(?:OR\\s+ALTER\\s+)?|ALTER\\s+)(TABLE|VIEW|FUNCTION|PROCEDURE|PROC)\\s+({_BRACKETED}(?:\\s*\\.\\s*{_BRACKETED})?)"
TSQL_EVIDENCE = "(?iU)\\[|\\b(?:GO|OBJECT_ID|sys\\.|CLUSTERED|NONCLUSTERED|IDENTITY|GRANT)\\b|\\bCREATE\\s+OR\\s+ALTER\\b"
REPLACEABLE = {"FUNCTION": "(?iU)^\\s*CREATE\\s+(?:OR\\s+REPLACE\\s+)?FUNCTION\\b", "PROCEDURE": "(?iU)^\\s*CREATE\\s+(?:OR\\s+REPLACE\\s+)?PROCEDURE\\b", "TRIGGER": "(?iU)^\\s*CREATE\\s+(?:OR\\s+REPLACE\\s+)?TRIGGER\\b"}
MATERIALIZED = "(?iU)^\\s*CREATE\\s+MATERIALIZED\\s+VIEW\\b"
TABLE_START = "(?iU)^\\s*CREATE\\s+(?:OR\\s+REPLACE\\s+)?TABLE\\b"
_PLAIN = '(?:"[^"]+"|[\\w$#@]+)'
TABLE_NAME = f"(?iU)^\\s*CREATE\\s+(?:OR\\s+REPLACE\\s+)?(?:(?:GLOBAL|LOCAL)\\s+)?(?:TEMP(?:ORARY)?\\s+|UNLOGGED\\s+|EXTERNAL\\s+)?TABLE\\s+(?:IF\\s+NOT\\s+EXISTS\\s+)?({_PLAIN}(?:\\s*\\.\\s*{_PLAIN}){{0,2}})"
VIEW_NAME = f"(?iU)^\\s*CREATE\\s+(?:OR\\s+REPLACE\\s+)?(?:TEMP(?:ORARY)?\\s+)?(?:RECURSIVE\\s+)?VIEW\\s+(?:IF\\s+NOT\\s+EXISTS\\s+)?({_PLAIN}(?:\\s*\\.\\s*{_PLAIN}){{0,2}})"
VIEW_BODY = "(?iU)\\bAS\\b\\s*[(]*\\s*(?:SELECT|WITH|VALUES|TABLE)\\b\\s*\\S"

STARTED = "CREATE_FAILED: the statement creates an object but gives no name that can be read."


def _tsql_name(raw: Column) -> Column:
    return F.array_join(F.transform(F.split(raw, "\\."), lambda p: F.regexp_replace(strip(p), "^[\\[\\]]+|[\\[\\]]+$", "")), ".")


def _unquoted(raw: Column) -> Column:
    return F.regexp_replace(raw, '^"+|"+$', "")


def _last(name: Column) -> Column:
    return F.regexp_extract(name, "([^.]*)$", 1)


def read_objects(statements: DataFrame, *keys: str, system: Column | str = "system_name", sql: str = "sql", strict_compat: bool = True) -> DataFrame:
    """One row per statement: keys, object_type, system_name, qualified_name, name, description,
    columns, error_type, error_message. object_type is null where a statement creates no object.

    Kinds are tried in the order T-SQL, function, procedure, trigger, materialized view, table,
    view. T-SQL objects are taken from any place of a text that shows signs of the dialect, with
    the whole text as description and without columns. strict_compat=False mends what that rule
    gets wrong: an array type is no sign of T-SQL, IF NOT EXISTS is no name, and the inner
    statement of a CREATE OR REPLACE is no object. An explicit NULL leaves a column nullable.
    A table that cannot be read is an UnsupportedSqlSyntaxError, another object a ParseError.
    Null statements give a row without object."""
    s = F.col(sql)
    kind, raw = F.upper(F.regexp_extract(s, TSQL, 1)), F.regexp_extract(s, TSQL, 2)
    evidence = s if strict_compat else F.regexp_replace(s, "\\[\\s*\\d*\\s*\\]", "")
    tsql = (kind != "") & evidence.rlike(TSQL_EVIDENCE)
    if not strict_compat:
        tsql = tsql & (F.upper(raw) != "IF") & ~s.rlike("(?iU)^\\s*CREATE\\s+OR\\s+REPLACE\\b")
    first_word = lambda what, stop: _unquoted(F.regexp_extract(s, f"(?iU)^\\s*CREATE\\s+{what}\\s+([^\\s{stop}]+)", 1))
    route = (
        F.when(tsql, F.when(kind == "PROC", "PROCEDURE").otherwise(kind))
        .when(s.rlike(REPLACEABLE["FUNCTION"]), "FUNCTION")
        .when(s.rlike(REPLACEABLE["PROCEDURE"]), "PROCEDURE")
        .when(s.rlike(REPLACEABLE["TRIGGER"]), "TRIGGER")
        .when(s.rlike(MATERIALIZED), "MATERIALIZED_VIEW")
        .when(s.rlike(TABLE_NAME) | s.rlike(TABLE_START), "TABLE")
        .when(s.rlike(VIEW_NAME) & s.rlike(VIEW_BODY), "VIEW")
    )
    r = statements.select(*keys, F.col(system).alias("system_name") if isinstance(system, str) else system.alias("system_name"), s.alias("sql"), tsql.alias("_tsql"), route.alias("_type"))
    s = F.col("sql")
    raw = F.regexp_extract(s, TSQL, 2)
    dotted = lambda p: F.regexp_replace(F.regexp_extract(s, p, 1), "(?U)\\s*\\.\\s*", ".")
    qualified = (
        F.when(F.col("_tsql"), _tsql_name(raw))
        .when(F.col("_type") == "FUNCTION", first_word("(?:OR\\s+REPLACE\\s+)?FUNCTION", "("))
        .when(F.col("_type") == "PROCEDURE", first_word("(?:OR\\s+REPLACE\\s+)?PROCEDURE", "("))
        .when(F.col("_type") == "TRIGGER", first_word("(?:OR\\s+REPLACE\\s+)?TRIGGER", ""))
        .when(F.col("_type") == "MATERIALIZED_VIEW", first_word("MATERIALIZED\\s+VIEW" + ("" if strict_compat else "(?:\\s+IF\\s+NOT\\s+EXISTS)?"), "("))
        .when(F.col("_type") == "TABLE", dotted(TABLE_NAME))
        .when(F.col("_type") == "VIEW", dotted(VIEW_NAME))
    )
    own_table = (F.col("_type") == "TABLE") & ~F.col("_tsql")
    r = r.withColumn("qualified_name", qualified).withColumn("_shape", table_shape(F.when(own_table, s)))
    quotes = F.when(F.col("_type") == "TRIGGER", F.regexp_replace(_last(F.col("qualified_name")), '^["\\[\\]]+|["\\[\\]]+$', "")).when(F.col("_tsql"), _last(F.col("qualified_name"))).otherwise(_unquoted(_last(F.col("qualified_name"))))
    unreadable = F.col("_type").isNotNull() & (F.coalesce("qualified_name", F.lit("")) == "")
    bad_table = own_table & (F.col("_shape.error").isNotNull() | unreadable)
    fine = ~(bad_table | unreadable)
    return r.select(
        *keys,
        F.when(fine, F.col("_type")).alias("object_type"),
        "system_name",
        F.when(fine, F.col("qualified_name")).alias("qualified_name"),
        F.when(fine & F.col("_type").isNotNull(), quotes).alias("name"),
        F.when(fine & F.col("_type").isNotNull() & ~own_table, s).alias("description"),
        F.coalesce(F.when(fine, F.col("_shape.columns")), F.array().cast(COLUMNS)).alias("columns"),
        F.when(bad_table, "UnsupportedSqlSyntaxError").when(unreadable, "ParseError").alias("error_type"),
        F.when(bad_table, F.concat(F.lit("Unsupported CREATE TABLE syntax: "), F.coalesce("_shape.error", F.lit("no table name")))).when(unreadable, STARTED).alias("error_message"),
        "sql",
    )


def objects_only(read: DataFrame, created_at: Column | None = None) -> DataFrame:
    """The objects among read statements, with id, display name, status and times."""
    now = created_at if created_at is not None else F.current_timestamp()
    o = read.where("object_type is not null")
    return o.withColumns({"object_id": natural_id("system_name", "qualified_name"), "display_name": F.col("name"), "owner_name": F.lit(None).cast("string"), "status": F.lit("ACTIVE"), "created_at": now, "updated_at": now})


def file_outcomes(read: DataFrame, file: str = "path") -> DataFrame:
    """The objects of files without any failing statement, with the number of the statement in its
    file. One failure discards all objects of its file; files are windows, bounded by a file."""
    bad = F.max(F.col("error_type").isNotNull()).over(Window.partitionBy(file))
    return read.withColumn("_bad", bad).where("not _bad and object_type is not null").drop("_bad")


def dispatch(extension: Column | str) -> Column:
    """The parser of a file: sql_ddl for .sql in any letter case, else null."""
    return F.when(F.lower(extension) == ".sql", "sql_ddl")
