"""Deployment scripts made of the rows of `part`, to run the extraction over a table of any size.

Spark reads the scripts; the SQL it is checked against never sees them and derives what they hold
from the key alone. The kind of a script is p_partkey % 7: table, view, materialized view,
function, T-SQL procedure, trigger, or nothing to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaquarry.operators import objects as O
from metaquarry.operators import statements as S
from metaquarry.session import table

_N = lambda letter, shift=0: f"concat('s', pmod(k, 10), '.{letter}_', k{shift:+d})" if shift else f"concat('s', pmod(k, 10), '.{letter}_', k)"

TABLE_SQL = f"""concat('CREATE TABLE ', {_N("t")}, ' (\\n  id INTEGER NOT NULL', if(k % 11 = 0, '', ', -- the; key'), '\\n  code VARCHAR(20) UNIQUE,\\n  qty NUMERIC(', 10 + k % 5, ',2) DEFAULT 0,\\n  made TIMESTAMP(6) DEFAULT CURRENT_TIMESTAMP,\\n  CONSTRAINT pk_', k, ' PRIMARY KEY (id)\\n)')"""
DISTRIBUTION = "case k % 4 when 0 then '' when 1 then ' DISTRIBUTED BY (id)' when 2 then ' DISTRIBUTED RANDOMLY' else ' DISTRIBUTE BY (id)' end"
REPLACE = "if(k % 2 = 0, 'OR REPLACE ', '')"
MAIN = f"""case k % 7
  when 0 then concat({TABLE_SQL}, {DISTRIBUTION}, ';')
  when 1 then concat('CREATE ', {REPLACE}, 'VIEW ', {_N("v")}, ' AS SELECT a.x FROM ', {_N("t", -1)}, ' a JOIN ', {_N("t", 6)}, ' b ON a.x = b.x WHERE a.y <> ''p;q'';')
  when 2 then concat('CREATE MATERIALIZED VIEW ', {_N("m")}, ' AS SELECT x FROM ', {_N("t", -2)}, ';')
  when 3 then concat('CREATE ', {REPLACE}, 'FUNCTION ', {_N("f")}, '(p int) RETURNS int AS $$ BEGIN PERFORM ', {_N("f", 7)}, '(1); RETURN (SELECT max(x) FROM ', {_N("t", -3)}, '); END; $$ LANGUAGE plpgsql;')
  when 4 then concat('GO\\nCREATE OR ALTER PROCEDURE [s', pmod(k, 10), '].[p_', k, '] @a int AS BEGIN ', case k % 3
      when 0 then concat('INSERT INTO ', {_N("t", -4)}, ' (x) SELECT x FROM ', {_N("t", 3)}, ' EXEC ', {_N("p", 7)})
      when 1 then concat('EXEC(''SELECT x FROM ', {_N("t", 3)}, ''')') else 'EXEC(@a + @b)' end, ' END\\nGO\\n')
  when 5 then concat('CREATE TRIGGER g_', k, ' BEFORE INSERT OR UPDATE OF a, b ON ', {_N("t", -5)}, ' FOR EACH ROW EXECUTE FUNCTION ', {_N("f", -2)}, '();')
  else concat('INSERT INTO ', {_N("t", -6)}, ' VALUES (1);\\nCREATE INDEX i_', k, ' ON ', {_N("t", -6)}, ' (x);') end"""
SCRIPT = f"""concat(case k % 4 when 0 then '' when 1 then '-- note; on parts\\n' when 2 then '/* block; it''s */\\n' else '\\\\echo part; one\\n' end,
  if(k % 3 = 0, concat('DROP TABLE IF EXISTS ', {_N("old")}, ';\\n'), ''), {MAIN}, '\\n',
  if(k % 5 = 0, concat('CREATE VIEW ', {_N("w")}, ' AS SELECT 1 AS one;\\n'), ''))"""


def scripts(spark: SparkSession, d: str) -> DataFrame:
    """(k, path, stem, text): one script per part."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    return parts.select("k", F.expr("concat('/repo/', k % 9, '/part_', k, '.sql')").alias("path"), F.expr("concat('part_', k)").alias("stem"), F.expr(SCRIPT).alias("text"))


def read(spark: SparkSession, d: str) -> DataFrame:
    """What each kept statement of each script creates."""
    return O.read_objects(S.kept_statements(scripts(spark, d), "k", "path", "stem"), "k", "path", "stmt_no", system="stem")


def objects(spark: SparkSession, d: str) -> DataFrame:
    """The objects of all scripts without a failing statement."""
    return O.objects_only(O.file_outcomes(read(spark, d)), F.lit("2024-01-01").cast("timestamp"))


# The same objects from the keys: k, seq, object_type, qualified_name, name, broken.
EXPECTED = """
WITH p AS (SELECT p_partkey k, 's' || (p_partkey % 10) s FROM part),
a AS (
  SELECT k, s, 1 AS seq, CASE k % 7 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'MATERIALIZED_VIEW' WHEN 3 THEN 'FUNCTION' WHEN 4 THEN 'PROCEDURE' WHEN 5 THEN 'TRIGGER' END AS object_type,
    CASE k % 7 WHEN 0 THEN 't_' WHEN 1 THEN 'v_' WHEN 2 THEN 'm_' WHEN 3 THEN 'f_' WHEN 4 THEN 'p_' WHEN 5 THEN 'g_' END || k AS name, k % 7 = 0 AND k % 11 = 0 AS broken
  FROM p WHERE k % 7 < 6
  UNION ALL SELECT k, s, CASE WHEN k % 7 = 6 THEN 1 ELSE 2 END, 'VIEW', 'w_' || k, k % 7 = 0 AND k % 11 = 0 FROM p WHERE k % 5 = 0
), o AS (
  SELECT k, seq, object_type, CASE WHEN object_type = 'TRIGGER' THEN name ELSE s || '.' || name END AS qualified_name, name, s FROM a WHERE NOT broken
)"""


# The same steps over the SQL files themselves, for DuckDB: f(file_id, stem, c), t(file_id, stem, ss)
# with the statements of each file, k with those that create or alter an object. DuckDB's patterns
# know no references, so the tags of dollar quotes that the files hold are named one by one.
_TAGS = ("", "body", "fn")
_PARTS = ["[^;'\"$/-]+", "--[^\\r\\n]*", "/\\*(?s:.*?)(?:\\*/|\\z)", "'(?:[^'\\\\]|''|\\\\(?s:.)|\\\\\\z)*(?:'|\\z)", '"(?:[^"]|"")*(?:"|\\z)', *[f"\\${t}\\$(?s:.*?)(?:\\${t}\\$|\\z)" for t in _TAGS], "[-/$]"]
_BLANK = "[\\s\\x0b\\x1c-\\x1f\\x85\\x{A0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, {quoted(f'^{_BLANK}+|{_BLANK}+$')}, '', 'g')"


_NAME = "regexp_extract(relative_path, '([^/]*)$', 1)"
FILE_STATEMENTS = f"""
WITH f AS (SELECT DISTINCT file_id, CASE WHEN {_NAME} LIKE '_%.%' THEN regexp_replace({_NAME}, '\\.[^.]+$', '') ELSE {_NAME} END AS stem, content AS c FROM source_file WHERE lower(relative_path) LIKE '%.sql' AND content IS NOT NULL),
b AS (SELECT file_id, stem, regexp_split_to_array(regexp_replace(c, {quoted("(?m)" + S.META[5:])}, '', 'g'), {quoted("(?im)" + S.BATCH[6:])}) AS bs FROM f),
s AS (SELECT file_id, stem, flatten(list_transform(bs, lambda x: regexp_extract_all(x, {quoted(f"(?:{'|'.join(_PARTS)})+;?|;")}))) AS ss FROM b),
t AS (SELECT file_id, stem, list_filter(list_transform(ss, lambda x: {_stripped("regexp_replace(x, '^\\x{FEFF}+', '')")}), lambda x: x <> '') AS ss FROM s),
w AS (SELECT file_id, stem, list_transform(ss, lambda x: regexp_replace(regexp_replace(x, '^\\x{{FEFF}}+', ''), {quoted(f"^(?:{_BLANK}|--[^{chr(92)}n]*{chr(92)}n|/{chr(92)}*(?s:.*?){chr(92)}*/)+")}, '')) AS ss FROM t),
k AS (SELECT file_id, stem, list_filter(list_transform(ss, lambda x: CASE WHEN x LIKE '--%' OR x LIKE '/*%' THEN '' ELSE {_stripped("x")} END), lambda x: regexp_matches(x, {quoted("(?i)" + S.CREATES[5:])}) AND NOT regexp_matches(x, {quoted("(?i)" + S.TEMPORARY[5:])})) AS ss FROM w)"""
_RE2 = lambda p: quoted("(?i)" + p.removeprefix("(?iU)"))
_FIRST = lambda what, stop: f"regexp_replace(regexp_extract(x, {quoted(f'(?i)^{chr(92)}s*CREATE{chr(92)}s+{what}{chr(92)}s+([^{chr(92)}s{stop}]+)')}, 1), '^\"+|\"+$', '', 'g')"
# o: what each kept statement creates, but for plain tables.
FILE_OBJECTS = (
    FILE_STATEMENTS
    + f""",
u AS (SELECT file_id, stem, unnest(range(1, len(ss) + 1))::INTEGER AS stmt_no, unnest(ss) AS x FROM k),
r AS (SELECT *, upper(regexp_extract(x, {_RE2(O.TSQL)}, 1)) AS kind, regexp_extract(x, {_RE2(O.TSQL)}, 2) AS raw, kind <> '' AND regexp_matches(x, {_RE2(O.TSQL_EVIDENCE)}) AS tsql FROM u),
n AS (SELECT *, CASE WHEN tsql THEN CASE kind WHEN 'PROC' THEN 'PROCEDURE' ELSE kind END WHEN regexp_matches(x, {_RE2(O.REPLACEABLE["FUNCTION"])}) THEN 'FUNCTION' WHEN regexp_matches(x, {_RE2(O.REPLACEABLE["PROCEDURE"])}) THEN 'PROCEDURE'
    WHEN regexp_matches(x, {_RE2(O.REPLACEABLE["TRIGGER"])}) THEN 'TRIGGER' WHEN regexp_matches(x, {_RE2(O.MATERIALIZED)}) THEN 'MATERIALIZED_VIEW' WHEN regexp_matches(x, {_RE2(O.TABLE_NAME)}) OR regexp_matches(x, {_RE2(O.TABLE_START)}) THEN 'TABLE'
    WHEN regexp_matches(x, {_RE2(O.VIEW_NAME)}) AND regexp_matches(x, {_RE2(O.VIEW_BODY)}) THEN 'VIEW' END AS object_type FROM r),
q AS (SELECT *, CASE WHEN tsql THEN array_to_string(list_transform(string_split(raw, '.'), lambda y: regexp_replace({_stripped("y")}, '^[\\[\\]]+|[\\[\\]]+$', '', 'g')), '.')
    WHEN object_type = 'MATERIALIZED_VIEW' THEN {_FIRST("MATERIALIZED" + chr(92) + "s+VIEW", "(")} WHEN object_type = 'TRIGGER' THEN {_FIRST("(?:OR" + chr(92) + "s+REPLACE" + chr(92) + "s+)?TRIGGER", "")}
    WHEN object_type = 'VIEW' THEN regexp_replace(regexp_extract(x, {_RE2(O.VIEW_NAME)}, 1), '\\s*\\.\\s*', '.', 'g') ELSE {_FIRST("(?:OR" + chr(92) + "s+REPLACE" + chr(92) + "s+)?(?:FUNCTION|PROCEDURE)", "(")} END AS qualified_name FROM n WHERE object_type <> 'TABLE' OR tsql),
o AS (SELECT file_id, stmt_no, object_type, stem AS system_name, qualified_name, CASE WHEN tsql THEN regexp_extract(qualified_name, '([^.]*)$', 1) WHEN object_type = 'TRIGGER' THEN regexp_replace(regexp_extract(qualified_name, '([^.]*)$', 1), '^[\"\\[\\]]+|[\"\\[\\]]+$', '', 'g') ELSE regexp_replace(regexp_extract(qualified_name, '([^.]*)$', 1), '^\"+|\"+$', '', 'g') END AS name, x FROM q WHERE qualified_name <> '')"""
)
