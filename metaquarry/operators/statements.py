"""Scripts into statements, and the statements that create or alter objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaquarry.functions import strip, strip_bom

# The patterns of lines of the shell psql, and of lines that end a batch.
META = "(?md)^[ \\t]*\\\\[A-Za-z_][^\\r\\n]*(?:\\r?\\n|$)"
BATCH = "(?imd)^[ \\t]*GO[ \\t]*(?:--[^\\r\\n]*)?(?:\\r?\\n|$)"

# What a statement consists of up to its semicolon. Whatever is left open reaches to the end.
_PARTS = (
    "[^;'\"$/-]++",
    "--[^\\r\\n]*+",
    "/\\*(?s:.*?)(?:\\*/|\\z)",
    "'(?:[^'\\\\]|''|\\\\(?s:.)|\\\\\\z)*+(?:'|\\z)",
    '"(?:[^"]|"")*+(?:"|\\z)',
    "\\$((?:[A-Za-z_][A-Za-z0-9_]*)?)\\$(?s:.*?)(?:\\$\\1\\$|\\z)",
    "[-/$]",
)
STATEMENT = f"(?:{'|'.join(_PARTS)})++;?|;"

# The phrases that create or alter an object, and temporary tables.
KINDS = "(?:TABLE|MATERIALIZED\\s+VIEW|VIEW|FUNCTION|PROCEDURE|PROC|TRIGGER)"
CREATES = f"(?iU)(?:CREATE\\s+(?:OR\\s+(?:REPLACE|ALTER))?\\s*|ALTER\\s+){KINDS}\\b"
TEMPORARY = "(?iU)CREATE\\s+(?:OR\\s+ALTER\\s+)?TABLE\\s+#"


def statements_of(script: Column | str) -> Column:
    """The statements of a script in order, as an array. They keep their semicolon."""
    batches = F.split(F.regexp_replace(script, META, ""), BATCH, -1)
    cut = F.flatten(F.transform(batches, lambda b: F.regexp_extract_all(b, F.lit(STATEMENT), F.lit(0))))
    return F.filter(F.transform(cut, lambda s: strip(strip_bom(s))), lambda s: s != "")


def without_leading_comments(statement: Column) -> Column:
    """The statement from its first word on; '' if a comment before it never ends."""
    rest = F.regexp_replace(strip_bom(statement), "(?U)^(?:\\s|--[^\\n]*+\\n|/\\*(?s:.*?)\\*/)++", "")
    return F.when(rest.startswith("--") | rest.startswith("/*"), "").otherwise(strip(rest))


def kept_statements_of(statements: Column) -> Column:
    """Those that create or alter an object, anywhere in them, from their first word on."""
    plain = F.transform(statements, without_leading_comments)
    return F.filter(plain, lambda s: s.rlike(CREATES) & ~s.rlike(TEMPORARY))


def split_scripts(scripts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, stmt_no, statement): each statement of each script, numbered from 1."""
    return scripts.select(*keys, F.posexplode(statements_of(text)).alias("p", "statement")).select(*keys, (F.col("p") + 1).alias("stmt_no"), "statement")


def kept_statements(scripts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, stmt_no, sql): the kept statements, numbered from 1 among themselves. Null and empty
    scripts give no row. No shuffle: a script is split where it is read."""
    return scripts.select(*keys, F.posexplode(kept_statements_of(statements_of(text))).alias("p", "sql")).select(*keys, (F.col("p") + 1).alias("stmt_no"), "sql")
