"""Columns of CREATE TABLE statements. The only part of extraction that needs Python: nesting."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaquarry.schemas import natural_id

_TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|(?P<s>[eEnN]?'(?:[^']|'')*')|(?P<q>"(?:[^"]|"")*"|\[[^\]]+\]|`[^`]+`)|(?P<d>\$(\w*)\$.*?\$\4\$)|(?P<n>\d+(?:\.\d+)?)|(?P<w>[^\W\d][\w$#@]*)|(?P<o>::|[^\s])""", re.S)
_DISTRIBUTION = re.compile(r"(?is)\bDISTRIBUT(?:ED|E)\s+(?:BY\b|RANDOMLY\b|REPLICATED\b).*?(?=;|\Z)")

# Spellings of types and the names they are reported under.
TYPE_NAMES = {
    "INTEGER": "INT", "INT4": "INT", "INT8": "BIGINT", "INT2": "SMALLINT", "SERIAL": "SERIAL", "NUMERIC": "DECIMAL", "DEC": "DECIMAL", "BOOL": "BOOLEAN",
    "FLOAT4": "FLOAT", "REAL": "FLOAT", "FLOAT8": "DOUBLE", "DOUBLE PRECISION": "DOUBLE", "CHARACTER": "CHAR", "BPCHAR": "CHAR", "CHARACTER VARYING": "VARCHAR",
    "BYTEA": "VARBINARY", "TIMESTAMP WITH TIME ZONE": "TIMESTAMPTZ", "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP", "TIME WITHOUT TIME ZONE": "TIME", "STRING": "TEXT",
}
CALLS = {"CURRENT_TIMESTAMP": "CURRENT_TIMESTAMP()", "CURRENT_DATE": "CURRENT_DATE", "NOW": "CURRENT_TIMESTAMP"}
# Words that begin a rule of a table or of a column.
_TABLE_RULES = {"PRIMARY", "UNIQUE", "FOREIGN", "CHECK", "CONSTRAINT", "LIKE", "EXCLUDE"}
_COLUMN_RULES = {"NOT", "NULL", "DEFAULT", "PRIMARY", "UNIQUE", "REFERENCES", "CHECK", "CONSTRAINT", "GENERATED", "COLLATE", "IDENTITY", "ENCODING", "DEFERRABLE", "INITIALLY", "COMMENT", "ON", "MATCH"}
FIELDS = [("column_name", T.StringType()), ("ordinal_position", T.IntegerType()), ("datatype", T.StringType()), ("nullable", T.BooleanType()), ("default_value", T.StringType()), ("is_primary_key", T.BooleanType()), ("is_unique", T.BooleanType())]
COLUMNS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in FIELDS]))
SHAPE = T.StructType([T.StructField("error", T.StringType()), T.StructField("columns", COLUMNS)])


class BadTable(ValueError):
    pass


def _tokens(sql: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
    return out


def _name(tok: tuple[str, str]) -> str:
    return tok[1][1:-1] if tok[0] == "q" else tok[1]


def _group(toks: list, at: int) -> int:
    """The index behind the parenthesis that closes the one at `at`."""
    depth = 0
    for i in range(at, len(toks)):
        if toks[i] == ("o", "("):
            depth += 1
        elif toks[i] == ("o", ")"):
            depth -= 1
            if not depth:
                return i + 1
    raise BadTable("parenthesis is not closed")


def _render(toks: list) -> str:
    out = ""
    for i, (k, t) in enumerate(toks):
        glue = not out or t in "(),.::" or out[-1] in "(.:" or (k == "o" and t == ")")
        out += t if glue else " " + t
        if t == "," and k == "o" and i + 1 < len(toks):
            out += ""
    return out


def _type(toks: list, at: int) -> tuple[str, int]:
    words = []
    while at < len(toks) and toks[at][0] in "wq" and not (words and toks[at][1].upper() in _COLUMN_RULES):
        words.append(toks[at][1].upper() if toks[at][0] == "w" else toks[at][1])
        at += 1
        while at + 1 < len(toks) and toks[at] == ("o", "."):
            words[-1] += "." + toks[at + 1][1]
            at += 2
        if len(words) == 1 and words[0] not in ("DOUBLE", "CHARACTER", "NATIONAL", "BIT", "TIMESTAMP", "TIME", "INTERVAL"):
            break
    if not words:
        raise BadTable("column without a type")
    args = ""
    if at < len(toks) and toks[at] == ("o", "("):
        end = _group(toks, at)
        inner = [t for _, t in toks[at + 1 : end - 1]]
        args = "(" + "".join(", " if t == "," else t for t in inner) + ")"
        at = end
        rest = [t.upper() for _, t in toks[at : at + 3]]
        if rest in (["WITH", "TIME", "ZONE"], ["WITHOUT", "TIME", "ZONE"]):
            words += rest
            at += 3
    while at < len(toks) and toks[at][1] == "[":
        at += 1
        while at < len(toks) and toks[at][1] != "]":
            at += 1
        at += 1
        args += "[]"
    if at < len(toks) and toks[at] == ("q", "[]"):
        args, at = args + "[]", at + 1
    name = " ".join(words)
    return TYPE_NAMES.get(name, name) + args, at


def _default(toks: list, at: int) -> tuple[str, int]:
    start = at
    while at < len(toks):
        if toks[at] == ("o", "("):
            at = _group(toks, at)
        elif at > start and toks[at][0] == "w" and toks[at][1].upper() in _COLUMN_RULES:
            break
        else:
            at += 1
    if at == start:
        raise BadTable("DEFAULT without a value")
    text = _render(toks[start:at])
    return CALLS.get(text.upper(), text), at


def parse_table(sql: str) -> list[tuple]:
    """The columns of a CREATE TABLE statement. Raises BadTable where it is malformed."""
    toks = _tokens(_DISTRIBUTION.sub("", sql))
    at = next((i for i, t in enumerate(toks) if t == ("o", "(")), None)
    upper = [t.upper() if k == "w" else t for k, t in toks]
    if "TABLE" not in upper:
        raise BadTable("not a table")
    if "AS" in upper[: at if at is not None else len(upper)]:
        return []
    if at is None:
        raise BadTable("no column list")
    end = _group(toks, at)
    if end < len(toks) and upper[end] not in (";", "WITH", "WITHOUT", "PARTITION", "TABLESPACE", "INHERITS", "ON", "AS", "USING", "LOCATION", "FORMAT", "ENCODING", "LOG", "COMMENT", "TEXTIMAGE_ON"):
        raise BadTable(f"unexpected {toks[end][1]!r} behind the column list")
    if end < len(toks):
        depth = 0
        for _, t in toks[end:]:
            depth += (t == "(") - (t == ")")
            if depth < 0:
                raise BadTable("parenthesis too many")
    items, item, depth = [], [], 0
    for tok in toks[at + 1 : end - 1]:
        depth += (tok == ("o", "(")) - (tok == ("o", ")"))
        if tok == ("o", ",") and not depth:
            items.append(item)
            item = []
        else:
            item.append(tok)
    items.append(item)
    columns: list[list] = []
    keys: set[str] = set()
    uniques: set[str] = set()
    for it in items:
        if not it:
            raise BadTable("empty column definition")
        word = it[0][1].upper() if it[0][0] == "w" else ""
        if word in _TABLE_RULES and (word == "CONSTRAINT" or len(it) > 1 and it[1][1].upper() in ("KEY", "(") or word == "LIKE"):
            if word == "CONSTRAINT":
                kinds = [t.upper() for _, t in it]
                where = keys if "PRIMARY" in kinds else uniques if "UNIQUE" in kinds else None
                if where is not None and ("o", "(") in it:
                    a = it.index(("o", "("))
                    where.update(_name(t) for t in it[a + 1 : _group(it, a) - 1] if t[0] in "wq")
            continue
        if it[0][0] not in "wq" or len(it) < 2:
            raise BadTable(f"unexpected {it[0][1]!r}")
        kind, i = _type(it, 1)
        col = [_name(it[0]), len(columns) + 1, kind, True, None, False, False]
        while i < len(it):
            w = it[i][1].upper()
            if w == "CONSTRAINT" and i + 1 < len(it):
                i += 2
            elif w == "NOT" and i + 1 < len(it) and it[i + 1][1].upper() == "NULL":
                col[3] = False
                i += 2
            elif w == "NULL":
                i += 1
            elif w == "DEFAULT":
                col[4], i = _default(it, i + 1)
            elif w == "PRIMARY" and i + 1 < len(it) and it[i + 1][1].upper() == "KEY":
                col[5] = True
                i += 2
            elif w == "UNIQUE":
                col[6] = True
                i += 1
            elif w in _COLUMN_RULES:
                # anything else that belongs to a column is passed over with its arguments
                i += 1
                while i < len(it) and not (it[i][0] == "w" and it[i][1].upper() in _COLUMN_RULES):
                    i = _group(it, i) if it[i] == ("o", "(") else i + 1
            elif w in ("CLUSTERED", "NONCLUSTERED", "SPARSE"):
                i += 1
            else:
                raise BadTable(f"unexpected {it[i][1]!r} in column {col[0]}")
        columns.append(col)
    for col in columns:
        col[5] = col[5] or col[0] in keys
        col[6] = col[6] or col[0] in uniques
        col[3] = col[3] and not col[5]
    return [tuple(c) for c in columns]


@F.pandas_udf(SHAPE)
def table_shape(sql: pd.Series) -> pd.DataFrame:
    """(error, columns) of CREATE TABLE statements; nulls for null, which costs nothing."""
    out = []
    for s in sql:
        if s is None:
            out.append((None, None))
            continue
        try:
            out.append((None, [dict(zip((n for n, _ in FIELDS), c, strict=True)) for c in parse_table(s)]))
        except BadTable as e:
            out.append((str(e), None))
    return pd.DataFrame(out, columns=["error", "columns"])


def columns_of(objects: DataFrame, *keys: str) -> DataFrame:
    """(keys, column_id, object_id and the fields of each column) of objects with their columns."""
    c = objects.select(*keys, "object_id", F.explode("columns").alias("c")).select(*keys, "object_id", "c.*")
    return c.select(*keys, natural_id("object_id", "column_name").alias("column_id"), "object_id", "column_name", "ordinal_position", "datatype", "nullable", "default_value", "is_primary_key", "is_unique")


def distribution_free(sql: Column | str) -> Column:
    """A statement without its distribution clause, the misspelt form included."""
    return F.regexp_replace(sql, "(?is)\\bDISTRIBUT(?:ED|E)\\s+(?:BY\\b|RANDOMLY\\b|REPLICATED\\b).*?(?=;|\\z)", "")
