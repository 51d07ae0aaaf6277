"""Properties and relation candidates that the text of an object shows, all by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaquarry.functions import strip
from metaquarry.schemas import natural_id

# The patterns of names, of dynamic SQL, of phrases that refer to an object, and of
# trigger clauses, and the words that are no target.
NAME = '(?:\\[[^\\]]+\\]|"[^" ]+"|[A-Za-z_#][\\w$#@]*)'
REFERENCE = f"({NAME}(?:\\s*\\.\\s*{NAME}){{0,2}})"
DYNAMIC = "(?iU)\\b(?:EXEC(?:UTE)?\\s*\\(|EXECUTE\\s+IMMEDIATE\\b|EXECUTE\\s+['\"]|sp_executesql\\b|EXECUTE\\s+[^'\"\\s]+\\s*\\+)"
LITERAL_CALL = "(?isU)\\b(?:EXEC|EXECUTE)\\s*\\(\\s*(['\"])(.*?)\\1\\s*\\)"
LITERAL_WORD = "(?isU)\\bEXECUTE\\s+(['\"])(.*?)\\1\\s*;?"
ASSIGNED = "(?isU)\\b(?:DECLARE\\s+)?@([A-Za-z_][\\w$]*)\\b(?:\\s+[^=;]+)?\\s*=\\s*(['\"])(.*?)\\2\\s*;"
CALLED_VARIABLE = "(?iU)\\bEXEC(?:UTE)?\\s*\\(\\s*@([A-Za-z_][\\w$]*)\\s*\\)"
PHRASES = {
    "from": f"(?isU)\\bFROM\\s+{REFERENCE}",
    "join": f"(?isU)\\bJOIN\\s+{REFERENCE}",
    "write": f"(?isU)\\b(?:INSERT\\s+INTO|UPDATE\\s+(?!ON\\b)|DELETE\\s+FROM|MERGE\\s+INTO)\\s+{REFERENCE}",
    "write_mended": f"(?isU)\\b(?:INSERT\\s+INTO|UPDATE(?!\\s+ON\\b)|DELETE\\s+FROM|MERGE\\s+INTO)\\s+{REFERENCE}",
    "on": f"(?isU)\\bON\\s+{REFERENCE}",
    "call": f"(?isU)\\b(?:CALL|PERFORM|EXEC(?:UTE)?(?:\\s+(?:FUNCTION|PROCEDURE))?)\\s+{REFERENCE}",
    "applied": f"(?isU)\\b({NAME}\\s*\\.\\s*{NAME})\\s*\\(",
}
NOT_TARGETS = ("SELECT", "VALUES", "DUAL")
EVENT_WORDS = "(?iU)\\b(INSERT|UPDATE|DELETE|TRUNCATE)\\b"
TIMING_WORDS = "(?iU)\\b(BEFORE|AFTER|INSTEAD\\s+OF)\\b"
UPDATE_OF = "(?isU)\\bUPDATE\\s+OF\\s+(.+?)\\s+ON\\b"


def clean_reference(c: Column) -> Column:
    """A dotted name without blanks, brackets and quotes around its parts."""
    return F.array_join(F.transform(F.split(c, "\\."), lambda p: F.regexp_replace(strip(p), '^[\\[\\]"]+|[\\[\\]"]+$', "")), ".")


def resolved_sql(sql: Column | str) -> Column:
    """The constant text that dynamic SQL executes, or null."""
    s = F.col(sql) if isinstance(sql, str) else sql
    literal = F.when(s.rlike(LITERAL_CALL), F.regexp_extract(s, LITERAL_CALL, 2)).when(s.rlike(LITERAL_WORD), F.regexp_extract(s, LITERAL_WORD, 2))
    names = F.transform(F.regexp_extract_all(s, F.lit(ASSIGNED), F.lit(1)), F.lower)
    values = F.regexp_extract_all(s, F.lit(ASSIGNED), F.lit(3))
    wanted = F.lower(F.regexp_extract(s, CALLED_VARIABLE, 1))
    # The last assignment of the variable counts.
    at = F.array_position(F.reverse(names), wanted)
    value = F.when((wanted != "") & (at > 0), F.try_element_at(F.reverse(values), at.cast("int")))
    return F.coalesce(literal, value)


def with_texts(objects: DataFrame) -> DataFrame:
    """Adds is_dynamic, resolved, relation_sql and source_type."""
    o = objects.withColumn("is_dynamic", F.col("sql").rlike(DYNAMIC)).withColumn("resolved", resolved_sql("sql"))
    use = F.col("is_dynamic") & F.col("resolved").isNotNull()
    return o.withColumns({"relation_sql": F.when(use, F.col("resolved")).otherwise(F.col("sql")), "source_type": F.when(use, "RESOLVED_DYNAMIC_SQL").otherwise("STATIC_SQL")})


def candidates(objects: DataFrame, *keys: str, strict_compat: bool = True) -> DataFrame:
    """(keys, seq, source_qualified_name, target_qualified_name, relation_type, source_type,
    evidence_sql): what each object reads, writes, calls and triggers on, in order of first mention,
    each once. Names in comments and strings count. strict_compat=False also sees an UPDATE with
    a single blank before the name. An object without a reference gives no row."""
    o = with_texts(objects)
    t, s = F.col("object_type"), F.col("relation_sql")
    reads = t.isin("VIEW", "MATERIALIZED_VIEW", "FUNCTION", "PROCEDURE")
    writes = t.isin("PROCEDURE", "TRIGGER")
    calls = t.isin("FUNCTION", "PROCEDURE", "TRIGGER")
    none = F.array().cast("array<string>")

    def found(phrase: str, kind: str, when: Column) -> Column:
        hits = F.when(when, F.regexp_extract_all(s, F.lit(PHRASES[phrase]), F.lit(1))).otherwise(none)
        return F.transform(hits, lambda x: F.struct(clean_reference(x).alias("target"), F.lit(kind).alias("kind")))

    every = F.concat(
        found("from", "READS", reads),
        found("join", "READS", reads),
        found("write" if strict_compat else "write_mended", "WRITES", writes),
        found("on", "TARGET", t == "TRIGGER"),
        found("call", "CALLS", calls),
        found("applied", "CALLS", calls),
    )
    own = F.upper("qualified_name")
    wanted = F.array_distinct(F.filter(every, lambda x: ~F.upper(x["target"]).isin(*NOT_TARGETS) & (F.upper(x["target"]) != own)))
    return (
        o.select(*keys, "qualified_name", "source_type", "relation_sql", F.posexplode(wanted).alias("seq", "c"))
        .select(*keys, (F.col("seq") + 1).alias("seq"), F.col("qualified_name").alias("source_qualified_name"), F.col("c.target").alias("target_qualified_name"), F.col("c.kind").alias("relation_type"), "source_type", F.col("relation_sql").alias("evidence_sql"))
    )


def properties(objects: DataFrame, *keys: str) -> DataFrame:
    """(keys, property_id, object_id, property_name, property_value) of dynamic SQL and triggers.

    An object without such a trait gives no row."""
    o = with_texts(objects)
    s, trigger = F.col("sql"), F.col("object_type") == "TRIGGER"
    prop = lambda name, value, when: F.when(when & value.isNotNull(), F.struct(F.lit(name).alias("property_name"), value.alias("property_value")))
    events = F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(EVENT_WORDS), F.lit(1)), F.upper))
    items = F.transform(F.split(F.regexp_extract(s, UPDATE_OF, 1), ","), lambda x: clean_reference(strip(x)))
    listed = s.rlike(UPDATE_OF) & F.forall(items, lambda x: x.rlike(f"(?iU)^{NAME}\\z"))
    found = F.array_compact(
        F.array(
            prop("contains_dynamic_sql", F.lit("true"), F.col("is_dynamic")),
            prop("dynamic_sql_source", s, F.col("is_dynamic")),
            prop("dynamic_sql_status", F.when(F.col("resolved").isNotNull(), "RESOLVED").otherwise("UNRESOLVED"), F.col("is_dynamic")),
            prop("trigger_timing", F.upper(F.regexp_extract(s, TIMING_WORDS, 1)), trigger & s.rlike(TIMING_WORDS)),
            prop("trigger_events", F.array_join(events, ","), trigger & (F.size(events) > 0)),
            prop("trigger_update_columns", F.array_join(items, ","), trigger & listed),
        )
    )
    p = o.select(*keys, "object_id", F.explode(found).alias("p")).select(*keys, "object_id", "p.*")
    return p.select(*keys, natural_id("object_id", "property_name").alias("property_id"), "object_id", "property_name", "property_value")
