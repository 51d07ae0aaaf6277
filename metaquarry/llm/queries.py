"""Queries of the text problems and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metaquarry.llm import encoding, formatdup, mix, parsing, pieces, tokens
from metaquarry.session import table


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    objects = encoding.garbled_texts(table(spark, d, "emip_object"), "object_id", "description", "emip_object")
    return objects.unionByName(encoding.garbled_texts(table(spark, d, "failed_file"), "failure_id", "error_type", "failed_file"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    objects = encoding.garbled_keys(table(spark, d, "emip_object"), "object_id", "description", "emip_object")
    return objects.unionByName(encoding.garbled_keys(table(spark, d, "failed_file"), "failure_id", "error_type", "failed_file"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.broken_files(table(spark, d, "source_file"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.broken_rates(table(spark, d, "source_file"))


def p4_report_gaps(spark: SparkSession, d: str) -> DataFrame:
    return parsing.report_gaps(table(spark, d, "source_file"), table(spark, d, "failed_file"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.duplicate_pairs(table(spark, d, "emip_object"))


def p7_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.collapse(table(spark, d, "emip_object"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix_plan(table(spark, d, "documents"), table(spark, d, "source_target"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix_plan(table(spark, d, "documents"), table(spark, d, "source_target"))[1]


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "documents"), table(spark, d, "split_limit"))


_CANON = """
WITH o AS (SELECT DISTINCT object_id, system_name, object_type, qualified_name q, name n FROM emip_object),
k AS (
  SELECT *, lower(upper(regexp_replace(n, '[^\\p{L}\\p{N}]', '', 'g'))) cn,
    CASE WHEN regexp_matches(q, '^[^\\p{L}\\p{N}=:]*[\\p{L}_][\\p{L}\\p{N}_ ]*\\s*(=|:[^:])') THEN
      (SELECT string_agg(f, chr(2) ORDER BY f) FROM (
        SELECT lower(regexp_replace(regexp_extract(x, '^([^=:]*)', 1), '[^\\p{L}\\p{N}]', '', 'g')) || chr(1) || lower(regexp_replace(regexp_replace(x, '^[^=:]*', ''), '[^\\p{L}\\p{N}]', '', 'g')) f
        FROM unnest(regexp_split_to_array(q, '[;,|\\n]')) u(x) WHERE regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g') <> ''))
    ELSE lower(upper(regexp_replace(q, '[^\\p{L}\\p{N}]', '', 'g'))) END cq
  FROM o
)"""

ORACLES = {
    "p7_found": _CANON
    + """ SELECT a.object_id AS object_id_a, b.object_id AS object_id_b FROM k a JOIN k b
  ON a.system_name = b.system_name AND a.object_type = b.object_type AND a.cn = b.cn AND a.cq = b.cq AND a.object_id < b.object_id""",
    "p7_collapsed": _CANON
    + """, r AS (SELECT object_id, count(*) c FROM emip_object GROUP BY object_id),
g AS (SELECT min(k.object_id) object_id, count(*) n_copies, sum(r.c)::BIGINT n_rows FROM k JOIN r USING (object_id) GROUP BY system_name, object_type, cn, cq)
SELECT g.object_id, k.system_name, k.object_type, k.q AS qualified_name, k.n AS name, g.n_copies, g.n_rows FROM g JOIN k USING (object_id)""",
}

QUERIES = {f.__name__: f for f in (p3_found, p3_restored, p4_found, p4_rates, p4_report_gaps, p7_found, p7_collapsed, p8_ids, p9_mix, p9_shares, p10_pieces)}
