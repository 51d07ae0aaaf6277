"""Entities of the catalogue as Spark schemas, and their sets of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The categories of the catalogue. Types of objects and relations may be others, too.
OBJECT_TYPES = ("TABLE", "VIEW", "MATERIALIZED_VIEW", "FUNCTION", "PROCEDURE", "TRIGGER", "WORKFLOW", "SESSION", "MAPPING", "FILE", "DIRECTORY")
OBJECT_STATUS = ("ACTIVE", "DEPRECATED", "DELETED", "UNKNOWN")
RELATION_TYPES = ("READS", "WRITES", "CALLS", "LOOKUP", "IMPORTS", "EXPORTS", "EXECUTES", "DEPENDS_ON", "BELONGS_TO", "GENERATES", "TARGET")
SCAN_STATUS = ("PENDING", "RUNNING", "SUCCESS", "FAILED", "CANCELLED")
DETECTION_METHODS = ("NAME", "COMMENT", "REGEX", "SAMPLE", "AI")

FILE = "path string, name string, extension string, stem string, relative_path string, length long, modified_at timestamp"
OBJECT = "object_id string, object_type string, system_name string, qualified_name string, name string, display_name string, description string, owner_name string, status string, created_at timestamp, updated_at timestamp"
COLUMN = "column_id string, object_id string, column_name string, ordinal_position int, datatype string, nullable boolean, default_value string, is_primary_key boolean, is_unique boolean"
PROPERTY = "property_id string, object_id string, property_name string, property_value string"
CANDIDATE = "source_qualified_name string, target_qualified_name string, relation_type string, source_type string, evidence_sql string"
RELATION = "relation_id string, from_object_id string, to_object_id string, relation_type string, source_type string, created_at timestamp"
COLUMN_RELATION = "relation_id string, source_column_id string, target_column_id string, transformation string"
VERSION = "version_id string, object_id string, version_number int, hash_value string, source_location string, created_at timestamp, is_current boolean"
JOB = "scan_job_id string, scanner_name string, started_at timestamp, finished_at timestamp, status string"
TARGET = "target_id string, scan_job_id string, target_type string, target_path string, hash_value string, changed boolean"
RESULT = "result_id string, scan_job_id string, object_count long, relation_count long, warning_count long, error_count long"
TAG = "tag_id string, name string, description string"
OBJECT_TAG = "object_id string, tag_id string"
PII_RULE = "rule_id string, category string, rule_type string, pattern string, priority int, enabled boolean"
PII_RESULT = "result_id string, column_id string, category string, confidence double, detection_method string"
FAILURE = "absolute_path string, relative_path string, parser string, stage string, error_type string, error_message string, statement_type string"

TABLES = {"OBJECT": OBJECT, "COLUMN": COLUMN, "PROPERTY": PROPERTY, "RELATION": RELATION, "COLUMN_RELATION": COLUMN_RELATION, "VERSION": VERSION, "SCAN_JOB": JOB, "SCAN_TARGET": TARGET, "SCAN_RESULT": RESULT, "TAG": TAG, "OBJECT_TAG": OBJECT_TAG, "PII_RULE": PII_RULE, "PII_RESULT": PII_RESULT}


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def natural_id(*parts: Column | str) -> Column:
    """A UUID text made of the md5 of the natural key, so that ids repeat from run to run."""
    h = F.md5(F.concat_ws("\u0001", *parts))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def complete_identity() -> Column:
    """The names that an object must have."""
    return (F.coalesce("system_name", F.lit("")) != "") & (F.coalesce("qualified_name", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "")
