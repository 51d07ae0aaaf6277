"""Whole scans of a folder: files to text, statements, objects, edges, catalogue and report."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaquarry.operators import catalog as C
from metaquarry.operators import objects as O
from metaquarry.operators.columns import columns_of
from metaquarry.operators.relations import candidates, properties
from metaquarry.operators.reports import scan_summary, write_report
from metaquarry.operators.statements import kept_statements
from metaquarry.session import cut, dropped_after
from metaquarry.sources import files as S

# Parsers by name: decoded files to read statements. Others can be registered.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"sql_ddl": lambda texts: O.read_objects(kept_statements(texts, "path", "stem"), "path", "stmt_no", system="stem")}


@dataclass
class Scan:
    """The tables of one scan: per file, per object, and their children."""

    files: DataFrame
    objects: DataFrame
    failures: DataFrame
    columns: DataFrame
    properties: DataFrame
    candidates: DataFrame


def scan_files(found: DataFrame, *, strict: bool = False, created_at: Column | None = None) -> Scan:
    """Everything that the files (path, extension, stem, relative_path, content) hold.

    A failing statement discards the objects of its file and makes it a failure; strict raises on
    the first one. Files of other kinds give nothing and no reason."""
    texts = cut(S.decode(found.withColumn("parser", O.dispatch("extension"))))
    read = None
    for name, parse in PARSERS.items():
        part = parse(texts.where((F.col("parser") == name) & (F.col("status") == "ok")))
        read = part if read is None else read.unionByName(part)
    read = cut(read)
    first_error = read.where("error_type is not null").groupBy("path").agg(F.min_by(F.struct("error_type", "error_message"), "stmt_no").alias("e"))
    good = O.objects_only(O.file_outcomes(read), created_at).withColumnRenamed("stmt_no", "seq")
    counts = good.groupBy("path").agg(F.count("*").alias("objects"))
    per_file = texts.drop("text", "content").join(first_error, "path", "left").join(counts, "path", "left")
    failed = F.col("parser").isNotNull() & ((F.col("status") == "failed") | F.col("e").isNotNull())
    per_file = cut(
        per_file.select(
            "path",
            "relative_path",
            F.col("parser"),
            (F.col("parser").isNotNull() & (F.col("status") != "unsupported")).alias("supported"),
            F.when(F.col("parser").isNotNull() & (F.col("status") == "unsupported"), F.col("unsupported_reason")).alias("unsupported_reason"),
            failed.alias("failed"),
            F.coalesce(F.col("e.error_type"), F.when(failed, F.col("error_type"))).alias("error_type"),
            F.coalesce(F.col("e.error_message"), F.when(failed, F.col("error_message"))).alias("error_message"),
            F.coalesce("objects", F.lit(0)).alias("objects"),
        )
    )
    failures = per_file.where("failed").select(F.col("path").alias("absolute_path"), "relative_path", F.lit("SqlDdlParser").alias("parser"), F.lit("parse").alias("stage"), "error_type", "error_message", F.lit(None).cast("string").alias("statement_type"))
    if strict:
        bad = failures.orderBy("absolute_path").first()
        if bad is not None:
            raise ValueError(f"{bad['absolute_path']}: {bad['error_type']}: {bad['error_message']}")
    good = cut(good)
    return Scan(per_file, good, failures, columns_of(good), properties(good), candidates(good, "object_id"))


def run_scan(spark: SparkSession, root: str, catalog: C.Catalog, report: str = "scan-report", *, say: Callable[[str], None] = print) -> int:
    """Scans a folder into the catalogue and writes the report; 1 if there is no such folder."""
    with dropped_after(spark):
        return _run_scan(spark, root, catalog, report, say)


def _run_scan(spark: SparkSession, root: str, catalog: C.Catalog, report: str, say: Callable[[str], None]) -> int:
    began = time.perf_counter()
    try:
        found = S.discover(spark, root)
    except S.FolderNotFound:
        say("Folder not found:")
        say(root)
        return 1
    scan = scan_files(S.with_content(found))
    catalog.migrate()
    ordered = scan.objects.withColumn("seq", F.concat_ws("/", "path", F.lpad(F.col("seq").cast("string"), 9, "0")))
    sorted_out = cut(C.classify(ordered, catalog.read("OBJECT")))
    created = sorted_out.where("outcome = 'created'")
    keep = created.select("object_id")
    catalog.append({"OBJECT": created, "COLUMN": scan.columns.join(keep, "object_id", "left_semi").dropDuplicates(["column_id"]), "PROPERTY": scan.properties.join(keep, "object_id", "left_semi").dropDuplicates(["property_id"])})
    stored = sorted_out.where("outcome <> 'failed'").select("object_id", "system_name").dropDuplicates(["object_id"])
    catalog.create_relations(scan.candidates, stored)
    counts = C.outcome_counts(sorted_out).first()
    total = scan_summary(scan.files.withColumns({"created": F.lit(0).cast("long"), "skipped": F.lit(0).cast("long")})).first().asDict() | {"objects_created": counts["objects_created"], "elapsed_seconds": time.perf_counter() - began}
    # Reports list failures one by one, as the files on the driver's disk are meant to be read.
    where = write_report(total, [r.asDict() for r in scan.failures.orderBy("absolute_path").toLocalIterator()], report)
    say("Done.")
    say("")
    say(f"Files scanned    : {total['files_scanned']}")
    say(f"Files supported  : {total['files_supported']}")
    say(f"Files unsupported: {total['files_unsupported']}")
    reasons = [r[0] for r in scan.files.where("unsupported_reason is not null").select("unsupported_reason").distinct().orderBy("unsupported_reason").collect()]
    if reasons:
        say("Unsupported reason: " + ", ".join(reasons))
    say(f"Files failed     : {total['files_failed']}")
    say(f"Objects created  : {counts['objects_created']}")
    say(f"Objects skipped  : {counts['objects_skipped']}")
    say(f"Objects failed   : {counts['objects_failed']}")
    say("Files with multiple objects:")
    several = scan.files.where("objects > 1").orderBy("path").select("path", "objects")
    some = False
    for r in several.toLocalIterator():
        some = True
        say(f"  {r['path']} : {r['objects']} objects")
    if not some:
        say("  None")
    say(f"Report written to: {where}")
    say("")
    say("Success.")
    return 0


def run_pipeline(spark: SparkSession, root: str, catalog: C.Catalog) -> dict[str, int]:
    """The minimal way: each SQL file is one text, read as UTF-8 and stored without a check for
    what is there and without edges. Gives files_scanned, files_parsed, objects_created."""
    found = S.discover(spark, root)
    texts = S.decode(S.with_content(found)).where((F.lower("extension") == ".sql") & (F.col("status") == "ok"))
    read = O.read_objects(texts, "path", system="stem", sql="text")
    good = cut(O.objects_only(read))
    catalog.migrate()
    catalog.append({"OBJECT": good, "COLUMN": columns_of(good), "PROPERTY": properties(good)})
    return {"files_scanned": found.count(), "files_parsed": texts.count(), "objects_created": good.count()}
