"""Reports on scans: summaries, failures by cause and signature, coverage and funnels."""

from __future__ import annotations

import csv
import json
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaquarry.functions import percent

FAILURE_FIELDS = ("relative_path", "parser", "stage", "error_type", "error_message")
RULE = "=" * 49


def scan_summary(files: DataFrame) -> DataFrame:
    """One row of counts from file rows: supported, unsupported_reason, failed, objects, created,
    skipped. Only files with a reason count as unsupported; failed files are supported, too."""
    ok = F.col("unsupported_reason").isNull()
    return files.agg(
        F.count("*").alias("files_scanned"),
        F.count_if(ok & F.col("supported")).alias("files_supported"),
        F.count_if(~ok).alias("files_unsupported"),
        F.count_if(ok & F.col("failed")).alias("files_failed"),
        F.coalesce(F.sum("created"), F.lit(0)).alias("objects_created"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("objects_skipped"),
        F.count_if(F.col("objects") > 1).alias("files_with_several_objects"),
    )


def root_causes(rows: DataFrame, causes: list[tuple[str, Column]], other: str = "OTHER") -> DataFrame:
    """(cause, n, pct, rank): the first cause that applies, ranked by number, then name."""
    cause = F.lit(other)
    for name, when in reversed(causes):
        cause = F.when(when, name).otherwise(cause)
    g = rows.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per cause
    return g.select("cause", "n", percent(F.col("n"), total).alias("pct"), F.row_number().over(Window.orderBy(F.desc("n"), "cause")).alias("rank"))


def signatures(rows: DataFrame, found: dict[str, Column]) -> DataFrame:
    """(signature, n): rows that show each signature; a row may show several. One pass."""
    one = rows.agg(*[F.count_if(c).alias(f"s{i}") for i, c in enumerate(found.values())])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("signature"), F.col(f"s{i}").alias("n")) for i, n in enumerate(found)])))


def top(rows: DataFrame, what: Column, name: str, n: int = 20) -> DataFrame:
    """The n most frequent values, a report; ties by value."""
    return rows.groupBy(what.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first(name)).limit(n)


def coverage(objects: DataFrame, repository: str, kinds: tuple[str, ...]) -> DataFrame:
    """One row per repository and one for all (null), with the number of objects of each kind."""
    return objects.rollup(repository).agg(*[F.count_if(F.col("object_type") == k).alias(k.lower()) for k in kinds], F.count("*").alias("total"))


def funnel(files: DataFrame, repository: str) -> DataFrame:
    """Per repository: discovered, ignored, scanned, supported, unsupported, failed, objects."""
    seen = ~F.col("ignored")
    return files.groupBy(repository).agg(
        F.count("*").alias("discovered"),
        F.count_if("ignored").alias("ignored"),
        F.count_if(seen).alias("scanned"),
        F.count_if(seen & F.col("supported")).alias("supported"),
        F.count_if(seen & F.col("unsupported_reason").isNotNull()).alias("unsupported"),
        F.count_if(seen & F.col("failed")).alias("failed"),
        F.coalesce(F.sum(F.when(seen, F.col("objects"))), F.lit(0)).alias("objects"),
    )


def write_report(summary: dict, failures: list[dict], folder: str = "scan-report") -> str:
    """summary.json, failed-files.csv and failed-files.log of one scan, as small local files.

    The header of the table is written without failures, too; the log is empty then."""
    os.makedirs(folder, exist_ok=True)
    keys = ("files_scanned", "files_supported", "files_failed", "objects_created")
    values = {k: int(summary[k]) for k in keys} | {"elapsed_seconds": round(float(summary["elapsed_seconds"]), 3)}
    with open(os.path.join(folder, "summary.json"), "w", encoding="utf-8") as f:
        f.write(json.dumps(values, indent=2) + "\n")
    with open(os.path.join(folder, "failed-files.csv"), "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(FAILURE_FIELDS)
        w.writerows([x[k] for k in FAILURE_FIELDS] for x in failures)
    with open(os.path.join(folder, "failed-files.log"), "w", encoding="utf-8") as f:
        f.write("\n\n".join(failure_block(x) for x in failures) + ("\n" if failures else ""))
    return folder


def failure_block(x: dict) -> str:
    labels = (("Absolute path", "absolute_path"), ("Parser", "parser"), ("Stage", "stage"), ("Exception", "error_type"))
    lines = [RULE, x["relative_path"], *[f"{a}: {x[b]}" for a, b in labels], f"Statement type: {x.get('statement_type') or 'Unknown'}", f"Message: {x['error_message']}", RULE]
    return "\n".join(lines)


def block_of() -> Column:
    """The block of the log for a failure row."""
    field = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    return F.concat_ws(
        "\n", F.lit(RULE), "relative_path", field("Absolute path", F.col("absolute_path")), field("Parser", F.col("parser")), field("Stage", F.col("stage")), field("Exception", F.col("error_type")),
        field("Statement type", F.coalesce("statement_type", F.lit("Unknown"))), field("Message", F.col("error_message")), F.lit(RULE),
    )
