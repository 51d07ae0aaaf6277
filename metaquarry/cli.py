"""Command line: scan FOLDER."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from metaquarry.operators.catalog import Catalog
from metaquarry.plans.pipeline import run_scan


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m metaquarry")
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="scan a folder of SQL scripts into the catalogue")
    scan.add_argument("folder")
    scan.add_argument("--catalog", default="catalog", help="folder of the catalogue's tables")
    scan.add_argument("--report", default="scan-report", help="folder of the reports")
    args = parser.parse_args(argv)
    session = spark or SparkSession.builder.appName("metaquarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return run_scan(session, args.folder, Catalog(session, args.catalog), args.report)
