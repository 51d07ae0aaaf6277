"""Where a catalogue database is: options of Spark's JDBC source, from the session or from a file."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from metaquarry.operators.catalog import Naming

SESSION_PREFIX = "spark.metaquarry.catalog."
# What has to be given, and other names that it goes by.
NEEDED = ("host", "port", "database", "username", "password")
ALIASES = {"pghost": "host", "pgport": "port", "pgdatabase": "database", "pguser": "username", "pgpassword": "password", "user": "username"}
_SETTING = re.compile(r"""^\s*(?:\$env:|export\s+)?(?P<name>\w+)\s*[:=]\s*(?:(?P<q>["'])(?P<quoted>.*?)(?P=q)|(?P<bare>[^#\n]*?))\s*(?:#.*)?$""", re.M)


def settings(text: str) -> dict[str, str]:
    """The settings of a text of lines `name: value`, `name=value` or `$env:NAME = "value"`; the last
    of equal names counts, lines of other forms do not."""
    return {m["name"].lower(): m["quoted"] if m["q"] else m["bare"] for m in _SETTING.finditer(text)}


def jdbc(found: Mapping[str, str]) -> tuple[dict[str, str], Naming]:
    """(JDBC options, names of the tables). One error tells all that is missing or wrong."""
    s = {ALIASES.get(k, k): str(v) for k, v in found.items()}
    wrong = [f"no {k}" for k in NEEDED if not s.get(k)]
    if s.get("port") and not s["port"].isdecimal():
        wrong.append(f"port {s['port']!r} is no number")
    if wrong:
        raise ValueError("catalogue database: " + ", ".join(wrong))
    options = {"url": f"jdbc:postgresql://{s['host']}:{s['port']}/{s['database']}", "user": s["username"], "password": s["password"]}
    return options, Naming(s.get("schema", ""), s.get("table_prefix", "META_"))


def from_session(spark: SparkSession) -> tuple[dict[str, str], Naming]:
    """From the keys below spark.metaquarry.catalog. of the session."""
    return jdbc({k.removeprefix(SESSION_PREFIX): v for k, v in spark.conf.getAll.items() if k.startswith(SESSION_PREFIX)})


def from_file(spark: SparkSession, path: str) -> tuple[dict[str, str], Naming]:
    """From a file of settings on any storage Spark reads."""
    return jdbc(settings("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())))


def read(spark: SparkSession, name: str, where: tuple[dict[str, str], Naming], *, by: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1) -> DataFrame:
    """A table of the database; with `by`, a numeric column, in as many parts at once."""
    options, naming = where
    split = {"partitionColumn": by, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)} if by else {}
    return spark.read.format("jdbc").options(**options, **split).option("dbtable", naming.table(name)).load()
