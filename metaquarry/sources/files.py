"""Folders of source files: discovery and decoding."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaquarry.functions import base_name, extension, relative_to, stem
from metaquarry.schemas import FILE

# Codes in the order they are tried, the mark of a binary dump, and its message.
TEXT_CODES = ("utf-8-sig", "utf-8", "cp950", "big5")
UTF16_CODES = (*TEXT_CODES, "utf-16")
DUMP_MARK = b"PGDMP"
DUMP_REASON = "PG custom-format dump"
SKIPPED_SUFFIX = ".testsuite.sql"


class FolderNotFound(ValueError):
    pass


def describe(paths: DataFrame, root: str) -> DataFrame:
    """Name, extension, stem and relative path of each path."""
    return paths.select("path", base_name("path").alias("name"), extension("path").alias("extension"), stem("path").alias("stem"), relative_to("path", root).alias("relative_path"), *[c for c in paths.columns if c != "path"])


def is_wanted(path: Column | str) -> Column:
    """Generated test suites are left out, in any letter case."""
    return ~F.lower(path).endswith(SKIPPED_SUFFIX)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Every regular file below a local folder, hidden ones included, by resolved absolute path in
    order; a link and its target give the target twice. The walk runs on the driver, as Spark's
    own listing drops names that start with a dot or an underscore; contents are read by tasks."""
    if not os.path.isdir(root):
        raise FolderNotFound(f"Folder not found: {root}")
    rows = []
    for folder, _, names in os.walk(root):
        for n in names:
            p = os.path.join(folder, n)
            if os.path.isfile(p) and not n.lower().endswith(SKIPPED_SUFFIX):
                s = os.stat(p)
                rows.append((os.path.realpath(p), s.st_size, datetime.fromtimestamp(s.st_mtime, UTC)))
    found = spark.createDataFrame(sorted(rows), "path string, length long, modified_at timestamp")
    return describe(found, os.path.realpath(root)).select(*[c.split(" ")[0] for c in FILE.split(", ")]).orderBy("path")


def discover_remote(spark: SparkSession, root: str) -> DataFrame:
    """The same for any storage Spark reads, listed by Spark: names that start with a dot or an
    underscore are missing."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = f.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", F.col("modificationTime").alias("modified_at")).where(is_wanted("path"))
    return describe(found, root)


def with_content(files: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds the bytes (content) of each file, read by the tasks; null where reading fails."""
    schema = files.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.column("path").to_pylist():
                try:
                    with open(p, "rb") as f:
                        out.append(f.read())
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "content"])

    spread = files.repartition(parts or max(1, files.sparkSession.sparkContext.defaultParallelism), "path")
    return spread.mapInArrow(load, schema + ", content binary")


def decode_bytes(content: bytes, path: str = "") -> tuple[str | None, str, str | None, str | None]:
    """(text, status, error type, error message); status is ok, unsupported or failed."""
    if content[: len(DUMP_MARK)] == DUMP_MARK:
        return None, "unsupported", "UnsupportedInputError", f"Unsupported input: {DUMP_REASON}: {path}"
    wide = content[:2] in (b"\xff\xfe", b"\xfe\xff")
    mended = content.replace(b"\r\x00\r\n\x00", b"\r\x00\n\x00")
    mended = mended[: len(mended) - len(mended) % 2]
    attempts = [(mended, "utf-16", "strict")] if wide else []
    attempts += [(content, c, "strict") for c in (UTF16_CODES if wide else TEXT_CODES)]
    attempts += [(mended, "utf-16", "replace")] if wide else []
    last = ""
    for raw, code, mode in attempts:
        try:
            text = raw.decode(code, mode)
        except UnicodeDecodeError as e:
            last = str(e)
            continue
        if code != "utf-16" or len(text) > 1:
            return text, "ok", None, None
    return None, "failed", "EncodingReadError", f"Unable to decode SQL file {path} using: {', '.join(UTF16_CODES)}. Last error: {last}"


def decode(files: DataFrame) -> DataFrame:
    """Adds text, status, unsupported_reason, error_type and error_message from content.

    UTF-8, with or without a byte order mark, and binary dumps are settled by built-in functions;
    only other bytes go to Python, which tries the remaining codes in order. Errors are rows.
    Null content is a failed file, empty content an empty text."""
    dump = F.substring("content", 1, 5) == F.lit(DUMP_MARK)
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    plain = F.when(utf8 & ~dump, F.regexp_replace(F.col("content").cast("string"), "^\\uFEFF", ""))
    rest = F.when(~dump & ~utf8, F.col("content"))

    @F.pandas_udf("text string, status string, error_type string, error_message string")
    def other(raw, path):
        import pandas as pd

        rows = [(None, None, None, None) if r is None else decode_bytes(bytes(r), p or "") for r, p in zip(raw, path, strict=True)]
        return pd.DataFrame(rows, columns=["text", "status", "error_type", "error_message"])

    d = files.withColumn("_d", dump).withColumn("_p", plain).withColumn("_o", other(rest, F.col("path")))
    missing = F.col("content").isNull()
    return d.select(
        *files.columns,
        F.coalesce("_p", "_o.text").alias("text"),
        F.when(missing, "failed").when(F.col("_d"), "unsupported").when(F.col("_p").isNotNull(), "ok").otherwise(F.col("_o.status")).alias("status"),
        F.when(F.col("_d"), DUMP_REASON).alias("unsupported_reason"),
        F.when(missing, "OSError").when(F.col("_d"), "UnsupportedInputError").otherwise(F.col("_o.error_type")).alias("error_type"),
        F.when(missing, "file could not be read").when(F.col("_d"), F.concat(F.lit(f"Unsupported input: {DUMP_REASON}: "), "path")).otherwise(F.col("_o.error_message")).alias("error_message"),
    )


def checked(files: DataFrame) -> DataFrame:
    """The same rows; a relative path or a negative length is an error when it is read."""
    bad_path = F.raise_error(F.concat(F.lit("path must be absolute: "), "path")).cast("string")
    bad_length = F.raise_error(F.concat(F.lit("length must not be negative: "), F.col("length").cast("string"))).cast("long")
    return files.withColumns({"path": F.when(F.col("path").startswith("/"), F.col("path")).otherwise(bad_path), "length": F.when(F.col("length") >= 0, F.col("length")).otherwise(bad_length)})
