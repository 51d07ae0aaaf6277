"""Source files that do not parse, and their rates.

Every file is read by the generalised LL recogniser under the grammar of its language; for SQL
the rules of three dialects run together on one stack. A file is flagged if no way through any of
them reaches its end."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaquarry.llm import grammars
from metaquarry.session import tasks_for

LANGUAGES = ("sql", "py", "json", "xml")


def language(path: Column | str) -> Column:
    """The language of the extension after the last dot of the file name, or null."""
    ext = F.lower(F.regexp_extract(path, "\\.([^./\\\\]*)$", 1))
    return F.when(ext.isin(*LANGUAGES), ext)


READERS = {"sql": (grammars.sql_tokens, grammars.sql_grammar), "py": (grammars.python_tokens, grammars.python_grammar), "json": (grammars.json_tokens, grammars.json_grammar), "xml": (grammars.xml_tokens, grammars.xml_grammar)}


def recognised(kind: str, text: str) -> bool:
    """Whether the recogniser finds a parse of the whole text."""
    read, grammar = READERS[kind]
    tokens = read(text)
    return tokens is not None and grammar().accepts(tokens)[0]


def verdicts(files: DataFrame) -> DataFrame:
    """(file_id, system_name, language, broken), one row per file with content in a language.

    Repeated rows of a file count once. Null content, null ids and other extensions are no case.
    Empty SQL and Python files are sound, empty JSON and XML ones are not. Files are spread evenly
    over the tasks, as reading them costs more than moving them."""
    f = files.select("file_id", "system_name", language("relative_path").alias("language"), "content").where("file_id is not null and language is not null and content is not null")
    kind = files.schema["file_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            broken = [not recognised(k, t) for k, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(broken, pa.bool_())], names=["file_id", "system_name", "language", "broken"])

    # Rows are dealt out evenly, so copies of one file do not meet in a task; their equal verdicts
    # are combined before the small shuffle.
    judged = f.repartition(tasks_for(f)).mapInArrow(judge, f"file_id {kind}, system_name string, language string, broken boolean")
    return judged.groupBy("file_id").agg(F.min("system_name").alias("system_name"), F.min("language").alias("language"), F.bool_or("broken").alias("broken"))


def broken_files(files: DataFrame) -> DataFrame:
    """(file_id) of the files that are not valid in their language."""
    return verdicts(files).where("broken").select("file_id")


def broken_rates(files: DataFrame) -> DataFrame:
    """(system_name, language, n_files, n_broken, rate) of each repository and language."""
    g = verdicts(files).groupBy("system_name", "language").agg(F.count("*").alias("n_files"), F.count_if("broken").alias("n_broken"))
    return g.withColumn("rate", F.round(F.col("n_broken") / F.col("n_files"), 6))


def report_gaps(files: DataFrame, failures: DataFrame) -> DataFrame:
    """(system_name, language, n_broken, n_broken_reported, n_sound_reported): how completely the
    failure reports cover the broken files. A report names a file by system_name and
    relative_path; reports without both, and of files that are not there, do not count."""
    v = verdicts(files)
    paths = files.where("content is not null").select("file_id", "relative_path").dropDuplicates(["file_id"])
    told = failures.select("system_name", "relative_path").where("system_name is not null and relative_path is not null").distinct().withColumn("told", F.lit(True))
    j = v.join(paths, "file_id").join(told, ["system_name", "relative_path"], "left")
    return j.groupBy("system_name", "language").agg(
        F.count_if("broken").alias("n_broken"), F.count_if(F.col("broken") & F.col("told").isNotNull()).alias("n_broken_reported"), F.count_if(~F.col("broken") & F.col("told").isNotNull()).alias("n_sound_reported")
    )
