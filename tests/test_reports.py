import json

from pyspark.sql import functions as F

from conftest import rows
from metaquarry.operators import reports as T

FAILURE = {"absolute_path": "/r/a.sql", "relative_path": "a.sql", "parser": "SqlDdlParser", "stage": "parse", "error_type": "ParseError", "error_message": "no, really", "statement_type": None}


def test_report_files(tmp_path):
    folder = T.write_report({"files_scanned": 5, "files_supported": 4, "files_failed": 0, "objects_created": 3, "elapsed_seconds": 1.23456}, [], str(tmp_path / "out"))
    assert json.load(open(f"{folder}/summary.json")) == {"files_scanned": 5, "files_supported": 4, "files_failed": 0, "objects_created": 3, "elapsed_seconds": 1.235}
    assert open(f"{folder}/failed-files.csv").read().split() == ["relative_path,parser,stage,error_type,error_message"] and open(f"{folder}/failed-files.log").read() == ""
    T.write_report({"files_scanned": 1, "files_supported": 1, "files_failed": 1, "objects_created": 0, "elapsed_seconds": 0}, [FAILURE, FAILURE], folder)
    assert open(f"{folder}/failed-files.csv").read().splitlines()[1] == 'a.sql,SqlDdlParser,parse,ParseError,"no, really"'
    log = open(f"{folder}/failed-files.log").read()
    assert log.count("Statement type: Unknown\nMessage: no, really\n") == 2 and "=\n\n=" in log and log.endswith("=\n")


def test_log_block_is_the_same_as_a_column(spark):
    df = spark.createDataFrame([FAILURE], ", ".join(f"{k} string" for k in FAILURE))
    assert df.select(T.block_of()).first()[0] == T.failure_block(FAILURE)


def test_summary_counts(spark):
    df = spark.createDataFrame([(True, None, False, 2, 2, 0), (True, None, True, 0, 0, 0), (False, "PG custom-format dump", False, 0, 0, 0), (False, None, False, 0, 0, 0)], "supported boolean, unsupported_reason string, failed boolean, objects int, created int, skipped int")
    assert tuple(T.scan_summary(df).first()) == (4, 2, 1, 1, 2, 0, 1)
    assert tuple(T.scan_summary(df.limit(0)).first()) == (0, 0, 0, 0, 0, 0, 0)


def test_causes_signatures_and_coverage(spark):
    df = spark.createDataFrame([("a",), ("ab",), ("b",), (None,), ("a",)], "m string")
    assert rows(T.root_causes(df, [("A", F.col("m").contains("a")), ("B", F.col("m").contains("b"))])) == [("A", 3, 60.0, 1), ("B", 1, 20.0, 2), ("OTHER", 1, 20.0, 3)]
    assert rows(T.signatures(df, {"A": F.col("m").contains("a"), "B": F.col("m").contains("b")})) == [("A", 3), ("B", 2)]
    assert [tuple(r) for r in T.top(df, F.col("m"), "m", 2).collect()] == [("a", 2), (None, 1)]
    o = spark.createDataFrame([("r", "TABLE"), ("r", "VIEW"), ("s", "TABLE")], "repo string, object_type string")
    assert rows(T.coverage(o, "repo", ("TABLE", "VIEW"))) == [(None, 2, 1, 3), ("r", 1, 1, 2), ("s", 1, 0, 1)]
    assert T.root_causes(df.limit(0), []).count() == 0
