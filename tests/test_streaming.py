import pytest
from pyspark.errors import StreamingQueryException

from conftest import rows
from metaquarry.streaming import incremental as I


def test_new_and_changed_files(spark, tmp_path):
    src, seen = tmp_path / "src", []
    src.mkdir()

    def go():
        seen.clear()
        q = I.scan_incrementally(spark, f"file://{src}", str(tmp_path / "state"), str(tmp_path / "check"), lambda df, n: seen.extend(rows(df.select("path", "changed"))))
        q.awaitTermination()
        return [p.rsplit("/", 1)[1] for p, _ in seen]

    (src / "a.sql").write_text("1")
    (src / "b.sql").write_text("2")
    (src / "c.txt").write_text("3")
    (src / "e.SQL").write_text("3")
    (src / "f.testsuite.sql").write_text("3")
    assert go() == ["a.sql", "b.sql", "e.SQL"]
    (src / "d.sql").write_text("4")
    assert go() == ["d.sql"] and go() == []


def test_a_state_that_cannot_be_read_is_an_error(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.sql").write_text("1")
    (tmp_path / "state").mkdir()
    (tmp_path / "state" / "part-0.parquet").write_text("no parquet")
    q = I.scan_incrementally(spark, f"file://{tmp_path}/src", str(tmp_path / "state"), str(tmp_path / "check"), lambda df, n: df.count())
    with pytest.raises(StreamingQueryException):
        q.awaitTermination()


def test_latest_targets(spark):
    c = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 1), ("c", None, 1)], "path string, hash_value string, modified_at int")
    k = spark.createDataFrame([("a", "2"), ("b", "0"), ("c", None)], "path string, hash_value string")
    assert rows(I.latest_targets(c, k)) == [("a", "2", False), ("b", "1", True), ("c", None, False)]
