from itertools import combinations

from pyspark.sql import functions as F

from conftest import rows
from metaquarry.llm import formatdup as D

SCHEMA = "object_id string, system_name string, object_type string, qualified_name string, name string, h1 string, canon string, x string"


def objects(spark, data):
    return spark.createDataFrame([(*r, "h", "c", "x") for r in data], SCHEMA)


LISTS = ["folder=a_b;workflow=c;session=d", "WORKFLOW = 'C' | SESSION=\"D\" , FOLDER=>A B;", "session: `d`;\tfolder: a-b;\tworkflow: c"]
NAMES = ["dm.t_x", "[DM].[T X]", "dm::`t_x`", "'dm' . 't_x' ;", "\u3000Dm.\u00a0T-X()"]


def test_pairs(spark):
    data = [(f"l{i}", "s", "SESSION", q, ["n_1", "N 1", "`n1`;"][i]) for i, q in enumerate(LISTS)] + [(f"p{i}", "s", "TABLE", q, "T_x") for i, q in enumerate(NAMES)]
    data += [("o1", "s", "SESSION", "folder=ab;workflow=d;session=c", "n1"), ("o2", "r", "TABLE", "dm.t_x", "t_x"), ("o3", "s", "VIEW", "dm.t_x", "t_x"), ("o4", "s", "TABLE", "dm.t_y", "t_x"), ("o5", "s", "TABLE", "dm.t_x", "t_y")]
    want = sorted([*combinations(["l0", "l1", "l2"], 2), *combinations([f"p{i}" for i in range(len(NAMES))], 2)])
    assert rows(D.duplicate_pairs(objects(spark, data + data[:3]))) == want


def test_a_large_set_is_formed_in_blocks(spark):
    ids = [f"{i:04d}" for i in range(137)]
    data = [(i, "s", "TABLE", "a.b", "b") for i in ids] + [(i, "s", "TABLE", "a.c", "c") for i in ids[::9]]
    assert rows(D.duplicate_pairs(objects(spark, data), block=10)) == list(combinations(ids, 2))
    large = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("object_id"), *[F.lit(x).alias(n) for n, x in (("system_name", "s"), ("object_type", "t"), ("qualified_name", "a.b"), ("name", "b"))])
    assert D.duplicate_pairs(large).count() == 10_000 * 9_999 // 2


def test_collapsing_counts_ids_and_rows(spark):
    data = [("b", "s", "TABLE", "a.b", "b"), ("a", "s", "TABLE", "A.B", "B"), ("a", "s", "TABLE", "A.B", "B"), ("c", "s", "TABLE", "a.c", "c"), ("n", None, "TABLE", "a.b", "b"), (None, "s", "TABLE", "a.b", "b")]
    assert rows(D.collapse(objects(spark, data)).select("object_id", "qualified_name", "n_copies", "n_rows")) == [("a", "A.B", 2, 3), ("c", "a.c", 1, 1)]


def test_hashes_that_collide_are_told_apart(spark, monkeypatch):
    same = D.canonical_records
    monkeypatch.setattr(D, "canonical_records", lambda o: same(o).withColumns({"h1": F.lit(1).cast("long"), "h2": F.lit(2).cast("long")}))
    data = [("a", "s", "TABLE", "a.b", "b"), ("b", "s", "TABLE", "A.B", "B"), ("c", "s", "TABLE", "a.c", "c")]
    assert rows(D.collapse(objects(spark, data)).select("object_id", "n_copies")) == [("a", 2), ("c", 1)]
    assert rows(D.duplicate_pairs(objects(spark, data))) == [("a", "b")]


def test_case_of_special_letters_and_empty_names(spark):
    data = [("a", "s", "T", "Straße", "É"), ("b", "s", "T", "straße", "é"), ("c", "s", "T", "", ""), ("d", "s", "T", "...", " ; "), ("e", "s", "T", "٣", "x" * 200_000), ("f", "s", "T", "٣", "X" * 200_000)]
    assert rows(D.duplicate_pairs(objects(spark, data))) == [("a", "b"), ("c", "d"), ("e", "f")]


def test_empty(spark):
    assert rows(D.duplicate_pairs(objects(spark, []))) == [] and rows(D.collapse(objects(spark, []))) == []
