from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from metaquarry.operators import catalog as C
from metaquarry.schemas import COLUMN, OBJECT, PROPERTY, RELATION, natural_id

NOW = datetime(2024, 1, 1)


def objects(spark, data):
    return spark.createDataFrame([(i, "TABLE", s, q, n, n, None, None, "ACTIVE", NOW, NOW) for i, s, q, n in data], OBJECT)


def batch(spark, data):
    return objects(spark, data).withColumn("seq", F.lit(0)).drop("seq").join(spark.createDataFrame([(d[0], d[1], d[2], k) for k, d in enumerate(data)], "object_id string, system_name string, qualified_name string, seq int").dropDuplicates(), ["object_id", "system_name", "qualified_name"])


def counts(spark, data, stored=()):
    return tuple(C.outcome_counts(C.classify(batch(spark, data), objects(spark, list(stored)))).first())


def test_outcomes(spark):
    a, b = ("1", "s", "q.a", "a"), ("2", "s", "q.b", "b")
    assert counts(spark, [a, b]) == (2, 0, 0)
    assert counts(spark, [a, b], [a]) == (1, 1, 0)
    assert counts(spark, [("9", "s", "q.a", "a"), b], [a]) == (1, 1, 0)
    assert counts(spark, [("1", "", "q.a", "a"), b]) == (1, 0, 1)
    assert counts(spark, [("1", "s", "q.a", None), b]) == (1, 0, 1)
    assert counts(spark, [a, ("3", "s", "q.a", "a"), b, ("2", "s", "q.c", "c")]) == (2, 2, 0)
    assert counts(spark, []) == (0, 0, 0)


def test_round_trip(spark, tmp_path):
    cat = C.Catalog(spark, f"file://{tmp_path}")
    assert not cat.exists("OBJECT") and cat.read("COLUMN").count() == 0
    cat.migrate()
    cat.migrate()
    assert cat.exists("OBJECT") and cat.read("OBJECT").count() == 0
    o = objects(spark, [("1", "s", "q.a", "a"), ("2", "s", "q.b", "b")])
    c = spark.createDataFrame([("c2", "1", "y", 2, "INT", True, None, False, False), ("c1", "1", "x", 1, "INT", False, "0", True, False)], COLUMN)
    p = spark.createDataFrame([("p1", "1", "z", "1"), ("p2", "1", "k", None)], PROPERTY)
    stored = {r["object_id"]: r for r in cat.create_objects(o, c, p).collect()}
    assert [x["column_name"] for x in stored["1"]["columns"]] == ["x", "y"] and [x["property_name"] for x in stored["1"]["properties"]] == ["k", "z"] and stored["2"]["columns"] == []
    assert C.lookup(cat.read("OBJECT"), object_id="1").first()["qualified_name"] == "q.a"
    new = o.where("object_id = '1'").withColumn("name", F.lit("renamed"))
    cat.update_objects(new, c.where("column_id = 'c1'"), p.where("false"))
    assert C.lookup(cat.read("OBJECT"), object_id="1").first()["name"] == "renamed"
    assert (cat.read("COLUMN").count(), cat.read("PROPERTY").count()) == (1, 2)
    assert rows(cat.delete_objects(o.where("object_id = '1'")).select("object_id", "name")) == [("1", "renamed")]
    assert rows(cat.read("OBJECT").select("object_id")) == [("2",)] and cat.read("COLUMN").count() == 1


def test_two_writers_lose_nothing(spark, tmp_path):
    one, two = C.Catalog(spark, f"file://{tmp_path}"), C.Catalog(spark, f"file://{tmp_path}")
    one.append({"OBJECT": objects(spark, [("1", "s", "q.a", "a")])})
    put, did = one._put, []

    def late(number, manifest):
        if len(did) < 1:
            did.append(1)
            two.append({"OBJECT": objects(spark, [(f"w{number}", "s", f"q.{number}", "b")])})
        return put(number, manifest)

    one._put = late
    one.append({"OBJECT": objects(spark, [("2", "s", "q.b", "b")])})
    assert sorted(r["object_id"] for r in one.read("OBJECT").collect()) == ["1", "2", "w2"]
    did.clear()
    gone = one.delete_objects(objects(spark, [("1", "s", "q.a", "a")]))
    assert rows(gone.select("object_id")) == [("1",)] and sorted(r["object_id"] for r in two.read("OBJECT").collect()) == ["2", "w2", "w4"]


def test_column_relations_are_saved_once_and_found(spark, tmp_path):
    cat = C.Catalog(spark, f"file://{tmp_path}")
    r = spark.createDataFrame([("c1", "c2", "copy"), ("c1", "c2", "copy"), ("c2", "c3", None)], "source_column_id string, target_column_id string, transformation string")
    cat.save_column_relations(r)
    cat.save_column_relations(r)
    c2 = spark.createDataFrame([("c2",), (None,)], "column_id string")
    assert cat.read("COLUMN_RELATION").count() == 2
    assert [x["target_column_id"] for x in cat.find_column_relations(c2).collect()] == ["c3"] and [x["source_column_id"] for x in cat.find_column_relations(c2, "target").collect()] == ["c1"]


def test_scans_are_saved_with_targets_and_results(spark, tmp_path):
    cat = C.Catalog(spark, f"file://{tmp_path}")
    job = lambda status: spark.createDataFrame([("j", "x", NOW, None, status)], "scan_job_id string, scanner_name string, started_at timestamp, finished_at timestamp, status string")
    target = spark.createDataFrame([("t", "j", "FILE", "/a", "h", True)], "target_id string, scan_job_id string, target_type string, target_path string, hash_value string, changed boolean")
    result = spark.createDataFrame([("r", "j", 1, 2, 0, 0)], "result_id string, scan_job_id string, object_count long, relation_count long, warning_count long, error_count long")
    cat.save_scan(job("RUNNING"), target, result.limit(0))
    cat.save_scan(job("SUCCESS"), target, result)
    assert [cat.read(n).count() for n in ("SCAN_JOB", "SCAN_TARGET", "SCAN_RESULT")] == [1, 1, 1] and cat.read("SCAN_JOB").first()["status"] == "SUCCESS"


def test_candidates_are_resolved_in_their_system_first(spark):
    o = objects(spark, [("1", "s", "q.a", "a"), ("2", "s", "q.b", "b"), ("3", "r", "q.b", "b"), ("4", "a", "q.c", "c"), ("5", "z", "q.c", "c"), ("6", "z", "Q.B", "B")])
    found = spark.createDataFrame([("1", t, "READS", "STATIC_SQL") for t in ("q.b", "q.c", "q.none", "Q.B", "q.b")] + [("9", "q.b", "READS", "STATIC_SQL"), ("1", None, "READS", "STATIC_SQL")], "object_id string, target_qualified_name string, relation_type string, source_type string")
    assert [r[1] for r in rows(C.resolve_candidates(found, o, o))] == ["2", "2", "4", "6"]


def test_edges_are_stored_once(spark, tmp_path):
    cat = C.Catalog(spark, f"file://{tmp_path}")
    cat.migrate()
    o = objects(spark, [("1", "s", "q.a", "a"), ("2", "s", "q.b", "b")])
    cat.create_objects(o, cat.read("COLUMN"), cat.read("PROPERTY"))
    found = spark.createDataFrame([("1", "q.b", "READS", "STATIC_SQL")] * 2 + [("1", "q.b", "CALLS", "STATIC_SQL")], "object_id string, target_qualified_name string, relation_type string, source_type string")
    assert cat.create_relations(found, o) == 3 and cat.read("RELATION").count() == 2
    cat.compact("RELATION")
    cat.compact()
    assert cat.create_relations(found, o) == 3 and cat.read("RELATION").count() == 2


def test_direct_edges_in_order(spark):
    r = spark.createDataFrame([("r2", "a", "b", "READS", "X", datetime(2024, 1, 1)), ("r1", "c", "b", "READS", "X", datetime(2024, 1, 1)), ("r0", "d", "b", "READS", "X", datetime(2024, 1, 2))], RELATION)
    assert [x["relation_id"] for x in C.upstream(r, "b").collect()] == ["r1", "r2", "r0"] and [x["relation_id"] for x in C.downstream(r, "a").collect()] == ["r2"]


def test_versions_targets_tags_and_rules(spark):
    v = spark.createDataFrame([("v1", "o", 1, "x", None, NOW, True), ("v2", "o", 2, "y", None, NOW, False)], "version_id string, object_id string, version_number int, hash_value string, source_location string, created_at timestamp, is_current boolean")
    assert rows(C.current_versions(v).select("object_id", "version_id")) == [("o", "v2")]
    t = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "1")], "target_path string, hash_value string")
    last = spark.createDataFrame([("a", "1", 2), ("a", "0", 1), ("b", "1", 1), ("c", None, 1)], "target_path string, hash_value string, scanned_at int")
    assert rows(C.changed_targets(t, last).select("target_path", "changed")) == [("a", False), ("b", True), ("c", False), ("d", True)]
    tags = spark.createDataFrame([("t1", "hot", None)], "tag_id string, name string, description string")
    assert rows(C.tags_of(spark.createDataFrame([("o", "t1"), ("o", "t1"), ("o", "t2")], "object_id string, tag_id string"), tags)) == [("o", "t1", "hot")]
    c = spark.createDataFrame([("1", "email"), ("2", "email_addr"), ("3", "x"), ("4", None)], "column_id string, column_name string")
    assert rows(C.pii_hits(c, [("a", "MAIL", "email", 1), ("b", "ADDR", "addr", 2)])) == [("1", "a", "MAIL"), ("2", "b", "ADDR")]


def test_ids_and_names(spark):
    i = spark.range(1).select(natural_id(F.lit("s"), F.lit("q"))).first()[0]
    assert [len(x) for x in i.split("-")] == [8, 4, 4, 4, 12]
    assert C.Naming("meta").table("OBJECT") == "meta.META_OBJECT" and C.Naming(table_prefix="").table("OBJECT") == "OBJECT"


@pytest.mark.parametrize("bad", ["system_name", "qualified_name", "name"])
def test_names_must_be_there(spark, bad):
    o = batch(spark, [("1", "s", "q", "n")]).withColumn(bad, F.lit(""))
    assert C.classify(o, objects(spark, [])).first()["outcome"] == "failed"
