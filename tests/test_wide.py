from datetime import date
from decimal import Decimal

from conftest import rows
from metaquarry.operators import wide as W
from metaquarry.operators.prefix import before

SCHEMA = "property_id string, object_id string, property_name string, property_value string, loaded_at timestamp, attr int, block string, ordinal int, canon string, bucket int, _t int"


def table(spark, data):
    from datetime import datetime

    return spark.createDataFrame([(str(i), o, n, v, None if t is None else datetime(2024, 1, t), 1, "x", 2, "y", 3, 4) for i, (o, n, v, t) in enumerate(data)], SCHEMA)


def types(spark, data):
    return spark.createDataFrame(data, "property_name string, value_type string")


TYPES = [("row_count", "integer"), ("ratio", "decimal"), ("is_open", "boolean"), ("made_on", "date"), ("note", "text")]


def cells(spark, data, kinds=TYPES, size=W.RANGE):
    t = types(spark, kinds)
    return rows(W.wide_cells(W.wide_table(table(spark, data), t, size=size), W.attribute_types(t)))


def test_values_of_every_type(spark):
    good = {
        "row_count": [("+007", "7"), ("1,234,567", "1234567"), (" -0 ", "0"), ("\t12　", "12"), ("-5", "-5")],
        "ratio": [(".5", "0.50"), ("1,234.5", "1234.50"), ("+3", "3.00"), ("0.340", "0.34"), ("-.25", "-0.25")],
        "is_open": [("YES", "true"), ("t", "true"), ("1", "true"), ("Off", "false"), ("0", "false")],
        "made_on": [("2024-2-9", "2024-02-09"), ("2024/02/29", "2024-02-29"), ("20240131", "2024-01-31"), ("1.2.2024", "2024-02-01"), ("2024-01-02T10:15:00", "2024-01-02"), ("2024-01-02 10:15", "2024-01-02")],
        "note": [(" a b ", "a b"), ("null", "null"), ("x" * 300_000, "x" * 300_000)],
    }
    bad = {"row_count": ["1.5", "1,23", "12k", "", "-", "١"], "ratio": ["NaN", "1.2.3", ".", "2 %"], "is_open": ["2", "maybe", ""], "made_on": ["2023-02-29", "0000-00-00", "2024-01/02", "soon", "2024"], "note": ["", "  \t"]}
    data, want = [], []
    for name, pairs in good.items():
        for i, (v, plain) in enumerate(pairs):
            data.append((f"{name}{i}", name, v, 1))
            want.append((f"{name}{i}", name, plain))
    data += [(f"bad{name}{i}", name, v, 1) for name, vs in bad.items() for i, v in enumerate(vs)]
    assert cells(spark, data) == sorted(want)


def test_latest_counting_row_wins_and_names_are_matched_loosely(spark):
    data = [("a", "Row Count", "1", 1), ("a", "rowCount", "2", 2), ("a", "ROW-COUNT", "many", 3), ("a", "row_counts", "9", 4), ("b", "row.count", "5", 1), ("b", "row.count", "7", 1), ("b", "row.count", "7", 1), ("b", "row.count", "9", None)]
    assert cells(spark, data) == [("a", "row_count", "2"), ("b", "row_count", "7")]


def test_nulls_and_entities_without_cells(spark):
    data = [(None, "note", "x", 1), ("a", None, "x", 1), ("b", "note", None, 1), ("c", "other", "x", None)]
    w = W.wide_table(table(spark, data), types(spark, TYPES))
    assert w.columns == ["ordinal", "object_id", "is_open", "made_on", "note", "ratio", "row_count"]
    assert [(r["ordinal"], r["note"]) for r in w.orderBy("ordinal").collect()] == [(0, None), (1, None), (2, None)]
    assert {r["object_id"] for r in w.collect()} == {"a", "b", "c"}


def test_typed_columns_over_many_ranges(spark):
    data = [(f"o{i:03}", "row_count", str(i), 1) for i in range(50)] + [(f"o{i:03}", "made_on", "2024-01-05", 1) for i in range(0, 50, 7)] + [(f"o{i:03}", "ratio", "1.5", 1) for i in range(0, 50, 9)]
    w = {r["object_id"]: r for r in W.wide_table(table(spark, data), types(spark, TYPES), size=3).collect()}
    assert len(w) == 50 and sorted(r["ordinal"] for r in w.values()) == list(range(50))
    for i in range(50):
        r = w[f"o{i:03}"]
        assert (r["row_count"], r["made_on"], r["ratio"]) == (i, date(2024, 1, 5) if i % 7 == 0 else None, Decimal("1.50") if i % 9 == 0 else None)


def test_values_before_each_bucket(spark):
    sizes = [(b, (b * 7) % 5, (b * 11) % 50) for b in range(0, 100, 3)]
    want = [(b, sum(n for c, n, _ in sizes if c < b) if b else None, max((m for c, _, m in sizes if c < b), default=None)) for b, _, _ in sizes]
    got = before(spark.createDataFrame(sizes[::-1], "bucket int, n long, m long"), run=8, n="sum", m="max")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_one_hot_entity(spark):
    data = [("hot", "row_count", str(i % 5), 1 + i % 28) for i in range(3000)] + [("cold", "note", "n", 1)]
    assert cells(spark, data) == [("cold", "note", "n"), ("hot", "row_count", "4")]


def test_empty_tables(spark):
    assert cells(spark, []) == []
    assert W.wide_table(table(spark, [("a", "note", "x", 1)]), types(spark, [])).select("object_id").collect()[0][0] == "a"
