import random
from datetime import UTC, datetime, timedelta

from conftest import rows
from metaquarry.operators import history as V

SCHEMA = "version_id string, object_id string, version_number int, hash_value string, source_location string, created_at timestamp, is_current boolean, loaded_at timestamp, k int, t string, d string, c int"
BEGIN = datetime(2024, 1, 1, tzinfo=UTC)


def table(spark, data):
    at = lambda h: None if h is None else BEGIN + timedelta(hours=h)
    return spark.createDataFrame([(str(i), o, 1, h, loc, at(c), True, at(ld), 1, "t", "d", 2) for i, (o, h, loc, c, ld) in enumerate(data)], SCHEMA)


def plain(data):
    us = lambda h: int((BEGIN + timedelta(hours=h)).timestamp() * 1_000_000)
    best = {}
    for o, h, _, c, ld in data:
        h = "" if h is None else h.strip().lower()
        if o is None or c is None or not h:
            continue
        rank = (ld is not None, ld or 0, h)
        if (o, c) not in best or rank > best[(o, c)]:
            best[(o, c)] = rank
    out = []
    for o in {k[0] for k in best}:
        kept = []
        for c in sorted(k[1] for k in best if k[0] == o):
            h = best[(o, c)][2]
            if not kept or kept[-1][0] != h:
                kept.append((h, c))
        for i, (h, c) in enumerate(kept):
            end = us(kept[i + 1][1]) if i + 1 < len(kept) else None
            out.append((o, h, us(c), end, end is None))
    return sorted(out, key=lambda t: tuple((x is not None, str(x)) for x in t))


def example(seed):
    r = random.Random(seed)
    data = [(r.choice(["a", "b", "c", "hot", "hot", "hot", None]), r.choice(["x", "X ", " x", "y", "z", "", None]), None, r.choice([None, *range(300)]), r.choice([None, 1, 2, 3])) for _ in range(400)]
    return data + data[:50]


def test_history_against_a_plain_loop(spark):
    data = example(1)
    assert rows(V.version_history(table(spark, data))) == plain(data)


def test_hot_keys_are_cut_into_chunks_with_the_same_result(spark):
    data = example(2)
    assert rows(V.version_history(table(spark, data), hot_rows=3)) == plain(data)


def test_a_returning_hash_starts_a_new_period(spark):
    data = [("o", "x", None, 1, 1), ("o", None, None, 2, 1), ("o", "X", None, 3, 1), ("o", "y", None, 4, 1), ("o", "x", None, 50, 1)]
    assert [r[1] for r in sorted(rows(V.version_history(table(spark, data))), key=lambda r: r[2])] == ["x", "y", "x"]


def test_locations_are_a_satellite_of_their_own(spark):
    data = [("o", "x", " repo://a ", 1, 1), ("o", "y", "repo://a", 2, 1), ("o", "z", None, 3, 1), ("o", "z", "repo://b", 4, 1)]
    assert [r[1] for r in rows(V.location_history(table(spark, data)))] == ["repo://a", "repo://b"]


def test_rates_assign_attributes_to_satellites(spark, tmp_path):
    data = [("o", str(i), "same", i, 1) for i in range(20)]
    store = V.Satellites(spark, str(tmp_path / "s"), V.attributes())
    store.load(table(spark, data))
    assert store.bands() == {"hash_value": 2, "source_location": 0} == V.split_by_rate({"hash_value": 0.95, "source_location": 0.0})
    assert {(r["a"], r["satellite"]) for r in store.rows().collect()} == {("hash_value", 2), ("source_location", 0)}


def stored(spark, folder, loads, hot_rows=V.HOT_ROWS):
    store = V.Satellites(spark, str(folder), V.attributes(), hot_rows=hot_rows)
    for part in loads:
        store.load(table(spark, part))
    return store


def test_loads_append_and_equal_the_full_history(spark, tmp_path):
    data = example(3)
    for n, cut_up in enumerate(([data[:150], data[150:300], data[300:]], [sorted(data, key=lambda r: (r[3] or 0))[:200], sorted(data, key=lambda r: (r[3] or 0))[200:], data[:9]])):
        store = stored(spark, tmp_path / str(n), cut_up, hot_rows=20)
        assert rows(store.history("hash_value").select("k", "d", "valid_from", "valid_to", "is_current")) == plain(data)


def test_a_load_in_order_of_time_appends_changes_only(spark, tmp_path):
    store = stored(spark, tmp_path, [[("o", "x", "p", 1, 1), ("o", "y", "p", 2, 1)], [("o", "y", "p", 3, 1), ("o", "z", "p", 4, 1), ("q", "x", None, 4, 1)], [], [("o", "y", "q", 3, 1)]])
    got = sorted((r["k"], r["a"], r["d"], r["gen"]) for r in store.rows().collect())
    assert [g for g in got if g[3] == 0] == [("o", "hash_value", "x", 0), ("o", "hash_value", "y", 0), ("o", "hash_value", "z", 0), ("o", "source_location", "p", 0), ("q", "hash_value", "x", 0)]
    # The late row of o gives all its rows again, as one more generation.
    assert len([g for g in got if g[3] == 1]) == 3 + 3 and len(rows(store.history("source_location"))) == 3


def test_a_load_that_breaks_off_does_not_count(spark, tmp_path):
    store = stored(spark, tmp_path, [[("o", "x", None, 1, 1)]])
    store.log().write.parquet(str(tmp_path / "log" / "load=1"))
    assert store.log().count() == 1
    store.load(table(spark, [("o", "y", None, 2, 1)]))
    assert [r[1] for r in rows(store.history("hash_value"))] == ["x", "y"] or len(rows(store.history("hash_value"))) == 2


def test_empty_and_null_only(spark):
    assert rows(V.version_history(table(spark, []))) == []
    assert rows(V.version_history(table(spark, [(None, "x", None, 1, 1), ("a", None, None, 1, 1), ("a", " ", None, 1, 1), ("a", "x", None, None, 1)]))) == []
