import random
from datetime import datetime

from conftest import rows
from metaquarry.operators import snapshots as S

COLUMNS = "column_id string, scan_job_id string, system_name string, qualified_name string, column_name string, datatype string, loaded_at timestamp, pair int, node int, leaf int, n int"
JOBS = "scan_job_id string, system_name string, started_at timestamp, status string"


def tables(spark, columns, jobs):
    c = [(str(i), j, s, q, n, t, None if at is None else datetime(2024, 1, at), 1, 2, 3, 4) for i, (j, s, q, n, t, at) in enumerate(columns)]
    return spark.createDataFrame(c, COLUMNS), spark.createDataFrame([(j, s, None if d is None else datetime(2024, 2, d), st) for j, s, d, st in jobs], JOBS)


def plain(columns, jobs):
    """The same, by dictionaries."""
    ok = {}
    for j, s, d, st in jobs:
        if st is not None and st.upper().strip() == "SUCCESS" and None not in (j, s, d):
            ok[j] = (s, d)
    state = {}
    for j, _, q, n, t, at in columns:
        if j in ok:
            t = None if t is None else "".join(t.split()).upper()
            key, rank = (j, q, n), (at is not None, at or 0, t is not None, t or "")
            if key not in state or rank > state[key][0]:
                state[key] = (rank, t)
    out = []
    for s in {x[0] for x in ok.values()}:
        order = sorted((d, j) for j, (x, d) in ok.items() if x == s)
        for (_, a), (_, b) in zip(order, order[1:]):
            old, new = ({k[1:]: v[1] for k, v in state.items() if k[0] == j} for j in (a, b))
            for k in old.keys() | new.keys():
                kind = "ADDED" if k not in old else "REMOVED" if k not in new else "CHANGED" if old[k] != new[k] else None
                if kind:
                    out.append((s, *k, b, kind))
    return sorted(out, key=lambda t: tuple((x is not None, str(x)) for x in t))


def test_random_snapshots(spark):
    r = random.Random(5)
    jobs = [(f"j{i}", f"s{i % 3}", 1 + i, r.choice(["SUCCESS", "success ", "FAILED", "SUCCESS"])) for i in range(14)]
    jobs += jobs[:3] + [(None, "s0", 1, "SUCCESS"), ("jx", None, 1, "SUCCESS"), ("jn", "s0", None, "SUCCESS"), ("jz", "s0", 25, None)]
    columns = []
    for j, s, _, _ in jobs[:14]:
        for q in range(6):
            for n in range(r.randint(0, 6)):
                columns.append((j, s, r.choice([f"q{q}", None]), f"c{n}", r.choice(["INT", "int", " I NT", "TEXT", None, ""]), r.randint(1, 5)))
    columns += columns[:40] + [("nowhere", "s0", "q", "c", "INT", 1), (None, "s0", "q", "c", "INT", 1), ("j0", "s0", None, None, None, None)]
    assert rows(S.snapshot_changes(*tables(spark, columns, jobs))) == plain(columns, jobs)


def test_an_empty_snapshot_removes_everything(spark):
    jobs = [("a", "s", 1, "SUCCESS"), ("b", "s", 2, "SUCCESS"), ("c", "s", 3, "SUCCESS")]
    columns = [("a", "s", "q", "x", "INT", 1), ("c", "s", "q", "x", "INT", 1)]
    assert rows(S.snapshot_changes(*tables(spark, columns, jobs))) == [("s", "q", "x", "b", "REMOVED"), ("s", "q", "x", "c", "ADDED")]


def test_large_snapshots_use_deep_trees(spark):
    jobs = [("a", "s", 1, "SUCCESS"), ("b", "s", 2, "SUCCESS")]
    columns = [(j, "s", f"q{i}", "x", "INT", 1) for j in "ab" for i in range(3000)]
    columns[3000 + 17] = ("b", "s", "q17", "x", "TEXT", 1)
    del columns[3000 + 99]
    assert [S.tree_depth(n) for n in (0, 256, 257, 3000, 10**15)] == [1, 1, 2, 2, 12]
    assert rows(S.snapshot_changes(*tables(spark, columns, jobs))) == [("s", "q17", "x", "b", "CHANGED"), ("s", "q99", "x", "b", "REMOVED")]


def test_empty_tables(spark):
    assert rows(S.snapshot_changes(*tables(spark, [], [("a", "s", 1, "SUCCESS")]))) == []
    assert rows(S.snapshot_changes(*tables(spark, [("a", "s", "q", "x", "INT", 1)], []))) == []
