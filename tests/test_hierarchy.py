import random
from datetime import datetime

from conftest import rows
from metaquarry.operators import hierarchy as H

SCHEMA = "relation_id string, from_object_id string, to_object_id string, relation_type string, created_at timestamp, v int, p int, a int, size string, lft string, depth string, path string"


def table(spark, data):
    return spark.createDataFrame([(str(i), f, t, k, None if c is None else datetime(2024, 1, c), 1, 2, 3, "", "", "", "") for i, (f, t, k, c) in enumerate(data)], SCHEMA)


def plain(data):
    """(root, depth, path) of each object by walking up."""
    parent, nodes = {}, set()
    for f, t, k, c in data:
        if k is None or k.strip().upper() != "BELONGS_TO":
            continue
        nodes |= {x for x in (f, t) if x is not None}
        if f is not None and t is not None:
            rank = (c is not None, c or 0, t)
            if f not in parent or rank > parent[f]:
                parent[f] = rank
    out = {}
    for v in nodes:
        path, seen, u = [v], {v}, v
        while u in parent:
            u = parent[u][2]
            if u in seen:
                path = None
                break
            seen.add(u)
            path.append(u)
        out[v] = ("", -1, None) if path is None else (path[-1], len(path) - 1, path[::-1])
    return out


def check(spark, data):
    want = plain(data)
    got = {r["object_id"]: r for r in H.hierarchy(table(spark, data), with_path=True).collect()}
    assert {k: (r["root_object_id"], r["depth"], r["path"]) for k, r in got.items()} == want
    below = {k: {u for u, (_, _, p) in want.items() if p and k in p[:-1]} for k, (_, d, _) in want.items() if d >= 0}
    for k, b in below.items():
        r = got[k]
        assert r["n_descendants"] == len(b) and r["rgt"] - r["lft"] == len(b) + 1
        assert {u for u, x in got.items() if x["root_object_id"] == r["root_object_id"] and r["lft"] < (x["lft"] if x["lft"] is not None else -1) < r["rgt"]} == b
    pairs = rows(H.descendants(H.hierarchy(table(spark, data))))
    assert [(a, b) for a, b, _ in pairs] == sorted((k, u) for k, b in below.items() for u in b)
    assert all(want[b][1] - want[a][1] == d for a, b, d in pairs)


def test_random_forest_with_cycles(spark):
    r = random.Random(3)
    data = [(f"n{i}", r.choice([f"n{r.randrange(max(1, i))}", f"n{r.randrange(i)}", None]) if i > 2 else None, r.choice(["BELONGS_TO", "belongs_to", " Belongs_To"]), r.randint(1, 9)) for i in range(120)]
    data += [("x", "y", "BELONGS_TO", 1), ("y", "z", "BELONGS_TO", 1), ("z", "x", "BELONGS_TO", 1), ("w", "x", "BELONGS_TO", 1), ("u", "w", "BELONGS_TO", 1), ("self", "self", "BELONGS_TO", 1)]
    data += data[:30] + [("n5", "n6", "READS", 1), (None, "lonely", "BELONGS_TO", None), (None, None, "BELONGS_TO", 1), ("n5", "n6", None, 1)]
    check(spark, data)


def test_long_chain_and_hot_parent(spark):
    chain = [(f"c{i:04}", f"c{i - 1:04}", "BELONGS_TO", 1) for i in range(1, 300)]
    star = [(f"s{i:04}", "c0100", "BELONGS_TO", 1) for i in range(200)]
    got = {r["object_id"]: r for r in H.hierarchy(table(spark, chain + star)).collect()}
    salted = {r["object_id"]: r for r in H.hierarchy(table(spark, chain + star), hot_rows=50).collect()}
    assert salted == got
    assert got["c0299"]["depth"] == 299 and got["c0000"]["n_descendants"] == 499 and got["s0007"]["depth"] == 101
    assert sorted(r["lft"] for r in got.values()) == list(range(500))


def test_the_last_of_several_parents_counts(spark):
    check(spark, [("a", "b", "BELONGS_TO", 1), ("a", "c", "BELONGS_TO", 3), ("a", "d", "BELONGS_TO", 3), ("a", None, "BELONGS_TO", 9)])


def test_only_cycles_and_empty(spark):
    check(spark, [("a", "b", "BELONGS_TO", 1), ("b", "a", "BELONGS_TO", 1)])
    assert rows(H.hierarchy(table(spark, []))) == []
