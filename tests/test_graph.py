import random
from collections import deque
from datetime import datetime, timedelta

import pytest

from conftest import rows
from metaquarry.operators import graph as G
from metaquarry.schemas import RELATION

BEGIN = datetime(2024, 1, 1)


def table(spark, edges):
    return spark.createDataFrame([(f"r{i:04}", f, t, "READS", "STATIC_SQL", BEGIN + timedelta(minutes=m)) for i, (f, t, m) in enumerate(edges)], RELATION)


def walk(edges, start, up=False, most=None):
    queue, seen, out = deque([(start, 0)]), {start}, []
    while queue:
        v, depth = queue.popleft()
        if most is not None and depth >= most:
            continue
        for m, rid, f, t in sorted((m, f"r{i:04}", f, t) for i, (f, t, m) in enumerate(edges) if (t if up else f) == v):
            out.append(rid)
            n = f if up else t
            if n not in seen:
                seen.add(n)
                queue.append((n, depth + 1))
    return out


def ids(df):
    return [r["relation_id"] for r in df.orderBy("position").collect()]


def test_cycle(spark):
    e = table(spark, [("a", "b", 1), ("b", "c", 1), ("c", "a", 1)])
    assert ids(G.traverse(e, "a")) == ["r0000", "r0001", "r0002"] and ids(G.traverse(e, "a", max_depth=1)) == ["r0000"]
    assert ids(G.traverse(e, "a", G.UPSTREAM)) == ["r0002", "r0001", "r0000"]


def test_depths_and_errors(spark):
    e = table(spark, [("a", "b", 1), ("a", "a", 2), ("a", "b", 0)])
    assert ids(G.traverse(e, "a", max_depth=0)) == [] and ids(G.traverse(e, "a")) == ["r0002", "r0000", "r0001"] and ids(G.traverse(e, "none")) == []
    with pytest.raises(ValueError):
        G.traverse(e, "a", max_depth=-1)
    with pytest.raises(ValueError):
        G.traverse(e, "a", "SIDEWAYS")


@pytest.mark.parametrize("up", [False, True])
def test_random_graph_in_breadth_first_order(spark, up):
    r = random.Random(4)
    edges = [(f"n{r.randrange(20)}", f"n{r.randrange(20)}", r.randrange(5)) for _ in range(45)]
    e = table(spark, edges)
    direction = G.UPSTREAM if up else G.DOWNSTREAM
    starts = spark.createDataFrame([("n1",), ("n7",), (None,), ("n1",)], "object_id string")
    got = G.traverse(e.unionByName(e), starts, direction).collect()
    for s in ("n1", "n7"):
        assert [x["relation_id"] for x in sorted(got, key=lambda x: x["position"]) if x["start_id"] == s] == walk(edges, s, up)
    assert ids(G.traverse(e, "n1", direction, 2)) == walk(edges, "n1", up, 2)


def test_large_levels_are_numbered_by_sorting(spark, monkeypatch):
    monkeypatch.setattr(G, "MOST_IN_WINDOW", 0)
    r = random.Random(6)
    edges = [(f"n{r.randrange(15)}", f"n{r.randrange(15)}", r.randrange(3)) for _ in range(60)]
    e = table(spark, edges)
    got = G.traverse(e, spark.createDataFrame([("n1",), ("n2",)], "object_id string")).collect()
    for s in ("n1", "n2"):
        assert [x["relation_id"] for x in sorted(got, key=lambda x: x["position"]) if x["start_id"] == s] == walk(edges, s)


def test_reachable(spark):
    e = table(spark, [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("a", "c", 1)])
    assert rows(G.reachable(e, "a").select("object_id", "depth")) == [("b", 1), ("c", 1)]


def test_two_steps_through_a_hub(spark):
    data = [(f"i{i}", "hub") for i in range(30)] + [("hub", f"o{i}") for i in range(7)] + [("o1", "i1"), ("hub", "hub"), ("a", None), (None, "b"), ("i1", "hub")]
    e = spark.createDataFrame(data, "from_object_id string, to_object_id string")
    edges = {(f, t) for f, t in data if f and t and f != t}
    want = sorted(edges | {(f, u) for f, t in edges for t2, u in edges if t == t2 and f != u})
    assert rows(G.within_two(e)) == want and rows(G.within_two(e, hot_rows=5)) == want and rows(G.within_two(e.limit(0))) == []
