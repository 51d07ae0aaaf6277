import math

import pytest

from conftest import rows
from metaquarry.llm import mix as M

DOCS = "doc_id long, text string, source string, n_tokens int, size int, salt int, x double"


def docs(spark, data):
    return spark.createDataFrame([(i, t, s, 1, 2, 3, 4.0) for i, t, s in data], DOCS)


def targets(spark, data):
    return spark.createDataFrame(data, "source string, target_share double, max_repeats int")


def test_expected_copies():
    t = {"a": (0.5, 3), "b": (0.3, 2), "c": (0.1, 4), "d": (0.1, 1)}
    x = M.expected_copies(t, {"a": 100, "b": 100, "c": 1, "d": 0}, 201)
    assert x["c"] == 4.0 and x["d"] == 0.0
    assert math.isclose(100 * x["a"] + 100 * x["b"] + 4, 201) and math.isclose(x["a"] / x["b"], 5 / 3)
    assert M.expected_copies({"a": (1.0, 2)}, {"a": 10}, 100) == {"a": 2.0}
    assert M.expected_copies({}, {}, 0) == {} and M.expected_copies({"a": (0.0, 2), "b": (1.0, 0)}, {"a": 1, "b": 1}, 2) == {"a": 0.0, "b": 0.0}


def test_shares_are_reached_and_repeats_are_capped(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_DOCS", 50)
    data = [(i, " word" * (1 + i % 40), "hot") for i in range(1500)] + [(5000 + i, " word" * (1 + i % 7), "small") for i in range(40)] + [(9000 + i, " word" * 5, "mid") for i in range(300)]
    data += [(20_000, None, "hot"), (20_001, "", "hot"), (20_002, "x", None), (20_003, "x", "unlisted")]
    t = targets(spark, [("hot", 0.5, 2), ("small", 0.2, 3), ("mid", 0.3, 9), ("none", 0.1, 3), (None, 0.5, 1)])
    m, s = M.mix_plan(docs(spark, data), t)
    share = {r["source"]: r for r in s.collect()}
    got = m.collect()
    assert len({(r["doc_id"], r["copy"]) for r in got}) == len(got) and {r["source"] for r in got} == {"hot", "small", "mid"}
    assert {r["doc_id"]: 0 for r in got if r["source"] == "small"}.keys() == {5000 + i for i in range(40)} and max(r["copy"] for r in got if r["source"] == "small") == 3
    assert max(r["copy"] for r in got if r["source"] == "hot") <= 2
    for k, r in share.items():
        assert r["mix_tokens"] == sum(x["n_tokens"] for x in got if x["source"] == k) and r["n_copies"] == sum(x["source"] == k for x in got)
    total = sum(r["mix_tokens"] for r in share.values())
    assert abs(total / sum(r["source_tokens"] for r in share.values()) - 1) < 0.01
    assert abs(share["hot"]["actual_share"] / share["mid"]["actual_share"] - 5 / 3) < 0.02 and share["none"]["actual_share"] == 0
    assert rows(M.mix_plan(docs(spark, data[::-1]), t)[0]) == rows(m)


@pytest.mark.parametrize("seed", [1, 2])
def test_every_document_gets_its_expected_copies(spark, seed):
    data = [(i, "a b c", "s") for i in range(101)]
    m, _ = M.mix_plan(docs(spark, data), targets(spark, [("s", 1.0, 5)]), total_tokens=2.5 * 303, seed=seed)
    n = {}
    for r in m.collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert set(n.values()) == {2, 3} and len(n) == 101 and abs(sum(n.values()) - 252.5) <= 1


def test_empty_tables(spark):
    m, s = M.mix_plan(docs(spark, []), targets(spark, [("a", 1.0, 1)]))
    assert m.count() == 0 and [(r["source"], r["actual_share"]) for r in s.collect()] == [("a", 0.0)]
    m, s = M.mix_plan(docs(spark, [(1, "x", "a")]), targets(spark, []))
    assert m.count() == 0 and s.count() == 0
