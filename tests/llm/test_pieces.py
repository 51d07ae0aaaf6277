import random

import numpy as np

from metaquarry.llm import pieces as P
from metaquarry.llm.bpe import encoder

DOCS = "doc_id long, text string, source string, l string, most int, own string"


def docs(spark, data):
    return spark.createDataFrame([(i, t, s, "l", 1, "o") for i, t, s in data], DOCS)


def limits(spark, data):
    return spark.createDataFrame(data, "source string, max_tokens int, overlap_tokens int")


def check(spark, data, lim, by):
    got = {}
    for r in P.split_oversized(docs(spark, data), limits(spark, lim)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    enc = encoder()
    for i, text, source in data:
        most, overlap = by.get(source, by.get(None, (None, 0)))
        n = int(enc.count([text or ""])[0])
        if most is None or n <= most:
            assert i not in got
            continue
        p = sorted(got.pop(i), key=lambda r: r["piece_no"])
        assert [r["piece_no"] for r in p] == list(range(len(p))) and p[0]["start_token"] == 0 and p[-1]["end_token"] == n and p[-1]["end_char"] == len(text) and p[-1]["boundary"] == "end"
        for a, b in zip(p, p[1:]):
            assert b["start_token"] == a["end_token"] - a["shared_tokens"] and b["end_token"] > a["end_token"]
            assert min(overlap, most - 1) <= a["shared_tokens"] <= min(overlap, most - 1) + 3 or most < 8
        for r in p:
            assert r["text"] == text[r["start_char"] : r["end_char"]]
            if most >= 8:
                assert r["n_tokens"] <= most and int(enc.count([r["text"]])[0]) <= most
    assert not got


def test_random_texts(spark):
    r = random.Random(2)
    parts = ["word ", "Sentence ends. ", "line\n", "para\n\n", "資料庫。", "🙂", "x" * 30, "don't ", "  ", "\r\n", "tbl_fee ", "1234567890"]
    data = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 400))), r.choice(["a", "b", None, "c"])) for i in range(60)] + [(100, None, "a"), (101, "", "a"), (102, "y" * 20_000, "a"), (103, "資" * 3000, "b"), (104, "no blank" * 1, "a")]
    check(spark, data, [("a", 64, 8), ("b", 20, 0), (None, 50, 12)], {"a": (64, 8), "b": (20, 0), None: (50, 12)})


def test_natural_boundaries_come_first(spark):
    text = ("This is one sentence of some words. " * 6 + "\n" + "Another line is here now. " * 4 + "\n\n") * 5
    got = sorted(P.split_oversized(docs(spark, [(1, text, "a")]), limits(spark, [("a", 100, 0)])).collect(), key=lambda r: r["piece_no"])
    assert {r["boundary"] for r in got} <= {"paragraph", "line", "end"} and "".join(r["text"] for r in got) == text


def test_limits_of_one_token_and_missing_limits(spark):
    check(spark, [(1, "a b c d", "a"), (2, "資料", "a"), (3, "x " * 90, "other")], [("a", 1, 5)], {"a": (1, 5)})
    check(spark, [(1, "a b c d", "a")], [], {})
    check(spark, [], [("a", 5, 1)], {})
    assert P.split_oversized(docs(spark, [(1, "a b c d e f g", "a")]), limits(spark, [("a", None, 1), ("a", 3, 1)])).count() == 3


def test_squaring_finds_the_greedy_cuts():
    r = random.Random(3)
    for _ in range(200):
        n = r.randint(1, 60)
        nxt = np.array([min(n, i + r.randint(1, 7)) for i in range(n)] + [n])
        at, want = 0, [0]
        while at < n:
            at = int(nxt[at])
            want.append(at)
        assert P.all_cuts(nxt).tolist() == want
