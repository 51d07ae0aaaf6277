import os

import pytest

from metaquarry.sources import files as S


def test_empty_and_missing_folder(spark, tmp_path):
    assert S.discover(spark, str(tmp_path)).count() == 0
    with pytest.raises(S.FolderNotFound):
        S.discover(spark, str(tmp_path / "none"))


def test_discovery_is_recursive_sorted_and_complete(spark, tmp_path):
    for p in ("b/x.txt", "a.sql", "b/c/y.py", ".hidden", "b/表格.sql", "b/z.TestSuite.SQL", "z.TESTSUITE.sql"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    (tmp_path / "folder.sql").mkdir()
    got = S.discover(spark, str(tmp_path)).collect()
    root = os.path.realpath(tmp_path)
    assert [r["relative_path"] for r in got] == sorted([".hidden", "a.sql", "b/c/y.py", "b/x.txt", "b/表格.sql"], key=lambda p: f"{root}/{p}")
    assert {(r["name"], r["extension"], r["stem"]) for r in got} >= {(".hidden", "", ".hidden"), ("a.sql", ".sql", "a"), ("表格.sql", ".sql", "表格")}


def test_a_link_gives_its_target_twice(spark, tmp_path):
    (tmp_path / "t.sql").write_text("x")
    (tmp_path / "l.sql").symlink_to(tmp_path / "t.sql")
    assert [r["name"] for r in S.discover(spark, str(tmp_path)).collect()] == ["t.sql", "t.sql"]


def test_remote_listing(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.B.sql").write_text("x")
    (tmp_path / "s/b.testsuite.sql").write_text("x")
    assert [(r["name"], r["stem"], r["relative_path"]) for r in S.discover_remote(spark, str(tmp_path)).collect()] == [("a.B.sql", "a.B", "s/a.B.sql")]


def test_checked_entries(spark):
    ok = spark.createDataFrame([("/a", 0)], "path string, length long")
    assert S.checked(ok).count() == 1
    for row in [("a", 1), ("/a", -1)]:
        with pytest.raises(Exception, match="must"):
            S.checked(spark.createDataFrame([row], "path string, length long")).collect()


BIG5 = "-- 客戶資料表\nCREATE TABLE a.b (c INT);"
CASES = {
    "bom": ("﻿SELECT 1".encode(), "SELECT 1", "ok"),
    "utf8": ("préfix".encode(), "préfix", "ok"),
    "cp950": (BIG5.encode("cp950"), BIG5, "ok"),
    "utf16": ("SELECT 'é'".encode("utf-16"), "SELECT 'é'", "ok"),
    "none": (b"\xff\xfe\xff", None, "failed"),
    "dump": (b"PGDMP\x01\x0e", None, "unsupported"),
    "empty": (b"", "", "ok"),
    "null": (None, None, "failed"),
    "damaged": (b"\xff\xfe" + b"\r\x00\r\n\x00".join("ab cd".encode("utf-16-le").split(b" \x00")) + b"\x00", "ab\r\ncd", "ok"),
}


def test_decoding(spark):
    df = spark.createDataFrame([(k, b) for k, (b, _, _) in CASES.items()], "path string, content binary")
    got = {r["path"]: r for r in S.decode(df).collect()}
    assert {k: (r["text"], r["status"]) for k, r in got.items()} == {k: (t, s) for k, (_, t, s) in CASES.items()}
    assert got["none"]["error_type"] == "EncodingReadError" and "utf-8-sig, utf-8, cp950, big5, utf-16" in got["none"]["error_message"]
    assert got["dump"]["unsupported_reason"] == "PG custom-format dump"


def test_content_is_read_by_the_tasks(spark, tmp_path):
    (tmp_path / "a.sql").write_bytes(b"abc")
    r = S.with_content(S.discover(spark, str(tmp_path))).collect()[0]
    assert (bytes(r["content"]), r["length"]) == (b"abc", 3)
