"""Scans end to end: folder to catalogue, report and console."""

import json
import os

import pytest

from conftest import rows
from metaquarry import cli, connection
from metaquarry.operators.catalog import Catalog
from metaquarry.plans import pipeline as P
from metaquarry.session import cut, dropped_after, shared_dir
from metaquarry.sources import files as S


def scan(spark, folder, out, catalog):
    said = []
    code = P.run_scan(spark, str(folder), catalog, str(out), say=said.append)
    return code, said


def test_scan_twice(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "one.sql").write_text("DROP TABLE IF EXISTS a.t;\nCREATE TABLE a.t (id INT PRIMARY KEY, x VARCHAR(9));")
    (src / "two.sql").write_text("CREATE VIEW a.v AS SELECT * FROM a.t;\nCREATE FUNCTION a.f() RETURNS int AS $$ SELECT 1 FROM a.v; $$ LANGUAGE sql;")
    (src / "bad.sql").write_text("CREATE VIEW a.w AS SELECT 1;\nCREATE TABLE a.b (")
    (src / "dump.sql").write_bytes(b"PGDMP\x01")
    (src / "note.txt").write_text("CREATE TABLE z (a INT)")
    (src / "twin.sql").write_text("CREATE VIEW a.t2 AS SELECT 1;")
    cat = Catalog(spark, f"file://{tmp_path}/cat")
    code, said = scan(spark, src, tmp_path / "rep", cat)
    assert code == 0 and said[-1] == "Success."
    want = ["Files scanned    : 6", "Files supported  : 4", "Files unsupported: 1", "Unsupported reason: PG custom-format dump", "Files failed     : 1", "Objects created  : 4", "Objects skipped  : 0", "Objects failed   : 0"]
    assert [x for x in said if x in want] == want and any(x.endswith("two.sql : 2 objects") for x in said)
    assert json.load(open(tmp_path / "rep/summary.json"))["objects_created"] == 4
    assert "bad.sql,SqlDdlParser,parse,UnsupportedSqlSyntaxError" in open(tmp_path / "rep/failed-files.csv").read()
    assert rows(cat.read("OBJECT").select("qualified_name")) == [("a.f",), ("a.t",), ("a.t2",), ("a.v",)]
    names = {r["object_id"]: r["qualified_name"] for r in cat.read("OBJECT").collect()}
    edges = {(names[r["from_object_id"]], names[r["to_object_id"]], r["relation_type"]) for r in cat.read("RELATION").collect()}
    assert edges == {("a.v", "a.t", "READS"), ("a.f", "a.v", "READS")}
    code, said = scan(spark, src, tmp_path / "rep", cat)
    assert "Objects created  : 0" in said and "Objects skipped  : 4" in said and cat.read("OBJECT").count() == 4 and cat.read("RELATION").count() == 2


def test_missing_folder(spark, tmp_path):
    said = []
    assert P.run_scan(spark, str(tmp_path / "none"), Catalog(spark, str(tmp_path)), say=said.append) == 1 and said[0] == "Folder not found:"


def test_strict_scan_raises(spark, tmp_path):
    (tmp_path / "bad.sql").write_text("CREATE TABLE a.b (")
    with pytest.raises(ValueError, match="bad.sql"):
        P.scan_files(S.with_content(S.discover(spark, str(tmp_path))), strict=True)


def test_minimal_pipeline(spark, tmp_path):
    (tmp_path / "a.sql").write_text("CREATE TABLE s.t (id INT);")
    (tmp_path / "a.txt").write_text("x")
    cat = Catalog(spark, f"file://{tmp_path}/cat")
    assert P.run_pipeline(spark, str(tmp_path), cat) == {"files_scanned": 2, "files_parsed": 1, "objects_created": 1}
    assert cat.read("COLUMN").count() == 1


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    assert cli.main(["scan", str(tmp_path / "src"), "--catalog", f"file://{tmp_path}/cat", "--report", str(tmp_path / "rep")], spark) == 0
    assert "Files scanned    : 0" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main([], spark)


def test_connection_settings(spark, tmp_path):
    lines = "host: h # here\nport = 5432\n\ndatabase: 'd#1'\nusername: u\npassword: \"p:=\"\nschema: s\ntable_prefix: T_\n"
    options, names = connection.jdbc(connection.settings(lines))
    assert options == {"url": "jdbc:postgresql://h:5432/d#1", "user": "u", "password": "p:="} and names.table("OBJECT") == "s.T_OBJECT"
    f = tmp_path / "env.txt"
    f.write_text("# comment\n" + "\n".join(f'$env:{k} = "{v}"' for k, v in {"PGHOST": "h", "PGPORT": "1", "PGDATABASE": "d", "PGUSER": "u", "PGPASSWORD": "p"}.items()))
    assert connection.from_file(spark, str(f))[0]["url"] == "jdbc:postgresql://h:1/d"
    with pytest.raises(ValueError, match="no host, no database, no username, no password, port 'x' is no number"):
        connection.jdbc(connection.settings("port: x"))
    spark.conf.set("spark.metaquarry.catalog.host", "h")
    with pytest.raises(ValueError, match="no port, no database"):
        connection.from_session(spark)


def test_tables_of_a_plan_are_dropped_with_it(spark):
    folder = shared_dir(spark).removeprefix("file://")
    kept = cut(spark.range(3))
    before = set(os.listdir(folder))
    with dropped_after(spark):
        assert cut(cut(spark.range(5)).where("id > 1")).count() == 3 and len(set(os.listdir(folder)) - before) == 2
    assert set(os.listdir(folder)) == before and kept.count() == 3
