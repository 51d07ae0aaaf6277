import random
import re

from metaquarry.operators import statements as S


def split(spark, *scripts):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scripts)], "i int, text string")
    got = {r["i"]: r["a"] for r in df.select("i", S.statements_of("text").alias("a")).collect()}
    return [got[i] for i in range(len(scripts))]


def kept(spark, script):
    df = spark.createDataFrame([(script,)], "text string")
    return [r["sql"] for r in S.kept_statements(df).orderBy("stmt_no").collect()]


def scanner(script):
    """A plain scanner: modes by the character that opened them."""
    script = "\n".join(x for x in script.split("\n") if not re.match(r"[ \t]*\\[A-Za-z_]", x))
    out = []
    for batch in re.split(r"(?im)^[ \t]*GO[ \t]*(?:--[^\r\n]*)?(?:\r?\n|$)", script):
        text, i = "", 0
        while i < len(batch):
            rest = batch[i:]
            tag = re.match(r"\$(?:[A-Za-z_]\w*)?\$", rest, re.A)
            if rest.startswith("--"):
                n = re.search(r"[\r\n]|\Z", rest).start()
            elif rest.startswith("/*"):
                n = rest.find("*/", 2) + 2 or len(rest)
                n = n if rest.find("*/", 2) >= 0 else len(rest)
            elif tag:
                e = rest.find(tag[0], tag.end())
                n = e + len(tag[0]) if e >= 0 else len(rest)
            elif rest[0] in "'\"":
                n = 1
                while n < len(rest):
                    if rest[n] == rest[0]:
                        if rest[n + 1 : n + 2] != rest[0]:
                            break
                        n += 1
                    elif rest[n] == "\\" and rest[0] == "'":
                        n += 1
                    n += 1
                n = min(n + 1, len(rest))
            else:
                n = 1
            text += rest[:n]
            i += n
            if n == 1 and rest[0] == ";":
                out.append(text)
                text = ""
        out.append(text)
    return [s for s in (x.lstrip("﻿").strip() for x in out) if s]


def test_shapes(spark):
    assert split(spark, "DROP TABLE a; CREATE TABLE a (b INT);") == [["DROP TABLE a;", "CREATE TABLE a (b INT);"]]
    assert [len(x) for x in split(spark, "CREATE FUNCTION f() AS $$ a; b; $$;", "\\echo a; b\nCREATE TABLE x (y INT);", "A\nGO\nB\n go -- x\nC", "A\nGO 5\nB;", "", "﻿ x ", None or "")] == [1, 1, 3, 1, 0, 1, 0]
    assert split(spark, "a 'x'';' ; b '\\';' ; c \"x;\" ; /* ; /* */ d; $t$ ; $$ ; $t$ e; -- ;\nf")[0] == ["a 'x'';' ;", "b '\\';' ;", 'c "x;" ;', "/* ; /* */ d;", "$t$ ; $$ ; $t$ e;", "-- ;\nf"]


def test_what_never_ends_reaches_to_the_end(spark):
    for s in ("a 'b; c", 'a "b; c', "a /* b; c", "a $$ b; c", "a '\\"):
        assert split(spark, s) == [[s]]


def test_random_scripts_match_a_plain_scanner(spark):
    r = random.Random(11)
    parts = ["'", '"', ";", "--", "\n", "/*", "*/", "$$", "$a$", "$", "\\", "a", " ", "\r\n", "\nGO\n", "\n\\echo x\n", "é", "-", "/", "　", "x1"]
    scripts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    for s, got in zip(scripts, split(spark, *scripts), strict=True):
        assert got == scanner(s), repr(s)


def test_very_long_scripts(spark):
    long = "CREATE TABLE t (" + ", ".join(f"c{i} VARCHAR(20) DEFAULT 'a;''b'" for i in range(20_000)) + ");"
    got = split(spark, long + "\n" + "'" + "x" * 400_000 + "'; z")[0]
    assert [len(x) for x in got] == [len(long), 400_003, 1]


def test_filter(spark):
    script = "DROP TABLE a; -- c\n/* x */ CREATE TABLE a (b INT); CREATE MATERIALIZED VIEW m AS SELECT 1; CREATE INDEX i ON a (b); INSERT INTO a VALUES (1); CREATE TABLE #t (a INT); ALTER TABLE a ADD b INT; DO $$ CREATE TABLE q (); $$; CREATE TEMP TABLE z (a INT); -- CREATE TABLE"
    assert kept(spark, script) == ["CREATE TABLE a (b INT);", "CREATE MATERIALIZED VIEW m AS SELECT 1;", "ALTER TABLE a ADD b INT;", "DO $$ CREATE TABLE q (); $$;"]
    assert kept(spark, "/* CREATE TABLE a") == []


def test_null_scripts(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "CREATE VIEW v AS SELECT 1", 8)], "id int, text string, stmt_no int")
    assert [(r["id"], r["stmt_no"]) for r in S.split_scripts(df, "id").collect()] == [(2, 1)]
    assert [(r["id"], r["stmt_no"]) for r in S.kept_statements(df, "id").collect()] == [(2, 1)]
