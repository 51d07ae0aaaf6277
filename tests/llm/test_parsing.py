import ast
import json
import random
import warnings
from xml.parsers import expat

import pytest

from conftest import rows
from metaquarry.llm import parsing as P
from metaquarry.llm.gll import Grammar

SOUND = {
    "sql": [
        "",
        "-- only a comment",
        "/* a /* nested */ comment */",
        "\\echo x; 'y\nSELECT 1;",
        "CREATE TABLE a.b (c INT NOT NULL, d VARCHAR(20) DEFAULT 'x;y', CONSTRAINT p PRIMARY KEY (c)) DISTRIBUTED BY (c);",
        "CREATE TABLE a (b int[], c numeric(4, 2) NULL) WITH (appendonly=true) DISTRIBUTED RANDOMLY PARTITION BY RANGE (b) (START (date '2020-01-01') INCLUSIVE END (date '2021-01-01') EXCLUSIVE EVERY (INTERVAL '1 month'), DEFAULT PARTITION o);",
        "CREATE OR REPLACE VIEW v AS SELECT a.x, count(*) AS n, 'y' z FROM t a LEFT JOIN u b ON a.x = b.x WHERE a.y <> '--' AND (b.x IS NULL OR b.y NOT IN (1, 2)) GROUP BY a.x HAVING count(*) > 1 ORDER BY 1 DESC NULLS LAST LIMIT 5;",
        "CREATE FUNCTION f(a int, b text DEFAULT 'x') RETURNS int AS $fn$ anything ' goes; $$ $fn$ LANGUAGE plpgsql IMMUTABLE;",
        "GO\nCREATE OR ALTER PROCEDURE [dbo].[my proc] @a int = 5, @b date OUTPUT AS\nBEGIN\n SET NOCOUNT ON;\n IF @a > 1 BEGIN UPDATE t SET x = NULL WHERE y < 3 END ELSE DELETE FROM t\n EXEC dbo.q @x = 1, 'a'\nEND\nGO\n",
        "DECLARE @s nvarchar(20) = N'it''s'; EXEC (@s); EXEC sp_executesql @s",
        "WITH RECURSIVE r AS (SELECT 1 UNION ALL SELECT x + 1 FROM r) INSERT INTO t (a) SELECT * FROM r ON CONFLICT (a) DO NOTHING RETURNING *;",
        "CREATE TRIGGER g BEFORE INSERT OR UPDATE OF a, b ON t FOR EACH ROW WHEN (OLD.a IS DISTINCT FROM NEW.a) EXECUTE FUNCTION s.f();",
        "SELECT CASE WHEN a BETWEEN 1 AND 2 AND b THEN x::date ELSE CAST(y AS int) END, sum(z) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), EXTRACT(year FROM d), date '2020-01-01' FROM t, LATERAL (SELECT 1) q;",
        "GRANT SELECT, UPDATE (a) ON t TO r; COMMENT ON COLUMN a.b IS 'x'; ANALYZE t; BEGIN; COMMIT; ALTER TABLE t ADD COLUMN date date NOT NULL DEFAULT now(), DROP CONSTRAINT c;",
        "MERGE INTO t USING u ON t.a = u.a WHEN MATCHED THEN UPDATE SET b = 1 WHEN NOT MATCHED THEN INSERT (a) VALUES (1);",
    ],
    "py": [
        "",
        "x = 1\n",
        "def f(a, *b, c=1, **d) -> int:\n    '''doc'''\n    return [y for y in b if y] or {**d, 'k': 1}\n",
        "async def f():\n    async with a as b, c: await d\n    async for x in y:\n        yield x\n",
        "match x:\n    case {'a': [1, *_], **r} if r: pass\n    case A.B(c=1) | None as q:\n        pass\n",
        "try:\n    f'{a!r:>{w}} {b=}'\nexcept* (A, B) as e:\n    raise C from e\nfinally: pass\n",
        "@a.b(1)\nclass A[T](B, metaclass=M):\n    x: int = 3\n    y, *z = a[1:2, ::3], lambda *q: (yield)\n",
        "print(a if b else c, *d, **e, sep='')\nx = y = (z := 5)\ndel a[0], b.c\nglobal q\nwith (open(a) as f, g): pass\nassert x, 'm'\nfrom .a import (b as c, d,)\nmatch = type = case = 1\nx += 1\ntype X = int\n",
    ],
    "json": ["1", "[]", '{"a": [1.5e3, -0, true, null, "\\u00e9\\n"], "b": {}}', ' \n"x" '],
    "xml": ["<a/>", '<?xml version="1.0" encoding="UTF-8"?>\n<!-- c --><a b="&lt;" c=\'x\'>t &amp; &#x41;<b:d/><![CDATA[ <&> ]]><a></a></a>\n', "<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>", "<é>ü</é>"],
}
BROKEN = {
    "sql": ["SELECT", "CREATE TABLE a (b INT", "CREATE TABLE a (b INT c INT);", "CREATE TABLE a (b INT)) ;", "SELECT 'x", "SELECT 1 /* x", "<<<<<<< HEAD\nSELECT 1;\n=======\nSELECT 2;\n>>>>>>> b", '{"a": 1}', "import os\nx = 1", "# Heading\ntext", "CREATE FUNCTION f() RETURNS int AS $$ BEGIN", "UPDATE t SET", "DELETE FROM t WHERE a > 5 AND", "SELECT a b c FROM t;", "INSERT INTO t (a, b", "2024-01-01 INFO started", "CREATE TABLE a (b INT) DISTRIBUTE BY (b);", "hello world;", "SELECT x BETWEEN 1;", "CREATE VIEW v AS;"],
    "py": ["def f(:\n", "x = (1\n", "if x\n    y\n", "  x = 1\n y = 2\n", "x = 'a\n", "<<<<<<< HEAD\nx = 1\n", "SELECT 1 FROM t;", "return return", "f(a b)", "{'a': 1, 'b'}", "1 = x", "for x in:\n    pass\n", "x = '''a", "class A:\n", "else:\n    pass\n"],
    "json": ["", " ", "{", '{"a": 1,}', "[1, 2", "{'a': 1}", "[1] [2]", '{"a" 1}', "NaN", "01", '"a\nb"', '"\\x"', "tru", '{"a": 1} x', "1."],
    "xml": ["", "text", "<a>", "<a></b>", "<a><b></a></b>", "<a/><b/>", "<a b=1/>", '<a b="1" b="2"/>', "<a>&x;</a>", "<a>&</a>", " <?xml version='1.0'?><a/>", "<a><!-- -- --></a>", "<a b='<'/>", "<a", "<a>]]></a>", "x<a/>"],
}


def no_constant(name):
    raise ValueError(name)


def refused(kind, text):
    """Whether the exact reader of the language refuses the text."""
    try:
        if kind == "py":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        elif kind == "json":
            json.loads(text, parse_constant=no_constant)
        else:
            expat.ParserCreate("utf-8").Parse(text.encode("utf-8"), True)
    except (SyntaxError, ValueError, expat.ExpatError):
        return True
    return False


@pytest.mark.parametrize("kind", list(SOUND))
def test_sound_and_broken_texts(kind):
    for t in SOUND[kind]:
        assert P.recognised(kind, t), t
        assert kind == "sql" or not refused(kind, t), t
    for t in BROKEN[kind]:
        assert not P.recognised(kind, t), t
        assert kind == "sql" or refused(kind, t), t


@pytest.mark.parametrize("kind", ["py", "json", "xml"])
def test_cut_and_mixed_texts_agree_with_the_exact_readers(kind):
    r = random.Random(8)
    # Declarations within a DOCTYPE are read in outline only.
    pool = [t for t in SOUND[kind] if t and "DOCTYPE" not in t]
    for _ in range(600):
        t = r.choice(pool)
        a, b = sorted((r.randint(0, len(t)), r.randint(0, len(t))))
        t = r.choice([t[:b], t[:a] + t[b:], t[:a] + r.choice(["(", ")", "<", '"', ",", "}", " ", "\n"]) + t[a:]])
        assert P.recognised(kind, t) != refused(kind, t), repr(t)


def test_modules_of_the_language_itself_are_sound():
    for m in (ast, json, random, warnings, pytest):
        with open(m.__file__, encoding="utf-8") as f:
            assert P.recognised("py", f.read()), m.__file__


def test_references_of_a_doctype():
    assert P.recognised("xml", "<!DOCTYPE a [<!ENTITY e 'x'>]><a b='&e;'>&e;&lt;&#65;</a>")
    assert not P.recognised("xml", "<!DOCTYPE a [<!ENTITY e 'x'>]><a>&f;</a>") and not P.recognised("xml", "<!DOCTYPE a><a>R & D</a>")
    assert not P.recognised("xml", "<!-- <!DOCTYPE --><a>R & D</a>") and P.recognised("xml", "<!DOCTYPE a SYSTEM 'x.dtd'><a>&f;</a>")


def test_readers_of_tokens_that_have_to_be_closed():
    assert P.recognised("sql", "SELECT $q$ $$ ' /* $q$, $$ /* $$ /* a /* b */ $q$ */;\n  go 5\nSELECT go FROM t\nGO")
    assert not P.recognised("sql", "SELECT $q$ x $$") and not P.recognised("sql", "SELECT 1 /* /* */") and not P.recognised("sql", "SELECT 1 GO SELECT 12ab")


def test_the_recogniser_follows_every_way():
    g = Grammar("s: e ; e: e '+' e | 'a' | '(' e ')' ;", "s")
    word = lambda w: g.accepts([g.kinds[c] for c in w])[0]
    assert word("a") and word("a+a+(a+a)+a") and not word("a+") and not word("") and not word("a+a)") and word("(((a)))")
    g = Grammar("s: b* 'x'? b ; b: 'x' | 'x' 'x' ;", "s")
    assert [g.accepts([g.kinds["x"]] * n)[0] for n in range(6)] == [False, True, True, True, True, True]
    g = Grammar("s: e ; e: f ('+' f)* ; f: 'a' | w | '(' e ')' ; w: 'b' 'b' ;", "s", "e")
    assert word("a+bb+(a+bb)") and not word("a+b") and not word("bb+")
    pair = g.kind("a", "b")
    assert g.accepts([pair, pair, g.kinds["+"], pair])[0] and not g.accepts([pair] * 3)[0]
    g = Grammar("s: a? b* ; a: 'x' ; b: 'y' ;", "s")
    assert g.accepts([])[0] and g.accepts([g.kinds["y"]])[0]


def test_deep_nesting_ends():
    assert P.recognised("json", "[" * 3000 + "]" * 3000) and not P.recognised("json", "[" * 3000)
    assert P.recognised("sql", "SELECT " + "(" * 400 + "1" + ")" * 400 + ";")


FILE = "file_id long, system_name string, relative_path string, content string, language string, broken string"


def files(spark, data):
    return spark.createDataFrame([(i, s, p, c, "x", "y") for i, s, p, c in data], FILE)


DATA = [(1, "s", "a/b.bak.SQL", "SELECT 1;"), (2, "s", "a.v2.sql", "SELECT"), (2, "s", "a.v2.sql", "SELECT"), (3, "s", "x.JSON", "{"), (4, "t", "x.txt", "{"), (5, "t", "x.py", None), (6, "t", "x.xml", ""), (None, "t", "x.xml", ""), (7, None, "noext", "x"), (8, None, "y.py", "x ="), (9, "t", None, "x ="), (10, "t", "q.py", "")]


def test_tables(spark):
    assert rows(P.broken_files(files(spark, DATA))) == sorted([(2,), (3,), (6,), (8,)])
    assert rows(P.broken_rates(files(spark, DATA))) == [(None, "py", 1, 1, 1.0), ("s", "json", 1, 1, 1.0), ("s", "sql", 2, 1, 0.5), ("t", "py", 1, 0, 0.0), ("t", "xml", 1, 1, 1.0)]
    told = spark.createDataFrame([("s", "a.v2.sql"), ("s", "a.v2.sql"), ("s", "a/b.bak.SQL"), (None, "y.py"), ("s", None)], "system_name string, relative_path string")
    assert [r for r in rows(P.report_gaps(files(spark, DATA), told)) if r[1] == "sql"] == [("s", "sql", 1, 1, 1)]
    assert rows(P.broken_files(files(spark, []))) == []
