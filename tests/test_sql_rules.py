"""Long statements, odd texts and the tokens themselves; what rules find over whole tables is in test_oracles.py."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tracelake.functions import text as tx
from tracelake.functions.sql_tokens import Statement
from tracelake.operators import rules as ru
from tracelake.operators import sql_rules as sr

LONG = {
    "in list": "SELECT a FROM t WHERE b IN (" + ", ".join(map(str, range(30_000))) + ")",
    "literals": "SELECT a FROM t WHERE b IN (" + ", ".join(f"'{i}'" for i in range(20_000)) + ")",
    "brackets": "SELECT a FROM t WHERE " + "(" * 60_000 + "a" + ")" * 60_000 + " = 1",
    "quotes": "SELECT '" + "''" * 90_000 + "'",
    "ors": "SELECT a FROM t WHERE " + " OR ".join(["a=1"] * 25_000),
    "joins": "SELECT a FROM t " + " ".join(f"LEFT JOIN u{i} ON u{i}.a = t.a" for i in range(5_000)) + " WHERE t.a = 1",
    "comments": "SELECT 1 " + "/* " * 30_000 + "*/" * 30_000,
    "queries": "SELECT " + "(SELECT " * 19_000 + "t.a" + ")" * 19_000 + " FROM t",
    "cases": "SELECT a FROM t WHERE " + "CASE WHEN a = 1 THEN " * 7_000 + "1" + " END" * 7_000,
    "open quote": "SELECT a FROM t WHERE b = 'x" + "''y" * 60_000,
}


@pytest.mark.parametrize("engine", ["mssql", "postgres"])
@pytest.mark.parametrize("name", LONG)
def test_long_statements_take_linear_time(engine, name):
    text = LONG[name]
    assert len(text) <= sr.LONGEST
    began = time.process_time()
    found = {f[0] for f in sr.findings_of(text, engine)}
    sr.is_safe(text)
    assert time.process_time() - began < 5
    assert (name == "open quote") == ("parse_error" in found)
    assert (name in ("in list", "literals") and engine == "mssql") == ("large_in_list" in found)


def test_long_statements_in_columns(spark):
    rows = [(i, t) for i, t in enumerate(LONG.values())] + [(100, None), (101, ""), (102, "SELECT 1; " * 30_000)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    got = df.select("id", tx.normalize_sql(F.col("text")).alias("n"), tx.unwrap_executesql(F.concat(F.lit("exec sp_executesql N'"), F.replace(F.col("text"), F.lit("'"), F.lit("''")), F.lit("'"))).alias("u"), ru.blanked(F.col("text")).alias("b"), ru.safe_to_explain(F.col("text")).alias("s"), "text").collect()
    for r in got:
        assert not r.text or (r.u == r.text and len(r.b) == len(r.text))
    normal = {r.id: r.n for r in got}
    assert normal[0].startswith("SELECT a FROM t WHERE b IN (?, ?,") and normal[3] == "SELECT ?" and len(normal[2]) == len(LONG["brackets"])
    assert {r.id for r in ru.sql_findings(df, "mssql").where("rule = 'large_in_list'").collect()} == {0, 1}
    assert ru.sql_findings(df, "mssql").where("id >= 100").count() == 0


def test_normal_form_is_that_of_the_plain_pattern(spark):
    """The possessive form gives what the form that goes back does, also where a literal has no end."""
    r = random.Random(4)
    texts = ["".join(r.choice("'''aN n1.x@P") for _ in range(r.randint(0, 14))) for _ in range(3000)]
    pairs = [(p.replace("*+", "*").replace("(?U)", "").replace("(?=')", ""), v) for p, v in tx.SQL_LITERALS]

    def plain(t):
        for p, v in pairs:
            t = re.sub(p, v, t)
        return re.sub(r"\s+", " ", t).strip()

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.normalize_sql(F.col("t")).alias("n")).collect()
    assert [(x.t, x.n) for x in got if x.n != plain(x.t)] == []


def test_tokens():
    s = Statement("SELECT [a]]b], N'it''s', 0x1F, 1.5e3, @p1 FROM #t -- x\nWHERE (a >= 1 /* ( */)", "mssql")
    assert list(zip(s.kind, s.word)) == [
        ("word", "SELECT"), ("name", "A]]B"), ("sign", ","), ("text", "N'it''s'"), ("sign", ","), ("number", "0x1F"), ("sign", ","), ("number", "1.5e3"), ("sign", ","), ("parameter", "@p1"),
        ("word", "FROM"), ("word", "#T"), ("word", "WHERE"), ("sign", "("), ("word", "A"), ("sign", ">="), ("number", "1"), ("sign", ")"),
    ]
    assert all(s.text[a:z].upper() == w.upper() for a, z, w, k in zip(s.start, s.end, s.word, s.kind) if k != "name")
    assert s.clause[-1] == "WHERE" and s.where[14] and not s.failed
    p = Statement("SELECT a[1], b::int, $1, :x, c ?| d, e->>'f' FROM t WHERE g IN (WITH h AS (SELECT 1) SELECT * FROM h)")
    assert ("sign", "::") in zip(p.kind, p.word) and ("parameter", "$1") in zip(p.kind, p.word) and ("sign", "?|") in zip(p.kind, p.word) and ("sign", "->>") in zip(p.kind, p.word)
    assert [q.verb for q in p.queries] == ["SELECT", "SELECT", "SELECT"] and p.queries[2].above == 1 and all(p.where[k] for k in p.queries[2].own)


def test_any_text_has_tokens():
    r = random.Random(9)
    parts = ["'", '"', "[", "]", "(", ")", "--", "/*", "*/", "\n", " ", "$$", "$q$", "E'", "\\", "SELECT", "FROM", "t", "WHERE", "LEFT", "JOIN", "u", ".", "x", "=", "UNION", "IN", ",", "CASE", "END", "OR", "::", "AS", "UPDATE", "SET", ";", "1", "*", "TOP", "WITH", "ORDER", "BY", "random", "OFFSET", "é", "LIKE", "'%a'", "DELETE"]
    for _ in range(4000):
        text = " ".join(r.choice(parts) for _ in range(r.randint(1, 25)))
        for engine in ("mssql", "postgres"):
            for f in sr.findings_of(text, engine):
                assert 0 <= f[2] <= f[3] <= len(text)
                f[4].place(f[2])
        sr.is_safe(text)
