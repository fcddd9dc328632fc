"""Rows made of texts: each text read once in a batch, whole batches of any size."""

import pytest

from tracelake.operators import metadata, sql_rules, text_rows


def test_texts_are_read_once(spark, tmp_path):
    def found(text):
        with (tmp_path / "read").open("a") as f:
            f.write(f"{text}\n")
        return [(text, n) for n in range(len(text or ""))]

    texts = spark.range(0, 3000, 1, 1).selectExpr("cast(id as int) AS id", "element_at(array('a', null, '', 'xyz'), cast(id % 4 + 1 as int)) AS text")
    out = text_rows.once_a_text(texts, found, "text string, n int")
    assert out.dtypes == [("id", "int"), ("text", "string"), ("n", "int")]
    want = [(i, "a", 0) for i in range(0, 3000, 4)] + [(i, "xyz", n) for i in range(3, 3000, 4) for n in range(3)]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert sorted((tmp_path / "read").read_text().split("\n")) == ["", "", "None", "a", "xyz"]


@pytest.mark.parametrize("most", [1, 7, 50_000])
def test_large_batches_are_cut(spark, monkeypatch, most):
    texts = spark.range(0, 100, 1, 1).selectExpr("id", "repeat('x', cast(id % 3 as int)) AS text")
    monkeypatch.setattr(text_rows, "MOST_ROWS", most)
    out = text_rows.once_a_text(texts, lambda t: [(n,) for n in range(len(t))], "n int")
    assert [tuple(r) for r in out.collect()] == [(i, n) for i in range(100) for n in range(i % 3)]


def test_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (None, "SELECT * FROM t CROSS JOIN u"), (3, ""), (4, "SELECT * FROM t CROSS JOIN u"), (5, "(")], "id int, text string")
    found = sorted(map(tuple, sql_rules.sql_findings(rows, "mssql").collect()), key=str)
    two = [("cross_join", "Critical"), ("select_star", "Minor")]
    assert found == sorted([(i, *f) for i in (None, 4) for f in two] + [(5, "parse_error", "Info")], key=str)
    places = sql_rules.placed_sql_findings(rows, "mssql").where("rule = 'cross_join'").select("id", "start", "snippet").collect()
    assert {tuple(r) for r in places} == {(None, 16, "CROSS JOIN"), (4, 16, "CROSS JOIN")}
    texts = rows.selectExpr("id", "if(id = 4, null, 'ИЗ Справочники.Товары') AS text").where("id IS NOT NULL")
    assert {(r.id, r.raw_kind, r.kind, r.name, r.start) for r in metadata.misspelt_kinds(texts).collect()} == {(i, "Справочники", "Справочник", "Товары", 3) for i in (1, 3, 5)}
