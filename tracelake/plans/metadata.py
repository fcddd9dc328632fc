"""Queries of the checks against a configuration. The dictionary is made of the parts' sizes n, the texts of the events' numbers k, so
that some of what a text names is there and some isn't."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary as di
from ..operators import metadata as me

OBJECTS = {
    "Справочник": ("Товар", "null"), "РегистрНакопления": ("Остаток", "if(n % 2 = 0, 'Balance', 'Turnovers')"), "РегистрСведений": ("Цены", "null"), "Константа": ("Предел", "null"), "Перечисление": ("Вид", "null"),
}
MEMBERS = [
    ("Справочник", "attribute", "concat('Цена', n % 3)", "true"), ("Справочник", "attribute", "'Вид'", "true"), ("Справочник", "tabular_section", "'Состав'", "true"), ("Справочник", "predefined", "concat('Основной', n % 2)", "n % 4 <> 0"),
    ("РегистрНакопления", "dimension", "concat('Склад', n % 2)", "true"), ("РегистрНакопления", "resource", "concat('Количество', n % 2)", "true"), ("Перечисление", "enum_value", "concat('Опт', n % 5)", "true"),
]
#: {k}, {a} = k % 4, {b} = k % 3, {c} = k % 7, {f}: a resource where k % 5 = 0, else a dimension.
TEXT = (
    "ВЫБРАТЬ Т.Цена{a}, Т.Код, Т.Состав, ВЫРАЗИТЬ(Т.Вид КАК Справочник.Товар{k})\nИЗ Справочник.Товар{k} КАК Т\n"
    "ЛЕВОЕ СОЕДИНЕНИЕ РегистрНакопления.Остаток{k}.Остатки(, {f} = 1) КАК О ПО ИСТИНА\n"
    "ГДЕ Т.Вид = ЗНАЧЕНИЕ(Справочник.Товар{k}.Основной{b}) ИЛИ Т.Вид = ЗНАЧЕНИЕ(Перечисление.Вид{k}.Опт{c}) ИЛИ Константа.Предел{k}.Поле > 0 ИЛИ Справочники.Товар{k}.Код = 1"
)


def _sizes(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").alias("n")).distinct()


def objects(spark, sf_dir):
    cells = F.array(*(F.struct(F.lit(k).alias("kind"), F.concat(F.lit(name), "n").alias("name"), F.expr(f"cast({kind} as string)").alias("register_type")) for k, (name, kind) in OBJECTS.items()))
    return _sizes(spark, sf_dir).select(F.explode(cells).alias("o")).select("o.*")


def members(spark, sf_dir):
    cells = F.array(*(F.when(F.expr(where), F.struct(F.lit(k).alias("kind"), F.concat(F.lit(OBJECTS[k][0]), "n").alias("name"), F.lit(kind).alias("member_kind"), F.expr(member).alias("member"))) for k, kind, member, where in MEMBERS))
    return _sizes(spark, sf_dir).select(F.explode(F.array_compact(cells)).alias("m")).select("m.*")


def texts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    field = F.when(F.col("k") % 5 == 0, F.concat(F.lit("Количество"), F.col("k") % 2)).otherwise(F.concat(F.lit("Склад"), F.col("k") % 3))
    out = F.lit(TEXT)
    for place, value in (("{k}", F.col("k")), ("{a}", F.col("k") % 4), ("{b}", F.col("k") % 3), ("{c}", F.col("k") % 7), ("{f}", field)):
        out = F.replace(out, F.lit(place), value.cast("string"))
    return e.select("id", out.alias("text"))


K = "WITH e AS (SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), p AS (SELECT DISTINCT p_size AS n FROM part) "
HAS, HASNT = "k IN (SELECT n FROM p)", "k NOT IN (SELECT n FROM p)"
FIELD = "CASE WHEN k % 5 = 0 THEN 'Количество' || (k % 2) ELSE 'Склад' || (k % 3) END"
AT = TEXT.replace("{a}", "0").index("Справочник")
PLACES = "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


def _text_sql() -> str:
    """A text of number k, as SQL."""
    out = "'" + TEXT.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for place, value in (("{k}", "k"), ("{a}", "k % 4"), ("{b}", "k % 3"), ("{c}", "k % 7"), ("{f}", FIELD)):
        out = f"replace({out}, '{place}', ({value})::VARCHAR)"
    return out


def _at(word: str) -> str:
    """Where a word is first, from 0."""
    return f"(strpos({_text_sql()}, '{word}') - 1)::INT AS start"



STEMS = "('Справочник', 'Товар'), ('РегистрНакопления', 'Остаток'), ('Перечисление', 'Вид'), ('Константа', 'Предел')"
QUERIES = {
    "t11_objects": lambda s, d: me.named(texts(s, d), "object").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("raw_kind") != F.col("kind")).alias("plurals"), F.min("start").cast("long").alias("first")),
    "t12_virtual_tables": lambda s, d: me.named(texts(s, d), "virtual_table").select("id", "kind", "name", "virtual_table"),
    "t13_cast_types": lambda s, d: me.named(texts(s, d), "cast_type").select("id", "kind", "name"),
    "m1_missing_objects": lambda s, d: di.missing_objects(me.named(texts(s, d), "object"), objects(s, d)),
    "m1_suggestions": lambda s, d: di.suggestions(di.missing_objects(me.named(texts(s, d), "object"), objects(s, d)), objects(s, d)),
    "m2_misspelt_kinds": lambda s, d: me.misspelt_kinds(texts(s, d)),
    "m3_virtual_tables": lambda s, d: me.unsupported_virtual_tables(texts(s, d), objects(s, d)),
    "m4_cast_types": lambda s, d: me.missing_cast_types(texts(s, d), objects(s, d)),
    "m5_dimensions": lambda s, d: me.missing_dimensions(texts(s, d), objects(s, d), members(s, d)),
    "m6_missing_members": lambda s, d: di.missing_members(me.named(texts(s, d), "value").where("kind = 'Перечисление'").select("id", "kind", "name", "member"), members(s, d)),
    "m7_attributes": lambda s, d: me.missing_attributes(texts(s, d), objects(s, d), members(s, d)),
    "m8_resources": lambda s, d: me.resources_as_dimensions(texts(s, d), objects(s, d), members(s, d)),
    "m10_predefined": lambda s, d: me.missing_predefined(texts(s, d), members(s, d)),
    "m11_constants": lambda s, d: me.constants_with_fields(texts(s, d), objects(s, d)),
}
ORACLES = {
    "t11_objects": K + f"SELECT id, 7::BIGINT AS n, 1::BIGINT AS plurals, {AT}::BIGINT AS first FROM e",
    "t12_virtual_tables": K + "SELECT id, 'РегистрНакопления' AS kind, 'Остаток' || k AS name, 'Остатки' AS virtual_table FROM e",
    "t13_cast_types": K + "SELECT id, 'Справочник' AS kind, 'Товар' || k AS name FROM e",
    "m1_missing_objects": K + f", o AS (SELECT * FROM (VALUES ('Справочник', 'Товар'), ('РегистрНакопления', 'Остаток'), ('Перечисление', 'Вид'), ('Константа', 'Предел')) AS t(kind, stem)) SELECT id, kind, stem || k AS name FROM e, o WHERE {HASNT}",
    "m1_suggestions": K + f", o AS (SELECT * FROM (VALUES {STEMS}) AS t(kind, stem)), w AS (SELECT id, kind, stem, stem || k AS name FROM e, o WHERE {HASNT}),"
    " m AS (SELECT id, kind, name, stem || n AS known, levenshtein(lower(name), lower(stem || n))::INT AS distance FROM w, p)"
    " SELECT * FROM m WHERE distance <= 3 QUALIFY row_number() OVER (PARTITION BY id, kind, name ORDER BY distance, known) <= 5",
    "m2_misspelt_kinds": K + f"SELECT id, 'Справочники' AS raw_kind, 'Справочник' AS kind, 'Товар' || k AS name, {_at('Справочники.')} FROM e",
    "m3_virtual_tables": K + f"SELECT id, 'РегистрНакопления' AS kind, 'Остаток' || k AS name, 'Остатки' AS virtual_table, {_at('РегистрНакопления')} FROM e WHERE {HAS} AND k % 2 = 1",
    "m4_cast_types": K + f"SELECT id, 'Справочник' AS kind, 'Товар' || k AS name, {_at('ВЫРАЗИТЬ')} FROM e WHERE {HASNT}",
    "m5_dimensions": K + f"SELECT id, 'РегистрНакопления' AS kind, 'Остаток' || k AS name, {FIELD} AS field, {_at('РегистрНакопления')} FROM e WHERE {HAS} AND (k % 5 = 0 OR k % 3 <> k % 2)",
    "m6_missing_members": K + f"SELECT DISTINCT id, 'Перечисление' AS kind, 'Вид' || k AS name, 'Опт' || (k % 7) AS member FROM e WHERE {HAS} AND k % 7 <> k % 5",
    "m7_attributes": K + f"SELECT id, 'Справочник' AS kind, 'Товар' || k AS name, 'Т' AS alias, 'Цена' || (k % 4) AS field, {_at('Т.Цена')} FROM e WHERE {HAS} AND k % 4 <> k % 3",
    "m8_resources": K + f"SELECT id, 'РегистрНакопления' AS kind, 'Остаток' || k AS name, {FIELD} AS field, {_at('РегистрНакопления')} FROM e WHERE {HAS} AND k % 5 = 0",
    "m10_predefined": K + f"SELECT id, 'Справочник' AS kind, 'Товар' || k AS name, 'Основной' || (k % 3) AS member, {_at('ЗНАЧЕНИЕ')} FROM e WHERE {HAS} AND k % 4 <> 0 AND k % 3 <> k % 2",
    "m11_constants": K + f"SELECT id, 'Предел' || k AS name, 'Поле' AS field, {_at('Константа')} FROM e WHERE {HAS}",
}
