"""A platform configuration's dictionary against the names that queries use: joins, not lookups.

Objects: kind, name, register_type. Attributes: kind, name, attribute_kind, attribute. References: id, kind, name, ...
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Kinds of objects, in the language of the platform.
KINDS = (
    "Справочник", "Документ", "РегистрСведений", "РегистрНакопления", "РегистрБухгалтерии", "РегистрРасчета", "ПланВидовХарактеристик", "ПланСчетов", "ПланВидовРасчета", "Перечисление", "Константа",
    "ЖурналДокументов", "БизнесПроцесс", "Задача", "ПланОбмена", "Последовательность",
)
REFERENCE = rf"(?Ui)(?<![\w.])({'|'.join(KINDS)})\.(\w+)(?:\.(\w+))?"
MOST_EDITS, MOST_NAMES = 3, 5


def references(queries: DataFrame, text: str = "text") -> DataFrame:
    """id, kind, name, member of each object that a query text names."""
    found = [F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(i)) for i in (1, 2, 3)]
    rows = queries.select("id", F.explode(F.arrays_zip(*(f.alias(n) for f, n in zip(found, ("kind", "name", "member"), strict=True)))).alias("r"))
    return rows.select("id", "r.kind", "r.name", F.nullif("r.member", F.lit("")).alias("member"))


def missing_objects(refs: DataFrame, objects: DataFrame) -> DataFrame:
    known = objects.select(F.lower("kind").alias("_k"), F.lower("name").alias("_n"))
    return refs.select("id", "kind", "name").distinct().join(known, (F.lower("kind") == F.col("_k")) & (F.lower("name") == F.col("_n")), "left_anti")


def missing_members(refs: DataFrame, members: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """References to a member (attribute, enumeration value, predefined item, dimension) that its object hasn't; objects
    without any member in the table aren't judged."""
    own = members.select(F.lower("kind").alias("_k"), F.lower("name").alias("_n"), F.lower("member").alias("_m"))
    same = (F.lower("kind") == F.col("_k")) & (F.lower("name") == F.col("_n"))
    judged = refs.where(F.col("member").isNotNull() & ~F.lower("member").isin(*(a.lower() for a in allowed)) if allowed else F.col("member").isNotNull()).join(own.select("_k", "_n").distinct(), same, "left_semi")
    return judged.join(own, same & (F.lower("member") == F.col("_m")), "left_anti").distinct()


def suggestions(wrong: DataFrame, known: DataFrame, most_edits: int = MOST_EDITS, most_names: int = MOST_NAMES) -> DataFrame:
    """id, kind, name, known, distance: the nearest known names of the same kind, the report's first few.

    A name within e edits of another shares one of the e + 1 parts that it falls into, moved by e at most; so the join is on
    equal parts, not on all pairs of a kind. Names of up to e letters, which have empty parts, meet by their kind and length.
    Each name is matched once, however many ids have it.
    """
    e = most_edits
    low = F.lower("_x")

    def part(i: int, size):
        begin = F.floor(size * i / (e + 1))
        return begin, F.floor(size * (i + 1) / (e + 1)) - begin

    right = known.select("kind", F.col("name").alias("known"), F.col("name").alias("_x")).distinct()
    pieces = F.array(*(F.struct(F.lit(i).alias("i"), F.length(low).alias("size"), F.substring(low, part(i, F.length(low))[0].cast("int") + 1, part(i, F.length(low))[1].cast("int")).alias("piece")) for i in range(e + 1)))
    index = right.select("kind", "known", F.explode(pieces).alias("p")).select("kind", "known", "p.*")
    left = wrong.select("kind", "name", F.col("name").alias("_x")).distinct()
    tries = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(d).alias("d"), F.lit(s).alias("s")) for i in range(e + 1) for d in range(-e, e + 1) for s in range(-e, e + 1)))
    probes = left.select("kind", "name", "_x", F.explode(tries).alias("t")).select("kind", "name", "_x", "t.i", "t.s", (F.length(low) + F.col("t.d")).alias("size"))
    begin, n = part(F.col("i"), F.col("size"))
    piece = F.substring(low, (begin + 1 + F.col("s")).cast("int"), n.cast("int"))
    # A part cut short equals none, and an empty one is the same wherever it is.
    fits = (F.col("size") >= 0) & (begin + 1 + F.col("s") > 0) & (F.length("piece") == n) & ((n > 0) | (F.col("s") == 0))
    probes = probes.withColumn("piece", piece).where(fits).select("kind", "name", "i", "size", "piece")
    met = probes.join(index, ["kind", "i", "size", "piece"]).select("kind", "name", "known").distinct()
    near = met.withColumn("distance", F.levenshtein(F.lower("name"), F.lower("known"))).where((F.col("distance") <= e) & (F.col("distance") > 0))
    place = F.row_number().over(Window.partitionBy("kind", "name").orderBy("distance", "known"))
    first = near.withColumn("_n", place).where(F.col("_n") <= most_names).groupBy("kind", "name").agg(F.collect_list(F.struct("known", "distance")).alias("_first"))
    found = wrong.select("id", "kind", "name").distinct().join(first, ["kind", "name"])
    return found.select("id", "kind", "name", F.explode("_first").alias("_f")).select("id", "kind", "name", "_f.*")
