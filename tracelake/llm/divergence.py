"""How far the sources of a language differ in their words: wide term vectors and the pairs of their entries.

Terms are counted per batch in Arrow, then once per (language, source, term). Each term that enough documents of its language
have becomes one array with an entry per source of the language; higher-order functions turn it into the contributions of all
pairs of entries, which partial aggregation sums before anything is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffer_of, read, whole_text, written

#: Letters of ASCII and all that isn't ASCII, as UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
LEAST_DOCUMENTS = 10
TOP = 10
SCALE = 1_000_000_000
#: A task that holds so many terms passes its counts on; it looks each time it has read so many bytes.
HELD_TERMS, HELD_BYTES = 500_000, 8 << 20
#: Tables of at most so many (language, source) groups are broadcast; beyond, languages are joined by salted keys.
FEW_GROUPS, SALTS = 100_000, 64


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), documents: what each task has counted, a row or few for a group's term."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, list] = {}
        size = 0

        def passed_on() -> pa.RecordBatch:
            langs, sources, terms, n, documents = [], [], [], [], []
            for (lang, source), (seen, within) in groups.items():
                langs += [lang] * len(seen)
                sources += [source] * len(seen)
                terms += seen
                n += seen.values()
                documents += map(within.__getitem__, seen)
            groups.clear()
            columns = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(documents, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "documents"])

        for batch in batches:
            data, at = buffer_of(batch.column(2))
            raw = data.tobytes().lower()  # of bytes: A to Z only
            at = at.tolist()
            for key, a, z in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), at[:-1], at[1:], strict=True):
                group = groups.get(key) or groups.setdefault(key, (Counter(), Counter()))
                terms = TERM.findall(raw, a, z)
                group[0].update(terms)
                group[1].update(set(terms))
                size += z - a
                if size >= HELD_BYTES:
                    size = 0
                    if sum(len(seen) for seen, _ in groups.values()) >= HELD_TERMS:
                        yield passed_on()
            del raw
        if groups:
            yield passed_on()

    return docs.select(*_group(), whole_text().alias("text")).mapInArrow(step, "lang string, source string, term string, n long, documents long")


def _group() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def _share(count: str, of: str) -> str:
    """1 + floor(SCALE * (count + 2) / (of + 2 V)), exact for counts of any size."""
    return f"1L + CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 2 AS DECIMAL(20, 0)) DIV CAST({of} + 2 * v AS DECIMAL(20, 0))"


def _apart(p: str, q: str) -> str:
    return f"({p} - {q}) * ({p} - {q}) DIV ({p} + {q})"


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int | None = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language, and by which terms it differs from the language.

    Part ``pair`` has a row per other source, part ``term`` the ``top`` terms (all with None) that the source has a greater share of
    than its language. A term counts if ``least_documents`` rows of its language have it. Null text, lang and source are read
    as empty. Repeated rows count as often as they are there. Texts of any length are taken whole. Equal values rank by the item's
    bytes. Sources without terms, and languages without kept ones, still have their pairs, of value 0 there. A language with one
    source has no pairs. Other columns are left out. No rows give no rows. An array has an entry per source of the language, and
    the pairs are as many as the sources squared, which is what is asked for.
    """
    numbered = Window.partitionBy("lang").orderBy("source")
    groups = written(docs.select(*_group()).distinct().withColumn("at", F.row_number().over(numbered) - 1))
    few = groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    small = F.broadcast if few else lambda table: table
    # One shuffle, by language and term, for the sums per source and for the arrays: tasks have summed up what they read.
    placed = counts(docs).join(small(groups), ["lang", "source"]).select("lang", "at", "term", "n", "documents").repartition("lang", "term")
    counted = placed.groupBy("lang", "term", "at").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    kept = counted.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.collect_list(F.struct("at", "n")).alias("found"))
    kept = written(kept.where(F.col("documents") >= least_documents).select("lang", "term", "found"))

    inside = kept.select("lang", F.explode("found").alias("x")).groupBy("lang", F.col("x.at").alias("at")).agg(F.sum("x.n").alias("n"))
    sums = groups.join(small(inside), ["lang", "at"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))).alias("all"))
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    per_lang = sums.join(vocabulary, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.expr("transform(all, x -> x.n)").alias("sums"))
    pairs = "flatten(transform(sequence(0, size(sums) - 2), i -> transform(sequence(i + 1, size(sums) - 1), j -> struct(i, j))))"
    pairs = F.expr(f"IF(size(sums) > 1, {pairs}, array())")
    per_lang = written(per_lang.withColumns({"total": F.expr("aggregate(sums, 0L, (s, x) -> s + x)"), "pairs": pairs}))

    if few:
        wide = kept.join(F.broadcast(per_lang), "lang")
    else:
        salted = per_lang.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        wide = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    # The source-indexed array: the entries in order, zeros between them.
    filled = "aggregate(sort_array(found), array(), (a, x) -> concat(a, array_repeat(0L, x.at - size(a)), array(x.n)), a -> concat(a, array_repeat(0L, size(sums) - size(a))))"
    wide = wide.withColumn("counts", F.expr(filled.replace("array()", "CAST(array() AS ARRAY<BIGINT>)")))
    wide = wide.withColumn("p", F.expr(f"transform(counts, (c, i) -> {_share('c', 'sums[i]')})"))
    # Written, so that nothing computes an array again for each of its pairs.
    wide = written(wide.select("lang", "term", "counts", "p", F.expr(_share("aggregate(counts, 0L, (s, x) -> s + x)", "total")).alias("q")))

    # A contribution for each pair of the language, in the pairs' order; a language without terms has zeros.
    each = f"flatten(transform(sequence(0, size(p) - 2), i -> transform(slice(p, i + 2, size(p)), x -> {_apart('p[i]', 'x')})))"
    values = wide.where("size(p) > 1").select("lang", F.expr(each).alias("values"))
    values = values.unionByName(per_lang.select("lang", F.expr("transform(pairs, x -> 0L)").alias("values")))
    summed = values.select("lang", F.posexplode("values").alias("pair", "value")).groupBy("lang", "pair").agg(F.sum("value").alias("value"))
    named = per_lang.select("lang", F.posexplode("pairs").alias("pair", "x"))
    both = summed.join(small(named), ["lang", "pair"]).select("lang", F.explode(F.expr("array(struct(x.i AS at, x.j AS other), struct(x.j AS at, x.i AS other))")).alias("x"), "value").select("lang", "x.*", "value")
    others = groups.select("lang", F.col("at").alias("other"), F.col("source").alias("item"))
    of_pairs = both.join(small(others), ["lang", "other"]).select("lang", "at", F.lit("pair").alias("part"), "item", "value")

    above = "filter(transform(p, (x, i) -> struct(i AS at, x AS p, counts[i] AS n)), x -> x.n > 0 AND x.p > q)"
    of_terms = wide.select("lang", "term", "q", F.explode(F.expr(above)).alias("x"))
    of_terms = of_terms.select("lang", "x.at", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_apart("x.p", "q")).alias("value"))
    ordered = Window.partitionBy("lang", "at").orderBy(F.col("value").desc(), "item")
    of_terms = ranked(of_terms, ordered)
    if top is not None:
        of_terms = of_terms.where(F.col("rank") <= top)  # a limit per task before the shuffle, and one after it
    found = ranked(of_pairs, ordered).unionByName(of_terms)
    return found.join(small(groups), ["lang", "at"]).select("lang", "source", "part", "item", "value", "rank")


def ranked(rows: DataFrame, window: Window) -> DataFrame:
    rank: Column = F.row_number().over(window)
    return rows.withColumn("rank", rank)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLES = {
    "op13_source_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(DISTINCT k.term)::HUGEINT AS v FROM g LEFT JOIN k USING (lang) GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN k USING (lang)
      LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM c JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)), 0) AS value
          FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
          LEFT JOIN p a ON a.lang = g.lang AND a.source = g.source LEFT JOIN p b ON b.lang = h.lang AND b.source = h.source AND b.term = a.term GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= 10
"""
}
