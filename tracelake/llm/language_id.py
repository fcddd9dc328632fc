"""Language identification of web pages by Bayesian fusion of four kinds of evidence.

* text: naive Bayes over hashed byte trigrams, counted over all documents with a known language, of which there may be any number;
* the language that the markup declares and the suffix of the host's name: how often each goes with each language is
  counted over all pages, by the text's posterior;
* the host: a prior smoothed towards that of its domain, which is smoothed towards all pages, from grouped sums of
  the text's posteriors; a page's own share is taken out of its host's sums.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, pieces, read, whole_text, written

SLOTS = 1 << 15
#: Languages whose counts a task holds, and whose model is fetched and broadcast (8 MB), at one time.
AT_ONCE = 64
#: Neighbouring trigrams overlap: their logarithms count for less than independent ones would.
TEMPER = 0.2
KAPPA = 4.0
MARKUP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;")


def _slots(data: np.ndarray) -> np.ndarray:
    low = data.astype(np.int64)
    return ((low[:-2] * 961 + low[1:-1] * 31 + low[2:]) * 2654435761 >> 7) % SLOTS


def trigram_counts(docs: DataFrame) -> DataFrame:
    """lang, slot, n: how often each trigram slot occurs in the documents of each known language; a language without any has slot null."""

    def step(batches):
        held: dict[str, np.ndarray] = {}

        def counts():
            for lang, n in held.items():
                slot = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(slot) + 1)), pa.array([None, *slot.tolist()], pa.int32()), pa.array(np.append(0, n[slot]))], ["lang", "slot", "n"])
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = pa.array([t.lower().encode() for t in batch.column(1).to_pylist()], pa.binary())
            for lang in sorted(set(langs.tolist())):
                data, at = buffer_of(texts.filter(pa.array(langs == lang)))
                n = held.setdefault(lang, np.zeros(SLOTS, np.int64))
                for a, b in pieces(at, 1 << 20):
                    part, own = data[at[a] : at[b]], at[a : b + 1] - at[a]
                    if len(part) > 2:
                        place = np.arange(len(part) - 2)
                        inside = place + 2 < own[np.searchsorted(own, place, "right")]
                        n += np.bincount(_slots(part)[inside], minlength=SLOTS)
                if len(held) >= AT_ONCE:
                    yield from counts()
        yield from counts()

    known = docs.select(F.col("lang").cast("string").alias("lang"), whole_text().alias("t")).where("lang is not null")
    return written(known.mapInArrow(step, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")))


def trigram_model(counts: DataFrame, langs: list[str]) -> np.ndarray:
    """Log-probabilities of the trigram slots of some languages, (SLOTS, languages)."""
    model = np.full((SLOTS, len(langs)), 0.1)
    rows = counts.where(F.col("lang").isin(langs) & F.col("slot").isNotNull()).toArrow()
    number = np.array([langs.index(k) for k in rows.column("lang").to_pylist()], np.int64)
    np.add.at(model, (rows.column("slot").to_numpy(), number), rows.column("n").to_numpy())
    return np.log(model / model.sum(0)).astype(np.float32)


def text_evidence(pages: DataFrame, langs: list[str], models) -> DataFrame:
    """page_id, url, declared, loglik (one entry per language) of each page. ``models``: tables of the languages' slots, side by side."""
    html = whole_text("html")
    declared = F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    known = F.when(declared == "", "none").when(declared.isin(langs), declared).otherwise("other")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), whole_text("url").alias("url"), known.alias("declared"), html.alias("html"), F.array().cast("array<double>").alias("loglik"))
    names = ["page_id", "url", "declared", "html", "loglik"]

    def step_of(shared):
        def step(batches):
            table = shared.value
            for batch in batches:
                texts = [MARKUP.sub(" ", t).lower().encode() for t in batch.column(3).to_pylist()]
                data, at = buffer_of(pa.array(texts, pa.binary()))
                out = np.zeros((len(texts), table.shape[1]))
                for a, b in pieces(at, 1 << 20):
                    part, own = data[at[a] : at[b]], at[a : b + 1] - at[a]
                    if len(part) > 2:
                        score = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table[_slots(part)], axis=0, dtype=np.float64)])
                        last = len(score) - 1
                        out[a:b] = score[np.clip(own[1:] - 2, 0, last)] - score[np.clip(own[:-1], 0, last)]
                        out[a:b][np.diff(own) < 3] = 0
                both = [x + y for x, y in zip(batch.column(4).to_pylist(), (out * TEMPER).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(both, pa.list_(pa.float64()))], names)

        return step

    for model in models:
        rows = rows.mapInArrow(step_of(pages.sparkSession.sparkContext.broadcast(model)), "page_id long, url string, declared string, html string, loglik array<double>")
    return rows.drop("html")


def _softmax(x):
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, docs: DataFrame, kappa: float = KAPPA) -> DataFrame:
    """page_id, host, declared, text_lang, lang, confidence of each page.

    Null or empty pages and addresses say nothing: such a page takes the language of its host, or the most frequent one. A
    null page_id stays null; repeated rows get equal results and each counts in its host's sums. Ties go to the first language
    by name. Pages are taken whole. Other columns are left out. No pages give no rows; without labelled documents lang is null.
    """
    counts = trigram_counts(docs)
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), *(F.lit(None).cast("string").alias(c) for c in ("host", "declared", "text_lang", "lang")), F.lit(None).cast("double").alias("confidence"))
    size = range(len(langs))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$|^([^.]*)$", 0)
    models = (trigram_model(counts, langs[i : i + AT_ONCE]) for i in range(0, len(langs), AT_ONCE))
    rows = text_evidence(pages, langs, models).withColumn("host", host).withColumn("domain", domain)
    rows = written(rows.withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1)).withColumn("q", _softmax(F.col("loglik"))))
    sums = [F.sum(F.col("q")[i]).alias(f"c{i}") for i in size]
    each = [f"c{i}" for i in size]

    everywhere = rows.agg(*sums).first()
    total = [(everywhere[c] or 0.0) + 1.0 for c in each]
    prior = [x / sum(total) for x in total]

    # P(declared | language), a few rows; P(suffix | language) by a join, since suffixes may be many.
    declared = {r.declared: [r[c] for c in each] for r in rows.groupBy("declared").agg(*sums).collect()}
    kinds = [*langs, "none", "other"]
    told = F.create_map(*(x for d in kinds for x in (F.lit(d), F.array(*(F.lit(float(np.log((declared.get(d, [0.0] * len(langs))[i] + 0.5) / (total[i] - 1 + 0.5 * len(kinds))))) for i in size)))))
    suffixes = rows.groupBy("suffix").agg(*sums).select("suffix", F.array(*(F.ln((F.col(f"c{i}") + 4 * prior[i]) / total[i]) for i in size)).alias("suffix_log"))
    domains = rows.groupBy("domain").agg(*sums, F.count(F.lit(1)).alias("n"))
    domains = domains.select("domain", F.array(*((F.col(f"c{i}") + kappa * prior[i]) / (F.col("n") + kappa) for i in size)).alias("domain_prior"))
    hosts = rows.groupBy("host", "domain").agg(*sums, F.count(F.lit(1)).alias("n")).join(domains, "domain")
    hosts = written(hosts.select("host", "n", "domain_prior", F.array(*each).alias("c")))
    fused = rows.join(hosts, "host").join(written(suffixes), "suffix")
    own = [(F.greatest(F.col("c")[i] - F.col("q")[i], F.lit(0.0)) + kappa * F.col("domain_prior")[i]) / (F.col("n") - 1 + kappa) for i in size]
    logs = F.array(*(F.col("loglik")[i] + F.ln(own[i]) + told[F.col("declared")][i] + F.col("suffix_log")[i] for i in size))
    names = F.array(*(F.lit(x) for x in langs))
    pick = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    out = fused.withColumn("p", _softmax(logs))
    return out.select("page_id", "host", "declared", pick(F.col("q")).alias("text_lang"), pick(F.col("p")).alias("lang"), F.round(F.array_max("p"), 6).alias("confidence"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


QUERIES = {"op4_language_id": op4_language_id}
