"""Nulls, empty and very long texts, repeated rows, clashing names and empty tables, through every operator and through the chain."""

import math
import random
import zlib
from collections import Counter
from hashlib import md5

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_near_dedup import brute_simhash
from tokenizers import Tokenizer

import corpus_pipeline
from tracelake.llm import decontaminate, language_id, licenses, media, mixing, simhash, substring_dedup, suffix_dedup, token_store, toxicity
from tracelake.llm.common import read

DATA = "/root/testdata/sf0.001"
ROWS = [(1, "Some text of a few words."), (1, "Some text of a few words."), (2, None), (3, ""), (None, "no id here"), (None, None), (4, " \n\t "), (5, "ünïcodé 漢字 🙂"), (6, "x" * 5000), (7, "idiot moron scum trash idiot pathetic loser")]
CLASHES = ["fp", "t", "doc", "key", "th", "uid", "row", "score", "spans", "component_id", "_copy", "rate", "cdf", "media", "start", "hash", "_none", "_row", "_words", "license", "n", "packed"]


@pytest.fixture(scope="module")
def crf(spark):
    return toxicity.learn(*(read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels")))


@pytest.fixture(scope="module")
def bench(spark):
    return read(spark, DATA, "benchmark")


@pytest.fixture(scope="module")
def operators(spark, crf, bench):
    """By name: the operator over documents, and whether it gives a row per row."""
    pages = lambda d: d.select(F.col("doc_id").alias("page_id"), F.lit("http://a.example.de/x").alias("url"), F.col("text").alias("html"), *(c for c in d.columns if c not in ("doc_id", "text")))
    return {
        "op1": (lambda d: licenses.scan(d.withColumn("path", F.lit("a/LICENSE"))), True),
        "op2": (token_store.token_store, True),
        "op3": (lambda d: toxicity.score(d, crf), True),
        "op4": (lambda d: language_id.identify(pages(d), read(spark, DATA, "documents")), True),
        "op5": (media.media_columns, True),
        "op6": (lambda d: decontaminate.contamination(d, bench), False),
        "op7": (lambda d: mixing.mixed(d, copy=None), False),
        "op8": (simhash.near_duplicates, True),
        "op9": (substring_dedup.substring_dedup, True),
        "op10": (suffix_dedup.suffix_dedup, True),
    }


@pytest.mark.parametrize("name", [f"op{i}" for i in range(1, 11)])
def test_odd_rows(docs_of, operators, name):
    make, each = operators[name]
    docs = docs_of(ROWS)
    odd = docs.selectExpr("*", *(f"{i} AS `{c}`" for i, c in enumerate(CLASHES)))
    plain, clash = make(docs), make(odd)
    assert not each or plain.count() == len(ROWS)
    keep = [c for c in plain.columns if c in clash.columns]
    assert Counter(map(str, plain.select(*keep).collect())) == Counter(map(str, clash.select(*keep).collect()))
    empty = make(odd.limit(0))
    assert empty.count() == 0 and empty.columns == clash.columns
    if name == "op7":
        assert clash.columns == odd.columns
    twice = Counter(str(r) for r in plain.collect() if str(r[0]) == "1")
    assert all(n % 2 == 0 for n in twice.values()) or name in ("op2",)  # equal rows have equal results


@pytest.mark.parametrize("name", [f"op{i}" for i in range(1, 11)])
def test_very_long_text(spark, docs_of, operators, bench, name):
    r = random.Random(1)
    item = bench.where("text is not null").orderBy("item_id").first()
    long = " ".join(str(r.getrandbits(30)) for _ in range(300_000)) + f" {item.text} You utter idiot. Released under the MIT License."
    make, each = operators[name]
    rows = {x[0]: x for x in make(docs_of([(1, long), (2, "short"), (3, long[1_000_000:1_001_000])])).collect()}
    assert not each or set(rows) == {1, 2, 3}
    one = rows.get(1)
    if name == "op1":
        assert (one.license, one.origin, rows[2].license, rows[2].origin) == ("MIT", "file", "MIT", "inherited")
    if name == "op2":
        tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        ids = np.array([*tok.encode(long, add_special_tokens=False).ids, 1], "<u4")
        assert (one.start, one.n_tokens, one.ids_crc32) == (0, len(ids), zlib.crc32(ids.tobytes())) and rows[2].start == len(ids)
    if name == "op3":
        assert "idiot" in [long[s.begin : s.end] for s in one.spans]
    if name == "op5":
        assert one.n_bytes == len(long.encode()) and one.fingerprint[-1].t > 10_000
    if name == "op6":
        assert one.item_id == item.item_id and one.edit_distance == 0
    if name == "op8":
        assert {x.component_id for x in rows.values()} == {1, 2, 3}
    if name == "op9":
        assert one.n_removed == 0 and rows[3].n_removed >= 90
    if name == "op10":
        assert one.n_removed == rows[3].n_removed == 1000


def chained(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    return docs


def test_chain_of_odd_rows(spark, docs_of):
    docs = docs_of(ROWS).selectExpr("*", *(f"{i} AS `{c}`" for i, c in enumerate(CLASHES)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        docs = out
    assert chained(spark, docs_of(ROWS)).count() > 0
    assert chained(spark, docs_of([])).count() == 0


def test_pipeline_by_hand(spark, bench):
    """The stages over the smallest documents, each worked out again by itself."""
    crf = toxicity.learn(read(spark, DATA, "documents"), read(spark, DATA, "labels"))
    docs = [(r.doc_id, r.text, r.source) for r in read(spark, DATA, "documents").collect()]
    docs = [d for d, s in zip(docs, toxicity._scores(crf, [d[1] or "" for d in docs]), strict=True) if s < toxicity.REJECT]
    first = {c for _, _, c in brute_simhash([(i, t) for i, t, _ in docs])}
    docs = [d for d in docs if d[0] in first]

    low = lambda t: " ".join("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()).encode()
    items = [low(r.text) for r in bench.collect() if r.text and r.text.strip()]
    grams = lambda b: {b[i : i + 5] for i in range(len(b) - 4)}
    sets = [grams(b) for b in items]

    def leaks(text):
        body = low(text)
        held, data = grams(body), np.frombuffer(body, np.uint8)
        for item, own in zip(items, sets, strict=True):
            most = math.floor(len(item) * 0.2 + 1e-9)
            if item in body:
                return True
            # Of an item met within the edits, a fifth of five letters in a row are whole at least, in any text of this corpus.
            if len(own & held) >= 0.15 * len(own) and decontaminate.edit_to_best(np.frombuffer(item, np.uint8), data, most) <= most:
                return True
        return False

    docs = [d for d in docs if not leaks(d[1])]
    sizes, copies = Counter(s for *_, s in docs), []
    for i, t, s in docs:
        rate = len(docs) / len(sizes) / sizes[s]
        u = int(md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, total = 0, math.exp(-rate)
        while total <= u:
            k += 1
            total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        copies += [(i, t or "")] * k
    tok, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, t in sorted(copies):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == want
