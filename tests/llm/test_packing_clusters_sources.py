"""Best-fit packing, centroid clustering and the source audit against brute force, SQL and the contract's words."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelake.llm import divergence, kmeans, packing, registry
from tracelake.llm.byte_tokens import ByteEncoder
from tracelake.llm.common import buffer_of, read

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def encoded(encoder, texts):
    ids, n = encoder(*buffer_of(pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary())), 2)
    end = np.cumsum(n)
    return [ids[a:z].tolist() for a, z in zip(end - n, end, strict=True)]


def test_byte_encoder():
    encoder, r = ByteEncoder(PATH), random.Random(5)
    pool = [*" \n\t\r　  \u0085aAbZ09.,'!<|>-_éßİ̱́漢字ह़क़🙂​", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "'s", "'ll", " the", " word.", "\n\n", "  "]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    texts += [f"a {c}b. {c}. c{c}d{c}! \n{c} {c} x{c}'s" for c in map(chr, range(0x80, 0x3100))]
    texts += ["", " ", "<|endoftext|>", "a<|endoftext|> b", "x" * 5000, "\n" * 300, " " * 300, "ab\n", "\ncd", " \n e"]
    want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert encoded(encoder, texts) == want


def used(plan, counts):
    got = np.zeros_like(counts)
    for filling, n in plan:
        assert n > 0 and sum(s * k for s, k in filling) <= len(counts) - 1
        for s, k in filling:
            got[s] += k * n
    assert (got == counts).all()
    return sum(n for _, n in plan)


def fewest(sizes, capacity):
    """Bins needed, by trying everything."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in sorted({x for x in bins if x + sizes[i] <= capacity}):
            j = bins.index(b)
            go(i + 1, [*bins[:j], b + sizes[i], *bins[j + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_bin_completion(seed):
    r = random.Random(seed)
    capacity = r.choice([12, 20, 50])
    sizes = [r.randint(1 if seed % 2 else capacity // 5, capacity if seed % 3 else capacity // 2) for _ in range(r.randint(0, 11))]
    counts = np.bincount(sizes, minlength=capacity + 1) if sizes else np.zeros(capacity + 1, np.int64)
    assert used(packing.best_fit(counts, capacity), counts) >= fewest(sizes, capacity) >= packing.lower_bound(counts, capacity)
    assert used(packing.complete_bins(counts, capacity), counts) == fewest(sizes, capacity)


def test_many_pieces_need_little_search():
    r = np.random.RandomState(0)
    counts = np.bincount(np.minimum(1024, r.geometric(0.002, 300_000)), minlength=1025)
    assert used(packing.complete_bins(counts * 10**9, 1024), counts * 10**9) == packing.lower_bound(counts * 10**9, 1024)
    two = np.zeros(1025, np.int64)
    two[[600, 424, 500, 524, 1024]] = [7, 7, 5, 5, 9]
    assert used(packing.complete_bins(two, 1024), two) == 21


def test_packing(spark, docs_of):
    rows = [(r.doc_id, r.text) for r in read(spark, DATA, "documents").collect()]
    rows += [(10_000, None), (10_001, ""), (10_002, "word " * 1023), (10_003, "word " * 5000), (10_004, "a <|endoftext|> b"), (None, "no id"), (10_005, "same"), (10_005, "same"), (10_006, " ".join(["word"] * 1024))]
    tokenizer, want = Tokenizer.from_file(PATH), Counter()
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cut = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want.update((i, n, a, z - a, zlib.crc32(ids[a:z].tobytes())) for n, (a, z) in enumerate(zip(cut, cut[1:])))
    table = packing.packed(docs_of(rows).repartition(5)).withColumn("crc", F.crc32("ids"))
    got = table.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.crc) for r in got) == want
    lines = defaultdict(list)
    for r in got:
        lines[r.sequence_id].append((r.offset, r.length))
    for line in lines.values():
        at = 0
        for offset, length in sorted(line):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(lines) <= -(-total // 1024) + 1
    whole = packing.sequences(table).collect()
    assert len(whole) == len(lines) and sum(len(r.ids) for r in whole) == total and all(r.documents[0].offset == 0 for r in whole)


def integers(rows):
    return np.floor(256 * np.array(rows, np.float64)).astype(np.int64)


def lloyd(rows, k=40, rounds=5):
    """(vec_id, cluster, distance) and the centroids, by the contract's words."""
    rows = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    x = integers([r[1] for r in rows])
    c = x[:k].copy()
    for turn in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(-1)
        at = d.argmin(1)
        if turn < rounds:
            for j in set(at.tolist()):
                some = x[at == j]
                c[j] = [sum(map(int, col)) // len(some) for col in some.T]
    return [(r[0], int(a), int(b)) for r, a, b in zip(rows, at, d.min(1), strict=True)], c


@pytest.mark.parametrize("case", ["given", "spread", "equal", "ties", "large", "few", "one"])
def test_clusters(spark, case):
    r = np.random.RandomState(1)
    if case == "given":
        rows = [(x.vec_id, x.embedding) for x in read(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    elif case == "spread":  # far groups: whole nodes fall to one centroid
        rows = [(i, (v + 50 * (i % 45)).tolist()) for i, v in enumerate(r.normal(size=(3000, 64)))]
    elif case == "equal":
        rows = [(i, [float(i % 3)] * 64) for i in range(500)]
    elif case == "ties":
        rows = [(i, v) for i, v in enumerate((r.randint(-1, 2, (2000, 64)) / 256).tolist())]
    elif case == "large":
        rows = [(i, v) for i, v in enumerate((r.randint(-(2**16), 2**16, (300, 64))).astype(float).tolist())]
    else:
        rows = [(i, r.normal(size=64).tolist()) for i in range(7 if case == "few" else 1)]
    want, centroids = lloyd(rows)
    got = kmeans.centroid_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert sorted((x.vec_id, x.cluster, x.distance) for x in got) == sorted(want)
    inertia = Counter()
    for _, cluster, distance in want:
        inertia[cluster] += distance
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    assert all((x.cluster_inertia, x.inertia, x.centroid_sha256) == (inertia[x.cluster], sum(inertia.values()), sha[x.cluster]) for x in got)


def test_trees_prune_and_cover():
    r = np.random.RandomState(3)
    x = np.floor(256 * (r.normal(size=(4000, 64)) + 40 * (np.arange(4000) % 40)[:, None])).astype(np.int64)
    tree, above = kmeans.CoverTree.build(x), kmeans.CoverTree.build(x[:40], leaf=1)
    ordered = x[tree.order]
    for a, b in zip(tree.levels, tree.levels[1:]):
        assert len(a) < len(b) and (a["end"][:-1] == a["first"][1:]).all() and a["end"][-1] == len(b)
        assert (a["radius"][np.repeat(np.arange(len(a)), a["end"] - a["first"])] + 1e-9 >= 0).all()
    last = tree.levels[-1]
    for node in last:
        assert math.isclose(node["radius"], np.sqrt(((ordered[node["first"] : node["end"]] - x[node["point"]]) ** 2).sum(1).max()), rel_tol=1e-9, abs_tol=1e-9)
    place = np.empty(len(x), np.int32)
    place[tree.order] = np.arange(len(x))
    for level in tree.levels:
        level["point"] = place[level["point"]]
    again = kmeans.CoverTree.unpacked(tree.packed(), len(x))
    number, distance, needed = kmeans.nearest(ordered, again, x[:40], above)
    d = ((ordered[:, None] - x[None, :40]) ** 2).sum(-1)
    assert (number == d.argmin(1)).all() and (distance == d.min(1)).all()
    assert needed < 0.3 * d.size  # far groups fall to one centroid as a whole


def test_odd_vectors(spark):
    good = [0.5] * 64
    rows = [(1, good), (1, good), (2, None), (3, []), (4, good[1:]), (5, [*good[1:], None]), (6, [*good[1:], float("nan")]), (7, [*good[1:], float("-inf")]), (None, [0.25] * 64)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cluster", "2 AS ids", "3 AS tree", "4 AS distance")
    got = kmeans.centroid_clusters(table).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == [("1", 0, 0), ("1", 0, 0), ("None", 2, 0)]
    assert kmeans.centroid_clusters(table.limit(0)).collect() == [] and kmeans.centroid_clusters(table.where("vec_id = 3")).collect() == []


def test_divergence_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{DATA}/documents.parquet'")
    want = con.execute(registry.ORACLES["op13_source_divergence"]).fetchall()
    got = registry.QUERIES["op13_source_divergence"](spark, DATA)
    assert got.columns == [d[0] for d in con.description]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_divergence_odd_rows(spark, monkeypatch):
    r = random.Random(2)
    words = ["Éa", "éa", "B", "b", "漢字", "x1y", "İx", "İ", "zz"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 9))), r.choice(["en", None, ""]), r.choice(["s", None, "", "t"])) for i in range(300)]
    rows += [(None, None, "fr", "s"), (1, "", "fr", "t"), (1, "lone", "de", "u"), (2, "lone", "de", "u")] + [(5, "rep eat", "en", "s")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    odd = docs.selectExpr("*", "1 AS term", "2 AS n", "3 AS at", "4 AS p", "5 AS rank", "6 AS item", "7 AS salt")
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = sorted(con.execute(registry.ORACLES["op13_source_divergence"]).fetchall())
    assert sorted(map(tuple, divergence.divergence(odd).collect())) == want
    monkeypatch.setattr(divergence, "FEW_GROUPS", 2)  # joins by salted keys
    monkeypatch.setattr(divergence, "HELD_BYTES", 100)
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    assert sorted(map(tuple, divergence.divergence(odd).collect())) == want
    assert divergence.divergence(odd.limit(0)).collect() == []


def test_shares_of_large_counts(spark):
    n, of, v = 4 * 10**15, 9 * 10**15, 10**6
    got = spark.range(1).selectExpr(f"{n}L AS n", f"{of}L AS m", f"{v}L AS v").selectExpr(divergence._share("n", "m").replace("v ", "v "))
    assert got.first()[0] == 1 + 10**9 * (n + 2) // (of + 2 * v)


def test_packing_odd_rows(docs_of):
    rows = [(1, "Some text of a few words."), (1, "Some text of a few words."), (2, None), (3, ""), (None, "no id here"), (None, None), (4, " \n\t "), (5, "ünïcodé 漢字 🙂"), (6, "x" * 5000)]
    docs = docs_of(rows)
    odd = docs.selectExpr("*", *(f"{i} AS `{c}`" for i, c in enumerate(["piece", "start", "length", "ids", "task", "nth", "n", "before", "place", "sequence_id", "offset", "t"])))
    kept = ["doc_id", "piece", "start", "length", "ids"]
    assert Counter(map(str, packing.packed(odd).select(kept).collect())) == Counter(map(str, packing.packed(docs).select(kept).collect()))
    empty = packing.packed(odd.limit(0))
    assert empty.collect() == [] and empty.columns == [*kept, "sequence_id", "offset"]
    small = packing.packed(docs, capacity=16).collect()
    assert all(r.length <= 16 for r in small) and max(r.offset + r.length for r in small) <= 16


def test_other_numbers_of_centroids(spark):
    r = np.random.RandomState(8)
    rows = [(i, v) for i, v in enumerate((r.normal(size=(700, 5)) + 3 * (np.arange(700) % 9)[:, None]).tolist())]
    got, centroids = kmeans.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2), k=9, rounds=2, seed=7, dimensions=5, scale=100)
    x = np.floor(100 * np.array([v for _, v in rows])).astype(np.int64)
    d = ((x[:, None] - centroids[None]) ** 2).sum(-1)
    assert len(centroids) == 9 and {v.vec_id: (v.cluster, v.distance) for v in got.collect()} == {i: (int(c), int(m)) for i, (c, m) in enumerate(zip(d.argmin(1), d.min(1)))}
