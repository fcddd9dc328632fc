import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tracelake.llm import simhash, substring_dedup, suffix_dedup, suffix_order
from tracelake.llm.common import key_chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    say = lambda k: r.choice([" ", "\n", "  ", " \t"]).join(r.choice(vocab) for _ in range(k))
    base = [say(r.randint(0, 200)) for _ in range(20)]
    shared = say(70)
    out = []
    for i in range(n):
        kind = r.random()
        if kind < 0.25:
            t = r.choice(base)
        elif kind < 0.6:
            w = r.choice(base).split(" ")
            for _ in range(r.randint(1, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
            t = " ".join(w)
        elif kind < 0.8:
            t = say(r.randint(0, 30)) + " " + shared + " " + say(r.randint(0, 30))
        else:
            t = say(r.randint(0, 60))
        out.append((i * 3 % 1001, t))
    out += [(2000, None), (2001, ""), (2002, " \n"), (2003, shared * 3), (None, shared), (2005, out[0][1]), out[1]]
    r.shuffle(out)
    return out


def brute_simhash(rows):
    fps = []
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sh = [" ".join(w[j : j + 3]) for j in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    root = list(range(len(rows)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((str(i), f"{fps[a]:016x}", least.get(find(a))) for a, (i, _) in enumerate(rows)), key=str)


def brute_words(rows, k):
    starts = {}
    key = lambda i: -1 if i is None else i
    split = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, split):
        for j in range(len(w) - k + 1):
            x = tuple(w[j : j + k])
            starts[x] = min(key(i), starts.get(x, key(i)))
    out = []
    for (i, _), w in zip(rows, split):
        gone = set()
        for j in range(len(w) - k + 1):
            if starts[tuple(w[j : j + k])] < key(i):
                gone.update(range(j, j + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def brute_bytes(rows, k):
    count = {}
    raw = [(t or "").encode() for _, t in rows]
    for b in raw:
        for j in range(len(b) - k + 1):
            count[b[j : j + k]] = count.get(b[j : j + k], 0) + 1
    out = []
    for (i, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for j in range(len(b) - k + 1):
            if count[b[j : j + k]] > 1:
                gone[j : j + k] = b"\1" * k
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_simhash(docs_of):
    rows = corpus(1)
    got = [(str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs_of(rows)).collect()]
    assert sorted(got, key=str) == brute_simhash(rows)
    kept = [r.doc_id for r in simhash.one_of_each(docs_of(rows)).collect()]
    assert sorted(kept, key=str) == sorted({c for _, _, c in brute_simhash(rows)}, key=str)


def test_one_of_each_by_component(docs_of):
    r = random.Random(8)
    a, b, c, d, e, f = (" ".join(str(r.getrandbits(20)) for _ in range(60)) for _ in range(6))
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c), (5, d), (5, e), (5, e), (5, a), (7, f), (3, f)]
    assert sorted(((x.doc_id, x.text) for x in simhash.one_of_each(docs_of(rows)).collect()), key=str) == sorted([(1, a), (None, b), (None, c), (5, d), (5, e), (3, f)], key=str)


def classes_of(fps, pairs):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("longest, least", [(512, 1), (512, 3), (512, 6), (16, 1), (3, 1)])
def test_count_filter_decides(spark, monkeypatch, longest, least):
    """Lists of few entries hold pairs that share too little; lists that are too long are split. The classes stay those of all pairs."""
    r = np.random.RandomState(3)
    base = r.randint(-(2**62), 2**62, 700).tolist()
    flipped = lambda x, n: int(np.bitwise_xor.reduce([np.int64(x), *(np.int64(1) << np.int64(b) for b in r.choice(63, n, replace=False))]))
    fps = {*base, *(flipped(b, r.randint(1, 5)) for b in base for _ in range(2)), *(flipped(base[0], r.randint(1, 6)) for _ in range(1200)), *(base[1] & ~0xFFFF | int(x) for x in r.randint(0, 65536, 700))}
    fps = np.array(sorted(fps), np.int64)
    u = fp_bits = fps.view(np.uint64)
    pairs = [(int(fps[i]), int(fps[i + 1 + k])) for i in range(len(u)) for k in np.flatnonzero(np.bitwise_count(fp_bits[i] ^ u[i + 1 :]) <= 2)]
    monkeypatch.setattr(simhash, "LIST", longest)
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps.tolist()], "fp long").repartition(3), least).collect()
    assert classes_of(fps.tolist(), edges) == classes_of(fps.tolist(), pairs)
    # What meets in lists of one entry mostly shares less than 6 bytes: the tally drops it.
    two = np.sort(fps)[:2000]
    x, y = simhash._tallied(two, np.full(len(two), 0xFF, np.uint64), np.full(len(two), len(two)))
    assert {(int(two[i]), int(two[j])) for i, j in zip(x, y)} == {(a, b) for a, b in pairs if (a ^ b) & 0xFF == 0 and a in set(two.tolist()) and b in set(two.tolist())}


def test_links_of_one_large_posting(spark):
    r = random.Random(5)
    fps = sorted({0xABCD << 48 | r.getrandbits(10) << r.choice([0, 20]) for _ in range(1500)})
    edges = simhash.links(spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")).collect()
    def classes(pairs):
        root = {f: f for f in fps}
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in pairs:
            root[find(a)] = find(b)
        best = {}
        for f in fps:
            best.setdefault(find(f), []).append(f)
        return sorted(map(sorted, best.values()))
    true = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2]
    assert classes([(e.src % 2**64, e.dst % 2**64) for e in edges]) == classes(true)


def test_substring_dedup(docs_of, monkeypatch):
    rows = corpus(2)
    for k in (13, 5):
        got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs_of(rows), k).collect()]
        assert sorted(got) == brute_words(rows, k)
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", 2)
    for few in (1_000_000, 3, 0):  # names that fit, that fit after doublings, and none
        monkeypatch.setattr(substring_dedup, "FEW_NAMES", few)
        got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs_of(rows)).collect()]
        assert sorted(got) == brute_words(rows, 13)


def spans_of(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_suffix_dedup(docs_of, monkeypatch):
    rows = corpus(3)
    for length in (400, 60, 15):
        assert spans_of(suffix_dedup.suffix_dedup(docs_of(rows), length)) == brute_bytes(rows, length)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 2)
    assert spans_of(suffix_dedup.suffix_dedup(docs_of(rows))) == brute_bytes(rows, 400)
    monkeypatch.setattr(suffix_dedup, "FEW_NAMES", 0)  # hot names by a shuffled join
    assert spans_of(suffix_dedup.suffix_dedup(docs_of(rows), 60)) == brute_bytes(rows, 60)


def test_key_chunks():
    r = random.Random(6)
    for _ in range(200):
        keys = sorted(r.choice([r.randint(0, 9), 5]) for _ in range(r.randint(0, 60)))
        cuts = sorted(r.randint(0, len(keys)) for _ in range(6))
        parts = [keys[a:z] for a, z in zip([0, *cuts], [*cuts, len(keys)])]
        batches = (pa.RecordBatch.from_arrays([pa.array(p, pa.int64())], ["key"]) for p in parts)
        out, last = [], None
        for batch, goes_on in key_chunks(batches, "key", r.randint(1, 9), 1 << 20, most := r.randint(2, 12)):
            got = batch.column(0).to_pylist()
            assert goes_on == (got[0] == last)
            assert not goes_on or keys.count(got[0]) >= most
            out, last = out + got, got[-1]
        assert out == keys


def test_hot_buckets_in_parts(docs_of, monkeypatch):
    """A shared passage in many rows, whose windows are dealt out by themselves and come in parts of two rows."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(80))
    rows = [(r.randint(0, 500), f"{' '.join(word() for _ in range(r.randint(0, 20)))} {passage}{' ' + word() if i % 3 else ''}") for i in range(40)]
    for module in (substring_dedup, suffix_dedup):
        monkeypatch.setattr(module, "HOT_ROWS", 2)
        monkeypatch.setattr(module, "MOST", 2)
        monkeypatch.setattr(module, "pieces", lambda at: ((i, i + 1) for i in range(len(at) - 1)))  # so equal strings go out each
    docs = docs_of(rows).repartition(3)
    for module, name in ((substring_dedup, "key_chunks"), (suffix_dedup, "key_chunks")):
        chunks = getattr(module, name)
        monkeypatch.setattr(module, name, lambda batches, key, rows=1, size=1, most=2, chunks=chunks: chunks((b.slice(i, 1) for b in batches for i in range(b.num_rows)), key, 1, 1, 2))
    got = [(str(x.doc_id), x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.substring_dedup(docs).collect()]
    assert sorted(got) == brute_words(rows, 13)
    assert spans_of(suffix_dedup.suffix_dedup(docs)) == brute_bytes(rows, 400)
    assert spans_of(suffix_dedup.suffix_dedup(docs, 60)) == brute_bytes(rows, 60)


def test_suffix_dedup_of_periodic_texts(docs_of):
    rows = [(1, "a" * 100_000), (2, "ab" * 700), (3, "b" * 399), (4, "b" * 400), (5, "b" * 401), (6, ("x" * 500 + "y") * 5), (7, "a" * 399 + "é")]
    assert spans_of(suffix_dedup.suffix_dedup(docs_of(rows))) == brute_bytes(rows, 400)


def test_suffix_order():
    r = random.Random(1)
    for _ in range(200):
        alphabet = r.choice([1, 2, 4, 26])
        b = bytes(r.randint(97, 96 + alphabet) for _ in range(r.randint(1, 500)))
        b += r.choice([b"", b"x" + b[: len(b) // 2] + b[len(b) // 3 :]])
        length = min(len(b), r.choice([1, 2, 7, 8, 9, 20, 31, 32, 62, 63, 100, 150]))
        start = np.array(sorted(r.sample(range(len(b) - length + 1), r.randint(1, len(b) - length + 1))))
        found = suffix_order.SuffixOrder(np.frombuffer(b, np.uint8), start, length)
        strings = [b[i : i + length] for i in found.order]
        assert sorted(found.order) == start.tolist() and strings == sorted(strings)
        assert found.common.tolist() == [x == y for x, y in zip(strings, strings[1:])]


def test_empty_and_extra_columns(spark, docs_of):
    none = docs_of([])
    assert simhash.near_duplicates(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert suffix_dedup.suffix_dedup(none).count() == 0
    odd = docs_of([(1, "a b c"), (2, None)]).selectExpr("*", "1 as fp", "2 as t", "3 as doc", "4 as key", "5 as th", "6 as component_id", "7 as uid")
    assert simhash.one_of_each(odd).columns == odd.columns
    for f in (simhash.near_duplicates, substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, simhash.one_of_each):
        assert f(odd).count() == 2


def test_very_long_text(docs_of):
    r = random.Random(4)
    t = " ".join(str(r.getrandbits(20)) for _ in range(900_000))
    got = {x.doc_id: x for x in suffix_dedup.suffix_dedup(docs_of([(1, t), (2, "x " + t[5_000_000:5_004_000])]), with_text=False).collect()}
    assert got[1].n_removed == 4000 and got[2].n_removed == 4000 and got[1].n_spans == 1


def test_many_rows_of_one_id(spark):
    """A passage of tens of thousands of rows without an id: its places and spans are held once."""
    r = random.Random(6)
    passage = " ".join(str(r.getrandbits(30)) for _ in range(80))
    alone = " ".join(str(r.getrandbits(30)) for _ in range(80))
    many = spark.range(20_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", f"'{passage}' AS text")
    docs = many.unionByName(spark.createDataFrame([(7, f"before {passage} after"), (8, alone), (8, alone)], "doc_id long, text string"))
    for module in (substring_dedup, suffix_dedup):
        spans = module.repeated_spans(docs).selectExpr("max(size(spans)) AS n", "count(*) AS rows").first()
        assert spans.n <= 200 and spans.rows <= 3
    got = {(x.doc_id, x.n_words): x.n_removed for x in substring_dedup.substring_dedup(docs, with_text=False).distinct().collect()}
    assert got == {(None, 80): 0, (7, 82): 80, (8, 80): 0}
    size = len(passage)
    got = {(x.doc_id, x.n_bytes): x.n_removed for x in suffix_dedup.suffix_dedup(docs, with_text=False).distinct().collect()}
    assert got == {(None, size): size, (7, size + 13): size, (8, len(alone)): len(alone)}
    from tracelake.llm import token_store

    stored = token_store.token_store(docs)
    assert stored.count() == 20_003 and stored.select("start").distinct().count() == 20_003


def test_passages_that_repeat_across_documents(docs_of):
    """Passages of over 50 words go from each document that has one, if they have 400 bytes; n_removed tells it, not n_bytes, the whole length."""
    r = random.Random(8)
    say = lambda n: " ".join(f"{r.getrandbits(22):x}" for _ in range(n))
    passages = [say(r.randint(53, 120)) for _ in range(30)]
    assert len({len(p) >= 400 for p in passages}) == 2
    rows, planted = [], {}
    for p in passages:
        for _ in range(r.randint(2, 3)):
            planted[len(rows)] = p
            mark = chr(65 + len(rows) % 26)  # another one in each copy, so no more than the passage is equal
            rows.append((len(rows), f"{say(r.randint(0, 80))} {mark}{p}{mark} {say(r.randint(0, 80))}"))
    clean = range(len(rows), len(rows) + 60)
    rows += [(i, say(r.randint(1, 250))) for i in clean]
    got = suffix_dedup.suffix_dedup(docs_of(rows)).collect()
    found = {x.doc_id: x for x in got}
    for i, p in planted.items():
        lost = p.encode() not in found[i].kept
        assert lost == (len(p) >= 400) and found[i].n_removed == lost * len(p) and found[i].n_bytes == len(rows[i][1])
    assert not any(found[i].n_removed for i in clean)
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == brute_bytes(rows, 400)
