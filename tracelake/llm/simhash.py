"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 2 bits share at least 6 of their 8 positional bytes. Every fingerprint is posted by
(position, byte); all pairs of a list meet there, the positional bytes that a pair shares are tallied, pairs that reach 6 stay, and
their bits are compared. A list of one entry holds about a 256th of all fingerprints, too many to compare all with all. So
a list of more than LIST is split by a further entry, again and again: lists of the first one, two, ... six entries that a pair shares.
How many to begin with follows from the number of fingerprints, so that most lists are short from the start. Each pair is tallied in
one list only: that of the first entries it shares. At least 6 are shared, so the first of them is among positions 0 to 2, the
second among 1 to 3, and so on: with d entries there are C(d + 2, 2) lists for each fingerprint. What is still too long with six has at most
65,536 members, which differ in two bytes only; there neighbours are looked up in a table of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, buffer_of, key_of, longs, read, whole_text, written
from .components import connected_components

MAX_BITS = 2
KEPT_BYTES = 8 - MAX_BITS
#: Members of a list whose pairs are all tallied; pairs tallied at one go.
LIST = 512
PAIRS = 1 << 18


def entries(depth: int) -> list[tuple[int, ...]]:
    """The positions that can be the first ``depth`` ones that a pair shares."""
    return [c for c in combinations(range(8), depth) if all(p <= MAX_BITS + i for i, p in enumerate(c))]


def mask_of(positions: tuple[int, ...]) -> int:
    return sum(0xFF << 8 * p for p in positions)


#: The places of a list of six entries that are left out, by its mask.
LEFT_OUT = {_mask: tuple(p for p in range(8) if not _mask >> 8 * p & 1) for _mask in map(mask_of, entries(KEPT_BYTES))}
NEAR = np.array([0, *(1 << i for i in range(16)), *(1 << i | 1 << j for i, j in combinations(range(16), 2))], np.int64)[1:]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles: bit i is set if more than half of the shingle hashes have it."""
    found = text.lower().split()  # ASCII letters and ASCII white space only
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    line = memoryview(b" ".join(found))
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    end = np.cumsum(size) - 1
    begin = (end - size + 1)[: len(found) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:z], seed) for a, z in zip(begin, end[words - 1 :].tolist(), strict=True)], ">u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, hashed: bool = False) -> DataFrame:
    """doc_id, fp (signed long) of each row, and its text's hash if ``hashed``; null texts count as empty, whose fingerprint is 0."""
    more = ["hash"] * hashed

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffer_of(batch.column(1))
            raw = data.tobytes()
            fp = [_signed(fingerprint(raw[a:z], words)) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64()), *batch.columns[2:]], ["doc_id", "fp", *more])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("t"))
    if hashed:
        rows = rows.withColumn("hash", F.xxhash64("t"))
    return rows.mapInArrow(step, ", ".join(f"{c} long" for c in ["doc_id", "fp", *more]))


def _near_pairs(fp: np.ndarray, out: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Within a list of six entries: the pairs of members that differ in MAX_BITS or fewer of the bits that are left."""
    u = fp.view(np.uint64)
    rest = sum(((u >> np.uint64(8 * i)) & np.uint64(255)).astype(np.int64) << (8 * n) for n, i in enumerate(out))
    table = np.full(1 << 16, -1, np.int64)
    table[rest] = np.arange(len(fp))
    near = table[rest[:, None] ^ NEAR[None, :]]
    a, k = np.nonzero(near >= 0)
    return a, near[a, k]


def _tallied(fp: np.ndarray, mask: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of all lists: rows of one list follow each other up to ``end``. A pair counts where its first shared entries are the list's."""
    more = end - np.arange(len(fp)) - 1  # rows of the same list behind each row
    upto = np.append(0, np.cumsum(more))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    a = 0
    while a < len(fp):
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, "right")) - 1)
        x = np.repeat(np.arange(a, z), more[a:z])
        y = np.arange(len(x)) + np.repeat(np.arange(a, z) + 1 - (upto[a:z] - upto[a]), more[a:z])
        differ = (fp[x] ^ fp[y]).view(np.uint64)
        same = differ.view(np.uint8).reshape(-1, 8) == 0  # by position, as the bytes lie in memory: position 0 is the lowest
        stay = np.flatnonzero(same.sum(1) >= KEPT_BYTES)
        stay = stay[np.bitwise_count(differ[stay]) <= MAX_BITS]
        low = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - top_bit(mask[x[stay]]))
        first = differ[stay]
        # Of the positions up to the list's last, the pair shares those of the list and no other.
        shared = sum(np.where((first >> np.uint64(8 * p)) & np.uint64(0xFF) == 0, np.uint64(0xFF << 8 * p), np.uint64(0)) for p in range(8))
        stay = stay[(shared & low) == mask[x[stay]]]
        found.append((x[stay], y[stay]))
        a = z
    x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    return x, y


def top_bit(mask: np.ndarray) -> np.ndarray:
    """How many bits reach to the end of the highest byte of a mask."""
    return sum(np.where(mask >> np.uint64(8 * p) != 0, np.uint64(8), np.uint64(0)) for p in range(8))


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that links a, b reach."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each list. Rows: mask of its entries, their bytes, fp; sorted by the first two."""

    def solve(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        at = np.append(np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))), len(mask))
        size = np.diff(at)
        end = np.repeat(at[1:], size)
        small = np.repeat(size <= LIST, size)
        rows = np.flatnonzero(small)
        place = np.cumsum(small) - 1
        x, y = _tallied(fp[rows], mask[rows].view(np.uint64), place[end[rows] - 1] + 1)
        links = [(rows[x], rows[y])]
        for a, n in zip(at[:-1][size > LIST].tolist(), size[size > LIST].tolist(), strict=True):
            x, y = _near_pairs(fp[a : a + n], LEFT_OUT[int(mask[a]) & (2**64 - 1)])
            links.append((a + x, a + y))
        x, y = (np.concatenate(c) for c in zip(*links, strict=True))
        root = spanning(len(fp), x, y)
        far = root != np.arange(len(fp))
        src, dst = fp[root[far]], fp[far]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(src, dst)), pa.array(np.maximum(src, dst))], ["src", "dst"])

    held = np.zeros((3, 0), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        held = np.concatenate([held, np.stack([longs(batch.column(i)) for i in range(3)])], axis=1)
        cut = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
        n = cut[-1] + 1 if len(cut) else 0
        if n:
            yield solve(*np.ascontiguousarray(held[:, :n]))
        held = held[:, n:]
    if held.size:
        yield solve(*np.ascontiguousarray(held))


def posted(rows: DataFrame, depth: int) -> DataFrame:
    """mask, key, fp: each fingerprint in all its lists of ``depth`` entries; of lists (mask, key, fp) in those they are split into."""
    choices = entries(depth)
    if "mask" in rows.columns:  # one entry more, behind the last
        known = F.array(*(F.struct(F.lit(_signed(mask_of(c[:-1]))).alias("bare"), F.lit(_signed(mask_of(c))).alias("mask")) for c in choices))
        made = F.explode(F.transform(F.filter(known, lambda c: c["bare"] == F.col("mask")), lambda c: c["mask"]))
    else:
        made = F.explode(F.array(*(F.lit(_signed(mask_of(c))) for c in choices)))
    return rows.select(made.alias("mask"), "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def links(fps: DataFrame, least: int = 1) -> DataFrame:
    """(src, dst) edges that span the classes of the distinct fingerprints in column fp. ``least`` is the number of entries to begin with."""
    n, depth = fps.count(), least
    while depth < KEPT_BYTES and n >> 8 * depth > LIST // 8:
        depth += 1
    lists, found = posted(fps, depth), []
    while True:
        long = None
        if depth < KEPT_BYTES:
            long = written(lists.groupBy("mask", "key").count().where(F.col("count") > LIST).select("mask", "key"))
            if not long.limit(1).count():
                long = None
        short = lists if long is None else lists.join(long, ["mask", "key"], "left_anti")
        found.append(short.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_edges, "src long, dst long"))
        if long is None:
            return reduce(DataFrame.unionByName, found).distinct()
        depth += 1
        lists = written(posted(lists.join(long, ["mask", "key"], "left_semi"), depth))


def components(fps: DataFrame) -> DataFrame:
    """fp, root, component_id of each distinct fingerprint in (doc_id, fp): its component's first fingerprint and smallest doc_id."""
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(distinct.select("fp")))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(named.join(best, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id among texts linked, directly or not, at 2 or fewer bits.

    One row per input row. Null and empty texts have fingerprint 0 and are linked like any other. A null doc_id
    gets a component like any other row and never becomes its name, unless the component has no other id (null then).
    Repeated rows share a component. Other columns are left out. No rows give no rows.
    """
    fps = written(fingerprints(docs, words))
    names = components(fps).select("fp", "component_id")
    return fps.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, of each component: the one with the smallest doc_id (null comes last), of several with that
    id the one with the first text hash; of rows equal in both one stays."""
    fps = written(fingerprints(docs, hashed=True))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("_key"), F.col("hash").alias("_hash"))).alias("k")
    keep = fps.join(components(fps).select("fp", "root"), "fp").groupBy("root").agg(first).select("k.*")
    keys = ["_none", "_key", "_hash"]
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").isNull().alias("_none"), key_of().alias("_key"), F.xxhash64(whole_text()).alias("_hash"))
    return rows.join(keep, keys, "left_semi").dropDuplicates(keys).select("_row.*")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
