"""Substring dedup over word windows by super-k-mers.

A window is ``k`` consecutive words. Its minimiser is the smallest hash of its ``m``-word parts; consecutive windows
of a document that share it travel as one packed string (a super-k-mer) to the bucket of that minimiser, where equal
windows always meet. There the windows are grouped exactly, and those that also start in a smaller doc_id are marked.

Before any text travels, the minimisers alone are dealt out and sorted: a super-k-mer whose minimiser occurs
nowhere else can't hold a repeated window and stays at home.

Skew: a passage that many documents share is collapsed before each shuffle (equal minimisers, and equal packed strings, of
one piece of text go out once; the others are already known to be repeats). Minimisers with more than HOT_ROWS super-k-mers
are dealt out by the hash of each window instead. Their names go to every task, so there may be FEW_NAMES of them (8 MB): if there
are more, HOT_ROWS is doubled until they fit; every other bucket then has less than that number, and than a FEW_NAMES-th of all.
A bucket of more than MOST rows, which is one window dealt out by its hash, goes by in parts, in the order of the ids: of what went by
a task keeps each string once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, key_chunks, key_of, longs, no_nulls, pieces, read, whole_text, written
from .windows import Hashes, groups_of, mix, runs_of, sliding_min, words_of

WORDS = 13
PART = 3
HOT_ROWS = 4096
FEW_NAMES = 1_000_000
#: Rows of one bucket that a task holds at a time.
MOST = 250_000

SUPER = "key long, doc long, th long, start int, n int, packed binary"


def _packed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Binary column of the slices [start, end) of a buffer."""
    size = end - start
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    take = np.repeat(start - at[:-1], size) + np.arange(at[-1])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[take])])


def _super(data: np.ndarray, offsets: np.ndarray, k: int, m: int):
    """Super-k-mers of some rows: key, row, first word, windows, and their bytes as (buffer, start, end, hashes)."""
    packed, ws, we, row = words_of(data, offsets)
    if len(ws) < k:
        return None
    h = Hashes(packed)
    part = h.of(ws, we)
    if m > 1:
        part = mix(sum(part[i : len(part) - m + 1 + i] * np.uint64(2 * i + 3) for i in range(m)))
    least = sliding_min(part, k - m + 1)
    valid = row[k - 1 :] == row[: len(row) - k + 1]
    row = row[: len(valid)]
    a, z = runs_of(least, row, valid)
    first = np.searchsorted(row, row[a], "left") if len(a) else a
    return least[a].view(np.int64), row[a], a - first, z - a + 1, packed, ws[a], we[z + k - 1], h


def _batches(batches, text: int = 2):
    """The batch's rows, bytes and offsets of pieces of a few MB."""
    for batch in batches:
        if batch.num_rows:
            data, at = buffer_of(batch.column(text))
            for a, b in pieces(at):
                yield batch.slice(a, b - a), data[at[a] : at[b]], at[a : b + 1] - at[a]


def tied_minimisers(rows: DataFrame, k: int = WORDS, m: int = PART) -> DataFrame:
    """uid, start of the super-k-mers whose minimiser occurs more than once; and, with null uid, key and n of frequent ones."""

    def sample(batches):
        for part, data, at in _batches(batches, 1):
            if found := _super(data, at, k, m):
                key, row, start = found[:3]
                _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                n = count[inverse]
                known = n > 1
                known[first] = False  # one goes out for all of them
                uid = longs(part.column(0))[row]
                key = np.where(known, mix(uid.view(np.uint64) + start.astype(np.uint64)).view(np.int64), key)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(uid), pa.array(start.astype(np.int32)), pa.array(np.where(known, 2, n).astype(np.int32))], ["key", "uid", "start", "n"])

    def tie(batches):
        for batch, goes_on in key_chunks(batches, "key", 500_000, 16 << 20, 2_000_000):
            key, n = longs(batch.column(0)), longs(batch.column(3))
            new = np.append(True, key[1:] != key[:-1])
            total = np.add.reduceat(n, np.flatnonzero(new))
            tied = total[np.cumsum(new) - 1] > 1
            if goes_on:
                tied |= key == key[0]
            hot = total > HOT_ROWS
            rows_, more = int(tied.sum()), int(hot.sum())
            keep = pa.array(tied)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column(1).filter(keep), pa.nulls(more, pa.int64())]), pa.concat_arrays([batch.column(2).filter(keep), pa.nulls(more, pa.int32())]),
                    pa.concat_arrays([pa.nulls(rows_, pa.int64()), pa.array(key[new][hot])]), pa.concat_arrays([pa.nulls(rows_, pa.int64()), pa.array(total[hot])]),
                ],
                ["uid", "start", "key", "n"],
            )

    dealt = rows.mapInArrow(sample, "key long, uid long, start int, n int").repartition("key").sortWithinPartitions("key")
    return written(dealt.mapInArrow(tie, "uid long, start int, key long, n long"))


def repeated_spans(docs: DataFrame, k: int = WORDS, m: int = PART) -> DataFrame:
    """doc, th, spans: the word ranges [s, e) of each document covered by windows that also start in a smaller doc_id.

    doc is the id (the smallest long for null), th a hash of the text: together they name the rows of one text and id.
    """
    uid = F.xxhash64("doc_id", whole_text()).alias("uid")
    tied = tied_minimisers(docs.select(uid, whole_text().alias("t")), k, m)
    names, least = tied.where("uid is null").groupBy("key").agg(F.sum("n").alias("n")), HOT_ROWS
    while names.where(F.col("n") > least).count() > FEW_NAMES:
        least *= 2
    hot = names.where(F.col("n") > least).select("key").toArrow().column("key").to_numpy().view(np.uint64)
    places = tied.where("uid is not null").groupBy("uid").agg(F.collect_set("start").alias("starts"))
    rows = docs.select(uid, key_of().alias("doc"), F.xxhash64(whole_text()).alias("th"), whole_text().alias("t"))
    rows = rows.join(places.hint("shuffle_hash"), "uid").select("doc", "th", "t", "starts")

    def cut(batches):
        for part, data, at in _batches(batches):
            found = _super(data, at, k, m)
            if not found or not len(found[0]):
                continue
            key, row, start, n, packed, s, e, h = found
            listed = part.column(3)
            own = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(listed.offsets)))
            may = np.isin(row << 32 | start, own << 32 | np.asarray(listed.flatten()).astype(np.int64))
            ids, th = longs(part.column(0)), part.column(1).to_numpy(zero_copy_only=False)
            is_hot = may & np.isin(key.view(np.uint64), hot)
            for single in (False, True):
                pick = np.flatnonzero(is_hot if single else may & ~is_hot)
                if not len(pick):
                    continue
                if single:  # each window by itself, named by its own hash
                    ws, we, word_row = words_of(data, at)[1:]
                    row0 = np.searchsorted(word_row, row[pick], "left")
                    item = np.repeat(np.arange(len(pick)), n[pick])
                    w = row0[item] + start[pick][item] + np.arange(len(item)) - np.repeat(np.cumsum(n[pick]) - n[pick], n[pick])
                    r, first, count, a, z = row[pick][item], w - row0[item], np.ones(len(w), np.int64), ws[w], we[w + k - 1]
                    name = h.of(a, z).view(np.int64)
                else:
                    r, first, count, a, z, name = row[pick], start[pick], n[pick], s[pick], e[pick], key[pick]
                doc = ids[r]
                leader = groups_of(packed, a, z, h)
                least = np.full(len(doc), np.iinfo(np.int64).max)
                np.minimum.at(least, leader, doc)
                known = doc > least[leader]  # the same string is here under a smaller id
                name = np.where(known, mix(doc.view(np.uint64) + first.astype(np.uint64)).view(np.int64), name)
                for sel in (~known, known):
                    if sel.any():
                        body = pa.nulls(int(sel.sum()), pa.binary()) if sel is known else _packed(packed, a[sel], z[sel])
                        yield pa.RecordBatch.from_arrays([pa.array(name[sel]), pa.array(doc[sel]), pa.array(th[r][sel], pa.int64()), pa.array(first[sel].astype(np.int32)), pa.array(count[sel].astype(np.int32)), body], ["key", "doc", "th", "start", "n", "packed"])

    def mark(batches):
        least_of: dict[bytes, int] = {}  # the strings of the last key so far, and the smallest id of each: it may go on
        for batch, goes_on in key_chunks(batches, "key", most=MOST):
            if not goes_on:
                least_of = {}
            before = len(least_of)
            key, doc, start, n = (longs(batch.column(i)) for i in (0, 1, 3, 4))
            doc, start, n = (np.append(x, y) for x, y in ((np.array([*least_of.values()], np.int64), doc), (np.zeros(before, np.int64), start), (np.zeros(before, np.int64), n)))
            th, body = batch.column(2), pa.concat_arrays([pa.array([*least_of], pa.binary()), batch.column(5)])
            lost = body.is_null().to_numpy(zero_copy_only=False)
            if key[0] != key[-1]:
                least_of = {}
            for i in (np.flatnonzero((key == key[-1]) & ~lost[before:]) + before).tolist():
                least_of.setdefault(body[i].as_py(), int(doc[i]))
            data, at = buffer_of(no_nulls(body, b""))
            hits = [(np.flatnonzero(lost), start[lost], start[lost] + n[lost] + k - 1)]
            packed, ws, we, row = words_of(data, at)
            if len(ws) >= k:
                valid = row[k - 1 :] == row[: len(row) - k + 1]
                w = np.flatnonzero(valid)
                leader = groups_of(packed, ws[w], we[w + k - 1])
                ids = doc[row[w]]
                least = np.full(len(w), np.iinfo(np.int64).max)
                np.minimum.at(least, leader, ids)
                again = np.zeros(len(valid), bool)
                again[w] = ids > least[leader]
                a, z = runs_of(np.zeros(len(valid), np.int8), row[: len(valid)], again)
                r = row[a]
                first = np.searchsorted(row, r, "left")
                hits.append((r, start[r] + a - first, start[r] + z - first + k))
            r, s, e = (np.concatenate(x) for x in zip(*hits, strict=True))
            r, s, e = (x[r >= before] for x in (r, s, e))
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(doc[r]), th.take(pa.array(r - before)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["doc", "th", "s", "e"])

    found = rows.mapInArrow(cut, SUPER).repartition("key").sortWithinPartitions("key", "doc").mapInArrow(mark, "doc long, th long, s int, e int")
    return written(found.groupBy("doc", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans")))


def with_spans(docs: DataFrame, spans: DataFrame, key: list) -> DataFrame:
    """Every row of docs as doc_id, t, spans; the span side is the small one of the join."""
    left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("t"), *key)
    names = [c for c in spans.columns if c != "spans"]
    return left.join(spans.hint("shuffle_hash"), names, "left").select("doc_id", "t", "spans.s", "spans.e")


def covered(size: int, s, e) -> np.ndarray:
    """Which of ``size`` places lie in one of the ranges [s, e)."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, s, 1)
    np.add.at(edge, e, -1)
    return np.cumsum(edge[:-1]) > 0


def substring_dedup(docs: DataFrame, k: int = WORDS, m: int = PART, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the text left) of each row.

    A word goes if a k-word window over it also starts in a document with a smaller doc_id, judged on the input.
    Null and empty texts have no words and the digest of the empty string; texts under k words lose nothing. A null
    doc_id counts as smaller than any other. Repeated rows with one id do not remove each other. Texts of any length
    are taken whole. Other columns are left out. No rows give no rows.
    """

    def keep(batches):
        for batch in batches:
            data, at = buffer_of(batch.column(1))
            raw = data.tobytes()
            s, e = batch.column(2), batch.column(3)
            out = []
            for i, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                words = raw[a:z].split()
                n, gone = len(words), 0
                if s[i].is_valid:
                    hit = covered(n, np.asarray(s[i].values), np.asarray(e[i].values))
                    gone = int(hit.sum())
                    words = [words[j] for j in np.flatnonzero(~hit)]
                kept = b" ".join(words)
                out.append((n, gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            n, gone, sha, text = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    rows = with_spans(docs, repeated_spans(docs, k, m), [key_of().alias("doc"), F.xxhash64(whole_text()).alias("th")])
    out = rows.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if with_text else out.drop("kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"), with_text=False)


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
