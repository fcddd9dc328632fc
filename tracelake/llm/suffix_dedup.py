"""Repeats of ``length`` bytes by difference-cover blockwise suffix sorting.

1. Cover sample of the corpus. Positions of a text whose residue modulo V is in a difference cover are the sample. For any
   two positions i and j some d < V puts both i + d and j + d in it, so two equal strings of ``length`` bytes share
   a sampled string of ``length - V + 1`` bytes. Samples whose hash occurs once are unique, and so are the suffixes
   that have no other samples: they leave here. (The hash only keeps too many: what follows compares bytes.)
2. Blocks. The suffixes left are sorted one bucket at a time. A bucket is named by the smallest part hash in the
   suffix's first ``length`` bytes, so equal ones meet, and neighbouring suffixes travel as one packed string.
   (Buckets by leading bytes would send ``length`` bytes for every single suffix.) Whole buckets of a few MB are a block;
   its difference-cover sample is ranked, then its suffixes are put in order, long ties by the sample's ranks
   (``suffix_order``). Those that share ``length`` bytes with a neighbour in that order are repeats.

Skew: equal strings of one batch go out once, marked as seen twice. Buckets with more than HOT_ROWS strings are dealt
out suffix by suffix, as 128-bit digests; their names are joined to the strings, by broadcast only if they are few. A digest's rows go
by in parts of MOST.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, key_chunks, key_of, longs, no_nulls, pieces, read, whole_text, written
from .substring_dedup import _packed, covered, with_spans
from .suffix_order import cover_of, repeated
from .windows import Hashes, groups_of, mix, runs_of, sliding_min

LENGTH = 400
PART = 16
HOT_ROWS = 4096
BLOCK_BYTES = 3 << 19
#: Rows of one bucket that a task holds at a time.
MOST = 250_000
#: Names of hot buckets are broadcast up to this number (8 MB).
FEW_NAMES = 1_000_000

ROWS = "key long, doc long, th long, start int, n int, twice boolean, packed binary"
NAMES = ["key", "doc", "th", "start", "n", "twice", "packed"]


def _identity() -> list:
    """A text's id and the hash of its bytes: rows that share both get each other's spans."""
    return [key_of().alias("doc"), F.xxhash64(whole_text()).alias("th")]


def _batches(batches, text: int):
    """Of pieces of a few MB: where they are, the batch, their bytes and the offsets of their rows."""
    for batch in batches:
        if batch.num_rows:
            data, at = buffer_of(batch.column(text))
            for a, b in pieces(at):
                yield slice(a, b), batch, data[at[a] : at[b]], at[a : b + 1] - at[a]


def _within(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts per row: each item's row and its place in it."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def whole_buckets(batches):
    """Whole buckets, of about BLOCK_BYTES together if they are small, and whether the first began before; buckets of over MOST rows, which
    are digests, come in parts."""
    for batch, goes_on in key_chunks(batches, "key", most=MOST):
        key = longs(batch.column(0))
        first = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        size = np.append(0, np.cumsum(longs(no_nulls(pc.binary_length(batch.column(6)), 0))))[first]
        a = 0
        while a < len(first) - 1:
            z = max(a + 1, int(np.searchsorted(size, size[a] + BLOCK_BYTES, "right")) - 1)
            yield batch.slice(int(first[a]), int(first[z] - first[a])), goes_on and a == 0
            a = z


def tied_samples(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """uid, pos: the sampled positions of each text whose first length - V + 1 bytes another sample may share."""
    v, cover = cover_of(length * 4 // 5)
    size = length - v + 1

    def sample(batches):
        for part, batch, data, at in _batches(batches, 1):
            uid = longs(batch.column(0))[part]
            room = np.diff(at)
            places = (np.arange(0, room.max() + v, v)[:, None] + cover[None, :]).ravel()
            row, nth = _within(np.searchsorted(places, np.maximum(room - size, -1), "right"))
            pos = places[nth]
            key = Hashes(data).of(at[row] + pos, at[row] + pos + size)
            _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            twice = count[inverse] > 1
            known = twice.copy()
            known[first] = False  # one goes out for all of them
            key = np.where(known, mix(uid[row].view(np.uint64) + pos.astype(np.uint64)), key).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(uid[row]), pa.array(pos.astype(np.int32)), pa.array(twice)], ["key", "uid", "pos", "twice"])

    def tie(batches):
        for batch, goes_on in key_chunks(batches, "key", 500_000, 16 << 20, 2_000_000):
            key = longs(batch.column(0))
            same = key[1:] == key[:-1]
            tied = batch.column(3).to_numpy(zero_copy_only=False).copy()
            tied[1:] |= same
            tied[:-1] |= same
            tied |= goes_on & (key == key[0])
            yield batch.select(["uid", "pos"]).filter(pa.array(tied))

    dealt = rows.mapInArrow(sample, "key long, uid long, pos int, twice boolean").repartition("key").sortWithinPartitions("key")
    return written(dealt.mapInArrow(tie, "uid long, pos int").groupBy("uid").agg(F.collect_set("pos").alias("pos")))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, th, spans: the byte ranges [s, e) of each text covered by ``length``-byte strings that start somewhere else too."""
    uid = F.xxhash64("doc_id", whole_text()).alias("uid")  # two texts with one uid only keep each other's samples
    rows = docs.select(uid, *_identity(), F.encode(whole_text(), "utf-8").alias("t")).where(F.octet_length("t") >= length)
    tied = tied_samples(rows.select("uid", "t"), length)
    v, part_size = cover_of(length * 4 // 5)[0], min(PART, length)

    def cut(batches):
        for part, batch, data, at in _batches(batches, 2):
            if len(data) < length:
                continue
            doc, th = (longs(batch.column(i))[part] for i in (0, 1))
            pos = batch.column(3).slice(part.start, part.stop - part.start)
            row, _ = _within(np.diff(np.asarray(pos.offsets)))
            p = at[row] + np.asarray(pos.flatten())
            inside = p < at[row + 1]
            row, p = row[inside], p[inside]
            # Suffix i may tie if a tied sample lies in [i, i + v).
            may = covered(len(data), np.maximum(p - v + 1, at[row]), p + 1)
            own = np.repeat(np.arange(len(doc)), np.diff(at))[: len(data) - length + 1]
            valid = may[: len(own)] & (np.arange(len(own)) + length <= at[own + 1])
            h = Hashes(data)
            i = np.arange(len(data) - part_size + 1)
            least = sliding_min(h.of(i, i + part_size), length - part_size + 1)
            a, z = runs_of(least, own, valid)
            if not len(a):
                continue
            leader = groups_of(data, a, z + length, h)
            many = np.bincount(leader, minlength=len(a))[leader] > 1
            known = leader != np.arange(len(a))
            key = np.where(known, mix(th[own[a]].view(np.uint64) + a.astype(np.uint64)), least[a]).view(np.int64)
            for sel in (~known, known):
                if sel.any():
                    body = pa.nulls(int(sel.sum()), pa.binary()) if sel is known else _packed(data, a[sel], z[sel] + length)
                    r = own[a[sel]]
                    yield pa.RecordBatch.from_arrays([pa.array(key[sel]), pa.array(doc[r]), pa.array(th[r]), pa.array((a - at[own[a]])[sel].astype(np.int32)), pa.array((z - a + 1)[sel].astype(np.int32)), pa.array(many[sel]), body], NAMES)

    def deal(batches):
        for batch in batches:
            pick = batch.column(7)
            batch = batch.select(NAMES)
            yield batch.filter(pc.invert(pick))
            batch = batch.filter(pick)
            doc, th, start, twice = longs(batch.column(1)), longs(batch.column(2)), longs(batch.column(3)), batch.column(5).to_pylist()
            seen: dict[bytes, int] = {}
            out = []
            for i, body in enumerate(batch.column(6).to_pylist()):
                for j in range(len(body) - length + 1):
                    digest = hashlib.blake2b(body[j : j + length], digest_size=16).digest()
                    one = [int.from_bytes(digest[:8], "little", signed=True), int(doc[i]), int(th[i]), int(start[i]) + j, 1, twice[i], digest]
                    if digest in seen:
                        out[seen[digest]][5] = True
                        one[0] ^= int(th[i]) ^ j
                        one[5:] = [True, None]
                    else:
                        seen[digest] = len(out)
                    out.append(one)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, x, strict=True)) for x in out], schema=batch.schema)

    def mark(batches):
        seen: dict[bytes, int | tuple | None] = {}  # digests of the last bucket so far: it may go on. With a place that has no equal yet
        for batch, goes_on in whole_buckets(batches):
            if not goes_on:
                seen = {}
            key, late = longs(batch.column(0)), []
            doc, th, start, n = (longs(batch.column(i)) for i in range(1, 5))
            twice = batch.column(5).to_numpy(zero_copy_only=False)
            lost = batch.column(6).is_null().to_numpy(zero_copy_only=False)
            data, at = buffer_of(no_nulls(batch.column(6), b""))
            room = np.diff(at)
            single = ~lost & (room < length)  # a digest stands for the suffix
            row, nth = _within(np.where(lost | single, 0, room - length + 1))
            again = twice[row]
            if len(row):
                again = again | repeated(data, at[row] + nth, length)
            some = np.flatnonzero(single)
            alone = twice[some]
            if len(some):
                leader = groups_of(data, at[some], at[some + 1])
                alone = alone | (np.bincount(leader, minlength=len(some))[leader] > 1)
            own = {} if key[0] != key[-1] else seen
            for j, i in enumerate(some.tolist()):
                if key[i] == key[0] and seen and (digest := batch.column(6)[i].as_py()) in seen:
                    alone[j] = True
                    if seen[digest] is not None:
                        late.append(seen[digest])
                        seen[digest] = None
                if key[i] == key[-1]:
                    digest = batch.column(6)[i].as_py()
                    if digest not in own:
                        own[digest] = None if alone[j] else (int(doc[i]), int(th[i]), int(start[i]))
            seen = own
            x, z = runs_of(np.zeros(len(row), np.int8), row, again)
            whole = np.append(np.flatnonzero(lost), some[alone])
            r = np.append(row[x], whole)
            s = np.append(start[row[x]] + nth[x], start[whole])
            e = np.append(start[row[x]] + nth[z], start[whole] + n[whole] - 1) + length
            if len(r) or late:
                more = np.array(late, np.int64).reshape(-1, 3)
                s, e = np.append(s, more[:, 2]), np.append(e, more[:, 2] + length)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(doc[r], more[:, 0])), pa.array(np.append(th[r], more[:, 1])), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["doc", "th", "s", "e"])

    blocks = written(rows.join(tied.hint("shuffle_hash"), "uid").select("doc", "th", "t", "pos").mapInArrow(cut, ROWS))
    hot = written(blocks.where("packed is not null").groupBy("key").count().where(F.col("count") > HOT_ROWS).select("key", F.lit(True).alias("hot")))
    if names := hot.count():
        is_hot = F.coalesce("hot", F.lit(False)) & F.col("packed").isNotNull()
        blocks = blocks.join(F.broadcast(hot) if names <= FEW_NAMES else hot, "key", "left").select(*NAMES, is_hot.alias("hot")).mapInArrow(deal, ROWS)
    found = blocks.repartition("key").sortWithinPartitions("key").mapInArrow(mark, "doc long, th long, s int, e int")
    return written(found.groupBy("doc", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans")))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) of each row.

    A byte goes if a ``length``-byte string over it starts anywhere else, in the same text or another, overlaps
    included, judged on the input. Null texts count as empty: no bytes, the digest of the empty string. Texts shorter
    than ``length`` lose nothing. Repeated rows count as separate texts, so long ones go whole; a null doc_id is an id
    like any other. Texts of any length are taken whole. Other columns are left out. No rows give no rows.
    """

    def keep(batches):
        for batch in batches:
            data, at = buffer_of(batch.column(1))
            raw = data.tobytes()
            s, e = batch.column(2), batch.column(3)
            out = []
            for i, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                kept, runs = raw[a:z], 0
                if s[i].is_valid:
                    hit = covered(z - a, np.asarray(s[i].values), np.asarray(e[i].values))
                    runs = int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum())
                    kept = data[a:z][~hit].tobytes()
                out.append((z - a, z - a - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = with_spans(docs, repeated_spans(docs, length), _identity())
    out = rows.mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"), with_text=False)


QUERIES = {"op10_suffix_array_dedup": op10_suffix_array_dedup}
