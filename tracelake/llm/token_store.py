"""Token ids as a Re-Pair grammar per shard, in a binary format that decodes any id range by itself.

A shard holds the ids of consecutive documents (ascending doc_id). Frequent neighbouring pairs of symbols are
replaced by nonterminals, round after round, the non-overlapping occurrences of all frequent pairs at once, until no pair
is left that occurs FREQUENT times (and half of them without overlap) or the symbols are used up: they stay below 2**16, so
a shard has at most 2**16 - FIRST rules. Layout, little-endian:

    4s magic | u4 rules, docs, symbols | u2 rule pairs | u4 expansion lengths | i8 doc ids | u4 ids per doc | u2 symbols

Shards are the rows of a Parquet table in the shared folder, written and committed by Spark.
"""

from __future__ import annotations

import os
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import NULL_ID, buffer_of, key_of, longs, pieces, read, whole_text, written
from .windows import LOWER, SPACE, mix

MAGIC = b"RPG1"
FIRST = 49408
END = 1
SHARD_TOKENS = 1 << 20
FREQUENT = 24
CACHE_WORDS = 250_000
PIECE = 4 << 20


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct u4 keys, for each key the number of its kind, and how many each kind has."""
    both = np.sort(keys.astype(np.uint64) << np.uint64(32) | np.arange(len(keys), dtype=np.uint64))
    s = (both >> np.uint64(32)).astype(np.uint32)
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    inverse = np.empty(len(s), np.int64)
    inverse[both & np.uint64(0xFFFFFFFF)] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return s[at], inverse, np.diff(at, append=len(s))


def re_pair(ids: np.ndarray, first: int = FIRST, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (n, 2) and the expansion length of each rule.

    After the first round only pairs with a symbol of the last round, and those that were frequent before it, can be frequent."""
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    lengths = np.zeros(0, np.int64)
    live = None
    while len(seq) > 1 and (free := (1 << 16) - first - len(lengths)) > 0:
        if live is None:
            slot = ((seq[:-1] << np.uint32(16) | seq[1:]) * np.uint32(2654435761)) >> np.uint32(12)
            at = np.flatnonzero((np.bincount(slot, minlength=1 << 20) >= frequent)[slot])
        else:
            at = np.flatnonzero(live[:-1])
        kind, inverse, count = counted(seq[at] << np.uint32(16) | seq[at + 1])
        best = np.argsort(-count, kind="stable")[:free]
        best = best[count[best] >= frequent]
        if not len(best):
            break
        rank = np.full(len(kind), len(kind))
        rank[best] = np.arange(len(best))
        mine = rank[inverse]
        at, mine = at[mine < len(best)], mine[mine < len(best)]
        # A pair is taken unless one that overlaps it is more frequent, or the same and before it.
        beside = at[1:] - at[:-1] == 1
        take = np.ones(len(at), bool)
        take[1:] &= ~beside | (mine[1:] < mine[:-1])
        take[:-1] &= ~beside | (mine[:-1] <= mine[1:])
        used = np.bincount(mine[take], minlength=len(best)) >= max(2, frequent // 2)
        take &= used[mine]
        chosen = at[take]
        if not len(chosen):
            break
        name = np.cumsum(used) - 1 + first + len(lengths)
        made = kind[best[used]]
        sides = np.stack([made >> np.uint32(16), made & np.uint32(0xFFFF)], axis=1)
        known = np.concatenate([np.ones(first, np.int64), lengths])
        lengths = np.concatenate([lengths, known[sides].sum(1)])
        rules.append(sides)
        seq[chosen] = name[mine[take]]
        live = np.zeros(len(seq), bool)
        live[at] = True
        live[chosen] = True
        stay = np.ones(len(seq), bool)
        stay[chosen + 1] = False
        before = chosen - 1
        before -= ~stay[before]  # over a place that goes
        live[before[before >= 0]] = True
        seq, live = seq[stay], live[stay]
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), lengths


def expand(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int = FIRST) -> np.ndarray:
    """The ids that symbols stand for. A rule's sides come before it, so each is expanded once; then the symbols are looked up."""
    if not len(rules):
        return seq.astype(np.uint32)
    size = np.append(np.ones(first, np.int64), lengths)
    begin = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.uint32)
    flat[:first] = np.arange(first)
    sides = rules.astype(np.int64)
    # All rules of one depth at a time: their sides are expanded already.
    left = np.arange(len(rules))
    known = np.arange(len(size)) < first
    while len(left):
        ready = known[sides[left]].all(1)
        now, left = left[ready], left[~ready]
        for side in (0, 1):
            source = sides[now, side]
            to = begin[now + first] + (size[sides[now, 0]] if side else 0)
            n = size[source]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            flat[np.repeat(to, n) + step] = flat[np.repeat(begin[source], n) + step]
        known[now + first] = True
    n = size[seq]
    end = np.cumsum(n)
    return flat[np.repeat(begin[seq] - end + n, n) + np.arange(int(end[-1]) if len(end) else 0)]


def pack(ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray) -> bytes:
    seq, rules, lengths = re_pair(ids)
    head = np.array([len(rules), len(doc_ids), len(seq)], "<u4")
    return b"".join([MAGIC, head.tobytes(), rules.astype("<u2").tobytes(), lengths.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), seq.astype("<u2").tobytes()])


class Shard:
    """A packed shard; ``ids(start, stop)`` expands only the symbols that the range touches."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard")
        n, d, s = np.frombuffer(blob, "<u4", 3, 4).tolist()
        at = 16
        self.rules = np.frombuffer(blob, "<u2", 2 * n, at).reshape(-1, 2)
        self.lengths = np.frombuffer(blob, "<u4", n, at := at + 4 * n).astype(np.int64)
        self.doc_ids = np.frombuffer(blob, "<i8", d, at := at + 4 * n)
        self.counts = np.frombuffer(blob, "<u4", d, at := at + 8 * d).astype(np.int64)
        self.symbols = np.frombuffer(blob, "<u2", s, at + 4 * d)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        if start == 0 and stop is None:
            return expand(self.symbols, self.rules, self.lengths)
        size = np.ones(len(self.symbols), np.int64)
        deep = self.symbols >= FIRST
        size[deep] = self.lengths[self.symbols[deep].astype(np.int64) - FIRST]
        end = np.cumsum(size)
        stop = int(end[-1]) if stop is None else stop
        a, z = int(np.searchsorted(end, start, "right")), int(np.searchsorted(end, stop, "left")) + 1
        before = int(end[a] - size[a]) if a < len(end) else start
        return expand(self.symbols[a:z], self.rules, self.lengths)[start - before : stop - before]


#: ASCII punctuation that the tokenizer splits off a preceding run of letters (the apostrophe may join it).
TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
IS_TAIL = np.isin(np.arange(256), list(TAIL))
IS_LETTER = np.isin(np.arange(256), list(range(97, 123)))


class Encoder:
    """Texts (bytes) to ids (little-endian u4 bytes), by the tokenizers library.

    The tokenizer drops white space, never joins over it, composes characters, lower-cases, and splits letters from punctuation. So the
    ids of a text are those of its words in order, and a word of letters and then punctuation has the ids of both parts, if its letters stay
    letters. Each distinct word of a few MB is looked up once; past CACHE_WORDS remembered words only those used again are kept. ASCII
    letters are made lower case beforehand, but for those that something beyond ASCII follows, which may compose with them. A run of
    ASCII letters in lower case is left as it is by the normaliser and the splitter, so it goes to the model without them. Texts with
    "<|", which begins the strings of special tokens, go through as they are. The tests compare with whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.four = [i.to_bytes(4, "little") for i in range(len(self.ends))]
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def runs(self, words: list[bytes], tokenizer) -> list[bytes]:
        """Ids of words of letters only: many at one go, cut where a token ends a word."""
        ids = np.array(tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        end = np.flatnonzero(self.ends[ids]) + 1
        if len(end) != len(words):  # a letter that isn't one after normalisation
            return self.each([w.decode() for w in words])
        raw, cut = ids.tobytes(), (end * 4).tolist()
        return [raw[p:q] for p, q in zip([0, *cut], cut)]

    def learn(self, words: set[bytes]) -> None:
        """Remembers the ids of new words."""
        plain = [w for w in words if w.isalpha()]
        tokenize, four = self.tokenizer.model.tokenize, self.four
        self.words.update((w, b"".join([four[t.id] for t in tokenize(w.decode())])) for w in plain)
        parts, split, letters, tails, whole = self.parts, [], {}, {}, []
        for w in words.difference(plain):
            head = w.rstrip(TAIL)
            if not stays_letters(head.decode("utf-8", "replace")):
                whole.append(w)
                continue
            tail = w[len(head) :]
            split.append((w, head, tail))
            if head not in parts:
                letters[head] = None
            if tail and tail not in parts:
                tails[tail] = None
        todo = list(letters)
        for i in range(0, len(todo), 1000):
            parts.update(zip(todo[i : i + 1000], self.runs(todo[i : i + 1000], self.tokenizer), strict=True))
        parts.update(zip(tails, self.each([t.decode() for t in tails]), strict=True))
        self.words.update((w, parts[head] + parts[tail] if tail else parts[head]) for w, head, tail in split)
        self.words.update(zip(whole, self.each([w.decode("utf-8", "replace") for w in whole]), strict=True))

    def known(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.words) > CACHE_WORDS:
            self.before, self.words = self.words, {}
            self.parts.clear()
        new = [w for w, ids in zip(words, map(self.words.get, words), strict=True) if ids is None]
        old = [w for w in new if w in self.before]
        self.words.update(zip(old, map(self.before.__getitem__, old), strict=True))
        self.learn(set(new).difference(old) if old else set(new))
        return list(map(self.words.__getitem__, words))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts (bytes and their offsets), each followed by END, and how many each has."""
        rows = len(offsets) - 1
        sign = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))  # <|
        whole = np.unique(np.searchsorted(offsets, sign, "right") - 1)
        lower = np.append(data[1:] < 0x80, True)[: len(data)]
        lower[offsets[1:][offsets[1:] > 0] - 1] = True  # a row's last byte
        for row in whole.tolist():
            lower[offsets[row] : offsets[row + 1]] = False
        data = np.where(lower, LOWER[data], data)
        start, end = units_of(data, offsets)
        if len(whole):
            part = ~np.isin(np.searchsorted(offsets, start, "right") - 1, whole)
            start, end = np.append(start[part], offsets[whole]), np.append(end[part], offsets[whole + 1])
            order = np.argsort(start)
            start, end = start[order], end[order]
        if not len(start):
            return np.full(rows, END, np.uint32), np.ones(rows, np.int64)
        first, kind = distinct(data, start, end)
        raw = data.tobytes()
        found = self.known([raw[a:z] for a, z in zip(start[first].tolist(), end[first].tolist(), strict=True)])
        found.append(np.array([END], "<u4").tobytes())
        after = np.searchsorted(start, offsets[1:])  # units up to the end of each text
        kind = np.insert(kind, after, len(found) - 1)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n = size[kind]
        upto = np.cumsum(n)
        shift = (np.cumsum(size) - size)[kind] - upto + n
        out = np.frombuffer(b"".join(found), "<u4")[np.repeat(shift, n) + np.arange(int(upto[-1]))]
        return out, np.diff(upto[after + np.arange(rows)], prepend=0)


def stays_letters(word: str) -> bool:
    """Whether a word is letters alone, also when it is composed and in lower case; told only of scripts whose letters are long settled."""
    return word.isalpha() and max(word) < "\u0530" and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


def units_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased texts; punctuation that follows a run of ASCII letters up to a word's end
    is a unit of its own."""
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner], last[inner - 1] = word[inner], word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    head, some = end.copy(), np.arange(len(start))
    while len(some):  # back over punctuation
        some = some[IS_TAIL[data[head[some] - 1]]]
        head[some] -= 1
        some = some[head[some] > start[some]]
    cut = np.flatnonzero((head > start) & (head < end))
    letters = np.zeros(len(data) + 1, np.int32)
    np.cumsum(IS_LETTER[data], out=letters[1:])
    cut = cut[letters[head[cut]] - letters[start[cut]] == head[cut] - start[cut]]
    head = head[cut]
    start = np.insert(start, cut + 1, head)
    end = np.insert(end, cut, head)
    return start, end


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each kind of slices [start, end), and for each slice the number of its kind. Found by hash, and compared."""
    size = end - start
    eight = np.ndarray(len(data) + 9, "<u8", np.pad(data, (8, 8)).tobytes(), strides=(1,))
    room = (8 * (8 - np.minimum(size, 8))).astype(np.uint64)
    head, tail = eight[start + 8] << room, eight[end] >> room
    h = mix(head * np.uint64(0x9E3779B97F4A7C15) ^ mix(tail ^ size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    raw, long = data.tobytes(), np.flatnonzero(size > 16)
    middle = [zlib.crc32(raw[a:z]) for a, z in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    h[long] ^= np.array(middle, np.uint64) << np.uint64(32)
    order = np.argsort(h)
    h = h[order]
    new = np.append(True, h[1:] != h[:-1])
    first, kind = order[new], np.empty(len(h), np.int64)
    kind[order] = np.cumsum(new) - 1
    its = first[kind]
    same = (size == size[its]) & (head == head[its]) & (tail == tail[its])
    long = long[its[long] != long]
    same[long] &= np.array([raw[a:z] == raw[p : p + z - a] for a, z, p in zip(start[long].tolist(), end[long].tolist(), start[its[long]].tolist(), strict=True)], bool)
    if not same.all():  # two words with one hash
        names: dict[bytes, int] = {}
        kind = np.array([names.setdefault(raw[a:z], len(names)) for a, z in zip(start.tolist(), end.tolist(), strict=True)])
        first = np.unique(kind, return_index=True)[1]
    return first, kind


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_shards(docs: DataFrame, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The written shard table: shard (ascending with doc_id), n_tokens, blob. Documents end in id 1."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def encode(batches):
        ids_of = encoder(path)
        part, made, total = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def shard():
            nonlocal made, total
            made += 1
            doc, count, ids = map(np.concatenate, zip(*held, strict=True))
            blob = pack(ids, doc, count)
            held.clear()
            total = 0
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | made], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())], ["shard", "n_tokens", "blob"])

        for batch in batches:
            data, at = buffer_of(batch.column(1))
            doc = longs(batch.column(0))
            for a, b in pieces(at, PIECE):
                ids, count = ids_of(data[at[a] : at[b]], at[a : b + 1] - at[a])
                upto = np.append(0, np.cumsum(count))
                x = 0
                while x < len(count):
                    z = min(len(count), int(np.searchsorted(upto, upto[x] + shard_tokens - total)))
                    held.append((doc[a + x : a + z], count[x:z], ids[upto[x] : upto[z]]))
                    total += int(upto[z] - upto[x])
                    x = z
                    if total >= shard_tokens:
                        yield shard()
        if held:
            yield shard()

    # Rows with one id, or none, are dealt out by their texts.
    rows = docs.select(key_of().alias("doc"), F.xxhash64(whole_text()).alias("h"), whole_text().alias("t")).repartitionByRange("doc", "h").sortWithinPartitions("doc", "h", "t").select("doc", "t")
    return written(rows.mapInArrow(encode, "shard long, n_tokens long, blob binary"))


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the stored shards."""

    def decode(batches):
        for batch in batches:
            for start, blob in zip(longs(batch.column(0)).tolist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(blob)
                raw = shard.ids().astype("<u4").tobytes()
                end = np.cumsum(shard.counts)
                begin = end - shard.counts
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(begin.tolist(), end.tolist(), strict=True)]
                ids = pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == NULL_ID)
                yield pa.RecordBatch.from_arrays([ids, pa.array(begin + start), pa.array(shard.counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row per shard of about a million ids, without the blobs.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    return shards.join(offsets, "shard").select("start", "blob").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from the written shards.

    One row per input row. Null and empty texts have the end id only. A null doc_id comes first and stays null;
    rows with one id follow each other, ordered by a hash of the text. Texts of any length are taken whole (a long one makes a
    shard longer). Other columns are left out. No rows give no rows.
    """
    return read_documents(write_shards(docs))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(read(spark, sf_dir, "documents"))


QUERIES = {"op2_token_store": op2_token_store}
