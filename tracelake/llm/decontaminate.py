"""Benchmark decontamination: CGK embeddings, bit-sampling LSH over item-sized windows, exact edit verification.

The CGK walk copies a byte sequence symbol by symbol; after each output a random bit, drawn from the step and the
byte, tells whether to move on. Two sequences at a small edit distance give outputs at a small Hamming distance.
A repetition has its own random bits and looks at SAMPLED of the output places; windows that agree there with a
stretch of an item are candidates. Walks start at every word of the texts and of the items (inside words of over
LONG_WORD bytes also at places told by the two bytes there) and end at a pad after the item or text, so an item is
met where its stretches are little damaged. A place is a candidate when walks from two starts met the item in line with it,
so that phrases which texts merely share don't count. The number of repetitions is the least with which TARGET of the
shortest items are met in copies with as many random letter edits as allowed, found by trial when the index is built.
Items below SHORT bytes or FEW_STARTS starts have too few stretches: they are cut into one part more than the allowed edits,
of which one must occur unchanged, so none is missed.
A candidate is verified by the edit distance of the whole item to the best-fitting stretch of the text around it, in
bytes of the normalised text. Most candidates fall before that, by a bound that loses none: the edits that the item's
parts of PART bytes need, each at its best place, never add up to more than those of the whole item.

Items are fetched in blocks of at most BLOCK_BYTES, each of which goes through all texts.
"""

from __future__ import annotations

import math
import warnings
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, longs, pieces, read, whole_text
from .windows import LOWER, Hashes, U, mix, words_of

SIMILARITY = 0.8
#: Share of the items to be met at ``SIMILARITY``, the items and copies of each tried for it, and the repetitions at most.
TARGET = 0.99
TRIED = 64
COPIES = 8
MOST_REPEATS = 32
SAMPLED = 11
STEPS = 28
#: The numbers of sampled places after which walks that no item shares are dropped.
LEVELS = (3, 5, 7, 9)
STARTS = 1 << 15
SHORT = 48
FEW_STARTS = 8
LONG_WORD = 24
STOP = 255
BLOCK_BYTES = 16 << 20
PART = 64
SEARCH_BYTES = 1 << 20

HIT = "doc_id long, item_id long, first_word long, n_words int, edit_distance int, similarity double"


@lru_cache
def sampled_steps(repeat: int) -> list[int]:
    """The output places a repetition looks at, spread over the walk, in order."""
    rng = np.random.RandomState(1000 + repeat)
    return sorted(rng.choice(STEPS, SAMPLED, replace=False).tolist())


@lru_cache
def moves(repeat: int) -> np.ndarray:
    """By step and byte, whether the walk moves on; at STOP it stays."""
    bits = mix(np.arange(256, dtype=U) ^ mix(np.array([repeat + 1], U)))
    out = ((bits[None, :] >> np.arange(STEPS, dtype=U)[:, None]) & U(1)).astype(np.int64)
    out[:, STOP] = 0
    return out


def walk(symbols: np.ndarray, start: np.ndarray, repeat: int, keep=None) -> tuple[np.ndarray, np.ndarray]:
    """Which walks from ``start`` over ``symbols`` go to the end, and their keys; ``keep(n, key)`` may drop some after the n-th sampled place."""
    move, wanted = moves(repeat), sampled_steps(repeat)
    left, at, key, n = np.arange(len(start)), start, np.full(len(start), repeat, U), 0
    for j in range(wanted[-1] + 1):
        here = symbols[at]
        if j in wanted:
            key = (key ^ here) * U(0x9E3779B97F4A7C15)
            key ^= key >> U(29)
            n += 1
            if keep is not None and n in LEVELS:
                live = np.flatnonzero(keep(n, key))
                left, at, key, here = left[live], at[live], key[live], here[live]
        at = at + move[j][here]
    return left, key


def stopped(packed: np.ndarray, ws: np.ndarray, we: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with STOP after each row; the walks' starts in them, in ``packed``, and their rows."""
    last = np.append(row[1:] != row[:-1], True)
    symbols = np.insert(packed, we[last], STOP)
    word = np.arange(len(ws))
    start = ws
    long = np.flatnonzero(we - ws > LONG_WORD)
    if len(long):
        n = (we - ws)[long] - 2
        inner = np.repeat(long, n)
        place = ws[inner] + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        some = mix(packed[place].astype(U) * U(256) + packed[place + 1]) % U(4) == 0
        word, start = np.append(word, inner[some]), np.append(start, place[some])
    rank = np.cumsum(last) - last
    return symbols, start + rank[word], start, row[word]


def damaged(body: np.ndarray, edits: int, rng: np.random.RandomState) -> bytes:
    """``body`` with so many of its places replaced by a letter, preceded by one or left out, at random."""
    out = [bytes([c]) for c in body.tolist()]
    for i in rng.choice(len(out), edits, replace=False).tolist():
        letter = bytes([rng.randint(97, 123)])
        out[i] = (letter, letter + out[i], b"")[rng.randint(3)]
    return b"".join(out)


def edit_to_best(item: np.ndarray, text: np.ndarray, most: int) -> int:
    """Edits between the whole of ``item`` and the stretch of ``text`` that needs the fewest; over ``most``: most + 1."""
    row = np.zeros(len(text) + 1, np.int64)
    place = np.arange(len(text) + 1)
    for i, c in enumerate(item.tolist(), 1):
        new = row + 1
        np.minimum(new[1:], row[:-1] + (text != c), out=new[1:])
        new[0] = i
        row = np.minimum.accumulate(new - place) + place
        if i % 32 == 0 and row.min() > most:
            return most + 1
    return int(min(row.min(), most + 1))


def least_edits(parts: np.ndarray, sizes: np.ndarray, which: np.ndarray, texts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each search the fewest edits between part ``which`` and any stretch of text row ``owner``, many searches at a time.

    A column of the edit table is two bit vectors of one machine word per search (Myers 1999). parts: (n, PART) bytes of
    which ``sizes`` count; texts: rows padded with 255, which no part has.
    """
    equal = np.zeros((len(parts), 256), U)
    for i in range(parts.shape[1]):
        inside = np.flatnonzero(i < sizes)
        equal[inside, parts[inside, i]] |= U(1) << U(i)
    equal = equal.ravel()
    base, one, last = which * 256, U(1), (sizes[which] - 1).astype(U)
    score = sizes[which].astype(np.int32)
    best, up, down = score.copy(), np.full(len(which), ~U(0)), np.zeros(len(which), U)
    for column in np.ascontiguousarray(texts.T):
        eq = equal[base + column[owner]]
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | ~(h | up), up & h
        score += ((more >> last) & one).astype(np.int32)
        score -= ((less >> last) & one).astype(np.int32)
        np.minimum(best, score, out=best)
        more <<= one
        less <<= one
        up, down = less | ~(v | more), more & v
    return best


class Index:
    """A block of items: their normalised bytes, and the keys of their walks by repetition."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY):
        self.similarity = similarity
        raw = [t.encode() for _, t in items]
        at = np.cumsum([0, *map(len, raw)])
        packed, ws, we, row = words_of(LOWER[np.frombuffer(b"".join(raw), np.uint8)], at)
        first = np.searchsorted(row, np.arange(len(items)))
        self.words = np.bincount(row, minlength=len(items))
        self.ids = np.array([i for i, _ in items], np.int64)
        self.bytes = [packed[ws[a] : we[a + n - 1]] if n else packed[:0] for a, n in zip(first.tolist(), self.words.tolist(), strict=True)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.allowed = np.array([self.most(b) for b in self.bytes], np.int64)
        self.levels, self.keys = [], []
        symbols, place, start, item = stopped(packed, ws, we, row) if len(ws) else (packed, *[np.zeros(0, np.int64)] * 3)
        self.seeded = (self.sizes > 0) & ((self.sizes < SHORT) | (np.bincount(item, minlength=len(items)) < FEW_STARTS))
        whole = (self.sizes > 0)[item] & ~self.seeded[item]
        if whole.any():
            place, item, ahead = place[whole], item[whole], (start - ws[first[item]])[whole]
            for r in range(self.repeats()):
                self._add(symbols, place, item, ahead, r)
        self.seeds = self._seeds()

    def _add(self, symbols, place, item, ahead, r: int) -> None:
        bits = min(24, max(16, int(len(place) * 40).bit_length()))
        maps = {n: np.zeros(1 << bits, bool) for n in LEVELS}

        def note(n, key):
            maps[n][(key >> U(64 - bits)).astype(np.int64)] = True
            return np.ones(len(key), bool)

        _, key = walk(symbols, place, r, note)
        order = np.argsort(key, kind="stable")
        self.levels.append((U(64 - bits), maps))
        self.keys.append((key[order], item[order], ahead[order]))

    def repeats(self) -> int:
        """The least number of repetitions with which TARGET of the shortest items (not those with seeds) are met in copies that have
        as many random edits as allowed."""
        rng = np.random.RandomState(11)
        tried = np.array([i for i in np.argsort(self.sizes, kind="stable").tolist() if self.sizes[i] and not self.seeded[i]][:TRIED])
        whole = [self.bytes[i].tobytes() for i in tried]
        # Other text follows a copy: the ends of item and text would meet too easily.
        copies = [damaged(self.bytes[i], self.allowed[i], rng) + b" " + whole[n - 1][::-1] for _ in range(COPIES) for n, i in enumerate(tried)]
        sides = []
        for texts in (whole, copies):
            at = np.cumsum([0, *map(len, texts)])
            packed, ws, we, row = words_of(np.frombuffer(b"".join(texts), np.uint8), at)
            symbols, place, start, own = stopped(packed, ws, we, row)
            sides.append((symbols, place, start - ws[np.searchsorted(row, own)], own))
        found = np.zeros((4, 0), np.int64)
        for r in range(MOST_REPEATS):
            (a, b), n = (walk(symbols, place, r)[1] for symbols, place, *_ in sides), len(tried)
            x, y = (p.ravel() for p in np.nonzero(sides[0][3][:, None] == sides[1][3][None, :] % n)) if r == 0 else (x, y)
            hit = a[x] == b[y]
            ahead, here = sides[0][2][x[hit]], sides[1][2][y[hit]]
            found = np.append(found, np.stack([tried[sides[0][3][x[hit]]], sides[1][3][y[hit]], here - ahead, ahead]), axis=1)
            if len(np.unique(self.twice(found)[1])) >= TARGET * len(copies):
                return r + 1
        warnings.warn(f"{MOST_REPEATS} walks meet fewer than {TARGET} of these items' damaged copies", stacklevel=2)
        return MOST_REPEATS

    def _seeds(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of the items with seeds, by size of part: its sorted hashes, items and places in them."""
        parts: dict[int, list] = {}
        for i in np.flatnonzero(self.seeded).tolist():
            body, n = self.bytes[i], int(self.allowed[i]) + 1
            hashes = Hashes(body)
            cuts = [len(body) * k // n for k in range(n + 1)]
            for a, z in zip(cuts, cuts[1:]):
                parts.setdefault(z - a, []).append((int(hashes.of(np.array([a]), np.array([z]))[0]), i, a))
        out = []
        for size, found in sorted(parts.items()):
            found.sort()
            h, i, a = zip(*found, strict=True)
            out.append((size, np.array(h, U), np.array(i), np.array(a)))
        return out

    def candidates(self, packed: np.ndarray, ws: np.ndarray, we: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Item, row, byte where it would begin, and the bytes between that and the place that met: of all that meet an item
        in one of its seeds, or by walks from two starts."""
        found = [np.zeros((4, 0), np.int64)]

        def meet(keys, key, start, own):
            keys, item, ahead = keys
            a, z = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            n = z - a
            which = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack([item[which], np.repeat(own, n), np.repeat(start, n) - ahead[which], ahead[which]]))

        if self.keys:
            symbols, place, start, own = stopped(packed, ws, we, row)
            for a in range(0, len(place), STARTS):
                some = slice(a, a + STARTS)
                for r, (shift, maps) in enumerate(self.levels):
                    left, key = walk(symbols, place[some], r, lambda n, key, shift=shift, maps=maps: maps[n][(key >> shift).astype(np.int64)])
                    meet(self.keys[r], key, start[some][left], own[some][left])
            found = [self.twice(np.concatenate(found, axis=1))]
        if self.seeds:
            last = np.append(row[1:] != row[:-1], True)
            head, tail, kept = ws[np.append(True, last[:-1])], we[last], row[last]
            hashes = Hashes(packed)
            for size, *keys in self.seeds:
                for a in range(0, len(packed) - size + 1, 1 << 20):
                    at = np.arange(a, min(a + (1 << 20), len(packed) - size + 1))
                    n = np.searchsorted(head, at, "right") - 1
                    inside = (n >= 0) & (at + size <= tail[n])
                    at, n = at[inside], n[inside]
                    meet(keys, hashes.of(at, at + size), at, kept[n])
        return np.concatenate(found, axis=1)

    def twice(self, found: np.ndarray) -> np.ndarray:
        """Those of the meetings that another one of their item and row supports: from another start, as many edits off as allowed at most."""
        start = found[2] + found[3]
        order = np.lexsort((start, found[2], found[1], found[0]))
        found, start = found[:, order], start[order]
        new = np.ones(len(start), bool)
        new[1:] = (found[:, 1:] != found[:, :-1]).any(0)  # several repetitions meet at one start
        found, start = found[:, new], start[new]
        item, own, begin, _ = found
        gap, live = self.allowed[item], np.zeros(len(item), bool)
        step, left = 1, np.arange(len(item))
        while len(left := left[left + step < len(item)]):
            a, b = left, left + step
            left = left[(item[a] == item[b]) & (own[a] == own[b]) & (begin[b] - begin[a] <= gap[a])]
            good = left[start[left] != start[left + step]]
            live[good] = live[good + step] = True
            step += 1
        return found[:, live]

    def most(self, body: np.ndarray) -> int:
        return math.floor(len(body) * (1 - self.similarity) + 1e-9)

    def plausible(self, item: np.ndarray, packed: np.ndarray, begin: np.ndarray, latest: np.ndarray, low: np.ndarray, high: np.ndarray, half: bool) -> np.ndarray:
        """Which candidates may be within the allowed edits, by the edits their parts need (``half``: the first half of them).

        The item begins from ``begin`` to ``latest``; its row is [low, high).
        """
        live = np.ones(len(item), bool)
        spare = latest - begin
        longest = self.sizes[item] + (self.sizes[item] // PART + 1) * spare
        order = np.lexsort((item, longest))
        longest = longest[order]
        a = 0
        while a < len(order):
            z = a + 1
            while z < len(order) and z - a < 4096 and (z + 1 - a) * longest[z] <= SEARCH_BYTES:
                z += 1
            some = order[a:z]
            own, kind = np.unique(item[some], return_inverse=True)
            bodies = [self.bytes[i] for i in own.tolist()]
            each = np.array([-(-len(b) // PART) for b in bodies])
            parts = np.concatenate([np.pad(b, (0, -len(b) % PART)) for b in bodies]).reshape(-1, PART)
            sizes = np.concatenate([np.minimum(PART, len(b) - PART * np.arange(k)) for b, k in zip(bodies, each.tolist(), strict=True)])
            n = (each[kind] + 1) // 2 if half else each[kind]
            owner = np.repeat(np.arange(len(some)), n)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            which = (np.cumsum(each) - each)[kind][owner] + nth
            # A part lies as far from the beginning as in the item, give or take the edits.
            at = begin[some][owner] + nth * PART
            upto = np.minimum(high[some][owner], at + sizes[which] + spare[some][owner])
            at = np.maximum(low[some][owner], at)
            place = at[:, None] + np.arange(max(1, int((upto - at).max())))[None, :]
            texts = np.where(place < upto[:, None], packed[np.minimum(place, len(packed) - 1)], np.uint8(255))
            edits = np.bincount(owner, weights=least_edits(parts, sizes, which, texts, np.arange(len(owner))), minlength=len(some))
            live[some] = edits <= np.array([self.most(b) for b in bodies])[kind]
            a = z
        return live

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, float]]:
        """(row, item_id, first word, words, edit distance, similarity) for each row and item: the best place in the row."""
        packed, ws, we, row = words_of(LOWER[data], offsets)
        if not len(ws):
            return []
        item, own, begin, ahead = self.candidates(packed, ws, we, row)
        if not len(item):
            return []
        # Of the places in one step the one that met nearest the item's beginning; the text from the first to the last is searched.
        bucket = begin // np.maximum(self.allowed[item], 1)
        order = np.lexsort((ahead, bucket, own, item))
        item, own, begin, bucket = (x[order] for x in (item, own, begin, bucket))
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1])
        new = np.flatnonzero(new)
        begins, latest = np.minimum.reduceat(begin, new), np.maximum.reduceat(begin, new)
        item, own, begin = item[new], own[new], begin[new]
        lo, hi = np.searchsorted(row, own, "left"), np.searchsorted(row, own, "right")
        low, high, begins, latest = ws[lo], we[hi - 1], begins - self.allowed[item], latest + self.allowed[item]
        first, past = np.maximum(low, begins), np.minimum(high, latest + self.sizes[item])
        some = np.flatnonzero(first < past)
        for half in (True, False):
            some = some[self.plausible(item[some], packed, begins[some], latest[some], low[some], high[some], half)]
        word = np.clip(np.searchsorted((ws + we) // 2, begin), lo, hi - 1) - lo
        best: dict[tuple[int, int], tuple] = {}
        for k in some.tolist():
            pair = (int(own[k]), int(item[k]))
            if best.get(pair, (1,))[0] == 0:
                continue
            body, most = self.bytes[item[k]], int(self.allowed[item[k]])
            text = packed[first[k] : past[k]]
            d = 0 if body.tobytes() in text.tobytes() else edit_to_best(body, text, most)
            if d <= most and d < best.get(pair, (most + 1,))[0]:
                best[pair] = (d, int(word[k]), int(self.words[item[k]]), 1 - d / max(1, len(body)))
        return [(r, int(self.ids[i]), max(0, b), n, d, s) for (r, i), (d, b, n, s) in sorted(best.items())]


def indexes(benchmark: DataFrame, similarity: float = SIMILARITY) -> list[Index]:
    """The items in blocks of about BLOCK_BYTES. Null and wordless items match nothing."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("t")).where("item_id is not null and trim(t) <> ''")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == b).collect()
        if rows:
            yield Index(sorted((r.item_id, r.t) for r in rows), similarity)


def _sliced(batches, text: int):
    for batch in batches:
        if batch.num_rows:
            data, at = buffer_of(batch.column(text))
            for a, b in pieces(at):
                yield batch.slice(a, b - a), data[at[a] : at[b]], at[a : b + 1] - at[a]


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, first_word, n_words, edit_distance, similarity: one row per document and item found in it.

    An item is found where a stretch of the text is within ``1 - similarity`` edits per byte of the whole item, both
    lower-cased (A-Z) with single spaces. Null and empty texts and items match nothing; a null doc_id is reported as
    null; repeated rows are reported each. Of equal places in a text the first counts. Texts are taken whole.
    Other columns play no part. No rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text())
    found = rows.sparkSession.createDataFrame([], HIT)

    def step_of(index):
        def step(batches):
            for part, data, at in _sliced(batches, 1):
                hits = index.value.search(data, at)
                if hits:
                    r, *rest = zip(*hits, strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), *(pa.array(x, t) for x, t in zip(rest, kinds, strict=True))], ["doc_id", "item_id", "first_word", "n_words", "edit_distance", "similarity"])

        return step

    for index in indexes(benchmark, similarity):
        found = found.unionByName(rows.mapInArrow(step_of(rows.sparkSession.sparkContext.broadcast(index)), HIT))
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns, without a shuffle."""
    names = docs.columns
    for index in indexes(benchmark, similarity):
        packed = docs.select(F.struct(*names).alias("row"), whole_text().alias("t"))

        def step(batches, held=docs.sparkSession.sparkContext.broadcast(index)):
            for part, data, at in _sliced(batches, 1):
                clean = np.ones(part.num_rows, bool)
                clean[[h[0] for h in held.value.search(data, at)]] = False
                yield part.filter(pa.array(clean)).select(["row"])

        docs = packed.mapInArrow(step, packed.select("row").schema).select("row.*")
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontamination": op6_decontamination}
