"""Documents packed into sequences of a fixed number of tokens: bin completion over the lengths' histogram.

How many sequences are needed depends on how many pieces of each length there are, and there are at most as many lengths as a sequence
has tokens. So only that histogram is searched, whatever the number of documents: by bin completion with branch and bound. What it
finds are fillings (lengths that share a sequence) and how often each is used. Pieces then take the places of their length in order,
by their number within the length, which follows from the counts per task without a shuffle of the pieces.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_tokens import byte_encoder
from .common import buffer_of, pieces, read, whole_text, written

CAPACITY = 1024
END = 2
PIECE = 4 << 20
#: Steps of the search after which the best found so far is taken, fillings tried at a step, and what is looked at to find these.
STEPS, BRANCHES, LOOKS = 20_000, 8, 4_000

Filling = tuple[tuple[int, int], ...]  # (length, how often), longest first


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences: all tokens, or the long pieces and what can't go beside them."""
    size = np.arange(len(counts))
    number, tokens = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * size))
    best = -(-int(tokens[-1]) // capacity)
    half = capacity // 2
    for k in range(1, half + 1):
        alone = int(number[capacity + 1] - number[capacity - k + 1])
        shared = int(number[capacity - k + 1] - number[half + 1])
        room = shared * capacity - int(tokens[capacity - k + 1] - tokens[half + 1])
        small = int(tokens[half + 1] - tokens[k])
        best = max(best, alone + shared + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Best fit, longest first, for all pieces of a length at once: fillings and how often they are used."""
    open_: list[tuple[int, Filling, int]] = []  # room, filling, how many; by room
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        at = bisect.bisect_left(open_, (size,))
        taken, rest = open_[at:], open_[:at]
        for i, (room, filling, many) in enumerate(taken):
            k = room // size
            full = min(many, left // k)
            if full:
                rest.append((room - k * size, (*filling, (size, k)), full))
                left, many = left - full * k, many - full
            if left and many:
                rest.append((room - left * size, (*filling, (size, left)), 1))
                left, many = 0, many - 1
            if many:
                rest.append((room, filling, many))
            if not left:
                rest += taken[i + 1 :]
                break
        k = capacity // size
        if left >= k:
            rest.append((capacity - k * size, ((size, k),), left // k))
        if left % k:
            rest.append((capacity - left % k * size, ((size, left % k),), 1))
        open_ = sorted(rest)
    return [(filling, many) for _, filling, many in open_]


def completions(counts: np.ndarray, room: int, branches: int = BRANCHES, looks: int = LOOKS) -> list[tuple[int, tuple[int, ...]]]:
    """(waste, lengths) of undominated ways to fill ``room``, least waste first and of these the fewest and longest pieces.

    A way is dominated if some of its pieces can be taken out for one single piece that is as long or longer and fits as well.
    """
    sizes = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    if not sizes:
        return [(room, ())]
    smallest, have = sizes[-1], counts.tolist()
    rising = sizes[::-1]
    found: list[tuple[int, tuple[int, ...]]] = []
    looked = 0

    def largest(most: int, used: tuple[int, ...]) -> int:
        """The longest piece up to ``most`` that is not used up."""
        i = bisect.bisect_right(rising, most) - 1
        while i >= 0 and used.count(rising[i]) >= have[rising[i]]:
            i -= 1
        return rising[i] if i >= 0 else 0

    def dominated(used: tuple[int, ...], waste: int) -> bool:
        sums = {0}
        for s in used[:6]:
            sums |= {s + t for t in sums}
        for t in sums:
            x = largest(t + waste, used)
            if x > t or (x == t and t not in used and t):
                return True
        return False

    def fill(left: int, start: int, used: tuple[int, ...]) -> None:
        nonlocal looked
        looked += 1
        if left < smallest or start >= len(sizes):
            if not dominated(used, left):
                found.append((left, used))
            return
        i = max(start, len(rising) - bisect.bisect_right(rising, left))
        any_ = False
        while i < len(sizes) and looked < looks and sum(w == 0 for w, _ in found[-branches:]) < branches:
            s = sizes[i]
            if used.count(s) < have[s]:
                any_ = True
                fill(left - s, i, (*used, s))
            i += 1
        if not any_ and not dominated(used, left):
            found.append((left, used))

    def greedy(left: int) -> tuple[int, tuple[int, ...]]:
        used: tuple[int, ...] = ()
        while s := largest(left, used):
            used, left = (*used, s), left - s
        return left, used

    def pair() -> list[tuple[int, tuple[int, ...]]]:
        """The best pieces by themselves, or with one more."""
        out = []
        for s in sizes:
            t = largest(room - s, (s,))
            out.append((room - s - t, (s, t) if t else (s,)))
        return sorted(out)[:branches]

    first = [greedy(room)] + [(w, u) for w, u in pair() if not dominated(u, w)]
    if not any(w == 0 for w, _ in first) or len(sizes) <= 64:
        fill(room, 0, ())
    found += first
    order = sorted({(w, tuple(sorted(u, reverse=True))) for w, u in found}, key=lambda x: (x[0], len(x[1]), tuple(-s for s in x[1])))
    return order[:branches]


def complete_bins(counts: np.ndarray, capacity: int, steps: int = STEPS) -> list[tuple[Filling, int]]:
    """Bin completion: round the longest piece left, the undominated fillings are tried, least waste first, each as often as it can be used.

    ``best_fit`` gives the first solution. A branch whose waste can't lead to fewer sequences than the best solution is left, and the
    search ends where none can be better or after ``steps`` fillings; then the best solution so far is given.
    """
    tokens = int((counts * np.arange(len(counts))).sum())
    best = best_fit(counts, capacity)
    used, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    if used <= bound:
        return best
    allowed = (used - 1) * capacity - tokens
    now = counts.copy()
    path: list[tuple[Filling, int, int]] = []  # filling, how often, waste
    stack: list[list[tuple[int, tuple[int, ...]]]] = []
    waste = 0

    def options() -> list[tuple[int, tuple[int, ...]]]:
        longest = int(np.flatnonzero(now)[-1])
        now[longest] -= 1
        found = completions(now, capacity - longest)
        now[longest] += 1
        return [(w, (longest, *u)) for w, u in found][::-1]

    if len(counts) and counts.any():
        stack.append(options())
    while stack and steps:
        if not stack[-1]:
            stack.pop()
            if path:
                filling, n, lost = path.pop()
                for s, k in filling:
                    now[s] += k * n
                waste -= lost
            continue
        w, pieces_ = stack[-1].pop()
        filling = tuple((s, pieces_.count(s)) for s in sorted(set(pieces_), reverse=True))
        n = min(int(now[s]) // k for s, k in filling)
        if w:
            n = min(n, (allowed - waste) // w)
        if n <= 0:
            continue
        steps -= 1
        for s, k in filling:
            now[s] -= k * n
        path.append((filling, n, w * n))
        waste += w * n
        if not now.any():
            best, used = [(f, m) for f, m, _ in path], sum(m for _, m, _ in path)
            if used <= bound:
                break
            allowed = (used - 1) * capacity - tokens
            stack.append([])
        else:
            stack.append(options())
    return best


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The written table of pieces: doc_id, piece, start, length, ids (little-endian u4), and the task that made it with its number among the
    task's pieces of that length."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def step(batches):
        ids_of, task = byte_encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, at = buffer_of(batch.column(1))
            for a, b in pieces(at, PIECE):
                ids, tokens = ids_of(data[at[a] : at[b]], at[a : b + 1] - at[a], end)
                many = -(-tokens // capacity)
                row = np.repeat(np.arange(len(tokens)), many)
                number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                first = (tokens - 1) % capacity + 1
                start = np.where(number > 0, first[row] + (number - 1) * capacity, 0)
                length = np.where(number > 0, capacity, first[row])
                order = np.argsort(length, kind="stable")
                line = length[order]
                new = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
                size = np.diff(np.append(new, len(line)))
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(line)) - np.repeat(new, size) + seen[line]
                seen[line[new]] += size
                bounds = np.append(0, np.cumsum(4 * length)).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u4", copy=False))])
                columns = [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), binary, pa.array(np.full(len(row), task, np.int64)), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "task", "nth"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("t"))
    return written(rows.mapInArrow(step, "doc_id long, piece int, start long, length long, ids binary, task long, nth long"))


class Places:
    """Where the pieces of each length go: for the n-th of a length its sequence and its offset there."""

    def __init__(self, plan: list[tuple[Filling, int]]):
        rows, first = [], 0
        upto: dict[int, int] = {}
        for filling, many in plan:
            offset = 0
            for size, k in filling:
                rows.append((size, upto.get(size, 0), first, k, offset))
                upto[size] = upto.get(size, 0) + k * many
                offset += size * k
            first += many
        self.size, self.nth, self.sequence, self.each, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        self.first = np.searchsorted(self.size, np.arange(int(self.size.max(initial=0)) + 2))

    def of(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((nth, length))
        at = np.empty(len(length), np.int64)
        line = length[order]
        for a, b in zip(*_runs(line), strict=True):
            low, high = self.first[line[a]], self.first[line[a] + 1]
            at[order[a:b]] = low + np.searchsorted(self.nth[low:high], nth[order[a:b]], "right") - 1
        turn, slot = np.divmod(nth - self.nth[at], self.each[at])
        return self.sequence[at] + turn, self.offset[at] + slot * length


def _runs(line: np.ndarray) -> tuple[list[int], list[int]]:
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
    return first.tolist(), np.append(first[1:], len(line)).tolist()[: len(first)]


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, steps: int = STEPS) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: pieces of documents, and each one's place in a sequence of at most ``capacity`` tokens.

    A document is the ids of its text and then ``end``. One of more than ``capacity`` ids is cut into pieces of that many, the first
    of which has what is left over. Pieces of a sequence lie without gaps from 0. Null and empty texts are the end id only. Every row is
    a document of its own, also one with a null or a repeated doc_id. Which of several pieces of one length takes which place
    follows the order in which tasks read them. Texts of any length are taken whole. Other columns are left out. No rows give no rows.
    """
    table = token_pieces(docs, path, capacity, end)
    per_task = written(table.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length, at most ``capacity``
        counts[row.length] = row.n
    places = Places(complete_bins(counts, capacity, steps))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begin = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, nth: pd.Series) -> pd.DataFrame:
        sequence, offset = places.of(length.to_numpy(np.int64), nth.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    found = table.join(begin, ["task", "length"]).withColumn("place", place("length", F.col("before") + F.col("nth")))
    return found.select("doc_id", "piece", "start", "length", "ids", "place.sequence_id", "place.offset")


def sequences(pieces_: DataFrame) -> DataFrame:
    """sequence_id, ids (array), documents (doc_id, piece, offset) of each sequence of ``packed``; a sequence has at most as many pieces as tokens."""
    line = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))

    @F.pandas_udf("array<int>")
    def joined(parts: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([np.frombuffer(p["ids"], "<u4") for p in row]).astype(np.int32) for row in parts])

    rows = pieces_.groupBy("sequence_id").agg(line.alias("line"))
    return rows.select("sequence_id", joined("line").alias("ids"), F.expr("transform(line, x -> struct(x.doc_id, x.piece, x.offset))").alias("documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packed(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES = {"op11_best_fit_packing": op11_best_fit_packing}
