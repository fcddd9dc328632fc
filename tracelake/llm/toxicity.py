"""Toxicity: a linear-chain conditional random field over words.

Labels are per document, so tokens are labelled first: a word of a toxic document is toxic if it occurs in toxic
documents far more often than chance allows (a binomial bound on the counts of the word and of its beginnings). A two-state chain is
fitted to those token labels; it scores a word by its own hashed features (the word, its beginnings, its end, its length),
and neighbours by the transitions. Forward-backward marginals give toxic spans, and their strongest and their sum
give the document's score through a logistic curve fitted on documents.

The fit takes at most FIT_ROWS labelled documents of FIT_BYTES together (the ones with the smallest hashes); scoring takes
every text whole, as one chain. It is worked on in pieces of PIECE words, all pieces at once; what a piece tells the next and the
one before it is carried over exactly, so the pieces don't show in the result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, read, whole_text

FIT_ROWS = 5000
FIT_BYTES = 32 << 20
PIECE = 48
WORDS_AT_ONCE = 1 << 16
SLOTS = 1 << 18
CHANCE = 1e-6
LEAST = 3
STEMS = (4, 5, 6, 7)
REJECT = 0.7
TOKEN = re.compile(r"[^\W\d_]+")
CACHE = 100_000
#: Clean documents that the chain is fitted on, at least; more if there are more with toxic words. The curve is fitted on all.
FEWEST_CLEAN = 1000


def tokens_of(text: str) -> list[str]:
    return [w.lower() for w in TOKEN.findall(text)]


def slots_of(word: str) -> list[int]:
    """Hashed features of a word; a known word is known by itself, the affixes speak for unknown ones."""
    return [zlib.crc32(x.encode()) % SLOTS for x in (f"w:{word}", *(f"p:{word[:n]}" for n in STEMS), f"s:{word[-4:]}", f"n:{min(len(word), 20)}")]


@dataclass
class Crf:
    """Two states, 0 clean and 1 toxic. weight: per feature slot, for state 1 against 0; move: log-scores [from, to]."""

    weight: np.ndarray
    bias: float
    move: np.ndarray
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    seen: dict = field(default_factory=dict, repr=False)
    before: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"seen": {}, "before": {}}

    def emission(self, words: list[str]) -> np.ndarray:
        """Log-scores of words. Past CACHE remembered ones only those used again are kept."""
        if len(self.seen) > CACHE:
            self.before, self.seen = self.seen, {}
        seen, before = self.seen, self.before
        for w in set(words).difference(seen):
            x = before.get(w)
            seen[w] = self.bias + float(self.weight[slots_of(w.lower())].sum()) if x is None else x
        return np.fromiter(map(seen.__getitem__, words), np.float64, len(words))


def pieces_of(lengths: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents in pieces: the places of their words as a (pieces, size) matrix into the joined words, a mask, and each piece's number in its document."""
    per = -(-lengths // size)
    doc = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    begin = (np.cumsum(lengths) - lengths)[doc] + nth * size
    have = np.minimum(lengths[doc] - nth * size, size)
    step = np.arange(size)
    mask = step[None, :] < have[:, None]
    return np.where(mask, begin[:, None] + step[None, :], 0), mask, nth


def _carried(steps: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], nth: np.ndarray, back: bool) -> np.ndarray:
    """The ratio that comes into each piece from its document's others. A step maps a ratio x to (c + d x) / (a + b x)."""
    a, b, c, d = np.ones(len(nth)), np.zeros(len(nth)), np.zeros(len(nth)), np.ones(len(nth))
    for p, q, r, s in steps:
        a, b, c, d = p * a + q * c, p * b + q * d, r * a + s * c, r * b + s * d
        norm = a + b + c + d
        a, b, c, d = a / norm, b / norm, c / norm, d / norm
    out = np.ones(len(nth))
    order = np.argsort(nth, kind="stable")
    cut = np.searchsorted(nth[order], np.arange(1, (nth.max() if len(nth) else 0) + 2))
    levels = [order[x:y] for x, y in zip(cut, cut[1:])]
    for to in reversed(levels) if back else levels:
        source, to = (to, to - 1) if back else (to - 1, to)
        out[to] = (c[source] + d[source] * out[source]) / (a[source] + b[source] * out[source])
    return out


def forward_backward(emit: np.ndarray, mask: np.ndarray, move: np.ndarray, nth: np.ndarray, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """P(state 1) per place, and the expected transitions [from, to] over all documents if wanted. emit: log-score of state 1 against 0.

    With two states a message is one ratio, of state 1 to state 0, and a step maps it by a fraction of two linear terms;
    such maps compose, so each piece is first composed to one map, and the messages between pieces follow from these.
    """
    n, size = emit.shape
    odds = np.exp(np.clip(emit, -30, 30))
    (s00, s01), (s10, s11) = np.exp(move)
    one, zero = np.ones(n), np.zeros(n)
    carry = (nth > 0).any()
    ahead = _carried(((np.where(m, s00, one), np.where(m, s10 * o, zero), np.where(m, s01, zero), np.where(m, s11 * o, one)) for o, m in zip(odds.T, mask.T)), nth, False) if carry else one
    behind = _carried(((np.where(m, s00, one), np.where(m, s01 * o, zero), np.where(m, s10, zero), np.where(m, s11 * o, one)) for o, m in zip(odds.T[::-1], mask.T[::-1])), nth, True) if carry else one
    left, right, b = np.empty((n, size)), np.empty((n, size)), behind
    for t in range(size):
        left[:, t] = odds[:, t] * ahead  # ratio of the words up to here
        ahead = (s01 + s11 * left[:, t]) / (s00 + s10 * left[:, t])
    for t in range(size - 1, -1, -1):
        right[:, t] = b  # ratio of the words after
        b = np.where(mask[:, t], (s10 + s11 * odds[:, t] * b) / (s00 + s01 * odds[:, t] * b), b)
    ratio = left * right
    p = np.where(mask, ratio / (1 + ratio), 0.0)
    if not with_pairs:
        return p, None
    go = odds * right
    frm, to, live = left[:, :-1].ravel(), go[:, 1:].ravel(), mask[:, 1:].ravel()
    late = np.flatnonzero(nth > 0)
    frm, to = np.append(frm[live], left[late - 1, -1]), np.append(to[live], go[late, 0])
    w = np.stack([np.full(len(frm), s00), s01 * to, s10 * frm, s11 * frm * to])
    pairs = (w / w.sum(0)).sum(1).reshape(2, 2)
    return p, pairs


def forms_of(word: str) -> list[str]:
    """The word and its beginnings, which inflected forms share ("idiot", "idio-", ...)."""
    return [word, *(f"{word[:n]}-" for n in STEMS if n < len(word))]


def toxic_forms(docs: list[list[str]], labels: np.ndarray, chance: float = CHANCE) -> set[str]:
    """Forms that occur in toxic documents more often than the overall rate lets expect (Chernoff bound on the binomial tail).

    A word counts once for each neighbour it is seen with, so that copies of one toxic text don't make all of
    its words toxic.
    """
    count = Counter(form for words, y in zip(docs, labels, strict=True) if y for w in set(words) for form in forms_of(w))
    often = {form for form, n in count.items() if n >= LEAST}
    bad: dict[str, tuple[set, set]] = defaultdict(lambda: (set(), set()))
    good: dict[str, set] = defaultdict(set)
    for toxic in (True, False):
        for words, y in zip(docs, labels, strict=True):
            if bool(y) == toxic:
                line = ["", *words, ""]
                for w, i in {w: i for i, w in enumerate(words)}.items():
                    for form in forms_of(w):
                        if form not in often:
                            continue
                        if toxic:
                            bad[form][0].add(line[i])
                            bad[form][1].add(line[i + 2])
                        elif form in bad:
                            good[form].add(line[i])
    rate = min(max(float(labels.mean()) if len(labels) else 0.0, 1e-6), 1 - 1e-6)
    out = set()
    for form, (left, right) in bad.items():
        k = min(len(left), len(right))
        if k < LEAST:
            continue
        n = k + len(good.get(form, ()))
        q = min(k / n, 1 - 1e-9)
        if q > max(0.85, rate) and n * (q * math.log(q / rate) + (1 - q) * math.log((1 - q) / (1 - rate))) > -math.log(chance):
            out.add(form)
    return out


def fit(texts: list[str], labels: list[int], passes: int = 30, seed: int = 1) -> Crf:
    """Fits the chain by gradient steps on the conditional likelihood, then the curve from marginals to document labels."""
    y = np.array(labels, np.float64)
    docs = [[intern(w) for w in tokens_of(t)] for t in texts]
    forms = toxic_forms(docs, y)
    bad = {w for d, t in zip(docs, y, strict=True) if t for w in set(d) if not forms.isdisjoint(forms_of(w))}
    crf = Crf(np.zeros(SLOTS), -4.0, np.zeros((2, 2)))
    # The documents that hold a toxic word, and as many others again (FEWEST_CLEAN at least).
    rng = np.random.RandomState(seed)
    with_bad = [d for d, t in zip(docs, y, strict=True) if t and not bad.isdisjoint(d)]
    others = [d for d in docs if d and bad.isdisjoint(d)]
    pick = with_bad + [others[i] for i in rng.permutation(len(others))[: max(FEWEST_CLEAN, len(with_bad))]]
    if with_bad:
        number: dict[str, int] = {}
        which = np.array([number.setdefault(w, len(number)) for d in pick for w in d])
        slots = np.array([slots_of(w) for w in number])
        truth = np.array([w in bad for w in number], np.float64)[which]
        at, mask, nth = pieces_of(np.array([len(d) for d in pick]))
        gold = truth[at] * mask
        g, late = gold.astype(int), np.flatnonzero(nth > 0)
        frm, to, live = g[:, :-1], g[:, 1:], mask[:, 1:]
        moved = np.bincount(np.append((frm * 2 + to)[live], g[late - 1, -1] * 2 + g[late, 0]), minlength=4).reshape(2, 2).astype(float)
        square = np.full(SLOTS, 1e-2)
        for _ in range(passes):
            emit = (crf.bias + crf.weight[slots].sum(1))[which]
            p, pairs = forward_backward(emit[at], mask, crf.move, nth)
            err = gold - p
            per_word = np.bincount(which[at[mask]], weights=err[mask], minlength=len(slots))
            step = np.bincount(slots.ravel(), weights=np.repeat(per_word, slots.shape[1]), minlength=SLOTS) - 0.01 * crf.weight
            square += step**2
            crf.weight += 0.5 * step / np.sqrt(square)
            crf.bias += 0.5 * err.sum() / mask.sum() ** 0.5 / 10
            crf.move += 0.5 * (moved - pairs) / (moved.sum(1, keepdims=True) + 1)
            crf.move -= crf.move.mean()
    top, total, _ = summarise(crf, docs)
    crf.curve = logistic(top, total, y)
    return crf


def summarise(crf: Crf, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document the strongest marginal and the expected number of toxic words; and the marginals of all words in a row."""
    lengths = np.array([len(d) for d in docs], np.int64)
    p = marginals(crf, docs, lengths)
    owner = np.repeat(np.arange(len(docs)), lengths)
    top = np.zeros(len(docs))
    np.maximum.at(top, owner, p)
    return top, np.bincount(owner, weights=p, minlength=len(docs)), p


def marginals(crf: Crf, docs: list[list[str]], lengths: np.ndarray) -> np.ndarray:
    """Of all words in a row; some documents at a time."""
    out, first, upto = np.empty(int(lengths.sum())), 0, np.append(0, np.cumsum(lengths))
    while first < len(docs):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + WORDS_AT_ONCE, "right")) - 1)
        own = out[upto[first] : upto[last]]
        if len(own):
            emit = crf.emission([w for d in docs[first:last] for w in d])
            at, mask, nth = pieces_of(lengths[first:last])
            p, _ = forward_backward(emit[at], mask, crf.move, nth, False)
            own[at[mask]] = p[mask]
        first = last
    return out


def logistic(top: np.ndarray, total: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Intercept and two slopes (not negative), by Newton steps with a small ridge."""
    x = np.stack([np.ones(len(top)), top, np.minimum(np.log1p(total), 3)], 1)
    w = np.zeros(3)
    for _ in range(50 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        w = w + np.linalg.solve(hess, x.T @ (y - p) - 0.05 * w)
        w[1:] = np.maximum(w[1:], 0)
    return tuple(w)


def score_of(crf: Crf, top: np.ndarray, total: np.ndarray) -> np.ndarray:
    a, b, c = crf.curve
    return 1 / (1 + np.exp(-np.clip(a + b * top + c * np.minimum(np.log1p(total), 3), -30, 30)))


def held_out() -> Column:
    """Labels of these rows are never learnt from: crc32(doc_id as text) mod 3 is 1."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Crf:
    """A chain fitted on labelled documents that aren't held out: at most ``fit_rows``, of at most ``fit_bytes`` together (one, if
    it is longer). Of labels that differ for one id the higher counts. Without labels it scores all alike."""
    rule = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    some = rule.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("t")).join(F.broadcast(some), "doc_id").withColumn("th", F.xxhash64("t"))
    sizes = rows.select("doc_id", "th", F.octet_length("t").alias("n")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(fit_rows).collect()
    room = np.cumsum([r.n for r in sizes]) <= fit_bytes
    keys = [(r.doc_id, r.th) for r, fits in zip(sizes, room.tolist(), strict=True) if fits or r is sizes[0]]
    if not keys:
        return fit([], [])
    chosen = docs.sparkSession.createDataFrame(keys, "doc_id long, th long")
    found = {(r.doc_id, r.th): r for r in rows.join(F.broadcast(chosen), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).collect()}
    used = [found[k] for k in sorted(found)]
    return fit([r.t for r in used], [r.toxic for r in used])


def _scores(crf: Crf, texts: list[str]) -> np.ndarray:
    return score_of(crf, *summarise(crf, [TOKEN.findall(t) for t in texts])[:2])


SPANS = "array<struct<begin:int,end:int,marginal:double>>"


def score(docs: DataFrame, crf: Crf, least: float = 0.5) -> DataFrame:
    """doc_id, score, spans of each row: spans are the character offsets of the words whose marginal reaches ``least``, in order.
    Only the text is looked at."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def step(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                texts = batch.column(1).slice(a, 500).to_pylist()
                docs_ = [TOKEN.findall(t) for t in texts]
                top, total, p = summarise(crf, docs_)
                end = np.cumsum([len(d) for d in docs_])
                spans: list[list[dict]] = [[] for _ in texts]
                for i in np.flatnonzero(top >= least).tolist():
                    own = p[end[i] - len(docs_[i]) : end[i]]
                    found = [m.span() for m in TOKEN.finditer(texts[i])]
                    spans[i] = [{"begin": found[j][0], "end": found[j][1], "marginal": float(own[j])} for j in np.flatnonzero(own >= least)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 500), pa.array(score_of(crf, top, total)), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text()).mapInArrow(step, f"doc_id long, score double, spans {SPANS}")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of each row.

    Null and empty texts get the score of a text without toxic words; a null doc_id is not held out. Repeated rows
    get equal scores. Texts of any length are taken whole. Offsets are characters of the text as it is. Other columns play no
    part. No rows give no rows.
    """
    rows = score(docs, learn(docs, labels))
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), "spans")


def accepted(docs: DataFrame, crf: Crf, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` whose score is below ``reject``, all columns, without a shuffle."""
    packed = docs.withColumn("text", F.col("text").cast("string")).select(F.struct(*docs.columns).alias("row"))
    place = docs.columns.index("text")

    def step(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = part.column(0).flatten()[place].to_pylist()
                yield part.filter(pa.array(_scores(crf, [t or "" for t in texts]) < reject))

    return packed.mapInArrow(step, packed.schema).select("row.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op3_toxicity": op3_toxicity}
