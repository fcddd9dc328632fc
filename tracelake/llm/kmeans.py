"""Lloyd's rounds over integer vectors with two trees: cover trees over the vectors, and one over the centroids each round.

Vectors stay where they are: each task cuts its rows into blocks, builds the cover tree of each block once, and writes it. A round
reads the blocks, builds the small tree of the centroids, and goes down both: pairs of nodes whose distance bounds tell that no
vector below the one can be nearest to a centroid below the other are dropped; pairs of leaves that are left are compared
exactly, in integers. Only sums per centroid leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import longs, read, written

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Vectors of a block, vectors a leaf is aimed at, and the factor between the radii of two levels.
BLOCK, LEAF, STEP = 4096, 8, 1.3
#: Larger components have squared distances that a long can't hold.
LARGEST = 2**27
#: Up to here sums of squared differences are exact in doubles.
EXACT_IN_DOUBLES = 2**22
PAIRS_AT_ONCE = 1 << 15
NODE = np.dtype([("point", "<i4"), ("radius", "<f8"), ("first", "<i4"), ("end", "<i4")])


def squares(x: np.ndarray, i: np.ndarray, c: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows i of x and j of c, as int64; both are float64 where that is exact, int64 else."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), PAIRS_AT_ONCE):
        d = x[i[a : a + PAIRS_AT_ONCE]] - c[j[a : a + PAIRS_AT_ONCE]]
        out[a : a + PAIRS_AT_ONCE] = np.einsum("ij,ij->i", d, d)
    return out


def number_kind(*arrays: np.ndarray) -> type:
    return np.float64 if max((int(np.abs(a).max(initial=0)) for a in arrays), default=0) <= EXACT_IN_DOUBLES else np.int64


class CoverTree:
    """Levels of nested nets. ``levels[i]``: point of each node, its radius (the furthest point below it), the range of its children in the next
    level, or of its points in ``order`` at the last level.

    The points are taken furthest first, so those that a level of radius r needs are a prefix, any two of them are at least r apart, and
    every other point is within r of one; a level is made wherever a radius of STEP to some power adds nodes.
    """

    def __init__(self, levels: list[np.ndarray], order: np.ndarray):
        self.levels, self.order = levels, order

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> CoverTree:
        n = len(points)
        x = points.astype(np.float64)
        norm = np.einsum("ij,ij->i", x, x)

        def away(i: int) -> np.ndarray:
            d = x - x[i] if n < 256 else None
            square = np.einsum("ij,ij->i", d, d) if d is not None else norm + norm[i] - 2 * (x @ x[i])
            return np.sqrt(np.maximum(square, 0))

        picked = [0]
        near = away(0)
        whose = np.zeros(n, np.int64)  # the picked point that each point is nearest to
        snapshots = []
        bound = near.max(initial=0.0)
        while len(picked) < max(1, -(-n // leaf)):
            i = int(near.argmax())
            far = near[i]
            if far <= 1e-6 * (1 + bound):
                break
            if not snapshots or far < bound / STEP:
                snapshots.append((len(picked), whose.copy()))
                bound = far
            d = away(i)
            closer = d < near
            whose[closer] = len(picked)
            np.minimum(near, d, out=near)
            picked.append(i)
        if not snapshots or snapshots[-1][0] < len(picked):
            snapshots.append((len(picked), whose))
        picked = np.array(picked)
        # A node's parent is the node of the level above that is nearest to its point; a point's leaf is that of the last level.
        paths = [snapshots[-1][1]]
        for _, owner in snapshots[-2::-1]:
            paths.insert(0, owner[picked][paths[0]])
        order = np.lexsort(paths[::-1])
        exact = points.astype(number_kind(points))
        new, firsts, levels = np.zeros(n, bool), [], []
        new[0] = True
        for path in paths:
            line = path[order]
            new[1:] |= line[1:] != line[:-1]
            first = np.flatnonzero(new)
            centre = picked[line[first]]
            size = np.diff(np.append(first, n))
            away_from = np.sqrt(squares(exact, order, exact, np.repeat(centre, size)).astype(np.float64))
            level = np.zeros(len(first), NODE)
            level["point"], level["radius"] = centre, np.maximum.reduceat(away_from, first)
            firsts.append(first)
            levels.append(level)
        for i, level in enumerate(levels):
            below = firsts[i + 1] if i + 1 < len(firsts) else np.arange(n)
            level["first"] = np.searchsorted(below, firsts[i])
            level["end"] = np.append(level["first"][1:], len(below))
        return cls(levels, order)

    def packed(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<i4")
        return sizes.tobytes() + b"".join(level.tobytes() for level in self.levels)

    @classmethod
    def unpacked(cls, raw: bytes, n: int) -> CoverTree:
        """A tree over points in tree order."""
        depth = int(np.frombuffer(raw, "<i4", 1)[0])
        sizes, at, levels = np.frombuffer(raw, "<i4", depth, 4), 4 + 4 * depth, []
        for size in sizes.tolist():
            levels.append(np.frombuffer(raw, NODE, size, at))
            at += size * NODE.itemsize
        return cls(levels, np.arange(n))


def _ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each member of the ranges the number of its range, and the member."""
    size = end - first
    whose = np.repeat(np.arange(len(first)), size)
    return whose, np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def nearest(points: np.ndarray, tree: CoverTree, centroids: np.ndarray, above: CoverTree) -> tuple[np.ndarray, np.ndarray, int]:
    """For each of ``points`` (in tree order) the nearest centroid, the smaller number of equals, its squared distance, and how many distances were needed."""
    kind = number_kind(points, centroids)
    x, c = points.astype(kind), centroids.astype(kind)
    needed, depth_q, depth_r = 0, 0, 0
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)  # the two roots
    while True:
        left, right = tree.levels[depth_q], above.levels[depth_r]
        d = np.sqrt(squares(x, left["point"][q], c, right["point"][r]).astype(np.float64))
        needed += len(d)
        below, beside = left["radius"][q], right["radius"][r]
        slack = 1e-9 * (d + below + beside) + 1e-6
        # No vector below q is nearer to a centroid below r than the first, and none is further from r's own centroid than the second.
        low, high = d - below - beside - slack, d + below + slack
        new = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        stay = low <= np.repeat(np.minimum.reduceat(high, new), np.diff(np.append(new, len(q))))
        q, r = q[stay], r[stay]
        last_q, last_r = depth_q == len(tree.levels) - 1, depth_r == len(above.levels) - 1
        if last_q and last_r:
            break
        if not last_r:
            pair, r = _ranges(right["first"][r], right["end"][r])
            q, depth_r = q[pair], depth_r + 1
        if not last_q:
            pair, child = _ranges(left["first"][q], left["end"][q])
            order = np.lexsort((r[pair], child))
            q, r, depth_q = child[order], r[pair][order], depth_q + 1
    pair, at = _ranges(above.levels[-1]["first"][r], above.levels[-1]["end"][r])  # a leaf has one centroid, or equal ones
    q, number = q[pair], above.order[at]
    leaves = tree.levels[-1]
    sizes = (leaves["end"] - leaves["first"]).astype(np.int64)
    pairs = int(sizes[q].sum())
    if kind is np.float64 and pairs * 8 > len(x) * len(c):  # many are left: products of matrices, with those dropped masked
        left_over = np.zeros((len(leaves), len(c)), bool)
        left_over[q, number] = True
        d = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", c, c) - 2 * (x @ c.T)
        d[~left_over[np.repeat(np.arange(len(leaves)), sizes)]] = np.inf
        best = d.argmin(1)  # the first of equals
        return best, d[np.arange(len(x)), best].astype(np.int64), needed + pairs
    pair, point = _ranges(leaves["first"][q], leaves["end"][q])
    number = number[pair]
    d = squares(x, point, c, number)
    order = np.lexsort((number, d, point))
    first = order[np.append(True, point[order][1:] != point[order][:-1])]
    return number[first], d[first], needed + pairs


def blocks(vectors: DataFrame, block: int = BLOCK, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """The written table of blocks: ids and integer vectors in tree order, and the packed tree. Rows with another number of components, a
    null or a non-finite one are left out."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def made(ids: pa.Array, rows: np.ndarray) -> pa.RecordBatch:
            tree = CoverTree.build(rows)
            rows = rows[tree.order]
            # Nodes name points by their place in tree order.
            place = np.empty(len(rows), np.int32)
            place[tree.order] = np.arange(len(rows))
            for level in tree.levels:
                level["point"] = place[level["point"]]
            ids = ids.take(pa.array(tree.order))
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([rows.astype("<i4").tobytes()], pa.binary()), pa.array([tree.packed()], pa.binary())], ["ids", "vectors", "tree"])

        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            rows = np.floor(scale * flat)
            if np.abs(rows).max(initial=0) > LARGEST:
                raise ValueError(f"a component of over {LARGEST / scale:.0f}: its squared distances don't fit a long")
            rows = rows.astype(np.int64)
            for i in range(0, len(rows), block):
                held.append((batch.column(0).slice(i, block), rows[i : i + block]))
                while sum(len(r) for _, r in held) >= block:
                    ids, rows_ = pa.concat_arrays([a for a, _ in held]), np.concatenate([r for _, r in held])
                    yield made(ids.slice(0, block), rows_[:block])
                    held[:] = [(ids.slice(block), rows_[block:])]
        if held and sum(len(r) for _, r in held):
            yield made(pa.concat_arrays([a for a, _ in held]), np.concatenate([r for _, r in held]))

    return written(kept(vectors, dimensions).mapInArrow(step, "ids array<long>, vectors binary, tree binary"))


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where((F.size("embedding") == dimensions) & whole)


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> np.ndarray:
    """The vectors of the k smallest hashes of seed and id; equal hashes by vector, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept(vectors, dimensions).select(key.alias("key"), "embedding").orderBy(F.col("key").asc_nulls_last(), "embedding").limit(k).collect()
    return np.floor(scale * np.array([r.embedding for r in rows], np.float64).reshape(-1, dimensions)).astype(np.int64)


def _each(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, vectors, cluster and squared distance of each block."""
    above = CoverTree.build(centroids, leaf=1)
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column(0).slice(i, 1).flatten()
            rows = np.frombuffer(batch.column(1)[i].as_buffer(), "<i4").reshape(len(ids), -1)
            tree = CoverTree.unpacked(batch.column(2)[i].as_py(), len(ids))
            yield ids, rows, *nearest(rows, tree, centroids, above)[:2]


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of each centroid's vectors; centroids without vectors stay."""
    k, dimensions = centroids.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for _, rows, cluster, _ in _each(batches, centroids):
            order = np.argsort(cluster, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(cluster[order]) != 0))
            names = cluster[order][first]
            count[names] += np.diff(np.append(first, len(cluster)))
            sums[names] += np.add.reduceat(rows[order].astype(np.int64), first, axis=0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    # A row per task and centroid; sums of any size are exact.
    parts = table.mapInArrow(step, "cluster int, n long, sums array<long>")
    exact = [F.sum(F.col("sums")[i].cast("decimal(38, 0)")).alias(f"s{i}") for i in range(dimensions)]
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():  # k rows
        out[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(dimensions)]
    return out


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of each vector."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in _each(batches, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return table.mapInArrow(step, "vec_id long, cluster int, distance long")


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each kept row, and the centroids (at most k, in the driver).

    Rows whose ``embedding`` is null, has another number of components, or a null or non-finite one, are left out. The rest
    become floors of ``scale`` times their components; one beyond 2**27 raises ValueError, as distances must fit a long (so must their sums). Equal
    distances go to the smaller number. Repeated rows count as often as they are there. A null vec_id stays null and starts a
    centroid only if there are too few others. Fewer rows than k start as many centroids. Other columns are left out. No rows give no rows.
    """
    table = blocks(vectors, dimensions=dimensions, scale=scale)
    centroids = first_centroids(vectors, k, seed, dimensions, scale)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = moved(table, centroids)
    return assigned(table, centroids), centroids


def centroid_clusters(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector; as ``clusters`` says."""
    found, centroids = clusters(vectors, **options)
    found = written(found)
    sums = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("d")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(i, d, sum(sums.values()), digest[i]) for i, d in sums.items()]
    names = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(read(spark, sf_dir, "embeddings"))


QUERIES = {"op12_centroid_clustering": op12_centroid_clustering}
