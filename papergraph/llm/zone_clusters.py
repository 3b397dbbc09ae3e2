"""Centroid clustering (Lloyd's rounds) over space-filling-curve zone maps.

Vectors, as integers on a lattice, are put into the order of a Hilbert curve and cut into
blocks with the least and the greatest value of each component: a box. In every round the
bounds of a box on the distances tell which centroids any of its vectors can have nearest;
only those are compared with the block's vectors, all at once and exactly. The blocks are
made once; the curve decides how well boxes prune, never the result.

The curve runs over the ``curve_dims`` components of the largest variance, in
``64 / curve_dims`` bits between their least and greatest values.

Defined cases: vectors of another length, and those with a null or non-finite component, are
left out; lattice values are held to +-LIMIT (components of over 65,535 in size at a scale of
1024), so that squared distances fit a long; fewer vectors than ``k`` give fewer centroids;
ties go to the smaller number; an empty cluster keeps its centroid; repeated rows are vectors
like others, and of equal ids the smaller vector starts first; a null id hashes as the empty
text; an empty table gives an empty result; columns that are not named are not read, so
clashing names do not matter; texts do not occur. A sum of distances over 2**63 - 1 is given
as that.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table

LIMIT = 2**26 - 1
#: Below this the products of two lattice vectors are exact in doubles.
EXACT = 2**22
MOST = 2**63 - 1


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (below ``2**bits``); signed,
    in order, so that 64 bits sort as longs. By Skilling's exchange and inversion of bits."""
    x = cells.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for bit in reversed(range(1, bits)):
        q = one << np.uint64(bit)
        low = q - one
        for i in range(len(x)):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for bit in reversed(range(1, bits)):
        q = one << np.uint64(bit)
        turn ^= np.where((x[-1] & q) != 0, q - one, np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for bit in reversed(range(bits)):
        for row in x:
            key = (key << one) | ((row >> np.uint64(bit)) & one)
    return (key ^ np.uint64(1 << 63)).view(np.int64)


def lattice(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    """Rows of ``floor(scale * x)``, held to LIMIT, of a list column."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.clip(np.floor(values * scale), -LIMIT, LIMIT).astype(np.int64)


@dataclass
class Curve:
    """Which components the curve runs over, and their ranges."""

    dims: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    bits: int

    def keys(self, points: np.ndarray) -> np.ndarray:
        part = (points[:, self.dims] - self.lo) / np.maximum(self.hi - self.lo, 1)
        return hilbert_keys(np.clip((part * (1 << self.bits)).astype(np.int64), 0, (1 << self.bits) - 1), self.bits)


def usable(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector: those with ``dims`` components, all finite."""
    v = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.where(v.isNotNull() & (F.size(v) == dims) & ~F.exists(v, bad)).select(F.col(id_col).alias("vec_id"), v.alias("vector"))


def fit_curve(kept: DataFrame, dims: int, scale: float, curve_dims: int) -> Curve | None:
    """Ranges and variances over all vectors; a task gives one row a component."""

    def run(batches):
        n, lo, hi = 0, np.full(dims, MOST), np.full(dims, -MOST)
        total, square = np.zeros(dims), np.zeros(dims)
        for batch in batches:
            if batch.num_rows:
                x = lattice(batch.column(0), dims, scale)
                n, lo, hi = n + len(x), np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0))
                total, square = total + x.sum(0), square + (x.astype(np.float64) ** 2).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, n)), *map(pa.array, (lo, hi, total, square))], ["dim", "n", "lo", "hi", "total", "square"])

    parts = kept.select("vector").mapInArrow(run, "dim long, n long, lo long, hi long, total double, square double")
    found = sorted(parts.groupBy("dim").agg(F.sum("n"), F.min("lo"), F.max("hi"), F.sum("total"), F.sum("square")).collect())
    if not found:
        return None
    _, n, lo, hi, total, square = map(np.array, zip(*found, strict=True))
    widest = np.argsort(-(square / n - (total / n) ** 2), kind="stable")[: min(curve_dims, dims)]
    return Curve(widest, lo[widest], hi[widest], 64 // len(widest))


def zone_blocks(kept: DataFrame, curve: Curve, dims: int, scale: float, block: int) -> DataFrame:
    """ids, points, lo, hi: ``block`` vectors a row in the order of the curve, and their box.

    The range shuffle is by the key and a hash of the id, so that a very common vector is
    dealt over many tasks. Points and boxes are little-endian 32-bit integers.
    """
    kind = dict(kept.dtypes)["vec_id"]

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                x = lattice(batch.column(1), dims, scale)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(curve.keys(x)), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())], ["vec_id", "key", "point"])

    def cut(batches):
        ids, points = [], np.zeros((0, dims), "<i4")

        def some(n):
            nonlocal ids, points
            while len(ids) >= n > 0:
                box = points[:block]
                yield pa.RecordBatch.from_arrays([pa.array([ids[:block]], pa.list_(id_type)), *(pa.array([a.astype("<i4").tobytes()], pa.binary()) for a in (box, box.min(0), box.max(0)))], ["ids", "points", "lo", "hi"])
                ids, points = ids[block:], points[block:]

        id_type = None
        for batch in batches:
            if batch.num_rows:
                id_type = batch.column(0).type
                ids += batch.column(0).to_pylist()
                points = np.concatenate([points, np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(-1, dims)])
                yield from some(block)
        yield from some(1)

    rows = kept.mapInArrow(keyed, f"vec_id {kind}, key long, point binary")
    salt = F.xxhash64("vec_id")
    dealt = rows.repartitionByRange("key", salt).sortWithinPartitions("key", salt).select("vec_id", "point")
    return dealt.mapInArrow(cut, f"ids array<{kind}>, points binary, lo binary, hi binary")


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that a vector in the box can have nearest.

    First those whose least distance to the box is at most the smallest of the greatest
    distances; of these, those that no other beats all over the box: the difference of two
    distances is linear in the vector, so its least value over the box is at a corner.
    """
    near = (np.maximum(np.maximum(lo - centroids, centroids - hi), 0) ** 2).sum(1)
    far = (np.maximum(np.abs(centroids - lo), np.abs(hi - centroids)) ** 2).sum(1)
    left = np.flatnonzero(near <= far.min())
    if len(left) > 1:
        c = centroids[left]
        size = (c**2).sum(1)
        keep = np.ones(len(left), bool)
        for a in range(len(left)):
            slope = -2 * (c[a] - c)
            least = size[a] - size + np.where(slope > 0, slope * lo, slope * hi).sum(1)
            keep[a] = not (least > 0).any()
        left = left[keep]
    return left


def nearest(points: np.ndarray, lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the nearest centroid (ties: the smaller number) and the squared distance."""
    some = candidates(lo, hi, centroids)
    c = centroids[some]
    exact = max(np.abs(lo).max(), np.abs(hi).max(), np.abs(c).max()) < EXACT
    x, y = (a.astype(np.float64) if exact else a for a in (points, c))
    cross = (x @ y.T).astype(np.int64)
    apart = (points**2).sum(1)[:, None] - 2 * cross + (c**2).sum(1)[None, :]
    best = apart.argmin(1)
    return some[best], apart[np.arange(len(points)), best]


def _assigned(batches, dims: int, centroids: np.ndarray):
    """(ids, points, cluster, distance) of each block."""
    for batch in batches:
        for ids, *parts in zip(*(batch.column(k) for k in range(4)), strict=True):
            points, lo, hi = (np.frombuffer(p.as_buffer(), "<i4").astype(np.int64) for p in parts)
            points = points.reshape(-1, dims)
            yield ids, points, *nearest(points, lo, hi, centroids)


def _sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, np.ndarray]]:
    """For each cluster its count, its distances' sum and its vectors' sum, exactly.

    A task gives one row a cluster and component; the driver gets as many.
    """
    k, dims = centroids.shape

    def run(batches):
        n, inertia, total = np.zeros(k, np.int64), [0] * k, np.zeros((k, dims), np.int64)
        for _, points, cluster, distance in _assigned(batches, dims, centroids):
            for c in np.unique(cluster):
                mine = cluster == c
                n[c] += mine.sum()
                inertia[c] += int(distance[mine].sum())
                total[c] += points[mine].sum(0)
        for c in np.flatnonzero(n):
            # place 0 has the count, 1 and 2 the inertia's high and low parts, the rest the sums
            values = [int(n[c]), inertia[c] >> 31, inertia[c] & (2**31 - 1), *total[c].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(c)] * len(values)), pa.array(range(len(values)), pa.int64()), pa.array(values, pa.int64())], ["cluster", "place", "value"])

    rows = blocks.mapInArrow(run, "cluster long, place long, value long").groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    found: dict[int, dict[int, int]] = {}
    for c, place, value in rows.collect():
        found.setdefault(c, {})[place] = int(value)
    return {c: (v[0], (v[1] << 31) + v[2], np.array([v[j + 3] for j in range(dims)], object)) for c, v in found.items()}


def first_centroids(kept: DataFrame, k: int, dims: int, scale: float, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(k).collect()
    return lattice(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), dims, scale) if rows else np.zeros((0, dims), np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: int = 3, block: int = 256, curve_dims: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector kept: vec_id, cluster, distance (squared, on the lattice),
    cluster_inertia, inertia, centroid_sha256.

    The ``k`` centroids and their sums (``k * dims`` numbers) go through the driver, nothing
    else does. A round that changes no centroid ends the rounds, since all later ones would
    change none either.
    """
    kept = usable(vectors, dims, id_col, vector_col)
    kind = dict(kept.dtypes)["vec_id"]
    shape = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    curve = fit_curve(kept, dims, scale, curve_dims)
    if curve is None:
        return vectors.sparkSession.createDataFrame([], shape)
    centroids = first_centroids(kept, k, dims, scale, seed)
    blocks = stored(zone_blocks(kept, curve, dims, scale, block), "zones")
    for _ in range(rounds):
        now = centroids.copy()
        for c, (n, _, total) in _sums(blocks, centroids).items():
            now[c] = [int(t) // n for t in total]
        if (now == centroids).all():
            break
        centroids = now
    sums = _sums(blocks, centroids)
    inertia = [min(MOST, sums[c][1]) if c in sums else 0 for c in range(len(centroids))]
    whole = min(MOST, sum(s[1] for s in sums.values()))
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def run(batches):
        for ids, points, number, distance in _assigned(batches, dims, centroids):
            yield pa.RecordBatch.from_arrays(
                [ids.values, pa.array(number, pa.int32()), pa.array(distance), pa.array(np.array(inertia)[number]), pa.array(np.full(len(points), whole)), pa.array(digest).take(pa.array(number))],
                ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return blocks.mapInArrow(run, shape)


def op12_zone_map_clusters(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))
