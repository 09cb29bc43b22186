"""Exact k-means on integer vectors with clusters as balls.

A ball is a centroid and the largest distance of a member to it.  A centroid can
only take over a member of a ball if the two centroids are at most two radii
apart: these are the ball's neighbours.  Sorted by distance they split the ball
into a stable core (nearer to its centroid than half the way to the nearest
neighbour; it stays without any comparison) and annuli (a member between half the
ways to the m-th and the next neighbour is compared with m of them, exactly).
All figures are integers, so results do not depend on the order of rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

#: Components reach this far at most, so that squared distances of 4,096 components fit 64 bits.
LARGEST = 1 << 24


@dataclass
class Balls:
    """Centroids, and of each ball its members, the square of its radius and the sum of squared distances."""

    centroids: np.ndarray
    members: list[int]
    radius: list[int]
    inertia: list[int]

    def digest(self, i: int) -> str:
        return hashlib.sha256(",".join(map(str, self.centroids[i].tolist())).encode()).hexdigest()


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def _root_up(x: int) -> int:
    r = isqrt(x)
    return r + (r * r < x)


def neighbours(centroids: np.ndarray, radius: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each ball (radii, not squared): the centroids at most two radii away, nearest first, and the squares of their distances."""
    out = []
    for i, r in enumerate(radius):
        others = np.delete(np.arange(len(centroids)), i)
        far = _square(centroids[others], centroids[i])
        order = np.lexsort((others, far))
        near = order[[int(x) <= 4 * r * r for x in far[order]]] if len(order) else order
        out.append((others[near], far[near]))
    return out


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of all centroids (ties: the smaller number) and the squared distance."""
    best, cluster = _square(points, centroids[0]), np.zeros(len(points), np.int64)
    for c in range(1, len(centroids)):
        d = _square(points, centroids[c])
        less = d < best
        best[less], cluster[less] = d[less], c
    return cluster, best


def reassign(points: np.ndarray, cluster: np.ndarray, centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, int]:
    """The same result as ``nearest`` from a former assignment; and how many distances to other centroids were taken."""
    best, out, compared = _square(points, centroids[cluster]), cluster.copy(), 0
    own = best.copy()
    for c in np.unique(cluster).tolist():
        others, far = near[c]
        rows = np.flatnonzero(cluster == c)
        annulus = np.searchsorted(far, 4 * own[rows], side="right")  # 0: the stable core
        for m, other in enumerate(others.tolist()):
            some = rows[annulus > m]
            if not len(some):
                break
            compared += len(some)
            d = _square(points[some], centroids[other])
            less = (d < best[some]) | ((d == best[some]) & (other < out[some]))
            best[some[less]], out[some[less]] = d[less], other
    return out, best, compared


_SCHEMA = "id {0}, point binary, cluster int, distance long, members long, radius long, inertia long, sums array<long>"
_NAMES = ["id", "point", "cluster", "distance", "members", "radius", "inertia", "sums"]


def _pass(rows: DataFrame, centroids: np.ndarray, near: list | None) -> DataFrame:
    """Every vector with its cluster and distance and, from each task, one row for each of its clusters with its sums."""
    kind, k, width = dict(rows.dtypes)["id"], len(centroids), centroids.shape[1]

    def run(batches):
        members, radius, inertia, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            points = np.frombuffer(b"".join(batch.column("point").to_pylist()), "<i4").reshape(n, width).astype(np.int64)
            if near is None:
                cluster, distance = nearest(points, centroids)
            else:
                cluster, distance, _ = reassign(points, batch.column("cluster").to_numpy().astype(np.int64), centroids, near)
            members += np.bincount(cluster, minlength=k)
            np.maximum.at(radius, cluster, distance)
            np.add.at(inertia, cluster, distance)
            for c in np.unique(cluster).tolist():
                sums[c] += points[cluster == c].sum(axis=0)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("point"), pa.array(cluster.astype(np.int32)), pa.array(distance), none, none, none, pa.nulls(n, pa.list_(pa.int64()))], names=_NAMES)
        some = np.flatnonzero(members)
        if len(some):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * width), pa.array(sums[some].ravel()))
            plain = [pa.array(x[some]) for x in (members, radius, inertia)]
            id_type = batch.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), id_type), pa.nulls(len(some), pa.binary()), pa.array(some.astype(np.int32)), pa.nulls(len(some), pa.int64()), *plain, lists], names=_NAMES)

    return rows.mapInArrow(run, _SCHEMA.format(kind))


def _balls(state: DataFrame, centroids: np.ndarray) -> tuple[Balls, np.ndarray]:
    """What the tasks' sums come to (k rows of components reach the driver), and the floors of the means."""
    parts = state.filter("members is not null")
    k = len(centroids)
    members, radius, inertia = [0] * k, [0] * k, [0] * k
    for r in parts.groupBy("cluster").agg(F.sum("members").alias("n"), F.max("radius").alias("r"), F.sum(F.col("inertia").cast("decimal(38,0)")).alias("s")).collect():
        members[r["cluster"]], radius[r["cluster"]], inertia[r["cluster"]] = r["n"], r["r"], int(r["s"])
    means = centroids.copy()
    for r in parts.select("cluster", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        means[r["cluster"], r["i"]] = int(r["x"]) // members[r["cluster"]]
    return Balls(centroids, members, radius, inertia), means


def whole_vectors(vectors: DataFrame, id_column: str, column: str, width: int, scale: float) -> DataFrame:
    """(id, point) of the vectors with exactly ``width`` components, none null or not finite: floor(scale * x) of each."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    ints = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    return vectors.filter(F.when(F.size(x) == width, finite).otherwise(F.lit(False))).select(F.col(id_column).alias("id"), ints.alias("point"))


def _packed(rows: DataFrame, width: int) -> DataFrame:
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("point").flatten().to_numpy()
            if np.abs(flat).max(initial=0) > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} after scaling: distances would not fit 64 bits")
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * (4 * width)
            raw = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype("<i4"))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), raw], names=["id", "point"])

    return rows.mapInArrow(run, f"id {kind}, point binary")


def ball_kmeans(spark: SparkSession, vectors: DataFrame, id_column: str, column: str, width: int, k: int = 16, rounds: int = 3, scale: float = 64.0, seed: int = 1, space: Workspace | None = None) -> tuple[DataFrame, Balls]:
    """(id, cluster, distance) of every whole vector, and the balls.

    Vectors with another number of components, or any null or non-finite one, are
    left out.  The first centroids are the ``k`` vectors with the smallest sha256 of
    ``seed:id`` (null ids last; ties by components), or all if there are fewer.  Each of
    ``rounds`` rounds assigns every vector to its nearest centroid (ties: the smaller
    number) and moves the centroids with members to the floors of their means; then
    vectors are assigned once more.  ``distance`` is the square of the Euclidean one.
    Rows with equal ids or equal vectors stand for themselves.  No vectors give no
    rows.  Components beyond LARGEST after scaling are an error.  Centroids, k times
    ``width`` numbers, are held by the driver and by each task.
    """
    space = space or Workspace(spark, "balls")
    rows = whole_vectors(vectors, id_column, column, width, scale)
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256).asc_nulls_last(), "point").limit(k).collect()
    if not first:
        empty = rows.filter("false").select(F.col("id").alias(id_column), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return empty, Balls(np.zeros((0, width), np.int64), [], [], [])
    centroids = np.array([r["point"] for r in first], np.int64)
    state = space.table(_pass(_packed(rows, width), centroids, None), "round-0")
    for i in range(rounds):
        balls, moved = _balls(state, centroids)
        # the old ball, and how far its centre went, bound the new one
        radius = [_root_up(r) + _root_up(int(d)) for r, d in zip(balls.radius, _square(moved, centroids), strict=True)]
        centroids, former = moved, state
        state = space.table(_pass(former.filter("members is null").select("id", "point", "cluster"), centroids, neighbours(centroids, radius)), f"round-{i + 1}")
        space.drop(former)
    balls, _ = _balls(state, centroids)
    return state.filter("members is null").select(F.col("id").alias(id_column), "cluster", "distance"), balls
