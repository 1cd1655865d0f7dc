"""Centroid clustering of whole-number vectors with Elkan's bounds.

A vector's state is its cluster, an upper bound on the distance to its centroid and a lower bound on the distance to
each. A round moves the bounds by the centroids' shifts and works a distance out only where they, or half the distance
between two centroids, do not rule the centroid out. Bounds are rounded outward and prune only if strictly beaten, so a
centroid at an equal distance is always looked at and ties go to the smaller number. Distances themselves are exact
integers.

A round is one pass without a shuffle: each task reads its vectors and states, writes the new states, and at its end one
row for each cluster with the number and exact sums of its vectors. The driver holds the k centroids, nothing else.

Kept are vectors of exactly ``dims`` components, none null or not finite. A component x becomes floor(scale * x), whose
absolute value must be under 2^27 for a squared distance to fit a long; vectors beyond that take no part, as no answer could hold their distance.

Defined results: null or short vectors take no part; a null id is hashed as the empty text; vectors of equal ids or equal
vectors are all assigned; if fewer than k vectors are kept, each starts a cluster; equal centroids: the smaller number
takes all; an empty cluster's centroid stays; without vectors there are no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy

LIMIT = 1 << 27
ROWS = 8192
STATE = "vec_id long, v array<int>, cluster int, upper double, lower array<float>, distance long, n long, sums array<long>"
UP, DOWN = 1 + 2.0**-50, 1 - 2.0**-50


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _below(x: np.ndarray) -> np.ndarray:
    """32-bit floats that are not above ``x``."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _apart(centres: np.ndarray) -> np.ndarray:
    """Half the distance between centroids, rounded down; infinite from one to itself."""
    half = np.stack([np.sqrt(_squares(centres, c).astype(float)) for c in centres]) / 2 * DOWN
    np.fill_diagonal(half, np.inf)
    return half


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: np.ndarray, shift: np.ndarray, half: np.ndarray | None = None):
    """Nearest centroids of vectors ``x`` (ties: the smaller number), from the last round's state and the centroids' shifts.

    Returns cluster, upper, lower, the exact squared distance where it was worked out (else -1), and how many were.
    """
    half = _apart(centres) if half is None else half
    nearest = half.min(1)
    a = cluster.copy()
    upper = (upper + shift[a]) * UP
    lower = _below(np.maximum(lower - shift, 0) * DOWN)
    exact, worked = np.full(len(x), -1, np.int64), 0
    live = np.flatnonzero(~(upper < nearest[a]))

    def found(rows: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        root = np.sqrt(d.astype(float))
        lower[rows, c] = _below(root * DOWN)
        return root * UP

    exact[live] = _squares(x[live], centres[a[live]])
    upper[live] = found(live, a[live], exact[live])
    worked += len(live)
    live = live[~(upper[live] < nearest[a[live]])]
    for c in range(len(centres)):
        own = a[live]
        look = live[(own != c) & ~(upper[live] < lower[live, c]) & ~(upper[live] < half[own, c])]
        if len(look):
            d = _squares(x[look], centres[c])
            root = found(look, np.full(len(look), c), d)
            won = (d < exact[look]) | ((d == exact[look]) & (c < a[look]))
            a[look[won]], exact[look[won]], upper[look[won]] = c, d[won], root[won]
            worked += len(look)
    return a, upper, lower, exact, worked


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), kind))


def _round(centres: np.ndarray, shift: np.ndarray, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centres.shape
        half, names = _apart(centres), [f.split()[0] for f in STATE.split(", ")]
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                flat = lambda c, kind, width: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)  # noqa: B023, E731
                x, lower = flat(1, np.int64, dims), flat(4, np.float32, k)
                cluster, upper = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy()
                a, upper, lower, exact, _ = assign(x, cluster, upper, lower, centres, shift, half)
                if last:
                    left = np.flatnonzero(exact < 0)
                    exact[left] = _squares(x[left], centres[a[left]])
                order = np.argsort(a, kind="stable")
                has, begin = np.unique(a[order], return_index=True)
                sums[has] += np.add.reduceat(x[order], begin)
                counts += np.bincount(a, minlength=k)
                none = lambda kind: pa.nulls(batch.num_rows, kind)  # noqa: B023, E731
                kept = none(pa.list_(pa.int32())) if last else batch.column(1).cast(pa.list_(pa.int32()))
                bounds = (none(pa.float64()), none(pa.list_(pa.float32()))) if last else (pa.array(upper), _lists(lower, pa.float32()))
                yield pa.record_batch([batch.column(0), kept, pa.array(a.astype(np.int32)), *bounds, pa.array(exact) if last else none(pa.int64()), none(pa.int64()), none(pa.list_(pa.int64()))], names)
        c = np.flatnonzero(counts)
        none = lambda kind: pa.nulls(len(c), kind)
        yield pa.record_batch([none(pa.int64()), none(pa.list_(pa.int32())), pa.array(c.astype(np.int32)), none(pa.float64()), none(pa.list_(pa.float32())), none(pa.int64()), pa.array(counts[c]), _lists(sums[c], pa.int64())], names)

    return run


def _next(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Floors of the clusters' means; an empty cluster's centroid stays. k rows for each component come to the driver."""
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    added = rows.filter("n is not null").select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(whole("n").alias("n"), whole("x").alias("x"))
    out = centres.copy()
    for r in added.collect():
        out[r.cluster, r.i] = int(r.x) // int(r.n)
    return out


def cluster(vectors: DataFrame, embedding: Column, vec_id: Column, k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64, seed: str = "2", scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Centroids start as the k kept vectors of least sha256 of "seed:vec_id" (equal ids: by their components). Each round
    assigns every vector to its nearest centroid and moves every centroid to the floor of its vectors' mean; a last
    assignment follows. distance is the exact square; the inertias are its sums (null beyond a long).
    """
    scratch, spark = scratch or Scratch(vectors.sparkSession), vectors.sparkSession
    inside = lambda x: F.coalesce(F.abs(F.floor(x.cast("double") * scale).cast("double")) < LIMIT, F.lit(False))
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & inside(x))
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).try_cast("int"))
    kept = vectors.filter(F.coalesce((F.size(embedding) == dims) & finite, F.lit(False))).select(vec_id.cast("long").alias("vec_id"), whole.alias("v"))
    rows = scratch.cut(kept)
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centres = np.array([r.v for r in rows.orderBy(draw, "v").limit(k).collect()], np.int64)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centres):
        return spark.createDataFrame([], out)
    shift, state = np.zeros(len(centres)), None
    for turn in range(rounds + 1):
        last = turn == rounds
        if state is None:
            given = rows.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.array_repeat(F.lit(0.0).cast("float"), len(centres)).alias("lower"))
        else:
            given = state.filter("n is null").select("vec_id", "v", "cluster", "upper", "lower")
        new = scratch.cut(given.mapInArrow(tidy(_round(centres, shift, last)), STATE))
        scratch.drop(rows if state is None else state)
        state = new
        if not last:
            moved = _next(state, centres)
            centres, shift = moved, np.sqrt(_squares(moved, centres).astype(float)) * UP
    assigned = state.filter("n is null").select("vec_id", "cluster", "distance")
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    about = spark.createDataFrame([(c, fits(s), fits(sum(sums.values())), digest(centres[c])) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(*(f.split()[0] for f in out.split(", ")))  # k rows at most
