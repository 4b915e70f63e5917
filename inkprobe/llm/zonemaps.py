"""Centroid clustering over Hilbert-ordered blocks with zone maps.

Vectors of whole numbers are ordered along a Hilbert curve and cut into blocks of
``BLOCK_ROWS``, each stored with the smallest and largest value of every axis. In
each round the box of a block bounds its distances to every centroid from below
and above; centroids that can't be nearest to any of its rows drop out, and the
rows are compared with the others exactly, all at once. One partial sum for each
centroid and task goes through a shuffle; the driver holds the centroids alone.

Entries become floor(1024 * x), saturated at +-2**27, so that every distance is
an exact long. Equal vectors are split over range partitions by their row's number.

Defined results: vectors that are null, of another length or hold null or
non-finite entries go; rows equal in key or vector count and come back one by
one; a null key hashes as an empty one; of equal hashes the smaller vector starts
first; fewer vectors than centroids give as many centroids as vectors; sums beyond
a long are null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprobe.llm.vectors import hilbert_keys, matrix, usable, whole_numbers
from inkprobe.session import materialize

FACTOR, MOST = 1_024, 1 << 27
WIDTH, CENTROIDS, ROUNDS, SEED = 64, 8, 10, 3
CURVE_BITS = 4
BLOCK_ROWS = 1_024
FLOAT_EXACT = 1 << 53


def numbers(column: pa.Array, width: int) -> np.ndarray:
    return whole_numbers(matrix(column, width), FACTOR, MOST)


# --------------------------------------------------------------------- blocks

def _extent(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of every axis."""
    def run(batches):
        lo = hi = None
        for batch in batches:
            if batch.num_rows:
                x = numbers(batch.column(1), width)
                lo = x.min(axis=0) if lo is None else np.minimum(lo, x.min(axis=0))
                hi = x.max(axis=0) if hi is None else np.maximum(hi, x.max(axis=0))
        if lo is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width), pa.int32()), pa.array(lo), pa.array(hi)], names=["axis", "lo", "hi"])

    per = rows.mapInArrow(run, "axis int, lo bigint, hi bigint").groupBy("axis").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("axis").collect()  # one row an axis
    return np.array([r["lo"] for r in per], np.int64), np.array([r["hi"] for r in per], np.int64)


def blocks(rows: DataFrame, width: int, kind: str) -> DataFrame:
    """Stored blocks in curve order: keys, x (int32, row by row), lo and hi of the axes."""
    lo, hi = _extent(rows, width)
    if not len(lo):
        lo, hi = np.zeros(width, np.int64), np.zeros(width, np.int64)
    span = (hi - lo + 1).astype(np.float64)

    def place(batches):
        for batch in batches:
            x = numbers(batch.column(1), width)
            cells = np.clip((x - lo) / span * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(hilbert_keys(cells, CURVE_BITS), pa.binary()),
                 pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())],
                names=["key", "salt", "place", "x"])

    def cut(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= BLOCK_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                yield _block(table.slice(0, BLOCK_ROWS))
                held, n = table.slice(BLOCK_ROWS).to_batches(), n - BLOCK_ROWS
        if n:
            yield _block(pa.Table.from_batches(held))

    def _block(table: pa.Table) -> pa.RecordBatch:
        keys = table.column(0).combine_chunks()
        data = b"".join(table.column(1).to_pylist())
        x = np.frombuffer(data, "<i4").reshape(-1, width)
        return pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays([0, len(keys)], keys), pa.array([data], pa.binary()),
            pa.array([x.min(axis=0).tolist()], pa.list_(pa.int64())),
            pa.array([x.max(axis=0).tolist()], pa.list_(pa.int64()))], names=["keys", "x", "lo", "hi"])

    placed = rows.mapInArrow(place, f"key {kind}, salt bigint, place binary, x binary")
    in_order = placed.repartitionByRange("place", "salt").sortWithinPartitions("place", "salt").select("key", "x")
    return materialize(in_order.mapInArrow(
        cut, f"keys array<{kind}>, x binary, lo array<bigint>, hi array<bigint>"), "zone-blocks")


# ----------------------------------------------------------------- assignment

def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some point of the box, ties included."""
    outside = np.maximum(np.maximum(lo - centroids, centroids - hi), 0)
    reach = np.maximum(np.abs(centroids - lo), np.abs(hi - centroids))
    least, most = (outside * outside).sum(axis=1), (reach * reach).sum(axis=1)
    return np.flatnonzero(least <= most.min())


def nearest(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, exact squared distance) of each row of a block."""
    some = candidates(lo, hi, centroids)
    c = centroids[some]
    far = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * far * far * x.shape[1] < FLOAT_EXACT:  # every step of the products is a whole double
        y, d = x.astype(np.float64), c.astype(np.float64)
        dist = ((y * y).sum(axis=1)[:, None] - 2 * (y @ d.T) + (d * d).sum(axis=1)).astype(np.int64)
    else:
        x = x.astype(np.int64)
        dist = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
    best = dist.argmin(axis=1)
    return some[best], dist[np.arange(len(x)), best]


def _unpacked(batch: pa.RecordBatch, width: int):
    for i in range(batch.num_rows):
        x = np.frombuffer(batch.column("x")[i].as_py(), "<i4").reshape(-1, width)
        yield i, x, np.array(batch.column("lo")[i].as_py()), np.array(batch.column("hi")[i].as_py())


def _round(zones: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, width = centroids.shape

    def run(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for _, x, lo, hi in _unpacked(batch, width):
                to, _ = nearest(x, lo, hi, centroids)
                counts += np.bincount(to, minlength=k)
                for c in np.unique(to):
                    sums[c] += x[to == c].sum(axis=0, dtype=np.int64)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(some, width), pa.int32()), pa.array(np.tile(np.arange(width), len(some)), pa.int32()),
            pa.array(np.repeat(counts[some], width)), pa.array(sums[some].ravel())], names=["c", "axis", "n", "total"])

    parts = zones.select("x", "lo", "hi").mapInArrow(run, "c int, axis int, n bigint, total bigint")
    found = parts.groupBy("c", "axis").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    new = centroids.copy()
    for r in found:  # centroids x axes
        new[r["c"], r["axis"]] = int(r["total"]) // r["n"]
    return new


@dataclass(frozen=True)
class Clustering:
    zones: DataFrame
    centroids: np.ndarray
    kind: str


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = WIDTH,
        k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> Clustering:
    """Blocks of all usable vectors, and the centroids after ``rounds``."""
    named = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector"))
    kind = named.schema["key"].dataType.simpleString()
    rows = named.filter((F.size("vector") == width) & usable(F.col("vector"))).withColumn(
        "salt", F.xxhash64(F.monotonically_increasing_id()))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    starts = rows.select("vector", F.sha2(name.cast("binary"), 256).alias("h")).orderBy("h", "vector").limit(k)
    first = [np.array(r["vector"], np.float64) for r in starts.collect()]  # k rows
    centroids = whole_numbers(np.array(first).reshape(-1, width), FACTOR, MOST)
    zones = blocks(rows, width, kind)
    for _ in range(rounds if len(centroids) else 0):
        after = _round(zones, centroids)
        if (after == centroids).all():  # every later round would give the same
            break
        centroids = after
    return Clustering(zones, centroids, kind)


def assign(found: Clustering, key: str = "vec_id") -> DataFrame:
    """One row per vector: ``key``, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    centroids, zones = found.centroids, found.zones
    width = centroids.shape[1]

    def run(batches):
        for batch in batches:
            for i, x, lo, hi in _unpacked(batch, width):
                to, dist = nearest(x, lo, hi, centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("keys").slice(i, 1).flatten(), pa.array(to, pa.int32()), pa.array(dist, pa.int64())],
                    names=["key", "cluster", "distance"])

    rows = materialize(zones.mapInArrow(run, f"key {found.kind}, cluster int, distance bigint"), "assigned")
    inertia = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    per = {r["cluster"]: int(r["s"]) for r in inertia}  # one row a centroid
    held = lambda n: n if n < 1 << 63 else None
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = F.array(*[F.lit(held(per.get(c, 0))).cast("bigint") for c in range(len(centroids))])
    names = F.array(*[F.lit(h) for h in hashes])
    return rows.select(
        F.col("key").alias(key), "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"),
        F.lit(held(sum(per.values()))).cast("bigint").alias("inertia"),
        F.get(names, F.col("cluster")).alias("centroid_sha256"))
