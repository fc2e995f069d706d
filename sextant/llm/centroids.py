"""Centroid clustering with Elkan's bounds, in integers.

Components become integers, so distances and means are exact whatever the
order of the rows, and a lost task computes the same again.  Every vector
keeps an upper bound of the distance to its centroid and a lower bound of the
distance to each.  After the centroids have moved, the bounds move by as much;
a centroid is skipped if a vector's upper bound is below its lower bound, or
below half the distance between the two centroids.  Upper bounds are rounded
up, lower ones down, and both tests are strict, so a centroid at the very same
distance is always measured and ties go to the smaller number.

A round is one pass over the vectors and their bounds, written to the shared
folder, and one aggregation to as many rows as there are centroids.  The
centroids, their distances and their moves are all that is sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_batches
from .staging import load, new_folder, remove, stage

#: Integers saturate here, so that a squared distance fits in a long.
MOST = 1 << 27
#: Up to this magnitude products and sums of 64 components are exact in doubles.
EXACT = 1 << 22
#: Bits of a lower bound's mantissa that are dropped, which rounds it down and makes it short to store.
DROPPED = np.uint32(0xFFFFFFFF << 12 & 0xFFFFFFFF)


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    low = np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))
    return (low.view(np.uint32) & DROPPED).view(np.float32)


class Space:
    """Exact squared distances between the integer vectors of a batch and centroids."""

    def __init__(self, vectors: np.ndarray, centroids: np.ndarray):
        self.plain = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0))) > EXACT
        kind = np.int64 if self.plain else np.float64
        self.vectors, self.centroids = vectors.astype(kind), centroids.astype(kind)
        self.own, self.other = (self.vectors**2).sum(1), (self.centroids**2).sum(1)

    def to(self, rows: np.ndarray, j: int) -> np.ndarray:
        """From those rows to centroid j."""
        if self.plain:
            return ((self.vectors[rows] - self.centroids[j]) ** 2).sum(1)
        return (self.own[rows] + self.other[j] - 2 * (self.vectors[rows] @ self.centroids[j])).astype(np.int64)

    def each(self, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        """From each of the rows to the centroid of its number."""
        return ((self.vectors[rows] - self.centroids[to]) ** 2).sum(1).astype(np.int64)


@dataclass
class Centroids:
    """Where the centroids are, how far each has moved (rounded up) and half their distances (rounded down)."""

    at: np.ndarray
    moved: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, at: np.ndarray, before: np.ndarray | None = None) -> Centroids:
        far = lambda a, b: np.sqrt(((a.astype(np.float64) - b.astype(np.float64)) ** 2).sum(-1))
        half = down(np.array([far(at, c) for c in at]) / 2)
        np.fill_diagonal(half, np.inf)
        return cls(at, up(far(at, before)) if before is not None else np.zeros(len(at), np.float32), half)


def assign(vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, now: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower, distances measured) of a batch after the centroids have moved."""
    cluster = cluster.copy()
    upper = up(upper.astype(np.float64) + now.moved[cluster])
    lower = down(lower.astype(np.float64) - now.moved)
    measured = np.zeros(len(vectors), np.int32)
    nearest_other = now.half.min(1)
    active = np.flatnonzero(~(upper < nearest_other[cluster]))
    if not len(active):
        return cluster, upper, lower, measured
    space = Space(vectors, now.at)

    def open_to(rows: np.ndarray, j: int) -> np.ndarray:
        return ~(upper[rows] < lower[rows, j]) & ~(upper[rows] < now.half[cluster[rows], j]) & (cluster[rows] != j)

    wanted = np.zeros(len(active), bool)
    for j in range(len(now.at)):
        wanted |= open_to(active, j)
    active = active[wanted]
    best = np.zeros(len(vectors), np.int64)
    best[active] = space.each(active, cluster[active])
    root = np.sqrt(best[active].astype(np.float64))
    upper[active], lower[active, cluster[active]] = up(root), down(root)
    measured[active] = 1
    for j in range(len(now.at)):
        rows = active[open_to(active, j)]
        if not len(rows):
            continue
        squared = space.to(rows, j)
        root = np.sqrt(squared.astype(np.float64))
        lower[rows, j] = down(root)
        measured[rows] += 1
        nearer = (squared < best[rows]) | ((squared == best[rows]) & (j < cluster[rows]))
        to = rows[nearer]
        cluster[to], best[to], upper[to] = j, squared[nearer], up(root[nearer])
    return cluster, upper, lower, measured


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel()))


def _round(state: DataFrame, now: Centroids, dims: int) -> DataFrame:
    """``state`` (vec_id, v, cluster, upper, lower, measured) after its vectors were assigned anew."""
    shared = state.sparkSession.sparkContext.broadcast(now)  # k centroids
    k = len(now.at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v, cluster, upper, lower, _ = batch.columns
            found = assign(_matrix(v, dims, np.int64), cluster.to_numpy(), upper.to_numpy(), _matrix(lower, k, np.float32), shared.value)
            yield pa.RecordBatch.from_arrays([ids, v, pa.array(found[0]), pa.array(found[1]), _lists(found[2]), pa.array(found[3])], names=batch.schema.names)

    return map_batches(state, run, state.schema)


def integers(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """``vec_id, v``: the vectors of ``dims`` finite components as integers floor(scale * x)."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))

    def whole(c: Column) -> Column:
        return F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int")

    return vectors.where((F.size(x) == dims) & finite).select(F.col(id_col).alias("vec_id"), F.transform(x, whole).alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, in that order; a null vec_id comes last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in kept.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()], np.int64)


def moved(state: DataFrame, at: np.ndarray, dims: int) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean; one without vectors stays."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("v")[i].cast("long")) for i in range(dims)]).alias("sums"))
    new = at.copy()
    for r in sums.collect():  # k rows
        new[r.cluster] = [s // r.n for s in r.sums]
    return new


def elkan(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: int = 256,
    seed: int = 2,
) -> tuple[DataFrame, np.ndarray]:
    """(``vec_id, v, cluster, upper, lower, measured`` of every kept vector, centroids) after ``rounds`` rounds and a last assignment.

    Kept are vectors with exactly ``dims`` components, none of them null or
    not finite; integers beyond ±2**27 saturate.  Repeated rows are vectors of
    their own, a null vec_id too.  With fewer than k vectors each starts a
    centroid; without any the result is empty and there are no centroids.
    Other columns are ignored.  ``measured``: distances computed in the last
    assignment.
    """
    spark = vectors.sparkSession
    kept = stage(integers(vectors, id_col, vec_col, dims, scale), "integers")
    at = first_centroids(kept, k, seed)
    lower = F.array_repeat(F.lit(0.0).cast("float"), len(at))
    state = kept.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(float("inf")).cast("float").alias("upper"), lower.alias("lower"), F.lit(0).alias("measured"))
    if not len(at):
        return state, at
    now, path = Centroids.of(at), None
    for r in range(rounds + 1):
        new_path = new_folder(spark, "bounds")
        _round(state, now, dims).write.option("compression", "zstd").parquet(new_path)
        state = spark.read.schema(state.schema).parquet(new_path)
        if path:
            remove(spark, path)  # the round before has been read for the last time
        path = new_path
        if r < rounds:
            after = moved(state, now.at, dims)
            now = Centroids.of(after, now.at)
    return state, now.at


def clusters(vectors: DataFrame, **options) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that elkan() keeps."""
    spark = vectors.sparkSession
    state, at = elkan(vectors, **options)
    named = spark.createDataFrame([(j, [int(x) for x in c], sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()) for j, c in enumerate(at)], "cluster int, centroid array<long>, centroid_sha256 string")
    difference = F.zip_with(F.col("v"), F.col("centroid"), lambda a, b: (a - b) * (a - b))
    squared = F.aggregate(difference, F.lit(0).cast("long"), lambda total, d: total + d)
    found = state.select("vec_id", "cluster", "v").join(F.broadcast(named), "cluster").select("vec_id", "cluster", squared.alias("distance"), "centroid_sha256")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    inertia = sum(r.cluster_inertia for r in sums)
    sums = spark.createDataFrame([(r.cluster, r.cluster_inertia, inertia) for r in sums], "cluster int, cluster_inertia long, inertia long")
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(load(spark, sf_dir, "embeddings"))


def _sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Every assignment by all distances; the means in one step of SQL each."""
    steps = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"""c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INT) AS cluster, v AS c
            FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k}))""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
            SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, cluster := cluster)) AS near
            FROM (SELECT r, vec_id, v, cluster, CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v, c)]) AS BIGINT) AS d FROM kept, c{r}) GROUP BY r)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (
            SELECT cluster, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
                SELECT cluster, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS m
                FROM (SELECT near.cluster AS cluster, i, sum(v[i])::DOUBLE AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY ALL) GROUP BY cluster) USING (cluster))"""
            )
    return (
        "WITH " + ",\n".join(steps) + f"""
        SELECT vec_id, near.cluster AS cluster, near.d AS distance,
               CAST(sum(near.d) OVER (PARTITION BY near.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(near.d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON c{rounds}.cluster = near.cluster"""
    )


QUERIES = {"op13_centroid_clustering": op13_centroid_clustering}
ORACLE = {"op13_centroid_clustering": _sql()}
