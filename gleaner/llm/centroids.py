"""Centroid clustering of integer vectors with Hamerly's bounds.

Components become integers, so distances and means are exact. Each vector keeps two bounds from round
to round: an upper one on the distance to its own centroid and a lower one on the distance to the
second nearest. When centroids move, the upper bound grows by the drift of the vector's own centroid,
and the lower one shrinks by the largest drift of the others. A vector whose upper bound is below the
lower one, or below half the distance from its centroid to the nearest other, keeps its centroid; if
the upper bound made exact does not settle it, the vector is ambiguous, and its exact distances to all
centroids are computed. Bounds are floating point numbers, rounded outwards, and never settle a tie.

Vectors and bounds are a table that each round rewrites in place of the one before. A round is a pass
over it without a shuffle, and sums by centroid and component, combined in each task, of which 64 x 16
a task move. Only centroids are on the driver.

Defined cases: a vector that is null, has another number of components, or a component that is null or
not finite is left out; components beyond +-2^26 after scaling count as that, so that distances fit;
repeated vectors and ids stay as rows of their own; a null id counts as the empty text where starting
vectors are drawn, and rows with the same id are drawn in the order of their components; with fewer
vectors than centroids each vector starts one; equal starting vectors give centroids of which the
later ones stay empty; ties go to the smaller number; an empty table gives no rows; other columns,
whatever their names, do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import keep, quoted

#: Integer components are held to this, so that a distance of 64 of them fits in a long.
LARGEST = 1 << 26
#: Up to this, sums of 64 products are exact in a float.
EXACT = 1 << 21
#: What a bound is widened by, relative to its size and to the largest distance: more than its rounding errors.
SLACK = 1e-9
STATE = "id {id}, vector array<int>, cluster int, upper double, lower double, scans int"


def integer_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", dims: int = 64, scale: int = 64) -> DataFrame:
    """(id, vector): floor(scale * x) of the vectors that have ``dims`` finite components."""
    whole = F.transform(quoted(vector_column), lambda x: x.cast("double"))
    finite = F.forall("real", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(quoted(id_column).alias("id"), whole.alias("real")).filter((F.size("real") == dims) & finite)
    # The limit comes before the integer, as a larger one does not fit.
    limited = F.transform("real", lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    return kept.select("id", limited.alias("vector"))


def start(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest digests of seed and id, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(k).collect()
    return np.array([r["vector"] for r in first], np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows of ``x`` by centroids."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return np.rint((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def own_distances(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x - centroids[cluster]) ** 2).sum(1)


def reassign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper and lower bound after the centroids moved, and which vectors were scanned."""
    drift = np.sqrt(((centroids - before) ** 2).sum(1).astype(float)) * (1 + SLACK)
    most = int(drift.argmax())
    others = np.full(len(drift), drift[most])
    others[most] = np.delete(drift, most).max(initial=0.0)
    between = np.sqrt(distances(centroids, centroids).astype(float))
    np.fill_diagonal(between, np.inf)
    half = between.min(1) / 2 * (1 - SLACK)
    upper, lower, cluster = upper + drift[cluster], lower - others[cluster], cluster.copy()
    limit = np.maximum(lower, half[cluster])
    unsure = np.flatnonzero(~(upper < limit))
    upper[unsure] = np.sqrt(own_distances(x[unsure], centroids, cluster[unsure]).astype(float)) * (1 + SLACK)
    unsure = unsure[~(upper[unsure] < limit[unsure])]
    cluster[unsure], upper[unsure], lower[unsure] = scan(x[unsure], centroids)
    scanned = np.zeros(len(x), bool)
    scanned[unsure] = True
    return cluster, upper, lower, scanned


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and both bounds, from exact distances to all."""
    d = distances(x, centroids)
    nearest = d.argmin(1)
    at = np.arange(len(x))
    upper = np.sqrt(d[at, nearest].astype(float)) * (1 + SLACK)
    rest = d.astype(float)
    rest[at, nearest] = np.inf
    return nearest, upper, np.sqrt(rest.min(1, initial=np.inf)) * (1 - SLACK)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def assign(state: DataFrame, before: np.ndarray | None, centroids: np.ndarray) -> DataFrame:
    """The state after centroids moved from ``before``; without it, every vector is scanned."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), dims)
            if before is None:
                cluster, upper, lower = scan(x, centroids)
                scans = np.ones(len(x), np.int32)
            else:
                held = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower", "scans")]
                cluster, upper, lower, scanned = reassign(x, *(v.copy() for v in held[:3]), before, centroids)
                scans = held[3] + scanned.astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(scans, pa.int32())], ["id", "vector", "cluster", "upper", "lower", "scans"])

    return state.mapInArrow(run, STATE.format(id=state.schema["id"].dataType.simpleString()))


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the exact means; a centroid without vectors stays."""
    dims, k = centroids.shape[1], len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            np.add.at(sums, cluster, _matrix(batch.column("vector"), dims))
            counts += np.bincount(cluster, minlength=k)
        place = np.arange(k * dims)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(sums.ravel()), pa.array(np.repeat(counts, dims))], ["place", "total", "rows"])

    parts = state.select("vector", "cluster").mapInArrow(run, "place long, total long, rows long")
    total = parts.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("rows").alias("rows")).collect()
    found = centroids.copy()
    for row in total:
        if row["rows"]:
            found[divmod(row["place"], dims)] = int(row["total"]) // row["rows"]
    return found


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """The vectors (id, vector, cluster, upper, lower, scans, distance) and the final centroids."""
    state = keep(integer_vectors(vectors, id_column, vector_column, dims, scale))
    centroids = start(state, k, seed)
    if not len(centroids):
        return state.select("id", "vector", *[F.lit(0).cast(t).alias(c) for c, t in (("cluster", "int"), ("upper", "double"), ("lower", "double"), ("scans", "int"), ("distance", "long"))]), centroids
    before = None
    for _ in range(rounds):
        state = keep(assign(state, before, centroids))
        before, centroids = centroids, moved(state, centroids)
    state = keep(assign(state, before, centroids))
    table = F.array(*[F.array(*[F.lit(int(v)) for v in c]) for c in centroids])
    apart = F.zip_with("vector", F.element_at(table, F.col("cluster") + 1), lambda a, b: (a.cast("long") - b) * (a.cast("long") - b))
    return state.withColumn("distance", F.aggregate(apart, F.lit(0).cast("long"), lambda acc, v: acc + v)), centroids


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def summary(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, sums of distances by cluster and over all, and the digest of the centroid: k sums on the driver."""
    sums = dict(assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    most = (1 << 63) - 1
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1) if len(centroids) else F.lit(None).cast(kind)
    inertia = [min(int(sums.get(c, 0)), most) for c in range(len(centroids))]
    return assigned.select(F.col("id").alias("vec_id"), "cluster", "distance", of(inertia, "long").alias("cluster_inertia"), F.lit(min(sum(int(v) for v in sums.values()), most)).cast("long").alias("inertia"), of([centroid_digest(c) for c in centroids], "string").alias("centroid_sha256"))
