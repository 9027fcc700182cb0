"""Centroid clustering of integer vectors by Orchard's search.

Every centroid keeps the others in a list, nearest first.  A vector walks down the list of
its best centroid so far; a closer one moves it to the head of that one's list, and centroids
it has measured are marked and not measured again.  A neighbour strictly more than twice as
far from the best centroid as the vector is can't be as near as that, nor can those after it,
so there the walk ends.  All arithmetic is on integers, hence exact, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quincunx.llm.common import written

BLOCK = 4_096  # vectors that walk together
# Components below 2^26 in size keep four times a squared distance of 64 components below 2^63.
LARGEST = 1 << 26


class Lists:
    """Centroids with their neighbour lists and the squared distances along them."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        gaps = np.stack([((centroids - c) ** 2).sum(axis=1) for c in centroids])
        own = np.arange(len(centroids))
        gaps[own, own] = -1  # first in its own list, then cut off
        order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
        self.neighbours, self.gaps = order, np.take_along_axis(gaps, order, axis=1)
        # The walk may begin anywhere; from the middle the first bound is smallest.
        self.middle = int(np.sqrt(np.maximum(gaps, 0)).sum(axis=1).argmin())

    def distances(self, x: np.ndarray, k: np.ndarray) -> np.ndarray:
        off = x - self.centroids[k]
        return np.einsum("ij,ij->i", off, off)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row; ties go to the smaller number."""
        n = len(x)
        best = np.full(n, self.middle)
        distance = self.distances(x, best)
        place = np.zeros(n, np.int64)
        marked = np.zeros((n, len(self.centroids)), bool)
        marked[:, self.middle] = True
        walking = np.arange(n if self.gaps.shape[1] else 0)
        while len(walking):
            at, step = best[walking], place[walking]
            onward = self.gaps[at, step] <= 4 * distance[walking]
            walking, at, step = walking[onward], at[onward], step[onward]
            next_one = self.neighbours[at, step]
            place[walking] += 1
            fresh = ~marked[walking, next_one]
            rows, tried = walking[fresh], next_one[fresh]
            marked[rows, tried] = True
            d = self.distances(x[rows], tried)
            closer = (d < distance[rows]) | ((d == distance[rows]) & (tried < best[rows]))
            rows = rows[closer]
            best[rows], distance[rows], place[rows] = tried[closer], d[closer], 0
            walking = walking[place[walking] < self.gaps.shape[1]]
        return best, distance


def integer_vectors(df: DataFrame, key: str, vector: str, size: int, scale: float) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors with ``size`` finite components."""
    v = F.col(vector).cast("array<double>")
    fits = (F.size(v) == size) & F.forall(v, lambda c: F.coalesce(F.abs(c) * scale < LARGEST, F.lit(False)))
    return df.where(F.coalesce(fits, F.lit(False))).select(
        F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c * scale).cast("int")).alias("x")
    )


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _assigned(vectors: DataFrame, lists: Lists, size: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                best, distance = lists.nearest(_rows(part.column(1), size))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"]
                )

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def _sums(vectors: DataFrame, lists: Lists, size: int) -> DataFrame:
    """(cluster, n, sums): one row a cluster, from one row for each cluster in each batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                x = _rows(batch.column(1).slice(start, BLOCK), size)
                best, _ = lists.nearest(x)
                order = np.argsort(best, kind="stable")
                clusters, starts, counts = np.unique(best[order], return_index=True, return_counts=True)
                totals = np.add.reduceat(x[order], starts, axis=0)
                offsets = np.arange(0, totals.size + 1, size, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(clusters, pa.int32()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(totals.ravel()))],
                    ["cluster", "n", "sums"],
                )

    partial = vectors.mapInArrow(run, "cluster int, n long, sums array<long>")
    # Decimals, since sums over a very large table may pass 64 bits.
    totals = [F.sum(F.col("sums")[k].cast("decimal(20,0)")) for k in range(size)]
    return partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*totals).alias("sums"))


def clustered(
    df: DataFrame, *, clusters: int = 40, rounds: int = 5, seed: int = 2, size: int = 64, scale: float = 256.0,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors with exactly ``size`` components, none null, non-finite or 2^26 / scale
    and more in size; with others squared distances would not fit 64 bits.  The first
    centroids are the vectors with the smallest SHA-256 of ``seed:vec_id``, equal ones by
    their components; a null id names no centroid, but its vector is assigned like any other.
    Fewer kept vectors than ``clusters`` make fewer centroids, and none gives no rows.
    Equal centroids stay apart, the smaller number getting all vectors.  An inertia beyond 64
    bits is null.  Repeated rows count as often as they come.

    A round is one pass over a stored table of integers.  Its sums combine on the map side,
    however large a cluster is; the driver sees ``clusters`` rows a round, whatever the input.
    """
    vectors = written(integer_vectors(df, key, vector, size, scale), "integers")
    first = vectors.where("vec_id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    chosen = [r["x"] for r in first.orderBy("h", "x").limit(clusters).collect()]
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not chosen:
        return df.sparkSession.createDataFrame([], schema)
    centroids = np.array(chosen, np.int64)
    for _ in range(rounds):
        for r in _sums(vectors, Lists(centroids), size).collect():
            centroids[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
    lists = Lists(centroids)
    assigned = written(_assigned(vectors, lists, size), "assigned")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = assigned.groupBy("cluster").agg(F.expr("try_sum(distance)").alias("cluster_inertia"))
    total = assigned.agg(F.expr("try_sum(distance)").alias("inertia"))
    # At most one row for each centroid, and one in all.
    return (
        assigned.join(F.broadcast(inertia), "cluster")
        .crossJoin(F.broadcast(total))
        .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.array(*map(F.lit, names))[F.col("cluster")].alias("centroid_sha256"))
    )


def clustering_sql(table: str, *, clusters: int, rounds: int, seed: int, size: int, scale: int) -> str:
    """The same in plain SQL, over all pairs of a vector and a centroid."""
    key = f"sha256('{seed}:' || vec_id::VARCHAR)"
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS x FROM {table}
      WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {size})""",
        f"p AS MATERIALIZED (SELECT vec_id, unnest(range({size})) AS i, unnest(x) AS x FROM v)",
        f"""s AS (SELECT row_number() OVER (ORDER BY {key}) - 1 AS k, x FROM v),
c0 AS MATERIALIZED (SELECT k, unnest(range({size})) AS i, unnest(x) AS c FROM s WHERE k < {clusters})""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""d{r} AS (SELECT vec_id, k, sum((x - c) * (x - c))::BIGINT AS d FROM p JOIN c{r} USING (i) GROUP BY vec_id, k),
a{r} AS MATERIALIZED (SELECT vec_id, k, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS n FROM d{r}) WHERE n = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""m{r} AS (SELECT k, i, sum(x)::BIGINT AS t, count(*) AS n FROM p JOIN a{r} USING (vec_id) GROUP BY k, i),
c{r + 1} AS MATERIALIZED (SELECT c{r}.k, c{r}.i, coalesce((t - ((t % n) + n) % n) // n, c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.k = m{r}.k AND c{r}.i = m{r}.i)"""
            )
    return f"""WITH {', '.join(parts)},
h AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN h USING (k)"""


__all__ = ["Lists", "clustered", "clustering_sql", "integer_vectors"]
