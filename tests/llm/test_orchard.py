"""Clustering by Orchard's search against comparing every vector with every centroid."""

import hashlib
import math

import numpy as np
import pytest

from quincunx.llm import orchard, queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, cluster int, x string, n long, h string"


def brute(table, clusters, rounds, seed, size, scale):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) of the kept vectors, sorted."""
    kept = []
    for key, v in table:
        if v is not None and len(v) == size and all(c is not None and math.isfinite(c) and abs(c) * scale < orchard.LARGEST for c in v):
            kept.append((key, [math.floor(c * scale) for c in v]))
    named = sorted((hashlib.sha256(f"{seed}:{k}".encode()).hexdigest(), x) for k, x in kept if k is not None)
    centroids = [x for _, x in named[:clusters]]
    if not centroids:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        found = assign()
        for k in range(len(centroids)):
            own = [x for (_, x), (_, c) in zip(kept, found, strict=True) if c == k]
            if own:
                centroids[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    inertia = [sum(d for d, c in found if c == k) for k in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((-1 if key is None else key, c, d, inertia[c], sum(inertia), digest[c]) for (key, _), (d, c) in zip(kept, found, strict=True)))


def got(df):
    return sorted(
        (-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()
    )


def test_every_kind_of_vector(spark):
    rng = np.random.default_rng(5)
    table = [(k, v) for k, v in enumerate((rng.integers(-9, 10, (150, 4)) / 4).tolist())]
    table += [(300 + k, [0.25, 0.25, -1.0, 2.0]) for k in range(60)]  # a hot vector
    table += [(500, [0.1, None, 0, 0]), (501, None), (502, []), (503, [1.0, 2.0]), (504, [math.nan] * 4), (505, [math.inf, 0, 0, 0]),
              (506, [1e300, 0, 0, 0]), (507, [float(orchard.LARGEST), 0, 0, 0]), (None, [1.0, -1.0, 1.0, -1.0]), (3, table[3][1]), (3, table[9][1])]
    df = spark.createDataFrame([(k, v and [c if c is None else float(c) for c in v], 7, "x", 1, "h") for k, v in table], SCHEMA)
    for clusters in (1, 12, 400):
        options = {"clusters": clusters, "rounds": 2, "seed": 2, "size": 4, "scale": 4}
        assert got(orchard.clustered(df, **options)) == brute(table, **options)


def test_equal_vectors_only(spark):
    table = [(k, [0.5] * 4) for k in range(30)]
    df = spark.createDataFrame([(k, v, 7, "x", 1, "h") for k, v in table], SCHEMA)
    options = {"clusters": 5, "rounds": 2, "seed": 2, "size": 4, "scale": 256}
    rows = got(orchard.clustered(df.repartition(7), **options))
    assert rows == brute(table, **options) and {r[1] for r in rows} == {0}


def test_no_vectors(spark):
    assert orchard.clustered(spark.createDataFrame([], SCHEMA)).count() == 0
    assert orchard.clustered(spark.createDataFrame([(None, [0.5] * 64, 1, "x", 1, "h")], SCHEMA)).count() == 0


@pytest.mark.parametrize("clusters", [1, 2, 30])
def test_walks_measure_fewer_than_all(clusters):
    rng = np.random.default_rng(8)
    centres = rng.integers(-5000, 5000, (clusters, 6))
    lists = orchard.Lists(centres)
    x = centres[rng.integers(0, clusters, 3000)] + rng.integers(-40, 41, (3000, 6))
    measured = 0
    whole = lists.distances

    def counted(rows, k):
        nonlocal measured
        measured += len(rows)
        return whole(rows, k)

    lists.distances = counted
    best, distance = lists.nearest(x)
    d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    assert clusters < 3 or measured < 0.6 * d.size


def test_given_vectors(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    assert got(queries.op11_clustering(spark, FOLDER)) == brute(table, **queries.CLUSTERING)
