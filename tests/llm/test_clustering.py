"""Ball k-means against comparing every vector with every centroid."""

import hashlib
import math
import random

import numpy as np
import pytest

from lodestone.llm import ball_kmeans

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=16, rounds=3, dimension=64):
    """Rows of (vec_id, cluster, distance) and the final centroids, in Python integers."""
    kept = [(i, [math.floor(64 * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == dimension and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in first[:k]]

    def assigned():
        out = []
        for i, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids]
            out.append((i, d.index(min(d)), min(d), x))
        return out

    for _ in range(rounds):
        now = assigned()
        for c in range(len(centroids)):
            if own := [x for _, n, _, x in now if n == c]:
                centroids[c] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    return [r[:3] for r in assigned()], centroids


def vectors(n=300, seed=2, spread=1.0):
    r = random.Random(seed)
    centre = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(9)]
    rows = []
    for i in range(n):
        c = centre[0] if i % 3 == 0 else r.choice(centre)  # a third of all in one cluster
        rows.append((i, [float(np.float32(v + r.gauss(0, 0.2 * spread))) for v in c]))
    rows += [(n, rows[4][1]), (n + 1, rows[4][1]), rows[7], rows[7], (None, rows[9][1]), (n + 2, None), (n + 3, []), (n + 4, [0.0] * 63), (n + 5, [0.0] * 63 + [None]), (n + 6, [0.0] * 63 + [float("nan")]), (n + 7, [float("-inf")] + [0.0] * 63)]
    return rows


@pytest.mark.parametrize("spread", [1.0, 0.0, 6.0])
def test_clusters_agree_with_brute_force(spark, spread):
    """Also with equal vectors (spread 0), so that centroids and distances tie."""
    rows = vectors(spread=spread)
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], SCHEMA).repartition(3)
    found, balls, sums = ball_kmeans.cluster(df)
    want, centroids = brute(rows)
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()), key=key) == sorted(want, key=key)
    assert [list(b.centroid) for b in balls] == centroids
    assert {c: s["inertia"] for c, s in sums.items()} == {c: sum(d for _, n, d in want if n == c) for c in {r[1] for r in want}}


def test_balls_hold_their_members_and_save_distances():
    rng = np.random.default_rng(1)
    centre = rng.integers(-3000, 3000, (8, 16))
    x = (centre[rng.integers(0, 8, 4000)] + rng.integers(-200, 200, (4000, 16))).astype(np.int64)
    balls = [ball_kmeans.Ball(tuple(map(int, c + 40))) for c in centre]
    best, least = ball_kmeans.nearest(x, np.array([b.centroid for b in balls]))
    for _ in range(4):
        stats = {int(c): {"n": int((best == c).sum()), "total": x[best == c].sum(axis=0).tolist(), "far": int(least[best == c].max()), "inertia": 0} for c in np.unique(best)}
        balls = ball_kmeans.updated(balls, stats)
        centroids = np.array([b.centroid for b in balls])
        assert all((ball_kmeans.distances(x[best == c], centroids[c]) <= balls[c].radius ** 2).all() for c in stats)
        want = ball_kmeans.nearest(x, centroids)
        best, least, made = ball_kmeans.moved(x, best, centroids, ball_kmeans.neighbours(balls))
        assert (best == want[0]).all() and (least == want[1]).all()
        assert made < 1.5 * len(x)  # of 8 * len(x): nearly all members are in a stable core


def test_ties_go_to_the_smaller_number():
    x = np.zeros((4, 2), np.int64)
    centroids = np.array([[3, 0], [0, 3], [0, -3], [3, 0]])
    near = ball_kmeans.neighbours([ball_kmeans.Ball(tuple(map(int, c)), 3) for c in centroids])
    for start in range(4):
        best, least, _ = ball_kmeans.moved(x, np.full(4, start), centroids, near)
        assert best.tolist() == [0] * 4 and least.tolist() == [9] * 4


def test_few_vectors_empty_table_and_far_components(spark):
    few = spark.createDataFrame([(1, [0.5] * 64, 0), (2, [-0.5] * 64, 0)], SCHEMA)
    found, balls, _ = ball_kmeans.cluster(few)
    assert len(balls) == 2 and [r["distance"] for r in found.collect()] == [0, 0]
    empty, balls, sums = ball_kmeans.cluster(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and balls == [] and sums == {}
    with pytest.raises(Exception, match="beyond"):
        ball_kmeans.cluster(spark.createDataFrame([(1, [1e30] * 64, 0)], SCHEMA))
    large = [(i, [float((i % 5) * 400_000 - 900_000 + j) for j in range(64)]) for i in range(40)]
    found, _, _ = ball_kmeans.cluster(spark.createDataFrame([(i, x, 1) for i, x in large], SCHEMA))
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()) == sorted(brute(large)[0])


def test_query_columns(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, centroids = brute(rows)
    inertia = {c: sum(d for _, n, d in want if n == c) for c in {r[1] for r in want}}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    out = ball_kmeans.op13_ball_kmeans(spark, sf_dir).collect()
    assert sorted(map(tuple, out)) == sorted((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in want)
