"""Centroid clustering by ball k-means, in exact integer arithmetic.

Components become floor(scale * x). A cluster is a ball: its centroid and a radius that no member exceeds. With D the squared
distance of two centroids, d that of a member to its own, and equal distances going to the smaller number:

- another cluster can take a member of a ball of radius r only if D <= 4 r^2: these are the ball's neighbours, nearest first;
- a member with D > 4 d for every neighbour is in the stable core and keeps its cluster, as |x - c'| >= sqrt(D) - sqrt(d) > sqrt(d);
- the others lie in annuli between the neighbours' half distances: in the l-th one, only the l nearest neighbours are compared.

All comparisons are of integers, so the result is that of comparing every vector with every centroid. After an update a ball's radius
is at most the old one plus the way that its centroid has moved, both rounded up to integers.

Scale: an assignment is one pass without an exchange, which writes vectors with their cluster and distance and takes the place of
the table before it; sums by cluster are added up in the tasks, so at most one row of sums a task and cluster is
exchanged, however large a cluster is. The driver holds the centroids (k * dimension integers) and their k * k distances, which are
sent to the tasks: k is a parameter, meant for up to a few thousand. Batches are limited by Arrow's limit of bytes.

Defined results: vectors that are null, of another length, or with a null or non-finite component are left out; a component beyond
LIMIT after scaling is an error, as squared distances would leave 64 bits; repeated rows are vectors of their own; a null id stands
behind all others when centroids are chosen; with fewer vectors than k all are centroids; a centroid that ends up empty stays where it
is; extra columns stay out; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

K, DIMENSION, SCALE, ROUNDS, SEED = 16, 64, 64, 3, 1
#: Largest size of a component after scaling: squared distances of 64 of them stay under 2^62.
LIMIT = 1 << 27


@dataclass(frozen=True)
class Ball:
    """A cluster: centroid, and a radius (not squared) that holds all members; None where nothing is known yet."""

    centroid: tuple[int, ...]
    radius: int | None = None


def root_up(n: int) -> int:
    """The least integer whose square is n or more."""
    return isqrt(n - 1) + 1 if n > 0 else 0


def squared(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """vec_id and x (array of long) of the vectors that are kept."""
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda y: F.coalesce(F.abs(y) < float("inf"), F.lit(False)))  # NaN is larger than all numbers
    kept = rows.where((F.size("v") == dimension) & finite)
    x = F.transform("v", lambda y: F.floor(y * F.lit(float(scale))))
    far = F.exists("v", lambda y: F.abs(y) * float(scale) > LIMIT)
    return kept.select("vec_id", F.when(far, F.raise_error(F.lit(f"a component is beyond {LIMIT} after scaling"))).otherwise(x).alias("x"))


def first_centroids(kept: DataFrame, k: int = K, seed: int = SEED) -> list[tuple[int, ...]]:
    """The k vectors of least SHA-256 of `seed:id`, in this order (equal ids by their vectors)."""
    named = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x")
    return [tuple(r["x"]) for r in named.orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()]


def distances(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all centroids: number and squared distance of the nearest, the first of equals."""
    best, least = np.zeros(len(x), np.int64), distances(x, centroids[0])
    for j in range(1, len(centroids)):
        d = distances(x, centroids[j])
        closer = d < least
        best[closer], least[closer] = j, d[closer]
    return best, least


def neighbours(balls: list[Ball]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each ball the numbers of the clusters that could take a member of it, and D, nearest first."""
    out = []
    for i, ball in enumerate(balls):
        near = sorted((squared(ball.centroid, other.centroid), j) for j, other in enumerate(balls) if j != i)
        near = [(d, j) for d, j in near if ball.radius is None or d <= 4 * ball.radius**2]
        out.append((np.array([j for _, j in near], np.int64), np.array([d for d, _ in near], np.int64)))
    return out


def moved(x: np.ndarray, cluster: np.ndarray, centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid, from the clusters of before, and how many distances were computed."""
    best, least, made = cluster.copy(), np.zeros(len(x), np.int64), 0
    for i in np.unique(cluster):
        members = np.flatnonzero(cluster == i)
        own = distances(x[members], centroids[i])
        least[members] = own
        made += len(members)
        other, apart = near[i]
        ring = np.searchsorted(apart, 4 * own, side="right")  # neighbours with D <= 4 d; 0: stable core
        for place in range(int(ring.max(initial=0))):
            some = members[ring > place]
            d = distances(x[some], centroids[other[place]])
            made += len(some)
            closer = (d < least[some]) | ((d == least[some]) & (other[place] < best[some]))
            best[some[closer]], least[some[closer]] = other[place], d[closer]
    return best, least, made


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimension)


def assign(rows: DataFrame, balls: list[Ball], dimension: int = DIMENSION) -> DataFrame:
    """rows: vec_id, x and, but for the first time, cluster. Adds cluster and distance."""
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, x array<long>, cluster int, distance long"
    centroids = np.array([b.centroid for b in balls], np.int64)
    near = neighbours(balls) if "cluster" in rows.columns else None

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), dimension)
            if near is None:
                best, least = nearest(x, centroids)
            else:
                best, least, _ = moved(x, batch.column("cluster").to_numpy().astype(np.int64), centroids, near)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(best, pa.int32()), pa.array(least, pa.int64())], ["vec_id", "x", "cluster", "distance"])

    return rows.mapInArrow(run, schema)


def sums(assigned: DataFrame, dimension: int = DIMENSION) -> dict[int, dict]:
    """For each cluster with members: n, total (of each component), far (largest squared distance), inertia. k rows reach the driver."""

    def partial(batches):
        held: dict[int, list] = {}
        for batch in batches:
            x, distance = _matrix(batch.column("x"), dimension), batch.column("distance").to_numpy()
            cluster = batch.column("cluster").to_numpy()
            for c in np.unique(cluster):
                of = cluster == c
                total = held.setdefault(int(c), [0, [0] * dimension, 0, 0])
                total[0] += int(of.sum())
                total[1] = [a + b for a, b in zip(total[1], x[of].sum(axis=0).tolist(), strict=True)]
                total[2] = max(total[2], int(distance[of].max()))
                total[3] += sum(distance[of].tolist())  # a Python integer, which cannot overflow
        for c, (n, total, far, inertia) in held.items():
            yield pa.RecordBatch.from_pydict({"cluster": pa.array([c], pa.int32()), "n": pa.array([n], pa.int64()), "far": pa.array([far], pa.int64()), "values": pa.array([[str(v) for v in (inertia, *total)]], pa.list_(pa.string()))})

    parts = assigned.select("cluster", "x", "distance").mapInArrow(partial, "cluster int, n long, far long, values array<string>")
    each = parts.select("cluster", "n", "far", F.posexplode("values").alias("place", "value"))
    each = each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out: dict[int, dict] = {}
    for r in each.collect():
        one = out.setdefault(r["cluster"], {"total": [0] * dimension, "n": r["n"], "far": r["far"], "inertia": 0})
        if r["place"]:
            one["total"][r["place"] - 1] = int(r["value"])
        else:
            one["inertia"] = int(r["value"])
    return out


def updated(balls: list[Ball], found: dict[int, dict]) -> list[Ball]:
    """Every ball with members around their floored mean."""
    out = []
    for i, ball in enumerate(balls):
        if i not in found:
            out.append(Ball(ball.centroid, 0))
            continue
        centroid = tuple(t // found[i]["n"] for t in found[i]["total"])
        out.append(Ball(centroid, root_up(found[i]["far"]) + root_up(squared(ball.centroid, centroid))))
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED, watch: Callable[[list[Ball]], None] | None = None) -> tuple[DataFrame, list[Ball], dict[int, dict]]:
    """vec_id, x, cluster and distance of every kept vector; the balls; and the sums of each cluster. watch: called with the balls of each round."""
    kept = common.staged(integer_vectors(vectors, id_col, vector_col, dimension, scale), "vectors")
    balls = [Ball(c) for c in first_centroids(kept, k, seed)]
    if not balls:
        return kept.withColumns({"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("long")}), [], {}
    rows = kept
    for i in range(rounds + 1):
        last, rows = rows, common.staged(assign(rows, balls, dimension), "clusters")
        common.discard(last)
        found = sums(rows, dimension)
        if i < rounds:
            balls = updated(balls, found)
            if watch:
                watch(balls)
    return rows, balls, found


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, balls, found = cluster(common.table(spark, sf_dir, "embeddings"))
    whole = sum(v["inertia"] for v in found.values())
    if whole >= 1 << 63:
        raise OverflowError("the inertia leaves 64 bits")
    of = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster"))
    sha = [hashlib.sha256(",".join(map(str, b.centroid)).encode()).hexdigest() for b in balls]
    return rows.select("vec_id", "cluster", "distance", of([found.get(i, {"inertia": 0})["inertia"] for i in range(len(balls))], "bigint").alias("cluster_inertia"), F.lit(whole).cast("long").alias("inertia"), of(sha, "string").alias("centroid_sha256"))


def _sql() -> str:
    """Every vector against every centroid, the rounds written out."""
    steps = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)::BIGINT) AS x, row_number() OVER () AS u FROM embeddings WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {DIMENSION})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS c, x FROM v ORDER BY sha256('{SEED}:' || vec_id), x LIMIT {K})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"d{i} AS (SELECT u, c, list_sum(list_transform(list_zip(v.x, c{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i})")
        steps.append(f"a{i} AS (SELECT u, c, d FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY d, c) AS r FROM d{i}) WHERE r = 1)")
        if i < ROUNDS:
            steps.append(f"s{i} AS (SELECT c, i, sum(x[i]) AS t, count(*) AS n FROM a{i} JOIN v USING (u), unnest(range(1, {DIMENSION + 1})) AS z(i) GROUP BY ALL)")
            steps.append(f"m{i} AS (SELECT c, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{i} GROUP BY c)")
            steps.append(f"c{i + 1} AS (SELECT c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c))")
    last = f"c{ROUNDS}"
    return f"WITH {', '.join(steps)} SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string({last}.x, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN v USING (u) JOIN {last} USING (c)"


QUERIES = {"op13_ball_kmeans": op13_ball_kmeans}
ORACLES = {"op13_ball_kmeans": _sql()}
