"""Centroid clustering with the threshold algorithm.

Each vector finds its nearest centroid by sorted access: in every dimension the
centroids' values are sorted, and one walks outward from the vector's own value,
nearest gap first. A centroid met in any dimension has its exact distance taken
at once. After each step the squared gaps of the frontier add up to a bound that
every centroid not yet met reaches or exceeds; the walk ends when that sum
strictly exceeds the best exact distance, so that ties still come to light and
go to the smaller number.

Vectors become integers once, written to the shared folder; a round is one scan
whose tasks return a sum for each centroid, added up by Spark before k x
dimensions numbers reach the driver. Centroids (k x dimensions integers, a
bound that does not grow with the table) travel with the tasks. No vector is
shuffled, so neither a huge cluster nor copies make a hot task.

Kept are vectors with exactly `dims` components, none null, NaN or infinite;
null and other vectors have no row. A null vec_id hashes as the empty text and
stays null; a repeated one is clustered once for each row, and rows of one id
begin in the order of their components. With fewer kept vectors than k, each is
a centroid; without any, the result is empty. Components beyond +-2**27 after
scaling raise an error, since squared distances would leave 64 bits. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import materialize, table

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, "3:"
LIMIT = 1 << 27
#: Vectors that walk at once.
BLOCK = 4096
FAR = np.iinfo(np.int64).max


def scaled(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """(vec_id, rank_hash, x): kept vectors as little-endian 32-bit integers floor(scale * component)."""
    fit = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    kept = df.where((F.size(vector) == dims) & F.forall(vector, fit)).select(F.col(key).cast("long").alias("vec_id"), hashed.alias("rank_hash"), F.col(vector).alias("v"))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.floor(scale * batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            if np.abs(x).max() > LIMIT:
                raise ValueError(f"a component times {scale} lies beyond +-{LIMIT}: exact distances would leave 64 bits")
            raw = x.astype("<i4").tobytes()
            rows = [raw[i : i + 4 * dims] for i in range(0, len(raw), 4 * dims)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("rank_hash"), pa.array(rows, pa.binary())], names=["vec_id", "rank_hash", "x"])

    return kept.mapInArrow(floors, "vec_id long, rank_hash string, x binary")


class Sorted:
    """Centroids sorted in each dimension, for walks from any value."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each row's nearest centroid, and how many exact distances that took."""
        k, dims = self.centroids.shape
        best, number, asked = np.full(len(x), FAR), np.full(len(x), k), 0
        above = np.stack([np.searchsorted(self.values[:, d], x[:, d]) for d in range(dims)], axis=1) if len(x) else np.zeros((0, dims), np.int64)
        rows, walk, below, met, at = np.arange(len(x)), x, above - 1, np.zeros((len(x), k), bool), np.arange(dims)
        while len(rows):
            down = np.where(below >= 0, walk - self.values[np.maximum(below, 0), at], FAR)
            up = np.where(above < k, self.values[np.minimum(above, k - 1), at] - walk, FAR)
            lower = down <= up
            gap = np.where(lower, down, up)
            new = np.zeros_like(met)
            new[np.arange(len(rows))[:, None], self.order[np.where(lower, below, np.minimum(above, k - 1)), at]] = True
            new &= ~met
            met |= new
            for c in range(k):
                who = np.flatnonzero(new[:, c])
                if len(who):
                    asked += len(who)
                    far = ((walk[who] - self.centroids[c]) ** 2).sum(axis=1)
                    r = rows[who]
                    nearer = (far < best[r]) | ((far == best[r]) & (c < number[r]))
                    best[r[nearer]], number[r[nearer]] = far[nearer], c
            go = ((gap**2).sum(axis=1) <= best[rows]) & ~met.all(axis=1)
            rows, walk, met = rows[go], walk[go], met[go]
            below, above = (below - lower)[go], (above + ~lower)[go]
        return number, best, asked


def rows_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def totals(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Of each non-empty cluster: its vectors and the componentwise sum; one row a task and cluster is added up by Spark."""
    k, dims = centroids.shape

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, n, sums = Sorted(centroids), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for part in (batch.slice(i, BLOCK) for i in range(0, batch.num_rows, BLOCK)):
                x = rows_of(part, dims)
                number = walker.nearest(x)[0]
                n += np.bincount(number, minlength=k)
                np.add.at(sums, number, x)
        some = np.flatnonzero(n)
        cells = np.concatenate([n[some, None], sums[some]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells.tolist(), pa.list_(pa.int64()))], names=["cluster", "cells"])

    cells = vectors.select("x").mapInArrow(fold, "cluster long, cells array<long>").select("cluster", F.posexplode("cells").alias("place", "cell"))
    found = cells.groupBy("cluster", "place").agg(F.sum(F.col("cell").cast("decimal(20,0)")).alias("cell")).collect()  # k x (dimensions + 1) numbers
    out: dict[int, list[int]] = {r.cluster: [0] * (dims + 1) for r in found}
    for r in found:
        out[r.cluster][r.place] = int(r.cell)
    return {c: (x[0], x[1:]) for c, x in out.items()}


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dims = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Sorted(centroids)
        for batch in batches:
            for part in (batch.slice(i, BLOCK) for i in range(0, batch.num_rows, BLOCK)):
                number, far, _ = walker.nearest(rows_of(part, dims))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "x").mapInArrow(assign, "vec_id long, cluster int, distance long")


def cluster(
    df: DataFrame, k: int = K, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE, seed: str = SEED
) -> DataFrame:
    """One row a kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid (its components) and centroid_sha256."""
    spark = df.sparkSession
    vectors = materialize(scaled(df, key, vector, dims, scale, seed))
    first = vectors.orderBy("rank_hash", "x").limit(k).collect()  # k rows
    centroids = np.array([np.frombuffer(r.x, "<i4") for r in first], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(first) else 0):
        for c, (n, sums) in totals(vectors, centroids).items():
            centroids[c] = [s // n for s in sums]
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    found = materialize(assigned(vectors, centroids))
    whole = F.sum(F.col("distance").cast("decimal(20,0)"))
    each = found.groupBy("cluster").agg(whole.alias("part"))  # k rows
    all_ = found.agg(whole.cast("long").alias("inertia"))
    named = [(c, x.tolist(), hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for c, x in enumerate(centroids)]
    told = each.join(spark.createDataFrame(named, "cluster int, centroid array<long>, centroid_sha256 string"), "cluster").crossJoin(F.broadcast(all_))
    told = told.select("cluster", F.col("part").cast("long").alias("cluster_inertia"), "inertia", "centroid", "centroid_sha256")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def op11_threshold_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def oracle(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> str:
    """The rounds written out one by one; every distance is compared."""
    far = f"list_sum([(v.x[i] - c.x[i]) * (v.x[i] - c.x[i]) for i in range(1, {dims + 1})])::BIGINT"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor({scale} * e::DOUBLE)::BIGINT for e in embedding] AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len([e for e in embedding if e IS NOT NULL AND isfinite(e)]) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('{seed}' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v) ORDER BY h, x LIMIT {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, c.c, {far} AS d FROM v, c{i} c) GROUP BY r)")
        if i < rounds:
            cell = "SELECT a.c, j, sum(v.x[j]) AS s, count(*) AS n FROM v JOIN a{0} a USING (r), range(1, {1}) t(j) GROUP BY a.c, j".format(i, dims + 1)
            down = "((s - (((s % n) + n) % n)) // n)::BIGINT"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT c, list({down} ORDER BY j) AS x FROM ({cell}) GROUP BY c) m USING (c))")
    last = rounds
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT v.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,"
        f" sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM v JOIN a{last} a USING (r) JOIN c{last} c ON a.c = c.c"
    )


QUERIES = {"op11_threshold_clusters": op11_threshold_clusters}
ORACLE_SQL = {"op11_threshold_clusters": oracle()}
