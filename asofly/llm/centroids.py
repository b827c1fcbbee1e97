"""Exact integer k-means, with most centroids ruled out by rotated coordinates.

Each vector is stored with its leading coordinates along the principal axes of all vectors and the norm of what they leave
out. The distance to a centroid is at least that between the leading coordinates and the residual norms, so only centroids
whose bound isn't above a distance already known are compared in integers. Assignments, sums and means are exact; floating
point decides nothing but what is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofly.llm.common import stash

LEAD = 16  # rotated coordinates stored per vector
WIDEST = 1 << 27  # integer components must be smaller than this: then 64 squared differences fit into a long
CHUNK = 4096  # vectors compared at once
SLACK = 1e-6  # of the norms: stored coordinates are 32-bit floats, whose rounding is some 20 times smaller


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def whole_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and v, the integers floor(scale * x), of vectors with exactly dims components, none null or non-finite."""
    x = F.col("embedding")
    fine = (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    wide = F.exists("v", lambda e: (e >= WIDEST) | (e <= -WIDEST))
    kept = vectors.filter(x.isNotNull() & fine).select("vec_id", v.alias("v"))
    return kept.select("vec_id", F.when(wide, F.raise_error(F.lit(f"a component of {WIDEST} or more after scaling"))).otherwise(F.transform("v", lambda e: e.cast("int"))).alias("v"))


def principal_axes(whole: DataFrame, dims: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of all vectors and the lead directions of greatest variance, from moments that tasks add up."""
    pairs = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(dims), np.zeros((dims, dims))
        for b in batches:
            x = _matrix(b.column(0), dims).astype(float)
            n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[float(n), *total, *square[pairs]]], pa.list_(pa.float64()))], ["m"])

    parts = whole.select("v").mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("at", "x"))
    m = np.array([r["x"] for r in parts.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()])  # 1 + dims + dims(dims + 1)/2 numbers
    if not len(m):
        return np.zeros(dims), np.eye(dims)[:, :lead]
    mean, cov = m[1 : dims + 1] / m[0], np.zeros((dims, dims))
    cov[pairs] = m[dims + 1 :] / m[0]
    cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)
    return mean, np.linalg.eigh(cov)[1][:, ::-1][:, :lead]


def rotated(v: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Leading coordinates and, last, the norm of the rest: distances between these rows are at most those of the vectors."""
    x = v - mean
    y = x @ axes
    return np.column_stack([y, np.sqrt(np.maximum((x * x).sum(axis=1) - (y * y).sum(axis=1), 0.0))])


def nearest(v: np.ndarray, low: np.ndarray, centroids: np.ndarray, low_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number) and squared distance of each vector, and how many were compared in integers."""
    norms, c_norms = (low * low).sum(axis=1), (low_centroids * low_centroids).sum(axis=1)
    bound = np.sqrt(np.maximum(norms[:, None] + c_norms[None, :] - 2 * low @ low_centroids.T, 0.0))
    bound = np.maximum(bound - SLACK * (1 + np.sqrt(norms)[:, None] + np.sqrt(c_norms)[None, :]), 0.0)
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    rows, guess = np.arange(len(v)), bound.argmin(axis=1)
    exact[rows, guess] = known = ((v - centroids[guess]) ** 2).sum(axis=1)
    left = bound * bound <= known[:, None]
    left[rows, guess] = False
    for c in np.flatnonzero(left.any(axis=0)):
        r = np.flatnonzero(left[:, c])
        exact[r, c] = ((v[r] - centroids[c]) ** 2).sum(axis=1)
    cluster = exact.argmin(axis=1)
    return cluster, exact[rows, cluster], len(v) + int(left.sum())


def centroid_clusters(vectors: DataFrame, *, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, lead: int = LEAD) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector that is kept.

    Centroids start as the k kept vectors whose sha256 of `seed:vec_id` is smallest (equal ids: the smaller vector first;
    vectors without an id don't start one), all of them if there are fewer. Each round assigns all vectors and takes the
    floor of each cluster's mean; empty clusters keep their centroid. Then vectors are assigned once more.

    Null vectors, other lengths, null or non-finite components aren't kept. Repeated rows are vectors each. An empty table,
    or one without a vector that is kept, gives an empty result; so does one in which no vector has an id. A component that
    reaches 2^27 after scaling is refused with an error. Other columns are not read.
    """
    spark: SparkSession = vectors.sparkSession
    whole = whole_vectors(vectors, dims, scale)
    id_type = vectors.schema["vec_id"].dataType
    mean, axes = principal_axes(whole, dims, lead)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = rotated(_matrix(b.column(1), dims).astype(float), mean, axes).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(low.ravel()), low.shape[1]).cast(pa.list_(pa.float32()))], ["vec_id", "v", "low"])

    ints = T.ArrayType(T.IntegerType())
    stored = stash(whole.mapInArrow(rotate, T.StructType([T.StructField("vec_id", id_type), T.StructField("v", ints), T.StructField("low", T.ArrayType(T.FloatType()))])), "vectors")
    first = stored.filter(F.col("vec_id").isNotNull()).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)

    def assigned(frame: pa.RecordBatch, c: np.ndarray, low_c: np.ndarray) -> Iterator[tuple]:
        v, low = _matrix(frame.column(0), dims).astype(np.int64), _matrix(frame.column(1), low_c.shape[1]).astype(float)
        for at in range(0, len(v), CHUNK):
            yield v[at : at + CHUNK], *nearest(v[at : at + CHUNK], low[at : at + CHUNK], c, low_c)[:2]

    for _ in range(rounds if len(centroids) else 0):
        low_centroids = rotated(centroids.astype(float), mean, axes)

        def add_up(batches: Iterator[pa.RecordBatch], c=centroids, low_c=low_centroids) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
            for b in batches:
                for v, cluster, _distance in assigned(b, c, low_c):
                    n += np.bincount(cluster, minlength=len(c))
                    order = np.argsort(cluster, kind="stable")
                    found, starts = np.unique(cluster[order], return_index=True)
                    total[found] += np.add.reduceat(v[order], starts, axis=0)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(list(total[at]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

        sums = stored.select("v", "low").mapInArrow(add_up, "cluster int, n long, total array<long>").groupBy("cluster")
        centroids = centroids.copy()
        for r in sums.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(dims))).alias("total")).collect():  # k rows at most
            centroids[r["cluster"]] = np.array(r["total"], np.int64) // r["n"]

    low_centroids = rotated(centroids.astype(float), mean, axes)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(assigned(b, centroids, low_centroids)) if len(centroids) and b.num_rows else []
            if got:
                yield pa.RecordBatch.from_arrays([b.column(2), pa.array(np.concatenate([g[1] for g in got]), pa.int32()), pa.array(np.concatenate([g[2] for g in got]))], ["vec_id", "cluster", "distance"])

    fields = [T.StructField("vec_id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    done = stash(stored.select("v", "low", "vec_id").mapInArrow(last, T.StructType(fields)), "clusters")
    digests = spark.createDataFrame([(i, ",".join(map(str, c.tolist()))) for i, c in enumerate(centroids)], "cluster int, text string").select("cluster", F.sha2("text", 256).alias("centroid_sha256"))
    sums = done.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0)))).join(F.broadcast(digests), "cluster")  # k rows at most
    return done.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql(rounds: int) -> str:
    """The rounds one after another, each of all distances, their least, and floors of means."""
    parts = []
    for i in range(rounds + 1):
        parts.append(
            f"""d{i} AS (SELECT x.r, c.n, list_sum(list_transform(generate_series(1, 64), lambda i: (x.v[i] - c.c[i]) * (x.v[i] - c.c[i]))) AS d FROM x, c{i} c),
 a{i} AS (SELECT r, arg_min(n, (d, n)) AS n, CAST(min(d) AS BIGINT) AS d FROM d{i} GROUP BY r)"""
        )
        if i < rounds:
            parts.append(
                f"""u{i} AS (SELECT a.n, i, sum(x.v[i])::BIGINT AS s, count(*) AS m FROM a{i} a JOIN x USING (r), generate_series(1, 64) g(i) GROUP BY ALL),
 c{i + 1} AS (SELECT c.n, coalesce(u.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT n, list((s - ((s % m) + m) % m) // m ORDER BY i) AS c FROM u{i} GROUP BY n) u USING (n))"""
            )
    return ",\n ".join(parts)


#: All distances in integers, round by round.
ORACLE_SQL = f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
 c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS n, v AS c FROM x WHERE vec_id IS NOT NULL ORDER BY n LIMIT 40),
 {_rounds_sql(5).replace(" AS (", " AS MATERIALIZED (")}
SELECT vec_id, CAST(a.n AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.n) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a5 a JOIN x USING (r) JOIN c5 c ON c.n = a.n"""
