"""Centroid clustering by weighted deduplication.

Vectors become integer vectors, and equal ones are grouped with how often each
occurs: one row for each task and vector crosses the exchange, so a vector that
a third of all rows have is one row from then on.  Lloyd's rounds run over the
distinct vectors alone.  A task adds up, for each cluster, its vectors times
their counts in whole numbers; these sums (clusters by components for a task,
however many vectors it has) meet in one aggregate, and the driver holds
nothing but the centroids.  At last the assignment of each distinct vector is
joined back to the vec_ids that have it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import BATCH, Workspace

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 16, 3, 64, 64, "1"
#: Components beyond this (of either sign) count as this, so that squared distances of 64 of them fit a long.
MOST = 1 << 24
#: Below this, products of float64 are exact whole numbers.
EXACT = 1 << 21
MOST_LONG = (1 << 63) - 1


def packed(values: np.ndarray) -> pa.Array:
    """Rows of whole numbers as binary, one byte for each component where all of a row fit, else four; equal rows are equal binaries."""
    rows, size = values.shape
    small = (np.abs(values + 0.5) < 128).all(axis=1)
    lengths = np.where(small, size, 4 * size)
    ends = np.cumsum(lengths)
    data = np.empty(int(ends[-1]) if rows else 0, np.uint8)
    for which, kind in ((small, "<i1"), (~small, "<i4")):
        own = np.ascontiguousarray(values[which].astype(kind)).view(np.uint8).reshape(-1, size * int(kind[2]))
        data[(ends - lengths)[which][:, None] + np.arange(own.shape[1])] = own
    return pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(np.r_[0, ends].astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array, size: int) -> np.ndarray:
    """The rows of whole numbers that ``packed`` made binary."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False)
    out = np.empty((len(column), size), np.int64)
    for width, kind in ((1, "<i1"), (4, "<i4")):
        which = np.flatnonzero(lengths == width * size)
        if len(which):
            out[which] = np.frombuffer(b"".join(column.take(pa.array(which)).to_pylist()), kind).reshape(-1, size)
    return out


def quantise(vectors: DataFrame, size: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the packed floors of scale times each component, of the rows with ``size`` finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = pc.equal(pc.fill_null(pc.list_value_length(batch.column("embedding")), -1), size)
            ids, lists = batch.column("vec_id").filter(right), batch.column("embedding").filter(right)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            finite = np.isfinite(x).all(axis=1)  # nulls are NaN here
            with np.errstate(over="ignore"):
                q = np.clip(np.floor(scale * x[finite]), -MOST, MOST).astype(np.int64)
            yield pa.record_batch([ids.filter(pa.array(finite)), packed(q)], ["vec_id", "q"])

    vectors.sparkSession.conf.set(*BATCH)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, q binary")


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid (ties: the smaller number) and its squared distance, exactly.

    Products run in float64 where all of them and their sums are whole numbers
    below 2**53, else in 64-bit integers; either way gives the same.
    """
    most = max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if most < EXACT and 4 * q.shape[1] * int(most) ** 2 < 1 << 53 else np.int64
    a, c = q.astype(kind), centroids.astype(kind)
    all_distances = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None, :]
    cluster = all_distances.argmin(axis=1)
    return cluster, all_distances[np.arange(len(q)), cluster].astype(np.int64)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of the vectors nearest to each; those without any stay."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), size + 1), np.int64)
        for batch in batches:
            q, n = unpacked(batch.column("q"), size), batch.column("n").to_numpy(zero_copy_only=False)
            cluster, _ = nearest(q, centroids)
            for c in np.unique(cluster):
                own = cluster == c
                total[c, :size] += n[own] @ q[own]
                total[c, size] += n[own].sum()
        used = np.flatnonzero(total[:, size])
        part = np.tile(np.arange(size + 1), len(used))
        yield pa.record_batch([pa.array(np.repeat(used, size + 1), pa.int32()), pa.array(part, pa.int32()), pa.array(total[used].ravel(), pa.int64())], ["cluster", "part", "total"])

    sums = distinct.select("q", "n").mapInArrow(run, "cluster int, part int, total long").groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    known = {(r.cluster, r.part): int(r.total) for r in sums.collect()}  # clusters times components at most
    return np.array([[known[c, i] // known[c, size] for i in range(size)] if (c, size) in known else old for c, old in enumerate(centroids.tolist())], np.int64)


def first_centroids(rows: DataFrame, clusters: int, seed: str, size: int) -> np.ndarray:
    """The vectors whose ``seed:vec_id`` has the smallest SHA-256, in that order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = rows.select(hashed.alias("hash_"), "q").orderBy("hash_", "q").limit(clusters).collect()
    return unpacked(pa.array([bytes(r.q) for r in chosen], pa.binary()), size)


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """q, n, cluster and distance of each distinct vector."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(unpacked(batch.column("q"), size), centroids)
            yield pa.record_batch([batch.column("q"), batch.column("n"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["q", "n", "cluster", "distance"])

    return distinct.select("q", "n").mapInArrow(run, "q binary, n long, cluster int, distance long")


def cluster(spark: SparkSession, vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = COMPONENTS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that counts, one row for each row.

    Vectors count if they have ``size`` components, none null, NaN or infinite;
    null vectors and others are left out, and if none counts the result is
    empty.  Rows that repeat a vec_id or a vector count each.  A row with a null
    vec_id is hashed as if it were empty text and stays null in the result.
    Rows of one vec_id with unlike vectors, which tie for a first centroid, go
    by their packed vectors.  With fewer vectors than ``clusters`` there are as
    many centroids as vectors, equal ones among them: ties go to the smaller
    number, so the others stay empty.  Components beyond 2**24 after scaling
    count as 2**24 (of their sign); inertias beyond a long are the greatest
    long.  Further columns of any name do no harm; there are no texts.
    """
    work = Workspace(spark, "lloyd")
    rows = work.keep(quantise(vectors, size, scale), "rows")
    distinct = work.keep(rows.groupBy("q").agg(F.count("*").alias("n")), "distinct")
    centroids = first_centroids(rows, clusters, seed, size)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    last = work.keep(assigned(distinct, centroids), "assigned")
    work.drop("distinct")
    inertia = last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)") * F.col("n").cast("decimal(18,0)")).alias("own")).collect()  # a row for each cluster
    own = {r.cluster: int(r.own) for r in inertia}
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    joined = rows.join(last.hint("merge"), "q")
    return joined.select(
        "vec_id", "cluster", "distance", pick([min(own.get(c, 0), MOST_LONG) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(own.values()), MOST_LONG)).cast("long").alias("inertia"), pick(shown).alias("centroid_sha256"),
    )


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = COMPONENTS, scale: int = SCALE, seed: str = SEED) -> str:
    """The same for DuckDB, over all vectors instead of distinct ones."""
    gap = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (q[i] - m[i]) * (q[i] - m[i])))"
    steps = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q, row_number() OVER () AS r FROM embeddings"
        f" WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"m0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q AS m FROM (SELECT sha256('{seed}:' || vec_id) AS h, q FROM kept ORDER BY h LIMIT {clusters}))",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(q) AS q, min(d) AS d, arg_min(c, d * {clusters} + c) AS c FROM (SELECT r, vec_id, q, c, CAST({gap} AS BIGINT) AS d FROM kept, m{k}) GROUP BY r)")
        if k < rounds:
            steps.append(f"s{k} AS (SELECT c, i, CAST(floor(sum(q[i])::DOUBLE / count(*)) AS BIGINT) AS v FROM a{k}, range(1, {size + 1}) AS t(i) GROUP BY c, i)")
            steps.append(f"m{k + 1} AS (SELECT c, coalesce(any_value(n.m), any_value(o.m)) AS m FROM m{k} o LEFT JOIN (SELECT c, list(v ORDER BY i) AS m FROM s{k} GROUP BY c) n USING (c) GROUP BY c)")
    return (
        "WITH " + ", ".join(steps) + f" SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN m{rounds} USING (c)"
    )
