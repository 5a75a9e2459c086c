"""Centroid clustering (11): exact integer Lloyd rounds with partial-distance search.

Vectors with exactly DIMS components, none null or non-finite, are kept; component x becomes the integer
floor(SCALE * x). The first K centroids are the kept vectors with the smallest hashes of their keys. A round assigns
every vector to its nearest centroid and moves each centroid that has vectors to their componentwise floor(sum / count);
after ROUNDS rounds vectors are assigned once more.

Partial-distance search: components are read in the order of falling variance, BLOCK at a time. The centroid that is
nearest over the first block is measured in full; each other one is given up for a vector as soon as its sum of squared
differences lies strictly above the best distance so far, so only centroids that may win, or tie, are measured over all
components. Everything is 64-bit integer arithmetic, so results depend neither on order nor on partitions.

Vectors live in one table in the shared folder. A round is one pass over it: a task hands on K counts and sums, the
driver gets K * DIMS sums and makes K centroids of them. A vector that occurs a million times is that many rows of many
tasks, never a group.

Ties between centroids go to the smaller number. A null key hashes to null and comes last among starting vectors; equal
hashes (repeated keys) are ordered by their vectors. Repeated rows count each. With fewer than K vectors there are as
many centroids. An empty table, or one without valid vectors, gives an empty result. Integers are held within
+-2**27, so that a distance fits 64 bits (components beyond +-131072); inertias that pass 64 bits stay at the largest
long. Columns other than key and vector aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import frugal, save, table

DIMS, SCALE, K, ROUNDS = 64, 1024, 8, 10
#: Components added to a partial distance between two looks at the best distance.
BLOCK = 8
BOUND = 2**27
LONGEST = 2**63 - 1


def integers(vector: Column, dims: int = DIMS, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, null for vectors that aren't kept."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    held = F.transform(
        vector,
        lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-1e15)), F.lit(1e15))), F.lit(-BOUND)), F.lit(BOUND)).cast("int"),
    )
    return F.when((F.size(vector) == dims) & finite, held)


def nearest(vectors: np.ndarray, centroids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; columns are in the order in which they are read."""
    n, dims = vectors.shape
    first = np.stack([_squares(vectors[:, :block], c[:block]) for c in centroids], axis=1)
    cluster = first.argmin(1)
    best = first[np.arange(n), cluster] + _squares(vectors[:, block:], centroids[cluster, block:])
    for number, centroid in enumerate(centroids):
        rows = np.flatnonzero((first[:, number] <= best) & (cluster != number))
        part = first[rows, number]
        for at in range(block, dims, block):
            part = part + _squares(vectors[rows, at : at + block], centroid[at : at + block])
            alive = part <= best[rows]  # strictly above: given up
            rows, part = rows[alive], part[alive]
            if not len(rows):
                break
        wins = (part < best[rows]) | ((part == best[rows]) & (number < cluster[rows]))
        cluster[rows[wins]], best[rows[wins]] = number, part[wins]
    return cluster, best


def _squares(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = vectors - centroid
    return np.einsum("ij,ij->i", gap, gap)


def _matrix(column: pa.Array, order: np.ndarray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), len(order))[:, order]


def _sums(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of every centroid's vectors."""
    sorted_centroids = centroids[:, order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centroids), np.int64)
        total = np.zeros(centroids.shape, np.int64)  # a task's sums: 2**36 vectors at the bound would fit
        for batch in batches:
            vectors = _matrix(batch.column(0), order)
            cluster, _ = nearest(vectors, sorted_centroids)
            for number in np.unique(cluster):
                mine = cluster == number
                count[number] += mine.sum()
                total[number, order] += vectors[mine].sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(count)), pa.int32()), pa.array(count), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"]
        )

    parts = rows.select("vector").mapInArrow(frugal(run), "cluster int, n long, sums array<long>").where("n > 0")
    sums = parts.select("cluster", "n", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("n"), F.sum(F.col("col").cast("decimal(20,0)")))
    out: dict[int, tuple[int, list[int]]] = {}
    for cluster, pos, n, total in sums.collect():  # K * DIMS rows
        out.setdefault(cluster, (n, [0] * len(order)))[1][pos] = int(total)
    return out


def fit(rows: DataFrame, dims: int = DIMS, k: int = K, rounds: int = ROUNDS, salt: str = "3:") -> tuple[np.ndarray, np.ndarray]:
    """(centroids, order of components) of a saved table with columns key and vector."""
    hashed = F.sha2(F.concat(F.lit(salt), F.col("key").cast("string")), 256)
    starts = rows.select(hashed.alias("hash"), "vector").orderBy(F.asc_nulls_last("hash"), "vector").limit(k).collect()
    centroids = np.array([r[1] for r in starts], np.int64).reshape(len(starts), dims)
    if not starts:
        return centroids, np.arange(dims)
    spread = rows.agg(*[F.var_pop(F.get("vector", F.lit(d))) for d in range(dims)]).first()
    order = np.argsort(-np.array(spread), kind="stable")
    for _ in range(rounds):
        for number, (n, sums) in _sums(rows, centroids, order).items():
            centroids[number] = [s // n for s in sums]
    return centroids, order


def assign(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """key, cluster, distance of every row of a table with columns key and vector."""
    kind, sorted_centroids = rows.schema["key"].dataType.simpleString(), centroids[:, order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(_matrix(batch.column(1), order), sorted_centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance)], ["key", "cluster", "distance"])

    return rows.select("key", "vector").mapInArrow(frugal(run), f"key {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, salt: str = "3:") -> DataFrame:
    """One row per kept vector: key, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The table of integers and that of assignments stay in the shared folder, as the result reads the latter.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(key).alias("key"), integers(F.col(vector), dims, scale).alias("vector")).where("vector IS NOT NULL")
    rows, _ = save(kept, "centroid-vectors")
    centroids, order = fit(rows, dims, k, rounds, salt)
    if not len(centroids):
        found = rows.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    else:
        found, _ = save(assign(rows, centroids, order), "centroid-clusters")
    within = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect()}  # K rows
    facts = [(number, min(within.get(number, 0), LONGEST), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for number, c in enumerate(centroids.tolist())]
    digests = spark.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.join(F.broadcast(digests), "cluster").select(  # K rows
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", F.lit(min(sum(within.values()), LONGEST)).cast("long").alias("inertia"), "centroid_sha256"
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in eight clusters."""
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The rounds written out: v has a row per vector and component, cN the centroids before round N + 1."""
    steps = [
        "e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "v AS MATERIALIZED (SELECT r, unnest(range(64)) AS d, unnest(q) AS x FROM e)",
        "s AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS j, q FROM e)",
        "c0 AS MATERIALIZED (SELECT j, unnest(range(64)) AS d, unnest(q) AS x FROM s WHERE j < 8)",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"g{n} AS (SELECT r, j, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS g FROM v JOIN c{n} c USING (d) GROUP BY r, j)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, min({{'g': g, 'j': j}}) AS m FROM g{n} GROUP BY r)")
        if n < ROUNDS:
            steps.append(f"t{n} AS (SELECT m.j AS j, d, sum(x) AS s, count(*)::HUGEINT AS n FROM a{n} JOIN v USING (r) GROUP BY m.j, d)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.j, c.d, coalesce((s - ((s % n) + n) % n) // n, c.x)::BIGINT AS x FROM c{n} c LEFT JOIN t{n} USING (j, d))")
    steps.append(f"h AS (SELECT j, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY j)")
    return f"WITH {', '.join(steps)} SELECT vec_id, m.j::INT AS cluster, m.g AS distance, (sum(m.g) OVER (PARTITION BY m.j))::BIGINT AS cluster_inertia, (sum(m.g) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN e USING (r) JOIN h ON h.j = m.j"


ORACLE = _oracle()
