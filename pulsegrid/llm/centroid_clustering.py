"""k-means over integer vectors with block-norm screening.

A vector is parted into segments, and the norm of each segment is stored beside it; so is that of each centroid. By the
inequality of Cauchy and Schwarz the squared distance of two vectors is at least the sum, over the segments, of the
squared differences of their norms. A centroid whose bound lies above the best distance found so far is left out; the
others, taken in the order of their bounds, get exact 64-bit distances. Bounds are lowered by more than their rounding
error and only strictly larger ones are left out, so labels and ties are those of the full comparison.

Vectors stay in a table of the shared folder. A round sends the centroids (k times the dimension, no more) to the tasks,
which send back one sum and count for each centroid; sums and quotients are exact integers.

Vectors that are null, of another length, or with a null, NaN or infinite component are left out. A vector without an id
is clustered, but no centroid starts from it. Repeated rows count as often as they stand. Fewer vectors with an id than
``k`` start fewer centroids; no such vector gives no rows. Components of which squares would not fit 64 bits end the
query with an error rather than a wrong label. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import counted, cut, settle

#: Components of a segment whose norm is kept.
SEGMENT = 4
#: Rows that one numpy pass handles.
ROWS = 4096
#: A bound is lowered by this share of the norms, far over the rounding error of its few operations.
SLACK = 1e-12
RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def largest(dims: int) -> int:
    """Largest component whose squared distances fit 64 bits."""
    return isqrt(2**62 // dims) // 2


def quantised(df: DataFrame, dims: int, scale: int, segment: int = SEGMENT, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Columns vec_id, q (integer components) and norms (of the segments) of the vectors that count."""
    own = df.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("e"))
    own = own.where(f"size(e) = {dims} AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    fits = f"abs({scale} * x) < {largest(dims)}"
    q = F.expr(f"transform(e, x -> CASE WHEN {fits} THEN CAST(floor({scale} * x) AS BIGINT) ELSE CAST(raise_error('a component is too large for exact distances') AS BIGINT) END)")
    norms = F.expr(f"transform(sequence(0, {(dims - 1) // segment}), s -> sqrt(aggregate(slice(q, s * {segment} + 1, {segment}), 0D, (a, x) -> a + CAST(x AS DOUBLE) * x)))")
    return own.select("vec_id", q.alias("q")).select("vec_id", "q", norms.alias("norms"))


def segment_norms(x: np.ndarray, segment: int) -> np.ndarray:
    return np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, np.arange(0, x.shape[1], segment), axis=1))


def bounds(norms: np.ndarray, centroid_norms: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances of every vector from every centroid."""
    gap = np.abs(norms[:, None, :] - centroid_norms[None, :, :]) - SLACK * (norms[:, None, :] + centroid_norms[None, :, :])
    np.maximum(gap, 0, out=gap)
    return np.einsum("ijk,ijk->ij", gap, gap) * (1 - SLACK)


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, centroid_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Label and exact squared distance of each row of x, ties to the smaller label, and how many distances were needed."""
    low = bounds(norms, centroid_norms)
    order = np.argsort(low, axis=1, kind="stable")
    every = np.arange(len(x))
    label, best, exact = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max), 0
    active = every
    for step in range(len(centroids)):
        which = order[active, step]
        keep = low[active, which] <= best[active]  # the bounds of a row ascend, so a row that is done stays done
        active, which = active[keep], which[keep]
        if not len(active):
            break
        away = x[active] - centroids[which]
        far = np.einsum("ij,ij->i", away, away)
        exact += len(active)
        better = (far < best[active]) | (far == best[active]) & (which < label[active])
        label[active[better]], best[active[better]] = which[better], far[better]
    return label, best, exact


def _parts(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            matrix = lambda c, d: part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)  # noqa: E731, B023
            yield part.column(0), matrix(1, dims), matrix(2, -1)


def _summed(vectors: DataFrame, centroids: list[list[int]], dims: int, segment: int) -> dict[int, list[int]]:
    """New components of every centroid that has a vector: floors of exact means."""
    c = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c_norms = segment_norms(c, segment)
        sums, n = np.zeros_like(c), np.zeros(len(c), np.int64)
        for _, x, norms in _parts(batches, dims):
            label, _, _ = nearest(x, norms, c, c_norms)
            np.add.at(sums, label, x)
            n += np.bincount(label, minlength=len(c))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])
        settle()

    parts = vectors.mapInArrow(run, "cluster int, n bigint, sums array<bigint>").select("cluster", "n", F.posexplode("sums").alias("pos", "s"))
    exact = parts.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    out: dict[int, list[int]] = {}
    for r in exact.collect():  # k times the dimension
        out.setdefault(r["cluster"], [0] * dims)[r["pos"]] = int(r["s"]) // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: list[list[int]], dims: int, segment: int = SEGMENT) -> DataFrame:
    """Columns vec_id, cluster and distance of every quantised vector."""
    c = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c_norms = segment_norms(c, segment)
        for ids, x, norms in _parts(batches, dims):
            label, best, _ = nearest(x, norms, c, c_norms)
            yield pa.RecordBatch.from_arrays([ids, pa.array(label, pa.int32()), pa.array(best)], ["vec_id", "cluster", "distance"])
        settle()

    return vectors.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def fitted(vectors: DataFrame, k: int, rounds: int, dims: int, seed: str = "2:", segment: int = SEGMENT) -> list[list[int]]:
    """Centroids after the rounds, from the vectors whose seeded ids have the smallest digests."""
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id IS NOT NULL").select(digest.alias("digest"), "q").orderBy("digest", "q").limit(k).collect()
    centroids = [list(r["q"]) for r in first]
    for _ in range(rounds if centroids else 0):
        for number, components in _summed(vectors, centroids, dims, segment).items():
            centroids[number] = components
    return centroids


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:", segment: int = SEGMENT, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Cluster, squared distance and inertias of every vector, with the digest of its centroid."""
    spark = df.sparkSession
    vectors, _ = counted(quantised(df, dims, scale, segment, key, column))
    centroids = fitted(vectors, k, rounds, dims, seed, segment)
    if not centroids:
        return spark.createDataFrame([], RESULT)
    found = cut(assigned(vectors, centroids, dims, segment))
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(n, s, sum(inertia.values()), digest(centroids[n])) for n, s in sorted(inertia.items())]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:") -> str:
    """The same rows in DuckDB's SQL, every distance computed."""
    text = f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
            FROM embeddings WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dims}),
        x AS MATERIALIZED (SELECT rid, i, q[i] AS x FROM v, unnest(generate_series(1, {dims})) AS t(i)),
        s AS (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id), q) - 1 AS c, q FROM v WHERE vec_id IS NOT NULL),
        c0 AS MATERIALIZED (SELECT c, i, q[i] AS y FROM s, unnest(generate_series(1, {dims})) AS t(i) WHERE c < {k})"""
    for r in range(rounds + 1):
        text += f""",
        d{r} AS (SELECT rid, c, sum((x - y) * (x - y)) AS d FROM x JOIN c{r} USING (i) GROUP BY rid, c),
        a{r} AS MATERIALIZED (SELECT rid, c, d FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS k FROM d{r}) AS o WHERE k = 1)"""
        if r < rounds:
            text += f""",
        m{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN x USING (rid) GROUP BY c, i),
        c{r + 1} AS MATERIALIZED (SELECT o.c, o.i, CASE WHEN n IS NULL THEN y ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS y FROM c{r} AS o LEFT JOIN m{r} AS m ON o.c = m.c AND o.i = m.i)"""
    return text + f"""
        SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
        FROM a{rounds} AS a JOIN v USING (rid) JOIN (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) AS f ON a.c = f.c
    """
