"""Operator 11, centroid clustering: Lloyd's rounds over integer vectors, each vector assigned by sort-means.

Each round the driver orders, for each centroid, all others by their distance from it: a table of k * k numbers. A vector starts at
the centroid that it had, and looks at the others in that one's order until one is strictly beyond twice the vector's distance
to where it started: by the triangle inequality none from there on is nearer, nor as near. In a batch the vectors of one centroid
go together, farthest first, so those that still look are a prefix of the block.

A round is one pass over a narrow table: it writes each vector with its new centroid and, in the same table, each task's sums (k rows);
only the sums are merged by a shuffle. The table of the round before is then dropped. Products are exact: in doubles while
all of them stay below 2 ** 53, else in 64-bit integers.

Defined results: vectors that are null, of another length, or hold null or non-finite components are left out; repeated rows are
rows of their own; equal hashes (repeated ids) are told apart by the vectors, null ids become first centroids last; with fewer
than k vectors, each is a first centroid; an empty table gives no rows; extra columns are ignored. Components beyond what a
long can hold the squared distance of fail with a message. A sum of distances that no long holds is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.llm import kernel as K
from noticeflow.llm import vectors as V
from noticeflow.llm.shared import discard, table_path

SCALE, WIDTH, CLUSTERS, ROUNDS, SALT = 256, 64, 40, 5, "2:"


class Scan:
    """The centroids of a round, and for each the others by distance (ties: smaller number)."""

    def __init__(self, centroids: list[list[int]]):
        self.c = np.array(centroids, np.int64)
        k = len(self.c)
        gaps = np.array([((self.c - row) ** 2).sum(1) for row in self.c])
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.order = np.array([row[row != i] for i, row in enumerate(self.order)]).reshape(k, k - 1)
        # a centroid is looked at while gap <= 4 * d, both squared, that is while d >= ceil(gap / 4)
        self.least = -(-np.take_along_axis(gaps, self.order, axis=1) // 4)

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of integer vectors that had the clusters `before`."""
        bound = max(int(np.abs(x).max(initial=0)), int(np.abs(self.c).max()))
        kind = np.float64 if x.shape[1] * 4 * bound * bound < 1 << 53 else np.int64
        c = self.c.astype(kind)
        lengths = (c * c).sum(1)
        cluster, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        order = np.argsort(before, kind="stable")
        borders = np.searchsorted(before[order], np.arange(len(c) + 1))
        for own in range(len(c)):
            rows = order[borders[own] : borders[own + 1]]
            if not len(rows):
                continue
            block = x[rows].astype(kind)
            start = (block * block).sum(1) - 2 * (block @ c[own]) + lengths[own]
            far = np.argsort(-start, kind="stable")
            rows, block, start = rows[far], block[far], start[far]
            norms = (block * block).sum(1)
            best, who = start.copy(), np.full(len(rows), own)
            looking = np.searchsorted(-start, -self.least[own].astype(kind), side="right")
            for other, n in zip(self.order[own].tolist(), looking.tolist(), strict=True):
                if not n:
                    break
                d = norms[:n] - 2 * (block[:n] @ c[other]) + lengths[other]
                closer = np.flatnonzero((d < best[:n]) | ((d == best[:n]) & (other < who[:n])))
                best[closer], who[closer] = d[closer], other
            cluster[rows], distance[rows] = who, best
        return cluster, distance


def _round(rows: DataFrame, scan: Scan, width: int, path: str) -> None:
    """Writes the rows with their new clusters, and each task's sums as rows without a vector."""
    id_type = rows.schema["vec_id"]
    schema = T.StructType([id_type, T.StructField("x", T.ArrayType(T.IntegerType())), T.StructField("cluster", T.IntegerType()), T.StructField("sums", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = np.zeros((len(scan.c), width + 1), np.int64), pa.null()
        for batch in batches:
            ids, lists = K.columns(batch, "vec_id"), K.columns(batch, "x")
            kind, x = ids.type, V.matrix(lists)
            if not len(x):
                continue
            cluster, _ = scan.assign(x, K.columns(batch, "cluster").to_numpy())
            V.add(x, cluster, total)
            yield pa.RecordBatch.from_arrays([ids, lists, pa.array(cluster, pa.int32()), pa.nulls(len(ids), pa.list_(pa.int64()))], names=schema.names)
        if len(used := np.flatnonzero(total[:, -1])):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(used), kind), pa.nulls(len(used), pa.list_(pa.int32())), pa.array(used, pa.int32()), V.lists(total[used], pa.int64())], names=schema.names)

    rows.mapInArrow(run, schema).write.parquet(path)


def _last(rows: DataFrame, scan: Scan, path: str) -> None:
    """Writes ids, clusters and distances, and each task's sums of distances by cluster as rows of their own."""
    total = T.StructField("total", T.DecimalType(38, 0))
    schema = T.StructType([rows.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), total])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, kind = np.zeros(len(scan.c), np.int64), np.zeros(len(scan.c), np.int64), pa.null()
        for batch in batches:
            ids, x = K.columns(batch, "vec_id"), V.matrix(K.columns(batch, "x"))
            kind = ids.type
            if not len(x):
                continue
            cluster, distance = scan.assign(x, K.columns(batch, "cluster").to_numpy())
            np.add.at(high, cluster, distance >> 32)
            np.add.at(low, cluster, distance & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance), pa.nulls(len(ids), pa.decimal128(38, 0))], names=schema.names)
        sums = [(i, (int(h) << 32) + int(l)) for i, (h, l) in enumerate(zip(high, low, strict=True)) if h or l]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(sums), kind), pa.array([i for i, _ in sums], pa.int32()), pa.nulls(len(sums), pa.int64()), pa.array([s for _, s in sums], pa.decimal128(38, 0))], names=schema.names)

    rows.mapInArrow(run, schema).write.parquet(path)


def _digest(components: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, components)).encode()).hexdigest()


def _long(n: int) -> int | None:
    return n if n < 1 << 63 else None


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, salt: str = SALT) -> DataFrame:
    """One row per kept vector: its cluster, squared distance, the sums of distances, and its centroid's digest."""
    spark = vectors.sparkSession
    kept = V.quantised(vectors, scale, width=width)
    hashed = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    centroids = [list(r.x) for r in kept.orderBy(hashed.asc_nulls_last(), "x").limit(k).select("x").collect()]
    rows, path = kept.select("vec_id", "x", F.lit(0).alias("cluster")), None
    for _ in range(rounds if centroids else 0):
        after = table_path(spark, "clusters")
        _round(rows, Scan(centroids), width, after)
        written = spark.read.parquet(after)
        for i, (*sums, n) in V.merged(written.where("sums is not null"), "cluster", "sums").items():
            centroids[i] = [s // n for s in sums]
        rows = written.where("sums is null").select("vec_id", "x", "cluster")
        if path:
            discard(spark, path)
        path = after
    if not centroids:
        return rows.select("vec_id", "cluster", *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    last = table_path(spark, "clusters")
    _last(rows, Scan(centroids), last)
    if path:
        discard(spark, path)
    written = spark.read.parquet(last)
    inertia = {i: int(s) for i, s in written.where("total is not null").groupBy("cluster").agg(F.sum("total")).collect()}
    whole = _long(sum(inertia.values()))
    of_cluster = spark.createDataFrame([(i, _long(inertia.get(i, 0)), whole, _digest(c)) for i, c in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = written.where("total is null").select("vec_id", "cluster", "distance")
    return found.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """The same rounds in DuckDB: distances to all centroids by inner products, exact in doubles for such components."""
    d = "list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x)"
    sql = [
        f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * CAST(e AS DOUBLE))) AS x FROM embeddings
WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {WIDTH})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT x, sha256('{SALT}' || vec_id) AS h FROM v ORDER BY h LIMIT {CLUSTERS}))",
    ]
    for r in range(ROUNDS + 1):
        sql.append(f"a{r} AS MATERIALIZED (SELECT v.vec_id, any_value(v.x) AS x, arg_min(c.c, ({d}, c.c)) AS c, min({d}) AS d FROM v, c{r} c GROUP BY v.vec_id)")
        if r < ROUNDS:
            sql.append(f"s{r} AS (SELECT c, i, floor(sum(x[i]) / count(*)) AS m FROM a{r}, range(1, {WIDTH + 1}) t(i) GROUP BY c, i)")
            sql.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(n.x, c{r}.x) AS x FROM c{r} LEFT JOIN (SELECT c, list(m ORDER BY i) AS x FROM s{r} GROUP BY c) n USING (c))")
    last = ROUNDS
    sql.append(f"g AS (SELECT c, sha256(array_to_string(list_transform(x, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS h FROM c{last})")
    return ",\n".join(sql) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{last} a JOIN g ON g.c = a.c"""
