"""Operator 12, vector code compression: product codebooks over integer vectors, trained on all of them.

Each round broadcasts the codebooks (parts * entries integer vectors, a fixed size). A task takes its vectors in Arrow batches and has all
distances of a part from |x|^2 - 2 x.c + |c|^2 with products in 64-bit integers (exact: what overflows on the way
cancels, since the distance itself fits); the first smallest wins. It returns one row of sums per part and entry; these are merged by a
grouped shuffle, and the driver gets a fixed number of sums.

Defined results: vectors that are null or hold null or non-finite components are left out, as are those whose length is no positive
multiple of `parts` or isn't that of the smallest kept id's vector (they have no code in these books); repeated rows are rows of their own; equal ids
start the books in the order of their vectors, null ids come last; with fewer vectors than entries the books are as small; an empty
table gives no rows; null labels are one label; extra columns are ignored. Components too large for a long distance fail
with a message; a label's sum that no long holds is null.
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
from noticeflow.llm.shared import keyed_join, table_path

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first nearest entry, squared distance) of integer vectors, by norm expansion."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)
    entry = d.argmin(1)
    return entry, d[np.arange(len(x)), entry]


def _trained(rows: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """books: parts x entries x components."""
    spark = rows.sparkSession
    parts, entries, width = books.shape
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts * entries, width + 1), np.int64)
            for batch in batches:
                x = V.matrix(K.columns(batch, "x"))
                for p in range(parts if len(x) else 0):
                    part = x[:, p * width : (p + 1) * width]
                    entry, _ = nearest(part, sent.value[p])
                    V.add(part, entry + p * entries, total)
            used = np.flatnonzero(total[:, -1])
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), V.lists(total[used], pa.int64())], names=["entry", "sums"])

        books = books.copy()
        for at, (*row, n) in V.merged(rows.select("x").mapInArrow(sums, "entry int, sums array<long>"), "entry", "sums").items():
            books[at // entries, at % entries] = [s // n for s in row]
        sent.unpersist()
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of quantised rows: an entry's index in each part as two hex digits."""
    parts, _, width = books.shape
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def code(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = V.matrix(K.columns(batch, "x"))
        entries, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
        for p in range(parts if len(x) else 0):
            entries[:, p], d = nearest(x[:, p * width : (p + 1) * width], sent.value[p])
            error += d
        yield pa.RecordBatch.from_arrays([K.columns(batch, "vec_id"), K.columns(batch, "label"), pa.array([row.tobytes().hex() for row in entries], pa.string()), pa.array(error)], names=schema.names)

    return rows.mapInArrow(K.mapped(code), schema)


def codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: its code, its error, its label's error, and the digest of all codebooks. At most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    rows = V.quantised(vectors, scale, multiple=parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(1).collect()
    if not first:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    rows = rows.where(F.size("x") == len(first[0].x))
    start = np.array([r.x for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()], np.int64)
    books = _trained(rows, np.stack(np.split(start, parts, axis=1)), rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    path = table_path(spark, "codes")
    key = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    encoded(rows, books).withColumn("_key", key).write.parquet(path)
    found = spark.read.parquet(path)
    labels = table_path(spark, "code-labels")
    found.groupBy("_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("n")).select("_key", F.expr("try_cast(sum as long)").alias("label_error"), "n").write.parquet(labels)
    return keyed_join(found.select("vec_id", "code", "error", "_key"), spark.read.parquet(labels), ["_key"], "n").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle() -> str:
    """The same rounds in DuckDB, a row per vector and part."""
    d = "list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x)"
    sql = [
        f"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda e: floor({SCALE} * CAST(e AS DOUBLE))) AS x FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding))""",
        f"p AS MATERIALIZED (SELECT vec_id, part, x[part * (len(x) // {PARTS}) + 1 : (part + 1) * (len(x) // {PARTS})] AS x FROM v, range({PARTS}) t(part))",
        f"b0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for r in range(ROUNDS + 1):
        sql.append(f"a{r} AS MATERIALIZED (SELECT p.vec_id, p.part, any_value(p.x) AS x, arg_min(b.entry, ({d}, b.entry)) AS entry, min({d}) AS d FROM p JOIN b{r} b ON b.part = p.part GROUP BY p.vec_id, p.part)")
        if r < ROUNDS:
            sql.append(f"s{r} AS (SELECT part, entry, i, floor(sum(x[i]) / count(*)) AS m FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY part, entry, i)")
            sql.append(f"b{r + 1} AS MATERIALIZED (SELECT b{r}.part, b{r}.entry, coalesce(n.x, b{r}.x) AS x FROM b{r} LEFT JOIN (SELECT part, entry, list(m ORDER BY i) AS x FROM s{r} GROUP BY part, entry) n USING (part, entry))")
    last = ROUNDS
    sql.append(f"h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS h FROM b{last})")
    sql.append(f"f AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY vec_id)")
    return ",\n".join(sql) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM f JOIN v USING (vec_id), h"
