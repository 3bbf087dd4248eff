"""Operator 8, token counts through a digest cache.

A text's key is the SHA-256 of its content (null counts as empty) beside the SHA-256 of the tokenizer's file. The
distinct keys of the rows, without any text, are joined with the cache table first. Only texts whose keys it lacks
travel, once per task that holds them, are encoded once each and appended to it; every row then joins its count.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows and ids each keep their row;
an empty table gives no rows; extra columns are ignored.
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
from noticeflow.llm.pieces import encoder
from noticeflow.llm.shared import checkpoint_dir, cut, keyed_join, only

#: Missing digests (32 bytes each) up to which all tasks hold them, to send on no other text.
FILTER_DIGESTS = 500_000
CACHE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with their text's digest."""
    return docs.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))


def missing(wanted: DataFrame, cache: str, version: str) -> DataFrame:
    """Of the digests in `wanted`, those that the cache table lacks for this tokenizer."""
    spark = wanted.sparkSession
    return wanted.join(read_cache(spark, cache, version), "digest", "left_anti") if _exists(spark, cache) else wanted


def fill_cache(docs: DataFrame, misses: DataFrame, cache: str, tokenizer_path: str, *, fold: bool = False) -> None:
    """Encodes the distinct texts of `docs` (digest, text) whose digests are in `misses`, and appends their counts."""
    spark, version = docs.sparkSession, file_digest(tokenizer_path)
    number = misses.count()
    if not number:
        return
    few = spark.sparkContext.broadcast({bytes(r[0]) for r in misses.select("digest").toLocalIterator()}) if number <= FILTER_DIGESTS else None

    def first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            digests = K.columns(batch, "digest").to_pylist()
            take = [i for i, d in enumerate(digests) if (few is None or d in few.value) and not (d in seen or seen.add(d))]
            if len(seen) > 2_000_000:  # bounds memory only: a text may then be sent once more
                seen.clear()
            if take:
                yield batch if len(take) == len(digests) else batch.take(pa.array(take))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer_path, fold, False)
        seen: set[bytes] = set()  # digests of this shuffle partition, 32 bytes each
        for batch in batches:
            digests = K.columns(batch, "digest").to_pylist()
            take = [i for i, d in enumerate(digests) if not (d in seen or seen.add(d))]
            if not take:
                continue
            batch = batch.take(pa.array(take))
            sizes, tokens = [], []
            for _, _, data, offsets in K.blocks(K.columns(batch, "text")):
                sizes.append(np.diff(offsets))
                tokens.append(count.counts(data, offsets))
            arrays = [K.columns(batch, "digest"), pa.array([version] * len(take)), pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(np.concatenate(tokens).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["digest", "tokenizer", "n_bytes", "n_tokens"])

    texts = docs.select("digest", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(first_seen, "digest binary, text string")
    # the join by digest and the encoding share one shuffle
    texts = texts.repartition("digest") if few is not None else texts.join(misses.hint("shuffle_hash"), "digest", "left_semi")
    texts.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)


def read_cache(spark, cache: str, version: str) -> DataFrame:
    """The counts for one tokenizer; a digest that two runs appended counts once."""
    return spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, *, cache: str | None = None, limit: int = 1024, fold: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cached (whether the count stood in the cache before) per row.

    cache: the folder of the cache table; if not given, one in the shared folder that later calls find again.
    """
    spark, version = docs.sparkSession, file_digest(tokenizer_path)
    cache = cache or f"{checkpoint_dir(spark).rstrip('/')}/token-cache"
    rows = keyed(only(docs, "doc_id", "text"))
    wanted = cut(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("_rows")))
    misses = cut(missing(wanted.select("digest"), cache, version))
    fill_cache(rows, misses, cache, tokenizer_path, fold=fold)
    if not _exists(spark, cache):  # no rows and no cache yet
        spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    found = wanted.join(read_cache(spark, cache, version), "digest").join(misses.withColumn("cached", F.lit(False)), "digest", "left")
    side = cut(found.select("digest", "_rows", "n_bytes", "n_tokens", F.coalesce("cached", F.lit(True)).alias("cached")))
    return keyed_join(rows.select("doc_id", "digest"), side, ["digest"], "_rows").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cached")
