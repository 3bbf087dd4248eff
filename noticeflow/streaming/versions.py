"""Streams (2.T): the version fold with per-key state, idempotent ingest per micro-batch, and tumbling counters.

The fold's watermark belongs to each key and never drops a row, so Spark's own (global, dropping) watermark is not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "canonical_key long, obs_seq long, is_new boolean, version_number long, transition_kind string, watermark long, current_state string"
STATE = "watermark long, current_state string, versions long"


def fold_stream(obs: DataFrame) -> DataFrame:
    """D3 on a stream of (canonical_key, obs_seq, effective_at, state_hash): the same rows as the batch fold.

    State per key is three values; rows of a micro-batch are taken in obs_seq order.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, current, versions = state.get if state.exists else (None, None, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values("obs_seq")
        for seq, at, value in zip(rows["obs_seq"].tolist(), rows["effective_at"].tolist(), rows["state_hash"].tolist()):
            lead, new, first = mark is None or at >= mark, current is None or value != current, current is None
            versions += new
            kind = None if not new else "initial" if first else "current" if lead else "historical"
            if lead:
                mark, current = at, value
            out.append((key[0], seq, new, versions if new else None, kind, mark, current))
        state.update((mark, current, versions))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({"version_number": "Int64"})

    return obs.groupBy("canonical_key").applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def append_new(batch: DataFrame, path: str, keys: list[str], order: str) -> None:
    """S6/D1 as a foreachBatch sink: rows whose keys the table lacks, once each; running a batch again adds nothing."""
    from noticeflow.operators.versions import ingest

    spark = batch.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    have = spark.read.schema(batch.schema).parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None
    ingest(batch, keys, order, existing=have).write.mode("append").parquet(path)


def daily_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", late: str = "1 day") -> DataFrame:
    """Tumbling day windows per kind; a day closes when the stream is `late` beyond it."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), kind, "n")
