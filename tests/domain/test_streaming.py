"""The streams against the batch operators."""

from pyspark.sql import functions as F

from noticeflow.operators import versions
from noticeflow.plans.adapters import observations
from noticeflow.streaming import versions as streams

SF = "/root/testdata/sf0.001"


def test_fold_stream_equals_batch(spark, tmp_path):
    obs = observations(spark, SF).select("canonical_key", "obs_seq", "effective_at", "state_hash").where("canonical_key < 10")
    for i in range(3):
        obs.where((F.col("obs_seq") >= i * 400) & (F.col("obs_seq") < (i + 1) * 400)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.fold_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    names = [c.split()[0] for c in streams.OUTPUT.split(", ")]
    got = spark.read.parquet(str(tmp_path / "out")).select(names)
    want = versions.version_fold(obs).select(names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20


def test_append_new_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "seq long, k string")
    for _ in range(2):
        streams.append_new(rows, str(tmp_path / "t"), ["k"], "seq")
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (3, "b")]


def test_feed_source(spark, tmp_path):
    from noticeflow.sources import feed

    feed.register(spark)
    rows = spark.read.format("noticefeed").load()
    assert [r.source_record_id for r in rows.orderBy("obs_seq").collect()] == [r[0] for r in feed.MockFeed.records]
    assert rows.sparkSession.read.format("noticefeed").option("cursor", 4).load().count() == 2
    q = spark.readStream.format("noticefeed").load().writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.obs_seq for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [0, 1, 2, 3, 4, 5]


def test_daily_counts(spark, tmp_path):
    spark.createDataFrame([("2026-01-01 10:00:00", "a"), ("2026-01-01 11:00:00", "a"), ("2026-01-02 10:00:00", "b"), ("2026-01-09 10:00:00", "b")], "ts string, event_type string").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    q = streams.daily_counts(stream).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.day.day, r.event_type, r.n) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {(1, "a", 2), (2, "b", 1)}
