"""Streams with timers against their batch folds, and the cases of deliveries, limits and timelines."""

import random

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import delivery, graph, linking
from noticeflow.streaming import deliveries

OPS = "event_id long, seq long, at long, action string, token long, good boolean, retryable boolean"


def log(spark, rows, until=10**9, **options):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], OPS)
    return [(r.seq, r.at, r.outcome, r.status, r.attempts) for r in sorted(delivery.delivery_log(df, until, **options).collect(), key=lambda r: (r.at, r.seq is not None, r.seq))]


def test_lease_fences_who_lost_it(spark):
    claim, done = lambda at, t: (at, "claim", t, None, None), lambda at, t, good=True: (at, "finish", t, good, True)
    got = log(spark, [claim(0, 7), claim(59, 8), claim(60, 9), done(61, 7), done(62, 9)])
    assert got == [(0, 0, "leased", "sending", 1), (1, 59, "not_due", "sending", 1), (None, 60, "lease_expired", "sending", 1), (2, 60, "leased", "sending", 2), (3, 61, "fenced", "sending", 2), (4, 62, "sent", "sent", 2)]
    # without another claim the late holder still ends its attempt
    assert [x[2] for x in log(spark, [claim(0, 7), done(300, 7)])] == ["leased", "lease_expired", "sent"]
    assert [x[2] for x in log(spark, [done(1, 7), (2, "cancel", None, None, None), claim(3, 1)])] == ["fenced", "cancelled", "already_cancelled"]


def test_three_attempts_then_dead(spark):
    rows, at = [], 0
    for i in range(3):
        rows += [(at, "claim", i, None, None), (at + 1, "finish", i, False, True)]
        at += 1 + 2 ** (i + 1)
    got = log(spark, rows + [(at + 5, "claim", 9, None, None)])
    assert [x[2] for x in got] == ["leased", "retry", "retry_due", "leased", "retry", "retry_due", "leased", "dead_lettered", "already_dead_lettered"]
    # leases that only run out use the attempts up, too
    assert [x[2] for x in log(spark, [(i * 60, "claim", i, None, None) for i in range(4)])][-1] == "dead_lettered"
    assert [x[2] for x in log(spark, [(0, "claim", 1, None, None), (1, "finish", 1, False, False)])] == ["leased", "dead_lettered"]
    assert log(spark, [(0, "claim", 1, None, None)], until=59) == [(0, 0, "leased", "sending", 1)]


def random_ops(seed, n):
    r, out, tokens = random.Random(seed), [], {}
    for i in range(n):
        event, at = r.randrange(6), 10 * i + 3
        action = r.choice(["claim", "claim", "finish", "finish", "cancel"] if r.random() < 0.1 else ["claim", "finish"])
        if action == "claim":
            tokens[event] = i
        out.append((event, i, at, action, i if action == "claim" else r.choice([tokens.get(event), tokens.get(event), 0]), r.random() < 0.1, r.random() < 0.9))
    return out


@pytest.fixture()
def timed(spark):
    was = spark.conf.get(deliveries.STATE_STORE[0])
    spark.conf.set(*deliveries.STATE_STORE)
    yield spark
    spark.conf.set(deliveries.STATE_STORE[0], was)


def through(spark, tmp_path, df, batches, stream):
    """What a stream returns for rows that come in so many batches, in order of seq, and its last progress."""
    rows = df.withColumn("at", F.timestamp_seconds("at"))
    n = df.count()
    for b in range(batches):
        rows.where((F.col("seq") >= b * n // batches) & (F.col("seq") < (b + 1) * n // batches)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    progress = q.lastProgress
    q.stop()
    return spark.read.parquet(str(tmp_path / "out")), progress


@pytest.mark.parametrize("batches", [1, 5])
def test_delivery_stream_equals_the_fold(timed, tmp_path, batches):
    spark = timed
    ops = random_ops(4, 120)
    df = spark.createDataFrame(ops, OPS)
    got, _ = through(spark, tmp_path, df, batches, lambda s: deliveries.delivery_stream(s, lease_s=45, backoff_s=20))
    last = max(o[2] for o in ops)
    want = delivery.delivery_log(df, last, lease_s=45, backoff_s=20)
    key = lambda r: (r.event_id, r.at, r.seq is not None, r.seq or 0)
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    # a timer at the very watermark may still wait for a later row
    assert [tuple(r) for r in got if r.at < last] == [tuple(r) for r in want if r.at < last]
    assert sum(r.seq is None for r in got) > 10 and {r.outcome for r in got} >= {"leased", "fenced", "retry", "lease_expired", "retry_due"}


def test_limit_stream_equals_the_fold_and_forgets(timed, tmp_path):
    spark = timed
    r = random.Random(2)
    hits = [(r.choice("ab"), r.randrange(3), i, 1000 + 7 * i) for i in range(90)] + [("z", 9, 90, 10_000), ("z", 9, 91, 20_000)]
    df = spark.createDataFrame(hits, "scope string, actor long, seq long, at long")
    got, progress = through(spark, tmp_path, df, 4, lambda s: deliveries.limit_stream(s, 2))
    want = delivery.limited(df, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {x.allowed for x in want.collect()} == {True, False}
    assert progress.stateOperators[0].numRowsTotal <= 4  # the last window's variables and timer alone


def test_queue_takes_a_job_once(spark, tmp_path):
    jobs = [(f"k{i % 7}", i, i) for i in range(40)]
    df = spark.createDataFrame(jobs, "job_key string, seq long, at long")
    got, _ = through(spark, tmp_path, df, 4, lambda s: deliveries.queued_once(s))
    assert sorted(x.job_key for x in got.collect()) == [f"k{i}" for i in range(7)]


def plain_components(edges, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    r = random.Random(kind)
    names = r.sample(range(1000), 120)
    edges = {"path": list(zip(names, names[1:])), "star": [(names[0], n) for n in names], "random": [(r.choice(names), r.choice(names)) for _ in range(70)], "none": []}[kind] + [(None, names[0]), (names[3], None), (names[5], names[5])]
    df = spark.createDataFrame(edges * 2, "a long, b long")
    nodes = spark.createDataFrame([(n,) for n in [*names, names[0], None]], "node long")
    assert {x.node: x.root for x in graph.components(df, nodes).collect()} == plain_components(edges, names)


def test_timelines_over_the_limit_are_not_shown(spark):
    links = [(i, 1, i + 1, "active", i) for i in range(1, 4)] + [(10, 20, 21, "active", 1), (11, 21, 3, "retracted", 5), (12, 30, 31, "retracted", 6)]
    df = spark.createDataFrame(links, "link_id long, child long, parent long, status string, created_at long")
    placed = linking.timelines(df, spark.createDataFrame([(99,)], "node long"), most=3)
    assert {(x.node, x.timeline, x["size"], x.shown) for x in placed.collect()} == {(n, 1, 4, False) for n in range(1, 5)} | {(20, 20, 2, True), (21, 20, 2, True), (30, 30, 1, True), (31, 31, 1, True), (99, 99, 1, True)}
    assert sorted(map(tuple, linking.timeline_links(df, placed).collect())) == [(20, "active", 1, 10), (20, "historical", 1, 11), (30, "historical", 1, 12), (31, "historical", 1, 12)]
