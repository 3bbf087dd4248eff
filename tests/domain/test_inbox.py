"""Edge cases of the inbox, worker and attachment rules."""

from pyspark.sql import functions as F

from noticeflow.operators import inbox


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_file_names(spark):
    names = {"a/b\\c d.pdf": "c_d.pdf", "...": "attachment", "x/": "attachment", "공고 문서(1).hwp": "공고_문서(1).hwp", "_a_.": "a"}
    for given, wanted in names.items():
        assert one(spark, inbox.file_name(F.lit(given))) == wanted
    assert len(one(spark, inbox.file_name(F.lit("a" * 300)))) == 255
    assert one(spark, inbox.file_name(F.lit(None).cast("string"))) is None


def test_heartbeat_takes_the_last_and_needs_all(spark):
    full = "j_complete=1 j_failed=2 j_retried=3 j_ongoing=4 j_complete=9"
    assert tuple(one(spark, inbox.heartbeat(F.lit(full)))) == (9, 2, 3, 4)
    assert one(spark, inbox.heartbeat(F.lit("j_complete=1 j_failed=2 j_retried=3"))) is None
    assert one(spark, inbox.heartbeat(F.lit(None).cast("string"))) is None


def test_pages(spark):
    assert one(spark, inbox.split_pages(F.lit(" a \fb\f \n"), F.lit(2))) == ["a", "b"]
    assert one(spark, inbox.split_pages(F.lit("a\f\fb"), F.lit(3))) == ["a", "", "b"]
    assert one(spark, inbox.split_pages(F.lit("a\fb"), F.lit(3))) is None
    assert one(spark, inbox.split_pages(F.lit(""), F.lit(0))) == []


def test_errors(spark):
    assert one(spark, inbox.public_error(F.lit("ReadTimeout"))) == "ReadTimeout"
    assert one(spark, inbox.public_error(F.lit("KeyError"))) == "ProcessingError"
    assert one(spark, inbox.public_error(F.lit(None).cast("string"))) == "ProcessingError"


def test_page_append_keeps_what_is_there(spark):
    have = spark.createDataFrame([(1, "old"), (2, "old")], "id long, v string")
    page = spark.createDataFrame([("new", 2), ("new", 3), ("new", 3)], "v string, id long")
    assert sorted(map(tuple, inbox.append_page(have, page).collect())) == [(1, "old"), (2, "old"), (3, "new")]


def test_currency_buckets_with_null_currency(spark):
    rows = spark.createDataFrame([(1, "EUR", None), (2, None, 5.0), (3, "EUR", 1.0), (4, None, 7.0)], "pos long, currency string, amount double")
    assert {r["pos"]: r["bucket"] for r in inbox.currency_buckets(rows, "pos").collect()} == {1: None, 2: 2, 3: 3, 4: 2}


def test_due_and_latest_run(spark):
    events = spark.createDataFrame([(1, "pending", 5), (2, "sending", None), (3, "sent", None), (4, "pending", 9), (5, "pending", 5)], "id long, status string, next_attempt_at long")
    assert [r["id"] for r in inbox.due(events, F.lit(6)).collect()] == [2, 1, 5]
    runs = spark.createDataFrame([("a", "success", 3, 1), ("a", "success", 3, 2), ("a", "failed", 9, 3), ("b", "failed", 1, 4)], "source string, status string, finished_at long, id long")
    assert list(map(tuple, inbox.latest_success(runs, "source", "status", "finished_at", "id").collect())) == [("a", 3, 2)]


def test_daily_epoch_is_the_utc_day_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Seoul")
        df = spark.sql("SELECT timestamp'2026-09-01T20:00:00Z' AS a, timestamp'1969-12-31T23:30:00Z' AS b, timestamp_ntz'2026-09-01 23:59:59' AS c, 'open' AS s")
        got = df.select(*(inbox.daily_epoch(F.col(x), F.col("s")).alias(x) for x in "abc")).first()
        assert tuple(got) == ("daily:2026-09-01:open", "daily:1969-12-31:open", "daily:2026-09-01:open")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
