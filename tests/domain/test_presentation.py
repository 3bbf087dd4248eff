"""Government notices, and what lists and pages show: edges beside the twins."""

import hashlib
import json

from pyspark.sql import functions as F

from noticeflow.operators import government, presentation


def mapped(spark, *payloads):
    df = spark.createDataFrame([(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "i long, payload string")
    return government.map_notices(df).orderBy("i").collect()


def test_notices(spark):
    full = {"bidNtceNo": "R31-7", "bidNtceOrd": "001", "bidNtceNm": " Pier ", "dminsttNm": "", "ntceInsttNm": "Port", "presmptPrce": "0012.50", "bidNtceDt": "2031-05-06 00:30:00", "rgstDt": "2031-05-05 00:00:00", "ntceKindNm": "변경공고 ", **{f"ntceSpecDocUrl{i}": f"u{i}" for i in range(0, 13)}, "ntceSpecFileNm2": "two.hwp"}
    a, b, c, d = mapped(spark, full, {"bidNtceNo": "x y", "bidNtceOrd": "1", "presmptPrce": "NaN", "bidClseDt": "2031-02-30 00:00:00", "chgDt": "soon", "ntceKindNm": "재변경공고"}, "{", None)
    assert (a.official_id, a.title, a.buyer_name, a.lifecycle_stage, a.estimated_amount, a.errors) == ("services:R31-7:001", "Pier", "Port", "amendment", "12.5", [])
    assert [x.filename for x in a.attachments] == ["specification-1", "two.hwp", *(f"specification-{i}" for i in range(3, 11))]
    assert a.attachments[0].attachment_id == hashlib.sha256(b"u1").hexdigest()
    assert {k: v.json_pointer for k, v in a.evidence.items()} == {"title": "/bidNtceNm", "buyer_name": "/ntceInsttNm", "estimated_amount": "/presmptPrce", "currency": "/presmptPrce", "published_at": "/bidNtceDt", "status": "/ntceKindNm"}
    seconds = spark.sql("SELECT unix_seconds(timestamp'2031-05-04T15:00:00Z') AS x").first()["x"]
    assert int(a.effective_at.timestamp()) == seconds and a.closes_at is None
    assert (b.official_id, b.lifecycle_stage, b.errors) == (None, "tender", ["identity_invalid", "closes_at_invalid", "effective_at_invalid", "estimated_amount_invalid"])
    assert "identity_invalid" in c.errors and d.errors[0] == "payload_invalid"


def test_incomplete_entries(spark):
    df = spark.sql("SELECT * FROM VALUES (array(named_struct('s', 'a', 'v', 'b')), false), (array(named_struct('s', 'a', 'v', ' ')), true), (array(named_struct('s', null, 'v', 'b')), true), (array(), false), (null, false) AS t(x, want)")
    assert all(r.got == r.want for r in df.select(government.incomplete(F.col("x"), ("s", "v")).alias("got"), "want").collect())


def test_views(spark):
    rows = [(1, "tender", "ready", True, [], []), (2, "amendment", "ready", True, [], ["w"]), (3, "tender", "ready", False, ["h"], ["w"]), (4, "tender", "ready", False, [], []), (5, "tender", "ready", None, None, None), (6, "amendment", "future_version", True, [], []), (7, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, stage string, status string, eligible boolean, hard array<string>, warnings array<string>")
    args = [F.col(c) for c in ("stage", "status", "eligible", "hard", "warnings")]
    got = {v: [r.id for r in df.where(presentation.in_view(v, *args)).orderBy("id").collect()] for v in presentation.VIEWS}
    assert got == {"all": [1, 2, 3, 4, 5, 6, 7], "strict": [1], "review": [2, 4, 5, 6, 7], "amendment": [2, 6]}
    tones = [r.x.tone for r in df.select(presentation.label(*args[1:]).alias("x"), "id").orderBy("id").collect()]
    assert tones == ["success", "pending", "danger", "neutral", "pending", "pending", "pending"]


def test_rows_of_json(spark):
    df = spark.createDataFrame([(1, '{"a": {"before": 1, "after": {"x": 2}}, "b": {"added": ["p"]}, "c": 3}', '{"t": [{"quote": "q", "page": 2}, {"source": "s"}], "u": {"sha256": "h", "page_number": 1}}'), (2, None, None), (3, "[]", "x")], "k long, d string, e string")
    assert sorted(map(tuple, presentation.delta_rows(df, "k", "d").collect())) == [(1, "a", "1", '{"x":2}'), (1, "b", None, '["p"]'), (1, "c", None, None)]
    assert sorted(map(tuple, presentation.evidence_rows(df, "k", "e").collect()), key=str) == [(1, "t", "q", "2", None, None), (1, "t", None, None, None, "s"), (1, "u", None, "1", "h", None)]


def test_small_predicates(spark):
    df = spark.sql("SELECT map('title', 'a', 'award_price', 'b') AS m, '{\"raw_record_id\": \"7\"}' AS p, CAST(null AS int) AS g, 7L AS r")
    got = df.select(presentation.features_only(F.col("m")).alias("f"), presentation.names_record(F.col("p"), F.col("r")).alias("n"), presentation.names_record(F.lit("{}"), F.col("r")).alias("no"), presentation.same_generation(F.col("g"), F.lit(None)).alias("s"), presentation.same_generation(F.col("g"), F.lit(1)).alias("d")).first()
    assert tuple(got) == ({"title": "a"}, True, False, True, False)
    items = spark.createDataFrame([(1, 10)], "opportunity_id long, current_version_id long")
    versions = spark.createDataFrame([(10, 100), (11, 100)], "version_id long, raw_record_id long")
    events = spark.createDataFrame([(5, 1), (6, 2)], "event_id long, opportunity_id long")
    raw = spark.createDataFrame([(100, "x")], "raw_record_id long, payload string")
    assert [(r.event_id, r.version_id, r.payload) for r in presentation.notification_sources(events, items, versions, raw).collect()] == [(5, 10, "x")]
    watches = spark.createDataFrame([("u", 1, 3), ("u", 9, 3)], "user_id string, opportunity_id long, created_at long")
    assert [(r.user_id, r.current_version_id) for r in presentation.watched(items, watches).collect()] == [("u", 10)]
