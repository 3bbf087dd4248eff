"""Windowed feeds that stop anywhere, stores that tasks write twice, pages of eligible rows, and the semantic step."""

import difflib
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import linking, views
from noticeflow.sources import blobs, windows

FEED = "tests.domain.window_feed:Archive"


@pytest.fixture()
def archive(tmp_path):
    at = lambda d, h: f"203105{d:02d}{h:02d}00"
    items = [{"n": n, "published": at(1, n), "changed": at(1, 20) if n % 4 == 0 else None} for n in range(8)] + [{"n": 20 + n, "published": at(2, 2 + n), "changed": at(2, 9)} for n in range(4)]
    (tmp_path / "items").write_text("\n".join(map(json.dumps, items)))
    (tmp_path / "now").write_text(at(1, 22))
    return tmp_path


def poll(spark, archive, pages, batches=None):
    """Runs the stream until it has caught up (or for so many batches); its rows in order of arrival stay in the folder `out`."""
    source = spark.readStream.format("noticewindows").option("feed", FEED).option("archive", str(archive)).option("pages", pages).option("size", 3).load()
    q = source.writeStream.format("parquet").option("path", str(archive / "out")).option("checkpointLocation", str(archive / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.parquet(str(archive / "out"))


def test_windows_walk_both_modes_and_resume(spark, archive):
    blobs.register(spark)
    first = poll(spark, archive, 1).collect()
    assert sorted(r.source_record_id for r in first if r.mode == "1") == sorted(f"services:{n}" for n in range(8))
    assert sorted(r.source_record_id for r in first if r.mode == "3") == ["services:0", "services:4"]
    # a day later, with another budget: the next window repeats an hour, ingest takes each payload once
    (archive / "now").write_text("203105022200")
    every = poll(spark, archive, 100)
    assert every.select("source_record_id").distinct().count() == 12
    asked = (archive / "asked").read_text().split("\n")
    assert "1 203105012100 1" in asked and "3 203105012100 1" in asked
    n = every.count()
    assert poll(spark, archive, 2).count() == n  # caught up: nothing is asked again but the same pages


def test_a_page_that_fails_is_asked_again(spark, archive):
    blobs.register(spark)
    for trouble in ("short", "down"):
        (archive / trouble).touch()
        with pytest.raises(Exception, match="totals|down"):
            poll(spark, archive, 1)
        (archive / trouble).unlink()
    rows = poll(spark, archive, 1)
    assert sorted(r.source_record_id for r in rows.where("mode = '1'").collect()) == sorted(f"services:{n}" for n in range(8))


def test_cursors():
    at = windows.Cursor("203105010000", "203105020000", "3", 4)
    assert windows.cursor_of(at.text()) == at
    good = at._asdict()
    for wrong in ("x", "[]", {"mode": "2"}, {"page": 0}, {"page": True}, {"page": "1"}, {"start": "2031"}, {"start": "203199990000"}, {"end": "203104010000"}, {"end": "203107010000"}):
        with pytest.raises(ValueError, match="cursor"):
            windows.cursor_of(wrong if isinstance(wrong, str) else json.dumps(good | wrong))
    answer = lambda **x: {"pageNo": 4, "numOfRows": 2, "totalCount": "8", "items": [1, 2]} | x
    assert windows.after_page(at, answer(), 2) == at._replace(mode="done", page=1)
    assert windows.after_page(at, answer(totalCount=9), 2).page == 5 and windows.after_page(at._replace(mode="1"), answer(), 2) == at._replace(mode="3", page=1)
    for wrong in ({"items": [1]}, {"items": None}, {"pageNo": 3}, {"numOfRows": 3}, {"totalCount": -1}, {"totalCount": True}, {"totalCount": "7"}):
        with pytest.raises(ValueError):
            windows.after_page(at, answer(**wrong), 2)


def stored(folder):
    return {p.name: p.read_bytes() for p in folder.glob("??/*") if not p.parent.name.startswith("_")}


def test_each_blob_once(spark, tmp_path):
    blobs.register(spark)
    texts = [f"text {i % 5}" for i in range(20)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string").repartition(4)
    put = lambda rows: rows.write.format("noticeblobs").option("path", str(tmp_path / "s")).mode("append").save()

    # a run whose last task breaks has left some blobs, all of them whole
    broken = df.unionByName(spark.createDataFrame([(99, "never")], "id long, content string").select("id", F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise("x").alias("content")))
    with pytest.raises(Exception, match="broken"):
        put(broken)
    for _ in range(2):
        put(df)
    want = {hashlib.sha256(t.encode()).hexdigest(): t.encode() for t in texts if t is not None}
    assert stored(tmp_path / "s") == want
    runs = [json.loads(p.read_text()) for p in (tmp_path / "s" / "_runs").iterdir()]
    assert sum(r["new"] for r in runs) <= 2 * len(want) and min(r["new"] for r in runs) == 0
    with pytest.raises(Exception, match="stays"):
        df.write.format("noticeblobs").option("path", str(tmp_path / "s")).mode("overwrite").save()


def test_receipts_of_a_stream_are_idempotent(spark, tmp_path):
    blobs.register(spark)
    df = spark.createDataFrame([(f"k{i % 3}", i % 3) for i in range(9)], "dedupe_key string, event long")
    df.write.parquet(str(tmp_path / "in"))
    for c in ("c1", "c2"):  # a second stream repeats what the first has sent
        q = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).writeStream.format("noticereceipts").option("path", str(tmp_path / "r")).option("checkpointLocation", str(tmp_path / c)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(json.loads(b)["event"] for b in stored(tmp_path / "r").values()) == [0, 1, 2]


def test_cursor_walk_over_eligible_pages_is_one_filtered_sort(spark, monkeypatch):
    monkeypatch.setattr(views, "BATCH", 7)
    rows = [(i, None if i % 29 == 0 else f"2031-01-{i % 20 + 1:02d} 00:00:00", i % 6 == 0 and not 30 < i < 90) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, t string, good boolean").select("id", F.col("t").cast("timestamp_ntz").alias("published_at"), "good")
    decide = lambda d: d.withColumn("eligible", F.when(F.col("good"), True))
    got, after, pages = [], None, 0
    while True:
        page = [r.id for r in views.eligible_page(df, decide, 4, after=after).collect()]
        at = views.eligible_cursor(df, decide, 4, after=after).first()
        got += page
        pages += 1
        assert len(page) <= 4
        if at is None:
            break
        after = (str(at["at"]), at["id"])
    want = [r[0] for r in sorted((r for r in rows if r[2]), key=lambda r: (r[1] or "1970", r[0]), reverse=True)]
    assert got == want and pages >= len(want) // 4


NODE = "id long, source_id long, record_id string, stage string, title string, buyer string, amount decimal(18,2), published_at timestamp_ntz, references array<struct<source_id: long, record_id: string, stage: string>>, identifiers array<struct<scheme: string, value: string>>"


def semantic(spark, rows, score, **options):
    nodes = spark.createDataFrame([(i, s, str(i), stage, title, None, None, None, None, None) for i, s, stage, title in rows], NODE)
    found = linking.semantic_links(nodes, linking.links(nodes, fuzzy=False), score, **options)
    return {r.child: (r.parent, r.method, r.confidence and str(r.confidence), r.unresolved) for r in found.collect()}


def test_semantic_step(spark):
    rows = [(1, 1, "tender", "pier a"), (2, 1, "tender", "pier b"), (3, 1, "award", "pier a"), (4, 1, "award", "pier c"), (5, 2, "award", "pier a"), (6, 1, "odd", "pier a"), (7, 1, "contract", "pier a")]
    got = semantic(spark, rows, lambda a, b: F.when(a["title"] == b["title"], 0.96).otherwise(0.94))
    none = (None, None, None, "no_conservative_match")
    assert got == {1: none, 2: none, 3: (1, "semantic", "0.9600", None), 4: none, 5: none, 6: none, 7: (None, None, None, "ambiguous_semantic")}
    # scores outside 0 to 1, null and not finite don't count
    odd = lambda a, b: F.when(a["id"] == 1, 7.0).when(a["id"] == 2, F.lit("NaN").cast("double"))
    assert semantic(spark, rows[:3], odd)[3] == none
    assert semantic(spark, rows[:3], lambda a, b: F.lit(None).cast("double"))[3] == none


def test_only_the_first_candidates_are_compared(spark):
    rows = [(i, 1, "tender", f"t{i}") for i in range(1, 31)] + [(50, 1, "award", "t25"), (51, 1, "award", "t20"), (52, 1, "contract", "t3")]
    got = semantic(spark, rows, lambda a, b: F.when(a["title"] == b["title"], 1.0).otherwise(0.0))
    assert got[50][3] == "no_conservative_match" and got[51][:2] == (20, "semantic") and got[52][:2] == (3, "semantic")


def test_fuzzy_query_is_difflib(spark):
    """The ladder's ratio, in its order of arguments, on titles that share buyer and amount."""
    titles = ["Harbour lights renewal", "Harbour light renewal", "Harbour lights renewals 2", "renewal of lights", "", "Harbor lights renewal"]
    pairs = [(a, b) for a in titles for b in titles]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(r.a, r.b): r.x for r in df.select("a", "b", linking.title_ratio(F.col("a"), F.col("b")).alias("x")).collect()}
    assert got == {p: difflib.SequenceMatcher(None, *p).ratio() for p in pairs}


def test_comparator_as_a_table_function(spark):
    spark.udtf.register("compare_titles", linking.CompareTitles)
    got = spark.sql("SELECT n.id, c.candidate, c.score FROM VALUES (9, 'pier a') AS n(id, title), LATERAL compare_titles(n.title, array(named_struct('id', 1L, 'title', 'pier a'), named_struct('id', 2L, 'title', 'sea'))) AS c").collect()
    assert [(r.candidate, r.score) for r in got] == [(1, 1.0), (2, difflib.SequenceMatcher(None, "sea", "pier a").ratio())]
