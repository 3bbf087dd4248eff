"""Operator 10: exact round trip against brute force."""

import base64
import hashlib

from noticeflow.llm import queries, warc


def brute(pages, least=0):
    bodies = [(p, (h or "").encode()) for p, _, h in pages]
    first = {}
    for p, b in bodies:
        have = first.get(b)
        first[b] = p if have is None or p is not None and p < have else have
    out = []
    for p, b in bodies:
        shared = sum(x == b for _, x in bodies) > 1 and len(b) >= least
        revisit = shared and first[b] != p
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[b] if revisit else None, True))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


PAGES = [(5, "http://a/é b\r\nX: y", "<p>one</p>"), (3, None, "<p>one</p>"), (9, "u", "<p>one</p>"), (7, "u", None), (6, "u", ""), (1, "u", "ü" * 5000), (2, "u", "\r\n\r\nHTTP/1.1\r\n\r\nWARC/1.1\r\n\r\n"), (4, "u", "solo"), (4, "u", "solo"), (None, "u", "<p>one</p>"), (None, "v", "only null"), (None, "w", "only null")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as first", "2 as record", "3 as payload_digest").repartition(3)
    for i, options in enumerate(({}, {"chunk_bytes": 7}, {"chunk_bytes": 64, "least_bytes": 5})):
        assert rows(warc.round_trip(df, path=str(tmp_path / f"t{i}"), **options)) == brute(PAGES, options.get("least_bytes", 0))
    assert spark.read.parquet(str(tmp_path / "t1")).selectExpr("max(length(data))").first()[0] == 7
    assert warc.round_trip(df.limit(0)).count() == 0
    files = warc.export_warc(spark, str(tmp_path / "t2"), str(tmp_path / "files"))
    data = b"".join(open(f, "rb").read() for f in files)
    assert data.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES) and data.count("ü".encode() * 5000) == 1


def test_appends_and_long_payloads(spark, tmp_path):
    frame = lambda pages: spark.createDataFrame(pages, "page_id long, url string, html string")
    long_ = [(50, "u", "é" * 700_000 + "end"), (51, "u", "y" * 300_000)]
    path = str(tmp_path / "t")
    warc.write_archive(frame(PAGES[:3]).coalesce(1), path)
    warc.write_archive(frame(PAGES[5:8]).coalesce(1), path)
    warc.write_archive(frame(long_).coalesce(1), path, chunk_bytes=100_001)
    got = rows(warc.read_archive(spark, path).drop("url"))
    assert got == sorted(brute(PAGES[:3]) + brute(PAGES[5:8]) + brute(long_), key=str)
    files = warc.export_warc(spark, path, str(tmp_path / "files"))
    assert len(files) == 3 and b"".join(open(f, "rb").read() for f in files).count("é".encode() * 700_000 + b"end\r\n\r\n") == 1


def test_damage_is_seen(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:1] + PAGES[5:6], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "t"), chunk_bytes=1000)
    table = spark.read.parquet(str(tmp_path / "t"))
    table.where("chunk_no <> 3").write.parquet(str(tmp_path / "missing"))
    assert {r.page_id: r.intact for r in warc.read_archive(spark, str(tmp_path / "missing")).collect()} == {5: True, 1: False}


def test_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = [tuple(r) for r in queries.table(spark, sf, "pages").select("page_id", "url", "html").collect()]
    assert rows(queries.op10_warc(spark, sf)) == brute(pages)
