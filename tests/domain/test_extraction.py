"""Labelled claims and their validation, on notices of a town that doesn't exist. The registered queries have twins of their own."""

import json
import re

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import documents, extraction


def read(spark, *texts):
    """Per text its quotes: (line, quote, field, value, qualified)."""
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, page_number int, text string")
    out = [[] for _ in texts]
    for r in extraction.page_quotes(df).collect():
        out[r.doc_id].append((r.line, r.quote, r.field, r.value, r.qualified))
    return [sorted(x, key=str) for x in out]


def claims(spark, *texts):
    return [{f: v for _, _, f, v, q in x if f and not q} for x in read(spark, *texts)]


def test_labels(spark):
    lines = ["Title: Harbour lights", "  Title :Harbour lights ", "Title：Harbour lights", "□ Title: Harbour lights", "나) 공  고  명: Harbour lights", "12. 입찰 건명 ： Harbour lights", "- 용역명:Harbour lights", "Title:\n\tHarbour lights"]
    assert claims(spark, *lines) == [{"title": "Harbour lights"}] * len(lines)
    nothing = ["title: Harbour lights", "The Title: Harbour lights", "Harbour lights", "Title Harbour lights", "Title:", "우리 공고명: 등대", "Note: x"]
    assert claims(spark, *nothing) == [{}] * len(nothing)
    assert claims(spark, "Title: a: b：c") == [{"title": "a: b：c"}]


def test_a_value_below_its_label(spark):
    for below in ("", "Buyer: Port office", "마감일", "Deadline", "1. Lights", "다. 등", "(2) Lights", "③ Lights", "IV. Lights", "※ Lights", "x" * 301, "물품 입찰공고", "공사\n입찰설명서"):
        assert "title" not in claims(spark, f"사업명:\n{below}")[0], below
    assert claims(spark, "사업명:\n" + "x" * 300) == [{"title": "x" * 300}]
    # only one line below, and the page's end ends it
    assert claims(spark, "Buyer:\n\nPort office", "Buyer:") == [{}, {}]
    assert read(spark, "Buyer:  \n  Port office ")[0] == [(1, "Buyer:  \n  Port office", "buyer_name", "Port office", False), (2, "Port office", None, None, False)]


@pytest.mark.parametrize("text, kind", [("공 사 입찰공고", "works"), ("물품 입 찰 설 명 서", "goods"), ("용역소액수의［견적제출］설명서", "services"), ("조달물자[공사]구매입찰공고", "works"), ("조달물자（물품） 구매\n입찰공고", "goods")])
def test_headings(spark, text, kind):
    assert claims(spark, text, text + " 취소", "재 " + text.replace("\n", "")) == [{"procurement_type": kind}, {}, {}]


def test_brackets_of_headings_match(spark):
    assert claims(spark, "조달물자(용역]구매입찰공고", "용역소액수의(견적제출］설명서", "용역 " * 60 + "\n입찰공고") == [{}, {}, {}]


def test_money(spark):
    texts = ["Budget: EUR 12,345,678.9", "Budget: JPY 7", "예산: 90원", "Budget: 90원", "Budget: CHF 5", "Budget: USD 1.234", "Budget: USD 12,34", "Budget: usd 5", "Budget: KRW -3", "예산: KRW 0.00"]
    some = lambda c, a: {"currency": c, "estimated_amount": a}
    assert claims(spark, *texts) == [some("EUR", "12345678.9"), some("JPY", "7"), some("KRW", "90"), {}, {}, {}, {}, {}, some("KRW", "!-3"), some("KRW", "!0")]


def test_instants(spark):
    texts = ["Published: 2031-05-06", "공고일: 2031-05-06", "Deadline: 2031-05-06", "Deadline: 2031-05-06T07:08:09.5Z", "Deadline: 2031-05-06 07:08 KST", "Deadline: 2031-05-06T07:08-0330", "Deadline: 2031-05-06 07:08", "Deadline: 2031-05-06 25:00Z", "Deadline: 2031-13-01 07:08", "Published: 2031-02-29", "Deadline: May"]
    at = [{"published_at": "2031-05-06T00:00:00Z"}, {"published_at": "2031-05-05T15:00:00Z"}, {}, *({"closes_at": f"2031-05-{x}Z"} for x in ("06T07:08:09", "05T22:08:00", "06T10:38:00")), {}, {"closes_at": "!2031-05-06 25:00Z"}, {"closes_at": "!2031-13-01 07:08"}, {"published_at": "!2031-02-29"}, {}]
    assert claims(spark, *texts) == at
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert claims(spark, *texts) == at
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_periods_and_lists(spark):
    texts = ["Contract period: 2031-01-01 to 2031-12-31", "계약기간: 2031-01-01/2031-01-01", "Contract period: 2031-12-31/2031-01-01", "Contract period: 2031-02-30/2031-03-01", "Contract period: two years"]
    assert claims(spark, *texts) == [{"contract_period": x} for x in ("2031-01-01/2031-12-31", "2031-01-01/2031-01-01", "!2031-12-31/2031-01-01", "!2031-02-30/2031-03-01")] + [{}]
    got = claims(spark, "Region: North shore ; 남해;", 'Capabilities: "quoted"; a\\b')
    assert json.loads(got[0]["regions"]) == ["North shore", "남해", ""] and json.loads(got[1]["required_capabilities"]) == ['"quoted"', "a\\b"]
    reserved = ["Certifications: Diving WITHOUT tanks", "필수역량: 등대 관리 제외", "Participation constraints: Optional", "Certifications: Diving; welding not needed"]
    assert [[(f, v, q) for _, _, f, v, q in x] for x in read(spark, *reserved)] == [[(f, None, True)] for f in ("required_certifications", "required_capabilities", "participation_constraints", "required_certifications")]
    assert claims(spark, "Certifications: notary; withoutness") == [{"required_certifications": '["notary","withoutness"]'}]


def test_titles(spark):
    texts = ['Title: "Harbour  lights"', "Title: 「a 「b」 c」", "Title: 「a」 and 「b」", "Title: [open", 'Title: "open', "Title: “Harbour\n  lights”", "Title: “Harbour\nlights", 'Title: "a" "b"', "Title: ］x［", "Title: “”"]
    want = ["Harbour lights", "a 「b」 c", "「a」 and 「b」", "![open", '!"open', "Harbour lights", "!“Harbour", '"a" "b"', "］x［", ""]
    assert [c.get("title") for c in claims(spark, *texts)] == want


def test_pages_without_lines(spark):
    assert read(spark, None, "", " \n\t\n") == [[], [], []]
    assert [r[0] for r in read(spark, "a\r\nb\rc d\n\ne")[0]] == [1, 2, 3, 4, 6]


def checked(spark, pages, proposed=None):
    p = spark.createDataFrame([(1, i, t) for i, t in enumerate(pages, 1)], "doc_id long, page_number int, text string")
    c = extraction.extract_claims(p)
    return extraction.validate_claims(proposed(c) if proposed else c, p).first().issues


def test_validation(spark):
    good = "Title: Harbour lights\nBuyer: Port office\n분류: 공사"
    assert checked(spark, [good, "Certifications: diving optional\nBudget: EUR 12.50"]) == []
    assert checked(spark, ["Title: Harbour lights\nCategory: works"]) == ["buyer_name:missing"]
    assert checked(spark, ["The lights are out."]) == ["buyer_name:missing", "procurement_type:missing", "title:missing"]
    assert checked(spark, [good, "하. 사업명: Pier"]) == ["title:contradictory_claims"]
    assert checked(spark, [good, "Budget: JPY 0"]) == ["estimated_amount:invalid_source_claim"]
    assert checked(spark, [good, "Region: North\nRegion:\nnot South"]) == ["regions:qualified_requirement"]
    forged = lambda c: c.withColumn("quote", F.when(F.col("field") == "buyer_name", "Buyer: Port  office").otherwise(F.col("quote")))
    assert checked(spark, [good], forged) == ["buyer_name:evidence_not_on_page", "buyer_name:unsupported_value"]
    other = lambda c: c.withColumn("value", F.when(F.col("field") == "title", "Pier").otherwise(F.col("value")))
    assert checked(spark, [good], other) == ["title:contradictory_claims", "title:unsupported_value"]


def test_first_value_wins_and_all_quotes_count(spark):
    p = spark.createDataFrame([(1, 2, "Title: late"), (1, 1, "Buyer: b\nTitle: first\nTitle: first")], "doc_id long, page_number int, text string")
    got = {r.field: (r.value, r.page_number, r.quotes) for r in extraction.extract_claims(p).collect()}
    assert got == {"title": ("first", 1, 3), "buyer_name": ("b", 1, 1)}


def test_same_claims(spark):
    rows = [("estimated_amount", "7", "7.00", True), ("closes_at", "2031-05-06T07:00:00Z", "2031-05-06T16:00:00+09:00", True), ("regions", '["x", "y"]', '["y","x"]', True), ("title", "pier", "Pier", False), ("estimated_amount", "n", "n", True)]
    df = spark.createDataFrame(rows, "field string, a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select(documents.same_claim(F.col("field"), F.col("a"), F.col("b")), "want").collect())


def test_documents_are_dealt_once(spark):
    """What is made of a page's text stays where its document is: neither claims nor quotes travel by keys of their own."""
    p = spark.createDataFrame([(1, 1, "Title: a")], "doc_id long, page_number int, text string")
    keys = lambda df: [re.sub(r"#\d+L?", "", k) for k in re.findall(r"hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())]
    claims = extraction.extract_claims(p)
    assert keys(claims) == ["doc_id"]
    assert set(keys(extraction.validate_claims(claims, p))) == {"doc_id"}
