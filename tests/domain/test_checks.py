"""What outside systems send, against Python's own libraries and small cases."""

import hashlib
import hmac
import json

from pyspark.sql import functions as F

from noticeflow.functions import checks


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, (bytes, type(None))) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_media_types(spark):
    cases = [(b"%PDF-1.7", "text/html", "application/pdf"), (b" \n\t<!DOCTYPE HTML>", None, "text/html"), (b"<P>\xff\xfe", "", "text/html"), (b"HWP Document File V5", None, "application/x-hwp"), (b"\x89PNG", " Application/X-HWP ; x=1", "application/x-hwp"), (b"\x89PNG", "image/png", None), (b"\x00", "application/zip", None), (None, "text/html", "text/html"), (b"", None, None), (b" " * 1024 + b"<html", None, None)]
    df = spark.createDataFrame(cases, "c binary, h string, want string")
    assert all(r.x == r.want for r in df.select(checks.media_type(F.col("c"), F.col("h")).alias("x"), "want").collect())


def test_addresses(spark):
    cases = [("https://files.town/a?b", "FILES.town", None), ("http://files.town/", "files.town", "https_without_credentials_required"), ("https://u:p@files.town/", "files.town", "https_without_credentials_required"), ("https://other/", "files.town", "host_not_allowed"), ("https://10.0.0.1/x", "10.0.0.1", "address_not_public"), ("https://[::1]/x", "[::1]", "address_not_public"), ("https://8.8.8.8:444/x", "8.8.8.8", None), ("https://169.254.169.254/", "169.254.169.254", "address_not_public"), ("not a url", "x", "https_without_credentials_required"), (None, "x", "https_without_credentials_required")]
    df = spark.createDataFrame(cases, "u string, h string, want string")
    assert [(r.u, r.x) for r in df.select("u", checks.unsafe_url(F.col("u"), F.col("h")).alias("x")).collect()] == [(u, w) for u, _, w in cases]


def test_signatures(spark):
    body, secrets = '{"é": 1}', ("short", "x" * 80)
    for secret in secrets:
        sign = lambda t, s=secret: hmac.new(s.encode(), f"{t}.".encode() + body.encode(), hashlib.sha256).hexdigest()
        good, old = sign(1000), "0" * 64
        cases = {f"t=1000,v1={good}": True, f"v1={old}, v1={good.upper()} ,t=1000": True, f"t=1000,v1={old}": False, f"t=1000,t=1000,v1={good}": False, f"v1={good}": False, f"t=1000,v1={good[:-1]}": False, f"t=1000,{good}": False, "": False, f"t=1000,v0=x,v1={good}": True, f"t=x,v1={good}": False, f"t=1301,v1={sign(1301)}": False, f"t=1300,v1={sign(1300)}": True}
        df = spark.createDataFrame([(h, body) for h in cases] + [(None, body), (f"t=1000,v1={good}", None)], "h string, b string")
        got = df.select("h", "b", checks.signed(F.col("b"), F.col("h"), secret, F.lit(1000)).alias("x")).collect()
        assert {r.h: r.x for r in got if r.b and r.h is not None} == cases and not any(r.x for r in got if not r.b or r.h is None)
    assert not one(spark, checks.signed(F.col("b"), F.lit("t=1,v1=" + "0" * 64), "", F.lit(1)), b="x")


def test_strict_json(spark):
    cases = {'{"a": {"b": 1}}': True, '{"a": 1, "a": 1}': False, '{"a": [{"b": 1, "b": 2}]}': False, '{"a": NaN}': False, "[]": False, "": False, "{": False}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.x for r in df.select("t", checks.strict_json(F.col("t")).alias("x")).collect()} == cases


def test_answers(spark):
    def said(content, finish="stop", usage=None, **more):
        return json.dumps({"choices": [{"finish_reason": finish, "message": {"content": content, **more}}], "usage": usage or {}})

    cases = [
        (said('{"a": 1}', usage={"prompt_tokens": 5, "completion_tokens": 0}), "parsed", "stop", "plain", "reported"), (said('```json\n{"a": 1}\n```'), "parsed", "stop", "json_fence", "unknown"), (said('see ```json\n{"a": 1}\n```'), "invalid_json", "stop", "plain", "unknown"),
        (said("[1]", usage={"prompt_tokens": -1, "completion_tokens": 2}), "non_object_json", "stop", "plain", "partial"), (said("{}", "length"), "incomplete_response", "length", "plain", "unknown"), (said("{}", "odd"), "incomplete_response", "other", "plain", "unknown"),
        (said("{}", refusal="no"), "refused", "stop", "plain", "unknown"), (said({"a": 1}), "invalid_envelope", "stop", None, "unknown"), ('{"choices": []}', "invalid_envelope", None, None, "unknown"), ("[]", "invalid_envelope", None, None, "unknown"), ("{", "invalid_json", None, None, "unknown"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i long, t string")
    a = checks.answer(F.col("t"))
    got = df.select("i", *(v.alias(k) for k, v in a.items())).orderBy("i").collect()
    assert [(r.status, r.finish, r.format, r.usage) for r in got] == [c[1:] for c in cases]
    assert got[1].content == '{"a": 1}' and got[0].completion_tokens == 0 and got[3].prompt_tokens is None


def test_composed_text(spark):
    assert one(spark, checks.compact_nfc(F.col("t")), t="가 é　x\n") == "가éx"
