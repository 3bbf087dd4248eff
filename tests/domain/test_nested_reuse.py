"""Nested values, derived triggers, and decisions that are kept: their edges, beside the twins of the registered queries."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from noticeflow.functions import nested
from noticeflow.operators import delivery, evaluation, reuse, triggers


def through(spark, make, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, v string")
    return [r["x"] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_canonical_is_pythons_own(spark):
    values = [{"b": 1, "a": [1.0, 2.5e-7, "é ", None, True, {"z": {}, "y": []}]}, [], "x", 10**30, {"k": "한"}, -0.0]
    texts = [json.dumps(v, indent=1) for v in values]
    assert through(spark, nested.canonical, *texts) == [json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for v in values]
    spaced = lambda c: nested.digest(c, ascii_=True, separators=nested.SPACED)
    assert through(spark, spaced, *texts) == [hashlib.sha256(json.dumps(v, sort_keys=True).encode()).hexdigest() for v in values]
    assert through(spark, nested.canonical, None, "", "{", "null", "[NaN]") == [None, None, None, "null", "[NaN]"]
    assert through(spark, lambda c: nested.canonical(c, numbers=False), "[NaN]", "[1]") == [None, "[1]"]
    assert through(spark, nested.canonical, "[" * 20_000) == [None]


def test_meaning_leaves_evidence_out_at_any_depth(spark):
    assert through(spark, lambda c: nested.without(c, "evidence"), '{"a":{"before_evidence":[1],"x":[{"evidence":2,"y":3}]},"my_evidence_":1}') == ['{"a":{"x":[{"y":3}]}}']


def test_redaction(spark):
    got = through(spark, nested.redacted, json.dumps({"Authorization": {"x": 1}, "list": [{"userEmail": "a@b"}], "t": "y" * 1001, "ok": "y" * 1000}), '["' + "z" * 1500 + '"]')
    assert json.loads(got[0]) == {"Authorization": "[REDACTED]", "list": [{"userEmail": "[REDACTED]"}], "t": "y" * 1000 + "...[TRUNCATED]", "ok": "y" * 1000}
    assert json.loads(got[1]) == ["z" * 1000 + "...[TRUNCATED]"]


def test_public_values_name_documents_by_handle(spark):
    name = "00000000-0000-0000-0000-00000000000a"
    known = json.dumps([{"id": name, "sha256": "s", "source_url": "u", "stored": True}, {"id": "e", "sha256": "s", "source_url": "w", "stored": False}])
    show = lambda v: json.loads(through(spark, lambda c: nested.public(c, F.lit(known)), json.dumps(v))[0])
    handle = f"/api/v1/documents/{name}/original"
    named = {"attachment_id": name, "sha256": "s", "original_url": handle}
    assert show({"attachments": ["u", "nowhere"], "provider_header": 1}) == {"attachments": [named, {}]}
    assert show({"url": "u", "title": "t"}) == {**named, "title": "t"}
    assert show({"sha256": "s"}) == {"sha256": "s"}  # two documents have it
    assert show({"sha256": "s", "url": "w"}) == {"attachment_id": "e", "sha256": "s", "original_url": None}
    assert show({"attachment_id": "other", "original_url": "http://x"}) == {"attachment_id": "other"}
    other = "00000000-0000-0000-0000-00000000000b"
    kept = {"attachment_id": other, "original_url": f"/api/v1/documents/{other}/original"}
    assert show(kept) == kept
    assert show({"value": {"request": {"title": 1}, "evidence": [{"quote": "q", "trace": 2}]}}) == {"value": {"evidence": [{"quote": "q"}]}}
    assert len(nested.PUBLIC_KEYS) == len(set(nested.PUBLIC_KEYS)) == 97


@pytest.mark.parametrize("fields, documents, impact, wanted", [
    ("{}", '{"added":[],"removed":[]}', "high", []),
    ("{}", '{"added":[{"x":1}]}', "low", ["watched_material_change"]),
    ('{"closes_at":{}}', "{}", "low", ["watched_material_change"]),
    ('{"closes_at":{}}', None, "medium", ["watched_material_change", "deadline_changed"]),
    ('{"budget":{},"closes_at":1}', "{}", "high", ["watched_material_change", "deadline_changed", "eligibility_changed"]),
    (None, None, None, []),
])
def test_triggers_of_a_change(spark, fields, documents, impact, wanted):
    df = spark.createDataFrame([(fields, documents, impact)], "f string, d string, i string")
    assert df.select(triggers.change_triggers(F.col("f"), F.col("d"), F.col("i")).alias("x")).first()["x"] == wanted


def test_repaired_evidence_tells_nothing_new(spark):
    versions = spark.createDataFrame([(1, 12, "current", 50, 40)], "opportunity_id long, version_id long, transition_kind string, transition_at long, effective_at long")
    watches = spark.createDataFrame([("u", 1, 10), ("late", 1, 51)], "user_id string, opportunity_id long, created_at long")
    delta = lambda i, evidence: (1, i, 11, 12, "current_transition", i, f'{{"regions": {{"after": ["x"], "after_evidence": {evidence}}}}}', "{}", "high", ["r"])
    schema = "opportunity_id long, delta_id long, from_version_id long, to_version_id long, comparison_kind string, created_at long, field_changes string, document_changes string, impact_level string, reason_codes array<string>"
    told = [{tuple(r) for r in triggers.changes(versions, spark.createDataFrame([delta(i, i) for i in range(1, n)], schema), watches, F.lit(60)).collect()} for n in (2, 3)]
    assert told[0] == told[1] and {r[2] for r in told[0]} == {"watched_material_change", "eligibility_changed"} and {r[0] for r in told[0]} == {"u"}
    assert triggers.changes(versions, spark.createDataFrame([delta(1, 1)], schema), watches, F.lit(45)).count() == 0


def test_store_computes_only_what_changed(spark, tmp_path):
    counted = spark.sparkContext.accumulator(0)
    schema = "id long, who string, v long"

    @F.udf("long")
    def seen(v):
        counted.add(1)
        return v * 2

    def run(store, rows):
        inputs = spark.createDataFrame(rows, schema).withColumn("fingerprint", reuse.fingerprint(F.col("v")))
        before = counted.value
        got = store.materialize(inputs, lambda df: df.select("id", "who", "fingerprint", seen("v").alias("twice"))).collect()
        return sorted((r.id, str(r.who), r.twice, r.reused) for r in got), counted.value - before

    store = reuse.Store(spark, str(tmp_path / "s"), ["id", "who"])
    rows = [(1, "a", 5), (2, None, 6), (3, "c", 7), (3, "c", 7)]
    assert run(store, rows) == ([(1, "a", 10, False), (2, "None", 12, False), (3, "c", 14, False)], 3)
    assert run(store, rows) == ([(1, "a", 10, True), (2, "None", 12, True), (3, "c", 14, True)], 0)
    assert run(store, [(1, "a", 50), (2, None, 6), (4, "d", 1)]) == ([(1, "a", 100, False), (2, "None", 12, True), (4, "d", 2, False)], 2)
    now = spark.createDataFrame([(1, "a", 50), (2, None, 6)], schema).withColumn("fingerprint", reuse.fingerprint(F.col("v")))
    assert [(r.id, r.twice) for r in store.stale(now).collect()] == [(1, 10)]
    assert run(store, [(1, "a", 5)])[1] == 0  # what an earlier input gave is still there
    # a run that broke off leaves rows without a marker: nobody reads them
    spark.createDataFrame([(9, "z", 1)], schema).write.parquet(str(tmp_path / "s" / "run-99999999-broken"))
    (tmp_path / "s" / "run-99999999-broken" / "_SUCCESS").unlink()
    assert run(store, [(1, "a", 5)])[1] == 0 and store.rows().where("id = 9").count() == 0


def test_fingerprints_tell_unknown_from_empty(spark):
    df = spark.sql("SELECT * FROM VALUES (array(), 'x'), (null, 'x'), (array('x'), null), (array('x', ''), null) AS t(a, b)")
    prints = [r[0] for r in df.select(reuse.fingerprint(F.col("a"), F.col("b"))).collect()]
    assert len(set(prints)) == 4


def test_epochs_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Seoul")
        df = spark.sql("SELECT timestamp'2026-09-01T20:00:00Z' AS a, timestamp'2026-09-01T20:00:00.000120Z' AS b")
        e = lambda c, asked: reuse.ranking_epoch(F.col(c), F.lit(asked).cast("string"), F.lit("open"))
        got = df.select(e("a", None).alias("w"), e("b", None).alias("x"), e("a", "daily:2026-09-01").alias("y"), e("a", "daily:2026-09-02").alias("z")).first()
        assert [tuple(x) for x in got] == [("exact:2026-09-01T20:00:00+00:00", None), ("exact:2026-09-01T20:00:00.000120+00:00", None), ("daily:2026-09-01:open", None), (None, "epoch_mismatch")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


ROWS = "artifact long, route string, case_id long, expected_valid boolean, valid boolean, schema_valid boolean, correct long, support long, prompt_tokens long, completion_tokens long, called boolean"


def test_totals_follow_from_rows(spark):
    rows = [(1, "hosted_all", c, c != 3, c == 1, c != 2, c, 4, 10 * c, None if c == 2 else 1, None) for c in (1, 2, 3)] + [(1, "hosted_gated", c, c != 3, True, True, 0, 4, None, None, c == 3) for c in (1, 2, 3)]
    df = spark.createDataFrame(rows, ROWS)
    got = {r.route: r for r in evaluation.route_totals(df).collect()}
    a, g = got["hosted_all"], got["hosted_gated"]
    assert (a.documents, a.correct_fields, a.expected_fields, a.schema_failures, a.grounded_accepted_documents, a.hosted_calls, a.prompt_tokens, a.completion_tokens, a.field_accuracy) == (3, 3, 8, 1, 1, 3, 60, None, 3 / 8)
    assert (g.hosted_calls, g.prompt_tokens, g.completion_tokens) == (1, None, None)
    rolled = {(r.artifact, r.route): r.documents for r in evaluation.route_totals(df, rolled=True).collect()}
    assert rolled == {(1, "hosted_all"): 3, (1, "hosted_gated"): 3, (1, None): 6, (None, None): 6}


def test_artifact_issues(spark):
    row = lambda a, route, c, correct=1, support=2: (a, route, c, True, True, True, correct, support, 1, 1, True)
    rows = [row(1, "hosted_all", 1), row(1, "hosted_gated", 1), row(2, "hosted_all", 1), row(2, "hosted_all", 1), row(3, "hosted_all", 1, 5), row(4, "hosted_all", 1), row(4, "hosted_gated", 1, 1, 3), row(5, "hosted_all", 1)]
    df = spark.createDataFrame(rows, ROWS)
    stored = evaluation.route_totals(df).where("artifact <> 5").unionByName(evaluation.route_totals(df).where("artifact = 5").withColumn("artifact", F.lit(6).cast("long")))
    got = {(r.artifact, r.route): r.issues for r in evaluation.check_artifacts(stored, df).collect()}
    assert got == {(1, "hosted_all"): [], (1, "hosted_gated"): [], (2, "hosted_all"): ["duplicate_cases"], (3, "hosted_all"): ["impossible_counts"], (4, "hosted_all"): ["other_cases"], (4, "hosted_gated"): ["other_cases"], (5, "hosted_all"): ["not_stored"], (6, "hosted_all"): ["no_rows"]}


def test_savings_stay_unknown_where_a_side_is(spark):
    totals = [(1, "hosted_all", 10, 5, 5, 2.0), (1, "hosted_gated", 12, 5, None, 1.0), (2, "hosted_all", 0, 0, 0, 0.0), (2, "hosted_gated", 0, 0, 0, 1.0), (3, "hosted_all", 1, 1, 1, None)]
    df = spark.createDataFrame(totals, "artifact long, route string, hosted_calls long, prompt_tokens long, completion_tokens long, cost double")
    got = {r.artifact: (r.status, r.avoided_calls, r.call_reduction_rate, r.token_reduction_rate, r.reported_cost_reduction_rate) for r in evaluation.optimization(df).collect()}
    assert got == {1: ("measured", -2, -0.2, None, 0.5), 2: ("measured", 0, None, None, None), 3: ("not_run", None, None, None, None)}


def test_rolling_hash_is_hashlib_in_order(spark):
    rows = [(g, i, None if i == 3 else f"é{g}{i}") for g in ("a", "b", None) for i in (5, 1, 3, 2)]
    df = spark.createDataFrame(rows, "g string, i long, t string").repartition(3)
    want = {g: hashlib.sha256(b"".join(f"é{g}{i}".encode() + b"\0" for i in (1, 2, 5))).hexdigest() for g in ("a", "b", None)}
    assert {r.g: r.digest for r in evaluation.rolling_hash(df, "g", "i", "t").collect()} == want


def test_folds_keep_large_numbers_beside_nulls(spark):
    big = (1 << 60) + 1
    hits = spark.createDataFrame([("a", None, big, 5), ("a", None, big + 2, 6), (None, big, 3, 5)], "scope string, actor long, seq long, at long")
    got = sorted(((r.scope, r.actor, r.seq, r.hits) for r in delivery.limited(hits, 1).collect()), key=str)
    assert got == [("a", None, big, 1), ("a", None, big + 2, 2), (None, big, 3, 1)]


def test_counters(spark):
    links = spark.createDataFrame([(1, 2), (2, None)], "child long, parent long")
    jobs = spark.createDataFrame([(True,), (False,), (None,)], "failed boolean")
    ranked = spark.createDataFrame([(True,), (False,)], "recommended boolean")
    assert tuple(evaluation.reconcile_counters(links, jobs, ranked).first()) == (1, 1, 2, 1, 1, 2)
    out = spark.createDataFrame([(1, "applied", 5), (1, "duplicate", None), (2, "review", None)], "invoice_id long, outcome string, credit_units long")
    assert sorted(map(tuple, evaluation.billing_scope(out).collect())) == [(1, 2, 1, 0, 5), (2, 1, 0, 1, None)]
