"""Golden cases of the domain operators, re-authored as small frames."""

import difflib
import random
import re
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from noticeflow.functions import text as T
from noticeflow.operators import decisions, delta, documents, linking, metrics, normalize, replay, state, versions, views


def fold(rows):
    """The version fold, row by row."""
    keys, out = {}, []
    for key, seq, at, value in rows:
        mark, current, n = keys.get(key, (None, None, 0))
        lead, new = mark is None or at >= mark, current is None or value != current
        n += new
        kind = None if not new else "initial" if current is None else "current" if lead else "historical"
        if lead:
            mark, current = at, value
        keys[key] = mark, current, n
        out.append((key, seq, new, n if new else None, kind, mark, current))
    return sorted(out)


CASES = {"identical": "A1 A1", "stale": "B2 A1", "change": "A1 B2", "revert": "A1 B2 A3", "advance": "A1 A3 B2", "tie": "A1 B1"}
KINDS = {"identical": ["initial", None], "stale": ["initial", "historical"], "change": ["initial", "current"], "revert": ["initial", "current", "current"], "advance": ["initial", None, "historical"], "tie": ["initial", "current"]}


def test_version_fold(spark):
    rows = [(name, i, int(x[1]), x[0]) for name, c in CASES.items() for i, x in enumerate(c.split())]
    r = random.Random(5)
    rows += [(f"k{r.randrange(20)}", 100 + i, r.randrange(12), r.choice("ABC")) for i in range(600)]
    df = spark.createDataFrame(rows, "canonical_key string, obs_seq long, effective_at long, state_hash string")
    got = versions.version_fold(df).select("canonical_key", "obs_seq", "is_new", "version_number", "transition_kind", "watermark", "current_state")
    assert sorted(tuple(x) for x in got.collect()) == fold(rows)
    kinds = {name: [x.transition_kind for x in got.where(F.col("canonical_key") == name).orderBy("obs_seq").collect()] for name in KINDS}
    assert kinds == KINDS


SNAP = "struct<amount: decimal(18,2), currency: string, closes_at: timestamp, regions: array<string>, required_certifications: array<string>, required_capabilities: array<string>, participation_constraints: array<string>, contract_period: string>"
AT = datetime(2026, 9, 30, 9)


def snap(amount="100", currency="KRW", closes=AT, regions=("Seoul",), certs=("ISO 27001",), caps=("OCR",), clauses=None, period=None):
    lists = [list(x) if x is not None else None for x in (regions, certs, caps, clauses)]
    return (Decimal(amount) if amount is not None else None, currency, closes, *lists, period)


DELTAS = [
    ("no-change", {}, "", "low", ""), ("budget", {"amount": "120"}, "budget", "medium", "budget_increased"), ("earlier", {"closes": datetime(2026, 9, 20, 9)}, "closes_at", "high", "deadline_earlier"),
    ("region", {"regions": ("Busan",)}, "regions", "high", "region_restriction_changed"), ("cert", {"certs": ("ISO 27001", "ISO 9001")}, "required_certifications", "high", "certification_added"), ("format", {"amount": "100.00"}, "", "low", ""),
    ("caps", {"caps": ()}, "required_capabilities", "medium", "capability_removed"), ("compound", {"regions": ("Busan",), "amount": "90"}, "budget,regions", "high", "budget_decreased,region_restriction_changed"),
    ("order", {"regions": ("Seoul", "Seoul")}, "", "low", ""), ("unknown", {"amount": None}, "budget", "medium", "budget_became_unknown"), ("lifted", {"regions": ()}, "regions", "medium", "region_restriction_removed"),
    ("currency", {"currency": "USD"}, "budget", "medium", "budget_currency_changed"), ("clause", {"clauses": ("x",)}, "participation_constraints", "medium", "participation_constraints_became_known"),
]


def test_deltas(spark):
    df = spark.createDataFrame([(name, snap(), snap(**change)) for name, change, *_ in DELTAS], f"id string, before {SNAP}, after {SNAP}")
    got = {r.id: (",".join(r.changed_fields), r.impact, ",".join(r.reason_codes)) for r in delta.compute_delta(df).collect()}
    assert got == {name: (fields, impact, codes) for name, _, fields, impact, codes in DELTAS}


def test_manifest(spark):
    m = lambda rows: spark.createDataFrame(rows, "url string, sha256 string")
    b, a = m([("1", "x"), ("2", "y"), ("3", None)]), m([("1", "z"), ("3", "q"), ("4", "w")])
    got = lambda **k: {(r.url, r.change, r.level) for r in delta.manifest_diff(b, a, ["url"], **k).collect()}
    assert got() == {("1", "replaced", 1), ("2", "removed", 1), ("4", "added", 0)}
    assert got(complete=False) == {("1", "replaced", 1)}


EVENT = "record_id string, version_id string, effective_at timestamp, observed_at timestamp, created_at timestamp, title string, body string, category string, estimated_amount decimal(18,2), currency string, regions array<string>, required_certifications array<string>, required_capabilities array<string>, published_at timestamp, deadline timestamp"


def event(record, version, effective, observed, title="cloud migration OCR", amount="100", regions=("Seoul",), caps=("OCR",)):
    day = lambda d: datetime(2026, 9, d)
    return (record, version, day(effective), day(observed), day(observed), title, None, "services", Decimal(amount), "KRW", list(regions), ["ISO 27001"], list(caps), day(effective), datetime(2026, 9, 30, 9))


def test_replay(spark):
    events = [event("A", "A-1", 1, 2), event("B", "B-1", 1, 2, "office furniture", caps=("woodworking",)), event("C", "C-1", 1, 2, regions=("Busan",)), event("D", "D-1", 1, 15, amount="110"), event("A", "A-2", 8, 9, regions=("Busan",))]
    p = lambda i, d: (i, d, ["Seoul"], ["ISO 27001"], ["cloud migration", "OCR"], ["services"], Decimal(50), Decimal(200), "KRW", ["gambling"])
    names = "profile_id string, available_at timestamp, regions array<string>, certifications array<string>, capabilities array<string>, industries array<string>, min_contract_amount decimal(18,2), max_contract_amount decimal(18,2), contract_currency string, excluded_keywords array<string>"
    profiles = spark.createDataFrame([p("before", datetime(2026, 8, 1)), p("future", datetime(2026, 10, 1))], names)
    instants = spark.createDataFrame([(datetime(2026, 9, d),) for d in (3, 10, 16)], "as_of timestamp")
    got = {(r.as_of.day, r.version_id): (str(r.score), ",".join(r.hard_failures), r.recommended) for r in replay.replay(spark.createDataFrame(events, EVENT), profiles, instants).collect()}
    gone = "region_not_served"
    # B's published date and the scores follow the frozen answers
    assert {k: v[1:] for k, v in got.items()} == {(3, "A-1"): ("", True), (3, "B-1"): ("", False), (3, "C-1"): (gone, False), (10, "A-2"): (gone, False), (10, "B-1"): ("", False), (10, "C-1"): (gone, False), (16, "A-2"): (gone, False), (16, "B-1"): ("", False), (16, "C-1"): (gone, False), (16, "D-1"): ("", True)}
    assert got[3, "A-1"][0] == "0.89938" and got[3, "B-1"][0] == "0.46188" and got[16, "D-1"][0] == "0.90854"


def test_eligibility_unknowns(spark):
    schema = "title string, regions array<string>, estimated_amount decimal(18,2), currency string, required_certifications array<string>, p struct<regions: array<string>, certifications: array<string>, min_contract_amount: decimal(18,2), max_contract_amount: decimal(18,2), contract_currency: string, excluded_keywords: array<string>>"
    full = (["Seoul"], ["ISO 9001"], Decimal(10), Decimal(20), "KRW", ["gamb ling", "도박"])
    rows = [("a Gamb  Ling b", ["SEOUL "], Decimal(15), "krw", ["iso  9001"], full), ("도박장", [], Decimal(5), "USD", None, full), (None, None, None, None, ["X"], (None, None, None, None, None, None)), ("도박 x", ["Busan"], Decimal(25), "KRW", [], full)]
    df = spark.createDataFrame(rows, schema)
    got = [(sorted(r.hard_failures), sorted(r.warnings)) for r in decisions.eligibility(df).collect()]
    assert got == [(["explicit_exclusion"], []), ([], ["amount_currency_mismatch", "certifications_unknown", "region_unknown"]), (["missing_certification"], ["region_unknown"]), (["amount_above_maximum", "explicit_exclusion", "region_not_served"], ["certifications_unknown"])]
    strict = decisions.eligibility(df, empty_is_unknown=False).collect()
    assert "region_not_served" in strict[1].hard_failures and strict[3].warnings == []


def test_links(spark):
    names = "id long, source_id long, record_id string, stage string, title string, buyer string, amount decimal(18,2), published_at timestamp, references array<struct<source_id: bigint, record_id: string, stage: string>>, identifiers array<struct<scheme: string, value: string>>"
    at = datetime(2026, 9, 1)
    node = lambda i, source, stage, refs=None, ids=None, title="Cloud migration services", buyer="Agency": (i, source, f"r{i % 10}", stage, title, buyer, Decimal(100), at, refs, ids)
    rows = [node(11, 1, "tender"), node(12, 1, "amendment", [(None, "r1", "tender")])]  # official
    rows += [node(21, 2, "tender"), (29, 2, "r1", "tender", "Other", "B", Decimal(1), at, None, None), node(22, 2, "award", [(None, "r1", "tender")])]  # ambiguous
    rows += [node(31, 3, "tender"), node(32, 3, "award", [(None, "r9", "tender")])]  # missing, no fall-through
    rows += [node(41, 4, "contract"), node(42, 4, "award", [(None, "r1", "contract")])]  # reverse
    rows += [node(51, 5, "tender"), node(52, 5, "amendment", title="Cloud migration service")]  # fingerprint
    rows += [node(61, 6, "tender", ids=[("CPV", "X1")]), node(62, 6, "award", ids=[("cpv", "x1")], title="else")]  # identifier
    rows += [node(71, 7, "tender"), node(73, 7, "contract", ids=[("c", "Y")], title="far off"), node(72, 7, "award", ids=[("c", "y")])]  # a match of a later stage ends the ladder
    got = {r.child: (r.parent, r.method, r.unresolved) for r in linking.links(spark.createDataFrame(rows, names)).collect()}
    assert got[12] == (11, "official_reference", None) and got[22] == (None, None, "ambiguous_official_reference") and got[32] == (None, None, "official_reference_not_found") and got[42] == (None, None, "incompatible_stage")
    assert got[52] == (51, "fingerprint", None) and got[62] == (61, "normalized_identifier", None) and got[11][2] == "incompatible_stage" and got[29][2] == "no_conservative_match"
    assert got[72] == (None, None, "incompatible_stage")
    assert linking.links(spark.createDataFrame(rows, names), fuzzy=False).where("child = 52").first().parent is None
    pairs = spark.createDataFrame([("abc d", "abd c"), ("", "x"), (None, None)], "a string, b string")
    assert [r[0] for r in pairs.select(linking.title_ratio("a", "b")).collect()] == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in (("abc d", "abd c"), ("", "x"), ("", ""))]
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "child long, parent long")
    assert {tuple(r) for r in linking.closure(edges).collect()} == {(2, 1, 1), (3, 2, 1), (4, 3, 1), (3, 1, 2), (4, 2, 2), (4, 1, 3)}
    links = edges.selectExpr("child AS link_id", "child", "parent", "'active' AS status", "child AS created_at")
    assert {tuple(r) for r in linking.timelines(links, edges.selectExpr("child AS node")).collect()} == {(i, 1, 4, True) for i in (1, 2, 3, 4)}


LINKED = "id long, source_id long, record_id string, stage string, title string, buyer string, amount decimal(18,2), published_at timestamp_ntz, references array<struct<source_id: bigint, record_id: string, stage: string>>, identifiers array<struct<scheme: string, value: string>>"


def seen(df, acc):
    """df, and how many of its rows are computed (in an accumulator)."""

    def count(batches):
        for b in batches:
            acc.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema)


def test_fingerprints_without_pairs(spark):
    """Matches are counted in their order: the ladder joins references alone, and titles are compared once per pair of titles."""
    at, day = datetime(2026, 9, 1), timedelta(days=1)
    node = lambda i, stage, when, title="Cloud migration services": (i, 1, str(i), stage, title, "Agency", Decimal(100), when, None, None)
    rows = [node(1, "tender", at), node(2, "award", at + 30 * day + timedelta(microseconds=999_999)), node(3, "award", at - 30 * day - timedelta(seconds=1)), node(4, "contract", at + 60 * day, "Cloud migration service"), node(5, None, at - 90 * day), node(6, "award", at - 90 * day)]
    df = spark.createDataFrame(rows, LINKED)
    want = {1: "incompatible_stage", 2: 1, 3: "no_conservative_match", 4: 2, 5: "incompatible_stage", 6: "incompatible_stage"}
    assert {r.child: r.parent or r.unresolved for r in linking.links(df).collect()} == want
    assert {r.child: r.parent or r.unresolved for r in linking.links(df, fuzzy=False).collect()} == want | {4: "no_conservative_match"}
    plan = lambda fuzzy: linking.links(df, fuzzy=fuzzy)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin ", plan(False))) == 1
    assert re.search(r"ArrowEvalPython [^\n]*\n(?:[^\n]*\n){0,2}[^\n]*Aggregate \[", plan(True))


def test_edges_are_computed_once(spark):
    acc = spark.sparkContext.accumulator(0)
    edges = seen(spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "child long, parent long"), acc)
    assert linking.closure(edges).count() == 6 and acc.value == 3


def test_outcome_watchers_read_each_table_once(spark):
    from noticeflow.plans import queries

    plan = queries.QUERIES["d24_outcome_watchers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[o_orderkey", plan)) == 2, "the ladder is computed again for each level of the closure"


def test_decisions_are_computed_once(spark):
    """The semantic step judges pairs where the decision is."""
    acc = spark.sparkContext.accumulator(0)
    rows = [(i, 1, str(i), stage, title, None, None, None, None, None) for i, stage, title in ((1, "tender", "a"), (2, "award", "a"), (3, "contract", "b"))]
    nodes = spark.createDataFrame(rows, LINKED)
    found = linking.semantic_links(nodes, seen(linking.links(nodes, fuzzy=False), acc), lambda a, b: F.when(a["title"] == b["title"], 1.0))
    assert {r.child: r.parent for r in found.collect()} == {1: None, 2: 1, 3: None} and acc.value == 3

def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "b", 1), ("q", "a", 2)], "g string, id string, position int")
    relevance = spark.createDataFrame([("q", "a", 3), ("q", "c", 1)], "g string, id string, grade int")
    import math

    r = metrics.ranking_metrics(ranked, relevance, 2, ["g"]).first()
    assert r.recall_at_k == 0.5 and abs(r.ndcg_at_k - (7 / math.log2(3)) / (7 + 1 / math.log2(3))) < 1e-12
    five = spark.createDataFrame([("x", float(i)) for i in range(1, 6)], "g string, v double")
    assert abs(metrics.percentiles(five, "v", [95], ["g"]).first().p95 - 4.8) < 1e-12
    empty = metrics.set_metrics(five.where("v > 9"), five.where("v > 9"), ["v"]).first()
    assert empty.precision is None and empty.f1 is None and empty.tp == 0


def test_state_folds(spark):
    op = lambda seq, what, amount, key, held=None, ref="x", account="a": (account, seq, what, amount, key, held, "t", ref)
    ops = [op(1, "grant", 10, "k1"), op(2, "reserve", 4, "k2", "r1"), op(3, "reserve", 4, "k2", "r1"), op(4, "reserve", 5, "k2", "r9"), op(5, "reserve", 50, "k3", "r2"), op(6, "reserve", 1, "k4", "r1"), op(7, "commit", None, "k5", "r1"), op(8, "refund", None, "k6", "r1"), op(9, "commit", None, "k5", "r1"), op(10, "refund", None, "k7", "r7"), op(11, "grant", 0, "k8"), op(12, "reserve", 6, "k9", "r3"), op(13, "refund", None, "k10", "r3")]
    got = state.ledger(spark.createDataFrame([*ops, op(1, "reserve", 1, "k1", account="b")], "account string, seq long, operation string, amount long, idempotency_key string, reservation_key string, reference_type string, reference_key string"))
    a = [(r.reason or r.outcome, r.available, r.reserved) for r in got.where("account = 'a'").orderBy("seq").collect()]
    assert a == [("applied", 10, 0), ("applied", 6, 4), ("repeat", 6, 4), ("idempotency_conflict", 6, 4), ("insufficient_credits", 6, 4), ("reservation_exists", 6, 4), ("applied", 6, 0), ("reservation_terminal", 6, 0), ("repeat", 6, 0), ("reservation_not_found", 6, 0), ("invalid_amount", 6, 0), ("applied", 0, 6), ("applied", 6, 0)]
    assert [tuple(r) for r in state.ledger_rejections(got).where("account = 'b'").collect()] == [("b", "insufficient_credits", 1, 1)]
    log = spark.createDataFrame([("j", i, f) for i, f in enumerate([True, True, False, True, True, True])], "job string, seq long, failed boolean")
    assert [(r.attempts, r.dead_lettered, r.retry_after_s) for r in state.failure_state(log).orderBy("seq").collect()] == [(1, False, 2), (2, False, 4), (0, False, None), (1, False, 2), (2, False, 4), (3, True, None)]
    codes = spark.createDataFrame([(429, None), (503, None), (404, None), (None, "40P01"), (None, "08006"), (None, None)], "s int, q string")
    assert [r[0] for r in codes.select(state.transient(F.col("s"), F.col("q"))).collect()] == [True, True, False, True, True, False]


def test_normalisation(spark):
    good = '{"title": " T ", "buyer_name": "B", "lifecycle_stage": "tender", "estimated_amount": "12.50", "published_at": "2026-09-01T09:00:00+09:00", "regions": ["b", " a", "a", ""]}'
    bad = '{"title": " ", "buyer_name": "B", "lifecycle_stage": "tender", "estimated_amount": "x", "currency": null, "closes_at": "2026-09-01T09:00:00"}'
    at = datetime(2026, 9, 5)
    raw = spark.createDataFrame([(1, 7, "r1", at, None, good), (2, 7, "r1", at, None, bad), (3, 7, "r2", at, None, "not json")], "obs_seq long, source_id long, source_record_id string, fetched_at timestamp, source_updated_at timestamp, payload string")
    n = normalize.normalize(raw)
    g = normalize.accepted(n).first()
    assert (g.title, g.regions, str(g.estimated_amount), g.currency, g.published_at, g.effective_at) == ("T", ["a", "b"], "12.500000", "KRW", datetime(2026, 9, 1), datetime(2026, 9, 1))
    q = {r.obs_seq: set(r.errors) for r in normalize.quarantined(n).collect()}
    assert q[2] == {"title_missing", "estimated_amount_invalid", "currency_null", "closes_at_not_zoned"} and "title_missing" in q[3]


def test_text_and_documents(spark):
    df = spark.createDataFrame([("  Straße　 A ", "100.500"), (None, None), ("한글ab", "7")], "t string, d string")
    got = df.select(T.norm(F.col("t")), T.decimal_text(F.col("d").cast("decimal(18,3)"))).collect()
    assert [tuple(r) for r in got] == [("strasse a", "100.5"), (None, None), ("한글ab", "7")]
    html = spark.createDataFrame([("<p>a&amp;b</p><script>x<b>y</b></script> <i> c </i><style>z</style>",), (None,)], "h string")
    assert [r[0] for r in html.select(documents.visible_text()("h")).collect()] == ["a&b\nc", ""]
    pages = spark.createDataFrame([(1, 2, "###!!!***(((###!!!***((("), (1, 1, "ok text that is long enough"), (2, 1, " ")], "doc_id long, page_number int, text string")
    assert {r.doc_id: (r.pages, r.weak_pages, r.reasons) for r in documents.document_quality(pages).collect()} == {1: (2, 1, ["page_2:low_alphanumeric_ratio"]), 2: (1, 1, ["page_1:empty_text"])}


def test_views(spark):
    with pytest.raises(ValueError):
        views.inbox_filter(spark.range(1), amount=(2, 1))
    mark = views.filter_fingerprint("u", {"q": "x"})
    assert views.decode_cursor(views.encode_cursor("2026-01-01", 5, mark), mark) == ("2026-01-01", 5)
    with pytest.raises(ValueError):
        views.decode_cursor(views.encode_cursor("2026-01-01", 5, mark), views.filter_fingerprint("u", {"q": "y"}))
    rows = spark.createDataFrame([(i, None if i == 3 else datetime(2026, 1, 1 + i % 2)) for i in range(6)], "id long, published_at timestamp").withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))
    assert [r.id for r in views.keyset_page(rows, 2).collect()] == [5, 1, 4]
    assert [r.id for r in views.keyset_page(rows, 9, after=("2026-01-02 00:00:00", 1)).collect()] == [4, 2, 0, 3]


def test_documents_and_delivery(spark):
    att = spark.createDataFrame([("v", "a", "h1"), ("v", "b", "h2")], "version_id string, attachment_id string, sha256 string")
    page = "array<struct<page_number: int, text: string>>"
    parses = spark.createDataFrame([("a", "native", 9, "trusted", [(1, "n")]), ("a", "ocr", 1, "trusted", [(2, "o2"), (1, "o1"), (3, " ")]), ("b", "native", 1, "needs_ocr", [(1, "x")])], f"attachment_id string, parser_kind string, parser_version int, status string, pages {page}")
    assert [(p.page_number, p.text) for p in documents.document_bundle(att, parses).first().bundle] == [(1, "o1"), (2, "o2")]
    log = [("e", 1, "failed", True), ("e", 2, "failed", True), ("e", 3, "failed", True), ("e", 4, "sent", True), ("f", 1, "failed", True), ("f", 2, "sent", True), ("f", 3, "failed", True), ("g", 1, "failed", True), ("h", 1, "failed", False)]
    got = {r.event_id: (r.status, r.attempts, r.wait_s) for r in state.delivery_state(spark.createDataFrame(log, "event_id string, seq long, outcome string, retryable boolean")).collect()}
    assert got == {"e": ("dead_lettered", 3, None), "f": ("sent", 2, None), "g": ("pending", 1, 2), "h": ("dead_lettered", 1, None)}
    row = spark.createDataFrame([(1, 0.5, 0.7, 0.7)], "id long, a double, b double, c double")
    assert [tuple(x) for x in views.top_features(row, ["a", "b", "c"]).first().top] == [("b", 0.7), ("c", 0.7)]


def test_government_fields_and_profiles(spark):
    raw = spark.createDataFrame([('{"bidNtceNm": "N", "dminsttNm": " ", "ntceInsttNm": "I", "ntceKindNm": "변경공고", "presmptPrce": "5", "bidNtceDt": "2026-09-01 10:00:00", "bidClseDt": "2026-09-02 10:00:00"}',)], "p string")
    import json

    assert json.loads(raw.select(normalize.map_government(F.col("p"))).first()[0]) == {"title": "N", "buyer_name": "I", "lifecycle_stage": "amendment", "estimated_amount": "5", "published_at": "2026-09-01T10:00:00+09:00", "closes_at": "2026-09-02T10:00:00+09:00"}
    p = spark.createDataFrame([(["a", " A "], [], [], [], Decimal(5), Decimal(1), None), (["a"], [], [], [], None, None, "krw")], "regions array<string>, certifications array<string>, industries array<string>, capabilities array<string>, min_contract_amount decimal(18,2), max_contract_amount decimal(18,2), contract_currency string")
    assert [(r.errors, r.contract_currency) for r in normalize.profile_errors(p).collect()] == [(["regions_repeated", "amounts_inverted", "currency_required"], None), ([], "KRW")]
