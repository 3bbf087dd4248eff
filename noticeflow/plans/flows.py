"""Registered queries of deliveries and limits, timelines, triggers, nested values and kept decisions, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noticeflow.functions import checks, nested
from noticeflow.functions.storage import new_table
from noticeflow.functions.text import utc_text
from noticeflow.operators import delivery, documents, government, linking, presentation, reuse, triggers
from noticeflow.plans.adapters import table
from noticeflow.plans.registry import query


def _seconds(c):
    """Whole seconds since 1970 of a wall-clock time, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))


# --- deliveries and limits -------------------------------------------------------------------------------------------

LEASE, BACKOFF, UNTIL = 2 * 86400, 43200, 1_706_745_600
DELIVERIES = f"""WITH RECURSIVE b AS (SELECT user_id * 100000 + event_id // 1000 AS event_id, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
  CASE WHEN event_type IN ('purchase', 'error') THEN 'finish' WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'cancel' ELSE 'claim' END AS action, event_type = 'purchase' AND event_id % 2 = 0 AS good, event_id % 4 <> 1 AS retryable FROM events),
r AS (SELECT *, row_number() OVER w AS n, CASE action WHEN 'claim' THEN seq WHEN 'finish' THEN CASE WHEN seq % 5 = 0 THEN -1 ELSE last_value(CASE WHEN action = 'claim' THEN seq END IGNORE NULLS) OVER (PARTITION BY event_id ORDER BY sec, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END END AS token FROM b WINDOW w AS (PARTITION BY event_id ORDER BY sec, seq)),
f AS (SELECT DISTINCT event_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS sec, '' AS outcome, 'pending' AS status, 0 AS attempts, CAST(NULL AS BIGINT) AS token, CAST(NULL AS BIGINT) AS due FROM b
UNION ALL SELECT event_id, n, seq, sec, outcome, CASE WHEN outcome IN ('sent', 'dead_lettered', 'cancelled') THEN outcome WHEN outcome = 'retry' THEN 'pending' WHEN outcome = 'leased' THEN 'sending' ELSE status END, attempts + CASE WHEN outcome = 'leased' THEN 1 ELSE 0 END,
  CASE WHEN outcome = 'leased' THEN asked WHEN outcome IN ('sent', 'dead_lettered', 'cancelled', 'retry') THEN NULL ELSE token END,
  CASE WHEN outcome = 'leased' THEN sec + {LEASE} WHEN outcome = 'retry' THEN sec + CAST(pow(2, attempts) AS BIGINT) * {BACKOFF} WHEN outcome IN ('sent', 'dead_lettered', 'cancelled') THEN NULL ELSE due END
  FROM (SELECT r.event_id, r.n, r.seq, r.sec, f.status, f.attempts, f.token, f.due, r.token AS asked, CASE WHEN action = 'finish' AND (f.status <> 'sending' OR r.token IS DISTINCT FROM f.token) THEN 'fenced' WHEN action = 'finish' AND good THEN 'sent'
    WHEN action = 'finish' AND (NOT retryable OR f.attempts >= 3) THEN 'dead_lettered' WHEN action = 'finish' THEN 'retry' WHEN f.status IN ('sent', 'dead_lettered', 'cancelled') THEN 'already_' || f.status
    WHEN f.due > r.sec THEN 'not_due' WHEN action = 'cancel' THEN 'cancelled' WHEN f.attempts >= 3 THEN 'dead_lettered' ELSE 'leased' END AS outcome FROM f JOIN r ON r.event_id = f.event_id AND r.n = f.n + 1))"""


def delivery_ops(spark, sf):
    """Claims, finishes and cancels from the events: some finishes hold a token that was never given."""
    e, t, k = table(spark, sf, "events"), F.col("event_type"), F.col("event_id")
    action = F.when(t.isin("purchase", "error"), "finish").when((t == "signup") & (k % 3 == 0), "cancel").otherwise("claim")
    ops = e.select((F.col("user_id") * 100000 + F.floor(k / 1000)).alias("event_id"), k.alias("seq"), _seconds("ts").alias("at"), action.alias("action"), ((t == "purchase") & (k % 2 == 0)).alias("good"), (k % 4 != 1).alias("retryable"))
    last = F.last(F.when(F.col("action") == "claim", F.col("seq")), ignorenulls=True).over(W.partitionBy("event_id").orderBy("at", "seq").rowsBetween(W.unboundedPreceding, -1))
    return ops.withColumn("token", F.when(F.col("action") == "claim", F.col("seq")).when(F.col("action") == "finish", F.when(F.col("seq") % 5 == 0, -1).otherwise(last)))


@query(DELIVERIES + f""" SELECT event_id, seq, sec AS "at", outcome, status, attempts FROM f WHERE n > 0
UNION ALL SELECT event_id, NULL, due, CASE status WHEN 'sending' THEN 'lease_expired' ELSE 'retry_due' END, status, attempts FROM (SELECT *, lead(sec) OVER (PARTITION BY event_id ORDER BY n) AS following FROM f WHERE n > 0) WHERE due > sec AND due <= coalesce(following, {UNTIL})""")
def d26_leases(spark, sf):
    """D26, 2.T: leases with fences, waits, dead letters, and what time alone changes; the oracle folds operation by operation."""
    return delivery.delivery_log(delivery_ops(spark, sf), UNTIL, lease_s=LEASE, backoff_s=BACKOFF)


LIMIT, LIMIT_S = 2, 7 * 86400


@query(f"""WITH RECURSIVE r AS (SELECT event_type AS scope, user_id AS actor, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS sec, row_number() OVER (PARTITION BY event_type, user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS n FROM events),
f AS (SELECT scope, actor, seq, n, sec AS window_start, 1 AS hits FROM r WHERE n = 1 UNION ALL SELECT r.scope, r.actor, r.seq, r.n, CASE WHEN r.sec >= f.window_start + {LIMIT_S} THEN r.sec ELSE f.window_start END, CASE WHEN r.sec >= f.window_start + {LIMIT_S} THEN 1 ELSE f.hits + 1 END FROM f JOIN r ON r.scope = f.scope AND r.actor = f.actor AND r.n = f.n + 1)
SELECT scope, actor, seq, window_start, hits, hits <= {LIMIT} AS allowed FROM f""")
def t_fixed_window(spark, sf):
    """2.T: hits in windows that start with a hit, and whether the limit allows each."""
    hits = table(spark, sf, "events").select(F.col("event_type").alias("scope"), F.col("user_id").alias("actor"), F.col("event_id").alias("seq"), _seconds("ts").alias("at"))
    return delivery.limited(hits, LIMIT, LIMIT_S)


# --- timelines -------------------------------------------------------------------------------------------------------

LINKED = """links AS (SELECT o_orderkey * 10 + 1 AS child, o_custkey * 10 + 2 AS parent, CASE WHEN o_orderstatus = 'F' THEN 'retracted' ELSE 'active' END AS status, o_orderkey * 10 AS link_id, o_orderdate AS created_at FROM orders
  UNION ALL SELECT c_custkey * 10 + 2, c_nationkey * 10 + 3, CASE WHEN c_custkey % 3 < 2 THEN 'active' ELSE 'retracted' END, c_custkey * 10 + 1, TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (c_custkey % 100) FROM customer
  UNION ALL SELECT n_nationkey * 10 + 3, n_regionkey * 10 + 4, CASE WHEN n_nationkey % 2 = 0 THEN 'active' ELSE 'retracted' END, n_nationkey * 10 + 2, TIMESTAMP '1990-01-01' FROM nation)"""
TIMELINES = f"""WITH RECURSIVE {LINKED}, e AS (SELECT child AS a, parent AS b FROM links WHERE status = 'active' UNION ALL SELECT parent, child FROM links WHERE status = 'active'),
nodes AS (SELECT child AS node FROM links UNION SELECT parent FROM links), lows AS (SELECT node FROM nodes WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.a = node AND e.b < node)),
reach AS (SELECT node, node AS seed FROM lows UNION SELECT e.b, r.seed FROM reach r JOIN e ON e.a = r.node), placed AS (SELECT node, min(seed) AS timeline FROM reach GROUP BY node),
t AS (SELECT *, count(*) OVER (PARTITION BY timeline) AS size FROM placed)"""


def _link_table(spark, sf):
    o, c, n = (table(spark, sf, x) for x in ("orders", "customer", "nation"))
    state = lambda live: F.when(live, "active").otherwise("retracted").alias("status")
    node = lambda c, kind: F.col(c) * 10 + kind
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    rows = o.select(node("o_orderkey", 1).alias("child"), node("o_custkey", 2).alias("parent"), state(F.col("o_orderstatus") != "F"), (F.col("o_orderkey") * 10).alias("link_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))
    rows = rows.unionAll(c.select(node("c_custkey", 2), node("c_nationkey", 3), state(F.col("c_custkey") % 3 < 2), F.col("c_custkey") * 10 + 1, at("1995-01-01") + F.make_dt_interval((F.col("c_custkey") % 100).cast("int"))))
    return rows.unionAll(n.select(node("n_nationkey", 3), node("n_regionkey", 4), state(F.col("n_nationkey") % 2 == 0), F.col("n_nationkey") * 10 + 2, at("1990-01-01")))


def _placed(links):
    return linking.timelines(links, links.select(F.col("child").alias("node")))


@query(TIMELINES + " SELECT node, timeline, size, size <= 1000 AS shown FROM t")
def j17_timeline(spark, sf):
    """Orders, customers, nations and regions that active links connect, in either direction; the oracle walks every edge."""
    return _placed(_link_table(spark, sf))


@query(TIMELINES + """, own AS (SELECT DISTINCT t.timeline, CASE WHEN status = 'active' THEN 'active' ELSE 'historical' END AS kind, link_id, created_at FROM links JOIN t ON t.node = child OR (status <> 'active' AND t.node = parent) WHERE size <= 1000)
SELECT timeline, kind, row_number() OVER (PARTITION BY timeline, kind ORDER BY created_at, link_id) AS position, link_id FROM own""")
def d17_timeline_links(spark, sf):
    """The active links of every timeline that is shown, and the retracted ones that touch it."""
    links = _link_table(spark, sf)
    return linking.timeline_links(links, _placed(links))


# --- triggers --------------------------------------------------------------------------------------------------------

NOW = "1998-01-01"
TRIGGERED = f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS u, o_orderdate AS d, o_totalprice AS p FROM orders), stages AS (SELECT *, CASE k % 6 WHEN 3 THEN 'award' WHEN 4 THEN 'contract' WHEN 5 THEN 'amendment' ELSE 'tender' END AS stage,
  CASE WHEN k % 4 = 0 THEN 'initial' WHEN k % 11 = 0 THEN 'historical' ELSE 'current' END AS kind, d + INTERVAL 30 DAY AS transition_at, d + INTERVAL 1 DAY * (k % 90) AS effective_at, d + INTERVAL 1 DAY * (k % 60) AS watched_at FROM o),
watches AS (SELECT u, k, watched_at FROM stages WHERE k % 5 <> 4), inform AS (SELECT * FROM stages WHERE transition_at <= TIMESTAMP '{NOW}' AND effective_at <= TIMESTAMP '{NOW}'),
told AS (SELECT *, list_filter([CASE WHEN k % 3 < 2 OR k % 5 = 0 THEN 'watched_material_change' END, CASE WHEN k % 3 = 0 AND k % 7 >= 3 THEN 'deadline_changed' END, CASE WHEN k % 3 = 1 THEN 'eligibility_changed' END], lambda x: x IS NOT NULL) AS triggers,
  '{{"documents":' || CASE WHEN k % 5 = 0 THEN '{{"added":[{{"name":"n' || k || '"}}],"removed":[]}}' ELSE '{{"added":[],"removed":[]}}' END || ',"fields":' || CASE k % 3 WHEN 0 THEN '{{"closes_at":{{"after":"b","before":"a' || k || '"}}}}' WHEN 1 THEN '{{"budget":{{"after":' || k || ',"before":1}}}}' ELSE '{{}}' END
  || ',"from_version_id":"' || k || '1","impact":"' || CASE WHEN k % 7 < 3 THEN 'low' WHEN k % 7 < 5 THEN 'medium' ELSE 'high' END || '","reasons":' || CASE k % 3 WHEN 0 THEN '["deadline_later"]' WHEN 1 THEN '["budget_increased","x"]' ELSE '[]' END || ',"to_version_id":"' || k || '2"}}' AS identity FROM inform WHERE kind = 'current' AND k % 10 < 8 AND k % 13 <> 0 AND k % 9 <> 0),
up AS (SELECT c.k AS child, p.k AS parent FROM stages c JOIN stages p ON p.k = c.k - 1 WHERE c.k % 6 IN (3, 4) AND c.k % 8 <> 0 AND c.k % 7 <> 0),
reach AS (SELECT k AS outcome, k AS at_ FROM stages UNION ALL SELECT child, parent FROM up UNION ALL SELECT a.child, b.parent FROM up a JOIN up b ON b.child = a.parent),
t AS (SELECT u AS user_id, k AS opportunity_id, 'new_high_relevance' AS trigger, '{{"canonical_key":"order-' || k || '"}}' AS identity FROM stages WHERE effective_at <= TIMESTAMP '{NOW}' AND stage NOT IN ('award', 'contract') AND p > 150000
UNION ALL SELECT w.u, w.k, unnest(triggers), identity FROM told JOIN watches w ON w.k = told.k AND w.watched_at <= transition_at
UNION ALL SELECT w.u, w.k, 'outcome_published', '{{"outcome_id":"' || s.k || '","stage":"' || stage || '"}}' FROM inform s JOIN reach ON outcome = s.k JOIN watches w ON w.k = at_ AND w.watched_at <= s.transition_at WHERE stage IN ('award', 'contract') AND kind <> 'historical')"""


def _triggers(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    day = lambda n: F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(n.cast("int") if not isinstance(n, int) else F.lit(n))
    items = o.select(k.alias("opportunity_id"), text("order-", k).alias("canonical_key"), F.when(k % 6 == 3, "award").when(k % 6 == 4, "contract").when(k % 6 == 5, "amendment").otherwise("tender").alias("stage"))
    versions = o.select(k.alias("opportunity_id"), (k * 10 + 2).alias("version_id"), F.when(k % 4 == 0, "initial").when(k % 11 == 0, "historical").otherwise("current").alias("transition_kind"), day(30).alias("transition_at"), day(k % 90).alias("effective_at"))
    r = F.col("r")
    fields = F.when(k % 3 == 0, text('{"closes_at": {"before": "a', k, '", "after": "b", "after_evidence": [{"quote": "q', r, '"}]}}')).when(k % 3 == 1, text('{"budget": {"before_evidence": {"page": ', r, '}, "after": ', k, ', "before": 1}}')).otherwise("{}")
    documents = F.when(k % 5 == 0, text('{"removed": [], "added": [{"name": "n', k, '", "evidence": ', r, "}]}")).otherwise('{"removed": [], "added": []}')
    # two revisions of each delta: the second repairs evidence alone
    deltas = o.where(k % 10 < 8).withColumn("r", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        k.alias("opportunity_id"), (k * 10 + r).alias("delta_id"), (k * 10 + 1).alias("from_version_id"), (k * 10 + F.when(k % 13 == 0, 1).otherwise(2)).alias("to_version_id"), F.when(k % 9 == 0, "historical").otherwise("current_transition").alias("comparison_kind"),
        day(30 + r).alias("created_at"), fields.alias("field_changes"), documents.alias("document_changes"), F.when(k % 7 < 3, "low").when(k % 7 < 5, "medium").otherwise("high").alias("impact_level"),
        F.when(k % 3 == 0, F.array(F.lit("deadline_later"))).when(k % 3 == 1, F.array(F.lit("budget_increased"), F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("reason_codes"),
    )
    watches = o.where(k % 5 != 4).select(F.col("o_custkey").alias("user_id"), k.alias("opportunity_id"), day(k % 60).alias("created_at"))
    rankings = o.select(F.col("o_custkey").alias("user_id"), k.alias("opportunity_id"), (F.col("o_totalprice") > 150000).alias("recommended"))
    links = o.where((k % 6).isin(3, 4)).select(k.alias("child"), (k - 1).alias("parent"), (k * 10 + 2).alias("child_version_id"), ((k - 1) * 10 + F.when(k % 8 == 0, 1).otherwise(2)).alias("parent_version_id"), F.when(k % 7 == 0, "retracted").otherwise("active").alias("status"))
    return triggers.derive(items, versions, deltas, rankings, links, watches, F.lit(NOW).cast("timestamp_ntz"))


@query(TRIGGERED + " SELECT * FROM t")
def d23_triggers(spark, sf):
    """What versions, deltas, rankings and outcomes tell to whom."""
    return _triggers(spark, sf).drop("seq")


@query(TRIGGERED + """, p AS (SELECT c_custkey AS user_id, c_custkey % 7 <> 0 AS enabled, CASE WHEN c_custkey % 3 = 0 THEN ['local', 'webhook'] WHEN c_custkey % 3 = 1 THEN ['email'] ELSE CAST([] AS VARCHAR[]) END AS channels, CASE WHEN c_custkey % 5 = 0 THEN ['watched_material_change'] ELSE ['deadline_changed', 'outcome_published', 'new_high_relevance'] END AS wanted FROM customer WHERE c_custkey % 2 = 0)
SELECT DISTINCT user_id, opportunity_id, unnest(coalesce(channels, ['local'])) AS channel, trigger, identity FROM t LEFT JOIN p USING (user_id) WHERE coalesce(enabled, true) AND coalesce(list_contains(wanted, trigger), true)""")
def d25_derived_outbox(spark, sf):
    """D23 into D25: derived triggers by the channels that preferences allow, each identity once."""
    k, lits = F.col("c_custkey"), lambda *x: F.array(*map(F.lit, x))
    prefs = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(k.alias("user_id"), (k % 7 != 0).alias("enabled"), F.when(k % 3 == 0, lits("local", "webhook")).when(k % 3 == 1, lits("email")).otherwise(F.array().cast("array<string>")).alias("channels"), F.when(k % 5 == 0, lits("watched_material_change")).otherwise(lits("deadline_changed", "outcome_published", "new_high_relevance")).alias("triggers"))
    return triggers.outbox_events(_triggers(spark, sf), prefs).drop("dedupe_key")


# --- nested values ---------------------------------------------------------------------------------------------------

_URL = "'http://h/' || user_id"


@query(f"""WITH v AS (SELECT event_id, user_id, {_URL} AS url, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, 'd' || user_id AS d, event_type AS t FROM events),
w AS (SELECT *, '{{"attachments":["' || url || '"],' AS a, '"evidence":[{{"b":[1,2.5,null,true],"quote":"q","token":' AS b, '"props":{{"k":' || k || '}},"source_url":"' || url || '","title":"T' AS c, '/api/v1/documents/' || d || '/original' AS h FROM v)
SELECT event_id, sha256(a || b || event_id || '}}],' || c || chr(233) || ' ' || t || '","z":' || event_id || '}}') AS digest, sha256('kind' || chr(0) || 'source' || chr(0) || a || b || event_id || '}}],' || c || '\\u00e9 ' || t || '","z":' || event_id || '}}') AS job_key,
  CASE WHEN user_id % 2 = 0 THEN '{{"attachment_id":"' || d || '","attachments":[{{"attachment_id":"' || d || '","original_url":"' || h || '","sha256":"s"}}],"evidence":[{{"quote":"q"}}],"original_url":"' || h || '","sha256":"s","title":"T' || chr(233) || ' ' || t || '"}}'
    ELSE '{{"attachments":[{{}}],"evidence":[{{"quote":"q"}}],"title":"T' || chr(233) || ' ' || t || '"}}' END AS shown,
  a || b || '"[REDACTED]"}}],' || c || chr(233) || ' ' || t || '","z":' || event_id || '}}' AS redacted, a || c || chr(233) || ' ' || t || '","z":' || event_id || '}}' AS semantic FROM w""")
def f6_nested_values(spark, sf):
    """Digests, public form, redaction and meaning of JSON values of any depth."""
    e = table(spark, sf, "events")
    url = F.concat(F.lit("http://h/"), F.col("user_id").cast("string"))
    value = F.concat(F.lit('{"z": '), F.col("event_id").cast("string"), F.lit(', "title": "T\\u00e9 '), F.col("event_type"), F.lit('", "source_url": "'), url, F.lit('", "props": '), F.col("props"), F.lit(', "attachments": ["'), url, F.lit('"], "evidence": [{"token": '), F.col("event_id").cast("string"), F.lit(', "quote": "q", "b": [1, 2.5, null, true]}]}'))
    documents = F.when(F.col("user_id") % 2 == 0, F.to_json(F.array(F.struct(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("id"), F.lit("s").alias("sha256"), url.alias("source_url"), F.lit(True).alias("stored")))))
    v = e.select("event_id", value.alias("v"), documents.alias("d"))
    c = F.col("v")
    return v.select("event_id", nested.digest(c).alias("digest"), nested.job_key(F.lit("kind"), F.lit("source"), c).alias("job_key"), nested.public(c, F.col("d")).alias("shown"), nested.redacted(c).alias("redacted"), nested.without(c, "evidence").alias("semantic"))


# --- kept decisions --------------------------------------------------------------------------------------------------


def _decided_twice(spark, sf):
    """A store after two runs, and what the second asked: some orders are new to it, some have changed."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    inputs = lambda amount: o.select(k.alias("id"), amount.cast("decimal(18,2)").alias("amount")).withColumn("fingerprint", reuse.fingerprint(F.col("amount"), F.lit("rules-1")))
    compute = lambda rows: rows.select("id", "fingerprint", (F.col("amount") < 100000).alias("eligible"))
    store = reuse.Store(spark, new_table(spark, "decisions"), ["id"])
    store.materialize(inputs(F.col("o_totalprice")).where("id % 3 <> 0"), compute)
    now = inputs(F.col("o_totalprice") + F.when(k % 5 == 0, 1).otherwise(0))
    return store, now, store.materialize(now, compute)


@query("SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END < 100000 AS eligible, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS reused FROM orders")
def d12_reuse(spark, sf):
    """A second run decides what is new or changed, and takes the rest from the store."""
    return _decided_twice(spark, sf)[2].select("id", "eligible", "reused")


@query("SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) < 100000 AS eligible FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0")
def d14_stale(spark, sf):
    """Stored decisions whose inputs have changed since."""
    store, now, _ = _decided_twice(spark, sf)
    return store.stale(now).select("id", "eligible")


@query("""WITH v AS (SELECT o_orderkey AS k, o_orderdate + INTERVAL 1 SECOND * (o_orderkey % 86400) AS as_of, CASE o_orderkey % 3 WHEN 0 THEN 'open' ELSE 'expired' END AS state, o_orderkey % 4 AS m FROM orders)
SELECT k AS id, CASE m WHEN 0 THEN 'exact:' || strftime(as_of, '%Y-%m-%dT%H:%M:%S+00:00') WHEN 1 THEN 'daily:' || strftime(as_of, '%Y-%m-%d') || ':' || state WHEN 2 THEN 'mine' END AS epoch, CASE WHEN m = 3 THEN 'epoch_mismatch' END AS error,
CASE WHEN k % 17 = 0 THEN 'stale_eligibility' WHEN k % 5 = 0 THEN 'other_version' WHEN k % 7 = 0 THEN 'stale_provenance' WHEN k % 11 = 0 THEN 'not_available' END AS refused FROM v""")
def d14_epochs(spark, sf):
    """Exact and daily epochs, and why a version isn't ranked."""
    k = F.col("o_orderkey")
    at = F.timestamp_seconds(_seconds("o_orderdate") + k % 86400)
    o = table(spark, sf, "orders").select(k.alias("id"), at.alias("as_of"), F.when(k % 3 == 0, "open").otherwise("expired").alias("state"))
    k = F.col("id")
    asked = F.when(k % 4 == 1, F.concat(F.lit("daily:"), F.date_format("as_of", "yyyy-MM-dd"))).when(k % 4 == 2, "mine").when(k % 4 == 3, "daily:1900-01-01")
    refused = reuse.ranking_error(k, F.when(k % 5 != 0, k), F.lit("n"), F.when(k % 7 != 0, "n"), F.when(k % 11 == 0, F.col("as_of") + F.expr("interval 1 second")).otherwise(F.col("as_of")), F.col("as_of"), k % 17 == 0)
    return o.select("id", reuse.ranking_epoch(F.col("as_of"), asked, F.col("state")).alias("e"), refused.alias("refused")).select("id", "e.epoch", "e.error", "refused")


@query("""WITH v AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), w AS (SELECT *, CASE WHEN n = 1 THEN 'initial' WHEN k % 4 = 1 THEN 'historical' WHEN k % 4 = 2 THEN 'old' ELSE 'current' END AS kind FROM v),
b AS (SELECT *, CASE WHEN kind = 'current' THEN CASE WHEN k % 6 <> 0 THEN last_value(CASE WHEN kind IN ('initial', 'current') THEN k END IGNORE NULLS) OVER (PARTITION BY c ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END ELSE lag(k) OVER (PARTITION BY c ORDER BY n) END AS before FROM w)
SELECT k AS version_id, before AS from_version_id, CASE kind WHEN 'current' THEN 'current_transition' WHEN 'historical' THEN 'historical' ELSE 'legacy_unknown' END AS comparison_kind, CASE WHEN before IS NULL THEN 'no_predecessor' WHEN k % 5 = 0 THEN 'pending' WHEN k % 7 = 0 THEN 'existing' ELSE 'created' END AS status FROM b WHERE kind <> 'initial'""")
def d8_delta_status(spark, sf):
    """Which version each one is compared with, and what becomes of the delta."""
    w, k = W.partitionBy("opportunity_id").orderBy("version_id"), F.col("version_id")
    v = table(spark, sf, "orders").select(F.col("o_custkey").alias("opportunity_id"), F.col("o_orderkey").alias("version_id")).withColumn("version_number", F.row_number().over(w))
    v = v.withColumn("transition_kind", F.when(F.col("version_number") == 1, "initial").when(k % 4 == 1, "historical").when(k % 4 == 2, "old").otherwise("current"))
    last = F.last(F.when(F.col("transition_kind").isin("initial", "current"), k), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    pairs = reuse.comparison_pairs(v.withColumn("previous_current_version_id", F.when(k % 6 != 0, last)))
    return pairs.select("version_id", "from_version_id", "comparison_kind", reuse.delta_status(F.col("transition_kind"), F.col("from_version_id"), k % 5 != 0, k % 7 == 0).alias("status"))


# --- documents and what others send ----------------------------------------------------------------------------------


@query("""WITH p AS (SELECT page_id, lower(regexp_replace(left(html, 1024), '^[ \\t\\n\\r]+', '')) AS s, CASE page_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN NULL ELSE 'other' END AS h FROM pages)
SELECT page_id, CASE WHEN starts_with(s, '<!doctype html') OR starts_with(s, '<html') OR starts_with(s, '<h1') OR starts_with(s, '<p') THEN 'text/html' WHEN h = 'application/pdf' THEN h END AS media_type FROM p""")
def f21_media_types(spark, sf):
    """pages by their first bytes, else by a header that may be believed."""
    k = F.col("page_id")
    header = F.when(k % 3 == 0, "Application/PDF; q=1").when(k % 3 == 2, "other")
    return table(spark, sf, "pages").select("page_id", checks.media_type(F.encode("html", "UTF-8"), header).alias("media_type"))


@query("SELECT event_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 700 <= 600 AS valid FROM events")
def f31_signatures(spark, sf):
    """signed bodies; some with another signature, without a time, or too late. The twin knows which."""
    k = F.col("event_id")
    at = (F.lit(1_000_000) + k % 700).cast("string")
    right = checks.hmac_sha256(F.concat(at, F.lit("."), F.col("props")).cast("binary"), "a secret")
    header = F.concat(F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("t="), at, F.lit(","))), F.lit("v1="), F.when(k % 5 == 0, "0" * 64).otherwise(right))
    return table(spark, sf, "events").select("event_id", checks.signed(F.col("props"), header, "a secret", F.lit(1_000_300)).alias("valid"))


@query("""WITH a AS (SELECT o_orderkey AS k, unnest(['estimated_amount', 'currency', 'title', 'regions']) AS field, unnest([CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) || '0', 'KRW', CASE WHEN o_orderkey % 7 = 0 THEN 'other' ELSE 'T' || o_orderkey END, '["b","a"]']) AS value FROM orders)
SELECT k, field, value, field <> 'regions' AS known, CASE WHEN field IN ('estimated_amount', 'currency') THEN k % 5 = 0 WHEN field = 'title' THEN k % 7 = 0 ELSE k % 3 = 0 END AS conflict FROM a WHERE field <> 'regions' UNION ALL SELECT k, field, value, k % 2 = 0, k % 2 = 0 AND k % 3 = 0 FROM a WHERE field = 'regions'""")
def d20_conflicts(spark, sf):
    """attachments' claims against upstream ones: amounts as numbers, lists as sets, the budget as a pair."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    rows = lambda *kv: o.select(k.alias("k"), F.inline(F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(f).alias("field"), v.alias("value"))) for f, v in kv)))))
    upstream = rows(("estimated_amount", price.cast("string")), ("currency", F.lit("KRW")), ("title", F.concat(F.lit("T"), k.cast("string"))), ("regions", F.when(k % 2 == 0, F.when(k % 3 == 0, '["a"]').otherwise('["a","b"]'))))
    attached = rows(("estimated_amount", F.concat((price + F.when(k % 5 == 0, 1).otherwise(0)).cast("string"), F.lit("0"))), ("currency", F.lit("KRW")), ("title", F.when(k % 7 == 0, "other").otherwise(F.concat(F.lit("T"), k.cast("string")))), ("regions", F.lit('["b","a"]')))
    return documents.withhold_conflicts(upstream, attached, ["k"]).select("k", "field", "value", F.col("upstream_value").isNotNull().alias("known"), "conflict")


@query("""WITH l AS (SELECT l_orderkey AS v, l_linenumber AS n, 's' || l_partkey AS s FROM lineitem), c AS (SELECT DISTINCT v, s, n % 2 = 0 AS ocr, CASE WHEN n % 2 = 0 THEN 'ocr1' WHEN n % 3 = 0 THEN 'native1' ELSE 'native2' END AS t FROM l WHERE n % 5 <> 0)
SELECT v AS version_id, string_agg(s || ':1:' || t, ',' ORDER BY s, t) AS bundle FROM c GROUP BY v""")
def d21_bundle(spark, sf):
    """Each version's trusted pages: recognised text before native, then the latest parser; blank pages and repeats go."""
    li, n = table(spark, sf, "lineitem"), F.col("l_linenumber")
    a = li.select((F.col("l_orderkey") * 10 + n).alias("attachment_id"), F.col("l_orderkey").alias("version_id"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("sha256"))
    parse = lambda kind, version, trusted: F.when(trusted, F.struct(F.lit(kind).alias("parser_kind"), F.lit(version).alias("parser_version"), F.when(n % 5 == 0, "needs_ocr").otherwise("trusted").alias("status")))
    each = li.select((F.col("l_orderkey") * 10 + n).alias("attachment_id"), F.inline(F.array_compact(F.array(parse("native", 1, n > 0), parse("native", 2, n % 3 != 0), parse("ocr", 1, n % 2 == 0)))))
    page = lambda number, text: F.struct(F.lit(number).alias("page_number"), text.alias("text"))
    parses = each.withColumn("pages", F.array(page(1, F.concat("parser_kind", F.col("parser_version").cast("string"))), page(2, F.lit(" \t"))))
    text = F.array_join(F.transform("bundle", lambda p: F.concat_ws(":", p["sha256"], p["page_number"].cast("string"), p["text"])), ",")
    return documents.document_bundle(a.distinct(), parses).select("version_id", text.alias("bundle"))


@query("""WITH n AS (SELECT o_orderkey AS k, 'services:N' || o_orderkey || ':' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS official_id, CASE WHEN o_orderkey % 3 = 0 THEN 'office' ELSE 'buyer ' || o_custkey END AS buyer, CASE WHEN o_orderkey % 4 = 0 THEN 'amendment' ELSE 'tender' END AS stage, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p, o_orderkey % 13 = 0 AS odd FROM orders)
SELECT k, CASE WHEN NOT odd THEN official_id END AS official_id, buyer AS buyer_name, stage AS lifecycle_stage, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN NULL WHEN contains(p, '.') THEN rtrim(rtrim(p, '0'), '.') ELSE p END AS estimated_amount, CASE WHEN k % 6 = 0 THEN '2026-01-01 20:00:00' ELSE '2026-01-01 18:04:05' END AS effective_at,
  CASE WHEN k % 2 = 0 THEN 'a' || k || '.pdf,specification-10' ELSE '' END AS files, array_to_string(list_filter([CASE WHEN odd THEN 'identity_invalid' END, CASE WHEN NOT odd AND k % 17 = 0 THEN 'identity_differs' END, CASE WHEN k % 11 = 0 THEN 'closes_at_invalid' END, CASE WHEN k % 5 <> 0 AND k % 7 = 0 THEN 'estimated_amount_invalid' END], lambda x: x IS NOT NULL), ',') AS errors,
  CASE WHEN k % 3 = 0 THEN '/ntceInsttNm' ELSE '/dminsttNm' END AS buyer_pointer, CASE WHEN k % 5 <> 0 THEN '/presmptPrce' END AS currency_pointer FROM n""")
def p2_government(spark, sf):
    """The government feed's payloads by canonical names, with attachments, evidence and errors."""
    k, text = F.col("o_orderkey"), lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    number = F.when(k % 13 == 0, "N 1").otherwise(text("N", k))
    order = F.lpad((k % 1000).cast("string"), 3, "0")
    url = lambda i: F.when(k % 2 == 0, text("https://files/", k, f"/{i}"))
    payload = F.to_json(F.struct(
        text(" Notice ", k, " ").alias("bidNtceNm"), number.alias("bidNtceNo"), order.alias("bidNtceOrd"), F.when(k % 4 == 0, "변경공고").otherwise("일반").alias("ntceKindNm"), F.when(k % 3 == 0, "  ").otherwise(text("buyer ", F.col("o_custkey"))).alias("dminsttNm"), F.lit("office").alias("ntceInsttNm"),
        F.when(k % 5 == 0, "").when(k % 7 == 0, "-5").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("presmptPrce"), F.lit("2026-01-02 03:04:05").alias("bidNtceDt"), F.when(k % 11 == 0, "2026/01/01").otherwise("2026-02-01 00:00:00").alias("bidClseDt"),
        F.when(k % 6 == 0, "2026-01-02 05:00:00").alias("chgDt"), url(1).alias("ntceSpecDocUrl1"), text("a", k, ".pdf").alias("ntceSpecFileNm1"), url(10).alias("ntceSpecDocUrl10"), url(11).alias("ntceSpecDocUrl11"),
    ))
    raw = table(spark, sf, "orders").select(k.alias("k"), payload.alias("payload"), F.when(k % 17 == 0, "services:other:000").otherwise(text("services:N", k, ":", order)).alias("record_id"))
    n = government.map_notices(raw, record_id="record_id")
    at = F.replace(utc_text(F.col("effective_at")), F.lit("T"), F.lit(" "))
    return n.select("k", "official_id", "buyer_name", "lifecycle_stage", "estimated_amount", at.alias("effective_at"), F.array_join(F.transform("attachments", lambda a: a["filename"]), ",").alias("files"), F.array_join("errors", ",").alias("errors"), F.col("evidence")["buyer_name"]["json_pointer"].alias("buyer_pointer"), F.try_element_at("evidence", F.lit("currency"))["json_pointer"].alias("currency_pointer"))


@query("""WITH d AS (SELECT o_custkey AS user_id, o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'amendment' ELSE 'tender' END AS stage, CASE o_orderkey % 7 WHEN 0 THEN 'documents_pending' WHEN 1 THEN 'odd' ELSE 'ready' END AS status, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 3 = 0 END AS eligible, o_orderkey % 5 = 0 AS hard, o_orderkey % 9 = 0 AS warn, o_orderkey % 2 = 0 AS seen, o_orderkey % 6 = 0 AS again FROM orders)
SELECT user_id, k AS opportunity_id, CASE WHEN status <> 'ready' OR eligible IS NULL THEN 'pending' WHEN hard THEN 'danger' WHEN warn THEN 'pending' WHEN eligible THEN 'success' ELSE 'neutral' END AS tone, CASE WHEN status = 'documents_pending' THEN '문서 처리 중' WHEN status = 'odd' OR eligible IS NULL THEN '판단 대기' WHEN hard THEN '필수 조건 불일치' WHEN warn THEN '확인 필요' WHEN eligible THEN '필수 조건 충족' ELSE '참여 비추천' END AS label,
  CASE WHEN NOT seen THEN 'new' WHEN NOT again THEN 'changed' END AS visit FROM d WHERE status <> 'ready' OR eligible IS NULL OR (NOT hard AND (warn OR NOT eligible))""")
def d35_review_list(spark, sf):
    """Every user's items for review, with labels and what is new since the last visit."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    some = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    items = o.select(k.alias("opportunity_id"), F.when(k % 4 == 0, "amendment").otherwise("tender").alias("stage"), at.alias("changed_at"))
    decisions = o.select(F.col("o_custkey").alias("user_id"), k.alias("opportunity_id"), F.when(k % 7 == 0, "documents_pending").when(k % 7 == 1, "odd").otherwise("ready").alias("status"), F.when(k % 11 > 0, k % 3 == 0).alias("eligible"), some(k % 5 == 0).alias("hard_failures"), some(k % 9 == 0).alias("warnings"))
    visit = lambda when, days: o.where(when).select(F.col("o_custkey").alias("user_id"), k.alias("opportunity_id"), (at + F.make_dt_interval(F.lit(days))).alias("visited_at"))
    return presentation.inbox(items, decisions, visit(k % 2 == 0, -1).unionAll(visit(k % 6 == 0, 1)), "review").select("user_id", "opportunity_id", "tone", "label", "visit")


@query("""WITH v AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), last AS (SELECT c, max(k) AS k FROM v GROUP BY c)
SELECT c AS opportunity_id, 'version' AS kind, row_number() OVER (PARTITION BY c ORDER BY n DESC) AS position, k AS id FROM v UNION ALL SELECT c_nationkey, 'link', row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 100, c_custkey), c_custkey FROM customer
UNION ALL SELECT c, 'document', row_number() OVER (PARTITION BY c ORDER BY l_linenumber), l_linenumber FROM last JOIN lineitem ON l_orderkey = k""")
def d35_detail(spark, sf):
    """The versions, links and current documents of every item, in the order of its page."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    v = o.select(F.col("o_custkey").alias("opportunity_id"), F.col("o_orderkey").alias("version_id"))
    versions = v.withColumn("version_number", F.row_number().over(W.partitionBy("opportunity_id").orderBy("version_id")))
    items = v.groupBy("opportunity_id").agg(F.max("version_id").alias("current_version_id"))
    links = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("opportunity_id"), F.col("c_custkey").alias("link_id"), (F.col("c_custkey") % 100).alias("created_at"))
    documents_ = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("opportunity_id"), F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").cast("long").alias("document_id"))
    return presentation.detail(items, versions, links, documents_)
