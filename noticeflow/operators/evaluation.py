"""Stored evaluations held against their rows (A14, A15, A17, A24, A26-A29): totals are made anew, and what doesn't fit is said."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.keyed import fold
from noticeflow.operators.metrics import rate, set_metrics

#: Counts of a route, its rates, the two routes, and how near a stored rate must be.
COUNTS = ("documents", "correct_fields", "expected_fields", "schema_failures", "grounded_accepted_documents", "hosted_calls", "prompt_tokens", "completion_tokens")
RATES = ("field_accuracy", "grounded_acceptance_rate")
ALL, GATED = "hosted_all", "hosted_gated"
NEAR = 1e-12


def _long(c: Column, name: str) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long").alias(name)


def route_totals(rows: DataFrame, *, rolled: bool = False) -> DataFrame:
    """The counts and rates of each artifact's routes, from their rows; `rolled`: those of whole artifacts and of everything, too (null route, null artifact).

    rows: artifact, route, case_id, expected_valid, valid, schema_valid, correct, support, prompt_tokens, completion_tokens, called (whether the
    model was asked). Fields count for cases that are expected to be valid. Tokens are null if one call's are unknown (A18).
    """
    when = lambda c, v=1: F.sum(F.when(c, v))
    called = F.coalesce("called", F.lit(False)) | F.col("prompt_tokens").isNotNull() | F.col("completion_tokens").isNotNull()
    tokens = lambda c: F.when(F.count_if(called & F.col(c).isNull()) == 0, F.coalesce(F.sum(c), F.lit(0)).cast("long")).alias(c)
    grouped = rows.rollup("artifact", "route") if rolled else rows.groupBy("artifact", "route")
    out = grouped.agg(
        F.count(F.lit(1)).alias("documents"), _long(when(F.col("expected_valid"), F.col("correct")), "correct_fields"), _long(when(F.col("expected_valid"), F.col("support")), "expected_fields"), _long(when(~F.col("schema_valid")), "schema_failures"),
        _long(when(F.col("valid")), "grounded_accepted_documents"), F.count_if(called).alias("hosted_calls"), tokens("prompt_tokens"), tokens("completion_tokens"),
    )
    return out.withColumns({"field_accuracy": rate(F.col("correct_fields"), F.col("expected_fields")), "grounded_acceptance_rate": rate(F.col("grounded_accepted_documents"), F.col("documents"))})


def near(a: Column, b: Column) -> Column:
    """Equal within NEAR, of the larger or as it is; null only equals null."""
    gap = F.abs(a - b) <= F.greatest(F.lit(NEAR), F.lit(NEAR) * F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(gap, a.isNull() & b.isNull())


def check_artifacts(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Artifact, route and the issues of what is stored: names of totals that don't follow from the rows, and what is wrong with the rows.

    duplicate_cases: a case comes twice in a route; impossible_counts: more fields right than there are; other_cases: the artifact's
    routes differ in cases, their expected validity or their support; no_rows, not_stored: only one side has the route.
    """
    by = ["artifact", "route"]
    made = route_totals(rows).select(*by, *(F.col(c).alias(f"m_{c}") for c in (*COUNTS, *RATES)))
    kept = stored.select(*by, *(F.col(c).alias(f"s_{c}") for c in (*COUNTS, *RATES)))
    cases = rows.groupBy(*by, "case_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("correct") > F.col("support")).alias("above"), F.max("expected_valid").alias("expected_valid"), F.max("support").alias("support"))
    odd = cases.groupBy(*by).agg(F.max(F.col("n") > 1).alias("duplicate"), F.max(F.coalesce("above", F.lit(False))).alias("above"))
    # a case agrees if all routes of its artifact have it, with the same facts
    routes = rows.select(*by).distinct().groupBy("artifact").agg(F.count(F.lit(1)).alias("routes"))
    same = cases.groupBy("artifact", "case_id").agg(F.count(F.lit(1)).alias("in"), F.count_distinct("expected_valid", "support").alias("facts"))
    differ = same.join(routes, "artifact").groupBy("artifact").agg(F.max((F.col("in") < F.col("routes")) | (F.col("facts") > 1)).alias("differ"))
    both = kept.withColumn("_s", F.lit(True)).join(made.withColumn("_m", F.lit(True)), by, "full").join(odd, by, "left").join(differ, "artifact", "left")
    pair = F.col("_s") & F.col("_m")
    issue = lambda wrong, name: F.when(F.coalesce(wrong, F.lit(False)), name)
    issues = F.array_compact(
        F.array(
            issue(F.col("_m").isNull(), "no_rows"), issue(F.col("_s").isNull(), "not_stored"), issue(F.col("duplicate"), "duplicate_cases"), issue(F.col("above"), "impossible_counts"), issue(F.col("differ"), "other_cases"),
            *(issue(pair & ~F.col(f"s_{c}").eqNullSafe(F.col(f"m_{c}")), c) for c in COUNTS), *(issue(pair & ~near(F.col(f"s_{c}"), F.col(f"m_{c}")), c) for c in RATES),
        )
    )
    return both.select(*by, issues.alias("issues"))


def optimization(totals: DataFrame) -> DataFrame:
    """What the gated route saves against the full one, per artifact: calls, tokens and the reported cost; null where either side isn't known.

    totals: artifact, route, hosted_calls, prompt_tokens, completion_tokens, cost. An increase is a negative reduction.
    """
    side = lambda r, c: F.max(F.when(F.col("route") == r, c))
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    wide = totals.groupBy("artifact").agg(*(side(r, c).alias(f"{p}_{n}") for r, p in ((ALL, "all"), (GATED, "gated")) for c, n in ((F.col("hosted_calls"), "calls"), (tokens, "tokens"), (F.col("cost"), "cost"))))
    saved = lambda n: rate(F.col(f"all_{n}") - F.col(f"gated_{n}"), F.col(f"all_{n}"))
    known = F.col("all_calls").isNotNull() & F.col("gated_calls").isNotNull()
    out = wide.select("artifact", F.when(known, "measured").otherwise("not_run").alias("status"), "all_calls", "gated_calls", (F.col("all_calls") - F.col("gated_calls")).alias("avoided_calls"), "all_tokens", "gated_tokens", saved("calls").alias("call_reduction_rate"), saved("tokens").alias("token_reduction_rate"), F.when(F.col("all_cost") > 0, saved("cost")).alias("reported_cost_reduction_rate"))
    shown = [c for c in out.columns if c not in ("artifact", "status")]
    return out.select("artifact", "status", *(F.when(F.col("status") == "measured", F.col(c)).alias(c) for c in shown))


def delta_evaluation(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: fields found (tp, fp, fn, precision, recall, f1), the same for cases of high impact, and false alerts among cases without a change.

    Both: case_id, fields array<string>, impact.
    """
    each = lambda df: df.select("case_id", F.explode(F.array_distinct("fields")).alias("field"))
    one = lambda df: df.withColumn("_all", F.lit(1))
    names = ("tp", "fp", "fn", "precision", "recall", "f1")
    fields = set_metrics(one(each(predicted)), one(each(expected)), ["case_id", "field"], ["_all"]).select("_all", *(F.col(c).alias(f"field_{c}") for c in names))
    high = lambda df: one(df.where("impact = 'high'").select("case_id"))
    impact = set_metrics(high(predicted), high(expected), ["case_id"], ["_all"]).select("_all", *(F.col(c).alias(f"high_{c}") for c in names))
    quiet = expected.where(F.size("fields") == 0).select("case_id").join(predicted.select("case_id", F.size("fields").alias("n")), "case_id", "left")
    alerts = one(quiet.agg(F.count(F.lit(1)).alias("no_change_support"), F.count_if(F.col("n") > 0).alias("false_alerts")))
    return alerts.join(fields, "_all", "left").join(impact, "_all", "left").drop("_all").withColumn("false_alert_rate", rate(F.col("false_alerts"), F.col("no_change_support")))


class _Rolling:
    """SHA-256 over what came so far."""

    def __init__(self):
        self.hash, self.n = hashlib.sha256(), 0

    def add(self, text: str | None) -> list[tuple]:
        if text is not None:
            self.hash.update(text.encode() + b"\x00")
            self.n += 1
        return []


def rolling_hash(records: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Per group the SHA-256 of its texts in order, each followed by a NUL, and their number. Null texts are left out.

    A hash depends on all before it, so a group is one task's walk: its rows stream through, sorted, and one state is held.
    """
    kinds = dict(records.dtypes)
    rows = records.select(by, order, text)
    return fold(rows, [by], [order], _Rolling, lambda s, row: s.add(row[1]), lambda s: [(s.hash.hexdigest(), s.n)], f"{by} {kinds[by]}, digest string, n long")


def reconcile_counters(links: DataFrame, failures: DataFrame, rankings: DataFrame) -> DataFrame:
    """One row: nodes linked and unresolved, jobs that ended well and failed, recommendations among rankings. Each table is counted once, in its tasks."""
    a = links.agg(F.count("parent").alias("linked"), F.count_if(F.col("parent").isNull()).alias("unresolved"))
    b = failures.agg(F.count_if(~F.coalesce("failed", F.lit(False))).alias("created"), F.count_if("failed").alias("failed"))
    c = rankings.agg(F.count_if("recommended").alias("recommended"), F.count(F.lit(1)).alias("ranked"))
    return a.crossJoin(b).crossJoin(c)  # three rows in all


def billing_scope(outcomes: DataFrame) -> DataFrame:
    """Per invoice the observations of billing_outcomes, those applied and for review among them, and the credits."""
    return outcomes.groupBy("invoice_id").agg(F.count(F.lit(1)).alias("observations"), F.count_if(F.col("outcome") == "applied").alias("applications"), F.count_if(F.col("outcome") == "review").alias("review_required"), F.sum("credit_units").alias("credit_units"))
