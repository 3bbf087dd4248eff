"""Folds of mutable state over logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Attempts before a job is dead-lettered, and the preferences of users without a row.
MOST_ATTEMPTS = 3
DEFAULT_CHANNELS = ("local",)
TRIGGERS = ("watched_material_change", "deadline_changed", "eligibility_changed", "new_high_relevance", "outcome_published")


#: Fixed value: the largest balance and amount.
MOST_CREDITS = 2_147_483_647


class _Account:
    """One account's balances, reservations and the input of each idempotency key."""

    def __init__(self):
        self.available = self.reserved = 0
        self.inputs: dict[str, tuple] = {}
        self.reservations: dict[str, list] = {}

    def apply(self, operation: str, amount: int | None, key: str, reservation: str | None, reference: tuple) -> tuple[str, str | None]:
        """(applied, None), (repeat, None) or (rejected, why); only an applied operation changes anything."""
        settles = operation in ("commit", "refund")
        held = self.reservations.get(reservation)
        if settles:
            if held is None:
                return "rejected", "reservation_not_found"
            amount, reference = held[0], held[1]
        elif amount is None or not 1 <= amount <= MOST_CREDITS:
            return "rejected", "invalid_amount"
        asked = (operation, amount, *reference)
        if key in self.inputs:
            return ("repeat", None) if self.inputs[key] == asked else ("rejected", "idempotency_conflict")
        if operation == "grant":
            if self.available > MOST_CREDITS - amount:
                return "rejected", "balance_overflow"
            self.available += amount
        elif operation == "reserve":
            if held is not None:
                return "rejected", "reservation_exists"
            if self.available < amount:
                return "rejected", "insufficient_credits"
            self.available -= amount
            self.reserved += amount
            self.reservations[reservation] = [amount, reference, "reserved"]
        else:
            if held[2] != "reserved":
                return "rejected", "reservation_terminal"
            self.reserved -= amount
            if operation == "refund":
                self.available += amount
            held[2] = "settled"
        self.inputs[key] = asked
        return "applied", None


def ledger(ops: DataFrame) -> DataFrame:
    """Account, seq, operation, outcome (applied, repeat or rejected), reason, available and reserved after each.

    ops: account, seq, operation (grant, reserve, commit, refund), amount, idempotency_key, reservation_key,
    reference_type, reference_key. What an operation does depends on all before it, so the fold walks each account in
    order of seq; rows stream through, and a task holds one account's keys and reservations at a time. commit and
    refund take amount and reference of their reservation. No balance ever falls below zero.
    """
    names = ["account", "seq", "operation", "amount", "idempotency_key", "reservation_key", "reference_type", "reference_key"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, _Account()
        for b in batches:
            out = []
            for account, seq, operation, amount, key, reservation, *reference in zip(*(b[n].tolist() for n in names)):
                if account != now:
                    now, state = account, _Account()
                outcome, reason = state.apply(operation, None if pd.isna(amount) else int(amount), key, reservation, tuple(reference))
                out.append((account, seq, operation, outcome, reason, state.available, state.reserved))
            yield pd.DataFrame(out, columns=["account", "seq", "operation", "outcome", "reason", "available", "reserved"])

    kinds = dict(ops.dtypes)
    ordered = ops.select(*names).repartition("account").sortWithinPartitions("account", "seq")
    return ordered.mapInPandas(fold, f"account {kinds['account']}, seq {kinds['seq']}, operation string, outcome string, reason string, available long, reserved long")


def ledger_rejections(entries: DataFrame) -> DataFrame:
    """Rejected operations per account and reason, with the first such seq."""
    return entries.where("outcome = 'rejected'").groupBy("account", "reason").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))


def failure_state(attempts: DataFrame, key: str = "job", seq: str = "seq", failed: str = "failed") -> DataFrame:
    """The attempt log with attempts since the last success, dead_lettered, and the wait in seconds (2**attempts).

    Success starts a new island; what follows a third failure is dead until a success.
    """
    w = W.partitionBy(key).orderBy(seq)
    island = F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    df = attempts.withColumn("island", island)
    n = F.sum(F.col(failed).cast("int")).over(W.partitionBy(key, "island").orderBy(seq).rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("attempts", n).withColumn("dead_lettered", F.col("attempts") >= MOST_ATTEMPTS)
    return df.withColumn("retry_after_s", F.when(F.col(failed) & ~F.col("dead_lettered"), F.pow(F.lit(2.0), F.col("attempts")).cast("long")))


def transient(status: Column, sqlstate: Column) -> Column:
    """whether a failure may pass by itself."""
    return F.coalesce((status == 429) | status.between(500, 599), F.lit(False)) | F.coalesce(sqlstate.rlike("^(08...|40001|40P01)$"), F.lit(False))


def outbox(triggers: DataFrame, preferences: DataFrame, order: str = "seq") -> DataFrame:
    """Events per channel that the user's preferences allow, first of each semantic identity.

    triggers: user_id, opportunity_id, trigger, identity, seq. A user without a preference row has the defaults. The
    preferences of all users are joined by user, not broadcast.
    """
    prefs = preferences.select("user_id", "enabled", "channels", F.col("triggers").alias("wanted"))
    both = triggers.join(prefs, "user_id", "left")
    on = F.coalesce("enabled", F.lit(True)) & F.coalesce(F.array_contains("wanted", F.col("trigger")), F.col("trigger").isin(*TRIGGERS))
    sent = both.where(on).withColumn("channel", F.explode(F.array_distinct(F.coalesce("channels", F.array(*map(F.lit, DEFAULT_CHANNELS))))))
    sent = sent.withColumn("dedupe_key", F.sha2(F.concat_ws("\u001f", "user_id", "opportunity_id", "channel", "trigger", "identity"), 256))
    first = F.row_number().over(W.partitionBy("dedupe_key").orderBy(order)) == 1
    return sent.withColumn("_first", first).where("_first").select("user_id", "opportunity_id", "channel", "trigger", "identity", order, "dedupe_key")


def observed_after_watch(watches: DataFrame, versions: DataFrame, now: Column) -> DataFrame:
    """Watches with the versions that became current after them and are in effect by now."""
    seen = (F.col("created_at") <= F.col("transition_at")) & (F.col("transition_at") <= now) & (F.col("effective_at") <= now)
    return watches.join(versions.where("transition_kind in ('initial', 'current')"), "opportunity_id").where(seen)


def deliverable(events: DataFrame, watches: DataFrame) -> DataFrame:
    """Events whose user still watches the opportunity; new relevance needs no watch."""
    free = events.where("trigger = 'new_high_relevance'")
    return events.where("trigger <> 'new_high_relevance'").join(watches.select("user_id", "opportunity_id").distinct(), ["user_id", "opportunity_id"], "left_semi").unionByName(free)


def billing_outcomes(events: DataFrame, mappings: DataFrame, policies: DataFrame) -> DataFrame:
    """Outcome, review_reason and credit_units per event row.

    events: event_id, seq, invoice_id (null: only observed), customer_id, price_id, currency, amount. An event id that
    comes again is a repeat, or a conflict if it says something else. An invoice is applied once, by the first event that
    has a mapped customer and a price of that currency and amount; events before that are for review by the first reason,
    later ones duplicates, or conflicts if the invoice says something else.
    """
    facts = F.struct("invoice_id", "customer_id", "price_id", "currency", "amount")
    by_event = W.partitionBy("event_id").orderBy("seq")
    e = events.withColumn("_facts", facts).withColumn("_n", F.row_number().over(by_event)).withColumn("_same", F.col("_facts").eqNullSafe(F.first("_facts").over(by_event)))
    again = e.where("_n > 1").select("event_id", "seq", "invoice_id", F.when(F.col("_same"), "repeat").otherwise("conflict").alias("outcome"), F.lit(None).cast("string").alias("review_reason"), F.lit(None).cast(dict(policies.dtypes)["credit_units"]).alias("credit_units"))
    e = e.where("_n = 1").join(mappings.select("customer_id", F.lit(True).alias("_mapped")), "customer_id", "left")
    e = e.join(policies.select("price_id", F.col("currency").alias("_cur"), F.col("amount").alias("_amt"), "credit_units"), "price_id", "left")
    why = F.when(F.col("_mapped").isNull(), "unmapped_customer").when(F.col("_amt").isNull(), "unmapped_price").when((F.col("_cur") != F.col("currency")) | (F.col("_amt") != F.col("amount")), "price_policy_mismatch")
    e = e.withColumn("review_reason", why)
    # events without an invoice have no order to keep and meet nowhere
    plain = e.where("invoice_id is null").select("event_id", "seq", "invoice_id", F.lit("observed").alias("outcome"), F.lit(None).cast("string").alias("review_reason"), F.lit(None).cast(dict(policies.dtypes)["credit_units"]).alias("credit_units"))
    before = W.partitionBy("invoice_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    e = e.where("invoice_id is not null").withColumn("_applied", F.first(F.when(F.col("review_reason").isNull(), F.col("_facts")), ignorenulls=True).over(before))
    outcome = F.when(F.col("_applied").isNotNull(), F.when(F.col("_applied") == F.col("_facts"), "duplicate").otherwise("conflict")).when(F.col("review_reason").isNotNull(), "review").otherwise("applied")
    e = e.withColumn("outcome", outcome).select("event_id", "seq", "invoice_id", "outcome", F.when(F.col("outcome") == "review", F.col("review_reason")).alias("review_reason"), F.when(F.col("outcome") == "applied", F.col("credit_units")).alias("credit_units"))
    return e.unionByName(plain).unionByName(again)


def delivery_state(attempts: DataFrame, event: str = "event_id", seq: str = "seq") -> DataFrame:
    """The state of each event after its attempts: sent, cancelled, dead_lettered after three, or pending with a wait.

    attempts: outcome in (sent, failed, cancelled), retryable. A failure that can't be retried is dead at once; nothing
    changes after an end state.
    """
    w = W.partitionBy(event).orderBy(seq)
    final = F.col("outcome").isin("sent", "cancelled") | ((F.col("outcome") == "failed") & ~F.col("retryable"))
    before = F.coalesce(F.max(final).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    n = F.count_if(F.col("outcome") == "failed").over(w.rowsBetween(W.unboundedPreceding, 0))
    df = attempts.withColumn("failures", n).withColumn("_done", before).where(~F.col("_done") & (F.coalesce(F.col("failures") - F.col("outcome").isin("failed").cast("int"), F.lit(0)) < MOST_ATTEMPTS))
    last = df.groupBy(event).agg(F.max_by(F.struct("outcome", "retryable", "failures"), seq).alias("x"), F.count(F.lit(1)).alias("attempts"))
    status = F.when(F.col("x.outcome") != "failed", F.col("x.outcome")).when(~F.col("x.retryable") | (F.col("x.failures") >= MOST_ATTEMPTS), "dead_lettered").otherwise("pending")
    return last.select(event, "attempts", status.alias("status"), F.when(status == "pending", F.pow(F.lit(2.0), F.col("x.failures")).cast("long")).alias("wait_s"))


def credit_fence(ops: DataFrame, now: Column, grace_s: int = 120) -> DataFrame:
    """Reservations and what became of them: settled, open, or for review beyond the grace.

    ops: reservation_key, operation, at (seconds).
    """
    by = ops.groupBy("reservation_key").agg(F.min(F.when(F.col("operation") == "reserve", F.col("at"))).alias("reserved_at"), F.max(F.col("operation").isin("commit", "refund")).alias("settled"))
    state_ = F.when(F.col("settled"), "settled").when(now - F.col("reserved_at") > grace_s, "review_required").otherwise("open")
    return by.where("reserved_at is not null").select("reservation_key", "reserved_at", state_.alias("state"))


def outcome_watchers(published: DataFrame, ancestors: DataFrame, watches: DataFrame) -> DataFrame:
    """Who hears of a published outcome: those who watch it or any of its ancestors, once each."""
    to = published.select("opportunity_id", F.col("opportunity_id").alias("watched"))
    up = published.join(ancestors, published["opportunity_id"] == ancestors["node"]).select("opportunity_id", F.col("ancestor").alias("watched"))
    return to.unionByName(up).join(watches.withColumnRenamed("opportunity_id", "watched"), "watched").groupBy("user_id", "opportunity_id").agg(F.min("watched").alias("through"))
