"""Operator 5, quality rules: learned decision lists over text statistics, emitted as Spark conditionals.

Statistics are built-in expressions of each row, so nothing is shuffled or sent to Python. The list is learned
by sequential covering on the driver, from the statistics of at most `sample` labelled rows (lowest hash of
doc_id first): each rule grows by the threshold condition of the best information gain on two thirds of the
rows still uncovered, is pruned on the other third, and is kept while it is precise enough there. The result is an ordered
CASE expression whose branches anyone can read.

Defined results: null text has no words and fails the base rule; so do empty texts; repeated rows and null ids
keep their row; without usable labels the list is empty and the base rule alone decides; an empty table gives
no rows; extra columns are kept by `apply_rules` unless they carry the name of a statistic.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.shared import aside, only

#: Fixed values of the base rule: fewest words, and the percentage of words in repeated 8-word windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
WINDOW = 8
SPACE = "[\\x20\\x09-\\x0D]+"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What conditions may test: counts, and ratios that don't depend on a text's length.
FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "mark_ratio", "caps_ratio", "digit_ratio")


def _pairs(hashes: Column, gap: int, n: Column, span: int) -> Column:
    """Combines each hash with the one `gap` later; the result covers `span` words."""
    size = F.greatest(n - (span - 1), F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), size), F.slice(hashes, F.lit(1 + gap), size), lambda a, b: F.xxhash64(a, b))


def with_statistics(docs: DataFrame, text: str = "text", features: Sequence[str] = FEATURES) -> DataFrame:
    """docs, the five statistics (long) and the named FEATURES (double); columns with names in `_nf_*` are internal."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    salt = F.lit(secrets.randbits(63))  # words are hashed with a secret of the run: windows can't be written to collide
    df = docs.withColumn("_nf_words", F.array_remove(F.split(t, SPACE), ""))
    n = F.size("_nf_words")
    df = df.withColumns({"_nf_n": n, "_nf_hash": F.transform("_nf_words", lambda w: F.xxhash64(salt, w)), "_nf_lines": F.filter(F.split(t, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))})
    df = df.withColumn("_nf_h2", _pairs(F.col("_nf_hash"), 1, F.col("_nf_n"), 2))
    df = df.withColumn("_nf_h4", _pairs(F.col("_nf_h2"), 2, F.col("_nf_n"), 4))
    df = df.withColumn("_nf_h8", _pairs(F.col("_nf_h4"), 4, F.col("_nf_n"), 8))
    # only texts with a repeated window pay for sorting their windows
    repeated = F.size(F.array_distinct("_nf_h8")) < F.size("_nf_h8")
    h8 = F.col("_nf_h8")
    df = df.withColumn("_nf_sorted", F.when(repeated, F.sort_array(F.zip_with(h8, F.sequence(F.lit(0), F.size(h8) - 1), lambda h, p: F.struct(h.alias("h"), p.alias("p"))))))
    s, m = F.col("_nf_sorted"), F.size("_nf_sorted") - 1
    twice = F.flatten(F.zip_with(F.slice(s, F.lit(1), m), F.slice(s, F.lit(2), m), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>"))))
    df = df.withColumn("_nf_at", F.when(s.isNotNull(), F.sort_array(F.array_distinct(twice))))
    covered = F.aggregate("_nf_at", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")))["n"]
    counts = {
        "n_words": F.col("_nf_n"),
        "word_chars": F.length(F.array_join("_nf_words", "")),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("_nf_lines") - F.size(F.array_distinct("_nf_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    parts = {
        "distinct_ratio": F.size(F.array_distinct("_nf_hash")),
        "mark_ratio": F.regexp_count(t, F.lit("[!?=~^_]")),
        "caps_ratio": F.regexp_count(t, F.lit("[A-Z]{2,}")),
        "digit_ratio": F.regexp_count(t, F.lit("[0-9]+")),
        "dup_line_ratio": F.size("_nf_lines"),
    }
    made = [c.cast("long").alias(k) for k, c in counts.items()] + [c.alias(f"_nf_{k}") for k, c in parts.items() if k in features]
    # a generator of one row: conditions on the statistics stay above it, or the optimizer would repeat what they are made of
    df = df.select(*(docs[f"`{c}`"] for c in docs.columns), F.inline(F.array(F.struct(*made))))
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    ratios = {"mean_word": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "repeat_ratio": ("n_repeat_words", "n_words"), "dup_line_ratio": ("n_dup_lines", "_nf_dup_line_ratio")}
    ratios |= {k: (f"_nf_{k}", "n_words") for k in parts if k != "dup_line_ratio"}
    return df.select(*(F.col(f"`{c}`") for c in docs.columns), *counts, *(per(*ratios[k]).alias(k) for k in features if k in ratios))


def base_failed() -> Column:
    """The base rule: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] >= self.threshold if self.at_least else row[self.feature] < self.threshold

    def sql(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects what it covers."""

    conditions: tuple[Condition, ...]

    def covers(self, row: dict[str, float]) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            value = F.col(c.feature).cast("double")
            out = out & (value >= F.lit(c.threshold) if c.at_least else value < F.lit(c.threshold))
        return out

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gained for the covered positives when (p0, n0) narrow to (p, n)."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def _best_condition(rows: list[tuple[dict[str, float], int]], features: Sequence[str]) -> tuple[float, Condition | None]:
    p0 = sum(y for _, y in rows)
    n0 = len(rows) - p0
    best: tuple[float, Condition | None] = (1e-9, None)
    for f in features:
        ordered = sorted((x[f], y) for x, y in rows)
        p = n = 0
        for i, (v, y) in enumerate(ordered[:-1]):
            p, n = p + y, n + 1 - y
            nxt = ordered[i + 1][0]
            if nxt == v:
                continue
            cut = (v + nxt) / 2
            for gain, at_least in ((_gain(p, n, p0, n0), False), (_gain(p0 - p, n0 - n, p0, n0), True)):
                if gain > best[0]:
                    best = (gain, Condition(f, at_least, cut))
    return best


def _pruned(conditions: list[Condition], rows: list[tuple[dict[str, float], int]]) -> tuple[Rule, int, int]:
    """The prefix of the conjunction that does best on the pruning rows, and what it covers there."""
    best = (-2.0, Rule(tuple(conditions)), 0, 0)
    for k in range(len(conditions), 0, -1):
        rule = Rule(tuple(conditions[:k]))
        p = sum(1 for x, y in rows if y and rule.covers(x))
        n = sum(1 for x, y in rows if not y and rule.covers(x))
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0] or worth == best[0] and p > best[2]:
            best = (worth, rule, p, n)
    return best[1], best[2], best[3]


def learn(rows: list[tuple[dict[str, float], int]], *, features: Sequence[str] = FEATURES, most_rules: int = 12, most_conditions: int = 4, least_precision: float = 0.95, least_covered: int = 3) -> list[Rule]:
    """Sequential covering: an ordered list of rules for label 1 (to reject). rows: feature values and label, in a fixed order."""
    rules: list[Rule] = []
    left = list(rows)
    while len(rules) < most_rules and any(y for _, y in left):
        grow, prune = [r for i, r in enumerate(left) if i % 3], left[::3]
        covered, conditions = grow, []
        while len(conditions) < most_conditions and any(not y for _, y in covered) and any(y for _, y in covered):
            gain, condition = _best_condition(covered, features)
            if condition is None:
                break
            conditions.append(condition)
            covered = [r for r in covered if condition.holds(r[0])]
        if not conditions:
            break
        rule, p, n = _pruned(conditions, prune)
        gp = sum(1 for x, y in grow if y and rule.covers(x))
        gn = sum(1 for x, y in grow if not y and rule.covers(x))
        if p + gp < least_covered or (p + gp) < least_precision * (p + n + gp + gn) or p < least_precision * (p + n):
            break
        rules.append(rule)
        left = [r for r in left if not rule.covers(r[0])]
    return rules


def labelled_rows(docs: DataFrame, labels: DataFrame, sample: int) -> list[tuple[dict[str, float], int]]:
    """Statistics and reject label (1: quality 0) of at most `sample` labelled rows, lowest hash of doc_id first."""
    chosen = only(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    both = only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # the sample's size is a parameter
    stats = with_statistics(both).select("doc_id", "quality", *FEATURES, base_failed().alias("failed"))
    picked = stats.where(~F.col("failed")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *FEATURES).limit(sample)
    return [({f: float(r[f]) for f in FEATURES}, int(r["quality"] == 0)) for r in picked.collect()]


def verdict(rules: Sequence[Rule]) -> Column:
    """Number of the first rule (from 1) that rejects the row, as one ordered conditional; 0 where none does."""
    if not rules:
        return F.lit(0)
    out = F.when(rules[0].column(), F.lit(1))
    for i, rule in enumerate(rules[1:], 2):
        out = out.when(rule.column(), F.lit(i))
    return out.otherwise(F.lit(0))


def case_sql(rules: Sequence[Rule]) -> str:
    """The decision list as text."""
    return "CASE " + " ".join(f"WHEN {r.sql()} THEN {i}" for i, r in enumerate(rules, 1)) + " ELSE 0 END" if rules else "0"


def apply_rules(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """docs with the statistics, base_failed, rule (int) and kept."""
    used = sorted({c.feature for r in rules for c in r.conditions})
    out = with_statistics(docs, features=used).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def report(docs: DataFrame, labels: DataFrame, *, sample: int = 6000, **options) -> DataFrame:
    """doc_id, the five statistics, base_failed, kept and rule per document."""
    rules = learn(labelled_rows(docs, labels, sample), **options)
    return apply_rules(only(docs, "doc_id", "text"), rules).select("doc_id", *STATISTICS, "base_failed", "kept", "rule")


def accepted(docs: DataFrame, labels: DataFrame, *, sample: int = 6000, **options) -> DataFrame:
    """The documents that neither the base rule nor the learned list rejects, with the columns they had."""
    rules = learn(labelled_rows(docs, labels, sample), **options)
    rows, back = aside(docs, "text")
    return back(apply_rules(rows, rules).where("kept"))
