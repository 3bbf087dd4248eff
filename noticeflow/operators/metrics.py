"""Evaluation metrics (A8-A13, A15-A18, A22, A29): undefined support stays null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noticeflow.functions.storage import cut


def rate(n: Column, d: Column) -> Column:
    """Null on zero support."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def set_metrics(predicted: DataFrame, expected: DataFrame, ids: list[str], by: list[str] | None = None) -> DataFrame:
    """Tp, fp, fn, supports, precision, recall, f1 of two sets of ids, per group if `by` is given."""
    keys = [*(by or []), *ids]
    both = predicted.select(*keys).distinct().withColumn("_p", F.lit(1)).join(expected.select(*keys).distinct().withColumn("_e", F.lit(1)), keys, "full")
    p, e = F.col("_p").isNotNull(), F.col("_e").isNotNull()
    out = both.groupBy(*(by or [])).agg(F.count_if(p & e).alias("tp"), F.count_if(p & ~e).alias("fp"), F.count_if(e & ~p).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"predicted_support": tp + fp, "expected_support": tp + fn, "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn)})


def field_metrics(predicted: DataFrame, expected: DataFrame, case: str = "case_id") -> DataFrame:
    """A10 over (case, field, value) rows: correct, accuracy, missing, unexpected, exact_match per case."""
    p = predicted.select(case, "field", F.col("value").alias("_pv"), F.lit(True).alias("_p"))
    e = expected.select(case, "field", F.col("value").alias("_ev"), F.lit(True).alias("_e"))
    both = p.join(e, [case, "field"], "full").withColumn("_ok", F.col("_p").isNotNull() & F.col("_e").isNotNull() & F.col("_pv").eqNullSafe(F.col("_ev")))
    out = both.groupBy(case).agg(
        F.count_if("_ok").alias("correct"),
        F.count("_e").alias("expected_fields"),
        F.array_sort(F.collect_set(F.when(F.col("_p").isNull(), F.col("field")))).alias("missing"),
        F.array_sort(F.collect_set(F.when(F.col("_e").isNull(), F.col("field")))).alias("unexpected"),
        F.min("_ok").alias("exact_match"),
    )
    return out.withColumn("accuracy", rate(F.col("correct"), F.col("expected_fields")))


def ranking_metrics(ranked: DataFrame, relevance: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Returned, hits, relevant_support, recall_at_k, ndcg_at_k per group.

    ranked: by, id, position (from 1); relevance: by, id, grade (0 to 4). Windows rank within groups only.
    """
    gain = lambda g, pos: (F.pow(F.lit(2.0), g) - 1) / F.log2(pos + F.lit(1.0))
    top = ranked.where(F.col("position") <= k).join(relevance.where("grade > 0"), [*by, "id"], "left")
    got = top.groupBy(*by).agg(F.count(F.lit(1)).alias("returned"), F.count("grade").alias("hits"), F.sum(gain(F.coalesce("grade", F.lit(0)), F.col("position"))).alias("_dcg"))
    # each task keeps its k best of a group before they meet
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("grade"), "id"))
    ideal = relevance.withColumn("_r", place).where(F.col("_r") <= k).groupBy(*by).agg(F.sum(gain(F.col("grade"), F.col("_r"))).alias("_ideal"))
    support = relevance.groupBy(*by).agg(F.count_if(F.col("grade") > 0).alias("relevant_support"))
    both = support.join(ideal, by, "left").join(got, by, "left").fillna(0, ["returned", "hits"])
    return both.select(*by, "returned", "hits", "relevant_support", rate(F.col("hits"), F.col("relevant_support")).alias("recall_at_k"), F.try_divide(F.coalesce("_dcg", F.lit(0.0)), F.col("_ideal")).alias("ndcg_at_k"))


def percentiles(df: DataFrame, value: str, percents: list[int], by: list[str]) -> DataFrame:
    """Exact percentiles with linear interpolation; null on no values.

    Values are counted, then put in order by range: a part's place follows from the counts of the parts before it, so that no
    task holds a group's values, whatever its size.
    """
    same = lambda a, b, on: reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in on), F.lit(True))
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    parts = cut(counted.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy(*by, "_part").agg(F.sum("_n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = totals.withColumns({"_start": before, "_all": F.sum("_n").over(W.partitionBy(*by))}).drop("_n")
    upto = F.sum("_n").over(W.partitionBy(*by, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    placed = parts.withColumn("_upto", upto).alias("p").join(starts.alias("s"), same("p", "s", [*by, "_part"])).select(*(F.col(f"p.{c}") for c in [*by, "_v", "_n", "_upto"]), "_start", "_all")
    last = F.col("_start") + F.col("_upto") - 1  # the last place of this value, from 0
    first = last - F.col("_n") + 1
    out = []
    for p in percents:
        place = (F.col("_all") - 1) * p / F.lit(100.0)
        at = lambda where: F.max(F.when((first <= where) & (where <= last), F.col("_v")))
        low, high, share = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        out.append((low + (high - low) * share).cast("double").alias(f"p{p}"))
    found = placed.groupBy(*by).agg(*out)
    return df.select(*by).distinct().alias("g").join(found.alias("f"), same("g", "f", by), "left").select(*(F.col(f"g.{c}") for c in by), *(f"f.p{p}" for p in percents)) if by else found


def all_or_null(measured: Column, value: Column) -> Column:
    """An aggregate that counts only if every row was measured."""
    return F.when(F.count_if(measured) == F.count(F.lit(1)), value)


def same_cases(a: DataFrame, b: DataFrame, case: str) -> DataFrame:
    """Cases that only one side has (an empty result means the sets agree)."""
    return a.select(case).distinct().withColumn("_a", F.lit(1)).join(b.select(case).distinct().withColumn("_b", F.lit(1)), case, "full").where("_a is null or _b is null").select(case, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("only_in"))
