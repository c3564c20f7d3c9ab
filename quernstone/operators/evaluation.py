"""Evaluation metrics of predictions and latencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.ranks import running_totals


def predicted(decision: Column, confidence: Column, sanitize_from: float = 0.5) -> Column:
    """block and exclude are 1; sanitize is 1 from a confidence on; all else 0."""
    return F.when(decision.isin("block", "exclude"), 1).when((decision == "sanitize") & (F.coalesce(confidence, F.lit(0.0)) >= sanitize_from), 1).otherwise(0)


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """One row (also for an empty table): tp, fp, tn, fn and their ratios, 0 where undefined."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    c = df.agg(
        F.count(F.when(y & p, 1)).alias("tp"), F.count(F.when(~y & p, 1)).alias("fp"), F.count(F.when(~y & ~p, 1)).alias("tn"), F.count(F.when(y & ~p, 1)).alias("fn")
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    prec, rec = ratio(tp, tp + fp), ratio(tp, tp + fn)
    n = F.greatest(tp + fp + tn + fn, F.lit(1))
    return c.select(
        "tp", "fp", "tn", "fn",
        F.round(prec, 4).alias("precision"), F.round(rec, 4).alias("recall"), F.round(ratio(2 * prec * rec, prec + rec), 4).alias("f1"),
        F.round((tp + tn) / n, 4).alias("accuracy"), F.round(fp / F.greatest(fp + tn, F.lit(1)), 4).alias("fpr"),
    )


def per_source(df: DataFrame, source: str = "source", pred: str = "pred") -> DataFrame:
    n = F.count(F.lit(1))
    hit = F.count(F.when(F.col(pred) == 1, 1))
    return df.groupBy(source).agg(n.alias("n"), hit.alias("flagged"), F.round(hit / n, 4).alias("rate"))


def rank_percentiles(df: DataFrame, value: str, percents: tuple = (50, 95, 99), by: list[str] | None = None, median: bool = False) -> DataFrame:
    """Percentile p = the value at rank min(floor(n * p / 100), n - 1) of the sorted values, with
    n, mean, min and max.

    Works on counts of distinct values, not on sorted rows; the running count is taken
    in two levels, so neither a hot group nor one without ``by`` meets in one task.
    Nulls are left out.  ``median`` adds the mean of the two middle values.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    upto = running_totals(counts, [F.col(value)], {"upto": F.col("c")}, by)
    totals = counts.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.sum("c").alias("total"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.lit(True))
    ranked = upto.join(totals, same) if by else upto.join(F.broadcast(totals), F.lit(True))  # one row
    want = lambda p: F.least(F.floor(F.col("total") * p / 100), F.col("total") - 1)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(value)))
    middle = [F.round((at(F.floor((F.col("total") - 1) / 2)) + at(F.floor(F.col("total") / 2))) / 2, 4).alias("median")] if median else []
    return ranked.groupBy(*by).agg(
        *middle,
        F.max("total").alias("n"), F.round(F.sum(F.col(value) * F.col("c")) / F.max("total"), 4).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        *[at(want(p)).alias(f"p{p}") for p in percents],
    )


def average_precision(df: DataFrame, score: str = "score", label: str = "label", order: str = "pos") -> DataFrame:
    """Area under the precision-recall curve by steps; ties stay in input order.

    Running counts over the global order are taken in two levels
    (:mod:`quernstone.operators.ranks`); ``order`` spreads equal scores.  Null scores are left out.
    """
    d = df.where(F.col(score).isNotNull()).select(F.col(score).alias("s"), F.when(F.col(label) == 1, 1).otherwise(0).alias("y"), F.col(order).alias("o"))
    ranked = running_totals(d, [F.desc("s"), F.asc("o")], {"tp": F.col("y"), "n": F.lit(1)})
    return ranked.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("n_pos"),
        F.round(F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("tp") / F.col("n"))), F.lit(0.0)) / F.greatest(F.coalesce(F.sum("y"), F.lit(0)), F.lit(1)), 6).alias("pr_auc"),
    )
