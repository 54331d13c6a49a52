"""Utility metrics from a table of scored rows (fold, y_true, y_pred, proba)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill import schema as S

MISS_WEIGHT = 3.0
CALIBRATION_BINS = 10


def outcome_counts(scored: DataFrame, by=()) -> DataFrame:
    """(by…, y_true, y_pred, cnt): all that the label metrics need, a handful of rows.

    Scored rows that come as counts already have a column `cnt`.
    """
    count = F.sum("cnt") if "cnt" in scored.columns else F.count(F.lit(1))
    return scored.groupBy(*by, "y_true", "y_pred").agg(count.alias("cnt"))


def confusion_matrix(scored: DataFrame, by=()) -> DataFrame:
    """One row per true label with a column per predicted label, zeros filled in."""
    cells = outcome_counts(scored, by)
    one = cells.groupBy(*by).agg(
        *[
            F.coalesce(
                F.sum(F.when((F.col("y_true") == t) & (F.col("y_pred") == p), F.col("cnt"))),
                F.lit(0),
            ).alias(f"c{t}{p}")
            for t in S.LABELS
            for p in S.LABELS
        ]
    )
    lines = ", ".join(f"{t}, " + ", ".join(f"c{t}{p}" for p in S.LABELS) for t in S.LABELS)
    names = ", ".join(f"pred_{p}" for p in S.LABELS)
    return one.selectExpr(*by, f"stack({len(S.LABELS)}, {lines}) as (y_true, {names})")


def _sum_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("cnt"))), F.lit(0))


def business_utility(scored: DataFrame, by=(), weight: float = MISS_WEIGHT) -> DataFrame:
    """(by…, business_utility): 1 - cost / worst cost; missed severe delays weigh more."""
    t, p = F.col("y_true"), F.col("y_pred")
    known = t.isin(S.LABELS) & p.isin(S.LABELS)
    return (
        outcome_counts(scored, by)
        .groupBy(*by)
        .agg(
            F.sum("cnt").alias("n"),
            _sum_if((t == p) & known).alias("right"),
            _sum_if((t == 2) & known).alias("severe"),
            _sum_if((t == 2) & (p != 2) & known).alias("missed"),
        )
        .select(
            *by,
            F.round(
                1
                - (F.col("n") - F.col("right") + (weight - 1) * F.col("missed"))
                / (F.col("n") + (weight - 1) * F.col("severe")),
                4,
            ).alias("business_utility"),
        )
    )


def weighted_f1(scored: DataFrame, by=(), digits: int = 4) -> DataFrame:
    """(by…, weighted_f1): F1 per true label, weighted by its support."""
    t, p, n = F.col("y_true"), F.col("y_pred"), F.col("cnt")
    views = F.array(
        F.struct(t.alias("label"), n.alias("support"), F.lit(0).alias("given"), F.when(t == p, n).otherwise(0).alias("hit")),
        F.struct(p.alias("label"), F.lit(0).alias("support"), n.alias("given"), F.lit(0).alias("hit")),
    )
    per_label = (
        outcome_counts(scored, by)
        .select(*by, F.explode(views).alias("v"))
        .groupBy(*by, "v.label")
        .agg(*[F.sum(f"v.{c}").alias(c) for c in ("support", "given", "hit")])
    )
    f1 = 2.0 * F.col("hit") / (F.col("support") + F.col("given"))
    return per_label.groupBy(*by).agg(
        F.round(F.sum(f1 * F.col("support")) / F.sum("support"), digits).alias("weighted_f1")
    )


def class2_recall(scored: DataFrame, by=()) -> DataFrame:
    t, p = F.col("y_true"), F.col("y_pred")
    known = (t == 2) & p.isin(S.LABELS)
    severe, found = _sum_if(known), _sum_if(known & (p == 2))
    return (
        outcome_counts(scored, by)
        .groupBy(*by)
        .agg(
            F.round(F.when(severe > 0, found / severe).otherwise(0.0), 4).alias("label2_recall")
        )
    )


def calibration_error(scored: DataFrame, by=(), bins: int = CALIBRATION_BINS) -> DataFrame:
    """(by…, ece): gap between confidence and accuracy over equal confidence bins."""
    top = F.array_max("proba")
    guess = F.array_position("proba", top) - 1
    placed = scored.select(*by, top.alias("conf"), (guess == F.col("y_true")).cast("double").alias("hit"))
    index = F.lit(0)
    for i in range(1, bins):
        index = index + (F.col("conf") >= F.lit(i * (1.0 / bins))).cast("int")
    per_bin = placed.groupBy(*by, index.alias("bin")).agg(
        F.count(F.lit(1)).alias("cnt"), F.avg("hit").alias("acc"), F.avg("conf").alias("mean_conf")
    )
    gap = F.abs(F.col("acc") - F.col("mean_conf")) * F.col("cnt")
    return per_bin.groupBy(*by).agg(F.round(F.sum(gap) / F.sum("cnt"), 4).alias("ece"))


def brier_score(scored: DataFrame, by=(), classes: int = 3) -> DataFrame:
    """(by…, brier): mean over classes of the squared probability error."""
    parts = []
    for c in range(classes):
        miss = (F.col("y_true") == c).cast("double") - F.get("proba", F.lit(c))
        parts.append(F.avg(miss * miss))
    return scored.groupBy(*by).agg(F.round(sum(parts[1:], parts[0]) / classes, 4).alias("brier"))


def fold_metrics(scored: DataFrame, by=("fold",)) -> DataFrame:
    """All utility metrics per fold, side by side."""
    out = weighted_f1(scored, by)
    for part in (business_utility, class2_recall, calibration_error, brier_score):
        out = out.join(part(scored, by), list(by))
    return out


def label_fold_metrics(scored: DataFrame, by=("fold",)) -> DataFrame:
    """The label metrics only, for scores without probabilities."""
    out = weighted_f1(scored, by)
    for part in (business_utility, class2_recall):
        out = out.join(part(scored, by), list(by))
    return out


def fold_summary(per_fold: DataFrame, metrics, by=()) -> DataFrame:
    """(by…, metric, mean, std): mean and population spread over folds."""
    lines = ", ".join(f"'{m}', `{m}`" for m in metrics)
    tidy = per_fold.selectExpr(*by, f"stack({len(metrics)}, {lines}) as (metric, value)")
    return tidy.groupBy(*by, "metric").agg(
        F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("std")
    )


def versus_baseline(metrics: DataFrame, base_f1: Column, base_bus: Column, base_recall: Column):
    """Gap and ratios of (weighted_f1, business_utility, label2_recall) to a baseline."""

    def ratio(value, base):
        return F.round(F.when(base > 0, value / base).otherwise(0.0), 4)

    return metrics.withColumns(
        {
            "f1_gap_vs_trtr": F.round(base_f1 - F.col("weighted_f1"), 4),
            "bus_ratio_vs_trtr": ratio(F.col("business_utility"), base_bus),
            "l2_recall_pres_ratio": ratio(F.col("label2_recall"), base_recall),
        }
    )
