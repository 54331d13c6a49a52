"""Distribution summaries: shares, drift, histograms, quantile tables, correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.coerce import Fields
from waybill.functions.small import scalar
from waybill.operators.ecdf import long_values, quantiles_from_steps, running_counts


def label_distribution(df: DataFrame, column: str = S.LABEL) -> DataFrame:
    """(label, n, share)"""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "share", F.round(F.col("n") / total, 4)
    )


def label_drift(df: DataFrame, expected=None, tolerance: float = 0.03) -> DataFrame:
    """(label, observed, expected, within) per expected label."""
    expected = S.LABEL_SHARES if expected is None else expected
    f = Fields(df)
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(f.number(S.LABEL) == k).alias(f"k{k}") for k in expected],
    )
    lines = [
        F.struct(
            F.lit(k).cast("int").alias("label"),
            F.when(F.col("n") == 0, 0.0).otherwise(F.col(f"k{k}") / F.col("n")).alias("share"),
            F.lit(float(v)).alias("expected"),
        )
        for k, v in expected.items()
    ]
    return one.select(F.explode(F.array(*lines)).alias("line")).select(
        "line.label",
        F.round("line.share", 4).alias("observed"),
        "line.expected",
        (F.abs(F.col("line.share") - F.col("line.expected")) <= tolerance).alias("within"),
    )


def combo_cardinality(df: DataFrame, columns=("last_scac", "carrier_service_code"), limit=200):
    """(pairs, within_limit): distinct combinations, missing values included."""
    return (
        df.select(*columns)
        .distinct()
        .agg(F.count(F.lit(1)).alias("pairs"))
        .withColumn("within_limit", F.col("pairs") <= limit)
    )


def bin_index(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Index of the equal-width bin of `value`; the last bin is closed.

    A first guess by division is settled against the edges low + i * width themselves.
    """
    width = (high - low) / F.lit(float(bins))
    guess = F.least(F.floor((value - low) / width), F.lit(bins - 1))
    down = F.when(value < low + guess * width, 1).otherwise(0)
    up = F.when((value >= low + (guess + 1) * width) & (guess < bins - 1), 1).otherwise(0)
    return (guess - down + up).cast("int")


def binned_counts(sides: dict[str, DataFrame], fields, bins: int, widen: bool = False):
    """(field, bin, low, high, <side>…): counts per equal-width bin of the common range.

    A constant field has no bins, or with `widen` the range value ± 0.5.
    """
    both = None
    for name, df in sides.items():
        part = df.select(F.lit(name).alias("side"), *[Fields(df).number(c).alias(c) for c in fields])
        both = part if both is None else both.unionByName(part)
    ranges = scalar(
        both.agg(
            *[F.min(c).alias(f"{c}__low") for c in fields],
            *[F.max(c).alias(f"{c}__high") for c in fields],
        )
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("field"),
                F.col(c).alias("value"),
                ranges[f"{c}__low"].alias("low"),
                ranges[f"{c}__high"].alias("high"),
            )
            for c in fields
        ]
    )
    flat = (
        both.select("side", F.explode(cells).alias("cell"))
        .select("side", "cell.*")
        .where(F.col("value").isNotNull())
    )
    same = F.col("low") == F.col("high")
    if widen:
        flat = flat.select(
            "side",
            "field",
            "value",
            F.when(same, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
            F.when(same, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
        )
    else:
        flat = flat.where(~same)
    index = bin_index(F.col("value"), F.col("low"), F.col("high"), bins)
    return flat.groupBy("field", index.alias("bin"), "low", "high").agg(
        *[F.count_if(F.col("side") == name).alias(name) for name in sides]
    )


def histogram(df: DataFrame, fields, bins: int = 20) -> DataFrame:
    """(field, bin, low_edge, high_edge, n); empty bins included."""
    counted = binned_counts({"n": df}, fields, bins, widen=True)
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    spans = counted.groupBy("field", "low", "high").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("filled")
    )
    return spans.select(
        "field",
        "low",
        "high",
        "filled",
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
    ).select(
        "field",
        "bin",
        F.round(F.col("low") + F.col("bin") * width, 6).alias("low_edge"),
        F.round(F.col("low") + (F.col("bin") + 1) * width, 6).alias("high_edge"),
        F.coalesce(F.element_at("filled", F.col("bin")), F.lit(0)).alias("n"),
    )


SUMMARY_PROBS = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def value_summary(df: DataFrame, fields) -> DataFrame:
    """(field, n, mean, min, p5 … p95, max) of non-null values, six digits."""
    steps = running_counts(long_values(df.select(*fields), fields), {"n": F.count(F.lit(1))})
    basic = steps.groupBy("field").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    marks = quantiles_from_steps(steps, SUMMARY_PROBS.values())
    wide = marks.groupBy("field").agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
            for name, p in SUMMARY_PROBS.items()
        ]
    )
    shown = ["mean", "min", *SUMMARY_PROBS, "max"]
    return basic.join(wide, "field").select(
        "field", "n", *[F.round(c, 6).alias(c) for c in shown]
    )


def confidence_interval(df: DataFrame, value: str, by=(), z: float = 1.96) -> DataFrame:
    """(by…, mean, std, ci95_low, ci95_high, n): sample spread, 0 for a single value."""
    mean, n = F.col("_mean"), F.col("n")
    margin = F.lit(z) * F.col("_sd") / F.sqrt(n)
    return (
        df.where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*by)
        .agg(
            F.avg(value).alias("_mean"),
            F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_sd"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            *by,
            F.round(mean, 4).alias("mean"),
            F.round("_sd", 4).alias("std"),
            F.round(mean - margin, 4).alias("ci95_low"),
            F.round(mean + margin, 4).alias("ci95_high"),
            "n",
        )
    )


def sweep_summary(long: DataFrame) -> DataFrame:
    """Mean and confidence interval per (architecture, level, metric) over seeds."""
    return confidence_interval(long, "value", ["architecture", "level", "metric"]).withColumnRenamed(
        "n", "n_seeds"
    )


def level_order(level: Column) -> Column:
    names = [s[0] for s in S.STRICTNESS]
    order = F
    for i, name in enumerate(names):
        order = order.when(level == name, i)
    return order.otherwise(len(names)).cast("int")


def frontier_table(summary: DataFrame, metrics) -> DataFrame:
    """One row per (architecture, level) with a column per metric, in level order."""
    return (
        summary.groupBy("architecture", "level")
        .pivot("metric", list(metrics))
        .agg(F.avg("mean"))
        .withColumn("position", level_order(F.col("level")))
        .orderBy("architecture", "position")
    )


def correlation_matrix(df: DataFrame, columns) -> DataFrame:
    """(left, right, corr) for every pair of columns, from one aggregation."""
    f = Fields(df)
    pairs = list(combinations(columns, 2))
    numbers = df.select(*[f.number(c).alias(c) for c in columns])

    def corr(a: str, b: str) -> Column:
        """NULL, not an error, where a column is constant."""
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        spread = F.stddev_pop(F.when(both, F.col(a))) * F.stddev_pop(F.when(both, F.col(b)))
        return F.when(spread > 0, F.covar_pop(a, b) / spread)

    one = numbers.agg(*[corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    lines = ", ".join(f"'{a}', '{b}', r{i}" for i, (a, b) in enumerate(pairs))
    return one.selectExpr(f"stack({len(pairs)}, {lines}) as (left_field, right_field, corr)")
