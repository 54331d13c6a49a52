"""Distributed prefix sums over ordered values.

KS, Wasserstein, exact quantiles, average ranks, AUC and time folds all need "how many
rows lie at or below x". A single ordered window would move everything to one task, so:

1. rows are reduced to distinct values with counts (hot values shrink to one row),
2. each value falls in a range bucket whose edges come from a one-pass sketch,
3. bucket totals (a bounded table) give each bucket its starting offset,
4. a window inside the bucket adds the local running count.

The sketch only balances the buckets; the sums are exact for any edges.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.small import shuffle_width


def range_edges(df: DataFrame, columns, width: int) -> dict[str, list[float]]:
    """Strictly increasing inner bucket edges per numeric column, at most `width - 1` each."""
    shares = [i / width for i in range(1, width)]
    row = df.agg(
        *[F.percentile_approx(c, shares, max(1000, 10 * width)).alias(c) for c in columns]
    ).first()
    return {c: sorted(set(row[c] or [])) for c in columns}


def add_range_buckets(df: DataFrame, columns, width: int | None = None, suffix="_bucket", edges=None):
    """Adds one monotone bucket number per numeric column; by given edges, or by those of `df`."""
    edges = edges or range_edges(df, columns, width or shuffle_width(df))
    inf = float("inf")
    splits = {c: [-inf, *[e for e in edges[c] if abs(e) < inf], inf] for c in columns}
    # a Bucketizer wants at least three split points
    splits = {c: s if len(s) > 2 else [-inf, 0.0, inf] for c, s in splits.items()}
    return Bucketizer(
        splitsArray=[splits[c] for c in columns],
        inputCols=list(columns),
        outputCols=[c + suffix for c in columns],
        handleInvalid="keep",
    ).transform(df)


def long_values(df: DataFrame, fields, carry=(), width: int | None = None, edges=None) -> DataFrame:
    """One row per non-null value: (carry…, field, bucket, value)."""
    bucketed = add_range_buckets(df, fields, width, edges=edges)
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                # never NULL, so both uses of the counts plan alike and share a shuffle
                F.coalesce(F.col(f + "_bucket").cast("int"), F.lit(0)).alias("bucket"),
                F.col(f).alias("value"),
            )
            for f in fields
        ]
    )
    return (
        bucketed.select(*carry, F.explode(cells).alias("cell"))
        .select(*carry, "cell.*")
        .where(F.col("value").isNotNull())
    )


def running_counts(values: DataFrame, counts: dict[str, Column], by=("field",)) -> DataFrame:
    """Distinct values with counts, running counts and the next larger value.

    `values` has the `by` columns plus `bucket` and `value`; `counts` names aggregates to
    accumulate. Output adds, per name n: n (own), cum_n (through this value), total_n.
    """
    by = list(by)
    points = values.groupBy(*by, "bucket", "value").agg(
        *[c.cast("bigint").alias(n) for n, c in counts.items()]
    )
    buckets = points.groupBy(*by, "bucket").agg(
        *[F.sum(n).alias(f"sum_{n}") for n in counts], F.min("value").alias("first_value")
    )
    # At most (width x fields) rows, whatever the data: safe to broadcast.
    across = Window.partitionBy(*by).orderBy("bucket")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        *by,
        "bucket",
        *[F.coalesce(F.sum(f"sum_{n}").over(before), F.lit(0)).alias(f"off_{n}") for n in counts],
        *[F.sum(f"sum_{n}").over(Window.partitionBy(*by)).alias(f"total_{n}") for n in counts],
        F.lead("first_value").over(across).alias("after_bucket"),
    )
    inside = Window.partitionBy(*by, "bucket").orderBy("value")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return points.join(F.broadcast(offsets), [*by, "bucket"]).select(
        *by,
        "bucket",
        "value",
        *counts,
        *[(F.col(f"off_{n}") + F.sum(n).over(upto)).alias(f"cum_{n}") for n in counts],
        *[f"total_{n}" for n in counts],
        F.coalesce(F.lead("value").over(inside), F.col("after_bucket")).alias("next_value"),
    )


def value_steps(df: DataFrame, fields) -> DataFrame:
    """One-sample version: n, cum_n, total_n per distinct value of every field."""
    return running_counts(long_values(df.select(*fields), fields), {"n": F.count(F.lit(1))})


def quantiles_from_steps(steps: DataFrame, probs, by=("field",)) -> DataFrame:
    """Exact quantiles with linear interpolation: (by…, prob, quantile)."""
    marks = []
    for p in probs:
        at = F.lit(float(p)) * (F.col("total_n") - 1)
        low = F.min(F.when(F.col("cum_n") > F.floor(at), F.col("value")))
        high = F.min(F.when(F.col("cum_n") > F.ceil(at), F.col("value")))
        share = F.first(at - F.floor(at))
        marks.append(
            F.struct(
                F.lit(float(p)).alias("prob"), (low + (high - low) * share).alias("quantile")
            )
        )
    return (
        steps.groupBy(*by)
        .agg(F.array(*marks).alias("marks"))
        .select(*by, F.explode("marks").alias("mark"))
        .select(*by, "mark.*")
    )


def exact_quantiles(df: DataFrame, fields, probs) -> DataFrame:
    return quantiles_from_steps(value_steps(df, fields), probs)
