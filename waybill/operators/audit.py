"""Constraint audits. Every rule is counted in one aggregation over one scan."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.coerce import Fields
from waybill.operators import custom
from waybill.operators.rules import KNOWN_PAIR, applicable, in_label_domain, with_known_pairs

WEAK_RULE = "R4_referential_integrity"


def _flags(df: DataFrame, vocabulary, keys=None):
    """The table with a `_v_<key>` flag per applicable rule, and those rules."""
    rules = applicable(df, keys)
    if any(r.key == WEAK_RULE for r in rules):
        if vocabulary is None:
            warnings.warn(
                "no carrier vocabulary given: referential integrity checks presence only",
                UserWarning,
                stacklevel=3,
            )
        else:
            df = with_known_pairs(df, vocabulary)
    f = Fields(df)
    return df.withColumns({f"_v_{r.key}": r.violated(f) for r in rules}), rules


def _as_rows(one_row: DataFrame, names, key: str, value: str, keep=("n",)) -> DataFrame:
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return one_row.selectExpr(*keep, f"stack({len(names)}, {pairs}) as (`{key}`, `{value}`)")


def audit_counts(df: DataFrame, vocabulary: DataFrame | None = None, keys=None) -> DataFrame:
    """(audit_key, violations, n): one row per rule whose inputs are present."""
    flagged, rules = _flags(df, vocabulary, keys)
    one = flagged.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(f"_v_{r.key}").alias(r.key) for r in rules]
    )
    return _as_rows(one, [r.key for r in rules], "audit_key", "violations").select(
        "audit_key", "violations", "n"
    )


def audit_summary(df: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """One row of totals. `violation_rate_pct` divides rule hits by rows and may pass 100;
    `violating_rows` counts rows with at least one hard violation."""
    flagged, rules = _flags(df, vocabulary)
    hard = [f"_v_{r.key}" for r in rules if r.hard]
    hits = sum((F.count_if(c) for c in hard[1:]), F.count_if(hard[0]))
    anyhow = F.col(hard[0])
    for c in hard[1:]:
        anyhow = anyhow | F.col(c)
    return flagged.agg(
        F.count(F.lit(1)).alias("n"),
        hits.alias("total_hard_violations"),
        F.count_if(anyhow).alias("violating_rows"),
    ).select(
        "n",
        "total_hard_violations",
        "violating_rows",
        F.when(F.col("n") == 0, 0.0)
        .otherwise(F.round(F.col("total_hard_violations") * 100.0 / F.col("n"), 4))
        .alias("violation_rate_pct"),
    )


CATALOG_FIELDS = ["id", "name", "category", "type", "severity", "on_violation"]


def catalog_audit(
    df: DataFrame,
    catalog: DataFrame,
    vocabulary: DataFrame | None = None,
    include_custom: bool = True,
) -> DataFrame:
    """Catalog entries with live counts, then registered custom constraints.

    `status` tells an evaluated rule from one that could not be (counted as 0) and from the
    presence-only stand-in of the membership rule.
    """
    extra = custom.registered() if include_custom else []
    flagged, rules = _flags(df, vocabulary)
    own = {f"custom_{i}": c for i, c in enumerate(extra)}
    one = flagged.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(f"_v_{r.key}").alias(r.key) for r in rules],
        *[F.count_if(c.violated(df)).alias(k) for k, c in own.items()],
    )
    counts = _as_rows(one, [r.key for r in rules] + list(own), "counted", "hits")

    spark = df.sparkSession
    seeded = catalog.select(*CATALOG_FIELDS, "audit_key", F.col("audit_key").alias("counted"))
    entries = seeded.withColumn("source", F.lit("seed"))
    if own:
        rows = [
            (c.id, c.name, c.category, c.type, c.severity, c.on_violation, None, k, "custom")
            for k, c in own.items()
        ]
        fields = [*CATALOG_FIELDS, "audit_key", "counted", "source"]
        entries = entries.unionByName(
            spark.createDataFrame(rows, ", ".join(f"{c} string" for c in fields))
        )
    total = flagged.agg(F.count(F.lit(1)).alias("n")).scalar() if not rules else None
    joined = entries.join(counts, "counted", "left")
    n = F.max("n").over(_everything()) if total is None else total
    joined = joined.withColumn("n", n)
    weak = vocabulary is None
    return joined.select(
        *CATALOG_FIELDS,
        "audit_key",
        F.coalesce("hits", F.lit(0)).cast("bigint").alias("violations"),
        F.col("n").cast("bigint").alias("n"),
        F.when(F.col("n") > 0, F.round(F.coalesce("hits", F.lit(0)) * 100.0 / F.col("n"), 4)).alias(
            "violation_rate_pct"
        ),
        "source",
        F.when(F.col("hits").isNull(), "not_evaluated")
        .when((F.col("audit_key") == WEAK_RULE) & F.lit(weak), "weak")
        .otherwise("evaluated")
        .alias("status"),
    )


def _everything():
    """Window over a whole table; used on catalog-sized tables only."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def violation_rows(df: DataFrame, vocabulary: DataFrame | None = None, keep=(S.ROW_ID,)):
    """Rows breaking at least one rule, with the sorted keys of the broken rules."""
    flagged, rules = _flags(df, vocabulary)
    hits = F.array_compact(F.array(*[F.when(F.col(f"_v_{r.key}"), r.key) for r in rules]))
    return flagged.select(*keep, F.array_sort(hits).alias("violated")).where(F.size("violated") > 0)


def flag_hard(df: DataFrame, vocabulary: DataFrame | None = None, keys=None) -> DataFrame:
    """Adds `quarantined`: whether the row breaks any hard rule (of `keys`, if given)."""
    columns = df.columns
    flagged, rules = _flags(df, vocabulary, keys)
    broken = F.lit(False)
    for r in rules:
        if r.hard:
            broken = broken | F.col(f"_v_{r.key}")
    return flagged.withColumn("quarantined", broken).select(*columns, "quarantined")


def quarantine_split(df: DataFrame, vocabulary: DataFrame | None = None, keys=None):
    """(clean rows, quarantined rows)."""
    marked = flag_hard(df, vocabulary, keys)
    return (
        marked.where(~F.col("quarantined")).drop("quarantined"),
        marked.where(F.col("quarantined")).drop("quarantined"),
    )


def integrity_hits(df: DataFrame) -> Column:
    """How many of the three narrow rules a row hits."""
    f = Fields(df)
    rules = []
    if f.has(S.TRANSIT):
        rules.append(f.number(S.TRANSIT) <= 0)
    if f.has(S.LATENCY):
        rules.append(f.number(S.LATENCY) < 0)
    if f.has(S.LABEL):
        rules.append(~in_label_domain(f))
    return sum([F.coalesce(r, F.lit(False)).cast("int") for r in rules], F.lit(0))


def integrity_score(df: DataFrame) -> DataFrame:
    """One row: hits of the three narrow rules as a share of rows, in percent."""
    hits = F.coalesce(F.sum(integrity_hits(df)), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n"), hits.cast("bigint").alias("violations")).select(
        "n",
        "violations",
        F.when(F.col("n") == 0, 0.0)
        .otherwise(F.round(F.col("violations") * 100.0 / F.col("n"), 4))
        .alias("integrity_violation_pct"),
    )


__all__ = [
    "KNOWN_PAIR",
    "audit_counts",
    "audit_summary",
    "catalog_audit",
    "flag_hard",
    "integrity_score",
    "quarantine_split",
    "violation_rows",
]
