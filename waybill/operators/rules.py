"""The denial constraints as boolean Columns: TRUE marks a violating row, never NULL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.coerce import Fields, days_between
from waybill.functions.small import broadcast_if_small

KNOWN_PAIR = "_pair_known"


@dataclass(frozen=True)
class Rule:
    key: str
    hard: bool
    needs: tuple[str, ...]
    violated: Callable[[Fields], Column]


def _false_if_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def absent(f: Fields, name: str, marks=None) -> Column:
    """NULL or one of the texts that stand for a missing value."""
    col = f.text(name)
    return col.isNull() | col.isin(marks or S.ABSENT_MARKS)


def in_label_domain(f: Fields) -> Column:
    return _false_if_null(f.number(S.LABEL).isin([float(v) for v in S.LABELS]))


def _event_chain(f: Fields) -> Column:
    chain = (f.stamp(S.CAPTURE) <= f.stamp(S.SHIP)) & (f.stamp(S.SHIP) <= f.stamp(S.DELIVERY))
    if f.has(S.PROMISE_SHIP, S.PROMISE_DELIVERY):
        promise = f.stamp(S.PROMISE_SHIP) <= f.stamp(S.PROMISE_DELIVERY)
        chain = chain & F.coalesce(promise, F.lit(True))
    return ~_false_if_null(chain)


def _label_disagrees(f: Fields) -> Column:
    sla = days_between(f.stamp(S.DELIVERY), f.stamp(S.PROMISE_DELIVERY))
    expected = F.when(sla >= 0, 0.0).when(-sla <= S.LATE_DAYS, 1.0).otherwise(2.0)
    return ~f.number(S.LABEL).eqNullSafe(expected)


def _pair_missing(f: Fields) -> Column:
    if f.has(KNOWN_PAIR):
        return F.col(KNOWN_PAIR).isNull()
    return absent(f, "last_scac") | absent(f, "carrier_service_code")


def _on_closed_day(f: Fields) -> Column:
    day, carrier = F.weekday(f.stamp(S.DELIVERY)), f.text("last_scac")
    closed = day.isin(S.CLOSED_DAYS_OTHER)
    rule = F
    for name, days in S.CLOSED_DAYS.items():
        rule = rule.when(carrier == name, day.isin(days))
    return _false_if_null(rule.otherwise(closed))


RULES = [
    Rule("R1_temporal_order", True, tuple(S.REQUIRED_DATES), _event_chain),
    Rule(
        "R2_positive_transit",
        True,
        (S.TRANSIT,),
        lambda f: _false_if_null(f.number(S.TRANSIT) <= 0),
    ),
    Rule(
        "RPT_non_negative_promised_transit",
        True,
        (S.PROMISED,),
        lambda f: _false_if_null(f.number(S.PROMISED) < 0),
    ),
    Rule(
        "R3_non_negative_capture_latency",
        True,
        (S.LATENCY,),
        lambda f: _false_if_null(f.number(S.LATENCY) < F.lit(-S.CLOCK_SKEW_DAYS)),
    ),
    Rule(
        "R3b_label_sla_consistency",
        True,
        (S.PROMISE_DELIVERY, S.DELIVERY, S.LABEL),
        _label_disagrees,
    ),
    Rule(
        "R4_referential_integrity", True, ("last_scac", "carrier_service_code"), _pair_missing
    ),
    Rule("R5_label_cardinality", True, (S.LABEL,), lambda f: ~in_label_domain(f)),
    Rule("R6_scac_calendar_soft", False, (S.DELIVERY, "last_scac"), _on_closed_day),
]
RULE_KEYS = [r.key for r in RULES]


def applicable(df: DataFrame, keys=None) -> list[Rule]:
    """Rules whose input columns exist; the others are left out of the plan."""
    f = Fields(df)
    return [r for r in RULES if (keys is None or r.key in keys) and f.has(*r.needs)]


def carrier_vocabulary(real: DataFrame) -> DataFrame:
    """Distinct (carrier, service) pairs of real data, without missing-value marks."""
    f = Fields(real)
    pair = ["last_scac", "carrier_service_code"]
    if not f.has(*pair):
        return real.sparkSession.createDataFrame([], "last_scac string, carrier_service_code string")
    present = ~absent(f, pair[0], S.ABSENT_MARKS_VOCABULARY) & ~absent(
        f, pair[1], S.ABSENT_MARKS_VOCABULARY
    )
    return real.where(present).select(*[f.text(c).alias(c) for c in pair]).distinct()


def with_known_pairs(df: DataFrame, vocabulary: DataFrame | None) -> DataFrame:
    """Marks rows whose carrier pair is in the vocabulary (`_pair_known` is NULL elsewhere)."""
    f = Fields(df)
    if vocabulary is None or not f.has("last_scac", "carrier_service_code"):
        return df
    known = broadcast_if_small(vocabulary).select(
        F.col("last_scac").alias("_scac"),
        F.col("carrier_service_code").alias("_service"),
        F.lit(True).alias(KNOWN_PAIR),
    )
    same = (f.text("last_scac") == F.col("_scac")) & (
        f.text("carrier_service_code") == F.col("_service")
    )
    return df.join(known, same, "left").drop("_scac", "_service")
