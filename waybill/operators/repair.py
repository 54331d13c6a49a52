"""Row repairs and rejection filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.coerce import Fields
from waybill.operators.derive import add_durations, label_from_sla
from waybill.operators.rules import absent, in_label_domain

MIN_TRANSIT = 0.01


def deterministic_repair(df: DataFrame, rederive: bool = False) -> DataFrame:
    """Pulls late-starting events forward, fills and clips durations, drops bad labels.

    Durations are repaired on their own; `rederive=True` first recomputes them from the
    repaired dates.
    """
    f = Fields(df)
    for earlier, later in [(S.CREATED, S.CAPTURE), (S.CAPTURE, S.SHIP), (S.SHIP, S.DELIVERY)]:
        if f.has(earlier, later):
            a, b = Fields(df).stamp(earlier), Fields(df).stamp(later)
            df = df.withColumn(later, F.when(b < a, a).otherwise(b))
    if rederive:
        df = add_durations(df)
    f = Fields(df)

    def fixed(name: str, fill: float, least: float | None) -> Column:
        value = F.coalesce(f.number(name), F.lit(fill)) if f.has(name) else F.lit(fill)
        return value if least is None else F.greatest(value, F.lit(least))

    # Latency and transit are created when absent; an absent transit starts from zero.
    changes = {
        S.LATENCY: fixed(S.LATENCY, 0.0, 0.0),
        S.TRANSIT: fixed(S.TRANSIT, MIN_TRANSIT, MIN_TRANSIT),
    }
    for name, least in [(S.PROMISED, 0.0), (S.BUFFER, None), (S.SLA, None)]:
        if f.has(name):
            changes[name] = fixed(name, 0.0, least)
    return df.withColumns(changes).where(in_label_domain(Fields(df)))


# Name of a rejection rule, the columns it needs, and the test a kept row passes.
REJECTION_RULES = {
    "transit": ((S.TRANSIT,), lambda f: f.number(S.TRANSIT) > 0),
    "label": ((S.LABEL,), in_label_domain),
    "carrier": (("last_scac",), lambda f: ~absent(f, "last_scac")),
    "service": (("carrier_service_code",), lambda f: ~absent(f, "carrier_service_code")),
    "order": (
        tuple(S.REQUIRED_DATES),
        lambda f: (f.stamp(S.CAPTURE) <= f.stamp(S.SHIP)) & (f.stamp(S.SHIP) <= f.stamp(S.DELIVERY)),
    ),
}


def rejection_predicate(df: DataFrame, rules=None) -> Column:
    """TRUE on rows the rejection filter keeps; a NULL in any tested column rejects.

    rules: names of REJECTION_RULES, all by default. A rule whose columns are missing doesn't apply.
    """
    f = Fields(df)
    names = REJECTION_RULES if rules is None else rules
    tests = [test(f) for columns, test in (REJECTION_RULES[n] for n in names) if f.has(*columns)]
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def rejection_filter(df: DataFrame, rules=None) -> DataFrame:
    return df.where(rejection_predicate(df, rules))


def tier_predicate(df: DataFrame, level: str) -> Column:
    """TRUE on rows that none / moderate / strict rejection keeps, for rows without dates; NULL rejects."""
    if level not in ("moderate", "strict"):
        return F.lit(True)
    f = Fields(df)
    keep = (f.number(S.TRANSIT) > 0) & (f.number(S.PROMISED) >= 0) & in_label_domain(f)
    if level == "strict":
        keep = keep & (f.number(S.LABEL) == label_from_sla(f.number(S.SLA)))
    return F.coalesce(keep, F.lit(False))


def tiered_rejection(df: DataFrame, level: str) -> DataFrame:
    """The rows that a tier keeps."""
    return df.where(tier_predicate(df, level))
