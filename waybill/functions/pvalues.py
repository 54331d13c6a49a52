"""Two-sided p-values of test statistics as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybill.functions.normal import normal_cdf

EXACT_DF = 10_000
EXACT_PAIRS = 50


def _two_tails(z: Column) -> Column:
    return F.least(F.lit(1.0), 2.0 * (1.0 - normal_cdf(F.abs(z))))


def _series(cos2: Column, terms: Column, up, down) -> Column:
    """1 + r(1) c + r(1) r(2) c^2 + …, `terms` summands, with r(k) = up(k) / down(k)."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * cos2 * up(k) / down(k)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    further = F.aggregate(
        F.sequence(F.lit(1), F.greatest(terms - 1, F.lit(1))), start, step, lambda s: s["total"]
    )
    return F.when(terms < 1, 0.0).when(terms < 2, 1.0).otherwise(further)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom.

    The central mass is a finite sum in the angle arctan(t / sqrt(df)), so the absolute error
    is that of a double; beyond 10,000 degrees t is scaled to a normal value (error below
    2e-7). NULL without a degree of freedom or where t is NULL or NaN; 0 where t is infinite.
    """
    nu = df.cast("int")
    t = t.cast("double")
    square = t * t
    cos2 = nu / (nu + square)
    sine = F.sqrt(square / (nu + square))
    even = sine * _series(cos2, F.floor(nu / 2).cast("int"), lambda k: 2 * k - 1, lambda k: 2 * k)
    odd = (2.0 / math.pi) * (
        F.atan(F.abs(t) / F.sqrt(nu))
        + sine
        * F.sqrt(cos2)
        * _series(cos2, F.floor((nu - 1) / 2).cast("int"), lambda k: 2 * k, lambda k: 2 * k + 1)
    )
    scaled = t * (1.0 - 1.0 / (4.0 * nu)) / F.sqrt(1.0 + square / (2.0 * nu))
    p = F.when(nu > EXACT_DF, _two_tails(scaled)).when(nu % 2 == 0, 1.0 - even).otherwise(1.0 - odd)
    return (
        F.when(t.isNull() | nu.isNull() | F.isnan(t) | (nu < 1), F.lit(None).cast("double"))
        .when(F.abs(t) == float("inf"), 0.0)
        .otherwise(F.greatest(F.lit(0.0), p))
    )


def wilcoxon_two_sided(w: Column, n: Column, tie_term: Column | None = None) -> Column:
    """Two-sided p of the smaller signed-rank sum: exact without ties up to 50 pairs,
    otherwise the normal approximation. `tie_term` is the sum of t^3 - t over tie groups.
    NULL without pairs or where no rank sum is known.
    """
    tie_term = F.lit(0.0) if tie_term is None else tie_term
    n = n.cast("int")

    def longer(ways: Column, rank: Column) -> Column:
        # Sign patterns by rank sum, with one rank more: it counts or it doesn't.
        return F.transform(
            F.sequence(F.lit(0), F.size(ways) - 1 + rank),
            lambda s: F.coalesce(F.get(ways, s), F.lit(0.0))
            + F.coalesce(F.get(ways, s - rank), F.lit(0.0)),
        )

    ways = F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(1.0)), longer)
    below = F.aggregate(
        F.slice(ways, F.lit(1), w.cast("int") + 1), F.lit(0.0), lambda total, x: total + x
    )
    exact = F.least(F.lit(1.0), 2.0 * below / F.pow(F.lit(2.0), n))
    size = n.cast("double")
    variance = size * (size + 1) * (2 * size + 1) / 24.0 - tie_term / 48.0
    distance = w - size * (size + 1) / 4.0
    return (
        F.when((n <= 0) | w.isNull() | n.isNull(), F.lit(None).cast("double"))
        .when((n <= EXACT_PAIRS) & (tie_term == 0) & (w == F.floor(w)), exact)
        .when(variance > 0, _two_tails(distance / F.sqrt(variance)))
    )
