"""Linear identities among columns: sums that hold in every row, found without trying sums.

A table's columns obey a linear identity exactly if their covariance matrix has a null vector.
The matrix comes from one aggregation, its null space is worked out on the driver (its size is
the number of columns, squared), and a second aggregation measures each identity's largest
residual, so what is reported was checked on every row.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.coerce import Fields

#: Share of the total variance below which a direction counts as constant.
FLAT = 1e-10
LARGEST_DENOMINATOR = 1000
RESULT = "dependent string, identity string, terms int, max_abs_residual double, n long, holds boolean, leaks boolean"


def _snapped(value: float) -> float:
    """The nearest small fraction, if the value is one up to rounding."""
    near = Fraction(value).limit_denominator(LARGEST_DENOMINATOR)
    return float(near) if abs(float(near) - value) <= 1e-5 * max(1.0, abs(value)) else value


def null_identities(covariance: np.ndarray) -> list[tuple[int, dict[int, float]]]:
    """(position, {other position: coefficient}) of a basis of all identities.

    In reduced echelon form: each identity expresses one column by columns that no other
    identity expresses. The first column is expressed if any identity holds it, then the last ones.
    """
    spread = np.sqrt(np.diag(covariance))
    moving = [int(i) for i in np.flatnonzero(spread > 0)]
    found: list[tuple[int, dict[int, float]]] = [(int(i), {}) for i in np.flatnonzero(spread == 0)]
    if not moving:
        return found
    sd = spread[moving]
    values, vectors = np.linalg.eigh(covariance[np.ix_(moving, moving)] / np.outer(sd, sd))
    rows = vectors[:, values < FLAT * len(moving)].T
    order = [0, *range(len(moving) - 1, 0, -1)]
    at, pivots = 0, []
    for column in order:
        if at == len(rows):
            break
        pivot = at + int(np.argmax(np.abs(rows[at:, column])))
        if abs(rows[pivot, column]) < 1e-6:
            continue
        rows[[at, pivot]] = rows[[pivot, at]]
        rows[at] /= rows[at, column]
        for other in range(len(rows)):
            if other != at:
                rows[other] -= rows[other, column] * rows[at]
        pivots.append(column)
        at += 1
    for own, row in zip(pivots, rows):
        raw = {c: -row[c] * sd[own] / sd[c] for c in range(len(moving)) if c != own and abs(row[c]) > 1e-6}
        found.append((moving[own], {moving[c]: _snapped(v) for c, v in raw.items()}))
    return found


def _text(names: list[str], parts: dict[int, float], constant: float) -> str:
    def one(name: str, c: float) -> str:
        size = "" if abs(c) == 1.0 else f"{abs(c):.6g}*"
        return f"{'-' if c < 0 else '+'}{size}{name}"

    shown = "".join(one(names[i], c) for i, c in sorted(parts.items()))
    return shown + (f"{constant:+.6g}" if constant or not parts else "")


def linear_identities(
    df: DataFrame, target: str = S.SLA, features=None, tolerance: float = 1e-6
) -> DataFrame:
    """(dependent, identity, terms, max_abs_residual, n, holds, leaks), a row per identity.

    All linear identities of target and features follow from the rows. `holds`: the residual
    stays below `tolerance` in every row. `leaks`: it holds and gives the target. Identities are
    looked for in the rows without a NULL or NaN among the columns (without such rows there is
    none) and checked on the n rows that know their own columns. A constant column is one by itself.
    """
    names = [target, *[c for c in (features or S.DURATION_COLUMNS) if c != target and c in df.columns]]
    f = Fields(df)
    values = [f.number(c).cast("double") for c in names]
    rows = df.select(*[F.when(~F.isnan(v), v).alias(f"v{i}") for i, v in enumerate(values)])
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in rows.columns])
    k = len(names)
    pairs = list(combinations_with_replacement(range(k), 2))
    facts = rows.where(known).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"v{i}").alias(f"m{i}") for i in range(k)],
        *[(F.min(f"v{i}") == F.max(f"v{i}")).alias(f"fixed{i}") for i in range(k)],
        *[F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    spark = df.sparkSession
    if not facts["n"]:
        return spark.createDataFrame([], RESULT)
    covariance = np.zeros((k, k))
    for i, j in pairs:
        # Rounding leaves a constant column a little variance.
        if not (facts[f"fixed{i}"] or facts[f"fixed{j}"]):
            covariance[i, j] = covariance[j, i] = facts[f"c{i}_{j}"]
    found = null_identities(covariance)
    if not found:
        return spark.createDataFrame([], RESULT)
    shown, residuals = [], []
    for at, (own, parts) in enumerate(found):
        mean = facts[f"m{own}"] - sum(c * facts[f"m{i}"] for i, c in parts.items())
        constant = _snapped(mean) if abs(mean) > tolerance else 0.0
        total: Column = F.lit(constant)
        for i, c in parts.items():
            total = total + F.col(f"v{i}") * F.lit(c)
        residual = F.abs(F.col(f"v{own}") - total)
        residuals += [F.max(residual).alias(f"r{at}"), F.count(residual).alias(f"n{at}")]
        shown.append((names[own], _text(names, parts, constant), len(parts)))
    worst = rows.agg(*residuals).first()
    result = []
    for at, (own, _) in enumerate(found):
        holds = worst[f"r{at}"] < tolerance
        result.append((*shown[at], worst[f"r{at}"], worst[f"n{at}"], holds, holds and own == 0))
    return spark.createDataFrame(result, RESULT)
