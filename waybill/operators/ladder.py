"""The strictness ladder: cumulative constraint specs and their enforcement as filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.coerce import Fields
from waybill.functions.small import broadcast_if_small

PAIR = ("last_scac", "carrier_service_code")


@dataclass(frozen=True)
class Spec:
    """One declarative constraint: kind, its columns, and a bound where there is one."""

    level: str
    kind: str
    columns: tuple[str, ...]
    value: float | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}({','.join(self.columns)})"


# ---- Fixed values: the ladder. A level has the rows of its own name and of those above. ----
LADDER_SPECS = (
    Spec("temporal", "ScalarInequality", (S.TRANSIT,), 0.01),
    Spec("temporal", "Inequality", (S.CAPTURE, S.SHIP)),
    Spec("temporal", "Inequality", (S.SHIP, S.DELIVERY)),
    Spec("temporal", "Inequality", (S.PROMISE_SHIP, S.PROMISE_DELIVERY)),
    Spec("moderate", "ScalarInequality", (S.LATENCY,), 0.0),
    Spec("moderate", "ScalarInequality", (S.PROMISED,), 0.0),
    Spec("moderate", "ScalarInequality", (S.BUFFER,), 0.0),
    Spec("moderate", "ScalarInequality", (S.DISTANCE,), 0.0),
    Spec("strict", "FixedCombinations", PAIR),
)


def depth_of(level: str | None) -> int:
    """Place of a level on the ladder; names it doesn't know ask for nothing."""
    name = (level or "").lower()
    return S.LADDER.index(name) if name in S.LADDER else 0


def build_specs(train: DataFrame, level: str) -> list[Spec]:
    """The ladder's specs up to a level whose columns all hold some value in `train`."""
    asked = [s for s in LADDER_SPECS if S.LADDER.index(s.level) <= depth_of(level)]
    columns = {c for s in asked for c in s.columns if c in train.columns}
    if not columns:
        return []
    row = train.agg(*[F.count(c).alias(c) for c in sorted(columns)]).first()
    filled = {c for c in columns if row[c]}
    return [s for s in asked if filled.issuperset(s.columns)]


def spec_table(train: DataFrame) -> DataFrame:
    """(level, position, kind, column_names, value): the ladder of a table, level by level."""
    rows = []
    strictest = build_specs(train, "strict")
    for depth, level in enumerate(S.LADDER):
        kept = [s for s in strictest if S.LADDER.index(s.level) <= depth]
        rows += [
            (level, i, s.kind, ",".join(s.columns), s.value) for i, s in enumerate(kept, start=1)
        ]
    return train.sparkSession.createDataFrame(
        rows, "level string, position bigint, kind string, column_names string, value double"
    )


_COMBO = "_combo_known"


def known_combinations(train: DataFrame, specs) -> DataFrame | None:
    """Distinct pairs of `train`, however many; None where no spec asks for them."""
    if not any(s.kind == "FixedCombinations" for s in specs):
        return None
    return broadcast_if_small(train.select(*PAIR).distinct())


def _with_combinations(df: DataFrame, known: DataFrame | None) -> DataFrame:
    """Marks rows whose pair is among the known ones; a pair with a missing value needs no mark."""
    if known is None or not set(PAIR) <= set(df.columns):
        return df
    seen = known.select(*[F.col(c).alias(f"_k_{c}") for c in PAIR], F.lit(True).alias(_COMBO))
    same = (F.col(PAIR[0]) == F.col(f"_k_{PAIR[0]}")) & (F.col(PAIR[1]) == F.col(f"_k_{PAIR[1]}"))
    return df.join(seen, same, "left").drop(*[f"_k_{c}" for c in PAIR])


def _holds(f: Fields, spec: Spec) -> Column:
    """Whether a spec holds; a missing operand passes."""
    if spec.kind == "Inequality":
        ok = f.stamp(spec.columns[0]) <= f.stamp(spec.columns[1])
    elif spec.kind == "ScalarInequality":
        ok = f.number(spec.columns[0]) >= F.lit(spec.value)
    else:
        both = f.text(spec.columns[0]).isNotNull() & f.text(spec.columns[1]).isNotNull()
        ok = F.when(both, F.col(_COMBO).isNotNull()) if f.has(_COMBO) else F.lit(True)
    return F.coalesce(ok, F.lit(True))


def passes(df: DataFrame, specs, level: str = "strict") -> Column:
    """Whether the specs up to a level hold; `df` is marked with its combinations."""
    f = Fields(df)
    keep = F.lit(True)
    for s in specs:
        if S.LADDER.index(s.level) <= depth_of(level) and f.has(*s.columns):
            keep = keep & _holds(f, s)
    return keep


def ladder_filter(df: DataFrame, level: str, train: DataFrame | None = None) -> DataFrame:
    """Keeps the rows on which every spec of `level` (learned on `train`) holds."""
    train = df if train is None else train
    specs = build_specs(train, level)
    marked = _with_combinations(df, known_combinations(train, specs))
    return marked.where(passes(marked, specs)).select(*df.columns)


def level_marks(train: DataFrame, levels, prefix: str = "_keep_"):
    """A function that adds one boolean column per strictness level, with specs and pairs learned once.

    levels: (name, ladder level, whether rejection follows).
    """
    from waybill.operators.repair import rejection_predicate

    deepest = max((level for _, level, _ in levels), key=depth_of, default="none")
    specs = build_specs(train, deepest)
    known = known_combinations(train, specs)

    def mark(df: DataFrame) -> DataFrame:
        marked = _with_combinations(df, known)
        rejects = rejection_predicate(df)
        columns = {
            f"{prefix}{name}": passes(marked, specs, level) & rejects if reject else passes(marked, specs, level)
            for name, level, reject in levels
        }
        return marked.withColumns(columns).select(*df.columns, *columns)

    return mark


def spec_drop_counts(df: DataFrame, level: str, train: DataFrame | None = None) -> DataFrame:
    """(spec, dropped, n): how many rows each spec of a level would drop on its own."""
    train = df if train is None else train
    specs = build_specs(train, level)
    marked = _with_combinations(df, known_combinations(train, specs))
    f = Fields(marked)
    names = [s.name for s in specs]
    one = marked.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(~_holds(f, s)).alias(s.name) for s in specs],
    )
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return one.selectExpr(f"stack({len(names)}, {pairs}) as (spec, dropped)", "n")


def strictness_survivors(df: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """(level, position, survivors) for every strictness level, from one aggregation."""
    marked = level_marks(df if train is None else train, S.STRICTNESS)(df)
    one = marked.agg(*[F.count_if(f"_keep_{name}").alias(f"s{i}") for i, (name, _, _) in enumerate(S.STRICTNESS)])
    lines = ", ".join(f"'{name}', {i}L, s{i}" for i, (name, _, _) in enumerate(S.STRICTNESS))
    return one.selectExpr(f"stack({len(S.STRICTNESS)}, {lines}) as (level, position, survivors)")
