"""Four-pillar evaluation of synthetic tables, over levels, generators and seeds."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.coerce import Fields
from waybill.functions.hashing import uniform
from waybill.functions.small import materialised, scalar, stored
from waybill.operators import audit, checks, fidelity, models, privacy, ranking, repair, utility
from waybill.operators.derive import category_codes, derive_features, feature_matrix, scale_stats
from waybill.operators.ecdf import add_range_buckets, quantiles_from_steps, running_counts
from waybill.operators.forest import binned, grown, outcomes
from waybill.operators.ladder import level_marks
from waybill.operators.ledger import js_divergence, ks_wasserstein, value_ledger
from waybill.operators.models import DEPTH, FOLDS, TREES
from waybill.operators.neighbours import nearest_distance
from waybill.operators.ranking import hash_rank, time_folds
from waybill.operators.repair import tier_predicate
from waybill.operators.resample import KEEP, Pool, draw_pool
from waybill.operators.rules import carrier_vocabulary
from waybill.operators.synth import bootstrap_index
from waybill.plans.generate import _strictness, generate, generator
from waybill.sources.catalog import load_catalog

#: Trees that are fitted and shared with the tasks at a time, over all cells.
TREES_AT_ONCE = 1_200
PILLARS = ("integrity", "fidelity", "privacy", "utility")
LONG_SCHEMA = "architecture string, level string, seed int, metric string, value double"


def evaluate_synth(real: DataFrame, synth: DataFrame, baseline: DataFrame, **options) -> DataFrame:
    """(metric, value): the ten sweep metrics of one synthetic table."""
    near = privacy.dcr_summary(privacy.dcr_distances(real, synth)).first()
    nnaa = privacy.nnaa_score(privacy.nnaa_distances(real, synth)).first()
    scored = models.tstr_evaluate(real, synth, baseline, **options).first()
    ks = fidelity.ks_complement(real, synth).agg(F.round(F.avg("ks"), 4)).first()[0]
    js = fidelity.js_divergence(real, synth).agg(F.round(F.avg("js"), 4)).first()[0]
    cvr = audit.integrity_score(synth).first()["integrity_violation_pct"]
    values = {
        "dcr_mean": near["dcr_mean"],
        "dcr_p5": near["dcr_p5"],
        "nnaa": nnaa["nnaa"],
        "business_utility": scored["business_utility"],
        "f1_gap": scored["f1_gap_vs_trtr"],
        "l2_recall": scored["label2_recall"],
        "bus_ratio": scored["bus_ratio_vs_trtr"],
        "ks_mean": ks,
        "js_mean": js,
        "cvr": cvr,
    }
    rows = [(m, float(values[m])) for m in S.SWEEP_METRICS if values[m] is not None]
    return real.sparkSession.createDataFrame(rows, "metric string, value double")


# ---- Sweeps: all cells in joint plans ----------------------------------------------------
@dataclass(frozen=True)
class Grid:
    """Cells of a sweep. A run is one generator and seed; its levels filter the same draws."""

    levels: list[str]
    architectures: list[str]
    seeds: list[int]

    @property
    def runs(self) -> list[tuple[str, str, int]]:
        return [(f"{a}|{s}", a, s) for a in self.architectures for s in self.seeds]

    @property
    def size(self) -> int:
        return len(self.runs) * len(self.levels)

    def cell(self, run: Column, level: Column) -> Column:
        """Number of a cell, from the run's name and the level's place."""
        names = F.array(*[F.lit(r) for r, _, _ in self.runs])
        return ((F.array_position(names, run) - 1) * len(self.levels) + level).cast("int")

    def named(self, measured: DataFrame) -> DataFrame:
        """(architecture, level, seed, metric, value) of (cell, metric, value)."""
        rows = [
            (i * len(self.levels) + j, a, level, int(s))
            for i, (_, a, s) in enumerate(self.runs)
            for j, level in enumerate(self.levels)
        ]
        cells = measured.sparkSession.createDataFrame(rows, "cell int, architecture string, level string, seed int")
        return measured.join(F.broadcast(cells), "cell").select("architecture", "level", "seed", "metric", "value")


def _drawn(real: DataFrame, grid: Grid, n: int) -> Pool:
    """The draws of all runs, with the first n survivors of every level."""
    spec = [(level, *_strictness(level)) for level in grid.levels]
    mark = level_marks(real, spec, KEEP)
    index = {s: bootstrap_index(real, s) for s in grid.seeds if set(grid.architectures) - {"copula"}}
    return draw_pool({run: (generator(real, a, s, index.get(s)), mark) for run, a, s in grid.runs}, n, list(grid.levels))


def _by_level(rows: DataFrame, grid: Grid, *columns) -> DataFrame:
    """The rows once for each of their cells, numbered in `cell`."""
    places = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.lit(i)) for i in range(len(grid.levels))]))
    long = rows.withColumn("_level", F.explode(places))
    return long.withColumn("cell", grid.cell(F.col("run"), F.col("_level"))).select("cell", *columns)


def _compared(real: DataFrame, grid: Grid) -> dict[tuple[str, ...], list[str]]:
    """Duration columns that a run's rows share with the real ones -> those runs."""
    out: dict[tuple[str, ...], list[str]] = {}
    for run, architecture, _ in grid.runs:
        names = S.COPULA_COLUMNS if architecture == "copula" else S.DURATION_COLUMNS
        out.setdefault(tuple(c for c in S.DURATION_COLUMNS if c in names and c in real.columns), []).append(run)
    return out


def _long(wide: DataFrame, names) -> DataFrame:
    """(cell, metric, value) of one column per metric."""
    lines = ", ".join(f"'{m}', cast(`{m}` as double)" for m in names)
    return wide.selectExpr("cell", f"stack({len(names)}, {lines}) as (metric, value)")


def _statistics(pool: Pool, grid: Grid) -> DataFrame:
    level = F.array_position(F.array(*[F.lit(v) for v in grid.levels]), F.col("level")) - 1
    stats = pool.stats().withColumn("cell", grid.cell(F.col("run"), level))
    columns = {
        "reject_kept_n": F.least("survived", "n_target"),
        "reject_drawn": F.col("drawn"),
        "reject_survived": F.col("survived"),
        "reject_survival_rate": F.col("survival_rate"),
        "reject_cap_hit": F.col("cap_hit").cast("int"),
        "label2_raw_rate": F.col("raw_label2_rate"),
        "label2_kept_n": F.col("kept_label2_n"),
    }
    return _long(stats.select("cell", *[c.alias(m) for m, c in columns.items()]), columns)


def _integrity(rows: DataFrame, grid: Grid) -> DataFrame:
    """Violation percentage of every cell, in one pass."""
    hits = rows.select("run", "mask", audit.integrity_hits(rows).alias("hits"))
    per = [F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.col("hits")) for i in range(len(grid.levels))]
    one = hits.groupBy("run").agg(*[F.round(F.avg(c) * 100.0, 4).alias(f"v{i}") for i, c in enumerate(per)])
    lines = F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"v{i}").alias("cvr")) for i in range(len(grid.levels))])
    long = one.select("run", F.explode(lines).alias("line")).withColumn("cell", grid.cell(F.col("run"), F.col("line.at")))
    return _long(long.where("line.cvr is not null").select("cell", "line.cvr"), ["cvr"])


def _fidelity(real: DataFrame, rows: DataFrame, grid: Grid, columns, runs) -> DataFrame:
    """Mean KS and JS of the cells of `runs`, from one ledger."""
    book = value_ledger(real, rows.where(F.col("run").isin(runs)), list(columns), len(grid.levels))
    both = ks_wasserstein(book, len(grid.levels)).join(js_divergence(book, len(grid.levels)), ["run", "field", "cell"])
    means = both.withColumn("cell", grid.cell(F.col("run"), F.col("cell"))).groupBy("cell")
    wide = means.agg(F.round(F.avg("ks"), 4).alias("ks_mean"), F.round(F.avg("js"), 4).alias("js_mean"))
    return _long(wide, ["ks_mean", "js_mean"])


def _scaled_rows(rows: DataFrame, stats, columns, *keep) -> DataFrame:
    f = Fields(rows)
    z = [((F.coalesce(f.number(c), F.lit(0.0)) - stats[f"{c}__mean"]) / stats[f"{c}__sd"]).alias(c) for c in columns]
    return rows.select(*keep, *z)


#: Room for the draw ids of a run, or of a cell, in one number.
ROOM = 1 << 40


def _privacy(real: DataFrame, rows: DataFrame, grid: Grid, columns, runs, seed: int = 42) -> DataFrame:
    """Distances to the closest record and adversarial accuracy of the cells of `runs`.

    Every drawn row is searched among the real ones once, whatever levels it belongs to. Among
    synthetic rows each cell has neighbours of its own: one search that keeps the cells apart.
    """
    columns = list(columns)
    stats = scalar(scale_stats(real, columns))
    number = grid.cell(F.col("run"), F.lit(0)).cast("long") * ROOM + F.col("draw_id")
    own = rows.where(F.col("run").isin(runs)).withColumn("id", number)
    drawn = stored(_scaled_rows(own, stats, columns, "run", "draw_id", "mask", "id"))
    near = stored(nearest_distance(drawn, _scaled_rows(real, stats, columns), columns, key="id"))
    marked = drawn.select("run", "mask", "id").join(near, "id")
    long = _by_level(marked, grid, F.col("distance").alias("value"))
    values = add_range_buckets(long, ["value"]).withColumnRenamed("value_bucket", "bucket")
    steps = stored(running_counts(values.withColumn("bucket", F.col("bucket").cast("int")), {"n": F.count("*")}, by=["cell"]))
    mean = F.sum(F.col("value") * F.col("n")) / F.sum("n")
    means = steps.groupBy("cell").agg(F.round(F.round(mean, 6), 4).alias("dcr_mean"))
    fifth = quantiles_from_steps(steps, [0.05], ["cell"]).select("cell", F.round(F.round("quantile", 6), 4).alias("dcr_p5"))

    name = F.concat(F.lit("S"), F.col("draw_id").cast("string")).alias(S.ROW_ID)
    split = hash_rank(_by_level(drawn, grid, name, "id", "draw_id", *columns), "nnaa", seed, ["cell"])
    sizes = steps.groupBy("cell").agg(F.max("total_n").alias("_n"))
    # One row for each cell.
    split = split.join(F.broadcast(sizes), "cell").withColumn("is_test", F.col("_rank") > F.floor(F.col("_n") * privacy.TRAIN_SHARE))
    split = stored(split.withColumn("key", F.col("cell").cast("long") * ROOM + F.col("draw_id")).drop("_rank", "_n", S.ROW_ID))
    test, train = split.where("is_test"), split.where(~F.col("is_test"))
    among = nearest_distance(test, train, columns, key="key", out="d_synth", group="cell")
    held = test.select("cell", "key", "id").join(among, "key").join(near.withColumnRenamed("distance", "d_real"), "id")
    closer = F.avg((F.col("d_real") < F.col("d_synth")).cast("double"))
    accuracy = held.groupBy("cell").agg(F.round(F.coalesce(closer, F.lit(0.0)), 4).alias("nnaa"))
    out = _long(means, ["dcr_mean"]).unionByName(_long(fifth, ["dcr_p5"]))
    return out.unionByName(_long(accuracy, ["nnaa"]))


def _sampled(rows: DataFrame, key: Column, size: int, most: int | None, salt: str) -> DataFrame:
    """All rows; with a bound, about `most` of `size` rows by digest."""
    return rows if most is None or size <= most else rows.where(uniform(key, salt) < F.lit(most / size))


def _utility(real, rows, grid: Grid, n: int, baseline, features, trees: int, depth: int, fit_rows: int | None, k: int) -> DataFrame:
    """Forests of all cells, trained on synthetic and tested on real folds, against the real baseline.

    The baseline's folds are further cells of the same fit, unless it is given. Forests are fitted and
    tested a few cells at a time.
    """
    names = S.resolve_features(real.columns, features)
    codes = category_codes(real, [c[:-4] for c in names if c.endswith("_enc")])
    folded = stored(time_folds(feature_matrix(real, names, codes), k))
    draw = F.concat_ws("|", "run", "draw_id")
    some = _sampled(rows, draw, n, fit_rows, "sweep-fit").withColumn(S.ROW_ID, F.concat_ws("|", "mask", "run", "draw_id"))
    made = feature_matrix(some, names, codes).withColumns(
        {
            "mask": F.substring_index(S.ROW_ID, "|", 1).cast("int"),
            "run": F.concat_ws("|", F.get(F.split(S.ROW_ID, r"\|"), 1), F.get(F.split(S.ROW_ID, r"\|"), 2)),
        }
    )
    x = F.array(*names).alias("x")
    train = _by_level(stored(made.select("run", "mask", S.LABEL, x)), grid, S.LABEL, "x")
    tested = {fold: list(range(grid.size)) for fold in range(1, k + 1)}
    if baseline is None:
        sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
        for i in range(1, k + 1):
            before = folded.where(F.col("fold") < i).withColumn("cell", F.lit(grid.size + i))
            size = sum(c for fold, c in sizes.items() if fold < i)
            part = _sampled(before, F.col(S.ROW_ID), size, fit_rows, f"base-fit{i}")
            train = train.unionByName(part.select("cell", S.LABEL, x))
            tested[i] = [*tested[i], grid.size + i]
    held = binned(train)
    cells, few, counts = sorted({c for asked in tested.values() for c in asked}), max(1, TREES_AT_ONCE // trees), []
    for at in range(0, len(cells), few):
        now = cells[at : at + few]
        forests = {c: f.groups for c, f in grown(held, trees, depth, cells=now).items()}
        found = outcomes(forests, folded.where("fold > 0"), names, {fold: [c for c in asked if c in now] for fold, asked in tested.items()})
        counts += found.collect()
    # A few rows for each cell and fold.
    counts = real.sparkSession.createDataFrame(counts, found.schema)
    by = ["cell", "fold"]
    per_fold = utility.label_fold_metrics(counts, by).toPandas()
    if baseline is None:
        base = per_fold[per_fold["cell"] >= grid.size].round(4)
        base = {f"{m}_mean": round(float(base[m].mean()), 4) for m in ("weighted_f1", "business_utility", "label2_recall")}
    else:
        base = baseline.first().asDict()
    own = per_fold[per_fold["cell"] < grid.size].groupby("cell")[["weighted_f1", "business_utility", "label2_recall"]].mean().round(4)
    lines = []
    for cell, row in own.iterrows():
        best = base["business_utility_mean"]
        lines += [
            (int(cell), "business_utility", float(row["business_utility"])),
            (int(cell), "f1_gap", round(base["weighted_f1_mean"] - float(row["weighted_f1"]), 4)),
            (int(cell), "l2_recall", float(row["label2_recall"])),
            (int(cell), "bus_ratio", round(float(row["business_utility"]) / best, 4) if best > 0 else 0.0),
        ]
    return real.sparkSession.createDataFrame(lines, "cell int, metric string, value double")


def run_sweep(
    real: DataFrame,
    levels,
    architectures,
    seeds,
    n: int,
    baseline: DataFrame | None = None,
    features=None,
    trees: int = TREES,
    depth: int = DEPTH,
    fit_rows: int | None = None,
    k: int = FOLDS,
    pillars=PILLARS,
) -> DataFrame:
    """Long table of metrics and draw statistics of every (architecture, level, seed).

    All cells share their plans: draws are made once per architecture and seed and marked with the
    levels they pass; distances, fidelity, integrity and forests are worked out for all cells
    together, from all rows unless `fit_rows` bounds the rows each forest is fitted on.
    `pillars` limits what is measured besides the draws.
    """
    grid = Grid(list(levels), list(architectures), [int(s) for s in seeds])
    if not grid.size:
        return real.sparkSession.createDataFrame([], LONG_SCHEMA)
    real = materialised(real)
    pool = _drawn(real, grid, n)
    rows = pool.survivors()
    parts = [_statistics(pool, grid)]
    if "integrity" in pillars:
        parts.append(_integrity(rows, grid))
    for columns, runs in _compared(real, grid).items():
        parts += [_fidelity(real, rows, grid, columns, runs)] if "fidelity" in pillars else []
        parts += [_privacy(real, rows, grid, columns, runs)] if "privacy" in pillars else []
    if "utility" in pillars:
        parts.append(_utility(real, rows, grid, n, baseline, features, trees, depth, fit_rows, k))
    return grid.named(reduce(DataFrame.unionByName, parts))


def run_mia_audit(
    real: DataFrame, levels, architectures, seeds, n: int, share: float = 0.5, columns=None
) -> DataFrame:
    """Membership inference per generator, level and seed: the generator sees members only.

    Every real row is asked in every cell of its seed; the cells are searched together, apart from
    each other.
    """
    grid = Grid(list(levels), list(architectures), [int(s) for s in seeds])
    columns = [c for c in (columns or S.DURATION_COLUMNS) if c in real.columns]
    if "copula" in grid.architectures:
        columns = [c for c in columns if c in S.COPULA_COLUMNS]
    asked, held = [], []
    for seed in grid.seeds:
        marked = materialised(ranking.member_split(real, share, seed))
        members = marked.where("is_member").drop("is_member")
        drawn = _drawn(members, Grid(grid.levels, grid.architectures, [seed]), n).survivors()
        cells = [r * len(grid.levels) + j for r, (_, _, s) in enumerate(grid.runs) if s == seed for j in range(len(grid.levels))]
        queries, rows = _attack(marked, members, drawn, grid, columns, cells)
        asked.append(queries)
        held.append(rows)
    return grid.named(_attack_rates(reduce(DataFrame.unionByName, asked), reduce(DataFrame.unionByName, held), columns, grid.size))


def _attack(marked: DataFrame, members: DataFrame, drawn: DataFrame, grid: Grid, columns, cells: list[int]) -> tuple[DataFrame, DataFrame]:
    """Every real row once for each cell, and the rows of the cells, scaled by the members."""
    stats = scalar(scale_stats(members, columns))
    rows = _by_level(_scaled_rows(drawn, stats, columns, "run", "mask"), grid, *columns)
    queries = _scaled_rows(marked, stats, columns, "is_member")
    return queries.withColumn("cell", F.explode(F.array(*[F.lit(c) for c in cells]))), rows


def _attack_rates(asked: DataFrame, held: DataFrame, columns, cells: int) -> DataFrame:
    """AUC and hit rate of every cell, from one search that keeps the cells apart.

    A query's key is one number that ends in its cell and membership: it goes along on every visit.
    """
    mark = F.col("cell") * 2 + F.col("is_member").cast("int")
    queries = stored(asked.withColumn("key", F.monotonically_increasing_id() * (2 * cells) + mark).drop("is_member"))
    near = nearest_distance(queries, held, columns, key="key", group="cell")
    place = F.pmod("key", F.lit(2 * cells))
    scores = stored(near.select(F.floor(place / 2).cast("int").alias("cell"), (place % 2 == 1).alias("is_member"), (-F.col("distance")).alias("score")))
    rates = privacy.roc_auc(scores, ["cell"]).join(privacy.tpr_at_fpr(scores, by=["cell"]), "cell")
    return _long(rates, ["mia_auc", "mia_tpr_at_fpr"])


def evaluate_draws(
    real: DataFrame, rows: DataFrame, architecture: str = "TVAE", seed: int = 42, baseline: DataFrame | None = None, features=None,
    trees: int = TREES, depth: int = DEPTH, fit_rows: int | None = None, k: int = FOLDS,
) -> DataFrame:
    """(metric, value): the ten sweep metrics of numbered draws, as a sweep of one cell.

    The baseline's folds are fitted along with it unless it is given.
    """
    grid = Grid(["drawn"], [architecture], [int(seed)])
    ((run, _, _),) = grid.runs
    rows = stored(rows.withColumns({"run": F.lit(run), "mask": F.lit(1)}))
    parts = [_integrity(rows, grid)]
    for columns, runs in _compared(real, grid).items():
        parts += [_fidelity(real, rows, grid, columns, runs), _privacy(real, rows, grid, columns, runs, seed)]
    parts.append(_utility(real, rows, grid, rows.count(), baseline, features, trees, depth, fit_rows, k))
    return reduce(DataFrame.unionByName, parts).select("metric", "value")


#: Rejection tiers of the mechanism table, and how many draws it makes for each row it keeps at most.
TIERS = ("none", "moderate", "strict")
OVERDRAW = 2.5
MECHANISM = ("kept", "cvr", "dcr_mean", "dcr_p5", "nnaa", "mia_auc", "business_utility", "f1_gap", "ks_mean", "js_mean")


def run_mechanism(
    real: DataFrame, n: int, tiers=TIERS, seed: int = 42, share: float = 0.5, trees: int = TREES, depth: int = DEPTH, fit_rows: int | None = None, k: int = FOLDS
) -> DataFrame:
    """(level, ten metrics): what rejecting copula draws by tier does to every pillar, on a member split.

    The copula is fitted on members. Each draw is made once and marked with the tiers that keep it;
    at most 2.5 n are drawn, so a tier may keep fewer than n rows.
    """
    marked = materialised(ranking.member_split(real, share, seed))
    members = marked.where("is_member").drop("is_member")
    grid = Grid(list(tiers), ["copula"], [int(seed)])

    def mark(df: DataFrame) -> DataFrame:
        return df.withColumns({f"{KEEP}{tier}": tier_predicate(df, tier) for tier in tiers})

    ((run, _, _),) = grid.runs
    pool = draw_pool({run: (generator(members, "copula", seed), mark)}, n, list(tiers), OVERDRAW)
    rows = pool.survivors()
    ((columns, runs),) = _compared(members, grid).items()
    kept = _statistics(pool, grid).where("metric = 'reject_kept_n'").withColumn("metric", F.lit("kept"))
    asked, held = _attack(marked, members, rows, grid, columns, list(range(len(tiers))))
    parts = [
        kept,
        _integrity(rows, grid),
        _fidelity(members, rows, grid, columns, runs),
        _privacy(members, rows, grid, columns, runs, seed),
        _utility(members, rows, grid, n, None, None, trees, depth, fit_rows, k),
        _attack_rates(asked, held, columns, grid.size),
    ]
    named = grid.named(reduce(DataFrame.unionByName, parts))
    return named.groupBy("level").pivot("metric", list(MECHANISM)).agg(F.first("value"))


def run_workflow(
    raw: DataFrame, until: int = 4, architecture: str = "TVAE", n: int | None = None, gate: tuple[str, ...] = (), **options
):
    """Load, derive, gate, audit, repair, generate, evaluate; stops after phase `until`.

    gate: preflight checks that must pass; if one fails the run ends there, before anything is
    audited or generated. Returns the named result tables of the phases that ran, with `stopped`
    naming the failed checks.
    """
    derived = derive_features(raw)
    out = {"derived": derived, "preflight": checks.preflight_checks(derived), "stopped": []}
    if gate:
        failed = out["preflight"].where(F.col("check_name").isin(list(gate)) & ~F.col("passed"))
        out["stopped"] = sorted(r["check_name"] for r in failed.collect())
    if until <= 1 or out["stopped"]:
        return out
    vocabulary = carrier_vocabulary(derived)
    out["catalog_audit"] = audit.catalog_audit(derived, load_catalog(raw.sparkSession), vocabulary)
    out["repaired"] = repair.deterministic_repair(derived)
    if until <= 2:
        return out
    clean = materialised(out["repaired"])
    rows, stats = generate(clean, "strict+reject", architecture, n or clean.count())
    out["synthetic"], out["draw_stats"] = rows, stats
    if until <= 3:
        return out
    out["evaluation"] = evaluate_draws(clean, rows, architecture, **options)
    return out
