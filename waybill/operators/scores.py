"""Scores and verdicts over tables of finished metrics, one row per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.operators.distribution import level_order

# ---- Fixed values: weights, targets and thresholds ---------------------------------
FIDELITY_WEIGHTS = (0.5, 0.3, 0.2)
UTILITY_WEIGHTS = (0.45, 0.45, 0.10)
NNAA_TARGET, NNAA_WIDTH = 0.60, 0.25
INFEASIBLE_FACTOR = 0.1
GATE_NNAA = (0.50, 0.70)
GATE_F1_GAP, GATE_BUS_RATIO, GATE_TRANSFER = 0.05, 0.90, 0.90
GATE_KS, GATE_JS = 0.90, 0.05
TSTR_METRICS = [
    "weighted_f1",
    "f1_gap_vs_trtr",
    "business_utility",
    "bus_ratio_vs_trtr",
    "label2_recall",
    "ece",
    "brier_score_mean",
]
FIDELITY_METRICS = ["ks_mean", "wasserstein_mean", "js_mean", "tvd_mean"]
PRIVACY_METRICS = ["dcr_mean", "dcr_min", "dcr_p5", "nnaa"]


def _unit(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def pillar_scores(wide: DataFrame) -> DataFrame:
    """Adds the four pillar scores in [0, 1] and their mean."""
    c = F.col
    a, b, d = FIDELITY_WEIGHTS
    js_part = F.greatest(F.lit(0.0), 1.0 - F.least(c("js_mean"), F.lit(1.0)))
    dcr_part = c("dcr_mean") / (1.0 + c("dcr_mean"))
    nnaa_part = F.greatest(F.lit(0.0), 1.0 - F.abs(c("nnaa") - NNAA_TARGET) / NNAA_WIDTH)
    f, u, r = UTILITY_WEIGHTS
    return wide.withColumns(
        {
            "fidelity_score": _unit(a * c("ks_mean") + b * c("tvd_mean") + d * js_part),
            "utility_score": _unit(
                f * c("weighted_f1") + u * c("business_utility") + r * c("label2_recall")
            ),
            "privacy_score": _unit(0.5 * dcr_part + 0.5 * nnaa_part),
            "integrity_score": _unit(1.0 - c("integrity_violation_pct") / 100.0),
        }
    ).withColumn(
        "mean_score",
        (c("fidelity_score") + c("utility_score") + c("privacy_score") + c("integrity_score")) / 4,
    )


def trial_scores(
    trials: DataFrame,
    weights=None,
    min_tstr_f1=None,
    min_business_utility=None,
    min_ks_mean=None,
    max_js_mean=None,
    min_dcr_mean=None,
) -> DataFrame:
    """Adds weighted and final score; a trial that misses a threshold keeps a tenth."""
    weights = weights or {"fidelity": 1.0, "utility": 1.0, "privacy": 1.0, "integrity": 1.0}
    scored = pillar_scores(trials)
    total = float(sum(weights.values()))
    weighted = sum(
        (F.col(f"{k}_score") * float(w) for k, w in weights.items()), F.lit(0.0)
    ) / F.lit(total)
    feasible = F.lit(True)
    for name, least in [
        ("weighted_f1", min_tstr_f1),
        ("business_utility", min_business_utility),
        ("ks_mean", min_ks_mean),
        ("dcr_mean", min_dcr_mean),
    ]:
        if least is not None:
            feasible = feasible & (F.col(name) >= float(least))
    if max_js_mean is not None:
        feasible = feasible & (F.col("js_mean") <= float(max_js_mean))
    return scored.withColumns({"weighted_score": weighted, "feasible": feasible}).withColumn(
        "final_score",
        F.when(F.col("feasible"), F.col("weighted_score")).otherwise(
            F.col("weighted_score") * INFEASIBLE_FACTOR
        ),
    )


def best_trial(scored: DataFrame, key: str) -> DataFrame:
    """One row: trials, feasible trials, and the best feasible one (ties: smallest key)."""
    feasible = F.col("feasible")
    top = F.max(F.when(feasible, F.round("final_score", 9)))
    one = scored.agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.count_if("feasible").alias("n_feasible"),
        top.alias("best_score"),
    )
    winner = (
        scored.where(feasible)
        .groupBy(F.round("final_score", 9).alias("_s"))
        .agg(F.min(key).alias("best_trial"))
    )
    return (
        one.join(winner, F.col("_s") == F.col("best_score"), "left")
        .select(
            "n_trials",
            "n_feasible",
            "best_trial",
            F.round("best_score", 6).alias("best_score"),
            F.when(F.col("n_feasible") > 0, "ok").otherwise("no_feasible_trials").alias("status"),
        )
    )


def pillar_verdicts(wide: DataFrame) -> DataFrame:
    """Adds one pass flag per pillar and overall. Missing values fail."""
    c = F.col

    def passed(*tests: Column) -> Column:
        out = F.lit(True)
        for t in tests:
            out = out & F.coalesce(t, F.lit(False))
        return out

    flags = {
        "privacy_ok": passed(c("dcr_mean") > 0, c("nnaa").between(*GATE_NNAA)),
        "utility_ok": passed(
            c("f1_gap_vs_trtr") <= GATE_F1_GAP,
            c("bus_ratio_vs_trtr") >= GATE_BUS_RATIO,
            c("transfer_25_f1") >= GATE_TRANSFER * c("trtr_f1"),
        ),
        "fidelity_ok": passed(c("ks_mean") >= GATE_KS, c("js_mean") <= GATE_JS),
        "integrity_ok": passed(c("hard_violation_pct") == 0),
    }
    out = wide.withColumns(flags)
    return out.withColumn(
        "overall_ok", c("privacy_ok") & c("utility_ok") & c("fidelity_ok") & c("integrity_ok")
    )


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """One row: passes per pillar and the models with the smallest gap and divergence."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("models"),
        *[
            F.count_if(f"{p}_ok").alias(f"{p}_passes")
            for p in ("privacy", "utility", "fidelity", "integrity", "overall")
        ],
        F.min(F.struct("f1_gap_vs_trtr", "model")).alias("_gap"),
        F.min(F.struct("js_mean", "model")).alias("_js"),
    ).select(
        "models",
        "privacy_passes",
        "utility_passes",
        "fidelity_passes",
        "integrity_passes",
        "overall_passes",
        F.col("_gap.model").alias("smallest_gap_model"),
        F.col("_js.model").alias("closest_model"),
    )


def results_summary(wide: DataFrame, metrics=None) -> DataFrame:
    """(model, metric, value): the wide metric table in long form."""
    metrics = metrics or [*TSTR_METRICS, *FIDELITY_METRICS, *PRIVACY_METRICS]
    lines = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    return wide.selectExpr("model", f"stack({len(metrics)}, {lines}) as (metric, value)")


def strictness_diagnostics(summary: DataFrame, metrics=("cvr", "dcr_mean", "business_utility")):
    """Per architecture and metric: whether the level means fall, rise or neither."""
    in_order = Window.partitionBy("architecture", "metric").orderBy("_pos")
    step = F.col("mean") - F.lag("mean").over(in_order)
    steps = (
        summary.where(F.col("metric").isin(list(metrics)))
        .withColumn("_pos", level_order(F.col("level")))
        .withColumn("_step", step)
    )
    ends = steps.groupBy("architecture", "metric").agg(
        F.max("_step").alias("_most"),
        F.min("_step").alias("_least"),
        F.max_by("mean", "_pos").alias("_last"),
        F.min_by("mean", "_pos").alias("_first"),
    )
    return ends.select(
        "architecture",
        "metric",
        F.coalesce(F.col("_most") <= 0, F.lit(True)).alias("never_rises"),
        F.coalesce(F.col("_least") >= 0, F.lit(True)).alias("never_falls"),
        F.round(F.col("_last") - F.col("_first"), 4).alias("change"),
    )
