"""Registered queries for distributions, fidelity, utility, tests and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.hashing import normal, uniform
from waybill.functions.normal import normal_cdf, normal_quantile
from waybill.operators import distribution, fidelity, quality, ranking, scores, significance, utility
from waybill.operators.ecdf import exact_quantiles
from waybill.operators.synth import average_ranks
from waybill.plans.registered import query
from waybill.sources import driver_tables as D


# ---- distributions ---------------------------------------------------------------------
@query
def label_distribution(spark, sf_dir):
    return distribution.label_distribution(D.audited(spark, sf_dir, []))


@query
def label_drift(spark, sf_dir):
    return distribution.label_drift(D.audited(spark, sf_dir, []))


@query
def combo_cardinality(spark, sf_dir):
    df = D.deliveries(spark, sf_dir, ["last_scac", "carrier_service_code"])
    return distribution.combo_cardinality(df)


@query
def duration_quantiles(spark, sf_dir):
    probs = [0.005, 0.05, 0.25, 0.5, 0.75, 0.95, 0.995]
    out = exact_quantiles(D.canonical(spark, sf_dir, []), S.DURATION_COLUMNS, probs)
    return out.withColumn("quantile", F.round("quantile", 9))


@query
def duration_histogram(spark, sf_dir):
    return distribution.histogram(D.canonical(spark, sf_dir, []), S.DURATION_COLUMNS, 30)


@query
def distance_summary(spark, sf_dir):
    return distribution.value_summary(D.synthetic(spark, sf_dir, []), S.DURATION_COLUMNS)


@query
def correlation_matrix(spark, sf_dir):
    out = distribution.correlation_matrix(D.canonical(spark, sf_dir, []), S.DURATION_COLUMNS)
    return out.withColumn("corr", F.round("corr", 6))


@query
def average_rank(spark, sf_dir):
    return average_ranks(D.canonical(spark, sf_dir, []), [S.TRANSIT, S.SLA]).select(
        S.ROW_ID, "field", "avg_rank"
    )


# ---- randomness, samples, folds ----------------------------------------------------------
@query
def hash_uniform(spark, sf_dir):
    rows = D.deliveries(spark, sf_dir, [S.CREATED])
    key = F.col(S.ROW_ID)
    return rows.select(
        S.ROW_ID,
        uniform(key, "probe").alias("u"),
        F.round(normal(key, "probe", 42, 1), 6).alias("z"),
    )


@query
def normal_functions(spark, sf_dir):
    rows = D.deliveries(spark, sf_dir, [S.CREATED])
    u = uniform(F.col(S.ROW_ID), "probe")
    return rows.select(
        S.ROW_ID,
        F.round(normal_quantile(u), 6).alias("z"),
        F.round(normal_cdf(normal_quantile(u)), 6).alias("p"),
    )


@query
def hash_sample(spark, sf_dir):
    rows = D.deliveries(spark, sf_dir, [S.CREATED]).select(S.ROW_ID)
    return ranking.hash_sample(rows, 1000)


@query
def member_split(spark, sf_dir):
    df = D.canonical(spark, sf_dir, []).select(S.ROW_ID, S.LABEL)
    return ranking.member_split(df)


@query
def stratified_cap(spark, sf_dir):
    df = D.canonical(spark, sf_dir, []).select(S.ROW_ID, S.LABEL)
    return ranking.stratified_cap(df, 20_000)


@query
def stratified_folds(spark, sf_dir):
    df = D.canonical(spark, sf_dir, []).select(S.ROW_ID, S.LABEL)
    return ranking.stratified_folds(df)


@query
def time_folds(spark, sf_dir):
    df = D.deliveries(spark, sf_dir, [S.CREATED]).select(S.ROW_ID, S.CREATED)
    return ranking.time_folds(df).select(S.ROW_ID, "fold")


@query
def temporal_holdout(spark, sf_dir):
    df = D.deliveries(spark, sf_dir, [S.CREATED]).select(S.ROW_ID, S.CREATED)
    return ranking.time_holdout(df).select(S.ROW_ID, "is_test")


@query
def top_features(spark, sf_dir):
    """Features ranked by the size of their correlation with the SLA buffer."""
    df = D.canonical(spark, sf_dir, [])
    pairs = distribution.correlation_matrix(df, S.DURATION_COLUMNS)
    ranked = pairs.where(F.col("right_field") == S.SLA).select(
        F.col("left_field").alias("feature"), F.round(F.abs("corr"), 6).alias("score")
    )
    return ranking.top_features(ranked, top_k=2, min_score=0.01)


# ---- fidelity ------------------------------------------------------------------------------
def _sides(spark, sf_dir, categories=(), durations=True):
    return D.sides(spark, sf_dir, categories, durations)


@query
def fidelity_ks(spark, sf_dir):
    return fidelity.ks_complement(*_sides(spark, sf_dir))


@query
def fidelity_wasserstein(spark, sf_dir):
    return fidelity.wasserstein(*_sides(spark, sf_dir))


@query
def fidelity_js(spark, sf_dir):
    return fidelity.js_divergence(*_sides(spark, sf_dir))


@query
def fidelity_tvd(spark, sf_dir):
    return fidelity.tvd_complement(
        *_sides(spark, sf_dir, S.CATEGORICAL_COLUMNS, durations=False)
    )


@query
def fidelity_report(spark, sf_dir):
    return fidelity.fidelity_report(*_sides(spark, sf_dir, S.CATEGORICAL_COLUMNS))


@query
def column_shapes(spark, sf_dir):
    return quality.column_shapes(*_sides(spark, sf_dir, S.CATEGORICAL_COLUMNS))


@query
def column_pair_trends(spark, sf_dir):
    return quality.column_pair_trends(*_sides(spark, sf_dir, S.CATEGORICAL_COLUMNS))


@query
def adherence(spark, sf_dir):
    return quality.adherence(*_sides(spark, sf_dir, S.CATEGORICAL_COLUMNS))


@query
def quality_overall(spark, sf_dir):
    return quality.quality_overall(*_sides(spark, sf_dir, S.CATEGORICAL_COLUMNS))


# ---- utility -------------------------------------------------------------------------------
@query
def confusion_matrix(spark, sf_dir):
    return utility.confusion_matrix(D.predictions(spark, sf_dir))


@query
def business_utility(spark, sf_dir):
    return utility.business_utility(D.predictions(spark, sf_dir), ["fold"])


@query
def weighted_f1(spark, sf_dir):
    return utility.weighted_f1(D.predictions(spark, sf_dir), ["fold"])


@query
def class2_recall(spark, sf_dir):
    return utility.class2_recall(D.predictions(spark, sf_dir), ["fold"])


@query
def calibration_error(spark, sf_dir):
    return utility.calibration_error(D.predictions(spark, sf_dir), ["fold"])


@query
def brier_score(spark, sf_dir):
    return utility.brier_score(D.predictions(spark, sf_dir), ["fold"])


@query
def fold_summary(spark, sf_dir):
    per_fold = utility.label_fold_metrics(D.predictions(spark, sf_dir))
    return utility.fold_summary(per_fold, ["weighted_f1", "business_utility", "label2_recall"])


@query
def utility_vs_baseline(spark, sf_dir):
    metrics = utility.label_fold_metrics(D.predictions(spark, sf_dir))
    return utility.versus_baseline(metrics, F.lit(0.95), F.lit(0.9), F.lit(0.0))


# ---- tests and tables of metrics --------------------------------------------------------------
@query
def confidence_interval(spark, sf_dir):
    df = D.canonical(spark, sf_dir, ["last_scac"])
    return distribution.confidence_interval(df, S.TRANSIT, ["last_scac"])


@query
def sweep_summary(spark, sf_dir):
    return distribution.sweep_summary(D.metric_long(spark, sf_dir))


@query
def frontier_table(spark, sf_dir):
    summary = distribution.sweep_summary(D.metric_long(spark, sf_dir))
    return distribution.frontier_table(summary, ["dcr_mean", "business_utility"])


@query
def paired_t(spark, sf_dir):
    pairs = significance.level_pairs(D.metric_long(spark, sf_dir), "business_utility")
    out = significance.paired_t(pairs, "a", "b", ["architecture", "level_a", "level_b"])
    return out.withColumn("t_stat", F.round("t_stat", 4))


@query
def wilcoxon_w(spark, sf_dir):
    pairs = significance.level_pairs(D.metric_long(spark, sf_dir), "business_utility")
    return significance.wilcoxon_w(pairs, "a", "b", ["architecture", "level_a", "level_b"])


@query
def significance_test(spark, sf_dir):
    """Promised against actual transit, averaged per order year."""
    df = D.canonical(spark, sf_dir, []).groupBy(F.year(S.CREATED).alias("seed"))
    pairs = df.agg(F.avg(S.PROMISED).alias("a"), F.avg(S.TRANSIT).alias("b"))
    return significance.significance_test(pairs, "a", "b")


@query
def level_significance(spark, sf_dir):
    return significance.level_significance(D.metric_long(spark, sf_dir), "dcr_mean")


@query
def metric_union(spark, sf_dir):
    """Two metric tables of different shape, one under the other."""
    summary = distribution.sweep_summary(D.metric_long(spark, sf_dir)).select(
        "architecture", "level", "metric", "mean"
    )
    tests = significance.level_significance(
        D.metric_long(spark, sf_dir), "dcr_mean", with_p=False
    ).select("architecture", "metric", F.col("level_a").alias("level"), "t_stat")
    return summary.unionByName(tests, allowMissingColumns=True)


@query
def pillar_scores(spark, sf_dir):
    out = scores.pillar_scores(D.metric_wide(spark, sf_dir))
    names = ["fidelity_score", "utility_score", "privacy_score", "integrity_score", "mean_score"]
    return out.select("model", *[F.round(c, 4).alias(c) for c in names])


@query
def trial_selection(spark, sf_dir):
    scored = scores.trial_scores(
        D.metric_wide(spark, sf_dir), min_ks_mean=0.9, max_js_mean=0.06
    )
    return scores.best_trial(scored, "model")


@query
def pillar_verdicts(spark, sf_dir):
    out = scores.pillar_verdicts(D.metric_wide(spark, sf_dir))
    return out.select(
        "model", "privacy_ok", "utility_ok", "fidelity_ok", "integrity_ok", "overall_ok"
    )


@query
def verdict_counts(spark, sf_dir):
    return scores.verdict_counts(scores.pillar_verdicts(D.metric_wide(spark, sf_dir)))


@query
def results_summary(spark, sf_dir):
    return scores.results_summary(D.metric_wide(spark, sf_dir))


@query
def strictness_diagnostics(spark, sf_dir):
    summary = distribution.sweep_summary(D.metric_long(spark, sf_dir))
    return scores.strictness_diagnostics(summary)
