"""Paired tests on fold or seed scores: inputs are one row per pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.pvalues import t_two_sided, wilcoxon_two_sided
from waybill.operators.distribution import level_order

SIGNIFICANT = 0.05


def paired_t(pairs: DataFrame, left: str, right: str, by=()) -> DataFrame:
    """(by…, n, t_stat): mean difference over its standard error; NULL without spread."""
    d = F.col(left) - F.col(right)
    return (
        pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"), F.avg(d).alias("_mean"), F.stddev_samp(d).alias("_sd")
        )
        .select(
            *by,
            "n",
            F.when(F.col("_sd") > 0, F.col("_mean") / (F.col("_sd") / F.sqrt("n"))).alias("t_stat"),
        )
    )


def wilcoxon_w(pairs: DataFrame, left: str, right: str, by=()) -> DataFrame:
    """(by…, n_nonzero, w_stat, tie_term): smaller signed-rank sum of the non-zero
    differences, average ranks for ties; NULL if all differences are zero."""
    keys = list(by)
    d = F.col(left) - F.col(right)
    diffs = pairs.select(*keys, d.alias("_d")).where(F.col("_d").isNotNull())
    size = F.abs("_d")
    lower = F.rank().over(Window.partitionBy(*keys).orderBy(size))
    peers = F.count(F.lit(1)).over(Window.partitionBy(*keys, size))
    ranked = diffs.where(F.col("_d") != 0).select(
        *keys, "_d", (lower + (peers - 1) / 2.0).alias("_rank"), peers.alias("_peers")
    )
    plus = F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_rank"))), F.lit(0.0))
    minus = F.coalesce(F.sum(F.when(F.col("_d") < 0, F.col("_rank"))), F.lit(0.0))
    peers_term = F.sum((F.col("_peers") * F.col("_peers") - 1).cast("double"))
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_nonzero"),
        F.when(F.count(F.lit(1)) > 0, F.least(plus, minus)).alias("w_stat"),
        F.coalesce(peers_term, F.lit(0.0)).alias("tie_term"),
    )


def significance_test(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """One row with both tests, their p-values and the verdict at 5 %."""
    t = paired_t(pairs, left, right).withColumn("_p", t_two_sided(F.col("t_stat"), F.col("n") - 1))
    w = wilcoxon_w(pairs, left, right).withColumn(
        "_p", wilcoxon_two_sided(F.col("w_stat"), F.col("n_nonzero"), F.col("tie_term"))
    )
    w_row = w.select(F.struct("w_stat", "_p").alias("v")).scalar()
    return t.select(
        F.round("t_stat", 4).alias("paired_t_stat"),
        F.round("_p", 4).alias("paired_t_pvalue"),
        F.round(w_row["w_stat"], 4).alias("wilcoxon_stat"),
        F.round(w_row["_p"], 4).alias("wilcoxon_pvalue"),
        F.coalesce(F.col("_p") < SIGNIFICANT, F.lit(False)).alias("significant_005"),
    )


def level_pairs(long: DataFrame, metric: str) -> DataFrame:
    """(architecture, level_a, level_b, seed, a, b): seeds matched between levels."""
    one = (
        long.where(F.col("metric") == metric)
        .groupBy("architecture", "level", "seed")
        .agg(F.avg("value").alias("v"))
        .withColumn("pos", level_order(F.col("level")))
    )
    left = one.select("architecture", "seed", F.col("level").alias("level_a"), F.col("v").alias("a"), F.col("pos").alias("_pa"))
    right = one.select("architecture", "seed", F.col("level").alias("level_b"), F.col("v").alias("b"), F.col("pos").alias("_pb"))
    return left.join(right, ["architecture", "seed"]).where(F.col("_pa") < F.col("_pb"))


def level_significance(long: DataFrame, metric: str, with_p: bool = True) -> DataFrame:
    """Paired t-test between every two strictness levels, per architecture.

    Needs two seeds and some spread; `adjacent` marks neighbouring levels.
    """
    keys = ["architecture", "level_a", "level_b"]
    pairs = level_pairs(long, metric)
    stats = pairs.groupBy(*keys, (F.col("_pb") - F.col("_pa") == 1).alias("adjacent")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("a").alias("_a"),
        F.avg("b").alias("_b"),
        F.stddev_samp("a").alias("_sa"),
        F.stddev_samp("b").alias("_sb"),
        F.avg(F.col("a") - F.col("b")).alias("_mean"),
        F.stddev_samp(F.col("a") - F.col("b")).alias("_sd"),
    )
    t = F.when(F.col("_sd") > 0, F.col("_mean") / (F.col("_sd") / F.sqrt("n")))
    out = stats.where((F.col("n") >= 2) & (F.col("_sa") + F.col("_sb") > 0)).withColumn("_t", t)
    columns = [
        "architecture",
        F.lit(metric).alias("metric"),
        "level_a",
        "level_b",
        "adjacent",
        F.round("_a", 4).alias("mean_a"),
        F.round("_b", 4).alias("mean_b"),
        F.round("_t", 3).alias("t_stat"),
    ]
    if with_p:
        columns.append(F.round(t_two_sided(F.col("_t"), F.col("n") - 1), 4).alias("p_value"))
    return out.select(*columns)
