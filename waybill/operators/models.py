"""Delay models: utility of synthetic training data on real test rows.

Models are fitted on all rows unless `fit_rows` bounds a fit.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import PCA, Bucketizer, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.small import materialised
from waybill.operators import utility
from waybill.operators.derive import assemble, category_codes, feature_matrix
from waybill.operators.forest import Binned, Forest, binned, grown, probabilities
from waybill.operators.ranking import hash_rank, stratified_folds, time_folds, time_holdout

TREES = 200
DEPTH = 10
FOLDS = 5
BOOST_ROUNDS, BOOST_DEPTH, BOOST_STEP = 50, 4, 0.1
FRACTIONS = (0.0, 0.25, 1.0)


def _vectors(matrix: DataFrame, features) -> DataFrame:
    return assemble(matrix, features).withColumn("label", F.col(S.LABEL).cast("double"))


def _balanced(train: DataFrame) -> DataFrame:
    """Weights n / (classes x class size), so that every class counts the same."""
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    weight = F
    for label, n in sizes.items():
        weight = weight.when(F.col("label") == label, total / (len(sizes) * n))
    return train.withColumn("weight", weight.otherwise(1.0))


def fitted_on(train: DataFrame, fit_rows: int | None, seed: int = 42) -> DataFrame:
    """A sample of about `fit_rows` labelled rows to fit a classifier on; all rows without a bound."""
    if fit_rows is None:
        return train
    n = train.count()
    return train if n <= fit_rows else materialised(train.sample(False, fit_rows / n, seed))


def _numbered(parts: dict[int, DataFrame]) -> Binned:
    """Training rows of several forests, by number."""
    x = vector_to_array("features").alias("x")
    return binned(reduce(DataFrame.unionByName, [p.select(F.lit(i).alias("cell"), F.col("label").alias(S.LABEL), x) for i, p in parts.items()]))


def fit_forest(
    train: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 42, fit_rows: int | None = None
) -> Forest:
    """A balanced forest. Only the fit is ever bounded, by `fit_rows`; scores cover all rows."""
    forests = grown(_numbered({0: fitted_on(train, fit_rows, seed)}), trees, depth, seed)
    if not forests:
        raise ValueError("no labelled rows to fit on")
    return forests[0]


def score(model, rows: DataFrame, carry=()) -> DataFrame:
    """(carry…, y_true, y_pred, proba) of every row. A forest walks many rows at once."""
    if isinstance(model, Forest):
        asked = rows.select(*carry, F.col(S.LABEL).alias("y_true"), vector_to_array("features").alias("_x"))
        return probabilities(model.groups, asked)
    out = model.transform(rows)
    proba = (
        vector_to_array("probability").alias("proba")
        if "probability" in out.columns
        else F.lit(None).cast("array<double>").alias("proba")
    )
    return out.select(
        *carry, F.col(S.LABEL).alias("y_true"), F.col("prediction").cast("int").alias("y_pred"), proba
    )


def prepared(real: DataFrame, synth: DataFrame | None = None, features=None):
    """(real vectors, synthetic vectors, feature names), codes learned on the real table.

    Both are materialised: trees read their input many times.
    """
    names = S.resolve_features(real.columns, features)
    codes = category_codes(real, [c[:-4] for c in names if c.endswith("_enc")])
    real_m = materialised(feature_matrix(real, names, codes))
    synth_m = None if synth is None else _vectors(materialised(feature_matrix(synth, names, codes)), names)
    return _vectors(real_m, names), synth_m, names


def with_folds(vectors: DataFrame, strategy: str = "temporal", k: int = FOLDS) -> DataFrame:
    """Temporal: fold i is tested, earlier folds train. Stratified: the others train."""
    if strategy == "temporal":
        return time_folds(vectors, k)
    return stratified_folds(vectors, k).withColumn("fold", F.col("fold") + 1)


def baseline_folds(
    real: DataFrame, features=None, strategy="temporal", trees=TREES, depth=DEPTH, k=FOLDS, fit_rows=None
) -> DataFrame:
    """Train on real, test on real: metrics per fold."""
    vectors, _, _ = prepared(real, None, features)
    folded = materialised(with_folds(vectors, strategy, k))
    others = {i: folded.where(F.col("fold") < i if strategy == "temporal" else F.col("fold") != i) for i in range(1, k + 1)}
    forests = grown(_numbered({i: fitted_on(train, fit_rows) for i, train in others.items()}), trees, depth)
    if len(forests) < k:
        raise ValueError("a fold has no labelled rows to fit on")
    parts = [score(forest, folded.where(F.col("fold") == i), ["fold"]) for i, forest in forests.items()]
    return utility.fold_metrics(materialised(reduce(DataFrame.unionByName, parts)))


def trtr_baseline(real: DataFrame, **options) -> DataFrame:
    """One row: means over folds and the spread of F1."""
    return baseline_folds(real, **options).agg(
        F.round(F.avg("weighted_f1"), 4).alias("weighted_f1_mean"),
        F.round(F.stddev_pop("weighted_f1"), 4).alias("weighted_f1_std"),
        F.round(F.avg("business_utility"), 4).alias("business_utility_mean"),
        F.round(F.avg("label2_recall"), 4).alias("label2_recall_mean"),
    )


def _fold_means(per_fold: DataFrame) -> DataFrame:
    return per_fold.agg(
        F.round(F.avg("weighted_f1"), 4).alias("weighted_f1"),
        F.round(F.stddev_pop("weighted_f1"), 4).alias("weighted_f1_std"),
        F.round(F.avg("business_utility"), 4).alias("business_utility"),
        F.round(F.avg("label2_recall"), 4).alias("label2_recall"),
        F.round(F.avg("ece"), 4).alias("ece"),
        F.round(F.avg("brier"), 4).alias("brier_score_mean"),
    )


def tstr_scored(real, synth, features=None, strategy="temporal", trees=TREES, depth=DEPTH, k=FOLDS, fit_rows=None):
    """Train on synthetic once, score every real fold: (fold, y_true, y_pred, proba)."""
    vectors, made, _ = prepared(real, synth, features)
    model = fit_forest(made, trees, depth, fit_rows=fit_rows)
    tested = with_folds(vectors, strategy, k).where(F.col("fold") > 0)
    return materialised(score(model, tested, ["fold"]))


def tstr_evaluate(real: DataFrame, synth: DataFrame, baseline: DataFrame, **options) -> DataFrame:
    """One row of metrics with gaps to the baseline row of `trtr_baseline`."""
    base = baseline.first()
    means = _fold_means(utility.fold_metrics(tstr_scored(real, synth, **options)))
    return utility.versus_baseline(
        means,
        F.lit(base["weighted_f1_mean"]),
        F.lit(base["business_utility_mean"]),
        F.lit(base["label2_recall_mean"]),
    )


def transfer_curve(
    real: DataFrame, synth: DataFrame, fractions=FRACTIONS, features=None, trees=TREES, depth=DEPTH, seed=42, fit_rows=None
) -> DataFrame:
    """(training, fraction, weighted_f1, business_utility) on the latest fifth of real rows.

    `fit_rows` bounds the real pool and the synthetic side once, before fractions of the pool are taken.
    """
    vectors, made, _ = prepared(real, synth, features)
    made = fitted_on(made, fit_rows, seed)
    split = materialised(hash_rank(time_holdout(vectors), "transfer", seed, ["is_test"]))
    test = split.where("is_test")
    pool = split.where(~F.col("is_test"))
    size = pool.count() if fit_rows is None else min(pool.count(), fit_rows)
    columns = ["features", "label", S.LABEL]
    scored = None
    for fraction in fractions:
        some = pool.where(F.col("_rank") <= max(1, int(size * fraction))).select(*columns)
        runs = {"synth_pretrain": made.select(*columns)}
        if fraction > 0:
            runs = {
                "synth_pretrain": made.select(*columns).unionByName(some),
                "real_only": some,
            }
        for name, train in runs.items():
            part = score(fit_forest(train, trees, depth), test).withColumns(
                {"training": F.lit(name), "fraction": F.lit(float(fraction))}
            )
            scored = part if scored is None else scored.unionByName(part)
    by = ["training", "fraction"]
    scored = materialised(scored)
    return utility.weighted_f1(scored, by).join(utility.business_utility(scored, by), by)


def _in_bins(matrix: DataFrame, names, edges) -> DataFrame:
    """The matrix with vectors of bins: a value at an edge lies below it."""
    # A Bucketizer wants at least three split points.
    splits = [[-math.inf, *np.nextafter(e, math.inf), math.inf] if len(e) else [-math.inf, 0.0, math.inf] for e in edges]
    places = [f"_bin{i}" for i in range(len(names))]
    placed = Bucketizer(splitsArray=splits, inputCols=list(names), outputCols=places, handleInvalid="keep").transform(matrix.drop("features"))
    return assemble(placed, places).drop(*places)


def boosted_tstr(
    real: DataFrame, synth: DataFrame, base_f1: float, features=None, rounds=BOOST_ROUNDS, k=FOLDS, fit_rows=None
) -> DataFrame:
    """One row: F1 of boosted trees, one model per class, trained on synthetic rows.

    Thresholds are those of the forests, quantiles of all training rows. Spark ML looks for thresholds in
    about maxBins² rows: so many bins that it reads all, though the bins hold a few values only.
    """
    vectors, made, names = prepared(real, synth, features)
    train = fitted_on(made, fit_rows)
    held = _numbered({0: train})
    bins = max(32, math.isqrt(held.sizes[0]) + 1)
    trees = GBTClassifier(maxIter=rounds, maxDepth=BOOST_DEPTH, stepSize=BOOST_STEP, seed=42, maxBins=bins)
    model = OneVsRest(classifier=trees, parallelism=3).fit(materialised(_in_bins(train, names, held.edges[0]).select("features", "label")))
    tested = _in_bins(with_folds(vectors, "temporal", k).where(F.col("fold") > 0), names, held.edges[0])
    per_fold = utility.weighted_f1(materialised(score(model, tested, ["fold"])), ["fold"])
    return per_fold.agg(F.round(F.avg("weighted_f1"), 4).alias("weighted_f1")).withColumn(
        "f1_gap_vs_trtr", F.round(F.lit(base_f1) - F.col("weighted_f1"), 4)
    )


def feature_importance(real: DataFrame, features=None, trees=TREES, depth=DEPTH, fit_rows=None) -> DataFrame:
    """(feature, score): impurity importance of the balanced forest."""
    vectors, _, names = prepared(real, None, features)
    weights = fit_forest(vectors, trees, depth, fit_rows=fit_rows).importances
    return real.sparkSession.createDataFrame(
        [(n, round(float(w), 4)) for n, w in zip(names, weights)], "feature string, score double"
    )


def permutation_importance(real: DataFrame, features=None, trees=TREES, depth=DEPTH, seed=42, fit_rows=None) -> DataFrame:
    """(feature, score): loss of F1 when one feature is shuffled among the test rows.

    The shuffle gives each row the value of its successor in digest order.
    """
    names = S.resolve_features(real.columns, features)
    codes = category_codes(real, [c[:-4] for c in names if c.endswith("_enc")])
    split = materialised(time_holdout(feature_matrix(real, names, codes)))
    train = _vectors(split.where(~F.col("is_test")), names)
    model = fit_forest(train, trees, depth, fit_rows=fit_rows)
    test = split.where("is_test")
    n = test.count()
    ranked = materialised(hash_rank(test, "permute", seed))
    donor = ranked.select(
        (F.col("_rank") % n + 1).alias("_rank"), *[F.col(c).alias(f"_p_{c}") for c in names]
    )
    both = materialised(ranked.join(donor, "_rank"))
    scored = score(model, _vectors(both, names)).withColumn("feature", F.lit("-"))
    for c in names:
        changed = both.withColumn(c, F.col(f"_p_{c}"))
        scored = scored.unionByName(
            score(model, _vectors(changed, names)).withColumn("feature", F.lit(c))
        )
    f1 = materialised(utility.weighted_f1(scored, ["feature"], 6))
    whole = f1.where(F.col("feature") == "-").first()["weighted_f1"]
    return f1.where(F.col("feature") != "-").select(
        "feature", F.round(F.lit(whole) - F.col("weighted_f1"), 4).alias("score")
    )


def pca_overlap(real: DataFrame, synth: DataFrame, columns=None, sample: int | None = None) -> DataFrame:
    """(side, row_id, pc1, pc2): both tables on the first two components of their union.

    `sample` keeps that many rows per side, for plotting.
    """
    columns = [c for c in (columns or S.DURATION_COLUMNS) if c in real.columns and c in synth.columns]
    filled = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns]
    both = real.select(F.lit("real").alias("side"), S.ROW_ID, *filled).unionByName(
        synth.select(F.lit("synth").alias("side"), S.ROW_ID, *filled)
    )
    if sample is not None:
        both = hash_rank(both, "pca", 42, ["side"]).where(F.col("_rank") <= sample).drop("_rank")
    vectors = assemble(both, columns)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    scaled = scaler.fit(vectors).transform(vectors)
    out = PCA(k=2, inputCol="scaled", outputCol="pc").fit(scaled).transform(scaled)
    pc = vector_to_array("pc")
    return out.select("side", S.ROW_ID, F.round(pc[0], 4).alias("pc1"), F.round(pc[1], 4).alias("pc2"))


