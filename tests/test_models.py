"""Models and sweeps: properties that hold whatever the trees look like."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.operators import audit, fidelity, forest, models, neighbours, oversample, privacy, ranking, repair, synth
from waybill.operators.resample import first_by_id
from waybill.plans import sweep
from waybill.plans.generate import generate

SMALL = {"trees": 12, "depth": 5}


@pytest.fixture(scope="module")
def labelled(proxy):
    return proxy.cache()


def _majority_f1(df) -> float:
    """Weighted F1 of always guessing the commonest label."""
    shares = [r["count"] / df.count() for r in df.groupBy(S.LABEL).count().collect()]
    top = max(shares)
    return top * 2 * top / (1 + top)


def test_forest_learns_labels_but_not_shuffled_ones(labelled):
    base = models.trtr_baseline(labelled, **SMALL).first()
    mixed = labelled.withColumn(S.LABEL, F.pmod(F.xxhash64(S.ROW_ID), F.lit(3)).cast("int"))
    chance = models.trtr_baseline(mixed, **SMALL).first()
    assert abs(chance.weighted_f1_mean - 1 / 3) < 0.12
    assert base.weighted_f1_mean > chance.weighted_f1_mean + 0.25


def test_classes_weigh_the_same(labelled):
    vectors, _, _ = models.prepared(labelled)
    weights = models._balanced(vectors).groupBy("label").agg(F.sum("weight").alias("w")).collect()
    n = labelled.count()
    assert [r.w for r in weights] == pytest.approx([n / len(weights)] * len(weights))


def test_folds_have_equal_sizes_and_fit_rows_bounds_the_fit_only(labelled):
    vectors, _, _ = models.prepared(labelled)
    for strategy in ("temporal", "stratified"):
        sizes = models.with_folds(vectors, strategy).where("fold > 0").groupBy("fold").count()
        counts = [r["count"] for r in sizes.collect()]
        assert len(counts) == 5 and max(counts) - min(counts) <= 3
    assert models.fitted_on(vectors, None) is vectors
    assert 60 < models.fitted_on(vectors, 100).count() < 150
    scored = models.tstr_scored(labelled, labelled, fit_rows=100, **SMALL)
    assert scored.count() == models.with_folds(vectors).where("fold > 0").count()


def test_training_on_a_copy_is_as_good_as_on_real_rows(labelled):
    base = models.trtr_baseline(labelled, **SMALL)
    got = models.tstr_evaluate(labelled, labelled, base, **SMALL).first()
    assert got.f1_gap_vs_trtr < 0.05
    curve = {(r.training, r.fraction): r.weighted_f1 for r in models.transfer_curve(labelled, labelled, **SMALL).collect()}
    assert set(curve) == {("synth_pretrain", f) for f in (0.0, 0.25, 1.0)} | {("real_only", 0.25), ("real_only", 1.0)}
    # The copy holds the tested rows as well.
    assert curve["synth_pretrain", 0.0] > _majority_f1(labelled) and min(curve.values()) > 0.5


def test_curve_takes_fractions_of_a_bounded_sample(labelled, monkeypatch):
    sizes, fit = [], models.fit_forest

    def watched(train, *args, fit_rows=None, **options):
        sizes.append(models.fitted_on(train, fit_rows).count())
        return fit(train, *args, fit_rows=fit_rows, **options)

    monkeypatch.setattr(models, "fit_forest", watched)
    models.transfer_curve(labelled, labelled, fit_rows=100, **SMALL)
    synth, quarter_both, quarter, all_both, whole = sizes
    assert (quarter, whole) == (25, 100) and 60 < synth < 150
    assert (quarter_both, all_both) == (synth + 25, synth + 100)


def test_importances(labelled):
    scores = {r.feature: r.score for r in models.feature_importance(labelled, **SMALL).collect()}
    assert sum(scores.values()) == pytest.approx(1, abs=0.01) and min(scores.values()) >= 0
    shuffled = {r.feature: r.score for r in models.permutation_importance(labelled, **SMALL).collect()}
    assert set(shuffled) == set(scores) and max(shuffled.values()) > 0


def test_components_are_centred_and_ordered(labelled):
    rows = models.pca_overlap(labelled, labelled).toPandas()
    assert len(rows) == 2 * labelled.count()
    assert rows[["pc1", "pc2"]].mean().abs().max() < 1e-3
    assert rows["pc1"].var() >= rows["pc2"].var() and abs(rows["pc1"].corr(rows["pc2"])) < 1e-2


def test_oversampling_scores(labelled):
    got = oversample.smote_baseline(labelled, models.trtr_baseline(labelled, **SMALL), **SMALL).first()
    assert 0 <= got.weighted_f1 <= 1


def test_sweep_equals_its_cells_taken_one_by_one(labelled):
    """Shared draws, one ledger and joint searches give what the single operators give."""
    levels, architectures, seeds, n = ["none", "moderate", "strict+reject"], ["TVAE", "copula"], [7], 150
    out = sweep.run_sweep(labelled, levels, architectures, seeds, n, **SMALL).toPandas()
    assert len(out) == 6 * 17 and not out.duplicated(["architecture", "level", "seed", "metric"]).any()
    for architecture, level in (("TVAE", "none"), ("TVAE", "strict+reject"), ("copula", "moderate")):
        cell = out[(out["architecture"] == architecture) & (out["level"] == level)]
        got = dict(zip(cell["metric"], cell["value"], strict=True))
        rows, stats = generate(labelled, level, architecture, n, 7)
        made, drawn = rows.cache(), stats.first()
        near = privacy.dcr_summary(privacy.dcr_distances(labelled, made)).first()
        want = {
            "reject_drawn": drawn.drawn,
            "reject_kept_n": n,
            "label2_kept_n": drawn.kept_label2_n,
            "label2_raw_rate": drawn.raw_label2_rate,
            "dcr_mean": near.dcr_mean,
            "dcr_p5": near.dcr_p5,
            "nnaa": privacy.nnaa_score(privacy.nnaa_distances(labelled, made)).first().nnaa,
            "ks_mean": fidelity.ks_complement(labelled, made).agg(F.avg("ks")).first()[0],
            "js_mean": fidelity.js_divergence(labelled, made).agg(F.avg("js")).first()[0],
            "cvr": audit.integrity_score(made).first().integrity_violation_pct,
        }
        assert {m: got[m] for m in want} == pytest.approx(want, abs=1.01e-4)
        assert 0 <= got["business_utility"] <= 1 and got["bus_ratio"] > 0 and abs(got["f1_gap"]) < 1
    assert sweep.run_sweep(labelled, [], ["TVAE"], [7], 10).count() == 0


def test_forests_of_many_cells_learn_their_own_labels(spark):
    """Each cell has another rule; trees of one cell do not know those of the next."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 3))
    cell = np.arange(3000) % 3
    y = np.where(x[np.arange(3000), cell] > 0.3, 2, np.where(x[np.arange(3000), cell] < -0.6, 0, 1))
    rows = pd.DataFrame(x, columns=list("abc")).assign(cell=cell, **{S.LABEL: y})
    trained = spark.createDataFrame(rows.iloc[:2400]).withColumn("cell", F.col("cell").cast("int"))
    forests = forest.fit_forests(trained.withColumn(S.LABEL, F.col(S.LABEL).cast("int")), "abc", 25, 6)
    assert sorted(forests) == [0, 1, 2] and [len(g) for g in forests.values()] == [2, 2, 2]
    again = forest.fit_forests(trained.repartition(7).withColumn(S.LABEL, F.col(S.LABEL).cast("int")), "abc", 25, 6)
    for c in range(3):
        test = rows.iloc[2400:][rows["cell"].iloc[2400:] == c]
        guess = forest.predicted(forests[c], test[list("abc")].to_numpy())
        assert (guess == test[S.LABEL]).mean() > 0.93
        assert (forest.predicted(forests[(c + 1) % 3], test[list("abc")].to_numpy()) == test[S.LABEL]).mean() < 0.75
        assert all(np.array_equal(a, b) for g, h in zip(forests[c], again[c], strict=True) for a, b in zip(g, h, strict=True))
    tested = spark.createDataFrame(rows.iloc[2400:].assign(fold=1)).withColumns({c: F.col(c).cast("int") for c in ("fold", S.LABEL)})
    counts = forest.outcomes(forests, tested, "abc", {1: [0, 2]}).toPandas()
    assert set(counts["cell"]) == {0, 2} and counts.groupby("cell")["cnt"].sum().tolist() == [600, 600]


def test_membership_audit_of_levels(labelled):
    """The joint audit is that of each cell on its own."""
    out = sweep.run_mia_audit(labelled, ["none", "strict"], ["TVAE", "CTGAN"], [7, 8], 200).toPandas()
    assert len(out) == 2 * 2 * 2 * 2
    for seed, architecture, level in ((7, "TVAE", "none"), (8, "CTGAN", "strict")):
        marked = ranking.member_split(labelled, 0.5, seed)
        members, others = marked.where("is_member").drop("is_member"), marked.where("not is_member").drop("is_member")
        rows, _ = generate(members, level, architecture, 200, seed)
        scores = privacy.mia_scores(members, others, rows, seed=seed)
        one = out[(out["seed"] == seed) & (out["architecture"] == architecture) & (out["level"] == level)]
        got = dict(zip(one["metric"], one["value"], strict=True))
        assert got["mia_auc"] == privacy.roc_auc(scores).first()[0]
        assert got["mia_tpr_at_fpr"] == privacy.tpr_at_fpr(scores).first()[0]


def test_mechanism_equals_the_single_operators(labelled):
    out = {r.level: r for r in sweep.run_mechanism(labelled, 120, **SMALL).collect()}
    assert set(out) == set(sweep.TIERS) and out["none"].kept == 120
    marked = ranking.member_split(labelled, 0.5, 42)
    members, others = marked.where("is_member").drop("is_member").cache(), marked.where("not is_member").drop("is_member")
    for tier in ("none", "strict"):
        draws = synth.copula(members, 42)(0, 300)
        kept = first_by_id(repair.tiered_rejection(draws, tier), 120).cache()
        near = privacy.dcr_summary(privacy.dcr_distances(members, kept)).first()
        row = out[tier]
        assert (row.kept, row.dcr_mean, row.dcr_p5) == (kept.count(), near.dcr_mean, near.dcr_p5)
        assert row.cvr == audit.integrity_score(kept).first().integrity_violation_pct
        assert row.mia_auc == privacy.roc_auc(privacy.mia_scores(members, others, kept)).first()[0]
        assert row.nnaa == privacy.nnaa_score(privacy.nnaa_distances(members, kept)).first().nnaa


def test_a_failed_gate_stops_the_workflow(labelled):
    out = sweep.run_workflow(labelled.withColumn(S.SHIP, F.lit("2001-01-01 00:00:00").cast("timestamp")), gate=("ship_before_capture",))
    assert out["stopped"] == ["ship_before_capture"] and set(out) == {"derived", "preflight", "stopped"}


def test_empty_columns_are_not_drawn(labelled):
    rows, _ = generate(labelled.withColumn("item_id", F.lit(None).cast("string")), "none", "TVAE", 50)
    assert "item_id" not in rows.columns and rows.count() == 50


def test_workflow_runs_to_its_end(labelled):
    out = sweep.run_workflow(labelled, until=4, n=120, **SMALL)
    assert out["synthetic"].count() == 120
    assert {r.metric for r in out["evaluation"].collect()} >= {"dcr_mean", "business_utility", "cvr"}


def test_flattened_forest_scores_as_its_model_does(labelled):
    """Same guesses and probabilities to the last bit, without the model's own transform."""
    vectors, _, _ = models.prepared(labelled)
    model = models.fit_forest(vectors, **SMALL)
    want = model.transform(vectors).select(
        S.ROW_ID, F.col("prediction").cast("int").alias("y_pred"), models.vector_to_array("probability").alias("proba")
    )
    got = models.score(model, vectors, [S.ROW_ID])
    assert got.count() == vectors.count()
    assert got.select(S.ROW_ID, "y_pred", "proba").exceptAll(want).isEmpty()
    used = []
    model.transform = lambda rows: used.append(rows)
    assert models.score(model, vectors).schema == got.drop(S.ROW_ID).schema and not used


@pytest.mark.parametrize("rows", [1, 700, 40_000])
def test_trees_walked_together_agree_with_one_row_at_a_time(rows):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 9, (400, 3)).astype(float), rng.integers(0, 3, 400)
    grown = forest.grow(x, y, 7, 4, 5)
    axis, cut, low, share, roots = grown
    tested = rng.integers(-1, 10, (rows, 3)).astype(float)
    got = forest.shares([forest._walkable(*grown)], tested)
    for i in rng.integers(0, rows, 20):
        total = np.zeros(3)
        for node in roots:
            while axis[node] >= 0:
                node = low[node] + (tested[i, axis[node]] > cut[node])
            total += share[node]
        assert (got[:, i] == total).all()


def test_attack_counts_rows_of_one_name_apart_on_every_path(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"x": rng.normal(size=240), "cell": np.arange(240) % 3, "is_member": rng.random(240) < 0.5})
    held = spark.createDataFrame(rows[rows["is_member"]][["cell", "x"]])
    asked = spark.createDataFrame(rows).withColumn(S.ROW_ID, F.lit("same"))
    got = []
    for room in (neighbours.BROADCAST_BYTES, 0):
        monkeypatch.setattr(neighbours, "BROADCAST_BYTES", room)
        got.append(sorted(tuple(r) for r in sweep._attack_rates(asked.drop(S.ROW_ID), held, ["x"], 3).collect()))
    assert got[0] == got[1] and {(c, v) for c, m, v in got[0] if m == "mia_auc"} == {(0, 1.0), (1, 1.0), (2, 1.0)}


def test_registered_models_are_fitted_on_all_rows(spark, labelled, monkeypatch):
    """No query bounds a fit, and packed rows are all rows of every cell."""
    from waybill.plans import registered_models

    bounds, held = [], []
    monkeypatch.setattr(registered_models.D, "canonical", lambda *a, **k: labelled)
    monkeypatch.setattr(registered_models.D, "synthetic", lambda *a, **k: labelled)
    monkeypatch.setattr(registered_models, "_made_rows", lambda *a: 2_300)
    monkeypatch.setattr(registered_models, "GRID", (["none"], ["TVAE"], [7]))
    for module in (models, sweep):
        plain = module.binned
        monkeypatch.setattr(module, "binned", lambda rows, plain=plain: held.append(plain(rows)) or held[-1])
        monkeypatch.setattr(module, "grown", lambda rows, trees, *a, plain=module.grown, **k: plain(rows, 2, 3, **k))
    monkeypatch.setattr(models, "fitted_on", lambda train, most, *a: bounds.append(most) or train)
    monkeypatch.setattr(models, "BOOST_ROUNDS", 1)
    registered_models.trtr_baseline(spark, "")
    registered_models.transfer_curve(spark, "")
    assert len(bounds) == 5 + 1 + 5 and set(bounds) == {None}
    total = labelled.count()
    sizes = [sum(h.sizes.values()) for h in held]
    assert sizes[0] == sum(total - i * (total // 6) for i in range(1, 6))
    pool = total - round(total / 5)
    assert sizes[1:] == [total, total + pool // 4, pool // 4, total + pool, pool]
    held.clear()
    registered_models.sweep_long(spark, "")
    (one,) = held
    assert one.sizes[0] == 2_300 and sum(r["size"] for r in one.chunks.collect()) == sum(one.sizes.values())


def test_forests_have_thresholds_of_all_rows(spark, monkeypatch):
    """Few rows that differ are found, whatever the partitioning, and by both ways to count values."""
    rng = np.random.default_rng(6)
    x = np.c_[rng.normal(size=6000), np.where(np.arange(6000) % 1500 == 0, 5.0, 0.0)]
    rows = pd.DataFrame({"x": x.tolist(), "cell": 0, S.LABEL: np.where(x[:, 1] > 1, 2, 0)})
    frame = spark.createDataFrame(rows).withColumns({c: F.col(c).cast("int") for c in ("cell", S.LABEL)})
    one = forest.binned(frame)
    (first, second) = one.edges[0]
    assert second.tolist() == [0.0]
    assert first.tolist() == np.unique(np.quantile(x[:, 0], np.arange(1, 33) / 32, method="inverted_cdf"))[:-1].tolist()
    monkeypatch.setattr(forest, "SENT_VALUES", 0)
    two = forest.binned(frame.repartition(5))
    assert all(np.array_equal(a, b) for a, b in zip(one.edges[0], two.edges[0], strict=True))
    a, b = (forest.grown(h, 9, 4)[0] for h in (one, two))
    assert all(np.array_equal(p, q) for g, h in zip(a.groups, b.groups, strict=True) for p, q in zip(g, h, strict=True))
    assert (forest.predicted(a.groups, x) == rows[S.LABEL]).all() and a.importances.argmax() == 1


def test_boosted_trees_read_bins_of_all_rows(labelled, monkeypatch):
    """Vectors of bins, as many as the forests have, and a search for thresholds that reads every row."""
    seen, made = [], models.OneVsRest.fit
    monkeypatch.setattr(models.OneVsRest, "fit", lambda self, rows: seen.append((self.getClassifier().getMaxBins(), rows)) or made(self, rows))
    models.boosted_tstr(labelled, labelled, 0.5, rounds=1)
    ((bins, rows),) = seen
    assert rows.count() == labelled.count() and bins**2 > labelled.count()
    x = np.stack([r.features.toArray() for r in rows.select("features").collect()])
    assert x.min() == 0 and x.max() <= forest.BINS - 1 and (x == x.round()).all()
