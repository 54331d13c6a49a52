"""Registered queries that train models or run whole sweeps, over all rows of the tables.

Models have their full size, 200 trees of depth 10 or 50 boosting rounds, and are fitted on all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from waybill import schema as S
from waybill.operators import derive, models, oversample
from waybill.plans import sweep
from waybill.plans.registered import query
from waybill.sources import driver_tables as D


def _sides(spark, sf_dir):
    return D.canonical(spark, sf_dir), D.synthetic(spark, sf_dir)


@query
def trtr_baseline(spark, sf_dir):
    return models.trtr_baseline(D.canonical(spark, sf_dir))


@query
def tstr_evaluate(spark, sf_dir):
    real, synth = _sides(spark, sf_dir)
    return models.tstr_evaluate(real, synth, models.trtr_baseline(real))


@query
def transfer_curve(spark, sf_dir):
    return models.transfer_curve(*_sides(spark, sf_dir))


@query
def boosted_tstr(spark, sf_dir):
    real, synth = _sides(spark, sf_dir)
    base = models.trtr_baseline(real).first()["weighted_f1_mean"]
    return models.boosted_tstr(real, synth, base)


@query
def feature_importance(spark, sf_dir):
    return models.feature_importance(D.canonical(spark, sf_dir))


@query
def permutation_importance(spark, sf_dir):
    return models.permutation_importance(D.canonical(spark, sf_dir))


@query
def pca_overlap(spark, sf_dir):
    real, synth = D.canonical(spark, sf_dir, []), D.synthetic(spark, sf_dir, [])
    return models.pca_overlap(real, synth)


@query
def evaluate_synth(spark, sf_dir):
    real, synth = _sides(spark, sf_dir)
    baseline = models.trtr_baseline(real)
    return sweep.evaluate_synth(real, synth, baseline)


#: The whole grid: five levels, three generators, two seeds.
LEVELS = [level for level, _, _ in S.STRICTNESS]
GRID = (LEVELS, ["TVAE", "CopulaGAN", "CTGAN"], [42, 43])


def _made_rows(spark, sf_dir) -> int:
    """Synthetic rows of a cell: as many as there are orders, a quarter of the real rows."""
    return D.table(spark, sf_dir, "orders").count()


@query
def sweep_long(spark, sf_dir):
    """Every metric and draw statistic of all thirty cells."""
    return sweep.run_sweep(D.canonical(spark, sf_dir), *GRID, _made_rows(spark, sf_dir))


@query
def sweep_measured(spark, sf_dir):
    """Draw statistics, integrity and fidelity of all thirty cells."""
    real = D.canonical(spark, sf_dir, ["last_scac", "carrier_service_code"])
    out = sweep.run_sweep(real, *GRID, _made_rows(spark, sf_dir), pillars=("integrity", "fidelity"))
    return out.where("metric <> 'js_mean'")


@query
def mia_audit(spark, sf_dir):
    """Membership inference in all thirty cells."""
    real = D.canonical(spark, sf_dir, ["last_scac", "carrier_service_code"])
    return sweep.run_mia_audit(real, *GRID, _made_rows(spark, sf_dir))


@query
def mechanism_metrics(spark, sf_dir):
    """Ten metrics for each of three rejection tiers of copula draws, on a member split."""
    return sweep.run_mechanism(D.canonical(spark, sf_dir), _made_rows(spark, sf_dir))


@query
def workflow_evaluation(spark, sf_dir):
    """The whole workflow, to the metrics of its fourth phase."""
    raw = D.deliveries(spark, sf_dir).drop("h", "l_suppkey")
    out = sweep.run_workflow(raw, until=4, n=_made_rows(spark, sf_dir), gate=("forbidden_features",))
    return out["evaluation"]


@query
def workflow_audit(spark, sf_dir):
    """Derive, gate, audit and repair in one go: the audit table of the second phase."""
    raw = D.deliveries(spark, sf_dir).drop("h", "l_suppkey")
    out = sweep.run_workflow(raw, until=2)["catalog_audit"]
    return out.select("id", "audit_key", "violations", "n", "status").orderBy(F.col("id"))




@query
def smote_rows(spark, sf_dir):
    """Rows needed to balance the labels, interpolated on the durations."""
    matrix = derive.feature_matrix(
        D.canonical(spark, sf_dir, []), [S.LATENCY, S.TRANSIT, S.PROMISED, S.BUFFER]
    )
    return oversample.smote_rows(matrix, [S.LATENCY, S.TRANSIT, S.PROMISED, S.BUFFER])


@query
def smote_baseline(spark, sf_dir):
    real = D.canonical(spark, sf_dir)
    return oversample.smote_baseline(real, models.trtr_baseline(real))
