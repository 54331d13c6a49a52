"""Registered queries for privacy metrics and generators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.small import stored
from waybill.operators import privacy, ranking, repair, resample, synth
from waybill.plans import generate as gen
from waybill.plans.registered import query
from waybill.sources import driver_tables as D


def _sides(spark, sf_dir):
    columns = [S.ROW_ID, *S.DURATION_COLUMNS]
    return (
        D.canonical(spark, sf_dir, []).select(*columns),
        D.synthetic(spark, sf_dir, []).select(*columns),
    )


@query
def dcr(spark, sf_dir):
    return privacy.dcr_summary(privacy.dcr_distances(*_sides(spark, sf_dir)))


@query
def dcr_exact(spark, sf_dir):
    out = privacy.dcr_distances(*_sides(spark, sf_dir))
    return out.select(S.ROW_ID, F.round("distance", 6).alias("distance"))


@query
def nnaa(spark, sf_dir):
    return privacy.nnaa_score(privacy.nnaa_distances(*_sides(spark, sf_dir)))


@query
def privacy_distributions(spark, sf_dir):
    return privacy.distance_distributions(*_sides(spark, sf_dir))[0]


@query
def privacy_histograms(spark, sf_dir):
    """Twenty bins of each distance, with edges; distances to nine digits, so that ties fall alike."""
    return privacy.distance_distributions(*_sides(spark, sf_dir), digits=9)[1]


def _mia(spark, sf_dir):
    """Members are half of the real rows; the synthetic side is made from members only."""
    columns = [S.ROW_ID, *S.DURATION_COLUMNS]
    # Stored: the split is read for the scale, for both sides and for the rows made from members.
    rows = stored(D.canonical(spark, sf_dir, []).select(S.LABEL, *columns))
    real = stored(ranking.member_split(rows).drop(S.LABEL))
    members = real.where("is_member").select(*columns)
    others = real.where(~F.col("is_member")).select(*columns)
    made = D.synthetic(spark, sf_dir, []).select(*columns)
    made = made.join(members.select(S.ROW_ID), S.ROW_ID, "left_semi")
    return privacy.mia_scores(members, others, made)


@query
def mia_scores(spark, sf_dir):
    out = _mia(spark, sf_dir)
    return out.select(S.ROW_ID, "is_member", F.round("score", 6).alias("score"))


@query
def mia_auc(spark, sf_dir):
    return privacy.roc_auc(_mia(spark, sf_dir))


@query
def mia_tpr_at_fpr(spark, sf_dir):
    return privacy.tpr_at_fpr(_mia(spark, sf_dir))


# ---- generators ------------------------------------------------------------------------
_CARRIER = ["last_scac", "carrier_service_code"]


def _rows_of(spark, sf_dir) -> int:
    return D.table(spark, sf_dir, "lineitem").count()


def _shown(df):
    return df.select(
        "draw_id",
        *[F.round(c, 9).alias(c) for c in S.DURATION_COLUMNS if c in df.columns],
        S.LABEL,
    )


@query
def bootstrap_synth(spark, sf_dir):
    """As many drawn rows as there are real ones."""
    real = D.canonical(spark, sf_dir, [])
    return _shown(synth.bootstrap(real, "TVAE")(0, _rows_of(spark, sf_dir)))


@query
def bootstrap_clipped(spark, sf_dir):
    real = D.canonical(spark, sf_dir, [])
    return _shown(synth.bootstrap(real, "CTGAN")(0, _rows_of(spark, sf_dir)))


def _resampled(spark, sf_dir, columns):
    real = D.canonical(spark, sf_dir, _CARRIER)
    return resample.resample_to_target(
        synth.bootstrap(real, "CopulaGAN"),
        _rows_of(spark, sf_dir),
        mark=lambda df: df.withColumn(f"{resample.KEEP}kept", repair.rejection_predicate(df)),
        columns=columns,
    )


@query
def resample_to_target(spark, sf_dir):
    return _shown(_resampled(spark, sf_dir, S.DURATION_COLUMNS)[0])


@query
def resample_stats(spark, sf_dir):
    return _resampled(spark, sf_dir, [])[1]


@query
def generate_levels(spark, sf_dir):
    real = D.canonical(spark, sf_dir, _CARRIER)
    draw = gen.generator(real, "TVAE")
    levels = [level for level, _, _ in S.STRICTNESS]
    return gen.generate_stats(real, levels, _rows_of(spark, sf_dir), draw, max_factor=8)


@query
def generate_rows(spark, sf_dir):
    """The rows of the strictest level, as many as there are real ones."""
    real = D.canonical(spark, sf_dir, _CARRIER)
    return _shown(gen.generate(real, "strict+reject", "TVAE", _rows_of(spark, sf_dir), columns=S.DURATION_COLUMNS)[0])


@query
def copula_fit(spark, sf_dir):
    out = synth.copula_fit(D.canonical(spark, sf_dir, []))
    return out.withColumn("corr", F.round("corr", 4))


@query
def copula_sample(spark, sf_dir):
    real = D.canonical(spark, sf_dir)
    return synth.copula(real)(0, _rows_of(spark, sf_dir))


@query
def mechanism_levels(spark, sf_dir):
    """Rows kept, label share and integrity per rejection tier of copula draws."""
    real = D.canonical(spark, sf_dir, _CARRIER)
    n = _rows_of(spark, sf_dir)
    draw = synth.copula(real)
    parts = []
    for level, kept in gen.overdraws(draw, ("none", "moderate", "strict"), n, [S.TRANSIT, S.LABEL]).items():
        parts.append(
            kept.agg(
                F.lit(level).alias("level"),
                F.count(F.lit(1)).alias("kept"),
                F.round(F.avg((F.col(S.LABEL) == 2).cast("double")), 4).alias("label2_share"),
                F.round(F.avg(S.TRANSIT), 4).alias("mean_transit"),
                F.count_if(F.col(S.TRANSIT) <= 0).alias("non_positive_transit"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)
