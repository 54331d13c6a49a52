"""The registered queries: every operator run over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.operators import audit, checks, custom, derive, identities, ladder, repair, rules
from waybill.sources import driver_tables as D
from waybill.sources.catalog import load_catalog
from waybill.sources.sinks import records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _nine(df: DataFrame, columns) -> list:
    """`columns` of `df`, doubles rounded to nine digits: seconds as days never end in a 5
    there, so both engines round alike."""
    kinds = dict(df.dtypes)
    return [F.round(c, 9).alias(c) if kinds[c] == "double" else F.col(c) for c in columns]


# ---- audits --------------------------------------------------------------------------
def _single_rule(key: str, rule: str, membership: bool = False):
    def run(spark, sf_dir):
        vocabulary = (
            rules.carrier_vocabulary(D.vocabulary_rows(spark, sf_dir)) if membership else None
        )
        return audit.audit_counts(D.audited(spark, sf_dir), vocabulary, [rule])

    QUERIES[key] = run


_single_rule("audit_r1", "R1_temporal_order")
_single_rule("audit_r2", "R2_positive_transit")
_single_rule("audit_r3", "R3_non_negative_capture_latency")
_single_rule("audit_rpt", "RPT_non_negative_promised_transit")
_single_rule("audit_r5_membership", "R4_referential_integrity", membership=True)
_single_rule("audit_r5_presence", "R4_referential_integrity")
_single_rule("audit_r6", "R5_label_cardinality")
_single_rule("audit_r7", "R3b_label_sla_consistency")
_single_rule("audit_r8", "R6_scac_calendar_soft")


def _audit_input(spark, sf_dir):
    return D.audited(spark, sf_dir), rules.carrier_vocabulary(D.vocabulary_rows(spark, sf_dir))


@query
def audit_counts(spark, sf_dir):
    return audit.audit_counts(*_audit_input(spark, sf_dir))


@query
def audit_summary(spark, sf_dir):
    return audit.audit_summary(*_audit_input(spark, sf_dir))


@query
def catalog_audit(spark, sf_dir):
    df, vocabulary = _audit_input(spark, sf_dir)
    return audit.catalog_audit(df, load_catalog(spark), vocabulary, include_custom=False)


@query
def custom_constraint(spark, sf_dir):
    df, vocabulary = _audit_input(spark, sf_dir)
    with custom.own_constraints():

        @custom.constraint(
            id="transit_below_four_days",
            name="Transit below four days",
            category="arithmetic",
            type="soft",
            severity="low",
        )
        def below_four_days(table):
            return F.col(S.TRANSIT) < 4

        @custom.constraint(
            id="promise_covers_buffer",
            name="Promise covers buffer",
            category="arithmetic",
            pandas_columns=[S.PROMISED, S.BUFFER],
        )
        def covers_buffer(promised, buffer):
            return promised + buffer > 0

        return audit.catalog_audit(df, load_catalog(spark), vocabulary)


@query
def constraint_catalog(spark, sf_dir):
    """Catalog entries in full, each with the rows that violate it."""
    counts = audit.audit_counts(*_audit_input(spark, sf_dir)).select("audit_key", "violations")
    return load_catalog(spark).join(counts, "audit_key").select(
        "id", "name", "category", "type", "severity", "on_violation", "audit_key", "violations"
    )


@query
def carrier_vocabulary(spark, sf_dir):
    return rules.carrier_vocabulary(D.vocabulary_rows(spark, sf_dir))


@query
def violation_rows(spark, sf_dir):
    rows = audit.violation_rows(*_audit_input(spark, sf_dir))
    return rows.withColumn("violated", F.array_join("violated", ","))


@query
def quarantine_split(spark, sf_dir):
    marked = audit.flag_hard(*_audit_input(spark, sf_dir))
    return marked.groupBy("quarantined").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(S.TRANSIT), 6).alias("mean_transit")
    )


@query
def integrity_score(spark, sf_dir):
    return audit.integrity_score(D.audited(spark, sf_dir, []))


# ---- derived features ----------------------------------------------------------------
@query
def derived_features(spark, sf_dir):
    raw = D.deliveries(spark, sf_dir)
    out = derive.derive_features(raw)
    return out.select(
        S.ROW_ID,
        *_nine(out, [*S.DURATION_COLUMNS, "transit_duration"]),
        S.DISTANCE,
        S.LABEL,
    )


@query
def label_from_sla(spark, sf_dir):
    df = derive.add_durations(D.deliveries(spark, sf_dir, S.DATE_COLUMNS))
    return df.select(S.ROW_ID, derive.label_from_sla(F.col(S.SLA)).alias(S.LABEL))


@query
def label_from_transit(spark, sf_dir):
    dated = D.deliveries(spark, sf_dir, S.DATE_COLUMNS).drop(S.PROMISE_SHIP, S.PROMISE_DELIVERY)
    return derive.derive_label(derive.add_durations(dated)).select(S.ROW_ID, S.LABEL)


def _zip_input(spark, sf_dir):
    h = F.col("h")
    plain = F.lpad((F.lit(10000) + h % 25).cast("string"), 5, "0")
    code = (
        F.when(h % 13 == 0, F.lit(None).cast("string"))
        .when(h % 13 == 1, "bad")
        .when(h % 13 == 2, F.concat(plain, F.lit("-1234")))
        .otherwise(plain)
    )
    rows = D.deliveries(spark, sf_dir, [S.CREATED]).select(S.ROW_ID, code.alias("zip_code"))
    key = F.col("n_nationkey")
    places = (
        D.table(spark, sf_dir, "nation")
        .where(F.col("n_regionkey") != 4)
        .select(
            F.lpad((F.lit(10000) + key).cast("string"), 5, "0").alias("zip5"),
            (F.lit(25.0) + key).alias("latitude"),
            (F.lit(-120.0) + F.lit(2.0) * key).alias("longitude"),
        )
    )
    return rows, places


@query
def zip_distance(spark, sf_dir):
    out = derive.add_distance(*_zip_input(spark, sf_dir))
    return out.select(S.ROW_ID, F.round(S.DISTANCE, 6).alias(S.DISTANCE))


@query
def zip_distance_parity(spark, sf_dir):
    out = derive.add_distance(*_zip_input(spark, sf_dir), parity=True)
    return out.select(S.ROW_ID, F.round(S.DISTANCE, 6).alias(S.DISTANCE))


@query
def encode_categoricals(spark, sf_dir):
    return derive.encode_categories(D.canonical(spark, sf_dir)).select(
        S.ROW_ID, *S.ENCODED_COLUMNS
    )


@query
def feature_matrix(spark, sf_dir):
    out = derive.feature_matrix(D.canonical(spark, sf_dir))
    return out.select(S.ROW_ID, *_nine(out, S.FEATURE_COLUMNS), S.LABEL)


@query
def standardise(spark, sf_dir):
    real, synth = D.canonical(spark, sf_dir, []), D.synthetic(spark, sf_dir, [])
    out = derive.standardise(synth, real, S.DURATION_COLUMNS)
    return out.select(S.ROW_ID, *[F.round(c, 6).alias(c) for c in S.DURATION_COLUMNS])


# ---- filters, repair, ladder, gates ----------------------------------------------------
@query
def rejection_filter(spark, sf_dir):
    return repair.rejection_filter(D.audited(spark, sf_dir)).select(S.ROW_ID, S.LABEL)


@query
def tiered_rejection(spark, sf_dir):
    df = D.audited(spark, sf_dir, [])
    parts = [
        repair.tiered_rejection(df, level).select(F.lit(level).alias("level"), S.LABEL)
        for level in ("none", "moderate", "strict")
    ]
    return (
        parts[0]
        .unionByName(parts[1])
        .unionByName(parts[2])
        .groupBy("level")
        .agg(
            F.count(F.lit(1)).alias("kept"),
            F.count_if(F.col(S.LABEL) == 2).alias("kept_label2"),
        )
    )


def _ladder_train(df):
    return df.where(F.col("last_scac").isNotNull() & (F.col("last_scac") != "ZZZ"))


def _ladder_query(level: str):
    def run(spark, sf_dir):
        df = D.audited(spark, sf_dir)
        return ladder.ladder_filter(df, level, _ladder_train(df)).select(S.ROW_ID, S.LABEL)

    QUERIES[f"ladder_filter_{level}"] = run


for _level in ("temporal", "moderate", "strict"):
    _ladder_query(_level)


@query
def constraint_ladder(spark, sf_dir):
    return ladder.spec_table(D.audited(spark, sf_dir))


@query
def ladder_spec_drops(spark, sf_dir):
    return ladder.spec_drop_counts(D.audited(spark, sf_dir), "moderate")


@query
def strictness_levels(spark, sf_dir):
    """Survivors at every strictness level, counted in one pass over the rows."""
    df = D.audited(spark, sf_dir)
    return ladder.strictness_survivors(df, _ladder_train(df))


@query
def deterministic_repair(spark, sf_dir):
    out = records(repair.deterministic_repair(D.audited(spark, sf_dir, [])))
    shown = [S.CAPTURE, S.SHIP, S.DELIVERY, *S.DURATION_COLUMNS, S.LABEL]
    return out.select(S.ROW_ID, *_nine(out, shown))


@query
def preflight_checks(spark, sf_dir):
    return checks.preflight_checks(D.audited(spark, sf_dir, []))


@query
def sanity_checks(spark, sf_dir):
    real, synth = D.sides(spark, sf_dir)
    return checks.sanity_checks(synth, real)


@query
def sanity_flagged_examples(spark, sf_dir):
    real, synth = D.sides(spark, sf_dir)
    out = records(checks.flagged_examples(synth, real))
    return out.select(*_nine(out, out.columns))


@query
def sanity_sample(spark, sf_dir):
    out = records(checks.sanity_sample(D.synthetic(spark, sf_dir)))
    return out.select(*_nine(out, out.columns))


@query
def record_export(spark, sf_dir):
    df = D.canonical(spark, sf_dir)
    out = records(df.select(S.ROW_ID, *checks.display_columns(df)))
    return out.select(*_nine(out, out.columns))


@query
def leakage_identities(spark, sf_dir):
    return checks.leakage_identities(D.canonical(spark, sf_dir, []))


@query
def linear_identities(spark, sf_dir):
    """Identities that give the label source, of any number of terms."""
    found = identities.linear_identities(D.canonical(spark, sf_dir, []))
    return found.where("leaks").select(
        "identity", F.round("max_abs_residual", 6).alias("max_abs_residual"), "n"
    )
