"""Boundary and null behaviour of rules, repairs, ladder and catalog."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.operators import audit, checks, custom, ladder, repair, rules
from waybill.sources.catalog import load_catalog

COLUMNS = (
    "row_id string, date_order_capture timestamp, date_ship_last_shipment timestamp, "
    "date_delivery_last_shipment timestamp, transit_duration_days double, delay_label double, "
    "last_scac string, carrier_service_code string"
)


def rows(spark, n=3, **changes):
    base = dict(
        date_order_capture=dt.datetime(2026, 1, 1),
        date_ship_last_shipment=dt.datetime(2026, 1, 2),
        date_delivery_last_shipment=dt.datetime(2026, 1, 5),
        transit_duration_days=2.0,
        delay_label=0.0,
        last_scac="DHL",
        carrier_service_code="XP",
    )
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    out = []
    for i in range(n):
        row = {"row_id": str(i), **base}
        for k, v in changes.items():
            if k in row:
                row[k] = v[i] if isinstance(v, list) else v
        out.append(tuple(row[c] for c in names))
    df = spark.createDataFrame(out, COLUMNS)
    for k, v in changes.items():
        if k not in names:
            extra = spark.createDataFrame(
                [(str(i), v[i] if isinstance(v, list) else v) for i in range(n)],
                f"row_id string, {k} {'timestamp' if k.startswith('date') else 'string' if isinstance(v, list) and any(isinstance(x, str) for x in v) else 'double'}",
            )
            df = df.join(extra, "row_id")
    return df


def counts(df, vocabulary=None):
    return {r.audit_key: r.violations for r in audit.audit_counts(df, vocabulary).collect()}


def test_clean_rows_pass(spark):
    with pytest.warns(UserWarning):
        got = counts(rows(spark))
    assert set(got.values()) == {0}
    assert "RPT_non_negative_promised_transit" not in got
    assert "R3_non_negative_capture_latency" not in got


def test_missing_date_breaks_the_chain(spark):
    df = rows(spark, date_delivery_last_shipment=[None, dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)])
    assert counts(df)["R1_temporal_order"] == 2


def test_transit_and_latency_boundaries(spark):
    nan = float("nan")
    got = counts(
        rows(spark, 4, transit_duration_days=[0.0, -1.0, nan, None], capture_latency_days=[0.0, -0.5 / 86400, -1.0, None])
    )
    assert got["R2_positive_transit"] == 2
    assert got["R3_non_negative_capture_latency"] == 1


def test_promised_transit(spark):
    assert counts(rows(spark, promised_transit_days=[0.0, 0.5, 10.0]))["RPT_non_negative_promised_transit"] == 0
    assert counts(rows(spark, promised_transit_days=[3.0, -1.5, 1.0]))["RPT_non_negative_promised_transit"] == 1
    loose = rows(spark, promised_transit_days=["nan", None, "not-a-number"])
    assert counts(loose)["RPT_non_negative_promised_transit"] == 0


def test_labels(spark):
    assert counts(rows(spark, 4, delay_label=[0.0, 3.0, None, float("nan")]))["R5_label_cardinality"] == 3
    late = rows(
        spark,
        delay_label=[0.0, 1.0, 2.0],
        date_promise_delivery=[dt.datetime(2026, 1, 5), dt.datetime(2026, 1, 4), None],
    )
    assert counts(late)["R3b_label_sla_consistency"] == 0


def test_vocabulary_and_membership(spark):
    pairs = spark.createDataFrame(
        [("DHL", "XP"), ("UPS", "XG"), ("DHL", "XP"), (None, "XE"), ("", "XE"), ("NaT", "XE")],
        "last_scac string, carrier_service_code string",
    )
    vocabulary = rules.carrier_vocabulary(pairs)
    assert vocabulary.count() == 2
    df = rows(spark, 4, last_scac=["DHL", "DHL", None, "UPS"], carrier_service_code=["XP", "XG", "XP", "XG"])
    assert counts(df, vocabulary)["R4_referential_integrity"] == 2
    assert counts(df)["R4_referential_integrity"] == 1
    # learned on the audited rows themselves, everything present becomes valid
    assert counts(df.where("last_scac is not null"), rules.carrier_vocabulary(df))["R4_referential_integrity"] == 0


def test_large_vocabulary_takes_the_shuffle_path(spark, monkeypatch):
    from waybill.functions import small

    vocabulary = rules.carrier_vocabulary(
        spark.createDataFrame([("DHL", "XP"), ("UPS", "XG")], "last_scac string, carrier_service_code string")
    )
    df = rows(spark, last_scac=["DHL", "UPS", "FDX"])
    expected = counts(df, vocabulary)
    original = small.broadcast_if_small
    monkeypatch.setattr(rules, "broadcast_if_small", lambda d, m=0: original(d, 1))
    assert counts(df, vocabulary) == expected


def test_calendar(spark):
    saturday, sunday = dt.datetime(2026, 1, 10), dt.datetime(2026, 1, 11)
    df = rows(
        spark,
        5,
        last_scac=["DPD", "DHL", None, "DPD", "DHL"],
        date_delivery_last_shipment=[saturday, saturday, sunday, sunday, None],
    )
    assert counts(df)["R6_scac_calendar_soft"] == 3


def test_totals_count_hits_and_rows(spark):
    df = rows(spark, transit_duration_days=[-1.0, 1.0, 1.0], delay_label=[9.0, 0.0, 0.0])
    got = audit.audit_summary(df).first()
    assert (got.total_hard_violations, got.violating_rows) == (2, 1)
    assert got.violation_rate_pct == pytest.approx(66.6667)
    none = audit.audit_summary(df.limit(0)).first()
    assert (none.n, none.total_hard_violations, none.violation_rate_pct) == (0, 0, 0.0)


def test_violation_rows_and_split_agree(spark):
    df = rows(spark, transit_duration_days=[-1.0, 1.0, 1.0], delay_label=[9.0, 0.0, 0.0])
    got = audit.violation_rows(df).collect()
    assert [(r.row_id, r.violated) for r in got] == [("0", ["R2_positive_transit", "R5_label_cardinality"])]
    clean, bad = audit.quarantine_split(df)
    assert (clean.count(), bad.count()) == (2, 1)


def test_catalog_binds_to_the_rules(spark, proxy):
    catalog = load_catalog(spark)
    keys = [r.audit_key for r in catalog.collect()]
    assert sorted(keys) == sorted(rules.RULE_KEYS)
    report = audit.catalog_audit(proxy, catalog, rules.carrier_vocabulary(proxy)).collect()
    assert len(report) == 8 and {r.status for r in report} == {"evaluated"}
    assert sum(r.violations for r in report if r.type == "hard") == 0


def test_catalog_reports_rules_it_could_not_evaluate(spark):
    report = audit.catalog_audit(rows(spark), load_catalog(spark)).collect()
    by_id = {r.id: r for r in report}
    assert by_id["R4_promised_transit_non_negative"].status == "not_evaluated"
    assert by_id["R4_promised_transit_non_negative"].violations == 0
    assert by_id["R5_referential_carrier_integrity"].status == "weak"


def test_custom_constraints(spark, proxy):
    custom.clear_constraints()
    df = proxy.withColumn("distance_km", F.when(F.substring("row_id", 2, 9).cast("int") < 10, -1.0).otherwise(5.0))

    @custom.constraint(id="near", name="Distance is not negative")
    def near(table):
        return F.col("distance_km") >= 0

    @custom.constraint(id="near_pandas", pandas_columns=["distance_km"])
    def near_pandas(distance):
        return distance >= 0

    with pytest.raises(ValueError):
        custom.constraint(id="near")
    try:
        report = {r.id: r for r in audit.catalog_audit(df, load_catalog(spark)).collect()}
    finally:
        custom.clear_constraints()
    assert report["near"].violations == report["near_pandas"].violations == 10
    assert report["near"].source == "custom"


def test_rejection_keeps_only_valid_rows(spark):
    df = rows(
        spark,
        6,
        transit_duration_days=[1.0, 0.0, None, 1.0, 1.0, 1.0],
        delay_label=[0.0, 0.0, 0.0, 5.0, 0.0, 0.0],
        last_scac=["DHL", "DHL", "DHL", "DHL", "", "DHL"],
        date_delivery_last_shipment=[dt.datetime(2026, 1, 5)] * 5 + [None],
    )
    kept = repair.rejection_filter(df)
    assert [r.row_id for r in kept.collect()] == ["0"]


def test_repair_leaves_no_repairable_violation(spark):
    from tests.conftest import SMALL
    from waybill.sources.driver_tables import audited

    fixed = repair.deterministic_repair(audited(spark, SMALL))
    got = counts(fixed)
    for key in ("R2_positive_transit", "RPT_non_negative_promised_transit", "R5_label_cardinality", "R3_non_negative_capture_latency"):
        assert got[key] == 0
    again = repair.deterministic_repair(fixed)
    assert again.exceptAll(fixed).isEmpty()


def test_ladder_sizes_and_monotone_survivors(spark, proxy):
    sizes = [len(ladder.build_specs(proxy, level)) for level in S.LADDER]
    assert sizes == [0, 4, 8, 9]
    assert ladder.build_specs(proxy, "relaxed") == []
    kept = [ladder.ladder_filter(proxy, level).count() for level in S.LADDER]
    assert kept == sorted(kept, reverse=True)
    counted = {r.level: r.survivors for r in ladder.strictness_survivors(proxy).collect()}
    assert [counted[level] for level in S.LADDER] == kept


def test_ladder_skips_empty_columns(spark, proxy):
    hollow = proxy.withColumn("promised_transit_days", F.lit(None).cast("double")).drop("date_promise_shipment")
    assert len(ladder.build_specs(hollow, "strict")) == 7


def test_integrity_and_preflight(spark, proxy):
    assert audit.integrity_score(proxy).first().integrity_violation_pct == 0.0
    report = {r.check_name: r.passed for r in checks.preflight_checks(proxy, tolerance=1.0).collect()}
    assert all(report.values())
    with pytest.raises(checks.PreflightError):
        checks.preflight_checks(proxy.drop("delay_label"))
    with pytest.raises(checks.PreflightError):
        checks.preflight_checks(proxy, expected={0: 0.0}, raise_on_fail=True)


def test_results_do_not_depend_on_partitioning(spark):
    from tests.conftest import SMALL
    from waybill.sources.driver_tables import audited

    df = audited(spark, SMALL)
    assert counts(df) == counts(df.repartition(13))


def test_identities_of_many_terms_are_found(spark):
    import numpy as np

    from waybill.operators.identities import linear_identities, null_identities

    draw = np.random.default_rng(4).normal(size=(400, 6)) * [1, 10, 0.1, 3, 100, 5] + [0, 1e4, 5, 0, 0, 2]
    a, b, c, d, e, free = draw.T
    target = a - b + 2 * c + 0.5 * d - e + 3
    table = {"t": target, "a": a, "b": b, "c": c, "d": d, "e": e, "free": free, "twin": a + b, "fixed": np.full(400, 7.0)}
    rows = [tuple(float(v[i]) for v in table.values()) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, *rows[0][1:]), (float("nan"), *rows[1][1:])], ", ".join(f"{k} double" for k in table))
    found = {r.dependent: r for r in linear_identities(df, "t", list(table)[1:]).collect()}
    assert set(found) == {"t", "twin", "fixed"}
    assert found["t"].identity == "+a-b+2*c+0.5*d-e+3" and found["t"].terms == 5
    assert found["t"].leaks and found["t"].max_abs_residual < 1e-6 and found["t"].n == 400
    assert found["twin"].identity == "+a+b" and found["twin"].holds and not found["twin"].leaks
    assert found["fixed"].identity == "+7" and not found["fixed"].leaks
    # One broken row is no identity any more; nothing is known without rows.
    broken = df.where("t IS NOT NULL").withColumn("t", F.when(F.col("a") == rows[0][1], F.col("t") + 1).otherwise(F.col("t")))
    assert not linear_identities(broken, "t", list(table)[1:]).where("leaks").count()
    assert linear_identities(df.where("false"), "t", ["a"]).count() == 0
    assert linear_identities(df, "t", ["a", "free"]).count() == 0
    assert null_identities(np.zeros((2, 2))) == [(0, {}), (1, {})]
