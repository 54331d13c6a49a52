"""Independent SQL for the registered queries, run by DuckDB on the same tables.

`_VIEWS` are shared CTEs; a statement gets exactly those it mentions, directly or through
another view.
"""

from __future__ import annotations

import re

from waybill import schema as S

_VIEWS: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    _VIEWS[name] = sql


def oracle(key: str, sql: str) -> None:
    ORACLE[key] = sql


def _mentioned(sql: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    return [n for n in _VIEWS if n in words]


def statement(body: str) -> str:
    """`body` with the CTEs it needs in front."""
    order: list[str] = []

    def need(sql: str) -> None:
        for name in _mentioned(sql):
            if name not in order and _VIEWS[name] is not sql:
                need(_VIEWS[name])
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in order) + "\n" + body


def all_statements() -> dict[str, str]:
    return {k: statement(v) for k, v in ORACLE.items()}


# ---- deliveries --------------------------------------------------------------------
view(
    "w_lines",
    """
    SELECT *, l_orderkey*31 + l_partkey*7 + l_suppkey*13 + l_linenumber*3 AS h
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)
view(
    "w_c1",
    """
    SELECT *, o_orderdate + to_seconds(CASE WHEN h%29=0 THEN -86400 WHEN h%5=0 THEN -1 ELSE h%3600 END)
      AS date_order_capture FROM w_lines
    """,
)
view(
    "w_c2",
    """
    SELECT *,
      date_order_capture + to_hours(CASE WHEN h%37=0 THEN -30 ELSE 2 + h%40 END) AS date_ship_last_shipment,
      date_order_capture + to_hours((h//7)%15) AS date_promise_shipment
    FROM w_c1
    """,
)
view(
    "w_dates",
    """
    SELECT *, o_orderdate AS date_order_created_omni,
      CASE WHEN h%53<>0 THEN date_ship_last_shipment
        + to_hours(CASE WHEN h%41=0 THEN 0 WHEN h%43=0 THEN -12 ELSE 6 + (h//11)%120 END) END AS date_delivery_last_shipment,
      date_promise_shipment + to_hours(CASE WHEN h%47=0 THEN -24 ELSE 48 + (h//13)%72 END) AS date_promise_delivery
    FROM w_c2
    """,
)


def _days(a: str, b: str) -> str:
    return f"(epoch_us({b}) - epoch_us({a})) / 86400e6"


view(
    "w_base",
    f"""
    SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id, h,
      l_suppkey, l_partkey, o_custkey, o_orderpriority,
      date_order_created_omni, date_order_capture, date_ship_last_shipment,
      date_delivery_last_shipment, date_promise_delivery, date_promise_shipment,
      CASE WHEN h%17=0 THEN NULL WHEN h%17=1 THEN '' WHEN h%17=2 THEN 'ZZZ'
        ELSE ['DHL','UPS','FDX','DPD','USPS'][l_suppkey%5+1] END AS last_scac,
      ['XS','XP','XG','XE','XD'][(l_suppkey//5)%5+1] AS carrier_service_code,
      o_orderpriority AS last_shipment_carrier_service,
      'SN_' || (l_suppkey%70) AS last_shipnode,
      {_days('date_order_created_omni','date_order_capture')} AS capture_latency_days,
      {_days('date_ship_last_shipment','date_delivery_last_shipment')} AS transit_duration_days,
      {_days('date_promise_shipment','date_promise_delivery')} AS promised_transit_days,
      {_days('date_ship_last_shipment','date_promise_shipment')} AS shipment_buffer_days,
      {_days('date_delivery_last_shipment','date_promise_delivery')} AS sla_buffer,
      0.0::DOUBLE AS distance_km
    FROM w_dates
    """,
)
view(
    "w_audited",
    """
    SELECT *, CASE WHEN h%67=0 THEN NULL WHEN h%61=0 THEN 7
        WHEN h%59=0 THEN (honest+1)%3 ELSE honest END::INTEGER AS delay_label
    FROM (SELECT *, CASE WHEN sla_buffer>=0 THEN 0 WHEN -sla_buffer<=2 THEN 1 ELSE 2 END AS honest FROM w_base)
    """,
)
view(
    "w_real",
    """
    SELECT b.*, CASE WHEN sla_buffer IS NULL OR sla_buffer>=0 THEN 0 WHEN -sla_buffer<=2 THEN 1 ELSE 2 END::INTEGER AS delay_label,
      c_mktsegment AS order_type, cn.n_name AS dpe_id, p_type AS line_type, p_brand AS item_id,
      sn.n_name AS dpe_shipnode
    FROM w_base b
    JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
    JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
    """,
)


def u(key: str, salt: str, seed: str = "42", lane: int = 0) -> str:
    return (
        f"((('0x' || substr(sha256(concat_ws('|', {key}, '{salt}', '{seed}')), {13*lane+1}, 13))::BIGINT + 0.5::DOUBLE)"
        " / 4503599627370496.0::DOUBLE)"
    )


def gauss(key: str, salt: str, seed: str = "42", lane: int = 0) -> str:
    pair = lane // 2
    trig = "cos" if lane % 2 == 0 else "sin"
    return (
        f"(sqrt(-2.0::DOUBLE * ln({u(key, salt, seed, 2*pair)}))"
        f" * {trig}(6.283185307179586::DOUBLE * {u(key, salt, seed, 2*pair+1)}))"
    )


def q6(expr: str) -> str:
    return f"(floor(({expr}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE)"


_noisy = ",\n".join(
    q6(f"r.{c} + 0.03::DOUBLE * s.{c} * {gauss('r.row_id', f'noise{i//4}', '42', i%4)}") + f" AS {c}"
    for i, c in enumerate(S.DURATION_COLUMNS)
)
view(
    "w_spread",
    "SELECT " + ", ".join(f"round(stddev_samp({c}), 6) AS {c}" for c in S.DURATION_COLUMNS) + " FROM w_base",
)
view(
    "w_synth",
    f"""
    SELECT r.* REPLACE ({_noisy},
      CASE WHEN h%19=0 THEN (r.delay_label+1)%3 ELSE r.delay_label END::INTEGER AS delay_label,
      CASE WHEN h%23=0 THEN 'DHL' ELSE r.last_scac END AS last_scac,
      CASE WHEN h%31=0 THEN 'NOVEL' ELSE r.line_type END AS line_type)
    FROM w_real r, w_spread s
    """,
)
view(
    "w_vocab",
    """
    SELECT DISTINCT last_scac, carrier_service_code FROM (
      SELECT CASE WHEN s_acctbal < 0 THEN '' ELSE ['DHL','UPS','FDX','DPD','USPS'][s_suppkey%5+1] END AS last_scac,
        ['XS','XP','XG','XE','XD'][(s_suppkey//5)%5+1] AS carrier_service_code FROM supplier)
    WHERE last_scac NOT IN ('','nan','None','NaN','<NA>','NaT') AND carrier_service_code IS NOT NULL
    """,
)
view(
    "w_pred",
    """
    SELECT *, [w0/(w0+w1+w2), w1/(w0+w1+w2), w2/(w0+w1+w2)] AS proba FROM (
      SELECT *, (h%7 + 1 + CASE WHEN y_pred=0 THEN 8 + h%9 ELSE 0 END)::DOUBLE AS w0,
        (h%5 + 1 + CASE WHEN y_pred=1 THEN 8 + h%9 ELSE 0 END)::DOUBLE AS w1,
        (h%3 + 1 + CASE WHEN y_pred=2 THEN 8 + h%9 ELSE 0 END)::DOUBLE AS w2
      FROM (SELECT row_id, h, (h%5)::INTEGER AS fold, honest::INTEGER AS y_true,
              ((honest + (h%11=0)::INTEGER) % 3)::INTEGER AS y_pred
            FROM (SELECT row_id, h, CASE WHEN sla_buffer>=0 THEN 0 WHEN -sla_buffer<=2 THEN 1 ELSE 2 END AS honest FROM w_base)))
    """,
)

# ---- constraint flags --------------------------------------------------------------
view(
    "w_flags",
    """
    SELECT a.*,
      NOT coalesce(date_order_capture <= date_ship_last_shipment AND date_ship_last_shipment <= date_delivery_last_shipment
        AND coalesce(date_promise_shipment <= date_promise_delivery, true), false) AS f_r1,
      coalesce(transit_duration_days <= 0, false) AS f_r2,
      coalesce(promised_transit_days < 0, false) AS f_rpt,
      coalesce(capture_latency_days < -(1.0::DOUBLE/86400.0::DOUBLE), false) AS f_r3,
      delay_label IS DISTINCT FROM (CASE WHEN sla_buffer>=0 THEN 0 WHEN -sla_buffer<=2 THEN 1 ELSE 2 END) AS f_r7,
      (v.last_scac IS NULL) AS f_r5,
      coalesce(a.last_scac IN ('','nan','None','NaN'), true) OR coalesce(a.carrier_service_code IN ('','nan','None','NaN'), true) AS f_r5p,
      coalesce(delay_label NOT IN (0,1,2), true) AS f_r6,
      coalesce(isodow(date_delivery_last_shipment)-1 = 6 OR (a.last_scac='DPD' AND isodow(date_delivery_last_shipment)-1 = 5), false) AS f_r8
    FROM w_audited a LEFT JOIN w_vocab v
      ON a.last_scac = v.last_scac AND a.carrier_service_code = v.carrier_service_code
    """,
)
_RULE_FLAG = {
    "R1_temporal_order": "f_r1",
    "R2_positive_transit": "f_r2",
    "RPT_non_negative_promised_transit": "f_rpt",
    "R3_non_negative_capture_latency": "f_r3",
    "R3b_label_sla_consistency": "f_r7",
    "R4_referential_integrity": "f_r5",
    "R5_label_cardinality": "f_r6",
    "R6_scac_calendar_soft": "f_r8",
}
for _key, _rule, _flag in [
    ("audit_r1", "R1_temporal_order", "f_r1"),
    ("audit_r2", "R2_positive_transit", "f_r2"),
    ("audit_r3", "R3_non_negative_capture_latency", "f_r3"),
    ("audit_rpt", "RPT_non_negative_promised_transit", "f_rpt"),
    ("audit_r5_membership", "R4_referential_integrity", "f_r5"),
    ("audit_r5_presence", "R4_referential_integrity", "f_r5p"),
    ("audit_r6", "R5_label_cardinality", "f_r6"),
    ("audit_r7", "R3b_label_sla_consistency", "f_r7"),
    ("audit_r8", "R6_scac_calendar_soft", "f_r8"),
]:
    oracle(
        _key,
        f"SELECT '{_rule}' AS audit_key, count(*) FILTER ({_flag}) AS violations, count(*) AS n FROM w_flags",
    )
_HARD = ["f_r1", "f_r2", "f_rpt", "f_r3", "f_r7", "f_r5", "f_r6"]
oracle(
    "audit_counts",
    " UNION ALL ".join(
        f"SELECT '{r}' AS audit_key, count(*) FILTER ({f}) AS violations, count(*) AS n FROM w_flags"
        for r, f in _RULE_FLAG.items()
    ),
)
oracle(
    "audit_summary",
    f"""
    SELECT n, hits AS total_hard_violations, violating_rows, round(hits*100.0::DOUBLE/n, 4) AS violation_rate_pct
    FROM (SELECT count(*) AS n, ({' + '.join(f'count(*) FILTER ({f})' for f in _HARD)})::BIGINT AS hits,
      count(*) FILTER ({' OR '.join(_HARD)}) AS violating_rows FROM w_flags)
    """,
)
oracle("carrier_vocabulary", "SELECT * FROM w_vocab")
oracle(
    "violation_rows",
    "SELECT row_id, array_to_string(list_sort(list_filter(["
    + ", ".join(f"CASE WHEN {f} THEN '{r}' END" for r, f in _RULE_FLAG.items())
    + "], lambda x: x IS NOT NULL)), ',') AS violated FROM w_flags WHERE "
    + " OR ".join(_RULE_FLAG.values()),
)
oracle(
    "quarantine_split",
    f"SELECT quarantined, count(*) AS n, round(avg(transit_duration_days),6) AS mean_transit FROM (SELECT *, {' OR '.join(_HARD)} AS quarantined FROM w_flags) GROUP BY 1",
)
oracle(
    "integrity_score",
    """
    SELECT n, violations, round(violations*100.0::DOUBLE/n,4) AS integrity_violation_pct FROM (
      SELECT count(*) AS n, (count(*) FILTER (transit_duration_days<=0) + count(*) FILTER (capture_latency_days<0)
        + count(*) FILTER (coalesce(delay_label NOT IN (0,1,2), true)))::BIGINT AS violations FROM w_audited)
    """,
)
_CATALOG = [
    ("R1_temporal_ordering", "Temporal event ordering", "temporal", "hard", "high", "reject", "R1_temporal_order"),
    ("R2_positive_transit", "Positive transit duration", "arithmetic", "hard", "high", "reject", "R2_positive_transit"),
    ("R3_non_negative_capture_latency", "Non-negative order-capture latency", "arithmetic", "hard", "high", "reject", "R3_non_negative_capture_latency"),
    ("R4_promised_transit_non_negative", "Non-negative promised transit window", "arithmetic", "hard", "high", "flag", "RPT_non_negative_promised_transit"),
    ("R5_referential_carrier_integrity", "Referential carrier/service integrity", "referential", "hard", "high", "reject", "R4_referential_integrity"),
    ("R6_label_cardinality", "Label cardinality", "cardinality", "hard", "high", "reject", "R5_label_cardinality"),
    ("R7_label_sla_consistency", "Label/SLA-buffer consistency", "arithmetic", "hard", "high", "reject", "R3b_label_sla_consistency"),
    ("R8_carrier_calendar_plausibility", "Carrier operating-calendar plausibility", "calendar", "soft", "low", "flag", "R6_scac_calendar_soft"),
]


def _catalog_sql(custom_row: str = "") -> str:
    rows = []
    for i, name, cat, typ, sev, act, key in _CATALOG:
        rows.append(
            f"SELECT '{i}' AS id, '{name}' AS name, '{cat}' AS category, '{typ}' AS type, '{sev}' AS severity,"
            f" '{act}' AS on_violation, '{key}' AS audit_key, count(*) FILTER ({_RULE_FLAG[key]}) AS violations,"
            f" count(*) AS n, round(count(*) FILTER ({_RULE_FLAG[key]})*100.0::DOUBLE/count(*),4) AS violation_rate_pct,"
            " 'seed' AS source, 'evaluated' AS status FROM w_flags"
        )
    return " UNION ALL ".join(rows) + custom_row


oracle("catalog_audit", _catalog_sql())
oracle(
    "constraint_catalog",
    f"SELECT id, name, category, type, severity, on_violation, audit_key, violations FROM ({_catalog_sql()})",
)
oracle(
    "custom_constraint",
    _catalog_sql(
        " UNION ALL SELECT 'transit_below_four_days', 'Transit below four days', 'arithmetic', 'soft', 'low',"
        " 'flag', NULL, count(*) FILTER (coalesce(NOT (transit_duration_days < 4), true)), count(*),"
        " round(count(*) FILTER (coalesce(NOT (transit_duration_days < 4), true))*100.0::DOUBLE/count(*),4), 'custom', 'evaluated' FROM w_flags"
        " UNION ALL SELECT 'promise_covers_buffer', 'Promise covers buffer', 'arithmetic', 'hard', 'medium',"
        " 'flag', NULL, count(*) FILTER (coalesce(NOT (promised_transit_days + shipment_buffer_days > 0), true)), count(*),"
        " round(count(*) FILTER (coalesce(NOT (promised_transit_days + shipment_buffer_days > 0), true))*100.0::DOUBLE/count(*),4), 'custom', 'evaluated' FROM w_flags"
    ),
)

# ---- derived features --------------------------------------------------------------
_D = ", ".join(f"round({c}, 9) AS {c}" for c in S.DURATION_COLUMNS)
oracle("derived_features", f"SELECT row_id, {_D}, round(transit_duration_days,9) AS transit_duration, distance_km, delay_label FROM w_real")
oracle("label_from_sla", "SELECT row_id, CASE WHEN sla_buffer IS NULL OR sla_buffer>=0 THEN 0 WHEN -sla_buffer<=2 THEN 1 ELSE 2 END::INTEGER AS delay_label FROM w_base")
oracle(
    "label_from_transit",
    """
    SELECT row_id, CASE WHEN q1 IS NULL OR transit_duration_days <= q1 THEN 0 WHEN transit_duration_days <= q2 THEN 1 ELSE 2 END::INTEGER AS delay_label
    FROM w_base, (SELECT quantile_cont(transit_duration_days, 0.5442) q1, quantile_cont(transit_duration_days, 0.5442+0.3758) q2 FROM w_base)
    """,
)
view(
    "w_zip",
    """
    SELECT row_id, zip_code, nullif(regexp_extract(zip_code, '^(\\d{5})', 1), '') AS zip5 FROM (
      SELECT row_id, CASE WHEN h%13=0 THEN NULL WHEN h%13=1 THEN 'bad' WHEN h%13=2 THEN lpad((10000+h%25)::VARCHAR,5,'0')||'-1234'
        ELSE lpad((10000+h%25)::VARCHAR,5,'0') END AS zip_code FROM w_base)
    """,
)
view(
    "w_places",
    "SELECT lpad((10000+n_nationkey)::VARCHAR,5,'0') AS zip5, 25.0::DOUBLE + n_nationkey AS lat, -120.0::DOUBLE + 2.0::DOUBLE*n_nationkey AS lon FROM nation WHERE n_regionkey <> 4",
)
for _key, _lon in [("zip_distance", "lon"), ("zip_distance_parity", "CASE WHEN lon IS NOT NULL THEN -75.9113 END")]:
    oracle(
        _key,
        f"""
        SELECT row_id, round(coalesce(d, (SELECT quantile_cont(d, 0.5) FROM k), 0), 6) AS distance_km FROM k
        """.replace(
            "FROM k)", "FROM K)"
        ).replace("FROM K)", "FROM w_km_" + ("p" if _lon != "lon" else "t") + ")").replace(
            "FROM k", "FROM w_km_" + ("p" if _lon != "lon" else "t")
        ),
    )
    view(
        "w_km_" + ("p" if _lon != "lon" else "t"),
        f"""
        SELECT row_id, 2*6371.0*asin(sqrt(pow(sin((radians(41.2044)-radians(lat))/2),2)
          + cos(radians(lat))*cos(radians(41.2044))*pow(sin((radians(-75.9113)-radians({_lon}))/2),2))) AS d
        FROM w_zip LEFT JOIN w_places USING (zip5)
        """,
    )
_codes = ", ".join(
    f"(dense_rank() OVER (ORDER BY coalesce({c}, 'nan')) - 1)::BIGINT AS {c}_enc" for c in S.CATEGORICAL_COLUMNS
)
oracle("encode_categoricals", f"SELECT row_id, {_codes} FROM w_real")
oracle(
    "feature_matrix",
    f"SELECT row_id, distance_km, coalesce(promised_transit_days,0) AS promised_transit_days, {_codes.replace('::BIGINT', '::DOUBLE')}, delay_label FROM w_real".replace(
        "promised_transit_days,0) AS promised_transit_days", "round(promised_transit_days,9),0) AS promised_transit_days"
    ),
)
oracle(
    "standardise",
    "SELECT row_id, "
    + ", ".join(f"round((coalesce(s.{c},0) - m.{c}_m)/m.{c}_s, 6) AS {c}" for c in S.DURATION_COLUMNS)
    + " FROM w_synth s, (SELECT "
    + ", ".join(
        f"avg(coalesce({c},0)) AS {c}_m, CASE WHEN stddev_pop(coalesce({c},0))=0 THEN 1 ELSE stddev_pop(coalesce({c},0)) END AS {c}_s"
        for c in S.DURATION_COLUMNS
    )
    + " FROM w_real) m",
)

# ---- filters, repair, ladder -------------------------------------------------------
view(
    "w_kept",
    """
    SELECT * FROM w_audited WHERE coalesce(transit_duration_days > 0 AND delay_label IN (0,1,2)
      AND last_scac NOT IN ('','nan','None','NaN') AND carrier_service_code NOT IN ('','nan','None','NaN')
      AND date_order_capture <= date_ship_last_shipment AND date_ship_last_shipment <= date_delivery_last_shipment, false)
    """,
)
_ids = "SELECT row_id, delay_label FROM"
oracle("rejection_filter", f"{_ids} w_kept")
oracle(
    "tiered_rejection",
    """
    SELECT level, count(*) AS kept, count(*) FILTER (delay_label=2) AS kept_label2 FROM (
      SELECT 'none' AS level, delay_label FROM w_audited
      UNION ALL SELECT 'moderate', delay_label FROM w_audited WHERE transit_duration_days>0 AND promised_transit_days>=0 AND delay_label IN (0,1,2)
      UNION ALL SELECT 'strict', delay_label FROM w_audited WHERE transit_duration_days>0 AND promised_transit_days>=0 AND delay_label IN (0,1,2)
        AND delay_label = CASE WHEN sla_buffer IS NULL OR sla_buffer>=0 THEN 0 WHEN -sla_buffer<=2 THEN 1 ELSE 2 END) GROUP BY 1
    """,
)
_T = """coalesce(transit_duration_days >= 0.01, true) AND coalesce(date_order_capture <= date_ship_last_shipment, true)
  AND coalesce(date_ship_last_shipment <= date_delivery_last_shipment, true) AND coalesce(date_promise_shipment <= date_promise_delivery, true)"""
_M = _T + """ AND coalesce(capture_latency_days >= 0, true) AND coalesce(promised_transit_days >= 0, true)
  AND coalesce(shipment_buffer_days >= 0, true) AND coalesce(distance_km >= 0, true)"""
view("w_pairs", "SELECT DISTINCT last_scac, carrier_service_code, true AS hit FROM w_base WHERE last_scac IS NOT NULL AND last_scac <> 'ZZZ'")
view("w_ladder_temporal", f"SELECT * FROM w_audited WHERE {_T}")
view("w_ladder_moderate", f"SELECT * FROM w_audited WHERE {_M}")
view(
    "w_ladder_strict",
    f"""SELECT a.* FROM w_audited a LEFT JOIN w_pairs p ON a.last_scac = p.last_scac AND a.carrier_service_code = p.carrier_service_code
    WHERE {_M} AND (a.last_scac IS NULL OR a.carrier_service_code IS NULL OR p.hit)""",
)
for _l in ("temporal", "moderate", "strict"):
    oracle(f"ladder_filter_{_l}", f"{_ids} w_ladder_{_l}")
oracle(
    "strictness_levels",
    """
    SELECT 'none' AS level, 0::BIGINT AS position, count(*) AS survivors FROM w_audited
    UNION ALL SELECT 'temporal', 1, count(*) FROM w_ladder_temporal
    UNION ALL SELECT 'moderate', 2, count(*) FROM w_ladder_moderate
    UNION ALL SELECT 'strict', 3, count(*) FROM w_ladder_strict
    UNION ALL SELECT 'strict+reject', 4, count(*) FROM w_ladder_strict s WHERE s.row_id IN (SELECT row_id FROM w_kept)
    """,
)
_SPECS = [
    (1, "temporal", "ScalarInequality", "transit_duration_days", "0.01::DOUBLE"),
    (2, "temporal", "Inequality", "date_order_capture,date_ship_last_shipment", "NULL"),
    (3, "temporal", "Inequality", "date_ship_last_shipment,date_delivery_last_shipment", "NULL"),
    (4, "temporal", "Inequality", "date_promise_shipment,date_promise_delivery", "NULL"),
    (5, "moderate", "ScalarInequality", "capture_latency_days", "0.0::DOUBLE"),
    (6, "moderate", "ScalarInequality", "promised_transit_days", "0.0::DOUBLE"),
    (7, "moderate", "ScalarInequality", "shipment_buffer_days", "0.0::DOUBLE"),
    (8, "moderate", "ScalarInequality", "distance_km", "0.0::DOUBLE"),
    (9, "strict", "FixedCombinations", "last_scac,carrier_service_code", "NULL"),
]
_LEVEL_OF = {"transit_duration_days": 0}
_rows = []
for _depth, _level in enumerate(S.LADDER):
    for _i, _lv, _kind, _cols, _val in _SPECS:
        if S.LADDER.index(_lv) <= _depth:
            _guard = " AND ".join(f"max({c}) IS NOT NULL" for c in _cols.split(","))
            _rows.append(
                f"SELECT '{_level}' AS level, {_i}::BIGINT AS position, '{_kind}' AS kind, '{_cols}' AS column_names,"
                f" {_val} AS value FROM w_audited HAVING {_guard}"
            )
oracle("constraint_ladder", " UNION ALL ".join(_rows))
oracle(
    "ladder_spec_drops",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{k}({c})' AS spec, count(*) FILTER (NOT ({t})) AS dropped, count(*) AS n FROM w_audited"
        for k, c, t in [
            ("ScalarInequality", "transit_duration_days", "coalesce(transit_duration_days >= 0.01, true)"),
            ("Inequality", "date_order_capture,date_ship_last_shipment", "coalesce(date_order_capture <= date_ship_last_shipment, true)"),
            ("Inequality", "date_ship_last_shipment,date_delivery_last_shipment", "coalesce(date_ship_last_shipment <= date_delivery_last_shipment, true)"),
            ("Inequality", "date_promise_shipment,date_promise_delivery", "coalesce(date_promise_shipment <= date_promise_delivery, true)"),
            ("ScalarInequality", "capture_latency_days", "coalesce(capture_latency_days >= 0, true)"),
            ("ScalarInequality", "promised_transit_days", "coalesce(promised_transit_days >= 0, true)"),
            ("ScalarInequality", "shipment_buffer_days", "coalesce(shipment_buffer_days >= 0, true)"),
            ("ScalarInequality", "distance_km", "coalesce(distance_km >= 0, true)"),
        ]
    )
    + ")",
)
oracle(
    "deterministic_repair",
    """
    SELECT row_id, strftime(c3, '%Y-%m-%d %H:%M:%S') AS date_order_capture, strftime(s3, '%Y-%m-%d %H:%M:%S') AS date_ship_last_shipment,
      strftime(CASE WHEN date_delivery_last_shipment < s3 THEN s3 ELSE date_delivery_last_shipment END, '%Y-%m-%d %H:%M:%S') AS date_delivery_last_shipment,
      round(greatest(coalesce(capture_latency_days,0),0),9) AS capture_latency_days,
      round(greatest(coalesce(transit_duration_days,0.01),0.01),9) AS transit_duration_days,
      round(greatest(coalesce(promised_transit_days,0),0),9) AS promised_transit_days,
      round(coalesce(shipment_buffer_days,0),9) AS shipment_buffer_days, round(coalesce(sla_buffer,0),9) AS sla_buffer, delay_label
    FROM (SELECT *, CASE WHEN date_ship_last_shipment < c3 THEN c3 ELSE date_ship_last_shipment END AS s3 FROM (
      SELECT *, CASE WHEN date_order_capture < date_order_created_omni THEN date_order_created_omni ELSE date_order_capture END AS c3 FROM w_audited))
    WHERE delay_label IN (0,1,2)
    """,
)
_share = {0: 0.5442, 1: 0.3758, 2: 0.08}
oracle(
    "preflight_checks",
    """
    SELECT check_name, round(observed::DOUBLE, 4) AS observed, threshold::DOUBLE AS threshold, passed FROM (
      SELECT 'capture_before_created' AS check_name, a AS observed, 0 AS threshold, a=0 AS passed FROM t
      UNION ALL SELECT 'ship_before_capture', b, 0, b=0 FROM t
      UNION ALL SELECT 'delivery_before_ship', c, 0, c=0 FROM t
      UNION ALL SELECT 'promise_delivery_before_promise_ship', d, 0, d=0 FROM t
      UNION ALL SELECT 'label_agreement', e/n, 0.95, e/n >= 0.95 FROM t
    """.replace("FROM t", "FROM w_pre")
    + "".join(
        f" UNION ALL SELECT 'class_share_{k}', k{k}/n, {v}, abs(k{k}/n - {v}) <= 0.03 FROM w_pre" for k, v in _share.items()
    )
    + " UNION ALL SELECT 'forbidden_features', 0, 0, true)",
)
view(
    "w_pre",
    """
    SELECT count(*)::DOUBLE AS n, count(*) FILTER (date_order_capture < date_order_created_omni) AS a,
      count(*) FILTER (date_ship_last_shipment < date_order_capture) AS b, count(*) FILTER (date_delivery_last_shipment < date_ship_last_shipment) AS c,
      count(*) FILTER (date_promise_delivery < date_promise_shipment) AS d,
      count(*) FILTER (coalesce(delay_label,-1) = CASE WHEN sla_buffer IS NULL OR sla_buffer>=0 THEN 0 WHEN -sla_buffer<=2 THEN 1 ELSE 2 END) AS e,
      count(*) FILTER (delay_label=0) AS k0, count(*) FILTER (delay_label=1) AS k1, count(*) FILTER (delay_label=2) AS k2
    FROM w_audited
    """,
)
_unknown = " OR ".join(
    f"coalesce({c} NOT IN (SELECT {c} FROM w_real WHERE {c} IS NOT NULL), true)" for c in S.SANITY_CATEGORICALS
)
view(
    "w_sane",
    f"""
    SELECT *, f1 OR f2 OR f3 OR f4 OR f5 OR f6 AS flagged FROM (SELECT s.*,
      NOT coalesce(date_order_created_omni <= date_order_capture AND date_order_capture <= date_ship_last_shipment AND date_ship_last_shipment <= date_delivery_last_shipment, false) AS f1,
      coalesce(transit_duration_days<=0,false) AS f2, coalesce(capture_latency_days<0,false) AS f3,
      delay_label <> CASE WHEN {_days('date_delivery_last_shipment','date_promise_delivery')} >= 0 THEN 0 WHEN -({_days('date_delivery_last_shipment','date_promise_delivery')}) <= 2 THEN 1 ELSE 2 END AS f4,
      {_unknown} AS f5,
      coalesce(capture_latency_days < l1 OR capture_latency_days > l2, false) OR coalesce(transit_duration_days < t1 OR transit_duration_days > t2, false) AS f6
    FROM w_synth s, (SELECT quantile_cont(capture_latency_days,0.005) l1, quantile_cont(capture_latency_days,0.995) l2,
      quantile_cont(transit_duration_days,0.005) t1, quantile_cont(transit_duration_days,0.995) t2 FROM w_real))
    """,
)
_sane_names = ["temporal_order_violation", "non_positive_transit_duration", "negative_capture_latency", "label_sla_inconsistency", "unknown_categorical_value", "extreme_numeric_outlier", "any_check"]
oracle(
    "sanity_checks",
    " UNION ALL ".join(
        f"SELECT '{n}' AS check_name, count(*) FILTER ({f}) AS hits, count(*) AS row_count, round(count(*) FILTER ({f})*100.0::DOUBLE/count(*),4) AS rate_pct FROM w_sane"
        for n, f in zip(_sane_names, ["f1", "f2", "f3", "f4", "f5", "f6", "flagged"])
    ),
)
_show = ", ".join(
    f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" if c.startswith("date_") else (f"round({c},9) AS {c}" if c in S.DURATION_COLUMNS else c)
    for c in [*S.DATE_COLUMNS, *S.SANITY_CATEGORICALS, *S.DURATION_COLUMNS, S.LABEL]
)
oracle("sanity_flagged_examples", f"SELECT row_id, {_show} FROM w_sane WHERE flagged ORDER BY row_id LIMIT 10")
oracle("sanity_sample", f"SELECT row_id, {_show} FROM w_synth ORDER BY md5(concat_ws('|', row_id, 'sanity', '42')), row_id LIMIT 25")
oracle("record_export", f"SELECT row_id, {_show} FROM w_real")
_rows = []
from itertools import combinations as _comb, product as _prod  # noqa: E402

for _n in (1, 2, 3):
    for _names in _comb([c for c in S.DURATION_COLUMNS if c != S.SLA], _n):
        for _signs in _prod((1, -1), repeat=_n):
            _text = "".join(f"{'+' if s > 0 else '-'}{c}" for c, s in zip(_names, _signs))
            _sum = " + ".join(f"{c} * {s}" for c, s in zip(_names, _signs))
            _rows.append(f"SELECT '{_text}' AS identity, max(abs(sla_buffer - ({_sum}))) AS r, count(sla_buffer - ({_sum})) AS n FROM w_base")
oracle(
    "leakage_identities",
    "SELECT identity, round(r, 6) AS max_abs_residual, r < 1e-6 AS leaks FROM (" + " UNION ALL ".join(_rows) + ")",
)
oracle(
    "linear_identities",
    "SELECT identity, round(r, 6) AS max_abs_residual, n FROM (" + " UNION ALL ".join(_rows) + ") WHERE r < 1e-6",
)

# ---- distributions -------------------------------------------------------------------
oracle("label_distribution", "SELECT delay_label AS label, count(*) AS n, round(count(*)::DOUBLE/(SELECT count(*) FROM w_audited),4) AS share FROM w_audited GROUP BY 1")
oracle(
    "label_drift",
    " UNION ALL ".join(
        f"SELECT {k}::INTEGER AS label, round(count(*) FILTER (delay_label={k})/count(*)::DOUBLE,4) AS observed, {v}::DOUBLE AS expected,"
        f" abs(count(*) FILTER (delay_label={k})/count(*)::DOUBLE - {v}) <= 0.03 AS within FROM w_audited"
        for k, v in _share.items()
    ),
)
oracle("combo_cardinality", "SELECT count(*) AS pairs, count(*) <= 200 AS within_limit FROM (SELECT DISTINCT last_scac, carrier_service_code FROM w_base)")


def _unpivot(source: str, columns=None, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS field, {c} AS value{extra} FROM {source} WHERE {c} IS NOT NULL"
        for c in (columns or S.DURATION_COLUMNS)
    )


view("w_values", _unpivot("w_base"))
view("w_synth_values", _unpivot("w_synth"))
oracle(
    "duration_quantiles",
    " UNION ALL ".join(
        f"SELECT field, {p}::DOUBLE AS prob, round(quantile_cont(value, {p}), 9) AS quantile FROM w_values GROUP BY field"
        for p in (0.005, 0.05, 0.25, 0.5, 0.75, 0.95, 0.995)
    ),
)


def _bin(n: int) -> str:
    g = f"least(floor((value-lo)/((hi-lo)/{n}.0::DOUBLE)), {n-1})"
    w = f"((hi-lo)/{n}.0::DOUBLE)"
    return (
        f"({g} - CASE WHEN value < lo + {g}*{w} THEN 1 ELSE 0 END"
        f" + CASE WHEN value >= lo + ({g}+1)*{w} AND {g} < {n-1} THEN 1 ELSE 0 END)::INTEGER"
    )


oracle(
    "duration_histogram",
    f"""
    SELECT r.field, k::INTEGER AS bin, round(lo + k*((hi-lo)/30.0::DOUBLE), 6) AS low_edge, round(lo + (k+1)*((hi-lo)/30.0::DOUBLE), 6) AS high_edge, coalesce(n, 0) AS n
    FROM (SELECT field, min(value) lo, max(value) hi FROM w_values GROUP BY 1) r, range(30) t(k)
    LEFT JOIN (SELECT field, {_bin(30)} AS b, count(*) AS n FROM w_values JOIN (SELECT field, min(value) lo, max(value) hi FROM w_values GROUP BY 1) USING (field) GROUP BY 1, 2) c
      ON c.field = r.field AND c.b = k
    """.replace("r, range(30) t(k)\n", "r CROSS JOIN range(30) t(k)\n"),
)
_SUM = "count(*) AS n, round(avg(value),6) AS mean, round(min(value),6) AS min, " + ", ".join(
    f"round(quantile_cont(value,{p}),6) AS {n}" for n, p in [("p5", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95)]
) + ", round(max(value),6) AS max"
oracle("distance_summary", f"SELECT field, {_SUM} FROM w_synth_values GROUP BY 1")
_corr_rows = [
    (a, b) for i, a in enumerate(S.DURATION_COLUMNS) for b in S.DURATION_COLUMNS[i + 1 :]
]
view("w_corr", " UNION ALL ".join(f"SELECT '{a}' AS left_field, '{b}' AS right_field, corr({a},{b}) AS corr FROM w_base" for a, b in _corr_rows))
oracle("correlation_matrix", "SELECT left_field, right_field, round(corr, 6) AS corr FROM w_corr")
oracle("top_features", "SELECT left_field AS feature, round(abs(corr),6) AS score FROM w_corr WHERE right_field='sla_buffer' AND round(abs(corr),6) >= 0.01 ORDER BY 2 DESC, 1 LIMIT 2")
oracle(
    "average_rank",
    " UNION ALL ".join(
        f"SELECT row_id, '{c}' AS field, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0::DOUBLE AS avg_rank FROM w_base WHERE {c} IS NOT NULL"
        for c in ("transit_duration_days", "sla_buffer")
    ),
)

# ---- randomness, samples, folds -------------------------------------------------------
oracle("hash_uniform", f"SELECT row_id, {u('row_id','probe')} AS u, round({gauss('row_id','probe','42',1)},6) AS z FROM w_base")


def _poly(cs, x: str) -> str:
    out = f"{cs[0]!r}::DOUBLE"
    for c in cs[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def ppf(p: str) -> str:
    from waybill.functions import normal as N

    r = f"(({p}-0.5::DOUBLE)*({p}-0.5::DOUBLE))"
    mid = f"{_poly(N.INVERSE_A, r)}*({p}-0.5::DOUBLE)/({_poly(N.INVERSE_B, r)}*{r}+1.0::DOUBLE)"

    def tail(m: str) -> str:
        q = f"sqrt(-2.0::DOUBLE*ln({m}))"
        return f"{_poly(N.INVERSE_C, q)}/({_poly(N.INVERSE_D, q)}*{q}+1.0::DOUBLE)"

    return f"(CASE WHEN {p} < 0.02425 THEN {tail(p)} WHEN {p} > 0.97575 THEN -({tail(f'(1.0::DOUBLE-{p})')}) ELSE {mid} END)"


def cdf(x: str) -> str:
    from waybill.functions import normal as N

    t = f"(1.0::DOUBLE/(1.0::DOUBLE+{N.CDF_P!r}::DOUBLE*abs({x})))"
    tail = f"({N.INV_SQRT_2PI!r}::DOUBLE*exp(-0.5::DOUBLE*{x}*{x})*{_poly(list(reversed(N.CDF_B)), t)}*{t})"
    return f"(CASE WHEN {x} >= 0 THEN 1.0::DOUBLE-{tail} ELSE {tail} END)"


oracle("normal_functions", f"SELECT row_id, round(z,6) AS z, round({cdf('z')},6) AS p FROM (SELECT row_id, {ppf('u')} AS z FROM (SELECT row_id, {u('row_id','probe')} AS u FROM w_base))")


def _order(salt: str, key: str = "row_id") -> str:
    return f"ORDER BY md5(concat_ws('|', {key}, '{salt}', '42')), {key}"


oracle("hash_sample", f"SELECT row_id FROM w_base {_order('sample')} LIMIT 1000")
view(
    "w_members",
    f"""
    SELECT *, rank_ <= round_even(n_*0.5::DOUBLE, 0)::BIGINT AS is_member FROM (
      SELECT *, row_number() OVER (PARTITION BY delay_label {_order('member')}) AS rank_, count(*) OVER (PARTITION BY delay_label) AS n_ FROM w_real)
    """,
)
oracle("member_split", "SELECT row_id, delay_label, is_member FROM w_members")
oracle(
    "stratified_cap",
    f"""
    SELECT row_id, delay_label FROM (SELECT row_id, delay_label, row_number() OVER (PARTITION BY delay_label {_order('cap')}) AS r,
      count(*) OVER (PARTITION BY delay_label) AS n, count(*) OVER () AS total FROM w_real)
    WHERE r <= CASE WHEN total <= 20000 THEN n ELSE floor(20000.0::DOUBLE*n/total) END
    """,
)
oracle("stratified_folds", f"SELECT row_id, delay_label, ((row_number() OVER (PARTITION BY delay_label {_order('fold')}) - 1) % 5)::INTEGER AS fold FROM w_real")
view("w_timed", "SELECT row_id, row_number() OVER (ORDER BY date_order_created_omni NULLS LAST, md5(row_id), row_id) AS r, count(*) OVER () AS n FROM w_base")
oracle("time_folds", "SELECT row_id, greatest(floor((r - 1 - (n - 5*(n//6)))/(n//6)::DOUBLE) + 1, 0)::INTEGER AS fold FROM w_timed")
oracle("temporal_holdout", "SELECT row_id, r > n - least(greatest(round_even(n*0.2::DOUBLE,0)::BIGINT, 1), n-1) AS is_test FROM w_timed")

# ---- fidelity ---------------------------------------------------------------------------
view("w_both", _unpivot("w_real", None, ", 0 AS side") + " UNION ALL " + _unpivot("w_synth", None, ", 1 AS side"))
view("w_ecdf", """
    SELECT field, value, lead(value) OVER (PARTITION BY field ORDER BY value) AS nxt,
      abs(sum(r) OVER (PARTITION BY field ORDER BY value)/(sum(r) OVER (PARTITION BY field))::DOUBLE
        - sum(s) OVER (PARTITION BY field ORDER BY value)/(sum(s) OVER (PARTITION BY field))::DOUBLE) AS gap
    FROM (SELECT field, value, count(*) FILTER (side=0) AS r, count(*) FILTER (side=1) AS s FROM w_both GROUP BY 1, 2)
    """)
view("w_ks", "SELECT field, round(1 - max(gap), 4) AS ks, round(sum(gap*(nxt-value)), 4) AS wasserstein FROM w_ecdf GROUP BY 1")
oracle("fidelity_ks", "SELECT field, ks FROM w_ks")
oracle("fidelity_wasserstein", "SELECT field, wasserstein FROM w_ks")
view("w_bins", f"""
    SELECT field, k, coalesce(r,0) + 1e-12::DOUBLE AS r, coalesce(s,0) + 1e-12::DOUBLE AS s FROM
      (SELECT DISTINCT field FROM w_both) CROSS JOIN range(30) t(k)
      LEFT JOIN (SELECT field, {_bin(30)} AS k, count(*) FILTER (side=0) AS r, count(*) FILTER (side=1) AS s
        FROM w_both JOIN (SELECT field, min(value) lo, max(value) hi FROM w_both GROUP BY 1) USING (field) GROUP BY 1, 2) USING (field, k)
    """)
view("w_js", """
    SELECT field, round((sum(p*ln(p/((p+q)/2))) + sum(q*ln(q/((p+q)/2))))/2, 4) AS js FROM (
      SELECT field, r/sum(r) OVER (PARTITION BY field) AS p, s/sum(s) OVER (PARTITION BY field) AS q FROM w_bins) GROUP BY 1
    """)
oracle("fidelity_js", "SELECT field, js FROM w_js")


def _cat_union(fields, source: str, side: int) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS field, coalesce({c}::VARCHAR, '<null>') AS value, {side} AS side FROM {source}" for c in fields
    )


view("w_cats", _cat_union([*S.CATEGORICAL_COLUMNS, S.LABEL], "w_real", 0) + " UNION ALL " + _cat_union([*S.CATEGORICAL_COLUMNS, S.LABEL], "w_synth", 1))
view("w_cat_counts", "SELECT field, value, count(*) FILTER (side=0) AS r, count(*) FILTER (side=1) AS s FROM w_cats GROUP BY 1, 2")
view("w_tvd", "SELECT field, round(1 - sum(abs(r/n_r - s/n_s))/2, 4) AS tvd FROM (SELECT *, (sum(r) OVER (PARTITION BY field))::DOUBLE AS n_r, (sum(s) OVER (PARTITION BY field))::DOUBLE AS n_s FROM w_cat_counts) GROUP BY 1")
_fid = "field IN (" + ", ".join(f"'{c}'" for c in S.FIDELITY_CATEGORICALS) + ")"
oracle("fidelity_tvd", f"SELECT field, tvd FROM w_tvd WHERE {_fid}")
view("w_fid", f"""
    SELECT 'ks' AS metric, field, ks AS value FROM w_ks UNION ALL SELECT 'wasserstein', field, wasserstein FROM w_ks
    UNION ALL SELECT 'js', field, js FROM w_js UNION ALL SELECT 'tvd', field, tvd FROM w_tvd WHERE {_fid}
    """)
oracle("fidelity_report", "SELECT * FROM w_fid UNION ALL SELECT metric, 'mean', round(avg(value),4) FROM w_fid GROUP BY metric")
view("w_shapes", "SELECT field, 'KSComplement' AS kind, ks AS score FROM w_ks UNION ALL SELECT 'distance_km', 'KSComplement', 1.0::DOUBLE UNION ALL SELECT field, 'TVComplement', tvd FROM w_tvd")
_instant = {side: " UNION ALL ".join(f"SELECT '{c}' AS field, epoch_us({c})::DOUBLE AS value, {side} AS side FROM {source} WHERE {c} IS NOT NULL" for c in S.DATE_COLUMNS) for side, source in enumerate(("w_real", "w_synth"))}
oracle("column_shapes", f"""
    SELECT * FROM w_shapes UNION ALL SELECT field, 'KSComplement', round(1 - max(gap), 4) FROM (
      SELECT field, abs(sum(r) OVER (PARTITION BY field ORDER BY value)/(sum(r) OVER (PARTITION BY field))::DOUBLE
          - sum(s) OVER (PARTITION BY field ORDER BY value)/(sum(s) OVER (PARTITION BY field))::DOUBLE) AS gap
      FROM (SELECT field, value, count(*) FILTER (side=0) AS r, count(*) FILTER (side=1) AS s FROM ({_instant[0]} UNION ALL {_instant[1]}) GROUP BY 1, 2)) GROUP BY 1
    """)
_quality_num = [*S.DURATION_COLUMNS, S.DISTANCE]
_quality_cat = [*S.CATEGORICAL_COLUMNS, S.LABEL]
_trend = [
    f"SELECT '{a}' AS left_field, '{b}' AS right_field, 'CorrelationSimilarity' AS kind, "
    + (f"round(1 - abs((SELECT corr({a},{b}) FROM w_real) - (SELECT corr({a},{b}) FROM w_synth))/2, 4)" if b != S.DISTANCE else "NULL::DOUBLE")
    + " AS score"
    for i, a in enumerate(_quality_num) for b in _quality_num[i + 1 :]
]
for _i, _a in enumerate(_quality_cat):
    for _b in _quality_cat[_i + 1 :]:
        _trend.append(
            f"SELECT '{_a}', '{_b}', 'ContingencySimilarity', round(1 - sum(abs(r/n_r - s/n_s))/2, 4) FROM ("
            f"SELECT r, s, (sum(r) OVER ())::DOUBLE AS n_r, (sum(s) OVER ())::DOUBLE AS n_s FROM ("
            f"SELECT count(*) FILTER (side=0) AS r, count(*) FILTER (side=1) AS s FROM w_joined GROUP BY coalesce({_a}::VARCHAR,'<null>'), coalesce({_b}::VARCHAR,'<null>')))"
        )
_both_cols = ", ".join(_quality_cat)
view("w_joined", f"SELECT {_both_cols}, 0 AS side FROM w_real UNION ALL SELECT {_both_cols}, 1 AS side FROM w_synth")
view("w_trends", " UNION ALL ".join(_trend))
oracle("column_pair_trends", "SELECT * FROM w_trends")
oracle(
    "adherence",
    " UNION ALL ".join(
        f"SELECT '{c}' AS field, 'RangeAdherence' AS kind, round(avg(({c} BETWEEN lo AND hi)::INTEGER), 4) AS score FROM w_synth, (SELECT min({c}) lo, max({c}) hi FROM w_real)"
        for c in _quality_num
    )
    + " UNION ALL SELECT field, 'CategoryAdherence', round(sum(CASE WHEN r>0 THEN s ELSE 0 END)/sum(s)::DOUBLE, 4) FROM w_cat_counts GROUP BY field",
)
oracle(
    "quality_overall",
    """
    SELECT 'column_shapes' AS property, round(a,4) AS score, 'completed' AS status FROM (SELECT avg(score) AS a FROM w_shapes)
    UNION ALL SELECT 'column_pair_trends', round(a,4), 'completed' FROM (SELECT avg(score) AS a FROM w_trends)
    UNION ALL SELECT 'overall', round((a+b)/2,4), 'completed' FROM (SELECT avg(score) AS a FROM w_shapes), (SELECT avg(score) AS b FROM w_trends)
    """,
)

# ---- utility -----------------------------------------------------------------------------
oracle(
    "confusion_matrix",
    "SELECT t::INTEGER AS y_true, " + ", ".join(f"(SELECT count(*) FROM w_pred WHERE y_true=t AND y_pred={p}) AS pred_{p}" for p in (0, 1, 2)) + " FROM range(3) x(t)",
)
view("w_fold", """
    SELECT fold, round(1 - (n - hits + 2*missed)::DOUBLE/(n + 2*severe), 4) AS business_utility,
      round(CASE WHEN severe>0 THEN (severe-missed)::DOUBLE/severe ELSE 0 END, 4) AS label2_recall FROM (
      SELECT fold, count(*) AS n, count(*) FILTER (y_true=y_pred) AS hits, count(*) FILTER (y_true=2) AS severe,
        count(*) FILTER (y_true=2 AND y_pred<>2) AS missed FROM w_pred GROUP BY 1)
    """)
oracle("business_utility", "SELECT fold, business_utility FROM w_fold")
oracle("class2_recall", "SELECT fold, label2_recall FROM w_fold")
view("w_f1", """
    SELECT fold, round(sum(2.0::DOUBLE*tp/(sup+giv)*sup)/sum(sup), 4) AS weighted_f1 FROM (
      SELECT fold, t, count(*) FILTER (y_true=t AND y_pred=t) AS tp, count(*) FILTER (y_true=t) AS sup, count(*) FILTER (y_pred=t) AS giv
      FROM w_pred, range(3) x(t) GROUP BY 1, 2) GROUP BY 1
    """)
oracle("weighted_f1", "SELECT * FROM w_f1")
_ece_bin = " + ".join(f"(conf >= {i * 0.1!r}::DOUBLE)::INTEGER" for i in range(1, 10))
oracle(
    "calibration_error",
    f"""
    SELECT fold, round(sum(abs(acc-mc)*n)/sum(n), 4) AS ece FROM (
      SELECT fold, {_ece_bin} AS b, count(*) AS n, avg((list_position(proba, conf)-1 = y_true)::INTEGER) AS acc, avg(conf) AS mc
      FROM (SELECT *, list_max(proba) AS conf FROM w_pred) GROUP BY 1, 2) GROUP BY 1
    """,
)
oracle(
    "brier_score",
    "SELECT fold, round((" + " + ".join(f"avg(((y_true={c})::INTEGER - proba[{c+1}])*((y_true={c})::INTEGER - proba[{c+1}]))" for c in (0, 1, 2)) + ")/3, 4) AS brier FROM w_pred GROUP BY 1",
)
oracle(
    "fold_summary",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(avg({m}),4) AS mean, round(stddev_pop({m}),4) AS std FROM w_fold JOIN w_f1 USING (fold)"
        for m in ("weighted_f1", "business_utility", "label2_recall")
    ),
)
oracle(
    "utility_vs_baseline",
    "SELECT fold, weighted_f1, business_utility, label2_recall, round(0.95::DOUBLE - weighted_f1,4) AS f1_gap_vs_trtr, round(business_utility/0.9::DOUBLE,4) AS bus_ratio_vs_trtr, 0.0::DOUBLE AS l2_recall_pres_ratio FROM w_fold JOIN w_f1 USING (fold)",
)

# ---- tests and metric tables ----------------------------------------------------------------
def _ci(value: str, by: str, source: str, n: str = "n") -> str:
    return f"""
    SELECT {by}, round(m,4) AS mean, round(s,4) AS std, round(m-1.96::DOUBLE*s/sqrt(c),4) AS ci95_low, round(m+1.96::DOUBLE*s/sqrt(c),4) AS ci95_high, c AS {n}
    FROM (SELECT {by}, avg({value}) AS m, coalesce(stddev_samp({value}),0) AS s, count({value}) AS c FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL)
    """


oracle("confidence_interval", _ci("transit_duration_days", "last_scac", "w_base"))
view("w_long", """
    SELECT architecture, level, seed, unnest(['business_utility','dcr_mean','cvr']) AS metric, unnest([a,b,c]) AS value FROM (
      SELECT carrier_service_code AS architecture, ['none','temporal','moderate','strict','strict+reject'][h%5+1] AS level,
        year(date_order_created_omni)::INTEGER AS seed, round(avg(promised_transit_days),6) AS a, round(avg(transit_duration_days),6) AS b,
        round(count(*) FILTER (transit_duration_days<=0)*100.0::DOUBLE/count(*),6) AS c FROM w_base GROUP BY 1,2,3)
    """)
_pos = "(list_position(['none','temporal','moderate','strict','strict+reject'], {0})-1)::INTEGER"
view("w_sweep", _ci("value", "architecture, level, metric", "w_long", "n_seeds"))
oracle("sweep_summary", "SELECT * FROM w_sweep")
oracle(
    "frontier_table",
    f"SELECT architecture, level, {_pos.format('level')} AS position, max(mean) FILTER (metric='dcr_mean') AS dcr_mean, max(mean) FILTER (metric='business_utility') AS business_utility FROM w_sweep GROUP BY 1,2,3",
)
view("w_level_pairs", f"""
    SELECT x.architecture, x.metric, x.seed, x.level AS level_a, y.level AS level_b, x.value AS a, y.value AS b,
      {_pos.format('y.level')} - {_pos.format('x.level')} = 1 AS adjacent
    FROM w_long x JOIN w_long y ON x.architecture=y.architecture AND x.metric=y.metric AND x.seed=y.seed AND {_pos.format('x.level')} < {_pos.format('y.level')}
    """)
oracle(
    "paired_t",
    "SELECT architecture, level_a, level_b, count(*) AS n, round(CASE WHEN stddev_samp(a-b)>0 THEN avg(a-b)/(stddev_samp(a-b)/sqrt(count(*))) END, 4) AS t_stat FROM w_level_pairs WHERE metric='business_utility' AND a IS NOT NULL AND b IS NOT NULL GROUP BY 1,2,3",
)
oracle(
    "wilcoxon_w",
    """
    SELECT architecture, level_a, level_b, count(*) AS n_nonzero,
      least(coalesce(sum(r) FILTER (d>0),0), coalesce(sum(r) FILTER (d<0),0)) AS w_stat, sum((p*p-1)::DOUBLE) AS tie_term FROM (
      SELECT *, rank() OVER (PARTITION BY architecture, level_a, level_b ORDER BY abs(d)) + (p-1)/2.0::DOUBLE AS r FROM (
        SELECT *, count(*) OVER (PARTITION BY architecture, level_a, level_b, abs(d)) AS p FROM (
          SELECT *, a-b AS d FROM w_level_pairs WHERE metric='business_utility') WHERE d <> 0)) GROUP BY 1,2,3
    """,
)
view("w_lsig", """
    SELECT architecture, 'dcr_mean' AS metric, level_a, level_b, adjacent, round(avg(a),4) AS mean_a, round(avg(b),4) AS mean_b,
      CASE WHEN stddev_samp(a-b)>0 THEN avg(a-b)/(stddev_samp(a-b)/sqrt(count(*))) END AS t, count(*) - 1 AS df
    FROM w_level_pairs WHERE metric='dcr_mean' GROUP BY 1,2,3,4,5 HAVING count(*)>=2 AND stddev_samp(a)+stddev_samp(b)>0
    """)
# Mass between -t and t, from the series of the t distribution with gamma functions.
_T_P = """CASE WHEN t IS NOT NULL THEN 1 - CASE WHEN df % 2 = 0 THEN
      sqrt(t*t/(df+t*t)) * list_sum(list_transform(range(df//2), lambda k: exp(lgamma(k+0.5)-lgamma(0.5)-lgamma(k+1)) * pow(df/(df+t*t), k)))
    ELSE 2/pi() * (atan(abs(t)/sqrt(df)) + sqrt(t*t/(df+t*t)) * sqrt(df/(df+t*t)) *
      coalesce(list_sum(list_transform(range((df-1)//2), lambda k: exp(lgamma(k+1)+lgamma(1.5)-lgamma(k+1.5)) * pow(df/(df+t*t), k))), 0)) END END"""
oracle("level_significance", f"SELECT * EXCLUDE (t, df), round(t, 3) AS t_stat, round({_T_P}, 4) AS p_value FROM w_lsig")
view("w_years", """
    SELECT a, b, a - b AS d, rank() OVER (ORDER BY abs(a - b)) + (count(*) OVER (PARTITION BY abs(a - b)) - 1) / 2.0::DOUBLE AS r FROM (
      SELECT avg(promised_transit_days) AS a, avg(transit_duration_days) AS b FROM w_base GROUP BY year(date_order_created_omni))
    """)
oracle("significance_test", f"""
    SELECT round(t, 4) AS paired_t_stat, round({_T_P}, 4) AS paired_t_pvalue, round(w, 4) AS wilcoxon_stat, round(least(1, 2.0::DOUBLE * (
        SELECT count(*) FROM range((1 << n)::BIGINT) p(signs)
        WHERE list_sum(list_transform(range(n), lambda i: CASE WHEN (signs >> i) & 1 = 1 THEN i + 1 ELSE 0 END)) <= w) / (1 << n)), 4) AS wilcoxon_pvalue,
      coalesce({_T_P} < 0.05, false) AS significant_005
    FROM (SELECT avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, count(*) - 1 AS df, count(*) AS n,
      least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w FROM w_years)
    """)
oracle("metric_union", "SELECT architecture, level, metric, mean, NULL::DOUBLE AS t_stat FROM w_sweep UNION ALL SELECT architecture, level_a, metric, NULL, round(t, 3) FROM w_lsig")
view("w_wide", """
    SELECT last_shipnode AS model, round(0.8+0.2*s0,6) AS ks_mean, round(0.7+0.3*s1,6) AS tvd_mean, round(s2/3,6) AS js_mean,
      round(t/10,6) AS wasserstein_mean, round(t/5,6) AS dcr_mean, round(t/50,6) AS dcr_min, round(t/20,6) AS dcr_p5, round(0.4+s1/2,6) AS nnaa,
      round(1-s1/2,6) AS weighted_f1, round(1-s2,6) AS business_utility, round(s0,6) AS label2_recall, round(s2/3,6) AS f1_gap_vs_trtr,
      round(1-s2/2,6) AS bus_ratio_vs_trtr, round(s2/2,6) AS ece, round(s1/4,6) AS brier_score_mean, round(1-s2*0.6,6) AS transfer_25_f1,
      1.0::DOUBLE AS trtr_f1, round(bad*100.0::DOUBLE/n,6) AS integrity_violation_pct, round(bad*100.0::DOUBLE/n,6) AS hard_violation_pct
    FROM (SELECT last_shipnode, count(*) FILTER (delay_label=0)/count(*)::DOUBLE AS s0, count(*) FILTER (delay_label=1)/count(*)::DOUBLE AS s1,
      count(*) FILTER (delay_label=2)/count(*)::DOUBLE AS s2, avg(transit_duration_days) AS t, count(*) FILTER (transit_duration_days<=0) AS bad, count(*) AS n
      FROM w_real GROUP BY 1)
    """)
view("w_scores", """
    SELECT *, (fid+uti+pri+inte)/4 AS mean_score FROM (SELECT *,
      greatest(0,least(1, 0.5*ks_mean+0.3*tvd_mean+0.2*greatest(0,1-least(js_mean,1)))) AS fid,
      greatest(0,least(1, 0.45*weighted_f1+0.45*business_utility+0.1*label2_recall)) AS uti,
      greatest(0,least(1, 0.5*dcr_mean/(1+dcr_mean)+0.5*greatest(0,1-abs(nnaa-0.6)/0.25))) AS pri,
      greatest(0,least(1, 1-integrity_violation_pct/100)) AS inte FROM w_wide)
    """)
oracle("pillar_scores", "SELECT model, round(fid,4) AS fidelity_score, round(uti,4) AS utility_score, round(pri,4) AS privacy_score, round(inte,4) AS integrity_score, round(mean_score,4) AS mean_score FROM w_scores")
oracle(
    "trial_selection",
    """
    SELECT count(*) AS n_trials, count(*) FILTER (ok) AS n_feasible, (arg_min(model, (-s, model)) FILTER (ok)) AS best_trial,
      round(max(s) FILTER (ok), 6) AS best_score, CASE WHEN count(*) FILTER (ok) > 0 THEN 'ok' ELSE 'no_feasible_trials' END AS status
    FROM (SELECT model, ks_mean >= 0.9 AND js_mean <= 0.06 AS ok, round(mean_score, 9) AS s FROM w_scores)
    """,
)
view("w_verdicts", """
    SELECT *, p AND u_ AND f AND i AS o FROM (SELECT *, coalesce(dcr_mean>0 AND nnaa BETWEEN 0.5 AND 0.7,false) AS p,
      coalesce(f1_gap_vs_trtr<=0.05 AND bus_ratio_vs_trtr>=0.9 AND transfer_25_f1>=0.9*trtr_f1,false) AS u_,
      coalesce(ks_mean>=0.9 AND js_mean<=0.05,false) AS f, coalesce(hard_violation_pct=0,false) AS i FROM w_wide)
    """)
oracle("pillar_verdicts", "SELECT model, p AS privacy_ok, u_ AS utility_ok, f AS fidelity_ok, i AS integrity_ok, o AS overall_ok FROM w_verdicts")
oracle(
    "verdict_counts",
    """
    SELECT count(*) AS models, count(*) FILTER (p) AS privacy_passes, count(*) FILTER (u_) AS utility_passes, count(*) FILTER (f) AS fidelity_passes,
      count(*) FILTER (i) AS integrity_passes, count(*) FILTER (o) AS overall_passes,
      (SELECT model FROM w_verdicts ORDER BY f1_gap_vs_trtr, model LIMIT 1) AS smallest_gap_model,
      (SELECT model FROM w_verdicts ORDER BY js_mean, model LIMIT 1) AS closest_model FROM w_verdicts
    """,
)
_metrics = ["weighted_f1", "f1_gap_vs_trtr", "business_utility", "bus_ratio_vs_trtr", "label2_recall", "ece", "brier_score_mean", "ks_mean", "wasserstein_mean", "js_mean", "tvd_mean", "dcr_mean", "dcr_min", "dcr_p5", "nnaa"]
oracle("results_summary", " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m} AS value FROM w_wide" for m in _metrics))
oracle(
    "strictness_diagnostics",
    f"""
    SELECT architecture, metric, coalesce(max(d) <= 0, true) AS never_rises, coalesce(min(d) >= 0, true) AS never_falls,
      round(arg_max(mean, p) - arg_min(mean, p), 4) AS change FROM (
      SELECT architecture, metric, mean, p, mean - lag(mean) OVER (PARTITION BY architecture, metric ORDER BY p) AS d FROM (
        SELECT *, {_pos.format('level')} AS p FROM w_sweep)) GROUP BY 1, 2
    """,
)

# ---- privacy -------------------------------------------------------------------------------
def _scaled(name: str, source: str, stats: str) -> None:
    view(
        name,
        "SELECT row_id, "
        + ", ".join(f"(coalesce(t.{c},0) - m.{c}_m)/m.{c}_s AS z{i}" for i, c in enumerate(S.DURATION_COLUMNS))
        + f" FROM {source} t, {stats} m",
    )


def _stats_view(name: str, source: str) -> None:
    view(
        name,
        "SELECT "
        + ", ".join(
            f"avg(coalesce({c},0)) AS {c}_m, CASE WHEN stddev_pop(coalesce({c},0))=0 THEN 1 ELSE stddev_pop(coalesce({c},0)) END AS {c}_s"
            for c in S.DURATION_COLUMNS
        )
        + f" FROM {source}",
    )


_dist = "+".join(f"(q.z{i}-r.z{i})*(q.z{i}-r.z{i})" for i in range(5))
_cell = "concat_ws('|', " + ", ".join(f"floor(z{i})" for i in range(5)) + ")"


def nearest(name: str, queries: str, refs: str, key: str = "row_id") -> None:
    """Exact nearest distance: a bound from the query's own cell, then a range join."""
    view(f"{name}_q", f"SELECT *, {_cell} AS cell FROM {queries}")
    view(f"{name}_r", f"SELECT *, {_cell} AS cell FROM {refs}")
    view(
        f"{name}_b",
        f"SELECT q.*, coalesce(b.d2, 'inf'::DOUBLE) AS d2, coalesce(sqrt(b.d2) + 1e-9, 1e6) AS b FROM {name}_q q LEFT JOIN"
        f" (SELECT q.{key}, min({_dist}) AS d2 FROM {name}_q q JOIN {name}_r r USING (cell) GROUP BY 1) b ON b.{key} = q.{key}",
    )
    view(
        name,
        f"SELECT {key}, sqrt(min(d)) AS distance FROM (SELECT q.{key}, {_dist} AS d FROM {name}_b q JOIN {name}_r r"
        f" ON r.z4 >= q.z4 - q.b AND r.z4 <= q.z4 + q.b WHERE abs(r.z1 - q.z1) <= q.b UNION ALL SELECT {key}, d2 FROM {name}_b) GROUP BY 1",
    )


_stats_view("w_st_real", "w_real")
_scaled("w_z_real", "w_real", "w_st_real")
_scaled("w_z_synth", "w_synth", "w_st_real")
nearest("w_nn_dcr", "w_z_synth", "w_z_real")
oracle("dcr_exact", "SELECT row_id, round(distance, 6) AS distance FROM w_nn_dcr")
oracle("dcr", "SELECT round(round(avg(distance),6),4) AS dcr_mean, round(round(min(distance),6),4) AS dcr_min, round(round(quantile_cont(distance,0.05),6),4) AS dcr_p5, count(*) AS n FROM w_nn_dcr")
view("w_nn_marks", f"SELECT *, row_number() OVER ({_order('nnaa')}) > floor(count(*) OVER ()*0.8::DOUBLE) AS is_test FROM w_z_synth")
view("w_nn_test", "SELECT * FROM w_nn_marks WHERE is_test")
view("w_nn_train", "SELECT * FROM w_nn_marks WHERE NOT is_test")
nearest("w_nn_a", "w_nn_test", "w_z_real")
nearest("w_nn_s", "w_nn_test", "w_nn_train")
view("w_nnaa", "SELECT row_id, a.distance AS d_real, s.distance AS d_synth FROM w_nn_a a JOIN w_nn_s s USING (row_id)")
oracle("nnaa", "SELECT round(avg((d_real < d_synth)::INTEGER), 4) AS nnaa, count(*) AS n FROM w_nnaa")
view("w_three", "SELECT 'dcr' AS field, distance AS value FROM w_nn_dcr UNION ALL SELECT 'd_real', d_real FROM w_nnaa UNION ALL SELECT 'd_synth', d_synth FROM w_nnaa")
oracle("privacy_distributions", f"SELECT field, {_SUM} FROM w_three GROUP BY 1")
view("w_hist", "SELECT field, round(value, 9) AS v FROM w_three WHERE value IS NOT NULL")
view("w_hist_ends", "SELECT field, min(v) AS lo, max(v) AS hi FROM w_hist GROUP BY 1")
view(
    "w_hist_range",
    "SELECT field, CASE WHEN lo = hi THEN lo - 0.5::DOUBLE ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5::DOUBLE ELSE hi END AS hi FROM w_hist_ends",
)
view("w_hist_bins", "SELECT field, lo, (hi - lo)/20.0::DOUBLE AS w, i::INTEGER AS bin FROM w_hist_range, range(20) t(i)")
oracle(
    "privacy_histograms",
    """
    SELECT b.field, bin, round(lo + bin*w, 6) AS low_edge, round(lo + (bin + 1)*w, 6) AS high_edge, count(v.v) AS n
    FROM w_hist_bins b LEFT JOIN w_hist v ON v.field = b.field AND v.v >= lo + bin*w AND (bin = 19 OR v.v < lo + (bin + 1)*w)
    GROUP BY b.field, bin, lo, w
    """,
)
view("w_in", "SELECT * FROM w_members WHERE is_member")
_stats_view("w_st_in", "w_in")
view("w_made", "SELECT * FROM w_synth WHERE row_id IN (SELECT row_id FROM w_in)")
_scaled("w_z_made", "w_made", "w_st_in")
_scaled("w_z_all", "w_members", "w_st_in")
view("w_mia_q", "SELECT z.*, is_member FROM w_z_all z JOIN (SELECT row_id, is_member FROM w_members) USING (row_id)")
nearest("w_nn_mia", "w_mia_q", "w_z_made")
view("w_mia", "SELECT row_id, is_member, -distance AS score FROM w_nn_mia JOIN (SELECT row_id, is_member FROM w_mia_q) USING (row_id)")
oracle("mia_scores", "SELECT row_id, is_member, round(score, 6) AS score FROM w_mia")
oracle(
    "mia_auc",
    """
    SELECT round((sum(r) FILTER (is_member) - p*(p+1)/2)/(p*n), 4) AS mia_auc FROM (
      SELECT is_member, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1)/2.0::DOUBLE AS r,
        (count(*) FILTER (is_member) OVER ())::DOUBLE AS p, (count(*) FILTER (NOT is_member) OVER ())::DOUBLE AS n FROM w_mia) GROUP BY p, n
    """,
)
oracle(
    "mia_tpr_at_fpr",
    """
    SELECT round(coalesce(max(tp/p) FILTER (fp/n <= 0.01), 0), 4) AS mia_tpr_at_fpr FROM (
      SELECT (count(*) FILTER (is_member) OVER (ORDER BY score DESC))::DOUBLE AS tp, (count(*) FILTER (NOT is_member) OVER (ORDER BY score DESC))::DOUBLE AS fp,
        (count(*) FILTER (is_member) OVER ())::DOUBLE AS p, (count(*) FILTER (NOT is_member) OVER ())::DOUBLE AS n FROM w_mia)
    """,
)

# ---- generators ----------------------------------------------------------------------------
view("w_indexed", f"SELECT *, row_number() OVER ({_order('boot')}) AS idx FROM w_real")
view("w_n", "SELECT count(*) AS n FROM w_real")


def _boot(noise: float, clip: bool, seed: str = "42") -> str:
    cells = []
    for i, c in enumerate(S.DURATION_COLUMNS):
        e = q6(f"r.{c} + {noise}::DOUBLE * s.{c} * {gauss('draw_id', f'jitter{i//4}', seed, i%4)}")
        low = {"capture_latency_days": 0, "transit_duration_days": 0.01, "promised_transit_days": 0.01}.get(c)
        cells.append((f"CASE WHEN {e} < {low} THEN {low}::DOUBLE ELSE {e} END" if clip and low is not None else e) + f" AS {c}")
    return ", ".join(cells)


def _draws(count: str, noise: float, clip: bool = False) -> str:
    return f"""
    SELECT draw_id, {_boot(noise, clip)}, r.delay_label, r.last_scac, r.carrier_service_code, r.distance_km,
      r.date_order_capture, r.date_ship_last_shipment, r.date_delivery_last_shipment, r.date_promise_shipment, r.date_promise_delivery
    FROM (SELECT i AS draw_id, floor({u('i', 'pick')} * (SELECT n FROM w_n))::BIGINT + 1 AS idx FROM range((SELECT {count} FROM w_n)) t(i))
    JOIN w_indexed r USING (idx), w_spread s
    """


_shown_cols = ", ".join(f"round({c},9) AS {c}" for c in S.DURATION_COLUMNS)
view("w_boot_one", _draws("n", 0.03))
oracle("bootstrap_synth", f"SELECT draw_id, {_shown_cols}, delay_label FROM w_boot_one")
view("w_boot_clip", _draws("n", 0.15, True))
oracle("bootstrap_clipped", f"SELECT draw_id, {_shown_cols}, delay_label FROM w_boot_clip")
_REJ = """coalesce(transit_duration_days > 0 AND delay_label IN (0,1,2) AND last_scac NOT IN ('','nan','None','NaN')
  AND carrier_service_code NOT IN ('','nan','None','NaN') AND date_order_capture <= date_ship_last_shipment
  AND date_ship_last_shipment <= date_delivery_last_shipment, false)"""
view("w_boot_two", _draws("8*n", 0.02))
view("w_boot_kept", f"SELECT *, {_REJ} AS ok FROM w_boot_two")
oracle(
    "resample_to_target",
    f"SELECT draw_id, {_shown_cols}, delay_label FROM (SELECT *, row_number() OVER (ORDER BY draw_id) AS r FROM w_boot_kept WHERE ok) WHERE r <= (SELECT n FROM w_n)",
)


def _until(name: str, kept: str) -> str:
    """Draws up to the one with which n rows have survived, at most 8 n of them."""
    view(
        f"{name}_cum",
        f"SELECT draw_id, delay_label, ok, sum(ok::INTEGER) OVER (ORDER BY draw_id) AS c FROM {kept}",
    )
    view(f"{name}_cut", f"SELECT coalesce(min(draw_id) FILTER (c >= n), max(draw_id)) AS last FROM {name}_cum, w_n")
    return f"""
        SELECT any_value(n) AS n_target, count(*) AS drawn, count(*) FILTER (ok) AS survived,
          round(count(*) FILTER (ok)::DOUBLE/count(*), 4) AS survival_rate, count(*) FILTER (ok) < any_value(n) AS cap_hit, CASE WHEN count(*) FILTER (ok) < any_value(n) THEN 'limit' ELSE 'full' END AS status,
          round(count(*) FILTER (delay_label=2)::DOUBLE/count(*), 4) AS raw_label2_rate,
          count(*) FILTER (ok AND delay_label=2) AS kept_label2_n
        FROM {name}_cum, {name}_cut, w_n WHERE draw_id <= last
        """


oracle("resample_stats", _until("w_res", "w_boot_kept"))
view("w_boot_three", _draws("8*n", 0.03))
view("w_fit_pairs", "SELECT DISTINCT last_scac, carrier_service_code, true AS hit FROM w_real")
_levels_sql = []
for _name, _cond in [
    ("none", "true"),
    ("temporal", _T),
    ("moderate", _M),
    ("strict", f"{_M} AND (last_scac IS NULL OR carrier_service_code IS NULL OR hit)"),
    ("strict_reject", f"{_M} AND (last_scac IS NULL OR carrier_service_code IS NULL OR hit) AND {_REJ}"),
]:
    view(
        f"w_lv_{_name}",
        f"SELECT draw_id, delay_label, ({_cond}) AS ok FROM w_boot_three LEFT JOIN w_fit_pairs USING (last_scac, carrier_service_code)",
    )
    _levels_sql.append(
        f"SELECT *, '{_name.replace('_', '+')}' AS level FROM (" + _until(f"w_lp_{_name}", f"w_lv_{_name}") + ")"
    )
oracle("generate_levels", " UNION ALL ".join(_levels_sql))
view("w_boot_wide", _draws("16*n", 0.03))
oracle(
    "generate_rows",
    f"""
    SELECT draw_id, {_shown_cols}, delay_label FROM (
      SELECT b.*, row_number() OVER (ORDER BY draw_id) AS r
      FROM w_boot_wide b LEFT JOIN w_fit_pairs USING (last_scac, carrier_service_code)
      WHERE {_M} AND (last_scac IS NULL OR carrier_service_code IS NULL OR hit) AND {_REJ})
    WHERE r <= (SELECT n FROM w_n)
    """,
)
_cop = ["transit_duration_days", "promised_transit_days", "shipment_buffer_days", "sla_buffer"]
_sc = ", ".join(
    ppf(f"u{i}") + f" AS {c}" for i, c in enumerate(_cop)
)
_us = ", ".join(
    f"greatest(1e-4::DOUBLE, least(0.9999::DOUBLE, (rank() OVER (ORDER BY coalesce({c},0)) + (count(*) OVER (PARTITION BY coalesce({c},0)) - 1)/2.0::DOUBLE)/(count(*) OVER () + 1))) AS u{i}"
    for i, c in enumerate(_cop)
)
view("w_ranks", f"SELECT {_us} FROM w_real")
view("w_normals", f"SELECT {_sc} FROM w_ranks")
oracle(
    "copula_fit",
    " UNION ALL ".join(
        f"SELECT '{a}' AS left_field, '{b}' AS right_field, round(corr({a},{b}), 4) AS corr FROM w_normals"
        for i, a in enumerate(_cop) for b in _cop[i + 1 :]
    ),
)

# ---- the sweep's draws, integrity and fidelity: three generators, two seeds, five levels --------
view("w_sw_n", "SELECT count(*) AS n FROM orders")
for _seed in ("42", "43"):
    view(f"w_sw_index{_seed}", f"SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', row_id, 'boot', '{_seed}')), row_id) AS idx FROM w_real")


def _sweep_draws(name: str, noise: float, seed: str) -> str:
    return f"""
    SELECT '{name}' AS architecture, {seed} AS seed, draw_id, {_boot(noise, name == 'CTGAN', seed)}, r.delay_label, r.last_scac,
      r.carrier_service_code, r.distance_km, r.date_order_capture, r.date_ship_last_shipment, r.date_delivery_last_shipment,
      r.date_promise_shipment, r.date_promise_delivery
    FROM (SELECT i AS draw_id, floor({u('i', 'pick', seed)} * (SELECT n FROM w_n))::BIGINT + 1 AS idx FROM range((SELECT 13*n FROM w_sw_n)) t(i))
    JOIN w_sw_index{seed} r USING (idx), w_spread s
    """


view(
    "w_sw_draws",
    " UNION ALL ".join(_sweep_draws(a, noise, seed) for a, noise in (("TVAE", 0.03), ("CopulaGAN", 0.02), ("CTGAN", 0.15)) for seed in ("42", "43")),
)
_PAIR_OK = "(last_scac IS NULL OR carrier_service_code IS NULL OR coalesce(hit, false))"
_sweep_levels = {
    "none": "true",
    "temporal": _T,
    "moderate": _M,
    "strict": f"{_M} AND {_PAIR_OK}",
    "strict+reject": f"{_M} AND {_PAIR_OK} AND {_REJ}",
}
view(
    "w_sw_marked",
    f"SELECT d.*, {', '.join(f'({e}) AS ok{i}' for i, e in enumerate(_sweep_levels.values()))} FROM w_sw_draws d LEFT JOIN w_fit_pairs USING (last_scac, carrier_service_code)",
)
view(
    "w_sw_counted",
    f"""
    SELECT architecture, seed, delay_label, capture_latency_days, transit_duration_days, promised_transit_days, shipment_buffer_days, sla_buffer,
      {', '.join(f'ok{i}, count(*) FILTER (ok{i}) OVER w AS c{i}' for i in range(5))}
    FROM w_sw_marked WINDOW w AS (PARTITION BY architecture, seed ORDER BY draw_id)
    """,
)
view(
    "w_sw_used",
    " UNION ALL ".join(
        f"SELECT architecture, seed, '{level}' AS level, ok{i} AS ok, delay_label, capture_latency_days, transit_duration_days, promised_transit_days, "
        f"shipment_buffer_days, sla_buffer, n FROM w_sw_counted, w_sw_n WHERE c{i} < n OR (c{i} = n AND ok{i})"
        for i, level in enumerate(_sweep_levels)
    ),
)
view(
    "w_sw_stats",
    """
    SELECT architecture, level, seed, count(*) AS drawn, count(*) FILTER (ok) AS kept, count(*) FILTER (delay_label = 2) AS raw2,
      count(*) FILTER (ok AND delay_label = 2) AS kept2, any_value(n) AS n,
      round(avg(coalesce(transit_duration_days <= 0, false)::INTEGER + coalesce(capture_latency_days < 0, false)::INTEGER
        + (delay_label IS NULL OR delay_label NOT IN (0, 1, 2))::INTEGER) FILTER (ok) * 100.0::DOUBLE, 4) AS cvr
    FROM w_sw_used GROUP BY ALL
    """,
)
view("w_sw_real", " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS v, count(*) AS r FROM w_real WHERE {c} IS NOT NULL GROUP BY 2" for c in S.DURATION_COLUMNS))
view(
    "w_sw_synth",
    f"""
    SELECT architecture, level, seed, p.field AS field, p.v AS v, count(*) AS s FROM (
      SELECT architecture, level, seed, unnest([{", ".join(f"{{'field': '{c}', 'v': {c}}}" for c in S.DURATION_COLUMNS)}]) AS p FROM w_sw_used WHERE ok)
    WHERE p.v IS NOT NULL GROUP BY ALL
    """,
)
view(
    "w_sw_points",
    """
    SELECT architecture, level, seed, field, v, sum(r) AS r, sum(s) AS s FROM (
      SELECT architecture, level, seed, field, v, 0 AS r, s FROM w_sw_synth
      UNION ALL SELECT architecture, level, seed, field, v, r, 0 FROM w_sw_real, (SELECT DISTINCT architecture, level, seed FROM w_sw_stats)) GROUP BY ALL
    """,
)
view(
    "w_sw_ks",
    """
    SELECT architecture, level, seed, field, round((1 - max(abs(cr::DOUBLE/nr - cs::DOUBLE/ns)))::VARCHAR::DECIMAL(20,18), 4)::DOUBLE AS ks FROM (
      SELECT *, sum(r) OVER up AS cr, sum(s) OVER up AS cs, sum(r) OVER al AS nr, sum(s) OVER al AS ns FROM w_sw_points
      WINDOW up AS (PARTITION BY architecture, level, seed, field ORDER BY v), al AS (PARTITION BY architecture, level, seed, field)) GROUP BY ALL
    """,
)
_sweep_lines = {
    "reject_kept_n": "least(kept, n)",
    "reject_drawn": "drawn",
    "reject_survived": "kept",
    "reject_survival_rate": "round(kept::DOUBLE/drawn, 4)",
    "reject_cap_hit": "(kept < n)::INTEGER",
    "label2_raw_rate": "round(raw2::DOUBLE/drawn, 4)",
    "label2_kept_n": "kept2",
    "cvr": "cvr",
}
oracle(
    "sweep_measured",
    " UNION ALL ".join(f"SELECT architecture, level, seed, '{m}' AS metric, ({e})::DOUBLE AS value FROM w_sw_stats" for m, e in _sweep_lines.items())
    + " UNION ALL SELECT architecture, level, seed, 'ks_mean', round(round(avg(ks), 7), 4) FROM w_sw_ks GROUP BY architecture, level, seed",
)

# ---- sources and streams ---------------------------------------------------------------------
def _result_sql(source: str, digits: int = 9) -> str:
    dates = ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in S.DATE_COLUMNS)
    return f"""
    SELECT row_id, {dates}, dpe_id, last_shipnode, last_scac, line_type, round(t,{digits}) AS transit_duration_days, round(p,{digits}) AS promised_transit_days,
      round(s,{digits}) AS sla_buffer, CASE WHEN s IS NULL OR s>=0 THEN 0 WHEN -s<=2 THEN 1 ELSE 2 END::INTEGER AS delay_label
    FROM (SELECT *, {_days('date_ship_last_shipment','date_delivery_last_shipment')} AS t, {_days('date_promise_shipment','date_promise_delivery')} AS p,
      {_days('date_delivery_last_shipment','date_promise_delivery')} AS s FROM ({source}))
    """


oracle(
    "adapt_order_lines",
    _result_sql("""
    SELECT row_id, o AS date_order_created_omni, o AS date_order_capture, sh AS date_ship_last_shipment, sh AS date_promise_shipment,
      sh + to_days(greatest(h%9-1, 0)::INTEGER) AS date_delivery_last_shipment, sh + to_days((h%4)::INTEGER) AS date_promise_delivery,
      'UNK' AS dpe_id, 'UNK' AS last_shipnode, coalesce(last_scac, 'nan') AS last_scac, line_type
    FROM (SELECT *, date_trunc('minute', date_order_created_omni) AS o, date_trunc('minute', date_order_created_omni) + to_days((h%5)::INTEGER) AS sh FROM w_real)
    WHERE h%71 <> 0 AND h%73 <> 0
    """),
)
oracle(
    "adapt_legacy",
    _result_sql("""
    SELECT row_id, date_order_created_omni, date_order_created_omni + to_hours(2) AS date_order_capture, date_ship_last_shipment,
      date_order_created_omni + to_hours(8) AS date_promise_shipment, CASE WHEN h%97<>0 THEN date_delivery_last_shipment END AS date_delivery_last_shipment,
      date_promise_delivery, 'UNKNOWN' AS dpe_id, 'SN_UNKNOWN' AS last_shipnode, coalesce(last_scac, 'nan') AS last_scac, 'NORMAL' AS line_type
    FROM w_base
    """),
)


def _pu(salt: str, lane: int = 0) -> str:
    return u("i", f"proxy-{salt}", "42", lane)


def _micro(days: str) -> str:
    return f"to_microseconds(floor(({days}) * 86400e6::DOUBLE)::BIGINT)"


_root = f"({1.0 - 1.0 / (9.0 * 2.3)!r}::DOUBLE + {gauss('i', 'proxy-transit')} * {1.0 / (3.0 * 2.3**0.5)!r}::DOUBLE)"
oracle(
    "proxy_deliveries",
    _result_sql(f"""
    SELECT 'P' || i AS row_id, cr AS date_order_created_omni, ca AS date_order_capture, sh AS date_ship_last_shipment, sh + {_micro('tr')} AS date_delivery_last_shipment,
      ps AS date_promise_shipment, ps + {_micro('greatest(0.25::DOUBLE, tr - sl)')} AS date_promise_delivery,
      'DPE_' || lpad((floor({_pu('ids', 0)}*50.0::DOUBLE)+1)::BIGINT::VARCHAR, 3, '0') AS dpe_id,
      'SN_' || lpad((floor({_pu('ids', 3)}*70.0::DOUBLE)+1)::BIGINT::VARCHAR, 3, '0') AS last_shipnode,
      ['DHL','UPS','FDX','DPD','USPS'][(floor({_pu('carrier', 0)}*5.0::DOUBLE)+1)::INTEGER] AS last_scac,
      CASE WHEN {_pu('types', 0)} < 0.86::DOUBLE THEN 'NORMAL' WHEN {_pu('types', 0)} < {0.86 + 0.09!r}::DOUBLE THEN 'BACKORDER' ELSE 'PREORDER' END AS line_type
    FROM (SELECT *, ca + {_micro(f"{0.05!r}::DOUBLE + {1.2 - 0.05!r}::DOUBLE * {_pu('created', 3)}")} AS sh, ca + {_micro(f"0.0::DOUBLE + 0.6::DOUBLE * {_pu('promise', 0)}")} AS ps FROM (
      SELECT *, cr + {_micro(f"{0.01!r}::DOUBLE + {0.8 - 0.01!r}::DOUBLE * {_pu('created', 2)}")} AS ca FROM (
        SELECT i, TIMESTAMP '2025-01-01' + to_hours((floor({_pu('created', 0)}*180.0::DOUBLE)*24 + floor({_pu('created', 1)}*24.0::DOUBLE))::BIGINT) AS cr,
          greatest(0.08::DOUBLE, {2.3 * 0.8!r}::DOUBLE * {_root} * {_root} * {_root}) AS tr, -0.25::DOUBLE + 1.0::DOUBLE * {_pu('promise', 1)} AS sl
        FROM (SELECT (l_orderkey * 10 + l_linenumber)::BIGINT AS i FROM lineitem))))
    """, 6),
)
oracle(
    "stream_audit",
    f"SELECT quarantined, count(*) AS n, count(DISTINCT row_id) AS ids FROM (SELECT *, {' OR '.join(_HARD)} AS quarantined FROM w_flags) GROUP BY 1",
)
oracle(
    "stream_window_rate",
    f"""
    SELECT strftime(make_timestamp((floor(epoch(date_order_created_omni)/604800)*604800*1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS window_start,
      count(*) AS n, count(*) FILTER ({' OR '.join(_HARD)}) AS violations FROM w_flags GROUP BY 1
    """,
)
oracle("stream_dedup", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
# Rows by the part of the month they arrive in; the watermark is a day behind what came before.
view(
    "w_arrivals",
    """
    SELECT *, (SELECT max(e.ts) - INTERVAL 1 DAY FROM w_parts e WHERE e.part < a.part) AS mark FROM w_parts a
    """,
)
view(
    "w_parts",
    """
    SELECT event_id, ts, value, least(3, (day(ts) - 1) // 8 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS part FROM events
    """,
)
oracle(
    "stream_late_rows",
    """
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) FILTER (NOT late) AS n,
      count(*) FILTER (NOT late AND value > 50) AS violations, count(*) FILTER (late) AS n_late
    FROM (SELECT *, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= mark, false) AS late FROM w_arrivals) GROUP BY 1
    """,
)
oracle(
    "workflow_audit",
    " UNION ALL ".join(
        f"SELECT '{i}' AS id, '{key}' AS audit_key, count(*) FILTER ({_flag}) AS violations, count(*) AS n, 'evaluated' AS status FROM w_work"
        for (i, _, _, _, _, _, key), _flag in zip(_CATALOG, ["f_r1", "f_r2", "f_r3", "f_rpt", "f_r5", "f_r6", "f_r7", "f_r8"])
    ),
)
view(
    "w_work",
    """
    SELECT NOT coalesce(date_order_capture <= date_ship_last_shipment AND date_ship_last_shipment <= date_delivery_last_shipment
        AND coalesce(date_promise_shipment <= date_promise_delivery, true), false) AS f_r1,
      coalesce(transit_duration_days <= 0, false) AS f_r2, coalesce(promised_transit_days < 0, false) AS f_rpt,
      coalesce(capture_latency_days < -(1.0::DOUBLE/86400.0::DOUBLE), false) AS f_r3,
      delay_label <> (CASE WHEN sla_buffer>=0 THEN 0 WHEN -sla_buffer<=2 THEN 1 ELSE 2 END) AS f_r7,
      last_scac IS NULL OR last_scac = '' AS f_r5, delay_label NOT IN (0,1,2) AS f_r6,
      coalesce(isodow(date_delivery_last_shipment)-1 = 6 OR (last_scac='DPD' AND isodow(date_delivery_last_shipment)-1 = 5), false) AS f_r8
    FROM w_real
    """,
)
