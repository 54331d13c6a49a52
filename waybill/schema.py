"""Canonical delivery schema and the fixed values the metrics depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- Fixed values: column names of the canonical schema -------------------------
CREATED = "date_order_created_omni"
CAPTURE = "date_order_capture"
SHIP = "date_ship_last_shipment"
DELIVERY = "date_delivery_last_shipment"
PROMISE_SHIP = "date_promise_shipment"
PROMISE_DELIVERY = "date_promise_delivery"

DATE_COLUMNS = [CREATED, CAPTURE, SHIP, DELIVERY, PROMISE_DELIVERY, PROMISE_SHIP]
REQUIRED_DATES = [CAPTURE, SHIP, DELIVERY]

CATEGORICAL_COLUMNS = [
    "dpe_id",
    "item_id",
    "line_type",
    "dpe_shipnode",
    "last_shipnode",
    "last_scac",
    "last_shipment_carrier_service",
    "carrier_service_code",
    "order_type",
]

LATENCY = "capture_latency_days"
TRANSIT = "transit_duration_days"
PROMISED = "promised_transit_days"
BUFFER = "shipment_buffer_days"
SLA = "sla_buffer"
DISTANCE = "distance_km"
LABEL = "delay_label"

DURATION_COLUMNS = [LATENCY, TRANSIT, PROMISED, BUFFER, SLA]
COPULA_COLUMNS = [TRANSIT, PROMISED, BUFFER, SLA]

ENCODED_COLUMNS = [f"{c}_enc" for c in CATEGORICAL_COLUMNS]
# Transit and shipment buffer stay out: with promised transit they add up to the
# SLA buffer, from which the label is cut.
FEATURE_COLUMNS = [DISTANCE, PROMISED, *ENCODED_COLUMNS]

FIDELITY_CATEGORICALS = [
    "dpe_id",
    "line_type",
    "dpe_shipnode",
    "last_shipnode",
    "last_scac",
    "last_shipment_carrier_service",
    "carrier_service_code",
    "order_type",
    LABEL,
]
SANITY_CATEGORICALS = [c for c in FIDELITY_CATEGORICALS if c != LABEL]

# ---- Fixed values: label domain and class shares ---------------------------------
LABELS = [0, 1, 2]
LABEL_SHARES = {0: 0.5442, 1: 0.3758, 2: 0.0800}
LATE_DAYS = 2.0

# ---- Fixed values: constraint parameters -----------------------------------------
CLOCK_SKEW_DAYS = 1.0 / 86400
ABSENT_MARKS = ["", "nan", "None", "NaN"]
ABSENT_MARKS_VOCABULARY = ["", "nan", "None", "NaN", "<NA>", "NaT"]
# weekday numbers, Monday = 0
CLOSED_DAYS = {"DHL": [6], "UPS": [6], "FDX": [6], "DPD": [5, 6], "USPS": [6]}
CLOSED_DAYS_OTHER = [6]
FORBIDDEN_FEATURES = [
    "promised_date",
    "delivery_date_actual",
    "on_time_exact",
    "transit_delay_days",
    "delay_source",
]

# ---- Fixed values: depot and sphere ----------------------------------------------
DEPOT_LAT = 41.2044
DEPOT_LON = -75.9113
EARTH_KM = 6371.0

# ---- Fixed values: strictness levels ---------------------------------------------
LADDER = ["none", "temporal", "moderate", "strict"]
STRICTNESS = [
    ("none", "none", False),
    ("temporal", "temporal", False),
    ("moderate", "moderate", False),
    ("strict", "strict", False),
    ("strict+reject", "strict", True),
]
SWEEP_METRICS = [
    "dcr_mean",
    "dcr_p5",
    "nnaa",
    "business_utility",
    "f1_gap",
    "l2_recall",
    "bus_ratio",
    "ks_mean",
    "js_mean",
    "cvr",
]

TIME_SORT_COLUMNS = [
    CREATED,
    CAPTURE,
    SHIP,
    DELIVERY,
    "order_timestamp",
    "shipping_date",
    "delivery_date_actual",
]

ROW_ID = "row_id"

CANONICAL = T.StructType(
    [T.StructField(ROW_ID, T.StringType(), False)]
    + [T.StructField(c, T.TimestampType()) for c in DATE_COLUMNS]
    + [T.StructField(c, T.StringType()) for c in CATEGORICAL_COLUMNS]
    + [T.StructField(c, T.DoubleType()) for c in [*DURATION_COLUMNS, DISTANCE]]
    + [T.StructField(LABEL, T.IntegerType())]
)


def resolve_features(columns, wanted=None):
    """Feature names usable on a table: present columns plus encodings still to be made."""
    present = set(columns)
    return [
        c
        for c in (wanted or FEATURE_COLUMNS)
        if c in present or (c.endswith("_enc") and c[: -len("_enc")] in present)
    ]


def is_raw_delivery_schema(columns) -> bool:
    return set(REQUIRED_DATES + CATEGORICAL_COLUMNS) <= set(columns)


def shared_columns(left, right):
    """Columns of `left` that `right` has too, in the order of `left`."""
    other = set(right)
    return [c for c in left if c in other]
