"""Proxy deliveries: plausible rows for trying things out without real data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.hashing import normal, uniform
from waybill.functions.small import computed_once
from waybill.operators.derive import derive_features

# ---- Fixed values: distributions of the proxy table ------------------------------------
START = "2025-01-01 00:00:00"
CREATED_DAYS, CREATED_HOURS = 180, 24
CAPTURE_LAG = (0.01, 0.8)
SHIP_LAG = (0.05, 1.2)
TRANSIT_SHAPE, TRANSIT_SCALE, MIN_TRANSIT = 2.3, 0.8, 0.08
PROMISE_LAG = (0.0, 0.6)
PROMISE_SLACK, MIN_PROMISED = (-0.25, 0.75), 0.25
LINE_TYPES = [("NORMAL", 0.86), ("BACKORDER", 0.09), ("PREORDER", 0.05)]
ORDER_TYPES = [("B2C", 0.72), ("B2B", 0.08), ("MARKETPLACE", 0.20)]
CARRIERS = ["DHL", "UPS", "FDX", "DPD", "USPS"]
SERVICES = ["EXPRESS", "PRIORITY", "GROUND", "ECONOMY", "SAME_DAY"]
SERVICE_CODES = ["XS", "XP", "XG", "XE", "XD"]
PARTIES, ITEMS, NODES = 50, 250, 70


def _between(u: Column, span) -> Column:
    low, high = span
    return F.lit(low) + F.lit(high - low) * u


def _numbered(prefix: str, u: Column, count: int, digits: int) -> Column:
    index = (F.floor(u * F.lit(float(count))) + 1).cast("string")
    return F.concat(F.lit(prefix), F.lpad(index, digits, "0"))


def _one_of(values, u: Column) -> Column:
    index = (F.floor(u * F.lit(float(len(values)))) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), index)


def _weighted(values, u: Column) -> Column:
    out, upto = F, 0.0
    for name, share in values[:-1]:
        upto += share
        out = out.when(u < upto, name)
    return out.otherwise(values[-1][0])


def _gamma(z: Column, shape: float, scale: float) -> Column:
    """Gamma variate from a normal one (Wilson-Hilferty)."""
    root = F.lit(1.0 - 1.0 / (9.0 * shape)) + z * F.lit(1.0 / (3.0 * shape**0.5))
    return F.lit(shape * scale) * root * root * root


def _shift(base: Column, days: Column) -> Column:
    return base + F.floor(days * F.lit(86400e6)).cast("bigint")


def proxy_deliveries(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n proxy rows, numbered from 0."""
    return proxies_for(spark.range(n), seed)


def proxies_for(ids: DataFrame, seed: int = 42) -> DataFrame:
    """A proxy row for each `id` of a table; the row is a function of the id and the seed."""
    key = F.col("id")

    def u(salt: str, lane: int = 0) -> Column:
        return uniform(key, f"proxy-{salt}", seed, lane)

    lags = computed_once(
        ids.select("id"),
        {
            "_created": F.floor(u("created", 0) * F.lit(float(CREATED_DAYS))) * 24
            + F.floor(u("created", 1) * F.lit(float(CREATED_HOURS))),
            "_capture": _between(u("created", 2), CAPTURE_LAG),
            "_ship": _between(u("created", 3), SHIP_LAG),
            "_transit": F.greatest(
                F.lit(MIN_TRANSIT),
                _gamma(normal(key, "proxy-transit", seed), TRANSIT_SHAPE, TRANSIT_SCALE),
            ),
            "_promise": _between(u("promise", 0), PROMISE_LAG),
            "_slack": _between(u("promise", 1), PROMISE_SLACK),
        },
    )
    start = F.unix_micros(F.lit(START).cast("timestamp"))
    created = start + F.col("_created").cast("bigint") * 3_600_000_000
    capture = _shift(created, F.col("_capture"))
    ship = _shift(capture, F.col("_ship"))
    promise_ship = _shift(capture, F.col("_promise"))
    promised = F.greatest(F.lit(MIN_PROMISED), F.col("_transit") - F.col("_slack"))
    raw = lags.select(
        F.concat(F.lit("P"), key.cast("string")).alias(S.ROW_ID),
        F.timestamp_micros(created).alias(S.CREATED),
        F.timestamp_micros(capture).alias(S.CAPTURE),
        F.timestamp_micros(ship).alias(S.SHIP),
        F.timestamp_micros(_shift(ship, F.col("_transit"))).alias(S.DELIVERY),
        F.timestamp_micros(promise_ship).alias(S.PROMISE_SHIP),
        F.timestamp_micros(_shift(promise_ship, promised)).alias(S.PROMISE_DELIVERY),
        F.concat(F.lit(f"ORD_{seed}_"), F.lpad(key.cast("string"), 7, "0")).alias("order_no"),
        _numbered("DPE_", u("ids", 0), PARTIES, 3).alias("dpe_id"),
        _numbered("ITEM_", u("ids", 1), ITEMS, 5).alias("item_id"),
        _numbered("SN_", u("ids", 2), NODES, 3).alias("dpe_shipnode"),
        _numbered("SN_", u("ids", 3), NODES, 3).alias("last_shipnode"),
        _weighted(LINE_TYPES, u("types", 0)).alias("line_type"),
        _weighted(ORDER_TYPES, u("types", 1)).alias("order_type"),
        _one_of(CARRIERS, u("carrier", 0)).alias("last_scac"),
        _one_of(SERVICES, u("carrier", 1)).alias("last_shipment_carrier_service"),
        _one_of(SERVICE_CODES, u("carrier", 2)).alias("carrier_service_code"),
    )
    return derive_features(raw)
