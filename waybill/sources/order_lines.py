"""Delivery tables from CSV: the canonical raw schema, the older one, public order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.coerce import Fields
from waybill.operators.derive import derive_features
from waybill.operators.rules import in_label_domain

# ---- Fixed values: column names of the sources, and defaults for missing ones --------
ORDER_DATE = "order date (DateOrders)"
SHIP_DATE = "shipping date (DateOrders)"
REAL_DAYS = "Days for shipping (real)"
SCHEDULED_DAYS = "Days for shipment (scheduled)"
ORDER_LINE_TEXTS = {
    "order_no": "Order Id",
    "dpe_id": "Department Name",
    "item_id": "Category Name",
    "line_type": "Type",
    "dpe_shipnode": "Order Region",
    "last_shipnode": "Market",
    "last_scac": "Shipping Mode",
    "last_shipment_carrier_service": "Shipping Mode",
    "carrier_service_code": "Customer Segment",
    "order_type": "Customer Segment",
}
UNKNOWN = "UNK"
ORDER_LINE_FORMAT = "M/d/yyyy H:mm"

LEGACY_REQUIRED = [
    "order_timestamp",
    "shipping_date",
    "delivery_date_actual",
    "fc_id",
    "carrier",
    "service_level",
]
LEGACY_TEXTS = {
    "dpe_id": ("region", "UNKNOWN"),
    "dpe_shipnode": ("fc_id", "SN_UNKNOWN"),
    "last_shipnode": ("fc_city", "SN_UNKNOWN"),
    "last_scac": ("carrier", "SCAC_UNKNOWN"),
    "last_shipment_carrier_service": ("service_level", "SERVICE_UNKNOWN"),
    "carrier_service_code": ("service_level", "CODE_UNKNOWN"),
}
LEGACY_CONSTANTS = {"item_id": "ITEM_UNKNOWN", "line_type": "NORMAL", "order_type": "B2C"}
CAPTURE_AFTER_HOURS, PROMISE_AFTER_HOURS = 2, 6


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Every column as text: types are settled once, by the adapters."""
    return spark.read.csv(path, header=True, encoding=encoding, multiLine=False)


def load_order_lines(spark: SparkSession, path: str) -> DataFrame:
    return adapt_order_lines(read_csv(spark, path, "ISO-8859-1"))


def load_deliveries(spark: SparkSession, path: str) -> DataFrame:
    """A CSV in the canonical raw or the older schema, as canonical rows with derivations."""
    df = read_csv(spark, path)
    if S.is_raw_delivery_schema(df.columns):
        return derive_features(df)
    if set(LEGACY_REQUIRED) <= set(df.columns):
        return adapt_legacy(df)
    raise ValueError("neither the raw delivery schema nor the older one")


def _plus_days(base: Column, days: Column) -> Column:
    micros = F.floor(F.greatest(days, F.lit(0.0)) * F.lit(86400e6)).cast("bigint")
    return F.timestamp_micros(F.unix_micros(base) + micros)


def _text(df: DataFrame, name: str, default: str) -> Column:
    if name not in df.columns:
        return F.lit(default)
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("nan"))


def _kept(df: DataFrame):
    return [S.ROW_ID] if S.ROW_ID in df.columns else []


def adapt_order_lines(lines: DataFrame, fmt: str = ORDER_LINE_FORMAT) -> DataFrame:
    """Public order lines as canonical rows. Delivery and promise lie the real and the
    scheduled days after shipping; rows without these dates and days are dropped."""
    f = Fields(lines)
    typed = lines.withColumns(
        {
            "_order": F.try_to_timestamp(F.col(f"`{ORDER_DATE}`"), F.lit(fmt)),
            "_ship": F.try_to_timestamp(F.col(f"`{SHIP_DATE}`"), F.lit(fmt)),
            "_real": f.number(REAL_DAYS),
            "_sched": f.number(SCHEDULED_DAYS),
        }
    ).where("_order is not null and _ship is not null and _real is not null and _sched is not null")
    order, ship = F.col("_order"), F.col("_ship")
    raw = typed.select(
        *_kept(lines),
        order.alias(S.CREATED),
        order.alias(S.CAPTURE),
        ship.alias(S.SHIP),
        _plus_days(ship, F.col("_real")).alias(S.DELIVERY),
        ship.alias(S.PROMISE_SHIP),
        _plus_days(ship, F.col("_sched")).alias(S.PROMISE_DELIVERY),
        *[_text(lines, src, UNKNOWN).alias(dst) for dst, src in ORDER_LINE_TEXTS.items()],
    )
    derived = derive_features(raw)
    usable = in_label_domain(Fields(derived)) & F.col(S.TRANSIT).isNotNull()
    return derived.where(usable)


def adapt_legacy(df: DataFrame) -> DataFrame:
    """The older schema as canonical rows; what it lacks is set to fixed values."""
    f = Fields(df)

    def hours_after(base: Column, hours: int) -> Column:
        return F.timestamp_micros(F.unix_micros(base) + F.lit(hours * 3_600_000_000))

    created = f.stamp("order_timestamp")
    capture = hours_after(created, CAPTURE_AFTER_HOURS)
    promised = (
        f.stamp("promised_date") if f.has("promised_date") else F.lit(None).cast("timestamp")
    )
    number = (
        F.col("order_id").cast("string")
        if f.has("order_id")
        else F.concat(F.lit("ORD_LEG_"), F.substring(F.md5(F.to_json(F.struct("*"))), 1, 12))
    )
    raw = df.select(
        *_kept(df),
        created.alias(S.CREATED),
        capture.alias(S.CAPTURE),
        f.stamp("shipping_date").alias(S.SHIP),
        f.stamp("delivery_date_actual").alias(S.DELIVERY),
        promised.alias(S.PROMISE_DELIVERY),
        hours_after(capture, PROMISE_AFTER_HOURS).alias(S.PROMISE_SHIP),
        number.alias("order_no"),
        *[_text(df, src, default).alias(dst) for dst, (src, default) in LEGACY_TEXTS.items()],
        *[F.lit(v).alias(k) for k, v in LEGACY_CONSTANTS.items()],
    )
    return derive_features(raw)
