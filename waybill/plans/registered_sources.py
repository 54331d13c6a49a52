"""Registered queries for source adapters and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.small import fresh_path
from waybill.operators.rules import carrier_vocabulary
from waybill.plans.registered import query
from waybill.sources import driver_tables as D
from waybill.sources import order_lines as O
from waybill.sources.proxy import proxies_for
from waybill.sources.sinks import records
from waybill.streaming import audit_stream as A

_SHOWN = [S.ROW_ID, *S.DATE_COLUMNS, "dpe_id", "last_shipnode", "last_scac", "line_type"]


def _result(df, digits=9):
    out = records(df)
    return out.select(
        *_SHOWN, *[F.round(c, digits).alias(c) for c in (S.TRANSIT, S.PROMISED, S.SLA)], S.LABEL
    )


@query
def adapt_order_lines(spark, sf_dir):
    """All order lines, renamed to the public CSV shape and read back from it."""
    rows = D.deliveries(
        spark, sf_dir, [S.CREATED, "line_type", "last_scac", "carrier_service_code"]
    )
    h = F.col("h")
    shape = {
        O.ORDER_DATE: F.when(h % 71 == 0, "unknown").otherwise(
            F.date_format(S.CREATED, O.ORDER_LINE_FORMAT)
        ),
        O.SHIP_DATE: F.date_format(
            F.timestamp_micros(F.unix_micros(S.CREATED) + (h % 5) * 86_400_000_000),
            O.ORDER_LINE_FORMAT,
        ),
        O.REAL_DAYS: F.when(h % 73 == 0, "n/a").otherwise((h % 9 - 1).cast("string")),
        O.SCHEDULED_DAYS: (h % 4).cast("string"),
        "Order Id": F.col(S.ROW_ID),
        "Type": F.col("line_type"),
        "Shipping Mode": F.col("last_scac"),
        "Customer Segment": F.col("carrier_service_code"),
    }
    lines = rows.select(S.ROW_ID, *[c.alias(k) for k, c in shape.items()])
    return _result(O.adapt_order_lines(lines))


@query
def adapt_legacy(spark, sf_dir):
    """All deliveries, renamed to the older schema and read back from it."""
    rows = D.deliveries(spark, sf_dir, [*S.DATE_COLUMNS, "last_scac", "carrier_service_code"])
    old = rows.select(
        S.ROW_ID,
        F.col(S.ROW_ID).alias("order_id"),
        F.col(S.CREATED).alias("order_timestamp"),
        F.date_format(S.SHIP, "yyyy-MM-dd HH:mm:ss").alias("shipping_date"),
        F.when(F.col("h") % 97 == 0, "never")
        .otherwise(F.date_format(S.DELIVERY, "yyyy-MM-dd HH:mm:ss"))
        .alias("delivery_date_actual"),
        F.col(S.PROMISE_DELIVERY).alias("promised_date"),
        F.col("carrier_service_code").alias("fc_id"),
        F.col("last_scac").alias("carrier"),
        F.col("carrier_service_code").alias("service_level"),
    )
    return _result(O.adapt_legacy(old))


@query
def proxy_deliveries(spark, sf_dir):
    """A proxy row for each order line, derived from its order and line numbers."""
    lines = D.table(spark, sf_dir, "lineitem")
    return _result(proxies_for(lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("id"))), 6)


# ---- streams -----------------------------------------------------------------------------
def _flagged_stream(spark, sf_dir):
    lines = A.parquet_stream(spark, f"{sf_dir}/lineitem.parquet")
    rows = D.audited(spark, sf_dir, lines=lines)
    return A.flag_stream(rows, carrier_vocabulary(D.vocabulary_rows(spark, sf_dir)))


@query
def stream_audit(spark, sf_dir):
    rows = A.run_once(_flagged_stream(spark, sf_dir).select(S.ROW_ID, "quarantined"))
    return rows.groupBy("quarantined").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(S.ROW_ID).alias("ids")
    )


@query
def stream_window_rate(spark, sf_dir):
    rates = A.window_rates(_flagged_stream(spark, sf_dir))
    return records(A.latest_batch(A.run_once(rates, "update"), ["window_start"]))


@query
def stream_dedup(spark, sf_dir):
    """Events sent twice, reduced to one copy each, counted by type."""
    events = A.parquet_stream(spark, f"{sf_dir}/events.parquet").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type"
    )
    twice = events.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    once = A.run_once(A.drop_repeats(twice, "event_id", "ts", "1 day").drop("copy"))
    return once.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_late_rows(spark, sf_dir):
    """Events per day, delivered in four parts, a tenth of them one part late: a micro-batch each."""
    events = D.table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 50).alias("quarantined")
    )
    behind = F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    part = F.least(F.lit(3), F.floor((F.dayofmonth("ts") - 1) / 8) + behind)
    folder = fresh_path(spark)
    for k in range(4):
        # What has arrived so far is processed; the next part goes on from the stored progress.
        events.where(part == k).write.mode("append").parquet(f"{folder}/events")
        stream = A.parquet_stream(spark, f"{folder}/events")
        rates = A.rates_with_late(stream, f"{folder}/state", "ts", "1 day", "1 day")
    return records(rates)
