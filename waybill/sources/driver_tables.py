"""The star-schema test tables read as canonical delivery rows.

`lineitem` joined to `orders` gives one delivery per line. Dates are derived from the
order date with a deterministic integer `h` per line, which also plants rule violations.
Only the dimension tables needed for the requested columns are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.coerce import days_between, quantised
from waybill.functions.hashing import lane_normal, with_digests
from waybill.functions.small import computed_once, scalar, spread, stored

_FROM_CUSTOMER = {"order_type", "dpe_id"}
_FROM_PART = {"line_type", "item_id"}
_FROM_SUPPLIER = {"dpe_shipnode"}
#: What dates, carriers and ids are derived from.
_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "o_orderdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _div(n: Column, d: int) -> Column:
    return F.floor(n / F.lit(d)).cast("bigint")


def _later(base: Column, seconds: Column) -> Column:
    """Plain microsecond arithmetic: cheaper than zone-aware interval addition."""
    return F.timestamp_micros(F.unix_micros(base) + seconds * 1_000_000)


def _hours(base: Column, hours: Column) -> Column:
    return _later(base, hours * 3600)


def deliveries(spark: SparkSession, sf_dir: str, columns=None, lines=None) -> DataFrame:
    """Raw delivery rows (dates, categories, `h`); `columns` limits what is joined and read.

    `lines` replaces the stored order lines, for instance by a stream of them.
    """
    wanted = set(columns or [*S.DATE_COLUMNS, *S.CATEGORICAL_COLUMNS])
    return _dated(_joined(spark, sf_dir, wanted, lines), wanted)


def _joined(spark: SparkSession, sf_dir: str, wanted: set[str], lines=None) -> DataFrame:
    """Order lines with the columns of the other tables from which `wanted` follows, nothing derived."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    lines = table(spark, sf_dir, "lineitem") if lines is None else lines
    lines = spread(lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    df = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    if wanted & _FROM_CUSTOMER:
        customer = table(spark, sf_dir, "customer").select(
            "c_custkey", "c_nationkey", F.col("c_mktsegment").alias("order_type")
        )
        df = df.join(customer, df.o_custkey == customer.c_custkey)
        if "dpe_id" in wanted:
            home = nation.select(F.col("n_nationkey").alias("_cn"), F.col("n_name").alias("dpe_id"))
            df = df.join(home, df.c_nationkey == home._cn)
    if wanted & _FROM_PART:
        part = table(spark, sf_dir, "part").select(
            "p_partkey", F.col("p_type").alias("line_type"), F.col("p_brand").alias("item_id")
        )
        df = df.join(part, df.l_partkey == part.p_partkey)
    if wanted & _FROM_SUPPLIER:
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        site = nation.select(
            F.col("n_nationkey").alias("_sn"), F.col("n_name").alias("dpe_shipnode")
        )
        df = df.join(supplier, df.l_suppkey == supplier.s_suppkey)
        df = df.join(site, df.s_nationkey == site._sn)
    taken = [*_LINE, *(["o_orderpriority"] if "last_shipment_carrier_service" in wanted else [])]
    return df.select(*taken, *sorted(wanted & (_FROM_CUSTOMER | _FROM_PART | _FROM_SUPPLIER)))


def _dated(df: DataFrame, wanted: set[str]) -> DataFrame:
    """Raw delivery rows of joined lines."""
    h = F.col("h")
    df = df.withColumn(
        "h",
        F.col("l_orderkey") * 31
        + F.col("l_partkey") * 7
        + F.col("l_suppkey") * 13
        + F.col("l_linenumber") * 3,
    )
    latency = F.when(h % 29 == 0, -86400).when(h % 5 == 0, -1).otherwise(h % 3600)
    to_ship = F.when(h % 37 == 0, -30).otherwise(h % 40 + 2)
    moved = F.when(h % 41 == 0, 0).when(h % 43 == 0, -12).otherwise(_div(h, 11) % 120 + 6)
    promised = F.when(h % 47 == 0, -24).otherwise(_div(h, 13) % 72 + 48)
    df = df.withColumn(S.CREATED, F.col("o_orderdate").cast("timestamp"))
    df = df.withColumn(S.CAPTURE, _later(F.col(S.CREATED), latency))
    df = df.withColumns(
        {
            S.SHIP: _hours(F.col(S.CAPTURE), to_ship),
            S.PROMISE_SHIP: _hours(F.col(S.CAPTURE), _div(h, 7) % 15),
        }
    )
    df = computed_once(
        df,
        {
            "h": h,
            S.CREATED: F.col(S.CREATED),
            S.CAPTURE: F.col(S.CAPTURE),
            S.SHIP: F.col(S.SHIP),
            S.PROMISE_SHIP: F.col(S.PROMISE_SHIP),
            S.DELIVERY: F.when(h % 53 != 0, _hours(F.col(S.SHIP), moved)),
            S.PROMISE_DELIVERY: _hours(F.col(S.PROMISE_SHIP), promised),
        },
    )
    supp = F.col("l_suppkey")
    derived = {
        S.ROW_ID: F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"),
        "last_scac": F.when(h % 17 == 1, F.lit(""))
        .when(h % 17 == 2, F.lit("ZZZ"))
        .when(h % 17 != 0, _pick(["DHL", "UPS", "FDX", "DPD", "USPS"], supp % 5)),
        "carrier_service_code": _pick(["XS", "XP", "XG", "XE", "XD"], _div(supp, 5) % 5),
        "last_shipment_carrier_service": F.col("o_orderpriority"),
        "last_shipnode": F.concat(F.lit("SN_"), (supp % 70).cast("string")),
    }
    keep = [S.ROW_ID, "h", "l_suppkey"] + [
        c for c in [*S.DATE_COLUMNS, *S.CATEGORICAL_COLUMNS] if c in wanted
    ]
    return df.select(*[derived[c].alias(c) if c in derived else F.col(c) for c in keep])


def audited_label() -> Column:
    """The label of the audited copy: derived, then damaged on some rows."""
    h = F.col("h")
    sla = days_between(F.col(S.DELIVERY), F.col(S.PROMISE_DELIVERY))
    honest = F.when(sla >= 0, 0).when(-sla <= S.LATE_DAYS, 1).otherwise(2)
    return (
        F.when(h % 67 == 0, F.lit(None).cast("int"))
        .when(h % 61 == 0, F.lit(7))
        .when(h % 59 == 0, (honest + 1) % 3)
        .otherwise(honest)
        .cast("int")
    )


def _with_durations(df: DataFrame) -> DataFrame:
    d = F.col
    return df.withColumns(
        {
            S.LATENCY: days_between(d(S.CREATED), d(S.CAPTURE)),
            S.TRANSIT: days_between(d(S.SHIP), d(S.DELIVERY)),
            S.PROMISED: days_between(d(S.PROMISE_SHIP), d(S.PROMISE_DELIVERY)),
            S.BUFFER: days_between(d(S.SHIP), d(S.PROMISE_SHIP)),
            S.SLA: days_between(d(S.DELIVERY), d(S.PROMISE_DELIVERY)),
        }
    ).withColumn(S.DISTANCE, F.lit(0.0))


def audited(spark: SparkSession, sf_dir: str, categories=None, lines=None) -> DataFrame:
    """Canonical rows with planted violations and damaged labels: input of the audits."""
    cats = ["last_scac", "carrier_service_code"] if categories is None else categories
    df = deliveries(spark, sf_dir, [*S.DATE_COLUMNS, *cats], lines)
    return _with_durations(df).withColumn(S.LABEL, audited_label()).drop("h", "l_suppkey")


def canonical(spark: SparkSession, sf_dir: str, categories=None, keep_h=False) -> DataFrame:
    """The real side of comparisons: all rows, honest labels (missing SLA counts as on time)."""
    cats = S.CATEGORICAL_COLUMNS if categories is None else categories
    df = _honest(deliveries(spark, sf_dir, [*S.DATE_COLUMNS, *cats]))
    return df if keep_h else df.drop("h")


def _honest(raw: DataFrame) -> DataFrame:
    df = _with_durations(raw)
    label = (
        F.when(F.col(S.SLA).isNull() | (F.col(S.SLA) >= 0), 0)
        .when(-F.col(S.SLA) <= S.LATE_DAYS, 1)
        .otherwise(2)
    )
    return df.withColumn(S.LABEL, label.cast("int")).drop("l_suppkey")


def sides(
    spark: SparkSession, sf_dir: str, categories=None, durations: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(canonical, synthetic): the tables are joined once, and both sides read the stored lines."""
    cats = S.CATEGORICAL_COLUMNS if categories is None else categories
    wanted = {*S.DATE_COLUMNS, *cats}
    # Keys and few texts are stored: narrower than the dates and ids that follow from them.
    real = _honest(_dated(stored(_joined(spark, sf_dir, wanted)), wanted))
    return real.drop("h"), _noisy(real, durations)


def synthetic(
    spark: SparkSession, sf_dir: str, categories=None, durations: bool = True
) -> DataFrame:
    """A synthetic counterpart of every row: noisy durations, some changed categories.

    `durations=False` leaves the durations as they are, for uses that do not read them.
    """
    return _noisy(canonical(spark, sf_dir, categories, keep_h=True), durations)


def _noisy(real: DataFrame, durations: bool) -> DataFrame:
    h = F.col("h")
    columns = real.columns
    if durations:
        size = scalar(
            real.agg(*[F.round(F.stddev_samp(c), 6).alias(c) for c in S.DURATION_COLUMNS])
        )
        real = with_digests(real, F.col(S.ROW_ID), {"_n0": "noise0", "_n1": "noise1"})
        noisy = {}
        for i, c in enumerate(S.DURATION_COLUMNS):
            noise = lane_normal(F.col(f"_n{i // 4}"), i % 4)
            noisy[c] = quantised(F.col(c) + F.lit(0.03) * size[c] * noise)
        real = computed_once(real, noisy)
    real = real.select(*columns)
    changes = {}
    changes[S.LABEL] = (
        F.when(h % 19 == 0, (F.col(S.LABEL) + 1) % 3).otherwise(F.col(S.LABEL)).cast("int")
    )
    if "last_scac" in real.columns:
        changes["last_scac"] = F.when(h % 23 == 0, "DHL").otherwise(F.col("last_scac"))
    if "line_type" in real.columns:
        changes["line_type"] = F.when(h % 31 == 0, "NOVEL").otherwise(F.col("line_type"))
    return real.withColumns(changes).drop("h")


def vocabulary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carrier and service of every supplier: what the vocabulary is learned from."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.when(F.col("s_acctbal") < 0, F.lit(""))
        .otherwise(_pick(["DHL", "UPS", "FDX", "DPD", "USPS"], key % 5))
        .alias("last_scac"),
        _pick(["XS", "XP", "XG", "XE", "XD"], _div(key, 5) % 5).alias("carrier_service_code"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored test set: fold, truth, prediction and class probabilities per row."""
    df = _with_durations(deliveries(spark, sf_dir, S.DATE_COLUMNS))
    h = F.col("h")
    honest = F.when(F.col(S.SLA) >= 0, 0).when(-F.col(S.SLA) <= S.LATE_DAYS, 1).otherwise(2)
    df = df.select(
        S.ROW_ID,
        "h",
        (h % 5).cast("int").alias("fold"),
        honest.cast("int").alias("y_true"),
    ).withColumn("y_pred", ((F.col("y_true") + (h % 11 == 0).cast("int")) % 3).cast("int"))
    weight = [
        (h % (7 - 2 * k) + 1 + F.when(F.col("y_pred") == k, 8 + h % 9).otherwise(0)).cast("double")
        for k in S.LABELS
    ]
    total = weight[0] + weight[1] + weight[2]
    return df.withColumn("proba", F.array(*[w / total for w in weight])).drop("h")


def metric_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long metric table (architecture, level, seed, metric, value) aggregated from all
    deliveries: service code, strictness name by line, and order year play the keys."""
    df = _with_durations(
        deliveries(spark, sf_dir, [*S.DATE_COLUMNS, "carrier_service_code"])
    )
    level = _pick([s[0] for s in S.STRICTNESS], F.col("h") % len(S.STRICTNESS))
    wide = df.groupBy(
        F.col("carrier_service_code").alias("architecture"),
        level.alias("level"),
        F.year(S.CREATED).alias("seed"),
    ).agg(
        F.round(F.avg(S.PROMISED), 6).alias("business_utility"),
        F.round(F.avg(S.TRANSIT), 6).alias("dcr_mean"),
        F.round(F.count_if(F.col(S.TRANSIT) <= 0) * 100.0 / F.count(F.lit(1)), 6).alias("cvr"),
    )
    return wide.selectExpr(
        "architecture",
        "level",
        "seed",
        "stack(3, 'business_utility', business_utility, 'dcr_mean', dcr_mean, 'cvr', cvr)"
        " as (metric, value)",
    )


def metric_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of finished metrics per ship node, computed from all of its deliveries."""
    df = canonical(spark, sf_dir, ["last_shipnode"])
    share = {k: F.count_if(F.col(S.LABEL) == k) / F.count(F.lit(1)) for k in S.LABELS}
    base = df.groupBy(F.col("last_shipnode").alias("model")).agg(
        share[0].alias("s0"),
        share[1].alias("s1"),
        share[2].alias("s2"),
        F.avg(S.TRANSIT).alias("t"),
        F.count_if(F.col(S.TRANSIT) <= 0).alias("bad"),
        F.count(F.lit(1)).alias("n"),
    )
    c = F.col
    columns = {
        "ks_mean": 0.8 + 0.2 * c("s0"),
        "tvd_mean": 0.7 + 0.3 * c("s1"),
        "js_mean": c("s2") / 3,
        "wasserstein_mean": c("t") / 10,
        "dcr_mean": c("t") / 5,
        "dcr_min": c("t") / 50,
        "dcr_p5": c("t") / 20,
        "nnaa": 0.4 + c("s1") / 2,
        "weighted_f1": 1 - c("s1") / 2,
        "business_utility": 1 - c("s2"),
        "label2_recall": c("s0"),
        "f1_gap_vs_trtr": c("s2") / 3,
        "bus_ratio_vs_trtr": 1 - c("s2") / 2,
        "ece": c("s2") / 2,
        "brier_score_mean": c("s1") / 4,
        "transfer_25_f1": 1 - c("s2") * 0.6,
        "trtr_f1": F.lit(1.0),
        "integrity_violation_pct": c("bad") * 100.0 / c("n"),
        "hard_violation_pct": c("bad") * 100.0 / c("n"),
    }
    return base.select("model", *[F.round(v, 6).alias(k) for k, v in columns.items()])
