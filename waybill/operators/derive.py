"""Derived delivery columns: durations, distance, delay label, encodings, scaling."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.coerce import Fields, days_between
from waybill.functions.small import BROADCAST_ROWS, broadcast_if_small, scalar, shuffle_width
from waybill.operators.ecdf import exact_quantiles


def add_durations(df: DataFrame) -> DataFrame:
    """Dates as timestamps and the five durations in days; NULL where an input is missing."""
    f = Fields(df)
    df = df.withColumns({c: f.stamp(c) for c in S.DATE_COLUMNS if f.has(c)})
    pairs = {
        S.LATENCY: (S.CREATED, S.CAPTURE),
        S.TRANSIT: (S.SHIP, S.DELIVERY),
        S.PROMISED: (S.PROMISE_SHIP, S.PROMISE_DELIVERY),
        S.BUFFER: (S.SHIP, S.PROMISE_SHIP),
        S.SLA: (S.DELIVERY, S.PROMISE_DELIVERY),
    }
    promised = f.has(S.PROMISE_SHIP, S.PROMISE_DELIVERY)
    needs_promise = {S.PROMISED, S.BUFFER, S.SLA}
    out = {}
    for name, (start, end) in pairs.items():
        usable = promised if name in needs_promise else f.has(start, end)
        out[name] = (
            days_between(F.col(start), F.col(end)) if usable else F.lit(None).cast("double")
        )
    df = df.withColumns(out)
    return df.withColumn("transit_duration", F.col(S.TRANSIT))


def label_from_sla(sla: Column, null_label: int = 0) -> Column:
    """On time / late up to two days / later. A missing SLA takes `null_label`."""
    return (
        F.when(sla.isNull(), null_label)
        .when(sla >= 0, 0)
        .when(-sla <= S.LATE_DAYS, 1)
        .otherwise(2)
        .cast("int")
    )


def transit_cuts(df: DataFrame, column: str = S.TRANSIT) -> DataFrame:
    """One row (cut_low, cut_high): transit quantiles at the canonical class shares."""
    low, high = S.LABEL_SHARES[0], S.LABEL_SHARES[0] + S.LABEL_SHARES[1]
    marks = exact_quantiles(df.select(Fields(df).number(column).alias(column)), [column], [low, high])
    return marks.agg(
        F.min(F.when(F.col("prob") == low, F.col("quantile"))).alias("cut_low"),
        F.min(F.when(F.col("prob") == high, F.col("quantile"))).alias("cut_high"),
    )


def label_from_transit(transit: Column, cuts: Column) -> Column:
    """Quantile label; all-NULL input gives 0, a NULL among values gives 2."""
    return (
        F.when(cuts["cut_low"].isNull(), 0)
        .when(transit <= cuts["cut_low"], 0)
        .when(transit <= cuts["cut_high"], 1)
        .otherwise(2)
        .cast("int")
    )


def derive_label(df: DataFrame) -> DataFrame:
    """SLA label when any SLA is known, otherwise the transit-quantile label."""
    f = Fields(df)
    known = f.has(S.SLA) and not df.where(f.number(S.SLA).isNotNull()).isEmpty()
    if known:
        return df.withColumn(S.LABEL, label_from_sla(f.number(S.SLA)))
    cuts = scalar(transit_cuts(df))
    return df.withColumn(S.LABEL, label_from_transit(f.number(S.TRANSIT), cuts))


def zip5(col: Column) -> Column:
    code = F.regexp_extract(col, r"^(\d{5})", 1)
    return F.when(code != "", code)


def great_circle_km(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Haversine distance to a fixed point."""
    half_lat = F.sin((F.lit(lat0) * F.lit(0.017453292519943295) - F.radians(lat)) / 2)
    half_lon = F.sin((F.lit(lon0) * F.lit(0.017453292519943295) - F.radians(lon)) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat)) * F.cos(
        F.radians(F.lit(lat0))
    ) * half_lon * half_lon
    return F.lit(2.0 * S.EARTH_KM) * F.asin(F.sqrt(chord))


def add_distance(
    df: DataFrame, places: DataFrame | None, zip_column: str = "zip_code", parity: bool = False
) -> DataFrame:
    """Distance from the depot by postal code.

    `places` is (zip5, latitude, longitude). Unknown codes take the median known distance,
    or 0. `parity=True` measures along the meridian only, as the published figures do.
    """
    if places is None or zip_column not in df.columns:
        return df.withColumn(S.DISTANCE, F.lit(0.0))
    spots = places.select(
        F.col("zip5").alias("_zip5"),
        F.col("latitude").cast("double").alias("_lat"),
        F.col("longitude").cast("double").alias("_lon"),
    )
    # A code listed twice counts once, at the mean of its places.
    spots = spots.groupBy("_zip5").agg(F.avg("_lat").alias("_lat"), F.avg("_lon").alias("_lon"))
    joined = df.withColumn("_zip5", zip5(F.col(zip_column))).join(
        broadcast_if_small(spots, 100_000), "_zip5", "left"
    )
    lon = F.when(F.col("_lon").isNotNull(), F.lit(S.DEPOT_LON)) if parity else F.col("_lon")
    joined = joined.withColumn(
        S.DISTANCE, great_circle_km(F.col("_lat"), lon, S.DEPOT_LAT, S.DEPOT_LON)
    )
    middle = scalar(exact_quantiles(joined, [S.DISTANCE], [0.5]).agg(F.max("quantile").alias("m")))
    filled = F.coalesce(F.col(S.DISTANCE), middle["m"], F.lit(0.0))
    return joined.withColumn(S.DISTANCE, filled).drop("_zip5", "_lat", "_lon")


def derive_features(df: DataFrame, places: DataFrame | None = None, parity: bool = False):
    """Durations, distance and label; a table of another schema is returned unchanged."""
    if not S.is_raw_delivery_schema(df.columns):
        return df
    return derive_label(add_distance(add_durations(df), places, parity=parity))


def category_codes(df: DataFrame, columns=None) -> DataFrame:
    """(column_name, value, code): 0-based rank of each distinct value in byte order.

    Values meet in one plan for all columns. Ranks are running counts over prefix buckets
    rather than one window per column, so a high-cardinality column spreads over tasks.
    """
    columns = S.shared_columns(
        S.CATEGORICAL_COLUMNS if columns is None else columns, df.columns
    )
    f = Fields(df)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.coalesce(f.category(c), F.lit("nan")).alias("value"))
            for c in columns
        ]
    )
    values = df.select(F.explode(cells).alias("cell")).select("cell.*").distinct()
    held = values.limit(BROADCAST_ROWS + 1).collect()
    if len(held) <= BROADCAST_ROWS:
        # Few values in all: ranked where they are, without another pass over the rows.
        local = df.sparkSession.createDataFrame(held, values.schema)
        rank = F.row_number().over(Window.partitionBy("column_name").orderBy("value")) - 1
        return local.withColumn("code", rank.cast("bigint"))
    return text_ranks(values, ["column_name"], "value").withColumnRenamed("_rank", "code")


def text_ranks(values: DataFrame, by, text: str, edges: int | None = None) -> DataFrame:
    """0-based rank of distinct texts within `by`, in byte order.

    Bucket edges are a bounded sample (the values with the smallest digests), as many as the
    session's shuffles are wide; they only balance the work.
    """
    edges = edges or shuffle_width(values, 16, 256)
    from waybill.operators.ranking import prefix_rank

    sample = (
        values.select(text).distinct().orderBy(F.md5(text), text).limit(32 * edges)
    )
    drawn = sorted((r[0] for r in sample.collect()), key=lambda s: s.encode())
    bucket = F.lit(0)
    for edge in drawn[32::32]:
        bucket = bucket + (F.col(text) >= F.lit(edge)).cast("int")
    ranked = prefix_rank(values, by, bucket, [F.col(text)])
    return ranked.withColumn("_rank", (F.col("_rank") - 1).cast("bigint"))


def encode_categories(df: DataFrame, codes: DataFrame | None = None, columns=None) -> DataFrame:
    """Adds `<column>_enc`. `codes` from another table keeps one meaning per code; a value
    it lacks gets the next free code."""
    columns = S.shared_columns(
        S.CATEGORICAL_COLUMNS if columns is None else columns, df.columns
    )
    if not columns:
        return df
    codes = category_codes(df, columns) if codes is None else codes
    sizes = scalar(
        codes.groupBy().agg(
            *[
                F.count_if(F.col("column_name") == c).cast("bigint").alias(c)
                for c in columns
            ]
        )
    )
    f = Fields(df)
    small = broadcast_if_small(codes)
    for c in columns:
        own = small.where(F.col("column_name") == c).select(
            F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"{c}_enc")
        )
        df = df.join(
            own, F.coalesce(f.category(c), F.lit("nan")) == F.col(f"_v_{c}"), "left"
        ).drop(f"_v_{c}")
        df = df.withColumn(f"{c}_enc", F.coalesce(F.col(f"{c}_enc"), sizes[c]))
    return df


def feature_matrix(df: DataFrame, features=None, codes: DataFrame | None = None) -> DataFrame:
    """Encoded numeric features (NULL as 0) and the label, one column per feature."""
    names = S.resolve_features(df.columns, features)
    encoded = encode_categories(df, codes, [c[:-4] for c in names if c.endswith("_enc")])
    f = Fields(encoded)
    carry = [c for c in (S.ROW_ID, S.CREATED) if c in df.columns]
    return encoded.select(
        *carry,
        *[F.coalesce(f.number(c), F.lit(0.0)).alias(c) for c in names],
        F.col(S.LABEL).cast("int").alias(S.LABEL),
    )


def assemble(matrix: DataFrame, features) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(matrix)


def scale_stats(df: DataFrame, columns) -> DataFrame:
    """One row with mean and population spread per column, NULL counted as 0, spread 0 as 1."""
    f = Fields(df)
    filled = {c: F.coalesce(f.number(c), F.lit(0.0)) for c in columns}
    return df.agg(
        *[F.avg(v).alias(f"{c}__mean") for c, v in filled.items()],
        *[F.stddev_pop(v).alias(f"{c}__sd") for c, v in filled.items()],
    ).select(
        *[f"{c}__mean" for c in columns],
        *[
            F.when(F.col(f"{c}__sd") == 0, 1.0).otherwise(F.col(f"{c}__sd")).alias(f"{c}__sd")
            for c in columns
        ],
    )


def standardise(df: DataFrame, reference: DataFrame, columns, keep=(S.ROW_ID,)) -> DataFrame:
    """`columns` of `df` scaled with the mean and spread of `reference`."""
    stats = scalar(scale_stats(reference, columns))
    f = Fields(df)
    return df.select(
        *keep,
        *[
            ((F.coalesce(f.number(c), F.lit(0.0)) - stats[f"{c}__mean"]) / stats[f"{c}__sd"]).alias(c)
            for c in columns
        ],
    )


def drop_empty_columns(df: DataFrame, columns=None) -> DataFrame:
    """Drops the columns (of `columns`) that hold no value at all."""
    columns = list(columns or df.columns)
    filled = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if filled[c] == 0])
