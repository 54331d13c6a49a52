"""Row generators: bootstrap with noise and Gaussian copula.

A generator is a function (first_id, n) -> DataFrame of rows with ids first_id … first_id
+ n - 1. Values depend on the id and the seed only, so batches never overlap and a
recomputed task draws the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.coerce import Fields, quantised
from waybill.functions.hashing import lane_normal, normal, uniform, with_digests
from waybill.functions.normal import normal_cdf, normal_quantile
from waybill.functions.small import broadcast_up_to, computed_once, materialised, shuffle_width, stored
from waybill.operators.ecdf import long_values, running_counts
from waybill.operators.ranking import hash_rank

Draw = Callable[[int, int], DataFrame]

# ---- Fixed values: noise per generator name, and lower clips of the widest one ------
NOISE = {"TVAE": 0.03, "CopulaGAN": 0.02, "CTGAN": 0.15}
CLIPS = {S.LATENCY: 0.0, S.TRANSIT: 0.01, S.PROMISED: 0.01}
CLIPPED = "CTGAN"
RANK_CLIP = 1e-4
RIDGE = 1e-6
MIN_SPREAD = 1e-9
#: Distinct values with their ranks, over all fields, that are sent to the tasks.
SENT_STEPS = 400_000


def draw_ids(spark: SparkSession, first: int, n: int, width: int) -> DataFrame:
    return spark.range(first, first + n, 1, width).withColumnRenamed("id", "draw_id")


def bootstrap_index(real: DataFrame, seed: int = 42) -> DataFrame:
    """The rows numbered in digest order: what every draw of a seed looks up, worked out once."""
    return materialised(hash_rank(real, "boot", seed).withColumnRenamed("_rank", "_index"))


def bootstrap(real: DataFrame, architecture: str = "TVAE", seed: int = 42, indexed: DataFrame | None = None) -> Draw:
    """Rows drawn with replacement, with normal noise on the durations.

    indexed: the `bootstrap_index` of the table and seed, if it is there already.
    """
    noise = NOISE[architecture]
    columns = [c for c in S.DURATION_COLUMNS if c in real.columns]
    f = Fields(real)
    stats = real.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.stddev_samp(f.number(c)), 6).alias(c) for c in columns],
    ).first()
    total = stats["n"]
    spread = {c: float(stats[c] or 0.0) for c in columns}
    indexed = bootstrap_index(real, seed) if indexed is None else indexed
    width = shuffle_width(real)

    def draw(first: int, n: int) -> DataFrame:
        key = F.col("draw_id")
        wanted = F.floor(uniform(key, "pick", seed) * F.lit(float(total))).cast("bigint") + 1
        asked = draw_ids(real.sparkSession, first, n, width).withColumn("_index", wanted)
        rows = asked.join(indexed, "_index").drop("_index", S.ROW_ID)
        rows = with_digests(rows, key, {"_j0": "jitter0", "_j1": "jitter1"}, seed)
        noisy = {}
        for i, c in enumerate(columns):
            shift = F.lit(noise * spread[c]) * lane_normal(F.col(f"_j{i // 4}"), i % 4)
            value = quantised(Fields(real).number(c) + shift)
            if architecture == CLIPPED and c in CLIPS:
                value = F.when(value < CLIPS[c], CLIPS[c]).otherwise(value)
            noisy[c] = value
        return computed_once(rows, noisy).drop("_j0", "_j1").withColumn(
            S.ROW_ID, F.concat(F.lit("S"), key.cast("string"))
        )

    return draw


# ---- Gaussian copula ------------------------------------------------------------------
def average_ranks(df: DataFrame, columns, key: str = S.ROW_ID) -> DataFrame:
    """(key, field, value, avg_rank, total_n): ties share the mean of their ranks."""
    values = long_values(df, columns, [key])
    steps = running_counts(values, {"n": F.count(F.lit(1))}).select(
        F.col("field"),
        F.col("value"),
        (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias("avg_rank"),
        "total_n",
    )
    return values.drop("bucket").join(broadcast_up_to(stored(steps), SENT_STEPS), ["field", "value"])


def copula_scores(df: DataFrame, columns, key: str = S.ROW_ID) -> DataFrame:
    """Normal scores of the ranks, one column per field."""
    share = F.col("avg_rank") / (F.col("total_n") + 1)
    clipped = F.greatest(F.lit(RANK_CLIP), F.least(F.lit(1 - RANK_CLIP), share))
    z = normal_quantile(F.col("_u"))
    scored = average_ranks(df, columns, key).withColumn("_u", clipped).withColumn("_z", z)
    return scored.groupBy(key).agg(
        *[F.max(F.when(F.col("field") == c, F.col("_z"))).alias(c) for c in columns]
    )


def usable_columns(df: DataFrame, columns):
    """(columns with spread, constant columns with their mean)."""
    f = Fields(df)
    filled = {c: F.coalesce(f.number(c), F.lit(0.0)) for c in columns}
    row = df.agg(
        *[F.coalesce(F.stddev_samp(f.number(c)), F.lit(0.0)).alias(f"{c}__sd") for c in columns],
        *[F.avg(v).alias(f"{c}__mean") for c, v in filled.items()],
    ).first()
    usable = [c for c in columns if row[f"{c}__sd"] > MIN_SPREAD]
    return usable, {c: float(row[f"{c}__mean"] or 0.0) for c in columns if c not in usable}


def filled_numbers(df: DataFrame, columns) -> DataFrame:
    f = Fields(df)
    return df.select(
        S.ROW_ID, *[F.coalesce(f.number(c), F.lit(0.0)).alias(c) for c in columns]
    )


def copula_fit(df: DataFrame, columns=None) -> DataFrame:
    """(left_field, right_field, corr): correlations of the normal scores."""
    from waybill.operators.distribution import correlation_matrix

    columns = [c for c in (columns or S.COPULA_COLUMNS) if c in df.columns]
    usable, _ = usable_columns(df, columns)
    return correlation_matrix(copula_scores(filled_numbers(df, usable), usable), usable)


def value_runs(df: DataFrame, numeric, categorical) -> DataFrame:
    """(field, start, end, value, next_value, text): every field's sorted values as runs of
    positions 0 … n-1, one row per distinct value."""
    f = Fields(df)
    parts = []
    if numeric:
        steps = running_counts(long_values(df.select(*numeric), numeric), {"n": F.count(F.lit(1))})
        parts.append(
            steps.select(
                "field",
                (F.col("cum_n") - F.col("n")).alias("start"),
                F.col("cum_n").alias("end"),
                "value",
                F.coalesce("next_value", "value").alias("next_value"),
                F.lit(None).cast("string").alias("text"),
            )
        )
    if categorical:
        cells = F.array(
            *[
                F.struct(F.lit(c).alias("field"), F.coalesce(f.category(c), F.lit("nan")).alias("text"))
                for c in categorical
            ]
        )
        counts = (
            df.select(F.explode(cells).alias("cell"))
            .groupBy("cell.field", "cell.text")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        # Any fixed order of the categories gives the same shares; digests spread them.
        slot = F.conv(F.substring(F.md5("text"), 1, 4), 16, 10).cast("int")
        counts = counts.withColumn("slot", slot)
        slots = counts.groupBy("field", "slot").agg(F.sum("n").alias("_size"))
        earlier = (
            Window.partitionBy("field").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        )
        offsets = slots.select(
            "field", "slot", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_off")
        )
        inside = (
            Window.partitionBy("field", "slot").orderBy("text").rowsBetween(Window.unboundedPreceding, 0)
        )
        parts.append(
            counts.withColumn("_cum", F.sum("n").over(inside))
            .join(offsets, ["field", "slot"])
            .select(
                "field",
                (F.col("_off") + F.col("_cum") - F.col("n")).alias("start"),
                (F.col("_off") + F.col("_cum")).alias("end"),
                F.lit(None).cast("double").alias("value"),
                F.lit(None).cast("double").alias("next_value"),
                "text",
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def lookup_positions(asked: DataFrame, runs: DataFrame, total: int, width: int) -> DataFrame:
    """Joins (draw_id, field, pos) to the run that holds floor(pos).

    Positions are cut into blocks; a run is entered once per block it touches. Inside a
    block one ordered pass carries the last run start forward, so work is linear and a run
    that holds a third of all rows only adds one row per block.
    """
    block = max(1, -(-total // (width * 64)))
    marks = runs.withColumn(
        "_block",
        F.explode(
            F.sequence(
                F.floor(F.col("start") / F.lit(block)), F.floor((F.col("end") - 1) / F.lit(block))
            )
        ),
    ).select(
        "field",
        "_block",
        F.greatest(F.col("start"), F.col("_block") * F.lit(block)).cast("double").alias("_at"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast("bigint").alias("draw_id"),
        F.struct("end", "value", "next_value", "text").alias("_run"),
    )
    wanted = asked.select(
        "field",
        F.floor(F.col("pos") / F.lit(block)).alias("_block"),
        F.col("pos").alias("_at"),
        F.lit(1).alias("_kind"),
        "draw_id",
        F.lit(None)
        .cast("struct<end:bigint,value:double,next_value:double,text:string>")
        .alias("_run"),
    )
    # A position belongs to the run that starts at or before its whole part.
    order = Window.partitionBy("field", "_block").orderBy(F.floor("_at"), "_kind", "_at")
    carried = F.last("_run", ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        marks.unionByName(wanted)
        .withColumn("_hit", carried)
        .where(F.col("_kind") == 1)
        .select("draw_id", "field", F.col("_at").alias("pos"), "_hit.*")
    )


#: Runs of all fields that are sent to the tasks; fields beyond are looked up by shuffle.
SENT_RUNS = 1 << 20


def sent_runs(runs: DataFrame, fields) -> dict[str, tuple]:
    """field -> (starts, ends, values, next values, texts) in order, the smallest fields first, while they fit `SENT_RUNS`."""
    sizes = {r["field"]: r["count"] for r in runs.groupBy("field").count().collect()}
    taken, room = [], SENT_RUNS
    for c in sorted(fields, key=lambda c: sizes.get(c, 0)):
        room -= sizes.get(c, 0)
        if room >= 0:
            taken.append(c)
    held = runs.where(F.col("field").isin(taken)).toPandas().sort_values(["field", "start"])
    kinds = {"start": "int64", "end": "int64", "value": float, "next_value": float, "text": object}
    return {c: tuple(held.loc[held["field"] == c, n].to_numpy(dtype=k) for n, k in kinds.items()) for c in taken}


def values_at(positions: DataFrame, sent: dict[str, tuple], numeric, kept) -> DataFrame:
    """(kept…, fields): what `lookup_positions` and the interpolation give for the fields' positions, from sent runs.

    positions: one double column per field, named as the field.
    """
    shared = positions.sparkSession.sparkContext.broadcast(sent)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c, (start, end, value, after, text) in shared.value.items():
                if not len(start):
                    batch[c] = None
                    continue
                pos = batch[c].to_numpy(dtype=float)
                whole = np.floor(pos)
                at = np.maximum(np.searchsorted(start, whole, side="right") - 1, 0)
                if c in numeric:
                    between = value[at] + (after[at] - value[at]) * (pos - whole)
                    batch[c] = np.where(whole + 1 < end[at], value[at], between)
                else:
                    batch[c] = text[at]
            yield batch

    kinds = dict(positions.dtypes)
    schema = [f"`{c}` {kinds[c]}" for c in kept] + [f"`{c}` {'double' if c in numeric else 'string'}" for c in sent]
    return positions.select(*kept, *sent).mapInPandas(found, ", ".join(schema))


def copula(train: DataFrame, seed: int = 42) -> Draw:
    """Fresh rows: correlated normals mapped through the empirical quantiles; categories
    and label drawn on their own from their shares."""
    numeric = [c for c in S.COPULA_COLUMNS if c in train.columns]
    categories = [c for c in S.CATEGORICAL_COLUMNS if c in train.columns]
    # The fit reads the rows many times, these columns only.
    keys = [S.ROW_ID] if S.ROW_ID in train.columns else []
    train = stored(train.select(*keys, *numeric, *categories, S.LABEL))
    usable, constants = usable_columns(train, numeric)
    discrete = [*categories, S.LABEL]

    numbers = filled_numbers(train, usable)
    pairs = copula_fit(train, numeric).collect()
    matrix = np.eye(len(usable)) * (1.0 + RIDGE)
    for left, right, corr in pairs:
        i, j = usable.index(left), usable.index(right)
        matrix[i, j] = matrix[j, i] = 0.0 if corr is None else corr
    factor = np.linalg.cholesky(matrix)
    total = train.count()
    # Every draw reads the runs; they are worked out once.
    runs = materialised(
        value_runs(numbers, usable, []).unionByName(value_runs(train, [], discrete))
    )
    sent = sent_runs(runs, [*usable, *discrete])
    width = shuffle_width(train)

    def draw(first: int, n: int) -> DataFrame:
        key = F.col("draw_id")
        base = [normal(key, f"copula{i // 4}", seed, i % 4) for i in range(len(usable))]
        normals = computed_once(
            draw_ids(train.sparkSession, first, n, width),
            {f"_g{i}": g for i, g in enumerate(base)},
        )
        spots = {}
        for i, c in enumerate(usable):
            mixed = F.lit(0.0)
            for j in range(i + 1):
                mixed = mixed + F.lit(float(factor[i, j])) * F.col(f"_g{j}")
            spots[c] = normal_cdf(mixed) * F.lit(float(total - 1))
        for c in discrete:
            spot = uniform(key, f"share-{c}", seed) * F.lit(float(total))
            spots[c] = F.floor(spot).cast("double")
        placed = normals.select("draw_id", *[v.alias(c) for c, v in spots.items()])
        rows = values_at(placed, sent, usable, ["draw_id"])
        large = [c for c in spots if c not in sent]
        if large:
            rows = rows.join(_looked_up(placed, runs, large, usable, total, width), "draw_id")
        return rows.select(
            F.concat(F.lit("S"), key.cast("string")).alias(S.ROW_ID),
            "draw_id",
            *[quantised(F.col(c)).alias(c) for c in usable],
            *[F.lit(v).alias(c) for c, v in constants.items()],
            *categories,
            F.col(S.LABEL).try_cast("int").alias(S.LABEL),
            F.lit(0.0).alias(S.DISTANCE),
        )

    return draw


def _looked_up(placed: DataFrame, runs: DataFrame, fields, numeric, total: int, width: int) -> DataFrame:
    """(draw_id, fields) by shuffle, for fields of many runs."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("pos")) for c in fields])
    asked = placed.select("draw_id", F.explode(cells).alias("cell")).select("draw_id", "cell.*")
    hits = lookup_positions(asked, runs.where(F.col("field").isin(fields)), total, width)
    share = F.col("pos") - F.floor("pos")
    stays = F.floor("pos") + 1 < F.col("end")
    number = F.when(stays, F.col("value")).otherwise(F.col("value") + (F.col("next_value") - F.col("value")) * share)
    return hits.withColumn("_number", number).groupBy("draw_id").agg(
        *[F.max(F.when(F.col("field") == c, F.col("_number" if c in numeric else "text"))).alias(c) for c in fields]
    )
