"""Privacy metrics: distance to closest record, adversarial accuracy, membership inference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.coerce import Fields
from waybill.functions.small import materialised, stored
from waybill.operators.derive import scale_stats
from waybill.operators.distribution import histogram, value_summary
from waybill.operators.ecdf import add_range_buckets, running_counts
from waybill.operators.neighbours import nearest_distance
from waybill.operators.ranking import hash_rank, hash_sample

TRAIN_SHARE = 0.8
LOW_FPR = 0.01


def _columns(*tables: DataFrame, wanted=None):
    names = wanted or S.DURATION_COLUMNS
    return [c for c in names if all(c in t.columns for t in tables)]


def _scaled(tables, reference: DataFrame, columns):
    """Tables scaled by the mean and spread of `reference`, read once as a single row."""
    row = scale_stats(reference, columns).first()
    out = []
    for df in tables:
        f = Fields(df)
        z = [
            (
                (F.coalesce(f.number(c), F.lit(0.0)) - F.lit(row[f"{c}__mean"]))
                / F.lit(row[f"{c}__sd"])
            ).alias(c)
            for c in columns
        ]
        out.append(df.select(S.ROW_ID, *z))
    return out


def dcr_distances(
    real: DataFrame, synth: DataFrame, columns=None, cap: int | None = None, seed: int = 42
) -> DataFrame:
    """(row_id, distance): distance of each synthetic row to the closest real row.

    Uncapped by default. `cap` samples both sides to at most `cap` rows first, which is
    how the published figures were taken; distances then come out larger.
    """
    columns = _columns(real, synth, wanted=columns)
    real = stored(real.select(S.ROW_ID, *columns))  # for its statistics and for the search
    r, s = _scaled([real, synth], real, columns)
    if cap is not None:
        r, s = hash_sample(r, cap, "dcr-real", seed), hash_sample(s, cap, "dcr-synth", seed)
    return materialised(nearest_distance(s, r, columns))


def dcr_summary(distances: DataFrame) -> DataFrame:
    """One row (dcr_mean, dcr_min, dcr_p5, n)."""
    summary = value_summary(distances, ["distance"])
    return summary.select(
        F.round("mean", 4).alias("dcr_mean"),
        F.round("min", 4).alias("dcr_min"),
        F.round("p5", 4).alias("dcr_p5"),
        "n",
    )


def train_test_marks(synth: DataFrame, seed: int = 42) -> DataFrame:
    """Adds `is_test` to the synthetic rows: the last fifth in digest order."""
    total = synth.agg(F.count(F.lit(1)).alias("n")).scalar()
    return hash_rank(synth, "nnaa", seed).withColumn(
        "is_test", F.col("_rank") > F.floor(total * F.lit(TRAIN_SHARE))
    ).drop("_rank")


def nnaa_distances(
    real: DataFrame, synth: DataFrame, columns=None, cap: int | None = None, seed: int = 42
) -> DataFrame:
    """(row_id, d_real, d_synth): for held-out synthetic rows, the distance to the closest
    real row and to the closest other synthetic row."""
    columns = _columns(real, synth, wanted=columns)
    real, synth = (stored(d.select(S.ROW_ID, *columns)) for d in (real, synth))
    r, s = _scaled([real, synth], real, columns)
    marked = stored(train_test_marks(s, seed))
    test, train = marked.where("is_test"), marked.where(~F.col("is_test"))
    if cap is not None:
        test = hash_sample(test, cap, "nnaa-test", seed)
        r, train = hash_sample(r, cap, "nnaa-real", seed), hash_sample(train, cap, "nnaa-train", seed)
    to_real = nearest_distance(test, r, columns, out="d_real")
    to_synth = nearest_distance(test, train, columns, out="d_synth")
    return materialised(to_real.join(to_synth, S.ROW_ID))


def nnaa_score(distances: DataFrame) -> DataFrame:
    """One row (nnaa, n): share of held-out rows closer to real than to synthetic data."""
    return distances.agg(
        F.round(
            F.coalesce(F.avg((F.col("d_real") < F.col("d_synth")).cast("double")), F.lit(0.0)), 4
        ).alias("nnaa"),
        F.count(F.lit(1)).alias("n"),
    )


def distance_distributions(real: DataFrame, synth: DataFrame, bins: int = 20, digits: int | None = None):
    """Summary and histogram of all three distances: of every synthetic row to real ones (dcr), and
    of held-out rows to real (d_real) and to other synthetic rows (d_synth)."""
    closest, held = all_distances(real, synth)
    if digits is not None:
        closest = closest.withColumn("dcr", F.round("dcr", digits))
        held = held.withColumns({c: F.round(c, digits) for c in ("d_real", "d_synth")})
    tables = [distance_tables(closest, ["dcr"], bins), distance_tables(held, ["d_real", "d_synth"], bins)]
    return tuple(a.unionByName(b) for a, b in zip(*tables, strict=True))


def all_distances(real: DataFrame, synth: DataFrame, columns=None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """`dcr_distances` (as dcr) and `nnaa_distances`: every synthetic row is searched among the real ones once."""
    columns = _columns(real, synth, wanted=columns)
    real, synth = (stored(d.select(S.ROW_ID, *columns)) for d in (real, synth))
    r, s = _scaled([real, synth], real, columns)
    tag = F.concat(F.when(F.col("is_test"), "t").otherwise("n"), S.ROW_ID)
    marked = stored(train_test_marks(s, seed).withColumn("_tag", tag))
    test, train = marked.where("is_test"), marked.where(~F.col("is_test"))
    near = materialised(nearest_distance(marked, r, columns, key="_tag", out="dcr"))
    own = F.expr("substring(_tag, 2)").alias(S.ROW_ID)
    to_real = near.where(F.col("_tag").startswith("t")).select(own, F.col("dcr").alias("d_real"))
    to_synth = nearest_distance(test, train, columns, out="d_synth")
    return near.select(own, "dcr"), materialised(to_real.join(to_synth, S.ROW_ID))


def distance_tables(distances: DataFrame, columns, bins: int = 20):
    """Summary and histogram of named distance columns."""
    return value_summary(distances, columns), histogram(distances, columns, bins)


def mia_scores(
    members: DataFrame,
    non_members: DataFrame,
    synth: DataFrame,
    columns=None,
    max_query: int | None = None,
    max_synth: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """(row_id, is_member, score): minus the distance to the nearest synthetic row.

    Scaling is learned on the members. All rows of both sides are asked, whatever their sizes;
    `max_query` samples each side by digest.
    """
    columns = _columns(members, non_members, synth, wanted=columns)
    if not columns:
        return members.sparkSession.createDataFrame(
            [], f"{S.ROW_ID} string, is_member boolean, score double"
        )
    inside, outside, refs = _scaled([members, non_members, synth], members, columns)
    if max_synth is not None:
        refs = hash_sample(refs, max_synth, "mia-synth", seed)
    if max_query is not None:
        inside, outside = (hash_sample(side, max_query, "mia-query", seed) for side in (inside, outside))
    asked = inside.withColumn("is_member", F.lit(True)).unionByName(outside.withColumn("is_member", F.lit(False)))
    tagged = asked.withColumn("_tag", F.concat(F.when(F.col("is_member"), "m").otherwise("n"), S.ROW_ID))
    found = materialised(nearest_distance(tagged, refs, columns, key="_tag"))
    return found.select(
        F.expr("substring(_tag, 2)").alias(S.ROW_ID),
        (F.substring("_tag", 1, 1) == "m").alias("is_member"),
        (-F.col("distance")).alias("score"),
    )


def roc_steps(scores: DataFrame, by=()) -> DataFrame:
    """Distinct scores with positive and negative counts, running and total, per `by`."""
    marked = add_range_buckets(scores.where(F.col("score").isNotNull()), ["score"])
    values = marked.select(
        *by, F.coalesce(F.col("score_bucket").cast("int"), F.lit(0)).alias("bucket"), F.col("score").alias("value"), "is_member"
    )
    return running_counts(
        values,
        {"pos": F.count_if("is_member"), "neg": F.count_if(~F.col("is_member"))},
        by=by,
    )


def roc_auc(scores: DataFrame, by=()) -> DataFrame:
    """(by…, mia_auc): share of (member, non-member) pairs ranked right, ties half."""
    # Negatives strictly below a score, plus half of those tied with it.
    below = F.col("cum_neg") - F.col("neg") / 2.0
    return (
        roc_steps(scores, by)
        .groupBy(*by)
        .agg(
            F.round(
                F.sum(F.col("pos") * below)
                / (F.max("total_pos").cast("double") * F.max("total_neg")),
                4,
            ).alias("mia_auc")
        )
    )


def tpr_at_fpr(scores: DataFrame, low_fpr: float = LOW_FPR, by=()) -> DataFrame:
    """(by…, mia_tpr_at_fpr): largest hit rate among thresholds within the false-alarm rate."""
    # Flag everything at or above a score.
    fp = F.col("total_neg") - F.col("cum_neg") + F.col("neg")
    tp = F.col("total_pos") - F.col("cum_pos") + F.col("pos")
    allowed = fp / F.col("total_neg") <= low_fpr
    return (
        roc_steps(scores, by)
        .groupBy(*by)
        .agg(
            F.round(
                F.coalesce(F.max(F.when(allowed, tp / F.col("total_pos"))), F.lit(0.0)), 4
            ).alias("mia_tpr_at_fpr")
        )
    )

