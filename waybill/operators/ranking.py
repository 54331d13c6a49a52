"""Ranks, folds and samples without a single-task ordered window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.coerce import Fields
from waybill.functions.hashing import digest, hash_bucket
from waybill.functions.small import broadcast_if_small, shuffle_width, stored
from waybill.operators.ecdf import add_range_buckets, running_counts


def prefix_rank(df: DataFrame, by, bucket: Column, order, out: str = "_rank") -> DataFrame:
    """1-based row number within `by`, in the order of `order`.

    `bucket` must never decrease along `order`. Rows are numbered inside their bucket and
    shifted by the size of the buckets before it, so the largest task holds one bucket.
    """
    by = list(by)
    marked = df.withColumn("_group", F.struct(*by, bucket.alias("bucket")))
    sizes = marked.groupBy("_group").agg(F.count(F.lit(1)).alias("_size"))
    before = (
        Window.partitionBy(*[F.col("_group")[c] for c in by])
        .orderBy(F.col("_group")["bucket"])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        "_group", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    # Window and join share the key, so the rows are shuffled once.
    local = F.row_number().over(Window.partitionBy("_group").orderBy(*order))
    return (
        marked.withColumn("_local", local)
        .join(offsets, "_group")
        .withColumn(out, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .drop("_group", "_local", "_offset")
    )


def hash_rank(
    df: DataFrame, salt: str, seed: int = 42, by=(), key: str = S.ROW_ID, out: str = "_rank"
) -> DataFrame:
    """Row number in digest order: a reproducible shuffle of the rows within `by`.

    Digests are uniform, so buckets are even even when one `by` value holds most rows.
    """
    marked = df.withColumn("_digest", digest(F.col(key), salt, seed))
    ranked = prefix_rank(
        marked, by, hash_bucket(F.col("_digest")), [F.col("_digest"), F.col(key)], out
    )
    return ranked.drop("_digest")


#: Bins of one look at the values, and rows of a group that is small enough to be numbered.
LOOK_BINS, NUMBERED_ROWS = 1_024, 50_000


def ranked_rows(rows: DataFrame, ranks, key: str = S.ROW_ID) -> dict[int, Row]:
    """rank -> the row with that 1-based rank in the order of (_t, _digest, key), without ranking the table.

    Each look counts the rows by equal bins of what may still hold a rank, at first of `_t`, then,
    where many rows share one `_t`, of the digest. Only the rows of the last bins are numbered.
    """
    ranks = sorted(set(ranks))
    tail = F.conv(F.substring("_digest", 1, 12), 16, 10).cast("double")
    # What is searched: rows of one `_t` are told apart by their digest.
    open_parts = {None: (ranks, 0)}
    found: dict[int, Row] = {}
    while open_parts:
        looked, counts = list(open_parts), {}
        for field, value in (("_t", F.col("_t")), ("_u", tail)):
            parts = [p for p in looked if (p is not None and p[0] == "_u") == (field == "_u")]
            if parts:
                counts |= _look(rows, value, parts)
        after: dict = {}
        small: dict = {}
        for part, (wanted, before) in open_parts.items():
            up = before
            for low, high, n in counts[part]:
                inside = [r for r in wanted if up < r <= up + n]
                if inside:
                    level, fixed = ("_t", None) if part is None or part[0] == "_t" else ("_u", part[1])
                    spot = (level, fixed, low, high)
                    if n <= NUMBERED_ROWS or (level == "_u" and low == high):
                        small[spot] = (inside, up)
                    elif low == high:
                        after["_u", low, 0.0, float(16**12)] = (inside, up)
                    else:
                        after[spot] = (inside, up)
                up += n
        for spot, (inside, up) in small.items():
            # At most a bin's rows, which are few, or share `_t` and twelve digits of the digest.
            place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_t", "_digest", key))
            numbered = rows.where(_inside(spot, tail)).select("_t", "_digest", key, place.alias("_place"))
            for r in numbered.where(F.col("_place").isin([r - up for r in inside])).collect():
                found[r["_place"] + up] = r
        open_parts = after
    return found


def _inside(part, tail: Column) -> Column:
    level, fixed, low, high = part
    if level == "_t":
        return F.col("_t").between(low, high)
    return (F.col("_t") == fixed) & tail.between(low, high)


def _look(rows: DataFrame, value: Column, parts) -> dict:
    """part -> (least, most, count) of its bins that hold rows, in order."""
    ends = {}
    if parts == [None]:
        one = rows.agg(F.min("_t"), F.max("_t")).first()
        ends[None] = (F.lit(True), one[0], one[1])
    else:
        for p in parts:
            ends[p] = (_inside(p, value) if p[0] == "_u" else F.col("_t").between(p[2], p[3]), p[2], p[3])
    numbered = list(ends)
    number, bin_of = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, part in enumerate(numbered):
        test, low, high = ends[part]
        share = (value - F.lit(low)) / F.lit(max(high - low, 1e-300)) if low is not None else F.lit(0.0)
        number = F.coalesce(number, F.when(test, F.lit(i)))
        bin_of = F.coalesce(bin_of, F.when(test, F.least(F.lit(LOOK_BINS - 1), F.floor(share * LOOK_BINS)).cast("int")))
    # At most `LOOK_BINS` rows for each rank asked for.
    bins = rows.select(number.alias("p"), bin_of.alias("b"), value.alias("v")).where("p IS NOT NULL")
    out: dict = {part: [] for part in numbered}
    for r in bins.groupBy("p", "b").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).orderBy("p", "b").collect():
        out[numbered[r["p"]]].append((r["low"], r["high"], r["n"]))
    return out


def _upto(cut: Row, key: str) -> Column:
    """Rows at or before a row in the order of (_t, _digest, key)."""
    t, d, k = F.lit(cut["_t"]), F.lit(cut["_digest"]), F.lit(cut[key])
    later = (F.col("_digest") < d) | ((F.col("_digest") == d) & (F.col(key) <= k))
    return (F.col("_t") < t) | ((F.col("_t") == t) & later)


def _in_digest_order(df: DataFrame, salt: str, seed: int, key: str) -> DataFrame:
    marked = df.withColumn("_digest", digest(F.col(key), salt, seed))
    return marked.withColumn("_t", F.conv(F.substring("_digest", 1, 12), 16, 10).cast("double"))


def hash_sample(df: DataFrame, n: int, salt: str = "sample", seed: int = 42, key: str = S.ROW_ID):
    """The `n` rows with the smallest digests: all up to the n-th, which is selected, not ranked for."""
    marked = _in_digest_order(df, salt, seed, key)
    if n <= 0:
        return df.limit(0)
    cut = ranked_rows(stored(marked.select("_t", "_digest", key)), [n], key).get(n)
    return df if cut is None else marked.where(_upto(cut, key)).drop("_t", "_digest")


def member_split(
    df: DataFrame, fraction: float = 0.5, seed: int = 42, label: str = S.LABEL, key: str = S.ROW_ID
) -> DataFrame:
    """Adds `is_member`: about `fraction` of every label, chosen by digest."""
    by = [label] if label in df.columns else []
    ranked = hash_rank(df, "member", seed, by, key)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        # Labels are few: their sizes go to the rows, not the rows to their labels.
        sizes = broadcast_if_small(sizes.withColumnRenamed(label, "_label"))
        ranked = ranked.join(sizes, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    else:
        ranked = ranked.withColumn("_n", sizes.scalar())
    return ranked.withColumn(
        "is_member", F.col("_rank") <= F.bround(F.col("_n") * F.lit(fraction)).cast("bigint")
    ).drop("_rank", "_n")


def stratified_cap(
    df: DataFrame, cap: int, seed: int = 42, label: str = S.LABEL, key: str = S.ROW_ID
) -> DataFrame:
    """At most `cap` rows, each label keeping its share (rounded down per label)."""
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = hash_rank(df, "cap", seed, [label], key).join(
        broadcast_if_small(sizes), F.col(label).eqNullSafe(F.col("_label"))
    )
    quota = F.when(total <= cap, F.col("_n")).otherwise(
        F.floor(F.lit(float(cap)) * F.col("_n") / total)
    )
    return ranked.where(F.col("_rank") <= quota).drop("_rank", "_n", "_label")


def stratified_folds(
    df: DataFrame, k: int = 5, seed: int = 42, label: str = S.LABEL, key: str = S.ROW_ID
) -> DataFrame:
    """Adds `fold` 0..k-1; every fold has the label mix of the table."""
    ranked = hash_rank(df, "fold", seed, [label], key)
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def time_column(df: DataFrame) -> str | None:
    return next((c for c in S.TIME_SORT_COLUMNS if c in df.columns), None)


def time_rank(df: DataFrame, key: str = S.ROW_ID, column: str | None = None) -> DataFrame:
    """Adds `_rank` (1-based) by time, NULL last, ties in digest order.

    Distinct (time, digest slice) groups get running counts; only rows of one group are
    numbered together, so a timestamp shared by many rows is spread over many groups: 256, or
    more where the session shuffles wider.
    """
    column = column or time_column(df)
    digits = max(2, math.ceil(math.log(shuffle_width(df), 16)))
    digest_col = F.md5(F.col(key))
    marked = df.withColumn("_digest", digest_col).withColumn(
        "_slice", F.conv(F.substring("_digest", 1, digits), 16, 10).cast("int")
    )
    if column:
        micros = F.unix_micros(Fields(df).stamp(column)).cast("double")
        marked = marked.withColumn("_t", F.coalesce(micros, F.lit(float("inf"))))
    else:
        marked = marked.withColumn("_t", F.lit(0.0))
    groups = add_range_buckets(
        marked.groupBy("_t", "_slice").agg(F.count(F.lit(1)).alias("_size")), ["_t"]
    ).select(
        F.coalesce(F.col("_t_bucket").cast("int"), F.lit(0)).alias("bucket"),
        F.struct("_t", "_slice").alias("value"),
        "_size",
    )
    starts = running_counts(groups, {"n": F.sum("_size")}, by=()).select(
        F.col("value._t").alias("_t"),
        F.col("value._slice").alias("_slice"),
        (F.col("cum_n") - F.col("n")).alias("_start"),
        F.col("total_n").alias("_total"),
    )
    local = F.row_number().over(Window.partitionBy("_t", "_slice").orderBy("_digest", key))
    return (
        marked.withColumn("_local", local)
        .join(starts, ["_t", "_slice"])
        .withColumn("_rank", F.col("_start") + F.col("_local"))
        .drop("_t", "_slice", "_digest", "_local", "_start")
    )


def _in_time_order(df: DataFrame, key: str) -> DataFrame:
    """Adds `_t`, with a missing time after all others, and the digest that orders ties."""
    column = time_column(df)
    micros = F.unix_micros(Fields(df).stamp(column)).cast("double") if column else F.lit(0.0)
    return df.withColumns({"_t": F.coalesce(micros, F.lit(1e19)), "_digest": F.md5(F.col(key))})


def time_folds(df: DataFrame, k: int = 5, key: str = S.ROW_ID) -> DataFrame:
    """Adds `fold`: the last k equal blocks in time are folds 1..k, everything before is 0.

    Fold i is tested on the rows with fold = i and trained on those with fold < i. The k rows at
    which folds begin are selected; a row's fold follows by comparison, no row is ranked.
    """
    marked = stored(_in_time_order(df, key))  # for the selection and for the folds
    order = marked.select("_t", "_digest", key)
    n = order.count()
    if n <= k:
        raise ValueError(f"{n} rows are too few for {k} time folds")
    size = n // (k + 1)
    head = n - k * size
    cuts = ranked_rows(order, [head + i * size for i in range(k)], key)
    fold = F.lit(k)
    for i in reversed(range(k)):
        fold = F.when(_upto(cuts[head + i * size], key), F.lit(i)).otherwise(fold)
    return marked.withColumn("fold", fold.cast("int")).drop("_t", "_digest")


def time_holdout(df: DataFrame, share: float = 0.2, key: str = S.ROW_ID) -> DataFrame:
    """Adds `is_test`: the latest `share` of rows, at least one row on either side."""
    marked = stored(_in_time_order(df, key))
    order = marked.select("_t", "_digest", key)
    n = order.count()
    tested = min(max(round(n * share), 1), n - 1)
    if not n:
        return marked.withColumn("is_test", F.lit(False)).drop("_t", "_digest")
    cut = ranked_rows(order, [n - tested], key)[n - tested]
    return marked.withColumn("is_test", ~_upto(cut, key)).drop("_t", "_digest")


def top_features(ranking: DataFrame, top_k: int | None = None, min_score: float | None = None):
    """Features by falling score; at least one stays. `ranking` is (feature, score)."""
    order = [F.col("score").desc(), F.col("feature")]
    kept = ranking if min_score is None else ranking.where(F.col("score") >= min_score)
    if kept.isEmpty():
        return ranking.orderBy("feature").limit(1)
    return kept.orderBy(*order).limit(max(1, int(top_k))) if top_k is not None else kept.orderBy(*order)
