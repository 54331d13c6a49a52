"""Neighbour search, membership inference, generators, adapters, streams and models."""

import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from waybill import schema as S
from waybill.functions.small import computed_once
from waybill.operators import neighbours, oversample, privacy, ranking, repair, resample, synth
from waybill.plans import generate as gen
from waybill.sources import driver_tables as D
from waybill.sources import order_lines, sinks

AXES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def clouds(spark):
    """References of which a third are one vector; queries near and far."""
    rng = np.random.default_rng(3)
    refs = rng.normal(size=(1500, 3)).round(2)
    refs[:500] = [0.5, 0.5, 0.5]
    queries = np.concatenate([refs[rng.integers(0, 1500, 300)] + rng.normal(0, 0.02, (300, 3)), rng.normal(0, 6, (40, 3))])

    def table(points, prefix):
        data = pd.DataFrame(points, columns=AXES)
        data.insert(0, "row_id", [f"{prefix}{i:05d}" for i in range(len(data))])
        return spark.createDataFrame(data)

    return refs, queries, table(refs, "r"), table(queries, "q")


@pytest.mark.parametrize("limit,cell", [(100_000, 4096), (10, 50)])
def test_nearest_distance_is_exact(clouds, limit, cell):
    refs, queries, r, q = clouds
    got = neighbours.nearest_distance(q, r, AXES, broadcast_rows=limit, cell_rows=cell).toPandas()
    want = np.sqrt(((queries[:, None] - refs[None]) ** 2).sum(2)).min(1)
    assert np.allclose(got.sort_values("row_id").distance.to_numpy(), want, atol=1e-12)


@pytest.mark.parametrize("limit,cell", [(100_000, 4096), (10, 50)])
def test_nearest_rows_are_exact(clouds, limit, cell):
    refs, queries, r, q = clouds
    got = neighbours.nearest_rows(q, r, AXES, 4, broadcast_rows=limit, cell_rows=cell).toPandas()
    dist = np.zeros((len(queries), len(refs)))
    for j in range(3):
        diff = queries[:, j][:, None] - refs[:, j][None, :]
        dist += diff * diff
    order = np.argsort(dist, axis=1, kind="stable")[:, :4]
    want = [[f"r{i:05d}" for i in row] for row in order]
    assert [list(v) for v in got.sort_values("row_id").neighbours] == want


def test_groups_are_searched_apart(spark, clouds):
    refs, queries, r, q = clouds
    group = F.pmod(F.xxhash64("row_id"), F.lit(3)).cast("int")
    left, right = q.withColumn("g", group), r.withColumn("g", group).where("g < 2")
    of_q = left.orderBy("row_id").toPandas()["g"].to_numpy()
    of_r = r.withColumn("g", group).orderBy("row_id").toPandas()["g"].to_numpy()
    dist = np.sqrt(((queries[:, None] - refs[None]) ** 2).sum(2))
    dist[(of_q[:, None] != of_r[None]) | (of_r[None] == 2)] = np.inf
    for limit, cell in ((100_000, 4096), (10, 40)):
        got = neighbours.nearest_distance(left, right, AXES, group="g", broadcast_rows=limit, cell_rows=cell)
        got = got.toPandas().sort_values("row_id").distance.fillna(np.inf).to_numpy()
        assert np.allclose(got, dist.min(1), atol=1e-12)


def test_a_far_query_visits_few_cells(spark):
    """References in a cube, queries far outside: only cells on the near side can matter."""
    rng = np.random.default_rng(8)
    points = rng.random((6000, 3))
    far = np.concatenate([rng.random((20, 3)) + [1000, 0, 0], rng.random((20, 3)) * 0.2 - [50, 50, 50]])
    table = lambda x: spark.createDataFrame(pd.DataFrame(x, columns=AXES))
    asked = table(far).withColumn("_key", F.monotonically_increasing_id().cast("string"))
    got = neighbours.visited(asked, table(points), AXES, cell_rows=30).toPandas()
    want = np.sort(((far[:, None] - points[None]) ** 2).sum(2).min(1))
    assert np.allclose(np.sort(got["_best"]), want, rtol=1e-12)
    assert got["_visits"].max() < 100  # of more than 200 cells


def test_queries_among_the_references_need_two_rounds(spark, monkeypatch):
    """The first visit follows the split and asks for what remains; no look at the boxes comes before it."""
    rng = np.random.default_rng(9)
    points, near = rng.random((4000, 3)), rng.random((300, 3))
    rounds, visit = [], neighbours._visit
    monkeypatch.setattr(neighbours, "_visit", lambda *a: rounds.append(1) or visit(*a))
    table = lambda x: spark.createDataFrame(pd.DataFrame(x, columns=AXES))
    asked = table(near).withColumn("_key", F.monotonically_increasing_id().cast("string"))
    got = neighbours.visited(asked, table(points), AXES, cell_rows=200).toPandas()
    want = np.sort(((near[:, None] - points[None]) ** 2).sum(2).min(1))
    assert np.allclose(np.sort(got["_best"]), want, rtol=1e-12)
    assert len(rounds) <= 2


def test_large_cells_are_split_again(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "FAN", 4)
    points = spark.createDataFrame(pd.DataFrame(np.random.default_rng(2).normal(size=(3000, 3)) ** 3, columns=AXES))
    sizes = neighbours._cells(points, AXES, 40).groupBy("_cell").count().toPandas()["count"]
    assert sizes.sum() == 3000 and sizes.max() <= 40 and len(sizes) > 4 * 4 * 4


def test_nearest_without_references(clouds):
    _, _, r, q = clouds
    got = neighbours.nearest_distance(q, r.limit(0), AXES)
    assert got.where("distance is not null").isEmpty() and got.count() == 340


def test_auc_and_tpr(spark):
    rng = np.random.default_rng(5)
    score = rng.normal(size=400).round(1)
    member = rng.random(400) < 0.5
    score[member] += 0.4
    df = spark.createDataFrame(pd.DataFrame({"row_id": [str(i) for i in range(400)], "is_member": member, "score": score}))
    pos, neg = score[member], score[~member]
    want = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    assert privacy.roc_auc(df).first()[0] == pytest.approx(want, abs=1e-4)
    best = max([(pos >= t).mean() for t in np.unique(score) if (neg >= t).mean() <= 0.01], default=0.0)
    assert privacy.tpr_at_fpr(df).first()[0] == pytest.approx(best, abs=1e-4)


def test_membership_shows_up_for_copies(spark):
    real = ranking.member_split(D.canonical(spark, SMALL, []))
    members, others = real.where("is_member"), real.where("not is_member")
    copied = privacy.roc_auc(privacy.mia_scores(members, others, members)).first()[0]
    assert copied > 0.75
    # Few members are scored as well, and the larger side keeps all its rows.
    few = privacy.mia_scores(members.limit(2), others, members).groupBy("is_member").count()
    assert {r.is_member: r["count"] for r in few.collect()} == {True: 2, False: others.count()}


def test_distances_of_a_copy_are_zero(spark):
    real = D.canonical(spark, SMALL, [])
    got = privacy.dcr_summary(privacy.dcr_distances(real, real)).first()
    assert (got.dcr_mean, got.n) == (0.0, real.count())
    capped = privacy.dcr_summary(privacy.dcr_distances(real, real, cap=100)).first()
    assert capped.n == 100 and capped.dcr_mean > 0


def test_bootstrap_is_reproducible_and_batches_differ(spark, proxy):
    draw = synth.bootstrap(proxy, "CTGAN")
    a, b = draw(0, 200), synth.bootstrap(proxy.repartition(5), "CTGAN")(0, 200)
    assert a.select(sorted(a.columns)).exceptAll(b.select(sorted(a.columns))).isEmpty()
    assert draw(200, 200).join(a, S.ROW_ID, "left_semi").isEmpty()
    assert a.agg(F.min(S.TRANSIT)).first()[0] >= 0.01


def test_resampling_reaches_the_target(spark):
    real = D.canonical(spark, SMALL, ["last_scac", "carrier_service_code"])
    rows, stats = resample.resample_to_target(synth.bootstrap(real), 500, repair.rejection_filter)
    got = stats.first()
    assert rows.count() == 500 and not got.cap_hit and got.drawn > 500
    assert rows.exceptAll(repair.rejection_filter(rows)).isEmpty()
    rows, none = resample.resample_to_target(synth.bootstrap(real), 50, lambda d: d.where("1 = 0"), 8)
    assert none.first().cap_hit and (none.first().drawn, none.first().status) == (400, "limit") and rows.isEmpty()
    rows, empty = resample.resample_to_target(synth.bootstrap(real), 0)
    assert rows.isEmpty() and empty.first().drawn == 0
    # The n-th survivor ends the draws, wherever batches and blocks end.
    odd = lambda d: d.where("draw_id % 37 = 5")
    rows, stats = resample.resample_to_target(synth.bootstrap(real), 300, odd)
    assert stats.first().drawn == 37 * 299 + 6 and rows.agg(F.max("draw_id")).first()[0] == 37 * 299 + 5


def test_rare_survivors_are_waited_for(spark):
    """One in 250,000 survives; impossible filters end by the bound on their rate."""
    numbers = lambda first, n: spark.range(first, first + n, 1, 4).withColumnRenamed("id", "draw_id")
    rare = lambda d: d.withColumn("_keep_kept", F.col("draw_id") % 250_000 == 249_999)
    rows, stats = resample.resample_to_target(numbers, 10, mark=rare)
    got = stats.first()
    assert (rows.count(), got.drawn, got.status, got.cap_hit) == (10, 2_500_000, "full", False)
    never = lambda d: d.withColumn("_keep_kept", F.lit(False))
    rows, stats = resample.resample_to_target(numbers, 10, mark=never, least_rate=1e-6)
    got = stats.first()
    assert (got.status, got.survived, got.cap_hit) == ("rare", 0, True) and 3e6 <= got.drawn < 1e8
    assert rows.isEmpty()


def test_pool_cuts_every_run_and_filter(spark):
    numbers = lambda first, n: spark.range(first, first + n, 1, 4).withColumnRenamed("id", "draw_id")
    by = lambda *steps: lambda d: d.withColumns({f"_keep_f{i}": F.col("draw_id") % s == 1 for i, s in enumerate(steps)})
    pool = resample.draw_pool({"a": (numbers, by(3, 7)), "b": (numbers, by(1000, 2))}, 900, ["f0", "f1"])
    want = {("a", "f0"): 3, ("a", "f1"): 7, ("b", "f0"): 1000, ("b", "f1"): 2}
    assert {k: (c.drawn, c.survived) for k, c in pool.cuts.items()} == {k: (s * 899 + 2, 900) for k, s in want.items()}
    got = {(r.run, bit): r.n for bit in (0, 1) for r in pool.survivors().where(f"mask & {1 << bit} > 0").groupBy("run").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", 0): 900, ("a", 1): 900, ("b", 0): 900, ("b", 1): 900}


def test_full_filters_store_no_more_rows(spark, monkeypatch):
    """Of a filter that all rows pass only the ids near its n-th are stored, however far another one draws."""
    monkeypatch.setattr(resample, "PILOT_ROWS", 500)
    draw = lambda first, n: spark.range(first, first + n).withColumnRenamed("id", "draw_id")
    mark = lambda df: df.withColumns({"_keep_all": F.lit(True), "_keep_few": F.col("draw_id") % 50 == 0})
    pool = resample.draw_pool({"r": (draw, mark)}, 600, ["all", "few"])
    assert pool.cuts["r", "all"] == resample.Cut(600, 600, "full")
    assert pool.cuts["r", "few"] == resample.Cut(599 * 50 + 1, 600, "full")
    assert pool.rows.where("_keep_all").count() < 2_000
    assert pool.survivors().count() == 600 + 600 - 12


def test_tiers_of_the_same_draws_are_drawn_once(spark, proxy):
    made, calls = synth.copula(proxy), []
    counted = lambda *a: calls.append(a) or made(*a)
    got = gen.overdraws(counted, ["none", "strict"], 200, [S.LABEL])
    assert len(calls) == 1
    for level, rows in got.items():
        want = gen.overdraw(made, level, 200).select("draw_id", S.LABEL).collect()
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want))


def test_formulas_computed_once_share_their_parts(spark):
    df = computed_once(spark.range(3), {"a": F.sha2(F.col("id").cast("string"), 256), "b": F.length(F.sha2(F.col("id").cast("string"), 256))})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "Generate" in line and "sha2" not in line]
    assert [r["b"] for r in df.collect()] == [64] * 3


def test_uniforms_reach_every_row_of_a_large_table(spark):
    from waybill.functions.hashing import uniform

    drawn = spark.range(2000).select((F.floor(uniform(F.col("id"), "pick") * F.lit(1e12)) % 1000).alias("low"))
    # 32 bits would leave gaps of 233: low digits then come in few steps.
    assert drawn.distinct().count() > 800


def test_strict_level_holds_with_many_pairs(spark):
    from waybill.operators import ladder

    train = spark.range(500).selectExpr("cast(id as string) AS last_scac", "'c' AS carrier_service_code")
    rows = spark.range(600).selectExpr("cast(id as string) AS last_scac", "'c' AS carrier_service_code")
    assert ladder.ladder_filter(rows, "moderate", train).count() == 600
    assert ladder.ladder_filter(rows, "strict", train).count() == 500


def test_copula_keeps_shapes(spark, proxy):
    rows = synth.copula(proxy)(0, 2000).cache()
    assert rows.count() == 2000
    for c in (S.TRANSIT, S.PROMISED, S.SLA):
        real, made = proxy.agg(F.avg(c), F.stddev(c)).first(), rows.agg(F.avg(c), F.stddev(c)).first()
        assert made[0] == pytest.approx(real[0], abs=0.15) and made[1] == pytest.approx(real[1], rel=0.2)
    assert rows.where(F.col(S.LABEL).isNull()).isEmpty()
    known = {r[0] for r in proxy.select("last_scac").distinct().collect()}
    assert {r[0] for r in rows.select("last_scac").distinct().collect()} <= known
    a, b = proxy.corr(S.PROMISED, S.TRANSIT), rows.corr(S.PROMISED, S.TRANSIT)
    assert a == pytest.approx(b, abs=0.15)
    kept = gen.overdraw(synth.copula(proxy), "strict", 300)
    assert kept.count() <= 300 and kept.where(F.col(S.TRANSIT) <= 0).isEmpty()


def test_levels_tighten(spark):
    real = D.canonical(spark, SMALL, ["last_scac", "carrier_service_code"])
    rates = [gen.generate(real, level, n=300)[1].first().survival_rate for level, _, _ in S.STRICTNESS]
    assert rates == sorted(rates, reverse=True)


@pytest.mark.parametrize("limit", [100_000, 20])
def test_smote_balances_and_interpolates(spark, limit):
    rng = np.random.default_rng(7)
    data = pd.DataFrame(rng.normal(size=(260, 3)).round(3), columns=AXES)
    data.insert(0, "row_id", [f"r{i:04d}" for i in range(260)])
    data[S.LABEL] = [0] * 180 + [1] * 60 + [2] * 20
    made = oversample.smote_rows(spark.createDataFrame(data), AXES, broadcast_rows=limit).toPandas()
    assert made[S.LABEL].value_counts().to_dict() == {1: 120, 2: 160}
    points = data.set_index("row_id")
    for row in made.itertuples():
        own = points[points[S.LABEL] == points.loc[row.base_id, S.LABEL]][AXES].to_numpy()
        base, other = points.loc[row.base_id, AXES].to_numpy(float), points.loc[row.neighbour_id, AXES].to_numpy(float)
        assert np.allclose([row.a, row.b, row.c], base + row.share * (other - base))
        rank = (((own - base) ** 2).sum(1) < ((other - base) ** 2).sum() - 1e-12).sum()
        assert 1 <= rank <= 5


def test_csv_adapters(spark, tmp_path):
    lines = tmp_path / "lines.csv"
    lines.write_bytes(
        "order date (DateOrders),shipping date (DateOrders),Days for shipping (real),Days for shipment (scheduled),Order Id,Type,Order Region\n"
        "1/31/2018 22:56,2/3/2018 22:56,3,4,77,DEBIT,Sud América\n"
        "1/13/2018 12:27,1/18/2018 12:27,-2,1,78,CASH,Asia\n"
        "never,1/18/2018 12:27,5,1,79,CASH,Asia\n".encode("latin-1")
    )
    got = order_lines.load_order_lines(spark, str(lines)).orderBy("order_no").collect()
    assert [(r.order_no, r.transit_duration_days, r.sla_buffer, r.delay_label) for r in got] == [("77", 3.0, 1.0, 0), ("78", 0.0, 1.0, 0)]
    assert got[0].dpe_shipnode == "Sud América" and got[0].last_scac == "UNK"
    old = tmp_path / "old.csv"
    old.write_text(
        "order_timestamp,shipping_date,delivery_date_actual,fc_id,carrier,service_level,promised_date\n"
        "2024-01-01 10:00:00,2024-01-02,2024-01-05,F1,DHL,XP,2024-01-04\n"
    )
    row = order_lines.load_deliveries(spark, str(old)).first()
    assert row.delay_label == 1 and row.item_id == "ITEM_UNKNOWN" and row.capture_latency_days == pytest.approx(2 / 24)
    bad = tmp_path / "bad.csv"
    bad.write_text("x\n1\n")
    with pytest.raises(ValueError):
        order_lines.load_deliveries(spark, str(bad))


def test_raw_csv_round_trip_and_sinks(spark, proxy, tmp_path):
    path = str(tmp_path / "raw")
    sinks.write_csv(proxy.drop(*S.DURATION_COLUMNS, "transit_duration", S.DISTANCE, S.LABEL), path)
    back = order_lines.load_deliveries(spark, path)
    assert back.count() == 500 and back.where(F.col(S.TRANSIT) <= 0).isEmpty()
    paths = sinks.write_report({"rows": proxy.limit(5), "by": proxy.limit(4).withColumn("architecture", F.lit("TVAE"))}, str(tmp_path / "out"), "json")
    assert spark.read.json(paths["rows"]).count() == 5
    assert spark.read.json(paths["by"]).first().architecture == "TVAE"


def test_feature_width(proxy):
    assert len(S.resolve_features(proxy.columns)) == 11
    assert S.shared_columns(["a", "b"], ["b", "c"]) == ["b"]


def test_stream_equals_batch(spark, proxy, tmp_path):
    from waybill.operators.audit import flag_hard
    from waybill.streaming import audit_stream as A

    damaged = proxy.withColumn(S.TRANSIT, F.when(F.hash("row_id") % 5 == 0, -1.0).otherwise(F.col(S.TRANSIT)))
    path = str(tmp_path / "in")
    damaged.write.parquet(path)
    stream = A.flag_stream(A.parquet_stream(spark, path))
    got = A.run_once(stream.select(S.ROW_ID, "quarantined"))
    want = flag_hard(damaged).select(S.ROW_ID, "quarantined")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_registered_keys_match():
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert len(queries) > 100


def test_streams_carry_state_over_batches_and_drop_late_rows(spark, tmp_path):
    import time

    from waybill.streaming import audit_stream as A

    files = [
        [("a", "2024-01-01 10:00:00", True), ("b", "2024-01-05 10:00:00", False)],
        [("a", "2024-01-01 10:00:00", True), ("c", "2024-01-06 10:00:00", True)],
        [("d", "2024-03-01 10:00:00", False)],
        # Two months late: its window is closed.
        [("e", "2024-01-02 10:00:00", True), ("f", "2024-03-02 10:00:00", False)],
    ]
    path = str(tmp_path / "rows")
    for rows in files:
        frame = spark.createDataFrame(rows, "id string, ts string, quarantined boolean")
        frame.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # the source takes files by their time
    stream = A.parquet_stream(spark, path, files_per_batch=1)
    rates = A.latest_batch(A.run_once(A.window_rates(stream, "ts"), "update"), ["window_start"])
    got = {str(r.window_start.date()): (r.n, r.violations) for r in rates.collect()}
    # Counts add up over batches; "e" is dropped.
    assert got == {"2023-12-28": (2, 2), "2024-01-04": (2, 1), "2024-02-29": (2, 0)}
    # "a" came twice in batches of its own; "e" is too late to be told from a repeat.
    once = A.run_once(A.drop_repeats(A.parquet_stream(spark, path, files_per_batch=1), "id", "ts", "1 day"))
    assert sorted(r.id for r in once.collect()) == ["a", "b", "c", "d", "f"]


def test_an_empty_stream_gives_an_empty_table(spark, tmp_path):
    from waybill.streaming import audit_stream as A

    path = str(tmp_path / "none")
    spark.createDataFrame([], "ts timestamp, quarantined boolean").coalesce(1).write.parquet(path)
    out = A.run_once(A.window_rates(A.parquet_stream(spark, path), "ts"), "update")
    assert out.count() == 0 and "batch" in out.columns


def test_late_rows_are_counted_and_progress_is_kept(spark, tmp_path):
    import time

    from waybill.streaming import audit_stream as A

    files = [
        [("2024-01-01 10:00:00", True), ("2024-01-05 10:00:00", False), (None, True)],
        [("2024-01-04 09:00:00", None), ("2024-01-03 10:00:00", True), ("2024-01-06 10:00:00", True)],
        [],
        [("2024-01-01 11:00:00", True), ("2024-01-05 11:00:00", True)],
    ]
    path, state = str(tmp_path / "rows"), str(tmp_path / "state")
    want = {"2024-01-01": (1, 1, 1), "2024-01-03": (0, 0, 1), "2024-01-04": (1, 0, 0), "2024-01-05": (2, 1, 0), "2024-01-06": (1, 1, 0)}

    def rows(k):
        frame = spark.createDataFrame(files[k], "ts string, quarantined boolean")
        frame.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)

    def rates(folder):
        stream = A.parquet_stream(spark, path, files_per_batch=1)
        found = A.rates_with_late(stream, folder, "ts", "1 day", "1 day").collect()
        return {str(r.window_start.date()): (r.n, r.violations, r.n_late) for r in found}

    for k in range(4):
        rows(k)
        got = rates(state)  # a restart from the stored progress each time
        time.sleep(1.1)  # the source takes files by their time
    assert got == want
    assert rates(state) == want  # nothing new, nothing counted twice
    assert rates(str(tmp_path / "afresh")) == want  # all files in one run, a batch each


def test_late_rows_of_an_empty_stream(spark, tmp_path):
    from waybill.streaming import audit_stream as A

    path = str(tmp_path / "none")
    spark.createDataFrame([], "ts timestamp, quarantined boolean").coalesce(1).write.parquet(path)
    out = A.rates_with_late(A.parquet_stream(spark, path), str(tmp_path / "state"), "ts")
    assert out.count() == 0 and out.columns == ["window_start", "n", "violations", "n_late"]


def test_distributions_search_the_real_rows_once(spark, monkeypatch):
    """Held-out rows take their distance to real rows from the search of all rows; keys may repeat."""
    rows = [(f"r{i % 35}", float(i * i % 17), float(i % 7)) for i in range(40)]
    real = spark.createDataFrame(rows, [S.ROW_ID, S.TRANSIT, S.PROMISED])
    synth = real.withColumn(S.TRANSIT, F.col(S.TRANSIT) + 0.3)
    want = [privacy.dcr_distances(real, synth), privacy.nnaa_distances(real, synth)]
    searched, search = [], privacy.nearest_distance

    def watched(asked, refs, *args, **options):
        searched.append((asked.count(), refs.count()))
        return search(asked, refs, *args, **options)

    monkeypatch.setattr(privacy, "nearest_distance", watched)
    privacy.distance_distributions(real, synth)
    held = round(40 * 0.2)
    assert sorted(searched) == [(held, 40 - held), (40, 40)]
    for got, old in zip(privacy.all_distances(real, synth), want, strict=True):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, old.select(S.ROW_ID, *old.columns[1:]).collect()))


def test_membership_reads_the_split_from_storage(spark, monkeypatch):
    from waybill.plans import registered_privacy as plans

    values = {c: (F.col("id") * (i + 3) % 11).cast("double") for i, c in enumerate(S.DURATION_COLUMNS)}
    rows = spark.range(60).select(F.concat(F.lit("r"), "id").alias(S.ROW_ID), (F.col("id") % 3).cast("int").alias(S.LABEL), *[v.alias(c) for c, v in values.items()])
    monkeypatch.setattr(plans.D, "canonical", lambda *_: rows)
    monkeypatch.setattr(plans.D, "synthetic", lambda *_: rows)
    kept, store = [], plans.stored
    monkeypatch.setattr(plans, "stored", lambda df: kept.append(df.columns) or store(df))
    scores = plans._mia(spark, "")
    assert ["is_member" in columns for columns in kept] == [False, True]
    # The synthetic rows are copies of the members.
    assert scores.count() == 60 and scores.where("is_member AND score < 0").isEmpty()


def test_block_settles_ties_by_id_without_comparing_texts():
    rng = np.random.default_rng(5)
    points, asked = (rng.integers(0, 4, size=(n, 3)).astype(float) for n in (400, 60))
    ids = np.array([f"r{i * 37 % 400}" for i in range(400)], dtype=object)
    half, k = 250, 6
    dist, found = np.full((60, k), np.inf), np.full((60, k), "", dtype=object)
    for part in (slice(0, half), slice(half, None)):
        dist, found = neighbours.Block(points[part]).nearest_rows(asked, ids[part], dist, found)
    gaps = ((asked[:, None] - points[None]) ** 2).sum(axis=2)
    for i in range(60):
        assert list(found[i]) == [n for _, n in sorted(zip(gaps[i], ids))[:k]]
    few = neighbours.Block(points[:2]).nearest_places(asked, np.array([1, 0]), np.full((60, k), np.inf), np.full((60, k), -1))
    assert (np.sort(few[1], axis=1) == [-1, -1, -1, -1, 0, 1]).all()


def test_copula_draws_are_the_same_by_sent_runs_and_by_shuffle(spark, proxy, monkeypatch):
    train = proxy.select(S.ROW_ID, S.TRANSIT, S.PROMISED, S.BUFFER, "last_scac", S.LABEL)
    with monkeypatch.context() as m:
        m.setattr(synth, "lookup_positions", None)
        sent = {tuple(r) for r in synth.copula(train)(0, 300).collect()}
    for most in (0, 10):
        monkeypatch.setattr(synth, "SENT_RUNS", most)
        shuffled = {tuple(r) for r in synth.copula(train)(0, 300).collect()}
        assert len(sent) == 300 and shuffled == sent


def test_tables_leave_no_shuffles_and_searches_no_wide_rows(spark):
    """Disk holds what is read later: stored rows, keys and distances."""
    from waybill.functions.small import shared_folder, stored

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        return {n for n in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in n}

    before, kept = shuffled(), set(os.listdir(shared_folder(spark)))
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame(pd.DataFrame(rng.normal(size=(600, 2)), columns=["x", "y"])).withColumn("_key", F.monotonically_increasing_id())
    mixed = stored(rows.repartition(3, "x"))
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and mixed.count() == 600
    asked = rows.withColumn("x", F.col("x") + 0.7)
    got = neighbours.visited(asked, mixed.select("x", "y"), ["x", "y"], cell_rows=40).toPandas().set_index("_key")
    refs, points = rows.toPandas(), asked.toPandas()
    gaps = points[["x", "y"]].to_numpy()[:, None, :] - refs[["x", "y"]].to_numpy()[None, :, :]
    assert got.loc[points["_key"], "_best"].to_numpy() == pytest.approx((gaps**2).sum(axis=2).min(axis=1))
    assert got["_visits"].max() > 2
    folders = [f"{shared_folder(spark)}/{n}" for n in set(os.listdir(shared_folder(spark))) - kept if n.startswith("waybill-")]
    assert folders and not any("_own" in spark.read.parquet(f).columns for f in folders)
