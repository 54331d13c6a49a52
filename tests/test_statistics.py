"""Prefix sums, ranks, distances, quantiles and tests against numpy or by hand."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from waybill import schema as S
from waybill.functions import pvalues
from waybill.operators import derive, distribution, ecdf, fidelity, quality, ranking, significance, utility
from waybill.sources import driver_tables as D


def frame(spark, **columns):
    n = len(next(iter(columns.values())))
    data = pd.DataFrame({"row_id": [f"r{i}" for i in range(n)], **columns})
    return spark.createDataFrame(data)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value."""
    rng = np.random.default_rng(1)
    x = np.where(rng.random(3000) < 0.34, 1.5, rng.gamma(2.0, 1.0, 3000).round(3))
    return x, frame(spark, x=x)


def test_quantiles_match_numpy(skewed):
    x, df = skewed
    probs = [0.0, 0.005, 0.05, 0.3, 0.5, 0.77, 1.0]
    got = {r.prob: r.quantile for r in ecdf.exact_quantiles(df, ["x"], probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(x, p), abs=1e-12)


@pytest.mark.parametrize("width", [1, 2, 64])
def test_running_counts_for_any_bucket_width(spark, skewed, width):
    x, df = skewed
    steps = ecdf.running_counts(ecdf.long_values(df.select("x"), ["x"], width=width), {"n": F.count(F.lit(1))})
    values, counts = np.unique(x, return_counts=True)
    rows = sorted(steps.collect(), key=lambda r: r.value)
    assert [r.value for r in rows] == list(values)
    assert [r.cum_n for r in rows] == list(np.cumsum(counts))
    assert [r.next_value for r in rows] == [*values[1:], None]


def test_fidelity_of_a_table_with_itself(spark, skewed):
    _, df = skewed
    row = fidelity.ks_and_wasserstein(df, df, ["x"]).first()
    assert (row.ks, row.wasserstein) == (1.0, 0.0)
    assert fidelity.js_divergence(df, df, ["x"]).first().js == 0.0


def test_fidelity_edges(spark):
    zeros, ones = frame(spark, x=np.zeros(50)), frame(spark, x=np.ones(50))
    row = fidelity.ks_and_wasserstein(zeros, ones, ["x"]).first()
    assert (row.ks, row.wasserstein) == (0.0, 1.0)
    empty = zeros.withColumn("x", F.lit(None).cast("double"))
    row = fidelity.ks_and_wasserstein(zeros, empty, ["x"]).first()
    assert (row.ks, row.wasserstein) == (0.0, 0.0)
    a, b = frame(spark, c=["A"] * 9), frame(spark, c=["B"] * 9)
    assert fidelity.tvd_complement(a, b, ["c"]).first().tvd == 0.0
    assert fidelity.tvd_complement(a, a, ["c"]).first().tvd == 1.0
    assert fidelity.js_divergence(zeros, zeros, ["x"]).first().js == 0.0
    assert fidelity.js_divergence(zeros, ones, ["x"]).first().js == pytest.approx(math.log(2), abs=1e-4)


def test_integer_and_float_labels_are_one_category(spark):
    a = frame(spark, delay_label=[0, 1, 2, 2])
    b = frame(spark, delay_label=[0.0, 1.0, 2.0, 2.0])
    assert fidelity.tvd_complement(a, b, ["delay_label"]).first().tvd == 1.0


def test_histogram_matches_numpy(spark, skewed):
    x, df = skewed
    got = sorted(distribution.histogram(df, ["x"], 20).collect(), key=lambda r: r.bin)
    assert [r.n for r in got] == list(np.histogram(x, bins=20)[0])
    flat = distribution.histogram(frame(spark, x=np.full(5, 2.0)), ["x"], 20).collect()
    assert sum(r.n for r in flat) == 5 and min(r.low_edge for r in flat) == 1.5


def test_hash_rank_and_samples(spark):
    df = frame(spark, label=["a"] * 700 + ["b"] * 300).withColumnRenamed("label", S.LABEL)
    ranks = ranking.hash_rank(df, "t").toPandas()
    assert sorted(ranks._rank) == list(range(1, 1001))
    assert ranking.hash_sample(df, 10).count() == 10
    split = ranking.member_split(df, 0.5).groupBy(S.LABEL).agg(F.count_if("is_member").alias("m")).collect()
    assert {r[S.LABEL]: r.m for r in split} == {"a": 350, "b": 150}
    capped = {r[S.LABEL]: r["count"] for r in ranking.stratified_cap(df, 100).groupBy(S.LABEL).count().collect()}
    assert capped == {"a": 70, "b": 30}
    assert ranking.stratified_cap(df, 5000).count() == 1000
    folds = ranking.stratified_folds(df, 5).groupBy("fold").count().collect()
    assert {r["count"] for r in folds} == {200}
    again = ranking.hash_sample(df.repartition(7), 10).toPandas()
    assert set(again.row_id) == set(ranking.hash_sample(df, 10).toPandas().row_id)


def test_selected_rows_are_those_of_a_full_sort(spark, monkeypatch):
    """Few values, one that many rows share, and groups small enough to be numbered only after several looks."""
    monkeypatch.setattr(ranking, "LOOK_BINS", 4)
    monkeypatch.setattr(ranking, "NUMBERED_ROWS", 3)
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.integers(0, 10**6, 300), np.full(400, 777), [10**15] * 5]).astype(float)
    rows = pd.DataFrame({"row_id": [f"r{i}" for i in range(705)], "_t": values})
    df = spark.createDataFrame(rows).withColumn("_digest", F.md5("row_id"))
    full = df.toPandas().sort_values(["_t", "_digest", "row_id"]).reset_index(drop=True)
    ranks = [1, 2, 100, 305, 500, 699, 700, 701, 705]
    got = ranking.ranked_rows(df, ranks)
    assert {r: got[r]["row_id"] for r in ranks} == {r: full["row_id"][r - 1] for r in ranks}
    assert ranking.ranked_rows(df, [706]) == {} and ranking.ranked_rows(df.limit(0), [1]) == {}


def test_time_folds_with_one_crowded_timestamp(spark):
    times = pd.to_datetime(["2026-01-01"] * 400 + list(pd.date_range("2026-01-02", periods=598, freq="h")) + [None] * 2)
    df = spark.createDataFrame(pd.DataFrame({"row_id": [f"r{i}" for i in range(1000)], S.CREATED: times}))
    got = ranking.time_folds(df, 5).toPandas()
    sizes = got.fold.value_counts().to_dict()
    assert sizes == {0: 170, 1: 166, 2: 166, 3: 166, 4: 166, 5: 166}
    assert (got[got[S.CREATED].isna()].fold == 5).all()
    held = ranking.time_holdout(df).toPandas()
    assert held.is_test.sum() == 200
    with pytest.raises(ValueError):
        ranking.time_folds(df.limit(5), 5)


def test_codes_follow_byte_order_on_both_paths(spark, monkeypatch):
    words = ["b", "a", "é", "Z", None, "a"]
    df = frame(spark, last_scac=words)
    want = {w: i for i, w in enumerate(sorted({w or "nan" for w in words}, key=lambda s: s.encode()))}
    for limit in (10_000, 2):
        monkeypatch.setattr(derive, "BROADCAST_ROWS", limit)
        got = {r.value: r.code for r in derive.category_codes(df, ["last_scac"]).collect()}
        assert got == want
    unseen = derive.encode_categories(frame(spark, last_scac=["new"]), derive.category_codes(df, ["last_scac"]), ["last_scac"])
    assert unseen.first().last_scac_enc == len(want)


def test_labels_from_transit(spark):
    df = frame(spark, transit_duration_days=[float(i) for i in range(1, 101)] + [None])
    got = derive.derive_label(df).toPandas()
    assert got[S.LABEL].value_counts().to_dict() == {0: 54, 1: 38, 2: 9}
    hollow = df.withColumn(S.TRANSIT, F.lit(None).cast("double"))
    assert {r[S.LABEL] for r in derive.derive_label(hollow).collect()} == {0}


def test_distance_fills_with_the_median(spark):
    places = spark.createDataFrame([("18706", 41.2044, -75.9113), ("10001", 40.75, -74.0)], "zip5 string, latitude double, longitude double")
    df = frame(spark, zip_code=["18706-1234", "10001", "bad", None])
    got = derive.add_distance(df, places).toPandas().sort_values("row_id").distance_km.tolist()
    assert got[0] == pytest.approx(0.0, abs=1e-6) and got[1] == pytest.approx(168.4, abs=2)
    assert got[2] == got[3] == pytest.approx(got[1] / 2)
    assert derive.add_distance(df, None).agg(F.max("distance_km")).first()[0] == 0.0


def scored(spark, truth, guess, proba=None):
    data = {"y_true": truth, "y_pred": guess}
    df = frame(spark, **data)
    return df if proba is None else spark.createDataFrame(pd.DataFrame({**data, "proba": proba}))


def test_business_utility(spark):
    perfect = scored(spark, [0, 1, 2, 2], [0, 1, 2, 2])
    assert utility.business_utility(perfect).first()[0] == 1.0
    worst = scored(spark, [2, 2], [0, 0])
    assert utility.business_utility(worst).first()[0] == 0.0
    missed = utility.business_utility(scored(spark, [0, 0, 2, 2], [0, 0, 2, 0])).first()[0]
    alarm = utility.business_utility(scored(spark, [0, 0, 2, 2], [0, 2, 2, 2])).first()[0]
    assert missed < alarm
    assert utility.class2_recall(scored(spark, [0, 1], [0, 1])).first()[0] == 0.0


def test_f1_and_confusion(spark):
    df = scored(spark, [0, 0, 1, 2], [0, 1, 1, 0])
    assert utility.weighted_f1(df).first()[0] == pytest.approx((2 * 0.5 + 2 / 3) / 4, abs=1e-4)
    cells = {r.y_true: (r.pred_0, r.pred_1, r.pred_2) for r in utility.confusion_matrix(df).collect()}
    assert cells == {0: (1, 1, 0), 1: (0, 1, 0), 2: (1, 0, 0)}


def test_calibration(spark):
    sure = scored(spark, [0] * 10, [0] * 10, [[1.0, 0.0, 0.0]] * 10)
    assert utility.calibration_error(sure).first()[0] == 0.0
    off = scored(spark, [1] * 10, [0] * 10, [[0.95, 0.03, 0.02]] * 10)
    assert utility.calibration_error(off).first()[0] == pytest.approx(0.95)
    assert utility.brier_score(sure).first()[0] == 0.0


def test_p_values(spark):
    t_cases = [(2.776445, 4, 0.05), (0.0, 4, 1.0), (12.706205, 1, 0.05), (4.302653, 2, 0.05), (-3.182446, 3, 0.05), (2.042272, 30, 0.05), (1.984217, 99, 0.05), (1.960083, 20_000, 0.05), (float("inf"), 5, 0.0)]
    rows = spark.createDataFrame(t_cases, "t double, df long, p double")
    for r in rows.select("*", pvalues.t_two_sided(F.col("t"), F.col("df")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, abs=1e-6), r
    # Student's t integrated numerically, for odd and even degrees.
    grid = np.linspace(0, 1.3, 200_001)
    many = spark.createDataFrame([(1.3, d) for d in range(1, 60)], "t double, df long")
    for r in many.select("df", pvalues.t_two_sided(F.col("t"), F.col("df")).alias("p")).collect():
        density = np.exp(math.lgamma((r.df + 1) / 2) - math.lgamma(r.df / 2)) / math.sqrt(r.df * math.pi) * (1 + grid**2 / r.df) ** (-(r.df + 1) / 2)
        assert r.p == pytest.approx(1 - 2 * np.trapezoid(density, grid), abs=1e-9)
    none = spark.createDataFrame([(None, 4), (1.0, 0), (float("nan"), 3), (1.0, None)], "t double, df long")
    assert [r.p for r in none.select(pvalues.t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()] == [None] * 4


def test_signed_rank_p_values(spark):
    from itertools import product

    def brute(w, n):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in product((0, 1), repeat=n)]
        return min(1.0, 2 * sum(x <= w for x in sums) / 2**n)

    cases = [(float(w), n) for n in (1, 2, 5, 9) for w in range(n * (n + 1) // 4 + 1)]
    rows = spark.createDataFrame(cases, "w double, n long")
    for r in rows.select("*", pvalues.wilcoxon_two_sided(F.col("w"), F.col("n")).alias("p")).collect():
        assert r.p == pytest.approx(brute(r.w, r.n), abs=1e-12)
    other = spark.createDataFrame([(None, 0, 0.0), (514.0, 50, 0.0), (514.0, 50, 6.0), (580.0, 51, 0.0)], "w double, n long, ties double")
    got = [r.p for r in other.select(pvalues.wilcoxon_two_sided(F.col("w"), F.col("n"), F.col("ties")).alias("p")).collect()]
    assert got[0] is None
    # The normal approximation is close to the exact value and uses the ties.
    assert got[1] == pytest.approx(got[2], abs=0.01) and 0 < got[3] < 1
    spread = math.sqrt(51 * 52 * 103 / 24)
    assert got[3] == pytest.approx(math.erfc(abs(580 - 51 * 52 / 4) / spread / math.sqrt(2)), abs=1e-6)


def test_significance(spark):
    pairs = spark.createDataFrame([(0.9, 0.8), (0.91, 0.8), (0.92, 0.83), (0.9, 0.79), (0.93, 0.8)], "a double, b double")
    got = significance.significance_test(pairs, "a", "b").first()
    d = np.array([0.1, 0.11, 0.09, 0.11, 0.13])
    assert got.paired_t_stat == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(5)), abs=1e-3)
    assert got.significant_005 and got.wilcoxon_stat == 0.0
    same = significance.significance_test(pairs.withColumn("b", F.col("a")), "a", "b").first()
    assert same.wilcoxon_stat is None and not same.significant_005


def test_confidence_interval(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (None,)], "v double")
    got = distribution.confidence_interval(df, "v").first()
    assert (got["mean"], got["std"], got["n"]) == (2.0, 1.0, 3)
    single = distribution.confidence_interval(df.limit(1), "v").first()
    assert (single["std"], single["ci95_low"]) == (0.0, 1.0)


def test_quality_report_is_four_tables(spark, proxy, tmp_path):
    from waybill.operators import quality
    from waybill.sources import sinks

    paths = sinks.write_report(quality.quality_tables(proxy, proxy), str(tmp_path), "parquet")
    assert set(paths) == {"quality_overall", "column_shapes", "column_pair_trends", "adherence"}
    for path in paths.values():
        # A correlation that doesn't exist has no score.
        scores = [r.score for r in spark.read.parquet(path).collect() if r.score is not None]
        assert scores and min(scores) == 1.0


def test_places_listed_twice_do_not_multiply_rows(spark):
    from waybill.operators.derive import add_distance

    rows = spark.createDataFrame([("10115",), ("10115",), ("99999",)], "zip_code string")
    places = spark.createDataFrame([("10115", 52.5, 13.4), ("10115", 52.5, 13.4)], "zip5 string, latitude double, longitude double")
    assert add_distance(rows, places).count() == 3


def test_ks_and_js_equal_those_of_the_ledger(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a = frame(spark, x=np.r_[rng.normal(size=300).round(1), [np.nan] * 9], y=np.r_[np.zeros(200), np.ones(109)], z=np.full(309, 2.0), e=np.full(309, np.nan))
    b = frame(spark, x=rng.normal(0.4, 2, size=250).round(2), y=np.full(250, 0.5), z=np.full(250, 2.0), e=np.ones(250))
    names = ["x", "y", "z", "e"]
    book = fidelity._ledger(a, b, names)
    js = {r.field: r.js for r in fidelity.ledger.js_divergence(book).collect()}
    ks = {r.field: r.ks for r in fidelity.ks_and_wasserstein(a, b, names).collect()}
    monkeypatch.setattr(fidelity.ledger, "value_ledger", None)
    assert {r.field: r.ks for r in fidelity.ks_complement(a, b, names).collect()} == ks
    assert {r.field: r.js for r in fidelity.js_divergence(a, b, names).collect()} == pytest.approx({c: js.get(c, 0.0) for c in names}, abs=1e-9)


@pytest.mark.parametrize("cells", [1 << 16, 4])
def test_pairs_are_counted_without_a_row_for_each(spark, monkeypatch, cells):
    monkeypatch.setattr(quality, "PAIR_CELLS", cells)
    rng = np.random.default_rng(8)
    sides = [pd.DataFrame({c: rng.choice(list("uvw") + [None], size=n) for c in "pqr"}) for n in (90, 70)]
    pairs = [("p", "q"), ("p", "r"), ("q", "r")]
    got = {r.pair: r.score for r in quality._pair_scores(*[spark.createDataFrame(s, "p string, q string, r string") for s in sides], list("pqr"), pairs).collect()}
    for i, (a, b) in enumerate(pairs):
        x, y = ((s[a].fillna("-") + s[b].fillna("-")).value_counts(normalize=True) for s in sides)
        assert got[i] == pytest.approx(1 - x.sub(y, fill_value=0).abs().sum() / 2, abs=1e-4)


def test_both_sides_read_the_lines_joined_once(spark, monkeypatch):
    calls, plain = [], D._joined
    monkeypatch.setattr(D, "_joined", lambda *a, **k: calls.append(a) or plain(*a, **k))
    real, synth = D.sides(spark, SMALL, ["last_scac"])
    assert len(calls) == 1 and "Join" not in synth._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(real.collect(), key=str) == sorted(D.canonical(spark, SMALL, ["last_scac"]).collect(), key=str)
    assert sorted(synth.collect(), key=str) == sorted(D.synthetic(spark, SMALL, ["last_scac"]).collect(), key=str)


def test_shapes_cover_dates(spark):
    """Days 0, 1, 2 and 1, 2, 3: the distribution functions are a third apart; a side without a date scores 0."""
    days = [pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-03"]) + pd.Timedelta(days=k) for k in (0, 1)]
    rows = [pd.DataFrame({S.CAPTURE: d, S.LABEL: [0, 1, 2]}) for d in days]
    real, synth = (spark.createDataFrame(r).withColumn(S.SHIP, F.lit(None).cast("timestamp")) for r in rows)
    got = {(r.field, r.kind): r.score for r in quality.column_shapes(real, synth).collect()}
    assert got == {(S.CAPTURE, "KSComplement"): 0.6667, (S.SHIP, "KSComplement"): 0.0, (S.LABEL, "TVComplement"): 1.0}
