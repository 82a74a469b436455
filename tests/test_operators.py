"""Corners of grids and signals that the queries do not reach."""

import math

import numpy as np
import pytest

from tempolin.operators import conditioning, grid, relational
from tempolin.operators.design import SessionTables, compile_design, convolve_arrow, convolve_sql, lagged
from tempolin.plans.spec import Event, Gain, History, ModelSpec, Signal


def signal(spark, values, times=None):
    rows = [("a", "s", i, None if times is None else times[i], v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "session string, source string, sample_ix long, time double, value double")


def values(df, order="sample_ix"):
    return [r.value for r in df.orderBy(order).collect()]


def bins(spark, n, dt=1.0):
    return spark.range(n).selectExpr("'a' as session", "id as row_id", f"id * {dt}D as bin_start", "id div 4 as trial")


def test_infinite_values_are_not_masked(spark):
    out = values(conditioning.mark_outliers(signal(spark, [1.0, 2.0, 1.5, math.inf, 50.0, 1.2, None, math.nan]), 5.0))
    assert out[3] == math.inf and out[4] is None and out[:3] == [1.0, 2.0, 1.5]


def test_constant_with_a_rare_other_value(spark):
    out = values(conditioning.mark_outliers(signal(spark, [1.0] * 60 + [-1.0]), 5.0))
    assert out[-1] is None  # no deviation of the median: the population deviation is the scale


def test_gaps_are_level_at_the_ends(spark):
    assert values(conditioning.fill_gaps(signal(spark, [None, 1.0, math.nan, None, 4.0, None]))) == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    with pytest.raises(Exception, match="no values"):
        conditioning.fill_gaps(signal(spark, [None, None])).collect()


def test_interpolation_follows_numpy(spark):
    rng = np.random.default_rng(1)
    times, v = np.sort(rng.uniform(1, 8, 12)), rng.normal(size=12)
    out = values(conditioning.interpolate(signal(spark, v.tolist(), times.tolist()), bins(spark, 10), 1.0), "row_id")
    assert np.allclose(out, np.interp(np.arange(10) + 0.5, times, v))


def test_empty_bins_are_zero_and_scaled_with_the_others(spark):
    out = conditioning.bin_mean(signal(spark, [2.0, 4.0, 9.0], [0.1, 0.2, 2.5]), bins(spark, 4), 1.0)
    assert values(out, "row_id") == [3.0, 0.0, 9.0, 0.0]
    assert np.allclose(values(conditioning.normalize(out, "zscore"), "row_id"), (np.array([3, 0, 9, 0]) - 3) / np.std([3, 0, 9, 0]))


def test_constant_signals_are_centred_only(spark):
    assert values(conditioning.normalize(signal(spark, [2.0, 2.0]), "zscore")) == [0.0, 0.0]
    with pytest.raises(ValueError):
        conditioning.normalize(signal(spark, [1.0]), "rank")


def test_asof_join_in_buckets_is_the_same(spark):
    rng = np.random.default_rng(2)
    left = spark.createDataFrame([("a", i, float(t)) for i, t in enumerate(rng.uniform(-5, 100, 200))], "session string, i long, t double")
    right = spark.createDataFrame([("a", float(t), float(t) * 2) for t in (3.0, 4.0, 50.0, 51.0, 90.0)], "session string, s double, v double")
    plain = {r.i: r.v for r in relational.asof_join(left, right, ["session"], "t", "s", ["v"]).collect()}
    cut = {r.i: r.v for r in relational.asof_join(left, right, ["session"], "t", "s", ["v"], bucket=7.0).collect()}
    assert plain == cut and len(plain) == 200 and None in plain.values()


def test_trials_that_overlap_or_leave_gaps(spark):
    trials = spark.createDataFrame([("a", 0, 0.0, 3.0), ("a", 1, 2.0, 5.0)], "session string, trial long, start double, end double")
    with pytest.raises(ValueError, match="bin 2"):
        grid.checked_trial_index(trials, 1.0)
    with pytest.raises(ValueError, match="0 trials"):
        grid.checked_trial_index(trials.where("trial = 1"), 1.0)


def test_stimulus_must_lie_in_its_trial(spark):
    trials = spark.createDataFrame([("a", 0, 0.0, 1.0, 1.5)], "session string, trial long, start double, end double, stim double")
    with pytest.raises(Exception, match="stimulus"):
        grid.stimulus_grid(trials, 0.1).collect()


def test_nearly_whole_offsets_snap(spark):
    trials = spark.createDataFrame([("a", 0, 0.0, 1.0, 0.3)], "session string, trial long, start double, end double, stim double")
    rows = grid.stimulus_grid(trials, 0.1).orderBy("row_id").collect()
    assert len(rows) == 10 and abs(rows[0].bin_start) < 1e-9  # 0.3 / 0.1 is just below 3


def test_history_gap(spark):
    frame = spark.createDataFrame([("a", i, i not in (4, 5)) for i in range(12)], "session string, row_id long, side boolean")
    safe = [r.safe for r in relational.with_history_gap(frame, "side", 2).orderBy("row_id").collect()]
    assert [i for i, s in enumerate(safe) if s] == [2, 3, 8, 9, 10, 11]


def test_both_convolutions_agree(spark):
    rng = np.random.default_rng(0)
    wide = spark.createDataFrame([("a", i, i // 5, True, float(v)) for i, v in enumerate(rng.normal(size=20))], "session string, row_id long, trial long, fit boolean, c double")
    lags, basis = np.arange(-2, 4), rng.normal(size=(6, 3))
    for segmented in (False, True):
        pair = [f(wide, {"p": "c"}, {"p": lags}, {"p": basis}, segmented).orderBy("row_id").collect() for f in (convolve_sql, convolve_arrow)]
        assert np.allclose([r.x for r in pair[0]], [r.x for r in pair[1]])


def test_lagged_is_the_written_out_sum():
    v = np.arange(1.0, 6.0)
    out = lagged(v, np.arange(5), np.array([-1, 0, 2]), np.eye(3))
    assert out.tolist() == [[2, 1, 0], [3, 2, 0], [4, 3, 1], [5, 4, 2], [0, 5, 3]]


def test_orthogonal_signals_have_no_projection_left(spark):
    rng = np.random.default_rng(4)
    r = rng.normal(size=40)
    rows = [("a", i, float(a), float(3 * a + b), i % 2 == 0) for i, (a, b) in enumerate(zip(r, rng.normal(size=40)))]
    df = spark.createDataFrame(rows, "session string, row_id long, r double, v double, fit boolean")
    out = conditioning.residualize(df, "v", "r").where("fit").toPandas()
    assert abs(np.cov(out.v, out.r)[0, 1]) < 1e-12


def test_compile_checks(spark):
    frame = bins(spark, 8)
    trials = spark.createDataFrame([("a", 0, 1.0), ("a", 1, -1.0)], "session string, trial long, g double")
    empty = spark.createDataFrame([], "session string, source string, time double")
    tables = SessionTables(1.0, frame, empty, None, trials)
    with pytest.raises(ValueError, match="dt"):
        compile_design(ModelSpec((Event("e", (0, 1)),), dt=0.5), tables)
    with pytest.raises(KeyError, match="gain"):
        compile_design(ModelSpec((Event("e", (0, 8), gains="h"),), (Gain("h"),), dt=1), tables)
    with pytest.raises(KeyError, match="signals"):
        compile_design(ModelSpec((Signal("s", (0, 0), 1),), dt=1), tables)
    with pytest.raises(ValueError, match="past"):
        compile_design(ModelSpec((History(window=(0, 3), n_basis=2),), dt=1), tables)
    rows = compile_design(ModelSpec((Event("e", (0, 2), 2, "identity"),), dt=1), tables).rows.collect()
    assert len(rows) == 8 and all(r.x == [0.0, 0.0] and r.fit for r in rows)


def test_bins_are_not_broadcast(spark):
    """Bins are many more than the trials they come of, so they must not go through the driver."""
    trials = spark.createDataFrame([(0, k, 10.0 * k, 10.0 * k + 10, 10.0 * k + 3) for k in range(5)], "session long, trial long, start double, end double, stim double")
    times = spark.createDataFrame([(0, 0.5 * k) for k in range(100)], "session long, time double")
    met = grid.aligned_rows(times, grid.stimulus_grid(trials, 0.5), 0.5)
    assert met.count() == 100
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_sums_of_trials_are_merged_in_all_partitions(spark):
    """Merging takes long for few bytes, so partitions are not put together by size."""
    from tempolin.operators import design

    rows = spark.createDataFrame([(s, t, True, [1.0, float(t)]) for s in range(8) for t in range(4)], "session long, trial long, fit boolean, x array<double>")
    sums = design.design_moments(rows)
    assert sums.count() == 32
    assert "REPARTITION_BY_NUM" in sums._jdf.queryExecution().executedPlan().toString()
