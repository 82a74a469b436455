"""The target's own past, gaps around held-out trials and large means: moments against rows."""

import numpy as np
import pytest

from tempolin.functions.bilinear import Moments
from tempolin.functions.evaluation import Side, evaluate, outer_folds
from tempolin.operators import conditioning, design, fit
from tempolin.operators.design import CoMoments, SessionTables, compile_design, convolve_arrow, convolve_sql, lagged
from tempolin.plans.spec import CVConfig, Event, FitConfig, Gain, History, ModelSpec, Signal

TRIALS, BINS = 12, 7
FIXED = FitConfig(kernel_alpha=0.7, gain_alpha=0.3, tol=0, max_iter=5)


@pytest.fixture(scope="module")
def session(spark):
    """Two sessions of one grid with a signal; targets of two units, one of them mostly 0."""
    rng = np.random.default_rng(4)
    n = TRIALS * BINS
    x = rng.normal(size=(2, n))
    y = rng.normal(size=(2, 2, n))
    y[:, 1] = np.where(rng.random((2, n)) < 0.8, 0.0, np.round(3 * y[:, 1]))
    context = np.where((np.arange(TRIALS) // 2) % 2, -1.0, 1.0)
    grid = spark.createDataFrame([(s, r, r // BINS) for s in range(2) for r in range(n)], "session long, row_id long, trial long")
    signals = spark.createDataFrame([(s, "x", r, None, float(x[s, r])) for s in range(2) for r in range(n)], "session long, source string, sample_ix long, time double, value double")
    trials = spark.createDataFrame([(s, t, float(context[t]), t // 2) for s in range(2) for t in range(TRIALS)], "session long, trial long, context double, cv_group long")
    targets = spark.createDataFrame([(s, u, r, float(y[s, u, r])) for s in range(2) for u in range(2) for r in range(n)], "session long, unit_id long, row_id long, y double")
    return SessionTables(1.0, grid, None, signals, trials), targets, x, y, context


def model(gains=()):
    return ModelSpec((Signal("x", (0, 2), 2, "identity", outlier_zscore=None), History(window=(1, 4), n_basis=2, gains=gains)), tuple(Gain(g) for g in gains), dt=1.0)


def columns(compiled, x, y, segmented):
    """The whole design of one unit, row by row."""
    rows, parts = np.arange(len(y)), []
    for p in compiled.design.spec.predictors:
        values, out = (x if p.name == "x" else y), np.zeros((len(y), compiled.design.bases[p.name].shape[1]))
        for at in [np.flatnonzero(rows // BINS == t) for t in range(TRIALS)] if segmented else [rows]:
            out[at] = lagged(values[at], at, compiled.design.lags[p.name], compiled.design.bases[p.name])
        parts.append(out)
    return np.hstack(parts)


def moments(x, y, keep):
    trial = np.arange(len(y)) // BINS
    there = np.unique(trial[keep])
    sums = []
    for t in there:
        at = keep & (trial == t)
        sums.append((at.sum(), x[at].sum(0), x[at].T @ x[at], y[at].sum(), x[at].T @ y[at], y[at] @ y[at]))
    return Moments(there, *[np.array(c, dtype=float) for c in zip(*sums)])


@pytest.mark.parametrize("segmented", [False, True])
def test_own_past_is_fitted_as_on_rows(spark, session, segmented):
    tables, targets, x, y, context = session
    compiled = compile_design(model(("context",)), tables, segmented=segmented)
    out = {(r.session, r.unit_id): r for r in fit.fit_units(compiled, targets, FIXED, units_per_task=1).collect()}
    assert len(out) == 4
    for (s, u), r in out.items():
        whole = columns(compiled, x[s], y[s, u], segmented)
        m = moments(whole, y[s, u], np.ones(len(whole), dtype=bool))
        told = evaluate(compiled.design, Side(m, {"context": context}), FIXED, CVConfig(folds=3, split="trials"), [])
        assert np.allclose(r.beta, told.state.beta, atol=1e-9) and np.allclose(r.gain, told.state.gain, atol=1e-9)
        assert abs(r.intercept - told.state.intercept) < 1e-9 and abs(r.train_r2 - told.train_r2) < 1e-9


@pytest.mark.parametrize("cv", [CVConfig(gap_history=True), CVConfig(folds=4, split="trials", seed=1, gap_history=4), CVConfig(folds=5, split="trials", gap_history=2)])
def test_gap_is_that_of_rows(spark, session, cv):
    tables, targets, x, y, _ = session
    chosen = tables.grid.where("row_id % 11 <> 4 and trial <> 5")
    compiled = compile_design(model(), tables, fit_mask=chosen)
    gap = compiled.history_lag_bins if cv.gap_history is True else cv.gap_history
    config = FitConfig(kernel_alpha=0.7)
    rows = np.arange(TRIALS * BINS)
    selected, trial = (rows % 11 != 4) & (rows // BINS != 5), rows // BINS
    apart = lambda side: np.array([side[r] and r >= gap and side[r - gap : r + 1].all() for r in rows])
    for r in fit.evaluate_units(compiled, targets, config, cv, []).collect():
        own = y[r.session, r.unit_id]
        whole = columns(compiled, x[r.session], own, False)
        m = moments(whole, own, selected)
        groups = m.trials // 2
        held = [np.isin(trial, f) for f in outer_folds(m.trials, groups, cv)[0]]
        sides = [(Side(moments(whole, own, apart(~h) & selected), {}), Side(moments(whole, own, apart(h) & selected), {})) for h in held]
        told = evaluate(compiled.design, Side(m, {}), config, cv, [], groups, sides)
        assert abs(r.train_r2 - told.train_r2) < 1e-9
        assert abs(r.cv_r2_pooled - told.cv["cv_r2_pooled"]) < 1e-9 and abs(r.cv_r2 - told.cv["cv_r2"]) < 1e-9


def test_refits_of_the_own_past(spark, session):
    tables, targets, x, y, context = session
    compiled = compile_design(model(("context",)), tables)
    fits = fit.fit_units(compiled, targets, FIXED)
    kernels = {(r.session, r.unit_id): r for r in fits.collect()}
    gains = {(r.session, r.unit_id): r for r in fit.refit_gains(compiled, targets, fits, FitConfig(kernel_alpha=1.0, gain_alpha=5.0)).collect()}
    trial = np.arange(TRIALS * BINS) // BINS
    for (s, u), r in gains.items():
        k, whole = kernels[s, u], columns(compiled, x[s], y[s, u], False)
        assert r.beta == k.beta and abs(r.intercept - k.intercept) < 1e-12
        drive = (whole[:, 2:] @ np.array(k.beta[2:]))[:, None] * np.column_stack([np.ones(len(trial)), context[trial]])
        rest = y[s, u] - k.intercept - whole[:, :2] @ np.array(k.beta[:2])
        assert np.allclose(r.gain, np.linalg.solve(drive.T @ drive + 5.0 * np.eye(2), drive.T @ rest), atol=1e-9)


def test_a_large_mean_costs_no_digits(spark, session):
    tables, targets, x, y, _ = session
    compiled = compile_design(ModelSpec((Signal("x", (0, 2), 2, "identity", outlier_zscore=None),), dt=1.0), tables)
    plain = {(r.session, r.unit_id): r for r in fit.fit_units(compiled, targets, FitConfig(kernel_alpha=0.7)).collect()}
    lifted = fit.fit_units(compiled, targets.selectExpr("session", "unit_id", "row_id", "y + 1e7 as y"), FitConfig(kernel_alpha=0.7))
    for r in lifted.collect():
        k = plain[r.session, r.unit_id]
        assert abs(r.train_r2 - k.train_r2) < 1e-8 and np.allclose(r.beta, k.beta, atol=1e-7) and abs(r.intercept - 1e7 - k.intercept) < 1e-6


def test_a_constant_target_has_no_score(spark, session):
    tables, targets, *_ = session
    compiled = compile_design(ModelSpec((Signal("x", (0, 2), 2, "identity", outlier_zscore=None),), dt=1.0), tables)
    for value in (0.0, 0.1, 3e6):
        for r in fit.fit_units(compiled, targets.selectExpr("session", "unit_id", "row_id", f"double({value}) as y"), FitConfig(kernel_alpha=0.7)).collect():
            assert r.train_r2 != r.train_r2 and abs(r.intercept - value) <= 1e-9 * max(1, value)


def test_co_moments_merge_as_if_together():
    rng = np.random.default_rng(0)
    x, own = rng.normal(size=(30, 3)), rng.normal(size=(30, 2)) + 1e6
    packing = CoMoments(3, 1)
    parts = np.array([packing.of(x[a:b], own[a:b]) for a, b in ((0, 4), (4, 5), (5, 30))])
    assert np.allclose(packing.merged(parts), packing.of(x, own), rtol=1e-10, atol=1e-6)
    more = np.vstack([x, rng.normal(size=(9, 3))])
    mean, apart = packing.with_zeros(packing.of(x, own)[None], np.array([39.0]), more.sum(0)[None])
    whole = np.column_stack([more, np.vstack([own, np.zeros((9, 2))])])
    assert np.allclose(mean[0], whole.mean(0))
    assert np.allclose(apart[0], (whole - whole.mean(0))[:, 3:].T @ (whole - whole.mean(0)))


def test_medians_over_many_tasks_are_those_of_one(spark):
    rng = np.random.default_rng(2)
    values = [("a", k, float(v)) for k, v in enumerate(np.concatenate([rng.normal(size=400), [40.0, -55.0, 9.0]]))]
    values += [("b", k, float(v)) for k, v in enumerate(rng.integers(0, 4, 301))] + [("c", 0, 5.0), ("d", 0, None), ("e", 0, 1e300), ("e", 1, -1e300), ("e", 2, 0.0)]
    table = spark.createDataFrame([("s", s, k, v) for s, k, v in values], "session string, source string, sample_ix long, value double")
    rows = lambda few: sorted(map(tuple, conditioning.mark_outliers(table, 3.0, few=few).collect()), key=str)
    assert rows(1 << 20) == rows(0)
    medians = {r.source: r.median for r in conditioning.group_median(table.where("value is not null"), ["source"], "value").collect()}
    assert medians == {s: float(np.median([v for k, _, v in values if k == s])) for s in "abce"}


def test_stretches_give_what_whole_signals_do(spark, monkeypatch):
    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.7 else float(v) for v in rng.normal(size=90)]
    samples = spark.createDataFrame([("a", "s", i, float(t), v) for i, (t, v) in enumerate(zip(np.sort(rng.uniform(5, 60, 90)), values))], "session string, source string, sample_ix long, time double, value double")
    grid = spark.range(70).selectExpr("'a' as session", "id as row_id", "double(id) as bin_start", "id div 4 as trial")
    told = lambda: ([r.value for r in conditioning.fill_gaps(samples).orderBy("sample_ix").collect()], [r.value for r in conditioning.interpolate(samples, grid, 1.0).orderBy("row_id").collect()])
    whole = told()
    known = [(r.sample_ix, r.value) for r in samples.where("value is not null").collect()]
    assert np.allclose(whole[0], np.interp(np.arange(90), *zip(*known)))
    monkeypatch.setattr(conditioning, "STRETCH", 7)
    assert told() == whole


@pytest.mark.parametrize("segmented", [False, True])
def test_convolution_in_stretches(spark, session, segmented):
    tables, _, x, _, _ = session
    wide = tables.grid.join(tables.signals.selectExpr("session", "sample_ix as row_id", "value as v"), ["session", "row_id"]).selectExpr("*", "true as fit")
    lags, bases = {"v": np.arange(-3, 6)}, {"v": np.random.default_rng(0).normal(size=(9, 3))}
    read = lambda df: {(r.session, r.row_id): r.x for r in df.collect()}
    one = read(convolve_sql(wide, {"v": "v"}, lags, bases, segmented))
    other = read(convolve_arrow(wide, {"v": "v"}, lags, bases, segmented, stretch=5))
    assert one.keys() == other.keys() and len(one) == 2 * TRIALS * BINS
    assert all(np.allclose(one[k], other[k], atol=1e-12) for k in one)
    assert design.STRETCH > 5


def test_ids_of_sessions_are_quoted(spark, tmp_path):
    import json

    from tempolin.sources import sinks

    names = ['a"b', "back\\slash", "plain"]
    results = spark.createDataFrame([(s, "u", '{"train_r2": 0.5}') for s in names], "session string, unit_id string, summary string")
    sinks.write_results(results, str(tmp_path / "out"), {"model": "m"})
    read = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out" / sinks.RESULTS)).select("value").collect()]
    assert sorted(d["session_id"] for d in read) == sorted(names) and all(d["model"] == "m" and d["units"]["u"]["train_r2"] == 0.5 for d in read)
    assert sinks.written_sessions(spark, str(tmp_path / "nothing")).count() == 0
