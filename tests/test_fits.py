"""Fits from moments against the same alternation on rows."""

import numpy as np
import pytest

from tempolin.functions.bilinear import Design, Moments, Problem, balanced_folds, solve_lasso
from tempolin.functions.evaluation import Side, common_trials, edge_shifts, evaluate, outer_folds, p_value
from tempolin.plans.spec import CVConfig, Dropout, Event, FitConfig, Gain, ModelSpec, ParameterLayout


def moments(x, y, trial):
    names = np.unique(trial)
    sums = [((trial == t).sum(), x[trial == t].sum(0), x[trial == t].T @ x[trial == t], y[trial == t].sum(), x[trial == t].T @ y[trial == t], y[trial == t] @ y[trial == t]) for t in names]
    return Moments(names, *[np.array(c, dtype=float) for c in zip(*sums)])


def problem(seed=0, n_trials=24, per=12):
    rng = np.random.default_rng(seed)
    trial = np.repeat(np.arange(n_trials), per)
    context = np.where((np.arange(n_trials) // 4) % 2, -1.0, 1.0)
    value = context + rng.normal(0, 0.35, n_trials)
    x = rng.normal(size=(len(trial), 4))
    drive = x[:, :3] @ np.array([0.6, 0.3, -0.2])
    y = 0.3 + (1.4 + 0.8 * context[trial] + 0.3 * value[trial]) * drive + 0.6 * x[:, 3] + rng.normal(0, 0.3, len(trial))
    spec = ModelSpec((Event("a", (0, 1), 3, gains=("context", "value")), Event("b", (0, 1), 1)), (Gain("context"), Gain("value")), dt=1)
    bases = {"a": np.eye(3), "b": np.ones((1, 1))}
    return Design(spec, ParameterLayout.of(spec, {"a": 3, "b": 1}), bases), x, y, trial, {"context": context, "value": value}


def dense(design, x, y, trial, gains, kernel_alpha, gain_alpha, steps):
    """The alternation on rows, written out."""
    beta, gain, b = np.zeros(4), np.array([1.0, 0.0, 0.0]), 0.0
    ridge = lambda a, t, alpha: np.linalg.solve(a.T @ a + alpha * np.eye(a.shape[1]), a.T @ t)
    v = np.column_stack([np.ones(len(y)), gains["context"][trial], gains["value"][trial]])
    fit_gain = lambda: ridge((x[:, :3] @ beta[:3])[:, None] * v, y - b - x[:, 3] * beta[3], gain_alpha)
    for _ in range(steps):
        w = x.copy()
        w[:, :3] *= (v @ gain)[:, None]
        beta = ridge(w - w.mean(0), y - y.mean(), kernel_alpha)
        b = y.mean() - w.mean(0) @ beta
        beta[:3] /= np.linalg.norm(beta[:3])
        gain = fit_gain()
    return beta, fit_gain(), b


def test_moments_give_the_alternation_on_rows():
    design, x, y, trial, gains = problem()
    state = Problem(design, moments(x, y, trial), gains, FitConfig(kernel_alpha=0.5, gain_alpha=0.1, tol=0, max_iter=6)).fit()
    beta, gain, b = dense(design, x, y, trial, gains, 0.5, 0.1, 6)
    assert np.allclose(state.beta, beta, atol=1e-10) and np.allclose(state.gain, gain, atol=1e-10) and abs(state.intercept - b) < 1e-10


def test_no_tolerance_runs_all_rounds_where_coefficients_rest_at_zero():
    design, x, y, trial, gains = problem(n_trials=8)
    x, y, trial = np.tile(x[:48], (2, 1)), np.tile(y[:48], 2), np.repeat(np.arange(8), 12)
    gains = {g: np.repeat([1.0, -1.0], 4) for g in gains}  # the same rows under both gains
    state = Problem(design, moments(x, y, trial), gains, FitConfig(kernel_alpha=20.0, gain_alpha=5.0, tol=0, max_iter=8)).fit()
    beta, gain, b = dense(design, x, y, trial, gains, 20.0, 5.0, 8)
    assert np.abs(state.gain[1:]).max() < 1e-12
    assert np.abs(state.beta - beta).max() < 1e-12 and np.abs(state.gain - gain).max() < 1e-12 and abs(state.intercept - b) < 1e-12


def test_known_parameters_are_recovered():
    design, x, y, trial, gains = problem(n_trials=60, per=30)
    state = Problem(design, moments(x, y, trial), gains, FitConfig()).fit()
    assert state.converged
    assert abs(np.linalg.norm(state.beta[:3]) - 1) < 1e-9
    assert np.allclose(state.gain[1] / state.gain[0], 0.8 / 1.4, atol=0.1)


def test_no_gains_is_one_iteration():
    spec = ModelSpec((Event("a", (0, 1), 1),), dt=1)
    design = Design(spec, ParameterLayout.of(spec, {"a": 1}), {"a": np.ones((1, 1))})
    x = np.linspace(0, 1, 40)[:, None]
    state = Problem(design, moments(x, 0.5 + 2 * x[:, 0], np.repeat(np.arange(4), 10)), {}, FitConfig(kernel_alpha=1e-9)).fit()
    assert state.converged and len(state.iterations) == 1
    assert np.allclose([state.intercept, state.beta[0]], [0.5, 2], atol=1e-6)


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    y = x[:, 0] - 2 * x[:, 3] + rng.normal(size=300)
    beta = solve_lasso(x.T @ x, x.T @ y, 0.1, 300, np.zeros(8))
    slope = x.T @ (y - x @ beta) / 300
    assert np.all(np.abs(slope[beta == 0]) <= 0.1 + 1e-8)
    assert np.allclose(slope[beta != 0], 0.1 * np.sign(beta[beta != 0]), atol=1e-8)


def test_penalty_is_the_best_of_the_inner_folds():
    design, x, y, trial, gains = problem()
    m = moments(x, y, trial)
    alphas = (0.01, 1.0, 100.0)
    p = Problem(design, m, gains, FitConfig(alphas=alphas, max_iter=1))
    chosen = p.fit_kernel(np.array([1.0, 0.0, 0.0]), None, np.zeros(4))[2]
    folds = balanced_folds(m.trials, m.n, None)
    means = []
    for a in alphas:
        errors = []
        for f in range(5):
            test = folds[trial] == f
            c = x[~test] - x[~test].mean(0)
            beta = np.linalg.solve(c.T @ c + a * np.eye(4), c.T @ (y[~test] - y[~test].mean()))
            errors.append(np.mean((y[test] - y[~test].mean() - (x[test] - x[~test].mean(0)) @ beta) ** 2))
        means.append(np.mean(errors))
    assert chosen == alphas[int(np.argmin(means))]


def test_inner_folds_are_balanced_and_whole():
    rows = np.array([5, 1, 9, 9, 2, 2, 7, 1])
    folds = balanced_folds(np.arange(8), rows, 3)
    load = [rows[folds == f].sum() for f in range(3)]
    assert max(load) - min(load) <= 2 and set(folds) == {0, 1, 2}
    with pytest.raises(ValueError):
        balanced_folds(np.arange(3), rows[:3], None)


def test_outer_folds():
    trials = np.array([0, 1, 2, 5, 6, 9])
    folds, split, held = outer_folds(trials, np.array([4, 4, 1, 1, 4, 0]), CVConfig())
    assert (split, held) == ("groups", [4, 1, 0]) and folds[0].tolist() == [0, 1, 6]
    folds, split, held = outer_folds(trials, None, CVConfig(folds=4))
    assert split == "trials" and [len(f) for f in folds] == [2, 2, 1, 1] and held is None
    shuffled = outer_folds(trials, None, CVConfig(folds=2, seed=3))[0]
    assert np.concatenate(shuffled).tolist() == np.random.default_rng(3).permutation(trials).tolist()
    for groups, config in ((None, CVConfig(split="groups")), (np.zeros(6), CVConfig()), (None, CVConfig(folds=7))):
        with pytest.raises(ValueError):
            outer_folds(trials, groups, config)


def test_edge_shifts():
    values = np.repeat([1, -1, 1, -1, 1, -1], [81, 81, 80, 74, 68, 74])
    shifts = edge_shifts(values)
    assert shifts[0] == 0 and shifts.max() == 40 and shifts.min() == -37 and len(shifts) == 78
    assert common_trials(np.arange(458), shifts).tolist() == list(range(40, 421))
    for bad in ([1.0], [1.0, 1.0], [1.0, 2.0]):
        with pytest.raises(ValueError):
            edge_shifts(np.array(bad))


def test_p_value_counts_the_observed_one():
    assert p_value([0.3, 0.1, 0.2, 0.3, 0.05]) == 0.4
    assert np.isnan(p_value([float("nan"), 1.0]))
    assert p_value([0.2, float("nan"), 0.1]) == 0.5


def test_evaluation_from_moments_is_evaluation_on_rows():
    design, x, y, trial, gains = problem()
    m = moments(x, y, trial)
    groups = np.arange(24) // 4
    dropouts = [Dropout.gain("context", permutation_test=True), Dropout.predictors("b"), Dropout.gain_terms("value", "a")]
    fit = FitConfig(kernel_alpha=0.5, gain_alpha=0.1, tol=0, max_iter=5)
    told = evaluate(design, Side(m, gains), fit, CVConfig(), [d.resolve_for(design.spec) for d in dropouts], groups).to_dict(design)
    errors = {"full": 0.0, "value": 0.0}
    for g in range(6):
        test = groups[trial] == g
        beta, gain, b = dense(design, x[~test], y[~test], trial[~test], gains, 0.5, 0.1, 5)
        v = np.column_stack([np.ones(test.sum()), gains["context"][trial[test]], gains["value"][trial[test]]])
        drive = x[test, :3] @ beta[:3]
        rest = y[test] - b - x[test, 3] * beta[3]
        errors["full"] += np.sum((rest - drive * (v @ gain)) ** 2)
        w = np.column_stack([np.ones((~test).sum()), gains["context"][trial[~test]]])
        a = (x[~test, :3] @ beta[:3])[:, None] * w
        less = np.linalg.solve(a.T @ a + 0.1 * np.eye(2), a.T @ (y[~test] - b - x[~test, 3] * beta[3]))
        errors["value"] += np.sum((rest - drive * (v[:, :2] @ less)) ** 2)
    total = np.sum((y - y.mean()) ** 2)
    assert abs(told["cv_r2_pooled"] - (1 - errors["full"] / total)) < 1e-10
    assert abs(told["dropouts"]["value:a"]["delta_r2_pooled"] - (errors["value"] - errors["full"]) / total) < 1e-10
    assert told["dropouts"]["b"]["delta_r2_pooled"] > 0.05 and told["dropouts"]["b"]["refit"] == "full"
    test = told["dropouts"]["context"]["permutation"]
    assert test["shifts"] == [0, 1, 2, -2, -1] and test["valid_trials"] == list(range(2, 22)) and test["omitted_trials"] == [0, 1, 22, 23]
    assert test["p_value"] == 0.2


def test_shift_at_zero_is_the_unshifted_refit():
    """With nothing shifted, the gain kind refits all gains on the reduced model's kernels."""
    design, x, y, trial, gains = problem()
    told = evaluate(
        design, Side(moments(x, y, trial), gains), FitConfig(kernel_alpha=0.5, gain_alpha=0.1), CVConfig(folds=3, split="trials"), [Dropout.gain("context", permutation_test=True).resolve_for(design.spec)]
    ).to_dict(design)["dropouts"]["context"]["permutation"]
    assert told["observed_delta_r2_pooled"] == told["delta_r2_pooled_per_shift"][0]
    assert max(told["delta_r2_pooled_per_shift"]) == told["observed_delta_r2_pooled"]


def test_penalties_are_looked_for_on_sums_that_are_added_up_once_a_fold(monkeypatch):
    from tempolin.functions.bilinear import Design, Moments, Problem
    from tempolin.plans.spec import FitConfig, ModelSpec, ParameterLayout, Signal

    spec = ModelSpec((Signal("a", (0, 0), 1),), dt=1.0)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(10, 8, 1)), rng.normal(size=(10, 8))
    moments = Moments(np.arange(10), np.full(10, 8.0), x.sum(1), np.einsum("tip,tiq->tpq", x, x), y.sum(1), np.einsum("tip,ti->tp", x, y), (y * y).sum(1))
    calls, real = [], Problem.kernel_system
    monkeypatch.setattr(Problem, "kernel_system", lambda self, *a: calls.append(1) or real(self, *a))
    Problem(Design(spec, ParameterLayout.of(spec, {"a": 1}), {"a": np.ones((1, 1))}), moments, {}, FitConfig()).fit()
    assert len(calls) == 6  # five folds and the whole, not one for each of 25 penalties
