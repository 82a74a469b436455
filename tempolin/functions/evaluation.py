"""Cross-validation, reduced models and shift tests for one target, from its trial moments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np

from tempolin.functions.bilinear import Design, FitState, Moments, Problem
from tempolin.plans.spec import CVConfig, FitConfig, Gain, History, ResolvedDropout


def r2(sse: float, moments: Moments) -> float:
    """1 - SSE / TSS with the mean of these rows; NaN where the target doesn't vary."""
    n, y = float(moments.n.sum()), float(moments.y.sum())
    total = float(moments.yy.sum()) - y * y / n
    # what rounding leaves of a constant: of the sums, and of values that were taken from a mean
    least = 1e-12 * float(moments.yy.sum()) + 1e-24 * moments.raw_yy
    return 1 - sse / total if total > max(least, 1e-300) else float("nan")


def outer_folds(trials: np.ndarray, groups: np.ndarray | None, config: CVConfig) -> tuple[list[np.ndarray], str, list[int] | None]:
    """Held-out trials of each fold, the kind of split, and the groups that are held out.

    ``trials`` have selected rows, in order; ``groups`` are theirs.  Groups come in the
    order of their first trial.
    """
    if config.split == "groups" and groups is None:
        raise ValueError("a split by groups needs trial groups")
    if groups is not None and config.split != "trials":
        order = list(dict.fromkeys(groups.tolist()))
        if len(order) < 2:
            raise ValueError("a split by groups needs two groups with selected rows")
        return [trials[groups == g] for g in order], "groups", order
    if len(trials) < config.folds:
        raise ValueError(f"{len(trials)} trials are too few for {config.folds} folds")
    if config.seed is not None:
        trials = np.random.default_rng(config.seed).permutation(trials)
    return np.array_split(trials, config.folds), "trials", None


def edge_shifts(values: np.ndarray) -> np.ndarray:
    """0, then forward shifts up to half the first run of equal values, then backward ones up to half the last."""
    values = np.asarray(values, dtype=float)
    if len(values) < 2:
        raise ValueError("a shift test needs two trials")
    first, last = (int(np.argmin(np.append(np.isclose(v, v[0]), False))) for v in (values, values[::-1]))
    if first == len(values):
        raise ValueError("a shift test needs values that change between trials")
    if first // 2 + last // 2 == 0:
        raise ValueError("the first and last runs of trials are too short for any shift")
    return np.array([*range(first // 2 + 1), *range(-(last // 2), 0)])


def common_trials(trials: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Trials that no shift would wrap around."""
    out = trials[max(0, shifts.max()) : len(trials) + min(0, shifts.min())]
    if len(out) < 2:
        raise ValueError("fewer than two trials are left that no shift wraps around")
    return out


@dataclass
class ShiftPlan:
    """A shift test laid out over the trials of a session."""

    kind: str
    shifts: np.ndarray
    values: np.ndarray
    eligible: np.ndarray
    valid: np.ndarray
    gain: str | None = None
    terms: tuple[tuple[str, str], ...] = ()
    predictor: str | None = None


def plan_shifts(design: Design, dropout: ResolvedDropout, moments: Moments, gains: Mapping[str, np.ndarray]) -> ShiftPlan:
    """``moments`` are of all selected rows, ordered by trial, and ``gains`` has their values."""
    here = f"comparison {dropout.name!r}"
    if dropout.predictors:
        name = dropout.predictors[0]
        predictor = design.spec.predictor(name)
        where = design.layout.beta_slices[name]
        if predictor.gains:
            raise ValueError(f"{here}: a predictor with gains has no shift test")
        if isinstance(predictor, History):
            raise ValueError(f"{here}: the target's history has no shift test")
        if where.stop - where.start != 1:
            raise ValueError(f"{here}: a predictor of several columns has no shift test")
        column = where.start
        values = moments.x[:, column] / moments.n
        spread = moments.xx[:, column, column] / moments.n - values**2
        if np.any(spread > 1e-10 * (1 + values**2)):
            raise ValueError(f"{here}: predictor {name!r} changes within a trial")
        kind, gain, terms = "predictor", None, ()
    else:
        touched = set(dropout.gains).union(g for g, _ in dropout.gain_terms)
        if len(touched) != 1:
            raise ValueError(f"{here}: a shift test is for one gain")
        gain, name, kind = next(iter(touched)), None, "gain"
        terms = tuple(t for t in design.layout.gain_coefficients if t[0] in dropout.gains or t in dropout.gain_terms)
        values = np.asarray(gains[gain], dtype=float)
    shifts = edge_shifts(values)
    rolled = np.array([np.roll(values, k) for k in shifts])
    return ShiftPlan(kind, shifts, rolled, moments.trials, common_trials(moments.trials, shifts), gain, terms, name)


@dataclass
class Side:
    """Train or test: moments by trial and the gains of those trials."""

    moments: Moments
    gains: dict[str, np.ndarray]

    def at(self, keep: np.ndarray) -> Side:
        return Side(self.moments.at(keep), {g: v[keep] for g, v in self.gains.items()})

    def without(self, columns: np.ndarray) -> Side:
        return Side(self.moments.without(columns), self.gains) if columns.any() else self

    def sse(self, design: Design, intercept: float, beta: np.ndarray, gain: np.ndarray) -> float:
        problem = Problem(design, self.moments, self.gains, _SCORING)
        return problem.sse(intercept, problem.coefficients(beta, gain))


#: The name under which chosen terms read a shifted gain.
_SHIFTED = "shifted gain"
_SCORING = FitConfig(kernel_alpha=1.0, gain_alpha=1.0)


def shifted_sse(design: Design, plan: ShiftPlan, state: FitState, train: Side, test: Side, config: FitConfig, where_train: np.ndarray, where_test: np.ndarray) -> np.ndarray:
    """Squared test error at each shift, with the other half of the parameters frozen.

    ``where_train`` and ``where_test`` are the trials' places in the plan.
    """
    out = []
    for values in plan.values:
        if plan.kind == "gain":
            # only the chosen terms see the shifted gain: give it to them under a name of its own
            changed = {t: _SHIFTED for t in plan.terms}
            moved = _renamed(design, changed)
            pair = [Side(s.moments, {**s.gains, _SHIFTED: values[w]}) for s, w in ((train, where_train), (test, where_test))]
            problem = Problem(moved, pair[0].moments, pair[0].gains, _SCORING)
            keep = np.ones(design.layout.gain_size, dtype=bool)
            if state.gain_alpha is None:
                raise RuntimeError("a shift test of a gain needs the penalty of the reduced fit's gains")
            gain, _ = problem.fit_gain(state.beta, state.intercept, state.gain_alpha, keep)
            out.append(pair[1].sse(moved, state.intercept, state.beta, gain))
        else:
            column = design.layout.beta_slices[plan.predictor].start
            fitted = Problem(design, train.moments.with_constant(column, values[where_train]), train.gains, _with_regularizer(config))
            beta, intercept, _ = fitted.fit_kernel(state.gain, state.kernel_alpha, state.beta)
            out.append(Side(test.moments.with_constant(column, values[where_test]), test.gains).sse(design, intercept, beta, state.gain))
    return np.array(out)


def _with_regularizer(config: FitConfig) -> FitConfig:
    return FitConfig(config.regularizer, kernel_alpha=1.0, gain_alpha=1.0)


def _renamed(design: Design, changed: Mapping[tuple[str, str], str]) -> Design:
    """The design with some gain terms reading another gain; places stay."""
    spec = design.spec
    predictors = [replace(p, gains=tuple(changed.get((g, p.name), g) for g in p.gains)) for p in spec.predictors]
    used = set().union(*(p.gains for p in predictors))
    gains = [g for g in (*spec.gains, Gain(_SHIFTED)) if g.name in used]
    terms = {(changed.get((g, p), g), p): i for (g, p), i in design.layout.gain_coefficients.items()}
    return replace(design, spec=replace(spec, predictors=tuple(predictors), gains=tuple(gains), dropouts=()), layout=replace(design.layout, gain_coefficients=terms))


@dataclass
class Evaluation:
    """The summary of one target."""

    state: FitState
    train_r2: float
    cv: dict = field(default_factory=dict)
    dropouts: dict = field(default_factory=dict)

    def to_dict(self, design: Design) -> dict:
        cv = self.cv
        kernels = {p.name: design.bases[p.name] @ self.state.beta[design.layout.beta_slices[p.name]] for p in design.spec.predictors}
        table = {
            p.name: {"offset": float(self.state.gain[design.layout.gain_offsets[p.name]]), **{g: float(self.state.gain[design.layout.gain_coefficients[(g, p.name)]]) for g in p.gains}}
            for p in design.spec.predictors
            if p.gains
        }
        last = self.state.diagnostics()
        return {
            "model": design.spec.name, "train_r2": self.train_r2, **cv, "n_iter": last["n_iter"], "converged": last["converged"],
            "final_converged": last["converged"], "final_convergence": last, "intercept": float(self.state.intercept),
            "kernels": {k: v.tolist() for k, v in kernels.items()}, "gain_table": table, "penalties": dict(self.state.searched), "dropouts": self.dropouts,
        }


def _mean(values: Sequence[float]) -> float:
    known = [v for v in values if v == v]
    return float(np.mean(known)) if known else float("nan")


def evaluate(
    design: Design, selected: Side, fit: FitConfig, cv: CVConfig, dropouts: Sequence[ResolvedDropout], groups: np.ndarray | None = None,
    fold_sides: Sequence[tuple[Side, Side]] | None = None,
) -> Evaluation:
    """Fit all selected rows, then every fold, reduced model and shift.

    ``selected`` is ordered by trial.  ``fold_sides`` replaces the train and test
    moments where they are not just those of some trials (a gap around the history).
    """
    m = selected.moments
    plans = {d.name: plan_shifts(design, d, m, selected.gains) for d in dropouts if d.permutation_test}
    state = Problem(design, m, selected.gains, fit).fit()
    train_r2 = r2(selected.sse(design, state.intercept, state.beta, state.gain), m)
    folds, split, held_out = outer_folds(m.trials, groups, cv)

    full: list[dict] = []
    tests: list[Moments] = []
    reduced: dict[str, list[dict]] = {d.name: [] for d in dropouts}
    shifted: dict[str, list[dict]] = {name: [] for name in plans}
    for number, held in enumerate(folds):
        out = np.isin(m.trials, held)
        train, test = (selected.at(~out), selected.at(out)) if fold_sides is None else fold_sides[number]
        if not train.moments.n.sum() or not test.moments.n.sum():
            raise ValueError(f"fold {number + 1} has no selected rows to train or to test on")
        whole = Problem(design, train.moments, train.gains, fit).fit()
        sse = test.sse(design, whole.intercept, whole.beta, whole.gain)
        full.append({"sse": sse, "r2": r2(sse, test.moments), "diagnostics": whole.diagnostics()})
        tests.append(test.moments)
        for d in dropouts:
            reduced[d.name].append(_reduced(design, d, train, test, whole, fit))
            if d.permutation_test:
                shifted[d.name].append(_shifts(design, d, plans[d.name], train, test, fit, number))

    pooled = _joined(tests)
    full_pooled = r2(sum(f["sse"] for f in full), pooled)
    converged = [f["diagnostics"]["converged"] for f in full]
    summary = {
        "cv_r2": _mean([f["r2"] for f in full]), "cv_r2_per_fold": [f["r2"] for f in full], "cv_r2_pooled": full_pooled, "cv_split": split,
        "cv_held_out_groups": held_out, "n_iter_per_fold": [f["diagnostics"]["n_iter"] for f in full], "cv_converged": all(converged),
        "cv_converged_per_fold": converged, "cv_convergence_per_fold": [f["diagnostics"] for f in full],
    }
    told = {d.name: _dropout_summary(d, full, reduced[d.name], pooled, full_pooled, plans.get(d.name), shifted.get(d.name)) for d in dropouts}
    return Evaluation(state, train_r2, summary, told)


def _joined(parts: Sequence[Moments]) -> Moments:
    names = ("trials", "n", "x", "xx", "y", "xy", "yy")
    return Moments(*(np.concatenate([getattr(p, k) for p in parts]) for k in names), parts[0].shift)


def _reduced(design: Design, d: ResolvedDropout, train: Side, test: Side, whole: FitState, fit: FitConfig) -> dict:
    keep = design.keep_mask(d.gains, d.gain_terms, d.predictors)
    if d.refit == "gains":
        if whole.gain_alpha is None:
            raise RuntimeError("a reduced model of gains alone needs the penalty of the full fit's gains")
        gain, _ = Problem(design, train.moments, train.gains, _SCORING).fit_gain(whole.beta, whole.intercept, whole.gain_alpha, keep)
        sse, told = test.sse(design, whole.intercept, whole.beta, gain), None
    else:
        gone = design.columns_of(d.predictors)
        state = Problem(design, train.without(gone).moments, train.gains, fit).fit(keep)
        sse, told = test.without(gone).sse(design, state.intercept, state.beta, state.gain), state.diagnostics()
    return {"sse": sse, "r2": r2(sse, test.moments), "diagnostics": told}


def _shifts(design: Design, d: ResolvedDropout, plan: ShiftPlan, train: Side, test: Side, fit: FitConfig, number: int) -> dict:
    train, test = (s.at(np.isin(s.moments.trials, plan.valid)) for s in (train, test))
    if not train.moments.n.sum() or not test.moments.n.sum():
        raise ValueError(f"fold {number + 1} has no rows for the shift test of {d.name!r}")
    gone = design.columns_of(d.predictors)
    state = Problem(design, train.without(gone).moments, train.gains, fit).fit(design.keep_mask(d.gains, d.gain_terms, d.predictors))
    sse = test.without(gone).sse(design, state.intercept, state.beta, state.gain)
    places = [np.searchsorted(plan.eligible, s.moments.trials) for s in (train, test)]
    return {
        "sse": sse, "r2": r2(sse, test.moments), "diagnostics": state.diagnostics(), "test": test.moments,
        "shifted": shifted_sse(design, plan, state, train, test, fit, *places),
    }


def _dropout_summary(d: ResolvedDropout, full: list, reduced: list, pooled: Moments, full_pooled: float, plan: ShiftPlan | None, shifted: list | None) -> dict:
    reduced_pooled = r2(sum(x["sse"] for x in reduced), pooled)
    deltas = [a["r2"] - b["r2"] for a, b in zip(full, reduced)]
    own = [x["diagnostics"]["converged"] for x in reduced] if d.refit == "full" else None
    both = [f["diagnostics"]["converged"] and (own is None or own[k]) for k, f in enumerate(full)]
    return {
        "predictors": list(d.predictors), "gains": list(d.gains), "gain_terms": [list(t) for t in d.gain_terms], "refit": d.refit,
        "permutation_test": d.permutation_test, "reduced_r2": _mean([x["r2"] for x in reduced]), "reduced_r2_per_fold": [x["r2"] for x in reduced],
        "reduced_r2_pooled": reduced_pooled, "delta_r2": _mean(deltas), "delta_r2_per_fold": deltas, "delta_r2_pooled": full_pooled - reduced_pooled,
        "metric_converged": all(both), "metric_converged_per_fold": both, "reduced_converged_per_fold": own,
        "reduced_convergence_per_fold": [x["diagnostics"] for x in reduced] if d.refit == "full" else None,
        "permutation": None if plan is None else _shift_summary(plan, shifted),
    }


def p_value(deltas: Sequence[float]) -> float:
    """Share of finite values that reach the first one; NaN if that isn't finite."""
    values = np.asarray(deltas, dtype=float)
    known = values[np.isfinite(values)]
    return float(np.mean(known >= values[0])) if np.isfinite(values[0]) else float("nan")


def _shift_summary(plan: ShiftPlan, folds: list) -> dict:
    pooled = _joined([f["test"] for f in folds])
    base = r2(sum(f["sse"] for f in folds), pooled)
    per_fold = [[r2(float(f["shifted"][k]), f["test"]) - f["r2"] for f in folds] for k in range(len(plan.shifts))]
    pooled_deltas = [r2(float(sum(f["shifted"][k] for f in folds)), pooled) - base for k in range(len(plan.shifts))]
    return {
        "kind": plan.kind, "shifts": plan.shifts.tolist(), "n_unique_shifts": len(plan.shifts), "eligible_trials": plan.eligible.tolist(),
        "valid_trials": plan.valid.tolist(), "omitted_trials": sorted(set(plan.eligible.tolist()) - set(plan.valid.tolist())), "p_value": p_value(pooled_deltas),
        "observed_delta_r2": _mean(per_fold[0]), "observed_delta_r2_pooled": pooled_deltas[0], "delta_r2_per_shift": [_mean(f) for f in per_fold],
        "delta_r2_per_shift_per_fold": per_fold, "delta_r2_pooled_per_shift": pooled_deltas, "reduced_r2_per_fold": [f["r2"] for f in folds],
        "reduced_r2_pooled": base, "reduced_converged_per_fold": [f["diagnostics"]["converged"] for f in folds],
        "reduced_convergence_per_fold": [f["diagnostics"] for f in folds],
    }
