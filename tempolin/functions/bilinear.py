"""Bilinear fits from per-trial moments.

All that a fit needs of the rows are sums per trial: n, sum x, sum x x', sum y, sum x y and
sum y y.  Gains are constant within a trial, so a trial with gain weights w (one per
column) contributes (w w') * sum x x' to the cross products of the weighted design.
Trials with the same gains, in the same fold, are added up before anything is solved.

Kernels: penalised least squares with a free intercept.  Gains: ridge without one, on
the drives of the kernels.  The two alternate; kernels of predictors with gains are
scaled to unit length in between.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np

from tempolin.plans.spec import FitConfig, ModelSpec, ParameterLayout

_TINY = 1e-12
_EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Moments:
    """Sums over the rows of each trial (first axis) for one target.

    ``y`` is taken from ``shift``, so that sums of squares keep their digits where its mean is
    large; intercepts then count from ``shift`` too.
    """

    trials: np.ndarray
    n: np.ndarray
    x: np.ndarray
    xx: np.ndarray
    y: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    shift: float = 0.0

    @property
    def raw_yy(self) -> float:
        """Sum of squares of the target itself."""
        return float(self.yy.sum() + 2 * self.shift * self.y.sum() + self.shift**2 * self.n.sum())

    def at(self, keep: np.ndarray) -> Moments:
        return Moments(self.trials[keep], self.n[keep], self.x[keep], self.xx[keep], self.y[keep], self.xy[keep], self.yy[keep], self.shift)

    def summed(self, labels: np.ndarray, count: int) -> Moments:
        """One set of sums for each label 0 to count - 1."""

        def add(values: np.ndarray) -> np.ndarray:
            out = np.zeros((count, *values.shape[1:]))
            np.add.at(out, labels, values)
            return out

        return Moments(np.arange(count), *map(add, (self.n, self.x, self.xx, self.y, self.xy, self.yy)), self.shift)

    def without(self, columns: np.ndarray) -> Moments:
        """The moments with some columns of x zero."""
        keep = np.ones(self.x.shape[1])
        keep[columns] = 0
        return replace(self, x=self.x * keep, xx=self.xx * keep[:, None] * keep[None, :], xy=self.xy * keep)

    def with_constant(self, column: int, values: np.ndarray) -> Moments:
        """The moments with one column of x replaced by a value per trial."""
        x, xx, xy = self.x.copy(), self.xx.copy(), self.xy.copy()
        x[:, column] = values * self.n
        xx[:, column, :] = values[:, None] * self.x
        xx[:, :, column] = values[:, None] * self.x
        xx[:, column, column] = values**2 * self.n
        xy[:, column] = values * self.y
        return replace(self, x=x, xx=xx, xy=xy)


@dataclass(frozen=True)
class Design:
    """Names and places of the parameters, and the bases that turn them into kernels."""

    spec: ModelSpec
    layout: ParameterLayout
    bases: Mapping[str, np.ndarray]
    lags: Mapping[str, np.ndarray] = field(default_factory=dict)

    @property
    def gain_columns(self) -> list[tuple[int, str | None, slice]]:
        """(index in the gain vector, gain or None for the offset, columns of the predictor)."""
        out: list[tuple[int, str | None, slice]] = [(i, None, self.layout.beta_slices[p]) for p, i in self.layout.gain_offsets.items()]
        return out + [(i, g, self.layout.beta_slices[p]) for (g, p), i in self.layout.gain_coefficients.items()]

    @property
    def free_columns(self) -> np.ndarray:
        """Columns of predictors without gains."""
        columns = np.zeros(self.layout.beta_size, dtype=bool)
        for p in self.spec.predictors:
            columns[self.layout.beta_slices[p.name]] = not p.gains
        return columns

    def keep_mask(self, gains: Sequence[str] = (), terms: Sequence[tuple[str, str]] = (), predictors: Sequence[str] = ()) -> np.ndarray:
        """Entries of the gain vector that a reduced model keeps."""
        keep = np.ones(self.layout.gain_size, dtype=bool)
        for (gain, predictor), index in self.layout.gain_coefficients.items():
            keep[index] = not (gain in gains or (gain, predictor) in terms or predictor in predictors)
        for predictor, index in self.layout.gain_offsets.items():
            keep[index] = predictor not in predictors
        return keep

    def columns_of(self, predictors: Sequence[str]) -> np.ndarray:
        columns = np.zeros(self.layout.beta_size, dtype=bool)
        for name in predictors:
            columns[self.layout.beta_slices[name]] = True
        return columns

    def unit_length(self, beta: np.ndarray, gain: np.ndarray) -> None:
        """Scale kernels that have gains to length 1 and their gains the other way."""
        scales = {}
        for p in self.spec.predictors:
            if p.gains:
                where = self.layout.beta_slices[p.name]
                length = float(np.linalg.norm(self.bases[p.name] @ beta[where]))
                if length >= _TINY:
                    beta[where] /= length
                    scales[p.name] = length
        for predictor, index in self.layout.gain_offsets.items():
            gain[index] *= scales.get(predictor, 1.0)
        for (_, predictor), index in self.layout.gain_coefficients.items():
            gain[index] *= scales.get(predictor, 1.0)


def balanced_folds(trials: np.ndarray, rows: np.ndarray, folds: int | None) -> np.ndarray:
    """Inner fold of each trial: largest first, each to the fold with the fewest rows.

    Ties go to the later trial first and to the lowest fold, so that the result depends
    on nothing but the counts.
    """
    count = 5 if folds is None else folds
    if len(trials) < count:
        raise ValueError(f"{len(trials)} trials are too few for {count} inner folds")
    out, load = np.zeros(len(trials), dtype=int), np.zeros(count)
    for k in np.argsort(rows, kind="stable")[::-1]:
        out[k] = int(np.argmin(load))
        load[out[k]] += rows[k]
    return out


def _quadratic(xx: np.ndarray, c: np.ndarray) -> float:
    """Sum over groups of c' xx c."""
    return float(((xx @ c[:, :, None])[:, :, 0] * c).sum())


def solve_ridge(system: np.ndarray, target: np.ndarray, alpha: float) -> np.ndarray:
    system = system + alpha * np.eye(len(system))
    return np.linalg.solve((system + system.T) / 2, target)


def solve_lasso(system: np.ndarray, target: np.ndarray, alpha: float, n: float, start: np.ndarray, max_iter: int = 10_000, tol: float = 1e-10) -> np.ndarray:
    """Minimise squared error / 2n + alpha * sum |beta| by coordinate descent on the cross products."""
    beta, diagonal = start.copy(), np.diag(system).copy()
    slope = target - system @ beta
    active = np.flatnonzero(diagonal > _TINY)
    beta[diagonal <= _TINY] = 0.0
    for _ in range(max_iter):
        most = 0.0
        for j in active:
            old = beta[j]
            pull = slope[j] + diagonal[j] * old
            beta[j] = np.sign(pull) * max(abs(pull) - n * alpha, 0.0) / diagonal[j]
            if beta[j] != old:
                slope -= system[:, j] * (beta[j] - old)
                most = max(most, abs(beta[j] - old))
        if most <= tol * max(1.0, float(np.abs(beta).max(initial=0.0))):
            break
    return beta


@dataclass(frozen=True)
class Iteration:
    number: int
    mse: float
    kernel_alpha: float
    gain_alpha: float | None
    relative_mse_change: float
    relative_prediction_change: float
    relative_gain_change: float
    max_abs_gain_change: float


@dataclass(frozen=True)
class FitState:
    beta: np.ndarray
    gain: np.ndarray
    intercept: float
    iterations: tuple[Iteration, ...]
    converged: bool
    #: Of the kernels and the gains, where a penalty was looked for: the penalties, the errors of the inner folds, and the chosen one.
    searched: Mapping[str, dict] = field(default_factory=dict)

    @property
    def kernel_alpha(self) -> float:
        return self.iterations[-1].kernel_alpha

    @property
    def gain_alpha(self) -> float | None:
        return self.iterations[-1].gain_alpha

    def diagnostics(self) -> dict:
        last = self.iterations[-1]
        names = ("relative_mse_change", "relative_prediction_change", "relative_gain_change", "max_abs_gain_change")
        return {"converged": bool(self.converged), "n_iter": len(self.iterations), **{k: float(getattr(last, k)) for k in names}}


class Problem:
    """One target on some trials: sums by (inner fold, gains), and the two solves on them."""

    def __init__(self, design: Design, moments: Moments, gains: Mapping[str, np.ndarray], config: FitConfig):
        """``gains`` has for each gain its value at each trial of ``moments``."""
        self.design, self.config = design, config
        needs_folds = config.kernel_alpha is None or (config.gain_alpha is None and design.layout.gain_size > 0)
        folds = balanced_folds(moments.trials, moments.n, config.inner_cv_folds) if needs_folds else np.zeros(len(moments.trials), dtype=int)
        names = design.spec.gain_names
        rows = np.column_stack([folds, *[np.asarray(gains[g], dtype=float) for g in names]])
        groups, label = np.unique(rows, axis=0, return_inverse=True)
        self.fold, self.values = groups[:, 0].astype(int), {g: groups[:, 1 + k] for k, g in enumerate(names)}
        self.sums = moments.summed(label.ravel(), len(groups))
        self.folds = sorted(set(self.fold.tolist()))
        self.searched: dict[str, dict] = {}

    def weights(self, gain: np.ndarray) -> np.ndarray:
        """(groups, columns): what each column of the design is multiplied by."""
        out = np.ones((len(self.fold), self.design.layout.beta_size))
        for p, index in self.design.layout.gain_offsets.items():
            out[:, self.design.layout.beta_slices[p]] = gain[index]
        for (g, p), index in self.design.layout.gain_coefficients.items():
            out[:, self.design.layout.beta_slices[p]] += gain[index] * self.values[g][:, None]
        return out

    def sse(self, intercept: float, coefficients: np.ndarray, at: np.ndarray | slice = slice(None)) -> float:
        """Squared error of intercept + x . coefficients (one row a group)."""
        s = self.sums
        c = coefficients[at]
        total = (
            s.yy[at].sum() - 2 * intercept * s.y[at].sum() - 2 * np.einsum("gp,gp->", c, s.xy[at]) + intercept**2 * s.n[at].sum()
            + 2 * intercept * np.einsum("gp,gp->", c, s.x[at]) + _quadratic(s.xx[at], c)
        )
        return max(float(total), 0.0)

    def kernel_system(self, weights: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float]:
        """Centred cross products of the weighted design: system, target, n, mean x, mean y."""
        s, w = self.sums, weights[at]
        n = float(s.n[at].sum())
        x, y = np.einsum("gp,gp->p", w, s.x[at]), float(s.y[at].sum())
        xx = (s.xx[at] * w[:, :, None] * w[:, None, :]).sum(axis=0)
        xy = np.einsum("gp,gp->p", w, s.xy[at])
        return xx - np.outer(x, x) / n, xy - x * y / n, n, x / n, y / n

    def solve_kernel(self, weights: np.ndarray, alpha: float, at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        return self._solved(self.kernel_system(weights, at), alpha, start)

    def _solved(self, sums: tuple, alpha: float, start: np.ndarray) -> tuple[np.ndarray, float]:
        system, target, n, mean_x, mean_y = sums
        beta = solve_lasso(system, target, alpha, n, start) if self.config.regularizer == "lasso" else solve_ridge(system, target, alpha)
        return beta, float(mean_y - mean_x @ beta)

    def fit_kernel(self, gain: np.ndarray, alpha: float | None, start: np.ndarray) -> tuple[np.ndarray, float, float]:
        weights, everything = self.weights(gain), np.arange(len(self.fold))
        if alpha is None:
            def solver(train: np.ndarray):
                sums = self.kernel_system(weights, train)
                return lambda a: self._solved(sums, a, np.zeros_like(start))

            def scorer(test: np.ndarray):
                s, w = self.sums, weights[test]
                xx, xy, x = (s.xx[test] * w[:, :, None] * w[:, None, :]).sum(axis=0), (w * s.xy[test]).sum(axis=0), (w * s.x[test]).sum(axis=0)
                yy, y, n = s.yy[test].sum(), s.y[test].sum(), s.n[test].sum()
                return lambda f: max(float(yy - 2 * f[1] * y - 2 * f[0] @ xy + f[1] ** 2 * n + 2 * f[1] * (f[0] @ x) + f[0] @ xx @ f[0]), 0.0)

            alpha = self._best("kernel", solver, scorer)
        beta, intercept = self.solve_kernel(weights, alpha, everything, start)
        return beta, intercept, alpha

    def _best(self, part: str, solver, scorer) -> float:
        """The first alpha with the least mean over folds of the folds' mean squared errors.

        ``solver`` and ``scorer`` add up the groups of a fold once, for all penalties.
        """
        folds = []
        for fold in self.folds:
            test = np.flatnonzero(self.fold == fold)
            folds.append((solver(np.flatnonzero(self.fold != fold)), scorer(test), self.sums.n[test].sum()))
        means = [float(np.mean([error(solve(alpha)) / n for solve, error, n in folds])) for alpha in self.config.alphas]
        best = float(self.config.alphas[int(np.argmin(means))])
        self.searched[part] = {"alphas": [float(a) for a in self.config.alphas], "errors": means, "chosen": best}
        return best

    def gain_map(self, beta: np.ndarray) -> np.ndarray:
        """(groups, columns, gain entries): the columns that each gain entry multiplies."""
        out = np.zeros((len(self.fold), self.design.layout.beta_size, self.design.layout.gain_size))
        for index, gain, where in self.design.gain_columns:
            out[:, where, index] = beta[where] if gain is None else self.values[gain][:, None] * beta[where]
        return out

    def gain_system(self, beta: np.ndarray, intercept: float) -> tuple[np.ndarray, np.ndarray]:
        """Cross products of the drives with each other and with what is left of the target, per group."""
        s, into = self.sums, self.gain_map(beta)
        free = np.where(self.design.free_columns, beta, 0.0)
        left = s.xy - intercept * s.x - s.xx @ free
        return into.transpose(0, 2, 1) @ (s.xx @ into), np.einsum("gpi,gp->gi", into, left)

    def fit_gain(self, beta: np.ndarray, intercept: float, alpha: float | None, keep: np.ndarray) -> tuple[np.ndarray, float | None]:
        gain = np.zeros(self.design.layout.gain_size)
        if not keep.any():
            return gain, None
        systems, targets = self.gain_system(beta, intercept)
        systems, targets = systems[:, keep][:, :, keep], targets[:, keep]

        def solver(at):
            system, target = systems[at].sum(axis=0), targets[at].sum(axis=0)
            return lambda a: solve_ridge(system, target, a)

        def scorer(test: np.ndarray):
            free = np.broadcast_to(np.where(self.design.free_columns, beta, 0.0), (len(self.fold), len(beta)))
            rest, system, target = self.sse(intercept, free, test), systems[test].sum(axis=0), targets[test].sum(axis=0)
            return lambda g: max(float(rest - 2 * g @ target + g @ system @ g), 0.0)

        if alpha is None:
            alpha = self._best("gain", solver, scorer)
        gain[keep] = solver(slice(None))(alpha)
        return gain, alpha

    def coefficients(self, beta: np.ndarray, gain: np.ndarray) -> np.ndarray:
        return self.weights(gain) * beta

    def fit(self, keep: np.ndarray | None = None) -> FitState:
        """Alternate until the retained gain coefficients have settled; at a tolerance of 0, until nothing moves at all."""
        config, layout, s = self.config, self.design.layout, self.sums
        keep = np.ones(layout.gain_size, dtype=bool) if keep is None else keep
        gain = np.zeros(layout.gain_size)
        gain[list(layout.gain_offsets.values())] = 1.0
        gain[~keep] = 0.0
        watched = [i for i in layout.gain_coefficients.values() if keep[i]]
        beta, intercept = np.zeros(layout.beta_size), 0.0
        kernel_alpha, gain_alpha = config.kernel_alpha, config.gain_alpha
        n, mean = float(s.n.sum()), float(s.y.sum() / s.n.sum())
        spread = max(float(np.sqrt(max(s.yy.sum() / n - mean**2, 0.0))), _EPS)
        last_mse, last = s.raw_yy / n, (-s.shift, np.zeros((len(self.fold), layout.beta_size)))
        before, settled, converged, parameters = gain[watched].copy(), 0, False, np.zeros(0)
        trace: list[Iteration] = []
        for number in range(config.max_iter):
            beta, intercept, kernel_alpha = self.fit_kernel(gain, kernel_alpha, beta)
            self.design.unit_length(beta, gain)
            gain, found = self.fit_gain(beta, intercept, gain_alpha, keep)
            gain_alpha = found if gain_alpha is None else gain_alpha
            now = (intercept, self.coefficients(beta, gain))
            mse = self.sse(*now) / n
            moved = np.abs(gain[watched] - before)
            trace.append(
                Iteration(
                    number, mse, float(kernel_alpha), gain_alpha, abs(mse - last_mse) / max(abs(last_mse), _EPS),
                    float(np.sqrt(self._difference(now, last) / n) / spread),
                    float((moved / (1 + np.abs(before))).max(initial=0.0)), float(moved.max(initial=0.0)),
                )
            )
            if config.verbose:
                print(trace[-1])
            earlier, parameters = parameters, np.concatenate([[intercept], beta, gain])
            # coefficients can rest (at 0, where trials of all gains are alike) while offsets, kernels and the intercept still move
            rests = trace[-1].max_abs_gain_change <= config.tol and (config.tol > 0 or np.array_equal(parameters, earlier))
            settled = settled + 1 if rests else 0
            if not watched or settled >= config.patience:
                converged = True
                break
            before, last_mse, last = gain[watched].copy(), mse, now
        gain, gain_alpha = self.fit_gain(beta, intercept, gain_alpha, keep)
        trace[-1] = replace(trace[-1], mse=self.sse(intercept, self.coefficients(beta, gain)) / n, gain_alpha=gain_alpha)
        return FitState(beta, gain, intercept, tuple(trace), converged, self.searched)

    def _difference(self, a: tuple[float, np.ndarray], b: tuple[float, np.ndarray]) -> float:
        """Sum of squared differences of two predictions."""
        step, c, s = a[0] - b[0], a[1] - b[1], self.sums
        total = step**2 * s.n.sum() + 2 * step * np.einsum("gp,gp->", c, s.x) + _quadratic(s.xx, c)
        return max(float(total), 0.0)
