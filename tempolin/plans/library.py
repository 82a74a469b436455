"""Models of a two-modality context task, on bins of 25 ms."""

from __future__ import annotations

from tempolin.plans.spec import Dropout, Event, Gain, ModelSpec, Signal

# Names of sources and models, windows and numbers of basis functions.
DEFAULT_DT = 0.025
FIT_WINDOW = (-1.0, 1.0)
STIMULI = ("is_aud_target", "is_aud_nontarget", "is_vis_target", "is_vis_nontarget")
OUTCOMES = ("is_hit", "is_miss", "is_correct_reject", "is_false_alarm")
FACE = ("ear", "jaw", "nose", "whisker_pad")


def _late(name: str) -> str:
    return f"{name}_late"


# Fixed values from here on: windows, numbers of basis functions, groups and names of the
# predictors and comparisons of each model.


def _stimuli(window: tuple[float, float], n_basis: int, basis: str) -> list[Event]:
    return [Event(s, window, n_basis, basis, gains="context", groups=("stimulus", "task")) for s in STIMULI]


def _late_stimuli() -> list[Event]:
    return [Event(_late(s), (0.1, 1), 5, source=s, gains="context", groups=("stimulus", "late_stimulus", "task")) for s in STIMULI]


def _movement(name: str, reach: float, n_basis: int, orthogonal: bool = True) -> Signal:
    groups = ("behavior", "face") if name in FACE else ("behavior",)
    return Signal(name, (-reach, reach), n_basis, normalize="zscore", groups=groups, orthogonalize_against="context_baseline" if orthogonal else None)


_CONTEXT = Signal("context_baseline", (0, 0), 1, groups="context")
_TIME = Signal("time", (0, 0), 1, normalize="zscore", groups="nuisance")


def _behavior() -> list:
    actions = [
        Event("licks", (-0.1, 0.1), 2, gains="context", groups=("behavior", "action")),
        Event("rewards", (-0.2, 0.2), 4, gains="context", groups=("behavior", "outcome")),
    ]
    return [*actions, *(_movement(n, 0.5, 5) for n in ("running_speed", "pupil_area")), *(_movement(n, 0.2, 4) for n in FACE), _CONTEXT, _TIME]


def _shift(name: str, *predictors: str) -> Dropout:
    """The context gain of some predictors, with a shift test."""
    return Dropout.gain_terms("context", *predictors, name=f"{name}_context_gain", permutation_test=True)


_BASELINE = Dropout.predictors("context_baseline", permutation_test=True)


def _default_dropouts() -> list[Dropout]:
    late = [_late(s) for s in STIMULI]
    return [
        _shift("early_stim", *STIMULI), *(_shift(f"early_{s}", s) for s in STIMULI),
        _shift("late_stim", *late), *(_shift(f"late_{s}", s) for s in late),
        _shift("reward", "rewards"), _shift("lick", "licks"), _BASELINE,
    ]


def _model(name: str, predictors: list, dropouts: list[Dropout], gains: tuple = (Gain("context", source="trial_context"),), window: tuple[float, float] = FIT_WINDOW) -> ModelSpec:
    return ModelSpec(tuple(predictors), gains, name, dt=DEFAULT_DT, fit_window=window, fit_events=STIMULI, dropouts=tuple(dropouts))


DEFAULT = _model("default", [*_stimuli((0, 0.1), 4, "identity"), *_late_stimuli(), *_behavior()], _default_dropouts())
NO_FACE = DEFAULT.without_group("face", name="no_face")
NO_HIT_LONG_STIM = _model("no_hit_long_stim", [*_stimuli((0, 1), 10, "cosine"), *_behavior()], [Dropout.gain("context", permutation_test=True), _BASELINE])
ALL_RESPONSE = DEFAULT.add(*(Event(o, (0.1, 1), 9, gains="context", groups=("response", "outcome", "task")) for o in OUTCOMES if o != "is_hit"), name="all_response")
ONLY_BASELINE = _model(
    "only_baseline",
    [_CONTEXT, *(_movement(n, 0.5, 10) for n in FACE), *(_movement(n, 0.5, 10, orthogonal=False) for n in ("running_speed", "pupil_area")), _TIME],
    [_BASELINE],
    gains=(),
    window=(-1.5, 0),
)
#: Outcome kernels that no model uses by default, for models built on the others.
TASK_PREDICTORS = tuple(Event(o, (0.1, 1), 5, groups="task") for o in ("is_hit", "is_false_alarm"))

MODELS = {m.name: m for m in (DEFAULT, NO_FACE, NO_HIT_LONG_STIM, ALL_RESPONSE, ONLY_BASELINE)}
