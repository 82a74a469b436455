import numpy as np
import pytest

from tempolin.functions.basis import lags_of, linear_cosine_basis, log_cosine_basis, make_basis, window_bounds
from tempolin.plans.library import ALL_RESPONSE, DEFAULT, MODELS, NO_FACE
from tempolin.plans.spec import CVConfig, Dropout, Event, FitConfig, Gain, History, ModelSpec, ParameterLayout, Signal


def model(**more):
    return ModelSpec((Event("a", (0, 1), gains="g", groups="x"), Signal("b", (0, 0), 1, groups=("x", "y"))), (Gain("g"),), dt=0.1, **more)


def test_bare_strings_are_tuples_of_one():
    assert model().predictor("a").gains == ("g",)
    assert model().predictor("a").source == "a"


@pytest.mark.parametrize(
    "make",
    [
        lambda: Event("", (0, 1)),
        lambda: Event("a", (1, 0)),
        lambda: Event("a", (0, 1), 0),
        lambda: Event("a", (0, 1), gains=("g", "g")),
        lambda: Signal("a", (0, 1), align="mean"),
        lambda: Signal("a", (0, 1), normalize="max"),
        lambda: Signal("a", (0, 1), outlier_zscore=0),
        lambda: Gain(""),
        lambda: ModelSpec((), dt=1),
        lambda: ModelSpec((Event("a", (0, 1)),), dt=0),
        lambda: ModelSpec((Event("a", (0, 1)), Event("a", (0, 1))), dt=1),
        lambda: ModelSpec((Event("a", (0, 1), gains="g"),), dt=1),
        lambda: ModelSpec((Event("a", (0, 1)),), (Gain("g"),), dt=1),
        lambda: ModelSpec((Event("a", (0, 1)),), dt=1, fit_window=(0, 1)),
        lambda: ModelSpec((Event("a", (0, 1)),), dt=1, fit_events="a"),
        lambda: ModelSpec((Signal("a", (0, 1), orthogonalize_against="a"),), dt=1),
        lambda: ModelSpec((Signal("a", (0, 1), orthogonalize_against="z"),), dt=1),
        lambda: ModelSpec((Signal("a", (0, 1), orthogonalize_against="b"), Signal("b", (0, 1), orthogonalize_against="a")), dt=1),
        lambda: model(dropouts=(Dropout.gain("g"), Dropout.gain("g"))),
        lambda: model(dropouts=(Dropout.gain("h"),)),
        lambda: model(dropouts=(Dropout.group("z"),)),
        lambda: model(dropouts=(Dropout("nothing"),)),
        lambda: model(dropouts=(Dropout.predictors("a", refit="gains"),)),
        lambda: model(dropouts=(Dropout.terms("mixed", predictors="b", gains="g", permutation_test=True),)),
        lambda: FitConfig(alphas=(0.0,)),
        lambda: FitConfig(inner_cv_folds=1),
        lambda: CVConfig(folds=1),
        lambda: CVConfig(split="rows"),
    ],
)
def test_wrong_declarations_raise(make):
    with pytest.raises(ValueError):
        make()


def test_all_broken_rules_are_told():
    with pytest.raises(ValueError, match="align.*normalize"):
        Signal("a", (0, 1), align="mean", normalize="max")
    with pytest.raises(ValueError, match="'z'.*'h'"):
        Dropout.terms("d", predictors=("z",), gains=("h",)).resolve_for(model())


def test_gain_terms_are_pairs_of_names():
    for bad in ("ga", (1, "a")):
        with pytest.raises(TypeError):
            Dropout("d", remove_gain_terms=(bad,))
    with pytest.raises(ValueError):
        Dropout("d", remove_gain_terms=(("g", "a", "b"),))


def test_terms_are_kernels_and_gains_in_order():
    assert [tuple(t) for t in model().terms] == [(None, "a"), ("g", "a"), (None, "b")]
    done = Dropout.terms("d", gains=("g",), gain_terms=(("g", "a"),)).resolve_for(model())
    assert (done.gains, done.gain_terms, done.refit) == (("g",), (("g", "a"),), "gains")


def test_orthogonal_to_an_event_is_a_type_error():
    with pytest.raises(TypeError):
        ModelSpec((Event("a", (0, 1)), Signal("b", (0, 1), orthogonalize_against="a")), dt=1)


def test_dropouts_resolve_in_model_order():
    done = Dropout.terms("d", groups=("x",)).resolve_for(model())
    assert (done.predictors, done.refit) == (("a", "b"), "full")
    assert Dropout.gain_terms("g", "a").resolve_for(model()).refit == "gains"
    assert Dropout.gain_terms("g", "a").name == "g:a"


def test_algebra_keeps_the_rest():
    spec = model(dropouts=(Dropout.gain("g"),))
    assert spec.without("b").predictor_names == ("a",)
    assert spec.without("b").dropouts == spec.dropouts
    assert spec.add(History()).predictor_names == ("a", "b", "history")
    assert spec.replace("a", n_basis=3).predictor("a").n_basis == 3
    assert spec.group_members("x") == ("a", "b")
    assert spec.group_names == ("x", "y")
    with pytest.raises(KeyError):
        spec.without_group("z")
    with pytest.raises(ValueError):
        spec.without("a")  # its gain would be idle


def test_layout_has_offsets_first():
    spec = ModelSpec((Event("a", (0, 1), gains=("g", "h")), Event("b", (0, 1)), Event("c", (0, 1), gains="g")), (Gain("g"), Gain("h")), dt=1)
    layout = ParameterLayout.of(spec, {"a": 2, "b": 3, "c": 1})
    assert layout.beta_slices["b"] == slice(2, 5)
    assert layout.gain_offsets == {"a": 0, "c": 1}
    assert layout.gain_coefficients == {("g", "a"): 2, ("h", "a"): 3, ("g", "c"): 4}


def test_library_sizes():
    def sizes(spec):
        n = {p.name: p.n_basis for p in spec.predictors}
        layout = ParameterLayout.of(spec, n)
        return layout.beta_size, layout.gain_size, len(spec.dropouts)

    assert {name: sizes(m) for name, m in MODELS.items()} == {
        "default": (70, 20, 13), "no_face": (54, 20, 13), "no_hit_long_stim": (74, 12, 2), "all_response": (97, 26, 13), "only_baseline": (62, 0, 1),
    }
    assert all(d.permutation_test for d in DEFAULT.dropouts)
    assert not NO_FACE.group_members("face")
    assert ALL_RESPONSE.predictor("is_miss").window == (0.1, 1)


def test_window_bounds_in_binary_arithmetic():
    assert window_bounds((0, 0), 0.1) == (0, 1)
    assert window_bounds((-0.2, 0.2), 0.1) == (-2, 2)
    assert window_bounds((0.3, 0.5), 0.1)[0] == 2  # 0.3 / 0.1 is just below 3
    assert lags_of((0, 0.1), 0.025).tolist() == [0, 1, 2, 3]


def test_bases():
    b = linear_cosine_basis(3, 9)
    assert b.shape == (9, 3)
    assert np.allclose(b[[0, 4, 8], [0, 1, 2]], 1)
    assert np.allclose(b[4, 0], 0.5)
    assert np.allclose(log_cosine_basis(2, 5)[[0, -1], [0, 1]], 1)
    assert (make_basis("cosine", 1, 4) == 1).all()
    for bad in (("cosine", 2, 1), ("identity", 2, 3), ("spline", 2, 3)):
        with pytest.raises(ValueError):
            make_basis(*bad)
