import importlib.util
import pathlib

PATH = pathlib.Path(__file__).parents[1] / "examples" / "synthetic.py"


def test_known_gains_are_recovered(spark):
    spec = importlib.util.spec_from_file_location("synthetic", PATH)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    gains = module.recover(spark)
    assert abs(gains["offset"] - module.OFFSET) < 0.1 and abs(gains["context"] - module.COEFFICIENT) < 0.1
