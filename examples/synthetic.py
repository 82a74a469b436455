"""Recover known gains: 40 trials of 30 bins, an event kernel scaled by a context, and a running signal."""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

import numpy as np
from pyspark.sql import SparkSession

from tempolin.operators.design import SessionTables, compile_design
from tempolin.operators.fit import evaluate_units, fit_units, gain_table
from tempolin.plans.spec import CVConfig, Dropout, Event, FitConfig, Gain, ModelSpec, Signal

N_TRIALS, BINS, DT = 40, 30, 0.02
OFFSET, COEFFICIENT = 1.5, 0.8


def recover(spark: SparkSession) -> dict[str, float]:
    """The cue's offset and context coefficient, as fitted."""
    rng = np.random.default_rng(0)
    trial = np.repeat(np.arange(N_TRIALS), BINS)
    context = np.where(np.arange(N_TRIALS) % 2, -1.0, 1.0)
    running = rng.normal(size=len(trial))
    cues = [float((t * BINS + 5) * DT + DT / 2) for t in range(N_TRIALS)]
    model = ModelSpec(
        (Event("cue", (0, 0.2), 4, gains="context"), Signal("running", (0, 0), 1)), (Gain("context"),), "synthetic", dt=DT, dropouts=(Dropout.gain("context"), Dropout.predictors("running"))
    )
    tables = SessionTables(
        DT,
        spark.createDataFrame([("s", i, int(t)) for i, t in enumerate(trial)], "session string, row_id long, trial long"),
        spark.createDataFrame([("s", "cue", t) for t in cues], "session string, source string, time double"),
        spark.createDataFrame([("s", "running", i, None, float(v)) for i, v in enumerate(running)], "session string, source string, sample_ix long, time double, value double"),
        spark.createDataFrame([("s", t, float(context[t])) for t in range(N_TRIALS)], "session string, trial long, context double"),
    )
    compiled = compile_design(model, tables)
    x = np.array([r.x for r in compiled.rows.orderBy("row_id").collect()])
    kernel = np.array([1.0, 0.6, 0.2, 0.0])
    drive = x[:, :4] @ (kernel / np.linalg.norm(compiled.design.bases["cue"] @ kernel))
    y = 0.2 + (OFFSET + COEFFICIENT * context[trial]) * drive + 0.5 * x[:, 4] + rng.normal(0, 0.05, len(trial))
    targets = spark.createDataFrame([("s", "u", i, float(v)) for i, v in enumerate(y)], "session string, unit_id string, row_id long, y double")
    fits = fit_units(compiled, targets, FitConfig(kernel_alpha=1e-3, gain_alpha=1e-3))
    found = {r.term: r.value for r in gain_table(compiled, fits).collect()}
    evaluate_units(compiled, targets, FitConfig(kernel_alpha=1e-3, gain_alpha=1e-3), CVConfig()).select("train_r2", "cv_r2", "cv_r2_pooled", "n_iter").show()
    return found


if __name__ == "__main__":
    session = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    gains = recover(session)
    print(gains)
    assert abs(gains["offset"] - OFFSET) < 0.1 and abs(gains["context"] - COEFFICIENT) < 0.1
