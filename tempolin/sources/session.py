"""Recorded sessions as tables, and the inputs of models made of them.

A store is a folder with one Parquet table for each group of a recording:
``intervals/trials``, ``processing/behavior/licks`` and so on, ``units``.  Each has a
``session`` column (or belongs to one session), so any number of sessions are read at
once and every step is one plan over all of them.  Only tables and columns that the
models need are read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempolin.operators.design import CompiledDesign, SessionTables, compile_design
from tempolin.operators.grid import (
    aligned_rows, context_code, included_events, stimulus_grid, time_fraction, trial_ends, trial_events, trial_gather, trial_windows_mask,
)
from tempolin.operators.relational import context_blocks
from tempolin.operators.scratch import settle
from tempolin.plans.library import FIT_WINDOW, OUTCOMES, STIMULI
from tempolin.plans.spec import Event, ModelSpec, Signal

# Names of tables and columns of a recording.
TRIALS, UNITS = "intervals/trials", "units"
POINT_TABLES = {"licks": "processing/behavior/licks", "rewards": "processing/behavior/rewards"}
RUNNING, EYE, POSE, FRAMES = "processing/behavior/running_speed", "processing/behavior/eye_tracking", "processing/behavior/lp_side_camera", "acquisition/frametimes_side_camera"
FACE_FEATURES = {"ear": "ear_base_l", "jaw": "jaw", "nose": "nose_tip", "whisker_pad": "whisker_pad_l_side"}
INSTRUCTION, QC_COLUMN = "is_instruction", "default_qc"
LIKELIHOOD_MIN, JITTER_SD = 0.98, 3.0


@dataclass(frozen=True)
class TableStore:
    """A folder of Parquet tables; ``session`` names the one that tables without that column belong to."""

    spark: SparkSession
    path: str
    session: str | None = None

    def read(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.path}/{name}")
        if "session" in table.columns:
            return table
        if self.session is None:
            raise KeyError(f"table {name!r} has no session column, and the store names no session")
        return table.withColumn("session", F.lit(self.session))


@dataclass(frozen=True)
class MemoryStore:
    """The same from DataFrames by name."""

    tables: dict[str, DataFrame]

    def read(self, name: str) -> DataFrame:
        return self.tables[name]


@dataclass(frozen=True)
class LoadedSessions:
    """Model inputs on grids that are aligned to stimuli, and the trial bounds in absolute seconds."""

    store: TableStore | MemoryStore
    tables: SessionTables
    trials: DataFrame

    @property
    def dt(self) -> float:
        return self.tables.dt


def required_sources(models: Iterable[ModelSpec]) -> tuple[set[str], set[str], set[str]]:
    """Event, signal and trial-value sources that the models read, all together."""
    models = list(models)
    terms = [p for m in models for p in m.predictors]
    events = {p.source for p in terms if isinstance(p, Event)}.union(*(m.fit_events for m in models))
    return events, {p.source for p in terms if isinstance(p, Signal)}, {g.source for m in models for g in m.gains}


def check_sources(events: set[str], signals: set[str], values: set[str]) -> None:
    """Raise before anything is read if a source is not one that recordings have."""
    supported = (
        ("events", events, {*STIMULI, *OUTCOMES, *POINT_TABLES}),
        ("signals", signals, {"running_speed", "pupil_area", "context_baseline", "time", *FACE_FEATURES}),
        ("trial values", values, {"trial_context"}),
    )
    unknown = {what: sorted(asked - there) for what, asked, there in supported if asked - there}
    if unknown:
        raise ValueError(f"recordings have no such sources: {unknown}")


def trial_table(store: TableStore | MemoryStore, use_instruction_trials: bool = False) -> DataFrame:
    """Trials in order of time, with bounds, stimulus, context, block and whether they are included.

    A trial lasts until the next one starts, the last one until its stop.
    """
    raw = store.read(TRIALS)
    if INSTRUCTION not in raw.columns:
        raise KeyError(f"the trial table has no column {INSTRUCTION!r}")
    from pyspark.sql import Window

    ordered = Window.partitionBy("session").orderBy("start_time")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = raw.withColumns(
        {
            "trial": (F.row_number().over(ordered) - 1).cast("long"), "start": F.col("start_time"), "stop": F.col("stop_time"), "stim": F.col("stim_start_time"),
            "task_start": F.first("start_time").over(whole), "task_end": F.last("stop_time").over(whole),
            "included": F.lit(True) if use_instruction_trials else ~F.coalesce(F.col(INSTRUCTION), F.lit(False)),
            "trial_context": context_code(F.col("is_vis_rewarded")),
        }
    )
    return context_blocks(trial_ends(named), "trial_context").withColumnRenamed("block", "cv_group")


def pose_signal(pose: DataFrame, frames: DataFrame, trials: DataFrame, source: str) -> DataFrame:
    """Distance of a feature from the origin on frames that are tracked well, as a signal.

    Frames meet their times by ordinal (``frame_ix`` in both).  Jitter is judged against
    the session's mean and deviation: an aggregate of one row a session.
    """
    x, y, likelihood, jitter = (f"{FACE_FEATURES[source]}_{s}" for s in ("x", "y", "likelihood", "temporal_norm"))
    known = F.when(~F.isnan(jitter), F.col(jitter))
    limits = pose.groupBy("session").agg((F.avg(known) + JITTER_SD * F.stddev_pop(known)).alias("_most"))
    kept = pose.join(limits, "session").where((F.col(likelihood) > LIKELIHOOD_MIN) & (F.col(jitter) <= F.col("_most")) & ~F.isnan(jitter))
    met = kept.join(frames.select("session", "frame_ix", "timestamps"), ["session", "frame_ix"])
    return met.select("session", F.lit(source).alias("source"), F.col("frame_ix").cast("long").alias("sample_ix"), "timestamps", F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y)).alias("value"))


def _ordinal(samples: DataFrame, source: str, value: str) -> DataFrame:
    from pyspark.sql import Window

    ordinal = F.row_number().over(Window.partitionBy("session").orderBy("timestamps")) - 1
    return samples.select("session", F.lit(source).alias("source"), ordinal.cast("long").alias("sample_ix"), "timestamps", F.col(value).cast("double").alias("value"))


def load_sessions(store: TableStore | MemoryStore, model: ModelSpec, *more: ModelSpec, use_instruction_trials: bool = False) -> LoadedSessions:
    """Everything that the models need, once for all of them."""
    models = (model, *more)
    if any(abs(m.dt - model.dt) > 1e-8 + 1e-5 * model.dt for m in more):
        raise ValueError("models that are loaded together have one dt")
    event_sources, signal_sources, value_sources = required_sources(models)
    check_sources(event_sources, signal_sources, value_sources)
    trials = settle(trial_table(store, use_instruction_trials))
    origin = trials.select("session", "task_start").distinct()
    absolute = stimulus_grid(trials, model.dt)
    since = lambda c: (F.col(c) - F.col("task_start")).alias(c)
    grid = settle(absolute.join(origin, "session").select(
        "session", "row_id", "trial", since("bin_start"), since("next_start"), F.col("bin_start").alias("absolute"), F.col("next_start").alias("absolute_next")
    ))

    relative = trials.withColumn("start", F.col("start") - F.col("task_start"))
    events = [trial_events(trials.where("included"), s).withColumn("source", F.lit(s)) for s in sorted(event_sources.intersection((*STIMULI, *OUTCOMES)))]
    for source in sorted(event_sources.intersection(POINT_TABLES)):
        times = store.read(POINT_TABLES[source]).select("session", "timestamps").join(origin, "session")
        times = times.select("session", (F.col("timestamps") - F.col("task_start")).alias("time"))
        events.append(included_events(times, relative).withColumn("source", F.lit(source)))

    sampled: list[DataFrame] = []
    if "running_speed" in signal_sources:
        sampled.append(_ordinal(store.read(RUNNING).select("session", "timestamps", "data"), "running_speed", "data"))
    if "pupil_area" in signal_sources:
        eye = store.read(EYE).where(~F.col("pupil_is_bad_frame")).select("session", "timestamps", "pupil_area")
        sampled.append(_ordinal(eye, "pupil_area", "pupil_area"))
    faces = [s for s in FACE_FEATURES if s in signal_sources]
    if faces:
        columns = [f"{FACE_FEATURES[s]}_{x}" for s in faces for x in ("x", "y", "likelihood", "temporal_norm")]
        pose, frames = store.read(POSE).select("session", "frame_ix", *columns), store.read(FRAMES)
        sampled += [pose_signal(pose, frames, trials, s) for s in faces]
    signals = [s.join(origin, "session").select("session", "source", "sample_ix", (F.col("timestamps") - F.col("task_start")).alias("time"), "value") for s in sampled]
    on_grid = lambda rows, source, value: rows.select("session", F.lit(source).alias("source"), F.col("row_id").alias("sample_ix"), F.lit(None).cast("double").alias("time"), value.cast("double").alias("value"))
    if "context_baseline" in signal_sources:
        signals.append(on_grid(trial_gather(grid, trials, ["trial_context"]), "context_baseline", F.col("trial_context")))
    if "time" in signal_sources:
        bounds = trials.select("session", "task_start", "task_end").distinct()
        signals.append(on_grid(grid.join(bounds, "session"), "time", time_fraction(F.col("absolute"), model.dt, F.col("task_start"), F.col("task_end"))))
    union = lambda parts: reduce(DataFrame.unionByName, parts) if parts else None
    values = trials.select("session", "trial", "trial_context", "cv_group", "included")
    return LoadedSessions(store, SessionTables(model.dt, grid, union(events), union(signals), values, regular=False), trials)


def stimulus_mask(loaded: LoadedSessions, window: tuple[float, float] = FIT_WINDOW) -> DataFrame:
    """(session, row_id) around any stimulus, inside its trial."""
    events = loaded.tables.events.where(F.col("source").isin(*STIMULI))
    return trial_windows_mask(events, loaded.tables.grid, loaded.dt, window)


def prepare(loaded: LoadedSessions, model: ModelSpec) -> CompiledDesign:
    """One design for all sessions: kernels and windows stay inside trials, excluded trials are not fitted."""
    included = loaded.tables.grid.join(loaded.tables.trials.where("included").select("session", "trial"), ["session", "trial"]).select("session", "row_id")
    return compile_design(model, loaded.tables, row_mask=included, segmented=True)


def qc_units(store: TableStore | MemoryStore, qc_column: str = QC_COLUMN, qc_filter: Column | str | None = None) -> DataFrame:
    """(session, unit_id) of units that are not noise and pass a flag, or a condition instead of it.

    The condition is a Column or SQL text; where it is null the unit is left out.  The
    units' place in their table (``unit_ix``) comes along if the table has it.
    """
    if qc_filter is None:
        condition = F.col(qc_column)
    elif isinstance(qc_filter, (str, Column)):
        condition = F.expr(qc_filter) if isinstance(qc_filter, str) else qc_filter
    else:
        raise TypeError("a QC filter is a Column or SQL text")
    units = store.read(UNITS)
    return units.where(condition & (F.col("decoder_label") != "noise")).select("session", "unit_id", *(c for c in ("unit_ix",) if c in units.columns))


def unit_targets(loaded: LoadedSessions, units: DataFrame) -> DataFrame:
    """(session, unit_id, row_id, y): spikes in each bin, for all units in one scan; bins without any are absent."""
    spikes = loaded.store.read(UNITS).select("session", "unit_id", "spike_times").join(units.select("session", "unit_id"), ["session", "unit_id"], "left_semi")
    times = spikes.select("session", "unit_id", F.explode("spike_times").alias("time"))
    grid = loaded.tables.grid.select("session", "row_id", "trial", F.col("absolute").alias("bin_start"), F.col("absolute_next").alias("next_start"))
    counted = aligned_rows(times, grid, loaded.dt).groupBy("session", "unit_id", "row_id").agg(F.count("*").cast("double").alias("y"))
    # a unit without spikes on the grid still is a target: one row of 0
    silent = units.join(counted.select("session", "unit_id").distinct(), ["session", "unit_id"], "left_anti")
    return counted.unionByName(silent.select("session", "unit_id", F.lit(0).cast("long").alias("row_id"), F.lit(0.0).alias("y")))


def catalog(paths: DataFrame, known: DataFrame) -> DataFrame:
    """(session, path): the part of the file name before its first dot, of known sessions only."""
    named = paths.select("path", F.split(F.element_at(F.split(F.regexp_replace("path", "/+$", ""), "/"), -1), r"\.").getItem(0).alias("session"))
    return named.join(known.select("session").distinct(), "session", "left_semi").select("session", "path")
