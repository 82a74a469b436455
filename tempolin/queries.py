"""Queries over the driver's tables, one or more for each operator.

``events`` stands for recordings: a session is 30 users, so sessions grow with the table; a
unit is ``user_id % 4``, a trial a day, a bin an hour of the days that a session's events
span, event sources are the event types, the signal is ``value``, and the target counts
a unit's purchases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempolin.operators import conditioning, design, fit, grid, relational, scratch
from tempolin.plans import library
from tempolin.plans.spec import CVConfig, Dropout, Event, FitConfig, Gain, History, ModelSpec, Signal
from tempolin.sources import session as sources
from tempolin.sources import sinks

DT, DAY, N_TIME = 3600.0, 86400.0, 720
DIGITS = 8


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, unit_id, source, sample_ix, time, value), time in seconds since the first of January."""
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 1e6
    return _read(spark, sf_dir, "events").select(
        F.expr("user_id div 30").alias("session"), (F.col("user_id") % 4).alias("unit_id"), F.col("event_type").alias("source"), F.col("event_id").alias("sample_ix"), seconds.alias("time"), "value"
    )


def _sessions(spark: SparkSession, sf_dir: str, extra: float = 1800.0) -> DataFrame:
    """Each session's whole days from the first of January to its last event, and a bit."""
    days = events(spark, sf_dir).groupBy("session").agg((F.floor(F.max("time") / DAY) + 1).alias("days"))
    return days.select("session", F.lit(0.0).alias("start"), (F.col("days") * DAY + extra).alias("end"), "days")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = grid.time_bins(_sessions(spark, sf_dir), DT)
    return bins.withColumn("trial", F.expr("row_id div 24"))


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days: bounds, context (+1 and -1 in blocks of five days), group, and whether they are included."""
    days = _sessions(spark, sf_dir).select("session", F.explode(F.sequence(F.lit(0).cast("long"), F.col("days") - 1)).alias("trial"))
    block = F.expr("trial div 5")
    return days.select(
        "session", "trial", (F.col("trial") * DAY).alias("start"), ((F.col("trial") + 1) * DAY).alias("stop"), (1.0 - 2.0 * (block % 2)).alias("context"),
        (0.25 * ((F.col("trial") * 7) % 11)).alias("load"), block.alias("cv_group"), (F.col("trial") % 7 != 3).alias("included"),
    )


def _stimulus_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with a stimulus: the first purchase that leaves room, or noon."""
    chosen = events(spark, sf_dir).where("source = 'purchase'").withColumn("trial", F.floor(F.col("time") / DAY))
    chosen = chosen.where("time < trial * 86400.0 + 80000.0").groupBy("session", "trial").agg(F.min("time").alias("stim"))
    return _trials(spark, sf_dir).join(chosen, ["session", "trial"], "left").withColumn("stim", F.coalesce("stim", F.col("start") + 43200.0))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, DIGITS) for n in names})


# --- grids and bins ---------------------------------------------------------------


def time_bins(spark, sf_dir):
    return grid.time_bins(_sessions(spark, sf_dir), DT)


def event_histogram(spark, sf_dir):
    rows = grid.regular_rows(events(spark, sf_dir), DT, N_TIME)
    return grid.bin_counts(rows.select("session", "source", "row_id"), _grid(spark, sf_dir), "source", value="n")


def smoothed_rate(spark, sf_dir):
    chosen = events(spark, sf_dir).where("source = 'click'")
    out = grid.bin_times(chosen.select("session", "time"), _sessions(spark, sf_dir), DT, smooth_sigma=2 * DT, output="rate")
    return out.select("session", "row_id", F.round(F.col("value") * DT, DIGITS).alias("per_bin"))


def trial_index(spark, sf_dir):
    return grid.checked_trial_index(_trials(spark, sf_dir).withColumnRenamed("stop", "end"), DT)


def trial_index_faults(spark, sf_dir):
    uneven = _trials(spark, sf_dir).select("session", "trial", (F.col("start") + 4000.0 * (F.col("trial") % 3)).alias("start"), (F.col("stop") + 5000.0 * (F.col("trial") % 2)).alias("end"))
    faults = grid.trial_index_faults(grid.trial_index(uneven, DT), uneven, DT)
    return faults.select("session", "row_id", F.col("n_trials").cast("long").alias("n_trials"))


def window_mask(spark, sf_dir):
    chosen = events(spark, sf_dir).where("source = 'purchase' and value > 100")
    return grid.windows_mask(chosen, _grid(spark, sf_dir), DT, (-1.5 * DT, 2.0 * DT))


def stimulus_grid(spark, sf_dir):
    trials = grid.trial_ends(_stimulus_trials(spark, sf_dir))
    return _rounded(grid.stimulus_grid(trials, DT), "bin_start").drop("next_start")


def _aligned(spark, sf_dir):
    return grid.stimulus_grid(grid.trial_ends(_stimulus_trials(spark, sf_dir)), DT)


def asof_rows(spark, sf_dir):
    met = grid.aligned_rows(events(spark, sf_dir).select("session", "sample_ix", "time"), _aligned(spark, sf_dir), DT)
    return met.select("session", "sample_ix", "row_id", "trial")


def trial_window_mask(spark, sf_dir):
    chosen = events(spark, sf_dir).where("source = 'signup' and value > 60").select("session", "time")
    return grid.trial_windows_mask(chosen, _aligned(spark, sf_dir), DT, (-3 * DT, 4 * DT))


def trial_ends(spark, sf_dir):
    late = _trials(spark, sf_dir).withColumn("start", F.col("start") + 60.0 * (F.col("trial") % 4))
    return grid.trial_ends(late).select("session", "trial", "end")


def trial_events(spark, sf_dir):
    flagged = _stimulus_trials(spark, sf_dir).withColumn("hit", F.when(F.col("trial") % 3 == 0, True).when(F.col("trial") % 3 == 1, False)).withColumn("task_start", F.lit(120.0))
    return _rounded(grid.trial_events(flagged, "hit"), "time")


def included_events(spark, sf_dir):
    late = _trials(spark, sf_dir).withColumn("start", F.col("start") + 7200.0)
    kept = grid.included_events(events(spark, sf_dir).select("session", "sample_ix", "time"), late)
    return kept.select("session", "sample_ix")


def context_block_index(spark, sf_dir):
    return relational.context_blocks(_trials(spark, sf_dir), "context").select("session", "trial", F.col("block").cast("long").alias("block"))


def trial_gather(spark, sf_dir):
    frame = grid.trial_gather(_grid(spark, sf_dir), _trials(spark, sf_dir), ["context", "load"])
    fraction = grid.time_fraction(F.col("bin_start"), DT, F.lit(0.0), F.lit(N_TIME * DT))
    return frame.select("session", "row_id", "context", "load", F.round(fraction, DIGITS).alias("fraction"), grid.context_code(F.col("load") > 1).alias("code"))


# --- signals ------------------------------------------------------------------------


def outlier_mask(spark, sf_dir):
    marked = conditioning.mark_outliers(events(spark, sf_dir), 3.0)
    return marked.select("session", "source", "sample_ix", F.col("value").isNull().alias("outlier"))


def _hourly(spark, sf_dir):
    """Mean value of each hour, null in hours without events: a signal on the grid."""
    rows = grid.regular_rows(events(spark, sf_dir).where("source <> 'error'"), DT, N_TIME)
    means = rows.groupBy("session", "source", "row_id").agg(F.avg("value").alias("value"))
    frame = _grid(spark, sf_dir).select("session", "row_id").crossJoin(F.broadcast(events(spark, sf_dir).where("source <> 'error'").select("source").distinct()))
    return frame.join(means, ["session", "source", "row_id"], "left").withColumnRenamed("row_id", "sample_ix")


def gap_fill(spark, sf_dir):
    return _rounded(conditioning.fill_gaps(_hourly(spark, sf_dir)), "value").select("session", "source", "sample_ix", "value")


def interpolated_signal(spark, sf_dir):
    chosen = events(spark, sf_dir).where("source in ('click', 'view')").select("session", "source", "sample_ix", "time", "value")
    return _rounded(conditioning.interpolate(chosen, _grid(spark, sf_dir), DT), "value")


def binned_signal(spark, sf_dir):
    chosen = events(spark, sf_dir).select("session", "source", "sample_ix", "time", "value")
    return _rounded(conditioning.bin_mean(chosen, _grid(spark, sf_dir), DT), "value")


def binned_signal_aligned(spark, sf_dir):
    chosen = events(spark, sf_dir).where("source = 'view'").select("session", "source", "sample_ix", "time", "value")
    return _rounded(conditioning.bin_mean(chosen, _aligned(spark, sf_dir), DT, regular=False), "value")


def zscored_signal(spark, sf_dir):
    chosen = events(spark, sf_dir).select("session", "source", "sample_ix", "time", "value")
    return _rounded(conditioning.normalize(conditioning.bin_mean(chosen, _grid(spark, sf_dir), DT), "zscore"), "value")


def centered_signal(spark, sf_dir):
    chosen = events(spark, sf_dir).select("session", "source", "sample_ix", "time", "value")
    return _rounded(conditioning.normalize(conditioning.bin_mean(chosen, _grid(spark, sf_dir), DT), "center"), "value")


def residual_signal(spark, sf_dir):
    means = binned_signal_raw(spark, sf_dir)
    wide = means.groupBy("session", "row_id").agg(*[F.max(F.when(F.col("source") == s, F.col("value"))).alias(s) for s in ("click", "view")])
    fitted = wide.withColumn("fit", F.col("row_id") % 24 >= 6)
    return _rounded(conditioning.residualize(fitted, "click", "view"), "click").select("session", "row_id", "click")


def binned_signal_raw(spark, sf_dir):
    chosen = events(spark, sf_dir).select("session", "source", "sample_ix", "time", "value")
    return conditioning.bin_mean(chosen, _grid(spark, sf_dir), DT)


def pose_signal(spark, sf_dir):
    """Line items stand for frames: positions, likelihood and jitter of one feature."""
    lines = _read(spark, sf_dir, "lineitem")
    pose = lines.select(
        F.expr("l_suppkey div 20").alias("session"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("frame_ix"), F.col("l_quantity").alias("ear_base_l_x"),
        F.col("l_extendedprice").alias("ear_base_l_y"), (1.0 - F.col("l_discount") / 4).alias("ear_base_l_likelihood"), F.col("l_tax").alias("ear_base_l_temporal_norm"),
    )
    frames = pose.select("session", "frame_ix", (F.col("frame_ix") * 0.01).alias("timestamps"))
    kept = sources.pose_signal(pose.distinct(), frames.distinct(), None, "ear")
    return kept.groupBy("session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.max("sample_ix").alias("last"))


# --- designs and moments --------------------------------------------------------------


def _tables(spark, sf_dir):
    ev = events(spark, sf_dir)
    samples = ev.where("source in ('click', 'view')").select("session", "source", "sample_ix", "time", "value")
    return design.SessionTables(DT, _grid(spark, sf_dir), ev.select("session", "source", "time"), samples, _trials(spark, sf_dir))


def _spec(**more):
    return ModelSpec(
        (Event("purchase", (0, 3 * DT), 2, gains=("context",)), Signal("click", (-DT, 2 * DT), 1, align="bin", normalize="zscore", outlier_zscore=None)), (Gain("context"),), dt=DT, **more
    )


def _plain_spec(**more):
    """Two one-column predictors, the second constant in each trial."""
    return ModelSpec((Event("signup", (0, 2 * DT), 1), Signal("click", (0, 0), 1, align="bin", outlier_zscore=None)), dt=DT, **more)


def _targets(spark, sf_dir):
    rows = grid.regular_rows(events(spark, sf_dir).where("source = 'purchase'"), DT, N_TIME)
    return rows.groupBy("session", "unit_id", "row_id").agg(F.count("*").cast("double").alias("y"))


def lagged_design(spark, sf_dir):
    rows = design.compile_design(_spec(fit_window=(-6 * DT, 6 * DT), fit_events=("error",)), _tables(spark, sf_dir)).rows
    return rows.select("session", "row_id", "fit", *[F.round(F.get("x", F.lit(k)), DIGITS).alias(f"x{k}") for k in range(3)])


def segmented_design(spark, sf_dir):
    rows = design.compile_design(_spec(), _tables(spark, sf_dir), segmented=True).rows
    return rows.select("session", "row_id", *[F.round(F.get("x", F.lit(k)), DIGITS).alias(f"x{k}") for k in range(3)])


def wide_design(spark, sf_dir):
    """Eighteen columns: too many for window functions, so stretches of rows are convolved on arrays."""
    spec = ModelSpec((Event("purchase", (0, 12 * DT), 9), Signal("click", (-6 * DT, 6 * DT), 9, align="bin", normalize="zscore", outlier_zscore=None)), dt=DT)
    rows = design.compile_design(spec, _tables(spark, sf_dir)).rows
    return rows.select("session", "row_id", *[F.round(F.get("x", F.lit(k)), DIGITS).alias(f"x{k}") for k in range(18)])


def trial_moments(spark, sf_dir):
    compiled = design.compile_design(_plain_spec(), _tables(spark, sf_dir))
    m = design.moments_sql(compiled.rows, _targets(spark, sf_dir), 2)
    return _unpacked(m, "sx", "sxx", "sy", "sxy", "syy")


def trial_moments_arrow(spark, sf_dir):
    """The same sums by the path for many columns."""
    compiled = design.compile_design(_plain_spec(), _tables(spark, sf_dir))
    targets = _targets(spark, sf_dir)
    shared = design.design_moments(compiled.rows).select("session", "trial", "n", F.slice("sums", 1, 2).alias("sx"), F.slice("sums", 3, 3).alias("sxx"))
    # count, means of x0, x1 and y, and co-moments of y with each of them
    packed = design.target_moments(compiled.rows, design.own_rows(compiled, targets), design.CoMoments(2))
    n, x0, x1, y, c0, c1, cy = (F.get("sums", F.lit(k)) for k in range(7))
    own = packed.select("session", "unit_id", "trial", F.round(n * y, DIGITS).alias("sy"), F.round(cy + n * y * y, DIGITS).alias("syy"), F.array(c0 + n * x0 * y, c1 + n * x1 * y).alias("sxy"))
    units = targets.select("session", "unit_id").distinct()
    zero = F.array(F.lit(0.0), F.lit(0.0))
    met = shared.join(units, "session").join(own, ["session", "unit_id", "trial"], "left")
    return _unpacked(met.withColumns({"sy": F.coalesce("sy", F.lit(0.0)), "syy": F.coalesce("syy", F.lit(0.0)), "sxy": F.coalesce("sxy", zero)}), "sx", "sxx", "sy", "sxy", "syy")


def _unpacked(m, *names):
    at = lambda c, k: F.round(F.get(c, F.lit(k)), 7)
    return m.select(
        "session", "unit_id", "trial", "n", at("sx", 0).alias("sx0"), at("sx", 1).alias("sx1"), at("sxx", 0).alias("sx00"), at("sxx", 1).alias("sx01"), at("sxx", 2).alias("sx11"),
        "sy", at("sxy", 0).alias("sxy0"), at("sxy", 1).alias("sxy1"), "syy",
    )


def group_moments(spark, sf_dir):
    """Trial moments added up by trial group."""
    m = trial_moments(spark, sf_dir).join(_trials(spark, sf_dir).select("session", "trial", "cv_group"), ["session", "trial"])
    return m.groupBy("session", "unit_id", "cv_group").agg(F.sum("n").alias("n"), F.round(F.sum("sx01"), 5).alias("sx01"), F.sum("sy").alias("sy"), F.round(F.sum("sxy1"), 5).alias("sxy1"))


def history_gap(spark, sf_dir):
    held = _grid(spark, sf_dir).withColumn("side", F.col("trial") % 5 == 2)
    return relational.with_history_gap(held, "side", 3).select("session", "row_id", "safe")


# --- fits -------------------------------------------------------------------------------

_FIXED = FitConfig(kernel_alpha=2.0, gain_alpha=0.5, tol=0.0, max_iter=8)


def kernel_ridge(spark, sf_dir):
    compiled = design.compile_design(_plain_spec(), _tables(spark, sf_dir))
    out = fit.fit_units(compiled, _targets(spark, sf_dir), FitConfig(kernel_alpha=2.0))
    return _rounded(out.select("session", "unit_id", "intercept", F.get("beta", F.lit(0)).alias("beta0"), F.get("beta", F.lit(1)).alias("beta1"), "train_r2"), "intercept", "beta0", "beta1", "train_r2")


def _gain_spec():
    return ModelSpec((Event("signup", (0, 2 * DT), 1, gains=("context",)), Signal("click", (0, 0), 1, align="bin", outlier_zscore=None)), (Gain("context"),), dt=DT)


def alternating_fit(spark, sf_dir):
    compiled = design.compile_design(_gain_spec(), _tables(spark, sf_dir))
    out = fit.fit_units(compiled, _targets(spark, sf_dir), _FIXED)
    at = lambda c, k: F.get(c, F.lit(k))
    return _rounded(
        out.select("session", "unit_id", "intercept", at("beta", 0).alias("beta0"), at("beta", 1).alias("beta1"), at("gain", 0).alias("offset"), at("gain", 1).alias("coefficient"), "train_r2"),
        "intercept", "beta0", "beta1", "offset", "coefficient", "train_r2",
    )


def predictions(spark, sf_dir):
    compiled = design.compile_design(_plain_spec(), _tables(spark, sf_dir))
    fits = fit.fit_units(compiled, _targets(spark, sf_dir), FitConfig(kernel_alpha=2.0))
    return fit.predict(compiled, fits).select("session", "unit_id", "row_id", F.round("prediction", DIGITS).alias("prediction"))


def row_scores(spark, sf_dir):
    """R2 from the rows themselves; the moments give the same as ``train_r2`` of kernel_ridge."""
    compiled = design.compile_design(_plain_spec(), _tables(spark, sf_dir))
    targets = _targets(spark, sf_dir)
    fits = fit.fit_units(compiled, targets, FitConfig(kernel_alpha=2.0))
    return _rounded(fit.score_rows(fit.predict(compiled, fits), targets), "sse", "tss", "r2")


def kernel_table(spark, sf_dir):
    compiled = design.compile_design(_plain_spec(), _tables(spark, sf_dir))
    return _rounded(fit.kernels(compiled, fit.fit_units(compiled, _targets(spark, sf_dir), FitConfig(kernel_alpha=2.0))), "weight")


def gain_values(spark, sf_dir):
    compiled = design.compile_design(_gain_spec(), _tables(spark, sf_dir))
    return _rounded(fit.gain_table(compiled, fit.fit_units(compiled, _targets(spark, sf_dir), _FIXED)), "value")


def _number(path):
    return F.round(F.get_json_object("summary", path).cast("double"), DIGITS)


def cross_validation(spark, sf_dir):
    """Held-out groups, pooled score and a reduced model without the signal."""
    compiled = design.compile_design(_plain_spec(), _tables(spark, sf_dir))
    out = fit.evaluate_units(compiled, _targets(spark, sf_dir), FitConfig(kernel_alpha=2.0), CVConfig(), [Dropout.predictors("click")])
    dropped = "$.dropouts.click"
    return out.select(
        "session", "unit_id", F.round("cv_r2", DIGITS).alias("cv_r2"), F.round("cv_r2_pooled", DIGITS).alias("cv_r2_pooled"), _number(f"{dropped}.delta_r2").alias("delta_r2"),
        _number(f"{dropped}.delta_r2_pooled").alias("delta_r2_pooled"),
    )


def shift_test(spark, sf_dir):
    """Shift test of the context gain: p value, and the pooled gain in score without a shift."""
    compiled = design.compile_design(_gain_spec(), _tables(spark, sf_dir))
    fixed = FitConfig(kernel_alpha=2.0, gain_alpha=0.5, max_iter=8)
    out = fit.evaluate_units(compiled, _targets(spark, sf_dir), fixed, CVConfig(), [Dropout.gain("context", permutation_test=True)])
    test = "$.dropouts.context.permutation"
    return out.select("session", "unit_id", _number(f"{test}.p_value").alias("p_value"), _number(f"{test}.observed_delta_r2_pooled").alias("observed"), _number(f"{test}.n_unique_shifts").alias("n_shifts"))


def baseline_shift_test(spark, sf_dir):
    """Shift test of a predictor that is constant within trials: the context itself."""
    tables = _tables(spark, sf_dir)
    context = grid.trial_gather(tables.grid, tables.trials, ["context"])
    on_grid = context.select("session", F.lit("context").alias("source"), F.col("row_id").alias("sample_ix"), F.lit(None).cast("double").alias("time"), F.col("context").alias("value"))
    spec = ModelSpec((Event("signup", (0, 2 * DT), 1), Signal("context", (0, 0), 1, outlier_zscore=None)), dt=DT)
    compiled = design.compile_design(spec, design.SessionTables(DT, tables.grid, tables.events, on_grid, tables.trials))
    out = fit.evaluate_units(compiled, _targets(spark, sf_dir), FitConfig(kernel_alpha=2.0), CVConfig(), [Dropout.predictors("context", permutation_test=True)])
    test = "$.dropouts.context.permutation"
    return out.select("session", "unit_id", _number(f"{test}.p_value").alias("p_value"), _number(f"{test}.observed_delta_r2_pooled").alias("observed"), _number(f"{test}.reduced_r2_pooled").alias("reduced"))


def selected_penalties(spark, sf_dir):
    """Penalties chosen by inner cross-validation over trials, ridge and lasso."""
    compiled = design.compile_design(_gain_spec(), _tables(spark, sf_dir))
    targets = _targets(spark, sf_dir)
    ridge = fit.fit_units(compiled, targets, FitConfig()).withColumn("regularizer", F.lit("ridge"))
    lasso = fit.fit_units(compiled, targets, FitConfig(regularizer="lasso", alphas=(1e-3, 1e-2, 1e-1))).withColumn("regularizer", F.lit("lasso"))
    return _rounded(ridge.unionByName(lasso).select("regularizer", "session", "unit_id", "train_r2", "n_iter", "converged"), "train_r2")


def masked_fit(spark, sf_dir):
    """A fit on rows that a mask of the caller selects instead of the design's own."""
    compiled = design.compile_design(_plain_spec(fit_window=(-6 * DT, 6 * DT), fit_events=("error",)), _tables(spark, sf_dir))
    mask = _grid(spark, sf_dir).where("row_id % 3 <> 1")
    out = fit.fit_units(compiled, _targets(spark, sf_dir), FitConfig(kernel_alpha=2.0), mask=mask)
    return _rounded(out.select("session", "unit_id", "intercept", F.get("beta", F.lit(0)).alias("beta0"), F.get("beta", F.lit(1)).alias("beta1"), "train_r2"), "intercept", "beta0", "beta1", "train_r2")


def refit_gains(spark, sf_dir):
    """Gains at another penalty, with the kernels of an alternating fit held."""
    compiled, targets = design.compile_design(_gain_spec(), _tables(spark, sf_dir)), _targets(spark, sf_dir)
    out = fit.refit_gains(compiled, targets, fit.fit_units(compiled, targets, _FIXED), FitConfig(kernel_alpha=1.0, gain_alpha=3.0))
    return _rounded(out.select("session", "unit_id", F.get("gain", F.lit(0)).alias("offset"), F.get("gain", F.lit(1)).alias("coefficient")), "offset", "coefficient")


def refit_kernels(spark, sf_dir):
    """Kernels at another penalty, with the gains of an alternating fit held."""
    compiled, targets = design.compile_design(_gain_spec(), _tables(spark, sf_dir)), _targets(spark, sf_dir)
    out = fit.refit_kernels(compiled, targets, fit.fit_units(compiled, targets, _FIXED), FitConfig(kernel_alpha=7.0, gain_alpha=1.0))
    return _rounded(out.select("session", "unit_id", "intercept", F.get("beta", F.lit(0)).alias("beta0"), F.get("beta", F.lit(1)).alias("beta1")), "intercept", "beta0", "beta1")


def penalty_errors(spark, sf_dir):
    """Errors of the inner folds by penalty, ridge and lasso, and the penalty that was chosen."""
    compiled, targets = design.compile_design(_plain_spec(), _tables(spark, sf_dir)), _targets(spark, sf_dir)
    grids = {"ridge": (1e-1, 1e1, 1e3), "lasso": (1e-3, 1e-2, 1e-1)}
    fits = [fit.fit_units(compiled, targets, FitConfig(regularizer=name, alphas=alphas)).withColumn("regularizer", F.lit(name)) for name, alphas in grids.items()]
    told = F.from_json(F.get_json_object("summary", "$.penalties.kernel"), "struct<alphas:array<double>,errors:array<double>,chosen:double>")
    out = fits[0].unionByName(fits[1]).select("regularizer", "session", "unit_id", told.alias("t"))
    each = out.select("regularizer", "session", "unit_id", "t.chosen", F.explode(F.arrays_zip("t.alphas", "t.errors")).alias("e"))
    return each.select("regularizer", "session", "unit_id", F.col("e.alphas").alias("alpha"), F.round("e.errors", DIGITS).alias("error"), (F.col("e.alphas") == F.col("chosen")).alias("chosen"))


def gains_dropout(spark, sf_dir):
    """Held-out score of a model without a gain, with the kernels of the full model held and the other gains solved again."""
    compiled = design.compile_design(_gain_spec(), _tables(spark, sf_dir))
    out = fit.evaluate_units(compiled, _targets(spark, sf_dir), _FIXED, CVConfig(), [Dropout.gain("context", refit="gains")])
    return out.select("session", "unit_id", F.round("cv_r2_pooled", DIGITS).alias("cv_r2_pooled"), _number("$.dropouts.context.delta_r2_pooled").alias("delta_r2_pooled"))


def history_predictions(spark, sf_dir):
    """Predictions of a model with the target's own past, for all rows."""
    spec = ModelSpec((History(window=(DT, 4 * DT), n_basis=1), Event("signup", (0, 2 * DT), 1)), dt=DT)
    compiled, targets = design.compile_design(spec, _tables(spark, sf_dir)), _targets(spark, sf_dir)
    made = fit.predict(compiled, fit.fit_units(compiled, targets, FitConfig(kernel_alpha=2.0)), targets)
    return made.select("session", "unit_id", "row_id", F.round("prediction", DIGITS).alias("prediction"))


def lasso_refit(spark, sf_dir):
    """Kernels solved again under an absolute penalty, with the gains of an alternating fit held."""
    compiled, targets = design.compile_design(_gain_spec(), _tables(spark, sf_dir)), _targets(spark, sf_dir)
    out = fit.refit_kernels(compiled, targets, fit.fit_units(compiled, targets, _FIXED), FitConfig(regularizer="lasso", kernel_alpha=0.01, gain_alpha=1.0))
    return _rounded(out.select("session", "unit_id", "intercept", F.get("beta", F.lit(0)).alias("beta0"), F.get("beta", F.lit(1)).alias("beta1")), "intercept", "beta0", "beta1")


def _history_gain_spec():
    """The target's own past, scaled by a gain, beside an event."""
    return ModelSpec((History(window=(DT, 4 * DT), n_basis=1, gains=("context",)), Event("signup", (0, 2 * DT), 1)), (Gain("context"),), dt=DT)


def history_refit_gains(spark, sf_dir):
    """Gains of the target's own past at another penalty, with the kernels of an alternating fit held."""
    compiled, targets = design.compile_design(_history_gain_spec(), _tables(spark, sf_dir)), _targets(spark, sf_dir)
    out = fit.refit_gains(compiled, targets, fit.fit_units(compiled, targets, _FIXED), FitConfig(kernel_alpha=1.0, gain_alpha=3.0))
    return _rounded(out.select("session", "unit_id", F.get("gain", F.lit(0)).alias("offset"), F.get("gain", F.lit(1)).alias("coefficient")), "offset", "coefficient")


def history_refit_kernels(spark, sf_dir):
    """Kernels, among them that of the target's own past, at another penalty, with the gains of an alternating fit held."""
    compiled, targets = design.compile_design(_history_gain_spec(), _tables(spark, sf_dir)), _targets(spark, sf_dir)
    out = fit.refit_kernels(compiled, targets, fit.fit_units(compiled, targets, _FIXED), FitConfig(kernel_alpha=7.0, gain_alpha=1.0))
    return _rounded(out.select("session", "unit_id", "intercept", F.get("beta", F.lit(0)).alias("beta0"), F.get("beta", F.lit(1)).alias("beta1")), "intercept", "beta0", "beta1")


def segmented_history(spark, sf_dir):
    """A model whose own past does not reach across trials."""
    spec = ModelSpec((History(window=(DT, 4 * DT), n_basis=1), Signal("click", (0, 0), 1, align="bin", outlier_zscore=None)), dt=DT)
    compiled = design.compile_design(spec, _tables(spark, sf_dir), segmented=True)
    out = fit.fit_units(compiled, _targets(spark, sf_dir), FitConfig(kernel_alpha=2.0))
    return _rounded(out.select("session", "unit_id", "intercept", F.get("beta", F.lit(0)).alias("beta0"), F.get("beta", F.lit(1)).alias("beta1"), "train_r2"), "intercept", "beta0", "beta1", "train_r2")


def offset_scores(spark, sf_dir):
    """Scores of targets whose mean is ten million times their spread: of moments, and of rows."""
    compiled = design.compile_design(_plain_spec(), _tables(spark, sf_dir))
    units = _targets(spark, sf_dir)
    # bins come of few sessions, whose size says nothing of theirs: they are never to be broadcast
    everywhere = _grid(spark, sf_dir).select("session", "row_id").hint("merge").join(units.select("session", "unit_id").distinct(), "session")
    lifted = everywhere.join(units, ["session", "unit_id", "row_id"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)) + 1e7)
    out = fit.evaluate_units(compiled, lifted, FitConfig(kernel_alpha=2.0), CVConfig(), [])
    return _rounded(out.select("session", "unit_id", F.get("beta", F.lit(0)).alias("beta0"), "train_r2", "cv_r2", "cv_r2_pooled"), "beta0", "train_r2", "cv_r2", "cv_r2_pooled")


def history_fit(spark, sf_dir):
    """A model with the target's own past, and a gap around held-out trials."""
    spec = ModelSpec((Event("signup", (0, 2 * DT), 1), History(window=(DT, 4 * DT), n_basis=1)), dt=DT)
    compiled = design.compile_design(spec, _tables(spark, sf_dir))
    out = fit.evaluate_units(compiled, _targets(spark, sf_dir), FitConfig(kernel_alpha=2.0), CVConfig(gap_history=True), [])
    return _rounded(out.select("session", "unit_id", "train_r2", "cv_r2", "cv_r2_pooled"), "train_r2", "cv_r2", "cv_r2_pooled")


# --- folds and shifts -------------------------------------------------------------------


def outer_folds(spark, sf_dir):
    groups = relational.grouped_folds(_trials(spark, sf_dir), "cv_group").select("session", "trial", F.col("fold").alias("by_group"))
    even = relational.even_folds(_trials(spark, sf_dir), 7).select("session", "trial", F.col("fold").alias("by_trial"))
    return groups.join(even, ["session", "trial"]).select("session", "trial", F.col("by_group").cast("long").alias("by_group"), F.col("by_trial").cast("long").alias("by_trial"))


def edge_shifts(spark, sf_dir):
    out = relational.edge_shifts(_trials(spark, sf_dir).where("trial >= 1 and trial < 28"), "context")
    return out.select("session", F.col("ordinal").cast("long").alias("ordinal"), F.col("shift").cast("long").alias("shift"), F.col("n_trials").cast("long").alias("n_trials"))


def shifted_values(spark, sf_dir):
    trials = _trials(spark, sf_dir).where("trial >= 1 and trial < 28")
    out = relational.shifted_values(trials, relational.edge_shifts(trials, "context"), "context")
    return out.select("session", "trial", F.col("shift").cast("long").alias("shift"), "shifted", "valid")


# --- units, sessions, comparisons ---------------------------------------------------------


def _units(spark, sf_dir):
    """Parts stand for units."""
    part = _read(spark, sf_dir, "part")
    return part.select(
        F.expr("p_partkey div 400").alias("session"), F.col("p_partkey").alias("unit_id"), (F.col("p_size") > 25).alias("default_qc"),
        F.when(F.col("p_partkey") % 11 == 0, "noise").when(F.col("p_partkey") % 13 != 0, "sua").alias("decoder_label"),
        F.when(F.col("p_partkey") % 17 != 0, F.col("p_size") / 50).alias("amplitude_cutoff"), (F.col("p_partkey") % 100 / 100).alias("presence_ratio"),
    )


def qc_column(spark, sf_dir):
    return sources.qc_units(sources.MemoryStore({"units": _units(spark, sf_dir)}))


def qc_filter(spark, sf_dir):
    return sources.qc_units(sources.MemoryStore({"units": _units(spark, sf_dir)}), qc_filter="amplitude_cutoff <= 0.5 AND presence_ratio >= 0.3")


def limited_units(spark, sf_dir):
    from tempolin.batch import _limited

    return _limited(qc_column(spark, sf_dir), 8)


def pending_sessions(spark, sf_dir):
    """Customers with certain orders are done; the others are pending."""
    asked = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"))
    return sinks.pending(asked, _read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("session")))


def session_catalog(spark, sf_dir):
    """Paths whose file name begins with a known id."""
    paths = _read(spark, sf_dir, "pages").select(F.concat(F.lit("s3://store/a.b/"), (F.col("page_id") % 97).cast("string"), F.lit(".nwb.zarr/")).alias("path"))
    known = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("session"))
    return sources.catalog(paths, known)


def unit_spikes(spark, sf_dir):
    """Spike times as a list a unit, binned on the aligned grid; a unit without spikes gets one row of 0."""
    ev = events(spark, sf_dir).where("source = 'purchase'")
    units = ev.groupBy("session", "unit_id").agg(F.sort_array(F.collect_list("time")).alias("spike_times"))
    silent = _sessions(spark, sf_dir).select("session", F.lit(99).cast("long").alias("unit_id"), F.array().cast("array<double>").alias("spike_times"))
    aligned = _aligned(spark, sf_dir).withColumn("absolute", F.col("bin_start")).withColumn("absolute_next", F.col("next_start"))
    loaded = sources.LoadedSessions(sources.MemoryStore({"units": units.unionByName(silent)}), design.SessionTables(DT, aligned, None, None, _trials(spark, sf_dir), regular=False), _trials(spark, sf_dir))
    return sources.unit_targets(loaded, units.unionByName(silent).select("session", "unit_id"))


# --- recorded sessions ------------------------------------------------------------------


def _store(spark, sf_dir):
    """Events as the tables of a recording: clicks are licks, values of views the running speed, purchases spikes."""
    trials, ev = _stimulus_trials(spark, sf_dir), events(spark, sf_dir)
    flags = [(F.col("trial") % 4 == k).alias(s) for k, s in enumerate(library.STIMULI)] + [(F.col("trial") % 3 == k % 3).alias(o) for k, o in enumerate(library.OUTCOMES)]
    units = ev.where("source = 'purchase'").groupBy("session", "unit_id").agg(F.sort_array(F.collect_list("time")).alias("spike_times"))
    return sources.MemoryStore({
        sources.TRIALS: trials.select(
            "session", F.col("start").alias("start_time"), F.col("stop").alias("stop_time"), F.col("stim").alias("stim_start_time"), (~F.col("included")).alias("is_instruction"),
            (F.col("context") > 0).alias("is_vis_rewarded"), *flags,
        ),
        sources.POINT_TABLES["licks"]: ev.where("source = 'click'").select("session", F.col("time").alias("timestamps")),
        sources.RUNNING: ev.where("source = 'view'").select("session", F.col("time").alias("timestamps"), F.col("value").alias("data")),
        "units": units.select("*", F.lit(True).alias("default_qc"), F.lit("sua").alias("decoder_label")),
    })


def _session_spec(name="both", *less):
    licks, running = Event("licks", (0, 2 * DT), 1), Signal("running_speed", (0, 0), 1, align="bin", outlier_zscore=None)
    return ModelSpec(tuple(p for p in (licks, running) if p.name not in less), (), name, dt=DT, fit_window=(-6 * DT, 6 * DT), fit_events=library.STIMULI)


def session_design(spark, sf_dir):
    """A store loaded and prepared: stimulus-aligned bins, events of included trials, kernels inside trials, rows to fit."""
    model = _session_spec()
    rows = sources.prepare(sources.load_sessions(_store(spark, sf_dir), model), model).rows
    return rows.select("session", "row_id", "trial", "fit", *[F.round(F.get("x", F.lit(k)), DIGITS).alias(f"x{k}") for k in range(2)])


def stimulus_mask(spark, sf_dir):
    """Bins around the stimuli of included trials."""
    return sources.stimulus_mask(sources.load_sessions(_store(spark, sf_dir), _session_spec()), (-2 * DT, 5 * DT))


def session_events(spark, sf_dir):
    """Events of every source by session: stimuli and outcomes of included trials, and licks in them."""
    spec = ModelSpec(tuple(Event(s, (0, DT)) for s in (*library.STIMULI, *library.OUTCOMES, "licks")), dt=DT)
    found = sources.load_sessions(_store(spark, sf_dir), spec).tables.events
    return _rounded(found.groupBy("session", "source").agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last")), "first", "last")


def model_comparison(spark, sf_dir):
    """Two models on the same units of all sessions, each unit a row."""
    from tempolin.batch import compare_models

    table = compare_models(_store(spark, sf_dir), [_session_spec(), _session_spec("licks alone", "running_speed")], fit=FitConfig(kernel_alpha=2.0), cv=CVConfig(), unit_limit=2)
    return _rounded(table.select("model", "session", "unit_id", "train_r2", "cv_r2", "worst_fold_r2", "n_cv_folds"), "train_r2", "cv_r2", "worst_fold_r2")


def written_results(spark, sf_dir):
    """Results written as JSON documents, a session each, and read back."""
    compiled = design.compile_design(_plain_spec(), _tables(spark, sf_dir))
    folder = scratch.fresh_folder(spark, "results")
    sinks.write_results(fit.fit_units(compiled, _targets(spark, sf_dir), FitConfig(kernel_alpha=2.0)), folder, {"model": "plain", "dt": DT})
    units = "map<string, struct<train_r2: double, intercept: double, n_iter: int, converged: boolean>>"
    read = spark.read.text(f"{folder}/{sinks.RESULTS}").select(F.from_json("value", f"session_id string, model string, dt double, units {units}").alias("d"))
    each = read.select("d.session_id", "d.model", "d.dt", F.explode("d.units").alias("unit_id", "u"))
    return _rounded(each.select(F.col("session_id").cast("long").alias("session"), F.col("unit_id").cast("long").alias("unit_id"), "model", "dt", "u.train_r2", "u.intercept", "u.n_iter", "u.converged"), "train_r2", "intercept")


def model_means(spark, sf_dir):
    """Means by group, best first: orders stand for comparison rows."""
    from tempolin.batch import mean_by_model

    orders = _read(spark, sf_dir, "orders")
    table = orders.select(F.col("o_orderpriority").alias("model"), (F.col("o_totalprice") / 1e6).alias("cv_r2"), (F.col("o_orderkey") % 7).cast("long").alias("n_iter"))
    return _rounded(mean_by_model(table), "cv_r2", "n_iter")


def union_difference(spark, sf_dir):
    """Event times of two sources as one bag, and trials that no shift can use."""
    ev = events(spark, sf_dir)
    union = ev.where("source = 'click'").select("session", "time").unionByName(ev.where("source = 'view'").select("session", "time"))
    trials = _trials(spark, sf_dir).where("trial >= 1 and trial < 28")
    valid = relational.shifted_values(trials, relational.edge_shifts(trials, "context"), "context").where("valid").select("session", "trial")
    omitted = trials.select("session", "trial").exceptAll(valid.distinct()).groupBy("session").agg(F.count("*").alias("n_omitted"))
    return union.groupBy("session").agg(F.count("*").alias("n_events")).join(omitted, "session")


def session_json(spark, sf_dir):
    """One JSON document a session with the summaries of its units."""
    compiled = design.compile_design(_plain_spec(), _tables(spark, sf_dir))
    return sinks.session_documents(fit.fit_units(compiled, _targets(spark, sf_dir), FitConfig(kernel_alpha=2.0)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        time_bins, event_histogram, smoothed_rate, trial_index, trial_index_faults, window_mask, stimulus_grid, asof_rows, trial_window_mask, trial_ends, trial_events, included_events,
        context_block_index, trial_gather, outlier_mask, gap_fill, interpolated_signal, binned_signal, binned_signal_aligned, zscored_signal, centered_signal, residual_signal, pose_signal,
        lagged_design, segmented_design, wide_design, trial_moments, trial_moments_arrow, group_moments, history_gap, kernel_ridge, alternating_fit, predictions, row_scores, kernel_table, gain_values,
        cross_validation, shift_test, baseline_shift_test, selected_penalties, penalty_errors, gains_dropout, history_fit, history_predictions, masked_fit, refit_gains, refit_kernels, lasso_refit, history_refit_gains, history_refit_kernels, segmented_history, offset_scores, outer_folds, edge_shifts, shifted_values, qc_column, qc_filter, limited_units, pending_sessions, session_catalog,
        unit_spikes, session_design, stimulus_mask, session_events, model_comparison, written_results, model_means, union_difference, session_json,
    )
}
