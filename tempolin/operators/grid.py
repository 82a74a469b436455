"""Time grids, trials, and what falls into which bin.

Tables share ``session``.  A grid has ``row_id`` (0, 1, ...), and where bins belong to
trials ``trial`` and ``bin_start`` (seconds, relative to the same origin as the times
that are binned).  Bin numbers are floors of float64 quotients.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempolin.functions.basis import gaussian_kernel, window_bounds
from tempolin.operators.relational import asof_join

#: Seconds of a session that one task puts in order where times are held against trials.
ASOF_BUCKET = 600.0


def time_bins(sessions: DataFrame, dt: float, start: str = "start", end: str = "end") -> DataFrame:
    """Complete bins of each session (columns start, end): row_id, bin_start, center."""
    if not dt > 0:
        raise ValueError("dt is positive")
    n = F.floor((F.col(end) - F.col(start)) / F.lit(dt))
    checked = sessions.withColumn("_n", F.when(F.col(end) > F.col(start), n).otherwise(F.raise_error(F.lit("a session ends after it starts")).cast("long")))
    bins = checked.where("_n > 0").select("session", F.col(start).alias("_s"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("row_id"))
    begin = F.col("_s") + F.col("row_id") * F.lit(dt)
    return bins.select("session", "row_id", begin.alias("bin_start"), (begin + dt / 2).alias("center"))


def bin_of(time: Column, dt: float) -> Column:
    return F.floor(time / F.lit(float(dt)))


def regular_rows(times: DataFrame, dt: float, n_time: int | Column, time: str = "time") -> DataFrame:
    """``times`` with the ``row_id`` of their bin; those outside the grid are left out."""
    n = F.lit(n_time) if isinstance(n_time, int) else n_time
    return times.withColumn("row_id", bin_of(F.col(time), dt)).where((F.col("row_id") >= 0) & (F.col("row_id") < n))


def aligned_rows(times: DataFrame, grid: DataFrame, dt: float, time: str = "time") -> DataFrame:
    """``times`` with the ``row_id`` and ``trial`` of the bin that holds them, for bins at any places in order.

    A bin lasts ``dt`` or until the next one starts (``next_start``, if the grid has it).
    Time is cut into cells of ``dt``; a bin is in two of them or three, so this is a join
    by equality of (session, cell) and nothing is sorted.
    """
    bins = grid.select("session", "row_id", "trial", F.col("bin_start").alias("_start"), *[F.col(c).alias("_next") for c in ("next_start",) if c in grid.columns])
    if "_next" not in bins.columns:
        following = grid.select("session", (F.col("row_id") - 1).alias("row_id"), F.col("bin_start").alias("_next"))
        bins = bins.join(following, ["session", "row_id"], "left")
    bins = bins.withColumn("_until", F.least(F.col("_start") + F.lit(float(dt)), "_next"))
    # monotone in floats as well: a time between the two is in no other cell
    cells = bins.withColumn("_cell", F.explode(F.sequence(bin_of(F.col("_start"), dt), F.greatest(bin_of(F.col("_start"), dt), bin_of(F.col("_until"), dt)))))
    names = list(times.columns)
    # bins come of few trials, whose size says nothing of theirs: they are never to be broadcast
    met = times.withColumn("_cell", bin_of(F.col(time), dt)).join(cells.hint("merge"), ["session", "_cell"])
    return met.where((F.col(time) >= F.col("_start")) & (F.col(time) < F.col("_until"))).select(*names, "row_id", "trial")


def bin_counts(rows: DataFrame, grid: DataFrame, *keys: str, value: str = "count") -> DataFrame:
    """Number of ``rows`` in each bin of ``grid`` and for each value of ``keys``; 0 where there are none."""
    counted = rows.groupBy("session", *keys, "row_id").agg(F.count("*").cast("double").alias(value))
    frame = grid.select("session", "row_id") if not keys else grid.select("session", "row_id").join(rows.select("session", *keys).distinct(), "session")
    return frame.join(counted, ["session", *keys, "row_id"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def bin_times(times: DataFrame, sessions: DataFrame, dt: float, *keys: str, smooth_sigma: float | None = None, output: str = "counts") -> DataFrame:
    """Counts or rates of ``times`` on each session's grid, smoothed by a Gaussian if asked for.

    Smoothing pads with zeros and comes before the division by dt.  It is a join of
    bins with the few weights, by the place that each bin spreads to, and one sum.
    """
    if output not in ("counts", "rate"):
        raise ValueError(f"output is 'counts' or 'rate', not {output!r}")
    bins = time_bins(sessions, dt)
    size = bins.groupBy("session").agg(F.count("*").alias("_n"))
    placed = times.join(sessions.select("session", "start"), "session").withColumn("_t", F.col("time") - F.col("start"))
    placed = placed.join(size, "session").withColumn("row_id", bin_of(F.col("_t"), dt)).where((F.col("row_id") >= 0) & (F.col("row_id") < F.col("_n")))
    out = bin_counts(placed.select("session", *keys, "row_id"), bins, *keys, value="value")
    if smooth_sigma is not None and smooth_sigma > 0:
        weights = gaussian_kernel(smooth_sigma / dt)
        reach = len(weights) // 2
        spread = F.explode(F.arrays_zip(F.sequence(F.lit(-reach), F.lit(reach)).alias("o"), F.array(*[F.lit(float(w)) for w in weights]).alias("w")))
        # only bins that hold anything spread; the rest of the grid stays 0
        moved = out.where("value <> 0").select("session", *keys, "row_id", "value", spread.alias("k"))
        summed = moved.groupBy("session", *keys, (F.col("row_id") + F.col("k.o")).alias("row_id")).agg(F.sum(F.col("value") * F.col("k.w")).alias("_v"))
        out = out.join(summed, ["session", *keys, "row_id"], "left").withColumn("value", F.coalesce("_v", F.lit(0.0))).drop("_v")
    return out.withColumn("value", F.col("value") / F.lit(dt)) if output == "rate" else out


def trial_index(trials: DataFrame, dt: float, start: str = "start", end: str = "end") -> DataFrame:
    """Bins of each trial, [floor(start / dt), floor(end / dt)): an interval join by enumeration."""
    rows = trials.where(F.col(end) > F.col(start)).select("session", "trial", bin_of(F.col(start), dt).alias("_a"), bin_of(F.col(end), dt).alias("_z"))
    rows = rows.where("_z > _a and _z > 0").select("session", "trial", F.explode(F.sequence(F.greatest(F.col("_a"), F.lit(0).cast("long")), F.col("_z") - 1)).alias("row_id"))
    return rows.select("session", "row_id", "trial")


def trial_index_faults(index: DataFrame, trials: DataFrame, dt: float, end: str = "end") -> DataFrame:
    """Bins that several trials hold or that none does; empty for a valid trial table."""
    frame = trials.groupBy("session").agg(F.max(bin_of(F.col(end), dt)).alias("_n")).where("_n > 0")
    frame = frame.select("session", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("row_id"))
    met = frame.join(index.groupBy("session", "row_id").agg(F.count("*").alias("n_trials")), ["session", "row_id"], "left")
    return met.select("session", "row_id", F.coalesce("n_trials", F.lit(0)).alias("n_trials")).where("n_trials <> 1")


def checked_trial_index(trials: DataFrame, dt: float) -> DataFrame:
    """:func:`trial_index`, or an error that names a bin that is not in exactly one trial."""
    index = trial_index(trials, dt)
    fault = trial_index_faults(index, trials, dt).first()
    if fault is not None:
        raise ValueError(f"bin {fault.row_id} of session {fault.session!r} is in {fault.n_trials} trials")
    return index


def windows_mask(events: DataFrame, grid: DataFrame, dt: float, window: tuple[float, float], time: str = "time") -> DataFrame:
    """(session, row_id) of the bins of ``grid`` inside a window around any event."""
    low, high = window_bounds(window, dt)
    around = F.explode(F.sequence(bin_of(F.col(time), dt) + low, bin_of(F.col(time), dt) + (high - 1)))
    marked = events.select("session", around.alias("row_id")).distinct()
    return grid.select("session", "row_id").join(marked, ["session", "row_id"], "left_semi")


def trial_windows_mask(events: DataFrame, grid: DataFrame, dt: float, window: tuple[float, float], time: str = "time") -> DataFrame:
    """As :func:`windows_mask` on a grid of trials: a window ends where its event's trial does."""
    low, high = window_bounds(window, dt)
    rows = aligned_rows(events, grid, dt, time)
    marked = rows.select("session", "trial", F.explode(F.sequence(F.col("row_id") + low, F.col("row_id") + (high - 1))).alias("row_id")).distinct()
    return grid.select("session", "trial", "row_id").join(marked, ["session", "trial", "row_id"], "left_semi").select("session", "row_id")


def trial_ends(trials: DataFrame, start: str = "start", stop: str = "stop") -> DataFrame:
    """``trials`` with ``end``: where the next one starts; the last ends at its own stop."""
    following = F.lead(start).over(Window.partitionBy("session").orderBy("trial"))
    return trials.withColumn("end", F.coalesce(following, F.col(stop)))


def trial_events(trials: DataFrame, flag: str, time: str = "stim", origin: str = "task_start") -> DataFrame:
    """Times, relative to the origin, of the trials whose flag is set; none if there is no such flag."""
    chosen = trials.where(F.coalesce(F.col(flag), F.lit(False)) & F.col(time).isNotNull()) if flag in trials.columns else trials.where("false")
    return chosen.select("session", (F.col(time) - F.col(origin)).alias("time"))


def included_events(events: DataFrame, trials: DataFrame, start: str = "start", time: str = "time") -> DataFrame:
    """``events`` without those in trials that are not ``included``; those before the first trial stay."""
    starts = trials.select("session", F.col(start).alias("_start"), "included")
    met = asof_join(events, starts, ["session"], time, "_start", ["included"], ASOF_BUCKET)
    return met.where(F.coalesce(F.col("included"), F.lit(True))).drop("included")


def snapped(value: Column) -> Column:
    """A value, or the nearest whole number if that is within 1e-9."""
    return F.when(F.abs(value - F.rint(value)) <= 1e-9, F.rint(value)).otherwise(value)


def stimulus_grid(trials: DataFrame, dt: float, start: str = "start", end: str = "end", stim: str = "stim") -> DataFrame:
    """Complete bins of each trial with an edge at its stimulus: row_id, trial, bin_start, next_start.

    The first row of a trial is the number of bins of the trials before it: a running sum
    over the trial table, so the bins themselves are never sorted.  ``next_start`` is where
    the session's next bin starts, null for its last one.
    """
    first = F.ceil(snapped((F.col(start) - F.col(stim)) / F.lit(dt)))
    last = F.floor(snapped((F.col(end) - F.col(stim)) / F.lit(dt)))
    bad = ~((F.col(end) > F.col(start)) & (F.col(stim) >= F.col(start)) & (F.col(stim) < F.col(end)))
    counted = trials.withColumn("_a", first).withColumn("_n", last - first)
    fault = F.when(F.coalesce(bad, F.lit(True)) | (F.col("_n") <= 0), F.raise_error(F.lit("a trial holds its stimulus and one complete bin at least")).cast("long"))
    before = Window.partitionBy("session").orderBy("trial").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_n", F.coalesce(fault, F.col("_n"))).withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = placed.withColumn("_later", F.lead(F.col(stim) + F.col("_a") * F.lit(dt)).over(Window.partitionBy("session").orderBy("trial")))
    bins = placed.select("session", "trial", F.col(stim).alias("_stim"), "_a", "_o", "_n", "_later", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_k"))
    begin = lambda k: F.col("_stim") + (F.col("_a") + k) * F.lit(dt)
    following = F.when(F.col("_k") < F.col("_n") - 1, begin(F.col("_k") + 1)).otherwise(F.col("_later"))
    return bins.select("session", (F.col("_o") + F.col("_k")).alias("row_id"), "trial", begin(F.col("_k")).alias("bin_start"), following.alias("next_start"))


def trial_gather(grid: DataFrame, trials: DataFrame, values: Sequence[str]) -> DataFrame:
    """``grid`` with values of its trials."""
    return grid.join(trials.select("session", "trial", *values), ["session", "trial"])


def time_fraction(bin_start: Column, dt: float, start: Column, end: Column) -> Column:
    """Where in the task a bin's centre lies, from 0 to 1."""
    return (bin_start + F.lit(dt / 2) - start) / (end - start)


def context_code(flag: Column) -> Column:
    """1 where the flag is set and -1 elsewhere."""
    return flag.cast("int") * 2 - 1


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(math.inf))
