"""Signals: outliers, gaps, alignment to a grid, normalisation, orthogonalisation.

Signals have ``session``, ``source``, ``sample_ix``, ``time`` (null: already on the grid)
and ``value``.  Means, deviations and medians are sums or counts that merge, joined back by
key; what needs an order is done in stretches.  So no task holds a whole signal.
Missing values are null or NaN; what comes out has none.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempolin.operators.grid import aligned_rows, finite, regular_rows
from tempolin.operators.scratch import settle

KEYS = ("session", "source")
PASSES = 5
#: Bins that a median is looked for in.
BINS = 1 << 16
#: Different values of a signal that one task may hold.
FEW_VALUES = 1 << 20
#: Samples, or bins of a grid, of a stretch that one task puts in order.
STRETCH = 4096


def group_median(rows: DataFrame, keys: Sequence[str], value: str, size: DataFrame | None = None) -> DataFrame:
    """(keys, median) of finite values, exact, by counts in bins.

    The values of a group are counted in ``BINS`` equal bins between its bounds; those of the
    bin that holds the middle are then counted value by value.  Counts are added up before
    they are shuffled, so no task needs the values of a group together, only its bins.
    ``size`` (keys, _n, _lo, _hi) has the groups' counts and bounds where they are known.
    """
    if size is None:
        size = rows.groupBy(*keys).agg(F.count(value).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")).where("_n > 0")
    middles = F.array_distinct(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2")))
    at = size.select(*keys, F.explode(middles).alias("_rank"), "_lo", "_hi").withColumn("_which", F.col("_rank"))
    of, v = [*keys, "_which", "_rank"], F.col(value)
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))

    def chosen(counted: DataFrame, order: str) -> DataFrame:
        """The bin or value of each group that holds its rank, and the rank among its values."""
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, "_which").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counted.withColumn("_b", before).where("_b <= _rank and _rank < _b + _c").withColumn("_rank", F.col("_rank") - F.col("_b"))

    share = (v - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    bins = rows.join(at, list(keys)).withColumn("_bin", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1)))
    counted = bins.groupBy(*of, "_bin").agg(F.count("*").alias("_c"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    at = chosen(counted, "_bin").select(*of, "_lo", "_hi")
    last = rows.join(at, list(keys)).where(inside).groupBy(*of, v.alias("_x")).agg(F.count("*").alias("_c"))
    return chosen(last, "_x").groupBy(*keys).agg(F.avg("_x").alias("median"))


def _far(v: Column, threshold: float):
    """Whether a value lies too far from a pass's median; the quotient only where there is a scale, as a condition would not keep Spark from dividing."""
    return lambda p: (p["s"] >= 1e-12) & (F.abs(v - p["m"]) / F.greatest(p["s"], F.lit(1e-12)) > threshold)


def mark_outliers(signals: DataFrame, threshold: float | None, keys: Sequence[str] = KEYS, few: int = FEW_VALUES) -> DataFrame:
    """``signals`` with values null that lie more than ``threshold`` scales from the median.

    The scale is 1.4826 times the median absolute deviation, or the population standard
    deviation where that is 0.  Five passes at most, each without the values masked
    before, and none for a signal of which the last pass masked nothing.  Infinite values are
    neither counted nor masked.

    A signal's passes are a list of medians and scales, so samples are read and never
    written.  Equal values are counted before they are shuffled: a signal of up to ``few`` different
    values is then a table that one task can hold, and goes through all passes there; a longer one
    has its medians found over many tasks.
    """
    if threshold is None or threshold <= 0:
        return signals
    values = signals.where(finite(F.col("value"))).select(*keys, F.col("value").cast("double").alias("_v"))
    sizes = settle(values.groupBy(*keys).agg(F.approx_count_distinct("_v", 0.05).alias("_distinct")))
    # the estimate is within a fifth: what one task holds stays bounded
    short = sizes.where(F.col("_distinct") <= few).select(*keys)
    state = _passes_in_tasks(values.join(short, list(keys)), threshold, keys)
    if not sizes.where(F.col("_distinct") > few).isEmpty():
        state = state.unionByName(_passes_by_selection(values.join(sizes.where(F.col("_distinct") > few).select(*keys), list(keys)), threshold, keys))
    masked = finite(F.col("value")) & F.exists("_passes", _far(F.col("value"), threshold))
    marked = signals.join(state, list(keys), "left")
    return marked.withColumn("value", F.when(~F.coalesce(masked, F.lit(False)), F.col("value"))).select(*signals.columns)


def _passes_in_tasks(values: DataFrame, threshold: float, keys: Sequence[str]) -> DataFrame:
    """(keys, _passes) from the counts of each signal's different values."""
    kinds = dict(values.dtypes)

    def middle(v: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(v, kind="stable")
        upto, total = np.cumsum(n[order]), int(n.sum())
        return float(v[order][np.searchsorted(upto, [(total - 1) // 2, total // 2], side="right")].mean())

    def passes(table: pa.Table) -> pa.Table:
        v, n = table.column("_v").to_numpy(), table.column("_c").to_numpy()
        told = []
        for _ in range(PASSES):
            if not len(v):
                break
            m = middle(v, n)
            d, mean = middle(np.abs(v - m), n), float((v * n).sum() / n.sum())
            s = 0.0 if n.sum() < 2 else 1.4826 * d if d >= 1e-12 else float(np.sqrt((n * (v - mean) ** 2).sum() / n.sum()))
            told.append({"m": m, "s": s})
            far = np.abs(v - m) / max(s, 1e-12) > threshold
            if s < 1e-12 or not far.any():
                break
            v, n = v[~far], n[~far]
        kind = pa.list_(pa.struct([("m", pa.float64()), ("s", pa.float64())]))
        return pa.table({k: table.column(k)[:1] for k in keys} | {"_passes": pa.array([told], kind)})

    counted = values.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    return counted.groupBy(*keys).applyInArrow(passes, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", _passes array<struct<m:double,s:double>>")


def _passes_by_selection(values: DataFrame, threshold: float, keys: Sequence[str]) -> DataFrame:
    """The same, with medians found by counts in bins; the state, one row a signal, is written in each pass."""
    state = None  # (keys, _passes, _masked)
    for _ in range(PASSES):
        if state is None:
            kept = values
        else:
            # the last pass masked something there: the others are done
            kept = values.join(state.where("_masked > 0").select(*keys, "_passes"), list(keys)).where(~F.exists("_passes", _far(F.col("_v"), threshold))).select(*keys, "_v")
        size = kept.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.stddev_pop("_v").alias("_s"))
        centre = settle(group_median(kept, keys, "_v", size).withColumnRenamed("median", "_m").join(size, list(keys)))
        distances = kept.join(centre.select(*keys, "_m"), list(keys)).select(*keys, F.abs(F.col("_v") - F.col("_m")).alias("_d"))
        bounds = centre.select(*keys, "_n", F.lit(0.0).alias("_lo"), F.greatest(F.col("_hi") - F.col("_m"), F.col("_m") - F.col("_lo")).alias("_hi"))
        apart = group_median(distances, keys, "_d", bounds).withColumnRenamed("median", "_d")
        scale = F.when(F.col("_n") < 2, 0.0).when(F.col("_d") >= 1e-12, 1.4826 * F.col("_d")).otherwise(F.col("_s"))
        found = centre.join(apart, list(keys)).select(*keys, F.struct(F.col("_m").alias("m"), scale.alias("s")).alias("_p"))
        met = kept.join(found, list(keys)).groupBy(*keys).agg(F.first("_p").alias("_p"), F.count_if(_far(F.col("_v"), threshold)(F.col("_p"))).alias("_more"))
        if state is None:
            state = settle(met.select(*keys, F.array("_p").alias("_passes"), F.col("_more").alias("_masked")))
        else:
            passes = F.when(F.col("_p").isNotNull(), F.concat(F.col("_passes"), F.array("_p"))).otherwise(F.col("_passes"))
            state = settle(state.join(met, list(keys), "left").select(*keys, passes.alias("_passes"), F.coalesce("_more", F.lit(0)).alias("_masked")))
        if state.where("_masked > 0").isEmpty():
            break
    return state.select(*keys, "_passes")


def _neighbours(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: float) -> DataFrame:
    """Rows with the known points (``_p`` = struct(time, value)) before and after them, in the order ``order``, which begins with ``_t``.

    A signal is cut into stretches of ``size`` along ``_t``.  Within each both are running
    values, the second one in the opposite order: a frame that ends with the partition would
    be gone through again for every row.  The last and first points of the stretches, one row
    each, are carried to those beside them that have none.
    """
    cut = rows.withColumn("_c", F.floor(F.col("_t") / F.lit(float(size))))
    running = lambda order: F.last("_p", ignorenulls=True).over(Window.partitionBy(*keys, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = cut.withColumn("_a", running([F.col(c).asc() for c in order])).withColumn("_z", running([F.col(c).desc() for c in order]))
    point = F.when(F.col("_p").isNotNull(), F.struct(*order, "_p"))
    ends = cut.groupBy(*keys, "_c").agg(F.max(point).alias("_last"), F.min(point).alias("_first"))
    beside = lambda name, order: F.last(f"{name}._p", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(*keys, "_c", beside("_last", F.col("_c").asc()).alias("_from"), beside("_first", F.col("_c").desc()).alias("_to"))
    met = near.join(carried, [*keys, "_c"])
    return met.withColumns({"_a": F.coalesce("_a", "_from"), "_z": F.coalesce("_z", "_to")}).drop("_c", "_from", "_to")


def _between(at: str):
    """Linear interpolation between the points ``_a`` and ``_z``; the only one there is at the ends."""
    a, z = F.col("_a"), F.col("_z")
    slope = (z["value"] - a["value"]) / F.when(z["time"] > a["time"], z["time"] - a["time"])
    return F.when(a.isNull(), z["value"]).when(z.isNull() | (a["time"] >= F.col(at)) | (z["time"] <= a["time"]), a["value"]).otherwise(slope * (F.col(at) - a["time"]) + a["value"])


def fill_gaps(samples: DataFrame, keys: Sequence[str] = KEYS, order: str = "sample_ix") -> DataFrame:
    """Missing values of signals on the grid, interpolated over the ordinal, level at the ends."""
    missing = F.col("value").isNull() | F.isnan("value")
    rows = samples.withColumn("_t", F.col(order).cast("double")).withColumn("_p", F.when(~missing, F.struct(F.col("_t").alias("time"), "value")))
    filled = _neighbours(rows, keys, ["_t"], STRETCH).withColumn("value", F.when(missing, _between("_t")).otherwise(F.col("value")))
    empty = F.col("_a").isNull() & F.col("_z").isNull()
    return filled.withColumn("value", F.when(empty, F.raise_error(F.lit("a signal has no values")).cast("double")).otherwise(F.col("value"))).drop("_t", "_p", "_a", "_z")


def interpolate(signals: DataFrame, grid: DataFrame, dt: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Signals at the bin centres: (keys, row_id, value), linear between samples, level at the ends.

    Samples at one time count in the order of their ordinal.
    """
    known = signals.where(finite(F.col("value")) & finite(F.col("time"))).select(
        *keys, F.col("time").alias("_t"), F.lit(0).alias("_k"), "sample_ix", F.lit(None).cast("long").alias("row_id"), F.struct(F.col("time"), "value").alias("_p")
    )
    sources = signals.select(*keys).distinct()
    wanted = grid.select("session", "row_id", (F.col("bin_start") + F.lit(dt / 2)).alias("_t")).join(sources, "session")
    wanted = wanted.select(*keys, "_t", F.lit(1).alias("_k"), F.lit(None).cast("long").alias("sample_ix"), "row_id", F.lit(None).cast(known.schema["_p"].dataType).alias("_p"))
    met = _neighbours(known.unionByName(wanted), keys, ["_t", "_k", "sample_ix"], dt * STRETCH).where("row_id is not null")
    return met.select(*keys, "row_id", _between("_t").alias("value"))


def bin_mean(signals: DataFrame, grid: DataFrame, dt: float, keys: Sequence[str] = KEYS, regular: bool = True) -> DataFrame:
    """Means of the samples in each bin: (keys, row_id, value); bins without samples are 0."""
    known = signals.where(finite(F.col("value")) & finite(F.col("time")))
    if regular:
        size = grid.groupBy("session").agg(F.count("*").alias("_n"))
        rows = regular_rows(known.join(size, "session"), dt, F.col("_n"))
    else:
        rows = aligned_rows(known, grid, dt)
    means = rows.groupBy(*keys, "row_id").agg(F.avg("value").alias("value"))
    # bins come of few sessions, whose size says nothing of theirs: they are never to be broadcast
    frame = grid.select("session", "row_id").hint("merge").join(signals.select(*keys).distinct(), "session")
    return frame.join(means, [*keys, "row_id"], "left").select(*keys, "row_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def normalize(values: DataFrame, mode: str, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """Centre, or centre and scale by the population deviation, over all rows of a key."""
    if mode == "none":
        return values
    if mode not in ("center", "zscore"):
        raise ValueError(f"no normalisation is called {mode!r}")
    known = values.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    scale = F.when(F.col("_s") < 1e-12, F.lit(1.0)).otherwise(F.col("_s")) if mode == "zscore" else F.lit(1.0)
    return values.join(known, list(keys)).withColumn(value, (F.col(value) - F.col("_m")) / scale).select(*values.columns)


def residualize(rows: DataFrame, value: str, reference: str, fit: str = "fit", keys: Sequence[str] = ("session",)) -> DataFrame:
    """``rows`` with the projection of ``value`` on ``reference`` taken out.

    Means and slope come from rows where ``fit`` is true; the correction is for all rows
    and keeps the mean.  A reference that doesn't vary changes nothing.
    """
    chosen = lambda c: F.when(F.col(fit), F.col(c))
    r, v = chosen(reference), chosen(value)
    sums = rows.groupBy(*keys).agg(F.avg(r).alias("_mr"), F.covar_pop(v, r).alias("_rv"), F.var_pop(r).alias("_rr"), F.count(r).alias("_n"))
    slope = F.when(F.col("_rr") * F.col("_n") >= 1e-12, F.col("_rv") / F.greatest("_rr", F.lit(1e-300))).otherwise(0.0)
    return rows.join(sums, list(keys)).withColumn(value, F.col(value) - (F.col(reference) - F.col("_mr")) * slope).select(*rows.columns)
