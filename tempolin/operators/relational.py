"""Joins and runs that Spark has no single operator for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], bucket: float | None = None) -> DataFrame:
    """``left`` with ``values`` of the last ``right`` row of the same ``by`` at or before its time.

    One union and one ordered window, no range join.  With ``bucket`` (in units of time)
    a long series is cut into buckets that are handled apart: the last right row of each
    is carried to the later ones, a table of one row a bucket.
    """
    names = list(left.columns)
    mine = left.select(F.struct(*names).alias("_l"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col(left_time).cast("double").alias("_t"), F.lit(None).alias("_r"), F.lit(1).alias("_k"))
    packed = F.struct(*[F.col(v) for v in values])
    theirs = right.select(
        F.lit(None).alias("_l"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col(right_time).cast("double").alias("_t"), packed.alias("_r"), F.lit(0).alias("_k")
    )
    keys = [f"_b{i}" for i in range(len(by))]
    rows = mine.unionByName(theirs)
    if bucket is not None:
        rows = rows.withColumn("_c", F.floor(F.col("_t") / bucket))
        before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
        ends = rows.groupBy(*keys, "_c").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_t"))).alias("_e"))
        carried = ends.select(*keys, "_c", F.last("_e", ignorenulls=True).over(before).alias("_r")).where("_r is not null")
        rows = rows.unionByName(carried.withColumn("_t", F.lit(float("-inf"))).withColumn("_k", F.lit(0)).withColumn("_l", F.lit(None).cast(rows.schema["_l"].dataType)))
        keys = [*keys, "_c"]
    running = Window.partitionBy(*keys).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.withColumn("_r", F.last("_r", ignorenulls=True).over(running)).where("_l is not null")
    return met.select(*[F.col(f"_l.{c}").alias(c) for c in names], *[F.col(f"_r.{v}").alias(v) for v in values])


def run_number(value: Column, order: Column, *by: str) -> Column:
    """Number of the run of equal values that a row is in, from 0."""
    ordered = Window.partitionBy(*by).orderBy(order)
    changed = (value != F.lag(value).over(ordered)).cast("long")
    return F.coalesce(changed, F.lit(0))


def context_blocks(trials: DataFrame, value: str, by: Sequence[str] = ("session",), order: str = "trial") -> DataFrame:
    """``trials`` with ``block``: 0 for the first run of equal values, and so on."""
    ordered = Window.partitionBy(*by).orderBy(order)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = trials.withColumn("_new", run_number(F.col(value), F.col(order), *by))
    return marked.withColumn("block", F.sum("_new").over(running)).drop("_new")


def edge_shifts(trials: DataFrame, value: str, by: Sequence[str] = ("session",), order: str = "trial") -> DataFrame:
    """The shifts that half of the first and of the last run of equal values support: one row each, 0 first."""
    ordered = Window.partitionBy(*by).orderBy(order)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = trials.select(
        *by, F.col(value).alias("v"), F.row_number().over(ordered).alias("i"), F.first(value).over(whole).alias("a"), F.last(value).over(whole).alias("z"), F.count("*").over(whole).alias("n")
    )
    close = lambda x, y: F.abs(F.col(x) - F.col(y)) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.col(y))
    ends = numbered.groupBy(*by).agg(
        F.min(F.when(~close("v", "a"), F.col("i") - 1)).alias("first"), F.min(F.when(~close("v", "z"), F.col("n") - F.col("i"))).alias("last"), F.max("n").alias("n_trials")
    )
    shifts = F.concat(F.sequence(F.lit(0), F.expr("first div 2").cast("int")), F.when(F.expr("last div 2") > 0, F.sequence(-F.expr("last div 2").cast("int"), F.lit(-1))).otherwise(F.array().cast("array<int>")))
    return ends.where("first is not null").select(*by, F.posexplode(shifts).alias("ordinal", "shift"), "n_trials")


def shifted_values(trials: DataFrame, shifts: DataFrame, value: str, by: Sequence[str] = ("session",), order: str = "trial") -> DataFrame:
    """Each trial's value after each circular shift, and whether no shift wraps around it (``valid``).

    Trials and shifts are few; the shifted place is met by an equality join.
    """
    numbered = trials.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    reach = shifts.groupBy(*by).agg(F.greatest(F.max("shift"), F.lit(0)).alias("_up"), F.least(F.min("shift"), F.lit(0)).alias("_down"))
    source = numbered.select(*by, F.col("_i").alias("_source"), F.col(value).alias("shifted"))
    placed = numbered.select(*by, order, "_i").join(shifts, list(by)).withColumn("_source", F.pmod(F.col("_i") - F.col("shift"), F.col("n_trials")).cast("int"))
    met = placed.join(source, [*by, "_source"]).join(reach, list(by))
    valid = (F.col("_i") >= F.col("_up")) & (F.col("_i") < F.col("n_trials") + F.col("_down"))
    return met.select(*by, order, "ordinal", "shift", "shifted", valid.alias("valid"))


def grouped_folds(trials: DataFrame, group: str, by: Sequence[str] = ("session",), order: str = "trial") -> DataFrame:
    """``trials`` with ``fold``: groups numbered in the order of their first trial."""
    first = trials.groupBy(*by, group).agg(F.min(order).alias("_first"))
    numbered = first.withColumn("fold", F.row_number().over(Window.partitionBy(*by).orderBy("_first")) - 1).drop("_first")
    return trials.join(numbered, [*by, group])


def even_folds(trials: DataFrame, folds: int, by: Sequence[str] = ("session",), order: str = "trial") -> DataFrame:
    """``trials`` with ``fold``: consecutive trials in parts whose sizes differ by one at most, larger ones first."""
    if folds < 2:
        raise ValueError("CV has two folds at least")
    return trials.withColumn("fold", F.ntile(folds).over(Window.partitionBy(*by).orderBy(order)) - 1)


def with_history_gap(grid: DataFrame, side: str, lag_bins: int, by: Sequence[str] = ("session",), order: str = "row_id") -> DataFrame:
    """``grid`` with boolean ``safe``: the row and the ``lag_bins`` rows before it are all on this side.

    The first ``lag_bins`` rows of a session are never safe.
    """
    if lag_bins <= 0:
        return grid.withColumn("safe", F.col(side))
    ordered = Window.partitionBy(*by).orderBy(order)
    back = F.min(F.col(side).cast("int")).over(ordered.rowsBetween(-lag_bins, 0)) == 1
    return grid.withColumn("safe", back & (F.row_number().over(ordered) > lag_bins))
