"""From a model and the tables of its sessions to a design and its per-trial moments.

``compile_design`` declares one DataFrame: a row for each bin with ``session``,
``row_id``, ``trial``, ``fit`` (whether a fit uses it) and ``x``, the convolved columns of
all predictors but the target's history.  Event counts and signals of all predictors
meet in one wide row a bin; the convolution is done on arrays, for stretches of a session (or
of a trial, where kernels don't reach across trials).  Up to ``SQL_COLUMNS`` columns it is
window functions instead, which stay in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempolin.functions.basis import lags_of, make_basis
from tempolin.functions.bilinear import Design
from tempolin.operators import conditioning
from tempolin.operators.grid import aligned_rows, finite, regular_rows, trial_windows_mask, windows_mask
from tempolin.plans.spec import Event, History, ModelSpec, ParameterLayout, Signal

SQL_COLUMNS = 16
#: Rows that a task convolves at a time.
STRETCH = 8192


@dataclass(frozen=True)
class SessionTables:
    """The inputs of one or many sessions; a session is a key in each table.

    grid: session, row_id, trial, and bin_start where bins are not ``row_id * dt``.
    events: session, source, time.  signals: session, source, sample_ix, time, value.
    trials: session, trial, the values that gains read, and optionally cv_group and
    included.
    """

    dt: float
    grid: DataFrame
    events: DataFrame | None
    signals: DataFrame | None
    trials: DataFrame
    regular: bool = True

    def __post_init__(self) -> None:
        if not (math.isfinite(self.dt) and self.dt > 0):
            raise ValueError(f"dt is a positive number, not {self.dt}")

    @property
    def has_groups(self) -> bool:
        return "cv_group" in self.trials.columns


@dataclass(frozen=True)
class CompiledDesign:
    """A design and what is needed to read its columns."""

    design: Design
    rows: DataFrame
    tables: SessionTables
    segmented: bool = False
    history: tuple[str, ...] = field(default=())

    @property
    def history_lag_bins(self) -> int:
        return max((int(self.design.lags[n].max()) for n in self.history), default=0)

    @property
    def base_columns(self) -> np.ndarray:
        """Columns of beta that ``x`` holds; the history's are made for each target."""
        return ~self.design.columns_of(self.history)


def _kernels(spec: ModelSpec, dt: float) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    lags = {p.name: lags_of(p.window, dt) for p in spec.predictors}
    for p in spec.predictors:
        if isinstance(p, History) and lags[p.name].min() < 1:
            raise ValueError(f"history {p.name!r} begins one bin in the past at the earliest")
    return lags, {p.name: make_basis(p.basis, p.n_basis, len(lags[p.name])) for p in spec.predictors}


def lagged(values: np.ndarray, row_id: np.ndarray, lags: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """(rows, functions): the value ``lag`` rows earlier, 0 where there is none, times the basis."""
    source = row_id[:, None] - lags[None, :]
    place = np.minimum(np.searchsorted(row_id, source), len(row_id) - 1)
    return np.where(row_id[place] == source, values[place], 0.0) @ basis


def _event_counts(events: DataFrame, tables: SessionTables, sources: list[str]) -> DataFrame:
    """(session, row_id, one column of counts a source); all sources in one aggregation."""
    chosen = events.where(F.col("source").isin(*sources))
    checked = chosen.withColumn("time", F.when(finite(F.col("time")), F.col("time")).otherwise(F.raise_error(F.lit("an event has no finite time")).cast("double")))
    rows = _rows_of(checked, tables)
    return rows.groupBy("session", "row_id").agg(*[F.count(F.when(F.col("source") == s, 1)).cast("double").alias(f"event_{k}") for k, s in enumerate(sources)])


def _rows_of(times: DataFrame, tables: SessionTables) -> DataFrame:
    if not tables.regular:
        return aligned_rows(times, tables.grid, tables.dt)
    size = tables.grid.groupBy("session").agg(F.count("*").alias("_n"))
    return regular_rows(times.join(size, "session"), tables.dt, F.col("_n")).drop("_n")


def _signal_series(spec: ModelSpec, tables: SessionTables) -> DataFrame | None:
    """(session, row_id, one column a signal predictor), aligned and normalised."""
    wanted = [p for p in spec.predictors if isinstance(p, Signal)]
    if not wanted:
        return None
    if tables.signals is None:
        raise KeyError(f"the model reads signals, and there are none: {[p.source for p in wanted]}")
    on_grid = F.col("time").isNull()
    starts = tables.grid if "bin_start" in tables.grid.columns else tables.grid.withColumn("bin_start", F.col("row_id") * F.lit(tables.dt))
    parts = []
    # predictors that are conditioned in the same way go through together, keyed by their name
    for threshold, align, mode in sorted({(p.outlier_zscore, p.align, p.normalize) for p in wanted}, key=str):
        names = [(p.name, p.source) for p in wanted if (p.outlier_zscore, p.align, p.normalize) == (threshold, align, mode)]
        copies = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).alias("s")) for n, s in names]))
        samples = tables.signals.withColumn("_c", copies).where(F.col("source") == F.col("_c.s")).withColumn("source", F.col("_c.n")).drop("_c")
        clean = conditioning.mark_outliers(samples, threshold)
        placed = conditioning.fill_gaps(clean.where(on_grid)).select("session", "source", F.col("sample_ix").alias("row_id"), "value")
        timed = clean.where(~on_grid)
        resampled = conditioning.interpolate(timed, starts, tables.dt) if align == "interp" else conditioning.bin_mean(timed, starts, tables.dt, regular=tables.regular)
        parts.append(conditioning.normalize(placed.unionByName(resampled), mode))
    series = reduce(DataFrame.unionByName, parts)
    return series.groupBy("session", "row_id").agg(*[F.max(F.when(F.col("source") == p.name, F.col("value"))).alias(f"signal_{k}") for k, p in enumerate(wanted)])


def compile_design(
    spec: ModelSpec, tables: SessionTables, fit_mask: DataFrame | None = None, row_mask: DataFrame | None = None, segmented: bool = False
) -> CompiledDesign:
    """Bind a model to tables.

    ``fit_mask`` (session, row_id) replaces the model's fit window; ``row_mask`` further
    restricts either.  ``segmented`` keeps kernels and fit windows inside trials.
    """
    if not math.isclose(spec.dt, tables.dt, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError(f"the model's dt {spec.dt} is not the data's {tables.dt}")
    lags, bases = _kernels(spec, tables.dt)
    missing = sorted({g.source for g in spec.gains}.difference(tables.trials.columns))
    if missing:
        raise KeyError(f"the trial table lacks the gain sources {missing}")
    events = [p for p in spec.predictors if isinstance(p, Event)]
    if (events or spec.fit_window) and tables.events is None:
        raise KeyError("the model reads events, and there are none")

    keep = tables.grid.select("session", "row_id", "trial")
    if fit_mask is None and spec.fit_window is not None:
        chosen = tables.events.where(F.col("source").isin(*spec.fit_events)).select("session", "time")
        fit_mask = trial_windows_mask(chosen, tables.grid, tables.dt, spec.fit_window) if segmented else windows_mask(chosen, tables.grid, tables.dt, spec.fit_window)
    wide = keep.withColumn("fit", F.lit(True)) if fit_mask is None else _flagged(keep, fit_mask, "fit")
    if row_mask is not None:
        wide = _flagged(wide, row_mask, "_kept").withColumn("fit", F.col("fit") & F.col("_kept")).drop("_kept")
    event_names = {s: f"event_{k}" for k, s in enumerate(sorted({p.source for p in events}))}
    signal_names = {p.name: f"signal_{k}" for k, p in enumerate(p for p in spec.predictors if isinstance(p, Signal))}
    if events:
        wide = wide.join(_event_counts(tables.events, tables, list(event_names)), ["session", "row_id"], "left")
    series = _signal_series(spec, tables)
    if series is not None:
        wide = wide.join(series, ["session", "row_id"], "left")
        for name in spec.orthogonal_order():
            wide = conditioning.residualize(wide, signal_names[name], signal_names[spec.predictor(name).orthogonalize_against])
    sources = {p.name: event_names[p.source] if isinstance(p, Event) else signal_names[p.name] for p in spec.predictors if not isinstance(p, History)}
    layout = ParameterLayout.of(spec, {n: b.shape[1] for n, b in bases.items()})
    history = tuple(p.name for p in spec.predictors if isinstance(p, History))
    convolve = convolve_sql if sum(bases[n].shape[1] for n in sources) <= SQL_COLUMNS else convolve_arrow
    rows = convolve(wide, sources, lags, bases, segmented)
    return CompiledDesign(Design(spec, layout, bases, lags), rows, tables, segmented, history)


def with_mask(compiled: CompiledDesign, mask: DataFrame | None) -> CompiledDesign:
    """The design with ``mask`` (session, row_id) in place of the rows that it selects; None changes nothing."""
    return compiled if mask is None else replace(compiled, rows=_flagged(compiled.rows.drop("fit"), mask, "fit"))


def _flagged(rows: DataFrame, mask: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean that is true where ``mask`` has the row."""
    return rows.join(mask.select("session", "row_id").distinct().withColumn(name, F.lit(True)), ["session", "row_id"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def convolve_sql(wide: DataFrame, sources: Mapping[str, str], lags: Mapping[str, np.ndarray], bases: Mapping[str, np.ndarray], segmented: bool) -> DataFrame:
    """The convolution as window functions: one ordered window for all columns."""
    ordered = Window.partitionBy("session", *["trial"] * segmented).orderBy("row_id")
    zeroed = wide.fillna(0.0, subset=sorted(set(sources.values())))

    def column(name: str, k: int) -> Column:
        terms = [
            F.lag(sources[name], int(lag), 0.0).over(ordered) * F.lit(float(w)) for lag, w in zip(lags[name], bases[name][:, k]) if w != 0.0
        ]
        return reduce(lambda a, b: a + b, terms, F.lit(0.0))

    x = [column(name, k) for name in sources for k in range(bases[name].shape[1])]
    return zeroed.select("session", "row_id", "trial", "fit", F.array(*x).cast("array<double>").alias("x"))


def convolve_arrow(wide: DataFrame, sources: Mapping[str, str], lags: Mapping[str, np.ndarray], bases: Mapping[str, np.ndarray], segmented: bool, stretch: int = STRETCH) -> DataFrame:
    """The convolution on arrays, for stretches of a session or trial with the rows around them that the lags reach."""
    reach = [int(x) for name in sources for x in (lags[name].min(), lags[name].max())]
    size = max(stretch, 4 * max(map(abs, reach), default=0))
    # a row goes to the stretches of all rows that it is a lag away from
    stretches = F.sequence(F.expr(f"floor((row_id + {min(0, *reach)}) / {size})"), F.expr(f"floor((row_id + {max(0, *reach)}) / {size})")) if reach else F.array(F.expr(f"floor(row_id / {size})"))
    dealt = wide.withColumn("_c", F.explode(stretches))

    def convolve(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_id")
        row_id = table.column("row_id").to_numpy()
        series = {c: np.nan_to_num(table.column(c).to_numpy(zero_copy_only=False).astype(float), nan=0.0) for c in set(sources.values())}
        own = np.flatnonzero(row_id // size == table.column("_c")[0].as_py())
        x = np.hstack([lagged(series[column], row_id, lags[name], bases[name])[own] for name, column in sources.items()]) if sources else np.zeros((len(own), 0))
        return pa.table([table.column(c).take(pa.array(own)) for c in ("session", "row_id", "trial", "fit")] + [lists(x)], names=["session", "row_id", "trial", "fit", "x"])

    kinds = dict(wide.dtypes)
    schema = f"session {kinds['session']}, row_id {kinds['row_id']}, trial {kinds['trial']}, fit boolean, x array<double>"
    return dealt.groupBy("session", *["trial"] * segmented, "_c").applyInArrow(convolve, schema)


def moments_sql(rows: DataFrame, targets: DataFrame, p: int) -> DataFrame:
    """Moments as plain sums, for few columns: (session, unit_id, trial, n, sx, sxx, sy, sxy, syy)."""
    units = targets.select("session", "unit_id").distinct()
    met = rows.where("fit").join(units, "session").join(targets, ["session", "unit_id", "row_id"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    x = [F.get("x", F.lit(i)) for i in range(p)]
    return met.groupBy("session", "unit_id", "trial").agg(
        F.count("*").cast("double").alias("n"), F.array(*[F.sum(c) for c in x]).alias("sx"), F.array(*[F.sum(a * b) for i, a in enumerate(x) for b in x[: i + 1]]).alias("sxx"),
        F.sum("y").alias("sy"), F.array(*[F.sum(c * F.col("y")) for c in x]).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy"),
    )


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists of numbers as (rows, length), without Python objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return np.zeros((0, 0))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an Arrow column of lists."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values, dtype=float).ravel()))


def _triangle(gram: np.ndarray) -> np.ndarray:
    return gram[np.tril_indices(len(gram))]


def full_gram(packed: np.ndarray, p: int) -> np.ndarray:
    """Symmetric matrices from their lower triangles, row after row."""
    out = np.zeros((*packed.shape[:-1], p, p))
    a, b = np.tril_indices(p)
    out[..., a, b] = packed
    out[..., b, a] = packed
    return out


def design_moments(rows: DataFrame, by: Sequence[str] = ("trial",)) -> DataFrame:
    """(session, by, n, sums of x and of the lower triangle of x x'): the half that all units of a session share.

    Each Arrow batch is reduced to one partial sum a key before the shuffle.
    """
    keys = ["session", *by]
    kinds = dict(rows.dtypes)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, (label, columns) = matrix(batch.column("x")), _labels(batch, keys)
                sums = []
                for at in _members(label, len(columns[0])):
                    sums.append(np.concatenate([[len(at)], x[at].sum(axis=0), _triangle(x[at].T @ x[at])]))
                sums = np.array(sums)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sums[:, 0]), lists(sums[:, 1:])], names=[*keys, "n", "sums"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n double, sums array<double>"
    parts = rows.where("fit").select(*keys, "x").mapInArrow(partial, schema)

    def merge(table: pa.Table) -> pa.Table:
        n = float(np.sum(table.column("n").to_numpy()))
        return pa.table({k: table.column(k)[:1] for k in keys} | {"n": [n], "sums": lists(matrix(table.column("sums")).sum(axis=0)[None, :])})

    return dealt(parts, *keys).groupBy(*keys).applyInArrow(merge, schema)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by key in as many partitions as shuffles have: Spark puts none together because its bytes are few."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _labels(batch: pa.RecordBatch, keys: Sequence[str]) -> tuple[np.ndarray, list[pa.Array]]:
    """The number of each row's key, and the keys by number as columns."""
    names: dict[tuple, int] = {}
    label = np.array([names.setdefault(k, len(names)) for k in zip(*(batch.column(c).to_pylist() for c in keys))], dtype=np.int64)
    return label, [pa.array(values, batch.column(c).type) for c, values in zip(keys, zip(*names))]


def _members(label: np.ndarray, count: int) -> list[np.ndarray]:
    return np.split(np.argsort(label, kind="stable"), np.cumsum(np.bincount(label, minlength=count))[:-1])


@dataclass(frozen=True)
class CoMoments:
    """How a target's sums are packed: count, means of (x, h, y), and co-moments of (h, y) with (x, h, y).

    ``x`` are ``p`` columns of the design and ``h`` the ``k`` columns of the target's own past.  Sums are
    of differences from the means, so that they keep their digits where the mean of a target is
    large beside its spread; parts are merged pairwise.
    """

    p: int
    k: int = 0

    @property
    def width(self) -> int:
        return self.p + self.k + 1

    def of(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """One packed row for rows of x and of (h, y)."""
        whole = np.column_stack([x, own])
        mean = whole.mean(axis=0)
        apart = whole - mean
        return np.concatenate([[len(whole)], mean, (apart[:, self.p :].T @ apart).ravel()])

    def unpacked(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return rows[:, 0], rows[:, 1 : self.width + 1], rows[:, self.width + 1 :].reshape(len(rows), self.k + 1, self.width)

    def merged(self, rows: np.ndarray) -> np.ndarray:
        n, mean, apart = self.unpacked(rows)
        total = n.sum()
        whole = (n[:, None] * mean).sum(axis=0) / total
        off = mean - whole
        between = np.einsum("g,gi,gj->ij", n, off[:, self.p :], off)
        return np.concatenate([[total], whole, (apart.sum(axis=0) + between).ravel()])

    def with_zeros(self, rows: np.ndarray, n: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(means, co-moments) over all ``n`` rows of each key, whose x sum to ``x``: the others have y and h of 0."""
        m, mean, apart = self.unpacked(rows)
        rest = n - m
        share = np.where(rest[:, None] > 0, (x - m[:, None] * mean[:, : self.p]) / np.maximum(rest, 1.0)[:, None], 0.0)
        zeros = np.column_stack([share, np.zeros((len(n), self.k + 1))])
        whole = np.column_stack([x, m[:, None] * mean[:, self.p :]]) / n[:, None]
        for weight, part in ((m, mean), (rest, zeros)):
            off = part - whole
            apart = apart + np.einsum("g,gi,gj->gij", weight, off[:, self.p :], off)
        return whole, apart


def own_rows(compiled: CompiledDesign, targets: DataFrame) -> DataFrame:
    """(session, unit_id, row_id, y, h): rows where a target or its own past is not 0.

    Each value that is not 0 is dealt to its own row and to those that it is in the past of,
    times the bases' weights, and what meets in a row is added up.  So nothing is
    ordered, and units and sessions of any length are spread over tasks.
    """
    values = targets.where("y <> 0").select("session", "unit_id", "row_id", "y")
    if not compiled.history:
        return values.withColumn("h", F.array().cast("array<double>"))
    at, weights = 0, {0: {}}
    for name in compiled.history:
        basis = compiled.design.bases[name]
        for lag, row in zip(compiled.design.lags[name].tolist(), basis.tolist()):
            weights.setdefault(lag, {}).update({at + k: w for k, w in enumerate(row)})
        at += basis.shape[1]
    parts = [F.struct(F.lit(lag).alias("lag"), F.array(*[F.lit(float(row.get(k, 0.0))) for k in range(at)]).alias("w")) for lag, row in sorted(weights.items())]
    if compiled.segmented:
        values = values.join(compiled.rows.select("session", "row_id", F.col("trial").alias("_from")), ["session", "row_id"])
    dealt = values.withColumn("_p", F.explode(F.array(*parts))).select(
        "session", "unit_id", (F.col("row_id") + F.col("_p.lag")).alias("row_id"), F.when(F.col("_p.lag") == 0, F.col("y")).otherwise(0.0).alias("y"),
        *[(F.col("y") * F.get("_p.w", F.lit(k))).alias(f"_h{k}") for k in range(at)], *["_from"] * compiled.segmented,
    )
    if compiled.segmented:  # a kernel doesn't reach into the next trial
        dealt = dealt.join(compiled.rows.select("session", "row_id", F.col("trial").alias("_from")), ["session", "row_id", "_from"])
    sums = dealt.groupBy("session", "unit_id", "row_id").agg(F.sum("y").alias("y"), *[F.sum(f"_h{k}").alias(f"_h{k}") for k in range(at)])
    return sums.select("session", "unit_id", "row_id", "y", F.array(*[f"_h{k}" for k in range(at)]).alias("h"))


def target_moments(rows: DataFrame, own: DataFrame, packing: CoMoments, by: Sequence[str] = ("trial",)) -> DataFrame:
    """(session, unit_id, by, packed co-moments) over the rows of :func:`own_rows`; the others add nothing and are never met."""
    keys = ["session", "unit_id", *by]
    kinds = dict(rows.dtypes) | dict(own.dtypes)
    met = rows.where("fit").select("session", "row_id", *by, "x").join(own.select("session", "unit_id", "row_id", "y", "h"), ["session", "row_id"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x")) if packing.p else np.zeros((batch.num_rows, 0))
                h = matrix(batch.column("h")) if packing.k else np.zeros((batch.num_rows, 0))
                y, (label, columns) = np.column_stack([h, batch.column("y").to_numpy()]), _labels(batch, keys)
                yield pa.RecordBatch.from_arrays([*columns, lists(np.array([packing.of(x[at], y[at]) for at in _members(label, len(columns[0]))]))], names=[*keys, "sums"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", sums array<double>"
    parts = met.select(*keys, "x", "y", "h").mapInArrow(partial, schema)

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({k: table.column(k)[:1] for k in keys} | {"sums": lists(packing.merged(matrix(table.column("sums")))[None, :])})

    return dealt(parts, *keys).groupBy(*keys).applyInArrow(merge, schema)
