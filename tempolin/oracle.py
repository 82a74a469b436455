"""DuckDB SQL for the queries of :mod:`tempolin.queries`, written from their definitions."""

from __future__ import annotations

_DT, _DAY, _HALF, _N = "3600e0", "86400e0", "1800e0", 720

_EV = """ev as (select user_id // 30 as session, user_id % 4 as unit_id, event_type as source, event_id as sample_ix,
    (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as time, value from events)"""
_SESSION = f"""sess as (select user_id // 30 as session, cast(max(floor((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 / {_DAY})) as bigint) + 1 as days from events group by 1)"""
_GRID = f"{_SESSION}, grid as (select session, cast(r as bigint) as row_id, r * {_DT} as bin_start, cast(r // 24 as bigint) as trial from sess, unnest(range(days * 24)) t(r))"
_DAYS = f"""trials as (select session, cast(t as bigint) as trial, t * {_DAY} as start, (t + 1) * {_DAY} as stop, 1e0 - 2e0 * ((t // 5) % 2) as context,
    0.25e0 * ((t * 7) % 11) as load, cast(t // 5 as bigint) as cv_group, t % 7 <> 3 as included from sess, unnest(range(days)) r(t))"""
_TRIALS = f"{_SESSION}, {_DAYS}"
_STIM = f"""{_EV}, {_TRIALS}, stims as (select session, cast(floor(time / {_DAY}) as bigint) as trial, min(time) as stim from ev
    where source = 'purchase' and time < floor(time / {_DAY}) * 86400.0 + 80000.0 group by all),
  strials as (select t.*, coalesce(s.stim, t.start + 43200.0) as stim from trials t left join stims s using (session, trial))"""
_SNAP = lambda x: f"(case when abs({x} - round_even({x}, 0)) <= 1e-9 then round_even({x}, 0) else {x} end)"
_ALIGNED = f"""{_STIM}, ended as (select *, coalesce(lead(start) over (partition by session order by trial), stop) as fin from strials),
  counted as (select *, cast(ceil({_SNAP(f'((start - stim) / {_DT})')}) as bigint) as a, cast(floor({_SNAP(f'((fin - stim) / {_DT})')}) as bigint) as z from ended),
  placed as (select *, coalesce(sum(z - a) over (partition by session order by trial rows between unbounded preceding and 1 preceding), 0) as o from counted),
  aligned as (select session, cast(o + k as bigint) as row_id, trial, stim + (a + k) * {_DT} as bin_start from placed, unnest(range(0, z - a)) u(k))"""
_ASOF = f"(select e.*, a.row_id, a.trial from {{ev}} e asof join aligned a on e.session = a.session and e.time >= a.bin_start where e.time < a.bin_start + {_DT})"
_R = lambda x, d=8: f"round({x}, {d})"


def _bins(where: str = "true") -> str:
    return f"select *, cast(floor(time / {_DT}) as bigint) as row_id from ev where floor(time / {_DT}) between 0 and {_N - 1} and ({where})"


def _means(where: str = "true") -> str:
    """Bin means on the regular grid, 0 where a bin is empty."""
    return f"""binned as (select session, source, row_id, avg(value) as value from ({_bins(where)}) group by all),
    pairs as (select distinct session, source from ev where {where}),
    means as (select g.session, p.source, g.row_id, coalesce(b.value, 0e0) as value from grid g join pairs p using (session) left join binned b using (session, source, row_id))"""


_HOURLY = f"""hourly as (select g.session, p.source, g.row_id as sample_ix, b.value from grid g cross join (select distinct source from ev where source <> 'error') p
    left join (select session, source, row_id, avg(value) as value from ({_bins("source <> 'error'")}) group by all) b using (session, source, row_id))"""

# columns of the designs on the regular grid
_SERIES = f"""counts as (select session, row_id, count(*) filter (source = 'purchase') as purchase, count(*) filter (source = 'signup') as signup from ({_bins()}) group by all),
  signal as (select g.session, g.row_id, coalesce(b.value, 0e0) as raw from grid g left join (select session, row_id, avg(value) as value from ({_bins("source = 'click'")}) group by all) b using (session, row_id)),
  series as materialized (select g.session, g.row_id, g.trial, cast(coalesce(c.purchase, 0) as double) as purchase, cast(coalesce(c.signup, 0) as double) as signup, s.raw as click,
    (s.raw - avg(s.raw) over (partition by g.session)) / stddev_pop(s.raw) over (partition by g.session) as zclick
    from grid g left join counts c using (session, row_id) join signal s using (session, row_id))"""


def _lagged(column: str, weights: dict[int, str], partition: str) -> str:
    """Sum of weights times the values so many bins earlier, 0 where there are none."""
    return " + ".join(f"{w} * {'lag' if k >= 0 else 'lead'}({column}, {abs(k)}, 0.0) over (partition by {partition} order by row_id)" for k, w in weights.items())


def _design(partition: str) -> str:
    # two raised cosines over the lags 0, 1, 2: centres at 0 and 2, each half a wave of 4 bins to either side
    bump = lambda centre: {k: f"(0.5 + 0.5 * cos(pi() * {k - centre} / 4))" for k in (0, 1, 2)}
    columns = [_lagged("purchase", bump(0), partition), _lagged("purchase", bump(2), partition), _lagged("zclick", {-1: "1.0", 0: "1.0", 1: "1.0"}, partition)]
    return ", ".join(f"{_R(c)} as x{k}" for k, c in enumerate(columns))


def _wide_design() -> str:
    """Nine raised cosines over twelve lags, centres 11/8 apart, each half a wave of two spacings to either side."""
    bump = lambda first, j: {first + k: f"(0.5 + 0.5 * cos(pi() * {k - 11 * j / 8!r} / 2.75))" for k in range(12) if abs(k - 11 * j / 8) < 2.75}
    columns = [_lagged(column, bump(first, j), "session") for column, first in (("purchase", 0), ("zclick", -6)) for j in range(9)]
    return f"with {_EV}, {_GRID}, {_SERIES} select session, row_id, " + ", ".join(f"{_R(c)} as x{k}" for k, c in enumerate(columns)) + " from series"


_TARGET = f"""y_ as (select session, unit_id, row_id, cast(count(*) as double) as y from ({_bins("source = 'purchase'")}) group by all),
  units as (select distinct session, unit_id from y_),
  xs as materialized (select session, row_id, trial, signup + lag(signup, 1, 0.0) over (partition by session order by row_id) as x0, click as x1 from series),
  rows_ as materialized (select x.session, u.unit_id, x.row_id, x.trial, x.x0, x.x1, coalesce(y.y, 0.0) as y from xs x join units u using (session) left join y_ y using (session, unit_id, row_id))"""
_DATA = f"{_EV}, {_GRID}, {_SERIES}, {_TARGET}"
_SUMS = "count(*) as n, sum(x0) as s0, sum(x1) as s1, sum(x0 * x0) as s00, sum(x0 * x1) as s01, sum(x1 * x1) as s11, sum(y) as sy, sum(x0 * y) as s0y, sum(x1 * y) as s1y, sum(y * y) as syy"


def _ridge(source: str, keys: str, alpha: float = 2.0, second: bool = True) -> str:
    """Two-column ridge with a free intercept, by Cramer's rule; without the second column b1 is 0."""
    a00, a01, a11 = f"(s00 - s0 * s0 / n + {alpha})", "(s01 - s0 * s1 / n)", f"(s11 - s1 * s1 / n + {alpha})"
    t0, t1 = "(s0y - s0 * sy / n)", "(s1y - s1 * sy / n)"
    if second:
        b0, b1 = f"({t0} * {a11} - {t1} * {a01}) / ({a00} * {a11} - {a01} * {a01})", f"({t1} * {a00} - {t0} * {a01}) / ({a00} * {a11} - {a01} * {a01})"
    else:
        b0, b1 = f"{t0} / {a00}", "0.0"
    return f"select {keys}, b0, b1, (sy - b0 * s0 - b1 * s1) / n as b from (select *, {b0} as b0, {b1} as b1 from {source})"


_SSE = "sum((y - b - b0 * x0 - b1 * x1) * (y - b - b0 * x0 - b1 * x1))"
_TSS = "(sum(y * y) - sum(y) * sum(y) / count(*))"
_FIT = f"{_DATA}, sums as (select session, unit_id, {_SUMS} from rows_ group by all), fits as materialized ({_ridge('sums', 'session, unit_id')})"


def _cross_validation() -> str:
    fold = "trial // 5"
    return f"""with {_DATA}, per as materialized (select session, unit_id, {fold} as g, {_SUMS} from rows_ group by all),
      train as (select t.session, t.unit_id, t.g, {', '.join(f'sum(o.{c}) as {c}' for c in ('n', 's0', 's1', 's00', 's01', 's11', 'sy', 's0y', 's1y', 'syy'))}
        from per t join per o on t.session = o.session and t.unit_id = o.unit_id and t.g <> o.g group by all),
      full_ as materialized ({_ridge('train', 'session, unit_id, g')}), less as materialized ({_ridge('train', 'session, unit_id, g', second=False)}),
      scores as (select r.session, r.unit_id, r.trial // 5 as g, {_TSS} as tss, sum(pow(y - f.b - f.b0 * x0 - f.b1 * x1, 2)) as e1, sum(pow(y - l.b - l.b0 * x0, 2)) as e0
        from rows_ r join full_ f on f.session = r.session and f.unit_id = r.unit_id and f.g = r.trial // 5 join less l on l.session = r.session and l.unit_id = r.unit_id and l.g = r.trial // 5 group by all),
      total as (select session, unit_id, {_TSS} as tss from rows_ group by all)
      select session, unit_id, {_R('avg(case when s.tss > 1e-9 then 1 - e1 / s.tss end)')} as cv_r2, {_R('1 - sum(e1) / any_value(t.tss)')} as cv_r2_pooled,
        {_R('avg(case when s.tss > 1e-9 then (e0 - e1) / s.tss end)')} as delta_r2, {_R('(sum(e0) - sum(e1)) / any_value(t.tss)')} as delta_r2_pooled
      from scores s join total t using (session, unit_id) group by all"""


def _alternating(select: str, data: str = _DATA, lags: int = 2) -> str:
    """Eight rounds of kernel and gain ridge in a recursive query, on sums by (session, unit, context).

    The kernel with gains, x0's, covers ``lags`` lags with one constant, so at length 1 its weight is
    1 / sqrt(lags) up to sign.
    """
    ka, ga = "2e0", "5e-1"
    return f"""with recursive {data}, ctx as (select *, 1e0 - 2e0 * ((trial // 5) % 2) as v from rows_),
      per as materialized (select session, unit_id, v, {_SUMS} from ctx group by all),
      als as (
        select session, unit_id, 0 as k, 0e0 as b, 0e0 as b0, 0e0 as b1, 1e0 as o, 0e0 as c from units
        union all
        select session, unit_id, k + 1, b, u, b1, (h11 * q0 - h01 * q1) / (h00 * h11 - h01 * h01), (h00 * q1 - h01 * q0) / (h00 * h11 - h01 * h01) from (
          select session, unit_id, k, b, u, b1, sum(u * u * s00) + {ga} as h00, sum(v * u * u * s00) as h01, sum(v * v * u * u * s00) + {ga} as h11,
            sum(u * (s0y - b * s0 - b1 * s01)) as q0, sum(v * u * (s0y - b * s0 - b1 * s01)) as q1
          from (
            select p.*, f.k, sign(f.nb0) / sqrt({lags}e0) as u, f.b1, (f.y_sum - f.nb0 * f.w0 - f.b1 * f.w1) / f.m as b from per p join (
              select *, (t0 * a11 - t1 * a01) / (a00 * a11 - a01 * a01) as nb0, (t1 * a00 - t0 * a01) / (a00 * a11 - a01 * a01) as b1 from (
                select session, unit_id, k, m, w0, w1, y_sum, w00 - w0 * w0 / m + {ka} as a00, w01 - w0 * w1 / m as a01, w11 - w1 * w1 / m + {ka} as a11,
                  w0y - w0 * y_sum / m as t0, w1y - w1 * y_sum / m as t1 from (
                  select a.session, a.unit_id, a.k, sum(n) as m, sum((o + c * v) * s0) as w0, sum(s1) as w1, sum((o + c * v) * (o + c * v) * s00) as w00, sum((o + c * v) * s01) as w01,
                    sum(s11) as w11, sum(sy) as y_sum, sum((o + c * v) * s0y) as w0y, sum(s1y) as w1y
                  from als a join per p on a.session = p.session and a.unit_id = p.unit_id where a.k < 8 group by a.session, a.unit_id, a.k)))
              f on f.session = p.session and f.unit_id = p.unit_id)
          group by session, unit_id, k, b, u, b1))
      {select}"""


_ALS_ROW = f"""select a.session, a.unit_id, {_R('a.b')} as intercept, {_R('a.b0')} as beta0, {_R('a.b1')} as beta1, {_R('a.o')} as "offset", {_R('a.c')} as coefficient,
  {_R('1 - sum(pow(y - a.b - (a.o + a.c * r.v) * a.b0 * x0 - a.b1 * x1, 2)) / ' + _TSS)} as train_r2
  from als a join ctx r on r.session = a.session and r.unit_id = a.unit_id where a.k = 8 group by a.session, a.unit_id, a.b, a.b0, a.b1, a.o, a.c"""


def _smoothed() -> str:
    """A Gaussian of two bins out to four deviations, normalised."""
    return f"""with {_EV}, {_GRID}, c as (select session, row_id, count(*) as n from ({_bins("source = 'click'")}) group by all),
      k as (select o, exp(-0.5 * pow(o / 2.0, 2)) / sum(exp(-0.5 * pow(o / 2.0, 2))) over () as w from range(-8, 9) t(o))
      select g.session, g.row_id, {_R('coalesce(sum(c.n * k.w), 0.0)')} as per_bin from grid g cross join k
      left join c on c.session = g.session and c.row_id = g.row_id - k.o group by all"""


def _outliers() -> str:
    steps, last = [], "(select session, source, sample_ix, value as v from ev)"
    for k in range(5):
        steps.append(f"m{k} as materialized (select session, source, median(v) as m, stddev_pop(v) as s from {last} group by all)")
        steps.append(f"d{k} as materialized (select session, source, median(abs(v - m)) as d from {last} join m{k} using (session, source) group by all)")
        steps.append(
            f"""v{k} as materialized (select session, source, sample_ix, case when scale >= 1e-12 and abs(v - m) / scale > 3.0 then null else v end as v from (
              select x.*, m, case when d >= 1e-12 then 1.4826 * d else s end as scale from {last} x join m{k} using (session, source) join d{k} using (session, source)))"""
        )
        last = f"v{k}"
    return f"with {_EV}, {', '.join(steps)} select session, source, sample_ix, v is null as outlier from v4"


_EDGE = f"""{_TRIALS}, t2 as (select *, row_number() over (partition by session order by trial) as i, count(*) over (partition by session) as n,
    first_value(context) over (partition by session order by trial) as a, first_value(context) over (partition by session order by trial desc) as z from trials where trial >= 1 and trial < 28),
  runs as (select session, any_value(n) as n, min(i - 1) filter (abs(context - a) > 1e-6) as f, min(n - i) filter (abs(context - z) > 1e-6) as l from t2 group by session),
  shifts as (select session, n, unnest(list_concat(range(0, f // 2 + 1), range(-(l // 2), 0))) as shift, unnest(range(0, f // 2 + 1 + l // 2)) as ordinal from runs)"""
_SHIFTED = f"""{_EDGE}, reach as (select session, greatest(max(shift), 0) as up, least(min(shift), 0) as down from shifts group by session),
  shifted as (select t.session, t.trial, s.shift, u.context as shifted, t.i - 1 >= r.up and t.i - 1 < t.n + r.down as valid
    from t2 t join shifts s using (session) join reach r using (session) join t2 u on u.session = t.session and u.i - 1 = ((t.i - 1 - s.shift) % t.n + t.n) % t.n)"""

_INTERP = f"""with {_EV}, {_GRID}, s as (select session, source, time, value from ev where source in ('click', 'view')), p as (select distinct session, source from s),
  c as (select g.session, p.source, g.row_id, g.bin_start + {_HALF} as t from grid g join p using (session)),
  a as (select c.*, s.time as t0, s.value as v0 from c asof left join s on c.session = s.session and c.source = s.source and c.t >= s.time),
  b as (select a.*, s.time as t1, s.value as v1 from a asof left join s on a.session = s.session and a.source = s.source and a.t <= s.time)
  select session, source, row_id, {_R('case when t0 is null then v1 when t1 is null or t0 = t or t1 <= t0 then v0 else (v1 - v0) / (t1 - t0) * (t - t0) + v0 end')} as value from b"""

_GAPS = f"""with {_EV}, {_GRID}, {_HOURLY},
  f as (select *, last_value(case when value is not null then sample_ix end ignore nulls) over (w rows between unbounded preceding and current row) as i0,
      last_value(value ignore nulls) over (w rows between unbounded preceding and current row) as v0,
      first_value(case when value is not null then sample_ix end ignore nulls) over (w rows between current row and unbounded following) as i1,
      first_value(value ignore nulls) over (w rows between current row and unbounded following) as v1 from hourly window w as (partition by session, source order by sample_ix))
  select session, source, sample_ix, {_R('case when value is not null then value when v0 is null then v1 when v1 is null then v0 else (v1 - v0) / (i1 - i0) * (sample_ix - i0) + v0 end')} as value from f"""

_POSE = """with pose as (select distinct l_suppkey // 20 as session, l_orderkey * 8 + l_linenumber as frame_ix, l_quantity as x, l_extendedprice as y, 1.0 - l_discount / 4 as likelihood, l_tax as jitter from lineitem),
  lim as (select session, avg(jitter) + 3.0 * stddev_pop(jitter) as most from pose group by session),
  fr as (select distinct session, frame_ix from pose)
  select session, count(*) as n, round(sum(sqrt(x * x + y * y)), 3) as total, max(frame_ix) as last from pose join lim using (session) join fr using (session, frame_ix)
  where likelihood > 0.98 and jitter <= most group by session"""

_PARTS = """units as (select p_partkey // 400 as session, p_partkey as unit_id, p_size > 25 as default_qc,
  case when p_partkey % 11 = 0 then 'noise' when p_partkey % 13 <> 0 then 'sua' end as decoder_label,
  case when p_partkey % 17 <> 0 then p_size / 50 end as amplitude_cutoff, p_partkey % 100 / 100 as presence_ratio from part)"""
_QC = f"{_PARTS}, ok as (select session, unit_id from units where default_qc and decoder_label <> 'noise')"

_MOMENT_COLUMNS = ", ".join(f"{_R(v, 7)} as {n}" for v, n in (("sum(x0)", "sx0"), ("sum(x1)", "sx1"), ("sum(x0 * x0)", "sx00"), ("sum(x0 * x1)", "sx01"), ("sum(x1 * x1)", "sx11")))
_MOMENTS = f"""select session, unit_id, trial, cast(count(*) as double) as n, {_MOMENT_COLUMNS}, sum(y) as sy, {_R('sum(x0 * y)', 7)} as sxy0, {_R('sum(x1 * y)', 7)} as sxy1, sum(y * y) as syy
  from rows_ group by all"""

def _sse_of(b: str = "b", b0: str = "b0", b1: str = "b1") -> str:
    """Squared error of a two-column fit from sums."""
    return f"""(syy - 2 * {b} * sy - 2 * {b0} * s0y - 2 * {b1} * s1y + n * {b} * {b} + 2 * {b} * {b0} * s0 + 2 * {b} * {b1} * s1
      + {b0} * {b0} * s00 + 2 * {b0} * {b1} * s01 + {b1} * {b1} * s11)"""


def _baseline_shifts() -> str:
    names = ("n", "s0", "s1", "s00", "s01", "s11", "sy", "s0y", "s1y", "syy")
    return f"""with {_DATA}, per as (select session, unit_id, trial, count(*) as n, sum(x0) as s0, sum(x0 * x0) as s00, sum(y) as sy, sum(x0 * y) as s0y, sum(y * y) as syy from rows_ group by all),
      moved as (select p.*, k.s, 1e0 - 2e0 * ((((trial - k.s + 30) % 30) // 5) % 2) as v from per p, (values (0), (1), (2), (-2), (-1)) k(s) where trial between 2 and 27),
      g as materialized (select session, unit_id, s, trial // 5 as g, sum(n) as n, sum(s0) as s0, sum(v * n) as s1, sum(s00) as s00, sum(v * s0) as s01, sum(v * v * n) as s11, sum(sy) as sy,
        sum(s0y) as s0y, sum(v * sy) as s1y, sum(syy) as syy from moved group by all),
      train as (select t.session, t.unit_id, t.s, t.g, {', '.join(f'sum(o.{c}) as {c}' for c in names)} from g t join g o
        on t.session = o.session and t.unit_id = o.unit_id and t.s = o.s and t.g <> o.g group by all),
      full_ as materialized ({_ridge('train', 'session, unit_id, s, g')}), less as materialized ({_ridge('train', 'session, unit_id, s, g', second=False)}),
      e as (select session, unit_id, s, sum({_sse_of()}) as e1 from g join full_ using (session, unit_id, s, g) group by all),
      e0 as (select session, unit_id, sum({_sse_of()}) as e0, sum(syy) - sum(sy) * sum(sy) / sum(n) as tss from g join less using (session, unit_id, s, g) where s = 0 group by all),
      d as (select session, unit_id, s, (e0 - e1) / tss as d, 1 - e0 / tss as reduced from e join e0 using (session, unit_id)),
      o as (select session, unit_id, d as observed, reduced from d where s = 0)
      select session, unit_id, {_R('avg(cast(d.d >= o.observed as int))')} as p_value, {_R('any_value(o.observed)')} as observed, {_R('any_value(o.reduced)')} as reduced
      from d join o using (session, unit_id) group by session, unit_id"""


def _history() -> str:
    sums = _SUMS.replace("x1", "h")
    past = " + ".join(f"lag(y, {k}, 0.0) over (partition by session, unit_id order by row_id)" for k in (1, 2, 3))
    error = "pow(y - b - b0 * x0 - b1 * h, 2)"
    return f"""with {_DATA}, r as materialized (select *, {past} as h from rows_), folds as (select unnest(range(6)) as g),
      sums as (select session, unit_id, {sums} from r group by all), all_ as ({_ridge('sums', 'session, unit_id')}),
      train as (select session, unit_id, g, {sums} from r, folds where row_id >= 3 and row_id // 120 <> g and (row_id - 3) // 120 <> g group by all), fits as ({_ridge('train', 'session, unit_id, g')}),
      test as (select r.*, g, b, b0, b1 from r join fits f using (session, unit_id) where row_id >= 3 and row_id // 120 = g and (row_id - 3) // 120 = g),
      scores as (select session, unit_id, g, sum({error}) as e, {_TSS} as tss from test group by all),
      pooled as (select session, unit_id, 1 - sum({error}) / {_TSS} as p from test group by all),
      own as (select session, unit_id, 1 - sum({error}) / {_TSS} as t from r join all_ using (session, unit_id) group by all)
      select session, unit_id, {_R('any_value(t)')} as train_r2, {_R('avg(case when tss > 1e-9 then 1 - e / tss end)')} as cv_r2, {_R('any_value(p)')} as cv_r2_pooled
      from scores join pooled using (session, unit_id) join own using (session, unit_id) group by session, unit_id"""


_PAST = " + ".join(f"lag(y, {k}, 0.0) over (partition by session, unit_id order by row_id)" for k in (1, 2, 3))
_HISTORY_PREDICTIONS = f"""with {_DATA}, r as materialized (select *, {_PAST} as h from rows_), sums as (select session, unit_id, {_SUMS.replace('x1', 'h')} from r group by all),
  fits as ({_ridge('sums', 'session, unit_id')}) select session, unit_id, row_id, {_R('b + b0 * x0 + b1 * h')} as prediction from r join fits using (session, unit_id)"""

_MASKED = f"""with {_DATA}, sums as (select session, unit_id, {_SUMS} from rows_ where row_id % 3 <> 1 group by all), fits as materialized ({_ridge('sums', 'session, unit_id')})
  select f.session, f.unit_id, {_R('b')} as intercept, {_R('b0')} as beta0, {_R('b1')} as beta1, {_R(f'1 - {_SSE} / {_TSS}')} as train_r2
  from fits f join rows_ r using (session, unit_id) where row_id % 3 <> 1 group by f.session, f.unit_id, b, b0, b1"""

_GAINS_AGAIN = f"""select session, unit_id, {_R('(h11 * q0 - h01 * q1) / (h00 * h11 - h01 * h01)')} as "offset", {_R('(h00 * q1 - h01 * q0) / (h00 * h11 - h01 * h01)')} as coefficient from (
    select a.session, a.unit_id, sum(b0 * b0 * s00) + 3e0 as h00, sum(v * b0 * b0 * s00) as h01, sum(v * v * b0 * b0 * s00) + 3e0 as h11,
      sum(b0 * (s0y - b * s0 - b1 * s01)) as q0, sum(v * b0 * (s0y - b * s0 - b1 * s01)) as q1
    from als a join per p on a.session = p.session and a.unit_id = p.unit_id where a.k = 8 group by a.session, a.unit_id)"""

_WEIGHTED = """(select a.session, a.unit_id, sum(n) as n, sum((o + c * v) * s0) as s0, sum(s1) as s1, sum((o + c * v) * (o + c * v) * s00) as s00,
    sum((o + c * v) * s01) as s01, sum(s11) as s11, sum(sy) as sy, sum((o + c * v) * s0y) as s0y, sum(s1y) as s1y
  from als a join per p on a.session = p.session and a.unit_id = p.unit_id where a.k = 8 group by a.session, a.unit_id)"""
_KERNELS_AGAIN = f"select session, unit_id, {_R('b')} as intercept, {_R('b0')} as beta0, {_R('b1')} as beta1 from ({_ridge(_WEIGHTED, 'session, unit_id', alpha=7.0)})"

# x0 is the target's own past over three lags, x1 the event's column
_PAST_DATA = _DATA.replace("rows_ as materialized", "plain_ as materialized") + f""", rows_ as materialized (select session, unit_id, row_id, trial, x0 as x1, y, {_PAST} as x0 from plain_)"""
_SEGMENTED_HISTORY = f"""with {_DATA.replace("rows_ as materialized", "plain_ as materialized")},
  rows_ as materialized (select session, unit_id, row_id, trial, x1, y, {_PAST.replace('partition by session, unit_id', 'partition by session, unit_id, trial')} as x0 from plain_),
  sums as (select session, unit_id, {_SUMS} from rows_ group by all), fits as materialized ({_ridge('sums', 'session, unit_id')})
  select f.session, f.unit_id, {_R('b')} as intercept, {_R('b0')} as beta0, {_R('b1')} as beta1, {_R(f'1 - {_SSE} / {_TSS}')} as train_r2
  from fits f join rows_ r using (session, unit_id) group by f.session, f.unit_id, b, b0, b1"""


def _offset_scores() -> str:
    """What a constant added to the target leaves as it is."""
    inner = _cross_validation().replace("delta_r2", "dropped")
    return f"""with cv as ({inner}), train as (with {_FIT} select f.session, f.unit_id, {_R('b0')} as beta0, {_R(f'1 - {_SSE} / {_TSS}')} as train_r2
        from fits f join rows_ r using (session, unit_id) group by f.session, f.unit_id, b, b0, b1)
      select session, unit_id, beta0, train_r2, cv_r2, cv_r2_pooled from cv join train using (session, unit_id)"""



def _lasso(source: str, keys: str) -> str:
    """Two-column lasso with a free intercept and penalty ``alpha``, a column: the best of the nine patterns of signs."""
    a00, a01, a11 = "(s00 - s0 * s0 / n)", "(s01 - s0 * s1 / n)", "(s11 - s1 * s1 / n)"
    t0, t1 = "(s0y - s0 * sy / n)", "(s1y - s1 * sy / n)"
    return f"""select {keys}, b0, b1, (sy - b0 * s0 - b1 * s1) / n as b from (
        select *, case when p = 0 then 0e0 when q = 0 then (t0 - n * alpha * p) / a00 else ((t0 - n * alpha * p) * a11 - (t1 - n * alpha * q) * a01) / (a00 * a11 - a01 * a01) end as b0,
          case when q = 0 then 0e0 when p = 0 then (t1 - n * alpha * q) / a11 else ((t1 - n * alpha * q) * a00 - (t0 - n * alpha * p) * a01) / (a00 * a11 - a01 * a01) end as b1
        from (select *, {a00} as a00, {a01} as a01, {a11} as a11, {t0} as t0, {t1} as t1 from {source}, unnest([-1, 0, 1]) u(p), unnest([-1, 0, 1]) w(q))) where sign(b0) = p and sign(b1) = q
      qualify row_number() over (partition by {keys} order by (b0 * b0 * a00 + 2 * b0 * b1 * a01 + b1 * b1 * a11 - 2 * b0 * t0 - 2 * b1 * t1) / (2 * n) + alpha * (abs(b0) + abs(b1))) = 1"""


def _penalty_errors() -> str:
    """Inner folds deal equal trials out from the last one on; a lasso of two columns is the best of its nine patterns of signs."""
    sums = ("n", "s0", "s1", "s00", "s01", "s11", "sy", "s0y", "s1y", "syy")
    a00, a01, a11 = "(s00 - s0 * s0 / n)", "(s01 - s0 * s1 / n)", "(s11 - s1 * s1 / n)"
    t0, t1 = "(s0y - s0 * sy / n)", "(s1y - s1 * sy / n)"
    return f"""with {_DATA}, per as materialized (select session, unit_id, (29 - trial) % 5 as g, {_SUMS} from rows_ group by all),
      train as materialized (select t.session, t.unit_id, t.g, {', '.join(f'sum(o.{c}) as {c}' for c in sums)} from per t join per o on t.session = o.session and t.unit_id = o.unit_id and t.g <> o.g group by all),
      penal as (select 'ridge' as regularizer, unnest([1e-1, 1e1, 1e3]) as alpha union all select 'lasso', unnest([1e-3, 1e-2, 1e-1])),
      ridge as (select session, unit_id, g, alpha, ({t0} * ({a11} + alpha) - {t1} * {a01}) / (({a00} + alpha) * ({a11} + alpha) - {a01} * {a01}) as b0,
        ({t1} * ({a00} + alpha) - {t0} * {a01}) / (({a00} + alpha) * ({a11} + alpha) - {a01} * {a01}) as b1 from train, penal where regularizer = 'ridge'),
      lasso as (select session, unit_id, g, alpha, b0, b1 from ({_lasso("(select * from train, penal where regularizer = 'lasso')", 'session, unit_id, g, alpha')})),
      fits as (select 'ridge' as regularizer, * from ridge union all select 'lasso', * from lasso),
      scored as (select regularizer, session, unit_id, alpha, g, {_sse_of('b')} / n as e from (select f.regularizer, f.alpha, f.b0, f.b1, (t.sy - f.b0 * t.s0 - f.b1 * t.s1) / t.n as b, p.*
        from fits f join train t using (session, unit_id, g) join per p using (session, unit_id, g))),
      means as (select regularizer, session, unit_id, alpha, avg(e) as error from scored group by all)
      select regularizer, session, unit_id, alpha, {_R('error')} as error, row_number() over (partition by regularizer, session, unit_id order by error, alpha) = 1 as chosen from means"""


def _gains_dropout() -> str:
    """The alternation on each fold's other trials, with a fold's copy of a unit as a unit of its own."""
    data = _DATA.replace("rows_ as materialized", "all_ as materialized").replace("units as (", "units0 as (").replace("join units u", "join units0 u") + """,
      rows_ as materialized (select session, unit_id * 100 + g as unit_id, row_id, trial, x0, x1, y from all_, unnest(range(6)) f(g) where trial // 5 <> g),
      units as (select distinct session, unit_id from rows_)"""
    tail = f"""select session, unit_id // 100 as unit_id, {_R('1 - sum(e1) / any_value(tss)')} as cv_r2_pooled, {_R('(sum(e0) - sum(e1)) / any_value(tss)')} as delta_r2_pooled
      from (select a.session, a.unit_id, sum(pow(r.y - a.b - (a.o + a.c * (1e0 - 2e0 * ((r.trial // 5) % 2))) * a.b0 * r.x0 - a.b1 * r.x1, 2)) as e1, sum(pow(r.y - a.b - less.o * a.b0 * r.x0 - a.b1 * r.x1, 2)) as e0
          from als a join (select a.session, a.unit_id, sum(a.b0 * (s0y - a.b * s0 - a.b1 * s01)) / (sum(a.b0 * a.b0 * s00) + 5e-1) as o
              from als a join per p on a.session = p.session and a.unit_id = p.unit_id where a.k = 8 group by a.session, a.unit_id) less on less.session = a.session and less.unit_id = a.unit_id
          join all_ r on r.session = a.session and r.unit_id = a.unit_id // 100 and r.trial // 5 = a.unit_id % 100 where a.k = 8 group by a.session, a.unit_id)
      join (select session, unit_id as own, {_TSS} as tss from all_ group by all) t using (session) where own = unit_id // 100 group by session, unit_id // 100"""
    return _alternating(tail, data)


def _gain_shifts() -> str:
    """Kernels of the model without the gain on trials 2 to 27; at each shift both gain entries solved again with them."""
    sums = ("n", "s0", "s1", "s00", "s01", "s11", "sy", "s0y", "s1y", "syy")
    error = lambda gain: f"""(syy - 2 * b * sy - 2 * {gain} * u * s0y - 2 * b1 * s1y + n * b * b + 2 * b * {gain} * u * s0 + 2 * b * b1 * s1
      + {gain} * {gain} * u * u * s00 + 2 * {gain} * u * b1 * s01 + b1 * b1 * s11)"""  # noqa: E731
    return f"""with {_DATA}, per as materialized (select session, unit_id, trial, trial // 5 as g, {_SUMS} from rows_ where trial between 2 and 27 group by all),
      fold as (select session, unit_id, g, {', '.join(f'sum({c}) as {c}' for c in sums)} from per group by all),
      train as (select t.session, t.unit_id, t.g, {', '.join(f'sum(o.{c}) as {c}' for c in sums)} from fold t join fold o on t.session = o.session and t.unit_id = o.unit_id and t.g <> o.g group by all),
      solved as ({_ridge('train', 'session, unit_id, g')}),
      kernel as materialized (select session, unit_id, g, sign(b0) / sqrt(2e0) as u, b1, b from solved),
      shifts as (select unnest([0, 1, 2, -2, -1]) as s),
      moved as materialized (select p.*, s, 1e0 - 2e0 * ((((p.trial - s + 30) % 30) // 5) % 2) as v from per p, shifts),
      system as (select m.session, m.unit_id, k.g, m.s, any_value(k.u) as u, any_value(k.b) as b, any_value(k.b1) as b1, sum(u * u * s00) + 5e-1 as h00, sum(v * u * u * s00) as h01, sum(v * v * u * u * s00) + 5e-1 as h11,
          sum(u * (s0y - b * s0 - b1 * s01)) as q0, sum(v * u * (s0y - b * s0 - b1 * s01)) as q1
        from moved m join kernel k on k.session = m.session and k.unit_id = m.unit_id and k.g <> m.g group by m.session, m.unit_id, k.g, m.s),
      gain as (select *, (h11 * q0 - h01 * q1) / (h00 * h11 - h01 * h01) as o, (h00 * q1 - h01 * q0) / (h00 * h11 - h01 * h01) as c, q0 / h00 as alone from system),
      e as (select m.session, m.unit_id, m.s, sum({error('(o + c * v)')}) as e1, sum({error('alone')}) as e0, sum(syy) - sum(sy) * sum(sy) / sum(n) as tss
        from moved m join gain k on k.session = m.session and k.unit_id = m.unit_id and k.g = m.g and k.s = m.s group by all),
      d as (select session, unit_id, s, (e0 - e1) / tss as d from e), o as (select session, unit_id, d as observed from d where s = 0)
      select session, unit_id, {_R('avg(cast(d >= observed as int))')} as p_value, {_R('any_value(observed)')} as observed, cast(count(*) as double) as n_shifts
      from d join o using (session, unit_id) group by session, unit_id"""


# a recording: the bins of trials, around their stimuli, with licks (clicks of included trials) and running speed (values of views)
_RECORDED = f"""{_ALIGNED}, licks as (select e.session, e.time from (select * from ev where source = 'click') e asof left join trials t on e.session = t.session and e.time >= t.start where coalesce(t.included, true)),
  lick as (select session, row_id, count(*) as n from {_ASOF.format(ev='licks')} group by all),
  speed as (select session, row_id, avg(value) as v from {_ASOF.format(ev="(select * from ev where source = 'view')")} group by all),
  near as (select a.session, a.row_id, a.row_id - (p.o - p.a) as k from aligned a join placed p using (session, trial) where p.included),
  series as materialized (select a.session, a.row_id, a.trial, cast(coalesce(l.n, 0) as double) as lick, coalesce(s.v, 0e0) as x1, coalesce(n.k >= -6 and n.k < 6, false) as fit
    from aligned a left join lick l using (session, row_id) left join speed s using (session, row_id) left join near n using (session, row_id)),
  xs as materialized (select session, row_id, trial, fit, lick + lag(lick, 1, 0e0) over (partition by session, trial order by row_id) as x0, x1 from series)"""


def _session_events() -> str:
    stimuli, outcomes = ("is_aud_target", "is_aud_nontarget", "is_vis_target", "is_vis_nontarget"), ("is_hit", "is_miss", "is_correct_reject", "is_false_alarm")
    flagged = [f"select session, '{s}' as source, stim as time from strials where included and trial % {m} = {k % m}" for m, names in ((4, stimuli), (3, outcomes)) for k, s in enumerate(names)]
    return f"""with {_RECORDED}, found as ({' union all '.join(flagged)} union all select session, 'licks', time from licks)
      select session, source, count(*) as n, {_R('min(time)')} as first, {_R('max(time)')} as last from found group by session, source"""


def _model_comparison() -> str:
    """Ridge on the rows to fit, with and without the second column, held out by runs of five days."""
    sums = ("n", "s0", "s1", "s00", "s01", "s11", "sy", "s0y", "s1y", "syy")
    parts = []
    for name, second in (("both", True), ("licks alone", False)):
        parts.append(f"""select '{name}' as model, session, unit_id, any_value(r) as train_r2, avg(case when tss > 1e-9 then 1 - e / tss end) as cv_r2,
            case when bool_and(tss > 1e-9) then min(case when tss > 1e-9 then 1 - e / tss end) else 'nan'::double end as worst_fold_r2, cast(count(*) as int) as n_cv_folds
          from (select t.session, t.unit_id, t.g, any_value(w.r) as r, sum(pow(y - f.b - f.b0 * x0 - f.b1 * x1, 2)) as e, {_TSS} as tss
            from rows_ t join ({_ridge('train', 'session, unit_id, g', second=second)}) f using (session, unit_id, g)
            join (select a.session, a.unit_id, 1 - sum(pow(y - b - b0 * x0 - b1 * x1, 2)) / {_TSS} as r from rows_ a join ({_ridge('whole', 'session, unit_id', second=second)}) using (session, unit_id) group by all) w using (session, unit_id)
            group by t.session, t.unit_id, t.g) group by session, unit_id""")
    return f"""with {_RECORDED}, y_ as (select session, unit_id, row_id, cast(count(*) as double) as y from {_ASOF.format(ev="(select * from ev where source = 'purchase')")} group by all),
      units as (select distinct session, unit_id from ev where source = 'purchase' qualify dense_rank() over (partition by session order by unit_id) <= 2),
      rows_ as materialized (select x.session, u.unit_id, x.trial // 5 as g, x.x0, x.x1, coalesce(y.y, 0e0) as y from xs x join units u using (session) left join y_ y using (session, unit_id, row_id) where x.fit),
      per as materialized (select session, unit_id, g, {_SUMS} from rows_ group by all), whole as (select session, unit_id, {', '.join(f'sum({c}) as {c}' for c in sums)} from per group by all),
      train as materialized (select t.session, t.unit_id, t.g, {', '.join(f'sum(o.{c}) as {c}' for c in sums)} from per t join per o on t.session = o.session and t.unit_id = o.unit_id and t.g <> o.g group by all),
      compared as ({' union all '.join(parts)})
      select model, session, unit_id, {_R('train_r2')} as train_r2, {_R('cv_r2')} as cv_r2, {_R('worst_fold_r2')} as worst_fold_r2, n_cv_folds from compared"""


ORACLE_SQL: dict[str, str] = {
    "session_design": f"with {_RECORDED} select session, row_id, trial, fit, {_R('x0')} as x0, {_R('x1')} as x1 from xs",
    "stimulus_mask": f"with {_RECORDED} select session, row_id from near where k >= -2 and k < 5",
    "session_events": _session_events(),
    "model_comparison": _model_comparison(),
    "written_results": f"""with {_FIT} select f.session, f.unit_id, 'plain' as model, {_DT} as dt, {_R(f'1 - {_SSE} / {_TSS}')} as train_r2, {_R('b')} as intercept, 1 as n_iter, true as converged
        from fits f join rows_ r using (session, unit_id) group by f.session, f.unit_id, b, b0, b1""",
    "wide_design": _wide_design(),
    "penalty_errors": _penalty_errors(),
    "gains_dropout": _gains_dropout(),
    "shift_test": _gain_shifts(),
    "history_predictions": _HISTORY_PREDICTIONS,
    "masked_fit": _MASKED,
    "refit_gains": _alternating(_GAINS_AGAIN),
    "refit_kernels": _alternating(_KERNELS_AGAIN),
    "lasso_refit": _alternating(f"select session, unit_id, {_R('b')} as intercept, {_R('b0')} as beta0, {_R('b1')} as beta1 from ({_lasso(f'(select *, 1e-2 as alpha from {_WEIGHTED})', 'session, unit_id')})"),
    "history_refit_gains": _alternating(_GAINS_AGAIN, _PAST_DATA, 3),
    "history_refit_kernels": _alternating(_KERNELS_AGAIN, _PAST_DATA, 3),
    "segmented_history": _SEGMENTED_HISTORY,
    "offset_scores": _offset_scores(),
    "time_bins": f"with {_GRID} select session, row_id, bin_start, bin_start + {_HALF} as center from grid",
    "event_histogram": f"""with {_EV}, {_GRID}, b as (select session, source, row_id, count(*) as c from ({_bins()}) group by all), p as (select distinct session, source from b)
        select g.session, p.source, g.row_id, cast(coalesce(b.c, 0) as double) as n from grid g join p using (session) left join b using (session, source, row_id)""",
    "smoothed_rate": _smoothed(),
    "trial_index": f"with {_GRID} select session, row_id, trial from grid",
    "trial_index_faults": f"""with {_TRIALS}, u as (select session, cast(floor((start + 4000.0 * (trial % 3)) / {_DT}) as bigint) as a, cast(floor((stop + 5000.0 * (trial % 2)) / {_DT}) as bigint) as z from trials),
        f as (select session, unnest(range(0, max(z))) as row_id from u group by session)
        select f.session, f.row_id, count(u.a) as n_trials from f left join u on u.session = f.session and f.row_id >= u.a and f.row_id < u.z group by all having count(u.a) <> 1""",
    "window_mask": f"""with {_EV}, {_GRID} select distinct g.session, g.row_id from grid g join (select session, floor(time / {_DT}) as b from ev where source = 'purchase' and value > 100) e
        on e.session = g.session and g.row_id >= e.b - 2 and g.row_id < e.b + 2""",
    "stimulus_grid": f"with {_ALIGNED} select session, row_id, trial, {_R('bin_start')} as bin_start from aligned",
    "asof_rows": f"with {_ALIGNED} select session, sample_ix, row_id, trial from {_ASOF.format(ev='ev')}",
    "trial_window_mask": f"""with {_ALIGNED}, hit as {_ASOF.format(ev="(select * from ev where source = 'signup' and value > 60)")}
        select distinct a.session, a.row_id from aligned a join hit h on h.session = a.session and h.trial = a.trial and a.row_id >= h.row_id - 3 and a.row_id < h.row_id + 4""",
    "trial_ends": f"""with {_TRIALS} select session, trial, coalesce(lead(start + 60e0 * (trial % 4)) over (partition by session order by trial), stop) as "end" from trials""",
    "trial_events": f"with {_STIM} select session, {_R('stim - 120.0')} as time from strials where trial % 3 = 0",
    "included_events": f"""with {_EV}, {_TRIALS}, late as (select session, start + 7200.0 as start, included from trials)
        select e.session, e.sample_ix from ev e asof left join late t on e.session = t.session and e.time >= t.start where coalesce(t.included, true)""",
    "context_block_index": f"""with {_TRIALS}, c as (select *, coalesce(cast(context <> lag(context) over (partition by session order by trial) as int), 0) as d from trials)
        select session, trial, cast(sum(d) over (partition by session order by trial) as bigint) as block from c""",
    "trial_gather": f"""with {_GRID}, {_DAYS} select g.session, g.row_id, t.context, t.load, {_R(f'(g.bin_start + {_HALF}) / {_N} / {_DT}')} as fraction,
        case when t.load > 1 then 1 else -1 end as code from grid g join trials t using (session, trial)""",
    "outlier_mask": _outliers(),
    "gap_fill": _GAPS,
    "interpolated_signal": _INTERP,
    "binned_signal": f"with {_EV}, {_GRID}, {_means()} select session, source, row_id, {_R('value')} as value from means",
    "binned_signal_aligned": f"""with {_ALIGNED}, m as (select session, row_id, avg(value) as value from {_ASOF.format(ev="(select * from ev where source = 'view')")} group by all)
        select a.session, 'view' as source, a.row_id, {_R('coalesce(m.value, 0.0)')} as value from aligned a left join m using (session, row_id)
        where a.session in (select session from ev where source = 'view')""",
    "zscored_signal": f"""with {_EV}, {_GRID}, {_means()} select session, source, row_id, {_R('(value - avg(value) over w) / case when stddev_pop(value) over w < 1e-12 then 1 else stddev_pop(value) over w end')} as value
        from means window w as (partition by session, source)""",
    "centered_signal": f"with {_EV}, {_GRID}, {_means()} select session, source, row_id, {_R('value - avg(value) over (partition by session, source)')} as value from means",
    "residual_signal": f"""with {_EV}, {_GRID}, {_means()}, wide as (select session, row_id, max(value) filter (source = 'click') as c, max(value) filter (source = 'view') as v from means group by all),
        s as (select session, avg(v) as mv, regr_slope(c, v) as b from wide where row_id % 24 >= 6 group by session) select session, row_id, {_R('c - (v - mv) * coalesce(b, 0)')} as click from wide join s using (session)""",
    "pose_signal": _POSE,
    "lagged_design": f"""with {_EV}, {_GRID}, {_SERIES}, hit as (select session, floor(time / {_DT}) as b from ev where source = 'error'),
        fitted as (select distinct g.session, g.row_id from grid g join hit h on h.session = g.session and g.row_id >= h.b - 6 and g.row_id < h.b + 6)
        select s.session, s.row_id, f.row_id is not null as fit, x0, x1, x2 from (select session, row_id, {_design('session')} from series) s left join fitted f on f.session = s.session and f.row_id = s.row_id""",
    "segmented_design": f"with {_EV}, {_GRID}, {_SERIES} select session, row_id, {_design('session, trial')} from series",
    "trial_moments": f"with {_DATA} {_MOMENTS}",
    "trial_moments_arrow": f"with {_DATA} {_MOMENTS}",
    "group_moments": f"""with {_DATA}, m as ({_MOMENTS}) select session, unit_id, trial // 5 as cv_group, sum(n) as n, {_R('sum(sx01)', 5)} as sx01, sum(sy) as sy, {_R('sum(sxy1)', 5)} as sxy1 from m group by all""",
    "history_gap": f"""with {_GRID} select session, row_id, row_id >= 3 and min(cast(trial % 5 = 2 as int)) over (partition by session order by row_id rows between 3 preceding and current row) = 1 as safe from grid""",
    "kernel_ridge": f"""with {_FIT} select f.session, f.unit_id, {_R('b')} as intercept, {_R('b0')} as beta0, {_R('b1')} as beta1, {_R(f'1 - {_SSE} / {_TSS}')} as train_r2
        from fits f join rows_ r using (session, unit_id) group by f.session, f.unit_id, b, b0, b1""",
    "alternating_fit": _alternating(_ALS_ROW),
    "predictions": f"with {_FIT} select session, unit_id, row_id, {_R('b + b0 * x0 + b1 * x1')} as prediction from rows_ join fits using (session, unit_id)",
    "row_scores": f"""with {_FIT} select session, unit_id, count(*) as n, {_R(_SSE)} as sse, {_R('var_pop(y) * count(*)')} as tss, {_R(f'1 - {_SSE} / (var_pop(y) * count(*))')} as r2
        from rows_ join fits using (session, unit_id) group by session, unit_id""",
    "kernel_table": f"""with {_FIT} select session, unit_id, 'signup' as predictor, cast(k as int) as lag, k * {_DT} as seconds, {_R('b0')} as weight from fits, range(2) t(k)
        union all select session, unit_id, 'click', 0, 0.0, {_R('b1')} from fits""",
    "gain_values": _alternating(f"""select session, unit_id, 'signup' as predictor, 'offset' as term, {_R('o')} as value from als where k = 8
        union all select session, unit_id, 'signup', 'context', {_R('c')} from als where k = 8"""),
    "cross_validation": _cross_validation(),
    "baseline_shift_test": _baseline_shifts(),
    "history_fit": _history(),
    "outer_folds": f"""with {_TRIALS} select session, trial, cv_group as by_group, cast(ntile(7) over (partition by session order by trial) - 1 as bigint) as by_trial from trials""",
    "edge_shifts": f"with {_EDGE} select session, cast(ordinal as bigint) as ordinal, cast(shift as bigint) as shift, n as n_trials from shifts",
    "shifted_values": f"with {_SHIFTED} select session, trial, shift, shifted, valid from shifted",
    "qc_column": f"with {_QC} select session, unit_id from ok",
    "qc_filter": f"with {_PARTS} select session, unit_id from units where amplitude_cutoff <= 0.5 and presence_ratio >= 0.3 and decoder_label <> 'noise'",
    "limited_units": f"with {_QC} select session, unit_id from ok qualify row_number() over (partition by session order by unit_id) <= 8",
    "pending_sessions": "select c_custkey as session from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 3 = 0)",
    "session_catalog": """select cast(page_id % 97 as varchar) as session, 's3://store/a.b/' || (page_id % 97) || '.nwb.zarr/' as path from pages
        where page_id % 97 in (select n_nationkey from nation)""",
    "unit_spikes": f"""with {_ALIGNED} select session, unit_id, row_id, cast(count(*) as double) as y from {_ASOF.format(ev="(select * from ev where source = 'purchase')")} group by all
        union all select session, 99, 0, 0e0 from sess""",
    "model_means": """select o_orderpriority as model, round(avg(o_totalprice / 1e6), 6) as cv_r2, round(avg(o_orderkey % 7), 6) as n_iter from orders group by 1""",
    "union_difference": f"""with {_EV}, {_SHIFTED}, o as (select session, count(distinct trial) as n_omitted from shifted where not valid group by session)
        select e.session, count(*) as n_events, any_value(n_omitted) as n_omitted from ev e join o using (session) where source in ('click', 'view') group by e.session""",
}
