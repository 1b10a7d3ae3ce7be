"""The queries once more, as DuckDB SQL over the same tables."""

from __future__ import annotations

from climspark.checks.network import NETWORK_SQL, STATIONS_SQL

GRAIN_UNITS = (("daily", None, "d"), ("monthly", "month", "m"), ("annual", "year", "y"))


def _metrics(y: str = "y", p: str = "p") -> str:
    close = f"abs({y} - {p}) <= 1e-8 + 1e-5 * abs({p})"
    return f"""count(*) as n, round(avg(abs({y} - {p})), 6) as mae, round(sqrt(avg(({y} - {p}) ** 2)), 6) as rmse,
       round(case when min({y}) = max({y}) then (case when bool_and({close}) then 1.0 end)
            else 1 - sum(({y} - {p}) ** 2) / (var_pop({y}) * count(*)) end, 6) as r2"""


def _bins(source: str, keys: str, unit: str | None, agg: str, name: str) -> str:
    """CTE ``name(keys, d, y, p)``: resampled pairs, with (0, 0) in empty bins for sums."""
    if unit is None:
        return f"{name} as (select {keys}, date as d, y, p from {source})"
    agg = {"sum": "sum", "mean": "avg", "median": "median"}[agg]
    raw = f"""{name}_b as (
  select {keys}, cast(date_trunc('{unit}', date) as date) as d, {agg}(y) as y, {agg}(p) as p
  from {source} group by {keys}, cast(date_trunc('{unit}', date) as date))"""
    if agg != "sum":
        return f"{raw}, {name} as (select * from {name}_b where y is not null and p is not null)"
    return f"""{raw},
{name}_s as (
  select {keys}, cast(unnest(generate_series(min(d), max(d), interval 1 {unit})) as date) as d
  from {name}_b group by {keys}),
{name} as (
  select {keys}, d, coalesce(y, 0) as y, coalesce(p, 0) as p from {name}_s left join {name}_b using ({keys}, d))"""


def _score(source: str, unit: str | None, agg: str, prefix: str = NETWORK_SQL) -> str:
    return f"""{prefix}, {source}, {_bins('pairs', 'station', unit, agg, 'bins')}
select station, {_metrics()} from bins group by station"""


def _wide(prefix: str, agg: str, tail: str) -> str:
    """``prefix`` ends with a CTE ``pairs(station, date, y, p)``; ``tail`` selects from the scores."""
    parts = [prefix]
    for grain, unit, _ in GRAIN_UNITS:
        parts.append(_bins("pairs", "station", unit, agg, grain))
        parts.append(f"{grain}_m as (select station, {_metrics()} from {grain} group by station)")
    return ", ".join(parts) + "\n" + tail


WIDE_COLUMNS = ", ".join(
    f"{g}_m.mae as MAE_{s}, {g}_m.rmse as RMSE_{s}, {g}_m.r2 as R2_{s}" for g, _, s in GRAIN_UNITS
)
WIDE_JOIN = "daily_m join monthly_m using (station) join annual_m using (station)"

PAIRS = "pairs as (select station, date, prec as y, prectotcorr as p from obs where prec is not null)"
WINDOW = "date between date '1996-01-01' and date '2000-12-31'"
HORIZON_DAYS = "cast(unnest(generate_series(date '1998-01-01', date '1999-12-31', interval 1 day)) as date) as date"
MONTH_DAYS = "cast(unnest(generate_series(date '1999-02-01', date '1999-02-28', interval 1 day)) as date) as date"

KNN = """
places as (select station, radians(median(latitude)) as x, radians(median(longitude)) as y from {rows} group by station),
near as (
  select a.station, b.station as neighbor, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 12) as distance
  from places a join places b on a.station <> b.station),
knn as (
  select * from (
    select *, row_number() over (partition by station order by distance, neighbor) as rank from near) where rank <= 5)"""

LEAK = """
{name} as (
  select * from (
    select *, row_number() over (partition by station
                order by md5(concat_ws('|', '42', cast(station as varchar), cast(date as varchar))), date{tie}) as i,
           count(*) over (partition by station) as total
    from {rows} where prec is not null{extra})
  where i <= ceil(total * 0.1))"""

CORR = """
daily as (select station, date, avg(prec) as v from raw where prec is not null {clip} group by station, date),
matched as (
  select q.station, q.neighbor, a.v as a, b.v as b
  from wanted q join daily a on a.station = q.station join daily b on b.station = q.neighbor and b.date = a.date),
sums as (
  select station, neighbor, count(*) as n,
         case when count(*) >= {overlap} and min(a) < max(a) and min(b) < max(b)
              then covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) end as corr
  from matched group by station, neighbor)
select {keys}q.neighbor, round(s.corr, 6) as corr, coalesce(s.n, 0) as n_overlap
from wanted q left join sums s on s.station = q.station and s.neighbor = q.neighbor
where q.station in (select station from daily)"""

KEPT = f"""
counts as (select station, count(prec) as valid_rows from obs where {WINDOW} group by station),
kept as (select station, valid_rows from counts where valid_rows >= 265)"""
TRAINED = f"""{KEPT},
trained as (select cast(avg(prec) as float) as v, count(*) as n from obs
            where prec is not null and {WINDOW} and station in (select station from kept))"""

SERIES_MEAN = f"""
totals as (select sum(prec) as s, count(prec) as n from obs where {WINDOW}),
own as (select station, coalesce(sum(case when {WINDOW} then prec end), 0) as s,
               count(case when {WINDOW} then prec end) as n from obs group by station),
means as (select own.station, (totals.s - own.s) / (totals.n - own.n) as p from own, totals),
spine as (select station, {HORIZON_DAYS} from means),
series as (
  select spine.station, spine.date, means.p as p, obs.prec as y
  from spine join means using (station) left join obs on obs.station = spine.station and obs.date = spine.date)"""

COMPARE_SOURCES = """
product as (select station, date, max(prectotcorr) + 1 as v from raw group by station, date),
long as (
  select station, 'obs' as source, date, prec as v from obs where prec is not null
  union all select station, 'nasa', date, prectotcorr from obs
  union all select station, 'rf', date, v from product)"""

COMPARE_SPINE = """
first as (
  select station, source, cast(date_trunc('month', date) as date) as d, {agg}(v) as v
  from long group by station, source, cast(date_trunc('month', date) as date)),
slots as (
  select station, source, cast(unnest(generate_series(min(d), max(d), interval 1 month)) as date) as d
  from first group by station, source),
monthly as (select station, source, d, {value} as v from slots left join first using (station, source, d))"""

COMPARE_PAIRS = """
pairs as (
  select o.station, s.source, o.v as y, s.v as p from {table} o join {table} s
  on s.station = o.station and s.{date} = o.{date} and s.source <> 'obs'
  where o.source = 'obs' and o.v is not null and s.v is not null)"""

WIDE_SOURCES = ", ".join(f"round(max(case when source = '{s}' then v end), 6) as {s}" for s in ("obs", "nasa", "rf"))

GRID_COLUMNS = """cast(date as varchar) as date, round(latitude, 6) as latitude, round(longitude, 6) as longitude,
       round(altitude, 4) as altitude, round(cast(trained.v as double), 3) as y_pred_full"""

TABLE_COLUMNS = """station, cast(date as varchar) as date, round(latitude, 6) as latitude,
       round(longitude, 6) as longitude, round(altitude, 4) as altitude, round(prec, 6) as prec,
       round(prectotcorr, 6) as prectotcorr"""

POINTS = """
points as (select c_custkey as station, cast(c_nationkey + 10 as double) as latitude,
                  cast(c_nationkey - 110 as double) as longitude, c_acctbal as altitude from customer)"""

ORACLE: dict[str, str] = {
    "dirty_dates": """
select l_orderkey, l_linenumber, cast(cast(try_cast(t as timestamp) as date) as varchar) as date
from (select l_orderkey, l_linenumber, case when l_returnflag <> 'R' then cast(l_shipdate as varchar) else 'n/a' end as t
      from lineitem)
where try_cast(t as timestamp) is not null""",
    "time_features": f"""{NETWORK_SQL}
select station, cast(date as varchar) as date, year(date) as year, month(date) as month, dayofyear(date) as doy,
       round(sin(2 * pi() * dayofyear(date) / 365.25), 6) as doy_sin,
       round(cos(2 * pi() * dayofyear(date) / 365.25), 6) as doy_cos
from obs""",
    "narrow_time_features": """
select event_id, year(ts) as year, month(ts) as month, dayofyear(ts) as doy,
       round(cast(cast(sin(2 * pi() * dayofyear(ts) / 365.25) as float) as double), 4) as doy_sin,
       round(cast(cast(cos(2 * pi() * dayofyear(ts) / 365.25) as float) as double), 4) as doy_cos
from events""",
    "clip_counts": """
select user_id, count(*) as n, cast(max(ts) as varchar) as last
from events where ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-20' group by user_id""",
    "valid_counts": f"""{NETWORK_SQL}
select station, count(*) as valid_rows from obs where prec is not null and {WINDOW}
group by station having count(*) >= 265""",
    "select_prefix_regex": f"""{NETWORK_SQL}
select distinct station from obs
where cast(station as varchar) like '1%' or cast(station as varchar) like '27%'
   or regexp_matches(cast(station as varchar), '^([5-6]$|9.)') or station = 3
union select 3 union select 100001""",
    "select_custom": f"""{NETWORK_SQL}
select distinct station from obs
where station < 12 or left(cast(station as varchar), 1) = right(cast(station as varchar), 1)""",
    "station_centroids": """
select c_nationkey as station, round(median(c_acctbal / 100), 6) as latitude,
       round(median(c_custkey / 7), 6) as longitude, round(median(cast(length(c_name) as double)), 6) as altitude
from customer group by c_nationkey""",
    "station_medians_ranged": """
select l_returnflag, round(median(l_extendedprice), 6) as l_extendedprice, round(median(l_discount), 6) as l_discount
from lineitem group by l_returnflag""",
    "knn_neighbors": f"""{NETWORK_SQL}, {KNN.format(rows='obs')}
select station, neighbor, rank, round(distance, 9) as distance from knn""",
    "neighbor_corr": f"""{NETWORK_SQL}, {KNN.format(rows='raw')},
wanted as (select station, neighbor from knn),
{CORR.format(clip='and ' + WINDOW, overlap=60, keys='q.station, ')}""",
    "neighbor_corr_one": f"""{NETWORK_SQL},
wanted as (select 7 as station, unnest([1, 2, 8, 10, 100001]) as neighbor),
{CORR.format(clip='', overlap=10, keys='')}""",
    "leave_one_out_counts": f"""{NETWORK_SQL}
select case when station = 7 then 'test' else 'train' end as part, count(*) as n, count(prec) as n_valid
from obs group by 1""",
    "slice_station": f"""{NETWORK_SQL}
select station, cast(date as varchar) as date, round(prec, 6) as prec from obs where station = 7""",
    "leak_sample": f"""{NETWORK_SQL}, {LEAK.format(name='leak', rows='obs', tie='', extra='')}
select station, cast(date as varchar) as date, round(prec, 6) as prec from leak""",
    "score_daily": _score(PAIRS, None, "sum"),
    "score_weekly_sum": _score(PAIRS, "week", "sum"),
    "score_monthly_sum": _score(PAIRS, "month", "sum"),
    "score_quarterly_mean": _score(PAIRS, "quarter", "mean"),
    "score_annual_mean": _score(PAIRS, "year", "mean"),
    "score_monthly_median": _score(PAIRS, "month", "median"),
    "resampled_months": f"""{NETWORK_SQL},
pairs as (select station, date, prec as y, prectotcorr as p from obs), {_bins('pairs', 'station', 'month', 'sum', 'bins')}
select station, cast(last_day(d) as varchar) as date, round(y, 6) as y_true, round(p, 6) as y_pred from bins""",
    "resampled_quarters": f"""{NETWORK_SQL},
b as (select station, cast(date_trunc('quarter', date) as date) as d, avg(prec) as y from obs group by 1, 2),
s as (select station, cast(unnest(generate_series(min(d), max(d), interval 3 month)) as date) as d from b group by station)
select station, cast(cast(d + interval 3 month - interval 1 day as date) as varchar) as date, round(y, 6) as y_true
from s left join b using (station, d)""",
    **{
        f"scoreboard_{agg}": _wide(
            f"{NETWORK_SQL}, {PAIRS}", agg, f"select station, daily_m.n as n_rows, {WIDE_COLUMNS} from {WIDE_JOIN}"
        )
        for agg in ("sum", "mean", "median")
    },
    "loso_observed_d0": f"""{NETWORK_SQL}, {LEAK.format(name='leak', rows='obs', tie='', extra=' and station = 7')},
pool as (select prec from obs where station <> 7 and prec is not null union all select prec from leak)
select cast(date as varchar) as date, station, round(prec, 6) as y_true, round((select avg(prec) from pool), 6) as y_pred
from obs where station = 7 and prec is not null and {WINDOW}""",
    "loso_full_series_d0": f"""{NETWORK_SQL},
m as (select avg(prec) as v from obs where station <> 7), spine as (select {HORIZON_DAYS})
select cast(spine.date as varchar) as date, cast(7 as bigint) as station, round(m.v, 6) as y_pred_full, round(obs.prec, 6) as y_true
from spine cross join m left join obs on obs.station = 7 and obs.date = spine.date""",
    "loso_fast_knn_d0": f"""{NETWORK_SQL},
windowed as (select * from raw where {WINDOW}), {KNN.format(rows='windowed')},
{LEAK.format(name='leak', rows='windowed', tie=', prec', extra=' and station = 7')},
pool as (select prec from windowed where prec is not null and station in (select neighbor from knn where station = 7)
         union all select prec from leak),
m as (select avg(prec) as v from pool), spine as (select {HORIZON_DAYS})
select cast(spine.date as varchar) as date, cast(7 as bigint) as station, round(m.v, 6) as y_pred_full, round(raw.prec, 6) as y_true
from spine cross join m left join raw on raw.station = 7 and raw.date = spine.date""",
    "loso_full_scores_d0": f"""{NETWORK_SQL},
m as (select avg(prec) as v from obs where station <> 7),
pairs as (select station, date, prec as y, m.v as p from obs, m
          where station = 7 and prec is not null and date between date '1998-01-01' and date '1999-12-31'),
{_bins('pairs', 'station', 'month', 'sum', 'monthly')}, {_bins('pairs', 'station', 'year', 'sum', 'annual')}
select station, 'daily' as grain, {_metrics()} from pairs group by station
union all select station, 'monthly', {_metrics()} from monthly group by station
union all select station, 'annual', {_metrics()} from annual group by station""",
    "evaluate_all_d0": _wide(
        f"""{NETWORK_SQL}, {LEAK.format(name='leak', rows='obs', tie='', extra='')},
totals as (select sum(prec) as s, count(prec) as n from obs),
own as (select station, coalesce(sum(prec), 0) as s, count(prec) as n from obs group by station),
drawn as (select station, sum(prec) as s, count(prec) as n from leak group by station),
means as (select own.station, (totals.s - own.s + coalesce(drawn.s, 0)) / (totals.n - own.n + coalesce(drawn.n, 0)) as p
          from own left join drawn using (station), totals),
pairs as (select station, date, prec as y, p from obs join means using (station) where prec is not null and {WINDOW})""",
        "sum",
        f"""select all_ids.station, coalesce(daily_m.n, 0) as n_rows, {WIDE_COLUMNS}
from (select distinct station from obs) all_ids left join ({WIDE_JOIN}) using (station)""",
    ),
    "evaluate_fast_knn_d0": _wide(
        f"""{NETWORK_SQL}, clipped as (select * from obs where {WINDOW}), {KNN.format(rows='clipped')},
own as (select station, sum(prec) as s, count(prec) as n from clipped group by station),
means as (select knn.station, sum(own.s) / sum(own.n) as p from knn join own on own.station = knn.neighbor group by knn.station),
spots as (select station, median(latitude) as latitude, median(longitude) as longitude, median(altitude) as altitude
          from clipped group by station),
pairs as (select station, date, prec as y, p from clipped join means using (station) join own using (station)
          where prec is not null and own.n >= 265)""",
        "mean",
        f"""select station, daily_m.n as n_rows, {WIDE_COLUMNS}, cast(0 as double) as include_target_pct,
       round(latitude, 6) as latitude, round(longitude, 6) as longitude, round(altitude, 6) as altitude
from {WIDE_JOIN} join spots using (station)""",
    ),
    "export_filled_d0": f"""{NETWORK_SQL}, {SERIES_MEAN},
spots as (select station, median(latitude) as latitude, median(longitude) as longitude, median(altitude) as altitude
          from obs group by station)
select station, round(latitude, 6) as latitude, round(longitude, 6) as longitude, round(altitude, 6) as altitude,
       cast(date as varchar) as date, round(coalesce(y, p), 6) as prec
from series join spots using (station)""",
    "export_series_d0": f"""{NETWORK_SQL}, {SERIES_MEAN}
select station, cast(date as varchar) as date, round(p, 6) as y_pred_full, round(y, 6) as y_true from series""",
    "manifest_d0": _wide(
        f"""{NETWORK_SQL}, {SERIES_MEAN},
coverage as (select station, round(100 * avg(case when y is not null then 1.0 else 0.0 end), 6) as coverage_pct
             from series group by station),
pairs as (select station, date, y, p from series where y is not null)""",
        "sum",
        f"""select station, coverage_pct, {WIDE_COLUMNS}, cast(null as varchar) as error
from coverage left join ({WIDE_JOIN}) using (station)""",
    ),
    "export_compact_one_d0": f"""{NETWORK_SQL},
m as (select avg(prec) as v from obs where station <> 7), spine as (select {HORIZON_DAYS})
select cast(7 as bigint) as station, round(m.v, 6) as y_pred_full, round(obs.prec, 6) as y_true,
       cast(spine.date as varchar) as date, round(coalesce(obs.prec, m.v), 6) as prec
from spine cross join m left join obs on obs.station = 7 and obs.date = spine.date""",
    "train_summary": f"""{NETWORK_SQL}, {KEPT} select station, valid_rows from kept""",
    "train_metadata": f"""{NETWORK_SQL}, {TRAINED}
select (select n from trained) as n_train_rows, count(*) as n_stations_used, min(station) as first_station,
       count(*) as n_listed, 'latitude,longitude,altitude,year,month,doy,doy_sin,doy_cos' as features
from kept""",
    "grid_predict_d0": f"""{NETWORK_SQL}, {TRAINED}, days as (select {HORIZON_DAYS})
select station, {GRID_COLUMNS} from stations cross join days cross join trained""",
    "grid_written_d0": f"""{NETWORK_SQL}, {TRAINED}, days as (select {MONTH_DAYS})
select station as cell, cast(date as varchar) as date, round(latitude, 6) as lat, round(longitude, 6) as lon,
       round(altitude, 4) as elev, round(cast(trained.v as double), 3) as y_pred_full
from stations cross join days cross join trained""",
    "points_predict_d0": f"""{NETWORK_SQL}, {TRAINED}, {POINTS}, days as (select {MONTH_DAYS})
select station, {GRID_COLUMNS} from points cross join days cross join trained""",
    "point_predict_d0": f"""{NETWORK_SQL}, {TRAINED}, days as (select {HORIZON_DAYS}),
point as (select 99 as station, 19.5 as latitude, -99.25 as longitude, 2240.0 as altitude)
select station, {GRID_COLUMNS} from point cross join days cross join trained""",
    "points_grid": f"""with {POINTS}
select station, round(latitude, 6) as latitude, round(longitude, 6) as longitude, round(altitude, 4) as altitude from points""",
    "grid_null_report": f"""{NETWORK_SQL}
select count(*) filter (where station is null) as station, count(*) filter (where prec is null) as latitude,
       count(*) filter (where prectotcorr > 15) as longitude, cast(null as bigint) as altitude
from obs""",
    "grid_dedupe": """
select c_nationkey as station, round(min(c_acctbal / 100), 6) as latitude,
       round(arg_min(c_custkey / 8, c_acctbal), 6) as longitude, 5.0 as altitude
from customer group by c_nationkey""",
    "compare_scores": f"""{NETWORK_SQL}, {COMPARE_SOURCES},
clipped as (select * from long where {WINDOW}), {COMPARE_PAIRS.format(table='clipped', date='date')}
select station, source, {_metrics()} from pairs group by station, source""",
    "compare_monthly_sum": f"""{NETWORK_SQL}, {COMPARE_SOURCES},
{COMPARE_SPINE.format(agg='sum', value='coalesce(v, 0)')}, {COMPARE_PAIRS.format(table='monthly', date='d')}
select station, source, {_metrics()} from pairs group by station, source""",
    "compare_smoothed": f"""{NETWORK_SQL}, {COMPARE_SOURCES}, {COMPARE_SPINE.format(agg='avg', value='v')},
smooth as (select station, source, d, avg(v) over (partition by station, source order by d
                rows between 2 preceding and 1 following) as v from monthly)
select station, cast(last_day(d) as varchar) as date, {WIDE_SOURCES} from smooth group by station, d""",
    "compare_smoothed_rows": f"""{NETWORK_SQL}, {COMPARE_SOURCES},
smooth as (select station, source, date, avg(v) over (partition by station, source order by date
                rows between 1 preceding and 1 following) as v from long)
select station, cast(date as varchar) as date, {WIDE_SOURCES} from smooth group by station, date""",
    "roundtrip_parquet": f"{NETWORK_SQL} select {TABLE_COLUMNS} from obs",
    "roundtrip_csv": f"{NETWORK_SQL} select {TABLE_COLUMNS} from obs",
    "roundtrip_metrics_json": f"""{NETWORK_SQL}, {PAIRS},
{_bins('pairs', 'station', 'month', 'sum', 'monthly')}, {_bins('pairs', 'station', 'year', 'sum', 'annual')}
select station, 'daily' as grain, {_metrics()} from pairs group by station
union all select station, 'monthly', {_metrics()} from monthly group by station
union all select station, 'annual', {_metrics()} from annual group by station""",
    "roundtrip_model": f"with {STATIONS_SQL} select station, true as same from stations",
}


# --- trees: the step function that the tree reproduces.


def _steps(lat: str = "latitude", lon: str = "longitude", alt: str = "altitude") -> str:
    return f"""(case when {lat} >= 23.5 then 200 else 0 end + case when {lon} >= -99 then 0 else 60 end
  + case when {alt} >= 1200 then 0 else 25 end + case when year(date) >= 1999 then 9 else 0 end
  + case when month(date) >= 7 then 4 else 0 end)"""


GRID_TREE = f"""cast(date as varchar) as date, round(latitude, 6) as latitude, round(longitude, 6) as longitude,
       round(altitude, 4) as altitude, cast({_steps()} as double) as y_pred_full"""

_PAIRED = """pairs as (select station, date, prec as y, p from obs join means using (station) where prec is not null and {window})"""
_BOARD = f"select station, daily_m.n as n_rows, {WIDE_COLUMNS} from {WIDE_JOIN}"

ORACLE |= {
    "knn_quadtree": """
with places as (select c_custkey as station, radians(cast(c_nationkey as double)) as x,
                       radians(cast(floor(c_acctbal / 1000) - 100 as double)) as y from customer),
near as (
  select a.station, b.station as neighbor, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 12) as distance
  from places a join places b on a.station <> b.station)
select station, neighbor, rank, round(distance, 9) as distance from (
  select *, row_number() over (partition by station order by distance, neighbor) as rank from near) where rank <= 3""",
    "knn_targets": f"""{NETWORK_SQL}, {KNN.format(rows='obs')}
select station, neighbor, rank, round(distance, 9) as distance from knn""",
    "grid_dedupe_nulls": """
with cells as (
  select c_nationkey as station, case when c_custkey % 3 <> 0 then c_acctbal / 100 end as latitude,
         case when c_custkey % 5 <> 0 then c_custkey / 8 end as longitude from customer),
ranked as (
  select *, row_number() over (partition by station order by (latitude is null or longitude is null)::int,
                               latitude nulls first, longitude nulls first) as i from cells)
select station, round(latitude, 6) as latitude, round(longitude, 6) as longitude, 5.0 as altitude from ranked where i = 1""",
    "compare_extra_table": f"""{NETWORK_SQL},
everywhere as (select date, avg(prec) as v from raw group by date),
long as (
  select station, 'obs' as source, date, prec as v from obs where prec is not null and station = 7
  union all select station, 'nasa', date, prectotcorr from obs where station = 7
  union all select 7, 'extra', date, v from everywhere where v is not null),
{COMPARE_SPINE.format(agg='avg', value='v')}, {COMPARE_PAIRS.format(table='monthly', date='d')}
select station, source, {_metrics()} from pairs group by station, source""",
    "compare_extra_vector": f"""{NETWORK_SQL}
select station, cast(date as varchar) as date, round(prec, 6) as obs,
       cast((row_number() over (order by date) - 1) % 31 as double) as extra
from obs where station = 7 and prec is not null""",
    "loso_tree": f"""{NETWORK_SQL}
select cast(date as varchar) as date, station, cast({_steps()} as double) as y_true, cast({_steps()} as double) as y_pred
from obs where station = 7 and prec is not null""",
    "loso_fast_tree": f"""{NETWORK_SQL},
spine as (select {HORIZON_DAYS}), here as (select latitude, longitude, altitude from stations where station = 7),
days as (select date, {_steps()} as p from spine, here)
select cast(days.date as varchar) as date, cast(7 as bigint) as station, cast(p as double) as y_pred_full,
       case when obs.prec is not null then cast(p as double) end as y_true
from days left join obs on obs.station = 7 and obs.date = days.date""",
    "loso_model_and_features": f"""{NETWORK_SQL}
select cast(date as varchar) as date, cast(month(date) as double) as y_pred, 'month' as features
from obs where station = 7 and prec is not null and {WINDOW}""",
    "evaluate_var_col_tree": f"""{NETWORK_SQL}
select station, count(*) as n_rows, cast(0 as double) as MAE_d, cast(0 as double) as RMSE_m,
       case when min(prectotcorr >= 15) = max(prectotcorr >= 15) then 1.0 else 1.0 end as R2_d
from obs where station in (2, 3, 5) and prec is not null and day(date) > 3 and {WINDOW} group by station""",
    "evaluate_order_d0": f"""{NETWORK_SQL},
totals as (select sum(prec) as s, count(prec) as n from obs),
means as (select station, (totals.s - coalesce(sum(prec), 0)) / (totals.n - count(prec)) as p from obs, totals
          group by station, totals.s, totals.n),
scored as (select all_ids.station, mae from (select distinct station from obs) all_ids left join (
  select station, avg(abs(prec - p)) as mae from obs join means using (station)
  where prec is not null and {WINDOW} group by station) using (station))
select station, round(mae, 6) as MAE_d, row_number() over (order by mae desc nulls last, station) as place from scored""",
    "evaluate_map_d0": _wide(
        f"""{NETWORK_SQL}, clipped as (select * from obs where {WINDOW}),
ids as (select distinct station from clipped),
map as (select a.station, b.station as neighbor from ids a join ids b on b.station in (a.station + 1, a.station + 2)),
means as (select map.station, avg(prec) as p from map join clipped on clipped.station = map.neighbor group by map.station),
{_PAIRED.format(window=WINDOW)}""",
        "sum",
        f"""select ids.station, coalesce(daily_m.n, 0) as n_rows, {WIDE_COLUMNS}
from ids left join ({WIDE_JOIN}) using (station)""",
    ),
    "evaluate_log_d0": _wide(
        f"""{NETWORK_SQL}, clipped as (select * from obs where {WINDOW}), {KNN.format(rows='clipped')},
means as (select knn.station, avg(prec) as p from knn join clipped on clipped.station = knn.neighbor
          where rank <= 2 group by knn.station),
{_PAIRED.format(window=WINDOW)}""",
        "sum",
        _BOARD,
    ),
    "full_series_covariates": f"""{NETWORK_SQL},
m as (select avg(prec) as v from obs where station <> 7), spine as (select {HORIZON_DAYS}),
held as (select distinct date from obs where day(date) % 3 <> 0)
select cast(spine.date as varchar) as date, cast(7 as bigint) as station,
       case when held.date is not null then round(m.v, 6) end as y_pred_full, round(obs.prec, 6) as y_true
from spine cross join m left join held on held.date = spine.date left join obs on obs.station = 7 and obs.date = spine.date""",
    "grid_tree": f"""with {STATIONS_SQL}, days as (select {HORIZON_DAYS})
select station, {GRID_TREE} from stations cross join days""",
    "grid_renamed_tree": f"""with {STATIONS_SQL}, days as (select {MONTH_DAYS})
select station as cell, cast(date as varchar) as date, round(latitude, 6) as y, round(longitude, 6) as x,
       round(altitude, 4) as z, cast({_steps()} as double) as y_pred_full
from stations cross join days""",
    "grid_forest_dealt": f"""with {STATIONS_SQL}, days as (select {MONTH_DAYS})
select station, {GRID_TREE} from stations cross join days""",
    "points_tree": f"""with {STATIONS_SQL}, days as (select {MONTH_DAYS})
select station + 500 as station, {GRID_TREE} from stations cross join days""",
}

_KNN_MEAN = SERIES_MEAN.replace(
    "means as (select own.station, (totals.s - own.s) / (totals.n - own.n) as p from own, totals)",
    "means as (select knn.station, sum(own.s) / sum(own.n) as p from knn join own on own.station = knn.neighbor "
    "group by knn.station)",
)
ORACLE |= {
    "export_knn_d0": f"""{NETWORK_SQL}, {KNN.format(rows='obs')}, {_KNN_MEAN}
select station, cast(date as varchar) as date, round(p, 6) as y_pred_full, round(y, 6) as y_true from series""",
    "export_covariates_d0": f"""{NETWORK_SQL}, {SERIES_MEAN},
held as (select distinct date from obs where day(date) % 3 <> 0)
select station, cast(series.date as varchar) as date, case when held.date is not null then round(p, 6) end as y_pred_full,
       round(y, 6) as y_true
from series left join held on held.date = series.date""",
}

# Mean forests grown together are those of single fits.
ORACLE["evaluate_together_d0"] = ORACLE["evaluate_fast_knn_d0"]
