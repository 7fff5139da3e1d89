"""SQL counterparts of the operators for DuckDB, assembled from named common table expressions."""

from __future__ import annotations

import re

from ..constants import (
    CLIPPED, LOGGED, MEASURES, PANEL_FEATURES, WEEKLY_MEANS, WEEKLY_SPREADS, WEEKLY_SUMS, ZERO_FILLED,
)

CONTINUOUS = [c for c in MEASURES if c not in ZERO_FILLED]
CTE: dict[str, str] = {}


def q(expr: str, alias: str | None = None, digits: int = 4) -> str:
    """Round for comparison. The tiny shift moves decimal ties off the rounding edge."""
    return f"round(cast({expr} as double) + 2.3e-9, {digits}) + 0.0 as {alias or expr}"


def qs(cols: list[str], digits: int = 4) -> str:
    return ", ".join(q(c, c, digits) for c in cols)


def big(expr: str, alias: str | None = None) -> str:
    return f"cast({expr} as bigint) as {alias or expr}"


def each(template: str, cols: list[str], sep: str = ", ") -> str:
    return sep.join(template.replace("@", c) for c in cols)


def query(final: str) -> str:
    """Prefix ``final`` with the expressions it needs, in order of definition."""
    names = list(CTE)
    needed: set[str] = set()
    todo = [final]
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop()))
        for n in names:
            if n in words and n not in needed:
                needed.add(n)
                todo.append(CTE[n])
    parts = [f"{n} as materialized ({CTE[n]})" for n in names if n in needed]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + final


# --- calendar and panel --------------------------------------------------------------
CTE["p_daily"] = """
select c.region_id,
  concat(cast(year(c.d) + c.region_id % 4 as varchar), '-', lpad(cast(month(c.d) as varchar),2,'0'), '-', lpad(cast(day(c.d) as varchar),2,'0')) as date,
  c.day_idx, o.prec, o.surf_pre, o.humidity, o.tmp,
  o.tmp - (100.0 - o.humidity)/5.0 as dp_tmp, o.tmp - (100.0 - o.humidity)/10.0 as wb_tmp,
  o.tmp_max, o.tmp_min, o.tmp_max - o.tmp_min as tmp_range, o.tmp + 1.0 as surf_tmp,
  o.wind, o.wind_max, o.wind_min, o.wind_max - o.wind_min as wind_range,
  case when c.day_idx >= 2405 or c.day_idx % 7 <> 6 then null
       when (c.region_id*31 + ((c.day_idx - c.day_idx % 7)/7)*17) % 10 < 6 then cast(0.0 as double)
       else cast(1.0 + ((c.region_id*7 + ((c.day_idx - c.day_idx % 7)/7)*13) % 9) / 2.0 as double) end as score
from (select s.s_suppkey as region_id, g.day_idx, cast(date '1995-01-02' + cast(g.day_idx as integer) as date) as d
      from supplier s cross join (select range as day_idx from range(0,2499)) g) c
left join (
  select l_suppkey as region_id, cast(l_shipdate as date) as d,
    sum(l_quantity*l_discount) as prec, sum(l_quantity) as surf_pre, avg(l_discount)*1000.0 as humidity,
    avg(l_extendedprice)/1000.0 - 20.0 as tmp, max(l_extendedprice)/1000.0 - 20.0 as tmp_max,
    min(l_extendedprice)/1000.0 - 20.0 as tmp_min, avg(l_tax)*100.0 as wind, max(l_tax)*100.0 as wind_max,
    min(l_tax)*100.0 as wind_min
  from lineitem group by l_suppkey, cast(l_shipdate as date)) o
on o.region_id = c.region_id and o.d = c.d
where not (c.region_id % 10 = 9 and month(c.d) = 2 and day(c.d) = 29)"""
CTE["p_parsed"] = """
select *, cast(split_part(date,'-',1) as bigint) as y, cast(split_part(date,'-',2) as bigint) as m,
  cast(split_part(date,'-',3) as bigint) as d from p_daily"""
CTE["p_dated"] = """
select *, ([0,31,60,91,121,152,182,213,244,274,305,335])[m] + d as doy,
  (y - 1) * 366 + ([0,31,60,91,121,152,182,213,244,274,305,335])[m] + d - 1 as ordinal from p_parsed"""
CTE["p_train"] = "select * exclude (day_idx), row_number() over (partition by region_id order by ordinal) - 1 as pos from p_dated where day_idx < 2405"
CTE["p_test"] = "select * exclude (day_idx, score), row_number() over (partition by region_id order by ordinal) - 1 as pos from p_dated where day_idx >= 2408"
CTE["p_phase"] = "select region_id, arg_min(y % 4, ordinal) as phase from p_train where m = 2 and d = 29 group by region_id"
CTE["p_calendar"] = """
select *, row_number() over (partition by phase order by y, m, d) as k from (
  select p.range as phase, y.range as y, m.range as m, d.range as d
  from range(0,4) p, range(1985,2011) y, range(1,13) m, range(1,32) d
  where d.range <= case when m.range = 2 then case when y.range % 4 = p.range then 29 else 28 end
                        when m.range in (4,6,9,11) then 30 else 31 end)"""

# --- imputation, clipping ----------------------------------------------------------------
KEPT = "region_id, date, y, m, d, doy, ordinal, pos"
BACK = "(partition by region_id order by pos rows between unbounded preceding and current row)"
AHEAD = "(partition by region_id order by pos rows between current row and unbounded following)"


def both_ways(src: str, extra: str = "") -> str:
    return f"select {KEPT}{extra}, " + each(
        f"coalesce(last_value(@ ignore nulls) over {BACK}, first_value(@ ignore nulls) over {AHEAD}) as @", MEASURES) + f" from {src}"


def limited(src: str, extra: str = "") -> str:
    w = "(partition by region_id order by pos rows between 3 preceding and current row)"
    return (f"select {KEPT}{extra}, coalesce(prec,0) as prec, coalesce(surf_pre,0) as surf_pre, "
            + each(f"last_value(@ ignore nulls) over {w} as @", CONTINUOUS) + f" from {src}")


def region_filled(src: str, extra: str = "") -> str:
    return f"select {KEPT}{extra}, prec, surf_pre, " + each(
        "coalesce(@, avg(@) over (partition by region_id)) as @", CONTINUOUS) + f" from {src}"


def globally_filled(src: str, extra: str = "") -> str:
    return f"select {KEPT}{extra}, prec, surf_pre, " + each(
        f"coalesce(@, (select avg(@) from {src})) as @", CONTINUOUS) + f" from {src}"


def clipped(src: str, extra: str = "") -> str:
    rest = [c for c in MEASURES if c not in CLIPPED]
    stats = "select " + each("avg(@) as @_mu, stddev_samp(@) as @_sd", CLIPPED) + f" from {src}"
    cases = each("case when @_sd > 0 and @ < @_mu - 3.5*@_sd then @_mu - 3.5*@_sd when @_sd > 0 and @ > @_mu + 3.5*@_sd then @_mu + 3.5*@_sd else @ end as @", CLIPPED)
    return f"select {KEPT}{extra}, {', '.join(rest)}, {cases} from {src}, ({stats})"


for cohort, extra in (("train", ", score"), ("test", "")):
    CTE[f"f51_{cohort}"] = both_ways(f"p_{cohort}", extra)
    CTE[f"c51_{cohort}"] = clipped(f"f51_{cohort}", extra)
    CTE[f"s54_{cohort}"] = limited(f"p_{cohort}", extra)
    CTE[f"r54_{cohort}"] = region_filled(f"s54_{cohort}", extra)
    CTE[f"f54_{cohort}"] = globally_filled(f"r54_{cohort}", extra)
    CTE[f"c54_{cohort}"] = clipped(f"f54_{cohort}", extra)

# --- padding -------------------------------------------------------------------------------
CTE["p_first"] = "select t.region_id, arg_min(date, ordinal) as first, arg_min(y, ordinal) as y, arg_min(m, ordinal) as m, arg_min(d, ordinal) as d, coalesce(any_value(phase), 1) as phase from p_test t left join p_phase using (region_id) group by t.region_id"
for v, weeks in (("51", 3), ("54", 7)):
    n = weeks * 7
    CTE[f"clim{v}"] = f"select region_id, doy, {each('avg(@) as @', MEASURES)} from c{v}_train group by region_id, doy"
    CTE[f"means{v}"] = f"select {each('avg(@) as @', MEASURES)} from c{v}_train"
    CTE[f"pad{v}"] = f"""
select f.region_id, concat(cast(c.y as varchar), '-', lpad(cast(c.m as varchar),2,'0'), '-', lpad(cast(c.d as varchar),2,'0')) as date,
  {n} - g.range as pos, ([0,31,60,91,121,152,182,213,244,274,305,335])[c.m] + c.d as doy
from p_first f join p_calendar a on a.phase = f.phase and a.y = f.y and a.m = f.m and a.d = f.d
cross join range(1, {n + 1}) g join p_calendar c on c.phase = f.phase and c.k = a.k - g.range"""
    CTE[f"filled_pad{v}"] = f"select p.region_id, p.date, p.pos, {each(f'coalesce(b.@, (select @ from means{v})) as @', MEASURES)} from pad{v} p left join clim{v} b using (region_id, doy)"
    CTE[f"padded{v}"] = f"select * from filled_pad{v} union all by name select region_id, date, pos + {n} as pos, {', '.join(MEASURES)} from c{v}_test"


# --- weeks and features ------------------------------------------------------------------------
def rolled(src: str, score: bool, where: str = "") -> str:
    aggs = [f"coalesce(sum({c}), 0.0) as {c}, max({c}) as {c}_week_max" for c in WEEKLY_SUMS]
    aggs += [f"avg({c}) as {c}, max({c}) as {c}_week_max, min({c}) as {c}_week_min, coalesce(stddev_samp({c}), 0.0) as {c}_week_std" for c in WEEKLY_SPREADS]
    aggs += [f"avg({c}) as {c}" for c in WEEKLY_MEANS] + (["max(score) as score"] if score else [])
    inner = f"select region_id, pos // 7 as week_idx, {', '.join(aggs)}, arg_max(date, pos) as week_end_date from {src} {where} group by region_id, pos // 7"
    doy = "(([0,31,60,91,121,152,182,213,244,274,305,335])[cast(split_part(week_end_date,'-',2) as bigint)] + cast(split_part(week_end_date,'-',3) as bigint))"
    return f"select *, sin(2.0*pi()*{doy}/365.25) as week_sin, cos(2.0*pi()*{doy}/365.25) as week_cos, (cast(split_part(week_end_date,'-',1) as bigint) - 1)*366 + {doy} - 1 as day_ordinal from ({inner})"


def over(rows: int) -> str:
    return f"over (partition by region_id order by week_idx rows between {rows - 1} preceding and current row)"


WK = "over (partition by region_id order by week_idx)"
ROLLING = f"sum(prec) {over(4)} as prec_roll_sum_4w, avg(tmp) {over(4)} as tmp_roll_mean_4w, avg(humidity) {over(4)} as humidity_roll_mean_4w"
LAGS = ", ".join(f"lag({c}, {k}) {WK} as {c}_lag{k}w" for c in ("tmp", "humidity", "prec", "wind") for k in (1, 2))
PET = "0.55 * case when tmp < 0 then 0.0 else tmp end"


def index_frames(src: str, v: str) -> str:
    if v == "51":
        return f"select *, sum(deficit) {over(4)} as deficit_roll_cum_4w from (select *, {PET} as pet, prec - {PET} as deficit, tmp/(humidity+1.0) as aridity_index, tmp_week_max - tmp as heat_shock, {ROLLING}, {LAGS} from {src})"
    s = f"case when {PET} - prec < 0 then 0.0 else {PET} - prec end"
    return f"""select *, sum(water_shortage) {over(4)} as water_shortage_roll_cum_4w, sum(water_shortage) {over(8)} as water_shortage_roll_cum_8w,
  pow(4.0*water_shortage + 2.0*coalesce(lag(water_shortage,1) {WK},0) + coalesce(lag(water_shortage,2) {WK},0), 2) as shortage_momentum,
  cast(coalesce(max(prec) {over(2)} < 0.5, false) as bigint) as is_dry_spell
from (select *, {PET} as pet, {s} as water_shortage, tmp/(humidity+1.0) as aridity_index, tmp_week_max - tmp as heat_shock, {ROLLING} from {src})"""


INDEX51 = ["pet", "deficit", "deficit_roll_cum_4w", "aridity_index", "heat_shock", "tmp_anomaly"]
INDEX54 = ["pet", "water_shortage", "water_shortage_roll_cum_4w", "water_shortage_roll_cum_8w", "cross_shortage_x_anomaly",
           "is_dry_spell", "shortage_momentum", "aridity_index", "heat_shock", "tmp_anomaly"]
CROSS = "water_shortage_roll_cum_4w * case when tmp_anomaly < 0 then 0.0 else tmp_anomaly end as cross_shortage_x_anomaly"
WBACK = "over (partition by region_id order by week_idx rows between unbounded preceding and current row)"

for v, weeks, idx in (("51", 3, INDEX51), ("54", 7, INDEX54)):
    CTE[f"w{v}_train"] = rolled(f"c{v}_train", True, "where pos between 0 and 2400")
    CTE[f"w{v}_test"] = rolled(f"padded{v}", False)
    CTE[f"fit{v}"] = f"select region_id, avg(tmp) as mu, case when stddev_samp(tmp) = 0 then 1.0 else stddev_samp(tmp) end as sd from w{v}_train group by region_id"
    for cohort in ("train", "test"):
        CTE[f"x{v}_{cohort}"] = index_frames(f"w{v}_{cohort}", v)
    CTE[f"z{v}_train"] = f"select x.*, (tmp - mu)/sd as tmp_anomaly from x{v}_train x left join fit{v} using (region_id)"
    CTE[f"own{v}"] = f"select region_id, avg(tmp) as own_mu from w{v}_test group by region_id"
    CTE[f"z{v}_test"] = (f"select x.*, (tmp - case when f.region_id is null then own_mu else f.mu end)/case when f.region_id is null then 1.0 else f.sd end as tmp_anomaly "
                         f"from x{v}_test x join own{v} using (region_id) left join fit{v} f on f.region_id = x.region_id")
    for cohort in ("train", "test"):
        CTE[f"i{v}_{cohort}"] = f"select *, {CROSS} from z54_{cohort}" if v == "54" else f"select * from z51_{cohort}"
    CTE[f"j{v}_test"] = f"select * replace ({each(f'coalesce(last_value(@ ignore nulls) {WBACK}, 0) as @', idx)}) from i{v}_test"
    logs = each("ln(1 + case when @ < 0 then 0.0 else @ end) as @", LOGGED)
    CTE[f"m{v}_train"] = f"select * replace ({logs}) from i{v}_train"
    CTE[f"m{v}_test"] = f"select * replace ({logs}, week_idx - {weeks} as week_idx) from j{v}_test where week_idx >= {weeks}"

# The test cohort with weeks whose temperature is missing, the first one among them, so that gaps are filled.
for v, idx in (("51", INDEX51), ("54", INDEX54)):
    CTE[f"g{v}_weeks"] = f"select * replace (case when region_id % 2 = 0 and week_idx % 5 < 2 then null else tmp end as tmp) from w{v}_test"
    CTE[f"g{v}_own"] = f"select region_id, avg(tmp) as own_mu from g{v}_weeks group by region_id"
    CTE[f"g{v}_frames"] = index_frames(f"g{v}_weeks", v)
    CTE[f"g{v}_z"] = (f"select x.*, (tmp - case when f.region_id is null then own_mu else f.mu end)/case when f.region_id is null then 1.0 else f.sd end as tmp_anomaly "
                      f"from g{v}_frames x join g{v}_own using (region_id) left join fit{v} f on f.region_id = x.region_id")
    CTE[f"g{v}_index"] = f"select *, {CROSS} from g54_z" if v == "54" else "select * from g51_z"
    CTE[f"g{v}_filled"] = f"select * replace ({each(f'coalesce(last_value(@ ignore nulls) {WBACK}, 0) as @', idx)}) from g{v}_index"

# Regions without any measure, so that only the overall mean is left to fill with.
CTE["b_test"] = f"select {KEPT}, prec, surf_pre, " + each("case when region_id % 10 = 3 then null else @ end as @", CONTINUOUS) + " from p_test"
CTE["b_short"] = limited("b_test")
CTE["b_region"] = region_filled("b_short")
CTE["b_filled"] = globally_filled("b_region")
# A climatology with missing slots, so that padded days miss it.
CTE["gap_pad"] = f"select p.region_id, p.date, {each('coalesce(b.@, (select @ from means51)) as @', MEASURES)} from pad51 p left join (select * from clim51 where (region_id + doy) % 3 <> 0) b using (region_id, doy)"

# --- windows and folds -----------------------------------------------------------------------------
F32 = "cast(cast({} as real) as double)"
CTE["t_rows"] = (
    "select region_id, week_idx, score, row_number() over (partition by region_id order by week_idx) - 1 as pos, "
    + " + ".join(F32.format(c) for c in PANEL_FEATURES) + " as fsum, " + each("cast(@ as real) as @", PANEL_FEATURES)
    + " from m51_train where score is not null and " + " and ".join(f"{c} is not null" for c in PANEL_FEATURES))
NEXT = "(partition by region_id order by pos rows between 1 following and 5 following)"
PAST = "(partition by region_id order by pos rows between 12 preceding and current row)"
CTE["t_windows"] = f"""
select * from (select region_id, pos - 12 as start, sum(fsum) over {PAST} as x_sum,
  {each(f"cast(@ - first_value(@) over {PAST} as double)", PANEL_FEATURES, " + ")} as d_sum,
  cast(first_value(prec) over {PAST} as double) as x_first, cast(tmp_anomaly as double) as x_last,
  first_value(week_idx) over {NEXT} as tgt_start, last_value(week_idx) over {NEXT} as tgt_end,
  count(*) over {PAST} as n_past, count(*) over {NEXT} as n_next, {', '.join(f'lead(score, {h}) over (partition by region_id order by pos) as y{h}' for h in range(1, 6))}
from t_rows) where n_past = 13 and n_next = 5"""
CTE["t_bounds"] = "select f.range as fold, mx - f.range*13 - 5 as train_end, mx - f.range*13 - 4 as val_start, mx - f.range*13 as val_end from (select max(week_idx) as mx from t_rows), range(0,4) f"
CTE["t_folds"] = """
select * from (select w.*, b.fold, case when tgt_end <= train_end then 'train' when tgt_start = val_start and tgt_end = val_end then 'val' end as split
from t_windows w, t_bounds b) where split is not null"""
CTE["t_scores"] = """
select r.fold, t.region_id, t.pos, t.score from t_rows t join
 (select region_id, fold, max(start) + 18 as until from t_folds where split = 'train' group by region_id, fold) r
on r.region_id = t.region_id and t.pos < r.until"""
CTE["t_encoding"] = "select fold, region_id, avg(score) as region_mean_score, avg(case when score = 0 then 1.0 else 0.0 end) as region_zero_prob from t_scores group by fold, region_id"
CTE["t_fallback"] = "select fold, avg(region_mean_score) as region_mean_score, avg(region_zero_prob) as region_zero_prob from t_encoding group by fold"

# --- forecasts ------------------------------------------------------------------------------------------
CTE["preds"] = """
select s_suppkey as region_id, f.range as fold, h.range as horizon, ((s_suppkey*13 + h.range*7 + f.range*3) % 51)/10.0 as pred_a,
  ((s_suppkey*29 + h.range*11 + f.range*5) % 101)/100.0 as prob_b, ((s_suppkey*17 + h.range*5) % 11)/2.0 as y_true
from supplier, range(0,4) f, range(1,6) h"""
CTE["gated"] = "select *, case when prob_b < 0.5 then 0.0 else pred_a end as pred from preds"
CTE["merged"] = "select region_id, horizon, median(pred_a) as severity, avg(prob_b) as prob from preds group by region_id, horizon"
BOUND = "least(greatest({}, 0.0), 5.0)"
HARD = "case when prob < {} then 0.0 else severity end"
CTE["subs"] = " union all ".join(
    f"select '{name}' as grp, {expr} as value from merged" for name, expr in (
        ("hard50", f"round_even({BOUND.format(HARD.format(0.5))}, 0)"), ("hard62", f"round_even({BOUND.format(HARD.format(0.62))}, 0)"),
        ("soft", f"round_even({BOUND.format('severity*prob')}, 0)"), ("hard50_raw", BOUND.format(HARD.format(0.5))),
        ("hard62_raw", BOUND.format(HARD.format(0.62))), ("soft_raw", BOUND.format("severity*prob"))))

# --- profiles ----------------------------------------------------------------------------------------------
CTE["e_train"] = "select *, region_id % 10 as cluster_id from m54_train"
CTE["e_test"] = "select *, region_id % 10 as cluster_id from m54_test"
CTE["raw_train"] = "select *, 0.55 * case when tmp < 0 then 0.0 else tmp end as pet_raw, tmp*(100.0-humidity)/100.0 as vpd_raw from p_train"
CTE["raw_test"] = "select *, 0.55 * case when tmp < 0 then 0.0 else tmp end as pet_raw, tmp*(100.0-humidity)/100.0 as vpd_raw from p_test"
CTE["stats54"] = "select region_id, region_id % 10 as cluster_id, " + ", ".join(
    f"coalesce(avg({c}),0) as {c}_mean, coalesce(stddev_samp({c}),0) as {c}_std" for c in ("tmp", "prec", "humidity", "wind")) + " from i54_train group by region_id"


def long(src: str, cols: list[str], keep: str = "") -> str:
    return " union all ".join(f"select {keep}'{c}' as grp, cast({c} as double) as value from {src} where {c} is not null" for c in cols)


def average_rank(c: str) -> str:
    return f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1)/2.0 as {c}"
