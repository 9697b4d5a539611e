"""Training-data statistics, splits, features and metrics queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.operators import features as fe
from larder.operators import kendall
from larder.operators import stats as st
from larder.plans import training as tr
from larder.plans.catalog import register
from larder.functions.parsing import to_number
from larder.plans.oracle_views import _num_sql, _q
from larder.sources.tables import Tables

NUM = tr.NUMERIC


def _long_sql(cols, src="training_frame", id_col=None, target=None):
    extra = (f"{id_col}, " if id_col else "") + (f"cast({target} as double) as _t, " if target else "")
    return "\nunion all\n".join(
        f"select {extra}{_q(c)} as \"column\", {i} as position, cast({c} as double) as value from {src}"
        for i, c in enumerate(cols))


def _long_text_sql(cols):
    return "\nunion all\n".join(f"select {_q(c)} as \"column\", {i} as position, cast({c} as varchar) as value from f" for i, c in enumerate(cols))


def _quantile_sql(src: str, probs: dict[str, float]) -> str:
    sel = []
    for k, p in probs.items():
        pos = f"cast({p} as double)*(n-1)"
        sel += [f"min(case when cum > floor({pos}) then value end) as {k}_lo",
                f"min(case when cum > ceil({pos}) then value end) as {k}_hi",
                f"first({pos} - floor({pos})) as {k}_f"]
    out = ", ".join(f"{k}_lo + ({k}_hi - {k}_lo) * {k}_f as {k}" for k in probs)
    return f"""(select "column", {out} from (
  select "column", {", ".join(sel)} from (
    select *, sum(c) over (partition by "column" order by value rows between unbounded preceding and current row) as cum,
           sum(c) over (partition by "column") as n
    from (select "column", value, count(*) as c from {src} where value is not null group by all) vc) x
  group by "column") y)"""


@register("describe_numeric", f"""
with l as ({_long_sql(NUM)}),
base as (select "column", position, count(*) as n_rows, count(value) as count, avg(value) as mean,
                stddev_samp(value) as std, min(value) as min, max(value) as max, count(distinct value) as "unique"
         from l group by all),
mom as (select l."column", sum(power(l.value - b.mean, 2)) / count(l.value) as m2,
               sum(power(l.value - b.mean, 3)) / count(l.value) as m3,
               sum(power(l.value - b.mean, 4)) / count(l.value) as m4
        from l join base b on b."column" = l."column" where l.value is not null group by all),
q as {_quantile_sql('l', {'q25': 0.25, 'q50': 0.5, 'q75': 0.75})}
select b."column", b.count, round(b.mean, 6) as mean, round(b.std, 6) as std, b.min,
       round(q.q25, 6) as q25, round(q.q50, 6) as q50, round(q.q75, 6) as q75, b.max,
       round(case when b.count > 2 then m.m3 / power(m.m2, 1.5) * sqrt(b.count * (b.count - 1.0)) / (b.count - 2) end, 6)
         as skew,
       round(case when b.count > 3 then ((b.count + 1.0) * (m.m4 / (m.m2 * m.m2) - 3) + 6) * (b.count - 1.0)
                  / ((b.count - 2.0) * (b.count - 3.0)) end, 6) as kurtosis,
       round((b.n_rows - b.count) / b.n_rows * 100, 6) as missing_pct, b."unique"
from base b join mom m on m."column" = b."column" join q on q."column" = b."column" """)
def describe_numeric(t: Tables):
    return st.describe_numeric(tr.training_frame(t), NUM)


@register("value_counts", """
select category, count(*) as n from training_frame group by category
order by n desc, category asc nulls first limit 10""")
def value_counts(t: Tables):
    """Top-10 categories by frequency (null counted as a value); the limit is the feature."""
    f = tr.training_frame(t)
    return f.groupBy("category").agg(F.count(F.lit(1)).alias("n")) \
            .orderBy(F.col("n").desc(), F.col("category").asc_nulls_first()).limit(10)


@register("histogram", f"""
with l as ({_long_sql(NUM)}),
r as (select "column", min(value) as lo, max(value) as hi from l where value is not null group by all),
b as (select l."column", r.lo, r.hi, cast(case when r.hi - r.lo = 0 then 0
             else least(29, floor((l.value - r.lo) / (r.hi - r.lo) * 30)) end as integer) as bin
      from l join r on r."column" = l."column" where l.value is not null)
select r."column", k.bin, round(r.lo + k.bin * (r.hi - r.lo) / 30, 6) as bin_start, count(b.bin) as n
from r join (select cast(unnest(range(30)) as integer) as bin) k on true
left join b on b."column" = r."column" and b.bin = k.bin group by r."column", k.bin, r.lo, r.hi""")
def histogram(t: Tables):
    return st.histogram(tr.training_frame(t), NUM, 30)


@register("box_stats", f"""
with l as ({_long_sql(NUM)}),
q0 as {_quantile_sql('l', {'q1': 0.25, 'median': 0.5, 'q3': 0.75})},
q as (select *, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence from q0)
select q."column", round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, round(iqr, 6) as iqr,
       round(lower_fence, 6) as lower_fence, round(upper_fence, 6) as upper_fence,
       min(case when value between lower_fence and upper_fence then value end) as whisker_low,
       max(case when value between lower_fence and upper_fence then value end) as whisker_high,
       count(*) filter (where not value between lower_fence and upper_fence) as n_outliers
from l join q on q."column" = l."column" where l.value is not null
group by q."column", q1, median, q3, iqr, lower_fence, upper_fence""")
def box_stats(t: Tables):
    return st.box_stats(tr.training_frame(t), NUM)


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


@register("corr_pearson", "\nunion all\n".join(
    f"select {_q(a)} as col_a, {_q(b)} as col_b, round(corr({a}, {b}), 6) as corr from training_frame"
    for a, b in _pairs(NUM)))
def corr_pearson(t: Tables):
    return st.corr_pearson(tr.training_frame(t), NUM)


def _spearman_sql(a: str, b: str) -> str:
    return f"""select {_q(a)} as col_a, {_q(b)} as col_b, round(corr(ra, rb), 6) as corr from (
  select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as ra,
         rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as rb
  from (select cast({a} as double) as x, cast({b} as double) as y from training_frame where {a} is not null and {b} is not null))"""


@register("corr_spearman", "\nunion all\n".join(_spearman_sql(a, b) for a, b in _pairs(NUM)))
def corr_spearman(t: Tables):
    return st.corr_spearman(tr.training_frame(t), NUM, "row_id")


def _kendall_points(cols):
    return "\nunion all\n".join(
        f"select {k} as pair, x, y, count(*) as c from (select cast({a} as double) as x, cast({b} as double) as y from training_frame) "
        f"where x is not null and y is not null group by all" for k, (a, b) in enumerate(_pairs(cols)))


@register("corr_kendall", f"""
with p as ({_kendall_points(NUM)}),
names(pair, col_a, col_b) as (values {", ".join(f"({k}, {_q(a)}, {_q(b)})" for k, (a, b) in enumerate(_pairs(NUM)))}),
o as (select pair, c, row_number() over (partition by pair order by x, y) as pos, row_number() over (partition by pair order by y, x) - 1 as r from p),
bits as (select unnest(range(cast(ceil(log2(max(r) + 1)) as bigint))) as b from o),
lost as (select pair, sum(cast(c * above as hugeint)) as n from (
   select pair, c, (r >> b) & 1 as bit, coalesce(sum(c) filter ((r >> b) & 1 = 1) over (
            partition by pair, b, r >> (b + 1) order by pos rows between unbounded preceding and current row), 0) as above from o, bits)
   where bit = 0 group by pair),
e as (select pair, sum(t) * (sum(t) - 1) as n, sum(t * (t - 1)) as s from (select pair, c as t from p) group by pair),
tx as (select pair, sum(t * (t - 1)) as n from (select pair, sum(c) as t from p group by pair, x) group by pair),
ty as (select pair, sum(t * (t - 1)) as n from (select pair, sum(c) as t from p group by pair, y) group by pair)
select col_a, col_b, round(cast(e.n - tx.n - ty.n + e.s - 4 * coalesce(lost.n, 0) as double)
       / nullif(sqrt(cast(e.n - tx.n as double) * cast(e.n - ty.n as double)), 0), 6) as corr
from names left join e using (pair) left join tx using (pair) left join ty using (pair) left join lost using (pair)""")
def corr_kendall(t: Tables):
    """tau-b of all pairs of columns, nulls pairwise."""
    return kendall.corr_kendall(tr.training_frame(t), NUM)


_MI = f"""
with l as (select * from ({_long_sql(tr.FEATURES, target='units_sold')}) x where _t is not null and value is not null),
r as (select "column", min(value) as lo, max(value) as hi, min(_t) as tlo, max(_t) as thi from l group by all),
cells as (select l."column", l.position,
                 cast(case when r.hi - r.lo = 0 then 0 else least(9, floor((l.value - r.lo) / (r.hi - r.lo) * 10)) end
                      as integer) as fb,
                 cast(case when r.thi - r.tlo = 0 then 0 else least(9, floor((l._t - r.tlo) / (r.thi - r.tlo) * 10)) end
                      as integer) as tb, count(*) as c
          from l join r on r."column" = l."column" group by all),
p as (select "column", position, c, sum(c) over (partition by "column", fb) as cf,
             sum(c) over (partition by "column", tb) as ct, sum(c) over (partition by "column") as n from cells),
scores as (select "column", position, round(sum((c / n) * ln((c * n) / (cf * ct))), 6) as score from p group by all)"""


@register("mutual_info", _MI + "\nselect * from scores")
def mutual_info(t: Tables):
    return st.mutual_info(tr.training_frame(t), tr.FEATURES, "units_sold", 10)


@register("select_k_best", _MI + """
select * from scores qualify row_number() over (order by score desc, position) <= 4""")
def select_k_best(t: Tables):
    return st.select_k_best(st.mutual_info(tr.training_frame(t), tr.FEATURES, "units_sold", 10), 4)


@register("split_random", "select row_id, split from split_random")
def split_random(t: Tables):
    return tr.split_random(tr.training_frame(t)).select("row_id", "split")


@register("split_three_way", """
select row_id, case when u < 0.70 then 'train' when u < 0.85 then 'validation' else 'test' end as split
from (select row_id, cast(('0x' || substr(md5('42:' || cast(row_id as varchar)), 1, 8)) as bigint) / 4294967296.0 as u
      from training_frame)""")
def split_three_way(t: Tables):
    return tr.split_three_way(tr.training_frame(t)).select("row_id", "split")


_CHRONO = """(select row_id, transaction_date, position,
        case when position < floor(n * 0.70) then 'train'
             when position < least(floor(n * 0.70) + greatest(1, floor(n * 0.15)), n - 1) then 'validation'
             else 'test' end as split
 from (select row_id, transaction_date, row_number() over (order by transaction_date, row_id) - 1 as position,
              count(*) over () as n from training_frame))"""


@register("split_chronological", f"select row_id, position, split from {_CHRONO}")
def split_chronological(t: Tables):
    return tr.chronological_positions(tr.training_frame(t)).select("row_id", "position", "split")


@register("split_chronological_sizes", f"select split, count(*) as n, min(transaction_date) as first_day, max(transaction_date) as last_day from {_CHRONO} group by split")
def split_chronological_sizes(t: Tables):
    """The same split from per-date counts alone: whole dates are marked, only the boundary dates are ranked."""
    s = tr.split_chronological(tr.training_frame(t))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("transaction_date").alias("first_day"),
                                  F.max("transaction_date").alias("last_day"))




@register("chronological_head", f"""
select row_id, position, split from {_CHRONO} qualify row_number() over (partition by split order by position) <= 5""")
def chronological_head(t: Tables):
    s = tr.chronological_positions(tr.training_frame(t))
    w = Window.partitionBy("split").orderBy("position")
    return s.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= 5).select("row_id", "position", "split")


@register("sample_n", """
select row_id, units_sold from training_frame order by md5('42:' || cast(row_id as varchar)) limit 100""")
def sample_n(t: Tables):
    """Exactly 100 rows without replacement, seeded: smallest md5(seed:key)."""
    f = tr.training_frame(t)
    return f.orderBy(F.md5(F.concat(F.lit("42:"), F.col("row_id").cast("string")))).limit(100) \
            .select("row_id", "units_sold")


@register("nlargest", """
select row_id, units_sold from training_frame where units_sold is not null
order by units_sold desc, row_id limit 10""")
def nlargest(t: Tables):
    f = tr.training_frame(t).where(F.col("units_sold").isNotNull())
    return f.orderBy(F.col("units_sold").desc(), "row_id").limit(10).select("row_id", "units_sold")


@register("nsmallest", """
select row_id, selling_price from training_frame where selling_price is not null
order by selling_price, row_id limit 10""")
def nsmallest(t: Tables):
    f = tr.training_frame(t).where(F.col("selling_price").isNotNull())
    return f.orderBy("selling_price", "row_id").limit(10).select("row_id", "selling_price")


@register("min_max_fit", f"""
with l as ({_long_sql(tr.FEATURES, src="(select * from split_random where split = 'train')")})
select "column", min(value) as min, max(value) as max from l group by all""")
def min_max_fit(t: Tables):
    f = tr.split_random(tr.training_frame(t)).where(F.col("split") == "train")
    long = st.long_numeric(f, tr.FEATURES)
    return long.groupBy("column").agg(F.min("value").alias("min"), F.max("value").alias("max"))


@register("min_max_apply", f"""
with l as ({_long_sql(tr.FEATURES, src="split_random", id_col="row_id")}),
m as (select "column", min(value) as lo, max(value) as hi
      from ({_long_sql(tr.FEATURES, src="(select * from split_random where split = 'train')")}) x group by all)
select l.row_id, l."column", round(case when m.hi = m.lo then 0.0 else (l.value - m.lo) / (m.hi - m.lo) end, 9) as scaled
from l join m on m."column" = l."column" """)
def min_max_apply(t: Tables):
    """Scale every row with the train-split minimum / maximum (no clipping)."""
    f = tr.split_random(tr.training_frame(t))
    fit = st.long_numeric(f.where(F.col("split") == "train"), tr.FEATURES).groupBy("column").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"))
    long = st.long_numeric(f, tr.FEATURES, "row_id")
    j = long.join(F.broadcast(fit), "column")  # one row per feature
    return j.select("row_id", "column",
                    F.round(fe.min_max_scale(F.col("value"), F.col("lo"), F.col("hi")), 9).alias("scaled"))


_TOKEN = ("case when {c} is null then '__MISSING__' when regexp_replace(regexp_replace(regexp_replace(trim({c}), "
          "'[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') = '' then 'EMPTY' "
          "else regexp_replace(regexp_replace(regexp_replace(trim({c}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), "
          "'_+', '_', 'g'), '^_+|_+$', '', 'g') end")

_VOCAB = f"""vocab as (
  select distinct 'category' as "group", {_TOKEN.format(c='category')} as level from split_random where split = 'train'
  union all
  select distinct 'region', {_TOKEN.format(c='region')} from split_random where split = 'train')"""


@register("one_hot_fit", f"""with {_VOCAB}
select "group", level, "group" || '_' || level as feature from vocab""")
def one_hot_fit(t: Tables):
    f = tr.split_random(tr.training_frame(t)).where(F.col("split") == "train")
    return fe.one_hot_vocabulary(f, ["category", "region"])


@register("one_hot_apply", f"""with {_VOCAB},
toks as (select row_id, {_TOKEN.format(c='category')} as category, {_TOKEN.format(c='region')} as region
         from training_frame)
select row_id, v."group" || '_' || v.level as feature,
       1.0::double as value
from toks join vocab v on (v."group" = 'category' and toks.category = v.level) or (v."group" = 'region' and toks.region = v.level)""")
def one_hot_apply(t: Tables):
    """Saved training vocabulary applied to every row, sparse: unknown levels have no row (all zeros)."""
    return fe.one_hot_long(tr.training_frame(t), "row_id", ["category", "region"], one_hot_fit(t))


@register("one_hot_all", """
select row_id, 'category_' || category as feature, 1 as value from training_frame where category is not null""")
def one_hot_all(t: Tables):
    """Dummies of every level of the whole frame (raw level names), sparse: the one hit per row, nulls none."""
    return tr.training_frame(t).where(F.col("category").isNotNull()).select(
        "row_id", F.concat(F.lit("category_"), "category").alias("feature"), F.lit(1).alias("value"))


def _cyc_sql(expr, name, period):
    ang = f"2 * pi() * {expr} / {float(period)}"
    return f"{expr} as {name}, round(sin({ang}), 9) as {name}_sin, round(cos({ang}), 9) as {name}_cos"


@register("cyclical_time", f"""
select event_id, {_cyc_sql('hour(ts)', 'hour', 24)}, {_cyc_sql('(isodow(ts) - 1)', 'day_of_week', 7)},
       {_cyc_sql('day(ts)', 'day', 31)}, {_cyc_sql('month(ts)', 'month', 12)} from events""")
def cyclical_time(t: Tables):
    e = t.raw("events")
    return e.select("event_id", *fe.cyclical_time(F.col("ts")))


@register("calendar_features", """
select i.source_row_number, isodow(i.snapshot_date) - 1 as day_of_week,
       cast(isodow(i.snapshot_date) - 1 >= 5 as integer) as is_weekend, month(i.snapshot_date) as month,
       quarter(i.snapshot_date) as quarter, weekofyear(i.snapshot_date) as week_of_year,
       datediff('day', i.snapshot_date, cast(i.snapshot_date + p.shelf_life_days as date)) as days_until_expiry
from inventory_snapshots i left join products p on p.product_id = i.product_id""")
def calendar_features(t: Tables):
    i = t.inventory_snapshots().join(t.products().select("product_id", "shelf_life_days"), "product_id", "left")
    d = F.col("snapshot_date")
    return i.select("source_row_number", *fe.calendar_features(d, F.date_add(d, F.col("shelf_life_days"))))


@register("stockout_features", """
select user_id, dt, list_sum(hours_stock_status) as stockout_hours,
       round(list_sum(hours_stock_status) / 24.0, 9) as stockout_ratio,
       list_max(list_transform(string_split(array_to_string(hours_stock_status, ''), '0'), lambda s: length(s)))
         as longest_stockout_run,
       cast(coalesce(list_position(hours_stock_status, 1) - 1, -1) as integer) as first_stockout_hour,
       cast(coalesce(24 - list_position(list_reverse(hours_stock_status), 1), -1) as integer) as last_stockout_hour,
       list_sum(hours_stock_status[9:18]) as business_stockout_hours
from hourly_arrays""")
def stockout_features(t: Tables):
    h = t.hourly_arrays()
    return h.select("user_id", "dt", *fe.stockout_features(F.col("hours_stock_status")))


@register("interaction_features", """
with s as (select user_id, dt, list_sum(hours_stock_status) / 24.0 as ratio,
                  list_sum(hours_stock_status[7:22]) as cnt, list_sum(hours_stock_status[9:18]) as business,
                  (user_id % 10) / 10.0 as discount, cast(day(dt) = 1 as integer) as holiday, cast(user_id % 3 = 0 as integer) as activity,
                  month(dt) / 4.0 as precpt, 40.0 + day(dt) as humidity, cast(isodow(dt) >= 6 as integer) as is_weekend
           from hourly_arrays)
select user_id, dt, round(discount * ratio, 9) as discount_stockout_ratio, round(discount * cnt, 9) as discount_stock_hour6_22_cnt,
       round(discount * business, 9) as discount_business_stockout, round(holiday * ratio, 9) as holiday_stockout_ratio,
       round(activity * ratio, 9) as activity_stockout_ratio, round(precpt * humidity, 9) as bad_weather, is_weekend from s""")
def interaction_features(t: Tables):
    """Six products of discount, calendar and weather columns with stock-out measures; the discount,
    holiday, activity and weather columns, which the tables lack, are derived from user and day."""
    h = t.hourly_arrays()

    def total(arr):
        return F.aggregate(arr, F.lit(0), lambda a, x: a + x)

    frame = h.select(
        "user_id", "dt", (total("hours_stock_status") / 24.0).alias("stockout_ratio"),
        total(F.slice("hours_stock_status", 7, 16)).alias("stock_hour6_22_cnt"),
        total(F.slice("hours_stock_status", 9, 10)).alias("business_stockout"),
        ((F.col("user_id") % 10) / 10.0).alias("discount"), (F.dayofmonth("dt") == 1).cast("int").alias("holiday_flag"),
        (F.col("user_id") % 3 == 0).cast("int").alias("activity_flag"), (F.month("dt") / 4.0).alias("precpt"),
        (F.dayofmonth("dt") + 40.0).alias("avg_humidity"), F.weekday("dt").alias("day_of_week"))
    return frame.select("user_id", "dt", *fe.interaction_features())


@register("log1p_transform", """
select row_id, round(ln(1 + units_sold), 9) as log_units_sold, round(ln(1 + selling_price), 9) as log_selling_price
from training_frame""")
def log1p_transform(t: Tables):
    f = tr.training_frame(t)
    return f.select("row_id", F.round(F.log1p("units_sold"), 9).alias("log_units_sold"),
                    F.round(F.log1p("selling_price"), 9).alias("log_selling_price"))


SERIES_KEYS = ["product_id", "warehouse_id"]


def _daily(t):
    return fe.daily_series(t.sales_records(), SERIES_KEYS)


@register("lag_features", """
select d.product_id, d.warehouse_id, d.day, d.units,
       coalesce(l7.units, 0.0) as lag_7, coalesce(l14.units, 0.0) as lag_14, coalesce(l30.units, 0.0) as lag_30
from daily_series d
left join daily_series l7 on l7.product_id = d.product_id and l7.warehouse_id = d.warehouse_id and l7.day = d.day - 7
left join daily_series l14 on l14.product_id = d.product_id and l14.warehouse_id = d.warehouse_id and l14.day = d.day - 14
left join daily_series l30 on l30.product_id = d.product_id and l30.warehouse_id = d.warehouse_id and l30.day = d.day - 30""")
def lag_features(t: Tables):
    return fe.lag_features(_daily(t), SERIES_KEYS).select(*SERIES_KEYS, "day", "units", "lag_7", "lag_14", "lag_30")


_ROLL = """r as (
  select product_id, warehouse_id, day, units,
         coalesce(sum(units) over w7, 0.0) as s7, coalesce(sum(units) over w30, 0.0) as s30,
         count(units) over w30 as m30, coalesce(var_pop(units) over w30, 0.0) as v30
  from (select *, datediff('day', date '1970-01-01', day) as dn from daily_series) x
  window w7 as (partition by product_id, warehouse_id order by dn range between 7 preceding and 1 preceding),
         w30 as (partition by product_id, warehouse_id order by dn range between 30 preceding and 1 preceding)),
f as (select *, round(s7 / 7.0, 6) as rolling_mean_7, round(s30 / 30.0, 6) as rolling_mean_30,
             round(sqrt(greatest(0.0, (m30 * (v30 + power(s30 / greatest(m30, 1) - s30 / 30.0, 2)) + (30 - m30) * power(s30 / 30.0, 2)) / 29.0)), 6)
               as rolling_std_30 from r)"""


@register("rolling_features", f"""with {_ROLL}
select product_id, warehouse_id, day, units, rolling_mean_7, rolling_mean_30, rolling_std_30 from f""")
def rolling_features(t: Tables):
    return fe.rolling_features(_daily(t), SERIES_KEYS).select(
        *SERIES_KEYS, "day", "units", "rolling_mean_7", "rolling_mean_30", "rolling_std_30")


@register("demand_variability", f"""with {_ROLL}
select product_id, warehouse_id, day, round(rolling_std_30 / nullif(rolling_mean_30, 0.0), 6) as demand_variability
from f""")
def demand_variability(t: Tables):
    return fe.rolling_features(_daily(t), SERIES_KEYS).select(*SERIES_KEYS, "day", "demand_variability")


@register("price_change_pct", """
select product_id, warehouse_id, day,
       round((price - lag(price) over w) / nullif(lag(price) over w, 0.0) * 100, 6) as price_change_pct
from daily_series window w as (partition by product_id, warehouse_id order by day)""")
def price_change_pct(t: Tables):
    return fe.price_change_pct(_daily(t), SERIES_KEYS).select(*SERIES_KEYS, "day", "price_change_pct")


@register("promotion_duration", """
with x as (select *, case when promoted = 0 or lag(promoted) over w is null or lag(promoted) over w = 0
                           or datediff('day', lag(day) over w, day) <> 1 then 1 else 0 end as st
           from daily_series window w as (partition by product_id, warehouse_id order by day)),
y as (select *, sum(st) over (partition by product_id, warehouse_id order by day
                              rows between unbounded preceding and current row) as island from x)
select product_id, warehouse_id, day,
       case when promoted = 1 then count(*) over (partition by product_id, warehouse_id, island order by day
                                                  rows between unbounded preceding and current row) else 0 end
         as promotion_duration
from y""")
def promotion_duration(t: Tables):
    return fe.promotion_duration(_daily(t), SERIES_KEYS).select(*SERIES_KEYS, "day", "promotion_duration")


@register("regression_metrics", """
with s as (select * from split_random),
m as (select avg(units_sold) as mu from s where split = 'train'),
p as (select s.units_sold as a, m.mu as p from s join m on true where s.split = 'test'),
g as (select count(*) as n, sum(abs(p - a)) as sae, sum((p - a) * (p - a)) as sse, var_pop(a) as va,
             sum(case when abs(a) > 1e-8 then abs(p - a) / abs(a) end) as sape,
             count(*) filter (where abs(a) > 1e-8) as n_ape,
             sum(case when abs(a) + abs(p) > 1e-8 then 2 * abs(p - a) / (abs(a) + abs(p)) end) as ssape,
             count(*) filter (where abs(a) + abs(p) > 1e-8) as n_sape from p)
select n, round(1 - sse / nullif(va * n, 0.0), 6) as r2, round(sae / n, 6) as mae, round(sse / n, 6) as mse,
       round(sqrt(sse / n), 6) as rmse, round(case when n_ape > 0 then sape / n_ape * 100 end, 6) as mape,
       round(case when n_sape > 0 then ssape / n_sape * 100 else 0.0 end, 6) as smape from g""")
def regression_metrics(t: Tables):
    """Metrics of the train-mean baseline on the random test split."""
    s = tr.split_random(tr.training_frame(t))
    mu = s.where(F.col("split") == "train").agg(F.avg("units_sold").alias("predicted")).withColumn("_k", F.lit(1))
    test = s.where(F.col("split") == "test").select(F.col("units_sold").alias("actual")).withColumn("_k", F.lit(1))
    pred = test.join(F.broadcast(mu), "_k")  # one-row side
    return st.regression_metrics(pred)


@register("training_audit", f"""
with f as ({tr.AUDIT_FRAME_SQL}),
l as ({_long_text_sql(tr.AUDIT_COLUMNS)}),
n as (select "column", position, value, {_num_sql("value")} as number, lower(trim(value)) in ('inf', '-inf') as infinite from l),
per as (select "column", position, count(*) as n_rows, count(*) filter (where value is null) as n_missing,
               count(*) filter (where infinite) as n_infinite,
               count(*) filter (where value is not null and number is null and not infinite) as n_invalid,
               count(distinct number) <= 1 as is_constant, min(number) as min, max(number) as max, round(avg(number), 6) as mean
        from n group by "column", position),
d as (select count(*) - count(distinct ({", ".join(tr.AUDIT_COLUMNS)})) as duplicate_rows from f)
select "column", position = 0 as is_target, n_rows, n_missing, n_infinite, n_invalid, is_constant, min, max, mean, duplicate_rows,
       [e for e in [case when n_invalid > 0 then cast(n_invalid as varchar) || ' values are not numeric' end,
                    case when n_missing > 0 then 'missing values' end,
                    case when n_infinite > 0 then cast(n_infinite as varchar) || ' infinite values' end,
                    case when n_rows < 9 then 'at least 9 rows are required for three usable subsets' end] if e is not null] as errors
from per, d""")
def training_audit(t: Tables):
    """Target and inputs of a training file as text: missing, infinite, bad casts, constants, range,
    duplicate rows and the errors that would stop a training run (one aggregation)."""
    f = tr.audit_frame(t)
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.col(c).alias("value"))
                        for i, c in enumerate(tr.AUDIT_COLUMNS)])
    v = F.col("value")
    infinite = F.coalesce(F.lower(F.trim(v)).isin("inf", "-inf"), F.lit(False))
    per = f.select(F.inline(entries)).withColumn("number", to_number(v)).groupBy("column", "position").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(v.isNull()).alias("n_missing"), F.count_if(infinite).alias("n_infinite"),
        F.count_if(v.isNotNull() & F.col("number").isNull() & ~infinite).alias("n_invalid"),
        (F.count_distinct("number") <= 1).alias("is_constant"), F.min("number").alias("min"), F.max("number").alias("max"),
        F.round(F.avg("number"), 6).alias("mean"))
    d = f.agg((F.count(F.lit(1)) - F.count_distinct(F.struct(*tr.AUDIT_COLUMNS))).alias("duplicate_rows")).withColumn("_k", F.lit(1))
    errors = F.array_compact(F.array(
        F.when(F.col("n_invalid") > 0, F.concat(F.col("n_invalid").cast("string"), F.lit(" values are not numeric"))),
        F.when(F.col("n_missing") > 0, F.lit("missing values")),
        F.when(F.col("n_infinite") > 0, F.concat(F.col("n_infinite").cast("string"), F.lit(" infinite values"))),
        F.when(F.col("n_rows") < 9, F.lit("at least 9 rows are required for three usable subsets"))))
    return per.withColumn("_k", F.lit(1)).join(F.broadcast(d), "_k").select(  # one-row side
        "column", (F.col("position") == 0).alias("is_target"), "n_rows", "n_missing", "n_infinite", "n_invalid", "is_constant",
        "min", "max", "mean", "duplicate_rows", errors.alias("errors"))


@register("view_report", f"""
with l as ({_long_sql(NUM)}),
d as (select count(*) - count(distinct (units_sold, shelf_life_days, cost_price, spoilage_sensitivity, spoilage_risk,
             selling_price, discount_pct, is_promoted, supplier_score, storage_temp, category, region)) as dup,
             count(*) as n from training_frame)
select l."column", count(distinct l.value) as nunique,
       round(count(*) filter (where l.value is null) * 100.0 / count(*), 6) as missing_pct,
       max(d.n) as n_rows, max(d.dup) as duplicate_rows
from l join d on true group by l."column" """)
def view_report(t: Tables):
    """Shape, per-column unique count and missing %, duplicate rows."""
    f = tr.training_frame(t)
    cols = NUM + ["category", "region"]
    d = f.agg(F.count(F.lit(1)).alias("n_rows"),
              (F.count(F.lit(1)) - F.count_distinct(F.struct(*cols))).alias("duplicate_rows")).withColumn("_k", F.lit(1))
    long = st.long_numeric(f, NUM)
    per = long.groupBy("column").agg(F.count_distinct("value").alias("nunique"),
                                     F.round(F.count_if(F.col("value").isNull()) * 100.0 / F.count(F.lit(1)), 6)
                                     .alias("missing_pct")).withColumn("_k", F.lit(1))
    return per.join(F.broadcast(d), "_k").drop("_k")  # one-row side


@register("inspect_filter", """
select row_id, category, units_sold, selling_price from training_frame
where category = 'SMALL' and units_sold > 25 and selling_price < 1500""")
def inspect_filter(t: Tables):
    f = tr.training_frame(t)
    return f.where((F.col("category") == "SMALL") & (F.col("units_sold") > 25) & (F.col("selling_price") < 1500)) \
            .select("row_id", "category", "units_sold", "selling_price")


@register("drop_columns", """
select row_id, transaction_date, units_sold, shelf_life_days, cost_price, spoilage_sensitivity, spoilage_risk,
       selling_price, discount_pct, is_promoted, supplier_score, storage_temp from training_frame""")
def drop_columns(t: Tables):
    """Drop the columns present (category, region); absent names (revenue) are reported, not fatal."""
    kept, _ = fe.drop_columns(tr.training_frame(t), ["category", "region", "revenue"])
    return kept


@register("drop_columns_absent", "select 'revenue' as absent_column, count(*) as n_rows from training_frame")
def drop_columns_absent(t: Tables):
    """The names that ``drop_columns`` was asked for and did not find, beside the rows it kept."""
    kept, absent = fe.drop_columns(tr.training_frame(t), ["category", "region", "revenue"])
    return kept.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(F.array(*[F.lit(a) for a in absent])).alias("absent_column"), "n_rows")


@register("candidate_projection", """
select row_id, transaction_date, cast(units_sold as double) as units_sold, shelf_life_days, cost_price,
       spoilage_sensitivity, selling_price, discount_pct, is_promoted, supplier_score, storage_temp
from training_frame""")
def candidate_projection(t: Tables):
    """Allowed candidate inputs (spoilage_risk excluded by default), target as double, date, row id."""
    f = tr.training_frame(t)
    cands = [c for c in tr.FEATURES if c != "spoilage_risk"]
    return f.select("row_id", "transaction_date", F.col("units_sold").cast("double").alias("units_sold"), *cands)
