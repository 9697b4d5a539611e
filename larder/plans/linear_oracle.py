"""SQL text of the linear models: encoded frame, feature scores, sums, ridge solutions, predictions.

The small systems are solved by Gauss-Jordan steps in a recursive query over
nested lists; with the penalty on the diagonal no pivoting is needed.
"""

from __future__ import annotations

BASE = ("shelf_life_days", "cost_price", "spoilage_sensitivity", "selling_price", "discount_pct", "is_promoted", "supplier_score", "storage_temp")

_STRIPPED = ("regexp_replace(regexp_replace(regexp_replace(trim({c}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')")
_TOKEN = f"case when {{c}} is null then '__MISSING__' when {_STRIPPED} = '' then 'EMPTY' else {_STRIPPED} end"
_CATEGORY, _REGION = _TOKEN.format(c="category"), _TOKEN.format(c="region")

CHRONO = """s as materialized (select *, case when pos < floor(n * 0.70) then 'train'
        when pos < least(floor(n * 0.70) + greatest(1, floor(n * 0.15)), n - 1) then 'validation' else 'test' end as split
  from (select *, row_number() over (order by transaction_date, row_id) - 1 as pos, count(*) over () as n from training_frame))"""


def _base_rows(source: str, keys: str) -> str:
    return "\n  union all ".join(f"select {keys}, {i} as position, cast({c} as double) as value from {source}" for i, c in enumerate(BASE))


FRAME = f"""{CHRONO},
levels as materialized (select distinct 'category' as grp, {_CATEGORY} as level from s where split = 'train'
   union select distinct 'region', {_REGION} from s where split = 'train'),
onehot as materialized (select {len(BASE)} + row_number() over (order by grp, level) - 1 as position, grp, level from levels),
names as materialized (select * from (values {", ".join(f"({i}, '{c}')" for i, c in enumerate(BASE))}) b(position, feature)
   union all select position, grp || '_' || level from onehot),
x as materialized ({_base_rows("s", "row_id, split")}
  union all select row_id, split, o.position, cast((case o.grp when 'category' then {_CATEGORY} else {_REGION} end) = o.level as double) from s, onehot o),
ranges as materialized (select position, min(value) as lo, max(value) as hi from x where split = 'train' group by position),
yr as materialized (select min(units_sold) as ylo, max(units_sold) as yhi, avg(units_sold) as ymean from s where split = 'train'),
z as materialized (select row_id, list(case when hi = lo then 0.0 else (value - lo) / (hi - lo) end order by position) as v
   from x join ranges using (position) group by row_id),
cells as (select position, fb, tb, count(*) as c from (
   select x.position, cast(case when hi = lo then 0 else least(9, floor((value - lo) / (hi - lo) * 10)) end as integer) as fb,
          cast(case when yhi = ylo then 0 else least(9, floor((units_sold - ylo) / (yhi - ylo) * 10)) end as integer) as tb
   from x join ranges using (position) join s using (row_id), yr where x.split = 'train' and value is not null) group by all),
scores as materialized (select position, round(sum((c / n) * ln((c * n) / (cf * ct))), 6) as score from (
   select position, c, sum(c) over (partition by position, fb) as cf, sum(c) over (partition by position, tb) as ct,
          sum(c) over (partition by position) as n from cells) group by position),
places as materialized (select position, row_number() over (order by score desc, position) as place from scores),
w as materialized (select list_concat(v, [(units_sold - ylo) / (yhi - ylo)]) as e from z join s using (row_id), yr where split = 'train'),
g as materialized (select i, j, sum(e[i] * e[j]) - sum(e[i]) * sum(e[j]) / count(*) as c, sum(e[i]) / count(*) as mi, count(*) as n from (
   select e, i, unnest(range(1, len(e) + 1)) as j from (select e, unnest(range(1, len(e) + 1)) as i from w)) group by i, j),
size as (select max(i) as p from g)"""  # entry p is the target; entry i is position i - 1


def solved(choices: str) -> str:
    """Ridge solutions (k, position, weight) and intercepts (k, b) for ``choices``: SQL giving (k, position)."""
    return f"""choices as materialized ({choices}),
system as (select a.k, list(r order by a.position) as m from (
   select a.k, a.position, list_append(list(g.c + case when a.position = b.position then 1.0 else 0.0 end order by b.position), any_value(t.c)) as r
   from choices a join choices b on b.k = a.k join g on g.i = a.position + 1 and g.j = b.position + 1
   join g t on t.i = a.position + 1 and t.j = (select p from size) group by a.k, a.position) a group by a.k),
gauss as (select k, 0 as step, m from system
   union all
   select k, step + 1, [case when i = step + 1 then [x / m[step + 1][step + 1] for x in m[i]]
          else [m[i][j] - m[i][step + 1] * m[step + 1][j] / m[step + 1][step + 1] for j in range(1, len(m) + 2)] end for i in range(1, len(m) + 1)]
   from gauss where step < len(m)),
weights as materialized (select c.k, c.position, s.m[c.i][len(s.m) + 1] as weight
   from (select *, row_number() over (partition by k order by position) as i from choices) c join (select k, m from gauss where step = len(m)) s using (k)),
intercepts as materialized (select k, (select any_value(mi) from g where i = (select p from size)) - sum(weight * mi) as b
   from weights join (select distinct i, mi from g) on i = position + 1 group by k)"""


def predictions(split: str) -> str:
    return f"""pred as materialized (select k, row_id, actual, greatest(0.0, (sum(weight * v[position + 1]) + any_value(b)) * (any_value(yhi) - any_value(ylo)) + any_value(ylo)) as predicted
   from (select row_id, cast(units_sold as double) as actual, v from s join z using (row_id) where split = '{split}')
   join weights on true join intercepts using (k), yr group by k, row_id, actual)"""


METRICS = """count(*) as n, round(1 - sum((predicted - actual) * (predicted - actual)) / nullif(var_pop(actual) * count(*), 0.0), 6) as r2,
  round(sum(abs(predicted - actual)) / count(*), 6) as mae, round(sum((predicted - actual) * (predicted - actual)) / count(*), 6) as mse,
  round(sqrt(sum((predicted - actual) * (predicted - actual)) / count(*)), 6) as rmse,
  round(sum(abs(predicted - actual) / abs(actual)) filter (abs(actual) > 1e-8) / nullif(count(*) filter (abs(actual) > 1e-8), 0) * 100, 6) as mape,
  round(coalesce(sum(2 * abs(predicted - actual) / (abs(actual) + abs(predicted))) filter (abs(actual) + abs(predicted) > 1e-8)
        / nullif(count(*) filter (abs(actual) + abs(predicted) > 1e-8), 0) * 100, 0.0), 6) as smape"""

EVERY = "select 0 as k, position from places"


def best(*counts: int) -> str:
    return f"select k, position from places join (select unnest([{', '.join(map(str, counts))}]) as k) on place <= k where k <= (select count(*) from places)"


SWEEP = f"""with recursive {FRAME},
{solved(best(4, 6, 8, 10, 12, 14))},
{predictions("validation")},
results as materialized (select 'ridge_k' || k as experiment_id, 'ridge' as model_name, k as feature_count, f.selected_features,
   (select count(*) from s where split = 'train') as training_samples, m.n as validation_samples, m.r2 as r2_score, m.mae, m.mse, m.rmse, m.mape, m.smape,
   'success' as status, '' as error_message
   from (select k, {METRICS} from pred group by k) m
   join (select k, string_agg(feature, ',' order by position) as selected_features from choices join names using (position) group by k) f using (k))"""

DESCENT = f"""with recursive {FRAME},
h as materialized (select list(r order by i) as a, list(t order by i) as b from (
   select i, list(c / n + case when i = j then 1.0 / n else 0.0 end order by j) filter (j < p) as r, any_value(c / n) filter (j = p) as t
   from g, size where i < p group by i)),
yy as (select c / n as v from g, size where i = p and j = p),
steps as (select 0 as iteration, [0.0::double for x in b] as w, a, b, 1.0 / list_sum([a[i][i] for i in range(1, len(a) + 1)]) as step from h
   union all
   select iteration + 1, [w[i] + step * (b[i] - list_dot_product(a[i], w)) for i in range(1, len(w) + 1)], a, b, step from steps where iteration < 50)
select iteration, round(v / 2 - list_dot_product(b, w) + list_dot_product(w, [list_dot_product(r, w) for r in a]) / 2, 9) as loss from steps, yy"""
