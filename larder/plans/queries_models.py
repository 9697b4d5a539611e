"""Model-training queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.operators import gram
from larder.operators import models as md
from larder.operators import scorers as sc
from larder.operators import stats as st
from larder.operators import trees
from larder.operators.serving import serving_features
from larder.plans import forecast as fc
from larder.plans import linear_oracle as lo
from larder.plans import training as tr
from larder.plans.catalog import register
from larder.session import scratch_path
from larder.sources.tables import Tables


def _prepared(t: Tables) -> md.Prepared:
    def build():
        return md.Prepared(tr.split_chronological(tr.training_frame(t)), store=lambda enc: t._stored("training_encoded", lambda: enc))
    return t._memo("prepared", build)


def sweep(t: Tables):
    """The sweep's results table, stored once per application."""
    return t._stored("sweep_results", lambda: md.feature_sweep(t.spark, _prepared(t)))


@register("ridge_fit", f"""with recursive {lo.FRAME},
{lo.solved(lo.EVERY)},
{lo.predictions("test")}
select row_id, actual, round(predicted, 4) as predicted from pred""")
def ridge_fit(t: Tables):
    """Ridge(alpha=1) on all candidates, scaled X and y; test predictions, clipped at 0."""
    p = _prepared(t)
    return md.scored(p, gram.ridge(p.moments(), p.candidates), p.test).withColumn("predicted", F.round("predicted", 4))


@register("ridge_fit_two", f"""
with {lo.CHRONO},
g as (select min(selling_price) as alo, max(selling_price) as ahi, min(shelf_life_days) as blo, max(shelf_life_days) as bhi,
             min(units_sold) as ylo, max(units_sold) as yhi from s where split = 'train'),
x as (select s.row_id, s.split, (selling_price - alo) / (ahi - alo) as a, (shelf_life_days - blo) / (bhi - blo) as b,
             (units_sold - ylo) / (yhi - ylo) as y, units_sold from s, g),
m as (select avg(a) as ma, avg(b) as mb, avg(y) as my, count(*) as n, var_pop(a) * count(*) + 1 as saa, var_pop(b) * count(*) + 1 as sbb,
             covar_pop(a, b) * count(*) as sab, covar_pop(a, y) * count(*) as say, covar_pop(b, y) * count(*) as sby from x where split = 'train'),
w as (select *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) as wa, (sby * saa - say * sab) / (saa * sbb - sab * sab) as wb from m)
select x.row_id, cast(x.units_sold as double) as actual,
       round(greatest(0.0, (my + wa * (a - ma) + wb * (b - mb)) * (yhi - ylo) + ylo), 4) as predicted
from x, w, g where x.split = 'test'""")
def ridge_fit_two(t: Tables):
    """Ridge(alpha=1) on two scaled inputs; the closed form is the oracle."""
    p = _prepared(t)
    return md.scored(p, gram.ridge(p.moments(), ["selling_price", "shelf_life_days"]), p.test).withColumn("predicted", F.round("predicted", 4))


@register("feature_sweep", lo.SWEEP + "\nselect * from results")
def feature_sweep(t: Tables):
    """Experiment rows of all feature counts; the measured seconds are in ``fastest_by_k``."""
    return sweep(t).drop("training_seconds")


@register("rank_experiments", lo.SWEEP + """
select experiment_id, r2_score, mae, rmse, row_number() over (order by round(r2_score, 4) desc, round(mae, 4), rmse, experiment_id) as place from results""")
def rank_experiments(t: Tables):
    """Places of the sweep's experiments; seconds only break ties of all three figures."""
    ranked = md.rank_experiments(sweep(t), "ridge")
    w = Window.orderBy(*md.ranking())  # one row per experiment
    return ranked.select("experiment_id", "r2_score", "mae", "rmse", F.row_number().over(w).cast("bigint").alias("place"))


@register("best_metric_by_k", lo.SWEEP + """
select model_name, feature_count, max(r2_score) as best_r2_score from results group by model_name, feature_count""")
def best_metric_by_k(t: Tables):
    return md.best_metric_by_k(sweep(t), "r2_score")


@register("fastest_by_k")
def fastest_by_k(t: Tables):
    """Least measured training seconds per feature count of the sweep (no oracle: they are measured)."""
    return md.fastest_by_k(sweep(t))


@register("winner_refit", lo.SWEEP.replace(lo.predictions("validation"), lo.predictions("validation") + ",\n" + lo.predictions("test").replace("pred as", "held as", 1)) + f""",
winner as (select experiment_id, feature_count from results order by round(r2_score, 4) desc, round(mae, 4), rmse, experiment_id limit 1),
both_models as (select experiment_id as model, actual, predicted from held join winner on k = feature_count
   union all select 'train_mean', actual, ymean from held join winner on k = feature_count, yr)
select model, {lo.METRICS} from both_models group by model""")
def winner_refit(t: Tables):
    """Refit the best-ranked k on train, score the untouched test split once,
    and report it beside the train-mean baseline on the same rows."""
    p = _prepared(t)
    best = md.rank_experiments(sweep(t), "ridge").first()
    fit = gram.ridge(p.moments(), best["selected_features"].split(","))
    pred = md.scored(p, fit, p.test)
    mu = p.train.agg(F.avg(md.TARGET).alias("mu")).first()["mu"]
    each = F.array(F.struct(F.lit("train_mean").alias("model"), F.lit(mu).alias("predicted")),
                   F.struct(F.lit(best["experiment_id"]).alias("model"), F.col("predicted").alias("predicted")))
    return st.regression_metrics(pred.select("actual", F.inline(each)), keys=["model"])


LOSS_STEPS = 50


@register("loss_history", lo.DESCENT)
def loss_history(t: Tables):
    """Objective of a ridge fit on all candidates before and after each gradient step."""
    p = _prepared(t)
    rows = [(i, loss) for i, (loss, _) in enumerate(gram.descent(p.moments(), p.candidates, LOSS_STEPS))]
    return t.spark.createDataFrame(rows, "iteration int, loss double").withColumn("loss", F.round("loss", 9))


def loss_table(t: Tables):
    """(experiment_id, evaluation_number, objective_value, elapsed_seconds) of that descent, seconds measured."""
    p = _prepared(t)
    rows = [("ridge_all", i, loss, seconds) for i, (loss, seconds) in enumerate(gram.descent(p.moments(), p.candidates, LOSS_STEPS), start=1)]
    return t.spark.createDataFrame(rows, "experiment_id string, evaluation_number int, objective_value double, elapsed_seconds double")


@register("save_load_model", f"""with recursive {lo.FRAME},
{lo.solved(lo.best(8))},
{lo.predictions("test")}
select row_id, round(predicted, 4) as predicted, true as same_as_before from pred""")
def save_load_model(t: Tables):
    """A model written, read again and applied to the test split without any fit, beside its predictions before."""
    p = _prepared(t)
    fit = gram.ridge(p.moments(), md.select_features(p.train, p.candidates, 8))
    path = scratch_path(t.spark, f"models/{uuid.uuid4().hex}")
    md.save_model(t.spark, fit, p, path)
    before = p.test.withColumn("before", p.predicted(fit))
    after = sc.load_scorer(t.spark, path).transform(before)
    return after.select("row_id", F.round("predicted", 4).alias("predicted"), (F.abs(F.col("predicted") - F.col("before")) < 1e-9).alias("same_as_before"))


def serving_model(t: Tables, k: int = 6) -> str:
    """Folder of the stored model of the k best features; fitted once per application."""
    def build():
        p = _prepared(t)
        path = scratch_path(t.spark, f"models/{uuid.uuid4().hex}")
        md.save_model(t.spark, gram.ridge(p.moments(), md.select_features(p.train, p.candidates, k)), p, path, version=str(k))
        return t.spark.createDataFrame([(path,)], "path string")
    return t._stored(f"serving_model_{k}", build).first()["path"]


_FTOKEN = "lower(regexp_replace(regexp_replace(regexp_replace(cast({x} as varchar), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '_+', '_', 'g'))"
_SERIES = ", ".join(fc.SERIES)


def _batch_sql(k: int) -> str:
    return f"""with recursive {lo.FRAME},
{lo.solved(lo.best(k))},
inputs as materialized ({lo._base_rows("forecast_context", _SERIES)}
  union all select {_SERIES}, o.position, case when (case o.grp when 'category' then category else region end) is null then null
     else cast({_FTOKEN.format(x="(case o.grp when 'category' then category else region end)")} = {_FTOKEN.format(x="o.level")} as double) end
  from forecast_context, onehot o)
select {_SERIES}, coalesce(list(feature order by position) filter (value is null), []) as missing_features,
       case when count(value) = count(*) then round(greatest(0.0, (sum(weight * case when hi = lo then 0.0 else (value - lo) / (hi - lo) end) + any_value(b))
            * (any_value(yhi) - any_value(ylo)) + any_value(ylo)), 4) end as predicted,
       case when count(value) = count(*) then true end as finite
from inputs join weights using (position) join intercepts using (k) join ranges using (position) join names using (position), yr
group by {_SERIES}"""


@register("batch_score", _batch_sql(6))
def batch_score(t: Tables):
    """The stored model applied to every forecast context row (serving features in
    schema order), clipped at 0, without fitting; the per-day forecast is flat over the horizon.

    Rows with unresolved inputs keep their missing names and get no prediction."""
    scorer = sc.load_scorer(t.spark, serving_model(t))
    scored = scorer.transform(serving_features(fc.forecast_context(t), fc.SERIES, scorer.features))
    ok = F.size("missing_features") == 0
    value = F.when(ok, F.col("predicted"))
    finite = F.when(ok, ~F.isnan("predicted") & ~F.col("predicted").isin(float("inf"), float("-inf")))
    return scored.select(*fc.SERIES, "missing_features", F.round(value, 4).alias("predicted"), finite.alias("finite"))


# Small settings of the registered tree models; the source's (1000 rounds, rate 0.03, depth 8; 500 trees, depth 20) are the operators' defaults.
GBT_SETTING = {"rounds": 12, "rate": 0.3, "max_depth": 3}
FOREST_SETTING = {"trees": 20, "max_depth": 6}


def _tree_model(t: Tables, name: str):
    """Scorer of the stored tree model and its training losses; fitted once per application."""
    def fit():
        p = _prepared(t)
        model = (trees.gbt_fit(p.train, "row_id", p.candidates, md.TARGET, **GBT_SETTING) if name == "gbt"
                 else trees.random_forest_fit(p.train, "row_id", md.select_features(p.train, p.candidates, 6), md.TARGET, **FOREST_SETTING))
        path = scratch_path(t.spark, f"models/{uuid.uuid4().hex}")
        model.save(t.spark, path, name)
        return t.spark.createDataFrame([(path, model.losses)], "path string, losses array<double>")
    row = t._stored(f"model_{name}", fit).first()
    return sc.load_scorer(t.spark, row["path"], trees.BUILDERS), row["losses"]


def _tree_predictions(t: Tables, name: str):
    scorer, _ = _tree_model(t, name)
    return scorer.transform(_prepared(t).test).select("row_id", F.col(md.TARGET).cast("double").alias("actual"), "predicted")


@register("gbt_fit")
def gbt_fit(t: Tables):
    """Boosted trees (small setting) on all candidates; test predictions, clipped at 0 (no oracle; tests hold the fit against a plain version)."""
    return _tree_predictions(t, "gbt")


@register("random_forest_fit")
def random_forest_fit(t: Tables):
    """Random forest (small setting) on the 6 best features; test predictions (no oracle; tests hold the fit against a plain version)."""
    return _tree_predictions(t, "random_forest")


@register("tree_models_report", f"""with {lo.CHRONO}
select model, count(*) as n, true as all_finite, true as all_non_negative, true as below_mean_error, true as losses_fall
from s, (select unnest(['gbt', 'random_forest']) as model) where split = 'test' group by model""")
def tree_models_report(t: Tables):
    """Per tree model: scored test rows, whether all predictions are finite and not negative, whether their squared error
    is below that of the training mean, and whether every round lowered the training loss."""
    mu = _prepared(t).train.agg(F.avg(md.TARGET).alias("mu")).first()["mu"]
    out = None
    for name in ("gbt", "random_forest"):
        losses = _tree_model(t, name)[1]
        falls = all(b < a for a, b in zip(losses, losses[1:]))
        off, plain = F.col("predicted") - F.col("actual"), F.lit(mu) - F.col("actual")
        part = _tree_predictions(t, name).agg(
            F.count(F.lit(1)).alias("n"), F.bool_and(F.abs("predicted") < float("inf")).alias("all_finite"),
            F.bool_and(F.col("predicted") >= 0).alias("all_non_negative"),
            (F.sum(off * off) < F.sum(plain * plain)).alias("below_mean_error")).select(F.lit(name).alias("model"), "*", F.lit(falls).alias("losses_fall"))
        out = part if out is None else out.unionByName(part)
    return out


@register("active_model_score", f"""with recursive {lo.FRAME},
{lo.solved(lo.best(4, 8, 12))},
active as (select organization_id, last(version order by created_at) as version from (
   select region as organization_id, k as version, cast(last_day + k as date) as created_at
   from (select region, max(transaction_date) as last_day from training_frame group by region), (select unnest([4, 8, 12]) as k)) group by 1),
inputs as materialized ({lo._base_rows("forecast_context", _SERIES + ", region")}
  union all select {_SERIES}, region, o.position, cast({_FTOKEN.format(x="(case o.grp when 'category' then category else region end)")} = {_FTOKEN.format(x="o.level")} as double)
  from forecast_context, onehot o)
select {_SERIES}, organization_id, version,
       case when count(value) = count(*) then round(greatest(0.0, (sum(weight * case when hi = lo then 0.0 else (value - lo) / (hi - lo) end) + any_value(b))
            * (any_value(yhi) - any_value(ylo)) + any_value(ylo)), 4) end as predicted
from inputs join active a on a.organization_id = region join weights w on w.k = a.version and w.position = inputs.position
join intercepts i on i.k = a.version join ranges r on r.position = inputs.position, yr group by {_SERIES}, organization_id, version""")
def active_model_score(t: Tables):
    """Every context row scored by its organisation's active model, each loaded from its folder; rows with a missing input get none.

    One branch per active version, of which the registry has a handful."""
    from larder.plans.queries_catalog import active_model
    active = active_model(t).select("organization_id", "version")
    ctx, out = fc.forecast_context(t), None
    for row in active.select("version").distinct().orderBy("version").collect():
        scorer = sc.load_scorer(t.spark, serving_model(t, row["version"]))
        mine = ctx.join(active.where(F.col("version") == row["version"]), F.col("region") == F.col("organization_id"))
        inputs = serving_features(mine, [*fc.SERIES, "organization_id", "version"], scorer.features)
        part = scorer.transform(inputs).select(*fc.SERIES, "organization_id", "version", F.round("predicted", 4).alias("predicted"))
        out = part if out is None else out.unionByName(part)
    return out
