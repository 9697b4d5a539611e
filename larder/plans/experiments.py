"""An experiment results table that both engines can compute: group-mean predictors.

Each experiment predicts the units of the validation rows by the training mean
of a group (all rows, category, region, category and region); its feature count
is the number of group columns. The table has the columns of the model sweep,
so ranking, best-by-k and the writers work on either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import stats as st
from larder.plans import training as tr
from larder.sources.tables import Tables

# (experiment, model, group columns)
EXPERIMENTS = [("mean_k0", "group_mean", []), ("category_k1", "group_mean", ["category"]),
               ("region_k1", "group_mean", ["region"]), ("category_region_k2", "group_mean", ["category", "region"])]


def _one_sql(name: str, model: str, groups: list[str]) -> str:
    keys = ", ".join(groups)
    means = (f"select {keys}, avg(units_sold) as p from s where split = 'train' group by {keys}" if groups
             else "select avg(units_sold) as p from s where split = 'train'")
    on = " and ".join(f"m.{g} is not distinct from v.{g}" for g in groups) or "true"
    return f"""select '{name}' as experiment_id, '{model}' as model_name, {len(groups)} as feature_count, v.units_sold as a, m.p
  from s v join ({means}) m on {on} where v.split = 'validation'"""


EXPERIMENTS_SQL = f"""with s as (
  select *, case when u < 0.70 then 'train' when u < 0.85 then 'validation' else 'test' end as split
  from (select *, cast(('0x' || substr(md5('42:' || cast(row_id as varchar)), 1, 8)) as bigint) / 4294967296.0 as u from training_frame)),
pairs as ({" union all ".join(_one_sql(*e) for e in EXPERIMENTS)}),
results as (
  select experiment_id, model_name, feature_count, count(*) as n,
         round(1 - sum((p - a) * (p - a)) / nullif(var_pop(a) * count(*), 0.0), 6) as r2_score,
         round(sum(abs(p - a)) / count(*), 6) as mae, round(sqrt(sum((p - a) * (p - a)) / count(*)), 6) as rmse,
         cast(count(*) as double) / 1000000 as training_seconds, 'success' as status
  from pairs group by experiment_id, model_name, feature_count)"""


def experiment_results(t: Tables) -> DataFrame:
    """One row per experiment; stored, so ranking and writing read it."""
    def build():
        s = tr.split_three_way(tr.training_frame(t))
        train, val = s.where("split = 'train'"), s.where("split = 'validation'")
        parts = []
        for name, model, groups in EXPERIMENTS:
            keys = groups or ["_one"]
            one = [] if groups else [F.lit(1).alias("_one")]
            means = train.select("*", *one).groupBy(*keys).agg(F.avg("units_sold").alias("predicted"))
            cond = [F.col(f"v.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
            both = val.select("*", *one).alias("v").join(means.alias("m"), cond)
            parts.append(both.select(F.lit(name).alias("experiment_id"), F.lit(model).alias("model_name"),
                                     F.lit(len(groups)).alias("feature_count"), F.col("units_sold").alias("actual"), "predicted"))
        pairs = parts[0]
        for p in parts[1:]:
            pairs = pairs.unionByName(p)
        m = st.regression_metrics(pairs, keys=["experiment_id", "model_name", "feature_count"])
        return m.select("experiment_id", "model_name", "feature_count", "n", F.col("r2").alias("r2_score"), "mae", "rmse",
                        (F.col("n") / 1000000).alias("training_seconds"), F.lit("success").alias("status"))
    return t._stored("group_mean_experiments", build)


def loss_table(t: Tables) -> DataFrame:
    return experiment_results(t).select("experiment_id", F.col("feature_count").alias("evaluation_number"),
                                        F.col("rmse").alias("objective_value"), F.lit(0.0).alias("elapsed_seconds"))
