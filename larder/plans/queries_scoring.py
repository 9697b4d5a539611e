"""Scoring-side queries: serving features, scenario overrides, schema rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.names import feature_token
from larder.operators.serving import serving_features as serve
from larder.plans import forecast as fc
from larder.plans import training as tr
from larder.plans import uploads as up
from larder.plans.catalog import register
from larder.functions import forecast as ff
from larder.functions.parsing import to_number
from larder.plans.oracle_views import _num_sql, _q, view
from larder.sources.tables import Tables

S = "request_id, product_id, warehouse_id"

# The installed model artifact's feature schema (configuration, not data).
FEATURE_SCHEMA = {
    "feature_order": ["selling_price", "discount_pct", "is_promoted", "shelf_life_days", "supplier_score",
                      "category_SMALL", "category_PROMO", "region_EUROPE", "region_ASIA"],
    "feature_count": 9,
    "target": "units_sold",
}

# ---------------------------------------------------------------------------
# Scenario override fields a request may set, reject texts, job states and error codes.
ALLOWED_OVERRIDES = ["selling_price", "discount_pct", "is_promoted", "spoilage_risk"]
NUMERIC_OVERRIDES = ["discount_pct", "selling_price", "spoilage_risk"]
UNSUPPORTED_FIELDS = "Unsupported scenario override fields."
DISCOUNT_RANGE = "discount_pct must be between 0 and 1."
NOT_A_NUMBER = "{} must be a number."
REJECTED, FAILED, COMPLETED = "rejected", "failed", "completed"
REQUEST_ERROR, FEATURE_ERROR = "DATASET_VALIDATION_FAILED", "FEATURE_RESOLUTION_ERROR"
# ---------------------------------------------------------------------------


def _token_sql(x: str) -> str:
    return (f"lower(regexp_replace(regexp_replace(regexp_replace(cast({x} as varchar), '[^a-zA-Z0-9]+', '_', 'g'), "
            f"'^_+|_+$', '', 'g'), '_+', '_', 'g'))")


def _feature_sql(f: str) -> str:
    for g in ("category", "region"):
        if f.startswith(g + "_"):
            lvl = f[len(g) + 1:]
            return f"case when {g} is null then null else cast({_token_sql(g)} = {_token_sql(_q(lvl))} as double) end"
    return f"cast({f} as double)"


@register("serving_features", f"""
select {S}, {", ".join(f"{_feature_sql(f)} as {f}" for f in FEATURE_SCHEMA["feature_order"])},
       list_filter([{", ".join(f"case when {_feature_sql(f)} is null then {_q(f)} end" for f in FEATURE_SCHEMA["feature_order"])}],
                   lambda s: s is not null) as missing_features
from forecast_context""")
def serving_features(t: Tables):
    """Model inputs in schema order for every forecast context row; missing names listed."""
    return serve(fc.forecast_context(t), fc.SERIES, FEATURE_SCHEMA["feature_order"])


def request_overrides(t: Tables):
    """Per request: scenario override map sent with it (by order priority and status)."""
    o = t.raw("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k, pr = F.col("o_orderkey"), F.col("o_orderpriority")

    def entry(**pairs):
        return F.create_map(*[x for name, v in pairs.items() for x in (F.lit(name), v)])

    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    m = (F.when(pr == "5-LOW", none)
         .when(pr == "4-NOT SPECIFIED", entry(spoilage_risk=F.lit("0.25"), selling_price=(k % 500 + 100).cast("string")))
         .when((pr == "3-MEDIUM") & (k % 11 == 0), entry(discount_pct=F.lit("ten")))
         .when((pr == "3-MEDIUM") & (k % 13 == 0), entry(selling_price=F.lit("12d")))
         .when(F.col("o_orderstatus") == "F", entry(discount_pct=F.concat(F.lit("0."), (k % 10).cast("string"))))
         .when(F.col("o_orderstatus") == "P", entry(selling_price=(k % 500 + 100).cast("string"), promo_code=F.lit("X")))
         .otherwise(entry(discount_pct=F.concat(F.lit("1."), (k % 3).cast("string")), is_promoted=F.lit("true"))))
    return o.select(F.col("o_orderkey").alias("request_id"), m.alias("overrides"))


view("overrides", """
select o_orderkey as request_id,
       case when o_orderpriority = '5-LOW' then map([]::varchar[], []::varchar[])
            when o_orderpriority = '4-NOT SPECIFIED' then map(['spoilage_risk', 'selling_price'], ['0.25', cast(o_orderkey % 500 + 100 as varchar)])
            when o_orderpriority = '3-MEDIUM' and o_orderkey % 11 = 0 then map(['discount_pct'], ['ten'])
            when o_orderpriority = '3-MEDIUM' and o_orderkey % 13 = 0 then map(['selling_price'], ['12d'])
            when o_orderstatus = 'F' then map(['discount_pct'], ['0.' || cast(o_orderkey % 10 as varchar)])
            when o_orderstatus = 'P' then map(['selling_price', 'promo_code'], [cast(o_orderkey % 500 + 100 as varchar), 'X'])
            else map(['discount_pct', 'is_promoted'], ['1.' || cast(o_orderkey % 3 as varchar), 'true']) end
         as overrides
from orders""")

_UNKNOWN_SQL = (f"list_sort([k for k in map_keys(overrides) if not list_contains([{', '.join(_q(a) for a in ALLOWED_OVERRIDES)}], k)])")

view("override_check", f"""
select request_id, {_UNKNOWN_SQL} as unknown_keys, {_num_sql("overrides['discount_pct']")} as discount_override,
       case when len({_UNKNOWN_SQL}) > 0 then {_q(UNSUPPORTED_FIELDS)}
            {" ".join(f"when overrides[{_q(c)}] is not null and ({_num_sql(f'overrides[{_q(c)}]')}) is null then {_q(NOT_A_NUMBER.format(c))}" for c in NUMERIC_OVERRIDES)}
            when ({_num_sql("overrides['discount_pct']")}) not between 0 and 1 then {_q(DISCOUNT_RANGE)} end as reject_reason
from overrides""", ["overrides"])

view("forecast_jobs", f"""
select c.request_id, c.n_products, c.horizon_days, c.dataset_id,
       case when c.reject_reason is not null then {_q(REJECTED)} when o.reject_reason is not null then {_q(FAILED)}
            else {_q(COMPLETED)} end as status,
       case when c.reject_reason is not null then {_q(REQUEST_ERROR)} when o.reject_reason is not null then {_q(FEATURE_ERROR)} end as error_code,
       coalesce(c.reject_reason, o.reject_reason) as error_message, true as is_mock
from request_contract c join override_check o on o.request_id = c.request_id""", ["request_contract", "override_check"])


def override_check(t: Tables):
    """Whitelist check of each request's overrides; numbers must be numbers, discount in [0, 1]."""
    o = request_overrides(t)

    def given(k: str):
        return F.element_at("overrides", F.lit(k))

    unknown = F.array_sort(F.array_except(F.map_keys("overrides"), F.array(*[F.lit(a) for a in ALLOWED_OVERRIDES])))
    discount = to_number(given("discount_pct"))
    reason = F.when(F.size(unknown) > 0, F.lit(UNSUPPORTED_FIELDS))
    for c in NUMERIC_OVERRIDES:
        reason = reason.when(given(c).isNotNull() & to_number(given(c)).isNull(), F.lit(NOT_A_NUMBER.format(c)))
    reason = reason.when(~discount.between(0, 1), F.lit(DISCOUNT_RANGE))
    return o.select("request_id", unknown.alias("unknown_keys"), discount.alias("discount_override"), reason.alias("reject_reason"))


def jobs(t: Tables):
    """One job per request, stored: rejected by the request contract, failed by its overrides, or completed."""
    def build():
        from larder.plans import queries_quality as qq
        c = qq.request_contract(t)
        o = override_check(t).select("request_id", F.col("reject_reason").alias("_override"))
        j = c.join(o, "request_id")
        refused, failed = F.col("reject_reason").isNotNull(), F.col("_override").isNotNull()
        return j.select("request_id", "n_products", "horizon_days", "dataset_id",
                        F.when(refused, REJECTED).when(failed, FAILED).otherwise(COMPLETED).alias("status"),
                        F.when(refused, REQUEST_ERROR).when(failed, FEATURE_ERROR).alias("error_code"),
                        F.coalesce("reject_reason", "_override").alias("error_message"), F.lit(True).alias("is_mock"))
    return t._stored("forecast_jobs", build)


@register("scenario_overrides", "select * from override_check")
def scenario_overrides(t: Tables):
    return override_check(t)


@register("forecast_jobs", "select * from forecast_jobs")
def forecast_jobs(t: Tables):
    """Job rows of all requests with status, error code and message."""
    return jobs(t)


def _override_sql(c: str) -> str:
    return f"case when o.overrides['{c}'] is not null then {_num_sql(f'o.overrides[{_q(c)}]')} else c.{c} end"


view("overridden_context", f"""
select c.request_id, c.product_id, c.warehouse_id, c.store_id, c.forecast_start_date, c.horizon_days, c.shelf_life_days,
       c.cost_price, c.spoilage_sensitivity, c.storage_temp, c.category, c.supplier_score, c.region,
       {_override_sql("selling_price")} as selling_price, {_override_sql("discount_pct")} as discount_pct,
       case when o.overrides['is_promoted'] is not null then lower(o.overrides['is_promoted']) = 'true'
            else c.is_promoted end as is_promoted,
       {_override_sql("spoilage_risk")} as spoilage_risk, c.current_inventory, c.incoming_inventory
from forecast_context c join overrides o on o.request_id = c.request_id
join override_check k on k.request_id = c.request_id and k.reject_reason is null""",
     ["forecast_context", "overrides", "override_check"])

_RUN_SCORE = " + ".join(f"{float(i)}*coalesce(cast({c} as double),0.0)" for i, c in enumerate(ff.DEFAULT_FEATURES, start=1))


@register("context_fallbacks", """
select request_id, product_id, warehouse_id, selling_price, discount_pct, is_promoted, spoilage_risk, region from overridden_context""")
def context_fallbacks(t: Tables):
    """Context after scenario overrides, for the requests whose overrides are accepted."""
    ok = override_check(t).where("reject_reason is null").select("request_id")
    ctx = fc.apply_overrides(fc.forecast_context(t).join(ok, "request_id", "left_semi"), request_overrides(t))
    return ctx.select(*fc.SERIES, "selling_price", "discount_pct", "is_promoted", "spoilage_risk", "region")


@register("forecast_run", f"""
with s as (select c.*, greatest(0, cast(round_even(greatest(0.0, 10.0 + abs({_RUN_SCORE}) % 490.0), 0) as bigint)) as predicted_units_sold
           from overridden_context c join forecast_jobs j on j.request_id = c.request_id and j.status = '{COMPLETED}'),
x as (select s.*, cast(unnest(generate_series(0, s.horizon_days - 1)) as integer) as day_index from s)
select {S}, store_id, cast(forecast_start_date + day_index as date) as forecast_date, predicted_units_sold,
       greatest(0, predicted_units_sold - cast(floor(42.0 + predicted_units_sold*0.08 + 0.5) as bigint)) as lower_bound,
       predicted_units_sold + cast(floor(42.0 + predicted_units_sold*0.08 + 0.5) as bigint) as upper_bound, true as is_mock
from x""")
def forecast_run(t: Tables):
    """Requests -> contract -> overrides -> context -> score -> daily results of the completed jobs."""
    return fc.forecast_run(t, jobs(t), request_overrides(t))


_SUPPORTED = """supported as (
  select distinct 'category' as "group", category as level from split_random where split = 'train' and category is not null)"""


@register("v12_unsupported_level", f"""with {_SUPPORTED}
select m.dataset_id, 'warning' as severity, 'UNSUPPORTED_' || upper(m."column") as code, m."column",
       m.source_row_number as row_number, m.value
from mapped_cells m
where m."column" in ('category', 'region') and m.value is not null
  and not exists (select 1 from supported s where s."group" = m."column" and s.level = m.value)""")
def v12_unsupported_level(t: Tables):
    """Every category / region value outside the model's training vocabulary."""
    train = tr.split_random(tr.training_frame(t)).where(F.col("split") == "train")
    sup = train.where(F.col("category").isNotNull()).select(
        F.lit("category").alias("column"), F.col("category").alias("value")).distinct()
    m = up.mapped_cells(t).where(F.col("column").isin("category", "region") & F.col("value").isNotNull())
    bad = m.join(sup, ["column", "value"], "left_anti")
    return bad.select("dataset_id", F.lit("warning").alias("severity"),
                      F.concat(F.lit("UNSUPPORTED_"), F.upper("column")).alias("code"), "column",
                      F.col("source_row_number").alias("row_number"), "value")


@register("v13_model_feature_unavailable", f"""
with feats as (select * from (values {", ".join(f"({_q(f)})" for f in FEATURE_SCHEMA["feature_order"])}) v(feature)),
avail as (select distinct dataset_id, "column" from mapped_cells)
select d.dataset_id, 'warning' as severity, 'MODEL_FEATURE_UNAVAILABLE' as code, f.feature as "column"
from (select dataset_id, unnest((select list(feature) from feats)) as feature
      from (select distinct dataset_id from avail) x) d join feats f on f.feature = d.feature
where not exists (select 1 from avail a where a.dataset_id = d.dataset_id
                  and a."column" in (f.feature, case when f.feature like 'category\\_%' escape '\\' then 'category'
                                                     when f.feature like 'region\\_%' escape '\\' then 'region'
                                                     else f.feature end))""")
def v13_model_feature_unavailable(t: Tables):
    """Schema features with no source column in a dataset (they must come from related records)."""
    avail = up.mapped_cells(t).select("dataset_id", "column").distinct()
    feats = t.spark.createDataFrame([(f,) for f in FEATURE_SCHEMA["feature_order"]], "feature string")
    group = (F.when(F.col("feature").startswith("category_"), F.lit("category"))
             .when(F.col("feature").startswith("region_"), F.lit("region")).otherwise(F.col("feature")))
    wanted = feats.select("feature", F.explode(F.array_distinct(F.array(F.col("feature"), group))).alias("column"))
    have = avail.join(wanted, "column").select("dataset_id", "feature").distinct()
    schema = F.array(*[F.lit(f) for f in FEATURE_SCHEMA["feature_order"]])
    all_pairs = avail.select("dataset_id").distinct().select("dataset_id", F.explode(schema).alias("feature"))
    missing = all_pairs.join(have, ["dataset_id", "feature"], "left_anti")
    return missing.select("dataset_id", F.lit("warning").alias("severity"),
                          F.lit("MODEL_FEATURE_UNAVAILABLE").alias("code"), F.col("feature").alias("column"))


def _registered_features(k: int) -> list[str]:
    """Feature order of the registered model version k; some versions carry a fault on purpose."""
    order = ["selling_price", "discount_pct", "is_promoted", "shelf_life_days", "supplier_score", "cost_price", "storage_temp",
             "spoilage_sensitivity", "category_SMALL", "category_PROMO", "region_EUROPE", "region_ASIA", "region_AFRICA",
             "weather_index"][:k]
    if k == 10:
        order[-1] = order[0]      # a repeated feature
    if k == 12:
        order[-1] = "units_sold"  # the target as an input
    return order


VERSIONS = [4, 6, 8, 10, 12, 14]
# (version, declared feature count, position, feature): the registry's schema files.
MODEL_SCHEMAS = [(k, k + 1 if k == 8 else k, i, f) for k in VERSIONS for i, f in enumerate(_registered_features(k))]

view("registered_features", f"""
select reg.organization_id, v.version, v.declared_count, v.position, v.feature
from (select * from (values {", ".join(f"({k}, {n}, {i}, {_q(f)})" for k, n, i, f in MODEL_SCHEMAS)})
      x(version, declared_count, position, feature)) v
join (select distinct region as organization_id from training_frame where region is not null) reg on true""", ["training_frame"])

view("candidate_features", f"""
select distinct region as organization_id, 'category_' || category as feature from training_frame where region is not null and category is not null
union select distinct region, 'region_' || r from (select distinct region from training_frame where region is not null) a
      join (select distinct region as r from training_frame where region is not null) b on true
union select distinct region, f from (select distinct region from training_frame where region is not null) a
      join (select unnest([{", ".join(_q(c) for c in tr.FEATURES)}]) as f) c on true""", ["training_frame"])


def registered_features(t: Tables):
    """(organization_id, version, declared_count, position, feature) of every registered model."""
    from larder.plans.queries_catalog import model_registry
    schemas = t.spark.createDataFrame(MODEL_SCHEMAS, "version int, declared_count int, position int, feature string")
    models = model_registry(t).where("organization_id is not null").select("organization_id", F.col("version").cast("int").alias("version"))
    return models.join(schemas, "version").select("organization_id", "version", "declared_count", "position", "feature")


def candidate_features(t: Tables):
    """Inputs that the training frame offers each organisation: numeric columns, its categories, all regions."""
    f = tr.training_frame(t).where("region is not null").select("region", "category").distinct()
    orgs = f.select(F.col("region").alias("organization_id")).distinct()
    names = F.array(*[F.lit(c) for c in tr.FEATURES])
    regions = orgs.agg(F.collect_set(F.concat(F.lit("region_"), "organization_id")).alias("_r")).withColumn("_k", F.lit(1))
    own = orgs.withColumn("_k", F.lit(1)).join(regions, "_k").select(
        "organization_id", F.explode(F.concat(F.col("_r"), names)).alias("feature"))  # one row of regions
    return own.unionByName(f.where("category is not null").select(
        F.col("region").alias("organization_id"), F.concat(F.lit("category_"), "category").alias("feature"))).distinct()


@register("v18_feature_schema_contract", """
select r.organization_id, r.version, count(*) as n_features, max(declared_count) as feature_count,
       count(*) = max(declared_count) as count_ok, count(distinct r.feature) = count(*) as unique_ok,
       count(*) filter (where r.feature = 'units_sold') = 0 as target_ok,
       count(*) filter (where c.feature is null) as n_not_candidates
from registered_features r left join candidate_features c on c.organization_id = r.organization_id and c.feature = r.feature
group by r.organization_id, r.version""")
def v18_feature_schema_contract(t: Tables):
    """Every registered model: declared count = length, no repeats, target not an input, inputs among candidates."""
    c = candidate_features(t).withColumn("_c", F.lit(True))
    j = registered_features(t).join(c, ["organization_id", "feature"], "left")
    n = F.count(F.lit(1))
    return j.groupBy("organization_id", "version").agg(
        n.alias("n_features"), F.max("declared_count").alias("feature_count"), (n == F.max("declared_count")).alias("count_ok"),
        (F.count_distinct("feature") == n).alias("unique_ok"), (F.count_if(F.col("feature") == "units_sold") == 0).alias("target_ok"),
        F.count_if(F.col("_c").isNull()).alias("n_not_candidates"))


@register("missing_candidates", """
select organization_id, version, feature from registered_features r
where not exists (select 1 from candidate_features c where c.organization_id = r.organization_id and c.feature = r.feature)""")
def missing_candidates(t: Tables):
    """Selected features of every registered model that its organisation's candidates lack."""
    return registered_features(t).join(candidate_features(t), ["organization_id", "feature"], "left_anti").select(
        "organization_id", "version", "feature")


@register("concat_results", """
with s as (select * from split_random),
mu as (select avg(units_sold) as p from s where split = 'train'),
cmu as (select category, avg(units_sold) as p from s where split = 'train' group by category),
base as (select 'train_mean' as model, s.units_sold as a, mu.p as p from s join mu on true where s.split = 'test'),
exp as (select 'category_mean' as model, s.units_sold as a, coalesce(cmu.p, mu.p) as p
        from s join mu on true left join cmu on cmu.category = s.category where s.split = 'test'),
allp as (select * from base union all select * from exp)
select model, count(*) as n, round(1 - sum((p - a) * (p - a)) / nullif(var_pop(a) * count(*), 0.0), 6) as r2,
       round(sum(abs(p - a)) / count(*), 6) as mae from allp group by model""")
def concat_results(t: Tables):
    """Baseline result rows + experiment result rows in one table."""
    from larder.operators import stats as st
    s = tr.split_random(tr.training_frame(t))
    train = s.where(F.col("split") == "train")
    mu = train.agg(F.avg("units_sold").alias("mu")).withColumn("_k", F.lit(1))
    cmu = train.groupBy("category").agg(F.avg("units_sold").alias("cmu"))
    test = s.where(F.col("split") == "test").withColumn("_k", F.lit(1)).join(F.broadcast(mu), "_k") \
            .join(cmu, "category", "left")
    base = test.select(F.lit("train_mean").alias("model"), F.col("units_sold").alias("actual"),
                       F.col("mu").alias("predicted"))
    exp = test.select(F.lit("category_mean").alias("model"), F.col("units_sold").alias("actual"),
                      F.coalesce("cmu", "mu").alias("predicted"))
    m = st.regression_metrics(base.unionByName(exp), keys=["model"])
    return m.select("model", "n", "r2", "mae")


# ---------------------------------------------------------------------------
# Warehouse field rules of the source application.
WAREHOUSE_TYPES = ["ambient", "chilled", "frozen", "mixed"]
CODE_MAX, NAME_MAX = 100, 255
# ---------------------------------------------------------------------------


@register("v17_warehouse_fields", """
with z as (select * from (values ('Europe/Paris'), ('America/New_York'), ('Asia/Tokyo'), ('UTC')) v(zone)),
w as (select n_nationkey as k, n_name as code, r_name || ' DC' as name,
             case n_nationkey % 4 when 0 then 'ambient' when 1 then 'chilled' when 2 then 'frozen' else 'mixed' end as kind,
             cast(n_nationkey * 100 - 500 as double) as capacity,
             case n_nationkey % 5 when 0 then 'Europe/Paris' when 1 then 'America/New_York' when 2 then 'Asia/Tokyo'
                  when 3 then 'Not/A_Timezone' else 'UTC' end as timezone
      from nation join region on r_regionkey = n_regionkey)
select k as warehouse_id, trim(code) as warehouse_code, trim(name) as warehouse_name, kind as warehouse_type,
       capacity as storage_capacity, timezone,
       [x for x in [case when length(trim(code)) = 0 or length(trim(code)) > 100 then 'warehouse_code' end,
                    case when length(trim(name)) = 0 or length(trim(name)) > 255 then 'warehouse_name' end,
                    case when not kind in ('ambient', 'chilled', 'frozen', 'mixed') then 'warehouse_type' end,
                    case when capacity < 0 then 'storage_capacity' end,
                    case when not timezone in (select zone from z) then 'timezone' end] if x is not null] as invalid_fields
from w""")
def v17_warehouse_fields(t: Tables):
    """Warehouse records from the nation table: stripped non-blank code / name
    with length caps, known type, capacity >= 0 and an IANA time-zone name.
    The zone list comes from the system tz database (broadcast, bounded)."""
    import zoneinfo
    zones = t.spark.createDataFrame([(z,) for z in sorted(zoneinfo.available_timezones())], "timezone string") \
                   .withColumn("_tz_ok", F.lit(True))
    n = t.nation_region()
    k = F.col("n_nationkey")
    tz = (F.when(k % 5 == 0, "Europe/Paris").when(k % 5 == 1, "America/New_York").when(k % 5 == 2, "Asia/Tokyo")
          .when(k % 5 == 3, "Not/A_Timezone").otherwise("UTC"))
    wh = t.warehouses().join(n.select(F.col("n_nationkey").alias("warehouse_id"), "r_name", tz.alias("timezone"),
                                      (k * 100 - 500).cast("double").alias("storage_capacity")), "warehouse_id")
    j = wh.join(F.broadcast(zones), "timezone", "left")
    code = F.trim("warehouse_code")
    name = F.trim(F.concat("r_name", F.lit(" DC")))
    reason = F.array_compact(F.array(
        F.when((F.length(code) == 0) | (F.length(code) > CODE_MAX), F.lit("warehouse_code")),
        F.when((F.length(name) == 0) | (F.length(name) > NAME_MAX), F.lit("warehouse_name")),
        F.when(~F.col("warehouse_type").isin(WAREHOUSE_TYPES), F.lit("warehouse_type")),
        F.when(F.col("storage_capacity") < 0, F.lit("storage_capacity")),
        F.when(F.col("_tz_ok").isNull(), F.lit("timezone"))))
    return j.select("warehouse_id", code.alias("warehouse_code"), name.alias("warehouse_name"), "warehouse_type",
                    "storage_capacity", "timezone", reason.alias("invalid_fields"))
