"""Splits, folds, ranks, best rows, joins, grids and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetable.operators import combine, rank, select, splits, stats
from wavetable.queries.aggregates import METRICS, PREDICTED, SPLIT, predicted_orders, rounded_metrics
from wavetable.queries.registry import L, MEAN, T, query, rounded, spectra, table, with_views


@query("random_split", with_views(SPLIT, body="select o_orderkey, split from sp"))
def random_split(spark, folder):
    return splits.assign_splits(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "two_way_split",
    """select vec_id, case when row_number() over (order by md5('7:' || vec_id)) <= ceil(round(count(*) over () * 0.3, 9))
    then 'test' else 'train' end as split from embeddings""",
)
def two_way_split(spark, folder):
    return splits.two_way_split(table(spark, folder, "embeddings").select("vec_id"), "vec_id", 0.3, 7)


@query(
    "stratified_split",
    """with h as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by md5('42:' || o_orderkey)) as r,
      count(*) over (partition by o_orderpriority) as n from orders)
    select o_orderkey, o_orderpriority, case when r <= ceil(round(n * 0.2, 9)) then 'test'
      when r <= ceil(round(n * 0.2, 9)) + ceil(round((n - ceil(round(n * 0.2, 9))) * 0.25, 9)) then 'val' else 'train' end as split from h""",
)
def stratified_split(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return splits.stratified_splits(rows, "o_orderpriority", "o_orderkey")


@query(
    "shuffled_folds",
    "select o_orderkey, (ntile(7) over (order by md5('42:' || o_orderkey)) - 1)::bigint as fold from orders",
)
def shuffled_folds(spark, folder):
    rows = splits.shuffled_folds(table(spark, folder, "orders").select("o_orderkey"), 7, "o_orderkey")
    return rows.withColumn("fold", F.col("fold").cast("long"))


@query("contiguous_folds", "select event_id, (ntile(7) over (order by event_id) - 1)::bigint as fold from events")
def contiguous_folds(spark, folder):
    rows = splits.contiguous_folds(table(spark, folder, "events").select("event_id"), 7, "event_id")
    return rows.withColumn("fold", F.col("fold").cast("long"))


_STRENGTH = "r as (select k, abs(corr(v, label)) as score from l group by k)"


@query(
    "top_channels",
    with_views(T, L, _STRENGTH, body="select k::bigint as k, round(score, 6) as score from r order by r.score desc, k limit 10"),
)
def top_channels(spark, folder):
    found = stats.channel_correlation(spectra(spark, folder)).withColumn("score", F.abs("correlation"))
    top = select.top_channels(found, 10)
    return top.select(F.col("channel").cast("long").alias("k"), rounded("score").alias("score"))


@query(
    "top_channels_per_run",
    """select p_brand, p_partkey, p_size::bigint as p_size from (select *, row_number() over (partition by p_brand order by p_size desc, p_partkey) as r from part) where r <= 5""",
)
def top_channels_per_run(spark, folder):
    rows = table(spark, folder, "part").select("p_brand", F.col("p_partkey").alias("channel"), F.col("p_size").alias("score"))
    top = select.top_channels(rows, 5, by=["p_brand"])
    return top.select("p_brand", F.col("channel").alias("p_partkey"), F.col("score").cast("long").alias("p_size"))


@query(
    "top_channels_with_ties",
    """select p_brand, p_partkey, p_size::bigint as p_size from (select *, rank() over (partition by p_brand order by p_size desc) as r from part) where r <= 5""",
)
def top_channels_with_ties(spark, folder):
    rows = table(spark, folder, "part").select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("p_size"))
    return select.top_channels_with_ties(rows, 5, ["p_brand"], "p_size")


@query(
    "channels_above_threshold",
    with_views(T, L, _STRENGTH, body="select k::bigint as k, round(score, 6) as score from r where r.score >= 0.05"),
)
def channels_above_threshold(spark, folder):
    found = stats.channel_correlation(spectra(spark, folder)).withColumn("score", F.abs("correlation"))
    return select.channels_above(found, 0.05).select(F.col("channel").cast("long").alias("k"), rounded("score").alias("score"))


@query(
    "top_importances",
    """select p_brand as model, p_partkey as channel, p_retailprice as importance, r::bigint as rank from
    (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as r from part) where r <= 10""",
)
def top_importances(spark, folder):
    rows = table(spark, folder, "part").select(
        F.col("p_brand").alias("model"), F.col("p_partkey").alias("channel"), F.col("p_retailprice").alias("importance")
    )
    return rank.top_importances(rows, 10).withColumn("rank", F.col("rank").cast("long"))


def _results(spark, folder):
    """One result row per customer: metrics of the predicted orders."""
    rows = table(spark, folder, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("experiment"), F.col("o_orderpriority").alias("model"),
        F.col("o_totalprice").alias("label"), (F.col("o_totalprice") * 0.8 + F.col("o_custkey") * 25.0).alias("prediction"),
    )
    scored = stats.evaluate(rows, by=["experiment", "model"])
    return scored.select("experiment", "model", *[rounded(c, 4).alias(c) for c in ("rmse", "mae", "r2")])


_RESULTS = """q as (select 'c' || o_custkey as experiment, o_orderpriority as model, o_totalprice as y,
  o_totalprice * 0.8 + o_custkey * 25.0::double as f from orders),
 res as (select experiment, model, round(sqrt(avg((y - f) * (y - f))), 4) + 0.0 as rmse, round(avg(abs(y - f)), 4) + 0.0 as mae,
  round(case when var_pop(y) > 0 then 1 - avg((y - f) * (y - f)) / var_pop(y) else 0.0 end, 4) + 0.0 as r2 from q group by all)"""


@query("leaderboard", with_views(_RESULTS, body="select * from res order by rmse, experiment"))
def leaderboard(spark, folder):
    return rank.leaderboard(_results(spark, folder), "rmse")


@query("leaderboard_by_r2", with_views(_RESULTS, body="select * from res order by r2 desc, experiment"))
def leaderboard_by_r2(spark, folder):
    return rank.leaderboard(_results(spark, folder), "r2")


@query(
    "best_result_per_model",
    with_views(
        _RESULTS,
        body="""select experiment, model, rmse, mae, r2 from (select *, row_number() over (partition by model order by rmse, experiment) as n
        from res where mae > 1000) where n = 1""",
    ),
)
def best_result_per_model(spark, folder):
    undefined = F.when(F.col("mae") > 1000, F.col("rmse")).otherwise(F.lit(float("nan")))
    rows = _results(spark, folder).withColumn("rmse", undefined)
    return rank.best_row(rows, "rmse", by="model")


@query(
    "study_summary",
    with_views(
        _RESULTS,
        body="""select arg_min(experiment, row(rmse, experiment)) as best_experiment, min(rmse) as best_rmse,
        arg_min(r2, row(rmse, experiment)) as best_r2, arg_min(mae, row(rmse, experiment)) as best_mae,
        count(*)::bigint as num_experiments, count(rmse)::bigint as successful_experiments from res""",
    ),
)
def study_summary(spark, folder):
    return rank.study_summary(_results(spark, folder))


_HISTORY = """hist as (select l_suppkey as search, l_partkey as run, count(*)::bigint as n_selected, round(avg(l_discount), 6) as rmse
  from lineitem group by 1, 2)"""


def _history(spark, folder):
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("search"), F.col("l_partkey").alias("run"))
    return rows.agg(F.count(F.lit(1)).alias("n_selected"), rounded(F.avg("l_discount")).alias("rmse"))


@query(
    "nearest_subset_size",
    with_views(_HISTORY, body="select search, arg_min(run, row(abs(n_selected - 4), run)) as best_run from hist group by search"),
)
def nearest_subset_size(spark, folder):
    return select.best_runs(_history(spark, folder), 4)


@query(
    "first_minimum_error",
    with_views(_HISTORY, body="select search, arg_min(run, row(rmse, run)) as best_run from hist group by search"),
)
def first_minimum_error(spark, folder):
    return select.best_runs(_history(spark, folder))


@query(
    "columns_side_by_side",
    """select coalesce(c_custkey, s_suppkey) as row_id, c_acctbal, s_acctbal from customer full outer join supplier on c_custkey = s_suppkey""",
)
def columns_side_by_side(spark, folder):
    left = table(spark, folder, "customer").select(F.col("c_custkey").alias("row_id"), "c_acctbal")
    right = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("row_id"), "s_acctbal")
    return combine.beside(left, right, how="full_outer")


@query("targets_of_kept_rows", "select o_orderkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem where l_discount > 0.09)")
def targets_of_kept_rows(spark, folder):
    kept = table(spark, folder, "lineitem").filter("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    return combine.surviving(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), kept, "o_orderkey")


@query("removed_rows", "select o_orderkey, o_totalprice from orders where o_orderkey not in (select l_orderkey from lineitem where l_discount > 0.09)")
def removed_rows(spark, folder):
    kept = table(spark, folder, "lineitem").filter("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    return combine.removed(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), kept, "o_orderkey")


@query(
    "channel_params_applied",
    with_views(T, L, MEAN, body="select row_id, k::bigint as k, round(v - m, 6) + 0.0 as v from l join c using (k)"),
)
def channel_params_applied(spark, folder):
    from wavetable.operators.columns import to_long

    scans = spectra(spark, folder)
    joined = combine.apply_channel_params(to_long(scans), stats.mean_spectrum(scans))
    centred = rounded(F.col("value") - F.col("mean"))
    return joined.select("row_id", F.col("channel").cast("long").alias("k"), centred.alias("v"))


@query(
    "experiment_grid",
    """with m as (select distinct lower(p_type) as model_type, p_brand from part)
    select model_type, p_brand, u.method, u.n_features::bigint as n_features from m,
      (values ('vip', 20), ('vip', 50), ('cars', 20), ('cars', 50), ('ga', 20), ('ga', 50)) u(method, n_features)""",
)
def experiment_grid(spark, folder):
    models = table(spark, folder, "part").select(F.lower("p_type").alias("model_type"), "p_brand").distinct()
    methods = [{"method": m, "n_features": n} for m in ("vip", "cars", "ga") for n in (20, 50)]
    grid = combine.experiment_grid(models, methods)
    return grid.withColumn("n_features", F.col("n_features").cast("long"))


@query(
    "experiments_appended",
    """select lower(p_type) as model_type, 'none' as method, p_size::double as n_features from part
    union all by name select p_brand as model_type, 'manual' as method from part""",
)
def experiments_appended(spark, folder):
    part = table(spark, folder, "part")
    grid = part.select(F.lower("p_type").alias("model_type"), F.lit("none").alias("method"), F.col("p_size").cast("double").alias("n_features"))
    manual = part.select(F.col("p_brand").alias("model_type"), F.lit("manual").alias("method"))
    return combine.append_rows(grid, manual)


@query(
    "splits_stacked",
    """select o_orderkey, case o_orderstatus when 'F' then 'test' when 'O' then 'train' else 'val' end as split from orders""",
)
def splits_stacked(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    parts = {n: rows.filter(F.col("o_orderstatus") == s).drop("o_orderstatus") for n, s in (("train", "O"), ("val", "P"), ("test", "F"))}
    return splits.stack_splits(**parts)


@query("names_removed", "select c_custkey as key from customer except select o_custkey from orders where o_totalprice > 400000")
def names_removed(spark, folder):
    left = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"))
    right = table(spark, folder, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("key"))
    return combine.names_difference(left, right)


@query("names_merged", "select c_custkey as key from customer union select o_custkey from orders")
def names_merged(spark, folder):
    left = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"))
    return combine.names_union(left, table(spark, folder, "orders").select(F.col("o_custkey").alias("key")))


@query(
    "params_over_defaults",
    """select event_id, case when event_type = 'error' then value::varchar else '10' end as n_components,
    case when event_type = 'click' then 'true' else 'false' end as scale, '500' as max_iter from events""",
)
def params_over_defaults(spark, folder):
    defaults = F.create_map(*[F.lit(x) for x in ("n_components", "10", "scale", "false", "max_iter", "500")])
    given = F.when(F.col("event_type") == "error", F.create_map(F.lit("n_components"), F.col("value").cast("string"))).when(
        F.col("event_type") == "click", F.create_map(F.lit("scale"), F.lit("true"))
    )
    merged = table(spark, folder, "events").select("event_id", combine.merged_params(defaults, given).alias("p"))
    return merged.select("event_id", *[F.col("p")[k].alias(k) for k in ("n_components", "scale", "max_iter")])


@query(
    "models_compared",
    with_views(
        PREDICTED, SPLIT,
        body=f"""select model, 'rmse' as metric, rmse as value from
        (select o_orderpriority as model, split, {METRICS} from p join sp using (o_orderkey) group by all) where split = 'test'""",
    ),
)
def models_compared(spark, folder):
    rows = splits.assign_splits(predicted_orders(spark, folder), "o_orderkey").withColumnRenamed("o_orderpriority", "model")
    scored = rounded_metrics(stats.evaluate(rows, by=["model", "split"]), "model", "split")
    return rank.compare_models(scored, "rmse", "test")


@query(
    "best_trials",
    """with tr as (select user_id, event_id as trial, case when event_type <> 'error' then value end as value, event_type as choice from events)
    select user_id, arg_max(choice, row(coalesce(value, -1e308), -trial)) as choice, max(value) as best_score, count(*)::bigint as n_trials
    from tr group by user_id""",
)
def best_trials(spark, folder):
    trials = table(spark, folder, "events").select(
        "user_id", F.col("event_id").alias("trial"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.create_map(F.lit("choice"), F.col("event_type")).alias("params"),
    )
    best = rank.best_trial(trials, "user_id")
    return best.select("user_id", F.col("best_params")["choice"].alias("choice"), "best_score", "n_trials")
