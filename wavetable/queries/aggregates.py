"""Aggregations, metrics and moments."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetable.functions import spectral
from wavetable.operators import stats
from wavetable.operators.latent import fit_latent
from wavetable.operators.moments import gram_entries, moments
from wavetable.operators.splits import assign_splits
from wavetable.queries.registry import L, MEAN, T, long_values, query, rounded, spectra, table, with_views


@query("mean_spectrum", with_views(T, L, MEAN, body="select k::bigint as k, round(m, 6) + 0.0 as v from c"))
def mean_spectrum(spark, folder):
    return stats.mean_spectrum(spectra(spark, folder)).select(F.col("channel").cast("long").alias("k"), rounded("mean").alias("v"))


@query(
    "mean_spectrum_per_label",
    with_views(T, L, body="select label, k::bigint as k, round(avg(v), 6) + 0.0 as v from l group by label, k"),
)
def mean_spectrum_per_label(spark, folder):
    means = stats.mean_spectrum(spectra(spark, folder), by="label")
    return means.select("label", F.col("channel").cast("long").alias("k"), rounded("mean").alias("v"))


@query(
    "standardized_channels",
    with_views(T, L, MEAN, body="select row_id, k::bigint as k, round((v - m) / s, 6) + 0.0 as v from l join c using (k)"),
)
def standardized_channels(spark, folder):
    scans = spectra(spark, folder)
    _, mean, std = stats.channel_stats(scans)
    return long_values(scans.withColumn("spectrum", spectral.standardize("spectrum", mean, std)), "row_id")


_GRAM = """u as (select row_id, label::bigint as fold, 0 as i, 1.0::double as v from t
  union all select row_id, label::bigint, k + 1, v from l union all select row_id, label::bigint, 65, label from t)"""


@query(
    "moment_table_per_fold",
    with_views(
        T, L, _GRAM,
        body="""select a.fold, a.i::bigint as i, b.i::bigint as j, round(sum(a.v * b.v), 6) + 0.0 as value
        from u a join u b on a.row_id = b.row_id and a.i <= b.i group by a.fold, a.i, b.i""",
    ),
)
def moment_table_per_fold(spark, folder):
    entries = gram_entries(spectra(spark, folder), fold="label")
    return entries.select(
        F.col("fold").cast("long").alias("fold"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"),
        rounded("value").alias("value"),
    )


@query(
    "target_summary",
    """select min(o_totalprice) as min, max(o_totalprice) as max, round(avg(o_totalprice), 4) as mean,
    round(stddev_samp(o_totalprice), 4) as std, round(median(o_totalprice), 4) as median from orders""",
)
def target_summary(spark, folder):
    s = stats.target_summary(table(spark, folder, "orders"), "o_totalprice")
    return s.select("min", "max", *[rounded(c, 4).alias(c) for c in ("mean", "std", "median")])


@query("shape_report", "select count(*)::bigint as n_rows, 67::bigint as n_columns, 64::bigint as n_channels, 3::bigint as n_others from embeddings")
def shape_report(spark, folder):
    from wavetable.queries.registry import wide

    report = stats.shape_report(wide(spark, folder))
    return report.select(
        "n_rows", F.col("n_columns").cast("long").alias("n_columns"),
        F.size("spectral_columns").cast("long").alias("n_channels"), F.size("non_spectral_columns").cast("long").alias("n_others"),
    )


def predicted_orders(spark, folder):
    """A simple prediction of the order price: a linear function of the customer key."""
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").alias("label"),
        (F.col("o_totalprice") * 0.8 + F.col("o_custkey") * 25.0).alias("prediction"),
    )


PREDICTED = """p as (select o_orderkey, o_orderstatus, o_orderpriority, o_totalprice as y,
  o_totalprice * 0.8 + o_custkey * 25.0::double as f from orders)"""
METRICS = """round(sqrt(avg((y - f) * (y - f))), 4) as rmse, round(avg(abs(y - f)), 4) as mae,
  round(1 - avg((y - f) * (y - f)) / var_pop(y), 6) as r2, round(1 - var_pop(y - f) / var_pop(y), 6) as explained_variance"""


def rounded_metrics(df, *keys):
    return df.select(
        *keys, rounded("rmse", 4).alias("rmse"), rounded("mae", 4).alias("mae"), rounded("r2").alias("r2"),
        rounded("explained_variance").alias("explained_variance"),
    )


@query("regression_metrics", with_views(PREDICTED, body=f"select {METRICS} from p"))
def regression_metrics(spark, folder):
    return rounded_metrics(stats.evaluate(predicted_orders(spark, folder)))


@query(
    "rows_in_metrics",
    """select user_id, count(*) filter (where event_type <> 'error')::bigint as n,
    count(*) filter (where event_type = 'error')::bigint as n_skipped from events group by user_id""",
)
def rows_in_metrics(spark, folder):
    guess = F.when(F.col("event_type") != "error", F.col("value") * 0.9)
    rows = table(spark, folder, "events").select("user_id", F.col("value").alias("label"), guess.alias("prediction"))
    return stats.evaluate(rows, by="user_id").select("user_id", "n", "n_skipped")


SPLIT = """h as (select o_orderkey, row_number() over (order by md5('42:' || o_orderkey)) as r, count(*) over () as n from orders),
 sp as (select o_orderkey, case when r <= ceil(round(n * 0.2, 9)) then 'test'
   when r <= ceil(round(n * 0.2, 9)) + ceil(round((n - ceil(round(n * 0.2, 9))) * 0.25, 9)) then 'val' else 'train' end as split from h)"""


@query(
    "metrics_per_split",
    with_views(PREDICTED, SPLIT, body=f"select split, {METRICS} from p join sp using (o_orderkey) group by split"),
)
def metrics_per_split(spark, folder):
    rows = assign_splits(predicted_orders(spark, folder), "o_orderkey")
    return rounded_metrics(stats.evaluate(rows, by="split"), "split")


@query(
    "mean_numbers_per_type",
    "select p_type, round(avg(p_size), 6) as p_size, round(avg(p_retailprice), 6) as p_retailprice from part group by p_type",
)
def mean_numbers_per_type(spark, folder):
    means = stats.mean_numeric(table(spark, folder, "part").drop("p_partkey"), "p_type")
    return means.select("p_type", rounded("p_size").alias("p_size"), rounded("p_retailprice").alias("p_retailprice"))


_REPLICATE = {"mean": "avg", "median": "median", "max": "max", "min": "min"}


def _replicates(method):
    def run(spark, folder):
        rows = stats.replicate_columns(table(spark, folder, "events"), "user_id", ["value"], method)
        return rows.select("user_id", rounded("value").alias("value"))

    return run


def _replicate_spectra(method):
    def run(spark, folder):
        return long_values(stats.replicate_spectra(spectra(spark, folder), "label", method), "label")

    return run


for _method, _function in _REPLICATE.items():
    query(
        f"replicate_values_{_method}",
        f"select user_id, round({_function}(value), 6) + 0.0 as value from events group by user_id",
    )(_replicates(_method))
    query(
        f"replicate_spectra_{_method}",
        with_views(T, L, body=f"select label, k::bigint as k, round({_function}(v), 6) + 0.0 as v from l group by label, k"),
    )(_replicate_spectra(_method))


@query(
    "label_correlation",
    with_views(T, L, body="select k::bigint as k, round(corr(v, label), 6) + 0.0 as r from l group by k"),
)
def label_correlation(spark, folder):
    found = stats.channel_correlation(spectra(spark, folder))
    return found.select(F.col("channel").cast("long").alias("k"), rounded("correlation").alias("r"))


ONE_COMPONENT = """c as (select k, avg(v) as m, avg(label) as my from l group by k),
 w0 as (select k, m, sum((l.v - m) * (label - my)) as w from l join c using (k) group by k, m),
 w as (select k, m, w / sqrt(sum(w * w) over ()) as w from w0),
 s as (select row_id, label, sum((l.v - w.m) * w.w) as score from l join w using (k) group by row_id, label)"""


@query(
    "first_score_variance",
    with_views(T, L, ONE_COMPONENT, body="select round(var_pop(score), 8) as variance from s"),
)
def first_score_variance(spark, folder):
    fit = fit_latent(moments(spectra(spark, folder)), 1, False)
    scored = spectra(spark, folder).select(spectral.linear_score("spectrum", fit.rotations[:, 0], 0.0).alias("score"))
    return scored.agg(F.round(F.var_pop("score"), 8).alias("variance"))


@query(
    "mean_fold_scores",
    """with f as (select p_brand, p_size, avg(p_retailprice) as score from part group by p_brand, p_size)
    select p_brand, round(avg(score), 6) as mean_score, count(score)::bigint as folds from f group by p_brand""",
)
def mean_fold_scores(spark, folder):
    folds = table(spark, folder, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("score"))
    return stats.mean_fold_score(folds, "p_brand").select("p_brand", rounded("mean_score").alias("mean_score"), "folds")


@query(
    "generation_stats",
    """select user_id as generation, round(avg(value), 6) as avg, round(stddev_pop(value), 6) as std,
    min(value) as min, max(value) as max from events group by user_id""",
)
def generation_stats(spark, folder):
    rows = table(spark, folder, "events").select(F.col("user_id").alias("generation"), F.col("value").alias("score"))
    return stats.generation_stats(rows).select(
        "generation", rounded("avg").alias("avg"), rounded("std").alias("std"), "min", "max"
    )


@query(
    "latest_run_metrics",
    """with e as (select user_id::varchar as run_id, event_type as key, arg_max(value, row(epoch_us(ts), event_id)) as value
      from events group by 1, 2)
    select run_id, max(value) filter (key = 'click') as click, max(value) filter (key = 'error') as error,
      max(value) filter (key = 'purchase') as purchase, max(value) filter (key = 'signup') as signup,
      max(value) filter (key = 'view') as view from e group by run_id""",
)
def latest_run_metrics(spark, folder):
    log = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("key"), "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("step"), F.col("event_id").alias("ts"),
    )
    return stats.latest_metrics(log)
