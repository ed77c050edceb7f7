"""Duplicates, uninformative columns, missing values, filters and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetable.operators import clean, stats
from wavetable.operators.outliers import OutlierDetector
from wavetable.queries.registry import L, MEAN, T, query, rounded, spectra, table, two_channels, with_views
from wavetable.sources.runs import model_files, successful


def _repeated_events(spark, folder):
    """Events reduced to columns that repeat often."""
    return table(spark, folder, "events").select("event_id", "user_id", "event_type")


@query(
    "distinct_rows_keep_first",
    "select min(event_id) as event_id, user_id, event_type from events group by user_id, event_type",
)
def distinct_rows_keep_first(spark, folder):
    return clean.drop_duplicates(_repeated_events(spark, folder), "event_id")


@query("distinct_rows", "select distinct user_id, event_type, value from events")
def distinct_rows(spark, folder):
    return clean.drop_duplicates(table(spark, folder, "events").select("user_id", "event_type", "value"))


@query(
    "duplicate_census",
    """select coalesce(sum(n), 0)::bigint as duplicate_rows, coalesce(sum(n - 1), 0)::bigint as removed_rows from
    (select count(*) as n from events group by user_id, event_type, value having count(*) > 1)""",
)
def duplicate_census(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    return clean.duplicate_census(rows, "event_id")


def _with_dull_columns(spark, folder):
    """Orders with an empty, a constant and a constant-or-missing column."""
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice",
        F.lit(None).cast("double").alias("blank"),
        F.lit(7).alias("always_seven"),
        F.when(F.col("o_orderstatus") == "P", 1).alias("one_or_missing"),
    )


@query(
    "empty_columns_dropped",
    """select o_orderkey, o_orderstatus, o_totalprice, 7::bigint as always_seven,
    coalesce(case when o_orderstatus = 'P' then 1 end, -1)::bigint as one_or_missing from orders""",
)
def empty_columns_dropped(spark, folder):
    rows = clean.drop_uninformative(_with_dull_columns(spark, folder), constant=False)
    return rows.withColumn("always_seven", F.col("always_seven").cast("long")).withColumn(
        "one_or_missing", F.coalesce(F.col("one_or_missing"), F.lit(-1)).cast("long")
    )


@query(
    "uninformative_columns_dropped",
    """select o_orderkey, o_orderstatus, o_totalprice,
    coalesce(case when o_orderstatus = 'P' then 1 end, -1)::bigint as one_or_missing from orders""",
)
def uninformative_columns_dropped(spark, folder):
    rows = clean.drop_uninformative(_with_dull_columns(spark, folder))
    return rows.withColumn("one_or_missing", F.coalesce(F.col("one_or_missing"), F.lit(-1)).cast("long"))


_COUNTS = "n as (select row_id, count_if(abs((v - m) / s) > 2.0) as extreme from l join c using (k) group by row_id)"


@query(
    "outliers_zscore",
    with_views(T, L, MEAN, _COUNTS, body="select row_id, extreme::bigint as extreme_channels, extreme >= 3 as is_outlier from n"),
)
def outliers_zscore(spark, folder):
    scans = spectra(spark, folder)
    model = OutlierDetector(method="zscore", threshold=2.0, keepScores=True).fit(scans)
    return model.transform(scans).select(
        "row_id", F.col("extreme_channels").cast("long").alias("extreme_channels"), "is_outlier"
    )


@query(
    "inliers_with_label",
    with_views(T, L, MEAN, _COUNTS, body="select row_id, label from t join n using (row_id) where extreme < 3"),
)
def inliers_with_label(spark, folder):
    scans = spectra(spark, folder)
    model = OutlierDetector(method="zscore", threshold=2.0, removeOutliers=True).fit(scans)
    return model.transform(scans).select("row_id", "label")


_T2 = """a as (select row_id, x[1] as a, x[2] as b from t),
 m as (select avg(a) ma, avg(b) mb, stddev_pop(a) sa, stddev_pop(b) sb, corr(a, b) r, count(*) n from a),
 z as (select row_id, (a - ma) / sa as za, (b - mb) / sb as zb, r, n from a, m),
 t2 as (select row_id, za, zb, ((za + zb) * (za + zb) / (2 * (1 + r)) + (za - zb) * (za - zb) / (2 * (1 - r))) * (n - 1) / n as t2 from z),
 lim as (select avg(t2) + 2.0 * stddev_pop(t2) as cut from t2)"""


@query(
    "outliers_t2_two_channels",
    with_views(T, _T2, body="select row_id, round(t2, 6) + 0.0 as t2, t2 > cut as is_outlier from t2, lim"),
)
def outliers_t2_two_channels(spark, folder):
    scans = two_channels(spark, folder)
    model = OutlierDetector(method="pca", threshold=2.0, nComponents=2, keepScores=True).fit(scans)
    return model.transform(scans).select("row_id", rounded("t2").alias("t2"), "is_outlier")


@query(
    "outliers_either_method",
    with_views(
        T, _T2,
        body="select row_id, t2 > cut or abs(za) > 2.0 or abs(zb) > 2.0 as is_outlier from t2, lim",
    ),
)
def outliers_either_method(spark, folder):
    scans = two_channels(spark, folder)
    model = OutlierDetector(method="both", threshold=2.0, nComponents=2).fit(scans)
    return model.transform(scans).select("row_id", "is_outlier")


@query("outliers_t2_all_channels")
def outliers_t2_all_channels(spark, folder):
    scans = spectra(spark, folder)
    model = OutlierDetector(method="both", keepScores=True).fit(scans)
    return model.transform(scans).select("row_id", "extreme_channels", rounded("t2").alias("t2"), "is_outlier")


@query("labelled_rows", "select event_id, value as label from events where event_type <> 'error'")
def labelled_rows(spark, folder):
    blanked = F.when(F.col("event_type") != "error", F.col("value"))
    rows = table(spark, folder, "events").select("event_id", blanked.alias("label"))
    return clean.require_label(rows)


@query(
    "successful_results",
    "select o_orderkey, case when o_orderstatus = 'F' then 'failed' else 'ok' end as status from orders where o_orderstatus <> 'F'",
)
def successful_results(spark, folder):
    status = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok")
    return successful(table(spark, folder, "orders").select("o_orderkey", status.alias("status")))


_PATHS = """select p_partkey, 'models/' || lower(p_type) || '_' || p_name || case when p_size > 25 then '.pkl' else '.json' end as path from part"""


@query("saved_model_files", f"select * from ({_PATHS}) where path like '%.pkl'")
def saved_model_files(spark, folder):
    suffix = F.when(F.col("p_size") > 25, ".pkl").otherwise(".json")
    path = F.concat(F.lit("models/"), F.lower("p_type"), F.lit("_"), "p_name", suffix)
    return model_files(table(spark, folder, "part").select("p_partkey", path.alias("path")))


@query(
    "numeric_means_imputed",
    """with b as (select event_id, user_id, case when event_type <> 'error' then value end as value,
      case when value > 5 then length(props)::double end as size from events)
    select event_id, user_id, round(coalesce(value, avg(value) over ()), 6) + 0.0 as value,
      round(coalesce(size, avg(size) over ()), 6) + 0.0 as size from b""",
)
def numeric_means_imputed(spark, folder):
    rows = table(spark, folder, "events").select(
        "event_id", "user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("value") > 5, F.length("props").cast("double")).alias("size"),
    )
    done = clean.impute(rows, exclude=["event_id", "user_id"])
    return done.select("event_id", "user_id", rounded("value").alias("value"), rounded("size").alias("size"))


@query(
    "frequent_texts_imputed",
    """with b as (select o_orderkey, case when o_totalprice < 400000 then o_orderpriority end as o_orderpriority,
      nullif(o_orderstatus, 'P') as o_orderstatus from orders),
    p as (select o_orderpriority as f from b where o_orderpriority is not null group by 1 order by count(*) desc, 1 limit 1),
    s as (select o_orderstatus as f from b where o_orderstatus is not null group by 1 order by count(*) desc, 1 limit 1)
    select o_orderkey, coalesce(o_orderpriority, (select f from p)) as o_orderpriority,
      coalesce(o_orderstatus, (select f from s)) as o_orderstatus from b""",
)
def frequent_texts_imputed(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") < 400000, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"),
    )
    return clean.impute(rows, exclude=["o_orderkey"])


@query(
    "flag_and_missing_counts",
    """select count_if(value > 20)::bigint as high, count_if(event_type = 'error')::bigint as failed,
    count_if(event_type <> 'error' and value is null or event_type = 'error')::bigint as missing_value from events""",
)
def flag_and_missing_counts(spark, folder):
    rows = table(spark, folder, "events").select(
        (F.col("value") > 20).alias("high"), (F.col("event_type") == "error").alias("failed"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )
    flags = rows.withColumn("missing_value", F.col("value").isNull())
    return stats.flag_counts(flags, ["high", "failed", "missing_value"])


@query(
    "missing_per_column",
    "select 0::bigint as event_id, count_if(event_type = 'error')::bigint as value, 0::bigint as event_type from events",
)
def missing_per_column(spark, folder):
    rows = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"), "event_type"
    )
    return stats.missing_counts(rows)
