"""Reading and writing, each checked by what is read back."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from wavetable.operators import rank, select, splits, stats
from wavetable.operators.transform import MSC, SNV
from wavetable.queries.aggregates import METRICS, PREDICTED, SPLIT, predicted_orders, rounded_metrics
from wavetable.queries.registry import (
    L, MEAN, MSC as MSC_SQL, SNV as SNV_SQL, T, long_values, query, rounded, scratch, spectra, table, values_of, with_views,
)
from wavetable.sources import runs, tables


@query("csv_scan", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def csv_scan(spark, folder):
    path = f"{scratch(spark)}/orders.csv"
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    tables.write_table(table(spark, folder, "orders").select(*columns), path, "csv")
    return tables.read_table(spark, path).select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), *columns[2:])


@query(
    "content_ids",
    """select o_orderstatus, o_orderpriority, count(*) as n, count(*) as ids, 0::bigint as first_copy, count(*) - 1 as last_copy
      from orders group by all""",
)
def content_ids(spark, folder):
    """Ids of rows that have many copies: all different, numbered without gaps."""
    rows = tables.content_id(table(spark, folder, "orders").select("o_orderstatus", "o_orderpriority"))
    copy = F.substring_index("row_id", "-", -1).cast("long")
    return rows.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids"), F.min(copy).alias("first_copy"), F.max(copy).alias("last_copy")
    )


@query(
    "run_log_buffered",
    """select c_nationkey::varchar as experiment, c_custkey::varchar as run_id, key, value from (select c_nationkey, c_custkey, 'acctbal' as key,
      c_acctbal as value from customer union all select c_nationkey, c_custkey, 'acctbal2', c_acctbal * 2 from customer)""",
)
def run_log_buffered(spark, folder):
    """A log of many small appends, compacted and read again."""
    place = scratch(spark)
    runs_of = table(spark, folder, "customer").select(
        F.col("c_nationkey").cast("string").alias("experiment"), F.col("c_custkey").cast("string").alias("run_id"), F.col("c_acctbal").alias("value")
    )
    for key, value in (("acctbal", F.col("value")), ("acctbal2", F.col("value") * 2)):
        entries = runs_of.select("experiment", "run_id", F.lit(key).alias("key"), value.cast("double").alias("value"), F.lit(0).cast("long").alias("ts"), F.lit(0).cast("long").alias("step"))
        runs.append_log(entries, f"{place}/many", "run_metrics")
    runs.compact_log(spark, f"{place}/many", f"{place}/few", "run_metrics")
    log = runs.read_log(spark, f"{place}/few", "run_metrics")
    return log.select(F.col("experiment").cast("string").alias("experiment"), "run_id", "key", "value")


@query(
    "formats_by_suffix",
    """select f as format, p_partkey, p_name, p_retailprice from part, (values ('csv'), ('parquet'), ('json'), ('orc')) v(f)""",
)
def formats_by_suffix(spark, folder):
    place = scratch(spark)
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")
    rows = None
    for name in ("csv", "parquet", "json", "orc"):
        path = f"{place}/part.{name}"
        tables.write_table(part, path, name)
        one = tables.read_table(spark, path).select(
            F.lit(name).alias("format"), F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_retailprice"
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


_EMBEDDING_SPLIT = """h as (select vec_id, label, embedding, row_number() over (order by md5('42:' || vec_id)) as r, count(*) over () as n from embeddings),
 sp as (select vec_id as row_id, label::double as label, embedding[1]::double as first,
   case when r <= ceil(round(n * 0.2, 9)) then 'test'
   when r <= ceil(round(n * 0.2, 9)) + ceil(round((n - ceil(round(n * 0.2, 9))) * 0.25, 9)) then 'val' else 'train' end as split from h)"""


@query("dataset_as_csv", with_views(_EMBEDDING_SPLIT, body="select row_id, label, split, round(first, 6) + 0.0 as first from sp"))
def dataset_as_csv(spark, folder):
    place = scratch(spark)
    data = splits.assign_splits(spectra(spark, folder))
    tables.write_dataset(data, place, {"rows": "all"}, format="csv")
    features = spark.read.csv(f"{place}/features", header=True, inferSchema=True)
    target = spark.read.csv(f"{place}/target", header=True, inferSchema=True)
    return features.join(target, "row_id").select(
        F.col("row_id").cast("long").alias("row_id"), "label", "split", rounded(F.col("`900`")).alias("first")
    )


@query("dataset_as_parquet_with_model", with_views(T, L, SNV_SQL, body=values_of("s")))
def dataset_as_parquet_with_model(spark, folder):
    place = scratch(spark)
    data = spectra(spark, folder)
    model = Pipeline(stages=[SNV()]).fit(data)
    tables.write_dataset(data, place, {"method": "snv"}, model)
    again = type(model).load(f"{place}/model")
    return long_values(again.transform(spark.read.parquet(f"{place}/features")), "row_id")


@query("splits_table", with_views(_EMBEDDING_SPLIT, body='select row_id as "index", split from sp'))
def splits_table(spark, folder):
    place = scratch(spark)
    tables.write_table(tables.split_table(splits.assign_splits(spectra(spark, folder))), place)
    return spark.read.parquet(place)


@query("predictions_table", with_views(PREDICTED, body="select o_orderkey, y as actual, round(f, 4) + 0.0 as predicted, round(y - f, 4) + 0.0 as error from p"))
def predictions_table(spark, folder):
    place = scratch(spark)
    tables.write_table(tables.prediction_table(predicted_orders(spark, folder), keys=["o_orderkey"]), place)
    rows = spark.read.parquet(place)
    return rows.select("o_orderkey", "actual", rounded("predicted", 4).alias("predicted"), rounded("error", 4).alias("error"))


@query(
    "metrics_table",
    with_views(
        PREDICTED, SPLIT,
        f"m as (select o_orderpriority as experiment, split, {METRICS} from p join sp using (o_orderkey) group by all)",
        body="unpivot m on rmse, mae, r2, explained_variance into name metric value value",
    ),
)
def metrics_table(spark, folder):
    place = scratch(spark)
    rows = splits.assign_splits(predicted_orders(spark, folder), "o_orderkey").withColumnRenamed("o_orderpriority", "experiment")
    wide = rounded_metrics(stats.evaluate(rows, by=["experiment", "split"]), "experiment", "split")
    tables.write_table(tables.metrics_table(wide), place)
    return spark.read.parquet(place)


@query(
    "selected_channels_table",
    with_views(
        T, L, "r as (select k, abs(corr(v, label)) as score from l group by k)",
        body="select k::bigint as feature_index, 900.0::double + 10 * k as wavelength from (select *, rank() over (order by score desc) as n from r) where n <= 12",
    ),
)
def selected_channels_table(spark, folder):
    place = scratch(spark)
    found = select.VIPSelector(nComponents=1, nFeatures=12).fit(spectra(spark, folder))
    tables.write_table(tables.selected_table(found.table(spark)), place)
    return spark.read.parquet(place).select(F.col("feature_index").cast("long").alias("feature_index"), "wavelength")


@query("saved_model", with_views(T, L, MEAN, MSC_SQL, body=values_of("msc", 3)))
def saved_model(spark, folder):
    scans = spectra(spark, folder)
    path = tables.save_model(MSC().fit(scans), scratch(spark), {"kind": "msc"}, spark)
    model, _ = tables.load_model(path, spark)
    return long_values(model.transform(scans), "row_id", digits=3)


@query(
    "trials_table",
    """select event_id as trial, value, case when event_type = 'error' then 'failed' else 'complete' end as state, event_type as choice from events""",
)
def trials_table(spark, folder):
    place = scratch(spark)
    state = F.when(F.col("event_type") == "error", "failed").otherwise("complete")
    params = F.create_map(F.lit("choice"), F.col("event_type"))
    trials = table(spark, folder, "events").select(F.col("event_id").alias("trial"), "value", state.alias("state"), params.alias("params"))
    tables.write_table(trials, place)
    return spark.read.parquet(place).select("trial", "value", "state", F.col("params")["choice"].alias("choice"))


@query(
    "results_table",
    """select p_brand as experiment, round(avg(p_retailprice), 4) as rmse, round(avg(p_size), 4) as mae from part group by p_brand""",
)
def results_table(spark, folder):
    place = scratch(spark)
    rows = table(spark, folder, "part").groupBy(F.col("p_brand").alias("experiment")).agg(
        rounded(F.avg("p_retailprice"), 4).alias("rmse"), rounded(F.avg("p_size"), 4).alias("mae")
    )
    tables.write_table(rank.leaderboard(rows), place, "csv")
    return tables.read_table(spark, place, format="csv", row_id=None, schema="experiment string, rmse double, mae double")


@query(
    "run_log_lines",
    """select user_id::varchar as run_id, event_type as key, value, epoch_us(ts) // 1000 as ts, event_id as step from events""",
)
def run_log_lines(spark, folder):
    """Events written as ``ts value step`` lines and parsed again."""
    place = scratch(spark)
    millis = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    lines = table(spark, folder, "events").select(
        F.lit("events").alias("experiment"), F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("key"),
        F.concat_ws(" ", millis.cast("string"), F.col("value").cast("string"), F.col("event_id").cast("string")).alias("value"),
    )
    lines.write.partitionBy("experiment", "key").csv(place, sep="\t")
    back = spark.read.schema("run_id string, value string, experiment string, key string").csv(place, sep="\t")
    return runs.metric_lines(back).drop("experiment")


@query(
    "run_log_files",
    """select 'events' as experiment, strftime(ts, '%Y%m%d') as run_id, event_type as key, value, epoch_us(ts) // 1000 as ts,
      event_id as step from events""",
)
def run_log_files(spark, folder):
    """A run a day, a file for each of its metrics, scanned again."""
    place = scratch(spark)
    entries = table(spark, folder, "events").select(
        F.lit("events").alias("experiment"), F.date_format("ts", "yyyyMMdd").alias("run_id"), F.col("event_type").alias("key"),
        "value", F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ts"), F.col("event_id").alias("step"),
    )
    runs.write_run_files(entries, place)
    return runs.scan_metrics(spark, place)


@query(
    "run_param_files",
    """select 'nation ' || s_nationkey as experiment, s_suppkey::varchar as run_id, unnest(['name', 'nation']) as key,
      unnest([s_name, s_nationkey::varchar]) as value from supplier""",
)
def run_param_files(spark, folder):
    """A run for each supplier, a file for each of its parameters, scanned again."""
    place = scratch(spark)
    params = F.create_map(F.lit("name"), F.col("s_name"), F.lit("nation"), F.col("s_nationkey").cast("string"))
    entries = table(spark, folder, "supplier").select(
        F.concat(F.lit("nation "), F.col("s_nationkey")).alias("experiment"), F.col("s_suppkey").cast("string").alias("run_id"), F.explode(params),
    )
    runs.write_run_files(entries, place, "params")
    return runs.scan_params(spark, place)


@query(
    "run_log_appended",
    """select user_id::varchar as run_id, event_type as key, value, epoch_us(ts) as ts, event_id as step from events""",
)
def run_log_appended(spark, folder):
    place = scratch(spark)
    rows = table(spark, folder, "events").select(
        F.col("event_type").alias("experiment"), F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("key"),
        "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("step"),
    )
    for half in (rows.filter("value < 10"), rows.filter("value >= 10")):
        runs.append_log(half, place, "run_metrics")
    return runs.read_log(spark, place, "run_metrics").drop("experiment")


@query(
    "model_catalogue",
    """select 'models/' || lower(p_type) || '_Brix_' || p_partkey || '.pkl' as model_file, lower(p_type) as model_type, 'Brix' as target,
      p_partkey::varchar as training_date,
      case when p_size > 45 then null else p_retailprice end as rmse, case when p_size > 45 then null else p_size::double end as mae,
      case when p_size > 45 then 'unreadable document' end as error from part""",
)
def model_catalogue(spark, folder):
    """Info documents with nested, flat and broken content."""
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    metrics = F.struct(price.alias("rmse"), size.alias("mae"))
    nested = F.to_json(F.struct(metrics.alias("metrics")))
    document = F.when(F.col("p_size") > 45, "{broken").when(F.col("p_size") > 20, nested).otherwise(F.to_json(metrics))
    path = F.concat(F.lit("models/"), F.lower("p_type"), F.lit("_Brix_"), F.col("p_partkey").cast("string"), F.lit(".pkl"))
    documents = table(spark, folder, "part").select(path.alias("model_file"), document.alias("value"))
    found = runs.describe_models(documents)
    return found.select("model_file", "model_type", "target", "training_date", "rmse", "mae", "error")


@query(
    "catalogue_top_features",
    """select model_file, feature, importance from (select 'rf_Brix_' || p_brand || '.pkl' as model_file, 'feature_' || p_partkey as feature,
      p_retailprice as importance, row_number() over (partition by p_brand order by p_retailprice desc, 'feature_' || p_partkey) as n from part) where n <= 10""",
)
def catalogue_top_features(spark, folder):
    entry = F.struct(F.concat(F.lit("feature_"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_retailprice").alias("value"))
    documents = table(spark, folder, "part").groupBy("p_brand").agg(F.map_from_entries(F.collect_list(entry)).alias("importances"))
    documents = documents.select(
        F.concat(F.lit("rf_Brix_"), "p_brand", F.lit(".pkl")).alias("model_file"),
        F.to_json(F.struct("importances")).alias("value"),
    )
    tops = runs.describe_models(documents).select("model_file", F.explode("top_features").alias("t"))
    return tops.select("model_file", F.col("t.key").alias("feature"), F.col("t.value").alias("importance"))


