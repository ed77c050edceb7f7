"""Scalar functions on ids, names, stamps and logged values."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetable.functions import names
from wavetable.operators.clean import add_sample_id
from wavetable.operators.columns import rename_columns
from wavetable.queries.registry import query, rounded, table
from wavetable.sources.tables import prediction_table


@query(
    "sample_ids",
    """select event_id, user_id::varchar || '_' || event_type || '_' ||
    coalesce((case when value < 5 then null else round(value) end)::bigint::varchar, 'nan') as "Sample_ID" from events""",
)
def sample_ids(spark, folder):
    lab = F.when(F.col("value") >= 5, F.round("value").cast("long"))
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type", lab.alias("lab"))
    named = rename_columns(rows, {"user_id": "SAMPLE NO", "event_type": "plant", "lab": "wetlab ID"})
    return add_sample_id(named, "event_id").select("event_id", "Sample_ID")


@query(
    "sample_ids_by_position",
    """select o_orderkey, 'sample_' || (row_number() over (order by o_orderkey) - 1) as "Sample_ID" from orders""",
)
def sample_ids_by_position(spark, folder):
    return add_sample_id(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "decimal_comma_numbers",
    """select o_orderkey, text, try_cast(replace(text, ',', '.') as double) as number from
    (select o_orderkey, case when o_orderstatus = 'F' then floor(o_totalprice)::bigint::varchar || ',25'
      else floor(o_totalprice)::bigint::varchar || '.5' end as text from orders)""",
)
def decimal_comma_numbers(spark, folder):
    whole = F.floor("o_totalprice").cast("string")
    text = F.when(F.col("o_orderstatus") == "F", F.concat(whole, F.lit(",25"))).otherwise(F.concat(whole, F.lit(".5")))
    rows = table(spark, folder, "orders").select("o_orderkey", text.alias("text"))
    return rows.withColumn("number", names.decimal_comma("text"))


@query(
    "model_file_names",
    """with f as (select p_partkey, 'models/' || lower(p_type) || '_Brix_2025' || lpad(p_size::varchar, 4, '0') || '_1200' || p_size || '.pkl' as path from part),
    s as (select p_partkey, path, string_split(path, '/')[-1] as model_name from f)
    select p_partkey, model_name, string_split(model_name, '_')[1] as model_type, string_split(model_name, '_')[2] as target,
      replace(array_to_string(string_split(model_name, '_')[3:], '_'), '.pkl', '') as training_date from s""",
)
def model_file_names(spark, folder):
    size = F.col("p_size").cast("string")
    path = F.concat(
        F.lit("models/"), F.lower("p_type"), F.lit("_Brix_2025"), F.lpad(size, 4, "0"), F.lit("_1200"), size, F.lit(".pkl")
    )
    return table(spark, folder, "part").select("p_partkey", names.model_file_parts(path).alias("f")).select("p_partkey", "f.*")


@query(
    "experiment_names",
    """with s as (select p_partkey, lower(p_type) as model, case when p_size > 25 then 'snv' else 'none' end as transform,
      p_size > 20 as savgol, p_retailprice > 1200 as tuned,
      case when p_size > 40 then 'vip' when p_size > 30 then 'none' end as selection, p_size as n from part)
    select p_partkey,
      model || '_' || transform || case when savgol then '_savgol' else '' end || case when tuned then '_tuned' else '' end
        || case when selection = 'vip' then '_vip' || n else '' end as long_name,
      model || '_' || transform || case when savgol then '_sg15' else '' end
        || case when selection = 'vip' then '_vip' || n else '' end || case when tuned then '_tuned' else '' end as short_name from s""",
)
def experiment_names(spark, folder):
    rows = table(spark, folder, "part").select(
        "p_partkey", F.lower("p_type").alias("model"),
        F.when(F.col("p_size") > 25, "snv").otherwise("none").alias("transform"),
        (F.col("p_size") > 20).alias("savgol"), (F.col("p_retailprice") > 1200).alias("tuned"),
        F.when(F.col("p_size") > 40, "vip").when(F.col("p_size") > 30, "none").alias("selection"),
        F.col("p_size").alias("n"),
    )
    parts = ["model", "transform", F.col("savgol"), F.col("tuned"), F.col("selection"), F.col("n")]
    return rows.select(
        "p_partkey", names.experiment_name(*parts).alias("long_name"),
        names.experiment_name(*parts, window=F.lit(15)).alias("short_name"),
    )


@query("prediction_errors", "select o_orderkey, round(o_totalprice - o_custkey, 4) + 0.0 as error from orders")
def prediction_errors(spark, folder):
    judged = prediction_table(table(spark, folder, "orders"), "o_totalprice", "o_custkey", ["o_orderkey"])
    return judged.select("o_orderkey", rounded(F.col("error"), 4).alias("error"))


@query("event_stamps", "select event_id, strftime(ts, '%Y%m%d_%H%M%S') as stamp from events")
def event_stamps(spark, folder):
    return table(spark, folder, "events").select("event_id", names.stamp("ts").alias("stamp"))


@query(
    "run_durations",
    """with r as (select user_id, min(ts) as a, max(ts) as b from events group by user_id)
    select user_id, round(date_diff('microsecond', a, b) / 1e6, 6) as seconds,
      round((epoch_us(b) // 1000 - epoch_us(a) // 1000) / 1000.0, 3) as seconds_from_millis from r""",
)
def run_durations(spark, folder):
    runs = table(spark, folder, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    millis = [F.unix_millis(F.col(c).cast("timestamp")) for c in ("a", "b")]
    return runs.select(
        "user_id", F.round(names.seconds_between("a", "b"), 6).alias("seconds"),
        F.round(names.seconds_between_millis(*millis), 3).alias("seconds_from_millis"),
    )


@query(
    "short_labels",
    """select c_custkey, label, case when length(label) > 15 then substring(label, 1, 12) || '...' else label end as short
    from (select c_custkey, case when c_acctbal > 5000 then c_name else c_mktsegment end as label from customer)""",
)
def short_labels(spark, folder):
    label = F.when(F.col("c_acctbal") > 5000, F.col("c_name")).otherwise(F.col("c_mktsegment"))
    rows = table(spark, folder, "customer").select("c_custkey", label.alias("label"))
    return rows.withColumn("short", names.short_label("label"))


@query(
    "logged_values",
    """select event_id, '["' || event_type || '",' || user_id || ']' as params, try_cast(json_extract_string(props, '$.k') as double) as number,
    user_id::varchar as text from events""",
)
def logged_values(spark, folder):
    rows = table(spark, folder, "events")
    pair = F.concat(F.lit('["'), "event_type", F.lit('",'), F.col("user_id").cast("string"), F.lit("]"))
    listed = F.from_json(pair, "array<string>")
    as_json = F.regexp_replace(names.log_json(listed), '"(\\d+)"', "$1")
    return rows.select(
        "event_id", as_json.alias("params"), names.log_number(F.get_json_object("props", "$.k")).alias("number"),
        names.log_text(F.col("user_id")).alias("text"),
    )
