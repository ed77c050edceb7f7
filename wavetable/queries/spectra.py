"""Channel schema and per-spectrum corrections."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from wavetable.functions import spectral
from wavetable.operators import columns, stats
from wavetable.operators.transform import MSC, SNV, ChannelScaler, ColumnFunction
from wavetable.plans.chains import build_chain, chains, correction_stages
from wavetable.plans.jobs import process_spectra
from wavetable.queries.registry import (
    L,
    MEAN,
    MSC as MSC_SQL,
    NAMES,
    SNV as SNV_SQL,
    T,
    long_values,
    query,
    rounded,
    savgol_view,
    spectra,
    table,
    two_channels,
    values_of,
    wide,
    with_views,
)


@query(
    "channel_columns",
    with_views(T, L, body="select row_id, k::bigint as k, 900.0::double + 10 * k as wavelength, v from l"),
)
def channel_columns(spark, folder):
    scans = wide(spark, folder)
    channels, _ = columns.split_columns(scans)
    long = columns.to_long(columns.pack(scans, channels))
    return long.select("row_id", F.col("channel").cast("long").alias("k"), "wavelength", F.col("value").alias("v"))


@query(
    "wl_channel_numbers",
    """select * from (select p_partkey, name,
      try_cast(nullif(regexp_extract(name, '^wl_([^_]*)', 1), '') as integer)::bigint as number
    from (select p_partkey, unnest(['wl_' || p_size, p_name, 'wl_' || p_brand, 'wl_' || p_size || '_b']) as name from part)) where number is not null""",
)
def wl_channel_numbers(spark, folder):
    size = F.col("p_size").cast("string")
    names = F.array(
        F.concat(F.lit("wl_"), size), F.col("p_name"), F.concat(F.lit("wl_"), "p_brand"),
        F.concat(F.lit("wl_"), size, F.lit("_b")),
    )
    from wavetable.functions.names import channel_number

    rows = table(spark, folder, "part").select("p_partkey", F.explode(names).alias("name"))
    return rows.withColumn("number", channel_number("name").cast("long")).filter("number is not null")


@query(
    "wide_pack_unpack",
    "select vec_id as row_id, " + ", ".join(f'embedding[{i + 1}]::double as "{n}"' for i, n in enumerate(NAMES)) + " from embeddings",
)
def wide_pack_unpack(spark, folder):
    return columns.unpack(columns.pack(wide(spark, folder).drop("Brix", "Lab")))


@query("long_round_trip", with_views(T, L, body=values_of("l")))
def long_round_trip(spark, folder):
    return long_values(columns.from_long(columns.to_long(spectra(spark, folder))), "row_id")


@query(
    "numeric_features",
    "select l_linenumber::bigint as l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax from lineitem",
)
def numeric_features(spark, folder):
    numeric = columns.filter_numeric(table(spark, folder, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"])
    return numeric.withColumn("l_linenumber", F.col("l_linenumber").cast("long"))


@query("kept_features", "select o_orderpriority, o_totalprice from orders")
def kept_features(spark, folder):
    return columns.filter_numeric(table(spark, folder, "orders"), keep=["o_orderpriority", "o_totalprice", "absent"])


@query(
    "restricted_features",
    "select vec_id as row_id, " + ", ".join(f'embedding[{i + 1}]::double as "{n}"' for i, n in enumerate(NAMES) if n != "900")
    + ", label::double as \"Brix\" from embeddings",
)
def restricted_features(spark, folder):
    return columns.restrict_features(wide(spark, folder), ["900"], ["Brix", "absent"], always=["row_id"])


@query("target_in_row", "select o_orderkey, o_totalprice as label from orders")
def target_in_row(spark, folder):
    return columns.with_target(table(spark, folder, "orders"), "o_totalprice").select("o_orderkey", "label")


@query(
    "extra_features_appended",
    with_views(T, L, body=values_of("(select row_id, k, v from l union all select row_id, 64, label from t)")),
)
def extra_features_appended(spark, folder):
    scans = wide(spark, folder)
    return long_values(columns.pack(scans, extras=["Brix"]), "row_id")


@query(
    "channel_subset",
    "select vec_id as row_id, unnest([0, 1, 2, 3])::bigint as k, round(unnest([embedding[4], embedding[18], embedding[41], embedding[64]])::double, 6) + 0.0 as v from embeddings",
)
def channel_subset(spark, folder):
    return long_values(spectra(spark, folder).withColumn("spectrum", spectral.take_channels("spectrum", [3, 17, 40, 63])), "row_id")


@query(
    "generic_channel_names",
    "select vec_id as row_id, " + ", ".join(f"embedding[{i + 1}]::double as feature_{i}" for i in range(64)) + " from embeddings",
)
def generic_channel_names(spark, folder):
    return columns.unpack(spectra(spark, folder).select("row_id", "spectrum"), columns.generic_names(64))


@query("renamed_columns", "select s_suppkey as id, s_name as name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier")
def renamed_columns(spark, folder):
    fixed = columns.rename_columns(table(spark, folder, "supplier"), {"s_suppkey": "id", "s_name": "name"})
    return columns.rename_columns(fixed).withColumn("s_nationkey", F.col("s_nationkey").cast("long"))


@query("snv", with_views(T, L, SNV_SQL, body=values_of("s")))
def snv(spark, folder):
    return long_values(SNV().transform(spectra(spark, folder)), "row_id")


def _savgol(deriv):
    def run(spark, folder):
        return long_values(spectra(spark, folder).withColumn("spectrum", spectral.savgol("spectrum", 15, 2, deriv)), "row_id")

    return run


for _order, _name in enumerate(["savgol_smooth", "savgol_first_derivative", "savgol_second_derivative"]):
    query(_name, with_views(T, L, savgol_view("l", "f", _order), body=values_of("f")))(_savgol(_order))


@query("msc", with_views(T, L, MEAN, MSC_SQL, body=values_of("msc", 3)))
def msc(spark, folder):
    scans = spectra(spark, folder)
    return long_values(MSC().fit(scans).transform(scans), "row_id", digits=3)


@query(
    "correction_keeps_other_columns",
    with_views(T, L, SNV_SQL, body="select row_id, label, k::bigint as k, round(v, 6) + 0.0 as v from s"),
)
def correction_keeps_other_columns(spark, folder):
    return long_values(SNV().transform(spectra(spark, folder)), "row_id", "label")


@query(
    "transform_by_name",
    with_views(
        T, L, SNV_SQL, MEAN, MSC_SQL, savgol_view("l", "f", 0),
        body="""select 'none' as method, row_id, k::bigint as k, round(v, 3) + 0.0 as v from l
        union all select 'snv', row_id, k::bigint, round(v, 3) + 0.0 from s
        union all select 'msc', row_id, k::bigint, round(v, 3) + 0.0 from msc
        union all select 'savgol', row_id, k::bigint, round(v, 3) + 0.0 from f""",
    ),
)
def transform_by_name(spark, folder):
    scans = spectra(spark, folder)
    _, mean, _ = stats.channel_stats(scans)
    outs = F.array(
        *[
            F.struct(F.lit(m).alias("method"), spectral.spectral_transform("spectrum", m, reference=mean).alias("spectrum"))
            for m in ("none", "snv", "msc", "savgol")
        ]
    )
    rows = scans.select("row_id", F.explode(outs).alias("o")).select("row_id", "o.*")
    return long_values(rows, "method", "row_id", digits=3)


_CHAIN_SQL = {
    "raw": (T, L, MEAN, "raw as (select row_id, k, (v - m) / s as v from l join c using (k))"),
    "snv": (T, L, SNV_SQL, "snv as (select * from s)"),
    "sg1": (T, L, savgol_view("l", "sg1", 1)),
    "sg2": (T, L, savgol_view("l", "sg2", 2)),
    "msc": (T, L, MEAN, MSC_SQL),
}


def _chain(name, digits):
    def run(spark, folder):
        scans = spectra(spark, folder)
        return long_values(Pipeline(stages=chains()[name]).fit(scans).transform(scans), "row_id", digits=digits)

    return run


for _name, _views in _CHAIN_SQL.items():
    _digits = 3 if _name == "msc" else 6
    query(f"chain_{_name}", with_views(*_views, body=values_of(_name, _digits)))(_chain(_name, _digits))


def _chain_pca(name):
    def run(spark, folder):
        scans = spectra(spark, folder)
        return long_values(Pipeline(stages=chains()[name]).fit(scans).transform(scans), "row_id")

    return run


for _name in ("snv_pca", "sg1_pca"):
    query(f"chain_{_name}")(_chain_pca(_name))


@query(
    "chain_with_detector_and_custom_step",
    with_views(
        T, L, MEAN, SNV_SQL,
        "z as (select row_id, count_if(abs((v - m) / s) > 2.0) >= 3 as is_outlier from l join c using (k) group by row_id)",
        "d as (select k, avg(v) as m, stddev_pop(v) as sd from s group by k)",
        body="""select row_id, is_outlier, k::bigint as k, round((v - m) / sd, 6) + 0.0 as v
        from s join d using (k) join z using (row_id)""",
    ),
)
def chain_with_detector_and_custom_step(spark, folder):
    scans = spectra(spark, folder)
    chain = build_chain("snv", outliers=True, threshold=2.0, custom=[ChannelScaler()])
    return long_values(chain.fit(scans).transform(scans), "row_id", "is_outlier")


@query("ordered_transformers", with_views(T, L, SNV_SQL, savgol_view("s", "f", 1), body=values_of("f")))
def ordered_transformers(spark, folder):
    scans = spectra(spark, folder)
    stages = correction_stages("snv", True, 15, 2, 1)
    return long_values(Pipeline(stages=stages).fit(scans).transform(scans), "row_id")


@query("msc_then_savgol", with_views(T, L, MEAN, MSC_SQL, savgol_view("msc", "f", 1), body=values_of("f", 3)))
def msc_then_savgol(spark, folder):
    scans = spectra(spark, folder)
    stages = correction_stages("msc", True, 15, 2, 1)
    return long_values(Pipeline(stages=stages).fit(scans).transform(scans), "row_id", digits=3)


def absorbance(block: np.ndarray) -> np.ndarray:
    """Example of a user transformer: -log10 of a reflectance made positive."""
    return -np.log10(np.abs(block) + 1.0)


@query(
    "user_transformer",
    with_views(T, L, body=values_of("(select row_id, k, -log10(abs(v) + 1) as v from l)")),
)
def user_transformer(spark, folder):
    step = ColumnFunction(function="wavetable.queries.spectra:absorbance")
    return long_values(step.transform(spectra(spark, folder)), "row_id")


@query("processed_spectra", with_views(T, L, SNV_SQL, savgol_view("s", "f", 0), body=values_of("f")))
def processed_spectra(spark, folder):
    done = process_spectra(wide(spark, folder), "Brix", "snv", savgol=True, window=15, polyorder=2, deriv=0)
    return long_values(done.table, "row_id")


@query(
    "component_columns",
    with_views(
        T,
        "a as (select row_id, x[1] as a, x[2] as b from t)",
        "m as (select avg(a) ma, avg(b) mb, stddev_pop(a) sa, stddev_pop(b) sb, sign(corr(a, b)) r from a)",
        "z as (select row_id, (a - ma) / sa as za, (b - mb) / sb as zb, r from a, m)",
        body="""select row_id, round(abs((za + r * zb) / sqrt(2.0)), 6) as "PC1",
        round(abs((za - r * zb) / sqrt(2.0)), 6) as "PC2" from z""",
    ),
)
def component_columns(spark, folder):
    from wavetable.operators.transform import ChannelPCA

    scans = two_channels(spark, folder).select("row_id", "spectrum")
    scores = ChannelPCA(nComponents=2, asColumns=True).fit(scans).transform(scans)
    return scores.select("row_id", rounded(F.abs("PC1")).alias("PC1"), rounded(F.abs("PC2")).alias("PC2"))
