"""Decomposition, regression, selection, search, experiments and streaming."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from wavetable.functions.metrics import rmse
from wavetable.functions.spectral import take_channels
from wavetable.operators import regress, search, select, stats
from wavetable.operators.latent import PLSRegressor
from wavetable.operators.moments import moments
from wavetable.operators.outliers import OutlierDetector
from wavetable.operators.splits import assign_splits
from wavetable.operators.transform import SNV, ChannelPCA, SavGol
from wavetable.plans import jobs
from wavetable.queries.aggregates import METRICS, ONE_COMPONENT, rounded_metrics
from wavetable.queries.registry import (
    L, NAMES, T, long_values, query, rounded, scratch, spectra, table, two_channels, wide, with_views,
)
from wavetable.sources import tables
from wavetable.streaming.score import read_scans, score_stream, write_scores


@query("flagship_metrics")
def flagship_metrics(spark, folder):
    """SNV, Savitzky-Golay, T2 outlier filter and PLS, learnt on train; metrics per split."""
    scans = assign_splits(spectra(spark, folder))
    chain = Pipeline(
        stages=[SNV(), SavGol(), OutlierDetector(method="pca", removeOutliers=True), PLSRegressor(nComponents=10)]
    )
    model = chain.fit(scans.filter("split = 'train'"))
    return stats.evaluate(model.transform(scans), by="split")


_PC = """a as (select row_id, x[1] as a, x[2] as b from t),
 m as (select avg(a) ma, avg(b) mb, stddev_pop(a) sa, stddev_pop(b) sb, sign(corr(a, b)) r from a),
 z as (select row_id, (a - ma) / sa as za, (b - mb) / sb as zb, r from a, m),
 pc as (select row_id, (za + r * zb) / sqrt(2.0) as p1, (za - r * zb) / sqrt(2.0) as p2 from z)"""


@query(
    "pca_two_channels",
    with_views(
        T, _PC,
        body="select row_id, 0::bigint as k, round(abs(p1), 6) as v from pc union all select row_id, 1, round(abs(p2), 6) from pc",
    ),
)
def pca_two_channels(spark, folder):
    scans = two_channels(spark, folder)
    scores = ChannelPCA(nComponents=2).fit(scans).transform(scans)
    return long_values(scores.withColumn("spectrum", F.transform("spectrum", F.abs)), "row_id")


@query("pca_scores")
def pca_scores(spark, folder):
    scans = spectra(spark, folder)
    return long_values(ChannelPCA(nComponents=10).fit(scans).transform(scans), "row_id")


_PREDICT = """p as (select row_id, label, my + (sum(score * (label - my)) over () / sum(score * score) over ()) * score as f
  from s, (select avg(label) as my from t))"""


@query(
    "pls_one_component",
    with_views(T, L, ONE_COMPONENT, _PREDICT, body="select row_id, round(f, 6) + 0.0 as prediction from p"),
)
def pls_one_component(spark, folder):
    scans = spectra(spark, folder)
    scored = PLSRegressor(nComponents=1).fit(scans).transform(scans)
    return scored.select("row_id", rounded("prediction").alias("prediction"))


@query(
    "pls_full_rank_two_channels",
    with_views(
        T,
        "a as (select row_id, label as y, x[1] as a, x[2] as b from t)",
        """m as (select avg(a) ma, avg(b) mb, avg(y) my, var_pop(a) aa, var_pop(b) bb, covar_pop(a, b) ab,
          covar_pop(a, y) ay, covar_pop(b, y) byy from a)""",
        body="""select row_id, round(my + (a - ma) * (ay * bb - byy * ab) / (aa * bb - ab * ab)
          + (b - mb) * (byy * aa - ay * ab) / (aa * bb - ab * ab), 6) + 0.0 as prediction from a, m""",
    ),
)
def pls_full_rank_two_channels(spark, folder):
    scans = two_channels(spark, folder)
    scored = PLSRegressor(nComponents=2).fit(scans).transform(scans)
    return scored.select("row_id", rounded("prediction").alias("prediction"))


def _deflated(value: str, components: int) -> list[str]:
    """Views of a PLS fit by deflation: scores ``t<i>``, weights ``w<i>``, label loading and score sum of squares ``q<i>``."""
    views = [
        f"x0 as materialized (select row_id, k, {value} as v from l)",
        "y0 as materialized (select row_id, label - avg(label) over () as y from t)",
    ]
    for i in range(1, components + 1):
        views += [
            f"""w{i} as materialized (select k, w / sqrt(sum(w * w) over ()) as w
              from (select k, sum(v * y) as w from x{i - 1} join y0 using (row_id) group by k))""",
            f"t{i} as materialized (select row_id, sum(v * w) as s from x{i - 1} join w{i} using (k) group by row_id)",
            f"q{i} as materialized (select sum(s * y) / sum(s * s) as q, sum(s * s) as ss from t{i} join y0 using (row_id))",
            f"p{i} as materialized (select k, sum(v * s) / any_value(ss) as p from x{i - 1} join t{i} using (row_id), q{i} group by k)",
            f"x{i} as materialized (select row_id, k, v - s * p as v from x{i - 1} join t{i} using (row_id) join p{i} using (k))",
        ]
    return views


_TEN = range(1, 11)
_PLS_TEN = f"""select row_id, round((select avg(label) from t) + {" + ".join(f"(select q from q{i}) * t{i}.s" for i in _TEN)}, 6) + 0.0 as prediction
 from t1 {" ".join(f"join t{i} using (row_id)" for i in _TEN[1:])}"""
_VIP_TEN = f"""select k::bigint as k, 900.0::double + 10 * k as wavelength, round(score, 6) as score, r <= 20 as selected from (
  select k, score, rank() over (order by score desc) as r from (
  select k, 8.0 * sqrt(sum(ss * w * w) / (select {" + ".join(f"(select ss from q{i})" for i in _TEN)})) as score
  from ({" union all ".join(f"select k, w, ss from w{i}, q{i}" for i in _TEN)}) group by k))"""


@query("pls_ten_components", with_views(T, L, *_deflated("v - avg(v) over (partition by k)", 10), body=_PLS_TEN))
def pls_ten_components(spark, folder):
    scans = spectra(spark, folder)
    scored = PLSRegressor(nComponents=10).fit(scans).transform(scans)
    return scored.select("row_id", rounded("prediction").alias("prediction"))


_VIP = """r as (select k, corr(v, label) as r from l group by k),
 vip as (select k, 8.0 * abs(r) / sqrt(sum(r * r) over ()) as score from r)"""


def _channel_rows(found):
    return found.select(F.col("channel").cast("long").alias("k"), "wavelength", rounded("score").alias("score"), "selected")


@query(
    "vip_one_component",
    with_views(
        T, L, _VIP,
        body="""select k::bigint as k, 900.0::double + 10 * k as wavelength, round(vip.score, 6) as score, vip.score >= 1.0 as selected from vip""",
    ),
)
def vip_one_component(spark, folder):
    found = select.VIPSelector(nComponents=1).fit(spectra(spark, folder))
    return _channel_rows(found.table(spark))


@query(
    "vip_top_channels_with_ties",
    with_views(
        T, L, _VIP,
        body="""select k::bigint as k, 900.0::double + 10 * k as wavelength, round(score, 6) as score, r <= 12 as selected
        from (select k, score, rank() over (order by score desc) as r from vip)""",
    ),
)
def vip_top_channels_with_ties(spark, folder):
    found = select.VIPSelector(nComponents=1, nFeatures=12).fit(spectra(spark, folder))
    return _channel_rows(found.table(spark))


@query(
    "vip_ten_components",
    with_views(T, L, *_deflated("(v - avg(v) over (partition by k)) / stddev_samp(v) over (partition by k)", 10), body=_VIP_TEN),
)
def vip_ten_components(spark, folder):
    found = select.VIPSelector(nFeatures=20).fit(spectra(spark, folder))
    return _channel_rows(found.table(spark))


@query("cars_channels")
def cars_channels(spark, folder):
    return select.CARSSelector(nFeatures=20).fit(spectra(spark, folder)).table(spark)


@query("cars_history")
def cars_history(spark, folder):
    found = select.CARSSelector().fit(spectra(spark, folder))
    return found.history(spark).select("run", "n_selected", rounded("rmse").alias("rmse"))


@query(
    "elimination_schedule",
    """with g as (select p_brand, count(*) as channels from part group by p_brand)
    select p_brand, channels::bigint as channels, run::bigint as run, greatest(floor(channels * pow(0.95::double, run)), 1)::bigint as n_selected
    from g, range(30) t(run)""",
)
def elimination_schedule(spark, folder):
    groups = table(spark, folder, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("channels"))
    rows = select.elimination_schedule(groups, "channels", 0.95, 30)
    return rows.select("p_brand", "channels", F.col("run").cast("long").alias("run"), F.col("n_selected").cast("long").alias("n_selected"))


@query("genetic_channels")
def genetic_channels(spark, folder):
    return select.GeneticSelector(nFeatures=10).fit(spectra(spark, folder)).table(spark)


@query("genetic_history")
def genetic_history(spark, folder):
    found = select.GeneticSelector(nFeatures=10).fit(spectra(spark, folder))
    return stats.generation_stats(found.history(spark))


@query(
    "correlation_cut",
    with_views(
        T, L, "r as (select k, abs(corr(v, label)) as score from l group by k)",
        body="select k::bigint as k from (select k, row_number() over (order by score desc, k desc) as n from r where k >= 16 and k < 48) where n <= 10",
    ),
)
def correlation_cut(spark, folder):
    import numpy as np

    strength = np.abs(moments(spectra(spark, folder)).label_correlation())
    chosen = select.cut_by_correlation(np.arange(16, 48), strength, 10)
    return spark.createDataFrame([(int(i),) for i in chosen], "k long")


@query(
    "selected_channels_cut",
    with_views(
        T, L, _VIP,
        body="""select k::bigint as k, round(score, 6) as score from (
          select k, score, row_number() over (order by abs(r.r) desc, k desc) as n from r join vip using (k) where score >= 1.0)
        where n <= 10""",
    ),
)
def selected_channels_cut(spark, folder):
    """The channels that a selector chose, cut to the ten most correlated with the label."""
    scans = spectra(spark, folder)
    found = select.VIPSelector(nComponents=1).fit(scans)
    strength = np.abs(moments(scans).label_correlation())
    kept = select.cut_by_correlation(np.asarray(found.value("channels")), strength, 10)
    scores = found.table(spark).filter("selected").select(F.col("channel").cast("long").alias("k"), rounded("score").alias("score"))
    return scores.filter(F.col("k").isin([int(k) for k in kept]))


_SINGLE = "a as (select row_id, label as y, x[1] as a from t)"


def _one_channel(spark, folder):
    return spectra(spark, folder).withColumn("spectrum", take_channels("spectrum", [0]))


@query(
    "elastic_net_one_channel",
    with_views(
        T, _SINGLE,
        "m as (select avg(a) ma, avg(y) my, covar_pop(a, y) ay, var_pop(a) aa from a)",
        body="""select row_id, round(my + (a - ma) * sign(ay) * greatest(abs(ay) - 0.001 * 0.5, 0) / (aa + 0.001 * 0.5), 6) + 0.0 as prediction
        from a, m""",
    ),
)
def elastic_net_one_channel(spark, folder):
    scans = _one_channel(spark, folder)
    scored = regress.train_model(scans, "elasticnet", {"alpha": 0.001}).transform(scans)
    return scored.select("row_id", rounded("prediction").alias("prediction"))


@query("elastic_net_all_channels")
def elastic_net_all_channels(spark, folder):
    scans = spectra(spark, folder)
    scored = regress.train_model(scans, "elasticnet", {"alpha": 0.01}).transform(scans)
    return scored.select("row_id", rounded("prediction").alias("prediction"))


def _scored(model_type, **params):
    def run(spark, folder):
        scans = assign_splits(spectra(spark, folder))
        model = regress.train_model(scans.filter("split = 'train'"), model_type, params)
        return stats.evaluate(model.transform(scans), by="split")

    return run


query("support_vector_linear")(_scored("svr", kernel="linear"))
query("support_vector_rbf")(_scored("svr", kernel="rbf"))
query("random_forest")(_scored("rf"))
query("gradient_boosting")(_scored("xgb"))
query("leafwise_boosting")(_scored("lgbm"))


@query("model_factory")
def model_factory(spark, folder):
    """Every model type by name, fitted and scored on the same rows."""
    scans = spectra(spark, folder)
    rows = None
    for name in regress.DEFAULTS:
        scored = regress.train_model(scans, name).transform(scans)
        one = stats.evaluate(scored).withColumn("model", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _stumps(rounds: int, smoothing: float, least: int, rate: float) -> list[str]:
    """Views of ``rounds`` trees of one split each, by trying every cut of every channel."""
    views = ["""t as (select l_orderkey * 8 + l_linenumber as row_id, l_quantity::double as c0, round(l_discount * 100)::double as c1,
  round(l_tax * 100)::double as c2, l_extendedprice::double as y from lineitem)""", "f0 as (select *, avg(y) over () as f from t)"]
    for i in range(1, rounds + 1):
        split = " union all ".join(f"select {c} as ch, c{c} as v, count(*) as n, sum(y - f) as s from f{i - 1} group by c{c}" for c in range(3))
        views += [
            f"s{i} as ({split})",
            f"""w{i} as (select ch, v, sum(n) over o as nl, sum(s) over o as sl, sum(n) over a - sum(n) over o as nr, sum(s) over a - sum(s) over o as sr
  from s{i} window o as (partition by ch order by v), a as (partition by ch))""",
            f"""b{i} as (select ch, v, {rate} * sl / (nl + {smoothing}) as low, {rate} * sr / (nr + {smoothing}) as high from w{i}
  where nl >= {least} and nr >= {least} order by sl * sl / (nl + {smoothing}) + sr * sr / (nr + {smoothing}) desc limit 1)""",
            f"""f{i} as (select row_id, c0, c1, c2, y, f + case when case ch when 0 then c0 when 1 then c1 else c2 end <= v then low else high end as f
  from f{i - 1}, b{i})""",
        ]
    return views


def _line_items(spark, folder):
    """Three channels of few different values, so that a cut between any two of them can be tried."""
    percent = [F.round(F.col(c) * 100).cast("double") for c in ("l_discount", "l_tax")]
    return table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("row_id"),
        F.array(F.col("l_quantity").cast("double"), *percent).alias("spectrum"), F.col("l_extendedprice").cast("double").alias("label"),
    )


def _stump_query(model_type, **params):
    def run(spark, folder):
        rows = _line_items(spark, folder)
        return regress.train_model(rows, model_type, params).transform(rows).select("row_id", rounded("prediction", 4).alias("prediction"))

    return run


_STUMP_BODY = "select row_id::bigint as row_id, round(f, 4) + 0.0 as prediction from f{0}"
query("boosted_stumps", with_views(*_stumps(3, 1.0, 1, 0.5), body=_STUMP_BODY.format(3)))(
    _stump_query("xgb", n_estimators=3, max_depth=1, learning_rate=0.5, subsample=1.0, colsample_bytree=1.0)
)
query("leafwise_stumps", with_views(*_stumps(3, 0.0, 20, 0.5), body=_STUMP_BODY.format(3)))(
    _stump_query("lgbm", n_estimators=3, num_leaves=2, learning_rate=0.5)
)
query("one_split_forest", with_views(*_stumps(1, 0.0, 1, 1.0), body=_STUMP_BODY.format(1)))(
    _stump_query("rf", n_estimators=1, max_depth=1, bootstrap=False)
)


@query("one_split_importances", with_views(*_stumps(1, 0.0, 1, 1.0), body="select c.ch::int as channel, (c.ch = b1.ch)::int::double as importance from b1, (select distinct ch from s1) c"))
def one_split_importances(spark, folder):
    model = regress.train_model(_line_items(spark, folder), "rf", {"n_estimators": 1, "max_depth": 1, "bootstrap": False})
    return regress.feature_importances(model, spark).select("channel", "importance")


@query("tree_importances")
def tree_importances(spark, folder):
    model = regress.train_model(spectra(spark, folder), "rf")
    return regress.feature_importances(model, spark, NAMES)


@query(
    "predicted_and_actual",
    with_views(
        T, L, ONE_COMPONENT, _PREDICT, "q as (select label as y, f from p)", f"m as (select {METRICS} from q)",
        body="""select row_id, label as actual, round(f, 6) + 0.0 as predicted, round(label - f, 6) + 0.0 as error, rmse, r2 from p, m""",
    ),
)
def predicted_and_actual(spark, folder):
    scans = spectra(spark, folder)
    scored = PLSRegressor(nComponents=1).fit(scans).transform(scans)
    level = rounded_metrics(stats.evaluate(scored)).first()
    rows = tables.prediction_table(scored, keys=["row_id"])
    return rows.select(
        "row_id", "actual", rounded("predicted").alias("predicted"), rounded("error").alias("error"),
        F.lit(level["rmse"]).alias("rmse"), F.lit(level["r2"]).alias("r2"),
    )


@query(
    "cross_validated_score",
    with_views(
        T, "f as (select row_id, label as y, x[1] as a, ntile(5) over (order by md5('42:' || row_id)) as fold from t)",
        """m as (select g.fold, regr_slope(f.y, f.a) as b, regr_intercept(f.y, f.a) as c
          from (select distinct fold from f) g join f on f.fold <> g.fold group by g.fold)""",
        "e as (select f.fold, sqrt(avg((y - b * a - c) * (y - b * a - c))) as rmse from f join m using (fold) group by f.fold)",
        body="select round(-avg(rmse), 6) as score from e",
    ),
)
def cross_validated_score(spark, folder):
    score = search.cv_score(_one_channel(spark, folder), "pls", {"n_components": 1}, folds=5)
    return spark.createDataFrame([(round(score, 6),)], "score double")


@query("grid_search")
def grid_search(spark, folder):
    return search.grid_search(spectra(spark, folder), "pls", refit=False).table(spark)


@query("random_search")
def random_search(spark, folder):
    return search.random_search(spectra(spark, folder), "elasticnet", refit=False).table(spark)


@query("adaptive_search")
def adaptive_search(spark, folder):
    return search.adaptive_search(spectra(spark, folder), "pls", refit=False).table(spark)


@query("grid_search_forest")
def grid_search_forest(spark, folder):
    """A learner that has to be refitted for every fold."""
    return search.grid_search(spectra(spark, folder), "rf", refit=False).table(spark)


@query(
    "user_scoring_function",
    with_views(
        T, L, ONE_COMPONENT, _PREDICT,
        body="select round(max(abs(label - f)), 6) as largest_error, round(sqrt(avg((label - f) * (label - f))), 6) as rmse from p",
    ),
)
def user_scoring_function(spark, folder):
    """Scores may be any aggregate of label and prediction, or an ml evaluator."""
    scans = spectra(spark, folder)
    scored = PLSRegressor(nComponents=1).fit(scans).transform(scans)
    judged = RegressionEvaluator(metricName="rmse", labelCol="label").evaluate(scored)
    largest = F.max(F.abs(F.col("label") - F.col("prediction")))
    return scored.agg(rounded(largest).alias("largest_error")).withColumn("rmse", F.lit(round(judged, 6)))


@query(
    "mask_scores",
    with_views(
        T, L, "f as (select row_id, k, label as y, v as a, ntile(5) over (partition by k order by row_id) as fold from l)",
        """m as (select g.fold, f.k, regr_slope(f.y, f.a) as b, regr_intercept(f.y, f.a) as c
          from (select distinct fold from f) g join f on f.fold <> g.fold group by g.fold, f.k)""",
        "e as (select f.k, f.fold, avg(abs(y - b * a - c)) as mae from f join m using (fold, k) group by f.k, f.fold)",
        body="select k::bigint as channel, round(-avg(mae), 6) as score from e where k % 8 = 0 group by k",
    ),
)
def mask_scores(spark, folder):
    """Eight candidates of the genetic search, a channel each, scored by a given estimator and evaluator."""
    judge = RegressionEvaluator(metricName="mae", labelCol="label")
    fitness = select.GeneticSelector(PLSRegressor(nComponents=1), judge)
    candidates = np.eye(len(NAMES), dtype=bool)[::8]
    scores = fitness.score_masks(spectra(spark, folder), candidates)
    return spark.createDataFrame([(int(m.argmax()), round(s, 6)) for m, s in zip(candidates, scores)], "channel long, score double")


@query(
    "search_with_validation",
    with_views(
        T, "r as (select row_id, label as y, x[1] as a, row_id % 4 = 0 as held from t)",
        "f as (select *, ntile(5) over (order by md5('42:' || row_id)) as fold from r where not held)",
        """m as (select g.fold, regr_slope(f.y, f.a) as b, regr_intercept(f.y, f.a) as c
          from (select distinct fold from f) g join f on f.fold <> g.fold group by g.fold)""",
        "e as (select f.fold, sqrt(avg((y - b * a - c) * (y - b * a - c))) as rmse from f join m using (fold) group by f.fold)",
        "w as (select regr_slope(y, a) as b, regr_intercept(y, a) as c from f)",
        "v as (select y, c + b * a as f from r, w where held)", f"q as (select {METRICS} from v)",
        body="select round(-avg(e.rmse), 6) as score, any_value(q.rmse) as rmse, any_value(q.r2) as r2 from e, q",
    ),
)
def search_with_validation(spark, folder):
    """The best trial's score, and the metrics of the refitted model on rows that the search did not see."""
    scans = _one_channel(spark, folder)
    held = F.col("row_id") % 4 == 0
    found = search.grid_search(scans.filter(~held), "pls", {"n_components": [1]}, validation=scans.filter(held))
    level = [round(found.validation["rmse"], 4), round(found.validation["r2"], 6)]
    return spark.createDataFrame([(round(found.best_score, 6), *level)], "score double, rmse double, r2 double")


@query("single_experiment")
def single_experiment(spark, folder):
    """One experiment on the wide table: outliers, SNV, Savitzky-Golay, CARS, PLS."""
    _, metrics, _ = jobs.run_experiment(
        wide(spark, folder), "Brix", "pls", "snv", savgol=True, deriv=1, selection="cars", n_features=20,
    )
    return metrics


@query("tuned_experiment")
def tuned_experiment(spark, folder):
    _, metrics, _ = jobs.run_experiment(
        wide(spark, folder), "Brix", "pls", "msc", tuned=True, remove_outliers=False,
    )
    return metrics


@query("experiment_study")
def experiment_study(spark, folder):
    """The 27 standard experiments; a failed one is recorded."""
    return jobs.Study(spectra(spark, folder)).run(jobs.standard_study()).drop("seconds", "message")


@query("prepared_dataset")
def prepared_dataset(spark, folder):
    """CSV in, prepared and split data set out; rows and mean label per split are read back."""
    place = scratch(spark)
    tables.write_table(wide(spark, folder), f"{place}/scans.csv", "csv")
    jobs.prepare_dataset(spark, f"{place}/scans.csv", f"{place}/data", "snv", outlier_method="pca")
    features = spark.read.parquet(f"{place}/data/features")
    target = spark.read.parquet(f"{place}/data/target")
    return features.join(target, "row_id").groupBy("split").agg(F.count("*").alias("n"), F.avg("label").alias("label"))


@query(
    "streamed_predictions",
    with_views(T, L, ONE_COMPONENT, _PREDICT, body="select row_id, label, round(f, 6) + 0.0 as prediction from p"),
)
def streamed_predictions(spark, folder):
    """A model fitted on the table scores the same scans arriving as a file stream."""
    scans = spectra(spark, folder)
    model = PLSRegressor(nComponents=1).fit(scans)
    place = scratch(spark)
    scans.write.parquet(f"{place}/in")
    stream = read_scans(spark, f"{place}/in", scans.schema)
    write_scores(score_stream(stream, model), f"{place}/out", f"{place}/state", keep=["row_id", "label", "prediction"]).awaitTermination()
    done = spark.read.parquet(f"{place}/out")
    return done.select("row_id", "label", rounded("prediction").alias("prediction"))


@query(
    "scores_by_aggregate",
    """select p_brand, round(sqrt(avg((p_retailprice - p_size * 40.0::double) * (p_retailprice - p_size * 40.0::double))), 4) as rmse from part group by p_brand""",
)
def scores_by_aggregate(spark, folder):
    rows = table(spark, folder, "part").groupBy("p_brand")
    return rows.agg(rounded(rmse("p_retailprice", F.col("p_size") * 40.0), 4).alias("rmse"))
