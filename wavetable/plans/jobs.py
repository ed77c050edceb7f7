"""Jobs composed of the operators: data preparation, one experiment, a study of many."""

from __future__ import annotations

import threading
import time
from concurrent.futures import Future
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetable.functions.metrics import METRICS
from wavetable.operators import clean, columns, rank
from wavetable.operators.moments import FoldMoments
from wavetable.operators.outliers import OutlierDetector
from wavetable.operators.regress import create_model
from wavetable.operators.search import GRIDS, adaptive_search, grid_search
from wavetable.operators.select import FOLDS, CARSSelector, GeneticSelector, VIPSelector, with_folds
from wavetable.operators.splits import assign_splits, two_way_column, two_way_split
from wavetable.operators.stats import evaluate, target_summary
from wavetable.operators.wide import WideTable, moment_source
from wavetable.plans.chains import build_chain, correction_stages
from wavetable.session import durable
from wavetable.sources.runs import RunLog
from wavetable.sources.tables import prediction_table, read_table, save_model, write_dataset, write_json, write_table

# Columns that never are features, and the usual name of the target.
NEVER_FEATURES = [
    "Instrument Serial Number", "Notes", "Timestamp", "Integration Time", "wetlab ID", "Lab",
]
TARGET = "Brix"
ROW = "row_id"


@dataclass
class Prepared:
    """A lazy table ``(row_id, metadata..., label, spectrum)`` and what was fitted for it."""

    table: DataFrame
    channels: list[str]
    extras: list[str]
    model: PipelineModel | None = None
    report: dict = field(default_factory=dict)


def prepare_spectra(
    df: DataFrame,
    target: str = TARGET,
    stages=None,
    exclude=(),
    remove_outliers: bool = True,
    outlier_method: str = "zscore",
    threshold: float = 3.0,
    fit_on: Column | None = None,
    row_id: str = ROW,
    distinct: bool = False,
) -> Prepared:
    """Clean a wide table, correct its spectra and drop outliers.

    Duplicates, empty and constant columns and non-numeric columns go; outliers are judged on the
    uncorrected spectra; numeric columns that are no channels follow the channels untransformed.
    ``stages=None`` means SNV, an empty list means no correction. ``fit_on`` is a condition on the row
    id that picks the rows to learn from; ``distinct`` tells that there are no duplicates.
    """
    stages = correction_stages("snv") if stages is None else list(stages)
    # written once: the later passes must not repeat the shuffle that finds duplicates
    rows = df if distinct else durable(clean.drop_duplicates(df, row_id))
    cleaned = clean.drop_uninformative(rows, keep=(row_id,))
    numeric = columns.filter_numeric(cleaned, [c for c in exclude if c != target])
    channels, others = columns.split_columns(numeric)
    extras = [c for c in others if c not in (target, row_id)]
    labelled = columns.with_target(numeric, target, required=False)
    packed = columns.pack(labelled, channels)
    source = packed if fit_on is None else packed.filter(fit_on)
    before = []
    if remove_outliers:
        before = [OutlierDetector(method=outlier_method, threshold=threshold, removeOutliers=True)]
    # every stage learns from all rows; outliers leave only the result
    corrections = Pipeline(stages=stages).fit(source)
    detectors = Pipeline(stages=before).fit(source)
    model = PipelineModel(stages=[*detectors.stages, *corrections.stages])
    table = model.transform(packed).drop("is_outlier")
    if extras:
        tail = F.array(*[columns.quoted(c).cast("double") for c in extras])
        names = columns.channel_metadata([*channels, *extras])
        table = table.withColumn("spectrum", F.concat("spectrum", tail).alias("spectrum", metadata=names))
    return Prepared(table, channels, extras, model, {"channels": len(channels), "extras": extras})


def load_and_prepare(
    spark: SparkSession,
    path: str,
    method: str = "raw",
    target: str = TARGET,
    outliers: bool = True,
    outlier_method: str = "zscore",
    threshold: float = 3.0,
    remove_outliers: bool = False,
    remove_constant: bool = True,
    impute: bool = True,
    custom=(),
    schema=None,
    row_id: str = ROW,
) -> Prepared:
    """Read, clean, impute and run a named chain; non-channel columns stay beside the spectrum."""
    df = durable(clean.drop_duplicates(read_table(spark, path, schema, row_id=row_id), row_id))
    df = clean.add_sample_id(df, row_id)
    if remove_constant:
        df = clean.drop_uninformative(df, keep=(row_id,))
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    channels, others = columns.split_columns(df)
    if impute:
        df = clean.impute(df, exclude=(target, row_id))
    packed = columns.pack(columns.with_target(df, target), channels)
    model = build_chain(method, outliers, outlier_method, threshold, remove_outliers, custom).fit(packed)
    table = model.transform(packed)
    level = target_summary(df, target).first().asDict()
    report = {
        "original_columns": len(df.columns),
        "preprocessing_method": method,
        "outlier_detection": outliers,
        "outlier_method": outlier_method if outliers else None,
        "spectral_columns": channels,
        "non_spectral_columns": [c for c in others if c != row_id],
        "target_column": target,
        "target_stats": level,
    }
    return Prepared(table, channels, [c for c in others if c not in (target, row_id)], model, report)


def prepare_dataset(
    spark: SparkSession,
    path: str,
    folder: str | None = None,
    method: str = "raw",
    target: str = TARGET,
    test_size: float = 0.2,
    val_size: float | None = 0.2,
    seed: int = 42,
    exclude_features=(),
    additional_features=None,
    format: str = "parquet",
    **options,
) -> Prepared:
    """Load, prepare, split and write a data set."""
    done = load_and_prepare(spark, path, method, target, **options)
    keep = [ROW, "label", "spectrum", "is_outlier"]
    table = done.table.drop(*[c for c in exclude_features if c not in keep])
    if additional_features:
        kept = [c for c in table.columns if c in keep or c in additional_features]
        table = table.select(*[columns.quoted(c) for c in kept])
    done.table = assign_splits(table, ROW, test_size, val_size, seed)
    if folder:
        write_dataset(done.table, folder, done.report, done.model, format)
    return done


def process_spectra(
    df: DataFrame,
    target: str = TARGET,
    transform: str = "none",
    savgol: bool = False,
    window: int = 15,
    polyorder: int = 2,
    deriv: int = 0,
    selection: str = "none",
    n_features: int = 20,
    row_id: str = ROW,
    fit_on: str | None = None,
    **selector_options,
) -> Prepared:
    """Channels of a wide table -> correction -> Savitzky-Golay -> channel selection.

    Everything is fitted on all rows, or on the rows where the boolean SQL expression ``fit_on`` holds.
    """
    channels, _ = columns.split_columns(df)
    packed = columns.pack(columns.with_target(df, target, required=False), channels)
    source = packed if fit_on is None else packed.filter(fit_on)
    stages = correction_stages(transform, savgol, window, polyorder, deriv)
    if selection != "none" and target in df.columns:
        stages.append(selector(selection, n_features, row_id, **selector_options))
    model = Pipeline(stages=stages).fit(source)
    table = model.transform(packed)
    kept = columns.channel_names(table) or channels
    return Prepared(table, kept, [], model, {"wavelengths": [columns.wavelength(c) for c in channels]})


def selector(method: str, n_features: int = 20, row_id: str = ROW, **options):
    """Selector by name: ``vip``, ``cars`` or ``ga``."""
    if method == "vip":
        return VIPSelector(nFeatures=n_features, **options)
    if method == "cars":
        return CARSSelector(nFeatures=n_features, rowIdCol=row_id, **options)
    if method == "ga":
        return GeneticSelector(nFeatures=n_features, rowIdCol=row_id, **options)
    raise ValueError(f"unknown feature selection method: {method}")


@dataclass
class Experiment:
    """One row of a study."""

    model_type: str
    transform: str = "snv"
    savgol: bool = True
    tuned: bool = False
    selection: str = "none"
    n_features: int = 0
    params: dict = field(default_factory=dict)

    @property
    def name(self) -> str:
        parts = [self.model_type, self.transform]
        parts += ["savgol"] if self.savgol else []
        parts += ["tuned"] if self.tuned else []
        parts += [f"{self.selection}{self.n_features}"] if self.selection != "none" else []
        return "_".join(parts)


def standard_study(with_selection: bool = True) -> list[Experiment]:
    """Nine plain experiments and, with selection, three models by six selections."""
    # fixed values: the experiments of the study, in their order
    plain = [
        Experiment("xgb", "snv"),
        Experiment("xgb", "msc"),
        Experiment("rf", "snv"),
        Experiment("rf", "snv", tuned=True),
        Experiment("rf", "msc"),
        Experiment("svr", "snv"),
        Experiment("svr", "msc"),
        Experiment("pls", "snv", tuned=True),
        Experiment("pls", "msc", tuned=True),
    ]
    if not with_selection:
        return plain
    chosen = [
        Experiment(model, "snv", selection=method, n_features=count)
        for model in ("pls", "xgb", "rf")
        for method in ("vip", "cars", "ga")
        for count in (20, 50)
    ]
    return plain + chosen


class Study:
    """Runs experiments over shared intermediate results.

    Per correction the split, corrected spectra are written to the checkpoint folder once and their
    fold moments are computed once; every selection with these inputs is solved once. So the number
    of scans of the raw data does not depend on the number of experiments, and those run at the same time.
    """

    def __init__(
        self, df: DataFrame, row_id: str = ROW, test_size: float = 0.2, seed: int = 42, savgol=(15, 2, 1),
        selectors: dict | None = None, grids: dict | None = None, folds: int = 5, fit_on: str = "train",
    ):
        if fit_on not in ("train", "all"):
            raise ValueError("fit_on must be 'train' or 'all'")
        # shares are those of the labelled rows
        self.split = df.withColumn("split", two_way_column(df.filter(F.col("label").isNotNull()), row_id, test_size, seed))
        self.row_id, self.seed, self.folds, self.savgol, self.fit_on = row_id, seed, folds, savgol, fit_on
        self.selectors, self.grids = selectors or {}, grids or {}
        self.spark = df.sparkSession
        self._shared: dict = {}
        self._lock = threading.Lock()

    def _once(self, key, build):
        """The result of ``build``, made once; experiments that need it meanwhile wait for it."""
        with self._lock:
            mine = key not in self._shared
            found = self._shared.setdefault(key, Future())
        if mine:
            try:
                found.set_result(build())
            except BaseException as error:
                found.set_exception(error)
        return found.result()

    def corrected(self, transform: str, savgol: bool) -> DataFrame:
        def build():
            window, polyorder, deriv = self.savgol
            stages = correction_stages(transform, savgol, window, polyorder, deriv)
            source = self.split if self.fit_on == "all" else self.split.filter("split = 'train'")
            model = Pipeline(stages=stages).fit(source)
            labelled = self.split.filter(F.col("label").isNotNull())
            table = model.transform(labelled).select(self.row_id, "label", "spectrum", "split")
            return durable(columns.filter_late(table, F.col("spectrum").isNotNull()))

        return self._once(("table", transform, savgol), build)

    def train(self, transform: str, savgol: bool) -> DataFrame:
        return self.corrected(transform, savgol).filter("split = 'train'")

    def moments(self, transform: str, savgol: bool, contiguous: bool) -> FoldMoments | WideTable:
        def build():
            folded = with_folds(self.train(transform, savgol), self.folds, self.row_id, self.seed, contiguous)
            return moment_source(folded, fold=FOLDS, folds=self.folds)

        return self._once(("moments", transform, savgol, contiguous), build)

    def selection(self, e: Experiment):
        def build():
            chooser = selector(e.selection, e.n_features, self.row_id, **self.selectors.get(e.selection, {}))
            if e.selection == "ga" and chooser.estimator is not None:
                return chooser.fit(self.train(e.transform, e.savgol))
            table = self.moments(e.transform, e.savgol, contiguous=e.selection == "ga")
            if e.selection == "vip":
                wide = isinstance(table, WideTable)
                return chooser.fit(self.train(e.transform, e.savgol)) if wide else chooser.from_moments(table.total)
            return chooser.from_moments(table) if e.selection == "cars" else chooser.from_moments(table, self.spark)

        return self._once(("selection", e.transform, e.savgol, e.selection, e.n_features), build)

    def fit(self, e: Experiment):
        """``(model, test predictions)`` of one experiment."""
        table = self.corrected(e.transform, e.savgol)
        stages = []
        if e.selection != "none":
            chosen = self.selection(e)
            table = chosen.transform(table)
            stages.append(chosen)
        train = table.filter("split = 'train'")
        params = dict(e.params)
        if e.tuned:
            grid = self.grids.get(e.model_type, GRIDS[e.model_type])
            params.update(grid_search(train, e.model_type, grid, self.folds, False, row_id=self.row_id, seed=self.seed).best_params)
        model = create_model(e.model_type, **params).fit(train)
        return PipelineModel(stages=[*stages, model]), model.transform(table.filter("split = 'test'"))

    def run(self, experiments: list[Experiment] | None = None, folder: str | None = None, parallelism: int = 4) -> DataFrame:
        """One row per experiment; a failed one has status ``failed``, its message and no metrics.

        ``parallelism`` experiments run at a time. What several of them need is made by the first one that asks, and
        the others wait for that alone. If the session ends, so does the study.
        """
        experiments = experiments if experiments is not None else standard_study()

        def one(e):
            started = time.time()
            try:
                model, predicted = self.fit(e)
                found = evaluate(predicted).first()
                return e, model, {m: found[m] for m in METRICS}, "ok", None, time.time() - started
            except Exception as error:  # recorded, and the study goes on
                if self.spark.sparkContext._jsc is None or self.spark.sparkContext._jsc.sc().isStopped():
                    raise
                return e, None, {}, "failed", str(error), time.time() - started

        with ThreadPool(parallelism) as pool:
            done = pool.map(inheritable_thread_target(self.spark)(one), experiments, chunksize=1)
        rows = []
        log = RunLog(self.spark, f"{folder}/log") if folder else None
        for e, model, scores, status, message, seconds in done:
            if log is not None and model is not None:
                save_model(model, f"{folder}/models/{e.name}", {"metrics": scores, "experiment": e.name}, self.spark)
                log.add("study", e.name, e.params, scores, {"status": status})
            rows.append(
                (e.name, e.model_type, e.transform, e.savgol, e.tuned, e.selection, e.n_features, status, message,
                 *[scores.get(m) for m in METRICS], seconds)
            )
        if log is not None:
            log.flush()
        return self.spark.createDataFrame(rows, STUDY)


STUDY = (
    "experiment string, model_type string, transform_type string, use_savgol boolean, tune_hyperparams boolean, "
    "feature_selection_method string, n_features int, status string, message string, rmse double, mae double, "
    "r2 double, explained_variance double, seconds double"
)


def run_experiment(
    df: DataFrame,
    target: str = TARGET,
    model_type: str = "pls",
    transform: str = "snv",
    savgol: bool = False,
    window: int = 15,
    polyorder: int = 2,
    deriv: int = 0,
    selection: str = "none",
    n_features: int = 20,
    selector_options: dict | None = None,
    params: dict | None = None,
    tuned: bool = False,
    n_trials: int = 50,
    cv_folds: int = 3,
    test_size: float = 0.2,
    exclude=NEVER_FEATURES,
    remove_outliers: bool = True,
    outlier_method: str = "zscore",
    fit_on: str = "train",
    seed: int = 42,
    folder: str | None = None,
    row_id: str = ROW,
):
    """One experiment on a wide table: prepare, select, split, fit or tune, evaluate, save.

    Returns ``(model, metrics, predictions)``. With ``fit_on="train"`` corrections, outlier limits
    and selection learn from the training rows only; ``"all"`` lets them see every row. The test share is
    that of the labelled rows; outliers leave afterwards, as their limits are learnt on the training rows.
    """
    spark = df.sparkSession
    if fit_on not in ("train", "all"):
        raise ValueError("fit_on must be 'train' or 'all'")
    rows = durable(clean.drop_duplicates(df, row_id))
    known = rows.filter(columns.quoted(target).isNotNull()) if target in rows.columns else rows
    split = two_way_column(known, row_id, test_size, seed)
    learn = split == "train" if fit_on == "train" else None
    stages = correction_stages(transform, savgol, window, polyorder, deriv)
    done = prepare_spectra(
        rows, target, stages, exclude, remove_outliers, outlier_method, fit_on=learn, row_id=row_id, distinct=True
    )
    labelled = clean.require_label(done.table)
    if fit_on == "train":
        table = durable(labelled.withColumn("split", split))
    else:
        table = durable(two_way_split(durable(labelled), row_id, test_size, seed))
    train = table.filter("split = 'train'")
    if selection != "none":
        chooser = selector(selection, n_features, row_id, **(selector_options or {}))
        chosen = chooser.fit(train if fit_on == "train" else table)
        table, train = chosen.transform(table), chosen.transform(train)
    params = dict(params or {})
    if tuned:
        found = adaptive_search(train, model_type, n_trials=n_trials, folds=cv_folds, seed=seed, row_id=row_id, refit=False)
        params.update(found.best_params)
    model = create_model(model_type, **params).fit(train)
    predictions = prediction_table(model.transform(table.filter("split = 'test'")), keys=[row_id])
    metrics = evaluate(predictions, "actual", "predicted")
    if folder:
        save_model(model, f"{folder}/model", {"target": target, "params": params}, spark)
        write_table(predictions, f"{folder}/predictions")
        write_table(metrics.unpivot([], METRICS, "metric", "value"), f"{folder}/metrics")
        if selection != "none":
            write_table(chosen.table(spark), f"{folder}/channels")
        write_json(spark, done.report, f"{folder}/report")
    return model, metrics, predictions


def summarise_study(results: DataFrame) -> DataFrame:
    return rank.study_summary(results)
