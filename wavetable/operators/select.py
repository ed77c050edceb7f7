"""Channel selection: VIP, CARS and a genetic search, all on moments of one pass."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavetable.functions.metrics import rmse
from wavetable.functions.spectral import take_channels
from wavetable.operators.columns import CHANNEL_NAME, channel_metadata, channel_names, wavelength
from wavetable.operators.latent import fit_latent, fit_table
from wavetable.operators.moments import FoldMoments, Moments
from wavetable.operators.params import Settings, a_float, a_flag, a_text, an_int, floats, ints, texts
from wavetable.operators.splits import contiguous_folds, shuffled_folds
from wavetable.operators.wide import NO_FOLD, WideTable, moment_source
from wavetable.session import durable

# Schemas of the report tables.
CHANNEL_TABLE = "channel int, name string, wavelength double, score double, selected boolean"
CARS_HISTORY = "run int, n_selected int, rmse double, channels array<int>"
GA_HISTORY = "generation int, candidate int, score double, n_selected int"
FOLDS = "spectral_fold"


class ChannelSelection(Model, Settings):
    """Keeps the selected channels of the spectrum, in channel order unless told otherwise."""

    channels = ints("channels", "selected positions")
    scores = floats("scores", "one score per channel")
    names = texts("names", "one name per channel")

    def __init__(self, names=None, history=None, **kwargs):
        super().__init__(names=names, **kwargs)
        self.history_rows = history or []

    def mask(self) -> np.ndarray:
        mask = np.zeros(len(self.value("scores")), dtype=bool)
        mask[self.value("channels")] = True
        return mask

    def _transform(self, df):
        names = channel_names(df, self.spectrum)
        column = take_channels(F.col(self.spectrum).cast("array<double>"), self.value("channels"))
        if names:
            kept = [names[i] for i in self.value("channels")]
            column = column.alias(self.output, metadata=channel_metadata(kept))
        return df.withColumn(self.output, column)

    def table(self, spark: SparkSession) -> DataFrame:
        """``(channel, name, wavelength, score, selected)``, one row per channel."""
        mask = self.mask()
        names = self.value("names") or [None] * len(mask)
        rows = []
        for i, score in enumerate(self.value("scores")):
            name = names[i]
            place = wavelength(name) if name and CHANNEL_NAME.match(name) else None
            rows.append((i, name, place, None if np.isnan(score) else float(score), bool(mask[i])))
        return spark.createDataFrame(rows, CHANNEL_TABLE)


class CarsSelection(ChannelSelection):
    def history(self, spark: SparkSession) -> DataFrame:
        """``(run, n_selected, rmse, channels)``; rmse is NULL when no fold was large enough."""
        return spark.createDataFrame(self.history_rows, CARS_HISTORY)


class GeneticSelection(ChannelSelection):
    def history(self, spark: SparkSession) -> DataFrame:
        """Every scored candidate: ``(generation, candidate, score, n_selected)``."""
        return spark.createDataFrame(self.history_rows, GA_HISTORY)


class VIPSelector(Estimator, Settings):
    """Keeps channels by their importance in a PLS fit.

    With ``nFeatures`` the limit is the score of the n-th best channel and ties stay in; without it,
    or with ``useCount`` off, the limit is ``threshold``.
    """

    nComponents = an_int("nComponents")
    nFeatures = an_int("nFeatures")
    threshold = a_float("threshold")
    useCount = a_flag("useCount")
    scale = a_flag("scale")
    DEFAULTS = {"nComponents": 10, "threshold": 1.0, "useCount": True, "scale": True}

    def _fit(self, df):
        fit = fit_table(df, self.value("nComponents"), self.value("scale"), self.spectrum, self.label)
        return self.from_latent(fit, channel_names(df, self.spectrum))

    def from_moments(self, m: Moments, names=None) -> ChannelSelection:
        return self.from_latent(fit_latent(m, self.value("nComponents"), self.value("scale")), names)

    def from_latent(self, fit, names=None) -> ChannelSelection:
        scores = fit.importance()
        limit = self.value("threshold")
        if self.value("useCount") and self.value("nFeatures"):
            limit = np.sort(scores)[-min(self.value("nFeatures"), len(scores))]
        chosen = np.flatnonzero(scores >= limit)
        return ChannelSelection(names, None, spectrumCol=self.spectrum, channels=chosen, scores=scores)


def with_folds(df: DataFrame, folds: int, row_id: str, seed: int, contiguous: bool = False) -> DataFrame:
    if contiguous:
        return contiguous_folds(df, folds, row_id, FOLDS)
    return shuffled_folds(df, folds, row_id, seed, FOLDS)


def cv_rmse(folds: FoldMoments, n_components: int, scale: bool) -> float | None:
    """Mean held-out rmse of PLS; folds that leave too few rows to train are skipped."""
    errors = []
    for train, held in folds.pairs():
        if train.n <= n_components or held.n == 0:
            continue
        fit = fit_latent(train, n_components, scale)
        coefficients = fit.coefficients()
        errors.append(np.sqrt(held.squared_error(coefficients, fit.intercept(coefficients)) / held.n))
    return float(np.mean(errors)) if errors else None


def rescaled(weights: np.ndarray) -> np.ndarray:
    low = weights.min()
    return (weights - low) / (weights.max() - low + 1e-10)


def kept_count(channels: int, decay: float, run: int) -> int:
    """Channels left in a run of the exponentially shrinking schedule."""
    return max(int(channels * decay**run), 1)


def fit_run(table: FoldMoments | WideTable, chosen, n_components: int, scale: bool, score: bool = True):
    """``(cross-validated rmse, coefficients on all rows)`` of PLS on the chosen channels."""
    if isinstance(table, WideTable):
        dense = table.dense(chosen)
        if dense is not None:
            table, chosen = dense, np.arange(len(chosen))
    if isinstance(table, WideTable):
        errors = table.cv_errors([chosen], n_components, scale, n_components)[0] if score else []
        fit = table.fit_many([(np.asarray(chosen, dtype=int), NO_FOLD)], n_components, scale)[0]
        return (float(np.mean(errors)) if errors else None), fit.coefficients()
    error = cv_rmse(table.take(chosen), n_components, scale) if score else None
    return error, fit_latent(table.total.take(chosen), n_components, scale).coefficients()


def cars_search(table: FoldMoments | WideTable, runs: int, n_components: int, decay: float, scale: bool = True):
    """Competitive elimination; returns the final weights and one entry per run.

    Each run keeps the highest weights, scores them by cross-validation and refreshes the weights
    of the kept channels. Dense moments answer all of it without touching the data again; a wide table takes a
    pass per component, or a single one once the kept channels fit a dense table.
    """
    p = table.channels
    weights = rescaled(np.abs(fit_run(table, np.arange(p), n_components, scale, score=False)[1]))
    history = []
    for run in range(runs):
        chosen = np.sort(np.argsort(weights, kind="stable")[-kept_count(p, decay, run) :])
        error, coefficients = fit_run(table, chosen, n_components, scale)
        history.append((run, len(chosen), error, [int(i) for i in chosen]))
        weights[chosen] = np.abs(coefficients)
        weights = rescaled(weights)
    return weights, history


def best_run(history, n_features: int | None):
    """Smallest rmse, or the subset size nearest to ``n_features``; the earliest run wins ties."""
    if n_features is None:
        scored = [h for h in history if h[2] is not None]
        return min(scored, key=lambda h: (h[2], h[0])) if scored else None
    return min(history, key=lambda h: (abs(h[1] - n_features), h[0]))


class CARSSelector(Estimator, Settings):
    """Competitive adaptive reweighted sampling with PLS."""

    nComponents = an_int("nComponents")
    runs = an_int("runs")
    nFeatures = an_int("nFeatures")
    decay = a_float("decay")
    folds = an_int("folds")
    seed = an_int("seed")
    scale = a_flag("scale")
    rowIdCol = a_text("rowIdCol")
    DEFAULTS = {
        "nComponents": 10, "runs": 50, "decay": 0.95, "folds": 5, "seed": 42, "scale": True, "rowIdCol": "row_id",
    }

    def _fit(self, df):
        folded = with_folds(df, self.value("folds"), self.value("rowIdCol"), self.value("seed"))
        table = moment_source(folded, self.spectrum, self.label, FOLDS, self.value("folds"))
        return self.from_moments(table, channel_names(df, self.spectrum))

    def from_moments(self, table: FoldMoments | WideTable, names=None) -> CarsSelection:
        weights, history = cars_search(
            table, self.value("runs"), self.value("nComponents"), self.value("decay"), self.value("scale")
        )
        best = best_run(history, self.value("nFeatures"))
        chosen = best[3] if best else list(range(len(weights)))
        return CarsSelection(names, history, spectrumCol=self.spectrum, channels=chosen, scores=weights)


def best_runs(history: DataFrame, n_features: int | None = None) -> DataFrame:
    """The same choice on a history table, per ``search`` when it has that column."""
    by = [c for c in ("search",) if c in history.columns]
    if n_features is None:
        order = F.struct("rmse", "run")
        history = history.filter("rmse is not null")
    else:
        order = F.struct(F.abs(F.col("n_selected") - n_features), F.col("run"))
    return history.groupBy(*by).agg(F.min_by("run", order).alias("best_run"))


def elimination_schedule(df: DataFrame, channels: str, decay: float, runs: int) -> DataFrame:
    """How many of ``channels`` survive in every run: ``(..., run, n_selected)``."""
    run = F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")
    kept = F.greatest(F.floor(F.col(channels) * F.pow(F.lit(decay), F.col("run"))), F.lit(1))
    return df.select("*", run).withColumn("n_selected", kept.cast("int"))


class GeneticSelector(Estimator, Settings):
    """Genetic search for a channel subset.

    Candidates are scored on Spark against broadcast fold moments, or, where these are too large, all
    together by passes over the rows: ``fitness`` is ``pls`` or ``linear`` (cross-validated, negative rmse). A candidate with the better score wins, the smaller
    one on equal scores. Too large winners are cut by absolute correlation with the label. Any other
    learner can score candidates by ``estimator`` (fits on the data, slow) and ``evaluator``.
    """

    nFeatures = an_int("nFeatures")
    population = an_int("population")
    generations = an_int("generations")
    crossover = a_float("crossover")
    mutation = a_float("mutation")
    folds = an_int("folds")
    nComponents = an_int("nComponents")
    seed = an_int("seed")
    fitness = a_text("fitness")
    rowIdCol = a_text("rowIdCol")
    DEFAULTS = {
        "nFeatures": 10, "population": 50, "generations": 20, "crossover": 0.5, "mutation": 0.2, "folds": 5,
        "nComponents": 10, "seed": 42, "fitness": "pls", "rowIdCol": "row_id",
    }

    def __init__(self, estimator=None, evaluator=None, parallelism: int = 4, **kwargs):
        super().__init__(**kwargs)
        self.estimator, self.evaluator, self.parallelism, self._known = estimator, evaluator, parallelism, {}
        if self.value("fitness") not in ("pls", "linear"):
            raise ValueError(f"unknown fitness: {self.value('fitness')}")

    def _fit(self, df):
        folded = with_folds(df, self.value("folds"), self.value("rowIdCol"), 0, contiguous=True)
        table = moment_source(folded, self.spectrum, self.label, FOLDS, self.value("folds"))
        names = channel_names(df, self.spectrum)
        if self.estimator is None:
            return self.from_moments(table, df.sparkSession, names)
        self._known = {}
        folded = durable(folded)  # read by every fit
        return self._search(table, lambda masks: self._fit_scores(folded, masks), names)

    def score_masks(self, df: DataFrame, masks) -> list[float]:
        """Fitness of channel masks by the given estimator and evaluator, as the search scores its candidates."""
        self._known = {}
        folded = durable(with_folds(df, self.value("folds"), self.value("rowIdCol"), 0, contiguous=True))
        return self._fit_scores(folded, [np.asarray(m, dtype=bool) for m in masks])

    def from_moments(self, table: FoldMoments | WideTable, spark: SparkSession, names=None) -> GeneticSelection:
        if isinstance(table, WideTable):
            return self._search(table, wide_scorer(table, self.value("nComponents"), self.value("fitness")), names)
        with _Scorer(spark, table, self.value("nComponents"), self.value("fitness")) as scorer:
            return self._search(table, scorer, names)

    def _fit_scores(self, folded, masks):
        """Score candidates with the given estimator; those seen before, or twice in a generation, are fitted once."""
        unseen = {m.tobytes(): m for m in map(np.asarray, masks) if m.tobytes() not in self._known and m.any()}

        def one(task):
            mask, k = task
            part = folded.withColumn(self.spectrum, take_channels(self.spectrum, np.flatnonzero(unseen[mask])))
            model = self.estimator.fit(part.filter(F.col(FOLDS) != k))
            held = model.transform(part.filter(F.col(FOLDS) == k))
            if self.evaluator is not None:
                return (1 if self.evaluator.isLargerBetter() else -1) * self.evaluator.evaluate(held)
            return -held.agg(rmse(self.label, "prediction")).first()[0]

        tasks = [(mask, k) for mask in unseen for k in range(self.value("folds"))]
        with ThreadPool(self.parallelism) as pool:
            found = dict(zip(tasks, pool.map(inheritable_thread_target(folded.sparkSession)(one), tasks, chunksize=1)))
        for mask in unseen:
            self._known[mask] = float(np.mean([found[mask, k] for k in range(self.value("folds"))]))
        return [self._known.get(np.asarray(m).tobytes(), -np.inf) for m in masks]

    def _search(self, table: FoldMoments | WideTable, score, names) -> GeneticSelection:
        p = table.channels
        winner, history = evolve(
            p, score, self.value("population"), self.value("generations"), self.value("crossover"),
            self.value("mutation"), self.value("seed"),
        )
        strength = np.abs(table.label_correlation())
        chosen = cut_by_correlation(np.flatnonzero(winner), strength, self.value("nFeatures"))
        return GeneticSelection(names, history, spectrumCol=self.spectrum, channels=chosen, scores=strength)


def cut_by_correlation(chosen: np.ndarray, strength: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` of the chosen channels: those most correlated with the label."""
    if len(chosen) <= count:
        return chosen
    order = np.argsort(np.nan_to_num(strength[chosen], nan=-1.0), kind="stable")[-count:]
    return np.sort(chosen[order])


class _Scorer:
    """Scores a generation as one Spark job; equal candidates are scored once."""

    def __init__(self, spark, table: FoldMoments, n_components: int, fitness: str):
        self.spark, self.known = spark, {}
        folds = {k: (m.gram, m.shift) for k, m in table.folds.items()}
        self.shared = spark.sparkContext.broadcast(folds)
        self.settings = (n_components, fitness)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.shared.unpersist()

    def __call__(self, masks):
        keys = [np.packbits(m).tobytes() for m in masks]
        fresh = {k: np.flatnonzero(m).tolist() for k, m in zip(keys, masks) if k not in self.known}
        if fresh:
            order = list(fresh)
            rows = [(i, fresh[k]) for i, k in enumerate(order)]
            shared, settings = self.shared, self.settings

            def score(batches):
                table = FoldMoments({k: Moments(g, s) for k, (g, s) in shared.value.items()})
                for batch in batches:
                    found = [subset_score(table, np.asarray(c, dtype=int), *settings) for c in batch["channels"]]
                    yield pd.DataFrame({"candidate": batch["candidate"], "score": found})

            # a list is spread over the default parallelism without a shuffle
            candidates = self.spark.createDataFrame(rows, "candidate int, channels array<int>")
            scored = candidates.mapInPandas(score, "candidate int, score double")
            for row in scored.collect():
                self.known[order[row["candidate"]]] = row["score"]
        return [self.known[k] for k in keys]


def wide_scorer(table: WideTable, n_components: int, fitness: str):
    """Scores a generation by a pass for each component; ``linear`` goes on until nothing of the label is left."""
    known: dict[bytes, float] = {}

    def score(masks):
        keys = [np.packbits(m).tobytes() for m in masks]
        unseen = {k: np.flatnonzero(m) for k, m in zip(keys, masks) if k not in known}
        known.update({k: float("-inf") for k, c in unseen.items() if not len(c)})
        fitted = [(k, c) for k, c in unseen.items() if len(c)]
        most = n_components if fitness == "pls" else table.channels
        errors = table.cv_errors([c for _, c in fitted], most, False) if fitted else []
        known.update({k: -float(np.mean(e)) for (k, _), e in zip(fitted, errors)})
        return [known[k] for k in keys]

    return score


def subset_score(table: FoldMoments, channels: np.ndarray, n_components: int, fitness: str) -> float:
    """Negative mean held-out rmse of one subset."""
    if not len(channels):
        return float("-inf")
    part = table.take(channels)
    components = min(n_components, len(channels)) if fitness == "pls" else len(channels)
    errors = []
    for train, held in part.pairs():
        fit = fit_latent(train, components, False)
        b = fit.coefficients()
        errors.append(np.sqrt(held.squared_error(b, fit.intercept(b)) / max(held.n, 1)))
    return -float(np.mean(errors))


def evolve(p, score, population, generations, crossover, mutation, seed):
    """Bit-string evolution: tournaments of three, uniform crossover, bit flips, one hall of fame."""
    rng = np.random.default_rng(seed)
    people = rng.integers(0, 2, (population, p)).astype(bool)
    scores = np.array(score(list(people)))
    history, best = [], None

    def rank(i):
        return (scores[i], -people[i].sum())

    for generation in range(generations + 1):
        if generation:
            rounds = rng.integers(0, population, (population, 3))
            parents = [max(entrants, key=rank) for entrants in rounds]
            people = people[parents].copy()
            for i in range(0, population - 1, 2):
                if rng.random() < crossover:
                    swap = rng.random(p) < 0.5
                    people[i, swap], people[i + 1, swap] = people[i + 1, swap].copy(), people[i, swap].copy()
            mutants = rng.random(population) < mutation
            people ^= (rng.random((population, p)) < 0.05) & mutants[:, None]
            scores = np.array(score(list(people)))
        for i in range(population):
            value = float(scores[i])
            history.append((generation, i, value if np.isfinite(value) else None, int(people[i].sum())))
        top = max(range(population), key=rank)
        if best is None or rank(top) > best[0]:
            best = (rank(top), people[top].copy())
    return best[1], history


def top_channels(scores: DataFrame, count: int, score: str = "score", by=()) -> DataFrame:
    """Exactly ``count`` best channels (per group): equal scores by channel order."""
    by = list(by)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), "channel"))
    if not by:
        return scores.orderBy(F.col(score).desc(), "channel").limit(count)
    return scores.withColumn("rank", rank).filter(F.col("rank") <= count).drop("rank")


def top_channels_with_ties(scores: DataFrame, count: int, by, score: str = "score") -> DataFrame:
    """All channels scoring at least as high as the ``count``-th best of their group."""
    rank = F.rank().over(Window.partitionBy(*by).orderBy(F.col(score).desc()))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= count).drop("rank")


def channels_above(scores: DataFrame, threshold: float = 1.0, score: str = "score") -> DataFrame:
    return scores.filter(F.col(score) >= threshold)


