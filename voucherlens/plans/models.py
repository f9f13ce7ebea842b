"""Training, evaluation and scoring with ``pyspark.ml``."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from voucherlens.columns import (
    LABEL, LINEAR_ALPHAS, LINEAR_L1_RATIOS, LINEAR_MAX_ITER, MODEL_SEED, predictors,
)
from voucherlens.functions.labels import binary_label
from voucherlens.operators.ranking import auc, mean_coupon_auc, pooled_auc
from voucherlens.operators.scaling import fit_standard, standard_sql
from voucherlens.operators.summary import accuracy
from voucherlens.plans import boosting
from voucherlens.plans.boosting import Grown, TreeSettings
from voucherlens.session import dealt, tasks_for

IS_VALID = "is_valid"
SCALED = "z_"
PARALLEL_FITS = 4


@dataclass
class Fitted:
    """A fitted pipeline with its held-out AUC and the settings tried."""

    model: PipelineModel
    valid_auc: float
    trials: list[dict]


def split_table(
    train: DataFrame, valid: DataFrame, *, drop_unreceived: bool = False
) -> DataFrame:
    """Both tables as one, with the fixed split as a column and a 0/1 label.

    Rows without a receipt count as 0, or are left out with ``drop_unreceived``.
    """
    if drop_unreceived:
        train, valid = (t.where(F.col(LABEL) != -1) for t in (train, valid))
    both = train.withColumn(IS_VALID, F.lit(False)).unionByName(
        valid.withColumn(IS_VALID, F.lit(True))
    )
    return both.withColumn(LABEL, binary_label(F.col(LABEL)))


def _assembler(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="features")


def _labels_for(df: DataFrame) -> DataFrame:
    return df.select("features", F.col(LABEL).cast("double").alias(LABEL), IS_VALID)


def score(model: PipelineModel, table: DataFrame) -> DataFrame:
    """``table`` with ``score``, the probability of redemption, and ``prediction``."""
    scored = model.transform(table)
    if "score" in scored.columns:  # trees grown in blocks give it themselves
        return scored.select(*table.columns, "score", "prediction")
    return scored.withColumn("score", vector_to_array("probability")[1]).select(
        *table.columns, "score", "prediction"
    )


def _grid_auc(trials: list, valid: DataFrame) -> list[float]:
    """Held-out AUC of several fitted models, all in one pass and one job."""
    scores = [
        F.struct(F.lit(i).alias("trial"), F.col(f"score_{i}").alias("score"))
        for i in range(len(trials))
    ]
    for i, model in enumerate(trials):
        scored = model.transform(valid)
        valid = scored.withColumn(f"score_{i}", vector_to_array("probability")[1]).drop(
            "probability", "rawPrediction", "prediction"
        )
    long = valid.select(LABEL, F.explode(F.array(*scores)).alias("s")).select(LABEL, "s.*")
    found = {r["trial"]: r["auc"] for r in auc(long, ["trial"]).collect()}
    return [found.get(i, float("nan")) for i in range(len(trials))]


def _fit_all(estimator, table: DataFrame, grid: list[dict], rows: int) -> list:
    """One model per setting; their jobs run side by side on the cluster.

    Every fit caches the rows in blocks of its own. A table that keeps all cores busy by
    itself is fitted one setting at a time, so that one copy is held.
    """
    at_once = PARALLEL_FITS if tasks_for(table.sparkSession, rows) == 1 else 1
    fits = estimator.fitMultiple(table, grid)
    fit_next = inheritable_thread_target(table.sparkSession)(lambda _: next(fits))
    with ThreadPool(min(len(grid), at_once)) as pool:
        found = dict(pool.imap_unordered(fit_next, grid))
    return [found[i] for i in range(len(grid))]


def logistic_grid(
    train: DataFrame,
    valid: DataFrame,
    *,
    alphas: list[float] = LINEAR_ALPHAS,
    l1_ratios: list[float] = LINEAR_L1_RATIOS,
    max_iter: int = LINEAR_MAX_ITER,
    columns: list[str] | None = None,
    drop_unreceived: bool = False,
) -> Fitted:
    """Elastic-net logistic regression over a grid, judged on the fixed split.

    Every setting is fitted on ``train`` and judged by pooled AUC on ``valid``;
    the best one is fitted again on both. The scaling is fitted anew each time
    and is part of the saved pipeline.
    """
    both = split_table(train, valid, drop_unreceived=drop_unreceived)
    names = columns or predictors(train.columns)

    def prepared(table: DataFrame) -> tuple[list, DataFrame]:
        scaler = SQLTransformer(statement=standard_sql(fit_standard(table, names), SCALED))
        stages = [scaler, _assembler([SCALED + c for c in names])]
        return stages, PipelineModel(stages)

    def linear(**settings: float) -> LogisticRegression:
        return LogisticRegression(
            labelCol=LABEL, maxIter=max_iter, standardization=False, **settings
        )

    _, preparation = prepared(both.where(~F.col(IS_VALID)))
    rows = both.count()
    ready = dealt(_labels_for(preparation.transform(both)), rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        estimator = linear()
        grid = (
            ParamGridBuilder()
            .addGrid(estimator.regParam, alphas)
            .addGrid(estimator.elasticNetParam, l1_ratios)
            .build()
        )
        models = _fit_all(estimator, ready.where(~F.col(IS_VALID)), grid, rows)
        aucs = _grid_auc(models, ready.where(IS_VALID))
    finally:
        ready.unpersist()
    trials = [
        {
            "alpha": params[estimator.regParam],
            "l1_ratio": params[estimator.elasticNetParam],
            "auc": value,
        }
        for params, value in zip(grid, aucs)
    ]
    best = trials[boosting.best_of([t["auc"] for t in trials]) - 1]
    stages, _ = prepared(both)
    final = Pipeline(
        stages=[*stages, linear(regParam=best["alpha"], elasticNetParam=best["l1_ratio"])]
    ).fit(both)
    return Fitted(final, best["auc"], trials)


# Boosting rounds of each setting, and rounds without a better one before a stop.
ROUNDS = {"deep": 800, "tuned": 300, "watched": 3000}
PATIENCE = 300


# Depth, step, sampling and leaf size of each setting.
TREES = {
    "deep": TreeSettings(max_depth=6, step=0.1, subsample=0.8, features="sqrt", min_rows=3),
    "tuned": TreeSettings(max_depth=5, step=0.1, subsample=0.8, features="0.8", min_rows=2),
    "watched": TreeSettings(max_depth=5, step=0.01, subsample=0.7, features="0.7", min_rows=1),
}


def boosted_trees(kind: str = "tuned", *, rounds: int | None = None) -> GBTClassifier:
    """Boosted trees in one of three settings.

    ``deep`` and ``tuned`` carry the tree settings of the two batch models,
    ``watched`` those of the early-stopping one. Every round runs a few jobs;
    ``rounds`` sets another number than that of the setting.
    """
    tree = TREES[kind]
    return GBTClassifier(
        labelCol=LABEL, maxIter=ROUNDS[kind] if rounds is None else rounds, seed=MODEL_SEED,
        maxDepth=tree.max_depth, stepSize=tree.step, subsamplingRate=tree.subsample,
        featureSubsetStrategy=tree.features, minInstancesPerNode=tree.min_rows,
    )


def fit_trees(
    train: DataFrame,
    valid: DataFrame,
    *,
    kind: str = "tuned",
    rounds: int | None = None,
    columns: list[str] | None = None,
    drop_unreceived: bool = False,
) -> Fitted:
    """Boosted trees judged on the fixed split, then fitted on both tables."""
    both = split_table(train, valid, drop_unreceived=drop_unreceived)
    stages = [_assembler(columns or predictors(train.columns))]
    ready = dealt(_labels_for(PipelineModel(stages).transform(both)), both.count()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        estimator = boosted_trees(kind, rounds=rounds)
        held_out = estimator.fit(ready.where(~F.col(IS_VALID)))
        value = _grid_auc([held_out], ready.where(IS_VALID))[0]
        final = estimator.fit(ready)
    finally:
        ready.unpersist()
    return Fitted(
        PipelineModel([*stages, final]), value, [{"rounds": estimator.getMaxIter(), "auc": value}]
    )


def _ready(table: DataFrame, columns: list[str], part) -> tuple[list, DataFrame]:
    """The assembler, and features, label and held-out part of every row, written once."""
    stages = [_assembler(columns)]
    featured = PipelineModel(stages).transform(table)
    return stages, featured.select("features", F.col(LABEL).cast("double").alias(LABEL), part.cast("int").alias(boosting.PART))


def fit_watched_trees(
    train: DataFrame,
    valid: DataFrame,
    *,
    rounds: int | None = None,
    patience: int = PATIENCE,
    settings: TreeSettings | None = None,
    columns: list[str] | None = None,
    drop_unreceived: bool = False,
) -> Fitted:
    """Trees grown until the AUC on ``valid`` has not risen for ``patience`` rounds.

    The model keeps the trees up to the best round. ``trials`` holds the best
    round, the rounds grown and the AUC of both tables after each of them.
    """
    settings = settings or TREES["watched"]
    both = split_table(train, valid, drop_unreceived=drop_unreceived)
    stages, ready = _ready(both, columns or predictors(train.columns), F.when(F.col(IS_VALID), 0).otherwise(-1))
    grown, best = boosting.grow_watched(
        ready, settings, rounds=ROUNDS["watched"] if rounds is None else rounds, patience=patience
    )
    curve = sorted(grown.curve, key=lambda r: (r["round"], r["held_out"]))
    trial = {"rounds": best, "grown": grown.rounds, "auc": grown.held_out()[best - 1], "curve": curve}
    return Fitted(boosting.scoring_model(stages, grown, best), trial["auc"], [trial])


def fold_of(rows: DataFrame, folds: int, seed: int = MODEL_SEED):
    """The fold of a row by a hash of all its columns: the same however rows are dealt."""
    return F.pmod(F.xxhash64(*rows.columns, F.lit(seed)), F.lit(folds))


def kfold_curve(grown: Grown, spark) -> DataFrame:
    """Mean and deviation over folds of the AUC after every round, in and out of sample."""
    schema = "round int, model int, held_out boolean, auc double"
    rows = spark.createDataFrame([(r["round"], r["model"], r["held_out"], r["auc"]) for r in grown.curve], schema)
    side = lambda held: F.when(F.col("held_out") == held, F.col("auc"))
    return rows.groupBy("round").agg(
        F.count(side(True)).alias("folds"),
        F.avg(side(False)).alias("train_auc_mean"), F.stddev_pop(side(False)).alias("train_auc_std"),
        F.avg(side(True)).alias("test_auc_mean"), F.stddev_pop(side(True)).alias("test_auc_std"),
    ).orderBy("round")


def kfold_rounds(
    train: DataFrame, *, folds: int = 3, rounds: int | None = None, fold=None, columns: list[str] | None = None
) -> Grown:
    """Boosted trees of all folds, grown side by side, with their AUC after every round.

    ``fold`` is a column that deals the rows; a hash of the row does if it is not given.
    """
    table = train.withColumn(LABEL, binary_label(F.col(LABEL)))
    part = fold_of(table, folds) if fold is None else fold
    _, ready = _ready(table, columns or predictors(train.columns), part)
    return boosting.grow_all(ready, folds, TREES["tuned"], rounds=ROUNDS["tuned"] if rounds is None else rounds)


def kfold_report(
    train: DataFrame, *, folds: int = 3, rounds: int | None = None, columns: list[str] | None = None
) -> tuple[Fitted, DataFrame]:
    """Held-out AUC over folds after the last round, then a fit on everything with its accuracy and AUC."""
    grown = kfold_rounds(train, folds=folds, rounds=rounds, columns=columns)
    last = kfold_curve(grown, train.sparkSession).where(F.col("round") == grown.rounds).first()
    mean_auc = last["test_auc_mean"]
    table = train.withColumn(LABEL, binary_label(F.col(LABEL)))
    # No row is held out from this one.
    stages, ready = _ready(table, columns or predictors(train.columns), F.lit(-1))
    whole = boosting.grow_all(ready, 1, TREES["tuned"], rounds=grown.rounds)
    model = boosting.scoring_model(stages, whole, whole.rounds)
    scored = score(model, table)
    values = [("fold_auc", float(mean_auc)), ("fold_auc_std", float(last["test_auc_std"]))]
    report = (
        accuracy(scored)
        .select(F.lit("train_accuracy").alias("metric"), F.col("accuracy").alias("value"))
        .unionByName(pooled_auc(scored).select(F.lit("train_auc").alias("metric"), F.col("auc").alias("value")))
        .unionByName(train.sparkSession.createDataFrame(values, "metric string, value double"))
    )
    return Fitted(model, mean_auc, [{"folds": folds, "auc": mean_auc}]), report


def quality_report(fitted: Fitted, valid: DataFrame) -> DataFrame:
    """Held-out AUC first, then the in-sample mean AUC per coupon of the final model."""
    spark = valid.sparkSession
    held_out = spark.createDataFrame(
        [("held_out_auc", float(fitted.valid_auc))], "metric string, value double"
    )
    table = valid.withColumn(LABEL, binary_label(F.col(LABEL)))
    in_sample = mean_coupon_auc(score(fitted.model, table)).select(
        F.lit("in_sample_mean_coupon_auc").alias("metric"), F.col("mean_auc").alias("value")
    )
    return held_out.unionByName(in_sample)


def feature_importances(fitted: Fitted, spark) -> DataFrame:
    """Predictors of a tree model by falling importance."""
    assembler, trees = fitted.model.stages[0], fitted.model.stages[-1]
    rows = list(zip(assembler.getInputCols(), trees.featureImportances.toArray().tolist()))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )
