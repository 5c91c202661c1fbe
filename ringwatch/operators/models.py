"""Training, calibration and population scoring with Spark ML.

Trees do not take missing values, so features are imputed with the median beside missing
flags. A model is fitted on the cluster; loops run over folds, bags or parameter draws, whose
number is fixed by the caller.
"""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwatch.operators.bagged import Bags, out_of_bag_scores
from ringwatch.operators.longform import to_long
from ringwatch.operators.metrics import rank_metrics
from ringwatch.operators.splits import stratified_folds
from ringwatch.session import cut_lineage

LABEL, WEIGHT, FEATURES, SCORE = "label", "_weight", "_features", "score"


def positive_weight(df: DataFrame, label: str = LABEL) -> float:
    """Negatives per positive."""
    row = df.agg(F.count_if(F.col(label) == 0).alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    return row["n"] / max(row["p"], 1)


def weighted(df: DataFrame, weight: float, label: str = LABEL) -> DataFrame:
    return df.withColumn(WEIGHT, F.when(F.col(label) == 1, float(weight)).otherwise(1.0))


def boosted_trees(rounds: int = 40, depth: int = 4, step: float = 0.1, subsample: float = 0.9, seed: int = 42):
    """Class-weighted boosted trees."""
    return GBTClassifier(
        labelCol=LABEL, featuresCol=FEATURES, weightCol=WEIGHT, maxIter=rounds, maxDepth=depth, stepSize=step,
        subsamplingRate=subsample, seed=seed, maxMemoryInMB=512,
    )


def logistic(reg: float = 0.01, max_iter: int = 100):
    return LogisticRegression(
        labelCol=LABEL, featuresCol=FEATURES, weightCol=WEIGHT, regParam=reg, maxIter=max_iter
    )


def forest(trees: int = 100, depth: int = 10, seed: int = 42):
    return RandomForestClassifier(
        labelCol=LABEL, featuresCol=FEATURES, weightCol=WEIGHT, numTrees=trees, maxDepth=depth,
        featureSubsetStrategy="sqrt", minInstancesPerNode=2, seed=seed, maxMemoryInMB=512,
    )


def pipeline(features: list[str], learner: Estimator, scale: bool = False) -> Pipeline:
    """Median imputation, assembling, optional scaling, learner."""
    filled = [f"_imp_{i}" for i in range(len(features))]
    raw = "_raw_features" if scale else FEATURES
    stages = [
        Imputer(inputCols=features, outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol=raw),
    ]
    if scale:
        stages.append(StandardScaler(inputCol=raw, outputCol=FEATURES, withMean=True, withStd=True))
    return Pipeline(stages=[*stages, learner])


def as_doubles(df: DataFrame, features: list[str], label: str | None = LABEL) -> DataFrame:
    out = df.withColumns({c: F.col(f"`{c}`").cast("double") for c in features})
    return out.withColumn(LABEL, F.col(label).cast("double")) if label else out


def probability(scored: DataFrame, name: str = SCORE) -> DataFrame:
    drop = [c for c in scored.columns if c.startswith("_") or c in ("rawPrediction", "prediction")]
    return scored.withColumn(name, vector_to_array("probability")[1]).drop("probability", *drop)


def fit(df: DataFrame, features: list[str], learner: Estimator, scale: bool = False) -> PipelineModel:
    rows = as_doubles(df, features)
    return pipeline(features, learner, scale).fit(weighted(rows, positive_weight(rows)))


def score(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Probability of each row in `score`."""
    rows = df.withColumns({c: F.col(f"`{c}`").cast("double") for c in features})
    return probability(model.transform(rows))


def side_by_side(tasks: list[Callable[[], object]], at_once: int = 4) -> list:
    """Results of tasks that each run Spark jobs of their own, some at a time, so that the small last
    stages of one fit leave no core idle."""
    with ThreadPoolExecutor(min(at_once, max(len(tasks), 1))) as pool:
        running = [pool.submit(inheritable_thread_target(t)) for t in tasks]
        return [r.result() for r in running]


def out_of_fold(
    folded: DataFrame, features: list[str], learner: Callable[[], Estimator], k: int, scale: bool = False,
    calibrate: bool = False,
) -> DataFrame:
    """Each row scored by the model that was fitted without its fold.

    The dealt rows are written once; every fit reads that table.
    """
    folded = cut_lineage(folded)

    def one(i: int) -> DataFrame:
        train, test = folded.where(F.col("fold") != i), folded.where(F.col("fold") == i)
        if calibrate:
            return Calibrated.fit(train.drop("fold"), features, learner, scale=scale).score(test)
        return score(fit(train, features, learner(), scale), test, features)

    parts = side_by_side([partial(one, i) for i in range(k)])
    return reduce(DataFrame.unionByName, parts)


class Calibrated:
    """A model with a sigmoid fitted on inner out-of-fold scores (Platt)."""

    def __init__(self, model: PipelineModel, sigmoid: PipelineModel, features: list[str]):
        self.model, self.sigmoid, self.features = model, sigmoid, features

    @classmethod
    def fit(
        cls, df: DataFrame, features: list[str], learner: Callable[[], Estimator], k: int = 3,
        identity: str = "account_id", scale: bool = False,
    ) -> "Calibrated":
        inner = out_of_fold(
            stratified_folds(df, k, LABEL, [identity], seed="inner"), features, learner, k, scale
        )
        # equal scores weigh as one row: the sigmoid sees the histogram, not the accounts
        inner = inner.groupBy(F.col(LABEL).cast("double").alias(LABEL), F.col(SCORE).alias("raw")).agg(
            F.count(F.lit(1)).cast("double").alias("n")
        )
        assembler = VectorAssembler(inputCols=["raw"], outputCol="_raw_vec")
        sigmoid = LogisticRegression(labelCol=LABEL, featuresCol="_raw_vec", weightCol="n")
        fitted = Pipeline(stages=[assembler, sigmoid]).fit(inner)
        return cls(fit(df, features, learner(), scale), fitted, features)

    def score(self, df: DataFrame) -> DataFrame:
        raw = score(self.model, df, self.features).withColumnRenamed(SCORE, "raw")
        return probability(self.sigmoid.transform(raw)).drop("raw")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        self.sigmoid.write().overwrite().save(f"{path}/sigmoid")

    @classmethod
    def load(cls, path: str, features: list[str]) -> "Calibrated":
        return cls(PipelineModel.load(f"{path}/model"), PipelineModel.load(f"{path}/sigmoid"), features)


def holdout_evaluation(
    df: DataFrame, features: list[str], learner: Callable[[], Estimator], identity: str = "account_id", k: int = 5,
    scale: bool = False,
) -> tuple[DataFrame, DataFrame, Calibrated]:
    """Metrics on a stratified fifth, its scores, and the model refitted on all rows.

    The marked rows are written once; the refit too reads that table, so `df` is made once.
    """
    from ringwatch.operators.splits import holdout_split

    split = holdout_split(df, LABEL, [identity], k=k)
    split = cut_lineage(split)
    train = split.where("not is_holdout").drop("is_holdout")
    trained = Calibrated.fit(train, features, learner, identity=identity, scale=scale)
    scored = trained.score(split.where("is_holdout").drop("is_holdout"))
    whole = split.drop("is_holdout")
    return rank_metrics(scored, []), scored, Calibrated.fit(whole, features, learner, identity=identity, scale=scale)


def compare_models(
    folded: DataFrame, features: list[str], learners: dict[str, tuple[Callable[[], Estimator], bool]], k: int
) -> DataFrame:
    """Metrics per model and fold over the same folds; the flag of a learner asks for scaling."""
    folded = cut_lineage(folded)
    parts = [
        out_of_fold(folded, features, learner, k, scale).select(F.lit(name).alias("model"), "fold", LABEL, SCORE)
        for name, (learner, scale) in learners.items()
    ]
    return rank_metrics(reduce(DataFrame.unionByName, parts), ["model", "fold"])


def mean_ensemble(scores: DataFrame, identity: str, score: str = SCORE) -> DataFrame:
    """Mean score per account over several models' out-of-fold scores."""
    return scores.groupBy(identity).agg(F.avg(score).alias(score))


def stacked(scores: DataFrame, identity: str, models: list[str], k: int) -> DataFrame:
    """Out-of-fold logistic blend; `scores` holds identity, model, label and score."""
    wide = scores.groupBy(identity).agg(
        F.max(LABEL).alias(LABEL),
        *[F.max(F.when(F.col("model") == m, F.col(SCORE))).alias(f"s_{m}") for m in models],
    )
    folded = stratified_folds(wide, k, LABEL, [identity], seed="stack")
    return out_of_fold(folded, [f"s_{m}" for m in models], lambda: logistic(reg=0.0), k).select(
        identity, LABEL, SCORE
    )


def random_search(
    folded: DataFrame, features: list[str], k: int, draws: int = 12, seed: int = 42
) -> DataFrame:
    """Random boosted-tree settings, each scored by average precision over the folds."""
    import random

    rng = random.Random(seed)
    folded = cut_lineage(folded)
    # a table of few parts leaves cores idle in each fit, so as many fits run at once as fill them
    cores, parts = folded.sparkSession.sparkContext.defaultParallelism, max(1, folded.rdd.getNumPartitions())
    chosen = [
        {
            "rounds": rng.randint(20, 60),
            "depth": rng.randint(3, 6),
            "step": round(rng.uniform(0.03, 0.2), 3),
            "subsample": round(rng.uniform(0.6, 1.0), 3),
        }
        for _ in range(draws)
    ]

    def one(draw: int, fold: int) -> DataFrame:
        setting = chosen[draw]
        train, test = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        part = score(fit(train, features, boosted_trees(**setting)), test, features).select(LABEL, SCORE)
        return part.withColumns({"draw": F.lit(draw), **{n: F.lit(v) for n, v in setting.items()}})

    out = reduce(DataFrame.unionByName, side_by_side([partial(one, d, f) for d in range(draws) for f in range(k)], max(4, -(-cores // parts))))
    settings = ["draw", "rounds", "depth", "step", "subsample"]
    return rank_metrics(out, settings).select(*settings, "average_precision", "roc_auc")


def feature_importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features of a tree model by importance, highest first."""
    weights = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, (float(w) for w in weights)), key=lambda p: (-p[1], p[0]))


def bagged_unlabelled(
    df: DataFrame, features: list[str], bags: int = 50, depth: int = 8, seed: int = 42, identity: str = "account_id"
) -> DataFrame:
    """Positive-unlabelled bagging: every row gets the mean score of the bags it was not in.

    A bag holds a random four fifths of the positives and about as many negatives, so positives
    too are scored by trees that never saw them. Each row has one bag it never joins, so no row
    is left without a score. All bags grow together, a level at a time.
    """
    ratio = 1.0 / max(positive_weight(df), 1.0)
    return out_of_bag_scores(df, features, Bags(bags, ratio, seed), depth, LABEL, identity, SCORE)


def typology_clusters(
    df: DataFrame, features: list[str], k: int = 3, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """K-means archetypes of the positives: cluster of each row, and what sets each cluster apart.

    The second frame ranks the features of a cluster by how far its mean is from the mean of all
    positives, in standard deviations.
    """
    rows = as_doubles(df, features).where(F.col(LABEL) == 1)
    model = pipeline(features, KMeans(featuresCol=FEATURES, predictionCol="cluster", k=k, seed=seed), scale=True).fit(rows)
    placed = model.transform(rows).drop(FEATURES, "_raw_features", *[f"_imp_{i}" for i in range(len(features))])
    long = to_long(placed, features, ["cluster"]).where("value is not null")
    overall = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    per = long.groupBy("cluster", "feature").agg(F.avg("value").alias("cluster_mean"), F.count(F.lit(1)).alias("n"))
    deviation = F.abs(F.col("cluster_mean") - F.col("mean")) / (F.col("std") + 1e-9)
    return placed, per.join(overall, "feature").select(
        "cluster", "feature", "n", "cluster_mean", deviation.alias("deviation")
    )
