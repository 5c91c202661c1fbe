"""Exact evaluation of rare-event scores over any (run, score, label) table.

Every curve starts from the histogram of distinct scores, so ties count once, and its
running totals come from `prefix_sums`, so no run is sorted in one task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwatch import constants as K
from ringwatch.functions.numbers import grid_index, risk_score
from ringwatch.functions.policy import band
from ringwatch.operators.running import exact_quantiles, prefix_sums
from ringwatch.operators.skew import join_counted


def score_histogram(scores: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    return (
        scores.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*keys, F.col(score).alias("score"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    )


def score_curve(hist: DataFrame, keys: list[str], small_groups: bool = False) -> DataFrame:
    """Per distinct score as threshold: alerts, tp, fp and the totals of the run."""
    return prefix_sums(hist, keys, "score", ["n", "pos"], ascending=False, small_groups=small_groups).select(
        *keys,
        "score",
        "n",
        "pos",
        (F.col("n_before") + F.col("n")).alias("alerts"),
        (F.col("pos_before") + F.col("pos")).alias("tp"),
        F.col("n_total").alias("n_rows"),
        F.col("pos_total").alias("n_pos"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def rank_metrics(scores: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Average precision, ROC AUC with ties on mid-ranks, Brier score, prevalence, best recall
    at a precision of one half, per run."""
    curve = score_curve(score_histogram(scores, keys, score, label), keys)
    precision = _ratio(F.col("tp"), F.col("alerts"))
    neg = F.col("n_rows") - F.col("n_pos")
    below = neg - (F.col("alerts") - F.col("tp"))
    pairs = F.col("pos").cast("double") * (below + (F.col("n") - F.col("pos")) / 2.0)
    s, y = F.col("score"), F.col("pos").cast("double")
    squared = y * (s - 1) * (s - 1) + (F.col("n") - y) * s * s
    return curve.groupBy(*keys).agg(
        F.sum(_ratio(F.col("pos"), F.col("n_pos")) * precision).alias("average_precision"),
        _ratio(F.sum(pairs), F.max(F.col("n_pos").cast("double") * neg)).alias("roc_auc"),
        _ratio(F.sum(squared), F.max("n_rows")).alias("brier"),
        _ratio(F.max("n_pos"), F.max("n_rows")).alias("prevalence"),
        F.coalesce(
            F.max(F.when(precision >= 0.5, _ratio(F.col("tp"), F.col("n_pos")))), F.lit(0.0)
        ).alias("recall_at_half_precision"),
        F.max("n_rows").alias("n_rows"),
        F.max("n_pos").alias("n_pos"),
    )


def pr_points(scores: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Precision and recall at each distinct score, plus the end point without alerts."""
    curve = score_curve(score_histogram(scores, keys, score, label), keys)
    points = curve.select(
        *keys,
        F.col("score").alias("threshold"),
        _ratio(F.col("tp"), F.col("alerts")).alias("precision"),
        _ratio(F.col("tp"), F.col("n_pos")).alias("recall"),
    )
    return points.unionByName(_end_points(scores, keys, {"precision": 1.0, "recall": 0.0}))


def roc_points(scores: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """False and true positive rate at each distinct score, plus the origin."""
    curve = score_curve(score_histogram(scores, keys, score, label), keys)
    points = curve.select(
        *keys,
        F.col("score").alias("threshold"),
        _ratio(F.col("alerts") - F.col("tp"), F.col("n_rows") - F.col("n_pos")).alias("fpr"),
        _ratio(F.col("tp"), F.col("n_pos")).alias("tpr"),
    )
    return points.unionByName(_end_points(scores, keys, {"fpr": 0.0, "tpr": 0.0}))


def _end_points(scores: DataFrame, keys: list[str], values: dict[str, float]) -> DataFrame:
    one = scores.groupBy(*keys).agg(F.lit(None).cast("double").alias("threshold"))
    return one.withColumns({name: F.lit(v) for name, v in values.items()})


def threshold_table(
    scores: DataFrame, grid: list[float], keys: list[str], score: str = "score", label: str = "label"
) -> DataFrame:
    """Alerts, caught, false alarms, precision and recall at every grid threshold, in one pass.

    A row adds to the one grid cell it falls in; the cells, not the rows, are then summed up
    over the thresholds they reach.
    """
    grid = sorted(grid)
    cells = (
        scores.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*keys, grid_index(F.col(score), grid).alias("_cell"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    )
    steps = F.posexplode(F.array(*[F.lit(float(t)) for t in grid])).alias("_step", "threshold")
    reached = F.col("_cell") > F.col("_step")
    out = (
        cells.select("*", steps)
        .groupBy(*keys, "threshold")
        .agg(
            F.sum(F.when(reached, F.col("n")).otherwise(0)).alias("alerts"),
            F.sum(F.when(reached, F.col("pos")).otherwise(0)).alias("caught"),
            F.sum("pos").alias("n_pos"),
            F.sum("n").alias("n_rows"),
        )
    )
    return out.select(
        *keys,
        "threshold",
        "alerts",
        "caught",
        (F.col("alerts") - F.col("caught")).alias("false_alarms"),
        F.coalesce(_ratio(F.col("caught"), F.col("alerts")), F.lit(0.0)).alias("precision"),
        F.coalesce(_ratio(F.col("caught"), F.col("n_pos")), F.lit(0.0)).alias("recall"),
        "n_pos",
        "n_rows",
    )


def recall_points(table: DataFrame, targets: list[float], keys: list[str]) -> DataFrame:
    """Highest threshold that still reaches each recall target; null when none does."""
    wanted = table.select("*", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target_recall"))
    picked = F.max(
        F.when(
            F.col("recall") >= F.col("target_recall"),
            F.struct("threshold", "precision", "recall", "false_alarms", "alerts", "caught"),
        )
    )
    return (
        wanted.groupBy(*keys, "target_recall")
        .agg(picked.alias("p"), F.max("recall").alias("max_recall"))
        .select(
            *keys,
            "target_recall",
            F.col("p").isNotNull().alias("achievable"),
            F.col("p.threshold").alias("threshold"),
            F.col("p.precision").alias("precision"),
            F.col("p.recall").alias("achieved_recall"),
            F.col("p.false_alarms").alias("false_alarms"),
            F.col("p.alerts").alias("alerts"),
            "max_recall",
        )
    )


def confusion(
    scores: DataFrame, threshold: float, keys: list[str], score: str = "score", label: str = "label",
    loss: float = K.MULE_LOSS, review: float = K.REVIEW_COST, harm: float = K.WRONG_ALERT_HARM,
) -> DataFrame:
    """Confusion counts and net value at one threshold."""
    up, y = F.col(score) >= threshold, F.col(label)
    counts = scores.groupBy(*keys).agg(
        F.count_if(up & (y == 1)).alias("tp"),
        F.count_if(up & (y == 0)).alias("fp"),
        F.count_if(~up & (y == 1)).alias("fn"),
        F.count_if(~up & (y == 0)).alias("tn"),
    )
    alerts = F.col("tp") + F.col("fp")
    return counts.withColumns(
        {
            "alerts": alerts,
            "recall": F.coalesce(_ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)),
            "precision": F.coalesce(_ratio(F.col("tp"), alerts), F.lit(0.0)),
            "net_value": F.col("tp") * loss - alerts * review - F.col("fp") * harm,
        }
    )


def calibration_table(
    scores: DataFrame, bins: int, keys: list[str], score: str = "score", label: str = "label"
) -> DataFrame:
    """Mean score and outcome rate per quantile bin; a bin that ties leave empty is left out."""
    cuts = {f"_e{i}": i / bins for i in range(1, bins)}
    edges = exact_quantiles(scores, score, cuts, keys)
    # right-closed bins: a score equal to an edge belongs to the bin below it
    index = sum((F.when(F.col(score) > F.col(c), 1).otherwise(0) for c in cuts), F.lit(0))
    placed = (
        join_counted(scores, edges, keys)
        if keys
        else scores.withColumns({c: edges.select(c).scalar() for c in cuts})
    )
    return (
        placed.groupBy(*keys, index.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col(score)).alias("mean_score"),
            F.avg(F.col(label).cast("double")).alias("positive_rate"),
        )
    )


def with_score_and_band(scores: DataFrame, probability: str = "score") -> DataFrame:
    """Whole-number risk score and band from a probability."""
    return scores.withColumn("risk_score", risk_score(probability)).withColumn("band", band(F.col("risk_score")))


def score_buckets(scored: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Accounts per ten-point score bucket and class."""
    bucket = (F.floor(F.col("risk_score") / 10) * 10).cast("int").alias("score_bucket")
    return scored.groupBy(*keys, bucket).agg(
        F.count_if(F.col(label) == 1).alias("mule"), F.count_if(F.col(label) == 0).alias("legit")
    )


def band_table(scored: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Accounts per band and class in the fixed band order, empty bands as zero rows."""
    order = F.posexplode(F.array(*[F.lit(b) for b in K.BAND_ORDER])).alias("band_order", "_band")
    counts = scored.groupBy(*keys, "band", label).agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("band") == F.col("_band")
    return (
        counts.select("*", order)
        .groupBy(*keys, "band_order", F.col("_band").alias("band_name"))
        .agg(
            F.sum(F.when(hit & (F.col(label) == 1), F.col("n")).otherwise(0)).alias("mule"),
            F.sum(F.when(hit & (F.col(label) == 0), F.col("n")).otherwise(0)).alias("legit"),
        )
        .withColumnRenamed("band_name", "band")
    )


def positive_score_percentiles(
    scored: DataFrame, quantiles: dict[str, float], keys: list[str], label: str = "label"
) -> DataFrame:
    """Percentiles of the positives' risk scores and the share at HIGH or above.

    Risk scores are whole numbers from 0 to 100, so the percentiles come from 101 counts.
    """
    positive = scored.where(F.col(label) == 1)
    percentiles = exact_quantiles(positive, "risk_score", quantiles, keys)
    share = positive.groupBy(*keys).agg(F.avg((F.col("risk_score") >= 70).cast("double")).alias("share_high"))
    return percentiles.join(share, keys) if keys else percentiles.withColumn("share_high", share.scalar())


def watchlist(scored: DataFrame, k: int, order: str = "risk_score", tie: str = "account_id") -> DataFrame:
    return scored.orderBy(F.desc(order), tie).limit(k)


def precision_at_k(scored: DataFrame, k: int, order: str, tie: str, label: str = "label") -> DataFrame:
    top = watchlist(scored, k, order, tie)
    return top.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col(label).cast("bigint")).alias("hits"),
        F.avg(F.col(label).cast("double")).alias("precision"),
    )


def alert_list(scored: DataFrame, threshold: float, probability: str = "score") -> DataFrame:
    """Everything at or above the threshold, for export."""
    return scored.where(F.col(probability) >= threshold)


def fold_interval(folds: DataFrame, keys: list[str], metric: str, critical: float = K.T_CRITICAL_DF9) -> DataFrame:
    """Mean, spread and interval of a metric over folds (spread without the n-1 correction)."""
    half = F.lit(critical) * F.stddev_pop(metric) / F.sqrt(F.count(metric))
    return folds.groupBy(*keys).agg(
        F.count(metric).alias("n_folds"),
        F.avg(metric).alias("mean"),
        F.stddev_pop(metric).alias("std"),
        (F.avg(metric) - half).alias("ci_lo"),
        (F.avg(metric) + half).alias("ci_hi"),
    )


def challenger_test(folds: DataFrame, model: str, metric: str, baseline: str) -> DataFrame:
    """One row: the best model, and whether it beats the baseline by more than its spread."""
    stats = folds.groupBy(model).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))
    base = F.col(model) == baseline
    summary = stats.agg(
        F.max_by(model, F.struct("mean", model)).alias("best_model"),
        F.max("mean").alias("best_mean"),
        F.max(F.when(base, F.col("mean"))).alias("baseline_mean"),
        F.max(F.when(base, F.col("std"))).alias("baseline_std"),
    )
    return summary.withColumn("adopt", F.col("best_mean") - F.col("baseline_mean") > F.col("baseline_std"))


def metrics_rows(metrics: DataFrame, dataset: str, keys: list[str]) -> DataFrame:
    """Wide metrics as (dataset, keys, metric, value) rows; the dataset tag may not be empty."""
    if not dataset or not dataset.strip():
        raise ValueError("metrics need a dataset tag")
    names = [c for c in metrics.columns if c not in keys]
    doubles = metrics.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    return doubles.unpivot(keys, names, "metric", "value").withColumn("dataset", F.lit(dataset))


def leaderboard(metrics: DataFrame, metric: str = "average_precision") -> DataFrame:
    return metrics.orderBy(F.desc(metric))
