"""Decision policies over scored accounts: cost curve, abstention, graduated action, capacity."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwatch import constants as K
from ringwatch.operators.metrics import threshold_table
from ringwatch.operators.running import prefix_sums
from ringwatch.operators.skew import join_counted


def cost_curve(
    scores: DataFrame, keys: list[str], grid: list[float] | None = None, score: str = "score", label: str = "label",
    loss: int = K.MULE_LOSS, review: int = K.REVIEW_COST, harm: int = K.WRONG_ALERT_HARM,
) -> DataFrame:
    """Net savings against doing nothing, per threshold."""
    table = threshold_table(scores, grid or K.COST_GRID, keys, score, label)
    net = F.col("caught") * loss - F.col("alerts") * review - F.col("false_alarms") * harm
    return table.withColumn("net_savings", net)


def best_operating_point(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Threshold with the highest net savings; the lowest such threshold on a tie."""
    best = F.max_by(
        F.struct("threshold", "alerts", "caught", "recall", "net_savings"),
        F.struct("net_savings", -F.col("threshold")),
    )
    return curve.groupBy(*keys).agg(best.alias("b"), F.max("n_pos").alias("n_pos")).select(
        *keys, "b.*", (F.col("n_pos") - F.col("b.caught")).alias("missed")
    )


def abstention_thresholds(
    scores: DataFrame, keys: list[str], score: str = "score", label: str = "label",
    precision: float = K.TARGET_PRECISION, npv: float = K.TARGET_NPV,
) -> DataFrame:
    """Lowest t_hi whose upper zone meets the precision, highest t_lo whose lower zone meets the NPV.

    Thresholds come from the scores rounded to four digits; zones compare the raw score.
    """
    grid = (
        scores.groupBy(*keys, F.bround(score, 4).alias("t"))
        .agg(F.lit(0).cast("bigint").alias("n"))
    )
    raw = scores.groupBy(*keys, F.col(score).alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
    )
    # one point list of thresholds and raw scores: a threshold row carries no accounts itself
    points = (
        raw.select(*keys, F.col("s").alias("t"), "n", "pos", F.lit(0).alias("is_grid"))
        .unionByName(grid.select(*keys, "t", "n", F.lit(0).cast("bigint").alias("pos"), F.lit(1).alias("is_grid")))
        .groupBy(*keys, "t")
        .agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.max("is_grid").alias("is_grid"))
    )
    run = prefix_sums(points, keys, "t", ["n", "pos"])
    up_n = F.col("n_total") - F.col("n_before")
    up_pos = F.col("pos_total") - F.col("pos_before")
    low_n = F.col("n_before") + F.col("n")
    low_neg = low_n - F.col("pos_before") - F.col("pos")
    is_grid = F.col("is_grid") == 1
    reaches = is_grid & (up_n > 0) & (F.try_divide(up_pos.cast("double"), up_n) >= precision)
    clears = is_grid & (low_n > 0) & (F.try_divide(low_neg.cast("double"), low_n) >= npv)
    found = run.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(reaches, F.col("t"))), F.lit(1.0)).alias("hi"),
        F.coalesce(F.max(F.when(clears, F.col("t"))), F.lit(0.0)).alias("lo"),
    )
    crossed = F.col("lo") >= F.col("hi")
    return found.select(
        *keys,
        F.when(crossed, K.DEFAULT_T_LO).otherwise(F.col("lo")).alias("t_lo"),
        F.when(crossed, K.DEFAULT_T_HI).otherwise(F.col("hi")).alias("t_hi"),
    )


def _with_thresholds(scores: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Thresholds are one row per run: a scalar without runs, a small join side with them."""
    if keys:
        return join_counted(scores, thresholds, keys)
    return scores.withColumns({c: thresholds.select(c).scalar() for c in ("t_lo", "t_hi")})


def abstention_report(
    scores: DataFrame, thresholds: DataFrame, keys: list[str], score: str = "score", label: str = "label"
) -> DataFrame:
    """Coverage, errors and zone quality of the abstention policy."""
    rows = _with_thresholds(scores, thresholds, keys)
    p, y = F.col(score), F.col(label)
    sure, clear = p >= F.col("t_hi"), p <= F.col("t_lo")
    counts = rows.groupBy(*keys, "t_lo", "t_hi").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(sure | clear).alias("n_auto"),
        F.count_if(~sure & ~clear).alias("n_uncertain"),
        F.count_if((sure & (y == 0)) | (clear & (y == 1))).alias("auto_zone_errors"),
        F.count_if(~sure & ~clear & (y == 1)).alias("mules_routed_to_review"),
        F.coalesce(F.avg(F.when(sure, y.cast("double"))), F.lit(0.0)).alias("confident_mule_precision"),
        F.coalesce(F.avg(F.when(clear, 1.0 - y)), F.lit(0.0)).alias("confident_legit_npv"),
    )
    return counts.withColumns(
        {
            "coverage_auto_decided": F.col("n_auto") / F.col("n"),
            "review_rate": F.col("n_uncertain") / F.col("n"),
            "auto_zone_error_rate": F.col("auto_zone_errors") / F.greatest(F.col("n_auto"), F.lit(1)),
        }
    )


def graduated_policy(
    scores: DataFrame, keys: list[str], t_lo: float, score: str = "score", label: str = "label",
    freeze_min: float = K.FREEZE_MIN, naive_min: float = K.NAIVE_FREEZE_MIN, loss: int = K.MULE_LOSS,
    review: int = K.REVIEW_COST, step_up: int = K.STEP_UP_COST, freeze_harm: int = K.WRONG_FREEZE_HARM,
) -> DataFrame:
    """Freeze-or-clear at one threshold beside clear / step-up / freeze, with total costs."""
    p, y = F.col(score), F.col(label)
    naive, freeze = p >= naive_min, p >= freeze_min
    verify = (p >= t_lo) & ~freeze
    c = scores.groupBy(*keys).agg(
        F.count_if(naive).alias("naive_freezes"),
        F.count_if(naive & (y == 0)).alias("naive_wrong_freezes"),
        F.count_if(naive & (y == 1)).alias("naive_mules_frozen"),
        F.count_if(~naive & (y == 1)).alias("_naive_missed"),
        F.count_if(freeze).alias("freezes"),
        F.count_if(freeze & (y == 0)).alias("wrong_freezes"),
        F.count_if(freeze & (y == 1)).alias("mules_frozen"),
        F.count_if(verify).alias("step_ups"),
        F.count_if(verify & (y == 1)).alias("mules_in_step_up"),
        F.count_if(verify & (y == 0)).alias("legit_in_step_up"),
        F.count_if(~freeze & ~verify & (y == 1)).alias("_missed"),
    )
    naive_cost = (
        F.col("naive_wrong_freezes") * freeze_harm + F.col("_naive_missed") * loss + F.col("naive_freezes") * review
    )
    cost = (
        F.col("wrong_freezes") * freeze_harm + F.col("_missed") * loss
        + F.col("step_ups") * step_up + F.col("freezes") * review
    )
    return (
        c.withColumn("naive_cost", naive_cost)
        .withColumn("graduated_cost", cost)
        .withColumn("wrong_freezes_avoided", F.col("naive_wrong_freezes") - F.col("wrong_freezes"))
        .withColumn("cost_reduction", F.col("naive_cost") - F.col("graduated_cost"))
        .drop("_missed", "_naive_missed")
    )


def capacity_threshold(
    scores: DataFrame, keys: list[str], analysts: int = 20, minutes: float = 15, score: str = "score",
    label: str = "label",
) -> DataFrame:
    """Lowest percent threshold whose alerts fit one shift of the desk; null when none fits."""
    capacity = int(analysts * K.SHIFT_MINUTES / minutes)
    table = threshold_table(scores, K.PERCENT_GRID, keys, score, label)
    fits = F.when(F.col("alerts") <= capacity, F.struct("threshold", "alerts"))
    picked = table.groupBy(*keys).agg(F.min(fits).alias("p"))
    return picked.select(
        *keys,
        F.lit(capacity).alias("daily_capacity"),
        F.col("p.threshold").alias("threshold"),
        F.col("p.alerts").alias("alerts"),
        F.ceil(F.col("p.alerts") * float(minutes) / K.SHIFT_MINUTES).alias("analyst_days"),
    )


def queue_reduction(scores: DataFrame, keys: list[str], t_lo: float, score: str = "score") -> DataFrame:
    """How many accounts the lower threshold clears without a human."""
    counts = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_accounts"),
        F.count_if(F.col(score) <= t_lo).alias("auto_cleared"),
        F.count_if(F.col(score) > t_lo).alias("priority"),
    )
    return counts.withColumn("workload_cut", 1 - F.col("priority") / F.greatest(F.col("n_accounts"), F.lit(1)))
