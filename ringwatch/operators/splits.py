"""Folds, hold-outs, samples and bootstrap draws that any run repeats exactly."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwatch import constants as K
from ringwatch.functions.hashing import poisson_lists, poisson_mode, poisson_one, uniform
from ringwatch.operators.metrics import score_curve
from ringwatch.operators.running import exact_quantiles, row_numbers
from ringwatch.session import cut_lineage

#: replicates of the binned bootstrap that a batch draws together
DRAWN_AT_ONCE = 64


def stratified_folds(
    df: DataFrame, k: int, label: str, identity: list[str], seed: int | str = 42, name: str = "fold"
) -> DataFrame:
    """Deal the rows of each class to k folds in seeded random order, so class shares match."""
    return row_numbers(df, [label], identity, seed, "_rn").withColumn(name, F.pmod("_rn", F.lit(k)).cast("int")).drop(
        "_rn", "_rn_total"
    )


def repeated_folds(
    df: DataFrame, k: int, repeats: int, label: str, identity: list[str], seed: int | str = 42
) -> DataFrame:
    """One copy of the rows per repeat, each with its own folds."""
    copies = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    numbered = row_numbers(copies, ["repeat", label], ["repeat", *identity], seed, "_rn")
    return numbered.withColumn("fold", F.pmod("_rn", F.lit(k)).cast("int")).drop("_rn", "_rn_total")


def holdout_split(df: DataFrame, label: str, identity: list[str], seed: int | str = 42, k: int = 5) -> DataFrame:
    """Stratified hold-out of one in k rows, marked in `is_holdout`."""
    return stratified_folds(df, k, label, identity, seed).withColumn("is_holdout", F.col("fold") == 0).drop("fold")


def temporal_split(df: DataFrame, step: str, quantile: float = 0.7) -> DataFrame:
    """Rows up to the step quantile train, later rows test."""
    cut = exact_quantiles(df.select(F.col(step).cast("double").alias("_s")), "_s", {"cut": quantile})
    return df.withColumn("is_train", F.col(step) <= F.floor(cut.scalar()))


def split_at(df: DataFrame, step: str, last_train) -> DataFrame:
    return df.withColumn("is_train", F.col(step) <= last_train)


def sample_rows(df: DataFrame, cap: int, identity: list[str], seed: int | str = 42) -> DataFrame:
    """Exactly `cap` rows in seeded random order, or all when there are fewer."""
    return row_numbers(df, [], identity, seed, "_rn").where(F.col("_rn") < cap).drop("_rn", "_rn_total")


def class_examples(df: DataFrame, label: str, order: str, k: int = 5) -> DataFrame:
    """The first k rows of each class, positives first."""
    first = df.where(F.col(label) == 1).orderBy(order).limit(k)
    return first.unionByName(df.where(F.col(label) == 0).orderBy(order).limit(k))


def bootstrap_precision(
    scores: DataFrame, identity: list[str], replicates: int = K.BOOTSTRAP_REPLICATES, seed: int | str = 42,
    score: str = "score", label: str = "label",
) -> DataFrame:
    """Average precision of each bootstrap replicate, one Poisson(1) weight per row and replicate.

    The weight stands for how often a row is drawn. Replicates with fewer than two positives
    are left out. Rows times replicates are made, so this form is for evaluation sets; see
    `bootstrap_precision_binned` for large ones.
    """
    # spread the rows before each becomes one per replicate
    slots = scores.sparkSession.sparkContext.defaultParallelism
    wide = scores.select(*identity, score, label).repartition(slots, *identity)
    copies = wide.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    weight = poisson_one(seed, "replicate", *identity)
    drawn = copies.withColumn("_w", weight.cast("bigint"))
    hist = (
        drawn.groupBy("replicate", F.col(score).alias("score"))
        .agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col(label)).alias("pos"))
        .where("n > 0")
    )
    return _replicate_precision(hist)


def bootstrap_precision_binned(
    scores: DataFrame, replicates: int = K.BOOTSTRAP_REPLICATES, seed: int | str = 42, score: str = "score",
    label: str = "label", digits: int = 4,
) -> DataFrame:
    """The same draw on a histogram of the scores to `digits` places: n rows of a bin and label draw Poisson(n).

    The histogram has at most 10 ** digits + 1 bins for scores from 0 to 1, whatever the rows. It is
    one array, beside which each replicate draws all bins in its row and adds up its curve; nothing is
    shuffled but the histogram. The replicates of a batch draw together.
    """
    binned = F.bround(F.col(score) * 10**digits).cast("long")
    bins = scores.where(F.col(score).isNotNull()).groupBy(binned.alias("bin")).agg(
        F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")
    )
    bins = bins.withColumns({f"{which}_mode": poisson_mode(F.col(which)) for which in ("neg", "pos")})
    packed = bins.agg(F.sort_array(F.collect_list(F.struct("bin", "neg", "pos", "neg_mode", "pos_mode")), asc=False).alias("bins"))
    spark = scores.sparkSession
    slots = min(max(spark.sparkContext.defaultParallelism, math.ceil(replicates / DRAWN_AT_ONCE)), replicates)
    rows = spark.range(1, replicates + 1, 1, slots).select(F.col("id").cast("int").alias("replicate"), packed.scalar().alias("bins"))

    def drawn(which: str) -> Column:
        u = F.transform("bins", lambda b: uniform(seed, "replicate", b["bin"], F.lit(which)))
        return poisson_lists(u, F.col(f"bins.{which}"), F.col(f"bins.{which}_mode"))

    rows = rows.select("replicate", drawn("neg").alias("neg"), drawn("pos").alias("pos"))
    rows = rows.select("replicate", F.arrays_zip("neg", "pos").alias("bins"))
    rows = rows.withColumn("n_pos", F.aggregate("bins", F.lit(0).cast("long"), lambda s, b: s + b["pos"])).where("n_pos >= 2")
    start = F.struct(F.lit(0).cast("long").alias("alerts"), F.lit(0).cast("long").alias("tp"), F.lit(0.0).alias("ap"))

    def step(s: Column, b: Column) -> Column:
        alerts, tp = s["alerts"] + b["neg"] + b["pos"], s["tp"] + b["pos"]
        gain = F.when(b["pos"] > 0, b["pos"].cast("double") / F.col("n_pos") * (tp.cast("double") / alerts)).otherwise(F.lit(0.0))
        return F.struct(alerts.alias("alerts"), tp.alias("tp"), (s["ap"] + gain).alias("ap"))

    return rows.select("replicate", F.aggregate("bins", start, step, lambda s: s["ap"]).alias("average_precision"), "n_pos")


def _replicate_precision(hist: DataFrame) -> DataFrame:
    # rows times replicates already had to fit; one replicate is a small group
    curve = score_curve(hist, ["replicate"], small_groups=True)
    share = F.col("pos").cast("double") / F.col("n_pos") * F.col("tp") / F.col("alerts")
    return (
        curve.where("n_pos >= 2")
        .groupBy("replicate")
        .agg(F.sum(share).alias("average_precision"), F.max("n_pos").alias("n_pos"))
    )


def bootstrap_interval(replicated: DataFrame) -> DataFrame:
    """Mean and 95% percentile interval over the replicates, which are drawn once and written."""
    replicated = cut_lineage(replicated.select("average_precision"))
    ends = exact_quantiles(replicated, "average_precision", {"ci_lo": 0.025, "ci_hi": 0.975})
    middle = replicated.agg(F.avg("average_precision").alias("m"))
    return ends.withColumn("mean", middle.scalar())
