"""Leak audit: four signatures per feature from one shared histogram of values."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwatch import constants as K
from ringwatch.functions.hashing import uniform
from ringwatch.functions.labels import base_feature
from ringwatch.operators.longform import feature_histogram
from ringwatch.operators.running import prefix_sums, quantile_columns
from ringwatch.session import cut_lineage

DECILES = {f"_e{i}": i / 10 for i in range(11)}


def injected_label(
    df: DataFrame, label: str, identity: list[str], name: str, rate: float = K.INJECTED_FLIP_RATE,
    seed: int | str = 42,
) -> DataFrame:
    """Copy of the label with a share of values flipped: a leak the audit has to find."""
    flip = uniform(seed, *identity) < rate
    y = F.col(label).cast("double")
    return df.withColumn(name, F.when(flip, 1.0 - y).otherwise(y))


def filled(hist: DataFrame) -> DataFrame:
    return hist.where(F.col("value").isNotNull())


def feature_totals(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, positives and distinct values per feature, missing values left out."""
    return filled(hist).groupBy(*keys, "feature").agg(
        F.sum("n").alias("n_rows"), F.sum("pos").alias("n_pos"), F.count(F.lit(1)).alias("n_distinct")
    )


def eligible(totals: DataFrame, min_rows: int = K.AUDIT_MIN_ROWS) -> DataFrame:
    """Features with enough rows and both classes."""
    return totals.where((F.col("n_rows") >= min_rows) & (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n_rows")))


def _rate() -> Column:
    return F.sum("pos").cast("double") / F.sum("n")


def bucket_purity(hist: DataFrame, keys: list[str], min_rows: int = K.AUDIT_MIN_ROWS) -> DataFrame:
    """Highest positive rate over values rounded to three digits with enough rows."""
    buckets = filled(hist).groupBy(*keys, "feature", F.bround("value", 3).alias("bucket")).agg(
        F.sum("n").alias("rows"), _rate().alias("rate")
    )
    best = F.max(F.when(F.col("rows") >= min_rows, F.col("rate")))
    return buckets.groupBy(*keys, "feature").agg(best.alias("bucket_rate"))


def running_histogram(hist: DataFrame, keys: list[str]) -> DataFrame:
    return prefix_sums(filled(hist), [*keys, "feature"], "value", ["n", "pos"])


def _auc() -> Column:
    below = F.col("n_before") - F.col("pos_before")
    pairs = F.sum(F.col("pos").cast("double") * (below + (F.col("n") - F.col("pos")) / 2.0))
    all_pairs = F.max(F.col("pos_total").cast("double") * (F.col("n_total") - F.col("pos_total")))
    auc = F.try_divide(pairs, all_pairs)
    return F.greatest(auc, 1.0 - auc)


def univariate_auc(running: DataFrame, keys: list[str]) -> DataFrame:
    """ROC AUC of each feature alone, ties on mid-ranks, the better of both directions."""
    return running.groupBy(*keys, "feature").agg(_auc().alias("auc"))


def feature_summary(running: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, AUC and decile edges of each feature in one aggregate."""
    return running.groupBy(*keys, "feature").agg(
        F.sum("n").alias("n_rows"),
        F.sum("pos").alias("n_pos"),
        F.count(F.lit(1)).alias("n_distinct"),
        _auc().alias("auc"),
        *quantile_columns("value", "n", "n_before", "n_total", DECILES),
    )


def decile_purity(
    running: DataFrame, summary: DataFrame, keys: list[str], min_rows: int = K.AUDIT_MIN_ROWS, min_distinct: int = 10
) -> DataFrame:
    """Highest positive rate over decile ranges with enough rows; equal values share a range.

    Ranges are right-closed and the lowest value belongs to the first one. Equal edges leave
    no range between them, so counting the edges below a value names its range.
    """
    below = sum((F.when(F.col(e) < F.col("value"), 1).otherwise(0) for e in DECILES), F.lit(0))
    lowest = sum((F.when(F.col(e) == F.col("_e0"), 1).otherwise(0) for e in DECILES), F.lit(0))
    on = [*keys, "feature"]
    ranges = (
        running.select(*on, "value", "n", "pos")
        # one row per column of the audited table (and fold): bounded by the schema
        .join(F.broadcast(summary.select(*on, *DECILES)), on)
        .groupBy(*on, F.greatest(below, lowest).alias("range"))
        .agg(F.sum("n").alias("rows"), _rate().alias("rate"), F.count(F.lit(1)).alias("distinct"))
    )
    best = F.max(F.when(F.col("rows") >= min_rows, F.col("rate")))
    return ranges.groupBy(*on).agg(F.when(F.sum("distinct") >= min_distinct, best).alias("decile_rate"))


def signatures(hist: DataFrame, keys: list[str] | None = None, min_rows: int = K.AUDIT_MIN_ROWS) -> DataFrame:
    """Totals, bucket purity, decile purity and AUC beside each other, per feature.

    All four read the running histogram, which is written once to the shared folder: the wide
    table is scanned a single time.
    """
    keys = keys or []
    on = [*keys, "feature"]
    running = cut_lineage(running_histogram(hist, keys))
    summary = feature_summary(running, keys)
    return (
        summary.drop(*DECILES)
        .join(bucket_purity(running, keys, min_rows), on)
        .join(decile_purity(running, summary, keys, min_rows), on)
        .withColumns(
            {
                "bucket_rate": F.coalesce("bucket_rate", F.lit(0.0)),
                "decile_rate": F.coalesce("decile_rate", F.lit(0.0)),
            }
        )
    )


def with_severity(signed: DataFrame, base_rate: float | Column, hinted: list[str] | None = None) -> DataFrame:
    """Severity ladder, lift against the base rate and the hint mark."""
    hinted = hinted or []
    rates = dict(K.AUDIT_RATES)
    worst = F.greatest("bucket_rate", "decile_rate")
    covered_auc = F.when(F.col("n_pos") >= K.AUDIT_MIN_POSITIVES, F.col("auc")).otherwise(0.0)
    severity = (
        F.when((worst >= rates["CRITICAL"]) | (covered_auc >= K.AUDIT_AUC_CRITICAL), "CRITICAL")
        .when((worst >= rates["HIGH"]) | (covered_auc >= K.AUDIT_AUC_HIGH), "HIGH")
        .when(worst >= rates["MEDIUM"], "MEDIUM")
        .when((worst >= rates["WATCH"]) | (F.col("auc") >= K.AUDIT_AUC_HIGH), "WATCH")
    )
    listed = base_feature(F.col("feature")).isin(hinted) if hinted else F.lit(False)
    return signed.withColumns(
        {"severity": severity, "lift": worst / base_rate, "hinted": listed}
    )


def integrity_audit(
    df: DataFrame, features: list[str], label: str, hinted: list[str] | None = None
) -> DataFrame:
    """Severity-ranked findings of a labelled table; features without a finding are left out."""
    hist = feature_histogram(df, features, label)
    base = df.agg(F.avg(F.col(label).cast("double")).alias("b"))
    found = with_severity(eligible(signatures(hist)), base.scalar(), hinted).where("severity is not null")
    return found.select(
        "feature",
        "severity",
        F.col("n_pos").alias("positives_covered"),
        F.bround("auc", 3).alias("univariate_auc"),
        F.bround("bucket_rate", 3).alias("best_bucket_rate"),
        F.bround("decile_rate", 3).alias("best_decile_rate"),
        F.bround("lift", 1).alias("lift_vs_base"),
        "hinted",
    )


def ranked(findings: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(s) for s, _ in K.AUDIT_RATES]), F.col("severity"))
    return findings.orderBy(order, F.desc("best_bucket_rate"), F.desc("univariate_auc"), "feature")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if(F.col("severity").isin("CRITICAL", "HIGH") & ~F.col("hinted")).alias("n_to_block"),
    )


def block_list(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity").isin("CRITICAL", "HIGH") & ~F.col("hinted")).select("feature")


def range_only_leaks(findings: DataFrame, rate: float = K.LEAK_RATE) -> DataFrame:
    """Features whose ranges leak while no single value does."""
    return findings.where(
        (F.col("best_decile_rate") >= rate) & (F.col("best_bucket_rate") < rate) & ~F.col("hinted")
    )


def purity(hist: DataFrame, keys: list[str] | None = None, min_rows: int = K.AUDIT_MIN_ROWS) -> DataFrame:
    """Worst of bucket and decile purity per feature, the measure of the leak detector."""
    signed = signatures(hist, keys, min_rows)
    return signed.select(*(keys or []), "feature", F.greatest("bucket_rate", "decile_rate").alias("worst_rate"))


def leaking_features(
    hist: DataFrame, rate: float = K.LEAK_RATE, min_rows: int = K.AUDIT_MIN_ROWS, hinted: list[str] | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Features too pure to be behaviour; hinted ones are never listed."""
    found = purity(hist, keys, min_rows).where(F.col("worst_rate") >= rate)
    return found.where(~base_feature(F.col("feature")).isin(hinted)) if hinted else found


def leak_sweep(
    hist: DataFrame, rates: list[float] | None = None, hinted: list[str] | None = None
) -> DataFrame:
    """How many features each detection rate removes and keeps, from one pass."""
    rates = rates or K.LEAK_SWEEP
    worst = purity(hist)
    exempt = base_feature(F.col("feature")).isin(hinted) if hinted else F.lit(False)
    hit = (F.col("leak_rate") <= 1) & (F.col("worst_rate") >= F.col("leak_rate")) & ~exempt
    return (
        worst.select("*", F.explode(F.array(*[F.lit(r) for r in rates])).alias("leak_rate"))
        .groupBy("leak_rate")
        .agg(F.count_if(hit).alias("n_leaks"), F.count_if(~F.coalesce(hit, F.lit(False))).alias("n_kept"))
    )


def training_histograms(hist: DataFrame, fold: str = "fold", k: int = 5) -> DataFrame:
    """Histogram of each training set (all rows but one fold) from the per-fold histogram."""
    per_value = hist.groupBy("feature", "value").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(fold), F.struct("n", "pos")))).alias("m"),
        F.sum("n").alias("n_all"),
        F.sum("pos").alias("pos_all"),
    )
    held = F.col("m")[F.col(fold)]
    return (
        per_value.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(fold))
        .select(
            fold, "feature", "value",
            (F.col("n_all") - F.coalesce(held["n"], F.lit(0))).alias("n"),
            (F.col("pos_all") - F.coalesce(held["pos"], F.lit(0))).alias("pos"),
        )
        .where("n > 0")
    )


def infold_leaks(
    df: DataFrame, features: list[str], label: str, k: int, fold: str = "fold", rate: float = K.LEAK_RATE,
    hinted: list[str] | None = None,
) -> DataFrame:
    """Leaking features per training fold; `df` carries the fold of each row."""
    hist = training_histograms(feature_histogram(df, features, label, [fold]), fold, k)
    return leaking_features(hist, rate, hinted=hinted, keys=[fold])


def audit_lines(findings: DataFrame) -> DataFrame:
    """Findings as markdown table rows."""
    line = F.format_string(
        "| %s | %s | %.3f | %.0f%% | %.1f× | %s |",
        "feature", "severity", "univariate_auc", F.col("best_bucket_rate") * 100, "lift_vs_base",
        F.when(F.col("hinted"), "yes").otherwise("no"),
    )
    return ranked(findings).select(line.alias("line"))
