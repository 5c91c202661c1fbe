"""Clean a wide account snapshot: profile, drop, encode, flag, report, re-apply."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringwatch import constants as K
from ringwatch.functions.numbers import safe_ratio, try_number
from ringwatch.operators.longform import feature_histogram, to_long, to_long_text
from ringwatch.operators.running import prefix_sums, quantile_columns, text_row_numbers

VECTOR_CHUNK = 250


def text_columns(df: DataFrame, features: list[str]) -> list[str]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in features if isinstance(kinds[c], (T.StringType, T.CharType, T.VarcharType))]


def drop_blocked(df: DataFrame, blocked: list[str] | None = None) -> DataFrame:
    return df.drop(*(K.SNAPSHOT_BLOCKED if blocked is None else blocked))


def drop_block_range(df: DataFrame, first: int = K.SNAPSHOT_TAIL[0], last: int = K.SNAPSHOT_TAIL[1]) -> DataFrame:
    """Drop columns F<first>..F<last> with all their derived columns."""

    def inside(name: str) -> bool:
        m = re.fullmatch(r"F(\d+)", name.split("__")[0])
        return bool(m) and first <= int(m.group(1)) <= last

    return df.drop(*[c for c in df.columns if inside(c)])


def profile(hist: DataFrame) -> DataFrame:
    """Per feature: rows, filled rows, missing share, distinct values, constant or not."""
    empty = F.col("value").isNull()
    return (
        hist.groupBy("feature")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum(F.when(empty, 0).otherwise(F.col("n"))).alias("n_filled"),
            F.count("value").alias("n_distinct"),
        )
        .withColumn("na_fraction", 1.0 - F.col("n_filled") / F.col("n_rows"))
        .withColumn("near_empty", F.col("na_fraction") > K.MISSING_DROP_MIN)
        .withColumn("hyper_sparse", F.col("n_filled") < K.MIN_FILLED)
        .withColumn("constant", F.col("n_distinct") <= 1)
        .withColumn("wants_flag", F.col("na_fraction") > K.MISSING_FLAG_MIN)
    )


def text_histogram(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, n, pos) of text columns."""
    return to_long_text(df, features, []).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("pos")
    )


def snapshot_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """Profile of numeric and text columns together."""
    text = text_columns(df, features)
    numeric = [c for c in features if c not in text]
    parts = []
    if numeric:
        parts.append(profile(feature_histogram(df, numeric)))
    if text:
        parts.append(profile(text_histogram(df, text)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def kept_features(profiled: DataFrame) -> DataFrame:
    return profiled.where(~F.col("near_empty") & ~F.col("hyper_sparse") & ~F.col("constant"))


def continuous_features(profiled: DataFrame, categorical: list[str] | None = None) -> DataFrame:
    """Columns that are neither flags nor codes and have more than twenty values."""
    out = profiled.where(
        (F.col("n_distinct") > K.CONTINUOUS_MIN_DISTINCT) & ~F.col("feature").endswith(K.FLAG_SUFFIX)
    )
    return out.where(~F.col("feature").isin(categorical)) if categorical else out


def missing_patterns(df: DataFrame, features: list[str], identity: str) -> DataFrame:
    """Fingerprint of the rows each feature misses: their number and two combined hashes."""
    gaps = to_long(df, [c for c in features], [identity]).where("value is null")
    return gaps.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_missing"),
        F.bit_xor(F.xxhash64(identity)).alias("print_a"),
        F.bit_xor(F.xxhash64(F.lit("b"), identity)).alias("print_b"),
    )


def distinct_flags(
    df: DataFrame, features: list[str], identity: str, min_missing: float = K.MISSING_FLAG_MIN
) -> DataFrame:
    """Of the features that miss the same rows, the first in column order keeps its flag."""
    order = F.array_position(F.array(*[F.lit(c) for c in features]), F.col("feature"))
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    return (
        missing_patterns(df, features, identity)
        .where(F.col("n_missing") > total * min_missing)
        .groupBy("n_missing", "print_a", "print_b")
        .agg(F.min_by("feature", order).alias("feature"), F.count(F.lit(1)).alias("n_sharing"))
        .select("feature", "n_missing", "n_sharing")
    )


def missing_flags(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f"{c}{K.FLAG_SUFFIX}": F.col(f"`{c}`").isNull().cast("tinyint") for c in features})


def category_codes(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, category, code): categories of each text column numbered in text order."""
    seen = to_long_text(df, features, []).where("value is not null").distinct()
    numbered = text_row_numbers(seen, ["feature"], "value", "code")
    return numbered.select("feature", F.col("value").alias("category"), "code")


def encode(df: DataFrame, codes: DataFrame, features: list[str]) -> DataFrame:
    """Replace text by its code; categories without a code become null.

    The code table is as large as its dictionaries, so the join strategy is left to Spark's
    own size check.
    """
    out = df
    for i, c in enumerate(features):
        side = codes.where(F.col("feature") == c).select(
            F.col("category").alias(f"_cat{i}"), F.col("code").cast("double").alias(f"_code{i}")
        )
        out = out.join(side, F.col(f"`{c}`").cast("string") == F.col(f"_cat{i}"), "left").drop(f"_cat{i}")
    renamed = {c: F.col(f"_code{i}") for i, c in enumerate(features)}
    return out.withColumns(renamed).drop(*[f"_code{i}" for i in range(len(features))])


def as_numbers(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({c: try_number(f"`{c}`") for c in features})


def duplicate_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: how many rows repeat an earlier one on all features."""
    distinct = df.groupBy(*features).agg(F.count(F.lit(1)).alias("n"))
    return distinct.agg(
        F.sum("n").alias("n_rows"), (F.sum("n") - F.count(F.lit(1))).alias("duplicate_rows")
    )


def row_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """Per row: missing cells, zero cells and the filled share."""
    missing, zero = [], []
    for i in range(0, len(features), VECTOR_CHUNK):
        cells = F.array(*[try_number(f"`{c}`") for c in features[i : i + VECTOR_CHUNK]])
        missing.append(F.aggregate(cells, F.lit(0), lambda a, x: a + F.when(x.isNull(), 1).otherwise(0)))
        zero.append(F.aggregate(cells, F.lit(0), lambda a, x: a + F.when(x == 0, 1).otherwise(0)))
    n_missing, n_zero = sum(missing[1:], missing[0]), sum(zero[1:], zero[0])
    return df.withColumn("n_missing", n_missing).withColumn("n_zero", n_zero).withColumn(
        "completeness", 1.0 - F.col("n_missing") / F.lit(float(max(len(features), 1)))
    )


def add_ratios(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    present = set(df.columns)
    return df.withColumns({f"eng_{a}_over_{b}": safe_ratio(a, b) for a, b in pairs if {a, b} <= present})


def hygiene_report(
    df: DataFrame, features: list[str], label: str, leaking: DataFrame, flags: DataFrame,
    blocked: list[str] | None = None, hinted: list[str] | None = None,
) -> DataFrame:
    """One row on what cleaning drops, flags and keeps."""
    blocked = K.SNAPSHOT_BLOCKED if blocked is None else blocked
    hinted = K.SNAPSHOT_HINTED if hinted is None else hinted
    present = [c for c in features if c not in blocked]
    profiled = snapshot_profile(df, present)
    dropped = profiled.agg(
        F.count_if("near_empty").alias("dropped_near_empty"),
        F.count_if("hyper_sparse").alias("dropped_hyper_sparse"),
        F.count_if(F.col("constant") & ~F.col("near_empty") & ~F.col("hyper_sparse")).alias("dropped_constant"),
        F.count_if(
            F.col("wants_flag") & ~F.col("near_empty") & ~F.col("hyper_sparse") & ~F.col("constant")
        ).alias("n_missing_flags_raw"),
    )
    rows = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col(label).cast("bigint")).alias("n_positives"),
        F.avg(F.col(label).cast("double")).alias("prevalence"),
    )
    lists = {
        "dropped_leakage": [c for c in blocked if c in features],
        "hint_features_present": [c for c in hinted if c in features],
        "categorical_cols": text_columns(df, present),
    }
    return (
        rows.withColumns({c: dropped.select(c).scalar() for c in dropped.columns})
        .withColumn("n_missing_flags", flags.agg(F.count(F.lit(1)).alias("c")).scalar())
        .withColumn("n_bucket_leaks", leaking.agg(F.count(F.lit(1)).alias("c")).scalar())
        .withColumn("n_features_raw", F.lit(len(features)))
        .withColumns({k: F.lit(", ".join(v)) for k, v in lists.items()})
    )


def target_free_prep(
    df: DataFrame, target: str, drop_cols: list[str] | None = None
) -> tuple[DataFrame, list[str], DataFrame]:
    """Drop constants, encode text, cast to numbers. Returns rows, features and the code table.

    The constant columns are found by one small aggregate read at plan time: the names of
    columns, not rows, reach the driver.
    """
    rows = df.drop(*[c for c in (drop_cols or []) if c in df.columns])
    features = [c for c in rows.columns if c != target]
    constant = {r["feature"] for r in snapshot_profile(rows, features).where("constant").select("feature").collect()}
    features = [c for c in features if c not in constant]
    text = text_columns(rows, features)
    codes = category_codes(rows, text) if text else None
    rows = rows.select(*features, F.col(target).cast("int").alias(target))
    if text:
        rows = encode(rows, codes, text)
    return as_numbers(rows, features), features, codes


def transform_new(
    df: DataFrame, columns: list[str], codes: DataFrame | None, text: list[str], keep: list[str] | None = None
) -> DataFrame:
    """Bring raw rows into the model's columns, by the saved column list and code table.

    A flag whose base column is absent reads as missing (1.0); an absent plain column is null.
    """
    has = set(df.columns)
    raw_gaps = {
        c: F.col(f"`{c[: -len(K.FLAG_SUFFIX)]}`").isNull().cast("double")
        for c in columns
        if c.endswith(K.FLAG_SUFFIX) and c[: -len(K.FLAG_SUFFIX)] in has
    }
    rows = df.withColumns({f"_raw{i}": e for i, e in enumerate(raw_gaps.values())}) if raw_gaps else df
    slot = {c: f"_raw{i}" for i, c in enumerate(raw_gaps)}
    present = [c for c in text if c in has]
    if present:
        rows = encode(rows, codes, present)

    def model_column(c: str) -> Column:
        if c.endswith(K.FLAG_SUFFIX):
            return F.col(slot[c]) if c in slot else F.lit(1.0)
        return try_number(f"`{c}`") if c in has else F.lit(None).cast("double")

    return rows.select(*(keep or []), *[model_column(c).alias(c) for c in columns])


def prepare_frame(
    df: DataFrame, columns: list[str], codes: DataFrame | None, text: list[str], keep: list[str] | None = None
) -> DataFrame:
    """Accept raw or cleaned rows: cleaned ones carry missing flags and only need aligning."""
    if any(c.endswith(K.FLAG_SUFFIX) for c in df.columns):
        has = set(df.columns)
        aligned = [(F.col(f"`{c}`") if c in has else F.lit(None)).cast("double").alias(c) for c in columns]
        return df.select(*(keep or []), *aligned)
    return transform_new(df, columns, codes, text, keep)


def check_matrix(
    df: DataFrame, label: str, blocked: list[str], hinted: list[str], rows: int | None = None,
    positives: int | None = None,
) -> DataFrame:
    """Raise when blocked columns are present, hinted ones absent or counts differ."""
    leaked = [c for c in blocked if c in df.columns]
    absent = [c for c in hinted if c not in df.columns]
    if leaked or absent:
        raise ValueError(f"matrix breaks its contract: blocked {leaked}, absent {absent}")
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("p")).first()
    if (rows is not None and counts["n"] != rows) or (positives is not None and counts["p"] != positives):
        raise ValueError(f"matrix has {counts['n']} rows and {counts['p']} positives")
    return df


def class_stats(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Per feature: median, 5th and 95th percentile, class means, standard deviation."""
    hist = feature_histogram(df, features, label).where("value is not null")
    running = prefix_sums(hist, ["feature"], "value", ["n"])
    neg = F.col("n") - F.col("pos")
    v = F.col("value")
    total = F.sum(F.col("n") * v)
    n = F.sum("n")
    # deviations are taken from the mean in a second step: a sum of squares would lose digits
    quantiles = {"median": 0.5, "q05": 0.05, "q95": 0.95}
    stats = running.groupBy("feature").agg(
        *quantile_columns("value", "n", "n_before", "n_total", quantiles),
        F.try_divide(F.sum(neg * v), F.sum(neg)).alias("mean_legit"),
        F.try_divide(F.sum(F.col("pos") * v), F.sum("pos")).alias("mean_mule"),
        F.try_divide(total, n).alias("mean"),
        n.alias("n_filled"),
    )
    spread = (
        # one row per column: bounded by the schema
        hist.join(F.broadcast(stats.select("feature", "mean")), "feature")
        .groupBy("feature")
        .agg(
            F.sqrt(
                F.try_divide(F.sum(F.col("n") * (v - F.col("mean")) * (v - F.col("mean"))), F.sum("n") - 1)
            ).alias("std")
        )
    )
    return stats.join(spread, "feature").withColumn("std", F.when(F.col("std") != 0, F.col("std")))


def profile_gap(
    df: DataFrame, features: list[str], probability: str, label: str, threshold: float
) -> DataFrame:
    """Feature means of missed positives, caught positives and negatives, widest gap first."""
    caught = F.col(probability) >= threshold
    y = F.col(label)
    long = to_long(df.withColumns({"_missed": (y == 1) & ~caught, "_caught": (y == 1) & caught, "_legit": y == 0}),
                   features, ["_missed", "_caught", "_legit"])
    return (
        long.groupBy("feature")
        .agg(
            F.avg(F.when(F.col("_missed"), F.col("value"))).alias("missed_mean"),
            F.avg(F.when(F.col("_caught"), F.col("value"))).alias("caught_mean"),
            F.avg(F.when(F.col("_legit"), F.col("value"))).alias("legit_mean"),
        )
        .withColumn("gap", F.abs(F.col("missed_mean") - F.col("caught_mean")))
    )


def percentile_note(value: Column) -> Column:
    """Where a value stands in the population; reads the columns of `class_stats`."""
    place = (
        F.when(value <= F.col("q05"), "in the bottom 5% of accounts")
        .when(value >= F.col("q95"), "in the top 5% of accounts")
        .when(value > F.col("median"), "above the median")
        .when(F.col("median").isNotNull(), "below the median")
    )
    nearer = F.when(
        F.abs(value - F.col("mean_mule")) < F.abs(value - F.col("mean_legit")), "mule"
    ).when(F.col("mean_mule").isNotNull() & F.col("mean_legit").isNotNull(), "legitimate")
    profile_text = F.concat(F.lit("closer to the typical "), nearer, F.lit(" profile"))
    note = F.concat_ws("; ", place, profile_text)
    return F.when(F.col("feature").endswith(K.FLAG_SUFFIX) | value.isNull(), "").otherwise(note)
