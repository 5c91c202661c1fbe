"""Wide table to feature histograms: one pass and one shuffle for thousands of columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwatch.functions.numbers import try_number

CHUNK = 500


def _chunks(features: list[str], size: int) -> list[list[str]]:
    return [features[i : i + size] for i in range(0, len(features), size)]


def _named(names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_pos") + 1)


def feature_histogram(
    df: DataFrame, features: list[str], label: str | None = None, keys: list[str] | None = None, chunk: int = CHUNK
) -> DataFrame:
    """(keys, feature, value, n, pos): how many rows and positives share each value.

    Missing values stay as value null, so the same pass counts them. Each chunk of columns is
    exploded by position and counted before names are put back, so the shuffle carries a
    small number instead of a name per cell.
    """
    keys = keys or []
    if not features:
        return df.select(
            *keys, F.lit("").alias("feature"), F.lit(None).cast("double").alias("value"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("pos")
        ).limit(0)
    positive = F.col(label).cast("bigint") if label else F.lit(0).cast("bigint")
    parts = []
    for names in _chunks(features, chunk):
        cells = df.select(
            *keys, positive.alias("_y"), F.posexplode(F.array(*[try_number(f"`{c}`") for c in names])).alias("_pos", "value")
        )
        counted = cells.groupBy(*keys, "_pos", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"))
        parts.append(counted.select(*keys, _named(names).alias("feature"), "value", "n", "pos"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def to_long(df: DataFrame, features: list[str], keep: list[str], chunk: int = CHUNK) -> DataFrame:
    """(keep, feature, value) with one row per cell, missing cells included."""
    if not features:
        return df.select(*keep, F.lit("").alias("feature"), F.lit(None).cast("double").alias("value")).limit(0)
    parts = [
        df.select(*keep, F.posexplode(F.array(*[try_number(f"`{c}`") for c in names])).alias("_pos", "value")).select(
            *keep, _named(names).alias("feature"), "value"
        )
        for names in _chunks(features, chunk)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def to_long_text(df: DataFrame, features: list[str], keep: list[str], chunk: int = CHUNK) -> DataFrame:
    """Like `to_long` for text columns."""
    if not features:
        return df.select(*keep, F.lit("").alias("feature"), F.lit(None).cast("string").alias("value")).limit(0)
    parts = [
        df.select(*keep, F.posexplode(F.array(*[F.col(f"`{c}`").cast("string") for c in names])).alias("_pos", "value"))
        .select(*keep, _named(names).alias("feature"), "value")
        for names in _chunks(features, chunk)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
