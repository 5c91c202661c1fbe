"""Small helpers that several operators of this subpackage share."""

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringwatch.session import cut_lineage

SPACE = r"\x20\x09-\x0D"
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_missing(df: DataFrame, **types: str) -> DataFrame:
    """The frame with the named columns, null where it lacks them."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def two_hashes(*cols: Column) -> list[Column]:
    """Two 64-bit hashes that share no seed, so both together act as one of 128 bits."""
    return [F.xxhash64(F.lit(17), *cols), F.xxhash64(F.lit(23), *cols)]


def lower_ascii(col: Column) -> Column:
    """A-Z in lower case, everything else as it is.

    `lower` does the same where no other character has a lower case, and `translate`, which is
    right everywhere, costs a map look-up per character.
    """
    plain = (F.octet_length(col) == F.length(col)) | ~F.regexp_like(
        col, F.lit(r"[\x{C0}-\x{D6}\x{D8}-\x{DE}\x{100}-\x{10FFFF}]")
    )
    return F.when(plain, F.lower(col)).otherwise(F.translate(col, string.ascii_uppercase, string.ascii_lowercase))


def counted(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast only if it has been counted to be small.

    With more rows the join that follows is a shuffle join, which may split hot keys.
    """
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= max_rows else df


def replacing(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns that the operator is about to add under the same names."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with `rank` (from 0, nulls first) and `n`, the number of rows of the key.

    Ranges of keys and order are numbered inside themselves; only one count per key and range is
    added up across ranges, so a key that holds most rows is many ranges.
    """
    ranged = cut_lineage(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    whole = Window.partitionBy(*keys, F.lit(0))
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(
        ranged.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_r"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("n"))
    )
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return (
        ranged.withColumn("_in", F.row_number().over(inside) - 1)
        .join(offsets, same)
        .select(*rows.columns, (F.col("_in") + F.col("_before")).alias("rank"), "n")
    )
