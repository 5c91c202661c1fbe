"""Join per-key facts to rows when a few keys may hold most of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwatch.session import cut_lineage

HOT_SHARE = 1000
HOT_MIN_ROWS = 1_000_000
SALTS = 64
BROADCAST_MAX_ROWS = 100_000


def join_counted(rows: DataFrame, small: DataFrame, on: list[str], max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Inner join to a table that should be small (a row per run, feature or bin).

    The table is written and counted first. Counted few rows are broadcast, so the large side
    is not shuffled by a key with few values; more rows take a shuffle join.
    """
    small = cut_lineage(small)
    return rows.join(F.broadcast(small) if small.count() <= max_rows else small, on)


def attach(
    rows: DataFrame,
    facts: DataFrame,
    key: str,
    weight: str,
    spread: list[str],
    how: str = "left",
    hot_min_rows: int = HOT_MIN_ROWS,
    salts: int = SALTS,
    broadcast_max_rows: int = BROADCAST_MAX_ROWS,
) -> DataFrame:
    """Join `facts` (one row per key, few narrow columns) to `rows`, whatever the key skew.

    One small aggregate over the facts picks the way. Counted few facts are broadcast and the
    rows are not shuffled at all. Without a hot key this is a plain shuffle join. Otherwise hot
    keys are spread over salts: `weight` is the number of rows each key has in `rows`, a key is
    hot at a thousandth of all rows, so there are at most a thousand hot keys and their list is
    safe to broadcast. Rows of a hot key are spread by the hash of the `spread` columns; the
    facts of the few hot keys are copied once per salt. No row is dropped.

    The facts are read more than once: give a table or a checkpointed frame.
    """
    seen = facts.agg(
        F.sum(weight).alias("total"), F.max(weight).alias("largest"), F.count(F.lit(1)).alias("n")
    ).first()
    if seen["n"] <= broadcast_max_rows:
        return rows.join(F.broadcast(facts.drop(weight)), key, how)
    limit = max((seen["total"] or 0) / HOT_SHARE, hot_min_rows)
    if (seen["largest"] or 0) < limit:
        return rows.join(facts.drop(weight), key, how)
    marked = facts.withColumn("_hot", F.col(weight) >= limit)
    hot = F.broadcast(marked.where("_hot").select(key, F.lit(True).alias("_is_hot")))
    salted = rows.join(hot, key, "left").withColumn(
        "_salt",
        F.when(F.col("_is_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0),
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = marked.withColumn("_salt", F.explode(copies)).drop("_hot", weight)
    return salted.join(copied, [key, "_salt"], how).drop("_salt", "_is_hot")
