"""The feed rules on event time. Each function takes a stream or a batch of the same shape.

An event is scored on what is known at its event time: rules on one row as they are, the
amount cut from a saved value, counts per account from closed windows, chains from an
interval join. No rule looks at later events.
"""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch import constants as K
from ringwatch.functions.policy import containment
from ringwatch.operators.fusion import fuse_alerts
from ringwatch.operators.rules import HIGH_VALUE_RULE, ROW_RULES, apply_rules, high_value_cut
from ringwatch.sources.roles import transactions


def save_high_value(feed: DataFrame, path: str) -> None:
    """Append the amount cut of a feed to the saved cuts, with the time it was made."""
    cut = high_value_cut(transactions(feed))
    cut.select("high_value", F.current_timestamp().alias("made")).write.mode("append").parquet(path)


def saved_high_value(spark: SparkSession, path: str) -> DataFrame:
    """One row: the newest of the saved cuts, as the folder holds them now."""
    return spark.read.parquet(path).agg(F.max_by("high_value", "made").alias("high_value"))


def score_events(events: DataFrame, high_value: float | DataFrame | None = None) -> DataFrame:
    """Row rules, the saved amount cut when given, and the containment step.

    A cut given as a table of one row is joined to every event. In a stream a join keeps the files it
    was planned with; to score each batch by the newest cut, call this per batch with the table read
    anew (`runner.drain_batches`).
    """
    feed = transactions(events)
    rules = ROW_RULES
    if isinstance(high_value, DataFrame):
        one = high_value.select(F.lit(1).alias("_one"), F.col("high_value").alias("_high_value"))
        feed = feed.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one", "left").drop("_one")
    elif high_value is not None:
        feed = feed.withColumn("_high_value", F.lit(float(high_value)))
    if high_value is not None:
        rules = (HIGH_VALUE_RULE, *ROW_RULES)
    scored = apply_rules(feed, rules)
    return scored.withColumn("action", containment(F.col("suspicion_score"))).drop("_high_value")


def account_windows(
    events: DataFrame, size: str = "1 day", slide: str | None = None, late_by: str = "1 hour"
) -> DataFrame:
    """Transactions and rails per account and window.

    Counted per rail first: the state of a busy account is one row per rail and window.
    """
    feed = transactions(events).withWatermark("ts", late_by)
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    by_rail = feed.where("origin is not null").groupBy(span.alias("w"), "origin", "channel").agg(
        F.count("amount").alias("n")
    )
    per = by_rail.groupBy("w", "origin").agg(F.sum("n").alias("txns"), F.count("channel").alias("rails"))
    return per.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        F.col("origin").alias("account"),
        "txns",
        "rails",
        (F.col("txns") >= K.VELOCITY_MIN).alias("high_velocity"),
        (F.col("rails") >= K.RAILS_MIN).alias("cross_rail"),
    )


def transfer_chains(
    events: DataFrame, within: str = "6 hours", late_by: str = "1 hour", key: str = "event_id"
) -> DataFrame:
    """Transfers into an account followed by a cash-out from it within the time bound.

    Both sides are keyed by account and stretch of time, as long as the bound; a cash-out looks in
    its own stretch and the one before. So a key holds one stretch of a busy account and not its
    whole open history, and only pairs of neighbouring stretches are compared.
    """
    feed = transactions(events).withWatermark("ts", late_by)
    kind = F.upper("txn_type")
    width = F.expr(f"unix_micros(TIMESTAMP_SECONDS(0) + INTERVAL {within})")
    stretch = F.floor(F.unix_micros("ts") / width)
    into = feed.where((kind == "TRANSFER") & F.col("dest").isNotNull()).select(
        F.col("dest").alias("account"), stretch.alias("stretch"), F.col("ts").alias("in_ts"), F.col(key).alias("in_id")
    )
    out = feed.where((kind == "CASH_OUT") & F.col("origin").isNotNull()).select(
        F.col("origin").alias("out_account"), F.explode(F.array(stretch, stretch - 1)).alias("out_stretch"), F.col("ts").alias("out_ts"), F.col(key).alias("out_id")
    )
    same = (F.col("account") == F.col("out_account")) & (F.col("stretch") == F.col("out_stretch"))
    bound = F.expr(f"out_ts >= in_ts AND out_ts <= in_ts + INTERVAL {within}")
    return into.join(out, same & bound).drop("out_account", "stretch", "out_stretch")


def fuse_ticket_stream(tickets: DataFrame, risk: DataFrame) -> DataFrame:
    """Tickets as they arrive beside a risk snapshot."""
    return fuse_alerts(tickets, risk, streaming=True)


def without_repeats(events: DataFrame, key: str, late_by: str = "1 hour") -> DataFrame:
    """Drop repeated deliveries of an event while its watermark is open."""
    return events.withWatermark("ts", late_by).dropDuplicatesWithinWatermark([key])


def split_late(batch: DataFrame, newest: datetime | None, late_by: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """The rows of a batch that are in time, and those that lie behind the newest event of earlier batches
    by more than the allowed delay. Rows without event time are late."""
    if newest is None:
        late = F.col("ts").isNull()
    else:
        late = F.coalesce(F.col("ts") < F.lit(newest) - F.expr(f"INTERVAL {late_by}"), F.lit(True))
    return batch.where(~late), batch.where(late)
