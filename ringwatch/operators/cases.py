"""Analyst case log: latest state, real changes, summaries, ring containment, escalation."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringwatch import constants as K
from ringwatch.functions.numbers import value_bin


def log_order(log: DataFrame) -> Column:
    """What orders the rows of a log: seq, and in a stored log the writer and its row."""
    return F.struct("seq", *[c for c in ("session", "row") if c in log.columns])


def latest_actions(log: DataFrame) -> DataFrame:
    """(account, action): the last explicit action of each account."""
    explicit = log.where(F.col("action").isin(K.EXPLICIT_ACTIONS))
    return explicit.groupBy("account").agg(F.max_by("action", log_order(log)).alias("action"), F.max("seq").alias("seq"))


def state_changes(log: DataFrame) -> DataFrame:
    """Rows whose status or owner differs from the account's last logged pair.

    A row that is still new and has no owner is never logged and leaves the last pair as it is.
    A busy account is cut into stretches of `seq`: rows look back inside their stretch, and the
    first row of a stretch takes the last pair of the stretch before it.
    """
    pair = F.struct("status", "owner")
    real = log.where((F.col("status") != "NEW") | (F.coalesce("owner", F.lit("")) != "")).withColumn(
        "_bin", value_bin(F.col("seq"))
    )
    last = real.groupBy("account", "_bin").agg(F.max_by(pair, log_order(log)).alias("_last"))
    carried = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy("account").orderBy("_bin"))).drop("_last")
    inside = F.lag(pair).over(Window.partitionBy("account", "_bin").orderBy(log_order(log)))
    seen = real.withColumn("_inside", inside).join(carried, ["account", "_bin"])
    before = F.coalesce("_inside", "_carry")
    return seen.where(before.isNull() | ~pair.eqNullSafe(before)).select(*log.columns)


def change_text(status: Column, owner: Column) -> Column:
    named = F.concat(status, F.lit(" · owner "), owner)
    return F.when(F.coalesce(owner, F.lit("")) != "", named).otherwise(status)


def log_summary(log: DataFrame) -> DataFrame:
    """One row: reviews, distinct accounts, alerts raised, known positives among them."""
    alert = F.col("decision") == "ALERT"
    return log.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_distinct("account").alias("distinct_accounts"),
        F.count_if(alert).alias("alerts_raised"),
        F.count_if(alert & (F.col("ground_truth") == "MULE")).alias("mules_caught"),
    )


def action_counts(log: DataFrame) -> DataFrame:
    return latest_actions(log).groupBy("action").agg(F.count(F.lit(1)).alias("n_accounts"))


def latest_status(log: DataFrame) -> DataFrame:
    return log.groupBy("account").agg(
        F.max_by("status", log_order(log)).alias("status"), F.max_by("owner", log_order(log)).alias("owner")
    )


def status_counts(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """One row over the open alerts: counts per status, handled and assigned ones."""
    state = alerts.select("account").join(latest_status(log), "account", "left")
    status = F.coalesce("status", F.lit("NEW"))
    return state.agg(
        F.count(F.lit(1)).alias("open_alerts"),
        *[F.count_if(status == s).alias(s.lower()) for s in K.CASE_STATUSES],
        F.count_if(status != "NEW").alias("handled"),
        F.count_if(F.coalesce("owner", F.lit("")) != "").alias("assigned"),
    )


def ring_containment(members: DataFrame, log: DataFrame, loss: int = K.MULE_LOSS) -> DataFrame:
    """Per ring: members reviewed and escalated, its state, and the exposure addressed."""
    reviewed = log.select(F.col("account").alias("id"), F.lit(1).alias("_r")).distinct()
    escalated = latest_actions(log).where("action = 'ESCALATED'").select(F.col("account").alias("id"), F.lit(1).alias("_e"))
    per_ring = (
        members.join(reviewed, "id", "left")
        .join(escalated, "id", "left")
        .groupBy("ring_id")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.count("_r").alias("reviewed"),
            F.count("_e").alias("escalated"),
        )
    )
    state = (
        F.when(F.col("escalated") == F.col("size"), "Contained")
        .when(F.col("reviewed") > 0, "In progress")
        .otherwise("Open")
    )
    return per_ring.select(
        "*",
        state.alias("state"),
        (F.col("size") * loss).alias("exposure"),
        (F.col("size") * loss * (F.col("escalated") / F.col("size"))).alias("exposure_addressed"),
    )


def escalation_rows(members: DataFrame, log: DataFrame, ring_id: int) -> DataFrame:
    """New log rows for the members of a ring that are not escalated yet; they can be appended as they are."""
    done = latest_actions(log).where("action = 'ESCALATED'").select(F.col("account").alias("id"))
    return (
        members.where(F.col("ring_id") == ring_id)
        .join(done, "id", "left_anti")
        .select(
            F.col("id").alias("account"),
            F.concat(F.lit("#"), F.col("ring_id").cast("string")).alias("ring"),
            F.lit("ESCALATED").alias("action"),
        )
    )
