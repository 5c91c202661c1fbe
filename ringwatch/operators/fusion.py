"""Alert and regulator tickets against account risk; accounts across payment rails."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwatch import constants as K
from ringwatch.functions.numbers import ladder, to_number
from ringwatch.operators.skew import attach
from ringwatch.session import cut_lineage
from ringwatch.sources import roles


def account_number(col: Column) -> Column:
    """Whole-number account id of a ticket; unreadable ids and fractions become null."""
    value = F.expr("cast(null as double)") if col is None else col.try_cast("double")
    whole = value.try_cast("bigint")
    return F.when(~F.isnan(value) & (whole.cast("double") == value), whole)


def fuse_alerts(alerts: DataFrame, risk: DataFrame, streaming: bool = False) -> DataFrame:
    """Put the model risk of the account beside each ticket; unknown accounts stay.

    `risk` holds account_id and risk_score; of several scores per account the highest counts.
    """
    tickets = roles.alerts(alerts)
    has = set(tickets.columns)
    tickets = tickets.withColumns(
        {
            "account": account_number(F.col("account")),
            "source": F.col("source") if "source" in has else F.lit(K.DEFAULT_ALERT_SOURCE),
            "severity": F.col("severity") if "severity" in has else F.lit(K.DEFAULT_ALERT_SEVERITY),
        }
    )
    best = risk.groupBy(F.col("account_id").cast("bigint").alias("account")).agg(
        F.max("risk_score").cast("int").alias("model_risk")
    )
    if streaming:
        fused = tickets.join(best, "account", "left")
    else:
        per_account = tickets.where("account is not null").groupBy("account").agg(F.count(F.lit(1)).alias("_tickets"))
        weighted = cut_lineage(per_account.join(best, "account"))
        fused = attach(tickets, weighted, "account", "_tickets", tickets.columns)
    return fused.withColumn("status", ladder(F.col("model_risk"), K.FUSION_STATUS, K.FUSION_DEFAULT))


def fusion_summary(fused: DataFrame) -> DataFrame:
    confirmed = F.col("status").startswith("CORROBORATED")
    return fused.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_alerts"), F.count_if(confirmed).alias("n_corroborated")
    )


def regulator_alerts(feed: DataFrame) -> DataFrame:
    """A regulator feed in the alert schema, ready for `fuse_alerts`."""
    tickets = roles.regulator_tickets(feed)
    has = set(tickets.columns)
    out = [
        account_number(F.col("account")).alias("account"),
        F.lit(K.REGULATOR_SOURCE).alias("source"),
        (F.col("severity") if "severity" in has else F.lit(K.REGULATOR_SEVERITY)).alias("severity"),
    ]
    if "ticket" in has:
        out.append(F.col("ticket").cast("string").alias("ticket"))
    return tickets.select(*out)


def cross_channel_view(feed: DataFrame) -> DataFrame:
    """Per account: its rails, their number, transactions, value, and a flag from two rails on.

    The first step groups by account and rail, so the rail list is built from one row per rail.
    """
    rows = roles.rails(feed)
    amount = to_number("amount") if "amount" in rows.columns else F.lit(0.0)
    by_rail = (
        rows.where("account is not null")
        .groupBy("account", F.col("channel").cast("string").alias("channel"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("value"))
    )
    return (
        by_rail.groupBy("account")
        .agg(
            F.concat_ws(", ", F.array_sort(F.collect_list("channel"))).alias("channels"),
            F.count("channel").alias("n_channels"),
            F.sum("n").alias("txns"),
            F.sum("value").alias("total_value"),
        )
        .withColumn("cross_channel_flag", F.col("n_channels") >= K.RAILS_MIN)
    )


def cross_channel_summary(view: DataFrame) -> DataFrame:
    return view.agg(
        F.count(F.lit(1)).alias("n_accounts"), F.count_if("cross_channel_flag").alias("n_cross_channel")
    )


def attach_ground_truth(scored: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Add the known outcome of each account; accounts without a label stay with null."""
    from ringwatch.functions.policy import ground_truth

    known = labels.groupBy(key).agg(F.max(label).alias("_label"))
    return scored.join(known, key, "left").withColumn("ground_truth", ground_truth(F.col("_label"))).drop("_label")
