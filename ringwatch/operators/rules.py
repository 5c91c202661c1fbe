"""Transaction rules: one declarative list, scored in one projection."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwatch import constants as K
from ringwatch.functions.numbers import to_number, try_number
from ringwatch.functions.policy import containment
from ringwatch.operators.running import exact_quantiles
from ringwatch.operators.skew import attach
from ringwatch.session import cut_lineage
from ringwatch.sources.roles import transactions


@dataclass(frozen=True)
class Rule:
    """A rule fires where its condition holds; it is skipped when a needed column is absent."""

    needs: frozenset[str]
    points: int
    reason: str
    condition: Callable[[], Column]


def _amount() -> Column:
    return to_number("amount")


def _near_limit(limit: int) -> Callable[[], Column]:
    return lambda: (_amount() >= K.STRUCTURING_FLOOR * limit) & (_amount() < float(limit))


def _kind() -> Column:
    return F.upper(F.col("txn_type").cast("string"))


def _drained() -> Column:
    return (to_number("new_orig") == 0) & (to_number("old_orig") > 0)


def _origin_gap() -> Column:
    gap = to_number("new_orig") + _amount() - to_number("old_orig")
    return (F.abs(gap) > 1) & (to_number("old_orig") > 0)


def _dest_gap() -> Column:
    gap = to_number("old_dest") + _amount() - to_number("new_dest")
    return (F.abs(gap) > 1) & (_amount() > 0)


def _rule(name: str, needs: set[str], condition: Callable[[], Column], **fmt) -> Rule:
    return Rule(frozenset(needs), K.RULE_POINTS[name], K.RULE_REASONS[name].format(**fmt), condition)


# Rules that need one transaction only; batch and stream share them.
ROW_RULES = (
    *[_rule("structuring", {"amount"}, _near_limit(x), limit=x) for x in K.STRUCTURING_LIMITS],
    _rule("drained", {"old_orig", "new_orig"}, _drained),
    _rule("origin_gap", {"old_orig", "new_orig"}, _origin_gap),
    _rule("dest_gap", {"old_dest", "new_dest"}, _dest_gap),
    _rule("cash_channel", {"txn_type"}, lambda: _kind().isin(K.CASH_OUT_TYPES)),
)
HIGH_VALUE_RULE = _rule("high_value", {"amount"}, lambda: _amount() >= F.col("_high_value"))
ACCOUNT_RULES = (
    _rule("chain", {"txn_type", "origin", "dest"}, lambda: F.col("_chain_origin") | F.col("_chain_dest")),
    _rule("velocity", {"origin"}, lambda: F.col("_txn_count") >= K.VELOCITY_MIN),
    _rule("rails", {"origin", "channel"}, lambda: F.col("_rail_count") >= K.RAILS_MIN),
)


def apply_rules(feed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Add suspicion_score, reasons and flag from the rules whose columns the feed has."""
    present = set(feed.columns)
    active = [r for r in rules if r.needs <= present]
    hits = [F.coalesce(r.condition(), F.lit(False)) for r in active]
    score = F.lit(0)
    for rule, hit in zip(active, hits):
        score = score + F.when(hit, rule.points).otherwise(0)
    reasons = F.concat_ws("; ", *[F.when(hit, r.reason) for r, hit in zip(active, hits)])
    scored = feed.withColumns(
        {
            "suspicion_score": F.least(score, F.lit(K.MAX_SUSPICION)).cast("int"),
            "reasons": F.when(reasons == "", K.NO_REASON).otherwise(reasons),
        }
    )
    return scored.withColumn("flag", F.col("suspicion_score") >= K.FLAG_MIN)


def high_value_cut(feed: DataFrame) -> DataFrame:
    """One row: the amount that only the top percent of positive amounts reaches."""
    positive = feed.select(to_number("amount").alias("amount")).where("amount > 0")
    return exact_quantiles(positive, "amount", {"high_value": K.HIGH_VALUE_QUANTILE})


def account_facts(feed: DataFrame) -> DataFrame:
    """Per account: rows as origin and destination, transactions, rails, chain membership.

    Grouped by account and rail first, so a hot account reaches the second step as a few
    partial rows.
    """
    has = set(feed.columns)
    # ids of one kind keep it; of different kinds ("M1" beside 17) both are compared as text
    id_type = feed.schema["origin"].dataType
    if "dest" in has and feed.schema["dest"].dataType != id_type:
        id_type = "string"
    kind = _kind() if "txn_type" in has else F.lit(None).cast("string")
    rail = F.col("channel") if "channel" in has else F.lit(None).cast("string")
    sides = [
        F.struct(
            F.col("origin").cast(id_type).alias("account"),
            rail.alias("rail"),
            F.lit(1).alias("as_origin"),
            F.lit(0).alias("as_dest"),
            F.when(F.col("amount").isNotNull(), 1).otherwise(0).alias("counted"),
            F.when(kind == "CASH_OUT", 1).otherwise(0).alias("cash_out"),
            F.lit(0).alias("transfer_in"),
        )
    ]
    if "dest" in has:
        sides.append(
            F.struct(
                F.col("dest").cast(id_type).alias("account"),
                F.lit(None).cast(rail_type(feed)).alias("rail"),
                F.lit(0).alias("as_origin"),
                F.lit(1).alias("as_dest"),
                F.lit(0).alias("counted"),
                F.lit(0).alias("cash_out"),
                F.when(kind == "TRANSFER", 1).otherwise(0).alias("transfer_in"),
            )
        )
    seen = feed.select(F.explode(F.array(*sides)).alias("s")).select("s.*").where("account is not null")
    by_rail = seen.groupBy("account", "rail").agg(
        F.sum("as_origin").alias("as_origin"),
        F.sum("as_dest").alias("as_dest"),
        F.sum("counted").alias("counted"),
        F.max("cash_out").alias("cash_out"),
        F.max("transfer_in").alias("transfer_in"),
    )
    return by_rail.groupBy("account").agg(
        F.sum("as_origin").alias("as_origin"),
        F.sum("as_dest").alias("as_dest"),
        F.sum("counted").alias("txn_count"),
        F.count("rail").alias("rail_count"),
        ((F.max("cash_out") == 1) & (F.max("transfer_in") == 1)).alias("chain"),
    )


def rail_type(feed: DataFrame):
    return feed.schema["channel"].dataType if "channel" in feed.columns else "string"


def chain_accounts(feed: DataFrame) -> DataFrame:
    """Accounts that received a transfer and sent a cash-out."""
    return account_facts(feed).where("chain").select("account")


def _with_account_facts(feed: DataFrame) -> DataFrame:
    if "origin" not in feed.columns:
        return feed
    # one row per account, read by both joins and their skew checks: written once
    facts = cut_lineage(account_facts(feed))
    spread = feed.columns
    as_origin = facts.where("as_origin > 0").select(
        F.col("account").try_cast(feed.schema["origin"].dataType).alias("origin"),
        "as_origin",
        F.col("txn_count").alias("_txn_count"),
        F.col("rail_count").alias("_rail_count"),
        F.col("chain").alias("_chain_origin"),
    )
    out = attach(feed, as_origin, "origin", "as_origin", spread)
    if "dest" not in feed.columns:
        return out
    as_dest = facts.where("chain").select(
        F.col("account").try_cast(feed.schema["dest"].dataType).alias("dest"), "as_dest", F.lit(True).alias("_in")
    ).where("dest is not null")
    out = attach(out, as_dest, "dest", "as_dest", spread)
    return out.withColumn("_chain_dest", F.coalesce("_in", F.lit(False))).withColumn(
        "_chain_origin", F.coalesce("_chain_origin", F.lit(False))
    )


def score_transactions(feed: DataFrame) -> DataFrame:
    """Score a transaction feed with every rule its columns allow."""
    feed = transactions(feed)
    cut = high_value_cut(feed).first()["high_value"]
    wide = _with_account_facts(feed).withColumn("_high_value", F.lit(cut).cast("double"))
    scored = apply_rules(wide, (HIGH_VALUE_RULE, *ROW_RULES, *ACCOUNT_RULES))
    return scored.select(*feed.columns, "suspicion_score", "reasons", "flag")


def with_containment(scored: DataFrame) -> DataFrame:
    return scored.withColumn("action", containment(F.col("suspicion_score")))


def account_rollup(scored: DataFrame) -> DataFrame:
    """Per origin account: volume, worst score, flagged count and flagged value."""
    flagged = F.col("suspicion_score") >= K.FLAG_MIN
    return (
        scored.where("origin is not null")
        .groupBy(F.col("origin").alias("account"))
        .agg(
            F.count(F.lit(1)).alias("txns"),
            F.max("suspicion_score").alias("max_suspicion"),
            F.count_if(flagged).alias("suspicious_txns"),
            F.sum(F.when(flagged, to_number("amount")).otherwise(0.0)).alias("suspicious_value"),
        )
    )


def feed_summary(scored: DataFrame) -> DataFrame:
    """One row: transactions, flagged, accounts implicated, flag rate."""
    implicated = account_rollup(scored).agg(F.count_if(F.col("suspicious_txns") > 0).alias("c"))
    return scored.agg(
        F.count(F.lit(1)).alias("n_transactions"),
        F.count_if("flag").alias("n_flagged"),
        F.avg(F.col("flag").cast("double")).alias("flag_rate"),
    ).withColumn("n_accounts_implicated", implicated.scalar())


def top_flagged(scored: DataFrame, tie: str, k: int = 200) -> DataFrame:
    return scored.where("flag").orderBy(F.desc("suspicion_score"), tie).limit(k)


def movement_features(feed: DataFrame) -> DataFrame:
    """Balance gaps, amount ratios, drain, empty destination, channel and chain flags."""
    feed = transactions(feed)
    amount, old_o, new_o, old_d, new_d = (
        try_number(c) for c in ("amount", "old_orig", "new_orig", "old_dest", "new_dest")
    )
    chain = cut_lineage(account_facts(feed).where("chain"))
    out = attach(
        feed,
        chain.select(F.col("account").alias("origin"), "as_origin", F.lit(1).alias("_co")),
        "origin", "as_origin", feed.columns,
    )
    out = attach(
        out,
        chain.select(F.col("account").alias("dest"), "as_dest", F.lit(1).alias("_cd")),
        "dest", "as_dest", feed.columns,
    )
    return out.select(
        *feed.columns,
        (new_o + amount - old_o).alias("origin_gap"),
        (old_d + amount - new_d).alias("dest_gap"),
        F.try_divide(amount, old_o + 1).alias("amount_to_origin"),
        F.try_divide(amount, old_d + 1).alias("amount_to_dest"),
        F.when((new_o == 0) & (old_o > 0), 1).otherwise(0).alias("drains_origin"),
        F.when(old_d == 0, 1).otherwise(0).alias("dest_was_empty"),
        F.when(F.col("txn_type").isin("TRANSFER", "CASH_OUT"), 1).otherwise(0).alias("is_cash_or_transfer"),
        F.greatest(F.coalesce("_co", F.lit(0)), F.coalesce("_cd", F.lit(0))).alias("in_chain"),
    )
