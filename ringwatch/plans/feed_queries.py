"""Queries on transaction, ticket, rail and event feeds."""

import uuid

from pyspark.sql import functions as F

from ringwatch.operators import fusion, rules
from ringwatch.plans import bindings as B
from ringwatch.plans import oracles as O
from ringwatch.plans.registry import query, rounded
from ringwatch.session import cut_lineage, shared_folder
from ringwatch.sources.roles import transactions
from ringwatch.streaming import feeds, runner


def _scored(spark, sf):
    return rules.score_transactions(B.feed(spark, sf))


@query("txn_scores", f"""WITH {O.SCORED}
SELECT txn_id, suspicion_score, reasons, flag,
  CASE WHEN suspicion_score >= 70 THEN 'FREEZE + ESCALATE' WHEN suspicion_score >= 50 THEN 'HOLD + REVIEW'
       ELSE 'monitor' END AS action
FROM scored""")
def txn_scores(spark, sf):
    scored = rules.with_containment(_scored(spark, sf))
    return scored.select("txn_id", "suspicion_score", "reasons", "flag", "action")


@query("txn_flagged_top", f"""WITH {O.SCORED}
SELECT txn_id, origin AS account, amount, suspicion_score, reasons FROM scored WHERE flag
ORDER BY suspicion_score DESC, txn_id LIMIT 200""")
def txn_flagged_top(spark, sf):
    top = rules.top_flagged(_scored(spark, sf), "txn_id", 200)
    return top.select("txn_id", F.col("origin").alias("account"), "amount", "suspicion_score", "reasons")


@query("txn_rollup", f"WITH {O.SCORED} SELECT * FROM rollup_rows")
def txn_rollup(spark, sf):
    return rounded(rules.account_rollup(_scored(spark, sf)), 2, "suspicious_value")


@query("txn_rollup_top", f"""WITH {O.SCORED} SELECT account, txns, max_suspicion, suspicious_txns FROM rollup_rows
ORDER BY max_suspicion DESC, account LIMIT 50""")
def txn_rollup_top(spark, sf):
    rows = rules.account_rollup(_scored(spark, sf))
    return rows.orderBy(F.desc("max_suspicion"), "account").limit(50).drop("suspicious_value")


@query("txn_summary", f"""WITH {O.SCORED}
SELECT count(*) AS n_transactions, count(*) FILTER (flag) AS n_flagged, round(avg(flag::INT::DOUBLE), 6) AS flag_rate,
  (SELECT count(*) FROM rollup_rows WHERE suspicious_txns > 0) AS n_accounts_implicated FROM scored""")
def txn_summary(spark, sf):
    return rounded(rules.feed_summary(_scored(spark, sf)), 6, "flag_rate")


@query("high_value_cut", f"""WITH {O.FEED}
SELECT round(quantile_cont(amount, 0.99), 4) AS high_value FROM feed WHERE amount > 0""")
def high_value_cut(spark, sf):
    return rounded(rules.high_value_cut(transactions(B.feed(spark, sf))), 4, "high_value")


@query("chain_accounts", f"WITH {O.FEED} SELECT a AS account FROM chain")
def chain_accounts(spark, sf):
    return rules.chain_accounts(transactions(B.feed(spark, sf)))


@query("account_facts", f"""WITH {O.FEED},
o AS (SELECT origin AS account, count(*) AS as_origin, count(amount) AS txn_count, count(DISTINCT channel) AS rail_count
      FROM feed GROUP BY 1),
t AS (SELECT dest AS account, count(*) AS as_dest FROM feed WHERE dest IS NOT NULL GROUP BY 1)
SELECT account, coalesce(as_origin, 0) AS as_origin, coalesce(as_dest, 0) AS as_dest, coalesce(txn_count, 0) AS txn_count,
  coalesce(rail_count, 0) AS rail_count, account IN (SELECT a FROM chain) AS chain
FROM o FULL JOIN t USING (account)""")
def account_facts(spark, sf):
    return rules.account_facts(transactions(B.feed(spark, sf)))


@query("txn_features", f"""WITH {O.FEED}
SELECT txn_id, round(new_orig + amount - old_orig, 4) AS origin_gap, round(old_dest + amount - new_dest, 4) AS dest_gap,
  round(amount / nullif(old_orig + 1, 0), 6) AS amount_to_origin, round(amount / nullif(old_dest + 1, 0), 6) AS amount_to_dest,
  coalesce(new_orig = 0 AND old_orig > 0, false)::INT AS drains_origin, coalesce(old_dest = 0, false)::INT AS dest_was_empty,
  (txn_type IN ('TRANSFER', 'CASH_OUT'))::INT AS is_cash_or_transfer,
  (origin IN (SELECT a FROM chain) OR coalesce(dest IN (SELECT a FROM chain), false))::INT AS in_chain
FROM feed""")
def txn_features(spark, sf):
    out = rules.movement_features(B.feed(spark, sf)).select(
        "txn_id", "origin_gap", "dest_gap", "amount_to_origin", "amount_to_dest", "drains_origin", "dest_was_empty",
        "is_cash_or_transfer", "in_chain",
    )
    return rounded(rounded(out, 4, "origin_gap", "dest_gap"), 6, "amount_to_origin", "amount_to_dest")


_RAILS = """
SELECT o_custkey AS account, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS channels,
  count(DISTINCT o_orderpriority) AS n_channels, count(*) AS txns, round(sum(o_totalprice), 2) AS total_value,
  count(DISTINCT o_orderpriority) >= 2 AS cross_channel_flag FROM orders GROUP BY 1"""


@query("cross_channel", _RAILS)
def cross_channel(spark, sf):
    return rounded(fusion.cross_channel_view(B.rail_feed(spark, sf)), 2, "total_value")


@query("cross_channel_summary", f"""SELECT count(*) AS n_accounts, count(*) FILTER (cross_channel_flag) AS n_cross_channel
FROM ({_RAILS})""")
def cross_channel_summary(spark, sf):
    return fusion.cross_channel_summary(fusion.cross_channel_view(B.rail_feed(spark, sf)))


@query("cross_channel_top", f"""SELECT account, n_channels, txns, total_value FROM ({_RAILS})
ORDER BY n_channels DESC, total_value DESC, account LIMIT 50""")
def cross_channel_top(spark, sf):
    view = rounded(fusion.cross_channel_view(B.rail_feed(spark, sf)), 2, "total_value")
    top = view.orderBy(F.desc("n_channels"), F.desc("total_value"), "account").limit(50)
    return top.select("account", "n_channels", "txns", "total_value")


_FUSED = """
risk AS (SELECT c_custkey AS a, round_even(100 * ((c_acctbal + 1000) / 11000), 0)::INT AS r FROM customer WHERE c_custkey % 7 <> 0),
fused AS (
  SELECT o_orderkey AS ticket_no, o_custkey AS account, o_orderstatus AS source, o_orderpriority AS severity, r AS model_risk,
    CASE WHEN r >= 70 THEN 'CORROBORATED — escalate' WHEN r >= 40 THEN 'model also elevated'
         ELSE 'model low / unknown — review' END AS status
  FROM orders LEFT JOIN risk ON a = o_custkey)
"""


@query("alert_fusion", f"WITH {_FUSED} SELECT * FROM fused")
def alert_fusion(spark, sf):
    return fusion.fuse_alerts(B.alert_tickets(spark, sf), B.account_risk(spark, sf)).select(
        "ticket_no", "account", "source", "severity", "model_risk", "status"
    )


@query("alert_by_source", f"""WITH {_FUSED} SELECT source, count(*) AS n_alerts,
  count(*) FILTER (starts_with(status, 'CORROBORATED')) AS n_corroborated FROM fused GROUP BY 1""")
def alert_by_source(spark, sf):
    return fusion.fusion_summary(fusion.fuse_alerts(B.alert_tickets(spark, sf), B.account_risk(spark, sf)))


@query("reg_fusion", f"""WITH {_FUSED} SELECT account, 'Govt-I4C' AS source, severity, ticket_no::VARCHAR AS ticket,
  model_risk, status FROM fused""")
def reg_fusion(spark, sf):
    tickets = fusion.regulator_alerts(B.regulator_feed(spark, sf))
    return fusion.fuse_alerts(tickets, B.account_risk(spark, sf)).select(
        "account", "source", "severity", "ticket", "model_risk", "status"
    )


@query("ground_truth", """SELECT doc_id, n_chars, CASE WHEN toxic = 1 THEN 'MULE' WHEN toxic IS NOT NULL THEN 'legit' END AS ground_truth
FROM documents LEFT JOIN labels USING (doc_id)""")
def ground_truth(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", "n_chars")
    return fusion.attach_ground_truth(docs, B.table(spark, sf, "labels"), "doc_id", "toxic")


_EVENT_SCORE = f"""WITH {O.EVENTS},
sc AS (
  SELECT event_id, least(100, %s 25 * ((amount >= 9000 AND amount < 10000)::INT + (amount >= 45000 AND amount < 50000)::INT
      + (amount >= 90000 AND amount < 100000)::INT + (amount >= 180000 AND amount < 200000)::INT)
    + 10 * (kind IN ('CASH_OUT', 'TRANSFER', 'WITHDRAWAL'))::INT)::INT AS suspicion_score FROM ev
)
SELECT event_id, suspicion_score, suspicion_score >= 50 AS flag,
  CASE WHEN suspicion_score >= 70 THEN 'FREEZE + ESCALATE' WHEN suspicion_score >= 50 THEN 'HOLD + REVIEW'
       ELSE 'monitor' END AS action FROM sc"""
_CUT = "30 * (amount >= (SELECT quantile_cont(amount, 0.99) FROM ev WHERE amount > 0))::INT + "


@query("event_actions", _EVENT_SCORE % "")
def event_actions(spark, sf):
    return feeds.score_events(B.event_feed(spark, sf)).select("event_id", "suspicion_score", "flag", "action")


@query("event_high_value", _EVENT_SCORE % _CUT)
def event_high_value(spark, sf):
    events = B.event_feed(spark, sf)
    cut = rules.high_value_cut(transactions(events)).first()["high_value"]
    return feeds.score_events(events, cut).select("event_id", "suspicion_score", "flag", "action")


_WINDOWS = """
w AS (SELECT time_bucket(INTERVAL 1 day, ts) AS s, account, count(amount) AS txns, count(DISTINCT channel) AS rails FROM ev GROUP BY 1, 2)
SELECT epoch(s)::BIGINT AS window_start, account, txns, rails, txns >= 5 AS high_velocity, rails >= 2 AS cross_rail FROM w"""


def _windows(df):
    return df.select(
        F.unix_timestamp("window_start").alias("window_start"), "account", "txns", "rails", "high_velocity", "cross_rail"
    )


@query("event_velocity", f"WITH {O.EVENTS}, {_WINDOWS}")
def event_velocity(spark, sf):
    return _windows(feeds.account_windows(B.event_feed(spark, sf)))


_SLIDE = """
w AS (
  SELECT s, account, count(amount) AS txns, count(DISTINCT channel) AS rails
  FROM ev, unnest([time_bucket(INTERVAL 12 hours, ts), time_bucket(INTERVAL 12 hours, ts) - INTERVAL 12 hours]) AS x(s)
  GROUP BY 1, 2)
SELECT epoch(s)::BIGINT AS window_start, account, txns, rails, txns >= 5 AS high_velocity, rails >= 2 AS cross_rail FROM w"""


@query("event_velocity_sliding", f"WITH {O.EVENTS}, {_SLIDE}")
def event_velocity_sliding(spark, sf):
    return _windows(feeds.account_windows(B.event_feed(spark, sf), "1 day", "12 hours"))


_CHAINS = """SELECT a.account, a.event_id AS in_id, b.event_id AS out_id FROM ev a JOIN ev b ON a.account = b.account
  AND a.kind = 'TRANSFER' AND b.kind = 'CASH_OUT' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 hours"""


@query("event_chain", f"WITH {O.EVENTS} {_CHAINS}")
def event_chain(spark, sf):
    return feeds.transfer_chains(B.event_feed(spark, sf)).select("account", "in_id", "out_id")


def _event_stream(spark, sf):
    raw = runner.open_stream(spark, f"{sf}/events.parquet")
    return B.as_event_feed(raw)


@query("stream_event_actions", _EVENT_SCORE % "")
def stream_event_actions(spark, sf):
    scored = feeds.score_events(_event_stream(spark, sf)).select("event_id", "suspicion_score", "flag", "action")
    return runner.drain(scored, "event_actions")


@query("stream_event_velocity", f"""WITH {O.EVENTS}, {_WINDOWS}
WHERE s + INTERVAL 1 day <= (SELECT max(ts) - INTERVAL 1 hour FROM ev)""")
def stream_event_velocity(spark, sf):
    return runner.drain(_windows(feeds.account_windows(_event_stream(spark, sf))), "event_velocity")


@query("stream_event_chain", f"WITH {O.EVENTS} {_CHAINS}")
def stream_event_chain(spark, sf):
    chains = feeds.transfer_chains(_event_stream(spark, sf)).select("account", "in_id", "out_id")
    return runner.drain(chains, "event_chain")


@query("stream_ticket_fusion", f"WITH {_FUSED} SELECT ticket_no, account, source, model_risk, status FROM fused")
def stream_ticket_fusion(spark, sf):
    tickets = B.as_alert_tickets(runner.open_stream(spark, f"{sf}/orders.parquet"))
    fused = feeds.fuse_ticket_stream(tickets, B.account_risk(spark, sf))
    return runner.drain(fused.select("ticket_no", "account", "source", "model_risk", "status"), "ticket_fusion")


@query("stream_without_repeats", "SELECT event_id, user_id AS sender FROM events")
def stream_without_repeats(spark, sf):
    events = _event_stream(spark, sf)
    # every event is delivered twice
    twice = events.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    return runner.drain(feeds.without_repeats(twice, "event_id").select("event_id", "sender"), "without_repeats")


@query("stream_event_high_value", _EVENT_SCORE % _CUT)
def stream_event_high_value(spark, sf):
    """The cut of the whole feed is saved first; every batch is scored by the newest saved one."""
    cuts = f"{shared_folder(spark)}/streams/cuts-{uuid.uuid4().hex}"
    feeds.save_high_value(B.event_feed(spark, sf), cuts)
    scored = runner.drain_batches(
        _event_stream(spark, sf), "event_high_value", lambda batch: feeds.score_events(batch, feeds.saved_high_value(spark, cuts))
    )
    return scored.select("event_id", "suspicion_score", "flag", "action")


_DELIVERED = """
d AS (SELECT event_id, ts, least(floor(4 * (epoch_us(ts) - lo) / (hi - lo + 1.0::DOUBLE))::INT + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END, 4) AS b
  FROM ev, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM ev)),
m AS (SELECT b, max(max(ts)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM d GROUP BY 1),
l AS (SELECT d.b, coalesce(ts < newest - INTERVAL 1 hour, false) AS late FROM d JOIN m USING (b))
SELECT b AS batch, count(*) FILTER (NOT late) AS n_in_time, count(*) FILTER (late) AS n_late FROM l GROUP BY 1"""


@query("stream_late_events", f"WITH {O.EVENTS}, {_DELIVERED}")
def stream_late_events(spark, sf):
    """Events delivered in five parts by their time, every ninth one part later: late rows are set aside and counted."""
    events = B.event_feed(spark, sf)
    ends = events.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi")).first()
    quarter = F.floor(4 * (F.unix_micros("ts") - F.lit(ends["lo"])) / F.lit(ends["hi"] - ends["lo"] + 1.0)).cast("int")
    part = F.least(quarter + F.when(F.col("event_id") % 9 == 0, 1).otherwise(0), F.lit(4))
    inbox = f"{shared_folder(spark)}/streams/inbox-{uuid.uuid4().hex}"
    parts = cut_lineage(events.withColumn("part", part))
    out = f"{shared_folder(spark)}/streams/late-{uuid.uuid4().hex}"
    for k in range(5):
        # one delivery is one batch
        parts.where(F.col("part") == k).drop("part").write.mode("append").parquet(inbox)
        in_time, late = runner.drain_in_time(runner.open_stream(spark, inbox), "late", "1 hour", out, f"{out}/progress")
    counts = lambda df, name: df.groupBy("batch").agg(F.count(F.lit(1)).alias(name))
    both = counts(in_time, "n_in_time").join(counts(late, "n_late"), "batch", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select(F.col("batch").cast("int").alias("batch"), zero("n_in_time"), zero("n_late"))
