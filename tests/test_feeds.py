import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ringwatch.operators import fusion, rules
from ringwatch.operators.skew import attach
from ringwatch.sources import generators, roles
from ringwatch.streaming import feeds, runner


def score(spark, rows, schema):
    return rules.score_transactions(spark.createDataFrame(rows, schema))


def test_structuring_edges(spark):
    amounts = [8999.99, 9000.0, 9999.99, 10000.0, 45000.0, 49999.0, 180000.0]
    out = score(spark, [(i, a) for i, a in enumerate(amounts)] + [(99, 1e9)], "id int, amt double").orderBy("id").collect()
    got = ["structuring" in r["reasons"] for r in out[:7]]
    assert got == [False, True, True, False, True, True, True]
    assert out[1]["reasons"] == "structuring (just under 10,000)"
    assert out[0]["reasons"] == "—" and out[0]["suspicion_score"] == 0


def test_missing_columns_skip_rules_and_amount_is_required(spark):
    out = score(spark, [(" 9500",), ("abc",), (None,)], "Amount string")
    assert sorted(r["suspicion_score"] for r in out.collect()) == [0, 0, 55]
    with pytest.raises(ValueError, match="amount"):
        score(spark, [(1,)], "value int")


def test_score_is_capped_and_flagged(spark):
    rows = [("A", "B", "TRANSFER", 9500.0, 9500.0, 0.0, 0.0, 0.0, c) for c in ("UPI", "CARD", "UPI", "UPI", "UPI")]
    rows += [("B", "C", "cash_out", 9500.0, 20000.0, 0.0, 0.0, 0.0, "UPI")]
    schema = (
        "sender string, receiver string, type string, amount double, orig_old_balance double, orig_new_balance double, "
        "dest_old_balance double, dest_new_balance double, mode string"
    )
    out = score(spark, rows, schema).collect()
    assert all(r["suspicion_score"] == 100 and r["flag"] for r in out if r["origin"] == "A")
    assert all("layering chain" in r["reasons"] for r in out)
    assert not any("high velocity" in r["reasons"] for r in out if r["origin"] == "B")


def test_velocity_counts_only_rows_with_an_amount(spark):
    rows = [("A", 1.0)] * 4 + [("A", None)] + [("B", 1.0)] * 5 + [(None, 1.0)] * 6
    out = score(spark, rows, "sender string, amount double").collect()
    fast = {r["origin"] for r in out if "velocity" in r["reasons"]}
    assert fast == {"B"}


def test_adding_a_row_leaves_other_accounts_velocity(spark):
    base = [("A", 1.0)] * 5 + [("B", 1.0)] * 2
    for extra in ([], [("B", 1.0)]):
        out = score(spark, base + extra, "sender string, amount double")
        assert out.where("origin = 'A' and reasons like '%velocity%'").count() == 5


def test_roles_first_alias_wins_and_names_are_trimmed(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x")], " AMT double, txn_amount double, Sender string".strip())
    out = roles.transactions(df)
    assert out.columns == ["amount", "txn_amount", "origin"]
    assert out.first()["amount"] == 1.0


@pytest.mark.parametrize("hot_min_rows, broadcast_max_rows", [(1, 0), (10, 0), (10**9, 0), (1, 10**6)])
def test_attach_equals_plain_join(spark, hot_min_rows, broadcast_max_rows):
    rows = spark.range(2000).select(F.when(F.col("id") < 1500, "hot").otherwise(F.concat(F.lit("k"), F.pmod("id", F.lit(97)))).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.max("id").alias("m")).where("k <> 'k5'")
    got = attach(rows, facts, "k", "w", ["id"], hot_min_rows=hot_min_rows, salts=7, broadcast_max_rows=broadcast_max_rows)
    want = rows.join(facts.drop("w"), "k", "left")
    assert sorted(map(tuple, got.select("k", "id", "m").collect()), key=str) == sorted(
        map(tuple, want.select("k", "id", "m").collect()), key=str
    )
    assert got.count() == 2000


def test_fusion_statuses(spark):
    alerts = spark.createDataFrame([("1", "tms"), ("2", "tms"), ("3", "gov"), ("x9", "gov"), (None, "gov")], "acct string, feed string")
    risk = spark.createDataFrame([(1, 70), (1, 20), (2, 40), (3, 39)], "account_id bigint, risk_score int")
    got = {(r["account"], r["status"].split(" ")[0]) for r in fusion.fuse_alerts(alerts, risk).collect()}
    assert got == {(1, "CORROBORATED"), (2, "model"), (3, "model"), (None, "model")}
    by_source = {r["source"]: (r["n_alerts"], r["n_corroborated"]) for r in fusion.fusion_summary(fusion.fuse_alerts(alerts, risk)).collect()}
    assert by_source == {"tms": (2, 1), "gov": (3, 0)}
    with pytest.raises(ValueError):
        fusion.fuse_alerts(spark.createDataFrame([(1,)], "nobody int"), risk)


def test_regulator_defaults(spark):
    out = fusion.regulator_alerts(spark.createDataFrame([("7",)], "mule_account string")).first()
    assert (out["account"], out["source"], out["severity"]) == (7, "Govt-I4C", "HIGH")
    assert fusion.regulator_alerts(generators.sample_tickets(spark)).count() == 5


def test_generated_feeds_carry_their_plants(spark):
    feed = generators.sample_transactions(spark, 200)
    scored = rules.score_transactions(feed)
    planted = scored.where("amount in (49500, 49000, 99000, 9500, 195000)")
    assert planted.where("reasons like '%structuring%' and reasons like '%drained%'").count() >= 5
    assert fusion.cross_channel_view(generators.sample_rails(spark)).where("cross_channel_flag").count() > 0


def test_cross_channel_ignores_null_rails(spark):
    df = spark.createDataFrame([("a", "UPI", 1.0), ("a", None, 2.0), ("b", "UPI", 1.0), ("b", "CARD", None)], "account string, rail string, amount double")
    out = {r["account"]: r for r in fusion.cross_channel_view(df).collect()}
    assert (out["a"]["n_channels"], out["a"]["txns"], out["a"]["total_value"]) == (1, 2, 3.0)
    assert out["b"]["channels"] == "CARD, UPI" and out["b"]["cross_channel_flag"]


def event(i, minute, kind, sender="a", receiver="a"):
    return (i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), kind, sender, receiver, 10.0, "UPI")


EVENT_SCHEMA = "event_id int, ts timestamp, type string, sender string, receiver string, amount double, rail string"


def test_chain_is_ordered_and_bounded(spark):
    rows = [event(1, 0, "TRANSFER"), event(2, 10, "CASH_OUT"), event(3, 400, "CASH_OUT"), event(4, 5, "CASH_OUT", "b"), event(5, 20, "TRANSFER")]
    got = {(r["in_id"], r["out_id"]) for r in feeds.transfer_chains(spark.createDataFrame(rows, EVENT_SCHEMA)).collect()}
    assert got == {(1, 2)}


def test_late_rows_are_dropped_by_the_stream(spark, tmp_path):
    first = [event(i, 60 * 48 + i, "PAYMENT") for i in range(5)]
    late = [event(9, 0, "PAYMENT")]
    folder = str(tmp_path / "in")
    spark.createDataFrame(first, EVENT_SCHEMA).coalesce(1).write.parquet(folder)
    stream = runner.open_stream(spark, folder)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    runner.drain(feeds.account_windows(stream), "w", out, progress)
    spark.createDataFrame(late, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    closing = [event(20, 60 * 96, "PAYMENT")]
    runner.drain(feeds.account_windows(runner.open_stream(spark, folder)), "w", out, progress)
    spark.createDataFrame(closing, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    table = runner.drain(feeds.account_windows(runner.open_stream(spark, folder)), "w", out, progress)
    rows = table.collect()
    assert [(r["txns"], r["high_velocity"]) for r in rows] == [(5, True)]


def test_cut_is_read_anew_for_each_batch(spark, tmp_path):
    cuts, folder, out = (str(tmp_path / x) for x in ("cuts", "in", "out"))
    feed = spark.createDataFrame([event(i, i, "PAYMENT") for i in range(4)], EVENT_SCHEMA)
    work = lambda batch: feeds.score_events(batch, feeds.saved_high_value(spark, cuts))
    seen = {}
    for number, (low, high) in enumerate(((10.0, 500.0), (400.0, 500.0))):
        # a cut at the only amount of its feed
        feeds.save_high_value(feed.limit(1).withColumn("amount", F.lit(low)), cuts)
        rows = feed.withColumns({"amount": F.lit(300.0), "event_id": F.col("event_id") + 10 * number})
        rows.coalesce(1).write.mode("append").parquet(folder)
        table = runner.drain_batches(runner.open_stream(spark, folder), "cuts", work, out, f"{out}-progress")
        seen = {r["event_id"]: r["suspicion_score"] for r in table.collect()}
    assert [seen[i] for i in range(4)] == [30] * 4 and [seen[10 + i] for i in range(4)] == [0] * 4


def test_late_rows_are_counted_in_a_side_table(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    deliveries = [[event(i, 60 * 48 + i, "PAYMENT") for i in range(5)], [event(9, 0, "PAYMENT"), event(10, 60 * 48 - 50, "PAYMENT")], [event(11, 60 * 48, "PAYMENT")]]
    for rows in deliveries:
        spark.createDataFrame(rows, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        in_time, late = runner.drain_in_time(runner.open_stream(spark, folder), "late", "1 hour", out, f"{out}/progress")
    assert sorted(r["event_id"] for r in in_time.collect()) == [0, 1, 2, 3, 4, 10, 11]
    assert [(r["event_id"], r["batch"]) for r in late.collect()] == [(9, 1)]


def test_chains_of_a_busy_account_over_many_stretches(spark):
    rng = random.Random(4)
    rows = [event(i, rng.randrange(0, 60 * 24 * 30), rng.choice(["TRANSFER", "CASH_OUT"])) for i in range(400)]
    got = feeds.transfer_chains(spark.createDataFrame(rows, EVENT_SCHEMA))
    pairs = sorted((r["in_id"], r["out_id"]) for r in got.collect())
    at = {r[0]: r for r in rows}
    ts, kind = 1, 2
    hours6 = dt.timedelta(hours=6)
    want = sorted(
        (a[0], b[0]) for a in at.values() for b in at.values()
        if a[kind] == "TRANSFER" and b[kind] == "CASH_OUT" and a[ts] <= b[ts] <= a[ts] + hours6
    )
    assert pairs == want and len(want) > 100
