"""Feeds as they come: mixed and text ids, fractional tickets, ties in the case log, no columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ringwatch.operators import cases, components, fusion
from ringwatch.operators.longform import feature_histogram, to_long
from ringwatch.operators.rules import chain_accounts, score_transactions
from ringwatch.sources import casestore


def test_ids_of_two_kinds_are_compared_as_text(spark):
    rows = [(1, "M1", "TRANSFER", 10.0), (2, "7", "TRANSFER", 10.0), (7, "M2", "CASH_OUT", 9.0)]
    feed = spark.createDataFrame(rows, "origin long, dest string, txn_type string, amount double")
    assert [r["account"] for r in chain_accounts(feed).collect()] == ["7"]
    scored = {r["origin"]: r["reasons"] for r in score_transactions(feed).collect()}
    assert set(scored) == {1, 2, 7} and scored[7] != scored[1]


def test_fractional_ticket_ids_match_no_account(spark):
    tickets = spark.createDataFrame([("12.7",), ("12.0",), ("12",), ("x",), (None,)], "t string")
    assert [r[0] for r in tickets.select(fusion.account_number(F.col("t"))).collect()] == [None, 12, 12, None, None]


def test_rings_of_text_accounts(spark):
    edges = spark.createDataFrame([("A1", "A2"), ("A2", "A3"), ("B7", "B8"), ("B8", "B9"), ("C1", "C2")], "src string, dst string")
    members = components.ring_members(components.connected_components(edges))
    rings = {}
    for r in members.collect():
        rings.setdefault(r["ring_id"], set()).add(r["id"])
    assert rings == {1: {"A1", "A2", "A3"}, 2: {"B7", "B8", "B9"}}
    risk = spark.createDataFrame([("A3", 90), ("A2", 90), ("B7", 5)], "id string, risk_score int")
    leads = {r["ring_id"]: r["lead_account"] for r in components.ring_table(members, risk).collect()}
    assert leads == {1: "A2", 2: "B7"}


def test_case_log_feeds_its_readers(spark, tmp_path):
    path, now = str(tmp_path / "log"), dt.datetime(2024, 1, 1)
    rows = [(1, "CLEARED", "NEW", None, now), (1, "ESCALATED", "ESCALATED", "kim", now), (2, "MONITORED", "INVESTIGATING", "lee", now)]
    casestore.append(spark.createDataFrame(rows, "account long, action string, status string, owner string, time_utc timestamp").coalesce(1), path, "s1")
    log = casestore.scan(spark, path)
    assert {r["account"]: r["action"] for r in cases.latest_actions(log).collect()} == {1: "ESCALATED", 2: "MONITORED"}
    assert {(r["account"], r["status"]) for r in cases.state_changes(log).collect()} == {(1, "ESCALATED"), (2, "INVESTIGATING")}
    members = spark.createDataFrame([(1, 2, 1), (1, 2, 2)], "ring_id int, size long, id long")
    casestore.append(cases.escalation_rows(members, log, 1), path, "s2")
    log = casestore.scan(spark, path)
    assert cases.ring_containment(members, log).first()["state"] == "Contained"
    assert casestore.count(spark, path) == 4
    with pytest.raises(ValueError, match="colour"):
        casestore.append(spark.createDataFrame([(1, "red")], "account long, colour string"), path, "s3")


def test_no_columns_give_no_rows(spark):
    df = spark.createDataFrame([(1, 2.0)], "k int, x double")
    assert feature_histogram(df, []).count() == 0 and to_long(df, [], ["k"]).columns == ["k", "feature", "value"]


def test_bins_spread_close_values_and_common_starts(spark):
    from ringwatch.operators.running import _range_bins, prefix_sums, text_row_numbers

    n, start = 4000, 1_700_000_000_000
    hist = spark.range(n).select((F.lit(start) + F.col("id") * 1000).alias("v"), F.lit(1).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        bins = _range_bins(hist, [], F.col("v")).groupBy("_bin").count().collect()
        assert len(bins) == 8 and max(r["count"] for r in bins) < n / 4
        sums = prefix_sums(hist, [], "v", ["n"]).collect()
        assert all(r["n_before"] == (r["v"] - start) // 1000 and r["n_total"] == n for r in sums)
        ids = spark.range(n).select(F.format_string("ACC-%08d", "id").alias("t"), "id")
        assert len(_range_bins(ids, [], F.col("t")).select("_bin").distinct().collect()) == 8
        assert all(r["rn"] == r["id"] for r in text_row_numbers(ids, [], "t").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
