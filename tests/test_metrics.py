import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringwatch import constants as K
from ringwatch.functions.numbers import grid_index, risk_score, value_bin
from ringwatch.functions.policy import band, confidence_tier
from ringwatch.operators import metrics as M
from ringwatch.operators import policy, splits
from ringwatch.operators.running import exact_quantiles, mid_ranks, prefix_sums, row_numbers


def frame(spark, scores, labels, run="a"):
    rows = [(run, f"id{i}", float(s), int(y)) for i, (s, y) in enumerate(zip(scores, labels))]
    return spark.createDataFrame(rows, "run string, account_id string, score double, label int")


def average_precision(s, y):
    total, out, tp, n = sum(y), 0.0, 0, 0
    for v in sorted(set(s), reverse=True):
        pos = sum(b for a, b in zip(s, y) if a == v)
        tp, n = tp + pos, n + sum(1 for a in s if a == v)
        out += pos / total * tp / n
    return out


def auc(s, y):
    pos, neg = [a for a, b in zip(s, y) if b], [a for a, b in zip(s, y) if not b]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_rank_metrics_with_ties_and_monotone_maps(spark):
    rng = np.random.default_rng(5)
    s = np.round(rng.random(300), 1)
    y = (rng.random(300) < s * 0.5).astype(int)
    row = M.rank_metrics(frame(spark, s, y), ["run"]).first()
    assert row["average_precision"] == pytest.approx(average_precision(list(s), list(y)))
    assert row["roc_auc"] == pytest.approx(auc(list(s), list(y)))
    assert row["brier"] == pytest.approx(np.mean((s - y) ** 2))
    mapped = M.rank_metrics(frame(spark, s**3 * 7 - 2, y), ["run"]).first()
    assert mapped["average_precision"] == pytest.approx(row["average_precision"])
    assert mapped["roc_auc"] == pytest.approx(row["roc_auc"])


def test_single_class_gives_null_not_an_error(spark):
    row = M.rank_metrics(frame(spark, [0.1, 0.2], [0, 0]), ["run"]).first()
    assert row["roc_auc"] is None and row["average_precision"] is None


def test_value_bins_keep_order(spark):
    values = sorted([0.0, -0.0, 1e-300, -1e-300, 1.0, -1.0, 1.0000001, 5e300, -5e300, 0.1, 0.2, 1e9, 1e9 + 1])
    bins = [r["b"] for r in spark.createDataFrame([(v,) for v in values], "v double").orderBy("v").select(value_bin(F.col("v")).alias("b")).collect()]
    assert bins == sorted(bins)


@pytest.mark.parametrize("ascending", [True, False])
def test_prefix_sums_both_forms(spark, ascending):
    rng = np.random.default_rng(1)
    rows = [(k, float(v), int(rng.integers(1, 9))) for k in "ab" for v in {round(x, 2) for x in rng.normal(size=200)}]
    hist = spark.createDataFrame(rows, "k string, v double, n int")
    want = {}
    for k in "ab":
        total = 0
        for _, v, n in sorted((r for r in rows if r[0] == k), key=lambda r: r[1] if ascending else -r[1]):
            want[(k, v)] = total
            total += n
    for small in (True, False):
        got = {(r["k"], r["v"]): r["n_before"] for r in prefix_sums(hist, ["k"], "v", ["n"], ascending, small).collect()}
        assert got == want


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.normal(size=501), np.zeros(300), [np.nan] * 0])
    df = spark.createDataFrame([("x", float(v)) for v in data] + [("y", 3.0), ("x", None)], "k string, v double")
    q = {"a": 0.0, "b": 0.05, "c": 0.3, "d": 0.5, "e": 0.99, "f": 1.0}
    rows = {r["k"]: r for r in exact_quantiles(df, "v", q, ["k"]).collect()}
    assert [rows["x"][n] for n in q] == pytest.approx(list(np.quantile(data, list(q.values()))))
    assert [rows["y"][n] for n in q] == [3.0] * len(q)
    assert exact_quantiles(df.where("k = 'x'"), "v", {"m": 0.5}).first()["m"] == pytest.approx(np.median(data))


def test_mid_ranks(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double")
    got = {r["v"]: r["rank_share"] for r in mid_ranks(df, "v").collect()}
    assert got == {1.0: 0.25, 2.0: 0.625, 5.0: 1.0}


def test_grid_index_and_half_even_scores(spark):
    df = spark.createDataFrame([(0.0,), (0.01,), (0.5,), (0.995,)], "v double")
    got = [r["g"] for r in df.select("v", grid_index(F.col("v"), K.PERCENT_GRID).alias("g")).orderBy("v").collect()]
    assert got == [0, 1, 50, 99]
    halves = spark.createDataFrame([(0.005,), (0.015,), (0.025,), (0.125,)], "p double").select(risk_score("p").alias("s"))
    assert [r["s"] for r in halves.collect()] == [0, 2, 2, 12]


def test_bands_and_tiers(spark):
    df = spark.createDataFrame([(89, 0.1), (90, 0.9), (39, 0.5), (40, 0.100001)], "s int, p double")
    got = [(r["b"], r["t"]) for r in df.select(band(F.col("s")).alias("b"), confidence_tier(F.col("p")).alias("t")).collect()]
    assert got == [("HIGH", "CONFIDENT-LEGIT"), ("CRITICAL", "CONFIDENT-MULE"), ("LOW", "UNCERTAIN"), ("MEDIUM", "UNCERTAIN")]


def test_recall_point_takes_the_highest_threshold(spark):
    scores = frame(spark, [0.9, 0.8, 0.3, 0.2], [1, 1, 0, 1])
    table = M.threshold_table(scores, [0.1, 0.2, 0.25, 0.85, 0.95], ["run"])
    got = {r["target_recall"]: (r["achievable"], r["threshold"]) for r in M.recall_points(table, [0.6, 1.0], ["run"]).collect()}
    assert got == {0.6: (True, 0.25), 1.0: (True, 0.2)}
    none = M.recall_points(M.threshold_table(scores, [0.95], ["run"]), [0.5], ["run"]).first()
    assert not none["achievable"] and none["threshold"] is None and none["max_recall"] == 0.0


def test_abstention_falls_back_when_zones_cross(spark):
    row = policy.abstention_thresholds(frame(spark, [0.5, 0.5], [1, 1]), ["run"]).first()
    assert (row["t_lo"], row["t_hi"]) == (0.0, 0.5)
    crossed = frame(spark, [0.2, 0.8, 0.3], [0, 1, 0])
    row = policy.abstention_thresholds(crossed, ["run"], precision=0.0, npv=0.0).first()
    assert (row["t_lo"], row["t_hi"]) == (K.DEFAULT_T_LO, K.DEFAULT_T_HI)


def test_abstention_and_percentiles_without_runs(spark):
    scores = frame(spark, [0.01, 0.02, 0.5, 0.97, 0.99], [0, 0, 0, 1, 1]).drop("run")
    cuts = policy.abstention_thresholds(scores, [])
    report = policy.abstention_report(scores, cuts, []).first()
    assert (report["n"], report["n_auto"], report["auto_zone_errors"]) == (5, 5, 0)
    scored = M.with_score_and_band(scores)
    assert M.positive_score_percentiles(scored, {"p50": 0.5}, []).first()["share_high"] == 1.0
    assert M.calibration_table(scores, 2, []).count() == 2


def test_permuted_rows_change_nothing(spark):
    rng = np.random.default_rng(9)
    s, y = np.round(rng.random(100), 2), rng.integers(0, 2, 100)
    df = frame(spark, s, y)
    a = M.rank_metrics(df, ["run"]).first()
    b = M.rank_metrics(df.orderBy(F.rand(3)).repartition(5), ["run"]).first()
    assert a["roc_auc"] == b["roc_auc"]
    first = splits.stratified_folds(df, 5, "label", ["account_id"])
    again = splits.stratified_folds(df.repartition(7), 5, "label", ["account_id"])
    pairs = lambda d: {(r["account_id"], r["fold"]) for r in d.collect()}
    assert pairs(first) == pairs(again)
    counts = [r["count"] for r in first.groupBy("label", "fold").count().orderBy("label").collect()]
    assert max(counts) - min(counts) <= abs(int((y == 0).sum()) - int((y == 1).sum())) // 5 + 2


def test_row_numbers_are_a_permutation(spark):
    got = row_numbers(spark.range(500), [], ["id"], 1, digits=2)
    assert sorted(r["rn"] for r in got.collect()) == list(range(500))


def test_binned_bootstrap_agrees_with_row_bootstrap(spark):
    rng = np.random.default_rng(4)
    s = np.round(rng.random(400), 2)
    y = (rng.random(400) < s).astype(int)
    df = frame(spark, s, y)
    a = splits.bootstrap_interval(splits.bootstrap_precision(df, ["account_id"], 200)).first()
    b = splits.bootstrap_interval(splits.bootstrap_precision_binned(df, 200)).first()
    for name in ("mean", "ci_lo", "ci_hi"):
        assert a[name] == pytest.approx(b[name], abs=0.03)
    again = splits.bootstrap_interval(splits.bootstrap_precision_binned(df.repartition(3), 200)).first()
    assert again["mean"] == pytest.approx(b["mean"])


@pytest.mark.parametrize("shape", ["times", "mixed", "ties", "infinite"])
def test_quantiles_of_narrow_columns_are_split(spark, shape, monkeypatch):
    from ringwatch.operators import running

    rng = np.random.default_rng(8)
    n = 4_000
    values = {
        "times": 1.7e12 + rng.integers(0, 86_400_000, n),
        "mixed": np.concatenate([rng.normal(size=n // 2) * 1e-8 + 5, -rng.pareto(1, n // 2)]),
        "ties": np.where(rng.random(n) < 0.7, 1e9, 1e9 + rng.integers(0, 50, n)),
        "infinite": np.concatenate([rng.normal(size=n - 2), [1e300, -1e300]]),
    }[shape].astype(float)
    key = rng.integers(0, 2, n)
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(key, values)], "k int, v double")
    sizes = []
    monkeypatch.setattr(running, "join_counted", lambda rows, small, on, join=running.join_counted: sizes.append(small.columns) or join(rows, small, on))
    wanted = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.94, "e": 1.0}
    got = {r["k"]: r for r in exact_quantiles(df, "v", wanted, ["k"], small_bin=30).collect()}
    for k in (0, 1):
        for name, q in wanted.items():
            assert got[k][name] == pytest.approx(np.quantile(values[key == k], q), rel=1e-12, abs=1e-12)
    if shape == "times":
        assert len(sizes) > 1  # it was split at least once


@pytest.mark.parametrize("mean", [0, 1, 3, 20, 21, 400, 30_000])
def test_poisson_draws_have_their_distribution(spark, mean):
    from ringwatch.functions.hashing import poisson, uniform

    n = 2_000 if mean > 1_000 else 8_000
    draws = np.array([r[0] for r in spark.range(n).select(poisson(uniform("p", "id"), F.lit(mean))).collect()])
    if not mean:
        assert not draws.any()
        return
    assert abs(draws.mean() - mean) < 5 * math.sqrt(mean / n) and draws.var() == pytest.approx(mean, rel=0.2)
    for k in range(max(mean - 3, 0), mean + 3):
        p = math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        assert abs((draws == k).mean() - p) < 5 * math.sqrt(p / n) + 1e-3


def test_metrics_rows_need_a_dataset(spark):
    with pytest.raises(ValueError):
        M.metrics_rows(spark.createDataFrame([(1,)], "n int"), " ", [])


def test_poisson_lists_draw_what_single_draws_are(spark):
    from ringwatch.functions.hashing import poisson, poisson_lists, poisson_mode, uniform

    df = spark.createDataFrame([(0, 0), (1, 1), (2, 7), (3, 500), (4, 10**7)], "id int, n long")
    one = {r["id"]: r["k"] for r in df.select("id", poisson(uniform("p", "id"), F.col("n")).alias("k")).collect()}
    lists = df.withColumns({"u": uniform("p", "id"), "mode": poisson_mode(F.col("n"))}).groupBy().agg(
        *[F.transform(F.array_sort(F.collect_list(F.struct("id", F.col(c).alias("v")))), lambda s: s["v"]).alias(c) for c in ("u", "n", "mode")]
    )
    assert lists.select(poisson_lists(F.col("u"), F.col("n"), F.col("mode"))).first()[0] == [one[k] for k in range(5)]
    assert one[0] == 0 and abs(one[4] - 10**7) < 5 * 10**3.5


def test_binned_bootstrap_takes_no_steps_per_deviation_in_the_plan(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0)], "score double, label int")
    plan = splits.bootstrap_precision_binned(df, 3)._jdf.queryExecution().toString()
    assert "sequence" not in plan


def test_bootstrap_interval_draws_replicates_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        made.add(1)
        return float(i)

    replicated = spark.range(0, 20, 1, 2).select(value("id").alias("average_precision"))
    assert splits.bootstrap_interval(replicated).first()["mean"] == 9.5
    assert made.value == 20


def test_spread_parts_are_bounded(spark):
    from ringwatch.plans.bindings import spread

    assert spread(spark.range(1000), part_rows=50).rdd.getNumPartitions() == 20
    assert spread(spark.range(10), part_rows=50).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
