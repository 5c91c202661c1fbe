import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry_point
from ringwatch.operators import anomaly, explain, robustness
from ringwatch.operators import metrics as M
from ringwatch.operators import models as L
from ringwatch.operators.splits import stratified_folds
from ringwatch.sources import casestore, readers, writers

FEATURES = ["x", "z", "w"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x, z, w = rng.normal(size=600), rng.normal(size=600), rng.normal(size=600)
    y = (x + 0.5 * z + rng.normal(scale=0.4, size=600) > 1.2).astype(int)
    data = [(i, int(y[i]), float(x[i]), float(z[i]), None if i % 50 == 0 else float(w[i])) for i in range(600)]
    return spark.createDataFrame(data, "account_id bigint, label int, x double, z double, w double").cache()


def test_out_of_fold_scores_every_row_once(rows):
    folded = stratified_folds(rows, 3, "label", ["account_id"])
    out = L.out_of_fold(folded, FEATURES, lambda: L.boosted_trees(5, 3), 3)
    assert out.count() == 600 == out.select("account_id").distinct().count()
    m = M.rank_metrics(out, []).first()
    assert m["roc_auc"] > 0.85
    means = {r["label"]: r["m"] for r in out.groupBy("label").agg(F.avg("score").alias("m")).collect()}
    assert means[1] > means[0]


def test_calibrated_model_round_trip(rows, tmp_path):
    model = L.Calibrated.fit(rows, FEATURES, L.logistic, k=2, scale=True)
    a = model.score(rows).select("account_id", "score").orderBy("account_id").collect()
    model.save(str(tmp_path))
    b = L.Calibrated.load(str(tmp_path), FEATURES).score(rows).select("account_id", "score").orderBy("account_id").collect()
    assert a == b
    rate = rows.agg(F.avg("label")).first()[0]
    assert np.mean([r["score"] for r in a]) == pytest.approx(rate, abs=0.05)


def test_linear_contributions_add_up_to_the_margin(rows):
    model = L.fit(rows, FEATURES, L.logistic(), scale=True)
    parts = explain.linear_contributions(rows, FEATURES, model, "account_id")
    total = {r["account_id"]: r["t"] for r in parts.groupBy("account_id").agg(F.sum("contribution").alias("t")).collect()}
    b = model.stages[-1].intercept
    for r in L.score(model, rows, FEATURES).collect():
        assert np.log(r["score"] / (1 - r["score"])) == pytest.approx(total[r["account_id"]] + b, abs=1e-6)


def test_tree_contributions_add_up(rows):
    model = L.fit(rows, FEATURES, L.boosted_trees(4, 3))
    parts = explain.tree_contributions(rows, FEATURES, model, "account_id")
    total = {r["account_id"]: r["t"] for r in parts.groupBy("account_id").agg(F.sum("contribution").alias("t")).collect()}
    offsets = set()
    for r in L.score(model, rows, FEATURES).collect():
        margin = np.log(r["score"] / (1 - r["score"])) / 2
        offsets.add(round(margin - total[r["account_id"]], 6))
    assert len(offsets) == 1  # the mean of the roots


def test_drivers_alerts_and_reports(rows):
    model = L.fit(rows, FEATURES, L.logistic(), scale=True)
    scored = L.score(model, rows, FEATURES)
    drivers = explain.top_drivers(explain.linear_contributions(rows, FEATURES, model, "account_id"), "account_id", 2)
    assert drivers.count() == 1200
    alerts = explain.alert_records(scored, drivers, "account_id").collect()
    assert len(alerts) == scored.where("score >= 0.5").count()
    assert all(d["contribution"] > 0 for a in alerts for d in a["top_drivers"] or [])
    text = explain.reports(scored.withColumn("n_missing", F.lit(0)), drivers, "account_id", 3).first()["report"]
    assert "INVESTIGATION REPORT" in text and "Risk Score" in text


def test_bagging_scores_all_rows(rows):
    out = L.bagged_unlabelled(rows, FEATURES, bags=3)
    assert out.count() == 600 and M.rank_metrics(out, []).first()["roc_auc"] > 0.75


def test_bags_grow_like_a_plain_tree(spark):
    from ringwatch.operators import bagged

    rng = np.random.default_rng(6)
    x = rng.integers(0, 20, size=(900, 3)).astype(float)
    y = ((x[:, 0] > 11) & (x[:, 1] < 7) | (rng.random(900) < 0.05)).astype(int)
    df = spark.createDataFrame([(i, int(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x))], "account_id int, label int, a double, b double, c double")
    rows = bagged.binned(df, ["a", "b", "c"], "label", "account_id")
    bags = bagged.Bags(3, 0.5, 7)
    trees = bagged.grow(rows.repartition(5), bags, 3, "label", 3)
    table = rows.orderBy("account_id").toPandas()
    bins, names, label = table[["b0", "b1", "b2"]].to_numpy(), table["name"].to_numpy().view(np.uint64), table["label"].to_numpy()

    def plain(at, depth):
        """Leaf values of the rows `at` by the best cuts found by trying all."""
        best, n, p = (1e-12, None), len(at), label[at].sum()
        spread = lambda part: 2.0 * label[part].sum() * (len(part) - label[part].sum()) / len(part)
        for f in range(3):
            for cut in range(32):
                left, right = at[bins[at, f] <= cut], at[bins[at, f] > cut]
                if len(left) and len(right):
                    gain = spread(at) - spread(left) - spread(right)
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
        if depth == 3 or best[1] is None:
            return {int(i): p / n for i in at}
        return plain(best[1][0], depth + 1) | plain(best[1][1], depth + 1)

    for bag in range(3):
        held = np.flatnonzero(bags.held(names, label, bag))
        assert 0.45 < label[held].sum() / label.sum() < 0.65  # four fifths of two thirds
        want = plain(held, 0)
        got = trees.value[bag, trees.walk(bag, bins[held], 3)]
        assert got == pytest.approx([want[int(i)] for i in held])


def test_isolation_forest_finds_outliers(spark):
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal(size=(400, 2)), [[9.0, 9.0], [-8.0, 9.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id bigint, a double, b double")
    out = anomaly.anomaly_scores(df, ["a", "b"], "id", trees=40)
    top = [r["id"] for r in out.orderBy(F.desc("raw")).limit(2).collect()]
    assert set(top) == {400, 401}
    again = anomaly.anomaly_scores(df.repartition(5), ["a", "b"], "id", trees=40)
    assert {(r["id"], round(r["raw"], 9)) for r in out.collect()} == {(r["id"], round(r["raw"], 9)) for r in again.collect()}


def test_robustness_levels(rows):
    model = L.fit(rows, FEATURES, L.logistic(), scale=True)
    got = {(r["kind"], r["level"]): r["average_precision"] for r in robustness.robustness(
        model, rows, FEATURES, ["x", "z"], "account_id", noise=[0.0, 2.0], dropout=[0.0]).collect()}
    assert got[("noise", 0.0)] == pytest.approx(got[("dropout", 0.0)])
    assert got[("noise", 2.0)] < got[("noise", 0.0)]


def test_case_store(spark, tmp_path):
    path = str(tmp_path / "cases")
    base = "account bigint, score int, band string, probability double, threshold double, decision string, time_utc timestamp"
    import datetime as dt

    day = dt.datetime(2024, 5, 1, 10)
    casestore.append(spark.createDataFrame([(1, 90, "CRITICAL", 0.91237, 0.5, "ALERT", day)], base), path, "s1")
    casestore.append(spark.createDataFrame([(2, 10, "LOW", 0.1, 0.5, "clear", day + dt.timedelta(days=1))], base), path, "s2")
    newest = casestore.newest_first(spark, path).collect()
    assert [r["account"] for r in newest] == [2, 1] and casestore.count(spark, path) == 2
    assert newest[1]["probability"] == 0.9124 and newest[1]["ring"] == "—" and newest[1]["action"] == "reviewed"


def test_csv_parquet_json_round_trips(spark, tmp_path):
    csv = str(tmp_path / "snap")
    spark.createDataFrame([(7, 1.5, "a", 1)], "idx int, F1 double, F2 string, F3924 int").write.option("header", True).csv(csv)
    snap = readers.read_snapshot(spark, csv)
    assert snap.columns == ["account_id", "F1", "F2", "F3924"] and snap.schema["F3924"].dataType == T.IntegerType()
    again = readers.read_csv(spark, csv, readers.load_schema(readers.save_schema(snap)))
    assert again.first()["F1"] == 1.5
    scored = M.with_score_and_band(spark.createDataFrame([(1, 0.95, 1)], "account_id int, score double, label int"))
    writers.write_predictions(writers.predictions(scored, "demo"), str(tmp_path / "p"))
    back = readers.read_matrix(spark, str(tmp_path / "p")).first()
    assert (back["band"], back["dataset"], back["risk_score"]) == ("CRITICAL", "demo", 95)
    writers.write_list(scored, str(tmp_path / "w"), [F.desc("risk_score")])
    writers.write_metrics(M.metrics_rows(spark.createDataFrame([(3.0,)], "ap double"), "demo", []), str(tmp_path / "m"))
    assert readers.read_metrics(spark, str(tmp_path / "m")).first()["value"] == 3.0


def test_money_flow_files(spark, tmp_path):
    for name, rows, cols in (
        ("accounts", [(1, "true")], ["ACCOUNT_ID", "IS_FRAUD"]),
        ("alerts", [(5, "cycle", 1, 2, 9.5)], ["ALERT_ID", "ALERT_TYPE", "SENDER_ACCOUNT_ID", "RECEIVER_ACCOUNT_ID", "TX_AMOUNT"]),
        ("transactions", [(1, 2, "True")], ["SENDER_ACCOUNT_ID", "RECEIVER_ACCOUNT_ID", "IS_FRAUD"]),
    ):
        spark.createDataFrame(rows, cols).write.option("header", True).csv(str(tmp_path / f"{name}.csv"))
    sets = readers.read_money_flows(spark, str(tmp_path))
    assert sets["alerts"].first()["amount"] == 9.5 and sets["transactions"].count() == 1


@pytest.mark.parametrize("name", ["sim_cut", "bootstrap_binned", "typology_clusters", "population_model_scores", "reasons"])
def test_rows_only_queries_run(name, spark, sf_dir):
    assert entry_point.queries()[name](spark, sf_dir).count() > 0


def test_holdout_makes_its_rows_once(spark, rows):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(x):
        made.add(1)
        return x

    L.holdout_evaluation(rows.withColumn("x", value("x")), ["x", "z"], lambda: L.logistic(max_iter=5), scale=True)
    assert made.value <= 600


def test_random_search_fills_the_cores_with_fits_of_few_parts(spark, monkeypatch):
    rows = [(i, i % 2, float(i % 7), int(i % 5 == 0)) for i in range(60)]
    folded = spark.createDataFrame(rows, "account_id long, fold int, x double, label int").coalesce(1)
    seen, side_by_side = [], L.side_by_side

    def at_most(tasks, at_once=4):
        seen.append(at_once)
        return side_by_side(tasks[:2], at_once)

    monkeypatch.setattr(L, "side_by_side", at_most)
    L.random_search(folded, ["x"], 2, draws=1)
    assert seen == [max(4, spark.sparkContext.defaultParallelism)]
