"""Queries that train models; their results follow from Spark ML, so rows are checked, not values."""

from pyspark.sql import functions as F

from ringwatch.operators import anomaly, explain, hygiene, robustness
from ringwatch.operators import metrics as M
from ringwatch.operators import models as L
from ringwatch.operators.splits import stratified_folds
from ringwatch.plans import bindings as B
from ringwatch.plans.registry import query, rounded
from ringwatch.session import cut_lineage

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def small_trees():
    return L.boosted_trees(rounds=8, depth=4)


def _rows(spark, sf):
    return B.audit_matrix(spark, sf).select("account_id", "label", *FEATURES)


def _folded(spark, sf, k=3):
    return stratified_folds(_rows(spark, sf), k, "label", ["account_id"])


@query("oof_scores")
def oof_scores(spark, sf):
    return L.out_of_fold(_folded(spark, sf), FEATURES, small_trees, 3).select("account_id", "fold", "label", "score")


@query("oof_calibrated")
def oof_calibrated(spark, sf):
    scored = L.out_of_fold(_folded(spark, sf, 2), FEATURES, L.logistic, 2, scale=True, calibrate=True)
    return scored.select("account_id", "label", "score")


@query("model_leaderboard")
def model_leaderboard(spark, sf):
    learners = {
        "boosted": (small_trees, False),
        "forest": (lambda: L.forest(trees=10, depth=6), False),
        "logistic": (L.logistic, True),
    }
    per_fold = L.compare_models(_folded(spark, sf, 2), FEATURES, learners, 2)
    return M.leaderboard(M.fold_interval(per_fold, ["model"], "average_precision"), "mean")


@query("holdout_metrics")
def holdout_metrics(spark, sf):
    metrics, _, _ = L.holdout_evaluation(_rows(spark, sf), FEATURES, L.logistic, scale=True)
    return M.metrics_rows(metrics, "sample", [])


@query("stacked_scores")
def stacked_scores(spark, sf):
    folded = _folded(spark, sf, 2)
    parts = [
        L.out_of_fold(folded, FEATURES, learner, 2, scale).select(
            "account_id", "label", "score", F.lit(name).alias("model")
        )
        for name, learner, scale in (("boosted", small_trees, False), ("logistic", L.logistic, True))
    ]
    return L.stacked(parts[0].unionByName(parts[1]), "account_id", ["boosted", "logistic"], 2)


@query("random_search")
def random_search(spark, sf):
    return L.random_search(_folded(spark, sf, 2), FEATURES, 2)


@query("feature_importance")
def feature_importance(spark, sf):
    model = L.fit(_rows(spark, sf), FEATURES, small_trees())
    return spark.createDataFrame(L.feature_importance(model, FEATURES), "feature string, importance double")


def _logistic_scored(spark, sf):
    rows = _rows(spark, sf)
    model = L.fit(rows, FEATURES, L.logistic(), scale=True)
    return rows, model, L.score(model, rows, FEATURES)


@query("population_model_scores")
def population_model_scores(spark, sf):
    _, _, scored = _logistic_scored(spark, sf)
    return M.with_score_and_band(scored).select("account_id", "label", "score", "risk_score", "band")


@query("reasons")
def reasons(spark, sf):
    rows, model, _ = _logistic_scored(spark, sf)
    stats = hygiene.class_stats(rows, FEATURES, "label")
    return explain.top_drivers(explain.linear_drivers(rows, explain.linear_table(FEATURES, model), "account_id"), "account_id", stats=stats)


#: a fixed model: feature, median, mean, deviation, coefficient
FIXED_MODEL = [
    ("l_quantity", 25.0, 25.5, 14.4, 0.8),
    ("l_discount", 0.05, 0.05, 0.0316, -1.1),
    ("l_tax", 0.04, 0.04, 0.0258, 0.3),
    ("l_extendedprice", 30000.0, 38000.0, 23000.0, 0.55),
]


@query("fixed_model_drivers", """WITH l AS (SELECT *, row_number() OVER () AS rid FROM lineitem), c AS (SELECT rid, l_orderkey * 8 + l_linenumber AS id, unnest([
  {'f': 'l_quantity', 'v': l_quantity::DOUBLE, 'c': (l_quantity::DOUBLE - 25.5) / 14.4::DOUBLE * 0.8::DOUBLE},
  {'f': 'l_discount', 'v': l_discount::DOUBLE, 'c': (l_discount::DOUBLE - 0.05) / 0.0316::DOUBLE * (-1.1)::DOUBLE},
  {'f': 'l_tax', 'v': l_tax::DOUBLE, 'c': (l_tax::DOUBLE - 0.04) / 0.0258::DOUBLE * 0.3::DOUBLE},
  {'f': 'l_extendedprice', 'v': l_extendedprice::DOUBLE, 'c': (l_extendedprice::DOUBLE - 38000) / 23000::DOUBLE * 0.55::DOUBLE}]) AS d FROM l),
r AS (SELECT id, d.f AS f, d.v AS v, d.c AS c, row_number() OVER (PARTITION BY rid ORDER BY abs(d.c) DESC, d.f) AS rank FROM c)
SELECT id, rank::INT AS rank, f AS feature, v AS value, c + 0.0 AS contribution FROM r WHERE rank <= 3""")
def fixed_model_drivers(spark, sf):
    rows = B.table(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    # the same operations in the same order give the same doubles, so nothing is rounded
    return explain.linear_drivers(rows, FIXED_MODEL, "id", 3).withColumn("contribution", F.col("contribution") + F.lit(0.0))


@query("tree_reasons")
def tree_reasons(spark, sf):
    rows = _rows(spark, sf)
    model = L.fit(rows, FEATURES, small_trees())
    return explain.top_drivers(explain.tree_contributions(rows, FEATURES, model, "account_id", 6), "account_id")


@query("alert_records")
def alert_records(spark, sf):
    rows, model, scored = _logistic_scored(spark, sf)
    drivers = explain.top_drivers(explain.linear_drivers(rows, explain.linear_table(FEATURES, model), "account_id"), "account_id")
    return explain.alert_records(scored, drivers, "account_id").withColumn(
        "top_drivers", F.to_json("top_drivers")
    )


@query("watchlist_reasons")
def watchlist_reasons(spark, sf):
    rows, model, scored = _logistic_scored(spark, sf)
    top = cut_lineage(M.watchlist(M.with_score_and_band(scored), 50))
    listed = rows.join(F.broadcast(top.select("account_id")), "account_id", "left_semi")  # 50 ids
    drivers = explain.top_drivers(explain.linear_drivers(listed, explain.linear_table(FEATURES, model), "account_id"), "account_id")
    return explain.watchlist_reasons(top, drivers, "account_id").select(
        "account_id", "risk_score", "band", "label", "top_reasons"
    )


@query("investigation_reports")
def investigation_reports(spark, sf):
    rows, model, scored = _logistic_scored(spark, sf)
    flagged = hygiene.row_counts(scored.where("score >= 0.9"), FEATURES)
    listed = rows.join(flagged.select("account_id"), "account_id", "left_semi")
    drivers = explain.top_drivers(explain.linear_drivers(listed, explain.linear_table(FEATURES, model), "account_id"), "account_id")
    return explain.reports(flagged, drivers, "account_id", len(FEATURES))


@query("typology_clusters")
def typology_clusters(spark, sf):
    _, ranking = L.typology_clusters(_rows(spark, sf), FEATURES)
    return ranking


@query("anomaly_scores")
def anomaly_scores(spark, sf):
    return anomaly.anomaly_scores(_rows(spark, sf), FEATURES, "account_id")


@query("anomaly_hybrid")
def anomaly_hybrid(spark, sf):
    _, _, scored = _logistic_scored(spark, sf)
    mixed = anomaly.hybrid(
        anomaly.anomaly_scores(scored, FEATURES, "account_id", keep=["label", "score"])
    )
    parts = [mixed.select(F.lit(n).alias("model"), "label", F.col(n).alias("score")) for n in ("score", "anomaly", "hybrid")]
    metrics = M.rank_metrics(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["model"])
    return metrics.select("model", "average_precision", "roc_auc")


@query("missed_in_anomaly", """WITH s AS (SELECT l_extendedprice AS a, l_quantity / 50.0::DOUBLE AS p, (l_returnflag = 'R')::INT AS y FROM lineitem),
h AS (SELECT a, count(*) AS n FROM s GROUP BY 1), r AS (SELECT a, (sum(n) OVER (ORDER BY a) - n + (n + 1) / 2.0::DOUBLE) / sum(n) OVER () AS k FROM h)
SELECT count(*) AS n_missed, round(avg(k), 6) AS mean_rank_share FROM s JOIN r USING (a) WHERE y = 1 AND p < 0.05""")
def missed_in_anomaly(spark, sf):
    rows = B.table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("anomaly"), (F.col("l_quantity") / 50.0).alias("score"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )
    return rounded(anomaly.missed_in_anomaly_ranking(rows), 6, "mean_rank_share")


@query("bagged_unlabelled")
def bagged_unlabelled(spark, sf):
    return L.bagged_unlabelled(_rows(spark, sf), FEATURES)


@query("robustness")
def robustness_levels(spark, sf):
    folded = cut_lineage(_folded(spark, sf, 2))
    noisy = ["l_quantity", "l_extendedprice"]
    spread = robustness.spreads(folded, noisy)
    parts = []
    for fold in (0, 1):
        model = L.fit(folded.where(F.col("fold") != fold), FEATURES, L.logistic(), scale=True)
        held_out = folded.where(F.col("fold") == fold)
        parts.append(robustness.perturbed_scores(model, held_out, FEATURES, noisy, "account_id", spread=spread))
    return robustness.pooled_robustness(parts).select("kind", "level", "average_precision", "roc_auc")
