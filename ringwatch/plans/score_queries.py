"""Queries on scored runs: metrics, curves, policies, splits, bootstrap."""

from pyspark.sql import functions as F

from ringwatch import constants as K
from ringwatch.functions import policy as P
from ringwatch.operators import metrics as M
from ringwatch.operators import policy, splits
from ringwatch.operators.running import mid_ranks, row_numbers
from ringwatch.plans import bindings as B
from ringwatch.plans import oracles as O
from ringwatch.plans.registry import query, rounded

RUN = ["run"]


@query("rank_metrics", f"""WITH {O.CURVE},
neg AS (SELECT run, score, n, pos, tp, alerts, n_pos, n_rows, n_rows - n_pos AS n_neg,
          (n_rows - n_pos) - (alerts - tp) AS below FROM curve),
m AS (SELECT run, sum(pos::DOUBLE / n_pos * (tp::DOUBLE / alerts)) AS average_precision,
        sum(pos::DOUBLE * (below + (n - pos) / 2.0::DOUBLE)) / (max(n_pos)::DOUBLE * max(n_neg)::DOUBLE) AS roc_auc,
        coalesce(max(tp::DOUBLE / n_pos) FILTER (tp::DOUBLE / alerts >= 0.5), 0) AS recall_at_half_precision,
        max(n_rows)::BIGINT AS n_rows, max(n_pos)::BIGINT AS n_pos FROM neg GROUP BY 1),
b AS (SELECT run, avg((score - label) * (score - label)) AS brier, avg(label::DOUBLE) AS prevalence FROM runs GROUP BY 1)
SELECT run, round(average_precision, 8) AS average_precision, round(roc_auc, 8) AS roc_auc, round(brier, 8) AS brier,
  prevalence, recall_at_half_precision, n_rows, n_pos
FROM m JOIN b USING (run)""")
def rank_metrics(spark, sf):
    out = M.rank_metrics(B.score_runs(spark, sf), RUN)
    return rounded(out, 8, "average_precision", "roc_auc", "brier")


@query("pr_curve", f"""WITH {O.CURVE}
SELECT run, score AS threshold, tp::DOUBLE / alerts AS precision, tp::DOUBLE / n_pos AS recall FROM curve
UNION ALL SELECT DISTINCT run, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM runs""")
def pr_curve(spark, sf):
    return M.pr_points(B.score_runs(spark, sf), RUN)


@query("roc_curve", f"""WITH {O.CURVE}
SELECT run, score AS threshold, (alerts - tp)::DOUBLE / (n_rows - n_pos) AS fpr, tp::DOUBLE / n_pos AS tpr
FROM curve UNION ALL SELECT DISTINCT run, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM runs""")
def roc_curve(spark, sf):
    return M.roc_points(B.score_runs(spark, sf), RUN)


_TABLE = "SELECT run, threshold, alerts, caught, false_alarms, precision, recall"


@query("threshold_table", f"WITH {O.threshold_sql(K.PERCENT_GRID)} {_TABLE}, n_pos, n_rows FROM tbl")
def threshold_table(spark, sf):
    return M.threshold_table(B.score_runs(spark, sf), K.PERCENT_GRID, RUN)


@query("dial_table", f"WITH {O.threshold_sql(K.DIAL_GRID)} {_TABLE} FROM tbl")
def dial_table(spark, sf):
    return M.threshold_table(B.score_runs(spark, sf), K.DIAL_GRID, RUN).drop("n_pos", "n_rows")


def _recall_sql(grid, targets):
    wanted = ", ".join(f"({t}::DOUBLE)" for t in targets)
    return f"""WITH {O.threshold_sql(grid)},
q AS (SELECT * FROM (VALUES {wanted}) AS v(target_recall)),
best AS (SELECT run, target_recall, max(threshold) FILTER (recall >= target_recall) AS threshold, max(recall) AS max_recall
         FROM tbl CROSS JOIN q GROUP BY 1, 2)
SELECT b.run, target_recall, b.threshold IS NOT NULL AS achievable, b.threshold, t.precision,
  t.recall AS achieved_recall, t.false_alarms, t.alerts, max_recall
FROM best b LEFT JOIN tbl t ON t.run = b.run AND t.threshold = b.threshold"""


@query("recall_point", _recall_sql(K.RECALL_GRID, [K.RECALL_TARGET]))
def recall_point(spark, sf):
    table = M.threshold_table(B.score_runs(spark, sf), K.RECALL_GRID, RUN)
    return M.recall_points(table, [K.RECALL_TARGET], RUN)


@query("recall_ladder", _recall_sql(K.PERCENT_GRID, K.RECALL_LADDER))
def recall_ladder(spark, sf):
    table = M.threshold_table(B.score_runs(spark, sf), K.PERCENT_GRID, RUN)
    return M.recall_points(table, K.RECALL_LADDER, RUN)


@query("confusion", f"""WITH {O.RUNS},
c AS (SELECT run, count(*) FILTER (score >= 0.7 AND label = 1) AS tp, count(*) FILTER (score >= 0.7 AND label = 0) AS fp,
        count(*) FILTER (score < 0.7 AND label = 1) AS fn, count(*) FILTER (score < 0.7 AND label = 0) AS tn FROM runs GROUP BY 1)
SELECT run, tp, fp, fn, tn, tp + fp AS alerts, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
  coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, tp * 250000 - (tp + fp) * 400 - fp * 5000 AS net_value FROM c""")
def confusion(spark, sf):
    return M.confusion(B.score_runs(spark, sf), 0.7, RUN)


@query("calibration", f"""WITH {O.RUNS},
e AS (SELECT run, quantile_cont(score, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS e FROM runs GROUP BY 1)
SELECT run, len(list_filter(e, lambda x: x < score))::INT AS bin, count(*) AS n, round(avg(score), 8) AS mean_score,
  avg(label::DOUBLE) AS positive_rate FROM runs JOIN e USING (run) GROUP BY 1, 2""")
def calibration(spark, sf):
    return rounded(M.calibration_table(B.score_runs(spark, sf), 8, RUN), 8, "mean_score")


_BANDED = """,
banded AS (SELECT *, round_even(100 * score, 0)::INT AS risk_score FROM runs),
bands AS (SELECT *, CASE WHEN risk_score >= 90 THEN 'CRITICAL' WHEN risk_score >= 70 THEN 'HIGH'
   WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM banded)"""


@query("population_scores", f"""WITH {O.RUNS} {_BANDED}
SELECT run, account_id, risk_score, band, CASE WHEN score >= 0.8 THEN 'CONFIDENT-MULE' WHEN score <= 0.2 THEN 'CONFIDENT-LEGIT'
  ELSE 'UNCERTAIN' END AS confidence_tier, CASE band WHEN 'CRITICAL' THEN
  'Freeze outbound transfers immediately; escalate to L2 fraud unit; file internal SAR review.'
  WHEN 'HIGH' THEN 'Hold high-value outbound transactions; assign to analyst for same-day review.'
  WHEN 'MEDIUM' THEN 'Add to enhanced-monitoring watchlist; review on next cycle.'
  ELSE 'No action; routine monitoring.' END AS recommended_action,
  CASE WHEN label = 1 THEN 'MULE' ELSE 'legit' END AS ground_truth FROM bands""")
def population_scores(spark, sf):
    scored = M.with_score_and_band(B.score_runs(spark, sf))
    return scored.select(
        "run", "account_id", "risk_score", "band",
        P.confidence_tier(F.col("score"), 0.2, 0.8).alias("confidence_tier"),
        P.band_action(F.col("band")).alias("recommended_action"),
        P.ground_truth(F.col("label")).alias("ground_truth"),
    )


@query("verdicts", f"""WITH {O.RUNS} {_BANDED}, v AS (SELECT *, round_even(100 * score, 0)::INT || '%' AS s FROM bands)
SELECT run, CASE WHEN band IN ('CRITICAL', 'HIGH') THEN CASE WHEN score >= 0.9 THEN 'High' ELSE 'Elevated' END || ' confidence (' || s
  || ') this account behaves like a mule; recommend ' || CASE band WHEN 'CRITICAL' THEN 'escalate to L2' ELSE 'same-day analyst review' END
  WHEN band = 'MEDIUM' THEN 'Mixed signals (' || s || '); add to enhanced monitoring' ELSE 'Low risk (' || s || '); routine monitoring' END
  AS verdict, count(*) AS n FROM v GROUP BY 1, 2""")
def verdicts(spark, sf):
    scored = M.with_score_and_band(B.score_runs(spark, sf))
    text = P.verdict(F.col("band"), F.col("score")).alias("verdict")
    return scored.groupBy("run", text).agg(F.count(F.lit(1)).alias("n"))


@query("score_hist", f"""WITH {O.RUNS} {_BANDED}
SELECT run, (risk_score // 10 * 10)::INT AS score_bucket, count(*) FILTER (label = 1) AS mule, count(*) FILTER (label = 0) AS legit
FROM bands GROUP BY 1, 2""")
def score_hist(spark, sf):
    return M.score_buckets(M.with_score_and_band(B.score_runs(spark, sf)), RUN)


@query("band_table", f"""WITH {O.RUNS} {_BANDED}, o AS (SELECT * FROM (VALUES (0, 'LOW'), (1, 'MEDIUM'), (2, 'HIGH'), (3, 'CRITICAL')) AS v(band_order, band)),
r AS (SELECT DISTINCT run FROM runs)
SELECT r.run, o.band_order, o.band, count(*) FILTER (label = 1) AS mule, count(*) FILTER (label = 0) AS legit
FROM r CROSS JOIN o LEFT JOIN bands b ON b.run = r.run AND b.band = o.band GROUP BY ALL""")
def band_table(spark, sf):
    return M.band_table(M.with_score_and_band(B.score_runs(spark, sf)), RUN)


@query("score_percentiles", f"""WITH {O.RUNS} {_BANDED}
SELECT run, round(quantile_cont(risk_score::DOUBLE, 0.1), 6) AS p10, round(quantile_cont(risk_score::DOUBLE, 0.25), 6) AS p25,
  round(quantile_cont(risk_score::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(risk_score::DOUBLE, 0.75), 6) AS p75,
  round(quantile_cont(risk_score::DOUBLE, 0.9), 6) AS p90, avg((risk_score >= 70)::INT::DOUBLE) AS share_high
FROM bands WHERE label = 1 GROUP BY 1""")
def score_percentiles(spark, sf):
    q = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    out = M.positive_score_percentiles(M.with_score_and_band(B.score_runs(spark, sf)), q, RUN)
    return rounded(out, 6, *q)


@query("watchlist", f"""WITH {O.RARE} SELECT account_id, score, label FROM rare ORDER BY score DESC, account_id LIMIT 50""")
def watchlist(spark, sf):
    return M.watchlist(B.rare_run(spark, sf), 50, "score").select("account_id", "score", "label")


@query("precision_at_k", f"""WITH {O.RARE}, t AS (SELECT * FROM rare ORDER BY score DESC, account_id LIMIT 50)
SELECT count(*) AS k, sum(label)::BIGINT AS hits, avg(label::DOUBLE) AS precision FROM t""")
def precision_at_k(spark, sf):
    return M.precision_at_k(B.rare_run(spark, sf), 50, "score", "account_id")


@query("alert_list", f"WITH {O.RARE} SELECT account_id, score, label FROM rare WHERE score >= 0.9")
def alert_list(spark, sf):
    return M.alert_list(B.rare_run(spark, sf), 0.9).select("account_id", "score", "label")


@query("percentile_ranks", f"""WITH {O.RUNS}, h AS (SELECT run, score, count(*) AS n FROM runs GROUP BY 1, 2)
SELECT run, score, n, (sum(n) OVER (PARTITION BY run ORDER BY score) - n + (n + 1) / 2.0::DOUBLE)
  / sum(n) OVER (PARTITION BY run) AS rank_share FROM h""")
def percentile_ranks(spark, sf):
    return mid_ranks(B.score_runs(spark, sf), "score", RUN)


@query("cost_curve", f"""WITH {O.threshold_sql(K.COST_GRID)} {_TABLE}, n_pos, n_rows,
  caught * 250000 - alerts * 400 - false_alarms * 5000 AS net_savings FROM tbl""")
def cost_curve(spark, sf):
    return policy.cost_curve(B.score_runs(spark, sf), RUN)


@query("cost_best", f"""WITH {O.threshold_sql(K.COST_GRID)},
c AS (SELECT *, caught * 250000 - alerts * 400 - false_alarms * 5000 AS net_savings FROM tbl),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY net_savings DESC, threshold) AS k FROM c)
SELECT run, threshold, alerts, caught, recall, net_savings, n_pos - caught AS missed FROM r WHERE k = 1""")
def cost_best(spark, sf):
    return policy.best_operating_point(policy.cost_curve(B.score_runs(spark, sf), RUN), RUN)


_ABSTAIN = f"""{O.RUNS},
g AS (SELECT DISTINCT run, round_even(score, 4) AS t FROM runs),
hh AS (SELECT run, score, count(*) AS n, sum(label) AS pos FROM runs GROUP BY 1, 2),
z AS (SELECT g.run, t, sum(pos) FILTER (score >= t) AS up_pos, sum(n) FILTER (score >= t) AS up_n,
        sum(n - pos) FILTER (score <= t) AS lo_neg, sum(n) FILTER (score <= t) AS lo_n
      FROM g JOIN hh ON hh.run = g.run GROUP BY 1, 2),
f AS (SELECT run, coalesce(min(t) FILTER (up_pos::DOUBLE / up_n >= %s), 1.0) AS hi,
        coalesce(max(t) FILTER (lo_neg::DOUBLE / lo_n >= %s), 0.0) AS lo FROM z GROUP BY 1),
th AS (SELECT run, CASE WHEN lo >= hi THEN 0.1::DOUBLE ELSE lo::DOUBLE END AS t_lo, CASE WHEN lo >= hi THEN 0.9::DOUBLE ELSE hi::DOUBLE END AS t_hi FROM f)
"""


@query("abstention_thresholds", "WITH " + _ABSTAIN % ("0.95", "0.999") + " SELECT * FROM th")
def abstention_thresholds(spark, sf):
    return policy.abstention_thresholds(B.score_runs(spark, sf), RUN)


@query("abstention", "WITH " + _ABSTAIN % ("0.4", "0.7") + """,
x AS (SELECT r.*, t_lo, t_hi, score >= t_hi AS s, score <= t_lo AS c FROM runs r JOIN th USING (run)),
a AS (SELECT run, t_lo, t_hi, count(*) AS n, count(*) FILTER (s OR c) AS n_auto, count(*) FILTER (NOT s AND NOT c) AS n_uncertain,
  count(*) FILTER ((s AND label = 0) OR (c AND label = 1)) AS auto_zone_errors,
  count(*) FILTER (NOT s AND NOT c AND label = 1) AS mules_routed_to_review,
  coalesce(avg(label::DOUBLE) FILTER (s), 0) AS confident_mule_precision,
  coalesce(avg(1.0::DOUBLE - label) FILTER (c), 0) AS confident_legit_npv FROM x GROUP BY 1, 2, 3)
SELECT *, n_auto::DOUBLE / n AS coverage_auto_decided, n_uncertain::DOUBLE / n AS review_rate,
  auto_zone_errors::DOUBLE / greatest(n_auto, 1) AS auto_zone_error_rate FROM a""")
def abstention(spark, sf):
    scores = B.score_runs(spark, sf)
    cuts = policy.abstention_thresholds(scores, RUN, precision=0.4, npv=0.7)
    return policy.abstention_report(scores, cuts, RUN)


@query("graduated_policy", f"""WITH {O.RUNS},
c AS (SELECT run, count(*) FILTER (score >= 0.5) AS naive_freezes, count(*) FILTER (score >= 0.5 AND label = 0) AS naive_wrong_freezes,
  count(*) FILTER (score >= 0.5 AND label = 1) AS naive_mules_frozen, count(*) FILTER (score < 0.5 AND label = 1) AS nm,
  count(*) FILTER (score >= 0.9) AS freezes, count(*) FILTER (score >= 0.9 AND label = 0) AS wrong_freezes,
  count(*) FILTER (score >= 0.9 AND label = 1) AS mules_frozen, count(*) FILTER (score >= 0.3 AND score < 0.9) AS step_ups,
  count(*) FILTER (score >= 0.3 AND score < 0.9 AND label = 1) AS mules_in_step_up,
  count(*) FILTER (score >= 0.3 AND score < 0.9 AND label = 0) AS legit_in_step_up,
  count(*) FILTER (score < 0.3 AND label = 1) AS gm FROM runs GROUP BY 1),
d AS (SELECT *, naive_wrong_freezes * 25000 + nm * 250000 + naive_freezes * 400 AS naive_cost,
  wrong_freezes * 25000 + gm * 250000 + step_ups * 50 + freezes * 400 AS graduated_cost FROM c)
SELECT * EXCLUDE (nm, gm), naive_wrong_freezes - wrong_freezes AS wrong_freezes_avoided, naive_cost - graduated_cost AS cost_reduction FROM d""")
def graduated_policy(spark, sf):
    return policy.graduated_policy(B.score_runs(spark, sf), RUN, 0.3)


@query("capacity", f"""WITH {O.threshold_sql(K.PERCENT_GRID)},
f AS (SELECT run, min(threshold) FILTER (alerts <= 640) AS threshold FROM tbl GROUP BY 1)
SELECT f.run, 640 AS daily_capacity, f.threshold, t.alerts, ceil(t.alerts * 15.0::DOUBLE / 480)::BIGINT AS analyst_days
FROM f LEFT JOIN tbl t ON t.run = f.run AND t.threshold = f.threshold""")
def capacity(spark, sf):
    return policy.capacity_threshold(B.score_runs(spark, sf), RUN)


@query("queue_reduction", f"""WITH {O.RUNS},
c AS (SELECT run, count(*) AS n_accounts, count(*) FILTER (score <= 0.1) AS auto_cleared, count(*) FILTER (score > 0.1) AS priority FROM runs GROUP BY 1)
SELECT *, 1 - priority::DOUBLE / greatest(n_accounts, 1) AS workload_cut FROM c""")
def queue_reduction(spark, sf):
    return policy.queue_reduction(B.score_runs(spark, sf), RUN, 0.1)


_FOLDS = """,
fd AS (SELECT account_id, score, label, ((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || account_id), account_id) - 1) % {k})::INT AS fold FROM rare)"""


@query("folds", f"WITH {O.RARE} {_FOLDS.format(k=5)} SELECT account_id, fold FROM fd")
def folds(spark, sf):
    return splits.stratified_folds(B.rare_run(spark, sf), 5, "label", ["account_id"]).select("account_id", "fold")


@query("folds_repeated", f"""WITH {O.RARE}, c AS (SELECT *, unnest([0, 1]) AS repeat FROM rare)
SELECT repeat, account_id, ((row_number() OVER (PARTITION BY repeat, label ORDER BY md5('42:' || repeat || ':' || account_id), account_id) - 1) % 5)::INT AS fold FROM c""")
def folds_repeated(spark, sf):
    out = splits.repeated_folds(B.rare_run(spark, sf), 5, 2, "label", ["account_id"])
    return out.select("repeat", "account_id", "fold")


@query("holdout", f"WITH {O.RARE} {_FOLDS.format(k=5)} SELECT account_id, fold = 0 AS is_holdout FROM fd")
def holdout(spark, sf):
    return splits.holdout_split(B.rare_run(spark, sf), "label", ["account_id"]).select("account_id", "is_holdout")


_FOLD_METRICS = f"""{O.RARE} {_FOLDS.format(k=10)},
h AS (SELECT fold, score, count(*) AS n, sum(label) AS pos FROM fd GROUP BY 1, 2),
cv AS (SELECT *, sum(n) OVER (PARTITION BY fold ORDER BY score DESC) AS a, sum(pos) OVER (PARTITION BY fold ORDER BY score DESC) AS tp,
  sum(pos) OVER (PARTITION BY fold) AS np FROM h),
ap AS (SELECT fold, sum(pos::DOUBLE / np * (tp::DOUBLE / a)) AS average_precision FROM cv GROUP BY 1)"""


@query("fold_interval", f"""WITH {_FOLD_METRICS}
SELECT count(*) AS n_folds, round(avg(average_precision), 8) AS mean, round(stddev_pop(average_precision), 8) AS std,
  round(avg(average_precision) - 2.262157162740992::DOUBLE * stddev_pop(average_precision) / sqrt(count(*)), 8) AS ci_lo,
  round(avg(average_precision) + 2.262157162740992::DOUBLE * stddev_pop(average_precision) / sqrt(count(*)), 8) AS ci_hi FROM ap""")
def fold_interval(spark, sf):
    dealt = splits.stratified_folds(B.rare_run(spark, sf), 10, "label", ["account_id"])
    per_fold = M.rank_metrics(dealt, ["fold"])
    return rounded(M.fold_interval(per_fold, [], "average_precision"), 8, "mean", "std", "ci_lo", "ci_hi")


_REPEAT_AP = f"""{O.RUNS}, fr AS (SELECT run, score, label, ((row_number() OVER (PARTITION BY run, label ORDER BY md5('42:' || run || ':' || account_id), account_id) - 1) % 5)::INT AS fold FROM runs),
h AS (SELECT run, fold, score, count(*) AS n, sum(label) AS pos FROM fr GROUP BY ALL),
cv AS (SELECT *, sum(n) OVER (PARTITION BY run, fold ORDER BY score DESC) AS a, sum(pos) OVER (PARTITION BY run, fold ORDER BY score DESC) AS tp,
  sum(pos) OVER (PARTITION BY run, fold) AS np FROM h),
ap AS (SELECT run, fold, sum(pos::DOUBLE / np * (tp::DOUBLE / a)) AS average_precision FROM cv GROUP BY ALL),
st AS (SELECT run, avg(average_precision) AS mean, stddev_pop(average_precision) AS std FROM ap GROUP BY 1)"""


def _run_folds(spark, sf):
    numbered = row_numbers(B.score_runs(spark, sf), ["run", "label"], ["run", "account_id"], 42)
    dealt = numbered.withColumn("fold", F.pmod("rn", F.lit(5)).cast("int"))
    return M.rank_metrics(dealt, ["run", "fold"])


@query("challenger", f"""WITH {_REPEAT_AP}
SELECT arg_max(run, mean) AS best_model, round(max(mean), 8) AS best_mean, round(max(mean) FILTER (run = 'price'), 8) AS baseline_mean,
  round(max(std) FILTER (run = 'price'), 8) AS baseline_std,
  max(mean) - max(mean) FILTER (run = 'price') > max(std) FILTER (run = 'price') AS adopt FROM st""")
def challenger(spark, sf):
    out = M.challenger_test(_run_folds(spark, sf), "run", "average_precision", "price")
    return rounded(out, 8, "best_mean", "baseline_mean", "baseline_std")


@query("leaderboard", f"""WITH {_REPEAT_AP} SELECT run, 5::BIGINT AS n_folds, round(mean, 8) AS mean, round(std, 8) AS std,
  round(mean - 1.96::DOUBLE * std / sqrt(5), 8) AS ci_lo, round(mean + 1.96::DOUBLE * std / sqrt(5), 8) AS ci_hi FROM st ORDER BY mean DESC""")
def leaderboard(spark, sf):
    rows = M.fold_interval(_run_folds(spark, sf), ["run"], "average_precision", K.NORMAL_CRITICAL)
    return M.leaderboard(rounded(rows, 8, "mean", "std", "ci_lo", "ci_hi"), "mean")


@query("metrics_rows", f"""WITH {O.RUNS}, m AS (SELECT run, count(*)::DOUBLE AS n_rows, sum(label)::DOUBLE AS n_pos FROM runs GROUP BY 1)
SELECT run, 'n_rows' AS metric, n_rows AS value, 'sample' AS dataset FROM m UNION ALL SELECT run, 'n_pos', n_pos, 'sample' FROM m""")
def metrics_rows(spark, sf):
    wide = B.score_runs(spark, sf).groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_pos"))
    return M.metrics_rows(wide, "sample", RUN)


@query("mean_ensemble", f"""WITH {O.RUNS},
w AS (SELECT account_id, max(score) FILTER (run = 'price') AS a, max(score) FILTER (run = 'mixed') AS b FROM runs GROUP BY 1)
SELECT account_id, round((a + b) / 2, 8) AS score FROM w""")
def mean_ensemble(spark, sf):
    from ringwatch.operators.models import mean_ensemble as ensemble

    return rounded(ensemble(B.score_runs(spark, sf).where("run <> 'rare'"), "account_id"), 8, "score")


@query("temporal_split", """WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS step FROM orders),
c AS (SELECT floor(quantile_cont(step::DOUBLE, 0.7)) AS cut FROM o)
SELECT step <= (SELECT cut FROM c) AS is_train, count(*) AS n, min(step) AS first_step, max(step) AS last_step FROM o GROUP BY 1""")
def temporal_split(spark, sf):
    step = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("step")
    rows = splits.temporal_split(B.table(spark, sf, "orders").select("o_orderkey", step), "step", 0.7)
    return rows.groupBy("is_train").agg(
        F.count(F.lit(1)).alias("n"), F.min("step").alias("first_step"), F.max("step").alias("last_step")
    )


@query("row_sample", """SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 1000""")
def row_sample(spark, sf):
    return splits.sample_rows(B.table(spark, sf, "orders").select("o_orderkey"), 1000, ["o_orderkey"])


@query("class_examples", f"""WITH {O.RARE}
(SELECT account_id, label FROM rare WHERE label = 1 ORDER BY account_id LIMIT 5)
UNION ALL (SELECT account_id, label FROM rare WHERE label = 0 ORDER BY account_id LIMIT 5)""")
def class_examples(spark, sf):
    return splits.class_examples(B.rare_run(spark, sf).select("account_id", "label"), "label", "account_id", 5)


_BOOT = f"""
s AS (SELECT doc_id, toxic AS label, (n_chars % 997) / 997.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id)),
r AS (SELECT s.*, rep.replicate, {O.HASH.format("'42:' || rep.replicate || ':' || doc_id")} AS u FROM s CROSS JOIN (SELECT unnest(range(1, 2001)) AS replicate) rep),
w AS (SELECT *, CASE WHEN u < 0.36787944117144233::DOUBLE THEN 0 WHEN u < 0.73575888234288467::DOUBLE THEN 1 WHEN u < 0.91969860292860584::DOUBLE THEN 2
  WHEN u < 0.98101184312384626::DOUBLE THEN 3 WHEN u < 0.99634015317265635::DOUBLE THEN 4 WHEN u < 0.99940581518241833::DOUBLE THEN 5
  WHEN u < 0.99991675885071193::DOUBLE THEN 6 WHEN u < 0.99998975080332537::DOUBLE THEN 7 WHEN u < 0.99999887479740201::DOUBLE THEN 8
  WHEN u < 0.99999988857452143::DOUBLE THEN 9 ELSE 10 END AS w FROM r),
h AS (SELECT replicate, score, sum(w) AS n, sum(w * label) AS pos FROM w GROUP BY 1, 2 HAVING sum(w) > 0),
c AS (SELECT *, sum(n) OVER (PARTITION BY replicate ORDER BY score DESC) AS a, sum(pos) OVER (PARTITION BY replicate ORDER BY score DESC) AS tp,
  sum(pos) OVER (PARTITION BY replicate) AS np FROM h),
ap AS (SELECT replicate, sum(pos::DOUBLE / np * (tp::DOUBLE / a)) AS average_precision, max(np)::BIGINT AS n_pos FROM c WHERE np >= 2 GROUP BY 1)
"""


def _boot_scores(spark, sf):
    docs = B.labelled_documents(spark, sf).where("toxic is not null")
    return docs.select(
        "doc_id", F.col("toxic").alias("label"), (F.pmod("n_chars", F.lit(997)) / F.lit(997.0)).alias("score")
    )


@query("bootstrap_replicates", f"WITH {_BOOT} SELECT replicate::INT AS replicate, round(average_precision, 8) AS average_precision, n_pos FROM ap")
def bootstrap_replicates(spark, sf):
    return rounded(splits.bootstrap_precision(_boot_scores(spark, sf), ["doc_id"]), 8, "average_precision")


@query("bootstrap_ci", f"""WITH {_BOOT} SELECT round(quantile_cont(average_precision, 0.025), 6) AS ci_lo,
  round(quantile_cont(average_precision, 0.975), 6) AS ci_hi, round(avg(average_precision), 6) AS mean FROM ap""")
def bootstrap_ci(spark, sf):
    out = splits.bootstrap_interval(splits.bootstrap_precision(_boot_scores(spark, sf), ["doc_id"]))
    return rounded(out, 6, "ci_lo", "ci_hi", "mean")


def _walk(mean: str) -> str:
    """Poisson draw by cutting the unit interval around the mean, as a lambda over the steps."""
    lam, m = f"{mean}::DOUBLE", mean
    fact = (f"CASE WHEN {m} <= 20 THEN ln(factorial(least({m}, 20)::INT)::DOUBLE) ELSE {lam} * ln({lam}) - {lam} + 0.5::DOUBLE * ln(6.283185307179586::DOUBLE * {lam})"
            f" + (1.0::DOUBLE / (12.0::DOUBLE * {lam}) - 1.0::DOUBLE / (360.0::DOUBLE * {lam} * {lam} * {lam}) + 1.0::DOUBLE / (1260.0::DOUBLE * {lam} * {lam} * {lam} * {lam} * {lam})) END")
    p = f"exp({m} * ln({lam}) - {lam} - ({fact}))"
    up, down = f"(s.up * {lam} / ({m} + j))", f"(CASE WHEN j <= {m} THEN s.down * ({m} - j + 1) / {lam} ELSE 0.0::DOUBLE END)"
    step = f"""lambda s, j: {{'rest': CASE WHEN s.done THEN s.rest ELSE s.rest - {up} - {down} END, 'up': {up}, 'down': {down},
      'k': CASE WHEN s.done THEN s.k WHEN s.rest < {up} THEN {m} + j WHEN s.rest - {up} < {down} THEN {m} - j ELSE s.k END,
      'done': s.done OR s.rest < {up} OR s.rest - {up} < {down}}}"""
    start = f"{{'rest': u - {p}, 'up': {p}, 'down': {p}, 'k': {m}::BIGINT, 'done': u < {p}}}"
    return f"CASE WHEN {m} > 0 THEN list_reduce(generate_series(1, ceil(10 * sqrt({lam}))::BIGINT + 12), {step}, {start}).k ELSE 0 END"


_BINNED = f"""
b AS (SELECT round_even((n_chars % 997) / 997.0::DOUBLE * 10000, 0)::BIGINT AS bin, toxic AS label, count(*) AS n
  FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL GROUP BY 1, 2),
d AS (SELECT replicate, bin, label, n, {O.HASH.format("'42:' || replicate || ':' || bin || ':' || CASE label WHEN 1 THEN 'pos' ELSE 'neg' END")} AS u
  FROM b CROSS JOIN (SELECT unnest(range(1, 2001)) AS replicate)),
w AS (SELECT replicate, bin, label, {_walk("n")} AS w FROM d),
h AS (SELECT replicate, bin, sum(w) AS n, coalesce(sum(w) FILTER (label = 1), 0) AS pos FROM w GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER o AS a, sum(pos) OVER o AS tp, sum(pos) OVER (PARTITION BY replicate) AS np FROM h WINDOW o AS (PARTITION BY replicate ORDER BY bin DESC)),
ap AS (SELECT replicate, coalesce(sum(pos::DOUBLE / np * (tp::DOUBLE / a)) FILTER (pos > 0), 0) AS average_precision, max(np)::BIGINT AS n_pos FROM c WHERE np >= 2 GROUP BY 1)
"""


@query("bootstrap_binned_replicates", f"WITH {_BINNED} SELECT replicate::INT AS replicate, round(average_precision, 8) AS average_precision, n_pos FROM ap")
def bootstrap_binned_replicates(spark, sf):
    return rounded(splits.bootstrap_precision_binned(_boot_scores(spark, sf)), 8, "average_precision")


@query("bootstrap_binned")
def bootstrap_binned(spark, sf):
    return splits.bootstrap_precision_binned(B.rare_run(spark, sf), digits=2)
