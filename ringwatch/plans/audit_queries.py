"""Queries on snapshots and labelled matrices: hygiene and leak audit."""

from pyspark.sql import functions as F

from ringwatch import constants as K
from ringwatch.functions.labels import human_label, readable_value
from ringwatch.operators import audit as A
from ringwatch.operators import hygiene as H
from ringwatch.operators.longform import feature_histogram, to_long
from ringwatch.operators.running import row_numbers
from ringwatch.plans import bindings as B
from ringwatch.plans import oracles as O
from ringwatch.plans.registry import query, rounded

FEATURES = [*B.AUDIT_FEATURES, "planted"]
SNAP = [*B.SNAPSHOT_NUMERIC, "segment"]
_SIG = f"{O.AUDIT}, {O.purity_sql('long', '')}"


def _hist(spark, sf):
    return feature_histogram(B.audit_matrix(spark, sf), FEATURES, "label")


@query("audit_buckets", f"WITH {_SIG} SELECT feature, bucket_rate FROM bk")
def audit_buckets(spark, sf):
    return A.bucket_purity(_hist(spark, sf), [])


@query("audit_deciles", f"WITH {_SIG} SELECT feature, CASE WHEN n_distinct >= 10 THEN rate END AS decile_rate FROM dc JOIN tot USING (feature)")
def audit_deciles(spark, sf):
    running = A.running_histogram(_hist(spark, sf), [])
    return A.decile_purity(running, A.feature_summary(running, []), [])


@query("audit_auc", f"WITH {_SIG} SELECT feature, round(auc, 8) AS auc FROM au")
def audit_auc(spark, sf):
    return rounded(A.univariate_auc(A.running_histogram(_hist(spark, sf), []), []), 8, "auc")


@query("audit_totals", f"WITH {_SIG} SELECT * FROM tot WHERE n_rows >= 10 AND n_pos > 0 AND n_pos < n_rows")
def audit_totals(spark, sf):
    return A.eligible(A.feature_totals(_hist(spark, sf), []))


def _findings(spark, sf):
    return A.integrity_audit(B.audit_matrix(spark, sf), FEATURES, "label", ["l_suppkey"])


@query("audit_severity", f"WITH {_SIG}, {O.SEVERITY} SELECT * FROM findings")
def audit_severity(spark, sf):
    return A.ranked(_findings(spark, sf))


@query("audit_counts", f"""WITH {_SIG}, {O.SEVERITY} SELECT severity, count(*) AS n_features,
  count(*) FILTER (severity IN ('CRITICAL', 'HIGH') AND NOT hinted) AS n_to_block FROM findings GROUP BY 1""")
def audit_counts(spark, sf):
    return A.severity_counts(_findings(spark, sf))


@query("audit_block_list", f"WITH {_SIG}, {O.SEVERITY} SELECT feature FROM findings WHERE severity IN ('CRITICAL', 'HIGH') AND NOT hinted")
def audit_block_list(spark, sf):
    return A.block_list(_findings(spark, sf))


@query("audit_injected", f"WITH {_SIG}, {O.SEVERITY} SELECT feature, severity FROM findings WHERE feature = 'planted'")
def audit_injected(spark, sf):
    return _findings(spark, sf).where("feature = 'planted'").select("feature", "severity")


_SNAP_AUDIT = f"""{O.SNAPSHOT},
li AS (SELECT label FROM snap),
{O.purity_sql('slong', '')}, {O.SEVERITY.replace("feature = 'l_suppkey'", "feature = 'nation'")}"""


@query("snapshot_audit", f"WITH {_SNAP_AUDIT} SELECT * FROM findings")
def snapshot_audit(spark, sf):
    return A.integrity_audit(B.snapshot(spark, sf), B.SNAPSHOT_NUMERIC, "label", ["nation"])


@query("snapshot_range_leaks", f"""WITH {_SNAP_AUDIT} SELECT feature, best_decile_rate FROM findings
WHERE best_decile_rate >= 0.1 AND best_bucket_rate < 0.1 AND NOT hinted""")
def snapshot_range_leaks(spark, sf):
    found = A.integrity_audit(B.snapshot(spark, sf), B.SNAPSHOT_NUMERIC, "label", ["nation"])
    return A.range_only_leaks(found).select("feature", "best_decile_rate")


@query("audit_lines")
def audit_lines(spark, sf):
    return A.audit_lines(_findings(spark, sf))


@query("leak_list", f"""WITH {_SIG} SELECT feature, greatest(coalesce(bucket_rate, 0), decile_rate) AS worst_rate FROM sig
WHERE greatest(bucket_rate, decile_rate) >= 0.1 AND feature <> 'l_suppkey'""")
def leak_list(spark, sf):
    return A.leaking_features(_hist(spark, sf), hinted=["l_suppkey"])


@query("leak_sweep", f"""WITH {_SIG}, r AS (SELECT unnest([1.01, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02])::DOUBLE AS leak_rate)
SELECT leak_rate, count(*) FILTER (leak_rate <= 1 AND greatest(bucket_rate, decile_rate) >= leak_rate) AS n_leaks,
  count(*) FILTER (NOT (leak_rate <= 1 AND greatest(bucket_rate, decile_rate) >= leak_rate)) AS n_kept FROM sig CROSS JOIN r GROUP BY 1""")
def leak_sweep(spark, sf):
    return A.leak_sweep(_hist(spark, sf))


_INFOLD = f"""{O.AUDIT},
fd AS (SELECT account_id, ((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || account_id), account_id) - 1) % 5)::INT AS f FROM li),
tr AS (SELECT k.fold, feature, value, label FROM long JOIN fd USING (account_id), (SELECT unnest([0, 1, 2, 3, 4])::INT AS fold) k WHERE fd.f <> k.fold),
{O.purity_sql('tr', 'fold')}"""


@query("leak_infold", f"WITH {_INFOLD} SELECT fold, feature, greatest(bucket_rate, decile_rate) AS worst_rate FROM sig WHERE greatest(bucket_rate, decile_rate) >= 0.02")
def leak_infold(spark, sf):
    numbered = row_numbers(B.audit_matrix(spark, sf), ["label"], ["account_id"], 42)
    dealt = numbered.withColumn("fold", F.pmod("rn", F.lit(5)).cast("int"))
    return A.infold_leaks(dealt, FEATURES, "label", 5, rate=0.02)


@query("snapshot_profile", f"""WITH {O.SNAPSHOT}, {O.PROFILE}
SELECT *, round(1 - n_filled::DOUBLE / n_rows, 8) AS na_fraction, 1 - n_filled::DOUBLE / n_rows > 0.97 AS near_empty,
  n_filled < 30 AS hyper_sparse, n_distinct <= 1 AS constant, 1 - n_filled::DOUBLE / n_rows > 0.3 AS wants_flag FROM prof""")
def snapshot_profile(spark, sf):
    return rounded(H.snapshot_profile(B.snapshot(spark, sf), SNAP), 8, "na_fraction")


@query("kept_features", f"""WITH {O.SNAPSHOT}, {O.PROFILE} SELECT feature FROM prof
WHERE 1 - n_filled::DOUBLE / n_rows <= 0.97 AND n_filled >= 30 AND n_distinct > 1""")
def kept_features(spark, sf):
    return H.kept_features(H.snapshot_profile(B.snapshot(spark, sf), SNAP)).select("feature")


@query("continuous_features", f"WITH {O.SNAPSHOT}, {O.PROFILE} SELECT feature FROM prof WHERE n_distinct > 20 AND feature <> 'segment'")
def continuous_features(spark, sf):
    return H.continuous_features(H.snapshot_profile(B.snapshot(spark, sf), SNAP), ["segment"]).select("feature")


@query("missing_flags", f"""WITH {O.SNAPSHOT} SELECT account_id, (value_p IS NULL)::TINYINT AS value_p__ismissing,
  (urgent_open IS NULL)::TINYINT AS urgent_open__ismissing FROM snap""")
def missing_flags(spark, sf):
    flagged = H.missing_flags(B.snapshot(spark, sf), ["value_p", "urgent_open"])
    return flagged.select("account_id", "value_p__ismissing", "urgent_open__ismissing")


@query("distinct_flags", f"""WITH {O.SNAPSHOT},
g AS (SELECT feature, count(*) AS n_missing, md5(string_agg(account_id::VARCHAR, ',' ORDER BY account_id)) AS p
      FROM slong WHERE value IS NULL GROUP BY 1),
o AS (SELECT * FROM (VALUES (1, 'balance'), (2, 'nation'), (3, 'value_f'), (4, 'value_o'), (5, 'value_p'), (6, 'urgent_txns'),
  (7, 'urgent_max'), (8, 'urgent_open'), (9, 'huge_txn'), (10, 'constant')) AS v(k, feature))
SELECT arg_min(feature, k) AS feature, n_missing, count(*) AS n_sharing FROM g JOIN o USING (feature)
WHERE n_missing > (SELECT count(*) FROM snap) * 0.1 GROUP BY n_missing, p""")
def distinct_flags(spark, sf):
    return H.distinct_flags(B.snapshot(spark, sf), B.SNAPSHOT_NUMERIC, "account_id", 0.1)


@query("ordinal_codes", """SELECT feature, category, row_number() OVER (PARTITION BY feature ORDER BY category) - 1 AS code FROM (
  SELECT DISTINCT 'lang' AS feature, lang AS category FROM documents UNION ALL SELECT DISTINCT 'source', source FROM documents
  UNION ALL SELECT DISTINCT 'toxic_text', CASE toxic WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END FROM documents LEFT JOIN labels USING (doc_id))
WHERE category IS NOT NULL""")
def ordinal_codes(spark, sf):
    docs = B.labelled_documents(spark, sf).withColumn(
        "toxic_text", F.when(F.col("toxic") == 1, "yes").when(F.col("toxic") == 0, "no")
    )
    return H.category_codes(docs, ["lang", "source", "toxic_text"]).withColumn("code", F.col("code").cast("bigint"))


@query("encoded_rows", """WITH l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS c FROM (SELECT DISTINCT lang FROM documents)),
s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS c FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, l.c::DOUBLE AS lang, s.c::DOUBLE AS source FROM documents JOIN l USING (lang) JOIN s USING (source)""")
def encoded_rows(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return H.encode(docs, H.category_codes(docs, ["lang", "source"]), ["lang", "source"])


@query("duplicate_rows", """SELECT sum(n)::BIGINT AS n_rows, (sum(n) - count(*))::BIGINT AS duplicate_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag)""")
def duplicate_rows(spark, sf):
    rows = B.table(spark, sf, "lineitem")
    return H.duplicate_rows(rows, ["l_quantity", "l_discount", "l_tax", "l_returnflag"])


@query("row_counts", f"""WITH {O.SNAPSHOT} SELECT account_id, count(*) FILTER (value IS NULL)::INT AS n_missing,
  count(*) FILTER (value = 0)::INT AS n_zero, round(1 - count(*) FILTER (value IS NULL) / 10.0::DOUBLE, 8) AS completeness FROM slong GROUP BY 1""")
def row_counts(spark, sf):
    out = H.row_counts(B.snapshot(spark, sf), B.SNAPSHOT_NUMERIC).select("account_id", "n_missing", "n_zero", "completeness")
    return rounded(out, 8, "completeness")


@query("model_trust", f"""WITH {O.SNAPSHOT}, c AS (SELECT account_id, any_value(label) AS label, 1 - count(*) FILTER (value IS NULL) / 10.0::DOUBLE AS completeness FROM slong GROUP BY 1),
p AS (SELECT c.account_id, completeness, (balance + 1000) / 11000.0::DOUBLE AS p FROM c JOIN snap USING (account_id))
SELECT account_id, round_even(100.0::DOUBLE * (0.6::DOUBLE * (abs(p - 0.5::DOUBLE) * 2.0::DOUBLE) + 0.4::DOUBLE * completeness), 0)::INT AS model_trust FROM p""")
def model_trust(spark, sf):
    from ringwatch.functions.policy import model_trust as trust

    rows = H.row_counts(B.snapshot(spark, sf), B.SNAPSHOT_NUMERIC)
    p = (F.col("balance") + 1000) / 11000.0
    return rows.select("account_id", trust(p, F.col("completeness")).alias("model_trust"))


@query("ratios", f"""WITH {O.SNAPSHOT} SELECT account_id, round(value_f / (abs(value_o) + 1e-6::DOUBLE), 6) AS eng_value_f_over_value_o,
  round(urgent_max / (abs(balance) + 1e-6::DOUBLE), 6) AS eng_urgent_max_over_balance FROM snap""")
def ratios(spark, sf):
    pairs = [("value_f", "value_o"), ("urgent_max", "balance"), ("absent", "balance")]
    out = H.add_ratios(B.snapshot(spark, sf), pairs)
    names = ["eng_value_f_over_value_o", "eng_urgent_max_over_balance"]
    return rounded(out.select("account_id", *names), 6, *names)


@query("transform_new", f"""WITH {O.SNAPSHOT}, c AS (SELECT segment, (row_number() OVER (ORDER BY segment) - 1)::DOUBLE AS code FROM (SELECT DISTINCT segment FROM snap WHERE label = 1))
SELECT account_id, balance, code AS segment, (value_p IS NULL)::INT::DOUBLE AS value_p__ismissing, (segment IS NULL)::INT::DOUBLE AS segment__ismissing,
  1.0::DOUBLE AS gone__ismissing, NULL::DOUBLE AS gone FROM snap LEFT JOIN c USING (segment)""")
def transform_new(spark, sf):
    rows = B.snapshot(spark, sf)
    codes = H.category_codes(rows.where("label = 1"), ["segment"])
    columns = ["balance", "segment", "value_p__ismissing", "segment__ismissing", "gone__ismissing", "gone"]
    return H.transform_new(rows, columns, codes, ["segment"], keep=["account_id"])


@query("target_free_prep", f"""WITH {O.SNAPSHOT}, c AS (SELECT segment, (row_number() OVER (ORDER BY segment) - 1)::DOUBLE AS code FROM (SELECT DISTINCT segment FROM snap))
SELECT label, balance, nation::DOUBLE AS nation, code AS segment, round(value_f, 2) AS value_f, urgent_txns::DOUBLE AS urgent_txns
FROM snap JOIN c USING (segment)""")
def target_free_prep(spark, sf):
    rows, _, _ = H.target_free_prep(B.snapshot(spark, sf), "label", ["account_id"])
    out = rows.select("label", "balance", "nation", "segment", "value_f", "urgent_txns")
    return rounded(out, 2, "value_f")


@query("hygiene_report", f"""WITH {O.SNAPSHOT}, {O.PROFILE}, {O.purity_sql('slong', '')},
d AS (SELECT *, 1 - n_filled::DOUBLE / n_rows AS na FROM prof WHERE feature <> 'huge_txn'),
k AS (SELECT *, na > 0.97 AS ne, n_filled < 30 AS hs, n_distinct <= 1 AS co FROM d),
g AS (SELECT count(*) AS n, md5(string_agg(account_id::VARCHAR, ',' ORDER BY account_id)) AS p FROM slong WHERE value IS NULL GROUP BY feature),
fl AS (SELECT count(*) AS c FROM (SELECT DISTINCT n, p FROM g WHERE n > (SELECT count(*) FROM snap) * 0.3)),
lk AS (SELECT count(*) AS c FROM sig WHERE greatest(bucket_rate, decile_rate) >= 0.1 AND feature NOT IN ('nation'))
SELECT (SELECT count(*) FROM snap) AS n_rows, (SELECT sum(label)::BIGINT FROM snap) AS n_positives,
  (SELECT round(avg(label::DOUBLE), 8) FROM snap) AS prevalence, count(*) FILTER (ne) AS dropped_near_empty,
  count(*) FILTER (hs) AS dropped_hyper_sparse, count(*) FILTER (co AND NOT ne AND NOT hs) AS dropped_constant,
  count(*) FILTER (na > 0.3 AND NOT ne AND NOT hs AND NOT co) AS n_missing_flags_raw, (SELECT c FROM fl) AS n_missing_flags,
  (SELECT c FROM lk) AS n_bucket_leaks, 11 AS n_features_raw, 'huge_txn' AS dropped_leakage, 'nation' AS hint_features_present,
  'segment' AS categorical_cols FROM k""")
def hygiene_report(spark, sf):
    rows = B.snapshot(spark, sf)
    hist = feature_histogram(rows, B.SNAPSHOT_NUMERIC, "label")
    leaks = A.leaking_features(hist, hinted=["nation"])
    flags = H.distinct_flags(rows, B.SNAPSHOT_NUMERIC, "account_id")
    report = H.hygiene_report(rows, SNAP, "label", leaks, flags, blocked=["huge_txn"], hinted=["nation"])
    return rounded(report, 8, "prevalence")


@query("class_stats", f"""WITH {O.SNAPSHOT}
SELECT feature, round(median(value), 4) AS median, round(quantile_cont(value, 0.05), 4) AS q05, round(quantile_cont(value, 0.95), 4) AS q95,
  round(avg(value) FILTER (label = 0), 4) AS mean_legit, round(avg(value) FILTER (label = 1), 4) AS mean_mule,
  round(avg(value), 4) AS mean, count(value) AS n_filled, round(nullif(stddev_samp(value), 0), 4) AS std
FROM slong WHERE value IS NOT NULL GROUP BY 1""")
def class_stats(spark, sf):
    out = H.class_stats(B.snapshot(spark, sf), B.SNAPSHOT_NUMERIC, "label")
    return rounded(out, 4, "median", "q05", "q95", "mean_legit", "mean_mule", "mean", "std")


@query("profile_gap", f"""WITH {O.SNAPSHOT}, p AS (SELECT account_id, (balance + 1000) / 11000.0::DOUBLE AS p FROM snap),
g AS (SELECT feature, avg(value) FILTER (label = 1 AND p < 0.05) AS m, avg(value) FILTER (label = 1 AND p >= 0.05) AS c,
  avg(value) FILTER (label = 0) AS l FROM slong JOIN p USING (account_id) GROUP BY 1)
SELECT feature, round(m, 4) AS missed_mean, round(c, 4) AS caught_mean, round(l, 4) AS legit_mean, round(abs(m - c), 4) AS gap FROM g""")
def profile_gap(spark, sf):
    rows = B.snapshot(spark, sf).withColumn("p", (F.col("balance") + 1000) / 11000.0)
    out = H.profile_gap(rows, B.SNAPSHOT_NUMERIC, "p", "label", 0.05)
    return rounded(out, 4, "missed_mean", "caught_mean", "legit_mean", "gap")


@query("feature_labels", f"""WITH {O.SNAPSHOT}, l AS (SELECT account_id, unnest(['F3889', 'F670', 'F3894', 'F12', 'F2956__ismissing']) AS feature,
  unnest([CASE WHEN nation < 5 THEN 'L31D' WHEN nation < 10 THEN 'L90D' WHEN nation < 15 THEN 'L180D' WHEN nation < 20 THEN 'L365D' ELSE 'G365D' END,
    (label)::VARCHAR, urgent_txns::VARCHAR, segment, (urgent_open IS NULL)::INT::VARCHAR]) AS value FROM snap)
SELECT feature, CASE feature WHEN 'F3889' THEN 'account tenure bucket (F3889) [bank-listed feature]' WHEN 'F670' THEN 'binary flag (F670) [bank-listed feature]'
  WHEN 'F3894' THEN 'customer age (inferred) (F3894) [bank-listed feature]' WHEN 'F12' THEN 'behavioral indicator F12 (anonymized)'
  ELSE 'whether ''F2956'' [bank-listed] profile field is blank' END AS label,
  CASE WHEN feature = 'F2956__ismissing' THEN CASE value WHEN '1' THEN 'BLANK' ELSE 'present' END WHEN value IS NULL THEN 'BLANK'
    WHEN feature = 'F3889' THEN CASE value WHEN 'L31D' THEN 'account tenure < 31 days (very new)' WHEN 'L90D' THEN 'account tenure < 90 days (new)'
      WHEN 'L180D' THEN 'account tenure < 180 days' WHEN 'L365D' THEN 'account tenure < 1 year' ELSE 'account tenure > 1 year (established)' END
    WHEN feature = 'F670' THEN CASE value WHEN '1' THEN 'set (1)' ELSE 'not set (0)' END
    WHEN feature = 'F3894' THEN value || '.00' ELSE value END AS value_readable, count(*) AS n FROM l GROUP BY ALL""")
def feature_labels(spark, sf):
    rows = B.snapshot(spark, sf)
    tenure = (
        F.when(F.col("nation") < 5, "L31D").when(F.col("nation") < 10, "L90D").when(F.col("nation") < 15, "L180D")
        .when(F.col("nation") < 20, "L365D").otherwise("G365D")
    )
    cells = {
        "F3889": tenure,
        "F670": F.col("label").cast("string"),
        "F3894": F.col("urgent_txns").cast("string"),
        "F12": F.col("segment"),
        "F2956__ismissing": F.col("urgent_open").isNull().cast("int").cast("string"),
    }
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), v.alias("value")) for f, v in cells.items()])
    long = rows.select(F.explode(pairs).alias("c")).select("c.*")
    return long.groupBy(
        "feature",
        human_label(F.col("feature")).alias("label"),
        readable_value(F.col("feature"), F.col("value")).alias("value_readable"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("context_notes", f"""WITH {O.SNAPSHOT}, s AS (SELECT feature, median(value) AS m, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b,
  avg(value) FILTER (label = 0) AS l, avg(value) FILTER (label = 1) AS u FROM slong WHERE value IS NOT NULL GROUP BY 1)
SELECT account_id, feature, CASE WHEN value IS NULL THEN '' ELSE concat_ws('; ',
  CASE WHEN value <= a THEN 'in the bottom 5% of accounts' WHEN value >= b THEN 'in the top 5% of accounts' WHEN value > m THEN 'above the median' ELSE 'below the median' END,
  CASE WHEN u IS NULL OR l IS NULL THEN NULL WHEN abs(value - u) < abs(value - l) THEN 'closer to the typical mule profile'
    ELSE 'closer to the typical legitimate profile' END) END AS note
FROM slong JOIN s USING (feature) WHERE feature IN ('balance', 'nation', 'urgent_max')""")
def context_notes(spark, sf):
    rows = B.snapshot(spark, sf)
    names = ["balance", "nation", "urgent_max"]
    stats = H.class_stats(rows, names, "label")
    long = to_long(rows, names, ["account_id"]).join(stats, "feature")
    return long.select("account_id", "feature", H.percentile_note(F.col("value")).alias("note"))
