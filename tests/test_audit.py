import numpy as np
import pytest
from pyspark.sql import functions as F

from ringwatch.operators import audit as A
from ringwatch.operators import hygiene as H
from ringwatch.operators.longform import feature_histogram


def brute_decile(values, labels):
    """Right-closed decile ranges, equal edges merged; highest rate with at least ten rows."""
    import pandas as pd

    v, y = pd.Series(values), pd.Series(labels)
    if v.nunique() < 10:
        return None
    bins = pd.qcut(v, 10, duplicates="drop")
    g = y.groupby(bins, observed=True)
    rates, counts = g.mean(), g.count()
    kept = rates[counts >= 10]
    return float(kept.max()) if len(kept) else None


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_decile_purity_matches_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    n = 400
    cols = {
        "a": rng.normal(size=n),
        "b": np.where(rng.random(n) < 0.7, 0.0, np.round(rng.random(n) * 20)),
        "c": rng.integers(0, 5, n).astype(float),
        "d": np.round(rng.exponential(size=n), 1),
    }
    y = (rng.random(n) < 0.1 + 0.3 * (cols["a"] > 1)).astype(int)
    rows = [(int(y[i]), *[float(cols[c][i]) for c in cols]) for i in range(n)]
    df = spark.createDataFrame(rows, "label int, a double, b double, c double, d double")
    running = A.running_histogram(feature_histogram(df, list(cols), "label"), [])
    got = {r["feature"]: r["decile_rate"] for r in A.decile_purity(running, A.feature_summary(running, []), []).collect()}
    for c in cols:
        want = brute_decile(cols[c], y)
        assert got[c] == (pytest.approx(want) if want is not None else None)


def test_planted_leak_is_caught_and_noise_is_not(spark):
    rows = spark.range(3000).select(
        F.concat(F.lit("r"), "id").alias("account_id"), F.when(F.pmod("id", F.lit(25)) == 3, 1).otherwise(0).alias("label"),
        F.pmod(F.hash("id"), F.lit(1000)).cast("double").alias("noise"),
    )
    df = A.injected_label(rows, "label", ["account_id"], "leak", rate=0.001)
    found = {r["feature"]: r["severity"] for r in A.integrity_audit(df, ["noise", "leak"], "label").collect()}
    assert found["leak"] == "CRITICAL" and found.get("noise") in (None, "WATCH", "MEDIUM")


def test_audit_skips_single_class_and_empty_features(spark):
    rows = [(int(i < 20), None if i < 20 else 1.0, None, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "label int, only_neg double, empty double, order double")
    found = {r["feature"] for r in A.integrity_audit(df, ["only_neg", "empty", "order"], "label").collect()}
    assert found == {"order"}


def test_hinted_features_are_never_listed(spark):
    df = spark.createDataFrame([(int(i < 15), float(i < 15), float(i < 15)) for i in range(100)], "label int, F1 double, F2__x double")
    hist = feature_histogram(df, ["F1", "F2__x"], "label")
    assert {r["feature"] for r in A.leaking_features(hist, hinted=["F2"]).collect()} == {"F1"}


def test_histogram_chunks_agree(spark):
    df = spark.createDataFrame([(i % 2, float(i % 3), None, str(i % 4)) for i in range(40)], "label int, a double, b double, c string")
    one = {tuple(r) for r in feature_histogram(df, ["a", "b", "c"], "label").collect()}
    two = {tuple(r) for r in feature_histogram(df, ["a", "b", "c"], "label", chunk=1).collect()}
    assert one == two and ("b", None, 40, 20) in one


def test_training_histogram_is_total_minus_fold(spark):
    df = spark.createDataFrame([(i % 3, i % 2, float(i % 5)) for i in range(90)], "fold int, label int, x double")
    got = A.training_histograms(feature_histogram(df, ["x"], "label", ["fold"]), "fold", 3)
    for f in range(3):
        want = {tuple(r) for r in feature_histogram(df.where(F.col("fold") != f), ["x"], "label").collect()}
        assert {tuple(r)[1:] for r in got.where(F.col("fold") == f).collect()} == want


def test_profile_and_flags(spark):
    rows = [(i, float(i) if i % 2 else None, 1.0 if i % 2 else None, 5.0, "x" if i % 3 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, t string")
    prof = {r["feature"]: r for r in H.snapshot_profile(df, ["a", "b", "c", "t"]).collect()}
    assert prof["a"]["na_fraction"] == 0.5 and prof["a"]["wants_flag"] and not prof["a"]["constant"]
    assert prof["b"]["constant"] and prof["c"]["constant"] and prof["t"]["n_distinct"] == 1
    flags = {r["feature"]: r["n_sharing"] for r in H.distinct_flags(df, ["a", "b", "c"], "id").collect()}
    assert flags == {"a": 2}


def test_codes_are_alphabetical_and_unseen_is_null(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "t string")
    codes = H.category_codes(train, ["t"])
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z"), (4, None)], "id int, t string")
    out = H.transform_new(new, ["t", "t__ismissing", "q__ismissing", "q"], codes, ["t"], keep=["id"]).orderBy("id").collect()
    assert [r["t"] for r in out] == [0.0, 1.0, None, None]
    assert [r["t__ismissing"] for r in out] == [0.0, 0.0, 0.0, 1.0]
    assert all(r["q__ismissing"] == 1.0 and r["q"] is None for r in out)


def test_prepare_frame_takes_cleaned_rows_as_they_are(spark):
    clean = spark.createDataFrame([(1, 0.0, 2.0)], "id int, a__ismissing double, a double")
    out = H.prepare_frame(clean, ["a", "a__ismissing", "b"], None, [], keep=["id"]).first()
    assert tuple(out) == (1, 2.0, 0.0, None)


def test_matrix_contract(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 2.0)], "label int, F1 double")
    assert H.check_matrix(df, "label", ["F9"], ["F1"], 2, 1) is df
    for bad in (dict(blocked=["F1"], hinted=[]), dict(blocked=[], hinted=["F7"]), dict(blocked=[], hinted=[], rows=3)):
        with pytest.raises(ValueError):
            H.check_matrix(df, "label", **bad)


def test_block_range(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "F3894 int, F3895 int, F3900__ismissing int, G3900 int")
    assert H.drop_block_range(df).columns == ["F3894", "G3900"]


def test_class_stats_match_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = 1e6 + rng.normal(size=200), rng.integers(0, 2, 200)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)] + [(None, 1)], "x double, label int")
    r = H.class_stats(df, ["x"], "label").first()
    assert r["std"] == pytest.approx(x.std(ddof=1))
    assert r["median"] == pytest.approx(np.median(x)) and r["mean_mule"] == pytest.approx(x[y == 1].mean())
