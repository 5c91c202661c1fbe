import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringwatch.operators import cases, similarity
from ringwatch.operators import components as C


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(500 + i, 501 + i) for i in range(40)]
    got = {r["id"]: r["component"] for r in C.connected_components(edges_of(spark, pairs)).collect()}
    assert got == brute(pairs)


def test_components_with_salted_stars(spark, monkeypatch):
    pairs = [(0, i) for i in range(1, 120)] + [(1000 + i, 1001 + i) for i in range(20)]
    monkeypatch.setattr(C, "HOT_MIN_ROWS", 1)
    monkeypatch.setattr(C, "attach", lambda *a, **k: __import__("ringwatch.operators.skew", fromlist=["attach"]).attach(*a, **k, hot_min_rows=5, salts=4, broadcast_max_rows=0))
    got = {r["id"]: r["component"] for r in C.connected_components(edges_of(spark, pairs)).collect()}
    assert got == brute(pairs)


def test_components_stop_when_the_edges_are_stars(spark, monkeypatch):
    """Stars and pairs, also with edges turned and repeated, need no round; a path needs no round to see that it is done."""
    rounds, step = [], C._round
    monkeypatch.setattr(C, "_round", lambda *a: rounds.append(1) or step(*a))
    pairs = [(0, i) for i in range(1, 9)] + [(5, 0), (20, 21), (21, 20), (20, 21), (30, 30)]
    for more, most in (([], 0), ([(40, 41), (41, 42)], 1)):
        got = {r["id"]: r["component"] for r in C.connected_components(edges_of(spark, pairs + more)).collect()}
        assert got == brute(pairs + more) and len(rounds) <= most
    assert C.connected_components(edges_of(spark, pairs).limit(0)).count() == 0


def test_relabelling_keeps_the_partition(spark):
    pairs = [(1, 2), (2, 3), (7, 8), (9, 9)]
    mapped = [(100 - a, 100 - b) for a, b in pairs]
    groups = lambda df: sorted(sorted(v) for v in _by(df).values())
    a = groups(C.connected_components(edges_of(spark, pairs)))
    b = groups(C.connected_components(edges_of(spark, mapped)))
    assert a == sorted(sorted(100 - x for x in g) for g in b)


def _by(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["component"], set()).add(r["id"])
    return out


def test_ring_numbers_by_size_then_smallest_member(spark):
    pairs = [(10, 11), (11, 12), (1, 2), (2, 3), (50, 51), (51, 52), (52, 53), (90, 91)]
    members = C.ring_members(C.connected_components(edges_of(spark, pairs)))
    got = {}
    for r in members.collect():
        got.setdefault(r["ring_id"], set()).add(r["id"])
    assert got == {1: {50, 51, 52, 53}, 2: {1, 2, 3}, 3: {10, 11, 12}}
    risk = spark.createDataFrame([(51, 80), (52, 80), (2, 5)], "id bigint, risk_score int")
    rings = {r["ring_id"]: (r["lead_account"], r["lead_score"], r["exposure"]) for r in C.ring_table(members, risk).collect()}
    assert rings == {1: (51, 80, 1000000), 2: (2, 5, 750000), 3: (10, None, 750000)}


def vectors(n, d, seed, gaps=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    if gaps:
        x[rng.random((n, d)) < 0.1] = np.nan
    return x


def standard(x):
    med = np.nanmedian(x, axis=0)
    x = np.where(np.isnan(x), med, x)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    return z / np.linalg.norm(z, axis=1, keepdims=True)


def vector_frame(spark, x):
    rows = [(i, [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, vector array<double>")


@pytest.mark.parametrize("gaps", [False, True])
def test_similarity_graph_in_blocks(spark, gaps):
    x = vectors(120, 6, 3, gaps)
    u = standard(x)
    sims = np.round(u @ u.T, 6)
    upper = sims[np.triu_indices(120, k=1)]
    cut = np.quantile(upper, 0.94)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if sims[i, j] >= cut}
    got = similarity.similarity_graph(vector_frame(spark, x), block_rows=25).collect()
    assert {(r["src"], r["dst"]) for r in got} == want and len(got) == len(want)


def test_positive_similarity_in_blocks(spark):
    x = vectors(90, 5, 4)
    y = (np.arange(90) % 3 == 0).astype(int)
    fold = np.arange(90) % 4
    df = vector_frame(spark, x).withColumn("y", (F.pmod("id", F.lit(3)) == 0).cast("int")).withColumn("f", F.pmod("id", F.lit(4)).cast("int"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r["id"]: r["positive_similarity"] for r in similarity.similarity_to_positives(df, "y", "f", block_rows=11).collect()}
    for i in range(90):
        mask = (y == 1) & (fold != fold[i])
        assert got[i] == pytest.approx(np.sort((u[mask] @ u[i]))[-5:].mean())


def test_cohesion_equals_pair_mean(spark):
    x = vectors(30, 4, 5)
    u = standard(x)
    ids = [1, 4, 9, 16]
    members = spark.createDataFrame([(1, i) for i in ids], "ring_id int, id bigint")
    s = (u @ u.T)[np.ix_(ids, ids)][np.triu_indices(4, k=1)].mean()
    assert similarity.ring_cohesion(vector_frame(spark, x), members).first()["cohesion"] == pytest.approx(s)


def test_cohesion_of_vectors_in_many_groups(spark):
    x = vectors(12, 4, 8)
    rows = [(i, x[i].tolist(), [g for g in (0, 1, 2) if i % (g + 1) == 0]) for i in range(12)]
    listed = spark.createDataFrame(rows, "id long, vector array<double>, grp array<int>")
    got = {r["grp"]: (r["n"], r["cohesion"]) for r in similarity._mean_pair_similarity(listed, "grp").collect()}
    for g in (0, 1, 2):
        own = x[:: g + 1]
        pairs = (own @ own.T)[np.triu_indices(len(own), k=1)]
        assert got[g] == (len(own), pytest.approx(pairs.mean()))


def test_random_groups_are_distinct(spark):
    groups = similarity.random_groups(spark.range(100), 9, groups=20)
    per = groups.groupBy("grp").agg(F.count("id").alias("n"), F.count_distinct("id").alias("d")).collect()
    assert len(per) == 20 and all(r["n"] == 9 == r["d"] for r in per)


def test_recovery_of_a_planted_ring(spark):
    planted = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 9)], "alert_id bigint, id bigint")
    comps = C.connected_components(edges_of(spark, [(1, 2), (2, 3), (3, 4)]))
    got = {r["alert_id"]: r["best_jaccard"] for r in C.ring_recovery(planted, comps).collect()}
    assert got == {1: 0.75, 2: 0.0}
    row = C.recovery_summary(C.ring_recovery(planted, comps)).first()
    assert (row["recovered_half"], row["recovered_most"], row["mean_best_jaccard"]) == (1, 0, 0.375)


def test_case_changes_and_containment(spark):
    log = spark.createDataFrame(
        [(1, 1, "NEW", "", "reviewed"), (1, 2, "ESCALATED", "", "ESCALATED"), (1, 3, "ESCALATED", "", "ESCALATED"),
         (1, 4, "ESCALATED", "ann", "CLEARED"), (2, 1, "NEW", "bob", "ESCALATED")],
        "account bigint, seq int, status string, owner string, action string",
    )
    assert sorted((r["account"], r["seq"]) for r in cases.state_changes(log).collect()) == [(1, 2), (1, 4), (2, 1)]
    members = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 7)], "ring_id int, id bigint")
    state = {r["ring_id"]: (r["state"], r["escalated"]) for r in cases.ring_containment(members, log).collect()}
    assert state == {1: ("In progress", 1), 2: ("Contained", 1), 3: ("Open", 0)}
    assert [r["account"] for r in cases.escalation_rows(members, log, 1).collect()] == [1]
