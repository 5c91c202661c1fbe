"""The similarity join by cells against the join of all blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringwatch.operators import metric, similarity


def units_frame(spark, x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")


def clusters(n, d, centres, spread, seed):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, d)) * spread


def wanted(x, cut):
    sims = np.round(x @ x.T, 6)
    i, j = np.nonzero(np.triu(sims >= cut, 1))
    return set(zip(i.tolist(), j.tolist()))


def compared(fitting, stuck):
    n = 0
    for m in fitting + stuck:
        for r in m.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("h")).collect():
            n += r["h"] * (r["h"] - 1) // 2 + r["h"] * (r["n"] - r["h"])
    return n + sum(m.count() ** 2 // 2 for m in stuck)


@pytest.mark.parametrize("cut", [0.99, 0.9, 0.7, 0.2, -0.5])
@pytest.mark.parametrize("spread", [0.05, 0.4])
def test_no_pair_is_lost_at_any_depth(spark, cut, spread):
    x, df = units_frame(spark, np.vstack([clusters(700, 8, 25, spread, 1), np.eye(8), np.eye(8)]))
    got = [(r["src"], r["dst"]) for r in metric.near_pairs(df, cut, cell_rows=40, pivots=8).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted(x, cut)


def test_equal_vectors_and_zero_vectors(spark):
    x = np.vstack([np.repeat(clusters(5, 6, 5, 0.1, 2), 60, axis=0), clusters(100, 6, 10, 0.2, 3)])
    x, df = units_frame(spark, x)
    df = df.unionByName(spark.createDataFrame([(9000 + i, [0.0] * 6) for i in range(50)], df.schema))
    got = [(r["src"], r["dst"]) for r in metric.near_pairs(df, 0.95, cell_rows=30, pivots=16).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted(x, 0.95)
    assert metric.near_pairs(df.limit(0), 0.95).count() == 0


def test_twenty_thousand_clustered_vectors(spark):
    """All pairs of the block form, with a small share of its comparisons."""
    n, cut = 20_000, 0.97
    x, df = units_frame(spark, clusters(n, 16, 400, 0.08, 5))
    df = df.repartition(8)
    fitting, stuck = metric.cells(df, cut)
    assert compared(fitting, stuck) < 0.15 * n * n / 2
    found = similarity.similar_pairs(df, cut)
    plain = 0
    for lo in range(0, n, 2000):
        sims = np.round(x[lo : lo + 2000] @ x.T, 6) >= cut
        plain += int(np.triu(sims, lo + 1).sum())
    assert plain > 100_000
    row = found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src", "dst").alias("d"), F.min("similarity").alias("m")).first()
    assert (row["n"], row["d"]) == (plain, plain) and row["m"] >= cut


def test_cut_at_a_share_of_all_pairs(spark):
    x, df = units_frame(spark, clusters(300, 5, 6, 0.5, 7))
    sims = np.round(x @ x.T, 6)[np.triu_indices(300, 1)]
    masks = np.ones((3, 5))
    masks[1, 0] = masks[2, 3] = 0
    cuts = similarity.masked_cuts(df, masks, 0.94, block_rows=70)
    for mask, cut in zip(masks, cuts):
        y = x * mask
        y = y / np.linalg.norm(y, axis=1, keepdims=True)
        sims = np.round(y @ y.T, 6)[np.triu_indices(300, 1)]
        assert cut == pytest.approx(np.quantile(sims, 0.94), abs=1e-9)
    assert similarity.similarity_cut(df.limit(0)) is None and similarity.similarity_cut(df.limit(1)) is None


def united(pairs):
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {v: find(v) for v in parent}


@pytest.mark.parametrize("block_rows", [70, 32_768])
def test_a_forest_stands_for_the_edges_of_a_share_of_all_pairs(spark, monkeypatch, block_rows):
    monkeypatch.setattr(similarity, "PART_ROWS", 64)
    _, df = units_frame(spark, clusters(600, 5, 12, 0.05, 3))
    pairs = [(r["src"], r["dst"]) for r in similarity.similarity_graph(df, 0.95, block_rows).collect()]
    assert len(pairs) > 8000 and len(set(pairs)) == len(pairs)
    forest = similarity.similarity_graph(df, 0.95, block_rows, forest=True).collect()
    tiles = math.ceil(600 / 64) if block_rows > 600 else math.ceil(600 / 70)
    # at most one link per vector and tile, not one per pair
    assert len(forest) <= 600 * (tiles + 1) < len(pairs)
    assert united([(r["src"], r["dst"]) for r in forest]) == united(pairs)
    assert sum(r["pairs"] for r in forest) == len(pairs)


def test_blocks_stay_few(spark):
    units = spark.range(60_000).select("id", F.array(F.lit(1.0)).alias("vector"))
    copies = similarity._self_blocks(units, similarity.TILE_ROWS)
    assert copies.count() == 60_000 * similarity.BUSY_BLOCKS  # by blocks of 2,048 rows they were 30 a vector


def test_tiles_shuffle_no_copies_of_vectors(spark, monkeypatch):
    """Blocks are packed once, one to a partition, and meet without an exchange."""
    monkeypatch.setattr(similarity, "PART_ROWS", 64)
    _, df = units_frame(spark, clusters(700, 5, 12, 0.05, 3))
    blocks = similarity._packed(df, 70)
    assert sorted(blocks.rdd.mapPartitions(lambda rows: [len([*rows])]).collect()) == [1] * 11
    assert blocks.agg(F.sum(F.size("ids"))).first()[0] == 700
    found = similarity._tiles(blocks, None, similarity._above(0.9), "src long, dst long, similarity double")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_members_of_random_groups_are_not_broadcast(spark):
    plan = similarity.random_groups(spark.range(1000), 500)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [rn" in plan


@pytest.mark.parametrize("cell_rows, spread", [(2048, 0.1), (25, 0.1), (25, 1.0)])
def test_nearest_equal_all_pairs(spark, cell_rows, spread):
    x, df = units_frame(spark, clusters(400, 6, 12, spread, 9))
    rows = df.withColumn("grp", F.explode(F.array(F.lit(0), F.lit(1), F.lit(7))))
    targets = df.where("id % 3 = 0").withColumn("grp", F.lit(0)).unionByName(df.where("id < 3").withColumn("grp", F.lit(1)))
    got = {(r["grp"], r["id"]): r["top"] for r in metric.nearest(rows, targets, 5, cell_rows, pivots=16).collect()}
    assert len(got) == 800  # group 7 has no targets
    for grp, ids in ((0, np.arange(0, 400, 3)), (1, np.arange(3))):
        top = -np.sort(-(x @ x[ids].T), axis=1)[:, :5]
        assert all(got[grp, i] == pytest.approx(top[i].tolist()) for i in range(400))


def test_fold_similarity_is_fitted_on_the_other_folds(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(90, 5)) * [1, 10, 0.1, 3, 1] + [0, 5, 0, 0, 9]
    gaps = rng.random(x.shape) < 0.1
    own, y = np.arange(90) % 4, np.arange(90) % 3 == 0
    rows = [(i, [None if g else float(v) for v, g in zip(x[i], gaps[i])], int(y[i]), int(own[i])) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, y int, f int")
    got = {(r["fold"], r["id"]): r for r in similarity.fold_similarity_to_positives(df, "y", "f", 4, cell_rows=13).collect()}
    assert len(got) == 360
    z = np.where(gaps, np.nan, x)
    for f in range(4):
        train = own != f
        med = np.nanmedian(z[train], axis=0)
        filled = np.where(np.isnan(z), med, z)
        scaled = (filled - filled[train].mean(axis=0)) / filled[train].std(axis=0)
        u = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
        for i in range(90):
            r = got[f, i]
            assert r["held_out"] == (own[i] == f)
            assert r["positive_similarity"] == pytest.approx(np.sort(u[train & y] @ u[i])[-5:].mean())
