"""Many decision trees at once: one pass over the rows per level grows all bags.

Features are cut into at most BINS bins by their quantiles. At each level a task walks its rows down
every bag's tree as it is so far and counts rows and positives per open node, feature and bin; Spark
adds the counts up and picks the best cut of each node by impurity. What comes back to the driver
per level is one row for each open node, at most bags * 2 ** level of them at any table size.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringwatch.session import cut_lineage

BINS = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _draws(names: np.ndarray, key: int) -> np.ndarray:
    """A value in [0, 1) per row name and key."""
    x = (names ^ np.array([key], dtype=np.uint64) * _ODD) * _MIX
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return ((x ^ (x >> np.uint64(29))) * _MIX >> np.uint64(11)).astype(np.float64) / 2**53


class Bags:
    """Which rows a bag holds: a random share of the positives and about as many negatives. Each row has one
    bag that it never joins."""

    def __init__(self, bags: int, ratio: float, seed: int, share: float = 0.8):
        self.bags, self.ratio, self.seed, self.share = bags, ratio, seed, share

    def held(self, names: np.ndarray, label: np.ndarray, bag: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            home = np.floor(_draws(names, self.seed * 1_000 + 999) * self.bags)
            wanted = np.where(label == 1, self.share, self.share * self.ratio)
            return (_draws(names, self.seed * 1_000_003 + bag + 1) < wanted) & (home != bag)


class Trees:
    """Feature, bin and value by bag and node; node 1 is the root, 2k and 2k + 1 are below k."""

    def __init__(self, bags: int, depth: int):
        size = 2 ** (depth + 1)
        self.feature = np.full((bags, size), -1, dtype=np.int32)
        self.cut = np.zeros((bags, size), dtype=np.int32)
        self.value = np.zeros((bags, size))

    def walk(self, bag: int, bins: np.ndarray, levels: int) -> np.ndarray:
        node = np.ones(len(bins), dtype=np.int64)
        for _ in range(levels):
            f = self.feature[bag, node]
            go = np.flatnonzero(f >= 0)
            if not len(go):
                break
            node[go] = node[go] * 2 + (bins[go, f[go]] > self.cut[bag, node[go]])
        return node


def binned(df: DataFrame, features: list[str], label: str, identity: str, bins: int = BINS) -> DataFrame:
    """(identity, label, name, b0, b1, ...): the bin of each feature, gaps filled with its median; written once."""
    values = [F.col(f"`{c}`").cast("double") for c in features]
    shares = [k / bins for k in range(1, bins)]
    cuts = df.agg(*[F.percentile_approx(v, shares, 10_000).alias(f"q{i}") for i, v in enumerate(values)]).first()

    def place(i: int, v):
        edges = sorted(set(cuts[f"q{i}"] or []))
        if not edges:
            return F.lit(0)
        filled = F.coalesce(v, F.lit(cuts[f"q{i}"][bins // 2 - 1]))
        return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: filled > e))

    names = F.xxhash64(F.lit(71), identity).alias("name")
    return cut_lineage(df.select(identity, F.col(label).cast("int").alias(label), names, *[place(i, v).cast("int").alias(f"b{i}") for i, v in enumerate(values)]))


def _blocks(batch: pa.RecordBatch, label: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bins = np.column_stack([batch.column(f"b{i}").to_numpy() for i in range(width)])
    return batch.column("name").to_numpy().view(np.uint64), batch.column(label).to_numpy(zero_copy_only=False), bins


def _counts(rows: DataFrame, bags: Bags, trees: Trees, level: int, label: str, width: int) -> DataFrame:
    """(bag, node, feature, bin, n, pos) of the nodes of one level."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names, y, bins = _blocks(batch, label, width)
            codes, pos = [], []
            for bag in range(bags.bags):
                at = np.flatnonzero(bags.held(names, y, bag))
                node = trees.walk(bag, bins[at], level)
                at, node = at[node >= 2**level], node[node >= 2**level]
                code = ((bag << 32 | node)[:, None] * width + np.arange(width)) * BINS + bins[at]
                codes.append(code.ravel())
                pos.append(np.repeat(y[at] == 1, width))
            code, inverse, n = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
            if len(code):
                p = np.bincount(inverse, weights=np.concatenate(pos)).astype(np.int64)
                rest = code // BINS // width
                columns = [(rest >> 32).astype(np.int32), rest & 0xFFFFFFFF, (code // BINS % width).astype(np.int32), (code % BINS).astype(np.int32), n, p]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bag", "node", "feature", "bin", "n", "pos"])

    found = rows.mapInArrow(count, "bag int, node long, feature int, bin int, n long, pos long")
    return found.groupBy("bag", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def best_cuts(counts: DataFrame) -> DataFrame:
    """(bag, node, n, pos, feature, bin, gain): the cut of each node that lowers Gini impurity most; ties go to
    the first feature and bin. Without one the gain is 0."""
    whole = Window.partitionBy("bag", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = counts.withColumns(
        {"ln": F.sum("n").over(upto), "lp": F.sum("pos").over(upto), "tn": F.sum("n").over(whole), "tp": F.sum("pos").over(whole)}
    )
    rn, rp = F.col("tn") - F.col("ln"), F.col("tp") - F.col("lp")
    # n times impurity is 2 p (n - p) / n
    spread = lambda n, p: F.when(n > 0, 2.0 * p * (n - p) / n).otherwise(F.lit(0.0))
    gain = F.when(rn > 0, spread(F.col("tn"), F.col("tp")) - spread(F.col("ln"), F.col("lp")) - spread(rn, rp)).otherwise(F.lit(0.0))
    order = F.struct("gain", -F.col("feature"), -F.col("bin"))
    return each.withColumn("gain", gain).groupBy("bag", "node").agg(
        F.max("tn").alias("n"), F.max("tp").alias("pos"), F.max_by("feature", order).alias("feature"), F.max_by("bin", order).alias("bin"), F.max("gain").alias("gain")
    )


def grow(rows: DataFrame, bags: Bags, depth: int, label: str, width: int) -> Trees:
    trees = Trees(bags.bags, depth)
    for level in range(depth + 1):
        open_nodes = best_cuts(_counts(rows, bags, trees, level, label, width)).collect()
        grown = False
        for r in open_nodes:
            trees.value[r["bag"], r["node"]] = r["pos"] / r["n"]
            if level < depth and r["gain"] > 1e-12:
                trees.feature[r["bag"], r["node"]], trees.cut[r["bag"], r["node"]] = r["feature"], r["bin"]
                grown = True
        if not grown:
            break
    return trees


def out_of_bag_scores(df: DataFrame, features: list[str], bags: Bags, depth: int, label: str, identity: str, score: str) -> DataFrame:
    """(identity, label, score, n_bags): the mean over the bags that do not hold a row."""
    width = len(features)
    rows = binned(df, features, label, identity)
    trees = grow(rows, bags, depth, label, width)
    id_type = df.schema[identity].dataType.simpleString()

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, y, bins = _blocks(batch, label, width)
            total, n = np.zeros(len(names)), np.zeros(len(names), dtype=np.int64)
            for bag in range(bags.bags):
                at = np.flatnonzero(~bags.held(names, y, bag))
                total[at] += trees.value[bag, trees.walk(bag, bins[at], depth)]
                n[at] += 1
            with np.errstate(invalid="ignore"):
                yield pa.RecordBatch.from_arrays([batch.column(identity), batch.column(label), pa.array(total / n), pa.array(n)], [identity, label, score, "n_bags"])

    return rows.mapInArrow(mean, f"{identity} {id_type}, {label} int, {score} double, n_bags long")
