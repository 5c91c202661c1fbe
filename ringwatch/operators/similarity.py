"""Behavioural similarity: standardised vectors, cosine pairs, neighbours, cohesion.

Pairs at a fixed cut are found by cells of near vectors (`metric`). Where a share of all pairs is
wanted, blocks are compared with one matrix product per task; a task holds two bounded blocks
whatever the data size, and hands back only counts or the pairs that are asked for.
"""

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from ringwatch import constants as K
from ringwatch.functions.hashing import uniform
from ringwatch.operators.metric import DIGITS, matrix, near_pairs, nearest
from ringwatch.operators.running import exact_quantiles, fraction, row_numbers
from ringwatch.session import cut_lineage

BLOCK_ROWS = 2048
#: rows of a block of the comparison of all pairs: 16 MB of vectors at 64 dimensions
TILE_ROWS = 32_768
#: blocks that are wanted while they are not full: 136 tiles to share out
BUSY_BLOCKS = 16
#: a part of a tile is that many rows and columns, 2 MB of cosines
PART_ROWS = 512
#: groups whose vector sums a task holds before it hands them on
HELD_GROUPS = 4096


def _with_filled_medians(stats: DataFrame, medians: DataFrame, by: list[str]) -> DataFrame:
    """Mean and spread of each dimension after its gaps are filled with the median.

    Both follow from the counts, so the cells are not read again.
    """
    gaps = F.col("n_all") - F.col("n")
    mean = (F.col("mean") * F.col("n") + F.col("med") * gaps) / F.col("n_all")
    shift, med_shift = F.col("mean") - mean, F.col("med") - mean
    var = (F.col("n") * (F.col("std") * F.col("std") + shift * shift) + gaps * med_shift * med_shift) / F.col("n_all")
    return stats.join(medians, by, "left").select(
        *by,
        "med",
        F.when(gaps == 0, F.col("mean")).otherwise(mean).alias("mean"),
        F.when(gaps == 0, F.col("std")).otherwise(F.sqrt(var)).alias("std"),
    )


def fitted_statistics(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _stats): median, mean and spread of every dimension as one array row per key."""
    by = [*keys, "dim"]
    cells = vectors.select(*keys, F.posexplode("vector").alias("dim", "x"))
    stats = cells.groupBy(*by).agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("n"),
        F.count(F.lit(1)).alias("n_all"),
    )
    if vectors.where(F.exists("vector", lambda x: x.isNull())).isEmpty():
        stats = stats.withColumn("med", F.lit(None).cast("double"))
    else:
        stats = _with_filled_medians(stats, exact_quantiles(cells, "x", {"med": 0.5}, by), by)
    return stats.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("dim", "med", "mean", "std"))),
            lambda s: F.struct(s["med"].alias("med"), s["mean"].alias("mean"), s["std"].alias("std")),
        ).alias("_stats")
    )


def with_statistics(rows: DataFrame) -> DataFrame:
    """Vectors filled and scaled by the statistics beside them."""

    def scaled(x: Column, s: Column) -> Column:
        centred = F.coalesce(x, s["med"]) - s["mean"]
        return F.when(s["std"] > 0, centred / s["std"]).otherwise(centred)

    return rows.withColumn("vector", F.zip_with("vector", "_stats", scaled)).drop("_stats")


def impute_and_standardise(vectors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Replace missing cells by the median of their dimension, then scale to mean 0, spread 1.

    Dimensions without spread are only centred. The statistics are one value per dimension;
    they are joined as one array row (per key).
    """
    keys = keys or []
    packed = fitted_statistics(vectors, keys)
    return with_statistics(vectors.join(packed, keys) if keys else vectors.withColumn("_stats", packed.scalar()))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Scale to length one; a zero vector stays zero."""
    length = F.sqrt(_dot(F.col("vector"), F.col("vector")))
    return (
        vectors.withColumn("_len", length)
        .withColumn(
            "vector", F.transform("vector", lambda x: F.when(F.col("_len") > 0, x / F.col("_len")).otherwise(x))
        )
        .drop("_len")
    )


def standard_units(vectors: DataFrame) -> DataFrame:
    """Imputed, standardised, length-one vectors, written once for the passes that follow."""
    return cut_lineage(unit_vectors(impute_and_standardise(vectors)).select("id", "vector"))


def _block_count(df: DataFrame, block_rows: int) -> int:
    return max(1, math.ceil(df.count() / block_rows))


def _wanted_blocks(units: DataFrame, block_rows: int) -> int:
    """Blocks are as large as a task's memory allows, and only as many as keep the cores busy."""
    rows = units.count()
    return max(1, math.ceil(rows / block_rows), min(BUSY_BLOCKS, math.ceil(rows / PART_ROWS)))


def _own_block(n: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def _self_blocks(units: DataFrame, block_rows: int) -> DataFrame:
    """A row per vector and pair of blocks that it takes part in: what a shuffle of the tiles would move."""
    n = _wanted_blocks(units, block_rows)
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = units.select("id", "vector", _own_block(n).alias("_own")).withColumn("_other", other)
    return dealt.select("id", "vector", "_own", F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"))


def _packed(units: DataFrame, block_rows: int) -> DataFrame:
    """(block, dims, ids, vectors): a row for each block of vectors, alone in its partition, written once."""
    n = _wanted_blocks(units, block_rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            block = pa.Table.from_batches(held)
            x, ids = matrix(block.column("vector")), block.column("id").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block.column("_own")[0].as_py()], pa.int32()), pa.array([x.shape[1]], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([x.tobytes()], pa.binary()),
                ],
                ["block", "dims", "ids", "vectors"],
            )

    dealt = units.select(F.col("id").cast("long").alias("id"), "vector", _own_block(n).alias("_own")).repartitionById(n, F.col("_own"))
    return cut_lineage(dealt.mapInArrow(pack, "block int, dims int, ids array<long>, vectors binary"))


def _codes(x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, cosines in millionths) of each part of a tile; what is no pair is minus infinity."""
    turned = np.ascontiguousarray(y.T)
    for i in range(0, len(x), PART_ROWS):
        for j in range(i if same else 0, len(y), PART_ROWS):
            codes = x[i : i + PART_ROWS] @ turned[:, j : j + PART_ROWS]
            codes *= 10**DIGITS
            np.rint(codes, out=codes)
            if same and i == j:
                codes[np.tri(len(codes), dtype=bool)] = -np.inf
            yield i, j, codes


def _tiles(blocks: DataFrame, masks: np.ndarray | None, work: Callable, schema: str) -> DataFrame:
    """`work(replicate, parts, left ids, right ids)` on the cosines of every pair of blocks, for all replicates.

    The packed blocks meet in a cartesian product, which reads them where they were written: no copy
    of a vector is shuffled. `masks` has a row of zeros and ones per replicate: the dimensions it
    uses; without masks the vectors are taken as they are. A tile reads its vectors once and is
    walked in small parts; of its cosines only one part is held. Right ids are None where a block
    meets itself. `work` yields tables of the schema.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                same = row["block"].as_py() == row["_block"].as_py()
                x, y = (np.frombuffer(row[v].as_buffer(), dtype=np.float64).reshape(-1, row["dims"].as_py()) for v in ("vectors", "_vectors"))
                left, right = (row[i].values.to_numpy(zero_copy_only=False) for i in ("ids", "_ids"))
                for r, mask in enumerate([None] if masks is None else masks):
                    if mask is None:
                        sides = x, y
                    else:
                        sides = [v * mask / np.maximum(np.linalg.norm(v * mask, axis=1, keepdims=True), 1e-300) for v in (x, y)]
                    for table in work(r, _codes(*sides, same), left, None if same else right):
                        yield from table.cast(arrow).to_batches()

    others = blocks.select(*[F.col(c).alias(f"_{c}") for c in ("block", "ids", "vectors")])
    return blocks.hint("shuffle_replicate_nl").join(others, F.col("block") <= F.col("_block")).mapInArrow(run, schema)


def _counted(wanted: dict[int, list[int]] | None) -> Callable:
    """Counts pairs by cosine: in thousandths, or in millionths inside the wanted thousandths."""
    coarse = 10 ** (DIGITS - 3)
    # cosines of unit vectors can pass one by rounding; the bins of thousandths start at -1.002
    low = 10**3 + 2

    def work(r, parts, _left, _right):
        bins = {w: np.zeros(coarse, dtype=np.int64) for w in wanted[r]} if wanted else np.zeros(2 * low, dtype=np.int64)
        for _, _, codes in parts:
            values = codes.ravel() if codes[-1, 0] > -np.inf else codes[codes > -np.inf]
            if wanted is None:
                bins += np.bincount((values / coarse + low).astype(np.int64), minlength=2 * low)
            else:
                for w, n in bins.items():
                    inside = values[(values >= w * coarse) & (values < (w + 1) * coarse)]
                    n += np.bincount((inside - w * coarse).astype(np.int64), minlength=coarse)
        for first, n in [(-low, bins)] if wanted is None else [(w * coarse, n) for w, n in bins.items()]:
            at = np.flatnonzero(n)
            yield pa.table({"replicate": np.full(len(at), r, dtype=np.int32), "code": at + first, "n": n[at]})

    return work


def _lowest_code(cut: float) -> float:
    """The lowest cosine in millionths that reaches the cut."""
    if math.isinf(cut):
        return cut
    code, scale = round(cut * 10**DIGITS), 10**DIGITS
    return float(min(c for c in range(code - 2, code + 3) if c / scale >= cut))


def _merge(parents: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of all nodes after the links (a, b) are added to settled `parents`; a root is the lowest of its tree."""
    while True:
        one, two = parents[a], parents[b]
        apart = one != two
        if not apart.any():
            return parents
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        parents[np.maximum(one, two)] = np.minimum(one, two)
        while True:
            up = parents[parents]
            if np.array_equal(up, parents):
                break
            parents = up


def _forest(cuts: list[float]) -> Callable:
    """Links of a spanning forest of the pairs of a tile at or above the cut of the replicate, as
    (src, dst, pairs): ids carry the replicate, and the first link the number of pairs of the tile."""
    lowest, total = [_lowest_code(c) for c in cuts], len(cuts)

    def work(r, parts, left, right):
        ids = left if right is None else np.concatenate([left, right])
        shift = 0 if right is None else len(left)
        parents, pairs = np.arange(len(ids)), 0
        for i, j, codes in parts:
            row, column = np.divmod(np.flatnonzero(codes.ravel() >= lowest[r]), codes.shape[1])
            pairs += len(row)
            parents = _merge(parents, row + i, column + (j + shift))
        linked = np.flatnonzero(parents != np.arange(len(ids)))
        n = np.zeros(len(linked), dtype=np.int64)
        n[:1] = pairs
        yield pa.table({"src": ids[parents[linked]] * total + r, "dst": ids[linked] * total + r, "pairs": n})

    return work


def _above(cut: float) -> Callable:
    """All pairs at or above the cut."""
    lowest = _lowest_code(cut)

    def work(_r, parts, left, right):
        others = left if right is None else right
        for i, j, codes in parts:
            row, column = np.nonzero(codes >= lowest)
            if len(row):
                x, y = left[row + i], others[column + j]
                yield pa.table({"src": np.minimum(x, y), "dst": np.maximum(x, y), "similarity": codes[row, column] / 10**DIGITS + 0.0})

    return work


def masked_cuts(units: DataFrame, masks: np.ndarray, quantile: float, block_rows: int = TILE_ROWS) -> list[float | None]:
    """Per replicate the cosine, in six digits, that the given share of all pairs stays below."""
    return _cuts(_packed(units, block_rows), masks, quantile)


def _cuts(blocks: DataFrame, masks: np.ndarray, quantile: float) -> list[float | None]:
    """Per replicate the cosine, in six digits, that the given share of all pairs stays below.

    Two passes of tiles count: cosines to three digits first, then only those about the wanted
    ranks to six. What comes back to the driver is a few thousand counts a replicate at any size.
    """
    coarse = 10 ** (DIGITS - 3)

    def counts(wanted=None) -> dict[int, list[tuple[int, int]]]:
        found = _tiles(blocks, masks, _counted(wanted), "replicate int, code long, n long")
        out: dict[int, list] = {r: [] for r in range(len(masks))}
        for row in found.groupBy("replicate", "code").agg(F.sum("n").alias("n")).collect():
            out[row["replicate"]].append((row["code"], row["n"]))
        return {r: sorted(v) for r, v in out.items()}

    first, ranks, wanted, before = counts(), {}, {}, {}
    for r, bins in first.items():
        total = sum(n for _, n in bins)
        num, den = fraction(quantile)
        low, share = divmod(num * (total - 1), den) if total else (0, 0)
        ranks[r] = (low, min(low + 1, total - 1), share / den)
        wanted[r], before[r], seen = [], {}, 0
        for value, n in bins:
            if any(seen <= k < seen + n for k in ranks[r][:2]):
                wanted[r].append(value)
                before[r][value] = seen
            seen += n
    cuts = []
    for r, codes in counts(wanted).items():
        values = {}
        for k in ranks[r][:2]:
            at: dict[int, int] = dict(before[r])
            for code, n in codes:
                if at[code // coarse] <= k < at[code // coarse] + n:
                    values[k] = code
                at[code // coarse] += n
        low, high, share = ranks[r]
        scale = 10.0**DIGITS
        cuts.append(values[low] / scale + (values[high] / scale - values[low] / scale) * share if values else None)
    return cuts


def pair_count(units: DataFrame) -> int:
    n = units.count()
    return n * (n - 1) // 2


def similarity_cut(units: DataFrame, quantile: float = K.EDGE_QUANTILE, block_rows: int = TILE_ROWS) -> float | None:
    """The similarity that the given share of all pairs stays below."""
    return _cut(_packed(units, block_rows), quantile)


def _cut(blocks: DataFrame, quantile: float) -> float | None:
    first = blocks.select("dims").first()
    return _cuts(blocks, np.ones((1, first["dims"])), quantile)[0] if first else None


def similar_pairs(units: DataFrame, min_similarity: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, dst, similarity) of all pairs of unit vectors at or above the cut; smaller id first."""
    return near_pairs(units, min_similarity, cell_rows=block_rows)


def similarity_graph(
    vectors: DataFrame, quantile: float = K.EDGE_QUANTILE, block_rows: int = TILE_ROWS, forest: bool = False
) -> DataFrame:
    """Edges (src, dst, similarity) between the most similar pairs, after imputing and standardising.

    The cut is a single number and is read at plan time. A share of all pairs takes every block
    against every other, and the edges are a share of them: meant for the confirmed positives. For
    large sets give `similar_pairs` a fixed cut, which compares near cells only.

    With `forest` the pairs are met but not listed: a tile hands back (src, dst, pairs), links that
    join what its edges join, at most one a vector, and in all of `pairs` the number of its edges.
    """
    blocks = _packed(standard_units(vectors), block_rows)
    cut = _cut(blocks, quantile)
    cut = math.inf if cut is None else cut
    if forest:
        return cut_lineage(_tiles(blocks, None, _forest([cut]), "src long, dst long, pairs long"))
    return _tiles(blocks, None, _above(cut), "src long, dst long, similarity double")


def ego_network(vectors: DataFrame, centre: int, k: int = K.EGO_NEIGHBOURS) -> DataFrame:
    """The k most similar accounts of one account, ties by id."""
    units = standard_units(vectors)
    one = units.where(F.col("id") == centre).select("vector")
    sims = (
        units.where(F.col("id") != centre)
        .withColumn("_c", one.scalar())
        .select("id", F.bround(_dot(F.col("vector"), F.col("_c")), DIGITS).alias("similarity"))
    )
    return sims.orderBy(F.desc("similarity"), "id").limit(k)


def similarity_to_positives(
    vectors: DataFrame, label: str, fold: str | None = None, k: int = K.SIMILAR_POSITIVES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, positive_similarity): mean of the k highest cosines to positives of other folds.

    A positive never counts for rows of its own fold (without folds, never for itself). Both
    sides are cut into blocks; a task returns the k best per row and the last step merges k
    values per block, so no row meets all positives at once.
    """
    units = unit_vectors(vectors)
    # counted twice and read by both sides of the block join: written once
    side = cut_lineage(
        units.select("id", "vector", (F.col(fold) if fold else F.lit(-1)).cast("int").alias("_f"), label)
    )
    positives = side.where(F.col(label) == 1).drop(label)
    rows = side.drop(label)
    n_rows, n_pos = _block_count(rows, block_rows), _block_count(positives, block_rows)

    def blocked(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(own_n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)))
        )

    def best(left, right):
        import numpy as np
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "similarity": []})
        sims = np.stack(left["vector"].to_numpy()) @ np.stack(right["vector"].to_numpy()).T
        ids = left["id"].to_numpy()
        own = ids[:, None] == right["id"].to_numpy()[None, :]
        lf, rf = left["_f"].to_numpy()[:, None], right["_f"].to_numpy()[None, :]
        sims[own | ((lf == rf) & (lf >= 0))] = -np.inf
        take = min(k, sims.shape[1])
        top = -np.partition(-sims, take - 1, axis=1)[:, :take]
        out = pd.DataFrame({"id": np.repeat(ids, take), "similarity": top.ravel()})
        return out[np.isfinite(out["similarity"])]

    left = blocked(rows, "_l", n_rows, "_r", n_pos).groupBy("_l", "_r")
    right = blocked(positives, "_r", n_pos, "_l", n_rows).groupBy("_l", "_r")
    partial = left.cogroup(right).applyInPandas(best, "id bigint, similarity double")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity")))
    top = partial.withColumn("_place", place).where(F.col("_place") <= k)
    return top.groupBy("id").agg(F.avg("similarity").alias("positive_similarity"))


def fold_similarity_to_positives(
    vectors: DataFrame, label: str, fold: str, folds: int, k: int = K.SIMILAR_POSITIVES, cell_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(fold, id, held_out, positive_similarity): for each held-out fold the mean of the k highest cosines
    of every row to the positives of the other folds.

    Medians, means and spreads are fitted on the other folds only, as a table with one row per
    fold, and applied to all rows. A positive of the other folds counts for itself, as it does
    in the feature that a model of these folds is trained on. Without positives there is no row.
    """
    rows = vectors.select("id", "vector", F.col(fold).cast("int").alias("_own"), (F.col(label) == 1).alias("_pos"))
    all_folds = F.array(*[F.lit(f) for f in range(folds)])
    training = rows.withColumn("fold", F.explode(F.array_except(all_folds, F.array("_own"))))
    fitted = cut_lineage(fitted_statistics(training, ["fold"]))
    # one row per fold
    scaled = with_statistics(rows.withColumn("fold", F.explode(all_folds)).join(F.broadcast(fitted), "fold"))
    units = cut_lineage(unit_vectors(scaled).withColumn("grp", F.col("fold").cast("long")))
    positives = units.where(F.col("_pos") & (F.col("_own") != F.col("fold")))
    top = nearest(units.select("grp", "id", "vector"), positives.select("grp", "id", "vector"), k, cell_rows)
    mean = F.aggregate("top", F.lit(0.0), lambda s, x: s + x) / F.size("top")
    return units.select("fold", "id", "grp", (F.col("_own") == F.col("fold")).alias("held_out")).join(
        top.select("grp", "id", mean.alias("positive_similarity")), ["grp", "id"]
    ).select("fold", "id", "held_out", "positive_similarity")


def _group_sums(grouped: DataFrame, group: str) -> DataFrame:
    """(group, n, own, s): rows, squared lengths and vector sum of each group, as parts of a task.

    The group can be a list, for vectors that are in many groups.
    """
    kind = grouped.schema[group].dataType
    many = isinstance(kind, ArrayType)
    key_type = (kind.elementType if many else kind).simpleString()

    def merged(keys, *sums):
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
        return keys[order][starts], *[np.add.reduceat(v[order], starts, axis=0) for v in sums]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def part() -> pa.RecordBatch:
            keys, n, own, s = held
            lists = pa.ListArray.from_arrays(np.arange(0, s.size + 1, s.shape[1], dtype=np.int32), pa.array(s.ravel()))
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(own), lists], [group, "n", "own", "s"])

        for batch in batches:
            if batch.num_rows:
                x, keys = matrix(batch.column("vector")), batch.column(group)
                rows = np.repeat(np.arange(len(x)), keys.value_lengths().to_numpy()) if many else np.arange(len(x))
                keys = (keys.flatten() if many else keys).to_numpy()
                order = np.argsort(keys, kind="stable")
                starts = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
                runs = np.split(rows[order], starts[1:])
                own = (x * x).sum(axis=1)
                new = keys[order][starts], np.array([len(k) for k in runs]), np.array([own[k].sum() for k in runs]), np.stack([x[k].sum(axis=0) for k in runs])
                held = new if held is None else merged(*[np.concatenate(pair) for pair in zip(held, new)])
                if len(held[0]) > HELD_GROUPS:
                    yield part()
                    held = None
        if held is not None:
            yield part()

    rows = grouped.where(F.col("vector").isNotNull()).select(group, "vector")
    return rows.mapInArrow(add, f"{group} {key_type}, n long, own double, s array<double>")


def _mean_pair_similarity(grouped: DataFrame, group: str) -> DataFrame:
    """Mean cosine over the pairs of each group from the sum of its unit vectors, pair-free."""
    cells = _group_sums(grouped, group).select(group, "n", "own", F.posexplode("s").alias("dim", "x"))
    sums = cells.groupBy(group, "dim").agg(F.sum("x").alias("s"), F.sum("n").alias("n"), F.sum("own").alias("own"))
    return (
        sums.groupBy(group)
        .agg(F.sum(F.col("s") * F.col("s")).alias("sq"), F.max("n").alias("n"), F.max("own").alias("own"))
        .select(
            group, "n", F.try_divide(F.col("sq") - F.col("own"), F.col("n") * (F.col("n") - 1)).alias("cohesion")
        )
    )


def ring_cohesion(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """(ring_id, n, cohesion): mean pair similarity inside each ring."""
    units = standard_units(vectors)
    return _mean_pair_similarity(members.select("ring_id", "id").join(units, "id"), "ring_id")


def random_groups(pool: DataFrame, size: int, groups: int = K.RANDOM_GROUPS, seed: int | str = 42) -> DataFrame:
    """(grp, id): random groups of distinct ids out of the pool.

    Ids are numbered once in seeded random order and cut into `size` equal stretches; a group
    takes one random place of every stretch, so no group can draw an id twice.
    """
    numbered = row_numbers(pool.select("id"), [], ["id"], seed, "rn")
    total = pool.agg(F.count(F.lit(1)).alias("c"))
    spark = pool.sparkSession
    draws = (
        spark.range(groups)
        .select(F.col("id").cast("int").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("j"))
        .withColumn("_total", total.scalar())
    )
    first = F.floor(F.col("j") * F.col("_total") / size)
    last = F.floor((F.col("j") + 1) * F.col("_total") / size)
    place = first + F.floor(uniform(f"{seed}g", "grp", "j") * (last - first))
    picks = draws.where(last > first).select("grp", place.cast("bigint").alias("rn"))
    # planned as a few rows, but as many as all groups have members: never to be broadcast
    return picks.hint("merge").join(numbered, "rn").select("grp", "id")


def cohesion_against_chance(
    vectors: DataFrame, members: DataFrame, pool: DataFrame, size: int, groups: int = K.RANDOM_GROUPS,
    seed: int | str = 42,
) -> DataFrame:
    """One row: cohesion of ring 1, and mean and 95th percentile over random groups of its size."""
    units = standard_units(vectors)
    # a vector is read once, beside the list of its groups
    picked = random_groups(pool, size, groups, seed).groupBy("id").agg(F.collect_list("grp").alias("grp"))
    chance = cut_lineage(_mean_pair_similarity(picked.join(units, "id"), "grp"))
    ring = _mean_pair_similarity(members.where("ring_id = 1").select("ring_id", "id").join(units, "id"), "ring_id")
    p95 = exact_quantiles(chance, "cohesion", {"p95": 0.95})
    return ring.select(F.col("n").alias("ring_size"), F.col("cohesion").alias("ring_similarity")).withColumns(
        {
            "chance_mean": chance.agg(F.avg("cohesion").alias("m")).scalar(),
            "chance_p95": p95.scalar(),
        }
    )


def ring_stability(
    vectors: DataFrame, dimensions: int, quantile: float, replicates: int = 30, share: float = 0.8,
    seed: int | str = 42, block_rows: int = TILE_ROWS,
) -> DataFrame:
    """(replicate, jaccard): overlap of the largest ring with the one of all dimensions, rebuilt on
    random parts of the dimensions.

    A dimension is imputed and scaled by itself, so vectors are prepared once; a rebuild is a mask on
    them, and a tile computes all masked products of its blocks. It hands back a spanning forest of
    each rebuilt graph. All go through one components run; node ids carry the replicate.
    """
    from ringwatch.operators.components import component_sizes, connected_components

    keep = max(5, int(dimensions * share))

    def part_of(r: int) -> list[int]:
        draw = sorted(range(dimensions), key=lambda d: hashlib.md5(f"{seed}:{r}:{d}".encode()).hexdigest())
        return sorted(draw[:keep])

    masks = np.ones((replicates + 1, dimensions))
    for r in range(replicates):
        masks[r + 1, np.setdiff1d(np.arange(dimensions), part_of(r))] = 0.0
    blocks = _packed(cut_lineage(impute_and_standardise(vectors).select("id", "vector")), block_rows)
    cuts = [math.inf if c is None else c for c in _cuts(blocks, masks, quantile)]
    total = replicates + 1
    edges = cut_lineage(_tiles(blocks, masks, _forest(cuts), "src long, dst long, pairs long"))
    comps = connected_components(edges)
    sizes = component_sizes(comps).withColumn("replicate", F.pmod("component", F.lit(total)).cast("int"))
    largest = sizes.groupBy("replicate").agg(
        F.max_by("component", F.struct("size", -F.col("component"))).alias("component")
    )
    members = comps.join(largest, "component").select(
        "replicate", F.expr(f"id div {total}").alias("id")
    )
    base = members.where("replicate = 0").select("id", F.lit(1).alias("_b"))
    n_base = base.agg(F.count(F.lit(1)).alias("c")).scalar()
    joined = members.where("replicate > 0").join(base, "id", "left")
    counts = joined.groupBy("replicate").agg(F.count(F.lit(1)).alias("n"), F.count("_b").alias("shared"))
    return counts.select(
        "replicate", (F.col("shared") / (F.col("n") + n_base - F.col("shared"))).alias("jaccard")
    )
